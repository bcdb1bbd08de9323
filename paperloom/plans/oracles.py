"""The queries of the registry as plain SQL over the same tables, written without them.

The SQL states the expected result straight from the table columns; it does not go through
the JSON text that the Spark queries build and parse, except where walking JSON is the point.
"""

from __future__ import annotations

from paperloom.schemas import KIND_BY_SUFFIX, LICENCES
from paperloom.plans.views import MENTION_SUFFIXES, SPELLINGS, STOP_LIST

ORACLES: dict[str, str] = {}


def _uuid(key: str) -> str:
    h = f"md5(CAST({key} AS VARCHAR))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in cuts)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_ITEMS = f"""
items AS (
  SELECT l.*, p.*, {_uuid('l_orderkey')} AS paper,
         {_uuid('l_orderkey')} || {_list(MENTION_SUFFIXES)}[l_linenumber % 5 + 1] AS name
  FROM lineitem l JOIN part p ON l_partkey = p_partkey
)"""

_KIND = """CASE
  WHEN regexp_matches({0}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}[.]') THEN
    CASE substr({0}, 37)
      WHEN '.json' THEN 'paper' WHEN '.software.json' THEN 'software'
      WHEN '.jats.software.json' THEN 'jats' WHEN '.pub2tei.tei.software.json' THEN 'pub2tei'
      WHEN '.latex.tei.software.json' THEN 'latex' WHEN '.grobid.tei.software.json' THEN 'grobid'
    END
END"""

# every mention of the readable documents
_FOUND = f"""{_ITEMS},
readable AS (SELECT * FROM items WHERE l_discount <> 0.1),
found AS (
  SELECT paper, p_name AS software, p_brand AS wikidata, p_type AS type, 0 AS pos,
         l_orderkey, l_linenumber, l_partkey FROM readable
  UNION ALL
  SELECT paper, split_part(p_name, ' ', 2), '', l_returnflag, 1,
         l_orderkey, l_linenumber, l_partkey FROM readable
)"""

_EDGES = f"""{_ITEMS},
edges AS (SELECT DISTINCT paper AS "paperId", p_name AS "softwareId" FROM items)"""

_SOFTWARE = """
ranked AS (
  SELECT software, wikidata, type, row_number() OVER (
    PARTITION BY software ORDER BY l_orderkey, l_linenumber, l_partkey, pos, wikidata, type) AS r
  FROM found),
software AS (
  SELECT software AS "normalizedForm", wikidata AS "wikidataId", type AS "softwareType"
  FROM ranked WHERE r = 1)"""

ORACLES["top_software"] = f"""
WITH {_FOUND},
edges AS (SELECT DISTINCT paper, software FROM found WHERE software NOT IN {_in(STOP_LIST)}),
counts AS (SELECT software, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) >= 100)
SELECT row_number() OVER (ORDER BY n DESC, software) - 1 AS rank,
       software AS "softwareId", n AS n_papers
FROM counts ORDER BY n DESC, software LIMIT 10
"""

ORACLES["mentions_table"] = f"""
WITH {_FOUND} SELECT paper AS "paperId", software AS "softwareId" FROM found
"""

ORACLES["distinct_edges"] = f"""WITH {_EDGES} SELECT * FROM edges"""

ORACLES["papers_per_software"] = f"""
WITH {_EDGES} SELECT "softwareId", count(*) AS n_papers FROM edges
WHERE "softwareId" <> 'small widget' GROUP BY 1
"""

ORACLES["excluded_by_list"] = f"""
WITH {_EDGES} SELECT "softwareId", count(*) AS n_papers FROM edges
WHERE "softwareId" NOT IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) < 30)
GROUP BY 1
"""

ORACLES["frequent_software"] = f"""
WITH {_EDGES} SELECT "softwareId", count(*) AS n_papers FROM edges
GROUP BY 1 HAVING count(*) >= 1000
"""

ORACLES["frequent_count"] = f"""
WITH {_EDGES}, f AS (SELECT 1 FROM edges GROUP BY "softwareId" HAVING count(*) >= 100)
SELECT count(*) AS n_software FROM f
"""

ORACLES["restricted_edges"] = f"""
WITH {_EDGES} SELECT * FROM edges WHERE "softwareId" IN
  (SELECT "softwareId" FROM edges GROUP BY 1 HAVING count(*) >= 1000)
"""


def _pairs(edges: str, item_support: int, pair_support: int) -> str:
    return f"""
WITH {edges},
kept AS (SELECT * FROM edges WHERE "softwareId" IN
  (SELECT "softwareId" FROM edges GROUP BY 1 HAVING count(*) >= {item_support}))
SELECT a."softwareId" AS s1, b."softwareId" AS s2, count(*) AS n_papers
FROM kept a JOIN kept b ON a."paperId" = b."paperId" AND a."softwareId" < b."softwareId"
GROUP BY 1, 2 HAVING count(*) >= {pair_support}
"""


ORACLES["co_mentions"] = _pairs(
    _EDGES.replace("FROM items)", "FROM items WHERE p_name <> 'small widget')"), 1000, 60
)
ORACLES["co_mentions_wide"] = _pairs(
    f"""edges AS (SELECT DISTINCT {_uuid('o_custkey')} AS "paperId", p_name AS "softwareId"
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    100,
    320,
)
_FEATURES = f"""n AS (SELECT {_uuid('l_orderkey')} AS "paperId", unnest(['flag ' || l_returnflag,
      'status ' || l_linestatus, 'line ' || l_linenumber,
      'quantity ' || CAST(floor(l_quantity / 10) AS INTEGER)]) AS "softwareId" FROM lineitem),
    edges AS (SELECT DISTINCT * FROM n)"""
_CUSTOMERS = f"""edges AS (SELECT DISTINCT {_uuid('o_custkey')} AS "paperId", p_name AS "softwareId"
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
ORACLES["co_mentions_hot"] = _pairs(_FEATURES, 100, 1500)
ORACLES["co_mentions_equal"] = _pairs(_FEATURES, 1, 1)
ORACLES["top_pairs_of_all"] = _pairs(_CUSTOMERS, 1, 1) + "ORDER BY n_papers DESC, s1, s2 LIMIT 20"
ORACLES["top_pairs"] = _pairs(_EDGES, 100, 100) + "ORDER BY n_papers DESC, s1, s2 LIMIT 20"

ORACLES["software_dimension"] = f"WITH {_FOUND}, {_SOFTWARE} SELECT * FROM software"

ORACLES["mention_counts"] = f"""
WITH {_FOUND} SELECT software AS "normalizedForm", count(*) AS n FROM found GROUP BY 1
"""

ORACLES["mention_report"] = f"""
WITH {_FOUND} SELECT software || ';' || count(*) AS line FROM found GROUP BY software
"""

ORACLES["mentions_per_paper"] = f"""
WITH {_ITEMS} SELECT paper, p_name || ';' || split_part(p_name, ' ', 2) AS names,
       CAST(2 AS INTEGER) AS n
FROM items WHERE l_discount <> 0.1
"""

ORACLES["paper_mentions_stored"] = ORACLES["mentions_per_paper"]

ORACLES["mentions_with_software"] = f"""
WITH {_FOUND.replace("found AS (", "found AS MATERIALIZED (")}, {_SOFTWARE.replace("software AS (", "software AS MATERIALIZED (")}
SELECT paper AS "paperId", f.software AS "softwareId", s."normalizedForm", s."wikidataId",
       s."softwareType"
FROM found f LEFT JOIN (SELECT * FROM software WHERE "wikidataId" <> '') s
  ON f.software = s."normalizedForm"
"""

_PAPERS = f"""
papers AS (
  SELECT {_uuid('o_orderkey')} AS uuid,
         CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE year(o_orderdate) END AS INTEGER) AS year
  FROM orders WHERE o_orderpriority <> '1-URGENT')"""

ORACLES["papers_table"] = f"WITH {_PAPERS} SELECT * FROM papers"

ORACLES["stored_tables"] = f"""
WITH {_FOUND}, {_SOFTWARE}, {_PAPERS}
SELECT p.year, s."softwareType", count(*) AS n
FROM found f JOIN software s ON f.software = s."normalizedForm"
LEFT JOIN papers p ON f.paper = p.uuid GROUP BY 1, 2
"""

_LISTING = f"""{_ITEMS},
listing AS (
  SELECT paper, CASE l_tax WHEN 0.0 THEN upper(name) WHEN 0.01 THEN name || '.bak'
         WHEN 0.02 THEN 'x' || name ELSE name END AS file FROM items),
classified AS (
  SELECT file, substr(paper, 1, 2) AS shard, {_KIND.format('file')} AS kind,
         substr(file, 1, 36) AS paper_id, file LIKE '%.software.json' AS is_mention_file,
         length(split_part(file, '.', 1)) = 36 AS has_id_length
  FROM listing)"""

ORACLES["classified_files"] = f"WITH {_LISTING} SELECT * FROM classified"
ORACLES["shard_kind_counts"] = (
    f"WITH {_LISTING} SELECT shard, kind, count(*) AS n FROM classified GROUP BY 1, 2"
)
ORACLES["removable_by_name"] = (
    f"WITH {_LISTING} SELECT file, count(*) AS n FROM classified WHERE kind IS NOT NULL GROUP BY 1"
)

# The rejected text ends before its last brace.
ORACLES["rejected_documents"] = f"""
WITH {_ITEMS}
SELECT substr(paper, 1, 1) AS shard, name AS file,
  '{{' || CASE l_returnflag WHEN 'R' THEN '"file":"elsewhere.json",' ELSE '' END
  || '"title":"' || p_name || '","price":' || l_extendedprice
  || ',"amounts":[' || l_quantity || ',' || l_tax || ']' AS body
FROM items WHERE l_discount = 0.1
"""

ORACLES["provenance"] = f"""
WITH {_ITEMS}
SELECT name AS file, name AS file_key, p_name AS title, l_extendedprice AS price,
       l_quantity AS quantity, CAST(4 AS INTEGER) AS n_keys
FROM items WHERE l_discount <> 0.1
"""

ORACLES["concatenated_documents"] = f"""
WITH {_ITEMS}, names AS (
  SELECT name FROM items WHERE l_discount <> 0.1
  UNION ALL SELECT {_uuid('o_orderkey')} || '.json' FROM orders)
SELECT {_KIND.format('name')} AS kind, count(*) AS n FROM names GROUP BY 1
"""

_SUFFIXES = [*KIND_BY_SUFFIX, ".txt.json"]
ORACLES["scanned_tree"] = f"""
WITH c AS (SELECT *, {_uuid('c_custkey')} AS uuid FROM customer),
f AS (SELECT *, uuid || {_list(_SUFFIXES)}[c_custkey % {len(_SUFFIXES)} + 1] AS file FROM c)
SELECT substr(uuid, 1, 2) AS shard, file, {_KIND.format('file')} AS kind, uuid AS paper_id,
       c_custkey % 7 <> 0 AS readable, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name
FROM f WHERE {_KIND.format('file')} IS NOT NULL
"""

ORACLES["first_seen_across_folders"] = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY c_custkey % 2, c_nationkey, c_custkey) AS place FROM customer)
SELECT c_mktsegment AS "normalizedForm", c_name AS "wikidataId", 'x' AS "softwareType" FROM r WHERE place = 1
"""

ORACLES["merged_shards"] = f"""
WITH {_ITEMS}
SELECT substr(paper, 1, 1) AS shard, {_KIND.format('name')} AS kind, count(*) AS n,
       count(DISTINCT name) AS n_files, max(l_extendedprice) AS max_price
FROM items WHERE l_discount <> 0.1 GROUP BY 1, 2
"""

ORACLES["two_kind_merge"] = f"""
WITH {_ITEMS}
SELECT substr(paper, 1, 1) AS shard, {_KIND.format('name')} AS kind, count(*) AS n
FROM items WHERE l_discount <> 0.1 AND {_KIND.format('name')} IN ('paper', 'software') GROUP BY 1, 2
"""

ORACLES["compacted_in_two_runs"] = f"""
WITH {_ITEMS}
SELECT substr(paper, 1, 1) AS shard, {_KIND.format('name')} AS kind,
       count(*) FILTER (l_discount <> 0.1) AS n, count(*) FILTER (l_discount = 0.1) AS n_rejected
FROM items GROUP BY 1, 2
"""

ORACLES["changed_documents"] = f"""
WITH {_ITEMS}, kinds AS (SELECT *, {_KIND.format('name')} AS kind FROM items),
merged AS (SELECT DISTINCT paper, kind FROM kinds WHERE l_discount <> 0.1)
SELECT name AS file, count(*) AS n FROM kinds JOIN merged USING (paper, kind)
WHERE l_discount = 0.1 OR l_returnflag = 'R' GROUP BY 1
"""

ORACLES["removable_unchanged"] = f"""
WITH {_ITEMS}
SELECT substr(paper, 1, 1) AS shard, {_KIND.format('name')} AS kind, count(*) AS n
FROM items WHERE l_discount <> 0.1 GROUP BY 1, 2
"""

ORACLES["streamed_in_two_runs"] = f"""
WITH c AS (SELECT *, {_uuid('c_custkey')} AS uuid FROM customer),
f AS (SELECT *, uuid || {_list(_SUFFIXES)}[c_custkey % {len(_SUFFIXES)} + 1] AS file FROM c)
SELECT substr(uuid, 1, 2) AS shard, {_KIND.format('file')} AS kind,
       count(*) FILTER (c_custkey % 7 <> 0) AS n, count(*) FILTER (c_custkey % 7 = 0) AS n_rejected
FROM f WHERE {_KIND.format('file')} IS NOT NULL GROUP BY 1, 2
"""

ORACLES["strict_counts"] = f"""
WITH {_ITEMS}, c AS (
  SELECT count(*) AS documents, count(*) FILTER (l_discount = 0.1) AS malformed, 0 AS blank,
         count(*) FILTER ({_KIND.format('name')} IS NULL) AS without_kind, 0 AS without_paper_id,
         count(*) FILTER (l_discount <> 0.1 AND l_returnflag = 'R') AS other_file_key
  FROM items)
SELECT rule, CAST(n AS BIGINT) AS n FROM c UNPIVOT (n FOR rule IN (documents, malformed, blank, without_kind, without_paper_id, other_file_key))
"""

# --- profile ------------------------------------------------------------------------------

# Leaves of the JSON column `body` of a table `docs`.
_WALK = r"""
leaves AS (
  SELECT regexp_replace(substr(j.fullkey, 2), '\[[0-9]+\]', '[]', 'g') AS path,
    CASE WHEN j.type = 'NULL' OR j.type IS NULL THEN 'null' WHEN j.type = 'BOOLEAN' THEN 'bool'
         WHEN j.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
    CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(j.atom AS DOUBLE) END AS num,
    CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS str,
    CASE WHEN j.type = 'BOOLEAN' THEN CAST(j.atom AS BOOLEAN) END AS flag
  FROM docs, json_tree(docs.body) j
  WHERE coalesce(j.type, 'NULL') NOT IN ('OBJECT', 'ARRAY')
)"""

ORACLES["json_nested_paths"] = f"""
WITH docs AS (
  SELECT to_json({{'conv': conv_id, 'turn': {{'no': turn, 'role': role, 'lines':
    list_transform(string_split(text, chr(10)), lambda line: string_split(line, ' '))}},
    'none': []}}) AS body FROM conversations),
{_WALK}
SELECT path, kind, count(*) AS n, CAST(sum(length(str)) AS BIGINT) AS characters,
       min(num) AS low, max(num) AS high
FROM leaves GROUP BY 1, 2
"""

ORACLES["json_deep_paths"] = """
WITH t AS (SELECT repeat('.d', CAST(conv_id % 26 + 15 AS INTEGER)) AS top, * FROM conversations)
SELECT top || '.no' AS path, 'number' AS kind, count(*) AS n, CAST(sum(turn) AS DOUBLE) AS total,
       CAST(NULL AS BIGINT) AS characters FROM t GROUP BY 1
UNION ALL SELECT top || '.role', 'string', count(*), NULL, CAST(sum(length(role)) AS BIGINT) FROM t GROUP BY 1
"""

_EVENTS = f"""
docs AS (
  SELECT '{{"event":' || to_json({{'event_type': event_type, 'value': value, 'user_id': user_id,
      'large': value > 100, 'steps': [CAST(floor(value / 100) AS BIGINT)]}})
    || ',"props":' || props
    || ',"code":' || CASE event_type WHEN 'error' THEN CAST(user_id AS VARCHAR)
                     ELSE '"' || event_type || '"' END
    || ',"maybe":' || CASE WHEN value > 50 THEN 'null' ELSE '1.5' END
    || ',"none":[],"blank":{{}}}}' AS body
  FROM events),
{_WALK}"""

_PROFILE = """
groups AS (SELECT path, kind, num, str, count(*) AS n FROM leaves GROUP BY ALL),
kinds AS (
  SELECT path, kind, CAST(sum(n) AS BIGINT) AS n, min(num) AS low, max(num) AS high,
         bool_and(num = round(num)) AS integral,
         bool_and(CAST(CAST(num AS FLOAT) AS DOUBLE) = num) AS float32,
         CASE WHEN kind IN ('number', 'string') AND count(*) <= 20 THEN count(*) END AS n_distinct
  FROM groups GROUP BY 1, 2),
flags AS (
  SELECT path, count(*) FILTER (flag) AS n_true, count(*) FILTER (NOT flag) AS n_false
  FROM leaves WHERE kind = 'bool' GROUP BY 1),
nulls AS (
  SELECT path, CAST(sum(CASE WHEN kind = 'null' THEN n ELSE 0 END) AS BIGINT) AS n_null,
         count(*) FILTER (kind <> 'null') AS n_kinds FROM kinds GROUP BY 1),
profile AS (
  SELECT path, kind, n, n_null, n_distinct, low AS "min", high AS "max", integral, float32,
    CASE WHEN kind IN ('bool', 'null') THEN kind
         WHEN kind = 'string' THEN CASE WHEN n_distinct IS NULL THEN 'string' ELSE 'enum' END
         WHEN integral AND low < 0 THEN CASE
           WHEN low >= -128 AND high <= 127 THEN 'int8'
           WHEN low >= -32768 AND high <= 32767 THEN 'int16'
           WHEN low >= -2147483648 AND high <= 2147483647 THEN 'int32' ELSE 'int64' END
         WHEN integral THEN CASE WHEN high <= 255 THEN 'uint8' WHEN high <= 65535 THEN 'uint16'
           WHEN high <= 4294967295 THEN 'uint32' ELSE 'uint64' END
         WHEN float32 THEN 'float32' ELSE 'float64' END AS storage_type,
    CASE WHEN kind = 'bool' THEN n_true END AS n_true,
    CASE WHEN kind = 'bool' THEN n_false END AS n_false,
    n_kinds > 1 AS conflict
  FROM kinds JOIN nulls USING (path) LEFT JOIN flags USING (path)
  WHERE kind <> 'null' OR n_kinds = 0),
valued AS (
  SELECT g.path, g.kind, g.num, g.n, k.n_distinct,
    CASE WHEN g.kind = 'string' THEN g.str
         WHEN k.integral THEN CAST(CAST(g.num AS HUGEINT) AS VARCHAR)
         ELSE CAST(g.num AS VARCHAR) END AS value,
    CASE WHEN g.kind = 'string' THEN g.str
         WHEN k.integral THEN CAST(CAST(g.num AS HUGEINT) AS VARCHAR)
         ELSE printf('%.6f', g.num) END AS shown
  FROM groups g JOIN kinds k USING (path, kind) WHERE k.n_distinct IS NOT NULL)"""

ORACLES["json_field_profile"] = f"WITH {_EVENTS}, {_PROFILE} SELECT * FROM profile"
ORACLES["json_field_values"] = (
    f"WITH {_EVENTS}, {_PROFILE} SELECT path, kind, value, n, n_distinct FROM valued"
)
ORACLES["json_profile_report"] = f"""
WITH {_EVENTS}, {_PROFILE},
lists AS (
  SELECT path, kind, string_agg(';' || shown || ':' || n, '' ORDER BY num, shown) AS list
  FROM valued GROUP BY 1, 2)
SELECT path, kind, path || ';' || CASE
    WHEN kind = 'bool' THEN 'true:' || n_true || ';false:' || n_false
    WHEN storage_type = 'enum' THEN 'enum;' || n_distinct
    WHEN kind <> 'number' THEN storage_type
    WHEN integral THEN storage_type || ';' || CAST("min" AS HUGEINT) || ';' || CAST("max" AS HUGEINT)
    ELSE storage_type || ';' || printf('%.6f', "min") || ';' || printf('%.6f', "max")
  END || coalesce(list, '') AS line
FROM profile LEFT JOIN lists USING (path, kind)
"""

_COLUMNS = {
    ".order": "l_orderkey",
    ".line": "l_linenumber",
    ".quantity": "l_quantity",
    ".price": "l_extendedprice",
    ".discount": "l_discount",
    ".tax": "l_tax",
}
ORACLES["storage_types"] = (
    "WITH leaves AS ("
    + " UNION ALL ".join(
        f"SELECT '{path}' AS path, 'number' AS kind, CAST({c} AS DOUBLE) AS num, "
        "CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS flag FROM lineitem"
        for path, c in _COLUMNS.items()
    )
    + " UNION ALL SELECT '.flag', 'string', NULL, l_returnflag, NULL FROM lineitem),"
    + _PROFILE
    + " SELECT * FROM profile"
)

ORACLES["number_tests"] = """
WITH xs AS (
  SELECT l_extendedprice AS x FROM lineitem
  UNION ALL SELECT l_extendedprice / 1024 FROM lineitem
  UNION ALL SELECT l_quantity * 0.5 FROM lineitem)
SELECT x, x = round(x) AS integral, CAST(CAST(x AS FLOAT) AS DOUBLE) = x AS float32 FROM xs
"""

# --- identifiers -----------------------------------------------------------------------------

_CODES = {label: code for code, label, _ in LICENCES}
_CODES.update({alias: code for code, _, alias in LICENCES if alias})
_CODE_CASE = " ".join(f"WHEN '{spelling}' THEN {code}" for spelling, code in _CODES.items())
_LABEL_CASE = " ".join(f"WHEN {code} THEN '{label}'" for code, label, _ in LICENCES)

_IDS = f"""
raw AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS number, o_orderstatus AS status,
         o_orderpriority AS priority, o_totalprice AS price,
         {_uuid('o_orderkey')} AS uuid, upper(sha1(CAST(o_orderkey AS VARCHAR))) AS sha,
         CASE WHEN o_totalprice BETWEEN 100000 AND 110000 THEN 'CC-BY'
              ELSE {_list(SPELLINGS)}[o_orderkey % {len(SPELLINGS)} + 1] END AS license
  FROM orders),
rows AS (
  SELECT *,
    CASE WHEN priority = '2-HIGH' THEN upper(uuid) ELSE uuid END AS id,
    '10.1/' || number AS doi,
    CASE WHEN status <> 'F' THEN 'arXiv:' || number ELSE '' END AS arxiv,
    CASE WHEN priority = '1-URGENT' THEN '00' || number WHEN status = 'P' THEN '-' || number
         ELSE number END AS pmid,
    'PMC' || number || CASE WHEN price >= 400000 THEN '.2' ELSE '' END AS pmcid,
    CASE WHEN priority = '5-LOW' THEN lower(sha) WHEN price < 20000 THEN substr(sha, 1, 39)
         ELSE sha END AS istex,
    CASE WHEN status = 'F' THEN 'json,pdf' WHEN status = 'O' AND priority = '3-MEDIUM' THEN 'xml,epub'
         WHEN status = 'O' THEN 'latex,xml' ELSE '' END AS names,
    CASE license {_CODE_CASE} END AS code,
    'https://a.example/' || number AS oa_link
  FROM raw),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN status = 'P' AND priority <> '1-URGENT' AND k > 0 THEN 'pmid' END,
    CASE WHEN price >= 400000 THEN 'pmcid' END,
    CASE WHEN priority <> '5-LOW' AND price < 20000 THEN 'istexId' END,
    CASE WHEN names = 'xml,epub' THEN 'resources' END,
    CASE WHEN license = 'CC-BY' THEN 'license' END) AS errors,
    CASE names WHEN 'json,pdf' THEN '1,2' WHEN 'latex,xml' THEN '3,4' ELSE '' END AS codes
  FROM rows),
good AS (SELECT * FROM checked WHERE errors = '')"""

_STORED = """
SELECT replace(uuid, '-', '') AS id, doi, arxiv, k AS pmid, k AS pmcid, sha AS istex_id,
       codes AS resources, CAST(code AS INTEGER) AS license, {0} AS oa_link FROM good
"""
ORACLES["paper_ids_normalised"] = f"WITH {_IDS} {_STORED.format('oa_link')}"
ORACLES["paper_ids_stored"] = f"""WITH {_IDS} {_STORED.format("''")}"""
ORACLES["paper_ids_denormalised"] = f"""
WITH {_IDS} SELECT uuid AS id, doi, arxiv, number AS pmid, 'PMC' || number AS pmcid,
  sha AS "istexId", names AS resources, CASE code {_LABEL_CASE} END AS license, oa_link FROM good
"""
ORACLES["paper_id_errors"] = f"WITH {_IDS} SELECT id, errors FROM checked WHERE errors <> ''"
ORACLES["paper_ids_roundtrip_mismatches"] = f"""
WITH {_IDS}
SELECT id, 'id' AS field, id AS before, uuid AS after FROM good WHERE id <> uuid
UNION ALL SELECT id, 'pmid', pmid, number FROM good WHERE pmid <> number
UNION ALL SELECT id, 'istexId', istex, sha FROM good WHERE istex <> sha
"""
ORACLES["resource_codes"] = f"""
WITH {_IDS}, used AS (
  SELECT unnest(string_split(codes, ',')) AS c FROM checked WHERE codes <> '')
SELECT CAST(c AS INTEGER) AS code,
       CASE c WHEN '1' THEN 'json' WHEN '2' THEN 'pdf' WHEN '3' THEN 'latex' ELSE 'xml' END AS name,
       count(*) AS n
FROM used GROUP BY 1, 2
"""
_DIMENSION = ", ".join(f"({code}, '{label}')" for code, label, _ in LICENCES)
ORACLES["licence_counts"] = f"""
WITH {_IDS}, dim(code, label) AS (VALUES {_DIMENSION})
SELECT CAST(dim.code AS INTEGER) AS code, label, count(good.k) AS n
FROM dim LEFT JOIN good ON dim.code = good.code GROUP BY 1, 2
"""

# --- order, pending work -------------------------------------------------------------------------

_ORDER = "l_linenumber, l_partkey, l_extendedprice"
ORACLES["sorted_by_uuid"] = f"""
WITH {_ITEMS} SELECT row_number() OVER (ORDER BY paper, {_ORDER}) - 1 AS position, paper, {_ORDER}
FROM items
"""
ORACLES["sorted_last_wins"] = f"""
WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY paper ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS place FROM items)
SELECT paper, {_ORDER} FROM r WHERE place = 1
"""
# documents that tie go by their text: the flag and then the price differ
ORACLES["last_documents"] = f"""
WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY paper ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC,
  CAST(l_extendedprice AS VARCHAR) || '}}' DESC) AS place FROM items WHERE l_discount <> 0.1)
SELECT paper, l_linenumber, l_partkey, l_extendedprice AS price FROM r WHERE place = 1
"""
ORACLES["sorted_repeat_last"] = f"""
WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY paper ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS place FROM items)
SELECT r.name AS file, i.l_linenumber, i.l_partkey, i.l_extendedprice
FROM items i JOIN r ON r.paper = i.paper AND r.place = 1
"""
ORACLES["sorted_jsonl"] = f"""
WITH {_ITEMS} SELECT row_number() OVER (ORDER BY paper) - 1 AS position, paper
FROM items WHERE l_discount <> 0.1
"""

_WORK = f"""{_ITEMS},
listed AS (SELECT name AS file, paper AS paper_id, {_KIND.format('name')} AS kind,
  substr(paper, 1, 2) AS shard, l_partkey, l_shipdate FROM items),
merged AS (SELECT * FROM listed WHERE l_shipdate < TIMESTAMP '1998-01-01')"""
ORACLES["pending_documents"] = f"""
WITH {_WORK} SELECT file, paper_id, kind, shard, l_partkey FROM listed s WHERE NOT EXISTS
  (SELECT 1 FROM merged m WHERE m.paper_id = s.paper_id AND m.kind = s.kind)
"""
ORACLES["processed_documents"] = f"""
WITH {_WORK} SELECT file, paper_id, kind, shard, l_partkey FROM listed s WHERE EXISTS
  (SELECT 1 FROM merged m WHERE m.paper_id = s.paper_id AND m.kind = s.kind)
"""
ORACLES["pending_shards"] = f"""
WITH {_WORK}, finished AS (
  SELECT substr(paper_id, 1, 4) AS shard FROM merged WHERE kind IN ('jats', 'latex')
  GROUP BY 1 HAVING count(DISTINCT kind) = 2)
SELECT substr(paper_id, 1, 4) AS shard, count(*) AS n FROM listed
WHERE kind IN ('jats', 'latex') AND substr(paper_id, 1, 4) NOT IN (SELECT shard FROM finished) GROUP BY 1
"""
