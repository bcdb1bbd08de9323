"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, fertility, filter_audit, language, near_copies, personal, phrases, scoring, secrets, tiling, toxicity, vectors, warc
from paperloom.llm.hashed import remainder
from paperloom.llm.spans import digest_columns
from paperloom.session import staging_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary; the library that has them is only needed here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("html").cast("binary").alias("payload"),
    )
    path = staging_path(spark, "warc")
    warc.write_warc(warc.with_revisits(pages), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return warc.read_warc(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), size=3, threshold=85)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = digest_columns(F.col("spans"), secrets.BASE)
    return found.select("doc_id", *(c.alias(name) for name, c in columns.items()))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    model = scoring.fit(docs.where(~held_out))
    scored = scoring.score(docs.withColumn("held_out", held_out), model)
    return scored.withColumn("train_tokens", F.lit(model.lexicon.tokens).cast("long"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, *vocabulary())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    learned = remainder(F.col("doc_id"), 4) != 2
    models = toxicity.fit(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity.classify(docs.withColumn("held_out", held_out), models)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = digest_columns(F.col("spans"), personal.BASE)
    return found.select("doc_id", *(c.alias(name) for name, c in columns.items()))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    models = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = fertility.judge(docs, public_tokenizers.path("piece_bpe_32k.model"), *vocabulary())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", *fertility.LEAST, F.array_join("outside", ",").alias("outside"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(found, table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_near_copies": op2_near_copies,
    "op3_secrets": op3_secrets,
    "op4_scoring": op4_scoring,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_personal": op8_personal,
    "op9_language": op9_language,
    "op10_vectors": op10_vectors,
    "op11_quality": op11_quality,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id AND first IS NOT NULL
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM q""",
    "op2_near_copies": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                END AS s
            FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
        k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, k.b FROM r JOIN k ON r.other = k.a),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM s JOIN m USING (doc_id)""",
    "op10_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        k AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, k.b FROM r JOIN k ON r.other = k.a),
        m AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM k GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM m LEFT JOIN n USING (vec_id)""",
    "op12_phrases": """
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
        g AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS (
            SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS a
            FROM g GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
        d AS (
            SELECT DISTINCT c.lang, c.p FROM f c JOIN (
                SELECT lang, a, k, p, unnest(range(2, k)) AS m FROM f) x ON c.lang = x.lang AND c.k = x.m
            WHERE c.k >= 2 AND 100 * x.a::HUGEINT >= 80 * c.a
              AND len(list_filter(range(1, x.k - c.k + 2), lambda i: x.p[i:i + c.k - 1] = c.p)) > 0),
        c AS (
            SELECT f.*, unnest(range(1, k)) AS cut FROM f ANTI JOIN d ON f.lang = d.lang AND f.p = d.p
            WHERE k >= 2),
        s AS (
            SELECT c.lang, c.p, c.a, c.cut, l.a AS l, r.a AS r,
                   CAST((2000000::HUGEINT * c.a) // (l.a + r.a) AS BIGINT) AS score
            FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.cut]
                   JOIN f r ON r.lang = c.lang AND r.p = c.p[c.cut + 1:]),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS best FROM s),
        o AS (
            SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (
                PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
            FROM b WHERE best = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_filter_audit": """
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        f AS (
            SELECT doc_id, part,
                   len(w) < 50 AS a,
                   100 * len(list_distinct(w)) < 65 * len(w) AS b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
                   regexp_matches(text, '[#$%&*|]') AS d,
                   coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e
            FROM t),
        g AS (
            SELECT part, [a, b, c, d, e] AS fails,
                   coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
                   coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
            FROM f),
        s AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM g GROUP BY ALL),
        l AS (SELECT unnest(range(1, 6)) AS i),
        o AS (
            SELECT a.i || '' || b.i || c.i || d.i || e.i AS o FROM l a, l b, l c, l d, l e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        p AS (
            SELECT part, o, l.i AS step, CAST(substr(o, l.i, 1) AS INTEGER) AS own, n, good, toxic, fails,
                   list_bool_or(list_transform(range(1, l.i), lambda k: fails[CAST(substr(o, k, 1) AS INTEGER)])) AS earlier
            FROM s, o, l),
        r AS (
            SELECT part, translate(o, '12345', 'ABCDE') AS filter_order, step, own,
                   sum(n) FILTER (NOT coalesce(earlier, false) AND NOT fails[own]) AS kept,
                   sum(n) FILTER (NOT coalesce(earlier, false) AND fails[own]) AS removed,
                   sum(n) FILTER (earlier AND fails[own]) AS redundant,
                   sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
                   sum(good) FILTER (NOT coalesce(earlier, false) AND fails[own]) AS good_lost,
                   sum(toxic) FILTER (NOT coalesce(earlier, false) AND fails[own]) AS toxic_lost
            FROM p GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step,
               CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
        FROM r""",
}
