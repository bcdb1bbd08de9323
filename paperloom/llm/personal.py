"""Personal data: fixed formats, and identifiers found by the contexts these stand in.

All of it is DataFrame and SQL functions. The base kinds are ``email``, ``ip`` (parts up to
255), ``card`` (12 to 19 digits, Luhn) and ``phone`` (9 to 15 digits); of each kind the
leftmost matches without overlap count, and those that fail their check are dropped.

The rest is bootstrapped. Words with a digit are candidates, and the two words before one
are its pattern. Candidates that touch a base match are the seeds. Patterns and instances
(the candidates' texts) make a graph: a pattern's confidence is the mean score of its
instances, an instance scores 1 as a seed and otherwise as its best confident pattern; this
is repeated ``ROUNDS`` times. What then stands behind a pattern of at least ``CONFIDENCE``
and ``SUPPORT`` instances, and is not in a base match, is a span of kind ``context``.

Places count code points, ends are exclusive; spans come by start, then by kind as listed.
Null and empty texts have none. Rows go by themselves, ids may be null or repeat. Patterns
never go back over what they matched, so a text's cost is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.once import once
from paperloom.session import stage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "context")
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 10
LEAST_LENGTH = 6
#: Characters before a candidate in which its context is looked for.
REACH = 60

LOCAL = "[A-Za-z0-9._%+-]"
#: A match can only begin where a run of its first characters does, or where the last match
#: ended; possessive repeats say so to the engine without changing what is matched.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind, looked for first.
HINTS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){11}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]",
}
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "struct<start:int,k:int,end:int,kind:string>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    """True when every second digit from the right, doubled, completes the sum to tens."""
    digits = F.reverse(_digits(found))
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _check(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        n = F.length(_digits(found))
        return F.when((n >= 12) & (n <= 19), _luhn(found)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places: ``array<struct<start, end, found, before>>``.

    Splitting gives the text between the matches, so places are sums of lengths; ``before``
    is the end of what precedes a match since the last one.
    """
    rows = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
    start = F.struct(F.lit(0).alias("at"), rows.alias("out"))
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("before")
    )

    def add(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["before"])
        end = begin + F.length(part["found"])
        row = F.struct(
            begin.alias("start"),
            end.alias("end"),
            part["found"].alias("found"),
            F.right(part["before"], F.lit(REACH)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    # the text after the last match has no match beside it
    return F.aggregate(F.filter(parts, lambda p: p["found"].isNotNull()), start, add, lambda acc: acc["out"])


def _spans(kind: str, found: Column) -> Column:
    kept = F.filter(found, lambda m: _check(kind, m["found"]))
    return F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``, the spans of the base kinds in order."""
    none = F.array().cast(f"array<{SPAN}>")
    for kind in BASE:
        hit = F.col(text).rlike(HINTS[kind])
        df = once(df, **{f"__{kind}": F.when(hit, _spans(kind, located(F.col(text), PATTERNS[kind]))).otherwise(none)})
    names = [f"__{kind}" for kind in BASE]
    return df.withColumn("base", F.array_sort(F.concat(*names))).drop(*names)


def _context(before: Column) -> Column:
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")


def candidates(text: Column, base: Column) -> Column:
    """Words with a digit: ``array<struct<start, end, core, context, seed>>``, without the
    punctuation around them."""

    def row(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["found"], r"^[^\p{L}\p{N}+]*+", 0))
        core = F.regexp_replace(F.regexp_replace(m["found"], r"^[^\p{L}\p{N}+]++", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        start = m["start"] + lead
        end = start + F.length(core)
        seed = F.exists(base, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
        return F.struct(
            start.alias("start"), end.alias("end"), core.alias("core"), _context(m["before"]).alias("context"), seed.alias("seed")
        )

    found = F.transform(located(text, CANDIDATE), row)
    return F.filter(found, lambda c: (F.length(c["core"]) >= LEAST_LENGTH) & (c["context"] != ""))


def patterns(found: DataFrame) -> DataFrame:
    """(context, confidence, support) of the confident patterns among candidates (context, core,
    seed). Both sides of the graph are aggregated in parts; its edges are its distinct pairs."""
    edges = stage(
        found.groupBy("context", "core").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pattern-edges"
    )
    # only patterns of a seed can ever score
    scores = edges.where("seed = 1").select("core", F.lit(1.0).alias("score")).distinct()
    chosen = None
    for _ in range(ROUNDS):
        scored = edges.join(scores, "core", "left")
        chosen = stage(
            scored.groupBy("context")
            .agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("confidence"), F.count("score").alias("support"))
            .where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)),
            "patterns",
        )
        reached = edges.join(chosen, "context").groupBy("core").agg(F.max("confidence").alias("score"))
        seeds = edges.where("seed = 1").select("core", F.lit(1.0).alias("score"))
        scores = seeds.unionByName(reached).groupBy("core").agg(F.max("score").alias("score"))
    return chosen


def find_personal(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``spans``: ``array<struct<start, k, end, kind>>``; without the text unless
    ``keep_text``."""
    kept = [c for c in df.columns if c not in ("spans", "base", "found", "__row") and (keep_text or c != text)]
    source = df.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = [f"c_{i}" for i in range(len(kept))]
    rows = once(base_spans(source, "__text"), found=candidates(F.col("__text"), F.col("base")))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("__row"), *own, "base", "found"), "personal")
    found = rows.select("__row", F.explode("found").alias("c")).select("__row", "c.*")
    chosen = patterns(found)
    new = found.where(~F.col("seed")).join(chosen, "context")
    span = F.struct("start", F.lit(KINDS.index("context")).alias("k"), "end", F.lit("context").alias("kind"))
    more = new.groupBy("__row").agg(F.collect_list(span).alias("more"))
    out = rows.join(more, "__row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return out.select(*[F.col(c).alias(name) for c, name in zip(own, kept, strict=True)], spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds; overlapping ones become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(
        spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
