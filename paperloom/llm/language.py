"""Language identification by interpolated Kneser-Ney character models.

One model per language, over words of letters in lower case, each with the space before and
after it. Letters go by Unicode class, and marks belong to the letter before them. The models are fitted on a bounded sample of labelled texts (``sample`` per
language); Spark counts their n-grams, and the tables of probabilities and backoff weights
are arrays sorted by n-gram hash. Every text is scored whole under every language; a word
that a batch repeats is scored once. The lowest cross-entropy per character wins.

Rejection is calibrated on sampled texts that the models were not fitted on: a text is
accepted when its cross-entropy exceeds the language's usual one by no more than twice what
any of these texts of its length class does. Texts without letters (null, empty, digits,
symbols only) are ``und``, not accepted, with score 0; the same holds for all texts when nothing is
labelled. Ties go to the alphabetically first language. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.hashed import bounded_sample, find, row_sums
from paperloom.llm.words import batch_rows, bounds, buffer_of, hash_words, mix, release, slices

ORDER = 4
SAMPLE = 1500
DISCOUNT = 0.75
#: Classes of length, in letters.
LENGTHS = (64, 256, 1024)

WORD = r"(\p{L}[\p{L}\p{M}]*)"
#: What is in no word, but for spaces: marks without a letter, and all that is neither.
OTHER = r"(?<![\p{L}\p{M}])\p{M}+|[^\p{L}\p{M} ]+"

#: Bytes that end words in a text of ``letters``.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x80:] = False
NOT_LETTER[ord("a") : ord("z") + 1] = False


@dataclass
class Models:
    languages: list[str]
    grams: np.ndarray  # sorted hashes of n-grams that any language has
    logp: np.ndarray  # one row per n-gram, one column per language
    contexts: np.ndarray  # sorted hashes of contexts
    backoff: np.ndarray
    unknown: np.ndarray  # of a character that no language has
    usual: np.ndarray | None = None  # mean cross-entropy of each language's own texts
    bound: np.ndarray | None = None  # accepted excess over it, by class of length


def letters(text: Column | str) -> Column:
    """The words of a text in lower case, with spaces between them."""
    return F.regexp_replace(F.lower(text), OTHER, " ")


def gram_hash(points: list[np.ndarray]) -> np.ndarray:
    """A hash of n code points, given by place."""
    total = np.full(len(points[0]), len(points), np.uint64)
    for p in points:
        total = mix(total * np.uint64(0x100000001B3) + p.astype(np.uint64) + np.uint64(1))
    return total


def _hash_strings(grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    by_size = defaultdict(list)
    for i, g in enumerate(grams):
        by_size[len(g)].append(i)
    for size, rows in by_size.items():
        if size:
            table = np.array([[ord(c) for c in grams[i]] for i in rows], np.uint64)
            out[rows] = gram_hash([table[:, k] for k in range(size)])
    return out


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): each character of each word with up to ORDER - 1 before it."""
    words = labelled.select(
        F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD))).alias("w")
    )
    words = words.groupBy("lang", "w").count()
    padded = words.select("lang", "count", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    grams = padded.select(
        "lang",
        "count",
        F.explode(
            F.expr(f"transform(sequence(2, length(w)), i -> substring(w, greatest(1, i - {ORDER - 1}), least(i, {ORDER})))")
        ).alias("gram"),
    )
    return grams.groupBy("lang", "gram").agg(F.sum("count").alias("n"))


def kneser_ney(counts: dict[str, dict[str, int]]) -> Models:
    """The models of each language's n-gram counts (of the highest order and of word starts)."""
    languages = sorted(counts)
    letters = {g[-1] for own in counts.values() for g in own}
    levels, totals, kinds = [], [], []
    for lang in languages:
        level: dict[str, int] = dict(counts[lang])
        for size in range(ORDER, 1, -1):  # lower orders count distinct characters before them
            shorter: dict[str, int] = defaultdict(int)
            for g in [g for g in level if len(g) == size]:
                shorter[g[1:]] += 1
            for g, n in shorter.items():
                if not (len(g) > 1 and g[0] == " "):
                    level[g] = level.get(g, 0) + n
        total: dict[str, int] = defaultdict(int)
        kind: dict[str, int] = defaultdict(int)
        for g, n in level.items():
            total[g[:-1]] += n
            kind[g[:-1]] += 1
        levels.append(level)
        totals.append(total)
        kinds.append(kind)
    grams = sorted({g for level in levels for g in level}, key=len)
    contexts = sorted({c for total in totals for c in total}, key=len)
    uniform = 1.0 / (len(letters) + 1)
    prob = np.zeros((len(grams), len(languages)))
    weight = np.ones((len(contexts), len(languages)))
    for k, (level, total, kind) in enumerate(zip(levels, totals, kinds, strict=True)):
        known: dict[str, float] = {}
        lam = {c: DISCOUNT * kind[c] / total[c] for c in total}
        weight[:, k] = [lam.get(c, 1.0) for c in contexts]
        for i, g in enumerate(grams):  # shorter ones first
            below = known[g[1:]] if len(g) > 1 else uniform
            c = g[:-1]
            p = max(level.get(g, 0) - DISCOUNT, 0) / total[c] + lam[c] * below if c in total else below
            known[g] = p
            prob[i, k] = p
    order = np.argsort(hashes := _hash_strings(grams))
    at = np.argsort(keys := _hash_strings(contexts))
    empty = weight[contexts.index("")] if contexts else np.ones(len(languages))
    return Models(
        languages, hashes[order], np.log(prob[order]), keys[at], np.log(weight[at]), np.log(empty * uniform)
    )


def word_scores(models: Models, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each word and its end by language, and its number of characters."""
    text = b" " + b" ".join(words) + b" "
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    gap = np.flatnonzero(points == 0x20)
    word = np.cumsum(points == 0x20) - 1  # spaces begin words
    n = len(points) - 1
    place = np.arange(1, len(points))
    owner = np.minimum(word[:-1], len(words) - 1)  # a character's word; the space after belongs to it
    depth = np.minimum(place - gap[word[:-1]], ORDER - 1)  # characters before it, in its word
    logp = np.zeros((n, len(models.languages)))
    open_ = np.ones(n, bool)
    for size in range(ORDER - 1, -1, -1):
        at = np.flatnonzero(open_ & (depth >= size))
        if not len(at):
            continue
        columns = [points[place[at] - k] for k in range(size, -1, -1)]
        where, hit = find(models.grams, gram_hash(columns))
        logp[at[hit]] += models.logp[where[hit]]
        open_[at[hit]] = False
        rest = at[~hit]
        if size:
            context, there = find(models.contexts, gram_hash([c[~hit] for c in columns[:-1]]))
            logp[rest[there]] += models.backoff[context[there]]
        else:
            logp[rest] += models.unknown
    total = np.zeros((len(words), len(models.languages)))
    for k in range(total.shape[1]):
        total[:, k] = np.bincount(owner, logp[:, k], len(words))
    return total, np.bincount(owner, minlength=len(words)).astype(np.int64)


def score_texts(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: log-likelihood by language, and characters (with word ends)."""
    sums, sizes = [], []
    data, offsets = buffer_of(texts)
    for at, to in slices(data, offsets):
        part, rows = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = bounds(part, rows, NOT_LETTER)
        cut = np.searchsorted(starts, rows)
        if not len(starts):
            sums.append(np.zeros((to - at, len(models.languages))))
            sizes.append(np.zeros(to - at))
            continue
        _, first, inverse = np.unique(hash_words(part, starts, ends, NOT_LETTER), return_index=True, return_inverse=True)
        raw = part.tobytes()
        total, n = word_scores(models, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sums.append(row_sums(total[inverse], cut))
        sizes.append(row_sums(n[inverse], cut))
    if not sums:
        return np.zeros((0, len(models.languages))), np.zeros(0)
    return np.concatenate(sums), np.concatenate(sizes)


def identify(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``accepted``."""
    new = ("lang_pred", "score", "cross_entropy", "accepted")
    kept = [c for c in df.columns if c not in new]
    source = df.select(*kept, letters(F.col(text)).alias("__lower"))
    sent = df.sparkSession.sparkContext.broadcast(models)
    batch_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            sums, n = score_texts(m, batch.column("__lower"))
            got = n > 0
            size = np.maximum(n, 1)
            if m.languages:
                entropy = -sums / size[:, None]
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(len(best)), best]
                # the posterior of the languages, with the evidence of sqrt(n) characters
                score = 1 / np.exp((low[:, None] - entropy) * np.sqrt(size)[:, None]).sum(axis=1)
                fits = got
                if m.usual is not None:
                    fits = got & (low - m.usual[best] <= m.bound[np.searchsorted(LENGTHS, n, "right")])
            else:
                best, low, score, fits = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
            names = [m.languages[b] if g and m.languages else "und" for b, g in zip(best.tolist(), got.tolist(), strict=True)]
            own = {k: batch.column(i) for i, k in enumerate(batch.schema.names) if k != "__lower"}
            yield pa.RecordBatch.from_pydict(
                own
                | {
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(np.where(got, score, 0.0)),
                    "cross_entropy": pa.array(low, mask=~got),
                    "accepted": pa.array(fits),
                }
            )
        release()

    schema = df.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema.add("cross_entropy", "double").add("accepted", "boolean"))


def length_class(n: Column) -> Column:
    return sum(((n >= size).cast("int") for size in LENGTHS), F.lit(0))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models:
    """Models of the languages of a bounded sample of ``labelled``; rows without a text or
    language teach nothing. Two thirds of the sample fit, the rest calibrates."""
    usable = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    drawn = bounded_sample(usable, "lang", F.col("text"), sample)
    part: Column = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(3))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in gram_counts(drawn.where(part != 0), "text", "lang").toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    models = kneser_ney(counts)
    if not models.languages:
        return models
    held = identify(drawn.where(part == 0), models).where("lang = lang_pred")
    # score_texts counts characters; the bound is on the excess times their root
    n = F.length(F.replace(letters("text"), F.lit(" "), F.lit("")))
    own = held.select("lang", "cross_entropy", length_class(n).alias("size"))
    stats = {r["lang"]: r["usual"] for r in own.groupBy("lang").agg(F.avg("cross_entropy").alias("usual")).collect()}
    overall = float(np.mean(list(stats.values()))) if stats else 0.0
    models.usual = np.array([stats.get(name, overall) for name in models.languages])
    pairs = zip(models.languages, models.usual.tolist(), strict=True)
    usual = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    excess = F.max(F.col("cross_entropy") - usual[F.col("lang")])
    most = {r["size"]: r["most"] for r in own.groupBy("size").agg(excess.alias("most")).collect()}
    # twice the largest excess of such texts, at least a nat; shorter texts get no less
    bound = [max(1.0, 2.0 * most.get(k, 0.0)) for k in range(len(LENGTHS) + 1)]
    models.bound = np.maximum.accumulate(bound[::-1])[::-1]
    return models
