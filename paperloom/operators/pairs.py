"""Which software is named by how many papers, and which names occur together."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.files import UUID_RE
from paperloom.functions.identifiers import bytes_to_uuid
from paperloom.schemas import STOP_WORDS
from paperloom.session import fits_in_broadcast, stage

MIN_SUPPORT = 100

# A paper with more names than this takes the second way through ``co_mentions``.
MAX_FANOUT = 256

# Number of pieces a hot join key is cut into; a power of two.
PIECES = 32


def stop_list_filter(mentions: DataFrame, words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Drop generic names; exact and case-sensitive."""
    return mentions.where(~F.coalesce("softwareId", F.lit("")).isin(list(words)))


def exclude_stop_list(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """The same for a list too long for a literal: ``words`` has a column ``softwareId``.

    Generic names are the most frequent of all, so their rows are dealt over several keys.
    """
    return _members(mentions, words.select("softwareId"), "softwareId", "left_anti")


#: Stands before the bytes of ids that are not UUIDs, so that no packed one has 16 bytes.
_PLAIN = bytes(17)


def packed(paper: Column) -> Column:
    """A paper's id in few bytes, for shuffles: a UUID in lower case as its 16, others as text
    behind ``_PLAIN``. Told apart by length, so nothing is lost."""
    plain = F.concat(F.lit(_PLAIN), paper.cast("binary"))
    return F.when(paper.rlike(f"^{UUID_RE}\\z"), F.unhex(F.translate(paper, "-", ""))).otherwise(plain)


def unpacked(paper: Column) -> Column:
    text = F.substring(paper, len(_PLAIN) + 1, 2**31 - 1).cast("string")
    return F.when(F.length(paper) == 16, bytes_to_uuid(paper)).otherwise(text)


def distinct_edges(mentions: DataFrame) -> DataFrame:
    """(paperId, softwareId) once each. Repeats are removed before and after the shuffle."""
    if dict(mentions.dtypes)["paperId"] != "string":
        return mentions.select("paperId", "softwareId").distinct()
    edges = mentions.select(packed(F.col("paperId")).alias("paperId"), "softwareId").distinct()
    return edges.select(unpacked(F.col("paperId")).alias("paperId"), "softwareId")


def _stage_edges(edges: DataFrame) -> DataFrame:
    """The edges as a table with packed ids: pairs are counted by paper, and no result names one."""
    if dict(edges.dtypes)["paperId"] == "string":
        edges = edges.select(packed(F.col("paperId")).alias("paperId"), "softwareId")
    return stage(edges, "edges", "zstd")


def papers_per_software(edges: DataFrame) -> DataFrame:
    """(softwareId, n_papers) over distinct edges."""
    return edges.groupBy("softwareId").agg(F.count("*").alias("n_papers"))


def min_support(counts: DataFrame, n: int = MIN_SUPPORT, column: str = "n_papers") -> DataFrame:
    return counts.where(F.col(column) >= n)


def frequent_count(frequent: DataFrame) -> DataFrame:
    return frequent.agg(F.count("*").alias("n_software"))


def _members(
    edges: DataFrame, listed: DataFrame, key: str, how: str, fits: bool | None = None
) -> DataFrame:
    """Edges whose ``key`` is in ``listed`` (left_semi; inner adds the list's columns) or
    is not in it (left_anti).

    ``listed`` is a written table. If its measured size allows, each task gets all of it and
    the edges stay where they are. Otherwise both are shuffled, and as one name or one paper
    may own a large share of the edges, a key's edges are dealt over ``PIECES`` join keys by
    their other column, with the list repeated that often. A list is short beside the edges:
    a listed name has at least ``min_support`` of them, a listed paper over ``max_fanout``.
    """
    if fits if fits is not None else fits_in_broadcast(listed, key):
        joined = edges.join(F.broadcast(listed), key, how)
    else:
        other = "paperId" if key == "softwareId" else "softwareId"
        piece = F.xxhash64(other).bitwiseAND(F.lit(PIECES - 1))
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long")))
        joined = edges.withColumn("_piece", piece).join(
            listed.select("*", pieces.alias("_piece")), [key, "_piece"], how
        )
    added = [c for c in listed.columns if how == "inner" and c != key]
    return joined.select(*edges.columns, *added)


def restrict_to_frequent(edges: DataFrame, frequent: DataFrame) -> DataFrame:
    """Edges of frequent software only; a pair is never more frequent than its members.

    Both are read more than once and should be written tables.
    """
    return _members(edges, frequent.select("softwareId"), "softwareId", "left_semi")


def merge_equal_papers(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(paperId, softwareId, weight): of papers with the same set of names one is left, whose
    weight is their number; ``sets`` is the list from ``equal_papers``. Papers of one name, which
    have no pairs, are left out.

    The edges are met with the papers that are left: where they are if the list is small, and
    else by one join that Spark can split.
    """
    left = sets.select(F.col("one").alias("paperId"), "weight")
    left = F.broadcast(left) if fits_in_broadcast(left, "paperId") else left
    return edges.join(left, "paperId").select("paperId", "softwareId", "weight")


def _name_sets(edges: DataFrame) -> DataFrame:
    """(paperId, degree, set): how many names each paper has, and a digest of them.

    The digest is the exclusive or of two 64-bit hashes of each name, which needs no list of
    a paper's names. Two different sets of a size share it with a chance of 2^-128.
    """
    halves = [F.bit_xor(F.xxhash64(F.lit(i), "softwareId")) for i in (1, 2)]
    summed = edges.groupBy("paperId").agg(F.count("*").alias("degree"), *(h.alias(f"_h{i}") for i, h in enumerate(halves)))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(f"_h{i}"), 16, "0") for i in (0, 1)]))
    return summed.select("paperId", "degree", digest.alias("set"))


def equal_papers(edges: DataFrame) -> DataFrame:
    """(set, degree, weight, one): the sets of two names or more, how many papers have each,
    and the first of these."""
    return (
        _name_sets(edges.select("paperId", "softwareId"))
        .where("degree > 1 and paperId is not null")
        .groupBy("set", "degree")
        .agg(F.count("*").alias("weight"), F.min("paperId").alias("one"))
    )


def _pair_up(edges: DataFrame, share: int | None = None) -> DataFrame:
    """(s1, s2, n): pairs s1 < s2 inside a paper, summed by its weight while they are made.

    With ``share``, edges have the ``degree`` of their paper, and the first names of a paper
    are dealt over one piece per ``share`` of them, each of which gets all second names: the
    pairs of a wide paper come from many tasks, and the copies are fewer than its pairs.
    """
    pieces = F.ceil(F.col("degree") / share).cast("int") if share else F.lit(1)
    piece = F.pmod(F.xxhash64("softwareId"), pieces).cast("int")
    a = edges.select("paperId", F.col("softwareId").alias("s1"), "weight", piece.alias("piece"))
    copies = F.explode(F.sequence(F.lit(0), pieces - 1))
    b = edges.select(F.col("paperId").alias("_p"), F.col("softwareId").alias("s2"), copies.alias("_piece"))
    same = (F.col("paperId") == F.col("_p")) & (F.col("piece") == F.col("_piece"))
    return (
        a.join(b, same & (F.col("s1") < F.col("s2")))
        .groupBy("s1", "s2")
        .agg(F.sum("weight").alias("n"))
    )


def co_mentions(
    edges: DataFrame,
    item_support: int = MIN_SUPPORT,
    pair_support: int = MIN_SUPPORT,
    max_fanout: int = MAX_FANOUT,
    written: bool = False,
) -> DataFrame:
    """(s1, s2, n_papers) for pairs s1 < s2 named together by >= pair_support papers.

    Exact for any input. Papers with the same frequent names count as one with a weight, if
    that saves more pairs than there are edges. They are then split by how many frequent
    names they hold:

    * up to ``max_fanout`` names: pairs are made by a self join. An edge meets at most
      ``max_fanout`` others, so the work is linear in the edges.
    * more: the pairs inside such a paper are not enumerated. See ``_with_wide_papers``.

    Every step reads the edges again, so they are written once, as are the lists of frequent
    names and of wide papers. Without wide papers the second way is left out of the plan.
    ``written`` says that ``edges`` is a table already.
    """
    edges = edges if written else _stage_edges(edges)
    counts = stage(papers_per_software(edges), "names")
    frequent = min_support(counts, item_support)
    fits = fits_in_broadcast(frequent, "softwareId")
    kept = _members(edges, frequent.select("softwareId"), "softwareId", "left_semi", fits)
    if not fits:
        kept = stage(kept, "frequent-edges")
    sets = stage(equal_papers(kept), "equal-papers")
    saved = F.sum((F.col("weight") - 1) * F.col("degree") * (F.col("degree") - 1) / 2)
    n_edges = frequent.agg(F.sum("n_papers")).first()[0] or 0
    if (sets.agg(saved).first()[0] or 0) > n_edges:
        kept = stage(merge_equal_papers(kept, sets), "merged-edges")
    else:
        kept = kept.select("paperId", "softwareId", F.lit(1).cast("long").alias("weight"))
    degree = kept.groupBy("paperId").agg(F.count("*").alias("degree"), F.max("weight").alias("_papers"))
    wide = stage(degree.where(F.col("degree") > max_fanout), "wide-papers")
    n_wide = wide.agg(F.sum("_papers")).first()[0] or 0
    wide = wide.select("paperId", "degree")
    if n_wide == 0:
        pairs = _pair_up(kept)
    else:
        fits = fits_in_broadcast(wide, "paperId")
        narrow = _members(kept, wide.select("paperId"), "paperId", "left_anti", fits)
        narrow_pairs = _pair_up(narrow)
        wide_edges = stage(_members(kept, wide, "paperId", "inner", fits), "wide-edges")
        pairs = _with_wide_papers(narrow_pairs, wide_edges, n_wide, pair_support, max_fanout)
    return pairs.where(F.col("n") >= pair_support).select(
        "s1", "s2", F.col("n").alias("n_papers")
    )


def _with_wide_papers(
    narrow_pairs: DataFrame, wide_edges: DataFrame, n_wide: int, support: int, max_fanout: int
) -> DataFrame:
    """Add to each narrow count the number of wide papers that hold the pair.

    Each name's ``support - 1`` widest papers are set aside; what is left of its wide papers
    is its rest. A merged paper is as many as its weight, and is set aside only as a whole.
    A pair that no narrow paper holds needs ``support`` wide ones, so at least
    one of them is in the rest of both names. Hence two steps find every pair that matters:

    1. Pairs are made from the rests only. A paper far wider than the others is set aside by
       all its names and pairs nothing; with fewer than ``support`` wide papers in all,
       there are no rests.
    2. Pairs of narrow papers or of step 1 that can still reach ``support`` get the papers
       added that one of the two names has set aside: at most ``2 * (support - 1)`` lookups
       per pair, whatever the size of the papers.
    """
    per_name = stage(wide_edges.groupBy("softwareId").agg(F.sum("weight").alias("n_papers")), "wide-names")
    # two steps: a name's papers are numbered in pieces, and only the first of each piece
    # together, so that no task sorts all papers of a hot name
    piece = F.xxhash64("paperId").bitwiseAND(F.lit(PIECES - 1))
    order = (F.desc("degree"), "paperId")
    upto = (Window.unboundedPreceding, Window.currentRow)
    in_piece = Window.partitionBy("softwareId", "piece").orderBy(*order).rowsBetween(*upto)
    widest_first = Window.partitionBy("softwareId").orderBy(*order).rowsBetween(*upto)
    aside = stage(
        wide_edges.withColumn("piece", piece)
        .withColumn("place", F.sum("weight").over(in_piece))
        .where(F.col("place") < support)
        .withColumn("place", F.sum("weight").over(widest_first))
        .where(F.col("place") < support)
        .select("paperId", "softwareId", "weight"),
        "widest-papers",
    )
    known = narrow_pairs
    if n_wide >= support:
        rest = stage(wide_edges.join(aside.drop("weight"), ["paperId", "softwareId"], "left_anti"), "rest")
        of_rest = _pair_up(rest, max_fanout)
        known = narrow_pairs.unionByName(of_rest).groupBy("s1", "s2").agg(F.sum("n").alias("n"))

    first = per_name.select(F.col("softwareId").alias("s1"), F.col("n_papers").alias("w1"))
    second = per_name.select(F.col("softwareId").alias("s2"), F.col("n_papers").alias("w2"))
    in_both = F.col("w1").isNotNull() & F.col("w2").isNotNull()
    can_add = F.least("w1", "w2", F.lit(2 * (support - 1)))
    hopeful = stage(
        known.join(first, "s1", "left")
        .join(second, "s2", "left")
        .withColumn("most", F.when(in_both, can_add).otherwise(0))
        .where(F.col("n") + F.col("most") >= support)
        .select("s1", "s2", "n", "most"),
        "hopeful-pairs",
    )
    open_pairs = hopeful.where("most > 0").select("s1", "s2")
    # set aside by s1, anywhere in s2's papers
    added = open_pairs.join(aside.withColumnRenamed("softwareId", "s1"), "s1").join(
        wide_edges.withColumnRenamed("softwareId", "s2"), ["paperId", "s2"], "left_semi"
    ).select("s1", "s2", "weight")
    if n_wide >= support:
        # set aside by s2 only
        by_second = open_pairs.join(aside.withColumnRenamed("softwareId", "s2"), "s2").join(
            rest.withColumnRenamed("softwareId", "s1"), ["paperId", "s1"], "left_semi"
        )
        added = added.unionByName(by_second.select("s1", "s2", "weight"))
    counted = added.groupBy("s1", "s2").agg(F.sum("weight").alias("n"))
    return (
        hopeful.select("s1", "s2", "n")
        .unionByName(counted)
        .groupBy("s1", "s2")
        .agg(F.sum("n").alias("n"))
    )


def top_software(frequent: DataFrame, k: int = 10) -> DataFrame:
    """(rank, softwareId, n_papers): the k largest, rank from 0, ties by name.

    The ranking window runs over the k rows that are left.
    """
    top = frequent.orderBy(F.desc("n_papers"), "softwareId").limit(k)
    order = Window.orderBy(F.desc("n_papers"), "softwareId")
    return top.select(
        (F.row_number().over(order) - 1).alias("rank"), "softwareId", "n_papers"
    )


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("n_papers"), "s1", "s2").limit(k)


#: Names whose pairs are counted first in ``most_frequent_pairs``.
FIRST_NAMES = 64


def most_frequent_pairs(
    edges: DataFrame, k: int = 20, support: int = 1, max_fanout: int = MAX_FANOUT, written: bool = False
) -> DataFrame:
    """``top_pairs`` of all pairs with ``support`` papers, without counting most of them.

    The pairs of the most frequent names are counted first. If there are k of them, the
    smallest of the k best counts is a support that every pair of the result reaches, and so
    do its names; the exact count then runs with that support. If not, four times as many
    names are tried, until all names are in.
    """
    edges = edges if written else _stage_edges(edges)
    counts = stage(papers_per_software(edges), "names")
    n_names, names = counts.count(), FIRST_NAMES
    while names < n_names:
        # a bounded list: FIRST_NAMES times a power of four, and one of them is enough
        first = stage(counts.orderBy(F.desc("n_papers"), "softwareId").limit(names), "first-names")
        among = _members(edges, first.select("softwareId"), "softwareId", "left_semi")
        best = top_pairs(co_mentions(stage(among, "first-edges", "zstd"), support, support, max_fanout, written=True), k).agg(
            F.count("*").alias("n"), F.min("n_papers").alias("least")
        ).first()
        if best["n"] == k:
            support = max(support, best["least"])
            break
        names *= 4
    return top_pairs(co_mentions(edges, support, support, max_fanout, written=True), k)
