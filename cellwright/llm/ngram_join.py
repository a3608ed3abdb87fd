"""Set-similarity self-join on word n-grams, as a T-occurrence search.

Documents with equal shingle sets are one class from the start.  Two classes x and y link if their overlap
reaches threshold * |union|, so x shares at least T(x) = ceil(threshold * |x|) shingles with any partner.

1. A list is of a part of a set, not of one shingle, as texts share single shingles by chance.  Linked sets of like sizes differ in D shingles at most, which lie
   in D of D + k parts at most (stretches of the hashes): they have k parts in common at least.  A part's hash names its list, and classes that have fewer
   of their lists with any other class link with nothing.  Of what passes, the lists of most classes are left out up to one less than linked sets have in common.
2. Classes that meet in lists, directly or over others, are a family; sets are written as their symmetric difference D from
   the family's smallest set.  As |x ^ y| = |Dx ^ Dy|, nothing is lost, and copies have short differences.
3. Each member is compared with the smallest set, with the one nearest to what most of the family have, and with up to CENTRES others.
4. What is left are pairs in different components so far.  The lists of D are merged, rare ones first: a pair that links shares at
   least T(x, y) = (|Dx| + |Dy| - slack) / 2 of them, so its first common one lies before the T(x, y) - 1 last places of
   both.  The long lists of such pairs are binary-probed in the other's sorted D, and the exact overlap decides.

64 hash bits stand for a shingle, 128 for a set.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash, text_of
from cellwright.llm.graph import components
from cellwright.llm.tokens import mixed, slices
from cellwright.llm.words import shingle_sets

#: Parts that linked sets have in common beyond the part of their differences that they may have more.
SPARE = 3
#: Largest size by smallest size in a class of sizes, if linked sets are nearer to each other.
CLASS = 1.5
#: Turns in which the lists are shuffled.
TURNS = 4
#: Ids of screened classes up to which they are broadcast (40 bytes each).
BROADCAST_IDS = 1_000_000
#: Members of a family that all others are compared with, beside its smallest set and its middle.
CENTRES = 4


def size_bounds(top: int, bottom: int) -> np.ndarray:
    """Least sizes of the classes of sizes: a set links within its class and the ones beside it only."""
    bounds = [1, 2]
    while bounds[-1] < 1 << 32:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * bottom // top + 1, int(bounds[-1] * CLASS)))
    return np.array(bounds, np.int64)


def part_lists(sets: list[np.ndarray], top: int, bottom: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The names of each set's lists, and how many of them it has in common with any set that it links with, at least.

    A set is in the lists of its own class of sizes, and of the next one if that has sets that it can link with: linked sets meet in the larger one's.  An empty part has no list, and takes one from what is asked for; sets for
    which so many parts are empty that nothing would be asked for are in one more list together.
    """
    bounds = size_bounds(top, bottom)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    weight = mixed(flat * np.uint64(0x9E3779B97F4A7C15))
    own, need, names, owners = np.searchsorted(bounds, n, "right") - 1, np.full(len(sets), np.iinfo(np.int64).max), [], []
    for label, near in ((own, n > 0), (own + 1, n * bottom >= bounds[own + 1] * top)):
        differ = 2 * (bounds[label + 1] - 1) * (bottom - top) // (bottom + top)
        common = np.where((differ > 0) & near, SPARE + differ * (bottom - top) // top, 0)  # 0: links with no other set of this class
        parts = differ + common
        use = common[owner] > 0
        of, what = owner[use], flat[use]
        part = (((what >> np.uint64(32)) * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        if not len(head):
            continue
        place = label[of[head]] << 34 | part[head] + 1
        names.append(mixed(np.add.reduceat(weight[use], head) + mixed(place.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))))
        owners.append(of[head])
        empty = parts - np.bincount(of[head], minlength=len(sets))
        many = np.flatnonzero((common > 0) & (empty >= common))
        names.append(mixed((label[many] << 34).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        owners.append(many)
        need = np.where(common > 0, np.minimum(need, np.maximum(1, common - empty)), need)
    order = np.argsort(every := np.concatenate(owners), kind="stable") if owners else np.zeros(0, np.int64)
    ends = np.cumsum(np.bincount(every, minlength=len(sets)))[:-1] if owners else np.zeros(max(0, len(sets) - 1), np.int64)
    lists = np.concatenate(names)[order] if owners else np.zeros(0, np.uint64)
    return np.split(lists, ends) if sets else [], need


def _scan(size: int, top: int, bottom: int):
    """doc_id, t, n, h1, h2 (of the set), need, lists."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(x) for x in texts], 1_500_000):
                sets = shingle_sets(texts[a:b], size)
                lists, need = part_lists(sets, top, bottom)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
                        *_set_hashes(sets),
                        pa.array(need),
                        pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "t", "n", "h1", "h2", "need", "lists"],
                )

    return run


def _set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    both = [[int(mixed(s * np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in both]


def _whole_sets(size: int):
    """rep, family, shingles (ascending) of the texts whose set has the hashes h1, h2."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(x) for x in texts], 1_500_000):
                sets = shingle_sets(texts[a:b], size)
                h1, h2 = (x.to_numpy() for x in _set_hashes(sets))
                own = (h1 == batch.column(3).to_numpy()[a:b]) & (h2 == batch.column(4).to_numpy()[a:b])
                kept = np.flatnonzero(own)
                columns = [batch.column(k).slice(a, b - a).take(pa.array(kept)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.sort(sets[k].view(np.int64)) for k in kept], pa.list_(pa.int64()))], names=["rep", "family", "shingles"])

    return run


def _difference(left: pd.Series, right: pd.Series) -> pd.Series:
    """Symmetric differences of sorted sets, sorted."""
    return pd.Series([np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)])


def _overlaps(left: pd.Series, right: pd.Series) -> pd.Series:
    """Sizes of intersections: the smaller set's elements are binary-probed in the larger one."""
    out = np.zeros(len(left), np.int64)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if len(x):
            at = np.searchsorted(y, x)
            out[k] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
    return pd.Series(out)


def links(both: Column, apart: Column, top: int, bottom: int) -> Column:
    """Whether two sets link, from the sum of their sizes and the size of their symmetric difference."""
    return (both - apart) * bottom >= (both + apart) * top


def screened(base: DataFrame) -> DataFrame:
    """row, first: classes that have enough lists with others in them, and the first class of each list that may tell which of them link.

    A list is in one of ``TURNS`` turns by its name, so that what is shuffled at once is a part of all lists; rows travel with the lists that other classes hold too, so all lists are never
    moved as arrays.  Classes that have too few such lists go, and lists are counted again among those that stay.  Linked classes have ``need`` lists in common, so the
    rarest of these is not among the last need - 1 of either by number of classes.
    """
    met = []
    for turn in range(TURNS):
        part = base.filter("n > 0").select("row", "h1", F.filter("lists", lambda s: F.pmod(s, F.lit(TURNS)) == turn).alias("lists"))  # noqa: B023
        postings = part.select("row", "h1", F.explode("lists").alias("s"))
        held = stash(postings.groupBy("s").agg(F.min("h1").alias("first"), F.max("h1").alias("last")).filter("first <> last").select("s"), "held-lists")
        met.append(stash(postings.select("row", "s").join(held, "s").groupBy("row").agg(F.collect_list("s").alias("lists")), "met-classes"))
    gathered = functools.reduce(DataFrame.unionByName, met).groupBy("row").agg(F.flatten(F.collect_list("lists")).alias("lists"))
    enough = stash(gathered.join(base.select("row", "need", "h1", "h2"), "row").filter("size(lists) >= need"), "screened-lists")
    own = enough.groupBy("h1", "h2").agg(F.min("row").alias("row")).select("row")
    postings = enough.join(own, "row", "left_semi").select("row", "need", F.explode("lists").alias("s"))
    held = stash(postings.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "held-lists")
    counted = postings.join(held, "s").groupBy("row", "need").agg(F.collect_list(F.struct("df", "s")).alias("by_df")).filter("size(by_df) >= need")
    rare = F.slice(F.array_sort("by_df"), F.lit(1), (F.size("by_df") - F.col("need") + 1).cast("int"))
    short = stash(counted.select("row", F.explode(rare).alias("x")).select("row", F.col("x.s").alias("s")), "rare-lists")
    firsts = stash(short.groupBy("s").agg(F.min("row").alias("first"), F.count("*").alias("df")).filter("df > 1").select("s", "first"), "first-classes")
    return short.join(firsts, "s").select("row", "first").distinct()


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, top: int = 4, bottom: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links with Jaccard >= top / bottom.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case.  Null, empty and blank texts have no shingles and link with
    nothing; a text with fewer words than ``words`` is one shingle.  One row per row.  Rows are told apart by themselves, not by their ids, so rows
    with null or equal ids link as any others.  A component is named by its smallest id, and by null if none of its rows has an id;
    a null id without links has a null component_id.  An empty table gives an empty result.
    """
    return grouped(docs, id_col, text_col, words, top, bottom).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, top: int, bottom: int) -> DataFrame:
    """doc_id, t (hash of the text), n, vertex (number of the component; null without shingles), component_id.

    Vertices are numbers of rows, as ids may be null or belong to several texts.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("t"), text_of(text_col).cast("binary").alias("text"))
    scanned = source.mapInArrow(_scan(words, top, bottom), "doc_id bigint, t bigint, n bigint, h1 bigint, h2 bigint, need bigint, lists array<bigint>")
    base = stash(scanned.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")

    merged = components(_linked(source, base, words, top, bottom)).select(F.col("v").alias("rep"), "component")
    keys = base.filter("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"))
    labelled = stash(keys.join(merged, "rep", "left").select("h1", "h2", "least_id", F.coalesce("component", "rep").alias("vertex")), "classes")
    names = labelled.groupBy("vertex").agg(F.min("least_id").alias("name"))
    out = base.select("doc_id", "t", "n", "h1", "h2").join(labelled.join(names, "vertex").select("h1", "h2", "vertex", "name"), ["h1", "h2"], "left")
    vertex = F.when(F.col("n") > 0, F.col("vertex"))
    return out.select("doc_id", "t", "n", vertex.alias("vertex"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def _linked(source: DataFrame, base: DataFrame, words: int, top: int, bottom: int) -> DataFrame:
    """Links (a, b) of classes, named by a row each, that give the same components as all links."""
    difference, overlap = F.pandas_udf(_difference, "array<bigint>"), F.pandas_udf(_overlaps, "bigint")
    family = components(screened(base).select(F.col("first").alias("a"), F.col("row").alias("b"))).select(F.col("v").alias("rep"), F.col("component").alias("family"))
    left = stash(base.select(F.col("row").alias("rep"), F.col("doc_id").alias("id"), F.col("t").alias("text_hash"), "n", "h1", "h2").join(family, "rep"), "families")

    # a bounded number of ids goes to the texts; more of them meet the texts in a shuffle
    few = left.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = left.drop("n")
    texts = source.join(F.broadcast(wanted) if few else wanted, (source.t == left.text_hash) & source.doc_id.eqNullSafe(left.id)).select("rep", "family", "text", "h1", "h2")
    found = texts.mapInArrow(_whole_sets(words), "rep bigint, family bigint, shingles array<bigint>")
    if base.groupBy("doc_id", "t").count().filter("count > 1").limit(1).count():
        found = found.dropDuplicates(["rep"])
    sets = stash(found, "family-sets")

    # sets as differences from the smallest one of their family
    least = left.groupBy("family").agg(F.min(F.struct("n", "rep")).alias("c"), F.count("*").alias("members")).select("family", F.col("c.n").alias("cn"), F.col("c.rep").alias("centre"), "members")
    centres = least.join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("middle")), "centre")
    apart = sets.join(centres, "family").filter("rep <> centre").select("rep", "family", "centre", "cn", "members", F.size("shingles").cast("bigint").alias("n"), difference("shingles", "middle").alias("diff"))
    apart = stash(apart.withColumn("d", F.size("diff").cast("bigint")).withColumn("near", links(F.col("n") + F.col("cn"), F.col("d"), top, bottom)), "differences")
    first = apart.filter("near").select(F.col("centre").alias("a"), F.col("rep").alias("b"))

    # lists of differences, rare ones first
    crowd = apart.filter("members > 2").select("rep", "family", "members", "n", "d", "diff")
    items = crowd.select("rep", "family", F.explode("diff").alias("s"))
    lists = items.groupBy("family", "s").agg(F.count("*").alias("df")).filter("df > 1")
    placed = stash(items.join(lists, ["family", "s"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("lists")), "difference-lists")

    # the member nearest to what most of the family have, and some others, are compared with all the rest
    often = F.size(F.filter("lists", lambda x: x["df"] * 2 >= F.col("members")))
    spread = crowd.join(placed, "rep", "left").select("rep", "family", F.pmod(F.xxhash64("rep"), F.lit(CENTRES)).alias("spoke"), (F.col("d") - 2 * F.coalesce(F.when(F.col("lists").isNotNull(), often), F.lit(0))).alias("far"), F.xxhash64("rep", F.lit(1)).alias("x"))
    middle = spread.groupBy("family").agg(F.min(F.struct("far", "rep")).alias("c"))
    others = spread.groupBy("family", "spoke").agg(F.min(F.struct("x", "rep")).alias("c"))
    chosen = middle.select("c.rep").unionByName(others.select("c.rep")).distinct()
    hubs = crowd.join(chosen, "rep", "left_semi").select("family", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("diff").alias("x"))
    compared = hubs.join(crowd.select("family", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("diff").alias("y")), "family").filter("a <> b")
    second = stash(_verified(compared, overlap, top, bottom), "hub-links")
    so_far = first.unionByName(second)
    # members that are linked to one centre are in one component; the middle goes before the others
    to_hub = second.join(middle.select(F.col("c.rep").alias("a"), F.lit(True).alias("best")), "a", "left")
    ties = to_hub.select(F.col("b").alias("rep"), F.when(F.col("best"), 0).otherwise(1).alias("order"), "a")
    ties = ties.unionByName(middle.select(F.col("c.rep").alias("rep"), F.lit(0).alias("order"), F.col("c.rep").alias("a"))).unionByName(first.select(F.col("b").alias("rep"), F.lit(1).alias("order"), "a"))
    known = ties.groupBy("rep").agg(F.min(F.struct("order", "a")).alias("m")).select("rep", F.col("m.a").alias("component"))

    # the first places of a class are taken by what it has alone, so one that has much of it meets nobody
    slack = F.expr(f"(n * {bottom - top}) div {top}")  # what a linked set may lack of D, at most
    own = crowd.select("rep", "family", "n", "d", F.greatest(F.lit(1), F.col("d") - slack).alias("t")).join(placed, "rep").filter(F.size("lists") >= F.col("t")).join(known, "rep", "left")
    short = own.select("rep", "family", F.coalesce("component", "rep").alias("component"), "n", "d", (F.col("d") - F.size("lists")).alias("alone"), F.posexplode(F.slice("lists", F.lit(1), (F.size("lists") - F.col("t") + 1).cast("int"))).alias("at", "x"))
    merged = stash(short.select("rep", "family", "component", "n", "d", (F.col("alone") + F.col("at") + 1).alias("place"), F.col("x.s").alias("s")), "short-difference-lists")
    open_ = merged.groupBy("family", "s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("family", "s")
    active = merged.join(open_, ["family", "s"], "left_semi")
    one, two = (active.select("family", "s", F.col("rep").alias(r), F.col("n").alias(f"n{r}"), F.col("d").alias(f"d{r}"), F.col("place").alias(f"p{r}"), F.col("component").alias(f"c{r}")) for r in "ab")
    # least overlap of the differences of two linked sets, times 2 * (top + bottom)
    both = F.expr(f"(da + db) * {top + bottom} - (na + nb) * {bottom - top}")
    within = lambda d, p: (F.col(d) - F.col(p) + 1) * (2 * (top + bottom)) >= both
    sizes = F.expr(f"least(na, nb) * {bottom} >= greatest(na, nb) * {top}")
    pairs = one.join(two, ["family", "s"]).filter("a < b and ca <> cb").filter(sizes & within("da", "pa") & within("db", "pb")).select("a", "b", "na", "nb", "da", "db").distinct()
    third = pairs.join(crowd.select(F.col("rep").alias("a"), F.col("diff").alias("x")), "a").join(crowd.select(F.col("rep").alias("b"), F.col("diff").alias("y")), "b")
    return so_far.unionByName(stash(_verified(third, overlap, top, bottom), "merged-links"))


def _verified(pairs: DataFrame, overlap, top: int, bottom: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their differences x and y of sizes da and db."""
    counted = pairs.select("a", "b", "na", "nb", (F.col("da") + F.col("db") - 2 * overlap("x", "y")).alias("apart"))
    return counted.filter(links(F.col("na") + F.col("nb"), F.col("apart"), top, bottom)).select("a", "b")
