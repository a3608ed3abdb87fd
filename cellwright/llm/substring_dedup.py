"""Exact substring deduplication over a whole corpus.

Every string of ``length`` bytes is assigned to the least hash among the 64-byte grams in it, so equal strings meet
under one hash wherever they stand, and only stretches whose hash occurs again are looked at.  A suffix array over the bytes of
stretches that share hashes, truncated at ``length`` bytes, is built by prefix doubling.  For every suffix the nearest ones with smaller
positions before and behind it in that order are found; the longer of the two common prefixes is its longest previous factor among them, and one of
``length`` bytes is an earlier match that removes it.  With positions turned round the same gives later matches, so that no copy stays.

A hash with more stretches than HOT is not left to one task: its strings are counted by name with pre-aggregation, and those of
crowded names are dealt over many tasks to be told whether they go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash, text_of
from cellwright.llm.tokens import mixed, slices

GRAM = 64
NULL_ID = (1 << 63) - 1  # where a null id stands among ids
#: Strings in a stretch, at most.
LONGEST = 1024
#: Stretches of one hash that a task puts in order; beyond, counting by name does it.
HOT = 2000
CHUNK_BYTES = 2_000_000
#: Names of hot strings fall into this many buckets; a bucket with more rows than CROWD and than four times the mean is dealt over SALTS tasks.
BUCKETS = 1 << 16
CROWD = 5000
#: Hashes that two texts share, at most.
MOST_CLASHES = 10_000
SALTS = 64
_BASE = 0x9E3779B97F4A7C15
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of data[i : i + width] at each i where it fits."""
    current, size, whole, have = _VALUES[data], 1, None, 0
    while True:
        if width & size:
            if whole is None:
                whole = current
            else:  # the part of ``size`` values comes before what is there
                n = len(current) - have
                whole = current[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + whole[size : size + n]
            have += size
        if have == width:
            return mixed(whole[: max(0, len(data) - width + 1)].copy())
        current = current[: max(0, len(current) - size)] * np.uint64(pow(_BASE, size, 1 << 64)) + current[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of x[i : i + width] at each i where it fits, and whether it is there more than once."""

    def joined(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        below, above = a <= b, b <= a
        return np.minimum(a, b), (ta[:n] & below) | (tb[:n] & above) | (below & above)

    part, tie, size = x, np.zeros(len(x), bool), 1
    whole, have = None, 0
    while True:
        if width & size:
            whole = (part, tie) if whole is None else joined(part, tie, whole[0][size:], whole[1][size:])
            have += size
        if have == width:
            return whole
        part, tie = joined(part, tie, part[size:], tie[size:])
        size *= 2


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text number, first string, number of strings, whether strings may repeat inside, hash: runs of strings with one least gram hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    gram = min(GRAM, length)
    least, tie = sliding_min(rolling(data, gram), length - gram + 1)
    ends = np.cumsum(sizes)
    valid = np.ones(len(least), bool)
    for e in ends[:-1].tolist():  # strings that would cross into the next text
        valid[max(0, e - length + 1) : e] = False
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new &= valid
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    count = stop - begin
    parts = -(-count // LONGEST)
    if len(parts) and parts.max() > 1:
        extra = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, total = np.repeat(begin, parts) + extra * LONGEST, np.repeat(count, parts)
        count = np.minimum(LONGEST, total - extra * LONGEST)
    owner = np.searchsorted(ends, begin, side="right")
    ties = np.zeros(len(tie) + 1, np.int64)
    np.cumsum(tie, out=ties[1:])
    # more strings than one gram's position lies in: the least gram stands at two positions, though no string may hold both
    inside = (ties[begin + count] > ties[begin]) | (count > length - gram + 1)
    return owner, begin - (ends - sizes)[owner], count, inside, least[begin]


def _anchors(length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task count once
        for batch in batches:
            texts, classes = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in slices([len(x) for x in texts], 1 << 20):
                use = []
                for k in range(a, b):
                    if len(texts[k]) >= length and classes[k] not in seen:
                        use.append(k)
                        if len(seen) < 500_000:
                            seen.add(classes[k])
                if use:
                    owner, first, count, inside, h = stretches([texts[k] for k in use], length)
                    key = np.array([classes[k] for k in use], np.int64)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(first << 12 | count << 1 | inside)], names=["h", "c1", "at"])

    return run


def _regions(length: int):
    """For (c1, doc, text, marks (at, h)): the bytes of each marked stretch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, texts, marks = (batch.column(k).to_pylist() for k in range(4))
            for key, doc, text, own in zip(keys, docs, texts, marks, strict=True):
                at = [m["at"] for m in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m["h"] for m in own], pa.int64()),
                        pa.array([key] * len(own), pa.int64()),
                        pa.array([doc] * len(own), pa.int64()),
                        pa.array([x >> 12 for x in at], pa.int64()),
                        pa.array([text[x >> 12 : (x >> 12) + (x >> 1 & 2047) + length - 1] for x in at], pa.binary()),
                    ],
                    names=["h", "c1", "doc", "first", "bytes"],
                )

    return run


def rank_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of data[i : i + width] among all such strings at each i where it fits) for growing widths up to ``length``; equal strings have one rank.

    Prefix doubling, or tripling where three ranks fit into a key.
    """
    if len(data) < length:
        return [(length, np.zeros(0, np.int64))]
    width = min(8, length)
    key = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        key = key << np.uint64(8) | data[k : k + len(key)]
    bits = 21 if len(data) < 1 << 21 else 32
    levels = []
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.uint64)
        levels.append((width, rank.astype(np.int64)))
        if width == length:
            return levels
        steps = [min(width, length - width)]
        if bits == 21:
            steps.append(min(2 * width, length - width))
        n = len(rank) - steps[-1]
        key = rank[:n]
        for step in steps:
            key = key << np.uint64(bits) | rank[step : step + n]
        width += steps[-1]


def truncated_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of data[i : i + length] among all such strings."""
    return rank_levels(data, length)[-1][1]


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at i and at j have in common, as far as the last level's width: by ranks of ever smaller widths, then byte by byte."""
    length = levels[-1][0]
    out = np.zeros(len(i), np.int64)
    for width, rank in [*reversed(levels), *[(1, data)] * 7]:
        for _ in range(2):  # no level is over three times the one before
            x, y = i + out, j + out
            fits = np.flatnonzero((np.maximum(x, y) < len(rank)) & (out + width <= length))
            same = fits[rank[x[fits]] == rank[y[fits]]]
            out[same] += width
            if not len(same) or width == length:
                break
    return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 without one; the values differ.

    A pointer over larger values follows the pointer of the value that it stands on, all at once, until none is left.
    """
    at = np.arange(len(x)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_ := open_[x[at[open_]] > x[open_]]):
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def longest_previous_factors(data: np.ndarray, levels: list[tuple[int, np.ndarray]], at: np.ndarray, position: np.ndarray, least: int = 0, later: bool = False) -> np.ndarray:
    """For each suffix of data at ``at`` the longest prefix that a suffix of a smaller position has too, as far as the levels go; with ``least`` shorter ones than that may be given as 0.

    In the order of the suffixes, ties by position, the longest common prefix with any earlier suffix is that with the nearest one of a smaller position on one of the two sides.
    ``later``: with any suffix of a larger position instead.  Suffixes that agree over the whole length lie side by side by position, so where only the whole length matters
    the earlier ones are before, and the later ones behind.
    """
    length, rank = levels[-1]
    rank = rank[at]
    order = np.lexsort((position, rank))
    ranked = rank[order]
    x = -position[order] if later else position[order]
    n = len(order)
    found = np.zeros(n, np.int64)
    sides = (False, True) if least < length else (later,)
    for behind in sides:
        near = n - 1 - previous_smaller(x[::-1])[::-1] if behind else previous_smaller(x)
        some = np.flatnonzero((near >= 0) & (near < n))
        # equal ranks agree over the whole length
        equal = ranked[some] == ranked[near[some]]
        found[some[equal]] = length
        if least < length:
            rest = some[~equal]
            found[rest] = np.maximum(found[rest], common_prefixes(data, levels, at[order[rest]], at[order[near[rest]]]))
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def _repeats(x: np.ndarray) -> np.ndarray:
    """Whether each value is there more than once."""
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def repeated(regions: list[bytes], groups: np.ndarray, docs: np.ndarray, firsts: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """region, first string, last string of the runs of strings that occur elsewhere (with keep_first: earlier).

    A stretch may be there more than once (copies of its text were in several tasks); it counts once.
    """
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    data = np.frombuffer(b"".join(regions), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(regions)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    marked = np.zeros(len(owner), bool)
    # only bytes under strings whose hash is there again come into the suffix array
    place = begin[owner] + inner
    again = np.flatnonzero(_repeats(rolling(data, length)[place]))
    change = np.zeros(len(data) + 1, np.int32)
    change[place[again]] += 1
    change[place[again] + length] -= 1
    under = np.cumsum(change[:-1]) > 0
    bytes_under, at = data[under], (np.cumsum(under) - 1)[place[again]]
    levels = rank_levels(bytes_under, length)
    position = np.arange(len(again))  # any order will do if no copy stays
    if keep_first:
        own = owner[again]
        position[np.lexsort((firsts[own] + inner[again], groups[own], docs[own]))] = np.arange(len(again))
    goes = longest_previous_factors(bytes_under, levels, at, position, least=length) >= length
    if not keep_first:
        goes |= longest_previous_factors(bytes_under, levels, at, position, least=length, later=True) >= length
    marked[again[goes]] = True
    # runs of marked strings within a region
    before = np.zeros(len(marked), bool)
    before[1:] = marked[:-1] & (inner[1:] > 0)
    start = np.flatnonzero(marked & ~before)
    after = np.zeros(len(marked), bool)
    after[:-1] = marked[1:] & (inner[1:] > 0)
    stop = np.flatnonzero(marked & ~after)
    return owner[start], inner[start], inner[stop]


def _ordered(length: int, keep_first: bool):
    """Regions sorted by h -> c1, first and last string of repeated runs."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        unique = list({(h, c1, first): (h, c1, doc, first, data) for h, c1, doc, first, data in rows}.values())
        h, c1, doc, first = (np.array([r[k] for r in unique], np.int64) for k in range(4))
        owner, a, b = repeated([r[4] for r in unique], c1, doc, first, length, keep_first)
        return pa.RecordBatch.from_arrays([pa.array(c1[owner]), pa.array(first[owner] + a), pa.array(first[owner] + b)], names=["c1", "a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= CHUNK_BYTES and held[-1][0] != row[0]:
                    yield result(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield result(held)

    return run


def spans_of(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by the strings a..b (first bytes of strings): begins and ends."""
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(b[order] + length)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > e[:-1]
    last = np.append(new[1:], True)
    return a[new], e[last]


def _cut(texts: pd.Series, runs: pd.Series, length: int) -> pd.DataFrame:
    kept, removed, n = [], [], []
    for text, own in zip(texts, runs, strict=True):
        begin, end = spans_of(np.array([r["a"] for r in own], np.int64), np.array([r["b"] for r in own], np.int64), length)
        edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
        kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
        removed.append(int((end - begin).sum()))
        n.append(len(begin))
    return pd.DataFrame({"kept": kept, "n_removed": removed, "n_spans": n})


def text_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "text") if seed else F.xxhash64("text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_first: bool = True) -> DataFrame:
    """doc_id, kept (bytes that stay), n_bytes, n_removed, n_spans (maximal removed runs).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the corpus, or, with ``keep_first``,
    starts somewhere before: in a document with a smaller id, or further ahead in the same one.  Strings never cross documents and
    are judged on the input.  Null texts are empty; texts of under ``length`` bytes stay whole.  Repeated
    rows are copies of each other (with ``keep_first`` rows with equal ids and texts are one document).  A null id comes after all others.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def classed(key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows with their text's class, and the classes of long texts; equal texts are one class, and its texts but one need no comparison."""
        rows = named.withColumn("c1", key)
        longs = rows.filter(F.length("text") >= length).select("c1", "doc_id", text_hash(1).alias("c2"))
        agg = longs.groupBy("c1").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), (F.min("c2") != F.max("c2")).alias("clash"))
        return rows, stash(agg, "text-classes")

    source, classes = classed(text_hash(0))
    # two texts with one hash: a handful among a thousand million; they take another hash
    clashing = [r["c1"] for r in classes.filter("clash").select("c1").limit(MOST_CLASHES + 1).collect()]
    if clashing:
        if len(clashing) > MOST_CLASHES:
            raise ValueError("too many texts have equal hashes")
        source, classes = classed(F.when(text_hash(0).isin(clashing), text_hash(2)).otherwise(text_hash(0)))
    longs = source.filter(F.length("text") >= length)

    anchors = stash(longs.select("c1", "text").mapInArrow(_anchors(length), "h bigint, c1 bigint, at bigint"), "anchors")
    tag = F.hash("c1", "at")
    again = anchors.groupBy("h").agg(F.min(tag).alias("x"), F.max(tag).alias("y"), F.max(F.col("at").bitwiseAND(1)).alias("inside"), F.count("*").alias("n")).filter("x <> y or inside = 1").select("h", (F.col("n") > HOT).alias("hot"))
    marks = anchors.join(again, "h").groupBy("c1").agg(F.collect_set(F.struct("at", "h", "hot")).alias("marks"))
    known = classes.join(marks, "c1", "left").select("c1", "copies", "rep", "marks")

    joined = source.join(known, "c1", "left").select("doc_id", "c1", "copies", "rep", "marks", "text")
    whole_copy = (F.col("copies") > 1) & (~F.col("doc_id").eqNullSafe(F.col("rep")) if keep_first else F.lit(True))
    first_row = F.col("doc_id").eqNullSafe(F.col("rep"))
    goes = F.coalesce(whole_copy, F.lit(False))
    needed = F.col("marks").isNotNull() & (~goes | first_row)
    # only texts with a stretch that occurs again are looked at further
    table = stash(joined.select("doc_id", "c1", F.length("text").cast("bigint").alias("n_bytes"), goes.alias("goes"), (needed & first_row).alias("first_row"), F.when(needed, F.col("marks")).alias("marks"), F.when(goes & ~(needed & first_row), F.lit(b"")).otherwise(F.col("text")).alias("text")), "marked-texts")

    def regions(hot: bool) -> DataFrame:
        own = F.filter("marks", lambda m: m["hot"] == hot)
        some = table.filter("first_row").select("c1", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text", own.alias("marks")).filter(F.size("marks") > 0)
        return some.mapInArrow(_regions(length), "h bigint, c1 bigint, doc bigint, first bigint, bytes binary")

    cold = regions(hot=False).repartition("h").sortWithinPartitions("h")
    runs = cold.mapInArrow(_ordered(length, keep_first), "c1 bigint, a bigint, b bigint").unionByName(_hot_runs(regions(hot=True), length, keep_first))
    found = stash(runs.groupBy("c1").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "removed-runs")

    cut = F.pandas_udf(lambda texts, own: _cut(texts, own, length), "struct<kept:binary,n_removed:bigint,n_spans:bigint>")
    open_ = table.filter(F.col("marks").isNotNull() & ~F.col("goes")).join(found, "c1", "left")
    done = table.filter(F.col("marks").isNull() | F.col("goes"))
    all_gone = done.select("doc_id", F.when(F.col("goes"), F.lit(b"")).otherwise(F.col("text")).alias("kept"), "n_bytes", F.when(F.col("goes"), F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), F.when(F.col("goes"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_spans"))
    untouched = open_.filter("runs is null").select("doc_id", F.col("text").alias("kept"), "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"))
    touched = open_.filter("runs is not null").select("doc_id", "n_bytes", cut("text", "runs").alias("cut")).select("doc_id", "cut.kept", "n_bytes", "cut.n_removed", "cut.n_spans")
    return all_gone.unionByName(untouched).unionByName(touched)


def _hot_runs(regions: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """c1, a, b for stretches of hashes that occur very often: strings are counted by name, with partial sums before the shuffle."""
    position = F.explode(F.sequence(F.lit(1), F.length("bytes") - length + 1))
    strings = regions.dropDuplicates(["h", "c1", "first"]).select("c1", "doc", "first", "bytes", position.alias("k"))
    data = F.substring(F.col("bytes"), F.col("k"), F.lit(length))
    named = strings.select("c1", "doc", (F.col("first") + F.col("k") - 1).alias("a"), F.xxhash64(data).alias("w1"), F.xxhash64(F.lit(1), data).alias("w2"))
    counted = named.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "a")).alias("least")).filter("n > 1")
    bucket = F.pmod("w1", F.lit(BUCKETS)).cast("int").alias("bucket")
    loads = named.groupBy(bucket).count().collect()  # BUCKETS rows at most
    bound = max(CROWD, 4 * sum(r["count"] for r in loads) // BUCKETS)
    crowded = F.broadcast(regions.sparkSession.createDataFrame([(r["bucket"], True) for r in loads if r["count"] > bound], "bucket int, many boolean"))
    dealt = named.withColumn("bucket", bucket).join(crowded, "bucket", "left").withColumn("salt", F.when(F.col("many"), F.pmod(F.hash("c1", "a"), F.lit(SALTS))).otherwise(0))
    each = F.when(F.col("many"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = counted.withColumn("bucket", bucket).join(crowded, "bucket", "left").select("w1", "w2", "least", F.explode(each).alias("salt"))
    hit = dealt.join(spread, ["w1", "w2", "salt"])
    if keep_first:
        hit = hit.filter((F.col("doc") != F.col("least.doc")) | (F.col("a") != F.col("least.a")))
    return hit.select("c1", "a", F.col("a").alias("b"))
