"""Best-two-fit packing of token sequences.

A document's last pieces are whole sequences; only its first piece can be shorter, so the plan needs no
more than the number of pieces of each length, at most ``capacity`` counts, however many documents there
are.  The plan fills a sequence greedily with the longest pieces that fit, then replaces its smallest piece with
two unpacked ones that fit the expanded gap more tightly, and repeats the filling for as many sequences as the counts
allow.  Pieces take their places by rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash, text_of
from cellwright.llm.tokens import encoded

#: Pieces of one length that a task puts in order, about.
SHARD_PIECES = 100_000


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) for counts[length] pieces.

    Each round fills one sequence: the longest piece, then again and again the longest that fits.  If a
    gap is left, the smallest piece but the first may give way to two unpacked pieces whose sum is larger, at
    most the gap and the smallest piece together.  The filling is used until a length runs out.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        bin_, gap = [top], capacity - top
        left[top] -= 1
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            bin_.append(size)
            left[size] -= 1
            gap -= size
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            pair = best_pair(left, room, bin_[-1])
            if pair:
                left[bin_[-1]] += 1
                left[pair[0]] -= 1
                left[pair[1]] -= 1
                bin_ = [*bin_[:-1], *pair]
        kinds, uses = np.unique(bin_, return_counts=True)
        more = int((left[kinds] // uses).min())
        left[kinds] -= more * uses
        out.append((1 + more, bin_))


def best_pair(left: np.ndarray, room: int, than: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum in (than, room]; None without such."""
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, side="right") - 1  # the longest partner that fits
    ok = at >= 0
    a, b = sizes[ok], sizes[at[ok]]
    single = (a == b) & (left[a] < 2)
    lower = at[ok] - 1
    b = np.where(single, np.where(lower >= 0, sizes[np.maximum(lower, 0)], -room), b)
    best = int(np.argmax(a + b)) if len(a) else -1
    if best < 0 or a[best] + b[best] <= than:
        return None
    return int(a[best]), int(b[best])


def _cutter(path: str, capacity: int, end_id: int | None, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, flat, counts in encoded(texts, path):
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(counts), end_id)
                    counts = counts + 1
                n = -(-counts // capacity)
                owner = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                short = counts - (n - 1) * capacity  # length of the first piece
                length = np.where(piece == 0, short[owner], capacity)
                start = np.where(piece == 0, 0, short[owner] + (piece - 1) * capacity)
                begin = (np.cumsum(counts) - counts)[owner] + start
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(a, b - a).take(pa.array(owner)).cast(pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([flat[x : x + y] for x, y in zip(begin.tolist(), length.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the first piece of a document may be shorter than the others."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return source.mapInArrow(_cutter(tokenizer, capacity, end_id, with_ids), schema)


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with place: their rank within their length, from 0; ``most``: pieces of the most frequent length, which make the number of shards."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-most // SHARD_PIECES)))).cast("int")
    dealt = pieces.withColumn("shard", shard)
    counts = dealt.groupBy("length", "shard").count()
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "shard"]).withColumn("place", F.col("ahead") + F.col("own") - 1).drop("shard", "own", "ahead")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; places in a sequence are gapless from 0.

    The counts by length (at most ``capacity`` rows) and the plan's fillings are all that the driver sees; their number
    depends on the lengths, not on how many pieces have them.  A piece of length 0 (a document without ids)
    goes nowhere: sequence_id and offset are null.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    kept = stash(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in kept.filter("length > 0").groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    slots, sequence = [], 0
    taken: dict[int, int] = {}
    for times, lengths in plan(counts, capacity):
        offset = 0
        for size in lengths:
            slots.append((size, taken.get(size, 0), times, sequence, offset))
            taken[size] = taken.get(size, 0) + times
            offset += size
        sequence += times
    # slots of a length cover its ranks without a gap; a slot is found by the range that holds the rank
    steps = spark.createDataFrame(slots or [(-1, 0, 0, 0, 0)], "length bigint, first bigint, times bigint, sequence bigint, at bigint")
    table = steps.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "at"))).alias("slots"))
    found = ranked(kept, int(counts.max())).join(F.broadcast(table), "length", "left")
    slot = slot_of(F.col("slots"), F.col("place"))
    placed = found.withColumn("slot", slot)
    return placed.select(
        *kept.columns, (F.col("slot.sequence") + F.col("place") - F.col("slot.first")).alias("sequence_id"), F.col("slot.at").alias("offset")
    )


def slot_of(slots, place):
    """The last slot whose first rank is at most place, by bisection over the sorted array."""
    low = F.struct(F.lit(0).alias("lo"), F.size(slots).alias("hi"))
    def step(s, _):  # noqa: E306
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = F.get(slots, mid)["first"] <= place
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(go, mid).otherwise(s["lo"]).alias("lo"), F.when(go, s["hi"]).otherwise(mid).alias("hi")))
    return F.get(slots, F.aggregate(F.sequence(F.lit(1), F.lit(24)), low, step)["lo"])


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts (null: empty), each followed by end_id, and pack them into sequences of at most ``capacity`` ids."""
    return pack(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity)
