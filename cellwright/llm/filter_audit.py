"""Interaction of filters: what each of them removes in every order.

Five filters are audited: A few words, B few distinct words, C many capitals, D marks of code, E a text that a smaller id has too.
A to D need a text alone.  E needs equal texts to meet, and most texts have no equal: a counting Bloom sketch whose counters
stop at two is built over all texts, task by task, and merged by block.  A text with a counter below two is the only one of its
kind, so its text is never shuffled; the others are grouped by their full texts for the least id.  What is left of a document is
a mask of five bits, and the numbers of documents by part and mask give every order's steps by addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash

FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Continuation bytes of UTF-8: all other bytes begin a code point.
INNER = bytes(range(0x80, 0xC0))
#: Counters that a text touches, and counters for each document while the sketch may grow.
TOUCHED, PER_DOC = 4, 16
#: Bytes of the sketch that every worker holds (a bit for each counter).  Beyond it documents share counters and more texts are
#: compared in full; the results stay the same.
SKETCH_BYTES = 32 << 20
BLOCKS = 2048


def n_counters(n_docs: int, sketch_bytes: int = SKETCH_BYTES) -> int:
    """A power of two."""
    most = 1 << ((sketch_bytes * 8).bit_length() - 1)
    wanted = 1 << (n_docs * PER_DOC).bit_length()
    return max(BLOCKS * 8, min(most, wanted))


def text_hashes(texts: list[bytes | None]) -> np.ndarray:
    """Two 64-bit hashes of each text, null as empty."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x or b"") for x in texts), "<u8").reshape(-1, 2)


def positions(hashes: np.ndarray, m: int) -> np.ndarray:
    """TOUCHED counters of each text, all different."""
    step = hashes[:, 1:] | np.uint64(1)
    return ((hashes[:, :1] + step * np.arange(TOUCHED, dtype=np.uint64)) & np.uint64(m - 1)).astype(np.int64)


def _sketcher(m: int):
    """A partition's counters by block: those that one text has touched, and those that more have."""
    shift = (m // BLOCKS).bit_length() - 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([at, *waiting])
            weights = np.concatenate([counts, np.ones(len(new) - len(at), np.int64)])
            waiting.clear()
            values, which = np.unique(new, return_inverse=True)
            return values, np.minimum(np.bincount(which, weights, len(values)).astype(np.int64), 2)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(positions(text_hashes(batch.column(0).to_pylist()), m).ravel())
            held += len(waiting[-1])
            if held > 1 << 20:
                (at, counts), held = merged(at, counts), 0
        at, counts = merged(at, counts)
        block, inside = at >> shift, (at & ((1 << shift) - 1)).astype("<u4")
        edge = np.searchsorted(block, np.arange(BLOCKS + 1))
        rows = [(k, inside[a:b], counts[a:b]) for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], pa.int32()),
                pa.array([x[n == 1].tobytes() for _, x, n in rows], pa.binary()),
                pa.array([x[n > 1].tobytes() for _, x, n in rows], pa.binary()),
            ],
            names=["block", "once", "more"],
        )

    return run


def _merger(m: int):
    """Blocks of the merged sketch, as bits of the counters that reach two; the rows come sorted by block."""
    size = m // BLOCKS

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, one, two = None, np.zeros(size, bool), np.zeros(size, bool)

        def done() -> pa.RecordBatch:
            bits = np.packbits(two, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != own:
                    if own is not None:
                        yield done()
                    own, one, two = block, np.zeros(size, bool), np.zeros(size, bool)
                x, y = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                two[x[one[x]]] = True
                one[x] = True
                two[y] = one[y] = True
        if own is not None:
            yield done()

    return run


def repeat_sketch(texts: DataFrame, n_docs: int, sketch_bytes: int = SKETCH_BYTES) -> np.ndarray:
    """Bits of all counters that reach two, over a table of one binary column; at most ``sketch_bytes`` come to the driver."""
    m = n_counters(n_docs, sketch_bytes)
    parts = texts.mapInArrow(_sketcher(m), "block int, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(m), "block int, bits binary")
    out = np.zeros((BLOCKS, m // BLOCKS // 8), np.uint8)
    for row in merged.collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def may_repeat(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False for texts that are certainly the only ones of their kind."""
    at = positions(hashes, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def failures(text: bytes, least_words: int, distinct_percent: int, capitals_percent: int, marks: bytes) -> int:
    """Bits 0 to 3: whether the text fails A to D.  bytes.split() cuts at the bytes \\x20 and \\x09-\\x0D."""
    words = text.split()
    out = int(len(words) < least_words)
    out |= (100 * len(set(words)) < distinct_percent * len(words)) << 1
    n_capitals = len(text) - len(text.translate(None, CAPITALS))
    out |= (100 * n_capitals > capitals_percent * len(text.translate(None, INNER))) << 2
    return out | (len(text.translate(None, marks)) < len(text)) << 3


def _marker(bits, limits: tuple, id_type: pa.DataType):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            hashes = text_hashes(texts)
            maybe = may_repeat(hashes, bits.value) if len(texts) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(id_type),
                    batch.column(1),
                    pa.array([failures(x, *limits) for x in texts], pa.int32()),
                    pa.array(hashes[:, 0].view(np.int64)),
                    pa.array(hashes[:, 1].view(np.int64)),
                    pa.array(maybe),
                    pa.array([x if m else None for x, m in zip(texts, maybe.tolist(), strict=True)], pa.binary()),
                ],
                names=["id", "part", "mask", "h", "g", "maybe", "text"],
            )

    return run


def rules(spark: SparkSession) -> DataFrame:
    """What a document with a mask means to each step of each order: 120 * 5 * 32 rows, whatever the data."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append(("".join(order), k + 1, bit, before))
            before |= bit
    every = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31))))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    return every.select(
        "filter_order", "step", "mask",
        (~fails & ~gone).cast("long").alias("kept"), (fails & ~gone).cast("long").alias("removed"), (fails & gone).cast("long").alias("redundant"),
        (F.col("mask") == F.col("bit")).cast("long").alias("unique_fails"),
        # in 120 / k of the orders a filter comes first of the k that a document fails
        F.when(fails, F.lit(120) / F.bit_count("mask")).otherwise(0).cast("long").alias("shapley"),
    )


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", least_words: int = 50, distinct_percent: int = 65, capitals_percent: int = 5, marks: str = "#$%&*|", sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """part, mask, n, good, toxic: numbers of documents, of those labelled quality 1 and of those labelled toxic 1."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    bits = spark.sparkContext.broadcast(repeat_sketch(own.select("text"), own.count(), sketch_bytes))
    kind = own.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    limits = (least_words, distinct_percent, capitals_percent, marks.encode())
    marker = _marker(bits, limits, to_arrow_type(own.schema["id"].dataType))
    marked = stash(own.mapInArrow(marker, f"id {kind}, part string, mask int, h bigint, g bigint, maybe boolean, text binary"), "audit-marks")
    # the least id of every text that may be there again, by the full text; copies are combined before they are shuffled
    least = marked.filter("maybe").groupBy("text").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.min("g").alias("g"))
    first = least.filter("id is not null").select("id", "h", "g", F.lit(True).alias("first"))
    labelled = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = marked.groupBy("id", "h", "g", "part", "mask", "maybe").agg(F.count("*").alias("n"))
    named = rows.filter("id is not null")
    # a text is there once for an id that is its least one, or it is a later copy
    joined = named.join(first, ["id", "h", "g"], "left").join(labelled, "id", "left")
    later = F.col("maybe") & F.col("first").isNull()
    known = joined.select("part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    nameless = rows.filter("id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, filter_order, step and the counts of ``masks``' documents at that step; ``options`` are those of ``masks``.

    Columns: kept, removed, redundant (failing the step's filter, removed before), unique_fails (failing no other filter), good_lost,
    toxic_lost, shapley (removed by the step's filter, summed over all orders).

    Null texts are empty ones, and null parts are the empty part.  E compares ids: rows with one id and one text are no copies of
    each other, and a null id is neither smaller nor larger than any (such a row never fails E, and its text excuses no other).  Rows of labels with one
    id count together: any quality 1 makes a document good.  An empty table gives no rows.  Other columns don't matter.
    """
    counted = masks(docs, labels, **options)
    steps = counted.join(F.broadcast(rules(docs.sparkSession)), "mask")
    total = lambda name: F.sum(F.col(name) * F.col("n")).alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        *(total(c) for c in ("kept", "removed", "redundant", "unique_fails")),
        F.sum(F.col("removed") * F.col("good")).alias("good_lost"),
        F.sum(F.col("removed") * F.col("toxic")).alias("toxic_lost"),
        total("shapley"),
    )
