"""Content-addressed store of token ids.

Every document's id stream is cut into chunks where a rolling hash of the last 16 ids says so, so equal
passages give equal chunks wherever they stand.  The store has three Parquet tables:

* ``parts``: doc_id, n_tokens, chunks, hash, payload.  Rows with a hash are the chunks, each once; the payload
  is its n_tokens ids as little-endian unsigned integers of 16 bits (32 if the vocabulary needs it).  The other
  rows are what a document was cut into.
* ``recipes``: recipe, doc_id, start, n_tokens, root, chunks.  Documents in ascending doc_id order; the hashes of
  a document's chunks, and the Merkle root over them.
* ``manifest``: segment, first_recipe, n_documents, n_tokens, root.  The Merkle root over a segment's documents.

Reading verifies every chunk against its hash and every document against its root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash, text_of
from cellwright.llm.tokens import encoded

WINDOW, CHUNK, LONGEST = 16, 512, 4096
#: Documents under one root of the manifest.
SEGMENT = 1 << 16
_GEAR = np.uint64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of chunks in ids; ends are those of the documents, ascending, none of them empty.

    A chunk ends after an id at which the hash of the last 16 ids of the same document falls into one of 512
    parts, at a document's end, and after 4096 ids.
    """
    h = ids.astype(np.uint64) * _GEAR
    h ^= h >> np.uint64(29)
    width = 1
    while width < WINDOW:  # hash of width ids -> of twice as many
        h[width:] = h[width:] + h[:-width] * np.uint64(pow(31, width, 1 << 64))
        width *= 2
    hit = (h * _GEAR) >> np.uint64(64 - CHUNK.bit_length() + 1) == 0
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.flatnonzero(hit)
    doc = np.searchsorted(ends, inside, side="right")
    inside = inside[inside - starts[doc] >= WINDOW - 1] + 1
    cuts = np.union1d(inside, ends)
    begin = np.concatenate([[0], cuts[:-1]])
    long = np.flatnonzero(cuts - begin > LONGEST)
    if len(long):
        cuts = np.union1d(cuts, np.concatenate([np.arange(begin[k] + LONGEST, cuts[k], LONGEST) for k in long]))
    return cuts


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over hashes: pairs are joined level by level, an odd one goes up alone; no leaf: the hash of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _chunker(path: str, end_id: int | None, wide: bool):
    dtype = "<u4" if wide else "<u2"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # payloads that this task has sent
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, flat, counts in encoded(texts, path):
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(counts), end_id)
                    counts = counts + 1
                hashes, payloads, owners, sizes = [], [], [], []
                full = np.flatnonzero(counts)
                ends = np.cumsum(counts)[full]
                if len(ends):
                    if not wide and flat.max() > 65535:
                        raise ValueError("ids of over 16 bits: pass wide=True")
                    raw, size = flat.astype(dtype).tobytes(), np.dtype(dtype).itemsize
                    cuts = cut_points(flat, ends)
                    begin = np.concatenate([[0], cuts[:-1]])
                    owners = full[np.searchsorted(ends, cuts, side="left")]
                    sizes = cuts - begin
                    for x, y in zip((begin * size).tolist(), (cuts * size).tolist(), strict=True):
                        data = raw[x:y]
                        key = digest(data)
                        hashes.append(key)
                        payloads.append(None if key in seen else data)
                        if len(seen) < 1_000_000:
                            seen.add(key)
                # a row for each document (its list of chunks), and one for each new chunk
                chunk_list: list[list[bytes]] = [[] for _ in range(b - a)]
                for key, k in zip(hashes, owners, strict=True):
                    chunk_list[k].append(key)
                new = [k for k, p in enumerate(payloads) if p is not None]
                n_docs = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column(0).slice(a, n_docs).to_pylist() + [None] * len(new), pa.int64()),
                        pa.array(counts.tolist() + [int(sizes[k]) for k in new], pa.int64()),
                        pa.array([*chunk_list, *[None] * len(new)], pa.list_(pa.binary())),
                        pa.array([None] * n_docs + [hashes[k] for k in new], pa.binary()),
                        pa.array([None] * n_docs + [payloads[k] for k in new], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "chunks", "hash", "payload"],
                )

    return run


def _roots(chunks: pd.Series) -> pd.Series:
    return chunks.map(lambda x: merkle(list(x)))


def _checked(keys: pd.Series, payloads: pd.Series, n_ids: pd.Series) -> pd.DataFrame:
    """Whether a chunk is what its hash says, and the CRC-32 of its ids as 32-bit integers."""
    ok, crc = [], []
    for key, data, n in zip(keys, payloads, n_ids, strict=True):
        ok.append(digest(data) == key)
        ids = np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2")
        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
    return pd.DataFrame({"ok": ok, "crc": crc})


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bit-reflected."""
    a, b, out = a.copy(), b.copy(), np.zeros_like(a)
    for _ in range(32):
        out ^= np.where(a & np.uint64(0x80000000), b, np.uint64(0))
        a = (a << np.uint64(1)) & np.uint64(0xFFFFFFFF)
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 parts as they count with n_bytes more bytes behind them."""
    out, left = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    power = np.full(1, 0x00800000, np.uint64)  # x**8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(np.broadcast_to(power, int(odd.sum())), out[odd])
        power, left = _times(power, power), left >> np.uint64(1)
    return out


def _joined_up(parts: pd.Series) -> pd.DataFrame:
    """Root, CRC-32 and number of ids of documents from their chunks' (seq, hash, n_ids, crc), in order; crc and n_ids of a bad chunk are null."""
    rows = [list(x) for x in parts]
    crc = np.array([p["crc"] or 0 for x in rows for p in x], np.uint64)
    n = np.array([p["n_ids"] or 0 for x in rows for p in x], np.int64)
    size = np.array([len(x) for x in rows], np.int64)
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    last = np.cumsum(size)
    behind = np.repeat(total[last], size) - total[1:]
    moved = shifted_crc(crc, 4 * behind)
    folded = [int(np.bitwise_xor.reduce(moved[a:b])) if b > a else 0 for a, b in zip(last - size, last, strict=True)]
    return pd.DataFrame({"root": [merkle([p["hash"] for p in x]) for x in rows], "crc": folded, "n": total[last] - total[last - size]})


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, wide: bool = False) -> None:
    """Encode whole texts (null: empty) and write the store under ``path``.

    Rows with equal ids are documents of their own, in an order by root; a null id comes first.  An empty
    table gives empty tables.
    """
    spark = docs.sparkSession
    small_batches(spark)
    merkle_root = F.pandas_udf(_roots, "binary")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, chunks array<binary>, hash binary, payload binary"
    pieces = source.mapInArrow(_chunker(tokenizer, end_id, wide), schema)
    # A row without a hash is a document's recipe.  Every task sends a payload once; of those, one stays.
    # Recipes stay whatever their number, so they are dealt so that equal rows don't meet in one task.
    dealt = pieces.withColumn("deal", F.when(F.col("hash").isNull(), F.xxhash64("doc_id", "chunks", F.spark_partition_id())).otherwise(F.xxhash64("hash")))
    same = Window.partitionBy("deal", "hash").orderBy("n_tokens")
    kept = dealt.withColumn("copy", F.row_number().over(same)).filter(F.col("hash").isNull() | (F.col("copy") == 1))
    kept.select("doc_id", "n_tokens", "chunks", "hash", "payload").write.option("compression", "zstd").parquet(f"{path}/parts")
    parts = spark.read.schema(schema).parquet(f"{path}/parts")
    recipes = parts.filter("hash is null").select("doc_id", "n_tokens", "chunks", merkle_root("chunks").alias("root"))
    ordered = stash(recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("segment", F.spark_partition_id()), "recipes")
    totals = ordered.groupBy("segment").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"), F.min(F.struct("doc_id")).alias("first"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = stash(totals.select("segment", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("n_documents").over(before), F.lit(0)).alias("docs_before")), "segments")
    own = Window.partitionBy("segment").orderBy("doc_id", "root")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.join(F.broadcast(offsets), "segment").select(
        (F.col("docs_before") + F.row_number().over(own) - 1).alias("recipe"), "doc_id", (F.col("ids_before") + F.sum("n_tokens").over(upto) - F.col("n_tokens")).alias("start"), "n_tokens", "root", "chunks"
    )
    placed.write.parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    segments(written).write.parquet(f"{path}/manifest")


def segments(recipes: DataFrame) -> DataFrame:
    """segment, first_recipe, n_documents, n_tokens and the Merkle root of every SEGMENT documents in a row."""
    merkle_root = F.pandas_udf(_roots, "binary")
    grouped = recipes.groupBy(F.floor(F.col("recipe") / SEGMENT).alias("segment")).agg(
        F.min("recipe").alias("first_recipe"), F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("recipe", "root"))), lambda x: x["root"]).alias("roots")
    )
    return grouped.select("segment", "first_recipe", "n_documents", "n_tokens", merkle_root("roots").alias("root"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts").filter("hash is not null").select("hash", F.col("n_tokens").alias("n_ids"), "payload")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files.

    Fails if a chunk is missing or isn't what its hash says, if a document's chunks don't give its root, or if the documents' roots don't give the manifest.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    listed = spark.read.parquet(f"{path}/manifest")
    found, columns = segments(recipes), ["segment", "first_recipe", "n_documents", "n_tokens", "root"]
    other = found.exceptAll(listed.select(*columns)).unionByName(listed.select(*columns).exceptAll(found))  # a row a segment
    if other.limit(1).count():
        raise ValueError("the manifest doesn't fit the store's documents")
    joined_up = F.pandas_udf(_joined_up, "struct<root:binary,crc:bigint,n:bigint>")
    check = F.pandas_udf(_checked, "struct<ok:boolean,crc:bigint>")("hash", "payload", "n_ids")
    chunks = read_chunks(spark, path).select("hash", "n_ids", check.alias("check")).select("hash", "n_ids", F.when(F.col("check.ok"), F.col("check.crc")).alias("crc"))
    asked = recipes.select("recipe", "doc_id", "start", "n_tokens", "root", F.posexplode_outer("chunks").alias("seq", "hash"))
    found = asked.join(chunks, "hash", "left")
    grouped = found.groupBy("recipe").agg(
        *(F.any_value(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")), F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("seq", "hash", "n_ids", "crc")))).alias("parts")
    )
    whole = grouped.select("doc_id", "start", "n_tokens", "root", joined_up("parts").alias("got"), F.exists("parts", lambda p: p["crc"].isNull()).alias("bad"))
    sound = ~F.col("bad") & (F.col("got.root") == F.col("root")) & (F.col("got.n") == F.col("n_tokens"))
    return whole.select(
        "doc_id", "start", "n_tokens", F.when(sound, F.col("got.crc")).otherwise(F.raise_error(F.concat(F.lit("the store doesn't hold document "), F.col("doc_id").cast("string"))).cast("bigint")).alias("ids_crc32")
    )
