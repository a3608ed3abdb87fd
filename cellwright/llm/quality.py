"""Quality by importance resampling.

Two generative models over hashed byte n-grams, one of target text (labelled good) and one of all raw text, give
each document a log importance weight: the sum over its n-grams of log p_target - log p_raw.  Weight plus Gumbel noise
is its key, and the k largest keys are a sample without replacement by importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash, text_of
from cellwright.llm.tokens import slices

#: Hash buckets; counts and models have this size whatever the corpus.
BUCKETS = 1 << 16
GRAM = 4
#: Labelled rows that the target model and the threshold are fitted on, at most; those with the least hashes.
FIT_ROWS = 50_000
#: Share of labelled good rows that may fall below the threshold for the number of rows kept.
GOOD_LOSS = 0.002
#: Pseudocount of a bucket.
PRIOR = 1.0


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last ones."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        h *= np.uint32(257)
        h += data[k : len(data) - GRAM + 1 + k]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _padded(text: bytes) -> bytes:
    """Texts begin and end with a line feed, so that short ones have n-grams too."""
    return b"\n" + text + b"\n"


def text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts in a row, and how many each text has; none goes over from one text to the next."""
    padded = [_padded(x) for x in texts]
    found = gram_buckets(np.frombuffer(b"".join(padded), np.uint8))
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    counts = np.maximum(sizes - GRAM + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return found[np.repeat(np.cumsum(sizes) - sizes, counts) + at], counts


@lean
def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket over a partition: of all rows and of target rows."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices([len(x) for x in texts], 1 << 19):
            found, counts = text_grams(texts[a:b])
            raw += np.bincount(found, minlength=BUCKETS)
            target += np.bincount(found[np.repeat(np.array(good[a:b], bool), counts)], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """Up to ``fit_rows`` labelled rows with the least hashes of their ids: id, good."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
    return own.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)


def fit(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of the target to the raw model by bucket; zeros where nothing is labelled good.

    The counts cover every document; BUCKETS rows at most come to the driver.
    """
    good = sample.filter("good").select("id", F.lit(True).alias("good"))
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    marked = own.join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = marked.mapInArrow(_counter, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    # both counts with the same pseudocount: buckets that are rarely seen say little
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str, name: str) -> DataFrame:
    """docs with ``name``: the sum of log ratios over all n-grams of the whole text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(ratio)

    def score(texts: pd.Series) -> pd.Series:
        table, out = model.value, np.zeros(len(texts))
        for a, b in slices([len(x) for x in texts], 1 << 19):
            found, counts = text_grams(list(texts[a:b]))
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), counts), weights=table[found], minlength=b - a)
        return pd.Series(out)

    return docs.withColumn(name, F.pandas_udf(score, "double")(text_of(text_col).cast("binary")))


def gumbel(seed: int, id_col: str) -> Column:
    """Gumbel noise from a hash of seed and id; a null id has its own."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, name: str, k: int) -> float | None:
    """The k-th largest value of a column, by counting in ever finer histograms; None if k is beyond the rows."""
    part = keys.select(F.col(name).alias("x")).filter("x is not null")
    low, high, n = part.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or k > n:
        return None
    while low < high:
        width = (high - low) / 1024
        if not low + width > low:
            # neighbouring floats: few distinct values are left
            values = part.filter(F.col("x").between(low, high)).groupBy("x").count().orderBy(F.desc("x")).limit(4096).collect()
            for v in values:
                k -= v["count"]
                if k <= 0:
                    return v["x"]
            return low
        bin_ = F.least(F.floor((F.col("x") - low) / width), F.lit(1023))
        rows = part.filter(F.col("x").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                if k == 1:
                    return row["hi"]
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0, k: int | None = None, fit_rows: int = FIT_ROWS, good_loss: float = GOOD_LOSS) -> DataFrame:
    """docs' ids with log_weight, key and kept: whether the key is among the k largest; without ``k`` labels say how many that is.

    The number of rows to keep is then that of the keys no less than all but the share ``good_loss`` of those of labelled good rows.  Rows with equal keys at the limit all stay.  Null and empty texts
    have the n-grams of an empty line, so the limit decides on them as on any short text; without any good label every weight
    is 0, and all rows are kept unless k is given.  Repeated rows have one key.
    """
    small_batches(docs.sparkSession)
    # at most fit_rows small rows: they are broadcast
    sample = stash(sampled_labels(labels, id_col, label_col, fit_rows), "label-sample")
    ratio = fit(docs, sample, id_col, text_col)
    weighted = log_weights(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ratio, "text", "log_weight").drop("text")
    scored = stash(weighted.withColumn("key", F.col("log_weight") + gumbel(seed, "id")), "quality-scores")
    if k is None:
        good = scored.join(F.broadcast(sample.filter("good")), "id", "left_semi")
        n_good = good.count()
        limit = kth_largest(good, "key", n_good - int(good_loss * n_good)) if ratio.any() else None
    else:
        limit = kth_largest(scored, "key", k)
        if limit is None:
            limit = float("inf") if k < 1 else None
    kept = F.lit(True) if limit is None else F.col("key") >= F.lit(limit)
    return scored.select(F.col("id").alias(id_col), "log_weight", "key", kept.alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The rows of docs that the resampling keeps, with their own columns."""
    kept = importance_resample(docs, labels, id_col, seed=seed).filter("kept").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
