"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted rate(s) = weight(s) * total / size(s) times on average.  A uniform number made
from a hash of seed and id is put through the inverse Poisson distribution with that mean; the
document is exploded by the count and its copies are dealt out by another hash.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import free_name, stash

#: Sources up to which the table of rates is broadcast (about 50 bytes each); beyond it is joined by key.
BROADCAST_SOURCES = 100_000
#: Larger means are drawn as sums of independent draws of equal mean, as exp(-mean) would vanish.
LARGEST_MEAN = 500.0


def unit(seed: int, *keys: str, part: Column | None = None) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over seed, keys (null: empty) and, if given, the part's number."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), *([] if part is None else [F.lit("part"), part.cast("string")]))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds u, for means up to LARGEST_MEAN; beyond the last step lies less than 1e-18 of the mass."""
    start = F.struct(F.lit(0).cast("bigint").alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.when(u < s["c"], s).otherwise(F.struct(i.cast("bigint").alias("k"), p.alias("p"), (s["c"] + p).alias("c")))

    steps = F.greatest(F.lit(64), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["k"]


def poisson(seed: int, mean: Column, *keys: str) -> Column:
    """A Poisson draw of any mean from hashes of seed and keys."""
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN).cast("int"), F.lit(1))
    more = F.transform(F.sequence(F.lit(2), parts), lambda k: poisson_inverse(unit(seed, *keys, part=k), mean / parts))
    rest = F.when(parts > 1, F.aggregate(more, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    return poisson_inverse(unit(seed, *keys), mean / parts) + rest


def rates(docs: DataFrame, targets: DataFrame | None, source_col: str, id_col: str, total: float | None = None) -> DataFrame:
    """source, rate, from counts over all documents.

    ``targets`` has source and weight (any positive scale); None: equal weights.  A source without a weight, or with one that
    is not positive, gets rate 0; a null source is a source.  ``total`` is the number of rows wanted; None: as many as there are.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = targets.groupBy("source").agg(F.max("weight").cast("double").alias("weight"))
        weighted = sizes.alias("s").join(wanted.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left").select("s.source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = weighted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    wanted_rows = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    return weighted.crossJoin(F.broadcast(sums)).select("source", F.coalesce(F.try_divide(F.col("weight") / F.col("all_w") * wanted_rows, F.col("n")), F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 0, total: float | None = None, copy_col: str = "copy", key_col: str = "mix_key", rate_col: str | None = None) -> DataFrame:
    """Replicate documents to the sources' target shares and shuffle them globally.

    Every column stays; ``copy_col`` numbers a document's copies from 0 and ``key_col`` is the hash by which rows are dealt
    to partitions and sorted inside them; where docs has a column of one of these names, the new one gets an underscore.  Rows with equal ids draw the same number.  An empty table stays empty.
    """
    rate, draw, wanted = (free_name(docs, name) for name in ("rate", "draw", "wanted_source"))
    copy_col, key_col = free_name(docs, copy_col), free_name(docs, key_col)
    own = stash(rates(docs, targets, source_col, id_col, total), "rates").select(F.col("source").alias(wanted), F.col("rate").alias(rate))
    few = own.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(own) if few else own, F.col(source_col).eqNullSafe(F.col(wanted))).drop(wanted)
    counted = joined.withColumn(draw, poisson(seed, F.col(rate), id_col)).filter(F.col(draw) > 0)
    copies = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(draw) - 1))).drop(draw)
    keyed = copies.withColumn(key_col, F.md5(F.concat_ws(":", F.lit(f"{seed}:mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy_col).cast("string"))))
    out = keyed.repartition(F.col(key_col)).sortWithinPartitions(key_col)
    return out.drop(rate) if rate_col is None else out.withColumnRenamed(rate, free_name(docs, rate_col))
