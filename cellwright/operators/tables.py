"""Labels, splits and other small tables joined to features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered

#: Half-open ranges of life by class (fixed values).
LIFE_CLASSES = [(1, 0, 300), (2, 300, 1000), (3, 1000, 2000), (4, 2000, 100_000_000)]


def first_rows(df: DataFrame, n: int | None, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """The first n cycles of each cell; None, 0 and -1: all."""
    if not n or n < 0:
        return df
    return df.withColumn("__k", F.row_number().over(ordered([cell], cycle))).filter(F.col("__k") <= n).drop("__k")


def labels_from_json(files: DataFrame, early: int = 100) -> DataFrame:
    """cell, life from JSON maps (file, json): file names lose their extension, lives up to ``early`` go, and of equal keys the last file's counts."""
    pairs = files.select("file", F.explode(F.from_json("json", "map<string,double>")).alias("key", "life")).filter(F.col("life") > early)
    return pairs.groupBy(F.regexp_replace("key", r"\.[^.]*$", "").alias("cell")).agg(F.max_by("life", "file").alias("life"))


def in_split(features: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """Rows of a split's cells; all rows if the split has none of them."""
    kept = features.join(splits.filter(F.col("split") == name).select("cell_id"), "cell_id", "left_semi")
    return kept if kept.limit(1).count() else features


def by_substring(df: DataFrame, column: str, rules: list[tuple[str, str]], default: str, name: str) -> DataFrame:
    out = F.lit(default)
    for part, value in reversed(rules):
        out = F.when(F.contains(F.col(column), F.lit(part)), value).otherwise(out)
    return df.withColumn(name, out)


def life_classes(labels: DataFrame) -> DataFrame:
    classes = labels.sparkSession.createDataFrame(LIFE_CLASSES, "life_class int, lo bigint, hi bigint")
    return labels.join(F.broadcast(classes), (F.col("life") >= F.col("lo")) & (F.col("life") < F.col("hi")))  # four rows


def seen_flags(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """seen: the flag of a test cell (a missing one is an error), 1 for the others."""
    joined = cells.join(lookup, "cell_id", "left")
    missing = F.raise_error(F.concat(F.lit("no seen/unseen flag for "), F.col("cell_id").cast("string"))).cast("int")
    return joined.withColumn("seen", F.when(F.col("split") != "test", 1).when(F.col("flag").isNotNull(), F.col("flag")).otherwise(missing)).drop("flag")


def ordered_columns(df: DataFrame, priority: list[str]) -> DataFrame:
    """Columns of the priority list first, the others by name."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def without(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys aren't among the excluded ones; a null key is never excluded."""
    return rows.join(excluded.select(*keys), keys, "left_anti")
