"""Battery tables derived from the supplied star schema (see FIXTURES.md)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered


#: Line items that a task holds while their cells' windows are computed; fewer where a small table would leave cores idle.
TASK_ROWS, LEAST_ROWS = 500_000, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(rows: int, cores: int) -> int:
    """Tasks of ``TASK_ROWS`` rows or less, and as many as there are cores if each gets ``LEAST_ROWS``."""
    return max(1, math.ceil(rows / TASK_ROWS), min(cores, rows // LEAST_ROWS))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier is a cell, 30 line items are a cycle (12 charge, 3 rest, 15 discharge samples) (the last one may be shorter).

    What follows sorts and groups within the same tasks, so cells are dealt to as many as the rows ask for, not to a number that the session fixes.
    """
    w = ordered(["l_suppkey"], "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    items = table(spark, sf_dir, "lineitem")
    dealt = items.repartition(task_count(items.count(), spark.sparkContext.defaultParallelism), "l_suppkey")
    rows = dealt.select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", (F.row_number().over(w) - 1).alias("rn"))
    return rows.selectExpr(
        "l_suppkey AS cell_id",
        "CAST(floor(rn / 30) AS INT) + 1 AS cycle",
        "CAST(rn % 30 AS INT) AS seq",
        "CAST(60 * (rn % 30) AS DOUBLE) + l_linenumber AS time_s",
        "CASE WHEN rn % 30 < 12 THEN 0.5D + l_quantity / 100 WHEN rn % 30 < 15 THEN 0D ELSE -(0.5D + l_quantity / 100) END AS current_a",
        "CASE WHEN rn % 30 < 12 THEN 3.0D + 0.1D * (rn % 30) + l_discount WHEN rn % 30 < 15 THEN 4.1D ELSE 4.2D - 0.08D * ((rn % 30) - 15) - l_tax END AS voltage_v",
        "25 + l_quantity / 10 AS temperature_c",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, dataset (the region's name), nominal_capacity_ah."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows by the schema
        .select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("dataset"), (0.1 + F.col("s_suppkey") % 5 / 10).alias("nominal_capacity_ah"))
    )


def life_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), (90 + (F.col("s_suppkey") * 37) % 2000).alias("life"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 10
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("split"))


def discharge_capacity(tel: DataFrame) -> DataFrame:
    """cell_id, cycle, qd: discharged charge of a cycle in Ah (right rectangles), to 9 digits."""
    w = ordered(["cell_id", "cycle"], "seq")
    step = F.when(F.col("current_a") < 0, F.abs("current_a") * (F.col("time_s") - F.lag("time_s").over(w))).otherwise(0.0)
    return tel.withColumn("q", step).groupBy("cell_id", "cycle").agg(F.round(F.sum("q") / 3600, 9).alias("qd"))


def cycle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, cycle and three features with gaps; a wide table for cleaning and imputation."""
    tel = telemetry(spark, sf_dir)
    agg = tel.groupBy("cell_id", "cycle").agg(
        F.round(F.avg("temperature_c"), 9).alias("temp_mean"), F.round(F.sum(F.when(F.col("current_a") > 0, F.col("voltage_v"))), 9).alias("chg_v"), F.round(F.max("voltage_v") - F.min("voltage_v"), 9).alias("dvp")
    )
    gone = ((F.col("cell_id") * 7 + F.col("cycle") * 3) % 11 == 0) | ((F.col("cell_id") % 10 == 3) & (F.col("cycle") <= 12))
    return agg.select("cell_id", "cycle", *(F.when(~gone, F.col(c)).alias(c) for c in ("temp_mean", "chg_v", "dvp")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 2).cast("int").alias("seen"), F.col("l_quantity").cast("int").alias("n_cycles"),
        F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_extendedprice") * (1 + F.col("l_discount") - 0.05)).cast("double").alias("pred"),
    )


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= n)
