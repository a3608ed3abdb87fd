"""Queries for readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cellwright.operators import samples as sm
from cellwright.plans.cycles import rounded
from cellwright.plans.sql import FEATURES, PREDICTIONS, SPLITS, TELEMETRY, with_
from cellwright.sources import files
from cellwright.sources import fixtures as fx
from cellwright.sources import readers as rd

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("src1_csv_series", with_(TELEMETRY) + "SELECT cell_id, cycle, seq, round(time_s, 6) AS time_s, round(current_a, 6) AS current_a FROM telemetry")
def src1(spark, d):
    lines = fx.telemetry(spark, d).select("cell_id", F.concat_ws(",", "cycle", "seq", "time_s", F.col("current_a") * 1000).alias("line"))
    rows = rd.csv_lines(lines, "line", "c int, s int, t double, ma double")
    return rounded(rd.renamed(rows, {"cell_id": "cell_id", "c": "cycle", "s": "seq", "t": "time_s", "ma": "current_a"}, {"current_a": 0.001}))


@query("src2_tab_text", with_(TELEMETRY) + "SELECT cell_id, cycle // 2 + 1 AS cycle, count(*) AS n, round(sum(voltage_v), 6) AS v FROM telemetry GROUP BY cell_id, cycle // 2 + 1")
def src2(spark, d):
    lines = fx.telemetry(spark, d).select("cell_id", F.concat_ws("\t", "cycle", "voltage_v").alias("line"))
    rows = rd.csv_lines(lines, "line", "n int, v double", sep="\t").withColumn("cycle", rd.charge_count_cycle(F.col("n")))
    return rounded(rows.groupBy("cell_id", "cycle").agg(F.count("*").alias("n"), F.sum("v").alias("v")))


@query("src3_json_cycles", with_(TELEMETRY) + "SELECT cell_id, cycle, seq, round(time_s, 6) AS t, CASE WHEN cycle % 3 <> 0 THEN round(voltage_v, 6) END AS v FROM telemetry")
def src3(spark, d):
    arrays = fx.telemetry(spark, d).groupBy("cell_id", "cycle").agg(F.array_sort(F.collect_list(F.struct("seq", "time_s", "voltage_v"))).alias("a"))
    v = F.when(F.col("cycle") % 3 == 0, F.array().cast("array<double>")).otherwise(F.transform("a", lambda x: x["voltage_v"]))
    text = F.to_json(F.struct(F.transform("a", lambda x: x["time_s"]).alias("t"), v.alias("v")))
    wrapped = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return rounded(rd.json_cycles(arrays.select("cell_id", "cycle", wrapped.alias("json")), "json", ["t", "v"], nested=True))


SCHEMA = StructType([StructField("cell_id", LongType()), StructField("cycle", IntegerType()), *(StructField(c, DoubleType()) for c in ("temp_mean", "chg_v", "dvp"))])


def cell_files(spark, d) -> str:
    """Feature files of all cells; the path."""
    path = files.new_folder(spark, "features")
    files.write_cell_files(fx.cycle_features(spark, d), path, ["cycle", "dvp"])
    return path


@query("src4_cell_files", with_(TELEMETRY, FEATURES) + "SELECT cell_id, cycle, round(temp_mean, 6) AS temp_mean, round(chg_v, 6) AS chg_v, round(dvp, 6) AS dvp FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM features) x WHERE k <= 5")
def src4_files(spark, d):
    """Written as a file a cell, read again with a limit of cycles."""
    rows = files.read_cell_files(spark, cell_files(spark, d), SCHEMA, nrows=5)
    return rounded(rows.withColumn("cell_id", F.col("cell_id").cast("bigint")))


@query("snk1_column_order", with_(TELEMETRY) + "SELECT CAST(position AS INT) AS position, name, count(*) AS n_files FROM (SELECT DISTINCT cell_id FROM telemetry) c, (VALUES (0, 'cycle'), (1, 'dvp'), (2, 'cell_id'), (3, 'chg_v'), (4, 'temp_mean')) v(position, name) GROUP BY ALL")
def snk1_order(spark, d):
    return files.header_lines(spark, cell_files(spark, d))


@query("snk2_reports", with_(PREDICTIONS, SPLITS) + "SELECT 'errors' AS \"table\", count(DISTINCT model) AS n_rows, 'model,mae,mape' AS columns FROM predictions UNION ALL SELECT 'cells', count(*), 'cell_id,split' FROM splits")
def snk2(spark, d):
    """Two reports as JSON and text; the summary of what was written."""
    path = files.new_folder(spark, "reports")
    metrics = fx.predictions(spark, d).groupBy("model").agg(*sm.errors()).select("model", "mae", "mape")
    files.write_summary(path, "Errors and cells", {"errors": metrics, "cells": fx.splits(spark, d)})
    summary = spark.read.schema("table string, n_rows bigint, columns array<string>").json(f"{path}/summary")
    return summary.withColumn("columns", F.array_join("columns", ","))


@query("snk3_metric_rows", with_(PREDICTIONS) + "SELECT model, printf('%.6f', avg(abs(pred - y))) AS mae, printf('%.6f', avg(abs(pred - y) / greatest(abs(y), 2.220446049250313e-16))) AS mape FROM predictions GROUP BY model")
def snk3(spark, d):
    return rd.metric_rows(fx.predictions(spark, d).groupBy("model").agg(*sm.errors()).select("model", "mae", "mape"))
