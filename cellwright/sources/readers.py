"""Vendors' text formats as telemetry, and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators.tables import without

TELEMETRY = "cell_id bigint, cycle int, seq int, time_s double, current_a double, voltage_v double"


def renamed(rows: DataFrame, names: dict[str, str], units: dict[str, float] = {}) -> DataFrame:  # noqa: B006
    """Vendors' columns under our names, multiplied by the units' factors."""
    out = rows.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()))
    return out.select(*((F.col(c) * units[c]).alias(c) if c in units else F.col(c) for c in out.columns))


def read_csv(spark: SparkSession, path: str, schema: str, names: dict[str, str], units: dict[str, float] = {}, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:  # noqa: B006
    """Files with a header and a known schema; cell_file is the file's name without its extension."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).schema(schema).csv(path)
    return renamed(raw, names, units).withColumn("cell_file", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))


def csv_lines(lines: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    """The same for lines in a column."""
    keep = [c for c in lines.columns if c != column]
    return lines.select(*keep, F.from_csv(column, schema, {"sep": sep}).alias("r")).select(*keep, "r.*")


def charge_count_cycle(count: Column) -> Column:
    """Two charge counts make a cycle."""
    return (F.floor(count / 2) + 1).cast("int")


def json_cycles(records: DataFrame, column: str, fields: list[str], nested: bool = False) -> DataFrame:
    """Long rows from a JSON object of equally long arrays; '[]' is missing; with ``nested`` the text is a JSON string that holds JSON."""
    text = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), "array<string>")[0] if nested else F.col(column)
    schema = ", ".join(f"{f} array<double>" for f in fields)
    keep = [c for c in records.columns if c != column]
    parsed = records.select(*keep, F.from_json(text, schema).alias("r"))
    arrays = F.arrays_zip(*(F.coalesce(F.col(f"r.{f}"), F.array().cast("array<double>")).alias(f) for f in fields))  # shorter ones are padded with NULLs
    return parsed.select(*keep, F.posexplode(arrays).alias("seq", "x")).select(*keep, "seq", *(F.col(f"x.{f}").alias(f) for f in fields))


def write_features(features: DataFrame, path: str) -> None:
    """A folder for each cell."""
    features.write.mode("overwrite").partitionBy("cell_id").parquet(path)


def unfinished(cells: DataFrame, path: str) -> DataFrame:
    """Cells without a folder under ``path`` where ``write_features`` wrote; all cells if nothing was written there yet."""
    try:
        done = cells.sparkSession.read.parquet(path).select("cell_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return cells
    return without(cells, done, ["cell_id"])


def write_reports(path: str, **tables: DataFrame) -> None:
    """Parquet tables under one folder: selected, importance, robustness, drops."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Doubles as text of six digits, as the metrics file holds them."""
    return metrics.select(*(F.format_string("%.6f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))


