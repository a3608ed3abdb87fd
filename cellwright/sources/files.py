"""Feature files of cells, and reports, as files."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from cellwright.operators.tables import first_rows, ordered_columns

#: What stands for a missing value in a file (fixed values).
MISSING = ["", "NaN", "nan", "NA", "null", "None"]
#: Files in a folder of cells' files; bytes of them that a task parses before it hands rows on; tasks a core that read files.
FOLDER_FILES = 1000
PARSED_BYTES = 4 << 20
TASKS_PER_CORE = 4
FOLDERS = "folder string, files bigint"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the folder that the cluster shares (spark.checkpoint.dir); a temporary one where one machine has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="cellwright-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: for a table that a plan needs several times, and would make anew each time."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parser(schema: StructType):
    """Rows of whole files by the names in their headers."""
    types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    convert = pa.csv.ConvertOptions(column_types=types, include_columns=types.names, include_missing_columns=True, null_values=MISSING, strings_can_be_null=True)
    one_thread = pa.csv.ReadOptions(use_threads=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, size = [], 0
            for cell, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = pa.csv.read_csv(io.BytesIO(data := text.encode()), read_options=one_thread, convert_options=convert)
                tables.append(rows.add_column(0, "__cell", pa.repeat(pa.scalar(cell, pa.string()), rows.num_rows)))
                size += len(data)
                if size >= PARSED_BYTES:
                    yield from pa.concat_tables(tables).combine_chunks().to_batches()
                    tables, size = [], 0
            if tables:
                yield from pa.concat_tables(tables).combine_chunks().to_batches()

    return run


def _texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, value (whole text) of all CSV files; the scan has a task for some thirty small files, so a number of tasks that the cores set takes them over."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), "value").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def read_features(spark: SparkSession, path: str | list[str], schema: StructType, nrows: int | None = None, cell: str = "cell_id", cell_of_path: str = r"([^/]+)\.csv$", cycle: str = "cycle", escaped: bool = False) -> DataFrame:
    """Rows of all CSV files under a folder, with ``cell`` from the file's path; of each cell the first ``nrows`` cycles (None, 0, -1: all).

    Columns are found by the files' own headers, whatever their order; those that a file lacks are NULL, and those that the schema lacks are left out.  Files in folders named ``*_curves``,
    and empty ones, are skipped.  ``escaped``: names in paths are written as Spark writes partitions' values.  A file is a cell's feature table, so a task parses it whole.
    """
    whole = _texts(spark, path).filter(~F.col("file").rlike(r"/[^/]*_curves/") & F.col("value").rlike(r"\S"))
    name = F.regexp_extract("file", cell_of_path, 1)
    for _ in range(1 + escaped):
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    named = whole.select(name.alias("cell"), "value")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = named.mapInArrow(_parser(schema), f"__cell string, {fields}").withColumnRenamed("__cell", cell)
    return first_rows(rows, nrows, cell, cycle)


def _cell_writer(path: str, header: str):
    """Writes a partition's lines (cell, line), which come cell by cell, as a file a cell; a row for each folder that is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        out, own, folder, n = None, None, "", 0
        for batch in batches:
            for cell, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or cell != own:
                    if out is not None:
                        out.close()
                    if n == FOLDER_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([n], pa.int64())], names=["folder", "files"])
                        n = 0
                    if n == 0:
                        folder = uuid.uuid4().hex
                        fs.create_dir(f"{root}/{folder}", recursive=True)
                    out, own, n = fs.open_output_stream(f"{root}/{folder}/__cell={quote(cell, safe='')}.csv", buffer_size=1 << 16), cell, n + 1
                    out.write(header.encode())
                out.write(f"{line}\n".encode())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([n], pa.int64())], names=["folder", "files"])

    return run


def write_cell_files(features: DataFrame, path: str, priority: list[str], cell: str = "cell_id", order: str = "cycle") -> str:
    """A CSV file for each cell, columns of the priority list first and the others by name, rows in order; the manifest is written last and names the version.

    A run that breaks leaves a folder that no manifest names, and a task that is repeated leaves folders that the version's list lacks, so readers never see half of it.  A cell's rows are
    written by one task, straight into the shared folder: a writer that moves a folder a cell at the end costs the driver a call for each.  The path is one that ``pyarrow.fs`` can open.
    """
    spark = features.sparkSession
    version = uuid.uuid4().hex
    columns = ordered_columns(features, priority).columns
    # an empty or missing name stands as Spark writes it in partitions' folders
    name = F.coalesce(F.nullif(F.col(cell).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = features.select(name.alias("__cell"), F.col(order).alias("__order"), F.to_csv(F.struct(*columns), {"escape": '"'}).alias("line"))
    sorted_rows = lines.repartition("__cell").sortWithinPartitions("__cell", "__order").select("__cell", "line")
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(columns)
    written = sorted_rows.mapInArrow(_cell_writer(f"{path}/data-{version}", header.getvalue()), FOLDERS)
    written.write.parquet(f"{path}/folders-{version}")
    manifest = spark.createDataFrame([(version, columns)], "version string, columns array<string>").withColumn("written", F.current_timestamp().cast("double"))
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """version, columns, written of the newest whole version."""
    every = spark.read.schema("version string, columns array<string>, written double").json(f"{path}/manifest")
    return every.orderBy(F.desc("written"), "version").limit(1)


def _newest(spark: SparkSession, path: str) -> list[str]:
    """Folders of the newest whole version, ``FOLDER_FILES`` files or less each; an error where there is none."""
    newest = manifest(spark, path).first()
    if newest is None:
        raise FileNotFoundError(f"no whole version under {path}")
    listed = spark.read.schema(FOLDERS).parquet(f"{path}/folders-{newest['version']}")
    return [f"{path}/data-{newest['version']}/{r['folder']}" for r in listed.collect()]


def read_cell_files(spark: SparkSession, path: str, schema: StructType, nrows: int | None = None, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """The newest whole version under ``path`` as ``read_features`` reads it; an error where there is none."""
    inside = StructType([f for f in schema if f.name != cell])
    folders = _newest(spark, path)
    if not folders:
        return spark.createDataFrame([], StructType([StructField(cell, StringType()), *inside]))
    return read_features(spark, folders, inside, nrows, cell, r"__cell=([^/]*)\.csv$", cycle, escaped=True)


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0), name, n_files of the columns in the files of the newest version."""
    folders = _newest(spark, path)
    if not folders:
        return spark.createDataFrame([], "position int, name string, n_files bigint")
    first = F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), ",")
    return _texts(spark, folders).select(F.posexplode(first).alias("position", "name")).groupBy("position", "name").agg(F.count("*").alias("n_files"))


def write_summary(path: str, title: str, tables: dict[str, DataFrame], most: int = 20) -> None:
    """Tables as JSON lines under ``path/json``, their sizes as ``path/summary`` and a Markdown text of up to ``most`` rows of each under ``path/text``."""
    spark = next(iter(tables.values())).sparkSession
    sizes, lines = [], [f"# {title}", ""]
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/json/{name}")
        written = spark.read.schema(df.schema).json(f"{path}/json/{name}")
        sizes.append((name, written.count(), df.columns))
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in written.orderBy(*df.columns).limit(most).collect()]
        lines += ["", f"{sizes[-1][1]} rows", ""]
    spark.createDataFrame(sizes, "table string, n_rows bigint, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")
