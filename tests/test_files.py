"""Feature files and reports: what is written is read again, broken and odd files included."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from cellwright.sources import files

SCHEMA = StructType([StructField("cell_id", StringType()), StructField("cycle", IntegerType()), StructField("a", DoubleType()), StructField("note", StringType())])
INSIDE = StructType([f for f in SCHEMA if f.name != "cell_id"])


def test_files_of_a_folder(spark, tmp_path):
    """Columns in any order, missing and extra ones, empty files, header alone, and folders of curves."""
    texts = {
        "x/cell_1.csv": "cycle,a,note\n2,1.5,two\n1,NaN,one\n3,,\n", "x/y/cell_2.csv": "note,extra,a,cycle\nfirst,9,0.25,7\n", "cell 3.csv": "cycle\n4\n", "cell_4.csv": "", "cell_5.csv": "  \n", "cell_6.csv": "cycle,a\n",
        "x_curves/cell_1.csv": "cycle,a\n1,99\n", "x/cell_9.txt": "cycle,a\n1,99\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda n: sorted(map(tuple, files.read_features(spark, f"file://{tmp_path}", INSIDE, n).collect()), key=str)
    assert read(None) == read(0) == read(-1) == [("cell 3", 4, None, None), ("cell_1", 1, None, "one"), ("cell_1", 2, 1.5, "two"), ("cell_1", 3, None, None), ("cell_2", 7, 0.25, "first")]
    assert read(1) == [("cell 3", 4, None, None), ("cell_1", 1, None, "one"), ("cell_2", 7, 0.25, "first")]


@pytest.fixture
def features(spark):
    rows = [(f"cell/{k} ö=1+%2", c, None if c == 2 else 0.1 * c, f'say "{c}", é') for k in range(3) for c in (3, 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), sorted(rows)


def test_cells_come_back_in_order_from_the_newest_version(spark, tmp_path, features):
    df, rows = features
    path = f"file://{tmp_path}/out"
    files.write_cell_files(df.withColumn("a", F.lit(9.0)), path, ["cycle"])
    files.write_cell_files(df, path, ["note", "cycle", "absent"])
    assert sorted(map(tuple, files.read_cell_files(spark, path, SCHEMA).collect())) == rows
    assert sorted((r["position"], r["name"], r["n_files"]) for r in files.header_lines(spark, path).collect()) == [(0, "note", 3), (1, "cycle", 3), (2, "a", 3), (3, "cell_id", 3)]
    version = files.manifest(spark, path).first()["version"]
    written = list(Path(tmp_path, "out", f"data-{version}").rglob("*.csv"))
    assert len(written) == 3 and all([line.rsplit(",", 2)[0][-1] for line in f.read_text().splitlines()[1:]] == ["1", "2", "3"] for f in written)


def test_a_broken_run_is_not_read(spark, tmp_path, features):
    df, rows = features
    path = f"file://{tmp_path}/out"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_cell_files(spark, path, SCHEMA)
    files.write_cell_files(df, path, ["cycle"])
    broken = df.withColumn("a", F.when(F.col("cycle") == 3, F.raise_error(F.lit("lost"))).otherwise(1.0).cast("double"))
    with pytest.raises(Exception, match="lost"):
        files.write_cell_files(broken, path, ["cycle"])
    assert sorted(map(tuple, files.read_cell_files(spark, path, SCHEMA).collect())) == rows


def test_folders_hold_many_cells_and_are_listed(spark, tmp_path, monkeypatch):
    """No folder for each cell; folders that the version's list lacks, as a repeated task leaves them, aren't read; odd names and no rows at all."""
    monkeypatch.setattr(files, "FOLDER_FILES", 7)
    path = f"file://{tmp_path}/many"
    rows = [(name, c, 0.5 * k, None) for k, name in enumerate(["_hidden", ".dot", "a,b", "", None, *map(str, range(50))]) for c in (2, 1)]
    version = files.write_cell_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, ["cycle"])
    folders = [f for f in Path(tmp_path, "many", f"data-{version}").iterdir() if f.is_dir()]
    sizes = [len(list(f.glob("*.csv"))) for f in folders]
    assert sum(sizes) == 54 and max(sizes) <= 7 and len(folders) < 20
    (lost := folders[0].parent / "lost").mkdir()
    (lost / "__cell=0.csv").write_text("cycle,a\n9,9\n")
    none = "__HIVE_DEFAULT_PARTITION__"
    expected = sorted((r[0] or none, *r[1:]) for r in rows)
    assert sorted(map(tuple, files.read_cell_files(spark, path, SCHEMA).collect())) == expected
    first = sorted({e[:2]: e for e in expected if e[1] == 1 and e[0] != none}.values())
    assert sorted(tuple(r) for r in files.read_cell_files(spark, path, SCHEMA, 1).collect() if r[0] != none) == first
    files.write_cell_files(spark.createDataFrame([], SCHEMA), f"{path}-none", ["cycle"])
    assert files.read_cell_files(spark, f"{path}-none", SCHEMA).collect() == files.header_lines(spark, f"{path}-none").collect() == []


def test_reports_as_json_and_text(spark, tmp_path, features):
    path = f"file://{tmp_path}/report"
    files.write_summary(path, "Report", {"cells": features[0].drop("a"), "none": features[0].limit(0)}, most=2)
    sizes = {r["table"]: r["n_rows"] for r in spark.read.json(f"{path}/summary").collect()}
    assert sizes == {"cells": 9, "none": 0}
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/text").collect())
    assert text.startswith("# Report") and "## none" in text and "9 rows" in text and text.count("cell/") == 2
    assert spark.read.json(f"{path}/json/cells").count() == 9
