"""Constants of the datasets, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "profile string, mode int, ic_low double, ic_high double, ic_window int, dv_window int, step double, min_height double, min_prominence double, cut double"
#: Mode (1: LFP rules, 2: NMC rules), voltage range, smoothing windows of IC and DV, step, least height and prominence, cut.
ROWS = [
    ("CALB", 2, 3.2, 3.6, 41, 25, 0.002, 0.5, 0.1, 0.02),
    ("CALCE", 1, 3.4, 4.2, 25, 31, 0.001, 0.05, 0.01, 0.01),
    ("HNEI", 1, 3.2, 4.2, 31, 21, 0.002, 0.01, 0.01, 0.02),
    ("HUST", 1, 3.0, 3.6, 51, 21, 0.001, 0.01, 0.02, 0.05),
    ("ISU-ILCC", 2, 3.85, 4.2, 21, 21, 0.01, 0.01, 0.02, 0.02),
    ("MATR", 1, 2.8, 3.8, 31, 31, 0.001, 0.01, 0.05, 0.02),
    ("MICH", 1, 3.3, 4.2, 21, 21, 0.01, 0.01, 0.02, 0.02),
    ("MICH_EXP", 1, 3.3, 4.2, 21, 21, 0.01, 0.01, 0.02, 0.02),
    ("Na", 2, 2.4, 3.0, 21, 21, 0.01, 0.01, 0.05, 0.02),
    ("RWTH", 1, 3.7, 3.88, 51, 21, 0.002, 0.01, 0.01, 0.02),
    ("SNL", 1, 3.0, 3.8, 31, 21, 0.001, 0.01, 0.02, 0.02),
    ("Stanford", 2, 3.4, 4.1, 21, 21, 0.002, 0.01, 0.01, 0.02),
    ("Tongji", 2, 3.8, 4.0, 21, 21, 0.005, 0.01, 0.01, 0.02),
    ("UL_PUR", 2, 3.1, 3.7, 21, 31, 0.002, 0.01, 0.02, 0.02),
    ("XJTU", 1, 3.3, 4.2, 21, 21, 0.01, 0.01, 0.02, 0.02),
    ("ZN-coin", 2, 1.0, 1.6, 21, 21, 0.005, 0.0001, 0.0001, 0.02),
]


#: Voltage intervals of equal-voltage times on charge and on discharge; where only one list is there, discharge mirrors it; none where cells differ (fixed values).
INTERVALS = {
    "CALB": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "CALCE": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "HNEI": ("3.5-3.8 3.8-4.1 4.1-4.25", "4.2-3.9 3.9-3.6 3.6-3.3"),
    "HUST": ("3.0-3.2 3.2-3.4 3.4-3.5", ""),
    "MATR": ("3.0-3.2 3.2-3.4 3.4-3.55", "3.5-3.3 3.3-3.1 3.1-2.9"),
    "MICH": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "MICH_EXP": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "Na": ("3.0-3.2 3.3-3.5 3.6-3.8", "3.9-3.6 3.5-3.2 3.1-2.8"),
    "RWTH": ("3.55-3.7 3.7-3.85 3.55-3.85",),
    "SNL": ("3.0-3.2 3.2-3.4 3.4-3.6",),
    "Stanford": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "Tongji": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "UL_PUR": ("3.5-3.7 3.7-3.9 3.9-4.1",),
    "XJTU": ("3.6-3.7 3.7-3.9 3.9-4.1", "4.1-3.9 3.9-3.7 3.7-3.5"),
    "ZN-coin": ("1.0-1.2 1.2-1.4 1.4-1.6",),
}
#: Half-widths in volts of the area around the main peak, where a profile fixes it (fixed values).
AREAS = {"HUST": 0.05, "ISU-ILCC": 0.03, "MATR": 0.03, "SNL": 0.05, "Tongji": 0.05, "UL_PUR": 0.05}
#: Profiles whose peak widths, and whose discharge DV features, are set to zero (fixed values).
NO_WIDTH, NO_DVP = ("ISU-ILCC", "MICH_EXP", "UL_PUR"), ("UL_PUR",)


def intervals(profile: str) -> tuple[list[list[float]], list[list[float]]]:
    """[from, to] on charge and on discharge."""
    parsed = [[[float(v) for v in part.split("-")] for part in text.split()] for text in INTERVALS.get(profile, ("", ""))]
    return parsed[0], parsed[1] if len(parsed) > 1 else [part[::-1] for part in parsed[0][::-1]]


def profiles(spark: SparkSession) -> DataFrame:
    """A row for each dataset profile."""
    rows = [(*row, AREAS.get(row[0]), row[0] in NO_WIDTH, row[0] in NO_DVP, *intervals(row[0])) for row in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", area double, no_width boolean, no_dvp boolean, tevi array<array<double>>, tevd array<array<double>>")


def forced_zeros(features: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """features (with their profile's flags) with the columns of each flag set to zero where it holds."""
    out = features
    for flag, columns in flags.items():
        for c in columns:
            out = out.withColumn(c, F.when(F.col(flag), 0.0).otherwise(F.col(c)))
    return out
