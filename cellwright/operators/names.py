"""What cells' names say: temperature, charge range, rates and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Charge and discharge rates by group number, ISU-ILCC (fixed values).
GROUP_RATES = {
    1: (0.5, 0.5), 2: (0.5, 0.5), 3: (0.5, 0.5), 4: (1, 0.5), 5: (1, 0.5), 6: (2, 0.5), 7: (2, 0.5), 8: (2, 0.5), 9: (2, 0.5), 10: (2.5, 0.5),
    12: (3, 0.5), 13: (3, 0.5), 14: (3, 0.5), 15: (3, 0.5), 16: (0.5, 0.5), 17: (1, 0.5), 18: (2.5, 0.5), 19: (2.5, 0.5), 20: (0.8, 0.5),
    21: (1.2, 0.5), 22: (1.4, 0.5), 23: (1.6, 0.5), 24: (1.8, 0.5), 25: (1.8, 0.6), 26: (1.4, 2.2), 27: (0.6, 2.4), 28: (2.4, 1.6), 29: (1.6, 1.8), 30: (0.8, 0.8),
    31: (1.2, 1), 32: (1, 1.4), 33: (2, 1.2), 34: (2.2, 2), 35: (1.825, 0.5), 36: (2.075, 0.5), 37: (0.725, 0.5), 38: (1.875, 0.5), 39: (1.475, 0.5), 40: (1.825, 1.025),
    41: (2.075, 1.775), 42: (0.725, 2.375), 43: (1.875, 2.325), 44: (0.775, 1.275), 45: (1.125, 1.725), 46: (1.225, 2.025), 47: (2.325, 1.925), 48: (2.375, 2.225), 49: (0.975, 0.675), 50: (2.425, 1.625),
    51: (2.275, 1.875), 52: (1.425, 0.875), 53: (2.025, 0.825), 54: (0.925, 1.125), 55: (1.025, 2.475), 56: (2.175, 0.975), 57: (1.775, 1.175), 58: (2.475, 0.575), 59: (1.325, 1.825), 60: (0.675, 1.325),
    61: (2.125, 1.975), 62: (1.575, 2.425), 63: (1.975, 1.675), 64: (1.175, 1.425),
}
#: Parts of MICH_EXP names with half a charge range, and with two peaks (fixed values).
HALF_RANGE = ["13R", "14C", "15H", "16R", "17C", "18H"]
TWO_PEAKS = ["01", "02", "03"]
#: Features of MICH_EXP cells that are zero at half a range (fixed values).
ZERO_AT_HALF = ["icp", "icpl_v", "icv", "icvl_v", "dvp", "dvpl_v", "dvv", "dvvl_v"]


def any_of(name: Column, parts: list[str]) -> Column:
    return F.greatest(F.lit(False), *(F.contains(name, F.lit(p)) for p in parts))


def token(name: Column, k: int) -> Column:
    """The k-th part between '_', from the end for a negative k; NULL without it."""
    parts = F.split(name, "_")
    return F.get(parts, F.lit(k) if k >= 0 else F.size(parts) + k)


def ambient_temperature(name: Column) -> Column:
    """The second part as a number, as in CALB_25_B1; NULL if it isn't one."""
    return token(name, 1).try_cast("double")


def protocol_of_name(name: Column) -> Column:
    """Of a name like SNL_18650_NCA_25C_20-80_0.5-1C_a: rates of charge and discharge, the range of charge, and the bounds of the cathode."""
    rates = F.split(F.regexp_replace(token(name, -2), ".$", ""), "-")
    cathode = token(name, 2)
    narrow = F.contains(name, F.lit("20-80"))
    is_ = lambda c: F.coalesce(cathode == c, F.lit(False))
    return F.struct(
        F.get(rates, F.lit(0)).try_cast("double").alias("charge_rate"), F.get(rates, F.lit(1)).try_cast("double").alias("discharge_rate"),
        F.when(narrow, 0.2).otherwise(0.0).alias("soc_from"), F.when(narrow, 0.8).otherwise(1.0).alias("soc_to"),
        F.when(is_("NCA"), 2.5).otherwise(2.0).alias("min_v"), F.when(is_("LFP"), 3.6).otherwise(4.2).alias("max_v"), F.when(is_("LFP"), 30.0).when(is_("NCA"), 6.0).otherwise(20.0).alias("max_a"),
    )


def expansion_metadata(name: Column) -> Column:
    """Of a MICH_EXP name: temperature (NMC_25C; 0 without one, so also for a negative one), soc (50 or 100) and peak_mode (2 with 01, 02 or 03 in the name)."""
    temperature = F.coalesce(F.regexp_extract(name, r"NMC_(\d+)C", 1).try_cast("int"), F.lit(0))
    half = any_of(name, HALF_RANGE) | (~F.contains(name, F.lit("0-100")) & F.contains(name, F.lit("50-100")))
    # '50-100' holds '0-100': the whole range is asked for first
    return F.struct(temperature.alias("temperature"), F.when(half, 50).otherwise(100).alias("soc"), F.when(any_of(name, TWO_PEAKS), 2).otherwise(1).alias("peak_mode"))


def group_rates(cells: DataFrame) -> DataFrame:
    """cells (name) with charge_rate, discharge_rate by their ISU-ILCC group; NULL for other names and unknown groups.  The table has a row a group."""
    rows = [(f"ISU-ILCC_G{k}", float(a), float(b)) for k, (a, b) in GROUP_RATES.items()]
    table = cells.sparkSession.createDataFrame(rows, "__group string, charge_rate double, discharge_rate double")
    grouped = cells.withColumn("__group", F.regexp_extract("name", r"(ISU-ILCC_G\d+)", 1))
    return grouped.join(F.broadcast(table), "__group", "left").drop("__group")


def protocol_rates(cells: DataFrame, charge: str = "charge_protocol", discharge: str = "discharge_protocol", default: float = 0.0) -> DataFrame:
    """cells with charge_rate, discharge_rate of the first entries (rate_in_c) of their protocols; ``default`` without an entry or a rate."""
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["rate_in_c"], F.lit(default))
    return cells.withColumns({"charge_rate": first(charge), "discharge_rate": first(discharge)})
