"""From raw samples to clean cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import median_of, ordered, ratio, running

KEYS = ["cell_id", "cycle"]


def integrate_charge(tel: DataFrame, sign: int, keys: list[str] = KEYS, order: str = "seq", unit: float = 3600.0) -> DataFrame:
    """capacity: charge so far by right rectangles over the rows whose current has the sign; carried over the others; 0 at first."""
    w = ordered(keys, order)
    step = F.when(F.col("current_a") * sign > 0, F.abs("current_a") * (F.col("time_s") - F.lag("time_s").over(w)))
    return tel.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("capacity", running(F.col("__step"), w) / unit).drop("__step")


def integrate_capped(tel: DataFrame, sign: int, cap: float, keys: list[str] = KEYS, order: str = "seq", unit: float = 3600.0) -> DataFrame:
    """Last capacity of each cycle if a step that would reach ``cap`` is not taken and leaves 0, from which later steps go on.

    The order matters, so the steps of a cycle are folded as an array.
    """
    w = ordered(keys, order)
    step = F.when(F.col("current_a") * sign > 0, F.abs("current_a") * (F.col("time_s") - F.lag("time_s").over(w)) / unit)
    steps = tel.withColumn("__s", F.coalesce(step, F.lit(0.0))).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "__s"))), lambda x: x["__s"]).alias("s"))
    fold = F.aggregate("s", F.lit(0.0), lambda q, x: F.when(x == 0, q).when(q + x < cap, q + x).otherwise(0.0))
    return steps.select(*keys, fold.alias("capacity"))


def renumber_on_change(rows: DataFrame, raw: str, keys: list[str], order: str) -> DataFrame:
    """cycle: starts at the first raw value and grows by 1 wherever the raw value differs from the row before."""
    w = ordered(keys, order)
    first = F.first(raw).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__new", F.when(F.col(raw) != F.lag(raw).over(w), 1).otherwise(0)).withColumn("cycle", first + running(F.col("__new"), w)).drop("__new")


def dense_cycles(tel: DataFrame, drop_first: int = 0, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Number the cycles that are there from 1, after dropping the first ones (formation)."""
    ranked = tel.withColumn("__rank", F.dense_rank().over(ordered([cell], cycle)) - drop_first)
    return ranked.filter(F.col("__rank") > 0).withColumn(cycle, F.col("__rank")).drop("__rank")


def cycle_boundaries(tel: DataFrame, cell: str = "cell_id", order: str = "t", run: int = 10, suppress: int = 500) -> DataFrame:
    """cell, boundary: indices at which ``run`` discharge samples in a row begin, spikes of one sample replaced by the next value;
    one within ``suppress`` samples of the last boundary doesn't count, and the first is skipped.  Candidates alone are folded."""
    w = ordered([cell], order)
    numbered = tel.withColumn("i", F.row_number().over(w) - 1)
    neg = F.col("current_a") < 0
    spike = (neg != (F.lag("current_a").over(w) < 0)) & (neg != (F.lead("current_a").over(w) < 0))
    fixed = numbered.withColumn("n", F.when(F.coalesce(spike, F.lit(False)), F.lead("current_a").over(w) < 0).otherwise(neg).cast("int"))
    ahead = F.sum("n").over(w.rowsBetween(0, run - 1)) == run
    starts = fixed.withColumn("b", ahead & (F.coalesce(F.lag("n").over(w), F.lit(0)) == 0)).filter("b")
    # a candidate within reach of none before it is kept whatever came earlier, so each stretch of near ones is walked on its own
    far = F.coalesce(F.col("i") - F.lag("i").over(ordered([cell], "i")) > suppress, F.lit(True))
    runs = starts.select(cell, "i", far.alias("far")).withColumn("run", F.sum(F.col("far").cast("int")).over(ordered([cell], "i")))
    listed = runs.groupBy(cell, "run").agg(F.array_sort(F.collect_list("i")).alias("c"))
    step = lambda a, x: F.when(x - a["last"] > suppress, F.struct(x.alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    begin = F.struct(F.get("c", F.lit(0)).alias("last"), F.slice("c", 1, 1).alias("kept"))
    kept = listed.select(cell, F.explode(F.aggregate("c", begin, step, lambda a: a["kept"])).alias("boundary"))
    return kept.withColumn("__k", F.row_number().over(ordered([cell], "boundary"))).filter("__k > 1").drop("__k")


def drop_time_anomalies(rows: DataFrame, most: float = 1e5, keys: list[str] = KEYS, order: str = "seq", time: str = "time_s") -> DataFrame:
    """keys, order of rows that stay: one goes if its time is over ``most`` after the last row that stayed."""
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(time).cast("double").alias("t")))).alias("a"))

    def kept(orders: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for own, values in zip(orders, times, strict=True):
            last, left = None, []
            for o, t in zip(own, values, strict=True):
                if last is None or t - last <= most:
                    last = t
                    left.append(int(o))
            out.append(left)
        return pd.Series(out)

    walk = F.pandas_udf(kept, "array<bigint>")  # what stays depends on what stayed before
    return arrays.select(*keys, F.explode(walk("a.o", "a.t")).alias(order))


def dedupe_times(rows: DataFrame, keys: list[str], time: str, source: str) -> DataFrame:
    """The first row (by ``source``) of each time."""
    return rows.withColumn("__k", F.row_number().over(ordered([*keys, time], source))).filter("__k = 1").drop("__k")


def isolated_abnormal(cycles: DataFrame, value: str = "qd", tolerance: float = 0.05, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Drop cycles off both the median of the 5 before and of the 5 from themselves on; the first and last 5 stay."""
    w = ordered([cell], cycle)
    before, after = median_of(F.col(value), w, -5, -1), median_of(F.col(value), w, 0, 4)
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(cell))
    bad = (F.abs(F.col(value) - before) > tolerance) & (F.abs(F.col(value) - after) > tolerance) & (i >= 5) & (i < n - 5)
    return cycles.withColumn("__bad", F.coalesce(bad, F.lit(False))).filter("not __bad").drop("__bad")


def median_filter_outliers(cycles: DataFrame, width: int = 21, factor: float = 3.0, least: float = 0.1, value: str = "qd", cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Keep |x - m| < factor * median(|x - m|) and x > least; m is the median over ``width`` rows, with zeros beyond the ends."""
    w, half = ordered([cell], cycle), width // 2
    around = F.collect_list(value).over(w.rowsBetween(-half, half))
    padded = F.array_sort(F.concat(around, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(around))))
    marked = cycles.withColumn("__d", F.abs(F.col(value) - F.get(padded, F.lit(half))))
    mad = F.percentile("__d", F.lit(0.5)).over(Window.partitionBy(cell))
    return marked.withColumn("__m", mad).filter((F.col("__d") < factor * F.col("__m")) & (F.col(value) > least)).drop("__d", "__m")


def neighbour_distance(value: Column, w, s: int) -> Column:
    """The smaller distance to the rows s before and s behind; a missing side counts as infinite, NULL without either."""
    return F.least(F.abs(value - F.lag(value, s).over(w)), F.abs(value - F.lead(value, s).over(w)))


def shift_outliers(cycles: DataFrame, factor: float = 10.0, value: str = "qd", cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """outlier: for a shift of 1 or 2 rows, the distance to the nearer neighbour is over factor * the median of the positive distances."""
    w, k = ordered([cell], cycle), Window.partitionBy(cell)
    d = {s: neighbour_distance(F.col(value), w, s) for s in (1, 2)}
    with_d = cycles.select("*", *(d[s].alias(f"__d{s}") for s in d))
    flag = [F.col(f"__d{s}") > factor * F.percentile(F.when(F.col(f"__d{s}") > 0, F.col(f"__d{s}")), F.lit(0.5)).over(k) for s in d]
    return with_d.withColumn("outlier", F.coalesce(flag[0], F.lit(False)) | F.coalesce(flag[1], F.lit(False))).drop("__d1", "__d2")


def hampel_outliers(cycles: DataFrame, factor: float = 3.0, value: str = "qd", cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """outlier: the distance to the nearer neighbour is over factor * MAD from its median, for a shift of 1 or 2 rows."""
    w, k = ordered([cell], cycle), Window.partitionBy(cell)
    out = cycles.select("*", *(neighbour_distance(F.col(value), w, s).alias(f"__d{s}") for s in (1, 2)))
    for s in (1, 2):
        out = out.withColumn(f"__o{s}", F.abs(F.col(f"__d{s}") - F.percentile(f"__d{s}", F.lit(0.5)).over(k)))
    flag = [F.coalesce(F.col(f"__o{s}") > factor * F.percentile(f"__o{s}", F.lit(0.5)).over(k), F.lit(False)) for s in (1, 2)]
    return out.withColumn("outlier", flag[0] | flag[1]).drop("__d1", "__d2", "__o1", "__o2")


def missing_cycles(cycles: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Every number from 1 to a cell's last cycle that is not there."""
    full = cycles.groupBy(cell).agg(F.max(cycle).alias("__n")).select(cell, F.explode(F.sequence(F.lit(1), "__n")).alias(cycle))
    return full.join(cycles.select(cell, cycle), [cell, cycle], "left_anti")


def as_of_cycles(marked: DataFrame, cell: str = "cell_id", cycle: str = "cycle", valid: str = "valid") -> DataFrame:
    """source_cycle: a cycle itself if valid, else the last valid one before, else the first valid one behind."""
    w = ordered([cell], cycle)
    own = F.when(F.col(valid), F.col(cycle))
    back = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    forward = F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("source_cycle", F.coalesce(back, forward))


def impute_cycles(tel: DataFrame, bad: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Telemetry in which bad and missing cycles are copies of the nearest valid one."""
    there = tel.select(cell, cycle).distinct()
    marked = there.join(bad.select(cell, cycle, F.lit(True).alias("__bad")).distinct(), [cell, cycle], "full").select(cell, cycle, F.col("__bad").isNull().alias("valid"))
    source = as_of_cycles(marked, cell, cycle).filter(F.col("source_cycle").isNotNull()).select(F.col(cell).alias("__cell"), F.col(cycle).alias("__cycle"), "source_cycle")
    joined = tel.join(source, (F.col(cell) == F.col("__cell")) & (F.col(cycle) == F.col("source_cycle")))
    return joined.withColumn(cycle, F.col("__cycle")).drop("__cell", "__cycle", "source_cycle")


def drop_singletons(tel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Drop cycles of one sample."""
    return tel.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def within_capacity(tel: DataFrame, capacity: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    """Samples of the cycles whose capacity (qd) is in [low, high]."""
    return tel.join(capacity.filter(F.col("qd").between(low, high)).select(*keys), keys, "left_semi")


def exclude_by_tests(cycles: DataFrame, tests: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Cycles (cycle, start_s) less those that reference tests (test_s) fall before.

    Walking both in order, a test before the current cycle's start excludes it and is used up: test k excludes the k-th of the cycles it can still
    reach, so its cycle's rank is r(k) = max(first cycle behind test k, r(k - 1) + 1), a running maximum of first(k) - k.
    """
    ranked = cycles.withColumn("rank", F.row_number().over(ordered([cell], "cycle")))
    after = tests.join(ranked.select(cell, "start_s", "rank"), cell).filter("start_s > test_s").groupBy(cell, "test_s").agg(F.min("rank").alias("first"))
    numbered = after.withColumn("k", F.row_number().over(ordered([cell], "test_s")))
    top = F.max(F.col("first") - F.col("k")).over(ordered([cell], "k").rowsBetween(Window.unboundedPreceding, 0))
    gone = numbered.select(cell, (top + F.col("k")).alias("rank"))
    return ranked.join(gone, [cell, "rank"], "left_anti").drop("rank")


def by_first_current(tel: DataFrame, low: float, high: float, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Samples of the cycles whose first current lies in (low, high)."""
    first = tel.groupBy(*keys).agg(F.min_by("current_a", order).alias("i"))
    return tel.join(first.filter((F.col("i") > low) & (F.col("i") < high)).select(*keys), keys, "left_semi")


def zero_other_phase(tel: DataFrame) -> DataFrame:
    """Drop -0.001 < I < 0; discharge capacity is 0 where I >= 0, charge capacity where I < 0."""
    kept = tel.filter(~((F.col("current_a") > -0.001) & (F.col("current_a") < 0)))
    return kept.withColumn("qd", F.when(F.col("current_a") >= 0, 0.0).otherwise(F.col("qd"))).withColumn("qc", F.when(F.col("current_a") < 0, 0.0).otherwise(F.col("qc")))


def skipped_cycles(tel: DataFrame, skips: DataFrame, cell: str = "cell_id", cycle: str = "cycle", minutes: str | None = "time_s") -> DataFrame:
    """tel without one bad cycle (``skips``: cell, skip) of some cells, later cycles of which move up by one; the column ``minutes`` becomes seconds.

    A cell has one skip at most; ``skips`` is a table of named cells and is broadcast.
    """
    one = skips.select(F.col(cell).alias("__cell"), F.col("skip").alias("__skip"))
    kept = tel.join(F.broadcast(one), F.col(cell) == F.col("__cell"), "left").filter(F.col("__skip").isNull() | (F.col(cycle) != F.col("__skip")))
    moved = kept.withColumn(cycle, F.when(F.col(cycle) > F.col("__skip"), F.col(cycle) - 1).otherwise(F.col(cycle)))
    timed = moved.withColumn(minutes, F.col(minutes) * 60) if minutes else moved
    return timed.select(*tel.columns)


def without_partial_end(tel: DataFrame, whole: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """tel up to each cell's number of whole cycles (``whole``: cell, n_whole); cells that aren't listed lose their last cycle, which may be cut short."""
    last = tel.groupBy(cell).agg(F.max(cycle).alias("__last")).join(whole.select(cell, "n_whole"), cell, "left").select(F.col(cell).alias("__cell"), F.coalesce("n_whole", F.col("__last") - 1).alias("__most"))
    return tel.join(last, tel[cell] == F.col("__cell")).filter(F.col(cycle) <= F.col("__most")).select(*tel.columns)


def merge_continued(tel: DataFrame, mapping: DataFrame, dropped: DataFrame) -> DataFrame:
    """Append the cycles of continuing cells (from_cell -> to_cell, offset) to the cells they continue; listed cells go."""
    kept = tel.join(dropped.select("cell_id"), "cell_id", "left_anti")
    moved = kept.join(mapping, kept.cell_id == mapping.from_cell).withColumn("cycle", F.col("cycle") + F.col("offset")).withColumn("cell_id", F.col("to_cell")).select(*tel.columns)
    return kept.join(mapping.select(F.col("from_cell").alias("cell_id")), "cell_id", "left_anti").unionByName(moved)


def seconds(clock: Column) -> Column:
    """HH:MM:SS as seconds; '-' and what isn't a time as 0."""
    p = F.split(clock, ":")
    n = lambda k: F.try_to_number(F.get(p, F.lit(k)), F.lit("999")).cast("double")
    return F.when(F.size(p) == 3, F.coalesce(n(0) * 3600 + n(1) * 60 + n(2), F.lit(0.0))).otherwise(0.0)


def elapsed(rows: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """elapsed_s: numbers over 1e11 are nanoseconds; the first time is 0."""
    w = ordered(keys, order)
    value = F.when(F.col(time) > 1e11, F.col(time) / 1e9).otherwise(F.col(time).cast("double"))
    return rows.withColumn("elapsed_s", value - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def charge_policy(text: Column) -> Column:
    """'5.4C(80%)-3.6C' -> first rate, percent, second rate."""
    number = lambda k: F.regexp_extract(text, r"([0-9.]+)C\(([0-9.]+)%\)-([0-9.]+)C", k).try_cast("double")
    return F.struct(number(1).alias("rate_1"), number(2).alias("percent"), number(3).alias("rate_2"))


def soc_window(first_cycle: DataFrame, capacity: float, keys: list[str] = KEYS) -> DataFrame:
    """soc_start = 1 - min(1, max qc / C), soc_end = 1 - max qd / C, 1 if that is over 1."""
    agg = first_cycle.groupBy(*keys).agg(F.max("qc").alias("c"), F.max("qd").alias("d"))
    end = 1 - ratio(F.col("d"), F.lit(capacity))
    return agg.select(*keys, (1 - F.least(F.lit(1.0), ratio(F.col("c"), F.lit(capacity)))).alias("soc_start"), F.when(end > 1, 1.0).otherwise(end).alias("soc_end"))


def repair_negative(rows: DataFrame, check: list[str], columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Rows with a negative value in a checked column become NULL in all columns, then take the next row's values."""
    bad = F.greatest(F.lit(0), *(F.coalesce((F.col(c) < 0).cast("int"), F.lit(0)) for c in check)) == 1
    w = ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("__bad", bad).select(*[c for c in rows.columns if c not in columns], *(F.first(F.when(~F.col("__bad"), F.col(c)), True).over(w).alias(c) for c in columns))
