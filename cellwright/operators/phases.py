"""Phases and stages of a cycle.  All windows run over (keys, order): a cycle's samples, some thousands at most."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, ratio, running
from cellwright.operators.curves import local_maxima

KEYS = ["cell_id", "cycle"]


def split_phases(tel: DataFrame, keys: list[str] = KEYS, charge_above: float = 0.0, discharge_below: float = 0.0) -> DataFrame:
    """phase: charge, discharge, or rest strictly between the last charge and the first discharge, if that starts later; else NULL."""
    w = Window.partitionBy(*keys)
    charge, discharge = F.col("current_a") > charge_above, F.col("current_a") < discharge_below
    last = F.max(F.when(charge, F.col("time_s"))).over(w)
    first = F.min(F.when(discharge, F.col("time_s"))).over(w)
    rest = (first > last) & (F.col("time_s") > last) & (F.col("time_s") < first)
    return tel.withColumn("phase", F.when(charge, "charge").when(discharge, "discharge").when(rest, "rest"))


def trim_at_voltage(phased: DataFrame, limit: Column | float | None, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Discharge rows up to and with the first at or below the limit; all rows without a limit or a crossing."""
    if limit is None:
        return phased
    stop = F.min(F.when((F.col("phase") == "discharge") & (F.col("voltage_v") <= limit), F.col(order))).over(Window.partitionBy(*keys))
    return phased.withColumn("__stop", stop).filter((F.coalesce("phase", F.lit("")) != "discharge") | F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")


def islands(df: DataFrame, new: Column, w, name: str) -> DataFrame:
    """Number the runs of rows: one starts wherever ``new`` holds."""
    return df.withColumn(name, running(F.when(new, 1).otherwise(0), w))


def identify_phases(tel: DataFrame, rest: float = 0.01, step: float = 0.05, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """One row a segment: state, rows, begin, end, mean current; a segment starts with a new state or, but at rest, a current step."""
    w = ordered(keys, order)
    state = F.when(F.abs("current_a") < rest, "Rest").when(F.col("current_a") >= rest, "Charge").otherwise("Discharge")
    marked = tel.withColumn("state", state)
    new = (F.col("state") != F.lag("state").over(w)) | ((F.col("state") != "Rest") & (F.abs(F.col("current_a") - F.lag("current_a").over(w)) > step))
    return islands(marked.withColumn("__new", F.coalesce(new, F.lit(False))), F.col("__new"), w, "segment").groupBy(*keys, "segment", "state").agg(
        F.count("*").alias("n_rows"), F.min("time_s").alias("begin_s"), F.max("time_s").alias("end_s"), F.avg("current_a").alias("mean_current_a")
    )


def charge_stages(charge: DataFrame, big: float = 0.5, small: float = 0.1, dv: float = 0.01, least: int = 5, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Stages of the charge (or discharge): a boundary where the current steps, or stays while the voltage moves; stages of under ``least`` rows go.
    jump_v: the step of the voltage into the stage's first row."""
    w = ordered(keys, order)
    di, du = F.abs(F.col("current_a") - F.lag("current_a").over(w)), F.abs(F.col("voltage_v") - F.lag("voltage_v").over(w))
    marked = charge.withColumn("__new", F.coalesce((di > big) | ((di < small) & (du > dv)), F.lit(False)))
    marked = marked.withColumn("__jump", F.coalesce(du, F.lit(0.0)))
    runs = islands(marked, F.col("__new"), w, "run").groupBy(*keys, "run").agg(F.count("*").alias("n_rows"), (F.max("time_s") - F.min("time_s")).alias("duration_s"), F.avg("current_a").alias("current_a"), F.min_by("__jump", order).alias("jump_v"))
    return runs.filter(F.col("n_rows") >= least).withColumn("stage", F.row_number().over(ordered(keys, "run"))).drop("run")


def stable_phase(rows: DataFrame, share: float = 0.9, length: int = 50, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """first_stable: order of the first row that ends ``length`` rows in a row at ``share`` of the largest |current| or more."""
    w = ordered(keys, order)
    top = F.max(F.abs("current_a")).over(Window.partitionBy(*keys))
    marked = rows.withColumn("stable", (F.abs("current_a") >= share * top).cast("int"))
    full = F.sum("stable").over(w.rowsBetween(1 - length, 0)) == length
    return marked.withColumn("__full", full).groupBy(*keys).agg(F.min(F.when(F.col("__full"), F.col(order))).alias("first_stable"), F.sum("stable").alias("n_stable"))


def longest_block(tel: DataFrame, below: float = -0.005, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Rows of the contiguous discharge block with the most rows (the first on ties); time_s starts at 0."""
    w = ordered(keys, order)
    inside = tel.withColumn("__in", F.col("current_a") < below)
    numbered = islands(inside, F.coalesce(F.col("__in") != F.lag("__in").over(w), F.lit(True)), w, "__block").filter("__in")
    sized = numbered.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__block")))
    best = F.max(F.struct("__n", (-F.col("__block")).alias("b"))).over(Window.partitionBy(*keys))
    kept = sized.withColumn("__best", best).filter(F.col("__block") == -F.col("__best.b"))
    return kept.withColumn("time_s", F.col("time_s") - F.min("time_s").over(Window.partitionBy(*keys))).drop("__in", "__block", "__n", "__best")


def stable_current_rows(tel: DataFrame, charge: bool, threshold: float = 0.001, least_v: float = 2.5, share: float = 0.9, length: int = 50, least: int | None = None, gap_s: float = 30.0, drop_v: float = 0.05, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Rows of the charge (or discharge) from the first stable window on.

    Rows with a current beyond ``threshold`` and a voltage over ``least_v`` count; ``least`` of them (``length`` when charging, else 10) and a largest current over 0.1 A must be there.  A window
    of ``length`` rows is stable where every current reaches ``share`` of the largest and the voltage rises by over 1e-5 V/s (discharging: doesn't rise).  From its first row on, the phase ends before
    the first gap in time of over ``gap_s``; when charging, also before the first row more than ``drop_v`` below the highest voltage so far.
    """
    sign = 1 if charge else -1
    least = least if least is not None else (length if charge else 10)
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    current = sign * F.col("current_a")
    rows = tel.filter((current > threshold) & (F.col("voltage_v") > least_v))
    rows = rows.withColumn("__top", F.max(current).over(whole)).withColumn("__n", F.count("*").over(whole)).filter((F.col("__n") >= least) & (F.col("__top") > 0.1))
    stable = F.sum((current >= share * F.col("__top")).cast("int")).over(w.rowsBetween(1 - length, 0)) == length
    dv, dt = F.col("voltage_v") - F.lag("voltage_v", length - 1).over(w), F.col("time_s") - F.lag("time_s", length - 1).over(w)
    rises = (dt > 1e-3) & (ratio(dv, dt) > 1e-5) if charge else dv <= 0
    marked = rows.withColumn("__i", F.row_number().over(w)).withColumn("__ok", F.coalesce(stable & rises, F.lit(False)))
    marked = marked.withColumn("__dt", F.col("time_s") - F.lag("time_s").over(w))
    begun = marked.withColumn("__begin", F.min(F.when(F.col("__ok"), F.col("__i") - (length - 1))).over(whole)).filter(F.col("__i") >= F.col("__begin"))
    ended = (F.col("__i") > F.col("__begin")) & (F.col("__dt") > gap_s)
    if charge:
        ended = ended | (F.max("voltage_v").over(w) - F.col("voltage_v") > drop_v)
    cut = begun.withColumn("__ended", ended).withColumn("__cut", F.min(F.when(F.col("__ended"), F.col("__i"))).over(whole))
    kept = cut.filter(F.col("__cut").isNull() | (F.col("__i") < F.col("__cut")))
    return kept.select(*tel.columns)


def charge_stream(tel: DataFrame, least_v: float = 2.5, least_a: float = 0.01, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Charging rows from a voltage on; time_s starts at 0 at the first of them."""
    rows = tel.filter((F.col("voltage_v") >= least_v) & (F.col("current_a") > least_a))
    return rows.withColumn("time_s", F.col("time_s") - F.first("time_s").over(ordered(keys, order)))


def discharge_stream(tel: DataFrame, below: float = -0.005, after: int = 10, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """The longest contiguous discharge block from its highest voltage (unless that is its last row) to its lowest one after it (if more than ``after`` rows in).

    On equal voltages the first row counts; time_s starts at 0 at the first row that is left.
    """
    w, whole = ordered(keys, order), Window.partitionBy(*keys)

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(whole))

    def place(best: Column) -> Column:
        return F.min(F.when(F.col("voltage_v") == best, F.col("__i"))).over(whole)

    block = numbered(longest_block(tel, below, keys, order)).withColumn("__v", F.max("voltage_v").over(whole))
    head = block.withColumn("__at", place(F.col("__v"))).filter((F.col("__at") >= F.col("__n") - 1) | (F.col("__i") >= F.col("__at")))
    tail = numbered(head.drop("__i", "__n", "__v", "__at")).withColumn("__v", F.min("voltage_v").over(whole))
    cut = tail.withColumn("__at", place(F.col("__v"))).filter((F.col("__at") <= after) | (F.col("__i") <= F.col("__at")))
    return cut.withColumn("time_s", F.col("time_s") - F.first("time_s").over(w)).select(*tel.columns)


def longest_chain(rows: DataFrame, gap_s: float = 10.0, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Rows of the longest chain of segments, with their voltages stitched.

    ``order`` numbers all samples of a cycle, so a missing number splits segments; neighbouring segments less than ``gap_s`` apart chain (``stitched``), and the chain with the most rows stays,
    the first on ties.  Where a voltage jumps up between the segments of a chain, the following one is shifted down by the jump.
    """
    w = ordered(keys, order)
    split = F.coalesce(F.col(order) - F.lag(order).over(w) > 1, F.lit(False))
    own = islands(rows, split, w, "__segment")
    ends = own.groupBy(*keys, "__segment").agg(
        F.min_by("time_s", order).alias("begin_s"), F.max_by("time_s", order).alias("end_s"), F.min_by("voltage_v", order).alias("begin_v"), F.max_by("voltage_v", order).alias("end_v"), F.count("*").alias("n")
    )
    chains = stitched(ends, gap_s, keys, "__segment")
    sized = chains.withColumn("__n", F.sum("n").over(Window.partitionBy(*keys, "chain")))
    best = F.max(F.struct("__n", (-F.col("chain")).alias("c"))).over(Window.partitionBy(*keys))
    kept = sized.withColumn("__best", best).filter(F.col("chain") == -F.col("__best.c")).select(*keys, "__segment", "shift_v")
    joined = own.join(kept, [*keys, "__segment"])
    return joined.withColumn("voltage_v", F.col("voltage_v") - F.col("shift_v")).select(*rows.columns)


def stitched(segments: DataFrame, gap_s: float = 10.0, keys: list[str] = KEYS, order: str = "segment") -> DataFrame:
    """chain, shift of segments (begin_s, end_s, begin_v, end_v): neighbours within ``gap_s`` chain, and where the voltage jumps up the following
    segment is shifted down by the jump, measured against the shifted end before: a cumulative sum less its running minimum."""
    w = ordered(keys, order)
    new = F.coalesce(F.col("begin_s") - F.lag("end_s").over(w) >= gap_s, F.lit(True))
    chained = islands(segments.withColumn("__new", new), F.col("__new"), w, "chain")
    wc = ordered([*keys, "chain"], order)
    jump = F.coalesce(F.col("begin_v") - F.lag("end_v").over(wc), F.lit(0.0))
    total = chained.withColumn("__jump", jump).withColumn("__sum", running(F.col("__jump"), wc))
    floor = F.least(F.lit(0.0), F.min("__sum").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
    return total.withColumn("shift_v", F.col("__sum") - floor).drop("__new", "__jump", "__sum")


def constant_current_slice(charge: DataFrame, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Charge rows before the first at V >= max - 0.05 and I < 0.98 * target (if its index is over 10); then those near the
    lowest voltage go if over 10 rows stay.  The target is the 0.9-quantile of the current."""
    w = Window.partitionBy(*keys)
    numbered = charge.withColumn("__i", F.row_number().over(ordered(keys, order)) - 1)
    marked = numbered.withColumn("__top", F.max("voltage_v").over(w)).withColumn("__target", F.percentile("current_a", F.lit(0.9)).over(w))
    cut = F.min(F.when((F.col("voltage_v") >= F.col("__top") - 0.05) & (F.col("current_a") < 0.98 * F.col("__target")), F.col("__i"))).over(w)
    kept = marked.withColumn("__cut", cut).filter(F.col("__cut").isNull() | (F.col("__cut") <= 10) | (F.col("__i") < F.col("__cut")))
    low = F.col("voltage_v") > F.min("voltage_v").over(w) + 0.02
    judged = kept.withColumn("__ok", low).withColumn("__n", F.sum(F.col("__ok").cast("int")).over(w))
    return judged.filter((F.col("__n") <= 10) | F.col("__ok")).drop("__i", "__top", "__target", "__cut", "__ok", "__n")


def rest_by_index(tel: DataFrame, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """rest_time: extent of the rows strictly between the last charge and the first discharge row; NULL without such rows."""
    w = Window.partitionBy(*keys)
    last, first = F.max(F.when(F.col("current_a") > 0, F.col(order))).over(w), F.min(F.when(F.col("current_a") < 0, F.col(order))).over(w)
    inside = (F.col(order) > F.col("__last")) & (F.col(order) < F.col("__first"))
    marked = tel.withColumn("__last", last).withColumn("__first", first).withColumn("__t", F.when(inside, F.col("time_s")))
    return marked.groupBy(*keys).agg((F.max("__t") - F.min("__t")).alias("rest_time"))


def workload_type(tel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """0: charge first, 1: discharge first, 2: charge only, 3: discharge only, -1: neither."""
    first = tel.groupBy(*keys).agg(F.min(F.when(F.col("current_a") > 0, F.col("time_s"))).alias("c"), F.min(F.when(F.col("current_a") < 0, F.col("time_s"))).alias("d"))
    kind = F.when(F.col("c").isNull() & F.col("d").isNull(), -1).when(F.col("d").isNull(), 2).when(F.col("c").isNull(), 3).when(F.col("c") <= F.col("d"), 0).otherwise(1)
    return first.select(*keys, kind.alias("workload_type"))


def renumbered(cycles: DataFrame, reject: Column, limit: int | None = None, first_limit: bool = False, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Drop rejected cycles and number the others from 1; the limit holds after the rejection, or before it."""
    w = ordered([cell], cycle)
    if first_limit and limit:
        cycles = cycles.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= limit).drop("__k")
    kept = cycles.filter(~F.coalesce(reject, F.lit(False))).withColumn("new_cycle", F.row_number().over(w))
    return kept.filter(F.col("new_cycle") <= limit) if limit and not first_limit else kept


def _main_currents(window: int, bins: int, apart: int):
    """s: currents of cycles through a median filter (zeros beyond the ends); levels: the currents of their histograms' peaks, rising."""
    half, place = window // 2, np.arange(bins)

    def levels(counts: np.ndarray, top: float) -> list[float]:
        if not np.isfinite(top):
            return []
        kept: list[tuple[int, float]] = []
        # the higher one stays (of equal ones the later), then what is prominent
        for p, _, r in sorted(local_maxima(place, counts), key=lambda m: (-m[1], -m[0])):
            if all(abs(p - q) >= apart for q, _ in kept):
                kept.append((p, r))
        return sorted((p + 0.5) * top / bins for p, r in kept if r >= counts.sum() * 0.01)

    def run(currents: pd.Series) -> pd.DataFrame:
        size = currents.map(len).to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        padded = np.zeros(size.sum() + half * (len(size) + 1))
        at = np.arange(len(owner)) + half * (owner + 1)
        padded[at] = np.concatenate(currents.to_numpy()) if len(size) else []
        near = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
        s = np.concatenate([np.sort(near[at[k : k + 100_000] - half], 1)[:, half] for k in range(0, len(at), 100_000)] or [np.zeros(0)])
        charging = (s > 0.1) | np.isnan(s)
        some, own = s[charging], owner[charging]
        top = np.ones(len(size))
        with np.errstate(invalid="ignore"):
            np.maximum.at(top, own, some)
        top *= 1.1
        tops = [[] for _ in size]
        for k in range(0, len(size), 1000):  # histograms of so many cycles at once
            a, b = np.searchsorted(own, [k, k + 1000])
            with np.errstate(invalid="ignore"):
                share = some[a:b] / top[own[a:b]] * bins
            bin_ = np.minimum(np.nan_to_num(share), bins - 1).astype(np.int64)
            counts = np.bincount((own[a:b] - k) * bins + bin_, minlength=bins * 1000).reshape(1000, bins).astype(float)
            for c in np.unique(own[a:b]).tolist():
                tops[c] = levels(counts[c - k], top[c])
        return pd.DataFrame({"s": np.split(s, np.cumsum(size)[:-1]) if len(size) else [], "levels": tops})

    return F.pandas_udf(run, "s array<double>, levels array<double>")


def histogram_stages(rows: DataFrame, tolerance: float = 0.3, window: int = 15, bins: int = 100, apart: int = 5, gap: float = 120.0, least: float = 60.0, keys: list[str] = KEYS, order: str = "seq", voltage: str | None = None) -> DataFrame:
    """keys, stage, start_s, duration_s, current_a (and with ``voltage`` that column's mean_v and std_v over the stage's rows): constant-current charge stages around the most frequent currents.

    Currents go through a median filter (zeros beyond the ends); a histogram of those over 0.1 A has peaks, at least ``apart`` bins from each other and
    with a prominence of a hundredth of its rows.  Rows within ``tolerance`` of a peak's current (the lowest such) form runs; runs of one current, or of currents
    under 0.5 A both, with less than ``gap`` seconds in between are one stage; stages of under ``least`` seconds go.  The current is
    the mean over the rows within twice the tolerance.  A cycle without peaks has no stages.  A cycle's rows come together once, as an array.
    """
    fields = list(dict.fromkeys([order, "time_s", "current_a", *([voltage] if voltage else [])]))
    cycles = rows.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    # a missing current is a zero to the filter
    found = _main_currents(window, bins, apart)(F.transform("rows", lambda r: F.coalesce(r["current_a"], F.lit(0.0))))
    levelled = cycles.withColumn("found", found).filter(F.size("found.levels") > 0).select(*keys, "rows", "found.s", "found.levels")
    near = F.transform("s", lambda v: F.array_min(F.filter("levels", lambda x: F.abs(v - x) < tolerance)))
    labelled = levelled.select(*keys, "rows", near.alias("near"))
    begins = F.filter(F.sequence(F.lit(1), F.size("near")), lambda k: (k == 1) | ~F.get("near", k - 1).eqNullSafe(F.get("near", k - 2)))
    runs = labelled.select(*keys, "rows", "near", begins.alias("begins"))
    ends = F.transform("begins", lambda a, k: F.coalesce(F.get("begins", k + 1) - 1, F.size("near")))
    at = lambda a: F.get("rows", a - 1)["time_s"]
    part = F.zip_with("begins", ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"), at(a).alias("t0"), at(b).alias("t1"), F.get("near", a - 1).alias("c")))
    listed = runs.select(*keys, "rows", F.filter(part, lambda p: p["c"].isNotNull()).alias("parts"))

    def stitched(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (part["t0"] - last["t1"] < gap) & ((part["c"] == last["c"]) | ((part["c"] < 0.5) & (last["c"] < 0.5)))
        longer = F.struct(last["a"].alias("a"), part["b"].alias("b"), last["t0"].alias("t0"), part["t1"].alias("t1"), last["c"].alias("c"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(part)))

    merged = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 1, 1), stitched)
    segments = listed.select(*keys, "rows", F.explode(F.filter(merged, lambda p: p["t1"] - p["t0"] >= least)).alias("s"))
    inside = segments.select(*keys, "s", F.explode(F.slice("rows", F.col("s.a"), F.col("s.b") - F.col("s.a") + 1)).alias("r")).select(*keys, "s", "r.*")
    mean = F.avg(F.when(F.abs(F.col("current_a") - F.col("s.c")) < 2 * tolerance, F.col("current_a")))
    volts = [F.avg(voltage).alias("mean_v"), F.stddev_samp(voltage).alias("std_v")] if voltage else []
    own = ["mean_v", "std_v"] if voltage else []
    stages = inside.groupBy(*keys, "s").agg(mean.alias("m"), *volts).select(*keys, F.col("s.t0").alias("start_s"), (F.col("s.t1") - F.col("s.t0")).alias("duration_s"), F.coalesce("m", F.col("s.c")).alias("current_a"), *own)
    return stages.withColumn("stage", F.row_number().over(ordered(keys, "start_s"))).select(*keys, "stage", "start_s", "duration_s", "current_a", *own)
