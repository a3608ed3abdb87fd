"""Scaling, labels, samples, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, ratio

EPSILON = 2.220446049250313e-16


def standard_scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - mean) / population deviation, both of the training rows; NULL counts as 0, a deviation of 0 as 1."""
    x = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    stats = df.filter(train).agg(*(F.avg(x(c)).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(x(c)).alias(f"__s_{c}") for c in columns))
    scale = lambda c: F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*[c for c in df.columns if c not in columns], *(((x(c) - F.col(f"__m_{c}")) / scale(c)).alias(c) for c in columns))


def end_of_life(soh: DataFrame, limit: float = 0.8, near: float = 0.825, last: int = 20) -> DataFrame:
    """cell_id, life: cells that end at or above ``near`` go; those that end above the limit are extrapolated by a line of position
    on health over their last cycles, truncated; else the position of the first cycle at or below the limit."""
    w, back = ordered(["cell_id"], "cycle"), Window.partitionBy("cell_id").orderBy(F.desc("cycle"))
    rows = soh.withColumn("k", F.row_number().over(w)).withColumn("b", F.row_number().over(back))
    recent = F.col("b") <= last
    agg = rows.groupBy("cell_id").agg(
        F.max(F.when(F.col("b") == 1, F.col("soh"))).alias("end"), F.min(F.when(F.col("soh") <= limit, F.col("k"))).alias("first"),
        F.regr_slope(F.when(recent, F.col("k").cast("double")), F.when(recent, F.col("soh"))).alias("a"), F.regr_intercept(F.when(recent, F.col("k").cast("double")), F.when(recent, F.col("soh"))).alias("c"),
    )
    life = F.when((F.col("end") > limit) & (F.col("end") < near), F.floor(F.col("a") * limit + F.col("c"))).otherwise(F.col("first"))
    return agg.filter(F.col("end") < near).select("cell_id", life.cast("bigint").alias("life"))


def early_samples(features: DataFrame, lives: DataFrame, least: int, most: int) -> DataFrame:
    """cell_id, n_cycles, life: a sample for each prefix of least..min(cycles, most) cycles.  Rows stay where they are: join on cycle <= n_cycles."""
    n = features.groupBy("cell_id").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") >= least)
    return n.join(lives, "cell_id").select("cell_id", F.explode(F.sequence(F.lit(least), F.least(F.col("n"), F.lit(most)))).alias("n_cycles"), "life")


def padded_prefixes(features: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """cell_id, n_cycles, x: the prefix as an array, padded with zeros, and its mask."""
    rows = features.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cycle", F.coalesce(value, F.lit(0.0)).alias("v")))), lambda r: r["v"]).alias("all"))
    cut = rows.filter(F.size("all") >= least).withColumn("n_cycles", F.explode(F.sequence(F.lit(least), F.least(F.size("all"), F.lit(most)))))
    pad = F.array_repeat(F.lit(0.0), F.lit(most) - F.col("n_cycles"))
    return cut.select("cell_id", "n_cycles", F.concat(F.slice("all", F.lit(1), F.col("n_cycles")), pad).alias("x"), F.concat(F.array_repeat(F.lit(1.0), F.col("n_cycles")), pad).alias("mask"))


def hash_split(cells: DataFrame, seed: int = 0, shares: tuple[float, float] = (0.7, 0.1)) -> DataFrame:
    """split by the rank of a hash within each dataset: the same draw whatever the partitions."""
    w = Window.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"))), "cell_id")
    k, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("dataset"))
    train, val = F.floor(n * shares[0]), F.floor(n * shares[1])
    return cells.withColumn("split", F.when(k <= train, "train").when(k <= train + val, "val").otherwise("test"))


def inverse_frequency(rows: DataFrame, key: str) -> DataFrame:
    """weight = 1 / n and log_weight = 1 / log(n / min n + 1), n being the rows of the key."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    least = n.agg(F.min("n").alias("least"))
    return n.crossJoin(F.broadcast(least)).select(key, ratio(F.lit(1.0), F.col("n")).alias("weight"), ratio(F.lit(1.0), F.log(F.col("n") / F.col("least") + 1)).alias("log_weight"))


def density_weights(labels: DataFrame, column: str = "life", points: int = 100) -> DataFrame:
    """weight falls with the density of labels (Gaussian kernel on a grid of ``points``, Scott's width), mean 1.  Labels are binned to the grid before the kernel sum, so it costs points ** 2."""
    s = labels.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd"), F.count("*").alias("n"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    at = F.round((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (points - 1)).cast("int")
    binned = labels.crossJoin(F.broadcast(s)).withColumn("g", at)
    counts = binned.groupBy("g", "lo", "hi", "sd", "n").agg(F.count("*").alias("c"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = counts.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).groupBy("x").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("g")) * step / h, F.lit(2.0)))).alias("d"))
    joined = binned.join(grid, binned.g == grid.x)
    top = grid.agg(F.min("d").alias("dl"), F.max("d").alias("dh"))
    raw = joined.crossJoin(F.broadcast(top)).withColumn("w", F.greatest(1 - ratio(F.col("d") - F.col("dl"), F.col("dh") - F.col("dl")), F.lit(1e-6)))
    mean = raw.agg(F.avg("w").alias("mw"))
    return raw.crossJoin(F.broadcast(mean)).select(*labels.columns, (F.col("w") / F.col("mw")).alias("weight"))


def calendar(ts: str) -> list[Column]:
    """Parts of a time, each scaled to [-0.5, 0.5]."""
    t = F.col(ts)
    scaled = {"second": F.second(t) / 59, "minute": F.minute(t) / 59, "hour": F.hour(t) / 23, "day_of_week": F.weekday(t) / 6, "day_of_month": (F.dayofmonth(t) - 1) / 30, "day_of_year": (F.dayofyear(t) - 1) / 365, "month": (F.month(t) - 1) / 11, "week": (F.weekofyear(t) - 1) / 52}
    return [(c - 0.5).alias(f"{name}_of_scale") for name, c in scaled.items()]


def errors(y: str = "y", pred: str = "pred") -> list[Column]:
    """MAE, MSE, RMSE, MAPE (denominator not under machine epsilon), MSPE, and shares within 15 and 10 percent."""
    e, a = F.col(pred) - F.col(y), F.abs(F.col(y))
    near = lambda alpha: F.avg(F.when(F.abs(e) / (F.col(y) + 1e-5) <= alpha, 100.0).otherwise(0.0))
    return [F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.greatest(a, F.lit(EPSILON))).alias("mape"), F.avg(F.pow(ratio(e, F.col(y)), F.lit(2.0))).alias("mspe"), near(0.15).alias("acc_15"), near(0.10).alias("acc_10")]


def relative_errors(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """rse, and corr as sum(dx dy) / sqrt(sum(dx^2 dy^2)); means first, then deviations."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("__my"), F.avg(pred).alias("__mp"))  # a row for each key, joined back: few keys don't gather rows
    same = [df[k].eqNullSafe(means[k]) for k in keys]
    joined = df.join(means, same).select(df["*"], "__my", "__mp")
    d = joined.withColumn("__y", F.col(y) - F.col("__my")).withColumn("__p", F.col(pred) - F.col("__mp"))
    return d.groupBy(*keys).agg(
        F.sqrt(ratio(F.sum(F.pow(F.col(y) - F.col(pred), F.lit(2.0))), F.sum(F.col("__y") * F.col("__y")))).alias("rse"),
        ratio(F.sum(F.col("__y") * F.col("__p")), F.sqrt(F.sum(F.col("__y") * F.col("__y") * F.col("__p") * F.col("__p")))).alias("corr"),
    )


def lagged(rows: DataFrame, keys: list[str], order: str, value: str, n: int, width: int, name: str) -> DataFrame:
    """rows with ``name``: the value n rows before, by a whole-numbered ``order``, in series that may hold a large part of all rows.

    Series are cut into ranges of ``width`` numbers; what the first rows of a range lack comes from the last n rows of the ranges before it,
    of which there is one small row each.
    """
    cut = rows.withColumn("__b", F.floor(F.col(order) / width))
    own = ordered([*keys, "__b"], order)
    inside = cut.withColumn("__own", F.lag(value, n).over(own)).withColumn("__k", F.row_number().over(own))
    back = Window.partitionBy(*keys, "__b").orderBy(F.desc(order))
    last = cut.select(*keys, "__b", F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("x"), F.row_number().over(back).alias("r")).filter(F.col("r") <= n)
    tails = last.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list("x")).alias("t"))
    before = ordered(keys, "__b").rowsBetween(-n, -1)
    carried = tails.select(*keys, "__b", F.flatten(F.collect_list("t").over(before)).alias("__c"))
    joined = inside.join(carried, [*keys, "__b"])
    place = F.size("__c") - n + F.col("__k")
    found = F.when(F.col("__k") > n, F.col("__own")).when(place >= 1, F.get("__c", place - 1)["v"])
    return joined.withColumn(name, found).drop("__b", "__own", "__k", "__c")


def weighted_errors(weight: str, y: str = "y", pred: str = "pred") -> list[Column]:
    """MAE, MSE and MAPE with a weight for each row."""
    w, e = F.col(weight), F.col(pred) - F.col(y)
    mean = lambda x: ratio(F.sum(w * x), F.sum(w))
    return [mean(F.abs(e)).alias("mae"), mean(e * e).alias("mse"), mean(ratio(F.abs(e), F.greatest(F.abs(F.col(y)), F.lit(EPSILON)))).alias("mape")]


def multi_output_errors(outputs: list[tuple[str, str]], kinds: tuple[str, ...] = ("mae",)) -> list[Column]:
    """Of each kind (mae, mse, mape) the error of each output (y, pred) as kind_k, and as kind their mean."""
    e = lambda y, p: F.col(p) - F.col(y)
    error = {"mae": lambda y, p: F.abs(e(y, p)), "mse": lambda y, p: e(y, p) * e(y, p), "mape": lambda y, p: F.abs(e(y, p)) / F.greatest(F.abs(F.col(y)), F.lit(EPSILON))}
    out = []
    for kind in kinds:
        each = [F.avg(error[kind](y, p)) for y, p in outputs]
        out += [*(m.alias(f"{kind}_{k}") for k, m in enumerate(each)), (sum(each[1:], each[0]) / len(each)).alias(kind)]
    return out


def masked_errors(mask: str, scale: str, y: str = "y", pred: str = "pred") -> list[Column]:
    """Masked mape, smape and mase over all rows, masked ones counting as 0; a ratio over 0 is 0.  ``scale``: the row's mean absolute seasonal difference."""
    e = F.abs(F.col(pred) - F.col(y))
    over = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return [F.avg(e * F.abs(over(F.col(mask), F.col(y)))).alias("mape"), (200 * F.avg(over(e, F.abs(pred) + F.abs(y)) * F.col(mask))).alias("smape"), F.avg(e * over(F.col(mask), F.col(scale))).alias("mase")]


def forecast_summary(points: DataFrame, scales: DataFrame, minor: list[str], digits: int = 3) -> DataFrame:
    """grp, smape, mape, mase, owa of forecasts by group, the ``minor`` groups as Others, and Average.

    ``points``: grp, series, y, pred, naive; ``scales``: grp, series, scale (the mean absolute seasonal difference of the series' own past).  A group's mase is the mean over its
    series, the others over its points; Others and Average weight groups by their series.  owa is the mean of the ratios of mase and smape to the naive forecast's.
    """
    denominator = lambda p: F.when(F.abs("y") + F.abs(p) == 0, 1.0).otherwise(F.abs("y") + F.abs(p))
    smape = lambda p: 200 * F.abs(F.col(p) - F.col("y")) / denominator(p)
    mape = 100 * F.abs(F.col("pred") - F.col("y")) / F.when(F.col("y") == 0, 1.0).otherwise(F.abs("y"))
    per = points.groupBy("grp", "series").agg(
        F.count("*").alias("n"), F.sum(smape("pred")).alias("s"), F.sum(smape("naive")).alias("s0"), F.sum(mape).alias("p"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("e"), F.avg(F.abs(F.col("naive") - F.col("y"))).alias("e0")
    )
    joined = per.join(scales, ["grp", "series"])
    group = joined.groupBy("grp").agg(
        F.count("*").alias("w"), ratio(F.sum("s"), F.sum("n")).alias("smape"), ratio(F.sum("s0"), F.sum("n")).alias("smape0"), ratio(F.sum("p"), F.sum("n")).alias("mape"),
        F.avg(ratio(F.col("e"), F.col("scale"))).alias("mase"), F.avg(ratio(F.col("e0"), F.col("scale"))).alias("mase0"),
    )
    names = F.array(F.when(F.col("grp").isin(*minor), "Others").otherwise(F.col("grp")), F.lit("Average"))
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c)
    merged = group.withColumn("grp", F.explode(names)).groupBy("grp").agg(*(mean(c) for c in ("smape", "smape0", "mape", "mase", "mase0")))
    owa = (ratio(F.col("mase"), F.col("mase0")) + ratio(F.col("smape"), F.col("smape0"))) / 2
    return merged.select("grp", *(F.round(c + 1e-9, digits).alias(name) for name, c in (("smape", F.col("smape")), ("mape", F.col("mape")), ("mase", F.col("mase")), ("owa", owa))))


def sensitivity_grid(predictions: DataFrame, axes: dict[str, list[int]], keys: list[str]) -> DataFrame:
    """Mean absolute percentage errors for each combination of upper limits on the axes' columns: a row counts for all limits that it keeps within."""
    own = predictions
    for column, limits in axes.items():
        own = own.withColumn(f"{column}_limit", F.explode(F.filter(F.array(*(F.lit(k) for k in limits)), lambda k: k >= F.col(column))))  # noqa: B023  called at once
    return own.groupBy(*(f"{c}_limit" for c in axes), *keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("y")) / F.greatest(F.abs("y"), F.lit(EPSILON))).alias("mape"))


#: Nominal capacities in Ah by the beginnings of names, in this order (fixed values).
CAPACITIES = [("RWTH", 1.85), ("SNL_18650_NCA_25C_20-80", 3.2)]


def state_of_health(capacities: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, cycle, soh: a cycle's largest discharge capacity over the nominal one and the share of the charge range that is used.

    ``capacities``: cell_id, cycle, discharge_capacity_ah (samples); ``cells``: cell_id, name, nominal_capacity_ah, soc_from, soc_to.  Names in CAPACITIES have a nominal capacity of their own.
    """
    nominal = F.col("nominal_capacity_ah")
    for begin, value in reversed(CAPACITIES):
        nominal = F.when(F.col("name").startswith(begin), value).otherwise(nominal)
    top = capacities.groupBy("cell_id", "cycle").agg(F.max("discharge_capacity_ah").alias("q"))
    return top.join(cells.select("cell_id", nominal.alias("__c"), (F.col("soc_to") - F.col("soc_from")).alias("__s")), "cell_id").select("cell_id", "cycle", ratio(F.col("q") / F.col("__c"), F.col("__s")).alias("soh"))


def whole_lives(soh: DataFrame, least: float = 0.78) -> DataFrame:
    """Trajectories (cell_id, cycle, soh) of the cells whose last state of health is no less than ``least``."""
    last = soh.groupBy("cell_id").agg(F.max_by("soh", "cycle").alias("__last")).filter(F.col("__last") >= least)
    return soh.join(last, "cell_id", "left_semi")


def first_columns(df: DataFrame, n: int, with_last: bool = False) -> DataFrame:
    """The first n numeric columns, and with ``with_last`` the last one too; all numeric columns if there aren't so many."""
    numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    if with_last and n > 0:
        return df.select(*(numeric[:n] + numeric[-1:] if len(numeric) > n else numeric))
    return df.select(*(numeric[:n] if 0 < n <= len(numeric) else numeric))


def point_adjust(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """adjusted: a hit anywhere in a true segment marks the whole segment; the first row of a series is not back-filled."""
    w = ordered(keys, order)
    runs = rows.withColumn("__new", F.coalesce(F.col("gt") != F.lag("gt").over(w), F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__k", F.row_number().over(w))
    k = Window.partitionBy(*keys, "__run")
    hit = F.max(F.when((F.col("gt") == 1) & (F.col("pred") == 1), 1).otherwise(0)).over(k)
    return runs.withColumn("adjusted", F.when((F.col("gt") == 1) & (hit == 1) & (F.col("__k") > 1), 1).otherwise(F.col("pred"))).drop("__new", "__run", "__k")


def leaderboard(trials: DataFrame) -> DataFrame:
    """Per dataset and model: best trial, mean errors of the successes, failures, minutes."""
    good = F.col("status") == "success"
    return trials.groupBy("dataset", "model").agg(
        F.min_by("trial", F.when(good, F.struct("mape", "trial"))).alias("best_trial"), F.min(F.when(good, F.col("mape"))).alias("best_mape"),
        *(F.avg(F.when(good, F.col(c))).alias(f"mean_{c}") for c in ("mape", "rmse", "mae")), F.count_if(~good).alias("failures"), (F.sum("seconds") / 60).alias("minutes"),
    )
