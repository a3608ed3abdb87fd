"""Order statistics and rank correlation without sorting a column in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.columns import ratio
from cellwright.sources.files import written_once

#: Bits of a value that one scan tells apart.
DIGIT = 11
_SIGN = np.uint64(1 << 63)


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (values + 0.0).view(np.uint64)  # -0.0 is 0.0
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counter(prefixes: list[np.ndarray], shift: int, bits: int):
    """Counts by column, known prefix and next digit over a partition."""
    top = 64 - shift - bits  # bits that are known already

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((len(p), 1 << DIGIT), np.int64) for p in prefixes]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                if not len(prefixes[k]):
                    continue
                own = column.drop_null().to_numpy(zero_copy_only=False)
                keys = _keys(own[~np.isnan(own)])
                head = keys >> np.uint64(64 - top) if top else np.zeros(len(keys), np.uint64)
                at = np.minimum(np.searchsorted(prefixes[k], head), len(prefixes[k]) - 1)
                known = prefixes[k][at] == head
                digit = ((keys[known] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                counts[k] += np.bincount((at[known] << DIGIT) | digit, minlength=counts[k].size).reshape(counts[k].shape)
        rows = [(k, *np.nonzero(c), c[c > 0]) for k, c in enumerate(counts)]
        column = np.concatenate([np.full(len(n), k) for k, _, _, n in rows]) if rows else np.zeros(0, np.int64)
        parts = [np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, np.int64) for j in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()), *(pa.array(x, pa.int64()) for x in parts)], names=["column", "prefix", "digit", "n"])

    return run


def _digits(asked: dict[tuple[int, int], list[tuple[int, int]]], step: int):
    """The digit of every rank that is asked for among a prefix's values, and the ranks' places among that digit's values."""
    mask = (1 << step) - 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column, prefix = (int(v) for v in key)
        own = asked.get((column, prefix), [])
        digits, n = pdf["digit"].to_numpy() & mask, pdf["n"].to_numpy()
        order = np.argsort(digits)
        digits, upto = digits[order], np.cumsum(n[order])
        inside = np.array([i for _, i in own], np.int64)
        at = np.searchsorted(upto, inside, side="right")
        before = np.append(0, upto)[at]
        return pd.DataFrame({"column": column, "rank": np.array([r for r, _ in own], np.int64), "digit": digits[at], "inside": inside - before})

    return run


def quantiles(df: DataFrame, columns: list[str], shares: list[float], interpolate: bool = True) -> dict[str, list[float]]:
    """Exact quantiles of all columns at once, NULL and NaN left out; no values for a column without any.

    Interpolated between neighbours, or else the least value with at least the share of all values up to it.  Every scan counts the next digit of
    the values that may still be asked for: six scans at most, and what a task sends is bounded by columns, shares and digits, not by rows.  The driver gets a row for each
    rank after the first scan.
    """
    own = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    wanted: list[dict[int, int]] = [{} for _ in columns]  # rank -> rank among the values of its prefix
    where: list[dict[int, int]] = [{} for _ in columns]  # rank -> prefix
    sizes = [0] * len(columns)
    prefixes = [np.zeros(1, np.uint64) for _ in columns]
    shift = 64
    first = True
    while shift > 0:
        step = min(DIGIT, shift)
        shift -= step
        counted = own.mapInArrow(_counter(prefixes, shift, step), "column bigint, prefix bigint, digit bigint, n bigint").groupBy("column", "prefix", "digit").agg(F.sum("n").alias("n"))
        if first:
            found: dict[int, list[tuple[int, int]]] = {}
            for row in counted.collect():  # one prefix a column
                found.setdefault(row["column"], []).append((row["digit"] & ((1 << step) - 1), row["n"]))
            for k in range(len(columns)):
                digits = sorted(found.get(k, []))
                sizes[k] = n = sum(x for _, x in digits)
                upto = np.cumsum([x for _, x in digits])
                for share in shares if n else []:
                    at = share * (n - 1)
                    ranks = (int(at), min(int(at) + 1, n - 1)) if interpolate else (max(0, int(np.ceil(share * n - 1e-9)) - 1),)
                    for r in ranks:
                        j = int(np.searchsorted(upto, r, side="right"))
                        wanted[k][r], where[k][r] = r - int(upto[j - 1] if j else 0), digits[j][0]
            first = False
        else:
            asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for k in range(len(columns)):
                place = {int(p): j for j, p in enumerate(prefixes[k])}
                for r, inside in wanted[k].items():
                    asked.setdefault((k, place[where[k][r]]), []).append((r, inside))
            if not asked:
                break
            # a row for each rank comes back, not one for each digit
            for row in counted.groupBy("column", "prefix").applyInPandas(_digits(asked, step), "column bigint, rank bigint, digit bigint, inside bigint").collect():
                k, r = row["column"], row["rank"]
                wanted[k][r], where[k][r] = row["inside"], where[k][r] << step | row["digit"]
        for k in range(len(columns)):
            prefixes[k] = np.unique(np.array(list(where[k].values()), np.uint64))
    out = {}
    for k, c in enumerate(columns):
        value = {r: _double(p) for r, p in where[k].items()}
        out[c] = []
        for share in shares if sizes[k] else []:
            if interpolate:
                at = share * (sizes[k] - 1)
                low, high = value[int(at)], value[min(int(at) + 1, sizes[k] - 1)]
                out[c].append(low if low == high else low + (at - int(at)) * (high - low))
            else:
                out[c].append(value[max(0, int(np.ceil(share * sizes[k] - 1e-9)) - 1)])
    return out


def inversions(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Sum of products of weights over pairs with smaller x and larger y, by counting one bit of y's rank after the other."""
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order]
    w = weight[order].astype(object) if float(weight.sum()) ** 2 > 2**62 else weight[order].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1 if len(rank) else -1, -1, -1):
        order = np.argsort(rank >> (bit + 1), kind="stable")  # the order of x within equal higher bits
        r, u = rank[order], w[order]
        one = (r >> bit) & 1 == 1
        before = np.cumsum(np.where(one, u, 0)) - np.where(one, u, 0)
        group = r >> (bit + 1)
        start = np.append(True, group[1:] != group[:-1])
        base = before[start][np.cumsum(start) - 1]
        total += int(np.sum(np.where(one, 0, u * (before - base))))
    return total


#: At most so many ranges of a column: their grid, of (2 * RANGES + 1) squared counts, is all that the driver holds.
RANGES = 256


def _placed(ex: np.ndarray, ey: np.ndarray):
    """Rows (x, y, n) with their ranges: an edge's own values have an odd number, those between edges an even one, so a frequent value is alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right") for e, v in ((ex, batch.column(0).to_numpy()), (ey, batch.column(1).to_numpy()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r, pa.int32()) for r in ranges)], names=["x", "y", "n", "bx", "by"])

    return run


def discordant(counts: DataFrame, rows: int, strip: int = 1_000_000) -> int:
    """Pairs with smaller x and larger y, of a table (x, y, n) of distinct pairs and their counts.

    Both columns are cut by exact quantiles into ranges of about ``strip`` rows, or into ``RANGES`` larger ones.  Pairs of rows in different ranges of both columns are counted from the
    grid of ranges; those in one range of x, and those in one range of y but different ones of x, in a task for each range.  A range of one value has no
    pairs inside and goes nowhere.  The grid comes to the driver as Arrow columns.
    """
    parts = min(RANGES, max(1, rows // strip))
    edges = quantiles(counts, ["x", "y"], [k / parts for k in range(1, parts)], interpolate=False) if parts > 1 else {"x": [], "y": []}
    ex, ey = (np.unique(np.array(edges[c], float)) for c in ("x", "y"))
    placed = counts.select("x", "y", "n").mapInArrow(_placed(ex, ey), "x double, y double, n bigint, bx int, by int")
    cells = placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((2 * len(ex) + 1, 2 * len(ey) + 1), object)  # exact whatever the counts
    grid[cells["bx"].to_numpy(), cells["by"].to_numpy()] = cells["n"].to_pylist()
    above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid  # in the same range of x, a higher range of y
    left = np.cumsum(above, axis=0) - above  # in lower ranges of x
    total = int((grid * left).sum())

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # exact whatever their size, so as text
        return pd.DataFrame({"d": [str(inversions(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

    inside_x = placed.filter(F.col("bx") % 2 == 0).select(F.col("bx").alias("strip"), "x", "y", "n")
    inside_y = placed.filter(F.col("by") % 2 == 0).select((-1 - F.col("by")).alias("strip"), F.col("bx").cast("double").alias("x"), "y", "n")
    for row in inside_x.unionByName(inside_y).groupBy("strip").applyInPandas(count, "d string").collect():
        total += int(row["d"])
    return total


def kendall(wide: DataFrame, a: str, b: str, strip: int = 1_000_000) -> DataFrame:
    """a, b, tau (tau-b; NULL for a constant column): ties from counts, discordant pairs by ranges, n log n."""
    own = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    counts = written_once(own.groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    pairs = lambda n: F.coalesce(F.sum(n.cast("decimal(38,0)") * (n - 1) / 2), F.lit(0)).cast("double")
    n = F.col("n")
    total, distinct = (int(v or 0) for v in counts.agg(F.sum("n"), F.count("*")).first())
    tied = counts.agg(pairs(n).alias("xy"))
    for c in ("x", "y"):
        tied = tied.join(counts.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs(n).alias(c)))  # one row each
    wrong = float(discordant(counts, distinct, strip)) if distinct else 0.0
    every = total * (total - 1) / 2
    right = F.lit(every) - F.col("x") - F.col("y") + F.col("xy") - wrong
    return tied.select(F.lit(a).alias("a"), F.lit(b).alias("b"), ratio(right - wrong, F.sqrt((F.lit(every) - F.col("x")) * (F.lit(every) - F.col("y")))).alias("tau"))
