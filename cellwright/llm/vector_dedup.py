"""Near-duplicate vectors by collision counting over sorted projections.

Each of many tables projects every vector on random directions: the signs of some of them name a bucket, and the value
on one more is the vector's place on a line, along which the bucket is sorted.  Two vectors collide in a table
if they share the bucket and one lies in the window centred at the other.  Pairs that collide in enough tables are
verified.  The number of tables is calibrated so that a pair at the threshold passes with the asked-for probability, and the number
of sign bits grows with the table, so that buckets stay small.

Equal vectors are one class, and classes close around a leader are one ball: whatever is within half the threshold
angle of a leader is linked to all the rest of its ball.  Balls, not vectors, collide; two balls link as wholes, or not at all, where the
triangle inequality decides it, and member by member otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash
from cellwright.llm.graph import components

BUCKET = 8  # vectors a bucket holds on average
NEEDED = 2  # collisions that a candidate has
WINDOW = 1.5  # half-width of a window in deviations of the projected difference at the threshold
BALL_ROUNDS = 3
BALL_BITS = 24
BALL_DEGREES = 6.0
MARGIN = 1e-6


def calibrated(n: int, threshold: float, recall: float) -> tuple[int, int, float]:
    """Sign bits, tables and half-width of the window for n vectors."""
    bits = max(0, min(40, math.ceil(math.log2(max(n, 1) / BUCKET)))) if n > BUCKET else 0
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(WINDOW / math.sqrt(2))
    tables = NEEDED
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(NEEDED)) > 1 - recall:
        tables += 1
    return bits, tables, WINDOW * math.sqrt(2 * (1 - threshold))


@functools.lru_cache(maxsize=8)
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _codes(signs: np.ndarray) -> np.ndarray:
    return (signs * (np.int64(1) << np.arange(signs.shape[-1], dtype=np.int64))).sum(-1) if signs.shape[-1] else np.zeros(signs.shape[:-1], np.int64)


def _by_dim(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, rows, matrix for a batch of vectors."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, begin = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[begin[rows][:, None] + np.arange(dim)]


@lean
def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, k1, k2 (of the vector), unit; null for a vector that links with nothing."""
    for batch in batches:
        keys, units = [], []
        for x in batch.column(1).to_pylist():
            unit, key = None, (None, None)
            if x and all(v is not None for v in x):
                v = np.asarray(x, np.float64)
                if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                    v = v / top + 0.0  # no overflow in the norm; no negative zero
                    unit = v / math.sqrt(float(v @ v))
                    d = hashlib.blake2b((np.asarray(x, np.float64) + 0.0).tobytes(), digest_size=16).digest()
                    key = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
            keys.append(key)
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "k1", "k2", "unit"]
        )


def _ball_codes(seed: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, matrix in _by_dim(batch.column("unit")):
                part = batch.take(pa.array(rows))
                code = _codes(matrix @ directions(dim, BALL_BITS, seed) > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), dim)), pa.array(code)], names=[*part.schema.names, "dim", "code"])

    return run


def _places(bits: int, tables: int, seed: int):
    """dim, t, code, ball, place for every table."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                for dim, rows, matrix in _by_dim(part.column("unit")):
                    shown = (matrix @ directions(dim, tables * (bits + 1), seed)).reshape(len(rows), tables, bits + 1)
                    code, place = _codes(shown[..., :bits] > 0), shown[..., bits]
                    ball = part.column("ball").to_numpy()[rows]
                    n = len(rows) * tables
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim)), pa.array(np.tile(np.arange(tables), len(rows))), pa.array(code.ravel()), pa.array(np.repeat(ball, tables)), pa.array(place.ravel())], names=["dim", "t", "code", "ball", "place"]
                    )

    return run


def _collisions(window: float):
    """Pairs of balls in one bucket of which one reaches into the other's window; rows come sorted by bucket and place."""

    def pairs(keys: np.ndarray, ball: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) else []
        bounds = [0, *edges, len(ball)]
        left, right, held = [], [], 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            upto = np.searchsorted(low[a:b], high[a:b] + window, side="right")
            for i in range(b - a - 1):
                if upto[i] > i + 1:
                    other = ball[a + i + 1 : a + upto[i]]
                    left.append(np.minimum(other, ball[a + i]))
                    right.append(np.maximum(other, ball[a + i]))
                    held += len(other)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                left, right, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)], 1), np.stack([batch.column(k).to_numpy() for k in (4, 5)], 1)
            if held is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
            keys = rows[0][:, :3]
            if not len(keys):
                continue
            last = len(keys) - np.argmax(np.any(keys[::-1] != keys[-1], axis=1)) if np.any(keys != keys[-1]) else 0
            yield from pairs(keys[:last], rows[0][:last, 3], rows[1][:last, 0], rows[1][:last, 1])
            held = tuple(x[last:] for x in rows)
        if held is not None:
            yield from pairs(held[0][:, :3], held[0][:, 3], held[1][:, 0], held[1][:, 1])

    return run


def _cosines(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([float(np.dot(a, b)) if len(a) == len(b) else -1.0 for a, b in zip(x, y, strict=True)])


def _balls(classes: DataFrame, seed: int) -> DataFrame:
    """cid, ball (its leader's cid), angle to the leader, for every class."""
    cosine = F.pandas_udf(_cosines, "double")
    tight = math.cos(math.radians(BALL_DEGREES))
    state = stash(classes.select("cid", "unit", F.lit(None).cast("bigint").alias("ball"), F.lit(0.0).alias("angle")), "balls")
    for turn in range(BALL_ROUNDS):
        coded = state.filter("ball is null or ball = cid").mapInArrow(_ball_codes(seed + 1 + turn), "cid bigint, unit array<double>, ball bigint, angle double, dim bigint, code bigint")
        coded = stash(coded, "ball-codes")
        lead = coded.groupBy("dim", "code").agg(F.min(F.struct(F.col("ball").isNull().alias("late"), F.col("cid").alias("lead"))).alias("m"), F.count("*").alias("n")).filter("n > 1").select("dim", "code", F.col("m.lead").alias("lead"))
        vectors = coded.select(F.col("cid").alias("lead"), F.col("unit").alias("lead_unit"))
        near = coded.filter("ball is null").select("cid", "unit", "dim", "code").join(lead, ["dim", "code"]).filter("cid <> lead").join(vectors, "lead").withColumn("cos", cosine("unit", "lead_unit")).filter(F.col("cos") >= tight)
        new = stash(near.select("cid", F.col("lead").alias("new"), F.acos(F.least("cos", F.lit(1.0))).alias("new_angle")), "ball-members")
        own = new.select(F.col("new").alias("cid")).distinct().select("cid", F.col("cid").alias("new"), F.lit(0.0).alias("new_angle"))
        joined = state.join(new.unionByName(own), "cid", "left")
        state = stash(joined.select("cid", "unit", F.coalesce("ball", "new").alias("ball"), F.when(F.col("ball").isNull(), F.coalesce("new_angle", F.lit(0.0))).otherwise(F.col("angle")).alias("angle")), "balls")
    return state.select("cid", "unit", F.coalesce("ball", "cid").alias("ball"), "angle")


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept: links are pairs with cosine >= threshold (in doubles).

    ``recall`` is the probability that a pair right at the threshold becomes a candidate; closer pairs pass more surely,
    and no pair below the threshold is linked.  Vectors that are null, empty or zero, or hold nulls or non-finite components, link
    with nothing, as do vectors of different dimensions.  Rows are vectors of their own whatever their ids: with null or
    equal ids they link as others do, a component is named by the smallest id in it, and by null where none of its rows has one.  An empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    spread = math.acos(threshold)
    if 2 * math.radians(BALL_DEGREES) > spread:
        raise ValueError("the threshold is too near to 1 for the balls' radius")
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = stash(source.mapInArrow(_units, "vec_id bigint, k1 bigint, k2 bigint, unit array<double>").withColumn("row", F.monotonically_increasing_id()), "units")
    classes = stash(base.filter("unit is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("row").alias("cid"), F.min("vec_id").alias("least_id"), F.first("unit").alias("unit")), "vector-classes")
    bits, tables, window = calibrated(classes.count(), threshold, recall)
    state = stash(_balls(classes, seed).join(classes.select("cid", "copies"), "cid"), "vectors-in-balls")
    balls = stash(state.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight")).join(state.select(F.col("cid").alias("ball"), "unit"), "ball"), "ball-table")

    places = state.select("unit", "ball").mapInArrow(_places(bits, tables, seed), "dim bigint, t bigint, code bigint, ball bigint, place double")
    lines = places.groupBy("dim", "t", "code", "ball").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    dealt = lines.repartition("dim", "t", "code").sortWithinPartitions("dim", "t", "code", "low")
    met = dealt.mapInArrow(_collisions(window), "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= NEEDED).select("a", "b")

    cosine = F.pandas_udf(_cosines, "double")
    one = balls.select(F.col("ball").alias("a"), F.col("unit").alias("ua"), F.col("radius").alias("ra"))
    two = balls.select(F.col("ball").alias("b"), F.col("unit").alias("ub"), F.col("radius").alias("rb"))
    apart = met.join(one, "a").join(two, "b").select("a", "b", cosine("ua", "ub").alias("cos"), (F.col("ra") + F.col("rb")).alias("slack"))
    angle = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    judged = apart.withColumn("all", F.when(F.col("slack") == 0, F.col("cos") >= threshold).otherwise(angle + F.col("slack") <= spread - MARGIN))
    judged = stash(judged.withColumn("some", F.col("all") | ((F.col("slack") > 0) & (angle - F.col("slack") <= spread + MARGIN))).filter("some").select("a", "b", "all"), "ball-pairs")
    whole = judged.filter("all").select("a", "b")
    members = state.select("cid", "ball", "unit", "copies")
    mixed = judged.filter(~F.col("all"))
    left = members.select(F.col("ball").alias("a"), F.col("cid").alias("x"), F.col("unit").alias("ux"), F.col("copies").alias("wx"))
    right = members.select(F.col("ball").alias("b"), F.col("cid").alias("y"), F.col("unit").alias("uy"), F.col("copies").alias("wy"))
    single = stash(mixed.select("a", "b").join(left, "a").join(right, "b").filter(cosine("ux", "uy") >= threshold).select("a", "b", "x", "y", "wx", "wy"), "single-links")

    weights = balls.select("ball", "weight")
    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(weights.withColumnRenamed("ball", "b"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("weight").alias("around"))
    singles = single.select(F.col("x").alias("cid"), F.col("wy").alias("w")).unionByName(single.select(F.col("y").alias("cid"), F.col("wx").alias("w"))).groupBy("cid").agg(F.sum("w").alias("single"))
    merged = components(whole.unionByName(single.select("a", "b").distinct()))
    counted = state.join(weights, "ball").join(around, "ball", "left").join(singles, "cid", "left").join(merged.withColumnRenamed("v", "ball"), "ball", "left")
    counted = counted.select("cid", F.coalesce("component", "ball").alias("group"), (F.col("weight") - 1 + F.coalesce("around", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("n_links"))
    counted = stash(counted, "vector-links")
    named = classes.select("k1", "k2", "cid", "least_id").join(counted, "cid")
    least = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "group").select("k1", "k2", "n_links", "component_id")
    out = base.select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
