"""Rows of stable phases, streams and chains against loops over a cycle's samples."""

import random

import pytest
from pyspark.sql import functions as F

from cellwright.operators import phases

COLUMNS = "cell_id bigint, cycle int, seq int, time_s double, current_a double, voltage_v double"


def samples(seed, n, charge):
    """Mostly steady, with dips of the current, gaps in time and steps of the voltage both ways."""
    rng = random.Random(seed)
    t, v, out = 0.0, 2.4 if charge else 4.2, []
    for k in range(n):
        t += 40.0 if rng.random() < 0.02 else 5.0
        v += (1 if charge else -1) * 0.02 + (rng.choice([-0.1, 0.1]) if rng.random() < 0.05 else 0)
        i = rng.choice([1.0, 1.0, 0.98, 0.95]) if rng.random() < 0.93 else rng.choice([0.5, 0.0, -0.2])
        out.append((1, seed, k, t, round(i if charge else -i, 4), round(v, 4)))
    return out


def cycles(charge):
    return [samples(seed, n, charge) for seed, n in enumerate([0, 3, 12, 30, 60, 80, 100, 120, 150, 200] * 3)]


def stable_loop(rows, charge, length, share=0.9, gap=30.0, drop=0.05):
    sign = 1 if charge else -1
    rows = [r for r in rows if sign * r[4] > 0.001 and r[5] > 2.5]
    if len(rows) < (length if charge else 10) or max(sign * r[4] for r in rows) <= 0.1:
        return []
    top = max(sign * r[4] for r in rows)
    for k in range(len(rows) - length + 1):
        part = rows[k : k + length]
        if any(sign * r[4] < share * top for r in part):
            continue
        dv, dt = part[-1][5] - part[0][5], part[-1][3] - part[0][3]
        if (charge and (dt <= 1e-3 or dv / dt <= 1e-5)) or (not charge and dv > 0):
            continue
        out = []
        for r in rows[k:]:
            if out and r[3] - out[-1][3] > gap:
                break
            if charge and max([r[5], *(x[5] for x in out)]) - r[5] > drop:
                break
            out.append(r)
        return out
    return []


@pytest.mark.parametrize("charge", [True, False])
def test_stable_rows_equal_a_loop(spark, charge):
    own = cycles(charge)
    df = spark.createDataFrame([r for c in own for r in c], COLUMNS).repartition(3)
    got = sorted(map(tuple, phases.stable_current_rows(df, charge, length=15).collect()))
    want = sorted(r for c in own for r in stable_loop(c, charge, 15))
    assert got == want and len({r[1] for r in want}) > 8 and len(want) < sum(map(len, own)) / 2


def discharge_loop(rows, below, after):
    blocks, last = [], None
    for r in rows:
        if r[4] < below:
            if last is None or r[2] != last + 1:
                blocks.append([])
            blocks[-1].append(r)
            last = r[2]
    if not blocks:
        return []
    own = max(blocks, key=len)
    volts = [r[5] for r in own]
    top = volts.index(max(volts))
    if top < len(own) - 1:
        own = own[top:]
    volts = [r[5] for r in own]
    low = volts.index(min(volts))
    if low > after:
        own = own[: low + 1]
    return [(*r[:3], r[3] - own[0][3], *r[4:]) for r in own]


@pytest.mark.parametrize("after", [10, 2])
def test_discharge_stream_equals_a_loop(spark, after):
    own = cycles(False)
    df = spark.createDataFrame([r for c in own for r in c], COLUMNS).repartition(3)
    got = sorted(map(tuple, phases.discharge_stream(df, after=after).collect()))
    want = sorted(r for c in own for r in discharge_loop(c, -0.005, after))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_charge_stream_begins_at_zero(spark):
    own = cycles(True)
    got = phases.charge_stream(spark.createDataFrame([r for c in own for r in c], COLUMNS)).collect()
    want = []
    for c in own:
        kept = [r for r in c if r[5] >= 2.5 and r[4] > 0.01]
        want += [(*r[:3], r[3] - kept[0][3]) for r in kept]
    assert sorted(tuple(r)[:3] for r in got) == sorted(r[:3] for r in want)
    assert [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in sorted(want)])


def chain_loop(rows, gap):
    segments = []
    for r in rows:
        if segments and r[2] == segments[-1][-1][2] + 1:
            segments[-1].append(list(r))
        else:
            segments.append([list(r)])
    chains = []
    for k, s in enumerate(segments):
        if k and s[0][3] - segments[k - 1][-1][3] < gap:
            jump = s[0][5] - segments[k - 1][-1][5]
            if jump > 0:
                for r in s:
                    r[5] -= jump
            chains[-1] += s
        else:
            chains.append(list(s))
    return max(chains, key=len) if chains else []


def test_longest_chain_equals_a_loop(spark):
    own = [[r for r in c if r[4] < -0.5] for c in cycles(False)]
    df = spark.createDataFrame([r for c in own for r in c], COLUMNS).repartition(3)
    got = sorted(map(tuple, phases.longest_chain(df, gap_s=12.0).collect()))
    want = sorted(tuple(r) for c in own for r in chain_loop(c, 12.0))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert any(abs(a[5] - b[5]) > 0.01 for a, b in zip(want, sorted(r for c in own for r in c if r[:3] in {tuple(x[:3]) for x in want}), strict=True))


def test_no_rows_and_null_values(spark):
    empty = spark.createDataFrame([], COLUMNS)
    nulls = spark.createDataFrame([(1, 1, k, None, None, None) for k in range(60)], COLUMNS)
    for df in (empty, nulls):
        assert phases.stable_current_rows(df, True).count() == phases.stable_current_rows(df, False).count() == 0
        assert phases.discharge_stream(df).count() == phases.charge_stream(df).count() == 0
    assert phases.longest_chain(empty).count() == 0 and phases.longest_chain(nulls).filter(F.col("voltage_v").isNotNull()).count() == 0


def test_a_task_holds_a_bounded_number_of_line_items(spark, sf, monkeypatch):
    """Tasks grow in number with the table, whatever number of partitions the session has; the rows are the same."""
    from cellwright.plans.cycles import ph3
    from cellwright.sources import fixtures

    assert [fixtures.task_count(n, 12) for n in (0, 6_000, 600_000, 36_000_000)] == [1, 1, 12, 72]
    whole = sorted(map(tuple, ph3(spark, sf).collect()))
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = ph3(spark, sf)
        assert found.rdd.getNumPartitions() == 12 and sorted(map(tuple, found.collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stages_need_a_cycles_rows_once(spark, capsys):
    """One grouping by cycle, no joins; missing currents are zeros to the filter, ones that are no numbers give no stages."""
    rows = [(cell, 1, k, 20.0 * k, 2.0 if k < 20 else 1.0) for cell in range(4) for k in range(40)]
    odd = {(1, 30): None, (2, 30): float("nan"), (3, 30): float("inf")}
    rows = [(*r[:4], odd.get((r[0], r[2]), r[4])) for r in rows] + [(None, 1, k, 20.0 * k, 2.0) for k in range(40)] + [(5, 1, k, 20.0 * k, float("nan")) for k in range(40)]
    df = spark.createDataFrame(rows, "cell_id bigint, cycle int, seq int, time_s double, current_a double")
    stages = phases.histogram_stages(df, window=5)
    got = sorted((r["cell_id"], r["stage"], r["start_s"], r["duration_s"], round(r["current_a"], 6)) for r in stages.collect())
    assert got == [(cell, *s) for cell in range(4) for s in ((1, 0.0, 380.0, 2.0), (2, 400.0, 380.0, 1.0))]
    stages.explain()
    assert "Join" not in capsys.readouterr().out
