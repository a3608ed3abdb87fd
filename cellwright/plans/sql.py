"""SQL of the fixtures, for the queries' counterparts.

Doubles are compared to 6 digits: ``round(x, 6)`` in a query's SQL gets the same small shift as in ``columns.r6``, so that a sum
right between two digits goes the same way in any order of summation.  ``ROUND`` has no shift.
"""

TELEMETRY = """telemetry AS (SELECT cell_id, CAST(floor(rn / 30) AS INT) + 1 AS cycle, CAST(rn % 30 AS INT) AS seq,
  CAST(60 * (rn % 30) AS DOUBLE) + l_linenumber AS time_s,
  CASE WHEN rn % 30 < 12 THEN CAST(0.5 AS DOUBLE) + l_quantity / 100 WHEN rn % 30 < 15 THEN CAST(0 AS DOUBLE) ELSE -(CAST(0.5 AS DOUBLE) + l_quantity / 100) END AS current_a,
  CASE WHEN rn % 30 < 12 THEN CAST(3.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (rn % 30) + l_discount WHEN rn % 30 < 15 THEN CAST(4.1 AS DOUBLE)
       ELSE CAST(4.2 AS DOUBLE) - CAST(0.08 AS DOUBLE) * ((rn % 30) - 15) - l_tax END AS voltage_v,
  25 + l_quantity / 10 AS temperature_c
FROM (SELECT l_suppkey AS cell_id, l_quantity, l_discount, l_tax, l_linenumber,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS rn
      FROM lineitem) x)"""

QD = """qd AS (SELECT cell_id, cycle, ROUND(sum(CASE WHEN current_a < 0 THEN abs(current_a) * (time_s - pt) ELSE 0 END) / 3600, 9) AS qd
  FROM (SELECT *, lag(time_s) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS pt FROM telemetry) x GROUP BY cell_id, cycle)"""

FEATURES = """raw_features AS (SELECT cell_id, cycle, ROUND(avg(temperature_c), 9) AS temp_mean,
    ROUND(sum(CASE WHEN current_a > 0 THEN voltage_v END), 9) AS chg_v, ROUND(max(voltage_v) - min(voltage_v), 9) AS dvp
  FROM telemetry GROUP BY cell_id, cycle),
features AS (SELECT cell_id, cycle, CASE WHEN keep THEN temp_mean END AS temp_mean, CASE WHEN keep THEN chg_v END AS chg_v, CASE WHEN keep THEN dvp END AS dvp
  FROM (SELECT *, NOT ((cell_id * 7 + cycle * 3) % 11 = 0 OR (cell_id % 10 = 3 AND cycle <= 12)) AS keep FROM raw_features) x)"""

LONG = """long AS (SELECT cell_id, cycle, 'temp_mean' AS feature, temp_mean AS value FROM features
  UNION ALL SELECT cell_id, cycle, 'chg_v', chg_v FROM features UNION ALL SELECT cell_id, cycle, 'dvp', dvp FROM features)"""

CELLS = """cells AS (SELECT s_suppkey AS cell_id, r_name AS dataset, CAST(0.1 AS DOUBLE) + s_suppkey % 5 / CAST(10 AS DOUBLE) AS nominal_capacity_ah
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LABELS = "life_labels AS (SELECT s_suppkey AS cell_id, 90 + (s_suppkey * 37) % 2000 AS life FROM supplier)"
SPLITS = "splits AS (SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM supplier)"
PREDICTIONS = """predictions AS (SELECT l_returnflag AS model, CAST(l_linenumber % 2 AS INT) AS seen, CAST(l_quantity AS INT) AS n_cycles,
  CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_extendedprice * (1 + l_discount - 0.05) AS DOUBLE) AS pred FROM lineitem)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def shifted(sql: str) -> str:
    return sql.replace("round(", "round(1e-9 + ")
