"""All queries of the library and their SQL."""

from cellwright.plans import cleaning, curves, cycles, ingest, learning, models, sources
from cellwright.plans.sql import shifted

PARTS = (cycles, ingest, cleaning, curves, learning, models, sources)
QUERIES: dict = {name: f for part in PARTS for name, f in part.Q.items()}
ORACLE_SQL: dict = {name: shifted(sql) for part in PARTS for name, sql in part.S.items()}
