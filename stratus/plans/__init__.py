"""Presets: operators bound to concrete tables.

* :mod:`stratus.plans.driver` — the driver tables (``queries()``).
* :mod:`stratus.plans.ingest` and :mod:`stratus.plans.streams` — sources, sinks and
  the course of streaming runs on the driver tables.
* :mod:`stratus.plans.oracle`, ``oracle_io`` — independent DuckDB SQL for each of them.
* :mod:`stratus.plans.weather` — the reference's batch and streaming jobs on
  the hourly weather schema.
"""

from stratus.plans import driver, ingest, oracle, oracle_io, streams

QUERIES = driver.QUERIES | ingest.QUERIES | streams.QUERIES
SQL = oracle.SQL | oracle_io.SQL
