"""lakeaudit — load, catalogue and audit lakehouse tables with Spark.

Sub-packages:

* ``sources``   — scans, typed CSV and Parquet reads/writes, file inventory;
* ``operators`` — contract gate, quality checks, profiles, medallion datasets,
  reconciliation, deadline, trail and summary checks, skew-safe ordered helpers;
* ``functions`` — column-expression helpers (money in DECIMAL, JSON, time);
* ``plans``     — multi-step work: loads and reloads, the migration flows, the
  audit run, catalog inventory, bounded SQL, the run ledger, and the
  driver-table bindings;
* ``streaming`` — bronze ingest (with the contract gate for CSV landings) and
  windowed counts with Structured Streaming.

``python -m lakeaudit`` (or ``spark-submit``) exposes the flows as a command
line; ``lakeaudit.session.build_session`` / ``configure`` apply the package's
SQL settings to a session.
"""

__version__ = "0.1.0"
