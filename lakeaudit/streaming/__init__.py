"""Structured Streaming jobs: bronze ingest and windowed event counts."""
from lakeaudit.streaming.bronze import (  # noqa: F401
    bronze_ingest,
    dedupe_events,
    file_stream,
    gated_csv_ingest,
    gated_sink_parts,
    run_available_now,
    window_counts,
    windowed_ingest,
)
