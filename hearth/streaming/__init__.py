"""Incremental (Structured Streaming) forms of the batch operators.

The source system only rewrites tables in batch; nothing here adds new
semantics. ``ingest`` applies the panel cleaning of E1 to monthly files as
they land, and ``latest`` keeps the W5 latest-row snapshot up to date.
"""

from .panel import ingest_panel_files, latest_snapshot_stream

__all__ = ["ingest_panel_files", "latest_snapshot_stream"]
