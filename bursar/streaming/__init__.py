"""Structured Streaming forms of the change jobs: issue requests against the published stock
(``issues.issue_stream``) and any batch job per micro-batch (``commands.apply_stream``)."""

from bursar.streaming.commands import apply_stream, appended_table, version_path
from bursar.streaming.issues import issue_stream

__all__ = ["apply_stream", "appended_table", "issue_stream", "version_path"]
