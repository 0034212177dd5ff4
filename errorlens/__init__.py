"""errorlens: log error analytics as Spark DataFrame operators.

The most used entry points, importable from the package root; every
operator lives in ``errorlens.functions`` (Column functions),
``errorlens.operators`` (DataFrame operators), ``errorlens.sources``,
``errorlens.streaming`` and ``errorlens.plans``.
"""

from errorlens.functions.fingerprints import cluster_id, fingerprint
from errorlens.functions.levels import at_least, has_stack_trace, is_error, normalize_level
from errorlens.functions.templates import normalize_message
from errorlens.functions.traces import exception_class, parse_frame, parse_trace
from errorlens.operators.clusters import (cluster_errors, most_recent_entry, rank_clusters,
                                          sample_entries, severity, top_clusters)
from errorlens.operators.merge import merge_similar
from errorlens.sources.logs import read_log_files, read_logs, stream_logs, write_logs

__all__ = [
    "at_least", "cluster_errors", "cluster_id", "exception_class", "fingerprint", "has_stack_trace",
    "is_error", "merge_similar", "most_recent_entry", "normalize_level", "normalize_message",
    "parse_frame", "parse_trace", "rank_clusters", "read_log_files", "read_logs", "sample_entries",
    "severity", "stream_logs", "top_clusters", "write_logs",
]
