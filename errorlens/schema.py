"""Fixed schemas and enumerations of the log data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Log levels in rank order (TRACE lowest, FATAL highest).
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ERROR_LEVELS = ["ERROR", "FATAL"]

# Cluster grading, cluster status, answer confidence, run status.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
STATUSES = ["OPEN", "ACKNOWLEDGED", "RESOLVED", "IGNORED"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
SCAN_STATUSES = ["RUNNING", "COMPLETED", "FAILED"]

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("stack_trace", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("method_name", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("thread_name", T.StringType()),
    T.StructField("mdc_context", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
])

FRAME_TYPE = T.StructType([
    T.StructField("class_name", T.StringType()),
    T.StructField("method_name", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("native", T.BooleanType()),
])

CLUSTER_COLUMNS = [
    "cluster_id", "fingerprint", "exception_class", "message_pattern",
    "primary_file", "primary_line", "primary_method", "primary_class",
    "first_seen", "last_seen", "occurrence_count", "severity",
]

SOURCE_SCHEMA = T.StructType([
    T.StructField("root_rank", T.IntegerType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("content", T.StringType()),
])
