"""Log tables derived from the driver's data.

The driver ships no log table, so one is derived from ``events`` by one SQL
statement that runs unchanged in Spark and in DuckDB (the oracle). Levels
are left raw on purpose (``WARNING``, ``info``) so level normalization is
exercised; ``mdc_context`` is the ``k=v;k=v`` text form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_VIEW_SQL = """
SELECT
  event_id AS id,
  'app-' || CAST(user_id % 4 AS string) AS app_id,
  ts AS timestamp,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 'FATAL' ELSE 'ERROR' END
       WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'info' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS level,
  'com.example.' || CASE WHEN event_id % 10 < 5 THEN 'OrderService' WHEN event_id % 10 < 7 THEN 'PaymentService' ELSE 'CacheService' END AS logger,
  CASE WHEN event_id % 10 < 5 THEN 'Error processing order ' || CAST(100000 + event_id AS string) || ' for u' || CAST(user_id AS string) || '@example.com'
       WHEN event_id % 10 < 7 THEN 'Gateway 10.0.' || CAST(user_id % 256 AS string) || '.' || CAST(event_id % 256 AS string) || ' timed out after ' || CAST(event_id % 997 AS string) || ' ms'
       WHEN event_id % 10 = 7 THEN 'Row "' || CAST(user_id AS string) || '" missing at 2024-01-' || lpad(CAST(1 + event_id % 28 AS string), 2, '0') || 'T10:30:00'
       WHEN event_id % 10 = 8 THEN 'Cache miss for key ''user_' || CAST(user_id AS string) || ''' shard ' || CAST(event_id % 3 AS string)
       ELSE 'Job ' || substr(md5(CAST(event_id AS string)), 1, 8) || '-' || substr(md5(CAST(event_id AS string)), 9, 4) || '-' || substr(md5(CAST(event_id AS string)), 13, 4) || '-' || substr(md5(CAST(event_id AS string)), 17, 4) || '-' || substr(md5(CAST(event_id AS string)), 21, 12) || ' failed in region r' || CAST(user_id % 3 AS string) END AS message,
  CASE WHEN event_type <> 'error' OR event_id % 10 >= 8 THEN NULL
       WHEN event_id % 10 < 5 THEN 'java.lang.NullPointerException: order ' || CAST(event_id AS string) || chr(10) || chr(9) || 'at com.example.OrderService.processOrder(OrderService.java:' || CAST(20 + user_id % 5 AS string) || ')' || chr(10) || chr(9) || 'at com.example.OrderController.createOrder(OrderController.java:45)' || chr(10) || chr(9) || 'at sun.reflect.NativeMethodAccessorImpl.invoke0(Native Method)' || chr(10) || 'Caused by: java.lang.IllegalStateException: Customer not loaded' || chr(10) || chr(9) || 'at com.example.Order.getCustomer(Order.java:67)' || chr(10) || chr(9) || '... 3 more' || chr(10)
       WHEN event_id % 10 < 7 THEN 'com.example.GatewayError: timeout' || chr(10) || chr(9) || 'at io.netty.channel.Channel.read(Channel.java:10)' || chr(10) || chr(9) || 'at com.example.PaymentService.charge(PaymentService.java:' || CAST(89 + user_id % 2 AS string) || ')' || chr(10)
       ELSE 'org.example.RowMissing: row ' || CAST(user_id AS string) || chr(10) || chr(9) || 'at com.example.Store.get(Store.java:7)' || chr(10) || chr(9) || 'at java.base/java.lang.Thread.run(Thread.java:840)' || chr(10) || chr(9) || 'at com.example.Main.main(Main.java:3)' || chr(10) END AS stack_trace,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 < 5 THEN 'OrderService.java' WHEN event_id % 10 < 7 THEN 'PaymentService.java' WHEN event_id % 10 = 7 THEN 'Store.java' ELSE 'CacheService.java' END AS file_name,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 < 5 THEN CAST(20 + user_id % 5 AS int) WHEN event_id % 10 < 7 THEN CAST(89 + user_id % 2 AS int) WHEN event_id % 10 = 7 THEN 7 ELSE CAST(40 + event_id % 3 AS int) END AS line_number,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 < 5 THEN 'processOrder' WHEN event_id % 10 < 7 THEN 'charge' ELSE 'get' END AS method_name,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 < 5 THEN 'com.example.OrderService' WHEN event_id % 10 < 7 THEN 'com.example.PaymentService' WHEN event_id % 10 = 7 THEN 'com.example.Store' ELSE 'com.example.CacheService' END AS class_name,
  'worker-' || CAST(event_id % 8 AS string) AS thread_name,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'traceId=' || substr(md5(CAST(event_id AS string)), 1, 16) || ';user=' || CAST(user_id AS string) END AS mdc_context
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log table as stored: raw levels, text context."""
    return spark.sql(LOG_VIEW_SQL, events=table(spark, sf_dir, "events"))


def log_view_sql(events: str = "events") -> str:
    """The same statement for DuckDB over a table or view named ``events``."""
    return LOG_VIEW_SQL.replace("{events}", events)


# ---------------------------------------------------------------- dimensions
# Small dimension and state tables, each written once as SQL that Spark and
# DuckDB both run. ``{TS}`` is the timestamp type name of the engine.

APPLICATIONS_SQL = """
SELECT app_id, name, user_id, api_key, CAST(created AS {TS}) AS created_at
FROM (VALUES
  ('app-0', 'Orders API', 'user-1', 'key-0-a1', '2023-12-01 00:00:00'),
  ('app-1', 'Payments API', 'user-1', 'key-1-b2', '2023-12-02 00:00:00'),
  ('app-2', 'Catalog API', 'user-2', 'key-2-c3', '2023-12-03 00:00:00'),
  ('app-3', 'Cache Service', 'user-2', 'key-3-d4', '2023-12-04 00:00:00'),
  ('app-4', 'Idle Service', 'user-2', 'key-4-e5', '2023-12-05 00:00:00')
) AS t(app_id, name, user_id, api_key, created)
"""

# Cut between the stored cluster state and the newer scan.
STATE_CUT = "2024-01-15 00:00:00"

# Stored cluster state: one row per (app, fingerprint) of the errors before
# the cut, with a status that the next scan must keep, plus one cluster the
# next scan will not see.
CLUSTER_STATE_SQL = """
SELECT app_id || ':' || cluster_id AS id, app_id, fingerprint, exception_class, message_pattern,
       primary_file, primary_line, primary_method, primary_class, occurrence_count, severity,
       CASE occurrence_count % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED'
            WHEN 2 THEN 'RESOLVED' ELSE 'IGNORED' END AS status,
       first_seen, last_seen, first_seen AS created_at, last_seen AS updated_at
FROM {clusters}
UNION ALL
SELECT 'app-0:ERR-00000000', 'app-0', 'legacy.RetiredError|gone', 'legacy.RetiredError',
       'retired', NULL, NULL, NULL, NULL, CAST(3 AS BIGINT), 'LOW', 'IGNORED',
       CAST('2023-12-20 00:00:00' AS {TS}), CAST('2023-12-21 00:00:00' AS {TS}),
       CAST('2023-12-20 00:00:00' AS {TS}), CAST('2023-12-21 00:00:00' AS {TS})
"""

# Two analyses per stored cluster, so "the newest analysis" matters; the
# newer one carries a patch for clusters with an even count.
ANALYSES_SQL = """
SELECT id || '#1' AS id, id AS cluster_id,
       'First look at ' || coalesce(exception_class, 'Unknown') AS explanation,
       'Unchecked input in ' || coalesce(primary_class, 'unknown code') AS root_cause,
       'Validate input' AS recommendation,
       CAST(NULL AS VARCHAR) AS patch, CAST(NULL AS VARCHAR) AS patch_file_name,
       'LOW' AS confidence, 'EXPLANATION: first look' AS raw_response,
       last_seen + INTERVAL '1' HOUR AS created_at
FROM {state}
UNION ALL
SELECT id || '#2', id,
       'Second look at ' || coalesce(exception_class, 'Unknown'),
       'Missing null check in ' || coalesce(primary_method, 'unknown method'),
       'Add a guard before use',
       CASE WHEN occurrence_count % 2 = 0 THEN '--- a/' || coalesce(primary_file, 'X.java')
            || chr(10) || '+++ b/' || coalesce(primary_file, 'X.java') || chr(10) || '@@ -1 +1 @@'
            || chr(10) || '-old' || chr(10) || '+new' || chr(10) END,
       CASE WHEN occurrence_count % 2 = 0 THEN coalesce(primary_file, 'X.java') || '.diff' END,
       'HIGH', 'EXPLANATION: second look',
       last_seen + INTERVAL '2' HOUR
FROM {state}
"""


def spark_sql(text: str) -> str:
    return text.replace("{TS}", "TIMESTAMP_NTZ").replace("AS VARCHAR", "AS STRING")


def duck_sql(text: str, **tables: str) -> str:
    out = text.replace("{TS}", "TIMESTAMP")
    for name, value in tables.items():
        out = out.replace("{" + name + "}", value)
    return out


def applications(spark: SparkSession) -> DataFrame:
    return spark.sql(spark_sql(APPLICATIONS_SQL))


def cluster_state(spark: SparkSession, logs: DataFrame) -> DataFrame:
    """Stored state from a cloud scan (per app) of the errors before the cut."""
    from pyspark.sql import functions as F
    from errorlens.operators.clusters import cluster_errors
    before = logs.filter(F.col("timestamp") < F.lit(STATE_CUT).cast(logs.schema["timestamp"].dataType))
    return spark.sql(spark_sql(CLUSTER_STATE_SQL), clusters=cluster_errors(before, mode="cloud"))


def analyses(spark: SparkSession, state: DataFrame) -> DataFrame:
    return spark.sql(spark_sql(ANALYSES_SQL), state=state)


# Model answers built from whole ``documents`` texts; the shape varies with
# the document id: all sections with a fenced diff; a mixed-case marker and
# no patch; a refusal in the patch block; no markers at all.
RESPONSES_SQL = """
SELECT doc_id AS id,
  CASE doc_id % 4
    WHEN 0 THEN 'EXPLANATION: ' || text || chr(10) || 'ROOT_CAUSE: ' || lang || ' text from ' || source
         || chr(10) || 'RECOMMENDATION: Check the input' || chr(10) || 'PATCH:' || chr(10) || '```diff'
         || chr(10) || '--- a/Doc' || CAST(doc_id AS VARCHAR) || '.java' || chr(10) || '+++ b/Doc'
         || CAST(doc_id AS VARCHAR) || '.java' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-old' || chr(10)
         || '+new' || chr(10) || '```'
    WHEN 1 THEN 'EXPLANATION: ' || text || chr(10) || 'Root_Cause: ' || source
    WHEN 2 THEN 'explanation: ' || text || chr(10) || 'PATCH: ```' || chr(10) || 'No code changes needed'
         || chr(10) || '```'
    ELSE text END AS raw_response
FROM {documents}
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_sql(RESPONSES_SQL), documents=table(spark, sf_dir, "documents"))


# Java source files derived from the locations in the log table: per class,
# a package line, an import, the class line, a field, and for every logged
# method a method whose body spans the logged lines (declared two lines
# above the first). Root 0 holds these files, root 1 an older copy of each,
# which the search must not pick. {SEQ} and {AGG} are the engine's forms of
# "one row per line number" and "lines joined in order".
GENERATED_SOURCES_SQL = """
WITH locs AS (
  SELECT class_name, method_name, min(line_number) AS lo, max(line_number) AS hi,
         greatest(5, min(line_number) - 2) AS d
  FROM {logs}
  WHERE class_name IS NOT NULL AND line_number IS NOT NULL AND method_name IS NOT NULL
  GROUP BY class_name, method_name),
per_class AS (SELECT class_name, max(hi) + 3 AS last FROM locs GROUP BY class_name),
numbered AS (SELECT class_name, last, {SEQ} AS k FROM per_class),
roles AS (
  SELECT n.class_name, n.k, n.last, m.method_name,
         CASE WHEN n.k = m.d THEN 3 WHEN n.k > m.d AND n.k <= m.hi + 1 THEN 2
              WHEN n.k = m.hi + 2 THEN 1 ELSE 0 END AS role
  FROM numbered n JOIN locs m ON n.class_name = m.class_name),
best AS (
  SELECT class_name, k, last, max(role) AS role,
         max_by(method_name, struct(role, method_name)) AS m
  FROM roles GROUP BY class_name, k, last),
texts AS (
  SELECT class_name, k,
    CASE WHEN k = 1 THEN 'package ' || regexp_extract(class_name, '^(.*)[.]', 1) || ';'
         WHEN k = 2 THEN 'import java.util.List;'
         WHEN k = 3 THEN 'public class ' || regexp_extract(class_name, '([^.]*)$', 1) || ' {'
         WHEN k = 4 THEN '    private final List<String> items = null;'
         WHEN k = last THEN '}'
         WHEN role = 3 THEN '    public int ' || m || '(String key) {'
         WHEN role = 2 THEN '        calls = calls + ' || CAST(k AS VARCHAR) || ';'
         WHEN role = 1 THEN '    }'
         ELSE '    // line ' || CAST(k AS VARCHAR) END AS t
  FROM best),
files AS (SELECT class_name, {AGG} AS content FROM texts GROUP BY class_name),
newer AS (
  SELECT 0 AS root_rank, replace(class_name, '.', '/') || '.java' AS rel_path,
         regexp_extract(class_name, '([^.]*)$', 1) || '.java' AS file_name, content || chr(10) AS content
  FROM files)
SELECT * FROM newer
UNION ALL
SELECT 1, rel_path, file_name, '// older copy' || chr(10) || content FROM newer
"""


def generated_sources_sql(engine: str, logs: str = "{logs}") -> str:
    if engine == "spark":
        seq = "explode(sequence(1, last))"
        agg = "array_join(transform(array_sort(collect_list(struct(k, t))), x -> x.t), chr(10))"
        out = GENERATED_SOURCES_SQL.replace("{SEQ}", seq).replace("{AGG}", agg).replace("AS VARCHAR", "AS STRING")
    else:
        seq = "unnest(generate_series(1, last))"
        agg = "string_agg(t, chr(10) ORDER BY k)"
        out = (GENERATED_SOURCES_SQL.replace("{SEQ}", seq).replace("{AGG}", agg)
               .replace("max_by(method_name, struct(role, method_name))", "arg_max(method_name, row(role, method_name))"))
    return out.replace("{logs}", logs)


def generated_sources(logs: DataFrame) -> DataFrame:
    """Java source files derived from the log table (see the SQL above)."""
    text = generated_sources_sql("spark").replace("{", "{{").replace("}", "}}").replace("{{logs}}", "{logs}")
    return logs.sparkSession.sql(text, logs=logs)
