"""Prompt and answer tables (J5, L1-L5): batch inference over clusters.

Prompts are built with ``concat`` from joined columns, one row per cluster;
the model call is a caller-supplied function run by ``mapInPandas`` over
Arrow batches of a repartitioned prompt table. No HTTP client lives here.
Template wording is our own; the fields and defaults follow the reference.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errorlens.functions.fingerprints import location_key
from errorlens.functions.levels import has_stack_trace, is_error
from errorlens.operators.clusters import fetch_rows
from errorlens.operators.sizes import broadcast_if_small, is_small
from errorlens.session import checkpoint

NO_TRACE = "No stack trace available"
NO_CODE = "Source code not available"


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")))


def _anchors(patterns: DataFrame, rows: DataFrame, lengths: list[int]) -> DataFrame:
    """For each pattern with a literal piece: the run of its longest piece
    (of three characters, or the whole piece) that fewest rows of its
    application hold."""
    each = None
    for n in lengths:
        own = patterns.filter(F.col("_n") == n).select("app_id", "fingerprint", F.explode(_grams(F.col("_piece"), n)).alias("gram"))
        each = own if each is None else each.unionByName(own)
    each = checkpoint(each)
    held = rows.select("app_id", F.explode(F.concat(*[_grams(F.col("_low"), n) for n in lengths])).alias("gram"))
    counts = (held.join(broadcast_if_small(each.select("app_id", "gram").distinct()), ["app_id", "gram"])
              .groupBy("app_id", "gram").agg(F.count(F.lit(1)).alias("_rows")))
    rarest = F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("rows"), "gram"))
    return (each.join(counts, ["app_id", "gram"], "left").groupBy("app_id", "fingerprint").agg(rarest.alias("_a"))
            .select("app_id", "fingerprint", F.col("_a.gram").alias("gram")))


def stored_pattern(prefix: int | None = None, tokens_as_wildcards: bool = False) -> Column:
    """The LIKE pattern of a cluster's ``message_pattern``, without the
    ``%`` around it."""
    pattern = F.coalesce("message_pattern", F.lit(""))
    if tokens_as_wildcards:
        pattern = F.regexp_replace(pattern, "<[A-Z]+>", "%")
    return pattern if prefix is None else F.substring(pattern, 1, prefix)


def sample_logs_by_pattern(clusters: DataFrame, logs: DataFrame, k: int = 3, prefix: int | None = None,
                           tokens_as_wildcards: bool = False, salt: int = 64) -> DataFrame:
    """For each cluster, the newest ``k`` error rows of its application
    whose message contains the cluster's pattern, case ignored, ``%`` and
    ``_`` in the pattern acting as wildcards (every other char is literal).

    ``prefix=50`` uses the first 50 chars of the pattern only, as the hosted
    form does; ``tokens_as_wildcards`` lets the tokens of a template
    (``<ID>``) match any text. A null or empty pattern matches every row.

    Rows and patterns meet on (application, gram): the rarest run of three
    characters of a pattern's longest literal piece, which every match
    holds; then LIKE decides. Where the patterns' measured bytes fit a broadcast
    the log isn't shuffled; else the pairs of id and gram are, and the messages
    once. Traces are fetched for the rows taken only. ``id`` is the log's key. Patterns without a literal piece take the newest
    rows of their application. The newest ``k`` are taken per cluster and
    salt first, then per cluster, so a pattern matching a third of all rows
    is not ranked in one task."""
    pattern = stored_pattern(prefix, tokens_as_wildcards)
    # fresh column ids on both sides: the clusters usually derive from the same log table
    c = checkpoint(clusters.select(*[F.col(x).alias(x) for x in ("app_id", "cluster_id", "fingerprint")],
                                   pattern.alias("_pattern")))
    longest = F.array_max(F.transform(F.split(F.lower("_pattern"), "[%_]"),
                                      lambda x: F.struct(F.length(x).alias("n"), x.alias("piece"))))
    c = c.select("*", longest.alias("_longest"),
                 F.concat(F.lit("%"), F.replace(F.col("_pattern"), F.lit("!"), F.lit("!!")), F.lit("%")).alias("_like"))
    c = checkpoint(c.select("app_id", "cluster_id", "fingerprint", "_like", F.col("_longest.piece").alias("_piece"),
                            F.least(F.col("_longest.n"), F.lit(GRAM)).alias("_n")))
    e = logs.filter(is_error("level") & F.col("message").isNotNull()).select(
        *[F.col(x).alias(x) for x in ("app_id", "id", "timestamp", "message")], F.lower("message").alias("_low"))
    names = ["app_id", "fingerprint", "cluster_id", "id", "timestamp"]
    lengths = sorted(r[0] for r in c.select("_n").distinct().collect() if r[0])
    hits = None
    if lengths:
        anchors = checkpoint(_anchors(c, e, lengths))
        told = checkpoint(c.join(anchors, ["app_id", "fingerprint"]).select("app_id", "fingerprint", "cluster_id", "_like", "gram"))
        grams = F.explode(F.concat(*[_grams(F.col("_low"), n) for n in lengths])).alias("gram")
        if is_small(told):
            met = e.select("*", grams).join(F.broadcast(told), ["app_id", "gram"])
        else:
            met = (e.select("app_id", "id", grams).join(told, ["app_id", "gram"])
                   .join(e.drop("app_id", "_low"), "id"))
        hits = met.filter(F.expr("message ILIKE _like ESCAPE '!'")).select(*names)
    # without a literal piece: the newest rows of the application
    free = c.filter(F.col("_n") == 0).select("app_id", "fingerprint", "cluster_id", "_like")
    if free.limit(1).count():
        some = e.join(free.select("app_id").distinct(), "app_id", "left_semi")
        # a pattern of m "_" asks for a message of m chars: kept to those, per m
        wanted = free.withColumn("_m", F.length(F.regexp_replace("_like", "%", "")))
        sizes = wanted.select("app_id", "_m").distinct()
        fits = some.join(sizes, "app_id").filter(F.length("message") >= F.col("_m"))
        newest = [F.desc("timestamp"), F.desc("id")]
        part = Window.partitionBy("app_id", "_m", F.pmod(F.xxhash64("id"), F.lit(salt))).orderBy(*newest)
        whole = Window.partitionBy("app_id", "_m").orderBy(*newest)
        few = fits.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
        few = few.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= k)
        taken = few.join(wanted, ["app_id", "_m"]).select(*names)
        hits = taken if hits is None else hits.unionByName(taken)
    if hits is None:  # no clusters
        hits = e.limit(0).select("*", F.lit("").alias("fingerprint"), F.lit("").alias("cluster_id")).select(*names)
    order = [F.desc("timestamp"), F.desc("id")]
    w1 = Window.partitionBy("app_id", "fingerprint", F.pmod(F.xxhash64("id"), F.lit(salt))).orderBy(*order)
    w2 = Window.partitionBy("app_id", "fingerprint").orderBy(*order)
    first = hits.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r")
    taken = first.withColumn("sample_rank", F.row_number().over(w2)).filter(F.col("sample_rank") <= k).drop("_r")
    texts = logs.filter(is_error("level")).select(*[F.col(x).alias(x) for x in ("id", "message", "stack_trace")])
    return fetch_rows(taken, texts, ["id"]).select(*names, "message", "stack_trace", "sample_rank")


def analysis_prompts(clusters: DataFrame, newest: DataFrame, context: DataFrame | None = None,
                     by: tuple[str, ...] = ()) -> DataFrame:
    """L1: one analysis prompt per cluster.

    ``newest``: the newest entry of each cluster (``most_recent_entry``) with
    ``stack_trace``; ``context``: ``code_context`` rows (optional) with
    ``file_path, target_line, plain_context, method_body``.
    """
    keys = [*by, "fingerprint"]
    n = newest.select(*keys, F.col("stack_trace").alias("_trace"))
    df = clusters.join(n, keys, "left")
    if context is not None:
        ctx = context.select(*keys, "file_path", "target_line", "plain_context", "method_body")
        df = df.join(ctx, keys, "left")
    else:
        df = (df.withColumn("file_path", F.lit(None).cast("string"))
                .withColumn("target_line", F.lit(None).cast("int"))
                .withColumn("plain_context", F.lit(None).cast("string"))
                .withColumn("method_body", F.lit(None).cast("string")))
    has_ctx = F.col("plain_context").isNotNull()
    trace = F.when(has_stack_trace("_trace"), F.col("_trace")).otherwise(F.lit(NO_TRACE))
    method = F.when(F.col("method_body").isNotNull(), F.concat(
        F.lit("\n## Method\n```java\n"), F.col("method_body"), F.lit("\n```\n"))).otherwise(F.lit(""))
    path = F.when(has_ctx, F.col("file_path")).otherwise(F.col("primary_file"))
    line = F.when(has_ctx, F.col("target_line")).otherwise(F.coalesce("primary_line", F.lit(0)))
    prompt = F.concat(
        F.lit("Error to analyse\n\nException: "), _or(F.col("exception_class"), "Unknown"),
        F.lit("\nPattern: "), _or(F.col("message_pattern"), "N/A"),
        F.lit("\nCount: "), F.col("occurrence_count").cast("string"),
        F.lit("\nWhere: "), location_key("primary_class", "primary_method", "primary_line"),
        F.lit("\n\n## Trace\n```\n"), trace, F.lit("\n```\n\n## Code\nFile: "), _or(path, "Unknown"),
        F.lit(" line "), line.cast("string"), F.lit("\n```java\n"),
        F.when(has_ctx, F.col("plain_context")).otherwise(F.lit(NO_CODE)), F.lit("\n```\n"), method,
        F.lit("\nAnswer with EXPLANATION:, ROOT_CAUSE:, RECOMMENDATION: and PATCH: sections."))
    return df.select(*by, "cluster_id", "fingerprint", prompt.alias("prompt"))


def _text_or(c: str, default: str) -> Column:
    """``c``, or ``default`` where it is null or empty."""
    return F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit(default))


def _where() -> Column:
    method = F.when(F.length("primary_method") > 0, F.concat(F.lit("."), F.col("primary_method"))).otherwise(F.lit(""))
    line = F.when(F.col("primary_line") != 0, F.concat(F.lit(":"), F.col("primary_line"))).otherwise(F.lit(""))
    return F.concat(F.coalesce("primary_class", F.lit("")), method, line)


def cloud_analysis_prompts(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """L1, cloud form: one prompt per cluster (``app_id``, ``fingerprint``)
    with the first of its pattern samples (J5: ``sample_rank`` 1, message
    and trace). No sample: the pattern stands for the message. An empty
    text or line 0 counts as missing."""
    first = samples.filter(F.col("sample_rank") == 1).select(
        "app_id", "fingerprint", F.col("message").alias("_message"), F.col("stack_trace").alias("_trace"))
    df = clusters.join(first, ["app_id", "fingerprint"], "left")
    line = F.when(F.col("primary_line") != 0, F.col("primary_line").cast("string")).otherwise(F.lit("Unknown"))
    message = F.when(F.length("_message") > 0, F.col("_message")).otherwise(_text_or("message_pattern", "N/A"))
    prompt = F.concat(
        F.lit("Error to analyse\n\nException: "), _text_or("exception_class", "Unknown"),
        F.lit("\nPattern: "), _text_or("message_pattern", "N/A"),
        F.lit("\nCount: "), F.col("occurrence_count").cast("string"), F.lit("\nWhere: "), _where(),
        F.lit("\n\n## Message\n"), message, F.lit("\n\n## Trace\n```\n"), _text_or("_trace", NO_TRACE),
        F.lit("\n```\n\nFile: "), _text_or("primary_file", "Unknown"), F.lit("\nLine: "), line,
        F.lit("\n\nAnswer with EXPLANATION:, ROOT_CAUSE:, RECOMMENDATION: and PATCH: sections."))
    return df.select("app_id", "cluster_id", "fingerprint", prompt.alias("prompt"))


def cloud_patch_prompts(clusters: DataFrame, analyses: DataFrame, newest_errors: DataFrame,
                        sources: DataFrame | None = None) -> DataFrame:
    """L3, cloud form: one prompt per cluster (``id``, ``app_id``) with its
    newest analysis (``cluster_id``, one row each), the trace of its
    application's newest error (J6) and, where given, its source text
    (``cluster_id``, ``source``). Sections without a value are left out."""
    a = analyses.select(F.col("cluster_id").alias("id"), "root_cause", "recommendation")
    e = newest_errors.select("app_id", F.col("stack_trace").alias("_trace"))
    df = clusters.join(a, "id", "left").join(e, "app_id", "left")
    if sources is None:
        df = df.withColumn("_source", F.lit(None).cast("string"))
    else:
        df = df.join(sources.select(F.col("cluster_id").alias("id"), F.col("source").alias("_source")), "id", "left")

    def section(title: str, c: str, fence: str | None = None) -> Column:
        body = F.col(c) if fence is None else F.concat(F.lit(f"```{fence}\n"), F.col(c), F.lit("\n```"))
        return F.when(F.length(c) > 0, F.concat(F.lit(f"\n## {title}\n"), body))

    prompt = F.concat_ws(
        "\n", F.lit("Write a unified diff that fixes this error."),
        F.concat(F.lit("Exception: "), _text_or("exception_class", "Unknown")),
        F.concat(F.lit("Where: "), _where()), F.concat(F.lit("File: "), _text_or("primary_file", "Unknown.java")),
        section("Root cause", "root_cause"), section("Recommendation", "recommendation"),
        section("Trace", "_trace", ""), section("Source", "_source", "java"),
        F.lit("\nAnswer with the diff alone: a/ and b/ file headers, @@ markers and three lines of context."))
    return df.select(F.col("id").alias("cluster_id"), "app_id", prompt.alias("prompt"))


def simple_prompts(clusters: DataFrame, newest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """L2: prompt without code: class, the newest message, its trace."""
    keys = [*by, "fingerprint"]
    n = newest.select(*keys, F.col("stack_trace").alias("_trace"), F.col("message").alias("_msg"),
                      F.lit(True).alias("_has"))
    df = clusters.join(n, keys, "left")
    msg = F.when(F.col("_has"), F.col("_msg")).otherwise(F.col("message_pattern"))
    trace = F.when(has_stack_trace("_trace"), F.col("_trace")).otherwise(F.lit(NO_TRACE))
    prompt = F.concat(F.lit("Error to analyse\n\nException: "), _or(F.col("exception_class"), "Unknown"),
                      F.lit("\nMessage: "), _or(msg, "N/A"), F.lit("\n\n## Trace\n```\n"), trace,
                      F.lit("\n```\n\nAnswer with EXPLANATION:, ROOT_CAUSE:, RECOMMENDATION: and PATCH: sections."))
    return df.select(*by, "cluster_id", "fingerprint", prompt.alias("prompt"))


def patch_prompts(analyses: DataFrame, context: DataFrame) -> DataFrame:
    """L3: patch prompt from an analysis and the code (one ``context`` row
    per cluster at most); sections whose value is missing are left out
    (``concat_ws`` skips nulls), so a cluster without code keeps its prompt."""
    df = analyses.join(context.select("cluster_id", "file_path", "plain_context", "method_body"),
                       "cluster_id", "left")
    code = F.coalesce("method_body", "plain_context")
    prompt = F.concat_ws(
        "\n",
        F.lit("Write a unified diff that fixes this error."),
        F.concat(F.lit("Explanation: "), F.col("explanation")),
        F.concat(F.lit("Root cause: "), F.col("root_cause")),
        F.concat(F.lit("File: "), F.col("file_path")),
        F.concat(F.lit("```java\n"), code, F.lit("\n```")),
        F.lit("PATCH:\n```diff\n[diff]\n```"))
    return df.select("cluster_id", prompt.alias("prompt"))


def summary_prompt(summary: DataFrame, top: DataFrame) -> DataFrame:
    """L4: one prompt over the totals and the top clusters (``top`` is a
    bounded top-k table, so gathering it into one row is bounded too)."""
    lines = top.select(F.struct(
        (-F.col("occurrence_count")).alias("o"), F.col("fingerprint").alias("f"),
        F.concat(F.lit("- "), _or(F.col("exception_class"), "Unknown"), F.lit(" ("),
                 F.col("occurrence_count").cast("string"), F.lit(" times): "),
                 _or(F.col("message_pattern"), "N/A")).alias("line")).alias("e"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")),
                                              lambda e: e["line"]), "\n").alias("t")).select("t").scalar()
    return summary.select(F.concat(
        F.lit("Summarise the health of this application.\nTotal errors: "),
        F.col("error_logs").cast("string"), F.lit("\nError types: "), F.col("cluster_count").cast("string"),
        F.lit("\nTop errors:\n"), F.coalesce(text, F.lit(""))).alias("prompt"))


def complete(prompts: DataFrame, fn: Callable[[str], str | None], partitions: int | None = None,
             prompt_col: str = "prompt") -> DataFrame:
    """Run every prompt through ``fn`` (the caller's model client); a
    call that raises leaves ``response`` null. Rows are spread over
    ``partitions`` tasks so calls run in parallel, one Arrow batch at a
    time per task."""
    df = prompts.repartition(partitions) if partitions else prompts
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField("response", StringType())])

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf[prompt_col]:
                try:
                    out.append(None if p is None else fn(p))
                except Exception:  # noqa: BLE001 - a failed call leaves null
                    out.append(None)
            yield pdf.assign(response=pd.Series(out, dtype="object"))

    return df.mapInPandas(run, schema)
