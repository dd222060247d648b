"""Trees of JSONL session transcripts as typed tables.

``<root>/<project>/<session>.jsonl`` is a main session, ``<root>/<project>/agent-*.jsonl`` an agent
at the root, and anything deeper under ``<session>/`` a subagent file. Lines that are blank or no
JSON objects are skipped, as are file-history snapshots.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.pricing import billable_tokens, context_ratio, context_window, cost_usd, token_rate
from tracelake.functions.scalars import delta_ms, encoded_path, message_kind

USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_5m_tokens", "billable_tokens", "cost_usd")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, project_id, file_type, session_stem, mtime, size) of every transcript under a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("_metadata.file_path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return files.select("*", *_path_columns(F.col("file_path"), root))


def _path_columns(path: Column, root: str) -> list[Column]:
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    parts = F.split(F.element_at(F.split(F.url_decode(path), f"\\Q{base}/\\E", 2), 2), "/")
    name = F.element_at(parts, -1)
    depth = F.size(parts)
    kind = F.when((depth == 2) & F.startswith(name, F.lit("agent-")), "agent_root").when(depth == 2, "main_session").otherwise("subagent")
    stem = F.when(depth > 2, F.element_at(parts, 2)).otherwise(F.regexp_replace(name, r"\.jsonl$", ""))
    return [F.element_at(parts, 1).alias("project_id"), kind.alias("file_type"), stem.alias("session_stem")]


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differs from what was read before."""
    same = known.select("file_path", F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size"))
    joined = found.join(same, "file_path", "left")
    return joined.where(F.col("k_mtime").isNull() | (F.col("k_mtime") != F.col("mtime")) | (F.col("k_size") != F.col("size"))).drop("k_mtime", "k_size")


def raw_lines(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(file_path, project_id, file_type, session_stem, line_number, line, raw) of every JSON object line; ``raw`` is a variant."""
    text = spark.read.text(paths or root, wholetext=True, recursiveFileLookup=paths is None, pathGlobFilter="*.jsonl")
    return lines_of(text, root)


def lines_of(text: DataFrame, root: str) -> DataFrame:
    files = text.select(F.col("_metadata.file_path").alias("file_path"), "value")
    lines = files.select("file_path", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    parsed = lines.withColumn("raw", F.try_parse_json("line")).where(F.startswith(F.schema_of_variant("raw"), F.lit("OBJECT")))
    return parsed.select("file_path", *_path_columns(F.col("file_path"), root), (F.col("at") + 1).alias("line_number"), "line", "raw")


def read_line(lines: DataFrame, file_path: str, number: int) -> DataFrame:
    """One line of one file."""
    return lines.where((F.col("file_path") == file_path) & (F.col("line_number") == number)).select("line")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", path, kind)


def _count(path: str) -> Column:
    return F.coalesce(_get(f"$.message.usage.{path}", "bigint"), F.lit(0))


def plain_text(blocks: Column) -> Column:
    """The readable text of content blocks: text, thinking, tool names, bare strings, a line each."""

    def one(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        tool = F.concat(F.lit("[tool: "), F.try_variant_get(b, "$.name", "string"), F.lit("]"))
        bare = F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))
        return F.when(kind == "text", F.try_variant_get(b, "$.text", "string")).when(kind == "thinking", F.try_variant_get(b, "$.thinking", "string")).when(kind == "tool_use", tool).otherwise(bare)

    return F.array_join(F.filter(F.transform(blocks, one), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


def parse_events(lines: DataFrame) -> DataFrame:
    """One row for each kept line, before responses are marked."""
    content = F.try_variant_get("raw", "$.message.content", "variant")
    is_string = F.startswith(F.schema_of_variant(content), F.lit("STRING"))
    text = F.when(is_string, _get("$.message.content")).otherwise(F.coalesce(plain_text(F.col("blocks")), F.lit("")))
    first = F.when(is_string, "string").otherwise(_get("$.message.content[0].type"))
    rows = lines.where(F.coalesce(_get("$.type"), F.lit("")) != "file-history-snapshot").withColumn("blocks", F.when(~is_string, F.try_variant_get("raw", "$.message.content", "array<variant>")))
    sidechain = F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False))
    own = F.coalesce(_get("$.sessionId"), F.when(F.col("file_type") != "agent_root", F.col("session_stem")))
    flat = rows.select(
        F.xxhash64("file_path", "line_number").alias("event_key"),
        "file_path",
        "line_number",
        "file_type",
        "project_id",
        own.alias("session_id"),
        _get("$.type").alias("event_type"),
        _get("$.uuid").alias("event_uuid"),
        _get("$.parentUuid").alias("parent_uuid"),
        _get("$.promptId").alias("prompt_id"),
        _get("$.requestId").alias("request_id"),
        _get("$.timestamp").alias("timestamp_raw"),
        F.try_to_timestamp(_get("$.timestamp")).alias("ts"),
        sidechain.alias("is_sidechain"),
        F.coalesce(_get("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"),
        _get("$.agentId").alias("agent_id"),
        _get("$.slug").alias("agent_slug"),
        _get("$.message.role").alias("role"),
        _get("$.message.model").alias("model_id"),
        _get("$.message.stop_reason").alias("stop_reason"),
        first.alias("first_block"),
        text.alias("message_content"),
        "blocks",
        _count("input_tokens").alias("input_tokens"),
        _count("output_tokens").alias("output_tokens"),
        _count("cache_read_input_tokens").alias("cache_read_tokens"),
        _count("cache_creation_input_tokens").alias("cache_creation_tokens"),
        _count("cache_creation.ephemeral_5m_input_tokens").alias("cache_5m_tokens"),
    )
    # a root agent's file belongs to the session that its first record with one names
    by_file = W.partitionBy("file_path").orderBy("line_number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flat = flat.withColumn("session_id", F.when(F.col("file_type") == "agent_root", F.first("session_id", ignorenulls=True).over(by_file)).otherwise(F.col("session_id")))
    tokens = [F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    model = F.col("model_id")
    occupied = F.when(F.col("event_type") == "assistant", tokens[0] + tokens[2] + tokens[3]).otherwise(0)
    subagent = F.col("is_sidechain") | F.col("file_type").isin("subagent", "agent_root")
    return (
        flat.withColumn("msg_kind", message_kind(F.col("event_type"), F.col("is_meta"), F.col("first_block"), F.col("message_content"), subagent))
        .withColumn("token_rate", F.coalesce(token_rate(model), F.lit(0.0)))
        .withColumn("billable_tokens", F.coalesce(F.round(billable_tokens(model, *tokens), 4), F.lit(0.0)))
        .withColumn("cost_usd", F.coalesce(cost_usd(model, *tokens), F.lit(0.0)))
        .withColumn("context_tokens", occupied)
        .withColumn("context_ratio", context_ratio(occupied, context_window(model)))
    )


def mark_responses(events: DataFrame) -> DataFrame:
    """Of the blocks of one response the last is its head: it alone keeps the usage, and the response's duration."""
    is_block = (F.col("event_type") == "assistant") & F.col("request_id").isNotNull()
    before = F.lag("ts").over(W.partitionBy("file_path").orderBy("line_number"))
    marked = events.withColumn("start", F.coalesce(before, "ts")).withColumn("response", F.when(is_block, F.col("request_id")))
    group = W.partitionBy("file_path", "response")
    first = F.min(F.struct("line_number", "start")).over(group)["start"]
    marked = marked.withColumn("began", first).withColumn("last_line", F.max("line_number").over(group))
    head = F.col("response").isNull() | (F.col("line_number") == F.col("last_line"))
    out = marked.withColumn("is_head", head).withColumn("duration_ms", F.when(F.col("response").isNotNull() & head, delta_ms(F.col("began"), F.col("ts"))))
    kept = {c: F.when(F.col("is_head"), F.col(c)).otherwise(F.lit(0).cast(events.schema[c].dataType)) for c in USAGE}
    return out.withColumns(kept).drop("start", "response", "began", "last_line")


def first_of_uuid(events: DataFrame) -> DataFrame:
    """One event for each (session, uuid): the one of the least file path and line; events without a uuid all stay."""
    order = W.partitionBy("session_id", "event_uuid").orderBy("file_path", "line_number")
    return events.withColumn("nth", F.row_number().over(order)).where(F.col("event_uuid").isNull() | (F.col("nth") == 1)).drop("nth")


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """All events of a tree, responses marked, repeated ones dropped."""
    return first_of_uuid(mark_responses(parse_events(raw_lines(spark, root))))


def edges(events: DataFrame) -> DataFrame:
    """Parent links between events."""
    return events.where(F.col("parent_uuid").isNotNull()).select("project_id", "session_id", "event_uuid", "parent_uuid").distinct()


def project_paths(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, project_path) from the index files that name one."""
    index = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "sessions-index.json").schema("entries array<struct<projectPath:string>>").json(root)
    return index.select(_path_columns(F.col("_metadata.file_path"), root)[0], F.col("entries")[0]["projectPath"].alias("project_path")).where(F.col("project_path").isNotNull())


def session_records(spark: SparkSession, root: str, project_id: str, session_id: str) -> DataFrame:
    """All records of one session, those of its main file and of its subagents' files, in time order, those without a time last.

    This reader stands alone: blocks of one response are not merged, and ``cache_creation_tokens`` are those kept for five minutes.
    Records without a type and file snapshots are left out; a session without files has no records.
    """
    name = F.element_at(F.split(F.url_decode("file_path"), "/"), -1)
    below = F.url_decode("file_path")
    main = (F.col("file_type") == "main_session") & (F.col("session_stem") == session_id)
    sub = (F.col("file_type") == "subagent") & F.endswith(F.left(below, F.length(below) - F.length(name)), F.lit(f"/{project_id}/{session_id}/subagents/"))
    try:
        text = spark.read.text(f"{root.rstrip('/')}/{project_id}", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").limit(0)
    rows = lines_of(text, root).where((F.col("project_id") == project_id) & (main | sub)).where(F.coalesce(_get("$.type"), F.lit("")) != "").where(_get("$.type") != "file-history-snapshot")
    content = F.try_variant_get("raw", "$.message.content", "variant")
    is_sub = F.col("file_type") == "subagent"
    slug = F.when(is_sub & F.startswith(name, F.lit("agent-")), F.regexp_replace(F.regexp_replace(name, r"^agent-|\.jsonl$", ""), "-[^-]*$", ""))
    return rows.select(
        _get("$.uuid").alias("event_uuid"),
        _get("$.parentUuid").alias("parent_uuid"),
        _get("$.type").alias("event_type"),
        _get("$.timestamp").alias("timestamp_raw"),
        F.try_to_timestamp(_get("$.timestamp")).alias("ts"),
        _get("$.sessionId").alias("session_id"),
        F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.coalesce(_get("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"),
        slug.alias("agent_slug"),
        _get("$.message.role").alias("role"),
        F.when(F.startswith(F.schema_of_variant(content), F.lit("STRING")), _get("$.message.content")).otherwise(F.to_json(content)).alias("message_content"),
        _get("$.message.model").alias("model_id"),
        _count("input_tokens").alias("input_tokens"),
        _count("output_tokens").alias("output_tokens"),
        _count("cache_read_input_tokens").alias("cache_read_tokens"),
        _count("cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_tokens"),
        "file_path",
        "line_number",
        is_sub.alias("is_subagent_file"),
    ).orderBy(F.asc_nulls_last("ts"), "is_subagent_file", "file_path", "line_number")


def raw_event(lines: DataFrame, events: DataFrame, project_id: str, session_id: str, event_uuid: str) -> DataFrame:
    """The raw line of one event, found by the file and line that the event comes from."""
    one = events.where((F.col("project_id") == project_id) & (F.col("session_id") == session_id) & (F.col("event_uuid") == event_uuid)).select("file_path", "line_number").orderBy("file_path", "line_number").limit(1)
    return lines.select("file_path", "line_number", "line").join(F.broadcast(one), ["file_path", "line_number"]).select("line")


def decoded_projects(project_ids: DataFrame, folders: DataFrame) -> DataFrame:
    """(project_id, path): project ids (dashes for what is no letter or digit) by a table of folder paths that exist; the longest known folder that the id begins with, and the rest of the id below it."""
    known = folders.select("path", encoded_path(F.col("path")).alias("code")).groupBy("code").agg(F.min("path").alias("path"))
    ends = F.filter(F.sequence(F.lit(1), F.length("project_id")), lambda k: (k == F.length("project_id")) | (F.substring("project_id", k + 1, F.lit(1)) == "-"))
    begins = project_ids.select("project_id", F.explode(F.transform(ends, lambda k: F.substring("project_id", F.lit(1), k))).alias("code"))
    best = begins.join(known, "code", "left").groupBy("project_id").agg(F.max(F.struct(F.when(F.col("path").isNotNull(), F.length("code")).otherwise(0).alias("n"), "path")).alias("best"))
    rest = F.expr("substring(project_id, best.n + 2)")
    return best.select("project_id", F.when(F.col("best.n") == 0, F.replace("project_id", F.lit("-"), F.lit("/"))).when(rest == "", F.col("best.path")).otherwise(F.concat_ws("/", F.col("best.path"), rest)).alias("path"))
