"""Transcripts of local agents, one JSON record a line, to one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import provenance, word_count

# Names of files that are transcripts or aren't, and of tools that name the file they work on.
PATTERNS = {"claude": "*.jsonl", "codex": "rollout-*.jsonl"}
NOT_TRANSCRIPTS = "journal.jsonl"
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit", "MultiEdit")
MAX_LINE_FILE = "2000000000"


def discover(spark: SparkSession, root: str, source: str) -> DataFrame:
    """source_path, name, size_bytes, modified, content of the transcript files under ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERNS[source]).option("recursiveFileLookup", "true").load(root)
    listed = files.select(F.col("path").alias("source_path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    return listed.where(F.col("name") != NOT_TRANSCRIPTS)


def lines(files: DataFrame) -> DataFrame:
    """source_path, pos, line: whole lines only. A last line still being written (without its end) is left for later; bytes that are no UTF-8 are replaced."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    whole = F.split(text, "\n")
    complete = F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))
    each = files.select("source_path", F.posexplode(complete).alias("pos", "line"))
    return each.where(F.btrim("line", F.lit(" \t\r\n\x0b\x0c")) != "")


def records(each: DataFrame) -> DataFrame:
    """source_path, pos, v (the record), failure (malformed_json, not_an_object or null)."""
    parsed = each.select("source_path", "pos", F.try_parse_json("line").alias("v"))
    bad = F.when(F.col("v").isNull(), "malformed_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "not_an_object")
    return parsed.withColumn("failure", bad)


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null for what is missing, empty or of another type."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def number_at(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, path, "bigint"))


def valid_time(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(text).isNotNull(), text)


def first(column: str) -> Column:
    """The first value of a file that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("pos"))).alias(column)


def last(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("pos")))


def tally(names: Column) -> Column:
    """An array of names as a map from name to how often it comes."""
    keys = F.array_sort(F.array_distinct(names))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(names, lambda n: n == k)).cast("long")))


def prose(parts: Column) -> Column:
    """(pos, at, text) in order, joined by blank lines."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "\n\n")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))) / 1e6


def parse_claude(files: DataFrame) -> DataFrame:
    """One row a transcript, with ``files``, ``tools`` and ``failures`` as an array and maps.

    Every field may be missing; a bad record is counted and skipped. A subagent's id is its file's
    name, its parent the folder above ``subagents`` or else the session the records name.
    """
    rec = records(lines(files))
    v = F.col("v")
    content = F.try_variant_get(v, "$.message.content", "variant")
    kind = F.coalesce(F.schema_of_variant(content), F.lit(""))
    message = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.message", "variant")), F.lit("")).startswith("OBJECT")
    role = text_at(v, "$.type")
    is_text, is_list = kind == "STRING", kind.startswith("ARRAY")
    missing = F.col("failure").isNull() & ~message & role.isin("user", "assistant")
    unreadable = F.col("failure").isNull() & message & ~is_text & ~is_list
    rec = rec.select(
        "source_path",
        "pos",
        F.coalesce("failure", F.when(missing, "missing_message"), F.when(unreadable, "unreadable_content")).alias("failure"),
        role.alias("role"),
        text_at(v, "$.sessionId").alias("record_id"),
        text_at(v, "$.cwd").alias("cwd"),
        text_at(v, "$.gitBranch").alias("branch"),
        text_at(v, "$.entrypoint").alias("entrypoint"),
        text_at(v, "$.message.model").alias("model"),
        valid_time(text_at(v, "$.timestamp")).alias("at"),
        (F.coalesce(number_at(v, "$.message.usage.input_tokens"), F.lit(0)) + F.coalesce(number_at(v, "$.message.usage.output_tokens"), F.lit(0))).alias("tokens"),
        (message & (is_text | is_list)).alias("readable"),
        F.when(is_text, F.try_variant_get(content, "$", "string")).alias("plain"),
        F.when(is_list, F.try_variant_get(content, "$", "array<variant>")).alias("blocks"),
    )
    tag = F.when(F.col("role") == "user", "[USER] ").otherwise("[ASSISTANT] ")
    block_kind = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))
    blocks = F.coalesce("blocks", F.array().cast("array<variant>"))
    says = lambda b: F.coalesce(text_at(b, "$.text"), F.lit(""))
    told = F.transform(blocks, lambda b, i: F.struct(F.col("pos").alias("pos"), i.alias("at"), F.when((block_kind(b) == "text") & (F.btrim(says(b), F.lit(" \t\r\n")) != ""), F.concat(tag, says(b))).alias("text")))
    alone = F.array(F.struct(F.col("pos").alias("pos"), F.lit(0).alias("at"), F.when(F.btrim("plain", F.lit(" \t\r\n")) != "", F.concat(tag, F.col("plain"))).alias("text")))
    parts = F.filter(F.when(F.col("plain").isNotNull(), alone).otherwise(told), lambda p: p["text"].isNotNull())
    used = F.filter(blocks, lambda b: block_kind(b) == "tool_use")
    named = F.filter(F.transform(used, lambda b: text_at(b, "$.name")), lambda n: n.isNotNull())
    touched = F.filter(F.transform(used, lambda b: F.when(text_at(b, "$.name").isin(*FILE_TOOLS), F.coalesce(text_at(b, "$.input.file_path"), text_at(b, "$.input.notebook_path")))), lambda f: f.isNotNull())
    rec = rec.select("*", parts.alias("parts"), named.alias("named"), touched.alias("touched"), F.size(used).alias("uses"), F.size(F.filter(blocks, lambda b: block_kind(b) == "tool_result")).alias("results"))
    one = rec.groupBy("source_path").agg(
        *[first(c) for c in ("record_id", "cwd", "branch", "entrypoint", "model")],
        first("at").alias("started_at"),
        last("at").alias("ended_at"),
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("readable") & (F.col("role") == "user")).alias("user_turns"),
        F.count_if(F.col("readable") & (F.col("role") == "assistant")).alias("assistant_turns"),
        F.sum("uses").alias("tool_uses"),
        F.sum("results").alias("tool_results"),
        prose(F.flatten(F.collect_list("parts"))).alias("text"),
        tally(F.flatten(F.collect_list("named"))).alias("tools"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("files"),
        tally(F.collect_list("failure")).alias("failures"),
    )
    path = F.col("source_path")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")
    subagent = stem.startswith("agent-") | path.contains("/subagents/")
    above = F.nullif(F.regexp_extract(path, r"([^/]+)/subagents/", 1), F.lit(""))
    parent = F.coalesce(F.when(above != "workflows", above), F.col("record_id"))
    duration = seconds_between(F.col("started_at"), F.col("ended_at"))
    return finish(one, "claude", F.when(subagent, stem).otherwise(F.coalesce("record_id", stem)), F.when(subagent, parent), duration, provenance(subagent, F.col("entrypoint"), F.col("cwd"), F.col("user_turns"), duration))


def parse_codex(files: DataFrame) -> DataFrame:
    """One row a rollout file; fields of a context record are taken from its payload or, failing that, from the record.

    The id is the UUID at the end of the file's name. ``tools`` counts runs as "exec"; functions
    called by name are counted beside them.
    """
    rec = records(lines(files))
    v = F.col("v")
    kind, inner = text_at(v, "$.type"), text_at(v, "$.payload.type")
    context = kind.isin("turn_context", "session_meta")
    either = lambda name: F.when(context, F.coalesce(text_at(v, f"$.payload.{name}"), text_at(v, f"$.{name}")))
    said = F.when(inner.isin("user_message", "agent_message") & (F.btrim(text_at(v, "$.payload.message"), F.lit(" \t\r\n")) != ""), text_at(v, "$.payload.message"))
    counted = inner == "token_count"
    tool = F.when(inner.startswith("exec"), "exec").when(inner == "function_call", F.coalesce(text_at(v, "$.payload.name"), F.lit("function")))
    rec = rec.select("source_path", "pos", "failure", valid_time(text_at(v, "$.timestamp")).alias("at"), either("cwd").alias("cwd"), either("model").alias("model"), F.coalesce(either("git_branch"), either("branch")).alias("branch"), inner.alias("inner"), said.alias("said"), F.when(counted, F.coalesce(number_at(v, "$.payload.input_tokens"), F.lit(0)) + F.coalesce(number_at(v, "$.payload.output_tokens"), F.lit(0))).alias("spent"), F.when(counted, number_at(v, "$.payload.total_tokens")).alias("total"), tool.alias("tool"))
    part = F.when(F.col("said").isNotNull(), F.struct("pos", F.lit(0).alias("at"), F.concat(F.when(F.col("inner") == "user_message", "[USER] ").otherwise("[ASSISTANT] "), F.col("said")).alias("text")))
    one = rec.groupBy("source_path").agg(
        *[first(c) for c in ("cwd", "branch", "model")],
        first("at").alias("started_at"),
        last("at").alias("ended_at"),
        F.greatest(F.coalesce(F.sum("spent"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).alias("tokens"),
        F.count_if(F.col("said").isNotNull() & (F.col("inner") == "user_message")).alias("user_turns"),
        F.count_if(F.col("said").isNotNull() & (F.col("inner") == "agent_message")).alias("assistant_turns"),
        F.count("tool").alias("tool_uses"),
        F.lit(0).cast("long").alias("tool_results"),
        prose(F.collect_list(part)).alias("text"),
        tally(F.collect_list("tool")).alias("tools"),
        F.array().cast("array<string>").alias("files"),
        tally(F.collect_list("failure")).alias("failures"),
    )
    stem = F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.jsonl$", "")
    uuid = F.nullif(F.regexp_extract(stem, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1), F.lit(""))
    duration = seconds_between(F.col("started_at"), F.col("ended_at"))
    none = F.lit(None).cast("string")
    return finish(one, "codex", F.coalesce(uuid, stem), none, duration, provenance(F.lit(False), none, F.col("cwd"), F.col("user_turns"), duration))


def finish(one: DataFrame, source: str, session_id: Column, parent: Column, duration: Column, held_by: Column) -> DataFrame:
    """The columns of a parsed session."""
    return one.select(session_id.alias("session_id"), F.lit(source).alias("source"), held_by.alias("provenance"), parent.alias("parent_id"), "cwd", "branch", "model", F.lit(None).cast("string").alias("title"), "started_at", "ended_at", duration.alias("duration_s"), "user_turns", "assistant_turns", "tool_uses", "tool_results", word_count("text").alias("words"), F.when(F.col("tokens") > 0, F.col("tokens")).alias("tokens"), "text", "source_path", "tools", "files", "failures")
