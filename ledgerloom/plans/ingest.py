"""Parsers and event windows over whole tables: rows are written in a source's form and read back by its parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.current import current_rows, label
from ledgerloom.plans.registry import CUR, WS, query
from ledgerloom.session import table
from ledgerloom.sources import exports, others, transcripts
from ledgerloom.streaming.ingest import event_counts

SAID = f"WITH {CUR}, t AS (SELECT session_id, title, s, ended_at, text, CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) + 1 END AS w FROM cur)"


def prose(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "sessions"), ["text", "title", "source", "ended_at"])


@query(f"{SAID} SELECT session_id, 1::BIGINT AS user_turns, w::INT AS words, md5(CASE WHEN w = 0 THEN '' ELSE '[USER] ' || text END) AS prose FROM t WHERE text IS NOT NULL")
def parse_claude_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every session's prose as a transcript of one record, parsed."""
    rows = prose(spark, folder).where(F.col("text").isNotNull())
    record = F.to_json(F.struct(F.lit("user").alias("type"), F.col("session_id").alias("sessionId"), F.struct(F.col("text").alias("content")).alias("message")))
    files = rows.select(F.concat(F.lit("/logs/"), "session_id", F.lit(".log.jsonl")).alias("source_path"), F.concat(record, F.lit("\n{half")).cast("binary").alias("content"))
    parsed = transcripts.parse_claude(files)
    return parsed.select(F.regexp_extract("source_path", r"/logs/(.*)\.log\.jsonl$", 1).alias("session_id"), "user_turns", "words", F.md5(F.col("text").cast("binary")).alias("prose"))


@query(f"{SAID} SELECT session_id, (w > 0)::INT::BIGINT AS user_turns, w::INT AS words FROM t WHERE text IS NOT NULL")
def parse_codex_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = prose(spark, folder).where(F.col("text").isNotNull())
    record = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    files = rows.select(F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("source_path"), F.concat(record, F.lit("\n")).cast("binary").alias("content"))
    parsed = transcripts.parse_codex(files)
    return parsed.select(F.regexp_extract("source_path", r"/logs/(.*)\.jsonl$", 1).alias("session_id"), "user_turns", "words")


@query(f"{SAID} SELECT session_id, CASE WHEN ended_at IS NULL THEN 'missing-timestamp' WHEN w = 0 THEN 'no-content' END AS reason, w::INT AS words, nullif(title, '') AS title FROM t")
def parse_chat_export(spark: SparkSession, folder: str) -> DataFrame:
    """Every session as a conversation of a hosted chat's export, parsed or refused with a reason."""
    rows = prose(spark, folder)
    item = F.struct(F.col("session_id").alias("uuid"), F.col("title").alias("name"), F.col("ended_at").alias("updated_at"), F.array(F.struct(F.lit("human").alias("sender"), F.col("text").alias("text"))).alias("chat_messages"))
    items = rows.select(F.monotonically_increasing_id().alias("item"), F.parse_json(F.to_json(item)).alias("v"))
    return exports.parse_claude(items).select("session_id", "reason", "words", "title")


@query(f"{SAID} SELECT session_id, CASE WHEN ended_at IS NULL THEN 'missing-timestamp' WHEN w = 0 THEN 'no-content' END AS reason, CASE WHEN w = 0 THEN 0 ELSE w + 2 END::INT AS words FROM t")
def parse_graph_export(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the form that keeps messages as a graph, with an answer that was written before its question."""
    rows = prose(spark, folder)
    message = lambda role, at, text: F.struct(F.struct(F.struct(F.lit(role).alias("role")).alias("author"), F.lit(at).alias("create_time"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message"))
    answer = F.when(F.btrim("text", F.lit(" \t\r\n")) != "", F.lit("yes")).otherwise("")
    mapping = F.struct(message("assistant", 2.0, answer).alias("b"), message("user", 1.0, F.coalesce("text", F.lit(""))).alias("a"))
    item = F.struct(F.col("session_id").alias("id"), F.col("ended_at").alias("update_time"), mapping.alias("mapping"))
    items = rows.select(F.monotonically_increasing_id().alias("item"), F.parse_json(F.to_json(item)).alias("v"))
    return exports.parse_chatgpt(items).select("session_id", "reason", "words")


@query("SELECT doc_id::VARCHAR AS commit_id, epoch_us(captured_at) AS at, coalesce(repo, '') AS author FROM documents WHERE lower(trim(source)) = 'commit-feed' AND captured_at IS NOT NULL")
def parse_commit_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where((label("source") == "commit-feed") & F.col("captured_at").isNotNull())
    line = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.date_format(F.col("captured_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), F.coalesce("repo", F.lit("")), F.lit("subject"))
    return others.parse_commits(rows.select(line.alias("value"))).select("commit_id", F.unix_micros("at").alias("at"), "author")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts over event time, the plan a stream runs too."""
    counts = event_counts(table(spark, folder, "events"))
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


TOUCHED = f"""WITH {CUR}, f AS (SELECT session_id, count(DISTINCT path) AS n, min(path) AS first FROM session_files WHERE session_id IS NOT NULL AND path IS NOT NULL GROUP BY session_id),
j AS (SELECT c.session_id, n, first, trim(coalesce(title, ''), ' ' || chr(9) || chr(10) || chr(13)) AS said, CASE WHEN said = '' THEN 0 ELSE len(list_filter(regexp_split_to_array(said, '{WS}'), lambda w: w <> '')) + 1 END AS w FROM f JOIN cur c USING (session_id))"""


def touched(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, said (the title) and paths of the sessions that touched files."""
    paths = table(spark, folder, "session_files").where(F.col("session_id").isNotNull() & F.col("path").isNotNull()).groupBy("session_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    titles = current_rows(table(spark, folder, "sessions"), ["words", "title"]).select("session_id", F.btrim(F.coalesce("title", F.lit("")), F.lit(" \t\r\n")).alias("said"))
    return paths.join(titles, "session_id")


@query(f"""{TOUCHED} SELECT session_id, 2::BIGINT AS user_turns, 1::BIGINT AS assistant_turns, n AS tool_uses, 1::BIGINT AS tool_results, n + 7 AS tokens, 90.0::DOUBLE AS duration_s, (w + 2)::INT AS words, n AS edits, n AS files, first, 'malformed_json,missing_message,not_an_object' AS failures, '/work/' || session_id AS cwd,
  md5(CASE WHEN said = '' THEN '' ELSE '[USER] ' || said || chr(10) || chr(10) END || '[ASSISTANT] done') AS prose FROM j""")
def parse_claude_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of several records (both roles, tools on every file a session touched, tokens, times, bad records), parsed."""
    rows = touched(spark, folder)
    at = lambda second: F.lit(f"2026-01-01T00:0{second // 60}:{second % 60:02d}Z").alias("timestamp")
    head = lambda role: [F.lit(role).alias("type"), F.col("session_id").alias("sessionId")]
    tool = lambda p: F.struct(F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"), F.struct(p.alias("file_path")).alias("input"), F.lit(None).cast("string").alias("text"))
    text = F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(None).cast("string").alias("file_path")).alias("input"), F.lit("done").alias("text")))
    usage = F.struct(F.size("paths").alias("input_tokens"), F.lit(7).alias("output_tokens"))
    said = F.to_json(F.struct(*head("user"), at(0), F.concat(F.lit("/work/"), "session_id").alias("cwd"), F.struct(F.col("said").alias("content")).alias("message")))
    done = F.to_json(F.struct(*head("assistant"), at(30), F.struct(usage.alias("usage"), F.concat(text, F.transform("paths", tool)).alias("content")).alias("message")))
    result = F.to_json(F.struct(*head("user"), at(90), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"))).alias("content")).alias("message")))
    bad = F.to_json(F.struct(*head("assistant")))
    lines = F.concat_ws("\n", said, F.lit("{broken"), done, F.lit(""), F.lit("[1]"), bad, result, F.lit("{half"))
    files = rows.select(F.concat(F.lit("/logs/"), "session_id", F.lit(".log.jsonl")).alias("source_path"), lines.cast("binary").alias("content"))
    parsed = transcripts.parse_claude(files)
    return parsed.select(F.regexp_extract("source_path", r"/logs/(.*)\.log\.jsonl$", 1).alias("session_id"), "user_turns", "assistant_turns", "tool_uses", "tool_results", "tokens", "duration_s", "words", F.col("tools")["Edit"].alias("edits"), F.size("files").cast("long").alias("files"), F.col("files")[0].alias("first"), F.array_join(F.array_sort(F.map_keys("failures")), ",").alias("failures"), "cwd", F.md5(F.col("text").cast("binary")).alias("prose"))


@query(f"""{TOUCHED} SELECT session_id, CASE WHEN said = '' THEN 'unsupported-sender-role' END AS reason, CASE WHEN said = '' THEN 0 ELSE w + 2 + (w - 1 + 3) END::INT AS words FROM j""")
def parse_chat_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of a hosted chat with an answer, an attachment and a sender that isn't read."""
    rows = touched(spark, folder)
    answer = F.when(F.col("said") != "", F.lit("done")).otherwise("")
    attachment = F.struct(F.lit("a.txt").alias("file_name"), F.col("said").alias("extracted_content"))
    none = F.array().cast("array<struct<file_name:string,extracted_content:string>>")
    message = lambda sender, text, attached: F.struct(F.lit(sender).alias("sender"), text.alias("text"), attached.alias("attachments"))
    item = F.struct(F.col("session_id").alias("uuid"), F.lit("t").alias("name"), F.lit("2026-01-01T00:00:00Z").alias("updated_at"), F.array(message("human", F.col("said"), F.array(attachment)), message("assistant", answer, none), message("system", F.lit(""), none)).alias("chat_messages"))
    items = rows.select(F.col("session_id").alias("item"), F.parse_json(F.to_json(item)).alias("v"))
    return exports.parse_claude(items).select("session_id", "reason", "words")
