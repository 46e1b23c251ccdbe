"""Prose files with headers, job queues, commit logs, and sources others plug in."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ledgerloom.functions.text import provenance, word_count
from ledgerloom.sources.transcripts import seconds_between, valid_time

# What kinds of prose file there are, the source each belongs to, and outcomes by another name.
KIND_SOURCE = {"cloud": "claude-cloud", "project": "claude-project", "project-memory": "claude-project", "memory": "claude-memory"}
NOT_CONVERSATIONS = ("project", "project-memory", "memory")
OUTCOME_NAMES = {"resolved": "fixed", "reference": "exploratory", "ongoing": "ongoing", "abandoned": "abandoned", "exploratory": "exploratory", "fixed": "fixed"}
JOB = "v int, kind string, session_id string, transcript_path string, cwd string, reason string, enqueued_at string, source string"


def read_prose(spark: SparkSession, folder: str, default_source: str = "claude") -> DataFrame:
    """One row a ``*.txt`` file: session columns, or ``reason`` why it was skipped.

    The headers are the lines that begin with ``#`` up to the first that doesn't; the first of
    several with one key counts. The rest is the prose.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    head = F.regexp_extract("value", r"^((?:#[^\n]*(?:\n|$))*)", 1)
    body = F.btrim(F.expr("substring(value, length(_head) + 1)"), F.lit("\n"))
    pairs = F.filter(F.transform(F.split("_head", "\n"), lambda line: F.struct(F.lower(F.trim(F.regexp_extract(line, r"^#([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(line, r"^#[^:]*:(.*)$", 1)).alias("value"))), lambda p: p["key"] != "")
    with_head = files.withColumn("_head", head).withColumn("_pairs", pairs).withColumn("_body", body)
    at = lambda key: F.nullif(F.element_at(F.concat(F.transform(F.filter(F.col("_pairs"), lambda p: p["key"] == key), lambda p: p["value"]), F.array(F.lit(""))), 1), F.lit(""))
    got = with_head.select("source_path", F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.txt$", "").alias("_stem"), F.col("_body").alias("text"), F.size("_pairs").alias("_n"), *[at(k).alias(f"_{k}") for k in ("session", "kind", "project", "parent", "cwd", "branch", "model", "title", "name", "source", "start", "end", "turns")])
    stem = F.coalesce("_project", "_stem")
    identity = F.coalesce("_session", F.when(F.col("_kind").isNotNull(), F.concat("_kind", F.lit(":"), stem)).otherwise(stem))
    reason = F.when(F.col("_n") == 0, "unknown-schema").when(F.btrim("text", F.lit(" \t\r\n")) == "", "no-content")
    by_kind = F.element_at(F.create_map(*[F.lit(x) for pair in KIND_SOURCE.items() for x in pair]), F.col("_kind"))
    turns = lambda who: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce("_turns", F.lit("")), rf"(?:^|\s){who}=(\d+)(?:\s|$)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    user, started, ended = turns("user"), valid_time(F.col("_start")), valid_time(F.col("_end"))
    duration = seconds_between(started, ended)
    held = F.when(F.col("_kind").isin(*NOT_CONVERSATIONS), "human").otherwise(provenance(F.col("_kind") == "subagent", F.lit(None).cast("string"), F.col("_cwd"), user, duration))
    return got.select(F.when(F.col("_n") == 0, F.col("_stem")).otherwise(identity).alias("session_id"), reason.alias("reason"), F.coalesce("_source", by_kind, F.lit(default_source)).alias("source"), held.alias("provenance"), F.col("_parent").alias("parent_id"), F.col("_cwd").alias("cwd"), F.col("_branch").alias("branch"), F.col("_model").alias("model"), F.coalesce("_title", "_name").alias("title"), started.alias("started_at"), ended.alias("ended_at"), duration.alias("duration_s"), user.alias("user_turns"), turns("assistant").alias("assistant_turns"), word_count("text").alias("words"), "text", "source_path", F.lit("prose-index").alias("origin"))


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """session_id (the file's name), topic, outcome, keywords of ``*.md`` files that begin with such lines, plain, bold or quoted."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.substr("value", F.lit(1), F.lit(2000)).alias("_head"), F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.md$", "").alias("session_id"))
    at = lambda key: F.nullif(F.btrim(F.regexp_extract("_head", rf"(?im)^[ \t>*_\-]*{key}[*_]*\s*:\s*[*_]*\s*(.+?)\s*$", 1), F.lit(" \"'*_")), F.lit(""))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOME_NAMES.items() for x in pair]), F.lower(at("outcome")))
    words = F.filter(F.transform(F.split(F.coalesce(at("keywords"), F.lit("")), ","), lambda w: F.btrim(w, F.lit(" []\"'"))), lambda w: w != "")
    return files.select("session_id", at("topic").alias("topic"), known.alias("outcome"), F.slice(words, 1, 12).alias("keywords")).where(F.col("topic").isNotNull())


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs of a queue, one JSON file each, in the order to be done: oldest first, then by name. ``ok`` tells jobs that can be read from those to set aside."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("job_path"), F.col("_metadata.file_modification_time").alias("modified"))
    job = F.from_json("value", JOB, {"mode": "PERMISSIVE"})
    got = files.select("job_path", "modified", job.alias("_j")).select("job_path", "modified", "_j.*")
    return got.withColumn("ok", F.coalesce((F.col("transcript_path") != "") & F.col("kind").isNotNull(), F.lit(False))).withColumn("source", F.coalesce("source", F.lit("claude"))).orderBy("modified", "job_path")


def queue_state(jobs: DataFrame) -> DataFrame:
    """One row: pending and bad jobs and the seconds the oldest has waited."""
    waited = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.min(F.when(F.col("ok"), F.col("modified"))))
    return jobs.agg(F.count_if("ok").alias("pending"), F.count_if(~F.col("ok")).alias("bad"), waited.alias("oldest_s"))


def parse_commits(lines: DataFrame, line: str = "value") -> DataFrame:
    """commit_id, at, author, subject of lines of a commit log whose fields are parted by 0x1f; others are left out."""
    fields = F.split(F.col(line), "\x1f")
    whole = lines.where(F.size(fields) == 4)
    return whole.select(fields[0].alias("commit_id"), F.try_to_timestamp(fields[1]).alias("at"), fields[2].alias("author"), fields[3].alias("subject"))


def read_commits(spark: SparkSession, repository: str, path: str, limit: int = 200, seconds: int = 30) -> DataFrame:
    """The commits that touched a file of a local repository, the newest first; none where there is no repository."""
    command = ["git", "-C", repository, "log", f"-{int(limit)}", "--follow", "--format=%H%x1f%aI%x1f%an%x1f%s", "--", path]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=True)
        found = done.stdout.splitlines()
    except (OSError, subprocess.SubprocessError):
        found = []
    return parse_commits(spark.createDataFrame([(x,) for x in found], "value string"))


class HistorySource(DataSource):
    """Spark's view of a plugged-in history: ``format("history")`` with the options ``module``, ``attribute`` and ``prefix``.

    The attribute is a callable that yields dicts of session columns; ids get ``prefix`` in front,
    so that no source can overwrite another's sessions.
    """

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return "session_id string, source string, title string, started_at string, ended_at string, text string"

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options)


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["attribute"])
        prefix = self.options.get("prefix", "")
        for got in fetch():
            yield (prefix + str(got["session_id"]), got.get("source"), got.get("title"), got.get("started_at"), got.get("ended_at"), got.get("text"))
