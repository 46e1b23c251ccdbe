"""Continuous ingest: a sweep that reconciles, a queue that is drained, and counts over event time."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import archive
from ledgerloom.sources import others, transcripts

PARSERS = {"claude": transcripts.parse_claude, "codex": transcripts.parse_codex}
SESSION = "session_id string, source string, provenance string, parent_id string, cwd string, branch string, model string, title string, started_at string, ended_at string, duration_s double, user_turns long, assistant_turns long, tool_uses long, tool_results long, words int, tokens long, text string, source_path string, source_present int, origin string, ingested_at timestamp, updated_at timestamp, topic string, outcome string, summary string, facets_json string, enriched_at timestamp, enriched_words int"
TABLES = {
    "sessions": SESSION,
    "session_files": "session_id string, path string, basename string",
    "session_tools": "session_id string, tool string, uses long",
    "ingest_state": "source_path string, session_id string, size_bytes long, modified timestamp",
    "presence": "session_id string, source_present int",
    "failure_log": "id string, failed_at timestamp, source string, category string, n_failures long, session_id string",
    "import_ledger": "ledger_id string, started_at timestamp, finished_at timestamp, source_kind string, source_ref string, source_digest string, item_count long, added long, updated long, unchanged long, skipped long, outcome string, duplicate_of string, error string",
    "import_items": "ledger_id string, item_id string, disposition string, reason string",
}
#: Tables of which the rows of a key's newest commit replace those of older ones, with that key; all others are only added to.
KEYS = {"sessions": "session_id", "session_files": "session_id", "session_tools": "session_id", "ingest_state": "source_path", "presence": "session_id"}


class Archive:
    """Tables under one folder, each a list of parts that one commit names for all tables together; one writer at a time.

    A batch writes its parts beside those that are there, only of the sessions it changes, and then
    commits them all at once: it is in every table or in none, and prose that doesn't change is never
    written again. A batch that fails leaves its ledger row unfinished; running it again gives the
    same tables, as rows are told by their key and failures by their file and kind.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = archive.Commits(spark, self.folder)

    def table(self, name: str) -> DataFrame:
        parts = self.commits.newest()[1].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name] + ", _commit long").parquet(*parts)
        key = KEYS.get(name)
        if key:
            newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_commit").alias("_newest"))  # narrow: prose stays where it lies
            rows = rows.join(newest, (F.col(key) == F.col("_key")) & (F.col("_commit") == F.col("_newest")), "left_semi")
        rows = rows.drop("_commit")
        if name == "failure_log":
            return rows.dropDuplicates(["id"])
        if name == "sessions":
            seen = self.table("presence").withColumnRenamed("source_present", "_present")
            rows = rows.join(seen, "session_id", "left").withColumn("source_present", F.coalesce("_present", "source_present")).select(*[c.split()[0] for c in SESSION.split(", ")])
        # a key whose newest commit has nothing in this table is marked by a row without a value
        empty = {"session_files": "path", "session_tools": "tool"}.get(name)
        return rows.where(F.col(empty).isNotNull()) if empty else rows

    def write(self, name: str, rows: DataFrame, number: int) -> str:
        """A part of a table, which counts only once a commit names it."""
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        folder = f"{self.folder}/{name}/part-{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.lit(number).cast("long").alias("_commit")).write.parquet(folder)
        return folder

    def add(self, changes: dict[str, DataFrame]) -> None:
        """Adds rows to several tables in one commit."""
        number, tables = self.commits.newest()
        made = {name: self.write(name, rows, number + 1) for name, rows in changes.items()}
        self.commits.commit(number + 1, {name: [*tables.get(name, []), *([made[name]] if name in made else [])] for name in {*tables, *made}})

    def compact(self, name: str) -> None:
        """Writes a table anew as one part of its current rows; call now and then, as every batch adds a part."""
        number, tables = self.commits.newest()
        part = self.write(name, self.table(name), number + 1)
        self.commits.commit(number + 1, {**tables, name: [part]})

    def incomplete(self) -> DataFrame:
        """Imports that never finished."""
        ledger = self.table("import_ledger")
        done = ledger.where(F.col("finished_at").isNotNull()).select("ledger_id")
        return ledger.join(done, "ledger_id", "left_anti")

    def receipts(self, newest: int = 20) -> DataFrame:
        """The newest finished imports."""
        return self.table("import_ledger").where(F.col("finished_at").isNotNull()).orderBy(F.desc("started_at")).limit(newest)

    def changed(self, listing: DataFrame) -> DataFrame:
        """Listed files the archive hasn't read, or not at this size and time. A path alone tells nothing: files grow."""
        known = self.table("ingest_state").select("source_path", "size_bytes", "modified")
        return listing.join(known, ["source_path", "size_bytes", "modified"], "left_anti")

    def _ledger(self, **row: object) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES["import_ledger"]).schema
        return self.spark.createDataFrame([tuple(row.get(f.name) for f in fields)], fields)

    def sweep(self, root: str, source: str) -> dict[str, int]:
        """Reads what changed under ``root``, merges it, and marks sessions whose file is gone; returns the counts of the receipt."""
        listing = transcripts.discover(self.spark, root, source)
        fresh = self.changed(listing)
        parsed = PARSERS[source](fresh.select("source_path", "content"))
        state = fresh.select("source_path", "size_bytes", "modified")
        counts = self.take(parsed, state, source, root)
        own = self.table("sessions").where(F.col("source") == source).select("session_id", "source_path", "source_present")
        marked = archive.mark_missing(own, listing.select("source_path")).where("source_present = 0").select("session_id", "source_present")
        gone = marked.join(own.where("source_present = 0"), "session_id", "left_anti")
        if not gone.isEmpty():
            self.add({"presence": gone})
        return counts

    def take(self, parsed: DataFrame, state: DataFrame, source: str, ref: str) -> dict[str, int]:
        """Merges parsed sessions: first path of each id, blank-preserving, with ledger, items and the conservation check."""
        ledger_id, now = uuid.uuid4().hex, datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        # the batch is read by several writes below: written once, so that a lost executor repeats no parsing
        staged = f"{self.folder}/staging/{ledger_id}"
        parsed.write.parquet(staged)
        batch = self.spark.read.parquet(staged)
        items = batch.count()
        digest = archive.digest(batch, source, "session_id", "ended_at").first()["digest"]
        before = self.table("import_ledger").where((F.col("source_digest") == digest) & F.col("finished_at").isNotNull()).orderBy("started_at").first()
        opened = dict(ledger_id=ledger_id, started_at=now, source_kind=source, source_ref=ref, source_digest=digest, item_count=items)
        self.add({"import_ledger": self._ledger(**opened)})
        kept, repeated = archive.first_of_each(batch, "session_id", ["source_path"])
        sessions = self.table("sessions")
        said = archive.disposition(sessions, kept).select("session_id", "disposition", F.lit(None).cast("string").alias("reason"))
        said = said.unionByName(repeated.select("session_id", F.lit("skipped").alias("disposition"), "reason"))
        counts = archive.conserve(said, items)
        stamp = F.lit(now).cast("timestamp")
        fresh = said.where(F.col("disposition").isin("added", "updated")).select("session_id")
        kept = kept.join(fresh, "session_id", "left_semi")
        new = kept.select(*[c for c in kept.columns if c not in ("tools", "files", "failures")], F.lit(1).alias("source_present"), F.lit("raw").alias("origin"), stamp.alias("updated_at"), stamp.alias("ingested_at"))
        files = kept.select("session_id", F.explode_outer("files").alias("path")).withColumn("basename", F.substring_index("path", "/", -1))
        tools = kept.select("session_id", F.explode_outer("tools").alias("tool", "uses"))
        of_file = batch.join(state, "source_path", "left").select("source_path", "session_id", "size_bytes", "modified", "failures")
        identity = F.sha2(F.concat_ws("\t", "source_path", F.col("size_bytes").cast("string"), F.col("modified").cast("string"), "category"), 256)
        failures = of_file.select("source_path", "size_bytes", "modified", "session_id", F.explode("failures").alias("category", "n_failures"))
        failures = failures.select(identity.alias("id"), stamp.alias("failed_at"), F.lit(source).alias("source"), "category", "n_failures", "session_id")
        seen = state.join(batch.select("source_path", "session_id"), "source_path", "left").select("source_path", "session_id", "size_bytes", "modified")
        ended = archive.outcome(**counts, items=items, prior=before is not None)
        closed = self._ledger(**opened, finished_at=datetime.datetime.now(datetime.UTC).replace(tzinfo=None), outcome=ended, duplicate_of=before["ledger_id"] if before and ended == "duplicate" else None, **counts)
        changes = {
            "import_items": said.select(F.lit(ledger_id).alias("ledger_id"), F.col("session_id").alias("item_id"), "disposition", "reason"),
            "sessions": archive.upsert(sessions.join(fresh, "session_id", "left_semi"), new).select(sessions.columns),
            "session_files": files,
            "session_tools": tools,
            "presence": kept.select("session_id", F.lit(1).alias("source_present")),
            "failure_log": failures,
            "ingest_state": seen,
            "import_ledger": closed,
        }
        self.add(changes)
        folder = self.commits._path(staged)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return counts

    def failures(self, keep: int = 500) -> DataFrame:
        """The newest failures of each source."""
        newest = self.table("failure_log").withColumn("_at", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("failed_at"), "id")))
        return newest.where(F.col("_at") <= keep).drop("_at")


def drain(spark: SparkSession, queue: str, target: Archive, checkpoint: str, bad: str, once: bool = True) -> StreamingQuery:
    """Takes jobs from a queue folder as they come: each batch's transcripts are merged, jobs that can't be read are set aside in ``bad``.

    The checkpoint remembers which jobs were taken; a batch repeated after a failure merges the
    same sessions again, which changes nothing.
    """
    jobs = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.json").text(queue)

    def take(batch: DataFrame, _: int) -> None:
        job = batch.select(F.from_json("value", others.JOB, {"mode": "PERMISSIVE"}).alias("j"), "value").select("value", "j.*")
        good = job.where((F.col("transcript_path") != "") & F.col("kind").isNotNull())
        job.where(~F.coalesce((F.col("transcript_path") != "") & F.col("kind").isNotNull(), F.lit(False))).select("value").write.mode("append").text(bad)
        for source in PARSERS:
            wanted = good.where(F.coalesce("source", F.lit("claude")) == source).select("transcript_path").distinct()
            paths = [r["transcript_path"] for r in wanted.collect()]  # the files of one micro-batch
            if paths:
                files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
                target.take(PARSERS[source](files.select("source_path", "content")), files.select("source_path", "size_bytes", "modified"), source, queue)

    stream = jobs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.trigger(processingTime="15 seconds").start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window start, event_type, events, total: counts over event time, for batches and streams; a stream drops what comes later than ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, started, events: events of a user with less than ``gap`` between them, for batches and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("started"), "events")
