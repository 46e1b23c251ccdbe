"""Merging into the archive, its ledger, and what is checked about both."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ConservationError(AssertionError):
    """Items went missing or came twice between input and ledger."""


def blank(column: Column, kind: str) -> Column:
    """Whether a value says nothing: null, the empty string, or 0."""
    if kind == "string":
        return column.isNull() | (column == "")
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return column.isNull() | (column == 0)
    return column.isNull()


def upsert(archive: DataFrame, incoming: DataFrame, key: str = "session_id", facets: tuple[str, ...] = ()) -> DataFrame:
    """``archive`` with ``incoming`` merged in, one row a key on both sides.

    Each column takes the new value unless it is blank and the old one is not; ``facets`` columns
    take the new value as it is. Columns the incoming rows lack keep theirs; new keys are added.
    """
    extra = [c for c in incoming.columns if c in archive.columns and c != key]
    new = incoming.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in extra], F.lit(True).alias("_there"))
    kinds = dict(archive.dtypes)
    # a left join, so that a small batch is broadcast and the archive's prose stays where it is
    merged = archive.join(new, key, "left")
    columns = []
    for c in archive.columns:
        if c == key or c not in extra:
            columns.append(F.col(c))
        elif c in facets:
            columns.append(F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            keep = blank(F.col(f"_new_{c}"), kinds[c]) & ~blank(F.col(c), kinds[c])
            columns.append(F.when(F.col("_there").isNull() | keep, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    added = incoming.join(archive.select(key), key, "left_anti")
    added = added.select(*[F.col(c).cast(kinds[c]).alias(c) if c in incoming.columns else F.lit(None).cast(kinds[c]).alias(c) for c in archive.columns])
    return merged.select(*columns).unionByName(added)


def disposition(archive: DataFrame, incoming: DataFrame, key: str = "session_id", version: str = "ended_at") -> DataFrame:
    """key, disposition of each incoming item: skipped without a key, added, unchanged (same version) or updated."""
    old = archive.select(F.col(key).alias("_id"), F.col(version).alias("_version"), F.lit(True).alias("_known"))
    joined = incoming.join(old, incoming[key] == old["_id"], "left")
    said = F.when(F.col(key).isNull(), "skipped").when(F.col("_known").isNull(), "added").when(F.col(version).eqNullSafe(F.col("_version")), "unchanged").otherwise("updated")
    return joined.select(key, said.alias("disposition"))


def conserve(dispositions: DataFrame, items: int) -> dict[str, int]:
    """Counts by disposition; ConservationError unless they add up to ``items``."""
    counts = {r["disposition"]: r["count"] for r in dispositions.groupBy("disposition").count().collect()}  # four at most
    counts = {name: counts.get(name, 0) for name in ("added", "updated", "unchanged", "skipped")}
    if sum(counts.values()) != items:
        raise ConservationError(f"{sum(counts.values())} of {items} items are accounted for")
    return counts


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the others, which are skipped as duplicates in their source."""
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where("_at = 1").drop("_at"), numbered.where("_at > 1").drop("_at").withColumn("reason", F.lit("duplicate-item-in-source"))


def mark_missing(sessions: DataFrame, present: DataFrame, path: str = "source_path") -> DataFrame:
    """``sessions`` with source_present 0 where the file is not among ``present``; nothing is ever deleted."""
    there = present.select(path).distinct().withColumn("_there", F.lit(1))
    return sessions.join(there, path, "left").withColumn("source_present", F.when(F.col("_there").isNull(), 0).otherwise(F.col("source_present"))).drop("_there").select(sessions.columns)


def prune(sessions: DataFrame, chunks: DataFrame, vectors: DataFrame, kind: str = "tool-invoked") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The archive without the prose, chunks and vectors of sessions of one provenance; their rows stay."""
    gone = sessions.where(F.col("provenance") == kind).select("session_id")
    bare = sessions.withColumn("text", F.when(F.col("provenance") == kind, F.lit("")).otherwise(F.col("text")))
    return bare, chunks.join(gone, "session_id", "left_anti"), vectors.join(gone, "session_id", "left_anti")


def digest(rows: DataFrame, kind: str, key: str, version: str, group: list[str] = []) -> DataFrame:
    """group..., digest: ``items-sha256:`` over the kind and the lines "key<tab>version" of the group, in whatever order they come.

    Two levels, so that no task ever holds all lines of a group: the lines' own hashes are sorted
    and hashed within 4,096 buckets by their first digits, and the buckets' hashes in order.
    """
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    line = F.concat_ws("\t", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(version).cast("string"), F.lit("")))
    lines = rows.select(*group, sha(line).alias("_line")).withColumn("_bucket", F.substr("_line", F.lit(1), F.lit(3)))
    buckets = lines.groupBy(*group, "_bucket").agg(sha(F.array_join(F.sort_array(F.collect_list("_line")), "\n")).alias("_hash"))
    joined = F.concat(F.lit(kind + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_bucket", "_hash"))), lambda b: b["_hash"]), "\n"))
    return (buckets.groupBy(*group) if group else buckets.groupBy()).agg(F.concat(F.lit("items-sha256:"), sha(joined)).alias("digest"))


def unsafe_to_delete(items: DataFrame, receipts: DataFrame, key: str = "item_id") -> DataFrame:
    """Items of a source without a receipt that isn't "skipped"; the source may be deleted when there are none."""
    vouched = receipts.where(F.col("disposition") != "skipped").select(key)
    return items.join(vouched, key, "left_anti")


def index_lag(listing: DataFrame, state: DataFrame) -> DataFrame:
    """source, files, new, changed: listed files the archive hasn't read, or read at another size."""
    known = state.select("source_path", F.col("size_bytes").alias("_size"))
    joined = listing.join(known, "source_path", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("_size").isNull()).alias("new"), F.count_if(F.col("_size") != F.col("size_bytes")).alias("changed"))


def failure_totals(failures: DataFrame) -> DataFrame:
    """source, category, total failures."""
    return failures.groupBy("source", "category").agg(F.sum("n_failures").alias("total"))


def trim_failures(failures: DataFrame, keep: int = 500) -> DataFrame:
    """The newest ``keep`` failures of each source, by id."""
    newest = Window.partitionBy("source").orderBy(F.desc("id"))
    return failures.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= keep).drop("_at")


def failures_with_sessions(failures: DataFrame, sessions: DataFrame) -> DataFrame:
    """Failures with ``recovered`` (the session has been archived) and ``missing`` (it is archived, its source gone)."""
    known = sessions.select("session_id", F.lit(True).alias("_known"), "source_present")
    joined = failures.join(known, "session_id", "left")
    return joined.select(*failures.columns, F.coalesce("_known", F.lit(False)).alias("recovered"), F.coalesce(F.col("source_present") == 0, F.lit(False)).alias("missing"))


def reconcile(sessions: DataFrame, listed: DataFrame | None, namespace: str, windowed: bool) -> tuple[DataFrame, str]:
    """``sessions`` with those of a plugged-in source marked gone that it no longer lists, and what was done.

    A source that lists only a window of its history is refused, one that lists nothing at all
    abstains (an empty answer is more likely a failure than a wish); only ids of ``namespace`` are touched.
    """
    if windowed:
        return sessions, "refused"
    if listed is None or not listed.limit(1).count():
        return sessions, "abstained"
    there = listed.select("session_id").distinct().withColumn("_there", F.lit(True))
    gone = F.col("session_id").startswith(namespace) & F.col("_there").isNull()
    return sessions.join(there, "session_id", "left").withColumn("source_present", F.when(gone, 0).otherwise(F.col("source_present"))).select(sessions.columns), "reconciled"


def file_digest(files: DataFrame) -> DataFrame:
    """source_path, digest: ``file-sha256:`` of each file's bytes (source_path, content)."""
    return files.select("source_path", F.concat(F.lit("file-sha256:"), F.sha2("content", 256)).alias("digest"))


def tree_digest(listing: DataFrame, root: str) -> DataFrame:
    """One row, digest: of the paths under ``root``, sizes and times of a listing (source_path, size_bytes, modified)."""
    relative = F.regexp_replace("source_path", "^" + root.rstrip("/") + "/", "")
    state = F.concat_ws("\t", F.col("size_bytes").cast("string"), F.unix_micros("modified").cast("string"))
    return digest(listing.select(relative.alias("_path"), state.alias("_state")), "tree", "_path", "_state")


class Commits:
    """Which folders make up each table under one root, as a chain of numbered commits.

    A commit is one small file that is written aside and then renamed, so it is there whole or not
    at all; the one with the highest number counts. Folders that no commit names are not read: a
    writer that dies before its commit leaves all tables as they were. One writer at a time; a
    second one that reaches the same number fails.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> tuple[int, dict[str, list[str]]]:
        """The number and the tables of the newest commit; 0 and none before the first."""
        folder = self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/commits/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, tables: dict[str, list[str]]) -> None:
        """Makes ``tables`` commit ``number``; FileExistsError if another writer was there first."""
        last, aside = self._path(f"{self.root}/commits/{number:012d}.json"), self._path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        if self._fs.exists(last):
            raise FileExistsError(str(last))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if not self._fs.rename(aside, last):
            raise FileExistsError(str(last))


def save(table: DataFrame, path: str) -> str:
    """Writes a snapshot under ``path`` and commits it; returns its folder."""
    commits = Commits(table.sparkSession, path)
    number, _ = commits.newest()
    folder = f"{commits.root}/snapshot-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    commits.commit(number + 1, {"": [folder]})
    return folder


def load(spark, path: str) -> DataFrame:
    """The newest snapshot of ``path``."""
    return spark.read.parquet(*Commits(spark, path).newest()[1][""])


def outcome(added: int, updated: int, unchanged: int, skipped: int, items: int, prior: bool, prose: bool = False) -> str:
    """How an import ended, from its counts and whether the same content was imported before (``prior``).

    A change makes it imported, or partial where something was skipped. Without one it is rejected if
    every item was skipped (prose indexes only where there is no prior import), a duplicate of a
    prior import, else imported.
    """
    if added + updated:
        return "partial" if skipped else "imported"
    refused = skipped > 0 and unchanged == 0 and items > 0
    if refused and not (prose and prior):
        return "rejected"
    return "duplicate" if prior else "imported"


def outcomes(imports: DataFrame) -> DataFrame:
    """``imports`` (added, updated, unchanged, skipped, item_count, prior, prose) with ``outcome``, as outcome() tells it."""
    changed = F.col("added") + F.col("updated") > 0
    refused = (F.col("skipped") > 0) & (F.col("unchanged") == 0) & (F.col("item_count") > 0) & ~(F.col("prose") & F.col("prior"))
    told = F.when(changed & (F.col("skipped") > 0), "partial").when(changed, "imported").when(refused, "rejected").when(F.col("prior"), "duplicate").otherwise("imported")
    return imports.withColumn("outcome", told)


def prose_dispositions(archive: DataFrame, incoming: DataFrame, origin: str = "prose-index") -> DataFrame:
    """session_id, disposition, reason of sessions read from a prose index: those the archive holds from a richer origin are skipped."""
    old = archive.select(F.col("session_id").alias("_id"), F.col("origin").alias("_origin"), F.col("ended_at").alias("_ended"))
    joined = incoming.select("session_id", "ended_at").join(old, F.col("session_id") == F.col("_id"), "left")
    richer = F.col("_id").isNotNull() & ~F.col("_origin").eqNullSafe(F.lit(origin))
    said = F.when(richer, "skipped").when(F.col("_id").isNull(), "added").when(F.col("ended_at").eqNullSafe(F.col("_ended")), "unchanged").otherwise("updated")
    return joined.select("session_id", said.alias("disposition"), F.when(richer, "superseded-by-richer-origin").alias("reason"))


def with_harvested(archive: DataFrame, summaries: DataFrame, facets: tuple[str, ...] = ("topic", "outcome", "summary", "facets_json")) -> DataFrame:
    """``archive`` with the facets of harvested summaries for sessions that have no topic yet, whatever their origin; enriched_words becomes words."""
    given = [c for c in facets if c in summaries.columns and c in archive.columns]
    new = summaries.groupBy("session_id").agg(F.max(F.struct(*given)).alias("_new"))
    joined = archive.join(new, "session_id", "left")
    takes = F.col("_new").isNotNull() & (F.coalesce("topic", F.lit("")) == "")
    columns = []
    for c in archive.columns:
        value = F.col(f"_new.{c}") if c in given else F.col("words") if c == "enriched_words" else None
        columns.append(F.col(c) if value is None else F.when(takes, value).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)
