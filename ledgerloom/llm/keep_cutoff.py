"""Score cutoffs that keep a target share of every group, from a persistent dyadic count tree.

A score (an integer of at least 0) is coded log-linearly into one of 2**DEPTH leaves: exact up
to 2**MANTISSA, above that MANTISSA significant bits. A binary tree over the leaves holds, per
group, the number of records below each node (nodes numbered as in a heap: 1 is the root, 2i
and 2i+1 are the children of i). The tree is a table (group, node, n) of at most 2**(DEPTH+1)
rows a group whatever the number of records; batches are added, or taken out again, by adding
their node counts. A cutoff is found by descending from the root to the leaf that holds the
target rank and then counting only that leaf's distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.archive import Commits
from ledgerloom.operators.current import current_rows, label
from ledgerloom.session import temporary_folder

MANTISSA = 6
DEPTH = 13  # 63-bit scores need (63 - MANTISSA + 1) * 2**MANTISSA < 2**12 leaves


def leaf_node(score: Column) -> Column:
    """The heap number of the leaf of an integer score of at least 0; keeps the order of scores."""
    score = score.cast("long")
    exponent = F.length(F.bin(score)) - 1
    base = F.lit(2**MANTISSA)
    shift = F.greatest(exponent - MANTISSA, F.lit(0))
    high = (shift.cast("long") * base + F.call_function("shiftright", score, shift)).cast("long")
    return F.lit(2**DEPTH).cast("long") + high


def node_counts(scores: DataFrame, group: list[str], score: str = "score", n: str | None = None) -> DataFrame:
    """The tree (group..., node, n) of a batch of scores; null and negative scores are left out.

    ``n`` names a column of counts, which may be negative to take records out again.
    """
    counts = scores.where(F.col(score) >= 0).withColumn("_node", leaf_node(F.col(score)))
    leaves = counts.groupBy(*group, "_node").agg(F.sum(F.col(n) if n else F.lit(1)).cast("long").alias("n"))
    path = F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda k: F.call_function("shiftright", F.col("_node"), k.cast("int")))
    return leaves.select(*group, "n", F.explode(path).alias("node")).groupBy(*group, "node").agg(F.sum("n").alias("n"))


def add_trees(*trees: DataFrame) -> DataFrame:
    """One tree of several batches' trees; nodes whose counts cancel out vanish."""
    first, *rest = trees
    group = [c for c in first.columns if c not in ("node", "n")]
    for tree in rest:
        first = first.unionByName(tree)
    return first.groupBy(*group, "node").agg(F.sum("n").alias("n")).where("n <> 0")


class KeptTree:
    """A tree under a folder, to which batches are added as they come; each is a part that one commit names.

    A batch is counted once: its name is part of the commit, and adding it again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, group: list[str]):
        self.spark, self.group, self.commits = spark, group, Commits(spark, folder)

    def add(self, name: str, scores: DataFrame, score: str = "score", n: str | None = None) -> bool:
        """Adds a batch's node counts, with ``n`` negative to take records out; False if a batch of this name is there already."""
        number, batches = self.commits.newest()
        if name in batches:
            return False
        part = f"{self.commits.root}/part-{number + 1:012d}"
        node_counts(scores, self.group, score, n).write.mode("overwrite").parquet(part)  # of a writer that died before its commit
        self.commits.commit(number + 1, {**batches, name: [part]})
        return True

    def tree(self) -> DataFrame:
        """The tree (group..., node, n) of all batches; at least one must have been added."""
        parts = sorted({part for of in self.commits.newest()[1].values() for part in of})
        return add_trees(self.spark.read.parquet(*parts))

    def compact(self) -> None:
        """Makes one part of all batches, whose names are kept."""
        number, batches = self.commits.newest()
        part = f"{self.commits.root}/part-{number + 1:012d}"
        self.tree().write.mode("overwrite").parquet(part)
        self.commits.commit(number + 1, {name: [part] for name in batches})


def descend(tree: DataFrame, targets: DataFrame, group: list[str], rank: Column) -> DataFrame:
    """``targets`` with n, the leaf (``node``) of the record of ``rank`` from the top, and its rank there (``need``).

    ``rank`` is an expression over ``targets`` and ``n``, the number of records of the group.
    A group's nodes are bounded in number, so its tree fits a map, which is walked in the JVM.
    """
    maps = tree.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("_tree"))
    at = targets.join(maps, group).withColumn("n", F.element_at("_tree", F.lit(1).cast("long")))
    at = at.withColumn("rank", rank.cast("long")).where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))

    def step(acc: Column, _: Column) -> Column:
        right = acc["node"] * 2 + 1
        there = F.coalesce(F.try_element_at("_tree", right), F.lit(0).cast("long"))
        return F.when(acc["need"] <= there, F.struct(right.alias("node"), acc["need"].alias("need"))).otherwise(F.struct((acc["node"] * 2).alias("node"), (acc["need"] - there).alias("need")))

    start = F.struct(F.lit(1).cast("long").alias("node"), F.col("rank").alias("need"))
    at = at.withColumn("_at", F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step))
    return at.select(*targets.columns, "n", "rank", F.col("_at.node").alias("node"), F.col("_at.need").alias("need"))


def refine(found: DataFrame, scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """``found`` of descend() with ``cutoff``, a score that occurs, and ``kept``, the number of records at or above it.

    Only scores of the chosen leaves are counted, after adding up equal ones.
    """
    leaves = found.select(*group, "node").distinct()
    valid = scores.where(F.col(score) >= 0).withColumn("node", leaf_node(F.col(score)))
    distinct = valid.join(leaves, [*group, "node"], "left_semi").groupBy(*group, "node", F.col(score).alias("cutoff")).agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*group, "node").orderBy(F.desc("cutoff"))
    runs = distinct.withColumn("_sum", F.sum("_n").over(above.rowsBetween(Window.unboundedPreceding, 0)))
    hit = found.join(runs, [*group, "node"]).where((F.col("_sum") >= F.col("need")) & (F.col("_sum") - F.col("_n") < F.col("need")))
    return hit.withColumn("kept", F.col("rank") - F.col("need") + F.col("_sum")).drop("_n", "_sum", "need", "node", "rank")


def cutoffs(scores: DataFrame, targets: DataFrame, group: list[str], score: str = "score", percent: str = "keep_pct", tree: DataFrame | None = None) -> DataFrame:
    """Per target the largest occurring score such that at least ``percent`` of the group's scores reach it.

    Columns: those of ``targets``, n, cutoff, kept. Scores that are null or negative don't count.
    Targets of groups without scores, with a null percentage or one above 100 give no row; a
    percentage of 0 or less keeps the records with the greatest score. Repeated targets count
    once. ``tree`` is a kept tree of the same records; without one it is built.
    """
    tree = node_counts(scores, group, score) if tree is None else tree
    need = F.greatest(F.lit(1), F.ceil(F.col(percent) * F.col("n") / 100))
    exact = F.floor((F.col(percent).cast("long") * F.col("n") + 99) / 100)
    kind = dict(targets.dtypes)[percent]
    rank = F.greatest(F.lit(1).cast("long"), exact.cast("long")) if kind in ("int", "bigint", "smallint", "tinyint") else need
    found = descend(tree, targets.where(F.col(percent).isNotNull()).distinct(), group, rank)
    return refine(found, scores, group, score)


def session_scores(sessions: DataFrame) -> DataFrame:
    """session_id, source, provenance (both as labels are compared) and ``score`` = words, of the current rows."""
    rows = current_rows(sessions, ["source", "provenance", "words"])
    return rows.select("session_id", label("source").alias("source"), label("provenance").alias("provenance"), F.col("words").cast("long").alias("score"))


def session_cutoffs(sessions: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Cutoffs of ``sessions.words`` for ``keep_targets`` (source, provenance, keep_pct), from a kept ``tree`` if one is given."""
    named = targets.select(label("source").alias("source"), label("provenance").alias("provenance"), F.struct("source", "provenance").alias("_as"), "keep_pct")
    found = cutoffs(session_scores(sessions), named, ["source", "provenance"], tree=tree)
    return found.select("source", "provenance", "_as", "keep_pct", "n", "cutoff", "kept")


def kept_sessions(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, provenance, session_id) of the sessions kept, labels as in ``targets``.

    A null label of a session or target equals none; sessions whose current row has null or
    negative words aren't kept and don't count; targets without sessions give no rows.
    """
    cuts = session_cutoffs(sessions, targets).select("source", "provenance", "_as", "cutoff")
    kept = session_scores(sessions).where(F.col("score") >= 0).join(cuts, ["source", "provenance"]).where(F.col("score") >= F.col("cutoff"))
    return kept.select("_as.source", "_as.provenance", "session_id").distinct()


def cutoffs_of_batches(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """What session_cutoffs() gives, from a kept tree that got the sessions in batches by length, one of them wrongly twice and once taken out again."""
    spark, scores = sessions.sparkSession, session_scores(sessions)
    kept = KeptTree(spark, temporary_folder(spark, "tree"), ["source", "provenance"])
    kept.add("short", scores.where("score < 300"))
    kept.add("long", scores.where("score >= 300"))
    kept.add("long", scores.where("score >= 300"))  # counts once
    kept.add("again", scores.where("score >= 300"))
    kept.add("undone", scores.where("score >= 300").withColumn("_n", F.lit(-1)), n="_n")
    kept.compact()
    return session_cutoffs(sessions, targets, kept.tree())
