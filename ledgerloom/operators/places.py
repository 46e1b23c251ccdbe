"""Which sessions belong to a place or a change: recall by repository, commits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import basename, comparable_path, moment
from ledgerloom.operators.current import label


def of_repo(sessions: DataFrame, repo: str) -> DataFrame:
    """Sessions whose folder's last part is ``repo``, in any case."""
    return sessions.where(F.lower(basename("cwd")) == repo.lower())


def current_repo(sessions: DataFrame) -> DataFrame:
    """One row: the folder name of the newest session that has one."""
    dated = sessions.where(F.col("cwd").isNotNull() & moment("started_at").isNotNull())
    return dated.agg(F.max_by(basename("cwd"), F.struct(moment("started_at").alias("_m"), "session_id")).alias("repo"))


def recall(sessions: DataFrame, repo: str, limit: int = 5) -> DataFrame:
    """kind, session_id, rank: unfinished sessions of a place, then the newest others, which never repeat the first."""
    own = of_repo(sessions, repo).select("session_id", "outcome", moment("started_at").alias("_m"))
    order = [F.desc_nulls_last("_m"), F.col("session_id")]
    unfinished = own.where(F.lower("outcome").isin("ongoing", "abandoned")).orderBy(*order).limit(limit)
    prior = own.join(F.broadcast(unfinished.select("session_id")), "session_id", "left_anti").orderBy(*order).limit(limit)  # at most ``limit`` ids
    return unfinished.select(F.lit("unfinished").alias("kind"), "session_id").unionByName(prior.select(F.lit("prior").alias("kind"), "session_id"))


def attributions(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """commit_id, session_id of the sessions of the commit's repository that were open when it was made.

    ``commits``: commit_id, repo, at. ``sessions``: session_id, cwd, started_at, ended_at; a session
    without an end lasts a moment. An equi-join on the repository and the days a session spans
    keeps the range condition from becoming a product: every session is listed once a day it
    was open (once a month if for longer than one), and a commit meets only the sessions of its
    repository on its day or in its month.
    """
    spans = sessions.select("session_id", F.lower(basename("cwd")).alias("repo"), moment("started_at").alias("_from"), F.coalesce(moment("ended_at"), moment("started_at")).alias("_to"))
    spans = spans.where(F.col("_from").isNotNull() & (F.col("_to") >= F.col("_from")) & (F.col("repo") != ""))
    first, last = F.to_date("_from"), F.to_date("_to")
    days = F.transform(F.sequence(first, last), lambda d: F.date_format(d, "yyyy-MM-dd"))
    months = F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    open_in = spans.withColumn("_when", F.explode(F.when(F.date_diff(last, first) <= 31, days).otherwise(months)))
    made = commits.where(F.col("repo").isNotNull() & F.col("at").isNotNull()).select("commit_id", F.lower("repo").alias("repo"), F.col("at").cast("timestamp").alias("_at"))
    made = made.withColumn("_when", F.explode(F.array(F.date_format("_at", "yyyy-MM-dd"), F.date_format("_at", "yyyy-MM"))))
    hit = made.join(open_in, ["repo", "_when"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to")))
    return hit.select("commit_id", "session_id").distinct()


def touching(files: DataFrame, path: str, repo: str = "") -> DataFrame:
    """session_id, rank: sessions that touched a file, 0 by its path, 1 by a path that ends in repo/tail."""
    seen = files.withColumn("_path", comparable_path("path"))
    target = F.lit(path.replace("\\", "/").lower())
    tail = F.lit(f"/{repo.lower()}/{path.lower()}" if repo else f"/{path.lower()}")
    rank = F.when(F.col("_path") == target, 0).when(F.col("_path").endswith(tail), 1)
    return seen.withColumn("rank", rank).where(F.col("rank").isNotNull()).groupBy("session_id").agg(F.min("rank").alias("rank"))


def uncommitted(files: DataFrame, attributed: DataFrame, path: str) -> DataFrame:
    """Sessions that touched a file and to which no commit is attributed."""
    return touching(files, path).join(attributed.select("session_id"), "session_id", "left_anti")


def why(commits: DataFrame, sessions: DataFrame, files: DataFrame, path: str, repo: str) -> DataFrame:
    """commit_id, at, session_id, confidence: the work behind each commit of a file, and work on it that was never committed.

    ``commits`` (commit_id, repo, at) are those of the file, ``sessions`` current rows (session_id,
    cwd, started_at, ended_at). Candidates are the sessions that touched the file (``touched-file``)
    or ran in its repository (``touched-repo``); a commit gets those that were open when it was made.
    Commits without any have a null session; sessions that touched the file and got no commit come
    with a null commit and ``uncommitted``.
    """
    touched = touching(files, path, repo).select("session_id", F.lit(0).alias("_rank"))
    here = of_repo(sessions, repo).select("session_id", F.lit(1).alias("_rank"))
    ranked = touched.unionByName(here).groupBy("session_id").agg(F.min("_rank").alias("_rank"))
    # all candidates are of one place, so that a commit meets those of the file whatever folder they ran in
    spans = sessions.join(ranked, "session_id").select("session_id", F.lit(repo).alias("cwd"), "started_at", "ended_at")
    mine = commits.where(F.lower("repo") == repo.lower()).select("commit_id", F.lit(repo).alias("repo"), "at")
    named = lambda rank: F.when(rank == 0, "touched-file").otherwise("touched-repo")
    found = attributions(mine, spans).join(ranked, "session_id").select("commit_id", "session_id", named(F.col("_rank")).alias("confidence"))
    explained = mine.select("commit_id", "at").join(found, "commit_id", "left").select("commit_id", "at", "session_id", "confidence")
    known = sessions.join(touched, "session_id", "left_semi").select("session_id")
    alone = known.join(found.select("session_id"), "session_id", "left_anti").distinct()
    at = dict(explained.dtypes)["at"]
    return explained.unionByName(alone.select(F.lit(None).cast(dict(explained.dtypes)["commit_id"]).alias("commit_id"), F.lit(None).cast(at).alias("at"), "session_id", F.lit("uncommitted").alias("confidence")))


def recall_all(sessions: DataFrame, repo: str, related: DataFrame | None, limit: int = 5, over: int = 3) -> DataFrame:
    """kind, session_id, score: unfinished work of a place, earlier work there, and related work elsewhere, no session twice.

    Only sessions of people and subagents are recalled. Earlier work is looked for among the newest
    ``over`` times ``limit``; ``related`` (session_id, repo, cosine) comes from vectors.related_elsewhere().
    """
    people = sessions.where(label("provenance").isin("human", "subagent"))
    own = of_repo(people, repo).select("session_id", "outcome", moment("started_at").alias("_m"))
    order = [F.desc_nulls_last("_m"), F.col("session_id")]
    unfinished = own.where(F.lower("outcome").isin("ongoing", "abandoned")).orderBy(*order).limit(limit).select("session_id")
    newest = own.orderBy(*order).limit(over * limit)
    prior = newest.join(F.broadcast(unfinished), "session_id", "left_anti").orderBy(*order).limit(limit).select("session_id")  # at most ``limit`` ids
    none = F.lit(None).cast("double")
    found = unfinished.select(F.lit("unfinished").alias("kind"), "session_id", none.alias("score")).unionByName(prior.select(F.lit("prior").alias("kind"), "session_id", none.alias("score")))
    if related is None:
        return found
    seen = unfinished.unionByName(prior)
    other = related.join(people.select("session_id"), "session_id", "left_semi").join(F.broadcast(seen), "session_id", "left_anti")  # at most 2 * ``limit`` ids
    other = other.orderBy(F.desc("cosine"), "session_id").limit(limit)
    return found.unionByName(other.select(F.lit("related").alias("kind"), "session_id", F.col("cosine").alias("score")))
