"""Structured filters over sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import basename, date_bounds, moment
from ledgerloom.operators.current import label


@dataclass(frozen=True)
class Filters:
    """What a session must have; None asks nothing. ``provenance`` None leaves out tool-invoked sessions only."""

    repo: str | None = None
    branch: str | None = None
    source: str | None = None
    model: str | None = None
    outcome: str | None = None
    since: str | None = None
    until: str | None = None
    provenance: str | None = None
    file: str | None = None
    tool: str | None = None


def apply(sessions: DataFrame, wanted: Filters, files: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """The sessions for which every filter holds.

    ``repo`` is a part of the last part of cwd, ``model`` a part of the model, both in any case;
    ``since`` and ``until`` are years, months or days and take the whole of them; ``file`` is a
    name, a path or the end of one that begins at a slash; ``tool`` a tool in any case. A null
    never equals anything, but a session of null provenance isn't tool-invoked.
    """
    rows = sessions
    if wanted.repo is not None:
        rows = rows.where(F.lower(basename("cwd")).contains(wanted.repo.lower()))
    if wanted.model is not None:
        rows = rows.where(F.lower("model").contains(wanted.model.lower()))
    for name in ("branch", "outcome"):
        if getattr(wanted, name) is not None:
            rows = rows.where(F.col(name) == getattr(wanted, name))
    if wanted.source is not None:
        rows = rows.where(label("source") == wanted.source)
    if wanted.since is not None:
        rows = rows.where(moment("started_at") >= F.lit(date_bounds(wanted.since)[0]).cast("timestamp"))
    if wanted.until is not None:
        rows = rows.where(moment("started_at") <= F.lit(date_bounds(wanted.until)[1]).cast("timestamp"))
    if wanted.provenance is not None:
        rows = rows.where(label("provenance") == wanted.provenance)
    else:
        rows = rows.where(F.coalesce(label("provenance"), F.lit("")) != "tool-invoked")
    if wanted.file is not None:
        hit = files.where((F.col("basename") == wanted.file) | (F.col("path") == wanted.file) | F.col("path").endswith("/" + wanted.file))
        rows = rows.join(hit.select("session_id"), "session_id", "left_semi")
    if wanted.tool is not None:
        rows = rows.join(tools.where(F.lower("tool") == wanted.tool.lower()).select("session_id"), "session_id", "left_semi")
    return rows


def by_prefix(sessions: DataFrame, prefix: str, shown: int = 20) -> DataFrame:
    """The ids that begin with ``prefix``, the first ``shown`` and one more to tell that there are others."""
    return sessions.where(F.col("session_id").startswith(prefix)).select("session_id").distinct().orderBy("session_id").limit(shown + 1)


def log(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest sessions by ``started_at``, undated ones last, ties by id."""
    return sessions.orderBy(F.desc_nulls_last(moment("started_at")), "session_id").limit(limit)


def with_parent_folder(sessions: DataFrame) -> DataFrame:
    """``sessions`` with ``shown_cwd``: a session's own folder, or its parent's where it has none."""
    parents = sessions.select(F.col("session_id").alias("parent_id"), F.col("cwd").alias("_parent_cwd")).where(F.col("parent_id").isNotNull())
    return sessions.join(parents, "parent_id", "left").withColumn("shown_cwd", F.coalesce("cwd", "_parent_cwd")).drop("_parent_cwd")
