"""The current row of each archived session."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c 　"


def label(column: str | Column) -> Column:
    """A label as it is compared: trimmed and in lower case; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def current_rows(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``session_id``: ``columns`` of the row with the greatest ``updated_at``.

    The maximum over a struct is combined on the map side, so a session with very many
    versions never gathers in one task. Rows without a ``session_id`` name no session and are
    left out; a null ``updated_at`` is older than any other; of different rows with the same
    ``updated_at`` the one with the most ``words`` counts, then the one with the greatest
    ``columns``, taken in order. Ask for short columns; see current_texts() for prose.
    """
    chosen = [c for c in columns if c not in ("session_id", "updated_at")]
    first = [F.coalesce(F.col("words"), F.lit(-(2**31))).alias("_words")] if "words" in sessions.columns and "words" not in chosen[:1] else []
    return (
        sessions.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.max(F.struct("updated_at", *first, *chosen)).alias("_row"))
        .select("session_id", "_row.updated_at", *[F.col(f"_row.{c}").alias(c) for c in chosen])
    )


def current_texts(sessions: DataFrame, columns: list[str] = [], text: str = "text") -> DataFrame:
    """session_id, ``text`` and ``columns`` of each session's current row, whose prose goes through no aggregation.

    The current version is found by time, words, a hash of its prose and the row's place in its file
    (which tells exact copies apart), and kept by a semi-join with these narrow marks: where they are
    small enough to be broadcast, no prose is shuffled at all, else each row once. Rows that come
    from no file have no place; copies among them are dropped afterwards.
    """
    words = F.coalesce(F.col("words"), F.lit(-(2**31))) if "words" in sessions.columns else F.lit(0)
    kept = [c for c in columns if c not in ("session_id", "updated_at", text)]
    filed = True
    try:
        place = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
        sessions.select(*place)
    except AnalysisException:
        filed = False
        place = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    mark = F.struct(words.alias("w"), F.xxhash64(text, *kept).alias("h"), place[0].alias("f"), place[1].alias("i"))
    rows = sessions.where(F.col("session_id").isNotNull()).select("session_id", "updated_at", mark.alias("_mark"), text, *kept)
    newest = rows.groupBy(F.col("session_id").alias("_id")).agg(F.max(F.struct("updated_at", "_mark")).alias("_m")).select("_id", F.col("_m.updated_at").alias("_at"), F.col("_m._mark").alias("_of"))
    found = rows.join(newest, (F.col("session_id") == F.col("_id")) & F.col("updated_at").eqNullSafe(F.col("_at")) & (F.col("_mark") == F.col("_of")), "left_semi").drop("_mark", "updated_at")
    return found if filed else found.dropDuplicates(["session_id"])
