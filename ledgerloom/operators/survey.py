"""Statistics of an archive: summaries by nearest rank, coverage, histograms, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import TOOL_FOLDERS, basename, model_name, moment, path_depth

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
CLASSES = ("human", "subagent", "tool-invoked")
TARGET = 85.0


def nearest_rank(column: str, percent: float, kind: str | None = None) -> Column:
    """The value at rank ceil(percent/100 * n) of the values in order; ``kind`` is the column's type."""
    rank = F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{column}`)")
    return rank.cast(kind) if kind else rank


def summarize(rows: DataFrame, column: str, group: list[str] = []) -> DataFrame:
    """group..., count, total, min, p10 ... p99, max, mean; no rows at all: count 0, total 0 and the rest null."""
    ranks = [nearest_rank(column, p, dict(rows.dtypes)[column]).alias("median" if p == 50 else f"p{p}") for p in PERCENTILES]
    measures = [F.count(column).alias("count"), F.coalesce(F.sum(column), F.lit(0)).alias("total"), F.min(column).alias("min"), *ranks, F.max(column).alias("max"), F.round(F.avg(column), 3).alias("mean")]
    return (rows.groupBy(*group) if group else rows.groupBy()).agg(*measures)


def by_class(rows: DataFrame, measure: str, source: str = "source", provenance: str = "provenance") -> DataFrame:
    """A summary for each source and each class of provenance, with zero rows for classes a source lacks."""
    known = rows.select(source).distinct().withColumn(provenance, F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    found = summarize(rows, measure, [source, provenance])
    return known.join(found, [source, provenance], "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))


def coverage_gate(rows: DataFrame, words: str, group: list[str], target: float = TARGET) -> DataFrame:
    """group..., threshold, sessions, coverage, share: how long sessions must be so that the longest of them hold ``target`` % of the words.

    Equal lengths are added up first, so the running sum sees one row a length however many
    sessions there are; within the length at which the target is met, just as many sessions
    count as it takes. Groups without words give threshold 0.
    """
    lengths = rows.where(F.col(words).isNotNull()).groupBy(*group, words).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(*group)
    longest = total.orderBy(F.desc(words)).rowsBetween(Window.unboundedPreceding, -1)
    runs = lengths.select(*group, F.col(words).cast("double").alias("_w"), "_n", F.sum(F.col(words) * F.col("_n")).over(total).alias("_all"), F.sum("_n").over(total).alias("_count"), F.coalesce(F.sum(F.col(words) * F.col("_n")).over(longest), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(longest), F.lit(0)).alias("_ahead"))
    need = F.col("_all") * target / 100
    met = runs.where((F.col("_all") > 0) & (F.col("_before") < need) & (F.col("_before") + F.col("_w") * F.col("_n") >= need))
    extra = F.greatest(F.lit(1), F.ceil((need - F.col("_before")) / F.col("_w")))
    gate = met.select(*group, F.col("_w").cast("long").alias("threshold"), (F.col("_ahead") + extra).cast("long").alias("sessions"), F.round((F.col("_before") + extra * F.col("_w")) / F.col("_all") * 100, 2).alias("coverage"), F.round((F.col("_ahead") + extra) / F.col("_count") * 100, 2).alias("share"))
    empty = rows.select(*group).distinct().join(gate, group, "left_anti").select(*group, F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("sessions"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("share"))
    return gate.unionByName(empty)


def gate_effect(rows: DataFrame, words: str, threshold: int, group: list[str]) -> DataFrame:
    """group..., coverage and share (%) of the sessions of at least ``threshold`` words."""
    long_ones = F.col(words) >= threshold
    held = F.sum(F.when(long_ones, F.col(words)).otherwise(0))
    return rows.groupBy(*group).agg(F.round(F.coalesce(held / F.nullif(F.sum(words), F.lit(0)) * 100, F.lit(0.0)), 2).alias("coverage"), F.round(F.count_if(long_ones) / F.count(F.lit(1)) * 100, 2).alias("share"))


def months(rows: DataFrame, group: list[str], started: str = "started_at") -> DataFrame:
    """group..., month (``2026-03``, null for undated ones), sessions."""
    return rows.groupBy(*group, F.date_format(moment(started), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("sessions"))


def age_buckets(rows: DataFrame, now: str, started: str = "started_at", days: int = 10) -> DataFrame:
    """bucket (``0-9`` days, ``10-19`` ...), sessions; undated ones are left out and those of the future count as 0 days."""
    age = F.greatest(F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(moment(started))) / 86400), F.lit(0))
    low = (F.floor(age / days) * days).cast("long")
    return rows.where(moment(started).isNotNull()).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("sessions")).select(F.concat_ws("-", F.col("low").cast("string"), (F.col("low") + days - 1).cast("string")).alias("bucket"), "sessions")


def model_usage(rows: DataFrame) -> DataFrame:
    """model (plain name), sessions; ordered by number, then name."""
    return rows.select(model_name("model").alias("model")).where(F.col("model").isNotNull()).groupBy("model").agg(F.count(F.lit(1)).alias("sessions"))


def projects(rows: DataFrame, top: int = 5) -> DataFrame:
    """repo, sessions, share (%) of the ``top`` folders by sessions; sessions without a folder are left out."""
    named = rows.where(F.col("cwd").isNotNull()).groupBy(basename("cwd").alias("repo")).agg(F.count(F.lit(1)).alias("sessions"))
    total = named.agg(F.sum("sessions")).first()[0]  # one number
    return named.orderBy(F.desc("sessions"), "repo").limit(top).select("repo", "sessions", F.round(F.col("sessions") / total * 100, 2).alias("share"))


def folder_structure(rows: DataFrame) -> DataFrame:
    """One row: folders, and their least, median and greatest depth."""
    depths = rows.where(F.col("cwd").isNotNull()).select("cwd").distinct().select(path_depth("cwd").alias("depth"))
    return depths.agg(F.count("depth").alias("folders"), F.min("depth").alias("least"), nearest_rank("depth", 50, "int").alias("median"), F.max("depth").alias("greatest"))


def monthly_medians(rows: DataFrame, measure: str, current_month: str) -> DataFrame:
    """month, median of the complete months before ``current_month``."""
    dated = rows.withColumn("month", F.date_format(moment("started_at"), "yyyy-MM")).where((F.col("month") < current_month) & F.col(measure).isNotNull())
    return dated.groupBy("month").agg(nearest_rank(measure, 50, dict(rows.dtypes)[measure]).alias("median"), F.count(F.lit(1)).alias("sessions"))


def chunk_totals(rows: DataFrame, words: str = "words") -> DataFrame:
    """One row: sessions, words and the search and model windows they make."""
    from ledgerloom.operators.chunks import chunk_count, enrich_count

    n = F.greatest(F.coalesce(F.col(words), F.lit(0)), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("sessions"), F.sum(n).alias("words"), F.sum(chunk_count(n)).alias("chunks"), F.sum(enrich_count(n)).alias("calls"))


def drift(before: DataFrame, after: DataFrame, key: str = "source", growth: float = 2.0, points: float = 10.0) -> DataFrame:
    """key, before, after, finding for two counts (key, sessions): new, gone, grew, shrank or mix, the most telling one.

    grew: at least ``growth`` times as many; mix: the share of all moved by more than ``points``.
    """
    total = lambda rows: rows.agg(F.sum("sessions")).first()[0]  # noqa: E731  (one number)
    a = before.select(key, F.col("sessions").alias("before"), (F.col("sessions") / F.lit(total(before)) * 100).alias("_was"))
    b = after.select(key, F.col("sessions").alias("after"), (F.col("sessions") / F.lit(total(after)) * 100).alias("_is"))
    both = a.join(b, key, "full_outer")
    moved = F.abs(F.coalesce("_is", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))) > points
    finding = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("after") >= growth * F.col("before"), "grew").when(F.col("after") < F.col("before"), "shrank").when(moved, "mix")
    return both.select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), finding.alias("finding"))


def anomalies(rows: DataFrame) -> DataFrame:
    """source, finding, value: what is odd about a source's sessions (source, provenance, source_present, cwd, started_at).

    many-tool and many-subagent from 25 %, no-human, few (under 30 conversations), irreplaceable
    (sessions whose file is gone), one-folder (one holds 40 %), short-history (under three months).
    """
    share = lambda kind: F.count_if(F.col("provenance") == kind) / F.count(F.lit(1)) * 100
    human = F.count_if(F.col("provenance") == "human")
    facts = rows.groupBy("source").agg(share("tool-invoked").alias("tool"), share("subagent").alias("sub"), human.alias("human"), F.count_if(F.col("source_present") == 0).alias("gone"), F.count_distinct(F.date_format(moment("started_at"), "yyyy-MM")).alias("months"), F.count("cwd").alias("placed"))
    folders = rows.where(F.col("cwd").isNotNull()).groupBy("source", "cwd").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("top"))
    facts = facts.join(folders, "source", "left")
    tests = [("many-tool", F.col("tool") >= 25, "tool"), ("many-subagent", F.col("sub") >= 25, "sub"), ("no-human", F.col("human") == 0, "human"), ("few", F.col("human") < 30, "human"), ("irreplaceable", F.col("gone") > 0, "gone"), ("one-folder", F.col("top") >= 0.4 * F.col("placed"), "top"), ("short-history", F.col("months") < 3, "months")]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("finding"), F.round(F.col(value).cast("double"), 2).alias("value"))) for name, test, value in tests]))
    return facts.select("source", F.explode(found).alias("_f")).select("source", "_f.finding", "_f.value")


def projects_summary(rows: DataFrame) -> DataFrame:
    """One row: projects, and the summary of sessions per project; sessions without a folder are left out."""
    named = rows.where(F.col("cwd").isNotNull()).groupBy(basename("cwd").alias("repo")).agg(F.count(F.lit(1)).alias("sessions"))
    return summarize(named, "sessions").withColumnRenamed("count", "projects")


def state_folders(rows: DataFrame) -> DataFrame:
    """source, placed, in_state, share (%): sessions with a folder, and those among them in folders programs keep their state in."""
    here = F.lit(False)
    for marker in TOOL_FOLDERS:
        here = here | F.col("cwd").contains(marker)
    placed, inside = F.count("cwd"), F.count_if(F.col("cwd").isNotNull() & here)
    return rows.groupBy("source").agg(placed.alias("placed"), inside.alias("in_state"), F.round(F.coalesce(inside / F.nullif(placed, F.lit(0)) * 100, F.lit(0.0)), 2).alias("share"))


def tokens_by_class(rows: DataFrame) -> DataFrame:
    """source, provenance, sessions, counted (those that know their tokens), tokens."""
    return rows.groupBy("source", "provenance").agg(F.count(F.lit(1)).alias("sessions"), F.count("tokens").alias("counted"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def survey(rows: DataFrame, words: str = "w", target: float = TARGET) -> DataFrame:
    """One row a source, what a later drift() compares with: conversations, threshold, coverage and share of its gate, sessions of each class, irreplaceable ones."""
    talks = rows.where(F.col("provenance").isin("human", "subagent"))
    gate = coverage_gate(talks, words, ["source"], target).select("source", "threshold", "coverage", "share")
    of = lambda kind: F.count_if(F.col("provenance") == kind)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("sessions"), *[of(c).alias(c.replace("-", "_")) for c in CLASSES], F.count_if(F.col("source_present") == 0).alias("irreplaceable"))
    counts = counts.withColumn("conversations", F.col("human") + F.col("subagent"))
    joined = counts.join(gate, "source", "left")
    return joined.withColumns({"threshold": F.coalesce("threshold", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0)), "share": F.coalesce("share", F.lit(0.0))})


def document(surveyed: DataFrame) -> DataFrame:
    """One row: the survey as a JSON document, sources in order; a source is one short struct, so the list is as long as there are sources."""
    one = F.struct(*sorted(surveyed.columns))
    return surveyed.agg(F.to_json(F.struct(F.lit(1).alias("schema"), F.sum("sessions").alias("sessions"), F.sort_array(F.collect_list(F.struct("source", one.alias("report")))).alias("sources"))).alias("document"))


def drifted(surveyed: DataFrame, rows: DataFrame, words: str = "w", growth: float = 2.0, coverage: float = 5.0, share: float = 10.0, mix: float = 10.0) -> DataFrame:
    """source, finding, was, now: why a survey no longer describes the archive; source null for the whole of it.

    grew (``growth`` times as many sessions) and shrank; new-source; coverage and selection (what the
    stored gate covers and selects now, against then); mix (a source's share of conversations).
    """
    talks = rows.where(F.col("provenance").isin("human", "subagent"))
    live = talks.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    gates = surveyed.select("source", "threshold", F.col("coverage").alias("_coverage"), F.col("share").alias("_share"), F.col("conversations").alias("_was"))
    # the gate of a source is one number, so it travels with the few rows of the survey
    measured = talks.join(F.broadcast(gates.select("source", "threshold")), "source")  # a row a source
    long_ones = F.col(words) >= F.col("threshold")
    effect = measured.groupBy("source").agg(F.coalesce(F.sum(F.when(long_ones, F.col(words)).otherwise(0)) / F.nullif(F.sum(words), F.lit(0)) * 100, F.lit(0.0)).alias("_covers"), (F.count_if(long_ones) / F.count(F.lit(1)) * 100).alias("_selects"))
    both = gates.join(live, "source", "full_outer").join(effect, "source", "left")
    total = both.agg(F.sum("_was").alias("was"), F.sum("_n").alias("now")).first()  # two numbers
    part = lambda c, of: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(of or 1)) * 100
    tests = [
        ("new-source", F.col("_was").isNull(), F.lit(0.0), F.col("_n")),
        ("coverage", (F.col("threshold") > 0) & (F.abs(F.col("_covers") - F.col("_coverage")) > coverage), F.col("_coverage"), F.col("_covers")),
        ("selection", (F.col("threshold") > 0) & (F.abs(F.col("_selects") - F.col("_share")) > share), F.col("_share"), F.col("_selects")),
        ("mix", F.abs(part("_n", total["now"]) - part("_was", total["was"])) > mix, part("_was", total["was"]), part("_n", total["now"])),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("finding"), F.round(was.cast("double"), 2).alias("was"), F.round(now.cast("double"), 2).alias("now"))) for name, test, was, now in tests]))
    of_source = both.select("source", F.explode(found).alias("_f")).select("source", "_f.*")
    was = float(surveyed.agg(F.sum("sessions")).first()[0] or 0)  # one number each
    now = float(rows.count())
    finding = "grew" if was and now >= growth * was else "shrank" if now < was else None
    whole = rows.sparkSession.createDataFrame([(None, finding, was, now)], "source string, finding string, was double, now double")
    return of_source.unionByName(whole.where(F.col("finding").isNotNull()))


def lag_anomalies(lag: DataFrame, swept: bool) -> DataFrame:
    """source, finding, value: behind (files new or changed since they were read), or never-swept where nothing lags but no sweep ever ended."""
    behind = lag.select("source", F.lit("behind").alias("finding"), (F.col("new") + F.col("changed")).cast("double").alias("value")).where("value > 0")
    if swept or not behind.isEmpty():
        return behind
    return behind.sparkSession.createDataFrame([(None, "never-swept", 0.0)], "source string, finding string, value double")


def file_anomalies(rows: DataFrame, failures: DataFrame, now: str) -> DataFrame:
    """source, finding, value: failures (more than 10 and 5 % of the files), young (oldest session under 40 days), very-young (under 15)."""
    days = lambda t: (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(t)) / 86400
    facts = rows.groupBy("source").agg(F.count_distinct("source_path").alias("files"), F.floor(days(F.min(moment("started_at")))).cast("double").alias("oldest"))
    failed = failures.groupBy("source").agg(F.sum("n_failures").cast("double").alias("failed"))
    facts = facts.join(failed, "source", "left")
    tests = [("failures", F.col("failed") > F.greatest(F.lit(10.0), 0.05 * F.col("files")), "failed"), ("very-young", F.col("oldest") < 15, "oldest"), ("young", F.col("oldest").between(15, 39), "oldest")]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("finding"), F.col(value).alias("value"))) for name, test, value in tests]))
    return facts.select("source", F.explode(found).alias("_f")).select("source", "_f.*")
