"""Statistics of the archive and of the driver's event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import survey
from ledgerloom.operators.current import label
from ledgerloom.plans.archive import current
from ledgerloom.plans.registry import CUR, query
from ledgerloom.session import table

MEASURED = f"{CUR}, fine AS (SELECT *, greatest(words, 0) AS w FROM cur WHERE words IS NOT NULL)"
RANKS = ", ".join(f"quantile_disc(w, {p / 100}) AS {'median' if p == 50 else f'p{p}'}" for p in survey.PERCENTILES)
SUMMARY = f"count(w) AS count, coalesce(sum(w), 0)::BIGINT AS total, min(w) AS min, {RANKS}, max(w) AS max, round(avg(w), 3) AS mean"


def measured(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows that have words, with ``w``, the words with negative ones as 0, and plain labels."""
    rows = current(spark, folder).where(F.col("words").isNotNull())
    return rows.withColumn("w", F.greatest("words", F.lit(0))).withColumn("source", label("source")).withColumn("provenance", label("provenance"))


@query(f"WITH {CUR} SELECT s AS source, p AS provenance, count(*) AS sessions, sum(words)::BIGINT AS words FROM cur GROUP BY ALL")
def provenance_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder)
    return rows.groupBy(label("source").alias("source"), label("provenance").alias("provenance")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("words").alias("words"))


@query(f"WITH {CUR} SELECT s AS source, count_if(source_present = 0) AS irreplaceable, count_if(topic IS NOT NULL) AS enriched, round(count_if(topic IS NOT NULL) / count(*) * 100, 2) AS coverage FROM cur GROUP BY s")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder)
    told = F.count_if(F.col("topic").isNotNull())
    return rows.groupBy(label("source").alias("source")).agg(F.count_if(F.col("source_present") == 0).alias("irreplaceable"), told.alias("enriched"), F.round(told / F.count(F.lit(1)) * 100, 2).alias("coverage"))


@query(f"WITH {MEASURED} SELECT {SUMMARY} FROM fine")
def summary_all(spark: SparkSession, folder: str) -> DataFrame:
    return survey.summarize(measured(spark, folder), "w")


@query(f"""WITH {MEASURED}, k AS (SELECT DISTINCT s AS source, unnest(['human', 'subagent', 'tool-invoked']) AS provenance FROM fine),
g AS (SELECT s AS source, p AS provenance, {SUMMARY} FROM fine GROUP BY s, p)
SELECT k.source, k.provenance, coalesce(g.count, 0) AS count, coalesce(g.total, 0) AS total, g.* EXCLUDE (source, provenance, count, total) FROM k LEFT JOIN g USING (source, provenance)""")
def summary_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return survey.by_class(measured(spark, folder), "w")


@query(f"""WITH {MEASURED}, r AS (SELECT s, w, sum(w) OVER (PARTITION BY s ORDER BY w DESC, session_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY s ORDER BY w DESC, session_id) AS k, sum(w) OVER (PARTITION BY s) AS total, count(*) OVER (PARTITION BY s) AS n FROM fine)
SELECT s AS source, arg_min(w, k)::BIGINT AS threshold, min(k) AS sessions, round(arg_min(run, k) / arg_min(total, k) * 100, 2) AS coverage, round(min(k) / arg_min(n, k) * 100, 2) AS share FROM r WHERE run >= total * 0.85 AND total > 0 GROUP BY s""")
def coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    return survey.coverage_gate(measured(spark, folder), "w", ["source"])


@query(f"WITH {MEASURED} SELECT s AS source, round(coalesce(sum(CASE WHEN w >= 500 THEN w ELSE 0 END) / nullif(sum(w), 0) * 100, 0), 2) AS coverage, round(count_if(w >= 500) / count(*) * 100, 2) AS share FROM fine GROUP BY s")
def gate_effect(spark: SparkSession, folder: str) -> DataFrame:
    return survey.gate_effect(measured(spark, folder), "w", 500, ["source"])


@query(f"WITH {CUR} SELECT s AS source, strftime(make_timestamp(start_us), '%Y-%m') AS month, count(*) AS sessions FROM cur GROUP BY ALL")
def month_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return survey.months(current(spark, folder).withColumn("source", label("source")), ["source"])


@query(f"""WITH {CUR}, a AS (SELECT greatest(floor((epoch(TIMESTAMP '2026-12-01') - floor(start_us / 1000000.0)) / 86400), 0)::BIGINT AS age FROM cur WHERE start_us IS NOT NULL), b AS (SELECT age // 10 * 10 AS low, count(*) AS sessions FROM a GROUP BY 1)
SELECT low || '-' || (low + 9) AS bucket, sessions FROM b""")
def age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return survey.age_buckets(current(spark, folder), "2026-12-01 00:00:00")


@query(f"WITH {CUR} SELECT model, count(*) AS sessions FROM cur WHERE model IS NOT NULL AND model <> '' GROUP BY model")
def model_usage(spark: SparkSession, folder: str) -> DataFrame:
    return survey.model_usage(current(spark, folder))


@query("SELECT lower(tool) AS tool, count(DISTINCT session_id) AS sessions, sum(uses)::BIGINT AS uses FROM (SELECT DISTINCT * FROM session_tools) GROUP BY 1")
def tool_usage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "session_tools").distinct()
    return rows.groupBy(F.lower("tool").alias("tool")).agg(F.count_distinct("session_id").alias("sessions"), F.sum("uses").alias("uses"))


@query("SELECT basename, count(DISTINCT session_id) AS sessions, count(DISTINCT path) AS paths FROM session_files GROUP BY basename ORDER BY sessions DESC, basename LIMIT 25")
def busiest_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file names most sessions touched; distinct pairs first, so the hot name is spread over tasks."""
    pairs = table(spark, folder, "session_files").select("basename", "session_id", "path").distinct()
    counted = pairs.groupBy("basename").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("path").alias("paths"))
    return counted.orderBy(F.desc("sessions"), "basename").limit(25)


@query(f"WITH {CUR}, r AS (SELECT repo, count(*) AS sessions FROM cur WHERE cwd IS NOT NULL GROUP BY repo) SELECT repo, sessions, round(sessions / (SELECT sum(sessions) FROM r) * 100, 2) AS share FROM r ORDER BY sessions DESC, repo LIMIT 5")
def top_projects(spark: SparkSession, folder: str) -> DataFrame:
    return survey.projects(current(spark, folder))


@query(f"WITH {CUR}, d AS (SELECT DISTINCT cwd, len(list_filter(string_split(cwd, '/'), lambda x: x <> '' AND x <> '.'))::INT AS depth FROM cur WHERE cwd IS NOT NULL) SELECT count(*) AS folders, min(depth) AS least, quantile_disc(depth, 0.5) AS median, max(depth) AS greatest FROM d")
def folder_structure(spark: SparkSession, folder: str) -> DataFrame:
    return survey.folder_structure(current(spark, folder))


@query(f"WITH {MEASURED} SELECT strftime(make_timestamp(start_us), '%Y-%m') AS month, quantile_disc(w, 0.5) AS median, count(*) AS sessions FROM fine WHERE strftime(make_timestamp(start_us), '%Y-%m') < '2026-12' GROUP BY 1")
def monthly_medians(spark: SparkSession, folder: str) -> DataFrame:
    return survey.monthly_medians(measured(spark, folder), "w", "2026-12")


@query(f"""WITH {MEASURED} SELECT count(*) AS sessions, sum(w)::BIGINT AS words,
  sum(CASE WHEN w <= 0 THEN 0 WHEN w <= 400 THEN 1 ELSE 1 + ceil((w - 400) / 320.0) END)::BIGINT AS chunks,
  sum(CASE WHEN w <= 0 THEN 0 WHEN w <= 12000 THEN 1 ELSE ceil(w / 11600.0) END)::BIGINT AS calls FROM fine""")
def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    return survey.chunk_totals(measured(spark, folder), "w")


@query(f"""WITH {CUR}, a AS (SELECT s AS source, count(*) AS n FROM cur WHERE ingested_at < TIMESTAMP '2026-06-01' GROUP BY s), b AS (SELECT s AS source, count(*) AS n FROM cur GROUP BY s),
j AS (SELECT source, a.n AS x, b.n AS y, a.n / (SELECT sum(n) FROM a) * 100 AS was, b.n / (SELECT sum(n) FROM b) * 100 AS now FROM a FULL JOIN b USING (source))
SELECT source, coalesce(x, 0) AS before, coalesce(y, 0) AS after, CASE WHEN x IS NULL THEN 'new' WHEN y IS NULL THEN 'gone' WHEN y >= 2 * x THEN 'grew' WHEN y < x THEN 'shrank' WHEN abs(coalesce(now, 0) - coalesce(was, 0)) > 10 THEN 'mix' END AS finding FROM j""")
def source_drift(spark: SparkSession, folder: str) -> DataFrame:
    """How the mix of sources moved between June and now."""
    rows = current(spark, folder).withColumn("source", label("source"))
    counts = lambda of: of.groupBy("source").agg(F.count(F.lit(1)).alias("sessions"))
    return survey.drift(counts(rows.where(F.col("ingested_at") < F.lit("2026-06-01").cast("timestamp_ntz"))), counts(rows))


@query(f"WITH {CUR} SELECT s AS source, min(start_us) AS earliest, max(start_us) AS latest, max(updated_at) AS updated FROM cur GROUP BY s")
def spans(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerloom.functions.text import moment

    rows = current(spark, folder).withColumn("_us", F.unix_micros(moment("started_at")))
    return rows.groupBy(label("source").alias("source")).agg(F.min("_us").alias("earliest"), F.max("_us").alias("latest"), F.max("updated_at").alias("updated"))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events),
g AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS started, count(*) AS events FROM g GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Visits: a user's events with less than half an hour between them."""
    from ledgerloom.streaming.ingest import visits

    return visits(table(spark, folder, "events")).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "events")


@query("""
SELECT o_orderpriority, sum(l_quantity)::DOUBLE AS quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderpriority""")
def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A large equi-join with a filter that reaches the scan, summed before the shuffle."""
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("o_orderpriority").agg(F.sum("q").alias("quantity"), F.sum("n").alias("lines"))


@query(f"""WITH {CUR}, g AS (SELECT s, count_if(p = 'tool-invoked') / count(*) * 100 AS tool, count_if(p = 'subagent') / count(*) * 100 AS sub, count_if(p = 'human') AS human, count_if(source_present = 0) AS gone, count(DISTINCT strftime(make_timestamp(start_us), '%Y-%m')) AS months, count(cwd) AS placed FROM cur GROUP BY s),
f AS (SELECT s, max(n) AS top FROM (SELECT s, cwd, count(*) AS n FROM cur WHERE cwd IS NOT NULL GROUP BY ALL) GROUP BY s), x AS (SELECT g.*, f.top FROM g LEFT JOIN f USING (s))
SELECT s AS source, 'many-tool' AS finding, round(tool::DOUBLE, 2) AS value FROM x WHERE tool >= 25 UNION ALL SELECT s, 'many-subagent', round(sub::DOUBLE, 2) FROM x WHERE sub >= 25
UNION ALL SELECT s, 'no-human', human::DOUBLE FROM x WHERE human = 0 UNION ALL SELECT s, 'few', human::DOUBLE FROM x WHERE human < 30 UNION ALL SELECT s, 'irreplaceable', gone::DOUBLE FROM x WHERE gone > 0
UNION ALL SELECT s, 'one-folder', top::DOUBLE FROM x WHERE top >= 0.4 * placed UNION ALL SELECT s, 'short-history', months::DOUBLE FROM x WHERE months < 3""")
def source_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder)
    return survey.anomalies(rows.withColumn("source", label("source")).withColumn("provenance", label("provenance")))


@query(f"WITH {CUR}, g AS (SELECT repo, count(*) AS w FROM cur WHERE cwd IS NOT NULL GROUP BY repo) SELECT {SUMMARY.replace('AS count', 'AS projects')} FROM g")
def projects_summary(spark: SparkSession, folder: str) -> DataFrame:
    return survey.projects_summary(current(spark, folder))


@query(f"WITH {CUR}, g AS (SELECT s AS source, count(cwd) AS placed, count_if(contains(cwd, '/.local/state/') OR contains(cwd, '/.cache/') OR contains(cwd, '/Library/Caches/') OR contains(cwd, '/AppData/Local/')) AS in_state FROM cur GROUP BY s) SELECT *, round(coalesce(in_state / nullif(placed, 0) * 100, 0), 2) AS share FROM g")
def state_folders(spark: SparkSession, folder: str) -> DataFrame:
    return survey.state_folders(current(spark, folder).withColumn("source", label("source")))


@query(f"WITH {CUR} SELECT s AS source, p AS provenance, count(*) AS sessions, count(tokens) AS counted, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM cur GROUP BY ALL")
def tokens_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return survey.tokens_by_class(current(spark, folder).withColumn("source", label("source")).withColumn("provenance", label("provenance")))


SIGNS = ("subagent_path", "cwd_state_dir", "zero_user_turns", "single_user_turn_under_2s")


@query(f"""WITH {CUR}, r AS (SELECT s AS source, unnest(list_filter([CASE WHEN parent_id IS NOT NULL THEN 'subagent_path' END, CASE WHEN contains(coalesce(cwd, ''), '/.cache/') THEN 'cwd_state_dir' END, CASE WHEN user_turns = 0 THEN 'zero_user_turns' END, CASE WHEN user_turns = 1 AND duration_s < 2.0 THEN 'single_user_turn_under_2s' END], lambda x: x IS NOT NULL)) AS rule FROM cur)
SELECT source, rule, count(*) AS sessions FROM r GROUP BY ALL""")
def rule_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How often each sign of who held a session fired, by source."""
    from ledgerloom.functions.text import provenance_rules

    no = F.lit(False)
    rows = current(spark, folder)
    fired = provenance_rules(F.col("parent_id").isNotNull(), no, no, no, no, F.coalesce("cwd", F.lit("")).contains("/.cache/"), F.col("user_turns"), F.col("duration_s"))
    told = rows.select(label("source").alias("source"), F.explode(fired).alias("rule")).where(F.col("rule") != "default_human")
    return told.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("sessions"))


SURVEY = f"""{MEASURED}, old AS (SELECT * FROM fine WHERE ingested_at < TIMESTAMP '2026-07-01'),
r AS (SELECT s, w, sum(w) OVER (PARTITION BY s ORDER BY w DESC, session_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY s ORDER BY w DESC, session_id) AS k, sum(w) OVER (PARTITION BY s) AS total, count(*) OVER (PARTITION BY s) AS n FROM old WHERE p IN ('human', 'subagent')),
gate AS (SELECT s AS source, arg_min(w, k)::BIGINT AS threshold, round(arg_min(run, k) / arg_min(total, k) * 100, 2) AS coverage, round(min(k) / arg_min(n, k) * 100, 2) AS share FROM r WHERE run >= total * 0.85 AND total > 0 GROUP BY s),
surveyed AS (SELECT c.*, coalesce(threshold, 0) AS threshold, coalesce(coverage, 0) AS coverage, coalesce(share, 0) AS share FROM (SELECT s AS source, count(*) AS sessions, count_if(p = 'human') AS human, count_if(p = 'subagent') AS subagent, count_if(p = 'tool-invoked') AS tool_invoked, count_if(source_present = 0) AS irreplaceable, count_if(p IN ('human', 'subagent')) AS conversations FROM old GROUP BY s) c LEFT JOIN gate USING (source))"""


def surveyed(spark: SparkSession, folder: str) -> DataFrame:
    """The survey of what was taken in before July."""
    return survey.survey(measured(spark, folder).where(F.col("ingested_at") < F.lit("2026-07-01").cast("timestamp_ntz")))


@query(f"WITH {SURVEY} SELECT * FROM surveyed")
def survey_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return surveyed(spark, folder)


def survey_document(spark: SparkSession, folder: str) -> DataFrame:
    """The survey as one JSON document, whose key order SQL engines write differently; tested against its parts."""
    return survey.document(surveyed(spark, folder))


query()(survey_document)


@query(f"""WITH {SURVEY}, live AS (SELECT s AS source, count(*) AS n FROM fine WHERE p IN ('human', 'subagent') GROUP BY s),
e AS (SELECT f.s AS source, sum(CASE WHEN w >= threshold THEN w ELSE 0 END) / nullif(sum(w), 0) * 100 AS covers, count_if(w >= threshold) / count(*) * 100 AS selects FROM fine f JOIN surveyed v ON v.source = f.s WHERE f.p IN ('human', 'subagent') GROUP BY f.s),
j AS (SELECT source, v.threshold, v.coverage, v.share, v.conversations AS was, l.n, e.covers, e.selects FROM surveyed v FULL JOIN live l USING (source) LEFT JOIN e USING (source)),
m AS (SELECT *, coalesce(was, 0) / (SELECT sum(was) FROM j) * 100 AS p0, coalesce(n, 0) / (SELECT sum(n) FROM j) * 100 AS p1 FROM j)
SELECT source, 'new-source' AS finding, 0.0::DOUBLE AS was, n::DOUBLE AS now FROM m WHERE was IS NULL
UNION ALL SELECT source, 'coverage', round(coverage, 2), round(covers, 2) FROM m WHERE threshold > 0 AND abs(covers - coverage) > 5
UNION ALL SELECT source, 'selection', round(share, 2), round(selects, 2) FROM m WHERE threshold > 0 AND abs(selects - share) > 10
UNION ALL SELECT source, 'mix', round(p0, 2), round(p1, 2) FROM m WHERE abs(p1 - p0) > 10
UNION ALL SELECT NULL, CASE WHEN y >= 2 * x THEN 'grew' ELSE 'shrank' END, x, y FROM (SELECT (SELECT sum(sessions) FROM surveyed)::DOUBLE AS x, (SELECT count(*) FROM fine)::DOUBLE AS y) WHERE y >= 2 * x OR y < x""")
def survey_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Why the survey of July no longer describes the archive."""
    return survey.drifted(surveyed(spark, folder), measured(spark, folder))


@query(f"""WITH {CUR}, g AS (SELECT s AS source, count(DISTINCT source_path) AS files, floor((epoch(TIMESTAMP '2026-12-01') - floor(min(start_us) / 1000000.0)) / 86400) AS oldest FROM cur GROUP BY s),
f AS (SELECT lower(trim(source)) AS source, sum(n_failures)::DOUBLE AS failed FROM failure_log GROUP BY 1), j AS (SELECT * FROM g LEFT JOIN f USING (source))
SELECT source, 'failures' AS finding, failed AS value FROM j WHERE failed > greatest(10, 0.05 * files) UNION ALL SELECT source, 'very-young', oldest FROM j WHERE oldest < 15 UNION ALL SELECT source, 'young', oldest FROM j WHERE oldest BETWEEN 15 AND 39""")
def file_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that fail often or whose history is young."""
    rows = current(spark, folder).withColumn("source", label("source"))
    return survey.file_anomalies(rows, table(spark, folder, "failure_log").withColumn("source", label("source")), "2026-12-01")


@query(f"""
WITH {CUR}, state AS (SELECT source_path, max(words) AS size_bytes FROM cur WHERE ingested_at < TIMESTAMP '2026-09-01' GROUP BY source_path),
listing AS (SELECT s AS source, source_path, max(words) AS size_bytes FROM cur WHERE source_path IS NOT NULL GROUP BY ALL)
SELECT source, 'behind' AS finding, count_if(t.size_bytes IS NULL OR t.size_bytes <> l.size_bytes)::DOUBLE AS value FROM listing l LEFT JOIN state t USING (source_path) GROUP BY source HAVING value > 0""")
def lag_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Sources the archive is behind of."""
    from ledgerloom.plans.archive import index_lag

    return survey.lag_anomalies(index_lag(spark, folder), True)
