"""Queries over the archive's tables: current rows, filters, merging, ledger, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import age_label, basename, model_name, moment
from ledgerloom.operators import archive, filters, places, vectors
from ledgerloom.operators.current import current_rows, label
from ledgerloom.plans.registry import CUR, query
from ledgerloom.session import table

COLUMNS = ["words", "source", "provenance", "parent_id", "cwd", "branch", "model", "title", "started_at", "ended_at", "duration_s", "user_turns", "assistant_turns", "tool_uses", "tokens", "source_path", "source_present", "origin", "ingested_at", "outcome", "topic", "enriched_words"]


def current(spark: SparkSession, folder: str, columns: list[str] = COLUMNS) -> DataFrame:
    """The current rows without their prose."""
    return current_rows(table(spark, folder, "sessions"), columns)


@query(f"WITH {CUR} SELECT session_id, s AS source, p AS provenance, words, updated_at FROM cur")
def current_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return current(spark, folder).select("session_id", label("source").alias("source"), label("provenance").alias("provenance"), "words", "updated_at")


@query(f"WITH {CUR} SELECT session_id, words FROM cur WHERE contains(lower(repo), 'lant') AND coalesce(p, '') <> 'tool-invoked'")
def filter_repo(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(repo="Lant")).select("session_id", "words")


@query(f"WITH {CUR} SELECT session_id FROM cur WHERE branch = 'main' AND contains(lower(model), 'opus') AND s = 'claude' AND coalesce(p, '') <> 'tool-invoked'")
def filter_branch_model_source(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(branch="main", model="OPUS", source="claude")).select("session_id")


@query(f"WITH {CUR} SELECT session_id FROM cur WHERE start_us >= epoch_us(TIMESTAMP '2026-03-01') AND start_us <= epoch_us(TIMESTAMP '2026-05-31 23:59:59.999999') AND coalesce(p, '') <> 'tool-invoked'")
def filter_dates(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(since="2026-03", until="2026-05")).select("session_id")


@query(f"WITH {CUR} SELECT session_id FROM cur WHERE p = 'human' AND outcome = 'fixed'")
def filter_provenance_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(provenance="human", outcome="fixed")).select("session_id")


@query(f"WITH {CUR} SELECT session_id FROM cur WHERE coalesce(p, '') <> 'tool-invoked' AND session_id IN (SELECT session_id FROM session_files WHERE basename = 'settings.toml' OR path = 'settings.toml' OR path LIKE '%/settings.toml')")
def filter_file(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(file="settings.toml"), files=table(spark, folder, "session_files")).select("session_id")


@query(f"WITH {CUR} SELECT session_id FROM cur WHERE coalesce(p, '') <> 'tool-invoked' AND session_id IN (SELECT session_id FROM session_tools WHERE lower(tool) = 'multiedit')")
def filter_tool(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply(current(spark, folder), filters.Filters(tool="multiedit"), tools=table(spark, folder, "session_tools")).select("session_id")


@query(f"WITH {CUR} SELECT session_id, s AS source, words FROM cur ORDER BY start_us DESC NULLS LAST, session_id LIMIT 50")
def log_newest(spark: SparkSession, folder: str) -> DataFrame:
    return filters.log(current(spark, folder), 50).select("session_id", label("source").alias("source"), "words")


@query("SELECT DISTINCT session_id FROM sessions WHERE starts_with(session_id, 'agent-0') ORDER BY session_id LIMIT 21")
def id_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_prefix(table(spark, folder, "sessions"), "agent-0")


@query(f"WITH {CUR} SELECT c.session_id, c.parent_id, coalesce(c.cwd, q.cwd) AS shown_cwd FROM cur c LEFT JOIN cur q ON q.session_id = c.parent_id")
def parent_folder(spark: SparkSession, folder: str) -> DataFrame:
    return filters.with_parent_folder(current(spark, folder, ["parent_id", "cwd"])).select("session_id", "parent_id", "shown_cwd")


MERGED = f"""
WITH {CUR},
old AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at, words NULLS FIRST, coalesce(title, '')) AS n FROM sessions WHERE session_id IS NOT NULL) WHERE n = 1)
SELECT coalesce(o.session_id, c.session_id) AS session_id,
  CASE WHEN (c.title IS NULL OR c.title = '') AND NOT (o.title IS NULL OR o.title = '') THEN o.title ELSE c.title END AS title,
  CASE WHEN (c.words IS NULL OR c.words = 0) AND NOT (o.words IS NULL OR o.words = 0) THEN o.words ELSE c.words END AS words,
  c.topic AS topic
FROM old o FULL JOIN cur c ON o.session_id = c.session_id"""


@query(MERGED)
def merge_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The oldest version of each session with the current one merged in; topics are overwritten."""
    sessions = table(spark, folder, "sessions").where(F.col("session_id").isNotNull())
    first = F.min(F.struct("updated_at", "words", F.coalesce("title", F.lit("")).alias("_t"), "title", "topic")).alias("_row")
    old = sessions.groupBy("session_id").agg(first).select("session_id", "_row.title", "_row.words", "_row.topic")
    new = current(spark, folder, ["words", "title", "topic"]).select("session_id", "title", "words", "topic")
    return archive.upsert(old, new, facets=("topic",))


@query(f"""
WITH {CUR}, half AS (SELECT * FROM cur WHERE ingested_at < TIMESTAMP '2026-07-01')
SELECT c.session_id, CASE WHEN h.session_id IS NULL THEN 'added' WHEN h.ended_at IS NOT DISTINCT FROM c.ended_at THEN 'unchanged' ELSE 'updated' END AS disposition
FROM cur c LEFT JOIN half h USING (session_id)""")
def import_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """What importing all current sessions does to an archive that holds those of the first half of the year."""
    rows = current(spark, folder)
    return archive.disposition(rows.where(F.col("ingested_at") < F.lit("2026-07-01").cast("timestamp_ntz")), rows)


@query("""
SELECT session_id, source_path FROM (SELECT session_id, source_path, row_number() OVER (PARTITION BY session_id ORDER BY source_path, updated_at, words NULLS FIRST) AS n FROM sessions WHERE session_id IS NOT NULL) WHERE n = 1""")
def first_path_wins(spark: SparkSession, folder: str) -> DataFrame:
    sessions = table(spark, folder, "sessions").where(F.col("session_id").isNotNull()).select("session_id", "source_path", "updated_at", "words")
    return archive.first_of_each(sessions, "session_id", ["source_path", "updated_at", "words"])[0].select("session_id", "source_path")


@query(f"""
WITH {CUR}, present AS (SELECT DISTINCT source_path FROM cur WHERE source_present = 1 AND origin = 'raw')
SELECT session_id, CASE WHEN p.source_path IS NULL THEN 0 ELSE source_present END AS source_present FROM cur LEFT JOIN present p USING (source_path)""")
def mark_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder)
    present = rows.where((F.col("source_present") == 1) & (F.col("origin") == "raw"))
    return archive.mark_missing(rows, present).select("session_id", "source_present")


@query(f"""
WITH {CUR}, gone AS (SELECT session_id FROM cur WHERE p = 'tool-invoked')
SELECT model, count(*) AS vectors FROM chunk_vectors WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY model""")
def prune_tool_invoked(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors left by model after the prose of tool-invoked sessions is pruned."""
    rows = current(spark, folder).withColumn("provenance", label("provenance")).withColumn("text", F.lit("kept"))
    vectors = table(spark, folder, "chunk_vectors")
    _, _, left = archive.prune(rows, vectors.select("session_id", "ordinal"), vectors)
    return left.groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))


@query(f"""
WITH {CUR}, l AS (SELECT s AS source, sha256(session_id || chr(9) || coalesce(ended_at, '')) AS line FROM cur),
b AS (SELECT source, substr(line, 1, 3) AS bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l GROUP BY ALL)
SELECT source, 'items-sha256:' || sha256('sessions' || chr(10) || string_agg(hash, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY source""")
def digest_by_source(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder).withColumn("source", label("source"))
    return archive.digest(rows, "sessions", "session_id", "ended_at", ["source"])


@query(f"WITH {CUR} SELECT DISTINCT d.session_id FROM documents d WHERE d.session_id IS NOT NULL AND d.session_id NOT IN (SELECT session_id FROM cur WHERE source_present = 1)")
def unsafe_to_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions documents name of which the archive has no receipt."""
    items = table(spark, folder, "documents").where(F.col("session_id").isNotNull()).select("session_id").distinct()
    receipts = current(spark, folder).select("session_id", F.when(F.col("source_present") == 1, "added").otherwise("skipped").alias("disposition"))
    return archive.unsafe_to_delete(items, receipts, "session_id")


@query(f"""
WITH {CUR}, state AS (SELECT source_path, max(words) AS size_bytes FROM cur WHERE ingested_at < TIMESTAMP '2026-09-01' GROUP BY source_path),
listing AS (SELECT s AS source, source_path, max(words) AS size_bytes FROM cur WHERE source_path IS NOT NULL GROUP BY ALL)
SELECT source, count(*) AS files, count_if(t.size_bytes IS NULL) AS new, count_if(t.size_bytes <> l.size_bytes) AS changed FROM listing l LEFT JOIN state t USING (source_path) GROUP BY source""")
def index_lag(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder).where(F.col("source_path").isNotNull()).withColumn("source", label("source"))
    listing = rows.groupBy("source", "source_path").agg(F.max("words").alias("size_bytes"))
    state = rows.where(F.col("ingested_at") < F.lit("2026-09-01").cast("timestamp_ntz")).groupBy("source_path").agg(F.max("words").alias("size_bytes"))
    return archive.index_lag(listing, state)


@query("SELECT source, category, sum(n_failures)::BIGINT AS total FROM failure_log GROUP BY source, category")
def failure_totals(spark: SparkSession, folder: str) -> DataFrame:
    return archive.failure_totals(table(spark, folder, "failure_log"))


@query("SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS n FROM failure_log) WHERE n <= 5")
def failures_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return archive.trim_failures(table(spark, folder, "failure_log"), 5).select("id", "source")


@query(f"""
WITH {CUR} SELECT f.id, f.category, c.session_id IS NOT NULL AS recovered, coalesce(c.source_present = 0, false) AS missing FROM failure_log f LEFT JOIN cur c ON c.session_id = f.session_id""")
def failures_recovered(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(spark, folder, ["source_present"])
    return archive.failures_with_sessions(table(spark, folder, "failure_log"), rows).select("id", "category", "recovered", "missing")


@query(f"""
WITH {CUR} SELECT DISTINCT d.doc_id AS commit_id, c.session_id
FROM documents d JOIN cur c ON lower(d.repo) = lower(c.repo) AND c.repo <> '' AND epoch_us(d.captured_at) >= c.start_us AND epoch_us(d.captured_at) <= coalesce(c.end_us, c.start_us)
""")
def commit_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions open when something of their repository was recorded."""
    commits = table(spark, folder, "documents").select(F.col("doc_id").alias("commit_id"), "repo", F.col("captured_at").alias("at"))
    return places.attributions(commits, current(spark, folder, ["cwd", "started_at", "ended_at"]))


@query("""
SELECT session_id, min(CASE WHEN lower(path) = 'settings.toml' THEN 0 ELSE 1 END)::INT AS rank FROM session_files
WHERE lower(path) = 'settings.toml' OR ends_with(lower(path), '/settings.toml') GROUP BY session_id""")
def touched_file(spark: SparkSession, folder: str) -> DataFrame:
    return places.touching(table(spark, folder, "session_files"), "settings.toml")


@query(f"""
WITH {CUR}, own AS (SELECT * FROM cur WHERE lower(repo) = 'lantern'),
a AS (SELECT 'unfinished' AS kind, session_id FROM own WHERE lower(outcome) IN ('ongoing', 'abandoned') ORDER BY start_us DESC NULLS LAST, session_id LIMIT 10),
b AS (SELECT 'prior' AS kind, session_id FROM own WHERE session_id NOT IN (SELECT session_id FROM a) ORDER BY start_us DESC NULLS LAST, session_id LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def recall_place(spark: SparkSession, folder: str) -> DataFrame:
    return places.recall(current(spark, folder, ["cwd", "outcome", "started_at"]), "lantern", 10)


@query(f"WITH {CUR} SELECT repo FROM cur WHERE cwd IS NOT NULL AND start_us IS NOT NULL ORDER BY start_us DESC, session_id DESC LIMIT 1")
def current_repository(spark: SparkSession, folder: str) -> DataFrame:
    return places.current_repo(current(spark, folder, ["cwd", "started_at"]))


@query(f"WITH {CUR} SELECT session_id, start_us, end_us, repo FROM cur")
def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end as microseconds since 1970, from text in several forms, and the folder's name."""
    rows = current(spark, folder, ["cwd", "started_at", "ended_at"])
    return rows.select("session_id", F.unix_micros(moment("started_at")).alias("start_us"), F.unix_micros(moment("ended_at")).alias("end_us"), basename("cwd").alias("repo"))


COMMITS = "SELECT doc_id AS commit_id, repo, epoch_us(captured_at) AS at FROM documents WHERE repo IS NOT NULL AND lower(repo) = 'lantern' AND captured_at IS NOT NULL"


@query(f"""
WITH {CUR}, c AS ({COMMITS}),
t AS (SELECT session_id, 0 AS rank FROM session_files WHERE lower(path) = 'settings.toml' OR ends_with(lower(path), '/lantern/settings.toml') UNION ALL SELECT session_id, 1 FROM cur WHERE lower(repo) = 'lantern'),
r AS (SELECT session_id, min(rank) AS rank FROM t GROUP BY session_id),
f AS (SELECT DISTINCT c.commit_id, s.session_id, CASE r.rank WHEN 0 THEN 'touched-file' ELSE 'touched-repo' END AS confidence FROM c JOIN cur s ON c.at >= s.start_us AND c.at <= coalesce(s.end_us, s.start_us) JOIN r ON r.session_id = s.session_id)
SELECT c.commit_id, f.session_id, f.confidence FROM c LEFT JOIN f USING (commit_id)
UNION ALL SELECT NULL, session_id, 'uncommitted' FROM (SELECT DISTINCT session_id FROM cur WHERE session_id IN (SELECT session_id FROM t WHERE rank = 0) AND session_id NOT IN (SELECT session_id FROM f))""")
def why_file(spark: SparkSession, folder: str) -> DataFrame:
    """The work behind what was recorded for a repository, by sessions that touched a file or ran there, and work on the file that nothing was recorded of."""
    commits = table(spark, folder, "documents").select(F.col("doc_id").alias("commit_id"), "repo", F.col("captured_at").alias("at")).where(F.col("at").isNotNull())
    rows = current(spark, folder, ["cwd", "started_at", "ended_at"])
    return places.why(commits, rows, table(spark, folder, "session_files"), "settings.toml", "lantern").select("commit_id", "session_id", "confidence")


@query(f"""
WITH {CUR}, k AS (SELECT s AS source, count_if(ingested_at >= TIMESTAMP '2026-11-01') AS added, count_if(user_turns > 8) AS updated, count_if(source_present = 1) AS unchanged, count_if(words IS NULL OR words < 0) AS skipped, count_if(source_present = 0) > 20 AS prior, s LIKE '%e%' AS prose FROM cur GROUP BY s),
v AS (SELECT * REPLACE (CASE m WHEN 0 THEN added ELSE 0 END AS added, CASE m WHEN 0 THEN updated ELSE 0 END AS updated, CASE WHEN m < 2 THEN unchanged ELSE 0 END AS unchanged, CASE m WHEN 3 THEN 0 ELSE skipped END AS skipped) FROM k, (SELECT unnest(range(4)) AS m)),
w AS (SELECT *, added + updated + unchanged + skipped AS item_count FROM v)
SELECT source, m::INT AS m, CASE WHEN added + updated > 0 THEN CASE WHEN skipped > 0 THEN 'partial' ELSE 'imported' END WHEN skipped > 0 AND unchanged = 0 AND item_count > 0 AND NOT (prose AND prior) THEN 'rejected' WHEN prior THEN 'duplicate' ELSE 'imported' END AS outcome FROM w""")
def import_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How imports of each source would end: as they are, without changes, with nothing but what is skipped, and with nothing at all."""
    rows = current(spark, folder).withColumn("source", label("source"))
    when = lambda keep, c: F.when(keep, F.col(c)).otherwise(0).alias(c)
    counts = rows.groupBy("source").agg(F.count_if(F.col("ingested_at") >= F.lit("2026-11-01").cast("timestamp_ntz")).alias("added"), F.count_if(F.col("user_turns") > 8).alias("updated"), F.count_if(F.col("source_present") == 1).alias("unchanged"), F.count_if(F.col("words").isNull() | (F.col("words") < 0)).alias("skipped"), (F.count_if(F.col("source_present") == 0) > 20).alias("prior"))
    cases = counts.withColumn("prose", F.col("source").contains("e")).withColumn("m", F.explode(F.array(*map(F.lit, range(4)))))
    cases = cases.select("source", "m", "prior", "prose", when(F.col("m") == 0, "added"), when(F.col("m") == 0, "updated"), when(F.col("m") < 2, "unchanged"), when(F.col("m") != 3, "skipped"))
    told = archive.outcomes(cases.withColumn("item_count", F.col("added") + F.col("updated") + F.col("unchanged") + F.col("skipped")))
    return told.select("source", "m", "outcome")


@query(f"""
WITH {CUR}, old AS (SELECT session_id, origin, ended_at FROM cur WHERE ingested_at < TIMESTAMP '2026-08-01')
SELECT c.session_id, CASE WHEN o.session_id IS NOT NULL AND o.origin IS DISTINCT FROM 'prose-index' THEN 'skipped' WHEN o.session_id IS NULL THEN 'added' WHEN o.ended_at IS NOT DISTINCT FROM c.ended_at THEN 'unchanged' ELSE 'updated' END AS disposition,
  CASE WHEN o.session_id IS NOT NULL AND o.origin IS DISTINCT FROM 'prose-index' THEN 'superseded-by-richer-origin' END AS reason FROM cur c LEFT JOIN old o USING (session_id)""")
def prose_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """What a prose index of all sessions does to an archive that holds those of the first seven months."""
    rows = current(spark, folder)
    return archive.prose_dispositions(rows.where(F.col("ingested_at") < F.lit("2026-08-01").cast("timestamp_ntz")), rows)


@query(f"""
WITH {CUR}, h AS (SELECT session_id, max(lang) AS topic FROM documents WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT c.session_id, CASE WHEN h.session_id IS NOT NULL AND coalesce(c.topic, '') = '' THEN h.topic ELSE c.topic END AS topic, CASE WHEN h.session_id IS NOT NULL AND coalesce(c.topic, '') = '' THEN c.words ELSE c.enriched_words END AS enriched_words FROM cur c LEFT JOIN h USING (session_id)""")
def harvested_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Topics harvested elsewhere, put only where a session has none."""
    rows = current(spark, folder).select("session_id", "topic", "words", "enriched_words")
    found = table(spark, folder, "documents").where(F.col("session_id").isNotNull()).select("session_id", F.col("lang").alias("topic"))
    return archive.with_harvested(rows, found, ("topic",)).select("session_id", "topic", "enriched_words")


@query(f"""
WITH {CUR}, l AS (SELECT s AS source, sha256(regexp_replace(source_path, '^/home/', '') || chr(9) || coalesce(words::VARCHAR || chr(9), '') || coalesce(epoch_us(updated_at)::VARCHAR, '')) AS line FROM cur WHERE source_path IS NOT NULL),
b AS (SELECT substr(line, 1, 3) AS bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l GROUP BY ALL)
SELECT 'items-sha256:' || sha256('tree' || chr(10) || string_agg(hash, chr(10) ORDER BY bucket)) AS digest FROM b""")
def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One digest of the archive's source files, their sizes and times."""
    rows = current(spark, folder).where(F.col("source_path").isNotNull())
    return archive.tree_digest(rows.select("source_path", F.col("words").alias("size_bytes"), F.col("updated_at").cast("timestamp").alias("modified")), "/home")


@query("SELECT doc_id, 'file-sha256:' || sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where(F.col("text").isNotNull())
    found = archive.file_digest(rows.select(F.col("doc_id").alias("source_path"), F.col("text").cast("binary").alias("content")))
    return found.select(F.col("source_path").alias("doc_id"), "digest")


@query(f"""
WITH {CUR}, listed AS (SELECT DISTINCT session_id FROM session_files)
SELECT session_id, CASE WHEN starts_with(session_id, 'agent-') AND session_id NOT IN (SELECT session_id FROM listed WHERE session_id IS NOT NULL) THEN 0 ELSE source_present END AS source_present FROM cur""")
def reconciled_source(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of one namespace marked gone that its source no longer lists."""
    rows = current(spark, folder, ["source_present"])
    done, said = archive.reconcile(rows, table(spark, folder, "session_files"), "agent-", False)
    assert said in ("reconciled", "abstained")
    return done.select("session_id", "source_present")


@query(f"""
WITH {CUR}, own AS (SELECT * FROM cur WHERE lower(repo) = 'lantern' AND p IN ('human', 'subagent')),
a AS (SELECT session_id FROM own WHERE lower(outcome) IN ('ongoing', 'abandoned') ORDER BY start_us DESC NULLS LAST, session_id LIMIT 10),
n AS (SELECT session_id, start_us FROM own ORDER BY start_us DESC NULLS LAST, session_id LIMIT 30),
b AS (SELECT session_id FROM n WHERE session_id NOT IN (SELECT session_id FROM a) ORDER BY start_us DESC NULLS LAST, session_id LIMIT 10),
v AS (SELECT DISTINCT ON (session_id, ordinal) session_id, ordinal, vec FROM chunk_vectors WHERE model = 'kite-embed-64' AND vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
x AS (SELECT session_id, unnest(vec::DOUBLE[]) AS x, unnest(range(len(vec))) AS i FROM v), y AS (SELECT session_id, i, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT session_id, list(x ORDER BY i) AS vec FROM y GROUP BY ALL),
r AS (SELECT m.session_id, lower(c.repo) AS repo, c.p, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM m JOIN cur c USING (session_id) WHERE c.cwd IS NOT NULL),
rx AS (SELECT unnest(vec) AS x, unnest(range(len(vec))) AS i FROM r WHERE repo = 'lantern'), centre AS (SELECT list(x ORDER BY i) AS vec FROM (SELECT i, avg(x) AS x FROM rx GROUP BY i)),
e AS (SELECT session_id, round(list_cosine_similarity(r.vec, centre.vec), 3) AS cosine FROM r, centre WHERE repo <> 'lantern' AND p IN ('human', 'subagent') AND list_cosine_similarity(r.vec, centre.vec) >= 0.5 AND session_id NOT IN (SELECT session_id FROM a UNION ALL SELECT session_id FROM b) ORDER BY round(list_cosine_similarity(r.vec, centre.vec), 3) DESC, session_id LIMIT 10)
SELECT 'unfinished' AS kind, session_id, NULL::DOUBLE AS score FROM a UNION ALL SELECT 'prior', session_id, NULL FROM b UNION ALL SELECT 'related', session_id, cosine FROM e""")
def recall_place_and_elsewhere(spark: SparkSession, folder: str) -> DataFrame:
    """All that is recalled of a place: unfinished, earlier, and related work elsewhere."""
    rows = current(spark, folder, ["cwd", "outcome", "started_at", "provenance"])
    repos = rows.where(F.col("cwd").isNotNull()).select("session_id", F.lower(basename("cwd")).alias("repo"))
    near = vectors.related_elsewhere(table(spark, folder, "chunk_vectors"), repos, "lantern", "kite-embed-64", 0.5, 1_000_000)
    return places.recall_all(rows, "lantern", near, 10)


SAMPLES = ("us.anthropic.claude-x", "arn:aws:bedrock:1:model/x", "https://host/model", "bedrock/us.anthropic.claude-y", "team@model", "<synthetic>", "m-1234567890123", "openai/gpt-z", "  ", "azure/own/deployed", "eu.openrouter/vertex/plain", "name with blank")


@query(rf"""
WITH {CUR}, s AS (SELECT session_id, trim([{', '.join(chr(39) + x + chr(39) for x in SAMPLES)}][coalesce(user_turns, 0) % {len(SAMPLES)} + 1]) AS t FROM cur),
n AS (SELECT *, regexp_replace(t, '^(us-gov\.|us\.|eu\.|apac\.|global\.|anthropic\.|anthropic/|openai/|bedrock/|vertex_ai/|vertex/|azure/|litellm/|openrouter/){{1,4}}', '', 'i') AS name FROM s)
SELECT session_id, CASE WHEN t = '' THEN NULL WHEN t = '<synthetic>' THEN t WHEN contains(lower(t), 'arn:') OR contains(t, '://') OR contains(t, '@') OR regexp_matches(t, '[0-9]{{10,}}') OR name = '' OR contains(name, '/') OR NOT regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._:@\-\[\]]{{0,63}}$') THEN 'custom/redacted' ELSE name END AS model FROM n""")
def model_names(spark: SparkSession, folder: str) -> DataFrame:
    """Plain names of models that come with routes, accounts and addresses, one of each kind put to every session."""
    rows = current(spark, folder)
    sample = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.coalesce("user_turns", F.lit(0)) % len(SAMPLES) + 1).cast("int"))
    return rows.select("session_id", model_name(sample).alias("model"))


@query(f"""
WITH {CUR}, a AS (SELECT session_id, floor((epoch_us(TIMESTAMP '2026-12-01') - epoch_us(ingested_at)) / 1000000.0)::BIGINT AS s FROM cur)
SELECT session_id, CASE WHEN s IS NULL THEN NULL WHEN s < 90 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || 'd ago' END AS age FROM a""")
def age_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How long ago each session was taken in, as a person says it."""
    rows = current(spark, folder).select("session_id", F.date_trunc("second", F.col("ingested_at").cast("timestamp")).alias("then"), F.lit("2026-12-01").cast("timestamp").alias("now"))
    return rows.select("session_id", age_label("then", "now").alias("age"))
