"""Vectors of chunks: exact top-k for a set of queries, best chunk per session, mean vectors, what is pending."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of query vectors that go out in one pass over the table, and how many of them are scored at once.
BLOCK_BYTES = 64_000_000
AT_ONCE = 2_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vec: Column) -> Column:
    """The vector at length 1; one of zeros, or null, stays as it is."""
    # one-element arrays bind the vector and its norm to lambda variables, so that each is computed once and not once a value

    def scaled(v: Column) -> Column:
        doubles = F.transform(v, lambda x: x.cast("double"))
        return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles))[0]

    return F.transform(F.array(vec), scaled)[0]


def sound(vectors: DataFrame, vec: str = "vec", dim: str | None = "dim") -> DataFrame:
    """The vectors that can be compared: right length, no null, infinite or not-a-number value, not all zero."""
    v = F.col(vec)
    rows = vectors.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.where(F.size(v) == F.col(dim)) if dim else rows


def models_present(vectors: DataFrame) -> DataFrame:
    """How many vectors each (model, dim) has; repeated rows count once."""
    return vectors.select("session_id", "ordinal", "model", "dim").distinct().groupBy("model", "dim").agg(F.count(F.lit(1)).alias("vectors"))


def pending(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks (session_id, ordinal, ...) without a vector of ``model``."""
    there = vectors.where(F.col("model") == model).select("session_id", "ordinal")
    return chunks.join(there, ["session_id", "ordinal"], "left_anti")


def next_pending(chunks: DataFrame, vectors: DataFrame, model: str, sessions: DataFrame, batch: int = 64) -> DataFrame:
    """The next ``batch`` pending chunks, those of the newest sessions first, undated ones last, then by id and ordinal."""
    dated = pending(chunks, vectors, model).join(sessions.select("session_id", "started_at"), "session_id", "left")
    return dated.orderBy(F.desc_nulls_last("started_at"), "session_id", "ordinal").limit(batch).drop("started_at")


def stale(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone since the text was cut anew."""
    return vectors.join(chunks.select("session_id", "ordinal"), ["session_id", "ordinal"], "left_anti")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str, vec: str, exclude_self: bool = True) -> DataFrame:
    """query, other, cosine, rank: the k most similar vectors of the whole table for each of a stated set of queries.

    Queries go out in blocks of BLOCK_BYTES (125,000 of 64 values), each of which takes one pass;
    a partition scores AT_ONCE of a block at a time by one matrix product and hands on its own k best of each query, so what is shuffled is k rows a query and partition.
    Ties go to the smaller key. Vectors that are unusable are in neither set.
    """
    spark = vectors.sparkSession
    key_type = dict(vectors.dtypes)[key]
    rows = sound(vectors, vec, None).select(F.col(key).alias("_key"), F.col(vec).alias("_vec"))
    asked = sound(queries, vec, None).select(F.col(key).alias("_key"), F.col(vec).alias("_vec"))
    size = asked.agg(F.sum(F.size("_vec") * 8)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block)
        got = mine.collect()  # about BLOCK_BYTES
        names = [r["_key"] for r in got]
        matrix = np.array([r["_vec"] for r in got], dtype=np.float64)
        if len(matrix):
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                theirs = np.stack(batch["_vec"].to_numpy()).astype(np.float64)
                theirs /= np.linalg.norm(theirs, axis=1, keepdims=True)
                keys = batch["_key"].to_numpy()
                for first in range(0, len(names), AT_ONCE):
                    own = names[first : first + AT_ONCE]
                    sims = np.round(matrix[first : first + AT_ONCE] @ theirs.T, 12)
                    n = min(k + 1, len(keys))
                    floor = np.partition(sims, len(keys) - n, axis=1)[:, len(keys) - n]
                    q, at = np.nonzero(sims >= floor[:, None])
                    order = np.lexsort((keys[at], -sims[q, at], q))
                    q, at = q[order], at[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < n  # counted from where each query's candidates begin
                    q, at = q[best], at[best]
                    yield pd.DataFrame({"query": np.array(own)[q], "other": keys[at], "cosine": sims[q, at]})

        part = rows.mapInPandas(run, f"query {key_type}, other {key_type}, cosine double")
        found = part if found is None else found.unionByName(part)
    if exclude_self:
        found = found.where(F.col("query") != F.col("other"))
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_sessions(vectors: DataFrame, query: list[float], limit: int, model: str | None = None) -> DataFrame:
    """session_id, ordinal, cosine of each session's most similar chunk, the best ``limit``; ties by id."""
    if model is not None:
        vectors = vectors.where((F.col("model") == model) & (F.col("dim") == len(query)))
    given = F.array(*[F.lit(float(x)) for x in query])
    scored = sound(vectors).select("session_id", "ordinal", dot(normalized(F.col("vec")), normalized(given)).alias("cosine"))
    best = scored.groupBy("session_id").agg(F.max(F.struct("cosine", (-F.col("ordinal")).alias("_o"))).alias("_best"))
    return best.select("session_id", (-F.col("_best._o")).alias("ordinal"), F.col("_best.cosine").alias("cosine")).orderBy(F.desc("cosine"), "session_id").limit(limit)


def session_means(vectors: DataFrame, group: list[str] = ["model", "session_id"]) -> DataFrame:
    """group..., vec: the mean of each group's vectors at length 1. Summed value by value, so a hot group is combined on the map side."""
    rows = sound(vectors).select(*group, "ordinal", "vec").dropDuplicates([*group, "ordinal"])
    flat = rows.select(*group, F.posexplode("vec").alias("place", "x"))
    means = flat.groupBy(*group, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = means.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("_v"))
    return gathered.select(*group, normalized(F.transform("_v", lambda p: p["x"])).alias("vec"))


def correlate(vectors: DataFrame, session_id: str, model: str, limit: int = 10) -> DataFrame:
    """Sessions by the cosine of their mean vector with that of ``session_id``; empty for an unknown id."""
    means = session_means(vectors.where(F.col("model") == model))
    own = means.where(F.col("session_id") == session_id).select(F.col("model"), F.col("vec").alias("_own"))
    others = means.where(F.col("session_id") != session_id).join(F.broadcast(own), "model")  # one row
    return others.select("session_id", dot(F.col("vec"), F.col("_own")).alias("cosine")).orderBy(F.desc("cosine"), "session_id").limit(limit)


def related_elsewhere(vectors: DataFrame, repos: DataFrame, repo: str, model: str, least: float = 0.88, limit: int = 10) -> DataFrame:
    """Sessions of other repositories that lie near the centre of ``repo``'s: session_id, repo, cosine (3 places).

    The centre is the mean, at length 1, of the mean vectors of the repository's sessions.
    """
    means = session_means(vectors.where(F.col("model") == model)).join(repos.select("session_id", "repo"), "session_id")
    centre = session_means(means.where(F.col("repo") == repo).select("model", "session_id", F.lit(0).alias("dim"), F.xxhash64("session_id").alias("ordinal"), "vec").withColumn("dim", F.size("vec")), ["model"]).select("model", F.col("vec").alias("_centre"))
    near = means.where(F.col("repo") != repo).join(F.broadcast(centre), "model")  # one row
    scored = near.select("session_id", "repo", dot(F.col("vec"), F.col("_centre")).alias("cosine")).where(F.col("cosine") >= least)
    return scored.orderBy(F.desc("cosine"), "session_id").limit(limit).withColumn("cosine", F.round("cosine", 3))


def store(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """``vectors`` with the incoming ones put in place of those of the same (session_id, ordinal, model). Raises for a length other than dim."""
    keys = ["session_id", "ordinal", "model"]
    checked = incoming.withColumn("vec", F.when(F.size("vec") == F.col("dim"), F.col("vec")).otherwise(F.raise_error(F.lit("a vector's length is not its dim")).cast(incoming.schema["vec"].dataType)))
    newest = checked.groupBy(*keys).agg(F.max(F.struct("dim", "vec")).alias("_v")).select(*keys, "_v.dim", "_v.vec")
    return vectors.join(newest.select(*keys), keys, "left_anti").select(*keys, "dim", "vec").unionByName(newest)


def mean_pairwise(vectors: DataFrame, group: list[str]) -> DataFrame:
    """group..., vectors, similarity: the mean cosine over all pairs of a group, from the length of the sum of its unit vectors alone.

    The sum of all cosines of n unit vectors is the squared length of their sum; without the n
    pairs of a vector with itself it is divided by n (n - 1). No pair is ever formed.
    """
    rows = sound(vectors).select(*group, normalized(F.col("vec")).alias("_u"))
    flat = rows.select(*group, F.posexplode("_u").alias("place", "x"))
    sums = flat.groupBy(*group, "place").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(*group).agg(F.sum(F.col("x") * F.col("x")).alias("_s"), F.max("n").alias("vectors"))
    pairs = F.col("vectors") * (F.col("vectors") - 1)
    return total.select(*group, "vectors", F.when(pairs > 0, (F.col("_s") - F.col("vectors")) / pairs).alias("similarity"))
