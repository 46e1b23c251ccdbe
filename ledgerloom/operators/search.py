"""Full-text search: an inverted index, boolean queries with phrases and prefixes, BM25, best chunk per session."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import stemming

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Terms a query is widened to when it finds too little; more would cost more than they add.
EXPANSION_TERMS = 4
KEYS = ["session_id", "ordinal"]


@dataclass(frozen=True)
class Leaf:
    """A term, the beginning of one, or a phrase."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, NOT (left but not right)
    left: object
    right: object


def parse(raw: str | None) -> object | None:
    """The query as a tree; None for one without terms or with misplaced operators.

    Quoted parts are phrases, ``x*`` a prefix; AND (also between terms that just follow each
    other), OR and NOT in capitals combine, NOT binding most and OR least. Other signs are blanks.
    """
    tokens: list[object] = []
    for phrase, word in re.findall(r'"([^"]*)"|([^\s"]+)', re.sub(r"[^\w\s\"'*-]+", " ", raw or "")):
        if word in ("AND", "OR", "NOT"):
            tokens.append(word)
            continue
        parts = tuple(stemming.plain_tokens(phrase or word))
        if parts:
            tokens.append(Leaf(parts, bool(word) and word.endswith("*")))
    place = 0

    def peek() -> object:
        return tokens[place] if place < len(tokens) else None

    def take_leaf() -> object:
        nonlocal place
        if not isinstance(peek(), Leaf):
            raise ValueError("a term is missing")
        place += 1
        return tokens[place - 1]

    def excluded() -> object:
        nonlocal place
        left = take_leaf()
        while peek() == "NOT":
            place += 1
            left = Node("NOT", left, take_leaf())
        return left

    def both() -> object:
        nonlocal place
        left = excluded()
        while peek() == "AND" or isinstance(peek(), Leaf):
            place += peek() == "AND"
            left = Node("AND", left, excluded())
        return left

    def either() -> object:
        nonlocal place
        left = both()
        while peek() == "OR":
            place += 1
            left = Node("OR", left, both())
        return left

    try:
        tree = either()
        return tree if place == len(tokens) else None
    except ValueError:
        return None


def leaves(tree: object, wanted: bool = True) -> list[Leaf]:
    """The leaves that score, each once: those not under the right side of a NOT."""
    if isinstance(tree, Leaf):
        return [tree]
    own = leaves(tree.left) + ([] if tree.op == "NOT" and wanted else leaves(tree.right, wanted))
    return list(dict.fromkeys(own))


def all_leaves(tree: object) -> list[Leaf]:
    return leaves(tree, wanted=False)


def expanded(tree: object) -> object | None:
    """OR of the first few terms of a query; phrases stay whole; None where that says nothing new."""
    few = leaves(tree)[:EXPANSION_TERMS]
    return reduce(lambda a, b: Node("OR", a, b), few) if len(few) > 1 else None


@dataclass
class Index:
    """``postings`` (term, keys, tf, positions, length of the chunk), ``bodies`` (keys, body), statistics of all chunks, and how terms are made from words."""

    postings: DataFrame
    bodies: DataFrame
    chunks: int
    average: float
    stems: bool


def build_index(chunks: DataFrame, stems: bool = True, keys: list[str] = KEYS) -> Index:
    """The inverted index of (keys..., body). Statistics are those of all chunks, whatever is filtered later."""
    body = F.col("body")
    tokens = chunks.select(*keys, (stemming.stemmed(body) if stems else stemming.unstemmed(body)).alias("_t"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("average")).first()
    placed = tokens.select(*keys, F.size("_t").alias("length"), F.posexplode("_t").alias("position", "term"))
    postings = placed.groupBy("term", *keys).agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return Index(postings, chunks.select(*keys, "body"), stats["n"], stats["average"] or 0.0, stems)


def write_index(index: Index, folder: str, keys: list[str] = KEYS) -> None:
    """Keeps an index: postings in order of their terms and bodies of their keys, so that reading skips all files and row groups without those asked for.

    Ranges take the keys in, too, so the postings of a word that is in most chunks are cut into many
    files. The statistics are written last; an index without them is none.
    """
    spark = index.postings.sparkSession
    order = ["term", *keys]
    index.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/postings")
    index.bodies.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/bodies")
    spark.createDataFrame([(index.chunks, index.average, index.stems)], "chunks long, average double, stems boolean").coalesce(1).write.mode("overwrite").json(f"{folder}/statistics")


def read_index(spark, folder: str) -> Index:
    stats = spark.read.schema("chunks long, average double, stems boolean").json(f"{folder}/statistics").first()
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/bodies"), stats["chunks"], stats["average"], stats["stems"])


def matches(index: Index, tree: object, keys: list[str] = KEYS) -> DataFrame:
    """keys..., score (lower is better) of the chunks the tree holds for.

    Only postings of the query's terms are read. A phrase's frequency counts the starts at which
    its words follow each other; a prefix counts all terms that begin so.
    """
    every, scoring = all_leaves(tree), leaves(tree)
    term_of = stemming.stem if index.stems else (lambda w: w)
    exact = sorted({term_of(w) for leaf in every for w in (leaf.words[:-1] if leaf.prefix else leaf.words)})
    starts = sorted({leaf.words[-1] for leaf in every if leaf.prefix})
    want = F.col("term").isin(exact) if exact else F.lit(False)
    for start in starts:
        want = want | F.col("term").startswith(start)
    hits = index.postings.where(want)
    # positions are only read for phrases; a term or a prefix by itself needs its frequency alone
    single = all(len(leaf.words) == 1 for leaf in every)

    def of_term(here: Column) -> Column:
        return F.sum(F.when(here, F.col("tf")).otherwise(0)) if single else F.flatten(F.collect_list(F.when(here, F.col("positions"))))

    places = [of_term(F.col("term") == t).alias(f"_p{k}") for k, t in enumerate(exact)]
    places += [of_term(F.col("term").startswith(s)).alias(f"_s{k}") for k, s in enumerate(starts)]
    found = hits.groupBy(*keys).agg(F.first("length").alias("length"), *places)

    def frequency(leaf: Leaf) -> Column:
        columns = [F.col(f"_p{exact.index(term_of(w))}") for w in (leaf.words[:-1] if leaf.prefix else leaf.words)]
        if leaf.prefix:
            columns.append(F.col(f"_s{starts.index(leaf.words[-1])}"))
        if len(columns) == 1:
            return columns[0] if single else F.size(columns[0])
        fits = lambda p: reduce(lambda a, b: a & b, [F.array_contains(c, p + k) for k, c in enumerate(columns) if k])
        return F.size(F.filter(columns[0], fits))

    for k, leaf in enumerate(every):
        found = found.withColumn(f"_f{k}", frequency(leaf))
    holds = {leaf: F.col(f"_f{k}") > 0 for k, leaf in enumerate(every)}

    def truth(node: object) -> Column:
        if isinstance(node, Leaf):
            return holds[node]
        left, right = truth(node.left), truth(node.right)
        return left & right if node.op == "AND" else left | right if node.op == "OR" else left & ~right

    names = [f"_f{k}" for k in range(len(every))]
    frequencies = found.select(*keys, "length", *names)
    counts = frequencies.agg(*[F.count_if(F.col(name) > 0).alias(name) for name in names]).first()
    chunks, average = index.chunks, index.average
    scored = frequencies.where(truth(tree))
    score = F.lit(0.0)
    for leaf in scoring:
        k = every.index(leaf)
        n = counts[f"_f{k}"] or 0
        idf = math.log((chunks - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col(f"_f{k}")
        score = score - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / average))
    return scored.select(*keys, score.alias("score"))


def best_per_session(hits: DataFrame, order: str = "score") -> DataFrame:
    """The best chunk of each session (ties: the first) with ``chunk_hits``, how many of its chunks were hit."""
    best = F.min(F.struct(order, "ordinal")).alias("_best")
    return hits.groupBy("session_id").agg(best, F.count(F.lit(1)).alias("chunk_hits")).select("session_id", F.col("_best.ordinal").alias("ordinal"), F.col(f"_best.{order}").alias(order), "chunk_hits")


def search(index: Index, sessions: DataFrame, raw: str, limit: int = 20, expand: bool = True) -> DataFrame:
    """The columns of ``sessions`` with ordinal, score and chunk_hits of the ``limit`` best sessions for a query.

    ``sessions`` (session_id, started_at, ...) is filtered beforehand; only its sessions are found.
    Best score first, then the newest, then by id. If fewer than ``limit`` sessions match, those an
    OR of the first terms finds are added and all are sorted together. A query that can't be read
    finds nothing.
    """
    tree = parse(raw)
    if tree is None:
        return sessions.select("*", F.lit(0).alias("ordinal"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("chunk_hits")).where("false")
    order = ["score", F.desc_nulls_last("started_at"), "session_id"]

    def leg(of: object) -> DataFrame:
        kept = sessions.select("session_id", "started_at")
        best = best_per_session(matches(index, of)).join(kept, "session_id")
        return best.orderBy(*order).limit(limit)

    found = leg(tree)
    wider = expanded(tree) if expand else None
    if wider is not None and wider != tree:
        spark = sessions.sparkSession
        rows = found.collect()  # at most ``limit`` rows: whether a second leg is needed depends on them
        found = spark.createDataFrame(rows, found.schema)
        if len(rows) < limit:
            more = leg(wider).join(F.broadcast(found.select("session_id")), "session_id", "left_anti")  # at most ``limit`` ids
            found = found.unionByName(more.select(found.columns)).orderBy(*order).limit(limit)
    # the rest of the sessions' columns are fetched for those found alone
    found = found.drop("started_at").join(sessions, "session_id") if set(sessions.columns) - {"session_id", "started_at"} else found
    return found.orderBy(*order)


def with_excerpts(found: DataFrame, index: Index, raw: str, size: int = 16) -> DataFrame:
    """``found`` of search() with ``excerpt``, the snippet of each session's best chunk; only bodies of the sessions found are read."""
    rows = found.select("session_id", "ordinal").collect()  # at most the search's limit
    bodies = index.bodies.where(F.col("session_id").isin(sorted({r["session_id"] for r in rows})))
    tree = parse(raw)
    words = sorted({w for leaf in (leaves(tree) if tree is not None else []) for w in leaf.words})
    return found.join(bodies.select("session_id", "ordinal", snippet(F.col("body"), words, size).alias("excerpt")), ["session_id", "ordinal"], "left")


def snippet(body: Column, words: list[str], size: int = 16) -> Column:
    """``size`` words of a chunk around the first of ``words``, hits in brackets, dots where text was left out."""
    tokens = F.split(body, " ")
    bare = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    first = F.coalesce(F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when(bare(t).isin(words), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(first - size // 2, F.lit(0))
    cut = F.transform(F.slice(tokens, start + 1, size), lambda t: F.when(bare(t).isin(words), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.concat(F.when(start > 0, " ... ").otherwise(""), F.array_join(cut, " "), F.when(start + size < F.size(tokens), " ... ").otherwise(""))


def fuse(legs: list[DataFrame], key: str = "id", k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank) lists: Σ 1/(k + rank), best first, ties by key; cut after fusing."""
    joined = reduce(lambda a, b: a.unionByName(b), [leg.select(F.col(key).alias("id"), "rank") for leg in legs])
    fused = joined.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id")
    return fused.limit(limit) if limit else fused


def ranked(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    """``rank`` from 1 over the first ``limit`` rows, which one task numbers."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(count: int, order: object) -> list[int]:
    """The order a model gives for ``count`` hits, made safe: distinct indices in range, the rest behind; the input order for anything else."""
    fine = isinstance(order, list) and all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i < count for i in order) and len(set(order)) == len(order)
    return [*order, *[i for i in range(count) if i not in set(order)]] if fine else list(range(count))


def hybrid(lexical: DataFrame, semantic: DataFrame, bodies: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, fused, score, chunk_hits, excerpt of two ranked legs (session_id, rank) fused by reciprocal rank.

    ``lexical`` also has score, chunk_hits and (it may) excerpt, which its sessions keep; those only
    ``semantic`` found get 0 for both and the head of their first chunk. Filter both legs alike
    beforehand: what one leg must not show, the other must not bring back.
    """
    fused = fuse([lexical.select(F.col("session_id").alias("id"), "rank"), semantic.select(F.col("session_id").alias("id"), "rank")], limit=limit)
    rows = fused.collect()  # ``limit`` rows
    excerpt = F.col("excerpt") if "excerpt" in lexical.columns else F.lit(None).cast("string").alias("excerpt")
    kept = lexical.sparkSession.createDataFrame(rows, fused.schema).select(F.col("id").alias("session_id"), F.col("score").alias("fused"))
    first = bodies.where((F.col("ordinal") == 0) & F.col("session_id").isin([r["id"] for r in rows])).select("session_id", F.substr("body", F.lit(1), F.lit(300)).alias("_head"))
    rows = kept.join(lexical.select("session_id", "score", "chunk_hits", excerpt), "session_id", "left").join(first, "session_id", "left")
    return rows.select("session_id", "fused", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("chunk_hits", F.lit(0)).alias("chunk_hits"), F.coalesce("excerpt", "_head").alias("excerpt")).orderBy(F.desc("fused"), "session_id")
