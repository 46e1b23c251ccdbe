"""Texts cut by a field limit or a broken transfer: a vocabulary trie, sentence ends and length evidence.

Three kinds of evidence are multiplied into the odds that a text was cut where it ends:

* the trie of the corpus vocabulary: how often the last token occurs as a whole word away from the
  ends of texts, and how often longer words begin with it. An unknown proper prefix of known words
  is the strongest sign; a known word that is mostly the beginning of others counts less;
* sentence ends: how often the last one to four tokens are followed by the end of a sentence or
  line elsewhere. "... and the" never is, "... with the flag off" nearly always, stop or no stop;
* lengths: a source with far more texts of one exact length (in characters or bytes) than of the
  lengths around it, and few longer, has a field limit there; one whose texts pile up in a narrow
  band with few beyond cuts at the last word before a limit.

Last lines that end a fair share of all different texts ("Done", "Thanks", "And so on...") are
closings; copies of one text are one there, as for lengths. All other counts run over all documents. What has to be counted is only the contexts in which documents
end; a bitmap of bounded size tells the counting tasks which these may be, and a join settles it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.current import label
from ledgerloom.session import spread, temporary_folder

ORDERS = 4
#: Runs of signs between blanks that hold the last tokens for certain, and the characters they usually fit in.
TAIL_RUNS, TAIL_CHARS = 8, 400
#: Prefixes up to this length are nodes of the trie; longer last tokens are looked up among the words that share so many letters.
DEPTH = 32
#: The filter has about so many bits for each document, within these powers of two (32 MB at the most; what it lets through beyond that, a join settles).
BITS_A_DOCUMENT, LEAST_BITS, MOST_BITS = 64, 16, 28
FLUSH = 200_000
#: Odds that a text is cut before anything is known of it, and the share of all different texts from which a last line is a closing.
PRIOR = 0.07
CLOSING_SHARE = 0.002
#: Factors on the odds.
AT_LIMIT, IN_BAND, BROKEN, OPEN_FENCE, CLOSING, STOPPED = 200.0, 25.0, 1000.0, 30.0, 0.01, 0.05
#: A cutting mark behind the text, where lengths speak for a cut and where they don't.
MARKED_THERE, MARKED = 10.0, 3.0
#: How much less a word counts as a whole one after a word it never follows elsewhere.
UNSEEN_PAIR = 20.0
#: Odds count in full only as far as this much was seen of a context.
WEIGHT = 2.0

RUN = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[.!?…]+[\"')\]»”]*(?=\s|$)|[。！？]|\n|[^\s\w]|_")
PIECE = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-ÿ])|.", re.S)
END, NUMBER, NAME = ".", "#", "_"
#: Marks that a cut puts behind a text.
MARKER = re.compile(r"(?:\s*(?:…|\.\.\.|\[\.\.\.\]|\[…\]|[(\[](?:cut|more|truncated|snip|continued|gekürzt|tronqué|cortado)[)\]]))$", re.I)
REPLACED = "�"
BROKEN_END = re.compile(r"(?:�|&#?[A-Za-z0-9]{0,8}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-F]?)$")
STOP = re.compile(r"[.!?。！？][\"')\]»”]*$")


def pieces(run: str) -> list[str]:
    """The words of a run: parts of camel case and snake case apart, in lower case; anything with digits one number, ends of sentences alike."""
    if run == "\n":
        return ["\n"]
    if run[0] in ".!?。！？…" and (len(run) > 1 or run in "!?。！？…."):
        return [END]
    if any(c.isdigit() for c in run):
        return [NUMBER]
    if len(run) == 1:
        return [run.lower()]
    return [p.lower() for part in run.split("_") for p in PIECE.findall(part)]


class Tokens:
    """Texts to arrays of 64-bit token hashes, remembering the words behind them.

    A token is a word, a number, a sign or an end; an identifier of several words is one token,
    as which one it is tells nothing of where a sentence ends.
    """

    def __init__(self) -> None:
        self.known: dict[str, tuple[int | None, tuple[int, ...]]] = {}
        self.words: dict[int, str] = {}
        self.end, self.line, self.name = self.hash(END), self.hash("\n"), self.hash(NAME)

    def hash(self, token: str) -> int:
        h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - 2**63
        if token[:1].isalpha():
            self.words[h] = token
        return h

    def codes(self, text: str) -> tuple[list[int], list[int], int]:
        """Tokens, the words among them (parts of identifiers each), and how many of the words are the last token's."""
        known, out, words, last = self.known, [], [], 0
        if len(known) > 4 * FLUSH:
            known.clear()
        for run in RUN.findall(text):
            got = known.get(run)
            if got is None:
                parts = tuple(self.hash(p) for p in pieces(run))
                # letters without blanks between them, as in Japanese, are tokens each
                got = (self.name if len(parts) > 1 and run.isascii() else None if len(parts) != 1 else parts[0], parts)
                if len(run) < 40:
                    known[run] = got
            code, parts = got
            if code is None:
                out += parts
                last = 1
            else:
                out.append(code)
                last = len(parts)
            words += parts
        return out, words, last


def contexts(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1..ORDERS tokens up to each token."""
    out = [codes]
    with np.errstate(over="ignore"):
        for k in range(1, ORDERS):
            before = np.concatenate((np.zeros(k, np.int64), codes[:-k])) if len(codes) > k else np.zeros(len(codes), np.int64)
            out.append(out[-1] * np.int64(6364136223846793005) + before * np.int64(1442695040888963407) + np.int64(k))
    return out


def bit_of(h: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(64 - bits))


def last_runs(text: str) -> str:
    """The end of a text from the start of its last TAIL_RUNS runs of signs between blanks, or the whole of it."""
    at = len(text)
    for _ in range(TAIL_RUNS):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return text[at:]


def tail_facts(text: str | None, tokens: Tokens) -> tuple:
    """What the end of a text shows: last token, hashes of its contexts, broken, marked, stopped."""
    text = last_runs((text or "").rstrip())
    broken = bool(BROKEN_END.search(text))
    bare = BROKEN_END.sub("", text) if broken else text
    marked = MARKER.search(bare)
    if marked:
        bare = bare[: marked.start()].rstrip()
    stopped = bool(STOP.search(bare)) and not marked
    found, words, _ = tokens.codes(bare)
    codes = np.array(found, dtype=np.int64)
    if not len(codes):
        return ("", *[0] * ORDERS, broken, bool(marked), stopped)
    last = tokens.words.get(words[-1], "") if bare and bare[-1].isalpha() else ""
    return (last, *[int(c[-1]) for c in contexts(codes)], broken, bool(marked), stopped)


def tails(documents: DataFrame) -> DataFrame:
    """One row a document with a text: doc_id, source, lengths, whether a code fence is open, a hash that copies share, and the facts of its end."""
    text = F.col("text")
    fences = F.regexp_count(text, F.lit(r"(?m)^[ \t]*```"))
    whole = F.rtrim(text)
    tail = F.right(whole, F.lit(TAIL_CHARS))
    # the last characters do where they hold runs enough, else the whole text is looked at
    tail = F.when(F.regexp_count(tail, F.lit(r"\s\S")) > TAIL_RUNS, tail).otherwise(whole)
    line = F.xxhash64(F.btrim(F.substring_index(F.btrim(text, F.lit(" \t\r\n")), "\n", -1), F.lit(" \t\r")))
    narrow = documents.where(F.length(F.btrim(text, F.lit(" \t\r\n"))) > 0).select("doc_id", label("source").alias("source"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"), (fences % 2 == 1).alias("open_fence"), F.xxhash64(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"\s+", " ")).alias("copy"), line.alias("line"), tail.alias("_tail"))
    facts = ["last", *[f"h{k}" for k in range(1, ORDERS + 1)], "broken", "marked", "stopped"]
    kept = ["doc_id", "source", "chars", "bytes", "open_fence", "copy", "line"]
    id_type = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, source string, chars int, bytes int, open_fence boolean, copy long, line long, last string, " + ", ".join(f"h{k} long" for k in range(1, ORDERS + 1)) + ", broken boolean, marked boolean, stopped boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            rows = [tail_facts(t, tokens) for t in batch["_tail"]]
            yield pd.concat([batch[kept].reset_index(drop=True), pd.DataFrame(rows, columns=facts)], axis=1)

    return spread(narrow).mapInPandas(run, schema)


def corpus_counts(documents: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """(word, h, n, ends): words away from the ends of texts with n, and contexts that ``wanted`` may hold with n and how often an end follows."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, held_bits = Tokens(), shared.value
        seen: dict[int, int] = {}
        totals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def words() -> pd.DataFrame:
            got = [(tokens.words[h], n) for h, n in seen.items() if h in tokens.words]
            return pd.DataFrame({"word": [w for w, _ in got], "h": 0, "n": [n for _, n in got], "ends": 0})

        def ends() -> pd.DataFrame:
            h, n, e = (np.concatenate(x) for x in zip(*totals))
            u, at = np.unique(h, return_inverse=True)
            return pd.DataFrame({"word": None, "h": u, "n": np.bincount(at, n).astype(np.int64), "ends": np.bincount(at, e).astype(np.int64)})

        for batch in batches:
            for first in range(0, len(batch), 256):
                parts, lengths, vocabulary = [], [], []
                for text in batch["text"].iloc[first : first + 256]:
                    codes, found, last = tokens.codes(text.rstrip())
                    if len(codes) > 1:
                        parts += codes
                        lengths.append(len(codes))
                        vocabulary += found[: len(found) - last]
                if not parts:
                    continue
                codes = np.array(parts, dtype=np.int64)
                inner = np.ones(len(codes), dtype=bool)
                inner[np.cumsum(lengths) - 1] = False  # what follows the last token is not known
                u, n = np.unique(np.array(vocabulary, dtype=np.int64), return_counts=True)
                for h, k in zip(u.tolist(), n.tolist()):
                    seen[h] = seen.get(h, 0) + k
                after = np.concatenate((codes[1:], [0]))
                end = (after == tokens.end) | (after == tokens.line)
                for context in contexts(codes):
                    at = context.view(np.uint64) >> np.uint64(64 - bits)
                    hit = inner & ((held_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    u, back = np.unique(context[hit], return_inverse=True)
                    totals.append((u, np.bincount(back, minlength=len(u)), np.bincount(back, end[hit], minlength=len(u))))
                    held += len(u)
                if held > FLUSH:
                    yield ends()
                    totals, held = [], 0
                if len(seen) > FLUSH:
                    yield words()
                    seen = {}
                    tokens = Tokens()
        if totals:
            yield ends()
        if seen:
            yield words()

    texts = documents.where(F.length("text") > 0).select("text")
    found = spread(texts).mapInPandas(run, "word string, h long, n long, ends long")
    return found.groupBy("word", "h").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def trie(words: DataFrame) -> DataFrame:
    """The vocabulary trie to DEPTH letters as a table of its nodes: prefix, ``whole`` (that word's count) and ``longer`` (of words that go on)."""
    lengths = F.sequence(F.lit(1), F.least(F.char_length("word"), F.lit(DEPTH)))
    nodes = words.select("word", "n", F.explode(lengths).alias("k")).select(F.substr(F.col("word"), F.lit(1), F.col("k")).alias("prefix"), "word", "n")
    same = F.col("prefix") == F.col("word")
    return nodes.groupBy("prefix").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("whole"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("longer"))


def deep_nodes(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The nodes of ``prefixes`` (prefix) that are longer than DEPTH, found among the words that share their first DEPTH letters."""
    head = lambda c: F.substr(F.col(c), F.lit(1), F.lit(DEPTH))
    asked = prefixes.where(F.char_length("prefix") > DEPTH).distinct().withColumn("_head", head("prefix"))
    long_words = words.where(F.char_length("word") > DEPTH).groupBy("word").agg(F.sum("n").alias("n")).withColumn("_head", head("word"))
    met = asked.join(long_words, "_head").where(F.col("word").startswith(F.col("prefix")))
    same = F.col("prefix") == F.col("word")
    return met.groupBy("prefix").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("whole"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("longer"))


def field_limits(ends: DataFrame) -> DataFrame:
    """(source, unit, low, high, exact): the lengths at which a source's texts were cut.

    ``exact``: one length with at least 5 texts, ten times as many as the lengths around it have on
    average, and no more than twice as many texts beyond. Otherwise the band of 24 lengths that
    holds most texts, if at least 8, six times what a band before it holds and five times what lies beyond.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counts = ends.select("source", unit.alias("_u")).select("source", "_u.*").groupBy("source", "unit", "length").count()
    of = Window.partitionBy("source", "unit").orderBy("length")
    near = F.sum("count").over(of.rangeBetween(-32, 32)) - F.col("count")
    beyond = F.coalesce(F.sum("count").over(of.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    past_band = F.coalesce(F.sum("count").over(of.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    band = F.sum("count").over(of.rangeBetween(-23, 0))
    before = F.coalesce(F.sum("count").over(of.rangeBetween(-119, -24)), F.lit(0))
    at = counts.select("source", "unit", "length", "count", near.alias("near"), beyond.alias("beyond"), past_band.alias("past"), band.alias("band"), before.alias("before"))
    exact = at.where((F.col("count") >= 5) & (F.col("count") >= 10 * (F.col("near") / 64 + 0.1)) & (F.col("beyond") <= 2 * F.col("count")))
    exact = exact.select("source", "unit", F.col("length").alias("low"), F.col("length").alias("high"), F.lit(True).alias("exact"))
    soft = at.where((F.col("band") >= 8) & (F.col("band") >= 6 * (F.col("before") / 4 + 0.5)) & (F.col("past") * 5 <= F.col("band")))
    best = Window.partitionBy("source", "unit").orderBy(F.desc("band"), "length")
    soft = soft.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return exact.unionByName(soft.select("source", "unit", (F.col("length") - 23).alias("low"), F.col("length").alias("high"), F.lit(False).alias("exact")))


def truncation_odds(documents: DataFrame) -> DataFrame:
    """doc_id, source, odds and the evidence of every document that has a text; odds above 1 say it was cut.

    Null, empty and blank texts were not cut and give no row. Counts and lengths take all rows,
    repeated ones included. Two small tables (a row a document, and the counts asked for) are
    written to the shared folder, so a lost executor costs no second pass over the texts.
    """
    spark = documents.sparkSession
    folder = temporary_folder(spark, "truncation")
    tails(documents).write.parquet(f"{folder}/ends")
    ends = spark.read.parquet(f"{folder}/ends")

    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_DOCUMENT * ends.count()).bit_length()))
    hashes = ends.select(F.explode(F.array(*[f"h{k}" for k in range(1, ORDERS + 1)])).alias("h")).select(bit_of(F.col("h"), bits).alias("bit"))
    # 2**bits bits in at most 2**(bits - 6) words
    words64 = hashes.groupBy(F.call_function("shiftright", F.col("bit"), F.lit(6)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    wanted = np.zeros(2 ** (bits - 6), dtype="<i8")
    found = words64.toPandas()
    wanted[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    corpus_counts(documents, wanted.view(np.uint8), bits).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")

    vocabulary = counts.where(F.col("word").isNotNull()).select("word", "n")
    nodes = trie(vocabulary).unionByName(deep_nodes(vocabulary, ends.select(F.col("last").alias("prefix"))))
    after = counts.where(F.col("word").isNull()).select("h", "n", "ends")
    rate = after.join(ends.select(F.col("h1").alias("h")).distinct(), "h", "left_semi").agg((F.sum("ends") / F.sum("n")).alias("rate")).first()["rate"]  # one number
    facts = ends.join(nodes.withColumnRenamed("prefix", "last"), "last", "left")
    for k in range(1, ORDERS + 1):
        facts = facts.join(after.select(F.col("h").alias(f"h{k}"), F.col("n").alias(f"n{k}"), F.col("ends").alias(f"e{k}")), f"h{k}", "left")
    total = ends.select("copy").distinct().count()
    closings = ends.groupBy("line").agg(F.count_distinct("copy").alias("_lines")).where((F.col("_lines") >= 3) & (F.col("_lines") >= CLOSING_SHARE * total)).select("line", F.lit(True).alias("closing"))
    facts = facts.join(closings, "line", "left")
    limits = field_limits(ends.select("source", "chars", "bytes", "copy").distinct())
    hits = ends.join(limits, "source").where(F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes")).between(F.col("low"), F.col("high")))
    hits = hits.groupBy("doc_id").agg(F.max("exact").alias("at_limit"))
    facts = facts.join(hits, "doc_id", "left").withColumn("rate", F.lit(float(rate or 0.0)))

    p = F.col("rate")
    for k in range(1, ORDERS + 1):
        n, e = F.coalesce(F.col(f"n{k}"), F.lit(0)), F.coalesce(F.col(f"e{k}"), F.lit(0))
        p = (e + WEIGHT * p) / (n + WEIGHT)
    whole, longer = F.coalesce(F.col("whole"), F.lit(0)), F.coalesce(F.col("longer"), F.lit(0))
    # a word that nowhere else follows the one before it is less likely to be itself
    known = F.when(F.col("n2") > 0, whole).otherwise(whole / UNSEEN_PAIR)
    word = F.when(F.col("last") == "", F.lit(1.0)).otherwise((known + longer + 0.1) / (known + 0.1))
    prose = F.when(F.col("stopped"), F.lit(STOPPED)).otherwise(word * F.col("rate") / F.greatest(p, F.lit(1e-4)))
    # a closing says nothing against a proven limit or a broken character
    proven = F.coalesce("at_limit", F.lit(False)) | F.col("broken")
    prose = F.when(F.coalesce("closing", F.lit(False)) & ~proven, F.least(prose, F.lit(1.0)) * CLOSING).otherwise(prose)
    odds = PRIOR * prose
    odds = odds * F.when(F.col("at_limit"), F.lit(AT_LIMIT)).when(~F.col("at_limit"), F.lit(IN_BAND)).otherwise(1.0)
    mark = F.when(F.col("at_limit").isNotNull(), F.lit(MARKED_THERE)).otherwise(F.lit(MARKED))
    odds = odds * F.when(F.col("marked") & ~F.coalesce("closing", F.lit(False)), mark).otherwise(1.0)
    odds = odds * F.when(F.col("broken"), F.lit(BROKEN)).otherwise(1.0) * F.when(F.col("open_fence"), F.lit(OPEN_FENCE)).otherwise(1.0)
    return facts.select("doc_id", "source", odds.alias("odds"), "last", whole.alias("whole"), longer.alias("longer"), p.alias("end_rate"), "at_limit", "broken", "marked", "stopped", "open_fence", F.coalesce("closing", F.lit(False)).alias("closing"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that were cut, each once."""
    return truncation_odds(documents).where("odds > 1").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source (trimmed, lower case; null is a source of its own): documents with a text, how many were cut, and the share."""
    return truncation_odds(documents).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("odds") > 1).alias("cut"), (F.count_if(F.col("odds") > 1) / F.count(F.lit(1))).alias("share"))
