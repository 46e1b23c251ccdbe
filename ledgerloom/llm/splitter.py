"""Cutting oversized texts at natural boundaries with overlap, by pointer doubling.

Every place where a text may be cut is a boundary. For each boundary the farthest legal successor
is found: the piece from the boundary, with the overlap before it, must stay within both limits,
and of the boundaries within reach a natural one is preferred (a turn in the second half of the
reach, else a paragraph there, else the last turn, paragraph, line or sentence anywhere in reach,
else the last word, else a hard cut inside a word that is too long by itself). Following successors
from the start of the text gives the greedy cuts. They are all found at once: squaring the table of
successors (next, next of next, ...) marks the boundaries reached within 2**k cuts after k rounds,
so the work is a few array operations over all boundaries of all texts of a batch, not a walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.current import current_rows
from ledgerloom.session import spread

MAX_WORDS = 1000
MAX_CHARS = 8000
OVERLAP_WORDS = 60
WORD, LINE, PARAGRAPH, TURN = 1, 2, 3, 4
TURN_MARKS = ("[USER]", "[ASSISTANT]", "[SYSTEM]")
ENDS = np.array([ord(c) for c in ".!?。！？…"], dtype=np.uint32)
CLOSERS = np.array([ord(c) for c in "\"')]»”’」』）"], dtype=np.uint32)
SPACES = np.array([ord(c) for c in " \t\r\n"], dtype=np.uint32)


def _marks(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, their number before each place, and the level of each place as a boundary (0: none)."""
    n = len(chars)
    space = np.isin(chars, SPACES)
    newline = chars == 10
    before_space = np.concatenate(([True], space[:-1]))
    starts = ~space & before_space
    level = np.zeros(n + 1, dtype=np.int8)
    level[:n][starts] = WORD
    # an end of sentence, closing marks, then white space: the next word starts a sentence
    ends = np.isin(chars, ENDS)
    closed = ends.copy()
    closers = np.isin(chars, CLOSERS)
    closed[1:] |= closers[1:] & ends[:-1]
    closed[2:] |= closers[2:] & closers[1:-1] & ends[:-2]
    index = np.flatnonzero(starts)
    if len(index):
        # the last character before the white space in front of each word
        previous = np.maximum.accumulate(np.where(~space, np.arange(n), -1))
        last = np.where(index > 0, previous[np.maximum(index - 1, 0)], -1)
        lines = np.concatenate(([0], np.cumsum(newline)))
        between = lines[index] - lines[np.maximum(last, 0)]
        own = level[:n]
        sentence = (last >= 0) & closed[np.maximum(last, 0)]
        own[index[sentence | (between >= 1)]] = LINE
        own[index[between >= 2]] = PARAGRAPH
        opens = index[(chars[index] == ord("[")) & ((between >= 1) | (index == 0))]
        for mark in TURN_MARKS:
            is_mark = np.ones(len(opens), dtype=bool)
            for k, c in enumerate(mark):
                is_mark &= chars[np.minimum(opens + k, n - 1)] == ord(c)
            own[opens[is_mark]] = TURN
    # a wide full stop needs no space after it
    wide = np.flatnonzero(np.isin(chars, np.array([ord(c) for c in "。！？"], dtype=np.uint32))) + 1
    wide = wide[wide < n]
    wide = wide[~space[wide] & ~closers[wide]]
    level[wide] = np.maximum(level[wide], LINE)
    counts = np.concatenate(([0], np.cumsum(starts)))
    return index, counts, level


def cut_places(chars: np.ndarray, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The cuts of one text (with its end) and where the overlap of the piece after each cut starts."""
    n = len(chars)
    index, counts, level = _marks(chars)
    places = np.flatnonzero(level[:n] >= WORD)
    # inside long words and long white space: a place to cut every so many characters
    edges = np.unique(np.concatenate((np.array([0, n]), places))).astype(np.int64)
    step = max(1, max_chars // 8)
    wide_gaps = np.flatnonzero(np.diff(edges) > step)
    hard = [np.arange(edges[k], edges[k + 1], step)[1:] for k in wide_gaps]
    b = np.unique(np.concatenate((edges, *hard))).astype(np.int64)
    # overlap: the start of the word that lies `overlap` words before each boundary, moved on until a unit fits behind it
    words_before = counts[b]  # words that start before b
    reach = np.minimum(b + step, np.concatenate((b[1:], [n])))  # at least this much must fit
    back = np.maximum(words_before - overlap, 0)
    start = np.where(words_before > 0, index[np.minimum(back, max(len(index) - 1, 0))] if len(index) else 0, b)
    start = np.minimum(start, b)
    too_long = reach - start > max_chars
    if too_long.any():
        first = np.searchsorted(index, reach - max_chars, side="left")
        later = np.where(first < len(index), index[np.minimum(first, max(len(index) - 1, 0))], b)
        start = np.where(too_long, np.minimum(later, b), start)
    start[0] = 0
    # the farthest place within both limits
    # a piece that starts inside a word holds the rest of it as a word of its own
    at_start = np.minimum(start, n - 1)
    inside_word = (counts[np.minimum(start + 1, n)] == counts[start]) & ~np.isin(chars[at_start], SPACES)
    by_words = counts[start] + max_words - inside_word
    word_end = np.where(by_words < len(index), index[np.minimum(by_words, max(len(index) - 1, 0))] if len(index) else n, n)
    far = np.minimum(start + max_chars, np.maximum(word_end, 0))
    far = np.minimum(far, n)
    kinds = level[b]
    succ = np.searchsorted(b, far, side="right") - 1  # any boundary
    at = np.arange(len(b))
    halfway = b + (far - b) // 2

    def last_of(least: int, floor: np.ndarray) -> np.ndarray:
        of = np.flatnonzero(kinds >= least)
        if not len(of):
            return np.full(len(b), -1)
        k = np.searchsorted(b[of], far, side="right") - 1
        got = np.where(k >= 0, of[np.maximum(k, 0)], -1)
        return np.where((got > at) & (b[np.maximum(got, 0)] >= floor), got, -1)

    choice = last_of(TURN, halfway)
    for least, floor in ((PARAGRAPH, halfway), (LINE, b + 1), (WORD, b + 1)):
        other = last_of(least, floor)
        choice = np.where(choice >= 0, choice, other)
    choice = np.where(far >= n, len(b) - 1, np.where(choice >= 0, choice, succ))
    choice[-1] = len(b) - 1
    stuck = (choice <= at) & (at < len(b) - 1)
    # pointer doubling: boundaries reached from the first one
    reached = np.zeros(len(b), dtype=bool)
    reached[0] = True
    jump = np.where(stuck, len(b) - 1, choice)
    for _ in range(max(1, int(np.ceil(np.log2(len(b) + 1))))):
        reached[jump[reached]] = True
        jump = jump[jump]
        if jump[0] == len(b) - 1 and reached[jump[reached]].all() and (jump == len(b) - 1).all():
            break
    cuts = np.flatnonzero(reached)
    if stuck[cuts].any():  # words longer than an eighth of a piece are cut themselves, so something always fits
        raise AssertionError("no legal cut after some boundary")
    # a piece repeats no more than the piece before it holds
    overlap_start = np.maximum.accumulate(start[cuts[:-1]])
    return b[cuts], overlap_start


def pieces_of(text: str, **limits: int) -> list[tuple[int, int, int]]:
    """(start of the overlap, start of what is new, end) of each piece of a text; one piece if it is within the limits."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(chars) == 0:
        return [(0, 0, 0)]
    cuts, starts = cut_places(chars, **limits)
    return list(zip(starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def word_count(text: str | Column) -> Column:
    """Words of a text: runs of characters other than blank, tab and line ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != ""))


def oversized(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text exceeds a limit; words are only counted where there are characters enough for too many."""
    length = F.char_length(F.col(text))
    return (length > max_chars) | ((length >= 2 * max_words + 1) & (word_count(text) > max_words))


def split_texts(texts: DataFrame, keys: list[str], text: str = "text", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS, with_text: bool = True) -> DataFrame:
    """Pieces of the oversized texts: keys..., piece (from 0), overlap_start, start, end, pieces[, piece_text].

    ``piece_text`` is text[overlap_start:end]; text[start:end] of all pieces in order is the whole
    text. Lengths are code points. Texts within the limits, empty and null ones give no rows. A text
    is handled where it lies: no shuffle. Repeated keys are cut row by row.
    """
    large = texts.where(oversized(text, max_words, max_chars)).select(*keys, F.col(text).alias("_text"))
    kept = [f for f in large.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["piece int", "overlap_start int", "start int", "end int", "pieces int"] + ["piece_text string"] * with_text)
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.iloc[first : first + 256]
                rows, owner = [], []
                for at, value in enumerate(part["_text"]):
                    found = pieces_of(value, max_words=max_words, max_chars=max_chars, overlap=overlap)
                    rows += [(k, o, s, e, len(found), *([value[o:e]] if with_text else [])) for k, (o, s, e) in enumerate(found)]
                    owner += [at] * len(found)
                out = part[names].iloc[owner].reset_index(drop=True)
                made = pd.DataFrame(rows, columns=["piece", "overlap_start", "start", "end", "pieces"] + ["piece_text"] * with_text)
                yield pd.concat([out, made], axis=1)

    return large.mapInPandas(run, schema)


def current_marks(sessions: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """session_id, updated_at, _tie of the current rows: names the version without moving its text (of versions of one time the one with the most words)."""
    narrow = sessions.select("session_id", "updated_at", *(["words"] if "words" in sessions.columns else []), F.xxhash64(*fields).alias("_tie"))
    return current_rows(narrow, ["_tie"])


def session_pieces(sessions: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of every oversized session's current text, in order by (session_id, piece).

    Versions that are not current are cut too and dropped afterwards by (updated_at, hash of text),
    which spares a shuffle of all texts; exact copies count once.
    """
    rows = sessions.where(F.col("session_id").isNotNull()).select("session_id", "updated_at", F.xxhash64("text").alias("_tie"), "text")
    pieces = split_texts(spread(rows), ["session_id", "updated_at", "_tie"], with_text=with_text)
    marks = current_marks(sessions).withColumnRenamed("updated_at", "_at").withColumnRenamed("_tie", "_of")
    kept = pieces.join(marks, (pieces["session_id"] == marks["session_id"]) & pieces["updated_at"].eqNullSafe(marks["_at"]) & (pieces["_tie"] == marks["_of"]), "left_semi")
    return kept.drop("updated_at", "_tie").dropDuplicates(["session_id", "piece"])


def session_pieces_checked(sessions: DataFrame) -> DataFrame:
    """(session_id, within, whole, repeated, split): what must hold of every split session's pieces.

    ``within``: no piece exceeds a limit; ``whole``: what is new in each piece begins where the piece
    before it ends, from the first character to the last; ``repeated``: no piece begins more than
    the overlap's words before what is new in it, or before the start of the piece before it.
    """
    pieces = session_pieces(sessions)
    words_of = word_count(F.col("piece_text"))
    again = word_count(F.substr("piece_text", F.lit(1), F.col("start") - F.col("overlap_start")))
    told = pieces.select("session_id", "piece", "start", "end", "overlap_start", (F.col("end") - F.col("overlap_start")).alias("chars"), F.char_length("piece_text").alias("_chars"), words_of.alias("words"), again.alias("again"))
    of = Window.partitionBy("session_id").orderBy("piece")
    told = told.withColumn("_end", F.coalesce(F.lag("end").over(of), F.lit(0))).withColumn("_from", F.coalesce(F.lag("overlap_start").over(of), F.lit(0)))
    fine = [
        F.bool_and((F.col("words") <= MAX_WORDS) & (F.col("chars") <= MAX_CHARS) & (F.col("chars") == F.col("_chars"))).alias("within"),
        F.bool_and(F.col("start") == F.col("_end")).alias("_joined"),
        F.bool_and((F.col("again") <= OVERLAP_WORDS) & (F.col("overlap_start") >= F.col("_from"))).alias("repeated"),
    ]
    seen = told.groupBy("session_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("end").alias("_last"), *fine)
    lengths = sessions.where(F.col("session_id").isNotNull()).select("session_id", "updated_at", F.xxhash64("text").alias("_tie"), F.char_length("text").alias("_length"))
    marks = current_marks(sessions)
    lengths = lengths.join(marks, (lengths["session_id"] == marks["session_id"]) & lengths["updated_at"].eqNullSafe(marks["updated_at"]) & (lengths["_tie"] == marks["_tie"]), "left_semi").select("session_id", "_length").distinct()
    return seen.join(lengths, "session_id").select("session_id", "within", (F.col("_joined") & (F.col("_last") == F.col("_length"))).alias("whole"), "repeated", (F.col("pieces") > 1).alias("split"))


def split_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id) of the sessions that had to be split, told by their pieces."""
    return session_pieces(sessions, with_text=False).where(F.col("piece") == 1).select("session_id")
