"""Held-out items inside a corpus: BM25 over an inverted index of the items, pruned by block maxima.

Items are indexed by their words. Every document is cut into passages of PASSAGE words that overlap
by WINDOW - 1, so any WINDOW consecutive words lie whole in one passage. A passage is a query: its
BM25 score against an item is the sum of the item's term impacts over the passage's distinct words.
Each item has its own threshold, the least score any WINDOW of its consecutive words reaches; no
passage that holds such a window scores less, so retrieving all items at or above their threshold
loses none. Items are stored in blocks with the greatest impact of each term in each block; a block
whose bound stays below all its thresholds is skipped, the rest is scored exactly (block-max WAND,
done for many passages at once on arrays). Retrieved pairs are then verified word by word.

Items come in index blocks of about ITEMS_A_BLOCK items and WORDS_A_BLOCK words, each broadcast on
its own. An index has four bytes for each pair of a word and an item, so what is sent to the
executors at once stays below 200 MB (1 MB for the 240 items here), however many items there are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

WINDOW = 12
PASSAGE = 64
K1, B = 1.2, 0.75
BLOCK = 8
ITEMS_A_BLOCK, WORDS_A_BLOCK = 1024, 50_000
#: Passages scored at once.
BATCH = 4096

WORDS = re.compile(r"[^\W_]+")
#: Characters without width or ink, which are dropped before words are told apart.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared: references resolved, compatibility forms and case folded, invisible characters dropped."""
    if not text:
        return []
    if not text.isascii() or "&" in text:
        if "&" in text:
            for _ in range(2):  # a reference may itself have been escaped
                text = ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
            return WORDS.findall(text.casefold())
    return WORDS.findall(text.lower())


def rolling(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of every run of ``window`` codes."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    total = np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(window):
            total = total * np.int64(6364136223846793005) + codes[k : k + n] * np.int64(1442695040888963407)
    return total


class ItemIndex:
    """Inverted index with block maxima of one block of items: [(item_id, text)...]."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        texts = [(i, words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= window]
        texts.sort(key=lambda x: (len(x[1]), x[0]))  # items of like length share a block
        self.ids = np.array([i for i, _ in texts], dtype=np.int64)
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], dtype=np.int64) for _, t in texts]
        self.coded = coded
        n, terms = len(texts), len(self.vocabulary) + 1
        counts = np.zeros((terms, n), dtype=np.float32)
        for k, c in enumerate(coded):
            np.add.at(counts[:, k], c, 1)
        lengths = np.array([len(c) for c in coded], dtype=np.float32)
        present = (counts > 0).sum(axis=1)
        idf = np.log1p((n - present + 0.5) / (present + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1) if n else 1)
        self.impact = idf[:, None] * counts * (K1 + 1) / (counts + norm) if n else counts
        self.impact[0] = 0  # words no item has
        blocks = -(-n // BLOCK) if n else 0
        padded = np.zeros((terms, blocks * BLOCK), dtype=np.float32)
        padded[:, :n] = self.impact
        self.impact = np.ascontiguousarray(padded)
        self.block_max = np.ascontiguousarray(padded.reshape(terms, blocks, BLOCK).max(axis=2)) if n else padded
        self.threshold = np.full(blocks * BLOCK, np.inf, dtype=np.float32)
        grams, homes, starts = [], [], []
        for k, c in enumerate(coded):
            hashed = rolling(c, window)
            grams.append(hashed)
            homes.append(np.full(len(hashed), k))
            starts.append(np.arange(len(hashed)))
            least = min(float(self.impact[np.unique(c[j : j + window]), k].sum()) for j in range(len(hashed)))
            self.threshold[k] = least * (1 - 1e-4) - 1e-6  # room for the order of float sums
        self.grams, self.homes, self.starts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, homes, starts))
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.homes, self.starts = self.grams[order], self.homes[order], self.starts[order]
        self.block_threshold = self.threshold.reshape(blocks, BLOCK).min(axis=1) if n else self.threshold

    def retrieve(self, owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item position) pairs at or above the item's threshold; owner/term are distinct pairs sorted by passage."""
        got_p, got_i = [], []
        if not len(owner) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        present = owner[starts]
        bound = np.add.reduceat(self.block_max[term], starts, axis=0)
        row, block = np.nonzero(bound >= self.block_threshold)
        ends = np.append(starts[1:], len(owner))
        # exact scores of the blocks that may hold a hit, block by block
        order = np.argsort(block, kind="stable")
        row, block = row[order], block[order]
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.empty(0, np.int64)
        for a, z in zip(edges, np.append(edges[1:], len(block))):
            at, rows = int(block[a]), row[a:z]
            size = ends[rows] - starts[rows]
            offset = np.concatenate(([0], np.cumsum(size)[:-1]))
            pick = np.repeat(starts[rows] - offset, size) + np.arange(size.sum())
            score = np.add.reduceat(self.impact[term[pick], at * BLOCK : (at + 1) * BLOCK], offset, axis=0)
            r, i = np.nonzero(score >= self.threshold[at * BLOCK : (at + 1) * BLOCK])
            got_p.append(present[rows[r]])
            got_i.append(i + at * BLOCK)
        return (np.concatenate(got_p), np.concatenate(got_i)) if got_p else (np.empty(0, np.int64), np.empty(0, np.int64))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Distinct (position of the text, item_id) of the texts that hold ``window`` consecutive words of an item."""
        lookup, stride = self.vocabulary.get, PASSAGE - self.window + 1
        coded = [np.fromiter((lookup(w, 0) for w in words(t)), dtype=np.int64) if t else np.empty(0, np.int64) for t in texts]
        passage_text, owners, terms = [], [], []
        for k, c in enumerate(coded):
            if np.count_nonzero(c) < self.window:
                continue
            known = c != 0
            n = max(1, -(-(len(c) - self.window + 1) // stride))
            base = len(passage_text)
            passage_text += [k] * n
            position = np.flatnonzero(known)
            home = position // stride
            first = np.minimum(home, n - 1)
            owners.append(base + first)
            terms.append(c[position])
            shared = (home > 0) & (position - home * stride < self.window - 1)  # also in the passage before
            shared &= home - 1 < n
            owners.append(base + home[shared] - 1)
            terms.append(c[position[shared]])
        if not owners:
            return
        pairs = np.unique(np.concatenate(owners) * (len(self.vocabulary) + 1) + np.concatenate(terms))
        owner, term = pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)
        retrieved = []
        edges = np.searchsorted(owner, np.arange(0, len(passage_text) + BATCH, BATCH))
        for a, z in zip(edges[:-1], edges[1:]):
            found_p, found_i = self.retrieve(owner[a:z], term[a:z])
            retrieved.append(found_p * len(self.ids) + found_i)
        yield from self.verify(coded, np.array(passage_text), np.unique(np.concatenate(retrieved)))

    def verify(self, coded: list[np.ndarray], passage_text: np.ndarray, retrieved: np.ndarray) -> Iterator[tuple[int, int]]:
        """The retrieved (passage, item) pairs whose passage holds ``window`` consecutive words of the item."""
        if not len(retrieved):
            return
        stride = PASSAGE - self.window + 1
        held = np.unique(retrieved // len(self.ids))
        texts = np.unique(passage_text[held])
        sizes = np.array([len(coded[k]) for k in texts])
        joined, offset = np.concatenate([coded[k] for k in texts]), np.concatenate(([0], np.cumsum(sizes)))
        hashed = rolling(joined, self.window)
        at = np.searchsorted(self.grams, hashed)
        alike = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == hashed)
        home = np.searchsorted(offset, alike, side="right") - 1
        whole = alike + self.window <= offset[home + 1]  # not across two texts
        first_passage = np.searchsorted(passage_text, texts)
        seen = set()
        for place, own in zip(alike[whole].tolist(), home[whole].tolist()):
            passage = int(first_passage[own]) + (place - int(offset[own])) // stride  # the one that holds this run whole
            for g in range(int(at[place]), len(self.grams)):
                if self.grams[g] != hashed[place]:
                    break
                i, start = int(self.homes[g]), int(self.starts[g])
                pair = passage * len(self.ids) + i
                found = np.searchsorted(retrieved, pair)
                if (own, i) not in seen and found < len(retrieved) and retrieved[found] == pair and (self.coded[i][start : start + self.window] == joined[place : place + self.window]).all():
                    seen.add((own, i))
                    yield int(texts[own]), int(self.ids[i])


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item): each document with each item of which it holds at least WINDOW consecutive words.

    Items of fewer words can't leak and documents of fewer can't hold any; null and empty texts give
    no rows; items with the same text leak together; repeated (key, item) come out once. Documents
    are read where they lie, once for each block of items.
    """
    spark = documents.sparkSession
    key_type, item_type = dict(documents.dtypes)[key], dict(items.dtypes)[item]
    narrow = spread(documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text")))
    numbered = items.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).distinct()
    size = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.split("_text", " "))), F.lit(0)).alias("words")).first()
    out = None
    blocks = max(1, -(-size["n"] // ITEMS_A_BLOCK), -(-size["words"] // WORDS_A_BLOCK))
    for block in range(blocks):
        mine = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block)
        rows = [(r["_item"], r["_text"]) for r in mine.collect()]  # one block of items
        names = [i for i, _ in rows]
        index = spark.sparkContext.broadcast(ItemIndex([(k, t) for k, (_, t) in enumerate(rows)]))

        def run(batches: Iterator[pd.DataFrame], index=index, names=names) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first in range(0, len(batch), 512):
                    part = batch.iloc[first : first + 512]
                    hits = list(index.value.search(part["_text"].tolist()))
                    yield pd.DataFrame({key: part[key].iloc[[k for k, _ in hits]].to_numpy(), item: [names[i] for _, i in hits]})

        found = narrow.mapInPandas(run, f"`{key}` {key_type}, `{item}` {item_type}")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
