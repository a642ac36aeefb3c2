"""Benchmark decontamination: BM25 over an index of the test items, every training passage a query.

Item weights are BM25's, divided by the item's score against its own text, so that one threshold
holds for all: a passage with all words of an item scores 1. Passages are windows of twice the
longest item, half of it apart, over all words of a document, so each item that a document holds
lies wholly in a passage. All items above the threshold are retrieved: a passage's rare terms alone
must first reach what an item's common terms leave open (the pivot test of WAND, for a batch of passages at
once), and those that do query the block-max index. The overlap of word shingles with the item's
question, and of words with its answer, then decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blockmax import BlockMaxIndex

WORDS = 5
SCORE = 0.6
QUESTION, ANSWER = 0.8, 0.5
K1, B = 1.2, 0.75
#: Items of one index, which is broadcast; more items make more indexes, one after another.
ITEMS = 20_000
LEAST_WINDOW = 32
#: Words that are handled at once.
WINDOW_WORDS = 1 << 20
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The item's words: its last line, or else last sentence, is the answer; an item of one sentence has none."""
    parts = [x for x in re.split(r"\n+", (text or "").strip()) if tokens(x)]
    if len(parts) < 2:
        parts = [x for x in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if tokens(x)]
    return ([w for x in parts[:-1] for w in tokens(x)], tokens(parts[-1])) if len(parts) > 1 else (tokens(text), [])


class ItemIndex:
    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        items = sorted({(i, t) for i, t in items if i is not None and tokens(t)})
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        words = [tokens(t) for _, t in items]
        self.window = max([LEAST_WINDOW, *map(len, words)])
        self.term: dict[str, int] = {}
        rows = []
        mean = sum(map(len, words)) / max(1, len(words))
        for e, own in enumerate(words):
            counts: dict[int, int] = {}
            for w in own:
                t = self.term.setdefault(w, len(self.term))
                counts[t] = counts.get(t, 0) + 1
            rows += [(t, e, n * (K1 + 1) / (n + K1 * (1 - B + B * len(own) / mean))) for t, n in counts.items()]
        terms, entries, weights = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        df = np.bincount(terms.astype(int), minlength=len(self.term))
        weights = weights * np.log1p((len(items) - df + 0.5) / (df + 0.5))[terms]
        weights = weights / np.bincount(entries, weights, len(items))[entries] if len(items) else weights
        self.index = BlockMaxIndex(terms, entries, weights, len(self.term), len(items))
        # the commonest terms are left out of the first test as long as no item has over half the threshold in them
        self.rest, self.essential = np.zeros(len(items)), np.ones(len(self.term), bool)
        for t in np.argsort(-df, kind="stable").tolist():
            a, b = self.index.start[t], self.index.start[t + 1]
            more = self.rest[self.index.entries[a:b]] + self.index.weights[a:b]
            if df[t] < 3 or (more > SCORE / 2).any():
                break
            self.rest[self.index.entries[a:b]] = more
            self.essential[t] = False

    def passages(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(document, window) that can hold an item; ids: terms of all documents' words, or -1."""
        at = np.flatnonzero(ids >= 0)
        at = at[self.essential[ids[at]]]
        doc = np.searchsorted(ends, at, side="right")
        window = (at - np.append(0, ends)[doc]) // self.window
        key = np.unique(np.concatenate([((doc << 24) | w) * len(self.term) + ids[at] for w in (window, np.maximum(window - 1, 0))]))
        passage, term = key // len(self.term), key % len(self.term)
        start, n = self.index.start[term], self.index.start[term + 1] - self.index.start[term]
        flat = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pair, back = np.unique(np.repeat(passage, n) * len(self.ids) + self.index.entries[flat], return_inverse=True)
        good = np.bincount(back, self.index.weights[flat], len(pair)) >= SCORE - self.rest[pair % len(self.ids)] - 1e-9
        return [(int(p >> 24), int(p & 0xFFFFFF)) for p in np.unique(pair[good] // len(self.ids))]

    def leaks(self, words: list[str]) -> list[tuple[int, float, float, float]]:
        """(item, score, question and answer overlap) of the items that a passage holds."""
        query = [(t, 1.0) for t in {self.term[w] for w in words if w in self.term}]
        out, own, have = [], None, set(words)
        for e, score in self.index.above(sorted(query), SCORE):
            own = _shingles(words) if own is None else own
            question, answer = self.parts[e]
            asked = _shingles(question)
            q = len(asked & own) / len(asked) if len(question) >= WORDS else float(any(words[k : k + len(question)] == question for k in range(len(words))))
            a = sum(w in have for w in answer) / len(answer) if answer else 1.0
            if q >= QUESTION and a >= ANSWER:
                out.append((e, score, q, a))
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(row, item_id, best score, question overlap, answer overlap) of all leaks in ``texts``."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        get = self.term.get
        for row, text in enumerate(texts):  # a very long text goes by itself
            if text and len(text) > 8 * WINDOW_WORDS:
                self._search([text], [row], best, get)
        rows = [r for r, t in enumerate(texts) if t and len(t) <= 8 * WINDOW_WORDS]
        first = size = 0
        for k, r in enumerate(rows):
            size += len(texts[r])
            if size > 8 * WINDOW_WORDS or k == len(rows) - 1:
                self._search([texts[x] for x in rows[first : k + 1]], rows[first : k + 1], best, get)
                first, size = k + 1, 0
        return [(r, self.ids[e], *x) for (r, e), x in sorted(best.items())]

    def _search(self, texts, rows, best, get) -> None:
        words = [tokens(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        ids = np.fromiter((get(w, -1) for own in words for w in own), np.int64, int(ends[-1]))
        for d, w in self.passages(ids, ends):
            for e, *found in self.leaks(words[d][w * self.window : (w + 2) * self.window]):
                key = rows[d], e
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), tuple(found))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak; no row for clean documents.

    Null texts, and items without a word or an id, match nothing. Repeated rows of ``docs`` give
    repeated rows, repeated items none.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    shards = max(1, -(-items.count() // ITEMS))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).select("item_id", "text")
        shared = spark.sparkContext.broadcast(ItemIndex([tuple(x) for x in own.collect()]))  # about ITEMS rows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches if index.ids else ():
                ids = batch.column(0).to_pylist()
                found = index.search(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([ids[x[0]] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay, all columns stay."""
    found = leaks(docs.filter(F.col("doc_id").isNotNull()), items).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_leak"), "left_anti")


def op9(spark, sf_dir: str) -> DataFrame:
    """All benchmark items that documents hold."""
    common.small_batches(spark)
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
