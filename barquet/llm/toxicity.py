"""Toxicity by the nearest labelled examples.

Terms are words and their beginnings (for languages that inflect); the vocabulary has those whose
share of toxic examples differs clearly from their share of clean ones. Documents and examples are
TF-IDF vectors over it, with document frequencies of the whole corpus. A block-max inverted index
of the examples gives the ``NEIGHBOURS`` nearest by exact cosine; their votes, weighted by closeness,
are calibrated on the examples themselves (each without itself) by isotonic regression, with
classes weighted as they come in the labels. The nearest examples are the evidence.

The classifier learns from at most ``EXAMPLES`` labelled rows of each class, those with the smallest
hashes of doc_id. Everything else covers all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blockmax import BlockMaxIndex

EXAMPLES = 2000
NEIGHBOURS = 15
TERMS = 4096
#: Examples that a term needs, its chi-square and the ratio of its shares by class.
SUPPORT, CHI_SQUARE, RATIO = 3, 20.0, 4.0
PREFIXES = (4, 5, 6)
PREDICT = 0.7
#: Weight of the clean vote that every document gets; a neighbour's is its squared cosine.
DOUBT = 0.2
#: Words whose terms a task remembers.
REMEMBERED = 1 << 18
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def counts_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for term in terms_of(word):
            out[term] += n
    return out


def examples_of(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the examples, and how many labelled rows each class has.

    Labels other than 0 and 1 and null ids don't count; an id with both labels counts as toxic, and
    so does a text whose rows have both. Equal texts are one example, under their smallest id.
    """
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = common.cut(labels)
    classes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    first = [labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]  # each task keeps its first ones
    chosen = F.broadcast(common.cut(first[0].unionByName(first[1])))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id")
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"), classes


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, y, t, n) for d, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True) for t, n in counts_of(x).items()]
        doc, toxic, term, n = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(toxic, pa.int32()), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "toxic", "term", "tf"])


def _vocabulary(terms: DataFrame, n: dict[int, int]) -> DataFrame:
    """(term) of at most ``TERMS`` terms; n: examples by class.

    A term of all examples, and any term where the examples have one class only, tells nothing and is left out.
    """
    n1, n0 = F.lit(float(n.get(1, 0))), F.lit(float(n.get(0, 0)))
    by = terms.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).filter(F.col("a") + F.col("b") >= SUPPORT)
    c, d = n1 - F.col("a"), n0 - F.col("b")
    chi = F.try_divide((n1 + n0) * F.pow(F.col("a") * d - F.col("b") * c, F.lit(2)), n1 * n0 * (F.col("a") + F.col("b")) * (c + d))
    ratio = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))
    good = by.withColumn("chi", chi).filter((F.col("chi") >= CHI_SQUARE) & ((ratio >= RATIO) | (ratio <= 1 / RATIO)))
    return good.orderBy(F.desc("chi"), "term").limit(TERMS).select("term")


def _vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, terms, tfs) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in batches:
            terms, tfs = [], []
            for text in batch.column(1).to_pylist():
                own: dict[int, int] = {}
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    found = known.get(word)
                    if found is None:
                        found = tuple(index[t] for t in terms_of(word) if t in index)
                        if len(known) < REMEMBERED and len(word) < 64:
                            known[word] = found
                    for t in found:
                        own[t] = own.get(t, 0) + n
                terms.append(sorted(own))
                tfs.append([own[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms array<int>, tfs array<long>")


def _document_frequencies(size: int):
    """(term, documents) of each task's rows, and (-1, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
            rows += batch.num_rows
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, -1), pa.int32()), pa.array(np.append(df[terms], rows))], names=["term", "n"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit, by pooling adjacent violators; equal x are one point."""
    xs, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back, w)
    value = np.bincount(back, w * y) / weight
    pools: list[list[float]] = []
    for k in range(len(xs)):
        pools.append([value[k], weight[k], 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, u, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * u) / (pools[-1][1] + u), pools[-1][1] + u, pools[-1][2] + n]
    return xs, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


@dataclass
class Neighbours:
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    index: BlockMaxIndex
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def weights(self, terms, tfs) -> list[tuple[int, float]]:
        """A unit TF-IDF vector."""
        w = [(int(t), (1 + np.log(n)) * self.idf[t]) for t, n in zip(terms, tfs, strict=True)]
        norm = float(np.sqrt(sum(x * x for _, x in w)))
        return [(t, float(x) / norm) for t, x in w] if norm else []

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Share of toxic neighbours by closeness, against ``DOUBT`` of a clean one; -1 without neighbours."""
        if not near:
            return -1.0
        w = [s * s for _, s in near]
        return float(np.dot(w, self.labels[[e for e, _ in near]]) / (np.sum(w) + DOUBT))

    def score(self, vote: float) -> float:
        xs, ys = self.knots
        return float(min(1.0, max(0.0, 0.98 * np.interp(vote, xs, ys) + 0.02 * max(0.0, vote))))


def train(docs: DataFrame, vectors_of: DataFrame, labels: DataFrame, per_class: int = EXAMPLES) -> tuple[Neighbours, DataFrame]:
    """The index of the examples among ``labels``, and the vectors of all rows of ``vectors_of``.

    Labels of one class give every document the score of that class; without labels all scores are 0.
    """
    chosen, classes = examples_of(docs, labels, per_class)
    terms = common.cut(chosen.mapInArrow(_example_terms, "doc_id long, toxic int, term string, tf long"))
    n = {r["toxic"]: r["n"] for r in terms.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    vocabulary = [r["term"] for r in _vocabulary(terms, n).collect()]  # at most TERMS
    vectors = common.cut(_vectors(vectors_of, vocabulary))
    counted = vectors.select("terms").mapInArrow(_document_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, n_rows = np.zeros(len(vocabulary)), 0
    for r in counted.collect():  # at most TERMS rows and the number of documents
        if r["term"] < 0:
            n_rows = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((1 + n_rows) / (1 + df)) + 1
    at = {t: k for k, t in enumerate(vocabulary)}
    known = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string"))
    rows = terms.join(known, "term", "left_semi").groupBy("doc_id").agg(F.collect_list("term").alias("t"), F.collect_list("tf").alias("n"))
    rows = terms.select("doc_id", "toxic").distinct().join(rows, "doc_id", "left").orderBy("doc_id").collect()  # the examples
    ids, y = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], float)
    model = Neighbours(idf, ids, y, BlockMaxIndex(*[np.zeros(0, int)] * 3, len(vocabulary), 0))
    own = [model.weights(*zip(*sorted((at[t], n) for t, n in zip(r["t"], r["n"], strict=True)), strict=True)) if r["t"] else [] for r in rows]
    flat = [(t, e, w) for e, x in enumerate(own) for t, w in x]
    if flat:
        model.index = BlockMaxIndex(*(np.array(x) for x in zip(*flat, strict=True)), len(vocabulary), len(rows))
    if len(rows):
        votes = np.array([model.vote([(e, s) for e, s in model.index.top(x, NEIGHBOURS + 1) if e != k][:NEIGHBOURS]) for k, x in enumerate(own)])
        share = np.array([classes[int(k)] / max(1, (y == k).sum()) for k in y])
        model.knots = isotonic(votes, y, share)
    return model, vectors


def score(vectors: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score, nearest, similarity) of every row of ``vectors``; nearest: ids of up to three examples."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # at most 2 * EXAMPLES vectors over TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, nearest, similarity = [], [], []
            for terms, tfs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                near = model.index.top(model.weights(terms, tfs), NEIGHBOURS) if terms else []
                scores.append(model.score(model.vote(near)))
                nearest.append([int(model.ids[e]) for e, _ in near[:3]])
                similarity.append([round(s, 6) for _, s in near[:3]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(nearest, pa.list_(pa.int64())), pa.array(similarity, pa.list_(pa.float64()))], names=["doc_id", "score", "nearest", "similarity"])

    return vectors.mapInArrow(run, "doc_id long, score double, nearest array<long>, similarity array<double>")


def op1(spark, sf_dir: str) -> DataFrame:
    """Score all documents; learn labels of those that aren't held out."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter(~common.held(1, 3))
    model, vectors = train(docs, docs, labels)
    out = score(vectors, model)
    return out.select("doc_id", common.held(1, 3).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "nearest", "similarity")
