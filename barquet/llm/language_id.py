"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes (orders 3 to 0), whose counts are
frozen after training. A byte costs ``-log2`` of its probability in the longest known context;
where a context hasn't seen the byte, the escape probability (method C: distinct symbols over
occurrences plus distinct symbols) is paid and the next shorter context asked, down to 1/256.
A text's code length is the exact sum over all of its bytes; the language with the shortest
code wins, and the score is its posterior under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ORDER = 3
UNKNOWN = "und"
#: Training documents of a language at most; the sample is that with the smallest hashes of doc_id.
DOCS_PER_LANGUAGE = 400
#: Byte pairs that the lookup table holds at most; rarer ones take the slower search.
DENSE_PAIRS = 3000
PAD = b"\n" * ORDER


@dataclass
class Level:
    """Counts of one order: symbols after contexts, and each context's occurrences and escapes."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def _level(grams: np.ndarray, counts: np.ndarray) -> Level:
    contexts, first = np.unique(grams >> 8, return_index=True)
    total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
    distinct = np.diff(np.append(first, len(grams)))
    of = np.repeat(np.arange(len(contexts)), distinct)
    return Level(grams, -np.log2(counts / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class ContextTree:
    """One language's frozen counts of orders ``ORDER`` to 0."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(float)
        self.levels = []
        for k in range(ORDER, -1, -1):
            self.levels.append(_level(grams, counts))
            grams, back = np.unique(grams & ((1 << 8 * k) - 1), return_inverse=True)
            counts = np.bincount(back, counts, len(grams))

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram (``ORDER`` bytes of context before it)."""
        bits, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k, level in zip(range(ORDER, -1, -1), self.levels, strict=True):
            at, known = _find(level.grams, grams[open_])
            bits[open_[known]] += level.bits[at[known]]
            open_ = open_[~known]
            at, seen = _find(level.contexts, grams[open_] >> 8)
            bits[open_[seen]] += level.escape[at[seen]]
            if k:
                grams = grams & ((1 << 8 * k) - 1)
        bits[open_] += 8.0
        return bits


class Model:
    """Context trees of all languages, and a table of the code lengths of every gram any of them knows."""

    def __init__(self, trees: dict[str, ContextTree]) -> None:
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        known = np.unique(np.concatenate([t.levels[0].grams for t in self.trees])) if self.trees else np.zeros(0, np.int64)
        pairs, counts = np.unique(np.concatenate([known >> 16, known & 0xFFFF]), return_counts=True)
        pairs = pairs[np.argsort(-counts, kind="stable")[:DENSE_PAIRS]]
        self.pair_id = np.zeros(1 << 16, np.int32)
        self.pair_id[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        a, b = self.pair_id[known >> 16], self.pair_id[known & 0xFFFF]
        known = known[(a > 0) & (b > 0)]
        self.row = np.zeros(self.width * self.width, np.int32)
        self.row[self.pair_id[known >> 16].astype(np.int64) * self.width + self.pair_id[known & 0xFFFF]] = np.arange(1, len(known) + 1)
        self.bits = np.zeros((len(known) + 1, len(self.languages)), np.float32)
        for k, tree in enumerate(self.trees):
            self.bits[1:, k] = tree.code_lengths(known)

    def _bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths by row and language; ``data`` has ``ORDER`` bytes of context before each row's bytes."""
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        ids = self.pair_id[pair]
        row = self.row[ids[:-2].astype(np.int64) * self.width + ids[2:]]
        cost = self.bits[row]
        if len(rare := np.flatnonzero(row == 0)):
            grams, back = np.unique((pair[rare].astype(np.int64) << 16) | pair[rare + 2], return_inverse=True)
            for k, tree in enumerate(self.trees):
                cost[rare, k] = tree.code_lengths(grams)[back]
        ends = np.append(starts[1:], len(data)) - ORDER
        live = np.zeros(len(row), bool)
        for s, e in zip(starts, ends, strict=True):
            live[s:e] = True
        cost[~live] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits by row and language for rows of bytes; long rows go piece by piece."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        pad = np.frombuffer(PAD, np.uint8)
        for first, last in common.blocks(bounds):
            pieces, rows = [], []
            for r in range(first, last):
                for s in range(bounds[r], bounds[r + 1], common.BLOCK_BYTES):
                    pieces.append(np.concatenate([pad, data[s : min(bounds[r + 1], s + common.BLOCK_BYTES)]]) if s == bounds[r] else data[s - ORDER : min(bounds[r + 1], s + common.BLOCK_BYTES)])
                    rows.append(r)
                    if len(pieces) > 1 and last - first == 1:
                        out[r] += self._bits(pieces.pop(0), np.zeros(1, np.int64))[0]
                        rows.pop()
            if pieces:
                starts = np.cumsum([0, *map(len, pieces[:-1])])
                np.add.at(out, rows, self._bits(np.concatenate(pieces), starts))
        return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = common.utf8(batch.column(1))
        of = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(of)):
            text = b"".join(PAD + data[bounds[r] : bounds[r + 1]].tobytes() for r in np.flatnonzero(of == lang))
            x = np.frombuffer(text, np.uint8).astype(np.int64)
            grams, counts = np.unique((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": counts})


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows a language: those with the smallest hashed ids."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    place = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("place")  # even between 0 and 1
    sizes = F.broadcast(usable.groupBy("lang").agg(F.count("*").alias("size")))  # a row a language
    # four times as many as wanted are looked at, so that no task gets a whole language; they hold the wanted ones for certain but for 1 in 10^100
    rows = usable.select("lang", "doc_id", place).join(sizes, "lang").filter(F.col("place") * F.col("size") <= 4 * per_language + 100)
    w = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_language)
    ids = chosen.select("doc_id").distinct()  # per_language rows a language: small by construction
    return usable.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model of the languages in ``lang``, from a bounded sample of the rows of ``docs``."""
    grams = training_sample(docs, per_language).mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = grams.toPandas()  # no more than the bytes of the sample
    return Model({lang: ContextTree(g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in kept.groupby("lang")})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` and ``bits_per_byte`` to every row.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages.
    Columns of those names in ``docs`` are replaced; all others stay. Ties go to the first language
    by name. Equal rows get equal results.
    """
    names = {"lang_pred", "lang_score", "bits_per_byte", "_letter"}
    docs = docs.select([c for c in docs.columns if c not in names])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = docs.schema.add("lang_pred", "string").add("lang_score", "double").add("bits_per_byte", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, bounds = common.utf8(batch.column(at))
            letters = batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)
            best, score, rate = np.full(len(letters), len(names) - 1), np.zeros(len(letters)), np.zeros(len(letters))
            if model.languages:
                bits = model.code_lengths(data, bounds)
                low = bits.min(axis=1)
                ok = letters.astype(bool)
                best[ok] = bits.argmin(axis=1)[ok]
                score[ok] = (1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1))[ok]
                rate[ok] = (low / np.maximum(1, np.diff(bounds)))[ok]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)], names=[*batch.schema.names[:-1], "lang_pred", "lang_score", "bits_per_byte"])

    return docs.withColumn("_letter", F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learn from those that aren't held out."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~common.held(2, 4)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", common.held(2, 4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")
