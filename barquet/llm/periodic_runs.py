"""Periodic runs: stretches of words that repeat with a period, and texts without the repeats.

Runs come from suffix trees. Ukkonen's algorithm builds the tree of a stretch and of its reversal; an
Euler tour of each, with a sparse table over the depths where it turns, answers how far two places
agree in constant time. Every run has a Lyndon root that is the longest Lyndon word where it begins,
under the order of words or under its reverse, so two passes over the suffixes' ranks name all
candidates, and each is extended in both directions by one query a tree.

A screen over whole blocks of documents comes first, as building trees takes some ten microseconds a
word. Inside a run of period q, 2**k <= q < 2**(k + 1), every block of 2**k words from the second period
on occurs again within q words, at least 2**(k + 1) times in a row. Hashes of such blocks show where
that is so; equal blocks have equal hashes, so nothing is lost, and trees are built of the rest only,
widened to hold whole runs. ``screen=False`` builds them of all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A run has at least so many periods and words.
PERIODS, WORDS = 4, 6
#: Words of documents that are screened together.
BLOCK_WORDS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start:long,length:long,period:long>>"
_ODD = 0x9E3779B97F4A7C15


class SuffixTree:
    """Ukkonen's suffix tree of a list of words given as numbers from 1; the end is 0, the least."""

    def __init__(self, words: list[int]) -> None:
        self.n = n = len(words)
        text, whole = [*words, 0], n + 1
        width = max(text) + 1
        edges: dict[int, int] = {}  # node * width + word -> child
        start, stop, link = [0], [0], [0]
        node = at = length = rest = 0
        for i, word in enumerate(text):
            rest += 1
            last = 0
            while rest:
                if not length:
                    at = i
                key = node * width + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(whole)
                    link.append(0)
                    if last:
                        link[last], last = node, 0
                else:
                    s = start[child]
                    span = min(stop[child], i + 1) - s
                    if length >= span:
                        node, at, length = child, at + span, length - span
                        continue
                    if text[s + length] == word:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)
                    edges[key] = mid
                    edges[mid * width + word] = mid + 1
                    edges[mid * width + text[s + length]] = child
                    start += [s, i]
                    stop += [s + length, whole]
                    link += [0, 0]
                    start[child] = s + length
                    if last:
                        link[last] = mid
                    last = mid
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - rest + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        parents = keys[order] // width
        self.kids = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        self.first = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.ends = (keys[order] % width == 0).tolist()  # children by the end of the text
        self.start, self.stop = start, stop
        self._tour()

    def _tour(self) -> None:
        """The Euler tour: the leaves in order, and the depth at which it turns between two of them."""
        whole, start, stop, first, kids = self.n + 1, self.start, self.stop, self.first, self.kids
        order, turns, stack = [], [], [(0, 0)]
        turning = 0
        while stack:
            v, above = stack.pop()
            if order and turning < 0:
                turning = above
                turns.append(above)
            a, b = first[v], first[v + 1]
            if a == b:
                order.append(start[v] - above)
                turning = -1
            else:
                depth = above + stop[v] - start[v]
                stack += [(x, depth) for x in reversed(kids[a:b])]
        rank = np.empty(whole, np.int64)
        rank[order] = np.arange(whole)
        self.rank = rank
        self.table = [np.array(turns, np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes under the reversed order of words; the end stays the least."""
        start, first, kids, ends = self.start, self.first, self.kids, self.ends
        order, stack = [], [(0, 0)]
        while stack:
            v, above = stack.pop()
            a, b = first[v], first[v + 1]
            if a == b:
                order.append(start[v] - above)
                continue
            depth = above + self.stop[v] - start[v]
            own = [(x, depth) for x in kids[a:b]]
            stack += [*own[1:], own[0]] if ends[a] else own
        rank = np.empty(self.n + 1, np.int64)
        rank[order] = np.arange(self.n + 1)
        return rank

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and at j, i != j, have in common."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each suffix the next one of lower rank: where its longest Lyndon word ends."""
    n = len(rank) - 1  # the empty suffix is the least
    out, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def tree_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of hashable ``words``, by start, then period."""
    n = len(words)
    if n < WORDS:
        return []
    known: dict = {}
    ids = [known.setdefault(w, len(known) + 1) for w in words]
    tree, back = SuffixTree(ids), SuffixTree(ids[::-1])
    found = []
    for rank in (tree.rank, tree.reversed_rank()):
        j = np.array(_next_smaller(rank.tolist()))
        i = np.arange(n)
        period = j - i
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = j < n
        right[at] = tree.agree(i[at], j[at])
        left[1:] = back.agree(n - i[1:], n - j[1:])
        length = period + left + right
        at = (length >= WORDS) & (length >= PERIODS * period)
        found.append(np.stack([i - left, period, length], 1)[at])
    rows = np.unique(np.concatenate(found), axis=0)
    return [(s, n, p) for s, p, n in rows.tolist()]


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each document [bounds[d], bounds[d + 1]) of word hashes: apart stretches [first, last), from its start, that hold all its runs."""
    total, docs = len(hashes), len(bounds) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    sizes = np.diff(bounds)
    end, size, before = np.repeat(bounds[1:], sizes), np.repeat(sizes, sizes), np.repeat(np.arange(docs), sizes)
    begin = bounds[:-1] + np.arange(docs)  # a free place after each document keeps them apart
    bits = max(1, int(total).bit_length())
    low = np.uint64((1 << bits) - 1)
    h, k, found = hashes.astype(np.uint64) * np.uint64(_ODD), 0, []
    while total and int(sizes.max()) >= max(WORDS, PERIODS << k):
        block = 1 << k
        at = np.flatnonzero((np.arange(total) + block <= end) & (size >= PERIODS * block))
        keys = np.sort((h[at] & ~low) | at.astype(np.uint64))
        place = (keys & low).astype(np.int64)
        near = ((keys[1:] ^ keys[:-1]) <= low) & (place[1:] - place[:-1] < 2 * block)
        close = np.zeros(total + docs + 2, np.int8)
        close[(place + before[place])[1:][near] + 1] = 1
        edge = np.diff(close)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # [a, b) are close
        long = b - a >= (WORDS - 1 if k == 0 else 2 * block + 1)
        doc = np.searchsorted(begin, a[long], "right") - 1
        found += zip(doc.tolist(), (a[long] - begin[doc] - 2 * block).tolist(), (b[long] - begin[doc] + block).tolist(), strict=True)
        if (2 * block) <= total:
            h = (h[:-block] * np.uint64(_ODD - 2 * k) ^ (h[:-block] >> np.uint64(29))) + h[block:]
            h = np.concatenate([h, np.zeros(block, np.uint64)])
        k += 1
    for d, a, b in sorted(found):
        a, b, own = max(a, 0), min(b, int(sizes[d])), out[d]
        if own and a <= own[-1][1]:
            own[-1] = own[-1][0], max(own[-1][1], b)
        else:
            own.append((a, b))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, with single spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _blocks(batch: pa.RecordBatch) -> Iterator[list[list[bytes]]]:
    """The words of a batch's texts (its first column), in runs of rows of about BLOCK_WORDS."""
    data, bounds = common.utf8(batch.column(0))
    rows, n = [], 0
    for r in range(len(bounds) - 1):
        rows.append(data[bounds[r] : bounds[r + 1]].tobytes().split())  # bytes split at the six kinds of white space alone
        n += len(rows[-1])
        if n >= BLOCK_WORDS:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def runs_of(rows: list[list[bytes]], screen: bool = True) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    if not screen:
        return [tree_runs(words) for words in rows]
    bounds = np.cumsum([0, *map(len, rows)])
    hashes = np.fromiter(map(hash, itertools.chain.from_iterable(rows)), np.int64, int(bounds[-1]))
    return [[(a + s, n, p) for a, b in own for s, n, p in tree_runs(words[a:b])] if own else [] for words, own in zip(rows, stretches(hashes, bounds), strict=True)]


def find_runs(docs: DataFrame, text: str = "text", screen: bool = True) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period; by start, then period) and collapsed (the text without repeats).

    A run is a maximal stretch of words of least period q with at least ``PERIODS`` periods and ``WORDS`` words.
    Words are what ASCII white space separates. A null, empty or blank text has no words, no run and an
    empty collapsed text. All other columns, null ids and repeated rows stay; former columns of these
    three names are replaced. A text is one task's work; memory is about a kilobyte for each word of its
    longest stretch with runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, rest = [], [], []
            for rows in _blocks(batch):
                runs = runs_of(rows, screen)
                n += map(len, rows)
                found += runs
                rest += [collapsed(w, r) for w, r in zip(rows, runs, strict=True)]
            flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            arrays = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), spans), pa.array(rest, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*batch.schema.names[1:], "n_words", "runs", "collapsed"])

    docs = docs.drop("n_words", "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"n_words long, runs {_RUNS}, collapsed string").fields])
    return docs.select(F.col(text).alias("_text_of_runs"), *docs.columns).mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """Of the runs of a document the one with the greatest length / period, ties to the first; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """The text that the query is asked for: one document in ten, by the checksum of its id, repeats from some word on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(of: Column) -> Column:
        words, a = of["words"], of["g"] % of["n"]
        bound = F.array(F.struct(words.alias("words"), a.alias("a"), (1 + F.floor((of["n"] - a) / (3 + of["g"] % 8))).alias("p"), of["n"].alias("n")))
        return F.transform(bound, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["words"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))[0]

    # a lambda's variable is computed once, what a lambda only mentions is computed for every word
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n"), g.alias("g")))
    made = F.transform(words, lambda of: F.when(of["n"] > 0, repeat(of)))[0]
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op13(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, one in ten of which is made to repeat."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs).withColumn("best", longest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *[x[k].cast("string") for k in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
