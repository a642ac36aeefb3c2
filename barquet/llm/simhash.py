"""SimHash near-duplicates, linked through BK-trees.

A fingerprint takes the majority of the bits of the hashes of all word shingles. Fingerprints
within ``RADIUS`` bits agree on at least one of ``RADIUS + 1`` blocks of bits, so each goes to one
shard for each block, and a BK-tree over a shard's fingerprints finds its links: children hang at
their Hamming distance to the parent, and a search follows only edges within the radius.

The shards' trees grow with the corpus, so they aren't broadcast: a shard's tree is built in the
task that holds the shard's fingerprints. A shard of more than ``SHARD`` fingerprints is divided
into parts, and each pair of parts is a shard again, so no task holds more than two parts and every
pair still meets. Equal fingerprints are one before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WORDS = 3
SEED = 42
RADIUS = 3
SHARD = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Rows of a shuffle partition of the shards.
TASK_ROWS = 200_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    tokens = text.lower().split()  # bytes: only A-Z changes, only ASCII white space parts
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], stops[k : k + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = common.utf8(batch.column(1))
        data = data.tobytes() if bounds[-1] - bounds[0] < 1 << 28 else memoryview(data)
        found = [fingerprint(bytes(data[bounds[r] : bounds[r + 1]])) for r in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def links(self, value: int, radius: int) -> list[int]:
        """Positions of all values within ``radius``."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children := self.children[at]:
                open_ += [children[e] for e in range(max(0, d - radius), d + radius + 1) if e in children]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at = 0
        while at < len(self.values) - 1:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), len(self.values) - 1)


def _shard_links(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of a shard's links: its roots and shape don't matter, its components do."""
    tree, parent, out = BKTree(), list(range(len(fps))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, fp in enumerate(fps):
        for other in tree.links(fp, radius):
            a, b = find(k), find(other)
            if a != b:
                parent[a] = b
                out.append((ids[k], ids[other]))
        tree.add(fp)
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.whole(batches)  # about TASK_ROWS rows, as large shards are divided
        if table is None:
            return
        shard, fp, node = (table.column(c).to_numpy() for c in ("shard", "fp", "node"))
        part = [table.column(c).to_numpy() for c in ("block", "i", "j")]
        order = np.lexsort((node, *part, shard))
        change = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (shard, *part)], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(order)], strict=True):
            if hi - lo > 1:
                own = order[lo:hi]
                links = _shard_links(fp[own].view(np.uint64).tolist(), node[own].tolist(), radius)
                if links:
                    u, v = zip(*links, strict=True)
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all ``nodes`` (node long, fp long, each fp once) within ``radius`` bits."""
    width, extra = divmod(64, radius + 1)
    cuts = np.cumsum([0, *(width + (b < extra) for b in range(radius + 1))]).tolist()
    shards = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo).alias("shard")) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    rows = nodes.select("node", "fp", F.explode(F.array(*shards)).alias("x")).select("node", "fp", "x.block", "x.shard")
    sizes = rows.groupBy("block", "shard").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["block", "shard"])
    parts = F.ceil(F.col("n") / SHARD).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")))
    )
    rows = rows.select("node", "fp", "block", "shard", F.explode(pairs).alias("x")).select("node", "fp", "block", "shard", "x.i", "x.j")
    n = common.partitions_for(nodes.sparkSession, 4 * nodes.count() // TASK_ROWS + 1)
    return rows.repartition(n, "block", "shard", "i", "j").mapInArrow(_links(radius), "u long, v long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null or blank text has fingerprint zero."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row of ``docs``.

    The component is named by its smallest doc_id; rows with a null id are linked like others, and
    a component of such rows alone has a null name. Repeated rows share their fingerprint. n_links
    counts the other fingerprints that the linking forest joins to the row's own.
    """
    prints = common.cut(fingerprints(docs))
    # a node is named by its smallest id; fingerprints of null ids alone get names of their own below all ids
    nodes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.lit(-(1 << 62)) + F.shiftright(F.xxhash64("fp"), 3)).alias("node"), "least"))
    nodes = nodes.dropDuplicates(["fp"])
    # one id may stand on rows of several texts: nodes must differ, so those are named by their fingerprint
    twice = nodes.groupBy("node").agg(F.count("*").alias("n"), F.max("fp").alias("top"))
    nodes = common.cut(nodes.join(twice, "node").select("fp", "least", F.when((F.col("n") > 1) & (F.col("fp") != F.col("top")), F.lit(-(1 << 62)) + F.shiftright(F.xxhash64("fp"), 3)).otherwise(F.col("node")).alias("node")))
    links = common.cut(link_fingerprints(nodes.select("node", "fp"), radius))
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").join(degree, "node", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest id. All columns stay.

    Rows whose text has no word (fingerprint zero by definition, not by likeness), and rows
    without an id, stay. Repeated rows of the id that stays are all kept.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    gone = near_duplicates(usable, radius).filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    common.small_batches(spark)
    return near_duplicates(common.table(spark, sf_dir, "documents"))
