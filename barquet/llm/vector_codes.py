"""Vector codes: each vector's parts become indexes into codebooks that k-means learns, in exact integers.

Assignment keeps adaptive bounds. For every part of every vector the table of a round persists its
``b`` closest entries with lower bounds of their distances, in order, and one outer bound for all other
entries, next to an upper bound of the distance to its own entry. When entries move, bounds give way by
the moves; what they still decide needs no distance at all. Else the integer distances to as many of
the close entries as the bounds leave open are computed, and only where the outer bound is passed too
those to the whole codebook. ``b`` shrinks with what the rounds need.

Bounds are stored as 32-bit floats rounded away from the truth, by more than what doubles lose, so that
a decision by bounds is one that exact distances would make; ties never pass as decided. A round reads
and writes one table in the shared folder. The driver holds the codebooks, some thousand entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Close entries kept of a part at first, and at least.
MOST, LEAST = 16, 4
#: Share of parts, in a thousand, that may need more close entries than are kept on.
RARE = 1
#: Integers of vectors lie below this, so that sums of squares fit into 64 bits.
LARGEST = 1 << 26
#: Rows of a part whose distances to all entries are computed together.
ROWS = 2048
#: Labels up to which their sums are sent to all tasks.
LABELS = 100_000


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most * most * 4 * max(1, x.shape[1]) < 1 << 53:  # doubles hold all sums
        x, entries = x.astype(float), entries.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def _to(x: np.ndarray, entries: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own entries ``near``."""
    return ((x[:, None, :] - entries[near]) ** 2).sum(-1)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _ordered(squares: np.ndarray, near: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` closest entries of each row, ties by index, and their squared distances."""
    if near is None:
        near = np.broadcast_to(np.arange(squares.shape[1]), squares.shape)
    if int(squares.max(initial=0)) < 1 << 54:
        keys = squares * 256 + near
        if most < keys.shape[1]:
            keys = np.partition(keys, most - 1, axis=1)[:, :most]
        keys = np.sort(keys, axis=1)
        return keys & 255, keys >> 8
    order = np.lexsort((near, squares), axis=1)[:, :most]
    return np.take_along_axis(near, order, 1), np.take_along_axis(squares, order, 1)


class Bounds:
    """Of one part of some vectors: close entries (near), bounds of their distances and of all others' (low, one column more), of the own entry's (up)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, up: np.ndarray) -> None:
        self.near, self.low, self.up = near, low, up
        self.need = np.zeros(len(near), np.uint8)  # close entries that the last round compared

    @classmethod
    def of(cls, x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        """From the distances to all entries."""
        near, low, up = np.zeros((len(x), b), np.uint8), np.full((len(x), b + 1), np.inf), np.zeros(len(x))
        for at in range(0, len(x), ROWS):
            rows = slice(at, at + ROWS)
            found, squares = _ordered(_squares(x[rows], entries), None, min(b + 1, len(entries)))
            roots = np.sqrt(squares)
            near[rows], up[rows], low[rows, : roots.shape[1]] = found[:, :b], roots[:, 0], roots
        return cls(near, low, up)

    def move(self, x: np.ndarray, entries: np.ndarray, drift: np.ndarray, b: int) -> Bounds:
        """Assign anew after the entries moved by ``drift``; keep ``b`` close entries."""
        near, up, k = self.near.astype(np.int64), self.up + drift[self.near[:, 0]], self.near.shape[1]
        low = self.low - np.concatenate([drift[near], np.full((len(near), 1), drift.max(initial=0))], 1)
        low = _rising(low)
        need = np.zeros(len(near), np.int64)
        rows = np.flatnonzero(up >= low[:, 1])
        up[rows] = np.sqrt(_to(x[rows], entries, near[rows, :1])[:, 0])
        rows = rows[up[rows] >= low[rows, 1]]
        need[rows] = 1 + (low[rows, 1:] <= up[rows, None]).sum(1)  # beyond k: the outer bound is passed
        width = 2
        while len(open_ := rows[(need[rows] <= k) & (need[rows] > width // 2) & (need[rows] <= width)]) or width < k:
            m = min(width, k)
            for at in range(0, len(open_), ROWS):
                own = open_[at : at + ROWS]
                found, squares = _ordered(_to(x[own], entries, near[own, :m]), near[own, :m], m)
                roots = np.sqrt(squares)
                near[own, :m], low[own, :m], up[own] = found, roots, roots[:, 0]
            width *= 2
        out = Bounds(near.astype(np.uint8), _rising(low), up)
        if len(far := rows[need[rows] > k]):
            full = Bounds.of(x[far], entries, k)
            out.near[far], out.low[far], out.up[far] = full.near, full.low, full.up
        out.near, out.low, out.need = out.near[:, :b], out.low[:, : b + 1], np.minimum(need, 255).astype(np.uint8)
        return out


def _rising(low: np.ndarray) -> np.ndarray:
    """Each bound lowered to those after it: then it holds for all entries from its place on."""
    return np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


def _binary(rows: np.ndarray) -> pa.Array:
    """A row's bytes as one value."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _array(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


_STATE = "vec_id {id}, label {label}, v array<int>, near binary, low binary, up binary, need binary"


def _write(batch: pa.RecordBatch, bounds: list[Bounds]) -> pa.RecordBatch:
    arrays = [np.concatenate([getattr(x, k).reshape(len(x.near), -1) for x in bounds], 1) for k in ("near", "low", "up", "need")]
    arrays[1], arrays[2] = _below(arrays[1]), _above(arrays[2])
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *map(_binary, arrays)], names=["vec_id", "label", "v", "near", "low", "up", "need"])


def _read(batch: pa.RecordBatch, b: list[int]) -> list[Bounds]:
    ends = np.cumsum([0, *b])
    near, low, up = _array(batch.column("near"), np.uint8, sum(b)), _array(batch.column("low"), np.float32, sum(b) + len(b)), _array(batch.column("up"), np.float32, len(b))
    return [Bounds(near[:, i:j], low[:, i + p : j + p + 1].astype(float), up[:, p].astype(float)) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def _assign(state: DataFrame, books: list[np.ndarray], schema: str, b: list[int], drift: list[np.ndarray] | None = None, then: list[int] | None = None) -> DataFrame:
    """The bounds of all rows: from all distances without ``drift``, else by the moves."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.split(_vectors(batch.column("v"), width * len(books)), len(books), axis=1)
                if drift is None:
                    yield _write(batch, [Bounds.of(*of) for of in zip(x, books, b, strict=True)])
                else:
                    yield _write(batch, [own.move(*of) for own, *of in zip(_read(batch, b), x, books, drift, then, strict=True)])

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, b: list[int], width: int) -> list:
    """A row for each part and entry (sums and n), and for each part and need (entry -1 - need)."""
    parts, names = len(b), [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, 512, width + 1), np.int64)  # entries, then needs
        for batch in batches:
            x = np.split(_vectors(batch.column("v"), width * parts), parts, axis=1)
            near, need = _array(batch.column("near"), np.uint8, sum(b)), _array(batch.column("need"), np.uint8, parts)
            for p, first in enumerate(np.cumsum([0, *b])[:-1]):
                order = np.argsort(near[:, first], kind="stable")
                own = near[order, first]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                if len(starts):
                    total[p, own[starts], :width] += np.add.reduceat(x[p][order], starts, axis=0)
                total[p, :256, width] += np.bincount(own, minlength=256)
                total[p, 256:, width] += np.bincount(need[:, p], minlength=256)
        part, entry = np.nonzero(total[:, :, width])
        rows = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.where(entry < 256, entry, 255 - entry)), *(pa.array(rows[:, k]) for k in range(width + 1))], names=["part", "entry", *names, "n"])

    found = state.select("v", "near", "need").mapInArrow(run, "part long, entry long, " + ", ".join(f"{k} long" for k in [*names, "n"]))
    return found.groupBy("part", "entry").agg(*[F.sum(k).alias(k) for k in [*names, "n"]]).collect()  # at most 512 rows a part


def integers(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: int = 1024) -> DataFrame:
    """(vec_id, label, v) of vectors without null or non-finite components; v holds floor(scale * component)."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    fits = lambda c: F.when(F.abs(c) < LARGEST, c.cast("int")).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")))
    v = F.transform(x, lambda c: fits(F.floor(c.cast("double") * scale)))
    return vectors.filter(good).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))


def _remove(spark: SparkSession, table: DataFrame) -> None:
    """Delete a round's table, which the next one has replaced."""
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fit(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """Learn codebooks of ``integers`` and assign all vectors: (vec_id, label, code, error), and each part's entries.

    A codebook starts as the vectors of the smallest ids (nulls last, ties by the vector), a smaller
    table gives fewer entries. Repeated rows count each. An empty table gives no rows and no codebooks.
    Vectors of different lengths, or of one that ``parts`` doesn't divide, are an error.
    """
    spark = kept.sparkSession
    kinds = dict(kept.dtypes)
    size = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if size[0] is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    if size[0] != size[1] or size[0] % parts or entries > 256:
        raise ValueError(f"vectors of {size[0]} to {size[1]} components, {parts} parts, {entries} entries of 256")
    width = size[0] // parts
    seeds = np.array([r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64).reshape(-1, size[0])
    books = np.split(seeds, parts, axis=1)
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    b = [min(MOST, len(seeds))] * parts
    state = common.cut(_assign(kept, books, schema, b))
    for _ in range(rounds):
        moved, need = [x.copy() for x in books], np.zeros((parts, 256), np.int64)
        for r in _sums(state, b, width):
            if r.entry < 0:
                need[r.part, -1 - r.entry] = r.n
            else:
                moved[r.part][r.entry] = np.array(r[2 : 2 + width]) // r.n
        drift = [np.sqrt(((new - old) ** 2).sum(1)) * (1 + 1e-12) for new, old in zip(moved, books, strict=True)]
        then = b if not need[:, 1:].any() else [min(k, max(LEAST, _needed(row, k))) for row, k in zip(need, b, strict=True)]
        books, before = moved, state
        state, b = common.cut(_assign(before, books, schema, b, drift, then)), then
        _remove(spark, before)
    coded = common.cut(_codes(state, books, b, kinds))
    _remove(spark, state)
    return coded, books


def _needed(counts: np.ndarray, b: int) -> int:
    """The number of close entries that all but RARE in a thousand of the parts needed, those past the outer bound aside."""
    more = counts[: b + 1].sum() - np.cumsum(counts[: b + 1])
    return int(np.argmax(more * 1000 <= RARE * counts.sum()))


def _codes(state: DataFrame, books: list[np.ndarray], b: list[int], kinds: dict[str, str]) -> DataFrame:
    """(vec_id, label, code, error) of rows whose first close entries are their own."""
    width, first = books[0].shape[1], np.cumsum([0, *b])[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.split(_vectors(batch.column("v"), width * len(books)), len(books), axis=1)
                own = _array(batch.column("near"), np.uint8, sum(b))[:, first]
                error = sum(_to(x[p], book, own[:, p : p + 1].astype(np.int64))[:, 0] for p, book in enumerate(books))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in own]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for, as integers."""
    own = np.array([list(bytes.fromhex(c)) for c in codes], int).reshape(len(codes), len(books))
    return np.concatenate([book[own[:, p]] for p, book in enumerate(books)], axis=1)


def checksum(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error, the sum of error over rows of the same label; null is a label of its own."""
    sums = common.cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    sums = sums.withColumnRenamed("label", "_label")
    few = sums.count() <= LABELS
    return coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def op12(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    common.small_batches(spark, 8192)
    coded, books = fit(integers(common.table(spark, sf_dir, "embeddings")))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by plain assignment: every vector against every entry, round by round."""
    steps = [f"""
kept as materialized (
  select row_number() over (order by vec_id, v) r, vec_id, label, v, len(v) // {parts} w
  from (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
),
x as materialized (select r, p, generate_subscripts(v, 1) - 1 - p * w as i, unnest(v) c from (
  select r, w, unnest(range({parts})) p, unnest(list_transform(range({parts}), lambda q: v[q * w + 1 : (q + 1) * w])) v from kept)),
x1 as materialized (select r, p, row_number() over (partition by r, p order by i) - 1 i, c from x),
c0 as materialized (select p, r - 1 e, i, c from x1 where r <= {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as materialized (
  select r, p, min(d * 256 + e) % 256 e, min(d) d
  from (select x1.r, x1.p, c{k}.e, sum((x1.c - c{k}.c) * (x1.c - c{k}.c)) d from x1 join c{k} using (p, i) group by 1, 2, 3) group by 1, 2
)""")
        if k < rounds:
            steps.append(f"""
m{k} as materialized (select p, e, i, floor(sum(c)::double / count(*))::bigint c from a{k} join x1 using (r, p) group by 1, 2, 3),
c{k + 1} as materialized (select o.p, o.e, o.i, coalesce(n.c, o.c) c from c{k} o left join m{k} n on n.p = o.p and n.e = o.e and n.i = o.i)""")
    return "with" + ",".join(steps) + f""",
coded as (select r, string_agg(lower(printf('%02x', e::int)), '' order by p) code, sum(d)::bigint error from a{rounds} group by 1),
books as (select sha256(string_agg(c::varchar, ',' order by p, e, i)) h from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from coded join kept using (r), books"""  # fmt: skip
