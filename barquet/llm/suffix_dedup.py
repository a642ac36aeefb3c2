"""Exact removal of repeated passages through a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller id.
Such strings are suffixes cut at ``LENGTH``; a sorted array of them finds repeats by merging.

Equal texts are one from the start, under their smallest id; the others are repeated as a whole.
The family is dealt over tasks by content. Every string of ``LENGTH`` bytes is owned by its
minimizer, the smallest hash of the ``GRAM``-byte strings in it, so equal strings meet in the task
that owns their minimizer, and a run of neighbouring strings with one minimizer travels as a
single stretch of bytes. Minimizers of a single text can't own a repeat; a first pass over
their hashes finds those that several texts have, and only stretches of these travel. Strings of a
minimizer that very many texts have (``HOT``) are dealt by their own bytes instead, once a bucket.

In its task, different stretches come in batches, in the order of documents. A batch gets a suffix
array, is merge-scanned against the levels that are there, and joins them as a new level; levels of
like size merge, so that n batches have about log n levels. A batch is as large as all before it, so
that a suffix is sorted a few times for each doubling of its part, not once for each batch.

Texts travel once, compressed, to buckets of about ``BUCKET_BYTES``; the number of buckets, and of
parts of the family, follows the bytes of the corpus, so that no task's share grows with it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
GRAM = 16
#: Suffixes of the first batch, about: those of a part mostly are one. A later one has as many as there are before it.
BATCH = 1 << 23
#: Strings of a stretch at most; longer runs (periodic texts) are several stretches.
STRETCH = 64
#: Bytes of different texts in a bucket, and in a part of the family, about; a task needs some twenty times as much memory.
BUCKET_BYTES = 8 << 20
#: Texts that make a minimizer hot; more in a large corpus, so that there are at most HOT_KEYS of them.
HOT, HOT_KEYS = 1 << 16, 1 << 20
#: Bits of a minimizer's hash that tell minimizers apart; equal ones only cost a needless comparison.
KEY_BITS = 48
_ZSTD = "zstd"


def minimizers(data: np.ndarray) -> np.ndarray:
    """The minimizer of the string of ``LENGTH`` bytes that starts at each place."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    h, n, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < GRAM:  # GRAM is a power of two
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor % (1 << 64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, n = LENGTH - GRAM + 1, 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(data) - LENGTH + 1], h[width - n :])


def _runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in row, strings, minimizer) of the runs of neighbouring strings with one minimizer."""
    for first, last in common.blocks(bounds):
        lo, hi = int(bounds[first]), int(bounds[last])
        for base in range(lo, hi, common.BLOCK_BYTES) if last - first == 1 else [lo]:  # a long row goes by pieces
            end = min(hi, base + common.BLOCK_BYTES + LENGTH - 1) if last - first == 1 else hi
            m = minimizers(data[base:end])
            if not len(m):
                continue
            at = np.arange(len(m)) + base
            row = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))[base - lo : base - lo + len(m)]
            good = at + LENGTH <= bounds[row + 1]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
            start = np.flatnonzero(new & good)
            # a run ends before the next one or the next string that isn't good
            stop = np.minimum(np.append(start[1:], len(m)), np.maximum(bounds[row[start] + 1] - LENGTH + 1 - base, start))
            yield row[start], at[start] - bounds[row[start]], stop - start, m[start] >> np.uint64(64 - KEY_BITS)


def _runs_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    found = list(_runs(data, bounds))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64))


def _mixed(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One key of a text's hash and a minimizer; equal keys of others only cost a needless comparison."""
    x = (text.view(np.uint64) ^ (h * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // KEY_BITS, 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def _slices(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by ``key``, and (key, first, last) of each slice of that order."""
    if not len(key):
        return np.zeros(0, int), []
    order = np.argsort(key.astype(np.int16) if key.max() < 1 << 15 else key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return order, list(zip(key[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True))


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


_SENT, _SENT_KINDS = ["to", "known", "a", "b", "c"], [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
_LISTS, _LIST_KINDS = ["bucket", "kind", "a", "b", "c"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_LISTS_DDL = "bucket int, kind int, a binary, b binary, c binary"
#: Kinds of lists: ids of texts, keys of shared minimizers, hot minimizers, ranges, strings of hot minimizers.
IDS, KEYS, HOTS, RANGES, STRINGS = range(5)


#: Bytes of a slice that goes to one of many buckets or parts, about, and of the batches that are held for it at most.
SLICE_BYTES, HELD_BYTES = 16 << 10, 32 << 20


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` bytes or ``HELD_BYTES``, about: with many buckets, each batch has next to nothing for one of them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= min(size, HELD_BYTES):
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, h1) of a batch's different texts; the batch has columns h1, h2, text."""
    h = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
    rows = np.unique(h, axis=0, return_index=True)[1] if len(h) else np.zeros(0, int)
    rows.sort()
    return rows, h[rows, 0] if len(h) else np.zeros(0, np.int64)


def _anchors(n: int) -> Callable:
    """Minimizers by part: (part, false, minimizers, hashes of the texts, minimizers of each). Those that several texts of a
    batch have are known to be shared: these keys go to the buckets of the texts as (bucket, true, keys), and one entry with
    its number of texts instead of a text tells the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, n * SLICE_BYTES):
            rows, h1 = _distinct(batch)
            row, _, _, h = _runs_of(*common.utf8(batch.column(2).take(pa.array(rows))))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")  # rows ascend within a minimizer
            row, h = row[order], h[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
            row, h = row[fresh], h[fresh]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(first, len(h)))
            known = np.repeat(count > 1, count)
            out = []
            order, slices = _slices((h1[row[known]] % n).astype(np.int64))
            keys = _mixed(h1[row[known]], h[known])[order]
            out += [(to, True, keys[a:b].tobytes(), b"", b"") for to, a, b in slices]
            single = np.flatnonzero(~known)
            single = single[np.argsort(row[single], kind="stable")]
            order, slices = _slices((h[single] % np.uint64(n)).astype(np.int64))
            single = single[order]
            for to, a, b in slices:
                of = row[single[a:b]]
                edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                out.append((to, False, _short(h[single[a:b]]), h1[of[edge]].tobytes(), np.diff(np.append(edge, b - a)).astype("<u4").tobytes()))
            several = first[count > 1]
            order, slices = _slices((h[several] % np.uint64(n)).astype(np.int64))
            some, times = h[several][order], count[count > 1][order].astype("<u4")
            out += [(to, False, _short(some[a:b]), b"", times[a:b].tobytes()) for to, a, b in slices]
            yield _rows(out, _SENT, _SENT_KINDS)

    return run


def _shared(n: int, hot: int) -> Callable:
    """Lists (bucket, KEYS, keys) of the minimizers that several texts have, and (-1, HOTS, minimizers) of those that at least ``hot`` have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, texts, several, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for to, known, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if known:
                    yield _rows([(to, KEYS, a, b"", b"")], _LISTS, _LIST_KINDS)
                elif b:
                    single.append(_long(a))
                    texts.append(np.repeat(np.frombuffer(b, np.int64), np.frombuffer(c, "<u4")))
                else:
                    several.append(_long(a))
                    times.append(np.frombuffer(c, "<u4").astype(np.int64))
        h, text, told, count = (np.concatenate(x) for x in (single, texts, several, times))
        order = np.argsort(h, kind="stable")
        h, text = h[order], text[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        own = h[first]
        size = np.diff(np.append(first, len(h)))
        differ = (np.minimum.reduceat(text, first) < np.maximum.reduceat(text, first)) if len(first) else np.zeros(0, bool)
        keep = np.repeat(differ | np.isin(own, told), size)
        out = []
        order, slices = _slices((text[keep] % n).astype(np.int64))
        keys = _mixed(text[keep], h[keep])[order]
        out += [(to, KEYS, keys[a:b].tobytes(), b"", b"") for to, a, b in slices]
        every, back = np.unique(np.concatenate([own, told]), return_inverse=True)
        most = every[np.bincount(back, np.concatenate([size, count]), len(every)) >= hot] if len(every) else every
        if len(most):
            out.append((-1, HOTS, _short(most), b"", b""))
        yield _rows(out, _LISTS, _LIST_KINDS)

    return run


def _ship(n: int) -> Callable:
    """(bucket, blob) of the different texts of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, n * SLICE_BYTES):
            rows, h1 = _distinct(batch)
            order, slices = _slices((h1 % n).astype(np.int64))
            out = []
            for to, a, b in slices:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as stream:
                    stream.write_batch(batch.take(pa.array(rows[order[a:b]])))
                out.append((to, sink.getvalue().to_pybytes()))
            yield _rows(out, ["bucket", "blob"], [pa.int32(), pa.binary()])

    return run


def _ids(n: int) -> Callable:
    """Lists (bucket, IDS, h1, h2, smallest ids) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, n * SLICE_BYTES // 16):  # an id and hashes have few bytes
            h1, h2, ids = (batch.column(k).to_numpy() for k in range(3))
            order, slices = _slices((h1 % n).astype(np.int64))
            h1, h2, ids = h1[order], h2[order], ids[order]
            yield _rows([(to, IDS, h1[a:b].tobytes(), h2[a:b].tobytes(), ids[a:b].tobytes()) for to, a, b in slices], _LISTS, _LIST_KINDS)

    return run


class _Lists:
    """The lists of one bucket."""

    def __init__(self, table: pa.Table) -> None:
        kind = table["kind"].to_pylist()
        self.columns = [table[c].to_pylist() for c in ("a", "b", "c")]
        self.at = {k: [i for i, x in enumerate(kind) if x == k] for k in set(kind)}

    def get(self, kind: int, column: int, dtype="<i8") -> np.ndarray:
        return np.frombuffer(b"".join(self.columns[column][i] for i in self.at.get(kind, [])), dtype)

    def ids(self) -> dict[tuple[int, int], int]:
        return dict(zip(zip(self.get(IDS, 0).tolist(), self.get(IDS, 1).tolist(), strict=True), self.get(IDS, 2).tolist(), strict=True))


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(h1, h2, data, bounds) of a bucket's different texts, blob by blob."""
    seen: set[tuple[int, int]] = set()
    for blob in table["blob"]:
        for batch in pa.ipc.open_stream(blob.as_buffer()):
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = [k for k, x in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)) if x not in seen and not seen.add(x)]
            if fresh:
                yield h1[fresh], h2[fresh], *common.utf8(batch.column(2).take(pa.array(fresh)))


def _strings(data: np.ndarray, bounds: np.ndarray, row, start, n) -> Iterator[tuple[int, int, bytes]]:
    """(row, start, bytes) of each string of the given runs."""
    for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
        lo = int(bounds[r]) + s
        for i in range(k):
            yield r, s + i, data[lo + i : lo + i + LENGTH].tobytes()


_STRETCH, _STRETCH_KINDS = ["part", "bucket", "hot", "texts", "counts", "starts", "sizes", "body"], [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
_STRETCH_DDL = "part int, bucket int, hot boolean, texts binary, counts binary, starts binary, sizes binary, body binary"


def _stretches(n: int, hot) -> Callable:
    """A bucket's stretches of shared minimizers, by part: hashes and ids of texts, stretches of each, their starts, strings and bytes."""

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        own = _Lists(lists)
        ids, wanted, hots = own.ids(), np.unique(own.get(KEYS, 0, np.uint64)), hot.value
        found: list[tuple] = []
        strings: dict[bytes, int] = {}
        for h1, h2, data, bounds in _texts(texts):
            doc = np.array([ids[x] for x in zip(h1.tolist(), h2.tolist(), strict=True)], np.int64)
            row, start, size, h = _runs_of(data, bounds)
            key = _mixed(h1[row], h)
            mine = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key if len(wanted) else np.zeros(len(h), bool)
            if len(hots):
                many = mine & (hots[np.minimum(np.searchsorted(hots, h), len(hots) - 1)] == h)
                mine &= ~many
                for r, _, s in _strings(data, bounds, row[many], start[many], size[many]):
                    strings[s] = min(strings.get(s, int(doc[r])), int(doc[r]))
            row, start, size, h = row[mine], start[mine], size[mine], h[mine]
            pieces = -(-size // STRETCH)
            of = np.repeat(np.arange(len(row)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            row, start, size, h = row[of], start[of] + nth * STRETCH, np.minimum(STRETCH, size[of] - nth * STRETCH), h[of]
            length = size + LENGTH - 1
            begin = bounds[row] + start
            flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
            found.append((h1[row], doc[row], start, size, h, data[flat]))
        out = []
        bucket = int((texts if texts.num_rows else lists)["bucket"][0].as_py())
        if found:
            text, doc, start, size, h, body = (np.concatenate(x) for x in zip(*found, strict=True))
            length = size + LENGTH - 1
            begin = np.cumsum(length) - length
            order, slices = _slices((h % np.uint64(n)).astype(np.int64))
            for to, a, b in slices:
                at = order[a:b]
                flat = np.repeat(begin[at] - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(length[at].sum())
                edge = np.flatnonzero(np.append(True, text[at][1:] != text[at][:-1]))
                of = np.stack([text[at][edge], doc[at][edge]], axis=1)
                out.append((to, bucket, False, of.tobytes(), np.diff(np.append(edge, b - a)).astype("<u4").tobytes(), start[at].astype("<u4").tobytes(), size[at].astype(np.uint8).tobytes(), pa.compress(body[flat].tobytes(), codec=_ZSTD, asbytes=True)))
        by_part: dict[int, list[bytes]] = {}
        for s in strings:
            by_part.setdefault(xxhash.xxh3_64_intdigest(s) % n, []).append(s)
        for to, own_strings in by_part.items():
            docs = np.array([strings[s] for s in own_strings], np.int64)
            out.append((to, bucket, True, docs.tobytes(), b"", b"", b"", pa.compress(b"".join(own_strings), codec=_ZSTD, asbytes=True)))
        return pa.Table.from_batches([_rows(out, _STRETCH, _STRETCH_KINDS)])

    return run


class SuffixFamily:
    """Levels of suffixes of ``data`` cut at ``LENGTH`` bytes, each sorted and without repeats, with the first document of each."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.ascontiguousarray(data)
        self.words = np.ndarray(max(0, len(data) - 7), ">u8", self.data, strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def suffix_array(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes at the places ``at`` (stable), and whether each equals the one before it."""
        word = lambda places, k: self.words[places + k].astype(np.uint64)
        rest = [*range(16, LENGTH - 8, 8), LENGTH - 8]
        a, b = word(at, 0), word(at, 8)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        begun = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))[: len(at)]
        group = np.cumsum(~begun)
        same = begun.copy()
        for k in rest:
            w = word(at[order], k)
            same[1:] &= w[1:] == w[:-1]
        mixed = np.zeros(len(at) + 1, bool)
        mixed[group[begun & ~same]] = True
        if len(open_ := np.flatnonzero(mixed[group])):  # groups that agree on 16 bytes but not on all
            own = order[open_]
            own = own[np.lexsort((*(word(at[own], k) for k in reversed(rest)), group[open_]))]
            order[open_] = own
            same[open_] = False
            equal = group[open_][1:] == group[open_][:-1]
            for k in rest:
                w = word(at[own], k)
                equal &= w[1:] == w[:-1]
            same[open_[1:]] = equal
        return order, same

    def add(self, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The first document of each suffix, in this batch or before; then the batch is a level. Documents never descend."""
        if not len(at):
            return docs
        order, same = self.suffix_array(at)
        first = np.flatnonzero(~same)
        of = np.cumsum(~same) - 1
        places, least = at[order[first]], np.minimum.reduceat(docs[order], first)
        merging, grown = True, (places, least)
        for k in range(len(self.levels) - 1, -1, -1):
            known, known_docs = self.levels[k]
            scan, met = self.suffix_array(np.concatenate([known, places]))
            hit = np.flatnonzero(met)
            new, old = scan[hit] - len(known), scan[hit - 1]
            least[new] = np.minimum(least[new], known_docs[old])
            merging = merging and len(known) <= 2 * len(grown[0])
            if merging:  # the merge-scan of the last level is its merge as well
                if grown[0] is not places:
                    scan, met = self.suffix_array(np.concatenate([known, grown[0]]))
                keep = scan[~met]
                grown = np.concatenate([known, grown[0]])[keep], np.concatenate([known_docs, grown[1]])[keep]
                self.levels.pop()
        self.levels.append(grown)
        out = np.empty(len(docs), np.int64)
        out[order] = least[of]
        return out


def _first_documents(body: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each string of stretches in the order of documents, and where each stretch's strings begin."""
    family = SuffixFamily(body)
    ends = np.cumsum(size)
    least, a = [np.zeros(0, np.int64)], 0
    while a < len(size):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + max(BATCH, done), side="right")))
        n = size[a:b]
        at = np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        least.append(family.add(at, np.repeat(doc[a:b], n)))
        a = b
    return np.concatenate(least), ends - size


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_firsts_of_part`` finds in each part; the rows come part by part."""
    rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, own in itertools.groupby(rows, key=lambda x: x[0]):
        yield from _firsts_of_part(own)


def _firsts_of_part(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Lists (bucket, RANGES, hash of the text, start, strings) of repeats, and (bucket, STRINGS, bytes, first document)."""
    parts, strings = [], []
    for _, bucket, hot, texts, counts, starts, sizes, body in rows:
        if hot:
            docs = np.frombuffer(texts, np.int64)
            strings.append((bucket, docs, pa.decompress(body, decompressed_size=LENGTH * len(docs), codec=_ZSTD, asbytes=True)))
            continue
        count, size = np.frombuffer(counts, "<u4"), np.frombuffer(sizes, np.uint8).astype(np.int64)
        own = np.repeat(np.frombuffer(texts, np.int64).reshape(-1, 2), count, axis=0)
        parts.append((np.full(len(size), bucket), own[:, 0], own[:, 1], np.frombuffer(starts, "<u4").astype(np.int64), size, np.frombuffer(pa.decompress(body, decompressed_size=int((size + LENGTH - 1).sum()), codec=_ZSTD, asbytes=True), np.uint8)))
    if parts:
        bucket, text, doc, start, size, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        length = size + LENGTH - 1
        begin = np.cumsum(length) - length
        order = np.argsort(doc, kind="stable")
        bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(begin, length.sum()).astype(np.int64)), pa.py_buffer(body)])
        code = bytes_.take(pa.array(order)).dictionary_encode().indices.to_numpy()  # equal stretches are one, with their first document
        fresh = order[np.unique(code, return_index=True)[1]]  # codes are in the order of first occurrence
        least, offset = _first_documents(body, begin[fresh], size[fresh], doc[fresh])
        # each stretch's strings as runs with one first document
        n = size[fresh]
        edge = np.append(True, least[1:] != least[:-1])
        edge[offset] = True
        run = np.flatnonzero(edge)
        run_size, run_doc = np.diff(np.append(run, len(least))), least[run]
        of = np.searchsorted(offset, run, side="right") - 1
        run_at = run - offset[of]
        run_first = np.searchsorted(of, np.arange(len(n) + 1))
        unique_of = np.empty(len(size), np.int64)
        unique_of[order] = code
        many = np.diff(run_first)[unique_of]
        who = np.repeat(np.arange(len(size)), many)
        which = np.repeat(run_first[unique_of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        gone = run_doc[which] < doc[who]
        who, which = who[gone], which[gone]
        order, slices = _slices(bucket[who])
        who, which = who[order], which[order]
        yield _rows([(to, RANGES, text[who[a:b]].tobytes(), (start[who[a:b]] + run_at[which[a:b]]).astype("<i8").tobytes(), run_size[which[a:b]].astype(np.uint8).tobytes()) for to, a, b in slices], _LISTS, _LIST_KINDS)
    if strings:
        docs = np.concatenate([x[1] for x in strings])
        body = np.frombuffer(b"".join(x[2] for x in strings), np.uint8)
        least = np.empty(len(docs), np.int64)
        order = np.argsort(docs, kind="stable")
        least[order] = _first_documents(body, order * LENGTH, np.ones(len(docs), np.int64), docs[order])[0]
        at = 0
        for bucket, own, data in strings:
            yield _rows([(bucket, STRINGS, data, least[at : at + len(own)].tobytes(), b"")], _LISTS, _LIST_KINDS)
            at += len(own)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return list(zip(starts[first].tolist(), ends[np.append(first[1:] - 1, len(ends) - 1)].tolist(), strict=True))


_DONE, _DONE_KINDS = ["h1", "h2", "first_id", "lost", "spans", "sha", "rest"], [*[pa.int64()] * 5, pa.string(), pa.binary()]
_DONE_DDL = "h1 long, h2 long, first_id long, lost long, spans long, sha string, rest binary"


def _cut_out(hot, with_bytes: bool) -> Callable:
    """What the first document of each of a bucket's texts loses and keeps."""

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        own = _Lists(lists)
        ids, hots = own.ids(), hot.value
        text, start, n = own.get(RANGES, 0), own.get(RANGES, 1), own.get(RANGES, 2, np.uint8).astype(np.int64)
        order = np.argsort(text, kind="stable")
        text, start, n = text[order], start[order], n[order]
        body = own.get(STRINGS, 0, np.uint8).tobytes()
        firsts = {body[LENGTH * k : LENGTH * (k + 1)]: d for k, d in enumerate(own.get(STRINGS, 1).tolist())}
        out = []
        for h1, h2, data, bounds in _texts(texts):
            more: dict[int, list[int]] = {}
            if firsts:
                row, at, size, h = _runs_of(data, bounds)
                many = hots[np.minimum(np.searchsorted(hots, h), len(hots) - 1)] == h
                for r, s, string in _strings(data, bounds, row[many], at[many], size[many]):
                    if firsts.get(string, 1 << 62) < ids[int(h1[r]), int(h2[r])]:
                        more.setdefault(r, []).append(s)
            lo, hi = np.searchsorted(text, h1), np.searchsorted(text, h1, side="right")
            for r, x in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                mine = data[bounds[r] : bounds[r + 1]]
                extra = np.array(more.get(r, []), np.int64)
                starts = np.concatenate([start[lo[r] : hi[r]], extra])
                ends = np.concatenate([start[lo[r] : hi[r]] + n[lo[r] : hi[r]] + (LENGTH - 1), extra + LENGTH])
                spans = _merged(starts, ends) if len(starts) else []
                at, kept = 0, []
                for s, e in [*spans, (len(mine), len(mine))]:
                    kept.append(mine[at:s].tobytes())
                    at = e
                rest = b"".join(kept)
                out.append((*x, ids[x], sum(e - s for s, e in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_bytes else b""))
        return pa.Table.from_batches([_rows(out, _DONE, _DONE_KINDS)])

    return run


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def losses(docs: DataFrame, with_bytes: bool) -> DataFrame:
    """(h1, h2, first_id, lost, spans, sha, rest) of each different text, for its smallest doc_id.

    Rows without an id are no source. Rows that share an id aren't compared with each other.
    """
    spark = docs.sparkSession
    keyed = _hashed(docs).filter(F.col("doc_id").isNotNull())
    firsts = common.cut(keyed.groupBy("h1", "h2").agg(F.min("doc_id").cast("long").alias("first_id"), F.max(F.octet_length("text")).alias("n_bytes")))
    total = firsts.agg(F.sum(F.col("n_bytes").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BUCKET_BYTES))
    texts = keyed.filter(F.octet_length("text") >= LENGTH).select("h1", "h2", "text")
    sent = texts.mapInArrow(_anchors(n), "to int, known boolean, a binary, b binary, c binary")
    hot = max(HOT, total // HOT_KEYS)  # a text has fewer minimizers than bytes, so at most HOT_KEYS are hot
    shared = common.cut(sent.repartition(n, F.when(F.col("known"), F.xxhash64("a")).otherwise(F.col("to"))).mapInArrow(_shared(n, hot), _LISTS_DDL))
    hots = shared.filter(F.col("kind") == HOTS).select("a").collect()  # at most HOT_KEYS minimizers
    hots = spark.sparkContext.broadcast(np.unique(_long(b"".join(bytes(r["a"]) for r in hots))))
    ids = firsts.filter(F.col("n_bytes") >= LENGTH).select("h1", "h2", "first_id").mapInArrow(_ids(n), _LISTS_DDL)
    shipped = texts.mapInArrow(_ship(n), "bucket int, blob binary").repartition(n, "bucket").groupBy("bucket")
    lists = ids.unionByName(shared.filter(F.col("kind") == KEYS)).repartition(n, "bucket").groupBy("bucket")
    stretches = shipped.cogroup(lists).applyInArrow(_stretches(n, hots), _STRETCH_DDL)
    ranges = stretches.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_firsts, _LISTS_DDL)
    return shipped.cogroup(ids.unionByName(ranges).repartition(n, "bucket").groupBy("bucket")).applyInArrow(_cut_out(hots, with_bytes), _DONE_DDL)


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the bytes that stay, in order.

    A null text is empty. Rows without an id lose nothing; repeated rows lose the same. A text that
    a smaller id has too goes as a whole, if it has ``LENGTH`` bytes; shorter texts stay.
    """
    rows = _hashed(docs)
    size = F.octet_length("text").cast("long")
    alone = (size < LENGTH) | F.col("doc_id").isNull()
    rest = [F.when(alone, F.encode("text", "UTF-8")).alias("own")] if with_bytes else []
    rows = rows.select("doc_id", "h1", "h2", size.alias("n_bytes"), alone.alias("alone"), F.when(alone, F.sha2("text", 256)).alias("own_sha"), *rest)
    done = losses(docs.select("doc_id", "text"), with_bytes)
    out = rows.join(done, ["h1", "h2"], "left")
    first = F.col("doc_id") == F.col("first_id")
    pick = lambda kept, mine, copied: F.when(F.col("alone"), kept).when(first, mine).otherwise(copied)
    zero = F.lit(0).cast("long")
    found = [
        "doc_id", "n_bytes", pick(zero, F.col("lost"), F.col("n_bytes")).alias("n_removed"), pick(zero, F.col("spans"), F.lit(1).cast("long")).alias("n_spans"),
        pick(F.col("own_sha"), F.col("sha"), F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    ]
    return out.select(*found, *([pick(F.col("own"), F.col("rest"), F.lit(b"")).alias("kept")] if with_bytes else []))


def op5(spark, sf_dir: str) -> DataFrame:
    """What every document loses to those before it."""
    common.small_batches(spark)
    return remove_repeats(common.table(spark, sf_dir, "documents"), with_bytes=False)
