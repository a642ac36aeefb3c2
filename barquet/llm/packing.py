"""Packing token ids into sequences of a fixed length, best fit decreasing.

A document longer than a window is first cut into full windows, each a sequence of its own, whose
number is known without a shuffle. The pieces that are left are packed longest first, each into the
open window with the least sufficient room; a segment tree over the remaining capacities finds it.
They are dealt evenly over tasks by a hash of their document, and each task packs its own, so a corpus
leaves a few part-filled windows for each ``PIECES`` pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
END = 1
#: Pieces that one task packs, about.
PIECES = 50_000
# fixed value: the vocabulary's pattern of words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed value: the vocabulary's added token
SPECIAL = {"<|endoftext|>": 50256}
#: The byte-level vocabulary, as the ``tokenizers`` library reads it and as ranks of the same ids.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids of the byte-level tokenizer, which adds no special tokens but reads one where the text holds it.

    ``tiktoken`` gives the same ids from the same vocabulary in a third of the time; what its
    matcher refuses (runs of white space beyond its limit) goes to ``tokenizers``.
    """

    def __init__(self, path: Callable[[str], str]) -> None:
        import tiktoken

        self.path, self.slow = path, None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path(RANKS), "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):  # what the matcher raises, no Exception
                raise
            return np.array(self.exact(text), np.uint32)

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path(VOCABULARY))
        return self.slow.encode(text, add_special_tokens=False).ids


def vocabulary_path(name: str) -> str:
    """The default place of vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: Callable[[str], str] = vocabulary_path, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the rest of each document.

    The ids are the tokenizer's, then ``END``; a null text is empty and so has one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.append(encode(text or ""), END).astype("<u4")
                out += [(doc_id, s, min(window, len(own) - s), zlib.crc32(own[s : s + window].tobytes()), len(own)) for s in range(0, len(own), window)]
            doc_id, *rest = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """Open windows by remaining capacity, below a segment tree that knows which capacities are there."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window with the least room of at least ``need``: (room, window)."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, none longer than ``window``; the first piece wins a tie."""
    open_, place, offset, n = OpenWindows(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room, at = open_.tightest(need) or (window, n)
        n += at == n
        place[k], offset[k] = at, window - room
        open_.add(room - need, at)
    return place, offset


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.whole(batches)  # about PIECES rows
        if table is not None:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            place, offset = best_fit_decreasing(table["length"].to_numpy(), window)
            yield from table.append_column("sequence_id", pa.array((task << 32) + place)).append_column("offset", pa.array(offset)).to_batches()

    return run


def pack(docs: DataFrame, path: Callable[[str], str] = vocabulary_path, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Repeated rows are packed as often as they come; a null id stays null.
    """
    cut = common.cut(pieces(docs, path, window))
    rests = cut.filter(F.col("length") < window)
    tasks = max(1, rests.count() // PIECES)
    packed = rests.repartition(tasks, F.xxhash64("doc_id", "start", "ids_crc32")).mapInArrow(_pack(window), cut.schema.add("sequence_id", "long").add("offset", "long"))
    # numbers of the tasks' windows are below 2^62, those of full windows above
    whole = cut.filter(F.col("length") == window).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def op3(spark, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    common.small_batches(spark)
    return pack(common.table(spark, sf_dir, "documents"))
