"""What a part of op5 costs as it grows, and what goes to each of many buckets."""

import numpy as np
import pyarrow as pa
import pytest

from barquet.llm import suffix_dedup as S


@pytest.mark.parametrize("strings", [640, 6400, 25600])
def test_a_suffix_is_sorted_a_few_times_for_each_doubling(monkeypatch, strings):
    monkeypatch.setattr(S, "BATCH", 64)
    sorted_, plain = [], S.SuffixFamily.suffix_array
    monkeypatch.setattr(S.SuffixFamily, "suffix_array", lambda self, at: sorted_.append(len(at)) or plain(self, at))
    r = np.random.default_rng(4)
    texts = r.integers(97, 123, (40, 32 + S.LENGTH - 1), dtype=np.uint8)
    pick = r.integers(0, 40, strings // 32)  # stretches of 32 strings, many of them again
    data = texts[pick].copy()
    data[::3, 5] = r.integers(97, 123, len(data[::3]))
    begin, size, doc = np.arange(len(pick)) * data.shape[1], np.full(len(pick), 32), np.arange(len(pick))
    least, offset = S._first_documents(data.ravel(), begin, size, doc)
    first: dict[bytes, int] = {}
    want = [first.setdefault(row[k : k + S.LENGTH].tobytes(), d) for d, row in enumerate(data) for k in range(32)]
    assert least.tolist() == want and offset.tolist() == list(range(0, strings, 32))
    assert sum(sorted_) <= 12 * strings


def test_rows_are_gathered_for_many_buckets():
    text = ["x" * 900 + str(k) for k in range(400)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(range(400), pa.int64()), pa.array(text)], ["h1", "h2", "text"])
    batches = [rows.slice(k, 10) for k in range(0, 400, 10)]
    few, many = (pa.Table.from_batches(list(S._ship(n)(iter(batches)))) for n in (1, 40))
    assert len(many) <= 80  # not one of each batch for each bucket, which are 400
    for shipped in (few, many):
        back = [x for blob in shipped["blob"] for b in pa.ipc.open_stream(blob.as_buffer()) for x in b.column(2).to_pylist()]
        assert sorted(back) == sorted(text)
    assert [b.num_rows for b in S._gathered(iter(batches), 1)] == [10] * 40 and list(S._gathered(iter([]), 9)) == []
