import hashlib
import random
import zlib

import numpy as np
import pytest

from barquet.llm import common
from barquet.llm import periodic_runs as K


def brute(words):
    """Runs by comparing every word with the one a period on."""
    n, seen = len(words), {}
    for q in range(1, n // K.PERIODS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(K.WORDS, K.PERIODS * q):
                seen.setdefault((s, length), q)  # the least period comes first
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda x: (x[0], x[2]))


def texts(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < r.choice([0, 3, 8, 30, 90, 200]):
            root = [r.choice("abcdef"[: r.choice([1, 2, 3, 6])]) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13]))]
            words += (root * r.choice([1, 1, 2, 4, 6, 9]))[: r.randint(1, 80)]
        yield [w.encode() for w in words]


def test_trees_find_the_runs_of_brute_force():
    for words in texts(400, 1):
        assert K.tree_runs(words) == brute(words)


def test_the_screen_loses_no_run():
    rows = list(texts(400, 2)) + [[b"a"] * 6, [b"a"] * 7, [], [b"a"] * 5, [b"x", *[b"a"] * 6, b"x"], [b"a", b"b"] * 4, [b"a", b"b"] * 4 + [b"a"], [b"a", b"b", b"c", b"d", b"e"] * 4]
    assert K.runs_of(rows) == [brute(x) for x in rows] == K.runs_of(rows, screen=False)
    assert sum(map(bool, K.runs_of(rows))) > 100


def test_the_screen_passes_few_ordinary_texts(spark):
    rows = [(x.text or "").encode().split() for x in common.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    hashes = np.fromiter((hash(w) for x in rows for w in x), np.int64)
    own = K.stretches(hashes, np.cumsum([0, *map(len, rows)]))
    assert sum(b - a for x in own for a, b in x) < 0.1 * len(hashes)


def test_suffixes_agree():
    words = [1, 2, 1, 2, 1, 3, 1, 2, 1]
    tree = K.SuffixTree(words)
    for i in range(len(words)):
        for j in range(len(words)):
            if i != j:
                n = 0
                while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                    n += 1
                assert tree.agree(np.array([i]), np.array([j]))[0] == n
    assert sorted(range(len(words) + 1), key=lambda i: words[i:]) == np.argsort(tree.rank).tolist()
    assert sorted(range(len(words) + 1), key=lambda i: [-x for x in words[i:]]) == np.argsort(tree.reversed_rank()).tolist()


EDGES = [None, "", "  \t\r\n\v\f ", "a", "a a a a a a", "a a a a a a a a a a a a", "x a b a b a b a b y", "a b c " * 5000, "naïve 日本 " * 9, "a\x1ca " * 6]


def test_find_runs_on_edges_repeats_and_other_columns(spark):
    rows = [(k, t, "old", 1) for k, t in enumerate(EDGES)] + [(None, EDGES[6], "old", 2), (6, EDGES[6], "old", 1)]
    got = K.find_runs(spark.createDataFrame(rows, "doc_id long, text string, collapsed string, n_chars long")).collect()
    assert len(got) == len(rows) and sorted((r.n_chars, str(r.text)) for r in got) == sorted((r[3], str(r[1])) for r in rows)
    for r in got:
        words = (r.text or "").encode().split()
        runs = brute(words) if len(words) < 500 else [(0, 15000, 3)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed.encode() == K.collapsed(words, runs)
    assert {r.collapsed for r in got if r.doc_id == 7} == {"a b c"}


def test_an_empty_table(spark):
    assert K.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def replay(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return doc_id, len(runs), *(best or (None, None, None)), best and best[1] * 1000 // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest()


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Documents of the small tables, and edges, many of which the query makes to repeat."""
    path = str(tmp_path_factory.mktemp("runs"))
    docs = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect() if len(r.text or "") < 4000]
    ids = [k for k in range(100_000, 101_000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = docs + list(zip(range(10_000, 10_000 + len(EDGES)), EDGES, strict=True)) + list(zip(ids, (x for _, x in docs), strict=False)) + list(zip(ids[90:], EDGES, strict=False)) + [(None, "a " * 9)]
    rows = [r for r in rows if len((r[1] or "").split()) < 2000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_the_query_equals_a_replay(spark, few):
    path, rows = few
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in K.op13(spark, path).collect()), key=key) == sorted((replay(*r) for r in rows), key=key)
