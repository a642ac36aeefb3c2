import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from barquet.llm import mixing as K

EDGES = [(None, "x y z", "s1"), (1, None, "s1"), (2, "", None), (3, "  \t\n ", "s2"), (4, "one", None), (4, "one", None), (4, "one two", "s1"), (5, "naïve 日本\x0blast\x1cone", "é"), (6, "w " * 30_000, "big"), (7, "tail", "zz")]


def saved(spark, folder, rows):
    spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_targets(sizes):
    """Shares by weight, stopped and shared anew until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / max(1, sum(weight[s] for s in open_))
        more = {s: 2.0 * sizes[s] for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: stopped.get(s, level * weight[s]) for s in order}
        stopped |= more


def replay(rows):
    """What each row gives: its words' places in the shuffled stream of its source, gone through twice."""
    words = [(r[0], r[2], len((r[1] or "").encode().split())) for r in rows]
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    targets, out = plain_targets(sizes), []
    for s in sizes:
        quota, at = min(int(targets[s] + 0.5), 2 * sizes[s]), 0
        digest = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        for i, _, n in sorted((w for w in words if w[1] == s), key=lambda w: (digest(w[0]), w[0] is not None, w[0] or 0, w[2])):
            got = sum(max(0, min(n, quota - turn * sizes[s] - at)) for turn in (0, 1))
            out.append((i, n, sizes[s], round(targets[s], 6), got))
            at += n
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def generated(seed, sources=7, docs=400):
    r = random.Random(seed)
    return EDGES + [(k, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 900]))), "hot" if r.random() < 0.4 else f"src{r.randrange(sources)}") for k in range(100, 100 + docs)]


@pytest.mark.parametrize("rows", [EDGES, generated(1), generated(2, 60, 500), [(1, "", "a"), (2, None, None)], [(1, "a b", "only")], []])
def test_the_query_equals_a_replay_and_its_sql(spark, tmp_path, rows):
    path = saved(spark, tmp_path, rows)
    got = rows_of(K.op11(spark, path))
    assert got == sorted(replay(rows), key=str)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    found = c.sql(K.ORACLE)
    at = [found.columns.index(k) for k in ("doc_id", "size", "source_size", "target", "taken")]
    assert sorted(((r[at[0]], r[at[1]], r[at[2]], round(r[at[3]], 6), r[at[4]]) for r in found.fetchall()), key=str) == got
    assert all(r[4] <= 2 * r[1] for r in got)


def test_the_mix_is_whole_blocks_in_which_sources_keep_their_shares(spark):
    rows = generated(3, 5, 1500)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, slot long")
    got = K.mix(df.repartition(5)).collect()
    blocks = defaultdict(list)
    for r in got:
        blocks[r.source, r.block].append(r)
        assert len(r.words.encode().split()) == r.length
    assert len({(own[0].slot, own[0].source) for own in blocks.values()}) == len(blocks)
    taken = Counter()
    for (source, _), own in blocks.items():
        at = 0
        for r in sorted(own, key=lambda r: r.at):
            assert r.at == at and r.slot == own[0].slot
            at += r.length
        assert at <= K.BLOCK
        taken[source] += at
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    targets = plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sum(n % K.BLOCK == 0 or n < K.BLOCK for n in (sum(r.length for r in own) for own in blocks.values())) == len(blocks)
    # any stretch of the mix holds sources near their weights: some blocks too many or too few
    order = [own[0].source for own in sorted(blocks.values(), key=lambda own: own[0].slot)]
    count, share = Counter(), {s: sum(1 for x, _ in blocks if x == s) / len(blocks) for s in sizes}
    for k, s in enumerate(order, 1):
        count[s] += 1
        assert all(abs(count[x] - k * share[x]) < 5 for x in share)
    again = K.mix(df.repartition(2)).collect()
    key = lambda r: (r.slot, str(r.source), r.at, str(r.doc_id), r.start)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]


def test_a_document_is_taken_twice_in_order(spark):
    df = spark.createDataFrame([(1, "a b c d", "small"), (2, "x " * 40, "large"), (3, "y " * 40, "other")], "doc_id long, text string, source string")
    got = sorted((r for r in K.mix(df).collect() if r.doc_id == 1), key=lambda r: (r.block, r.at))
    assert [(r.turn, r.words) for r in got] == [(0, "a b c d"), (1, "a b c d")]


def test_many_sources_meet_their_slots(spark):
    sources = spark.range(3000).selectExpr("cast(id as int) place", "cast(1 + id % 4 as long) blocks").selectExpr("*", "sum(blocks) over (order by place) - blocks as first")
    n = 3000 // 4 * 10
    got = K.schedule(sources, n, 3000).collect()
    assert Counter((r.place, r.block) for r in got) == Counter((k, b) for k in range(3000) for b in range(1 + k % 4))
    assert len({r.slot for r in got if r.slot < n}) == sum(r.slot < n for r in got) > 0.5 * n
