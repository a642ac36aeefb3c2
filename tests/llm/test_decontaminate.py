import random

import numpy as np

from barquet.llm import decontaminate as D
from barquet.llm.blockmax import BlockMaxIndex


def texts(seed=1):
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{k}" for k in range(600)]
    sentence = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)).capitalize() + "."
    items = [(k, f"{sentence(r.randint(12, 30))} {sentence(r.randint(1, 8))}") for k in range(40)]
    docs = []
    for d in range(120):
        parts = [sentence(r.randint(3, 40)) for _ in range(r.randint(1, 12))]
        if d % 4 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(items)[1].upper().replace(".", " !"))
        docs.append((d, "\n".join(parts)))
    return docs, items


def plain(docs, items):
    out = set()
    for d, t in docs:
        words = D.tokens(t)
        have = D._shingles(words)
        for i, item in items:
            q, a = D.question_and_answer(item)
            if D.tokens(item) and len(D._shingles(q) & have) >= D.QUESTION * len(D._shingles(q)) and sum(w in words for w in a) >= D.ANSWER * len(a):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    docs, items = texts()
    docs += [(500, None), (501, ""), (None, docs[0][1]), (502, "the of and " * 60_000 + items[3][1])]
    items_df = spark.createDataFrame([*items, (None, "x"), (99, None), (98, " "), items[0]], "item_id long, text string")
    got = D.leaks(spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double"), items_df).collect()
    assert {(x.doc_id, x.item_id) for x in got} == plain(docs, items)
    assert len(got) == len({(x.doc_id, x.item_id) for x in got})


def test_shards_of_items_and_filter(spark, monkeypatch):
    docs, items = texts(2)
    monkeypatch.setattr(D, "ITEMS", 15)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert {(x.doc_id, x.item_id) for x in D.leaks(df, it).collect()} == want
    assert {x.doc_id for x in D.drop_leaking(df, it).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    docs, items = texts()
    no = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), no).count() == 0
    assert D.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_block_max_searches_are_exact():
    r = np.random.default_rng(0)
    dense = r.random((300, 40)) * (r.random((300, 40)) < 0.15)
    e, t = np.nonzero(dense)
    index = BlockMaxIndex(t, e, dense[e, t], 40, 300)
    for _ in range(50):
        query = [(int(k), float(r.random())) for k in r.choice(40, 6, replace=False)]
        scores = dense @ np.bincount([k for k, _ in query], [w for _, w in query], 40)
        order = [k for k in np.argsort(-scores, kind="stable") if scores[k] > 0][:10]
        assert np.allclose([s for _, s in index.top(query, 10)], scores[order])
        assert {k for k, _ in index.above(query, 0.6)} == set(np.flatnonzero(scores >= 0.6))
    assert BlockMaxIndex(*[np.zeros(0, int)] * 3, 5, 0).top([(1, 1.0)], 3) == []
