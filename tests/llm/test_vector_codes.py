import math

import numpy as np
import pytest

from barquet.llm import common
from barquet.llm import vector_codes as K


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain assignment of every vector to every entry; rows: (vec_id, label, vector)."""
    kept = [(i, lab, [math.floor(1024 * float(x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept], np.int64).reshape(len(kept), parts, -1)
    codes, error, books = [], 0, []
    for p in range(parts):
        own = x[:, p]
        book = own[:entries].copy()
        for k in range(rounds + 1):
            d = ((own[:, None, :] - book) ** 2).sum(-1)
            near = d.argmin(1)
            if k < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        s, n = own[near == e].sum(0), int((near == e).sum())
                        book[e] = [int(c) // n for c in s]
        codes.append(near)
        error = error + d[np.arange(len(own)), near]
        books.append(book)
    labels = {}
    for (_, lab, _), e in zip(kept, error, strict=True):
        labels[lab] = labels.get(lab, 0) + int(e)
    return [(i, bytes(int(c[r]) for c in codes).hex(), int(error[r]), labels[lab], K.checksum(books)) for r, (i, lab, _) in enumerate(kept)]


def saved(spark, folder, rows, extra=False):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string")
    (df if extra else df.drop("code")).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


key = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("seed,n,entries,spread", [(1, 900, 256, 1.0), (2, 700, 256, 0.002), (3, 40, 256, 1.0), (4, 1200, 7, 30.0), (5, 300, 1, 1.0), (6, 500, 64, 20000.0)])
def test_codes_are_those_of_plain_assignment(spark, seed, n, entries, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (9, 16))
    x = (centres[r.integers(0, 9, n)] + r.normal(0, spread / 4, (n, 16))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a common vector
    rows = [(int(i), int(i) % 3 or None, x[i].tolist()) for i in range(n)]
    coded, books = K.fit(K.integers(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)), entries=entries)
    got = [(*g[:4], K.checksum(books)) for g in K.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, entries=entries), key=key)


def test_bounds_decide_most_parts_and_never_wrongly():
    r = np.random.default_rng(0)
    x = r.integers(-500, 500, (4000, 8))
    book = x[:64].copy()
    own, seen = K.Bounds.of(x, book, 8), []
    for _ in range(6):
        new = np.array([x[own.near[:, 0] == e].sum(0) // max(1, (own.near[:, 0] == e).sum()) if (own.near[:, 0] == e).any() else book[e] for e in range(64)])
        own = own.move(x, new, np.sqrt(((new - book) ** 2).sum(1)), 8)
        exact = K._squares(x, new)
        assert (own.near[:, 0] == exact.argmin(1)).all()
        roots = np.sqrt(exact)
        assert (own.up + 1e-9 >= roots[np.arange(4000), own.near[:, 0]]).all()
        for j in range(9):  # from each place on, no entry is nearer than the bound
            others = roots.copy()
            np.put_along_axis(others, own.near[:, :j].astype(int), np.inf, 1)
            assert (own.low[:, j] <= others.min(1) + 1e-9).all()
        assert (np.diff(own.low, axis=1) >= 0).all()
        seen.append(float((own.need > 8).mean()))
        book = new
    assert seen[-1] < 0.5 and seen[-1] < seen[0]


def test_bounds_are_rounded_away_from_the_truth():
    x = np.array([0.1, 1 / 3, 123456789.123, 0.0])
    assert (K._above(x) > x).all() and (K._below(x) < x).all()


def test_edges_of_the_table(spark, tmp_path):
    v = [0.25, -0.5, 1.0, -1.0, 0.1, 0.2, 0.3, 0.4]
    rows = [(3, 1, v), (3, 1, v), (3, None, [x / 2 for x in v]), (None, None, v), (7, 2, None), (8, 2, [*v[:7], None]), (9, 2, [*v[:7], float("nan")]), (10, 2, [*v[:7], float("inf")]), (1, 2, [-x for x in v])]
    got = [tuple(r) for r in K.op12(spark, saved(spark, tmp_path, rows, True)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key) and len(got) == 5


def test_an_empty_table_and_one_without_good_rows(spark, tmp_path):
    assert K.op12(spark, saved(spark, tmp_path / "a", [])).collect() == []
    assert K.op12(spark, saved(spark, tmp_path / "b", [(1, 1, None), (2, 1, [float("nan")] * 8)])).collect() == []


def test_vectors_that_do_not_fit_are_refused(spark):
    for vectors in ([[1.0] * 8, [1.0] * 4], [[1.0] * 6]):
        with pytest.raises(ValueError):
            K.fit(K.integers(spark.createDataFrame([(k, 0, v) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>")))


def test_decoded_codes_are_near_their_vectors(spark, sf_dir):
    kept = K.integers(common.table(spark, sf_dir, "embeddings"))
    coded, books = K.fit(kept)
    rows = coded.join(kept.select("vec_id", "v"), "vec_id").collect()
    back = K.decoded([r.code for r in rows], books)
    assert [int(((np.array(r.v) - b) ** 2).sum()) for r, b in zip(rows, back, strict=True)] == [r.error for r in rows]
