import hashlib
import random

from barquet.llm import suffix_dedup as S


def plain(rows):
    """Brute force over all strings of LENGTH bytes."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - S.LENGTH + 1):
            s = b[k : k + S.LENGTH]
            if doc is not None and doc < first.get(s, 1 << 62):
                first[s] = doc
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - S.LENGTH + 1):
            if doc is not None and first[b[k : k + S.LENGTH]] < doc:
                gone[k : k + S.LENGTH] = b"\1" * S.LENGTH
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, n_bytes int")
    got = [tuple(r) for r in S.remove_repeats(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = [(None, base[0]), (7, None), (8, ""), (9, "short"), (10, "a" * 400), (11, "a" * 49), (12, "a" * 50), (13, "ab" * 200), (14, "a" * 300 + "b"), (14, "a" * 300 + "b"), (14, base[3])]
    for k in range(60):
        cuts = []
        for _ in range(r.randint(1, 5)):
            b = r.choice(base)
            at = r.randint(0, len(b) - 1)
            cuts.append(b[at : at + r.choice([30, 49, 50, 51, 60, 120])])
            cuts.append(text(r.randint(0, 15)))
        rows.append((20 + r.randint(0, 80), "".join(cuts)))
    check(spark, rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S.common, "BLOCK_BYTES", 700)
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, long), (2, long[1000:1200] + "zzz" + long[640:760]), (3, long[:60]), (4, long)]
    runs = list(S._runs(*(lambda b: (S.np.frombuffer(b, S.np.uint8), S.np.array([0, len(b)])))(long.encode())))
    assert sum(x[2].sum() for x in runs) == len(long) - S.LENGTH + 1
    check(spark, rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_stay_few():
    r = S.np.random.default_rng(1)
    data = r.integers(0, 255, 64 * 150, dtype=S.np.uint8)
    family = S.SuffixFamily(data)
    for k in range(64):
        family.add(S.np.arange(100) + 150 * k, S.np.full(100, k))
    assert len(family.levels) <= 8 and sum(len(x[0]) for x in family.levels) == 6400


def test_suffix_array_is_the_sorted_order():
    r = S.np.random.default_rng(2)
    data = r.integers(97, 99, 4000, dtype=S.np.uint8)
    data[1000:2000] = data[:1000]
    at = r.permutation(len(data) - S.LENGTH)
    order, same = S.SuffixFamily(data).suffix_array(at)
    own = [data[x : x + S.LENGTH].tobytes() for x in at[order]]
    assert own == sorted(own) and same.tolist() == [k > 0 and own[k] == own[k - 1] for k in range(len(own))]


def test_hot_minimizers_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "BATCH", 64)
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(30) for _ in range(3)]
    rows = [(k, text(r.randint(0, 9)) + r.choice(common)[r.randint(0, 5) :] + text(r.randint(0, 9))) for k in range(80)]
    rows += [(100 + k, rows[r.randint(0, 79)][1]) for k in range(20)]
    r.shuffle(rows)
    check(spark, rows)


def test_query(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(x) for x in S.op5(spark, sf_dir).collect()) == sorted(plain(rows))
