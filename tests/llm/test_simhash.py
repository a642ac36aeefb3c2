import random
import re

import xxhash

from barquet.llm import simhash


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    parent = {f: f for _, f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)  # so that shards are divided
    r = random.Random(2)
    base = [[f"w{r.randint(0, 500)}" for _ in range(r.randint(1, 300))] for _ in range(20)]
    rows = [(None, "a b c"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (904, "two words"), (905, "É é"), (905, "É é"), (906, "x " * 50_000)]
    for d in range(150):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = f"n{r.randint(0, 9)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int")
    got = simhash.near_duplicates(df).collect()
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=str) == plain(rows)


def test_links_in_close_clusters(spark):
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(50)}
    for p in list(prints)[:20]:
        for _ in range(30):
            prints.add(p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.link_fingerprints(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()
    find = {k: k for k in range(len(prints))}

    def root(t, x):
        while t[x] != x:
            x = t[x]
        return x

    for x in links:
        assert (prints[x.u] ^ prints[x.v]).bit_count() <= 3
        find[root(find, x.u)] = root(find, x.v)
    want = {k: k for k in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                want[root(want, i)] = root(want, j)
    groups = lambda t: sorted(sorted(k for k in t if root(t, k) == g) for g in {root(t, k) for k in t})
    assert groups(find) == groups(want)


def test_keep_first(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "same words here", "en", "s", 1), (2, "same words here", "en", "s", 1), (7, "quite another text", "en", "s", 1), (8, None, "en", "s", 1), (9, " ", "en", "s", 1), (None, "same words here", "en", "s", 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([2, 7, 8, 9, None], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
