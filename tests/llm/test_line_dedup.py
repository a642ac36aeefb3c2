import random

from barquet.llm import components, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(line):
    w = line_dedup.WIDTH
    return {line} if len(line) < w else {line[k : k + w] for k in range(len(line) - w + 1)}


def normal(line):
    return " ".join(line.lower().split())


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def plain(rows):
    """(doc, line number) of the lines that stay, by comparing all pairs."""
    lines = [(d, k, normal(x)) for d, t in rows for k, x in enumerate(t.split("\n"))]
    texts = sorted({x for _, _, x in lines if x})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(a, b) >= line_dedup.THRESHOLD:
                parent[find(a)] = find(b)
    first = {}
    for d, k, x in sorted(lines):
        if x:
            first.setdefault(find(x), (d, k))
    return {(d, k) for d, k, x in lines if not x or first[find(x)] == (d, k)}


def corpus(seed=3, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(r.randint(12, 40))) for _ in range(25)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(base).split()
            if r.random() < 0.5:
                words[r.randrange(len(words))] = word()
            lines.append(" ".join(words) if r.random() < 0.9 else "")
        rows.append((d, "\n".join(lines)))
    return rows


def test_agrees_with_all_pairs(spark):
    rows = corpus()
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    wanted = plain(rows)
    assert len(got) == sum(t.count("\n") + 1 for _, t in rows)
    gone, gone_wanted = {(r.doc_id, r.line_no) for r in got} - kept, {(r.doc_id, r.line_no) for r in got} - wanted
    assert len(gone & gone_wanted) >= 0.95 * len(gone_wanted)  # banding may miss a pair
    assert gone <= gone_wanted  # and never joins lines that aren't alike


def test_edge_cases(spark):
    same = "one line that is long enough to have some shingles of its own"
    rows = [(1, same, "en", "s", 61), (1, same, "en", "s", 61), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, same + "!", "en", "s", 62), (4, f"x\n{same}\n\n" + "word " * 20_000, None, None, None), (5, same.upper(), "en", "s", 61)]
    out = {(r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (2, None, 0) in out and (3, "", 0) in out
    assert (None, same + "!", 62) in out  # null ids come first
    assert not any(d in (1, 5) for d, _, _ in out)  # all their lines are elsewhere
    four = next(t for d, t, _ in out if d == 4)
    assert four == "x\n\n" + "word " * 20_000


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def recall(spark, pairs):
    """The share of ``pairs`` of alike lines that end up in one class, each pair being a document of two lines."""
    rows = [(k, "\n".join(p)) for k, p in enumerate(pairs)]
    got = {(r.doc_id, r.line_no): r.class_doc_id for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").collect()}
    assert all(similarity(normal(a), normal(b)) >= line_dedup.THRESHOLD for a, b in pairs)
    return sum((k, 1) not in got for k in range(len(pairs))) / len(pairs)


def words(r, letters, n, least=2, most=8):
    line = ""
    while len(line) < n:
        line += " " * bool(line) + "".join(r.choice(letters) for _ in range(r.randint(least, most)))
    return line[: n - 1] + r.choice(letters)  # no blank at the end


def test_alike_lines_of_all_lengths_meet(spark):
    r = random.Random(5)
    pairs = [(line := words(r, "abcdefghijklmnopqrstuvwxyz", r.randint(55, 60)), line + r.choice(["!", "!!!", " more"])) for _ in range(200)]
    assert recall(spark, pairs) >= 0.97


def test_alike_lines_without_certain_letters_meet(spark):
    r = random.Random(6)
    pairs = [(line := words(r, "abcdefghijklm", r.randint(70, 120)), line + r.choice(["!", "!!!", " bad"])) for _ in range(100)]
    long = [(line := words(r, "abcdefghijklmnopqrstuvwxyz", 150, 20, 40), line[:-3]) for _ in range(100)]
    assert recall(spark, pairs + long) >= 0.97


def test_short_lines_meet(spark):
    """Few shingles leave most bins empty; alike lines still take the same minima."""
    r = random.Random(8)
    pairs = []
    while len(pairs) < 200:
        line = words(r, "abcdefghijklmnopqrstuvwxyz", r.randint(16, 34))
        other = line + r.choice("!?s") if r.random() < 0.7 else line[1:]
        if similarity(normal(line), normal(other)) >= line_dedup.THRESHOLD:
            pairs.append((line, other))
    assert recall(spark, pairs) >= 0.97


def test_lines_at_the_threshold_meet(spark):
    r = random.Random(10)
    pairs = []
    while len(pairs) < 200:
        line = words(r, "abcdefghijklmnopqrstuvwxyz", r.randint(60, 900)).split()
        other = list(line)
        for _ in range(max(1, len(line) // 12)):
            other[r.randrange(len(other))] = "qqq"
        a, b = " ".join(line), " ".join(other)
        if 0.8 <= similarity(a, b) < 0.88:
            pairs.append((a, b))
    assert recall(spark, pairs) >= 0.95


def test_shingles_are_characters_at_every_position(spark):
    line = "naïve 日本語 😀 " + "some words of a line that is not short " * 2
    got = spark.createDataFrame([(1, line), (2, line[1:])], "doc_id long, text string")
    F = line_dedup.F
    rows = line_dedup._shingles(line_dedup.lines_of(got).select("doc_id", F.encode("line", "UTF-32").alias("b"))).select("doc_id", F.substring("b", 4 * F.col("at") + 1, F.lit(4 * line_dedup.WIDTH)).alias("s"))
    sets = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.count_distinct("s").alias("n")).collect()}
    assert sets == {1: len(shingles(normal(line))), 2: len(shingles(normal(line[1:])))}


def test_every_pair_of_a_hot_band_is_compared(spark, monkeypatch):
    """Lines of one band in pairs of alike ones: whatever lies between them, each meets its copy."""
    n = 60
    r = random.Random(7)
    base = [words(r, "abcdefghijklmnopqrstuvwxyz", 80) for _ in range(n)]
    rows = [(k * 2 + i, text) for i in (0, 1) for k, text in enumerate(x + "!" * i for x in base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (line_dedup.BAND_ROWS, 50):  # whole, and in several parts
        monkeypatch.setattr(line_dedup, "BAND_ROWS", part)
        own = line_dedup.lines_of(docs)
        F = line_dedup.F
        # all in one band; in the order of the other, copies are far from one another
        hot = [F.lit(1).cast("long").alias("b0"), *[F.xxhash64("h1", F.lit(b)).alias(f"b{b}") for b in range(1, line_dedup.BANDS)]]
        signed = own.select("h1", *hot).distinct()
        got = {x.node: x.root for x in line_dedup.alike(own, signed).collect()}
        names = {x.doc_id: x.h1 for x in own.collect()}
        assert all(got[names[2 * k]] == got[names[2 * k + 1]] == min(names[2 * k], names[2 * k + 1]) for k in range(n))


def plan_of(df, mode="executedPlan"):
    return str(getattr(df._jdf.queryExecution(), mode)().toString())


def test_costly_columns_are_made_once(spark):
    """The optimizer repeats a projected column in each filter and column that reads it, unless something keeps it."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    lines = line_dedup.lines_of(docs)
    signed = plan_of(line_dedup.signatures(lines), "optimizedPlan")
    assert signed.lower().count("encode(") == 1 and signed.count("lower(") == 1
    texts, pairs = lines.select("h1", "line"), spark.createDataFrame([], "u long, v long")
    alike = plan_of(line_dedup.similar_lines(texts, pairs), "optimizedPlan")
    assert alike.count("array_intersect(") == 1 and alike.count("array_union(") == 1 and alike.count("Encode.encode(") == 2


def test_rows_of_bands_are_shuffled_once(spark):
    """The sizes of bands and the lines in them come out of one shuffle, whatever the number of shared bands."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    signed = line_dedup.signatures(line_dedup.lines_of(docs))
    assert len([c for c in signed.columns if c != "h1"]) == line_dedup.PER_ROW
    got = line_dedup.shared_bands(signed).collect()
    members = {}
    for r in got:
        members.setdefault(r.band, set()).add(r.h1)
    assert got and all((r.first, r.last, r.n) == (min(m := members[r.band]), max(m), len(m)) and r.n > 1 for r in got)


def test_similarity_counts_different_shingles(spark):
    r = random.Random(12)
    made = [words(r, "ab", r.randint(5, 60)) for _ in range(12)]
    made += ["word " * 30 + "x", "word " * 20 + "x", "naïve 日本語 😀 " * 4, "naïve 日本語 😀 " * 3 + "naïve 日本語 ! "] + [x + "a" for x in made]
    made = sorted({normal(x) for x in made})
    texts = spark.createDataFrame(list(enumerate(made)), "h1 long, line string")
    pairs = [(u, v) for u in range(len(made)) for v in range(u)]
    got = {(x.u, x.v): x.similarity for x in line_dedup.similar_lines(texts, spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(u, v): similarity(made[u], made[v]) for u, v in pairs if similarity(made[u], made[v]) >= line_dedup.THRESHOLD}
