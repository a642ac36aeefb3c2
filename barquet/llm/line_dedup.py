"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line's normal form is lower case with single spaces. Two lines are alike if the Jaccard
similarity of their sets of character shingles (``WIDTH`` characters at every position) is
``THRESHOLD`` or more. Signatures are minima over all shingles of a line, ``BANDS`` bands of
``ROWS`` minima each; lines that share a band are candidates, and the exact similarity decides.
Every two lines of a band are compared unless links already join them: a few neighbours first, then
all pairs whose lines lie in different components. One line of every connected component stays: the
first by (doc_id, line number).

Each minimum is that of one bin of hash values, so that one hash of a shingle serves all of them
(one-permutation hashing). A line of few shingles leaves bins empty; its shingles are therefore hashed
again, level by level, and an empty bin takes its minimum from the first level that reaches it. Of a
line of n shingles only hashes below ``DEPTH`` / n of the range count: the minima of all bins lie
there but for e^(-DEPTH / bins), and the bound changes with n without a step. More rows a band make
candidates fewer; they are a parameter, as chance likeness grows with the square of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import connected_components

WIDTH = 10
THRESHOLD = 0.8
BANDS = 8
ROWS = 4
#: Bands that share a row of minima.
PER_ROW = 2
#: Hashes of a line that count, about.
DEPTH = 3 * BANDS * ROWS
#: Positions that one array holds, so that a very long line isn't one array.
STEP = 4096
#: Neighbours in a band, in the order of another band, that a line is compared with first, besides the band's first line.
NEIGHBOURS = 4
#: Rows of a band that one window sorts, about; larger bands are salted by that order. Pairs of parts of as many rows meet later.
BAND_ROWS = 2000
#: Rows of (hash) that a broadcast may hold, 16 bytes each in Spark's own layout and some overhead.
BROADCAST_ROWS = 200_000
#: A line that makes up this share of all is hot: there are at most as many hot lines as its inverse.
HOT_SHARE = 0.001
#: Bits of a hash that tell its bin, and that are its value within a level.
BIN_BITS, VALUE_BITS = 5, 24


def _single_spaces(line: Column) -> Column:
    """Single spaces; the pattern is only run where there is something to replace."""
    odd = [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\u00a0")]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.trim(F.regexp_replace(line, r"[\s\u00a0]+", " "))).otherwise(line)


def _shingles(lines: DataFrame) -> DataFrame:
    """A row for each shingle of each row, with its place ``at``; column b: the line in UTF-32, where a place in the line
    is a place in its bytes. A line shorter than a shingle is one."""
    own = lines.columns
    last = F.greatest(F.lit(0), F.shiftright(F.octet_length("b"), 2) - WIDTH)
    x = lines.select(*own, F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("_from"))
    return x.select(*own, F.explode(F.sequence("_from", F.least(F.col("_from") + (STEP - 1), last))).alias("at"))


def _once(**columns: Column) -> Column:
    """``columns`` for a select, behind a generator of one row: else the optimizer repeats a costly one in each place that reads it."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _keys() -> list[Column]:
    """A document is known by its id and text, so that repeated rows are one and rows that only share the id are not."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, h1, h2) for each line: its normal form and two hashes of that. A null text has none."""
    docs = docs.filter(F.col("text").isNotNull()).select(*_keys(), "text")  # before the lines: a text is hashed once, not once a line
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    lines = lines.select("doc_id", "text_hash", "line_no", _once(_low=F.trim(F.lower("_raw"))))
    lines = lines.select("doc_id", "text_hash", "line_no", _once(line=_single_spaces(F.col("_low"))))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), F.col("line")))


def signatures(lines: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h1, b0, b1) of each different line but blank ones: hashes of two bands' minima a row, null where a band has none.

    One generated row a shingle runs within one stage of compiled code and ends in a partial aggregate.
    A shingle only looks at the minima of its own two bands: a line has a group for each two.
    """
    bins, depth, wide = bands * rows, DEPTH * bands * rows // (BANDS * ROWS), PER_ROW * rows
    if bins > 1 << BIN_BITS:
        raise ValueError(f"more than {1 << BIN_BITS} minima")
    x = lines.filter("line != ''").select("h1", _once(b=F.encode("line", "UTF-32")))
    x = x.select("h1", "b", F.greatest(F.lit(1), F.shiftright(F.octet_length("b"), 2) - (WIDTH - 1)).alias("n"))
    x = x.select("h1", "b", (F.lit(depth << VALUE_BITS) / F.col("n")).cast("long").alias("below"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(depth) / F.col("n")).cast("long") - 1)).alias("level"))
    x = _shingles(x).select("h1", "below", "level", F.xxhash64(F.substring("b", 4 * F.col("at") + 1, F.lit(4 * WIDTH)), "level").alias("h"))
    value = F.shiftleft("level", VALUE_BITS) + F.col("h").bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    x = x.select("h1", "below", F.shiftrightunsigned("h", 64 - BIN_BITS).cast("int").alias("bin"), value.alias("value")).filter(F.col("value") < F.col("below"))
    x = (x if bins == 1 << BIN_BITS else x.filter(F.col("bin") < bins)).select("h1", (F.col("bin") / wide).cast("int").alias("g"), F.pmod("bin", F.lit(wide)).alias("bin"), "value")
    least = x.groupBy("h1", "g").agg(*[F.min(F.when(F.col("bin") == k, F.col("value"))).cast("int").alias(f"m{k}") for k in range(wide)])
    names = [[f"m{k}" for k in range(b * rows, (b + 1) * rows)] for b in range(PER_ROW)]
    each = [F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.col("g") * PER_ROW + b, *[F.coalesce(m, F.lit(-1)) for m in own])).alias(f"b{b}") for b, own in enumerate(names)]
    return least.select("h1", *each)


def shared_bands(signed: DataFrame) -> DataFrame:
    """(band, h1, next, first, last, n) of each line in each band of two or more, of n in all; next: the line's hash of another band.

    signed: h1 and hashes of bands, in one row or several. Its rows are shuffled once, for the bands' sizes and for the join with these.
    """
    bands = [c for c in signed.columns if c != "h1"]
    each = [F.struct(F.col(b).alias("band"), F.coalesce(bands[(k + 1) % len(bands)], b).alias("next")) for k, b in enumerate(bands)]
    rows = signed.select("h1", F.inline(F.array(*each))).filter("band is not null").repartition("band")
    shared = rows.groupBy("band").agg(F.min("h1").alias("first"), F.max("h1").alias("last"), F.count("next").alias("n")).filter("first < last")
    return common.cut(rows.join(shared.hint("shuffle_hash"), "band"))


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of h1, u > v, to be compared first, of the rows of ``shared_bands``.

    In a band of more than two lines, each meets the band's first line and its ``NEIGHBOURS``
    predecessors in the order of the next band's hash.
    """
    pairs = rows.filter("h1 = last").select(F.col("h1").alias("u"), F.col("first").alias("v"))
    more = rows.filter("n > 2").withColumn("salt", F.when(F.col("n") > BAND_ROWS, F.pmod(F.col("next"), F.ceil(F.col("n") / BAND_ROWS))).otherwise(F.lit(0)))
    w = Window.partitionBy("band", "salt").orderBy("next", "h1")
    near = more.select("h1", F.array(F.col("first"), *[F.lag("h1", k).over(w) for k in range(1, NEIGHBOURS + 1)]).alias("others")).select("h1", F.explode("others").alias("other"))
    near = near.filter("other is not null and h1 != other").select(F.greatest("h1", "other").alias("u"), F.least("h1", "other").alias("v"))
    return pairs.unionByName(near).distinct()


def apart(rows: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v) of h1 between all alike lines that share a band and are in different components.

    rows: of ``shared_bands``; roots: (node, root) of the lines that have links; texts: (h1, line).
    A line's set of shingles is made once a band and travels with it. A large band is divided into
    parts, and each pair of parts is joined by itself.
    """
    own = rows.filter(F.col("n") > NEIGHBOURS + 1).select("band", "h1")  # in smaller ones all lines were neighbours
    own = own.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select("band", "h1", F.coalesce("root", "h1").alias("c"))
    mixed = own.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most")
    parts = F.ceil(F.col("n") / BAND_ROWS).cast("int")
    own = common.cut(own.join(mixed.select("band", parts.alias("parts")), "band").withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int")))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    bands = own.groupBy("h1").agg(F.collect_list("band").alias("bands"))  # a line has BANDS at most
    cells = own.join(texts.join(bands, "h1"), "h1").select("band", "bands", "h1", "c", "part", F.array_distinct(_hashes(F.col("line"))).alias("s"), F.explode(cells).alias("x")).select("band", "bands", "h1", "c", "part", "s", "x.i", "x.j")
    a, b = cells.alias("a"), cells.alias("b")
    met = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("band", "i", "j")]
    once = (F.col("a.part") != F.col("b.part")) | (F.col("a.i") == F.col("a.j"))
    n = F.size("a.s") + F.size("b.s")
    open_ = once & (F.col("a.h1") > F.col("b.h1")) & (F.col("a.c") != F.col("b.c")) & (F.least(F.size("a.s"), F.size("b.s")) >= threshold * F.greatest(F.size("a.s"), F.size("b.s")))
    first = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.band")
    # alike if the common shingles are threshold / (1 + threshold) of both sets' sizes; only looked at for open pairs, in the first band that they share
    share = F.when(open_ & first, F.size(F.array_intersect("a.s", "b.s")) / n)
    links = a.join(b, met[0] & met[1] & met[2] & (share >= threshold / (1 + threshold) - 1e-12))
    return links.select(F.col("a.h1").alias("u"), F.col("b.h1").alias("v")).distinct()


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast, if they are few; else for Spark to shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_lines(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, similarity) of those ``pairs`` (u, v) that are alike; texts: (h1, line) of their lines, once each."""
    # the texts travel, not their shingles: these are many times as long; a line has few candidates, so those of one u are hashed against it in one row
    others = pairs.join(texts.select(F.col("h1").alias("v"), F.col("line").alias("b")), "v").groupBy("u").agg(F.collect_list(F.struct("v", "b")).alias("others"))
    both = others.join(texts.select(F.col("h1").alias("u"), F.col("line").alias("a")), "u").select("u", "others", _once(a=F.array_distinct(_hashes(F.col("a")))))
    hashes = both.select("u", "a", F.inline("others")).select("u", "v", "a", _once(b=_hashes(F.col("b"))))
    met = hashes.select("u", "v", "a", "b", _once(both=F.size(F.array_intersect("a", "b")))).filter(F.col("both") / F.size("a") >= threshold)  # the union is as large as a at least
    alike = met.select("u", "v", _once(similarity=F.col("both") / F.size(F.array_union("a", "b"))))
    return alike.filter(F.col("similarity") >= threshold)


def _hashes(line: Column) -> Column:
    """The hashes of a line's shingles, repeated ones too."""
    wide = F.array(F.encode(line, "UTF-32"))
    places = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - 4 * WIDTH + 1), F.lit(4))
    return F.transform(wide, lambda b: F.transform(places(b), lambda at: F.xxhash64(F.substring(b, at, 4 * WIDTH))))[0]


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with more ``links`` (u, v) between the nodes of ``roots``, or lines that had no link before."""
    for x in ("u", "v"):
        links = links.join(roots.select(F.col("node").alias(x), "root"), x, "left").withColumn(x, F.coalesce("root", x)).select("u", "v")
    more = common.cut(connected_components(links))
    both = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return common.cut(both.unionByName(more.join(roots.select("node"), "node", "left_anti")))


def alike(lines: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of all lines that have a link: the component of each hash of a line, named by its smallest."""
    rows = shared_bands(signed)
    nodes = common.cut(rows.select("h1").distinct())
    texts = common.cut(lines.select("h1", "line").join(_small(nodes), "h1", "left_semi").dropDuplicates(["h1"]))
    pairs = common.cut(candidates(rows))
    roots = common.cut(connected_components(similar_lines(texts, pairs, threshold).select("u", "v")))
    more = common.cut(apart(rows, roots, texts, threshold))
    return roots if more.isEmpty() else _joined(roots, more)


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, line_no, class_doc_id, class_line_no, n_members, kept) for each line of each document.

    The class is named by its first line, the only one that is kept; n_members is the number of its
    lines, equal ones included. Blank lines are classes of their own and kept. A null text has no
    lines; a null id sorts first; repeated rows count once.
    """
    lines = lines_of(docs.select("doc_id", "text"))
    places = common.cut(lines.select("doc_id", "text_hash", "line_no", F.when(F.col("line") != "", F.col("h1")).alias("h1"), "h2"))
    roots = alike(lines, signatures(lines), threshold)
    place = F.struct("doc_id", "line_no", "text_hash")
    # equal lines are one before they meet their class, so that a common line is no skewed key
    own = places.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    own = common.cut(own.join(_small(common.cut(roots)).withColumnRenamed("node", "h1"), "h1", "left"))
    classes = own.filter("root is not null").groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n_members"))
    named = own.filter("root is not null").select("h1", "h2", "root", "n").join(classes, "root").select("h1", "h2", "n", "first", "n_members")
    named = common.cut(named.unionByName(own.filter("root is null and n > 1").select("h1", "h2", "n", "first", F.col("n").alias("n_members"))))
    least = max(1.0, HOT_SHARE * places.count())
    hot = F.broadcast(named.filter(F.col("n") >= least).drop("n").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", "n_members"))  # at most 1 / HOT_SHARE rows
    met = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    common_lines = places.join(hot, met).drop("g1", "g2")
    others = places.join(hot.select("g1", "g2"), met, "left_anti").join(named.filter(F.col("n") < least).drop("n"), ["h1", "h2"], "left")
    found = common_lines.unionByName(others.select(common_lines.columns))
    return found.select(
        "doc_id", "text_hash", "line_no",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"),
        F.coalesce("n_members", F.lit(1)).cast("long").alias("n_members"),
        (F.col("first").isNull() | (F.col("first") == place)).alias("kept"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that aren't kept; all columns stay, and n_chars, if there, follows the text.

    A document that loses every line with content goes; a null or blank text stays as it is.
    """
    lost = line_classes(docs, threshold).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("line_no", "kept"))).alias("_lines"))
    lost = lost.filter(F.exists("_lines", lambda x: ~x["kept"])).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.transform("_lines", lambda x: x["kept"]).alias("_kept"))
    own = docs.columns
    _, text_hash = _keys()
    out = docs.withColumn("_text_hash", text_hash).join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.get(F.col("_kept"), i)), "\n")
    out = out.withColumn("_rest", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(rest)).filter(F.col("_kept").isNull() | (F.trim(F.regexp_replace("_rest", r"\s+", " ")) != ""))
    put = {"text": F.col("_rest")} | ({"n_chars": F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_rest")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    return out.select(*[put.get(c, F.col(c)).alias(c) for c in own])


def op2(spark, sf_dir: str) -> DataFrame:
    """The class of every line of every document."""
    return line_classes(common.table(spark, sf_dir, "documents"))
