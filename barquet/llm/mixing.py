"""Mixing sources to target weights: a low-discrepancy schedule over shuffled blocks of equal tokens.

Each source's documents, in an order that a digest of their ids shuffles, make one stream of words,
which may be gone through twice. The stream up to the source's target is cut into blocks of ``BLOCK``
words. The mix has a slot for each block: slot n looks up the golden ratio's n-th point among the sources'
cumulative shares, and a source's slots, ranked, take its blocks in turn, so that any stretch of the mix
holds the sources near their weights. The points miss a share by a few blocks at most. Slots of a source
that has no block left are passed over, and the few blocks that found no slot end the mix, so that each
source gives its target to the word.

Running sums are taken in two steps, within some square root of n buckets and over the buckets, so no
task holds a source or the schedule. One row a source passes a single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Words of a block.
BLOCK = 2048
#: Weights of the sources in order, repeating; the mix's size and a source's most, as multiples of the input.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which one row for each goes to all tasks.
SOURCES = 50_000
#: Digests of ids lie below this.
_KEYS = 1 << 60
# the golden ratio's share of a turn, in points of a lattice: each is met once in _TURN slots
_TURN, _STEP = 1 << 31, 1_327_217_885


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _broadcast(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SOURCES else table


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, docs) with place, weight, target, quota (whole words) and the number of blocks.

    Targets are a level times the weight, stopped at ``most`` times the source's size; the level is the one at which
    they sum to ``total`` times all sizes. Of the sources in order of size by weight, those before the first that
    stays under its bound are stopped.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("place", F.row_number().over(by) - 1)
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    bound = F.col("source_size").cast("double") * most
    order, everything = Window.orderBy(bound / F.col("weight"), "place"), Window.partitionBy()
    stopped = F.coalesce(F.sum(bound).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_level", (F.sum("source_size").over(everything) * total - stopped) / rest)
    df = df.withColumn("_first", F.when(F.col("_level") * F.col("weight") <= bound, F.struct(bound / F.col("weight"), "place", "_level")))
    level = F.min("_first").over(everything)["_level"]
    df = df.withColumn("target", F.coalesce(F.least(bound, level * F.col("weight")), bound))
    quota = F.least(F.floor(F.col("target") + 0.5), bound.cast("long"))
    df = df.withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("quota") / BLOCK))
    return df.withColumn("first", F.coalesce(F.sum("blocks").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_level", "_first")


def schedule(sources: DataFrame, slots: int, places: int) -> DataFrame:
    """(place, block, slot) of ``sources`` (place, blocks, first), ``slots`` being the sum of their blocks.

    Sources meet the points in cells of the unit interval, so many sources cost no more comparisons a slot.
    """
    spark, cells = sources.sparkSession, 4 * max(1, places)
    turn = F.pmod(F.col("id") % _TURN * _STEP, F.lit(_TURN)) / _TURN
    points = spark.range(slots).select(F.col("id").alias("slot"), turn.alias("_u"), F.floor(turn * cells).alias("_cell"))
    low, high = F.col("first") / slots, (F.col("first") + F.col("blocks")) / slots
    spans = sources.filter("blocks > 0").select("place", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.floor(low * cells), F.floor(high * cells))).alias("_cell"))
    met = points.join(_broadcast(spans, places), "_cell").filter((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))).select("slot", "place")
    chunk = max(1, math.isqrt(slots))
    met = met.withColumn("_chunk", F.floor(F.col("slot") / chunk))
    counts = met.groupBy("place", "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select("place", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("place").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("place", "_chunk").orderBy("slot")) - 1
    ranked = met.join(before, ["place", "_chunk"]).select("place", rank.alias("block"), "slot")
    own = sources.select("place", "blocks")
    found = ranked.join(_broadcast(own, places), "place").filter("block < blocks").select("place", "block", "slot")
    left = own.join(counts.groupBy("place").agg(F.sum("_n").alias("_n")), "place", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("_n < blocks")
    ends = left.select("place", F.explode(F.sequence(F.col("_n"), F.col("blocks") - 1)).alias("block")).withColumn("slot", F.lit(slots) + F.col("block"))
    return found.unionByName(ends)


def _known(docs: DataFrame, sources: DataFrame, places: int) -> DataFrame:
    known = _broadcast(sources.select(F.col("source").alias("_source"), "place", "source_size", "docs", "target", "quota", "blocks"), places)
    return docs.join(known, docs["source"].eqNullSafe(F.col("_source"))).drop("_source")


def _placed(docs: DataFrame, sources: DataFrame, places: int, carry: list[str]) -> DataFrame:
    """``docs`` (doc_id, source, size, key) with their source's columns and ``begin``, the words of the source before them."""
    df = _known(docs, sources, places)
    buckets = F.ceil(F.sqrt("docs"))
    df = df.withColumn("_bucket", F.least(F.floor(F.col("key") / _KEYS * buckets), buckets - 1))
    sums = df.groupBy("place", "_bucket").agg(F.sum("size").alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("place").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(sums.select("place", "_bucket", before.alias("_before")), ["place", "_bucket"])
    within = Window.partitionBy("place", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return df.select("doc_id", "source", "size", "place", "source_size", "target", "quota", "blocks", begin.alias("begin"), *carry)


def _pieces(placed: DataFrame) -> DataFrame:
    """A row for each block of either pass that a document shares; one with length null if it shares none."""
    df = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    df = df.withColumn("_at", F.col("begin") + F.col("turn") * F.col("source_size")).filter((F.col("turn") == 0) | (F.col("_at") < F.col("quota")))
    first = F.floor(F.col("_at") / BLOCK)
    last = F.least(F.floor((F.col("_at") + F.col("size") - 1) / BLOCK), F.col("blocks") - 1)
    df = df.withColumn("block", F.explode(F.sequence(first, F.greatest(first, last))))
    low = F.greatest(F.col("_at"), F.col("block") * BLOCK)
    length = F.least((F.col("block") + 1) * BLOCK, F.col("_at") + F.col("size"), F.col("quota")) - low
    return df.withColumns({"start": low - F.col("_at"), "at": low - F.col("block") * BLOCK, "length": F.when(length > 0, length)}).drop("_at")


def prepared(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pieces of documents with their slots (null for those that the mix leaves), and documents without words."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sized = common.cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.col(text)).alias("size"), key.alias("key"), *[F.col(c).alias(f"_{c}") for c in carry]))
    sources = common.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))))
    places, slots = sources.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    pieces = _pieces(_placed(sized.filter("size > 0"), sources, places, [f"_{c}" for c in carry]))
    if slots:
        pieces = pieces.join(schedule(sources.select("place", "blocks", "first"), slots, places), ["place", "block"], "left")
    else:
        pieces = pieces.withColumn("slot", F.lit(None).cast("long"))
    return pieces, _known(sized.filter("size = 0"), sources, places)


def mix(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text): (slot, source, block, at, doc_id, turn, start, length, words, carried columns).

    A row is a stretch of a document's words (from word ``start``) that stands ``at`` words into the block of a slot;
    sorted by slot, source and at, the rows are the mix. ``turn`` counts the passes, ``words`` is the text.
    Null and empty texts have no words and no row; a null source is one of its own, the last; a null id is as
    good as any; repeated rows count each. Documents of one id are taken in order of their sizes.
    """
    carry = tuple(dict.fromkeys((*carry, text)))
    pieces, _ = prepared(docs, carry, text)
    taken = pieces.filter("slot is not null and length is not null")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_{text}"), F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
    more = [F.col(f"_{c}").alias(c) for c in carry if c not in ("doc_id", "source", text)]
    return taken.select("slot", "source", "block", "at", "doc_id", "turn", "start", "length", words.alias("words"), *more)


def taken(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row for each row of ``docs``, with the words that the mix takes."""
    pieces, empty = prepared(docs, text=text)
    by = pieces.groupBy("place", "begin").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("length"))), F.lit(0)).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return by.select(columns).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(columns))


def op11(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return taken(common.table(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint k
  from documents
),
s0 as (select source, sum(size)::bigint s, row_number() over (order by source nulls last) - 1 i from d group by 1),
s1 as (select *, (case i % 3 when 0 then 3 when 1 then 1 else 2 end)::double w, s::double * {MOST} b from s0),
s2 as (
  select *, (sum(s) over () * {TOTAL}::double - coalesce(sum(b) over (order by b / w, i rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by b / w, i rows between current row and unbounded following) l
  from s1
),
s3 as (select source, s, b, coalesce(least(b, w * (select arg_min(l, row(b / w, i)) from s2 where l * w <= b)), b) target from s2),
p as (
  select d.*, s3.s, target, least(floor(target + 0.5), b)::bigint q,
    coalesce(sum(size) over (partition by d.source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint a
  from d join s3 on d.source is not distinct from s3.source
)
select doc_id, size, s source_size, target, greatest(0, least(size, q - a)) + greatest(0, least(size, q - s - a)) taken from p
"""
