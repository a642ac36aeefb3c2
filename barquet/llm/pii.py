"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A span's place follows from the lengths of the texts between matches
(``split`` and ``regexp_extract_all`` walk a text alike), in code points, end exclusive.

Kinds: email, ip, card, phone and iban. Matches of a kind are leftmost and don't overlap; one that
fails its check is dropped and its text not tried again. The patterns are the plain ones, written
so that Java's matcher neither recurses nor rescans long runs: possessive where nothing after
could give back, and the email's local part only tried from where a run of its characters begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: kind: (pattern, characters of which a text must hold one).
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", ""),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and words near it that raise or lower that.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
# fixed values: context words
RAISE = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login|client",
    "card": "card|visa|credit|debit|payment|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|cell|sms|telefon|móvil",
    "iban": "iban|bank|account|transfer|konto|cuenta|compte",
}
LOWER = {"email": "example|noreply", "ip": "version|release|build|section", "card": "order|isbn|serial|tracking|invoice", "phone": "isbn|version|serial", "iban": "serial|part"}
#: Characters before a span (and after the one before it) in which its context words count, and what one of them changes.
NEAR, STEP = 40, 0.15
_CHUNK = 256


def _running(values: Column) -> Column:
    """Inclusive running sums of an array, in chunks, so that long arrays aren't copied for every element."""
    zero = F.lit(0).cast("long")
    n = F.ceil(F.size(values) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK))
    bases = F.aggregate(chunks, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(x, zero, lambda a, y: a + y))))
    sums = F.zip_with(chunks, F.slice(bases, 1, n), lambda x, base: F.slice(F.aggregate(x, F.array(base), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y))), 2, _CHUNK))
    return F.flatten(sums)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """The remainder of an account number whose first four characters went to its end, letters as 10 to 35."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _scored(kind: str, before: Column) -> Column:
    word = lambda words: F.lower(before).rlike(rf"\b(?:{words})").cast("double")
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORES[kind]) + STEP * word(RAISE[kind]) - STEP * word(LOWER[kind]))), 2)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` and a column ``pii``: array of (kind, start, end, score), by kind as listed and then start.

    A null or empty text has none. A column named ``pii`` is replaced; others stay.
    """
    own = [c for c in docs.columns if c != "pii"]
    out = docs.select(*own, F.coalesce("text", F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    out = out.select("*", *[F.when(F.contains("_text", F.lit(need)) if need else F.lit(True), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k, (p, need) in PATTERNS.items()])
    hit = lambda gap, m: F.when(m.isNotNull(), F.struct(F.substring(gap, -NEAR, NEAR).alias("before"), m.alias("match"), (F.length(gap) + F.length(m)).cast("long").alias("step")))
    found = {k: F.when(F.size(f"_m_{k}") > 0, F.filter(F.zip_with(F.split("_text", p, -1), f"_m_{k}", hit), lambda x: x.isNotNull())) for k, (p, _) in PATTERNS.items()}
    out = out.select(*own, *[x.alias(f"_h_{k}") for k, x in found.items()])
    out = out.select("*", *[_running(F.transform(f"_h_{k}", lambda x: x["step"])).alias(f"_e_{k}") for k in PATTERNS])

    def spans(kind: str) -> Column:
        pairs = F.zip_with(f"_h_{kind}", f"_e_{kind}", lambda x, e: F.when(confirmed(kind, x["match"]), F.struct(F.lit(kind).alias("kind"), (e - F.length(x["match"])).alias("start"), e.alias("end"), _scored(kind, x["before"]).alias("score"))))
        return F.coalesce(F.filter(pairs, lambda x: x.isNotNull()), F.array())

    return out.select(*own, F.concat(*[spans(k) for k in PATTERNS]).alias("pii"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kinds(*kinds: str) -> Column:
    return F.filter("pii", lambda x: x["kind"].isin(*kinds))


def op4(spark, sf_dir: str) -> DataFrame:
    """Counts, places and scores of the personal data in every document."""
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    counts = [F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(joined(_of_kinds(*BASE)), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores)
