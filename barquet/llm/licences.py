"""Licence scans by sentence rules.

A text's sentences are normalised (lower case, letters and digits, single spaces) and those in the
dictionary become identifiers. A rule is a sequence of identifiers; it matches where they stand in
the text in its order, with at most ``GAP`` other sentences, known or not, between two of them.
Sentences without a letter (numbering) don't count. Texts are read twice, with line ends as ends
of sentences and as blanks, as licences may be wrapped. The dictionary is made of the rules' own
texts, which are taken apart like any other text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GAP = 3

# fixed values: (rule, licence, the licence's sentences as published, in order)
RULES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-notice-2", "MIT", "Licensed under the MIT License."),
    ("mit-text", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-header-2", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License version 3."),
    ("gpl3-header", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-text", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-notice", "CC0-1.0", "Released under CC0 1.0."),
    ("bsd-2-text", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", "BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]


def sentences_of(text: str) -> list[str]:
    """Normal forms of a rule's sentences; the same steps as ``_sentences`` and ``_normal``."""
    parts = re.split(r"\n+", re.sub(r"([.!?:;])[ \t\r\n]+", "\\1\n", text))
    return [x for x in (re.sub(r"[^a-z0-9]+", " ", part.lower()).strip() for part in parts) if re.search("[a-z]", x)]


def _sentences(text: Column) -> Column:
    """The sentences that have a letter."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?:;])[ \t\r\n]+", "$1\n"), r"\n+"), lambda x: x.rlike(r"\p{L}"))


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def matches(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """(doc_id, text_hash, licence, rule, n) for each rule that a document matches, n times at most over both readings.

    rules: (rule, licence, text); a rule's own sentences, in order, are its identifiers. A null or
    empty text matches nothing. Repeated rows count once; rows that share an id but not their text
    are told apart by text_hash. Other columns don't matter.
    """
    spark = docs.sparkSession
    steps = [(x, rule, licence, k, len(own)) for rule, licence, text in rules for own in [sentences_of(text)] for k, x in enumerate(own)]
    known = F.broadcast(spark.createDataFrame(steps, "sentence string, rule string, licence string, step int, steps int"))  # the dictionary
    shortest, longest = min(len(x[0]) for x in steps), max(len(x[0]) for x in steps)
    text = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # wrapped: line ends within a sentence are blanks, an empty line ends one; only worth a second look where a line doesn't end a sentence
    wrapped = F.when(F.col("text").rlike(r"[^.!?:;\s]\s*\n"), F.regexp_replace(F.regexp_replace("text", r"\n[ \t\r]*\n", ".\n"), r"([^.!?:;\s])[ \t\r]*\n[ \t]*", "$1 "))
    readings = F.array(F.struct(F.lit(0).alias("reading"), F.col("text").alias("body")), F.struct(F.lit(1).alias("reading"), wrapped.alias("body")))
    rows = text.select("doc_id", "text_hash", F.explode(readings).alias("r")).filter("r.body is not null")
    rows = rows.select("doc_id", "text_hash", "r.reading", F.posexplode(_sentences(F.col("r.body"))).alias("at", "raw"))
    rows = rows.filter(F.length("raw") >= shortest).select("doc_id", "text_hash", "reading", "at", _normal(F.col("raw")).alias("sentence"))
    found = rows.filter(F.length("sentence").between(shortest, longest)).join(known, "sentence").distinct()
    runs = found.groupBy("doc_id", "text_hash", "reading", "rule", "licence", "steps").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("seq"))
    # reached[k]: where the last run of the rule's first k + 1 sentences ended; a run goes on if the next one is near
    far = -(GAP + 2)
    start = F.struct(F.array_repeat(F.lit(far), F.col("steps")).alias("reached"), F.lit(0).cast("long").alias("n"))
    goes_on = lambda state, x: (x["step"] == 0) | (x["at"] - F.get(state["reached"], x["step"] - 1) <= GAP + 1)
    merge = lambda state, x: F.when(
        goes_on(state, x),
        F.struct(F.transform(state["reached"], lambda r, k: F.when(k == x["step"], x["at"]).otherwise(r)).alias("reached"), (state["n"] + (x["step"] == F.col("steps") - 1).cast("long")).alias("n")),
    ).otherwise(state)
    hits = runs.select("doc_id", "text_hash", "licence", "rule", F.aggregate("seq", start, merge, lambda state: state["n"]).alias("n")).filter("n > 0")
    return hits.groupBy("doc_id", "text_hash", "licence", "rule").agg(F.max("n").alias("n"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Licences of every document that has one, by rule."""
    return matches(common.table(spark, sf_dir, "documents")).drop("text_hash")


def oracle_sql(rules: list = RULES) -> str:
    """The same in SQL, for rules of one sentence (others don't occur in the given tables)."""
    single = ", ".join(f"('{sentences_of(text)[0]}', '{rule}', '{licence}')" for rule, licence, text in rules if len(sentences_of(text)) == 1)
    reading = lambda body: f"select doc_id, text, unnest(regexp_split_to_array(regexp_replace({body}, '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+')) raw from documents"
    unwrapped = "regexp_replace(regexp_replace(text, '\\n[ \\t\\r]*\\n', '.' || chr(10), 'g'), '([^.!?:;\\s])[ \\t\\r]*\\n[ \\t]*', '\\1 ', 'g')"
    plain, wrapped = reading("text"), reading(unwrapped)
    return f"""
with rules(sentence, rule, licence) as (values {single}),
s as (select 0 reading, * from ({plain}) union all select 1, * from ({wrapped})),
hit as (
  select doc_id, text, reading, licence, rule, count(*) n
  from s join rules on trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = sentence
  group by all
)
select doc_id, licence, rule, max(n) n from hit group by doc_id, text, licence, rule
"""
