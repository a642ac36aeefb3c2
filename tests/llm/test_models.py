import random

from pyspark.sql import functions as F

from barquet.llm import language_id, licences, toxicity


def plain_bits(tree, text):
    """Code length byte by byte."""
    data, total = language_id.PAD + text, 0.0
    counts = {}
    for gram, n in tree.items():
        for k in range(4):
            ctx, sym = gram[3 - k : 3], gram[3]
            counts.setdefault(ctx, {}).setdefault(sym, 0)
            counts[ctx][sym] += n
    import math

    for i in range(3, len(data)):
        for k in range(3, -1, -1):
            own = counts.get(bytes(data[i - k : i]))
            if own is None:
                continue
            n, q = sum(own.values()), len(own)
            if data[i] in own:
                total -= math.log2(own[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(monkeypatch):
    import numpy as np

    train = b"the cat sat on the mat and the hat " * 3
    grams = {}
    data = language_id.PAD + train
    for i in range(3, len(data)):
        grams[data[i - 3 : i + 1]] = grams.get(data[i - 3 : i + 1], 0) + 1
    tree = language_id.ContextTree(np.array([int.from_bytes(g, "big") for g in grams]), np.array(list(grams.values())))
    model = language_id.Model({"en": tree})
    texts = [b"the rat sat", b"", b"zzz\xff", b"the cat sat on the mat and the hat " * 40, b"a"]
    bounds = np.cumsum([0, *map(len, texts)])
    for block in (1 << 20, 100):
        monkeypatch.setattr(language_id.common, "BLOCK_BYTES", block)
        got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), bounds)[:, 0]
        want = [plain_bits(grams, t) for t in texts]
        assert np.allclose(got, want, rtol=1e-5), (got, want)


def test_language_held_out_and_edges(spark, sf_dir):
    got = language_id.op7(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    rows = [(k, "the old house on the hill was very quiet " * 3, "en") for k in range(9)] + [(20 + k, "das alte haus auf dem berg war sehr still " * 3, "de") for k in range(9)] + [(50, None, "en"), (51, "123 !", "en"), (52, "", None), (None, "das haus ist still", None), (53, "still " * 300_000, "de")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, lang_score double")
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(df, language_id.train(df)).collect()}
    assert [out[k][0] for k in (0, 20, 50, 51, 52, None, 53)] == ["en", "de", "und", "und", "und", "de", "de"] and out[50][1] == 0
    empty = df.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert language_id.identify(df, language_id.train(empty)).filter("lang_pred != 'und'").count() == 0


def test_toxicity_held_out_and_edges(spark):
    r = random.Random(0)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for d in range(400):
        own = [r.choice(words) for _ in range(60)]
        bad = d % 5 == 0
        if bad:
            own[7] = r.choice(["vilest", "vilely", "horridest", "horridly"])
        rows.append((d, " ".join(own)))
        labels.append((d, int(bad)))
    rows += [(900, None), (901, ""), (None, "vilest thing"), (902, "w1 " * 100_000 + "vilest")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (901, None)], "doc_id long, toxic int")
    train = lab.filter("doc_id % 2 = 0")
    model, vectors = toxicity.train(docs, docs, train)
    got = {x.doc_id: x for x in toxicity.score(vectors, model).collect()}
    assert len(got) == len({d for d, _ in rows})
    wrong = [d for d, y in labels if d % 2 and (got[d].score >= toxicity.PREDICT) != bool(y)]
    assert not wrong
    assert got[900].score < 0.5 > got[901].score and got[None].score > 0.7 < got[902].score
    model, vectors = toxicity.train(docs, docs, lab.limit(0))
    assert toxicity.score(vectors, model).filter("score > 0").count() == 0


def test_licence_rules(spark):
    texts = {rule: text for rule, _, text in licences.RULES}
    mit = "\n".join(x.capitalize() + "." for x in licences.sentences_of(texts["mit-text"]))
    wrapped = mit.replace(" software ", "\nsoftware ")
    rows = [(1, f"Hello.\n{mit}\nBye."), (2, wrapped), (3, "\n".join(reversed(mit.split("\n")))), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0."), (7, "word. " * 50_000 + "Licensed under the Apache License, Version 2.0.")]
    got = sorted(((r.doc_id, r.rule) for r in licences.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "mit-text"), (2, "mit-text"), (4, "mit-notice"), (None, "cc-by-nc-notice"), (7, "apache-notice")], key=str)
    assert licences.matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT
"""
CLAUSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS"""


def test_published_licence_texts(spark):
    noisy = "*" * 1500 + " Licensed under the MIT License. " + "-" * 1500
    rows = [(1, APACHE, 0), (2, GPL, 0), (3, GPL.replace("This program is distributed", "All rights reserved. This program is distributed"), 0), (4, BSD, 0), (5, BSD.replace("THIS", CLAUSE), 0), (6, noisy, 0), (7, GPL.replace("This program is distributed", "One. " * 9 + "This program is distributed"), 0), (8, GPL + "\n" + GPL, 0)]
    got = {(r.doc_id, r.rule, r.n) for r in licences.matches(spark.createDataFrame(rows, "doc_id long, text string, rule int")).collect()}
    assert got == {(1, "apache-header", 1), (2, "gpl3-header", 1), (3, "gpl3-header", 1), (4, "bsd-2-text", 1), (5, "bsd-2-text", 1), (5, "bsd-3-clause", 1), (6, "mit-notice-2", 1), (8, "gpl3-header", 2)}


def test_licence_query_equals_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    wanted = sorted(db.sql(licences.oracle_sql()).fetchall())
    assert wanted and sorted((r.doc_id, r.licence, r.rule, r.n) for r in licences.op10(spark, sf_dir).collect()) == wanted


def test_toxicity_of_repeated_texts_and_opposite_labels(spark):
    rows = [(k, t, None) for k, t in enumerate(["vile words here", "calm words here"] * 30)] + [(3, "calm words here", None)]
    labels = [(k, int(k % 2 == 0)) for k in range(60)] + [(1, 1), (2, 0)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    examples, classes = toxicity.examples_of(docs, lab)
    assert {(r.doc_id, r.toxic) for r in examples.collect()} == {(0, 1), (1, 1)}  # one example a text; both labels mean toxic
    assert sum(classes.values()) == 60
    one, two = (sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(v, m).collect()) for m, v in (toxicity.train(docs, docs, lab), toxicity.train(docs.repartition(3), docs, lab.repartition(2))))
    assert one == two and len(one) == len(rows)


def test_toxicity_with_labels_of_one_class(spark):
    docs = spark.createDataFrame([(k, f"some words {k % 3} here and there") for k in range(12)], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(k, y) for k in range(6)], "doc_id long, toxic int")
        model, vectors = toxicity.train(docs, docs, labels)
        got = {round(r.score, 6) for r in toxicity.score(vectors, model).collect()}
        assert len(got) == 1 and (got.pop() >= toxicity.PREDICT) == bool(y)


def test_toxicity_with_a_term_in_every_example(spark):
    rows = [(k, f"common {'vile nasty' if k % 2 else 'kind gentle'} {k}") for k in range(60)]
    docs = spark.createDataFrame(rows + [(100, "vile nasty"), (101, "kind gentle"), (102, "nothing known")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    model, vectors = toxicity.train(docs, docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(vectors, model).collect()}
    assert got[100] >= toxicity.PREDICT > got[101] and got[102] < toxicity.PREDICT
