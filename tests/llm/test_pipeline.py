import corpus_pipeline
from barquet.llm import decontaminate, packing, simhash


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.common.cut(stage(spark, seen[-1], sf_dir)))
        assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True))
    assert len(ids[1]) >= 0.98 * len(ids[0])  # clean documents stay
    near = simhash.near_duplicates(seen[3])
    assert near.filter("doc_id != component_id").count() == 0
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.leaks(seen[3], items).count() > 0 == decontaminate.leaks(seen[4], items).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir)
    lengths = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    encode = packing.Encoder(packing.vocabulary_path)
    assert lengths == {r.doc_id: len(encode(r.text or "")) + 1 for r in seen[4].collect()}


def test_empty_documents(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path, sf_dir):
    """Rows without a text or a letter go with the first stage; a null id, repeats and names that stages use inside don't trouble any."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = docs.filter(F.length("text") > 400).orderBy("doc_id").first()
    extra = [(9001, None, one.lang), (9002, "", one.lang), (9003, "12 34 !", None), (None, one.text + " of no id", one.lang), (9005, (one.text + " ") * 60, one.lang), (9006, one.text, None), (9006, one.text, None)]
    rows = spark.createDataFrame([(i, t, lang, "x", len(t or "")) for i, t, lang in extra], docs.schema)
    clash = {"lang_pred": F.lit("zz"), "score": F.lit(1.5), "component_id": F.lit(-1), "fingerprint": F.lit("f"), "item_id": F.lit(7), "line": F.lit(0), "sequence_id": F.lit(3)}
    docs.unionByName(rows).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.common.cut(stage(spark, seen[-1], str(tmp_path))))
        assert seen[-1].columns == seen[0].columns
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in seen]
    assert not {9001, 9002, 9003} & set(ids[1]) and {9005, 9006, None} <= set(ids[1])
    assert ids[3].count(9006) <= 1  # copies of one text: one stays
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids[-1])
