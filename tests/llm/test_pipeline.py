from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import minhash, packing, pii, quality
from pulseloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
    before = {r.doc_id: r.text for r in held["in"].collect()}
    model = quality.fit(held["in"], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(held["in"], model).where("predicted = 1").collect()}
    assert {r.doc_id for r in held["quality"].collect()} == good and len(good) < len(before)
    kept = {r.doc_id for r in minhash.near_duplicates(held["quality"]).where("kept").collect()}
    assert {r.doc_id for r in held["near_duplicates"].collect()} == kept and len(kept) < len(good)
    clean = held["personal_data"]
    assert clean.count() == len(kept) and pii.find_personal_data(clean).where("size(base_spans) > 0").count() == 0
    assert held["mixing"].select("doc_id").distinct().count() <= len(kept) and held["mixing"].count() > 0
    packed = held["packing"]
    assert packed.select("doc_id", "piece").distinct().count() >= held["mixing"].select("doc_id").distinct().count()
    assert packed.groupBy("bin_id").sum("tokens").where(f"`sum(tokens)` > {packing.CAPACITY}").count() == 0


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries()] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(oracle_sql()) <= set(queries())


def test_stages_keep_columns_of_any_name(spark, corpus, docs, tmp_path):
    names = ["score", "predicted", "spans", "base_spans", "_email", "row", "key", "tie", "bucket", "of", "last", "cut", "epochs", "rest", "size", "taken", "target"]
    wide = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {row[0] for row in corpus} and len(rows) > 40
        assert all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).count() >= len(corpus)
