from __future__ import annotations

import corpus_pipeline
from millrace.llm import decontamination, mixture, repetition, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash", "decontamination", "mixture"]
    rows = {r.doc_id: r for r in docs.collect()}

    def after(keep):
        return spark.createDataFrame([rows[i] for i in sorted(keep)], docs.schema)

    keep = {r.doc_id for r in repetition.quality_rules(docs).collect() if r.kept}
    model = toxicity.fit(after(keep), labels)
    keep = {r["doc_id"] for r in toxicity.tag(after(keep), model).collect() if r["__score"] < 0.5}
    keep = {r.component_id for r in simhash.near_duplicates(after(keep)).collect()}
    keep -= {r.doc_id for r in decontamination.leaks(after(keep), benchmark).collect()}
    want = {r.doc_id: r.taken for r in mixture.mix(after(keep), preference=mixture.by_length).collect() if r.copies}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.taken for r in got} == want
    assert all(r.text == rows[r.doc_id].text for r in got)


def test_all_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


CLASHES = ("__score", "__items", "__kept", "__fp", "__root", "__spans", "copies", "size", "taken", "target", "source_size", "kept_0", "key")


def test_odd_rows_and_clashing_columns_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = docs.orderBy("doc_id").limit(60)
    odd = [
        (None, None, None, None, None), (9001, None, "en", "a", 0), (9002, "", None, None, 0), (9003, " \n\t", "en", "a", 3),
        (None, "a text without an id that has more than ten words in it", "en", None, 50), (9004, "long " + " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1),
    ]
    rows = first.unionByName(first.limit(5)).unionByName(spark.createDataFrame(odd, docs.schema))
    for name in CLASHES:
        rows = rows.selectExpr("*", f"concat('{name}', doc_id) AS `{name}`")
    folder = tmp_path / "sf"
    rows.write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    stored = spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stored, str(folder))
        assert out.columns == stored.columns
        assert out.where("doc_id = 9004").count() == 1, name
        assert out.where("doc_id is not null and __fp <> concat('__fp', doc_id)").count() == 0
    out = corpus_pipeline.run(spark, str(folder))
    assert out.columns[: len(stored.columns)] == stored.columns
    got = out.collect()
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in got}
    assert all(r["copies"] in (None, f"copies{r['doc_id']}") and r["copies_"] >= 1 for r in got)
