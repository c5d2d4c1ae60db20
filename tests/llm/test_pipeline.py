import corpus_pipeline
from shelfline.llm import catalog, decontaminate, minhash, secret_scan
from shelfline.llm.common import table


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), before.schema)
        seen[name] = docs
    assert 0 < seen["quality classifier"].count() < table(spark, sf_dir, "documents").count()
    distinct = seen["near-duplicates"]
    assert distinct.count() < seen["quality classifier"].count()
    again = minhash.report(distinct).collect()
    assert all(r.keep for r in again)
    unseen = seen["decontamination"]
    assert not any(r.contaminated for r in decontaminate.report(unseen, table(spark, sf_dir, "benchmark")).collect())
    assert unseen.count() == len([r for r in decontaminate.report(distinct, table(spark, sf_dir, "benchmark")).collect() if not r.contaminated])
    masked = seen["secret scan"]
    assert masked.count() == unseen.count()
    assert all(r.spans == "" for r in secret_scan.report(masked).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == masked.count() and all(r.taken <= 2 * r["size"] for r in last.collect())


def test_run_is_the_registered_query(spark, sf_dir):
    assert catalog.queries()["pipeline"](spark, sf_dir).columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    names = [n for n in catalog.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_reruns_agree_whatever_the_partitions(spark, tmp_path):
    """Null ids, repeated rows and columns with the operators' own names: three partitionings give one result."""
    text = lambda k: " ".join(f"word{(k * 7 + i * i) % 83}" for i in range(40))
    rows = [(k, text(k), "en", f"s{k % 3}", 100, 1, "x") for k in range(40)] + [(None, text(k), "en", None, 100, 2, "y") for k in range(50, 60)]
    rows += rows[:10] + [(3, text(3), "en", "other", 100, 9, "z"), (None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (77, "", "en", "s0", 0, 0, "e")]
    spec = "doc_id long, text string, lang string, source string, n_chars long, node long, row string"
    found = set()
    for n in (1, 3, 8):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, spec).repartition(n).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(k, k % 4 > 0, 0) for k in range(40)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "int(quality) quality", "toxic").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "word1 word2")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        found.add(str(sorted(map(str, corpus_pipeline.run(spark, str(folder)).collect()))))
    assert len(found) == 1
