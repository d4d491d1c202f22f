"""The batch jobs one after another on a small data set."""

from pyspark.sql import functions as F

from inkgauge.plans import jobs
from inkgauge.session import work_path
from inkgauge.sources import sinks


def test_jobs_from_raw_tables_to_reports(spark, sf_dir):
    root = work_path(spark, "jobs")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    raw = documents.join(labels, "doc_id").select(F.col("text").alias("content"), F.col("quality").alias("label"))
    sinks.write_table(raw, f"{root}/raw")
    sources = [
        jobs.Source("documents", f"{root}/raw"),
        jobs.Source("news", f"{root}/missing", generate_seeds=120),
    ]
    gate = jobs.build_dataset(spark, sources, f"{root}/data").first()
    assert gate.status == "warn" and 0 < gate.synthetic_fraction < 1
    rows = jobs.load_dataset(spark, f"{root}/data")
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}
    assert {r.source for r in rows.select("source").distinct().collect()} == {"documents", "news_synthetic"}

    assert jobs.baseline_scorer(spark, f"{root}/model") is None
    trained = jobs.train_baseline(spark, f"{root}/data", f"{root}/model", k=300).first()
    assert 0 <= trained.f1 <= 1
    baseline = jobs.baseline_scorer(spark, f"{root}/model")

    def always_ai(df):
        return df.withColumns({"pred": F.lit(1), "prob": F.lit(0.9)})

    known = rows.where(F.crc32("row_id") % 4 > 0)
    vectors = known.select("row_id", F.array(F.log1p("perplexity"), F.col("burstiness"), F.lit(0.5)).alias("embedding"))
    trained = jobs.train_hybrid(spark, f"{root}/data", vectors, f"{root}/network", 3, hidden=(4,), max_iter=20).first()
    assert trained.model == "hybrid" and 0 <= trained.f1 <= 1
    read_csv = spark.read.options(header=True, inferSchema=True).csv
    assert sum(r.rows for r in read_csv(f"{root}/network/without_vector").collect()) == rows.count() - known.count()
    assert spark.read.json(f"{root}/network/training_results").first().f1 == trained.f1
    network = jobs.hybrid_scorer(f"{root}/network", vectors)

    scorers = {"baseline": baseline, "hybrid": always_ai, "network": network}
    result = jobs.evaluate(spark, f"{root}/data", scorers, f"{root}/results")
    by_model = {r.model: r for r in result.collect()}
    assert by_model["hybrid"].recall == 1.0 and by_model["hybrid"].roc_auc == 0.5
    robust = spark.read.options(header=True, inferSchema=True).csv(f"{root}/results/robustness")
    assert robust.where("model = 'hybrid'").first().edited_f1 == 1.0
    compared = {r.metric: r for r in read_csv(f"{root}/results/model_comparison").collect()}
    assert compared["recall"].hybrid == 1.0 and compared["f1"].network is not None
    better = "hybrid_better" if compared["f1"].hybrid > compared["f1"].baseline else "baseline_better"
    verdict = spark.read.json(f"{root}/results/verdict").first().verdict
    assert verdict == ("tie" if compared["f1"].hybrid == compared["f1"].baseline else better)
    preview = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{root}/results/challenge_preview")
    assert {"hybrid_pred", "hybrid_prob", "baseline_pred", "baseline_prob"} <= set(preview.columns)
    tested = rows.where("split = 'test'").count()
    assert {r.samples for r in spark.read.json(f"{root}/results/evaluation_results").collect()} == {tested}

    sinks.write_table(spark.createDataFrame([("A text. And more text here!",), ("A text. And more text here!",), (None,)], "text string"), f"{root}/batch")
    language_model = sinks.load_ngram(spark, f"{root}/data/language_model")
    scored = jobs.score_files(spark, f"{root}/batch", baseline, language_model, f"{root}/scored", fmt="parquet")
    rows = scored.collect()
    assert len(rows) == len({r.row_id for r in rows}) == 3
    assert sum(r.label is None for r in rows) == 1
    assert len({(r.probability, r.interpretation) for r in rows if r.label}) == 1

    # a text scores the same in any batch, and each row keeps its key
    batch = [("x", "A text. And more text here!", 1), ("y", "Some other words. They are new.", 2), ("z", None, 3)]
    sinks.write_table(spark.createDataFrame(batch, "id string, text string, label int"), f"{root}/keyed")
    keyed = jobs.score_files(
        spark, f"{root}/keyed", baseline, language_model, f"{root}/scored2", fmt="parquet", key="id", keep=("label",)
    )
    by_id = {r.row_id: r for r in keyed.collect()}
    assert [by_id[i]._label for i in "xyz"] == ["1", "2", "3"] or [by_id[i]._label for i in "xyz"] == [1, 2, 3]
    alone = next(r for r in rows if r.label)
    assert (by_id["x"].probability, by_id["x"].perplexity) == (alone.probability, alone.perplexity)
    assert by_id["z"].probability is None
