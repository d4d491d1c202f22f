"""Sources, sinks, generation and streams."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inkgauge.operators import decisions, governance, splits, style, tfidf
from inkgauge.operators.cleaning import clean_corpus
from inkgauge.plans.views import add_predictions
from inkgauge.session import work_path
from inkgauge.sources import generate, readers, sinks
from inkgauge.streaming import streams


def test_label_names(spark):
    rows = [(x,) for x in ["Bot", "AI", "machine", "1", "human", "0", None]]
    out = readers.normalise_label(spark.createDataFrame(rows, "label string")).collect()
    assert [r.label for r in out] == [1, 1, 1, 1, 0, 0, 0]
    numbers = spark.createDataFrame([(3,)], "label int")
    assert readers.normalise_label(numbers).first().label == 3


def test_columns_are_found_by_name(spark):
    df = spark.createDataFrame([(1, "t", "bot")], "id int, Tweet string, account_type string")
    assert readers.resolve_columns(df).columns == ["id", "text", "label"]
    odd = spark.createDataFrame([(1, "t", "bot")], "account_id int, content string, kind string")
    assert readers.resolve_columns(odd, label="kind").columns == ["account_id", "text", "label"]
    with pytest.raises(readers.MissingColumns):
        readers.resolve_columns(spark.createDataFrame([(1,)], "id int"))


def test_csv_round_trip(spark):
    path = work_path(spark, "csv")
    rows = [(1, 'He said "no", twice\nand left'), (2, "plain")]
    sinks.write_table(spark.createDataFrame(rows, "doc_id int, text string"), path, "csv")
    back = readers.read_samples(spark, path, "csv", "doc_id int, text string")
    assert sorted(tuple(r) for r in back.collect()) == rows
    with pytest.raises(readers.MissingColumns):
        readers.read_samples(spark, path, "csv", required=("body",))


def test_fallback_only_for_missing_input(spark):
    seeds = spark.range(5).withColumnRenamed("id", "doc_id")
    made = readers.load_or_fallback(spark, "/no/such/path", "news", lambda: generate.fill_templates(seeds))
    assert {r.source for r in made.collect()} == {"news_synthetic"}
    path = work_path(spark, "real")
    sinks.write_table(spark.createDataFrame([("t", "bot")], "tweet string, account string"), path)
    real = readers.load_or_fallback(spark, path, "news", lambda: 1 / 0)
    assert [tuple(r) for r in real.collect()] == [("t", 1, "news")]
    with pytest.raises(AnalysisException):  # a table that is there is never replaced
        readers.load_or_fallback(spark, path, "news", lambda: generate.fill_templates(seeds), keep=("doc_id",))


def test_templates(spark):
    seeds = spark.range(500).withColumnRenamed("id", "doc_id")
    texts = [r.text for r in generate.generate_templates(seeds).collect()]
    assert len(texts) == len(set(texts)) > 50
    assert any("{region}" in t for t in texts)
    assert not any("{topic}" in t for t in texts)
    assert generate.generate_templates(seeds, n=20).count() == 20
    with pytest.raises(ValueError):
        generate.generate_templates(seeds, n=499)


def test_only_the_first_slot_is_filled(spark):
    seeds = spark.range(1).withColumnRenamed("id", "doc_id")
    made = generate.fill_templates(seeds, templates=[(0, "{a} and {a}")], fillers={"a": ["$1\\x"]})
    assert made.first().text == "$1\\x and {a}"
    drawn = generate.fill_templates(spark.range(50).withColumnRenamed("id", "doc_id"), label_first=True)
    assert {r.label for r in drawn.collect()} == {0, 1}


def test_summary_has_no_nan(spark):
    path = work_path(spark, "summary")
    df = spark.createDataFrame([(3, float("nan"), [1.0])], "n int, roc_auc double, history array<double>")
    sinks.write_summary_json(df, path, drop=("history",))
    assert json.loads(spark.read.text(path).first().value) == {"n": 3, "roc_auc": None}


def test_empty_dataset_has_no_synthetic_part(spark):
    empty = spark.createDataFrame([], "source string, label int")
    assert governance.synthetic_fraction(empty).first().synthetic_fraction == 0.0
    assert governance.composition_gate(empty).first().status == "ok"
    assert governance.dataset_metadata(empty).first().total_samples == 0


def test_missing_models(spark):
    assert sinks.load_baseline(spark, "/no/such/model") is None
    with pytest.raises(Exception):
        sinks.load_hybrid("/no/such/model")


def _files(spark, rows, schema, name, files):
    path = work_path(spark, name)
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return path


def test_stream_scores_like_a_batch(spark):
    schema = "doc_id long, text string"
    rows = [(i, f"Some text number {i}. " + "More words follow here. " * (i % 5)) for i in range(40)]
    path = _files(spark, rows, schema, "in", 4)

    def score(df):
        feats = style.scaled_stats(style.skip_perplexity(style.add_sentence_features(df)))
        return decisions.score_batch(add_predictions(feats), "prob_a")

    out = work_path(spark, "out")
    stream = streams.stream_samples(spark, path, spark.read.parquet(path).schema, max_files=1)
    streams.stream_score(stream, score, f"{out}/rows", f"{out}/state").awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    assert got.select("batch").distinct().count() > 1
    batch = score(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, batch.collect()))


def _first_copies(rows, keep):
    """(doc_id, at, text) of the first copies, and the time of the last copy of each run."""
    runs = {}
    for i, text, at in sorted(rows, key=lambda r: (r[2], r[0])):
        of_text = runs.setdefault(text, [])
        if of_text and at < of_text[-1][1] + keep:
            of_text[-1][1] = at
        else:
            of_text.append([(i, at, text), at])
    return [(tuple(first), last) for of_text in runs.values() for first, last in of_text]


def test_first_copies_out_of_order_late_and_restarted(spark):
    def text(k):
        return f"a text that is repeated, of number {k}"

    schema, delay, keep = "doc_id long, text string, at long", 100, 50
    batches = [
        [(1, text(1), 1000), (2, text(1), 960), (3, text(2), 1000), (4, "short", 1000), (5, None, 1000), (6, text(9), None)],
        [(11, text(1), 940), (12, text(3), 1030), (13, text(2), 1060), (14, text(1), 1075), (15, text(3), 1030)],  # out of order
        [(21, text(4), 1400), (22, text(1), 1130)],
        [(31, text(1), 1299), (32, text(5), 1250), (33, text(4), 1301)],  # behind the watermark of 1300, one by `keep`
        [(41, text(6), 2000), (42, text(1), 1990)],
    ]
    home = work_path(spark, "copies")
    for k, batch in enumerate(batches):  # each run goes on from the state of the one before
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = streams.stream_samples(spark, f"{home}/in", spark.createDataFrame([], schema).schema)
        timed = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at")
        out = streams.first_copies(timed, delay=f"{delay} seconds", keep=f"{keep} seconds")
        query = streams.run_to_parquet(out, f"{home}/rows", f"{home}/state")
        query.awaitTermination()
    got = [(r.doc_id, r.s, r.text) for r in spark.read.parquet(f"{home}/rows").withColumn("s", F.unix_seconds("ts")).collect()]
    taken = [r for b in batches for r in b if r[0] not in (32, 4, 5, 6)]
    expected = [first for first, last in _first_copies(taken, keep) if last + keep <= 2000 - delay]
    assert sorted(got) == sorted(expected)
    assert (11, 940, text(1)) in got and (33, 1301, text(4)) in got and (12, 1030, text(3)) in got
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # runs that may still grow

    table = spark.createDataFrame(taken, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    whole = streams.first_copies(table, keep=f"{keep} seconds").withColumn("s", F.unix_seconds("ts")).collect()
    assert sorted((r.doc_id, r.s, r.text) for r in whole) == sorted(first for first, _ in _first_copies(taken, keep))


def test_first_copies_merges_hot_texts_before_they_move(spark):
    rows = [(i, "one text with very many copies", i) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, at long").withColumn("ts", F.timestamp_seconds("at"))
    home = work_path(spark, "hot")
    table.repartition(4).write.parquet(f"{home}/in")
    out = streams.first_copies(streams.stream_samples(spark, f"{home}/in", table.schema))
    query = streams.run_to_parquet(out, f"{home}/rows", f"{home}/state")
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.rfind("MergingSessions") > plan.rfind("Exchange hash") > 0  # below the exchange
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert [r.doc_id for r in streams.first_copies(table).collect()] == [0]


def test_stream_dedup_equals_batch_within_the_watermark(spark):
    schema = "doc_id long, text string, at long"
    rows = [(i, f"repeated text with number {0 if i % 3 == 0 else i % 20}", i) for i in range(300)]
    path = _files(spark, rows, schema, "dup", 5)
    stream = streams.stream_samples(spark, path, spark.read.parquet(path).schema, max_files=1)
    timed = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out = work_path(spark, "once")
    streams.run_to_parquet(streams.stream_dedup(timed), f"{out}/rows", f"{out}/state").awaitTermination()
    got = sorted(r.text for r in spark.read.parquet(f"{out}/rows").collect())
    batch = clean_corpus(spark.createDataFrame(rows, schema), ["doc_id"])
    assert got == sorted(r.text for r in batch.collect())
