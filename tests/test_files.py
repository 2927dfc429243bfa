from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from conftest import values
from stargauge import schemas
from stargauge.operators import models
from stargauge.operators.features import assemble
from stargauge.plans.sentiment import score_reviews
from stargauge.queries import features as feature_queries
from stargauge.queries import scans as scan_queries
from stargauge.sources import readers, scratch, writers


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines_fill_absent_fields(spark, tmp_path):
    path = put(
        tmp_path,
        "chk.json",
        '{"business_id": "b", "checkin_info": {"9-5": 2, "10-1": 1}}\n{"business_id": "c"}\n',
    )
    got = readers.read_json_lines(spark, path, schemas.CHECKIN)
    assert values(got) == [("b", {"9-5": 2, "10-1": 1}, None), ("c", None, None)]


def test_written_splits_are_packed_and_whole(spark, warehouse, tmp_path):
    scan_queries._write_split(warehouse, warehouse.raw_old_test, f"{tmp_path}/old")
    files = [path.name for path in tmp_path.glob("*.json/part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)
    got = readers.read_split(spark, str(tmp_path), "old")
    for entity, key in (("review", "review_id"), ("business", "business_id"), ("user", "user_id")):
        assert values(getattr(got, entity), key) == values(
            getattr(warehouse.raw_old_test, entity).select(F.col(key).cast("string")), key
        )


def test_csv_rows_keep_the_header_as_a_row(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'category,n\n"Food, Drink",2\n')
    got = values(readers.read_csv_rows(spark, path))
    assert got == [("Food, Drink", "2"), ("category", "n")]


def test_csv_table_reads_quotes_and_crlf(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'category,n,x\r\n"Food, ""Hot""",2,3.5\r\nBars,,\r\n')
    got = readers.read_csv_table(spark, path, "category string, n bigint, x double")
    assert values(got) == [("Bars", None, None), ('Food, "Hot"', 2, 3.5)]


def test_lexicon_has_no_quoting_and_keeps_the_last_score(spark, tmp_path):
    path = put(tmp_path, "l.txt", 'can\'t stand\t-3\nnaïve\t-2\ngood\t3\n"odd\t1\ngood\t2\n')
    assert set(values(readers.read_lexicon(spark, path))) == {
        ('"odd', 1),
        ("can't stand", -3),
        ("good", 2),
        ("naïve", -2),
    }


def test_last_line_per_review_wins(spark, tmp_path):
    lines = [f'{{"review_id": "{i % 3}", "stars": {i}}}' for i in range(10)]
    path = put(tmp_path, "r.json", "\n".join(lines))
    got = readers.read_keyed_reviews(spark, path)
    assert values(got, "review_id", "stars") == [("0", 9), ("1", 7), ("2", 8)]


def test_sentiment_job(spark, tmp_path):
    reviews = put(
        tmp_path,
        "r.json",
        '{"review_id": "a", "text": "bad"}\n{"review_id": "b", "text": "meh"}\n'
        '{"review_id": "a", "text": "good good"}\n',
    )
    lexicon = put(tmp_path, "l.txt", "good\t3\nbad\t-3\n")
    out = score_reviews(spark, reviews, lexicon, str(tmp_path / "scores"))
    assert values(spark.read.csv(out)) == [("0", "b"), ("6", "a")]


def test_predictions_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 4.9)], "review_id string, predictions_M double")
    free = writers.write_predictions(df, str(tmp_path), "M", "All", "7")
    assert "Submission7--" in free and free.endswith("--M--All.csv")
    read = spark.read.option("header", True).csv(free)
    assert read.columns == ["review_id", "stars"]
    assert values(read) == [("a", "0.5"), ("b", "4.9")]
    tight = writers.write_predictions(df, str(tmp_path), "M", "Cut", "7", low=1.2, high=4.8)
    assert values(spark.read.option("header", True).csv(tight)) == [("a", "1.2"), ("b", "4.8")]


def test_sinks_do_not_overwrite(spark, tmp_path):
    path = writers.write_csv(spark.range(1), str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_csv(spark.range(1), path)


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(str(i), float(2 * i), float(i)) for i in range(9)],
        "review_id string, rev_stars double, a double",
    )
    model = Pipeline(stages=[models.least_squares()]).fit(assemble(df, ["a"]))
    loaded = writers.load_model(writers.save_model(model, str(tmp_path), "LinReg"))
    got = values(loaded.transform(assemble(df, ["a"])), "review_id", "prediction")
    assert all(abs(p - 2 * int(key)) < 1e-8 for key, p in got)


def test_shared_folder_is_the_configured_one(spark):
    before = spark.conf.get(scratch.CHECKPOINT_SETTING, None)
    path = scratch.scratch_path(spark, "label")
    assert before is None or path.startswith(before)
    assert path != scratch.scratch_path(spark, "label")


def test_feature_scan_reads_only_the_needed_columns(warehouse):
    df = feature_queries.master_features(warehouse).select("review_id", "bus_stars")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_quantity" not in plan
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
