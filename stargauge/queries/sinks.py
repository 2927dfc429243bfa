"""Sinks: results are written by the library's writers and read back plainly."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import benchmarks
from stargauge.operators import models as ops
from stargauge.operators.features import QUANT_FEATURES
from stargauge.operators.joins import attach_recommendation_ids
from stargauge.operators.sentiment import sentiment_scores
from stargauge.plans import jobs
from stargauge.plans.modelling import model_frames
from stargauge.queries.base_sql import SPACE
from stargauge.queries.benchmarks import _FALLBACK, _KNOWN
from stargauge.queries.columns import r6
from stargauge.queries.models import NAME_NUMBERS, _fit_sql, fit_numbers_sql
from stargauge.queries.registry import query
from stargauge.queries.subsets import _1_5, _5_8, _NAMES_1
from stargauge.sources import writers
from stargauge.sources.scratch import scratch_path
from stargauge.sources.warehouse import Warehouse

c = F.col


def _read(w: Warehouse, path: str, schema: str, header: bool = True) -> DataFrame:
    return w.spark.read.schema(schema).option("header", header).csv(path)


@query(
    "k1_dimension_csv",
    """SELECT category, cat_tot_count, round(cat_avg_stars, 6) AS cat_avg_stars
       FROM v_business_categories""",
)
def dimension_csv(w: Warehouse) -> DataFrame:
    path = writers.write_dimension(
        w.dimensions.business_categories, scratch_path(w.spark, "dimension")
    )
    read = _read(w, path, "category string, cat_tot_count double, cat_avg_stars double")
    return read.select("category", "cat_tot_count", r6("cat_avg_stars"))


@query(
    "k2_sentiment_csv",
    f"""SELECT CAST(coalesce(sum(score), 0) AS BIGINT) AS score, doc_id AS review_id
        FROM (SELECT doc_id, unnest(CASE WHEN len(words) > 0 THEN words ELSE [NULL] END) AS term
              FROM (SELECT doc_id, regexp_split_to_array(text, '{SPACE}') AS words
                    FROM documents))
        LEFT JOIN v_lexicon USING (term) GROUP BY doc_id""",
)
def sentiment_csv(w: Warehouse) -> DataFrame:
    scores = sentiment_scores(w.review_text, w.lexicon)
    path = writers.write_sentiment(scores, scratch_path(w.spark, "sentiment"))
    return _read(w, path, "score bigint, review_id bigint", header=False)


@query(
    "k3_predictions_csv",
    f"""SELECT review_id, round(least(greatest({_FALLBACK}, 1.2), 4.8), 6) AS stars
        FROM {_KNOWN}""",
)
def predictions_csv(w: Warehouse) -> DataFrame:
    scored = benchmarks.business_user_mean(w.test.review, w.train)
    path = writers.write_predictions(
        scored,
        scratch_path(w.spark, "submits"),
        model="Means",
        subset="All",
        submission="1",
        prediction="benchmark_bus_usr_mean",
        low=1.2,
        high=4.8,
    )
    return _read(w, path, "review_id string, stars double").select("review_id", r6("stars"))


@query(
    "k4_benchmark_csv",
    f"""SELECT RecommendationId, round(coalesce(bus_stars, (SELECT mean FROM v_global)), 6)
        AS stars FROM {_KNOWN} JOIN v_lookup USING (user_id, business_id)""",
)
def benchmark_csv(w: Warehouse) -> DataFrame:
    scored = benchmarks.business_mean(w.test.review, w.train)
    path = writers.write_benchmark(
        attach_recommendation_ids(scored, w.id_lookup),
        scratch_path(w.spark, "submits"),
        benchmark="bus_mean",
        submission="1",
    )
    read = _read(w, path, "RecommendationId bigint, stars double")
    return read.select("RecommendationId", r6("stars"))


@query(
    "k5_chosen_columns_csv",
    """SELECT name, CAST(user_id % 40 AS BIGINT) AS review_count, user_id
       FROM v_raw_user WHERE user_id % 14 = 1""",
)
def chosen_columns_csv(w: Warehouse) -> DataFrame:
    path = writers.write_csv(
        w.raw_old_test.user,
        scratch_path(w.spark, "old-users"),
        ["name", "review_count", "user_id"],
    )
    return _read(w, path, "name string, review_count bigint, user_id bigint")


@query("k6_model_round_trip", _fit_sql("v_train_set", "v_test_set"))
def model_round_trip(w: Warehouse) -> DataFrame:
    train, test = model_frames(w.sets.train, w.sets.test)
    model = Pipeline(stages=[ops.least_squares()]).fit(train)
    path = writers.save_model(model, scratch_path(w.spark, "models"), "LinReg")
    scored = writers.load_model(path).transform(test)
    return scored.select("review_id", F.round("prediction", 4).alias("prediction"))


def _workspace(w: Warehouse) -> jobs.Workspace:
    return jobs.Workspace(
        w.train, w.test, w.everything, w.id_lookup, w.dimensions, w.sets, w.subset_sources
    )


_RULES = [
    jobs.Rule("all_5_8_train", "all_1_5_test"),
    jobs.Rule("names_1_train", "names_1_test", features=NAME_NUMBERS),
]


@query(
    "k3_whole_submission",
    f"""WITH first AS ({fit_numbers_sql(
            f"(SELECT * FROM v_train_set WHERE {_5_8})",
            f"(SELECT * FROM v_test_set WHERE {_1_5})", QUANT_FEATURES)}),
        second AS ({fit_numbers_sql(
            "(SELECT * FROM v_train_set WHERE bus_name_counts = 2)",
            f"(SELECT * FROM v_master_set WHERE {_NAMES_1})", NAME_NUMBERS)}),
        rest AS (SELECT review_id, {_FALLBACK} AS prediction FROM {_KNOWN})
        SELECT review_id,
               round(coalesce(first.prediction, second.prediction, rest.prediction), 4) AS stars
        FROM rest LEFT JOIN first USING (review_id) LEFT JOIN second USING (review_id)""",
)
def whole_submission(w: Warehouse) -> DataFrame:
    path = jobs.submit_all(_workspace(w), _RULES, scratch_path(w.spark, "submits"), submission="1")
    read = _read(w, path, "review_id string, stars double")
    return read.select("review_id", F.round("stars", 4).alias("stars"))


@query(
    "k6_job_model",
    _fit_sql(
        f"(SELECT * FROM v_train_set WHERE {_5_8})", f"(SELECT * FROM v_test_set WHERE {_1_5})"
    ),
)
def job_model(w: Warehouse) -> DataFrame:
    """The model that a job saved, loaded again to score raw rows."""
    work = _workspace(w)
    models = scratch_path(w.spark, "models")
    jobs.predict_subset(
        work, "all_5_8_train", "all_1_5_test", scratch_path(w.spark, "submits"), submission="1",
        model_folder=models,
    )
    scored = jobs.score_saved(work, models, "all_1_5_test")
    return scored.select("review_id", F.round("predictions_LinReg", 4).alias("prediction"))
