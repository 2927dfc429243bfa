"""From cleaned splits to review sets with features, and on to predictions."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.functions.numeric import map_total
from stargauge.operators import features as feats
from stargauge.operators.cleaning import fill_null
from stargauge.operators.joins import append_unseen_names, join_business, join_user
from stargauge.operators.models import FEATURES, KEY, LABEL, reads_key
from stargauge.plans.dimensions import Dimensions, StagedDimensions
from stargauge.sources.staging import stage, stage_all


NAME_COLUMNS = ["bus_name_counts", "total_stars", "bus_name_avg"]


def wide_business(
    business: DataFrame,
    checkin: DataFrame,
    dimensions: Dimensions | StagedDimensions,
    how: str = "left",
) -> DataFrame:
    """One row per business with all features that depend on the business alone.

    ``how="full"`` also keeps check-ins of businesses without a record.
    """
    known = dimensions.ready()
    grouped = known.grouped_categories.select(
        "bus_categories",
        F.col("cat_counts").alias("grp_cat_counts"),
        F.col("cat_avg_stars").alias("grp_cat_avg_stars"),
    )
    scores = feats.business_category_scores(
        business,
        calc_cat_avg=known.review_categories,
        calc_cat_avg_bus_avg=known.business_categories,
    )
    named = business.join(known.names, "bus_name", "left")
    grouped_too = named.join(grouped, "bus_categories", "left")
    return _with_totals(grouped_too.join(scores, "business_id", "left"), checkin, how)


def _with_totals(business: DataFrame, checkin: DataFrame, how: str = "left") -> DataFrame:
    totals = checkin.select(
        "business_id", map_total(F.col("chk_checkin_info")).alias("calc_total_checkins")
    )
    return business.join(totals, "business_id", how)


def wide_user(user: DataFrame, averages: DataFrame) -> DataFrame:
    """One row per user known by record or by computed average."""
    return user.join(averages, "user_id", "full")


class ReviewSets:
    """Train, test and master reviews with their features, each built when first asked for.

    Features are computed per business and per user and staged; every set then joins its
    reviews once per key. ``names="outer"`` appends the names that no review carries to the
    train and master sets.
    """

    def __init__(
        self,
        train: Split,
        test: Split,
        everything: Split,
        dimensions: Dimensions | StagedDimensions,
        category_fill: float | Column = feats.CATEGORY_FILL,
        names: str = "left",
    ) -> None:
        self._train, self._test, self._all = train, test, everything
        self._dimensions, self._fill, self._names = dimensions, category_fill, names

    def _filled(self, df: DataFrame) -> DataFrame:
        return fill_null(df, "calc_total_checkins", F.lit(0).cast("bigint"))

    def _all_names(
        self, df: DataFrame, names: DataFrame, reviews: DataFrame, business: DataFrame
    ) -> DataFrame:
        """A name is known per business, so only the ids of ``reviews`` are read again."""
        if self._names != "outer":
            return df
        seen = reviews.select("business_id").distinct()
        carriers = business.join(seen, "business_id", "left_semi")
        return append_unseen_names(df, names, carriers)

    @cached_property
    def train(self) -> DataFrame:
        wide = wide_business(self._train.business, self._all.checkin, self._dimensions)
        # In training, a name is informative only if another business shares it.
        shared = F.col("bus_name_counts") > 1
        informative = {name: F.when(shared, F.col(name)) for name in NAME_COLUMNS}
        business = stage(wide.withColumns(informative), "train-business")
        # The narrow user side first: what the business adds is shuffled once.
        known = join_business(join_user(self._train.review, self._train.user), business)
        filled = fill_null(self._filled(known), "calc_cat_avg", self._fill)
        reviews = self._train.review.join(
            self._train.user.select("user_id"), "user_id", "left_semi"
        )
        return self._all_names(filled, self._dimensions.names.where(shared), reviews, business)

    @cached_property
    def test(self) -> DataFrame:
        scores = feats.business_category_scores(
            self._train.business, calc_cat_avg=self._dimensions.review_categories
        )
        scored = self._train.business.join(scores, "business_id", "left")
        business = stage(_with_totals(scored, self._all.checkin), "test-business")
        known = join_business(join_user(self._test.review, self._train.user), business)
        return fill_null(self._filled(known), "calc_cat_avg", self._fill)

    @cached_property
    def master(self) -> DataFrame:
        wide = wide_business(self._all.business, self._all.checkin, self._dimensions, "full")
        averages = feats.computed_user_averages(
            self._train.review, self._test.review, self._train.user
        )
        staged = stage_all({"business": wide, "user": wide_user(self._all.user, averages)})
        known = join_user(self._test.review, staged["user"], "left")
        filled = self._filled(join_business(known, staged["business"], "left"))
        return self._all_names(
            filled, self._dimensions.names, self._test.review, staged["business"]
        )


def _numbers(df: DataFrame, extra: list[str]) -> DataFrame:
    flags = [name for name in extra if dict(df.dtypes)[name] == "boolean"]
    return df.withColumns({name: F.col(name).cast("double") for name in flags})


def model_frames(
    train: DataFrame,
    test: DataFrame,
    features: list[str] | None = None,
    extra: list[str] | None = None,
    places: int | None = None,
    keyed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Standardised numeric features, and ``extra`` columns as they are, as one vector.

    ``extra`` may hold numbers, flags and vectors. Training rows must be complete in all of
    them; test rows that are not have no vector. Moments, fits and folds each read the training
    rows again, so their columns are staged. With ``places`` the scaled numbers are rounded, so
    that distances between equal rows are equal to the last digit. ``keyed=False`` leaves the key,
    the widest of the columns, out of the training rows, for fits that do not read it.
    """
    numeric = features or feats.QUANT_FEATURES
    extra = extra or []
    train, test = (_numbers(df, extra) for df in (train, test))
    keys = [KEY] if keyed else []
    rows = stage(train.select(*keys, LABEL, *numeric, *extra), "training-rows")
    scaled = [f"{name}_scaled" for name in numeric]
    fitted, scored = feats.standardize(rows, [rows, test], numeric)
    if places is not None:
        rounded = {name: F.round(name, places) for name in scaled}
        fitted, scored = fitted.withColumns(rounded), scored.withColumns(rounded)
    columns = scaled + extra
    return feats.assemble(fitted, columns), feats.assemble(scored, columns, incomplete="null")


def _encoding(train: DataFrame, categorical: list[str], vocabulary: list[str]) -> list[Transformer]:
    """Stages that put a one-hot vector of each text column into ``<name>_vector`` and a binary one
    of the category list into ``category_vector``. Unknown and missing values are all zeros."""
    stages: list[Transformer] = []
    for name in categorical:
        # One place more than there are labels stands for all other values and has no slot.
        index = StringIndexer(inputCol=name, outputCol=f"{name}_index", handleInvalid="keep").fit(train)
        stages.append(index)
        encoder = OneHotEncoder(inputCol=f"{name}_index", outputCol=f"{name}_vector")
        stages.append(encoder.fit(index.transform(train.select(name))))
    if vocabulary:
        listed = "coalesce(bus_categories, cast(array() AS array<string>)) AS category_words"
        stages.append(SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__"))
        stages.append(
            CountVectorizerModel.from_vocabulary(
                vocabulary, inputCol="category_words", outputCol="category_vector"
            ).setBinary(True)
        )
    return stages


def scoring_model(
    train: DataFrame,
    estimator: Estimator,
    features: list[str] | None = None,
    extra: list[str] | None = None,
    categorical: list[str] | None = None,
    vocabulary: list[str] | None = None,
) -> PipelineModel:
    """A model that scores raw rows: scaling by the training moments, encoding of text columns and
    of the category list, assembling and the fit, as one pipeline that can be saved.

    Training rows must be complete in their numbers; ``extra`` may hold numbers, flags and vectors
    that the rows to score have too. Labels of ``categorical`` columns and the vocabulary reach
    the driver; for columns with very many labels ``features.one_hot`` makes a vector to pass in
    ``extra``. Wide vectors need an estimator like ``models.sparse_least_squares``.
    """
    numeric = feats.QUANT_FEATURES if features is None else features
    extra, categorical, vocabulary = extra or [], categorical or [], vocabulary or []
    lists = ["bus_categories"] if vocabulary else []
    # The key is the widest column and would be shuffled with every row.
    keys = [KEY] if reads_key(estimator) else []
    wanted = dict.fromkeys([*keys, LABEL, *numeric, *extra, *categorical, *lists])
    rows = stage(train.select(*wanted), "training-rows")
    flags = [name for name in extra if dict(train.dtypes)[name] == "boolean"]
    made = []
    if numeric:
        made += [
            f"(`{name}` - {mean!r}D) / {deviation!r}D AS `{name}_scaled`"
            for name, (mean, deviation) in feats.fitted_scaling(rows, numeric).items()
        ]
    made += [f"CAST(`{name}` AS DOUBLE) AS `{name}_number`" for name in flags]
    columns = [f"{name}_scaled" for name in numeric]
    columns += [f"{name}_number" if name in flags else name for name in extra]
    columns += [f"{name}_vector" for name in categorical] + ["category_vector"] * bool(vocabulary)
    stages: list[Transformer] = []
    if made:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"))
    stages += _encoding(rows, categorical, vocabulary)
    prepared = PipelineModel(stages).transform(rows)
    fitted = estimator.fit(feats.assemble(prepared, columns))
    assembler = VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="keep")
    return PipelineModel([*stages, assembler, fitted])


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``predictions_<name>`` by a model of raw rows; a row without a value in one
    of the features has no prediction. Every row is kept."""
    assembler = next(part for part in model.stages if isinstance(part, VectorAssembler))
    scored = model.transform(df)
    complete = [F.col(column).isNotNull() for column in assembler.getInputCols()]
    known = F.when(reduce(Column.__and__, complete), F.col("prediction"))
    return scored.select(*df.columns, known.alias(f"predictions_{name}"))


def train_and_score(
    train: DataFrame,
    test: DataFrame,
    estimator: Estimator,
    name: str,
    features: list[str] | None = None,
    extra: list[str] | None = None,
    categorical: list[str] | None = None,
    vocabulary: list[str] | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """Fit on one review set and predict every row of another; also the model, for raw rows.

    A test row without a value in one of the features has a NULL prediction: sets that lack an
    attribute by definition are predicted from ``features`` without it.
    """
    model = scoring_model(train, estimator, features, extra, categorical, vocabulary)
    return score(model, test, name), model
