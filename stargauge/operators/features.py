"""Feature columns, encodings and scaling."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.functions.numeric import map_total
from stargauge.operators.dimensions import VOCABULARY_SIZE, category_vocabulary, top_k
from stargauge.operators.joins import users_without_average
from stargauge.sources.staging import stage

# Stars assumed where no category or no category list is known, and the
# numeric features of the default model.
CATEGORY_FILL = 3.766723066
GROUPED_FILL = 3.80
QUANT_FEATURES = [
    "bus_stars",
    "user_average_stars",
    "bus_review_count",
    "user_review_count",
    "calc_total_checkins",
    "calc_cat_avg",
]


def computed_user_averages(
    train_reviews: DataFrame, test_reviews: DataFrame, train_users: DataFrame
) -> DataFrame:
    """Count and average of the training stars of test users whose average is not known.

    Stars are averaged per user before the ids are matched, so a user with very many reviews
    is reduced ahead of the shuffle.
    """
    per_user = train_reviews.groupBy("user_id").agg(
        F.count("*").cast("double").alias("calc_user_rev_count"),
        F.avg("rev_stars").alias("calc_user_avg_stars"),
    )
    return per_user.join(users_without_average(test_reviews, train_users), "user_id")


def with_total_checkins(df: DataFrame) -> DataFrame:
    return df.withColumn("calc_total_checkins", map_total(F.col("chk_checkin_info")))


def business_category_scores(business: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """Per business, the mean of its categories' averages, one column per dimension.

    ``name=dimension`` gives a column ``name``. Categories outside a dimension are left out;
    a business without any known category gets NULL.
    """
    scored = business.select("business_id", F.explode("bus_categories").alias("category"))
    for name, dimension in dimensions.items():
        averages = dimension.select("category", F.col("cat_avg_stars").alias(name))
        scored = scored.join(averages, "category", "left")
    return scored.groupBy("business_id").agg(*[F.avg(name).alias(name) for name in dimensions])


def attach_category_scores(
    df: DataFrame, business: DataFrame, **dimensions: DataFrame
) -> DataFrame:
    scores = stage(business_category_scores(business, **dimensions), "category-scores")
    return df.join(scores, "business_id", "left")


def multi_hot_long(
    df: DataFrame, vocabulary_from: DataFrame, k: int = VOCABULARY_SIZE
) -> DataFrame:
    """Sparse multi-hot matrix as ``(review_id, category)`` rows, one per 1-entry.

    The vocabulary has ``k`` words at most and enters as one array value, so the reviews are
    neither joined nor shuffled.
    """
    vocabulary = category_vocabulary(vocabulary_from, k).agg(F.collect_list("category")).scalar()
    hot = F.array_intersect(F.col("bus_categories"), vocabulary)
    return df.select("review_id", F.explode(hot).alias("category"))


def review_vocabulary(
    reviews: DataFrame, business: DataFrame, k: int = VOCABULARY_SIZE
) -> DataFrame:
    """The ``k`` categories with the most reviews, as ``category_vocabulary`` of the joined rows.

    Reviews are counted per business first, so each category list is met once per business.
    """
    counts = reviews.groupBy("business_id").agg(F.count("*").alias("reviews"))
    listed = business.select("business_id", F.explode("bus_categories").alias("category"))
    known = listed.where(F.col("category").isNotNull())
    per_category = known.join(counts, "business_id").groupBy("category")
    return top_k(per_category.agg(F.sum("reviews").alias("n")), "n", "category", k)


def _listed(vocabulary: list[str]) -> Column:
    """The words of a category list that the vocabulary has, each once."""
    return F.array_distinct(F.filter("bus_categories", lambda word: word.isin(vocabulary)))


def multi_hot_long_by_business(
    reviews: DataFrame, business: DataFrame, vocabulary: DataFrame
) -> DataFrame:
    """``multi_hot_long`` of reviews (``review_id, business_id``) whose lists are those of
    ``business``: a list is compared with the vocabulary once per business, not per review."""
    words = [row["category"] for row in vocabulary.collect()]
    hot = business.select("business_id", _listed(words).alias("hot"))
    known = stage(hot.where(F.size("hot") > 0), "business-words")
    joined = reviews.select("review_id", "business_id").join(known, "business_id")
    return joined.select("review_id", F.explode("hot").alias("category"))


def multi_hot_by_business(
    reviews: DataFrame, business: DataFrame, vocabulary: DataFrame, output: str = "category_vector"
) -> tuple[DataFrame, list[str]]:
    """``multi_hot`` of reviews whose lists are those of ``business``: a vector is built once per
    business. Every review is kept; one without a business, or without a list, has no words."""
    words = [row["category"] for row in vocabulary.collect()]
    model = CountVectorizerModel.from_vocabulary(
        words, inputCol="_words", outputCol=output
    ).setBinary(True)
    lists = F.coalesce("bus_categories", F.array().cast("array<string>")).alias("_words")
    vectors = model.transform(business.select("business_id", lists)).drop("_words")
    joined = reviews.join(stage(vectors, "business-vectors"), "business_id", "left")
    nothing = array_to_vector(F.array_repeat(F.lit(0.0), len(words)))
    return joined.withColumn(output, F.coalesce(output, nothing)), words


def multi_hot(
    df: DataFrame,
    vocabulary_from: DataFrame,
    k: int = VOCABULARY_SIZE,
    output: str = "category_vector",
) -> tuple[DataFrame, list[str]]:
    """Binary category vectors, and the vocabulary (``k`` words at most) they refer to.

    Every row is kept; one without a list has no words.
    """
    vocabulary = [row["category"] for row in category_vocabulary(vocabulary_from, k).collect()]
    listed = f"{output}_words"
    model = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol=listed, outputCol=output
    ).setBinary(True)
    words = F.coalesce("bus_categories", F.array().cast("array<string>"))
    return model.transform(df.withColumn(listed, words)).drop(listed), vocabulary


def one_hot_long(
    train: DataFrame, df: DataFrame, feature: str, key: str = "review_id"
) -> DataFrame:
    """Sparse one-hot matrix as ``(key, value)`` rows; values unseen in training have none.

    Works for any number of values, as nothing reaches the driver.
    """
    seen = stage(train.where(F.col(feature).isNotNull()).select(feature).distinct(), "values")
    return df.select(key, feature).join(seen, feature, "left_semi").select(
        key, F.col(feature).alias("value")
    )


def one_hot(train: DataFrame, frames: list[DataFrame], feature: str) -> list[DataFrame]:
    """One-hot vectors of a text column in ``<feature>_vector``, fitted on ``train`` only.

    A boolean column becomes one 0/1 column, NULL where it is not known. Values unseen in
    training, and NULL, become all zeros. Labels are numbered in Spark, in their order, so there
    may be any number of them; only that number reaches the driver.
    """
    output = f"{feature}_vector"
    if dict(train.dtypes)[feature] == "boolean":
        flag = array_to_vector(F.array(F.col(feature).cast("double")))
        known = F.col(feature).isNotNull()
        return [df.withColumn(output, F.when(known, flag)) for df in frames]
    index = f"{feature}_index"
    labels, count = numbered(train.select(feature).where(F.col(feature).isNotNull()), index)
    # The number after the last label stands for all other values and has no slot.
    encoder = OneHotEncoder(inputCols=[index], outputCols=[output]).fit(
        train.sparkSession.range(1).select(F.lit(float(count)).alias(index))
    )
    return [
        encoder.transform(
            df.join(labels, feature, "left").fillna(float(count), [index])
        )
        for df in frames
    ]


def numbered(values: DataFrame, index: str) -> tuple[DataFrame, int]:
    """The distinct values of a one-column frame with their place in order, and their number.

    Values are sorted across tasks and numbered within each; the driver sees one count per task.
    """
    (name,) = values.columns
    marked = stage(
        values.distinct().orderBy(name).withColumn("_mark", F.monotonically_increasing_id()),
        "labels",
    )
    task = F.shiftright("_mark", 33)
    sizes = sorted(tuple(row) for row in marked.groupBy(task).count().collect())
    before, total = {}, 0
    for number, size in sizes:
        before[number], total = total, total + size
    spark = values.sparkSession
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_task bigint, _before bigint")
    place = (F.col("_before") + F.col("_mark").bitwiseAND((1 << 33) - 1)).cast("double")
    placed = marked.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return stage(placed.select(name, place.alias(index)), "numbered-labels"), total


def moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population standard deviation of each feature, in one row."""
    return df.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in features],
        *[F.stddev_pop(name).alias(f"{name}_std") for name in features],
    )


def fitted_scaling(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Training mean and deviation of each feature; 1 for the deviation of a constant one. One
    row reaches the driver."""
    fitted = moments(train, features).first()
    return {name: (fitted[f"{name}_mean"], fitted[f"{name}_std"] or 1.0) for name in features}


def standardize(
    train: DataFrame, frames: list[DataFrame], features: list[str], suffix: str = "_scaled"
) -> list[DataFrame]:
    """Scale by the training mean and deviation; a constant feature is only centred.

    The moments, one row, are fitted when called.
    """
    scaling = fitted_scaling(train, features)

    def scaled(name: str) -> Column:
        mean, deviation = scaling[name]
        return (F.col(name) - mean) / deviation

    return [df.withColumns({name + suffix: scaled(name) for name in features}) for df in frames]


def assemble(
    df: DataFrame, columns: list[str], output: str = "features", incomplete: str = "error"
) -> DataFrame:
    """Put numbers and vectors side by side into one vector, row by row.

    An incomplete row fails and names its empty columns, or, with ``incomplete="null"``, has no
    vector. Rows are never left out.
    """
    missing = F.concat_ws(", ", *[F.when(F.col(name).isNull(), F.lit(name)) for name in columns])
    if incomplete == "null":
        kept = VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")
        return kept.transform(df).withColumn(output, F.when(missing == "", F.col(output)))
    failed = F.raise_error(F.concat(F.lit("rows without a value in "), missing))
    # Checked in a column of the assembler, which takes vectors as they are, sparse ones too.
    first = columns[0]
    checked = df.withColumn(first, F.when(missing == "", F.col(first)).otherwise(failed))
    return VectorAssembler(inputCols=columns, outputCol=output).transform(checked)


