"""Streams of files against the batch operators, and restarts from a checkpoint."""

from __future__ import annotations

import json

import pytest

from conftest import values
from stargauge import schemas
from stargauge.operators.sentiment import sentiment_scores
from stargauge.streaming import files

TEXTS = ["good good bad", "", None, "nothing known", "bad", "good\tgood\nbad good"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 3), ("bad", -2)], "term string, score int")


def land(folder, name, rows):
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as file:
        for key, text in rows:
            file.write(json.dumps({"review_id": key, "text": text, "stars": 3}) + "\n")


def test_scores_equal_the_batch_and_files_are_read_once(spark, lexicon, tmp_path):
    folder, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    rows = [(f"r{i}", text) for i, text in enumerate(TEXTS)]
    land(folder, "first", rows[:4])
    first = files.score_review_files(spark, folder, lexicon, output, progress)
    assert values(first, "review_id") == [(key,) for key, _ in rows[:4]]
    # A new run goes on where the last one ended.
    land(folder, "second", rows[4:])
    both = files.score_review_files(spark, folder, lexicon, output, progress)
    batch = sentiment_scores(spark.createDataFrame(rows, "review_id string, text string"), lexicon)
    assert values(both, "review_id", "score") == values(batch, "review_id", "score")
    # Nothing new: nothing is read or written again.
    again = files.score_review_files(spark, folder, lexicon, output, progress)
    assert values(again, "review_id", "score") == values(batch, "review_id", "score")


def test_a_repeated_batch_replaces_its_own_rows(spark, lexicon, tmp_path):
    """A run that dies after it has written, but before it is noted, writes the batch again."""
    folder, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    land(folder, "first", [("a", "good"), ("b", "bad")])
    stream = files.stream_json_lines(spark, folder, schemas.REVIEW)

    def dies(rows):
        sentiment_scores(rows.select("review_id", "text"), lexicon).write.mode("overwrite").parquet(
            f"{output}/batch=0"
        )
        raise RuntimeError("lost")

    query = files.run_batches(stream, dies, output, progress)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    done = files.score_review_files(spark, folder, lexicon, output, progress)
    assert values(done, "review_id", "score") == [("a", 3), ("b", -2)]


def test_files_in_several_batches(spark, lexicon, tmp_path):
    folder, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    for i in range(5):
        land(folder, f"file{i}", [(f"r{i}", "good " * i)])
    stream = files.stream_json_lines(spark, folder, schemas.REVIEW, files_per_batch=2)
    files.score_stream(stream, lexicon, output, progress).awaitTermination()
    assert values(files.read_batches(spark, output), "review_id", "score") == [
        (f"r{i}", 3 * i) for i in range(5)
    ]
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
