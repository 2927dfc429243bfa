from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from helpers import ROWS, documents, no_documents
from stargauge.llm import sharding


def fewest_bytes(sizes, shards):
    """The smallest capacity of a contiguous partition, by trying the capacities that occur."""
    def needed(capacity):
        used, load = 1, 0
        for size in sizes:
            if load + size > capacity:
                used, load = used + 1, 0
            load += size
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def laid_out(df):
    return [row.asDict() for row in df.collect()]


def test_contract_on_awkward_rows(spark):
    rows = laid_out(sharding.shard_documents(documents(spark), 3))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted(
        (key or -1, len((text or "").encode()) + 8) for key, text in ROWS
    )
    texts = {}
    for key, text in ROWS:
        texts.setdefault(text, []).append(key)
    for text, keys in texts.items():
        mine = [r for r in rows if r["doc_id"] in keys]
        assert len({r["shard"] for r in mine}) == 1
        assert {r["text_crc32"] for r in mine} == {zlib.crc32((text or "").encode())}
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_capacity_is_the_smallest(shards, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hashed = docs.select(
        (F.octet_length("text") + 8).alias("size"),
        F.shiftrightunsigned(F.xxhash64("text"), 48).alias("bin"),
    )
    bins = {r["bin"]: r["s"] for r in hashed.groupBy("bin").agg(F.sum("size").alias("s")).collect()}
    share = sum(bins.values()) / shards
    order = sorted(bins, key=lambda b: (-bins[b] if bins[b] > share else 0, b))
    best = fewest_bytes([bins[b] for b in order], shards)
    loads = sharding.shard_documents(docs, shards).groupBy("shard").agg(F.sum("size").alias("s"))
    found = {r["shard"]: r["s"] for r in loads.collect()}
    assert set(found) == set(range(shards)) and max(found.values()) <= best


def test_a_group_of_copies_with_a_third_of_all_rows(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "'copy of one text' AS text")
    rest = spark.range(3000, 9000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    found = sharding.shard_documents(hot.unionByName(rest), 24).cache()
    loads = {r["shard"]: r["count"] for r in found.groupBy("shard").count().collect()}
    assert len(loads) == 24 and sorted(loads.values())[-1] >= 3000
    others = sorted(loads.values())[:-1]
    assert max(others) < 1.2 * min(others)
    slots = found.groupBy("shard").agg(F.max("slot").alias("m"), F.count_distinct("slot").alias("n"))
    assert all(r["m"] + 1 == r["n"] == loads[r["shard"]] for r in slots.collect())


def test_same_result_for_any_partitioning_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = sharding.shard_documents(docs)
    second = sharding.shard_documents(docs.repartition(13))
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, second.collect()), key=str)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    assert sharding.shard_documents(no_documents(spark)).count() == 0
