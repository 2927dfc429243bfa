"""The registered queries over whole tables: SQL where there is one, contract columns for all."""

from __future__ import annotations

import pytest

from check import rows_of
from stargauge.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op11_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op12_cross_tokenizer": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, FOLDER)
    expected = duck.execute(queries.ORACLE_SQL[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == sorted(df.columns)
    mine = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert mine and mine == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_contract(name, spark):
    found = dict(queries.QUERIES[name](spark, FOLDER).dtypes)
    wanted = dict(part.split(" ") for part in COLUMNS[name].split(", "))
    assert {key: found.get(key) for key in wanted} == wanted


@pytest.mark.parametrize(
    ("name", "label", "parts", "remainder", "least"),
    [("op4_quality", "quality", 4, 2, 0.9), ("op8_toxicity", "toxic", 5, 0, 0.9)],
)
def test_held_out_accuracy(name, label, parts, remainder, least, spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.QUERIES[name](spark, folder).join(labels, "doc_id").collect()
    held = [row for row in rows if row["held_out"]]
    assert 0.1 < len(held) / len(rows) < 0.4
    assert sum(row["predicted"] == row[label] for row in held) / len(held) >= least
    assert all(0 <= row["score"] <= 1 for row in rows)


def test_held_out_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, folder).where("held_out").join(docs, "doc_id").collect()
    assert sum(row["lang"] == row["lang_pred"] for row in rows) / len(rows) > 0.97
