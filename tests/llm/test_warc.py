from __future__ import annotations

import gzip
import hashlib
import os

import pytest

from helpers import LONG
from stargauge.llm import warc

BIG = "<p>" + "same page " * 200
PAGES = [
    (1, "http://a/1", BIG),
    (2, "http://a/2\r\nX-Evil: 1", BIG),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5", "short"),
    (6, "http://a/6", "short"),
    (7, "http://a/7", LONG + "é\r\n\r\nWARC/1.1\r\n"),
    (8, "http://a/8", BIG),
    (9, "http://a/9", "row that stands twice " * 100),
    (9, "http://a/9", "row that stands twice " * 100),
    (None, "http://a/none", "no key"),
]


def pages(spark, rows=PAGES, parts=3):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.selectExpr("*", "'x' AS digest", "1 AS shard", "2 AS kind").repartition(parts)


def archive(spark, tmp_path, name, **options):
    root = f"file://{tmp_path}/{name}"
    manifest = warc.write_archives(pages(spark, **options.pop("pages", {})), root, **options)
    return root, manifest


def contents(tmp_path, name):
    folder = f"{tmp_path}/{name}"
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".gz")}


def test_round_trip(spark, tmp_path):
    root, _ = archive(spark, tmp_path, "a")
    found = warc.read_archives(spark, root).collect()
    assert len(found) == len(PAGES)
    newest = {}
    for key, _, html in PAGES:
        if html and len(html.encode()) >= 1000 and key is not None:
            newest[html] = max(key, newest.get(html, key))
    for row in found:
        html = next(h or "" for k, _, h in PAGES if k == row["page_id"])
        raw = html.encode()
        assert row["payload_bytes"] == len(raw)
        assert row["payload_digest"] == hashlib.sha1(raw).hexdigest()
        other = newest.get(html)
        revisits = other is not None and other != row["page_id"]
        assert row["record_type"] == ("revisit" if revisits else "response")
        assert row["refers_to"] == (other if revisits else None)
    assert {r["target_uri"] for r in found if r["page_id"] == 3} == {"urn:page:3"}


def test_same_files_for_any_partitioning(spark, tmp_path):
    small = {"shard_bytes": 20_000, "roll_bytes": 300}
    archive(spark, tmp_path, "a", **small)
    archive(spark, tmp_path, "b", pages={"parts": 7}, **small)
    first, second = contents(tmp_path, "a"), contents(tmp_path, "b")
    assert len(first) > 3 and first == second
    assert not os.path.exists(f"{tmp_path}/a/_temporary")


def test_files_are_gzip_members_that_any_tool_reads(spark, tmp_path):
    _, manifest = archive(spark, tmp_path, "a")
    text = b"".join(gzip.decompress(data) for _, data in sorted(contents(tmp_path, "a").items()))
    assert text.count(b"WARC-Type: response\r\n") + text.count(b"WARC-Type: revisit\r\n") == len(PAGES)
    assert b"\r\nX-Evil" not in text
    rows = manifest.collect()
    assert sum(row["records"] for row in rows) == len(PAGES)
    assert {r["name"]: r["bytes"] for r in rows} == {
        name: len(data) for name, data in contents(tmp_path, "a").items()
    }


def test_no_pages(spark, tmp_path):
    root, manifest = archive(spark, tmp_path, "a", pages={"rows": []})
    assert manifest.count() == 0 and warc.read_archives(spark, root).count() == 0


def test_a_damaged_archive_is_refused(spark, tmp_path):
    root, _ = archive(spark, tmp_path, "a")
    (name, data), *_ = contents(tmp_path, "a").items()
    plain = gzip.decompress(data).replace(b"same page same", b"same page SAME", 1)
    with open(f"{tmp_path}/a/{name}", "wb") as out:
        out.write(gzip.compress(plain))
    os.path.exists(f"{tmp_path}/a/.{name}.crc") and os.remove(f"{tmp_path}/a/.{name}.crc")
    with pytest.raises(Exception, match="does not hold"):
        warc.read_archives(spark, root).collect()


def test_a_payload_of_pages_without_keys_is_written(spark, tmp_path):
    lone = "<p>" + "page without a key " * 100
    rows = [(None, "http://a/x", lone), (None, "http://a/y", lone), (None, "http://a/z", BIG), (1, None, BIG)]
    root, manifest = archive(spark, tmp_path, "a", pages={"rows": rows})
    found = warc.read_archives(spark, root).collect()
    got = sorted((r["target_uri"], r["record_type"], r["refers_to"]) for r in found)
    assert got == [
        ("http://a/x", "response", None),
        ("http://a/y", "response", None),
        ("http://a/z", "revisit", 1),
        ("urn:page:1", "response", None),
    ]
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    text = b"".join(gzip.decompress(data) for data in contents(tmp_path, "a").values())
    assert text.count(lone.encode()) == 2 and b"None" not in text
