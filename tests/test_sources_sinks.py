"""Readers and writers against small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crawlwright.operators import scan, stats
from crawlwright.sources import readers, writers


def test_files_logs_and_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text("one\nERROR two\nthree\n")
    (tmp_path / "sub" / "key.PEM").write_text("x" * 150)
    (tmp_path / "sub" / "m.py").write_text("import os\nos.system('x')\npassword = \"verysecret1\"\nos.system('y'); eval('z')\n")
    listing = {r["filename"]: (r["length"], r["suffix"]) for r in readers.file_listing(spark, str(tmp_path)).collect()}
    assert listing["key.PEM"] == (150, ".pem") and len(listing) == 3
    found = scan.scan_file_names(readers.file_listing(spark, str(tmp_path)).select("path")).collect()
    assert [r["kind"] for r in found] == ["sensitive_file"]
    lines = readers.log_lines(spark, str(tmp_path))
    assert sorted((r["line_no"], r["line"]) for r in lines.collect()) == [(1, "one"), (2, "ERROR two"), (3, "three")]
    assert stats.log_error_rate(lines).first()["error_rate"] == pytest.approx(100 / 3)
    issues = scan.scan_texts(readers.source_tree(spark, str(tmp_path))).collect()
    got = sorted((r["line_number"], r["category"]) for r in issues)
    assert got == [(2, "command_injection"), (3, "hardcoded_secrets"), (4, "command_injection"), (4, "unsafe_deserialization")]
    assert {r["code_snippet"] for r in issues if r["line_number"] == 3} == {'password = "verysecret1"'}


def test_event_log_and_reports(spark, tmp_path):
    event = {"event_id": "e1", "timestamp": "2024-01-01T00:00:05", "metric_name": "m", "current_value": 1.5}
    (tmp_path / "log.json").write_text(json.dumps({"events": [event, {**event, "event_id": "e2"}]}, indent=1))
    rows = readers.event_log(spark, str(tmp_path / "log.json"))
    assert sorted(r["event_id"] for r in rows.collect()) == ["e1", "e2"] and rows.first()["ts"] is not None
    writers.append_events(rows, str(tmp_path / "kept"))
    writers.append_events(rows, str(tmp_path / "kept"))
    assert writers.kept_events(spark.read.parquet(str(tmp_path / "kept")), 3).count() == 3


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"k": "v"})], "a int, b string, c map<string,string>")
    writers.export(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).columns == ["a", "b", "c"]
    writers.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["c"] == '{"k":"v"}'
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "x"), "xml")


def test_wide_metrics(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in (0, 1)]
    df = spark.createDataFrame([(t[0], "cpu", 1.0, 0), (t[0], "mem", 2.0, 1), (t[1], "cpu", 3.0, 2), (t[1], "late", 9.0, 3)],
                               "ts timestamp, name string, value double, seq int")
    got = writers.wide_metrics(df).orderBy("ts").collect()
    assert [tuple(r)[1:] for r in got] == [("1.0", "2.0"), ("3.0", "")]


def test_crawl_report_and_descriptions(spark, tmp_path):
    found = spark.createDataFrame([("b", "subpage", "u1", True), ("b", "subpage", "u2", None), ("c", "image", "i", False)],
                                  "base_url string, kind string, url string, valid boolean")
    errors = spark.createDataFrame([("b", 0, "boom")], "base_url string, seq int, error string")
    lines = writers.crawl_report(found, errors)
    text = {b: [r["line"] for r in lines.filter(F.col("base_url") == b).orderBy("part", "n").collect()] for b in "bc"}
    assert text["b"][-8:] == ["有效图片: 0 个", "", "=== 错误 ===", "- boom", "", "=== 统计 ===", "子页面有效率: 50.0%", "图片有效率: N/A"]
    assert "2. u2 [无效]" in text["b"] and "图片有效率: 0.0%" in text["c"]
    writers.write_crawl_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == lines.count()
    pages = spark.createDataFrame([("http://h/a.html", "T: x", " d "), ("http://h/b.html", " ", "e"), ("http://h/c.html", "t", " ")],
                                  "url string, title string, description string")
    got = {r["dir"]: r["filename"] for r in writers.page_descriptions(pages, "now").collect()}
    assert got == {"a": "T_ x.txt", "b": writers.DESCRIPTION_FILE}


def test_collectors(spark):
    base = spark.createDataFrame([("cpu", 1.0)], "name string, value double")
    out = readers.with_collected(base, ("db", spark.createDataFrame([("rows", 5.0)], "name string, value double")))
    assert sorted(r["name"] for r in out.collect()) == ["cpu", "db_rows"]
