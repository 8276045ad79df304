"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def keys(df):
    return sorted(r.repo_key for r in df.collect())


def test_lists_in_all_forms(spark, tmp_path):
    assert keys(R.repository_list(spark, put(tmp_path, "a.csv", "id,url\n1,https://h/A/b.git\n2,\n"))) == ["a/b"]
    assert keys(R.repository_list(spark, put(tmp_path, "b.csv", "x\nA/c\n"))) == ["a/c"]
    objects = [{"url": "https://h/a/b", "classification": "app"}, {"repo": "a/c"}, {"name": "a/d", "classification": "framework"}]
    assert keys(R.repository_list(spark, put(tmp_path, "c.json", json.dumps({"results": objects})))) == ["a/b", "a/c"]
    assert keys(R.repository_list(spark, put(tmp_path, "d.json", json.dumps(["https://h/A/b", "c/d", ""])))) == ["a/b", "c/d"]
    assert keys(R.repository_list(spark, put(tmp_path, "e.json", json.dumps({"n": 2, "urls": ["https://h/A/b", "x, \"y/z"]})))) == ["a/b", 'x, "y/z']


def test_names_in_order(spark):
    rows = [(1, "https://github.com/O/r.git", None), (2, None, "O/r"), (3, "x", None), (4, "a/b/c", None), (5, " /p/q/ ", None), (6, None, None)]
    got = R.repository_names(spark.createDataFrame(rows, "at int, name string, full_name string"), "at").orderBy("at").collect()
    assert [tuple(r) for r in got] == [("O/r", 1), ("p/q", 5)]


def test_judges_and_flags(spark, tmp_path):
    doc = {"model": "gpt-gpt-5:x", "results": [{"url": "u", "classification": "app", "error": None}, {"url": "v", "classification": "app", "error": "e"}, {"url": "w", "classification": ""}]}
    path = put(tmp_path, "j.json", json.dumps(doc))
    assert sorted(map(tuple, R.judge_answers(spark, path).collect())) == [("gpt-5", "u", "app"), ("gpt-5", "v", "error"), ("gpt-5", "w", "error")]
    assert {r.judge for r in R.judge_answers(spark, path, "mine").collect()} == {"mine"}
    want = [("p", True, False, True), ("q", False, False, False)]
    assert sorted(map(tuple, R.flag_table(spark, put(tmp_path, "f.csv", "﻿package,c1,c2,c3\n# note\n\n p ,1,nao,sim\nq,,0,-\n")).collect())) == want
    assert sorted(map(tuple, R.flag_table(spark, put(tmp_path, "g.csv", "p;1;nao;sim\nq;;0;-\n"), ";").collect())) == want
    for bad in ("p,1,0\nq,1,0\n", ",1,0,1\n", "p,1,0,maybe\nq,1,0,perhaps\n"):
        with pytest.raises(Exception, match="row without|neither yes nor no"):
            R.flag_table(spark, put(tmp_path, "h.csv", bad), header=False).collect()


def test_lines_keep_the_last(spark, tmp_path):
    path = put(tmp_path, "m.jsonl", '{"repo": "a", "description": "one two"}\n\n{"repo": "b"}\nbroken\n{"repo": "a", "description": "three"}\n')
    got = {r.repo: r.description for r in R.json_lines(spark, path, "repo string, description string", "repo").collect()}
    assert got == {"a": "three", "b": None}


def test_sinks(spark, tmp_path):
    totals = spark.createDataFrame([(3, 2)], "n_agents int, repos int")
    bars = spark.createDataFrame([("n_agents", 10, 1), ("n_agents", 2, 4)], "field string, value bigint, n_repos bigint")
    R.write_totals(totals, f"file://{tmp_path}/totals", bars)
    (doc,) = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/totals").collect()]
    assert doc == {"n_agents": 3, "repos": 2, "distributions": {"n_agents": {"2": 4, "10": 1}}} and list(doc["distributions"]["n_agents"]) == ["2", "10"]
    rows = spark.createDataFrame([("r", 1, ["a", "b"])], "repo_name string, stars int, tools array<string>")
    R.write_csv(rows, f"file://{tmp_path}/csv", ("stars", "repo_name", "tools"))
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True, escape='"').first().asDict() == {"stars": "1", "repo_name": "r", "tools": '["a","b"]'}
    R.write_logs(spark.createDataFrame([("passed", "u"), ("failed_language", "v - 10%")], "verdict string, line string"), f"file://{tmp_path}/logs")
    assert {(r.verdict, r.value) for r in spark.read.text(f"file://{tmp_path}/logs").collect()} == {("passed", "u"), ("failed_language", "v - 10%")}
    R.write_manifest(rows.drop("tools"), f"file://{tmp_path}/man", filter_date="2031")
    assert json.loads(spark.read.text(f"file://{tmp_path}/man/metadata").first().value) == {"filter_date": "2031", "total_repos": 1}
    assert R.read_sidecar(spark, put(tmp_path, "side.json", '{"sessions": 2}')) == {"sessions": 2} and R.read_sidecar(spark, f"file://{tmp_path}/none.json") == {}


def test_shared_folder_must_be_told(spark, monkeypatch):
    from tessera import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Far())
    assert spark.range(1).select(F.lit(1)).count() == 1
