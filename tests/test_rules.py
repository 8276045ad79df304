"""Runs, windows of lines, selections, rule tables, excerpts and appends against small expected results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import manifest as M
from tessera.operators import rules as R
from tessera.operators import scanning as S
from tessera.operators import screening as J
from tessera.operators import sections as X
from tessera.operators.components import components


def test_runs_of_failures_over_spans(spark):
    import datetime as dt
    import random

    rng = random.Random(4)
    rows, want = [], []
    for judge in "ab":
        run = []
        for i in range(300):
            at = dt.datetime(2031, 1, 1) + dt.timedelta(minutes=7 * i + (3000 if i > 200 else 0))
            bad = rng.random() < 0.6
            rows.append((judge, at, f"u{i}", "no" if bad else None))
            if bad:
                run.append(at)
            if not bad or i == 299:
                if len(run) >= 3:
                    want.append((judge, run[0], len(run)))
                run = []
    df = spark.createDataFrame(rows, "judge string, at timestamp, url string, error string")
    for span in (None, F.date_trunc("day", "at"), F.date_trunc("minute", "at")):
        assert sorted(map(tuple, S.failure_runs(df, "judge", ["at", "url"], F.col("error").isNotNull(), 3, span).select("judge", "started", "n").collect())) == sorted(want)


def test_long_files_near_checks(spark):
    text = "\n".join("x = store.get(1)" if i % 3 == 0 else "validate(y)" if i % 50 == 1 else "pass" for i in range(16_000))
    got = S.near_check(spark.createDataFrame([(1, text), (2, None), (3, "")], "file_id bigint, text string"), r"\.get\(").collect()
    lines = text.split("\n")
    assert sorted((r.line, r.checked) for r in got) == [(i + 1, any("validate" in x for x in lines[max(0, i - 4) : i + 1])) for i, x in enumerate(lines) if ".get(" in x]


def test_components_with_hubs(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400, 7)] + [(5000, 5001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), hot_from=1).collect()}
    assert set(got.values()) == {0, 5000} and len(got) == 400 + 57 + 2


def test_more_words_than_at_once(spark):
    texts = spark.createDataFrame([(1, "Alpha and BETA"), (2, None), (3, "gamma beta")], "k bigint, t string")
    registry = spark.createDataFrame([("A", ["alpha", None, ""]), ("B", ["beta", "b"]), ("C", ["gamma"])], "name string, keywords array<string>")
    for n in (1, 2, 100):
        assert sorted(map(tuple, M.keyword_hits(texts, "k", "t", registry, n).collect())) == [(1, "A"), (1, "B"), (3, "B"), (3, "C")]


def test_selection_by_votes(spark):
    given = {"u1": "aaa", "u2": "aaf", "u3": "aaf", "u4": "fff", "u5": "nnn", "u6": "aa-", "u7": "eaa"}
    names = {"a": "app", "f": "framework", "n": "needs_review", "e": "error", "-": ""}
    answers = spark.createDataFrame([(u, j, names[x]) for u, xs in given.items() for j, x in zip("abc", xs)], "key string, judge string, label string")
    manual = spark.createDataFrame([("u2", "app"), ("u4", "app"), ("u5", "app"), ("u6", " App ")], "key string, decision string")
    got = {r.key: r.source for r in J.selected(answers.select("key").distinct(), answers, manual, "app").collect()}
    assert got == {"u1": "judges", "u2": "manual", "u3": "open", "u4": "other", "u5": "manual", "u6": "manual", "u7": "open"}


def test_modules_and_packages(spark):
    modules = spark.createDataFrame([(m,) for m in ("google.adk.agents", "google.genai", "langchain_openai.x", "os", None, "")], "module string")
    roots = spark.createDataFrame([("google", "Google GenAI")], "module string, framework string")
    parts = spark.createDataFrame([("google.adk", "Google ADK")], "module string, framework string")
    assert sorted(map(tuple, M.module_framework(modules, roots, parts).collect())) == [("google.adk.agents", "Google ADK"), ("google.genai", "Google GenAI"), ("langchain_openai.x", "LangChain")]
    entries = spark.createDataFrame([("@langchain/", "A"), ("@langchain/langgraph", "B"), ("@langchain/langgraph-", "B"), ("ai", "C"), ("@x/pi-", "D")], "entry string, framework string")
    said = ["@langchain/core", "@langchain/langgraph/web", "@langchain/langgraph-sdk", "ai", "ai/react", "air", "./ai", "node:ai", "@x/pi-core", None]
    got = {r.module: r.framework for r in M.package_framework(spark.createDataFrame([(x,) for x in said], "module string"), entries).collect()}
    assert got == {"@langchain/core": "A", "@langchain/langgraph/web": "B", "@langchain/langgraph-sdk": "B", "ai": "C", "ai/react": "C", "node:ai": "C", "@x/pi-core": "D"}


def test_answers(spark):
    said = [None, "", "An app.", "framework, then app", "app, but a framework", "unclear app", 'so: {"classification": " APP "} framework', '{"classification": 5} framework', "none of both", '{broken framework']
    got = [(r.a, r.b) for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(T.answer_label(F.col("t")).alias("a"), T.object_label(F.col("t")).alias("b")).collect()]
    nr = "needs_review"
    assert got == [(nr, nr), (nr, nr), ("app", nr), ("app", nr), ("framework", nr), (nr, nr), ("app", "app"), ("framework", nr), (nr, nr), ("framework", nr)]
    strict = ['{"label":"x","reason":"r"}', ' {"reason":"r","label":"x"} ', '{"label":"x"}', '{"label":"y","reason":"r"}', '{"label":"x","reason":" "}', '{"label":"x","reason":"r","z":1}', '{"label":"x","reason":5}', "no", None, '{"label":"x","reason":"r"} z']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(strict)], "i int, t string").orderBy("i").select(T.valid_answer(F.col("t"), ("x",)).isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [True, True] + [False] * 8


def test_paths_and_places(spark):
    one = spark.createDataFrame([("a/./b/../c.js",), ("../x",), ("x/y",)], "p string").select(T.plain_folders(F.col("p")).alias("p"), T.script_paths(F.col("p")).alias("s")).collect()
    assert [r.p for r in one] == ["a/c.js", "../x", "x/y"]
    assert one[2].s[:2] == ["x/y", "x/y.ts"] and one[2].s[-1] == "x/y/index.cts" and len(one[2].s) == 25
    r = spark.range(1).select(T.store_id(F.lit("a.py"), F.lit(3), F.lit(7)), T.store_id(F.lit("a.py"), F.lit(None), F.lit(7)), T.rounded(F.lit(97.725)), T.rounded(F.lit(2.675)), T.without_comments(F.lit("a /* b\nc */ d // e\nf"))).first()
    assert tuple(r) == ("a.py:3:7", None, 97.72, 2.67, "a  d \nf")


def test_aliases_through_steps(spark):
    files = spark.createDataFrame([(1, "b = a\r\nc = b\nx = None\nd = f(a)\n"), (2, "const b = a;\n"), (3, None)], "file_id bigint, text string")
    assert sorted(map(tuple, R.alias_groups(files).collect())) == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (2, "a", "a"), (2, "b", "a")]


def test_rule_tables_by_rank(spark):
    rows = spark.createDataFrame([("agent", "Python", "**Agno**", "Agent("), ("agent", "JavaScript x", "`Agno JS`", "new Agent("), ("agent", "Generic", "Direct", r"\bAgent\s*\("), ("agent", "Detection methods", "x", "y")], "category string, section string, label string, pattern string")
    made = R.dimension(rows, ["Agno"], {"Agno JS": "Agno"})
    assert sorted((r.label, r.is_generic, r.language, r.pattern) for r in made.collect()) == [("Agno", False, "javascript", "new Agent("), ("Agno", False, "python", "Agent("), ("Direct", True, None, r"\bAgent\s*\(")]
    rules = [r.asDict() for r in made.collect()]
    calls = spark.createDataFrame([("new Agent(x)", ["Agno"]), ("Agent (x)", ["Agno"]), ("Agent(x)", []), ("run(x)", None)], "t string, i array<string>")
    got = [(r.a, r.b) for r in calls.select(R.first_label(F.col("t"), rules).alias("a"), R.first_label(F.col("t"), rules, F.col("i")).alias("b")).collect()]
    assert got == [("Agno", "Agno"), ("Direct", "Direct"), ("Agno", "Direct"), (None, None)]
    assert sorted(map(tuple, R.sweep(spark.createDataFrame([(1, "Agent( Agent(Agent("), (2, None)], "k int, t string"), "k", "t", rules).collect())) == [(1, "Agno", 3), (1, "Direct", 3)]


def test_excerpts(spark):
    intro, use, other, skip = "# T\n" + "i" * 500, "## Usage\n" + "u\n" * 900, "## Zebra\n" + "z" * 1190, "## License\n" + "l" * 2000
    fenced = "```\n# no heading\n```"
    rows = spark.createDataFrame([(1, "short <p>text</p>\n\n\n\nend"), (2, "\n\n".join([intro, skip, other, use, fenced])), (3, None), (4, "")], "k int, t string")
    got = {r.k: r.e for r in X.sections(rows, "k", "t").select("k", X.excerpt(F.col("sections")).alias("e")).collect()}
    assert got[1] == "short text\n\nend" and got[4] == "" and set(got) == {1, 2, 4}
    assert "License" not in got[2] and got[2].startswith("# T") and got[2].endswith("[README excerpt; remaining text omitted]") and got[2].index("Zebra") < got[2].index("Usage") and "[...section truncated]" in got[2] and len(got[2]) <= 3000


def test_appends_over_runs(spark, tmp_path):
    from tessera.streaming.incremental import append_first_seen, append_until, count_session

    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for run, names in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(n, run) for n in names], "name string, run int").coalesce(1).write.mode("append").parquet(src)
        append_first_seen(spark.readStream.schema("name string, run int").parquet(src), ["name"], out, f"file://{tmp_path}/state")
    assert sorted((r.name, r.run) for r in spark.read.parquet(out).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    rows = spark.readStream.schema("name string, run int").option("maxFilesPerTrigger", 1).parquet(src)
    assert append_until(rows, F.col("name") != "c", f"file://{tmp_path}/some", f"file://{tmp_path}/some-state", 2) == 2
    assert count_session(spark, f"file://{tmp_path}/n", calls=3) == {"sessions": 1, "calls": 3} and count_session(spark, f"file://{tmp_path}/n", calls=4) == {"sessions": 2, "calls": 7}


def test_statuses_and_filters(spark):
    rows = spark.createDataFrame([("a", "scanned", True, True), ("b", "scanned", True, False), ("c", "failed", False, None), ("d", None, False, None)], "k string, status string, has_usage boolean, passes boolean")
    assert [r.k for r in M.instantiating(rows, "has_usage", "passes").collect()] == ["a", "c", "d"]
    with pytest.raises(Exception, match="scan them again"):
        M.instantiating(rows.withColumn("has_usage", F.lit(False)), "has_usage", "passes").collect()
    assert [r.counted for r in M.with_status(rows, F.col("status"), F.col("has_usage")).collect()] == ["scanned", "scanned", "failed", "failed"]


def test_links_of_stores(spark):
    usage = spark.createDataFrame([("r", "s1", 1, 0, True), ("r", "s2", 0, 2, True), ("r", "s3", 1, 1, False)], "repo string, store string, n_writes int, n_reads int, known boolean")
    links = spark.createDataFrame([("r", "s1", "a"), ("r", "s1", "b"), ("r", "s1", "b"), ("r", "s2", "a"), ("r", "s3", "c"), ("r", "s1", None)], "repo string, store string, agent string")
    assert [tuple(r) for r in S.shared_stores(links, usage).collect()] == [("r", True, "a,b", "a")]
