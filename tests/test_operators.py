import io
import json
import random
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import manifest as M
from tessera.operators import scanning as S
from tessera.operators import screening as J
from tessera.operators.components import components
from tessera.sources import readers as R
from tessera.streaming.incremental import append_once, windowed_counts


def column(spark, values, expression, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_repo_key(spark):
    assert column(spark, ["https://h/A/b.git/", "a/b", "x", None, "https://h/A/b.git"], T.repo_key) == ["a/b", "a/b", "x", None, "a/b"]


def test_requirements_and_package(spark):
    assert column(spark, ["a==1\n# c\n\nb>=2\nc[x]\n pkg~=1"], T.requirement_names) == [["a", "b", "c", "pkg~"]]
    assert column(spark, ['{"dependencies": {"b": "1"}, "devDependencies": {"a": "2", "b": "3"}}', "no", None, '{"dependencies": null}'], T.package_dependencies) == [["a", "b"], [], [], []]


def test_truncate_classes_and_tokens(spark):
    assert column(spark, ["abc", "abcd", None], lambda c: T.truncated(c, 3)) == ["abc", "abc\n... [truncated]", None]
    assert column(spark, [0, 9, 10, 12345, None, -1], T.star_class, "int") == ["< 10", "< 10", "10 - 99", "10k+", None, None]
    assert column(spark, ["Sim", "não", "", None], T.yes_or_no) == [True, False, False, None]
    with pytest.raises(Exception, match="neither yes nor no"):
        column(spark, ["maybe"], T.yes_or_no)


def test_paths(spark):
    keep = ["src/a.py", "Tests/a.py", "README.md", "skills/x/SKILL.md"]
    drop = ["tests/a.py", "src/node_modules/b.js", "src/a.test.ts", "src/test_a.py", "a_test.py", "examples/x.py"]
    assert column(spark, keep + drop, T.scanned_path) == [True] * 4 + [False] * 6
    assert column(spark, ["a/b/__init__.py", "x.py"], T.module_keys) == [["a.b", "b"], ["x"]]


def test_markers_in_order(spark):
    assert column(spark, ["the .content of a REQUEST", "none here", None], T.first_marker) == ["request", None, None]


def test_verdicts_and_dedupe(spark):
    repos = spark.createDataFrame([(1, [("Python", 69.0), ("Go", 31.0)], [("x", "c", "d")]), (2, [("Python", 70.0), ("Go", 30.0)], []), (3, [("Python", 70.0), ("Go", 30.0)], [("x", "c", "d")]), (4, None, None)],
        "row_id int, languages array<struct<name:string,percentage:double>>, frameworks array<struct<name:string,category:string,category_display:string>>")
    assert [r.verdict for r in M.verdicts(repos).orderBy("row_id").collect()] == ["failed_language", "failed_framework", "passed", "failed_language"]
    seen = spark.createDataFrame([(1, "u", "n"), (2, "u", "m"), (3, "v", "n"), (4, None, "k"), (5, "w", None)], "o int, url string, name string")
    assert sorted(r.o for r in M.first_by_any_key(seen, ["url", "name"], "o").collect()) == [1, 4, 5]


def test_rejected_rows_mark_nothing(spark):
    rng = random.Random(3)
    rows = [(1, "u1", "n"), (2, "u2", "n"), (3, "u2", "m")] + [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"pqrstuvw"])) for i in range(4, 40)]
    marks, keep = set(), []
    for o, *ks in rows:
        own = {(i, k) for i, k in enumerate(ks) if k is not None}
        if not own & marks:
            marks |= own
            keep.append(o)
    assert {1, 3} <= set(keep)
    assert sorted(r.o for r in M.first_by_any_key(spark.createDataFrame(rows, "o int, url string, name string"), ["url", "name"], "o").collect()) == keep


def test_longest_prefix(spark):
    prefixes = spark.createDataFrame([("@a", "A"), ("@a/core", "C"), ("b", "B")], "p string, f string")
    values = spark.createDataFrame([("@a/core-x",), ("@a/other",), ("bc",), ("b",), (None,), ("",)], "v string")
    assert {r.v: r.f for r in M.longest_prefix(values, "v", prefixes, "p", "f").collect()} == {"@a/core-x": "C", "@a/other": "A", "b": "B"}


def test_votes_merge_with_manual_sheet(spark):
    data = {"u1": "app app app", "u2": "app app framework", "u3": "app app framework", "u4": "framework framework framework", "u5": "needs_review needs_review needs_review", "u6": "app app framework"}
    votes = spark.createDataFrame([(u, f"j{i}", x) for u, s in data.items() for i, x in enumerate(s.split())], "url string, judge string, label string")
    manual = spark.createDataFrame([("u2", "app"), ("u4", "app"), ("u5", "app"), ("u6", "App")], "url string, decision string")
    got = {r.url: (r.decision, r.source) for r in J.merged_votes(votes, manual).collect()}
    assert got == {"u1": ("app", "judges"), "u2": ("app", "manual"), "u3": (None, "none"), "u4": ("framework", "judges"), "u5": ("app", "manual"), "u6": ("app", "manual")}


def test_all_judges_answer(spark):
    votes = spark.createDataFrame([("u", "a", "App"), ("u", "b", "error"), ("v", "c", "framework")], "url string, judge string, label string")
    assert {tuple(r) for r in J.all_answers(votes).collect()} == {("u", "a", "app"), ("u", "b", ""), ("u", "c", ""), ("v", "a", ""), ("v", "b", ""), ("v", "c", "framework")}


def test_framework_stages(spark):
    sets = [spark.createDataFrame([("r", x) for x in xs], "repo string, framework string") for xs in ("a", "ab", "abc")]
    assert {r.framework: r.stage for r in S.framework_stages(*sets).collect()} == {"a": "instantiated", "b": "imported", "c": "declared"}


def test_as_of_falls_back_to_the_first(spark):
    uses = spark.createDataFrame([("f", 1, "a"), ("f", 7, "b"), ("g", 3, "c")], "file string, line int, u string")
    made = spark.createDataFrame([("f", 5, "s5"), ("f", 7, "s7"), ("f", 9, "s9")], "file string, line int, s string")
    got = {r.u: (r.made_at, r.s) for r in S.as_of(uses, made, ["file"], "line", ["s"]).collect()}
    assert got == {"a": (5, "s5"), "b": (7, "s7"), "c": (None, None)}


def test_imported_objects(spark):
    files = spark.createDataFrame([
        (1, "O/r", "src/use.ts", "import {kb as mine, other} from './store'\nimport {bot} from '../lib/bots'\n"), (2, "O/r", "src/store.ts", "export const kb = 1"), (3, "O/r", "src/store/index.ts", ""), (4, "o/r", "lib/bots/index.js", ""),
        (5, "O/r", "pkg/app/use.py", "from app.store import kb, other\nfrom .store import kb as again\n"), (6, "O/r", "pkg/app/store.py", "kb = 1"), (7, "O/r", "own.py", "from store import kb\nkb = Other()"), (8, "O/s", "use.py", "from app.store import kb"), (9, "O/r", "x/app/other.py", None),
    ], "file_id bigint, repo string, path string, text string")
    made = spark.createDataFrame([(2, "store", "kb", "F"), (4, "agent", "bot", "G"), (6, "store", "kb", "H"), (7, "store", "kb", "I"), (6, "store", "self.kb", "H"), (9, "store", None, "H")], "file_id bigint, kind string, name string, framework string")
    got = sorted((r.file_id, r.local, r.kind, r.framework, r.made_in) for r in S.imported_objects(files, made).collect())
    assert got == [(1, "bot", "agent", "G", 4), (1, "mine", "store", "F", 2), (5, "again", "store", "H", 6), (5, "kb", "store", "H", 6)]
    assert S.imported_objects(files.limit(0), made).count() == 0


def test_failure_runs(spark):
    rows = spark.createDataFrame([("j", i, f) for i, f in enumerate([True, True, False, True, True, True])], "j string, i int, f boolean")
    assert sorted((r.started, r.n) for r in S.failure_runs(rows, "j", ["i"], F.col("f"), 2).collect()) == [(0, 2), (3, 3)]


def test_check_window_is_the_line_and_four_above(spark):
    text = "\n".join(["validate(x)", "", "", "", "kb.add(a)", "kb.add(b)"])
    got = S.near_check(spark.createDataFrame([(1, text)], "file_id int, text string"), r"\.add\(").orderBy("line").collect()
    assert [(r.line, r.checked) for r in got] == [(5, True), (6, False)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components_match_union_find(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_long_chain(spark):
    n = 60
    got = components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")).collect()
    assert len(got) == n + 1 and {r.root for r in got} == {0}


def test_readers(spark, tmp_path):
    whole = {"metadata": {"n": 2}, "repos": [{"name": "a/b", "stars": 3, "languages": [{"name": "Go", "percentage": 1.5}]}, {"name": "c/d"}]}
    (tmp_path / "m.json").write_text(json.dumps(whole))
    assert [(r.pos, r.name, r.stars) for r in R.manifest(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == [(0, "a/b", 3), (1, "c/d", None)]
    (tmp_path / "cut.json").write_text(json.dumps(whole["repos"])[:-12])
    assert [r.name for r in R.manifest(spark, str(tmp_path / "cut.json")).collect()] == ["a/b"]
    (tmp_path / "l.txt").write_text("# c\n\nhttps://h/A/b.git\nA/b\n")
    assert [r.repo_key for r in R.repository_list(spark, str(tmp_path / "l.txt")).collect()] == ["a/b"]
    (tmp_path / "r.md").write_text("## Agents\n| Framework | Pattern |\n|---|---|\n| **X** | `A(`, `B(` |\n| Y | plain |\n")
    assert {(r.section, r.label, r.pattern) for r in R.rule_tables(spark, str(tmp_path / "r.md")).collect()} == {("Agents", "X", "A("), ("Agents", "X", "B(")}
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, body in (("top/a.py", b"x = 1"), ("top/tests/b.py", b""), ("top/c.png", b"\x89"), ("top/skills/s/SKILL.md", b"---")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    files = R.archive_files(spark, str(tmp_path / "x.tar.gz"))
    assert {(r.path, r.text) for r in files.collect()} == {("a.py", "x = 1"), ("c.png", None), ("skills/s/SKILL.md", "---")}
    assert [(r.path, r.name) for r in R.skills(files).collect()] == [("skills/s/SKILL.md", "s")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for lo, hi in ((0, 5), (5, 9)):
        spark.range(lo, hi).write.mode("append").parquet(src)
        append_once(spark.readStream.schema("id bigint").parquet(src), out, state)
    append_once(spark.readStream.schema("id bigint").parquet(src), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:01", "a")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    assert sorted(r.n for r in windowed_counts(rows, "t", "1 minute", "1 minute", ["k"]).collect()) == [1, 2]
