import json

from pyspark.sql import types as T

from tessera.operators.nested import FINDINGS, SchemaGraph, inlined_children, inlined_tables, normal_json
from tessera.sources.readers import REPO

REPOS = T.StructType([T.StructField("row_id", T.LongType()), *[f for f in REPO.fields if f.name in ("languages", "frameworks")], T.StructField("pos", T.StringType()), T.StructField("child", T.StringType())])
RESULTS = "result_id bigint, findings string, parent_id string, name string"


def rows(spark, texts, repos=()):
    made = inlined_children(spark.createDataFrame(list(repos), REPOS), spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], RESULTS))
    return sorted((r.source, r.parent_id, r.child, r.pos, r.name) for r in made.collect())


def test_places_and_names(spark):
    doc = [None, {"type": "a", "tools_bound": ["x", None, "y"], "tool_names": {"name": None, "args": [{"name": "p"}, None, {"type": "t"}]}, "store": {"id": "s", "sites": [{"method": "m"}]}}]
    got = rows(spark, [json.dumps(doc)])
    assert got == sorted([
        ("file_results", 0, "finding", "1", "a"), ("file_results", 0, "tool_bound", "1.0", "x"), ("file_results", 0, "tool_bound", "1.2", "y"), ("file_results", 0, "tool_name", "1.0", ""),
        ("file_results", 0, "arg", "1.0.0", "p"), ("file_results", 0, "arg", "1.0.2", ""), ("file_results", 0, "site", "1.0", "m"),
    ])


def test_delivered_shapes_are_alike(spark):
    plain = [{"type": "a", "line": 1}, {"type": "b", "tools_bound": "solo"}]
    texts = [json.dumps(plain), json.dumps(json.dumps(plain)), json.dumps({"items": plain}), json.dumps({"count": 2, "findings": plain}), json.dumps(plain)[:-1], json.dumps(json.dumps(plain) + " ")]
    got = rows(spark, texts)
    for i in range(len(texts)):
        assert [(c, p, n) for _, k, c, p, n in got if k == i] == [("finding", "0", "a"), ("finding", "1", "b"), ("tool_bound", "1.0", "solo")], texts[i]


def test_cut_text_keeps_complete_findings_only(spark):
    text = json.dumps([{"type": "a", "tools_bound": ["x"]}, {"type": "b", "tools_bound": ["y", "z"]}])
    whole = [(c, p) for _, _, c, p, _ in rows(spark, [text])]
    for cut in range(len(text) - 1):
        got = [(c, p) for _, _, c, p, _ in rows_fast(text[:cut])]
        assert got in ([], whole[:1] + [("tool_bound", "0.0")]), cut
    assert rows(spark, ['{"type": "a", "tools_bou']) == []


def rows_fast(text):
    from tessera.operators.nested import _decoded, _shaped, _wrapped

    out = []
    for i, x in enumerate(_shaped(_wrapped(_decoded(text)), FINDINGS) or []):
        if x:
            out.append(("", 0, "finding", str(i), x["type"]))
            out += [("", 0, "tool_bound", f"{i}.{k}", t) for k, t in enumerate(x["tools_bound"] or []) if t]
    return out


def test_nothing_gives_nothing(spark):
    assert rows(spark, [None, "", "null", "[]", "{}", '{"items": []}', "[null]", "nonsense", '"', "[", "{"]) == []
    assert rows(spark, []) == []


def test_arrays_of_repositories_and_repeated_rows(spark):
    row = (7, [None, (None, 1.0), ("Go", 2.0)], [], "c", "d")
    got = rows(spark, [], [row, row, (8, None, None, None, None)])
    assert got == sorted([("repos_test", 7, "language", "1", ""), ("repos_test", 7, "language", "2", "Go")] * 2)


def test_long_text(spark):
    text = json.dumps([{"type": "a", "name": "x" * 1_000_000}] * 3)
    assert len(rows(spark, [text])) == 3


def test_shared_types_are_seen(spark):
    pair = T.StructType([T.StructField("n", T.StringType())])
    graph = SchemaGraph.of(T.StructType([T.StructField("a", T.ArrayType(pair)), T.StructField("s", T.StructType([T.StructField("b", T.ArrayType(pair))]))]))
    assert [e.name for e in graph.roots] == ["a", "s_b"]
    assert {name: [e.name for e in elements] for name, elements in graph.tables.items()} == {"a": ["a", "s_b"]}


def test_tables_with_inlined_columns_and_foreign_keys(spark):
    kind = "k bigint, v struct<pair:array<struct<n:string,at:struct<x:int,y:int>,deep:array<array<int>>>>>, w array<struct<n:string,at:struct<x:int,y:int>,deep:array<array<int>>>>, pos string"
    rows = [(1, (([("a", (1, None), [[5, None], None, [6]]), None, ("b", None, None)],)), [("c", (3, 4), [])], "z"), (2, None, None, "z"), (1, None, [], "z")]
    made = inlined_tables(spark.createDataFrame(rows, kind), "k", ["v", "w"])
    got = {name: sorted(map(tuple, t.collect())) for name, t in made.items()}
    assert sorted(got) == ["v_pair", "v_pair_deep", "v_pair_deep_item"]
    assert made["v_pair"].columns == ["root_id", "element", "pos", "at", "parent", "parent_pos", "n", "at_x", "at_y"]
    assert got["v_pair"] == [(1, "v_pair", "0", 0, "", "", "a", 1, None), (1, "v_pair", "2", 2, "", "", "b", None, None), (1, "w", "0", 0, "", "", "c", 3, 4)]
    assert got["v_pair_deep"] == [(1, "v_pair.deep", "0.0", 0, "v_pair", "0"), (1, "v_pair.deep", "0.2", 2, "v_pair", "0")]
    assert got["v_pair_deep_item"] == [(1, "v_pair.deep.item", "0.0.0", 0, "v_pair.deep", "0.0", 5), (1, "v_pair.deep.item", "0.2.0", 0, "v_pair.deep", "0.2", 6)]
    keys = {(r, e, p) for rows in got.values() for r, e, p, *_ in rows}
    assert all(parent == "" or (r, parent, parent_pos) in keys for rows in got.values() for r, _, _, _, parent, parent_pos, *_ in rows)


def test_well_formed_texts_are_read_alike(spark):
    from pyspark.sql import functions as F

    from tessera.operators.nested import _decoded, _shaped, _wrapped

    texts = [
        '[{"type":"a","tool_names":["x",{"name":"y"}]}]', '[{"type":"a","tool_names":[{"name":"y","args":[]},"x"]}]', '[{"type":"a","tool_names":[{"name":"y","args":[{"name":"q"},5]}]}]',
        '[{"type":"a"},"x",null,{"type":"b","line":"7"}]', '[{"type":"a","line":1.5},{"type":"b","store":{"id":"s","sites":[{"method":"m","taint":{"sanitized":"no"}}]}}]', '[{"type":"a","tools_bound":["x",{"a":1},3,null]}]',
        '[{"type":"a","tool_names":[[{"name":"n"}]]}]', '[{"type":"a","line":99999999999999999999}]', '[{"type":"a","store":"s","name":["x"]},{"type":true}]', '[{"type":"a"},]', '[{"type":"a"}] x', ' [ {"type":"a, b","line":3,"store":{"id":"q","sites":[{"method":"m","line":4,"taint":null}]}} ] ',
    ]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", normal_json(F.col("t"), FINDINGS).alias("v")).collect():
        assert [x and x.asDict(True) for x in r.v or []] == (_shaped(_wrapped(_decoded(r.t)), FINDINGS) or []), r.t


def test_normal_json_types(spark):
    df = spark.createDataFrame([('[{"type": 5, "line": "x", "store": "no"}]',)], "t string").select(normal_json(__import__("pyspark").sql.functions.col("t"), FINDINGS).alias("v"))
    (r,) = df.collect()[0].v
    assert (r.type, r.line, r.store) == ("5", None, None)
