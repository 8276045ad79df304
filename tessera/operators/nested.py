"""Deeply nested records to related flat tables by shared inlining.

``SchemaGraph`` reads a Spark type as a graph of elements. An element that occurs at most once below its parent (a struct
field, or a scalar) is inlined into the parent's table; an element that can repeat (an array) becomes a table of its own, and
repeated elements of the same record type share one table. (Spark types cannot be recursive.) Every row of a child table carries the
root's key, the element it came from, the positions from the root down to itself (``pos``), its place in its parent's array (``at``), and the element and ``pos`` of its parent
(``parent``, ``parent_pos``), which with the root's key are the foreign key into the parent's table; for outermost elements they are empty, and the root's key alone is.

All tables come from one narrow pass over the root rows, whose rows are written to one folder for each table: no join and no shuffle, however deep the nesting.

Defined results: null arrays and null elements give no rows, but a null element keeps its place in the count of positions;
a null label is the empty string; repeated root rows give repeated children; an empty table gives empty tables; columns
of the root other than its key and the nested ones are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch


@dataclass(frozen=True)
class Element:
    """A repeated element: where it hangs below its parent, the type of one item, and what lives in its table."""

    name: str  # dotted, from the root
    path: tuple[str, ...]  # steps from the parent item to the array, through inlined structs
    item: T.DataType
    table: str
    children: tuple["Element", ...] = ()
    inlined: tuple[tuple[tuple[str, ...], T.DataType], ...] = ()  # the paths of the scalars below an item; one empty path for a scalar item


@dataclass
class SchemaGraph:
    """The element graph of a root struct: repeated elements, and the tables that they share."""

    roots: tuple[Element, ...] = ()
    tables: dict[str, list[Element]] = field(default_factory=dict)

    @classmethod
    def of(cls, schema: T.StructType) -> "SchemaGraph":
        graph, named = cls(), {}

        def below(kind: T.DataType, path: tuple[str, ...], scalars: list, owner: str, held: str) -> list[Element]:
            found: list[Element] = []
            if isinstance(kind, T.StructType):
                for f in kind.fields:
                    found += below(f.dataType, (*path, f.name), scalars, owner, held)
            elif isinstance(kind, T.ArrayType):
                name = ".".join(x for x in (owner, "_".join(path) or "item") if x)
                plain = "_".join(x for x in (held, "_".join(path) or "item") if x)
                table = named.setdefault(kind.elementType.simpleString(), plain) if isinstance(kind.elementType, T.StructType) else plain  # records of one type share a table, and their children do
                inner: list = []
                kids = below(kind.elementType, (), inner, name, table)
                found.append(Element(name, path, kind.elementType, table, tuple(kids), tuple(inner)))
                graph.tables.setdefault(table, []).append(found[-1])
            else:
                scalars.append((path, kind))
            return found

        graph.roots = tuple(below(schema, (), [], "", ""))
        return graph

    def columns(self, table: str) -> T.StructType:
        """The inlined columns of a table: the scalars' paths joined by ``_``, or ``value``."""
        return T.StructType([T.StructField("_".join(path) or "value", kind) for path, kind in self.tables[table][0].inlined])

    def row_type(self) -> T.StructType:
        plain = [("element", T.StringType()), ("pos", T.StringType()), ("at", T.IntegerType()), ("parent", T.StringType()), ("parent_pos", T.StringType())]
        return T.StructType([T.StructField(n, k) for n, k in plain] + [T.StructField("table", T.StringType())] + [T.StructField(t, self.columns(t)) for t in self.tables if self.columns(t)])


def _at(item: Column, path: tuple[str, ...]) -> Column:
    for step in path:
        item = item.getField(step)
    return item


def element_rows(root: DataFrame, key: str, graph: SchemaGraph) -> DataFrame:
    """``root_id, element, pos, at, parent, parent_pos, table`` and one struct of inlined columns for each table, null but for the row's own.

    One narrow expression builds the rows of a root row and one ``explode`` emits them.
    """
    kind = graph.row_type()

    def rows(element: Element, item: Column, above: Column | None, parent: str) -> Column:
        items = F.coalesce(_at(item, element.path), F.array().cast(T.ArrayType(element.item)))

        def one(x: Column, i: Column) -> Column:
            place = i.cast("string") if above is None else F.concat_ws(".", above, i.cast("string"))
            own = F.struct(*[_at(x, path).alias("_".join(path) or "value") for path, _ in element.inlined])
            tables = [own if t == element.table else F.lit(None).cast(graph.columns(t)) for t in graph.tables if graph.columns(t)]
            row = F.struct(F.lit(element.name), place, i.cast("int"), F.lit(parent), above if above is not None else F.lit(""), F.lit(element.table), *tables).cast(kind)
            parts = [F.array(row)] + [rows(e, x, place, element.name) for e in element.children]
            return F.when(x.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.concat(*parts) if len(parts) > 1 else parts[0])

        return F.flatten(F.transform(items, one))

    holder = F.struct(*[F.col(f"`{f}`").alias(f) for f in dict.fromkeys(e.path[0] for e in graph.roots)])
    every = F.concat(*[rows(e, holder, None, "") for e in graph.roots])
    return root.select(F.col(f"`{key}`").cast("long").alias("root_id"), F.explode(every).alias("r")).select("root_id", "r.*")


def inlined_tables(root: DataFrame, key: str, nested: list[str]) -> dict[str, DataFrame]:
    """The tables of the ``nested`` columns of ``root``, by name: ``root_id, element, pos, at, parent, parent_pos`` and the inlined columns."""
    graph = SchemaGraph.of(root.select(*nested).schema)
    path = scratch(root.sparkSession, "inlined")
    rows = element_rows(root, key, graph)
    rows.write.partitionBy("table").parquet(path)
    every = root.sparkSession.read.schema(rows.schema).parquet(path)
    return {t: every.where(F.col("table") == t).select("root_id", "element", "pos", "at", "parent", "parent_pos", *[F.col(f"{t}.{f.name}").alias(f.name) for f in graph.columns(t)]) for t in graph.tables}


#: One finding of the scanner's JSON, as far as tables are made of it.
FINDINGS = T.ArrayType(
    T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("tools_bound", T.ArrayType(T.StringType())),
        T.StructField("tool_names", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("args", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
        ]))),
        T.StructField("store", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("sites", T.ArrayType(T.StructType([
                T.StructField("method", T.StringType()), T.StructField("line", T.LongType()),
                T.StructField("taint", T.StructType([T.StructField("source", T.StringType()), T.StructField("sanitized", T.BooleanType())])),
            ]))),
        ])),
    ])
)

#: Keys under which the array may be wrapped; an object without any key holds no item.
_WRAPPERS = ("items", "findings")
_SPACE = re.compile(r"\s*")
_DECODER = json.JSONDecoder(strict=False)


def _unquoted(text: str) -> str:
    """The start of a JSON string literal that was cut off, unescaped as far as it goes."""
    body = text[1:]
    for drop in range(0, 12):
        try:
            return json.loads('"' + body[: len(body) - drop] + '"', strict=False)
        except ValueError:
            continue
    return ""


def _complete(text: str, i: int) -> list:
    """The complete values of an array that starts at ``text[i]``, which may be cut off."""
    out: list = []
    i = _SPACE.match(text, i + 1).end()
    while i < len(text) and text[i] != "]":
        try:
            value, i = _DECODER.raw_decode(text, i)
        except ValueError:
            break
        i = _SPACE.match(text, i).end()
        if isinstance(value, (int, float)) and not isinstance(value, bool) and i >= len(text):
            break
        out.append(value)
        if i < len(text) and text[i] == ",":
            i = _SPACE.match(text, i + 1).end()
    return out


def _wrapped(value: object) -> list:
    while isinstance(value, str):
        value = _decoded(value)
    if isinstance(value, dict):
        if not value:
            return []
        for key in _WRAPPERS:
            if key in value and "type" not in value:
                return _wrapped(value[key])
        return [value]
    return value if isinstance(value, list) else []


def _decoded(text: str) -> object:
    """The JSON value of ``text``; of a text that was cut off, a list of its complete items."""
    text = text.strip("\ufeff \t\r\n")
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):
        pass
    if text.startswith('"'):
        return _decoded(_unquoted(text)) if len(text) > 1 else None
    if text.startswith("["):
        return _complete(text, 0)
    if text.startswith("{"):  # look for a wrapper's array; a single object that was cut off is not complete
        i = _SPACE.match(text, 1).end()
        while i < len(text):
            try:
                key, i = _DECODER.raw_decode(text, i)
                i = _SPACE.match(text, _SPACE.match(text, i).end() + 1).end()
                if key in _WRAPPERS:
                    if text[i : i + 1] == "[":
                        return _complete(text, i)
                    if text[i : i + 1] == '"':
                        return _decoded(text[i:])
                    value, i = _DECODER.raw_decode(text, i)
                    return value
                _, i = _DECODER.raw_decode(text, i)
                i = _SPACE.match(text, _SPACE.match(text, i).end() + 1).end()
            except ValueError:
                return None
    return None


def _shaped(value: object, kind: T.DataType) -> object:
    """``value`` in the shape of ``kind``: one object where an array belongs becomes an array of one; what cannot fit is null."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_shaped(x, kind.elementType) for x in (value if isinstance(value, list) else [value])]
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None
    return value if isinstance(value, bool) else None


def _odd(kind: T.ArrayType) -> str:
    """What ``from_json`` does not read as it is meant: a field whose value is not of its type, a scalar or array among records, and escapes that may hide a name."""
    fields: dict[str, set[str]] = {}

    def walk(k: T.DataType) -> None:
        for f in k.fields if isinstance(k, T.StructType) else ():
            inner = f.dataType
            records = isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType)
            fields.setdefault("records" if records else inner.typeName(), set()).add(re.escape(f.name))
            walk(inner.elementType if isinstance(inner, T.ArrayType) else inner)

    walk(kind.elementType)
    begins = {"records": r"\[\s*[{\]n]|n", "array": r"\[|n", "struct": r"\{|n", "long": r"-?\d{1,18}\s*[,}]|n", "double": r"[-\d]|n", "boolean": r"true|false|n"}
    parts = [rf'"(?:{"|".join(sorted(names))})"\s*+:\s*+(?!{begins[sort]})' for sort, names in sorted(fields.items()) if sort in begins]
    return "|".join([*parts, r'(?:\}|null)\s*+,\s*+(?:[^\s{"n]|"(?:[^"\\]|\\.)*+"\s*+[^:\s])', r"\\u"])


def normal_json(text: Column, kind: T.ArrayType) -> Column:
    """JSON text in any of the delivered shapes (array, bare object, wrapped, encoded twice, cut off) as a column of type ``kind``.

    Whole arrays of objects are read by ``from_json``; only what that rejects, or where a field looks odd, goes to Python.
    Null, empty and unreadable texts give null. Of a text that was cut off only complete items remain.
    """

    @F.pandas_udf(T.StringType())
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda s: None if not s else json.dumps(_shaped(_wrapped(_decoded(s)), kind), separators=(",", ":")))

    plain = F.when(text.rlike(r"^\s*\[\s*\{") & ~text.rlike(_odd(kind)), F.from_json(text, kind))
    taken = plain.isNotNull() & (F.size(plain) == F.json_array_length(text))
    return F.when(taken, plain).otherwise(F.from_json(canonical(F.when(~F.coalesce(taken, F.lit(False)), text)), kind))


#: The children of the queries: for each element, the child's name and the inlined column that names it.
CHILDREN = {
    "languages": ("language", "name"), "frameworks": ("framework", "name"), "findings": ("finding", "type"), "findings.tools_bound": ("tool_bound", "value"),
    "findings.tool_names": ("tool_name", "name"), "findings.tool_names.args": ("arg", "name"), "findings.store_sites": ("site", "method"),
}


def inlined_children(repos: DataFrame, results: DataFrame) -> DataFrame:
    """The children of ``repos`` (languages, frameworks) and of ``results`` (JSON findings with all below them), read off their tables.

    ``source, parent_id, child, pos, name``; see the module's text for nulls, empties and repeated rows.
    """
    nested = results.select("result_id", normal_json(F.col("findings"), FINDINGS).alias("findings"))
    out = None
    for source, tables in (("repos_test", inlined_tables(repos, "row_id", ["languages", "frameworks"])), ("file_results", inlined_tables(nested, "result_id", ["findings"]))):
        for name, table in tables.items():
            child, label = next((c, n) for e, (c, n) in CHILDREN.items() if e.replace(".", "_") == name)
            rows = table.select(F.lit(source).alias("source"), F.col("root_id").alias("parent_id"), F.lit(child).alias("child"), "pos", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("name"))
            out = rows if out is None else out.unionByName(rows)
    return out
