"""The training-data operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import datetime as dt
import random

import pytest

from plain import edits, name_level, share_level

from tessera.llm import handwritten
from tessera.llm.consensus import LABELS, consensus
from tessera.llm.handwritten import fingerprints, is_data, not_handwritten, split_head
from tessera.llm.leakage import leaked_items, myers, plain_words
from tessera.llm import linkage
from tessera.llm.linkage import Linker, accepted, learn_weights, linked_batches, place, plain_rows, repeated_rows
from tessera.llm.packing import TOKENIZER, evolved, fill_report, fitness, packed
from tessera.llm.stuffing import split_blocks, stuffed_documents, stuffing_shares
from tessera.llm.syntax import invalid_files, invalid_rates, parsed_files

VOTES = "judge string, url string, classification string, reasoning string, error string, processed_at timestamp, js string, v int"
T0 = dt.datetime(2031, 1, 1)


def vote(judge, url, label, error=None, day=0):
    return judge, url, label, None, error, T0 + dt.timedelta(days=day), "x", 1


# --- problem 3


def test_consensus_small_cases(spark):
    a, b = LABELS[0], LABELS[1]
    votes = [vote(j, "https://h/o/r", a) for j in "pqr"] + [vote(j, "HTTPS://h/O/s.git", x) for j, x in zip("pqr", (a, a, b))]
    votes += [vote("p", "https://h/o/t/", a), vote("p", "https://h/o/t", b, day=1), vote("q", "https://h/o/t", f" {b.upper()} "), vote("r", "https://h/o/t", b), vote("r", "https://h/o/t", b)]
    votes += [vote("p", "https://h/o/few", a), vote("q", "https://h/o/few", a), vote("r", "https://h/o/few", a, error="late", day=2), vote(None, "https://h/o/n", a), vote("p", None, a), vote("q", "https://h/o/n", None)]
    got = consensus(spark.createDataFrame(votes, VOTES))
    assert {r.url: r.classification for r in got.items.collect()} == {"https://h/o/r": a, "https://h/o/s": a, "https://h/o/t": b}
    assert {r.judge for r in got.judges.collect()} == {"p", "q", "r"}
    empty = consensus(spark.createDataFrame([], VOTES))
    assert empty.items.count() == 0 and empty.judges.count() == 0


def test_consensus_uses_what_bad_judges_do(spark):
    rng = random.Random(5)
    votes, truth = [], {}
    other = {LABELS[0]: LABELS[1], LABELS[1]: LABELS[2], LABELS[2]: LABELS[0]}
    for i in range(400):
        truth[f"https://h/o/r{i}"] = true = rng.choice(LABELS[:3])
        say = {"good": true if rng.random() < 0.9 else rng.choice(LABELS[:3]), "fair": true if rng.random() < 0.8 else rng.choice(LABELS[:3]), "turned": other[true] if rng.random() < 0.95 else true, "same": LABELS[0]}
        votes += [vote(j, f"https://h/o/r{i}", x) for j, x in say.items()]
    got = {r.url: r.classification for r in consensus(spark.createDataFrame(votes, VOTES)).items.collect()}
    assert sum(got[u] == t for u, t in truth.items()) > 370


def test_features_decide_where_votes_are_few(spark):
    rng = random.Random(9)
    votes, truth = [], {}
    for i in range(600):
        true = rng.choice(LABELS[:2])
        url = f"https://h/o{i}/thing-{'kit' if true == LABELS[0] else 'list'}{i}-{'kit' if true == LABELS[0] else 'list'}"
        truth[url] = true
        for j in range(3):
            votes.append((f"j{j}", url, true if rng.random() < 0.6 else rng.choice(LABELS[:2]), "a plain reason", None, T0, "x", 1))
    rows = spark.createDataFrame(votes, VOTES)
    right = {w: sum(truth[r.url] == r.classification for r in consensus(rows, width=w).items.collect()) for w in (0, 256)}
    assert right[256] > 555 and right[256] > right[0] + 20


def test_many_judges(spark):
    votes = [vote(f"j{i % 2500}", f"https://h/o/r{i // 5}", LABELS[(i // 5) % 3] if i % 7 else LABELS[3]) for i in range(7_500)]
    got = {r.url: r.classification for r in consensus(spark.createDataFrame(votes, VOTES)).items.collect()}
    assert len(got) == 1500 and sum(got[f"https://h/o/r{i}"] == LABELS[i % 3] for i in range(1500)) > 1450


# --- problem 7


def leak_tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint, key string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")


def test_leaks_found_through_changes(spark):
    words = [f"w{i}x" for i in range(80)]
    item = " ".join(words)
    other = "stock words that every item opens with before its own question begins here " + " ".join(f"v{i}y" for i in range(60))
    shared = "stock words that every item opens with before its own question begins here " + " ".join(f"u{i}z" for i in range(60))
    changed = words[10:60]
    for k in (5, 17, 31, 44):
        changed[k] = "other"
    docs = [
        (1, "before " + " ".join(words[20:50]).upper() + " after", 0, "k"), (2, "<b>" + "</b>, **".join(changed) + "**", 0, "k"), (3, "\\n".join(words[:40]), 0, "k"),
        (4, " ".join(words[:24]), 0, "k"), (5, other[:75], 0, "k"), (6, None, 0, "k"), (7, "", 0, "k"), (8, "noise " * 200_000 + item, 0, "k"), (1, "before " + " ".join(words[20:50]), 0, "k"),
    ]
    d, i = leak_tables(spark, docs, [(1, item, "x"), (2, other, "x"), (3, shared, "x"), (4, None, "x"), (5, "too short", "x")])
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(d, i).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (8, 1)]
    assert leaked_items(d.limit(0), i).count() == 0
    assert leaked_items(d, i.limit(0)).count() == 0


def test_a_crowded_filter_loses_nothing(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"a{rng.randrange(400)}" for _ in range(60)), "x") for k in range(20)]
    docs = [(k, " ".join(items[k % 20][1].split()[k % 7 : k % 7 + 20 + k % 12]), 0, "k") for k in range(60)]
    d, i = leak_tables(spark, docs, items)
    whole = sorted(map(tuple, leaked_items(d, i).collect()))
    assert whole == sorted(map(tuple, leaked_items(d, i, most_bits=1024).collect()))
    assert whole == sorted((k, k % 20) for k in range(60) if 20 + k % 12 >= 25)


def test_myers_against_plain_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert myers(p, t) == min(row)


def test_words_whatever_their_form():
    assert plain_words("The&nbsp;<em>Quick</em>\\nbrown_fox, it&#39;s caf\\u00e9") == ["the", "quick", "brown", "fox", "it", "s", "café"]


# --- problem 8

def test_stuffing(spark):
    rng = random.Random(2)
    prose = " ".join(" ".join(f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(9)) + "." for _ in range(25))
    spam = ", ".join(rng.choice(["best agent tool", "cheap agent tool", "free agent tool"]) for _ in range(300))
    links = "\n".join(f"- [x](https://a.example/{rng.randrange(50)}/b)" for _ in range(120))
    docs = [(1, prose, "en"), (2, spam, "EN "), (3, links, None), (4, None, "en"), (5, "", "xx"), (6, "   \n\n ", None), (7, prose + "\n\n" + spam[:400], "en"), (8, spam * 200, "en"), (2, spam, "EN ")]
    rows = spark.createDataFrame([(i, t, lang, "q") for i, t, lang in docs], "doc_id bigint, text string, lang string, words string")
    assert sorted(r.doc_id for r in stuffed_documents(rows).collect()) == [2, 3, 8]
    assert stuffing_shares(rows).where("doc_id in (4, 5)").count() == 0
    assert stuffed_documents(rows.limit(0)).count() == 0


def test_blocks_lose_nothing():
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "\n", "\n\n", "x" * 300, "\r\n"]) for _ in range(600))
    assert "".join("".join(split_blocks(text)).split()) == "".join(text.split())


# --- problem 2

GOOD = {
    "a.py": ["", "x = 1\n", "def f(a, /, b=1, *, c, **k) -> int:\n    return f'{a!r:>{b}}' if (n := b) else [*c]\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n", "async def f():\n\tasync with a as b, c: await d\n", "type A[T] = list[T]\n", "print(*a, sep='')\nlambda *a, b=1: (yield)\n"],
    "b.js": ["import x from 'y'\nexport default () => ({a: 1})\n", "const {a = 1, ...b} = require('c')\nreturn a\n", "let r = /[/\"]/g.test(`x${`${1}`}`) / 2\n", "a\n++b\n", "for await (const x of y) z?.[0]?.(x)\n", "class A { #p = 1; static { } get x() { return this.#p } async *g() {} }\n", "label: for (;;) { if (a) break label\n else continue }\n"],
    "g.js": ["({a = 1} = b)\n", "for ({a = 1} of b) c\n", "const f = ({a = 1}, [b = 2]) => a\n", "x = [a, {b: [c] = d}]\n;[a.b, c[d]] = e\n", "/(?<y>a|b)+(?=c)[)*]{2,3}?\\(/u.test(x)\n", "x = '\\u{1F600}\\x41\\u0041\\\\u'\n", "tag`\\unicode`\n", "yield = 1\n", "let é1 = 10n + 1_000\n", "if (a) b\nelse { const c = 1 }\n", "x = " + "[" * 3000 + "]" * 3000 + "\n", "x = " + "`${" * 300 + "1" + "}`" * 300 + "\n"],
    "c.ts": ["type A<T> = T extends (infer U)[] ? U : never;\ninterface I { a?: string; b(): void\n [k: string]: any }\n", "const f = <T,>(x: T): x is T => x as unknown as T\nlet a = b<c>(d)\n", "abstract class A<T> extends B<T> implements C { private readonly x!: number; constructor(public y: string) { super() } }\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }\n"],
    "d.tsx": ["export const A = ({x}: {x: any[]}) => <div className=\"a\" {...x}>{x.map((y) => (<B key={y} c={`d ${y}`} />))} text</div>;\n"],
    "e.cjs": ["module.exports = { a, b() { return 1 } }\nif (x) return\n"],
}
BAD = {
    "a.py": ["print 'x'\n", "def f(:\n", "if x:\npass\n", "  x = 1\n", "x = (1\n", "x = 'a\n", "<<<<<<< HEAD\n", "f() = 1\n", "f(a=1, 2)\n", "0123\n", "x = {{ y }}z\n", "try:\n    a\n"],
    "b.js": ["let x = ;\n", "{\"a\": 1, \"b\": 2}\n", "let x: number = 1\n", "const a = <div/>\n", "if (a {\n}\n", "f() = 1\n", "import x from 'y'\nreturn x\n", "'abc\n", "<<<<<<< HEAD\n", "const a\n", "x = `a ${b\n", "}\n"],
    "g.js": ["({a = 1})\n", "/(/\n", "/a)/\n", "/+a/\n", "/a{3,2}/\n", "'\\u{zz}'\n", "'\\x4'\n", "`\\u12`\n", "const a = “b”;\n", "if (a) const b = 1\n", "while (a) let b\n", "x = 1.5n\n", "x = `${`${`\n"],
    "h.mjs": ["yield = 1\n", "if (a) function f() {}\n"],
    "c.ts": ["const a = <div className=\"x\">y</div>;\n", "interface { }\n", "let x: = 1\n"],
    "d.tsx": ["const a = <b><c></b>;\n", "const a = <b\n"],
    "e.cjs": ["import x from 'y'\n"],
    "f.mjs": ["return 1\n", "with (a) b\n"],
}


def test_what_parses(spark):
    rows = [(i, "r", path, text, good) for i, (path, text, good) in enumerate((p, t, g) for table, g in ((GOOD, True), (BAD, False)) for p, ts in table.items() for t in ts)]
    got = {r.file_id: r for r in parsed_files(spark.createDataFrame(rows, "file_id bigint, repo string, path string, text string, invalid boolean").drop("invalid")).collect()}
    assert [(p, t) for i, _, p, t, good in rows if got[i].invalid == good] == []


def test_syntax_small_cases(spark):
    rows = [(1, "r", "a.py", None), (2, "R", "a.py", ""), (3, None, "a.PY", "x = ("), (4, "r", None, "x"), (5, "r", "a.md", "("), (6, "r", "b.js", "a;" * 200_000), (7, "r", "c.py", "\0")]
    files = spark.createDataFrame([(*r, "z") for r in rows], "file_id bigint, repo string, path string, text string, line string")
    assert sorted(r.file_id for r in invalid_files(files).collect()) == [3, 7]
    results = spark.createDataFrame([(2, "Python", T0), (2, "py", T0), (7, None, None)], "file_id bigint, language string, scanned_at timestamp")
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in invalid_rates(files, results).collect()}
    assert rates == {("r", "python"): (2, 1), ("", "python"): (1, 1), ("r", "javascript"): (1, 0)}
    assert invalid_files(files.limit(0)).count() == 0


def test_first_error_is_named(spark):
    files = spark.createDataFrame([(1, "r", "a.js", "let a = 1;\nlet b = ;\n")], "file_id bigint, repo string, path string, text string")
    (r,) = parsed_files(files).collect()
    assert (r.line, r.token) == (2, ";")


# --- problem 4

REPOS = "row_id bigint, batch_no int, name string, url string, languages array<struct<name:string,percentage:double>>, node string, key string"


def test_links_over_batches(spark):
    a, b = [("Python", 60.0), ("Go", 40.0)], [("Python", 60.3), ("Go", 39.7)]
    rows = [
        (1, 0, "o/parser", "https://h/o/parser", a), (2, 0, "O/Parser", "git@h:O/Parser.git", a), (3, 0, "o/other", "https://h/o/other/", [("Rust", 100.0)]), (4, 1, None, "http://www.h/o/par%73er?tab=x#y", None),
        (5, 1, "p/parser", "https://h/p/parser", b), (6, 1, "q/the-parser", "https://h/q/the-parser", b), (7, 1, "q/parser", "https://h/q/parser", [("Python", 61.5), ("Go", 38.5)]), (8, 2, "o/other", None, []),
        (9, 2, None, None, a), (10, 2, "z/parsre", "https://h/z/parsre", [("Python", 60.2), (None, 39.8)]), (11, 2, "z/lexer", "https://h/z/lexer", a), (12, 2, "z/lexer", "https://h/z/lexer", [None]),
    ]
    got = sorted(map(tuple, linked_batches(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS)).collect()))
    assert got == [(1, 2), (1, 4), (1, 5), (1, 6), (1, 10), (3, 8), (11, 12)]


def test_hot_name_is_one_cell(spark):
    rows = [(i, i // 100, f"o{i}/starter", f"https://h/o{i}/starter", [("Python", 100.0)], "n", "k") for i in range(200)]
    got = linked_batches(spark.createDataFrame(rows, REPOS)).collect()
    assert len(got) == 199 and {r.first_row_id for r in got} == {0}


def test_later_row_joins_two_clusters(spark):
    rows = [(1, 0, "a/kit-moreba", "https://h/a/kit-moreba", [("Go", 70.0), ("C", 30.0)]), (2, 0, "b/the-kit-morebax", "https://h/b/the-kit-morebax", [("Go", 70.0), ("C", 30.0)]), (3, 1, "c/kit-morebax", "https://h/c/kit-morebax", [("Go", 70.0), ("C", 30.0)]), (4, 2, "b/the-kit-morebax", "https://h/b/the-kit-morebax", None)]
    got = sorted(map(tuple, linked_batches(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS)).collect()))
    assert got == [(1, 2), (1, 3), (1, 4)]
    assert linked_batches(spark.createDataFrame([], REPOS)).count() == 0


def test_late_languages_meet_what_came_between(spark):
    a = [("Go", 70.0), ("C", 30.0)]
    rows = [(5, 0, "x/kit-moreba", "https://h/x/kit-moreba", None), (100, 1, "y/kit-moreba", "https://h/y/kit-moreba", a), (200, 2, "x/kit-moreba", "https://h/x/kit-moreba", a)]
    got = sorted(map(tuple, linked_batches(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS)).collect()))
    assert got == [(5, 100), (5, 200)]


def test_every_address_of_a_cell_is_compared(spark):
    for last in (0, 1):
        rows = [(i, b, f"o{i}/starter", f"https://h/o{i}/starter", [("Go", x)], "n", "k") for i, b, x in ((0, 0, 10.0), (1, 0, 10.24), (2, last, 10.7))]
        assert sorted(map(tuple, linked_batches(spark.createDataFrame(rows, REPOS)).collect())) == [(0, 1), (0, 2)]


def test_comparisons():
    assert [name_level(*p) for p in (("a-b", "a_B"), ("the-kit", "kit"), ("parser", "prser"), ("parser", "lexer"), ("", ""))] == [0, 1, 2, 4, 0]
    assert edits("abcd", "abdc") == 1
    x = lambda **k: [{"name": n, "share": s} for n, s in k.items()]
    assert [share_level(x(a=60, b=40), y) for y in (x(a=60.1, b=39.9), x(a=60.5, b=39.5), x(a=60.6, b=39.4), x(a=60, c=40), [{"name": "a", "share": 60}, None])] == [0, 1, 2, 2, 0]


def test_comparisons_as_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    names = [("a-b", "a_B"), ("the-kit", "kit"), ("parser", "prser"), ("parser", "lexer"), ("", ""), ("abcdefghijkl", "abdcefghijkl"), ("abcdefghijkl", "abdcefghijkx"), ("ab", "ab-c"), ("", "x")]
    for _ in range(300):
        word = "".join(rng.choice("abc-") for _ in range(rng.randint(0, 13)))
        other = list(word)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(other))
            other[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "x", "-"])
        names.append((word, "".join(other)))
    shares = []
    for _ in range(300):
        x = [(n, round(rng.uniform(0, 99), 1)) for n in rng.sample("pqrs", rng.randint(1, 4))]
        y = [(n if rng.random() < 0.9 else rng.choice(["t", None]), s + rng.choice([0, 0.1, -0.2, 0.3, 0.5, 0.6])) for n, s in x]
        shares.append((x, y if rng.random() < 0.8 else y[:-1]))
    kind = "array<struct<name:string,share:double>>"
    rows = spark.createDataFrame([(*names[i % len(names)], *shares[i % len(shares)]) for i in range(310)], f"a string, b string, x {kind}, y {kind}")
    wide = lambda c: F.transform(F.array_sort(c), lambda e: F.struct(e["name"].alias("name"), e["share"].alias("least"), e["share"].alias("most")))
    got = rows.select("*", linkage.name_level(linkage.name_words(F.col("a")), linkage.name_words(F.col("b"))).alias("n"), linkage.share_level(linkage.apart(wide("x"), wide("y"), F.lit(0), F.lit(0))).alias("s")).collect()
    assert [(r.a, r.b, r.n) for r in got if r.n != name_level(r.a, r.b)] == []
    plain = [r for r in got if all(e.name for e in [*r.x, *r.y])]
    assert len(plain) > 100 and [(r.x, r.y) for r in plain if r.s != share_level(r.x, r.y)] == []


def brute_pairs(rows):
    """Union-find over all pairs of rows of one host: address, or name and shares of the address's first row with languages."""
    said, first, root = {}, {}, {}
    for i, _, name, url, langs in sorted(rows):
        addr = (url or f"https://h/{name}").lower().removesuffix("/")
        first.setdefault(addr, i)
        said.setdefault(addr, None)
        if langs and said[addr] is None:
            said[addr] = (addr.rsplit("/", 1)[-1], [{"name": n, "share": s} for n, s in langs])

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    known = [(a, v) for a, v in said.items() if v]
    for k, (a, (n, x)) in enumerate(known):
        for b, (m, y) in known[:k]:
            if name_level(n, m) < 4 and share_level(x, y) < 2:
                p, q = sorted((find(a), find(b)), key=first.get)
                root[q] = p
    return sorted((first[find(a)], i) for i, _, name, url, _ in rows for a in [(url or f"https://h/{name}").lower().removesuffix("/")] if first[find(a)] != i)


def many_rows(n, batches, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(["starter", "parser", "the-parser", "parsre", "kit-moreba", "kit-morebax", "lexer"]) if rng.random() < 0.7 else f"n{rng.randrange(9)}{'abcdefghij'[rng.randrange(10)] * 3}x"
        base = rng.choice([20.0, 20.3, 20.55, 21.0, 40.0])
        langs = rng.choice([[("Go", base), ("C", 100 - base)], [("Go", base), ("C", 70 - base + rng.choice([0, 0.2, 0.45])), ("D", 30.0)], None, [("Go", 100.0)]])
        rows.append((i, i * batches // n, f"o{rng.randrange(n // 2)}/{name}", None, langs))
    return [(i, b, name, f"https://h/{name}", langs) for i, b, name, _, langs in rows]


def test_against_all_pairs(spark):
    rows = many_rows(150, 3)
    got = sorted(map(tuple, linked_batches(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS)).collect()))
    assert got == brute_pairs(rows) and len(got) > 30


def test_state_goes_on_in_another_session(spark, tmp_path):
    rows = many_rows(120, 3, seed=5)
    repos = plain_rows(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS), "h")
    first = Linker(spark, f"file://{tmp_path}/state", "h")
    for b in (0, 1):
        first.add(b, repos.where(f"batch_no = {b}"))
    before = sorted(map(str, tmp_path.rglob("batch_no=[01]/*.parquet")))
    other = Linker.open(spark.newSession(), f"file://{tmp_path}/state")
    assert (other.done, other.counts, other.weights, other.parts) == (first.done, first.counts, first.weights, first.parts)
    for _ in range(2):  # a repeated batch changes nothing
        other.add(2, repos.where("batch_no = 2"))
    assert sorted(map(str, tmp_path.rglob("batch_no=[01]/*.parquet"))) == before
    assert sorted(map(tuple, repeated_rows(other.assigned(repos)).collect())) == brute_pairs(rows)


def test_waiting_batches_are_one_step(spark, tmp_path):
    rows = many_rows(120, 12, seed=7)
    table = spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS)
    spark.sparkContext.setJobGroup("linkage-jobs", "jobs of all batches")
    try:
        got = sorted(map(tuple, linked_batches(table).collect()))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("linkage-jobs")) < 120  # each of 12 steps would take dozens
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    repos = plain_rows(table, "h")
    linker = Linker(spark, f"file://{tmp_path}/state", "h")
    linker.add(9, repos.where("batch_no < 10"), range(10))
    linker.add(11, repos.where("batch_no > 8"), (9, 10))  # batch 9 was taken in before
    other = Linker.open(spark, f"file://{tmp_path}/state")
    assert linker.done == other.done == list(range(12))
    assert got == sorted(map(tuple, repeated_rows(other.assigned(repos)).collect())) == brute_pairs(rows)


def test_stored_keys_are_a_cells_spellings(spark, tmp_path):
    shares = [(11.8, 88.2), (12.2, 87.8), (12.9, 87.1)]  # the first two are in other classes; the last is near neither
    rows = [(i, b, f"o{i}/{name}", f"https://h/o{i}/{name}", [("Go", x), ("C", y)]) for i, (b, name, (x, y)) in enumerate(zip((0, 0, 0, 1, 1), ("kit-moreba", "kit-morebax", "kit-moreba", "kit-morebax", "kitmorxba"), (*shares, *shares[1::-1])))]
    repos = plain_rows(spark.createDataFrame([(*r, "n", "k") for r in rows], REPOS), "h")
    linker = Linker(spark, f"file://{tmp_path}/state", "h")
    for b in (0, 1):
        linker.add(b, repos.where(f"batch_no = {b}"))
    spelled = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    ends = {0: {"kit", "moreba"}, 1: {"kit", "morebax"}, 2: {"kit", "moreba"}, 3: {"kit", "morebax"}, 4: set()}
    want = {i: len(spelled(r[2].split("/")[1].replace("-", "")) | ends[i]) for i, r in enumerate(rows)}
    assert {r.cell: r["count"] for r in linker.history("keys").groupBy("cell").count().collect()} == want
    assert sorted(map(tuple, repeated_rows(linker.assigned(repos)).collect())) == brute_pairs(rows) == [(0, 1), (0, 3), (0, 4)]


def test_ranges_that_do_not_decide_are_looked_at(spark):
    far = [(0, "a", 10.0, 30.0), (1, "b", 10.24, 30.24), (2, "c", 10.7, 30.0 + 0.5)]  # no address of the cell is near in both
    near = [(0, "a", 10.0, 30.0), (1, "b", 10.24, 30.24), (2, "c", 10.7, 30.7)]
    for cells, want in ((near, [(0, 1), (0, 2)]), ([(0, "a", 10.0, 30.24), (1, "b", 10.24, 30.0), (2, "c", 10.7, 30.7)], [(0, 1)]), (far, [(0, 1), (0, 2)])):
        rows = [(i, i // 2, f"{o}/starter", f"https://h/{o}/starter", [("Go", x), ("C", y), ("D", 5.0)], "n", "k") for i, o, x, y in cells]
        assert sorted(map(tuple, linked_batches(spark.createDataFrame(rows, REPOS)).collect())) == want


def test_learned_weights_decide():
    often, never = {"201": 400, "311": 300, "001": 300, "421": 500}, {"000": 300, "001": 40, "321": 90_000, "311": 4, "421": 500}
    assert "311" in accepted(learn_weights(often)) and "311" not in accepted(learn_weights(never))
    assert "001" in accepted(learn_weights(never))


# --- problem 6


def test_packing(spark):
    if not __import__("os").path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(rng.choice((3, 40, 150))))) for i in range(150)] + [(900, None), (901, ""), (902, "x y " * 4000), (903, "same text"), (903, "same text")]
    plan = packed(spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id bigint, text string, tokens int, container string"), capacity=256, shard_items=40).persist()
    fills = {}
    for r in plan.collect():
        fills[r.container] = fills.get(r.container, 0) + r.tokens
    assert max(fills.values()) <= 256 and {900, 901}.isdisjoint({r.doc_id for r in plan.collect()})
    assert plan.where("doc_id = 903").count() == 2
    long = sorted((r.piece, r.tokens) for r in plan.where("doc_id = 902").collect())
    assert len(long) > 20 and all(t == 256 for _, t in long[:-1])
    report = fill_report(plan, 256).first()
    assert report.containers <= report.least_possible * 1.03 + 2
    assert packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_evolution_never_overfills_or_loses():
    import numpy as np

    sizes = np.sort(np.random.default_rng(1).integers(1, 100, 120))[::-1].copy()
    best = evolved(sizes, [], 100, 7)
    for a in best:
        assert len(a) == len(sizes) and (a >= 0).all() and np.bincount(a, sizes).max() <= 100
    assert -fitness(best[0], sizes, 100)[0] <= -(-int(sizes.sum()) // 100) + 3


def test_crossover_beats_best_fit_on_hard_sizes():
    import numpy as np

    from tessera.llm.packing import best_fit

    rng = np.random.default_rng(3)
    plain = bred = 0
    for seed in range(4):
        sizes = []
        for _ in range(20):  # triples that fill a container exactly
            a = int(rng.integers(380, 500))
            b = int(rng.integers(250, (1000 - a) // 2 + 1))
            sizes += [a, b, 1000 - a - b]
        sizes = np.sort(sizes)[::-1].copy()
        assign, room = np.full(len(sizes), -1), []
        best_fit(np.arange(len(sizes)), assign, room, sizes, 1000)
        best = evolved(sizes, [], 1000, seed)[0]
        assert np.bincount(best, sizes).max() <= 1000
        plain, bred = plain + len(room), bred - fitness(best, sizes, 1000)[0]
    assert bred <= plain - 3


# --- problem 1


def test_giveaways_are_masked():
    assert (handwritten.head_features("# Generated by x. DO NOT EDIT.\n") == handwritten.head_features("# by x. .\n")).all()


def test_parts_of_files():
    head, body = split_head("#!/x\n# made by us\n\nimport a\n# not head\n")
    assert head == "#!/x\n# made by us\n\n" and body == "import a\n# not head\n"
    assert is_data("\n".join('  "a": 12, "b": [1.5e3, null],' for _ in range(9))) and not is_data("import a\nx = f(1)\n" * 9) and not is_data("")
    text = [f"line {i}" for i in range(40)]
    assert set(fingerprints("\n".join(text))) & set(fingerprints("\n".join(["a", "b", *text[10:18], "c"])))


def test_classifier_small_cases(spark):
    rng = random.Random(8)
    own = lambda: "\n".join(f"def {rng.choice('abcdef')}{rng.randrange(99)}(x{rng.randrange(9)}):\n    return run(x, {rng.randrange(9)}, name='{rng.choice(['red', 'blue'])}')\n" for _ in range(12))
    tool = lambda: "\n".join(f"_M{rng.randrange(99)} = _pool.Field(number={rng.randrange(99)}, kind=_K.T{rng.randrange(9)}, label=_L.REQ)" for _ in range(40))
    rows = []
    for i in range(160):
        repo = f"o/r{i % 20}"
        if i % 4 == 0:
            rows.append((i, repo, f"src/gen/m{i}_pb2.py", ("# Generated by x. DO NOT EDIT.\n" if i % 8 else "") + tool()))
        else:
            rows.append((i, repo, f"src/core/m{i}.py", "# Copyright the authors\n" + own()))
    rows += [(900, "o/r1", "src/core/hidden.py", tool()), (901, None, None, ""), (902, "o/r1", "x.py", None), (903, "o/r2", "src/core/long.py", own() * 500)]
    files = spark.createDataFrame([(*r, "v", "h") for r in rows], "file_id bigint, repo string, path string, text string, view string, head string")
    results = spark.createDataFrame([(0, "generated"), (1, "unsupported extension"), (None, None)], "file_id bigint, skipped_reason string")
    got = {r.file_id for r in not_handwritten(files, results).collect()}
    assert got == {i for i in range(0, 160, 4)} | {900}
    assert not_handwritten(files.limit(0), results).count() == 0


def test_places(spark):
    from pyspark.sql import functions as F

    same = ["https://h/O/R", "http://www.h/o/r/", "git@h:o/r.git", "ssh://git@h/o/r", "git+https://h/o/r.git@v1", "h/o/r", " HTTPS://H/o/r \n", "https://h/o/r/tree/main?x=1#y", "https://h/o/%72"]
    got = {r.p for r in spark.createDataFrame([(u,) for u in same], "u string").select(place(F.col("u")).alias("p")).collect()}
    assert got == {"h/o/r"}


def test_findings_with_backslash_paths(spark, monkeypatch):
    files = spark.createDataFrame([(1, "O/r", "src/verdict_x.ts"), (2, "O/r", "src/own.ts")], "file_id bigint, repo string, path string")
    found = spark.createDataFrame([("o/R", r"src\verdict_x.ts"), ("o/R", r"src\\verdict_x.ts"), ("o/R", r".\src\own.ts")], "repo_name string, file string")
    monkeypatch.setattr(handwritten, "not_handwritten", lambda *_: files.where("file_id = 1").select("file_id"))
    assert [r.file for r in handwritten.handwritten_findings(found, files, None).collect()] == [r".\src\own.ts"]
