"""Scalar functions over addresses, paths and texts, as Spark columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_key(value: Column) -> Column:
    """The last two parts of an address in lower case, without final slashes and one ``.git``; null stays null."""
    x = F.regexp_replace(F.regexp_replace(F.trim(value), r"/+$", ""), r"\.git$", "")
    parts = F.split(x, "/")
    n = F.size(parts)
    return F.lower(F.when(n >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(x))


def requirement_names(text: Column) -> Column:
    """Names of a requirements text: each line up to ``=``, ``>``, ``<`` or ``[``; blank and comment lines are left out."""
    names = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(F.trim(line), r"[=><\[].*$", "")))
    return F.filter(names, lambda n: (n != "") & ~n.startswith("#"))


def package_dependencies(text: Column) -> Column:
    """Names under ``dependencies`` and ``devDependencies`` of a package.json text; anything unreadable has none."""
    kind = "map<string,string>"
    both = F.map_keys(F.from_json(F.get_json_object(text, "$.dependencies"), kind)), F.map_keys(F.from_json(F.get_json_object(text, "$.devDependencies"), kind))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(both[0], none), F.coalesce(both[1], none)))


def truncated(text: Column, most: int) -> Column:
    """``text`` cut to ``most`` characters, with a mark if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... [truncated]"))).otherwise(text)


#: The beginnings of HTML tags whose marks are dropped from Markdown, and what else is taken out of it (comments, images, links without text).
TAGS = r"p|div|a|picture|source|br|span|h\d|sup|sub|b|strong|em|center|details|summary|table|tr|td|th|img"
MARKDOWN_NOISE = (r"(?s)<!--.*?-->", r"!\[[^\]]*\]\([^)]*\)", r"\[\s*\]\([^)]*\)", rf"(?i)</?(?:{TAGS})[^>]*>")
#: Fixed value: white space at the ends of a text, as far as texts have it.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")


def clean_markdown(text: Column) -> Column:
    """Markdown without comments, images, empty links and the marks of common tags; three and more line ends become two."""
    for noise in MARKDOWN_NOISE:
        text = F.regexp_replace(text, noise, "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


#: The tokens of a yes or no in tables of several languages.
TRUE_TOKENS = ("1", "true", "t", "yes", "y", "sim", "s", "x", "v")
FALSE_TOKENS = ("", "0", "false", "f", "no", "n", "nao", "não", "-", "na", "n/a", "none", "null")


def yes_or_no(value: Column) -> Column:
    """A boolean of a token, null for a null, an error for anything else."""
    x = F.lower(F.trim(value))
    return F.when(x.isin(*TRUE_TOKENS), True).when(x.isin(*FALSE_TOKENS), False).when(x.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("neither yes nor no: "), x)).cast("boolean"))


#: Lower ends of the star classes.
STAR_CLASSES = ((0, "< 10"), (10, "10 - 99"), (100, "100 - 999"), (1000, "1k - 9.9k"), (10000, "10k+"))


def star_class(stars: Column) -> Column:
    """The class of a number of stars; null for null or negative numbers."""
    out = F.lit(None).cast("string")
    for least, name in STAR_CLASSES:
        out = F.when(stars >= least, F.lit(name)).otherwise(out)
    return out


def store_role(writes: Column, reads: Column) -> Column:
    return F.when((writes > 0) & (reads > 0), "read_write").when(writes > 0, "write_only").when(reads > 0, "read_only").otherwise("unused")


def module_keys(path: Column) -> Column:
    """All dotted names under which a Python file can be imported: every suffix of its path; ``__init__`` is dropped."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.py$", ""), "/"), lambda x: (x != "") & (x != ".") & (x != "__init__"))
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(parts, i, n)))).otherwise(F.array().cast("array<string>"))


#: Markers of text that came from outside, in their order, and words of a check.
TAINT_MARKERS = ("request", "response", ".text", ".content", "http", "fetch", "tool_output", "tool_result", "retrieved", "retrieval", "user_input", "external", "web_content")
SANITIZER_WORDS = ("validate", "sanitize", "clean", "escape", "schema", "pydantic")
SCRIPT_TAINT_MARKERS = (*TAINT_MARKERS, "req.body", "req.query", "req.params")
SCRIPT_SANITIZER_WORDS = (*SANITIZER_WORDS, "zod", "safeparse", "dompurify")


def first_marker(text: Column, markers: tuple[str, ...] = TAINT_MARKERS) -> Column:
    """The first of ``markers``, in their order, that the text contains in any case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: Folders whose files are not scanned (case matters), names of test files, and the languages of suffixes.
EXCLUDED_FOLDERS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".turbo", "site-packages", ".mypy_cache", ".pytest_cache", "coverage",
    ".tox", "vendor", "test", "tests", "evals", "examples", "example", "demo", "demos", "tutorial", "tutorials", "showcase", "cookbook",
)
TEST_NAMES = r"(?i)\.(?:test|spec)\.[cm]?[jt]sx?$|(?:^|/)test_[^/]+\.py$|_test\.py$"
SUFFIX_LANGUAGES = {".py": "python"} | dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"), "javascript")


def scanned_path(path: Column) -> Column:
    """Whether a file is looked at: in no excluded folder, and not named like a test."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in EXCLUDED_FOLDERS])) & ~path.rlike(TEST_NAMES)


def suffix_language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair])[suffix(path)]


def owner_repo(entry: Column) -> Column:
    """``owner/repo`` of an address or a name in any of the usual spellings; null if it has fewer than two parts."""
    x = F.regexp_replace(F.trim(entry), r"^(?:https?://(?:www\.)?[^/]+/|git@[^:]+:|ssh://git@[^/]+/)", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(x, r"^/+|/+$", ""), r"\.git$", ""), "/")
    return F.when((F.size(parts) >= 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != ""), F.concat_ws("/", F.get(parts, 0), F.regexp_replace(F.get(parts, 1), r"\.git$", "")))


def repo_at_host(url: Column, host: str) -> Column:
    """The first two parts of an address at ``host``; null for other hosts and shorter paths."""
    found = F.regexp_extract(F.trim(url), rf"(?i)^(?:https?://)?(?:www\.)?{host.replace('.', chr(92) + '.')}/([^/?#\s]+/[^/?#\s]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.git$", ""), F.lit(""))


def rounded(value: Column, places: int = 2) -> Column:
    """``value`` rounded to the nearest by its exact binary value, ties to even; Spark's own functions round the shortest decimal instead."""

    @F.pandas_udf("double")
    def nearest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else round(v, places)).astype("float64")

    return nearest(value.cast("double"))


def without_comments(script: Column) -> Column:
    """A script without block comments and then without line comments; ``//`` within strings goes too."""
    return F.regexp_replace(F.regexp_replace(script, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def plain_label(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """A table cell's label without bold marks and back quotes, in its usual spelling."""
    x = F.trim(label)
    for wrapped in (r"^\*\*(.+)\*\*$", "^`(.+)`$"):
        x = F.trim(F.regexp_replace(x, wrapped, "$1"))
    return F.coalesce(F.create_map(*[F.lit(y) for pair in aliases.items() for y in pair])[x], x) if aliases else x


def store_id(file: Column, line: Column, col: Column) -> Column:
    """``file:line:col`` of the place where a store is made; null without a place."""
    return F.when(line.isNotNull() & col.isNotNull(), F.concat_ws(":", file, line.cast("string"), col.cast("string")))


#: The endings tried for a relative import of a script, in their order.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")


def plain_folders(path: Column) -> Column:
    """A path without ``.`` and with ``..`` resolved; those that lead above the root stay."""
    step = lambda seen, x: F.when((x == "") | (x == "."), seen).when((x == "..") & (F.size(seen) > 0) & (F.element_at(seen, -1) != ".."), F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def script_paths(target: Column) -> Column:
    """The paths that a relative import of ``target`` may mean, in the order in which they are tried."""
    stem = F.regexp_replace(target, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(
        F.array(target), F.array(*[F.concat(stem, F.lit(e)) for e in SCRIPT_ENDINGS]), F.array(*[F.concat(target, F.lit(e)) for e in SCRIPT_ENDINGS]), F.array(*[F.concat(target, F.lit(f"/index{e}")) for e in SCRIPT_ENDINGS])
    )


#: The labels of short answers, and words that say an answer does not decide.
ANSWERS = ("app", "framework", "needs_review")
UNCLEAR = ("needs review", "needs_review", "unclear", "ambiguous")


def _object(text: Column) -> Column:
    return F.regexp_extract(text, r"\{[^{}]*\}", 0)


def _named(text: Column) -> Column:
    """The label in the first object of ``text``, or null; a label that is no string is none."""
    label = F.lower(F.trim(F.get_json_object(_object(text), "$.classification")))
    return F.when(label.isin(*ANSWERS), label)


def answer_label(text: Column) -> Column:
    """A free answer's label: of its first object, else by words; where both kinds are named, the one named last."""
    low = F.lower(text)
    last = lambda word: F.length(low) - F.instr(F.reverse(low), word[::-1])
    framework, app = F.contains(low, F.lit("framework")), F.contains(low, F.lit("app"))
    words = (
        F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in UNCLEAR]), "needs_review")
        .when(framework & app, F.when(last("framework") - len("framework") > last("app") - len("app"), "framework").otherwise("app"))
        .when(framework, "framework").when(app, "app").otherwise("needs_review")
    )
    return F.when(text.isNull() | (text == ""), "needs_review").otherwise(F.coalesce(_named(text), words))


def object_label(text: Column) -> Column:
    """A label by the first object alone; anything else needs review."""
    return F.coalesce(_named(text), F.lit("needs_review"))


def object_reason(text: Column) -> Column:
    """The reason beside ``object_label``; of an unreadable answer its beginning."""
    return F.when(_named(text).isNotNull(), F.coalesce(F.get_json_object(_object(text), "$.reasoning"), F.lit(""))).otherwise(F.concat(F.lit("UNPARSED: "), F.substring(F.coalesce(text, F.lit("")), 1, 300)))


def valid_answer(text: Column, labels: tuple[str, ...]) -> Column:
    """``label, reason`` of an answer that is exactly an object of these two, with a known label and a reason that is not blank; null otherwise."""
    x = stripped(text)
    keys = F.array_sort(F.json_object_keys(x))
    label, reason = F.get_json_object(x, "$.label"), F.get_json_object(x, "$.reason")
    field = r'"(?:label|reason)"\s*+:\s*+"(?:[^"\\]|\\.)*+"\s*+'
    whole = x.rlike(rf"^\{{\s*{field},\s*{field}\}}$") & F.try_parse_json(x).isNotNull()
    return F.when(whole & (keys == F.array(F.lit("label"), F.lit("reason"))) & label.isin(*labels) & (stripped(reason) != ""), F.struct(label.alias("label"), reason.alias("reason")))


def iso_time(at: Column) -> Column:
    """A time in UTC as text, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
