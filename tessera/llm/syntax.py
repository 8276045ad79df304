"""Source files that do not parse (problem 2).

Each text is read by the lexer of its suffix's language and its whole token stream is run through generalised LR tables made from
the bundled grammars (``grammars/``). The first token at which no parse goes on is the file's first unrecoverable error. Text of
``.js`` files is tried as a module and as CommonJS. Nesting may be of any depth.

The tables are made once on the driver and sent to the tasks (under 1 MB, they depend on the grammars only); a task keeps what it
remembers of line forms within a bound. Files are independent: one narrow pass, no shuffle; the rates are one grouped count.

Defined results: null texts and suffixes of other languages give no row; empty text parses; a text the lexer cannot read at all
(null characters, unended strings) is invalid at that place; repeated ids give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexing import python_lines, script_lines
from tessera.llm.parsing import Recogniser, Tables, tables

#: The dialects to try for a suffix (grammar and flags), and the lexer's modes.
DIALECTS: dict[str, tuple[tuple[str, frozenset[str]], ...]] = {
    "py": (("python", frozenset()),),
    "js": (("script", frozenset({"module"})), ("script", frozenset())),
    "mjs": (("script", frozenset({"module"})),),
    "cjs": (("script", frozenset()),),
    "jsx": (("script", frozenset({"module", "jsx"})),),
    "ts": (("script", frozenset({"module", "ts"})),),
    "mts": (("script", frozenset({"module", "ts"})),),
    "cts": (("script", frozenset({"module", "ts"})),),
    "tsx": (("script", frozenset({"module", "ts", "jsx"})),),
}
_TWINS = {"{": ("B{", "O{"), "function": ("Dfunction", "Efunction"), "class": ("Dclass", "Eclass")}
_FORCED = frozenset({"return", "break", "continue", "throw"})
_LOOSE = frozenset({"++", "--"})


class Parser:
    """First errors of texts, by suffix."""

    def __init__(self, made: dict[tuple[str, frozenset[str]], Tables]):
        self.by = {
            key: Recogniser(t) if key[0] == "python" else Recogniser(t, _TWINS, "ASI", frozenset({"}", "$end"}), frozenset({"["} if "ts" in key[1] else ())) for key, t in made.items()
        }

    def error(self, suffix: str, text: str) -> tuple[int, str] | None:
        """Line and token of the first error, or nothing."""
        if not text:
            return None
        if suffix == "py":
            lines, numbers = python_lines(text)
        else:
            lines, numbers = script_lines(text, jsx=suffix.endswith("x"), ts="ts" in suffix)
        worst = (-1, -1)
        for key in DIALECTS[suffix]:
            at = self.by[key].parse(lines, _FORCED if suffix != "py" else frozenset(), _LOOSE if suffix != "py" else frozenset())
            if at is None:
                return None
            worst = max(worst, at)
        return numbers[worst[0]], lines[worst[0]][worst[1]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def parsed_files(files: DataFrame) -> DataFrame:
    """``file_id, repo, suffix, invalid, line, token`` of every file with text in a known language."""
    wanted = {key for d in DIALECTS.values() for key in d}
    made = files.sparkSession.sparkContext.broadcast({key: tables(*key) for key in wanted})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(made.value)
        sys.setrecursionlimit(1_000_000)  # nested templates and elements are read by functions that call one another; their frames are on the heap
        for b in batches:
            errors = [parser.error(s, t) for s, t in zip(b["suffix"], b["text"])]
            yield pd.DataFrame({
                "file_id": b["file_id"], "repo": b["repo"], "suffix": b["suffix"], "invalid": [e is not None for e in errors],
                "line": pd.Series([e[0] if e else None for e in errors], dtype="Int64"), "token": [e[1] if e else None for e in errors],
            })

    known = files.where("text is not null").select("file_id", "repo", suffix(F.col("path")).alias("suffix"), "text").where(F.col("suffix").isin(*DIALECTS))
    return known.mapInPandas(parse, "file_id bigint, repo string, suffix string, invalid boolean, line bigint, token string")


def invalid_files(files: DataFrame) -> DataFrame:
    """``file_id`` of the files that do not parse."""
    return parsed_files(files).where("invalid").select("file_id")


#: Spellings of languages in scanner results.
_LANGUAGES = {"py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript"}


def invalid_rates(files: DataFrame, results: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_invalid, rate``: per repository (in lower case) and the scanner's language; where it gave none, the suffix's."""
    plain = F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair])
    told = results.select(F.col("file_id").alias("r_id"), plain[F.lower(F.trim("language"))].alias("told"), "scanned_at").where("told is not null")
    told = told.groupBy("r_id").agg(F.max_by("told", F.struct("scanned_at", "told")).alias("told"))
    own = F.when(F.col("suffix") == "py", "python").when(F.col("suffix").contains("ts"), "typescript").otherwise("javascript")
    return (
        parsed_files(files).join(told, F.col("file_id") == F.col("r_id"), "left")
        .groupBy(F.lower(F.coalesce("repo", F.lit(""))).alias("repo"), F.coalesce("told", own).alias("language"))
        .agg(F.count("*").alias("n_files"), F.count_if("invalid").alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )


def first_errors(files: DataFrame) -> DataFrame:
    """``file_id, suffix, line, token``: the first unrecoverable error of each file that does not parse."""
    return parsed_files(files).where("invalid").select("file_id", "suffix", "line", "token")
