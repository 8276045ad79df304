"""Tokens of Python, JavaScript and TypeScript texts as kinds by line, for the recogniser.

A lexer gives ``(lines, numbers)``: for each line of the parse its token kinds, and the line of the text it began at. What no rule
of the language covers (a string without end, a stray character) is the kind ``ERROR``, which no grammar has.
"""

from __future__ import annotations

import re

#: Python's keywords, and its soft keywords that grammar rules mention.
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield match case type".split()
)
_PY = re.compile(
    r"""[ \t\f]*(?:
    (?P<name>[^\W\d][\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f\u00b7]*)
  | (?P<number>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)
  | (?P<quote>\"\"\"|'''|"|')
  | (?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^]=|[-+*/%@&|^~<>=()\[\]{},:;.])
  | (?P<end>\#[^\n]*|\n|\\\n|\Z)
  )""",
    re.X,
)
_PREFIX = re.compile(r"(?i)^(?:[rbuft]|br|rb|fr|rf|tr|rt)$")
_AUG = frozenset("**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\[\s\S])*{q}") for q in "\"'"} | {q * 3: re.compile(rf"(?:[^{q}\\]|\\[\s\S]|{q}(?!{q}{q}))*{q}{q}{q}") for q in "\"'"}
_FBODY = re.compile(r"[^{}\\\n\"']+|\\[\s\S]|\{\{|\}\}|[\s\S]")


def _f_string(text: str, i: int, quote: str, raw: bool) -> int:
    """The end of a formatted string whose body starts at ``i``, or -1: fields may hold strings with the same quotes."""
    depth: list[int] = []  # in a field: how many brackets are open; a format spec is a body again
    spec = 0
    n = len(text)
    while i < n:
        c = text[i]
        if not depth:
            if text.startswith(quote, i):
                return i + len(quote)
            if c == "\\" and not (raw and text[i + 1 : i + 2] in "{}"):
                i += 2
                continue
            if c == "\n" and len(quote) == 1:
                return -1
            if c == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                depth.append(0)
                if re.compile(r"\s*[}!:]").match(text, i + 1):
                    return -1
            elif c == "}":
                if not text.startswith("}}", i):
                    return -1
                i += 2
                continue
            i += 1
            continue
        if depth[-1] < 0:  # a format spec
            if text.startswith(quote, i) or (c == "\n" and len(quote) == 1):
                return -1
            if c == "{":
                depth.append(0)
            elif c == "}":
                depth.pop()
            i += 1
            continue
        if c in "\"'":
            q = c * 3 if text.startswith(c * 3, i) else c
            before = re.search(r"[A-Za-z]{0,2}$", text[max(0, i - 2) : i])[0].lower()
            if "f" in before:
                i = _f_string(text, i + len(q), q, "r" in before)
                if i < 0:
                    return -1
            else:
                m = _BODY[q].match(text, i + len(q))
                if not m:
                    return -1
                i = m.end()
            continue
        if c in "([":
            depth[-1] += 1
        elif c == "{":
            depth[-1] += 1
        elif c in ")]":
            depth[-1] -= 1
            if depth[-1] < 0:
                return -1
        elif c == "}":
            if depth[-1]:
                depth[-1] -= 1
            else:
                depth.pop()
        elif c == ":" and not depth[-1] and not text.startswith(":=", i):
            depth[-1] = -1
        elif c == "#":
            return -1
        i += 1
    return -1


_INDENT = re.compile(r"[ \t\f]*")
_OCTAL, _AFTER, _JOINS = re.compile(r"0[0-9_]*[1-9]"), re.compile(r"[^\W\d]\w*"), re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


def python_lines(text: str) -> tuple[list[tuple[str, ...]], list[int]]:
    """Logical lines with NEWLINE, INDENT and DEDENT."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    lines: list[tuple[str, ...]] = []
    numbers: list[int] = []
    if "\0" in text:
        return [("ERROR",)], [1]
    indents, line, open_ = [(0, 0)], [], []
    i, number, n, fresh = 0, 1, len(text), True
    match = _PY.match
    began = 1
    while True:
        if fresh and not open_:
            m = _INDENT.match(text, i)
            head = m[0].rpartition("\f")[2]
            i = m.end()
            if i >= n or text[i] in "#\n":
                if i >= n:
                    break
                i = text.find("\n", i) + 1 or n
                number += 1
                continue
            wide, narrow = len(head.expandtabs(8)), len(head.expandtabs(1))
            began = number
            if wide > indents[-1][0]:
                line.append("INDENT" if narrow > indents[-1][1] else "ERROR")
                indents.append((wide, narrow))
            else:
                while wide < indents[-1][0]:
                    indents.pop()
                    line.append("DEDENT")
                if (wide, narrow) != indents[-1]:
                    line.append("ERROR")
            fresh = False
        m = match(text, i)
        if not m:
            line.append("ERROR")
            break
        group, word = m.lastgroup, m[m.lastgroup]
        i = m.end()
        if group == "name":
            if i < n and text[i] in "\"'" and _PREFIX.match(word):
                q = text[i] * 3 if text.startswith(text[i] * 3, i) else text[i]
                start = i + len(q)
                if "f" in word.lower():
                    end = _f_string(text, start, q, "r" in word.lower())
                else:
                    b = _BODY[q].match(text, start)
                    end = b.end() if b else -1
                    if b and "b" in word.lower() and not b[0].isascii():
                        end = -1
                if end < 0:
                    line.append("ERROR")
                    break
                number += text.count("\n", i, end)
                i = end
                line.append("STRING")
            else:
                line.append(word if word in PY_WORDS else "NAME")
        elif group == "op":
            if word in _OPEN:
                open_.append(word)
            elif word in _CLOSE:
                if not open_ or _OPEN[open_.pop()] != word:
                    line.append("ERROR")
                    break
            line.append("AUGASSIGN" if word in _AUG else word)
        elif group == "number":
            if word[0] == "0" and _OCTAL.match(word) and word.replace("_", "").isdigit():
                line.append("ERROR")
                break
            after = _AFTER.match(text, i) if i < n and (text[i] == "_" or text[i].isalpha()) else None
            if after and not _JOINS.match(after[0]):
                line.append("ERROR")
                break
            line.append("NUMBER")
        elif group == "quote":
            b = _BODY[word].match(text, i)
            if not b:
                line.append("ERROR")
                break
            number += text.count("\n", i, b.end())
            i = b.end()
            line.append("STRING")
        elif word == "\n":
            number += 1
            if not open_:
                lines.append((*line, "NEWLINE"))
                numbers.append(began)
                line, fresh = [], True
        elif word == "\\\n":
            number += 1
            if i >= n:
                line.append("ERROR")
                break
        elif not word:
            if open_:
                line.append("ERROR")
            elif line:
                lines.append((*line, "NEWLINE"))
                numbers.append(began)
                line = []
            break
    if line and line[-1] == "ERROR":
        lines.append(tuple(line))
        numbers.append(number)
        return lines, numbers
    lines.append((*["DEDENT"] * (len(indents) - 1), "$end"))
    numbers.append(number)
    return lines, numbers


#: Words of ECMAScript and TypeScript that the grammar mentions.
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "let new null return super switch this throw true try typeof var void while with yield await async of get set static from as type interface namespace "
    "module declare abstract readonly public private protected override accessor keyof infer is asserts satisfies unique global out require implements".split()
)
_JS_SPACE = re.compile(r"(?:[ \t\v\f\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+|//[^\n]*)*")
_JS = re.compile(
    r"""(?P<name>\#?(?:[$_]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w\u200c\u200d\u00b7\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
  | (?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|[0-9](?:_?[0-9])*n|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)
  | (?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
  | (?P<tick>`)
  | (?P<op>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|\+\+|--|<<=|<<|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?![0-9])|<=|[-+*%&|^/]=|[-+*/%&|^!~?:;,.(){}\[\]<>=@])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_FLAGS = re.compile(r"/(?!.*(.).*\1)[dgimsuvy]*$")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JNAME = re.compile(r"[A-Za-z_$][\w$]*(?:-[\w$-]*)?(?:[.:][A-Za-z_$][\w$-]*)*")
_JSTRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
#: Kinds after which an operand is complete, so that ``/`` divides and ``<`` compares.
_WHOLE = frozenset("NAME PRIVATE NUMBER STRING REGEX TEMPLATE TEND this super null true false ] J/> J>".split()) | (
    JS_WORDS - frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new return switch throw try typeof var void while with yield await of as satisfies keyof is this super null true false".split())
)
_BEFORE_PAREN = frozenset("if while for with".split())
LINE = 24


#: An escape of a string or template that is no character.
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:[0-9a-fA-F]{1,5}|10[0-9a-fA-F]{4})\}))")
_REGEX_PART = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]|\((?:\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>))?|\)|[*+?]\??|\{\d+(?:,\d*)?\}\??|.", re.S)


def regex_is_whole(body: str) -> bool:
    """Whether groups are closed and every quantifier has something to repeat."""
    depth, bare = 0, True  # bare: there is nothing to repeat
    opened: list[bool] = []
    for m in _REGEX_PART.finditer(body):
        part = m[0]
        if part[0] == "(":
            if part == "(" and body.startswith("(?", m.start()):
                return False
            depth, bare = depth + 1, True
            opened.append(part.startswith("(?<") and part[3:4] in ("=", "!"))
        elif part == ")":
            depth -= 1
            if depth < 0:
                return False
            bare = opened.pop()  # what looks behind cannot be repeated
        elif part[0] in "*+?" or (part[0] == "{" and len(part) > 1):
            if bare:
                return False
            bounds = re.findall(r"\d+", part)
            if len(bounds) == 2 and int(bounds[0]) > int(bounds[1]):
                return False
            bare = True
        else:
            bare = part in ("|", "^") or part in ("\\b", "\\B")
    return depth == 0


class _Script:
    """One text's tokens; ``emit`` starts a new line of kinds where the text has one."""

    def __init__(self, text: str, jsx: bool, ts: bool):
        self.text, self.jsx, self.ts = text, jsx, ts
        self.lines: list[tuple[str, ...]] = []
        self.numbers: list[int] = []
        self.line: list[str] = []
        self.fresh, self.last, self.number, self.began = True, "", 1, 1
        self.failed = False

    def emit(self, kind: str) -> None:
        if self.fresh or len(self.line) >= LINE:
            if self.line:
                self.lines.append(tuple(self.line))
                self.numbers.append(self.began)
            self.line = [] if self.fresh else [""]
            self.began, self.fresh = self.number, False
        self.line.append(kind)
        self.last = kind

    def fail(self) -> int:
        self.emit("ERROR")
        self.failed = True
        return len(self.text)

    def space(self, i: int) -> int:
        text = self.text
        while True:
            i = _JS_SPACE.match(text, i).end()
            c = text[i : i + 1]
            if c == "\n":
                self.number += 1
                self.fresh = True
                i += 1
            elif c == "/" and text[i + 1 : i + 2] == "*":
                end = text.find("*/", i + 2)
                if end < 0:
                    return self.fail()
                lines = text.count("\n", i, end)
                if lines:
                    self.number += lines
                    self.fresh = True
                i = end + 2
            else:
                return i

    def template(self, i: int, depth: int, tagged: bool) -> int:
        """From behind the tick. A tag may make sense of any escape."""
        started = False
        while True:
            m = _TEMPLATE.match(self.text, i)
            if not m:
                return self.fail()
            if not tagged and "\\" in m[0] and _BAD_ESCAPE.search(m[0]):
                return self.fail()
            ends = m[1] == "`"
            self.emit(("TEND" if ends else "TMID") if started else ("TEMPLATE" if ends else "TSTART"))
            self.number += m[0].count("\n")
            i, started = m.end(), True
            if ends:
                return i
            i = self.run(i, depth + 1)
            if self.failed:
                return i

    def element(self, i: int, depth: int) -> int:
        """A JSX element from its ``<``."""
        text = self.text
        self.emit("J<")
        i = self.space(i + 1)
        m = _JNAME.match(text, i)
        name = m[0] if m else ""
        if m:
            self.emit("JNAME")
            i = m.end()
        while not self.failed:
            i = self.space(i)
            c = text[i : i + 1]
            if text.startswith("/>", i) and name:
                self.emit("J/>")
                return i + 2
            if c == ">":
                self.emit("J>")
                i += 1
                break
            m = _JNAME.match(text, i)
            if m:
                self.emit("JNAME")
                i = m.end()
            elif c == "=":
                self.emit("J=")
                i = self.space(i + 1)
                s = _JSTRING.match(text, i)
                if s:
                    self.emit("JSTRING")
                    self.number += s[0].count("\n")
                    i = s.end()
                elif text[i : i + 1] == "<":
                    i = self.element(i, depth + 1)
                elif text[i : i + 1] != "{":
                    return self.fail()
            elif c == "{":
                self.emit("J{")
                i = self.run(i + 1, depth + 1)
                if self.failed:
                    return i
                self.emit("J}")
            elif c == "<" and self.ts and self.last == "JNAME":
                return self.fail()
            else:
                return self.fail()
        while not self.failed:
            m = re.compile(r"[^<{}>]*").match(text, i)
            if m[0].strip():
                self.emit("JTEXT")
            lines = m[0].count("\n")
            if lines:
                self.number += lines
                self.fresh = True
            i = m.end()
            c = text[i : i + 1]
            if c == "{":
                self.emit("J{")
                i = self.run(i + 1, depth + 1)
                if self.failed:
                    return i
                self.emit("J}")
            elif c == "<":
                close = re.compile(r"<\s*/\s*").match(text, i)
                if not close:
                    i = self.element(i, depth + 1)
                    continue
                self.emit("J</")
                i = close.end()
                m = _JNAME.match(text, i)
                if (m[0] if m else "") != name:
                    return self.fail()
                if m:
                    self.emit("JNAME")
                    i = m.end()
                i = self.space(i)
                if text[i : i + 1] != ">":
                    return self.fail()
                self.emit("J>")
                return i + 1
            else:
                return self.fail()
        return i

    def run(self, i: int, depth: int) -> int:
        """Tokens up to the end, or in an embedded expression up to its closing brace, which is taken."""
        text, n = self.text, len(self.text)
        brackets: list[tuple[str, bool]] = []  # and whether an operand is complete behind the closing one
        whole = False
        while not self.failed:
            if text[i : i + 1] == " ":
                i += 1
            c = text[i : i + 1]
            if not "!" <= c <= "~" or c == "/":  # most tokens follow one blank or none
                i = self.space(i)
            if i >= n or self.failed:
                if depth or brackets:
                    return self.fail()
                return i
            c = text[i]
            if c == "/" and not whole:
                m = _REGEX.match(text, i)
                if not m or not _FLAGS.search(m[0][m[0].rfind("/") :]) or not regex_is_whole(m[0][1 : m[0].rfind("/")]):
                    return self.fail()
                self.emit("REGEX")
                i, whole = m.end(), True
                continue
            if c == "<" and self.jsx and not whole and re.compile(r"<\s*[A-Za-z_$>]").match(text, i) and not (self.ts and _GENERIC.match(text, i)):
                i = self.element(i, depth)
                whole = True
                continue
            m = _JS.match(text, i)
            if not m:
                return self.fail()
            group, word = m.lastgroup, m[0]
            i = m.end()
            if group == "name":
                kind = "PRIVATE" if word[0] == "#" else word if word in JS_WORDS and self.last not in (".", "?.") else "NAME"
                self.emit(kind)
                whole = kind in _WHOLE
            elif group == "number":
                after = text[i : i + 1]
                if after and (after == "_" or after == "$" or after.isalnum()) or (word[0] == "0" and word[1:2].isdigit()):
                    return self.fail()
                self.emit("NUMBER")
                whole = True
            elif group == "string":
                if "\\" in word and _BAD_ESCAPE.search(word):
                    return self.fail()
                self.emit("STRING")
                self.number += word.count("\n")
                whole = True
            elif group == "tick":
                i = self.template(i, depth, whole)
                whole = True
            else:
                if word in "([{":
                    if word == "(":
                        after = self.last not in _BEFORE_PAREN
                    elif word == "{":
                        after = not whole and self.last not in ("=>", ")", ";", "{", "}", "", "else", "do", "try", "finally") and not self.fresh
                    else:
                        after = True
                    brackets.append((word, after))
                    self.emit(word)
                    whole = False
                elif word in ")]}":
                    if word == "}" and not brackets and depth:
                        return i
                    if not brackets or {"(": ")", "[": "]", "{": "}"}[brackets[-1][0]] != word:
                        return self.fail()
                    whole = brackets.pop()[1]
                    self.emit(word)
                else:
                    self.emit(word)
                    whole = word in ("++", "--") and whole or (word == "!" and whole and self.ts)
        return i


def script_lines(text: str, jsx: bool = False, ts: bool = False) -> tuple[list[tuple[str, ...]], list[int]]:
    """Kinds by line of the text; a line of kinds that begins with the empty kind goes on with the line before."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n")
    s = _Script(text, jsx, ts)
    i = text.find("\n") if text.startswith("#!") else 0
    if i >= 0:
        s.run(i, 0)
    if not s.failed:
        s.emit("$end")
    s.lines.append(tuple(s.line))
    s.numbers.append(s.began)
    return s.lines, s.numbers
