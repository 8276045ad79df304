"""Table-driven parsing: grammars as text, LR tables made of them, and a generalised LR recogniser over token kinds.

The recogniser keeps the set of all stacks that the tokens so far allow, so that a grammar may be ambiguous. Stacks and sets are shared
objects, and the step from a set over a whole line of token kinds is remembered: as lines of the same form recur in the same
place of the nesting, most lines cost one look-up. What is remembered is bounded and forgotten when it is full.

Grammar notation: ``name: alternative | alternative ;`` with ``'token'``, ``KIND``, ``name``, ``( )``, ``?``, ``*``, ``+``. A line that begins with ``@flag``
or ``@!flag`` counts only with or without that flag, up to the rule's end. ``name[R]`` stands for two rules, ``name`` and ``nameR``; inside, ``other[R]`` goes along.
"""

from __future__ import annotations

import pkgutil
import re
from functools import lru_cache

_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<q>'[^']+')|(?P<w>[A-Za-z_][A-Za-z_0-9]*(?:\[R\])?)|(?P<p>[:;|()?*+])")


class Grammar:
    """Productions over numbered symbols; terminals come first."""

    def __init__(self, text: str, flags: frozenset[str] = frozenset(), start: str = "start"):
        lines, dropped = [], False
        for line in text.split("\n"):
            if dropped:  # the rest of a rule that does not count
                dropped = not line.rstrip().endswith(";")
                continue
            while m := re.match(r"\s*@(!?)(\w+)\s", line):
                if (m[2] in flags) == bool(m[1]):
                    dropped, line = not line.rstrip().endswith(";"), ""
                    break
                line = line[m.end() :]
            lines.append(line)
        rules = self._read("\n".join(lines))
        self.productions: list[tuple[str, tuple[str, ...]]] = []
        self._made: dict[tuple, str] = {}
        for name, alternatives in rules.items():
            for alternative in alternatives:
                self.productions.append((name, tuple(self._plain(x) for x in alternative)))
        used, queue = {start}, [start]
        by: dict[str, list] = {}
        for p in self.productions:
            by.setdefault(p[0], []).append(p)
        while queue:
            for _, right in by.get(queue.pop(), ()):
                for x in right:
                    if x not in used:
                        used.add(x)
                        queue.append(x)
        self.productions = [("$start", (start, "$end"))] + [p for p in dict.fromkeys(self.productions) if p[0] in used]
        names = {p[0] for p in self.productions}
        if both := names & {x[1:-1] for x in re.findall(r"'[^']+'", re.sub(r"#[^\n]*", "", text))}:
            raise ValueError(f"rules named like tokens: {sorted(both)}")
        self.terminals = sorted({x for _, right in self.productions for x in right} - names)
        self.names = names

    def _read(self, text: str) -> dict[str, list]:
        tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup]
        covered = sum(len(m[0]) for m in _TOKEN.finditer(text))
        if covered != len(text):
            raise ValueError("the grammar has a part that is no notation")
        words = [m[0] for m in tokens]
        at = 0
        rules: dict[str, list] = {}

        def alternatives(stop: str) -> list:
            nonlocal at
            out: list = [[]]
            while words[at] != stop:
                w = words[at]
                at += 1
                if w == "|":
                    out.append([])
                    continue
                item: tuple | str = ("group", tuple(tuple(a) for a in alternatives(")"))) if w == "(" else w
                if w == "(":
                    at += 1
                while words[at] in ("?", "*", "+"):
                    item = (words[at], item)
                    at += 1
                out[-1].append(item)
            return [tuple(a) for a in out]

        def named(x, r: str):
            if isinstance(x, str):
                return x.replace("[R]", r)
            return tuple(named(y, r) for y in x)

        while at < len(words):
            name = words[at]
            at += 2
            alts = alternatives(";")
            at += 1
            for r in ("", "R") if name.endswith("[R]") else ("",):
                rules.setdefault(name.replace("[R]", r), []).extend(named(a, r) for a in alts)
        return rules

    def _plain(self, item) -> str:
        """The symbol of an item; repeated and grouped items get rules of their own."""
        if isinstance(item, str):
            return item.strip("'") if item[0] == "'" else item
        if item in self._made:
            return self._made[item]
        name = self._made[item] = f"_{len(self._made)}"
        if item[0] == "group":
            for a in item[1]:
                self.productions.append((name, tuple(self._plain(x) for x in a)))
        else:
            inner = self._plain(item[1])
            if item[0] == "?":
                self.productions += [(name, ()), (name, (inner,))]
            elif item[0] == "*":
                self.productions += [(name, ()), (name, (name, inner))]
            else:
                self.productions += [(name, (inner,)), (name, (name, inner))]
        return name


class Tables:
    """SLR(1) tables with all their conflicts: shifts and gotos by state, and reductions by state and next token."""

    def __init__(self, grammar: Grammar):
        prods = grammar.productions
        self.lengths = [len(r) for _, r in prods]
        self.lefts = [left for left, _ in prods]
        by: dict[str, list[int]] = {}
        for i, (left, _) in enumerate(prods):
            by.setdefault(left, []).append(i)
        empty, grown = set(), True
        while grown:
            grown = False
            for left, right in prods:
                if left not in empty and all(x in empty for x in right):
                    empty.add(left)
                    grown = True
        first = {t: {t} for t in grammar.terminals} | {n: set() for n in grammar.names}
        follow = {n: set() for n in grammar.names}

        def spread(step) -> None:
            while any([step(p) for p in prods]):
                pass

        def firsts(p) -> bool:
            before = len(first[p[0]])
            for x in p[1]:
                first[p[0]] |= first[x]
                if x not in empty:
                    break
            return len(first[p[0]]) > before

        def follows(p) -> bool:
            changed, tail = False, set(follow[p[0]])
            for x in reversed(p[1]):
                if x in follow:
                    if not tail <= follow[x]:
                        follow[x] |= tail
                        changed = True
                    tail = tail | first[x] if x in empty else set(first[x])
                else:
                    tail = set(first[x])
            return changed

        spread(firsts)
        spread(follows)
        opened: dict[str, frozenset[int]] = {}

        def begins(name: str) -> frozenset[int]:
            if name not in opened:
                seen, queue = set(), [name]
                while queue:
                    n = queue.pop()
                    for i in by[n]:
                        if i not in seen:
                            seen.add(i)
                            if prods[i][1] and prods[i][1][0] in by:
                                queue.append(prods[i][1][0])
                opened[name] = frozenset(seen)
            return opened[name]

        numbers = {frozenset([(0, 0)]): 0}
        kernels = [frozenset([(0, 0)])]
        self.goto: list[dict[str, int]] = []
        self.reduce: list[dict[str, tuple[int, ...]]] = []
        for kernel in kernels:
            moves: dict[str, set] = {}
            done: list[int] = []
            inner: set[int] = set()
            for p, d in kernel:
                right = prods[p][1]
                if d < len(right):
                    moves.setdefault(right[d], set()).add((p, d + 1))
                    if right[d] in by:
                        inner |= begins(right[d])
                else:
                    done.append(p)
            for p in inner:
                right = prods[p][1]
                if right:
                    moves.setdefault(right[0], set()).add((p, 1))
                else:
                    done.append(p)
            row = {}
            for x, items in moves.items():
                k = frozenset(items)
                if k not in numbers:
                    numbers[k] = len(kernels)
                    kernels.append(k)
                row[x] = numbers[k]
            self.goto.append(row)
            by_token: dict[str, list[int]] = {}
            for p in done:
                for t in follow[prods[p][0]] if p else ():
                    by_token.setdefault(t, []).append(p)
            self.reduce.append({t: tuple(v) for t, v in by_token.items()})


class Recogniser:
    """Steps sets of stacks over tokens. ``twins`` maps a token to the terminals it may stand for, the first one that a state
    can shift excluding the others. ``end`` is a token that may be put in where the next one does not fit (at line starts, before
    ``close`` tokens and at the end); before an ``either`` token at a line's start both readings are followed."""

    def __init__(self, tables: Tables, twins: dict[str, tuple[str, ...]] | None = None, end: str | None = None, close: frozenset[str] = frozenset(), either: frozenset[str] = frozenset(), most: int = 400_000):
        self.either = either
        self.t, self.twins, self.end, self.close, self.most = tables, twins or {}, end, close, most
        self.forget()

    def forget(self) -> None:
        self.stacks: dict[tuple, tuple] = {}
        self.sets: dict[frozenset, frozenset] = {}
        self.steps: dict[tuple, frozenset] = {}
        self.lines: dict[tuple, frozenset] = {}
        root = (None, 0)
        self.start = self._set({root})

    def _stack(self, below: tuple, state: int) -> tuple:
        key = (id(below), state)
        got = self.stacks.get(key)
        if got is None:
            got = self.stacks[key] = (below, state)
        return got

    def _set(self, stacks: set) -> "Stacks":
        key = frozenset(map(id, stacks))
        got = self.sets.get(key)
        if got is None:
            got = self.sets[key] = Stacks(stacks)
        return got

    def step(self, stacks: "Stacks", token: str) -> "Stacks":
        key = (stacks, token)
        got = self.steps.get(key)
        if got is None:
            out: dict[int, tuple] = {}
            for terminal in self.twins.get(token, (token,)):
                self._shift(stacks, terminal, token, out)
            got = self.steps[key] = self._set(set(out.values()))
        return got

    def _shift(self, stacks: "Stacks", terminal: str, token: str, out: dict[int, tuple]) -> None:
        goto, reduce, lefts, lengths = self.t.goto, self.t.reduce, self.t.lefts, self.t.lengths
        seen = {id(s): s for s in stacks.all}
        queue = list(stacks.all)
        while queue:
            stack = queue.pop()
            state = stack[1]
            for p in reduce[state].get(terminal, ()):
                below = stack
                for _ in range(lengths[p]):
                    below = below[0]
                to = goto[below[1]].get(lefts[p])
                if to is not None:
                    new = self._stack(below, to)
                    if id(new) not in seen:
                        seen[id(new)] = new
                        queue.append(new)
            to = goto[state].get(terminal)
            if to is not None:
                if terminal != token:  # an earlier twin that this state can shift excludes this one
                    earlier = self.twins[token][: self.twins[token].index(terminal)]
                    if any(x in goto[state] for x in earlier):
                        continue
                new = self._stack(stack, to)
                out[id(new)] = new

    def token(self, stacks: "Stacks", kind: str, first: bool, before: str, forced: frozenset[str], loose: frozenset[str]) -> "Stacks":
        """Over one token. ``forced``: tokens after which a line's end ends the statement; ``loose``: tokens that do not join the line before."""
        if self.end and first and (before in forced or kind in loose):
            ended = self.step(self.step(stacks, self.end), kind)
            if ended.all or before in forced:
                return ended
        new = self.step(stacks, kind)
        if self.end and first and kind in self.either and new.all:
            new = self._set({*new.all, *self.step(self.step(stacks, self.end), kind).all})
        if not new.all and self.end and (first or kind in self.close):
            new = self.step(self.step(stacks, self.end), kind)
        return new

    def parse(self, lines: list[tuple[str, ...]], forced: frozenset[str] = frozenset(), loose: frozenset[str] = frozenset()) -> tuple[int, int] | None:
        """The line and token at which no stack goes on, or nothing if all lines parse. The last token must be ``$end``."""
        if len(self.steps) + len(self.stacks) + len(self.lines) > self.most:
            self.forget()
        stacks, before = self.start, ""
        for n, line in enumerate(lines):
            key = (stacks, line, before in forced)
            new = self.lines.get(key)
            if new is None:
                new, b, first = stacks, before, line[:1] != ("",)
                for i, kind in enumerate(line):
                    if not kind:
                        continue
                    new = self.token(new, kind, first, b, forced, loose)
                    if not new.all:
                        return n, i
                    b, first = kind, False
                self.lines[key] = new
            stacks = new
            if line:
                before = line[-1]
        return None


class Stacks:
    """A set of stacks, compared by identity."""

    __slots__ = ("all",)

    def __init__(self, stacks: set):
        self.all = tuple(stacks)


@lru_cache(None)
def tables(name: str, flags: frozenset[str] = frozenset()) -> Tables:
    """Tables of a bundled grammar."""
    text = pkgutil.get_data("tessera.llm", f"grammars/{name}.txt").decode()
    return Tables(Grammar(text, flags))
