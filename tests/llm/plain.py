"""Comparisons of names and shares row by row, against which the column expressions are tested."""


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swapped neighbours, or ``most`` if it is more."""
    if abs(len(a) - len(b)) >= most:
        return most
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            v = min(rows[i - 1][j] + 1, row[-1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, rows[i - 2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return min(rows[-1][-1], most)


def name_level(a: str, b: str) -> int:
    """0 the same but for separators, 1 a word or letters added at an end, 2 one edit, 3 two edits, 4 another name."""
    split = lambda s: "".join(c if c.isalnum() else " " for c in s.lower()).split()
    x, y = split(a), split(b)
    p, q = "".join(x), "".join(y)
    if p == q:
        return 0
    short, long = sorted((x, y), key=len)
    if short and len(long) - len(short) == 1 and (long[1:] == short or long[:-1] == short):
        return 1
    d = edits(p, q)
    if min(len(p), len(q)) > 1 and abs(len(p) - len(q)) == 1 and (p.startswith(q) or q.startswith(p) or p.endswith(q) or q.endswith(p)):
        return 1
    return 2 if d == 1 and min(len(p), len(q)) >= 4 else 3 if d == 2 and min(len(p), len(q)) >= 10 else 4


def share_level(a: list, b: list, within: float = 0.5) -> int:
    """0 the same languages within half of ``within``, 1 within ``within``, 2 otherwise."""
    known = [{x["name"]: x["share"] for x in s if x is not None and x["name"]} for s in (a, b)]
    loose = [[None if x is None else x["share"] for x in s if x is None or not x["name"]] for s in (a, b)]
    if not known[0] and not known[1]:
        return 2
    worst = 0.0
    for name in known[0].keys() & known[1].keys():
        worst = max(worst, abs(known[0][name] - known[1][name]))
    for mine, other, blanks in ((known[0], known[1], list(loose[1])), (known[1], known[0], list(loose[0]))):
        for name in mine.keys() - other.keys():
            near = sorted((abs(mine[name] - s), i) for i, s in enumerate(blanks) if s is not None)
            if near and near[0][0] <= within:
                worst = max(worst, near[0][0])
                blanks.pop(near[0][1])
            elif None in blanks:
                blanks.remove(None)
            else:
                return 2
    return 0 if worst <= within / 2 else 1 if worst <= within + 1e-9 else 2
