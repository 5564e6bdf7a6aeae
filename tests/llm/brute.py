"""Operators said again without Spark, for small tables."""

import itertools
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t) if w]


def shingles(t):
    w = words((t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b, least=0.8):
    both = len(a & b)
    return bool(both) and both >= least * (len(a) + len(b) - both)


def line_kind(line):
    """The masked tokens of a line, or None."""
    w = words(line)
    few = 4 * sum(bool(re.search("[0-9]", x)) for x in w) <= len(w)
    return tuple("<*>" if few and re.search("[0-9]", x) else x for x in w) or None


def fields(kind):
    n = len(kind)
    return [kind[n * k // 8 : n * (k + 1) // 8] for k in range(8)] if n >= 8 else [(w,) for w in kind]


def one_template(a, b):
    if len(a) != len(b) or a[:3] != b[:3]:
        return False
    f, g = fields(a), fields(b)
    return 4 * sum(x != y for x, y in zip(f, g, strict=True)) <= len(f)


def lines(rows, least_docs=2):
    """rows of (id, text) -> (text without dropped lines, lines, dropped) of each row, from the definition: pair by pair.

    A text's class is the first text of its chain of copies. A line goes if an earlier class has a line of its template, or if
    an earlier line of its own text has, where the template occurs in another class.
    """
    place = {}
    for i, t in rows:
        at = (i is None, i or 0)
        place[t or ""] = min(place.get(t or "", at), at)
    texts = sorted(place, key=lambda t: (place[t], t))
    kinds = {t: [line_kind(x) for x in t.split("\n")] for t in texts}
    sets = {t: shingles(t) for t in texts}
    root = {}
    for k, t in enumerate(texts):
        of = [f for f in texts[:k] if alike(sets[t], sets[f]) and any(a and b and one_template(a, b) for a in kinds[t] for b in kinds[f])]
        root[t] = root[of[0]] if of else t
    patterns = {}
    for t in texts:
        for pos, kind in enumerate(kinds[t]):
            if kind:
                f = fields(kind)
                may = len(f) // 4
                for out in itertools.combinations(range(len(f)), may):
                    name = (len(kind), kind[:3], out, tuple(x for k, x in enumerate(f) if k not in out))
                    patterns.setdefault(name, []).append((t, pos))
    gone = {t: set() for t in texts}
    order = {t: k for k, t in enumerate(texts)}
    for at in patterns.values():
        classes = {root[t] for t, _ in at}
        if len(classes) < least_docs:
            continue
        first = root[min(at, key=lambda x: order[x[0]])[0]]
        own = {}
        for t, pos in at:
            own[t] = min(own.get(t, pos), pos)
        for t, pos in at:
            if root[t] != first or pos != own[t]:
                gone[t].add(pos)
    out = []
    for _, t in rows:
        rs = (t or "").split("\n")
        g = gone[t or ""]
        out.append((t if not g else "\n".join(x for k, x in enumerate(rs) if k not in g), len(rs), len(g)))
    return out
