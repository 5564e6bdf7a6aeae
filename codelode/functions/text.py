"""Names and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that lead a name without telling it apart, and words that a query is not about.
LEADING_VERBS = "handle process execute run do perform apply".split()
STOPWORDS = """a an and any are as at be been but by can did do does for from had has have how i if in into is it its just me my of on or
our out please so that the their them then there these they this those to up us was we were what when where which who whom why
will with would you your""".split()


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def camel_tokens(name: Column) -> Column:
    """Lower-cased parts of an identifier by two replacements, without look-ahead."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def identifier_tokens(name: Column) -> Column:
    """Lower-cased parts of an identifier: acronyms, capitalised words, lower-case words and digits."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0)), lambda w: F.lower(w))


def query_tokens(text: Column) -> Column:
    """Tokens of a question: longer than one character and no stopwords."""
    return F.filter(camel_tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def acronym(tokens: Column) -> Column:
    """The initials of two tokens and more."""
    return F.when(F.size(tokens) >= 2, F.array_join(F.transform(tokens, lambda w: F.substring(w, 1, 1)), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty (T4)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"^({'|'.join(LEADING_VERBS)})", "")


def bare_similarity(x: Column, y: Column) -> Column:
    """1 for equal names, else 1 - edits / longer length; 0 if either is empty."""
    longer = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / F.nullif(longer, F.lit(0)))


def name_similarity(a: Column, b: Column) -> Column:
    """``bare_similarity`` of lower-cased names without a leading verb (T5)."""
    return bare_similarity(bare_name(a), bare_name(b))


def name_parts(name: Column) -> Column:
    """A name's lower-cased parts: camel humps, - and _."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]", " ")), r"\s+"), lambda w: w != "")


def name_token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of names' parts."""
    return jaccard(name_parts(a), name_parts(b))


def test_stem(file: Column) -> Column:
    """A test file's name without what marks it as one."""
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[A-Za-z]+$", "")
    for mark in (r"\.(test|spec)$", "_test$", "^test_", "(Tests?|Spec)$"):
        base = F.regexp_replace(base, mark, "")
    return base


def span(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based, inclusive, without carriage returns."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def code_lines(text: Column, marks: tuple[str, ...] = ("//", "#", "*", "/*")) -> Column:
    """Lines that are not blank and don't begin with a comment mark."""

    def counts(line):
        bare = F.trim(line)
        out = bare != ""
        for m in marks:
            out = out & ~bare.startswith(m)
        return out

    return F.size(F.filter(F.split(text, "\n"), counts))


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ** any, * within a segment, ? one character."""
    out = re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]).replace("/", "/"), glob)
    return f"^{out}$"


def module_matches(glob: Column, name: Column) -> Column:
    """A module glob: *, an exact name, X/* (X or below) or X* (a prefix); nothing else is a wildcard."""
    tree = glob.endswith("/*")
    top = F.substring(glob, F.lit(1), F.length(glob) - 2)
    head = F.substring(glob, F.lit(1), F.length(glob) - 1)
    return F.when(glob == "*", F.lit(True)).when(tree, (name == top) | name.startswith(F.concat(top, F.lit("/")))).when(glob.endswith("*"), name.startswith(head)).otherwise(glob == name)


def specifier_package(spec: Column) -> Column:
    """The package of an import: two segments if scoped, one if not."""
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))


def fold_path(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda acc, s: F.when((s == ".") | (s == ""), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def doc_start(text: Column, line: Column, look: int = 30) -> Column:
    """The line where what belongs to a declaration on ``line`` begins: its decorators, and above them a comment block or a run of //.

    ``look`` lines above are looked at; a block that begins further up does not count.
    """
    above = F.slice(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), F.greatest(line - look, F.lit(1)), F.greatest(F.least(line - 1, F.lit(look)), F.lit(0)))
    run = lambda rows, rule: F.aggregate(F.reverse(rows), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + (acc["on"] & x.rlike(rule)).cast("int")).alias("n"), (acc["on"] & x.rlike(rule)).alias("on")))["n"]
    marks = run(above, r"^\s*[@\[]")
    rest = F.slice(above, F.lit(1), F.size(above) - marks)
    opens = F.array_max(F.transform(rest, lambda x, i: F.when(x.rlike(r"^\s*/\*"), i + 1)))
    closed = F.coalesce(F.get(rest, F.size(rest) - 1).rlike(r"\*/\s*$"), F.lit(False))
    block = F.when(closed & opens.isNotNull(), F.size(rest) - opens + 1)
    return F.when(line <= 1, line).otherwise(line - marks - F.coalesce(block, run(rest, r"^\s*//")))
