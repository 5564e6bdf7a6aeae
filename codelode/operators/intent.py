"""Intent of a question, and what it names (Q-1, Q-2, Q-7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in order of evaluation (rule, intent, pattern); the first that matches decides.
RULES = [
    ("blast.breaks-if", "blast_radius", r"\bwhat\b.*\bbreaks?\b|\bbreaks?\b.*\bif i\b"),
    ("blast.impact", "blast_radius", r"\b(blast radius|impact of|affected by|ripple)\b"),
    ("blast.safe-to", "blast_radius", r"\b(safe to (change|remove|delete|rename)|what happens if i (change|remove|delete))\b"),
    ("callees.what-does-call", "callees", r"\bwhat (does|do)\b.*\bcalls?\b|\bcallees? of\b|\bcalls? what\b"),
    ("callers.who-calls", "callers", r"\b(who|what|which)\b[^?]*\bcalls?\b"),
    ("callers.called-by", "callers", r"\b(called by|callers? of|invoked by|used by)\b"),
    ("callers.who-uses", "callers", r"\bwho (uses|is using|invokes)\b"),
    ("refs.where-used", "references", r"\b(where is .* (used|referenced)|references? to|usages? of|all uses of)\b"),
    ("deps.depends-on", "dependencies", r"\b(what (does|do) .*\bdepends? on\b|depends? on what|dependencies of|imports? of)\b"),
    ("dependents.what-depends", "dependents", r"\bwhat\b.*\bdepends? on\b|\bdependents? of\b|\bimported by\b"),
    ("similar.find", "similar_logic", r"\b(similar|duplicate[ds]?|duplication|same logic|copy of|clones?)\b"),
    ("tests.what-tests", "tests", r"\b(what tests?|tests? for|tested by|test coverage (of|for)|which tests?)\b"),
    ("arch.violations", "architecture", r"\b(violations?|architecture|layering|boundar(y|ies)|coupling|circular)\b"),
    ("history.changed", "history", r"\b(what changed|recent(ly)? (changed|modified)|last (changed|modified)|churn|who (wrote|changed))\b"),
    ("path.between", "find_path", r"\b(path (from|between)|how does .* reach|before creating|after .* calls)\b"),
    ("source.show-code", "source", r"\b(show|give|print|display)\b[^?]*\b(code|source|body|implementation)\b"),
    ("source.read", "source", r"\bread\b.*\b(function|method|class)\b"),
    ("explain.what-does", "explain", r"\b(what does .* do|explain|how does .* work|purpose of)\b"),
    ("overview.orient", "overview", r"\b(overview|orient|what is this (repo|repository|project)|structure of the (repo|project)|get me up to speed|lay of the land)\b"),
    ("locate.where", "locate", r"\b(where is|where are|where does|find|locate|which file)\b"),
    ("locate.implemented", "locate", r"\b(implemented|defined|declared|lives?)\b"),
]
#: Relations a question may name, in order.
RELATIONS = [
    ("before", r"\bbefore\b"),
    ("after", r"\bafter\b"),
    ("called-by", r"\b(called by|invoked by)\b"),
    ("imported-by", r"\bimported by\b"),
    ("depends-on", r"\bdepends? on\b"),
    ("similar-to", r"\bsimilar to\b"),
    ("changed-by", r"\bchanged by\b"),
    ("tested-by", r"\btested by\b"),
    ("calls", r"\bcalls?\b"),
]
#: Which tool answers an intent; path questions need two names.
ROUTES = {
    "blast_radius": "impact_of", "callees": "callees_of", "callers": "callers_of", "references": "find_references", "dependencies": "dependencies_of",
    "dependents": "dependents_of", "similar_logic": "similar_logic_exists", "tests": "tests_for", "architecture": "architecture_health", "history": "change_impact",
    "find_path": "path_between", "source": "read_function", "explain": "context_bundle", "overview": "repo_map", "locate": "find_symbol",
}


def normalise(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(q), "[`\"'“”‘’]", " "), r"\s+", " "))


def _first(text: Column, rules: list[tuple[str, ...]]) -> Column:
    out = None
    for name, *_, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def classify(questions: DataFrame, col: str = "question") -> DataFrame:
    """The rule and intent of each question; NULL where no rule matches. One pass of ordered tests, no join."""
    rule = _first(normalise(F.col(col)), RULES)
    kinds = F.create_map(*[F.lit(x) for r in RULES for x in r[:2]])
    out = questions.withColumn("rule", rule)
    return out.withColumn("intent", F.element_at(kinds, F.col("rule"))).withColumn("relation", _first(normalise(F.col(col)), RELATIONS))


def quoted(q: Column) -> Column:
    """Spans the asker marked as literal."""
    return F.regexp_extract_all(q, F.lit("[\"'`]([^\"'`]{2,})[\"'`]"), F.lit(1))


def code_shaped(q: Column) -> Column:
    """Parts shaped like code: dotted, camel-cased or snake-cased names, and files with an ending."""
    return F.regexp_extract_all(q, F.lit(r"\b(?:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+|[A-Za-z]\w*_\w+|[A-Z]\w{2,})\b"), F.lit(0))


def route(question: str) -> tuple[str | None, str | None]:
    """(intent, tool) of one question, on the driver."""
    q = re.sub(r"\s+", " ", re.sub("[`\"'“”‘’]", " ", question.lower())).strip()
    intent = next((i for _, i, p in RULES if re.search(p, q)), None)
    return intent, ROUTES.get(intent) if intent else None
