"""Lexical search over symbols (A13, T13, Q-3 to Q-6, W5). Symbol documents: id, name, terms (array), and where needed tokens, file, module, exported, is_test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.numeric import round2
from codelode.functions.text import acronym

#: Term saturation and length normalisation; gates of resolution.
K1, B = 1.2, 0.75
RESOLVE_MIN, AMBIGUITY_GAP, MAX_CANDIDATES = 0.4, 0.12, 5
SCORES = {"exact": 1.0, "all": 0.72, "subset": 0.5, "alias": 0.45, "lexical": 0.35, "path": 0.15, "exported": 0.05, "test": 0.55}
ALIAS_SUPPORT, ALIAS_PREFIX = 1, 3


def vocabulary(docs: DataFrame) -> DataFrame:
    """Per term: documents that hold it and occurrences."""
    per = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """Scores of the documents that hold a query term (T13); a term given twice counts twice.

    The corpus is reduced to the query's terms in one pass before anything is shuffled; its size and mean length come from one aggregate.
    """
    spark = docs.sparkSession
    q = spark.createDataFrame([(t,) for t in query] or [("",)], "term string").groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean"))
    tf = docs.select("id", F.size("terms").alias("len"), F.explode(F.filter("terms", lambda t: t.isin(*query) if query else F.lit(False))).alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(q), "term").join(F.broadcast(size), F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return x.groupBy("id").agg(F.sum(part * F.col("times")).alias("score"))


def prefix_aliases(terms: DataFrame) -> DataFrame:
    """(alias, target, rank): a term of three characters and more stands for the longer terms it begins (Q-3).

    terms: term, occurrences. A longer term offers its own prefixes, so the join is on equality.
    """
    t = terms.filter(F.col("occurrences") >= ALIAS_SUPPORT)
    longer = t.select(F.col("term").alias("target"), "occurrences", F.explode(F.when(F.length("term") > ALIAS_PREFIX, F.transform(F.sequence(F.lit(ALIAS_PREFIX), F.length("term") - 1), lambda k: F.substring(F.col("term"), F.lit(1), k)))).alias("alias"))
    hits = longer.join(t.select(F.col("term").alias("alias")), "alias")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("occurrences"), "target")))


def acronym_aliases(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(alias, target): the initials of a name of two words and more, if they are not a term themselves, stand for each word."""
    a = docs.select(acronym(F.col("tokens")).alias("alias"), "tokens").filter("alias is not null")
    a = a.join(terms.select(F.col("term").alias("alias")), "alias", "left_anti")
    return a.select("alias", F.explode("tokens").alias("target")).distinct()


def symbol_search(symbols: DataFrame, query: Column, query_tokens: Column) -> DataFrame:
    """Ladder of Q-5: exact, ignoring case, all tokens, some tokens, substring; a nudge for exports; two decimals."""
    name, low = F.col("name"), F.lower(F.col("name"))
    t, q = F.col("tokens"), query_tokens
    hit = F.size(F.array_intersect(t, q))
    extra = F.size(F.array_except(t, q))
    score = (
        F.when(name == query, 1.0)
        .when(low == F.lower(query), 0.95)
        .when((F.size(q) > 0) & (hit == F.size(F.array_distinct(q))), 0.9 - F.least(F.lit(0.2), 0.05 * extra))
        .when(hit > 0, 0.4 + 0.3 * hit / F.size(F.array_distinct(q)))
        .when((F.length(query) >= 3) & low.contains(F.lower(query)), 0.35)
    )
    s = symbols.withColumn("score", score).filter("score is not null")
    nudged = F.when(F.col("exported") & (F.col("score") < 0.94), F.least(F.lit(0.94), F.col("score") + 0.03)).otherwise(F.col("score"))
    return s.withColumn("score", round2(nudged + 1e-9))


def target_score(features: DataFrame) -> DataFrame:
    """Q-4: structural evidence first, lexical evidence to break ties, tests damped.

    Columns: exact, all_tokens, subset (booleans), coverage, lexical (0 to 1), path_hit, exported, is_test.
    """
    c = SCORES
    base = F.when(F.col("exact"), c["exact"]).when(F.col("all_tokens"), c["all"]).when(F.col("subset"), c["subset"] * F.col("coverage")).when(F.col("coverage") > 0, c["alias"] * F.col("coverage")).otherwise(0.0)
    s = base + c["lexical"] * F.col("lexical") + F.when(F.col("path_hit"), c["path"]).otherwise(0.0) + F.when(F.col("exported"), c["exported"]).otherwise(0.0)
    s = F.when(F.col("is_test"), s * c["test"]).otherwise(s)
    return features.withColumn("confidence", F.least(F.lit(1.0), F.round(s, 4)))


def resolve(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per query (``by``): resolved, ambiguous or unresolved, with the best, its lead and how many are close.

    candidates: id, confidence. Resolved takes 0.4 and a lead of 0.12; ambiguous ones are within 0.24 of the best of five.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), "id")
    c = candidates.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("confidence").over(w)).withColumn("best", F.first("confidence").over(w)).filter(F.col("rank") <= MAX_CANDIDATES)
    g = c.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.struct("id", "confidence", "next"))).alias("top"), F.count_if((F.col("best") - F.col("confidence")) < 2 * AMBIGUITY_GAP).alias("close"))
    lead = F.round(F.col("top.confidence") - F.coalesce(F.col("top.next"), F.lit(0.0)), 6)
    status = F.when(F.col("top.confidence") < RESOLVE_MIN, "unresolved").when(F.col("top.next").isNotNull() & (lead < AMBIGUITY_GAP), "ambiguous").otherwise("resolved")
    return g.select(*by, status.alias("status"), F.when(status != "unresolved", F.col("top.id")).alias("target"), lead.alias("lead"), "close")


def references(*sources: DataFrame) -> DataFrame:
    """All kinds of references (file, line, kind), each once (Q-6)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["file", "line", "kind"])
