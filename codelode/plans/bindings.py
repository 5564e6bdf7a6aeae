"""The operators over the driver's tables, each with the same answer in SQL.

The tables hold no source code, so each operator works on its analogue: a document is a function body and its source the
module; consecutive orders are calls; a customer's nation importing from a supplier's nation is an import; events are commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions.hashing import content_hash, fnv1a, md5_int, sketch
from codelode.functions.numeric import round2
from codelode.functions.text import acronym, camel_tokens, glob_regex, words
from codelode.operators import duplicates, governance, graph, intent, metrics, resolution, search, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def binding(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- duplicates

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"
_FNS = rf"""fns AS (SELECT doc_id AS id, source AS module, text, md5(text) AS body_hash, len({_WORDS}) AS tokens,
  coalesce({_WORDS}[1], '') AS name, doc_id % 2 = 0 AS exported, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS literal_hash FROM documents)"""
_SIM = "CASE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0.0 WHEN {x} = {y} THEN 1.0 ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE END"
_BARE = "regexp_replace(lower({c}), '^(handle|process|execute|run|do|perform|apply)', '')"
_JAC = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::DOUBLE, 0.0)"


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    w = words(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("module"), "text", F.md5("text").alias("body_hash"), F.size(w).alias("tokens"), F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("name"), (F.col("doc_id") % 2 == 0).alias("exported"), F.md5(F.regexp_replace("text", "[^0-9]", "")).alias("literal_hash"))


@binding(f"WITH {_FNS} SELECT body_hash, count(*) AS size, count(DISTINCT module) AS modules, min(id) AS first_id, max(id) AS last_id FROM fns WHERE tokens >= 4 GROUP BY body_hash HAVING count(*) >= 2")
def exact_clone_groups(spark, sf_dir):
    return duplicates.exact_groups(_functions(spark, sf_dir))


_PAIRS = "SELECT a.id AS a_id, b.id AS b_id, least(a.id::VARCHAR, b.id::VARCHAR) || '|' || greatest(a.id::VARCHAR, b.id::VARCHAR) AS pair_key, CAST(90 + CASE WHEN a.tokens > 120 THEN 4 ELSE 0 END AS BIGINT) AS confidence FROM fns a JOIN fns b ON a.body_hash = b.body_hash AND a.id < b.id AND a.module <> b.module WHERE a.tokens >= 30"


@binding(f"WITH {_FNS} {_PAIRS}")
def cross_module_clone_pairs(spark, sf_dir):
    return duplicates.clone_pairs(_functions(spark, sf_dir))


@binding(f"""WITH {_FNS}, big AS (SELECT body_hash, module, count(*) AS size, min(id) AS first_id FROM fns WHERE tokens >= 12 GROUP BY ALL),
tiny AS (SELECT * FROM fns WHERE tokens >= 4 AND tokens < 12),
named AS (SELECT body_hash, module FROM tiny GROUP BY ALL HAVING count(DISTINCT name) = 1 AND bool_and(exported)),
cohort AS (SELECT body_hash, module, literal_hash, count(*) AS size, min(id) AS first_id FROM tiny SEMI JOIN named USING (body_hash, module) GROUP BY ALL),
best AS (SELECT body_hash, module, size, first_id FROM cohort QUALIFY row_number() OVER (PARTITION BY body_hash, module ORDER BY size DESC, literal_hash) = 1)
SELECT * FROM (SELECT * FROM big UNION ALL SELECT * FROM best) WHERE size >= 2""")
def intra_module_clone_groups(spark, sf_dir):
    return duplicates.intra_groups(_functions(spark, sf_dir))


@binding(f"WITH {_FNS}, g AS (SELECT body_hash, count(*) AS copies FROM fns WHERE tokens >= 4 GROUP BY body_hash) SELECT id, coalesce(copies >= 2, false) AS is_clone, coalesce(copies, 0) AS copies FROM fns LEFT JOIN g USING (body_hash)")
def clone_membership_flags(spark, sf_dir):
    return duplicates.membership(_functions(spark, sf_dir))


_SKETCH = rf"""t AS (SELECT doc_id AS id, md5(text) AS body_hash, {_WORDS} AS w FROM documents),
s AS (SELECT id, body_hash, len(w) AS tokens, list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: CAST('0x' || substr(md5(concat_ws('|', w[i], w[i + 1], w[i + 2], w[i + 3])), 1, 15) AS BIGINT))))[1:24] AS sk FROM t WHERE len(w) >= 12),
f AS (SELECT *, len(sk) < 24 AND len(sk) / tokens::DOUBLE < 0.35 AS low_info FROM s)"""


def _sketched(spark, sf_dir):
    w = words(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("body_hash"), F.size(w).alias("tokens"), sketch(w, md5_int).alias("sketch"))


@binding(f"""WITH {_SKETCH}, o AS (SELECT id, unnest(sk) AS v FROM f WHERE NOT low_info), h AS (SELECT v FROM o GROUP BY v HAVING count(*) BETWEEN 2 AND 24),
p AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS shared FROM o a JOIN h USING (v) JOIN o b ON b.v = a.v AND a.id < b.id GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT a_id, b_id, shared, least(0.99, {_JAC.format(a='x.sk', b='y.sk')}) AS sim FROM p JOIN f x ON x.id = a_id JOIN f y ON y.id = b_id WHERE x.body_hash <> y.body_hash)
SELECT a_id, b_id, least(a_id::VARCHAR, b_id::VARCHAR) || '|' || greatest(a_id::VARCHAR, b_id::VARCHAR) AS pair_key, shared, floor(sim * 100 + 0.5) / 100.0 AS similarity FROM q WHERE sim >= 0.72""")
def near_clone_pairs(spark, sf_dir):
    return duplicates.near_pairs(_sketched(spark, sf_dir))


@binding(f"WITH {_SKETCH} SELECT id, len(sk) AS grams, low_info FROM f")
def near_clone_low_info_filter(spark, sf_dir):
    return duplicates.low_information(_sketched(spark, sf_dir)).select("id", F.size("sketch").cast("long").alias("grams"), "low_info")


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.concat_ws("/", "p_brand", "p_size").alias("body_hash"), F.col("p_partkey").cast("string").alias("literal_hash"))


def _name_parts(c: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]', ' ', 'g')), '\\s+'), lambda w: w <> '')"


@binding(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS name, p_brand || '/' || p_size AS h, {_name_parts("(p_name || ' ' || p_type)")} AS t FROM part),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.h = b.h AND a.id < b.id AND a.name <> b.name WHERE {_JAC.format(a='a.t', b='b.t')} >= 0.5),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS id, a AS x FROM both_ UNION SELECT r.id, b.b FROM reach r JOIN both_ b ON r.x = b.a)
SELECT id, min(x) AS cluster FROM reach GROUP BY id""")
def literal_drift_clusters(spark, sf_dir):
    return duplicates.literal_drift(_parts(spark, sf_dir))


@binding(f"""WITH p AS (SELECT p_partkey AS id, p_brand AS module, p_name AS name, p_size, list_distinct(list_transform(list_concat(string_split(p_name, ' '), [p_type, p_brand]), lambda x: lower(x))) AS params, {_BARE.format(c='p_name')} AS bare FROM part WHERE p_size >= 2),
j AS (SELECT a.id AS a_id, b.id AS b_id, {_JAC.format(a='a.params', b='b.params')} AS s, {_SIM.format(x='a.bare', y='b.bare')} AS n FROM p a JOIN p b ON a.p_size = b.p_size AND a.id < b.id AND a.module <> b.module)
SELECT a_id, b_id, least(a_id::VARCHAR, b_id::VARCHAR) || '|' || greatest(a_id::VARCHAR, b_id::VARCHAR) AS pair_key, CAST(floor(45 + s * 25 + 0.5) AS BIGINT) AS confidence, floor(s * 100 + 0.5) / 100.0 AS signature, floor(n * 100 + 0.5) / 100.0 AS name_similarity FROM j WHERE s >= 0.6 AND n >= 0.55""")
def signature_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("body_hash"), F.lit(99).alias("tokens"), F.col("p_size").alias("param_count"), F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))).alias("params"))
    return duplicates.signature_pairs(f)


@binding(f"""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS module, {_BARE.format(c='s_name')} AS bare FROM supplier),
j AS (SELECT a.id AS a_id, b.id AS b_id, {_SIM.format(x='a.bare', y='b.bare')} AS n FROM s a JOIN s b ON a.id < b.id AND a.module <> b.module)
SELECT a_id, b_id, least(a_id::VARCHAR, b_id::VARCHAR) || '|' || greatest(a_id::VARCHAR, b_id::VARCHAR) AS pair_key, CAST(floor(60 + (n - 0.92) * 150 + 0.5) AS BIGINT) AS confidence, floor(n * 100 + 0.5) / 100.0 AS name_similarity FROM j WHERE n >= 0.92 AND n < 1""")
def name_drift_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return duplicates.name_drift_pairs(s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("module"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("body_hash")))


_TARGETS = "t AS (SELECT doc_id AS id, list_distinct([lang, 'n' || (n_chars // 500), 's' || (doc_id % 3)]) AS t FROM documents)"


def _targets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.explode(F.array("lang", F.concat(F.lit("n"), F.floor(F.col("n_chars") / 500).cast("string")), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))).alias("target"))


@binding(f"""WITH {_FNS}, p AS ({_PAIRS}), {_TARGETS}, j AS (SELECT p.*, {_JAC.format(a='x.t', b='y.t')} AS overlap FROM p JOIN t x ON x.id = a_id JOIN t y ON y.id = b_id)
SELECT a_id, b_id, pair_key, CAST(least(99, confidence + CASE WHEN overlap >= 0.75 THEN 12 WHEN overlap >= 0.5 THEN 8 ELSE 0 END) AS BIGINT) AS confidence, round(overlap, 6) AS overlap FROM j""")
def import_overlap_boost(spark, sf_dir):
    out = duplicates.import_boost(duplicates.clone_pairs(_functions(spark, sf_dir)), _targets(spark, sf_dir))
    return out.withColumn("overlap", F.round("overlap", 6))


@binding(f"""WITH {_FNS}, p AS ({_PAIRS}) SELECT CAST(least(100, coalesce(sum(12), 0) + 15) AS BIGINT) AS score, count(*) AS findings, CASE WHEN least(100, coalesce(sum(12), 0) + 15) < 10 THEN 'clean' WHEN least(100, coalesce(sum(12), 0) + 15) < 30 THEN 'watch' WHEN least(100, coalesce(sum(12), 0) + 15) < 60 THEN 'high' ELSE 'critical' END AS band FROM p""")
def contamination_score(spark, sf_dir):
    pairs = duplicates.clone_pairs(_functions(spark, sf_dir)).withColumn("kind", F.lit("clone"))
    return duplicates.contamination_score(pairs, F.lit(7))


@binding(f"WITH {_FNS}, p AS ({_PAIRS}), half AS (SELECT count(*) // 2 AS h FROM documents) SELECT p.* FROM p ANTI JOIN (SELECT pair_key FROM p, half WHERE a_id < h AND b_id < h) b ON p.pair_key = b.pair_key")
def new_clone_pairs_vs_base(spark, sf_dir):
    f = _functions(spark, sf_dir)
    pairs = duplicates.clone_pairs(f)
    half = table(spark, sf_dir, "documents").agg(F.floor(F.count(F.lit(1)) / 2).alias("h"))
    base = pairs.join(F.broadcast(half), (F.col("a_id") < F.col("h")) & (F.col("b_id") < F.col("h")), "left_semi")
    return duplicates.new_pairs(pairs, base).select("a_id", "b_id", "pair_key", "confidence")


@binding("""SELECT p_partkey, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619::HUGEINT) % 4294967296::HUGEINT) AS BIGINT) AS hash FROM part""")
def fnv1a_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("hash"))


_CAMEL = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@binding(f"""SELECT name, list_aggregate({_CAMEL.format(c='name')}, 'string_agg', ' ') AS tokens FROM (SELECT DISTINCT p_brand || p_type || '_' || p_name || 'HTTPServer' AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)""")
def identifier_tokens(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type", F.lit("_"), "p_name", F.lit("HTTPServer")).alias("name")).union(table(spark, sf_dir, "nation").select("n_name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return names.select("name", F.array_join(camel_tokens(F.col("name")), " ").alias("tokens"))


# ------------------------------------------------- ownership, windows, deltas

_TOUCHED = "touched AS (SELECT o_orderkey AS commit, o_orderpriority AS author, 'n' || c_nationkey AS module FROM orders JOIN customer ON o_custkey = c_custkey)"
_OWN = f"""{_TOUCHED}, per AS (SELECT module, author, count(DISTINCT commit) AS n FROM touched GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, sum(n) OVER (PARTITION BY module ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY module) AS total FROM per WINDOW w AS (PARTITION BY module ORDER BY n DESC, author)),
own AS (SELECT module, CAST(max(total) AS BIGINT) AS commits, count(*) AS authors, CAST(min(rn) FILTER (WHERE 5 * cum >= 4 * total) AS BIGINT) AS bus_factor, first(author ORDER BY rn) AS top_author, first(n ORDER BY rn) / max(total)::DOUBLE AS top_share FROM r GROUP BY module)"""


def _touched(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("module"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("author"), "module")


@binding(f"WITH {_OWN} SELECT module, commits, authors, bus_factor FROM own")
def ownership_bus_factor(spark, sf_dir):
    return metrics.ownership(_touched(spark, sf_dir)).select("module", "commits", "authors", "bus_factor")


@binding(f"WITH {_OWN} SELECT module, top_author, round(top_share, 6) AS top_share, CASE WHEN commits >= 3 AND top_share >= 0.5 THEN top_author END AS owner FROM own")
def top_author_share(spark, sf_dir):
    return metrics.ownership(_touched(spark, sf_dir)).select("module", "top_author", F.round("top_share", 6).alias("top_share"), "owner")


@binding(f"WITH {_OWN} SELECT module, CAST(CASE WHEN commits >= 3 THEN greatest(0, least(100, floor(25 * least(bus_factor, 4) - greatest(top_share - 0.5, 0.0) * 100 + 0.5))) END AS BIGINT) AS risk FROM own")
def knowledge_risk(spark, sf_dir):
    return metrics.ownership(_touched(spark, sf_dir)).select("module", "risk")


_EV = "ev AS (SELECT user_id || '-' || CAST(ts AS DATE) AS commit, event_type AS module, event_type AS dir, event_type || '/' || (event_id % 17) AS file FROM events)"


def _event_commits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("commit"), F.col("event_type").alias("module"), F.col("event_type").alias("dir"), F.concat_ws("/", "event_type", F.col("event_id") % 17).alias("file"))


@binding(f"""WITH {_EV}, per AS (SELECT commit, count(DISTINCT dir) AS dirs, count(DISTINCT file) AS files FROM ev GROUP BY commit),
c AS (SELECT module, count(*) AS commits, avg(dirs) AS mean_dirs, avg(files) AS mean_files FROM (SELECT DISTINCT commit, module FROM ev) JOIN per USING (commit) GROUP BY module)
SELECT module, commits, round(mean_dirs, 6) AS mean_dirs, round(mean_files, 6) AS mean_files, CAST(CASE WHEN commits >= 2 THEN floor(100 * (1 - (0.7 * least(greatest(mean_dirs - 1, 0.0) / 4, 1.0) + 0.3 * least(mean_files / 12, 1.0))) + 0.5) END AS BIGINT) AS locality FROM c""")
def cochange_locality(spark, sf_dir):
    c = metrics.locality(metrics.cochange(_event_commits(spark, sf_dir)))
    return c.select("module", "commits", F.round("mean_dirs", 6).alias("mean_dirs"), F.round("mean_files", 6).alias("mean_files"), "locality")


@binding("""WITH e AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 AS s FROM events),
r AS (SELECT user_id, event_id, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
SELECT user_id, run, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM r GROUP BY ALL""")
def import_run_islands(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", 40)


@binding("""WITH s AS (SELECT user_id, event_id AS st, event_id + CAST(floor(value) AS BIGINT) AS en FROM events),
n AS (SELECT user_id, greatest(0, en - greatest(st - 1, coalesce(max(en) OVER (PARTITION BY user_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st - 1))) AS add, en FROM s)
SELECT user_id, CAST(sum(add) AS BIGINT) AS covered, max(en) AS "last", CAST(floor(100 * CAST(sum(add) AS BIGINT) / nullif(max(en), 0) + 0.5) AS BIGINT) AS percent FROM n GROUP BY user_id""")
def outline_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value")).alias("end"))
    return windows.coverage(s, ["user_id"])


@binding("""WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, rank, total, CASE WHEN rank <= 12 THEN l_orderkey END AS l_orderkey, CASE WHEN rank = 13 THEN total - 12 END AS more FROM d WHERE rank <= 13""")
def evidence_capped_with_overflow(spark, sf_dir):
    d = windows.capped(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 12)
    return d.select("l_suppkey", F.col("rank").cast("long").alias("rank"), "total", F.when(F.col("rank") <= 12, F.col("l_orderkey")).alias("l_orderkey"), "more")


@binding("""SELECT conv_id, turn, coalesce(lag(substr(sha256(coalesce(text, '')), 1, 12)) OVER (PARTITION BY role ORDER BY conv_id, turn) = substr(sha256(coalesce(text, '')), 1, 12), false) AS repeat FROM conversations""")
def session_dedup_receipts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("digest", content_hash(F.coalesce("text", F.lit("")), 12))
    return windows.receipts(c, ["role"], ["conv_id", "turn"], "digest").select("conv_id", "turn", "repeat")


@binding("""WITH d AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
g AS (SELECT l_returnflag, max(n) AS n, max(v) AS most, min(CASE WHEN r = greatest(1, ceil(n * 0.5::DOUBLE - 1e-9)) THEN v END) AS p50, min(CASE WHEN r = greatest(1, ceil(n * 0.95::DOUBLE - 1e-9)) THEN v END) AS p95 FROM d GROUP BY l_returnflag)
SELECT l_returnflag, n, most, p50, CASE WHEN p95 < most THEN p95 END AS p95 FROM g""")
def latency_percentiles(spark, sf_dir):
    return windows.nearest_rank(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")


@binding("""SELECT conv_id, turn, CAST(sum(CAST(ceil((length(coalesce(text, '')) + 1) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, sum(CAST(ceil((length(coalesce(text, '')) + 1) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 400 AS shown FROM conversations""")
def budgeted_sections(spark, sf_dir):
    return windows.budgeted(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length(F.coalesce("text", F.lit(""))), 400).select("conv_id", "turn", "upto", "shown")


@binding("""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: length(x) >= 3))) AS token FROM documents),
p AS (SELECT source, token, min(doc_id) AS pos FROM w JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, token, pos, row_number() OVER (PARTITION BY source ORDER BY pos, token) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos, token) <= 120""")
def first_distinct_tokens(spark, sf_dir):
    w = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: F.length(x) >= 3))
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), F.explode(w).alias("token"))
    return windows.first_distinct(d, ["source"], "token", "pos", 120).withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------------------------ module graph

_IMPORTS = """imports AS (SELECT cn.n_name AS src, sn.n_name AS dst, l_partkey AS name, l_suppkey AS target, l_quantity, l_returnflag, l_discount, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""


def _imports(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation")
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_shipdate")
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("src", "dst", F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("target"), "l_quantity", "l_returnflag", "l_discount", "l_shipdate")


@binding(f"WITH {_IMPORTS} SELECT src, dst, count(*) AS imports FROM imports WHERE src <> dst GROUP BY ALL")
def module_import_edges(spark, sf_dir):
    return graph.module_edges(_imports(spark, sf_dir))


@binding(f"WITH {_IMPORTS} SELECT dst, count(DISTINCT name) AS used_exports, count(DISTINCT src) AS imported_by FROM imports WHERE src <> dst GROUP BY dst")
def used_exports(spark, sf_dir):
    return graph.used_exports(_imports(spark, sf_dir))


@binding(f"WITH {_IMPORTS}, e AS (SELECT DISTINCT src, dst FROM imports WHERE src <> dst) SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def mutual_import_cycles(spark, sf_dir):
    return graph.mutual_cycles(_imports(spark, sf_dir))


_INTERFACES = "faces AS (SELECT n_name AS module, min(s_suppkey) AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"


def _interfaces(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("module")).agg(F.min("s_suppkey").alias("file"))


@binding(f"WITH {_IMPORTS}, {_INTERFACES} SELECT DISTINCT src, dst, target FROM imports JOIN faces ON dst = module WHERE src <> dst AND target <> file")
def deep_imports(spark, sf_dir):
    return graph.deep_imports(_imports(spark, sf_dir), _interfaces(spark, sf_dir))


@binding(f"WITH {_IMPORTS}, {_INTERFACES}, d AS (SELECT DISTINCT src, dst, target, l_shipdate >= TIMESTAMP '1993-01-01' AS late FROM imports JOIN faces ON dst = module WHERE src <> dst AND target <> file) SELECT DISTINCT src, dst, target FROM d WHERE late AND (src, dst, target) NOT IN (SELECT (src, dst, target) FROM d WHERE NOT late)")
def introduced_deep_imports(spark, sf_dir):
    i, faces = _imports(spark, sf_dir), _interfaces(spark, sf_dir)
    late = F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp")
    return graph.introduced(graph.deep_imports(i.filter(late), faces), graph.deep_imports(i.filter(~late), faces), ["src", "dst", "target"]).select("src", "dst", "target")


@binding(f"WITH {_IMPORTS} SELECT dst, count(DISTINCT src) AS fan_in FROM imports WHERE src <> dst GROUP BY dst")
def module_fan_in(spark, sf_dir):
    return graph.fan_in(graph.module_edges(_imports(spark, sf_dir)))


_HOSTS = r"""h AS (SELECT page_id AS id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '\.', '/', 'g') AS p FROM pages),
files AS (SELECT DISTINCT p AS file, string_split(p, '/')[1] AS module FROM h),
imp AS (SELECT id, array_to_string(string_split(p, '/')[2:], '/') AS p FROM h)"""
_TAILS = "unnest(list_transform(range(1, least(len(string_split({p}, '/')), 6) + 1), lambda k: {{'k': k, 'tail': array_to_string(string_split({p}, '/')[-k:], '/')}})) AS t"


@binding(f"""WITH {_HOSTS}, ft AS (SELECT file, module, {_TAILS.format(p='file')} FROM files), it AS (SELECT id, {_TAILS.format(p='p')} FROM imp),
per AS (SELECT t.k AS k, t.tail AS tail, min(module) AS module, min(file) AS file FROM ft GROUP BY 1, 2 HAVING count(DISTINCT module) = 1),
hit AS (SELECT id, per.k, per.module, per.file, row_number() OVER (PARTITION BY id ORDER BY per.k DESC) AS r FROM it JOIN per ON it.t.k = per.k AND it.t.tail = per.tail)
SELECT id, CAST(k AS INT) AS segments, module, file FROM hit WHERE r = 1""")
def suffix_unique_resolution(spark, sf_dir):
    p = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1), r"\.", "/")
    h = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), p.alias("p"))
    files = h.select(F.col("p").alias("path"), F.get(F.split("p", "/"), F.lit(0)).alias("module")).distinct()
    imports = h.select("id", F.array_join(F.slice(F.split("p", "/"), 2, 99), "/").alias("path"))
    return resolution.unique_suffix(imports, files)


# --------------------------------------------------------------- call graph

_CALLS = """o AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS dst, CASE WHEN o_totalprice >= 300000 THEN 1.0 WHEN o_totalprice >= 150000 THEN 0.9 ELSE 0.7 END::DOUBLE AS c FROM orders),
edges AS (SELECT src, dst, max(c) AS c FROM o WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst), start AS (SELECT min(src) AS node FROM edges)"""


def _calls(spark, sf_dir):
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    c = F.when(F.col("o_totalprice") >= 300000, 1.0).when(F.col("o_totalprice") >= 150000, 0.9).otherwise(0.7)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(day).alias("dst"), c.alias("confidence"))
    return o.filter("dst is not null and src != dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def _levels(f: str, t: str, depth: int) -> str:
    out = ["l0 AS (SELECT node, 0 AS depth, 1.0::DOUBLE AS confidence FROM start)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        out.append(f"l{k} AS (SELECT e.{t} AS node, {k} AS depth, max(least(l.confidence, e.c)) AS confidence FROM l{k - 1} l JOIN edges e ON l.node = e.{f} WHERE e.{t} NOT IN ({seen}) GROUP BY e.{t})")
    return ", ".join(out)


def _all_levels(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, depth + 1))


def _start(spark, sf_dir):
    return _calls(spark, sf_dir).agg(F.min("src").alias("node"))


@binding(f"WITH {_CALLS}, {_levels('dst', 'src', 6)} SELECT node, depth FROM ({_all_levels(6)})")
def callers_bfs(spark, sf_dir):
    return graph.reach(_calls(spark, sf_dir), _start(spark, sf_dir), reverse=True).select("node", "depth")


@binding(f"WITH {_CALLS}, {_levels('src', 'dst', 6)} SELECT node, depth FROM ({_all_levels(6)})")
def callees_bfs(spark, sf_dir):
    return graph.reach(_calls(spark, sf_dir), _start(spark, sf_dir)).select("node", "depth")


@binding(f"WITH {_CALLS}, {_levels('src', 'dst', 6)} SELECT node, confidence FROM ({_all_levels(6)})")
def weakest_link_confidence(spark, sf_dir):
    return graph.reach(_calls(spark, sf_dir), _start(spark, sf_dir)).select("node", "confidence")


@binding(f"""WITH {_CALLS}, s AS (SELECT DISTINCT src AS start FROM edges WHERE src % 50 = 0), l0 AS (SELECT start, start AS node FROM s),
l1 AS (SELECT DISTINCT start, src AS node FROM l0 JOIN edges ON node = dst), l2 AS (SELECT DISTINCT start, src AS node FROM l1 JOIN edges ON node = dst), l3 AS (SELECT DISTINCT start, src AS node FROM l2 JOIN edges ON node = dst),
hit AS (SELECT DISTINCT start, node FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE start <> node),
g AS (SELECT start, count(*) AS callers, count(DISTINCT c_nationkey) AS modules FROM hit JOIN customer ON node = c_custkey GROUP BY start)
SELECT s.start, coalesce(callers, 0) AS callers, coalesce(modules, 0) AS modules, CASE WHEN coalesce(callers, 0) = 0 THEN 'isolated' WHEN callers <= 3 THEN 'local' WHEN callers <= 10 THEN 'moderate' ELSE 'wide' END AS bucket FROM s LEFT JOIN g USING (start)""")
def impact_buckets(spark, sf_dir):
    e = _calls(spark, sf_dir)
    starts = e.filter("src % 50 = 0").select(F.col("src").alias("node")).distinct()
    modules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("module"))
    return graph.impact(e, starts, modules)


def _path_sql(depth: int = 16) -> str:
    out = [f"{_CALLS}, goal AS (SELECT max(dst) AS node FROM edges), p0 AS (SELECT node, [node] AS path FROM start)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM p{i}" for i in range(k))
        out.append(f"p{k} AS (SELECT e.dst AS node, min(list_append(p.path, e.dst)) AS path FROM p{k - 1} p JOIN edges e ON p.node = e.src WHERE e.dst NOT IN ({seen}) GROUP BY e.dst)")
    hits = " UNION ALL ".join(f"SELECT {k} AS hops, path FROM p{k} JOIN goal USING (node)" for k in range(depth + 1))
    return f"WITH {', '.join(out)} SELECT hops, array_to_string(path, '>') AS path, 'callees' AS direction FROM ({hits})"


@binding(_path_sql())
def shortest_call_path(spark, sf_dir):
    e = _calls(spark, sf_dir)
    ends = e.agg(F.min("src"), F.max("dst")).first()
    return graph.shortest_path(e, *ends).select("hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "direction")


@binding("""WITH nodes AS (SELECT 'region:' || r_name AS id, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_name, 'nation' FROM nation), edges AS (SELECT 'region:' || r_name AS src, 'nation:' || n_name AS dst, 'contains' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'node:' || kind AS kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge:' || kind, count(*) FROM edges GROUP BY kind""")
def node_edge_export(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = r.select(F.concat(F.lit("region:"), "r_name").alias("id"), F.lit("region").alias("kind")).unionByName(n.select(F.concat(F.lit("nation:"), "n_name").alias("id"), F.lit("nation").alias("kind")))
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("region:"), "r_name").alias("src"), F.concat(F.lit("nation:"), "n_name").alias("dst"), F.lit("contains").alias("kind"))
    return graph.stats(nodes, edges)


_RESOLVE = """fn AS (SELECT c_custkey AS id, 'n' || c_nationkey || '/' || c_mktsegment AS file, 'n' || c_nationkey AS module, 'f' || (c_custkey % 400) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'T' || (c_custkey % 50) END AS type FROM customer),
ty AS (SELECT type, count(*) > 60 AS iface FROM fn WHERE type IS NOT NULL GROUP BY type),
imp AS (SELECT DISTINCT 'n' || n_nationkey AS module, 'n' || ((n_nationkey + k) % 25) AS target_module FROM nation, (VALUES (1), (7)) v(k)),
bd AS (SELECT file, 'f' || (id * 3 % 400) AS name, min(id) AS anchor FROM fn WHERE id % 10 = 0 GROUP BY 1, 2),
bind AS (SELECT bd.file, bd.name, min(fn.id) AS target FROM bd JOIN fn USING (name) GROUP BY 1, 2),
calls AS (SELECT DISTINCT fn.id AS caller, fn.file, fn.module, 'f' || (o_orderkey % 400) AS name, o_orderkey % 3 = 0 AS member, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (o_orderkey % 400 % 50) END AS receiver FROM orders JOIN fn ON fn.id = o_custkey),
n AS (SELECT c.*, f.id AS target, f.file AS tf, f.module AS tm, count_if(f.id <> c.caller) OVER (PARTITION BY c.caller, c.name, c.member) AS others FROM calls c JOIN fn f USING (name)),
sc AS (SELECT n.*, count(*) OVER w AS k, min(n.tm) OVER w AS lo, max(n.tm) OVER w AS hi FROM n JOIN imp ON n.module = imp.module AND n.tm = imp.target_module WHERE target <> caller WINDOW w AS (PARTITION BY caller, name, member)),
r AS (SELECT c.caller, c.name, c.member, min(f.id) AS target, 'receiver-type' AS reason, 0 AS rung, 0.85::DOUBLE AS confidence FROM calls c JOIN ty ON c.receiver = ty.type AND NOT iface JOIN fn f ON f.type = c.receiver AND f.name = c.name GROUP BY 1, 2, 3 HAVING count(*) = 1
UNION ALL SELECT caller, name, member, target, 'same-file', 1, 1.0 FROM n WHERE tf = file AND (target <> caller OR others = 0)
UNION ALL SELECT c.caller, c.name, c.member, b.target, 'import-binding', 2, 0.9 FROM calls c JOIN bind b USING (file, name) WHERE NOT member
UNION ALL SELECT caller, name, member, min(target), 'unique-name', 3, 0.9 FROM n WHERE NOT member AND target <> caller GROUP BY 1, 2, 3 HAVING count(*) = 1
UNION ALL SELECT caller, name, member, target, 'import-scoped', 4, 0.7 FROM sc WHERE k = 1
UNION ALL SELECT caller, name, member, target, 'module-scoped', 5, 0.5 FROM sc WHERE k BETWEEN 2 AND 4 AND lo = hi
UNION ALL SELECT caller, name, member, min(target), 'module-local', 6, 0.6 FROM n WHERE NOT member AND target <> caller AND tm = module GROUP BY 1, 2, 3 HAVING count(*) = 1),
hit AS (SELECT *, min(rung) OVER (PARTITION BY caller, name, member) AS best FROM r),
res AS (SELECT DISTINCT caller, name, member, target, reason, confidence FROM hit WHERE rung = best AND target <> caller
UNION ALL SELECT DISTINCT caller, name, member, NULL, 'unresolved', NULL FROM calls ANTI JOIN r USING (caller, name, member))"""


def _resolved(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    c = table(spark, sf_dir, "customer")
    fn = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), s("c_nationkey"), F.lit("/"), "c_mktsegment").alias("file"), F.concat(F.lit("n"), s("c_nationkey")).alias("module"), F.concat(F.lit("f"), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("T"), (F.col("c_custkey") % 50).cast("string"))).alias("type"))
    types = fn.filter("type is not null").groupBy("type").agg((F.count(F.lit(1)) > 60).alias("is_interface")).withColumn("declared", F.lit(1))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(7))).alias("k"))
    imports = n.select(F.concat(F.lit("n"), s("n_nationkey")).alias("module"), F.concat(F.lit("n"), ((F.col("n_nationkey") + F.col("k")) % 25).cast("string")).alias("target_module"))
    bd = fn.filter("id % 10 = 0").select("file", F.concat(F.lit("f"), (F.col("id") * 3 % 400).cast("string")).alias("name")).distinct()
    bindings = bd.join(fn.groupBy("name").agg(F.min("id").alias("target")), "name")
    k = F.col("o_orderkey")
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller"), F.concat(F.lit("f"), (k % 400).cast("string")).alias("name"), (k % 3 == 0).alias("member"), F.when(k % 3 == 0, F.concat(F.lit("T"), (k % 400 % 50).cast("string"))).alias("receiver"))
    calls = calls.join(fn.select(F.col("id").alias("caller"), "file", "module"), "caller")
    return resolution.resolve_calls(calls, fn, imports, bindings, types)


@binding(f"WITH {_RESOLVE} SELECT caller, name, member, target, reason, confidence FROM res")
def prioritized_call_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("caller", "name", "member", "target", "reason", "confidence")


@binding(f"WITH {_RESOLVE} SELECT caller, count(DISTINCT name) AS unresolved FROM res WHERE reason = 'unresolved' GROUP BY caller")
def unresolved_calls(spark, sf_dir):
    return resolution.unresolved_calls(_resolved(spark, sf_dir))


# ------------------------------------------------------------------ metrics

_DEPTH_IN = """sup AS (SELECT s_nationkey AS k, count(*) AS functions, count_if(s_acctbal < 0) AS private_functions, count_if(s_acctbal > 8000) AS consts FROM supplier GROUP BY 1),
cus AS (SELECT c_nationkey AS k, count(*) AS loc, count_if(c_acctbal < 0) AS types, count_if(c_mktsegment = 'MACHINERY') AS reexports, count_if(c_acctbal > 9000) AS required_params FROM customer GROUP BY 1),
m AS (SELECT n_name AS module, n_nationkey AS k, coalesce(functions, 0) AS functions, coalesce(types, 0) AS types, coalesce(consts, 0) AS consts, coalesce(reexports, 0) AS reexports, coalesce(required_params, 0) AS required_params, coalesce(private_functions, 0) AS private_functions, coalesce(loc, 0) AS loc, CASE WHEN n_nationkey = 24 THEN 0 ELSE 1 END AS source_files FROM nation LEFT JOIN sup ON sup.k = n_nationkey LEFT JOIN cus ON cus.k = n_nationkey)"""
_BAND = "CASE WHEN {c} IS NULL THEN 'n/a' WHEN {c} >= 80 THEN 'Strong' WHEN {c} >= 60 THEN 'Moderate' WHEN {c} >= 40 THEN 'Shallow' ELSE 'Weak' END"
_DEPTH = f"""{_DEPTH_IN}, d0 AS (SELECT *, functions + types + 0.5::DOUBLE * consts + 0.5::DOUBLE * required_params + 0.25::DOUBLE * reexports AS iface, loc + 5 * private_functions AS impl, reexports / greatest(1, functions + types + consts + reexports)::DOUBLE AS ratio FROM m),
d1 AS (SELECT *, floor(100 * ((impl / nullif(iface, 0)) / (impl / nullif(iface, 0) + 18)) + 0.5) AS base FROM d0),
depth AS (SELECT module, functions, CAST(CASE WHEN source_files = 0 THEN NULL WHEN iface = 0 THEN 75 WHEN ratio > 0.8 AND loc < 30 THEN least(base, 25) ELSE base END AS BIGINT) AS depth FROM d1)"""


def _depth_inputs(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    sup = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("s_acctbal") < 0).alias("private_functions"), F.count_if(F.col("s_acctbal") > 8000).alias("consts"))
    cus = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("loc"), F.count_if(F.col("c_acctbal") < 0).alias("types"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("reexports"), F.count_if(F.col("c_acctbal") > 9000).alias("required_params"))
    m = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("module"), F.when(F.col("n_nationkey") == 24, 0).otherwise(1).alias("source_files")).join(sup, "k", "left").join(cus, "k", "left")
    return m.fillna(0, ["functions", "private_functions", "consts", "loc", "types", "reexports", "required_params"])


@binding(f"WITH {_DEPTH} SELECT module, depth, {_BAND.format(c='depth')} AS label FROM depth")
def module_depth(spark, sf_dir):
    return metrics.depth(_depth_inputs(spark, sf_dir))


_SEAMS = f"""{_IMPORTS}, {_INTERFACES}, dp AS (SELECT src AS module, count(DISTINCT (src, dst, target)) AS deep FROM imports JOIN faces ON dst = module WHERE src <> dst AND target <> file GROUP BY src),
ce AS (SELECT DISTINCT src, dst FROM imports WHERE src <> dst), cy AS (SELECT DISTINCT x.src AS module FROM ce x JOIN ce y ON x.src = y.dst AND x.dst = y.src),
si AS (SELECT n_name AS module, n_nationkey % 2 = 0 AS needs, n_nationkey % 3 <> 0 AS has, coalesce(deep, 0) AS deep, cy.module IS NOT NULL AS cyc, n_nationkey % 4 <> 1 AS tested FROM nation LEFT JOIN dp ON dp.module = n_name LEFT JOIN cy ON cy.module = n_name),
seams AS (SELECT module, CAST(greatest(0, 100 - CASE WHEN needs AND NOT has THEN 35 ELSE 0 END - least(8 * deep, 30) - CASE WHEN cyc THEN 25 ELSE 0 END - CASE WHEN tested THEN 0 ELSE 10 END) AS BIGINT) AS seams FROM si)"""


def _seams(spark, sf_dir):
    i = _imports(spark, sf_dir)
    deep = graph.deep_imports(i, _interfaces(spark, sf_dir)).groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("deep"))
    c = graph.mutual_cycles(i)
    cyc = c.select(F.col("a").alias("module")).union(c.select("b")).distinct().withColumn("in_cycle", F.lit(True))
    k = F.col("n_nationkey")
    m = table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), (k % 2 == 0).alias("needs_interface"), (k % 3 != 0).alias("has_interface"), (k % 4 != 1).alias("tested"))
    m = m.join(deep, "module", "left").join(cyc, "module", "left").withColumn("deep", F.coalesce("deep", F.lit(0))).withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    return metrics.seams(m)


@binding(f"WITH {_SEAMS} SELECT module, seams, {_BAND.format(c='seams')} AS label FROM seams")
def module_seams(spark, sf_dir):
    return _seams(spark, sf_dir)


_LEV = f"""ue AS (SELECT dst, count(DISTINCT name) AS used, count(DISTINCT src) AS callers FROM imports WHERE src <> dst GROUP BY dst),
li AS (SELECT n_name AS module, n_nationkey % 30 AS exported, coalesce(used, 0) AS used, coalesce(callers, 0) AS callers FROM nation LEFT JOIN ue ON dst = n_name),
lev AS (SELECT module, exported, CAST(CASE WHEN exported = 0 THEN NULL WHEN callers = 0 THEN 10 ELSE floor(greatest(0, least(1, 0.55::DOUBLE * least(1.0, callers / least(greatest(25 - 1, 1), 6)::DOUBLE) + 0.45::DOUBLE * least(1.0, used / nullif(exported, 0)::DOUBLE) - 0.15::DOUBLE * least(1.0, exported / 25.0::DOUBLE))) * 100 + 0.5) END AS BIGINT) AS leverage FROM li)"""


def _leverage(spark, sf_dir):
    i = _imports(spark, sf_dir)
    u = graph.used_exports(i).select(F.col("dst").alias("module"), F.col("used_exports").alias("used"), F.col("imported_by").alias("callers"))
    m = table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), (F.col("n_nationkey") % 30).alias("exported")).join(u, "module", "left").fillna(0, ["used", "callers"])
    return metrics.leverage(m, F.lit(25)), m.select("module", F.col("exported").alias("exports"))


@binding(f"WITH {_IMPORTS}, {_LEV} SELECT module, leverage, {_BAND.format(c='leverage')} AS label FROM lev")
def module_leverage(spark, sf_dir):
    return _leverage(spark, sf_dir)[0]


_ALL = f"{_DEPTH}, {_SEAMS}, {_LEV}, {_OWN}"


def _modules(spark, sf_dir):
    own = metrics.ownership(_touched(spark, sf_dir)).join(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module"), "n_name"), "module").select(F.col("n_name").alias("module"), "risk", "bus_factor")
    lev, exports = _leverage(spark, sf_dir)
    drop = lambda d: d.drop("label")
    return drop(metrics.depth(_depth_inputs(spark, sf_dir))).join(drop(_seams(spark, sf_dir)), "module").join(drop(lev), "module").join(exports, "module").join(own, "module", "left")


_RISK = "(SELECT n_name AS module, CAST(CASE WHEN commits >= 3 THEN greatest(0, least(100, floor(25 * least(bus_factor, 4) - greatest(top_share - 0.5, 0.0) * 100 + 0.5))) END AS BIGINT) AS risk, bus_factor FROM own JOIN nation ON own.module = 'n' || n_nationkey) rk"
_MODULES = f"{_ALL}, mods AS (SELECT module, depth, seams, leverage, exported AS exports, risk, bus_factor FROM depth JOIN seams USING (module) JOIN lev USING (module) LEFT JOIN {_RISK} USING (module))"


@binding(f"""WITH {_MODULES}, v AS (SELECT module, coalesce(depth * 0.25::DOUBLE, 0) + coalesce(seams * 0.2::DOUBLE, 0) + coalesce(leverage * 0.25::DOUBLE, 0) AS v, CASE WHEN depth IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN seams IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN leverage IS NULL THEN 0 ELSE 0.25::DOUBLE END AS w FROM mods),
h AS (SELECT module, CAST(floor(v / nullif(w, 0) + 0.5) AS BIGINT) AS health FROM v) SELECT module, health, {_BAND.format(c='health')} AS band FROM h""")
def composite_health(spark, sf_dir):
    m = _modules(spark, sf_dir).withColumn("locality", F.lit(None).cast("long")).withColumn("contamination", F.lit(None).cast("long"))
    return metrics.composite(m).select("module", "health", "band")


@binding(f"""WITH {_MODULES} SELECT module, 0 AS "pass", 'deepen' AS kind, depth AS score FROM mods WHERE depth < 40 UNION ALL SELECT module, 1, 'trim-surface', leverage FROM mods WHERE leverage < 40 AND exports >= 8
UNION ALL SELECT module, 2, 'harden-boundary', seams FROM mods WHERE seams < 60 UNION ALL SELECT module, 3, 'spread-knowledge', risk FROM mods WHERE risk < 40""")
def opportunities(spark, sf_dir):
    return metrics.opportunities(_modules(spark, sf_dir))


@binding(f"WITH {_IMPORTS}, g AS (SELECT dst, count(DISTINCT src) AS fan_in FROM imports WHERE src <> dst GROUP BY dst) SELECT dst, fan_in, (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM g) > 18 AS truncated FROM g ORDER BY fan_in DESC, dst LIMIT 18")
def repo_map_topn(spark, sf_dir):
    return graph.ranked(graph.fan_in(graph.module_edges(_imports(spark, sf_dir))), [F.desc("fan_in"), F.col("dst")], 18)


@binding("""WITH f AS (SELECT l_suppkey AS module, 'part' AS kind, 'p' || l_partkey AS text FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY module, kind ORDER BY text) AS ord, count(*) OVER (PARTITION BY module, kind) AS total FROM f)
SELECT module, kind, CAST(ord AS INT) AS ord, text FROM r WHERE ord <= 12 UNION ALL SELECT module, kind || '-overflow', 13, (total - 12) || ' more' FROM r WHERE ord = 1 AND total > 12""")
def evidence_rows(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.lit("part").alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text")).distinct()
    return metrics.evidence(f)


# ------------------------------------------------------------------- search

_TERMS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def _symbol_docs(spark, sf_dir):
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), terms.alias("terms"))


@binding(f"""WITH d AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents), q AS (SELECT term, count(*) AS times FROM (VALUES ('the'), ('thandion'), ('oner'), ('erth'), ('oner')) v(term) GROUP BY term), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) * times), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY id""")
def bm25_rank(spark, sf_dir):
    return search.bm25(_symbol_docs(spark, sf_dir), ["the", "thandion", "oner", "erth", "oner"]).withColumn("score", F.round("score", 6))


@binding(f"WITH p AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY term")
def vocab_df(spark, sf_dir):
    return search.vocabulary(_symbol_docs(spark, sf_dir))


_NAMES = "nm AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t FROM part), vt AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM nm UNION ALL SELECT substr(p_type, 1, 3) FROM part UNION ALL SELECT lower(substr(p_name, 1, 3)) FROM part) GROUP BY term)"


def _part_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.explode(F.split("p_name", " ")).alias("term")).union(p.select(F.substring("p_type", 1, 3))).union(p.select(F.lower(F.substring("p_name", 1, 3))))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))


@binding(f"WITH {_NAMES} SELECT a.term AS alias, b.term AS target, row_number() OVER (PARTITION BY a.term ORDER BY b.n DESC, b.term) AS rank FROM vt a JOIN vt b ON length(a.term) >= 3 AND length(b.term) > length(a.term) AND starts_with(b.term, a.term)")
def alias_prefix(spark, sf_dir):
    return search.prefix_aliases(_part_terms(spark, sf_dir)).select("alias", "target", F.col("rank").cast("long").alias("rank"))


@binding(f"WITH {_NAMES} SELECT DISTINCT a AS alias, unnest(t) AS target FROM (SELECT t, array_to_string(list_transform(t, lambda w: w[1]), '') AS a FROM nm WHERE len(t) >= 2) ANTI JOIN vt ON a = term")
def alias_acronym(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tokens"))
    return search.acronym_aliases(docs, _part_terms(spark, sf_dir))


_SEARCH = """sy AS (SELECT p_partkey AS id, p_name AS name, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS t, p_partkey % 2 = 0 AS exported FROM part),
q AS (SELECT 'red bolt' AS query, ['red', 'bolt'] AS qt), s0 AS (SELECT id, name, exported, CASE WHEN name = query THEN 1.0 WHEN lower(name) = lower(query) THEN 0.95 WHEN len(list_intersect(t, qt)) = 2 THEN 0.9 - least(0.2, 0.05 * len(list_filter(t, lambda x: NOT list_contains(qt, x)))) WHEN len(list_intersect(t, qt)) > 0 THEN 0.4 + 0.3 * len(list_intersect(t, qt)) / 2.0 WHEN contains(lower(name), query) THEN 0.35 END::DOUBLE AS s FROM sy, q),
ranked AS (SELECT id, name, floor((CASE WHEN exported AND s < 0.94 THEN least(0.94, s + 0.03) ELSE s END + 1e-9) * 100 + 0.5) / 100.0 AS score FROM s0 WHERE s IS NOT NULL)"""


def _search(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), camel_tokens(F.col("p_name")).alias("tokens"), (F.col("p_partkey") % 2 == 0).alias("exported"))
    return search.symbol_search(s, F.lit("red bolt"), F.array(F.lit("red"), F.lit("bolt")))


@binding(f"WITH {_SEARCH} SELECT id, name, score FROM ranked")
def symbol_search_rank(spark, sf_dir):
    return _search(spark, sf_dir).select("id", "name", "score")


@binding(f"""WITH {_SEARCH}, c AS (SELECT r.id % 7 AS query, r.id, r.score AS confidence FROM ranked r), k AS (SELECT *, row_number() OVER w AS rk, lead(confidence) OVER w AS nx, first(confidence) OVER w AS best FROM c WINDOW w AS (PARTITION BY query ORDER BY confidence DESC, id)),
g AS (SELECT query, first(id ORDER BY rk) AS id, first(confidence ORDER BY rk) AS cf, first(nx ORDER BY rk) AS nx, CAST(count_if(best - confidence < 0.24) AS BIGINT) AS close FROM k WHERE rk <= 5 GROUP BY query)
SELECT query, CASE WHEN cf < 0.4 THEN 'unresolved' WHEN nx IS NOT NULL AND round(cf - coalesce(nx, 0), 6) < 0.12 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN cf >= 0.4 THEN id END AS target, round(cf - coalesce(nx, 0), 6) AS lead, close FROM g""")
def resolve_or_ambiguous(spark, sf_dir):
    return search.resolve(_search(spark, sf_dir).select((F.col("id") % 7).alias("query"), "id", F.col("score").alias("confidence")), ["query"])


@binding("""SELECT 'o' || o_custkey AS file, CAST(o_orderkey % 100 AS BIGINT) AS line, 'definition' AS kind FROM orders UNION SELECT 'o' || o_custkey, CAST(l_linenumber AS BIGINT), CASE WHEN l_returnflag = 'R' THEN 'call' ELSE 'member-call' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT 'o' || user_id, CAST(event_id % 100 AS BIGINT), 'import' FROM events""")
def references_union(spark, sf_dir):
    o, li, e = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "events"))
    file = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("file")
    a = o.select(file("o_custkey"), (F.col("o_orderkey") % 100).alias("line"), F.lit("definition").alias("kind"))
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(file("o_custkey"), F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_returnflag") == "R", "call").otherwise("member-call").alias("kind"))
    return search.references(a, b, e.select(file("user_id"), (F.col("event_id") % 100).alias("line"), F.lit("import").alias("kind")))


QUESTIONS = ["What breaks if I change the parser?", "impact of renaming Token", "is it safe to delete the cache", "what does handler call?", "who calls verify_token", "used by which module", "who is using Session", "where is the config used", "what does the api module depend on", "what depends on storage", "find duplicate validation logic", "which tests cover login", "any layering violations?", "what changed last week", "path from router to db", "show me the code of login", "read the class Session", "explain the retry policy", "give me an overview", "where is the session created", "where are users defined", "hello there", "is the token declared"]


def _question_sql() -> str:
    values = ", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS)
    case = lambda k, rules: "CASE " + " ".join(f"WHEN regexp_matches(q, '{r[-1]}') THEN '{r[k]}'" for r in rules) + " END"
    return f"""WITH v AS (SELECT question, trim(regexp_replace(regexp_replace(lower(question), '[`"''“”‘’]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM (VALUES {values}) t(question)) SELECT question, {case(0, intent.RULES)} AS "rule", {case(1, intent.RULES)} AS intent, {case(0, intent.RELATIONS)} AS relation FROM v"""


@binding(_question_sql())
def intent_classify(spark, sf_dir):
    return intent.classify(spark.createDataFrame([(q,) for q in QUESTIONS], "question string"))


@binding("""WITH a AS (SELECT DISTINCT l_suppkey AS target, 't' || (l_orderkey % 50) AS test, 0 AS r FROM lineitem WHERE l_quantity >= 45), b AS (SELECT DISTINCT l_suppkey, 't' || (l_partkey % 50), 1 FROM lineitem WHERE l_discount >= 0.09), c AS (SELECT DISTINCT s_suppkey, 't' || (s_nationkey % 50), 2 FROM supplier)
SELECT target, test, count(DISTINCT r) AS routes FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL""")
def tests_for_routes(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    t = lambda c: F.concat(F.lit("t"), (F.col(c) % 50).cast("string")).alias("test")
    return resolution.tests_for([li.filter("l_quantity >= 45").select(F.col("l_suppkey").alias("target"), t("l_orderkey")), li.filter("l_discount >= 0.09").select(F.col("l_suppkey").alias("target"), t("l_partkey")), s.select(F.col("s_suppkey").alias("target"), t("s_nationkey"))])


# --------------------------------------------------------------- governance

@binding("""WITH b AS (SELECT doc_id, substr(sha256(text), 1, 32) AS d FROM documents WHERE doc_id % 11 <> 0), h AS (SELECT doc_id, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END), 1, 32) AS d FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN b.d IS NULL THEN 'added' WHEN h.d IS NULL THEN 'removed' ELSE 'modified' END AS status FROM h FULL JOIN b USING (doc_id) WHERE h.d IS DISTINCT FROM b.d""")
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base = d.filter("doc_id % 11 != 0").select("doc_id", content_hash(F.col("text")).alias("digest"))
    head = d.filter("doc_id % 13 != 0").select("doc_id", content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    return governance.changed(head, base, "doc_id", "digest")


@binding("""WITH h AS (SELECT max(conv_id) // 2 AS h FROM conversations), c AS (SELECT turn, role, md5(coalesce(text, '')) AS d, conv_id >= h AS late FROM conversations, h),
s AS (SELECT turn || ':' || role AS name, late, string_agg(d, ',' ORDER BY d) AS sig FROM c GROUP BY ALL)
SELECT name, CASE WHEN b.sig IS NULL THEN 'added' WHEN a.sig IS NULL THEN 'removed' ELSE 'modified' END AS status FROM (SELECT * FROM s WHERE late) a FULL JOIN (SELECT * FROM s WHERE NOT late) b USING (name) WHERE a.sig IS DISTINCT FROM b.sig""")
def symbol_signature_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    half = c.agg(F.floor(F.max("conv_id") / 2).alias("h"))
    c = c.join(F.broadcast(half), F.lit(True)).select(F.concat_ws(":", "turn", "role").alias("name"), F.md5(F.coalesce("text", F.lit(""))).alias("d"), (F.col("conv_id") >= F.col("h")).alias("late"))
    side = lambda late: governance.signatures(c.filter(F.col("late") == late), ["name"], "d")
    return governance.changed(side(True), side(False), "name", "signature")


_POLICY = [("r1", "NATION_1*", "NATION_2", None), ("r2", "*", "NATION_3", "NATION_4"), ("r3", "NATION_5/*", "*", None), ("r4", "NATION_9", "NATION_7", None)]
_VIOLATIONS = f"""{_IMPORTS}, e AS (SELECT src, dst, count(*) % 4 = 0 AS type_only, count(*) AS n FROM imports WHERE src <> dst GROUP BY src, dst),
pol(r, f, t, via) AS (VALUES ('r1', 'NATION_1*', 'NATION_2', NULL), ('r2', '*', 'NATION_3', 'NATION_4'), ('r3', 'NATION_5/*', '*', NULL), ('r4', 'NATION_9', 'NATION_7', NULL))"""
_GLOB = "CASE WHEN {g} = '*' THEN true WHEN {g} LIKE '%/*' THEN {m} = {g}[:-3] OR starts_with({m}, {g}[:-2]) WHEN {g} LIKE '%*' THEN starts_with({m}, {g}[:-2]) ELSE {g} = {m} END"


def _violations(spark, sf_dir, imports=None):
    i = imports if imports is not None else _imports(spark, sf_dir)
    e = i.filter("src != dst").groupBy(F.col("src").alias("from_module"), F.col("dst").alias("to_module")).agg((F.count(F.lit(1)) % 4 == 0).alias("is_type_only"), F.count(F.lit(1)).alias("n")).withColumn("from_is_test", F.lit(False))
    rules = spark.createDataFrame([(r, "forbidden-dependency", f, t, via, False, False) for r, f, t, via in _POLICY], "rule string, type string, `from` string, `to` string, allowed_via string, include_type_only boolean, include_tests boolean")
    return governance.forbidden_edges(e, rules)


@binding(f"WITH {_VIOLATIONS} SELECT r AS \"rule\", src AS from_module, dst AS to_module, n FROM e JOIN pol ON {_GLOB.format(g='f', m='src')} AND {_GLOB.format(g='t', m='dst')} AND NOT type_only AND NOT coalesce({_GLOB.format(g='via', m='src')}, false)")
def policy_forbidden_edges(spark, sf_dir):
    return _violations(spark, sf_dir).select("rule", "from_module", "to_module", "n")


@binding(f"""WITH {_MODULES} SELECT 'metric-floor' AS "rule", module, CAST(depth AS DOUBLE) AS value FROM mods WHERE depth IS NOT NULL AND depth < 60 UNION ALL SELECT 'min-owners', module, CAST(bus_factor AS DOUBLE) FROM mods WHERE bus_factor IS NOT NULL AND bus_factor < 5""")
def policy_metric_floor_min_owners(spark, sf_dir):
    m = _modules(spark, sf_dir)
    a = governance.metric_floor(m, "depth", 60).withColumn("rule", F.lit("metric-floor"))
    b = governance.min_owners(m, 5).withColumn("rule", F.lit("min-owners"))
    return a.unionByName(b).select("rule", "module", F.col("value").cast("double").alias("value"))


@binding("""SELECT outcome, count(*) AS rules FROM (SELECT CASE WHEN t NOT IN ('health-delta', 'contamination-delta', 'no-new-duplication', 'metric-floor', 'min-owners', 'forbidden-dependency') THEN 'invalid' WHEN t IN ('health-delta', 'contamination-delta', 'no-new-duplication') THEN 'no_base' WHEN t = 'forbidden-dependency' AND x IS NULL THEN 'invalid' WHEN t = 'forbidden-dependency' THEN 'no_edges' ELSE 'evaluated' END AS outcome
FROM (VALUES ('health-delta', NULL), ('contamination-delta', NULL), ('no-new-duplication', NULL), ('metric-floor', NULL), ('min-owners', NULL), ('forbidden-dependency', 'db'), ('forbidden-dependency', NULL), ('typo', NULL)) v(t, x)) GROUP BY outcome""")
def policy_skipped_counters(spark, sf_dir):
    rules = [("health-delta", None), ("contamination-delta", None), ("no-new-duplication", None), ("metric-floor", None), ("min-owners", None), ("forbidden-dependency", "db"), ("forbidden-dependency", None), ("typo", None)]
    return governance.skipped(spark.createDataFrame(rules, "type string, `to` string"), has_base=False, has_edges=False)


@binding(f"""WITH {_IMPORTS}, x AS (SELECT DISTINCT src || '::' || dst AS fp, l_shipdate >= TIMESTAMP '1992-06-01' AS late FROM imports WHERE src <> dst)
SELECT fp AS fingerprint, CASE WHEN bool_and(late) THEN 'introduced' WHEN NOT bool_or(late) THEN 'resolved' ELSE 'pre_existing' END AS scope FROM x GROUP BY fp""")
def diff_scope_partition(spark, sf_dir):
    i = _imports(spark, sf_dir).filter("src != dst").withColumn("fingerprint", F.concat_ws("::", "src", "dst"))
    late = F.col("l_shipdate") >= F.lit("1992-06-01").cast("timestamp")
    return governance.diff_scope(i.filter(late), i.filter(~late))


_SNAP = "SELECT user_id % 20 AS module, CASE WHEN avg(value) > 18 THEN NULL ELSE floor(avg(value) * 5) END AS depth, floor(max(value)) AS seams, count(DISTINCT event_type) AS leverage, CAST(count(*) AS DOUBLE) AS locality, least(count(DISTINCT user_id), 3) AS bus_factor FROM events WHERE {w} GROUP BY 1"


def _snapshot(e):
    return e.groupBy((F.col("user_id") % 20).alias("module")).agg(F.when(F.avg("value") > 18, None).otherwise(F.floor(F.avg("value") * 5)).alias("depth"), F.floor(F.max("value")).alias("seams"), F.count_distinct("event_type").alias("leverage"), F.count(F.lit(1)).alias("locality"), F.least(F.count_distinct("user_id"), F.lit(3)).alias("bus_factor"))


@binding(f"""WITH b AS ({_SNAP.format(w="ts < TIMESTAMP '2024-01-16' AND user_id % 20 <> 3")}), h AS ({_SNAP.format(w="ts >= TIMESTAMP '2024-01-16' AND user_id % 20 <> 5")}),
j AS (SELECT coalesce(h.module, b.module) AS module, h.module IS NOT NULL AS inh, b.module IS NOT NULL AS inb, h.bus_factor AS f1, b.bus_factor AS f0, h.depth AS d1, b.depth AS d0, h.seams AS s1, b.seams AS s0, h.leverage AS l1, b.leverage AS l0, h.locality AS o1, b.locality AS o0 FROM h FULL JOIN b ON h.module = b.module),
m AS (SELECT module, inh AND inb AS ok, 'depth' AS metric, d0 AS x, d1 AS y FROM j UNION ALL SELECT module, inh AND inb, 'seams', s0, s1 FROM j UNION ALL SELECT module, inh AND inb, 'leverage', l0, l1 FROM j UNION ALL SELECT module, inh AND inb, 'locality', o0, o1 FROM j)
SELECT module, 'module-added' AS kind, 'info' AS severity, '' AS metric, NULL::DOUBLE AS before, NULL::DOUBLE AS after FROM j WHERE NOT inb UNION ALL SELECT module, 'module-removed', 'info', '', NULL, NULL FROM j WHERE NOT inh
UNION ALL SELECT module, 'bus-factor-one', 'critical', 'bus_factor', f0, f1 FROM j WHERE inh AND inb AND f0 >= 2 AND f1 = 1
UNION ALL SELECT module, 'metric-drop', 'warn', metric, x, y FROM m WHERE ok AND x - y >= 10 UNION ALL SELECT module, 'metric-unavailable', 'info', metric, x, y FROM m WHERE ok AND x IS NOT NULL AND y IS NULL""")
def alerts_metric_drop(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16").cast("timestamp")
    return governance.alerts(_snapshot(e.filter((F.col("ts") >= cut) & (F.col("user_id") % 20 != 5))), _snapshot(e.filter((F.col("ts") < cut) & (F.col("user_id") % 20 != 3))))


GLOBS = ["http*://*/en/*", "https://**", "*://*.example.org/**", "http?://*/de/*"]


def _glob_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS glob, count(*) AS pages FROM pages WHERE regexp_matches(url, '{glob_regex(g)}')" for g in GLOBS)


@binding(_glob_sql())
def glob_filter_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    tests = F.array(*[F.when(F.col("url").rlike(glob_regex(g)), F.lit(g)) for g in GLOBS])
    hit = p.select(F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("glob")).groupBy("glob").agg(F.count(F.lit(1)).alias("pages"))
    every = spark.createDataFrame([(g,) for g in GLOBS], "glob string")
    return every.join(hit, "glob", "left").select("glob", F.coalesce("pages", F.lit(0)).alias("pages"))


@binding(f"""WITH {_FNS}, p AS ({_PAIRS}), b AS (SELECT id FROM fns WHERE id % 3 = 0) SELECT a_id, b_id, CASE WHEN a_id % 5 = 0 AND b_id % 5 <> 0 THEN 'b' WHEN b_id % 5 = 0 AND a_id % 5 <> 0 THEN 'a' WHEN a_id % 3 = 0 AND b_id % 3 <> 0 THEN 'b' WHEN b_id % 3 = 0 AND a_id % 3 <> 0 THEN 'a' ELSE 'unknown' END AS new_side FROM p""")
def which_copy_is_new(spark, sf_dir):
    f = _functions(spark, sf_dir)
    p = duplicates.clone_pairs(f).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_id").alias("a_file"), F.col("b_id").alias("b_file"))
    ids = f.select("id")
    out = governance.new_side(p, ids.filter("id % 3 = 0").select(F.col("id").alias("file")), ids.filter("id % 5 = 0"))
    return out.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "new_side")
