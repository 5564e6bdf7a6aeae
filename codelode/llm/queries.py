"""The driver's queries of the corpus operators, with production parameters over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart, decontam, exact, html, langid, linetree, lm, mixing, quality, secrets
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.near_classes(table(spark, sf_dir, "documents")).drop("class_key")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetree.dedup_lines(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    kinds = [of(k) for k in range(3)]
    digest = F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *kinds, digest, secrets.span_text(F.concat("base", "added")).alias("spans"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 8's result SQL can say: the base spans."""
    return op8_secrets(spark, sf_dir).drop("spans")


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 10's result SQL can say: the counts and the base score."""
    return op10_lm_score(spark, sf_dir).withColumn("base_score", F.round("base_score", 4)).drop("score")


def queries() -> dict[str, Query]:
    found = (op1_mix, op2_exact, op3_near, op4_lines, op5_quality, op6_decontaminate, op7_language, op8_secrets, op9_main_text, op10_lm_score, base_secrets, base_lm_score)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(chr(1), '1', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 12) AS BIGINT) AS k
  FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM base),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl
       FROM s2 WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(lvl, ratio) FROM s3 WHERE ratio >= lvl) AS l FROM s3),
q AS (SELECT source, source_size, CASE WHEN ratio >= lvl THEN l * w ELSE cap END AS target FROM s4),
q1 AS (SELECT *, sum(target) OVER () AS tot, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q WHERE target > 0),
q2 AS (SELECT source, source_size, target, tot, floor(a / tot * 281474976710656.0) AS lo,
              floor(coalesce(lead(a / tot) OVER (ORDER BY source NULLS LAST), 1.0) * 281474976710656.0) AS hi FROM q1),
n AS (SELECT CAST(floor(max(tot) / 64) AS BIGINT) + 1 AS n FROM q2),
slot AS (SELECT k, CAST('0b' || rpad(reverse(bin(k)), 48, '0') AS BIGINT) AS pt FROM (SELECT unnest(range((SELECT n + n // 16 + 64 FROM n))) AS k)),
dealt AS (SELECT source, target, source_size, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS r FROM slot JOIN q2 ON pt >= lo AND pt < hi),
times AS (SELECT source, r % CAST(ceil(source_size / 64.0) AS BIGINT) AS block, count(*) AS times FROM dealt WHERE r * 64 < target GROUP BY 1, 2),
part AS (SELECT p.*, unnest(range(st // 64, (st + size - 1) // 64 + 1)) AS block FROM placed p WHERE size > 0),
got AS (
  SELECT p.source, p.st, p.doc_id, p.size, CAST(sum((least(p.st + p.size, (p.block + 1) * 64) - greatest(p.st, p.block * 64)) * coalesce(t.times, 0)) AS BIGINT) AS taken
  FROM part p LEFT JOIN times t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block GROUP BY ALL
  UNION ALL SELECT source, st, doc_id, size, CAST(0 AS BIGINT) FROM placed WHERE size = 0)
SELECT g.doc_id, g.source, g.size, q.source_size, round(q.target, 6) AS target, g.taken
FROM got g JOIN q ON g.source IS NOT DISTINCT FROM q.source
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id < y.doc_id),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS x FROM d UNION SELECT r.id, e2.b FROM r JOIN e2 ON r.x = e2.a),
c AS (SELECT id, min(x) AS class_id FROM r GROUP BY id)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, id = class_id AS kept FROM c
"""

OP4_SQL = r"""
WITH RECURSIVE texts AS (SELECT t, doc, row_number() OVER (ORDER BY doc NULLS LAST, t) AS tid FROM (SELECT coalesce(text, '') AS t, min(doc_id) AS doc FROM documents GROUP BY ALL)),
l0 AS (SELECT tid, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT tid, string_split(t, chr(10)) AS ls FROM texts)),
l1 AS (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM l0),
l AS (SELECT tid, pos, len(line) AS chars, CASE WHEN 4 * len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) <= len(w) THEN list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE w END AS k FROM l1 WHERE len(w) > 0),
kinds AS (SELECT k, len(k) AS n, CASE WHEN len(k) >= 8 THEN list_transform(range(0, 8), lambda f: array_to_string(k[(len(k) * f // 8) + 1:(len(k) * (f + 1) // 8)], ' ')) ELSE k END AS fs FROM (SELECT DISTINCT k FROM l)),
holes AS (SELECT x.i AS i, y.i AS j, 8 AS m FROM range(1, 9) x(i), range(1, 9) y(i) WHERE x.i < y.i UNION ALL SELECT i, i, m FROM range(1, 8) x(i), range(4, 8) y(m) WHERE i <= m UNION ALL SELECT 0, 0, m FROM range(1, 4) y(m)),
pat AS (SELECT k, concat_ws(chr(1), n, i, j, array_to_string(k[1:3], chr(2)), array_to_string(list_filter(fs, lambda x, q: q <> i AND q <> j), chr(2))) AS p FROM kinds JOIN holes ON least(n, 8) = m),
many AS (SELECT p FROM l JOIN pat USING (k) GROUP BY p HAVING min(tid) <> max(tid)),
occ AS (SELECT p, tid, pos, chars FROM l JOIN pat USING (k) SEMI JOIN many USING (p)),
place AS (SELECT p, min(tid) AS f FROM occ GROUP BY p),
early AS (SELECT tid, pos, min(f) AS f, max(chars) AS chars FROM occ JOIN place USING (p) GROUP BY ALL),
near0 AS (SELECT tid, f, sum(chars) AS shared FROM early WHERE f <> tid GROUP BY ALL),
words AS (SELECT tid, t, list_filter(string_split_regex(lower(t), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
sh AS (SELECT tid, t, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
near1 AS (SELECT n.tid, n.f, n.shared, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS total FROM near0 n JOIN sh a ON a.tid = n.tid JOIN sh b ON b.tid = n.f WHERE n.shared >= 0.2::DOUBLE * greatest(len(a.t), len(b.t))),
up AS (SELECT tid, first(f ORDER BY shared DESC, f) AS f FROM near1 WHERE c >= 0.8::DOUBLE * (total - c) GROUP BY tid),
chain AS (SELECT tid, f, 1 AS d FROM up UNION ALL SELECT c.tid, up.f, d + 1 FROM chain c JOIN up ON up.tid = c.f),
class AS (SELECT t.tid, coalesce(c.f, t.tid) AS cl FROM texts t LEFT JOIN (SELECT tid, arg_max(f, d) AS f FROM chain GROUP BY tid) c ON c.tid = t.tid),
o2 AS (SELECT p, tid, pos, cl, min(pos) OVER (PARTITION BY p, tid) AS own FROM occ JOIN class USING (tid)),
rec AS (SELECT p, arg_min(cl, tid) AS keeps FROM o2 GROUP BY p HAVING count(DISTINCT cl) >= 2),
gone AS (SELECT DISTINCT tid, pos FROM o2 JOIN rec USING (p) WHERE cl <> keeps OR pos <> own),
kept AS (SELECT tid, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS k FROM l0 ANTI JOIN gone USING (tid, pos) GROUP BY tid),
total AS (SELECT tid, count(*) AS n FROM l0 GROUP BY tid)
SELECT d.doc_id, n AS n_lines, n - coalesce(k, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d JOIN texts ON texts.t = coalesce(d.text, '') JOIN total USING (tid) LEFT JOIN kept ON kept.tid = texts.tid
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS h FROM documents),
b AS (SELECT min(item_id) AS item, h, least(13, len(h)) AS width, CASE WHEN len(h) < 8 THEN len(h) ELSE CAST(ceil(least(13, len(h)) * 0.75) AS BIGINT) END AS need
      FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS h FROM benchmark) WHERE len(h) > 0 GROUP BY h),
dw AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS p, unnest(h) AS w FROM d),
bw AS (SELECT item, need, unnest(range(1, len(h) + 1)) AS p, unnest(h) AS w FROM b),
hits AS (SELECT doc_id, item, dw.p - bw.p AS sh FROM dw JOIN bw USING (w) GROUP BY doc_id, item, sh, need HAVING count(*) >= need),
al AS (SELECT doc_id, item, width, need, greatest(sh, 0) AS lo, greatest(-sh, 0) AS skip, least(len(d.h) - greatest(sh, 0), len(b.h) - greatest(-sh, 0)) AS n, d.h AS dh, b.h AS bh
       FROM hits JOIN d USING (doc_id) JOIN b USING (item)),
win AS (SELECT doc_id, item, width, need, unnest(range(1, n - width + 2)) AS w, list_transform(range(1, n + 1), lambda i: CASE WHEN dh[lo + i] = bh[skip + i] THEN 1 ELSE 0 END) AS same FROM al WHERE n >= width),
best AS (SELECT doc_id, item, need, CAST(max(list_sum(same[w:w + width - 1])) AS INT) AS matches, max(width) AS length FROM win GROUP BY doc_id, item, need),
ok AS (SELECT * FROM best WHERE matches >= need),
per AS (SELECT doc_id, count(*) AS n_items, first(item ORDER BY matches DESC, item) AS item_id, first(matches ORDER BY matches DESC, item) AS matches, first(length ORDER BY matches DESC, item) AS length FROM ok GROUP BY doc_id)
SELECT documents.doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, per.item_id, per.matches, CAST(per.length AS INT) AS length
FROM documents LEFT JOIN per ON documents.doc_id = per.doc_id
"""

#: crc32 of the id as text, bit by bit.
CRC_SQL = "xor(list_reduce([4294967295] || list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

BASE_SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, 8 AS least, string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS f, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v FROM d
  UNION ALL SELECT doc_id, 1, 'access', 16, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', 32, string_split_regex(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}') FROM d),
pl AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s, len(f[i]) AS n FROM pl WHERE len(v[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

BASE_LM_SQL = rf"""
WITH d AS (SELECT doc_id, {CRC_SQL} % 5 = 1 AS held, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS w FROM documents),
t AS (SELECT doc_id, held, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op2_exact": OP2_SQL, "op3_near": OP3_SQL, "op4_lines": OP4_SQL, "op6_decontaminate": OP6_SQL, "base_secrets": BASE_SECRETS_SQL, "base_lm_score": BASE_LM_SQL}
