import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from codelode.operators import duplicates, governance, graph, intent, metrics, resolution, search, windows


def test_reach_depth_confidence_and_start(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("a", "x", 0.9), ("x", "c", 0.8), ("c", "a", 1.0), ("c", "d", 0.7)], "src string, dst string, confidence double")
    start = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.depth, r.confidence) for r in graph.reach(e, start).collect()}
    assert got == {"b": (1, 1.0), "x": (1, 0.9), "c": (2, 0.8), "d": (3, 0.7)}
    assert {r.node for r in graph.reach(e, start, 1, reverse=True).collect()} == {"c"}
    assert graph.reach(e.limit(0), start).count() == 0


def test_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("z", "a")], "src string, dst string")
    p = graph.shortest_path(e, "a", "d").first()
    assert (p.hops, p.path, p.direction) == (2, ["a", "b", "d"], "callees")
    p = graph.shortest_path(e, "a", "z").first()
    assert (p.hops, p.direction) == (1, "callers")
    assert graph.shortest_path(e, "a", "a").first().hops == 0
    assert graph.shortest_path(e, "d", "nowhere").count() == 0


def test_a_path_longer_than_any_cap(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long").coalesce(1)
    p = graph.shortest_path(e, 0, 70).first()
    assert (p.hops, p.path[-1]) == (70, 70)


def test_affected_counts_changed_callers(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("z", "a", 1.0), ("b", "b", 1.0)], "src string, dst string, confidence double")
    got = {r.node: (r.depth, r.confidence) for r in graph.affected(e, spark.createDataFrame([("a",), ("b",)], "node string")).collect()}
    assert got == {"a": (1, 0.5), "z": (1, 1.0)}


def test_bypasses_and_languages(spark):
    i = spark.createDataFrame([("a/b/x.go", "a/internal/y.go"), ("c/x.go", "a/internal/y.go"), ("c/x.go", "internal/y.go"), ("a/x.go", "a/internal/b/internal/z.go"), ("a/internal/b/q.go", "a/internal/b/internal/z.go")], "from_file string, to_file string")
    assert sorted((r.from_file, r.to_file) for r in graph.bypasses(i).collect()) == [("a/x.go", "a/internal/b/internal/z.go"), ("c/x.go", "a/internal/y.go")]
    f = spark.createDataFrame([("a.py",), ("b.c/d.py",), ("e.ts",), ("Makefile",)], "path string")
    assert [(r.ending, r.files, r.total) for r in graph.languages(f).collect()] == [("py", 2, 3), ("other", 1, 3), ("ts", 1, 3)]


def test_receipts_across_partitions(spark):
    rows = [("k", n, str(n // 3 % 4)) for n in range(400)] + [("j", 1, "x"), ("j", 2, "x"), (None, 1, "a"), (None, 2, "a")]
    got = {(r.k, r.n): r.repeat for r in windows.receipts(spark.createDataFrame(rows, "k string, n int, d string"), ["k"], ["n"], "d").collect()}
    by = {}
    for k, n, d in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert got[k, n] == (by.get(k) == d), (k, n)
        by[k] = d


def test_comment_above_a_declaration(spark):
    from codelode.functions.text import doc_start

    cases = [("/** says\n * what\n */\n@deco\nf()", 5, 1), ("x\n// one\n// two\nf()", 4, 2), ("a\nb\nf()", 3, 3), ("f()", 1, 1), ("/* a */\n\nf()", 3, 3), ("@a\n[b]\nf()", 3, 1), ("x */\nf()", 2, 2)]
    d = spark.createDataFrame([(t, n, w) for t, n, w in cases], "t string, n int, w int")
    assert [(r.t, r.got) for r in d.select("t", "w", doc_start(F.col("t"), F.col("n")).alias("got")).collect()] == [(t, w) for t, _, w in cases]


def test_impact_buckets(spark):
    e = spark.createDataFrame([(f"c{k}", "f") for k in range(5)] + [("f", "g")], "src string, dst string")
    m = spark.createDataFrame([(f"c{k}", f"m{k % 2}") for k in range(5)], "node string, module string")
    got = {r.start: (r.callers, r.modules, r.bucket) for r in graph.impact(e, spark.createDataFrame([("f",), ("c0",)], "node string"), m).collect()}
    assert got == {"f": (5, 2, "moderate"), "c0": (0, 0, "isolated")}


def test_components_match_union_find(spark):
    edges = [(1, 2), (2, 3), (4, 5), (7, 8), (8, 9), (9, 7), (3, 10)]
    e = spark.createDataFrame(edges, "a long, b long")
    n = spark.createDataFrame([(k,) for k in range(1, 11)], "id long")
    got = {r.id: r.label for r in duplicates.components(e, n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7}


def test_cascade_first_step_wins(spark):
    rows = [("a#f", "a", "validateToken", True, 130, 1, 1, 2, ["user", "token"]), ("b#f", "b", "validateToken", True, 130, 1, 2, 2, ["user", "token"]), ("c#g", "c", "validToken", True, 40, 3, 3, 2, ["User", "token"]), ("d#summarizeLedger", "d", "summarizeLedger", True, 40, 4, 4, 1, ["x"]), ("e#summariseLedger", "e", "summariseLedger", True, 40, 5, 5, 1, ["y"]), ("e#t", "e", "t", True, 5, 1, 1, 0, [])]
    f = spark.createDataFrame(rows, "id string, module string, name string, exported boolean, tokens int, body_hash long, literal_hash long, param_count int, params array<string>")
    i = spark.createDataFrame([("a#f", "lib"), ("b#f", "lib")], "id string, target string")
    got = {(r.a_id, r.b_id): (r.kind, r.confidence) for r in duplicates.cascade(f, i).collect()}
    assert got[("a#f", "b#f")] == ("clone", 99)
    assert got[("a#f", "c#g")][0] == "signature"
    assert got[("d#summarizeLedger", "e#summariseLedger")][0] == "naming"
    s = duplicates.contamination_score(duplicates.cascade(f, i), F.lit(10)).first()
    assert s.score <= 100
    assert s.findings == len(got)


def test_tiny_groups_need_one_exported_name(spark):
    rows = [(1, "m", "f", True, 6, 9, 1), (2, "m", "f", True, 6, 9, 1), (3, "m", "f", True, 6, 9, 2), (4, "n", "f", True, 6, 9, 1), (5, "n", "g", True, 6, 9, 1), (6, "o", "f", False, 6, 9, 1), (7, "o", "f", True, 6, 9, 1)]
    f = spark.createDataFrame(rows, "id int, module string, name string, exported boolean, tokens int, body_hash long, literal_hash long")
    assert [(r.module, r["size"]) for r in duplicates.intra_groups(f).collect()] == [("m", 2)]


def test_scores_and_nulls(spark):
    m = spark.createDataFrame([("tests", 0, 0, 0, 0, 0, 0, 0, 50), ("none", 1, 0, 0, 0, 0, 0, 3, 40), ("barrel", 1, 0, 0, 0, 9, 0, 0, 20), ("deep", 3, 1, 0, 0, 0, 0, 0, 72)], "module string, source_files int, functions int, types int, consts int, reexports int, required_params int, private_functions int, loc int")
    got = {r.module: r.depth for r in metrics.depth(m).collect()}
    assert got == {"tests": None, "none": 75, "barrel": 25, "deep": 80}
    h = spark.createDataFrame([("x", 80, None, None, None, None), ("y", None, None, None, None, None), ("z", 100, 100, 100, 100, 0)], "module string, depth int, seams int, leverage int, locality int, contamination int")
    assert {r.module: r.health for r in metrics.composite(h).collect()} == {"x": 80, "y": None, "z": 100}


@pytest.mark.parametrize(("counts", "factor", "owner"), [((5,), 1, "a0"), ((8, 2), 1, "a0"), ((5, 3, 2), 2, "a0"), ((2, 2, 2, 2), 4, None), ((1, 1), 2, None)])
def test_bus_factor(spark, counts, factor, owner):
    rows, c = [], 0
    for a, n in enumerate(counts):
        for _ in range(n):
            rows += [(c, f"a{a}", "m"), (c, f"a{a}", "m")]
            c += 1
    r = metrics.ownership(spark.createDataFrame(rows, "commit int, author string, module string")).first()
    assert (r.bus_factor, r.owner) == (factor, owner)
    assert (r.risk is None) == (sum(counts) < 3)


def test_resolution_ladder(spark):
    fn = spark.createDataFrame([("a.ts#run", "a.ts", "a", "run", None, True), ("a.ts#help", "a.ts", "a", "help", None, True), ("b.ts#help", "b.ts", "b", "help", None, True), ("b.ts#only", "b.ts", "b", "only", None, True), ("c.ts#two", "c.ts", "c", "two", None, True), ("d.ts#two", "d.ts", "d", "two", None, True), ("s.ts#save", "s.ts", "s", "save", "Store", True)], "id string, file string, module string, name string, type string, exported boolean")
    call = lambda name, member=False, receiver=None: ("a.ts#run", "a.ts", "a", name, member, receiver)
    calls = spark.createDataFrame([call("help"), call("only"), call("two"), call("map", True), call("save", True, "Store"), call("run")], "caller string, file string, module string, name string, member boolean, receiver string")
    imports = spark.createDataFrame([("a", "c")], "module string, target_module string")
    types = spark.createDataFrame([("Store", 1, False)], "type string, declared int, is_interface boolean")
    none = spark.createDataFrame([], "file string, name string, target string")
    got = {r.name: (r.reason, r.target, r.confidence) for r in resolution.resolve_calls(calls, fn, imports, none, types).collect()}
    assert got["help"] == ("same-file", "a.ts#help", 1.0)
    assert got["only"] == ("unique-name", "b.ts#only", 0.9)
    assert got["two"] == ("import-scoped", "c.ts#two", 0.7)
    assert got["save"] == ("receiver-type", "s.ts#save", 0.85)
    assert got["map"] == ("unresolved", None, None)
    bound = spark.createDataFrame([("a.ts", "two", "d.ts#two")], "file string, name string, target string")
    got = {r.name: r.target for r in resolution.resolve_calls(calls, fn, imports, bound, types).collect()}
    assert got["two"] == "d.ts#two"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_name_drift_meets_all_near_names_only(spark):
    f = spark.range(15000).selectExpr("id", "id % 7 AS module", "cast(id AS string) AS body_hash", "concat('CommonPrefix#', lpad(id * 3, 6, '0')) AS name")
    out = duplicates.name_drift_pairs(f)
    names = [f"commonprefix#{k * 3:06}" for k in range(15000)]
    near = {}
    for k, x in enumerate(names):
        for i in range(len(x)):
            near.setdefault((i, x[:i] + x[i + 1 :]), []).append(k)
    pairs = {(a, b) for g in near.values() for a in g for b in g if a < b and a % 7 != b % 7}
    began = time.monotonic()
    got = {(r.a_id, r.b_id) for r in out.collect()}
    assert time.monotonic() - began < 30  # all pairs of 15,000 names take minutes
    assert got == pairs

    # lengths around those from which one, two and three edits are allowed; every second name is an edit or two from another
    rng, said = random.Random(3), []
    for size in (11, 12, 13, 21, 22, 23, 24, 35, 36, 37):
        for _ in range(8):
            x = "".join(rng.choice("abc") for _ in range(size))
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                at, what = rng.randrange(len(y)), rng.randrange(3)
                y[at : at + (what != 0)] = [] if what == 1 else [rng.choice("abc")]
            said += [x, "".join(y)]
    f = spark.createDataFrame([(k, k % 5, str(k), x) for k, x in enumerate(said)], "id int, module int, body_hash string, name string")
    got = {(r.a_id, r.b_id) for r in duplicates.name_drift_pairs(f).collect()}
    sim = lambda x, y: 1 - edits(x, y) / max(len(x), len(y))
    assert got == {(a, b) for a, x in enumerate(said) for b, y in enumerate(said) if a < b and a % 5 != b % 5 and 0.92 <= sim(x, y) < 1}
    assert len(got) > 20


def test_signatures_with_a_common_parameter(spark):
    f = spark.range(20000).selectExpr("id", "concat('m', id % 5) AS module", "concat('load', id) AS name", "cast(id AS string) AS body_hash", "99 AS tokens", "4 AS param_count", "array('ctx', concat('a', id div 2), concat('b', id div 2), concat('c', id)) AS params")
    began = time.monotonic()
    got = [(r.a_id, r.b_id, r.signature) for r in duplicates.signature_pairs(f).collect()]
    assert time.monotonic() - began < 30  # all pairs of 20,000 signatures take minutes
    assert sorted(got) == [(k, k + 1, 0.6) for k in range(0, 20000, 2)]

    rng, fns = random.Random(9), []
    for k in range(240):
        few = rng.sample("abcdefghijklmnop", rng.choice((1, 2, 3, 3, 4, 5, 6, 8, 12)))
        for x in (few, [*few[rng.randint(0, 2) :], *rng.sample("qrs", rng.randint(0, 2))]):
            fns.append((len(fns), f"m{rng.randint(0, 2)}", rng.choice(("load", "loads", "store")), str(rng.randint(0, 200)), 99, rng.choice((2, 3)), x))
    got = sorted((r.a_id, r.b_id) for r in duplicates.signature_pairs(spark.createDataFrame(fns, "id int, module string, name string, body_hash string, tokens int, param_count int, params array<string>")).collect())
    alike = lambda x, y: len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y)) > 0 and (x and y)
    want = [(x[0], y[0]) for x in fns for y in fns if x[0] < y[0] and x[1] != y[1] and x[3] != y[3] and x[5] == y[5] and alike(x[6], y[6]) and 1 - edits(x[2], y[2]) / max(len(x[2]), len(y[2])) >= 0.55]
    assert got == want and len(want) > 100


def test_literal_drift_of_many_functions(spark, monkeypatch):
    rows, settle = [], duplicates.settle
    monkeypatch.setattr(duplicates, "settle", lambda df: (out := settle(df), rows.append(out.count()))[0])
    f = spark.range(2000).selectExpr("id", "concat('get user ', id % 2) AS name", "'b' AS body_hash", "cast(id AS string) AS literal_hash")
    got = duplicates.literal_drift(f).collect()
    assert len(got) == 2000 and {r.cluster for r in got} == {0}
    assert max(rows) <= 2000

    # every body is a trial; few literals and names, so that all shapes of literal sets meet
    rng = random.Random(5)
    names = ["get user", "user get", "get user now", "put user", "put order", "now"]
    fns = [(100 * body + k, rng.choice(names[: 2 + body % 5]), f"b{body}", rng.choice("xyzw"[: 1 + body % 4])) for body in range(120) for k in range(rng.randint(2, 9))]
    label = {x[0]: x[0] for x in fns}
    half = lambda a, b: 2 * len(a & b) >= len(a | b)
    edges = [(x[0], y[0]) for x in fns for y in fns if x[0] < y[0] and x[2] == y[2] and x[1] != y[1] and x[3] != y[3] and half(set(x[1].split()), set(y[1].split()))]
    for _ in range(12):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.cluster for r in duplicates.literal_drift(spark.createDataFrame(fns, "id long, name string, body_hash string, literal_hash string")).collect()}
    assert got == {k: label[k] for e in edges for k in e}


def test_common_names_are_counted_not_spelled_out(spark, monkeypatch):
    rows, settle = [], resolution.settle
    monkeypatch.setattr(resolution, "settle", lambda df: (out := settle(df), rows.append(out.count()))[0])
    made = [(f"f{k}", f"a{k}.ts", "a", "get", None, True) for k in range(200)] + [(f"g{k}", f"g{k}.ts", "g", "scoped", None, True) for k in range(4)] + [("h", "h.ts", "m", "again", None, True), ("i", "i.ts", "i", "again", None, True), ("self", "s.ts", "m", "self", None, True)]
    fn = spark.createDataFrame(made, "id string, file string, module string, name string, type string, exported boolean")
    said = [(f"c{k}", "m.ts", "m", "get", False, None) for k in range(200)] + [("c0", "m.ts", "m", "scoped", True, None), ("c0", "m.ts", "m", "gone", False, None), ("c0", "m.ts", "m", "again", False, None), ("h", "h.ts", "m", "again", False, None), ("self", "s.ts", "m", "self", False, None), ("f0", "a0.ts", "a", "get", False, None), ("f1", "a1.ts", "a", "get", True, None)]
    calls = spark.createDataFrame(said, "caller string, file string, module string, name string, member boolean, receiver string")
    imports = spark.createDataFrame([("m", "g"), ("m", "m")], "module string, target_module string")
    none = spark.createDataFrame([], "file string, name string, target string")
    types = spark.createDataFrame([], "type string, is_interface boolean, declared int")
    got = {(r.caller, r.name, r.target, r.reason) for r in resolution.resolve_calls(calls, fn, imports, none, types).collect()}
    want = {(f"c{k}", "get", None, "unresolved") for k in range(200)} | {("c0", "scoped", f"g{k}", "module-scoped") for k in range(4)} | {("c0", "gone", None, "unresolved"), ("c0", "again", "h", "import-scoped")}
    # a function's other namesake is its target; its own file, with namesakes elsewhere, is none; alone of its name, it is no call at all
    assert got == want | {("h", "again", "i", "unique-name"), ("f0", "get", None, "unresolved"), ("f1", "get", None, "unresolved")}
    assert max(rows) <= 10


def test_unresolved_calls_of_common_names(spark, monkeypatch):
    rows, settle = [], resolution.settle
    monkeypatch.setattr(resolution, "settle", lambda df: (out := settle(df), rows.append(out.count()))[0])
    fn = spark.range(300).selectExpr("concat('f', id) AS id", "concat(id, '.ts') AS file", "'a' AS module", "concat('n', id % 2) AS name", "CAST(NULL AS STRING) AS type", "true AS exported")
    calls = spark.range(300).selectExpr("concat('c', id % 100) AS caller", "'m.ts' AS file", "'m' AS module", "concat('n', id % 3) AS name", "false AS member", "CAST(NULL AS STRING) AS receiver")
    imports = spark.createDataFrame([], "module string, target_module string")
    bound = spark.createDataFrame([("m.ts", "n1", "f1")], "file string, name string, target string")
    types = spark.createDataFrame([], "type string, is_interface boolean, declared int")
    out = resolution.unresolved_calls(resolution.resolve_calls(calls, fn, imports, bound, types))
    assert {(r.caller, r.unresolved) for r in out.collect()} == {(f"c{k}", 2) for k in range(100)}
    assert max(rows) <= 3


def test_relative_and_tail_imports(spark):
    files = spark.createDataFrame([("src/a/index.ts",), ("src/b.ts",), ("src/c.js",)], "path string")
    i = spark.createDataFrame([("src/x.ts", 0, "./a"), ("src/x.ts", 1, "./b.js"), ("src/q/x.ts", 2, "../c"), ("src/x.ts", 3, "./gone")], "from_file string, seq int, specifier string")
    assert {r.seq: r.to_file for r in resolution.relative_targets(i, files).collect()} == {0: "src/a/index.ts", 1: "src/b.ts", 2: "src/c.js"}
    f = spark.createDataFrame([("x/com/acme/A", "m1"), ("y/com/acme/B", "m2"), ("y/util/B", "m3")], "path string, module string")
    q = spark.createDataFrame([("1", "com/acme/A"), ("2", "B"), ("3", "org/acme/B")], "id string, path string")
    assert {r.id: (r.module, r.segments) for r in resolution.unique_suffix(q, f).collect()} == {"1": ("m1", 3), "3": ("m2", 2)}


def test_types_routes_and_lookup(spark):
    types = spark.createDataFrame([("T", "a", "m"), ("T", "b", "n"), ("U", "c", "n")], "name string, file string, module string")
    refs = spark.createDataFrame([(1, "T", "a", "m"), (2, "T", "x", "n"), (3, "T", "x", "z"), (4, "U", "x", "z"), (5, "V", "x", "z")], "id int, name string, file string, module string")
    assert {r.id: (r.status, r.file) for r in resolution.resolve_type(refs, types).collect()} == {1: ("same-file", "a"), 2: ("same-module", "b"), 3: ("ambiguous", None), 4: ("unique", "c"), 5: ("none", None)}
    v = spark.createDataFrame([(1, "db/x", "db", "services")], "violation int, to_file string, to_module string, allowed_via string")
    e = spark.createDataFrame([(1, "s/a", "services", "db/y", "db"), (2, "s/b", "services", "db/x", "db"), (3, "u/c", "ui", "db/x", "db")], "ord int, from_file string, from_module string, to_file string, to_module string")
    assert [(r.via, r.same_file) for r in resolution.legal_routes(v, e).collect()] == [("s/b", True)]
    m = spark.createDataFrame([("Auth",), ("auth",), ("authz",)], "name string")
    assert {(r.name, r.status) for r in resolution.lookup(m, "auth").collect()} == {("auth", "resolved")}
    assert {r.status for r in resolution.lookup(m, "AUTH").collect()} == {"ambiguous"}


def test_search_and_resolve(spark):
    s = spark.createDataFrame([(1, "verifyToken", ["verify", "token"], True), (2, "VerifyToken", ["verify", "token"], False), (3, "tokenVerifyNow", ["token", "verify", "now"], False), (4, "tokens", ["tokens"], True)], "id int, name string, tokens array<string>, exported boolean")
    got = {r.id: r.score for r in search.symbol_search(s, F.lit("verifyToken"), F.array(F.lit("verify"), F.lit("token"))).collect()}
    assert got == {1: 1.0, 2: 0.95, 3: 0.85}
    c = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.5), (2, "b", 0.45), (3, "a", 0.3)], "q int, id string, confidence double")
    assert {r.q: (r.status, r.target) for r in search.resolve(c, ["q"]).collect()} == {1: ("resolved", "a"), 2: ("ambiguous", "a"), 3: ("unresolved", None)}
    f = spark.createDataFrame([(True, False, False, 1.0, 1.0, True, True, False), (False, False, True, 0.5, 0.0, False, False, True)], "exact boolean, all_tokens boolean, subset boolean, coverage double, lexical double, path_hit boolean, exported boolean, is_test boolean")
    assert [r.confidence for r in search.target_score(f).collect()] == [1.0, 0.1375]


def test_bm25_orders_and_counts_repeats(spark):
    d = spark.createDataFrame([(1, ["token", "auth"]), (2, ["token", "token", "x", "y"]), (3, ["z"])], "id int, terms array<string>")
    once = {r.id: r.score for r in search.bm25(d, ["auth"]).collect()}
    twice = {r.id: r.score for r in search.bm25(d, ["auth", "auth"]).collect()}
    assert set(once) == {1}
    assert twice[1] == pytest.approx(2 * once[1])
    assert search.bm25(d, ["nothing"]).count() == 0


def test_every_intent_rule_fires():
    questions = {"blast.breaks-if": "what breaks if x", "blast.impact": "the blast radius", "blast.safe-to": "safe to remove it", "callees.what-does-call": "what does x call", "callers.who-calls": "who calls x", "callers.called-by": "invoked by", "callers.who-uses": "who invokes it", "refs.where-used": "usages of x", "deps.depends-on": "what does x depend on", "dependents.what-depends": "what depends on x", "similar.find": "similar code", "tests.what-tests": "tests for x", "arch.violations": "layering", "history.changed": "churn", "path.between": "path from a to b", "source.show-code": "show the code", "source.read": "read the function", "explain.what-does": "purpose of x", "overview.orient": "overview", "locate.where": "where is x", "locate.implemented": "x implemented"}
    import re

    for rule, q in questions.items():
        assert next(r for r, _, p in intent.RULES if re.search(p, q)) == rule
    assert intent.route("hello") == (None, None)
    assert intent.route("What tests cover `x`?") == ("tests", "tests_for")


def test_entities(spark):
    r = spark.range(1).select(intent.quoted(F.lit("where is 'verify token' used")).alias("q"), intent.code_shaped(F.lit("does authMiddleware call db.save or parse_url")).alias("c")).first()
    assert r.q == ["verify token"]
    assert r.c == ["authMiddleware", "db.save", "parse_url"]


def test_windows(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 9)], "k string, n int")
    assert sorted((r.first, r.last, r.n) for r in windows.islands(d, ["k"], "n").collect()) == [(1, 4, 3), (9, 9, 1)]
    s = spark.createDataFrame([("f", 1, 5), ("f", 3, 7), ("f", 10, 10)], "k string, start int, end int")
    c = windows.coverage(s, ["k"]).first()
    assert (c.covered, c.percent) == (8, 80)
    p = windows.nearest_rank(spark.createDataFrame([("x", float(k)) for k in range(1, 11)], "k string, v double"), ["k"], "v").first()
    assert (p.p50, p.p95) == (5.0, None)
    out = windows.render_budgeted([("one", ["aaaa"] * 10), ("two", ["b"])], 14)
    assert out[0][2] > 0
    assert out[1][0] == "two"


def test_policy(spark):
    rules = spark.createDataFrame([("health-delta", None, None), ("nope", None, None), ("forbidden-dependency", None, None), ("forbidden-dependency", "db", "m")], "type string, `to` string, module string")
    assert sorted(r.problem for r in governance.invalid_rules(rules).collect()) == ["missing to", "module is not used here", "unknown type"]
    assert {r.outcome: r.rules for r in governance.skipped(rules, True, True).collect()} == {"evaluated": 2, "invalid": 2}
    assert [governance.exit_code(*x) for x in ((0, 0, 1, False), (2, 2, 0, True), (2, 2, 0, False))] == [2, 1, 0]
    assert governance.conclusion(1, 0, 0, False) == "neutral"
    assert governance.complete_pairs(None, 20, None) is False
    assert governance.complete_pairs(None, 19, None) is True
    many = [{"rule": "r", "message": "m", "file": f"f{k}", "line": 1, "block": True, "fingerprint": str(k)} for k in range(60)]
    run = governance.check_run(many, 0, True)
    assert run["conclusion"] == "failure"
    assert len(run["output"]["annotations"]) == 50
    assert "10 more" in run["output"]["summary"]
    assert '"level": "error"' in governance.sarif(many[:1], [{"rule": "x", "reason": "no base"}])


def test_alerts(spark):
    s = "module string, depth int, seams int, leverage int, locality int, bus_factor int"
    base = spark.createDataFrame([("a", 80, 80, 80, 80, 3), ("gone", 1, 1, 1, 1, 1)], s)
    head = spark.createDataFrame([("a", 70, 75, None, 80, 1), ("new", 1, 1, 1, 1, 1)], s)
    got = {(r.module, r.kind, r.metric) for r in governance.alerts(head, base).collect()}
    assert got == {("a", "metric-drop", "depth"), ("a", "metric-unavailable", "leverage"), ("a", "bus-factor-one", "bus_factor"), ("new", "module-added", ""), ("gone", "module-removed", "")}
    row = lambda h, b, c: Row(health=h, band=b, contamination=c)
    assert governance.report_alerts(row(50, "Shallow", 9), row(70, "Moderate", 0), 2) == [("health-band-drop", "critical"), ("contamination-spike", "warn"), ("new-clones", "warn")]
    assert governance.report_alerts(row(None, "n/a", 0), row(70, "Moderate", 0), 0) == []


def test_alerts_of_reports():
    row = lambda name, **m: {"module": name, "depth": 80, "seams": 80, "leverage": None, "locality": 80, "bus_factor": 3, "in_cycle": False, "files": 2, "top_author": "ann"} | m
    got = governance.module_alerts([row("a", depth=60, bus_factor=1, in_cycle=True, locality=None), row("new")], [row("a"), row("gone")])
    assert [(e["severity"], e["kind"], e["module"]) for e in got] == [("critical", "bus-factor-one", "a"), ("critical", "new-cycle", "a"), ("warn", "metric-drop", "a"), ("info", "metric-unavailable", "a"), ("info", "module-added", "new"), ("info", "module-removed", "gone")]
    assert got[0]["route"] == "ann"


def test_disclosures():
    from codelode.cli import _glob, evaluate

    report = {"modules": [{"module": "one"}], "importEdges": [], "filesScanned": 3, "skippedFiles": 2, "health": {"score": None}, "contamination": {"pairKeys": None, "findings": [{}] * 20, "total": None, "score": None}}
    said = governance.disclosures(report, [{"id": "r", "type": "forbidden-dependency", "from": "*", "to": "db"}], _glob)
    assert len(said) == 4
    assert said[0] == "r: no module is named by to db"
    base = {"health": {"score": 70}, "contamination": {"score": 3, "findings": [], "pairKeys": []}}
    assert evaluate(report, base, [{"type": "health-delta"}, {"type": "contamination-delta"}])[:2] == ([], {"not_measured": 2})


def test_totals_stay_with_cut_answers(spark):
    d = spark.createDataFrame([("g", k) for k in range(20)], "k string, n int")
    top = graph.ranked(d, [F.desc("n")], 3).collect()
    assert [(r.n, r.total, r.truncated) for r in top] == [(19, 20, True), (18, 20, True), (17, 20, True)]
    c = windows.capped(d, ["k"], [F.col("n")], 12)
    assert c.filter("more is not null").first().more == 8
