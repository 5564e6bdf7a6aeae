import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codelode import cli
from codelode.plans import reports, tools
from codelode.schema import FILES_RAW
from codelode.sources import git, lexer, parse, store, tree
from codelode.streaming import incremental

from . import sample_code


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return sample_code.write(tmp_path_factory.mktemp("repo"))


@pytest.fixture(scope="module")
def index(spark, root):
    return tools.Index.of(spark, root)


def test_walk(root):
    files, cut = tree.walk(root)
    paths = [p for p, *_ in files]
    assert not cut
    assert "py/tools/__init__.py" in paths
    assert not any("node_modules" in p or ".hidden" in p or p.endswith(".d.ts") for p in paths)
    assert paths == sorted(paths, key=lambda p: p.split("/"))
    assert tree.walk(root, most=2)[1]
    assert all(not p.startswith("py/") for p, *_ in tree.walk(root, ["py/**"])[0])
    with pytest.raises(NotADirectoryError):
        tree.walk(root + "/nothing")


def test_tables(index):
    assert [r.path for r in index.tables["skipped"].collect()] == ["py/broken.py"]
    fn = {(r.path.split("/")[-1], r.name): r for r in index.tables["functions"].collect()}
    want = {("engine.ts", "feeOf"): (True, 2), ("engine.ts", "refund"): (True, 2), ("place.ts", "place"): (True, 2), ("core.py", "run"): (True, 2), ("core.py", "inner"): (False, 1), ("core.py", "_private"): (False, 0), ("main.go", "Serve"): (True, 1), ("main.go", "helper"): (False, 0), ("Cart.java", "total"): (True, 1), ("Cart.java", "hidden"): (False, 0), ("lib.rs", "visit"): (True, 1), ("lib.rs", "quiet"): (False, 0), ("cart.rb", "total"): (True, 1), ("cart.rb", "sum"): (False, 1), ("Cart.php", "low"): (False, 1), ("Cart.php", "total"): (True, 2), ("list.c", "grow"): (False, 1), ("list.c", "list_push"): (True, 2), ("Cart.cs", "Total"): (True, 1), ("Cart.cs", "Sum"): (False, 1), ("Cart.kt", "total"): (True, 1), ("Cart.kt", "sum"): (False, 1), ("Cart.swift", "total"): (True, 1), ("Cart.swift", "sum"): (False, 1), ("cart.dart", "total"): (True, 1), ("cart.dart", "_sum"): (False, 1), ("View.vue", "pay"): (True, 1), ("PAY.cbl", "PAYROLL"): (True, 1), ("PAY.cbl", "CALC-PAY"): (False, 0)}
    got = {k: (fn[k].exported, fn[k].param_count) for k in want if k in fn}
    assert got == want
    assert fn["View.vue", "pay"].start_line == 6
    assert fn["PAY.cbl", "MAIN-PARA"].calls == ["CALC-EXIT", "CALC-PAY", "DONE-PARA", "TAXPROG"]
    assert fn["Cart.java", "total"].member_calls == ["sum"]
    assert fn["Cart.java", "total"].enclosing_type == "Cart"
    imports = {(r.from_file.split("/")[-1], r.specifier): r for r in index.tables["imports"].collect()}
    assert imports["place.ts", "../billing/types"].is_type_only
    assert imports["place.ts", "../billing/checks"].named == ["checkCard"]
    for k in [("core.py", "../base"), ("main.go", "fmt"), ("Cart.java", "com.acme.b.Store"), ("lib.rs", "crate/util/walk"), ("cart.rb", "./store"), ("Cart.php", "Acme/Store"), ("list.c", "list.h"), ("Cart.cs", "Acme.Store"), ("Cart.kt", "acme.Store"), ("Cart.swift", "Foundation"), ("cart.dart", "store.dart"), ("View.vue", "./x"), ("PAY.cbl", "RATES")]:
        assert k in imports, k
    assert imports["View.vue", "./x"].line == 5
    f = {r.path: r for r in index.files.collect()}
    assert f["py/tools/__init__.py"].is_index
    assert f["src/billing/index.ts"].is_index
    assert f["src/app/main.test.ts"].is_test
    assert f["cob/PAY.cbl"].comment_tokens is None
    assert "fee" in f["src/billing/engine.ts"].comment_tokens


def test_shapes_ignore_names_and_literals(index):
    fn = {r.name: r for r in index.tables["functions"].collect()}
    assert fn["checkCard"].body_hash == fn["verifyOrderCard"].body_hash
    assert fn["checkCard"].literal_hash != fn["verifyOrderCard"].literal_hash
    assert fn["feeOf"].body_hash != fn["charge"].body_hash
    assert fn["helper"].ngram_sketch is None


def test_call_graph_tools(index):
    assert {r.node for r in tools.callers_of(index, "checkCard", 6).collect()} == {"src/billing/engine.ts#charge", "src/orders/place.ts#place", "src/app/main.ts#checkout"}
    assert "src/billing/engine.ts#feeOf" in {r.node for r in tools.callees_of(index, "charge").collect()}
    i = tools.impact_of(index, "checkCard").first()
    assert (i.callers, i.modules, i.bucket) == (3, 3, "local")
    p = tools.path_between(index, "checkout", "feeOf").first()
    assert (p.hops, p.direction) == (2, "callees")
    assert tools.impact_of(index, "checkout").first().bucket == "isolated"


def test_module_tools(index):
    assert {(r.dst) for r in tools.dependencies_of(index, "orders").collect()} == {"billing"}
    assert {(r.src) for r in tools.dependents_of(index, "billing").collect()} == {"app", "orders"}
    deep = {(r.src, r.dst) for r in tools.boundary_check(index).filter("kind = 'deep-import'").collect()}
    assert ("orders", "billing") in deep
    assert ("app", "billing") not in deep
    m = {r.module: r for r in tools.module_metrics(index).collect()}
    assert m["billing"].leverage is not None
    assert m["billing"].locality is None
    h = tools.architecture_health(index).first()
    assert 0 <= h.health <= 100
    assert tools.repo_map(index, 3).first().truncated


def test_duplicate_tools(index):
    got = {(r.tier, r.a_id.split("#")[1], (r.b_id or "#").split("#")[1]) for r in tools.similar_logic_exists(index).collect()}
    assert ("cross-module", "checkCard", "verifyOrderCard") in got
    assert any({a, b} == {"summarizeBook", "summariseBook"} for t, a, b in got if t == "cross-module")
    c = tools.compare_implementations(index, "checkCard", "verifyOrderCard").first()
    assert c.same_shape
    assert not c.same_literals


def test_source_tools(index):
    assert tools.read_function(index, "feeOf").first().text.startswith("// Computes the fee of a card payment\nexport function feeOf")
    assert tools.read_span(index, "py/base.py", 1, 1).first().text == "def helper(x):"
    assert tools.find_symbol(index, "OrderDesk").first().name == "OrderDesk"
    kinds = {r.kind for r in tools.find_references(index, "checkCard").collect()}
    assert kinds == {"definition", "call", "import"}
    assert [r.name for r in tools.file_outline(index, "src/orders/place.ts").collect()] == ["verifyOrderCard", "summariseBook", "OrderDesk", "place"]
    assert tools.tests_for(index, "src/app/main.ts").first().routes == 3
    b = tools.context_bundle(index, "charge", "change", 400)
    assert [s for s, *_ in b] == tools.PROFILES["change"]
    assert len(tools.TOOLS) == 23


def test_questions(index):
    kind, tool, out = tools.query_repository(index, "who calls checkCard?")
    assert (kind, tool) == ("callers", "callers_of")
    assert out.count() == 2
    assert tools.query_repository(index, "good morning") == (None, None, None)
    kind, tool, out = tools.query_repository(index, "explain checkCard")
    assert tool == "context_bundle"
    assert {r.title for r in out.collect()} >= {"source", "callers"}
    best = tools.find_target(index, "where is the order desk").first()
    assert best.name == "OrderDesk"
    assert tools.find_target(index, "what does verifyNothingHere do").count() == 0
    assert [r.name for r in tools.find_target(index, "checkCard").collect()][0] == "checkCard"


def test_changes(spark, root, index, tmp_path):
    other = sample_code.write(tmp_path)
    p = tmp_path / "src/billing/engine.ts"
    p.write_text(p.read_text().replace("amount * rate", "amount * rate * 2"))
    (tmp_path / "src/app/extra.ts").write_text("import { feeOf } from '../billing/engine';\nexport function extra(a: number) { return feeOf(a, 1); }\n")
    head = tools.Index.of(spark, other)
    assert {(r.id.split("#")[1], r.status) for r in tools.diff_context(head, index).collect()} == {("feeOf", "modified"), ("extra", "added")}
    assert "src/billing/engine.ts#charge" in {r.node for r in tools.change_impact(head, index).collect()}
    kinds = {r.kind for r in tools.check_my_changes(head, index).collect()}
    assert "deep-import" in kinds


def test_report_and_policy(index):
    r = json.loads(reports.to_json(reports.report(index)))
    assert "<" not in reports.page(r).split("const data = ")[1].split(";document")[0]
    assert reports.markdown(r).startswith("## Architecture health")
    assert "module" in reports.terminal(r)
    rules = [{"id": "layers", "type": "forbidden-dependency", "from": "orders", "to": "billing"}, {"type": "health-delta"}, {"type": "typo"}, {"id": "floor", "type": "metric-floor", "metric": "seams", "min": 101}]
    found, skipped, invalid = cli.evaluate(r, None, rules)
    assert {v["rule"] for v in found} == {"layers", "floor"}
    assert skipped == {"no_base": 1, "invalid": 1}
    assert invalid == 1
    assert cli.evaluate(r, r, [{"type": "no-new-duplication"}, {"type": "contamination-delta"}])[0] == []
    types = {json.loads(x[0])["type"] for x in reports.graph_json(index).collect()}
    assert types == {"node", "edge"}


def test_git(spark, tmp_path):
    sh = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    sh("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "notes.txt").write_text("n")
    sh("add", "-A")
    sh("commit", "-qm", "one")
    (tmp_path / "notes.txt").write_text("m")
    sh("commit", "-qam", "no code")
    c = git.commits(spark, git.log_lines(str(tmp_path))).collect()
    assert [(r.author, r.files) for r in c] == [("A B", ["a.py"])]
    assert git.old_version(str(tmp_path), "a.py") == ("x = 1\n", "")
    assert git.old_version(str(tmp_path), "gone.py") == (None, "missing")
    assert git.run(str(tmp_path / "none"), "status") is None


def test_store_parses_only_what_is_new(spark, root, tmp_path):
    at = str(tmp_path / "store")
    files = tree.read_tree(spark, root)
    assert store.load(spark, at)[3] == "no index"
    generation, n = store.save(spark, at, files)
    assert (generation, n) == (1, files.count())
    assert store.save(spark, at, files) == (1, 0)
    changed = files.withColumn("content", F.when(F.col("path") == "py/base.py", "def helper(x):\n    return 2 * x\n").otherwise(F.col("content"))).filter("path != 'rs/lib.rs'")
    assert store.save(spark, at, changed) == (2, 1)
    records = store.load(spark, at)[0]
    t = parse.tables(records)
    assert t["files"].filter("path = 'rs/lib.rs'").count() == 0
    assert t["files"].filter("path = 'py/base.py'").count() == 1
    log = tmp_path / "telemetry"
    store.append_telemetry(str(log), "repo_map", {"a": 1}, 5, 10, True)
    assert json.loads(log.read_text())["tokens"] == 3
    log.write_text("x" * store.TELEMETRY_BYTES)
    store.append_telemetry(str(log), "repo_map", {"a": 1}, 5, 10, True)
    assert len(log.read_text().split("\n")) == 2
    assert (tmp_path / "telemetry.1").exists()
    store.append_telemetry(str(tmp_path / "no" / "such" / "folder"), "repo_map", {}, 1, 1, False)


def test_stream_keeps_the_index(spark, root, tmp_path):
    files = tree.read_tree(spark, root).filter("path like 'py/%'")
    files.select(*[c.name for c in FILES_RAW]).write.parquet(str(tmp_path / "in/1"))
    at = str(tmp_path / "store")
    run = lambda: incremental.maintain(incremental.changes(spark, str(tmp_path / "in/*")), at, str(tmp_path / "cp")).awaitTermination()
    run()
    assert store.load(spark, at)[2] == 1
    files.limit(1).select(*[c.name for c in FILES_RAW]).write.parquet(str(tmp_path / "in/2"))
    run()
    assert store.load(spark, at)[2] == 1
    files.limit(1).withColumn("content", F.lit("y = 2\n")).select(*[c.name for c in FILES_RAW]).write.parquet(str(tmp_path / "in/3"))
    run()
    assert store.load(spark, at)[2] == 2


def test_stream_receipts(spark, tmp_path):
    spark.createDataFrame([("k", "same"), ("k", "same"), ("j", "same"), ("k", "other")], "key string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key string, text string").parquet(str(tmp_path / "in"))
    q = incremental.receipts(s).writeStream.format("memory").queryName("receipts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.repeat) for r in spark.sql("SELECT * FROM receipts").collect())
    assert got == [("j", False), ("k", False), ("k", False), ("k", True)]


@pytest.mark.parametrize("text", ["", "{", "}", "function", "function (", "class", "export const x =", "a(b", "'open", "/* open"])
def test_lexer_survives(text):
    for lang in (*lexer.PROFILES, "vue", "rb"):
        assert isinstance(lexer.parse("x", text, lang), dict)


def test_server(index):
    import io

    from codelode import server

    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "file_outline", "arguments": {"path": "py/base.py"}}}, {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "tools/call", "params": {"name": "diff_context"}}, {"id": 6, "method": "tools/call", "params": {"name": "file_outline", "arguments": {"wrong": 1}}}]
    out = io.StringIO()
    server.serve(index, io.StringIO("\n".join([*map(json.dumps, ask), "not json", "[]"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None, None]
    assert len(got[1]["result"]["tools"]) == 23
    assert json.loads(got[2]["result"]["content"][0]["text"])["name"] == "helper"
    assert got[3]["error"]["code"] == -32602
    assert got[4]["result"]["isError"]
    assert got[5]["error"]["code"] == -32602
    assert [r["error"]["code"] for r in got[6:]] == [-32700, -32600]
    one = lambda method, **params: server.handle(index, {"id": 1, "method": method, "params": params}, base=index)
    assert one("ping")["result"] == {}
    assert len(one("resources/list")["result"]["resources"]) == 2
    assert "orders" in one("resources/read", uri="codelode://repo-map")["result"]["contents"][0]["text"]
    assert one("resources/read", uri="codelode://none")["error"]["code"] == -32002
    assert one("resources/read")["error"]["code"] == -32602
    assert one("prompts/list")["result"]["prompts"][0]["name"] == "orient"
    assert "orders" in one("prompts/get", name="orient")["result"]["messages"][0]["content"]["text"]
    assert one("prompts/get", name="x")["error"]["code"] == -32602
    assert one("tools/call", name="diff_context")["result"]["isError"] is False


def test_sections_of_cpp_classes():
    text = "class A {\n  int hidden() { return 1; }\npublic:\n  int open() { return 2; }\nprivate:\n  int shut() { return 3; }\n  int shut2() { return 4; }\n};\nstruct B {\n  int free1() { return 5; }\nprotected:\n  int kin() { return 6; }\n};\nint outside() { return 7; }\n"
    out = {f["name"]: f["exported"] for f in lexer.parse("a.cpp", text, "cpp")["functions"]}
    assert out == {"hidden": False, "open": True, "shut": False, "shut2": False, "free1": True, "kin": False, "outside": True}


TYPED = [
    ("java", "class A { private Store store; void go(Book b, int n) { Cart c = new Cart(); c.add(b); store.put(n); this.stop(); other.run(); b.title = n; } void stop() {} }", {("add", "Cart"), ("put", "Store"), ("stop", "A")}, {"title"}),
    ("ts", "export class A { private store: Store; go(b: Book, n: number) { const c = new Cart(); c.add(b.title); this.store.put(n); this.stop(); x ? y : Zed; } stop() { return 1; } }", {("add", "Cart"), ("put", "Store"), ("stop", "A")}, {"store", "title"}),
    ("go", "package a\nfunc Go(b *Book, n int) { c := &Cart{}; c.Add(b.Title); b.Read(n) }", {("Add", "Cart"), ("Read", "Book")}, {"Title"}),
    ("kt", "class A(val n: Int) { fun go(b: Book) { val c = Cart(); c.add(b); b.read() } }", {("add", "Cart"), ("read", "Book")}, set()),
    ("cpp", "struct A { Store store; int go(Book& b) { Cart* c = make(); c->add(b.title); return store.put(b); } };", {("add", "Cart"), ("put", "Store")}, {"title"}),
    ("rs", "impl A { fn go(&self, b: &Book) { let c: Cart = make(); c.add(b.title); self.stop(); } }", {("add", "Cart"), ("stop", "A")}, {"title"}),
]


@pytest.mark.parametrize(("lang", "text", "typed", "fields"), TYPED, ids=[x[0] for x in TYPED])
def test_receivers_and_fields(lang, text, typed, fields):
    got = lexer.parse(f"a.{lang}", text, lang)
    assert {(m, t) for _, m, t in got["typed_calls"]} == typed
    assert {n for _, n, _, _, field in got["call_sites"] if field} == fields


def test_receivers_in_python():
    from codelode.sources import python_front

    got = python_front.parse("a.py", "class A:\n    def go(self, b: Book, n):\n        c = Cart()\n        c.add(b.title)\n        self.store.put(n)\n        self.stop()\n        n.run()\n    def __init__(self, s: Store):\n        self.store = s\n")
    assert {(f, m, t) for f, m, t in got["typed_calls"]} == {("go", "add", "Cart"), ("go", "put", "Store"), ("go", "stop", "A")}
    assert {(f, n) for f, n, _, _, field in got["call_sites"] if field} == {("go", "title"), ("go", "store"), ("__init__", "store")}


def test_receiver_types_resolve_calls(spark, tmp_path):
    (tmp_path / "src/shop").mkdir(parents=True)
    (tmp_path / "src/shop/Cart.java").write_text("package shop;\npublic class Cart { public int total(int n) { int sum = n + 1; return sum; } }\n")
    (tmp_path / "src/shop/Bill.java").write_text("package shop;\npublic class Bill { public int total(int n) { int sum = n + 2; return sum; } }\n")
    (tmp_path / "src/shop/Desk.java").write_text("package shop;\npublic class Desk { private Bill bill; public int sum(Cart cart) { return cart.total(1); } public int owed() { return bill.total(2); } }\n")
    x = tools.Index.of(spark, str(tmp_path))
    got = {(r.caller.split("#")[1], r.target, r.reason, r.confidence) for r in x.calls.filter("target is not null").collect()}
    assert got == {("sum", "src/shop/Cart.java#total", "receiver-type", 0.85), ("owed", "src/shop/Bill.java#total", "receiver-type", 0.85)}


def test_names_of_the_package():
    import codelode

    for name in codelode.__all__:
        assert getattr(codelode, name)
    with pytest.raises(AttributeError):
        codelode.nothing  # noqa: B018
