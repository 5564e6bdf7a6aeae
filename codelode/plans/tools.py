"""The 23 tools over the canonical tables: each a function that returns a DataFrame; capped answers carry their totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions.hashing import content_hash
from codelode.functions.text import camel_tokens, doc_start, query_tokens, span, specifier_package, test_stem
from codelode.operators import duplicates, governance, graph, intent, metrics, resolution, search, windows
from codelode.sources import parse, tree


@dataclass
class Index:
    """A snapshot: the canonical tables, and the graph derived from them once."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    raw: DataFrame | None = None
    commits: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, root: str, ignore: list[str] | None = None) -> Index:
        raw = tree.read_tree(spark, root, ignore)
        records = parse.parsed(raw).cache()
        return cls(spark, parse.tables(records), raw)

    @property
    def files(self) -> DataFrame:
        return self.tables["files"]

    @cached_property
    def functions(self) -> DataFrame:
        """Functions outside tests; of one path and name the first declaration counts."""
        tests = self.files.filter("is_test").select("path")
        f = self.tables["functions"].join(tests, "path", "left_anti")
        first = Window.partitionBy("path", "name").orderBy("fn_ord")
        f = f.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
        return f.withColumn("id", F.concat_ws("#", "path", "name")).persist()

    @cached_property
    def file_imports(self) -> DataFrame:
        """Import statements with the file they reach; tests left out."""
        i = self.tables["imports"].filter("not from_is_test")
        target = resolution.relative_targets(i, self.files.select("path"))
        dotted = i.filter(~F.col("specifier").startswith(".")).select(F.concat_ws(":", "from_file", "seq").alias("id"), F.regexp_replace("specifier", r"\.", "/").alias("path"))
        stems = self.files.select(F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("path"), "module", F.col("path").alias("real"))
        by_tail = resolution.unique_suffix(dotted, stems.select("path", "module")).join(stems.select(F.col("path").alias("file"), "real"), "file").select("id", "real")
        out = i.withColumn("id", F.concat_ws(":", "from_file", "seq")).join(target, ["from_file", "seq"], "left").join(by_tail, "id", "left")
        out = out.withColumn("to_file", F.coalesce("to_file", "real")).drop("real").filter("to_file != from_file or to_file is null")
        m = self.files.select(F.col("path").alias("to_file"), F.col("module").alias("to_module"), F.col("is_index").alias("to_index"))
        return out.join(m, "to_file", "left").persist()

    @cached_property
    def module_imports(self) -> DataFrame:
        i = self.file_imports.filter("to_module is not null")
        return i.select(F.col("from_module").alias("src"), F.col("to_module").alias("dst"), F.col("to_file").alias("target"), "from_file", "line", "is_type_only", F.explode_outer("named").alias("name"))

    @cached_property
    def calls(self) -> DataFrame:
        """Resolved calls: caller, name, target, reason, confidence; unresolved ones have no target."""
        f = self.functions
        fn = f.select("id", F.col("path").alias("file"), "module", "name", F.col("enclosing_type").alias("type"), "exported")
        one = lambda c, member: f.select(F.col("id").alias("caller"), F.col("path").alias("file"), "module", F.explode(c).alias("name"), F.lit(member).alias("member"), F.lit(None).cast("string").alias("receiver"))
        typed = self.tables["typed_calls"].select(F.concat_ws("#", "path", "fn").alias("caller"), F.col("method").alias("name"), F.col("type").alias("of")).distinct()
        member = one("member_calls", True).join(typed, ["caller", "name"], "left").withColumn("receiver", F.col("of")).drop("of")
        calls = one("calls", False).unionByName(member)
        named = self.file_imports.filter("to_file is not null and not is_type_only").select(F.col("from_file").alias("file"), "to_file", F.explode("named").alias("name"))
        bindings = named.join(fn.filter("exported").select(F.col("file").alias("to_file"), "name", F.col("id").alias("target")), ["to_file", "name"]).select("file", "name", "target").distinct()
        modules = self.file_imports.filter("to_module is not null").select(F.col("from_module").alias("module"), F.col("to_module").alias("target_module")).distinct()
        types = self.tables["symbols"].filter("kind in ('class', 'interface')").groupBy(F.col("name").alias("type")).agg(F.count(F.lit(1)).alias("declared"), F.max(F.col("kind") == "interface").alias("is_interface"))
        return resolution.resolve_calls(calls, fn, modules, bindings, types).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return self.calls.filter("target is not null").groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.max("confidence").alias("confidence")).persist()

    def find(self, name: str) -> DataFrame:
        """Functions of a name: file#name, exact, ignoring case, or a part of it, first tier that answers."""
        low = name.lower()
        tier = F.when(F.col("id") == name, 0).when(F.col("name") == name, 1).when(F.lower("name") == low, 2).when(F.lower("name").contains(low), 3)
        hit = self.functions.withColumn("tier", tier).filter("tier is not null")
        best = hit.agg(F.min("tier").alias("tier"))
        return hit.join(F.broadcast(best), "tier").select(F.col("id").alias("node"), "path", "name", "start_line", "end_line")


def repo_map(x: Index, modules: int = 18) -> DataFrame:
    """Modules by the modules that import them, with files and lines."""
    m = x.files.filter("not is_test").groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("code_lines").alias("code_lines"))
    used = graph.fan_in(graph.module_edges(x.module_imports)).select(F.col("dst").alias("module"), "fan_in")
    return graph.ranked(m.join(used, "module", "left").fillna(0, ["fan_in"]), [F.desc("fan_in"), F.col("module")], modules)


def file_outline(x: Index, path: str) -> DataFrame:
    """Symbols and functions of a file in line order; functions inside a class have depth 1."""
    s = x.tables["symbols"].filter(F.col("path") == path).select("name", "kind", "start_line", "end_line", "exported", F.lit(0).alias("depth"))
    inner = x.functions.filter((F.col("path") == path) & F.col("enclosing_type").isNotNull()).select("name", F.lit("method").alias("kind"), "start_line", "end_line", "exported", F.lit(1).alias("depth"))
    return s.unionByName(inner).orderBy("start_line", "depth", "name")


def read_span(x: Index, path: str, start: int, end: int, context: int = 0, most: int = 320) -> DataFrame:
    """Lines of a file; what was asked beyond the limit is said."""
    lo, want = max(1, start - min(context, 50)), end + min(context, 50)
    hi = min(want, lo + most - 1)
    return x.raw.filter(F.col("path") == path).select("path", F.lit(lo).alias("first"), F.lit(hi).alias("last"), F.lit(want > hi).alias("clamped"), span(F.col("content"), F.lit(lo), F.lit(hi)).alias("text"))


def read_function(x: Index, name: str, most: int = 160) -> DataFrame:
    """A function's lines, from the comment above it; what was cut is said."""
    f = x.find(name).join(x.raw.select("path", "content"), "path").withColumn("first", doc_start(F.col("content"), F.col("start_line")))
    last = F.least("end_line", F.col("first") + most - 1)
    return f.select("node", "start_line", "first", last.alias("last"), (F.col("end_line") > last).alias("clamped"), span(F.col("content"), F.col("first"), last).alias("text"))


def find_symbol(x: Index, query: str, limit: int = 8) -> DataFrame:
    s = x.tables["symbols"].select("path", "name", "kind", "start_line", "exported", camel_tokens(F.col("name")).alias("tokens"))
    tokens = query_tokens(F.lit(query))
    return graph.ranked(search.symbol_search(s, F.lit(query), tokens).drop("tokens"), [F.desc("score"), F.length("name"), F.col("path"), F.col("start_line")], min(limit, 25))


def find_references(x: Index, name: str, limit: int = 40) -> DataFrame:
    d = x.tables["symbols"].filter(F.col("name") == name).select(F.col("path").alias("file"), F.col("start_line").alias("line"), F.lit("definition").alias("kind"))
    c = x.tables["call_sites"].filter(F.col("name") == name).select(F.col("path").alias("file"), "line", F.when(F.col("is_field"), "field-access").when(F.col("member"), "member-call").otherwise("call").alias("kind"))
    i = x.tables["imports"].filter(F.array_contains("named", name)).select(F.col("from_file").alias("file"), "line", F.lit("import").alias("kind"))
    return graph.ranked(search.references(d, c, i), [F.col("file"), F.col("line"), F.col("kind")], min(limit, 200))


def _module_scores(x: Index) -> DataFrame:
    f = x.files
    src = f.filter("not is_test")
    m = f.groupBy("module").agg(F.count_if(~F.col("is_test")).alias("source_files"), F.sum("code_lines").alias("all_lines"), F.count(F.lit(1)).alias("files"), F.max(F.col("is_index") & ~F.col("is_test")).alias("has_interface"), F.max(F.col("lang").isin("ts", "py", "vue")).alias("needs_interface"))
    loc = src.groupBy("module").agg(F.sum("code_lines").alias("loc"), F.sum("internal_functions").alias("private_functions"))
    e = x.tables["exports"].filter("not is_test").groupBy("module").agg(F.count_if(F.col("kind").isin("function", "class")).alias("functions"), F.count_if(F.col("kind") == "type").alias("types"), F.count_if(F.col("kind") == "const").alias("consts"), F.count_if(F.col("kind") == "reexport").alias("reexports"), F.coalesce(F.sum(F.when(F.col("kind") == "function", F.col("required_params"))), F.lit(0)).alias("required_params"), F.count_distinct("name").alias("exported"))
    m = m.join(loc, "module", "left").join(e, "module", "left").fillna(0)
    i = x.module_imports
    interfaces = src.filter("is_index").groupBy("module").agg(F.min("path").alias("file"))
    deep = graph.deep_imports(i, interfaces).groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("deep"))
    c = graph.mutual_cycles(i.filter("not is_type_only"))
    cyc = c.select(F.col("a").alias("module")).union(c.select("b")).distinct().withColumn("in_cycle", F.lit(True))
    stems = f.filter("is_test").select(test_stem(F.col("path")).alias("stem"))
    tested = src.select("module", test_stem(F.col("path")).alias("stem")).join(stems, "stem", "left_semi").select("module").union(f.filter("is_test").select("module")).distinct().withColumn("tested", F.lit(True))
    used = graph.used_exports(i).select(F.col("dst").alias("module"), F.col("used_exports").alias("used"), F.col("imported_by").alias("callers"))
    m = m.join(deep, "module", "left").join(cyc, "module", "left").join(tested, "module", "left").join(used, "module", "left").fillna(0, ["deep", "used", "callers"]).fillna(False, ["in_cycle", "tested"])
    n = m.count()
    out = metrics.depth(m).drop("label").join(metrics.seams(m).drop("label"), "module").join(metrics.leverage(m, F.lit(n)).drop("label"), "module").join(m.select("module", "exported", "source_files", "all_lines", "files", "in_cycle"), "module")
    if x.commits is None:
        return out.withColumn("locality", F.lit(None).cast("long")).withColumn("bus_factor", F.lit(None).cast("long")).withColumn("risk", F.lit(None).cast("long")).withColumn("top_author", F.lit(None).cast("string"))
    t = x.commits.select(F.col("commit_id").alias("commit"), "author", F.explode("files").alias("file")).join(f.select(F.col("path").alias("file"), "module"), "file").withColumn("dir", F.get(F.split("file", "/"), F.lit(0)))
    return out.join(metrics.locality(metrics.cochange(t)).select("module", "locality"), "module", "left").join(metrics.ownership(t).select("module", "bus_factor", "risk", "top_author"), "module", "left")


def module_metrics(x: Index, module: str | None = None) -> DataFrame:
    m = _module_scores(x)
    return m.filter(F.col("module") == module) if module else m


def architecture_health(x: Index) -> DataFrame:
    """One row: the composite and its parts; NULL where there are no files."""
    m = _module_scores(x)
    c = duplicates.contamination_score(findings(x), F.lit(0)).select(F.col("score").alias("contamination"))
    means = m.agg(*[F.floor(F.avg(k) + 0.5).alias(k) for k in ("depth", "seams", "leverage", "locality")], F.count(F.lit(1)).alias("modules"))
    out = means.join(c, F.lit(True)).withColumn("contamination", F.when(F.col("modules") > 0, F.col("contamination")))
    return metrics.composite(out)


def _duplicate_view(x: Index) -> DataFrame:
    f = x.functions
    return f.select("id", "module", "name", "exported", F.col("body_tokens").alias("tokens"), "body_hash", "literal_hash", "param_count", F.col("param_names").alias("params"), F.col("ngram_sketch").alias("sketch"))


def findings(x: Index) -> DataFrame:
    f = _duplicate_view(x).filter(F.col("tokens") >= duplicates.CANDIDATE_TOKENS)
    i = x.file_imports.select(F.col("from_file").alias("path"), F.coalesce("to_file", specifier_package(F.col("specifier"))).alias("target"))
    i = i.join(x.functions.select("path", "id"), "path").select("id", "target")
    return duplicates.cascade(f, i)


def similar_logic_exists(x: Index, limit: int = 20) -> DataFrame:
    """Copies across modules, copies within one, near copies: each tier's first rows with its total."""
    a = findings(x).select(F.lit("cross-module").alias("tier"), "a_id", "b_id", F.col("confidence").cast("double").alias("score"))
    view = _duplicate_view(x)
    g = duplicates.intra_groups(view).select(F.lit("intra-module").alias("tier"), F.col("first_id").alias("a_id"), F.lit(None).cast("string").alias("b_id"), F.col("size").cast("double").alias("score"))
    n = duplicates.near_pairs(view.filter(F.col("sketch").isNotNull() & ~F.col("name").startswith("("))).select(F.lit("near").alias("tier"), "a_id", "b_id", F.col("similarity").alias("score"))
    return graph.ranked_within(a.unionByName(g).unionByName(n), ["tier"], [F.desc("score"), F.col("a_id"), F.col("b_id")], limit)


def callers_of(x: Index, name: str, depth: int = 1, limit: int = 25) -> DataFrame:
    return graph.ranked(graph.reach(x.edges, x.find(name).select("node"), depth, reverse=True), [F.col("depth"), F.desc("confidence"), F.col("node")], limit)


def callees_of(x: Index, name: str, depth: int = 1, limit: int = 25) -> DataFrame:
    return graph.ranked(graph.reach(x.edges, x.find(name).select("node"), depth), [F.col("depth"), F.desc("confidence"), F.col("node")], limit)


def impact_of(x: Index, name: str) -> DataFrame:
    """Transitive callers and a bucket; a lower bound where any call has no target."""
    m = x.functions.select(F.col("id").alias("node"), "module")
    out = graph.impact(x.edges, x.find(name).select("node"), m, graph.MAX_DEPTH)
    return out.withColumn("lower_bound", F.lit(x.calls.filter("target is null").limit(1).count() > 0))


def path_between(x: Index, a: str, b: str) -> DataFrame:
    one = lambda n: x.find(n).select("node").orderBy("node").first()
    start, goal = one(a), one(b)
    if start is None or goal is None:
        return x.spark.createDataFrame([], "hops int, path array<string>, direction string")
    return graph.shortest_path(x.edges, start[0], goal[0])


def dependencies_of(x: Index, module: str) -> DataFrame:
    return graph.module_edges(x.module_imports).filter(F.col("src") == module).orderBy(F.desc("imports"), "dst")


def dependents_of(x: Index, module: str) -> DataFrame:
    return graph.module_edges(x.module_imports).filter(F.col("dst") == module).orderBy(F.desc("imports"), "src")


def boundary_check(x: Index, module: str | None = None) -> DataFrame:
    """Deep imports, imports past an internal folder's holder, and mutual cycles, of one module or all."""
    interfaces = x.files.filter("is_index and not is_test").groupBy("module").agg(F.min("path").alias("file"))
    d = graph.deep_imports(x.module_imports, interfaces).select(F.lit("deep-import").alias("kind"), "src", "dst", "target")
    past = graph.bypasses(x.file_imports.filter("to_module is not null")).select(F.lit("internal-import").alias("kind"), F.col("from_module").alias("src"), F.col("to_module").alias("dst"), F.col("to_file").alias("target")).distinct()
    c = graph.mutual_cycles(x.module_imports.filter("not is_type_only")).select(F.lit("cycle").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("string").alias("target"))
    out = d.unionByName(past).unionByName(c)
    return out.filter((F.col("src") == module) | (F.col("dst") == module)) if module else out


def _changes(head: Index, base: Index) -> DataFrame:
    side = lambda x: governance.signatures(x.functions.withColumn("d", F.col("def_hash").cast("string")), ["id"], "d")
    return governance.changed(side(head), side(base), "id", "signature")


def diff_context(head: Index, base: Index) -> DataFrame:
    """Changed functions with how many functions call them."""
    callers = head.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return _changes(head, base).join(callers, "id", "left").fillna(0, ["callers"]).orderBy("id")


def change_impact(head: Index, base: Index) -> DataFrame:
    """Callers that changed functions reach, each once; a changed function that calls another is one of them."""
    starts = _changes(head, base).filter("status != 'removed'").select(F.col("id").alias("node"))
    return graph.affected(head.edges, starts)


def check_my_changes(head: Index, base: Index) -> DataFrame:
    """What a change brings: new copies, new deep imports, new cycles, changed functions."""
    key = F.concat_ws("->", "src", "dst", "target").alias("item")
    b = boundary_check(head).select("kind", key).join(boundary_check(base).select("kind", key), ["kind", "item"], "left_anti")
    new = duplicates.new_pairs(findings(head), findings(base)).select(F.lit("new-duplicate").alias("kind"), F.col("pair_key").alias("item"))
    c = _changes(head, base).select(F.concat(F.lit("function-"), "status").alias("kind"), F.col("id").alias("item"))
    return b.unionByName(new).unionByName(c)


def tests_for(x: Index, path: str) -> DataFrame:
    """Test files by three routes: they import the file, call its functions, or are named after it."""
    t = x.files.filter("is_test").select(F.col("path").alias("test"), F.col("module").alias("tm"))
    target = x.files.filter(F.col("path") == path).select(F.col("path").alias("target"), "module")
    i = x.tables["imports"].filter("from_is_test")
    by_import = resolution.relative_targets(i, x.files.select("path")).filter(F.col("to_file") == path).select(F.col("to_file").alias("target"), F.col("from_file").alias("test"))
    names = x.functions.filter((F.col("path") == path) & F.col("exported")).select("name")
    by_call = x.tables["call_sites"].filter("not is_field").join(t, F.col("path") == F.col("test")).join(names, "name", "left_semi").select(F.lit(path).alias("target"), "test")
    by_name = t.join(target, (test_stem(F.col("test")) == test_stem(F.col("target")))).select("target", "test")
    return resolution.tests_for([by_import, by_call, by_name]).orderBy(F.desc("routes"), "test")


def compare_implementations(x: Index, a: str, b: str) -> DataFrame:
    """Two functions side by side: likeness of shape, callees and parameters."""
    one = lambda n, p: x.find(n).orderBy("node").limit(1).join(x.functions, F.col("node") == F.col("id")).select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "body_hash", "literal_hash", "body_tokens", "ngram_sketch", "calls", "param_names")])
    j = one(a, "a").join(one(b, "b"), F.lit(True))
    from codelode.functions.text import jaccard

    same = F.col("a_body_hash") == F.col("b_body_hash")
    near = F.least(F.lit(0.99), jaccard(F.col("a_ngram_sketch"), F.col("b_ngram_sketch")))
    return j.select("a_id", "b_id", same.alias("same_shape"), (same & (F.col("a_literal_hash") == F.col("b_literal_hash"))).alias("same_literals"), F.when(same, 1.0).otherwise(near).alias("similarity"), jaccard(F.col("a_calls"), F.col("b_calls")).alias("callees"), jaccard(F.col("a_param_names"), F.col("b_param_names")).alias("parameters"))


#: Which sections a bundle has, in order, by purpose.
PROFILES = {
    "understand": ["source", "callees", "types", "architecture", "callers", "tests"],
    "change": ["source", "callers", "blast-radius", "tests", "types", "recent-changes"],
    "debug": ["source", "callers", "recent-changes", "callees", "types"],
    "review": ["source", "blast-radius", "tests", "architecture", "recent-changes", "callers"],
}


def context_bundle(x: Index, name: str, purpose: str = "understand", budget: int = 900) -> list[tuple[str, list[str], int]]:
    """Sections about one function within a token budget, with the number of lines each had to leave out."""
    f = x.find(name).orderBy("node").first()
    if f is None:
        return []
    node = f["node"]

    def lines(section: str) -> list[str]:
        if section == "source":
            text = read_function(x, node).first()
            return (text["text"] or "").split("\n")[:48] if text else []
        if section in ("callers", "callees"):
            rows = (callers_of if section == "callers" else callees_of)(x, node, 1, 6).collect()
            return [f"{r.node} ({r.confidence})" for r in rows]
        if section == "blast-radius":
            return [f"{r.callers} callers in {r.modules} modules: {r.bucket}" for r in impact_of(x, node).collect()]
        if section == "tests":
            return [r.test for r in tests_for(x, f["path"]).limit(4).collect()]
        if section == "types":
            return [f"{r.kind} {r.name}" for r in x.tables["symbols"].filter((F.col("path") == f["path"]) & F.col("kind").isin("class", "interface", "type", "enum")).orderBy("start_line").collect()]
        if section == "architecture":
            return [f"{r.module}: depth {r.depth}, seams {r.seams}, leverage {r.leverage}" for r in module_metrics(x).join(x.files.filter(F.col("path") == f["path"]).select("module"), "module").collect()]
        if x.commits is None:
            return []
        return [f"{r.author} {r.ts}" for r in x.commits.filter(F.array_contains("files", f["path"])).orderBy(F.desc("commit_id")).limit(3).collect()]

    return windows.render_budgeted([(s, lines(s)) for s in PROFILES[purpose]], budget)


def _asked(x: Index, question: str) -> tuple[list[str], list[str]]:
    """(names the question spells out, its other words)."""
    q = F.lit(question)
    row = x.spark.range(1).select(F.concat(intent.quoted(q), intent.code_shaped(q)).alias("n"), query_tokens(q).alias("t")).first()
    spelled = [n for n in dict.fromkeys(row["n"]) if n.lower() not in ("what", "who", "which", "where", "how", "why", "does")]
    return spelled, [t for t in dict.fromkeys(row["t"])]


def find_target(x: Index, question: str, limit: int = search.MAX_CANDIDATES) -> DataFrame:
    """Symbols a question may be about: id, name, path, start_line and confidence, best first (Q-2 to Q-4).

    Names that the question spells out count first, else its words, with what this tree's vocabulary says they stand for. A
    question that spells out a name of several words is about no symbol that lacks one of them.
    """
    spelled, said = _asked(x, question)
    probes = spelled or said
    split = {p: x.spark.range(1).select(camel_tokens(F.lit(p)).alias("t")).first()["t"] for p in probes}
    terms = list(dict.fromkeys(t for p in probes for t in split[p]))
    files = x.files.select("path", "module", "is_test", F.coalesce("comment_tokens", F.array().cast("array<string>")).alias("said"))
    d = x.tables["symbols"].drop("module").join(files, "path").withColumn("tokens", camel_tokens(F.col("name"))).withColumn("id", F.concat_ws("#", "path", "name"))
    first = Window.partitionBy("id").orderBy("start_line")
    d = d.withColumn("_r", F.row_number().over(first)).filter("_r = 1").withColumn("terms", F.concat("tokens", "said")).persist()
    vocab = search.vocabulary(d)
    known = search.prefix_aliases(vocab).filter(F.col("rank") <= 8).select("alias", "target").union(search.acronym_aliases(d, vocab)).filter(F.col("alias").isin(*terms) if terms else F.lit(False))
    stands: dict[str, list[str]] = {t: [] for t in terms}
    for r in known.orderBy("alias", "target").limit(16 * max(1, len(terms))).collect():
        stands[r["alias"]].append(r["target"])
    words = lambda ts: F.array(*[F.lit(t) for t in ts]).cast("array<string>")
    covers = lambda t: F.arrays_overlap("tokens", words([t, *stands[t]])).cast("int")
    coverage = sum((covers(t) for t in terms), F.lit(0)) / F.lit(max(1, len(terms)))
    used = F.size(F.array_except("tokens", words(terms))) == 0
    exact = F.lower("name").isin(*[p.lower() for p in probes]) if probes else F.lit(False)
    named = [split[p] for p in spelled if len(split[p]) > 1]
    fits = exact
    for ts in named:
        fits = fits | (sum((covers(t) for t in ts), F.lit(0)) == len(ts))
    lexical = search.bm25(d, list(dict.fromkeys([*terms, *(t for v in stands.values() for t in v)])))
    best = lexical.agg(F.max("score").alias("best"))
    place = F.concat(camel_tokens(F.col("path")), camel_tokens(F.col("module")))
    rows = d.join(lexical, "id", "left").join(F.broadcast(best), F.lit(True)).filter(fits if named else F.lit(True))
    rows = rows.select("id", "name", "path", "start_line", "kind", exact.alias("exact"), ((coverage == 1) & used).alias("all_tokens"), (used & (coverage > 0)).alias("subset"), coverage.alias("coverage"), F.coalesce(F.col("score") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(0.0)).alias("lexical"), F.arrays_overlap(place, words(terms)).alias("path_hit"), "exported", "is_test")
    scored = search.target_score(rows).filter("confidence > 0").select("id", "name", "path", "start_line", "kind", "confidence")
    return scored.orderBy(F.desc("confidence"), "id").limit(limit)


def query_repository(x: Index, question: str) -> tuple[str | None, str | None, DataFrame | None]:
    """(intent, tool, answer) of a question in words; an unknown question says so instead of guessing.

    Where what it is about is not clear, the answer is the symbols it may be about.
    """
    kind, tool = intent.route(question)
    if tool is None:
        return None, None, None
    if tool in ("repo_map", "architecture_health", "similar_logic_exists"):
        return kind, tool, TOOLS[tool](x)
    spelled, _ = _asked(x, question)
    there = [n for n in spelled if x.find(n).limit(1).count()]
    if tool == "path_between":
        return kind, tool, path_between(x, there[0], there[1]) if len(there) > 1 else None
    if tool in ("dependencies_of", "dependents_of", "boundary_check", "module_metrics"):
        last = spelled[0] if spelled else question.rstrip("?").split()[-1]
        return kind, tool, TOOLS[tool](x, last)
    if not there:
        candidates = find_target(x, question).persist()
        said = search.resolve(candidates.select(F.lit(question).alias("question"), "id", "confidence"), ["question"]).first()
        if said is None or said["status"] == "unresolved":
            return kind, tool, None
        if said["status"] == "ambiguous":
            return kind, "find_target", candidates
        there = [said["target"]]
    name = there[0]
    if tool == "find_symbol":
        return kind, tool, find_symbol(x, name.rsplit("#", 1)[-1])
    if tool == "find_references":
        return kind, tool, find_references(x, name.rsplit("#", 1)[-1])
    if tool == "context_bundle":
        rows = [(k, title, line, left) for k, (title, lines, left) in enumerate(context_bundle(x, name)) for line in lines or [""]]
        return kind, tool, x.spark.createDataFrame(rows, "section int, title string, line string, left_out int") if rows else None
    hit = x.find(name).orderBy("node").first()
    if tool == "tests_for":
        return kind, tool, tests_for(x, hit["path"]) if hit else None
    if tool == "change_impact":
        if x.commits is None or hit is None:
            return kind, tool, None
        return kind, tool, x.commits.filter(F.array_contains("files", hit["path"])).select("commit_id", "author", "ts", F.size("files").alias("files")).orderBy("commit_id")
    return kind, tool, TOOLS[tool](x, name)


TOOLS = {f.__name__: f for f in (repo_map, file_outline, read_function, read_span, find_symbol, find_references, architecture_health, module_metrics, similar_logic_exists, impact_of, callers_of, callees_of, check_my_changes, boundary_check, diff_context, change_impact, tests_for, dependencies_of, dependents_of, path_between, query_repository, compare_implementations, context_bundle)}


def receipt(text: str, spark: SparkSession) -> str:
    """The short digest by which a repeated answer is recognised."""
    return spark.range(1).select(content_hash(F.lit(text), 12)).first()[0]
