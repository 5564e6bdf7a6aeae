"""Resolution of imports and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import fold_path
from codelode.operators.iterate import settle

#: Endings tried in turn for a relative import.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".py", ".go", ".java", ".rb", ".rs", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".dart", ".kt", ".swift", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs"]
TAIL = 6
#: Confidences of the ladder of call resolution.
LADDER = {"receiver-type": 0.85, "same-file": 1.0, "import-binding": 0.9, "unique-name": 0.9, "import-scoped": 0.7, "module-scoped": 0.5, "module-local": 0.6}
RUNGS = list(LADDER)


def relative_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each relative import: the joined path, then without .js, with each ending in turn; the first that exists."""
    i = imports.filter(F.col("specifier").startswith("."))
    joined = fold_path(F.concat(F.regexp_replace("from_file", "[^/]*$", ""), "specifier"))
    bases = F.array(joined, F.regexp_replace(joined, r"\.jsx?$", ""))
    i = i.select("*", F.posexplode(bases).alias("bi", "base"))
    i = i.select("*", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("si", "ending")).withColumn("path", F.concat("base", "ending"))
    hits = i.join(files.select("path"), "path")
    return hits.groupBy("from_file", "seq").agg(F.min_by("path", F.struct("bi", "si")).alias("to_file"))


def unique_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Module-path imports (id, path) by the longest trailing part, of six segments at most, whose files are all in one module.

    files: path (without ending), module. A tail that several modules share declines; the file itself is not its own target.
    """
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.size(c), F.lit(TAIL))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(c, F.size(c) - k + 1, k), "/").alias("tail")))
    i = imports.select("id", F.inline(tails(F.split("path", "/"))))
    f = files.select(F.col("path").alias("file"), "module", F.inline(tails(F.split("path", "/"))))
    per = f.groupBy("k", "tail").agg(F.count_distinct("module").alias("modules"), F.min("module").alias("module"), F.min("file").alias("file")).filter("modules = 1")
    hits = i.join(per, ["k", "tail"])
    return hits.groupBy("id").agg(F.max(F.struct("k", "module", "file")).alias("m")).select("id", F.col("m.k").alias("segments"), F.col("m.module").alias("module"), F.col("m.file").alias("file"))


def classify_import(imports: DataFrame) -> DataFrame:
    """stdlib, external or unresolved, for imports without a target (P10)."""
    s = F.col("specifier")
    first = F.get(F.split(s, "/"), F.lit(0))
    kind = F.when(s.startswith("."), "unresolved").when((F.col("lang") == "go") & ~first.contains("."), "stdlib").when((F.col("lang") == "go") & first.contains("."), "external").when(s.startswith("/") | s.startswith("@/") | s.startswith("~/"), "unresolved").otherwise("external")
    return imports.withColumn("kind", kind)


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, bindings: DataFrame, types: DataFrame) -> DataFrame:
    """Each (caller, name)'s targets with reason and confidence; none of them: an unresolved row.

    calls: caller, file, module, name, member, receiver (NULL where unknown). functions: id, file, module, name, type, exported.
    imports: module, target_module. bindings: file, name, target (function id). types: type, is_interface, declared.

    The first rung with an answer gives the edges, and a rung that is not unique declines instead of guessing. A caller lies in one
    file. Candidates are counted once for each place (name, file, module) that calls; only the edges themselves are spelled out, since
    a name's calls times its functions would be their square. A call without a caller or with an unknown ``member`` stays unresolved.
    """
    f = functions.select(F.col("id").alias("target"), "file", "module", "name", "type")
    key = ["caller", "name", "member"]
    sole = types.filter("declared = 1 and not is_interface").select("type")

    typed = f.join(sole, "type", "left_semi").groupBy("type", "name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("t")).filter("n = 1").select(F.col("type").alias("receiver"), "name", "t")
    typed = _small(calls.filter("receiver is not null").join(typed, ["receiver", "name"]).groupBy(*key).agg(F.collect_set("t").alias("typed")))
    places = _small(_places(calls, f, imports, bindings))
    own = f.groupBy(F.col("target").alias("caller"), "name").agg(F.collect_list(F.struct("file", "module")).alias("own"))

    c = calls.select(*key, "file", "module").distinct().join(own, ["caller", "name"], "left").alias("c")
    c = c.join(places.alias("p"), F.expr("c.name <=> p.name and c.file <=> p.file and c.module <=> p.module"), "left").select("c.*", *[f"p.{x}" for x in places.columns if x not in ("name", "file", "module")])
    c = c.join(typed, key, "left")
    mine = lambda rule: F.coalesce(F.size(F.filter("own", rule)), F.lit(0))
    others = F.coalesce("in_all", F.lit(0)) - F.when(F.col("own").isNull(), 0).otherwise(F.size("own"))
    c = c.withColumn("others", others).withColumn("beside", F.col("in_file") - mine(lambda x: x.file == F.col("file"))).withColumn("near", F.col("in_module") - mine(lambda x: x.module == F.col("module")))
    c = c.withColumn("scoped", F.filter("few", lambda x: x.target != F.col("caller")))
    c = c.withColumn("reach", F.aggregate("scoped", F.lit(0).cast("long"), lambda n, x: n + x.m)).withColumn("spans", F.size(F.array_distinct(F.transform("scoped", lambda x: x.tm))))
    free = ~F.col("member")
    answers = [F.col("typed").isNotNull(), (F.col("beside") > 0) | ((F.col("others") == 0) & (F.col("in_file") > 0)), free & F.col("bound"), free & (F.col("others") == 1), F.col("reach") == 1, F.col("reach").between(2, 4) & (F.col("spans") == 1), free & (F.col("near") == 1)]
    rung = F.coalesce(*[F.when(rule, k) for k, rule in enumerate(answers)])
    c = c.withColumn("rung", F.when(F.col("caller").isNotNull() & F.col("member").isNotNull(), rung))
    other = lambda lo, hi: F.array(F.when(F.col(lo) != F.col("caller"), F.col(lo)).otherwise(F.col(hi)))
    said = F.when(F.col("rung") == 0, F.col("typed")).when(F.col("rung") == 3, other("all_lo", "all_hi")).when(F.col("rung").isin(4, 5), F.array_distinct(F.transform("scoped", lambda x: x.target))).when(F.col("rung") == 6, other("module_lo", "module_hi"))
    c = c.select(*key, "file", "rung", F.explode_outer(said).alias("said"))
    # the two rungs whose edges may be any number
    many = f.select("name", "file", F.lit(1).alias("rung"), "target").unionByName(bindings.select("name", "file", F.lit(2).alias("rung"), "target")).distinct()
    out = c.join(many, ["name", "file", "rung"], "left").withColumn("target", F.coalesce("said", "target")).filter("rung is null or target != caller")
    reason = F.when(F.col("rung").isNull(), "unresolved").otherwise(F.get(F.array(*[F.lit(k) for k in RUNGS]), F.col("rung")))
    conf = F.get(F.array(*[F.lit(LADDER[k]) for k in RUNGS]), F.col("rung"))
    return out.select(*key, F.col("target").cast(functions.schema["id"].dataType).alias("target"), reason.alias("reason"), conf.alias("confidence"))


def _small(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A written table, marked for broadcast where it has few rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= most else df


def _places(calls: DataFrame, f: DataFrame, imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """What the rungs ask of each place (name, file, module) that calls: functions of the name in all, in the file, in the module.

    few: (tm, target, m) of its functions in the modules that the place's module imports, where they are five ids at most: the
    caller and as many as a rung accepts.
    """
    ids = f.groupBy("name", F.col("module").alias("tm"), "target").agg(F.count(F.lit(1)).alias("m"))
    per = ids.groupBy("name", "tm").agg(F.sum("m").alias("in_module"), F.min("target").alias("module_lo"), F.max("target").alias("module_hi"), F.count(F.lit(1)).alias("ids"))
    reach = imports.select("module", F.col("target_module").alias("tm")).distinct()
    some = reach.join(per, "tm").groupBy("module", "name").agg(F.sum("ids").alias("ids")).filter("ids <= 5")
    few = reach.join(ids.join(per.filter("ids <= 5").select("name", "tm"), ["name", "tm"], "left_semi"), "tm").join(some, ["module", "name"], "left_semi")
    few = few.groupBy("module", "name").agg(F.collect_list(F.struct("tm", "target", "m")).alias("few"))
    every = f.groupBy("name").agg(F.count(F.lit(1)).alias("in_all"), F.min("target").alias("all_lo"), F.max("target").alias("all_hi"))
    at = calls.select("name", "file", "module").distinct().join(every, "name", "left")
    at = at.join(f.groupBy("name", "file").agg(F.count(F.lit(1)).alias("in_file")), ["name", "file"], "left").join(per.drop("ids").withColumnRenamed("tm", "module"), ["name", "module"], "left")
    return at.join(few, ["name", "module"], "left").join(bindings.select("name", "file", F.lit(True).alias("bound")).distinct(), ["name", "file"], "left")


def unresolved_calls(resolved: DataFrame) -> DataFrame:
    """Distinct (caller, name) without a target, per caller."""
    return resolved.filter("reason = 'unresolved'").groupBy("caller").agg(F.count_distinct("name").alias("unresolved"))


def resolve_type(refs: DataFrame, types: DataFrame) -> DataFrame:
    """A type name's file: the same file, then the same module, then the only one; else ambiguous with its count, or none."""
    t = types.select(F.col("name"), F.col("file").alias("tf"), F.col("module").alias("tm"))
    j = refs.join(t, "name", "left").groupBy("id").agg(
        F.min(F.when(F.col("tf") == F.col("file"), F.col("tf"))).alias("same_file"),
        F.min(F.when(F.col("tm") == F.col("module"), F.col("tf"))).alias("same_module"),
        F.count("tf").alias("n"),
        F.min("tf").alias("any"),
    )
    status = F.when(F.col("same_file").isNotNull(), "same-file").when(F.col("same_module").isNotNull(), "same-module").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return j.select("id", status.alias("status"), F.when(status.isin("same-file", "same-module", "unique"), F.coalesce("same_file", "same_module", "any")).alias("file"), F.col("n").alias("candidates"))


def legal_routes(violations: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Files that already reach the target the allowed way: the same file first, else the same module; five in edge order."""
    e = edges.select(F.col("ord"), F.col("from_file").alias("via"), F.col("from_module").alias("vm"), F.col("to_file").alias("tf"), F.col("to_module").alias("tm"))
    j = violations.join(e, (F.col("to_module") == F.col("tm")) & (F.col("allowed_via") == F.col("vm")))
    j = j.withColumn("exact", (F.col("tf") == F.col("to_file")).cast("int"))
    w = Window.partitionBy("violation")
    j = j.withColumn("best", F.max("exact").over(w)).filter("exact = best").groupBy("violation", "via", "exact").agg(F.min("ord").alias("ord"))
    return j.withColumn("rank", F.row_number().over(w.orderBy("ord", "via"))).filter(F.col("rank") <= most).select("violation", "via", "rank", (F.col("exact") == 1).alias("same_file"))


def tests_for(routes: list[DataFrame]) -> DataFrame:
    """Test files by how many of the routes (target, test) lead to them."""
    all_routes = None
    for k, r in enumerate(routes):
        r = r.select("target", "test", F.lit(k).alias("route")).distinct()
        all_routes = r if all_routes is None else all_routes.unionByName(r)
    return all_routes.groupBy("target", "test").agg(F.count_distinct("route").alias("routes"))


def lookup(modules: DataFrame, query: str) -> DataFrame:
    """A module by name: exact, then ignoring case, then as a part; all of the first tier that has any."""
    n, q = F.col("name"), query.lower()
    tier = F.when(n == query, 0).when(F.lower(n) == q, 1).when(F.lower(n).contains(q), 2)
    hit = modules.withColumn("tier", tier).filter("tier is not null")
    best = hit.agg(F.min("tier").alias("tier"))
    out = hit.join(F.broadcast(best), "tier")
    total = out.agg(F.count(F.lit(1)).alias("matches"))
    return out.join(F.broadcast(total), F.lit(True)).withColumn("status", F.when(F.col("matches") == 1, "resolved").otherwise("ambiguous"))
