"""Policy, differences and alerts between two snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codelode.functions.text import module_matches

#: Rule types, the default policy and thresholds of alerts.
RULE_TYPES = ("health-delta", "contamination-delta", "no-new-duplication", "metric-floor", "min-owners", "forbidden-dependency")
NEEDS_BASE = ("health-delta", "contamination-delta", "no-new-duplication")
RATCHET = [{"id": "health", "type": "health-delta", "maxDrop": 3}, {"id": "contamination", "type": "contamination-delta", "maxRise": 0}, {"id": "duplication", "type": "no-new-duplication"}]
HEALTH_DROP, METRIC_DROP, CONTAMINATION_RISE = 3, 10, 5
CAP_WITHOUT_KEYS = 20


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules that can't be evaluated (D7): unknown type, no ``to`` on a dependency rule, or ``module`` on one."""
    dep = F.col("type") == "forbidden-dependency"
    why = F.when(~F.col("type").isin(*RULE_TYPES), "unknown type").when(dep & F.col("to").isNull(), "missing to").when(dep & F.col("module").isNotNull(), "module is not used here")
    return rules.withColumn("problem", why).filter("problem is not null")


def forbidden_edges(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a rule forbids (J14): from and to globs match, neither type-only nor of a test unless included, not by the allowed way.

    The rules are the small side by contract (a policy file); each edge meets each rule once.
    """
    r = F.broadcast(rules.filter("type = 'forbidden-dependency' and to is not null").select("rule", F.coalesce("from", F.lit("*")).alias("f"), F.col("to").alias("t"), "allowed_via", "include_type_only", "include_tests"))
    hit = module_matches(F.col("f"), F.col("from_module")) & module_matches(F.col("t"), F.col("to_module"))
    skip = (F.col("is_type_only") & ~F.coalesce("include_type_only", F.lit(False))) | (F.col("from_is_test") & ~F.coalesce("include_tests", F.lit(False)))
    way = F.coalesce(module_matches(F.col("allowed_via"), F.col("from_module")), F.lit(False))
    return edges.join(r, hit & ~skip & ~way)


def metric_floor(modules: DataFrame, metric: str, least: float, glob: str = "*") -> DataFrame:
    """Modules under a floor; one that was not measured doesn't violate it."""
    return modules.filter(module_matches(F.lit(glob), F.col("module"))).filter(F.col(metric).isNotNull() & (F.col(metric) < least)).select("module", F.col(metric).alias("value"))


def min_owners(modules: DataFrame, least: int = 2, glob: str = "*") -> DataFrame:
    return metric_floor(modules, "bus_factor", least, glob)


def skipped(rules: DataFrame, has_base: bool, has_edges: bool, base_complete: bool = True) -> DataFrame:
    """How many rules were not evaluated and why: a rule that was not checked is counted, never passed."""
    t = F.col("type")
    why = (
        F.when(~t.isin(*RULE_TYPES), "invalid")
        .when(t.isin(*NEEDS_BASE) & ~F.lit(has_base), "no_base")
        .when((t == "no-new-duplication") & ~F.lit(base_complete), "incomplete_base")
        .when((t == "forbidden-dependency") & F.col("to").isNull(), "invalid")
        .when((t == "forbidden-dependency") & ~F.lit(has_edges), "no_edges")
        .otherwise("evaluated")
    )
    return rules.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("rules"))


def complete_pairs(keys: int | None, shown: int, total: int | None) -> bool:
    """Whether a report's pairs are all there are."""
    return keys is not None or (shown == total if total is not None else shown < CAP_WITHOUT_KEYS)


def new_side(pairs: DataFrame, base_files: DataFrame, base_clones: DataFrame) -> DataFrame:
    """Which of a pair (a, b, a_file, b_file) is the new copy (D6): by clone membership in the base, else by file, else unknown."""
    for side in ("a", "b"):
        pairs = pairs.join(base_clones.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_was_clone")), side, "left").join(base_files.select(F.col("file").alias(f"{side}_file"), F.lit(True).alias(f"{side}_was_there")), f"{side}_file", "left")
    had = lambda c: F.coalesce(F.col(c), F.lit(False))
    side = F.when(had("a_was_clone") & ~had("b_was_clone"), "b").when(had("b_was_clone") & ~had("a_was_clone"), "a").when(had("a_was_there") & ~had("b_was_there"), "b").when(had("b_was_there") & ~had("a_was_there"), "a").otherwise("unknown")
    return pairs.withColumn("new_side", side)


def diff_scope(head: DataFrame, base: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Each fingerprint as introduced, pre_existing or resolved."""
    h, b = head.select(key).distinct().withColumn("in_head", F.lit(True)), base.select(key).distinct().withColumn("in_base", F.lit(True))
    scope = F.when(F.col("in_base").isNull(), "introduced").when(F.col("in_head").isNull(), "resolved").otherwise("pre_existing")
    return h.join(b, key, "full_outer").select(key, scope.alias("scope"))


def fingerprint(rule_type: Column, rule: Column, module: Column, a: Column, b: Column) -> Column:
    """Coarse identity of a violation: stable when lines move."""
    pair = F.array_join(F.array_sort(F.array(a, b)), "|")
    return F.when(rule_type == "no-new-duplication", F.concat_ws("::", rule, pair)).when(rule_type.isin("metric-floor", "min-owners"), F.concat_ws("::", rule, module)).when(rule_type == "forbidden-dependency", F.concat_ws("::", rule, a, b)).otherwise(rule)


def alerts(head: DataFrame, base: DataFrame, metrics: tuple[str, ...] = ("depth", "seams", "leverage", "locality")) -> DataFrame:
    """Per-module alerts (D10): (module, kind, severity, metric, before, after). NULL is never a drop; a lost measurement is said.

    Both sides: module, the metrics and bus_factor.
    """
    h = head.select("module", F.lit(True).alias("h"), F.col("bus_factor").alias("bf1"), *[F.col(m).alias(f"{m}1") for m in metrics])
    b = base.select("module", F.lit(True).alias("b"), F.col("bus_factor").alias("bf0"), *[F.col(m).alias(f"{m}0") for m in metrics])
    j = h.join(b, "module", "full_outer")
    none = F.lit(None).cast("double")

    def event(when: Column, kind: str, severity: str, metric: str, before: Column, after: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(metric).alias("metric"), before.cast("double").alias("before"), after.cast("double").alias("after")))

    both = F.col("h") & F.col("b")
    found = [
        event(F.col("b").isNull(), "module-added", "info", "", none, none),
        event(F.col("h").isNull(), "module-removed", "info", "", none, none),
        event(both & (F.col("bf0") >= 2) & (F.col("bf1") == 1), "bus-factor-one", "critical", "bus_factor", F.col("bf0"), F.col("bf1")),
    ]
    for m in metrics:
        before, after = F.col(f"{m}0"), F.col(f"{m}1")
        found.append(event(both & (before - after >= METRIC_DROP), "metric-drop", "warn", m, before, after))
        found.append(event(both & before.isNotNull() & after.isNull(), "metric-unavailable", "info", m, before, after))
    return j.select("module", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


#: Alerts by how much they matter.
RANKS = ("critical", "warn", "info")


def module_alerts(head: list[dict], base: list[dict], metrics: tuple[str, ...] = ("depth", "seams", "leverage", "locality")) -> list[dict]:
    """``alerts`` over two reports' module rows, with the modules that entered a cycle, whom each goes to and what it says; worst first."""
    was, now, out = {m["module"]: m for m in base}, {m["module"]: m for m in head}, []

    def add(kind: str, severity: str, module: str, text: str, **more: object) -> None:
        out.append({"kind": kind, "severity": severity, "module": module, "message": f"{module}: {text}", "route": now.get(module, {}).get("top_author"), **more})

    for name, h in now.items():
        b = was.get(name)
        if b is None:
            add("module-added", "info", name, f"new, {h.get('files')} files")
            continue
        if (b.get("bus_factor") or 0) >= 2 and h.get("bus_factor") == 1:
            add("bus-factor-one", "critical", name, f"one author left who holds most of it (there were {b['bus_factor']})")
        if h.get("in_cycle") and not b.get("in_cycle"):
            add("new-cycle", "critical", name, "entered an import cycle")
        for k in metrics:
            x, y = b.get(k), h.get(k)
            if x is not None and y is None:
                add("metric-unavailable", "info", name, f"{k} is no longer measured (was {x})", metric=k)
            elif x is not None and x - y >= METRIC_DROP:
                add("metric-drop", "warn", name, f"{k} fell from {x} to {y}", metric=k)
    for name in was.keys() - now.keys():
        add("module-removed", "info", name, "gone")
    return sorted(out, key=lambda e: (RANKS.index(e["severity"]), e["kind"], e["module"]))


def disclosures(report: dict, rules: list[dict], matches) -> list[str]:
    """What a policy's result can't tell (D5): globs that name no module, one module for all files, files left out, a cut list of copies."""
    names = {m["module"] for m in report["modules"]} | {e[k] for e in report.get("importEdges") or [] for k in ("from_module", "to_module")}
    out = []
    for k, r in enumerate(rules):
        for side in ("from", "to"):
            glob = r.get(side)
            if r.get("type") == "forbidden-dependency" and glob and glob != "*" and not any(matches(glob, n) for n in names):
                out.append(f"{r.get('id', f'rule-{k}')}: no module is named by {side} {glob}")
    if len(names) == 1 and (report.get("filesScanned") or 0) > 1:
        out.append(f"all files are in one module, {min(names)}: nothing between modules could be checked")
    if report.get("skippedFiles"):
        out.append(f"{report['skippedFiles']} files were left out of the scan")
    c = report["contamination"]
    if not complete_pairs(len(c["pairKeys"]) if c.get("pairKeys") is not None else None, len(c["findings"]), c.get("total")):
        out.append("the report's list of copies is cut: new ones may be missing")
    elif any(r.get("type") == "no-new-duplication" for r in rules) and (c.get("total") or 0) > len(c["findings"]):
        out.append(f"{c['total'] - len(c['findings'])} copies are known by their keys only and are not shown one by one")
    return out


def report_alerts(head: Row, base: Row, new_clones: int) -> list[tuple[str, str]]:
    """Alerts of whole reports: a drop of the band outranks a drop within it."""
    out = []
    if head.health is not None and base.health is not None and head.health < base.health:
        if head.band != base.band:
            out.append(("health-band-drop", "critical"))
        elif base.health - head.health >= HEALTH_DROP:
            out.append(("health-drop", "warn"))
    if head.contamination - base.contamination >= CONTAMINATION_RISE:
        out.append(("contamination-spike", "warn"))
    if new_clones:
        out.append(("new-clones", "warn"))
    return out


def exit_code(violations: int, blocking: int, invalid: int, strict: bool) -> int:
    """2 for an invalid policy, 1 where a strict run blocks, else 0."""
    return 2 if invalid else 1 if strict and blocking else 0


def conclusion(violations: int, blocking: int, invalid: int, strict: bool) -> str:
    """The check run's conclusion (K7)."""
    return "failure" if invalid or (blocking and strict) else "neutral" if violations else "success"


def changed(head: DataFrame, base: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that were added, removed or modified, by content digest (D4); unchanged ones are left out."""
    h, b = head.select(key, F.col(digest).alias("d1")), base.select(key, F.col(digest).alias("d0"))
    status = F.when(F.col("d0").isNull(), "added").when(F.col("d1").isNull(), "removed").when(F.col("d0") != F.col("d1"), "modified")
    return h.join(b, key, "full_outer").withColumn("status", status).filter("status is not null").select(key, "status")


def signatures(df: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """One signature per name: its digests sorted and joined, safe for overloads."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(digest)), ",").alias("signature"))


def sarif(violations: list[dict], skipped_rules: list[dict], version: str = "2.1.0") -> str:
    """Violations as SARIF (K6): blocking ones are errors, places only where known, unchecked rules are notifications."""
    results = []
    for v in violations:
        r = {"ruleId": v["rule"], "level": "error" if v.get("block") else "warning", "message": {"text": v["message"]}, "partialFingerprints": {"codelode/v1": v["fingerprint"]}}
        if v.get("file"):
            place = {"artifactLocation": {"uri": v["file"]}}
            if v.get("line"):
                place["region"] = {"startLine": v["line"]}
            r["locations"] = [{"physicalLocation": place}]
        results.append(r)
    notes = [{"level": "note", "message": {"text": f"{s['rule']}: {s['reason']}"}} for s in skipped_rules]
    run = {"tool": {"driver": {"name": "codelode", "rules": [{"id": x} for x in sorted({v["rule"] for v in violations})]}}, "results": results, "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": notes}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": version, "runs": [run]}, sort_keys=True)


def check_run(violations: list[dict], invalid: int, strict: bool, most: int = 50) -> dict:
    """A check-run payload (K7): at most 50 annotations, the rest stated."""
    blocking = sum(bool(v.get("block")) for v in violations)
    known = [v for v in violations if v.get("file")]
    notes = [{"path": v["file"], "start_line": v.get("line") or 1, "annotation_level": "failure" if v.get("block") else "warning", "message": v["message"]} for v in known[:most]]
    more = f" {len(known) - most} more are not annotated." if len(known) > most else ""
    return {"conclusion": conclusion(len(violations), blocking, invalid, strict), "output": {"title": f"{len(violations)} violations", "summary": f"{len(violations)} violations, {blocking} blocking.{more}", "annotations": notes}}
