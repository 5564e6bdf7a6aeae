"""Report rows and their renderings (K2-K5, K8): JSON, markdown, terminal text, one self-contained page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import governance, graph, metrics
from codelode.plans import tools


def report(x: tools.Index) -> dict:
    """One scan's report, JSON-stable: health, modules, findings, pair keys, edges and opportunities. Frames here are per module."""
    m = tools.module_metrics(x).filter("all_lines >= 10 or files > 1").persist()  # a small single file is no module of a report
    health = tools.architecture_health(x).first()
    f = tools.findings(x)
    top = graph.ranked(f, [F.desc("confidence"), F.col("a_id"), F.col("b_id")], 20).collect()
    edges = x.file_imports.filter("to_module is not null and from_module != to_module").select("from_file", "line", "from_module", "to_file", "to_module", "is_type_only", "from_is_test")
    chances = metrics.opportunities(m.withColumnRenamed("exported", "exports")).orderBy("pass", "score", "module")
    return {
        "version": 1,
        "filesScanned": x.files.count(),
        "skippedFiles": x.tables["skipped"].count() if "skipped" in x.tables else 0,
        "health": {"score": health["health"], "label": health["band"]},
        "modules": [r.asDict() for r in m.orderBy(F.col("depth").asc_nulls_last(), "module").collect()],
        "contamination": {"score": health["contamination"], "total": f.count(), "findings": [r.asDict() for r in top], "pairKeys": sorted(r[0] for r in f.select("pair_key").collect())},
        "importEdges": [r.asDict() for r in edges.orderBy("from_file", "line").collect()],
        "opportunities": [r.asDict() for r in chances.limit(8).collect()],
    }


def to_json(r: dict) -> str:
    return json.dumps(r, sort_keys=True, default=str)


def graph_json(x: tools.Index) -> DataFrame:
    """Nodes and edges of the knowledge graph, one JSON object a row (K2): containment, imports and calls with their grounds."""
    f, fn = x.files.filter("not is_test"), x.functions
    node = lambda kind, c: F.to_json(F.struct(F.lit("node").alias("type"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), c).alias("id"))).alias("json")
    nodes = f.select(node("module", F.col("module"))).distinct().unionByName(f.select(node("file", F.col("path")))).unionByName(fn.select(node("fn", F.col("id"))))
    edge = lambda kind, a, b, *more: F.to_json(F.struct(F.lit("edge").alias("type"), F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"), *more)).alias("json")
    at = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c))
    inside = f.select(edge("contains", at("module", "module"), at("file", "path"))).unionByName(fn.select(edge("contains", at("file", "path"), at("fn", "id"))))
    imports = x.file_imports.filter("to_file is not null").select(edge("imports", at("file", "from_file"), at("file", "to_file"))).distinct()
    calls = x.calls.filter("target is not null").select(edge("calls", at("fn", "caller"), at("fn", "target"), F.col("confidence"), F.col("reason")))
    return nodes.unionByName(inside).unionByName(imports).unionByName(calls)


def _cell(v: object) -> str:
    return "n/a" if v is None else str(v)


def markdown(r: dict) -> str:
    rows = [f"## Architecture health: {_cell(r['health']['score'])} ({r['health']['label']})", "", "| module | depth | seams | leverage | locality | owners |", "|---|---|---|---|---|---|"]
    rows += [f"| {m['module']} | " + " | ".join(_cell(m.get(k)) for k in ("depth", "seams", "leverage", "locality", "bus_factor")) + " |" for m in r["modules"]]
    c = r["contamination"]
    rows += ["", f"Duplicate logic: {c['total']} pairs, {len(c['findings'])} shown; score {_cell(c['score'])}."]
    rows += [f"- {f['a_id']} ~ {f['b_id']} ({f['kind']}, {f['confidence']})" for f in c["findings"]]
    rows += [f"- {o['kind']}: {o['module']} ({o['score']})" for o in r["opportunities"]]
    return "\n".join(rows)


def terminal(r: dict) -> str:
    width = max([6, *(len(m["module"]) for m in r["modules"])])
    rows = [f"health {_cell(r['health']['score'])} {r['health']['label']}", f"{'module':{width}} depth seams leverage"]
    return "\n".join([*rows, *(f"{m['module']:{width}} {_cell(m['depth']):>5} {_cell(m['seams']):>5} {_cell(m['leverage']):>8}" for m in r["modules"])])


def page(r: dict) -> str:
    """A page that holds its data: < is escaped, so no string of a repository can end the script."""
    data = to_json(r).replace("<", "\\u003c")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body><pre id='out'></pre><script>const data = {data};document.getElementById('out').textContent = JSON.stringify(data, null, 2);</script></body></html>"


def governance_text(violations: list[dict], skipped: dict[str, int], scope: dict[str, int] | None = None) -> str:
    rows = [f"{len(violations)} violations"] + [f"- [{v['rule']}] {v['message']}" for v in violations]
    rows += [f"not evaluated ({k}): {n}" for k, n in sorted(skipped.items()) if k != "evaluated" and n]
    if scope:
        rows.append(", ".join(f"{k} {n}" for k, n in sorted(scope.items())))
    return "\n".join(rows)


def alerts_text(events: list[dict], head: dict) -> str:
    """Alerts for a terminal: how many of each severity, then a line each."""
    rows = [f"health {_cell(head['health']['score'])} {head['health']['label']}"]
    if not events:
        return "\n".join([*rows, "no regressions against the base"])
    count = {s: sum(e["severity"] == s for e in events) for s in governance.RANKS}
    rows.append(", ".join(f"{n} {s}" for s, n in count.items() if n))
    return "\n".join([*rows, *(f"[{e['severity']}] {e['kind']}: {e['message']}" + (f" -> {e['route']}" if e.get("route") else "") for e in events)])


def alerts_markdown(events: list[dict], head: dict) -> str:
    """Alerts as one markdown table under a marker, so that a later message can take its place."""
    cell = lambda v: str(v or "").replace("|", "\\|").replace("\n", " ")
    rows = ["<!-- codelode-alerts -->", f"## Health alerts: {_cell(head['health']['score'])} ({head['health']['label']})", ""]
    if not events:
        return "\n".join([*rows, "No regressions against the base."])
    rows += ["| severity | kind | finding | to |", "|---|---|---|---|"]
    return "\n".join([*rows, *(f"| {e['severity']} | {e['kind']} | {cell(e['message'])} | {cell(e.get('route'))} |" for e in events)])
