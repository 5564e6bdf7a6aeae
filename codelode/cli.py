"""Command line: scan, index, graph, dashboard, policy, alerts, ask, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import Row, SparkSession

from codelode import server
from codelode.operators import governance
from codelode.plans import reports, tools
from codelode.sources import git, store, tree


def session() -> SparkSession:
    return SparkSession.builder.appName("codelode").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def index(spark: SparkSession, root: str) -> tools.Index:
    x = tools.Index.of(spark, root)
    lines = git.log_lines(root)
    if any(lines):
        x.commits = git.commits(spark, lines)
    return x


def evaluate(report: dict, base: dict | None, rules: list[dict]) -> tuple[list[dict], dict[str, int], int]:
    """(violations, skipped by reason, invalid rules) of a report against a policy; rules that can't be checked are counted."""
    found, skipped, invalid = [], {}, 0

    def skip(why: str) -> None:
        skipped[why] = skipped.get(why, 0) + 1

    for k, r in enumerate(rules):
        rid, kind = r.get("id", f"rule-{k}"), r.get("type")
        if kind not in governance.RULE_TYPES or kind == "forbidden-dependency" and (not r.get("to") or r.get("module")):
            invalid += 1
            skip("invalid")
            continue
        add = lambda fp, message, **more: found.append({"rule": rid, "message": r.get("message") or message, "block": r.get("block", True), "fingerprint": fp, **more})  # noqa: B023, E731
        if kind in governance.NEEDS_BASE and base is None:
            skip("no_base")
        elif kind == "health-delta":
            before, now = base["health"]["score"], report["health"]["score"]
            if before is None or now is None:
                skip("not_measured")
            elif before - now > r.get("maxDrop", 0):
                add(rid, f"health fell by {before - now}")
        elif kind == "contamination-delta":
            before, now = base["contamination"]["score"], report["contamination"]["score"]
            if before is None or now is None:
                skip("not_measured")
            elif now - before > r.get("maxRise", 0):
                add(rid, f"duplication rose by {now - before}")
        elif kind == "no-new-duplication":
            keys = base["contamination"].get("pairKeys")
            if not governance.complete_pairs(len(keys) if keys is not None else None, len(base["contamination"]["findings"]), base["contamination"].get("total")):
                skip("incomplete_base")
                continue
            known = set(keys if keys is not None else (f["pair_key"] for f in base["contamination"]["findings"]))
            for f in report["contamination"]["findings"]:
                if f["pair_key"] not in known:
                    add(f"{rid}::{f['pair_key']}", f"new copy: {f['a_id']} ~ {f['b_id']}")
        elif kind in ("metric-floor", "min-owners"):
            metric, least = (r.get("metric", "seams"), r.get("min", 0)) if kind == "metric-floor" else ("bus_factor", r.get("minOwners", 2))
            for m in report["modules"]:
                if m.get(metric) is not None and m[metric] < least and _glob(r.get("module", "*"), m["module"]):
                    add(f"{rid}::{m['module']}", f"{m['module']}: {metric} {m[metric]} is under {least}")
        elif report.get("importEdges") is None:
            skip("no_edges")
        else:
            for e in report["importEdges"]:
                free = e["is_type_only"] and not r.get("includeTypeOnly") or e["from_is_test"] and not r.get("includeTests") or r.get("allowedVia") and _glob(r["allowedVia"], e["from_module"])
                if not free and _glob(r.get("from", "*"), e["from_module"]) and _glob(r["to"], e["to_module"]):
                    add(f"{rid}::{e['from_file']}::{e['to_file']}", f"{e['from_file']} imports {e['to_module']}", file=e["from_file"], line=e["line"])
    return found, skipped, invalid


def _glob(glob: str, name: str) -> bool:
    if glob == "*":
        return True
    if glob.endswith("/*"):
        return name == glob[:-2] or name.startswith(glob[:-1])
    return name.startswith(glob[:-1]) if glob.endswith("*") else name == glob


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codelode", description=__doc__)
    p.add_argument("verb", choices=["scan", "index", "graph", "dashboard", "policy", "alerts", "ask", "serve"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--format", choices=["text", "json", "md", "sarif", "check-run"], default="text")
    p.add_argument("--out")
    p.add_argument("--base", help="a stored report; for serve, the folder of the base snapshot")
    p.add_argument("--telemetry", help="for serve: a file for records of tool calls")
    p.add_argument("--head")
    p.add_argument("--policy")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--store")
    p.add_argument("--question", default="")
    a = p.parse_args(argv)
    spark = session()
    load = lambda f: json.loads(Path(f).read_text()) if f else None
    code = 0
    if a.verb == "index":
        generation, n = store.save(spark, a.store or f"{a.root}/.codelode", tree.read_tree(spark, a.root))
        text = f"generation {generation}, {n} files parsed"
    elif a.verb == "graph":
        text = "\n".join(r[0] for r in reports.graph_json(index(spark, a.root)).toLocalIterator())
    elif a.verb == "serve":
        server.serve(index(spark, a.root), base=tools.Index.of(spark, a.base) if a.base else None, log=a.telemetry)
        return 0
    elif a.verb == "ask":
        kind, tool, out = tools.query_repository(index(spark, a.root), a.question)
        text = f"{kind} -> {tool}\n" + ("\n".join(str(r.asDict()) for r in out.limit(50).collect()) if out is not None else "no answer")
    else:
        head = load(a.head) or reports.report(index(spark, a.root))
        base = load(a.base)
        if a.verb == "dashboard":
            text = reports.page(head)
        elif a.verb == "scan":
            text = {"json": reports.to_json, "md": reports.markdown}.get(a.format, reports.terminal)(head)
        elif a.verb == "policy":
            rules = (load(a.policy) or {"rules": governance.RATCHET})["rules"]
            found, skipped, invalid = evaluate(head, base, rules)
            unsaid = governance.disclosures(head, rules, _glob)
            blocking = sum(v["block"] for v in found)
            code = governance.exit_code(len(found), blocking, invalid, a.strict)
            if a.format == "sarif":
                text = governance.sarif(found, [{"rule": k, "reason": f"{n} rules"} for k, n in skipped.items()] + [{"rule": "coverage", "reason": x} for x in unsaid])
            elif a.format == "check-run":
                text = json.dumps(governance.check_run(found, invalid, a.strict))
            else:
                text = "\n".join([reports.governance_text(found, skipped), *unsaid])
        else:
            base = base or head
            row = lambda r: Row(health=r["health"]["score"], band=r["health"]["label"], contamination=r["contamination"]["score"] or 0)
            fresh = set(head["contamination"]["pairKeys"] or ()) - set(base["contamination"]["pairKeys"] or ())
            events = [{"kind": kind, "severity": severity, "module": "", "message": f"{kind.replace('-', ' ')} against the base"} for kind, severity in governance.report_alerts(row(head), row(base), len(fresh))]
            events = sorted(events + governance.module_alerts(head["modules"], base["modules"]), key=lambda e: (governance.RANKS.index(e["severity"]), e["kind"], e["module"]))
            text = json.dumps(events) if a.format == "json" else reports.alerts_markdown(events, head) if a.format == "md" else reports.alerts_text(events, head)
    Path(a.out).write_text(text) if a.out else print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
