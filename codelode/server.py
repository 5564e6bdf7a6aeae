"""The tools over newline-delimited JSON-RPC 2.0 on stdin and stdout, with two resources and a prompt that show the tree at a glance."""

from __future__ import annotations

import inspect
import json
import sys
import time
from typing import IO

from pyspark.sql import DataFrame

from codelode.plans import tools
from codelode.sources import store

PROTOCOL = "2024-11-05"
#: Tools that compare two snapshots: they take the server's base, and say so where it has none.
NEEDS_BASE = ("check_my_changes", "diff_context", "change_impact")
#: Resources by address: the tool that each one shows.
RESOURCES = {"codelode://repo-map": "repo_map", "codelode://health": "architecture_health"}


def describe() -> list[dict]:
    out = []
    for name, f in tools.TOOLS.items():
        args = [a for a in list(inspect.signature(f).parameters.values())[2 if name in NEEDS_BASE else 1 :]]
        kinds = {a.name: {"type": "integer" if a.annotation == "int" else "string"} for a in args}
        out.append({"name": name, "description": (f.__doc__ or name.replace("_", " ")).strip().split("\n")[0], "inputSchema": {"type": "object", "properties": kinds, "required": [a.name for a in args if a.default is inspect.Parameter.empty]}})
    return out


def render(answer: object, most: int = 200) -> str:
    """An answer as JSON lines; a list that was cut says so."""
    if isinstance(answer, DataFrame):
        rows = answer.limit(most + 1).collect()
        lines = [json.dumps(r.asDict(recursive=True), default=str) for r in rows[:most]]
        return "\n".join([*lines, *(["... more rows"] if len(rows) > most else [])])
    if isinstance(answer, tuple):
        return "\n".join(render(a) if isinstance(a, DataFrame) else json.dumps(a, default=str) for a in answer)
    return json.dumps(answer, default=str)


def handle(index: tools.Index, message: dict, base: tools.Index | None = None) -> dict | None:
    """The reply to one message; notifications have none; errors are replies, never exceptions."""
    rid, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    ok = lambda result: {"jsonrpc": "2.0", "id": rid, "result": result}
    bad = lambda code, text: {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": text}}
    if rid is None:
        return None
    if method == "initialize":
        return ok({"protocolVersion": PROTOCOL, "serverInfo": {"name": "codelode"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": describe()})
    if method == "resources/list":
        return ok({"resources": [{"uri": uri, "name": tool, "description": (tools.TOOLS[tool].__doc__ or tool).strip().split("\n")[0], "mimeType": "text/plain"} for uri, tool in RESOURCES.items()]})
    if method == "resources/read":
        if not isinstance(uri := params.get("uri"), str):
            return bad(-32602, "uri has to be a string")
        if uri not in RESOURCES:
            return bad(-32002, f"no such resource: {uri}")
        try:
            return ok({"contents": [{"uri": uri, "mimeType": "text/plain", "text": render(tools.TOOLS[RESOURCES[uri]](index))}]})
        except Exception as e:
            return bad(-32603, f"{uri}: {str(e)[:300]}")
    if method == "prompts/list":
        return ok({"prompts": [{"name": "orient", "description": "The module map of this tree, and which tool answers what."}]})
    if method == "prompts/get":
        if params.get("name") != "orient":
            return bad(-32602, f"no such prompt: {params.get('name')}")
        try:
            shown = render(tools.repo_map(index))
        except Exception:
            shown = "The map can't be shown now; call repo_map."
        text = "These are the modules of this tree. find_symbol finds a name, file_outline a file's shape, read_function its lines, context_bundle what belongs to it; query_repository takes a question in words.\n\n" + shown
        return ok({"description": "Where things are", "messages": [{"role": "user", "content": {"type": "text", "text": text}}]})
    if method != "tools/call":
        return bad(-32601, f"unknown method {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in tools.TOOLS:
        return bad(-32602, f"unknown tool {name}")
    if name in NEEDS_BASE:
        if base is None:
            return ok({"isError": True, "content": [{"type": "text", "text": "needs a base snapshot"}]})
        args = {"base": base, **args}
    start = time.perf_counter()
    try:
        text, failed = render(tools.TOOLS[name](index, **args)), False
    except TypeError as e:
        return bad(-32602, str(e))
    except Exception as e:
        text, failed = f"{type(e).__name__}: {str(e)[:300]}", True
    ms = round((time.perf_counter() - start) * 1000)
    return ok({"isError": failed, "content": [{"type": "text", "text": text}], "meta": {"ms": ms, "tokens": (len(text) + 2) // 4}})


def serve(index: tools.Index, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout, base: tools.Index | None = None, log: str | None = None) -> None:
    """Answer messages until the source ends; ``log`` is a file for telemetry of tool calls."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = handle(index, message, base) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
            if log and isinstance(message, dict) and message.get("method") == "tools/call" and "result" in (reply or {}):
                call, result = message.get("params") or {}, reply["result"]
                store.append_telemetry(log, str(call.get("name")), call.get("arguments") or {}, result.get("meta", {}).get("ms", 0), len(result["content"][0]["text"]), not result["isError"])
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
