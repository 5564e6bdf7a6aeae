"""Parse dispatch (S4): from files to the canonical tables, in one distributed pass; what can't be parsed is a row, not an error."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode import schema
from codelode.sources import cobol, lexer, python_front

for _m in (sys.modules[__name__], lexer, python_front, cobol):
    cloudpickle.register_pickle_by_value(_m)

PARSER_VERSION = "1"
#: Comment marks by language; COBOL opts out.
COMMENTS = {"py": ("#",), "rb": ("#",), "php": ("//", "#")}
_STOP = frozenset("a an and any are as at be been but by can did do does for from had has have how i if in into is it its just me my of on or our out please so that the their them then there these they this those to up us was we were what when where which who whom why will with would you your".split())


def comment_tokens(text: str, lang: str, most: int = 120) -> list[str] | None:
    """Words of comments in order of first appearance: three characters and more, no stopwords or numbers."""
    if lang == "cob":
        return None
    marks = COMMENTS.get(lang, ("//",))
    seen: dict[str, None] = {}
    for row in text.split("\n"):
        s = row.strip()
        hit = next((s.split(m, 1)[1] for m in marks if m in s), None)
        if hit is None and s.startswith(("/*", "*", '"""', "'''", "=begin")):
            hit = s
        for w in re.findall(r"[A-Za-z][A-Za-z0-9]+", hit or ""):
            w = w.lower()
            if len(w) >= 3 and w not in _STOP:
                seen.setdefault(w)
    return list(seen)[:most]


def code_lines(text: str) -> int:
    return sum(bool(s := r.strip()) and not s.startswith(("//", "#", "*", "/*")) for r in text.split("\n"))


def parse_file(path: str, lang: str, text: str | None) -> dict:
    if text is None:
        raise ValueError("binary or unreadable")
    if lang == "py":
        return python_front.parse(path, text)
    if lang == "cob":
        return cobol.parse(path, text)
    return lexer.parse(path, text, lang)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for f in p.to_dict("records"):
            try:
                got = parse_file(f["path"], f["lang"], f["content"])
            except (SyntaxError, ValueError, IndexError, RecursionError) as e:
                out.append(("skipped", json.dumps({"path": f["path"], "reason": f"{type(e).__name__}: {e}"[:200]})))
                continue
            path, module, test = f["path"], f["module"], bool(f["is_test"])
            rows = [("files", {"path": path, "module": module, "lang": f["lang"], "is_test": test, "is_index": got["is_index"], "code_lines": code_lines(f["content"]), "total_lines": f["content"].count("\n") + 1, "internal_functions": sum(not x["exported"] for x in got["functions"]), "comment_tokens": comment_tokens(f["content"], f["lang"]), "file_ord": int(f["file_ord"])})]
            rows += [("functions", {"path": path, "module": module, "fn_ord": k, **x}) for k, x in enumerate(got["functions"])]
            rows += [("symbols", dict(zip(("path", "module", "name", "kind", "start_line", "end_line", "exported"), (path, module, *x), strict=True))) for x in got["symbols"] or ()]
            rows += [("exports", {"path": path, "module": module, "is_test": test, "name": n, "kind": k, "required_params": r, "total_params": t}) for n, k, r, t in got["exports"]]
            rows += [("imports", {"from_file": path, "from_module": module, "from_is_test": test, "seq": s, "line": n, "specifier": spec, "named": named, "is_type_only": only}) for s, (n, spec, named, only) in enumerate(got["imports"])]
            rows += [("call_sites", {"path": path, "fn": fn, "name": n, "line": ln, "member": m, "is_field": fld}) for fn, n, ln, m, fld in got["call_sites"]]
            rows += [("typed_calls", {"path": path, "fn": fn, "method": m, "type": t}) for fn, m, t in got.get("typed_calls", ())]
            out += [(k, json.dumps(x)) for k, x in rows]
        yield pd.DataFrame(out, columns=["table", "row"])


def parsed(files: DataFrame) -> DataFrame:
    """(table, row as JSON) of every file, in one pass; write it partitioned by table to keep it."""
    return files.select("path", "module", "lang", "is_test", "content", "file_ord").mapInPandas(_records, "table string, row string")


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """The canonical tables from parsed records."""
    return {name: records.filter(F.col("table") == name).select(F.from_json("row", s).alias("r")).select("r.*") for name, s in schema.TABLES.items()}
