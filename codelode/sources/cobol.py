"""The COBOL front end (S19): fixed columns, paragraphs as functions, PERFORM, CALL and GO TO as calls, COPY as imports."""

from __future__ import annotations

import re

from codelode.sources.lexer import fnv

#: Verbs that stay in the shape of a body; divisions and sections that are no paragraphs.
VERBS = frozenset("ACCEPT ADD CALL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ELSE END-IF END-PERFORM EVALUATE EXIT GO GOBACK IF INITIALIZE MOVE MULTIPLY OPEN PERFORM READ REWRITE SEARCH SET STOP STRING SUBTRACT UNSTRING UNTIL VARYING WHEN WRITE".split())
_RESERVED = re.compile(r"(DIVISION|SECTION|END-|EXIT$|STOP$|GOBACK$)")


def _code(row: str) -> str:
    """A row without its sequence area and comments; fixed columns if the first six are blank or digits."""
    if re.match(r"^[\d ]{6}[ *\-/D]", row):
        return "" if row[6] in "*/" else row[7:72]
    return "" if row.lstrip().startswith("*") else row


def parse(path: str, text: str) -> dict:
    rows = [_code(r).rstrip() for r in text.split("\n")]
    functions, exports, imports, sites = [], [], [], []
    program, divided, current = None, False, None
    paragraphs: list[dict] = []
    for n, row in enumerate(rows, 1):
        up = row.strip().upper()
        if m := re.search(r"PROGRAM-ID\.?\s+([\w-]+)", up):
            program = m[1]
            exports.append((program, "function", 0, 0))
        if re.match(r"PROCEDURE\s+DIVISION", up):
            divided = True
            continue
        if m := re.search(r"\bCOPY\s+[\"']?([\w-]+)", up):
            imports.append((n, m[1], [], False))
        if not divided or not up:
            continue
        head = re.match(r"([A-Z0-9][\w-]*)(\s+SECTION)?\.\s*$", up)
        if head and not _RESERVED.search(head[1]) and (len(row) - len(row.lstrip()) < 4):
            if current:
                current["end"] = n - 1
            current = {"name": head[1], "start": n, "end": len(rows), "tokens": [], "literals": []}
            paragraphs.append(current)
            continue
        if current is None:
            current = {"name": program or "MAIN", "start": n, "end": len(rows), "tokens": [], "literals": []}
            paragraphs.append(current)
        for m in re.finditer(r"\bPERFORM\s+([A-Z0-9][\w-]*)(?:\s+(?:THRU|THROUGH)\s+([A-Z0-9][\w-]*))?|\bCALL\s+[\"']([\w-]+)[\"']|\bGO\s+TO\s+([A-Z0-9][\w-]*)", up):
            for name in (m[1], m[2], m[3], m[4]):
                if name and name not in ("UNTIL", "VARYING"):
                    sites.append((current["name"], name, n, False, False))
        for t in re.findall(r"\"[^\"]*\"|'[^']*'|[\w-]+|[^\s\w]", up):
            literal = t[0] in "\"'" or t[0].isdigit()
            current["tokens"].append(t if t in VERBS or not t[0].isalnum() and not literal else "LIT" if literal else "ID")
            if literal:
                current["literals"].append(t)
    using = re.search(r"PROCEDURE\s+DIVISION\s+USING\s+([^.]*)\.", "\n".join(rows).upper())
    params = [x for x in re.split(r"[\s,]+", using[1]) if x and x not in ("BY", "REFERENCE", "VALUE")] if using else []
    if program:
        exports[0] = (program, "function", len(params), len(params))
        every = [t for p in paragraphs for t in p["tokens"]]
        functions.append({"name": program, "start_line": paragraphs[0]["start"] if paragraphs else 1, "end_line": len(rows), "decl_line": 1, "exported": True, "param_count": len(params), "param_names": params, "required_params": len(params), "body_hash": fnv(every), "body_tokens": len(every), "literal_hash": fnv([x for p in paragraphs for x in p["literals"]]), "def_hash": fnv([program, *every]), "calls": sorted({n for _, n, *_ in sites}), "member_calls": [], "enclosing_type": None, "type_refs": None, "ngram_sketch": None})
    for p in paragraphs:
        calls = sorted({name for fn, name, *_ in sites if fn == p["name"]})
        functions.append({"name": p["name"], "start_line": p["start"], "end_line": p["end"], "decl_line": p["start"], "exported": False, "param_count": 0, "param_names": [], "required_params": 0, "body_hash": fnv(p["tokens"]), "body_tokens": len(p["tokens"]), "literal_hash": fnv(p["literals"]), "def_hash": fnv([p["name"], *p["tokens"], *p["literals"]]), "calls": calls, "member_calls": [], "enclosing_type": None, "type_refs": None, "ngram_sketch": None})
    return {"functions": functions, "symbols": None, "exports": exports, "imports": imports, "call_sites": sites, "is_index": False}
