"""The Python front end (S7), on the standard library's parser."""

from __future__ import annotations

import ast
import io
import tokenize

from codelode.sources.lexer import KEYWORDS, fnv, sketch

_SKIP = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER)
_PY = KEYWORDS | frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False".split())


def _specifier(node: ast.ImportFrom) -> str:
    """A relative import as a path: one dot is ./, each more is ../"""
    if not node.level:
        return node.module or ""
    up = "./" if node.level == 1 else "../" * (node.level - 1)
    return up + (node.module or "").replace(".", "/")


def parse(path: str, text: str) -> dict:
    """Functions at any depth; only top-level names export: those in __all__, or without it those that start with no underscore."""
    tree = ast.parse(text)
    lines: dict[int, list[tokenize.TokenInfo]] = {}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type not in _SKIP:
            lines.setdefault(t.start[0], []).append(t)
    listed = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            listed = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
    public = lambda name: name in listed if listed is not None else not name.startswith("_")
    functions, symbols, exports, imports, sites, typed = [], [], [], [], [], []
    attributes: dict[str | None, dict[str, str | None]] = {}  # of each class, its attributes' types

    def body_tokens(node: ast.AST) -> list[tokenize.TokenInfo]:
        first = node.body[0]
        return [t for n in range(first.lineno, node.end_lineno + 1) for t in lines.get(n, ()) if (n, t.start[1]) >= (first.lineno, first.col_offset)]

    def type_of(node: ast.AST | None) -> str | None:
        """The class that an annotation names or a call makes, by a capitalised name."""
        if isinstance(node, ast.Call):
            node = node.func
        name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else node.value.split(".")[-1] if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""
        return name if name[:1].isupper() else None

    def learn(into: dict[str, str | None], name: str, kind: str | None) -> None:
        if kind:
            into[name] = kind if into.get(name, kind) == kind else None

    def typed_in(fn: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> None:
        local: dict[str, str | None] = {}
        for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]:
            learn(local, a.arg, type_of(a.annotation))
        mine = attributes.setdefault(owner, {}) if owner else {}
        for n in ast.walk(fn):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            kind = type_of(n.annotation) if isinstance(n, ast.AnnAssign) else type_of(n.value) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) else local.get(n.value.id) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Name) else None
            for t in targets:
                if isinstance(t, ast.Name):
                    learn(local, t.id, kind)
                elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    learn(mine, t.attr, kind)
        calls = [c.func for c in ast.walk(fn) if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute)]
        for f in calls:
            v = f.value
            if isinstance(v, ast.Name):
                kind = owner if v.id in ("self", "cls") else local.get(v.id)
            else:
                kind = mine.get(v.attr) if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "self" else None
            if kind and (fn.name, f.attr, kind) not in typed:
                typed.append((fn.name, f.attr, kind))
        called = {id(f) for f in calls}
        sites.extend((fn.name, n.attr, n.lineno, True, True) for n in ast.walk(fn) if isinstance(n, ast.Attribute) and id(n) not in called)

    def visit(node: ast.AST, owner: str | None, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                ts = body_tokens(child)
                norm = [t.string if t.type == tokenize.OP or t.string in _PY else "ID" if t.type == tokenize.NAME else "LIT" for t in ts]
                called = [(c.func.id, c.lineno, False) if isinstance(c.func, ast.Name) else (c.func.attr, c.lineno, True) for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)]
                args = [a.arg for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs] if a.arg not in ("self", "cls")]
                optional = len(child.args.defaults) + sum(d is not None for d in child.args.kw_defaults)
                out = top and public(child.name)
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                functions.append({"name": child.name, "start_line": start, "end_line": child.end_lineno, "decl_line": child.lineno, "exported": out, "param_count": len(args), "param_names": args, "required_params": max(0, len(args) - optional), "body_hash": fnv(norm), "body_tokens": len(norm), "literal_hash": fnv([t.string for t in ts if t.type in (tokenize.STRING, tokenize.NUMBER)]), "def_hash": fnv([child.name, *(t.string for t in ts)]), "calls": sorted({n for n, _, m in called if not m}), "member_calls": sorted({n for n, _, m in called if m}), "enclosing_type": owner, "type_refs": None, "ngram_sketch": sketch(norm)})
                sites.extend((child.name, *c, False) for c in called)
                typed_in(child, owner)
                if top:
                    symbols.append((child.name, "function", start, child.end_lineno, out))
                    if out:
                        exports.append((child.name, "function", max(0, len(args) - optional), len(args)))
                visit(child, owner, False)
            elif isinstance(child, ast.ClassDef):
                symbols.append((child.name, "class", child.lineno, child.end_lineno, top and public(child.name)))
                if top and public(child.name):
                    exports.append((child.name, "class", 0, 0))
                inits = [x for x in child.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"]
                child.body = inits + [x for x in child.body if x not in inits]  # attributes first
                visit(child, child.name, False)
            elif isinstance(child, ast.Import):
                imports.extend((child.lineno, a.name, [], False) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append((child.lineno, _specifier(child), [a.name for a in child.names], False))
            elif top and isinstance(child, ast.Assign | ast.AnnAssign):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        symbols.append((t.id, "const", child.lineno, child.end_lineno, public(t.id)))
                        if public(t.id):
                            exports.append((t.id, "const", 0, 0))
            else:
                visit(child, owner, top and isinstance(child, ast.If | ast.Try))

    visit(tree, None, True)
    return {"functions": functions, "symbols": symbols, "exports": exports, "imports": imports, "call_sites": sites, "typed_calls": typed, "is_index": path.rsplit("/", 1)[-1] == "__init__.py"}
