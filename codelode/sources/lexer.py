"""A front end for the brace languages and Ruby (S5, S6, S8-S18): one tokeniser, language profiles, one scope walk.

There is no grammar here, only tokens: names, spans, calls, imports, visibility, shapes and sketches come from the token stream,
and so do the declared types of parameters, locals and fields, as far as a name stands beside one. A name with two types has none.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

#: Sketch size, gram width and floor; hash constants.
K, GRAM, FLOOR = 24, 4, 12
OFFSET, PRIME = 0x811C9DC5, 0x01000193


def fnv(tokens: list[str]) -> int:
    h = OFFSET
    for t in tokens:
        for c in t:
            h = (h ^ ord(c)) * PRIME & 0xFFFFFFFF
        h = (h ^ 31) * PRIME & 0xFFFFFFFF
    return h


def sketch(tokens: list[str]) -> list[int] | None:
    if len(tokens) < FLOOR:
        return None
    grams = {"|".join(tokens[i : i + GRAM]) for i in range(len(tokens) - GRAM + 1)}
    return sorted(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=4).digest(), "big") for g in grams)[:K]


@dataclass(frozen=True)
class Profile:
    """What tells a language's declarations apart."""

    functions: frozenset[str] = frozenset()  # keywords before a function's name
    types: dict[str, str] = field(default_factory=dict)  # keyword -> kind
    bare: bool = True  # functions may be declared by name and parentheses alone
    private: frozenset[str] = frozenset()  # words that hide a declaration
    public: frozenset[str] = frozenset()  # words that alone export one
    exported: str = ""  # rule by name: "capital", "underscore"
    hash_comment: bool = False
    backtick: bool = False
    index: tuple[str, ...] = ()


_CLASS = {"class": "class", "interface": "interface", "enum": "enum", "trait": "interface", "struct": "class", "record": "class", "object": "class", "protocol": "interface", "union": "class", "mixin": "class", "extension": "module", "namespace": "module", "impl": "module", "type": "type"}
_pick = lambda *k: {x: _CLASS[x] for x in k}
PROFILES = {
    "ts": Profile(frozenset({"function"}), _pick("class", "interface", "enum", "namespace", "type"), True, frozenset({"private", "protected"}), frozenset({"export"}), backtick=True, index=("index.",)),
    "go": Profile(frozenset({"func"}), _pick("type"), False, exported="capital", backtick=True),
    "java": Profile(frozenset(), _pick("class", "interface", "enum", "record"), True, public=frozenset({"public"})),
    "cs": Profile(frozenset(), _pick("class", "interface", "enum", "struct", "record", "namespace"), True, public=frozenset({"public"})),
    "rs": Profile(frozenset({"fn"}), _pick("struct", "enum", "trait", "impl", "type", "union"), False, public=frozenset({"pub"}), index=("mod.rs", "lib.rs", "main.rs")),
    "php": Profile(frozenset({"function"}), _pick("class", "interface", "trait", "enum"), False, frozenset({"private", "protected"}), hash_comment=True),
    "c": Profile(frozenset(), _pick("struct", "enum", "union"), True, frozenset({"static"})),
    "cpp": Profile(frozenset(), _pick("class", "struct", "enum", "union", "namespace"), True, frozenset({"static"})),
    "dart": Profile(frozenset(), _pick("class", "enum", "mixin", "extension"), True, exported="underscore"),
    "kt": Profile(frozenset({"fun"}), _pick("class", "interface", "object"), False, frozenset({"private", "protected"})),
    "swift": Profile(frozenset({"func"}), _pick("class", "struct", "enum", "protocol", "extension"), False, frozenset({"private", "fileprivate"})),
}
CONTROL = frozenset("if for while switch catch return else do try when match with synchronized lock using foreach unless until sizeof typeof await yield throw new delete super this assert guard defer in is as and or not case elseif elif".split())
KEYWORDS = CONTROL | frozenset("function func fn fun def class interface enum struct trait type const let var val final static public private protected internal export import from package use async abstract override virtual readonly void int long float double bool boolean char string byte short unsigned signed true false null nil none self extends implements default break continue".split())
TOKEN = re.compile(r"""(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<b>`(?:\\.|[^`\\])*`)|(?P<h>\#[^\n]*)|(?P<n>\b\d[\w.]*)|(?P<i>[A-Za-z_$][\w$]*)|(?P<o>=>|->|::|\?\.|[{}()\[\];,.:=<>!&|+*/%^~?@-])""", re.S)


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens(text: str, profile: Profile) -> list[Token]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup
        if kind == "c" or (kind == "h" and profile.hash_comment):
            continue
        if kind == "h":
            kind = "d"
        out.append(Token("s" if kind == "b" else kind, m.group(), line))
    return out


def matching(ts: list[Token], at: int) -> int:
    """The index of the bracket that closes the one at ``at``, or the end."""
    close = {"(": ")", "{": "}", "[": "]"}[ts[at].text]
    depth = 0
    for k in range(at, len(ts)):
        if ts[k].text == ts[at].text and ts[k].kind == "o":
            depth += 1
        elif ts[k].text == close and ts[k].kind == "o":
            depth -= 1
            if not depth:
                return k
    return len(ts) - 1


def shape(ts: list[Token]) -> tuple[list[str], list[str]]:
    """A body's normalised tokens (names ID, literals LIT) and its literals."""
    norm = [t.text if t.kind in "od" or t.text in KEYWORDS else "ID" if t.kind == "i" else "LIT" for t in ts]
    return norm, [t.text for t in ts if t.kind in "sn"]


def parameters(ts: list[Token], lang: str) -> tuple[list[str], int]:
    """Names of a parameter list, and how many have no default."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        depth += (t.text in "([{<") - (t.text in ")]}>") if t.kind == "o" else 0
        if t.text == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    names, required = [], 0
    for p in parts:
        ids = [t.text for t in p if t.kind == "i"]
        if not ids or ids[0] in ("self", "this") or ids == ["void"]:
            continue
        head = [t.text for t in p]
        before = head.index(":") if ":" in head else head.index("=") if "=" in head else len(head)
        own = [t.text for t in p[:before] if t.kind == "i" and t.text not in KEYWORDS] or ids
        names.append(own[0] if lang in ("ts", "go", "rs", "kt", "php") else own[-1] if lang in ("java", "c", "cpp", "cs", "dart") and ":" not in head else own[-1])
        required += "=" not in head and "?" not in head
    return names, required


def _imports(text: str, lang: str) -> list[tuple[int, str, list[str], bool]]:
    """(line, specifier, names, type only)."""
    out = []
    line_of = lambda m: text.count("\n", 0, m.start()) + 1
    names = lambda s: [re.split(r"\s+as\s+|:", x.strip())[0].removeprefix("type ").strip() for x in s.split(",") if x.strip()]
    if lang == "ts":
        for m in re.finditer(r"""(?:import|export)\s+(type\s+)?(?:([\w$*]+)?\s*,?\s*(?:\{([^}]*)\})?\s*(?:\*\s*(?:as\s+[\w$]+)?)?\s*from\s*)?["']([^"'\n]+)["']|require\(\s*["']([^"']+)["']\s*\)""", text):
            inner = m[3] or ""
            only = bool(m[1]) or bool(inner.strip()) and not m[2] and all(x.strip().startswith("type ") for x in inner.split(",") if x.strip())
            out.append((line_of(m), m[4] or m[5], ([m[2]] if m[2] and m[2] != "*" else []) + names(inner), only))
    elif lang == "go":
        for m in re.finditer(r'import\s*\(([^)]*)\)|import\s+(?:[\w.]+\s+)?"([^"]+)"', text):
            if m[2]:
                out.append((line_of(m), m[2], [], False))
            else:
                first = text.count("\n", 0, m.start(1)) + 1
                out += [(first + k, x[1], [], False) for k, row in enumerate(m[1].split("\n")) if (x := re.search(r'"([^"]+)"', row))]
    else:
        rule = {
            "java": r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", "kt": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import[ \t]+(?:\w+[ \t]+)?([\w.]+)", "cs": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
            "rs": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "php": r"^\s*use\s+([\w\\]+)", "c": r'^\s*#\s*include\s+["<]([^">]+)[">]', "cpp": r'^\s*#\s*include\s+["<]([^">]+)[">]', "dart": r"""^\s*(?:import|export)\s+['"]([^'"]+)['"]""", "rb": r"""^\s*(?:require|require_relative|load)\s+['"]([^'"]+)['"]""",
        }.get(lang)
        for m in re.finditer(rule, text, re.M) if rule else ():
            spec = m[1]
            if lang == "rs":
                spec = spec.replace("::", "/").rstrip("/")
            elif lang == "php":
                spec = spec.replace("\\", "/")
            elif lang in ("c", "cpp"):
                spec = spec.rsplit("/", 1)[-1]
            elif lang == "rb" and "require_relative" in m[0]:
                spec = spec if spec.startswith(".") else f"./{spec}"
            out.append((text.count("\n", 0, m.start(1)) + 1, spec, [], False))
    return out


def calls_of(ts: list[Token]) -> list[tuple[str, int, bool]]:
    """(name, line, member) of each call in a body."""
    out = []
    for k, t in enumerate(ts[:-1]):
        if t.kind == "i" and ts[k + 1].text == "(" and t.text not in KEYWORDS and not (k and ts[k - 1].text in ("func", "function", "fn", "fun", "new")):
            out.append((t.text, t.line, bool(k) and ts[k - 1].text in (".", "?.", "->", "::")))
    return out


def fields_of(ts: list[Token]) -> list[tuple[str, int, bool]]:
    """(name, line, member) of each member that a body reads or writes without calling it."""
    return [(t.text, t.line, True) for k, t in enumerate(ts) if k and t.kind == "i" and ts[k - 1].text in (".", "?.", "->") and (k + 1 == len(ts) or ts[k + 1].text != "(")]


#: Languages that write a type before the name, and words that may stand before a name with its type behind.
TYPE_FIRST = frozenset("java cs dart c cpp php".split())
_DECLARES = frozenset("( , ; { } let const var val mut private public protected readonly static lateinit final weak".split())
_named_type = lambda t: t.kind == "i" and t.text[:1].isupper() and t.text not in KEYWORDS


def declared(ts: list[Token], lang: str, fields: bool = False) -> dict[str, str | None]:
    """Types of names that these tokens declare: beside the name, or by what it is made from; None where they disagree.

    ``fields``: of a class body, whose methods' bodies are passed over.
    """
    out: dict[str, str | None] = {}
    k, depth = 0, 0
    while k < len(ts):
        t = ts[k]
        depth += (t.text == "{") - (t.text == "}") if t.kind == "o" else 0
        if t.kind != "i" or t.text in KEYWORDS or fields and depth:
            k += 1
            continue
        at = lambda j: ts[k + j] if 0 <= k + j < len(ts) else Token("o", "", 0)  # noqa: B023, E731
        name = kind = None
        if at(1).text == ":" and lang not in TYPE_FIRST and (at(-1).text in _DECLARES or k == 0):
            j = 2
            while at(j).text in ("&", "mut", "*"):
                j += 1
            if _named_type(at(j)):
                name, kind = t.text, at(j).text
        if lang in TYPE_FIRST and _named_type(t):
            j = 1
            while lang in ("c", "cpp") and at(j).text in ("*", "&", "const"):
                j += 1
            if at(j).kind == "i" and at(j).text not in KEYWORDS and at(j + 1).text in ("=", ";", ",", ")", ":", "in"):
                name, kind = at(j).text, t.text
        if lang == "go":
            j = 1 + (at(1).text == "*")
            if _named_type(at(j)) and at(-1).text in ("(", ",", "var", "{", ";"):
                name, kind = t.text, at(j).text
            made = 3 if at(1).text == ":" and at(2).text == "=" else 2 if at(1).text == ":=" else 0
            made += bool(made) and at(made).text == "&"
            if made and _named_type(at(made)) and at(made + 1).text == "{":
                name, kind = t.text, at(made).text
        if name is None and at(1).text == "=" and at(2).text == "new" and _named_type(at(3)):
            name, kind = t.text, at(3).text
        if name is None and at(1).text == "=" and lang in ("kt", "swift", "dart") and _named_type(at(2)) and at(3).text == "(":
            name, kind = t.text, at(2).text
        if name is not None:
            out[name] = kind if out.get(name, kind) == kind else None
        k += 1
    return out


def typed_calls_of(ts: list[Token], types: dict[str, str | None], own: str | None, fields: dict[str, str | None]) -> list[tuple[str, str]]:
    """(method, type) of calls on a name, a field or the object itself whose type is declared."""
    out = []
    for k in range(len(ts) - 3):
        recv, dot, method = ts[k], ts[k + 1], ts[k + 2]
        if recv.kind != "i" or dot.text not in (".", "?.", "->", "!.") or method.kind != "i" or ts[k + 3].text != "(":
            continue
        if k and ts[k - 1].text in (".", "?.", "->", "::", "!."):
            kind = fields.get(recv.text) if k > 1 and ts[k - 2].text in ("this", "self") and (k < 3 or ts[k - 3].text not in (".", "->")) else None
        else:
            kind = own if recv.text in ("this", "self") else types[recv.text] if recv.text in types else fields.get(recv.text)
        if kind and (method.text, kind) not in out:
            out.append((method.text, kind))
    return out


def _exported(name: str, words: set[str], p: Profile, depth_class: bool, lang: str) -> bool:
    if p.exported == "capital":
        return name[:1].isupper()
    if p.exported == "underscore":
        return not name.startswith("_")
    if p.public and not (lang == "ts" and depth_class):
        return bool(words & p.public)
    return not words & p.private


def parse(path: str, text: str, lang: str) -> dict:
    """Functions, symbols, exports, imports and call sites of one file."""
    if lang == "vue":
        return parse(path, "\n".join(_vue_lines(text)), "ts")
    if lang == "rb":
        return _ruby(text)
    p = PROFILES.get(lang, PROFILES["ts"])
    ts = tokens(text, p)
    functions, symbols, exports, sites, typed = [], [], [], [], []
    classes: list[tuple[str, int]] = []  # name, closing index
    members: list[dict[str, str | None]] = []  # of each class, its fields' types
    sections: list[bool] = []  # of each class of C++, whether its members are public here
    k, modifiers = 0, set()
    while k < len(ts):
        t = ts[k]
        while classes and k > classes[-1][1]:
            classes.pop()
            sections.pop()
            members.pop()
        if lang == "cpp" and classes and t.text in ("public", "protected", "private") and k + 1 < len(ts) and ts[k + 1].text == ":":
            sections[-1] = t.text == "public"
            k, modifiers = k + 2, set()
            continue
        if t.kind == "o" and t.text in ";{}":
            modifiers = set()
        if t.kind == "i" and t.text in p.types and k + 1 < len(ts) and ts[k + 1].kind == "i":
            name, kind = ts[k + 1].text, p.types[t.text]
            if lang == "go" and k + 2 < len(ts):
                kind = {"struct": "class", "interface": "interface"}.get(ts[k + 2].text, "type")
            body = next((j for j in range(k + 1, min(len(ts), k + 80)) if ts[j].text in "{;" or (lang in ("ts", "kt", "rs") and ts[j].text == "=")), len(ts) - 1)
            if lang in ("c", "cpp") and ts[body].text != "{":
                k += 1
                continue
            close = matching(ts, body) if ts[body].text == "{" else body
            out = _exported(name, modifiers, p, bool(classes), lang)
            symbols.append((name, kind, t.line, ts[close].line, out))
            if out and kind != "module":
                exports.append((name, "class" if kind == "class" else "type", 0, 0))
            if ts[body].text == "{" and (kind in ("class", "interface", "module", "enum")):
                classes.append((name, close))
                sections.append(lang != "cpp" or t.text != "class")
                members.append(declared(ts[body + 1 : close], lang, fields=True))
                k = body + 1
                modifiers = set()
                continue
        found = _function_at(ts, k, p, lang, bool(classes))
        if found:
            name, opening, closing, body, end = found
            inner = ts[body : end + 1]
            params, required = parameters(ts[opening + 1 : closing], lang)
            norm, literals = shape(inner)
            words = modifiers | {x.text for x in ts[max(0, k - 1) : k]}
            out = _exported(name, words, p, bool(classes), lang) and all(sections)
            called = calls_of(inner)
            functions.append({"name": name, "start_line": t.line, "end_line": ts[end].line, "decl_line": t.line, "exported": out, "param_count": len(params), "param_names": params, "required_params": required, "body_hash": fnv(norm), "body_tokens": len(norm), "literal_hash": fnv(literals), "def_hash": fnv([x.text for x in ts[k : end + 1]]), "calls": sorted({c for c, _, m in called if not m}), "member_calls": sorted({c for c, _, m in called if m}), "enclosing_type": classes[-1][0] if classes else None, "type_refs": None, "ngram_sketch": sketch(norm)})
            sites += [(name, *c, False) for c in called] + [(name, *c, True) for c in fields_of(inner)]
            local = declared(ts[opening : closing + 1] + inner, lang)
            typed += [(name, *x) for x in typed_calls_of(inner, local, classes[-1][0] if classes else None, members[-1] if members else {})]
            if not classes:
                symbols.append((name, "function", t.line, ts[end].line, out))
                if out:
                    exports.append((name, "function", required, len(params)))
            k, modifiers = end + 1, set()
            continue
        if lang == "ts" and t.text in ("const", "let", "var") and "export" in modifiers and k + 1 < len(ts) and ts[k + 1].kind == "i":
            exports.append((ts[k + 1].text, "const", 0, 0))
            symbols.append((ts[k + 1].text, "const", t.line, t.line, True))
        if t.kind == "i":
            modifiers.add(t.text)
        k += 1
    if lang == "ts":
        exports += [(n, "reexport", 0, 0) for m in re.finditer(r"export\s*\{([^}]*)\}\s*from", text) for n in (x.strip().split(" as ")[-1].strip() for x in m[1].split(",")) if n]
    base = path.rsplit("/", 1)[-1]
    return {"functions": functions, "symbols": symbols, "exports": exports, "imports": _imports(text, lang), "call_sites": sites, "typed_calls": typed, "is_index": any(base.startswith(x) if x.endswith(".") else base == x for x in p.index)}


def _function_at(ts: list[Token], k: int, p: Profile, lang: str, in_class: bool):
    """(name, opening, closing parenthesis, first body token, last body token) of a function that starts at k."""
    t = ts[k]
    if t.kind != "i":
        return None
    name = opening = None
    if t.text in p.functions:
        j = k + 1
        if lang == "go" and j < len(ts) and ts[j].text == "(":
            j = matching(ts, j) + 1
        while j < len(ts) and ts[j].text in ("*", "&"):
            j += 1
        if lang == "kt" and j < len(ts) and ts[j].text == "<":
            j = next((i + 1 for i in range(j, len(ts)) if ts[i].text == ">"), j)
        if j < len(ts) and ts[j].kind == "i":
            name, j = ts[j].text, j + 1
            while lang in ("kt", "swift") and j + 1 < len(ts) and ts[j].text == ".":
                name, j = ts[j + 1].text, j + 2
            if j < len(ts) and ts[j].text == "<":
                j = next((i + 1 for i in range(j, len(ts)) if ts[i].text == ">" and ts[i + 1 : i + 2] and ts[i + 1].text == "("), j)
            opening = j if j < len(ts) and ts[j].text == "(" else None
    elif lang == "ts" and t.text in ("const", "let", "var") and k + 2 < len(ts) and ts[k + 1].kind == "i":
        j = next((i for i in range(k + 2, min(len(ts), k + 40)) if ts[i].text in ("=", ";")), None)
        if j is not None and ts[j].text == "=":
            j += 1
            while j < len(ts) and ts[j].text in ("async", "function"):
                j += 1
            if j < len(ts) and ts[j].text == "(":
                c = matching(ts, j)
                after = next((i for i in range(c + 1, min(len(ts), c + 30)) if ts[i].text in ("=>", "{", ";")), None)
                if after is not None and (ts[after].text == "=>" or ts[j - 1].text == "function"):
                    name, opening = ts[k + 1].text, j
    elif p.bare and t.text not in KEYWORDS and k + 1 < len(ts) and ts[k + 1].text == "(":
        before = ts[k - 1] if k else None
        typed = before is not None and (before.kind == "i" and before.text not in CONTROL or before.text in (">", "]", "*", "&", "~", "::"))
        if in_class or typed and lang != "ts":
            name, opening = t.text, k + 1
    if name is None or opening is None:
        return None
    closing = matching(ts, opening)
    j = closing + 1
    while j < len(ts) and ts[j].text not in ("{", ";", "}", "=>", "=") and j < closing + 40:
        if ts[j].text == "(" :
            j = matching(ts, j)
        j += 1
    if j >= len(ts) or ts[j].text in (";", "}"):
        return None
    if ts[j].text in ("=>", "="):
        if ts[j].text == "=" and lang != "kt":
            return None
        if j + 1 < len(ts) and ts[j + 1].text == "{":
            return name, opening, closing, j + 1, matching(ts, j + 1)
        end, depth = j + 1, 0
        while end < len(ts):
            if ts[end].kind == "o":
                depth += (ts[end].text in "([{") - (ts[end].text in ")]}")
            if depth < 0:
                return name, opening, closing, j + 1, end - 1
            last = end + 1 >= len(ts)
            if not depth and (last or ts[end].text == ";" or lang == "kt" and ts[end + 1].line > ts[end].line):
                break
            end += 1
        return name, opening, closing, j + 1, min(end, len(ts) - 1)
    return name, opening, closing, j, matching(ts, j)


def _vue_lines(text: str) -> list[str]:
    """The script blocks with every other line blank, so that line numbers stay."""
    out, inside = [], False
    for line in text.split("\n"):
        if not inside and re.match(r"\s*<script\b[^>]*>", line):
            inside = "</script>" not in line
            out.append("")
        elif inside and "</script>" in line:
            inside = False
            out.append("")
        else:
            out.append(line if inside else "")
    return out


def _ruby(text: str) -> dict:
    """Ruby by lines: def, class and module with their ends; a bare private or protected hides the methods after it."""
    functions, symbols, exports, sites = [], [], [], []
    stack: list[dict] = []
    hidden = [False]
    prof = Profile(hash_comment=True)
    rows = text.split("\n")
    for n, row in enumerate(rows, 1):
        line = re.sub(r"#(?!\{).*$", "", row).strip()
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)", line):
            symbols.append((m[2], m[1], n, None, True))
            stack.append({"kind": m[1], "name": m[2], "line": n, "symbol": len(symbols) - 1})
            hidden.append(False)
            exports.append((m[2], "class" if m[1] == "class" else "type", 0, 0))
        elif m := re.match(r"def\s+(?:self\.)?([\w?!=]+)\s*(?:\(([^)]*)\))?", line):
            stack.append({"kind": "def", "name": m[1], "line": n, "params": [x.strip() for x in (m[2] or "").split(",") if x.strip()], "hidden": hidden[-1], "type": next((x["name"] for x in reversed(stack) if x["kind"] == "class"), None)})
            if re.search(r"\bend\s*$", line) and len(line.split()) > 2:
                stack.append({"kind": "one-line"})
        elif line in ("private", "protected", "public"):
            hidden[-1] = line != "public"
        elif re.match(r"(if|unless|while|until|case|begin|for)\b", line) or re.search(r"\bdo(\s*\|[^|]*\|)?$", line):
            if not re.search(r"\bend$", line):
                stack.append({"kind": "block"})
        if stack and (re.match(r"end\b", line) or stack[-1]["kind"] == "one-line"):
            x = stack.pop()
            if x["kind"] == "one-line":
                x = stack.pop()
            if x["kind"] in ("class", "module"):
                hidden.pop()
                s = symbols[x["symbol"]]
                symbols[x["symbol"]] = (*s[:3], n, s[4])
            elif x["kind"] == "def":
                inner = tokens("\n".join(rows[x["line"] : n - 1]) or rows[x["line"] - 1], prof)
                for t in inner:
                    t.line += x["line"]
                norm, literals = shape(inner)
                called = calls_of(inner)
                names = [re.split(r"[=:]", q)[0].strip("*& ") for q in x["params"]]
                functions.append({"name": x["name"], "start_line": x["line"], "end_line": n, "decl_line": x["line"], "exported": not x["hidden"], "param_count": len(names), "param_names": names, "required_params": sum("=" not in q and not q.endswith(":") for q in x["params"]), "body_hash": fnv(norm), "body_tokens": len(norm), "literal_hash": fnv(literals), "def_hash": fnv([x["name"], *(t.text for t in inner)]), "calls": sorted({c for c, _, mm in called if not mm}), "member_calls": sorted({c for c, _, mm in called if mm}), "enclosing_type": x["type"], "type_refs": None, "ngram_sketch": sketch(norm)})
                sites += [(x["name"], *c, False) for c in called]
                if not x["type"]:
                    symbols.append((x["name"], "function", x["line"], n, not x["hidden"]))
                    exports.append((x["name"], "function", len(names), len(names)))
    return {"functions": functions, "symbols": [(a, b, c, d or len(rows), e) for a, b, c, d, e in symbols], "exports": exports, "imports": _imports(text, "rb"), "call_sites": sites, "is_index": False}
