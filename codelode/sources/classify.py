"""What a path says about a file (S2, S3): language, module, test, code; for the driver and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions.text import glob_regex

#: Limits, folders that hold no source, code endings, test paths, endings of languages, scaffold roots, containers and groupers.
MAX_BYTES, MAX_FILES = 4 * 1024 * 1024, 60_000
SKIP_DIRS = frozenset("node_modules .git dist build out coverage .next .nuxt .turbo .cache vendor __pycache__ .venv venv __pypackages__ site-packages target bin obj .dart_tool .gradle .build Pods DerivedData".split())
CODE = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|go|java|rb|rs|php|c|h|cpp|cc|cxx|hpp|hh|hxx|cs|dart|kt|kts|swift|vue|cob|cbl|cpy)$"
TEST = r"(\.test\.|\.spec\.|__tests__|(^|/)tests?/|(^|/)test_|_test\.(py|go|dart|c|cc|cpp)$|_spec\.rb$|Test\.java$|Tests?\.cs$|Tests?\.swift$|Test\.kt$)"
LANGS = {"py": "py", "go": "go", "java": "java", "rb": "rb", "rs": "rs", "php": "php", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp", "cs": "cs", "dart": "dart", "kt": "kt", "kts": "kt", "swift": "swift", "vue": "vue", "cob": "cob", "cbl": "cob", "cpy": "cob"}
SCAFFOLDS = ["src/main/java", "src/main/kotlin", "src/main/scala", "src/main/groovy", "src/test/java", "src/test/kotlin", "src/test/scala", "src/test/groovy", "src/androidTest/java", "src/androidTest/kotlin"]
CONTAINERS, GROUPERS = ["src", "lib", "packages", "apps"], ["services", "modules", "features", "domains"]


def is_code(path: str) -> bool:
    return bool(re.search(CODE, path)) and not path.endswith(".d.ts")


def is_test(path: str) -> bool:
    return bool(re.search(TEST, path))


def language(path: str) -> str:
    return LANGS.get(path.rsplit(".", 1)[-1], "ts")


def module_of(path: str) -> str:
    """The package below a build root, with the prefix before it; else the first folder below containers, two below a grouper."""
    for root in SCAFFOLDS:
        at = path.rfind(f"{root}/")
        if at >= 0:
            package = path[at + len(root) + 1 :].rpartition("/")[0]
            return "/".join(x for x in (path[:at].rstrip("/"), package) if x) or "(root)"
    *dirs, _ = path.split("/")
    while dirs and dirs[0] in CONTAINERS:
        dirs.pop(0)
    if not dirs:
        return "(root)"
    return "/".join(dirs[:2]) if len(dirs) > 1 and dirs[0] in GROUPERS else dirs[0]


def ignored(path: str, globs: list[str]) -> bool:
    return any(re.match(glob_regex(g), path) for g in globs)


def language_column(path: Column) -> Column:
    ending = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.lit("ts"))


def module_column(path: Column) -> Column:
    """``module_of`` as built-in expressions."""
    out = None
    for root in SCAFFOLDS:
        hit = F.concat(F.lit("/"), path).rlike(f"/{root}/") | path.contains(f"{root}/")
        prefix, rest = F.regexp_extract(path, f"^(.*){root}/", 1), F.regexp_extract(path, f"^.*{root}/(.*)$", 1)
        package = F.regexp_extract(rest, "^(.*)/[^/]*$", 1)
        joined = F.array_join(F.filter(F.array(F.regexp_replace(prefix, "/$", ""), package), lambda x: x != ""), "/")
        value = F.when(joined == "", "(root)").otherwise(joined)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    bare = F.regexp_replace(path, f"^(?:(?:{'|'.join(CONTAINERS)})/)+", "")
    parts = F.split(bare, "/")
    grouped = F.size(parts).__gt__(2) & F.get(parts, F.lit(0)).isin(*GROUPERS)
    plain = F.when(F.size(parts) == 1, "(root)").when(grouped, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    return out.otherwise(plain)


def is_test_column(path: Column) -> Column:
    return path.rlike(TEST)
