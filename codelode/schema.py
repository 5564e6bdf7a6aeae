"""The canonical tables: one schema for every source. Absent is NULL, none is an empty array; they are never merged."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_T = {"s": StringType(), "i": IntegerType(), "l": LongType(), "b": BooleanType(), "as": ArrayType(StringType()), "al": ArrayType(LongType()), "t": TimestampType()}


def _table(**columns: str) -> StructType:
    return StructType([StructField(k, _T[v], True) for k, v in columns.items()])


FILES_RAW = _table(path="s", module="s", lang="s", is_test="b", size="l", mtime="t", content="s", file_ord="l")
FILES = _table(path="s", module="s", lang="s", is_test="b", is_index="b", code_lines="i", total_lines="i", internal_functions="i", comment_tokens="as", file_ord="l")
FUNCTIONS = _table(path="s", module="s", name="s", fn_ord="i", start_line="i", end_line="i", decl_line="i", exported="b", param_count="i", param_names="as", required_params="i", body_hash="l", body_tokens="i", literal_hash="l", def_hash="l", calls="as", member_calls="as", enclosing_type="s", type_refs="as", ngram_sketch="al")
SYMBOLS = _table(path="s", module="s", name="s", kind="s", start_line="i", end_line="i", exported="b")
EXPORTS = _table(path="s", module="s", is_test="b", name="s", kind="s", required_params="i", total_params="i")
IMPORTS = _table(from_file="s", from_module="s", from_is_test="b", seq="i", line="i", specifier="s", named="as", is_type_only="b")
CALL_SITES = _table(path="s", fn="s", name="s", line="i", member="b", is_field="b")
TYPED_CALLS = _table(path="s", fn="s", method="s", type="s")
SKIPPED = _table(path="s", reason="s")
COMMITS = _table(commit_id="l", author="s", ts="t", files="as")
FILE_STATE = _table(path="s", size="l", mtime="t", content_hash="s", parser_version="s", generation="l")
TELEMETRY = _table(ts="t", tool="s", args_hash="s", ms="l", chars="l", tokens="l", ok="b")
TABLES = {"files": FILES, "functions": FUNCTIONS, "symbols": SYMBOLS, "exports": EXPORTS, "imports": IMPORTS, "call_sites": CALL_SITES, "typed_calls": TYPED_CALLS, "skipped": SKIPPED}
