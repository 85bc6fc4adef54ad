"""The ordered pair checks over (source, target) texts, as statements with one boolean each.

A check is a registry entry, so an engine can run all of them in one pass (``all_checks``) or one by one.
"""

from __future__ import annotations

from corpusweave.plans.sql import Statement


def _lit(pattern: str, spark: bool) -> str:
    """A string literal; Spark's reads backslashes as escapes, DuckDB's as they are."""
    return "'" + (pattern.replace("\\", "\\\\").replace("'", "\\'") if spark else pattern.replace("'", "''")) + "'"


def _count(column: str, pattern: str, spark: bool) -> str:
    return f"regexp_count({column}, {_lit(pattern, True)})" if spark else f"len(regexp_extract_all({column}, {_lit(pattern, False)}))"


def _has(column: str, pattern: str, spark: bool) -> str:
    return f"regexp_like({column}, {_lit(pattern, True)})" if spark else f"regexp_matches({column}, {_lit(pattern, False)})"


def _keys(column: str, pattern: str, spark: bool) -> str:
    return f"array_join(array_sort(regexp_extract_all({column}, {_lit(pattern, True)}, 1)), ',')" if spark else f"array_to_string(list_sort(regexp_extract_all({column}, {_lit(pattern, False)}, 1)), ',')"


def _differs(pattern: str):
    return lambda s: f"{_count('src', pattern, s)} <> {_count('tgt', pattern, s)}"


#: name -> condition under which the check reports an issue, for Spark (True) or DuckDB (False)
CHECKS = {
    "placeholder": lambda s: f"{_keys('src', r'(\[\[[A-Z]+_[0-9]+\]\])', s)} <> {_keys('tgt', r'(\[\[[A-Z]+_[0-9]+\]\])', s)}",
    "brace": lambda s: f"{_count('tgt', r'[{]', s)} <> {_count('tgt', r'[}]', s)} OR {_count('src', r'[{]', s)} <> {_count('tgt', r'[{]', s)}",
    "environment": lambda s: f"{_keys('src', r'\\(?:begin|end)[{]([a-z*]+)[}]', s)} <> {_keys('tgt', r'\\(?:begin|end)[{]([a-z*]+)[}]', s)}",
    "key": lambda s: f"{_keys('src', r'\\(?:ref|cite|label)[{]([^}]*)[}]', s)} <> {_keys('tgt', r'\\(?:ref|cite|label)[{]([^}]*)[}]', s)}",
    "math": _differs(r"[$]"),
    "same_source": lambda _: "length(src) >= 20 AND lower(trim(src)) = lower(trim(tgt))",
    "length": lambda s: f"{_count('src', r'[^ ]+', s)} >= 10 AND (length(tgt) < 3e-1 * length(src) OR length(tgt) > CASE WHEN {_count('src', ',', s)} * 2 >= {_count('src', r'[^ ]+', s)} THEN 4e0 ELSE 3e0 END * length(src))",
    "residual": lambda s: _has("tgt", r"(?:[a-z]+[*#$%&]{3} ){4}", s),
    "macro": _differs(r"\\(?:new|renew|provide)command|\\def"),
    "item_glue": lambda s: f"{_has('tgt', r'\\item[A-Za-z]', s)} AND NOT {_has('src', r'\\item[A-Za-z]', s)}",
    "token_in_command": lambda s: _has("tgt", r"\\[A-Za-z]*\[\[[A-Z]+_", s),
    "bare_command": _differs(r"\\[A-Za-z]+"),
    "dangerous_command": lambda s: f"{_has('tgt', r'\\(?:input|include|write18|openout|read)', s)} AND NOT {_has('src', r'\\(?:input|include|write18|openout|read)', s)}",
    "protocol_echo": lambda s: _has("tgt", r"```|<<<|\[\[SEG", s),
    "trailing_comment": lambda s: _has("tgt", r"(?:^|[^\\])%[^\n]*$", s),
}

STATEMENTS = {f"val_{name}": Statement(f"SELECT conv_id, turn, {issue(True)} AS issue FROM pairs", f"SELECT conv_id, turn, {issue(False)} AS issue FROM pairs") for name, issue in CHECKS.items()}
STATEMENTS["val_all"] = Statement(
    "SELECT conv_id, turn, " + " + ".join(f"CASE WHEN {issue(True)} THEN 1 ELSE 0 END" for issue in CHECKS.values()) + " AS issues FROM pairs",
    "SELECT conv_id, turn, " + " + ".join(f"CASE WHEN {issue(False)} THEN 1 ELSE 0 END" for issue in CHECKS.values()) + " AS issues FROM pairs",
)
