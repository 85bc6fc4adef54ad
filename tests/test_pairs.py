"""Each pair check reports its own trap and leaves a clean pair alone."""

import pytest

from corpusweave.functions.pairs import CHECKS

CLEAN = ("See \\ref{a} and [[MATH_1]] in {x}.", "Siehe \\ref{a} und [[MATH_1]] in {x}.")
TRAPS = {
    "placeholder": ("a [[MATH_1]]", "a [[MATH_2]]"),
    "brace": ("{a}", "{a"),
    "environment": ("\\begin{it} x \\end{it}", "\\begin{it} x"),
    "key": ("\\cite{a}", "\\cite{b}"),
    "math": ("$x$", "$x"),
    "same_source": ("This one is never translated", "this one is never translated "),
    "length": ("one two three four five six seven eight nine ten eleven", "one"),
    "residual": ("x", "the*** and*** of*** it*** "),
    "macro": ("\\newcommand{a}", "a"),
    "item_glue": ("\\item a", "\\itema"),
    "token_in_command": ("x", "\\bf[[MATH_1]]"),
    "bare_command": ("\\alpha", "alpha"),
    "dangerous_command": ("x", "\\input{y}"),
    "protocol_echo": ("x", "```x"),
    "trailing_comment": ("x", "x % y"),
}


@pytest.mark.parametrize("name", CHECKS)
def test_check(name, spark):
    df = spark.createDataFrame([(0, *CLEAN), (1, *TRAPS[name])], "id int, src string, tgt string")
    got = {r["id"]: r["issue"] for r in df.selectExpr("id", f"{CHECKS[name](True)} AS issue").collect()}
    assert got == {0: False, 1: True}
