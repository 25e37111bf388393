"""Selectors over trees of nodes, as joins.

    Type, *                     by type
    [name="x"] [value=/re/]     by text (name, operator and value are the text), field, type, ord, start or stop; =, !=, <, >
    A B, A > B, A + B, A ~ B    descendant, child, next sibling, later sibling
    :is(..) :not(..) :has(..)   any of, none of, with such a descendant
    :nth-child(n)               the n-th of its field, from 1

nodes: (package, script, node, parent, field, ord, type, text, start, stop). Each step joins only the nodes that the step before has found, inside a script; a descendant is told by its place in the text and its number."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<attr>\[\s*(\w+)\s*(!=|=|<|>)\s*(?:\"([^\"]*)\"|'([^']*)'|/((?:[^/\\]|\\.)*)/|([^\]\s]+))\s*\])|(?P<pseudo>:(is|not|has|nth-child)\()|(?P<close>\))|(?P<comma>,)|(?P<type>\*|[A-Za-z]\w*))")
_KEY = ["package", "script", "node"]


def parse(text: str):
    """A list of alternatives; each is a list of (combinator, type, tests)."""
    out, end = _alternatives(text, 0)
    if text[end:].strip():
        raise ValueError(f"{text[end:]!r} can't be read")
    return out


def _alternatives(text: str, at: int):
    out = []
    while True:
        steps, at = _steps(text, at)
        out.append(steps)
        m = _TOKEN.match(text, at)
        if not (m and m["comma"]):
            return out, at
        at = m.end()


def _steps(text: str, at: int):
    steps, how = [], ""
    while True:
        kind, tests, begun = None, [], at
        while m := _TOKEN.match(text, at):
            if m["close"] or m["comma"] or (at > begun and text[at : at + 1].isspace()) or (m["type"] and at > begun):
                break
            if m["type"]:
                kind = None if m["type"] == "*" else m["type"]
                at = m.end()
            elif m["attr"]:
                value = next((x for x in m.group(4, 5, 7) if x is not None), None)
                tests.append(("attr", m[2], m[3], m[6], value))
                at = m.end()
            elif m[9] == "nth-child":
                close = text.index(")", m.end())
                tests.append(("nth", int(text[m.end() : close])))
                at = close + 1
            else:
                inner, end = _alternatives(text, m.end())
                m2 = _TOKEN.match(text, end)
                if not (m2 and m2["close"]):
                    raise ValueError(f"a bracket is open in {text!r}")
                tests.append((m[9], inner))
                at = m2.end()
        if at == begun:
            raise ValueError(f"nothing to select in {text[at:]!r}")
        steps.append((how, kind, tests))
        m = re.compile(r"\s*([>+~])\s*|\s+(?=[^\s),])").match(text, at)
        if not m:
            return steps, at
        how, at = (m[1] or " "), m.end()


_TEXTS = {"name": "text", "operator": "text", "value": "text"}


def _attribute(name: str, op: str, pattern: str | None, value: str | None) -> Column:
    c = F.col(_TEXTS.get(name, name))
    if pattern is not None:
        fits = c.rlike(pattern)
        return F.coalesce(~fits if op == "!=" else fits, F.lit(op == "!="))
    if op in "<>":
        n = c.try_cast("double")
        return F.coalesce(n < float(value) if op == "<" else n > float(value), F.lit(False))
    same = F.coalesce(c.cast("string") == value, F.lit(False))
    return ~same if op == "!=" else same


def _fits(nodes: DataFrame, rows: DataFrame, kind: str | None, tests: list) -> DataFrame:
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    for t in tests:
        if t[0] == "attr":
            rows = rows.filter(_attribute(*t[1:]))
        elif t[0] == "nth":
            rows = rows.filter(F.col("ord") == t[1] - 1)
        elif t[0] in ("is", "not"):
            rows = rows.join(_all(nodes, t[1]).select(*_KEY), _KEY, "left_semi" if t[0] == "is" else "left_anti")
        else:
            inner = _all(nodes, t[1]).select("package", "script", F.col("node").alias("n2"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
            held = rows.join(inner, ["package", "script"]).filter((F.col("n2") > F.col("node")) & (F.col("s2") >= F.col("start")) & (F.col("e2") <= F.col("stop"))).select(*_KEY).distinct()
            rows = rows.join(held, _KEY, "left_semi")
    return rows


def _all(nodes: DataFrame, alternatives: list) -> DataFrame:
    out = None
    for steps in alternatives:
        found = None
        for how, kind, tests in steps:
            rows = nodes
            if found is not None:
                b = found.select("package", "script", F.col("node").alias("b_node"), F.col("parent").alias("b_parent"), F.col("field").alias("b_field"), F.col("ord").alias("b_ord"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
                if how == ">":
                    rows = rows.join(b.select("package", "script", F.col("b_node").alias("parent")).distinct(), ["package", "script", "parent"], "left_semi")
                elif how == " ":
                    rows = rows.join(b, ["package", "script"]).filter((F.col("node") > F.col("b_node")) & (F.col("start") >= F.col("b_start")) & (F.col("stop") <= F.col("b_stop"))).select(*nodes.columns).distinct()
                else:
                    beside = b.select("package", "script", F.col("b_parent").alias("parent"), F.col("b_field").alias("field"), "b_ord")
                    ok = F.col("ord") == F.col("b_ord") + 1 if how == "+" else F.col("ord") > F.col("b_ord")
                    rows = rows.join(beside, ["package", "script", "parent", "field"]).filter(ok).select(*nodes.columns).distinct()
            found = _fits(nodes, rows, kind, tests)
        out = found if out is None else out.unionByName(found).distinct()
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that a selector names."""
    return _all(nodes, parse(selector)).select(*nodes.columns)
