"""Rules that name a flow by its source and sink, and rules that suppress flows.

A rule has four lists (source and sink capabilities, source and sink types); each list that isn't empty must have a member that fits: equal for capabilities, by glob for types. Rules are matched against the distinct pairs of source and sink, of which there are few, and the pairs are joined back to the flows, so the theta join never sees the flows themselves."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_match
from .classify import classify

SCHEMA = "ord int, suppress boolean, rule_id string, description string, flow_type string, source_caps array<string>, sink_caps array<string>, source_types array<string>, sink_types array<string>"
_FIELDS = (("sourceCapability", "source_caps"), ("sinkCapability", "sink_caps"), ("sourceType", "source_types"), ("sinkType", "sink_types"))


def _list(x) -> list[str]:
    return [] if x is None else list(x) if isinstance(x, list | tuple) else [x]


def violations(rule_set: dict) -> list[str]:
    """What is wrong with a rule set; empty if nothing is."""
    out = [] if rule_set.get("version") == 1 else ["version must be 1"]
    if not isinstance(rule_set.get("rules"), list):
        return [*out, "rules must be a list"]
    for kind in ("rules", "suppress"):
        for k, r in enumerate(rule_set.get(kind) or []):
            match = r.get("match")
            filled = isinstance(match, dict) and any(_list(match.get(f)) for f, _ in _FIELDS)
            if not r.get("id"):
                out.append(f"{kind}[{k}] has no id")
            if kind == "rules" and not r.get("flowType"):
                out.append(f"{kind}[{k}] has no flowType")
            if kind == "rules" and not filled:
                out.append(f"{kind}[{k}] has no matcher")
            if kind == "suppress" and not filled and not r.get("flowType"):
                out.append(f"{kind}[{k}] has neither a matcher nor a flowType")
    return out


def invalid(sets: DataFrame, key: str, text: str) -> DataFrame:
    """(key, violation): what is wrong with rule sets that are rows of JSON text; text that isn't a rule set is one violation."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_violations_of)

    return sets.select(key, F.explode(found(F.col(text))).alias("violation"))


def _violations_of(text: str | None) -> list[str]:
    try:
        rule_set = json.loads(text or "")
    except ValueError:
        return ["not JSON"]
    return violations(rule_set) if isinstance(rule_set, dict) else ["not a rule set"]


def rule_rows(rule_sets: Iterable[dict]) -> list[tuple]:
    """Rows of SCHEMA, later sets after earlier ones. Raises on an invalid set."""
    rows: list[tuple] = []
    for s in rule_sets:
        if found := violations(s):
            raise ValueError("; ".join(found))
        for kind in ("rules", "suppress"):
            for r in s.get(kind) or []:
                match = r.get("match") or {}
                rows.append((len(rows), kind == "suppress", r["id"], r.get("description"), r.get("flowType"), *(_list(match.get(f)) for f, _ in _FIELDS)))
    return rows


def rules_frame(spark: SparkSession, rule_sets: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame(rule_rows(rule_sets), SCHEMA)


def load(spark: SparkSession, path: str) -> list[dict]:
    """The rule sets of a path's JSON files, in order of their names; an empty file is an empty set. Rule files are settings, so they are read whole; code isn't run from them."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy("file").collect()
    return [json.loads(r["value"]) if r["value"].strip() else {"version": 1, "rules": []} for r in files]


#: The default rules, as capability pairs and the flow they make.
DEFAULT_PAIRS = """
ATTACKER_INPUT PRIVILEGED_OPERATION PRIVILEGE_ESCALATION
ATTACKER_INPUT NETWORK_SEND REQUEST_FORGERY
ATTACKER_INPUT STORAGE_WRITE STORAGE_POSOING
ATTACKER_INPUT CODE_EXECUTION CODE_INJECTION
NETWORK_RESPONSE CODE_EXECUTION CODE_INJECTION
WEB_CONTENT CODE_EXECUTION CODE_INJECTION
WEB_CONTENT STORAGE_WRITE STORAGE_POSOING
WEB_CONTENT NETWORK_SEND DATA_LEAK
WEB_CONTENT DOM_WRITE DOM_XSS
WEB_CONTENT PRIVILEGED_OPERATION PRIVILEGE_ESCALATION
SENSITIVE_DATA NETWORK_SEND DATA_LEAK
SYSTEM_INFO NETWORK_SEND DATA_LEAK
SENSITIVE_DATA MESSAGE_RESPONSE DATA_LEAK
SYSTEM_INFO MESSAGE_RESPONSE DATA_LEAK
""".split("\n")[1:-1]


def default_rules() -> dict:
    rules = []
    for line in DEFAULT_PAIRS:
        source, sink, flow = line.split()
        rules.append({"id": f"{source}-{sink}".lower().replace("_", "-"), "flowType": flow, "match": {"sourceCapability": source, "sinkCapability": sink}})
    hidden = [
        {"id": "fingerprint", "flowType": "DATA_LEAK", "match": {"sourceType": ["NAVIGATOR_*", "SCREEN_INFO"]}},
        {"id": "headers", "match": {"sourceCapability": ["SENSITIVE_DATA", "SYSTEM_INFO"], "sinkType": ["FETCH_HEADERS", "AXIOS_HEADERS", "XML_HTTP_REQUEST_SETHEADER"]}},
        {"id": "native-sources", "match": {"sourceType": ["*NATIVE*"]}},
        {"id": "native-sinks", "match": {"sinkType": ["*NATIVE*"]}},
        {"id": "window-echo", "match": {"sourceType": "WINDOW_MESSAGE_EVENT", "sinkType": "WINDOW_POSTMESSAGE"}},
    ]
    return {"version": 1, "rules": rules, "suppress": hidden}


def rule_counts(rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rules and suppressions there are: (by..., kind, n)."""
    return rules.groupBy(*(by or []), F.when(F.col("suppress"), "suppress").otherwise("rules").alias("kind")).agg(F.count("*").cast("int").alias("n"))


def _fits(values: str, one: str, by_glob: bool):
    test = (lambda p: glob_match(F.col(one), p)) if by_glob else (lambda p: p == F.col(one))
    return (F.size(values) == 0) | F.exists(values, test)


def _matcher():
    return _fits("source_caps", "source_cap", False) & _fits("sink_caps", "sink_cap", False) & _fits("source_types", "source_type", True) & _fits("sink_types", "sink_type", True)


def match_pairs(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """pairs (source_type, sink_type, source_cap, sink_cap) -> the same with ord, rule_id, description and flow_type of every rule that holds and isn't suppressed; a flow type and rule once for each pair."""
    wide = F.broadcast(rules.filter("not suppress"))
    found = pairs.join(wide, _matcher()).select(*pairs.columns, "ord", "rule_id", "description", "flow_type")
    off = F.broadcast(rules.filter("suppress").select(F.col("flow_type").alias("off_type"), "source_caps", "sink_caps", "source_types", "sink_types"))
    kept = found.join(off, (F.col("off_type").isNull() | (F.col("off_type") == F.col("flow_type"))) & _matcher(), "left_anti")
    first = kept.groupBy(*pairs.columns, "rule_id", "flow_type").agg(F.min(F.struct("ord", "description")).alias("r"))
    return first.select(*pairs.columns, "r.ord", "rule_id", "r.description", "flow_type")


def match_flows(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """flows with source_type and sink_type -> a row for each rule that names them; others are dropped."""
    pairs = classify(flows.select("source_type", "sink_type").distinct())
    named = match_pairs(pairs, rules)
    return flows.join(F.broadcast(named), ["source_type", "sink_type"])


def first_match(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The flow type of the first rule for each key."""
    return matched.groupBy(*keys).agg(F.min_by("flow_type", "ord").alias("flow_type"))
