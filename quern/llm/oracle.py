"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

import string

_LOWER = "translate({0}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _mixing(temper: float = 0.9, rounds: int = 10, seed: str = "mix") -> str:
    dims = ("source", "lang", "topic")
    out = [
        """keyed AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE WHEN contains(coalesce(text, ''), '|') THEN 'tabular' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'numeric'
       WHEN length(coalesce(text, '')) >= 8000 THEN 'long' ELSE 'plain' END AS topic,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM keyed GROUP BY ALL)",
        *(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) AS s FROM cells GROUP BY {d})" for d in dims),
        "w0 AS (SELECT source, lang, topic, tokens, tokens AS w, " + ", ".join(f"t_{d}.s / (SELECT sum(s) FROM t_{d}) AS s_{d}" for d in dims) + " FROM cells " + " ".join(f"JOIN t_{d} USING ({d})" for d in dims) + ")",
    ]
    k = 0
    for _ in range(rounds):
        for d in dims:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * s_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0) AS w) FROM w{k})")
            k += 1
    out.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens = 0 OR max(CASE WHEN tokens > 0 THEN w / tokens END) OVER () = 0 THEN 1.0 ELSE round(w / tokens / max(CASE WHEN tokens > 0 THEN w / tokens END) OVER (), 9) END AS probability FROM w{k})")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, probability,
  CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '(null)'), '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0 < probability AS kept
FROM keyed JOIN p USING (source, lang, topic)"""


SQL: dict[str, str] = {"op9_decontam": OP9, "op10_mixing": _mixing()}
