"""Oracle SQL for detection and masking, written for DuckDB.

DuckDB's word boundary is ASCII, so patterns run on a copy of the text in which
every other letter is ``_`` (a word character of the same length) and values are
cut from the original by position. For tax ids ``ñ`` becomes ``N``; for house
numbers the ``ú`` of ``Núm`` is that ``_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from veladura.functions.rules import KEYWORDS, RULES, Rule
from veladura.plans.inputs import CORPUS_SQL


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OTHER_LETTER = text(r"[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F]")


def _raw(rule: Rule, rank: int) -> str:
    column, pattern = "norm", rule.pattern
    if rule.type == "rfc":
        column, pattern = "norm_rfc", pattern.replace("Ñ", "N")
    pattern = pattern.replace("Núm", "N_m").replace("años", "a_os").replace("año", "a_o")
    flag = ", 'i'" if rule.ignore_case else ""
    return (
        f"SELECT kind, id, text, {rank} AS rank, {text(rule.type)} AS type, {rule.confidence}::DOUBLE AS base, "
        f"regexp_extract_all({column}, {text(pattern)}, 0{flag}) AS m, regexp_split_to_array({column}, {text(pattern)}{flag}) AS g "
        f"FROM norms WHERE regexp_matches({column}, {text(pattern)}{flag})"
    )


def _confidence() -> str:
    branches = []
    for kind, words in KEYWORDS.items():
        value = "base"
        for word in words:
            value = f"least({value} + CASE WHEN contains(lower(context), {text(word)}) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 0.99::DOUBLE)"
        branches.append(f"WHEN type = '{kind}' THEN {value}")
    raised = f"CASE {' '.join(branches)} ELSE base END"
    penalty = (
        "CASE WHEN type = 'rfc' AND length(value) NOT IN (12, 13) THEN 0.7::DOUBLE "
        "WHEN type = 'curp' AND length(value) <> 18 THEN 0.7::DOUBLE "
        "WHEN type = 'email' AND NOT (contains(value, '@') AND contains(split_part(value, '@', -1), '.')) THEN 0.5::DOUBLE "
        "ELSE 1.0::DOUBLE END"
    )
    return f"least({raised} * {penalty}, 0.99::DOUBLE)"


def scored(source: str = CORPUS_SQL, rules: Sequence[Rule] = RULES, min_confidence: float = 0.6) -> str:
    """CTEs up to ``scored``: every hit above the threshold, overlaps included. ``source`` gives (kind, id, text)."""
    raw = " UNION ALL ".join(_raw(r, i) for i, r in enumerate(rules))
    return f"""texts AS ({source}),
norms AS (SELECT kind, id, text, regexp_replace(text, {OTHER_LETTER}, '_', 'g') AS norm,
  regexp_replace(replace(replace(text, 'ñ', 'n'), 'Ñ', 'N'), {OTHER_LETTER}, '_', 'g') AS norm_rfc FROM texts),
raw AS ({raw}),
placed AS (SELECT kind, id, text, rank, type, base, length(m[i])::INT AS size,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
valued AS (SELECT kind, id, text, rank, type, base, start, start + size AS stop, substr(text, start + 1, size) AS value,
  substr(text, greatest(start - 30, 0) + 1, start + size + 30 - greatest(start - 30, 0)) AS context FROM placed),
scored AS (SELECT * FROM (SELECT *, {_confidence()} AS confidence FROM valued) WHERE confidence >= {min_confidence}::DOUBLE)"""


def kept(source: str = CORPUS_SQL, rules: Sequence[Rule] = RULES, min_confidence: float = 0.6) -> str:
    """CTEs up to ``hits``: overlap-free hits with their position ``hit_ix`` in the text."""
    return f"""{scored(source, rules, min_confidence)},
listed AS (SELECT kind, id, any_value(text) AS text,
  list({{'start': start, 'stop': stop, 'type': type, 'value': value, 'context': context, 'confidence': confidence}} ORDER BY start, -confidence, rank) AS hs
  FROM scored GROUP BY kind, id),
folded AS (SELECT kind, id, text, list_reduce(hs, lambda acc, h:
  CASE WHEN len(acc) = 0 OR h.start >= acc[-1].stop THEN list_append(acc, h)
       WHEN h.confidence > acc[-1].confidence THEN list_append(acc[1:len(acc) - 1], h) ELSE acc END, []) AS hs FROM listed),
hits AS (SELECT kind, id, text, (i - 1)::INT AS hit_ix, hs[i].type AS type, hs[i].value AS value, hs[i].start AS start,
  hs[i].stop AS stop, hs[i].context AS context, hs[i].confidence AS confidence
  FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM folded))"""
