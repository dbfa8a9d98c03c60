"""Detection rules: pattern, base confidence and context keywords per type."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    type: str
    pattern: str
    confidence: float
    ignore_case: bool = False
    # What every hit must contain; texts without it skip the pattern (see GATES).
    gate: str = "any"


# The patterns and base confidences, in the order in which ties are settled.
RULES: list[Rule] = [
    Rule("rfc", r"\b[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}\b", 0.95, True, "digits6"),
    Rule("curp", r"\b[A-Z]{4}[0-9]{6}[A-Z]{6}[0-9]{2}\b", 0.95, True, "digits6"),
    Rule("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0.98, False, "at"),
    Rule("telefono", r"\b(?:\d{2}\s?)?\d{4}[-.\s]?\d{4}\b|\b\d{10}\b", 0.85, False, "digits4"),
    Rule(
        "telefono_movil",
        r"\b(?:55|56|33|81|44|66|99|77|22|55)[-.\s]?\d{4}[-.\s]?\d{4}\b|\b1\d{9}\b", 0.90, False, "digits4",
    ),
    Rule("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.90, False, "dotted"),
    Rule("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 0.95, False, "pair_sign"),
    Rule("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", 0.98, True, "dash"),
    Rule("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", 0.85, False, "digits4"),
    Rule("nss", r"\b\d{2,4}\d{2}\d{2}\d{3}\d{1}\b|\b\d{11}\b", 0.80, False, "digits10"),
    Rule("placa_auto", r"\b[A-Z]{3}[ -]?\d{3}\b|\b\d{3}[ -]?[A-Z]{3}\b", 0.75, True, "digits3"),
    Rule("codigo_postal", r"\b[0-9]{5}\b", 0.70, False, "digits5"),
    Rule(
        "fecha_nacimiento",
        r"\b(?:0[1-9]|[12][0-9]|3[01])[-/](?:0[1-9]|1[0-2])[-/](?:19|20)[0-9]{2}\b", 0.80, False, "year",
    ),
    Rule("numero_exterior", r"\b(?:No\.?|Núm\.?|#)\s*[0-9]+\b", 0.65, True, "number"),
]

# Rules that exist but are off unless asked for, with the confidence of a custom rule.
OPTIONAL_RULES: list[Rule] = [
    Rule("edad", r"(?:edad|años?):\s*([0-9]{1,3})", 0.90, True),
    Rule(
        "coordenada",
        r"\b[-+]?(?:[0-8]?\d(?:\.\d+)?|90(?:\.0+)?)[°\s]?[-+]?(?:[0-9]?\d(?:\.\d+)?|180(?:\.0+)?)\b", 0.90,
    ),
]

# Words near a hit that raise its confidence.
KEYWORDS: dict[str, list[str]] = {
    "rfc": ["rfc", "registro federal", "contribuyente"],
    "curp": ["curp", "registro poblacion", "clave unica"],
    "email": ["email", "correo", "mail"],
    "telefono": ["tel", "telefono", "cel", "movil"],
}

# Fixed values of the confidence arithmetic.
CUSTOM_CONFIDENCE = 0.90
MIN_CONFIDENCE = 0.6
KEYWORD_BONUS = 0.05
MAX_CONFIDENCE = 0.99
LENGTH_PENALTY = 0.7
SHAPE_PENALTY = 0.5
CONTEXT_CHARS = 30

# Types behind the three censoring levels; the highest level is every rule.
LEVELS: dict[str, list[str] | None] = {
    "bajo": ["email", "telefono", "telefono_movil"],
    "medio": ["email", "telefono", "telefono_movil", "rfc", "curp", "ip_address"],
    "alto": None,
}

# What the gates read: the text, its shape (digits as 0; null when it has no digit), and
# whether it has decimal digits other than 0-9, which some patterns accept.
HAS_DIGIT = r"(?U)\d"
OTHER_DIGIT = r"[^\P{Nd}0-9]"
DIGIT_SHAPE = ("123456789", "000000000")


def _any(text: Column, *pieces: str) -> Column:
    found = F.contains(text, F.lit(pieces[0]))
    for piece in pieces[1:]:
        found = found | F.contains(text, F.lit(piece))
    return found


# Cheap conditions a hit implies; where one fails its patterns are skipped without losing a hit.
GATES = {
    "digits3": lambda text, shape, other: _any(shape, "000") | other,
    "digits4": lambda text, shape, other: _any(shape, "0000") | other,
    "digits5": lambda text, shape, other: _any(shape, "00000"),
    "digits6": lambda text, shape, other: _any(shape, "000000"),
    "digits10": lambda text, shape, other: _any(shape, "0000000000") | other,
    "dotted": lambda text, shape, other: _any(shape, "0.0"),
    "year": lambda text, shape, other: _any(shape, "/0000", "-0000"),
    "number": lambda text, shape, other: shape.isNotNull() & _any(text, "#", "No", "no", "NO", "nO", "úm", "Úm", "úM", "ÚM"),
    "at": lambda text, shape, other: _any(text, "@"),
    "dash": lambda text, shape, other: _any(text, "-"),
    "pair_sign": lambda text, shape, other: _any(text, "-", ":"),
}
SHAPE_GATES = {"digits3", "digits4", "digits5", "digits6", "digits10", "dotted", "year", "number"}


def select_rules(
    types: Iterable[str] | None = None,
    custom: Mapping[str, str] | None = None,
    optional: Iterable[str] = (),
) -> list[Rule]:
    """Rules for the wanted types, then optional ones, then user patterns (pattern -> type).

    Cut at plan time: an unwanted pattern never becomes part of the query.
    """
    wanted = None if types is None else set(types)
    for kind in (custom or {}).values():
        if not re.fullmatch(r"\w+", kind):
            raise ValueError(f"a type is a plain word, got {kind!r}")
    rules = [r for r in RULES if wanted is None or r.type in wanted]
    rules += [r for r in OPTIONAL_RULES if r.type in set(optional)]
    for pattern, kind in (custom or {}).items():
        check_pattern(pattern)
        if wanted is None or kind in wanted:
            rules.append(Rule(kind, pattern, CUSTOM_CONFIDENCE))
    if not rules:
        raise ValueError("no detection rule left")
    return rules


def check_pattern(pattern: str) -> None:
    """Custom patterns must compile and must not match the empty text (positions rely on it)."""
    if re.search(pattern, "") is not None:
        raise ValueError(f"pattern can match the empty text: {pattern!r}")


def java_pattern(rule: Rule) -> str:
    """Unicode classes and word boundaries on every Java version, Unicode case folding where asked."""
    return ("(?iuU)" if rule.ignore_case else "(?U)") + rule.pattern


def confidence(kind: str, base: str, value: str, context: str) -> str:
    """SQL text: base confidence, raised per keyword in the context, lowered for a wrong shape."""
    branches = []
    for name, words in KEYWORDS.items():
        raised = base
        for word in words:
            # The sum is capped after each keyword and stays a double: decimals would tie differently.
            bonus = f"CASE WHEN contains(lower({context}), '{word}') THEN {KEYWORD_BONUS}D ELSE 0D END"
            raised = f"least({raised} + {bonus}, {MAX_CONFIDENCE}D)"
        branches.append(f"WHEN {kind} = '{name}' THEN {raised}")
    mail = f"contains({value}, '@') AND contains(substring_index({value}, '@', -1), '.')"
    penalty = (
        f"CASE WHEN {kind} = 'rfc' AND length({value}) NOT IN (12, 13) THEN {LENGTH_PENALTY}D "
        f"WHEN {kind} = 'curp' AND length({value}) <> 18 THEN {LENGTH_PENALTY}D "
        f"WHEN {kind} = 'email' AND NOT ({mail}) THEN {SHAPE_PENALTY}D ELSE 1D END"
    )
    return f"least((CASE {' '.join(branches)} ELSE {base} END) * {penalty}, {MAX_CONFIDENCE}D)"
