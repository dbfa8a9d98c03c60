"""HTML helpers as column expressions: tags, attributes, text, entities."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments, scripts and styles hold no fields; a marker keeps the texts around them apart.
NOISE = r"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>"
ATTRIBUTE = r"""([^\s/>=][^\s/=>]*)(?:\s*=+\s*(?:"([^"]*)"|'([^']*)'|([^>\s"'][^>\s]*)?))?"""
ANY_TAG = r"<[^>]*>"
EDGE_SPACE = r"(?U)^\s+|\s+$"

# The named entities that the given pages use, for their SQL; the ampersand comes last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ", "&uuml;": "ü",
    "&Aacute;": "Á", "&Eacute;": "É", "&Iacute;": "Í", "&Oacute;": "Ó", "&Uacute;": "Ú", "&Ntilde;": "Ñ", "&Uuml;": "Ü",
    "&iexcl;": "¡", "&iquest;": "¿", "&euro;": "€", "&copy;": "©", "&middot;": "·", "&amp;": "&",
}

REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# The named references of HTML 4, as the standard library lists them, and the apostrophe.
NAMED = "map('apos', chr(39), " + ", ".join(f"'{n}', decode(unhex('{c:08x}'), 'UTF-32')" for n, c in name2codepoint.items()) + ")"


def tag_pattern(name: str) -> str:
    """Opening tag of an element; ``>`` inside quoted attribute values does not end it."""
    return rf"""(?i)<{name}(?:[\s/][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?>"""


def block_pattern(name: str) -> str:
    """Element with its content; an unclosed one runs to the end."""
    return rf"""(?is)<{name}(?:[\s/][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?>.*?(?:</{name}\s*>|\z)"""


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, "<!>")


def strip(text: Column) -> Column:
    """Python's strip: every kind of white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def _character(code: Column) -> Column:
    return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _referenced(m: Column) -> Column:
    """What one reference stands for; an unknown one stays as it is."""
    inner = F.substring(m, F.lit(2), F.length(m) - 2)
    number = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).when(F.startswith(inner, F.lit("#")), F.substring(inner, F.lit(2), F.length(inner)))
    return F.coalesce(_character(number.try_cast("bigint")), F.try_element_at(F.expr(NAMED), inner), m)


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal references, each decoded once, in one pass over the text."""
    bound = F.transform(F.array(text), lambda t: F.struct(F.split(t, REFERENCE, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)).alias("refs")))
    joined = F.transform(bound, lambda c: F.array_join(F.transform(c["gaps"], lambda g, i: F.concat(g, F.coalesce(_referenced(F.get(c["refs"], i)), F.lit("")))), ""))[0]
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def inner_text(html: Column) -> Column:
    """Text of an element: every run between tags stripped, then joined."""
    return F.array_join(F.transform(F.split(html, ANY_TAG, -1), lambda run: strip(unescape(run))), "")


def attribute_parts(tag: Column) -> list[Column]:
    """Names and the three ways to write values, by position; zip them with ``attributes``."""
    return [F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(g)).alias(f"p{g}") for g in (1, 2, 3, 4)]


def attributes(parts: Column) -> Column:
    """Array of (name, value) from a struct of ``attribute_parts``; a bare attribute has an empty value."""
    return F.transform(
        parts["p1"],
        lambda n, i: F.struct(
            F.lower(n).alias("name"),
            unescape(F.concat(F.get(parts["p2"], i), F.get(parts["p3"], i), F.get(parts["p4"], i))).alias("value"),
        ),
    )


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, null when absent; of repeated ones the last counts."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def attribute_of(tag: Column, name: str) -> Column:
    """One attribute straight from a tag text."""
    parts = F.transform(F.array(tag), lambda t: F.struct(*attribute_parts(t)))
    attrs = F.transform(parts, attributes)
    return attribute(F.element_at(attrs, 1), name)
