"""User dictionaries: a table or text file of names and provider texts over the base catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions.families import Provider
from veladura.operators.catalogue import as_provider, merge
from veladura.operators.jobs import LINE_BREAK
from veladura.sources.files import read_texts

# A catalogue becomes part of the plan, so it has to fit the driver; this is far above any real one.
MAX_ENTRIES = 20_000
ENTRY = r"""^\s*(["'])(.+?)\1\s*:\s*(.*?)\s*,?\s*(?:#[^"']*)?$"""


def read_dictionary_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, name, provider) of the ``"name": provider text,`` lines of dictionary files. A file is read as text and never run."""
    lines = read_texts(spark, path, "content").select("path", F.posexplode(F.split("content", LINE_BREAK, -1)).alias("line", "value"))
    parsed = lines.select(
        "path", "line", F.regexp_extract("value", ENTRY, 2).alias("name"), F.regexp_extract("value", ENTRY, 3).alias("provider")
    )
    return parsed.where((F.col("name") != "") & (F.col("provider") != ""))


def load_theme(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> dict[str, Provider]:
    """Providers of a (name, provider) table; of entries of one name the last by (path, line), where it has them, counts.

    A larger table than ``max_entries`` is an error, never cut.
    """
    places = [c for c in ("path", "line") if c in entries.columns]
    rows = entries.select(*places, "name", "provider").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"a catalogue may have at most {max_entries} entries")
    rows.sort(key=lambda r: tuple(r[c] for c in places))
    return {r["name"].strip().lower(): as_provider(_unquoted(r["provider"])) for r in rows}


def load_catalogue(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> dict[str, Provider]:
    """Base catalogue overridden by a (name, provider) table."""
    return merge(load_theme(entries, max_entries))


def _unquoted(text: str) -> str:
    quoted = len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" and text[0] not in text[1:-1]
    return text[1:-1] if quoted else text
