"""JSON texts as readers take them: whole objects, ordered, the last of a repeated key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


STRICT = {"allowSingleQuotes": "false"}


def is_object(text: Column) -> Column:
    """Whether a text is one whole JSON object: an array around it has one element, which is an object."""
    around = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", STRICT)
    return F.coalesce(text.rlike(r"(?s)^\s*\{.*\}\s*$") & (F.size(around) == 1), F.lit(False))


def entries(object_: Column) -> Column:
    """Array of (key, value) of an ordered map; repeated keys are merged."""
    def merged(all_: Column) -> Column:
        # Sorted by key and place, a run of one key has its first place in front and its last value at the end.
        placed = F.array_sort(F.transform(all_, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
        bound = F.transform(F.array(placed), lambda p: F.transform(p, lambda x, k: F.struct(
            x["key"].alias("key"), x["value"].alias("value"), x["i"].alias("i"),
            ((k == 0) | (F.get(p, k - 1)["key"] != x["key"])).alias("first"), ((k == F.size(p) - 1) | (F.get(p, k + 1)["key"] != x["key"])).alias("last"),
        )))[0]
        firsts = lambda b: F.filter(b, lambda x: x["first"])
        lasts = lambda b: F.filter(b, lambda x: x["last"])
        both = F.transform(F.array(bound), lambda b: F.zip_with(firsts(b), lasts(b), lambda f, v: F.struct(f["i"].alias("i"), f["key"].alias("key"), v["value"].alias("value"))))[0]
        return F.transform(F.array_sort(both), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))

    listed = F.map_entries(object_)
    once = F.transform(F.array(listed), lambda a: F.when(F.size(F.array_distinct(F.transform(a, lambda e: e["key"]))) == F.size(a), a).otherwise(merged(a)))[0]
    return F.when(object_.isNotNull(), once)
