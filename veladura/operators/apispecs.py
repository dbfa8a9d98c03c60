"""OpenAPI and Swagger documents to rows: versions, base URLs, schemas, endpoints, request bodies.

A document is one JSON text per row. Objects are read as ordered maps with
``from_json``, since a VARIANT returns its keys sorted and the order of the
properties is the order of the generated columns. Of a key that an object repeats the last value counts, at the
place of the first, as JSON readers do; a VARIANT would refuse the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions.draws import DEFAULT_SEED
from veladura.functions.jsontext import STRICT, entries, is_object
from veladura.operators.generate import generate_named

DOCUMENT = (
    "struct<openapi:string,swagger:string,servers:array<struct<url:string>>,host:string,schemes:array<string>,"
    "basePath:string,components:struct<schemas:map<string,string>>,definitions:map<string,string>,"
    "paths:map<string,string>>"
)
DETAILS = "struct<summary:string,description:string,parameters:string,requestBody:string,responses:string>"
PROPERTIES = "struct<properties:map<string,string>>"

# The path-item keys that are methods.
METHODS = ["get", "post", "put", "delete", "patch", "options", "head"]

# Names and properties shown of a document.
TOP = 5


def parse_specs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """Adds ``doc`` (null when the text is not a JSON object)."""
    return specs.withColumn("doc", F.when(is_object(F.col(spec)), F.from_json(F.col(spec), DOCUMENT, STRICT)))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("doc").isNotNull())


def rejected(parsed: DataFrame) -> DataFrame:
    """Documents that could not be read, kept for a reject table."""
    return parsed.where(F.col("doc").isNull()).drop("doc")


def api_version(doc: Column) -> Column:
    return F.coalesce(doc["openapi"], doc["swagger"])


def api_base_url(doc: Column) -> Column:
    """First server, else scheme://host + basePath, else empty."""
    host = F.concat(
        F.coalesce(F.try_element_at(doc["schemes"], F.lit(1)), F.lit("https")),
        F.lit("://"), doc["host"], F.coalesce(doc["basePath"], F.lit("")),
    )
    server = F.when(F.size(doc["servers"]) > 0, F.coalesce(F.get(doc["servers"], F.lit(0))["url"], F.lit("")))
    return F.coalesce(server, host, F.lit(""))


def merged_schemas(doc: Column) -> Column:
    """Array of (key, value): component schemas in document order, definitions over them and after them."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    first = F.coalesce(entries(doc["components"]["schemas"]), none)
    later = F.coalesce(entries(doc["definitions"]), none)
    as_map = F.when(F.size(later) > 0, F.map_from_entries(later))
    kept = F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(as_map, e["key"]), e["value"]).alias("value")))
    names = F.transform(first, lambda e: e["key"])
    return F.concat(kept, F.filter(later, lambda e: ~F.array_contains(names, e["key"])))


def _rows(df: DataFrame, keys: Sequence[str], entries: Column, index: str, name: str, value: str) -> DataFrame:
    listed = df.select(*keys, F.posexplode_outer(entries).alias(index, "__e"))
    return listed.where(F.col(index).isNotNull()).select(
        *keys, index, F.col("__e.key").alias(name), F.col("__e.value").alias(value)
    )


def api_schemas(parsed: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """One row per schema with its JSON text and property count."""
    rows = _rows(accepted(parsed), keys, merged_schemas(F.col("doc")), "schema_ix", "schema", "body")
    return rows.withColumn("n_properties", _n_properties(F.col("body")))


def _properties(body: Column) -> Column:
    return entries(F.from_json(body, PROPERTIES)["properties"])


def _n_properties(body: Column) -> Column:
    return F.coalesce(F.size(_properties(body)), F.lit(0))


def api_columns(schemas: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """One row per property, in document order: the generator columns of a schema."""
    properties = _properties(F.col("body"))
    rows = _rows(schemas, [*keys, "schema"], properties, "property_ix", "property", "definition")
    kind = F.from_json(F.col("definition"), "struct<type:string>")["type"]
    return rows.withColumn("type", F.coalesce(kind, F.lit("string")))


def _methods(item: Column) -> Column:
    """(key, value) of the methods of a path item."""
    return F.filter(entries(F.from_json(item, "map<string,string>")), lambda e: F.lower(e["key"]).isin(METHODS))


def api_endpoints(parsed: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """One row per (path, method); path-item keys that are no methods are left out."""
    paths = _rows(accepted(parsed), keys, entries(F.col("doc.paths")), "path_ix", "path", "item")
    items = _rows(paths, [*keys, "path_ix", "path"], entries(F.from_json("item", "map<string,string>")), "method_ix", "method", "details")
    details = F.from_json(F.col("details"), DETAILS)
    return (
        items.where(F.lower("method").isin(METHODS))
        .withColumn("__d", details)
        .select(
            *keys, "path_ix", "method_ix", "path", F.upper("method").alias("method"),
            F.coalesce("__d.summary", F.lit("")).alias("summary"),
            F.coalesce("__d.description", F.lit("")).alias("description"),
            F.coalesce("__d.parameters", F.lit("[]")).alias("parameters"),
            F.coalesce("__d.requestBody", F.lit("{}")).alias("request_body"),
            F.coalesce("__d.responses", F.lit("{}")).alias("responses"),
        )
    )


def api_summary(parsed: DataFrame, keys: Sequence[str] = ("spec_id",), top: int = TOP) -> DataFrame:
    """Per document: base URL, counts, the first schemas with their property counts and the first endpoints, and how many more there are. No shuffle."""
    none = F.array().cast("array<string>")
    labelled = lambda e: F.concat(e["key"], F.lit(" ("), _n_properties(e["value"]).cast("string"), F.lit(")"))
    of_path = lambda p: F.transform(F.coalesce(_methods(p["value"]), F.array().cast("array<struct<key:string,value:string>>")), lambda m: F.concat(F.upper(m["key"]), F.lit(" "), p["key"]))
    listed = accepted(parsed).withColumns(
        {"__schemas": merged_schemas(F.col("doc")), "__endpoints": F.coalesce(F.flatten(F.transform(entries(F.col("doc.paths")), of_path)), none)}
    )
    return listed.select(
        *keys,
        api_base_url(F.col("doc")).alias("base_url"),
        F.size("__schemas").alias("schemas_count"),
        F.size("__endpoints").alias("endpoints_count"),
        F.array_join(F.transform(F.slice("__schemas", 1, top), labelled), ", ").alias("first_schemas"),
        F.greatest(F.size("__schemas") - top, F.lit(0)).alias("more_schemas"),
        F.array_join(F.slice("__endpoints", 1, top), ", ").alias("first_endpoints"),
        F.greatest(F.size("__endpoints") - top, F.lit(0)).alias("more_endpoints"),
    )


def schema_datasets(schemas: DataFrame, n: int, keys: Sequence[str] = ("spec_id",), document: str = "spec_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` records per document and schema: keys, schema, record_ix and the record as a map of the schema's own columns.

    ``document`` is an integer key; a value depends on (seed, document, record, property). One row per property until the
    records are put together, so schemas of any shape go through one plan.
    """
    properties = api_columns(schemas, keys).select(*keys, "schema", "property_ix", "property", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("record_ix"))
    valued = generate_named(properties.withColumn("__row", F.col(document) * n + F.col("record_ix")), "__row", "property", seed=seed)
    ordered = F.array_sort(F.collect_list(F.struct("property_ix", "property", "value")))
    records = valued.groupBy(*keys, "schema", "record_ix").agg(F.transform(ordered, lambda x: F.struct(x["property"], x["value"])).alias("__pairs"))
    return records.select(*keys, "schema", "record_ix", F.map_from_entries("__pairs").alias("record"))


def request_bodies(schemas: DataFrame, n: int = 1, keys: Sequence[str] = ("spec_id",), seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` sample bodies per schema as JSON: the example, else an enum value drawn by
    (document, schema, body, property), else a constant by type."""
    rows = schemas.select(*keys, "schema", "body", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("body_ix"))
    place = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("schema"), F.col("body_ix"))
    properties = _properties(F.col("body"))
    opened = F.transform(
        properties,
        lambda e: F.struct(
            e["key"].alias("name"),
            F.try_parse_json(e["value"]).alias("v"),
            F.from_json(e["value"], "struct<type:string>")["type"].alias("type"),
            F.conv(F.substring(F.sha2(F.concat_ws("|", place, e["key"]), 256), 1, 13), 16, 10).cast("bigint").alias("draw"),
        ),
    )

    def value(p: Column) -> Column:
        enum = F.try_variant_get(p["v"], "$.enum", "array<variant>")
        kind = F.coalesce(p["type"], F.lit("string"))
        return F.coalesce(
            F.to_json(F.try_variant_get(p["v"], "$.example", "variant")),
            F.when(F.size(enum) > 0, F.to_json(F.get(enum, (p["draw"] % F.greatest(F.size(enum), F.lit(1))).cast("int")))),
            F.when(kind == "string", F.to_json(F.concat(F.lit("test_"), p["name"]).cast("variant")))
            .when(kind == "integer", F.lit("0"))
            .when(kind == "boolean", F.lit("false"))
            .otherwise(F.lit("null")),
        )

    pairs = F.transform(opened, lambda p: F.concat(F.to_json(p["name"].cast("variant")), F.lit(":"), value(p)))
    return rows.select(
        *keys, "schema", "body_ix",
        F.concat(F.lit("{"), F.array_join(F.coalesce(pairs, F.array().cast("array<string>")), ","), F.lit("}")).alias("request"),
    )
