"""Normalising raw facts: ids, entities, locations, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import content_id

# Prefix of the id of each fact type, where it is not the type itself.
ID_PREFIX = {
    "hook_usage": "hook", "function_call": "call", "react_component": "component", "vue_component": "component",
    "express_route": "route", "next_page_route": "nextroute", "next_api_route": "nextroute",
    "shell_function_def": "shell_function", "shell_package_manager_call": "shell_pkg_cmd",
    "shell_command": "shell_cmd", "lua_function_def": "lua_function", "doc_code_block": "doc_codeblock",
}
# The field that names the entity of these types; others take the first field present.
ENTITY_FIELD = {
    "import": "target", "hook_usage": "name", "function_call": "callee", "react_component": "name",
    "express_route": "route_path",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normalize_facts(raw: DataFrame, id_size: int = 32) -> DataFrame:
    """Add ``id``, ``entity``, ``source``, ``location`` and ``metadata`` to raw facts.

    The id is a hash of what the fact says and where, so it is the same in every run.
    """
    kind = F.col("type")
    prefix = F.coalesce(_lookup(ID_PREFIX, kind), kind)
    first_named = F.coalesce("name", "target", "callee", "route_path")
    mapped = F.when(kind == "import", F.col("target"))
    for name, column in ENTITY_FIELD.items():
        mapped = mapped.when(kind == name, F.col(column))
    ident = content_id(
        prefix, F.col("repo"), kind, F.col("file"), F.col("line"), first_named, F.col("pos"), size=id_size
    )
    own = F.create_map(
        F.lit("name"), F.col("name"), F.lit("target"), F.col("target"), F.lit("caller"), F.col("caller"),
        F.lit("callee"), F.col("callee"), F.lit("method"), F.col("method"), F.lit("routePath"), F.col("route_path"),
        F.lit("kind"), F.col("kind"),
    )
    metadata = F.map_concat(F.map_filter(own, lambda k, v: v.isNotNull()), F.coalesce("extra", F.create_map().cast("map<string,string>")))
    return (
        raw.withColumn("id", ident)
        .withColumn("entity", F.coalesce(mapped, first_named, F.col("id")))
        .withColumn("source", F.col("file"))
        .withColumn("location", F.struct(F.col("line").alias("line"), F.lit(None).cast("int").alias("col")))
        .withColumn("metadata", metadata)
        .drop("extra")
    )
