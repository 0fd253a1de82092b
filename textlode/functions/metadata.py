"""Typed reads from JSON metadata held in a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(metadata: Column, key: str) -> Column:
    """The value of ``key`` as its JSON text: 5 is '5', 5.0 is '5.0', true is 'true'; null if missing, null or no JSON."""
    return F.get_json_object(metadata, f"$.{key}")


def parsed(metadata: Column) -> Column:
    """The JSON as a variant: as a column of its own, it is parsed once for all reads."""
    return F.try_parse_json(metadata)


def kind(metadata: Column, key: str, variant: Column | None = None) -> Column:
    """'number', 'string', 'boolean', 'object', 'array' or null; ``variant`` is what ``parsed`` gave, if it was called."""
    schema = F.schema_of_variant(F.try_variant_get(parsed(metadata) if variant is None else variant, f"$.{key}", "variant"))
    return (
        F.when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|TINYINT|SMALLINT|INT)"), "number").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
    )


def as_number(metadata: Column, key: str) -> Column:
    """The value as a double if it is a JSON number, else null: the text "5" is no number."""
    return F.when(kind(metadata, key) == "number", F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "double"))


def as_string(metadata: Column, key: str, variant: Column | None = None) -> Column:
    """The value if it is a JSON string, else null."""
    return F.when(kind(metadata, key, variant) == "string", as_text(metadata, key))


def as_index(metadata: Column, key: str, variant: Column | None = None) -> Column:
    """The value as a long if it is a whole JSON number of at least 0, else null; digits are read from the text, so 19 digits keep
    their precision."""
    text = as_text(metadata, key)
    return F.when((kind(metadata, key, variant) == "number") & text.rlike(r"^\d{1,18}$|^[1-8]\d{18}$"), text.cast("long"))
