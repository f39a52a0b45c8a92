"""Observation values as VARIANT: kinds, whole numbers and members of JSON text, all in the JVM.

JSON keeps integers of up to 38 digits exact, apart from decimals, and true apart from 1. Text that is no JSON is no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the parser types a whole number: by size. A decimal of 18 digits or fewer had a point.
WHOLE = r"^(BIGINT|DECIMAL\((19|2[0-9]|3[0-8]),0\))$"


def member(value_json: Column, path: str = "$") -> Column:
    """The value at a path, as VARIANT; null if there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(value_json), path, "variant")


def kind(value_json: Column, path: str = "$") -> Column:
    """null, boolean, integer, number, string, array or object; SQL null if there is no value."""
    name = F.schema_of_variant(member(value_json, path))
    return (
        F.when(name == "VOID", "null")
        .when(name == "BOOLEAN", "boolean")
        .when(name.rlike(WHOLE), "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
    )


def whole_number(value_json: Column, path: str = "$") -> Column:
    """The integer at a path as decimal(38, 0); null for anything else, true and 3.0 too."""
    found = member(value_json, path)
    return F.when(F.schema_of_variant(found).rlike(WHOLE), F.try_variant_get(found, "$", "decimal(38,0)"))


def canonical(value_json: Column) -> Column:
    """The value as compact JSON with sorted members; equal values have equal text."""
    return F.to_json(F.try_parse_json(value_json))
