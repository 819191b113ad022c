"""JSON text and columns: sources, sinks, navigation, and checks against a subset of JSON Schema."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object a line; give a schema where the data is large, inferring one reads it twice."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def parse(text: Column) -> Column:
    """A dynamically typed value; null where the text is no JSON."""
    return F.try_parse_json(text)


def get(value: Column, path: str, kind: str) -> Column:
    """The value at ``path`` ($.a.b[0]) as ``kind``; null where it is absent or of another kind. Fractions are cut for int."""
    return F.try_variant_get(value, path, kind)


def serialise(value: Column) -> Column:
    return F.to_json(value)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _below(path: str, name: str) -> str:
    return f"{path}.{name}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) else f"{path}[{json.dumps(name)}]"


def violations(value: Column, schema: dict, at: str = "$", shown: str = "$") -> Column:
    """Texts of what breaks ``schema`` (type, required, properties, items, minimum, maximum, minLength, maxLength), each once.

    ``value`` is a variant column, ``at`` the path of the part looked at, ``shown`` its name in the texts: [] stands for any element of
    an array. Lengths are in bytes.
    """
    kinds = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": "^BIGINT", "boolean": "^BOOLEAN"}
    here = value if at == "$" else F.try_variant_get(value, at, "variant")
    wanted = schema.get("type")
    wrong = ~F.coalesce(_kind(here).rlike(kinds[wanted]), F.lit(False)) if wanted else F.lit(False)
    checks: list[Column] = [F.when(wrong, F.lit(f"{shown}: {wanted} expected"))]
    for name in schema.get("required", []):
        missing = F.try_variant_get(value, _below(at, name), "variant").isNull()
        checks.append(F.when(~wrong & missing, F.lit(f"{shown}.{name}: required")))
    number = F.try_variant_get(value, at, "long")
    for key, test in (("minimum", lambda v: number < v), ("maximum", lambda v: number > v)):
        if key in schema:
            checks.append(F.when(~wrong & F.coalesce(test(schema[key]), F.lit(False)), F.lit(f"{shown}: {key} {schema[key]}")))
    length = F.octet_length(F.try_variant_get(value, at, "string"))
    for key, test in (("minLength", lambda v: length < v), ("maxLength", lambda v: length > v)):
        if key in schema:
            checks.append(F.when(~wrong & F.coalesce(test(schema[key]), F.lit(False)), F.lit(f"{shown}: {key} {schema[key]}")))
    made = F.filter(F.array(*checks), lambda c: c.isNotNull())
    for name, part in schema.get("properties", {}).items():
        inner = violations(value, part, _below(at, name), f"{shown}.{name}")
        present = F.try_variant_get(value, _below(at, name), "variant").isNotNull()
        made = F.concat(made, F.when(present, inner).otherwise(F.array().cast("array<string>")))
    if schema.get("items"):
        items = F.try_variant_get(value, at, "array<variant>")
        inner = F.array_distinct(F.flatten(F.transform(items, lambda x: violations(x, schema["items"], "$", f"{shown}[]"))))
        made = F.concat(made, F.when(~wrong & items.isNotNull(), inner).otherwise(F.array().cast("array<string>")))
    return made
