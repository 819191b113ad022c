"""Predicates written as text: ``field op value``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.relational import compare

OPERATORS = ("!=", ">=", "<=", "=", ">", "<")


def literal(text: str):
    """true and false, then whole numbers, else text; quotes are taken off."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def parse_triple(text: str) -> tuple[str, str, object]:
    """``age > 21``: three words, the rest of the line being the value."""
    parts = text.split(None, 2)
    if len(parts) < 3 or parts[1] not in OPERATORS:
        raise ValueError(f"field, operator and value expected: {text!r}")
    return parts[0], parts[1], literal(parts[2].strip())


def parse_compact(text: str) -> tuple[str, str, object]:
    """``age>21`` or ``age > 21``: the first operator that occurs, longer ones first."""
    for op in OPERATORS:
        if op in text:
            field, value = text.split(op, 1)
            return field.strip(), op, literal(value.strip())
    raise ValueError(f"no operator in {text!r}")


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows that satisfy the written predicate."""
    return df.where(compare(df, *parse_triple(text)))
