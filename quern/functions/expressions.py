"""A small expression language compiled to columns.

Numbers, quoted text, names, calls of four functions, * and / before + and -, those before = < >, left to
right; parentheses. Names of the form ``slot.A.B`` mean column ``a_b``, if there is one. Everything is
compiled against a schema, so each part's kind (int, text, bool or none) is known before the plan runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

BINDING = {"*": 20, "/": 20, "+": 10, "-": 10, "=": 5, "<": 5, ">": 5}
TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<sign>[-+*/=<>(),]))""")


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Typed:
    """``bare``: for a filter, the column as the scan can take it, null for false."""

    kind: str
    column: Column
    bare: Column | None = None


def none() -> Typed:
    return Typed("none", F.lit(None).cast("long"))


def kind_of(data: T.DataType) -> str:
    if isinstance(data, T.IntegralType):
        return "int"
    if isinstance(data, T.StringType):
        return "text"
    if isinstance(data, T.BooleanType):
        return "bool"
    return "none"


class _Parser:
    def __init__(self, text: str, schema: T.StructType):
        self.schema, self.tokens, at = schema, [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if sign is not None and token != ("sign", sign):
            raise ExpressionError(f"{sign} expected, not {token[1]!r}")
        self.at += 1
        return token

    def expression(self, least: int = 0) -> Typed:
        left = self.single()
        while (token := self.peek())[0] == "sign" and BINDING.get(token[1], -1) > least:
            self.take()
            left = binary(token[1], left, self.expression(BINDING[token[1]]))
        return left

    def single(self) -> Typed:
        kind, value = self.take()
        if kind == "int":
            return Typed("int", F.lit(int(value)).cast("long"))
        if kind == "text":
            return Typed("text", F.lit(re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S)))
        if kind == "name":
            return self.call(value) if self.peek() == ("sign", "(") else self.name(value)
        if (kind, value) == ("sign", "("):
            inner = self.expression()
            self.take(")")
            return inner
        raise ExpressionError(f"a value expected, not {value!r}")

    def name(self, name: str) -> Typed:
        if name.lower() in ("true", "false"):
            return Typed("bool", F.lit(name.lower() == "true"))
        options = ["_".join(name.split(".")[1:]).lower(), name] if name.startswith("slot.") else [name]
        for option in options:
            if option in self.schema.names:
                kind = kind_of(self.schema[option].dataType)
                column = F.col(f"`{option}`")
                return Typed(kind, column.cast("long") if kind == "int" else column)
        return none()

    def call(self, name: str) -> Typed:
        self.take("(")
        args: list[Typed] = []
        while self.peek() != ("sign", ")"):
            args.append(self.expression())
            if self.peek() == ("sign", ","):
                self.take()
            elif self.peek() != ("sign", ")"):
                raise ExpressionError("a call isn't closed")
        self.take(")")
        return call(name, args)


def call(name: str, args: list[Typed]) -> Typed:
    """len, contains, between, bucket; another name or number of arguments gives none."""
    kinds = [a.kind for a in args]
    columns = [a.column for a in args]
    if name == "len" and len(args) == 1:
        return Typed("int", scalars.byte_length(columns[0]).cast("long") if kinds == ["text"] else F.lit(0).cast("long"))
    if name == "contains" and len(args) == 2:
        return Typed("bool", scalars.contains(*columns), F.contains(*columns)) if kinds == ["text", "text"] else Typed("bool", F.lit(False))
    if name == "between" and len(args) in (2, 3):
        if set(kinds) != {"int"}:
            return Typed("bool", F.lit(False))
        return Typed("bool", scalars.between(*columns), columns[0].between(columns[1], columns[2] if len(args) == 3 else columns[1] + 10))
    if name == "bucket" and len(args) in (1, 2):
        if kinds[0] != "int":
            return Typed("int", F.lit(0).cast("long"))
        return Typed("int", scalars.bucket(columns[0], columns[1] if len(args) == 2 and kinds[1] == "int" else None))
    return none()


def binary(sign: str, a: Typed, b: Typed) -> Typed:
    ints = a.kind == b.kind == "int"
    if sign in "=<>":
        if not (ints or sign == "=" and a.kind == b.kind != "none"):
            return Typed("bool", F.lit(False))
        bare = a.column == b.column if sign == "=" else a.column < b.column if sign == "<" else a.column > b.column
        return Typed("bool", F.coalesce(bare, F.lit(False)), bare)
    if not ints:
        return none()
    return Typed("int", {"+": lambda: a.column + b.column, "-": lambda: a.column - b.column, "*": lambda: a.column * b.column, "/": lambda: scalars.divide(a.column, b.column)}[sign]())


def compile_expression(text: str, schema: T.StructType) -> Typed:
    parser = _Parser(text, schema)
    made = parser.expression()
    if parser.peek()[0] != "end":
        raise ExpressionError(f"nothing expected after {parser.peek()[1]!r}")
    return made


def condition(text: str, schema: T.StructType) -> Column:
    """Whether the expression is truthy; an empty one is. For filters: null may stand for false."""
    if not text.strip():
        return F.lit(True)
    made = compile_expression(text, schema)
    return scalars.truthy(made.kind, made.column) if made.bare is None else made.bare


def with_expression(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, compile_expression(text, df.schema).column)
