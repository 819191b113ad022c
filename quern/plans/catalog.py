"""Tables with declared fields: validation, defaults, signatures, differences, text form."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS: dict[str, T.DataType] = {"int": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "double": T.DoubleType()}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    unique: bool = False
    default: object = None
    least: int | None = None
    most: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    values: tuple = ()


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    fields: tuple[str, ...]
    unique: bool = False
    sparse: bool = False
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...] = ()
    indexes: tuple[Index, ...] = ()
    version: int = 1

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS.get(f.kind, T.VariantType()), not f.required) for f in self.fields])

    def signature(self) -> str:
        """The same for tables whose fields, constraints and indexes are the same."""
        return hashlib.sha256(emit_text([replace(self, version=0)]).encode()).hexdigest()[:16]


def defaults(df: DataFrame, table: Table) -> DataFrame:
    """Absent columns added, nulls filled with the declared defaults."""
    made = df
    for f in table.fields:
        kind = KINDS.get(f.kind)
        if f.name not in made.columns:
            made = made.withColumn(f.name, F.lit(f.default).cast(kind) if kind else F.lit(f.default))
        elif f.default is not None:
            made = made.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(f.default)))
    return made


def _checks(df: DataFrame, f: Field) -> list[tuple[Column, str]]:
    if f.name not in df.columns:
        return [(F.lit(True), "required")] if f.required and f.default is None else []
    c = F.col(f"`{f.name}`")
    out = [(c.isNull(), "required")] if f.required and f.default is None else []
    kind, wanted = df.schema[f.name].dataType, KINDS.get(f.kind)
    alike = wanted is None or type(kind) is type(wanted) or isinstance(kind, T.IntegralType) and f.kind == "int" or isinstance(kind, T.FractionalType) and f.kind == "double"
    if not alike:
        return [*out, (c.isNotNull(), f"{f.kind} expected")]  # other checks make no sense
    if f.least is not None:
        out.append((c < f.least, f"below {f.least}"))
    if f.most is not None:
        out.append((c > f.most, f"above {f.most}"))
    if f.min_length is not None:
        out.append((F.octet_length(c) < f.min_length, f"shorter than {f.min_length}"))
    if f.max_length is not None:
        out.append((F.octet_length(c) > f.max_length, f"longer than {f.max_length}"))
    if f.values:
        out.append((~c.isin(*f.values), "not a listed value"))
    if f.unique:
        out.append((c.isNotNull() & (F.count("*").over(W.partitionBy(c)) > 1), "not unique"))
    return out


def issues(df: DataFrame, table: Table, key: list[str]) -> DataFrame:
    """A row (key, field, issue) for each broken constraint; lengths in bytes."""
    found = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(f.name).alias("field"), F.lit(text).alias("issue"))) for f in table.fields for test, text in _checks(df, f)]
    if not found:
        return df.select(*key, F.lit("").alias("field"), F.lit("").alias("issue")).where("false")
    listed = df.select(*key, F.array_compact(F.array(*found)).alias("__found"))
    return listed.select(*key, F.explode("__found").alias("__issue")).select(*key, "__issue.field", "__issue.issue")


def insertable(df: DataFrame, table: Table) -> DataFrame:
    return defaults(df, table).select(*[f.name for f in table.fields])


def table_issues(table: Table) -> list[str]:
    names = {f.name for f in table.fields}
    return [f"index {i.name}: no field {c}" for i in table.indexes for c in (*i.fields, *i.include) if c not in names]


class Catalog:
    """Declared tables by name."""

    def __init__(self, tables: list[Table] | None = None):
        self.tables = {t.name: t for t in tables or []}

    def create(self, table: Table) -> bool:
        if not table.name or table.name in self.tables:
            return False
        self.tables[table.name] = table
        return True

    def drop(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None

    def update(self, table: Table) -> bool:
        if table.name not in self.tables:
            return False
        self.tables[table.name] = table
        return True

    def difference(self, other: Catalog) -> dict[str, list[str]]:
        """Names added, removed and changed on the way to ``other``."""
        ours, theirs = self.tables, other.tables
        return {
            "added": sorted(theirs.keys() - ours.keys()),
            "removed": sorted(ours.keys() - theirs.keys()),
            "changed": sorted(n for n in ours.keys() & theirs.keys() if ours[n].signature() != theirs[n].signature()),
        }

    def register(self, spark: SparkSession) -> None:
        """An empty view for each table that has no data yet."""
        for t in self.tables.values():
            if not spark.catalog.tableExists(t.name):
                spark.createDataFrame([], t.schema()).createOrReplaceTempView(t.name)


def _value(kind: str, text: str):
    return text == "true" if kind == "bool" else int(text) if kind == "int" else float(text) if kind == "double" else text


def parse_field(text: str) -> Field:
    """``name kind [required] [unique] [default=v] [min=n] [max=n] [minlen=n] [maxlen=n] [enum=a,b]``."""
    name, kind, *words = text.split()
    made: dict = {}
    for w in words:
        key, _, value = w.partition("=")
        if key in ("required", "unique"):
            made[key] = True
        elif key == "default":
            made["default"] = _value(kind, value)
        elif key in ("min", "max", "minlen", "maxlen"):
            made[{"min": "least", "max": "most", "minlen": "min_length", "maxlen": "max_length"}[key]] = int(value)
        elif key == "enum":
            made["values"] = tuple(_value(kind, v) for v in value.split(","))
        else:
            raise ValueError(f"unknown word {w!r}")
    return Field(name, kind, **made)


def parse_text(text: str) -> list[Table]:
    """``table name [version]``, then ``field …`` and ``index name kind a,b [unique] [sparse] [include=a,b]`` lines."""
    tables: list[Table] = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        word, _, rest = line.partition(" ")
        if word == "table":
            name, *version = rest.split()
            tables.append(Table(name, version=int(version[0]) if version else 1))
        elif word == "field" and tables:
            tables[-1] = replace(tables[-1], fields=(*tables[-1].fields, parse_field(rest)))
        elif word == "index" and tables:
            name, kind, columns, *words = rest.split()
            include = next((tuple(w[8:].split(",")) for w in words if w.startswith("include=")), ())
            made = Index(name, kind, tuple(columns.split(",")), "unique" in words, "sparse" in words, include)
            tables[-1] = replace(tables[-1], indexes=(*tables[-1].indexes, made))
        elif line:
            raise ValueError(f"can't read {line!r}")
    return tables


def emit_text(tables: list[Table]) -> str:
    out = []
    for t in tables:
        out.append(f"table {t.name} {t.version}")
        for f in t.fields:
            words = [f.name, f.kind, *(["required"] if f.required else []), *(["unique"] if f.unique else [])]
            if f.default is not None:
                words.append(f"default={str(f.default).lower() if isinstance(f.default, bool) else f.default}")
            words += [f"{k}={v}" for k, v in (("min", f.least), ("max", f.most), ("minlen", f.min_length), ("maxlen", f.max_length)) if v is not None]
            words += [f"enum={','.join(map(str, f.values))}"] if f.values else []
            out.append("field " + " ".join(words))
        for i in t.indexes:
            words = [i.name, i.kind, ",".join(i.fields), *(["unique"] if i.unique else []), *(["sparse"] if i.sparse else []), *([f"include={','.join(i.include)}"] if i.include else [])]
            out.append("index " + " ".join(words))
    return "\n".join(out)


def describe(table: Table) -> str:
    return re.sub(r"^(field|index) ", r"  \1 ", emit_text([table]), flags=re.M)
