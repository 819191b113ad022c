"""Plans written as text: pipelines, transforms, workloads, batch jobs. Each is parsed once and becomes a lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import condition
from ..functions.predicates import parse_compact
from ..operators import windows
from ..operators.relational import compare, holds, project
from .catalog import Catalog, Table

# Pipelines: a stage a line, ``name|first|second|amount``.


@dataclass(frozen=True)
class Stage:
    name: str
    first: str = ""
    second: str = ""
    amount: int = 0


def parse_pipeline(text: str) -> list[Stage]:
    stages = []
    for line in text.splitlines():
        if line.strip():
            name, first, second, amount = ([p.strip() for p in line.split("|")] + [""] * 4)[:4]
            stages.append(Stage(name, first, second, int(amount) if amount.isdigit() else 0))
    return stages


def run_pipeline(tables: Mapping[str, DataFrame], stages: list[Stage], order: list[str], shards: int = 0) -> DataFrame:
    """Stages load, filter, project, join, window and preview; others are passed over.

    ``order`` names what the input order is; a window's first rows go by it. An unknown table is empty.
    """
    spark = SparkSession.active()
    df = spark.range(0).drop("id")
    for s in stages:
        if s.name == "load":
            df = tables.get(s.first or "users", spark.range(0).drop("id"))
        elif s.name == "filter":
            df = df.where(condition(s.first, df.schema))
        elif s.name == "project":
            df = project(df, [c.strip() for c in (s.first or "id,score").split(",")])
        elif s.name == "join":
            df = join_kind(df, tables.get(s.first), s.second or "id")
        elif s.name == "window":
            if s.first in df.columns and "score" in df.columns:
                df = windows.first_sum(df, "score", [s.first], [c for c in order if c in df.columns], s.amount or shards % 8 + 1)
        elif s.name == "preview":
            size = df.agg(F.count("*").alias("bytes"))
            df = df.unionByName(size, allowMissingColumns=True)
    return df


def join_kind(df: DataFrame, table: DataFrame | None, key: str) -> DataFrame:
    """Rows with each partner of the table on its id; the partner's kind is added as event_kind."""
    if table is None or key not in df.columns or "id" not in table.columns:
        return df.where("false")
    kind = F.col("kind") if "kind" in table.columns else F.lit(None).cast("string")
    return df.join(table.select(F.col("id").alias("__id"), kind.alias("event_kind")), F.col(key) == F.col("__id")).drop("__id")


# Transforms: ``project=a,b|filter=a>1|limit=n``.


@dataclass
class Transform:
    project: list[str] = field(default_factory=list)
    filter: tuple[str, str, object] | None = None
    limit: int = 0


def parse_transform(text: str) -> Transform:
    made = Transform()
    for part in text.split("|"):
        key, _, value = part.strip().partition("=")
        if key == "project":
            made.project = [c.strip() for c in value.split(",") if c.strip()]
        elif key == "filter":
            made.filter = parse_compact(value)
        elif key == "limit":
            made.limit = int(value)
    return made


def emit_transform(plan: Transform) -> str:
    parts = [f"project={','.join(plan.project)}"] if plan.project else []
    if plan.filter:
        name, op, value = plan.filter
        parts.append(f"filter={name}{op}{str(value).lower() if isinstance(value, bool) else value}")
    return "|".join([*parts, *([f"limit={plan.limit}"] if plan.limit else [])])


def run_transform(df: DataFrame, plan: Transform, order: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Filter, then limit, then projection; and what was missing."""
    issues = []
    if plan.filter:
        if plan.filter[0] not in df.columns:
            issues.append(f"no column {plan.filter[0]}")
            df = df.where("false")
        else:
            df = df.where(compare(df, *plan.filter))
    if plan.limit:
        df = (df.orderBy(*order) if order else df).limit(plan.limit)
    if plan.project:
        issues += [f"no column {c}" for c in plan.project if c not in df.columns]
        df = project(df, plan.project)
    return df, issues


# Workloads: ``verb|table|key=value|…``.

VERBS = ("insert", "find", "update", "delete", "scan", "aggregate")


@dataclass
class Statement:
    verb: str
    table: str
    where: list[tuple[str, str, object]] = field(default_factory=list)
    values: dict[str, object] = field(default_factory=dict)
    project: list[str] = field(default_factory=list)
    aggregate: str = ""
    limit: int = 0


def parse_workload(text: str) -> list[Statement]:
    """Conditions and values are comma-separated; unknown verbs are refused."""
    out = []
    for line in text.splitlines():
        parts = [p.strip() for p in line.split("|")]
        if len(parts) < 2 or not parts[0]:
            continue
        if parts[0] not in VERBS:
            raise ValueError(f"no verb {parts[0]!r}")
        s = Statement(parts[0], parts[1])
        for p in parts[2:]:
            key, _, value = p.partition("=")
            if key == "where":
                s.where = [parse_compact(w) for w in value.split(",")]
            elif key in ("set", "doc"):
                s.values = {n: v for n, _, v in (parse_compact(w) for w in value.replace(":", "=").split(","))}
            elif key == "project":
                s.project = [c.strip() for c in value.split(",")]
            elif key == "agg":
                s.aggregate = value.strip()
            elif key == "limit":
                s.limit = int(value)
        out.append(s)
    return out


@dataclass
class Plan:
    """``steps``: (kind, what it uses, rows, cost); the plan costs their sum."""

    statement: Statement
    index: str = ""
    steps: list[tuple[str, str, int, int]] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)

    @property
    def cost(self) -> int:
        return sum(cost for *_, cost in self.steps)

    @property
    def accepted(self) -> bool:
        return not self.diagnostics

    def explain(self) -> str:
        path = f"index {self.index}" if self.index else "scan"
        steps = "".join(f"\n  {kind}{' ' + uses if uses else ''}: {rows} rows, cost {cost}" for kind, uses, rows, cost in self.steps)
        return f"{self.statement.verb} {self.statement.table} by {path}, cost {self.cost}" + "".join(f"; {d}" for d in self.diagnostics) + steps


def plan(statement: Statement, catalog: Catalog) -> Plan:
    """Checks names and kinds against the catalog, and estimates what an index or a scan would cost."""
    made = Plan(statement)
    table = catalog.tables.get(statement.table)
    if table is None:
        made.diagnostics.append(f"no table {statement.table}")
        return made
    named = [c for c, _, _ in statement.where] + list(statement.values) + statement.project + ([statement.aggregate] if statement.aggregate else [])
    made.diagnostics += [f"no field {c}" for c in dict.fromkeys(named) if table.field(c) is None]
    for name, value in [(c, v) for c, _, v in statement.where] + list(statement.values.items()):
        f = table.field(name)
        kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "string"
        if f is not None and f.kind in ("int", "bool", "string") and f.kind != kind:
            made.diagnostics.append(f"{name}: {f.kind} expected")
    if statement.verb == "insert":
        made.diagnostics += [f"{f.name} is required" for f in table.fields if f.required and f.default is None and f.name not in statement.values]
    made.index = "" if statement.verb == "insert" else _index(table, statement)
    made.steps = _inserting(table) if statement.verb == "insert" else _reading(table, statement, made.index)
    return made


# Fixed values of the cost model: cost of each step, and what share of a table's rows it is taken to leave.
VALIDATE, DEFAULTS, UNIQUE_ENTRY, ENTRY, LOOKUP, SCAN, COLUMN, CHANGED, UPDATE, DELETE, AGGREGATE = 4, 2, 3, 5, 8, 4, 2, 5, 3, 7, 25
FILTERED, UPDATED, DELETED, GROUPED = 4, 4, 5, 8


def _inserting(table: Table) -> list[tuple[str, str, int, int]]:
    entries = [("index", i.name, 1, UNIQUE_ENTRY if i.unique else ENTRY) for i in table.indexes]
    return [("validate", "", 1, VALIDATE), ("defaults", "", 1, DEFAULTS), *entries]


def _reading(table: Table, s: Statement, index: str) -> list[tuple[str, str, int, int]]:
    whole = 128 * max(1, len(table.fields)) * max(1, len(table.indexes))
    left = lambda share: max(1, whole // share)
    steps = [("scan", "", whole, whole * SCAN)]
    if index:
        unique = {f.name for f in table.fields if f.unique} | {i.fields[0] for i in table.indexes if i.unique and len(i.fields) == 1}
        rows = whole
        for column, op, _ in s.where:
            rows = max(1, rows // ((64 if column in unique else 8) if op == "=" else 4))
        steps = [("lookup", index, rows, rows + LOOKUP)]
    if s.where:
        steps.append(("filter", "", left(FILTERED), whole))
    if s.project:
        steps.append(("project", ",".join(s.project), left(FILTERED), COLUMN * len(s.project)))
    if s.verb == "update":
        steps.append(("update", "", left(UPDATED), CHANGED * len(s.values) + UPDATE))
    elif s.verb == "delete":
        steps.append(("delete", "", left(DELETED), DELETE))
    elif s.verb == "aggregate":
        steps.append(("aggregate", s.aggregate, left(GROUPED), AGGREGATE))
    return steps


def _index(table: Table, statement: Statement) -> str:
    """The index of whose fields equalities cover most; unique ones count double."""
    equal = {c for c, op, _ in statement.where if op == "="}
    best, score = "", 0
    for i in table.indexes:
        covered = sum(c in equal for c in i.fields)
        if covered * (4 if i.unique else 2) > score:
            best, score = i.name, covered * (4 if i.unique else 2)
    return best


def execute(statement: Statement, df: DataFrame) -> DataFrame:
    """The statement over its table: rows read, or the whole table rewritten by insert, update and delete."""
    hit = F.lit(True)
    for w in statement.where:
        hit = hit & compare(df, *w)
    if statement.verb == "insert":
        row = [F.lit(statement.values[c]).cast(df.schema[c].dataType).alias(c) if c in statement.values else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
        return df.unionByName(SparkSession.active().range(1).select(*row))
    if statement.verb == "update":
        return df.withColumns({c: F.when(holds(hit), F.lit(v)).otherwise(F.col(c)) for c, v in statement.values.items()})
    if statement.verb == "delete":
        return df.where(~holds(hit))
    found = df.where(hit)
    if statement.verb == "aggregate":
        c = F.col(statement.aggregate)
        return found.agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"))
    found = found.limit(statement.limit) if statement.limit else found
    return project(found, statement.project) if statement.project else found


# Batch jobs: ``task|name|cost|needs,needs``.


@dataclass(frozen=True)
class Task:
    name: str
    cost: int = 1
    needs: tuple[str, ...] = ()
    retries: int = 0


def parse_batch(text: str) -> list[Task]:
    out = []
    for line in text.splitlines():
        parts = [p.strip() for p in line.split("|")]
        if parts[0] == "task" and len(parts) > 1:
            parts += [""] * (5 - len(parts))
            out.append(Task(parts[1], int(parts[2] or 1), tuple(n.strip() for n in parts[3].split(",") if n.strip()), int(parts[4] or 0)))
    return out


def dry_run(tasks: list[Task]) -> tuple[list[list[str]], int, list[str]]:
    """(levels of tasks that can run together, total cost, tasks that never can: unknown needs or circles)."""
    left = {t.name: set(t.needs) for t in tasks}
    done: set[str] = set()
    levels = []
    while ready := sorted(n for n, needs in left.items() if needs <= done):
        levels.append(ready)
        done |= set(ready)
        for n in ready:
            del left[n]
    return levels, sum(t.cost for t in tasks if t.name in done), sorted(left)


def run_batch(tasks: list[Task], actions: Mapping[str, Callable[[], object]]) -> list[tuple[str, str, int]]:
    """(task, status, tries) in order of running: done, failed, or skipped after a failed need; stuck ones last."""
    levels, _, stuck = dry_run(tasks)
    known, events, bad = {t.name: t for t in tasks}, [], set()
    for name in [n for level in levels for n in level]:
        task = known[name]
        if bad & set(task.needs):
            bad.add(name)
            events.append((name, "skipped", 0))
            continue
        for attempt in range(1, task.retries + 2):
            try:
                actions.get(name, lambda: None)()
                events.append((name, "done", attempt))
                break
            except Exception:
                if attempt > task.retries:
                    bad.add(name)
                    events.append((name, "failed", attempt))
    return [*events, *((name, "failed", 0) for name in stuck)]
