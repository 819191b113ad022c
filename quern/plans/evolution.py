"""Schema changes: compatibility, and steps folded over a table's rows and declaration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import KINDS, Field, Index, Table, defaults, issues, parse_field


@dataclass(frozen=True)
class Action:
    kind: str
    target: str
    detail: object = None


@dataclass(frozen=True)
class Step:
    table: str
    source: int
    target: int
    actions: tuple[Action, ...] = ()


@dataclass
class Report:
    table: Table
    rows: DataFrame | None
    issues: list[str] = field(default_factory=list)
    rebuilt: int = 0

    @property
    def success(self) -> bool:
        return not self.issues


def compatibility(before: Table, after: Table) -> list[str]:
    """What readers of ``before`` lose in ``after``."""
    out = []
    for f in before.fields:
        now = after.field(f.name)
        if now is None:
            out.append(f"field {f.name} removed")
        elif now.kind != f.kind and "any" not in (f.kind, now.kind):
            out.append(f"field {f.name}: {f.kind} became {now.kind}")
    known = {f.name for f in before.fields}
    out += [f"new field {f.name} is required without a default" for f in after.fields if f.name not in known and f.required and f.default is None]
    old = {i.name: i for i in before.indexes}
    out += [f"index {i.name} changed" for i in after.indexes if i.name in old and old[i.name] != i]
    return out


def parse(text: str) -> list[Step]:
    """``step table from to`` lines, each followed by its actions."""
    steps: list[Step] = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        word, _, rest = line.partition(" ")
        if word == "step":
            name, source, target = rest.split()
            steps.append(Step(name, int(source), int(target)))
            continue
        if not steps:
            raise ValueError(f"no step before {line!r}")
        target, _, more = rest.partition(" ")
        detail: object = more
        if word == "add_field":
            detail = parse_field(rest)
        elif word == "add_index":
            name, columns, *words = rest.split()
            detail = Index(name, "btree", tuple(columns.split(",")), "unique" in words)
        elif word == "add_constraint":
            detail = parse_field(f"{target} string {more}")
        elif word not in ("drop_field", "rename_field", "change_type", "drop_index", "set_default", "drop_constraints"):
            raise ValueError(f"unknown action {word!r}")
        steps[-1] = replace(steps[-1], actions=(*steps[-1].actions, Action(word, target, detail)))
    return steps


def emit(steps: list[Step]) -> str:
    from .catalog import emit_text

    out = []
    for s in steps:
        out.append(f"step {s.table} {s.source} {s.target}")
        for a in s.actions:
            if isinstance(a.detail, Field):
                words = emit_text([Table("t", (a.detail,))]).splitlines()[1].split()[1:]
                out.append(" ".join([a.kind, *(words if a.kind == "add_field" else [words[0], *words[2:]])]))
            elif isinstance(a.detail, Index):
                out.append(" ".join([a.kind, a.detail.name, ",".join(a.detail.fields), *(["unique"] if a.detail.unique else [])]))
            else:
                out.append(f"{a.kind} {a.target} {a.detail}".rstrip())
    return "\n".join(out)


def _set(table: Table, of: str, **changes) -> Table:
    return replace(table, fields=tuple(replace(f, **changes) if f.name == of else f for f in table.fields))


def _apply(report: Report, action: Action) -> None:
    t, df, name = report.table, report.rows, action.target
    known = t.field(name) is not None

    def need(ok: bool, text: str) -> bool:
        if not ok:
            report.issues.append(f"{action.kind} {name}: {text}")
        return ok

    match action.kind:
        case "add_field":
            if need(not known, "there is one"):
                report.table = replace(t, fields=(*t.fields, action.detail))
                df = defaults(df, report.table) if df is not None else None
        case "drop_field":
            if need(known, "no such field"):
                report.table = replace(t, fields=tuple(f for f in t.fields if f.name != name), indexes=tuple(i for i in t.indexes if name not in (*i.fields, *i.include)))
                df = df.drop(name) if df is not None else None
        case "rename_field":
            new = str(action.detail).strip()
            if need(known, "no such field") and need(t.field(new) is None, f"{new} is taken"):
                swap = lambda names: tuple(new if n == name else n for n in names)
                report.table = replace(_set(t, name, name=new), indexes=tuple(replace(i, fields=swap(i.fields), include=swap(i.include)) for i in t.indexes))
                df = df.withColumnRenamed(name, new) if df is not None else None
        case "change_type":
            kind = str(action.detail).strip()
            if need(known, "no such field") and need(kind in KINDS, f"no type {kind}"):
                report.table = _set(t, name, kind=kind)
                df = df.withColumn(name, F.col(name).try_cast(KINDS[kind])) if df is not None else None
        case "add_index":
            missing = [c for c in action.detail.fields if t.field(c) is None]
            if need(all(i.name != action.detail.name for i in t.indexes), "there is one") and need(not missing, f"no field {', '.join(missing)}"):
                report.table = replace(t, indexes=(*t.indexes, action.detail))
                report.rebuilt += 1
        case "drop_index":
            if need(any(i.name == name for i in t.indexes), "no such index"):
                report.table = replace(t, indexes=tuple(i for i in t.indexes if i.name != name))
        case "set_default":
            if need(known, "no such field"):
                value = parse_field(f"{name} {t.field(name).kind} default={str(action.detail).strip()}").default
                report.table = _set(t, name, default=value)
                df = defaults(df, report.table) if df is not None else None
        case "add_constraint":
            if need(known, "no such field"):
                d = action.detail
                changes = {k: getattr(d, k) for k in ("required", "unique") if getattr(d, k)} | {k: getattr(d, k) for k in ("least", "most", "min_length", "max_length") if getattr(d, k) is not None}
                report.table = _set(t, name, **changes, **({"values": d.values} if d.values else {}))
        case "drop_constraints":
            if need(known, "no such field"):
                report.table = _set(t, name, required=False, unique=False, least=None, most=None, min_length=None, max_length=None, values=())
    report.rows = df


def migrate(table: Table, steps: list[Step], rows: DataFrame | None = None, strict: bool = True) -> Report:
    """Applies the steps in order. A step whose version isn't the table's stops the run.

    With ``strict``, losses to readers of the version before are issues too.
    """
    report = Report(table, rows)
    for step in steps:
        if step.table != report.table.name or step.source != report.table.version:
            report.issues.append(f"step {step.table} {step.source} {step.target}: the table is {report.table.name} {report.table.version}")
            break
        before = report.table
        for action in step.actions:
            _apply(report, action)
        report.table = replace(report.table, version=step.target)
        if strict:
            report.issues += compatibility(before, report.table)
    return report


def rewrite_issues(report: Report, key: list[str]) -> DataFrame:
    """Rows of the migrated table that break its declaration."""
    return issues(report.rows, report.table, key)
