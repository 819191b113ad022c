"""Runtime manifests: sections with properties, inheritance from a parent section, total shards."""

from __future__ import annotations

import re
from collections.abc import Iterator


def parse(text: str) -> dict[str, dict[str, str]]:
    """``[section]`` lines followed by ``key=value`` words; # starts a comment."""
    sections: dict[str, dict[str, str]] = {}
    current: dict[str, str] | None = None
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        m = re.match(r"\[([^\]]+)\]\s*(.*)", line)
        if m:
            current = sections.setdefault(m[1].strip(), {})
            line = m[2]
        if current is not None:
            for word in line.split():
                if "=" in word:
                    key, value = word.split("=", 1)
                    current[key] = value
    return sections


def emit(sections: dict[str, dict[str, str]]) -> str:
    return "\n".join(" ".join([f"[{name}]", *[f"{k}={v}" for k, v in sorted(p.items())]]) for name, p in sorted(sections.items()))


#: Counts belong to a section itself and aren't inherited.
OWN = ("parent", "shards", "replicas")


def resolve(sections: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """Properties with those of parents filled in; an absent parent is made, its mode deferred."""
    known = {name: dict(p) for name, p in sections.items()}
    for p in list(known.values()):
        if p.get("parent") and p["parent"] not in known:
            known[p["parent"]] = {"mode": "deferred"}
    out: dict[str, dict[str, str]] = {}
    for name in known:
        merged, at, seen = {}, name, set()
        while at in known and at not in seen:
            seen.add(at)
            merged = {k: v for k, v in known[at].items() if at == name or k not in OWN} | merged
            at = known[at].get("parent", "")
        out[name] = merged
    return out


def total_shards(sections: dict[str, dict[str, str]]) -> int:
    return sum(int(p.get("shards", 1)) * int(p.get("replicas", 1)) for name, p in sections.items())


def _lines(text: str) -> Iterator[tuple[list[str], dict[str, str]]]:
    """Plain words and ``key=value`` words of each line that isn't blank or a comment."""
    for line in text.splitlines():
        words = line.split()
        if words and not words[0].startswith("#"):
            yield [w for w in words if "=" not in w], dict(w.split("=", 1) for w in words if "=" in w)


def _number(text: str | None, default: int | None = None) -> int | None:
    return int(text) if text is not None and text.isdecimal() else default


def read_topology(text: str) -> tuple[list[dict], list[dict]]:
    """(nodes, replicas) of a topology, as rows that ``cluster`` works on.

    ``node id zone rack role health [capacity=n] [used=n] [tag=t ...]``; ``shard id size node[:leader][:nonvoting][:log=n] ...``. Tags
    repeat. A later line replaces an earlier one of the same id; lines with too few words are passed over. A replica is online if its
    node is known and online.
    """
    nodes: dict[str, dict] = {}
    shards: dict[str, list[dict]] = {}
    for line in text.splitlines():
        words = line.split()
        if words[:1] == ["node"] and len(words) >= 6:
            named = [w.split("=", 1) for w in words[6:] if "=" in w]
            one = dict(named)
            tags = sorted({v for k, v in named if k == "tag"})
            nodes[words[1]] = dict(zip(("node", "zone", "rack", "role", "health"), words[1:6], strict=True)) | {"capacity": _number(one.get("capacity"), 0), "used": _number(one.get("used"), 0), "tags": tags}
        elif words[:1] == ["shard"] and len(words) >= 4:
            placed = []
            for word in words[3:]:
                node, *marks = word.split(":")
                log = next((m[4:] for m in marks if m.startswith("log=")), None)
                placed.append({"shard": words[1], "size": _number(words[2], 0), "node": node, "voter": "nonvoting" not in marks, "leader": "leader" in marks, "log_index": _number(log, 0)})
            shards[words[1]] = placed
    up = {n for n, p in nodes.items() if p["health"] == "online"}
    return list(nodes.values()), [r | {"online": r["node"] in up} for placed in shards.values() for r in placed]


def read_backups(text: str) -> tuple[list[dict], list[dict]]:
    """(backups, objects) of a backup manifest.

    ``backup id kind [start=n] [end=n] [checkpoint=n] [wal=n-n] [parent=id] [catalog=text]``, followed by its ``object id kind table
    length [shard=s] [offset=n] [checksum=c]`` lines, - for no table. Values that aren't numbers where numbers are due count as 0.
    """
    backups: list[dict] = []
    objects: list[dict] = []
    for words, named in _lines(text):
        if words[0] == "backup" and len(words) >= 3:
            low, dash, high = named.get("wal", "").partition("-")
            span = (int(low), int(high)) if dash and low.isdecimal() and high.isdecimal() else (0, 0)
            times = {k: _number(named.get(k), 0) for k in ("start", "end", "checkpoint")}
            backups.append({"id": words[1], "kind": words[2], **times, "start_lsn": span[0], "end_lsn": span[1], "parent": named.get("parent"), "catalog": named.get("catalog", "")})
        elif words[0] == "object" and backups and len(words) >= 5:
            table = None if words[3] == "-" else words[3]
            objects.append({"backup": backups[-1]["id"], "id": words[1], "kind": words[2], "table": table, "length": _number(words[4], 0), "shard": named.get("shard", ""), "offset": _number(named.get("offset"), 0), "checksum": named.get("checksum", "")})
    return backups, objects


#: Names of a checkpoint policy's settings.
POLICY = ("max_wal_bytes", "max_dirty_pages", "periodic_interval_ms", "min_interval_ms", "max_replica_lag", "full_every_n", "allow_during_backup", "prefer_incremental")


def read_policy(text: str) -> dict[str, int | bool] | None:
    """The settings that a checkpoint policy names, one ``key = value`` a line; None if a number isn't one or no line has an =."""
    out: dict[str, int | bool] = {}
    pairs = [line.split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#")]
    for key, value in ((k.strip(), v.strip()) for k, v in pairs):
        if key in POLICY[6:]:
            out[key] = value.lower() in ("true", "1", "yes", "on")
        elif key in POLICY:
            if not value.isdecimal():
                return None
            out[key] = int(value)
    return out if pairs else None
