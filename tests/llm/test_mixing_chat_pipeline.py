"""Mixing, tool calls and the pipeline."""

import json
from collections import Counter

import pytest

from quern.llm import mixing, tool_calls


def edf(weights, slots):
    """Brute force: at each slot the earliest deadline among the released blocks."""
    whole, done, order = sum(weights.values()), Counter(), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * whole // w), s) for s, w in weights.items() if done[s] * whole // w <= t]
        _, s = min(ready)
        order.append(s)
        done[s] += 1
    return order


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2}, {"a": 7, "b": 5, "c": 1}, {f"s{i}": i + 1 for i in range(9)}])
def test_period(weights):
    whole = sum(weights.values())
    slots = {slot: s for s, turns in mixing.period(weights).items() for slot, _, _ in turns}
    order = edf(weights, whole)
    assert [slots[t] for t in range(whole)] == order
    done = Counter()
    for t, s in enumerate(order):
        done[s] += 1
        assert all(abs(done[k] - (t + 1) * w / whole) < 1 for k, w in weights.items())
    assert all(release <= slot < due for turns in mixing.period(weights).values() for slot, release, due in turns)


def brute_order(blocks, weights):
    left, out = dict(blocks), []
    while any(left.values()):
        active = {s: w for s, w in weights.items() if left.get(s)}
        for s in edf(active, 10_000):
            out.append(s)
            left[s] -= 1
            if not left[s]:
                break
    return out


def test_mix(spark):
    weights = {"a": 3, "b": 2, "c": 1}
    rows = [(i, "abcdx"[i % 5] if i % 7 else None, "kept") for i in range(2000)] + [(None, "a", "kept"), (3, "d", "kept"), (3, "d", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, source string, position string")
    found = mixing.mix(df, weights, block_rows=16).collect()
    assert len(found) == len(rows) and len({r["position"] for r in found}) == len(rows)
    counts = Counter(r["stream"] for r in found)
    assert counts[""] == sum(s not in weights for _, s, _ in rows)
    slots = {}
    for r in found:
        assert slots.setdefault(r["slot"], r["stream"]) == r["stream"] and r["release"] <= r["slot"] < r["deadline"]
    full = {mixing.OTHER: 1} | weights
    assert [slots[t] for t in range(len(slots))] == brute_order({s: -(-n // 16) for s, n in counts.items()}, full)
    assert mixing.mix(df.where("false"), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})


def test_mixing_stage_keeps_rows_in_order(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    made = mixing.mixing_stage(spark, docs, tiny)
    assert made.columns == docs.columns and made.count() == docs.count() and made.exceptAll(docs).count() == 0
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert [r.doc_id for r in made.collect()] == want


def test_tool_calls(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", 'What "is" é\n{x}?'),
        (1, 1, "assistant", j({"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "c2", "name": "weather", "arguments": {"days": "two", "z": 1}}]})),
        (1, 2, "tool", j({"tool_call_id": "c1", "content": {"b": 1, "a": [1.5, None, True]}})),
        (1, 3, "tool", j({"tool_call_id": "c9", "content": "?"})),
        (2, 0, "tool", j({"tool_call_id": "a", "content": "early"})),
        (2, 1, "assistant", j({"tool_calls": [{"id": "a", "name": "nope", "arguments": {}}]})),
        (2, 2, "assistant", j({"tool_calls": [{"id": "b", "name": "fetch", "arguments": {"url": {"$from": "a"}}}]})),
        (2, 3, "tool", j({"tool_call_id": "b"})),
        (3, 0, "assistant", j({"tool_calls": [{"id": "p", "name": "fetch", "arguments": {"url": {"$from": "q"}}}]})),
        (3, 1, "tool", j({"tool_call_id": "p"})),
        (3, 2, "assistant", j({"tool_calls": [{"id": "q", "name": "fetch", "arguments": {"url": {"$from": "p"}}}]})),
        (3, 3, "tool", j({"tool_call_id": "q"})),
        (4, 0, None, None),
        (None, 1, "user", "x"),
        (4, None, "user", "y"),
        (4, 1, "assistant", '{"tool_calls": 5}'),
        (4, 2, "assistant", '{"tool_calls": [{"id":"m"}]}'),
        (4, 3, "assistant", "{broken"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, status string")
    found = {(r.conv_id, r.turn): r for r in tool_calls.format_chat(df).collect()}
    assert len(found) == len(rows)
    status = {k: r.status for k, r in found.items()}
    assert [status[1, t] for t in range(4)] == ["plain", "unanswered", "result", "orphan"]
    assert [status[2, t] for t in range(4)] == ["result", "call", "call", "result"]
    assert {status[3, t] for t in range(4)} == {"circular"}
    assert status[4, 1] == status[4, 3] == "plain" and status[4, 2] == "unanswered"
    assert found[1, 1].errors == "days is not integer; missing city; unknown z"
    assert found[2, 1].errors == "no tool nope" and found[2, 2].errors == "" and found[4, 2].errors == "arguments are not an object"
    # The early result follows its call.
    assert (found[2, 0].after, found[2, 0].depth) == (1, 1) and (found[2, 1].after, found[2, 1].depth) == (1, 0)
    assert json.loads(found[1, 0].json) == {"content": 'What "is" é\n{x}?', "role": "user"}
    assert found[1, 2].json == '{"content":{"content":{"a":[1.5,null,true],"b":1},"tool_call_id":"c1"},"role":"tool"}'
    assert found[4, 0].json == '{"content":"","role":null}'
    assert tool_calls.format_chat(df.where("false")).count() == 0


def test_chat_query(spark, tiny):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    found = tool_calls.op9_tool_calls(spark, tiny)
    want = con.execute(tool_calls.OP9_SQL)
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in found.select(*columns).fillna("", ["call_id"]).collect()) == sorted(tuple("" if c == "call_id" and v is None else v for c, v in zip(columns, r, strict=True)) for r in want.fetchall())


def test_pipeline(spark, tiny):
    import corpus_pipeline
    from quern.llm import toxicity
    from test_dedup_and_joins import classes

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "shingle_join", "mixing", "piece_codec"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    scorer = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{tiny}/labels.parquet")))
    kept = [(r.doc_id, r.text or "") for r in toxicity.score(docs, scorer).where("score < 0.3").collect()]
    last = {}
    for i, t in sorted(kept):
        last[t] = i
    unique = sorted((i, t) for t, i in last.items())
    survivors = {i for i, _, c in classes(unique) if i == c}
    found = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in found} == survivors and len(found) == len(survivors)
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_order_of_the_mix_survives_files(spark, small):
    from quern.llm.common import Written
    from quern.llm.piece_codec import codec_stage

    docs = spark.read.parquet(f"{small}/documents.parquet")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        written = Written(mixing.mixing_stage(spark, docs, small), "stage").read()
        assert len(written.inputFiles()) > 1
        made = codec_stage(spark, written, small).select("doc_id", "position").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert [r.doc_id for r in sorted(made, key=lambda r: r.position)] == want
    assert sorted(r.position for r in made) == list(range(len(want)))


def brute_places(edges):
    """(after, depth), or None on a circle or behind one: longest paths from the largest turn above a message."""
    above = {}
    for s, t in edges:
        above.setdefault(t, set()).add(s)
        above.setdefault(s, set())
    reach = {v: {v} for v in above}
    for _ in above:
        reach = {v: reach[v].union(*[reach[s] for s in above[v]]) for v in above}
    after, depth = {v: max(r) for v, r in reach.items()}, {}
    for _ in above:
        for v in above:
            near = [s for s in above[v] if after[s] == after[v]]
            if v not in depth and all(s in depth for s in near):
                depth[v] = max([depth[s] + 1 for s in near], default=0)
    return {v: (after[v], depth[v]) if v in depth else None for v in above}


def test_places(spark):
    import random

    rng = random.Random(11)
    graphs = [[(200 - i, 199 - i) for i in range(200)]]  # newest first: 200 links
    graphs.append([(300, 1), *[(i, i + 1) for i in range(1, 250)]])  # forward behind one backward link
    graphs.append([(3, 1), (1, 2), (2, 3), (3, 4), (4, 9), (9, 5), (5, 6), (2, 7), (8, 0), (0, 1)])  # a circle, and messages behind it
    for _ in range(150):
        n = rng.randint(2, 9)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))}
        graphs.append([(s, t) for s, t in pairs if s != t])
    rows = [(c, s, t) for c, g in enumerate(graphs) for s, t in g]
    found = {(r.conv_id, r.turn): r for r in tool_calls._places(spark.createDataFrame(rows, "conv_id long, source long, turn long")).collect()}
    for c, g in enumerate(graphs):
        for v, want in brute_places(g).items():
            r = found.get((c, v))
            got = (v, 0) if r is None else None if r.circular else (r.after, r.depth)
            assert got == want, (c, g, v)
    assert found[0, 0].after == 200 and found[0, 0].depth == 200
