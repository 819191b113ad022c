import pytest

from quern.plans import catalog, cluster, dsl, evolution, history, partitions, statistics, telemetry
from quern.sources import manifests
from quern.sources.tables import demo_events, demo_users

USERS = """
table users
field id int required unique min=0
field email string required maxlen=80
field age int default=18 min=0 max=130
field active bool default=true
index users_pk btree id unique
index users_email hash email sparse include=id,active
table events
field id int required
field user_id int required
field kind string required maxlen=32
index events_user composite user_id,kind
"""


@pytest.fixture
def cat():
    return catalog.Catalog(catalog.parse_text(USERS))


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_catalog(spark, cat):
    users = cat.tables["users"]
    assert catalog.parse_text(catalog.emit_text(list(cat.tables.values()))) == list(cat.tables.values())
    assert not cat.create(users) and not cat.create(catalog.Table(""))
    good = spark.createDataFrame([(7, "a@b")], "id long, email string")
    assert rows(catalog.insertable(good, users)) == [(7, "a@b", 18, True)]
    assert catalog.issues(good, users, ["id"]).count() == 0
    bad = spark.createDataFrame([(-1, None, 200), (3, "x" * 81, 1), (3, "y", 1)], "id long, email string, age long")
    assert sorted(rows(catalog.issues(bad, users, ["id"]))) == [
        (-1, "age", "above 130"),
        (-1, "email", "required"),
        (-1, "id", "below 0"),
        (3, "email", "longer than 80"),
        (3, "id", "not unique"),
        (3, "id", "not unique"),
    ]
    wrong = spark.createDataFrame([(1, 5)], "id long, email int")
    assert ("email", "string expected") in {x[1:] for x in rows(catalog.issues(wrong, users, ["id"]))}
    other = catalog.Catalog(catalog.parse_text(USERS.replace("maxlen=80", "maxlen=90").replace("table events", "table logs")))
    assert cat.difference(other) == {"added": ["logs"], "removed": ["events"], "changed": ["users"]}
    assert catalog.table_issues(catalog.Table("t", (), (catalog.Index("i", "btree", ("a",)),))) == ["index i: no field a"]
    assert "index users_pk" in catalog.describe(users)


def test_migration(spark, cat):
    users = catalog.Table("users", (catalog.Field("id", "int"), catalog.Field("score", "int")))
    text = "step users 1 2\nadd_field active bool default=true\nadd_index users_score score"
    assert evolution.emit(evolution.parse(text)) == text
    report = evolution.migrate(users, evolution.parse(text), spark.createDataFrame([(1, 5)], "id long, score long"))
    assert report.success and report.table.version == 2 and report.rebuilt == 1 and rows(report.rows) == [(1, 5, True)]
    more = "step users 2 3\nrename_field score points\nchange_type points string\nset_default points 0\nadd_constraint points maxlen=3\ndrop_field id\ndrop_index users_score"
    later = evolution.migrate(report.table, evolution.parse(more), report.rows, strict=False)
    assert later.success and rows(later.rows) == [("5", True)] and later.table.indexes == ()
    assert evolution.rewrite_issues(later, ["points"]).count() == 0
    assert not evolution.migrate(report.table, evolution.parse(more), report.rows).success  # readers lose fields
    assert evolution.migrate(users, evolution.parse("step users 5 6\ndrop_field id")).issues
    assert evolution.migrate(users, evolution.parse("step users 1 2\ndrop_field gone")).issues == ["drop_field gone: no such field"]
    assert evolution.compatibility(users, catalog.Table("users", (catalog.Field("id", "string"), catalog.Field("new", "int", required=True)))) == [
        "field id: int became string",
        "field score removed",
        "new field new is required without a default",
    ]


def test_pipeline(spark):
    tables = {"users": demo_users(spark), "events": demo_events(spark)}
    plan = dsl.parse_pipeline("load|users\nfilter|score > 10\nproject|id,score,region,group\nwindow|group|rows|2\nunknown|x")
    found = {x["id"]: x["window_total"] for x in dsl.run_pipeline(tables, plan, ["id"]).collect()}
    assert found[2] == 14 + 35 and found[3] == 21 + 42 and len(found) == 10
    joined = dsl.run_pipeline(tables, dsl.parse_pipeline("load|users\njoin|events|id"), [])
    assert joined.count() == 32 and "event_kind" in joined.columns
    assert dsl.run_pipeline(tables, dsl.parse_pipeline("load|nowhere"), []).count() == 0
    assert dsl.run_pipeline(tables, dsl.parse_pipeline("load|users\nproject|id\npreview|gray"), []).count() == 13


def test_transform(spark):
    df = spark.range(10).selectExpr("id", "IF(id % 2 = 0, 'west', 'east') AS region", "id % 3 = 0 AS active")
    text = "project=id,region|filter=id>3|limit=3"
    assert dsl.emit_transform(dsl.parse_transform(text)) == text
    made, issues = dsl.run_transform(df, dsl.parse_transform(text), ["id"])
    assert rows(made) == [(4, "west"), (5, "east"), (6, "west")] and issues == []
    made, issues = dsl.run_transform(df, dsl.parse_transform("project=id,gone|filter=lost=1"))
    assert made.count() == 0 and issues == ["no column lost", "no column gone"]


def test_workload(spark, cat):
    text = """insert|users|doc=id=7,email=a@b
find|users|where=id=7|project=id,email
update|users|where=id=7|set=age=30
aggregate|events|where=user_id=7|agg=id
delete|users|where=age>=30"""
    plans = [dsl.plan(s, cat) for s in dsl.parse_workload(text)]
    assert all(p.accepted for p in plans) and plans[1].index == "users_pk" and plans[1].cost < plans[4].cost
    assert [k for k, *_ in plans[0].steps][:2] == ["validate", "defaults"] and plans[0].steps[0][2:] == (1, 4)
    assert [k for k, *_ in plans[1].steps] == ["lookup", "filter", "project"] and plans[2].steps[-1][0] == "update" and plans[2].steps[-1][3] == 8
    assert plans[3].steps[-1][0] == "aggregate" and plans[3].steps[-1][3] == 25 and plans[4].steps[-1][0] == "delete" and plans[4].steps[-1][3] == 7
    assert all(p.cost == sum(c for *_, c in p.steps) for p in plans)
    assert "users_pk" in plans[1].explain()
    bad = [dsl.plan(s, cat).diagnostics for s in dsl.parse_workload("find|nowhere\nfind|users|where=id=x|project=gone\ninsert|users|doc=id=1")]
    assert bad == [["no table nowhere"], ["no field gone", "id: int expected"], ["email is required"]]
    df = spark.createDataFrame([(7, 30), (8, 29)], "id long, age long")
    s = dsl.parse_workload("insert|t|doc=id=9\nupdate|t|where=id=7|set=age=31\ndelete|t|where=age>=30\nscan|t|limit=1")
    assert [dsl.execute(x, df).count() for x in s] == [3, 2, 1, 1]
    assert sorted(rows(dsl.execute(s[1], df))) == [(7, 31), (8, 29)]


def test_batch():
    tasks = dsl.parse_batch("task|validate|1\ntask|plan|3|validate\ntask|checkpoint|2|plan|1\ntask|metrics|1|plan\ntask|lost|1|nowhere\ntask|a|1|b\ntask|b|1|a")
    assert dsl.dry_run(tasks) == ([["validate"], ["plan"], ["checkpoint", "metrics"]], 7, ["a", "b", "lost"])
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise OSError

    events = dsl.run_batch(tasks, {"checkpoint": flaky})
    assert ("checkpoint", "done", 2) in events and ("lost", "failed", 0) in events

    def broken():
        raise OSError

    assert dict((n, s) for n, s, _ in dsl.run_batch(tasks[:4], {"plan": broken})) == {"validate": "done", "plan": "failed", "checkpoint": "skipped", "metrics": "skipped"}


def test_manifest():
    text = "[base]\nshards=2\nreplicas=2\nmode=primary\n[analytics]\nparent=base\nshards=3\n[lost]\nparent=nowhere"
    made = manifests.resolve(manifests.parse(text))
    assert made["analytics"]["mode"] == "primary" and made["lost"]["mode"] == "deferred"
    assert manifests.total_shards(manifests.parse(text.split("[lost]")[0])) == 7
    assert manifests.parse(manifests.emit(manifests.parse(text))) == manifests.parse(text)


def test_partitions(spark, tmp_path):
    ranges = partitions.Ranges("salary", (("p_low", 0, 5000), ("p_high", 5001, 15000)))
    df = spark.createDataFrame([(1, 4000), (2, 8000), (3, 99999), (4, None)], "id int, salary int")
    rejected = partitions.write(df, ranges, str(tmp_path / "r"))
    assert sorted(x[0] for x in rows(rejected)) == [3, 4]
    stored = spark.read.parquet(str(tmp_path / "r"))
    found = partitions.read_where(stored, ranges, "salary", ">", 6000)
    assert [x["id"] for x in found.collect()] == [2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "p_high" in plan
    assert ranges.prune("salary", "=", 5000) == {"p_low"} and ranges.prune("salary", "<", 5001) == {"p_low"} and ranges.prune("other", "=", 1) == ranges.labels()
    lists = partitions.Lists("dept", (("eng", ("Engineering", "R&D")), ("sales", ("Sales", "Marketing"))))
    assert lists.prune("dept", "=", "R&D") == {"eng"} and lists.prune("dept", ">", "R&D") == lists.labels()
    assert partitions.keep(ranges, ("and", ("salary", ">", 6000), ("or", ("salary", "=", 10), ("salary", ">", 1)))) == {"p_high"}
    hashed = partitions.Hashed("id", 4)
    partitions.write(df, hashed, str(tmp_path / "h"))
    one = partitions.read_where(spark.read.parquet(str(tmp_path / "h")), hashed, "id", "=", 3)
    assert [x["id"] for x in one.collect()] == [3]


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    for name in ("b1", "b2"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.bucketBy(4, "k").option("path", str(tmp_path / name)).mode("overwrite").saveAsTable(name)
    plan = spark.table("b1").join(spark.table("b2").hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for name in ("b1", "b2"):
        spark.sql(f"DROP TABLE {name}")


def test_statistics(spark):
    assert statistics.selectivity(80, 0, 100, ">", 50) == 0.5 and statistics.selectivity(80, 0, 100, "=", 20) == 0.0125
    assert statistics.combine("and", 0.5, 0.5) == 0.25 and statistics.combine("or", 0.5, 0.5) == 0.75 and statistics.join_selectivity(10, 20) == 0.05
    df = spark.createDataFrame([(1,), (5,), (10,), (11,), (None,)], "x int")
    assert sorted(rows(statistics.equi_width(df, "x", 0, 10, 2))) == [(0, 1), (1, 2)]
    assert rows(statistics.column_stats(df, ["x"])) == [("x", 5, 4, 1, "1", "11")]
    bounds = rows(statistics.equi_depth_bounds(spark.range(1000), "id", 4))
    assert [b for b, _ in bounds] == [0, 1, 2, 3] and abs(bounds[1][1] - 500) < 10
    probe = spark.range(200).withColumnRenamed("id", "v")
    passed = {x[0] for x in rows(statistics.bloom_may_contain(spark.range(50), "id", probe, "v", 1000))}
    assert set(range(50)) <= passed and len(passed) < 60
    coded = statistics.delta_encode(spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "i int, x int"), "x", ["i"])
    assert [x["value"] for x in sorted(statistics.delta_decode(coded, ["i"]).collect())] == [5, 3, 9]
    runs = statistics.run_length(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "i int, x string"), "x", ["i"])
    assert sorted(rows(runs)) == [(1, "a", 2), (2, None, 2), (3, "a", 1)]
    assert statistics.approximate_stats(spark.range(100), ["id"]).first()[0] > 80


def test_telemetry(spark):
    df = spark.createDataFrame([("g", 42.0, 1), ("g", 50.0, 2)], "name string, value double, seq int")
    assert rows(telemetry.gauges(df, ["name"], "value", "seq")) == [("g", 50.0)]
    seen = spark.createDataFrame([(7.5,), (80.0,), (500.0,), (1.0,)], "value double")
    h = telemetry.histogram(seen, "value", [1, 10, 100])
    assert sorted(rows(h), key=str) == [(1.0, 1, 1.0), (10.0, 1, 7.5), (100.0, 1, 80.0), (None, 1, 500.0)]
    assert sorted(rows(telemetry.merge_histograms([h, h])), key=str)[0] == (1.0, 2, 2.0)
    spans = spark.createDataFrame([(1, 10, 0), (2, 10, 20), (3, 10, 11)], "id int, start_ms int, end_ms int")
    assert [x[0] for x in rows(telemetry.slow_spans(spans, 5))] == [2]
    assert telemetry.parse("counter|c|1|a=b\nnoise\ngauge|g|2") == [("counter", "c", {"a": "b"}, 1.0), ("gauge", "g", {}, 2.0)]


def test_history_and_cluster(spark):
    log = spark.createDataFrame([(1, 10, "a", 1), (2, 20, "a", 2), (3, 10, "b", 3)], "lsn int, tx int, k string, v int")
    assert sorted(rows(history.snapshot(log, "k", "lsn", 1, ["v"]))) == [("a", 1, 1)]
    done = spark.createDataFrame([(10,)], "tx int")
    assert sorted(rows(history.recover(log, "tx", "k", "lsn", done, ["v"]))) == [("a", 1, 1), ("b", 3, 3)]
    assert rows(history.losers(log, "tx", done)) == [(20,)]
    assert history.rollback_to(log, "tx", "lsn", 10, 1).count() == 2
    assert cluster.wait_circles(spark, spark.createDataFrame([(1, 2), (2, 3)], "waiter int, holder int")).count() == 0


def test_failover_of_an_offline_leader(spark):
    nodes = spark.createDataFrame(
        [("s1", "n1", True, True, True, 100), ("s2", "n4", False, True, True, 100), ("s2", "n2", True, True, False, 60)],
        "shard string, node string, online boolean, voter boolean, leader boolean, log_index int",
    )
    assert rows(cluster.failover(nodes)) == [("s2", "n2", False)]


def test_long_chains_and_circles(spark):
    ids = [f"b{i}" for i in range(12)]
    chain = [(i, p, 10 * k, 10 * k + 10) for k, (p, i) in enumerate(zip([None, *ids], ids, strict=False))]
    found = rows(cluster.restore_plan(spark, spark.createDataFrame(chain, "id string, parent string, start_lsn int, end_lsn int"), "b11"))
    assert [x[0] for x in found] == ids
    edges = [(i, (i + 1) % 70) for i in range(70)] + [(100, 0), (5, 200), (300, 301), (301, 300), (400, 400)]
    made = cluster.wait_circles(spark, spark.createDataFrame(edges, "waiter int, holder int"))
    assert sorted(x[0] for x in rows(made)) == [*range(70), 300, 301, 400]


def test_depth_histogram_and_estimates(spark):
    import random

    rng = random.Random(3)
    for values, k in (([rng.randrange(50) for _ in range(997)], 7), ([5] * 40 + [1, 9], 4), ([3, 1, 2], 5), ([2.5, None, 2.5], 2)):
        df = spark.createDataFrame([(v,) for v in values], "x double" if isinstance(values[0], float) else "x int")
        got = sorted(rows(statistics.equi_depth(df, "x", k)))
        known = sorted(v for v in values if v is not None)
        want, at = [], 0
        for b in range(k):
            n = len(known) // k + (b < len(known) % k)
            if n:
                want.append((b + 1, known[at], known[at + n - 1], n))
            at += n
        assert got == want
    even = statistics.equi_depth(spark.range(1000), "id", 10)
    assert abs(rows(statistics.depth_selectivity(even, "<", 250))[0][0] - 0.25) < 0.01
    assert abs(rows(statistics.depth_selectivity(even, "=", 250))[0][0] - 0.001) < 0.0002
    bits, hashes = statistics.bloom_size(1000, 0.01)
    assert abs(statistics.bloom_rate(bits, hashes, 1000) - 0.01) < 0.001 and statistics.bloom_rate(bits, hashes, 0) == 0


def test_backups_and_rebalance(spark):
    made = spark.createDataFrame([("a", "f1", None, 0, 9), ("a", "i1", "f1", 9, 12), ("b", "f2", None, 20, 30), ("c", "f3", None, 40, 41)], "chain string, id string, parent string, start_lsn int, end_lsn int")
    assert sorted(x[1] for x in rows(cluster.kept_backups(made, 2))) == ["f2", "f3"]
    nodes = spark.createDataFrame([("s1", "n1", True), ("s2", "n1", True), ("s3", "n1", True), ("s1", "n2", True), ("s9", "n3", False)], "shard string, node string, online boolean")
    assert sorted(rows(cluster.rebalance(nodes))) == [("n1", 3, 1), ("n2", 1, 0)]


def test_checkpoints(spark):
    columns = "id int, shutdown boolean, since_last int, backup_requested boolean, wal_records int, dirty_pages int, replica_lag int, checkpoints_done int"
    signals = [
        (1, True, 0, False, 0, 700, 0, 1), (2, False, 5, True, 9999, 700, 0, 1), (3, False, 40, True, 0, 700, 0, 1), (4, False, 40, False, 2000, 700, 0, 4),
        (5, False, 40, False, 2000, 700, 0, 3), (6, False, 40, False, 0, 50, 99, 3), (7, False, None, False, 0, 3, 0, 0), (8, False, 40, False, 0, 0, 0, 0), (9, False, 40, False, 0, 700, 0, 0),
    ]
    made = cluster.checkpoint_decisions(spark.createDataFrame(signals, columns)).select("id", "reason", "mode", "flush_pages")
    assert sorted(rows(made)) == [
        (1, "shutdown", "consistent", 700), (2, "wait", "none", 0), (3, "backup", "consistent", 700), (4, "wal", "full", 700), (5, "wal", "incremental", 256),
        (6, "replica", "light", 50), (7, "periodic", "incremental", 3), (8, "none", "none", 0), (9, "dirty", "incremental", 256),
    ]
    plain = cluster.checkpoint_decisions(spark.createDataFrame(signals, columns), full_every=0, prefer_incremental=False, during_backup=False)
    assert [(x[0], x[1]) for x in sorted(rows(plain.select("id", "reason", "mode")))[2:5]] == [(3, "dirty"), (4, "wal"), (5, "wal")]
    past = spark.createDataFrame([(1, 10, "full", 5), (2, 20, "light", 15), (3, 30, "light", 25), (4, 30, "light", 26), (5, 40, "incremental", 35)], "id int, at int, mode string, wal_start int")
    kept = cluster.checkpoint_retention(past, 2, 0, 100)
    assert sorted(x[0] for x in rows(kept.where("kept").select("id"))) == [1, 4, 5] and rows(cluster.reclaimable_log(kept)) == [(5,)]
    assert cluster.checkpoint_retention(past, 0, 71, 100).where("kept").count() == 4
    assert cluster.checkpoint_retention(past.limit(0), 2, 0, 100).count() == 0


def test_text_readers(spark):
    nodes, replicas = manifests.read_topology("# c\nnode a z1 r1 storage online capacity=9 used=x tag=ssd tag=big\nnode b z2 r1 storage offline\nnode short\nshard s 5 a:leader:log=12 b:nonvoting c\nnoise")
    assert [(n["node"], n["capacity"], n["used"], n["tags"]) for n in nodes] == [("a", 9, 0, ["big", "ssd"]), ("b", 0, 0, [])]
    assert [(r["node"], r["leader"], r["voter"], r["online"], r["log_index"]) for r in replicas] == [("a", True, True, True, 12), ("b", False, False, False, 0), ("c", False, True, False, 0)]
    assert cluster.failover(spark.createDataFrame(replicas)).count() == 0 and manifests.read_topology("") == ([], [])
    backups, objects = manifests.read_backups("object lost page t 1\nbackup f full wal=0-9 end=x\nobject o1 page - 64 shard=s offset=8\nbackup i incremental parent=f wal=9-z")
    assert [(b["id"], b["parent"], b["start_lsn"], b["end_lsn"]) for b in backups] == [("f", None, 0, 9), ("i", "f", 0, 0)]
    assert [(o["backup"], o["table"], o["length"], o["offset"]) for o in objects] == [("f", None, 64, 8)]
    assert manifests.read_policy("# p\nfull_every_n = 3\nprefer_incremental=yes\nother=1") == {"full_every_n": 3, "prefer_incremental": True}
    assert manifests.read_policy("full_every_n=many") is None and manifests.read_policy("") is None


def test_report_and_frames(spark):
    samples = spark.createDataFrame([("counter", "c", 1.0, 1), ("counter", "c", 2.0, 2), ("gauge", "g", 5.0, 3), ("gauge", "g", 4.0, 4), ("noise", "n", 1.0, 5)], "kind string, name string, value double, at int")
    spans = spark.createDataFrame([("read", 10, 30), ("open", 10, 0), ("back", 9, 5)], "operation string, start_ms int, end_ms int")
    assert sorted(rows(telemetry.report(samples, spans, 10))) == [("counter", "c", 2, 3.0), ("gauge", "g", 2, 4.0), ("slow_span", "read", 1, 20.0)]
    assert sorted(rows(telemetry.report(samples, spans, 0, since=3))) == [("gauge", "g", 1, 4.0), ("slow_span", "back", 1, 0.0), ("slow_span", "read", 1, 20.0)]
    frames = spark.createDataFrame([(1,), (2,), (None,)], "type int")
    assert rows(history.missing_frame_types(frames, "type", ["log", "catalog"])) == [("catalog",)]
    assert history.missing_frame_types(frames.limit(0), "type", ["log", "catalog"]).count() == 2
