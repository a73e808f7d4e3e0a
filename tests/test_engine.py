"""State over cycles, streams, reports, configuration, sources and transforms on small rows."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from syncwright.functions import transforms as T
from syncwright.operators import mapping, origin, progress, state
from syncwright.operators.mapping import FieldMap, Mapping
from syncwright.plans import config, cycle, report
from syncwright.plans import plan as P
from syncwright.sources import fixtures
from syncwright.streaming import deliveries

FIELDS = (FieldMap("email", "email", "mail.primary", transform="email_normalize"), FieldMap("name", "name", "who.first"))
SYNC = P.Sync("contact:left-right", "left", "right", Mapping("contact", FIELDS), ("email",), "newest_wins")


def now():
    return F.expr("timestamp '2026-09-05 12:00:00'")


def peer(spark, side, rows):
    """Canonical records of (id, email, name, second)."""
    docs = [(i, json.dumps({"email": e, "name": n} if side == "left" else {"mail": {"primary": e}, "who": {"first": n}}), s) for i, e, n, s in rows]
    df = spark.createDataFrame(docs, "remote_id string, doc string, second long")
    return P.canonical(df.select("remote_id", F.parse_json("doc").alias("record"), F.timestamp_seconds("second").alias("updated_at")), SYNC, side)


def empty_state(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in state.TABLES.items()}


def deletes(spark, rows=()):
    return spark.createDataFrame(list(rows), "side string, remote_id string")


def changes(plan):
    return sorted((r["action"], r["target"], r["source"], tuple(sorted(r["fields"].items()))) for r in plan.collect())


def written(tables, path):
    """The tables of a cycle in a new folder, as whoever runs one writes them."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


def as_peers(tables, spark):
    """The peers' records after a cycle, as its snapshots say."""
    out = []
    for side in ("left", "right"):
        rows = tables["snapshots"].where(F.startswith("ref", F.lit(side))).select(F.regexp_extract("ref", "/(.*)$", 1).alias("remote_id"), F.timestamp_seconds(F.lit(9)).alias("updated_at"), "fields", "hash")
        out.append(rows.withColumn("key_email", F.expr("substr(fields['email'], 2)")))
    return out


def test_two_cycles_and_a_delete(spark, tmp_path):
    left = peer(spark, "left", [("l1", " Ann@X.test", "Ann", 5), ("l2", "bo@x.test", "Bo", 5), ("l4", "di@x.test", "Di", 50)])
    right = peer(spark, "right", [("r1", "ann@x.test", "Ann", 5), ("r3", "cy@x.test", "Cy", 5), ("r4", "di@x.test", "Dee", 5)])
    tables = empty_state(spark)
    first = P.planned(left, right, tables["links"], tables["snapshots"], SYNC)
    assert changes(first) == [
        ("create", "left", "right:contact/r3", (("email", "scy@x.test"), ("name", "sCy"))),
        ("create", "right", "left:contact/l2", (("email", "sbo@x.test"), ("name", "sBo"))),
        ("update", "right:contact/r4", "left:contact/l4", (("email", "sdi@x.test"), ("name", "sDi"))),
    ]
    decisions = written({"d": P.decided(left, right, tables["links"], tables["snapshots"], SYNC)}, f"{tmp_path}/0")["d"]
    created = spark.createDataFrame([("left:contact/l2", "r2"), ("right:contact/r3", "l3")], "source string, remote_id string")
    after = tables | written(cycle.after(decisions, created, deletes(spark), tables, SYNC, now(), {"right": 60}), f"{tmp_path}/1")
    assert sorted((r["a"], r["b"]) for r in after["links"].collect()) == [("l1", "r1"), ("l2", "r2"), ("l3", "r3"), ("l4", "r4")]
    assert after["snapshots"].count() == 8 and after["keys"].count() == 8
    lives = {r["ref"]: (r["expires_at"] - r["written_at"]).total_seconds() for r in after["origins"].collect()}
    assert lives == {"right:contact/r2": 60, "right:contact/r4": 60, "left:contact/l3": 300}
    assert after["idem"].count() == 3 and after["idem"].where("in_flight").count() == 0

    # nothing is left to do, and what comes back from the peers is an echo
    left, right = as_peers(after, spark)
    assert changes(P.planned(left, right, after["links"], after["snapshots"], SYNC)) == []
    back = after["snapshots"].where("ref in ('right:contact/r2', 'right:contact/r4', 'left:contact/l3', 'left:contact/l1')").select("ref", "hash")
    verdicts = {r["ref"]: r["verdict"] for r in origin.classify(back, after["origins"], now(), ["ref"]).collect()}
    assert verdicts == {"right:contact/r2": "echo", "right:contact/r4": "echo", "left:contact/l3": "echo", "left:contact/l1": "foreign"}

    # a deleted end: one delete, no comparison, and the pair is forgotten
    gone = deletes(spark, [("left", "l2"), ("left", "nobody"), ("right", "r3"), ("left", "l3")])
    plan = P.planned(left.where("remote_id not in ('l2', 'l3')"), right.where("remote_id <> 'r3'"), after["links"], after["snapshots"], SYNC, gone)
    assert changes(plan.where("action = 'delete'")) == [("delete", "right:contact/r2", "left:contact/l2", ()), ("delete", "right:contact/r3", "left:contact/l3", ())]
    last = cycle.after(decisions.limit(0), created.limit(0), gone, after, SYNC, now())
    assert sorted(r["a"] for r in last["links"].collect()) == ["l1", "l4"]
    assert last["snapshots"].count() == 4 and last["keys"].count() == 4


def test_edits_on_both_sides_within_the_tolerance_wait(spark):
    links = spark.createDataFrame([("l1", "r1")], "a string, b string")
    left, right = peer(spark, "left", [("l1", "a@x.test", "Ann", 5)]), peer(spark, "right", [("r1", "a@x.test", "Anna", 6)])
    plan = P.planned(left, right, links, empty_state(spark)["snapshots"], SYNC).collect()
    assert [(r["action"], r["fields"], r["review"] is not None) for r in plan] == [("review", {}, True)]


def test_reports(spark):
    made = spark.createDataFrame(
        [
            ("contact:left-right", "create", "right", "left:contact/l-2", {"email": "sbo@x.test", "score": "n42", "phone": "\x00null"}),
            ("contact:left-right", "update", "left:contact/l-7", "right:contact/r-4", {"first": 'sA "B"'}),
            ("contact:left-right", "delete", "right:contact/r-9", "left:contact/l-9", {}),
        ],
        "sync string, action string, target string, source string, fields map<string,string>",
    )
    open_ = spark.createDataFrame([("left:contact/l-1", "which is newer is not knowable")], "ref string, reason string")
    dead = spark.createDataFrame([("right:contact/r-3", "a rule failed")], "ref string, reason string")
    lines = lambda df: [r["line"] for r in df.collect()]
    assert lines(report.plan_lines(made, open_, dead)) == [
        "contact:left-right", "  create on right", "    from left:contact/l-2", '    email = "bo@x.test"', "    phone = (unset)", "    score = 42",
        "  update left:contact/l-7", "    from right:contact/r-4", '    first = "A \\"B\\""', "  delete right:contact/r-9", "    because left:contact/l-9 was deleted", "",
        "Waiting for a decision (1)", "  left:contact/l-1", "    which is newer is not knowable", "", "Would fail (1)", "  right:contact/r-3", "    a rule failed", "",
        "1 to create, 1 to update, 1 to delete, 1 waiting for a decision, 1 that would fail.",
    ]
    assert lines(report.plan_lines(made.limit(0), open_.limit(0), dead.limit(0))) == ["Nothing to do: both sides already agree."]
    assert lines(report.plan_lines(made.limit(0), open_.limit(0), dead.limit(0), ["right: bad credentials"])) == ["Nothing to report from the peers that answered.", "", "The plan is incomplete. 1 peer error(s):", "  right: bad credentials"]
    first = json.loads(report.plan_json(made.where("action = 'update'")).first()["change"])
    assert first == {"sync": "contact:left-right", "action": "update", "source": {"connector": "right", "kind": "contact", "remote_id": "r-4"}, "target": {"connector": "left", "kind": "contact", "remote_id": "l-7"}, "fields": [{"field": "first", "value": 'A "B"'}]}
    checks = spark.createDataFrame([(1, "connector", "left/contact", True, "4 fields"), (2, "queue", "review queue", False, "2 waiting")], "k long, name string, subject string, ok boolean, detail string")
    assert lines(report.doctor_lines(checks)) == ["ok    connector left/contact  4 fields", "FAIL  queue review queue      2 waiting", "", "1 of 2 checks failed."]
    assert lines(report.doctor_lines(checks.where("ok")))[-1] == "All 1 checks passed."
    assert lines(report.doctor_lines(checks.limit(0))) == ["Nothing to check: no syncs are configured."]


GOOD = {
    "connectors": [{"name": "left", "driver": "fixture", "echo_window": "1m30s"}, {"name": "right", "driver": "fixture"}],
    "syncs": [{"kind": "contact", "left": "left", "right": "right", "identity": {"keys": ["email"]}, "conflict": {"per_field": {"name": "left_wins"}}, "fields": [{"canonical": "email", "left": "email", "right": "mail", "transform": "email_normalize"}, {"canonical": "name", "left": "n", "right": "n", "direction": "left_to_right"}]}],
}


def test_configuration():
    c = config.parsed(json.dumps(GOOD))
    assert c.windows() == {"left": 90, "right": 300} and c.max_attempts == 6
    s = c.syncs[0]
    assert (s.name, s.keys, s.policy, s.per_field, s.on_ambiguous) == ("contact:left-right", ("email",), "review", (("name", "left_wins"),), "review")
    assert s.mapping.writable("left") == ["email"] and s.mapping.writable("right") == ["email", "name"]


def test_configuration_of_rates():
    some = json.loads(json.dumps(GOOD))
    some["connectors"][0]["rate_limit"] = {"rate_per_sec": 0.5, "burst": 3}
    some["connectors"][1].pop("rate_limit", None)
    assert config.parsed(json.dumps(some)).limits() == {"left": (0.5, 3), "right": (5, 10)}
    some["connectors"][0] = "left"
    with pytest.raises(ValueError, match="connectors.0.: wants an object"):
        config.parsed(json.dumps(some))


def test_configuration_reports_all_at_once():
    bad = json.loads(json.dumps(GOOD))
    bad |= {"log_level": "loud", "workers": -1, "colour": 1}
    bad["connectors"][1] = {"name": "left", "driver": "", "echo_window": "soon", "watermark_overlap": "-5s", "rate_limit": {"burst": -1}}
    bad["syncs"][0] |= {"right": "left", "direction": "up", "kind": ""}
    bad["syncs"][0]["fields"] += [{"canonical": "email", "left": "", "right": "x", "transform": "shout"}]
    bad["syncs"][0]["conflict"]["per_field"] = {"age": "oldest_wins"}
    with pytest.raises(ValueError) as e:
        config.parsed(json.dumps(bad))
    said = str(e.value)
    for part in ("colour", "log_level", "workers", "connectors[1].name", "connectors[1].driver", "echo_window", "watermark_overlap", "burst", "syncs[0].kind", "must differ", "syncs[0].direction", "fields[2].canonical", "fields[2].left", "fields[2].transform", "per_field: 'age'", "per_field[age]"):
        assert part in said, part
    with pytest.raises(ValueError, match="not JSON"):
        config.parsed("{")


def test_deliveries_as_a_stream_keep_late_events(spark, tmp_path):
    hour = 3600
    batches = [
        [("d1", 100 * hour), ("d1", 101 * hour), ("", 100 * hour), ("d3", 72 * hour)],
        [("d2", 2 * hour), ("d1", 110 * hour), ("d3", 24 * hour)],
        [("d1", 130 * hour), ("d2", 3 * hour), ("", 1 * hour), ("d3", 72 * hour), ("d3", 24 * hour), ("d3", 25 * hour)],
    ]
    schema = "connector string, delivery string, kind string, remote_id string, at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame([("left", d, "contact", "x", s) for d, s in rows], schema.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = deliveries.once_streaming(stream).writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    began = time.monotonic()
    # expiry by the clock keeps the stream busy for ever, so there is no end to wait for
    while time.monotonic() - began < 70 and sum(p["numInputRows"] for p in run.recentProgress) < 26:
        time.sleep(1)
    run.stop()
    got = sorted((r["delivery"], r["s"]) for r in spark.sql("select delivery, cast(unix_seconds(at) / 3600 as int) as s from taken").collect())
    assert got == [("", 1), ("", 100), ("d1", 100), ("d1", 130), ("d2", 2), ("d3", 24), ("d3", 72)]
    whole = spark.read.schema(schema).parquet(f"{tmp_path}/in/*")
    assert sorted((r["delivery"], r["s"]) for r in deliveries.once(whole).selectExpr("delivery", "cast(unix_seconds(at) / 3600 as int) as s").collect()) == got


def test_deliveries_need_a_right_signature(spark):
    now, body = 1_700_000_000, '[{"kind":"contact","remote_id":"1","deleted":false,"record":"{}"}]'
    sign = lambda b, t: deliveries.signature(b"key", t, b.encode())
    rows = [("a", now, body, sign(body, now)), ("b", now, body, "0" * 64), ("c", now - 9999, body, sign(body, now - 9999)), ("d", now, None, sign("", now)), ("e", now, body, None)]
    df = spark.createDataFrame([("left", *r) for r in rows], "connector string, delivery string, ts long, body string, signature string")
    assert [r["delivery"] for r in deliveries.accepted(df, b"key", F.timestamp_seconds(F.lit(now))).collect()] == ["a"]


def test_sources(spark, tmp_path):
    (tmp_path / "peer.jsonl").write_text('{"id": "1", "updated_at": "2026-01-04T00:00:00Z", "fields": {"email": "a@x"}}\nnot json\n{"id": "2", "fields": {}}\n')
    assert sorted(r["remote_id"] for r in fixtures.build("records", spark, path=str(tmp_path / "peer.jsonl")).collect()) == ["1", "2"]
    whole = {"objects": {"contact": {"fields": [{"name": "email", "type": "string"}, {"name": "made", "type": "datetime", "read_only": True}], "records": [{"id": "1", "fields": {"email": "a@x"}}]}}}
    (tmp_path / "peer.json").write_text(json.dumps(whole))
    peers = fixtures.build_all(spark, {"left": ("fixture", {"file": str(tmp_path / "peer.json"), "kind": "contact"})})
    assert peers["left"].count() == 1
    assert [(r["field"], r["read_only"]) for r in fixtures.fixture_schema(spark, str(tmp_path / "peer.json"), "contact").orderBy("field").collect()] == [("email", False), ("made", True)]
    assert "fixture" in fixtures.drivers()
    with pytest.raises(ValueError, match="nowhere"):
        fixtures.build_all(spark, {"left": ("nowhere", {})})
    with pytest.raises(ValueError, match="already"):
        fixtures.register("fixture", fixtures.fixture)


def test_faults_are_the_same_on_every_run(spark):
    events = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 7).alias("at"), F.lit("r").alias("record"))
    made = lambda: fixtures.with_faults(events, "id", seed=3, duplicate_every=5, bare_every=4, delay_every=6, granularity=60, fail_every=9, clock_offset=30, shuffle=True, rename={"record": "body"})
    one, two = [tuple(r) for r in made().collect()], [tuple(r) for r in made().collect()]
    assert one == two and len(one) > 200
    assert [r[0] for r in one] != sorted(r[0] for r in one)
    assert {r[3] for r in one} == {None, "rate_limited"} and {r[2] for r in one} == {None, "r"}
    assert made().columns == ["id", "at", "body", "error_kind"]


def test_mapping_errors_come_at_once():
    with pytest.raises(ValueError) as e:
        Mapping("contact", (FieldMap("a", "", "y"), FieldMap("a", "x", "y", transform="shout"), FieldMap("b", "x", "y", direction="right_to_left")), "left_to_right")
    for part in ("no left path", "mapped twice", "shout", "leaves no direction"):
        assert part in str(e.value)
    assert mapping.narrow("bidirectional", "left_to_right") == "left_to_right" and mapping.narrow("left_to_right") == "left_to_right"


def test_transforms_are_registered_once_and_in_sql(spark):
    T.register_sql(spark)
    got = spark.sql("select domain_normalize('https://www.Example.com:8443/x') as d, email_normalize(' A.b+c@WWW.Example.com. ') as e").first()
    assert tuple(got) == ("example.com", "a.b+c@example.com")
    with pytest.raises(ValueError):
        T.register("trim", T.trim)


def test_state_helpers(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, None)], "k string, v int, e long").withColumn("expires_at", F.timestamp_seconds("e"))
    at = F.timestamp_seconds(F.lit(5))
    asked, left = state.taken(rows, rows.where("k = 'a'"), ["k"], at)
    assert asked.count() == 0 and [r["k"] for r in left.collect()] == ["b"]
    waits = progress.backoff(F.lit(3), F.lit("x"), F.lit(99_000))
    assert spark.range(1).select(waits.alias("w")).first()["w"] == 99_000
