"""No record has two partners; candidates are counted, not listed; links that lead nowhere are dropped; creates are known again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from syncwright.operators import identity, progress
from syncwright.plans import cycle
from syncwright.plans import plan as P
from test_engine import SYNC, changes, deletes, empty_state, now, peer

KEYS = "id string, email string, phone string, tax string"


def test_counts_equal_lists_of_candidates(spark):
    rng = random.Random(4)
    some = lambda k: rng.choice([None, "", *map(str, range(k))])
    near = spark.createDataFrame([(f"l{i}", some(6), some(9), some(40)) for i in range(150)], KEYS)
    far = spark.createDataFrame([(f"r{i}", some(30), some(40), some(40)) for i in range(60)], KEYS)
    keys = ["email", "phone", "tax"]
    for own in (keys[:1], keys[:2], keys):
        want = {r["id"]: (len(r["candidates"]), r["candidates"][0] if len(r["candidates"]) == 1 else None, r["matched_on"]) for r in identity.candidates(near, far, "id", "id", own).collect()}
        assert {r["id"]: (r["n"], r["one"], r["matched_on"]) for r in identity.counted(near, far, "id", "id", own).collect()} == want
    assert {n for n, _, _ in want.values()} >= {1, 2, 3}


def test_a_key_that_all_records_share_makes_no_long_row(spark):
    many = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.lit("same").alias("email"))
    found = identity.counted(many, many, "id", "id", ["email"])
    assert found.where("n = 200000 and one is null").count() == 200_000
    assert "collect_set(far" not in found._jdf.queryExecution().toString()


def ends(plan):
    return sorted((r["l_id"], r["r_id"], r["outcome"]) for r in plan.collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_contested_matches_wait(spark, order):
    """Two records on the right answer to one on the left: whoever comes first, nothing is written."""
    right = [("r1", "ann@x.test", "One", 5), ("r2", "ann@x.test", "Two", 5), ("r3", "bo@x.test", "Bo", 5)]
    left, far = peer(spark, "left", [("l1", "ann@x.test", "Ann", 9), ("l3", "bo@x.test", "Bob", 90)]), peer(spark, "right", [right[k] for k in order])
    tables = empty_state(spark)
    decisions = P.decided(left, far, tables["links"], tables["snapshots"], SYNC)
    assert ends(decisions.fillna("")) == [("", "r1", "review"), ("", "r2", "review"), ("l1", "", "review"), ("l3", "r3", "matched")]


def test_a_linked_record_is_nobody_elses_partner(spark):
    links = spark.createDataFrame([("l1", "r1")], "a string, b string")
    left = peer(spark, "left", [("l1", "ann@x.test", "Ann", 5), ("l2", "ann@x.test", "Ann B", 5)])
    right = peer(spark, "right", [("r1", "ann@x.test", "Ann", 5)])
    decisions = P.decided(left, right, links, empty_state(spark)["snapshots"], SYNC).fillna("")
    assert ends(decisions) == [("l1", "r1", "linked"), ("l2", "", "review")]
    after = cycle.after(P.decided(left, right, links, empty_state(spark)["snapshots"], SYNC), spark.createDataFrame([], "source string, remote_id string"), deletes(spark), empty_state(spark) | {"links": links.withColumn("linked_at", now())}, SYNC, now())
    assert [(r["a"], r["b"]) for r in after["links"].collect()] == [("l1", "r1")]


def test_states_hold_a_record_once(spark):
    """Many records with few key values: after a cycle no ref is twice in links, snapshots or keys."""
    rng = random.Random(1)
    rows = lambda s, n: [(f"{s}{i}", f"{rng.randrange(60)}@x.test", f"N{rng.randrange(3)}", rng.randrange(100)) for i in range(n)]
    left, right = peer(spark, "left", rows("l", 50)), peer(spark, "right", rows("r", 50))
    tables = empty_state(spark)
    decisions = P.decided(left, right, tables["links"], tables["snapshots"], SYNC)
    created = P.standing(decisions, None, SYNC)[0].where("outcome = 'create'").select(F.coalesce(*P.refs(SYNC)).alias("source"), F.concat(F.lit("n"), F.coalesce("l_id", "r_id")).alias("remote_id"))
    after = cycle.after(decisions, created, deletes(spark), tables, SYNC, now())
    links = [(r["a"], r["b"]) for r in after["links"].collect()]
    assert links and len({a for a, _ in links}) == len({b for _, b in links}) == len(links)
    for name, key in (("snapshots", ["ref"]), ("keys", ["ref", "key_name"]), ("idem", ["key"])):
        assert after[name].groupBy(*key).count().where("count > 1").isEmpty(), name
    assert after["snapshots"].count() == 2 * len(links)


def test_a_link_that_leads_nowhere_is_dropped_and_the_record_created_anew(spark):
    tables = empty_state(spark)
    tables["links"] = spark.createDataFrame([("l1", "gone"), ("l2", "r2"), ("l3", "deleted")], "a string, b string").withColumn("linked_at", now())
    tables["snapshots"] = spark.createDataFrame([("right:contact/gone", "h", {"email": "sann@x.test"})], "ref string, hash string, fields map<string,string>").withColumn("at", now())
    left = peer(spark, "left", [("l1", "ann@x.test", "Ann", 5), ("l2", "bo@x.test", "Bo", 5), ("l3", "cy@x.test", "Cy", 5)])
    right = peer(spark, "right", [("r2", "bo@x.test", "Bo", 5)])
    gone = deletes(spark, [("right", "deleted")])
    plan = P.planned(left, right, tables["links"], tables["snapshots"], SYNC, gone)
    assert changes(plan) == [("create", "right", "left:contact/l1", (("email", "sann@x.test"), ("name", "sAnn"))), ("delete", "left:contact/l3", "right:contact/deleted", ())]
    decisions = P.decided(left, right, tables["links"], tables["snapshots"], SYNC)
    answer = spark.createDataFrame([("left:contact/l1", "r9")], "source string, remote_id string")
    after = cycle.after(decisions, answer, gone, tables, SYNC, now())
    assert sorted((r["a"], r["b"]) for r in after["links"].collect()) == [("l1", "r9"), ("l2", "r2")]
    assert "right:contact/gone" not in {r["ref"] for r in after["snapshots"].collect()}


def test_a_create_that_is_tried_again_is_known(spark):
    """Its key needs no id from the peer, so a second try finds the first one's answer."""
    tables = empty_state(spark)
    left, right = peer(spark, "left", [("l1", "ann@x.test", "Ann", 5)]), peer(spark, "right", [])
    decisions = P.decided(left, right, tables["links"], tables["snapshots"], SYNC)
    keys = []
    for new in ("r1", "r2"):
        answer = spark.createDataFrame([("left:contact/l1", new)], "source string, remote_id string")
        idem = cycle.after(decisions, answer, deletes(spark), tables, SYNC, now())["idem"].collect()
        assert [(r["remote_id"], r["created"]) for r in idem] == [(new, True)]
        keys.append(idem)
    assert keys[0][0]["key"] == keys[1][0]["key"]
    known = spark.createDataFrame(keys[0], tables["idem"].schema)
    again = progress.idem_decision(spark.createDataFrame([(keys[1][0]["key"],)], "key string"), known, now()).first()
    assert (again["decision"], again["known_id"]) == ("replayed", "r1")
