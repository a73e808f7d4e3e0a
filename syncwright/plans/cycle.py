"""What a cycle leaves behind: links, snapshots, origins, keys and idempotency results, as new tables.

The state is a dict of plain tables (operators.state.TABLES).  A cycle reads one;
`changed` gives what it changes, which sources.versions keeps, and `after` the next
state whole, to be written into a new folder.  Either way a cycle that fails leaves the
old state as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import duration, idempotency_key, snapshot_hash, untag
from ..functions.transforms import bound
from ..operators.mapping import DIRECTIONS
from ..operators.origin import expiry
from ..operators.progress import IDEM_TTL
from ..operators.state import KEYS, overlay, swept
from ..session import written
from .plan import Sync, _writable, deleted_ends, refs, standing


def merged(base: Column, values: Column) -> Column:
    """A canonical map with the values written over it."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(values, F.create_map().cast("map<string,string>")), lambda _, old, new: F.coalesce(new, old))


def committed(decisions: DataFrame, created: DataFrame, sync: Sync) -> DataFrame:
    """(l_id, r_id, l_after, r_after, to_left, to_right, made) of the pairs that are in step after the cycle.

    decisions: as plan.standing gives them; created: (source ref, remote_id), the peers'
    answers to creates; what waits for a decision, and a create without an answer, is not
    in step.  made: the pair's other end was created in this cycle.
    """
    l_ref, r_ref = refs(sync)
    answers = created.select(F.col("source").alias("_source"), F.col("remote_id").alias("_new"))
    rows = decisions.where("outcome <> 'review' and outcome <> 'skip' and coalesce(d.action, '') <> 'escalate'")
    rows = rows.withColumn("_ref", F.when(F.col("outcome") == "create", F.coalesce(l_ref, r_ref)).otherwise(F.concat(l_ref, F.lit("\x00"), r_ref))).join(answers, F.col("_ref") == F.col("_source"), "left")
    rows = rows.where("outcome <> 'create' and d is not null or _new is not null")
    to_right = F.when(F.col("outcome") == "create", F.when(F.col("r_id").isNull(), _writable(F.col("l")["fields"], sync, "right"))).otherwise(_writable(F.col("d")["right_values"], sync, "right"))
    to_left = F.when(F.col("outcome") == "create", F.when(F.col("l_id").isNull(), _writable(F.col("r")["fields"], sync, "left"))).otherwise(_writable(F.col("d")["left_values"], sync, "left"))
    rows = rows.select(F.coalesce("l_id", "_new").alias("l_id"), F.coalesce("r_id", "_new").alias("r_id"), F.col("l")["fields"].alias("lf"), F.col("r")["fields"].alias("rf"), to_left.alias("to_left"), to_right.alias("to_right"), (F.col("outcome") == "create").alias("made"))
    return rows.select("l_id", "r_id", merged(F.col("lf"), F.col("to_left")).alias("l_after"), merged(F.col("rf"), F.col("to_right")).alias("r_after"), "to_left", "to_right", "made")


def changed(decisions: DataFrame, created: DataFrame, deletes: DataFrame, state: dict[str, DataFrame], sync: Sync, now: Column, windows: dict[str, int] | None = None) -> dict[str, tuple[DataFrame, DataFrame | None]]:
    """What a cycle at `now` changes in links, snapshots, origins, idem and keys: (rows put, keys removed) of each, as sources.versions takes them.

    A deleted end drops its link with both snapshots and keys, and so does a link that
    leads nowhere.  Every write leaves an origin, of the whole record as the peer will send
    it back, and its result under its idempotency key.  The key of a create names no
    target, since nobody knows it before the call: a repeat has the same key.  windows:
    seconds that origins live, by connector.  Rows that the state holds already are not
    put again.  The pairs and the ends are written once; all tables come from them, and no link,
    snapshot or key has a record twice.
    """
    names = sync.mapping.names()
    ends = written(deleted_ends(deletes, state["links"], sync))
    rows, nowhere = standing(decisions, ends, sync)
    pairs = written(committed(rows, created, sync))
    ends = ends.select("l_id", "r_id").union(nowhere)
    l_ref, r_ref = refs(sync)
    links = pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), now.alias("linked_at")).join(state["links"].select("a", "b"), ["a", "b"], "left_anti")

    sides = F.array(F.struct(l_ref.alias("ref"), F.col("l_after").alias("fields"), F.col("to_left").alias("written"), r_ref.alias("source"), F.lit(sync.left).alias("connector"), "made"), F.struct(r_ref.alias("ref"), F.col("r_after").alias("fields"), F.col("to_right").alias("written"), l_ref.alias("source"), F.lit(sync.right).alias("connector"), "made"))
    side = pairs.select(F.explode(sides).alias("s")).select("s.*").withColumn("hash", snapshot_hash(F.col("fields"), names))
    # a record whose link led nowhere may be in step with a new one
    gone = ends.select(F.explode(F.array(l_ref, r_ref)).alias("ref")).join(side.select("ref"), "ref", "left_anti")
    snapshots = side.select("ref", "hash", "fields", now.alias("at")).join(state["snapshots"].select("ref", "hash"), ["ref", "hash"], "left_anti")

    write = side.where("size(written) > 0")
    origins = write.select("ref", "hash", now.alias("written_at"), expiry(F.col("connector"), now, windows).alias("expires_at"))
    key = idempotency_key(F.lit(sync.name), F.lit(sync.mapping.kind), F.split("source", ":", 2)[0], F.col("source"), F.col("connector"), F.when(F.col("made"), "").otherwise(F.col("ref")), F.col("hash"))
    idem = write.select(key.alias("key"), F.regexp_extract("ref", "^[^/]*/(.*)$", 1).alias("remote_id"), F.col("made").alias("created"), F.lit(False).alias("in_flight"), now.alias("written_at"), (now + F.make_dt_interval(secs=F.lit(IDEM_TTL))).alias("expires_at"))

    named = F.array(*[F.struct(F.lit(k).alias("key_name"), untag(F.col("fields")[k]).alias("key_value")) for k in sync.keys])
    fresh = side.select("ref", F.explode(named).alias("k")).select("ref", "k.key_name", "k.key_value").where("key_value is not null and key_value <> ''")
    touched = gone.union(side.select("ref")).distinct()
    stale = state["keys"].join(touched, "ref", "left_semi").join(fresh.select("ref", "key_name"), ["ref", "key_name"], "left_anti").select("ref", "key_name")
    keys = fresh.join(state["keys"], ["ref", "key_name", "key_value"], "left_anti")
    return {"links": (links, ends.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))), "snapshots": (snapshots, gone), "origins": (origins, None), "idem": (idem, None), "keys": (keys, stale)}


def after(decisions: DataFrame, created: DataFrame, deletes: DataFrame, state: dict[str, DataFrame], sync: Sync, now: Column, windows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The tables links, snapshots, origins, idem and keys after a cycle at `now`: the changes over the state, expired rows left out."""
    out = {}
    for name, (put, gone) in changed(decisions, created, deletes, state, sync, now, windows).items():
        base = swept(state[name], now) if name in ("origins", "idem") else state[name]
        # an origin is one write's mark: it replaces none
        out[name] = base.unionByName(put) if name == "origins" else overlay(base, put, put.limit(0) if gone is None else gone, KEYS[name])
    return out


def writes(decisions: DataFrame, deletes: DataFrame, links: DataFrame, sync: Sync, at: Column) -> DataFrame:
    """What a cycle sends to its peers, as sources.peers.WRITES.

    hash is that of the whole record as it will be after the write, by which the peer's
    echo is known again; a create's key names no target.
    """
    ends = deleted_ends(deletes, links, sync)
    rows, _ = standing(decisions, ends, sync)
    l_ref, r_ref = refs(sync)
    kind, names = F.lit(sync.mapping.kind), sync.mapping.names()

    def sent(side: str) -> Column:
        own, far, connector, other = ("l", "r", sync.left, sync.right) if side == "left" else ("r", "l", sync.right, sync.left)
        new = (F.col("outcome") == "create") & F.col(f"{own}_id").isNull()
        values = F.when(new, _writable(F.col(far)["fields"], sync, side)).otherwise(_writable(F.col("d")[f"{side}_values"], sync, side))
        go = new | F.col("d")["action"].isin(f"write_{side}", "write_both")
        source, target = (r_ref, l_ref) if side == "left" else (l_ref, r_ref)

        def row(values: Column, digest: Column) -> Column:
            key = idempotency_key(F.lit(sync.name), kind, F.lit(other), source, F.lit(connector), F.when(new, "").otherwise(target), digest)
            fields = {"connector": F.lit(connector), "sync": F.lit(sync.name), "action": F.when(new, "create").otherwise("update"), "remote_id": F.when(~new, F.col(f"{own}_id")), "record": sync.mapping.from_canonical(values, side), "hash": digest, "key": key, "source": source}
            return F.struct(*[c.alias(n) for n, c in fields.items()])

        digest = lambda v: snapshot_hash(F.when(new, v).otherwise(merged(F.col(own)["fields"], v)), names)
        return F.when(go, bound(values, lambda v: F.when(F.size(v) > 0, bound(digest(v), lambda h: row(v, h)))))

    out = rows.select(F.explode(F.array_compact(F.array(sent("left"), sent("right")))).alias("w")).select("w.*")
    at_left = F.col("side") == "left"
    connector, source, target = F.when(at_left, sync.right).otherwise(sync.left), F.when(at_left, l_ref).otherwise(r_ref), F.when(at_left, r_ref).otherwise(l_ref)
    key = idempotency_key(F.lit(sync.name), kind, F.when(at_left, sync.left).otherwise(sync.right), source, connector, target, F.lit("delete"))
    gone = ends.select(connector.alias("connector"), F.lit(sync.name).alias("sync"), F.lit("delete").alias("action"), F.when(at_left, F.col("r_id")).otherwise(F.col("l_id")).alias("remote_id"), F.lit(None).cast("string").alias("record"), F.lit("").alias("hash"), key.alias("key"), source.alias("source"))
    return out.unionByName(gone).withColumn("at", at)


def routed(events: DataFrame, syncs: list[Sync]) -> DataFrame:
    """events (connector, kind, ...) with `sync`: a row for each sync that they start work in; others are dropped.

    The direction gate stands first: a peer that a one-way sync never writes from starts
    none, so its events are neither hydrated nor compared.
    """
    rows = [(s.name, own, s.mapping.kind) for s in syncs for own, far in ((s.left, "right"), (s.right, "left")) if far in DIRECTIONS[s.mapping.direction]]
    table = events.sparkSession.createDataFrame(rows, "sync string, _connector string, _kind string")
    return events.join(F.broadcast(table), (F.col("connector") == F.col("_connector")) & (F.col("kind") == F.col("_kind"))).drop("_connector", "_kind")


def diagnosis(schemas: DataFrame, marks: DataFrame, queues: DataFrame, syncs: list[Sync], now: Column) -> DataFrame:
    """Checks (k, name, subject, ok, detail): connectors, mappings, watermarks, queues.

    schemas: (connector, kind, field, read_only, error), one row with an error for a
    peer that could not be described; marks: (connector, kind, mark); queues: (queue).
    """
    spark = schemas.sparkSession
    subject = F.concat_ws("/", "connector", "kind")
    peers = sorted({(c, s.mapping.kind) for s in syncs for c in (s.left, s.right)})
    asked = F.broadcast(spark.createDataFrame(peers or [("", "")], "connector string, kind string").where("connector <> ''"))
    seen = schemas.groupBy("connector", "kind").agg(F.count("field").alias("n"), F.max("error").alias("error"))
    joined = asked.join(seen, ["connector", "kind"], "left")
    out = [joined.select(F.lit(1).alias("part"), F.lit("connector").alias("name"), subject.alias("subject"), (F.col("error").isNull() & F.col("n").isNotNull()).alias("ok"), F.coalesce("error", F.when(F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(" fields"))), F.lit("not described")).alias("detail"))]
    for s in syncs:
        mapped = [(c, f.path(side), f.path(side).split(".")[0], f.canonical in s.mapping.writable(side)) for side, c in (("left", s.left), ("right", s.right)) for f in s.mapping.fields]
        want = spark.createDataFrame(mapped, "connector string, path string, head string, writes boolean")
        own = schemas.where(F.col("kind") == s.mapping.kind)
        known = own.where("field is not null").select(F.col("connector").alias("_c"), "field", "read_only")
        met = want.join(F.broadcast(known), (F.col("_c") == F.col("connector")) & ((F.col("field") == F.col("path")) | (F.col("field") == F.col("head"))), "left")
        wrong = F.when(F.col("field").isNull(), F.concat("connector", F.lit(": "), "path", F.lit(" is missing"))).when(F.col("writes") & F.col("read_only"), F.concat("connector", F.lit(": "), "path", F.lit(" is read-only")))
        both = own.where(F.col("connector").isin(s.left, s.right) & F.col("error").isNull()).agg(F.countDistinct("connector").alias("peers"))
        found = met.agg(F.array_join(F.array_sort(F.collect_set(wrong)), "; ").alias("wrong")).join(both.where("peers = 2"))
        out.append(found.select(F.lit(2).alias("part"), F.lit("mapping").alias("name"), F.lit(s.name).alias("subject"), (F.col("wrong") == "").alias("ok"), F.when(F.col("wrong") == "", f"{len(s.mapping.fields)} fields, {s.mapping.direction}").otherwise(F.col("wrong")).alias("detail")))
    read = sorted({(c, s.mapping.kind) for s in syncs for c, far in ((s.left, "right"), (s.right, "left")) if far in DIRECTIONS[s.mapping.direction]})
    behind = F.broadcast(spark.createDataFrame(read or [("", "")], "connector string, kind string").where("connector <> ''")).join(marks, ["connector", "kind"], "left")
    lag = F.concat(duration(F.unix_timestamp(now) - F.unix_timestamp("mark")), F.lit(" behind"))
    out.append(behind.select(F.lit(3).alias("part"), F.lit("watermark").alias("name"), subject.alias("subject"), F.lit(True).alias("ok"), F.coalesce(lag, F.lit("not set yet; the next run backfills")).alias("detail")))
    # The queues as reports name them.
    kinds = spark.createDataFrame([("dlq", "dead-letter queue", " items that exhausted their attempts"), ("review", "review queue", " decisions waiting for a person")], "queue string, title string, what string")
    waiting = F.broadcast(kinds).join(queues.groupBy("queue").agg(F.count("*").alias("n")), "queue", "left")
    out.append(waiting.select(F.lit(4).alias("part"), F.lit("queue").alias("name"), F.col("title").alias("subject"), F.col("n").isNull().alias("ok"), F.coalesce(F.concat(F.col("n").cast("string"), "what"), F.lit("empty")).alias("detail")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    # a few rows for each sync and peer: one task orders them
    return rows.withColumn("k", F.row_number().over(Window.orderBy("part", "subject")).cast("long")).select("k", "name", "subject", "ok", "detail")
