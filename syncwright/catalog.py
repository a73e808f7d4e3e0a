"""The operators as registered queries over the driver's tables, each with the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digest as D
from .functions import transforms as T
from .operators import conflict, identity, mapping, origin, pacing, progress, serial, state
from .plans import cycle, outcomes, report
from .plans import plan as P
from .plans import run as cycles
from .session import empty, shared_folder
from .sources import connector, fixtures, peers, versions
from .streaming import deliveries, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- transforms -----------------------------------------------------------

_DOMAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({v}), '^.*?://', ''), '[/?#].*$', ''), '^.*@', ''), ':.*$', ''), '[.]$', ''), '^www[.]', '')"
_TRIM = "regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
_EMAIL = "case when contains({v}, '@') then lower(regexp_extract({v}, '^(.*)@[^@]*$', 1)) || '@' || " + _DOMAIN.format(v="regexp_extract({v}, '@([^@]*)$', 1)") + " else lower({v}) end"
_RAW = "chr(9) || ' ' || upper(replace(c_name, '#', '+')) || '@WWW.Example.COM. ' || chr(10)"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RAW).alias("raw"))


@query(f"select c_custkey, {_TRIM.format(v=_RAW)} as v from customer")
def t_trim(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", T.trim(F.col("raw")).alias("v"))


@query(f"select c_custkey, lower({_TRIM.format(v=_RAW)}) as v from customer")
def t_lowercase(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", T.lowercase(F.col("raw")).alias("v"))


@query(f"with t as (select c_custkey, {_TRIM.format(v=_RAW)} as a from customer) select c_custkey, {_EMAIL.format(v='a')} as v from t")
def t_email_normalize(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", T.email_normalize(F.col("raw")).alias("v"))


@query(f"with t as (select c_custkey, {_TRIM.format(v=_RAW)} as a from customer), e as (select c_custkey, {_EMAIL.format(v='a')} as a from t) select c_custkey, regexp_replace(regexp_extract(a, '^(.*)@', 1), '[+].*$', '') || regexp_extract(a, '@[^@]*$') as v from e")
def t_email_fold_plus(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", T.email_fold_plus(F.col("raw")).alias("v"))


@query(f"select page_id, {_DOMAIN.format(v='url')} as v from pages")
def t_domain_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.domain_normalize(F.col("url")).alias("v"))


# ---- digests --------------------------------------------------------------


@query("""
select c_custkey, sha256('3:key' || strlen(k) || ':' || k || '4:name' || strlen(n) || ':' || n || '4:note' || strlen(x) || ':' || x) as h
from (select c_custkey, 'n' || c_custkey as k, 's' || c_name as n, case when c_custkey % 3 = 0 then chr(0) || 'absent' else chr(0) || 'null' end as x from customer)
""")
def digest_snapshot(spark, sf_dir):
    note = F.when(F.col("c_custkey") % 3 != 0, D.NULL)
    fields = F.map_from_entries(F.filter(F.array(F.struct(F.lit("key"), D.tag_number(F.col("c_custkey"))), F.struct(F.lit("name"), D.tag_string(F.col("c_name"))), F.struct(F.lit("note"), note)), lambda e: e["col2"].isNotNull()))
    return _table(spark, sf_dir, "customer").select("c_custkey", fields.alias("fields")).select("c_custkey", D.snapshot_hash(F.col("fields"), ["name", "note", "key"]).alias("h"))



@query("""
select o_orderkey, sha256('4:pair7:contact4:left' || strlen(a) || ':' || a || '5:right' || strlen(b) || ':' || b || strlen(p) || ':' || p) as h
from (select o_orderkey, 'L-' || o_custkey as a, 'R-' || o_orderkey as b, sha256(o_orderstatus) as p from orders)
""")
def idem_key(spark, sf_dir):
    c = lambda x: F.lit(x)
    key = D.idempotency_key(c("pair"), c("contact"), c("left"), F.concat(c("L-"), F.col("o_custkey").cast("string")), c("right"), F.concat(c("R-"), F.col("o_orderkey").cast("string")), F.sha2(F.col("o_orderstatus").cast("binary"), 256))
    return _table(spark, sf_dir, "orders").select("o_orderkey", key.alias("h"))


@query("select o_orderkey, 'review-' || substr(sha256('pair' || chr(0) || 'left:contact/' || o_orderkey), 1, 32) as id from orders")
def review_id(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.review_id(F.lit("pair"), D.ref(F.lit("left"), F.lit("contact"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("select o_orderkey, lpad(cast(epoch_us(o_orderdate) * 1000 as varchar), 20, '0') || '-' || lpad(cast(o_orderkey as varchar), 10, '0') as id from orders")
def queue_id(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.queue_id(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")).alias("id"))


@query("select s as seconds, case when s >= 3600 then (s // 3600) || 'h' else '' end || case when s >= 60 then (s % 3600 // 60) || 'm' else '' end || (s % 60) || 's' as d from (select distinct c_custkey * 7 as s from customer)")
def duration_text(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("seconds")).distinct().select("seconds", D.duration(F.col("seconds")).alias("d"))


# ---- mappings -------------------------------------------------------------

_EVENT_MAP = mapping.Mapping("event", (mapping.FieldMap("k", "k", "data.k"), mapping.FieldMap("gone", "nothing.here", "gone"), mapping.FieldMap("type", "meta.type", "type", transform="lowercase")))


@query("""
select event_id, 'k=n' || cast(json_extract(props, '$.k') as varchar) || ';type=s' || lower(event_type) as fields
from events where json_extract(props, '$.k') is not null
""")
def canonical_map_nested(spark, sf_dir):
    record = F.parse_json(F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "meta": {"type": " '), F.upper("event_type"), F.lit(' "}}')))
    rows = _table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", _EVENT_MAP.to_canonical(record, "left").alias("m"))
    return rows.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


_CONTACT = mapping.Mapping("contact", (mapping.FieldMap("email", "email", "emails.primary", transform="email_normalize"), mapping.FieldMap("segment", "segment", "info.segment"), mapping.FieldMap("balance", "balance", "info.balance", "left_to_right"), mapping.FieldMap("nation", "nation", "nation", "right_to_left")))


@query("""select c_custkey, '{"emails":{"primary":"' || lower(replace(c_name, '#', '.')) || '@example.com"},"info":{' || case when c_custkey % 4 <> 0 then '"balance":' || c_custkey || ',' else '' end || '"segment":"' || c_mktsegment || '"}}' as doc from customer""")
def from_canonical_writable(spark, sf_dir):
    entries = F.array(F.struct(F.lit("email"), D.tag_string(F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")))), F.struct(F.lit("segment"), D.tag_string(F.col("c_mktsegment"))), F.struct(F.lit("nation"), D.tag_number(F.col("c_nationkey"))), F.struct(F.lit("balance"), F.when(F.col("c_custkey") % 4 != 0, D.tag_number(F.col("c_custkey")))))
    fields = F.map_from_entries(F.filter(entries, lambda e: e["col2"].isNotNull()))
    return _table(spark, sf_dir, "customer").select("c_custkey", fields.alias("m")).select("c_custkey", _CONTACT.from_canonical(F.col("m"), "right").alias("doc"))


@query("""select field, 'missing' as problem from (values ('k', 'k'), ('nothing.here', 'nothing'), ('meta.type', 'meta')) t(field, head)
where head not in (select unnest(json_keys(props)) from events where props is not null)""")
def mapping_missing_fields(spark, sf_dir):
    """Mapped fields that no record of the peer holds."""
    records = _table(spark, sf_dir, "events").select(F.try_parse_json("props").alias("record")).where("record is not null")
    return mapping.problems(_EVENT_MAP, "left", fixtures.described(records))


# ---- incremental reading --------------------------------------------------

_MARK = "timestamp '1996-06-01 00:00:00'"


@query(f"select o_orderkey, o_orderdate from orders where o_orderdate >= {_MARK} - interval 120 second")
def delta_since_overlap(spark, sf_dir):
    start = progress.since(F.expr(_MARK), progress.overlap())
    return progress.delta(_table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), "at", start).select("o_orderkey", "o_orderdate")


@query(f"with m as (select o_orderstatus, o_custkey % 2 = 0 as known from orders), t as (select o_orderstatus, max(o_orderdate) as top from orders group by 1) select o_orderstatus, greatest({_MARK}, least(top, timestamp '1998-01-01 00:00:00')) as mark from t")
def watermark_advance(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    marks = spark.sql(f"select s as o_orderstatus, {_MARK} as mark from values ('F'), ('O'), ('P') as t(s)").join(orders.select("o_orderstatus").distinct(), "o_orderstatus", "left_semi")
    out = progress.advanced(marks, orders, ["o_orderstatus"], F.expr("timestamp '1998-01-01 00:00:00'"))
    return out.select("o_orderstatus", F.col("mark").cast("timestamp_ntz").alias("mark"))


@query("select event_type, cast(epoch(timestamp '2030-01-01 00:00:00') - epoch(date_trunc('second', max(ts))) as bigint) as lag_seconds from events group by 1")
def watermark_lag(spark, sf_dir):
    top = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("mark"))
    return top.select("event_type", (F.unix_timestamp(F.expr("timestamp '2030-01-01 00:00:00'")) - F.unix_timestamp("mark")).alias("lag_seconds"))


@query(f"select case when o_orderdate >= {_MARK} - interval 300 second then 'incremental' else 'backfill only' end as scan, count(*) as n from orders group by 1")
def backfill_vs_incremental(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    start = progress.since(F.expr(_MARK), progress.overlap(exact_times=False))
    return orders.groupBy(F.when(F.col("at") >= start, "incremental").otherwise("backfill only").alias("scan")).agg(F.count("*").alias("n"))


# ---- deliveries and echoes ------------------------------------------------

_DELIVERY = "case when event_id % 10 = 0 then '' else 'd-' || cast(event_id % 997 as string) end"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))


@query("""
with recursive e as (select event_type, case when event_id % 10 = 0 then '' else 'd-' || (event_id % 997) end as delivery, ts from events),
taken as (select event_type, delivery, min(ts) as ts from e where delivery <> '' group by 1, 2
          union all select t.event_type, t.delivery, min(e.ts) from taken t join e using (event_type, delivery) where e.ts >= t.ts + interval 24 hour group by t.event_type, t.delivery, t.ts)
select event_type, count(*) as n from (select event_type from taken union all select event_type from e where delivery = '' union all select event_type from e where delivery = '') group by 1
""")
def delivery_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir)
    e = e.unionByName(e).select(F.lit("left").alias("connector"), F.expr(_DELIVERY).alias("delivery"), F.col("event_type").alias("kind"), F.lit("x").alias("remote_id"), "at")
    return deliveries.once(e).groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


_CLASSIFIED = """
with e as (select event_id, 'u-' || user_id as ref, sha256(event_type) as hash from events),
w as (select ref, hash, count(*) as entries from e where event_id % 3 = 0 and event_id % 2 = 0 group by 1, 2),
r as (select distinct ref from e where event_id % 3 = 0 and event_id % 2 = 0),
n as (select e.event_id, e.ref, w.entries, row_number() over (partition by e.ref, e.hash order by e.event_id) as turn from e left join w on e.ref = w.ref and e.hash = w.hash),
v as (select event_id, case when turn <= entries then 'echo' when r.ref is not null then 'near_miss' else 'foreign' end as verdict from n left join r on n.ref = r.ref)
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("ref"), F.sha2(F.col("event_type").cast("binary"), 256).alias("hash"))
    now = F.expr("timestamp '2030-01-01 00:00:00'")
    # every third event is one of our writes; odd ones among them have expired
    writes = e.where("event_id % 3 = 0").select("ref", "hash", F.when(F.col("event_id") % 2 != 0, now).alias("expires_at"))
    return origin.classify(e, writes, now, ["event_id"])


@query(_CLASSIFIED + "select event_id, verdict from v")
def echo_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "verdict")


@query(_CLASSIFIED + "select verdict, count(*) as n from v where verdict <> 'echo' group by 1")
def near_miss_classify(spark, sf_dir):
    return _classified(spark, sf_dir).where(origin.processed(F.col("verdict"))).groupBy("verdict").agg(F.count("*").alias("n"))


# ---- identity -------------------------------------------------------------

_NAME = "lower(replace(c_name, '#', '.'))"
_PEERS = f"""
with l as (select 'L-' || c_custkey as id, c_custkey as k, {_NAME} || '@example.com' as email, case when c_custkey % 6 = 0 then '' else 'p' || (c_custkey // 3) end as phone, c_mktsegment as seg from customer where c_custkey % 10 <> 0),
r as (select 'R-' || c_custkey as id, c_custkey as k, {_NAME} || '@example.com' as email, 'p' || (c_custkey + 1) as phone, case when c_custkey % 7 = 0 then 'EDITED' else c_mktsegment end as seg from customer where c_custkey % 10 <> 1
      union all select 'R-dup-' || c_custkey, c_custkey, {_NAME} || '@example.com', 'p' || (c_custkey + 2), c_mktsegment from customer where c_custkey % 50 = 2),
links as (select 'L-' || c_custkey as a, 'R-' || c_custkey as b from customer where c_custkey % 13 = 5 and c_custkey % 10 > 1)
"""


def _peers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # a small file is one task, and its addresses are dear to normalise; by its bytes it would be few tasks again
    c = _table(spark, sf_dir, "customer").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey").withColumn("k", F.col("c_custkey"))
    name = F.translate("c_name", "#", ".")
    raw_l, raw_r = F.concat(F.lit(" "), F.upper(name), F.lit("@Example.COM")), F.concat(F.lower(name), F.lit("@www.example.com."))
    text = lambda x: x.cast("string")
    left = c.where("k % 10 <> 0").select(F.concat(F.lit("L-"), text(F.col("k"))).alias("id"), "k", T.email_normalize(raw_l).alias("email"), F.when(F.col("k") % 6 == 0, "").otherwise(F.concat(F.lit("p"), text(F.expr("k div 3")))).alias("phone"), F.col("c_mktsegment").alias("seg"))
    right = c.where("k % 10 <> 1").select(F.concat(F.lit("R-"), text(F.col("k"))).alias("id"), "k", T.email_normalize(raw_r).alias("email"), F.concat(F.lit("p"), text(F.col("k") + 1)).alias("phone"), F.when(F.col("k") % 7 == 0, "EDITED").otherwise(F.col("c_mktsegment")).alias("seg"))
    twice = c.where("k % 50 = 2").select(F.concat(F.lit("R-dup-"), text(F.col("k"))).alias("id"), "k", T.email_normalize(raw_r).alias("email"), F.concat(F.lit("p"), text(F.col("k") + 2)).alias("phone"), F.col("c_mktsegment").alias("seg"))
    links = c.where("k % 13 = 5 and k % 10 > 1").select(F.concat(F.lit("L-"), text(F.col("k"))).alias("a"), F.concat(F.lit("R-"), text(F.col("k"))).alias("b"))
    return left, right.unionByName(twice), links


@query(_PEERS + "select l.id, links.b as linked from l left join links on l.id = links.a")
def link_lookup(spark, sf_dir):
    left, _, links = _peers(spark, sf_dir)
    return identity.linked_peer(left, links, "id").select("id", "linked")


@query(_PEERS + "select l.id, array_to_string(list_sort(list(r.id)), ' ') as candidates from l join r on l.email = r.email group by 1")
def key_match(spark, sf_dir):
    left, right, _ = _peers(spark, sf_dir)
    return identity.candidates(left, right, "id", "id", ["email"]).select("id", F.array_join("candidates", " ").alias("candidates"))


@query(_PEERS + """, m as (select l.id, r.id as far, 'email' as key from l join r on l.email = r.email union select l.id, r.id, 'phone' from l join r on l.phone = r.phone where l.phone <> '')
select id, array_to_string(list_sort(list_distinct(list(far))), ' ') as candidates, array_to_string(list_sort(list_distinct(list(key))), ', ') as matched_on from m group by 1""")
def two_key_match(spark, sf_dir):
    left, right, _ = _peers(spark, sf_dir)
    return identity.candidates(left, right, "id", "id", ["email", "phone"]).select("id", F.array_join("candidates", " ").alias("candidates"), "matched_on")


def _outcome_sql(policy: str) -> str:
    nobody = "skip" if policy == "skip" else "create"
    return _PEERS + f""", m as (select l.id, list_sort(list(r.id)) as far from l join r on l.email = r.email group by 1)
select l.id, case when b is not null then 'linked' when len(far) = 1 then 'matched' when far is null then '{nobody}' else '{policy}' end as outcome,
       coalesce(b, case when len(far) = 1 then far[1] end) as peer_id,
       case when b is not null then 'linked' when len(far) = 1 then 'matched on email' when far is null then 'no match' else len(far) || ' records on right match on email' end as reason
from l left join links on l.id = a left join m on l.id = m.id"""


def _outcomes(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right, links = _peers(spark, sf_dir)
        return identity.resolve(left, right, links, "id", "id", ["email"], "right", policy).select("id", "outcome", "peer_id", "reason")

    return run


for _policy in identity.POLICIES:
    QUERIES[f"identity_outcome_{_policy}"], ORACLE[f"identity_outcome_{_policy}"] = _outcomes(_policy), _outcome_sql(_policy)


# ---- conflicts ------------------------------------------------------------

_SIDES = """
with t as (select c_custkey as k, case when c_custkey % 3 = 0 then 'nL' else 'n' end as ln, case when c_custkey % 5 = 0 then 'pL' else 'p' end as lp,
                  case when c_custkey % 4 = 0 then 'nR' else 'n' end as rn, case when c_custkey % 6 = 0 then 'pR' else 'p' end as rp,
                  c_custkey % 11 <> 0 as based, c_custkey % 7 as ls, c_custkey % 5 as rs from customer),
d as (select *, ln <> rn as dn, lp <> rp as dp, not based or ln <> 'n' as lnc, not based or lp <> 'p' as lpc, not based or rn <> 'n' as rnc, not based or rp <> 'p' as rpc,
             not based or ln <> 'n' or lp <> 'p' as lc, not based or rn <> 'n' or rp <> 'p' as rc, abs(ls - rs) as gap from t),
s as (select *, case when lc and rc then 'both_changed' when lc then 'left_changed' when rc then 'right_changed' else 'unchanged' end as situation from d)
"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")

    def side(name: str, phone: str, n: int, p: int, step: int) -> Column:
        fields = F.create_map(F.lit("name"), F.when(k % n == 0, f"s{name}").otherwise("sn"), F.lit("phone"), F.when(k % p == 0, f"s{phone}").otherwise("sp"))
        base = F.when(k % 11 != 0, F.create_map(F.lit("name"), F.lit("sn"), F.lit("phone"), F.lit("sp")))
        names = ["name", "phone"]
        at = F.timestamp_seconds(F.lit(1_700_000_000) + k % step)
        return F.struct(fields.alias("fields"), base.alias("base"), D.snapshot_hash(fields, names).alias("hash"), F.when(base.isNotNull(), D.snapshot_hash(base, names)).alias("synced_hash"), at.alias("updated_at"))

    return _table(spark, sf_dir, "customer").select(k.alias("k"), side("nL", "pL", 3, 5, 7).alias("l"), side("nR", "pR", 4, 6, 5).alias("r"))


def _shown(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), D.untag(e["value"]))), ";")


@query(_SIDES + "select k, situation from s")
def situation(spark, sf_dir):
    return _sides(spark, sf_dir).select("k", conflict.situation(F.col("l"), F.col("r")).alias("situation"))


@query(_SIDES + """select k, 'name' as field, ln as left_value, rn as right_value, lnc as left_changed, rnc as right_changed from s where dn
union all select k, 'phone', lp, rp, lpc, rpc from s where dp""")
def field_diffs(spark, sf_dir):
    rows = _sides(spark, sf_dir).select("k", F.explode(conflict.differences(F.col("l"), F.col("r"), ["phone", "name"])).alias("d"))
    return rows.select("k", "d.field", D.untag(F.col("d.left")).alias("left_value"), D.untag(F.col("d.right")).alias("right_value"), "d.left_changed", "d.right_changed")


_AGREE, _NEITHER, _LEFT, _RIGHT = "the two sides already agree on every mapped field", "neither side changed since the last sync", "only the left side changed", "only the right side changed"
_ALL_L, _ALL_R = "'name=' || ln || ';phone=' || lp", "'name=' || rn || ';phone=' || rp"


def _policy_sql(action: str, reason: str, to_left: str, to_right: str) -> str:
    head = "case when not dn and not dp then {a} when situation = 'unchanged' then {b} when situation = 'left_changed' then {c} when situation = 'right_changed' then {d} else {e} end"
    return (
        _SIDES
        + "select k, situation, "
        + head.format(a="'nothing'", b="'nothing'", c="'write_right'", d="'write_left'", e=action)
        + " as action, "
        + head.format(a=f"'{_AGREE}'", b=f"'{_NEITHER}'", c=f"'{_LEFT}'", d=f"'{_RIGHT}'", e=reason)
        + " as reason, "
        + head.format(a="''", b="''", c="''", d=_ALL_R, e=to_left)
        + " as left_values, "
        + head.format(a="''", b="''", c=_ALL_L, d="''", e=to_right)
        + " as right_values from s"
    )


def _field_sql(name_block: str, name_left: str, name_right: str, phone_block: str, phone_left: str, phone_right: str, escalated: str, stop: str, words: tuple[str, str, str]) -> str:
    """Field by field: conditions for a blocked field and for each side's winning value; escalated: a condition before all."""
    bn, bp = f"(dn and {name_block})", f"(dp and {phone_block})"
    nl, nr, pl, pr = f"(dn and not {name_block} and {name_left})", f"(dn and not {name_block} and {name_right})", f"(dp and not {phone_block} and {phone_left})", f"(dp and not {phone_block} and {phone_right})"
    to_right, to_left = f"({nl} or {pl})", f"({nr} or {pr})"
    no_base = "both sides changed and there is no recorded base to merge against"
    blocked = f"concat_ws(', ', case when {bn} then 'name' end, case when {bp} then 'phone' end)"
    shown = lambda a, x, b, y: f"concat_ws(';', case when {a} then 'name=' || {x} end, case when {b} then 'phone=' || {y} end)"
    go = f"not ({escalated}) and not {bn} and not {bp}"
    return _policy_sql(
        f"case when {escalated} or {bn} or {bp} then 'escalate' when {to_left} and {to_right} then 'write_both' when {to_right} then 'write_right' when {to_left} then 'write_left' else 'nothing' end",
        f"case when {escalated} then '{no_base}' when {bn} or {bp} then {stop.format(fields=blocked)} when {to_left} and {to_right} then '{words[0]}' when {to_right} then '{words[1]}' when {to_left} then '{words[2]}' else 'the digests differ but no mapped field does' end",
        f"case when {go} then {shown(nr, 'rn', pr, 'rp')} else '' end",
        f"case when {go} then {shown(nl, 'ln', pl, 'lp')} else '' end",
    )


_POLICY_SQL = {
    "left_wins": _policy_sql("'write_right'", "'both sides changed; the left side is the source of truth'", "''", _ALL_L),
    "right_wins": _policy_sql("'write_left'", "'both sides changed; the right side is the source of truth'", _ALL_R, "''"),
    "review": _policy_sql("'escalate'", "'both sides changed and the policy is to ask'", "''", "''"),
    "newest_wins": _policy_sql(
        "case when gap <= 2 then 'escalate' when ls > rs then 'write_right' else 'write_left' end",
        "case when gap <= 2 then 'both sides changed ' || gap || 's apart, inside the 2s clock tolerance, so which is newer is not knowable' when ls > rs then 'the left side changed ' || gap || 's later' else 'the right side changed ' || gap || 's later' end",
        f"case when gap > 2 and ls <= rs then {_ALL_R} else '' end",
        f"case when gap > 2 and ls > rs then {_ALL_L} else '' end",
    ),
    "field_level": _field_sql("(lnc and rnc)", "lnc", "rnc", "(lpc and rpc)", "lpc", "rpc", "not based", "'both sides edited ' || {fields}", ("both sides changed, in fields that do not overlap", "both sides changed, but only left-side edits need applying", "both sides changed, but only right-side edits need applying")),
}
_PER_FIELD_SQL = _field_sql("(gap <= 2)", "ls > rs", "ls <= rs", "(not based or (lpc and rpc))", "lpc", "rpc", "false", "'both sides changed and ' || {fields} || ' has no automatic winner'", ("both sides changed and per-field policies name both winners", "both sides changed; per-field policy keeps the left values", "both sides changed; per-field policy keeps the right values"))


def _resolved(policy: str, per_field: dict[str, str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _sides(spark, sf_dir).select("k", conflict.resolve(F.col("l"), F.col("r"), ["name", "phone"], policy, per_field).alias("d"))
        return rows.select("k", "d.situation", "d.action", "d.reason", _shown(F.col("d.left_values")).alias("left_values"), _shown(F.col("d.right_values")).alias("right_values"))

    return run


for _policy, _sql in _POLICY_SQL.items():
    QUERIES[f"policy_{_policy}"], ORACLE[f"policy_{_policy}"] = _resolved(_policy), _sql
QUERIES["policy_per_field"], ORACLE["policy_per_field"] = _resolved("review", {"name": "newest_wins", "phone": "field_level"}), _PER_FIELD_SQL


@query(f"with q as ({_POLICY_SQL['field_level']}) select k, left_values, right_values from q where action = 'write_both'")
def merge_write_both(spark, sf_dir):
    return _resolved("field_level")(spark, sf_dir).where("action = 'write_both'").select("k", "left_values", "right_values")


# ---- writing, state and queues --------------------------------------------


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus else c_mktsegment end as record, o_orderkey % 9 = 0 or (o_orderkey % 3 <> 0 and c_custkey is null) as gone
from orders left join (select * from customer where c_custkey % 5 <> 0) on o_custkey = c_custkey
""")
def hydrate_or_delete(spark, sf_dir):
    k = F.col("o_orderkey")
    events = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 3 == 0, F.col("o_orderstatus")).alias("record"), (k % 9 == 0).alias("deleted"))
    current = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("record"))
    return progress.hydrated(events.withColumn("id", F.col("o_custkey")), current, "id").select("o_orderkey", "record", "gone")


@query("""select 'R-' || c_custkey as target, 'left:contact/L-' || c_custkey as because from customer where c_custkey % 13 = 5 and c_custkey % 10 > 1 and c_custkey % 2 = 0""")
def delete_propagation(spark, sf_dir):
    _, _, links = _peers(spark, sf_dir)
    deleted = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("L-"), F.col("c_custkey").cast("string")).alias("id"))
    return identity.linked_peer(deleted, links, "id").where("linked is not null").select(F.col("linked").alias("target"), D.ref(F.lit("left"), F.lit("contact"), F.col("id")).alias("because"))


@query("""
with w as (select event_id, sha256(cast(event_id % 500 as varchar)) as key from events),
i as (select n, sha256(cast(n as varchar)) as key from (select distinct event_id % 500 as n from events) where n % 4 < 3 and n % 5 <> 0)
select event_id, case when i.key is null then 'proceed' when n % 4 = 1 then 'recheck' else 'replayed' end as decision, case when i.key is not null and n % 4 <> 1 then 'r-' || n end as known_id from w left join i using (key)
""")
def idem_decision(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 500)
    key = F.sha2(F.col("n").cast("string").cast("binary"), 256)
    now = F.expr("timestamp '2030-01-01 00:00:00'")
    idem = events.select("n").distinct().where("n % 4 < 3").select(key.alias("key"), (F.col("n") % 4 == 1).alias("in_flight"), F.concat(F.lit("r-"), F.col("n").cast("string")).alias("remote_id"), F.when(F.col("n") % 5 == 0, now).otherwise(now + F.expr("interval 1 hour")).alias("expires_at"))
    return progress.idem_decision(events.select("event_id", key.alias("key")), idem, now).select("event_id", "decision", "known_id")


@query("select event_id, least(30000, 250 * cast(pow(2, least(greatest(event_id % 12, 1), 20) - 1) as bigint)) as window_ms from events")
def backoff_window(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", progress.backoff_window(F.col("event_id") % 12).alias("window_ms"))


@query("select event_id from events where event_id % 3 = 0 or (event_id % 3 = 1 and ts > timestamp '2024-01-15 00:00:00')")
def ttl_sweep(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("expires_at", F.when(F.col("event_id") % 3 == 1, F.col("at")).when(F.col("event_id") % 3 == 2, F.expr("timestamp '2000-01-01 00:00:00'")))
    return state.swept(rows, F.expr("timestamp '2024-01-15 00:00:00'")).select("event_id")


@query("select c_custkey as k, case when c_custkey % 3 = 0 then 'written' else c_name end as v from customer where c_custkey % 5 <> 0")
def overlay_list(spark, sf_dir):
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return state.overlay(base, base.where("k % 3 = 0").withColumn("v", F.lit("written")), base.where("k % 5 = 0"), ["k"])


@query("select event_id, ts from events order by ts, lpad(cast(event_id as varchar), 10, '0') limit 50")
def queue_list_oldest_first(spark, sf_dir):
    queue = _table(spark, sf_dir, "events").select("event_id", "ts", F.col("ts").alias("created_at"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("id"))
    return state.oldest_first(queue, 50).select("event_id", "ts")


@query("select user_id, max_by(event_id, ts) as event_id, max(ts) as ts from (select * from events qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) group by 1")
def latest_wins(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return state.latest(rows, ["user_id"], "ts").select("user_id", "event_id", "ts")


@query("select 'review-' || user_id as id, min(event_id) as first_event from events group by 1")
def first_review_wins(spark, sf_dir):
    items = _table(spark, sf_dir, "events").select(F.concat(F.lit("review-"), F.col("user_id").cast("string")).alias("id"), "event_id", F.col("event_id").alias("created_at"))
    return state.first_review(items).select("id", F.col("event_id").alias("first_event"))


_KIND = "case event_id % 7 when 0 then 'unknown' when 1 then 'transient' when 2 then 'rate_limited' when 3 then 'auth' when 4 then 'not_found' when 5 then 'permanent' end"


@query(f"select event_id, coalesce({_KIND}, 'transient') in ('unknown', 'transient', 'rate_limited') as again from events")
def error_kind_retryable(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", progress.retryable(F.expr(_KIND)).alias("again"))


@query(f"with e as (select event_id, coalesce({_KIND}, 'transient') as kind, event_id % 8 as attempts from events) select event_id, attempts from e where kind not in ('unknown', 'transient', 'rate_limited') or attempts >= 6")
def dead_letters(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", F.expr(_KIND).alias("error_kind"), (F.col("event_id") % 8).alias("attempts"), F.col("user_id").cast("string").alias("ref"))
    return progress.failed(events)[1].select("event_id", "attempts")


# ---- the plan -------------------------------------------------------------

SYNC = P.Sync("contact:left-right", "left", "right", mapping.Mapping("contact", (mapping.FieldMap("email", "email", "emails.primary", transform="email_normalize"), mapping.FieldMap("segment", "segment", "info.segment"))), ("email",), "left_wins")


def _sides_of_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    left, right, links = _peers(spark, sf_dir)
    at = F.expr("timestamp '2024-01-01 00:00:00'")
    as_json = lambda head, tail: F.parse_json(F.concat(F.lit(head), F.upper("email"), F.lit(tail), F.col("seg"), F.lit('"}' + ("}" if "emails" in head else ""))))
    near = left.select(F.col("id").alias("remote_id"), at.alias("updated_at"), as_json('{"email":" ', ' ","segment":"').alias("record"))
    far = right.select(F.col("id").alias("remote_id"), at.alias("updated_at"), as_json('{"emails":{"primary":"', '"},"info":{"segment":"').alias("record"))
    return P.canonical(near, SYNC, "left"), P.canonical(far, SYNC, "right"), links


def _no_snapshots(spark: SparkSession) -> DataFrame:
    return empty(spark, "ref string, hash string, fields map<string,string>")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.planned(*_sides_of_plan(spark, sf_dir), _no_snapshots(spark), SYNC)


_PLAN = _PEERS + """,
lm as (select l.id, count(*) as n, min(r.id) as far from l join r on l.email = r.email group by 1), rm as (select r.id, count(*) as n, min(l.id) as far from r join l on l.email = r.email group by 1),
free as (select l.id as lid, lm.far as rid from l join lm on l.id = lm.id join rm on rm.id = lm.far where lm.n = 1 and rm.n = 1 and l.id not in (select a from links) and lm.far not in (select b from links)),
pairs as (select a as lid, b as rid from links union all select lid, rid from free),
p as (select 'update' as action, 'right:contact/' || rid as target, 'left:contact/' || lid as source, 'email=' || l.email || ';segment=' || l.seg as fields, 'both sides changed; the left side is the source of truth' as reason
      from pairs join l on lid = l.id join r on rid = r.id where l.seg <> r.seg or l.email <> r.email
      union all select 'create', 'right', 'left:contact/' || l.id, 'email=' || l.email || ';segment=' || l.seg, 'no match' from l left join links on l.id = a left join lm on l.id = lm.id where a is null and lm.n is null
      union all select 'create', 'left', 'right:contact/' || r.id, 'email=' || r.email || ';segment=' || r.seg, 'no match' from r left join links on r.id = b left join rm on r.id = rm.id where b is null and rm.n is null
      union all select 'review', 'right', 'left:contact/' || l.id, '', lm.n || ' records on right match on email' from l left join links on l.id = a join lm on l.id = lm.id where a is null and lm.n > 1
      union all select 'review', 'left', 'right:contact/' || r.id, '', rm.n || ' records on left match on email' from r left join links on r.id = b join rm on r.id = rm.id where b is null and rm.n > 1
      union all select 'review', 'right', 'left:contact/' || l.id, '', 'matched on email, but the record there has another match' from l left join links on l.id = a join lm on l.id = lm.id where a is null and lm.n = 1 and l.id not in (select lid from free)
      union all select 'review', 'left', 'right:contact/' || r.id, '', 'matched on email, but the record there has another match' from r left join links on r.id = b join rm on r.id = rm.id where b is null and rm.n = 1 and r.id not in (select rid from free))
"""


@query(_PLAN + "select * from p")
def plan_changes(spark, sf_dir):
    return _plan(spark, sf_dir).select("action", "target", "source", _shown(F.col("fields")).alias("fields"), "reason")


@query(_PLAN + "select action, count(*) as n from p group by 1")
def plan_summary(spark, sf_dir):
    return P.summary(_plan(spark, sf_dir))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    end = lambda side, mark, every: c.where(F.col("c_custkey") % every == 0).select(F.lit(side).alias("side"), F.concat(F.lit(mark), F.col("c_custkey").cast("string")).alias("remote_id"))
    return end("left", "L-", 2).unionByName(end("right", "R-", 3))


def _changes(rows: DataFrame) -> DataFrame:
    return rows.select("action", "target", "source", _shown(F.col("fields")).alias("fields"), "reason")


_ENDS = """, ends as (select a, b, case when cast(substr(a, 3) as bigint) % 2 = 0 then 'left' else 'right' end as side from links
 where cast(substr(a, 3) as bigint) % 2 = 0 or cast(substr(b, 3) as bigint) % 3 = 0)
"""


@query(_PLAN + _ENDS + """select 'delete' as action, case when side = 'left' then 'right:contact/' || b else 'left:contact/' || a end as target,
case when side = 'left' then 'left:contact/' || a else 'right:contact/' || b end as source, '' as fields, 'the source was deleted' as reason from ends
union all select * from p where not exists (select 1 from ends where action = 'update' and target = 'right:contact/' || b and source = 'left:contact/' || a)""")
def plan_deletes(spark, sf_dir):
    return _changes(P.planned(*_sides_of_plan(spark, sf_dir), _no_snapshots(spark), SYNC, _deleted(spark, sf_dir)))


@query(_PLAN + """select action, case when moved then source else target end as target, case when moved then target else source end as source,
case when moved then replace(fields, ';segment=' || seg, ';segment=EDITED') else fields end as fields, case when moved then 'only the right side changed' else reason end as reason
from (select p.*, l.seg, action = 'update' and l.k % 4 <> 0 and starts_with(target, 'right:contact/R-') and not contains(target, 'dup') as moved from p left join l on source = 'left:contact/' || l.id)""")
def plan_with_base(spark, sf_dir):
    left, right, links = _sides_of_plan(spark, sf_dir)
    base = _table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0")
    fields = F.create_map(F.lit("email"), F.concat(F.lit("s"), F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")), F.lit("segment"), D.tag_string(F.col("c_mktsegment")))
    ends = F.explode(F.array(F.concat(F.lit("left:contact/L-"), F.col("c_custkey").cast("string")), F.concat(F.lit("right:contact/R-"), F.col("c_custkey").cast("string"))))
    snapshots = base.select(ends.alias("ref"), fields.alias("fields")).select("ref", D.snapshot_hash(F.col("fields"), ["email", "segment"]).alias("hash"), "fields")
    return _changes(P.planned(left, right, links, snapshots, SYNC))


_ONE_WAY = P.Sync("contact:left-right", "left", "right", mapping.Mapping("contact", SYNC.mapping.fields, "left_to_right"), ("email",), "left_wins")


@query(_PLAN + """select p.* from p where action = 'update' and exists (select 1 from l left join links on l.id = a left join lm on l.id = lm.id where source = 'left:contact/' || l.id and (b is not null or lm.n = 1))
union all select * from p where action <> 'update' and starts_with(source, 'left:')""")
def plan_one_way(spark, sf_dir):
    left, right, links = _sides_of_plan(spark, sf_dir)
    return _changes(P.planned(left, right, links, _no_snapshots(spark), _ONE_WAY))


@query(_PLAN + "select 'contact:left-right' as sync, action, count(*) as n from p group by 2")
def changes_by_sync(spark, sf_dir):
    return report.by_sync(_plan(spark, sf_dir).withColumn("sync", F.lit(SYNC.name)))


_STATS_SQL = _CLASSIFIED.replace("with e as", ", e as").replace("r as (select distinct", "rr as (select distinct").replace("n as (select e.event_id", "tn as (select e.event_id").replace("from n left join r on n.ref = r.ref", "from tn left join rr on tn.ref = rr.ref").replace("r.ref is not null", "rr.ref is not null")


@query(_PLAN + _ENDS + _STATS_SQL + """, num as (select action, source, cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) as k from p where not exists (select 1 from ends where action = 'update' and target = 'right:contact/' || b and source = 'left:contact/' || a)),
done as (select null as verdict, case when action = 'review' then 'reviewed' when k % 17 = 0 then 'retried' when k % 19 = 0 then 'dead_letter' when action = 'create' then 'created' else 'updated' end as outcome from num
 union all select null, 'no_change' from pairs join l on lid = l.id join r on rid = r.id where not (l.seg <> r.seg or l.email <> r.email) and not exists (select 1 from ends where a = lid and b = rid)
 union all select null, 'deleted' from ends
 union all select verdict, case when verdict = 'echo' then 'echo' else 'skipped' end from v)
select stat, case stat when 'ingested' then count(*) when 'near_misses' then count(*) filter (verdict = 'near_miss') else count(*) filter (outcome = o) end as n
from done, (values ('ingested', ''), ('echoes', 'echo'), ('near_misses', ''), ('created', 'created'), ('updated', 'updated'), ('deleted', 'deleted'), ('reviewed', 'reviewed'), ('skipped', 'skipped'), ('no_change', 'no_change'), ('retried', 'retried'), ('dead_lettered', 'dead_letter')) t(stat, o) group by stat, o""")
def outcome_stats(spark, sf_dir):
    """The eleven counters of a cycle: its decisions, with errors in the peers' answers, and events that no sync routes."""
    left, right, links = _sides_of_plan(spark, sf_dir)
    ends = P.deleted_ends(_deleted(spark, sf_dir), links, SYNC)
    rows, _ = P.standing(P.decided(left, right, links, _no_snapshots(spark), SYNC), ends, SYNC)
    k = F.regexp_extract(F.coalesce("l_id", "r_id"), "([0-9]+)$", 1).cast("long")
    error = F.when(k % 17 == 0, "rate_limited").when(k % 19 == 0, "permanent")
    none = F.lit(None).cast("string")
    decided = rows.select(none.alias("verdict"), outcomes.after_errors(outcomes.decision_outcome(), error, F.lit(1)).alias("outcome"))
    deleted = ends.select(none.alias("verdict"), F.lit("deleted").alias("outcome"))
    seen = _classified(spark, sf_dir).select("verdict", F.when(origin.processed(F.col("verdict")), "skipped").otherwise("echo").alias("outcome"))
    return outcomes.stats(decided.unionByName(deleted).unionByName(seen))


@query(_PLAN + _ENDS + """, d as (select 'delete' as action, case when side = 'left' then 'right:contact/' || b else 'left:contact/' || a end as target, case when side = 'left' then 'left:contact/' || a else 'right:contact/' || b end as source, 0 as later from ends
union all select action, target, source, 1 from p where action <> 'review' and not exists (select 1 from ends where action = 'update' and target = 'right:contact/' || b and source = 'left:contact/' || a)),
o as (select *, row_number() over (order by starts_with(source, 'right'), later, source, action) as n from d)
select n, action, source, case when action = 'create' then target || ':contact/planned-' || n else target end as target from o""")
def plan_named(spark, sf_dir):
    """The plan's changes numbered in the order of events, by which records yet to be created are named."""
    plan = P.planned(*_sides_of_plan(spark, sf_dir), _no_snapshots(spark), SYNC, _deleted(spark, sf_dir))
    return P.named(plan, SYNC).select("n", "action", "source", "target")


@query(_CLASSIFIED + "select lpad(event_id::varchar, 12, '0') as id, ref, hash, verdict from v join e using (event_id)")
def echo_stream(spark, sf_dir):
    """echo_classify as a stream with state: first our writes, then the events."""
    e = _events(spark, sf_dir).select("event_id", F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("ref"), F.sha2(F.col("event_type").cast("binary"), 256).alias("hash"))
    at = lambda second: F.timestamp_seconds(F.lit(second))
    writes = e.where("event_id % 6 = 0").select("ref", "hash", at(0).alias("at"), at(100).alias("expires_at"), F.lit(None).cast("string").alias("id"))
    seen = e.select("ref", "hash", at(1).alias("at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    out, store = _folder(spark, "echo-stream"), "spark.sql.streaming.stateStore.providerClass"
    writes.unionByName(seen).write.parquet(f"{out}/traffic")
    before = spark.conf.get(store)
    verdicts = stateful.classified(stateful.prepared(spark).readStream.schema(stateful.TRAFFIC).parquet(f"{out}/traffic"))
    run = verdicts.writeStream.format("parquet").option("path", f"{out}/verdicts").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.set(store, before)
    return spark.read.schema(verdicts.schema).parquet(f"{out}/verdicts")


# ---- after a cycle --------------------------------------------------------

_NOW = "timestamp '2024-06-01 00:00:00'"


def _after(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    left, right, links = _sides_of_plan(spark, sf_dir)
    tables = {name: empty(spark, schema) for name, schema in state.TABLES.items()}
    tables["links"] = links.select("a", "b", F.expr("timestamp '2024-01-01 00:00:00'").alias("linked_at"))
    decisions = P.decided(left, right, links, tables["snapshots"], SYNC)
    l_ref, r_ref = P.refs(SYNC)
    source = F.coalesce(l_ref, r_ref)
    # the peers answer every create but those of customers whose number ends in 7
    created = decisions.where("outcome = 'create'").select(source.alias("source"), F.concat(F.lit("N-"), F.coalesce("l_id", "r_id")).alias("remote_id")).where("not endswith(source, '7')")
    return cycle.after(decisions, created, _deleted(spark, sf_dir), tables, SYNC, F.expr(_NOW))


_AFTER = _PLAN + _ENDS + """,
made as (select substr(source, instr(source, '/') + 1) as id, target, fields from p where action = 'create' and not source like '%7'),
kept as (select lid as a, rid as b from pairs where not exists (select 1 from ends where a = lid and b = rid)),
step as (select a, b, 'email=' || l.email || ';segment=' || l.seg as lf, 'email=' || l.email || ';segment=' || l.seg as rf, l.seg <> r.seg as to_right, false as to_left from kept join l on a = l.id join r on b = r.id
         union all select case when target = 'right' then id else 'N-' || id end, case when target = 'right' then 'N-' || id else id end, fields, fields, target = 'right', target = 'left' from made)
"""


@query(_AFTER + f"select a, b, case when (a, b) in (select (a, b) from links) then timestamp '2024-01-01 00:00:00' else {_NOW} end as linked_at from step")
def apply_links(spark, sf_dir):
    return _after(spark, sf_dir)["links"].select("a", "b", F.col("linked_at").cast("timestamp_ntz").alias("linked_at"))


@query(_AFTER + "select 'left:contact/' || a as ref, lf as fields from step union all select 'right:contact/' || b, rf from step")
def apply_snapshots(spark, sf_dir):
    return _after(spark, sf_dir)["snapshots"].select("ref", _shown(F.col("fields")).alias("fields"))


@query(_AFTER + "select 'left:contact/' || a as ref, 'email' as key_name, split_part(split_part(lf, ';', 1), '=', 2) as key_value from step union all select 'right:contact/' || b, 'email', split_part(split_part(rf, ';', 1), '=', 2) from step")
def apply_keys(spark, sf_dir):
    return _after(spark, sf_dir)["keys"].select("ref", "key_name", "key_value")


@query(_AFTER + f"select 'right:contact/' || b as ref, {_NOW} + interval 300 second as expires_at from step where to_right union all select 'left:contact/' || a, {_NOW} + interval 300 second from step where to_left")
def apply_origins(spark, sf_dir):
    return _after(spark, sf_dir)["origins"].select("ref", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


_PREFIXED = "strlen({0}) || ':' || {0}"
_WRITTEN = """, write as (
 select b as remote_id, 'left' as source, a as source_id, 'right' as target, rf as fields from step where to_right
 union all select a, 'right', b, 'left', lf from step where to_left),
payload as (select *, 's' || split_part(split_part(fields, ';', 1), '=', 2) as email, 's' || split_part(split_part(fields, ';', 2), '=', 2) as segment from write),
part as (select remote_id, starts_with(remote_id, 'N-') as created, source, source || ':contact/' || source_id as source_ref, target, case when starts_with(remote_id, 'N-') then '' else target || ':contact/' || remote_id end as target_ref,
         sha256('5:email' || strlen(email) || ':' || email || '7:segment' || strlen(segment) || ':' || segment) as hash from payload)
"""


@query(_AFTER + _WRITTEN + f"select remote_id, created, sha256('18:contact:left-right7:contact' || {' || '.join(_PREFIXED.format(c) for c in ('source', 'source_ref', 'target', 'target_ref', 'hash'))}) as key from part")
def apply_idem(spark, sf_dir):
    return _after(spark, sf_dir)["idem"].select("remote_id", "created", "key")


@query(_PLAN + """, gone as (select id from r where k % 4 = 0),
d as (select a, b from links where b in (select id from gone))
select 'create' as action, 'right' as target, 'left:contact/' || a as source, 'email=' || l.email || ';segment=' || l.seg as fields, 'the linked record is not there' as reason from d join l on a = l.id""")
def plan_dangling(spark, sf_dir):
    """Linked records whose other end is no longer there, and not known as deleted."""
    left, right, links = _sides_of_plan(spark, sf_dir)
    plan = P.planned(left, right.where("not regexp_extract(remote_id, '([0-9]+)$', 1) % 4 = 0"), links, _no_snapshots(spark), SYNC)
    return _changes(plan).where("reason = 'the linked record is not there'")


# ---- peers: reading changes, writing once ---------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _peer(spark: SparkSession, sf_dir: str, stream: bool = False):
    connector.register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("peer").options(path=f"{sf_dir}/orders.parquet", id="o_orderkey", updated_at="o_orderdate", columns="o_orderkey,o_orderdate,o_orderstatus").load()


@query(f"select o_orderkey, o_orderdate, o_orderstatus from orders where o_orderdate >= {_MARK} - interval 120 second")
def connector_delta(spark, sf_dir):
    """A peer's changes since a mark, the time taken down to its row groups."""
    start = progress.since(F.expr(_MARK), progress.overlap()).cast("timestamp_ntz")
    return progress.delta(_peer(spark, sf_dir), "o_orderdate", start)


@query("select o_orderkey, o_orderdate, o_orderstatus from orders")
def connector_stream(spark, sf_dir):
    """The same peer as a stream, from its first change to its last; a second run finds nothing new."""
    out = _folder(spark, "connector-stream")
    for _ in range(2):
        changes = _peer(spark, sf_dir, stream=True)
        run = changes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{out}/rows")


@query(_PLAN + _ENDS + """, sent as (select *, not exists (select 1 from ends where action = 'update' and target = 'right:contact/' || b and source = 'left:contact/' || a) as stands from p where action in ('create', 'update')),
doc as (select action, substr(target, 1, instr(target || ':', ':') - 1) as connector, split_part(split_part(fields, ';', 1), '=', 2) as email, split_part(fields, 'segment=', 2) as seg, fields from sent where stands)
select connector, case when connector = 'left' then '{"email":"' || email || '","segment":"' || seg || '"}' else '{"emails":{"primary":"' || email || '"},"info":{"segment":"' || seg || '"}}' end as record,
       case when action = 'create' then 1 else 2 end::bigint as version, false as deleted from doc
union all select case when side = 'left' then 'right' else 'left' end, null, 2, true from ends""")
def write_once(spark, sf_dir):
    """A cycle's writes, sent three times: twice as one batch, once as another.  Shown: the versions that they leave at the peers."""
    left, right, links = _sides_of_plan(spark, sf_dir)
    decisions = P.decided(left, right, links, _no_snapshots(spark), SYNC)
    out, now = _folder(spark, "write-once"), F.expr(_NOW)
    targets = {"left": peers.Target(f"{out}/left", ("email", "segment")), "right": peers.Target(f"{out}/right", ("emails", "info"))}
    for side, rows in (("left", left), ("right", right)):
        there = rows.select("remote_id", F.lit(1).cast("long").alias("version"), "updated_at", F.lit(False).alias("deleted"), SYNC.mapping.from_canonical(F.col("fields"), side).alias("record"), F.array().cast("array<string>").alias("keys"))
        peers.append_once(there, targets[side].folder, "0")
    sent = cycle.writes(decisions, _deleted(spark, sf_dir), links, SYNC, now)
    peers.append_once(sent, f"{out}/sent", "1")
    sent = peers.log(spark, f"{out}/sent", peers.WRITES)
    for batch in ("1", "1", "2"):
        peers.write(sent, targets, f"{out}/state", batch, now)
    versions = [peers.log(spark, t.folder, peers.PEER).where("size(keys) > 0").select(F.lit(side).alias("connector"), F.when(~F.col("deleted"), F.col("record")).alias("record"), "version", "deleted") for side, t in targets.items()]
    return versions[0].unionByName(versions[1])


@query(_PLAN + """, now_left as (select id, email, case when k % 11 = 0 then 'MOVED' else seg end as seg from l where k % 17 <> 0),
doc as (select 'left' as connector, email, seg from now_left
 union all select 'left', r.email, r.seg from p join r on source = 'right:contact/' || r.id where action = 'create' and target = 'left'
 union all select 'right', n.email, n.seg from now_left n join pairs on lid = n.id
 union all select 'right', n.email, n.seg from now_left n join p on source = 'left:contact/' || n.id where action = 'create' and target = 'right'
 union all select 'right', email, seg from r where id not in (select rid from pairs))
select connector, case when connector = 'left' then '{"email":"' || email || '","segment":"' || seg || '"}' else '{"emails":{"primary":"' || email || '"},"info":{"segment":"' || seg || '"}}' end as record from doc""")
def run_cycles(spark, sf_dir):
    """Two cycles between peers that hold the given records, with edits and deletes of left ones in between.  Shown: what the peers then hold."""
    left, right, links = _sides_of_plan(spark, sf_dir)
    out, number = _folder(spark, "run-cycles"), F.regexp_extract("remote_id", "([0-9]+)$", 1).cast("long")
    targets = {side: peers.Target(f"{out}/{side}") for side in ("left", "right")}

    def version(rows: DataFrame, side: str, n: int, fields: Column, at: Column, deleted: Column) -> None:
        record = SYNC.mapping.from_canonical(fields, side).alias("record")
        peers.append_once(rows.select("remote_id", F.lit(n).cast("long").alias("version"), at.alias("updated_at"), deleted.alias("deleted"), record, F.array().cast("array<string>").alias("keys")), targets[side].folder, f"edit-{n}")

    for side, rows in (("left", left), ("right", right)):
        version(rows, side, 1, F.col("fields"), F.expr("timestamp '2024-01-01 00:00:00'") - F.make_dt_interval(days=(number % 100).cast("int")), F.lit(False))
    versions.commit(spark, f"{out}/state", 1, {"links": (links.withColumn("linked_at", F.expr(_NOW)), None)})
    cycles.once(spark, SYNC, targets, f"{out}/state", F.expr(_NOW))
    edited = left.where((number % 11 == 0) | (number % 17 == 0))
    version(edited, "left", 2, cycle.merged(F.col("fields"), F.create_map(F.lit("segment"), D.tag_string(F.lit("MOVED")))), F.expr(f"{_NOW} + interval 1 day"), number % 17 == 0)
    cycles.once(spark, SYNC, targets, f"{out}/state", F.expr(f"{_NOW} + interval 2 days"))
    held = [peers.current(peers.log(spark, t.folder, peers.PEER)).where("not deleted").select(F.lit(side).alias("connector"), "record") for side, t in targets.items()]
    return held[0].unionByName(held[1])


@query("""with v2 as (select c_name as ref, case when c_custkey % 3 = 0 then 'second' else c_mktsegment end as hash, c_custkey as k from customer)
select 2 as version, ref, hash from v2 union all select 3, ref, case when k % 4 = 0 then 'third' else hash end from v2 where k % 5 <> 0""")
def state_versions(spark, sf_dir):
    """Snapshots in three versions, a base made of the second; the second and third as they read."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("ref"), F.col("c_mktsegment").alias("hash"), F.lit(None).cast("map<string,string>").alias("fields"), F.expr(_NOW).alias("at"))
    out = _folder(spark, "state-versions")
    versions.commit(spark, out, 1, {"snapshots": (c, None)})
    versions.commit(spark, out, 2, {"snapshots": (c.where("c_custkey % 3 = 0").withColumn("hash", F.lit("second")), None)})
    versions.compacted(spark, out, F.expr(_NOW))
    versions.commit(spark, out, 3, {"snapshots": (c.where("c_custkey % 4 = 0").withColumn("hash", F.lit("third")), c.where("c_custkey % 5 = 0"))})
    rows = [versions.read(spark, out, v)["snapshots"].select(F.lit(v).alias("version"), "ref", "hash") for v in (2, 3)]
    return rows[0].unionByName(rows[1])


@query(_PEERS + """, member as (select email, 'left:contact/' || id as ref, 'left' as side from l union all select email, 'right:contact/' || id, 'right' from r),
own as (select email, 'left:contact/' || a as l_ref, 'right:contact/' || b as r_ref from links join l on a = l.id),
n as (select email, count(*) filter (side = 'left') as lefts, count(*) filter (side = 'right') as rights, min(ref) filter (side = 'left') as l_ref, min(ref) filter (side = 'right') as r_ref from member where email not in (select email from own) group by 1)
select case when lefts + rights = 2 then 'pair' else 'create' end as action, l_ref as left, r_ref as right, case when lefts + rights = 1 then coalesce(l_ref, r_ref) end as source from n where lefts <= 1 and rights <= 1
union all select 'review', case when side = 'left' then ref end, case when side = 'right' then ref end, ref from member join n using (email) where lefts > 1 or rights > 1
union all select 'review', case when side = 'left' then ref end, case when side = 'right' then ref end, ref from member join own using (email) where ref not in (l_ref, r_ref)
union all select 'linked', l_ref, r_ref, null from own""")
def serial_decisions(spark, sf_dir):
    """Both peers' records as events of one batch, decided by logical record."""
    left, right, links = _peers(spark, sf_dir)
    named = lambda rows, side: rows.select(F.concat(F.lit(f"{side}:contact/"), "id").alias("ref"), F.lit(side).alias("side"), F.col("k").alias("at"), "email")
    e = named(left, "left").unionByName(named(right, "right"))
    known = spark.createDataFrame([], "ref string, side string, key_name string, key_value string")
    pairs = links.select(F.concat(F.lit("left:contact/"), "a").alias("a"), F.concat(F.lit("right:contact/"), "b").alias("b"))
    return serial.decided(e.drop("email"), e.select("ref", F.lit("email").alias("key_name"), F.col("email").alias("key_value")), known, pairs).drop("group")


# ---- routing, deliveries over time, queues, diagnosis ---------------------


@query("select event_type, sum(case when event_id % 10 = 0 then 3 when event_id % 4 = 0 then 1 else 2 end)::bigint as n from events group by 1")
def delivery_ttl(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.lit("left").alias("connector"), F.expr("case when event_id % 10 = 0 then '' else 'd-' || event_id end").alias("delivery"), F.col("event_type").alias("kind"), F.lit("x").alias("remote_id"), "at")
    again = lambda hours: e.withColumn("at", F.col("at") + F.expr(f"interval {hours} hours"))
    seen = again(-1).where("event_id % 4 = 0").drop("event_id")
    return deliveries.once(e.unionByName(again(1)).unionByName(again(30)).drop("event_id"), seen).groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


@query("select event_id, sync from events join (values ('left', 'purchase', 'both'), ('right', 'purchase', 'both'), ('left', 'click', 'forth'), ('right', 'view', 'back')) t(connector, kind, sync) on event_type = kind and connector = case when event_id % 2 = 0 then 'left' else 'right' end")
def route_events(spark, sf_dir):
    sync = lambda name, kind, direction: P.Sync(name, "left", "right", mapping.Mapping(kind, SYNC.mapping.fields, direction), ("email",))
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("connector"), F.col("event_type").alias("kind"))
    return cycle.routed(e, [sync("both", "purchase", "bidirectional"), sync("forth", "click", "left_to_right"), sync("back", "view", "right_to_left")]).select("event_id", "sync")


_WINDOWED = "case when event_id % 3 = 0 then 600 when event_id % 3 = 1 then 300 else 30 end"


@query(f"select event_id, ts + {_WINDOWED} * interval 1 second as expires_at from events")
def echo_windows(spark, sf_dir):
    connector = F.element_at(F.array(F.lit("slow"), F.lit("usual"), F.lit("fast")), (F.col("event_id") % 3 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", origin.expiry(connector, F.col("at"), {"slow": 600, "fast": 30}).cast("timestamp_ntz").alias("expires_at"))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.concat(F.lit("q-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("contact").alias("sync"), F.col("event_type").alias("payload"), "at", "event_id")


@query("select 'submitted' as part, 'q-' || lpad(event_id::varchar, 8, '0') as id, null as problem from events where event_id % 7 = 0 and event_id % 5 <> 0 union all select 'left', 'q-' || lpad(event_id::varchar, 8, '0'), null from events where not (event_id % 7 = 0 and event_id % 5 <> 0) union all select 'problem', 'q-' || lpad(event_id::varchar, 8, '0'), 'sync old is not configured' from events where event_id % 35 = 0 union all select 'problem', 'none', 'no such item'")
def dlq_replay(spark, sf_dir):
    dead = _dead(spark, sf_dir)
    ids = dead.where("event_id % 7 = 0").select("id").unionByName(spark.createDataFrame([("none",)], "id string"))
    submitted, left, wrong = state.replayed(dead, ids, ["contact"])
    part = lambda name, rows, problem: rows.select(F.lit(name).alias("part"), "id", problem.alias("problem"))
    none = F.lit(None).cast("string")
    return part("submitted", submitted, none).unionByName(part("left", left, none)).unionByName(part("problem", wrong, F.col("problem")))


@query("select event_id from events where event_id % 3 <> 0")
def queue_discard(spark, sf_dir):
    dead = _dead(spark, sf_dir)
    return state.discarded(dead, dead.where("event_id % 3 = 0")).select("event_id")


@query("select event_id from events where event_id % 2 = 0 or ts > timestamp '2024-01-15 00:00:00' order by reverse(event_id::varchar) limit 40")
def list_in_key_order(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("expires_at", F.when(F.col("event_id") % 2 != 0, F.col("at"))).withColumn("key", F.reverse(F.col("event_id").cast("string")))
    return state.listed(rows, "key", 40, F.expr("timestamp '2024-01-15 00:00:00'")).select("event_id")


@query("select event_id from events where event_id % 4 = 0 or ts <= timestamp '2024-01-10 00:00:00'")
def delayed_due(spark, sf_dir):
    queue = _events(spark, sf_dir).select("event_id", F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("at")).alias("not_before"))
    return state.due(queue, F.expr("timestamp '2024-01-10 00:00:00'")).select("event_id")


def _idem(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    now = F.expr(_NOW)
    return _events(spark, sf_dir).where(which).select(F.col("event_id").cast("string").alias("key"), F.lit("r").alias("remote_id"), F.lit(False).alias("created"), F.lit(False).alias("in_flight"), now.alias("written_at"), F.when(F.col("event_id") % 5 == 0, now).otherwise(now + F.expr("interval 1 hour")).alias("expires_at"))


@query("select event_id::varchar as key, not (event_id % 2 = 0 and event_id % 5 <> 0) as in_flight from events where event_id % 3 = 0 or (event_id % 2 = 0 and event_id % 5 <> 0)")
def idem_begin(spark, sf_dir):
    writes = _events(spark, sf_dir).where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("key"))
    return progress.begun(writes.union(writes), _idem(spark, sf_dir, "event_id % 2 = 0"), F.expr(_NOW)).select("key", "in_flight")


@query("select event_id::varchar as key, event_id % 3 <> 0 as in_flight from events where event_id % 3 <> 1")
def idem_settle(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("key"), "event_id")
    results = e.select("key", F.lit("r").alias("remote_id"), F.lit(True).alias("created"), (F.col("event_id") % 3 != 0).alias("failed"), F.when(F.col("event_id") % 3 == 1, "permanent").alias("error_kind"))
    return progress.settled(progress.begun(e, _idem(spark, sf_dir, "false"), F.expr(_NOW)), results, F.expr(_NOW)).select("key", "in_flight")


@query("select event_id, case when event_id % 2 = 0 then 'unknown' when event_id % 3 = 0 then 'auth' else 'transient' end as kind, event_id % 3 = 0 as answered from events")
def error_kinds(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "auth")
    return _table(spark, sf_dir, "events").select("event_id", progress.kind_of(kind, F.col("event_id") % 2 != 0).alias("kind"), progress.answered(kind).alias("answered"))


@query("select distinct o_custkey as id from orders where o_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1998-01-01 00:00:00')")
def deleted_scan(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate")
    return progress.deleted_scan(orders, orders.where("o_orderdate >= timestamp '1998-01-01 00:00:00'"), "id")


@query("select o_orderkey from orders order by o_orderdate, o_orderkey limit 30")
def delta_in_order(spark, sf_dir):
    return progress.in_order(_table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@query("select 'dlq' as collection, count(*) as n from events union all select 'empty', 0 union all select 'idem', count(*) from events where event_id % 2 = 0 and event_id % 5 <> 0")
def collection_lengths(spark, sf_dir):
    dead = _dead(spark, sf_dir)
    return state.lengths({"dlq": dead, "empty": dead.limit(0), "idem": _idem(spark, sf_dir, "event_id % 2 = 0")}, F.expr(_NOW))


@query(f"""select * from (values ('connector', 'left/contact', true, '2 fields'), ('connector', 'right/contact', true, '2 fields'), ('mapping', 'contact:left-right', false, 'left: segment is missing'), ('watermark', 'right/contact', true, 'not set yet; the next run backfills'), ('queue', 'review queue', true, 'empty')) t(name, subject, ok, detail)
union all select 'watermark', 'left/contact', true, case when s >= 3600 then (s // 3600) || 'h' else '' end || case when s >= 60 then (s % 3600 // 60) || 'm' else '' end || (s % 60) || 's behind' from (select cast(epoch({_NOW}) - epoch(date_trunc('second', max(o_orderdate))) as bigint) as s from orders)
union all select 'queue', 'dead-letter queue', false, count(*) || ' items that exhausted their attempts' from events""")
def doctor_checks(spark, sf_dir):
    """Peers described by the records they hold, one without a field that is mapped; a watermark from the last change; a queue."""
    c = _table(spark, sf_dir, "customer")
    held = {"left": F.to_json(F.struct(F.col("c_name").alias("email"), F.col("c_nationkey").alias("nation"))), "right": F.to_json(F.struct(F.struct(F.col("c_name").alias("primary")).alias("emails"), F.struct(F.col("c_mktsegment").alias("segment")).alias("info")))}
    known = [fixtures.described(c.select(F.parse_json(doc).alias("record"))).select(F.lit(side).alias("connector"), F.lit("contact").alias("kind"), "field", "read_only", F.lit(None).cast("string").alias("error")) for side, doc in held.items()]
    marks = _table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("mark")).select(F.lit("left").alias("connector"), F.lit("contact").alias("kind"), "mark")
    return cycle.diagnosis(known[0].unionByName(known[1]), marks, _table(spark, sf_dir, "events").select(F.lit("dlq").alias("queue")), [SYNC], F.expr(_NOW)).drop("k")


# Fixed values of the queries: rate a second and burst; the other peers have the default
_LIMITS = {"view": (1 / 1500, 3), "click": (1 / 1200, 5), "error": (1 / 7200, 1)}


@query("""with c as (select event_id, event_type, epoch_us(ts) as a, row_number() over (partition by event_type order by ts, event_id) as i,
  case event_type when 'view' then 1500000000 when 'click' then 1200000000 when 'error' then 7200000000 else 200000 end as step,
  case event_type when 'view' then 3 when 'click' then 5 when 'error' then 1 else 10 end as burst from events)
select event_id, cast(greatest(0, (i - burst) * step - a + max(a - (i - 1) * step) over (partition by event_type order by i)) as bigint) as wait_micros from c""")
def rate_limit_waits(spark, sf_dir):
    """How long each event, as a call to the peer of its type, waits for a token of that peer's bucket."""
    calls = _table(spark, sf_dir, "events").select(F.col("event_type").alias("peer"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return pacing.paced(calls, _LIMITS).select(F.col("id").alias("event_id"), "wait_micros")
