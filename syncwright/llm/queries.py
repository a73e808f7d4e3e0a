"""The operators as registered queries, with production parameters, and their DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, html_crf, licenses, line_dedup, near_dedup, packing, pii_crf, quality_classifier, quality_rules, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(_table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document stands at source/lang/doc_id, so a source's language is one directory."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.licences(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(k % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", label), k % 100 == 0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_near_dedup, op3_quality_rules, op4_decontamination, op5_pii, op6_toxicity, op7_license_scan, op8_quality_classifier, op9_packing, op10_line_dedup, op11_hard_negatives, op12_bpe, op13_vector_codes)
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2_SQL = rf"""
with recursive words as (select doc_id, {_WORDS} as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             when len(w) > 0 then ['short ' || array_to_string(w, ' ')] else [] end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as item from sets),
links as (select a.doc_id as a, b.doc_id as b from items a join items b on a.item = b.item and a.doc_id < b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as seen from sets union select r.node, e.b from reach r join edges e on r.seen = e.a),
roots as (select node, min(seen) as root from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.root as component_id, s.doc_id = r.root as kept
from sets s join roots r on s.doc_id = r.node
"""

OP10_SQL = r"""
with raw as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, text is null as missing from documents),
line as (select doc_id, unnest(range(len(lines))) as line_no, unnest(lines) as line from raw),
words as (select doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from line),
sets as (select doc_id, line_no, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                      else ['short ' || array_to_string(w, ' ')] end as s from words where len(w) > 0),
content as (select list_sort(s) as s, min({'d': doc_id, 'l': line_no}) as first, row_number() over () as c from sets group by 1),
items as (select c, first, len(s) as n, unnest(s) as item from content),
near as (select b.c from items a join items b on a.item = b.item and a.first < b.first
         group by a.c, b.c, a.n, b.n having 4 * count(*) >= 3 * (a.n + b.n - count(*))),
gone as (select x.doc_id, x.line_no from sets x join content k on list_sort(x.s) = k.s
         where k.c in (select c from near) or k.first <> {'d': x.doc_id, 'l': x.line_no}),
listed as (select doc_id, list_sort(list(line_no)) as g from gone group by doc_id)
select r.doc_id, cast(case when r.missing then 0 else len(r.lines) end as bigint) as n_lines, cast(coalesce(len(g), 0) as bigint) as n_removed,
       coalesce(array_to_string(g, ','), '') as removed_lines
from raw r left join listed using (doc_id)
"""

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}0-9]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({k}, '{licence}', '{kind}', '{w}', {n})" for k, licence, kind, w, n in licenses.ROWS)

OP7_SQL = rf"""
with recursive template(template, licence, kind, word, n) as (values {_TEMPLATES}),
docs as (select doc_id, source || '/' || lang || '/' || doc_id as path, source || '/' || lang as dir, text from documents),
texts as (select doc_id, regexp_replace(text, '^[^\p{{L}}0-9]+', '') as text from docs where text is not null),
known as (select distinct word from template),
seen as (select word, count(*) as df from (select distinct doc_id, unnest({_TOKENS.format("text")}) as word from texts) join known using (word) group by 1),
total as (select count(*) as texts from texts),
idf as (select word, ln((1 + total.texts) / (1 + coalesce(df, 0))) + 1 as idf from known left join seen using (word), total),
weighed as (select template, licence, kind, word, t.n * idf as weight from template t join idf using (word)),
size as (select template, sqrt(sum(weight * weight)) as size from weighed group by 1),
parts as (select doc_id, 'text' as level, 0 as k, text as part from texts
          union all select doc_id, 'paragraph', unnest(range(1, 1 + len(regexp_split_to_array(text, '\n[^\p{{L}}0-9]*\n')))), unnest(regexp_split_to_array(text, '\n[^\p{{L}}0-9]*\n')) from texts
          union all select doc_id, 'line', unnest(range(len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) from texts),
words as (select doc_id, level, k, {_TOKENS.format("part")} as w from parts),
token as (select doc_id, level, k, len(w) as n, unnest(w) as word from words),
counted as (select doc_id, level, k, n, word, count(*) as tf from token where word not in ({", ".join(f"'{w}'" for w in licenses.STOP)}) group by all),
own as (select doc_id, level, k, n, word, tf * coalesce(idf, ln(1 + total.texts) + 1) as own_weight from counted left join idf using (word), total),
own_size as (select doc_id, level, k, sqrt(sum(own_weight * own_weight)) as own from own group by all),
dot as (select doc_id, level, k, n, template, licence, kind, sum(own_weight * weight) as dot from own join weighed using (word) group by all having count(*) >= 2),
match as (select doc_id, level, k, n, licence, kind, round(dot / size / own, 6) as cosine from dot join size using (template) join own_size using (doc_id, level, k) where round(dot / size / own, 6) >= 0.7),
best_part as (select doc_id, level, k, n, min({{'less': -cosine, 'licence': licence, 'kind': kind}}) as best from match group by all),
held as (select doc_id, min(best) as best, bool_or(level = 'text' or (level = 'paragraph' and k = 1 and best.kind = 'heading')) as whole,
                greatest(sum(case when level = 'paragraph' then n else 0 end), sum(case when level = 'line' then n else 0 end)) as covered from best_part group by 1),
placed as (select docs.doc_id, path, dir, best, coalesce(whole or 2 * covered >= len({_TOKENS.format("text")}), false) as is_file from docs left join held using (doc_id)),
given as (select dir as up, min({{'best': best, 'doc_id': doc_id}}).best.licence as handed from placed where is_file group by 1),
nearest as (select dir, max_by(handed, length(up)) as handed from (select distinct dir from placed) join given on dir = up or starts_with(dir, up || '/') group by 1)
select doc_id, path, coalesce(best.licence, handed) as licence, -best.less as cosine,
       case when best is not null then case when is_file then 'file' else 'own' end when handed is not null then 'inherited' end as origin
from placed left join nearest using (dir)
"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP11_SQL = f"""
with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
              from embeddings where label is not null and {_FINITE}),
pairs as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
          from kept a join kept b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
             qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positive join pairs using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256, width: int = 16) -> str:
    """Plain Lloyd, round by round: entries b0, b1, ... and the assignments a0, a1, ... to them."""
    steps = [
        f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings where {_FINITE})",
        f"part as materialized (select vec_id, p, q[{width} * p + 1:{width} * p + {width}] as x from kept, range({parts}) t(p))",
        f"b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from part where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    for k in range(rounds + 1):
        far = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        steps.append(f"a{k} as materialized (select vec_id, p, any_value(x) as x, min(row(cast({far} as bigint), e)) as best from part join b{k} using (p) group by vec_id, p)")
        if k < rounds:
            at = ", ".join(f"floor(sum(x[{j}]) / count(*))" for j in range(1, width + 1))
            steps.append(f"b{k + 1} as materialized (select p, e, coalesce(m, c) as c from b{k} left join (select p, best[2] as e, [{at}] as m from a{k} group by p, best[2]) using (p, e))")
    return f"""
with {", ".join(steps)},
coded as (select vec_id, label, string_agg(lower(lpad(hex(best[2]), 2, '0')), '' order by p) as code, cast(sum(best[1]) as bigint) as error from a{rounds} join kept using (vec_id) group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(list_transform(c, lambda v: cast(v as bigint)), ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256
from coded
"""


OP13_SQL = _codes_sql()

ORACLE_SQL = {"op11_hard_negatives": OP11_SQL, "op13_vector_codes": OP13_SQL, "op2_near_dedup": OP2_SQL, "op7_license_scan": OP7_SQL, "op10_line_dedup": OP10_SQL}
