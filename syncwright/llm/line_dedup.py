"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its five-word shingles (lower-cased words); a line of fewer
words is the set of its whole word sequence.  A line is removed if an earlier line,
by (doc_id, line number), has a similarity of 0.75 or more.

1.  Equal lines are one content, named by its first place.  Lines that make up over
    1 / HOT of all are left out of what follows but for their first place.
2.  Every content names its signature: the hashes of its s smallest items.  Of a set
    of n items at most n / 4 are missing in a similar one, so of two similar
    sets the one whose signature ends first finds all but its missing items in the
    other's signature.  A pair of which one content's signature holds no item that more
    than FEW lines have meets in items of few lines: such pairs are counted, and those
    that share enough items are compared.  Of the other contents, those that share
    enough items with others go on.
3.  Items of those are counted over all of them and ordered by rarity.  Items that no
    other content has come first and join nothing; a content meets others by its
    n / 4 + 1 rarest items at most (prefix filter).  Length and positional filters
    stand in the join: what precedes the first common item is missing.
4.  Each content first meets the earliest and the most repeated content that it
    shares most items with; what those remove meets nobody else.  Jaccard is
    computed on the full sets of the pairs left.

Defined cases: null texts have no lines; lines without words stay; rows that repeat
a doc_id are one document, whose lines at one place are not compared with each
other; a null doc_id keeps its lines; of equal or similar lines (ties) the first by
(doc_id, line number) stays; texts and lines of any length are read whole;
clean_documents drops a document of which every line with words was removed;
an empty table gives an empty result; extra columns are carried through unchanged,
whatever their names.  Lines and items are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

HOT = 1 << 14  # a line or item with more than a HOT-th of all rows is hot: there are fewer than HOT of them
SHARES = 1 << 10  # tasks that a hot item is dealt to, at most
PLACES = HOT * SHARES
CELLS = 1 << 22  # hashed places behind the filter of lines to be read again: a bound for its broadcast
FEW = 32  # lines that share an item of their signatures: up to so many meet in pairs; the work depends on it, not the result
SAMPLE = 256  # one content of so many is looked at for hot items; how rows are dealt depends on it, not the result


def _words(line: Column) -> Column:
    """The words of one line; splitting at a single plain space takes no regular expression."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    plain = F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(plain, " ", -1), "")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h) of the lower-cased lines with a word."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value): an array that is worked out once and not written as a column between."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_items(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, items) of rows (keep, line); items: the sorted hashes of its distinct shingles, made of the pairs at its first, third and fourth word."""

    def hashed(words: Column) -> Column:
        pair = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
        five = _let(pair, lambda pair: F.transform(pair, lambda p, i: F.xxhash64(p, F.get(pair, i + 2), F.get(pair, i + 3))))
        return F.when(F.size(words) >= 5, F.slice(five, F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)))).otherwise(F.array(F.xxhash64(F.lit("short"), words)))

    return rows.select(*keep, F.sort_array(F.array_distinct(_let(_words(F.col("line")), hashed))).alias("items"))


def _missing(n: Column, m: Column) -> Column:
    """How many of n items a similar set of m may lack: the overlap is 3 (n + m) / 7 at least."""
    return n - F.floor((3 * (n + m) + 6) / 7)


def _signature_size(n: Column) -> Column:
    """An eighth more than the n / 4 + 1 items of which a similar set has one."""
    most = F.floor(n / 4) + 1
    return F.least(n, most + F.ceil(most / 8)).cast("int")


def _by_rarity(rows: DataFrame, hot_item: DataFrame) -> DataFrame:
    """(h, n, order) of rows (h, n, item): the items that several h have, as (how often, item), the rarest first.

    Hot items are dealt out over tasks and rank last: that others have them is known.  In the
    shuffle they go by number and share, below PLACES, and come out by number; the items
    whose hashes lie there give way.  So a row is three numbers, of which there is one for each item.
    """
    rows, own = rows.join(F.broadcast(hot_item), "item", "left"), F.col("item")
    cold = F.when((own >= 0) & (own < PLACES), own + PLACES).otherwise(own)
    rows = rows.select(F.when(F.col("hot").isNotNull(), F.col("hot") * SHARES + F.pmod("h", F.lit(SHARES))).otherwise(cold).alias("item"), "h", "n")
    group, hot = Window.partitionBy("item"), (own >= 0) & (own < PLACES)
    rows = rows.select("item", "h", "n", F.min("h").over(group).alias("lo"), F.max("h").over(group).alias("hi"), F.count("*").over(group).alias("df"))
    df, item = F.when(hot, F.lit(1 << 40)).otherwise(F.col("df")), F.when(hot, F.floor(own / SHARES)).otherwise(own)
    rows = rows.where((F.col("lo") != F.col("hi")) | hot).select("h", "n", F.struct(df.alias("df"), item.alias("item")).alias("o"))
    return rows.groupBy("h").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("o")).alias("order"))


def _prefix(ordered: DataFrame) -> DataFrame:
    """(h, n, i, item) of the items that may be the first common one with a similar set; i: its place among all n by rarity."""
    rows = ordered.select("h", "n", F.posexplode("order").alias("k", "o"), (F.col("n") - F.size("order")).alias("alone"))
    return rows.select("h", "n", (F.col("alone") + F.col("k")).alias("i"), "o.item").where(F.col("i") <= F.floor(F.col("n") / 4))


def _least_shared(n: Column) -> Column:
    """How many items of its signature a set of n, or more, has in common with the longer signature of a similar set."""
    return _signature_size(n) - F.floor(n / 4)


def _pairs_of_few(shared: DataFrame) -> DataFrame:
    """(h, other) that share enough items which few lines have, of the rows (h, n, common, df, item); common: has an item of many lines, too."""
    few = shared.where(F.col("df") <= FEW).drop("df")
    n, m = F.col("a.n"), F.col("b.n")
    met = few.alias("a").join(few.alias("b"), F.col("a.item") == F.col("b.item"))
    met = met.where((F.col("a.h") < F.col("b.h")) & ~(F.col("a.common") & F.col("b.common")) & (4 * F.least(n, m) >= 3 * F.greatest(n, m)))
    met = met.select("a.h", F.col("b.h").alias("other"), n.alias("n"), m.alias("m"))
    n, m = F.col("n"), F.col("m")
    least = F.least(_signature_size(n) - _missing(n, m), _signature_size(m) - _missing(m, n))
    return met.groupBy("h", "other", "n", "m").agg(F.count("*").alias("met")).where(F.col("met") >= least).select("h", "other")


def _in_cells(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """rows whose hashed place is that of a row of `wanted`, and some more: CELLS places at most are broadcast."""
    cell = F.pmod(F.xxhash64(*key), F.lit(CELLS)).cast("int")
    return rows.withColumn("cell", cell).join(F.broadcast(wanted.select(cell.alias("cell")).distinct()), "cell", "left_semi").drop("cell")


def _of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the contents of the pairs (h, other), and some more."""
    return _in_cells(sets, pairs.select(F.explode(F.array("h", "other")).alias("h")), "h")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later content h of each of the pairs (h, other) whose sets have a similarity of 0.75; two at one place are not compared."""
    one = pairs.join(sets.select("h", F.col("at").alias("at1"), F.col("items").alias("x")), "h")
    both = one.join(sets.select(F.col("h").alias("other"), F.col("at").alias("at2"), F.col("items").alias("y")), "other").where("at1 <> at2")
    # 4 both >= 3 (n + m - both)
    both = both.where(7 * F.size(F.array_intersect("x", "y")) >= 3 * (F.size("x") + F.size("y")))
    return both.select(F.when(F.col("at1") > F.col("at2"), F.col("h")).otherwise(F.col("other")).alias("h")).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, h) of every line that an earlier line equals or nearly equals; h: xxhash64 of it, lower-cased."""
    store = Store(docs.sparkSession, "line-dedup")
    lines = _lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    # contents: their first places and how often they occur; the signatures of a few show which items are hot
    sampled = F.when(F.pmod("h", F.lit(SAMPLE)) == 0, F.col("line"))
    place = store.save(lines.select("doc_id", "line_no", "h", sampled.alias("line")), "places")
    first = place.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("copies"))
    first = store.save(first.select("h", "at.doc_id", "at.line_no", "copies"), "first")
    total = place.count()
    hot_line = first.where(F.col("copies") > F.greatest(F.lit(64), F.lit(total // HOT))).select("h", F.col("doc_id").alias("first_id"), F.col("line_no").alias("first_no"))

    def signed(rows: DataFrame) -> DataFrame:
        rows = _with_items(rows, "h").select("h", F.size("items").alias("n"), "items")
        return rows.select("h", "n", F.explode(F.slice("items", F.lit(1), _signature_size(F.col("n")))).alias("item"))

    seen = signed(place.where("line is not null").dropDuplicates(["h"])).groupBy("item").count()
    seen = store.save(seen.where("count >= 16"), "sampled")
    hot_item = seen.where(F.col("count") > F.lit(total // SAMPLE // HOT)).orderBy(F.desc("count"), "item").limit(HOT)
    hot_item = hot_item.select("item", (F.row_number().over(Window.orderBy("item")) - 1).cast("long").alias("hot"))

    # contents of which enough items are shared, and those that share as many with one of them as a similar set would
    once = lines.join(F.broadcast(hot_line), "h", "left").where("first_id is null or (doc_id = first_id and line_no = first_no)")
    ordered = store.save(_by_rarity(signed(once.select("h", "line")), hot_item), "shared")
    common = F.element_at("order", -1)["df"] > FEW
    few = store.save(_pairs_of_few(ordered.select("h", "n", common.alias("common"), F.inline("order"))), "few")
    ordered = ordered.where(common)
    prober = F.size("order") >= _least_shared(F.col("n"))
    probed = ordered.where(prober).select(F.explode("order.item").alias("item")).distinct()
    others = ordered.where(~prober).select("h", "n", F.explode("order.item").alias("item")).join(probed, "item", "left_semi")
    others = others.groupBy("h", "n").agg(F.count("*").alias("met")).where(F.col("met") >= _least_shared(F.ceil(3 * F.col("n") / 4)))
    alike = ordered.where(prober).select("h").union(others.select("h"))
    alike = alike.select("h", F.lit(True).alias("led")).union(few.select(F.explode(F.array("h", "other")).alias("h"), F.lit(False))).groupBy("h").agg(F.max("led").alias("led"))

    # their sets, read again, each from its first place (where another text of a repeated doc_id may have another line)
    spots = store.save(first.join(alike, "h"), "spots")
    place_key = ["doc_id", "line_no", "h"]
    near = _in_cells(lines, spots, "doc_id", "line_no").join(spots, place_key).dropDuplicates(place_key)
    sets = store.save(_with_items(near.select("h", F.struct("doc_id", "line_no").alias("at"), "copies", "led", "line"), "h", "at", "copies", "led"), "sets")
    later = _similar(few, sets)

    # those that share items of many lines
    sets = sets.where("led")
    ordered = _by_rarity(sets.select("h", F.size("items").alias("n"), F.explode("items").alias("item")), hot_item)
    probe = store.save(_prefix(ordered).join(sets.select("h", "at", "copies"), "h"), "probes")
    other = probe.select("item", *[F.col(c).alias(f"{c}2") for c in ("h", "n", "i", "at")])
    close = (F.col("at2") < F.col("at")) & (4 * F.least("n", "n2") >= 3 * F.greatest("n", "n2"))
    close = close & (F.col("i") <= _missing(F.col("n"), F.col("n2"))) & (F.col("i2") <= _missing(F.col("n2"), F.col("n")))

    # the earliest and the most repeated content of each item
    who = F.struct(*[F.col(c).alias(f"{c}2") for c in ("h", "n", "i", "at")])
    leaders = probe.groupBy("item").agg(F.min_by(who, "at").alias("early"), F.max_by(who, F.struct("copies", "h")).alias("common"))
    led = probe.join(leaders, "item").select("h", "n", "i", "at", F.posexplode(F.array("early", "common")).alias("kind", "with"))
    met = led.select("h", "n", "i", "at", "kind", "with.*").where(close).groupBy("h", "h2", "kind").agg(F.count("*").alias("met"))
    tried = store.save(met.groupBy("h", "kind").agg(F.max_by("h2", F.struct("met", "h2")).alias("other")).select("h", "other").distinct(), "tried")
    led = store.save(_similar(tried, _of_pairs(sets, tried)), "led")

    # what no leader removes meets all earlier ones that its items allow
    rest = store.save(probe.join(led, "h", "left_anti").join(other, "item").where(close).select("h", F.col("h2").alias("other")).distinct(), "rest")
    later = later.union(led).union(_similar(rest, _of_pairs(sets, rest))).distinct()

    near_copies = first.join(later, "h", "left_semi").select("doc_id", "line_no", "h")
    repeated = first.where("copies > 1").select("h", F.col("doc_id").alias("first_id"), F.col("line_no").alias("first_no"))
    equal = place.select("doc_id", "line_no", "h").join(repeated, "h").where("doc_id <> first_id or line_no <> first_no")
    return near_copies.union(equal.select("doc_id", "line_no", "h"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) for every row of docs; removed_lines: numbers from 0, comma-joined."""
    gone = repeated_lines(docs, id_col, text_col).select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    n = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"))
    gone_here = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.size(gone_here).cast("long").alias("n_removed"), F.array_join(gone_here.cast("array<string>"), ",").alias("removed_lines"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines cut out of their texts; a document left without words, which had some, goes."""
    gone = repeated_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "h")).alias("gone"))
    # the caller's columns stand in one struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(gone, "doc_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", F.struct(i.alias("line_no"), F.xxhash64(F.lower(x)).alias("h"))))
    joined = joined.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    joined = joined.where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
