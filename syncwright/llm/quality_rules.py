"""Quality rules: counts over words, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Counts are taken on the whole text.  The verdict compares two multinomials over
CELLS hashed words and word pairs: one of trusted documents (a bounded sample of
rows labelled 1, those of the smallest hashes), one of all documents.  A
document's ratio is the mean over its n-grams of log(trusted) - log(raw), summed
in whole steps of 1 / STEP so that no order of adding matters; a document under
`threshold` goes.

Defined cases: a null or wordless text has no words and fails the base rules;
rows that repeat a doc_id are decided each by its text; without labels every
ratio is 0 and only the base rules decide; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CELLS = 1 << 16  # a fixed size: the weights travel in the plan
STEP, ZERO = 1 << 10, 1 << 13  # weights of -8 to 8, as two bytes under 128 each


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_counts(rows: DataFrame) -> DataFrame:
    """Adds the base columns to (doc_id, text, words)."""
    size = F.size("words")
    rows = rows.withColumn("windows", F.transform(_range(size - 7), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(8)])))
    several = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(several, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("found", F.transform(F.filter("ordered", lambda x, k: F.coalesce(x["h"] == F.get("ordered", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("ordered", k + 1)["h"], F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("found", F.sort_array("found"))
    covered = F.aggregate(F.transform("found", lambda i, k: F.least(F.lit(8), F.coalesce(F.get("found", k + 1) - i, F.lit(8)))), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.length(F.regexp_replace("text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return rows.drop("windows", "ordered", "found").withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _cell(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(CELLS)).cast("int")


def ratio_weights(rows: DataFrame, labels: DataFrame, max_labels: int) -> bytes:
    """Two bytes for each cell: its log ratio in steps, from the n-grams of all rows (doc_id, words)."""
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).withColumn("trusted", F.lit(1))
    word = rows.join(F.broadcast(trusted), "doc_id", "left").select("trusted", F.posexplode("words").alias("i", "word"), "words")
    gram = word.select("trusted", F.explode(F.array(_cell(F.col("word")), F.when(F.col("i") + 1 < F.size("words"), _cell(F.col("word"), F.get("words", F.col("i") + 1))))).alias("cell"))
    counted = gram.where("cell is not null").groupBy("cell").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    raw, good = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for cell, r, g in counted.toLocalIterator():  # CELLS rows at most
        raw[cell], good[cell] = r, g
    if good.sum() == 0:
        steps = np.zeros(CELLS, np.int64)
    else:
        weight = np.log((good + 0.5) / (good.sum() + 0.5 * CELLS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * CELLS))
        steps = np.rint(np.clip(weight, -7.9, 7.9) * STEP).astype(np.int64)
    steps += ZERO
    return np.stack([steps >> 7, steps & 127], axis=1).astype(np.uint8).tobytes()


def _weight(table: bytes, cell: Column) -> Column:
    byte = lambda at: F.ascii(F.substring(F.lit(bytearray(table)), at, F.lit(1)).cast("string"))
    return (byte(2 * cell + 1) * 128 + byte(2 * cell + 2)).cast("long")


def with_ratio(rows: DataFrame, table: bytes) -> DataFrame:
    """Adds `ratio`, the mean weight of a document's n-grams, to rows with `words`."""
    size = F.size("words")
    cells = F.concat(F.transform("words", lambda w: _cell(w)), F.transform(_range(size - 1), lambda i: _cell(F.get("words", i), F.get("words", i + 1))))
    rows = rows.withColumn("cells", cells)
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + _weight(table, c))
    n = F.greatest(F.lit(1), F.size("cells"))
    return rows.withColumn("ratio", (total - F.size("cells") * F.lit(ZERO)) / n / F.lit(STEP)).drop("cells")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.22, max_labels: int = 20_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed, kept) for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("words", _words(F.col("text")))
    table = ratio_weights(rows.select("doc_id", "words"), labels, max_labels)
    rows = with_ratio(with_counts(rows), table)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    # a generator between the counts and the caller: a filter on the verdict is not pushed into the counts, which it would repeat
    return rows.select(F.inline(F.array(F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept"))))
