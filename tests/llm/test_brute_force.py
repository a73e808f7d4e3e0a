"""Whole operators against plain versions: the verdict of the quality rules, the search for benchmark items, pairs in split buckets."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from syncwright.llm import decontaminate, line_dedup, near_dedup, quality_rules

from test_operators import base_counts, corpus, edited, got, labels, lower, prose, removed_lines, smith_waterman, table, words


def hashed(*parts, seed=42):
    """What F.xxhash64 gives for texts (or one whole number): each part's hash is the next one's seed."""
    for p in parts:
        raw = p.to_bytes(8, "little", signed=True) if isinstance(p, int) else p.encode()
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def verdicts(rows, good_ids, max_labels, threshold=-0.22):
    """(doc_id, ratio, kept) from dictionaries of n-grams, document by document."""
    trusted = set(sorted(good_ids, key=lambda i: (hashed(i), i))[:max_labels])
    grams = lambda w: [hashed(x) % quality_rules.CELLS for x in w] + [hashed(x, y) % quality_rules.CELLS for x, y in zip(w, w[1:])]
    cells = [(i, t, grams(words(t))) for i, t in rows]
    raw = Counter(c for _, _, g in cells for c in g)
    good = Counter(c for i, _, g in cells if i in trusted for c in g)
    n_raw, n_good = raw.total() + 0.5 * quality_rules.CELLS, good.total() + 0.5 * quality_rules.CELLS

    def weight(c):
        if not good:
            return 0
        w = math.log((good[c] + 0.5) / n_good) - math.log((raw[c] + 0.5) / n_raw)
        return round(max(-7.9, min(7.9, w)) * quality_rules.STEP)

    out = []
    for i, t, g in cells:
        ratio = sum(map(weight, g)) / max(1, len(g)) / quality_rules.STEP
        out.append((i, round(ratio, 9), not base_counts(t)[-1] and ratio >= threshold))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_labels", [20_000, 40])
def test_quality_verdicts_equal_brute_force(spark, max_labels):
    draw = random.Random(31)
    odd = lambda n: " ".join(f"zq{draw.randint(0, 30)}" for _ in range(n))
    rows = corpus() + [(1000 + k, prose(draw, 40) if k % 3 else odd(40)) for k in range(90)]
    rows += [(1500, prose(draw, 30) + " " + odd(30)), (1500, odd(25)), (1501, "x"), (1502, "é ü\tß " * 15)]
    marks = labels(spark, [r for r in rows if (r[0] or 0) >= 1000], lambda i: int(i % 3 > 0))
    good = {r["doc_id"] for r in marks.where("quality = 1").collect() if r["doc_id"] is not None}
    found = quality_rules.judged(table(spark, rows), marks, max_labels=max_labels).collect()
    got = sorted(((r["doc_id"], round(r["ratio"], 9), r["kept"]) for r in found), key=repr)
    want = verdicts(rows, good, max_labels)
    assert got == want and {k for _, _, k in want} == {True, False}


def changed(draw, text, rate, kind):
    out = []
    for w in text.split(" "):
        hit = draw.random() < rate
        if hit and kind == "replace":
            w = f"new{draw.randint(0, 999)}"
        if not (hit and kind == "drop"):
            out.append(w)
        if hit and kind == "insert":
            out.append(f"new{draw.randint(0, 999)}")
    return " ".join(out)


def test_decontamination_equals_alignment_of_all_pairs(spark):
    draw = random.Random(32)
    items = [(k, prose(draw, draw.randint(8, 40))) for k in range(12)] + [(12, prose(draw, 8)), (13, prose(draw, 8))]
    items[13] = (13, items[12][1])  # the same item twice: a tie
    rows, kinds = [], [(kind, rate) for kind in ("replace", "drop", "insert") for rate in (0.0, 0.1, 0.2, 0.3)]
    for k, t in items:
        for j, (kind, rate) in enumerate(kinds):
            rows.append((100 * (k + 1) + j, prose(draw, draw.randint(0, 50)) + " " + changed(draw, t, rate, kind) + " " + prose(draw, draw.randint(0, 50))))
    rows += [(5000 + k, prose(draw, 120)) for k in range(20)]
    rows += [(6000, items[0][1] + " " + prose(draw, 500) + " " + changed(draw, items[1][1], 0.1, "replace")), (6001, items[2][1].upper()), (6001, items[3][1])]
    want = {}
    for i, t in rows:
        for k, item in items:
            x, y = lower(item).split(), lower(t).split()
            score = smith_waterman(x, y) / (decontaminate.MATCH * len(x))
            if score >= 0.5:
                want[i, k] = max(want.get((i, k), 0), round(score, 9))
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(want.get(k) == s for k, s in found.items())  # nothing more, and each with its best score
    assert found == want  # true of these edits, though the operator promises less:
    for kind in ("replace", "drop", "insert"):  # nine of ten, for each kind of edit
        mine = [p for p in want if p[0] < 5000 and kinds[p[0] % 100][0] == kind]
        assert len(mine) >= 40 and len([p for p in mine if p in found]) >= 0.9 * len(mine), kind


def test_pairs_of_a_split_bucket_share_another_band():
    """A bucket over hot_bucket is split by a second band: how many pairs of 0.75 that loses, against all of them."""
    rng, pairs, shared, alone = np.random.default_rng(33), 4000, 0, 0
    for _ in range(pairs):
        both, left, right = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 50, 50))
        a, b = (near_dedup.band_keys(near_dedup.sketch(np.concatenate([both, own]))) for own in (left, right))
        same = int((a == b).sum())
        shared, alone = shared + (same > 0), alone + (same == 1)
    assert shared >= pairs - 4 and alone <= 8  # 5e-6 and 8e-5 are expected of each pair


@pytest.mark.parametrize("few", [2, 6])
def test_lines_that_meet_in_pairs_or_by_rarity_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    draw = random.Random(41)
    bases = [prose(draw, draw.choice((8, 40, 70))) for _ in range(12)]
    rows = [(k, "\n".join(edited(draw, bases[min(int(draw.expovariate(0.4)), 11)], 0.02) + " " + prose(draw, draw.choice((0, 3, 9))) for _ in range(3))) for k in range(50)]
    gone = removed_lines(rows)
    assert sum(map(len, gone.values())) > 40
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == sorted(((i, ",".join(map(str, sorted(gone[i])))) for i, _ in rows), key=repr)


def test_lines_that_meet_in_pairs_are_not_ordered_by_rarity(spark, monkeypatch):
    counted, by_rarity = [], line_dedup._by_rarity

    def spied(rows, hot_item):
        counted.append(rows.count())
        return by_rarity(rows, hot_item)

    monkeypatch.setattr(line_dedup, "_by_rarity", spied)
    draw = random.Random(42)
    rows = [(k, prose(draw, 60)) for k in range(20)]
    rows += [(100 + k, t + " and more") for k, t in rows]
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == sorted([(k, "") for k in range(20)] + [(100 + k, "0") for k in range(20)], key=repr)
    assert counted[0] > 0 and counted[1:] == [0]
