"""The corpus operators against brute force, on small tables that hold every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syncwright.llm import decontaminate, html_crf, licenses, line_dedup, near_dedup, packing, pii_crf, quality_classifier, quality_rules, toxicity
from syncwright.llm import queries as llm_queries

from pages_by_hand import PAGES

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, h long, g string"


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(draw, n):
    return " ".join("".join(draw.choices("ka lo mi ter an den sol vi ra ne".split(), k=draw.randint(1, 3))) for _ in range(n))


def edited(draw, text, every):
    return " ".join(w if draw.random() > every else "changed" + str(draw.randint(0, 99)) for w in text.split(" "))


def corpus(seed=1):
    """(doc_id, text): null, empty, blank, short, repeated, near and long texts; ids that repeat or are null."""
    draw = random.Random(seed)
    base = [prose(draw, draw.randint(20, 80)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d e"), (8, None), (None, base[0]), (None, None)]
    rows += [(10 + k, t) for k, t in enumerate(base)]
    rows += [(30 + k, edited(draw, t, 0.02)) for k, t in enumerate(base)]
    rows += [(50 + k, t.upper()) for k, t in enumerate(base[:4])]
    rows += [(10, base[0]), (11, base[5])]  # an id again: with the same text and with another
    rows += [(70 + k, base[k] + "\n" + base[k + 1] + "\n" + base[k]) for k in range(6)]
    rows += [(90, prose(draw, 6000)), (91, "x" * 50_000), (92, "\n".join(base) + "\né中\U0001f600 words " + prose(draw, 30))]
    draw.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 7, "clash") for i, t in rows], DOCS)


def labels(spark, rows, quality, toxic=lambda i: 0):
    ids = sorted({i for i, _ in rows if i is not None})
    return spark.createDataFrame([(i, quality(i), toxic(i), "clash") for i in ids] + [(None, 1, 1, "clash")], "doc_id long, quality int, toxic int, text string")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({("short", *w)} if w else set())


# ---- 2 ----------------------------------------------------------------------


def components(rows):
    """Smallest reachable id of each id, over links between all its texts."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    root = components(rows)
    want = sorted(((i, len(shingles(t)), root.get(i), i is None or root[i] == i) for i, t in rows), key=repr)
    assert got(near_dedup.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_with_small_blocks(spark):
    draw = random.Random(4)
    first = prose(draw, 120)
    rows = [(k, edited(draw, first, 0.01)) for k in range(150)] + [(1000 + k, first) for k in range(40)]
    root = components(rows)
    found = near_dedup.near_duplicates(table(spark, rows), block=16, hot_bucket=32)
    assert got(found, "doc_id", "component_id") == sorted(((i, root[i]) for i, _ in rows), key=repr)


def test_near_duplicates_of_hot_buckets_are_those_of_small_ones(spark):
    """Pairs of 0.5 share one band only, more often than not: what a bucket counts as must not matter."""
    draw, rows = random.Random(41), []
    for k in range(40):
        both = prose(draw, 80)
        rows += [(2 * k, both + " " + prose(draw, 30)), (2 * k + 1, both + " " + prose(draw, 30))]
    found = lambda **sizes: got(near_dedup.near_duplicates(table(spark, rows), percent=50, sketch_percent=35, **sizes), "doc_id", "component_id")
    want = found()
    assert sum(i != root for i, root in want) >= 20
    assert found(hot_bucket=1, block=2) == want


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:750], draw.integers(0, 1 << 63, 150, dtype=np.uint64)])
    agree = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(agree - 750 / 1050) < 0.15
    assert (near_dedup.sketch(a[:1]) != ~np.uint64(0)).all()


def test_one_of_each_group(spark):
    rows = corpus()
    root = components(rows)
    kept = near_dedup.one_of_each_group(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in root.items() if i == r} | {None}


# ---- 10 ---------------------------------------------------------------------


def removed_lines(rows):
    by_place = defaultdict(list)
    for i, t in rows:
        if i is None or t is None:
            continue
        for k, line in enumerate(t.split("\n")):
            if s := frozenset(shingles(line)):
                by_place[i, k].append(s)
    places = sorted((p, s) for p, sets in by_place.items() for s in sets)
    gone = defaultdict(set)
    for n, (p, s) in enumerate(places):
        if any(q < p and 4 * len(s & z) >= 3 * len(s | z) for q, z in places[:n]):
            gone[p[0]].add(p[1])
    return gone


def test_line_report_equals_brute_force(spark):
    rows = [(i, t) for i, t in corpus() if i not in (10, 11)]  # one text for each id
    gone = removed_lines(rows)
    want = sorted(((i, len(t.split("\n")) if t is not None else 0, len(gone[i]), ",".join(map(str, sorted(gone[i])))) for i, t in rows), key=repr)
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "n_lines", "n_removed", "removed_lines") == want


def test_line_report_many_near_lines(spark):
    draw = random.Random(9)
    bases = [prose(draw, 30) for _ in range(5)]
    rows = [(k, "\n".join(edited(draw, draw.choice(bases), 0.03) for _ in range(4))) for k in range(60)]
    gone = removed_lines(rows)
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == sorted(((i, ",".join(map(str, sorted(gone[i])))) for i, _ in rows), key=repr)


def test_clean_documents(spark):
    draw = random.Random(3)
    a, b, c = (prose(draw, 20) for _ in range(3))
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\nshort\n{c}"), (3, a), (4, None), (None, a), (5, "short")]
    clash = table(spark, rows).withColumns({"gone": F.lit(1), "row": F.lit(2), "_text": F.lit(3), "first_id": F.lit(4), "item": F.lit(5)})
    found = line_dedup.clean_documents(clash)
    assert found.columns == clash.columns
    assert all((r["gone"], r["row"], r["_text"], r["h"]) == (1, 2, 3, 7) for r in found.collect())
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: f"{a}\n{b}", 2: f"short\n{c}", 4: None, None: a}


def test_line_report_short_lines(spark):
    rows = [(k, f"Share this page\n{prose(random.Random(k), 12)}\nSubscribe  now\n\n}}\n" + ("Subscribe now" if k == 30 else "x\tY")) for k in range(50)]
    gone = removed_lines(rows)
    assert sum(map(len, gone.values())) > 150
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == sorted(((i, ",".join(map(str, sorted(gone[i])))) for i, _ in rows), key=repr)


def test_line_report_of_one_hot_line_and_item(spark, monkeypatch):
    # a line and a passage in most rows, with bounds so low that both are dealt out
    monkeypatch.setattr(line_dedup, "HOT", 8)
    monkeypatch.setattr(line_dedup, "SAMPLE", 2)
    draw = random.Random(21)
    line, passage = prose(draw, 30), prose(draw, 24)
    rows = [(k, f"{line}\n{prose(draw, 60)} {edited(draw, passage, 0.05)}\n{edited(draw, line, 0.04)}\n{prose(draw, 3)} {passage}") for k in range(150)]
    gone = removed_lines(rows)
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == sorted(((i, ",".join(map(str, sorted(gone[i])))) for i, _ in rows), key=repr)


def test_line_report_of_a_very_long_line(spark):
    draw = random.Random(22)
    long = prose(draw, 60_000)
    rows = [(1, long), (2, edited(draw, long, 0.01)), (3, prose(draw, 60_000)), (4, "y" * 300_000 + " z"), (5, "y" * 300_000 + " z")]
    assert got(line_dedup.line_report(table(spark, rows)), "doc_id", "removed_lines") == [(1, ""), (2, "0"), (3, ""), (4, ""), (5, "0")]


def test_pipeline_removes_short_lines(spark):
    draw = random.Random(15)
    a, b = prose(draw, 20), "All rights reserved."
    rows = [(1, f"{a}\n{b}\n\n}}"), (2, f"{prose(draw, 5)}\n all  RIGHTS\treserved. \n"), (3, b), (4, f"}}\nrights reserved.\n{b} Now"), (5, b + "\n " + b), (None, b), (6, None), (7, " ")]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, table(spark, rows), "").collect()}
    assert out == {1: rows[0][1], 2: rows[1][1].split("\n")[0] + "\n", 4: f"rights reserved.\n{b} Now", None: b, 6: None, 7: " "}


def test_lines_of_repeated_ids_are_compared_as_their_own(spark):
    draw = random.Random(16)
    keep, gone = [], []
    for k in range(12):
        first, tail = prose(draw, 40).split(), prose(draw, 16).split()
        keep += [(k, " ".join(first)), (100 + k, " ".join(first[:24] + tail))]
        gone.append((100 + k, " ".join(first[:39] + ["changed"])))
        # what the two do not share is common, so that they meet in what they share
        keep += [(200 + 10 * k + j, " ".join([prose(draw, 80), *first[20:], prose(draw, 80), *first[20:24], *tail])) for j in range(6)]
    kept = line_dedup.clean_documents(table(spark, keep + gone)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(keep)


# ---- 3 ----------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_equal_brute_force(spark):
    draw = random.Random(5)
    rows = corpus() + [(200, "# a | b\n" * 30), (201, " ".join(prose(draw, 9) for _ in range(1)) * 5), (202, "\t lead " + prose(draw, 25) + " tail\n\n")]
    found = quality_rules.judged(table(spark, rows), labels(spark, rows, lambda i: i % 2))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(found, *names) == sorted(((i, *base_counts(t)) for i, t in rows), key=repr)
    assert found.where("base_failed and kept").count() == 0


def test_quality_rules_without_labels(spark):
    rows = corpus()
    found = quality_rules.judged(table(spark, rows), labels(spark, [], lambda i: 1).where("doc_id is not null"))
    assert found.where("kept = base_failed").count() == 0


def test_quality_ratio_tells_kinds_apart(spark):
    draw = random.Random(6)
    rows = [(k, prose(draw, 60) if k % 4 else " ".join(f"zq{draw.randint(0, 30)}" for _ in range(60))) for k in range(200)]
    found = quality_rules.judged(table(spark, rows), labels(spark, rows, lambda i: int(i % 4 > 0))).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 4) for r in found)


# ---- 4 ----------------------------------------------------------------------


def test_decontamination_finds_copies_and_edits(spark):
    draw = random.Random(7)
    items = [(k, prose(draw, 30)) for k in range(6)] + [(50, "two words"), (51, ""), (52, None), (None, "x y z a")]
    clean = [(100 + k, prose(draw, 150)) for k in range(20)]
    held = [(200 + k, prose(draw, 60) + " " + t + " " + prose(draw, 60)) for k, (_, t) in enumerate(items[:6])]
    near = [(300 + k, prose(draw, 60) + " " + edited(draw, t, 0.1) + " " + prose(draw, 60)) for k, (_, t) in enumerate(items[:6])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = clean + held + near + [(1, None), (2, ""), (None, items[0][1])]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()}
    assert set(found) == {(200 + k, k) for k in range(6)} | {(300 + k, k) for k in range(6)}
    assert all(found[200 + k, k] == 1.0 for k in range(6))
    kept = decontaminate.clean_of(table(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean} | {1, 2, None}


def test_decontamination_finds_long_items(spark):
    draw = random.Random(17)
    word = [prose(draw, 1) + str(k) for k in range(4000)]
    long = lambda n: " ".join(draw.choices(word, k=n))
    items = [(1, long(1500)), (2, long(600)), (3, prose(draw, 30))]
    item = items[0][1].split()
    # copies: as it is, with every tenth word changed, with 300 words put in, and with one n-gram left as it is
    sparse = [w if k % 4 or 700 <= k < 708 else "changed" for k, w in enumerate(item)]
    texts = [items[0][1], " ".join("changed" if k % 10 == 0 else w for k, w in enumerate(item)), " ".join([*item[:700], long(300), *item[700:]]), " ".join(sparse), items[1][1]]
    rows = [(k, f"{long(400)} {t} {long(400)}") for k, t in enumerate(texts)] + [(20, long(3000)), (21, " ".join(item[:600])), (22, " ".join([items[1][1]] * 4))]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(k, 1) for k in range(4)} | {(4, 2), (22, 2)}
    assert found[0, 1] == found[4, 2] == found[22, 2] == 1.0
    assert found[1, 1] >= (2 * 1350 - 150) / 3000 - 0.01 and found[2, 1] >= 0.9 and found[3, 1] >= 0.62


def smith_waterman(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, now[j] - 1))
        best, last = max(best, *now), now
    return best


def test_alignment_equals_smith_waterman():
    draw = np.random.default_rng(3)
    a = [draw.integers(0, 6, draw.integers(1, 30)) for _ in range(40)]
    b = [draw.integers(0, 6, draw.integers(1, 50)) for _ in range(40)]
    assert decontaminate.align(a, b).tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b)]


# ---- 9 ----------------------------------------------------------------------


def reference_pieces(rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % capacity or capacity) if k == 0 else capacity
            out.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, k = at + n, k + 1
    return sorted(out, key=repr)


def test_ids_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k")
    draw = random.Random(23)
    odd = [chr(c) for c in (*range(0x20, 0x3000, 7), 0x85, 0xA0, 0x200B, 0x1680, 0x2028, 0xFEFF, 0x1F600, 0x10FFFF)] + [" ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|", "|>", "a", "1"]
    for _ in range(3000):
        text = "".join(draw.choices(odd, k=draw.randint(1, 12)))
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("items_per_task", "pieces_per_task"), [(200_000, 1_000_000), (10, 1_000_000), (200_000, 40)])
def test_packing(spark, items_per_task, pieces_per_task):
    rows = corpus() + [(400, "<|endoftext|> plain"), (401, prose(random.Random(8), 9000)), (402, "hello <|endoftext|> world"), (403, "in<|endoftext|>word<|endoftext|><|endoftext|>"), (404, "<|endoftext| <|endoftext|>>")]
    rows += [(405, " " * 400_000 + "a\n" + "\n" * 300_000), (406, "x" * 200_000)]
    found = packing.packed(table(spark, rows), items_per_task=items_per_task, pieces_per_task=pieces_per_task)
    assert got(found, "doc_id", "piece", "start", "length", "ids_crc32") == reference_pieces(rows)
    bins = defaultdict(list)
    for r in found.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(bins) <= -(-total // 2048) + 1


# ---- 5 ----------------------------------------------------------------------


def brute_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


AWKWARD = [
    "a@b.co, x.y+z@sub.example.org. a@@b.c a@b c@d.e@f.g .@-.- 1@2.3.4.5",
    "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3. 300.1.2.3.4.5 12345678901.1.1.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111 12 4111  1111 1111 1111",
    "+49 (30) 1234-5678 +1 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +44.20.7946.0958.",
    "é\U0001f600 mail: josé@exa-mple.com ١٢ +49 30 call",
    "token=abcdefgh12345678abcd password: Zz09Zz09Zz09Zz09Zz09",
]


def test_base_spans_equal_patterns():
    draw = random.Random(10)
    texts = AWKWARD + ["".join(draw.choices("01259.@+- ()ab%", k=60)) for _ in range(3000)]
    for t in texts:
        assert sorted(pii_crf.base_spans(t)) == sorted(brute_spans(t)), t


def test_personal_data(spark):
    rows = corpus() + [(500 + k, t) for k, t in enumerate(AWKWARD)]
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    order = ("email", "ip", "card", "phone")
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1])))
    want = sorted(((i, *(sum(s[0] == k for s in brute_spans(t)) for k in order), hashlib.sha256(show(brute_spans(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    found = pii_crf.personal_data(table(spark, rows))
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    for r in found.collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute_spans(text[r["doc_id"]][0])} if len(text[r["doc_id"]]) == 1 else set()
        assert base <= set(r["spans"].split(","))


def secrets_corpus(n, seed):
    draw = random.Random(seed)
    hexes = lambda k: "".join(draw.choices("0123456789abcdef", k=k))
    out = []
    for _ in range(n):
        parts = [prose(draw, draw.randint(5, 30)) for _ in range(4)] + ["".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(16, 24))) for _ in range(2)] + [str(draw.randint(1, 10**8))]
        parts += draw.choices(([f'token = "{hexes(40)}"'], [f"me{draw.randint(1, 99)}@site.example.org"], [f"{draw.randint(1, 255)}.7.0.{draw.randint(1, 255)}"], []), k=2)[0]
        draw.shuffle(parts)
        out.append(" ".join(parts))
    return out


def test_repeats_carry_a_label_that_no_other_evidence_gives():
    draw = random.Random(41)
    field = pii_crf.fitted([pii_crf.sampled_graph(t, 64) for t in secrets_corpus(400, 40)])
    without = pii_crf.Field()
    without.node, without.edge = field.node, field.edge.copy()
    without.edge[1:] = 0
    secret = "correcthorsebatterystaple"
    text = f"{prose(draw, 40)} password: {secret} {prose(draw, 200)} " + " ".join(f"{prose(draw, 9)} {secret}." for _ in range(50))
    places = [("secret", m.start(), m.end()) for m in re.finditer(secret, text)]
    assert len(places) == 51
    assert set(places) <= set(pii_crf.found_spans([text], field, 0.9)[0][1])
    assert len(set(places) & set(pii_crf.found_spans([text], without, 0.9)[0][1])) <= 1
    # a long word of no such kind stays, however often it repeats
    plain = f"{prose(draw, 40)} " + " ".join(f"{prose(draw, 9)} {secret}" for _ in range(50))
    assert pii_crf.found_spans([plain], field, 0.9)[0][1] == []


def test_personal_data_of_very_long_texts_and_repeated_ids(spark):
    draw = random.Random(42)
    text = prose(draw, 40_000) + " me@exa.mple.org " + "1" * 60_000 + " " + "key=" * 20_000 + " " + prose(draw, 1000) + " 10.0.0.1"
    found = pii_crf.personal_data(table(spark, [(1, text), (1, text), (1, "a@b.co"), (2, "x"), (3, None)])).collect()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"]) for r in found) == [(1, 1, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_messages_equal_exact_marginals_on_a_tree():
    draw = np.random.default_rng(5)
    field = pii_crf.Field()
    field.node, field.edge = draw.normal(size=field.node.shape), draw.normal(size=field.edge.shape)
    rows, edges = np.array([[1, 2], [3, 4], [5, 6]]), np.array([[0, 1, 0], [1, 2, 1]])
    n = len(pii_crf.LABELS)
    score = field.node[rows].sum(axis=1)
    joint = score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :] + field.edge[0][:, :, None] + field.edge[1][None, :, :]
    p = np.exp(joint - joint.max())
    p /= p.sum()
    want = np.stack([p.sum(axis=(1, 2)), p.sum(axis=(0, 2)), p.sum(axis=(0, 1))])
    assert want.shape == (3, n)
    np.testing.assert_allclose(field.beliefs(rows, edges, rounds=200, settled=1e-9), want, atol=1e-6)


# ---- 1 ----------------------------------------------------------------------


def test_html_on_pages_of_unseen_layout_draws(spark):
    pages = html_crf.labelled_pages(60, seed=99)
    rows = [(k, f"u{k}", p, "clash") for k, (p, _) in enumerate(pages)] + [(900, None, None, "x"), (901, "", "", "x"), (None, "u", "<p>Hi", "x")]
    found = {r["page_id"]: r for r in html_crf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    exact = sum(found[k]["text"] == "\n".join(t) for k, (_, t) in enumerate(pages))
    assert exact >= 0.9 * len(pages)
    assert found[900]["text"] == found[901]["text"] == "" and found[900]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_blocks_after_empty_and_similarly_named_elements():
    text = lambda page: [t for t, _, _ in html_crf.blocks(page)]
    assert text('<header><svg class="i"/></header><article><p>Body.</p></article>') == ["Body."]
    assert text("<p>one<svg/>two</p><SVG viewBox='0 > 1' /><p>three</p>") == ["one two", "three"]
    for name in ("template-card", "style-guide", "iframe-box", "script-x", "svg-icon"):
        assert text(f"<{name} a=b><p>In.</p></{name}><p>Out.</p>") == ["In.", "Out."], name
    for name in ("script", "style", "template", "iframe", "svg"):
        assert text(f"<p>a</p><{name}>x</{name}><{name} a='/'\n>y</{name} ><p>b</p>") == ["a", "b"], name
    assert text("<p>a</p><script src=x />hidden</script><p>b</p>") == ["a", "b"]


def test_html_on_pages_written_by_hand():
    model, right, found, wanted = html_crf.trained(), 0, 0, 0
    for page, texts in PAGES:
        got_texts = Counter(html_crf.main_text(page, model).split("\n"))
        want_texts = Counter(texts)
        right, found, wanted = right + sum((got_texts & want_texts).values()), found + sum(got_texts.values()), wanted + sum(want_texts.values())
    assert right >= 0.85 * found and right >= 0.85 * wanted, (right, found, wanted)


def test_deep_nesting_takes_linear_time():
    import time

    model = html_crf.trained()
    began = time.perf_counter()
    for page in ("<div>x" * 100_000, "<i><div>" + "<b>x" * 50_000 + "</i>" * 50_000, "".join(f"<div class=c{k}>" for k in range(100_000)) + "x", "<p>a" * 100_000):
        html_crf.main_text(page, model)
    assert time.perf_counter() - began < 60  # the square of these sizes would take hours


def test_viterbi_is_the_best_labelling():
    model = html_crf.trained()
    page = "<body><nav><a href=x>home</a></nav><article><h1>A title</h1><p>Some long text, with words. And more.</p></article><footer>(c) us</footer></body>"
    found = html_crf.blocks(page)
    rows = html_crf.features(found)

    def score(ys):
        return sum(y * sum(model[0].get(f, 0.0) for f in row) for y, row in zip(ys, rows)) + sum(model[1][a, b] for a, b in zip(ys, ys[1:]))

    best = max((tuple(int(c) for c in format(k, f"0{len(rows)}b")) for k in range(1 << len(rows))), key=score)
    assert tuple(html_crf.decode(found, model)) == best


# ---- 6, 7, 8 ----------------------------------------------------------------


def test_toxicity_chain(spark):
    draw = random.Random(11)
    rude = ["idiot", "worthless", "scum"]
    rows = [(k, prose(draw, 50) + (f" {draw.choice(rude)} you {draw.choice(rude)}" if k % 5 == 0 else "")) for k in range(300)] + [(None, "idiot"), (900, None), (901, "")]
    found = toxicity.toxicity(table(spark, rows), labels(spark, rows[:200], lambda i: 1, lambda i: int(i % 5 == 0))).collect()
    assert len(found) == len(rows)
    seen = {r["doc_id"]: r["toxic"] for r in found}
    assert sum(seen[k] == (k % 5 == 0) for k in range(200, 300)) >= 97
    assert not seen[900] and not seen[901]


def test_toxicity_chain_tells_kinds_that_one_linear_model_does_not():
    # toxic: a1 with a2, or b1 with b2; clean: every mixed pair
    draw = np.random.default_rng(4)
    pairs = {(0, 1): 1, (2, 3): 1, (0, 2): 0, (0, 3): 0, (1, 2): 0, (1, 3): 0}

    def sample(n):
        x, y = draw.poisson(0.2, (n, 12)).astype(float), np.zeros(n)
        x[:, :4] = 0
        for k in range(n):
            at, y[k] = list(pairs.items())[draw.integers(len(pairs))]
            x[k, list(at)] = 1
        x[:, -1] = 3
        return x, y

    (x, y), (held_x, held_y) = sample(1500), sample(1000)
    targets = toxicity.chain_targets(x, y, 2)
    assert (targets[:, :2].sum(axis=1) == y).all()
    loss = lambda p: -np.mean(np.log(np.where(held_y > 0, p, 1 - p).clip(1e-9)))
    chain = toxicity.chain_scores(held_x, toxicity.fit_chain(x, targets))[:, -1]
    alone = toxicity.predict(held_x, toxicity.fit_linear(x, y))
    assert loss(chain) < 0.5 * loss(alone)


def test_chain_equals_its_models_one_after_the_other():
    draw = np.random.default_rng(8)
    x, y = draw.random((300, 6)), (draw.random(300) < 0.3) * 1.0
    models = toxicity.fit_chain(x, toxicity.chain_targets(x, y, 3))
    row, want = x[7], []
    for w in models:
        z = sum(a * b for a, b in zip([*row, *want], w[:-1])) + w[-1]
        want.append(1 / (1 + np.exp(-z)))
    np.testing.assert_allclose(toxicity.chain_scores(x[7:8], models)[0], want, rtol=1e-9)


def test_toxicity_of_repeated_ids_is_bounded_in_rows(spark):
    rows = [(1, f"scum {k}") for k in range(60)] + [(1, "scum 1")] * 40 + [(k, f"fine words {k}") for k in range(2, 40)]
    found = toxicity.toxicity(table(spark, rows), labels(spark, rows, lambda i: 1, lambda i: int(i == 1)), max_labels=30)
    assert found.count() == len(rows) and found.where("p_toxic is null").count() == 0


def test_toxicity_without_labels(spark):
    rows = corpus()
    found = toxicity.toxicity(table(spark, rows), labels(spark, [], lambda i: 1).where("doc_id is not null"))
    assert found.count() == len(rows) and found.where("toxic").count() == 0


def test_licences(spark):
    draw = random.Random(12)
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"),
        (2, prose(draw, 60), "a/b/c.txt"),
        (3, "Licensed under the Apache License, Version 2.0\n" + prose(draw, 60), "a/b/d.txt"),
        (4, prose(draw, 60), "z/e.txt"),
        (5, None, None),
        (None, "Released under the MIT License.", "q/x"),
        (6, "", "a/empty"),
        (7, "Licensed under the Apache License, Version 2.0", "a/b/n/LICENSE"),
        (8, "text " * 30, "a/b/n/m/f"),
    ]
    docs = spark.createDataFrame([(i, t, p, "clash", 3) for i, t, p in rows], "doc_id long, text string, path string, licence string, n_words int")
    found = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.licences(docs, F.col("path")).collect()}
    assert found == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, None), 5: (None, None), None: (None, None), 6: ("MIT", "inherited"), 7: ("Apache-2.0", "file"), 8: ("Apache-2.0", "inherited")}


def licence_rows():
    """(doc_id, text) of whole licence files, headers, notices and texts that only look alike."""
    draw = random.Random(31)
    t = {(licence, kind): text for licence, kind, text in licenses.TEMPLATES}
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    mit = f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrap(t['MIT', 'file'], '')}\n"
    bsd = f"BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n{wrap(t['BSD-3-Clause', 'file'], '')}\n"
    apache = "\n                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n" + "\n\n".join(prose(draw, 80) for _ in range(5))
    header = f"#!/bin/sh\n#\n{wrap(t['GPL-3.0', 'header'], '# ')}\n#\n" + prose(draw, 300)
    two = "Released under the MIT License.\nReleased under the ISC License.\n" + prose(draw, 40)
    return [(1, mit), (2, bsd), (3, apache), (4, header), (5, two), (6, "the licence of the house and the software"), (7, None), (8, ""), (9, "of the\n\n\n--\n\n"), (10, prose(draw, 50) + " licensed"), (11, "#\n" * 3000 + "Released under the MIT License."), (12, prose(draw, 30_000) + "\n\n" + mit), (13, mit), (14, mit.upper())]


def test_whole_licences_headers_and_ties(spark):
    found = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.licences(table(spark, licence_rows()), F.concat(F.lit("d"), F.col("doc_id"), F.lit("/x"))).collect()}
    assert found == {1: ("MIT", "file"), 2: ("BSD-3-Clause", "file"), 3: ("Apache-2.0", "file"), 4: ("GPL-3.0", "own"), 5: ("ISC", "own"), 6: (None, None), 7: (None, None), 8: (None, None), 9: (None, None), 10: (None, None), 11: ("MIT", "file"), 12: ("MIT", "own"), 13: ("MIT", "file"), 14: ("MIT", "file")}


def test_licences_equal_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in corpus() if i not in (None, 10, 11)] + [(1000 + i, t) for i, t in licence_rows()]
    docs = table(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s/a").otherwise("s"))
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(f"select doc_id, path, licence, cosine, origin from ({llm_queries.OP7_SQL})").fetchall(), key=repr)
    assert got(llm_queries.op7_license_scan(spark, str(tmp_path)), "doc_id", "path", "licence", "cosine", "origin") == want


def test_quality_classifier_held_out_accuracy(spark):
    draw = random.Random(13)
    rows = [(k, prose(draw, 60) if k % 2 else " ".join("".join(draw.choices("zqxjwv", k=4)) for _ in range(60))) for k in range(400)] + [(None, "x"), (900, None), (901, "")]
    found = quality_classifier.quality_scores(table(spark, rows), labels(spark, rows[:400], lambda i: i % 2)).collect()
    assert len(found) == len(rows)
    held = {r["doc_id"]: r for r in found if r["held_out"]}
    assert set(held) == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == i % 2 for i, r in held.items() if i < 400) >= 0.97 * len([i for i in held if i < 400])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


# ---- empty tables, the pipeline ---------------------------------------------


def test_empty_tables(spark):
    docs, marks = table(spark, []), labels(spark, [], lambda i: 1).limit(0)
    none = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        html_crf.extracted(pages), near_dedup.near_duplicates(docs), quality_rules.judged(docs, marks), decontaminate.contaminated(docs, none), pii_crf.personal_data(docs), toxicity.toxicity(docs, marks),
        licenses.licences(docs, F.col("source")), quality_classifier.quality_scores(docs, marks), packing.packed(docs), line_dedup.line_report(docs), line_dedup.clean_documents(docs), near_dedup.one_of_each_group(docs),
    ):
        assert df.count() == 0
    assert decontaminate.contaminated(table(spark, corpus()), none).count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    rows = corpus()
    draw = random.Random(14)
    rows += [(1000 + k, prose(draw, 60) if k % 2 else " ".join("".join(draw.choices("zqxjwv", k=4)) for _ in range(60))) for k in range(200)]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = labels(spark, [r for r in rows if (r[0] or 0) >= 1000], lambda i: i % 2).select("doc_id", "quality", "toxic")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns, name
        assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert rows[-1][0] not in {i for i, _ in left}
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert got(found, "doc_id", "piece", "start", "length", "ids_crc32") == reference_pieces(left)
