"""Hard negatives, vector codes and byte-level BPE against brute force, SQL and tiktoken."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from syncwright.llm import bpe, hard_negatives, queries, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, q string, row string, code string"


def vectors(spark, rows):
    """(id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# ---- hard negatives ---------------------------------------------------------


def brute_negatives(rows, anchor, positives=5, negatives=5):
    q = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows]
    out = []
    for k, (i, label, a) in enumerate(q):
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, other) for n, (j, other, b) in enumerate(q) if n != k]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            near = sorted(r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:negatives]
            out += [(i, p, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    found = hard_negatives.mined(vectors(spark, rows), F.col("vec_id") % 10 == 0, **options)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("cell", [(1 << 15, 1 << 12), (2048, 7)])
def test_hard_negatives_equal_brute_force(spark, cell):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    rows = []
    for i in range(2200 if cell[1] == 7 else 400):
        # a third of all rows have one label and nearly one place; many scores tie
        label = 0 if i % 3 == 0 else int(r.integers(1, 6))
        v = np.round(centres[label] * (1 if i % 3 else 2) + r.normal(size=12) * (0.4 if i % 3 else 0.01), 1)
        rows.append((i, v.tolist(), label))
    anchor = lambda i: i % 10 == 0 and i < 120
    found = hard_negatives.mined(vectors(spark, rows), (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 120), rows_per_cell=cell[0], anchors_per_cell=cell[1])
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, anchor)


def test_hard_negatives_of_odd_rows(spark):
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (10, [-1.0, 0.5], 1)]
    odd = [(4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [1e300, 0.0], 2)]
    assert mined(spark, good + odd) == brute_negatives(good, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, odd) == []
    twice = good + [good[0], good[2]]
    assert mined(spark, twice) == brute_negatives(twice, lambda i: i % 10 == 0)
    # short vectors end in zeros
    assert mined(spark, [*good, (11, [0.95], 3), (12, [], 3)]) == brute_negatives([*good, (11, [0.95, 0.0], 3), (12, [0.0, 0.0], 3)], lambda i: i % 10 == 0)


def test_discarding_keeps_every_pair_in_range():
    r = np.random.default_rng(2)
    for scale in (3, 3000, 1 << 24):
        q = r.integers(-scale, scale, size=(300, 16))
        axes = np.linalg.qr(r.normal(size=(16, 16)))[0]
        cuts = [4, 8, 12, 16]
        a, b = hard_negatives.Block(q[:40], axes, cuts), hard_negatives.Block(q, axes, cuts)
        exact = q[:40] @ q.T
        least, most = np.quantile(exact, 0.97, axis=1).astype(np.int64), exact.max(1)
        i, j, product = hard_negatives.survivors(a, b, cuts, least.astype(float), most.astype(float), None)
        assert (product == exact[i, j]).all()
        there = np.zeros(exact.shape, bool)
        there[i, j] = True
        assert there[(exact >= least[:, None]) & (exact <= most[:, None])].all()
        assert len(i) < exact.size / 2


# ---- vector codes -----------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows]
    q = np.array([v for _, v, _ in kept])
    x = q.reshape(len(q), 4, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][2] is not None and kept[k][2] or 0, kept[k][1]))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(4)], 1)
    for _ in range(rounds):
        code = nearest()
        for p in range(4):
            for e in set(code[:, p].tolist()):
                own = x[code[:, p] == e, p]
                books[p, e] = [int(t) // len(own) for t in own.sum(0)]
    code = nearest()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(4)).tolist()
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in row), e, by_label[label], digest) for (i, _, label), row, e in zip(kept, code.tolist(), error))


def compressed(spark, rows, **options):
    return sorted(map(tuple, vector_codes.compressed(vectors(spark, rows), **options).collect()))


def test_codes_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-3, 4, 16) / 1024 if i % 3 else r.normal(size=16)).tolist(), [None, 1, 2][i % 3]) for i in range(900)]
    assert compressed(spark, rows) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    good = [(3, [0.5] * 8, 1), (1, [0.25] * 8, None), (2, [0.25] * 8, None), (3, [0.5] * 8, 1), (-4, [-0.0001] * 8, 2)]
    odd = [(0, None, 1), (5, [0.0] * 7 + [None], 1), (6, [float("nan")] * 8, 1), (7, [float("-inf")] * 8, 1), (8, [1e200] * 8, 1)]
    assert compressed(spark, good + odd) == brute_codes(good)
    assert compressed(spark, odd) == [] and compressed(spark, []) == []
    short = [(1, [0.5, 0.25, 0.125], 1), (2, [0.5], 1), (3, [], 1)]
    assert compressed(spark, short) == brute_codes([(1, [0.5, 0.25, 0.125, 0.0], 1), (2, [0.5, 0.0, 0.0, 0.0], 1), (3, [0.0] * 4, 1)])


def test_bounds_skip_scans_and_change_nothing():
    r = np.random.default_rng(4)
    book = r.integers(-40, 40, (32, 4)) * 100
    x = book[r.integers(0, 32, 5000)] + r.integers(-60, 60, (5000, 4))
    state, moved, share = (None, None, None), None, []
    for _ in range(5):
        code, upper, lower, scanned = vector_codes.assigned(x, book, *(None if s is None else s.copy() for s in state), moved)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == far.argmin(1)).all()
        ranked = np.sqrt(np.sort(far, 1)[:, :2].astype(float))
        assert (upper >= ranked[:, 0]).all() and (lower <= ranked[:, 1]).all()
        share.append(scanned.mean())
        new = book.copy()
        for e in set(code.tolist()):
            new[e] = x[code == e].sum(0) // (code == e).sum()
        moved = vector_codes._moves(book[None], new[None])[0]
        book, state = new, (code, upper, lower)
    assert share[0] == 1 and share[-1] < 0.3


# ---- byte-level BPE ---------------------------------------------------------

DOCS = "doc_id long, text string, ids string, bytes string"


def encoding(vocabulary: bpe.Vocabulary, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["the", " in", "ing", "ab", "a", " ", "  ", "\n", "\t\r", "é", "ß", "中文", "😀", "1", "٣", "'s", "'LL", "!?", "\x1c", "\x85", "​", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_tiktoken(spark):
    rows = texts(3000, 1) + ["", "a" * 30_000, " " * 5_000, "á" * 500, "ab" * 20_000 + " x"]
    plain = encoding(bpe.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(rows)] + [(-1, None, "x", "y"), (None, "one", "x", "y"), (0, rows[0], "x", "y")], DOCS)
    got = bpe.decoded(bpe.encoded(docs, share=2000)).collect()
    assert len(got) == len(rows) + 3
    for row in got:
        text = "" if row.doc_id == -1 else "one" if row.doc_id is None else rows[row.doc_id]
        assert row.ids == plain.encode_ordinary(text) and bytes(row.bytes) == text.encode()
    assert bpe.decoded(bpe.encoded(docs.limit(0))).count() == 0


def test_every_code_point():
    v = bpe.vocabulary("byte_bpe_50k.tiktoken")
    plain = encoding(v, public_tokenizers.PATTERN)
    rows = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} " for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    ids, counts = v.encoded(rows)
    want = plain.encode_ordinary_batch(rows)
    assert counts.tolist() == [len(w) for w in want]
    assert np.array_equal(ids, np.concatenate(want))


@pytest.mark.parametrize("seed", range(8))
def test_any_order_of_ranks(seed):
    """Vocabularies whose ranks follow no training, so that merges make pairs of lower ranks."""
    rng = random.Random(seed)
    made = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)}
    order = [bytes([b]) for b in range(256)] + sorted(made, key=lambda _: rng.random())
    v = bpe.Vocabulary({t: k for k, t in enumerate(order)}, r"\S+|\s+")
    plain = encoding(v, r"\S+|\s+")
    rows = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(20)) for _ in range(200)]
    ids, counts = v.encoded(rows)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain.encode_ordinary_batch(rows)
    for word in rows[0].split():
        whole = v.ranks.get(word.encode())
        assert ([whole] if whole is not None else v.alone(word.encode())) == plain.encode_ordinary(word)


def test_bytes_that_are_no_text_and_odd_ids(spark):
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    got = bpe.decoded(bpe.encoded(broken)).first()
    assert bytes(got.bytes) == "a�b".encode()
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decoded(rows).collect()} == {1: b"", 2: b"", 3: b"ab"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decoded(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>")).collect()


def test_op12_is_what_tiktoken_gives(spark):
    plain = encoding(bpe.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_bpe(spark, SF).collect()
    assert len(got) == len(source)
    for row in got:
        ids = plain.encode_ordinary(source[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(source[row.doc_id].encode()).hexdigest()
