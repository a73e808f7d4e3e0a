"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  The field labels every word with a digit or an @, every
word of 16 letters or more, every word after a name of a secret (as in "token ="), and
every other occurrence of such a word in the text.  Neighbours share chain
potentials; the occurrences of a token share skip potentials with its first one,
and first occurrences of one shape after one word with the first of that kind, however
far apart they are.  Loopy sum-product messages run until they settle, so all
occurrences agree; tokens labelled surely that no base span touches become added spans.

The potentials are trained by pseudo-likelihood on a bounded sample of texts (those
of the smallest hashes).  What the patterns and a rule for secrets mark there is
carried to the other occurrences of the same token; every token is also seen once
more as an occurrence in the surroundings of an unmarked one, and every marked one after
a name of a secret in the shape of an unmarked one: so shape, surroundings and
repetition each learn to do without the others.

Defined cases: null and empty texts have no spans; offsets are code points; texts of any
length are searched whole; of overlapping candidates (ties) the first stands; rows
that repeat a doc_id are searched each, and with the same text count once in the
sample; a null doc_id is searched; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

# The kinds in the order of results, and their patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|api_?key|key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_=-]{16,})")


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost matches of [A-Za-z0-9._%+-]+@domain, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the graph of a text --------------------------------------------------

LABELS = ("none", *KINDS)
FEATURES = 1 << 12
AROUND = [4, 5, 6, 9]  # places of the features of a token's surroundings
_START = re.compile(r"[0-9@]")
_LONG = re.compile(r"(?<!\w)[^\W\d_]{16,}")
_CUE = re.compile(r"(?i)\b(?:token|secret|password|api_?key|key)\s*[=:]\s*[\"']?(?=\S{8})")
_CUED = re.compile(r"(?i)\b(?:token|secret|password|api_?key|key)\s*[=:]\s*[\"']?\Z")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_RUNS = (re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+"))
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|"


def _word_around(text: str, at: int, end: int) -> tuple[int, int]:
    """The word at text[at:end], without a name and its = or : before it."""
    a = at
    while a > 0 and text[a - 1] not in " \t\n\r\x0b\x0c":
        a -= 1
    space = _SPACE.search(text, end)
    b = space.start() if space else len(text)
    cut = max(text.rfind("=", a, b - 6), text.rfind(":", a, b - 6))
    return (cut + 1 if cut > a else a), b


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the words that the field labels, in order."""
    out: list[tuple[int, int]] = []

    def search(pattern: re.Pattern, whole: bool) -> int:
        """Adds the words around the matches, or what follows them, each word once."""
        at, before = 0, len(out)
        while m := pattern.search(text, at):
            space = _SPACE.search(text, m.end())
            out.append(_word_around(text, m.start(), m.end()) if whole else (m.end(), space.start() if space else len(text)))
            at = max(out[-1][1], m.end())
        return before

    search(_START, True)
    search(_LONG, True)
    named = out[search(_CUE, False) :] if "=" in text or ":" in text else []
    # letters alone are no candidate elsewhere: look for their other occurrences
    for core in {text[a:b].strip(_EDGE) for a, b in named}:
        at = text.find(core) if core.isalpha() else -1
        while at >= 0:
            end = at + len(core)
            if not text[max(0, at - 1) : at].isalnum() and not text[end : end + 1].isalnum():
                out.append((at, end))
            at = text.find(core, end)
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(out)):
        if a < b and (not kept or a >= kept[-1][1]):
            kept.append((a, b))
    return kept


def shape(word: str) -> str:
    """A word with its runs of digits and letters reduced to 9 and a."""
    return _RUNS[1].sub("a", _RUNS[0].sub("9", word[:64]))


def node_features(text: str, span: tuple[int, int]) -> tuple[list[int], str, str, bool]:
    """(hashed features, key of repeats, key of likeness, whether a name of a secret precedes it) of a candidate."""
    a, b = span
    word = text[a:b]
    core = word.strip(_EDGE)
    ahead = text[max(0, a - 40) : a]
    before, after, cued = ahead.split()[-2:], text[b : b + 30].split()[:1], bool(_CUED.search(ahead))
    last = before[-1].lower() if before else ""
    form, digits = shape(core), sum(c.isdigit() for c in core)
    names = (f"s{form[:24]}", f"h{shape(word)[:6]}", f"n{min(20, digits)}", f"l{min(12, len(core).bit_length())}", f"b{last[:16]}", f"c{''.join(before).lower()[-16:]}", f"a{shape(after[0])[:8] if after else ''}", f"q{word[:1]}{word[-1:]}" if not word[-1:].isalnum() else "q", f"p{len(form) > 12}", f"k{cued}")
    return [zlib.crc32(x.encode()) % FEATURES for x in names], core.lower(), f"{form[:24]} {last[:16]}", cued


def graph(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int, int]]]:
    """(candidates, their features, edges (i, j, kind)).

    kind 0: next to each other, 1: repeated, 2: alike, 3: repeated, and a name of a secret
    stands before one of the occurrences: what is seen at one is evidence at all.
    """
    spans = candidates(text)
    found = [node_features(text, span) for span in spans]
    named = {same for _, same, _, cued in found if cued}
    edges = []
    repeats: dict[str, int] = {}
    alike: dict[str, int] = {}
    for k, (_, same, like, _) in enumerate(found):
        if k and not text[spans[k - 1][1] : spans[k][0]].strip():
            edges.append((k - 1, k, 0))
        # each is linked to the first of its kind: two steps lead from any to any, and edges stay as many as tokens
        if same in repeats:
            edges.append((repeats[same], k, 3 if same in named else 1))
            continue
        if like in alike:
            edges.append((alike[like], k, 2))
        repeats[same] = k
        alike.setdefault(like, k)
    return spans, [row for row, _, _, _ in found], edges


def silver_labels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    marked = [(LABELS.index(kind), a, b) for kind, a, b in base_spans(text)]
    marked += [(LABELS.index("secret"), *m.span(1)) for m in _SECRET.finditer(text)]
    marked.sort(key=lambda x: x[1])
    out, k = [], 0
    for a, b in spans:
        while k < len(marked) and marked[k][2] <= a:
            k += 1
        out.append(marked[k][0] if k < len(marked) and marked[k][1] < b else 0)
    cores = [text[a:b].strip(_EDGE).lower() for a, b in spans]
    known = {core: y for core, y in zip(cores, out) if y and len(core) >= 8}
    return [y or known.get(core, 0) for core, y in zip(cores, out)]


# ---- potentials -----------------------------------------------------------


class Field:
    """Potentials: node (FEATURES, L); edge (4, L, L), rows for the earlier token."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.node, self.edge = np.zeros((FEATURES, n)), np.zeros((4, n, n))

    def train(self, rows: np.ndarray, labels: np.ndarray, edges: np.ndarray, steps: int = 400, rate: float = 0.2, decay: float = 1e-5) -> "Field":
        """Pseudo-likelihood: each label given its features and its neighbours' labels."""
        if len(labels) == 0:
            self.node[:, 0] = 1.0
            return self
        i, j, kind = edges.T
        m, v = [np.zeros_like(self.node), np.zeros_like(self.edge)], [np.zeros_like(self.node), np.zeros_like(self.edge)]
        truth = np.eye(len(LABELS))[labels]
        for step in range(1, steps + 1):
            score = self.node[rows].sum(axis=1)
            np.add.at(score, j, self.edge[kind, labels[i]])
            np.add.at(score, i, self.edge[kind, :, labels[j]])
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            d = (p / p.sum(axis=1, keepdims=True) - truth) / len(labels)
            g = [decay * self.node, decay * self.edge]
            for k in range(rows.shape[1]):
                np.add.at(g[0], rows[:, k], d)
            np.add.at(g[1], (kind, labels[i]), d[j])
            np.add.at(g[1].transpose(0, 2, 1), (kind, labels[j]), d[i])
            for a, x in enumerate((self.node, self.edge)):
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                v[a] = 0.99 * v[a] + 0.01 * g[a] ** 2
                x -= rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.99**step)) + 1e-6)
        return self

    def beliefs(self, rows: np.ndarray, edges: np.ndarray, rounds: int = 60, settled: float = 1e-4) -> np.ndarray:
        """Marginals by loopy sum-product messages, damped by a half, until none moves by more than `settled`."""
        score = self.node[rows].sum(axis=1)
        if len(edges):
            i, j, kind = edges.T
            table = np.concatenate([self.edge[kind], self.edge[kind].transpose(0, 2, 1)])
            source, target = np.concatenate([i, j]), np.concatenate([j, i])
            back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(rounds):
                total = score.copy()
                np.add.at(total, target, message)
                cavity = total[source] - message[back]
                new = _log_sum(cavity[:, :, None] + table)
                step = 0.5 * (new - new.max(axis=1, keepdims=True) - message)
                message += step
                if np.abs(step).max() < settled:
                    break
            np.add.at(score, target, message)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def added_spans(text: str, spans: list[tuple[int, int]], belief: np.ndarray, base: list[tuple[str, int, int]], sure: float) -> list[tuple[str, int, int]]:
    """Surely labelled tokens, cut to their cores, that no base span touches; neighbours of one kind are one span."""
    taken, out, k = sorted((a, b) for _, a, b in base), [], 0
    for n, (a, b) in enumerate(spans):
        label = int(belief[n].argmax())
        if label == 0 or belief[n, label] < sure:
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
        if a >= b:
            continue
        if out and out[-1][0] == KINDS[label - 1] and not text[out[-1][2] : a].strip():
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((KINDS[label - 1], a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def sampled_graph(text: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, edges) of a text's candidates: of all, or of `most` that their hashes choose from the whole text."""
    spans, rows, edges = graph(text)
    labels = np.array(silver_labels(text, spans), np.int64)
    rows, edges = np.array(rows, np.int64).reshape(len(spans), -1), np.array(edges, np.int64).reshape(-1, 3)
    if len(spans) > most:
        chosen = np.sort(np.argsort([zlib.crc32(text[a:b].lower().encode("utf-8", "replace")) for a, b in spans], kind="stable")[:most])
        place = np.full(len(spans), -1)
        place[chosen] = np.arange(most)
        edges = edges[(place[edges[:, 0]] >= 0) & (place[edges[:, 1]] >= 0)]
        edges[:, :2] = place[edges[:, :2]]
        rows, labels = rows[chosen], labels[chosen]
    return rows, labels, edges


def fitted(graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> "Field":
    """The potentials from sampled graphs."""
    graphs = [g for g in graphs if len(g[1])]
    if not graphs:
        return Field().train(np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64))
    starts = np.cumsum([0, *(len(g[1]) for g in graphs)])
    rows, labels = np.concatenate([g[0] for g in graphs]), np.concatenate([g[1] for g in graphs])
    edges = np.concatenate([g[2] + [s, s, 0] for g, s in zip(graphs, starts)])
    plain, draw = np.flatnonzero(labels == 0), np.random.default_rng(9)
    unmarked = lambda own: rows[draw.choice(plain, len(own))] if len(plain) else own
    cued = rows[:, AROUND[-1]] == zlib.crc32(b"kTrue") % FEATURES
    # what follows a name of a secret once more, in the shape of an unmarked token
    named = np.flatnonzero((labels == LABELS.index("secret")) & cued)
    shaped = unmarked(rows[named]).copy()
    shaped[:, AROUND] = rows[named][:, AROUND]
    rows, labels, cued = np.concatenate([rows, shaped]), np.concatenate([labels, labels[named]]), np.concatenate([cued, cued[named]])
    # every token once more, as an occurrence in the surroundings of an unmarked one
    again, n = rows.copy(), len(labels)
    again[:, AROUND] = unmarked(rows)[:, AROUND]
    copied = np.stack([np.arange(n), np.arange(n) + n, np.where(cued, 3, 1)], axis=1)
    return Field().train(np.concatenate([rows, again]), np.concatenate([labels, labels]), np.concatenate([edges, copied]))


def found_spans(texts: list[str], model: "Field", sure: float) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base, graphs = [base_spans(t) for t in texts], [graph(t) for t in texts]
    starts = np.cumsum([0, *(len(g[0]) for g in graphs)])
    rows = np.array([r for g in graphs for r in g[1]], np.int64).reshape(starts[-1], -1 if starts[-1] else 0)
    edges = np.array([(i + s, j + s, k) for g, s in zip(graphs, starts) for i, j, k in g[2]], np.int64).reshape(-1, 3)
    belief = model.beliefs(rows, edges) if len(rows) else np.zeros((0, len(LABELS)))
    return [(own, added_spans(t, graphs[k][0], belief[starts[k] : starts[k + 1]], own, sure)) for k, (t, own) in enumerate(zip(texts, base))]


def _sample_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tuple(x.ravel() for x in sampled_graph(t, most)) for t in batch.column(0).to_pylist()]
        columns = list(zip(*found)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32())) for c in columns], names=["rows", "labels", "edges"])


def _span_rows(batches: Iterator[pa.RecordBatch], field, sure: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, all_spans = [], [], []
        for base, more in found_spans([t or "" for t in batch.column(1).to_pylist()], field.value, sure):
            counts.append([sum(s[0] == kind for s in base) for kind in BASE])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            all_spans.append(joined(base + more))
        counts = np.array(counts, np.int64).reshape(-1, len(BASE))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(counts[:, k]) for k in range(len(BASE))), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sample: int = 4000, sample_nodes: int = 64, sure: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    The potentials are fitted on max_sample texts with a candidate, on sample_nodes
    candidates of each; the search covers all of every text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usable = rows.where(F.col("text").rlike("[0-9@]")).withColumn("text_id", F.xxhash64("text"))
    sample = usable.select(F.xxhash64("doc_id", "text_id").alias("h"), "text_id").distinct().orderBy("h", "text_id").limit(max_sample).select("text_id").distinct()
    sampled = usable.join(F.broadcast(sample), "text_id", "left_semi").dropDuplicates(["text_id"]).select("text").mapInArrow(partial(_sample_rows, most=sample_nodes), "rows array<int>, labels array<int>, edges array<int>").toArrow()
    found = sorted(zip(*(sampled.column(c).to_pylist() for c in ("rows", "labels", "edges"))))
    field = fitted([(np.array(r, np.int64).reshape(len(y), -1 if y else 0), np.array(y, np.int64), np.array(e, np.int64).reshape(-1, 3)) for r, y, e in found])
    shared = spark.sparkContext.broadcast(field)
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return rows.mapInArrow(partial(_span_rows, field=shared, sure=sure), f"doc_id long, {counts}, base_sha256 string, spans string")
