"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a linear model over its words and word
beginnings; noisy-or combines them to the document's probability, and the weights are trained from document labels
alone by gradient descent on the bag likelihood. The same weights then locate offending sentences. A sentence without
any feature of the model is no evidence and counts as 0, in training as in scoring, so that long texts don't turn toxic
by their length; a feature counts once in a sentence.

Null or empty texts are bags without sentences and score 0; texts of any length are scored whole; repeated rows score
alike, and a score of just 0.5 is toxic; an empty table gives an empty one; extra columns are ignored. Without any
positive or negative label every score is 0. Labels that contradict each other for one id count as toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, trim

_SENTENCE = re.compile(rb"[.!?\n]+")
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
STARTS = (4, 5, 6)


def features(word: bytes) -> list[bytes]:
    """A word, and its beginnings as ``begin*``: inflected forms share them."""
    return [word, *(word[:k] + b"*" for k in STARTS if len(word) > k)]


def sentences(text: str) -> list[tuple[int, int, list[bytes]]]:
    """(start byte, end byte, words) of the sentences that have words."""
    raw, out, at = text.encode(), [], 0
    for m in [*_SENTENCE.finditer(raw), None]:
        end = m.start() if m else len(raw)
        if words := raw[at:end].translate(_LETTERS).split():
            out.append((at, end, words))
        at = m.end() if m else end
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_total: int = 24_000_000) -> list[tuple[str, int]]:
    """Labelled rows outside the held-out fold as (text, label), by a hash of their id: the first ``limit`` of them, as
    many as hold ``max_total`` characters together. That bounds what the driver holds; no row is left out for its length
    alone. Rows that share an id all take its label."""
    marked = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.where(~held_out("id")).withColumn("h", F.xxhash64("id"))
    chosen = marked.orderBy("h").limit(limit)
    rows = id_text(docs, id_col, text_col).where(~held_out("id")).withColumn("k", F.xxhash64("text")).join(F.broadcast(chosen), "id")  # at most ``limit`` rows are broadcast
    sizes = rows.select("h", "id", "k", F.length("text").alias("n")).orderBy("h", "id", "k").limit(limit).collect()
    taken = 0
    for n, r in enumerate(sizes):
        taken += r.n
        if taken > max_total:
            sizes = sizes[:n]
            break
    if not sizes:
        return []
    last = F.struct(*[F.lit(v).cast("long") for v in sizes[-1][:3]])
    return [(r.text, r.y) for r in rows.where(F.struct("h", "id", "k") <= last).select("text", "y", "h", "id", "k").orderBy("h", "id", "k").limit(len(sizes)).collect()]


def train(rows: list[tuple[str, int]], rounds: int = 60, least: int = 3, rate: float = 0.5, l2: float = 1e-4) -> tuple[dict[bytes, float], float]:
    """Feature weights and bias. Features seen in under ``least`` documents, or as often in clean as in toxic ones as
    chance has it, are left out. Adagrad on the mean noisy-or log-likelihood."""
    n_pos = sum(y for _, y in rows)
    if not 0 < n_pos < len(rows):
        return {}, -30.0
    telling, base = _telling_buckets(rows, least), n_pos / len(rows)
    index: dict[bytes, int] = {}
    doc, sent, feat, y = (array("i") for _ in range(4))
    at = 0
    for text, label in rows:
        if not (found := sentences(text)):
            continue
        for _, _, words in found:
            held = {f for w in words for f in features(w) if telling[_bucket(f)]}
            feat.extend([index.setdefault(f, len(index)) for f in held])
            sent.extend([at] * len(held))
            doc.append(len(y))
            at += 1
        y.append(label)
    feat, sent, doc, y = (np.array(x, np.int64) for x in (feat, sent, doc, y))
    once = np.unique(np.stack([doc[sent], feat], axis=1), axis=0) if len(feat) else np.zeros((0, 2), np.int64)
    n_docs = np.bincount(once[:, 1], minlength=len(index))
    n_bad = np.bincount(once[:, 1], y[once[:, 0]], minlength=len(index))
    chosen = np.flatnonzero((n_docs >= least) & ((n_bad + 0.5 * base) / (n_docs + 0.5) > 2 * base))
    place = np.full(len(index), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    every = list(index)
    names = [every[i] for i in chosen.tolist()]
    sent, feat = sent[place[feat] >= 0], place[feat[place[feat] >= 0]]
    told, sent = np.unique(sent, return_inverse=True)  # sentences without features are no evidence
    doc, at = doc[told], len(told)
    w, b = np.zeros(len(names)), -5.0
    gw, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(sent, w[feat], minlength=at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        bag = np.clip(1 - np.exp(none), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/dz: p for clean bags, -p (1 - bag) / bag for toxic ones
        g = np.where(y[doc] == 1, -p * (1 - bag[doc]) / bag[doc], p)
        dw = np.bincount(feat, g[sent], minlength=len(names)) / len(y) + l2 * w / max(1, len(names)) ** 0.5
        db = g.sum() / len(y)
        gw += dw**2
        gb += db**2
        w -= rate * dw / np.sqrt(gw)
        b = min(-4.0, b - 0.1 * db / np.sqrt(gb))
    return dict(zip(names, w.tolist())), float(b)


BUCKETS = 1 << 23


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) & (BUCKETS - 1)


def _telling_buckets(rows: list[tuple[str, int]], least: int) -> np.ndarray:
    """Of hashed features, which buckets may hold one that toxic documents have clearly more often. Counting by bucket
    keeps the driver's memory fixed; names are only kept for these."""
    seen, bad = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for text, label in rows:
        own = np.fromiter({_bucket(f) for _, _, words in sentences(text) for w in words for f in features(w)}, np.int64)
        seen[own] += 1
        bad[own] += label
    return (seen >= least) & ((bad + 0.5) / (seen + 0.5) > 1.5 * sum(y for _, y in rows) / len(rows))


def bag_scores(text: str, weights: dict[bytes, float], bias: float, known: dict[bytes, tuple], found: list | None = None) -> float:
    """Noisy-or of the sentence probabilities of one text; ``known`` keeps words' features; ``found`` takes the
    (start byte, end byte, probability) of sentences of one half or more."""
    none = 0.0
    for start, end, words in sentences(text):
        held: set[bytes] = set()
        for w in words:
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in features(w) if f in weights)
            if own:
                held.update(own)
        if held:
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, bias + sum(weights[f] for f in sorted(held))))))
            none += math.log1p(-min(p, 1 - 1e-9))
            if found is not None and p >= 0.5:
                found.append((start, end, p))
    return 1 - math.exp(none)


def score(docs: DataFrame, weights: dict[bytes, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans are the offending sentences (bytes, probability). One narrow scan."""

    def scan(batches):
        known: dict[bytes, tuple] = {}
        for b in batches:
            scores, spans = [], []
            for t in b.column(1).to_pylist():
                if len(known) > 150_000:
                    known = {}
                spans.append(found := [])
                scores.append(bag_scores(t, weights, bias, known, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], ["doc_id", "score", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, score double, spans array<struct<start int, end int, p double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they were."""
    weights, bias = train(training_rows(docs, labels, limit))
    at = docs.columns.index("text")

    def keep(batches):
        known: dict[bytes, tuple] = {}
        for b in batches:
            ok = []
            for t in b.column(at).to_pylist():
                if len(known) > 150_000:
                    known = {}
                ok.append(not t or bag_scores(t, weights, bias, known) < threshold)
            yield b.filter(pa.array(ok, pa.bool_()))
        del known
        trim()

    return docs.mapInArrow(keep, docs.schema)
