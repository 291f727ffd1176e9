"""Quality by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .fitting import Adam, held_out, sampled, sigmoid
from .packed import IS_WORD, Packed, chunks

#: Bytes of a passage; the last passage of a text may be shorter.
PASSAGE = 512
#: Buckets byte pairs are hashed to.
PAIRS = 64
#: Bounds of the labelled sample the model is fitted on: documents, and passages in all.
MOST_LABELLED, MOST_PASSAGES = 6000, 40_000
FOLDS, HELD_OUT = 4, 2
CUT = 0.7

#: A class for each byte: lower, upper, digit, beyond ASCII, blank, line end, other, or one for each ASCII sign.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4, 5
for _i, _c in enumerate(c for c in range(33, 127) if not IS_WORD[c]):
    _CLASS[_c] = 7 + _i
CLASSES = int(_CLASS.max()) + 1
WIDTH = CLASSES + PAIRS + 7


def passages(p: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(encoded passages, text number of each). Every byte is in one passage; an empty text has one empty passage."""
    per_text = np.maximum(1, -(-p.lens // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per_text)])
    n = int(base[-1])
    owner_of_byte = np.repeat(np.arange(len(p.lens)), p.lens + 1)
    offset = np.arange(len(p.raw)) - p.starts[owner_of_byte]
    at = base[owner_of_byte] + np.minimum(offset // PASSAGE, per_text[owner_of_byte] - 1)
    inside = offset < p.lens[owner_of_byte]
    at, cls, raw, own = at[inside], _CLASS[p.raw[inside]], p.raw[inside].astype(np.int64), owner_of_byte[inside]
    size = np.maximum(np.bincount(at, minlength=n), 1)[:, None]
    counts = np.bincount(at * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES) / size
    within = np.flatnonzero(own[1:] == own[:-1])  # a text's last byte makes no pair with the next text
    pair = (raw[within] * 131 + raw[within + 1]) % PAIRS
    pairs = np.bincount(at[within] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / size

    first = p.starts[p.text_of(p.w0)]
    of_word = base[p.text_of(p.w0)] + np.minimum((p.w0 - first) // PASSAGE, per_text[p.text_of(p.w0)] - 1)
    h = p.word_hashes()
    words = np.bincount(of_word, minlength=n)
    some = np.maximum(words, 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    new = np.ones(len(h))
    new[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (of_word[order[1:]] != of_word[order[:-1]])
    length = (p.w1 - p.w0).astype(float)
    upper = p.raw[p.w0] != p.low[p.w0] if len(h) else np.zeros(0)
    stats = [np.bincount(of_word, x, n) / some for x in (same, new, length / 10, length**2 / 100, upper)] + [np.log1p(words) / 5, np.log1p(size[:, 0]) / 7]
    return np.hstack([np.sqrt(counts), np.sqrt(pairs), np.stack(stats, axis=1)]).astype(np.float32), np.repeat(np.arange(len(p.lens)), per_text)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first, last, texts in chunks(pdf["text"].tolist()):
            x, owner = passages(Packed(texts))
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[first:last], "label": pdf["label"].to_numpy()[first:last], "x": [x[a:b].ravel() for a, b in zip(cut[:-1], cut[1:])]})


class GatedAttention:
    """h = tanh(xW + b); a = softmax(w . (tanh(hV) * sigmoid(hU))) over a document; score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = [r(width, hidden), np.zeros(hidden), r(hidden, gate), r(hidden, gate), r(gate), r(hidden), np.zeros(1)]

    def forward(self, x: np.ndarray, cut: np.ndarray):
        """Scores of the documents whose passages are x[cut[i]:cut[i + 1]], none of them empty."""
        w, b, v, u, a, c, d = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), sigmoid(h @ u)
        e = (tv * su) @ a
        n = np.diff(cut)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, cut[:-1]), n))
        att = e / np.repeat(np.add.reduceat(e, cut[:-1]), n)
        z = np.add.reduceat(att[:, None] * h, cut[:-1], axis=0)
        return sigmoid(z @ c + d[0]), (x, h, tv, su, att, z, n)

    def gradients(self, cut: np.ndarray, y: np.ndarray, weight: np.ndarray, score: np.ndarray, kept, decay: float) -> list[np.ndarray]:
        w, b, v, u, a, c, d = self.p
        x, h, tv, su, att, z, n = kept
        g = (score - y) * weight / weight.sum()
        gz = np.repeat(g[:, None] * c, n, axis=0)
        gatt = (gz * h).sum(1)
        ge = att * (gatt - np.repeat(np.add.reduceat(att * gatt, cut[:-1]), n))
        gt, gs = ge[:, None] * a * su * (1 - tv**2), ge[:, None] * a * tv * su * (1 - su)
        gh = att[:, None] * gz + gt @ v.T + gs @ u.T
        gx = gh * (1 - h**2)
        return [x.T @ gx + decay * w, gx.sum(0), h.T @ gt + decay * v, h.T @ gs + decay * u, (tv * su).T @ ge, z.T @ g + decay * c, np.array([g.sum()])]

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 3, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4) -> GatedAttention:
        everything = np.concatenate(docs)
        self.mean, self.scale = everything.mean(0), np.maximum(everything.std(0), 1e-2)
        opt, rng = Adam(self.p, rate), np.random.default_rng(seed)
        for epoch in range(epochs):
            opt.rate = rate * (1 - 0.9 * epoch / epochs)
            order = rng.permutation(len(docs))
            for k in range(0, len(order), 64):
                some = order[k : k + 64]
                x = np.concatenate([docs[i] for i in some])
                cut = np.concatenate([[0], np.cumsum([len(docs[i]) for i in some])])
                score, kept = self.forward(x, cut)
                opt.step(self.gradients(cut, y[some], np.ones(len(some)), score, kept, decay))
        return self


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_passages: int = MOST_PASSAGES, seed: int = 3) -> GatedAttention | float:
    """Fit on a bounded sample of the labels outside the held-out fold; without both labels, the share of ones.

    About most_labelled documents are taken by a hash of their ids and, if they
    have more than most_passages passages together, as large a share of them as
    has not; one with over a tenth of that alone doesn't teach. Of rows with one
    id the one with the least text teaches. The sample is put in the order of
    the hash, so that the fit depends on the rows alone, not on how they are stored.
    """
    known = labels.filter(~held_out(FOLDS, HELD_OUT) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = sampled(known, most_labelled, seed)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumns({"key": F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), "n": F.ceil((F.octet_length("text") + 1) / PASSAGE)}).filter(F.col("n") <= most_passages / 10)
    rows = settle(rows.select("key", "label", "text", "n"))
    total, span = rows.agg(F.sum("n")).first()[0] or 0, 1 << 20
    if total > most_passages:
        rows = rows.filter(F.pmod("key", F.lit(span)) < int(span * most_passages / total))
    rows = rows.select("key", "label", "text").mapInPandas(_encode, "key long, label int, x array<float>").toPandas().sort_values(["key", "label"])
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return GatedAttention(WIDTH).fit([np.asarray(x, dtype=np.float32).reshape(-1, WIDTH) for x in rows["x"]], y, seed)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """The rows of docs that score cut or more, with all their columns.

    Null and empty texts are scored as one empty passage; rows with equal texts
    stay or go together, whatever their ids; an empty table stays empty. Without
    labels of both kinds all rows stay or all go, by the share of ones.
    """
    model = train(docs, labels, **options)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in chunks(batch.column(at).to_pylist()):
                if isinstance(model, float):
                    good = np.full(len(texts), model >= cut)
                else:
                    x, owner = passages(Packed(texts))
                    good = model.forward(x, np.searchsorted(owner, np.arange(len(texts) + 1)))[0] >= cut
                if good.any():
                    yield batch.slice(first, last - first).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Rows (keep..., score), one for each row of docs; score: how likely the label is 1.

    A text is cut into passages that cover it all; each is encoded, a gated
    attention weighs them, and the weighted mean is scored. Null and empty texts
    are one empty passage; equal texts get equal scores. Labels without a
    document, null labels and empty tables are no error; without labels of both
    kinds every score is the share of ones (0.5 without any).
    """
    model = train(docs, labels, **options)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for first, last, texts in chunks(pdf["__text"].tolist()):
                    x, owner = passages(Packed(texts))
                    out[first:last] = model.forward(x, np.searchsorted(owner, np.arange(len(texts) + 1)))[0]
            yield pdf.drop(columns="__text").assign(__score=out)

    as_text = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(keep)]
    schema = ", ".join([*(f"c{i} string" for i in range(len(keep))), "__score double"])
    scored = docs.select(*as_text, F.col("text").alias("__text")).mapInPandas(score, schema)
    return scored.select(*[F.col(f"c{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(keep)], F.col("__score").alias("score"))


def judge_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    return score_quality(docs, labels, **options).select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
