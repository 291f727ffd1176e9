"""Toxicity by non-negative positive-unlabelled learning on hashed words and their beginnings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle
from .fitting import Adam, chosen, held_out, sampled, sigmoid
from .packed import Packed, chunks, mixed

DIMS = 1 << 20
#: Beginnings of words, in bytes, taken as features beside whole words.
PREFIXES = (4, 5, 6, 7)
#: Pairs of minima by which near copies are told in a sample.
KEYS = 5
#: Bounds of the samples the model is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 12000
#: Positives a feature must occur in, and how rare a chance feature must be among those tested.
MIN_SUPPORT, CERTAIN = 5, 3.0
FOLDS, HELD_OUT = 3, 1
CUT = 0.7


def features(p: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each word and each beginning of a word, repeats included."""
    owner = p.text_of(p.w0)
    ids, owners = [p.hashes(p.w0, p.w1) % np.uint64(DIMS)], [owner]
    for n in PREFIXES:
        long = p.w1 - p.w0 > n
        ids.append((p.hashes(p.w0[long], p.w0[long] + n) * np.uint64(2 * n + 1)) % np.uint64(DIMS))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def copy_keys(p: Packed) -> np.ndarray:
    """(texts, KEYS): keys of two minima over scattered word trigrams. Near copies agree in some, other texts in none."""
    h, owner = p.word_hashes(), p.text_of(p.w0)
    out = np.zeros((len(p.lens), 2 * KEYS), dtype=np.uint64)
    total = np.zeros(len(p.lens), dtype=np.uint64)
    np.add.at(total, owner, h)
    out[:] = mixed(total + np.uint64(1))[:, None]  # too short for a trigram
    same = owner[2:] == owner[:-2]
    tri, owner = mixed(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[same], owner[2:][same]
    if len(tri):
        full = np.unique(owner)
        cut = np.searchsorted(owner, full)
        for k in range(2 * KEYS):
            out[full, k] = np.minimum.reduceat(mixed(tri + np.uint64(k + 1)), cut)
    return mixed(out[:, 0::2]) ^ out[:, 1::2]


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct features of each text, and its keys."""
    for pdf in batches:
        for first, last, texts in chunks(pdf["text"].tolist()):
            p = Packed(texts)
            owner, ids = features(p)
            pairs = np.unique(owner * DIMS + ids)
            cut = np.searchsorted(pairs, np.arange(len(texts) + 1) * DIMS)
            rows = [(pairs[a:b] % DIMS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
            pairs = copy_keys(p)
            yield pd.DataFrame({"rank": pdf["rank"].to_numpy()[first:last], "pos": pdf["pos"].to_numpy()[first:last], **{f"k{k}": np.ascontiguousarray(pairs[:, k]).view(np.int64) for k in range(KEYS)}, "ids": rows})


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, steps: int = 800, rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear scorer with the non-negative risk; texts are lists of features below width.

    Risk: prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)]), with
    logistic loss, descended on the whole sample at once, and shrink times the sum
    of the weights, which clears weights that only noise holds up. Weights are not negative, so no text is cleared by its length.
    Without positives the scorer is constant.
    """
    if not pos or not unl:
        return np.zeros(width), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    flat = lambda docs: (np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
    (pi, rp), (ui, ru) = flat(pos), flat(unl)
    w, b = np.zeros(width), np.array([np.log(prior / (1 - prior))])
    opt = Adam([w, b], rate)
    for step in range(steps):
        opt.rate = rate * (1 - 0.9 * step / steps)
        sp = sigmoid(np.bincount(rp, w[pi], len(pos)) + b[0])
        su = sigmoid(np.bincount(ru, w[ui], len(unl)) + b[0])
        negative = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        gp, gu, back = -prior * (1 - sp) / len(pos), su / len(unl), -prior * sp / len(pos)
        gp, gu = (gp + back, gu) if negative >= 0 else (gp, np.zeros_like(gu))
        opt.step([np.bincount(pi, gp[rp], width) + np.bincount(ui, gu[ru], width) + shrink, np.array([gp.sum() + gu.sum()])])
        np.maximum(w, 0, out=w)
    return w, float(b[0])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, bias), fitted on bounded samples outside the held-out fold.

    The samples are confirmed toxic texts, about most_positive of them, one for
    each labelled id, and about most_unlabelled texts of any kind taken as
    unlabelled; both are chosen by hashes, and near copies count once. Features
    are those in MIN_SUPPORT positives that are so frequent there, against the
    unlabelled, that by the prior half of the texts with them are toxic (and at
    least twice as frequent), with a Poisson likelihood ratio that less than one
    in exp(CERTAIN) of the features tested reaches by chance; only these reach
    the driver. The class prior is the share of toxic rows among the labels
    outside the fold, or, if larger, the median ratio of these features'
    frequencies in the two samples: a prior that is too low would turn
    unlabelled toxic texts into counter-examples. All orders are those of
    hashes, so that the fit depends on the rows alone, not on how they are stored.
    """
    known = labels.filter(~held_out(FOLDS, HELD_OUT) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    prior = min(0.9, max(1e-3, toxic / n)) if n else 0.05
    pos = sampled(known.filter("toxic = 1").select("doc_id"), most_positive, seed)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    confirmed = texts.join(F.broadcast(pos), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rank = F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string"), F.col("text"))
    others = texts.filter(~held_out(FOLDS, HELD_OUT))
    others = others.filter(chosen(rank, most_unlabelled, others.count()))
    both = confirmed.select("text", rank.alias("rank"), F.lit(True).alias("pos")).unionByName(others.select("text", rank.alias("rank"), F.lit(False).alias("pos")))
    encoded = both.mapInPandas(_encode, f"rank long, pos boolean, {', '.join(f'k{k} long' for k in range(KEYS))}, ids array<int>")
    columns = ["rank", "pos", *(f"k{k}" for k in range(KEYS)), "ids"]
    for k in range(KEYS):
        encoded = encoded.groupBy("pos", F.col(f"k{k}").alias("same")).agg(F.min_by(F.struct(*columns), F.col("rank")).alias("kept")).select("kept.*")
    encoded = settle(encoded)
    n_pos, n_unl = encoded.agg(F.count_if("pos"), F.count_if(~F.col("pos"))).first()
    if not n_pos or not n_unl:
        return np.zeros(0, np.int64), *fit_nnpu([], [], 0, prior)
    seen = settle(encoded.select("pos", F.explode("ids").alias("id")).groupBy("id").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("u")).filter(F.col("p") >= MIN_SUPPORT))
    least = CERTAIN + float(np.log(max(1, seen.count())))
    expected = F.lit(float(n_pos)) * (F.col("u") + 0.5) / F.lit(float(n_unl))
    telling = seen.filter((F.col("p") >= max(2.0, 0.5 / prior) * expected) & (F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1)) / expected) - F.col("p") + expected >= least))
    telling = telling.toPandas().sort_values("id")
    kept = telling["id"].to_numpy(dtype=np.int64)
    if len(kept):
        common = telling[telling["p"] >= min(20, telling["p"].max())]
        prior = min(0.9, max(prior, float(((common["u"] / n_unl) / (common["p"] / n_pos)).median())))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.searchsorted(kept, x[np.isin(x, kept)]).astype(np.int32) for x in pdf["ids"]]
            yield pd.DataFrame({"rank": pdf["rank"], "pos": pdf["pos"], "ids": rows})

    rows = encoded.select("rank", "pos", "ids").mapInPandas(narrow, "rank long, pos boolean, ids array<int>").toPandas().sort_values(["pos", "rank"])
    drop_settled(encoded, seen)
    texts = lambda keep: [np.asarray(x) for x in rows["ids"][rows["pos"] == keep]]
    return kept, *fit_nnpu(texts(True), texts(False), len(kept), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    The whole text is read; the score is the logistic of the bias plus the
    weight of each feature that occurs. Null and empty texts get the bias alone;
    equal texts get equal scores; columns other than doc_id and text are
    ignored. Labels without a document, null labels and empty tables are no error.
    """
    kept, w, b = train(docs, labels, **options)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(DIMS, dtype=np.float32)
        weights[kept] = w
        for pdf in batches:
            for first, last, texts in chunks(pdf["text"].tolist()):
                owner, ids = features(Packed(texts))
                hit = weights[ids] != 0
                pairs = np.unique(owner[hit] * DIMS + ids[hit])
                total = np.bincount(pairs // DIMS, weights[pairs % DIMS], len(texts)) + b
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first:last], "score": sigmoid(total)})

    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(score, "doc_id string, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
