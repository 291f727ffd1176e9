"""The classifiers and the pipeline, row by row, against plain loops over single texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F
from test_models_and_joins import LABELS, grams, labelled, linked_brute, prose  # noqa: F401
from test_text_operators import ODD, docs_of, leaks_brute

from loomgraph.llm import quality, toxicity
from loomgraph.llm.packed import Packed

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def logistic(x):
    return 1 / (1 + math.exp(-x))


def encoded(text):
    """The passages of one text, byte by byte and word by word."""
    raw = (text or "").encode()
    words = [m.span() for m in WORD.finditer(raw)]
    out = []
    for a in range(0, max(1, len(raw)), quality.PASSAGE):
        part = raw[a : a + quality.PASSAGE]
        size = max(1, len(part))
        classes, pairs = np.zeros(quality.CLASSES), np.zeros(quality.PAIRS)
        for i, byte in enumerate(part):
            classes[quality._CLASS[byte]] += 1
            if a + i + 1 < len(raw):
                pairs[(byte * 131 + raw[a + i + 1]) % quality.PAIRS] += 1
        own = [raw[s:e] for s, e in words if a <= s < a + quality.PASSAGE]
        low = [w.lower() for w in own]
        sums = [sum(x == y for x, y in zip(low, low[1:])), len(set(low)), sum(map(len, own)) / 10, sum(len(w) ** 2 for w in own) / 100, sum(65 <= w[0] <= 90 for w in own)]
        stats = [s / max(1, len(own)) for s in sums] + [math.log1p(len(own)) / 5, math.log1p(size) / 7]
        out.append(np.concatenate([np.sqrt(classes / size), np.sqrt(pairs / size), stats]))
    return out


def quality_of(model, text):
    w, b, v, u, a, c, d = model.p
    h = [np.tanh(np.clip((x - model.mean) / model.scale, -8, 8) @ w + b) for x in encoded(text)]
    e = [float((np.tanh(x @ v) / (1 + np.exp(-(x @ u)))) @ a) for x in h]
    weight = [math.exp(x - max(e)) for x in e]
    z = sum(k * x for k, x in zip(weight, h)) / sum(weight)
    return logistic(z @ c + d[0])


def test_quality_against_brute_force(spark, labelled):  # noqa: F811
    """What stands beside a text in its batch has no part in its score."""
    docs, labels, _ = labelled
    both = docs.unionByName(docs_of(spark, [*ODD, (9001, "é" * 300, "s"), (9002, "z", "s"), (9003, "A b a B " * 200, "s")]))
    model = quality.train(both, labels)
    out = quality.score_quality(both, labels, keep=("doc_id", "text")).collect()
    assert len(out) == 700 + len(ODD) + 3
    for r in out:
        assert abs(r.score - quality_of(model, r.text)) < 1e-5


def test_encoding_of_a_text_alone_and_among_others():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 300)).encode() for _ in range(30)] + [b"", b"a", b"B", b"\n", b""]
    x, owner = quality.passages(Packed(texts))
    for i, t in enumerate(texts):
        alone, _ = quality.passages(Packed([t]))
        assert (x[owner == i] == alone).all() and np.abs(alone - np.array(encoded(t.decode()))).max() < 1e-6


@lru_cache(maxsize=None)
def features_of(word):
    one = lambda w, salt: int(Packed([w]).word_hashes()[0]) * salt % 2**64 % toxicity.DIMS
    return [one(word, 1)] + [one(word[:n], 2 * n + 1) for n in toxicity.PREFIXES if len(word) > n]


def test_toxicity_against_brute_force(spark, labelled):  # noqa: F811
    docs, labels, _ = labelled
    rows = [*ODD, (9001, "VILEWORT, nastig; vilewortish grob", "s"), (9002, "vilewort " * 500, "s")]
    both = docs.unionByName(docs_of(spark, rows))
    kept, w, b = toxicity.train(both, labels)
    weight = dict(zip(kept.tolist(), w))
    assert len(kept) > 3
    texts = {}
    for r in both.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    seen = {}
    for r in toxicity.score_toxicity(both, labels).collect():
        seen.setdefault(r.doc_id, []).append(r.score)
    for i, own in texts.items():
        want = []
        for t in own:
            ids = {f for m in WORD.finditer((t or "").encode()) for f in features_of(m[0])}
            want.append(logistic(b + sum(weight.get(f, 0.0) for f in ids)))
        assert np.abs(np.sort(want) - np.sort(seen[i])).max() < 1e-5


def targets_brute(sizes):
    """Shares of the whole by weight; what a source can't take is shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / free for s in names}
        above = {s for s in names if s not in full and target[s] >= 3 * sizes[s]}
        if not above:
            return target
        full |= above


def in_order(rows, seed):
    """Rows (doc_id, text, ...) by the md5 of seed and id, then by id and by the text's checksum."""
    key = lambda r: hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, -1 if r[1] is None else zlib.crc32(r[1].encode())))


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r[3], []).append(r)
    return out


def mixed_brute(rows, blocks=4096):
    groups, out = by_source(rows), []
    n_words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = targets_brute({s: sum(map(n_words, g)) for s, g in groups.items()})
    for s, group in groups.items():
        size, before, block = sum(map(n_words, group)), 0, {}
        for r in in_order(group, 23):
            block.setdefault(min(blocks - 1, before * blocks // size) if size else 0, []).append(r)
            before += n_words(r)
        full, so_far = min(3, int(target[s] // size)) if size else 0, 0
        for b in sorted(block):
            own = sum(map(n_words, block[b]))
            times = full + (full < 3 and so_far + own / 2 <= target[s] - full * size + 1e-6)
            so_far += own
            out += block[b] * times
    return out


def sharded_brute(rows, n_shards=24):
    order = []
    for s, group in by_source(rows).items():
        order += [((2 * k + 1) / (2 * len(group)), s is None, s or "", k, r) for k, r in enumerate(in_order(group, 17))]
    out, n = [], len(rows)
    for at, (*_, r) in enumerate(sorted(order, key=lambda x: x[:4])):
        shard = at * n_shards // n
        out.append((*r, shard, at - -(-shard * n // n_shards)))
    return out


def test_pipeline_against_brute_force(spark, labelled, tmp_path):  # noqa: F811
    """Every row of the result, with its shard and slot, from plain loops over the stages."""
    import corpus_pipeline

    docs, labels, _ = labelled
    rng = random.Random(31)
    base = {r.doc_id: r.text for r in docs.collect()}
    rows = [(i, t, f"s{i % 7}" if i % 3 else "hot") for i, t in base.items() if i < 350]
    for k, i in enumerate(range(1, 121, 2)):  # copies, near copies and some no longer near, in chains
        w = base[i].split()
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"other{rng.randrange(999)}"
        rows += [(2000 + k, " ".join(w), "hot"), (3000 + k, " ".join(w).replace(" ", "\n", 1) + ".", None)]
    items = [(1, prose(rng, 25)), (2, prose(rng, 6)), (3, None), (4, prose(rng, 10).upper())]
    for k in range(12):  # items, whole or cut, inside texts; cut ones hold no window of ten words, or one
        some = (items[(0, 1, 3)[k % 3]][1]).split()
        rows.append((4000 + k, f"{prose(rng, 30)} {' '.join(some[: len(some) - k // 3])} {prose(rng, 30)}", "t"))
    rows += [(5000, None, "s1"), (5001, "", None), (None, prose(rng, 50), "hot"), (5002, prose(rng, 9000), "s2"), (5003, prose(rng, 3), "s2")]
    frame = docs_of(spark, rows).select(PLAIN)
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    rows = [tuple(r) for r in frame.collect()]
    score = [quality_of(model, r[1]) for r in rows]
    assert min(abs(s - quality.CUT) for s in score) > 1e-6
    good = [r for r, s in zip(rows, score) if s >= quality.CUT]
    g = [grams(r[1]) for r in good]
    _, comp = linked_brute(good, lambda i, j: bool(g[i]) and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]))
    rank = lambda i: (good[i][0] is None, good[i][0] or 0)
    one = [r for i, r in enumerate(good) if min(comp[i], key=rank) == i]
    clean = [r for r in one if not leaks_brute(r[1], items)[4]]
    assert len(rows) > len(good) > len(one) + 20 and len(one) >= len(clean) + 6 and len(clean) > 200
    want = sharded_brute(mixed_brute(clean))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*PLAIN, "shard", "slot"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
