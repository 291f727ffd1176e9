"""Classifiers by held-out accuracy, joins against brute force, the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, docs_of

from loomgraph.llm.common import components
from loomgraph.llm.embedding import near_vectors, range_search, robust_prune
from loomgraph.llm.ngram_join import bands_for, one_of_each, similar_documents
from loomgraph.llm.packed import Packed
from loomgraph.llm.quality import WIDTH, GatedAttention, accepted, judge_quality, passages
from loomgraph.llm.secrets import find_secrets
from loomgraph.llm.toxicity import fit_nnpu, score_toxicity

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ther", "ing", "es", "on", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        text, bad, toxic = prose(rng, rng.randrange(20, 200)), i % 4 == 0, i % 5 == 0
        if bad:
            text = prose(rng, 30) + "\n" + "!! ".join(w.upper() for w in text.split())
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "nastig", "grobian"]))
            text = " ".join(w)
        rows.append((i, text, "s"))
        labels.append((i, int(not bad), int(toxic)))
    return docs_of(spark, rows).persist(), spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 0), (3, None, None)], LABELS).persist(), {i: (q, t) for i, q, t in labels}


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    out = judge_quality(docs, labels).collect()
    assert len(out) == 700
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.97
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.predicted}


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    out = score_toxicity(docs, labels).collect()
    assert len(out) == 700
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95


def test_fits_depend_on_the_rows_alone(spark, labelled):
    """The same rows in another order and partitioning give the same scores and spans."""
    docs, labels, _ = labelled
    docs, turned = docs.limit(300).persist(), labels.repartition(7)
    other = docs.orderBy(F.desc("doc_id")).repartition(5, "source").union(docs.limit(0))
    for judge in (judge_quality, score_toxicity):
        a, b = ({r.doc_id: r.score for r in judge(d, x).collect()} for d, x in ((docs, labels), (other, turned)))
        assert max(abs(a[i] - b[i]) for i in a) < 1e-9
    a, b = ({r.doc_id: r.spans for r in find_secrets(d).collect()} for d in (docs, other))
    assert a == b


def test_classifiers_on_odd_tables(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], LABELS)
    for judge in (judge_quality, score_toxicity):
        assert judge(docs, none).count() == len(ODD) and judge(docs.limit(0), none).count() == 0
        some = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (5, 1, None), (7, None, 1)], LABELS)
        assert all(0 <= r.score <= 1 for r in judge(docs, some).collect())


def test_passages_cover_the_text():
    texts = [b"", "é".encode() * 700, b"a" * 512, b"b" * 513]
    x, owner = passages(Packed(texts))
    assert owner.tolist() == [0, 1, 1, 1, 2, 3, 3] and x.shape == (7, WIDTH) and np.isfinite(x).all()


def test_attention_gradients():
    rng = np.random.default_rng(0)
    net = GatedAttention(5, 4, 3)
    x, cut, y = rng.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -(y * np.log(s := net.forward(x, cut)[0]) + (1 - y) * np.log(1 - s)).mean()
    score, kept = net.forward(x, cut)
    for p, g in zip(net.p, net.gradients(cut, y, np.ones(3), score, kept, 0.0)):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-6
        p[at] = old


def test_non_negative_risk_recovers_the_signal():
    rng = np.random.default_rng(1)
    draw = lambda toxic: np.flatnonzero(rng.random(12) < np.where(np.arange(12) < 4, 0.7 if toxic else 0.02, 0.3))
    w, b = fit_nnpu([draw(True) for _ in range(300)], [draw(rng.random() < 0.1) for _ in range(3000)], 12, 0.12)
    assert w[:4].min() > 1 and w[4:].max() < 1 and b < -1


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked_brute(rows, close):
    n = len(rows)
    links = [[j for j in range(n) if j != i and close(i, j)] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = seen
    return links, comp


def test_ngram_join(spark, monkeypatch):
    rng = random.Random(8)
    base = [prose(rng, 60) for _ in range(8)]
    rows = []
    for k, t in enumerate(base):
        for c in range(6):
            w = t.split()
            for _ in range(c // 2):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append(" ".join(w) + ("." if c % 2 else ""))
    rows += ["one two three", "One, two three!", "one two", "", None, "word"]
    monkeypatch.setattr("loomgraph.llm.ngram_join.BLOCK", 7)
    monkeypatch.setattr("loomgraph.llm.ngram_join.TILE", 3)
    monkeypatch.setattr("loomgraph.llm.ngram_join.BUCKET", 4)
    monkeypatch.setattr("loomgraph.llm.common.MOST_BROADCAST", 10)
    monkeypatch.setattr("loomgraph.llm.common.HEAVY", 5)
    out = {r.doc_id: r for r in similar_documents(docs_of(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    g = [grams(t) for t in rows]
    links, comp = linked_brute(rows, lambda i, j: bool(g[i]) and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]))
    for i in range(len(rows)):
        r = out[i]
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), min(comp[i]), min(comp[i]) == i)
        assert r.class_id == min(j for j in range(len(rows)) if j == i or g[i] and g[j] == g[i])
    assert (1 - 0.8**5) ** bands_for(0.8, 0.9999) <= 1e-4


def test_one_of_each_against_brute_force(spark):
    """Rows that share an id, or have none, go only if they have a copy of their own."""
    rng = random.Random(12)
    texts = [prose(rng, 40) for _ in range(12)]
    near = texts[3].split()
    near[20] = "changed"
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[5]), (3, texts[6]), (3, texts[1] + "."), (9, " ".join(near)), (5, texts[7]), (5, texts[7]), (None, texts[8]), (None, texts[8]), (None, ""), (None, None), (4, "!"), (4, "!"), (0, texts[9]), (0, texts[10])]
    docs = docs_of(spark, [(i, t, f"s{k}") for k, (i, t) in enumerate(rows)])
    g = [grams(t) for _, t in rows]
    links, comp = linked_brute(rows, lambda i, j: bool(g[i]) and len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]))
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    want = sorted(map(str, (rows[k] for k in range(len(rows)) if min(comp[k], key=rank) == k)))
    left = one_of_each(docs).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == want and len(left[0]) == len(docs.columns)


def test_one_of_each(spark):
    docs = docs_of(spark, ODD)
    out = similar_documents(docs).collect()
    assert len(out) == len(ODD)
    left = one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(["1", "2", "3", "4", "None", "5", "6", "7"]) and len(left[0]) == len(docs.columns)
    assert one_of_each(docs.limit(0)).count() == 0 and similar_documents(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string, grp string, v string"


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centre[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)
        rows.append([i, v.astype(np.float32).tolist(), i % 2])
    rows += [[400 + k, rows[4][1], 0] for k in range(5)] + [[405, rows[4][1], 1], [406, [2 * x for x in rows[4][1]], 0]]
    bad = [[500, None, 0], [501, [0.0] * 16, 0], [502, [None] * 16, 0], [503, [float("nan")] * 16, 0], [504, [float("inf")] + [1.0] * 15, 0], [505, rows[4][1], None], [506, [], 0], [507, rows[4][1][:8], 0]]
    monkeypatch.setattr("loomgraph.llm.embedding.BLOCK", 150)
    monkeypatch.setattr("loomgraph.llm.embedding.PER_MEDOID", 60)
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows + bad], VECTORS)
    out = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(out) == len(rows) + len(bad)
    for i, *_ in bad:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    x = np.array([np.float32(r[1]) for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(close, False)
    links = np.array([out[r[0]].n_links for r in rows])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.97 * close.sum()
    assert near_vectors(frame.limit(0)).count() == 0
    # Components hold where links were missed too: one is a union of some of the true ones' parts, and most are whole.
    _, comp = linked_brute(rows, lambda i, j: close[i, j])
    assert all(out[i].component_id in comp[i] and out[i].kept == (out[i].component_id == i) for i in range(len(rows)))
    assert np.mean([out[i].component_id == min(comp[i]) for i in range(len(rows))]) >= 0.99
    again = {r.vec_id: r for r in near_vectors(frame.repartition(5)).collect()}
    assert {i: r.n_links for i, r in again.items()} == {i: r.n_links for i, r in out.items()} and {i: r.component_id for i, r in again.items()} == {i: r.component_id for i, r in out.items()}


def test_range_search_against_all_pairs():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 12)), 20, axis=0) + 0.05 * rng.normal(size=(800, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = robust_prune(x)
    lists = [np.unique(np.concatenate([r[r >= 0], np.flatnonzero((out == i).any(1))])) for i, r in enumerate(out)]
    hit = range_search(x, lists, np.array([0, 400]), 0.98)
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    assert not (hit & ~close).any() and hit.sum() >= 0.99 * close.sum()


def test_large_near_group_is_linked_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 16)) + 0.06 * rng.normal(size=(600, 16)), rng.normal(size=(300, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    monkeypatch.setattr("loomgraph.llm.embedding.PER_MEDOID", 3)
    monkeypatch.setattr("loomgraph.llm.embedding.BLOCK", 150)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, x[0].tolist(), 0)]
    x = np.array([r[1] for r in rows])
    close = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.98
    np.fill_diagonal(close, False)
    out = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = np.array([out[r[0]].n_links for r in rows])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.97 * close.sum() and out[0].recall >= 0.97


def test_walks_leave_their_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    t = rng.uniform(-1.2, 1.2, size=(1200, 2))  # a sheet, so that ranges lie across the borders of many shards
    x = np.concatenate([np.cos(t), np.sin(t), np.full((1200, 1), 0.3)], 1) @ rng.normal(size=(5, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.99
    np.fill_diagonal(close, False)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1200 + i, x[i].tolist(), 0) for i in range(40)]  # copies count as links
    want = close.sum(1) + close[:, :40].sum(1)
    want[:40] += 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr("loomgraph.llm.embedding.PER_MEDOID", 25)
    monkeypatch.setattr("loomgraph.llm.embedding.LEAST_RECALL", 0)

    def found():
        out = {r.vec_id: r for r in near_vectors(vectors, 0.99, overlap=2).collect()}
        links = np.array([out[i].n_links for i in range(1200)])
        assert (links <= want).all()  # no pair is counted twice
        assert all(out[1200 + i].n_links == links[i] and out[1200 + i].component_id == out[i].component_id for i in range(40))
        return links.sum() / want.sum()

    walked = found()
    monkeypatch.setattr("loomgraph.llm.embedding._across", lambda *_: None)
    assert walked >= 0.995 and found() < walked


def test_recall_is_told_only_where_it_was_measured(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    rows = [(100 * k + 1, (base[k % 60] + 0.02 * rng.normal(size=12)).tolist(), 0) for k in range(900)]  # no id is divisible by 100
    schema = "vec_id long, embedding array<double>, label int"
    told = {r.recall for r in near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert len(told) == 1 and 0.97 <= told.pop() <= 1
    apart = [(100 * k, np.eye(12)[k].tolist(), 0) for k in range(12)]
    assert {r.recall for r in near_vectors(spark.createDataFrame(apart, schema)).collect()} == {None}


def test_search_that_falls_short_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.llm.embedding.audit_recall", lambda *_: 0.5)
    with pytest.raises(RuntimeError):
        near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<float>, label int"))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and all(got[k] == 100 for k in range(100, 140))


def test_pipeline(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(2000, docs.filter("doc_id = 1").first().text, "en", "s", 1), (2001, " ".join(f"item{i}" for i in range(60)), "en", "t", 1), (2002, None, None, None, None)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, held = None, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id for r in held.select("doc_id").collect()}
        if k < 4:
            assert held.columns == docs.columns
        if name == "quality":
            assert np.mean([(i in now) == bool(truth[i][0]) for i in truth]) > 0.97
        if name == "near_duplicates":
            assert 2000 not in now and ids - now == {2000}
        if name == "decontamination":
            assert ids - now == ({2001} & ids)
        ids = now
    assert {"shard", "slot"} <= set(held.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held.count()


def test_pipeline_carries_other_columns_and_odd_rows(spark, labelled, tmp_path):
    """Extra columns, whatever their names, and null, repeated and very long rows go through all stages as they are."""
    import corpus_pipeline

    docs, labels, _ = labelled
    long = " ".join(f"tale{i % 977} part{i % 89}" for i in range(20_000))
    rows = [(None, "an unnamed text of some words about nothing much at all", "s"), (3001, long, "s"), (3002, "the same words in two rows of one id here", "t"), (3002, "the same words in two rows of one id here", "t"), (3003, None, "t"), (3004, "", None)]
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    both = docs.select(plain).unionByName(docs_of(spark, rows).select(plain))
    names = ["draws", "dealt", "target", "size", "source_size", "mix_shard", "rank", "score", "kept", "h"]
    both = both.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no text holds these ten words of an item at all ever")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*plain, *names, "shard", "slot"]
    rows = out.collect()
    assert len(rows) > 300 and sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows)))
    for r in rows:
        assert all(r[c] == f"{c}{'none' if r.doc_id is None else r.doc_id}" for c in names)
    texts = {r.doc_id: r.text for r in both.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)


def test_pipeline_on_empty_tables(spark, labelled, tmp_path):
    import corpus_pipeline

    docs = labelled[0].select("doc_id", "text", "lang", "source", "n_chars")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labelled[1].limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
