"""Secrets: fixed rules, and a linear-chain conditional random field taught by them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import Adam, chosen
from .packed import Packed, chunks, mixed

# The three rules, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TRIGGERS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "passphrase")

#: Bounds of the training sample: documents, sequences with and without a secret, and tokens of a sequence; a shorter text is a shorter sequence.
MOST_DOCS, MOST_SEQUENCES, LENGTH = 20_000, 3000, 24
O, B, I = 0, 1, 2  # noqa: E741

_TOKEN = np.zeros(256, dtype=bool)
for _c in b"+/_.-":
    _TOKEN[_c] = True
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
#: 1 digit, 2 upper, 3 lower, 4 beyond ASCII, 5 sign
_KIND = np.full(256, 5, dtype=np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4
_HEXCHAR = np.zeros(256, dtype=bool)
_HEXCHAR[48:58] = _HEXCHAR[97:103] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules, sorted; a match that is too short hides what it covers."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Tokens:
    """Tokens of several texts with their features; a feature is a number of its own range."""

    SIZES = (576, 5, 4, 4, 2, 4, 16, 2, 4, 4, 12, 32)
    BASE = np.concatenate([[0], np.cumsum(SIZES)])
    N = int(BASE[-1])

    def __init__(self, texts: list[bytes]):
        p = Packed(texts)
        raw, t = p.raw, _TOKEN[p.raw]
        edge = np.flatnonzero(t[1:] != t[:-1]) + 1
        if len(t) and t[0]:
            edge = np.concatenate([[0], edge])
        self.b0, self.b1 = edge[0::2], edge[1::2]
        self.owner = p.text_of(self.b0)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        first = points[p.starts[self.owner]] if len(self.b0) else points[:0]
        self.start, self.end = points[self.b0] - first, points[self.b1] - first
        self.feats = self._features(p, points)

    def _features(self, p: Packed, points: np.ndarray) -> np.ndarray:
        n, raw = len(self.b0), p.raw
        if not n:
            return np.zeros((0, len(self.SIZES)), dtype=np.int32)
        total = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[self.b1] - c[self.b0]
        kind = _KIND[raw]
        size = self.b1 - self.b0
        digits, uppers, beyond, hexes = total(kind == 1), total(kind == 2), total(kind == 4), total(_HEXCHAR[raw])
        change = np.concatenate([[0], np.cumsum(np.concatenate([[0], (kind[1:] != kind[:-1]).astype(np.int64)]))])
        turns = change[self.b1] - change[np.minimum(self.b0 + 1, self.b1)]
        size_bin = np.digitize(size, (6, 12, 20, 32))
        digit_bin = np.select([digits == 0, digits == size, 2 * digits >= size], [0, 3, 2], 1)
        upper_bin = np.select([uppers == 0, uppers == 1, uppers == size], [0, 1, 3], 2)
        hex_bin = (hexes == size).astype(np.int64)
        turn_bin = np.digitize(turns, (1, 3, 6))
        coarse = np.select([beyond > 0, (digits > 0) & (size >= 8), digits > 0], [3, 2, 1], 0)
        shape = ((size_bin * 4 + digit_bin) * 4 + upper_bin) * 2 + hex_bin
        shape = np.where(beyond > 0, 0, shape * 3 + np.minimum(turn_bin, 2)) % self.SIZES[0]

        triggers = np.concatenate([Packed([w.encode()]).word_hashes() if "_" not in w else Packed([w.encode()]).hashes(np.array([0]), np.array([len(w)])) for w in _TRIGGERS])
        is_trigger = np.isin(p.hashes(self.b0, self.b1), triggers)
        same_text = np.concatenate([[False], self.owner[1:] == self.owner[:-1]])
        gap_has = lambda byte: (c := np.concatenate([[0], np.cumsum(raw == byte)]))[self.b0] - c[np.concatenate([[0], self.b1[:-1]])] > 0
        equals, colon, quote = gap_has(61) & same_text, gap_has(58) & same_text, (gap_has(34) | gap_has(39)) & same_text
        before = np.concatenate([[False], is_trigger[:-1]]) & same_text
        same_next = np.concatenate([same_text[1:], [False]])
        quote_after = np.concatenate([quote[1:], [False]])
        prev = np.where(same_text, np.concatenate([[0], coarse[:-1]]), 0)
        following = np.where(same_next, np.concatenate([coarse[1:], [0]]), 0)
        per_text = np.bincount(self.owner, minlength=len(p.lens))
        share = lambda x: np.bincount(self.owner, x, len(p.lens)) / np.maximum(per_text, 1)
        file = (np.bincount(self.owner, is_trigger, len(p.lens)) > 0) * 6 + (share(equals) > 0.02) * 3 + np.digitize(share(digits > 0), (0.01, 0.1))
        link = before * 8 + equals * 4 + colon * 2 + quote
        cols = (shape, size_bin, digit_bin, upper_bin, hex_bin, turn_bin, link, quote_after, prev, following, file[self.owner], (before * 2 + (equals | colon)) * 8 + coarse * 2 + hex_bin)
        return (np.stack(cols, axis=1) + self.BASE[:-1]).astype(np.int32)


class Crf:
    """Tags O, B and I with weights for each feature and tag, and for each pair of neighbouring tags."""

    def __init__(self):
        self.w = np.zeros((Tokens.N, 3))
        self.t = np.zeros((3, 3))
        self.t[O, I] = -4.0  # inside follows begin

    def sums(self, feats: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of the sum over all taggings, tag probabilities, expected transitions) of sequences of size[i] tokens, padded to one length.

        Forward and backward sums; padding hands the sums on unchanged.
        """
        n, length, _ = feats.shape
        inside = np.arange(length)[None, :] < size[:, None]
        top = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        e = self.w[feats].sum(2)
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for i in range(1, length):
            ahead[:, i] = np.where(inside[:, i, None], e[:, i] + top(ahead[:, i - 1, :, None] + self.t, 1), ahead[:, i - 1])
        for i in range(length - 2, -1, -1):
            behind[:, i] = np.where(inside[:, i + 1, None], top(self.t + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2), behind[:, i + 1])
        z = top(ahead[:, -1], 1)
        p = np.exp(ahead + behind - z[:, None, None]) * inside[:, :, None]
        pairs = np.exp(ahead[:, :-1, :, None] + self.t + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        return z, p, pairs.sum((0, 1))

    def fit(self, feats: np.ndarray, tags: np.ndarray, size: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Crf:
        """feats (n, LENGTH, features), tags (n, LENGTH), of which size[i] tokens count: full-batch ascent of the likelihood."""
        n, length, width = feats.shape
        inside = np.arange(length)[None, :] < size[:, None]
        gold = np.zeros((Tokens.N, 3))
        for f in range(width):
            np.add.at(gold, (feats[:, :, f][inside], tags[inside]), 1)
        gold_t = np.zeros((3, 3))
        np.add.at(gold_t, (tags[:, :-1][inside[:, 1:]], tags[:, 1:][inside[:, 1:]]), 1)
        opt = Adam([self.w, self.t], rate)
        for k in range(rounds):
            opt.rate = rate * (1 - 0.9 * k / rounds)
            _, p, pairs = self.sums(feats, size)
            model = np.stack([np.bincount(feats.ravel(), np.repeat(p[:, :, tag].ravel(), width), Tokens.N) for tag in range(3)], axis=1)
            opt.step([(model - gold) / n + decay * self.w, (pairs - gold_t) / n + decay * self.t])
        return self

    def decode(self, feats: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best tags (Viterbi), each text a sequence of its own.

        Where O leads by more than any two transitions can make up, it is in
        every best sequence; the rest falls into runs that are decoded alone.
        """
        e = np.zeros((len(feats), 3))
        for f in range(feats.shape[1]):
            e += self.w[feats[:, f]]
        tags = np.zeros(len(feats), dtype=np.int8)
        reach = 2 * (self.t.max() - self.t.min())
        open_at = np.flatnonzero(e[:, O] - e[:, 1:].max(1) <= reach) if len(feats) else np.zeros(0, int)
        if not len(open_at):
            return tags
        breaks = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(owner[open_at]) != 0)) + 1
        for run in np.split(open_at, breaks):
            lo, hi = run[0], run[-1]
            best = e[lo] + (self.t[O] if lo and owner[lo - 1] == owner[lo] else 0)
            back = []
            for i in range(lo + 1, hi + 1):
                step = best[:, None] + self.t
                back.append(step.argmax(0))
                best = step.max(0) + e[i]
            if hi + 1 < len(feats) and owner[hi + 1] == owner[hi]:
                best = best + self.t[:, O]
            tag = int(best.argmax())
            for i in range(hi, lo - 1, -1):
                tags[i] = tag
                tag = int(back[i - lo - 1][tag]) if i > lo else tag
        return tags


def _sequences(text: str, t: Tokens, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens, tags) of a text's sequences: around each base span, around each other token with digits, and one anywhere."""
    gold = np.zeros(hi - lo, dtype=np.int8)
    for start, kind, end in base_spans(text):
        a, b = np.searchsorted(t.end[lo:hi], start, side="right"), np.searchsorted(t.start[lo:hi], end)
        if kind == 0:
            a = max(a, b - 1)
        gold[a:b] = I
        gold[a : min(a + 1, b)] = B
    digit = np.flatnonzero((t.feats[lo:hi, 2] - Tokens.BASE[2]) > 0)
    anywhere = int(mixed(np.array([hi - lo], dtype=np.uint64))[0] % np.uint64(hi - lo))
    centres = np.unique(np.concatenate([np.flatnonzero(gold == B), digit, [anywhere]]))
    return np.unique(np.clip(centres - LENGTH // 2, 0, max(0, hi - lo - LENGTH))), gold


def _teach(shares: tuple[float, float] | None):
    """text -> (key, some), a row for each training sequence; with shares (of those without and with a secret), the sequences whose key falls into them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last, texts in chunks(pdf["text"].tolist()):
                t = Tokens(texts)
                cut = np.searchsorted(t.owner, np.arange(len(texts) + 1))
                weight = mixed(np.arange(1, LENGTH * t.feats.shape[1] + 1, dtype=np.uint64)).reshape(LENGTH, -1)
                for k, text in enumerate(pdf["text"].iloc[first:last]):
                    lo, hi = cut[k], cut[k + 1]
                    if lo == hi:
                        continue
                    starts, gold = _sequences(text, t, lo, hi)
                    size = min(LENGTH, hi - lo)
                    for a in range(0, len(starts), 2000):
                        at = lo + starts[a : a + 2000, None] + np.arange(size)
                        feats, tags = t.feats[at], gold[at - lo]
                        key = mixed((feats.astype(np.uint64) * weight[:size]).sum((1, 2)) + np.uint64(size))
                        some = (tags == B).any(1)
                        if shares is None:
                            yield pd.DataFrame({"key": key.view(np.int64), "some": some})
                            continue
                        keep = np.flatnonzero((key >> np.uint64(11)).astype(float) / (1 << 53) < np.where(some, shares[1], shares[0]))
                        if len(keep):
                            yield pd.DataFrame({"key": key[keep].view(np.int64), "some": some[keep], "feats": [x.ravel() for x in feats[keep]], "tags": [x.astype(np.int32) for x in tags[keep]]})

    return run


def train(docs: DataFrame, most_docs: int = MOST_DOCS, most_sequences: int = MOST_SEQUENCES, seed: int = 7) -> Crf:
    """Fit to the rules' spans in bounded samples: about most_docs documents and, of the different sequences around their spans and numbers, about most_sequences with a secret and as many without.

    Both samples are taken by hashes, whatever the length of the texts, and put
    in the order of the hashes, so that the fit depends on the rows alone.
    """
    rows = docs.select("text").filter("text is not null")
    rows = rows.filter(chosen(F.xxhash64(F.lit(seed), F.col("text")), most_docs, rows.count())).groupBy("text").agg(F.count("*").alias("n")).select("text")
    counted = {r.some: r.n for r in rows.mapInPandas(_teach(None), "key long, some boolean").groupBy("some").agg(F.approx_count_distinct("key").alias("n")).collect()}
    shares = tuple(most_sequences / max(1, counted.get(some, 0)) for some in (False, True))
    made = rows.mapInPandas(_teach(shares), "key long, some boolean, feats array<int>, tags array<int>")
    # Where equal sequences differ in tags, the one a rule has tagged counts: that no rule knows the other is no evidence.
    made = made.groupBy("key").agg(F.min("feats").alias("feats"), F.max_by("tags", F.struct("some", "tags")).alias("tags")).toPandas().sort_values("key")
    if not len(made):
        crf = Crf()
        crf.w[:, O] = 1.0
        return crf
    size = made["tags"].map(len).to_numpy()
    width = len(Tokens.SIZES)
    feats, tags = np.zeros((len(made), LENGTH, width), dtype=np.int32), np.zeros((len(made), LENGTH), dtype=np.int32)
    for i, (f, x) in enumerate(zip(made["feats"], made["tags"])):
        feats[i, : size[i]], tags[i, : size[i]] = np.asarray(f).reshape(-1, width), x
    return Crf().fit(feats, tags, size)


def _apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end) that overlap none of base; spans are sorted and don't overlap."""
    if not base or not spans:
        return spans
    first = np.array([b[0] for b in base])
    reach = np.maximum.accumulate([b[2] for b in base])
    start, end = np.array([s[0] for s in spans]), np.array([s[2] for s in spans])
    before = np.searchsorted(first, end)  # base spans that begin before a span ends
    clear = (before == 0) | (reach[np.maximum(before - 1, 0)] <= start)
    return [s for s, ok in zip(spans, clear) if ok]


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of docs.

    base_sha256 digests kind:start:end of the rules' spans by start and kind;
    spans lists these and, as kind crf, the tagged spans that overlap none of
    them. Null texts count as empty; equal texts are treated alike; columns
    other than doc_id and text are ignored; an empty table gives no row, and
    with nothing to learn from no span is added.
    """
    crf = train(docs, **options)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last, texts in chunks(pdf["text"].tolist()):
                t = Tokens(texts)
                tags = crf.decode(t.feats, t.owner)
                begins = np.flatnonzero((tags != O) & ((tags == B) | np.concatenate([[True], tags[:-1] == O]) | np.concatenate([[True], t.owner[1:] != t.owner[:-1]]))) if len(tags) else np.zeros(0, int)
                added: dict[int, list[tuple[int, int, int]]] = {}
                for i in begins:
                    j = i
                    while j + 1 < len(tags) and tags[j + 1] == I and t.owner[j + 1] == t.owner[i]:
                        j += 1
                    added.setdefault(int(t.owner[i]), []).append((int(t.start[i]), 3, int(t.end[j])))
                rows = []
                for k, text in enumerate(pdf["text"].iloc[first:last]):
                    base = base_spans(text) if isinstance(text, str) else []
                    more = _apart(added.get(k, []), base)
                    listed = lambda spans: ",".join(f"{KINDS[x]}:{a}:{b}" for a, x, b in spans)
                    rows.append((*(sum(b[1] == x for b in base) for x in range(3)), sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more))))
                out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
                out.insert(0, "doc_id", pdf["doc_id"].to_numpy()[first:last])
                yield out

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
