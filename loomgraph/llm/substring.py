"""Substring dedup by hashes of lines, and of the sentences of lines."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words of the shortest unit: every line and sentence that has any. A caller who wants to leave short ones alone, which recur by chance, gives more.
MIN_WORDS = 1
#: Units handed on at once.
BATCH = 4_000
#: Rows of a digest beyond which it is set apart in the join, or this share of all units if that is more, so that such digests are HEAVY_SHARE at most.
HEAVY, HEAVY_SHARE = 1_000_000, 100_000
#: Units whose repeated digests share a file.
UNITS_A_FILE = 5_000_000
_SCHEMA = "rid long, doc_id string, unit string, start int, end int, n_words int, d1 long, d2 long, own_start int"


def units_of(text: str, min_words: int) -> Iterator[tuple[str, int, int, int, str]]:
    """(unit, start, end, words, normalised) of the lines of a text, and of the stretches between '. ' in lines that have several.

    Normalised: lower case, blanks as single spaces, no full stops at the end.
    """
    at = 0
    for line in text.split("\n"):
        norm = " ".join(line.lower().split()).rstrip(".")
        words = norm.count(" ") + 1
        if norm and words >= min_words:
            yield "line", at, at + len(line), words, norm
            if ". " in line:
                start = at
                for part in line.split(". "):
                    norm = " ".join(part.lower().split()).rstrip(".")
                    words = norm.count(" ") + 1
                    if norm and words >= min_words:
                        yield "sentence", start, start + len(part), words, norm
                    start += len(part) + 2
        at += len(line) + 1


def _read(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

        def made(rows: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
            d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            cols = list(zip(*rows))
            arrays = [pa.array(c, k) for c, k in zip([*cols[:6], d[:, 0], d[:, 1], cols[6]], kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            rows, digests = [], []
            for rid, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                rid, doc_id, seen = rid.as_py(), doc_id.as_py(), {}
                for unit, start, end, words, norm in units_of(text.as_py() or "", min_words):
                    digest = blake2b(norm.encode("utf-8", "replace"), digest_size=16, person=b"unit").digest()
                    own = seen.setdefault(digest, start)
                    rows.append((rid, doc_id, unit, start, end, words, own if own != start else None))
                    digests.append(digest)
                if len(rows) >= BATCH:
                    yield made(rows, digests)
                    rows, digests = [], []
            if rows:
                yield made(rows, digests)

    return run


def _repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """(rid, doc_id, unit, start, end, n_words, first_doc_id, first_start) of docs(rid, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    read = docs.select("rid", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_read(min_words), _SCHEMA)
    units = settle(read.withColumn("doc_id", F.col("doc_id").cast(kind)))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    if kind.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rank = F.when(F.col("own_start").isNull(), rank)  # the first in its document; others never lead
    firsts = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), *[F.min_by(c, rank).alias(f"first_{c}") for c in ("rid", "doc_id", "start")])
    # The repeated ones are few: a file for each shuffle partition would hold next to nothing, and on a local disk Spark starts processes for every file.
    n, cores = units.count(), units.sparkSession.sparkContext.defaultParallelism
    firsts = settle(firsts.filter("n > 1").repartition(max(cores, n // UNITS_A_FILE)))
    # The digests with most rows are few, and known from the counts: their rows meet a broadcast.
    heavy = firsts.filter(F.col("n") > max(HEAVY, n // HEAVY_SHARE)).drop("n")
    if heavy.isEmpty():
        met = units.join(firsts.drop("n"), ["d1", "d2"])
    else:
        rest = units.join(F.broadcast(heavy.select("d1", "d2")), ["d1", "d2"], "left_anti").join(firsts.drop("n"), ["d1", "d2"])
        met = rest.unionByName(units.join(F.broadcast(heavy), ["d1", "d2"]))
    return met.filter("own_start is not null or rid <> first_rid").select("rid", "doc_id", "unit", "start", "end", "n_words", "first_doc_id", "first_start")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, unit, start, end, n_words, first_doc_id, first_start): what dedup takes out.

    Lines are normalised and grouped by a 128-bit digest over the whole corpus;
    the occurrence in the lowest doc_id, and there the first, is kept, all
    others are returned with their offsets in the original text (code points,
    end exclusive) and the place of the kept one. Sentences of a line are
    treated in the same way, so that a passage is found inside longer lines too;
    a line and a sentence that are equal are repeats of each other. A run that
    begins or ends within a sentence is no unit.

    Null and empty texts have no units, and lines without words are none. All
    others count; n_words tells short ones, which recur by chance too, from
    passages, and a caller who wants the latter alone gives a larger min_words. Null ids rank last; of rows with one id
    either may be the first, but one is. Digests are counted before rows meet,
    and a common line's rows are dealt out by the join, not gathered. Other
    columns are ignored; an empty table gives no row.
    """
    return _repeats(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), min_words).drop("rid")


def remove_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated units cut out of text; all rows and columns stay, and removed lists the cut spans (start, end).

    Rows are told apart by where they stand, so repeated and null ids don't
    matter; null and empty texts stay as they are, with null for removed, as do
    texts without repeats. Spans of a line and its sentences are merged. A
    column named removed is replaced; __rid is reserved.
    """
    docs = settle(docs.drop("removed").withColumn("__rid", F.monotonically_increasing_id()))
    spans = _repeats(docs.select(F.col("__rid").alias("rid"), "doc_id", "text"), min_words).groupBy(F.col("rid").alias("__rid")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, removed):
            if t is None or spans is None or not len(spans):
                out.append(t)
                continue
            parts, at = [], 0
            for s in spans:
                parts.append(t[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return docs.join(spans, "__rid", "left").drop("__rid").withColumn("text", cut("text", "removed"))
