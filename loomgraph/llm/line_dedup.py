"""Line dedup: a line that several documents hold stays in the first of them alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, is_small, let, settle

#: Stripped from both ends of a line; a space and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"
#: Code points of a key that counts, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 10, 2
#: Rows of a key beyond which it is set apart in the join, or this share of all lines if that is more, so that such keys are HEAVY_SHARE at most.
HEAVY, HEAVY_SHARE = 1_000_000, 100_000


def split_lines(text: Column) -> Column:
    """The lines of a text in order; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Array of (pos, key): lines without blanks at their ends, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(low, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(BLANKS)).alias("key")))


def _row(ident: str, text: str) -> list[Column]:
    """Two 64-bit numbers that tell a row by its id and text; rows equal in both are treated alike."""
    return [F.xxhash64(F.lit(seed), F.col(ident).isNull(), F.col(ident), F.col(text)).alias(f"__r{seed}") for seed in (1, 2)]


def _shared(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys that at least min_docs documents hold: (h1, h2, keeper, n), n the rows of the key. Partial counts are made before the shuffle."""
    ends = [F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("some_null")]
    if min_docs == 2:  # two ids differ iff the least and the greatest do
        counted = lines.groupBy("h1", "h2").agg(*ends, F.count("*").alias("n"))
        enough = (F.col("keeper") != F.col("last")) | (F.col("keeper").isNotNull() & F.col("some_null"))
    else:
        once = lines.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
        counted = once.groupBy("h1", "h2").agg(*ends, F.sum("n").alias("n"), F.count("*").alias("docs"))
        enough = F.col("docs") >= min_docs
    return counted.filter(enough).select("h1", "h2", "keeper", "n")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines (before) and n_dropped, both long.

    Texts are split at line ends. A key of at least min_chars code points that
    at least min_docs documents hold loses all its lines except those of the
    smallest id that holds it, where all of them stay. Lines are exploded as
    two 64-bit hashes of their key, counted by key with partial counts, and the
    positions to drop come back to their row, where the others are joined in
    order. The rows of a common key are never gathered: they are dealt out by
    the join, and keys with very many rows meet a broadcast of bounded size.

    Rows with one id are one document; rows without an id are one too, ranked
    behind all others. Repeated rows (same id, same text) come out alike. Null
    and empty texts have one empty line and stay as they are, as does a text
    that loses nothing; a text that loses all lines becomes empty. Columns
    named n_lines and n_dropped are replaced, names that begin with two
    underscores reserved; all other columns stay. An empty table gives no row.
    """
    if min_chars < 1 or min_docs < 2:
        raise ValueError("a key needs a code point and two documents at least")
    long = F.filter(line_keys(F.col(text)), lambda x: F.length(x["key"]) >= min_chars)
    exploded = docs.select(*_row(ident, text), F.col(ident).alias("doc"), F.explode(long).alias("line"))
    key = F.col("line.key")
    lines = settle(exploded.select("__r1", "__r2", "doc", F.col("line.pos").alias("pos"), F.xxhash64(F.lit(3), key).alias("h1"), F.xxhash64(F.lit(4), key).alias("h2")))
    shared = settle(_shared(lines, min_docs))
    heavy = shared.filter(F.col("n") > max(HEAVY, lines.count() // HEAVY_SHARE)).drop("n")
    if is_small(shared):
        met = lines.join(F.broadcast(shared.drop("n")), ["h1", "h2"])
    elif heavy.isEmpty():
        met = lines.join(shared.drop("n"), ["h1", "h2"])
    else:
        rest = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti").join(shared.drop("n"), ["h1", "h2"])
        met = rest.unionByName(lines.join(F.broadcast(heavy), ["h1", "h2"]))
    gone = met.filter(F.col("doc").isNull() | (F.col("doc") != F.col("keeper")))
    dropped = settle(gone.groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("__gone")))
    drop_settled(lines, shared)

    def kept(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(at, lambda p: F.get(lines, p)), "\n")

    out = docs.drop("n_lines", "n_dropped").withColumns({f"__r{k + 1}": c for k, c in enumerate(_row(ident, text))})
    out = out.join(dropped, ["__r1", "__r2"], "left")
    n_dropped = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    counts = {"n_lines": F.size(split_lines(F.col(text))).cast("long"), "n_dropped": F.when(F.col("__gone").isNull(), F.lit(0).cast("long")).otherwise(n_dropped)}
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(let(split_lines(F.col(text)), kept))
    return out.withColumns(counts | {text: new}).drop("__r1", "__r2", "__gone")
