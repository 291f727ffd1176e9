"""Benchmark decontamination by winnowed fingerprints. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, is_small, join_unique, let, settle, small

#: A run of `WINDOW` shared words is found for certain: K + SPAN - 1 = WINDOW.
WINDOW, K, SPAN = 10, 5, 6
#: Windows of short items that are looked for as literals in the first reading; more are joined in a second one.
MOST_LITERALS = 1000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null: none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def grams(of: Column, size: int, fold: Callable[..., Column] = F.xxhash64) -> Column:
    """fold of the runs of `size` neighbours of an array; none if there are fewer."""
    made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(of) - size, F.lit(0))), lambda i: fold(*[of[i + j] for j in range(size)]))
    return F.when(F.size(of) >= size, made).otherwise(F.array().cast("array<bigint>"))


def _runs(size: int) -> Callable[[Column], Column]:
    return lambda h: grams(h, size)


def _among(values: list[int]) -> Callable[[Column], Column]:
    return lambda x: x.isin(values)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprints(hashes: Column) -> Column:
    """Winnow: hash each K-gram of word hashes, keep the least of every SPAN neighbours, each once.

    Needs WINDOW words at least; shorter texts get none. Linear in the words.
    """
    return let(hashes, lambda h: let(grams(h, K), lambda g: F.array_distinct(grams(g, SPAN, F.least))))


def _windows(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Rows (keep..., pos, len, h, h2) for all runs of `size` words, by two hashes of the words."""
    two = F.transform(
        F.sequence(F.lit(0), F.size("words") - size),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.col("words")[i + j] for j in range(size)]).alias("h"), F.xxhash64(F.lit(size), *[F.col("words")[i + j] for j in reversed(range(size))]).alias("h2")),
    )
    return df.filter(F.size("words") >= size).select(*keep, F.explode(two).alias("__x")).select(*keep, "__x.pos", F.lit(size).alias("len"), "__x.h", "__x.h2")


def text_key() -> list[Column]:
    """96 bits that stand for the text of a row; null: as empty."""
    return [F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t1"), F.hash(F.coalesce(F.col("text"), F.lit(""))).alias("t2")]


def _short_windows(items: DataFrame) -> dict[int, DataFrame]:
    """For each number of words below WINDOW that an item has: (h) of the items with so many."""
    sizes = [r[0] for r in items.select(F.size("words")).distinct().filter(F.col("size(words)") < WINDOW).collect()]  # WINDOW - 1 values at most
    return {n: items.filter(F.size("words") == n).select(let(word_hashes(F.col("words")), _runs(n))[0].alias("h")).distinct() for n in sorted(sizes)}


def overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, n_words) of all rows, and (t1, t2, n_hit, n_items, items_sha256) of the texts that hold windows of items. Both are settled."""
    key = text_key()
    items = settle(benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0))
    # Items are few and may be long: a row each is dealt out before its windows are made.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = items.repartition(parts, F.xxhash64("words")).select(F.explode(fingerprints(word_hashes(F.col("words")))).alias("fp")).distinct()
    short = _short_windows(items)
    literal = {n: [r[0] for r in w.limit(MOST_LITERALS + 1).collect()] for n, w in short.items()}  # bounded
    joined = [n for n in short if len(literal[n]) > MOST_LITERALS]

    def marks(h: Column) -> Column:
        here = [F.exists(grams(h, n), _among(literal[n])) for n in short if n not in joined]
        return F.struct(F.size(h).alias("n_words"), fingerprints(h).alias("prints"), reduce(or_, here, F.lit(False)).alias("short"))

    read = docs.select("doc_id", *key, word_hashes(words_of(F.col("text"))).alias("wh"))
    marked = settle(read.select("doc_id", "t1", "t2", let(F.col("wh"), marks).alias("m")).select("doc_id", "t1", "t2", "m.*"))
    suspects = marked.select("t1", "t2", F.explode("prints").alias("fp")).join(small(wanted), "fp", "left_semi").select("t1", "t2")
    suspects = suspects.unionByName(marked.filter("short").select("t1", "t2"))
    for n in joined:
        suspects = suspects.unionByName(read.select("t1", "t2", F.explode(let(F.col("wh"), _runs(n))).alias("h")).join(small(short[n]), "h", "left_semi").select("t1", "t2"))
    suspects = settle(suspects.distinct())

    texts = join_unique(docs.select(*key, "text"), suspects, ["t1", "t2"]).groupBy("t1", "t2").agg(F.min("text").alias("text"))
    texts = settle(texts.select("t1", "t2", words_of(F.col("text")).alias("words")))
    hits = None
    for size in sorted({WINDOW, *short}):
        of_items = items if size == WINDOW else items.filter(F.size("words") == size)
        of_items = settle(_windows(of_items, ["item_id"], size).select("item_id", "h", "h2").distinct())
        found = join_unique(_windows(texts, ["t1", "t2"], size), of_items, ["h", "h2"]).select("t1", "t2", "pos", "len", "item_id")
        hits = found if hits is None else hits.unionByName(found)
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["pos"] + x["len"] - F.greatest(x["pos"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["pos"] + x["len"]).alias("end"))
    laid = (
        hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select(
            "t1", "t2", F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"]).cast("long").alias("n_hit"),
            F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        )
    )
    laid = settle(laid)
    drop_settled(items, suspects, texts)
    return marked.select("doc_id", "t1", "t2", "n_words"), laid


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs.

    Winnowed fingerprints of documents are joined with those of the items; the
    texts that share one are compared with all windows of the items, and their
    windows are laid over the words. No shared run of WINDOW words is missed.
    Items of fewer words are one window each, looked for by its hash.
    Windows are compared once for each distinct text, so copies cost nothing;
    only the few texts that are hit meet the rows again.

    Null and empty texts have no words and are clean; items without words or
    that are null never occur; an item without id marks words but isn't counted;
    items with the same id count as one. Other columns are ignored; empty
    tables give no row, or clean rows. Long texts and items cost time in
    proportion to their words.
    """
    marked, laid = overlaps(docs, benchmark)
    out = join_unique(marked, laid, ["t1", "t2"], "left")
    hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce(F.col("items_sha256"), F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no window of an item, with all their columns.

    Rows with null, empty or wordless texts stay, repeated rows stay as often as
    they come; an empty table stays empty, and without items every row stays.
    Rows are told by their text, so nulls and ties in doc_id don't matter;
    columns that begin with two underscores are reserved.
    """
    _, laid = overlaps(docs, benchmark)
    bad = laid.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.lit(True).alias("__bad"))
    kept = docs.withColumns({"__t1": text_key()[0], "__t2": text_key()[1]})
    if is_small(bad):
        return kept.join(F.broadcast(bad), ["__t1", "__t2"], "left_anti").select(docs.columns)
    return join_unique(kept, bad, ["__t1", "__t2"], "left").filter("__bad is null").select(docs.columns)
