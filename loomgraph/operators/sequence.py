"""Scans, packs and reductions over rows in an order. Long sequences are scanned in blocks, not in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows a block of a scan aims at, and the most blocks there are.
BLOCK_ROWS, MOST_BLOCKS = 100_000, 4096
#: Rows that a fold by a caller's operation takes at once.
FOLDED = 256

_FOLD: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def block_of(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the column: a binary search."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) <= column), at + step).otherwise(at))


def quantiles(df: DataFrame, column: str, blocks: int) -> list[int]:
    """Bounds that cut an integer column into `blocks` stretches of nearly as many rows, MOST_BLOCKS at most; fewer where values are few."""
    blocks = min(MOST_BLOCKS, blocks)
    if blocks < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(column, [k / blocks for k in range(1, blocks)], 4 * blocks)).first()[0] or []))


def scan(df: DataFrame, order: str, value: str, op: str = "sum", inclusive: bool = False, back: bool = False, out: str = "scan", identity: int | None = None) -> DataFrame:
    """df with the fold of the values before each row (and its own, if inclusive), from the other end if back.

    order: an integer column without repeats. Rows are counted and dealt to
    blocks of consecutive order, cut at quantiles so that clustered values don't
    meet in one block; each block is folded alone, the folds of the blocks are
    scanned (MOST_BLOCKS rows at most), and the two are combined. What precedes
    the first row is identity (0 for sums, null otherwise).
    """
    fold, both = _FOLD[op]
    identity = 0 if op == "sum" and identity is None else identity
    blocks = min(MOST_BLOCKS, -(-df.count() // BLOCK_ROWS))
    if not blocks:
        return df.withColumn(out, F.col(value))
    bounds = quantiles(df, order, blocks)
    df = df.withColumn("__block", block_of(F.col(order), bounds))
    key = lambda c: F.col(c).desc() if back else F.col(c)
    over_blocks = Window.orderBy(key("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy("__block").agg(fold(F.col(value)).alias("__fold")).select("__block", fold(F.col("__fold")).over(over_blocks).alias("__carried"))
    inside = Window.partitionBy("__block").orderBy(key(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = fold(F.col(value)).over(inside)
    joined = df.join(F.broadcast(carried), "__block").withColumn("__own", own)
    combined = F.when(F.col("__own").isNull(), F.col("__carried")).when(F.col("__carried").isNull(), F.col("__own")).otherwise(both(F.col("__own"), F.col("__carried")))
    return joined.withColumn(out, F.coalesce(combined, F.lit(identity))).drop("__block", "__carried", "__own")


def _folded(rows: DataFrame, both: Callable[[Column, Column], Column], kind: str) -> DataFrame:
    """rows(__at, __v) -> (__at, __before): the fold of all earlier values, null for the first; in blocks of blocks."""
    each = F.struct(F.col("__at"), F.col("__v"))
    blocks = rows.groupBy(F.expr(f"__at div {FOLDED}L").alias("__block")).agg(F.array_sort(F.collect_list(each)).alias("__rows"))
    join = lambda a, x: F.when(a.isNull(), x).when(x.isNull(), a).otherwise(both(a, x).cast(kind))
    nothing = F.lit(None).cast(kind)
    if rows.count() > FOLDED:
        whole = blocks.select(F.col("__block").alias("__at"), F.aggregate("__rows", nothing, lambda a, x: join(a, x["__v"])).alias("__v"))
        carried = _folded(whole, both, kind).select(F.col("__at").alias("__block"), F.col("__before").alias("__carried"))
        blocks = blocks.join(carried, "__block")
    else:
        blocks = blocks.withColumn("__carried", nothing)
    start = F.struct(F.col("__carried").alias("fold"), F.array().cast(f"array<struct<__at:bigint,__before:{kind}>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.array(F.struct(x["__at"].alias("__at"), a["fold"].alias("__before")))
        return F.struct(join(a["fold"], x["__v"]).alias("fold"), F.concat(a["out"], before).alias("out"))

    return blocks.select(F.explode(F.aggregate("__rows", start, step, lambda a: a["out"])).alias("r")).select("r.*")


def scan_with(df: DataFrame, order: str, value: Column, both: Callable[[Column, Column], Column], inclusive: bool = False, back: bool = False, out: str = "scan") -> DataFrame:
    """df with the fold of the values before each row by any associative operation, such as the composition of maps.

    value: a column of any type, structs too; both(earlier, later) makes one of
    the same type. The operation need not commute. Rows are numbered, folded in
    blocks of FOLDED, and the folds of the blocks are scanned in the same way,
    so no task holds more than a block, however long the sequence. What
    precedes the first row is null; null values are passed over. order: an
    integer column without repeats.
    """
    rows = scan(df.withColumns({"__v": value, "__one": F.lit(1).cast("long")}), order, "__one", back=back, out="__at").drop("__one")
    kind = rows.schema["__v"].dataType.simpleString()
    before = _folded(rows.select("__at", "__v"), both, kind)
    done = rows.join(before, "__at")
    if inclusive:
        own = F.when(F.col("__v").isNull(), F.col("__before")).when(F.col("__before").isNull(), F.col("__v")).otherwise(both(F.col("__before"), F.col("__v")).cast(kind))
        done = done.withColumn("__before", own)
    return done.withColumn(out, F.col("__before")).drop("__v", "__at", "__before")


def plus_scan(df: DataFrame, order: str, value: str, out: str = "scan") -> DataFrame:
    """Exclusive prefix sums: offsets from degrees."""
    return scan(df, order, value, "sum", out=out)


def scan_inclusive(df: DataFrame, order: str, value: str, op: str = "sum", out: str = "scan") -> DataFrame:
    return scan(df, order, value, op, inclusive=True, out=out)


def scan_back(df: DataFrame, order: str, value: str, op: str = "sum", out: str = "scan") -> DataFrame:
    return scan(df, order, value, op, back=True, out=out)


def scan_inclusive_back(df: DataFrame, order: str, value: str, op: str = "min", out: str = "scan") -> DataFrame:
    return scan(df, order, value, op, inclusive=True, back=True, out=out)


def pack(df: DataFrame, flag: Column) -> DataFrame:
    return df.filter(flag)


def pack_index(df: DataFrame, flag: Column, order: str, base: int = 0) -> DataFrame:
    """The order of the rows that meet the flag, with their place among them from base on."""
    kept = df.filter(flag).select(order, F.lit(1).cast("long").alias("__one"))
    return scan(kept, order, "__one", out="place").select(order, (F.col("place") + base).alias("place"))


def filter_non_negative(df: DataFrame, column: str) -> DataFrame:
    """Drops the empty slots (-1) of a sparse push."""
    return df.filter(F.col(column) >= 0)


def reduce(df: DataFrame, **folds: Column) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in folds.items()])


def plus_reduce(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))


def count_flags(df: DataFrame, flag: Column) -> DataFrame:
    return df.agg(F.count_if(flag).alias("set"))
