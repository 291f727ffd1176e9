"""Personal data: fixed rules, and contextual patterns bootstrapped from what they find.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, join_unique, let, settle

#: Times scores are passed at most before it is an error; they settle in three to five.
ROUNDS = 50
KINDS = ("email", "ip", "card", "phone")
# The four rules. Possessive runs and the looks behind leave the matches as they are, but keep long runs linear.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of other characters than blanks that holds a digit or an @.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
#: Code points of context on either side of a span.
CONTEXT = 64
#: Elements an array is folded over at once, and code points of a piece of text: what keeps long texts linear.
STRETCH, PIECE = 256, 1024


def _folds_before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, the fold of those before it, from 0 on.

    An array that grows by one is copied at each step, so stretches are folded
    alone and their results carried over: n * STRETCH steps instead of n * n.
    """
    nothing = F.array().cast("array<int>")

    def walk(part: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(part, F.struct(first.alias("at"), nothing.alias("out")), step, lambda a: a["out"])

    def over(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int"))
        part = lambda k: F.slice(v, k * STRETCH + 1, STRETCH)
        totals = F.transform(places, lambda k: F.aggregate(part(k), F.lit(0), both))
        carried = lambda totals: walk(totals, F.lit(0))
        return let(let(totals, carried), lambda c: F.flatten(F.transform(places, lambda k: walk(part(k), c[k]))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(nothing))


def _found(text: Column, rule: str, kind: int | None, may: Column) -> Column:
    """The leftmost matches of a rule and the gaps between them; none where the text can't hold any."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    return F.struct(F.lit(kind).cast("int").alias("kind"), F.when(may, F.split(text, rule, -1)).otherwise(none).alias("gaps"), F.when(may, found).otherwise(none).alias("found"))


def _laid(s: Column) -> Column:
    """Spans of what _found() returns, in code points, end exclusive."""
    places = F.sequence(F.lit(0), F.size(s["found"]) - 1)
    steps = F.transform(places, lambda i: F.length(s["gaps"][i]) + F.length(s["found"][i]))

    def spans(before: Column) -> Column:
        def one(i: Column) -> Column:
            start = before[i] + F.length(s["gaps"][i])
            return F.struct(s["kind"].alias("kind"), start.alias("start"), (start + F.length(s["found"][i])).alias("end"), s["found"][i].alias("value"))

        return F.transform(places, one)

    return F.when(F.size(s["found"]) > 0, let(_folds_before(steps, lambda a, x: a + x), spans)).otherwise(F.array().cast(_SPAN))


def _check(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four rules, by kind and start; matches that fail their check are dropped."""
    may = {"email": text.contains("@"), "phone": text.contains("+")}
    found = F.array(*[_found(text, _RULES[kind], i, may.get(kind, text.rlike("[0-9]"))) for i, kind in enumerate(KINDS)])

    def valid(s: Column) -> Column:
        checks = F.when(s["kind"] == 0, _check(KINDS[0], s["value"]))
        for i, kind in list(enumerate(KINDS))[1:]:
            checks = checks.when(s["kind"] == i, _check(kind, s["value"]))
        return checks

    return F.filter(F.flatten(F.transform(found, _laid)), valid)


def _candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens that touch no base span, cut back to their ASCII letters and digits."""

    def core(s: Column) -> Column:
        value = F.regexp_extract(s["value"], r"(?s)[A-Za-z0-9].*[A-Za-z0-9]|[A-Za-z0-9]", 0)
        return let(F.struct(value.alias("v"), (s["start"] + F.instr(s["value"], value) - 1).alias("at")), lambda c: F.struct(c["at"].alias("start"), F.lit(1).alias("token"), (c["at"] + F.length(c["v"])).alias("end"), c["v"].alias("value")))

    def free(events: Column) -> Column:
        """Tokens don't overlap, so of the base spans that start later only the next one can touch a token."""

        def kept(before: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                after = F.get(events, i + 1)
                clear = (before[i] <= e["start"]) & (after.isNull() | (after["token"] == 1) | (after["start"] >= e["end"]))
                return F.when((e["token"] == 1) & (e["end"] > e["start"]) & clear, F.struct(F.lit(None).cast("int").alias("kind"), e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value")))

            return F.filter(F.transform(events, one), lambda x: x.isNotNull())

        ends = F.transform(events, lambda e: F.when(e["token"] == 0, e["end"]).otherwise(0))
        return let(_folds_before(ends, lambda a, x: F.greatest(a, x)), kept)

    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("token"), b["end"].alias("end"), F.lit("").alias("value")))
    events = F.array_sort(F.concat(fixed, F.transform(let(_found(text, _TOKEN, None, F.lit(True)), _laid), core)))
    return F.when(text.rlike("[0-9@]"), let(events, free)).otherwise(F.array().cast(_SPAN))


def _patterns(pieces: Column, s: Column) -> Column:
    """Lexical patterns of a span: one and two words before, two words after, one on either side.

    pieces: the text in pieces of PIECE code points, of which only those around the span are read.
    """
    shape = lambda x: F.translate(F.lower(x), "123456789", "000000000")

    def around(start: Column, length: Column) -> Column:
        k = F.floor(start / PIECE).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit(""))), start - k * PIECE + 1, length)

    words = lambda x: F.regexp_extract_all(shape(x), F.lit(r"\S+"), F.lit(0))
    left = words(around(F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT))))
    right = words(around(s["end"], F.lit(CONTEXT)))

    def named(c: Column) -> Column:
        word = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
        l1, l2, r1, r2 = word(c["l"], -1), word(c["l"], -2), word(c["r"], 1), word(c["r"], 2)
        return F.array(F.concat(F.lit("L1 "), l1), F.concat_ws(" ", F.lit("L2"), l2, l1), F.concat_ws(" ", F.lit("R2"), r1, r2), F.concat_ws(" ", F.lit("B"), l1, r1))

    return let(F.struct(left.alias("l"), right.alias("r")), named)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_support: float = 5.0, min_conf: float = 0.8, accept: float = 0.9) -> DataFrame:
    """Values that trusted patterns give away: rows (value, kind, score).

    edges(pattern, value, kind) holds each pair once; kind is null for values no
    rule knows. A pattern's confidence in a kind is the score of the kind's
    values over the score of all its values, where an unknown value counts half;
    its support is the score of the kind's values, so copies of one value add
    nothing. A value's score is the noisy-or over its trusted patterns. Scores
    are passed back and forth until they stay as they are; if they don't in
    `rounds` times, that is an error. Empty edges give no row; a null pattern or
    value is one like any other to the sums and meets nothing. A pattern or value that holds a large part of the edges is spread
    over tasks (join_unique).
    """
    seeds = settle(edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("seed"), F.lit(1.0).alias("score")))
    unknown = settle(join_unique(edges.filter("kind is null").select("pattern", "value"), seeds, ["value"], "left").filter("seed is null").select("pattern", "value"))
    known, found, last = seeds, None, None
    for _ in range(rounds):
        seen = join_unique(edges.select("pattern", "value"), known, ["value"], "left")
        sums = [F.sum(F.when(F.col("seed") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))]
        scored = seen.groupBy("pattern").agg(*sums, F.sum(F.col("seed").isNull().cast("double")).alias("unknown"))
        total = sum((F.col(f"s{k}") for k in range(len(KINDS))), F.lit(0.0))
        best = F.greatest(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(k).alias("k")) for k in range(len(KINDS))])
        trusted = scored.withColumn("conf", best["s"] / (total + 0.5 * F.col("unknown") + 1e-9)).filter((best["s"] >= min_support) & (F.col("conf") >= min_conf)).select("pattern", best["k"].alias("kind"), F.least(F.col("conf"), F.lit(0.999)).alias("conf"))
        trusted = settle(trusted)
        votes = join_unique(unknown, trusted, ["pattern"])
        score = (1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")
        best = votes.groupBy("value", "kind").agg(score).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        before, found = found, settle(best.select("value", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")).filter(F.col("score") >= accept))
        drop_settled(trusted, *([before] if before is not None else []))
        now = found.agg(F.count("*"), F.round(F.sum("score"), 6), F.sum("kind")).first()
        if now == last:
            break
        known, last = seeds.unionByName(found.select("value", F.col("kind").alias("seed"), "score")), now
    else:
        raise RuntimeError(f"scores did not settle in {rounds} rounds")
    drop_settled(seeds, unknown)
    return found


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_support: float = 5.0, min_conf: float = 0.8, accept: float = 0.9) -> DataFrame:
    """Rows (doc_id, base, spans), one for each row of docs; arrays of (kind, start, end) by kind and start.

    base holds the spans of the rules; spans adds identifier-like tokens whose
    values bootstrap() accepts. kind counts along KINDS. Null texts count as
    empty and have no span; equal rows are treated alike; columns other than
    doc_id and text are ignored; an empty table gives no row. Without seeds
    enough, no pattern is trusted and spans equal base. A long text costs time
    in proportion to its length.
    """
    read = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).withColumn("b", base_spans(F.col("t")))

    def seen(c: Column) -> Column:
        def occurrence(s: Column) -> Column:
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("value"), _patterns(c["pieces"], s).alias("patterns"))

        return F.transform(c["spans"], occurrence)

    plain = F.transform("b", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.struct(F.concat(F.col("b"), _candidates(F.col("t"), F.col("b"))).alias("spans"), F.regexp_extract_all("t", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    found = settle(read.select("doc_id", F.monotonically_increasing_id().alias("rid"), plain.alias("base"), F.when(F.col("t").rlike("[0-9@]"), let(both, seen)).alias("seen")))

    each = found.select("rid", F.explode("seen").alias("o"))
    edges = settle(each.select(F.explode("o.patterns").alias("pattern"), F.col("o.value").alias("value"), F.col("o.kind").alias("kind")).groupBy("pattern", "value").agg(F.min("kind").alias("kind")))
    values = bootstrap(edges, rounds, min_support, min_conf, accept)
    drop_settled(edges)
    more = each.filter("o.kind is null").select("rid", F.col("o.value").alias("value"), F.col("o.start").alias("start"), F.col("o.end").alias("end"))
    more = join_unique(more, values.select("value", "kind"), ["value"])
    more = more.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("more"), F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return found.select("doc_id", "rid", "base").join(more, "rid", "left").select("doc_id", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
