"""Personal data: fixed base patterns, and identifiers found from their contexts by bootstrapping. DataFrame code only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and non-overlapping for each
kind. Valid ones are seeds, and so are secrets, a further kind: runs of 32 or more hexadecimal digits, letters among
them. A seed induces up to three lexical patterns: the two words before it, the two after it, the one on either side;
lower-cased, told apart by side, whatever stands between. Candidates are words with a digit or an @ that no base span
overlaps, with their own patterns. Scoring runs on the graph of patterns and distinct values until nothing new is found
(or `rounds` times, if given):

  a pattern's confidence for a kind is the share of its distinct values that are known to be of that kind; it counts
  from `support` known values on, seeds and those found in earlier rounds, else as 0;
  a candidate's score for a kind whose shape it has is 1 - the product of (1 - confidence) over its patterns of one
  side, for the best side (the sides of one occurrence are no independent witnesses); values that reach `accept` are
  known from then on.

Every occurrence of a value found so is a span of its kind. Patterns with few known values never fire, so texts whose contexts
say nothing gain nothing.

At scale: texts are scanned once; spans and candidates go to the shared folder as small rows. The graph is aggregated to
distinct (pattern, value) pairs before joins, so a pattern that a third of all rows share is pre-aggregated; patterns
with fewer than `support` values of all, which can never count, don't enter them. Rounds end as each but the last finds a
value; the joins are plain equi-joins that adaptive execution may split.

A text costs linear time in its length, but for one sort of its matches: what an expression uses for every match is bound once
(`let`), running sums and extremes are formed block by block (`scan`), and regular expressions are possessive and
anchored by look-behind where a leftmost match cannot begin later in a run (or, for e-mail addresses, at the end of the
last match).

Defined cases: null and empty texts have no spans; a context of fewer words than its pattern has is none; equal rows each
get all spans; rows that share an id but not the text are scanned each by its own text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import discard, stored

KINDS = ("email", "ip", "card", "phone")  # of the base
FOUND = (*KINDS, "secret")
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The whole of a run of digits with single separators, if it has 13 to 19.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9A-Fa-f]{32}", "token": "[0-9@]"}
TOKEN = rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+"
#: Shapes that a value found by context may have.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]-?){11,18}[0-9]$",
    "phone": r"^[(]?[0-9](?:[().-]{0,2}[0-9]){6,14}$",
    "secret": r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+$",
}
SIDES = ("<", ">", "|")
BLOCK = 1024


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern stays."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Fa-f]")
    return F.lit(True)


def _is_kind(number: int):
    return lambda x: x["kind"] == number


def _keeps(kind: str):
    return lambda x: valid(kind, x["value"])


def scan(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of an associative join of ints: in blocks of BLOCK, then over the blocks' ends."""

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda a, n: F.array_append(a, join(F.coalesce(F.get(a, F.size(a) - 1), F.lit(zero)), n)))

    def blocked(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda j: plain(F.slice(x, j * BLOCK + 1, F.lit(BLOCK))))
        joined = lambda b, ends: F.flatten(F.transform(b, lambda own, j: F.when(j == 0, own).otherwise(F.transform(own, lambda n: join(F.get(ends, j - 1), n)))))
        return let(blocks, lambda b: let(plain(F.transform(b, lambda own: F.element_at(own, -1))), lambda ends: joined(b, ends)))

    return let(values, lambda x: F.when(F.size(x) <= BLOCK, plain(x)).otherwise(blocked(x)))


def _patterns(found: Column, gaps: Column, i: Column) -> Column:
    """The lexical patterns of match i. Words have a letter or digit, punctuation before it aside. A match is a word or
    more, so the words next to it lie within two matches of it."""
    two = rf"^(?:[^\p{{L}}\p{{N}}]*+{_WORD}++){{0,2}}+{_SPACE}*+"  # and all of a shorter piece
    none = F.lit("")

    def tail(j: Column) -> Column:
        piece = F.concat(F.when(j > 0, F.get(found, j - 1)).otherwise(none), F.get(gaps, j))
        return F.when(j >= 0, F.regexp_extract(F.reverse(piece), two, 0)).otherwise(none)

    def head(j: Column) -> Column:
        piece = F.concat(F.get(gaps, j + 1), F.coalesce(F.get(found, j + 1), none))
        return F.when(j < F.size(found), F.regexp_extract(piece, two, 0)).otherwise(none)

    def words(x: Column) -> Column:
        return F.regexp_extract_all(F.lower(x), F.lit(rf"[\p{{L}}\p{{N}}]{_WORD}*+"), F.lit(0))

    def pick(a: Column, b: Column) -> Column:  # a backwards
        return F.array_compact(F.array(
            F.when(F.size(a) >= 2, F.concat(F.lit(SIDES[0]), F.reverse(F.get(a, F.lit(1))), F.lit(" "), F.reverse(F.get(a, F.lit(0))))),
            F.when(F.size(b) >= 2, F.concat(F.lit(SIDES[1]), F.get(b, F.lit(0)), F.lit(" "), F.get(b, F.lit(1)))),
            F.when((F.size(a) >= 1) & (F.size(b) >= 1), F.concat(F.lit(SIDES[2]), F.reverse(F.get(a, F.lit(0))), F.lit(" "), F.get(b, F.lit(0)))),
        ))

    before, after = F.concat(tail(i), tail(i - 1), tail(i - 2)), F.concat(head(i), head(i + 1), head(i + 2))
    return let(words(before), lambda a: let(words(after), lambda b: pick(a, b)))


def _with_patterns(matches: Column, found: Column, gaps: Column, kind: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _patterns(found, gaps, x["i"]).alias("patterns")))


def _core(m: Column, i: Column, end: Column) -> Column:
    """A word's place, and its value without the punctuation around it."""
    value = F.regexp_replace(m, r"^[^0-9A-Za-z(:]++|(?<![^0-9A-Za-z):])[^0-9A-Za-z):]++$", "")
    at = end - F.length(m) + F.length(F.regexp_extract(m, r"^[^0-9A-Za-z(:]*+", 0))
    return F.struct(i.alias("i"), at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"), (end - F.length(m)).alias("first"), end.alias("last"))


def _in_order(events: Column, ended: Column, following: Column) -> Column:
    """For each event of a place, in order: whether all spans that begin before it or with it have ended, and the next begins behind it."""
    free = F.transform(events, lambda e, i: F.struct(e["own"].alias("own"), ((F.get(ended, i) <= e["first"]) & (F.get(following, i) >= e["last"])).alias("free")))
    return F.filter(free, lambda e: e["own"])


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row (a hash of the text), spans (base and secrets; kind is a number) and candidates of each document, in the shared folder.

    Each step's columns are used by the next one more than once, or within a lambda and on, so that the optimiser keeps
    the steps apart and computes them once.
    """
    patterns = {**BASE, "secret": SECRET, "token": TOKEN}
    step = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    step = step.withColumns({f"m_{k}": F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    step = step.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in patterns.items()})
    step = step.select("id", F.xxhash64("text").alias("row"), *(f"{x}_{k}" for x in "mg" for k in patterns))
    length = lambda g, m: F.length(g) + F.length(m)
    step = step.withColumns({f"e_{k}": F.when(F.size(f"m_{k}") > 0, scan(F.zip_with(F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), f"m_{k}", length), lambda a, b: a + b, 0)) for k in patterns})

    def placed(k: str) -> Column:
        end = F.col(f"e_{k}")
        return F.transform(f"m_{k}", lambda m, i: F.struct(i.alias("i"), (F.get(end, i) - F.length(m)).alias("start"), F.get(end, i).alias("end"), m.alias("value")))

    kept = {f"v_{k}": F.filter(placed(k), _keeps(k)) for k in FOUND}
    shaped = F.filter(F.transform("m_token", lambda m, i: _core(m, i, F.get("e_token", i))), lambda x: x["value"].rlike("|".join(SHAPES.values())))
    step = step.withColumns({**kept, "v_token": shaped}).drop(*(f"e_{k}" for k in patterns))
    spans = F.concat(*(_with_patterns(F.col(f"v_{k}"), F.col(f"m_{k}"), F.col(f"g_{k}"), F.lit(i)) for i, k in enumerate(FOUND)))
    step = step.select("id", "row", spans.alias("spans"), "v_token", "m_token", "g_token")

    # Words that no span overlaps, told by one order of both.
    event = lambda own: lambda x: F.struct(*((x["first"], F.lit(own).alias("own"), x["last"].alias("last")) if own else (x["start"].alias("first"), F.lit(own).alias("own"), x["end"].alias("last"))))
    mixed = F.array_sort(F.concat(F.transform("spans", event(False)), F.transform("v_token", event(True))))
    step = step.withColumn("events", F.when((F.size("spans") > 0) & (F.size("v_token") > 0), mixed))
    far = F.lit(2**31 - 1)
    ended = scan(F.transform("events", lambda e: F.when(e["own"], 0).otherwise(e["last"])), lambda a, b: F.greatest(a, b), 0)
    following = F.reverse(scan(F.reverse(F.transform("events", lambda e: F.when(e["own"], far).otherwise(e["first"]))), lambda a, b: F.least(a, b), 2**31 - 1))
    order = let(ended, lambda a: let(following, lambda b: _in_order(F.col("events"), a, b)))
    free = let(order, lambda own: F.filter("v_token", lambda _, i: F.get(own, i)["free"]))
    step = step.withColumn("v_token", F.when(F.col("events").isNull(), F.col("v_token")).otherwise(free)).drop("events")
    out = step.select("id", "row", "spans", _with_patterns(F.col("v_token"), F.col("m_token"), F.col("g_token"), F.lit(None).cast("int")).alias("candidates"))
    return stored(out, "pii")


def bootstrapped(found: DataFrame, support: int = 5, accept: float = 0.9, rounds: int | None = None) -> DataFrame:
    """(value, kind) of the values that contexts tell, from scanned rows."""
    seeds = found.select(F.explode("spans").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.value", "x.kind").distinct()
    tokens = found.select(F.explode("candidates").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.value").distinct()
    shapes = F.array_compact(F.array(*(F.when(F.col("value").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(FOUND))))
    pairs = stored(seeds.withColumn("seed", F.lit(True)).union(tokens.withColumn("kind", F.explode(shapes)).select("pattern", "value", "kind").withColumn("seed", F.lit(False))), "pairs")
    able = pairs.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = stored(pairs.join(able, "pattern"), "edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    known = stored(edges.where("NOT seed").limit(0).select("value", "kind"), "known")
    for _ in count() if rounds is None else range(rounds):
        sure = edges.join(known.withColumn("new", F.lit(True)), ["value", "kind"], "left").where("seed OR new")
        trust = sure.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n")).join(totals, "pattern")
        trust = trust.where(F.col("n") >= support).select("pattern", "kind", (F.col("n") / F.col("total")).alias("trust"))
        sided = edges.where("NOT seed").join(trust, ["pattern", "kind"]).groupBy("value", "kind", F.substring("pattern", 1, 1).alias("side"))
        sided = sided.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-12)))))).alias("score"))
        scored = sided.groupBy("value", "kind").agg(F.max("score").alias("score"))
        now = stored(known.union(scored.where(F.col("score") >= accept).select("value", "kind")).distinct(), "known")
        if now.count() == known.count():
            discard(now)
            break
        discard(known)
        known = now
    best = F.min("kind").alias("kind")  # one kind for each value
    return known.groupBy("value").agg(best)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, FOUND))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, accept: float = 0.9, rounds: int | None = None) -> DataFrame:
    """One row per document: id, base and found (arrays of kind number, start, end), their counts and written forms; found has
    the secrets and what contexts told."""
    rows = scanned(docs, id_col, text_col)
    values = bootstrapped(rows, support, accept, rounds)
    hits = rows.where(F.size("candidates") > 0).select("id", "row", F.explode("candidates").alias("x")).select("id", "row", "x.value", "x.start", "x.end").join(values, "value")
    hits = hits.groupBy("id", "row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("told")).withColumnsRenamed({"id": "_id", "row": "_row"})
    place = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = rows.select("id", "row", place(F.filter("spans", lambda x: x["kind"] < len(KINDS))).alias("base"), place(F.filter("spans", lambda x: x["kind"] >= len(KINDS))).alias("secrets"))
    out = out.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    out = out.select(F.col("id").alias(id_col), "base", F.concat("secrets", F.coalesce("told", F.array().cast("array<struct<kind:int,start:int,end:int>>"))).alias("found"))
    counts = (F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS))
    return out.select(id_col, *counts, F.size("found").cast("long").alias("n_found"), _written(F.col("base")).alias("base_spans"), _written(F.concat("base", "found")).alias("spans"), "base", "found")
