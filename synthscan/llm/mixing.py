"""Mixing of sources to target weights, with a low-discrepancy schedule over equal-token blocks.

Sizes are words. The mix is `share` times all sizes; sources share it by weight, none above `cap` times its own size
(what is above is shared again by weight). The schedule has N = 2^k slots. Slot i's van der Corput point, its bits
reversed, falls into one source's interval of the cumulative targets; with 2^k slots each source gets its share to
within one slot, and any stretch of the schedule is mixed alike. The r-th slot of a source takes the source's block r,
counted round and round. A block is total / N words of the source's documents in shuffled order (by the hash of their
ids), so a document may be cut between blocks.

At scale: sizes are written to the shared folder once and texts are read once more only for `mixed`. Positions in a
source are running sums in two steps, over fine buckets and then within them, so a source with a third of all rows is
spread over many tasks, as are its slots and blocks. N grows with the input from 2^16 (or the number of words, if
smaller), in blocks of up to 4096 words.

Defined cases: a null or empty text has size 0 and nothing taken; the null source is a source of its own, the last;
null ids are shuffled as an empty text would be; rows that share an id are each placed; sources without words have the
target 0; an empty table gives an empty result; columns whose names clash with this module's are no trouble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, n_words, stored

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
LEAST_SLOTS_LOG2, BLOCK, BUCKET_ROWS, CELLS, FAN = 16, 4096, 512, 1024, 4096


def _bases(sums: DataFrame, group: str, buckets: int) -> DataFrame:
    """(group, _bucket, _sum) with _base: the sum of the group's earlier buckets; no task gets more than FAN of them."""
    past = lambda *by: Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *by: F.coalesce(F.sum("_sum").over(past(*by)), F.lit(0))
    if buckets <= FAN:
        return sums.withColumn("_base", before(group))
    sums = sums.withColumn("_up", F.expr(f"_bucket div {FAN}"))
    above = _bases(sums.groupBy(group, F.col("_up").alias("_bucket")).agg(F.sum("_sum").alias("_sum")), group, -(-buckets // FAN))
    above = above.select(F.col(group).alias("_group"), F.col("_bucket").alias("_above"), F.col("_base").alias("_start"))
    joined = sums.join(above, (F.col(group) == F.col("_group")) & (F.col("_up") == F.col("_above")))
    return joined.select(group, "_bucket", "_sum", (F.col("_start") + before(group, "_up")).alias("_base"))


def running(df: DataFrame, group: str, bucket: Column, buckets: int, order: list[str], value: Column) -> DataFrame:
    """df with `before`: the sum of value over the rows of its group that come earlier by (bucket, order); bucket is a long below buckets."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = _bases(df.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum")), group, buckets).drop("_sum")
    inner = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, [group, "_bucket"]).withColumn("before", F.col("_base") + F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return out.drop("_bucket", "_value", "_base")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and the hash that shuffles, written to the shared folder."""
    out = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    key = F.substring(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256), 1, 16)
    return stored(out.withColumn("key", key), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: number, source, source_size, target, low and high (sums of the targets before and through it)."""
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    one = one.withColumn("number", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = one.withColumn("weight", weight.cast("long")).withColumn("cap", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    # Filled like connected vessels: by cap / weight, the level if all before are full; the first not full has the level.
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "number")
    one = one.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(everything)
    one = one.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).withColumn("full", first["place"].isNull() | (F.col("place") < first["place"]))
    through = by_name.rowsBetween(Window.unboundedPreceding, 0)
    full, loose = F.when(F.col("full"), F.col("cap")).otherwise(0), F.when(~F.col("full"), F.col("weight")).otherwise(0)
    high = F.sum(full).over(through) + F.col("level") * F.sum(loose).over(through)
    return one.withColumn("high", high).select(
        "number", "source", "source_size", "total", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
        F.coalesce(F.lag("high").over(by_name), F.lit(0.0)).alias("low"), "high",
    )


def n_slots(total_words: int, share: float = SHARE) -> int:
    """2^k: blocks of at most BLOCK words, 2^16 slots if words allow; a block has a word at least."""
    size = share * total_words
    if size < 1:
        return 1
    k = max(LEAST_SLOTS_LOG2, 0)
    while size / (1 << k) > BLOCK:
        k += 1
    while k and size / (1 << k) < 1:
        k -= 1
    return 1 << k


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, number (of its source) and rank (from 0, among the slots of that source)."""
    spark, bits = sources.sparkSession, slots.bit_length() - 1
    bound = lambda c: F.least(F.ceil(F.col(c) / F.col("total") * slots), F.lit(slots))
    width = max(1, slots // CELLS)
    own = sources.where("total > 0").select("number", bound("low").alias("a"), bound("high").alias("b")).where("a < b")
    own = own.select("number", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))).alias("cell"))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    points = spark.range(slots).select(F.col("id").alias("slot"), reversed_bits.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(own, "cell").where("point >= a AND point < b").select("slot", "number")
    return running(drawn, "number", F.expr(f"slot div {BUCKET_ROWS}"), -(-slots // BUCKET_ROWS), ["slot"], F.lit(1)).select("slot", "number", F.col("before").alias("rank"))


def _block_of(position: Column, block: float) -> Column:
    """The block of a word: the last j with floor(j * block) <= position."""
    near = F.ceil((position + 1) / F.lit(block)) - 1
    return F.when(F.floor((near + 1) * F.lit(block)) <= position, near + 1).when(F.floor(near * F.lit(block)) > position, near - 1).otherwise(near)


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of sizes in their places; their pieces (block, part: words of it, begin: in the document); and the
    schedule's draws (number, block, slot, time: from 0)."""
    rows, words = sizes.agg(F.count("*"), F.sum("size")).first()
    slots, words = n_slots(words or 0, share), words or 0
    block = max(share * words / slots, 1.0)
    sources = stored(targets(sizes, weights, share, cap), "sources")
    digits = 0
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    bucket = F.conv(F.substring("key", 1, digits), 16, 10).cast("long") if digits else F.lit(0).cast("long")
    placed = sizes.join(sources.select(F.col("source").alias("_source"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running(placed, "number", bucket, 16**digits, ["key", "id", "size"], F.col("size"))
    end = F.col("before") + F.col("size")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(_block_of(F.col("before"), block), _block_of(end - 1, block))))
    begin = F.greatest(F.col("before"), F.floor(F.col("block") * block))
    pieces = pieces.withColumn("part", F.least(end, F.floor((F.col("block") + 1) * block)) - begin).withColumn("begin", begin - F.col("before"))
    blocks = sources.where("source_size > 0").select("number", (_block_of(F.col("source_size") - 1, block) + 1).alias("blocks"))
    draws = schedule(sources, slots).join(blocks, "number").select("number", (F.col("rank") % F.col("blocks")).alias("block"), "slot", F.floor(F.col("rank") / F.col("blocks")).alias("time"))
    return placed, pieces, draws.where(F.col("time") < cap)


def drawn(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix as a schedule: slot, source, block, id, begin and words (of the document, the words from begin on). Rows of
    a slot that takes no words are none."""
    _, pieces, draws = _plan(sizes, weights, share, cap)
    return pieces.join(draws, ["number", "block"]).select("slot", "source", "block", "id", "begin", F.col("part").alias("words"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """For each row of sizes: id, source, size, source_size, target, taken, passes (words taken in each pass over the
    source) and slots (the first that takes words of it in each pass, or null)."""
    columns = ["id", "source", "size", "source_size", "target"]
    placed, pieces, draws = _plan(sizes, weights, share, cap)
    at = lambda i: F.col("time") == i
    times = draws.groupBy("number", "block").agg(*(F.min(F.when(at(i), F.col("slot"))).alias(f"slot_{i}") for i in range(cap)))
    taken = pieces.join(times, ["number", "block"], "left").groupBy("number", "before", *columns).agg(
        F.array(*(F.sum(F.when(F.col(f"slot_{i}").isNotNull(), F.col("part")).otherwise(0)).cast("long") for i in range(cap))).alias("passes"),
        F.array(*(F.min(f"slot_{i}") for i in range(cap))).alias("slots"),
    )
    none = placed.where("size = 0").select(*columns, F.array(*[F.lit(0).cast("long")] * cap).alias("passes"), F.array(*[F.lit(None).cast("long")] * cap).alias("slots"))
    total = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)
    return taken.select(*columns, "passes", "slots").union(none).select(*columns, total.alias("taken"), "passes", "slots")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: docs' columns, a row for each pass that takes words of a document, in the order of the schedule.

    A pass that takes all of a document keeps its text; one that takes its head only keeps those words, joined by one
    space. Rows that share id and size are taken alike, as the first of them.
    """
    plan = mix(sized(docs, id_col, text_col, source_col), weights, share, cap)
    plan = plan.where("taken > 0").groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("__mix_id"), F.col("size").alias("__mix_size")).agg(F.min(F.struct("source", F.arrays_zip(F.col("passes").alias("n"), F.col("slots").alias("slot")).alias("passes")))["passes"].alias("__mix_passes"))
    names = docs.columns
    rows = docs.withColumn("__mix_id", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("__mix_size", n_words(F.col(text_col)))
    rows = rows.join(plan, ["__mix_id", "__mix_size"]).withColumn("__mix_pass", F.explode(F.filter("__mix_passes", lambda x: x["n"] > 0)))
    rows = rows.withColumn("__mix_n", F.col("__mix_pass")["n"]).withColumn("__mix_slot", F.col("__mix_pass")["slot"]).drop("__mix_pass", "__mix_passes")
    rows = rows.repartitionByRange("__mix_slot", "__mix_id").sortWithinPartitions("__mix_slot", "__mix_id")
    head = F.array_join(F.slice(F.filter(F.split(F.col(text_col), WORD_SEPARATORS), lambda x: x != ""), F.lit(1), F.col("__mix_n").cast("int")), " ")
    return rows.withColumn(text_col, F.when(F.col("__mix_n") == F.col("__mix_size"), F.col(text_col)).otherwise(head)).select(*names)


#: mix() for DuckDB. Slots of a source fill its blocks in order, so what they take is the head of the source, pass by pass.
ORACLE = r"""
WITH d AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 16) AS key
  FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS number FROM d GROUP BY source),
b AS (SELECT *, CASE number % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM a),
c AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
             row_number() OVER (ORDER BY cap::DOUBLE / weight, number) AS place FROM b),
l AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM c WHERE level * weight < cap),
e AS (SELECT c.* EXCLUDE (level), coalesce(l.level, 0) AS level, l.place IS NULL OR c.place < l.place AS full FROM c, l),
f AS (SELECT *, CASE WHEN "full" THEN cap::DOUBLE ELSE level * weight END AS target,
             (sum(CASE WHEN "full" THEN cap ELSE 0 END) OVER w)::DOUBLE + level * (sum(CASE WHEN "full" THEN 0 ELSE weight END) OVER w)::DOUBLE AS high
      FROM e WINDOW w AS (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT CASE WHEN total < 1 THEN 1 ELSE (1 << least(floor(log2(total))::INT, greatest(16, ceil(log2(total / 4096))::INT))) END::BIGINT AS n, total FROM (SELECT DISTINCT total FROM f)),
g AS (SELECT f.*, k.n, greatest(f.total / k.n, 1.0::DOUBLE) AS block, least(ceil(high / f.total * k.n), k.n)::BIGINT AS b,
             least(ceil(coalesce(lag(high) OVER (ORDER BY number), 0) / f.total * k.n), k.n)::BIGINT AS a FROM f, k),
h AS (SELECT *, CASE WHEN floor((ceil(source_size / block)) * block) < source_size THEN ceil(source_size / block) + 1
                     WHEN floor((ceil(source_size / block) - 1) * block) >= source_size THEN ceil(source_size / block) - 1
                     ELSE ceil(source_size / block) END::BIGINT AS blocks FROM g),
p AS (SELECT d.*, h.source_size, h.target, h.block, h.blocks, greatest(h.b - h.a, 0) AS slots,
             (sum(size) OVER (PARTITION BY number ORDER BY key, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, least(source_size, floor(least(blocks, slots) * block)::BIGINT) AS one,
             least(source_size, floor(greatest(least(blocks, slots - blocks), 0) * block)::BIGINT) AS two FROM p)
SELECT id AS doc_id, size, source_size, target,
       (greatest(0, least(before + size, one) - before) + greatest(0, least(before + size, two) - before))::BIGINT AS taken
FROM q
"""
