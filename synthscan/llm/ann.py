"""Nearest neighbours by cosine, over shifted space-filling curves.

Equal vectors are one class with the k + 1 smallest of their ids, which is all that any query can need of them. Unit
vectors are turned by `orderings` random rotations, of which the first `axes` coordinates are shifted, put on a grid and
numbered along a Hilbert curve. For each ordering Spark range-partitions the classes by curve key and packs them into
blocks with the ranks they begin at; a query meets, by an equi-join on (ordering, block), all blocks with a row up to
`reach` ranks before or after it, across the borders of partitions. The merged and reranked best of all orderings are
the result of the curves.

How far windows have to reach depends on the data: it is measured. Of the queries, `probes` at most (those of the
smallest hashes; the documented bound) are ranked against every row, and reach is what finds `share` of their nearest
neighbours in some ordering, `window` at least. On clustered vectors that is the least window; on vectors without any
structure it is some percent of the rows, and the curves then read about as many rows as there are in all.

With `complete` an exact check follows: the first ordering's blocks, in groups, have centres and radii, which bound any
query's score; queries, in chunks along the curve, meet those groups that may hold a better neighbour than found.

Scores are sums in one fixed order in double precision, of vectors scaled by powers of two (which changes no score but
keeps sums from overflowing): equal vectors score equally wherever they lie, and ties go to the smaller id.

At scale: nothing but the probes, counts and totals reaches the driver, and no group that meets in a task grows with the
data: blocks, chunks and the number of either in a group are bounded; what is more is dealt to further groups.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or don't have the most common
length take no part, nor do null ids; rows with a query's own id are not its candidates, and several rows of one id
count once, with the best score; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, tidy

ORDERINGS, AXES, BITS, WINDOW, BLOCK = 16, 8, 7, 64, 1024
PROBES, SHARE = 256, 0.95
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 50_000
#: What may meet in one task: packs of queries with a block, blocks with chunks of about CHUNK queries.
PACKS, BLOCKS, CHUNKS, CHUNK = 256, 32, 8, 2048
#: Query's class, candidate's class with the smallest of its ids, score.
HITS = "q long, c long, least long, score double"
#: A block: its rows, and once more those that are queries.
PACKED = "ordering int, part int, begin long, n long, vec binary, least binary, v binary, n_asks long, q binary, v_q binary"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of grid points x (rows of unsigned integers below 2**bits), after Skilling (2004)."""
    x = x.astype(np.uint64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for axis in x:
            set_ = (axis & np.uint64(q)) != 0
            swap = np.where(set_, 0, (x[0] ^ axis) & p)
            x[0] ^= np.where(set_, p, swap)
            axis ^= swap if axis is not x[0] else np.uint64(0)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & np.uint64(q), np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | ((axis >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(unit: np.ndarray, ordering: int, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    rng = np.random.default_rng(ordering)
    d = unit.shape[1]
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    place = unit @ turn[:, :axes] * np.sqrt(d) / 8 + 0.375 + rng.random(min(axes, d)) / 4
    return hilbert(np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64), bits)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products along the last axis, added up from the first component to the last."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.clip(in_order(query, vectors) / np.sqrt(in_order(query, query) * in_order(vectors, vectors)), -1, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that their largest component is from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> tuple[DataFrame, int]:
    """id, is_query and the vector's doubles as binary, of the rows that take part; and their length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            flat = _scaled(flat) if len(flat) else flat
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("is_query"), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "is_query", "v"])

    return rows.where(F.size("v") == d).mapInArrow(run, "id long, is_query boolean, v binary"), d


def _longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _best(q: np.ndarray, vec: np.ndarray, least: np.ndarray, v: np.ndarray, v_q: np.ndarray, k: int, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """Hits: of each query the k best rows by (score, least id), of score floor or more; screened by fast products, scored exactly."""
    names = ["q", "c", "least", "score"]
    if not len(q) or not len(vec):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
    near = _unit(v_q) @ _unit(v).T
    bound = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
    bound = bound if floor is None else np.maximum(bound, floor)
    row, col = np.nonzero(near >= bound[:, None] - 1e-9)
    score = cosine(v_q[row], v[col])
    order = np.lexsort((least[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, score = (x[place < k] for x in (row, col, score))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (q[row], vec[col], least[col], score)], names)


def _top(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least", "c"))
    return hits.distinct().withColumn("place", place).where(F.col("place") <= k)


def classed(rows: DataFrame, k: int) -> DataFrame:
    """vec (a number), ids (the k + 1 smallest), least (the smallest), asks (whether one is a query's) and v of each distinct vector."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select("v", "id").withColumn("place", place).where(F.col("place") <= k + 1).select("v", "id", F.lit(False).alias("asks"))
    asked = rows.where("is_query").select("v").distinct().select("v", F.lit(None).cast("long").alias("id"), F.lit(True).alias("asks"))
    one = few.union(asked).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max("asks").alias("asks"))
    return stored(one.select(F.monotonically_increasing_id().alias("vec"), "ids", F.get("ids", F.lit(0)).alias("least"), "asks", "v"), "classes")


def reach(classes: DataFrame, d: int, k: int, orderings: int = ORDERINGS, probes: int = PROBES, share: float = SHARE) -> int:
    """Within how many ranks of some ordering share of the probes' k nearest other classes lie, by brute force."""
    chosen = classes.where("asks").select("vec", "v").orderBy(F.xxhash64("least"), "vec").limit(probes).toPandas()
    if not len(chosen):
        return 0
    q, v_q = chosen["vec"].to_numpy(np.int64), np.frombuffer(b"".join(chosen["v"]), np.float64).reshape(-1, d)

    def truth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _best(q, b.column("vec").to_numpy(), b.column("least").to_numpy(), _matrix(b.column("v"), d), v_q, k + 1)

    true = _top(classes.mapInArrow(tidy(truth), HITS), k + 1).where("q <> c").select("q", "c").join(classes.select(F.col("vec").alias("c"), "v"), "c").toPandas()
    if not len(true):
        return 0
    own = np.searchsorted(np.sort(q), true["q"])
    u, u_q = _unit(np.frombuffer(b"".join(true["v"]), np.float64).reshape(-1, d)), _unit(v_q[np.argsort(q)])
    keys = [(curve_keys(u, o), curve_keys(u_q, o)[own]) for o in range(orderings)]

    def between(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((orderings, len(own)), np.int64)
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column("v"), d))
                for o, (x, y) in enumerate(keys):
                    key = np.sort(curve_keys(unit, o))
                    total[o] += np.maximum(0, np.searchsorted(key, np.maximum(x, y)) - np.searchsorted(key, np.minimum(x, y), side="right"))
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["ordering", "pair", "n"])

    far = classes.select("v").mapInArrow(tidy(between), "ordering long, pair long, n long").groupBy("ordering", "pair").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.min("n").alias("n"))
    return 1 + int(np.quantile(far.toPandas()["n"].to_numpy(), share, method="higher"))


def _keyed(d: int, orderings: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column("v"), d))
                for o in range(orderings):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), o, np.int32)), pa.array(curve_keys(unit, o)), *b.columns], ["ordering", "key", "vec", "least", "asks", "v"])

    return run


def _packed(block: int):
    """Sorted rows in packs of one ordering; begin: the rank within this partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        last, begin = None, 0

        def pack(rows: pa.Table) -> pa.RecordBatch:
            vec, least, asks = (rows.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("vec", "least", "asks"))
            v = rows.column("v").to_pylist()
            at = np.flatnonzero(asks)
            row = (last, part, begin, rows.num_rows, vec.tobytes(), least.tobytes(), b"".join(v), len(at), vec[at].tobytes(), b"".join(v[i] for i in at))
            kinds = [pa.binary() if x.endswith("binary") else pa.int32() if x.endswith("int") else pa.int64() for x in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            orderings = b.column("ordering").to_numpy()
            cuts = [0, *(np.flatnonzero(orderings[1:] != orderings[:-1]) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if orderings[i] != last:
                    if held:
                        yield pack(pa.Table.from_batches(held))
                    held, last, begin = [], int(orderings[i]), 0
                held.append(b.slice(i, j - i))
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= block:
                    yield pack(rows.slice(0, block))
                    rows, begin = rows.slice(block), begin + block
                held = rows.to_batches()
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def _met(d: int, k: int):
    """Blocks and packs of queries that meet: the k best of each query."""

    def run(blocks: pa.Table, packs: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_best(_longs(packs.column("q")), _longs(blocks.column("vec")), _longs(blocks.column("least")), _matrix(blocks.column("v"), d), _matrix(packs.column("v_q"), d), k)])

    return run


def _summary(d: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        u = _unit(_matrix(table.column("v"), d))
        center = u.mean(axis=0)
        return pa.table({"group": pa.array([key[0].as_py()], pa.int64()), "center": [center.tolist()], "radius": [float(np.sqrt(((u - center) ** 2).sum(axis=1).max()))]})

    return run


def _chunked(d: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        q, v, floor = table.column("q").to_numpy(), _matrix(table.column("v"), d), table.column("floor").to_numpy()
        u = _unit(v)
        center = u.mean(axis=0)
        row = {"chunk": key[0].as_py(), "q": q.tobytes(), "v_q": v.tobytes(), "floor": floor.tobytes(), "least_floor": float(floor.min()), "center_q": center.tolist(), "radius_q": float(np.sqrt(((u - center) ** 2).sum(axis=1).max()))}
        return pa.Table.from_pylist([row], pa.schema([("chunk", pa.int64()), ("q", pa.binary()), ("v_q", pa.binary()), ("floor", pa.binary()), ("least_floor", pa.float64()), ("center_q", pa.list_(pa.float64())), ("radius_q", pa.float64())]))

    return run


def _checked(d: int, k: int):
    """Groups of blocks and chunks of queries that meet: what may be better than found, block by block."""

    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        out = []
        q, v_q, floor = _longs(chunks.column("q")), _matrix(chunks.column("v_q"), d), np.frombuffer(b"".join(chunks.column("floor").to_pylist()))
        u_q = _unit(v_q) if len(q) else v_q
        for block in blocks.to_pylist():
            v = np.frombuffer(block["v"], np.float64).reshape(-1, d)
            u = _unit(v)
            center = u.mean(axis=0)
            radius = np.sqrt(((u - center) ** 2).sum(axis=1).max())
            open_ = np.flatnonzero(u_q @ center + radius >= floor - 1e-9)
            out.append(_best(q[open_], np.frombuffer(block["vec"], np.int64), np.frombuffer(block["least"], np.int64), v, v_q[open_], k, floor[open_]))
        return pa.Table.from_batches(out or [_best(q[:0], q[:0], q[:0], v_q[:0], v_q[:0], k)])

    return run


def _checks(packs: DataFrame, found: DataFrame, d: int, k: int, block: int) -> DataFrame:
    """Hits of an exact check over the first ordering."""
    first = packs.where("ordering = 0").withColumn("group", F.expr(f"home div {BLOCKS}"))
    groups = first.groupBy("group").applyInArrow(_summary(d), "group long, center array<double>, radius double")
    n, asking = first.agg(F.max("home"), F.sum("n_asks")).first()
    each = max(1, CHUNK * (n + 1) // max(1, asking))  # blocks that have about CHUNK queries
    reached = found.groupBy("q").agg(F.min("score").alias("least_score"), F.count("*").alias("n"))

    def singly(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack in b.to_pylist():
                q, v = np.frombuffer(pack["q"], np.int64), np.frombuffer(pack["v_q"], np.float64).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), pack["home"] // each, np.int64)), pa.array([x.tobytes() for x in v], pa.binary())], ["q", "chunk", "v"])

    asked = first.where("n_asks > 0").select("home", "q", "v_q").mapInArrow(singly, "q long, chunk long, v binary").join(reached, "q", "left")
    asked = asked.select("q", "chunk", "v", F.when(F.col("n") >= k, F.col("least_score")).otherwise(-2.0).alias("floor"))
    chunks = stored(asked.groupBy("chunk").applyInArrow(_chunked(d), "chunk long, q binary, v_q binary, floor binary, least_floor double, center_q array<double>, radius_q double"), "chunks")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    bound = dot("center", "center_q") + F.col("radius") * norm("center_q") + F.col("radius_q") * norm("center") + F.col("radius") * F.col("radius_q")
    every = F.sequence(F.lit(0).cast("long"), F.lit(n // BLOCKS).cast("long"))
    pairs = chunks.select("chunk", "least_floor", "center_q", "radius_q", F.explode(every).alias("group")).join(groups, "group").where(bound >= F.col("least_floor") - 1e-6)
    pairs = stored(pairs.select("group", "chunk", F.expr(f"chunk div {CHUNKS}").alias("several")), "open")
    left = first.select("group", "vec", "least", "v").join(pairs.select("group", "several").distinct(), "group")
    right = chunks.select("chunk", "q", "v_q", "floor").join(pairs, "chunk").select(F.col("group").alias("group_q"), F.col("several").alias("several_q"), "q", "v_q", "floor")
    return left.groupBy("group", "several").cogroup(right.groupBy("group_q", "several_q")).applyInArrow(_checked(d, k), HITS)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, orderings: int = ORDERINGS, window: int = WINDOW, block: int = BLOCK, probes: int = PROBES, share: float = SHARE, complete: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest other rows; without `complete`, of the curves only."""
    rows, d = usable(vectors, id_col, vector_col, is_query)
    rows = stored(rows, "vectors")
    classes = classed(rows, k)
    wide = max(window, reach(classes, d, k, orderings, probes, share))
    sort = ("ordering", "key", "vec")
    along = classes.select("vec", "least", "asks", "v").mapInArrow(tidy(_keyed(d, orderings)), "ordering int, key long, vec long, least long, asks boolean, v binary")
    pieces = min(MOST_PARTITIONS, parts(classes.count() * orderings * (8 * d + 64), PARTITION_BYTES))
    packs = stored(along.repartitionByRange(pieces, *sort).sortWithinPartitions(*sort).mapInArrow(tidy(_packed(block)), PACKED), "packs")
    sizes = packs.groupBy("ordering", "part").agg(F.sum("n").alias("rows"))
    past = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("ordering", "part", F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("base"))
    packs = packs.join(sizes, ["ordering", "part"]).withColumn("begin", F.col("base") + F.col("begin")).withColumn("home", F.expr(f"begin div {block}"))
    packs = packs.drop("base", "part")
    # A block begins less than a block's rows before the rows it has; queries go to all that may have a row within reach.
    asked = packs.where("n_asks > 0").select("ordering", "begin", "n", "q", "v_q")
    low, high = F.greatest(F.expr(f"(begin - {wide + block}) div {block}"), F.lit(0)), F.expr(f"(begin + n + {wide}) div {block}")
    several = -(-(2 * wide + 3 * block) // block // PACKS) or 1
    asked = asked.select("ordering", "q", "v_q", F.pmod(F.expr(f"begin div {block}"), F.lit(several)).alias("several"), F.explode(F.sequence(low, high)).alias("home"))
    met = packs.select("ordering", "home", "vec", "least", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(several - 1).cast("long"))).alias("several"))
    by = ("ordering", "home", "several")
    asked = asked.withColumnsRenamed({x: f"{x}_q" for x in by})
    near = stored(_top(met.groupBy(*by).cogroup(asked.groupBy(*(f"{x}_q" for x in by))).applyInArrow(_met(d, k + 1), HITS), k + 1), "near")
    hits = near.select("q", "c", "least", "score")
    if complete and not near.isEmpty():
        hits = hits.union(_checks(packs, hits, d, k + 1, block))
    best = _top(hits, k + 1).select("q", "c", "score").join(classes.select(F.col("vec").alias("c"), F.explode("ids").alias("vec_id")), "c")
    asking = rows.where("is_query").select(F.col("id").alias("query_id"), "v").distinct().join(classes.select(F.col("vec").alias("q"), "v"), "v").select("query_id", "q")
    one = asking.join(best, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT vec_id, e, list_dot_product(e, e) AS n FROM v),
d AS (SELECT * FROM n WHERE n > 0 AND len(e) = (SELECT len(e) FROM n GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(greatest(-1, least(1, list_dot_product(q.e, c.e) / sqrt(q.n * c.n)))) AS score
      FROM d q JOIN d c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
