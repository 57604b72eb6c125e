"""Near-duplicate groups by min-max hashing, every link confirmed on the full shingle sets.

A document's set holds the hashes of its distinct k-word shingles, A-Z lower-cased (with fewer words, of the whole
sequence). Each permutation gives two signature values, its minimum and its maximum, so a signature of 2P values costs
P hash evaluations. Bands of signature values propose candidates: at the default 16 bands of 4, a pair at a similarity
of 0.85 is missed with probability 8e-6, more similar pairs more rarely.

Candidates are confirmed in groups, not pairs. Documents with equal sets form a class with one representative.
Representatives in a bucket are grouped under its smallest member; a group is dealt into tiles of bounded size, which all
hold the same few `centres` of the group besides. In a tile all links are found exactly, without comparing all pairs (see
`linked`), and each member reports one link to the smallest it is connected with. In a group of several tiles nearly all
members are then connected by way of the centres. Two members whose link is still to be found cannot both be in the
group's largest component, so only the members outside it go on: their tiles meet all tiles of the group. Components of
all these links are the near-duplicate groups.

At scale: a task holds a tile or two whatever the group's size. A giant group is read as often as the members that its
centres don't reach fill tiles, which is seldom; the square of its tiles is needed only where nearly nothing is linked.

Defined cases: null and wordless texts have an empty set and are linked with nothing; rows with a null id are kept and
linked with nothing (component null); rows that share an id are one node of the graph, each with its own row in the
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import by_size, byte_texts, stored, tidy
from .components import components

SHINGLE, BANDS, ROWS = 5, 16, 4
CHUNK_BYTES, TILE_SHINGLES, CENTRES = 1 << 20, 25_000, 8
FEATURES = "id long, n_shingles long, h1 long, h2 long, bands array<long>"


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, ascending within a text, and the offsets of each text."""
    words = kernel.words(texts, lower=True)
    h, first = words.hashes(), words.first
    total, sizes = len(h), np.diff(words.first)
    inside = kernel.inside(first, k, total)
    values, owner = kernel.windows(h, k)[inside], words.text_of[: len(inside)][inside]
    if len(short := np.flatnonzero((sizes > 0) & (sizes < k))):
        values = np.concatenate([values, *(kernel.windows(h[first[i] : first[i + 1]], int(sizes[i])) for i in short)])
        owner = np.concatenate([owner, short])
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.uint32), kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def min_max(values: np.ndarray, begins: np.ndarray, permutations: int) -> np.ndarray:
    """For each nonempty set (values from begins[i] on), the minima and then the maxima under each permutation."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    factors = np.random.default_rng(7).integers(0, 1 << 31, (permutations, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((2 * permutations, len(begins)), np.uint32)
    for i, (a, b) in enumerate(factors):
        x = short * a
        x ^= x >> np.uint32(15)
        x *= b
        out[i] = np.minimum.reduceat(x, begins)
        out[permutations + i] = np.maximum.reduceat(x, begins)
    return out


def _features(k: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", CHUNK_BYTES):
            values, first = shingle_sets(byte_texts(batch.column("text")), k)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(full), bands), np.uint64)
            h = np.zeros((2, len(sizes)), np.uint64)
            if len(full):
                signature = min_max(values, first[:-1][full], bands * rows // 2).astype(np.uint64)
                for band in range(bands):
                    key = np.full(len(full), band, np.uint64)
                    for row in signature[band * rows : band * rows + rows]:
                        key = kernel.mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
                    keys[:, band] = key
                for i, salt in enumerate((1, 2)):
                    h[i, full] = kernel.mix(np.add.reduceat(kernel.mix(values ^ np.uint64(salt)), first[:-1][full]))
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), lists], ["id", "n_shingles", "h1", "h2", "bands"])

    return run


def linked(sets: list[np.ndarray], least: int) -> np.ndarray:
    """For each set the smallest index it is connected with, by links of similarity >= least %; exact.

    Sets are written as differences from the elements most of them hold. With d the size of a set's difference, n its
    own size and o the overlap of two differences, two sets are linked just when v1 + v2 + 2 (100 + least) o >= 0 for
    v = (100 - least) n - (100 + least) d. The overlap only helps: all sets with v at least -max(v) are linked with the
    set that has max(v). Only the others need overlaps, which postings of the differences give.
    """
    m = len(sets)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    elements, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    center = counts * 2 > m
    held = np.bincount(owner[center[place]], minlength=m)
    v = (100 - least) * sizes - (100 + least) * (sizes + center.sum() - 2 * held)
    top = int(np.argmax(v))
    star = v + v[top] >= 0
    star[top] = True
    for i in np.flatnonzero(star):
        union(int(i), top)
    if star.all():
        return np.array([find(i) for i in range(m)])
    plain = ~center[place] & (counts[place] > 1)
    at = np.flatnonzero(center)
    number = np.cumsum(center) - 1
    lack = np.ones((len(at), m), bool)
    inside = center[place]
    lack[number[place[inside]], owner[inside]] = False
    lacking, lacker = np.nonzero(lack)
    element, who = np.concatenate([place[plain], at[lacking]]), np.concatenate([owner[plain], lacker])
    order = np.argsort(element, kind="stable")
    element, who = element[order], who[order]
    posting = np.searchsorted(element, np.arange(len(elements) + 1))
    mine = np.argsort(who, kind="stable")
    of = np.searchsorted(who[mine], np.arange(m + 1))
    for i in np.flatnonzero(~star):
        own = element[mine[of[i] : of[i + 1]]]
        begin, n = posting[own], posting[own + 1] - posting[own]
        total = int(n.sum())
        if not total:
            continue
        spread = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        overlap = np.bincount(who[spread], minlength=m)
        close = v[i] + v + 2 * (100 + least) * overlap >= 0
        close[i] = False
        for j in np.flatnonzero(close):
            union(int(i), int(j))
    return np.array([find(i) for i in range(m)])


def _links(k: int, least: int):
    """Links of each tile; rows come sorted by tile."""

    def flush(group: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(group).combine_chunks()
        tiles = np.stack([table.column(x).to_numpy() for x in ("pivot", "t", "u")])
        begins = np.flatnonzero(np.concatenate(([True], (tiles[:, 1:] != tiles[:, :-1]).any(0)))) if table.num_rows else np.zeros(0, np.int64)
        done = table.num_rows if whole else int(begins[-1])
        a, b = [], []
        ids = table.column("id").to_numpy()
        bounds = np.append(begins[begins < done], done)
        n = pa.compute.binary_length(table.column("text")).to_numpy()
        at = 0
        while at < len(bounds) - 1:
            to = at + 1
            while to < len(bounds) - 1 and n[bounds[at] : bounds[to + 1]].sum() <= CHUNK_BYTES:
                to += 1
            low = bounds[at]
            values, first = shingle_sets(byte_texts(table.column("text").slice(low, bounds[to] - low).combine_chunks()), k)
            for begin, end in zip(bounds[at:to] - low, bounds[at + 1 : to + 1] - low, strict=True):
                own = np.argsort(ids[low + begin : low + end], kind="stable") + begin
                if len(own) > 1:
                    found = linked([values[first[i] : first[i + 1]] for i in own], least)
                    other = np.flatnonzero(found != np.arange(len(own)))
                    a.append(ids[low + own[other]])
                    b.append(ids[low + own[found[other]]])
            at = to
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])
        return out, table.slice(done).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if size >= 8 * CHUNK_BYTES:
                out, group = flush(group, False)
                size = sum(x.nbytes for x in group)
                yield out
        if group:
            yield flush(group, True)[0]

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (its own id is that)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = stored(texts.mapInArrow(tidy(_features(k, bands, rows)), FEATURES), "features")
    able = features.where("id IS NOT NULL AND n_shingles > 0")
    classes = stored(able.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"), F.min("bands").alias("bands")), "classes")
    keyed = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = keyed.join(buckets, "key").select("pivot", "rep", "n_shingles").distinct()
    tiles = members.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / F.lit(TILE_SHINGLES)).alias("tiles"))
    members = stored(members.join(tiles, "pivot").withColumn("x", F.pmod(F.xxhash64("rep"), F.col("tiles"))), "members")
    bodies = stored(members.select(F.col("rep").alias("id")).distinct().join(texts.where("text IS NOT NULL"), "id"), "bodies")

    def confirmed(dealt: DataFrame) -> DataFrame:
        met = dealt.distinct().join(bodies, "id").repartition("pivot", "t", "u").sortWithinPartitions("pivot", "t", "u")
        return met.mapInArrow(tidy(_links(k, least)), "a long, b long")

    own = members.select("pivot", F.col("x").alias("t"), F.col("x").alias("u"), F.col("rep").alias("id"))
    place = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("rep"), "rep"))
    large = members.where("tiles > 1")
    centres = large.withColumn("place", place).where(F.col("place") <= CENTRES)
    centres = centres.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t"), F.col("rep").alias("id")).select("pivot", "t", F.col("t").alias("u"), "id")
    links = stored(confirmed(own.union(centres)), "links")
    roots = components(links)
    if not large.isEmpty():
        placed = large.join(roots, F.col("rep") == F.col("node"), "left").select("pivot", "rep", "n_shingles", "x", F.coalesce("component", "rep").alias("component"))
        most = placed.groupBy("pivot", "component").count().groupBy("pivot").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        left = stored(placed.join(most, "pivot").where("component <> main").select("pivot", "rep", "n_shingles"), "left")
        more = left.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / F.lit(TILE_SHINGLES)).alias("more"))
        every = F.sequence(F.lit(0).cast("long"), F.col("more") - 1)
        both = large.join(more, "pivot").select("pivot", F.explode(every).alias("t"), F.col("x").alias("u"), F.col("rep").alias("id"))
        ours = left.join(more, "pivot").join(tiles, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), F.col("more")).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("u"), F.col("rep").alias("id"))
        roots = components(roots.select("node", "component").toDF("a", "b").union(confirmed(both.union(ours))))
    reached = classes.select("h1", "h2", "n_shingles", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = features.select("id", "h1", "h2", "n_shingles").join(reached, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
