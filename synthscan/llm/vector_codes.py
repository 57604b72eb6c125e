"""Vector compression by product codes: each part of a vector becomes the number of its codebook's nearest entry.

Components are whole numbers, floor(scale * x), so sums and distances are exact and results don't hang on the order in
which partitions are added. A vector is cut into equal consecutive parts, each part's place with a codebook of its own.
Codebooks start as the parts of the smallest ids and are bettered by a fixed number of rounds of k-means.

At scale: vectors are written once to the shared folder, as blocks of columns: a row holds some thousand vectors, and of
each component the values of all of them in a row. A round is a treeAggregate over the blocks. In a block, distances to all
entries are added up component by component, in a matrix of (vectors, entries) that never has a third side; sums and counts
of the entries are tensors of entries times components, whatever the number of vectors, and merge through a tree of
partial sums. Only codebooks travel to tasks and only those tensors to the driver: entries * components whole numbers,
parameters both. Blocks that are lost with an executor are read again from the shared folder.

Defined cases: rows whose vector is null or empty or holds null or non-finite components take no part, nor do vectors of
another length than the one with the smallest id, or that the parts don't divide; fewer vectors than entries make as many
entries as there are vectors; entries without vectors stay as they are; rows with a null id are coded and come first in no
codebook; of equal ids the vectors' order decides; an empty table gives an empty result. Scaled components beyond 2^62 count
as that; where squares leave 64 bits, unbounded integers are used, and errors stop at the largest long. Columns besides id,
vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and labels' salts.
BLOCK, SALTS = 2048, 16
LARGEST, LONG = float(1 << 62), (1 << 63) - 1
BLOCKS = "n int, ids binary, has_id binary, labels binary, columns array<binary>"


@dataclass
class Codebooks:
    """entries[p][d, e]: component d of entry e for part p, as whole numbers of the kind that distances need."""

    entries: list[np.ndarray]
    kind: type

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.T.ravel()).encode()).hexdigest()

    def nearest(self, columns: list[np.ndarray], part: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector of a block the number of the nearest entry, the lower one of ties, and its squared distance."""
        book = self.entries[part]
        at = part * len(book)
        total = np.zeros((len(columns[0]), book.shape[1]), self.kind)
        for d, row in enumerate(book):
            off = columns[at + d].astype(self.kind)[:, None] - row.astype(self.kind)
            off *= off
            total += off
        code = np.argmin(total, axis=1)
        return code, total[np.arange(len(code)), code]


def _kind(largest: int, width: int) -> type:
    """The narrowest whole numbers in which a squared distance of width components up to largest fits."""
    most = (2 * largest) ** 2 * width
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component: longs, or null where the vector takes no part."""
    double = vector.cast("array<double>")
    able = vector.isNotNull() & (F.size(vector) > 0) & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(able, F.transform(double, lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x * F.lit(float(scale)))))))


def _blocks(width: int):
    """Rows (id, label, vector) as blocks of columns."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        n = table.num_rows
        matrix = np.ascontiguousarray(table.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width).T)
        ids = table.column("id").chunk(0)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([table.schema.field("label")])) as writer:
            writer.write_table(table.select(["label"]))
        columns = pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array([x.tobytes() for x in matrix], pa.binary()))
        found = [pa.array([n], pa.int32()), pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()), pa.array([ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), columns]
        return pa.RecordBatch.from_arrays(found, [x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows.append(batch.slice(at, BLOCK))
                n += rows[-1].num_rows
                if n >= BLOCK:
                    yield block(rows)
                    rows, n = [], 0
        if n:
            yield block(rows)

    return run


def _columns(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in blobs]


def bettered(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """A round: each entry moves to the floor of the mean of the parts nearest to it."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(books)  # entries times components
    n, (width, size) = len(books.entries), books.entries[0].shape
    sums = object if books.kind is object else np.int64

    def zero() -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((n, width, size), sums), np.zeros((n, size), np.int64)

    def add(total, row):
        total = zero() if total is None else total
        columns = _columns(row.columns)
        for part in range(n):
            code, _ = sent.value.nearest(columns, part)
            np.add.at(total[1][part], code, 1)
            for d in range(width):
                np.add.at(total[0][part, d], code, columns[part * width + d].astype(sums))
        return total

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        a[0][...] += b[0]
        a[1][...] += b[1]
        return a

    total, count = blocks.select("columns").rdd.treeAggregate(None, add, merge) or zero()
    sent.unpersist()
    entries = [np.where(c > 0, s // np.maximum(c, 1), old).astype(old.dtype) for old, s, c in zip(books.entries, total, count, strict=True)]
    return Codebooks(entries, books.kind)


def _codes(books: Codebooks):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = _columns(row["columns"])
                found = [books.nearest(columns, part) for part in range(len(books.entries))]
                error = sum(x[1].astype(object if books.kind is object else np.int64) for x in found)
                hexed = np.stack([x[0] for x in found], axis=1)
                digits = max(2, len(f"{max(0, books.entries[0].shape[1] - 1):x}"))
                codes = ["".join(f"{x:0{digits}x}" for x in one) for one in hexed.tolist()]
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["has_id"], bool))
                labels = pa.ipc.open_stream(row["labels"]).read_all().column("label").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes), pa.array([min(x, LONG) for x in error.tolist()], pa.int64())], ["id", "label", "code", "error"])

    return run


def fitted(blocks: DataFrame, first: np.ndarray, largest: int, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the rows of `first`, a matrix of vectors, and take the rounds over the blocks."""
    width = first.shape[1] // parts
    kind = _kind(largest, width)
    books = Codebooks([np.ascontiguousarray(first[:, p * width : p * width + width].T) for p in range(parts)], kind)
    for _ in range(rounds):
        books = bettered(blocks, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per coded vector: its id, label, code, error, label_error (of all vectors with that label), codebooks_sha256."""
    q = lambda name: F.col("`" + name.replace("`", "``") + "`")
    rows = vectors.select(q(id_col).cast("long").alias("id"), q(label_col).alias("label"), whole(q(vector_col), scale).alias("vector")).where("vector IS NOT NULL")
    able = rows.where(F.size("vector") % parts == 0)
    lead = rows.where("id IS NOT NULL").orderBy("id", "vector").select(F.size("vector").alias("n")).first()
    width = lead.n if lead and lead.n % parts == 0 else 0
    able = able.where(F.size("vector") == width)
    kind = dict(able.dtypes)["label"]
    schema = f"id long, label {kind}, code string, error long"
    spark = vectors.sparkSession
    if not width:
        out = spark.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
        return out.withColumnRenamed("id", id_col)
    first = np.array([r.vector for r in able.where("id IS NOT NULL").orderBy("id", "vector").select("vector").limit(entries).collect()], np.int64)  # entries of them
    largest = able.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0]
    blocks = stored(able.mapInArrow(tidy(_blocks(width)), BLOCKS), "blocks")
    books = fitted(blocks, first, largest, parts, rounds)
    coded = blocks.mapInArrow(tidy(_codes(books)), schema)
    coded = stored(coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")), "codes")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(30,0)")).cast("long").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = sums.select(F.col("label").alias("_label"), F.col("_salt").alias("_of"), "label_error")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of")))
    return joined.select(F.col("id").alias(id_col), "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL, its rounds written out."""
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT vec_id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) t(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"near{i} AS (SELECT vec_id, p, x, min(struct_pack(d := d, e := e)) AS m FROM (SELECT vec_id, p, x, e, "
            f"list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{i} USING (p)) GROUP BY vec_id, p, x)"
        )
        if i < ROUNDS:
            steps.append(
                f"sums{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM (SELECT p, m.e AS e, k, sum(x[k]) AS s, count(*) AS n "
                f"FROM near{i}, range(1, (SELECT max(len(x)) FROM parts) + 1) t(k) GROUP BY p, m.e, k) GROUP BY p, e)"
            )
            steps.append(f"book{i + 1} AS (SELECT p, e, coalesce(s.c, b.c) AS c FROM book{i} b LEFT JOIN sums{i} s USING (p, e))")
    return (
        "WITH " + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)
        + f", coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id) "
        f"SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 "
        "FROM coded JOIN kept USING (vec_id)"
    )


ORACLE = _oracle()
