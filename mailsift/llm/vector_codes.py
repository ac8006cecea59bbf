"""Vector code compression: product codes of 16 parts with 64 entries each, learnt and assigned with exact integer products.

Components become integers floor(256 x). Squared distances are |x|^2 - 2 x.c + |c|^2: the dot products of a batch of parts
with a codebook are float64 matrix products (BLAS) of limbs. Integers are split into limbs of so few bits that the sum of a
part's products stays below 2^53, hence every product is exact; the limbs' products are shifted and added in int64, and the
first smallest distance gives the code. Values of one limb, the usual case, need one product.

Spark scans the vectors once for each round. A task adds its rows' parts up by entry and gives one row for each entry that
it met (at most parts x entries), these are summed by (part, entry), and only the codebooks, parts x entries rows, come to
the driver and go out with the next round. The last scan writes codes and errors; label sums are joined back over salted
labels, so a label with a third of the rows is spread.

Defined cases: rows with a null vector, a null or non-finite component, or another length than the vector of the smallest kept
vec_id are dropped; that length must be a multiple of the number of parts (else ValueError). The first codebook orders equal
vec_ids by their vectors and takes null ids last; with fewer rows than entries the codebooks are shorter. Components beyond
+-2^27 after scaling are cut there, so that all sums fit 64 bits. An empty table gives an empty table; repeated rows are rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import prepare, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 27
SALTS = 32
EXACT_BITS = 53


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of ``bits`` bits, the lowest first; only the last one carries the sign."""
    out = []
    while True:
        if not a.size or int(np.abs(a).max()) < 1 << bits:
            return [*out, a.astype(np.float64)]
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int64 products of the rows of ``x`` with the rows of ``c``, by float64 BLAS over limbs."""
    bits = (EXACT_BITS - x.shape[1].bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    cs = limbs(c, bits)
    for i, xi in enumerate(limbs(x, bits)):
        for j, cj in enumerate(cs):
            out += (xi @ cj.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest row of ``c`` for each row of ``x`` and the squared distance."""
    d = (c * c).sum(axis=1) - 2 * dots(x, c)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(x)), k] + (x * x).sum(axis=1)


def scaled(column: pa.ListArray | pa.LargeListArray, length: int) -> np.ndarray:
    """Integer matrix of a batch of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), length)


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, v, label) of the rows whose vector has finite components only."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"), label.alias("label")).where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray] | None:
    """The parts of the vectors of the smallest ids: a list with an (entries, part length) array for each part. The first of
    these vectors sets the length."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).select("v").first()
    if first is None:
        return None
    length = len(first.v)
    if length % parts or not length:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    least = rows.where(F.size("v") == length).orderBy(*order).limit(entries).select("v").collect()  # entries rows
    return np.split(scaled(pa.array([r.v for r in least], pa.list_(pa.float64())), length), parts, axis=1)


def learnt(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, entries to the floored means of their parts; unused ones stay."""
    parts, length = len(books), sum(b.shape[1] for b in books)
    width = length // parts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, len(books[0]), width), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, x in enumerate(np.split(scaled(batch.column(0), length), parts, axis=1)):
                    k, _ = nearest(x, books[p])
                    n[p] += np.bincount(k, minlength=n.shape[1])
                    np.add.at(total[p], k, x)
        at = np.argwhere(n)
        if len(at):
            columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[tuple(at.T)], pa.int64())]
            columns += [pa.array(total[at[:, 0], at[:, 1], j], pa.int64()) for j in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    added = rows.select("v").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{j}") for j in range(width)])
    new = [b.copy() for b in books]
    for part, entry, n, *total in added.collect():  # parts x entries rows at most
        new[part][entry] = [s // n for s in total]
    return new


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of all rows."""
    parts, length = len(books), sum(b.shape[1] for b in books)
    schema = T.StructType([*rows.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(x, b) for x, b in zip(np.split(scaled(batch.column(2), length), parts, axis=1), books)]
                each = np.stack([k for k, _ in found], axis=1).astype(np.uint8)
                error = np.sum([d for _, d in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes().hex() for k in each]),
                                                  pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(codes, schema)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The coded rows (vec_id, label, code, error, label_error) and the codebooks, one integer array for each part.

    ``entries`` is at most 256: a code has two hex digits for each part."""
    prepare(vectors.sparkSession)
    rows = kept(vectors, id_col, vector_col, label_col)
    books = first_books(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    rows = rows.where(F.size("v") == sum(b.shape[1] for b in books))
    for _ in range(rounds):
        books = learnt(rows, books)
    out = written(coded(rows, books), "codes")
    totals = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    totals = totals.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    out = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)))
    out = out.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salted")))
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    out, books = compress(vectors)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
