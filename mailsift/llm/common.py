"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.session import ensure_checkpoint_dir, ship_package

ROWS_PER_BATCH = "1000"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and bound the rows of an Arrow batch (whole texts travel in them)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_struct(df: DataFrame, text_col: str, name: str, fields: list[tuple[str, T.DataType, pa.DataType]],
                  make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """All columns of ``df`` plus, as the last one, the struct column ``name`` (made fresh if taken) that ``make()`` computes from each whole text.

    ``make`` runs once per task and returns the per-text function, so tables it builds are kept for the task.
    """
    name = fresh(df, name)
    struct = T.StructType([T.StructField(n, t) for n, t, _ in fields])
    schema = T.StructType([*df.schema.fields, T.StructField(name, struct)])
    at = df.columns.index(text_col)
    arrow = [pa.field(n, t) for n, _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                rows = [one(t) for t in b.column(at).to_pylist()]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                out = pa.StructArray.from_arrays(columns, fields=arrow)
                yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes (``bytes.split`` parts at exactly these six characters)."""
    return text.encode().split() if text else []


MASK = (1 << 64) - 1


class Windows:
    """Polynomial hashes of all windows of a sequence of 64-bit values, modulo 2**64.

    The values are mixed 64-bit hashes, so two independent odd bases give 128 bits for a window.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(b, k, 1 << 64))]))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), equal for equal contents at any place."""
        return (prefix[end] - prefix[start]) * self.inverses[start]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def sha256_joined(column) -> F.Column:
    """Lowercase hex SHA-256 of an array of strings joined by commas."""
    return F.sha2(F.array_join(column, ","), 256)
