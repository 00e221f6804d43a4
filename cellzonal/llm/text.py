"""Words, hashes and scratch tables that several operators share.

Texts are handled as UTF-8 bytes: both word patterns of the operators split at ASCII
characters only, so bytes and code points give the same words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cellzonal.session import shared_folder

#: Words `[^\x20\x09-\x0D]+`: what is between ASCII white space, as bytes.split() has it.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks all but digits, letters and what is not ASCII.
TERMS = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_BYTES = _BYTES[np.frombuffer(LOWER, np.uint8)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words, and of words of letters, digits and what is not ASCII.
WORD_BYTE = np.array([b not in SPACES for b in range(256)])
TERM_BYTE = np.array([TERMS[b] != 32 for b in range(256)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[0] == at[-1]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(
    batches: Iterator[pa.RecordBatch], text: int | str = "text", limit: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about half a megabyte of text, or one row, each with its bytes.

    Arrays of eight bytes a letter then stay within a few megabytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            part = at[start : end + 1]
            yield batch.slice(start, end - start), data[part[0] : part[-1]], part - part[0]
            start = end
        del batch, data
        pa.default_memory_pool().release_unused()


#: Rows of text that go to a worker at once; Spark's own 10 000 can be a hundred megabytes.
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Text goes to workers a few rows at once, unless the session asks for fewer still."""
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS or int(spark.conf.get(BATCH_KEY)) <= 0:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def word_hashes(
    data: np.ndarray, at: np.ndarray, kept: np.ndarray = WORD_BYTE, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, lower-cased or not, and where each row's words begin."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    inside = kept[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = at[:-1]
    before[firsts[firsts < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    letters = data[inside]
    # Where each word begins among the letters only.
    first = np.cumsum(inside)[start] - 1
    length = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    sums = np.add.reduceat((_LOWER_BYTES if lower else _BYTES)[letters] * power[place], first)
    return mix(sums + length.astype(np.uint64)), np.searchsorted(start, at)


def shingle_rows(
    data: np.ndarray, at: np.ndarray, width: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles, repeats included, and where each row begins.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    words, bounds = word_hashes(data, at)
    counts = np.diff(bounds)
    windows = np.zeros(max(len(words), 1), np.uint64)
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        if n > 0:
            total = np.zeros(n, np.uint64)
            for j in range(width):
                total = total * _BASE + words[j : n + j]
            windows[:n] = mix(total)
        for row in np.flatnonzero((counts > 0) & (counts < width)):
            total = np.uint64(counts[row])
            for h in words[bounds[row] : bounds[row + 1]]:
                total = total * _BASE + h
            windows[bounds[row]] = mix(np.array([total]))[0]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return windows, np.stack([bounds[:-1], bounds[:-1] + sizes], 1)


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit hash of a set, whatever its order."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(values))])).view(np.int64)[0])


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a null id counts as an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """Remainder of the id's checksum, which splits rows into learning and held out."""
    return F.crc32(id_text(column)) % modulus


def with_columns(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further columns behind."""
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """The name, with underscores behind it as long as a column has it; case is no difference."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names, which an operator needs itself, under free ones.

    The second value maps each free name to the column's own; put_back() takes it.
    """
    wanted = {n.lower() for n in names}
    aside: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in wanted:
            aside[free_name(f"own_{c}", [*df.columns, *aside])] = c
    back = {c: free for free, c in aside.items()}
    return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns]), aside


def put_back(df: DataFrame, aside: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """The columns that were there before set_aside(), under their own names."""
    free = {c: name for name, c in aside.items()}
    return df.select(*[F.col(f"`{free.get(c, c)}`").alias(c) for c in columns])


class Scratch:
    """Tables in the cluster's shared folder, gone when their run no longer needs them."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The table written once and read back, which cuts its lineage."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
