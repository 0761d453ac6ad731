"""Helpers that the text operators share: Arrow buffers as numpy arrays, rolling hashes, shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles; a longer document is handled alone.
SLICE_BYTES = 1 << 19
#: Copies of a repeated row that one array holds.
COPY_RUN = 100_000
#: Two primes below 2**31 and a base for each, drawn at random once: a hash is a polynomial over each of the two fields.
_PRIMES = (2147483629, 2147483587)
_BASES = (1288490189, 873511403)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_sample(df: DataFrame, order: Column, rows: int, size: int, text: str = "text", once: bool = False) -> DataFrame:
    """Rows of df with their whole texts, for learning on the driver: of the `rows` whose number `order` is least those that fit into `size` bytes of text, in that order; one that doesn't fit any more is passed over.

    Rows of equal numbers are taken together or not at all; once=True is for numbers that tell texts apart: of each text one row counts and is returned.
    """
    key = free_name(df, "__key")
    keyed = df.withColumn(key, order)
    heads = keyed.select(key, F.coalesce(F.octet_length(text), F.lit(0)).alias("size")).groupBy(key).agg((F.max if once else F.sum)("size").alias("size")).orderBy(key).limit(rows).collect()
    chosen, total = [], 0
    for row in heads:
        if total + row["size"] <= size:
            chosen.append((row[0],))
            total += row["size"]
    picked = df.sparkSession.createDataFrame(chosen, f"`{key}` long")
    out = keyed.join(F.broadcast(picked), key, "left_semi").drop(key)  # at most `rows` numbers
    return out.dropDuplicates([text]) if once else out


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Returns free memory of Arrow's pool and of the C library to the system: Spark keeps a Python worker for later stages, with all that earlier ones have left in it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes."""
    data, at = byte_view(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _power_column(base: int, prime: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n].astype(np.uint32)


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the base's powers and their inverses."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        _powers[:] = [(_power_column(b, p, size), _power_column(pow(b, -1, p), p, size)) for b, p in zip(_BASES, _PRIMES, strict=True)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> list[np.ndarray]:
    """Sums, one array for each prime, from which range_hash gets the hash of any byte range."""
    n, plus, out = len(data), data.astype(np.uint64), []
    plus += np.uint64(1)
    for (up, _), prime in zip(powers(n), _PRIMES, strict=False):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.multiply(plus, up[:n], out=sums[1:])
        if n > 1 << 23:  # smaller sums of whole products stay below 2**63
            sums %= np.uint64(prime)
        np.cumsum(sums, out=sums)
        out.append(sums)
    return out


def range_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of 62 bits, mixed, of the byte ranges [start, end); equal bytes give equal hashes wherever they stand."""
    halves = [(s[end] - s[start]) % np.uint64(p) * down[start] % np.uint64(p) for s, (_, down), p in zip(sums, powers(len(sums[0])), _PRIMES, strict=False)]
    return mix((halves[0] << np.uint64(31)) ^ halves[1] ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_HEAD_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _heads(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of each range, or all of a shorter one, as a number."""
    wide = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    return wide[start].view("<u8")[:, 0] & _HEAD_MASKS[np.minimum(length, 8)]


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of a and b that start there and have the given lengths hold the same bytes."""
    if not len(length):
        return np.zeros(0, bool)
    same = _heads(a, a_start, length) == _heads(b, b_start, length)
    long = length > 4096
    for i in np.flatnonzero(long).tolist():
        same[i] = np.array_equal(a[a_start[i] : a_start[i] + length[i]], b[b_start[i] : b_start[i] + length[i]])
    rows = np.flatnonzero(same & ~long & (length > 8))
    total = np.cumsum(length[rows])
    for low in range(0, int(total[-1]) if len(total) else 0, 1 << 18):
        part = rows[np.searchsorted(total, low, side="right") : np.searchsorted(total, low + (1 << 18), side="right")]
        at = ranges(a_start[part], length[part])
        other = at + np.repeat(b_start[part] - a_start[part], length[part])
        bad = np.flatnonzero(a[at] != b[other])
        if len(bad):
            same[part[np.searchsorted(np.cumsum(length[part]), bad, side="right")]] = False
    return same


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct number, in the order of these places, and which of these each number is."""
    which, kinds = pd.factorize(keys)
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, which


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct byte range, and which of these each range is. Hashes only lead to it: ranges of one hash are compared byte by byte."""
    first, which = grouped(hashes)
    rows = np.flatnonzero(first[which] != np.arange(len(start)))
    of, size = first[which[rows]], end[rows] - start[rows]
    same = size == end[of] - start[of]
    same[same] = same_bytes(data, start[rows[same]], data, start[of[same]], size[same])
    if not same.all():
        apart: dict[bytes, int] = {}
        more = []
        for i in rows[~same].tolist():
            key = data[start[i] : end[i]].tobytes()
            if key not in apart:
                apart[key] = len(first) + len(more)
                more.append(i)
            which[i] = apart[key]
        first = np.append(first, more)
    return first, which


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (length[i] numbers) for each i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def repeated(df: DataFrame, copies: str, number: str | None = None) -> DataFrame:
    """Each row of df as often as its column copies says, without that column but with its number if a name is given; no array holds more than COPY_RUN of them."""
    step, copy = free_name(df, "first"), number or free_name(df, "copy")
    runs = df.withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies).cast("long") - 1, F.lit(COPY_RUN).cast("long"))))
    each = runs.withColumn(copy, F.explode(F.sequence(F.col(step), F.least(F.col(copies).cast("long"), F.col(step) + COPY_RUN) - 1)))
    return each.drop(step, copies, *(() if number else (copy,)))


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """data cut at the offsets, as a binary array."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
