"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

One pass gathers the distinct pre-tokens of the corpus and one task each counts their pieces. The most
frequent of them (at most HEAD rows, whatever the corpus) are broadcast, so no frequent pre-token is a
join key; all others are joined by a shuffle on the pre-token. A document's own row goes along under a key
that no other row of its batch has, so copies of a text don't meet in the join. No ids are kept.

Nulls are empty texts with no tokens. Repeated rows are each counted and returned; rows with one id and
different texts stay apart. Rows without an id are counted like others. Texts and pre-tokens of any length are
counted whole; other columns, whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, pretokens
from tempora.llm.bpe import special_token
from tempora.llm.common import binary_array, byte_view, distinct, prefix_sums, range_hash, ranges, read, repeated, same_bytes, slices, stored

#: Most pre-tokens that are broadcast and their bytes; pre-tokens that a task gathers before it passes them on, and their bytes.
HEAD, HEAD_BYTES, FLUSH, FLUSH_BYTES = 400_000, 8 << 20, 250_000, 4 << 20


@lru_cache(maxsize=1)
def _special(path: str) -> bytes:
    with open(path, encoding="utf-8") as f:
        return special_token(json.load(f))[0]


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    return binary_array(data[ranges(start, length)], np.concatenate([[0], np.cumsum(length)]))


def _distinct(path: str):
    """Pre-tokens of a task's texts with their counts; each is passed on once for FLUSH of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = _special(path)
        hashes, counts, parts, gathered, size = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            c, pieces = np.concatenate(counts), pa.concat_arrays(parts)
            raw, at = byte_view(pieces)
            first, word = distinct(raw, at[:-1], at[1:], np.concatenate(hashes))
            return pa.RecordBatch.from_arrays([pieces.take(pa.array(first)), pa.array(np.bincount(word, c).astype(np.int64))], ["piece", "total"])

        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                cuts, _ = pretokens.split(data, at, special)
                if len(cuts) == 1:
                    continue
                h = range_hash(prefix_sums(data), cuts[:-1], cuts[1:])
                first, word = distinct(data, cuts[:-1], cuts[1:], h)
                hashes.append(h[first])
                counts.append(np.bincount(word, minlength=len(first)))
                parts.append(_gather(data, cuts[first], cuts[first + 1] - cuts[first]))
                gathered, size = gathered + len(first), size + parts[-1].nbytes
                if gathered > FLUSH or size > FLUSH_BYTES:
                    yield flush()
                    hashes, counts, parts, gathered, size = [], [], [], 0, 0
        if gathered:
            yield flush()

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bpe.vocabulary(path)
        for batch in batches:
            for a, b, data, at in slices(batch.column(0)):
                length = np.diff(at)
                _, n = known.encode_words(data, at[:-1], length)
                same = np.flatnonzero(length == len(known.special)) if known.special else np.zeros(0, np.int64)
                n[same[[data[at[k] : at[k + 1]].tobytes() == known.special for k in same.tolist()]]] = 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n)], ["piece", "total", "pieces"])

    return run


def vocabulary(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """piece, total (occurrences), pieces: the corpus's distinct pre-tokens with the tokens that each makes."""
    found = df.select(text).mapInArrow(_distinct(path), "piece binary, total bigint")
    return found.groupBy("piece").agg(F.sum("total").alias("total")).mapInArrow(_count_pieces(path), "piece binary, total bigint, pieces bigint")


class Head:
    """The most frequent pre-tokens with their pieces, by hash; their bytes decide."""

    def __init__(self, table: pa.Table):
        data, at = byte_view(table["piece"])
        parts = [range_hash(prefix_sums(d), a[:-1], a[1:]) for _, _, d, a in slices(table["piece"])]
        hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        order = np.argsort(hashes, kind="stable")
        self.data, self.start, self.length = data, at[:-1][order], np.diff(at)[order]
        self.hashes, self.pieces = hashes[order], table["pieces"].to_numpy()[order]

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pre-token is here, and its pieces or 0. One that shares its hash with another may be missed, not mistaken."""
        found, pieces = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            rows = np.flatnonzero((self.hashes[i] == hashes) & (self.length[i] == length))
            rows = rows[same_bytes(data, start[rows], self.data, self.start[i[rows]], length[rows])]
            found[rows], pieces[rows] = True, self.pieces[i[rows]]
        return found, pieces


def _head(words: DataFrame, most: int) -> Head:
    """The pre-tokens of the largest totals, by powers of two, as many as the bounds on rows and bytes allow."""
    bin_ = F.floor(F.log2("total")).alias("bin")
    bins = words.groupBy(bin_).agg(F.count("*").alias("n"), F.sum(F.octet_length("piece")).alias("size")).orderBy(F.desc("bin")).collect()
    least, n, size = 63, 0, 0
    for row in bins:
        n, size = n + row["n"], size + row["size"]
        if n > most or size > HEAD_BYTES:
            break
        least = row["bin"]
    empty = pa.table({"piece": pa.array([], pa.binary()), "pieces": pa.array([], pa.int64())})
    return Head(words.where(F.col("total") >= 2**least).select("piece", "pieces").toArrow() if least < 63 else empty)


def _digests(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _own_keys(digests: list[bytes]) -> pa.Array:
    """Join keys of documents' own rows, copies of a text under different ones. No pre-token begins with these two bytes, as they aren't UTF-8."""
    return pa.array([b"\xff\xff" + d[:8] + k.to_bytes(4, "little") for k, d in enumerate(digests)], pa.binary())


def _frequencies(path: str, broadcast):
    """A row for each document with its tokens from broadcast pre-tokens, and one for each other pre-token in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, head_words = _special(path), broadcast.value
        for batch in batches:
            for a, b, data, at in slices(batch.column(1)):
                digests = _digests(data, at)
                ids, row_id = batch.column(0).slice(a, b - a), pa.array(digests, pa.binary())
                cuts, _ = pretokens.split(data, at, special)
                start, tail_of, tail_n, tail_start, tail_size = cuts[:-1], *(np.zeros(0, np.int64),) * 4
                head = np.zeros(len(at) - 1, np.int64)
                if len(start):
                    h = range_hash(prefix_sums(data), start, cuts[1:])
                    first, word = distinct(data, start, cuts[1:], h)
                    found, weight = head_words.find(h[first], data, start[first], cuts[first + 1] - start[first])
                    total = np.concatenate([[0], np.cumsum(weight[word])])
                    token_at = np.searchsorted(start, at)
                    head = total[token_at[1:]] - total[token_at[:-1]]
                    rest = np.flatnonzero(~found[word])
                    document = np.searchsorted(token_at, rest, side="right") - 1
                    pair, tail_n = np.unique(document * len(first) + word[rest], return_counts=True)
                    tail_of, w = pair // len(first), first[pair % len(first)]
                    tail_start, tail_size = start[w], cuts[w + 1] - start[w]
                n, m = len(row_id), len(tail_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids, ids.take(pa.array(tail_of))]),
                        pa.concat_arrays([row_id, row_id.take(pa.array(tail_of))]),
                        pa.concat_arrays([_own_keys(digests), _gather(data, tail_start, tail_size)]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), tail_n])),
                        pa.concat_arrays([pa.array(np.diff(at)), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(head), pa.nulls(m, pa.int64())]),
                    ],
                    ["doc_id", "row_id", "piece", "n", "n_bytes", "head"],
                )

    return run


def token_counts(df: DataFrame, path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens), one row for each row of df."""
    spark, df = df.sparkSession, df.select("doc_id", "text")
    words = stored(vocabulary(df, path))
    broadcast = spark.sparkContext.broadcast(_head(words, head))
    rows = df.mapInArrow(_frequencies(path, broadcast), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, row_id binary, piece binary, n bigint, n_bytes bigint, head bigint")
    joined = rows.join(words.select("piece", "pieces").hint("shuffle_merge"), "piece", "left")
    summed = joined.groupBy("doc_id", "row_id").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum("head").alias("head"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(0))).alias("tail"), F.count("head").alias("copies")
    )
    n = F.expr("(head + tail) div copies")
    return repeated(summed.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "copies"), "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
