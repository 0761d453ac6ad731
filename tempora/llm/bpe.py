"""BPE encoding and decoding of whole texts with contiguous rank arrays.

A word is held as an array of part ids beside an array of the ranks of its adjacent pairs. Each
round scans the ranks for the least, deletes the boundary there and looks up the two ranks beside
it. Words of like length are handled as the rows of one matrix; a long word's ranks lie in blocks
whose minima are scanned first. Only distinct pre-tokens are encoded, and each Python worker keeps a
bounded table of those that it has seen: hashes lead to an entry, its bytes decide.

Nulls are empty texts. The string of the special token inside a text is that token, as is the
library's default. Texts and words of any length are encoded whole. Repeated rows and rows without an id are
encoded each for itself; an empty table gives no rows. Of pairs of equal rank, which a word that repeats itself has, the leftmost is merged. Other columns of df pass through; those that have the name
of an output column don't. Tokenizer files with other settings than plain byte-level BPE are refused.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import pretokens
from tempora.llm.common import binary_array, byte_view, distinct, give_back, prefix_sums, range_hash, ranges, read, same_bytes, slices

NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens and their bytes that a worker remembers, and the longest words that matrices hold.
CACHE_WORDS, CACHE_BYTES, MATRIX_BYTES = 400_000, 16 << 20, 48


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def special_token(file: dict) -> tuple[bytes, int]:
    """The added token of a tokenizer file and its id; refuses files whose settings this encoder doesn't follow."""
    added = file.get("added_tokens") or []
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not file.get("normalizer")
    plain &= model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or len(added) > 1 or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only byte-level BPE without a normalizer, with one plain added token at most, is encoded here")
    return (added[0]["content"].encode(), added[0]["id"]) if added else (b"", -1)


class Vocabulary:
    """Byte strings of all ids and, for pairs of ids, ranks and the ids that they merge to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs = _byte_signs()
        ids = {bytes(signs[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if all(c in signs for c in piece)}
        self.special, self.special_id = special_token(file)
        if self.special:
            ids[self.special] = self.special_id
        size = max(ids.values()) + 1
        self.pieces = [b""] * size
        for piece, i in ids.items():
            self.pieces[i] = piece
        self.piece_length = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_length)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        to_bytes = lambda piece: bytes(signs[c] for c in piece)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        left, right = ([ids[to_bytes(p[k])] for p in pairs] for k in (0, 1))
        key = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(key)
        self.size, self.keys = size, np.append(key[order], np.iinfo(np.int64).max)
        self.key_rank = np.append(order, NONE).astype(np.int32)
        self.merged = np.array([ids[to_bytes(a) + to_bytes(b)] for a, b in pairs], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.key_rank[i], NONE)

    def encode_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row of byte ids for each word, all of one length. Merged ids, and how many of each row count."""
        rows, width = ids.shape
        out, size = ids.copy(), np.full(rows, width, np.int64)
        live, ranks = np.arange(rows), self.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((rows, 1), NONE)
        ids, column = ids.copy(), np.arange(width)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            go = best < NONE
            if not go.all():
                done = ~go
                out[live[done], : ids.shape[1]] = ids[done]
                live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
                if not len(live):
                    break
            row, width = np.arange(len(live)), ids.shape[1]
            ids[row, at] = self.merged[best]
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)  # the boundary after `at` goes
            size[live] -= 1
            if width == 2:
                out[live, :1] = ids
                break
            column = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self.ranks(ids[has, at[has]], ids[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.ranks(ids[has, at[has] - 1], ids[has, at[has]])
            # Columns past a row's parts don't exist here: every live row has lost one boundary in each round.
        return out, size

    def pair_rank(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id by pair, for words that are encoded one merge at a time."""
        if not hasattr(self, "_pair_rank"):
            known = self.keys[:-1].tolist()
            ranks = self.key_rank[:-1]
            self._pair_rank = dict(zip(known, zip(ranks.tolist(), self.merged[ranks].tolist(), strict=True), strict=True))
        return self._pair_rank

    def encode_long(self, ids: np.ndarray) -> np.ndarray:
        """One word of any length. Its ranks lie in blocks, so a round scans the blocks' minima and one block, not the word."""
        n, size, pair_rank = len(ids), self.size, self.pair_rank()
        block = max(32, math.isqrt(n))
        ranks = np.full(-(-n // block) * block, NONE)  # of each part and the one after it; NONE where none follows or it's gone
        ranks[: n - 1] = self.ranks(ids[:-1], ids[1:])
        rows = ranks.reshape(-1, block)
        least = rows.min(1)
        parts, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))
        while True:
            b = int(least.argmin())
            if least[b] == NONE:
                return np.array([p for p in parts if p >= 0], np.int32)
            i = b * block + int(rows[b].argmin())
            j = after[i]
            parts[i], parts[j] = pair_rank[parts[i] * size + parts[j]][1], -1
            after[i] = after[j]  # the boundary before j goes
            before[after[i]] = i
            ranks[j] = NONE
            touched = {b, j // block}
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0:
                    ranks[x] = pair_rank.get(parts[x] * size + parts[y], (NONE,))[0] if y < n else NONE
                    touched.add(x // block)
            for b in touched:
                least[b] = rows[b].min()

    def encode_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at the given places, one after another, and their counts."""
        counts = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids, the words' counts
        for size in np.unique(length):
            words = np.flatnonzero(length == size)
            if size <= MATRIX_BYTES:
                for part in np.array_split(words, max(1, len(words) * int(size) // 400_000)):
                    ids, kept = self.encode_rows(self.of_byte[data[start[part][:, None] + np.arange(size)]])
                    found.append((part, ids[np.arange(size) < kept[:, None]], kept))
            else:
                for word in words:
                    ids = self.of_byte[data[start[word] : start[word] + size]]
                    ids = self.encode_long(ids)
                    found.append((np.array([word]), ids, np.array([len(ids)])))
        for words, _, kept in found:
            counts[words] = kept
        at = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for words, ids, kept in found:
            flat[ranges(at[words], kept)] = ids
        return flat, counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches and remembers the distinct pre-tokens of those before, up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.flat, self.data = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.start, self.count, self.word, self.length = (np.zeros(0, np.int64) for _ in range(4))

    def _known(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero((self.hashes[i] == hashes) & (self.length[i] == length))
        rows = rows[same_bytes(data, start[rows], self.data, self.word[i[rows]], length[rows])]
        out = np.full(len(hashes), -1)
        out[rows] = i[rows]
        return out

    def _remember(self, hashes: np.ndarray, data: np.ndarray, word: np.ndarray, length: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        at = len(self.data) + np.cumsum(length) - length
        self.data = np.concatenate([self.data, data[ranges(word, length)]])
        new = ((self.hashes, hashes), (self.start, start), (self.count, count), (self.word, at), (self.length, length))
        self.hashes, self.start, self.count, self.word, self.length = (np.concatenate(x)[order] for x in new)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after another, and the offsets of the documents' ids."""
        cuts, special = pretokens.split(data, at, self.vocabulary.special)
        start, length = cuts[:-1], np.diff(cuts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        hashes = range_hash(prefix_sums(data), start, cuts[1:])
        first, word_of = distinct(data, start, cuts[1:], hashes)
        hashes, word, size = hashes[first], start[first], length[first]
        entry = self._known(hashes, data, word, size)
        if (entry < 0).any() and (len(self.hashes) + len(hashes) > CACHE_WORDS or len(self.data) > CACHE_BYTES):
            self.clear()
            entry[:] = -1
        new = np.flatnonzero(entry < 0)
        flat, n_ids = self.vocabulary.encode_words(data, word[new], size[new])
        begin, count = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        begin[entry >= 0], count[entry >= 0] = self.start[entry[entry >= 0]], self.count[entry[entry >= 0]]
        begin[new], count[new] = len(self.flat) + np.cumsum(n_ids) - n_ids, n_ids
        self.flat = np.concatenate([self.flat, flat])
        if len(new):
            self._remember(hashes[new], data, word[new], size[new], begin[new], n_ids)
        begin, count = begin[word_of], count[word_of]
        if special.any():
            begin, count = np.where(special, len(self.flat), begin), np.where(special, 1, count)
        ids = np.append(self.flat, np.int32(self.vocabulary.special_id))[ranges(begin, count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(start, at)]


def _pass_through(batch: pa.RecordBatch, drop: set[str]) -> tuple[list[pa.Array], list[str]]:
    names = [n for n in batch.schema.names if n not in drop]
    return [batch.column(batch.schema.names.index(n)) for n in names], names


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", keep_text: bool = False, layout: str = "array") -> DataFrame:
    """df with its texts' token ids, as array<int> or (layout "le32") as binary of little-endian 32-bit numbers, and their count."""
    drop = {ids, count} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{ids}` {'array<int>' if layout == 'array' else 'binary'}", f"`{count}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            give_back()
            for a, b, data, at in slices(batch.column(batch.schema.names.index(text))):
                flat, ends = encoder.encode(data, at)
                if layout == "array":
                    values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                else:
                    values = binary_array(flat.astype("<u4").view(np.uint8), ends * 4)
                columns, names = _pass_through(batch.slice(a, b - a), drop)
                yield pa.RecordBatch.from_arrays([*columns, values, pa.array(np.diff(ends))], [*names, ids, count])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the ids (array<int>, or binary of little-endian 32-bit numbers) replaced by the text that they stand for."""
    kept = [f for f in df.schema.fields if f.name not in (ids, text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            if pa.types.is_list(column.type):
                numbers = column.flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            else:
                raw, at = byte_view(column)
                numbers, at = raw.view("<u4") if len(raw) else np.zeros(0, np.uint32), at // 4
            row, n = 0, len(at) - 1
            while row < n:
                end = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 18), side="right")) - 1)
                part = numbers[at[row] : at[end]].astype(np.int64)
                size = known.piece_length[part]
                data = known.piece_bytes[ranges(known.piece_start[part], size)].tobytes()
                ends = np.concatenate([[0], np.cumsum(size)])[at[row : end + 1] - at[row]].tolist()
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:], strict=False)]
                columns, names = _pass_through(batch.slice(row, end - row), {ids, text})
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, text])
                row = end

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, one row for each document."""
    df = df.select("doc_id", "text")
    out = encode(df, path, layout="le32").withColumn("ids_sha256", F.sha2("token_ids", 256))
    return decode(out, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
