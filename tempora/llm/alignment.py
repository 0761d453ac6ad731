"""Alignment of two tokenizers: which tokens of A stand for which of B, how many documents link a pair, and each document's share.

The two token sequences of a text are cut into groups where tokens of both end; all pairs of a group are linked. Counting is
external: a task spills the pair-document records of RUN_BYTES of text as a run, sorted by A's id, then B's, radix-partitioned
by both and packed as zstd frames. What a run holds of a part is pre-aggregated (a pair, its number of documents), so a pair
of every document is one record a run. For each part a heap merges the runs' frames in order and counts each pair; A's id
comes first in that order, so its highest count is known when its pairs are through, and the counts stream back to the runs, which
add them up by document. The highest counts by A's id (as many as A has ids) are the only broadcast.

Texts are worked on as distinct stretches: where a pre-token of A ends and no piece of B holds the two characters there side by
side, both sequences are cut whatever else stands around, so a stretch is encoded once and remembered.

Nulls and empty texts have no tokens, nor have texts that B's pieces don't give back byte by byte. Repeated rows, rows of one
id and rows without one each count as documents. A text is whole in one task, however long; other columns aren't read. Ties for
the highest count are all best. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, pretokens
from tempora.llm.common import distinct, mix, prefix_sums, range_hash, ranges, read, slices, stored

#: Text bytes, documents and records of a run; pairs of a frame; records that one step of a merge takes; text bytes for each part; slices of a part by B's id.
RUN_BYTES, RUN_DOCS, RUN_RECORDS, FRAME, STEP, PART_BYTES, SIDES = 8 << 20, 65_000, 3_000_000, 4096, 1 << 16, 64 << 20, 4
#: Stretches and their bytes that a worker remembers.
CACHE_WORDS, CACHE_BYTES = 300_000, 8 << 20
B_BITS, DOC_BITS = 20, 16
_SPACE = 0x2581


class Pieces:
    """B's library and what its pieces say: their lengths in bytes, and which characters stand side by side in one."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        plain = [not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)) for i in range(n)]
        self.bytes = [name.replace("▁", " ").encode() if ok else bytes([int(name[3:-1], 16)]) if self.library.is_byte(i) else name.encode() for i, (name, ok) in enumerate(zip(names, plain, strict=True))]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.before = self.library.encode("\n")  # what stands before the tokens of a text after a line feed
        pairs = {(ord(a), ord(b)) for name, ok in zip(names, plain, strict=True) if ok for a, b in zip(name, name[1:], strict=False)}
        self.cuts = any(map(self.library.is_byte, range(n))) and not any(10 in p for p in pairs)  # else a text is one stretch
        self.beside = np.sort(np.array([a << 21 | b for a, b in pairs] or [0], np.int64))

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no piece can hold the two characters side by side."""
        a, b = (np.where(x == 0x20, _SPACE, x).astype(np.int64) for x in (left, right))
        code = a << 21 | b
        return self.beside[np.minimum(np.searchsorted(self.beside, code), len(self.beside) - 1)] != code

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words as they stand inside a text, one after another, and their counts."""
        found, skip = self.library.encode(["\n" + w for w in words], num_threads=1), len(self.before)
        count = np.array([len(x) - skip for x in found], np.int64)
        return np.fromiter((i for x in found for i in x[skip:]), np.int64, int(count.sum())), count


def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, one number after another, their starts and their lengths."""
    text = [str(i) for i in range(n)]
    length = np.array([len(t) for t in text], np.int64)
    return np.frombuffer("".join(text).encode(), np.uint8), np.cumsum(length) - length, length


class Aligner:
    """Stretches of text with their links, remembered up to a bound."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = bpe.vocabulary(a_path), Pieces(b_path)
        self.digits = _digits(max(self.a.size, len(self.b.length)))
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[int, bytes], int] = {}
        self.strings: list[bytes] = []
        self.sums = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether B gives other bytes
        self.first, self.pair, self.times, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def stretches(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pre-tokens' cuts, and which of these end a stretch."""
        cuts, _ = pretokens.split(data, at)
        if not self.b.cuts:
            return cuts, np.isin(cuts, at)
        points, first = pretokens.code_points(data)
        inner = cuts[1:-1]
        char = np.searchsorted(first, inner)
        return cuts, np.concatenate([[True], self.b.apart(points[char - 1], points[char]) | np.isin(inner, at), [True]])

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number under which each stretch of the documents is remembered, and the offsets of the documents' stretches."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        cuts, ends = self.stretches(data, at)
        edge = np.flatnonzero(ends)
        start, end, inside = cuts[edge[:-1]], cuts[edge[1:]], np.diff(edge)
        hashes = range_hash(prefix_sums(data), start, end) ^ mix(inside.astype(np.uint64))
        first, which = distinct(data, start, end, hashes)
        raw = data.tobytes()
        keys = [(n, raw[i:j]) for n, i, j in zip(inside[first].tolist(), start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) + len(keys) > CACHE_WORDS or self.size > CACHE_BYTES:
            self.clear()
        place = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.strings) + np.arange(len(new))
            self._learn([keys[i] for i in new.tolist()], data, cuts, edge[:-1][first[new]], inside[first[new]])
        return place[which], np.searchsorted(start, at)

    def _learn(self, keys: list[tuple[int, bytes]], data: np.ndarray, cuts: np.ndarray, edge: np.ndarray, inside: np.ndarray) -> None:
        n = len(keys)
        token = ranges(edge, inside)
        a_ids, a_count = self.a.encode_words(data, cuts[token], cuts[token + 1] - cuts[token])
        a_count = np.add.reduceat(a_count, np.cumsum(inside) - inside)
        b_ids, b_count = self.b.encode([k[1].decode() for k in keys])
        a_ids, a_word, b_word = a_ids.astype(np.int64), np.repeat(np.arange(n), a_count), np.repeat(np.arange(n), b_count)
        size = np.array([len(k[1]) for k in keys], np.int64)
        begin = np.cumsum(size) - size
        # B's bytes against the text's; a stretch that differs gets no tokens of B and is marked.
        b_size = np.bincount(b_word, self.b.length[b_ids], n).astype(np.int64)
        bad = b_size != size
        flat = np.frombuffer(b"".join(k[1] for k in keys), np.uint8)
        held = ~bad[b_word]
        b_ids, b_word = b_ids[held], b_word[held]
        got = self.b.data[ranges(self.b.start[b_ids], self.b.length[b_ids])]
        good = np.flatnonzero(~bad)
        where = ranges(begin[good], size[good])
        differs = np.flatnonzero(flat[where] != got)
        bad[np.searchsorted(begin, where[differs], side="right") - 1] = True
        held_a, held_b = ~bad[a_word], ~bad[b_word]
        a_ids, a_word, b_ids, b_word = a_ids[held_a], a_word[held_a], b_ids[held_b], b_word[held_b]
        a_end, b_end = np.cumsum(self.a.piece_length[a_ids]), np.cumsum(self.b.length[b_ids])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        groups = len(common)
        n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        word = np.zeros(groups, np.int64)
        word[a_group] = a_word
        sums = np.stack([np.bincount(a_word, minlength=n), np.bincount(b_word, minlength=n), np.bincount(word, minlength=n), np.zeros(n, np.int64), bad], 1).astype(np.int64)
        np.add.at(sums[:, 3], word, n_a * n_b)
        pair_word, pair, times = self._links(a_ids, b_ids, n_a, n_b, word)
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(pair_word, minlength=n))])
        self.sums = np.concatenate([self.sums, sums])
        self._write(a_ids, b_ids, a_group, b_group, word, n)
        self.known.update(zip(keys, range(len(self.strings) - n, len(self.strings)), strict=True))
        self.size += int(size.sum())

    @staticmethod
    def _links(a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each stretch with their links: stretch, pair, times. A large group is linked by its distinct ids."""
        a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        small = n_a * n_b <= 4096
        s_a, s_b, size = n_a[small], n_b[small], (n_a * n_b)[small]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(s_b, size)
        found = [(np.repeat(word[small], size), a_ids[np.repeat(a_at[small], size) + k // np.maximum(wide, 1)] << B_BITS | b_ids[np.repeat(b_at[small], size) + k % np.maximum(wide, 1)], np.ones(len(k), np.int64))]
        for g in np.flatnonzero(~small).tolist():
            a, times_a = np.unique(a_ids[a_at[g] : a_at[g] + n_a[g]], return_counts=True)
            b, times_b = np.unique(b_ids[b_at[g] : b_at[g] + n_b[g]], return_counts=True)
            found.append((np.full(len(a) * len(b), word[g]), (a[:, None] << B_BITS | b).ravel(), (times_a[:, None] * times_b).ravel()))
        stretch, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pair, stretch))
        stretch, pair, times = stretch[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (pair[1:] != pair[:-1])])) if len(pair) else np.zeros(0, np.int64)
        return stretch[new], pair[new], np.add.reduceat(times, new) if len(new) else times

    def _write(self, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, word: np.ndarray, n: int) -> None:
        """The groups of each stretch as text, with a `;` after each."""
        digits, first, length = self.digits
        ids, group, side = np.concatenate([a_ids, b_ids]), np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        sign = np.full(len(ids), ord(","), np.uint8)
        if len(ids):
            last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
            sign[last] = np.where(side[last] == 0, ord("|"), ord(";"))
        size = length[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(size.sum()), np.uint8)
        out[ranges(end - size, size - 1)] = digits[ranges(first[ids], size - 1)]
        out[end - 1] = sign
        total = np.concatenate([[0], np.cumsum(np.bincount(word[group], size, n).astype(np.int64))]).tolist()
        raw = out.tobytes()
        self.strings += [raw[i:j] for i, j in zip(total, total[1:], strict=False)]


# Runs: planes of bytes, packed.


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers from 0 on as zstd frames, each array with its width in bytes and its low bytes first."""
    out, packer = [], zstandard.ZstdCompressor(level=3)
    for x in arrays:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        packed = packer.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        out += [np.array([len(x), width, len(packed)], "<u4").tobytes(), packed]
    return b"".join(out)


def _unpack(raw: bytes, count: int, at: int = 0) -> tuple[list[np.ndarray], int]:
    """The next arrays from a place in raw, and the place after them."""
    out, unpacker = [], zstandard.ZstdDecompressor()
    for _ in range(count):
        n, width, size = np.frombuffer(raw, "<u4", 3, at).tolist()
        planes = np.frombuffer(unpacker.decompress(raw[at + 12 : at + 12 + size], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = planes.T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += 12 + size
    return out, at


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


class Frames:
    """A run's pairs of one part, frame by frame: each frame is its first pair, the rest as steps, and the numbers of documents."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.left = raw, 4, int(np.frombuffer(raw, "<u4", 1)[0])

    @staticmethod
    def of(pair: np.ndarray, documents: np.ndarray) -> bytes:
        cut = range(0, len(pair), FRAME)
        return np.array([len(cut)], "<u4").tobytes() + b"".join(pair[i : i + 1].astype("<u8").tobytes() + _pack(_steps(pair[i : i + FRAME] - pair[i]), documents[i : i + FRAME]) for i in cut)

    def head(self) -> int:
        return int(np.frombuffer(self.raw, "<u8", 1, self.at)[0])

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.head()
        (steps, documents), self.at = _unpack(self.raw, 2, self.at + 8)
        self.left -= 1
        return np.cumsum(steps) + first, documents

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        found = [self.next() for _ in range(self.left)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _part(pair: np.ndarray, parts: int) -> np.ndarray:
    """The part of a pair: most of the radix is A's, SIDES of it B's, so that one id of A fills no part."""
    a, b = mix((pair >> B_BITS).astype(np.uint64)), mix((pair & ((1 << B_BITS) - 1)).astype(np.uint64))
    return (a % np.uint64(max(1, parts // SIDES)) * np.uint64(SIDES) + b % np.uint64(SIDES)).astype(np.int64)


RUNS = "run long, part int, head binary, body binary, idx int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _spill(a_path: str, b_path: str, parts: int):
    """A row for each document, and one for each part of each run."""

    def blocks(run: int, code: np.ndarray, times: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, times = code[new], np.add.reduceat(times, new)
        pair, document = code >> DOC_BITS, code & ((1 << DOC_BITS) - 1)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        kinds, n = pair[first], np.diff(np.append(first, len(pair)))
        part = _part(kinds, parts)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
        for i, j in zip(cut, cut[1:], strict=False):
            rows = order[i:j]
            at = ranges(first[rows], n[rows])
            d = document[at]
            step = _steps(d)
            step[np.cumsum(n[rows]) - n[rows]] = d[np.cumsum(n[rows]) - n[rows]]
            yield run, int(part[rows[0]]), Frames.of(kinds[rows], n[rows]), _pack(step, times[at] - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, context = Aligner(a_path, b_path), 0, TaskContext.get()
        task = (context.partitionId() if context else 0) << 32
        codes, times, size, documents = [], [], 0, 0
        names = ["doc_id", *(c.split()[0] for c in RUNS.split(", "))]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *(pa.int64(),) * 4, pa.string()]

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            if codes:
                for row in blocks(task + number, np.concatenate(codes), np.concatenate(times)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *(pa.array([v], k) for v, k in zip(row, kinds, strict=False)), *(pa.nulls(1, k) for k in kinds[4:])], names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            whole = pc.if_else(pc.greater(pc.binary_length(texts.fill_null("")), 0), pc.binary_join_element_wise(" ", texts.fill_null(""), ""), "")
            for i, j, data, at in slices(whole):
                if documents and (size + len(data) > RUN_BYTES or documents + j - i > RUN_DOCS or sum(map(len, codes)) > RUN_RECORDS):
                    yield from flush(ids.type)
                    number, codes, times, size, documents = number + 1, [], [], 0, 0
                for low in range(i, j, RUN_DOCS):
                    high = min(j, low + RUN_DOCS)
                    cut = at[low - i : high - i + 1]
                    if low > i:
                        yield from flush(ids.type)
                        number, codes, times, size, documents = number + 1, [], [], 0, 0
                    word, edge = aligner.words(data[cut[0] : cut[-1]], cut - cut[0])
                    n = high - low
                    total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(aligner.sums[word], 0)])
                    sums = total[edge[1:]] - total[edge[:-1]]
                    good = (sums[:, 4] == 0) & (np.diff(edge) > 0)
                    sums[~good] = 0
                    strings, places, bounds = aligner.strings, word.tolist(), edge.tolist()
                    sha = ["" if not ok else hashlib.sha256(b"".join([strings[w] for w in places[p:q]])[:-1]).hexdigest() for ok, p, q in zip(good.tolist(), bounds, bounds[1:], strict=False)]
                    document = np.repeat(np.arange(n), np.diff(edge))
                    held = good[document]
                    kind, often = np.unique(document[held] * np.int64(len(strings) + 1) + word[held], return_counts=True)
                    of, w = kind // (len(strings) + 1), kind % (len(strings) + 1)
                    count = aligner.first[w + 1] - aligner.first[w]
                    links = ranges(aligner.first[w], count)
                    if len(links):
                        codes.append(aligner.pair[links] << DOC_BITS | np.repeat(of + documents, count))
                        times.append(aligner.times[links] * np.repeat(often, count))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, n), pa.array(np.full(n, task + number)), *(pa.nulls(n, k) for k in kinds[1:4]), pa.array(np.arange(documents, documents + n).astype(np.int32)), *(pa.array(sums[:, k].copy()) for k in range(4)), pa.array(sha, pa.string())], names
                    )
                    documents += n
                size += len(data)
        if codes:
            yield from flush(ids.type)

    return run


COUNTS = "run long, part int, counts binary, a array<int>, top array<bigint>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's pairs counted over all runs: the counts of each run's pairs in its own order, and the highest count of each id of A. Rows come by part."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [c.split()[0] for c in COUNTS.split(", ")])

    def merged(part: int, runs: list[tuple[int, Frames]]) -> Iterator[pa.RecordBatch]:
        heap = [(f.head(), k) for k, (_, f) in enumerate(runs)]
        heapq.heapify(heap)
        counts: list[list[np.ndarray]] = [[] for _ in runs]
        pair, n, of = (np.zeros(0, np.int64),) * 3
        tops_a, tops = [], []
        while heap or len(pair):
            new = [(pair, n, of)]
            taken = 0
            while heap and taken < STEP:
                k = heap[0][1]
                frame = runs[k][1]
                p, c = frame.next()
                new.append((p, c, np.full(len(p), k)))
                taken += len(p)
                heapq.heapreplace(heap, (frame.head(), k)) if frame.left else heapq.heappop(heap)
            pair, n, of = (np.concatenate(x) for x in zip(*new, strict=True))
            now = pair < heap[0][0] if heap else np.ones(len(pair), bool)
            p, c, k = pair[now], n[now], of[now]
            pair, n, of = pair[~now], n[~now], of[~now]
            if not len(p):
                continue
            order = np.argsort(p, kind="stable")
            sorted_p = p[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_p[1:] != sorted_p[:-1]]))
            total = np.add.reduceat(c[order], first)
            a = sorted_p[first] >> B_BITS
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            tops_a.append(a[edge])
            tops.append(np.maximum.reduceat(total, edge))
            each = np.empty(len(p), np.int64)
            each[order] = np.repeat(total, np.diff(np.append(first, len(p))))
            back = np.lexsort((p, k))  # the pairs of a run come in their order
            cut = np.flatnonzero(np.concatenate([[True], k[back][1:] != k[back][:-1], [True]]))
            for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                counts[k[back[i]]].append(each[back[i:j]])
        for low in range(0, len(runs), 256):
            yield rows([(number, part, _pack(np.concatenate(c)), None, None) for (number, _), c in zip(runs[low : low + 256], counts[low : low + 256], strict=True)])
        a, top = np.concatenate(tops_a), np.concatenate(tops)
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))  # an id of A may go over steps
        yield rows([(None, part, None, a[edge].astype(np.int32), np.maximum.reduceat(top, edge))])

    part, runs = -1, []
    for batch in batches:
        for p, number, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if p != part and runs:
                yield from merged(part, runs)
                runs = []
            part = p
            runs.append((number, Frames(head.as_py())))
    if runs:
        yield from merged(part, runs)


def _contributions(tops):
    """The documents of each run with what its pairs' counts come to. Rows come by run: its parts with their counts first, its documents last."""

    def add(have: dict, best: np.ndarray, total: np.ndarray) -> None:
        pair, n = Frames(have["head"]).all()
        (count,), _ = _unpack(have["counts"], 1)
        (step, times), _ = _unpack(have["body"], 2)
        first = np.cumsum(n) - n
        document = np.cumsum(step)
        document -= np.repeat(document[first] - step[first], n)
        times += 1
        np.add.at(total, document, times * np.repeat(count, n))
        np.add.at(best, document, np.where(np.repeat(count == tops.value[pair >> B_BITS], n), times, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, total, have = None, np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64), {}
        for batch in batches:
            runs, out = batch.column("run").to_numpy(), batch.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).columns
            cut = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
            for low, high in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                if runs[low] != number:
                    number, have = runs[low], {}
                    best[:], total[:] = 0, 0
                documents = low + int(np.count_nonzero(batch.column("part").slice(low, high - low).is_valid()))
                for i in range(low, documents):
                    have |= {c: v for c in ("head", "body", "counts") if (v := batch.column(c)[i].as_py()) is not None}
                    if len(have) == 3:  # a part's own row and its counts stand side by side
                        add(have, best, total)
                        have = {}
                if documents < high:
                    n, idx = high - documents, batch.column("idx").slice(documents, high - documents).to_numpy()
                    columns = [*(c.slice(documents, n) for c in out), pa.array(best[idx]), pa.array(total[idx]), batch.column("groups_sha256").slice(documents, n)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _tops(counts: DataFrame, size: int) -> np.ndarray:
    """The highest count of each id of A over all parts: as many numbers as A has ids, whatever the corpus."""
    each = counts.where("a IS NOT NULL").select(F.explode(F.arrays_zip("a", "top")).alias("x")).groupBy(F.col("x.a").alias("a")).agg(F.max("x.top").alias("top")).toArrow()
    tops = np.zeros(size, np.int64)
    tops[each["a"].to_numpy()] = each["top"].to_numpy()
    return tops


def pair_runs(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The documents with their sums, and the runs' parts, as a table."""
    df = df.select("doc_id", "text")
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(SIDES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return stored(df.mapInArrow(_spill(a_path, b_path, parts), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {RUNS}"))


def pair_counts(runs: DataFrame) -> DataFrame:
    """For each part of each run the corpus-wide counts of its pairs, and the highest counts by A's ids, as a table."""
    heads = runs.where("part IS NOT NULL").select("part", "run", "head")
    return stored(heads.repartition("part").sortWithinPartitions("part", "run").mapInArrow(_merge, COUNTS))


def align(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row of df."""
    spark, runs = df.sparkSession, pair_runs(df, a_path, b_path)
    counts = pair_counts(runs)
    tops = spark.sparkContext.broadcast(_tops(counts, bpe.vocabulary(a_path).size))
    both = runs.unionByName(counts.where("run IS NOT NULL").select("run", "part", "counts"), allowMissingColumns=True)
    by_run = both.repartition("run").sortWithinPartitions("run", F.isnull("part"), "part")
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return by_run.mapInArrow(_contributions(tops), schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
