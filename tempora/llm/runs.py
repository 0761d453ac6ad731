"""Stretches of a text in which a few words come again and again, found in a grammar of the text and cut down to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least max(6, 4 q) words,
that no neighbouring word extends. Word ids are compressed by Re-Pair: rounds replace the most frequent adjacent pairs (those
of at least half the highest count; where two overlap, the more frequent one) by nonterminals, and what is left without a repeated pair
is paired off neighbour by neighbour. So each border between two words is the boundary of one node of the derivation, and a run lies
whole in the lowest node around it, across that node's boundary. Runs over a nonterminal's boundary are worked out once, however often it
stands in the text: for each period, how far both sides agree, by hashes and binary search, and the words confirm it. They are translated to
all positions of the nonterminal, and intervals of one period that overlap by a period are merged, which leaves the maximal ones.

Before that, a document is cut where no run can be: all three-word windows of a run stand in it at least three times.

Nulls and texts without words have no runs and an empty rest. Repeated rows, rows of one id and rows without one are each worked on. A text
of any length is whole in one task. Columns to carry that have the name of an output column aren't carried. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import binary_array, distinct, grouped, mix, prefix_sums, range_hash, ranges, read, slices
from tempora.llm.shingles import word_spans

#: Least words of a run, and of its periods; candidates (node and period) and words that one step compares.
LEAST, PERIODS, STEP = 6, 4, 1 << 20
_PRIME, _BASE = 2147483629, 1103515245
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def segments(ids: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the stretches that can hold runs: all windows of three words stand at least three times in their document.

    Windows are told apart by hashes; equal hashes of different windows only leave more words in.
    """
    n = len(ids) - 2
    if n < LEAST - 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at)).astype(np.uint64)
    wide = ids.astype(np.uint64)
    code = mix(wide[:-2] * _ODD[0] + wide[1:-1] * _ODD[1] + wide[2:] * _ODD[2] + document[:-2] * _ODD[3])
    which, kinds = pd.factorize(code)
    kept = (np.bincount(which, minlength=len(kinds))[which] >= 3) & (document[:-2] == document[2:])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
    first, size = edge[::2], edge[1::2] - edge[::2] + 2
    # A stretch doesn't go over into the next document, as the windows across their border aren't kept.
    long = size >= LEAST
    return first[long], size[long]


class Grammar:
    """Re-Pair over words (equal numbers are equal words) within segments. A node is a rule, or a pair that stands once.

    left, middle, right: where a node stands for the first time, as words; at, of: all places of nodes, and which node stands there.
    """

    def __init__(self, words: np.ndarray, segment: np.ndarray):
        sym, place, size, seg = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64), segment
        parts: list[tuple[np.ndarray, ...]] = []
        nodes, names, pairing = 0, int(words.max(initial=-1)) + 1, False
        while True:
            ok = np.flatnonzero(seg[1:] == seg[:-1])
            if not len(ok):
                break
            if not pairing:
                first, which = grouped(sym[ok] * names + sym[ok + 1])
                count = np.bincount(which, minlength=len(first))
                pairing = count.max() < 2
            chosen = self._neighbours(ok) if pairing else ok[self._frequent(ok, which, count)]
            if pairing:
                first, which = np.arange(len(chosen)), np.arange(len(chosen))
            else:
                first, which = grouped(sym[chosen] * names + sym[chosen + 1])
            head = chosen[first]
            parts.append((place[head], place[head + 1], place[head + 1] + size[head + 1], place[chosen], which + nodes))
            sym[chosen] = names + which
            size[chosen] += size[chosen + 1]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            sym, place, size, seg = sym[keep], place[keep], size[keep], seg[keep]
            nodes, names = nodes + len(first), names + len(first)
        empty = (np.zeros(0, np.int64),) * 5
        self.left, self.middle, self.right, self.at, self.of = (np.concatenate(x) for x in zip(empty, *parts, strict=True))

    @staticmethod
    def _frequent(ok: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which pair places are replaced in a round. ok: first symbols of all pairs. Pairs as frequent as each other go in a mixed order: in that of the text, one of a chain of them would go in each round."""
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((mix(np.arange(len(count), dtype=np.uint64)), count))] = np.arange(len(count))
        candidate = count[which] >= max(2, count.max() // 2)
        weight = np.where(candidate, rank[which], -1)
        beside = ok[1:] == ok[:-1] + 1
        free = candidate.copy()
        free[:-1] &= ~(beside & (weight[1:] > weight[:-1]))
        free[1:] &= ~(beside & (weight[:-1] > weight[1:]))
        # What is free side by side is one pair over and over, as in `a a a`: every other place.
        joined = np.concatenate([[False], beside & free[1:] & free[:-1]])
        index = np.arange(len(ok))
        begin = np.maximum.accumulate(np.where(joined, 0, index))
        return np.flatnonzero(free & ((index - begin) % 2 == 0))

    @staticmethod
    def _neighbours(ok: np.ndarray) -> np.ndarray:
        """First and second, third and fourth symbol of each segment, and so on."""
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ok[1:] != ok[:-1] + 1]), np.arange(len(ok)), 0))
        return ok[(np.arange(len(ok)) - begin) % 2 == 0]


class Agreement:
    """How far two places of the words agree, by hashes over a prime field."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.power = words, np.ones(1, np.int64)
        while len(self.power) <= n:
            self.power = np.concatenate([self.power, self.power * pow(_BASE, len(self.power), _PRIME) % _PRIME])
        value = (mix(words.astype(np.uint64)) % np.uint64(_PRIME)).astype(np.int64) * self.power[:n] % _PRIME
        self.sums = np.concatenate([[0], np.cumsum(value) % _PRIME]) if n < 1 << 31 else None

    def _equal(self, i: np.ndarray, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        a, b = self.sums[i + k] - self.sums[i], self.sums[i + q + k] - self.sums[i + q]
        return a % _PRIME * self.power[q] % _PRIME == b % _PRIME

    def ahead(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most words from i on that equal those q later."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            k = (low[open_] + high[open_] + 1) // 2
            same = self._equal(i[open_], q[open_], k)
            low[open_[same]], high[open_[~same]] = k[same], k[~same] - 1
        return low

    def behind(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most words up to i (not with it) that equal those q later."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            k = (low[open_] + high[open_] + 1) // 2
            same = self._equal(i[open_] - k, q[open_], k)
            low[open_[same]], high[open_[~same]] = k[same], k[~same] - 1
        return low

    def periodic(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the words of [start, end) that are q apart are the same, word by word."""
        good, size = np.ones(len(start), bool), end - q - start
        total = np.cumsum(size)
        for low in range(0, int(total[-1]) if len(total) else 0, STEP):
            part = np.arange(*np.searchsorted(total, [low, low + STEP], side="right"))
            at = ranges(start[part], size[part])
            bad = np.flatnonzero(self.words[at] != self.words[at + np.repeat(q[part], size[part])])
            good[part[np.searchsorted(np.cumsum(size[part]), bad, side="right")]] = False
        return good


def _plain(words: np.ndarray, left: int, middle: int, right: int, q: int, ahead: bool) -> tuple[int, int]:
    """A run's ends by comparing words, for the case that hashes misled."""
    i = middle if ahead else middle - q
    start, end = i, i + q
    while end < right and words[end] == words[end - q]:
        end += 1
    while start > left and words[start - 1] == words[start - 1 + q]:
        start -= 1
    return start, end


def boundary_runs(words: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs within each node over its boundary: node, start and end at its first place, period."""
    left, middle, right = grammar.left, grammar.middle, grammar.right
    agreement, found = Agreement(words), []
    for ahead in (True, False):  # at least two periods lie on one side of the boundary
        most = np.minimum((right - middle if ahead else middle - left) // 2, (right - left) // PERIODS)
        most[right - left < LEAST] = 0
        total = np.concatenate([[0], np.cumsum(most)])
        low = 0
        while low < len(most):
            high = max(low + 1, int(np.searchsorted(total, total[low] + STEP, side="right")) - 1)
            node = np.repeat(np.arange(low, high), most[low:high])
            q = np.arange(len(node)) - np.repeat(total[low:high] - total[low], most[low:high]) + 1
            low = high
            m = middle[node]
            near = (words[m] == words[m + q]) if ahead else (words[m - 1] == words[m - 1 - q])
            node, q, m = node[near], q[near], m[near]
            far = (words[m + q - 1] == words[m + 2 * q - 1]) if ahead else (words[m - q] == words[m - 2 * q])
            node, q, m = node[far], q[far], m[far]
            at = m if ahead else m - q
            end = at + q + agreement.ahead(at, q, right[node] - at - q)
            start = at - agreement.behind(at, q, at - left[node])
            held = (end - start >= np.maximum(LEAST, PERIODS * q)) & (start < m) & (end > m)
            node, q, start, end = node[held], q[held], start[held], end[held]
            for i in np.flatnonzero(~agreement.periodic(start, end, q)).tolist():
                start[i], end[i] = _plain(words, int(left[node[i]]), int(middle[node[i]]), int(right[node[i]]), int(q[i]), ahead)
            held = (end - start >= np.maximum(LEAST, PERIODS * q)) & (start < middle[node]) & (end > middle[node])
            found.append((node[held], start[held], end[held], q[held]))
    node, start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(node)]
    return node[new], start[new], end[new], q[new]  # of one stretch the smallest period


def maximal_runs(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start, then period."""
    grammar = Grammar(words, segment)
    node, start, end, q = boundary_runs(words, grammar)
    order = np.argsort(grammar.of, kind="stable")
    place, size = grammar.at[order], np.bincount(grammar.of, minlength=len(grammar.left))
    first, times = (np.cumsum(size) - size)[node], size[node]
    shift = place[ranges(first, times)] - np.repeat(grammar.left[node], times)
    start, end, q = np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(q, times)
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    if not len(q):
        return start, end, q
    kind = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]])) * (len(words) + 1)
    reach = np.maximum.accumulate(end + kind) - kind  # as far as those before of this period go
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (start[1:] + q[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    start, end, q = start[at], np.maximum.reduceat(end, at), q[at]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs_of_texts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of the words of all documents, the offsets of their words, and the runs as words of all documents: starts, ends, periods."""
    _, start, end = word_spans(data, at)
    word_at = np.searchsorted(start, at)
    none = (np.zeros(0, np.int64),) * 3
    if len(start) < LEAST:
        return start, end, word_at, *none
    _, ids = distinct(data, start, end, range_hash(prefix_sums(data), start, end))
    first, size = segments(ids, word_at)
    if not len(first):
        return start, end, word_at, *none
    origin = ranges(first, size)
    low, high, q = maximal_runs(ids[origin], np.repeat(np.arange(len(first)), size))
    return start, end, word_at, origin[low], origin[high - 1] + 1, q


def _collapse(drop: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in drop]
            for a, b, data, at in slices(batch.column(batch.schema.names.index("text"))):
                start, end, word_at, low, high, q = runs_of_texts(data, at)
                gone = np.cumsum(np.bincount(low + q, minlength=len(start) + 1) - np.bincount(high, minlength=len(start) + 1))[: len(start)] > 0
                size = np.where(gone, 0, end - start + 1)
                cut = np.concatenate([[0], np.cumsum(size)])
                flat = np.full(int(cut[-1]), 32, np.uint8)
                kept = np.flatnonzero(~gone)
                flat[ranges(cut[kept], size[kept] - 1)] = data[ranges(start[kept], size[kept] - 1)]
                edge = cut[word_at]
                some = np.diff(edge) > 0  # the space after a document's last word goes
                last = np.ones(len(flat), bool)
                last[edge[1:][some] - 1] = False
                rest = binary_array(flat[last], edge - np.concatenate([[0], np.cumsum(some)]))
                run_at = np.searchsorted(low, word_at)
                document = np.searchsorted(word_at, low, side="right") - 1
                fields = [pa.array(x.astype(np.int64)) for x in (low - word_at[document], high - low, q)]
                runs = pa.ListArray.from_arrays(pa.array(run_at.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                columns = [batch.column(batch.schema.names.index(n)).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(word_at)), runs, rest.cast(pa.string())], [*names, "n_words", "runs", "collapsed"])

    return run


def collapse(df: DataFrame) -> DataFrame:
    """df without its text, with n_words, its runs (start, length, period; by start, then period) and the collapsed text: of each run the first period, words joined by one space."""
    drop = {"text", "n_words", "runs", "collapsed"}
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    return df.select("text", *(f"`{f.name}`" for f in kept)).mapInArrow(_collapse(drop), schema)


def _cycled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the ids that the contract names go round from a word on: the words, joined by one space."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        h = [None if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()]
        rows = [k for k, x in enumerate(h) if x is not None and x % 10 == 0]
        if not rows:
            yield batch
            continue
        new: dict[int, str] = {}
        of = pa.array(rows)
        for i, j, data, at in slices(texts.take(of)):
            _, start, end = word_spans(data, at)
            word_at, raw = np.searchsorted(start, at).tolist(), data.tobytes()
            for k, low, high in zip(rows[i:j], word_at, word_at[1:], strict=False):
                n, g = high - low, h[k] // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = [raw[x:y] for x, y in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)]
                    new[k] = b" ".join([*words[:a], *(words[a + (x - a) % p] for x in range(a, n))]).decode()
        flags = np.zeros(batch.num_rows, bool)
        flags[list(new)] = True
        changed = pa.array([new[k] for k in sorted(new)], pa.string())
        yield pa.RecordBatch.from_arrays([ids, pa.compute.replace_with_mask(texts, pa.array(flags), changed)], batch.schema.names)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = collapse(docs.mapInArrow(_cycled, docs.schema))
    best = F.expr("reduce(slice(runs, 2, size(runs)), get(runs, 0), (x, y) -> if(y.length * x.period > x.length * y.period, y, x))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
