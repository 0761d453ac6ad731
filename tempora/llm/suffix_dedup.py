"""Removes bytes covered by a string of 50 bytes that also starts in a document with a smaller doc_id.

A sparse suffix array finds the strings. Each window of 50 bytes has an anchor: the start of the 24-byte
gram in it whose hash is least, the leftmost on a tie. Equal windows have equal anchors, so only the
suffixes that start at anchors (about one in 14) are sorted:

0.  Rows are dealt into parts by a hash of doc_id, as compressed Arrow streams; all steps read the parts from this one shuffle.
1.  Splitters sampled from the suffixes range-partition them by their leading 8 bytes and, so that frequent leading
    bytes with different continuations are cut too, by a fingerprint of the gram. Equal grams fall into one range, so
    neighbours to compare never lie on two sides of a boundary. Each range is sorted by multikey quicksort: by
    the leading 8 bytes, then within ties by the gram's fingerprint. A run of equal grams
    whose documents all agree on the text of all windows around the anchor is settled by its least doc_id;
    so is a member of any run whose text around is that of the run's least document.
2.  Where the texts around equal grams differ, each window by itself is ranged by its fingerprint, sorted, and
    settled by its least doc_id.

Documents are dealt into parts by a hash of doc_id. A part sends each distinct gram or window once, with its
least doc_id, so a passage in a third of all documents makes one message a part; answers are one byte a
message, in the order sent. Parts are read anew for each step, and every step gives the same messages
whatever the order of rows, so a lost executor's work is redone alike.

Nulls are empty texts. A row without a doc_id loses nothing and removes nothing elsewhere. Rows with one
doc_id aren't compared with each other; each is returned. Texts under 50 bytes lose nothing; very long ones are
whole in one task. An empty table gives no rows. Columns to carry that have the name of an output column aren't
carried. Fingerprints of the rest of a gram have 32 bits beside the 64 of its leading bytes, those of windows 64,
those of the text around a gram 48 within its run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import SLICE_BYTES, binary_array, byte_view, give_back, mix, prefix_sums, range_hash, ranges, read

SPAN, GRAM = 50, 24
#: Text bytes in a part, messages in a range; text bytes of the sample for each range, which grows with them, and of a piece of it.
PART_BYTES, RANGE_MESSAGES, SAMPLE_BYTES, SAMPLE_PIECE = 2 << 20, 600_000, 64 << 10, 2 << 10
SHARED, DIFFERS, EARLIER, FIRST_TEXT = 1, 2, 4, 8
MASK = np.uint64(0xFFFFFFFF)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes."""
    out = [struct.pack("<qB", len(columns[0]), len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(struct.pack("<2s", c.dtype.str[1:].encode()))
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = struct.unpack_from("<qB", raw)
    i, out = 9, []
    for _ in range(k):
        kind = np.dtype("<" + raw[i : i + 2].decode())
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, i + 2).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        i += 2 + size
    return out


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Sorts by the first key, then only within runs of ties by the next ones."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        tied = np.ones(len(order), bool)
        for k in keys[:depth]:
            s = k[order]
            tied[1:] &= s[1:] == s[:-1]
        tied[:1] = False
        run = np.cumsum(~tied)
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        rows = np.flatnonzero(inside)
        sub = order[rows]
        order[rows] = sub[np.lexsort((keys[depth][sub], run[rows]))]
    return order


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def leading(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, in the order of the bytes."""
    x, width = data.astype(np.uint64), 1
    while width < 8:
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
        width *= 2
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the gram bytes (eight at least) from each place on, from words of eight."""
    words = leading(data)
    n, out = len(data) - gram + 1, None
    for k in sorted({*range(0, gram - 7, 8), gram - 8}):
        w = words[k : k + n] * np.uint64(0x9E3779B97F4A7C15)
        out = mix(w if out is None else w ^ out)
    return out


def anchors(data: np.ndarray, at: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside the documents: place, first and last window start, gram's hash, hash of the windows' text."""
    n = len(data)
    if n < span:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums, grams = prefix_sums(data), gram_hashes(data, gram)
    least = (grams & ~MASK) | np.arange(len(grams), dtype=np.uint64)
    width, reach = span - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    ok = np.ones(n - span + 1, bool)
    low = np.maximum(at[:-1], at[1:] - span + 1)
    outside = ranges(low, at[1:] - low)
    ok[outside[outside < len(ok)]] = False
    window = np.flatnonzero(ok)
    place = (least[window] & MASK).astype(np.int64)
    if not len(place):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    start = run_starts(place)
    place, first, last = place[start], window[start], window[np.append(start[1:], len(window)) - 1]
    around = mix(range_hash(sums, first, last + span) + (place - first).astype(np.uint64))
    return place, first, last, grams[place], around


class Part:
    """The anchors of a part's documents, grouped by gram, in an order that depends on their texts alone."""

    def __init__(self, texts: pa.Array, ids: pa.Array, span: int, gram: int):
        self.span = span
        self.data, self.at = byte_view(texts)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        self.pieces: list[tuple[int, int]] = []
        found = []
        for lo, at in self._pieces():
            place, first, last, grams, around = anchors(self.data[lo : lo + at[-1]], at, span, gram)
            self.pieces.append((lo, lo + int(at[-1])))
            found.append((place + lo, first + lo, last + lo, grams, around))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        place = columns[0]
        document = np.searchsorted(self.at, place, side="right") - 1
        keep = self.known[document] if len(document) else np.zeros(0, bool)
        self.place, self.first, self.last, grams, around = (c[keep] for c in columns)
        self.document = document[keep]
        lead = np.zeros(len(self.place), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | self.data[self.place + k]
        rest = (mix(grams) & MASK).astype(np.uint32)  # anchors are those of small hashes, so their bits are mixed once more
        self.around = around & np.uint64(0xFFFFFFFFFFFF)
        doc_id = self.ids[self.document]
        order = multikey_order(lead, rest, doc_id, self.around)
        start = run_starts(lead[order], rest[order])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.lead, self.rest = lead[order[start]], rest[order[start]]
        self.least, self.text_key = doc_id[order[start]], self.around[order[start]]
        self.flags = np.zeros(0, np.uint8)
        if len(start):
            d, a = doc_id[order], self.around[order]
            self.flags = ((np.maximum.reduceat(d, start) != self.least) * SHARED + (np.maximum.reduceat(a, start) != np.minimum.reduceat(a, start)) * DIFFERS).astype(np.uint8)
        self.doc_id = doc_id

    def _pieces(self):
        """Runs of documents of about SLICE_BYTES, and of a longer document pieces whose windows are all its windows."""
        row, n, at = 0, len(self.at) - 1, self.at
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
            if end > row + 1 or at[end] - at[row] <= SLICE_BYTES:
                yield int(at[row]), at[row : end + 1] - at[row]
            else:
                for lo in range(int(at[row]), int(at[end]), SLICE_BYTES):
                    yield lo, np.array([0, min(SLICE_BYTES + self.span - 1, int(at[end]) - lo)])
            row = end

    def first_messages(self, splitters: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, bytes]]:
        """A blob for each range: leading bytes, rest of the gram, least doc_id, text around, flags."""
        lead, rest = splitters
        low, high = np.searchsorted(self.lead, lead), np.searchsorted(self.lead, lead, side="right")
        for i in np.flatnonzero(low < high).tolist():
            low[i] += np.searchsorted(self.rest[low[i] : high[i]], rest[i], side="right")
        at = np.concatenate([[0], low, [len(self.lead)]])
        return [(k, pack(*(c[a:b] for c in (self.lead, self.rest, self.least, self.text_key, self.flags)))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]

    def settle(self, answers: np.ndarray) -> None:
        """Takes the answers to first_messages; unsettled holds the anchors whose windows are looked at one by one."""
        all_flags = (self.flags | answers)[self.group]
        shared, differs = (all_flags & SHARED) > 0, (all_flags & DIFFERS) > 0
        later = self.doc_id > self.least[self.group]
        matched = shared & ~differs & (((all_flags & EARLIER) > 0) | later)
        # The text around may be that of the gram's first document even where others differ.
        matched |= shared & differs & (self.around == self.text_key[self.group]) & (((all_flags & FIRST_TEXT) > 0) | later)
        self.low, self.high = self.first[matched], self.last[matched] + self.span
        self.unsettled = np.flatnonzero(shared & differs & ~matched)

    def windows(self) -> None:
        """Fingerprints of the unsettled anchors' windows, the distinct ones with their least doc_id."""
        marks, owners, starts = [], [], []
        for lo, hi in self.pieces:
            rows = self.unsettled[(self.first[self.unsettled] >= lo) & (self.last[self.unsettled] + self.span <= hi)]
            rows = rows[self.first[rows] < lo + SLICE_BYTES] if hi - lo > SLICE_BYTES else rows
            if not len(rows):
                continue
            size = self.last[rows] - self.first[rows] + 1
            start = ranges(self.first[rows], size)
            marks.append(range_hash(prefix_sums(self.data[lo:hi]), start - lo, start - lo + self.span))
            owners.append(np.repeat(self.doc_id[rows], size))
            starts.append(start)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        marks, self.owner, self.start = join(marks, np.uint64), join(owners, np.int64), join(starts, np.int64)
        self.marks, self.window_of = np.unique(marks, return_inverse=True)
        self.window_least = np.full(len(self.marks), np.iinfo(np.int64).max)
        np.minimum.at(self.window_least, self.window_of, self.owner)

    def second_messages(self, n_ranges: int) -> list[tuple[int, bytes]]:
        bounds = np.array([(k << 64) // n_ranges for k in range(1, n_ranges)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(self.marks, bounds), [len(self.marks)]])
        return [(k, pack(self.marks[a:b], self.window_least[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]

    def removed(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of the removed runs, in order, none of them across documents."""
        hit = (answers[self.window_of] > 0) | (self.owner > self.window_least[self.window_of])
        edge = np.zeros(len(self.data) + 1, np.int32)
        for low, high in ((self.low, self.high), (self.start[hit], self.start[hit] + self.span)):
            np.add.at(edge, low, 1)
            np.add.at(edge, high, -1)
        covered = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[False], covered[:-1]])
        ends_here = np.zeros(len(covered) + 1, bool)
        ends_here[self.at] = True
        start = np.flatnonzero(covered & (~before | ends_here[:-1]))
        after = np.append(covered[1:], False)
        return start, np.flatnonzero(covered & (~after | ends_here[1:])) + 1


def resolve_first(blobs: list[bytes]) -> list[np.ndarray]:
    """Answers to first_messages: whether another document has the gram, whether texts around differ, whether an earlier one has it, whether the first one has it in the same text."""
    tables = [unpack(b) for b in blobs]
    lead, rest, least, text, flags = (np.concatenate(c) for c in zip(*tables, strict=True))
    order = multikey_order(lead, rest, least)
    start = run_starts(lead[order], rest[order])
    size = np.diff(np.append(start, len(order)))
    low, high, first_text = least[order[start]], np.maximum.reduceat(least[order], start), text[order[start]]
    differs = np.minimum.reduceat(text[order], start) != np.maximum.reduceat(text[order], start)
    both = np.bitwise_or.reduceat(flags[order], start) | ((low != high) * SHARED + differs * DIFFERS).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    earlier = np.repeat(low, size) < least[order]
    out[order] = np.repeat(both, size) | (earlier * EARLIER + (earlier & (np.repeat(first_text, size) == text[order])) * FIRST_TEXT).astype(np.uint8)
    return np.split(out, np.cumsum([len(t[0]) for t in tables])[:-1])


def resolve_second(blobs: list[bytes]) -> list[np.ndarray]:
    """Whether an earlier document has the window."""
    tables = [unpack(b) for b in blobs]
    mark, least = (np.concatenate(c) for c in zip(*tables, strict=True))
    order = np.argsort(mark, kind="stable")
    start = run_starts(mark[order])
    size = np.diff(np.append(start, len(order)))
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(np.minimum.reduceat(least[order], start), size) < least[order]
    return np.split(out, np.cumsum([len(t[0]) for t in tables])[:-1])


def _packed(n_columns: int):
    """(part, columns ...) -> (part, blob): a batch's rows of each part as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            give_back()
            part = batch.column(0).to_numpy()
            order = np.argsort(part, kind="stable")
            rows, start = batch.select(range(1, n_columns)).take(pa.array(order)), run_starts(part[order])
            blobs = []
            for a, b in zip(start, np.append(start[1:], len(order)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                    stream.write_batch(rows.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[order][start]), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def _rows(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table["blob"].to_pylist()]).combine_chunks()


MESSAGE = "place long, part long, step int, blob binary"


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    place, part, step, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"place": pa.array(place, pa.int64()), "part": pa.array(part, pa.int64()), "step": pa.array(step, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _answer(resolve, step: int):
    """Answers a range's messages of the step; passes earlier answers on. place then is the range that answered."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = list(zip(*(table[c].to_pylist() for c in ("place", "part", "step", "blob")), strict=True))
        ask = [r for r in rows if r[2] == step]
        done = [r for r in rows if r[2] != step]
        if ask:
            done += [(r[0], r[1], step + 1, pack(a)) for r, a in zip(ask, resolve([r[3] for r in ask]), strict=True)]
        return _messages(done)

    return run


def _answers(table: pa.Table, step: int) -> tuple[np.ndarray, list[tuple[int, int, int, bytes]]]:
    rows = sorted(r for r in zip(*(table[c].to_pylist() for c in ("place", "part", "step", "blob")), strict=True) if r[2] == step)
    return (np.concatenate([unpack(r[3])[0] for r in rows]) if rows else np.zeros(0, np.uint8)), rows


def _splitters(df: DataFrame, total: int, n: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading words and rests that cut the suffixes of a sample into about n equal shares, one of each for a cut.

    Pieces of texts are sampled, more of longer texts, and the cuts are the last suffixes of Spark's own ranges
    of the sample. They steer the dealing, not the result.
    """
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    share, chars = min(1.0, n * SAMPLE_BYTES / total), F.length("text")
    seed = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1_000_003)) / 1_000_003.0
    pieces = F.floor(chars * (share / SAMPLE_PIECE) + seed)
    at = F.pmod(F.xxhash64("doc_id", "piece"), F.greatest(F.lit(1), chars - SAMPLE_PIECE)).cast("int") + 1
    drawn = df.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), pieces.cast("int"))).alias("piece")).where(F.col("piece") < pieces)

    def suffixes(batches):
        for batch in batches:
            part = Part(batch.column(0), pa.array(np.arange(batch.num_rows)), span, gram)
            yield pa.RecordBatch.from_arrays([pa.array((part.lead ^ (np.uint64(1) << np.uint64(63))).view(np.int64)), pa.array(part.rest.astype(np.int64))], ["lead", "rest"])

    sample = drawn.select(F.substring("text", at, F.lit(SAMPLE_PIECE)).alias("piece_text")).mapInArrow(suffixes, "lead long, rest long")
    ranged = sample.repartitionByRange(n, "lead", "rest").groupBy(F.spark_partition_id()).agg(F.max(F.struct("lead", "rest")).alias("last"))
    cuts = sorted((r["last"]["lead"], r["last"]["rest"]) for r in ranged.collect())[:-1]
    lead, rest = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
    return lead.view(np.uint64) ^ (np.uint64(1) << np.uint64(63)), rest.astype(np.uint32)


def remove_repeats(df: DataFrame, span: int = SPAN, gram: int = GRAM, carry: tuple[str, ...] = (), part_bytes: int = PART_BYTES, range_messages: int = RANGE_MESSAGES, characters: bool = False) -> DataFrame:
    """doc_id, removed (array of byte runs), kept (the remaining bytes) and the carried columns, a row for each row of df.

    With characters, kept holds whole characters: one that loses a byte goes whole, and all others stay as they are.
    """
    spark = df.sparkSession
    df = df.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text", "removed", "kept", "part")))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts, n_ranges = max(1, -(-total // part_bytes)), max(1, int(total * 2 / (span - gram + 2)) // range_messages)
    splitters = _splitters(df.select("doc_id", "text"), total, n_ranges, span, gram)
    n_ranges, cuts = len(splitters[0]) + 1, spark.sparkContext.broadcast(splitters)
    dealt = df.withColumn("part", F.pmod(F.xxhash64(F.coalesce(F.xxhash64("doc_id") * F.when(F.col("doc_id").isNotNull(), 1), F.xxhash64("text"))), F.lit(n_parts)))
    kept_fields = [f for f in df.schema.fields if f.name != "text"]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields), "removed array<struct<start:bigint,end:bigint>>", "kept binary"])
    names = [f.name for f in kept_fields]

    dealt = dealt.select("part", *df.columns).mapInArrow(_packed(1 + len(df.columns)), "part long, blob binary")

    def part_of(table: pa.Table) -> Part:
        return Part(table["text"].combine_chunks(), table["doc_id"].combine_chunks(), span, gram)

    def ask_first(table: pa.Table) -> pa.Table:
        k = table["part"][0].as_py()
        return _messages([(p, k, 0, b) for p, b in part_of(_rows(table)).first_messages(cuts.value)])

    def ask_second(table: pa.Table, state: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        k, part = table["part"][0].as_py(), part_of(_rows(table))
        answers, rows = _answers(state, 1)
        part.settle(answers)
        part.windows()
        return _messages([*rows, *((p, k, 2, b) for p, b in part.second_messages(n_ranges))])

    def finish(table: pa.Table, state: pa.Table) -> pa.Table:
        table = _rows(table)
        part = part_of(table)
        part.settle(_answers(state, 1)[0])
        part.windows()
        start, end = part.removed(_answers(state, 3)[0])
        row = np.searchsorted(part.at, start, side="right") - 1
        at = np.searchsorted(row, np.arange(table.num_rows + 1))
        keep = np.ones(len(part.data), bool)
        keep[ranges(start, end - start)] = False
        if characters and len(keep):
            character = np.cumsum((part.data & 0xC0) != 0x80) - 1
            torn = np.zeros(character[-1] + 1, bool)
            torn[character[~keep]] = True
            keep = ~torn[character]
        left = np.concatenate([[0], np.cumsum(keep)])[part.at]
        runs = pa.StructArray.from_arrays([pa.array(start - part.at[row]), pa.array(end - part.at[row])], ["start", "end"])
        columns = [table[c] for c in names]
        return pa.table([*columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), runs), binary_array(part.data[keep], left)], names=[*names, "removed", "kept"])

    asked = dealt.groupBy("part").applyInArrow(ask_first, MESSAGE)
    answered = asked.groupBy("place").applyInArrow(_answer(resolve_first, 0), MESSAGE)
    asked = dealt.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(ask_second, MESSAGE)
    answered = asked.groupBy("place").applyInArrow(_answer(resolve_second, 2), MESSAGE)
    return dealt.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(finish, out_schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(
        "doc_id", (F.octet_length("kept") + n_removed).alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: Every window as hexadecimal text, so this is for small tables.
OP5_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS gram FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h WHERE length(x) >= 100)),
least_id AS (SELECT gram, min(doc_id) AS m FROM win GROUP BY gram),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win JOIN least_id USING (gram) WHERE m < doc_id),
run AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a, b FROM span),
kept AS (SELECT doc_id, string_agg(substr(x, CAST(2 * low + 1 AS BIGINT), CAST(2 * (a - low) AS BIGINT)), '' ORDER BY a) || substr(any_value(x), CAST(2 * max(b) + 1 AS BIGINT)) AS y, sum(b - a) AS removed, count(*) AS spans FROM gap JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""
