"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces are dealt to shards of bounded size by a hash, and each shard is packed by itself: longest pieces first,
each into the open bin with the least room that still takes it, of whatever capacity. If none does, a bin is opened
whose capacity costs least for what is still to be packed: for each capacity, a trial fills it best-fit from the
pieces left, and the one with the least padding for each token wins. Last, each bin is downsized to the least
permitted capacity that holds its contents.

A document longer than the largest capacity is cut into pieces of that capacity and a rest, so nothing is
dropped. A document without tokens makes one piece of length 0, which takes no room. A null or negative length counts as 0.
Repeated rows are packed each for itself and dealt to all shards; null ids are kept. Of equal lengths that of the
smaller doc_id goes first, a null one last. Other columns, whatever their names, aren't read. An empty table gives no bins.

best_fit packs lengths, sequences packs the tokens themselves. A length is a number of tokens, as a bin of so many
words would overflow the sequence of so many tokens that is made of it.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, token_counts
from tempora.llm.common import give_back, read, repeated, stored

#: Permitted sequence lengths; pieces in a shard, where they are lengths and where they are tokens.
CAPACITIES, SHARD_PIECES, TOKEN_SHARD_PIECES = (512, 1024, 2048, 4096), 20_000, 4000


class Pieces:
    """Lengths left to pack, a count for each."""

    def __init__(self, lengths: np.ndarray):
        size, count = np.unique(lengths, return_counts=True)
        self.sizes, self.left = size.tolist(), dict(zip(size.tolist(), count.tolist(), strict=True))

    def fit(self, room: int) -> int:
        """The longest length left that is at most room, or 0."""
        i = bisect.bisect_right(self.sizes, room) - 1
        return self.sizes[i] if i >= 0 else 0

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def trial(self, first: int, capacity: int) -> int:
        """What a bin of the capacity would hold at last, if it were opened with first and filled best-fit."""
        room, i, used = capacity - first, len(self.sizes), first
        while i >= 0 and room > 0:
            i = bisect.bisect_right(self.sizes, room, 0, i) - 1
            if i < 0:
                break
            n = min(self.left[self.sizes[i]], room // self.sizes[i])
            room, used = room - n * self.sizes[i], used + n * self.sizes[i]
        return used


def pack(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each piece, its place in the bin, and the bins' capacities. lengths: positive, none above the largest capacity."""
    order = np.argsort(-lengths, kind="stable")
    pieces = Pieces(lengths)
    bin_of, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    size: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in order.tolist():
        n = int(lengths[i])
        pieces.take(n)
        k = bisect.bisect_left(rooms, (n, -1))
        if k < len(rooms):
            _, b = rooms.pop(k)
        else:
            fits = [c for c in capacities if c >= n]
            waste = [(c - pieces.trial(n, c)) / c for c in fits]
            b = len(size)
            size.append(fits[int(np.argmin(np.round(waste, 6)))])
            used.append(0)
        bin_of[i], place[i] = b, used[b]
        used[b] += n
        if size[b] > used[b]:
            bisect.insort(rooms, (size[b] - used[b], b))
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bin_of, place, final


def _pack_shard(capacities: tuple[int, ...], keep: tuple[str, ...] = ()):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths, shard = table["length"].to_numpy(), table["shard"][0].as_py()
        some = np.flatnonzero(lengths > 0)
        b, at, size = pack(lengths[some], capacities)
        bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bin_of[some], place[some] = b, at
        if not len(size):
            size = np.array([capacities[0]])
        columns = {"bin": bin_of, "place": place, "capacity": size[bin_of]}
        out = table.select(["doc_id", "piece", "start", "length", "shard", *keep])
        for name, c in columns.items():
            out = out.append_column(name, pa.array(c.astype(np.int64)))
        return out

    return run


def best_fit(df: DataFrame, length: str = "length", capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start and length (tokens of the document), shard, bin (in the shard), place in it, capacity."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    rows = df.select("doc_id", F.greatest(F.col(length).cast("long"), F.lit(0)).alias("n"))
    counted = stored(rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies")))  # lengths are worked out once
    total = counted.agg(F.sum(F.col("copies") * F.greatest(F.lit(1), F.ceil(F.col("n") / most)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    starts = F.expr(f"transform(sequence(0L, greatest(0L, (n - 1) div {most})), p -> struct(p as piece, p * {most} as start))")
    each = repeated(counted, "copies", number="copy")
    cut = each.select("doc_id", "n", "copy", F.explode(starts).alias("p")).select("doc_id", "copy", "p.piece", "p.start", F.least(F.col("n") - F.col("p.start"), F.lit(most)).cast("long").alias("length"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), F.lit(shards))).drop("copy")
    kind = df.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("shard").applyInArrow(_pack_shard(capacities), f"doc_id {kind}, piece long, start long, length long, shard long, bin long, place long, capacity long")


def _fill_shard(capacities: tuple[int, ...]):
    """The bins of a shard with their tokens, and where in them which piece starts."""
    place = _pack_shard(capacities, ("row",))

    def run(table: pa.Table) -> pa.Table:
        give_back()
        row = pa.array(np.arange(table.num_rows))
        lengths = table.select(["doc_id", "piece", "start", "length", "shard"])
        packed = place(lengths.append_column("row", row)).sort_by([("bin", "ascending"), ("place", "ascending")])
        bins = packed["bin"].to_numpy()
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1])).astype(np.int32)
        ends = np.append(first, len(bins)).astype(np.int32)
        tokens = table["ids"].combine_chunks().take(packed["row"].combine_chunks())
        at = np.concatenate([[0], np.cumsum(packed["length"].to_numpy())])[ends].astype(np.int32)
        lists = lambda c: pa.ListArray.from_arrays(pa.array(ends), packed[c].combine_chunks())
        return pa.table({
            "shard": packed["shard"].take(pa.array(first)), "bin": packed["bin"].take(pa.array(first)), "capacity": packed["capacity"].take(pa.array(first)),
            "ids": pa.ListArray.from_arrays(pa.array(at), tokens.flatten()), "doc_ids": lists("doc_id"), "pieces": lists("piece"), "places": lists("place"),
        })

    return run


def sequences(df: DataFrame, path: str, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = TOKEN_SHARD_PIECES) -> DataFrame:
    """shard, bin, capacity, ids (the bin's tokens), and doc_ids, pieces, places: whose tokens start where. A row for each bin.

    Texts are encoded by the tokenizer of path; those without tokens are in no bin. Pieces are dealt to shards by where
    they are stored, so bins may differ from run to run.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    cut = F.expr(f"transform(sequence(0L, greatest(0L, (n_tokens - 1) div {most})), p -> struct(p as piece, slice(token_ids, int(p * {most} + 1), {most}) as ids))")
    encoded = bpe.encode(df.select("doc_id", "text"), path).where("n_tokens > 0")
    pieces = stored(encoded.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.piece", (F.col("p.piece") * most).alias("start"), F.size("p.ids").cast("long").alias("length"), "p.ids"))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    kind = df.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(_fill_shard(capacities), f"shard long, bin long, capacity long, ids array<int>, doc_ids array<{kind}>, pieces array<long>, places array<long>")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit(counted.select("doc_id", F.col("n_tokens").alias("length")))
