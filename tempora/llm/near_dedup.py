"""Near-duplicate documents by HyperMinHash registers, bands of them, and exact Jaccard of word shingles.

1.  Each text's shingle set gives registers of leading zeros and mantissa bits, its words a digest; texts of one
    digest are one class from here on, whatever their number.
2.  Keys of bands of registers put classes that may be similar into one bucket. Members of a bucket are tied to its
    least id (no pairs are made), and what is so tied together is a cluster: links only exist inside clusters.
3.  A cluster of bounded size is settled in one task: pairs whose corrected register estimate comes near the
    threshold, and that aren't connected yet, are verified on their full sets.
4.  A larger cluster is spread over tasks: every member is verified against those of a few hubs that it may link with,
    chosen from a small sample of it. Hubs with a member in common are one component. All that isn't in the
    largest component is compared by its registers with the members of its buckets, in blocks of bounded size. First
    a forest of the pairs near the threshold is verified; then, inside the blocks, all such pairs that aren't
    connected by then, each in the first band that they share. No pair is a row but those of the forest. Of two
    members that aren't connected, one at least isn't in the largest component, so no pair of a bucket is
    left out, and the work grows with the pairs that buckets hold, not with the cluster's square.

Sets are compared by the bytes of their words, so equal hashes never make a link. Nulls and texts without words have
no shingles and link with nothing. Rows with one doc_id are one document, whose texts are tied. A row without doc_id
links with nothing, keeps a null component and is kept. Copies and repeated rows share their component. Very long
texts are whole in one task. Other columns, whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tempora.llm import shingles
from tempora.llm.common import binary_array, byte_view, ranges, read, slices, stored
from tempora.llm.components import Forest, components

#: Most documents and shingles of a cluster that one task settles; hub candidates and hubs; members of a block of a bucket; pairs that are estimated at once.
GROUP_DOCS, GROUP_SHINGLES, SAMPLE, HUBS, BLOCK, PAIRS = 256, 500_000, 32, 6, 500, 100_000
#: How far below the threshold an estimate from 120 registers may lie (over four standard deviations).
MARGIN = 0.17


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in slices(batch.column(1)):
            sets, ends = shingles.shingle_sets(data, at)
            n = np.diff(ends)
            digest = pa.array(shingles.digests(data, at), pa.binary())
            register = shingles.registers(sets, ends)
            whole = lambda x, size: binary_array(x, np.arange(len(n) + 1) * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), digest, whole(register.view(np.uint8).reshape(-1), 2 * register.shape[1])], ["doc_id", "n_shingles", "digest", "registers"]
            )


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (equal for equal words in one order) and registers of each document."""
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1) if len(column) else np.zeros((0, shingles.BANDS * shingles.ROWS), np.uint16)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = shingles.band_keys(_registers(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], ["id", "bucket"])


def _member_bands(columns: tuple[str, ...]):
    """Members once for each of their buckets, with the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(low, 2048)])
                keys = shingles.band_keys(_registers(part["registers"]))
                rows = part.select(columns).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))
                yield from rows.add_column(0, "bucket", pa.array(keys.reshape(-1))).combine_chunks().to_batches()

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Group:
    """Documents of a cluster in a task, with their sets and registers."""

    def __init__(self, table: pa.Table):
        self.ids = table["id"].to_numpy()
        flat, ends, self.registers = shingles.exact_sets(*byte_view(table["text"]))
        self.sets, self.n = [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)], np.diff(ends)

    def similar(self, i: int, j: int, percent: int) -> bool:
        return similar(self.sets[i], self.sets[j], percent)

    def connect(self, forest: Forest, percent: int) -> None:
        """Joins in the forest what links of which it doesn't know yet."""
        for i in range(len(self.ids)):
            rest = i + 1 + np.flatnonzero(forest.roots()[i + 1 :] != forest.find(i))
            if not len(rest):
                continue
            k = len(rest)
            guess = shingles.estimate(np.repeat(self.registers[i : i + 1], k, 0), self.registers[rest], np.repeat(self.n[i], k), self.n[rest])
            near = guess >= percent / 100 - MARGIN
            for j in rest[near][np.argsort(-guess[near], kind="stable")].tolist():
                if forest.find(i) != forest.find(j) and self.similar(i, j, percent):
                    forest.join(i, j)


def _settle(percent: int):
    """Components of one cluster."""

    def run(table: pa.Table) -> pa.Table:
        group = Group(table)
        n = len(group.ids)
        forest = Forest(n)
        first: dict[int, int] = {}
        for i, x in enumerate(group.ids.tolist()):
            if x in first:
                forest.join(first[x], i)
            first.setdefault(x, i)
        group.connect(forest, percent)
        root = forest.roots()
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, group.ids)
        return pa.table({"id": pa.array(group.ids), "component": pa.array(least[root])})

    return run


def _pick_hubs(percent: int):
    """The sampled members that are most similar to others not near an earlier hub."""

    def run(table: pa.Table) -> pa.Table:
        register, n, ids = _registers(table["registers"]), table["n_shingles"].to_numpy(), table["id"].to_numpy()
        k = len(ids)
        a, b = np.repeat(np.arange(k), k), np.tile(np.arange(k), k)
        guess = shingles.estimate(register[a], register[b], n[a], n[b]).reshape(k, k)
        open_, hubs = np.ones(k, bool), []
        while open_.any() and len(hubs) < HUBS:
            hubs.append(int((np.where(guess >= percent / 100 - 0.05, 1 + guess, 0.0)[:, open_]).sum(1).argmax()))
            open_ &= guess[hubs[-1]] < percent / 100
            open_[hubs[-1]] = False
        return pa.table({"cluster": table["cluster"].slice(0, 1), "hubs": pa.array([ids[hubs].tolist()], pa.list_(pa.int64())), "hub_n": pa.array([n[hubs].tolist()], pa.list_(pa.int64())), "hub_registers": pa.array([register[hubs].tobytes()], pa.binary())})

    return run


def _near_hubs(percent: int):
    """(id, hub) for each hub whose estimate comes near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = lambda c: batch.column(names.index(c))
            register, n, members = _registers(column("registers")), column("n_shingles").to_numpy(), column("id").to_pylist()
            out = []
            for i, (ids, sizes, raw) in enumerate(zip(column("hubs").to_pylist(), column("hub_n").to_pylist(), column("hub_registers").to_pylist(), strict=True)):
                of = np.frombuffer(raw, np.uint16).reshape(len(ids), -1)
                guess = shingles.estimate(np.repeat(register[i : i + 1], len(ids), 0), of, np.repeat(n[i], len(ids)), np.array(sizes))
                out += [(members[i], ids[k]) for k in np.flatnonzero(guess >= percent / 100 - MARGIN).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["id", "hub"])

    return run


def _merge_hubs(table: pa.Table) -> pa.Table:
    """Components of a cluster's hubs, from the sets of hubs (hubs) that members link with and how many do (docs): each hub's, and the largest."""
    sets, docs = table["hubs"].to_pylist(), table["docs"].to_pylist()
    hubs = sorted({h for s in sets for h in s})
    at, forest = {h: i for i, h in enumerate(hubs)}, Forest(len(hubs))
    for s in sets:
        for h in s:
            forest.join(at[s[0]], at[h])
    size = np.zeros(len(hubs), np.int64)
    np.add.at(size, [forest.find(at[s[0]]) for s in sets], docs)
    known = [(h, hubs[forest.find(at[h])]) for h in hubs]
    return pa.table({"cluster": table["cluster"].slice(0, 1), "largest": pa.array([hubs[int(size.argmax())]], pa.int64()), "component": pa.array([known], pa.map_(pa.int64(), pa.int64()))})


def _verify(percent: int):
    """(id, text, hub, hub_text) -> (id, hub, linked)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column(2).to_numpy()
            for a, b, data, at in slices(batch.column(1)):
                linked = np.zeros(b - a, bool)
                for hub in np.unique(hubs[a:b]):
                    rows = np.flatnonzero(hubs[a:b] == hub)
                    hub_text = np.frombuffer((batch.column(3)[a + int(rows[0])].as_py() or "").encode(), np.uint8)
                    texts = np.concatenate([hub_text, data[ranges(at[rows], at[rows + 1] - at[rows])]])
                    flat, ends, _ = shingles.exact_sets(texts, np.cumsum(np.concatenate([[0, len(hub_text)], at[rows + 1] - at[rows]])), estimated=False)
                    linked[rows] = [similar(flat[: ends[1]], flat[i:j], percent) for i, j in zip(ends[1:], ends[2:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(linked)], ["id", "hub", "linked"])

    return run


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, which follow each other in the batches, and where the runs start."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.any([(c := table[k].to_numpy())[1:] != c[:-1] for k in keys], axis=0)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        if held.num_rows >= rows and len(start := starts(held)) > 1:
            yield held.slice(0, int(start[-1])), start[:-1]
            held = held.slice(int(start[-1]))
    if held is not None:
        yield held, starts(held)


BLOCK_KEY = ["bucket", "row_block", "column_block"]


def _find(forest: dict[int, int], i: int) -> int:
    while (j := forest.setdefault(i, i)) != i:
        i = forest[i] = forest[j]
    return i


def _near_pairs(table: pa.Table, start: np.ndarray, register: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an open member and another of its block (runs of rows from start on) whose estimate comes near the threshold and whose known components differ; the estimates."""
    side, known = table["side"].to_numpy(), table["known"].to_numpy()
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(known))))
    rows, columns = np.flatnonzero((side != COLUMN) & table["open"].to_numpy(zero_copy_only=False)), np.flatnonzero(side != ROW)
    column_at = np.searchsorted(run[columns], np.arange(len(start) + 1))
    first, many = column_at[run[rows]], column_at[run[rows] + 1] - column_at[run[rows]]
    total = np.concatenate([[0], np.cumsum(many)])
    a, b, near, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PAIRS, side="right")) - 1)
        i, j = np.repeat(rows[low:high], many[low:high]), columns[ranges(first[low:high], many[low:high])]
        low = high
        apart = known[i] != known[j]
        i, j = i[apart], j[apart]
        guess = shingles.estimate(register[i], register[j], n[i], n[j])
        hit = guess >= percent / 100 - MARGIN
        a, b, near = [*a, i[hit]], [*b, j[hit]], [*near, guess[hit]]
    return np.concatenate(a), np.concatenate(b), np.concatenate(near)


def _first_shared(register: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair's bucket is that of the first band that the pair shares, so that one bucket alone settles it."""
    keys, out = shingles.band_keys(register), np.zeros(len(i), bool)
    for low in range(0, len(i), PAIRS):
        x, y = i[low : low + PAIRS], j[low : low + PAIRS]
        out[low : low + PAIRS] = keys[x, (keys[x] == keys[y]).argmax(1)] == bucket[x]
    return out


def _forest_pairs(percent: int):
    """(a, b): pairs near the threshold that connect components which a task's earlier ones don't connect yet, the likest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[int, int] = {}
        for table, start in _segments(batches, BLOCK_KEY):
            ids, known = table["id"].to_numpy(), table["known"].to_numpy()
            a, b, near = _near_pairs(table, start, _registers(table["registers"]), table["n_shingles"].to_numpy(), percent)
            kept = []
            for k in np.argsort(-near, kind="stable").tolist():
                p, q = _find(forest, int(known[a[k]])), _find(forest, int(known[b[k]]))
                if p != q:
                    forest[p] = q
                    kept.append(k)
            x, y = ids[a[kept]], ids[b[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])

    return run


def _unsettled(percent: int):
    """The members that a block has to compare by their sets, on their sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _segments(batches, BLOCK_KEY):
            register = _registers(table["registers"])
            a, b, _ = _near_pairs(table, start, register, table["n_shingles"].to_numpy(), percent)
            mine = _first_shared(register, table["bucket"].to_numpy(), a, b)
            rows, columns = np.unique(a[mine]), np.unique(b[mine])
            out = table.select([*BLOCK_KEY, "id", "known"]).take(pa.array(np.concatenate([rows, columns])))
            side = np.repeat(np.array([ROW, COLUMN], np.int32), [len(rows), len(columns)])
            yield from out.append_column("side", pa.array(side)).append_column("open", pa.array(side == ROW)).combine_chunks().to_batches()

    return run


def _settle_blocks(percent: int):
    """(a, b): links inside blocks between components that a task's earlier ones don't connect yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[int, int] = {}
        for table, start in _segments(batches, BLOCK_KEY, rows=128):
            group, known, links = Group(table), table["known"].to_numpy(), []
            a, b, near = _near_pairs(table, start, group.registers, group.n, percent)
            mine = np.flatnonzero(_first_shared(group.registers, table["bucket"].to_numpy(), a, b))
            for k in mine[np.argsort(-near[mine], kind="stable")].tolist():
                i, j = int(a[k]), int(b[k])
                p, q = _find(forest, int(known[i])), _find(forest, int(known[j]))
                if p != q and group.similar(i, j, percent):
                    forest[p] = q
                    links.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array(group.ids[[x[k] for x in links]], pa.int64()) if links else pa.array([], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


#: Sides of a block of a bucket that a member stands on.
BOTH, ROW, COLUMN = 0, 1, 2


def _blocks(rows: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Members (id, known, open of rows; n_shingles, registers) in each block of their buckets, but buckets without an open one or of one component."""
    whole = members.select("id", "n_shingles", "registers").join(rows, "id")
    slim, full = ("known", "open"), ("id", "known", "open", "n_shingles", "registers")
    spots = whole.mapInArrow(_member_bands(slim), "bucket long, known long, open boolean")
    sizes = spots.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if("open").alias("open_ones"), F.min("known").alias("low"), F.max("known").alias("high"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("long")
    sizes = stored(sizes.where("open_ones > 0 AND low <> high").select("bucket", blocks("open_ones").alias("row_blocks"), blocks("all").alias("column_blocks")))
    placed = whole.mapInArrow(_member_bands(full), "bucket long, id long, known long, open boolean, n_shingles long, registers binary").join(sizes, "bucket").withColumn("deal", F.xxhash64("id"))
    zero, spot = F.lit(0).cast("long"), lambda r, c, side: F.struct(r.alias("row_block"), c.alias("column_block"), F.lit(side).alias("side"))
    every = lambda c, f: F.transform(F.sequence(zero, F.col(c) - 1), f)
    own_row, own_column = F.pmod("deal", "row_blocks"), F.pmod("deal", "column_blocks")
    as_row = F.when(F.col("open"), every("column_blocks", lambda c: spot(own_row, c, ROW))).otherwise(F.array().cast("array<struct<row_block:bigint,column_block:bigint,side:int>>"))
    spots = F.when(F.col("column_blocks") > 1, F.concat(as_row, every("row_blocks", lambda r: spot(r, own_column, COLUMN)))).otherwise(F.array(spot(zero, zero, BOTH)))
    return _in_order(placed.select("bucket", *full, F.explode(spots).alias("spot")).select("bucket", *full, "spot.*"))


def _in_order(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "id")


def _large(members: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Components of clusters that one task shouldn't hold. members: id, cluster, docs (of the cluster), n_shingles, registers; texts: id, text."""
    sampled = members.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) * F.col("docs") < SAMPLE * 1_000_000) | (F.col("id") == F.col("cluster")))
    hubs = stored(sampled.select("cluster", "id", "n_shingles", "registers").groupBy("cluster").applyInArrow(_pick_hubs(percent), "cluster long, hubs array<bigint>, hub_n array<bigint>, hub_registers binary"))
    near = members.join(hubs, "cluster").select("id", "n_shingles", "registers", "hubs", "hub_n", "hub_registers").mapInArrow(_near_hubs(percent), "id long, hub long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (id, hub) with whether they link."""
        second = texts.select(F.col("id").alias("hub"), F.col("text").alias("hub_text"))
        return stored(pairs.join(texts, "id").join(second, "hub").select("id", "text", "hub", "hub_text").mapInArrow(_verify(percent), "id long, hub long, linked boolean"))

    stars = stored(verified(near.where("id <> hub")).where("linked").unionByName(hubs.select(F.explode("hubs").alias("id")).select("id", F.col("id").alias("hub"), F.lit(True).alias("linked"))).groupBy("id").agg(F.array_sort(F.collect_set("hub")).alias("hubs")))
    sets = members.select("id", "cluster").join(stars, "id").groupBy("cluster", "hubs").agg(F.count("*").alias("docs"))
    merged = stored(sets.groupBy("cluster").applyInArrow(_merge_hubs, "cluster long, largest long, component map<bigint, bigint>"))
    rows = members.join(stars.select("id", F.col("hubs")[0].alias("hub")), "id", "left").join(merged, "cluster", "left")
    known = F.coalesce(F.try_element_at("component", "hub"), "id")
    rows = stored(rows.select("id", known.alias("known"), (~known.eqNullSafe(F.col("largest"))).alias("open")))
    links = rows.where("id <> known").select(F.col("id").alias("a"), F.col("known").alias("b"))

    pairs = _blocks(rows, members, block).mapInArrow(_forest_pairs(percent), "a long, b long").distinct().select(F.col("a").alias("id"), F.col("b").alias("hub"))
    links = stored(links.unionByName(verified(pairs).where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))))
    now = rows.join(components(links), "id", "left").select("id", F.coalesce("component", "known").alias("known"), "open")
    spots = "bucket long, row_block long, column_block long, id long, known long, side int, open boolean"
    left = stored(_blocks(stored(now), members, block).mapInArrow(_unsettled(percent), spots))
    more = _in_order(left.join(texts, "id")).mapInArrow(_settle_blocks(percent), "a long, b long")
    return components(links.unionByName(more))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in slices(batch.column(0)):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shingles.digests(data, at), pa.binary())], [*part.schema.names, "__digest"])


def with_digests(df: DataFrame) -> DataFrame:
    """text and the other columns of df, with the digest of the text's words as __digest."""
    df = df.select("text", *(f"`{c}`" for c in df.columns if c != "text"))
    return df.mapInArrow(_digested, StructType([*df.schema.fields, StructField("__digest", BinaryType())]))


class _Classes:
    """The classes of texts of a table, each under an id of its own: a doc_id that has this text alone, or a negative number where there is none.

    table: id, digest, least (the least doc_id with this text), n_shingles, registers, copies; texts: id, text; several: the doc_ids of more than one text (no words are one, too), or None.
    """

    def __init__(self, df: DataFrame, sketch: DataFrame):
        some = sketch.where("n_shingles > 0 and doc_id is not null")
        each = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("least"), F.count("*").alias("copies"))
        each = each.select("digest", F.col("least.doc_id").alias("least"), "least.n_shingles", "least.registers", "copies")
        rows = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
        text = F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(F.lit(b""))
        several = sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id")
        self.several = stored(several)
        if self.several.isEmpty():
            self.several, self.texts, self.table = None, rows, stored(each.withColumn("id", F.col("least")))
            return
        owners = some.select("doc_id", "digest").join(self.several, "doc_id", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("id"))
        each = stored(each.join(owners, "digest", "left"))
        orphans = stored(each.where("id IS NULL").withColumn("id", -1 - F.monotonically_increasing_id()))
        self.table = stored(each.where("id IS NOT NULL").unionByName(orphans))
        named = self.several.select(F.col("doc_id").alias("id"))
        odd = with_digests(rows.join(named, "id", "left_semi")).withColumnRenamed("__digest", "digest").select("digest", "text")
        odd = odd.join(orphans.select("digest", "id"), "digest").groupBy("id").agg(F.first("text").alias("text"))
        self.texts = stored(rows.join(named, "id", "left_anti").unionByName(odd))


def _text_components(df: DataFrame, sketch: DataFrame, percent: int, group_docs: int, group_shingles: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """digest and component (the least doc_id of a text that links reach) of the classes of several rows or in links; and the doc_ids of several texts, if any."""
    found = _Classes(df, sketch)
    classes, texts = found.table, found.texts
    bands = classes.select("id", "registers").mapInArrow(_bands, "id long, bucket long")
    least = stored(bands.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1").select("bucket", "least"))
    tied = components(bands.join(least, "bucket").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    clusters = stored(tied.select("id", F.col("component").alias("cluster")))
    members = clusters.join(classes.select("id", "n_shingles"), "id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    big = stored(sizes.where((F.col("docs") > group_docs) | (F.col("shingles") > group_shingles)))
    # A cluster of a few very long texts stays whole.
    big = big.where(F.col("docs") > 8)
    small = clusters.join(big, "cluster", "left_anti").join(texts, "id").select("cluster", "id", "text")
    linked = small.groupBy("cluster").applyInArrow(_settle(percent), "id long, component long")
    if not big.isEmpty():
        inside = stored(clusters.join(big, "cluster").join(classes.select("id", "n_shingles", "registers"), "id"))
        large_texts = stored(texts.join(inside.select("id"), "id", "left_semi"))
        linked = linked.unionByName(_large(inside, large_texts, percent, block))
    linked = linked.groupBy("id").agg(F.min("component").alias("component"))
    label = classes.join(linked, "id", "left").select("digest", "least", F.coalesce("component", "id").alias("component"), "id", "copies")
    if found.several is None:
        return stored(label.where("copies > 1 or component <> id").select("digest", "component")), None
    label = stored(label)
    name = label.groupBy("component").agg(F.min("least").alias("name"))
    return stored(label.join(name, "component").select("digest", F.col("name").alias("component"))), found.several


def near_components(df: DataFrame, percent: int = 85, group_docs: int = GROUP_DOCS, group_shingles: int = GROUP_SHINGLES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach), kept (the least itself), a row for each row of df."""
    sketch = stored(sketches(df))
    label, several = _text_components(df, sketch, percent, group_docs, group_shingles, block)
    out = sketch.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("digest")).alias("digest"))
    out = out.join(label.hint("shuffle_merge"), "digest", "left")
    if several is not None:  # a document's texts are one document
        out = stored(out)
        ties = out.where("component IS NOT NULL").join(several, "doc_id").groupBy("doc_id").agg(F.collect_set("component").alias("all"), F.min("component").alias("b"))
        tied = components(ties.select(F.explode("all").alias("a"), "b")).select(F.col("id").alias("component"), F.col("component").alias("tied"))
        out = out.join(tied, "component", "left").withColumn("component", F.coalesce("tied", "component"))
        whole = out.where("component IS NOT NULL").join(several, "doc_id").groupBy("doc_id").agg(F.min("component").alias("whole"))  # its rows without words go along
        out = out.join(whole, "doc_id", "left").withColumn("component", F.coalesce("component", "whole"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(df: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of df whose text is the first of its near-duplicates, that of the least doc_id: no text goes that isn't like one that stays.

    A document of several texts keeps or loses each by itself. Rows without doc_id or without words stay, and so do all rows of the least doc_id.
    """
    df = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = stored(sketches(df))
    label, several = _text_components(df, sketch, percent, GROUP_DOCS, GROUP_SHINGLES, BLOCK)
    later = sketch.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest").join(label.hint("shuffle_merge"), "digest").where("doc_id <> component").select("doc_id", "digest").distinct()
    if several is None:
        return df.join(later.select("doc_id"), "doc_id", "left_anti").select(*(f"`{c}`" for c in df.columns))
    later = stored(later)
    single, odd = df.join(several, "doc_id", "left_anti"), with_digests(df.join(several, "doc_id", "left_semi"))
    single = single.join(later.select("doc_id").distinct(), "doc_id", "left_anti")
    odd = odd.join(later.withColumnRenamed("digest", "__digest"), ["doc_id", "__digest"], "left_anti")
    return single.select(*(f"`{c}`" for c in df.columns)).unionByName(odd.select(*(f"`{c}`" for c in df.columns)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"), 85)


#: All pairs that share a shingle are counted, so this is for small tables.
OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], chr(31)) AS shingle FROM spots),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a),
low AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component, d.doc_id) AS component_id, coalesce(low.component, d.doc_id) = d.doc_id AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id
"""
