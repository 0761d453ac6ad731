"""Exact cosine links between embeddings by dual traversal of cover trees.

Unit vectors x and y have a cosine of at least c when |x - y| <= sqrt(2 - 2c). Equal vectors are one point.

The top of the tree is a nested net: farthest-first points of a bounded sample, whose prefixes cover the sample
with ever smaller radii. Every point belongs to its nearest centre; a cell's covering radius and count come from
all its points. Pairs of cells are then pruned (too far apart by centres and covering radii), taken whole (near
enough by the same bounds, so that no pair is made) or tested: a point visits a later cell only if its own
distance to the centre allows a link. Cells are cut into blocks of bounded size and visitors into chunks, so a task
holds no more than a block and a chunk. Inside a task both sides are trees again, with radii that halve from level to
level, and the same three rules are applied to pairs of nodes; leaves are compared in double precision.

A vector that is null, zero or holds a null or a non-finite number links with nothing and is its own
component; so is a row without id, with a null component. Vectors of different lengths don't link; lengths of few
vectors are settled in one pass, each in a task, and only others get a net of their own. Components of any magnitude
count. Rows that repeat an id are one vector's copies: each links with the others' rows. Other columns, whatever
their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import read, stored
from tempora.llm.components import Forest, components

#: Sampled vectors that the centres come from, most cells, points for each cell, points in a block, visitors in a chunk, points in a leaf.
SAMPLE, CELLS, CELL_POINTS, BLOCK, CHUNK, LEAF = 4096, 1024, 2000, 4000, 20_000, 256
#: Bounds of distances are widened by this, as they are computed in floating point.
SLACK = 1e-7


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by their largest component first, as squares of very small or large ones would vanish or overflow."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True, initial=np.finfo(float).smallest_subnormal)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Centres so chosen that each is farthest from those before it; stops when all points are centres."""
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < most:
        i = int(gap.argmax())
        if gap[i] <= SLACK:
            break
        chosen.append(i)
        gap = np.minimum(gap, distances(points, points[i : i + 1])[:, 0])
    return points[chosen]


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A cover tree of the rows: children cover theirs with at most half the radius. Rows that halving doesn't thin out stay a leaf."""
    rows = np.arange(len(points)) if rows is None else rows
    gap = distances(points[rows], points[rows[:1]])[:, 0]
    node = Node(points[rows[0]], float(gap.max()), rows)
    if len(rows) <= LEAF or node.radius <= SLACK:
        return node
    rest, parts = rows, []
    while len(rest):
        if len(parts) >= 32 and len(rest) > len(rows) // 2:
            return node
        near = distances(points[rest], points[rest[:1]])[:, 0] <= node.radius / 2
        near[0] = True
        parts.append(rest[near])
        rest = rest[~near]
    node.children = [tree(points, part) for part in parts]
    return node


class Links:
    """Link counts and connections of the points of one task."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, cosine: float):
        self.points, self.weight, self.cosine = points, weight, cosine
        self.limit = math.sqrt(2 - 2 * cosine)
        self.count = np.zeros(len(points), np.int64)
        self.forest = Forest(len(points))

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a link with all of b; a and b are the same rows or have none in common."""
        same = a is b
        self.count[a] += self.weight[b].sum() - (self.weight[a] if same else 0)
        if not same:
            self.count[b] += self.weight[a].sum()
        for i in a.tolist():
            self.forest.join(i, int(b[0]))
        for j in b.tolist():
            self.forest.join(j, int(a[0]))

    def leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        same = a is b
        for low in range(0, len(a), 1024):
            x = a[low : low + 1024]
            cos = self.points[x] @ self.points[b].T
            hit = cos >= self.cosine
            for i, j in zip(*np.nonzero(np.abs(cos - self.cosine) < 1e-12), strict=True):
                p, q = self.points[x[i]], self.points[b[j]]
                hit[i, j] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= self.cosine
            if same:
                hit[np.arange(len(x)), low + np.arange(len(x))] = False
            if not hit.any():
                continue
            self.count[x] += hit @ self.weight[b]
            if not same:
                self.count[b] += self.weight[x] @ hit
            for i in np.flatnonzero(hit.any(1)).tolist():
                roots = {self.forest.find(j) for j in b[hit[i]].tolist()}
                for j in roots:
                    self.forest.join(int(x[i]), j)

    def dual(self, a: Node, b: Node) -> None:
        """Links of a's rows with b's, which are the same node or have no row in common."""
        if a is b:
            if 2 * a.radius <= self.limit - SLACK:
                self.whole(a.rows, a.rows)
            elif not a.children:
                self.leaves(a.rows, a.rows)
            else:
                for i, x in enumerate(a.children):
                    for y in a.children[i:]:
                        self.dual(x, y)
            return
        gap = float(distances(a.centre[None], b.centre[None])[0, 0])
        if gap - a.radius - b.radius > self.limit + SLACK:
            return
        if gap + a.radius + b.radius <= self.limit - SLACK:
            self.whole(a.rows, b.rows)
        elif not a.children and not b.children:
            self.leaves(a.rows, b.rows)
        elif a.children and (not b.children or a.radius >= b.radius):
            for x in a.children:
                self.dual(x, b)
        else:
            for y in b.children:
                self.dual(a, y)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


@dataclass
class Cells:
    """What all tasks know of the cells: bounded by CELLS."""

    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    chunks: np.ndarray
    tested: np.ndarray


def _assign(centres: np.ndarray):
    """(id, weight, vector) -> with the nearest cell and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                gap = distances(unit(_matrix(part.column(2), centres.shape[1])), centres)
                cell = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(gap[np.arange(len(cell)), cell])], ["id", "weight", "vector", "cell", "gap"])

    return run


def _deal(cells: Cells, limit: float):
    """A row for each block and chunk in which a point is at home or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                x = unit(_matrix(part.column(2), cells.centres.shape[1]))
                home, deal = part.column(3).to_numpy(), part.column(4).to_numpy()
                rows, where, block, chunk, visit = [], [], [], [], []
                add = lambda *c: [a.append(b) for a, b in zip((rows, where, block, chunk, visit), c, strict=True)]
                reach = (distances(x, cells.centres) <= cells.radius + limit + SLACK) & cells.tested[home]
                reach &= np.arange(len(cells.radius)) >= home[:, None]
                own = deal % cells.blocks[home]
                inside = cells.tested[home, home]
                for k in range(int(cells.chunks[home].max())):
                    i = np.flatnonzero(cells.chunks[home] > k)
                    add(i, home[i], own[i], np.full(len(i), k), np.zeros(len(i), bool))
                for k in range(int(cells.blocks.max())):
                    i, c = np.nonzero(reach & (cells.blocks > k))
                    other = (c != home[i]) | ((own[i] < k) & inside[i])
                    i, c = i[other], c[other]
                    add(i, c, np.full(len(i), k), (deal[i] // 7919) % cells.chunks[c], np.ones(len(i), bool))
                rows, where, block, chunk, visit = (np.concatenate(a) for a in (rows, where, block, chunk, visit))
                for a in range(0, len(rows), 8192):
                    s = slice(a, a + 8192)
                    taken = part.select(["id", "weight", "vector"]).take(pa.array(rows[s]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c[s]) for c in (where, block, chunk, visit))], ["id", "weight", "vector", "cell", "block", "chunk", "visit"])

    return run


def _search(cosine: float, size: int, tested: np.ndarray):
    """Links of a block's points with one another (in chunk 0) and with the visitors of a chunk."""

    def run(table: pa.Table) -> pa.Table:
        visit = table["visit"].to_numpy(zero_copy_only=False)
        table = table.take(pa.array(np.argsort(visit, kind="stable")))
        ids = table["id"].to_numpy()
        n = int((~visit).sum())
        links = Links(unit(_matrix(table["vector"], size)), table["weight"].to_numpy(), cosine)
        cell = table["cell"][0].as_py()
        if n:
            home = tree(links.points, np.arange(n))
            if table["chunk"][0].as_py() == 0 and tested[cell, cell]:
                links.dual(home, home)
            if n < len(ids):
                links.dual(tree(links.points, np.arange(n, len(ids))), home)
        root = links.forest.roots()
        linked = np.flatnonzero(links.count)
        return pa.table({"id": pa.array(ids[linked]), "links": pa.array(links.count[linked]), "other": pa.array(ids[root[linked]])})

    return run


def _links(points: DataFrame, cosine: float, size: int, cell_points: int, block: int) -> DataFrame:
    """id, links, other: link counts in parts, and for each linked point another of its component."""
    spark, limit = points.sparkSession, math.sqrt(2 - 2 * cosine)
    total = points.count()
    share = max(1, total // SAMPLE)
    sample = points.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("id", "vector").orderBy("id").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = points.select("id", "vector").orderBy("id").limit(1).toArrow()
    centres = farthest_first(unit(_matrix(sample["vector"], size)), min(CELLS, max(1, -(-total // cell_points))))
    dealt = stored(points.mapInArrow(_assign(centres), "id long, weight long, vector array<double>, cell long, gap double"))
    stats = dealt.groupBy("cell").agg(F.count("*").alias("points"), F.sum("weight").alias("weight"), F.max("gap").alias("radius"), F.min("id").alias("least")).toPandas()
    k = len(centres)
    points_in, weight, radius, least = (np.zeros(k, t) for t in (np.int64, np.int64, np.float64, np.int64))
    for out, name in ((points_in, "points"), (weight, "weight"), (radius, "radius"), (least, "least")):
        out[stats["cell"].to_numpy(np.int64)] = stats[name].to_numpy()
    gap, both = distances(centres, centres), radius[:, None] + radius[None]
    np.fill_diagonal(gap, 0)
    there = (points_in > 0)[:, None] & (points_in > 0)[None]
    whole = there & (gap + both <= limit - SLACK)
    tested = there & ~whole & (gap - both <= limit + SLACK)
    blocks = np.maximum(1, -(-points_in // block))
    chunks = np.maximum(1, -(-(np.tril(tested, 0) @ points_in) // CHUNK))
    cells = spark.sparkContext.broadcast(Cells(centres, radius, blocks, chunks, tested))
    spread = dealt.select("id", "weight", "vector", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("deal"))
    placed = spread.mapInArrow(lambda b: _deal(cells.value, limit)(b), "id long, weight long, vector array<double>, cell long, block long, chunk long, visit boolean")
    found = placed.groupBy("cell", "block", "chunk").applyInArrow(lambda t: _search(cosine, size, cells.value.tested)(t), "id long, links long, other long")
    some = whole.any(1)
    if some.any():
        # Cells taken whole: every point links with all points of the other cells, and with its own cell's but itself. At most CELLS rows.
        label = np.where(some, np.arange(k), k)
        while (label != (label := np.minimum(label, np.where(whole, label[None], k).min(1)))).any():
            pass
        cell = np.flatnonzero(some)
        table = pa.table({"cell": cell, "links": (whole @ weight)[cell], "other": least[label[cell]], "own": whole[cell, cell]})
        more = dealt.join(F.broadcast(spark.createDataFrame(table)), "cell")
        found = found.unionByName(more.select("id", (F.col("links") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links"), "other"))
    return found


def _settle_length(cosine: float):
    """Links of all vectors of one length, which are few."""

    def run(table: pa.Table) -> pa.Table:
        ids, size = table["id"].to_numpy(), table["n"][0].as_py()
        links = Links(unit(_matrix(table["vector"], size)), table["weight"].to_numpy(), cosine)
        home = tree(links.points)
        links.dual(home, home)
        root, linked = links.forest.roots(), np.flatnonzero(links.count)
        return pa.table({"id": pa.array(ids[linked]), "links": pa.array(links.count[linked]), "other": pa.array(ids[root[linked]])})

    return run


def cosine_components(df: DataFrame, cosine: float = 0.95, id: str = "vec_id", vector: str = "embedding", cell_points: int = CELL_POINTS, block: int = BLOCK) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (least id reached), kept, a row for each row of df."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    ok = F.col("vector").isNotNull() & F.col("id").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    pair = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(7), "vector").alias("b"), F.size("vector").alias("n"))
    rows = stored(rows.select("id", "vector", F.when(F.coalesce(ok, F.lit(False)), pair).alias("key")))
    valid = rows.where("key is not null")
    # Equal vectors are one point, by 128 bits and their length; a point's number is its own, not a hash.
    points = stored(valid.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector")))
    points = stored(points.withColumn("point", F.monotonically_increasing_id()))
    sized = points.select(F.col("point").alias("id"), "weight", "vector", F.col("key.n").alias("n"))
    lengths = stored(sized.groupBy("n").agg(F.count("*").alias("points")))
    few = sized.join(lengths.where(F.col("points") <= block).select("n"), "n", "left_semi")
    found = few.groupBy("n").applyInArrow(_settle_length(cosine), "id long, links long, other long")
    # Each length of more than a block of vectors is an index of its own; there are fewer of these than blocks.
    for size in sorted(r["n"] for r in lengths.where(F.col("points") > block).collect()):
        found = found.unionByName(_links(sized.where(F.col("n") == size).drop("n"), cosine, size, cell_points, block))
    found = stored(found)
    counts = found.groupBy(F.col("id").alias("point")).agg(F.sum("links").alias("links"))
    # One id may carry several vectors; they are one vertex.
    many = valid.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("id")
    several = stored(valid.select("id", "key").join(many, "id", "left_semi").join(points.select("key", "point"), "key").select("id", "point"))
    same = several.join(several.groupBy("id").agg(F.min("point").alias("low")), "id").select(F.col("point").alias("a"), F.col("low").alias("b"))
    labels = stored(components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(same)).select(F.col("id").alias("point"), "component"))
    least = stored(labels.join(points.select("point", "least"), "point").groupBy("component").agg(F.min("least").alias("component_id")))
    label = points.select("key", "point", "least", "weight").join(counts, "point", "left").join(labels.join(least, "component").select("point", "component_id"), "point", "left")
    label = stored(label.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = rows.select("id", "key").join(label.hint("shuffle_merge"), "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(read(spark, sf_dir, "embeddings"))


#: All pairs of vectors, so this is for small tables.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a),
low AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(low.component, vec_id) AS component_id, coalesce(low.component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.id = vec_id
"""
