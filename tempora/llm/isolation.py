"""Quality rules whose last is an isolation forest on the rules' own statistics.

Two plain rules reject texts of too few words or too many repeated windows. All else is judged by how easily its statistics are
isolated: trees split rows at random values of random statistics, and a text that is told apart after few splits is anomalous.
Forest and threshold come from all labelled rows that the plain rules leave (equal statistics count once): one half is what trees are drawn from, as an isolation
forest does it, LEAF_SAMPLE rows for each tree, and the splits don't see the labels; the threshold is the one that parts good from bad best on the whole other half,
among those that lose at most LOSS of the good ones. Without labelled rows of both kinds on that half the plain rules alone decide.

Nulls and texts without words have zeros everywhere and fail the first rule. Repeated rows are each judged; rows without an id are judged like others
but have no label. A score equal to the threshold is kept. A text of any length is whole in one task. Columns to carry that have the name of an output column
aren't carried. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import distinct, grouped, mix, prefix_sums, range_hash, read, slices, stored
from tempora.llm.quality_em import MEASURES, measures
from tempora.llm.shingles import word_spans

TREES, LEAF_SAMPLE, LOSS, SEED = 200, 256, 0.01, 17
#: Equal parts of 0 .. 1 by which scores are counted before they are looked at one by one.
SLOTS = 4096
#: The plain rules: least words, words of a window, most repeated words of 100.
LEAST_WORDS, WINDOW, REPEATED = 10, 5, 20
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW + 1)], np.uint64)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _exact_windows(ids: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of words, equal where documents and words are."""
    number = document[:n]
    for k in range(WINDOW):
        _, number = grouped(number.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids[k : k + n])
    return number


def repeated_words(ids: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether a window of WINDOW words that stands twice or more in the word's document holds it. Equal ids are equal words; hashes of windows are confirmed by them."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(ids), bool)
    wide = ids.astype(np.uint64)
    first, which = grouped(mix(sum(wide[k : k + n] * _ODD[k] for k in range(WINDOW)) + document[:n].astype(np.uint64) * _ODD[WINDOW]))
    of = first[which]
    same = document[:n] == document[of]
    for k in range(WINDOW):
        same &= ids[k : k + n] == ids[of + k]
    if not same.all():
        which = _exact_windows(ids, document, n)
    whole = document[:n] == document[WINDOW - 1 :]  # others go over into the next document
    again = (np.bincount(which, whole)[which] >= 2) & whole
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[WINDOW : WINDOW + n] -= again
    return np.cumsum(edge)[: len(ids)] > 0


def duplicate_lines(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """For each document its lines with a word that equal one before. solid: which bytes belong to words."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    feed = data == 10
    head = np.zeros(len(data) + 1, bool)
    head[at] = True
    head[1:] |= feed
    start = np.flatnonzero(head[:-1])
    end = np.append(start[1:], len(data))
    some = _sums(solid, np.append(start, len(data))) > 0
    end = end - feed[end - 1]
    start, end = start[some], end[some]
    document = np.searchsorted(at, start, side="right") - 1
    _, line = distinct(data, start, end, range_hash(prefix_sums(data), start, end))
    first, which = grouped(line * np.int64(n) + document)
    return np.bincount(document, first[which] != np.arange(len(line)), n).astype(np.int64)


def statistics(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS of each document, and what the forest sees: these as shares, and shares of kinds of bytes and words."""
    _, start, end = word_spans(data, at)
    word_at = np.searchsorted(start, at)
    n = np.diff(word_at)
    solid = (data != 0x20) & ((data < 9) | (data > 13))
    hashes = range_hash(prefix_sums(data), start, end)
    _, ids = distinct(data, start, end, hashes)
    document = np.repeat(np.arange(len(n)), n)
    counts = np.stack([n, _sums(solid & ((data & 0xC0) != 0x80), at), _sums(np.isin(data, SYMBOLS), at), duplicate_lines(data, at, solid), np.bincount(document, repeated_words(ids, document), len(n)).astype(np.int64)], 1)
    lines = np.maximum(_sums(data == 10, at) + 1, 1)
    some = np.maximum(n, 1)
    own = np.stack([np.log1p(n), counts[:, 1] / some, counts[:, 2] / some, counts[:, 3] / lines, counts[:, 4] / some], 1)
    return counts, np.concatenate([own, measures(data, at, hashes, start, word_at)[1]], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEATED * counts[:, 0])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """The mean depth at which a search in a random tree of n points ends without a find."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _depth(sample: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, sample)))))


def grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree of the rows as a complete binary one: each node's feature and split, and the path lengths of leaves, which stand below them on the lowest level, too."""
    nodes = 1 << depth + 1
    feature, split, path = np.zeros(nodes, np.int16), np.full(nodes, np.inf), np.zeros(nodes)
    todo = [(1, 0, rows)]
    while todo:
        node, level, held = todo.pop()
        low, high = held.min(0), held.max(0)
        open_ = np.flatnonzero(low < high)
        if level == depth or len(held) <= 1 or not len(open_):
            below = node << depth - level
            path[below : below + (1 << depth - level)] = level + _mean_path(np.array([len(held)]))[0]
            continue
        f = int(rng.choice(open_))
        s = rng.uniform(low[f], high[f])
        left = held[:, f] <= s
        feature[node], split[node] = f, s
        todo += [(2 * node, level + 1, held[left]), (2 * node + 1, level + 1, held[~left])]
    return feature, split, path


class Forest:
    """Trees as rows of complete binary trees."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = LEAF_SAMPLE, seed: int = SEED):
        rng, n = np.random.default_rng(seed), len(rows)
        size = min(sample, n)
        self._set(size, [grow(rows[rng.choice(n, size, replace=False)], _depth(size), rng) for _ in range(trees)])

    @classmethod
    def of(cls, sample: int, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Forest:
        """The forest of trees that are grown already, of sample rows each."""
        out = cls.__new__(cls)
        out._set(sample, trees)
        return out

    def _set(self, sample: int, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.sample, self.depth = sample, _depth(sample)
        self.feature, self.split, self.path = (np.stack(x) for x in zip(*trees, strict=True))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over that of a random tree: near 1 for what is isolated at once, 0.5 and less for the rest."""
        tree, node = np.arange(len(self.split)), np.ones((len(rows), len(self.split)), np.int64)
        for _ in range(self.depth):
            value = np.take_along_axis(rows, self.feature[tree, node].astype(np.int64), 1)
            node = 2 * node + (value > self.split[tree, node])
        mean = self.path[tree, node].mean(1) if len(rows) else np.zeros(0)
        return 2 ** -(mean / max(_mean_path(np.array([self.sample]))[0], 1e-9))


def threshold(score: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The score up to which rows are kept that rejects the most bad rows for the good ones that go, of which at most a share of loss may go."""
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(score)
    lost = 1 - np.searchsorted(np.sort(score[good]), cuts, side="right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), cuts, side="right") / (~good).sum()
    gain = np.where(lost <= loss, caught - lost, -1)
    at = int(gain.argmax())
    nxt = cuts[at + 1] if at + 1 < len(cuts) else np.inf
    return float(cuts[at] if np.isinf(nxt) else (cuts[at] + nxt) / 2)


def settled(scored: DataFrame, loss: float = LOSS) -> float:
    """threshold() of a table of any size. scored: score (0 to 1), good, bad (whether such rows have it)."""
    each = stored(scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad")).withColumn("slot", F.floor(F.col("score") * SLOTS)))
    slots = each.groupBy("slot").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("slot").collect()  # SLOTS + 1 rows at most
    good, bad = (np.cumsum([0, *(r[c] for r in slots)]).tolist() for c in ("good", "bad"))
    if not good[-1] or not bad[-1]:
        return np.inf
    ahead = scored.sparkSession.createDataFrame([(r["slot"], g, b) for r, g, b in zip(slots, good, bad, strict=False)], "slot long, good_ahead long, bad_ahead long")
    up_to_now = Window.partitionBy("slot").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda c, total: 1 - (F.col(f"{c}_ahead") + F.sum(c).over(up_to_now)) / F.lit(float(total))
    cuts = each.join(F.broadcast(ahead), "slot").select("score", share("good", good[-1]).alias("lost"), share("bad", bad[-1]).alias("caught"))
    gain = F.when(F.col("lost") <= loss, F.col("caught") - F.col("lost")).otherwise(-1.0)
    at = cuts.agg(F.max_by("score", F.struct(gain, -F.col("score")))).first()[0]
    after = each.where(F.col("score") > at).agg(F.min("score")).first()[0]
    return at if after is None else (at + after) / 2


def _draws(limit: int, trees: int):
    """Candidates of each tree: rows whose number for it is at most limit."""
    own = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                number = mix(part.column(0).to_numpy().view(np.uint64)[:, None] ^ own)
                row, tree = np.nonzero(number <= np.uint64(limit))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(number[row, tree].view(np.int64)), part.column(1).take(pa.array(row))], ["tree", "number", "seen"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array of lists of one length."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def forest_of(rows: DataFrame, n: int, trees: int = TREES, sample: int = LEAF_SAMPLE) -> Forest:
    """Each tree's rows are those of rows (digest, seen; n of them) whose numbers for it, mixed from their digests, are least.

    A task sends on what is below a bound that twice as many rows as wanted are expected below; fewer than wanted are there with a chance of less than 1e-30.
    Trees are grown side by side, each in a group of some hundred rows.
    """
    size = min(sample, n)
    limit = min((1 << 64) - 1, (1 << 64) * 2 * sample // n)

    def tree(key: tuple, held: pa.Table) -> pa.Table:
        seen = _matrix(held.column("seen").combine_chunks())
        first = np.lexsort([*seen.T, held.column("number").to_numpy().view(np.uint64)])[:size]
        found = grow(seen[first], _depth(size), np.random.default_rng(np.random.SeedSequence(SEED, spawn_key=(key[0].as_py(),))))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x.tolist()], pa.list_(kind)) for c, x, kind in zip(("feature", "split", "path"), found, (pa.int16(), pa.float64(), pa.float64()), strict=True)}})

    drawn = rows.select("digest", "seen").mapInArrow(_draws(limit, trees), "tree int, number long, seen array<double>")
    grown = drawn.groupBy("tree").applyInArrow(tree, "tree int, feature array<smallint>, split array<double>, path array<double>").toArrow().sort_by("tree")  # a row for each tree
    return Forest.of(size, list(zip(*(_matrix(grown.column(c).combine_chunks()) for c in ("feature", "split", "path")), strict=True)))


def _scores(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([pa.array(known.value.score(_matrix(part.column(0)))), part.column(1), part.column(2)], ["score", "good", "bad"])

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = mix(_matrix(batch.column(0)).view(np.uint64).sum(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest.view(np.int64))], [*batch.schema.names, "digest"])


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """seen, good, bad, digest: each distinct row of statistics among the labelled ones that the plain rules leave, and whether good and bad texts have it. labels: doc_id, quality (0 or 1)."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") > 0).alias("is_good"))
    known = rows.where("NOT base_failed").select("doc_id", F.col("__seen").alias("seen")).join(told, "doc_id")
    met = known.groupBy("seen").agg(F.max("is_good").alias("good"), F.max(~F.col("is_good")).alias("bad"))
    return met.mapInArrow(_dealt, "seen array<double>, good boolean, bad boolean, digest long")


def fit(rows: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and the threshold from all labelled rows of measured()."""
    met = stored(labelled(rows, labels))
    grows = F.col("digest") % 2 != 0  # a row's figures deal it to its half, whatever partition it came from
    n = met.agg(F.count_if(grows), F.count_if(~grows)).first()
    if min(n) < 2:
        return None, np.inf
    forest = forest_of(met.where(grows), n[0])
    known = met.sparkSession.sparkContext.broadcast(forest)
    scored = met.where(~grows).select("seen", "good", "bad").mapInArrow(_scores(known), "score double, good boolean, bad boolean")
    return forest, settled(scored)


def learn(df: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and the threshold from the labelled rows of df. labels: doc_id, quality (0 or 1)."""
    return fit(measured(df.where("doc_id IS NOT NULL")), labels)


#: Columns that measured() and decided() add.
_TAKEN = {*COUNTS, "doc_id", "base_failed", "anomaly", "kept", "__seen"}


def _measure(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in slices(batch.column(0)):
                counts, seen = statistics(data, at)
                ends = pa.array(np.arange(0, seen.size + 1, seen.shape[1], dtype=np.int32))
                kept = [batch.column(k).slice(a, b - a) for k in range(1, carried + 1)]
                columns = [*kept, *(pa.array(c.copy()) for c in counts.T), pa.array(base_failed(counts)), pa.ListArray.from_arrays(ends, pa.array(seen.astype(float).ravel()))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], *COUNTS, "base_failed", "__seen"])

    return run


def measured(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, COUNTS, base_failed and __seen (what the forest sees), a row for each row of df."""
    carry = ("doc_id", *(c for c in carry if c not in _TAKEN))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, __seen array<double>"
    return df.select(F.col("text").alias("__text"), *(F.col(f"`{c}`") for c in carry)).mapInArrow(_measure(len(carry)), schema)


def _decide(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, limit = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                failed = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
                score = forest.score(_matrix(part.column(part.num_columns - 1))) if forest else np.zeros(len(failed))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array(~failed & (score <= limit))], [*part.schema.names[:-1], "anomaly", "kept"])

    return run


def decided(rows: DataFrame, model: tuple[Forest | None, float]) -> DataFrame:
    """The rows of measured() with anomaly (the forest's score) and kept instead of what the forest sees."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__seen")
    return rows.mapInArrow(_decide(known), f"{fields}, anomaly double, kept boolean")


def judge(df: DataFrame, model: tuple[Forest | None, float], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, COUNTS, base_failed, anomaly (the forest's score) and kept, a row for each row of df."""
    return decided(measured(df, carry), model)


def op12_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(read(spark, sf_dir, "documents")))  # texts are read once
    return decided(rows, fit(rows, read(spark, sf_dir, "labels")))
