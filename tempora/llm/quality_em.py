"""Text quality from heuristic labellers that overlap: their accuracies are estimated, not given, and a scorer learns from them.

Each labeller votes good, bad or nothing on a text. Expectation-maximisation over the counts of all vote patterns
in the corpus (at most 3 to the number of labellers, whatever the corpus) estimates how often each labeller votes
what for good and for bad texts, and the share of good ones; a pattern's posterior labels its texts. A linear
scorer over hashed words, hashed word shapes and word repeats learns these labels from a bounded sample of
distinct texts (TRAIN_DOCS at most, drawn by a digest of the text, as many whole ones as fit into TRAIN_BYTES) and scores every text whole. Where no text with words is drawn, the
posterior is the score; where no labeller votes, it is near a half.

Nulls and texts without words get no votes, score 0 and aren't kept. Repeated rows are each returned; ids, and null
ids, have no part in a score. A score of exactly a half is kept. Columns to carry that have the name of an output
column aren't carried. Very long texts are whole in one task. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import mix, prefix_sums, range_hash, read, slices, whole_sample
from tempora.llm.shingles import words

TRAIN_DOCS, TRAIN_BYTES, BUCKETS, EPOCHS = 8000, 16 << 20, 1 << 16, 12
NOTHING, BAD, GOOD = 0, 1, 2
#: Labellers: measure, bounds between good and bad (the lower for good if it comes first), and the words a text must have.
LABELLERS = (
    ("signs", 0.05, 0.12, 3), ("capitals", 0.25, 0.55, 3), ("repeats", 0.06, 0.2, 5), ("bars", 0.02, 0.1, 3),
    ("calls", 0.05, 0.3, 3), ("digits", 0.1, 0.3, 3), ("word_bytes", 14.0, 25.0, 3), ("sameness", 0.5, 0.8, 30), ("sign_words", 0.1, 0.3, 3), ("odd_words", 0.2, 0.5, 3), ("top_word", 0.12, 0.2, 30),
)
MEASURES = tuple(x[0] for x in LABELLERS)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def measures(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, start: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and for each labeller its measure: shares of bytes, of letters or of words, or bytes a word."""
    n = np.diff(word_at)
    upper, lower = (data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 128)
    digit, space = (data >= 48) & (data <= 57), (data == 32) | ((data >= 9) & (data <= 13))
    plain = np.isin(data, np.frombuffer(b".,;:'\"()-?", np.uint8))
    size, some = np.maximum(_sums(~space, at), 1), np.maximum(n, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[word_at[:-1][n > 0]] = False
    pairs = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    _, distinct, times = np.unique(mix(hashes + pairs * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    found, top = np.zeros(len(hashes), bool), np.zeros(len(n))
    found[distinct] = True
    np.maximum.at(top, pairs[distinct].astype(np.int64), times)
    sign = ~(upper | lower | digit | space | plain)
    inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.append(start, len(data))])  # noqa: E731  for each word
    out = {
        "signs": _sums(sign, at) / size, "capitals": _sums(upper, at) / np.maximum(_sums(upper | lower, at), 1), "repeats": _sums(again, word_at) / some,
        "bars": _sums(data == 124, at) / some, "calls": _sums(data == 33, at) / some, "digits": _sums(digit, at) / size, "word_bytes": size / some, "sameness": 1 - _sums(found, word_at) / some,
        "sign_words": _sums(inside(sign) > 0, word_at) / some, "odd_words": _sums(inside(lower) == 0, word_at) / some, "top_word": top / some,
    }
    return n, np.stack([out[m] for m in MEASURES], 1)


def votes(n: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """A pattern for each text: its votes as digits to base 3."""
    pattern = np.zeros(len(n), np.int64)
    for k, (_, good, bad, least) in enumerate(LABELLERS):
        vote = np.where(n < least, NOTHING, np.where(measured[:, k] <= good, GOOD, np.where(measured[:, k] >= bad, BAD, NOTHING)))
        pattern += vote * 3**k
    return pattern


def pattern_votes(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, rates (labeller, class bad or good, vote among its votes), share of good."""
    cast = pattern_votes(patterns)
    bad, good = (cast == BAD).sum(1), (cast == GOOD).sum(1)
    posterior = np.where(bad + good, np.clip(0.95 - 0.6 * bad, 0.05, 0.95), 0.5)
    rates, share = np.zeros((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for v in (BAD, GOOD):
            rates[:, :, v] = ((cast == v)[:, :, None] * weight.T[:, None, :]).sum(0) + 0.5
        rates[:, :, NOTHING] = 0
        rates /= rates.sum(2, keepdims=True)
        rates[:, :, NOTHING] = 1  # no vote says nothing
        log = np.log(np.array([1 - share, share]))[None] + sum(np.log(rates[k][:, cast[:, k]]).T for k in range(len(LABELLERS)))
        log -= log.max(1, keepdims=True)
        new = np.exp(log[:, 1]) / np.exp(log).sum(1)
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, rates, share


def features(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, start: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Three buckets for each word: its letters, its shape (runs of capitals, letters, digits, each other sign) and whether it repeats."""
    if not len(hashes):
        return np.zeros((0, 3), np.int64)
    shape = np.where((data >= 65) & (data <= 90), 65, np.where(((data >= 97) & (data <= 122)) | (data >= 128), 97, np.where((data >= 48) & (data <= 57), 48, data))).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[start] = True
    new &= ~space
    place = np.concatenate([[0], np.cumsum(new)])
    end = np.append(start[1:], len(data))
    shapes = range_hash(prefix_sums(shape[new]), place[start], place[end])
    again = np.zeros(len(hashes), np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[word_at[:-1][np.diff(word_at) > 0]] = 0
    half = np.uint64(BUCKETS // 2)
    return np.stack([hashes % half, half + shapes % (half - np.uint64(2)), np.uint64(BUCKETS - 2) + again], 1).astype(np.int64)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in slices(batch.column(0)):
            hashes, start, word_at = words(data, at)
            pattern, n = np.unique(votes(*measures(data, at, hashes, start, word_at)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in slices(batch.column(0)):
            hashes, start, word_at = words(data, at)
            pattern = votes(*measures(data, at, hashes, start, word_at))
            found = features(data, at, hashes, start, word_at)
            rows = [np.unique(found[a:b], return_counts=True) for a, b in zip(word_at, word_at[1:], strict=False)]
            lists = lambda k, kind: pa.array([r[k] for r in rows], pa.list_(kind))  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([pa.array(pattern), lists(0, pa.int32()), lists(1, pa.int32())], ["pattern", "bucket", "times"])


def fit_scorer(rows: list[tuple[float, np.ndarray, np.ndarray]], seed: int = 11) -> np.ndarray:
    """Weights of the buckets, and the bias last, by Adagrad on the soft labels' cross-entropy. rows: (label, buckets, times)."""
    weight, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, bucket, times = rows[i]
            x = times / max(1, times.sum())
            p = 1 / (1 + np.exp(-np.clip(weight[bucket] @ x + weight[-1], -30, 30)))
            for at, g in ((bucket, (p - label) * x), (np.array([BUCKETS]), np.array([p - label]))):
                seen[at] += g * g
                weight[at] -= 0.5 * g / np.sqrt(seen[at])
    return weight


def _score(broadcast, carry_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, patterns, posterior = broadcast.value
        for batch in batches:
            for a, b, data, at in slices(batch.column(1)):
                hashes, start, word_at = words(data, at)
                n, measured = measures(data, at, hashes, start, word_at)
                pattern = votes(n, measured)
                i = np.minimum(np.searchsorted(patterns, pattern), len(patterns) - 1)
                label = score = np.where(n > 0, posterior[i], 0.0)
                if weight is not None:
                    total = np.concatenate([[0], np.cumsum(weight[features(data, at, hashes, start, word_at)].sum(1))])
                    mean = (total[word_at[1:]] - total[word_at[:-1]]) / np.maximum(3 * n, 1)
                    score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(mean + weight[-1], -30, 30))), 0.0)
                kept = [batch.column(k).slice(a, b - a) for k in (0, *range(carry_from, batch.num_columns))]
                names = [batch.schema.names[k] for k in (0, *range(carry_from, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pattern), pa.array(label), pa.array(score), pa.array(score >= 0.5)], [*names, "votes", "label", "score", "keep"])

    return run


def classify(df: DataFrame, carry: tuple[str, ...] = (), docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, the carried columns, votes (pattern), label (posterior of good), score and keep (score of at least 0.5), a row for each row of df."""
    spark = df.sparkSession
    counted = df.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float)
    carry = tuple(c for c in carry if c not in ("doc_id", "votes", "label", "score", "keep"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    schema = f"{fields}, votes long, label double, score double, keep boolean"
    if not len(patterns):
        return spark.createDataFrame([], schema)
    posterior, _, _ = expectation_maximisation(patterns, counts)
    digest = F.xxhash64("text")
    drawn = whole_sample(df.where("text IS NOT NULL").select("text"), digest, docs, TRAIN_BYTES, once=True)
    sample = drawn.mapInArrow(_examples, "pattern long, bucket array<int>, times array<int>").toArrow()
    label = posterior[np.searchsorted(patterns, sample["pattern"].to_numpy())].tolist()
    rows = [(p, b.values.to_numpy(), t.values.to_numpy().astype(float)) for p, b, t in zip(label, sample["bucket"], sample["times"], strict=True) if len(b)]
    rows.sort(key=lambda r: (r[0], r[1].tolist(), r[2].tolist()))
    weight = fit_scorer(rows) if rows else None
    known = spark.sparkContext.broadcast((weight, patterns, posterior))
    return df.select("doc_id", F.col("text").alias("__text"), *carry).mapInArrow(_score(known, 2), schema)


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))
