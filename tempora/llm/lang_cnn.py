"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text's bytes, with Latin capitals made small, are cut into windows of fixed length, all of them, the last
padded with zeros. Filters of several widths see one-hot bytes, so a filter is a table of weights for each of its
places; their largest responses in a window (through a rectifier) feed a softmax. A text's score for a language is
the mean of its windows' probabilities.

The network learns on the driver from all windows of a bounded sample of labelled documents (TRAIN_DOCS at most, as many whole
texts as fit into TRAIN_BYTES); everything else covers all rows. Documents whose crc32 of the id as text leaves 2 modulo 4
are held out of it, as are rows without an id. Texts that are null or without a letter are `und` with score 0, as is
everything if there is nothing to learn from. Of languages with equal scores the first in the order of their names counts. Repeated
rows are each returned. Columns to carry that have the name of an output column aren't carried. A text of any length is whole in one
task. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import read, slices, whole_sample

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, BATCH = 4000, 4 << 20, 4, 64


def small(data: np.ndarray) -> np.ndarray:
    """Latin capitals made small: A-Z, and the letters of Latin-1 in UTF-8."""
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if len(data) > 1:
        out[1:] = np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E), data[1:] + np.uint8(32), out[1:])
    return out


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the documents, one in each row, and how many each document has."""
    count = -(-np.diff(at) // WINDOW)
    document = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    start = at[:-1][document] + (np.arange(len(document)) - first[document]) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[1:][document][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(place, len(data))], np.uint8(0)), count


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        out, places = [], []
        for table, bias in zip(self.tables, self.biases, strict=True):
            width = len(table)
            reach = x.shape[1] - width + 1
            response = table[0][x[:, :reach]]
            for k in range(1, width):
                response += table[k][x[:, k : k + reach]]
            best = response.argmax(1)
            out.append(np.take_along_axis(response, best[:, None], 1)[:, 0] + bias)
            places.append(best)
        return np.maximum(np.concatenate(out, 1), 0), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = []
        for table, bias in zip(self.tables, self.biases, strict=True):
            reach = x.shape[1] - len(table) + 1
            response = table[0][x[:, :reach]]
            for k in range(1, len(table)):
                response += table[k][x[:, k : k + reach]]
            hidden.append(response.max(1) + bias)
        return softmax(np.maximum(np.concatenate(hidden, 1), 0) @ self.dense + self.dense_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Adam steps on cross-entropy; the largest responses alone pass gradients on."""
    langs, y = np.unique(labels, return_inverse=True)
    rng = np.random.default_rng(seed)
    net = Network(
        langs.tolist(), [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    weights = [*net.tables, *net.biases, net.dense, net.dense_bias]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            xb, hot = x[rows], np.eye(len(langs), dtype=np.float32)[y[rows]]
            hidden, places = net.pooled(xb)
            error = (softmax(hidden @ net.dense + net.dense_bias) - hot) / len(rows)
            back = (error @ net.dense.T) * (hidden > 0)
            grads = []
            for n, (table, best) in enumerate(zip(net.tables, places, strict=True)):
                g, own = np.zeros_like(table), back[:, n * FILTERS : (n + 1) * FILTERS]
                for k in range(len(table)):
                    np.add.at(g[k], (np.take_along_axis(xb, best + k, 1), np.arange(FILTERS)[None].repeat(len(rows), 0)), own)
                grads.append(g)
            grads += [back[:, n * FILTERS : (n + 1) * FILTERS].sum(0) for n in range(len(WIDTHS))]
            grads += [hidden.T @ error, error.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                weights[i] -= (0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in slices(batch.column(1)):
            x, count = windows(small(data), at)
            document = np.repeat(np.arange(len(count)), count)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(document)), pa.array([w.tobytes() for w in x], pa.binary())], ["lang", "bytes"])


def learn(df: DataFrame, docs: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> Network | None:
    """A network from a sample of at most docs labelled rows that aren't held out."""
    known = df.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    chosen = whole_sample(known, F.xxhash64("doc_id"), docs, size).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in chosen.mapInArrow(_examples, "lang string, bytes binary").collect())
    if not rows:
        return None
    return train(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), WINDOW), [r[0] for r in rows])


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = broadcast.value
        for batch in batches:
            has_letter = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, data, at in slices(batch.column(1)):
                x, count = windows(small(data), at)
                at_window = np.concatenate([[0], np.cumsum(count)])
                p = np.concatenate([np.zeros((0, len(net.langs))), *(net.probabilities(x[k : k + 256]) for k in range(0, len(x), 256))])
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
                mean = (total[at_window[1:]] - total[at_window[:-1]]) / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                ok = has_letter[a:b] & (count > 0)
                lang = [net.langs[k] if good else "und" for k, good in zip(best, ok, strict=True)]
                score = np.where(ok, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                kept = [batch.column(k).slice(a, b - a) for k in (0, *range(3, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score)], [batch.schema.names[0], *batch.schema.names[3:], "lang_pred", "score"])

    return run


def predict(df: DataFrame, net: Network | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, lang_pred and score of each row; neither lang, source nor doc_id has a part in them."""
    carry = tuple(c for c in carry if c not in ("doc_id", "lang_pred", "score"))
    fields = [df.schema["doc_id"], *(df.schema[c] for c in carry)]
    if net is None:
        return df.select("doc_id", *carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    picked = df.select("doc_id", F.col("text").alias("__text"), F.col("text").rlike(r"\p{L}").alias("__letter"), *carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    return picked.mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(net)), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
