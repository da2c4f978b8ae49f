"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words (runs of letters, digits and non-ASCII bytes, lower-cased) hash to features: single words,
pairs of neighbours and pairs with one word between. A document's features are present or absent.
FTRL-proximal keeps a learning rate per coordinate; its L1 term leaves few non-zero weights. Only
those are broadcast, as index and weight (12 bytes each, at most 2**bits of them).

Training takes a bounded sample of labelled rows (`sample_rows` ids by hash, one row of each, texts of
at most SAMPLE_BYTES); scoring is one pass over all documents without a shuffle.

Defined results: null and empty texts have the bias alone; without usable labels the score is the
prior; null labels are not used; several labels of an id count as the largest; of several rows of an
id one is learned from (the least hash of the text); repeated rows are scored each; ids may be of any
type that hashes; texts of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import crc_bucket, lean, small_batches, text_bytes
from lumaflow.llm.rolling import LETTER, hashed_words, mix
from lumaflow.llm.token_counts import text_groups

BITS = 20
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 1 << 18


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram and skip-gram occurrence, and its text. Feature 0 is left to the bias."""
    word, owner = hashed_words(texts, LETTER)
    parts, owners = [word], [owner]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(word) > gap:
            same = owner[gap:] == owner[:-gap]
            parts.append(mix(word[:-gap][same] * np.uint64(0x9E3779B1) + word[gap:][same] + np.uint64(salt)))
            owners.append(owner[:-gap][same])
    index = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.maximum(index, 1), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) for binary features."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        l1 = np.where(index == 0, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, index: np.ndarray, label: float) -> None:
        w = self.weights(index)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out_modulus: int, held_out_rest: int, sample_rows: int) -> DataFrame:
    """key (hash of the id), text, label of at most about sample_rows ids outside the held-out ones, chosen by hash; one row of an id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_bucket("doc_id", held_out_modulus) != held_out_rest))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the sample is bounded by sample_rows, and so is what is broadcast
    rows = small_batches(docs).select("doc_id", text_bytes("text").alias("text")).where(F.length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select(F.xxhash64("doc_id").alias("key"), F.col("one.text").alias("text"), "label")


def train(sample: DataFrame, epochs: int = 3, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights that are not 0 (feature 0: the bias); the sample is featurised in parallel and learned in one task."""

    def featurise(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts, 1 << 20):
                n = part.stop - part.start
                index, owner = features(texts[part], bits)
                key = np.unique(owner << bits | index)
                cut = np.searchsorted(key, np.arange(n + 1) << bits).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), rows, batch.column(2).slice(part.start, n)], ["key", "features", "label"])

    def learn(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("index", "weight"), fit(*sample_arrays(table, "features"), epochs, bits), strict=True)))

    made = sample.mapInArrow(lean(featurise), "key long, features array<int>, label double")
    rows = made.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(learn, "index long, weight double").toArrow()
    if not rows.num_rows:
        return np.zeros(1, np.int64), np.array([np.log(0.5 / 4.5)])
    order = np.argsort(rows["index"].to_numpy())
    return rows["index"].to_numpy()[order], rows["weight"].to_numpy()[order]


def sample_arrays(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' values end to end, their bounds and the labels, ordered by key, label and size, without copies by row."""
    lists = table[column].combine_chunks()
    flat, bound = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    size, label, key = np.diff(bound), table["label"].to_numpy(), table["key"].to_numpy()
    order = np.lexsort((size, label, mix(key.view(np.uint64) + np.uint64(17))))
    end = np.cumsum(size[order])
    at = np.repeat(bound[:-1][order] - (end - size[order]), size[order]) + np.arange(end[-1] if len(end) else 0)
    return flat[at], np.concatenate([[0], end]), label[order]


def fit(flat: np.ndarray, bound: np.ndarray, label: np.ndarray, epochs: int = 3, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL over rows of features; features and weights that are not 0."""
    model, yes = Ftrl(bits), (label >= 0.5).sum()
    prior = np.log((yes + 0.5) / (len(label) - yes + 4.5))
    model.z[0] = -prior * (model.beta / model.alpha + model.l2)
    for _ in range(epochs):
        for i in range(len(label)):
            model.learn(np.concatenate([[0], flat[bound[i] : bound[i + 1]]]), float(label[i] >= 0.5))
    weights = model.weights(np.arange(1 << bits))
    kept = np.flatnonzero(weights)
    return kept.astype(np.int64), weights[kept]


def scores(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    index, owner = features(texts, bits)
    hit = np.flatnonzero(weights[index])
    key = np.unique(owner[hit] << bits | index[hit])
    total = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], len(texts)) + float(weights[0])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3, keep: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns of `keep` (each is sent to the workers once, the text too)."""
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    narrow = small_batches(docs).select(F.col("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep) if c != "text"])
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def run(batches):
        dense = np.zeros(1 << bits, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            s = np.concatenate([scores(texts[part], dense, bits) for part in text_groups(texts, 1 << 20)] or [np.zeros(0)])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), *[columns["text" if c == "text" else f"kept_{i}"] for i, c in enumerate(keep)]], ["doc_id", "held_out", "score", "predicted", *[f"kept_{i}" for i in range(len(keep))]])

    kinds = ", ".join(f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = narrow.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int" + (", " + kinds if kinds else ""))
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    return score_toxicity(docs, train(labelled_sample(docs, labels, "toxic", 4, 2, sample_rows)), threshold, keep)
