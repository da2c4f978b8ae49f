"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded from its words (hashed to HASHED
places), byte classes, word repetition and lengths: z = tanh(W f + b). Gated attention weighs the passages,
  a = softmax(w . (tanh(V z) * sigmoid(U z))),
and the score is the logistic of a linear function of the weighted passage sum. All weights are
learned from document labels alone (Adam, on the log loss), over a bounded sample of labelled rows
(`sample_rows` ids by hash, one row of each, texts of at most toxicity.SAMPLE_BYTES); scoring is one
pass over all documents without a shuffle.

Defined results: null and empty texts are one empty passage; without usable labels the score is
0.5; null labels are not used; several labels of an id count as the largest; repeated rows are
scored each; every passage of a text of any length is encoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import crc_bucket, lean, small_batches, text_bytes
from lumaflow.llm.rolling import BLANK, hashed_words, join_texts, spans_of
from lumaflow.llm.token_counts import text_groups
from lumaflow.llm.toxicity import labelled_sample, sample_arrays

PASSAGE_WORDS = 64
SAMPLE_ROWS = 6000
HIDDEN, GATE = 24, 12
CLASSES, HASHED = 40, 64


def _byte_classes() -> np.ndarray:
    """Each ASCII mark is a class of its own; letters, capitals, digits, line ends, blanks, controls and other bytes follow."""
    out = np.full(256, 38, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(len(marks))
    out[97:123], out[65:91], out[48:58], out[10], out[32], out[128:] = 32, 33, 34, 35, 36, 37
    return out


CLASS = _byte_classes()
N_FEATURES = CLASSES + 8 + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the starts (and the end) of each text's passages."""
    buffer, bounds = join_texts(texts)
    inside = ~BLANK[buffer]
    start, end = spans_of(inside)
    owner = np.searchsorted(bounds, start, side="right") - 1
    words = np.bincount(owner, minlength=len(texts))
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    first_word = np.concatenate([[0], np.cumsum(words)])
    passage = first[owner] + (np.arange(len(start)) - first_word[owner]) // PASSAGE_WORDS
    total = int(first[-1])
    # bytes go with the word before them, leading ones with the text's first passage
    opens = np.concatenate([bounds[:-1], start[(np.arange(len(start)) - first_word[owner]) % PASSAGE_WORDS == 0]])
    opens_passage = np.concatenate([first[:-1], passage[(np.arange(len(start)) - first_word[owner]) % PASSAGE_WORDS == 0]])
    order = np.lexsort((opens_passage, opens))
    opens, opens_passage = opens[order], opens_passage[order]
    of_byte = np.repeat(opens_passage, np.diff(np.concatenate([opens, [len(buffer)]])))
    classes = np.bincount(of_byte * CLASSES + CLASS[buffer], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    size = np.maximum(classes.sum(1), 1)
    n = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(n, 1)
    length = (end - start).astype(np.float64)
    mean = np.bincount(passage, length, total) / some
    spread = np.sqrt(np.maximum(np.bincount(passage, length * length, total) / some - mean * mean, 0))
    word = hashed_words(texts, ~BLANK)[0]
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((word, passage))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], new, total)
    marked = ~np.isin(CLASS[buffer[end - 1]], (32, 33, 34, 37)) if len(end) else np.zeros(0, bool)
    alone = marked & (length == 1)
    other = np.stack([mean, spread, np.log1p(n), np.bincount(passage, again, total) / some, distinct / some, np.bincount(passage, marked, total) / some, np.bincount(passage, alone, total) / some, np.bincount(passage, length > 25, total) / some], 1)
    place = passage * HASHED + (word >> np.uint64(56)).astype(np.int64) % HASHED
    words = np.sqrt(np.bincount(place, minlength=total * HASHED).reshape(total, HASHED) / some[:, None])
    return np.hstack([np.sqrt(classes / size[:, None]), other, words]).astype(np.float32), first


def feature_scale(f: np.ndarray) -> np.ndarray:
    """Spread of every feature; hashed words weigh little until labels speak for them (and their weights start at 0)."""
    return f.std(0, dtype=np.float64) + np.repeat([0.02, 0.5], [CLASSES + 8, HASHED])


class AttentionModel:
    """Gated attention over passages, in numpy with hand-written gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = {
            "W": np.vstack([r.normal(0, (d - HASHED) ** -0.5, (d - HASHED, HIDDEN)), np.zeros((HASHED, HIDDEN))]), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, f: np.ndarray, first: np.ndarray) -> dict:
        w = self.w
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        z = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        e = (t * s) @ w["a"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        att = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        bag = np.add.reduceat(att[:, None] * z, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["d"], -35, 35)))
        return {"x": x, "z": z, "t": t, "s": s, "att": att, "bag": bag, "p": p, "sizes": sizes}

    def gradients(self, f: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, k = self.w, self.forward(f, first)
        dl = (k["p"] - y) / len(y)
        dbag = np.repeat(dl[:, None] * w["c"], k["sizes"], axis=0)
        datt = (dbag * k["z"]).sum(1)
        mean = np.repeat(np.add.reduceat(k["att"] * datt, first[:-1]), k["sizes"])
        de = k["att"] * (datt - mean)
        dgate = de[:, None] * w["a"]
        dt, ds = dgate * k["s"] * (1 - k["t"] ** 2), dgate * k["t"] * k["s"] * (1 - k["s"])
        dz = (k["att"][:, None] * dbag + dt @ w["V"].T + ds @ w["U"].T) * (1 - k["z"] ** 2)
        return {"W": k["x"].T @ dz, "b": dz.sum(0), "V": k["z"].T @ dt, "U": k["z"].T @ ds, "a": (k["t"] * k["s"]).T @ de, "c": k["bag"].T @ dl, "d": np.array([dl.sum()])}

    def fit(self, f: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> None:
        r = np.random.default_rng(9)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for part in (order[i : i + batch] for i in range(0, len(y), batch)):
                sizes = np.diff(first)[part]
                begin = np.concatenate([[0], np.cumsum(sizes)])
                rows = np.repeat(first[part] - begin[:-1], sizes) + np.arange(begin[-1])
                step += 1
                for key, g in self.gradients(f[rows], begin, y[part]).items():
                    g = g + decay * self.w[key]
                    m[key] += 0.1 * (g - m[key])
                    v[key] += 0.001 * (g * g - v[key])
                    self.w[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.mean, self.scale, *[x.ravel() for x in self.w.values()]])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> AttentionModel:
        out = cls(flat[:N_FEATURES], flat[N_FEATURES : 2 * N_FEATURES])
        at = 2 * N_FEATURES
        for k, x in out.w.items():
            out.w[k] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return out


def train(sample: DataFrame) -> np.ndarray | None:
    """The packed model, or None without labelled rows: passages are encoded in parallel, weights learned in one task."""

    def encode(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts, 1 << 20):
                n = part.stop - part.start
                f, first = passages(texts[part])
                rows = pa.ListArray.from_arrays(pa.array((first * N_FEATURES).astype(np.int32)), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), rows, batch.column(2).slice(part.start, n)], ["key", "passages", "label"])

    def learn(table: pa.Table) -> pa.Table:
        flat, bound, label = sample_arrays(table, "passages")
        f = flat.reshape(-1, N_FEATURES)
        model = AttentionModel(f.mean(0, np.float64), feature_scale(f))
        model.fit(f, bound // N_FEATURES, (label >= 0.5).astype(np.float64))
        return pa.table({"weights": [model.pack().tolist()]})

    made = sample.mapInArrow(lean(encode), "key long, passages array<float>, label double")
    rows = made.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(learn, "weights array<double>").collect()
    return np.array(rows[0]["weights"]) if rows else None


def score_quality(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    narrow = small_batches(docs).select(F.col("doc_id"), held.alias("held_out"), text_bytes("text").alias("text"))

    def run(batches):
        model = AttentionModel.unpack(weights) if weights is not None else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts = [model.forward(*passages(texts[part]))["p"] if model else np.full(part.stop - part.start, 0.5) for part in text_groups(texts, 1 << 20)]
            s = np.concatenate(parts or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    return score_quality(docs, train(labelled_sample(docs, labels, "quality", 5, 0, sample_rows)), threshold)
