"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Each passage is described by shares of kinds of bytes,
word statistics and hashed words, and encoded by a hidden layer.  Gated attention gives each passage a weight, the
weighted sum of the encoded passages represents the document, and a logistic unit scores it.  All weights are learned
together from labels of whole documents; no passage has a label of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlglass.llm.rows import narrow, steps, texts_of
from crawlglass.llm.words import word_places

PASSAGE_WORDS, HASHED = 64, 48
HIDDEN, GATE = 32, 16
TRAIN_DOCS, TRAIN_BYTES = 4_000, 200_000  # bounds of the sample that the model is fitted to
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
_STEP = 2_000_000
_KINDS = [
    np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    for chars in (
        bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!?", b"#*$%&|<>",
        b"\"'()[]{}-_/\\@+=^`~", b"\n", bytes(range(128, 256)),
    )
]
FEATURES = len(_KINDS) + 5 + HASHED


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (passages x FEATURES), and the number of passages of each text, one at least."""
    written = [t.encode("utf-8") for t in texts]
    hashes, starts, words = word_places(written)
    data = np.frombuffer(b" ".join(written) + b" ", np.uint8)
    count = np.maximum(-(-words // PASSAGE_WORDS), 1)
    total = int(count.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(hashes):
        return out, count
    first_passage = np.cumsum(count) - count
    first_word = np.cumsum(words) - words
    place = np.arange(len(hashes)) - np.repeat(first_word, words)
    of = np.repeat(first_passage, words) + place // PASSAGE_WORDS  # passage of each word
    some, begin = np.unique(of, return_index=True)
    n = np.diff(begin, append=len(hashes)).astype(float)
    cut = starts[begin]
    size = np.diff(cut, append=len(data)).astype(float)
    for j, kind in enumerate(_KINDS):
        out[some, j] = np.add.reduceat(kind[data], cut, dtype=np.int64) / size
    j = len(_KINDS)
    order = np.lexsort((hashes, of))
    new = np.append(True, (np.diff(of[order]) != 0) | (np.diff(hashes[order]) != 0))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
    out[some, j] = np.bincount(of[order][new], minlength=total)[some] / n  # distinct words
    out[some, j + 1] = np.bincount(of[same], minlength=total)[some] / n  # words that repeat the one before
    out[some, j + 2] = size / n / 10  # bytes a word
    out[some, j + 3] = np.log1p(n) / np.log1p(PASSAGE_WORDS)
    out[some, j + 4] = np.log1p(np.repeat(words, count)[some]) / 10
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    slot = (hashes % np.uint64(HASHED)).astype(np.int64)
    mass = np.bincount(of * HASHED + slot, weights=sign, minlength=total * HASHED).reshape(total, HASHED)
    out[some, j + 5 :] = mass[some] / np.sqrt(n)[:, None]
    return out, count


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        first = np.cumsum(count) - count
        h = np.tanh(x @ w["encode"] + w["bias"])
        t = np.tanh(h @ w["attend"])
        g = 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["weigh"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        logit = np.clip(z @ w["score"] + w["base"], -60, 60)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-logit)), "first": first}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, attention of all passages, and the number of passages of each text."""
        x, count = passages(texts)
        found = self.forward(self.standard(x), count)
        return found["p"], found["a"], count


def gradients(model: Model, x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss for each of the model's weights."""
    w, f = model.weights, model.forward(x, count)
    do = weight * (f["p"] - y) / len(y)
    dz = np.repeat(do[:, None] * w["score"], count, axis=0)
    da = (f["h"] * dz).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), count))
    both = de[:, None] * w["weigh"]
    dt = both * f["g"] * (1 - f["t"] ** 2)
    dg = both * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T
    du = dh * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ du, "bias": du.sum(axis=0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg,
        "weigh": (f["t"] * f["g"]).T @ de, "score": f["z"].T @ do, "base": np.array(do.sum()),
    }


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam over shuffled batches of documents; both classes weigh the same.  The seed is fixed."""
    draw = np.random.default_rng(seed)
    start = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(FEATURES)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(FEATURES), scale, {
        "encode": start(FEATURES, HIDDEN), "bias": np.zeros(HIDDEN), "attend": start(HIDDEN, GATE),
        "gate": start(HIDDEN, GATE), "weigh": start(GATE), "score": start(HIDDEN), "base": np.array(0.0),
    })
    x = model.standard(x)
    first = np.cumsum(count) - count
    share = y.mean() if len(y) else 0.5
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    turn = 0
    for epoch in range(epochs if 0 < share < 1 and len(y) else 0):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[b], first[b] + count[b]) for b in bags])
            step = gradients(model, x[rows], count[bags], y[bags], weight[bags])
            turn += 1
            for k, g in step.items():
                if k not in ("bias", "base"):
                    g = g + DECAY * model.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                rate = RATE * (1 - epoch / epochs)
                model.weights[k] = model.weights[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return model


def train(
    docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Model:
    """A model of the documents that ``labels`` (doc_id, label 0 or 1) marks.

    It is fitted on at most ``train_docs`` labelled documents of at most ``train_bytes`` bytes each, those of the
    smallest hash of their id; only their ids are sent to the tasks, and only their features to the driver.  Labels
    that are null, or differ for one id, are left out.  Without labels of both classes every score is about one half.
    """
    marked = narrow(labels, id=doc_id, y=label).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(
        F.min("y").cast("double").alias("y"), F.max("y").cast("double").alias("z")
    ).filter("y = z").drop("z")
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    rows = narrow(docs, id=doc_id, text=text).join(F.broadcast(chosen), "id")
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes).select("text", "y", "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            x, count = passages(texts_of(step))
            cuts = np.split(x, np.cumsum(count)[:-1])
            yield pa.RecordBatch.from_arrays(
                [step.column(2), step.column(1), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["id", "y", "x"]
            )

    got = rows.mapInArrow(describe, "id long, y double, x binary").toPandas().sort_values(["id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"]]
    x = np.concatenate(bags).astype(float) if bags else np.empty((0, FEATURES))
    return fit(x, np.array([len(b) for b in bags], int), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5), n_passages, top_passage for each row of ``docs``.

    ``top_passage`` is the number of the passage with the most attention, the first of equals.  Every passage of a
    text is encoded, however long it is.  Null and empty texts are one passage without words, and get its score.
    Repeated rows, and rows with a null id, each get their score; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            p, attention, count = shared.value.predict(texts_of(step))
            top = [int(np.argmax(a)) for a in np.split(attention, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(count, pa.int64()), pa.array(top, pa.int64())],
                names=["doc_id", "score", "predicted", "n_passages", "top_passage"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(judge, "doc_id long, score double, predicted int, n_passages long, top_passage long")
