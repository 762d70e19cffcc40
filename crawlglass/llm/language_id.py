"""Language identification by multilingual mixture inference.

Training counts character n-grams per language over all labelled texts, in a fixed number of hashed buckets.  A
document is a mixture: each of its words belongs to one language, with a probability given by the word's n-grams, and
expectation-maximisation estimates the proportions of the languages.  Language sets of growing size (in the order of
the proportions over all languages) are fitted, and the set with the best likelihood less a penalty for each further
language is taken (half the logarithm of the number of words, times ``penalty``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlglass.llm.rows import narrow, steps, texts_of

GRAM, BUCKETS, SMOOTHING = 3, 1 << 16, 0.5
PENALTY, ROUNDS, TOLERANCE = 2.0, 25, 1e-4
UNDETERMINED = "und"
_STEP = 1_000_000
_TOP = 0x110000
_EDGE = np.uint64(0x110001)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_TOP)), bool, _TOP)


_TABLE: dict[str, np.ndarray] = {}


def grams(texts: list[str], size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (runs of letters, lower-cased, with an edge mark on both sides), the
    number of n-grams of each word, and the number of words of each text."""
    if "letters" not in _TABLE:
        _TABLE["letters"] = _letters()
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    data = np.concatenate([x for p in parts for x in (p, np.array([32], np.uint32))]) if parts else np.empty(0, np.uint32)
    inside = _TABLE["letters"][data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.cumsum([len(p) + 1 for p in parts]) if parts else np.empty(0, np.int64)
    words = np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), words
    # Before each word and after it stands one edge mark: position of a letter = its rank + 2 * word + 1.
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    marked = np.full(int((sizes + 2).sum()), _EDGE, np.uint64)
    at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
    marked[at] = data[inside]
    folded = np.zeros(len(marked), np.uint64)
    for j in range(size):
        folded[: len(marked) - j] = folded[: len(marked) - j] * np.uint64(0x9E3779B97F4A7C15) + marked[j:]
    folded ^= folded >> np.uint64(29)
    bucket = ((folded * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(buckets)
    # n-grams that begin in a word and end in it (with its marks); a short word has one at least.
    count = np.maximum(sizes + 2 - size + 1, 1)
    begin = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return bucket[begin].astype(np.int64), count, words


@dataclass
class Model:
    """Log-likelihood of each bucket under each language; of fixed size, whatever the corpus."""

    languages: list[str]
    log_likelihood: np.ndarray  # buckets x languages, float32
    gram: int
    penalty: float


def train(
    labelled: DataFrame, *, gram: int = GRAM, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
    penalty: float = PENALTY, lang: str = "lang", text: str = "text",
) -> Model:
    """Counts over all rows with a language and a text.  The driver gets ``buckets`` counts a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for step in steps(batches, limit=_STEP):
            langs = step.column(1).to_pylist()
            bucket, size, words = grams(texts_of(step), gram, buckets)
            names = sorted(set(langs))
            code = np.repeat(np.repeat(np.array([names.index(x) for x in langs]), words), size)
            both = np.bincount(code * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
            for i, x in enumerate(names):
                sums[x] = sums[x] + both[i] if x in sums else both[i]
        for x, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = narrow(labelled, text=text, lang=lang).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got: pd.DataFrame = counted.toPandas()
    languages = sorted(got["lang"].unique())
    table = np.zeros((buckets, len(languages)))
    if languages:
        table[got["bucket"], np.searchsorted(languages, got["lang"])] = got["n"]
        table = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * buckets))
    return Model(languages, table.astype(np.float32), gram, penalty)


def mixture(likelihood: np.ndarray, words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each document, and the log-likelihood, by expectation-maximisation.

    ``likelihood``: words x languages; ``words``: number of words of each document, one at least.  Documents whose
    proportions have settled leave the loop.
    """
    n = likelihood.shape[1]
    shares = np.full((len(words), n), 1.0 / n)
    loss = np.zeros(len(words))
    live, own, size = np.arange(len(words)), likelihood, words
    for turn in range(rounds):
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        weighted = own * np.repeat(shares[live], size, axis=0)
        total = weighted.sum(axis=1)
        new = np.add.reduceat(weighted / total[:, None], first, axis=0) / size[:, None]
        loss[live] = np.add.reduceat(np.log(total), first)
        moved = np.abs(new - shares[live]).max(axis=1) > TOLERANCE
        shares[live] = new
        if not moved.any() or turn == rounds - 1:
            break
        if not moved.all():
            keep = np.repeat(moved, size)
            live, own, size = live[moved], own[keep], size[moved]
    return shares, loss


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages; zero outside the selected set) and number of words of each text."""
    bucket, size, words = grams(texts, model.gram, len(model.log_likelihood))
    n = len(model.languages)
    out = np.zeros((len(texts), n))
    docs = np.flatnonzero(words)
    if not len(docs) or not n:
        return out, words
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    # A float64 sum for each word, made one language at a time so that memory stays small.
    log = np.stack([np.add.reduceat(model.log_likelihood[:, j][bucket], first, dtype=np.float64) for j in range(n)], axis=1)
    top = log.max(axis=1)
    own = np.exp(np.maximum(log - top[:, None], -60.0))
    counts = words[docs]
    doc = np.repeat(np.arange(len(docs)), counts)
    full, _ = mixture(own, counts)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.full(len(docs), -np.inf)
    chosen = np.zeros((len(docs), n))
    for k in range(1, n + 1):
        # A k-th language that explains less than a hundredth of a word cannot pay for its penalty.
        able = np.flatnonzero(full[np.arange(len(docs)), order[:, k - 1]] * counts > 0.01) if k > 1 else np.arange(len(docs))
        if not len(able):
            break
        rows = np.isin(doc, able) if len(able) < len(docs) else slice(None)
        some = np.take_along_axis(own[rows], order[doc[rows], :k], axis=1)
        if k == 1:
            shares, loss = np.ones((len(able), 1)), np.add.reduceat(np.log(some[:, 0]), np.concatenate([[0], np.cumsum(counts[able])[:-1]]))
        else:
            shares, loss = mixture(some, counts[able])
        value = loss - model.penalty * 0.5 * np.log(counts[able]) * (k - 1)
        better = value > best[able] + 1e-9
        won = able[better]
        best[won] = value[better]
        chosen[won] = 0.0
        chosen[won[:, None], order[won, :k]] = shares[better]
    out[docs] = chosen
    return out, words


def _verdicts(model: Model, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """Each step with the predicted language, its share, and all shares, of every row."""
    limit = _STEP // max(1, len(model.languages) // 8)
    for step in steps(batches, text=text, limit=limit):
        shares, _ = infer(model, texts_of(step, text))
        found = shares.sum(axis=1) > 0 if shares.shape[1] else np.zeros(len(shares), bool)
        best = shares.argmax(axis=1) if shares.shape[1] else np.zeros(len(shares), int)
        pred = [model.languages[b] if f else UNDETERMINED for b, f in zip(best, found)]
        yield step, pred, np.minimum(np.where(found, shares.max(axis=1, initial=0.0), 0.0), 1.0), shares


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, proportions for each row of ``docs``.

    ``lang_pred`` is the language of the largest proportion and ``score`` that proportion; equal proportions go to
    the first language by name.  ``proportions`` maps the selected languages to their shares.  A text that is null or
    has no letter, or a model without languages, gives ``und``, score 0 and an empty map.  Whole texts are read,
    however long; repeated rows, and rows with a null id, each get their result; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for step, pred, score, shares in _verdicts(model, batches, "text"):
            maps = [[(model.languages[j], float(row[j])) for j in np.flatnonzero(row)] for row in shares]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "proportions"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def accepted(docs: DataFrame, model: Model, *, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language with a share of ``least`` at least.

    Nothing is shuffled.  Texts that are null or have no letter are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, pred, score, _ in _verdicts(shared.value, batches, text):
            keep = [p != UNDETERMINED and s >= least for p, s in zip(pred, score)]
            yield step.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
