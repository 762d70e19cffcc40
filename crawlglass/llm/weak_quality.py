"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate they are.

Each rule looks at measures of a whole text and votes good, bad, or abstains where its measure says little.  Votes are
counted by pattern (one digit a rule, so at most 3 ** rules patterns), and the label model is fitted to those counts:
each rule votes good, bad or abstains with probabilities of its own, given the unknown quality.  The posterior probability
of good quality takes the place of a filter that all rules must pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.llm.rows import narrow, steps, texts_of
from crawlglass.llm.words import shingles, word_hashes
from crawlglass.storage import materialize

MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
_STEP = 2_000_000
MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_upper long, n_distinct_words long, n_marks long, n_bare_words long"
)
# Words of ASCII digits and signs only.
_BARE = re.compile(r"(?<![^\x20\x09-\x0D])[!-@\[-`{-~]+(?![^\x20\x09-\x0D])")
_SPACES = {c: " " for c in range(9, 14)}


def _repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words that lie in a window found twice or more."""
    if len(hashes) < window:
        return 0
    keys = shingles(hashes, window)
    _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[group] > 1)
    if not len(starts):
        return 0
    # Windows overlap: each adds what lies beyond the one before.
    return int(np.minimum(np.diff(starts, append=starts[-1] + window), window).sum())


def measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``MEASURES`` for each row; all zero for a null text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            texts = texts_of(step)
            hashes, counts = word_hashes([t.encode("utf-8") for t in texts])
            ends = np.cumsum(counts)
            out: list[tuple] = []
            for t, end, n in zip(texts, ends.tolist(), counts.tolist()):
                own = hashes[end - n : end]
                spaced = t.translate(_SPACES)
                seen: set[str] = set()
                repeated = lines = 0
                for line in t.split("\n"):
                    if line.translate(_SPACES).strip(" "):
                        lines += 1
                        repeated += line in seen
                        seen.add(line)
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                code = np.minimum(points, 127)
                ascii_ = np.bincount(code, minlength=128)
                beyond = t.translate(_ASCII_GONE) if ascii_[127] else ""
                letters = int(ascii_[65:91].sum() + ascii_[97:123].sum()) + sum(map(str.isalpha, beyond))
                upper = int(ascii_[65:91].sum()) + sum(map(str.isupper, beyond))
                out.append((
                    n, len(t) - spaced.count(" "), int(ascii_[_SYMBOL_CODES].sum()), repeated,
                    _repeated_words(own, WINDOW), lines, letters, upper, len(np.unique(own)), int(ascii_[[33, 63]].sum()),
                    len(_BARE.findall(t)),
                ))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [step.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=[part.split(" ")[0] for part in MEASURES.split(", ")],
            )

    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(measure, MEASURES)


_SYMBOL_CODES = [ord(c) for c in SYMBOLS]
_ASCII_GONE = dict.fromkeys(range(127))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``value`` is within ``good``, bad where it is outside ``fair``, and abstains between."""

    value: str
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        v = F.expr(self.value)
        good = v.between(*self.good)
        bad = ~v.between(*self.fair)
        return F.when(bad, 2).when(good, 1).otherwise(0)


# Values are null, and the rule abstains, where a text has nothing to measure.
RULES = (
    Rule("word_chars / nullif(n_words, 0)", (3.0, 10.0), (2.0, 15.0)),
    Rule("n_symbols / nullif(n_words, 0)", (0.0, 0.05), (0.0, 0.2)),
    Rule("n_dup_lines / nullif(n_lines, 0)", (0.0, 0.1), (0.0, 0.3)),
    Rule("n_repeat_words / nullif(n_words, 0)", (0.0, 0.1), (0.0, 0.3)),
    Rule("n_letters / nullif(word_chars, 0)", (0.85, 1.0), (0.75, 1.0)),
    Rule("n_upper / nullif(n_letters, 0)", (0.0, 0.15), (0.0, 0.4)),
    Rule("if(n_words < 50, null, n_distinct_words / pow(n_words, 0.75))", (0.8, 6.0), (0.4, 8.0)),
    Rule("n_bare_words / nullif(n_words, 0)", (0.0, 0.15), (0.0, 0.25)),
    Rule("n_marks / nullif(n_words, 0)", (0.0, 0.05), (0.0, 0.2)),
)


@dataclass
class LabelModel:
    """How often each rule abstains, votes good and votes bad on good and on bad texts; and the share of good texts.

    A rule has an accuracy for each class of its own, as a vote against a text often tells more than one for it.
    """

    good: np.ndarray  # rules x (abstain, good, bad)
    bad: np.ndarray
    prior: float
    rounds: int = 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``votes`` (0 abstains, 1 good, 2 bad)."""
        rule = np.arange(votes.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.good[rule, votes] / self.bad[rule, votes]).sum(axis=1)
        return 1 / (1 + np.exp(-odds))


FALSE_ALARM = 0.01
START_GOOD, START_BAD, START_PRIOR = (0.1, 0.89, 0.01), (0.2, 0.5, 0.3), 0.8


def start(rules: int) -> LabelModel:
    return LabelModel(np.tile(START_GOOD, (rules, 1)), np.tile(START_BAD, (rules, 1)), START_PRIOR)


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of ``votes``) that occur ``counts`` times.

    Each estimate is held by one text's weight of the start, so no probability becomes zero.  A rule is taken to vote
    bad on at most ``FALSE_ALARM`` of the good texts: this is what tells the class of good texts from the others, and
    keeps a kind of bad texts that few rules see from being taken for good.  The prior keeps between 0.05 and 0.95.
    """
    model = start(votes.shape[1])
    cast = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # patterns x rules x votes
    for turn in range(rounds):
        good = model.posterior(votes)
        seen_good = np.einsum("p,prv->rv", counts * good, cast) + np.array(START_GOOD)
        seen_bad = np.einsum("p,prv->rv", counts * (1 - good), cast) + np.array(START_BAD)
        new_good = seen_good / seen_good.sum(axis=1, keepdims=True)
        new_bad = seen_bad / seen_bad.sum(axis=1, keepdims=True)
        over = np.maximum(new_good[:, 2] - FALSE_ALARM, 0.0)
        new_good -= over[:, None] * [0.0, -1.0, 1.0]
        prior = float(np.clip((counts @ good + START_PRIOR) / (counts.sum() + 1.0), 0.05, 0.95))
        moved = max(np.abs(new_good - model.good).max(initial=0), np.abs(new_bad - model.bad).max(initial=0), abs(prior - model.prior))
        model = LabelModel(new_good, new_bad, prior, turn + 1)
        if moved < 1e-9:
            break
    return model


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, least: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The measures of each row of ``docs``, with ``base_failed``, ``posterior`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows of three.  ``kept`` is
    false for those, else whether the posterior probability of good quality is ``least`` or more.  The label model is
    fitted to the votes of all rows.

    A null or empty text has no words and fails.  Repeated rows, and rows with a null id, count like others; texts of
    any length are measured whole; no rows give no rows.  The driver gets one count for each pattern of votes that
    occurs, at most 3 ** rules.
    """
    measured = materialize(measures(docs, doc_id=doc_id, text=text), "quality-measures")
    pattern = F.lit(0)
    for rule in rules:
        pattern = pattern * 3 + rule.vote()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    voted = measured.withColumn("pattern", pattern).withColumn("base_failed", failed)
    counted = voted.groupBy("pattern").count().collect()
    digits = [[(row["pattern"] // 3**i) % 3 for i in reversed(range(len(rules)))] for row in counted]
    votes = np.array(digits, int).reshape(len(counted), len(rules))
    model = fit(votes, np.array([row["count"] for row in counted], float)) 
    scored = [(int(r["pattern"]), float(p)) for r, p in zip(counted, model.posterior(votes))]
    table = docs.sparkSession.createDataFrame(scored, "pattern int, posterior double")
    kept = ~F.col("base_failed") & (F.col("posterior") >= least)
    return voted.join(F.broadcast(table), "pattern").drop("pattern").withColumn("kept", kept)
