"""URL verdicts: rules first, then words of the host and path scored by naive Bayes.

Hosts run words together (``cheapflightsnow.example.com``).  A unigram model of the words in the pages' texts splits
every part of a host into its likeliest words (Viterbi); a multinomial naive Bayes model over hashed tokens of
the split host and of the path then says whether the URL looks like the allowed or like the blocked ones.  It learns
from the URLs that the rules decide, and from a list of words that no wanted host is named after.

Both models have a size that does not grow with the pages: the word model keeps words that make up at least one in
``RAREST`` of all words, so there are at most ``RAREST`` of them, and naive Bayes counts hashed tokens.  So every URL
is judged by itself, wherever it is, and a host that a third of all pages share is no special case.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.llm.rows import name, steps, texts_of
from crawlglass.llm.shipping import ship
from crawlglass.storage import materialize

ALLOW, BLOCK = "allow", "block"
# (host, path, verdict): a rule fits its host and all subdomains, where the URL's path starts with the rule's.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
# Words that hosts of unwanted pages are named after.  Each counts as a blocked URL that holds only this word, as
# many times as makes all of them together EXAMPLE_SHARE of the URLs that the rules decide.
BLOCK_WORDS = (
    "ads", "adult", "adware", "bet", "bets", "betting", "bingo", "casino", "cheap", "counterfeit", "crack", "cracked",
    "dating", "escort", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude",
    "payday", "pharma", "pharmacy", "phishing", "pill", "pills", "poker", "porn", "replica", "roulette", "sex", "slots",
    "spam", "spyware", "torrent", "track", "tracker", "viagra", "warez", "win", "winner", "xxx",
)
EXAMPLE_SHARE = 0.1
RAREST = 1_000_000
LONGEST_WORD = 24
TOKEN_BUCKETS = 1 << 16
SMOOTHING = 0.1
# Hosts whose words a worker remembers.
REMEMBERED = 50_000

_LETTERS, _WORDS = re.compile("[a-z]+"), re.compile("[a-z]+|[0-9]+")
# Linear on any markup: what is not closed goes on to the end, a tag to the next bracket.
_TAGS = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>?", re.DOTALL)
_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    path_at = F.instr(rest, "/")
    known = F.coalesce(at > 0, F.lit(False))
    host = F.when(path_at > 0, F.substring(rest, F.lit(1), path_at - 1)).otherwise(rest)
    path = F.when(path_at > 0, F.substring(rest, path_at, F.length(rest))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(known, F.translate(host, upper, lower)).otherwise(""), F.when(known, path).otherwise("")


class Rules:
    """Rules by host, longest path first."""

    def __init__(self, rules: tuple):
        self._paths: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self._paths.setdefault(host, []).append((path, verdict))
        for paths in self._paths.values():
            paths.sort(key=lambda r: (-len(r[0]), r))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits (of equally long ones that with the longer host), and its verdict."""
        best, length, at = None, -1, 0
        while True:  # the host itself, then without its first label, and so on
            suffix = host[at:]
            for start, verdict in self._paths.get(suffix, ()):
                if path.startswith(start):
                    if len(suffix) + len(start) > length:
                        best, length = (suffix + start, verdict), len(suffix) + len(start)
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


def words_in(html: str) -> list[str]:
    """Words of a page's visible text, lower-cased."""
    return [w for w in _LETTERS.findall(_TAGS.sub(" ", html).translate(_LOWER)) if len(w) <= LONGEST_WORD]


def word_model(pages: DataFrame, *, more: tuple = (), html: str = "html") -> dict[str, float]:
    """Negative log share of every word that makes up at least one in ``RAREST`` of all words, and of ``more`` words."""
    ship(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(counted: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], names=["word", "n"])

        counted: Counter = Counter()
        for step in steps(batches):
            for text in texts_of(step):
                counted.update(words_in(text))
            if len(counted) > 200_000:
                yield row(counted)
                counted = Counter()
        yield row(counted)

    texts = pages.select(name(html).alias("text"))
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") * RAREST >= total).orderBy("word").collect()
    return dict.fromkeys(more, math.log(RAREST)) | {r.word: -math.log(r.n / total) for r in common}


@dataclass
class Splitter:
    """Splits names into the words whose product of shares is largest."""

    cost: dict[str, float]

    def __post_init__(self):
        # An unknown word is as rare as the rarest known one and made of letters drawn evenly.
        self.unknown = math.log(RAREST)

    def split(self, part: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(part) + 1):
            least, at = math.inf, 0
            for start in range(max(0, end - LONGEST_WORD), end):
                word = part[start:end]
                own = self.cost.get(word)
                if own is None:
                    own = self.unknown + math.log(26) * len(word)
                if best[start] + own < least - 1e-9:
                    least, at = best[start] + own, start
            best.append(least)
            back.append(at)
        words, end = [], len(part)
        while end:
            words.append(part[back[end] : end])
            end = back[end]
        return words[::-1]

    def host_words(self, host: str) -> list[str]:
        return [w for part in _LETTERS.findall(host) for w in self.split(part)]


def path_tokens(path: str) -> list[str]:
    """Letters as words; numbers by their first digit and length."""
    return [w if w[0] > "9" else w[0] + "#" * (len(w) - 1) for w in _WORDS.findall(path.translate(_LOWER))]


def buckets_of(words: list[str], path: str) -> list[int]:
    marked = [f"h {w}" for w in words] + [f"p {t}" for t in path_tokens(path)]
    return [crc32(t.encode()) % TOKEN_BUCKETS for t in marked]


@dataclass
class Model:
    """Words of hosts, rules, and the log odds of each hashed token for being blocked."""

    cost: dict[str, float]
    rules: tuple
    prior: float
    odds: np.ndarray

    def __post_init__(self):
        self._split, self._rules = Splitter(self.cost), Rules(self.rules)
        self._known: OrderedDict[str, list[str]] = OrderedDict()

    def host_words(self, host: str) -> list[str]:
        if host not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.popitem(last=False)
            self._known[host] = self._split.host_words(host)
        return self._known[host]

    def judge(self, host: str, path: str) -> tuple[str | None, str, float, list[str]]:
        """Rule, verdict, the probability of being blocked by the words alone, and the host's words."""
        words = self.host_words(host)
        x = self.prior + float(self.odds[buckets_of(words, path)].sum())
        score = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        found = self._rules.find(host, path)
        rule, verdict = found if found else (None, BLOCK if score >= 0.5 else ALLOW)
        return rule, verdict, score, words


def train(pages: DataFrame, *, rules: tuple = RULES, block_words: tuple = BLOCK_WORDS, url: str = "url", html: str = "html") -> Model:
    """The word model of all pages, and naive Bayes over all URLs that ``rules`` decide and ``block_words``."""
    cost = word_model(pages, more=block_words, html=html)
    known, splitter = Rules(rules), pages.sparkSession.sparkContext.broadcast(Splitter(cost))
    host, path = host_and_path(name(url))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, TOKEN_BUCKETS + 1), np.int64)  # the last one counts URLs
        remembered: dict[str, list[str]] = {}
        for batch in batches:
            for own, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = known.find(own, at)
                if found:
                    if own not in remembered:
                        if len(remembered) >= REMEMBERED:
                            remembered.clear()
                        remembered[own] = splitter.value.host_words(own)
                    side = int(found[1] == BLOCK)
                    np.add.at(seen[side], buckets_of(remembered[own], at), 1)
                    seen[side, -1] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["bucket", "allowed", "blocked"])

    counted = pages.select(host.alias("host"), path.alias("path")).mapInArrow(count, "bucket long, allowed long, blocked long")
    table = counted.groupBy("bucket").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).collect()
    seen = np.zeros((2, TOKEN_BUCKETS + 1))
    for r in table:
        seen[:, r.bucket] = r.allowed, r.blocked
    urls = seen[:, -1].copy()
    if block_words:
        each = max(1.0, EXAMPLE_SHARE * urls.sum() / len(block_words))
        for word in block_words:
            for b in buckets_of([word], ""):
                seen[1, b] += each
        urls[1] += each * len(block_words)
    tokens = seen[:, :-1] + SMOOTHING
    share = np.log(tokens / tokens.sum(axis=1, keepdims=True))
    prior = math.log((urls[1] + 1) / (urls[0] + 1))
    return Model(cost, rules, prior, share[1] - share[0])


def judge(pages: DataFrame, model: Model | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score, host_words)`` of every row.

    ``rule`` is the longest rule that fits (host and path as one text), null without one; then ``verdict`` is that of
    naive Bayes: ``block`` if ``score``, the probability of being blocked by the words alone, is at least a half.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, and gets the commoner verdict.  Null
    or empty ``html`` has no words.  Rows are judged one by one, so null or repeated ids and repeated URLs are rows
    like others; other columns are not read.  Without rows, or without a URL that a rule decides, only
    ``block_words`` are learned.
    """
    ship(pages.sparkSession)
    model = train(pages, url=url, html=html, **options) if model is None else model
    held = pages.sparkSession.sparkContext.broadcast(model)
    host, path = host_and_path(name(url))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule, verdict, blocked, words = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(blocked, pa.float64()),
                 pa.array([" ".join(w) for w in words], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "score", "host_words"],
            )

    rows = pages.select(name(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, score double, host_words string")
