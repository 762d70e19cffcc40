"""Collocations, the conversation trie and URL verdicts: brute force, and the odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from crawlglass.llm import phrases, prefix_trie, url_filter

# ---------------------------------------------------------------- collocations
DOCS = "doc_id long, lang string, text string, phrase string, f long, block string"


def brute_collocations(rows, least, top=2000, longest=5, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: v for key, v in f.items() if v >= least and len(key[1]) > 1}
    longer = defaultdict(int)
    for (lang, words), v in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = (lang, words[i : i + size])
                longer[inner] = max(longer[inner], v)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] < percent * a:
            cut = lambda k: (f[lang, words[:k]], f[lang, words[k:]])
            score, k = min((1000 * a * n[lang] // math.prod(cut(k)), k) for k in range(1, len(words)))
            found[lang].append((-score, -a, " ".join(words).encode(), *cut(k)))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)
    )


def some_texts(seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "a", "b", "é", "ÉÀ", "x\u00a0y", "of", "the", "\x0e", "ß"]
    made = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!", "\x0b"]) for _ in range(rng.randint(0, 40)))
        made.append((rng.choice(["en", "en", "de", None]), text))
    return made + [("en", None), (None, ""), ("fr", "..."), ("en", "the the the the the the the"), ("en", "a" * 3000)] * 2


def same(spark, rows, least, **options):
    docs = spark.createDataFrame([(i, lang, text, "p", 1, "b") for i, (lang, text) in enumerate(rows)], DOCS).repartition(4)
    got = phrases.collocations(docs, least=least, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    plain = {"percent" if k == "inside_percent" else k: v for k, v in options.items()}
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, **plain)


def test_collocations(spark):
    same(spark, some_texts(), 5)
    same(spark, some_texts(4), 3, top=7, longest=3, inside_percent=60)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_cut_without_loss():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "c", "def", "é", "wordword" * rng.randint(1, 9)]) + rng.choice([" ", "  ", "\t", ".", "\n"]) * (rng.random() < 0.95)
                       for _ in range(200)).encode()
        limit, whole, parts = rng.choice([7, 20, 64, 300]), Counter(), Counter()
        stretches = list(phrases._cuts(text, limit, 5))
        assert sum(own for _, own in stretches) == len(text)
        for counter, cut in ((whole, [(text, len(text))]), (parts, stretches)):
            for part, own in cut:
                block = phrases.Block(part, own, "en", 5)
                counter["words"] += block.first
                for n in range(1, 6):
                    counter.update((n, int(k)) for k in block.fingerprints(n)[1])
        assert whole == parts


def test_phrases_of_one_fingerprint_do_not_mix(monkeypatch):
    text = b"one two three four one two five six three four"
    plain = phrases.Block(text, len(text), "en", 3)
    keys = np.unique(phrases.key48(np.concatenate([plain.fingerprints(n)[1] for n in (1, 2, 3)])))
    want = Counter({p: c for p, _, c in plain.counted(keys)})
    monkeypatch.setattr(phrases, "mix64", lambda x: x & np.uint64(0))  # every n-gram has the same fingerprint
    clash = phrases.Block(text, len(text), "en", 3)
    got = Counter()
    for p, _, c in clash.counted(np.zeros(1, np.uint64)):
        got[p] += c
    assert got == want and got["one two"] == 2
    clash.hashes[:] = 7  # and every word the same hash
    got = Counter()
    for p, _, c in clash.counted(np.zeros(1, np.uint64)):
        got[p] += c
    assert got == want


# ---------------------------------------------------------------- conversations
TURNS = "conv_id long, turn long, role string, text string, depth string, words string"


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def test_prefix_trie(spark):
    rng, rows = random.Random(1), []
    for c in [*range(-25, 45), None]:
        for t in range(rng.choice([1, 2, 3, 5, 12, 20])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a b", "x", "é\u2003ü"])))
    for c in range(100, 125):  # a group of copies that part in their last turns
        length = rng.choice([20, 20, 21])
        rows.extend((c, t, "user", f"same {t} w w" if t < length else f"v{c % 3}") for t in range(24))
    rows.extend((200, t, "u", f"t{t % 7}") for t in range(900))  # one conversation with many rows
    table = spark.createDataFrame([(*r, "d", "w") for r in rows], TURNS).repartition(5)
    want = brute_trie(rows)
    for turns in (4, 8):
        assert Counter(map(tuple, prefix_trie.prefix_trie(table, block_turns=turns).collect())) == want
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_running_folds_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 9)) for i in range(3_000)]
    table = spark.createDataFrame(rows, "g long, at long, h long, v long")
    got = prefix_trie.running(table, "g", ["at"], {"h": 0x9E3779B97F4A7C15, "v": 1}, "t").collect()
    state, want = defaultdict(lambda: (0, 0, 0)), {}
    for g, at, h, v in sorted(rows):
        n, fold, total = state[g]
        state[g] = want[at] = (n + 1, (fold * 0x9E3779B97F4A7C15 + h) % 2**64, total + v)
    assert {r["at"]: (r["n"], r["h"] % 2**64, r["v"]) for r in got} == want


# ---------------------------------------------------------------- URLs
PAGES = "page_id long, url string, html string, rule string, host string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path, rules):
    fitting = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[2:] if fitting else None


URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en/21", "http://notexample.org/es/1", "http://x.com/fr/",
    "http://x.com/de/3", "http://x.com/FR/", "http://com/de/x", "http://x.net/de/", "http://y.com", "http://y.org", "http://org/", "x.com/de/1",
    None, "", "://", "http://?a=/de/", "http://h.com?/de/", "http://h.com#/fr/", "ftp://u:p@h.com:80/de/a?b#c", "a://b://c.org/d", "http://é.Ü.com/fr/é",
    "http://" + "x" * 5_000 + ".com/" + "y" * 50_000,
]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i % 20 or None, u, "<p>w</p>", "r", "h") for i, u in enumerate(URLS)], PAGES)
    got = Counter((r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge(pages).collect())
    want = Counter()
    for url in URLS:
        host, path = plain_parts(url)
        want[(host, path, *(plain_rule(host, path, url_filter.RULES) or (None, None)))] += 1
    assert got == want
    rules = (("b.c", "/x", "allow"), ("c", "/x/yy", "block"), ("a.b.c", "", "allow"), ("c", "/x/zzz", "block"))
    for host, path in (("a.b.c", "/x/yy"), ("a.b.c", "/x"), ("b.c", "/x/zzz"), ("d.c", "/x/yyy"), ("a.b.c", ""), ("bb.c", "/x")):
        assert url_filter.Rules(rules).find(host, path) == plain_rule(host, path, rules)
    empty = url_filter.judge(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and empty.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


def test_viterbi_finds_the_likeliest_split():
    words = {"cheap": 5.0, "flight": 7.0, "flights": 7.5, "now": 4.0, "snow": 9.0, "s": 12.0, "a": 3.0, "aa": 5.5}
    splitter = url_filter.Splitter(words)
    assert splitter.split("cheapflightsnow") == ["cheap", "flights", "now"]
    assert splitter.split("") == [] and splitter.host_words("cheap-now.com") == ["cheap", "now", "com"]

    def every(text):
        return [[text[:i], *rest] for i in range(1, len(text) + 1) for rest in every(text[i:])] if text else [[]]

    cost = lambda parts: sum(words.get(p, splitter.unknown + math.log(26) * len(p)) for p in parts)
    rng = random.Random(7)
    for _ in range(40):
        text = "".join(rng.choice("aasnowqflight") for _ in range(rng.randint(1, 9)))
        assert cost(splitter.split(text)) == pytest.approx(min(map(cost, every(text))))


def test_naive_bayes_learns_from_the_rules(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        bad = i % 2
        section = rng.choice(["shop", "deal"]) if bad else rng.choice(["news", "guide"])
        host = f"{rng.choice(['super', 'mega'])}{section}.example.{'com' if i % 4 < 2 else 'net'}"
        rows.append((i, f"https://{host}/{'de' if bad else 'fr'}/{section}/{i}", "<script>bad<b</script>super mega shop deal news guide " * 3, "r", "h"))
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    rules = (("com", "/fr/", "allow"), ("com", "/de/", "block"))
    model = url_filter.train(pages, rules=rules)
    assert model.host_words("megashop.example.net") == ["mega", "shop", "example", "net"] and "script" not in model.cost
    seen = Counter()
    for url in (r[1] for r in rows):
        host, path = plain_parts(url)
        found = plain_rule(host, path, rules)
        if found:
            seen[found[1]] += 1
    examples = max(len(url_filter.BLOCK_WORDS), url_filter.EXAMPLE_SHARE * sum(seen.values()))
    assert model.prior == pytest.approx(math.log((seen["block"] + examples + 1) / (seen["allow"] + 1)))
    got = url_filter.judge(pages, model).collect()
    assert len(got) == 400 and all((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert {r.rule for r in got if r.host.endswith("net")} == {None}
    assert model.judge("casinowin.net", "/")[1] == "block"
