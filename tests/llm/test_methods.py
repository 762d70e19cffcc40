"""The methods inside the operators, without Spark: against brute force, exact round trips, and their bounds."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlglass.llm import (
    id_coder, language_id, line_dedup, minhash, passage_quality, substring_dedup, tokens, vp_search, weak_quality,
)
from crawlglass.llm.packing import best_fit
from crawlglass.llm.sharing import pack48, key48, unpack48
from crawlglass.llm.tokens import Encoder
from crawlglass.llm.words import mix64, shingle_sets, word_hashes

ODD_TEXTS = [
    "", " ", "\n", "a", "don't we'll I'M", "x  y\n\n z ", "Straße Ÿ ÀÉ été", "Σίσυφος ΣΑΣ", "日本語 テスト", "a\tb\r\nc\x0bd",
    "<|endoftext|> a <|startoftext|>", "é ́a", "1234 5,6.7", "\xa0non breaking", "…—“quoted”", "🙂🙂 ok",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_words_give_the_tokenizers_ids(name):
    path = public_tokenizers.path(name)
    own, whole = Encoder(path), Tokenizer.from_file(path)
    draw = random.Random(3)
    made = ["".join(draw.choice("aAbéß ñ'\n  ,.!1Σ-") for _ in range(draw.randint(0, 40))) for _ in range(2_000)]
    for text in ODD_TEXTS + made:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("long", [tokens.LONG, 10, 2])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_encoded_together_have_the_ids_of_each_alone(name, long, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", long)
    path = public_tokenizers.path(name)
    own, whole = Encoder(path), Tokenizer.from_file(path)
    draw = random.Random(4)
    odd = ["J\u030c J\u030ca", "word.\u0301", "It's NOT'S it's", "a<|b", "x.,Y-z9", "\u2003a b", "a\x1cb", "A.B\nC", "\u1680", "ÀÖ×ØÞß÷ÿ", "É.É,é É\u0301.É Ç1ç×"]
    made = ["".join(draw.choice("aAbBjJéß ñ'\u030c\u0301  \n\t,.!19Σ-<|\xa0") for _ in range(draw.randint(0, 30))) for _ in range(2_000)]
    plain = ["".join(draw.choice("aAbBjJzÉéß× ñ'  \n,.!19-") for _ in range(draw.randint(0, 30))) for _ in range(2_000)]
    for texts in ([], [""], ["", ""], odd, ODD_TEXTS, made, plain, ODD_TEXTS + odd + made + plain):
        got = own.encode_all(texts)
        assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_differ_in_case_or_marks_are_encoded_once():
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    own.encode_all(["Word word, WORD word. (word)", "wörd,wÖrd Wörd."] * 50)
    assert sorted(own._known) == ["(", ")", ",", ".", "word", "wörd"]


@pytest.mark.filterwarnings("error")
def test_blocks_of_all_lengths_and_vocabularies_round_trip():
    draw = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 33, 64, 65, 255, 257, 1_025, 2_049, id_coder.BLOCK_IDS):
        for vocabulary in (1, 2, 300, 49_408, 1 << 16, id_coder.MOST_VOCABULARY):
            ids = np.stack([
                draw.integers(0, vocabulary, n), np.full(n, vocabulary - 1), np.arange(n) % min(vocabulary, 7), draw.zipf(1.2, n) % vocabulary,
            ]).astype(np.uint32)
            coded = id_coder._encode(ids, vocabulary)
            assert (id_coder._decode(coded, n, vocabulary) == ids).all(), (n, vocabulary)
    with pytest.raises(ValueError):
        id_coder.write_segment([1], [np.array([1], np.uint32)], id_coder.MOST_VOCABULARY + 1)


def test_shares_fill_the_whole_and_follow_the_weights():
    mixer = id_coder.Mixer(3)
    for order0 in (False, True):
        begins, shares = mixer.shares(order0)
        assert (begins[3] + shares[3] == 1 << 12).all() and (begins[1:] == begins[:3] + shares[:3]).all() and (shares[3] > 0).all()
        assert ((shares[2] > 0) == order0).all() and (shares[:2][mixer.weights[:2] > 0] > 0).all()
    mixer.learn(np.full(200, 2 * mixer.rows + 5))
    assert mixer.shares(True)[1][2, 5] > 3_900


def test_segments_round_trip_and_notice_damage():
    draw = np.random.default_rng(1)
    cases = [[], [[]], [[5]], [[1] * 900], [draw.integers(0, 49_408, 3_000)], [draw.zipf(1.3, 9_000) % 49_408, [], [3, 4, 5] * 300]]
    for case in cases:
        docs = [np.array(d, np.uint32) for d in case]
        names = [None if i == 1 else -i for i in range(len(docs))]
        data = id_coder.write_segment(names, docs, 49_408)
        got_names, got = id_coder.read_segment(data)
        assert got_names == names
        assert [d.tolist() for d in got] == [d.tolist() for d in docs]
    for at in (20, len(data) // 2, len(data) - 9):
        damaged = bytearray(data)
        damaged[at] ^= 255
        with pytest.raises((ValueError, IndexError)):
            id_coder.read_segment(bytes(damaged))


def test_repeated_ids_become_cheap():
    docs = [np.tile(np.arange(40, dtype=np.uint32), 200)]
    assert len(id_coder.write_segment([1], docs, 49_408)) < docs[0].size / 2  # two bytes an id without coding; blocks of 256 start anew


def test_best_fit_keeps_every_capacity_and_prefers_full_bins():
    draw = np.random.default_rng(2)
    size = np.sort(draw.integers(1, 101, 400))[::-1]
    demand = np.stack([size, np.ones(400), size**2], axis=1).astype(float)
    for rule in ("norm", "dot"):
        for capacity in ([100, 100, 10_000], [100, 3, 10_000], [100, 100, 4_000]):
            bins, before = best_fit(demand, np.array(capacity, float), np.array([1, 0.1, 0.1]), rule)
            for b in range(bins.max() + 1):
                rows = np.flatnonzero(bins == b)
                assert len(rows) == 1 or (demand[rows].sum(axis=0) <= capacity).all()
                assert before[rows].tolist() == (np.cumsum(size[rows]) - size[rows]).tolist()
    bins, _ = best_fit(demand, np.array([100, 400, 1e9]), np.array([1.0, 0, 0]))
    room: list[int] = []  # plain best-fit decreasing
    for n in size.tolist():
        fitting = [i for i, r in enumerate(room) if r >= n]
        if fitting:
            room[min(fitting, key=lambda i: room[i])] -= n
        else:
            room.append(100 - n)
    assert bins.max() + 1 == len(room)


def test_vantage_point_search_is_exact_at_factor_one_and_near_at_more():
    draw = np.random.default_rng(3)
    data = draw.normal(size=(3_000, 12)).round(1)
    data[100:140] = data[100]  # ties
    ids = np.arange(3_000) * 3 + 1
    points = vp_search.lifted(data)
    tree = vp_search.build(points, leaf=32)
    asked, names = data[::50], ids[::50]
    scores = asked @ data.T
    scores[names[:, None] == ids[None, :]] = -np.inf
    wanted = [ids[np.lexsort((ids, -row))[:10]] for row in scores]
    found, best = vp_search.search(tree, points, ids, asked, names, 10, 1.0)
    assert np.allclose(best, -np.sort(-scores, axis=1)[:, :10])
    assert all(set(w) == set(f) or np.isclose(row[np.searchsorted(ids, w)].min(), row[np.searchsorted(ids, f)].min())
               for w, f, row in zip(wanted, found, scores))
    near, _ = vp_search.search(tree, points, ids, asked, names, 10, 2.0)
    assert np.mean([len(set(w) & set(f)) / 10 for w, f in zip(wanted, near)]) > 0.9
    few, score = vp_search.search(vp_search.build(points[:4]), points[:4], ids[:4], asked[:1], names[:1], 10, 1.0)
    assert (few[0] >= 0).sum() == 3 and np.isneginf(score[0, 3:]).all()


def test_triggers_and_suffix_minimum_against_brute_force():
    draw = np.random.default_rng(4)
    data = draw.integers(97, 99, 400).astype(np.uint8)
    low = substring_dedup._triggers(data, 50, 7)
    assert len(low) == 351
    same = {}
    for i in range(351):  # equal strings have equal triggers
        assert same.setdefault(data[i : i + 50].tobytes(), low[i]) == low[i]
    phrases = [bytes(data[a : a + n]) for a, n in ((0, 60), (10, 70), (5, 50), (200, 90), (10, 70))]
    least = np.array([9, 4, 7, 1, 2])
    first = {}
    for phrase, doc in zip(phrases, least):
        for i in range(len(phrase) - 49):
            key = phrase[i : i + 50]
            first[key] = min(first.get(key, 99), doc)
    got = substring_dedup._suffix_minimum(phrases, least, 50)
    assert [g.tolist() for g in got] == [[first[p[i : i + 50]] for i in range(len(p) - 49)] for p in phrases]


def test_shingle_sets_count_like_python():
    texts = ["A b a B a b", "one", "", "  \n", "x y", "É é É é", "a\x0bb c\x0cd", "w" * 5_000 + " z"]
    for size in (1, 2, 5):
        for text, got in zip(texts, shingle_sets(texts, size)):
            words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            wanted = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
            assert len(got) == len(wanted), (text, size)


def test_minhash_signatures_meet_in_a_band():
    draw = np.random.default_rng(5)
    for n in (5, 40, 400):
        missed = 0
        for _ in range(60):
            common = mix64(draw.integers(0, 1 << 62, n).astype(np.uint64))
            extra = mix64(draw.integers(0, 1 << 62, max(n // 9, 1)).astype(np.uint64))
            a, b = np.unique(common), np.unique(np.append(common, extra))
            keys = minhash.band_keys(minhash.signatures([a, b], 200), 40, 5)
            missed += not (keys[0] == keys[1]).any()
            different = np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum()
            assert different <= len(b) - len(a)
        assert missed == 0


def test_deletion_variants_meet_exactly_within_one_edit():
    draw = random.Random(6)
    words = ["a", "b", "c"]
    for _ in range(600):
        x = [draw.choice(words) for _ in range(draw.randint(2, 7))]
        y = list(x) if draw.random() < 0.7 else [draw.choice(words) for _ in range(draw.randint(2, 7))]
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(y) + 1)
            y[at : at + draw.randint(0, 1)] = [draw.choice(words)] * draw.randint(0, 1)
        distance = np.arange(len(y) + 1)
        for i, w in enumerate(x):
            row = [i + 1]
            for j, v in enumerate(y):
                row.append(min(row[-1] + 1, distance[j + 1] + 1, distance[j] + (w != v)))
            distance = row
        near = distance[-1] <= 1
        assert line_dedup.within_one(x, y) == near
        if not y or x == y:
            continue
        lines, _ = line_dedup.split([" ".join(x) + "\n" + " ".join(y)])
        keys, place, line = lines.variants(np.array([0, 1]))
        sides = [set(zip(keys[line == i].tolist(), place[line == i].tolist())) for i in (0, 1)]
        meet = any(p >= 0 and (k, p) in sides[1] for k, p in sides[0])
        meet |= any(a[1] == -1 and b[1] >= 0 and a[0] == b[0] for s, t in (sides, sides[::-1]) for a in s for b in t)
        assert meet == near, (x, y)
        half, owner = lines.halves(np.array([0, 1]))
        if near and min(len(x), len(y)) >= 2:
            assert set(half[owner == 0]) & set(half[owner == 1])


def test_keys_of_48_bits_round_trip():
    keys = key48(mix64(np.arange(1_000, dtype=np.uint64)))
    assert (unpack48(pack48(keys)) == keys).all()


def test_label_model_finds_rules_that_are_right():
    draw = np.random.default_rng(7)
    good = draw.random(20_000) < 0.85
    votes = np.zeros((20_000, 5), int)
    for r, caught in enumerate((0.9, 0.8, 0.5, 0.4, 0.3)):
        alarm = np.where(good, draw.random(20_000) < 0.005, draw.random(20_000) < caught)
        votes[:, r] = np.where(alarm, 2, np.where(draw.random(20_000) < 0.9, 1, 0))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.03
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.97
    assert (model.good[:, 2] <= weak_quality.FALSE_ALARM + 1e-9).all()
    assert weak_quality.fit(np.empty((0, 5), int), np.empty(0)).prior > 0


def test_repeated_words_against_brute_force():
    draw = random.Random(8)
    for _ in range(300):
        words = [draw.choice("abcd") for _ in range(draw.randint(0, 30))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        hashes, _ = word_hashes([" ".join(words).encode()])
        assert weak_quality._repeated_words(hashes, 3) == len(covered)


def test_gradients_match_differences():
    draw = np.random.default_rng(9)
    x, count, y = draw.normal(size=(9, passage_quality.FEATURES)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = passage_quality.fit(x, count, y, epochs=1)
    x = model.standard(x)
    slope = passage_quality.gradients(model, x, count, y, np.ones(3))

    def loss():
        p = model.forward(x, count)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for key in ("encode", "bias", "attend", "gate", "weigh", "score"):
        weight = model.weights[key]
        at = tuple(int(draw.integers(0, s)) for s in weight.shape)
        own = weight[at]
        weight[at] = own + 1e-5
        more = loss()
        weight[at] = own - 1e-5
        assert np.isclose(slope[key][at], (more - loss()) / 2e-5, atol=1e-6)
        weight[at] = own


def test_mixture_finds_proportions_and_selects_languages():
    draw = np.random.default_rng(10)
    own = np.where(draw.random((400, 1)) < 0.7, [[1.0, 0.01, 0.01]], [[0.01, 1.0, 0.01]])
    shares, _ = language_id.mixture(own, np.array([400]))
    assert abs(shares[0, 0] - 0.7) < 0.08 and shares[0, 2] < 0.01
    texts = {"x": "aba bab aab baa abab", "y": "cdc dcd ccd ddc cdcd"}
    table = np.full((1 << 12, 2), -9.0, np.float32)
    for j, text in enumerate(texts.values()):
        bucket, _, _ = language_id.grams([text], 3, 1 << 12)
        table[bucket, j] = -2.0
    model = language_id.Model(["x", "y"], table, 3, 2.0)
    found, words = language_id.infer(model, [texts["x"] * 3, (texts["x"] + " " + texts["y"]) * 3, "", "12 34"])
    assert found[0].tolist() == [1.0, 0.0] and (found[1] > 0.3).all()
    assert found[2:].sum() == 0 and words[2:].tolist() == [0, 0]
