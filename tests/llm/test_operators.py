"""The operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlglass.llm import (
    graph, id_coder, language_id, line_dedup, minhash, mixing, packing, passage_quality, substring_dedup, vp_search, weak_quality,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, keys string, hash int, bucket int"
EN = "the cat sat on the mat and the dog ran to the house with a red ball in the rain while birds sang"
DE = "der hund lief in das haus und die katze schlief auf dem sofa bis der regen an die fenster schlug"
LINE = "this line of several words is shared by a number of documents here"
PASSAGE = "A passage of more than fifty bytes that two documents have in common, word for word. "


def rows():
    long_text = " ".join(f"word{i} thing{i % 7}" for i in range(6_000))
    texts = [
        EN, EN, EN.replace("red", "blue"), DE, None, "", "   \n\t", "12 34 -- ?", long_text, LINE + "\n" + EN + "\nmore",
        LINE + "\n" + DE, LINE.replace("several", "many") + "\n" + PASSAGE + "tail one", "head two " + PASSAGE * 2,
        "é à ü ß " * 40, "a", "a", LINE, "x\n\nx", PASSAGE + PASSAGE,
    ]
    made = [(i, t, "en" if t and EN[:20] in t else "de" if t == DE else None, None if i == 3 else f"s{i % 3}", len(t or ""), "r", "k", 1, 2)
            for i, t in enumerate(texts)]
    made.append((5, "", None, "s1", 0, None, None, None, None))
    made.append((9, texts[9], "en", "s0", 1, "r", "k", 1, 2))  # a row that repeats an id
    made.append((None, EN, None, None, None, None, None, None, None))
    return made


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language(docs, none):
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert got[0].lang_pred == "en" and got[3].lang_pred == "de" and got[0].score > 0.9
    assert set(got[10].proportions) <= {"de", "en"} and abs(sum(got[10].proportions.values()) - 1) < 1e-6
    for i in (4, 5, 6, 7):
        assert (got[i].lang_pred, got[i].score, got[i].proportions) == ("und", 0.0, {})
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 7})
    assert language_id.identify(none, model).count() == 0
    empty = language_id.train(none)
    assert empty.languages == [] and {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_token_ids(docs, none):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [tuple(r) for r in id_coder.token_ids(docs).orderBy("start").collect()]
    order = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, wanted = 0, []
    for name, text in order:
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((name, at, len(ids), crc32(ids.tobytes())))
        at += len(ids)
    assert got == wanted
    assert id_coder.token_ids(none).count() == 0


def test_weak_supervision(docs, none):
    got = weak_quality.judge(docs).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        own, lines, seen = words(texts[r.doc_id]), (texts[r.doc_id] or "").split("\n"), set()
        assert (r.n_words, r.word_chars) == (len(own), sum(map(len, own)))
        repeated = 0
        for line in lines:
            if words(line):
                repeated += line in seen
                seen.add(line)
        assert r.n_dup_lines == repeated
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
        assert 0 <= r.posterior <= 1
    assert weak_quality.judge(none).count() == 0


def test_packing(docs, none):
    cut = packing.pieces(docs, tokens=64)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in rows()}
    for r in cut.collect():
        ids = np.array([*tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.length <= 64 and r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
        assert r.length == 64 or r.piece == 0
    for options in ({}, {"documents": 2}, {"attention": 2_000}, {"rule": "dot", "shard_pieces": 50}):
        packed = packing.pack(cut, tokens=64, **options).collect()
        assert len(packed) == cut.count()
        bins = {}
        for r in packed:
            bins.setdefault(r.sequence_id, []).append(r)
        for members in bins.values():
            members.sort(key=lambda r: r.offset)
            assert [m.offset for m in members] == np.cumsum([0, *(m.length for m in members[:-1])]).tolist()
            assert sum(m.length for m in members) <= 64
            assert len(members) <= options.get("documents", 64)
            assert len(members) == 1 or sum(m.length**2 for m in members) <= options.get("attention", 64**2)
    assert packing.pack_documents(none).count() == 0


def test_mixing_keeps_every_row_within_a_block_of_its_share(spark, docs, none):
    mixed = mixing.mix(docs, block_chars=100)
    assert mixed.columns == [c for c in docs.columns if c != "n_chars"] + mixing.PLAN
    assert mixed.count() == len(rows())
    assert mixing.mix(none).count() == 0
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs).count() == len(rows())
    given = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, block_chars=100)
    assert given.count() == len(rows())


def earliest_deadline_first(parts, slots):
    """Source and block of each slot."""
    h, done, out = sum(parts), [0] * len(parts), []
    for t in range(slots):
        ready = [(-(-(done[i] + 1) * h // n), i) for i, n in enumerate(parts) if done[i] * h // n <= t]
        pick = min(ready)[1]
        out.append((pick, done[pick]))
        done[pick] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_of_a_schedule_are_those_of_the_whole(spark, seed):
    draw = np.random.default_rng(seed)
    parts = [[5, 3, 3, 1, 1], [1, 1, 1], draw.integers(1, 10**6, 12).tolist(), (10**6 / np.arange(1, 31) ** 2).astype(int).tolist()][seed]
    weights = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(parts)], "key string, n long")
    wanted = earliest_deadline_first(parts, 32 * 40)
    got = mixing.schedule(weights, spark.range(40).toDF("segment"), 32).collect()
    assert sorted((r.slot, int(r.key[1:]), r.block) for r in got) == [(t, *x) for t, x in enumerate(wanted)]
    far = mixing.schedule(weights, spark.range(1).select((F.col("id") + 1_000_000).alias("segment")), 32).orderBy("slot").collect()
    h = sum(parts)
    for r in far:
        n = parts[int(r.key[1:])]
        assert r.block * h // n <= r.slot < -(-(r.block + 1) * h // n)


def test_no_source_is_ever_a_block_away_from_its_target(spark):
    draw = np.random.default_rng(9)
    targets = np.exp(draw.normal(size=300) * 0.7)
    sums = spark.createDataFrame([(f"=s{i:03}", 1) for i in range(300)], "key string, mass long")
    weights = mixing._weights(sums, {f"s{i:03}": float(w) for i, w in enumerate(targets)}, mixing.RESOLUTION)
    assert min(targets) / sum(targets) > 1 / 3_600  # none is lifted
    segments = spark.range(200).toDF("segment").repartition(16)
    got = mixing.schedule(weights, segments, 512).select("key", "slot").toPandas().sort_values("slot")
    assert len(got) == 102_400 and (got["slot"] == np.arange(102_400)).all()
    source = got["key"].str[2:].astype(int).to_numpy()
    parts = {int(r.key[2:]): r.n for r in weights.collect()}
    h, t, rounding = sum(parts.values()), np.arange(1, 102_401), 0.0
    for i, share in enumerate(targets / targets.sum()):
        assert (np.abs(np.cumsum(source == i) * h - t * parts[i]) < h).all()  # exact, in whole numbers
        rounding = max(rounding, 102_400 * abs(parts[i] / h - share))
    assert rounding < 0.001  # of a block, over all slots


def test_mixing_without_broadcast_gives_the_same(docs, monkeypatch):
    sent = mixing.mix(docs, block_chars=100).select("doc_id", "slot", "start", "release", "deadline").collect()
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", -1)
    joined = mixing.mix(docs, block_chars=100).select("doc_id", "slot", "start", "release", "deadline").collect()
    key = lambda r: (r.slot, r.start, r.doc_id or -1)
    assert sorted(sent, key=key) == sorted(joined, key=key) and len(sent) == len(rows())
    assert all(r.release <= r.slot < r.deadline for r in sent)


def test_mixing_meets_targets_among_many_sources(spark, monkeypatch):
    data = [(i, "x" * 9, "s0") for i in range(900)] + [(1_000 + i, "x" * 9, f"s{i}") for i in range(1, 300)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    for targets, wanted in (({"s0": 3.0, "s1": 1.0}, 0.75), (None, 30 / (30 + 299))):
        mixed = mixing.mix(table, targets, block_chars=10)
        last = mixed.filter("source = 's0'").orderBy(F.desc("slot")).first()
        assert abs((last.block + 1) / (last.slot + 1) / wanted - 1) < 0.1
    monkeypatch.setattr(mixing, "MAX_SOURCES", 299)
    with pytest.raises(Exception, match="300 sources"):
        mixing.mix(table).collect()


def brute_spans(texts):
    first, out = {}, {}
    for i, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 49):
            gone[j : j + 50] |= first.setdefault(data[j : j + 50], i) < i
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs, none):
    got = substring_dedup.remove_duplicates(docs).collect()
    assert len(got) == len(rows())
    wanted = brute_spans({r[0]: r[1] for r in rows() if r[0] is not None})
    for r in got:
        own = (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
        if r.doc_id is None:
            assert (r.n_removed, bytes(r.kept).decode()) == (0, EN)
        else:
            assert own == wanted[r.doc_id]
    assert substring_dedup.remove_duplicates(none).count() == 0


def test_substrings_that_a_document_repeats_go_at_every_place(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_PACKED_STEP", 1)  # each document is a step of its own
    other = PASSAGE.replace("two", "few")
    texts = {1: "start " + PASSAGE + "end", 2: PASSAGE + "first " + PASSAGE + "second " + PASSAGE, 3: other + "x" + other[8:] + "y" + other,
             4: "nothing that another document has, however long this line gets"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in substring_dedup.remove_duplicates(table).collect()}
    assert got == brute_spans(texts) and got[2][2] == 3


def test_vector_search(spark):
    draw = np.random.default_rng(0)
    data = [(i, draw.normal(size=6).round(2).tolist(), 1, "x") for i in range(400)]
    data += [(400, None, 1, "x"), (401, [0.0] * 6, 1, "x"), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (403, [float("nan")] * 6, 1, "x"),
             (None, [1.0] * 6, 1, "x"), (404, [1.0, 2.0], 1, "x"), (7, data[7][1], 1, "x"), (405, data[7][1], 1, "x"), (420, [3.0, 1.0], 1, "x")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int, vector string")
    got = vp_search.nearest(table, F.col("id") % 20 == 0, factor=1.0, shard_rows=150, block_rows=8).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    # components are floats, as in the table
    usable = {i: np.array(v, np.float32).astype(float) for i, v, *_ in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    assert set(found) == {i for i in usable if i % 20 == 0 and len(usable[i]) in (2, 6)}
    for q, hits in found.items():
        hits.sort(key=lambda r: r.rank)
        scores = sorted(((-float(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])))[:20]
        assert np.allclose([h.score for h in hits], [-s for s, _ in scores])
        assert [h.rank for h in hits] == list(range(1, len(scores) + 1))
    assert found[420][0].vec_id == 404 and len(found[420]) == 1
    assert vp_search.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_vector_search_finds_neighbours_of_vectors_of_unequal_lengths(spark):
    draw = np.random.default_rng(11)
    for spread in (0.1, 0.5):
        data = draw.normal(size=(16_384, 64))
        data *= np.exp(draw.normal(size=(16_384, 1)) * spread) / np.linalg.norm(data, axis=1, keepdims=True)
        table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>")
        found = {}
        for r in vp_search.nearest(table, F.col("id") % 200 == 0).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        names = np.arange(0, 16_384, 200)
        scores = data[names] @ data.T
        scores[np.arange(len(names)), names] = -np.inf
        wanted = np.argsort(-scores, axis=1)[:, :20]
        recall = np.mean([len(found[q] & set(w)) / 20 for q, w in zip(names.tolist(), wanted.tolist())])
        assert recall >= 0.9, (spread, recall)


def test_passage_quality(spark, docs, none):
    bad = [(100 + i, "BUY NOW!! $$$ " * (20 + i), "en", "s", 1, "r", "k", 1, 2) for i in range(30)]
    good = [(200 + i, EN + f" {i} " + DE, "en", "s", 1, "r", "k", 1, 2) for i in range(30)]
    table = docs.unionByName(spark.createDataFrame(bad + good, SCHEMA))
    labels = spark.createDataFrame([(100 + i, 0) for i in range(25)] + [(200 + i, 1) for i in range(25)] + [(1, None), (None, 1), (2, 0), (2, 1)],
                                   "doc_id long, quality int")
    model = passage_quality.train(table, labels)
    got = passage_quality.score(table, model).collect()
    assert len(got) == len(rows()) + 60
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.top_passage < r.n_passages for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[125 + i].predicted == 0 and by_id[225 + i].predicted == 1 for i in range(5))
    assert by_id[4].score == by_id[5].score and by_id[4].n_passages == 1
    assert passage_quality.score(none, model).count() == 0
    blank = passage_quality.train(table, labels.limit(0))
    assert passage_quality.score(table, blank).count() == len(got)


def one_edit(x, y):
    return x != y and (
        any(x[:k] + x[k + 1 :] == y for k in range(len(x))) or any(y[:k] + y[k + 1 :] == x for k in range(len(y)))
        or any(x[:k] + x[k + 1 :] == y[:k] + y[k + 1 :] for k in range(len(x)) if len(x) == len(y)))


def near_lines(x, y, least=8):
    if min(len(x), len(y)) >= least and one_edit(x, y):
        return True
    one, other = " ".join(x), " ".join(y)
    return max(len(x), len(y)) <= least and min(len(one), len(other)) >= least and one_edit(one, other)


def brute_lines(texts):
    lines = [(i, k, words(line)) for i, t in sorted(texts.items()) if t is not None for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, w in lines:
        first.setdefault(tuple(w), (i, k))
    out = {}
    for i, k, w in lines:
        near = min((at for o, at in first.items() if at < first[tuple(w)] and near_lines(list(o), w)), default=None)
        out[i, k] = (first[tuple(w)] if w else (i, k), near, not w or (first[tuple(w)] == (i, k) and near is None))
    return out


def test_lines(docs, none):
    got = line_dedup.line_classes(docs).collect()
    wanted = brute_lines({r[0]: r[1] for r in rows() if r[0] is not None})
    assert {(r.doc_id, r.line_no) for r in got if r.doc_id is not None} == set(wanted)
    assert len(got) == len(wanted) + 3 + 1 + 1  # id 9 twice, id 5 twice, the null id
    for r in got:
        near = None if r.near_doc_id is None else (r.near_doc_id, r.near_line_no)
        if r.doc_id is not None:
            assert ((r.first_doc_id, r.first_line_no), near, r.kept) == wanted[r.doc_id, r.line_no]
        else:
            assert r.kept
    left = line_dedup.without_duplicate_lines(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert 1 not in texts and 2 not in texts and 16 not in texts  # nothing of their own is left
    assert texts[9] == LINE + "\nmore" and 10 not in texts  # of 10, one line is in 9 and one in 3
    assert texts[4] is None and texts[6] == "   \n\t" and texts[17] == "x\n"
    assert texts[3] == DE and 14 in texts and 15 not in texts
    assert line_dedup.line_classes(none).count() == 0 and line_dedup.without_duplicate_lines(none).count() == 0


def test_short_and_unspaced_lines_are_compared_by_characters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_VARIANTS", 50)  # lines of many units are emitted in parts
    draw = np.random.default_rng(5)
    seeds = ["foo bar baz", "文字列の比較は文字ごとに行われます", "one two three four five six seven", "one two three four five six seven eight",
             "short 1", "short line 1", "😀😀 emoji line", "x" * 300, "a b c d e f g h", "tail", "12345678", "1234567", "one  two\tthree four five six seven"]
    made = []
    for i in range(120):
        lines = []
        for _ in range(3):
            line = list(draw.choice(seeds))
            for _ in range(draw.integers(0, 3)):
                at = int(draw.integers(0, len(line) + 1))
                line[at : at + int(draw.integers(0, 2))] = [str(draw.choice(["", " ", "x", "語", "😀"]))]
            lines.append("".join(line))
        made.append((i, "\n".join(lines)))
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    wanted = brute_lines(dict(made))
    got = {}
    for r in line_dedup.line_classes(table).collect():
        near = None if r.near_doc_id is None else (r.near_doc_id, r.near_line_no)
        got[r.doc_id, r.line_no] = ((r.first_doc_id, r.first_line_no), near, r.kept)
    assert got == wanted
    assert sum(near is not None for _, near, _ in wanted.values()) > 50


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, none, size):
    base = [f"t{i}" for i in range(60)]
    family = [(300 + j, " ".join(w if (i * 7 + j) % 61 else f"n{j}" for i, w in enumerate(base)), "en", "s", 1, "r", "k", 1, 2) for j in range(25)]
    table = docs.unionByName(spark.createDataFrame(family, SCHEMA))
    sets = {}
    for i, text, *_ in rows() + family:
        w = words(text, True)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    names = sorted(i for i in sets if i is not None)
    component = {i: i for i in names}
    for _ in names:
        for a in names:
            for b in names:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    component[a] = component[b] = min(component[a], component[b])
    got = minhash.near_duplicates(table, words=size).collect()
    assert len(got) == len(rows()) + 25
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == component.get(r.doc_id) and r.kept == (r.doc_id is None or component[r.doc_id] == r.doc_id)
    if size == 5:
        assert minhash.near_duplicates(none).count() == 0
        kept = minhash.without_near_duplicates(docs)
        assert kept.columns == docs.columns and {1} & {r.doc_id for r in kept.collect()} == set()


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (50, 50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeated_ids():
    """Rows that repeat an id with different texts, and some with null ids."""
    shared = [f"shared passage {i} of more than fifty bytes, {'found in several rows ' * 3}" for i in range(6)]
    draw = np.random.default_rng(3)
    made = []
    for i in range(60):
        parts = [f"own line {i} {draw.integers(10**9)} with several words that no other row has"]
        parts += [shared[k] for k in draw.integers(0, 6, draw.integers(0, 4))]
        parts += [shared[k].replace("found", "seen", 1) for k in draw.integers(0, 6, draw.integers(0, 2))]
        draw.shuffle(parts)
        made.append((None if i % 15 == 14 else int(draw.choice([1, 1, 2, 3, 4, i])), "\n".join(parts)))
    return made + made[:5] + [(1, None), (1, ""), (2, "")]


def test_rows_that_repeat_an_id_keep_their_own_bytes(spark):
    made = repeated_ids()
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    starts = {}
    for i, text in made:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            starts[data[k : k + 50]] = min(starts.get(data[k : k + 50], (1 << 62)), 1 << 62 if i is None else i)
    want = []
    for i, text in made:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49) if i is not None else ():
            if starts[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append((i, kept, len(data), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum())))
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in substring_dedup.remove_duplicates(table).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    made = repeated_ids()
    table = spark.createDataFrame([(i, t, "s") for i, t in made], "doc_id long, text string, source string").repartition(4)
    places = [(i, k, words(line)) for i, t in made if t is not None and i is not None for k, line in enumerate(t.split("\n"))]

    def kept(i, k, line):
        if not line or i is None:
            return True
        first = min((a, b) for a, b, other in places if other == line)
        near = any((a, b) < first and near_lines(line, other) for a, b, other in places)
        return first == (i, k) and not near

    want = []
    for i, text in made:
        if text is None:
            want.append((i, None))
            continue
        lines = text.split("\n")
        left = [line for k, line in enumerate(lines) if kept(i, k, words(line))]
        if len(left) == len(lines) or any(map(words, left)):
            want.append((i, "\n".join(left)))
    got = [(r.doc_id, r.text) for r in line_dedup.without_duplicate_lines(table).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
