"""The pipeline on the smallest given tables: each stage against plain Python."""

import corpus_pipeline
import numpy as np
import pytest

from crawlglass.llm import mixing, packing
from crawlglass.storage import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_stages(written):
    docs, spoken, lined, single, mixed, packed = written
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_filter", "line_filter", "near_duplicate_filter", "source_mixing", "best_fit_packing"]
    for table in written[1:-1]:
        assert table.columns == docs.columns
    assert spoken.count() == docs.filter("text rlike '[A-Za-zß-ÿ]'").count()
    seen, left = set(), {r.doc_id: r.text for r in lined.collect()}
    for r in spoken.orderBy("doc_id").collect():
        fresh = []
        for line in r.text.split("\n"):
            key = tuple(line.split())
            if not key or key not in seen:
                fresh.append(line)
            seen.add(key)
        own = left.get(r.doc_id, "").split("\n")
        assert set(own) <= set(fresh) | {""}  # near lines may go as well
    assert {r.doc_id for r in single.collect()} <= set(left)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, single.collect()))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    used = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in used) <= 2_048
    assert len(used) <= packed.agg({"length": "sum"}).first()[0] / 2_048 * 1.05 + 1


def test_sequences_keep_the_shares_of_the_mixture(spark):
    path = new_path(spark, "test-mixture")
    text = "some words that make a text of a few ids, again and again "
    data = [(i, text * (1 + i * 7 % 5), "a" if i < 1_500 else "b", 0) for i in range(3_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long").repartition(7)
    mixing.in_order(docs, {"a": 3.0, "b": 1.0}, block_chars=500).write.parquet(path)
    stored = spark.read.parquet(path)
    packed = packing.pack_mixture(stored, tokens=256, run_sequences=16).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) == len(packed) and {r.doc_id for r in packed} == set(range(3_000))
    used, shares = {}, {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        shares.setdefault(r.sequence_id, [0, 0])[r.doc_id >= 1_500] += r.length
    assert max(used.values()) <= 256
    seen = np.cumsum([shares[k] for k in sorted(shares)], axis=0)
    total = seen.sum(axis=1)
    mixed = (seen[:, 1] < 0.3 * seen[-1, 1]) & (total > 20 * 256)  # the first documents of both, source a has not run out
    assert mixed.sum() > 50 and (abs(seen[mixed, 0] / total[mixed] - 0.75) < 0.06).all()
