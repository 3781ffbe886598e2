import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coderill.llm import packing
from coderill.llm.tokens import encoder


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60), st.sampled_from([[64], [16, 64], [8, 16, 32, 64]]))
def test_best_fit_is_valid(sizes, permitted):
    sizes = np.array(sizes, dtype=np.int64)
    bins, offsets, capacity = packing.best_fit(sizes, permitted)
    total = 0
    for k, c in enumerate(capacity):
        own = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == k)
        at = 0
        for o, n in own:
            assert o == at or n == 0
            at = max(at, o + n)
        assert at <= c and c in permitted and all(p < at for p in permitted if p < c)
        total += c
    assert total <= 2 * max(permitted) + 2 * sizes.sum() or len(sizes) == 0


def optimum(sizes, permitted):
    """Least total capacity by trying every assignment of a few items."""
    best = [10**9]

    def go(k, loads):
        if k == len(sizes):
            best[0] = min(best[0], sum(min(c for c in permitted if c >= x) for x in loads))
            return
        for j in range(len(loads)):
            if loads[j] + sizes[k] <= max(permitted):
                go(k + 1, loads[:j] + [loads[j] + sizes[k]] + loads[j + 1 :])
        go(k + 1, [*loads, sizes[k]])

    go(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=6), st.sampled_from([[16], [4, 8, 16]]))
def test_near_the_optimum(sizes, permitted):
    _, _, capacity = packing.best_fit(np.array(sizes), permitted)
    assert sum(capacity) <= 1.5 * optimum(sizes, permitted) + max(permitted)


def test_pack_items(spark):
    rows = [(i % 7 if i % 5 else None, (i * 37) % 300) for i in range(400)] + [(1, None), (2, 0)]
    items = spark.createDataFrame(rows, "k long, n long").selectExpr("*", "1 as pack_id", "2 as _size")
    packs = spark.createDataFrame([(1, 64), (2, 256), (2, 256), (3, 0), (4, None)], "pack_id long, capacity_tokens int")
    got = packing.pack_items(items, packs, "k", "n", shard_items=150).toPandas()
    for pack, cap in [(1, 64), (2, 256)]:
        mine = got[got.pack_id == pack]
        assert mine.n_tokens.sum() == sum(n or 0 for _, n in rows)
        assert len(mine) == sum(max(1, -(-n // cap)) for _, n in rows if n is not None)
        loads = mine.groupby("container_id").n_tokens.sum()
        caps = mine.groupby("container_id").capacity_tokens.first()
        assert (loads <= caps).all() and set(caps) <= {64, 256} and caps.max() <= cap
        assert loads.sum() / caps.sum() > 0.9
    assert set(got.pack_id) == {1, 2}
    assert packing.pack_items(items.limit(0), packs, "k", "n").count() == 0
    assert packing.pack_items(items, packs.limit(0), "k", "n").count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 700), (4, "x")], "doc_id long, text string")
    packs = spark.createDataFrame([(1, 128)], "pack_id long, capacity_tokens int")
    got = packing.pack_documents(docs, packs)
    sizes = {(r.doc_id, r.piece_no): r.n_tokens for r in got.collect() if r.doc_id != 4}
    assert sizes == {(1, 0): len(encoder().encode_ordinary("hello world")), (3, 0): 0}
    report = packing.fill_report(got).first()
    assert report.tokens == sum(len(encoder().encode_ordinary(t)) for t in ["hello world", "word " * 700, "x"])


def test_too_many_packs(spark):
    packs = spark.range(1, 100).selectExpr("id as pack_id", "cast(id as int) as capacity_tokens")
    with pytest.raises(ValueError):
        packing.pack_items(spark.createDataFrame([(1, 1)], "k long, n long"), packs, "k", "n")
