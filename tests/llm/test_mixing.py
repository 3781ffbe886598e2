from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from coderill.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**12))
def test_permutation(n, key):
    assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=5), st.integers(1, 60), st.integers(0, 9))
def test_shards_add_up(quotas, slots, seed):
    quotas = np.array(quotas)
    total = int(quotas.sum())
    if not total:
        return
    at = np.zeros_like(quotas)
    for shard in range(-(-total // slots)):
        counts, offsets = mixing.draw_counts(quotas, slots, shard, seed)
        assert counts.sum() == min(slots, total - shard * slots) and (offsets == at).all() and (counts >= 0).all()
        at = at + counts
    assert (at == quotas).all()


def test_draw_follows_the_hypergeometric_law():
    have, take, n = np.array([60, 90, 250]), 150, 4000
    rng = np.random.default_rng(1)
    got = np.array([mixing.draw_without_replacement(have, take, rng) for _ in range(n)])
    share = have / have.sum()
    spread = np.sqrt(take * share * (1 - share) * (have.sum() - take) / (have.sum() - 1))
    assert (got.sum(1) == take).all() and (got <= have).all()
    assert (abs(got.mean(0) - take * share) < 4 * spread / np.sqrt(n)).all() and (abs(got.std(0) / spread - 1) < 0.06).all()


def test_no_switch_at_large_counts():
    """Just below, at and far above the range of numpy's own generator the draw has the spread of the law."""
    for size in (9 * 10**8, 10**9, 4 * 10**12):
        have = np.array([size // 4 * 3, size // 4])
        rng = np.random.default_rng(2)
        got = np.array([mixing.draw_without_replacement(have, size // 4, rng)[0] for _ in range(600)], dtype=float)
        spread = (size / 4 * 0.75 * 0.25 * 0.75) ** 0.5
        assert abs(got.mean() - size / 4 * 0.75) < 4 * spread / 600**0.5 and 0.85 < got.std() / spread < 1.15


def test_shards_cost_no_setup_by_their_number():
    counts, offsets = mixing.draw_counts(np.array([3 * 10**12, 10**12]), 4096, 700_000_000, 1)
    assert counts.sum() == 4096 and offsets.sum() == 4096 * 700_000_000


def documents(spark):
    rows = [(i, "some words about boats number %d and more " % i * (1 + i % 9), ["issue", " Issue ", "chat", "read-me"][i % 4]) for i in range(600)]
    rows += [(601, None, "issue"), (602, "", "issue"), (603, "lost", None), (1, "repeated row", "chat")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "2 as block_no")


def test_mix(spark):
    docs = documents(spark)
    targets = spark.createDataFrame(
        [(1, "issue", 0.2, 1), (1, "chat", 0.5, 4), (1, "read_me", 0.3, 3), (2, "issue", 3.0, 2), (2, "wiki", 1.0, 5), (2, "chat", 1.0, None), (3, "wiki", 1.0, 1), (4, None, 1.0, 1), (5, "chat", None, 1)],
        "mix_id long, source string, target_share double, max_repeats int",
    )
    mixed = mixing.mix_documents(docs, targets, block_tokens=64).cache()
    caps = {(1, "issue"): 1, (1, "chat"): 4, (1, "read_me"): 3, (2, "issue"): 2, (2, "chat"): 1}
    seen = Counter()
    for r in mixed.collect():
        assert r.doc_id not in (601, 602, 603)
        seen[r.mix_id, r.source, r.doc_id, r.block_no, r.start_token] += 1
    for (mix, source, *_), n in seen.items():
        assert n <= caps[mix, source]
    report = {(r.mix_id, r.source): r for r in mixing.share_report(mixed, targets).collect()}
    for source, share in [("issue", 0.2), ("chat", 0.5), ("read_me", 0.3)]:
        assert abs(report[1, source].actual_share - share) < 0.02
    assert abs(report[2, "issue"].actual_share - 0.75) < 0.02 and report[2, "wiki"].n_tokens == 0
    assert report[3, "wiki"].actual_share is None and (4, None) not in report
    again = mixing.mix_documents(docs, targets, block_tokens=64)
    assert again.exceptAll(mixed).count() == 0


def test_blocks_hold_every_token(spark):
    sized = spark.createDataFrame([(i, "abc"[i % 3 % 2], (i * 13) % 90) for i in range(300)], "doc_id long, source string, n long")
    got = mixing.blocks_of(sized, 50, group_rows=70).collect()
    per_doc, per_block = Counter(), Counter()
    for r in got:
        per_doc[r.doc_id] += r.n_tokens
        per_block[r.source, r.block_no] += r.n_tokens
    assert all(per_doc[i] == (i * 13) % 90 for i in range(300))
    assert max(per_block.values()) == 50
    for s in "ab":
        numbers = sorted(b for t, b in per_block if t == s)
        assert numbers == list(range(len(numbers)))
    assert mixing.blocks_of(sized.limit(0)).count() == 0
