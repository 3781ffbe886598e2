"""Problem 7: sources mixed to target shares.

Token streams of every source are cut into blocks of a fixed number of tokens.  Each output shard draws how many blocks it takes
of each source (multinomial counts, conditioned on the totals, so that they add up), the slots of a source run through a
pseudorandom permutation of its blocks once per repetition, and slots and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coderill.llm.tokens import VOCABULARY, count_tokens
from coderill.session import cut_lineage, spread

BLOCK_TOKENS, SHARD_SLOTS, GROUP_ROWS = 256, 4096, 20_000


def clean_source(source: str):
    """The source's name in one spelling: lower case, words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(source)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"[^\p{L}\p{N}]+", "_")


def blocks_of(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Segments of documents in numbered blocks: source, block_no, doc_id, start_token, n_tokens; ``sized`` (doc_id, source,
    n) must be a written table.

    Documents of a source are spread over groups of about ``group_rows`` rows, each cut on its own, so that a source
    that holds most of the rows needs no task of its own; a group's last block may be short."""
    rows = sized.filter("n > 0 and source is not null")
    groups = max(1, -(-rows.count() // group_rows))
    rows = rows.withColumn("_id", F.xxhash64(F.monotonically_increasing_id())).withColumn("_group", F.pmod("_id", F.lit(groups)))
    w = Window.partitionBy("source", "_group").orderBy("_id", "doc_id")
    rows = rows.withColumn("_end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("n"))
    sizes = rows.groupBy("source", "_group").agg(F.ceil(F.sum("n") / block_tokens).alias("_blocks"))
    before = F.coalesce(F.sum("_blocks").over(Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.withColumn("_first", before), ["source", "_group"])
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / block_tokens), F.floor((F.col("_end") - 1) / block_tokens))))
    low = F.greatest(F.col("_start"), F.col("_b") * block_tokens)
    high = F.least(F.col("_end"), (F.col("_b") + 1) * block_tokens)
    return rows.select("source", (F.col("_first") + F.col("_b")).cast("long").alias("block_no"), "doc_id", (low - F.col("_start")).cast("long").alias("start_token"), (high - low).cast("long").alias("n_tokens"))


def plan(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, share, max_repeats, n_blocks, quota: how many blocks each mix takes of each source.

    Shares are made to sum to 1 over the sources that have blocks; the whole mix is as large as the source that is used up
    first allows.  Targets with a null or non-positive share are left out, a null or lower cap counts as 1, and a
    source named twice in a mix has the sum of its shares and the larger cap."""
    wanted = (
        targets.filter("target_share > 0 and source is not null")
        .groupBy("mix_id", clean_source("source").alias("source"))
        .agg(F.sum("target_share").alias("_share"), F.max(F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("max_repeats"))
    )
    have = blocks.groupBy("source").agg((F.max("block_no") + 1).alias("n_blocks"))
    every = Window.partitionBy("mix_id")
    found = wanted.join(have, "source").withColumn("share", F.col("_share") / F.sum("_share").over(every))
    room = F.floor(F.min(F.col("max_repeats") * F.col("n_blocks") / F.col("share")).over(every))
    exact = F.col("share") * F.col("_room")
    return found.withColumn("_room", room).select("mix_id", "source", "share", F.col("max_repeats").cast("int").alias("max_repeats"), "n_blocks", F.least(F.round(exact), F.col("max_repeats") * F.col("n_blocks")).cast("long").alias("quota"))


def draw_without_replacement(have: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``take`` of ``have`` items drawn without replacement; exact for counts of any size.

    Every item is drawn by itself with the probability that gives ``take`` on average.  Whatever number that makes, its members are a
    random set of that size, so the few that are missing are drawn from the rest, or the few too many from those drawn."""
    total = int(have.sum())
    if 2 * take > total:
        return have - draw_without_replacement(have, total - take, rng)
    if take <= 32:
        out = np.zeros_like(have)
        for k in range(take):
            out[np.searchsorted(np.cumsum(have - out), rng.integers(total - k), side="right")] += 1
        return out
    drawn = rng.binomial(have, take / total)
    more = take - int(drawn.sum())
    return drawn + draw_without_replacement(have - drawn, more, rng) if more > 0 else drawn - draw_without_replacement(drawn, -more, rng)


def draw_counts(quotas: np.ndarray, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, offsets) of the sources in one output shard; all shards have ``shard_slots`` slots but the last, which has the rest.

    The shards are halved again and again, every half draws its counts from what its parent has; each shard finds its
    own counts, and the counts of all shards before it, by walking down without seeing any other shard."""
    have = quotas.astype(np.int64)
    offsets, total = np.zeros_like(have), int(have.sum())
    low, high = 0, -(-total // shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        left = draw_without_replacement(have, min(middle * shard_slots, total) - low * shard_slots, np.random.default_rng([seed, low, high]))
        if shard < middle:
            high, have = middle, left
        else:
            offsets, low, have = offsets + left, middle, have - left
    return have, offsets


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network over the next even power of two, walked until the
    value is in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(27)
            f = f * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def draw_slots(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> DataFrame:
    """mix_id, shard_id, slot_key, source, block_no, repeat_no: every slot of every output shard with the block it takes.
    Slots of a shard are shuffled by ordering them by slot_key."""
    one = planned.filter("quota > 0").groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("source", "quota", "n_blocks"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    shards = one.withColumn("n", total).withColumn("shard_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / shard_slots).cast("int"))))
    shards = shards.repartition("mix_id", "shard_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for mix, sources, shard in zip(b["mix_id"], b["s"], b["shard_id"]):
                base = (seed * 1_000_003 + int(mix if mix is not None else -1)) & 0x7FFFFFFF
                counts, offsets = draw_counts(np.array([s["quota"] for s in sources]), shard_slots, int(shard), base)
                for k, s in enumerate(sources):
                    slots = np.arange(offsets[k], offsets[k] + counts[k], dtype=np.int64)
                    if not len(slots):
                        continue
                    repeat, index = slots // s["n_blocks"], slots % s["n_blocks"]
                    block = np.empty_like(index)
                    for r in np.unique(repeat):
                        of = repeat == r
                        block[of] = permute(index[of], int(s["n_blocks"]), base * 31 + k * 1009 + int(r))
                    yield pd.DataFrame({"mix_id": pd.array([mix] * len(slots), dtype="Int64"), "shard_id": int(shard), "slot_no": slots, "source": s["source"], "block_no": block, "repeat_no": repeat})

    schema = "mix_id long, shard_id int, slot_no long, source string, block_no long, repeat_no long"
    slots = shards.select("mix_id", "s", "shard_id").mapInPandas(run, schema)
    return slots.withColumn("slot_key", F.xxhash64(F.lit(seed), "mix_id", "source", "slot_no"))


def _sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    return cut_lineage(spread(documents.select("doc_id", "source", "text")).select("doc_id", clean_source("source").alias("source"), count_tokens("text", vocabulary).alias("n")))


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixes as segments of documents: mix_id, shard_id, slot_key, source, block_no, repeat_no, doc_id, start_token, n_tokens.

    No token of a document is taken more often than its source's max_repeats.  Documents of a null source, of null or of empty text
    take no part; sources without documents give nothing."""
    blocks = cut_lineage(blocks_of(_sized(documents, vocabulary), block_tokens))
    return draw_slots(plan(blocks, targets)).join(blocks, ["source", "block_no"]).select("mix_id", "shard_id", "slot_key", "source", "block_no", "repeat_no", "doc_id", "start_token", "n_tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share (of all named sources, summing to 1), n_tokens, actual_share and repeats used, for every
    named source; one that lacks documents has 0 tokens."""
    every = Window.partitionBy("mix_id")
    named = targets.filter("target_share > 0 and source is not null").groupBy("mix_id", clean_source("source").alias("source")).agg(F.sum("target_share").alias("_t"))
    named = named.withColumn("target_share", F.col("_t") / F.sum("_t").over(every))
    got = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("_n"), (F.max("repeat_no") + 1).alias("_r"))
    out = named.join(got, ["mix_id", "source"], "left").withColumn("n_tokens", F.coalesce("_n", F.lit(0)))
    return out.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), "n_tokens", F.round(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(every), F.lit(0)), 6).alias("actual_share"), F.coalesce("_r", F.lit(0)).alias("repeats_used"))
