"""Problem 6: items packed into containers of permitted capacities, by variable-capacity best fit.

Items above the capacity fill whole containers by themselves and leave a rest; rests and all other items are spread over shards of
bounded size, so that no task ever packs more than some ``SHARD_ITEMS`` of them; what a shard leaves over is at most a few containers.  In a shard, items go largest first into the open container with the least
sufficient space; where none has, the permitted capacity is opened that leaves least unused given the items still to come.
In the end every container shrinks to the smallest permitted capacity that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm.tokens import VOCABULARY, count_tokens
from coderill.session import cut_lineage, spread

SHARD_ITEMS = 20_000
MAX_PACKS = 64


def best_fit(sizes: np.ndarray, permitted: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Container number and offset in it of every item, and the capacity of every container.

    No size may exceed the largest capacity; items of size 0 go where they take nothing."""
    order = np.argsort(-sizes, kind="stable")
    ascending = np.sort(sizes)
    sums = np.concatenate([[0], np.cumsum(ascending)])
    left_to_place = int(sums[-1])
    free_of: dict[int, list[int]] = {}
    mask, used, given = 0, [], []
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for item in order.tolist():
        size = int(sizes[item])
        left_to_place -= size
        fits = mask >> size
        if fits:
            gap = (fits & -fits).bit_length() - 1
            free = size + gap
            k = free_of[free].pop()
            if not free_of[free]:
                mask &= ~(1 << free)
        else:
            best = None
            for capacity in permitted:
                if capacity >= size:
                    gap_if = capacity - size
                    # the items still to come are the smallest ones; those that fit the gap may fill it
                    coming = min(left_to_place, int(sums[np.searchsorted(ascending, gap_if, side="right")]))
                    cost = (max(0, gap_if - coming), -capacity)
                    if best is None or cost < best[0]:
                        best = (cost, capacity)
            k, gap = len(used), best[1] - size
            used.append(0)
            given.append(best[1])
        bins[item], offsets[item] = k, used[k]
        used[k] += size
        if gap not in free_of or not free_of[gap]:
            free_of[gap] = []
            mask |= 1 << gap
        free_of[gap].append(k)
    ladder = sorted(permitted)
    return bins, offsets, [next(c for c in ladder if c >= u) for u in used]


def pack_items(items: DataFrame, packs: DataFrame, key: str, size: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every item in a container of every pack: pack_id, container_id, capacity_tokens, key, piece_no, start_token, n_tokens,
    container_offset.

    ``packs`` has pack_id and capacity_tokens; a pack may use its own capacity and every smaller one in the table.
    Items above the pack's capacity are cut into pieces of that capacity, all others stay whole; containers that a piece
    fills have negative numbers.  Items of null size
    are left out; those of size 0 are placed.  Repeated keys are items of their own.  Packs without a positive
    capacity give no rows."""
    caps = [(r.pack_id, int(r.capacity_tokens)) for r in packs.filter("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().limit(MAX_PACKS + 1).collect()]
    if len(caps) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs in one call")
    ladder = sorted({c for _, c in caps})
    sized = items.filter(F.col(size).isNotNull()).select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"))
    shards = max(1, -(-sized.count() // shard_items))
    # row numbers are stable because the sizes have been written before
    sharded = sized.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    offer = "array<struct<pack_id:bigint,capacity_tokens:int,_permitted:array<int>>>"
    offers = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity_tokens"), F.array(*[F.lit(x) for x in ladder if x <= c]).alias("_permitted")) for p, c in caps]).cast(offer)
    wanted = sharded.withColumn("_o", F.explode(offers)).select("_key", "_size", "_shard", "_o.*", F.floor(F.col("_size") / F.col("capacity_tokens")).cast("int").alias("_whole"))
    whole = wanted.filter("_whole > 0").select("pack_id", "capacity_tokens", "_key", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("piece_no"))
    start = lambda no: F.col(no) * F.col("capacity_tokens").cast("long")
    full = whole.select(
        "pack_id", (-1 - F.monotonically_increasing_id()).alias("container_id"), "capacity_tokens", "_key", "piece_no", start("piece_no").alias("start_token"), F.col("capacity_tokens").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("container_offset")
    )
    rest = wanted.select("pack_id", "_permitted", "_key", "_shard", F.col("_whole").alias("_piece"), start("_whole").alias("_start"), (F.col("_size") - start("_whole")).alias("_n"))
    cut = rest.filter("_n > 0 or _piece = 0")
    key_type = items.schema[key].dataType.simpleString()
    schema = f"pack_id long, container_id long, capacity_tokens int, _key {key_type}, piece_no int, start_token long, n_tokens long, container_offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_n", "_key", "_piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, capacity = best_fit(rows["_n"].to_numpy(), [int(c) for c in rows["_permitted"].iloc[0]])
        return pd.DataFrame(
            {
                "pack_id": rows["pack_id"].to_numpy(), "container_id": (int(rows["_shard"].iloc[0]) << 32) + bins, "capacity_tokens": np.array(capacity, dtype=np.int32)[bins], "_key": rows["_key"].to_numpy(),
                "piece_no": rows["_piece"].to_numpy(), "start_token": rows["_start"].to_numpy(), "n_tokens": rows["_n"].to_numpy(), "container_offset": offsets,
            }
        )

    packed = cut.groupBy("pack_id", "_shard").applyInPandas(pack, schema)
    return full.unionByName(packed).withColumnRenamed("_key", key)


def pack_documents(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack_items` for documents sized in tokens; documents with a null text are left out."""
    sized = cut_lineage(spread(documents.select("doc_id", "text")).select("doc_id", count_tokens("text", vocabulary).alias("n")))
    return pack_items(sized, packs, "doc_id", "n")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, capacity after shrinking and filled share of every pack."""
    one = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    return one.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("c").alias("capacity"), F.round(F.sum("n") / F.sum("c"), 6).alias("filled_share"))
