"""Lexical and vector retrieval: postings, BM25, hashed embeddings, exact cosine search, weighted fusion."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from coderill.functions.text import code_tokens, djb2, singular, vocabulary_tokens

K1, B = 1.2, 0.75
# Sixteen concepts and their terms, a pair of dimensions each.
CONCEPTS = [
    ("auth_security", "auth login token jwt verify password credential mfa authenticate bearer session oauth"),
    ("database_storage", "database connection db db_url sql query table store repository connect schema entity"),
    ("network_http", "middleware request response headers dispatch authorization handler route api http fetch axios endpoint"),
    ("ml_computation", "predict prediction model inference dataset features train classifier regression estimator calculate"),
    ("crypto_hashing", "crypto hash salt hmac sha256 secret signature sign digest encrypt decrypt"),
    ("device_hardware", "device bluetooth hub settings deeplink pairing hardware beacon adapter sensor peripheral"),
    ("error_handling", "error exception catch raise try throw fault fail fallback validationerror reject"),
    ("audit_logging", "audit log security_event logging logger trace events monitor record debug console"),
    ("config_environment", "config settings env environment debug host port url parameter options constants"),
    ("async_concurrency", "async await promise then observable stream event emit listen subscribe channel"),
    ("data_parsing", "load read csv parse json dataset records file stream import_data serialize"),
    ("initialization", "init initialize bootstrap startup main start lifecycle setup index app"),
    ("class_architecture", "class base inherit subclass mixin constructor prototype extends implements interface"),
    ("call_graph", "call caller callee calls invoke execute run pipeline dispatch forward"),
    ("user_management", "user username account profile role scopes permissions admin tenant member"),
    ("validation_check", "validate_token validate validation check valid expiry authentic assert verify schema"),
]


def postings_of(items: DataFrame, key: str, text: str) -> DataFrame:
    """The tokens of every item, with blanks between them: key, words; a full vocabulary, no stop words.  Items without tokens give no row."""
    return _words(items.select(key, text), text).filter("words <> ''")


def _words(items: DataFrame, text: str) -> DataFrame:
    """``items`` with words, the tokens of :func:`code_tokens`, instead of the text; in Python, which takes a tenth of the time of the expression.
    A column ``tokens`` of texts in lower case keeps only what the embedding reads of it, its tokens; the terms of concepts lie within them."""
    kept = items.select(*[c for c in items.columns if c != text], F.col(text).alias("words"))
    return kept.mapInArrow(_worded, kept.schema)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    camel, token = re.compile("([a-z])([A-Z])"), re.compile("[a-zA-Z0-9_]{2,}")
    read = {"words": lambda x: " ".join(token.findall(camel.sub(r"\1 \2", x))).lower() if x else "", "tokens": lambda x: " ".join(token.findall(x))}
    for b in batches:
        columns = [pa.array(map(read[name], c.to_pylist()), type=c.type) if name in read else c for name, c in zip(b.schema.names, b.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


BLOCK = (100_000, 32_768)  # fixed values: how many queries and items a cell holds


def _parts(size: int, block: int = BLOCK[1]) -> int:
    """Blocks of items: a fixed value of 12 at least, for cores to share, where these hold 1,024 items."""
    return max(1, -(-size // block), min(12, -(-size // 1024)))


def _part(by: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(parts)).cast("long")


def _hash_long(x: int) -> int:
    """Spark's hash of a long, by which rows go to partitions."""
    h = 42
    for k in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def _cell(number: Column, cells: int) -> Column:
    """The value that stands for a cell: each cell has a partition of its own, because by their numbers several would share one.  Above 1,024 cells
    chance is even enough."""
    if cells > 1024:
        return number
    found: dict[int, int] = {}
    x = 0
    while len(found) < cells:
        found.setdefault(_hash_long(x) % cells, x)
        x += 1
    return F.element_at(F.array(*[F.lit(found[i]).cast("long") for i in range(cells)]), (number + 1).cast("int"))


def item_cells(items: DataFrame, key: str, grid: tuple[int, int]) -> DataFrame:
    """``items`` in the cells of a grid of blocks of queries and of items.  There are as many partitions as cells, because their work does not go by
    their bytes.  Used twice in a plan, it is shuffled once."""
    return _placed(items.withColumn("_part", _part(key, grid[1])), grid)


def _placed(parted: DataFrame, grid: tuple[int, int]) -> DataFrame:
    q_parts, v_parts = grid
    every = F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("_block")
    return parted.select("*", every).withColumn("_cell", _cell(F.col("_block") * v_parts + F.col("_part"), q_parts * v_parts)).repartition(q_parts * v_parts, "_cell")


PACK = 16 << 20  # fixed value: bytes of rows that are packed together


ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(t: pa.Table, bags: tuple[str, ...] = ()) -> bytes:
    """Compressed as a whole, because columns repeat one another; the size comes first.  Of the columns ``bags``, words with blanks between them,
    how often each word occurs is kept, but not their order."""
    sink = pa.BufferOutputStream()
    for part in (t.drop_columns([*bags]), *[_bag(t[c].combine_chunks(), c) for c in bags]):
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def _bag(texts: pa.Array, column: str) -> pa.Table:
    """Words by their number, frequent ones first, as differences within a text: mostly small numbers, the bytes of which are kept apart."""
    split = pc.split_pattern(texts.fill_null(""), " ")
    words = split.flatten().dictionary_encode()
    codes, rows = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    blank = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    codes, rows = (x[~blank[codes]] for x in (codes, rows))
    often = np.bincount(codes, minlength=len(blank))
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    place = np.zeros(len(blank), np.int64)
    place[order] = np.arange(len(order))
    rows, codes = np.divmod(np.sort(rows * max(len(order), 1) + place[codes]), max(len(order), 1))
    less = np.where(np.r_[False, rows[1:] == rows[:-1]][: len(rows)], np.r_[0, codes[:-1]][: len(codes)], 0)
    plain = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (codes - less, np.bincount(rows, minlength=len(texts)))]
    return pa.table({"terms": ["\n".join(words.dictionary.take(pa.array(order)).to_pylist())], "codes": plain[:1], "sizes": plain[1:]}).replace_schema_metadata({"column": column})


def _packs(t: pa.Table, to: np.ndarray, by: str, bags: tuple[str, ...] = ()) -> pa.Table:
    """The rows of ``t`` by where they go, a pack for each."""
    order = np.argsort(to, kind="stable")
    t, to = t.take(pa.array(order)).combine_chunks(), to[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    packs = [_pack(t.slice(a, b - a), bags) for a, b in zip(starts, np.r_[starts[1:], len(to)])]
    return pa.table({by: pa.array(to[starts], pa.int64()), "_pack": pa.array(packs, pa.binary())})


def _opened(packs: Iterable[pa.Scalar]) -> tuple[pa.Table, dict[str, list[str]]]:
    """The rows of packs.  Columns that are bags have lists of numbers of words, in any order; their words come second."""
    rows: list[pa.Table] = []
    words: dict[str, list[pa.DictionaryArray]] = {}
    sizes: dict[str, list[np.ndarray]] = {}
    for x in packs:
        raw = _raw(x)
        rows.append(pa.ipc.open_stream(raw).read_all())
        while raw.tell() < raw.size():
            bag = pa.ipc.open_stream(raw).read_all()
            column = bag.schema.metadata[b"column"].decode()
            less, lengths = (np.frombuffer(bag[c][0].as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64) for c in ("codes", "sizes"))
            total = np.cumsum(less)
            before = np.r_[0, total][np.cumsum(lengths) - lengths]
            codes = total - np.repeat(before, lengths)
            terms = bag["terms"][0].as_py()
            words.setdefault(column, []).append(pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), pa.array(terms.split("\n") if terms else [], pa.string())))
            sizes.setdefault(column, []).append(lengths)
    t, terms = pa.concat_tables(rows), {}
    for column, parts in words.items():
        one = pa.chunked_array(parts).unify_dictionaries()
        terms[column] = one.chunk(0).dictionary.to_pylist()
        ends = np.r_[0, np.cumsum(np.concatenate(sizes[column]))].astype(np.int32)
        t = t.append_column(column, pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([c.indices for c in one.chunks])))
    return t, terms


def _raw(pack: pa.Scalar) -> pa.BufferReader:
    return pa.BufferReader(ZSTD.decompress(pack.as_buffer()[8:], int.from_bytes(pack.as_buffer()[:8].to_pybytes(), "little")))


def _unpacked(packs: Iterable[pa.Scalar]) -> pa.Table:
    """The rows of packs, without their bags."""
    return pa.concat_tables(pa.ipc.open_stream(_raw(x)).read_all() for x in packs)


def _tokens(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the tokens of a bag, ascending, and the numbers of their words."""
    lists = t[column].combine_chunks()
    return np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()


def _in_packs(parted: DataFrame, bags: tuple[str, ...] = (), read: Callable | None = None) -> DataFrame:
    """The rows in packs by ``_part``.  ``read`` is run over the batches before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in read(batches) if read else batches:
            held.append(b)
            size += b.nbytes
            if size > PACK:
                yield from _packs(pa.Table.from_batches(held), np.concatenate([x.column("_part").to_numpy() for x in held]), "_part", bags).to_batches()
                held, size = [], 0
        if held:
            yield from _packs(pa.Table.from_batches(held), np.concatenate([x.column("_part").to_numpy() for x in held]), "_part", bags).to_batches()

    return parted.mapInArrow(run, "_part long, _pack binary")


def packed_cells(items: DataFrame, key: str, grid: tuple[int, int], read: Callable | None = None, bags: tuple[str, ...] = ()) -> DataFrame:
    """``items`` in cells as :func:`item_cells` has them, but in compressed packs of many rows, which :func:`_opened` reads: their texts take a third of
    the disk, and half of that as ``bags`` of words.  ``read`` is run over the batches before."""
    return _placed(_in_packs(items.withColumn("_part", _part(key, grid[1])), bags, read), grid)


def meet(queries: DataFrame, placed: DataFrame, query_key: str, grid: tuple[int, int], run: Callable, schema: StructType) -> DataFrame:
    """``run`` over every pair of a block of queries and a block of items that :func:`item_cells` has placed, as Arrow tables; it returns a row per
    query, with arrays.  Both blocks meet by an equi-join on the cell."""
    first, *rest = schema.fields
    best = _cogrouped(queries, placed, query_key, grid).applyInArrow(run, StructType([first] + [StructField(f.name, ArrayType(f.dataType)) for f in rest])).repartition(first.name)
    return best.select(first.name, F.explode(F.arrays_zip(*[f.name for f in rest])).alias("_z")).select(first.name, *[F.col("_z")[f.name].alias(f.name) for f in rest])


def _cogrouped(queries: DataFrame, placed: DataFrame, query_key: str, grid: tuple[int, int]) -> PandasCogroupedOps:
    q_parts, v_parts = grid
    every = F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1))).alias("_other")
    part = F.col("_part") if "_part" in queries.columns else _part(query_key, q_parts)
    left = queries.select("*", every).withColumn("_cell", _cell(part * v_parts + F.col("_other"), q_parts * v_parts)).drop("_other").repartition(q_parts * v_parts, "_cell")
    return left.groupBy("_cell").cogroup(placed.groupBy("_cell"))


def meet_packed(queries: DataFrame, placed: DataFrame, grid: tuple[int, int], run: Callable, schema: StructType, k: int) -> DataFrame:
    """:func:`meet` by ``asked`` over the cells of :func:`packed_cells`: what may be among the k best over all cells, by words and by meaning, with scores of six
    digits.  ``run`` gets the questions, the items and the words of their bags; it returns arrays of a key, the score in millionths and, where ``schema`` has them, bits.

    What the cells found is packed by where its questions are gathered, so it takes a third of the disk; questions go to every cell in packs."""
    cells, arrow = grid[0] * grid[1], to_arrow_schema(schema)

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"_to": pa.array([], pa.int64()), "_pack": pa.array([], pa.binary())})
        found = run(_unpacked(left["_pack"]), *_opened(right["_pack"]))
        return _packs(found, np.array([zlib.crc32(x.encode()) % cells for x in found["asked"].to_pylist()], np.int64), "_to")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [x for b in batches for x in b.column("_pack")]
        if not packs:
            return
        t = _unpacked(packs).combine_chunks()
        asked = t["asked"].combine_chunks().dictionary_encode()
        keys, millionths, *bits = [t[c].combine_chunks() for c in schema.names[1:]]
        of = np.repeat(asked.indices.to_numpy(), keys.value_lengths().to_numpy())
        scores, bits = millionths.flatten().to_numpy() / 1e6, [x.flatten().to_numpy() for x in bits]
        total, kind = (BOOSTS[bits[0] & (SYMBOL_MATCH | PATH_MATCH)] * scores, of * 2 + (bits[0] & MEANING > 0)) if bits else (scores, of)
        if bits:
            total = np.where(bits[0] & MEANING > 0, scores, total)
        order = np.lexsort((-total, kind))
        total, kind = total[order], kind[order]
        starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]][: len(kind)])
        sizes = np.diff(np.r_[starts, len(kind)])
        least = np.where(sizes > k, total[np.minimum(starts + k, starts + sizes) - 1], -np.inf) - 2e-6  # rounding moves no score by more
        kept = order[total >= np.repeat(least, sizes)]
        columns = [asked.dictionary.take(pa.array(of[kept])), keys.flatten().take(pa.array(kept)), pa.array(scores[kept]), *[pa.array(x[kept]) for x in bits]]
        yield from pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow).to_batches(65_536)

    asked = _in_packs(queries.withColumn("_part", _part("asked", grid[0])))
    found = _cogrouped(asked, placed, "asked", grid).applyInArrow(sent, "_to long, _pack binary").withColumn("_home", _cell(F.col("_to"), cells))
    return found.repartition(cells, "_home").select("_pack").mapInArrow(gather, schema)


def _millionths(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5).astype(np.int64)


def in_cells(queries: DataFrame, items: DataFrame, query_key: str, key: str, sizes: tuple[int, int], run: Callable, schema: StructType, block: tuple[int, int] = BLOCK) -> DataFrame:
    """:func:`meet` of all queries and all items.  ``sizes`` are the numbers of rows of both."""
    grid = max(1, -(-sizes[0] // block[0])), _parts(sizes[1], block[1])
    return meet(queries, item_cells(items, key, grid), query_key, grid, run, schema)


def _packed(schema: StructType, millionths: bool = False) -> pa.Schema:
    """How cells return their rows: a query's values as arrays, so that less is shuffled."""
    kind = lambda f: LongType() if millionths and f.name == "score" else f.dataType
    return to_arrow_schema(StructType([schema.fields[0]] + [StructField(f.name, ArrayType(kind(f))) for f in schema.fields[1:]]))


def _numbers(right: pa.Table, key: str) -> np.ndarray:
    """The numbers of a cell's items: its part, and the place of the key among those of the part.  Long keys leave no cell."""
    keys = right[key].to_pylist()
    out = np.empty(len(keys), np.int64)
    out[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return out + (right["_part"].to_numpy() << 32)


def _numbered(items: DataFrame, key: str, size: int) -> DataFrame:
    """``items``, of which each has one row, with the numbers that :func:`_numbers` gives them."""
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return items.filter(F.col(key).isNotNull()).withColumn("_part", _part(key, _parts(size))).withColumn("number", F.shiftleft("_part", 32) + place).drop("_part")


def _named(best: DataFrame, numbered: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """``best`` (number, score and ``by``) with what ``numbered`` has for the numbers, ranked for each value of ``by``.  ``best`` has equal scores, as
    keys were not known to it."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col(key))
    return best.join(numbered, "number").drop("number").repartition("asked").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def at_least(scores: np.ndarray, k: int) -> float:
    """A lower bound of the k-th best score, near it: the k-th best among the best of 128 stretches; below all scores where there are fewer."""
    if len(scores) <= 1024 or k > 128:
        return np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
    even = len(scores) // 128 * 128
    return np.partition(scores[:even].reshape(128, -1).max(axis=1), -k)[-k]


def few_best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of scores that can be among the k best once they are rounded to six digits: equal scores count up to k times, smaller keys first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 2e-6)
    near = near[np.lexsort((keys[near], -scores[near]))]
    s = scores[near]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return near[np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)])) < k]


def contained(needles: list[str], texts: list[str]) -> Iterator[list[int]]:
    """For each text the numbers of the needles that occur in it; needles are distinct and not empty."""
    number = {x: i for i, x in enumerate(needles)}
    # needles of one or two characters, of three to seven and longer ones are found by their first one, three or eight characters
    tiers: dict[int, dict[str, set[int]]] = {8: {}, 3: {}, 1: {}}
    for x in needles:
        head = next(n for n in tiers if n <= len(x))
        tiers[head].setdefault(x[:head], set()).add(len(x))
    for t in texts:
        met = set()
        for head, lengths in tiers.items():
            if lengths:
                for at, found in enumerate(map(lengths.get, [t[i : i + head] for i in range(len(t) - head + 1)])):
                    if found:
                        for n in found:
                            i = number.get(t[at : at + n])
                            if i is not None:
                                met.add(i)
        yield sorted(met)


def _places(values: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct values that are not empty, and where each stands."""
    at: dict[str, list[int]] = {}
    for i, x in enumerate(values):
        if x:
            at.setdefault(x, []).append(i)
    return list(at), [np.array(x) for x in at.values()]


class _Lists:
    """A row of equally long arrays for each query, as an Arrow table."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.asked, self.parts, self.ends = schema, [], [[] for _ in schema.names[1:]], [0]

    def add(self, asked: str, *values: np.ndarray) -> None:
        self.asked.append(asked)
        self.ends.append(self.ends[-1] + len(values[0]))
        for column, x in zip(self.parts, values):
            column.append(x)

    def table(self) -> pa.Table:
        if not self.asked:
            return self.schema.empty_table()
        ends = pa.array(self.ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), f.type.value_type)) for x, f in zip(self.parts, list(self.schema)[1:])]
        return pa.table([pa.array(self.asked, self.schema[0].type), *lists], schema=self.schema)


SYMBOL_MATCH, PATH_MATCH, MEANING = 1, 2, 4  # what is known of a hit, as bits
SYMBOL_BOOST, PATH_BOOST = 1.8, 1.3
BOOSTS = np.array([1.0, SYMBOL_BOOST, PATH_BOOST, SYMBOL_BOOST * PATH_BOOST])


class _Words:
    """The words of a cell's ``n`` items, to be asked for by queries.  ``rows`` are the numbers of the items, from 0, of each token, ``codes`` that of its word
    among ``words``."""

    def __init__(self, terms: list[list[dict]], rows: np.ndarray, codes: np.ndarray, words: list[str], n: int, avgdl: float):
        vocabulary: dict[str, int] = {}
        self.terms = [[(vocabulary.setdefault(t["term"], len(vocabulary)), t["weight"]) for t in x or ()] for x in terms]
        dl = np.bincount(rows, minlength=n).astype(float)
        known = np.array([vocabulary.get(x, -1) for x in words], np.int64)[codes]
        rows, known = rows[known >= 0], known[known >= 0]
        codes, tf = np.unique(known * n + rows, return_counts=True)
        self.item = codes % max(n, 1)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[self.item] / avgdl))
        self.ends = np.searchsorted(codes // max(n, 1), np.arange(len(vocabulary) + 1)).tolist()
        self.n = n

    def scored(self, q: int) -> np.ndarray:
        """The scores of all items for query ``q``, above 0 where one holds a word of it."""
        spans = [(slice(self.ends[t], self.ends[t + 1]), weight) for t, weight in self.terms[q]]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.item[x] for x, _ in spans]), np.concatenate([weight * self.part[x] for x, weight in spans]), self.n)


def _best_words(scores: np.ndarray, total: np.ndarray, bits: np.ndarray | None, keys: np.ndarray, k: int) -> np.ndarray:
    """The items that may be among the k best by ``total``, the scores boosted by ``bits``.  Rounding, before and after a boost, moves scores by less than the margin."""
    near = np.flatnonzero(total >= at_least(total, k) - 4e-6)
    near = near[scores[near] > 0]
    rounded = np.round(scores[near], 6)
    return near[few_best(rounded if bits is None else rounded * BOOSTS[bits[near]], keys[near], k)]


COUNTED = StructType([StructField("term", StringType(), False), StructField("df", LongType(), False), StructField("dl", LongType(), False)])


def _counted(key: str, cells: int) -> Callable:
    """Counts the words of a cell of packs: term, df, in how many items it occurs; with an empty term, the number of items and in dl
    that of their words.  The rows of an item count as one.  Other blocks of queries have the same
    items, so only the first block counts.  The counts are packed by where those of a term are summed."""
    schema = to_arrow_schema(COUNTED)

    def run(t: pa.Table) -> pa.Table:
        if t["_block"][0].as_py():
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["_to", "_pack"])
        t, words = _opened(t["_pack"])
        t = _last(t, key)
        rows, codes = _tokens(t, "words")
        first = np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])][: len(codes)]  # equal words of a row stand together
        met, size, items = codes[first], max(len(words["words"]), 1), np.arange(t.num_rows)
        if "_at" not in t.column_names:
            numbers: dict[object, int] = {}
            items = np.array([numbers.setdefault(x, len(numbers)) for x in t[key].to_pylist()], np.int64)
            if len(numbers) < t.num_rows:
                met = np.unique(items[rows[first]] * size + met) % size
        df = np.bincount(met, minlength=len(words["words"]))
        seen = sorted((words["words"][i], i) for i in np.flatnonzero(df).tolist())
        counts = [pa.array([*(x for x, _ in seen), ""], pa.string()), pa.array([*df[[i for _, i in seen]], len(np.unique(items[np.unique(rows)]))], pa.int64()), pa.array([0] * len(seen) + [len(rows)], pa.int64())]
        return _packed_counts(pa.table(counts, schema=schema), cells)

    return run


def _packed_counts(t: pa.Table, cells: int) -> pa.Table:
    return _packs(t, np.array([zlib.crc32(x.encode()) % cells for x in t["term"].to_pylist()], np.int64), "_to")


def _terms_asked(cells: int) -> Callable:
    """The distinct terms of questions, packed by where their counts are summed, with -1 as df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted({x for b in batches for x in b.column("terms").flatten().to_pylist() if x})
        if seen:
            yield from _packed_counts(pa.table([pa.array(seen, pa.string()), pa.array([-1] * len(seen), pa.int64()), pa.array([0] * len(seen), pa.int64())], schema=to_arrow_schema(COUNTED)), cells).to_batches()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of those terms that questions have, and of the empty term."""
    packs = [x for b in batches for x in b.column("_pack")]
    if packs:
        t = _unpacked(packs)
        terms = t["term"].combine_chunks().dictionary_encode()
        of, df, dl = terms.indices.to_numpy(), t["df"].to_numpy(), t["dl"].to_numpy()
        kept = np.zeros(len(terms.dictionary), bool)
        kept[of[df < 0]] = True
        kept |= pc.equal(terms.dictionary, "").to_numpy(zero_copy_only=False)
        sums = [np.bincount(of, x, len(kept)).astype(np.int64)[kept] for x in (np.maximum(df, 0), dl)]
        yield from pa.table([terms.dictionary.filter(pa.array(kept)), *map(pa.array, sums)], schema=to_arrow_schema(COUNTED)).to_batches()


def _last(t: pa.Table, key: str) -> pa.Table:
    """The last delivery of every item of a cell, where the rows say when they were delivered."""
    if "_at" not in t.column_names:
        return t
    at: dict[object, int] = {}
    keys, order = t[key].to_pylist(), list(zip(*(t[c].to_pylist() for c in ("_at", "_hash", "_rest"))))
    for i, x in enumerate(keys):
        if x not in at or order[at[x]] < order[i]:
            at[x] = i
    return t if len(at) == len(keys) else t.take(list(at.values()))


def _weighed(asked: DataFrame, placed: DataFrame, key: str, grid: tuple[int, int]) -> DataFrame:
    """``asked`` with the weights of its terms, repeated terms counting again, by how many of the items hold them, and the mean length of the items (avgdl).
    Both come from the words that :func:`packed_cells` has ``placed``; counts of words that nobody asks for go no further."""
    cells = grid[0] * grid[1]
    counts = placed.groupBy("_cell").applyInArrow(_counted(key, cells), "_to long, _pack binary").unionByName(asked.select("terms").mapInArrow(_terms_asked(cells), "_to long, _pack binary"))
    # both filters are of sums, so that they stay above the sums, which run once
    told = counts.withColumn("_home", _cell(F.col("_to"), cells)).repartition(cells, "_home").select("_pack").mapInArrow(_summed, COUNTED)
    totals = told.filter("dl > 0").agg(F.max("df").cast("double").alias("_n"), (F.max("dl") / F.max("df")).alias("avgdl"))
    counted = asked.select("asked", F.explode("terms").alias("term")).groupBy("asked", "term").agg(F.count("*").alias("qf"))
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weights = counted.join(told.filter("dl = 0 and df > 0").select("term", "df"), "term").crossJoin(totals).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qf") * idf).alias("weight")))).alias("terms"), F.max("avgdl").alias("avgdl"))
    return weights


def _bm25_best(postings: DataFrame, asked: DataFrame, key: str, k: int, size: int = 0) -> DataFrame:
    """asked, key, score of the items that may be among the k best.  ``asked`` has a row for each distinct question with its terms.
    ``size`` is the number of postings or more.

    Only the best of each cell leave it, so what is shuffled grows with the items and the questions, not with their pairs."""
    schema = StructType([StructField("asked", StringType()), StructField(key, postings.schema[key].dataType), StructField("score", DoubleType())])
    arrow = _packed(schema, True)

    def run(left: pa.Table, right: pa.Table, words: dict[str, list[str]]) -> pa.Table:
        numbers: dict[object, int] = {}
        right = right.filter(right[key].is_valid())
        places = np.array([numbers.setdefault(x, len(numbers)) for x in right[key].to_pylist()], np.int64)
        out, keys, asked = _Lists(arrow), np.array(list(numbers)), left["asked"].to_pylist()
        if asked and numbers:
            rows, codes = _tokens(right, "words")
            cell = _Words(left["terms"].to_pylist(), places[rows], codes, words["words"], len(numbers), left["avgdl"][0].as_py())
            for q, x in enumerate(asked):
                scores = cell.scored(q)
                best = _best_words(scores, scores, None, keys, k)
                if len(best):
                    out.add(x, keys[best], _millionths(scores[best]))
        return out.table()

    grid = max(1, -(-asked.count() // BLOCK[0])), _parts(size or postings.count())
    placed = packed_cells(postings.select(key, "words"), key, grid, bags=("words",))
    return meet_packed(_weighed(asked, placed, key, grid), placed, grid, run, schema, k)


def bm25(postings: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 10, size: int = 0) -> DataFrame:
    """The k best items per query by BM25: query_key, key, score, rank.  Ties go to the smaller key.  ``postings`` come from :func:`postings_of`;
    ``queries`` has one row per query token; repeated tokens count again.  Statistics cover all items.  Queries of the same words are answered once.
    ``size``, the number of items or more, saves counting them."""
    worded = queries.filter(F.col(query_key).isNotNull()).groupBy(query_key).agg(F.array_sort(F.collect_list("term")).alias("terms")).withColumn("asked", F.array_join("terms", " "))
    best = _bm25_best(postings, worded.select("asked", "terms").distinct(), key, k, size)
    return top_k(best, "asked", key, "score", k).join(worded.select("asked", query_key), "asked").select(query_key, key, "score", "rank")


def top_k(scored: DataFrame, query_key: str, key: str, score: str, k: int) -> DataFrame:
    """Rank within each query by score, ties by key."""
    w = Window.partitionBy(query_key).orderBy(F.desc(score), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embed_tokens(text: str) -> Column:
    """Tokens of the embedding: lower case, split at all but letters, digits and underscores, single characters dropped."""
    return F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"), lambda t: F.length(t) > 1)


def embed(items: DataFrame, key: str, text: str, digits: int = 6) -> DataFrame:
    """Sparse unit vectors of the hashed embedding with 128 dimensions: key, dim, weight.  Dimensions 0-47 count token hashes, 48-95
    trigram hashes at half weight; from 96 on each concept has two: its weight (2 for each term among the tokens, 1 for each that only
    occurs within the text) and log1p of it.  Items without tokens and concepts give no rows.

    Hashes are computed once for each distinct token, not for each of its occurrences."""
    words = items.select(key, F.explode(embed_tokens(text)).alias("token"))
    counted = words.groupBy(key, "token").agg(F.count("*").cast("double").alias("n"))
    grams = F.when(F.length("token") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1))), lambda i: F.struct((F.lit(48) + djb2(F.substring(F.col("token"), i, F.lit(3))) % 48).cast("int").alias("dim"), F.lit(0.5).alias("w"))))
    own = F.array(F.struct((djb2("token") % 48).cast("int").alias("dim"), F.lit(1.0).alias("w")))
    hashed = counted.select("token").distinct().select("token", F.when(grams.isNull(), own).otherwise(F.concat(own, grams)).alias("parts"))
    by_hash = counted.join(hashed, "token").select(key, "n", F.explode("parts").alias("p")).select(key, "p.dim", (F.col("n") * F.col("p.w")).alias("w"))
    terms = F.array(*[F.struct(F.lit(96 + 2 * c).alias("dim"), F.lit(t).alias("term")) for c, (_, words) in enumerate(CONCEPTS) for t in words.split()])
    told = lambda x: F.when(F.array_contains("_tokens", x["term"]), 2.0).when(F.contains(F.col("_low"), x["term"]), 1.0).otherwise(0.0)
    met = items.select(key, F.lower(F.col(text)).alias("_low"), embed_tokens(text).alias("_tokens")).select(key, F.explode(F.filter(F.transform(terms, lambda x: F.struct(x["dim"].alias("dim"), told(x).alias("m"))), lambda p: p["m"] > 0)).alias("p"))
    concept = met.groupBy(key, F.col("p.dim").alias("dim")).agg(F.sum("p.m").alias("m"))
    by_concept = concept.select(key, F.explode(F.array(F.struct("dim", F.col("m").alias("w")), F.struct((F.col("dim") + 1).alias("dim"), F.log1p("m").alias("w")))).alias("x")).select(key, "x.*")
    summed = by_hash.unionByName(by_concept).groupBy(key, "dim").agg(F.sum("w").alias("w"))
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return summed.join(norm, key).select(key, "dim", F.round(F.col("w") / F.col("_norm"), digits).alias("weight"))


def _cosine_best(asked: list, a: np.ndarray, keys: np.ndarray, c: np.ndarray, key: str, k: int, own: bool, schema: pa.Schema) -> pa.Table:
    """The k best vectors of ``c`` for each vector of ``a``.  Products in single precision tell which come into question, with a margin for what
    they may be off; the scores are computed in double precision."""
    out: list[list] = [[], [], []]
    if not len(asked) or not len(keys):
        return schema.empty_table()
    ids, single = np.array(asked), c.astype(np.float32)
    lengths = np.sqrt((c * c).sum(axis=1)).max(initial=0) * np.sqrt((a * a).sum(axis=1))
    margin = 4 * a.shape[1] * np.finfo(np.float32).eps * lengths + 1e-6
    for at in range(0, len(asked), 256):
        scores = np.clip(a[at : at + 256].astype(np.float32) @ single.T, 0, 1)
        if not own:
            scores[ids[at : at + 256, None] == keys[None, :]] = -np.inf
        for i in range(len(scores)):
            near = np.flatnonzero(scores[i] >= max(at_least(scores[i], k) - margin[at + i], -1))
            exact = np.round(np.clip(c[near] @ a[at + i], 0, 1), 6)
            order = np.lexsort((keys[near], -exact))[:k]
            for column, values in zip(out, (asked[at + i], keys[near[order]], exact[order])):
                column.append(values)
    return pa.table([pa.array(x, type=f.type) for x, f in zip(out, schema)], schema=schema)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", query_key: str = "vec_id", own: bool = False, block: tuple[int, int] = (8192, 16_384)) -> DataFrame:
    """Exact search of a set of query vectors against all vectors: query_id, the vectors' key, score, rank; unless ``own``, a vector with
    the query's key takes no part.  Null vectors are left out.

    Queries and vectors are cut into blocks of ``block`` rows; a cell multiplies its blocks as matrices and sends on only its k best per query."""
    q, v = (df.filter(f"embedding is not null and {by} is not null").select(F.col(by).alias(to), "embedding") for df, by, to in ((queries, query_key, "query_id"), (vectors, key, key)))
    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField(key, v.schema[key].dataType), StructField("score", DoubleType())])
    arrow = _packed(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = (np.array(t["embedding"].to_pylist(), dtype=np.float64) for t in (left, right))
        return _cosine_best(left["query_id"].to_pylist(), a, np.array(right[key].to_pylist()), c, key, k, own, arrow)

    return top_k(in_cells(q, v, "query_id", key, (q.count(), v.count()), run, schema, block), "query_id", key, "score", k)


_GRAMS: dict[str, int] = {}  # dimensions of trigrams, of which there are 37 ** 3


def _djb2(x: str) -> int:
    h = 5381
    for c in x:
        h = (h * 33 + ord(c) + 2147483648) % 4294967296 - 2147483648
    return abs(h)


def embed_texts(texts: list[str], digits: int = 12) -> np.ndarray:
    """The vectors of :func:`embed` as rows of a matrix; a text without tokens and concepts gives zeros.  Texts are in lower case."""
    token = re.compile("[a-z0-9_]{2,}")
    numbers: dict[str, int] = {}
    ids, lengths = [], []
    for text in texts:
        found = token.findall(text)
        lengths.append(len(found))
        ids += [numbers.setdefault(t, len(numbers)) for t in found]
    return embed_tokens_of(list(numbers), np.array(ids, np.int32), lengths, digits)


def embed_tokens_of(words: list[str], ids: np.ndarray, lengths: Iterable[int], digits: int = 12) -> np.ndarray:
    """The same of texts by their tokens: the numbers of their ``words``, and how many each text has.  A concept's term that occurs within a text
    lies within one of its tokens.

    Sums of counts and halves are exact in any order."""
    dims: list[int] = []
    starts = [0]
    for t in words:
        dims.append(_djb2(t) % 48)
        for x in map(str.__add__, map(str.__add__, t, t[1:]), t[2:]):
            d = _GRAMS.get(x)
            if d is None:
                d = _GRAMS[x] = 48 + _djb2(x) % 48
            dims.append(d)
        starts.append(len(dims))
    lengths = np.array(lengths, np.int64)
    each, first, ends, n = np.array(dims, np.int64), np.array(starts, np.int64), np.r_[0, np.cumsum(lengths)], len(lengths)
    holders, terms, whole, concept = _holders(words)
    at = np.searchsorted(holders, np.arange(len(words) + 1))
    out = np.zeros(n * 128)
    for i in range(0, n, 1024):  # a row for each part of each token needs memory
        j = min(i + 1024, n)
        tokens, rows = ids[ends[i] : ends[j]], np.repeat(np.arange(j - i), lengths[i:j])
        place, sizes = _spans(first, tokens)
        dim = each[place]
        out[i * 128 : j * 128] = np.bincount(np.repeat(rows, sizes) * 128 + dim, np.where(dim < 48, 1.0, 0.5), (j - i) * 128)
        place, sizes = _spans(at, tokens)
        met, code = np.zeros((j - i) * len(concept)), np.repeat(rows, sizes) * len(concept) + terms[place]
        met[code] = 1
        met[code[whole[place]]] = 2
        out[i * 128 : j * 128].reshape(j - i, 128)[:, 96::2] = met.reshape(j - i, -1) @ (concept[:, None] == np.arange(16))
    out = out.reshape(n, 128)
    out[:, 97::2] = np.log1p(out[:, 96::2])
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.round(out / np.where(norm > 0, norm, 1), digits)


def _spans(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from ``starts`` of each of ``of`` to the next start, one after the other, and how many each has."""
    sizes = starts[of + 1] - starts[of]
    return np.arange(sizes.sum()) + np.repeat(starts[of] - np.cumsum(sizes) + sizes, sizes), sizes


def _holders(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words hold which terms of concepts: the words' numbers, ascending, those of the terms, whether the word is the term; and the concept of each term."""
    terms = [(c, t) for c, (_, x) in enumerate(CONCEPTS) for t in x.split()]
    text, found = "\n".join(words), []
    for p, (_, t) in enumerate(terms):
        at = text.find(t)
        while at >= 0:
            found.append((at, p, len(t)))
            at = text.find(t, at + 1)
    at, p, size = np.array(sorted(found), np.int64).reshape(-1, 3).T
    lengths = np.array([len(x) for x in words], np.int64)
    word = np.searchsorted(np.cumsum(lengths + 1), at, "right")
    return word, p, lengths[word] == size, np.array([c for c, _ in terms])


def _nearest(a: np.ndarray, c: np.ndarray, single: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors ``a`` the k best of the unit vectors ``c`` (``single`` in single precision), with scores above ``least``: rows of a, ascending,
    rows of c and scores.  As in :func:`_cosine_best` a margin covers what single precision may be off; equal scores go to the smaller row of c."""
    scores = a.astype(np.float32) @ single.T
    n = scores.shape[1]
    even = n // 128 * 128
    if n <= 1024 or k > 128:
        bound = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(a), -1, np.float32)
    else:
        bound = np.partition(scores[:, :even].reshape(len(a), 128, -1).max(axis=2), 128 - k, axis=1)[:, 128 - k]
    margin = 8 * a.shape[1] * np.finfo(np.float32).eps + 1e-6
    rows, items = np.divmod(np.flatnonzero(scores >= np.maximum(bound - margin, least - margin)[:, None]), n)
    products = [np.einsum("ij,ij->i", a[rows[i : i + 65_536]], c[items[i : i + 65_536]]) for i in range(0, len(rows), 65_536)]
    exact = np.round(np.clip(np.concatenate([*products, np.zeros(0)]), 0, 1), 6)
    order = np.lexsort((items, -exact, rows))
    rows, items, exact = rows[order], items[order], exact[order]
    starts = np.searchsorted(rows, np.arange(len(a)))
    kept = (np.arange(len(rows)) - starts[rows] < k) & (exact > least)
    return rows[kept], items[kept], exact[kept]


def meaning_top_k(items: DataFrame, queries: DataFrame, key: str, text: str, k: int, size: int) -> DataFrame:
    """:func:`cosine_top_k` over the embeddings of texts: asked, key, score, rank.  ``queries`` has asked and low, ``size`` is the number of items.
    Texts go to the cells and are embedded there, because they are smaller than vectors."""
    lower = items.select(key, F.coalesce(F.lower(text), F.lit("")).alias("low")).filter(f"{key} is not null")
    schema = StructType([StructField("asked", StringType()), StructField("number", LongType()), StructField("score", DoubleType())])
    arrow = _packed(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = (embed_texts(t["low"].to_pylist()) for t in (left, right))
        qs, vs = a.any(axis=1), c.any(axis=1)
        return _cosine_best(left.filter(pa.array(qs))["asked"].to_pylist(), a[qs], _numbers(right, key)[vs], c[vs], key, k, True, arrow)

    best = in_cells(queries.select("asked", "low"), lower, "asked", key, (queries.count(), size), run, schema)
    kept = best.withColumn("_r", F.rank().over(Window.partitionBy("asked").orderBy(F.desc("score")))).filter(F.col("_r") <= k).drop("_r")
    return _named(kept, _numbered(lower.select(key), key, size), ["asked"], key, k)


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """The last delivery of every chunk with what searches need, as :func:`delivered_chunks` has it of all deliveries."""
    rows = delivered_chunks(chunks)
    kept = [c for c in rows.columns if c not in ("chunk_id", "_at", "_hash", "_rest")]
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*kept), F.struct("_at", "_hash", "_rest")).alias("c"))
    return last.select("chunk_id", *[F.col("c")[c].alias(c) for c in kept])


def delivered_chunks(chunks: DataFrame) -> DataFrame:
    """Every delivery of every chunk with what searches need: the text of the lexical index (path, symbol, docstring, source) and that
    of the embedding (symbol, docstring and the first 300 characters of the source).  The last one has the largest (_at, _hash, _rest)."""
    return chunks.select(
        "chunk_id", "repo_id", F.lower("file_path").alias("path"), F.lower("file_language").alias("language"), F.lower(F.coalesce("symbol_name", F.lit(""))).alias("symbol"),
        F.concat_ws(" ", "file_path", "symbol_name", "docstring", "source_text").alias("lexical_text"), F.concat_ws(" ", "symbol_name", "docstring", F.left("source_text", F.lit(300))).alias("semantic_text"),
        F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**63))).alias("_at"), F.xxhash64("source_text").alias("_hash"), F.xxhash64("repo_id", "file_path", "file_language", "symbol_name", "docstring").alias("_rest"),
    )


def _texts(queries: DataFrame) -> DataFrame:
    """The distinct texts of the queries: asked, low, terms."""
    return queries.filter("query_text is not null").select(F.col("query_text").alias("asked")).distinct().select("asked", F.lower("asked").alias("low"), code_tokens("asked").alias("terms"))


def _chunk_cell(k: int, meaning: bool, schema: pa.Schema) -> Callable:
    """The k best chunks of a cell for each query by words and, with ``meaning``, by the embedding: numbers, scores in millionths and bits.  By words,
    the score is not yet boosted."""

    def run(left: pa.Table, right: pa.Table, words: dict[str, list[str]]) -> pa.Table:
        right = _last(right, "chunk_id")
        right = right.filter(right["chunk_id"].is_valid())
        numbers, asked, low = _numbers(right, "chunk_id"), left["asked"].to_pylist(), left["low"].to_pylist()
        right, numbers = right.take(pa.array(np.argsort(numbers))), np.sort(numbers)
        out, n = _Lists(schema), len(numbers)
        if not asked or not n:
            return out.table()
        (symbols, of_symbol), (paths, of_path) = _places(right["symbol"].to_pylist()), _places(right["path"].to_pylist())
        texts = sorted(set(low) - {""})
        by_symbol: dict[str, set[int]] = {t: set(x) for t, x in zip(texts, contained(symbols, texts))}
        by_path: dict[str, list[int]] = {t: [] for t in texts}
        for s, x in enumerate(contained(texts, symbols)):
            for t in x:
                by_symbol[texts[t]].add(s)
        for p, x in enumerate(contained(texts, paths)):
            for t in x:
                by_path[texts[t]].append(p)
        avgdl = next((x for x in left["avgdl"].to_pylist() if x is not None), 1.0)
        cell = _Words(left["terms"].to_pylist(), *_tokens(right, "words"), words["words"], n, avgdl)
        vectors = np.zeros((0, 128))
        if meaning:
            rows, codes = _tokens(right, "tokens")
            vectors = embed_tokens_of(words["tokens"], codes, np.bincount(rows, minlength=n))
        at = np.flatnonzero(vectors.any(axis=1))
        vectors = vectors[at]
        single = vectors.astype(np.float32)
        bits = np.zeros(n, np.int8)
        for first in range(0, len(asked), 256):
            ends = np.zeros(257, np.int64)
            if len(vectors):
                a = embed_texts(low[first : first + 256])
                rows, near, close = _nearest(a, vectors, single, k, 0.05)
                known = a.any(axis=1)[rows]
                rows, near, close = rows[known], at[near[known]], close[known]
                ends = np.searchsorted(rows, np.arange(257))
            for q in range(first, min(first + 256, len(asked))):
                scores = total = cell.scored(q)
                span = slice(ends[q - first], ends[q - first + 1])
                marked = [of_symbol[s] for s in by_symbol.get(low[q], ())], [of_path[p] for p in by_path.get(low[q], ())]
                for bit, places in zip((SYMBOL_MATCH, PATH_MATCH), marked):
                    if places:
                        bits[np.concatenate(places)] |= bit
                if any(marked):
                    at_bits = np.concatenate([*marked[0], *marked[1]])
                    total = scores.copy()
                    total[at_bits] = scores[at_bits] * BOOSTS[bits[at_bits]]
                best = _best_words(scores, total, bits, numbers, k)
                found, of = bits[best], (bits[near[span]] & PATH_MATCH | MEANING) if len(vectors) else np.zeros(0, np.int8)
                for places in marked:
                    if places:
                        bits[np.concatenate(places)] = 0
                if not len(best) and span.start == span.stop:
                    continue
                if len(vectors):
                    out.add(asked[q], np.concatenate([numbers[best], numbers[near[span]]]), _millionths(np.concatenate([scores[best], close[span]])), np.concatenate([found, of]))
                else:
                    out.add(asked[q], numbers[best], _millionths(scores[best]), found)
        return out.table()

    return run


def _chunk_best(items: DataFrame, texts: DataFrame, k: int, meaning: bool, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """asked, number, score and bits of the chunks that may be among the k best by words and, with ``meaning``, by the embedding; and number, chunk_id and
    ``columns`` of every chunk.  ``items`` come from :func:`delivered_chunks` or :func:`latest_chunks`.

    Words, meaning and names share a grid: a chunk's texts are shuffled once, as the tokens of each; its last delivery is found in its cell."""
    size, schema = items.select("chunk_id").count(), StructType([StructField("asked", StringType()), StructField("number", LongType()), StructField("score", DoubleType()), StructField("bits", ByteType())])
    order = [c for c in ("_at", "_hash", "_rest") if c in items.columns]
    low = [F.coalesce(F.lower("semantic_text"), F.lit("")).alias("tokens")] if meaning else []
    grid = max(1, -(-texts.count() // BLOCK[0])), _parts(size)
    read = items.select("chunk_id", *order, "path", "symbol", *[c for c in columns if c != "symbol"], *low, F.col("lexical_text").alias("words"))
    placed = packed_cells(read, "chunk_id", grid, _worded, ("words", "tokens") if meaning else ("words",))
    left = texts.select("asked", "low").join(_weighed(texts, placed, "chunk_id", grid), "asked", "left" if meaning else "inner")
    best = meet_packed(left, placed, grid, _chunk_cell(k, meaning, _packed(schema, True)), schema, k)
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) > 0
    boosted = F.col("score") * F.when(has(SYMBOL_MATCH), SYMBOL_BOOST).otherwise(1.0) * F.when(has(PATH_MATCH), PATH_BOOST).otherwise(1.0)
    found = best.select("asked", "number", F.when(has(MEANING), F.col("score")).otherwise(F.round(boosted, 6)).alias("score"), has(MEANING).alias("by_meaning"), has(SYMBOL_MATCH).alias("symbol_match"), has(PATH_MATCH).alias("path_match"))
    named = StructType([StructField("number", LongType()), StructField("chunk_id", items.schema["chunk_id"].dataType), *[items.schema[c] for c in columns]])
    arrow = to_arrow_schema(named)

    def names(t: pa.Table) -> pa.Table:
        if t["_block"][0].as_py():
            return arrow.empty_table()
        t = _last(_unpacked(t["_pack"]), "chunk_id")
        t = t.filter(t["chunk_id"].is_valid())
        return pa.table([pa.array(_numbers(t, "chunk_id")), *[t[c] for c in named.names[1:]]], schema=arrow)

    return found, placed.groupBy("_cell").applyInArrow(names, named)


def chunk_search(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best chunks per query: query_id, chunk_id, score, symbol_match, rank.  BM25 over the chunks' lexical text, times 1.8 where query and
    symbol contain one another and times 1.3 where the path contains the query.  ``queries`` has query_id and query_text; equal texts are answered once."""
    best, names = _chunk_best(items, _texts(queries), k, False, [])
    ranked = _named(best, names, ["asked"], "chunk_id", k)
    return by_query(ranked, queries).select("query_id", "chunk_id", "score", "symbol_match", "rank")


# Weights of the semantic, lexical and structural scores by preset.
PRESETS = {"hybrid": (0.45, 0.25, 0.20), "semantic": (0.85, 0.10, 0.05), "symbol": (0.10, 0.60, 0.30)}


def chunk_candidates(items: DataFrame, queries: DataFrame, definitions: DataFrame, k: int = 5) -> DataFrame:
    """The pools of 3k best chunks by meaning and by words, joined: asked (the query's text), chunk_id and the five scores.

    ``definitions`` has repo_id and name (lower case) of known functions and classes; they give Python chunks of that name a structural
    score of 0.8.  Meaning counts above 0.05, words at a fifth of their score up to 1."""
    best, names = _chunk_best(items, _texts(queries), 3 * k, True, ["repo_id", "language", "symbol"])
    known = definitions.select("repo_id", F.col("name").alias("symbol")).distinct().withColumn("_known", F.lit(True))
    about = names.join(known, ["repo_id", "symbol"], "left")
    structural = F.when((F.col("language") == "python") & F.col("_known"), 0.8).otherwise(0.0)
    ranked = _named(best, about.select("number", "chunk_id", structural.alias("structural")), ["asked", "by_meaning"], "chunk_id", 3 * k)
    score = lambda kind, x: F.coalesce(F.max(F.when(kind, x)), F.lit(0.0))
    by_words = ~F.col("by_meaning")
    return ranked.groupBy("asked", "chunk_id").agg(
        score(F.col("by_meaning") & (F.col("score") > 0.05), F.col("score")).alias("semantic"), score(by_words, F.least(F.lit(1.0), F.col("score") / 5)).alias("lexical"), F.max("structural").alias("structural"),
        score(by_words & F.col("symbol_match"), F.lit(1.0)).alias("symbol_score"), score(F.col("path_match"), F.lit(0.5)).alias("path_score"),
    )


SCORES = ["semantic", "lexical", "structural", "symbol_score", "path_score"]


def fuse_chunks(candidates: DataFrame, presets: list[str], k: int = 5, scores: bool = False) -> DataFrame:
    """Weighted sums of the five scores, symbol and path at a tenth each, with the kind of match; totals below 0.15 are dropped.  With ``scores``
    the five scores stay.  ``candidates`` are those of texts (asked) or of queries (query_id)."""
    by = "asked" if "asked" in candidates.columns else "query_id"
    weights = F.array(*[F.struct(F.lit(p).alias("preset"), *[F.lit(w).alias(n) for n, w in zip(("ws", "wl", "wt"), PRESETS[p])]) for p in presets])
    each = candidates.withColumn("_w", F.explode(weights)).select("*", "_w.*")
    total = F.col("semantic") * F.col("ws") + F.col("lexical") * F.col("wl") + F.col("structural") * F.col("wt") + F.col("symbol_score") * 0.1 + F.col("path_score") * 0.1
    s, x, t = F.col("semantic") > 0.25, F.col("lexical") > 0.25, F.col("structural") > 0.3
    kind = F.when((s & x) | (s & t) | (x & t), "hybrid").when(s, "semantic").when(t, "structural").when(F.col("symbol_score") > 0, "symbol").otherwise("lexical")
    # a billionth more, so that sums that end on a half do not depend on their binary fractions
    kept = each.withColumn("total", F.round(total + 1e-9, 6)).filter("total >= 0.15").withColumn("match_type", kind)
    w = Window.partitionBy("preset", by).orderBy(F.desc("total"), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("preset", by, "chunk_id", "total", "match_type", "rank", *(SCORES if scores else []))


def by_query(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """The answers to a text for every query that has it."""
    return answers.join(queries.select("query_id", F.col("query_text").alias("asked")), "asked").select("query_id", *[c for c in answers.columns if c != "asked"])


def fuse(semantic: DataFrame, lexical: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Weighted fusion of two candidate lists (query_id, key, score): semantic above 0.05 at .55, lexical score / 5 clamped at .35;
    totals below .15 are dropped."""
    s = semantic.filter("score > 0.05").select("query_id", key, F.col("score").alias("semantic"))
    x = lexical.select("query_id", key, F.least(F.lit(1.0), F.col("score") / 5).alias("lexical"))
    both = s.join(x, ["query_id", key], "full_outer").fillna(0.0, ["semantic", "lexical"])
    both = both.withColumn("total", F.round(F.col("semantic") * 0.55 + F.col("lexical") * 0.35, 6)).filter("total >= 0.15")
    kind = F.when((F.col("semantic") > 0.25) & (F.col("lexical") > 0.25), "hybrid").when(F.col("semantic") > 0.25, "semantic").when(F.col("lexical") > 0.25, "lexical").otherwise("weak")
    return top_k(both.withColumn("match_type", kind), "query_id", key, "total", k)


# Weights of symbols in the vocabulary by kind; what a raw name, a later exact hit and a prefix hit weigh more or less.
KIND_WEIGHTS, OTHER_KIND = {"class": 1.0, "function": 0.95, "route": 0.95}, 0.85
RAW_NAME, AGAIN, PREFIX = 1.2, 1.5, 0.7


def vocabulary(symbols: DataFrame) -> DataFrame:
    """token, symbol_id, weight, repo_id: every symbol under its words and, weighing more, under its raw name; the first of equal tokens of
    a symbol counts."""
    kind = F.lit(OTHER_KIND)
    for name, weight in KIND_WEIGHTS.items():
        kind = F.when(F.col("symbol_kind") == name, weight).otherwise(kind)
    raw = F.lower("symbol_name")
    words = F.filter(vocabulary_tokens("symbol_name"), lambda t: t != raw)
    tokens = F.concat(F.array(F.struct(raw.alias("token"), F.lit(RAW_NAME).alias("more"))), F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("more"))))
    rows = symbols.select("repo_id", "symbol_id", kind.alias("_w"), F.explode(tokens).alias("t"))
    return rows.select("repo_id", "symbol_id", "t.token", (F.col("_w") * F.col("t.more")).alias("weight")).filter(F.length("token") >= 2)


def vocabulary_search(entries: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """The k best symbols per query: query_id, symbol_id, score, rank.  ``asked`` has query_id, repo_id, token_no and token.

    In the order of the query's tokens, exact hits before prefix hits, a symbol's first hit counts once (a prefix hit at 0.7), each
    later exact hit half as much again and each later prefix hit 0.7.  Prefixes, of tokens of four letters and more, either way, are
    met by an equi-join on the shorter token: the longer one is looked up under each of its beginnings."""
    e = entries.select("repo_id", "symbol_id", "token", "weight")
    exact = asked.join(e, ["repo_id", "token"]).select("query_id", "token_no", F.lit(0).alias("phase"), "symbol_id", "weight", F.col("token").alias("met"))
    starts = lambda least: F.transform(F.sequence(least, F.greatest(F.length("token") - 1, least)), lambda n: F.left(F.col("token"), n))
    longer_entry = e.filter(F.length("token") > 4).select("repo_id", "symbol_id", "weight", F.col("token").alias("met"), F.explode(starts(F.lit(4))).alias("token"))
    longer_query = asked.filter(F.length("token") >= 4).select("query_id", "repo_id", "token_no", F.explode(starts(F.lit(2))).alias("token"))
    by_query = asked.filter(F.length("token") >= 4).join(longer_entry, ["repo_id", "token"]).select("query_id", "token_no", F.lit(1).alias("phase"), "symbol_id", "weight", "met")
    by_entry = longer_query.join(e, ["repo_id", "token"]).select("query_id", "token_no", F.lit(1).alias("phase"), "symbol_id", "weight", F.col("token").alias("met"))
    hits = exact.unionByName(by_query).unionByName(by_entry)
    first = Window.partitionBy("query_id", "symbol_id").orderBy("token_no", "phase", "met")
    part = F.when(F.col("phase") == 1, PREFIX).when(F.row_number().over(first) == 1, 1.0).otherwise(AGAIN)
    scored = hits.withColumn("part", F.col("weight") * part).groupBy("query_id", "symbol_id").agg(F.round(F.sum("part") + 1e-9, 6).alias("score"))
    return top_k(scored, "query_id", "symbol_id", "score", k)


# What else to look for when a term is asked for.
THESAURUS = {
    "auth": "auth authenticate login jwt session token credentials password user", "authentication": "auth authenticate login jwt session token credentials password user", "login": "login authenticate credentials password session token auth",
    "predict": "predict prediction predictor model inference forecast regression pipeline", "prediction": "predict prediction predictor model inference forecast regression pipeline", "logo": "logo icon brand favicon banner mark asset image png svg",
    "asset": "asset logo icon image static public resource svg png", "favicon": "favicon icon logo", "server": "server express listen port host http app routes", "entry": "entry main index app __main__ start run",
    "database": "database db sql sqlite postgres postgresql mongo redis datasource connection", "db": "database db sql sqlite postgres datasource connection", "redis": "redis redis_client redis_url redis_host cache_redis",
    "install": "install installation setup requirements package.json pip", "test": "test tests spec __tests__ pytest unittest assert describe it", "tests": "test tests spec __tests__ pytest unittest assert",
    "error": "error exception catch raise throw fail failure handler try", "exception": "exception error catch raise throw handler",
}


def keywords(entities: DataFrame, entity: str) -> DataFrame:
    """Keywords to search for an entity, a row each: its name and singular, its words, its spellings with underscores and hyphens, and the
    terms of the thesaurus under every key that contains the entity or is contained in it.  Null and empty entities give none."""
    e = F.col(entity)
    low = F.lower(e)
    words = F.filter(F.split(low, r"\s+"), lambda t: F.length(t) > 2)
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(t) for t in v.split()]).alias("v")) for k, v in THESAURUS.items()])
    terms = F.flatten(F.transform(F.filter(table, lambda x: F.contains(low, x["k"]) | F.contains(x["k"], low)), lambda x: x["v"]))
    others = F.concat(F.array(e, F.regexp_replace(low, r"\s+", "_"), F.regexp_replace(low, r"\s+", "-")), terms)
    kept = entities.filter(F.length(e) > 0).select(e.alias("entity"), F.concat(F.array(low), words).alias("_w"), others.alias("_o"))
    plain = kept.select("entity", F.explode("_w").alias("w")).select("entity", F.explode(F.array("w", singular("w"))).alias("keyword"))
    return plain.unionByName(kept.select("entity", F.explode("_o").alias("keyword"))).distinct()


def explain(fused: DataFrame) -> DataFrame:
    """A line about each fused row, which has its scores: what matched and how much."""
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    parts = [
        F.when(F.col("semantic") > 0, F.concat(F.lit("semantic "), percent("semantic"))), F.when(F.col("lexical") > 0, F.concat(F.lit("lexical "), percent("lexical"))), F.when(F.col("structural") > 0, F.lit("known definition")),
        F.when(F.col("symbol_score") > 0, F.lit("symbol match")), F.when(F.col("path_score") > 0, F.lit("path match")),
    ]
    return fused.select("asked", "chunk_id", "rank", F.concat_ws("; ", *parts).alias("explanation"))
