import datetime
import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coderill.functions import detect, text
from coderill.operators import evaluate, graph, lines, retrieval, structure
from coderill.plans import catalog, route
from coderill.sources import ingest
from coderill.sources.tables import latest
from coderill.streaming import update


def files(spark, *rows):
    return spark.createDataFrame([(i, 1, p, t.split("\n") if t is not None else None) for i, (p, t) in enumerate(rows)], "file_id long, repo_id long, file_path string, file_lines array<string>")


def test_tokens_and_hash(spark):
    df = spark.createDataFrame([("getUserName foo_bar x HTTPServer", "validate_token_long_name")], "a string, b string")
    r = df.select(text.code_tokens("a").alias("t"), text.djb2("b").alias("h"), text.vocabulary_tokens("b").alias("v")).first()
    assert r.t == ["get", "user", "name", "foo_bar", "httpserver"] and r.h == 377670146 and r.v == ["validate", "token", "long", "name"]


@pytest.mark.parametrize("word,want", [("Ferries", "ferry"), ("classes", "class"), ("bus", "bus"), ("crates", "crate"), ("boxes", "box"), ("glass", "glass"), ("s", "s"), (None, None)])
def test_singular(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(text.singular("w")).first()[0] == want


def test_paths(spark):
    bad = ["", "/a", "C:\\x", "a/../b", "..", None]
    good = {"a//b/./c.py": "a/b/c.py", "x": "x"}
    df = spark.createDataFrame([(p,) for p in bad + list(good)], "p string")
    got = {r.p: r.s for r in df.select("p", detect.safe_path("p").alias("s")).collect()}
    assert all(got[p] is None for p in bad) and all(got[p] == w for p, w in good.items())
    df = spark.createDataFrame([("a/node_modules/b.js",), ("dist",), ("src/Dist/x.py",), ("Dockerfile",), ("a.b/c",)], "p string")
    got = [tuple(r) for r in df.select(detect.is_ignored("p"), detect.is_readable("p"), detect.extension("p")).collect()]
    assert got == [(True, True, "js"), (False, False, ""), (True, True, "py"), (False, True, ""), (False, False, "")]


def test_blocks_and_slices(spark):
    f = files(spark, ("a.py", "\n".join(str(i) for i in range(1, 36))), ("b.py", None), ("c.py", "x"))
    got = [(r.file_id, r.start_line, r.end_line) for r in lines.blocks_of(f).orderBy("file_id", "start_line").collect()]
    assert got == [(0, 1, 35), (0, 31, 35), (2, 1, 1)]
    assert [r.slice_text for r in lines.slice_lines(f, 34, 90).orderBy("file_id").collect()] == ["34\n35", None, ""]


def test_sections(spark):
    f = files(spark, ("r.md", "lead\n# A\ntext\n## B\n### C\nx\n# D"))
    got = [(r.section_no, r.start_line, r.end_line, r.trail) for r in lines.doc_sections(lines.lines_of(f)).orderBy("section_no").collect()]
    assert got == [(1, 2, 3, "A"), (2, 4, 4, "A > B"), (3, 5, 6, "A > B > C"), (4, 7, 7, "A > B > C > D")]


def test_block_ends(spark):
    f = files(spark, ("a.py", "class A:\n    def f(self):\n        x\n\n    def g(self):\n        y\nz = 1\ndef h():\n    pass"))
    got = {r.start_line: r.end_line for r in lines.block_ends(lines.lines_of(f), F.col("line_text").rlike("^ *(def|class) ")).collect()}
    assert got == {1: 6, 2: 4, 5: 6, 8: 9}


def test_line_categories_and_braces(spark):
    f = files(spark, ("a.java", "/* x\ny */\nclass A {\n  // z\n\n  void f() { s(\"}\"); }\n}\nclass B {\n}"), ("b.py", "# c\n\nx"), ("c.py", None))
    got = {r.file_id: (r.blank_lines, r.comment_lines, r.code_lines) for r in lines.line_categories(f).collect()}
    assert got[0] == (1, 3, 5) and got[1] == (1, 1, 1)
    assert [(r.start_line, r.end_line) for r in lines.brace_chunks(f).orderBy("start_line").collect()] == [(3, 7), (8, 9)]


def test_modules(spark):
    f = files(spark, ("src/a/x.ts", "import { p, q } from '../b/y';\nimport { r } from './lib';\nimport { s } from 'pkg';\nimport { t } from './none';"), ("src/b/y.ts", ""), ("src/a/lib/index.js", ""))
    got = {r.source_module: (r.status, r.resolved_path) for r in structure.resolve_modules(structure.imports_of(lines.lines_of(f)), f).collect()}
    assert got == {"../b/y": ("resolved", "src/b/y.ts"), "./lib": ("resolved", "src/a/lib/index.js"), "pkg": ("external", None), "./none": ("unresolved", None)}


def test_calls_through_a_method(spark):
    f = files(spark, ("a.py", "def low():\n    pass\nclass C:\n    def mid(self):\n        low(1)\ndef top():\n    C().mid()\n    print(low())"))
    sy = spark.createDataFrame([(1, 0, "low", "function"), (1, 0, "mid", "method"), (1, 0, "top", "function")], "repo_id long, file_id long, symbol_name string, symbol_kind string")
    calls = structure.calls_of(lines.lines_of(f), sy)
    assert {(r.caller, r.callee) for r in calls.collect()} == {("mid", "low"), ("top", "mid"), ("top", "low")}


def test_shortest_hops_with_a_cycle(spark):
    e = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a"), (0, "c", "d"), (1, "a", "z")], "repo_id int, src string, dst string")
    s = spark.createDataFrame([(0, "a")], "repo_id int, source string")
    got = {r.node: r.hops for r in graph.shortest_hops(e, s).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.shortest_hops(e, s, 1).collect()} == {"b"}


def test_latency_golden(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (10, 12, 14, 15, 18, 20, 22, 25, 30, 500)] + [("y", None), ("z", 7.0), ("z", 7.0)], "g string, v double")
    got = {r.g: r for r in evaluate.order_statistics(df, "g", "v").collect()}
    x = got["x"]
    assert (x.n, x.min_value, x.max_value, x.mean_value, x.median_value, x.p90_value) == (10, 10, 500, 66.6, 19, 500)
    assert got["z"].median_value == 7 and "y" not in got


def test_precision_recall_golden(spark):
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, False)], "query_id int, rank int, is_relevant boolean")
    truth = spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "query_id int, n_relevant int")
    got = {r.query_id: (r.precision_5, r.recall_5) for r in evaluate.precision_recall(ranked, truth, [5]).collect()}
    assert got == {1: (0.2, 0.5), 2: (0.0, 0.0), 3: (None, None)}


def test_grounding_and_counts(spark):
    f = files(spark, ("a.py", "\n".join("x" * 80))).select("file_id", F.size("file_lines").alias("n_lines"))
    e = spark.createDataFrame([(9, 1, 2), (0, 200, 250), (0, 1, 80), (0, 5, 4)], "file_id long, start_line int, end_line int")
    assert sorted(r.status for r in evaluate.grounding(e, f).collect()) == ["fabricated", "grounded", "unsupported", "unsupported"]
    c = spark.createDataFrame([(5, 5), (5, 1), (5, 4)], "e int, a int").select(evaluate.count_accuracy("e", "a").alias("x"))
    assert [r.x for r in c.collect()] == [1.0, 0.0, 0.5]


def test_top_k_is_nested_and_bm25_empty(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0")
    five, ten = (retrieval.cosine_top_k(v, q, k, block=(2, 16)).select("query_id", "vec_id") for k in (5, 10))
    assert five.exceptAll(ten).count() == 0 and five.count() == 15
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id int, term string")
    assert retrieval.bm25(retrieval.postings_of(docs, "doc_id", "text"), asked, "doc_id", "query_id").count() == 0


def bm25_by_hand(docs, asked, k, boost=lambda q, d: 1.0):
    tokens = {d: re.findall("[a-z0-9_]{2,}", re.sub("([a-z])([A-Z])", r"\1 \2", t).lower()) for d, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for x in tokens.values() for t in set(x))
    out = {}
    for q, words in asked.items():
        scores = {}
        for d, x in tokens.items():
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / avgdl)) for t in words if t in df)
            if s > 0:
                scores[d] = round(round(s, 6) * boost(q, d), 6)
        for r, (d, s) in enumerate(sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k], 1):
            out[q, r] = d, s
    return out


def test_bm25_sends_on_only_the_best(spark):
    rng = random.Random(5)
    docs = {d: " ".join(["common"] + rng.choices(["alpha", "betaGamma", "delta_one", "zeta", "x", "eta9"], k=rng.randrange(1, 5))) for d in range(3000)}
    asked = {1: ["common"], 2: ["common", "zeta", "zeta"], 3: ["alpha", "eta9", "none"], 4: ["common"]}
    d = spark.createDataFrame([(i, t) for i, t in docs.items() if i] + [(0, docs[0][: len("common")]), (0, docs[0][len("common") :])], "doc_id long, text string")  # doc 0 in two rows
    q = spark.createDataFrame([(i, t) for i, x in asked.items() for t in x], "query_id int, term string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(retrieval.postings_of(d, "doc_id", "text"), q, "doc_id", "query_id", 5).collect()}
    want = bm25_by_hand(docs, asked, 5)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    one = spark.createDataFrame([("common", ["common"])], "asked string, terms array<string>")
    assert retrieval._bm25_best(retrieval.postings_of(d, "doc_id", "text"), one, "doc_id", 5).count() <= 5 * 8 * 21  # of 3,000 pairs: for a cell at most k of each score near the k-th


def test_chunk_search_keeps_the_best_after_boosts(spark):
    rng = random.Random(6)
    names = ["", "get_user", "get_user_name", "user", "name", "load"]
    chunks = [(i, 1, rng.choice(["src/user.py", "src/get_user.py", "lib/a.py", None]), "Python", rng.choice(names), "", " ".join(["user"] + rng.choices(["get_user", "name", "other", "load"], k=rng.randrange(1, 6))), datetime.datetime(2024, 1, 1)) for i in range(3000)]
    c = spark.createDataFrame(chunks, "chunk_id long, repo_id long, file_path string, file_language string, symbol_name string, docstring string, source_text string, ingested_at timestamp")
    q = spark.createDataFrame([(1, "user"), (2, "get_user"), (3, "userName"), (4, "user"), (5, None)], "query_id int, query_text string")
    texts = {i: " ".join(x for x in (path, symbol, "", source) if x is not None) for i, _, path, _, symbol, _, source, _ in chunks}

    def boost(q, d):
        low, symbol, path = {1: "user", 2: "get_user", 3: "username", 4: "user"}[q], chunks[d][4], chunks[d][2] or ""
        return (1.8 if symbol and (symbol in low or low in symbol) else 1.0) * (1.3 if low in path else 1.0)

    want = bm25_by_hand(texts, {1: ["user"], 2: ["get_user"], 3: ["user", "name"], 4: ["user"]}, 7, boost)
    got = {(r.query_id, r["rank"]): r for r in retrieval.chunk_search(retrieval.latest_chunks(c), q, 7).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].score - want[k][1]) < 3e-6 for k in want)
    assert all(r.symbol_match == (boost(r.query_id, r.chunk_id) in (1.8, 1.8 * 1.3)) for r in got.values())


def test_meaning_search_embeds_as_the_columns_do(spark):
    texts = ["loadUser token", "jwt_auth error error", "Grüße an alle x", "a", "", "query the database for a table", None]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in retrieval.embed(t, "id", "t", 12).collect():
        assert abs(retrieval.embed_texts([(texts[r.id] or "").lower()])[0][r.dim] - r.weight) < 2e-12
    q = spark.createDataFrame([("Token", "token"), ("!", "!")], "asked string, low string")
    got = retrieval.meaning_top_k(t, q, "id", "t", 3, 7).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and {r.asked for r in got} == {"Token"} and next(r.id for r in got if r["rank"] == 1) == 0


def test_hybrid_scores_both_lists_in_cells(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 3} common", f"word{i % 3}") for i in range(40)], "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["ret_hybrid"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("CoGroupsInArrow") == 2  # neither list is cut from a table of all pairs
    assert {r.query_id for r in got.collect()} == {0, 20}


def test_hybrid_texts_leave_no_task_but_in_packs(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 3} common", f"word{i % 3}") for i in range(40)], "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.QUERIES["ret_hybrid"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_pack#" in plan and not re.search(r"Repartition[^\n]*\n[^\n]*\b(text|words)#", plan)


def test_hybrid_counts_and_questions_leave_no_task_but_in_packs(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 3} common", f"word{i % 3}") for i in range(40)], "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.QUERIES["ret_hybrid"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(df#" not in plan and not re.search(r"Repartition[^\n]*_cell[^\n]*\n[^\n]*\bterms#", plan)


def test_counts_of_words_are_sums_over_cells_of_what_is_asked(spark):
    d = spark.createDataFrame([(i // 2 if i < 40 else None, f"both word{i % 3} both") for i in range(60)] + [(99, "")], "doc_id long, words string")
    asked = spark.createDataFrame([("x", ["both", "word1", "unknown"])], "asked string, terms array<string>")
    got = retrieval._weighed(asked, retrieval.packed_cells(d, "doc_id", (1, 5), bags=("words",)), "doc_id", (1, 5)).collect()[0]
    n, df = 21, {"both": 21, "word1": len({i // 2 if i < 40 else None for i in range(60) if i % 3 == 1})}
    assert abs(got.avgdl - 180 / 21) < 1e-9 and {t.term: round(t.weight, 9) for t in got.terms} == {t: round(math.log((n - x + 0.5) / (x + 0.5) + 1), 9) for t, x in df.items()}


def test_bags_keep_every_word_in_less():
    words = [None, "", *(" ".join(f"w{i * j % 97} load" for j in range(i % 40)) for i in range(3000))]
    t, to = pa.table({"id": range(len(words)), "words": words}), np.arange(len(words)) % 3
    bags, texts = (retrieval._packs(t, to, "_to", *x)["_pack"] for x in ([("words",)], []))
    rows, terms = retrieval._opened(bags)
    assert [sorted(terms["words"][c] for c in x) for _, x in sorted(zip(rows["id"].to_pylist(), rows["words"].to_pylist()))] == [sorted((x or "").split()) for x in words]
    assert sum(len(x.as_py()) for x in bags) < 0.8 * sum(len(x.as_py()) for x in texts)


def chunk_tables(spark, folder):
    day = datetime.datetime(2024, 1, 1)
    chunks = [(f"c{i}", i, 1, f"src/load{i % 3}.py", "python", "function", "loadUser" if i % 4 else "save", 1, 2, None, f"def load_user(): return token {i}", None, day) for i in range(30)]
    chunks += [("c1", 1, 1, "src/load1.py", "python", "function", "gone", 1, 2, None, "nothing of it is left", None, day - datetime.timedelta(days=1)), (None, 9, 1, None, None, None, None, 1, 2, None, "loadUser", None, None)]
    spark.createDataFrame(chunks, "chunk_id string, file_id long, repo_id long, file_path string, file_language string, symbol_type string, symbol_name string, start_line int, end_line int, parent_class string, source_text string, docstring string, ingested_at timestamp").write.parquet(f"{folder}/chunks.parquet")
    spark.read.parquet("/root/testdata/sf0.001/km_symbols.parquet").limit(1).withColumns({"symbol_id": F.lit(20).cast("long"), "repo_id": F.lit(1).cast("long"), "symbol_name": F.lit("loadUser"), "symbol_kind": F.lit("function")}).write.parquet(f"{folder}/km_symbols.parquet")


@pytest.mark.parametrize("name,rows", [("ret_chunk_hybrid", 5), ("ret_presets", 10), ("ret_explanations", 5)])
def test_chunk_pools_shuffle_texts_once(spark, tmp_path, monkeypatch, name, rows):
    chunk_tables(spark, str(tmp_path))
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: pytest.fail("candidates are written"), raising=False)
    got = catalog.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroupsInArrow") == 1 and not re.search("max_by[^\n]*(source_text|_text)", plan)  # words and meaning share their cells; deliveries are told apart there
    found = got.collect()
    assert len(found) == rows and {r.query_id for r in found} == {20} and all(r.chunk_id is not None for r in found)


TEXTS_MOVE = r"Repartition[^\n]*\n[^\n]*(_text|\bwords#|\btokens#)"


@pytest.mark.parametrize("name", ["ret_explanations", "ret_presets"])
def test_chunk_texts_leave_no_task_but_in_packs(spark, tmp_path, name):
    chunk_tables(spark, str(tmp_path))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_pack#" in plan and not re.search(TEXTS_MOVE, plan)
    assert "_to#" in plan  # what cells found goes on in packs too


def test_explanations_move_words_as_bags(spark, tmp_path, monkeypatch):
    chunk_tables(spark, str(tmp_path))
    bagged, real = [], retrieval.packed_cells
    monkeypatch.setattr(retrieval, "packed_cells", lambda *a, **k: bagged.append(k.get("bags") or a[4:]) or real(*a, **k))
    plan = catalog.QUERIES["ret_explanations"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert [set(*x) if len(x) == 1 else set(x) for x in bagged] == [{"words", "tokens"}]
    assert "sum(df#" not in plan and not re.search(r"Repartition[^\n]*_cell[^\n]*\n[^\n]*\b(terms|low)#", plan)  # counts and questions go in packs too


def test_bags_have_the_same_meaning():
    texts = ["load_user token tokens", "jwt_auth error error validationerror", "", "a query the database for db_url dburl", "xx"]
    t = pa.table({"id": range(5), "tokens": [" ".join(re.findall("[a-z0-9_]{2,}", x)) for x in texts]})
    rows, words = retrieval._opened(retrieval._packs(t, np.array([0, 1, 0, 1, 1]), "_to", ("tokens",))["_pack"])
    of, codes = retrieval._tokens(rows, "tokens")
    got = retrieval.embed_tokens_of(words["tokens"], codes, np.bincount(of, minlength=5))
    assert (got == retrieval.embed_texts([texts[i] for i in rows["id"].to_pylist()])).all() and got[:, 96:].any()


def test_packs_keep_every_row_in_less(spark):
    texts = [(i if i else None, f"load user number {i % 50} of the table and save it " * 5) for i in range(5000)]
    t = spark.createDataFrame(texts, "id long, words string")
    packs = retrieval.packed_cells(t, "id", (2, 3)).collect()
    assert {r["_block"] for r in packs} == {0, 1} and len({r["_cell"] for r in packs}) == 6
    one = [pa.scalar(bytes(r["_pack"]), pa.binary()) for r in packs if r["_block"] == 0]
    rows = retrieval._unpacked(one)
    assert sorted(zip((x or 0 for x in rows["id"].to_pylist()), rows["words"].to_pylist())) == [(i or 0, x) for i, x in texts]
    assert sum(len(x.as_py()) for x in one) < sum(len(x) for _, x in texts) / 10


def test_chunks_count_once_in_their_cells(spark, tmp_path):
    chunk_tables(spark, str(tmp_path))
    chunks = spark.read.parquet(f"{tmp_path}/chunks.parquet")
    q = spark.createDataFrame([(1, "loadUser"), (2, "gone"), (3, "nothing left")], "query_id int, query_text string")
    all_rows, last = (sorted(map(tuple, retrieval.chunk_search(x, q, 40).collect())) for x in (retrieval.delivered_chunks(chunks), retrieval.latest_chunks(chunks)))
    assert all_rows == last and len(last) == 22 and {r[0] for r in last} == {1}
    cells = retrieval.item_cells(spark.range(5000).withColumnRenamed("id", "key"), "key", (2, 6)).select("_cell", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(cells) == 12 == len({r.p for r in cells})


def test_contained():
    needles, texts = ["a", "ab", "abc", "abcdefgh", "b_cdefghi", "é", "abcdefg"], ["", "a", "xabcdefghy", "b_cdefghi", "éab"]
    assert list(retrieval.contained(needles, texts)) == [[i for i, x in enumerate(needles) if x in t] for t in texts]


def test_zip_and_tree(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in [("root/a.py", "x\r\ny"), ("root/node_modules/b.js", "z"), ("root/c.png", "q"), ("root/../d.py", "z"), ("root/e.py", b"\0\1")]:
            z.writestr(name, data)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = [(r.file_path, r.file_lines) for r in ingest.read_zip(spark, str(tmp_path / "*.zip")).collect()]
    assert got == [("a.py", ["x", "y"])]
    assert sorted((r.file_path or "", r.problem) for r in ingest.rejected_entries(spark, str(tmp_path / "*.zip")).collect()) == [("", "broken archive"), ("../d.py", "unsafe path"), ("e.py", "binary")]
    assert [(r.file_path, r.problem) for r in ingest.rejected_entries(spark, str(tmp_path / "a.zip"), 3).collect() if r.file_path == "a.py"] == [("a.py", "too large")]
    (tmp_path / "t" / "src").mkdir(parents=True)
    (tmp_path / "t" / "src" / "m.go").write_text("a\nb")
    assert [(r.file_path, r.file_lines) for r in ingest.read_tree(spark, str(tmp_path / "t")).collect()] == [("src/m.go", ["a", "b"])]


def test_benchmark_and_report(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "problem": "p"}, {"id": "2", "query": "q", "category": "c"}, {"id": "3"}]))
    got = ingest.read_benchmark(spark, str(tmp_path / "q.json"))
    assert {(r.id, r.query, r.query_type) for r in got.collect()} == {("1", "p", "general"), ("2", "q", "c")}
    assert ingest.markdown_report(got.select("id", "query"), "T", ["id"]) == "# T\n\n| id | query |\n|---|---|\n| 1 | p |\n| 2 | q |\n"
    url = spark.createDataFrame([("https://forge.example/o/n.git",), ("x",)], "u string").select(ingest.parse_repository_url("u").alias("p"))
    assert [(r.p.owner, r.p.name) for r in url.collect()] == [("o", "n"), (None, None)]


@pytest.mark.parametrize("question,kind,entity", [("Where is fooBar defined?", "definition", "fooBar"), ("How many classes are there?", "count", "classes"), ("Which files call do_it?", "callers", "do_it"), ("What does run call?", "callees", None), ("Hello", "general", None)])
def test_routing(question, kind, entity):
    got = route.plan_question(question)
    assert got["intent"] == kind and (entity is None or got["entity"] == entity)


def test_stream_equals_batch(spark, tmp_path):
    schema = "file_id long, repo_id long, file_path string, file_lines array<string>, ingested_at long"
    rows = [(i % 5, 1, f"f{i % 5}", [str(i)], i) for i in range(20)]
    whole = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    update.latest_file_versions(spark, str(tmp_path / "in"), whole.schema, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = update.current(spark, str(tmp_path / "out")).select("file_id", "file_lines")
    want = latest(whole, "file_id").select("file_id", "file_lines")
    assert got.exceptAll(want).count() == 0 and got.count() == 5
    kept = update.delete(want, want.filter("file_id = 1"), "file_id")
    assert kept.count() == 4 and update.upsert(kept, want, "file_id").count() == 5


def test_greedy_spacing_and_brackets(spark):
    hits = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (1, 5), (2, 9)], "file_id int, line_no int")
    assert sorted(tuple(r) for r in lines.greedy_spaced(hits).collect()) == [(1, 1), (1, 5), (2, 9)]
    f = files(spark, ("a.py", 'A = [\n  "x]",\n\n  {1: 2},\n]\nB = (\n)\nc = [\n1'), ("b.py", None))
    got = [(r.start_line, r.end_line, r.item_count) for r in lines.bracket_ends(f).orderBy("start_line").collect()]
    assert got == [(1, 5, 2), (6, 7, 1)]


def test_running_bytes_over_spans(spark):
    rows = [(i, i % 2, None if i % 7 == 0 else i, 1, 1) for i in range(300)] + [(5, 1, 99, 0, 1)]
    m = spark.createDataFrame(rows, "file_id long, repo_id long, byte_size long, ingested_at long, line_count int")
    total, want = {0: 0, 1: 0}, {}
    for i in range(300):
        total[i % 2] += 0 if i % 7 == 0 else i
        want[i] = (total[i % 2], total[i % 2] > 5000)
    got = {r.file_id: (r.total_bytes, r.over_limit) for r in lines.running_bytes(m, 5000, span=16).collect()}
    assert got == want


def test_config_entries_of_every_format(spark):
    f = files(spark, ("a/.env.prod", "export A=\"x\"\n# B=2\n C = 3"), ("b/.env", "D="), ("c.json", '{\n  "port": 3000,\n  "db": {\n  "u-v": "w",'), ("x/Dockerfile", "FROM a\nENV K v w\nexpose 8080/tcp\nENV L=1"), ("d.yml", "s:\n  k.a: 'v'\n- z"), ("e.toml", "[t]\na-b = \"c\""), ("f.py", "a = 1"))
    got = {(r.file_id, r.line_no, r.config_key, r.config_value) for r in structure.all_config_entries(lines.lines_of(f)).collect()}
    want = {(0, 1, "A", "x"), (0, 3, "C", "3"), (1, 1, "D", ""), (2, 2, "port", "3000"), (2, 3, "db", "{"), (2, 4, "u-v", "w"), (3, 2, "K", "v w"), (3, 3, "port", "8080"), (3, 4, "L", "1"), (4, 1, "s", "(section)"), (4, 2, "k.a", "v"), (5, 2, "a-b", "c")}
    assert got == want


def test_config_entries_hold_the_config_table(spark):
    from coderill.plans import catalog
    from coderill.sources.tables import table

    folder = "/root/testdata/sf0.001"
    got = catalog.QUERIES["ext_config_entries"](spark, folder).select("file_id", "line_no", "config_key")
    assert table(spark, folder, "km_configs").select("file_id", "line_no", "config_key").subtract(got).count() == 0


def test_six_line_categories(spark):
    """The golden counts of configuration and documentation files, and block comments that open and close on one line."""
    f = files(
        spark, ("a.yaml", "# one\n# two\n\na: 1\nb: 2"), ("r.md", "# A\n\ntext\nmore"), ("d.csv", "a,b\n1,2\n"), ("x.py", '"""doc"""\nx = 1\n"""open\nstill\nclosed""" \n# c\ny'), ("t.tsx", "{/* a\nb */}\n<A />"), ("Dockerfile", "FROM x\n# c"),
        ("data/x.json", "{}"), ("a/data/x.json", "{}"), ("u.xyz", "p\n\n"), ("e.py", None),
    )
    kinds = ("blank_lines", "comment_lines", "code_lines", "data_lines", "config_lines", "documentation_lines")
    got = {r.file_id: tuple(r[k] for k in kinds) for r in lines.line_categories(f).collect()}
    assert got == {0: (1, 2, 0, 0, 2, 0), 1: (1, 0, 0, 0, 0, 3), 2: (1, 0, 0, 2, 0, 0), 3: (0, 5, 2, 0, 0, 0), 4: (0, 2, 1, 0, 0, 0), 5: (0, 1, 0, 0, 1, 0), 6: (0, 0, 0, 0, 1, 0), 7: (0, 0, 0, 1, 0, 0), 8: (2, 0, 0, 0, 0, 1), 9: got[9]}


def test_exact_singular_and_ignored(spark):
    got = spark.createDataFrame([(w,) for w in ("ids", "axes", "is", "ties", "boxes", "as")], "w string").select(text.singular("w")).collect()
    assert [r[0] for r in got] == ["id", "ax", "is", "tie", "box", "as"]
    df = spark.createDataFrame([(p,) for p in ("bin/a.py", ".github/x.yml", "a/.DS_Store", "a/._x.py", "a/x.PNG", ".env", "src/.env")], "p string")
    assert [r[0] for r in df.select(detect.is_ignored("p")).collect()] == [False, True, True, True, True, False, False]
    assert [r[0] for r in df.select(detect.file_extension("p")).collect()] == ["py", "yml", "", "py", "png", "", ""]


def test_imports_exports_and_bases(spark):
    f = files(
        spark, ("a.py", "from .x import (a, b as c)\nimport os, sys as s\n  import deep.mod\nclass A(B, m.C, metaclass=M):"),
        ("b.ts", "import d, { e, type f as g } from './y';\nimport * as ns from 'z';\nconst { h, i: j } = require('k');\nconst l = require(\"m\");\nexport class D extends E implements G, H {\nexport { p, q as r };\nexport default async function t() {}"), ("C.java", "import java.util.List;\nimport static a.B.c;\nclass X extends Y {"),
    )
    x = lines.lines_of(f)
    got = {(r.file_id, r.source_module, r.imported_name, r.alias, r.import_type) for r in structure.all_imports(x).collect()}
    assert got == {
        (0, ".x", "a", None, "from"), (0, ".x", "b", "c", "from"), (0, "os", "os", None, "module"), (0, "sys", "sys", "s", "module"), (0, "deep.mod", "deep.mod", None, "module"), (1, "./y", "e", None, "named"), (1, "./y", "f", "g", "named"),
        (1, "./y", "d", None, "default"), (1, "z", "ns", None, "namespace"), (1, "k", "h", None, "commonjs"), (1, "k", "i", "j", "commonjs"), (1, "m", "l", None, "commonjs"), (2, "java.util.List", "java.util.List", None, "module"), (2, "a.B.c", "a.B.c", None, "module"),
    }
    assert sorted(r.exported_name for r in structure.exports_of(x).collect()) == ["D", "p", "r", "t"]
    assert sorted((r.class_name, r.base_name) for r in structure.bases_of(x).collect()) == [("A", "B"), ("A", "C"), ("D", "E"), ("D", "G"), ("D", "H"), ("X", "Y")]


def test_references_of_every_kind(spark):
    f = files(spark, ("a.py", "from m import Gate\nclass Sub(Gate):\ng = Gate(1)\nopen_it(g)\ndef h(x: Gate):\n    return GATES\ny = x.open_it"), ("b.ts", "export class Gate {"), ("r.md", "The Gate opens."))
    sy = spark.createDataFrame([(1, "Gate", "class"), (1, "open_it", "function"), (1, "GATES", "collection")], "repo_id long, symbol_name string, symbol_kind string")
    got = {(r.name, r.file_id, r.line_no, r.ref_type) for r in structure.references(lines.lines_of(f), sy).collect()}
    assert got == {
        ("gate", 0, 1, "import"), ("gate", 0, 2, "class_inheritance"), ("gate", 0, 3, "class_instantiation"), ("open_it", 0, 4, "function_call"), ("gate", 0, 5, "type_hint"), ("gates", 0, 6, "variable_usage"), ("open_it", 0, 7, "attribute_reference"),
        ("gate", 1, 1, "export"), ("gate", 2, 1, "doc_mention"),
    }


def test_chain_with_its_nodes(spark):
    e = spark.createDataFrame([(1, *x) for x in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "x"), ("x", "c"), ("d", "e")]], "repo_id long, src string, dst string")
    asked = spark.createDataFrame([(1, "a", "d"), (1, "a", "a"), (1, "d", "a"), (1, "b", "e"), (2, "a", "d")], "repo_id long, source string, target string")
    got = {(r.source, r.target): (r.hops, r.chain) for r in graph.shortest_chains(e, asked).collect()}
    assert got == {("a", "d"): (3, ["a", "b", "c", "d"]), ("a", "a"): (0, ["a"]), ("b", "e"): (3, ["b", "c", "d", "e"])}
    assert ("b", "e") not in {(r.source, r.target) for r in graph.shortest_chains(e, asked, 2).collect()}


def test_presets_and_labels(spark):
    c = spark.createDataFrame([(1, "a", 0.9, 0.0, 0.0, 0.0, 0.0), (1, "b", 0.0, 1.0, 0.8, 1.0, 0.5), (1, "c", 0.0, 0.2, 0.0, 1.0, 0.0), (1, "d", 0.06, 0.0, 0.0, 0.0, 0.0)], "query_id long, chunk_id string, semantic double, lexical double, structural double, symbol_score double, path_score double")
    got = {(r.preset, r.chunk_id): (round(r.total, 3), r.match_type) for r in retrieval.fuse_chunks(c, ["hybrid", "symbol"]).collect()}
    assert got == {("hybrid", "a"): (0.405, "semantic"), ("hybrid", "b"): (0.56, "hybrid"), ("hybrid", "c"): (0.15, "symbol"), ("symbol", "b"): (0.99, "hybrid"), ("symbol", "c"): (0.22, "symbol")}


def test_report_is_refused_rather_than_cut(spark):
    with pytest.raises(ValueError):
        ingest.markdown_report(spark.range(5), "T", ["id"], most=4)


def test_checkpoint_folder_is_required_on_clusters(spark, monkeypatch):
    from coderill import session

    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

        def getConf(self):
            return spark.sparkContext.getConf()

    class Frame:
        class sparkSession:
            sparkContext, conf = Context(), spark.conf

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(ValueError):
            session.cut_lineage(Frame)
