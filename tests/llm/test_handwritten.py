import random

import numpy as np

from coderill.llm import corpus
from coderill.llm import handwritten as h

LIB = [f"def tool_{i}(a): return a + {i}" for i in range(40)]


def made(kind, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("berth crane davit ferry gauge hinge ledger mash orchard pallet quota rotor".split())
    if kind == "generated":
        head = ["# Code generated by toolx. DO NOT EDIT."] if seed % 3 else []
        return head + [x for i in range(30) for x in (f"class {word()}{i}(_Message):", f'    __slots__ = ("f{i}",)', f"    FIELD_{i} = {i}", "")]
    if kind == "data":
        return ["T = ["] + ["  " + ", ".join(str(rnd.randint(0, 255)) for _ in range(12)) + "," for _ in range(20)] + ["]"]
    if kind == "minified":
        return ["".join(f"function ${i}(a,b){{return a>{rnd.randint(1, 99)}?b:a.{word()}({i})}}" for i in range(40))]
    if kind == "copied":
        return ["# own"] + LIB[5:35]
    body = []
    for i in range(rnd.randint(3, 8)):
        body += [f"def {word()}_{word()}({word()}, other):", f"    for item in {word()}:"] + [rnd.choice([f"        {word()} = item * {rnd.randint(1, 99)}", f"        if {word()} is None: return {word()}", f'        log("{word()} %s", {word()})']) for _ in range(rnd.randint(2, 6))] + [f"    return {word()}", ""]
    return body


def corpus_rows():
    rows, kinds = [], {}
    for i in range(240):
        kind = ["hand", "hand", "hand", "hand", "generated", "data", "minified", "copied"][i % 8]
        kinds[i] = kind
        end = {"minified": ".min.js" if i % 3 else ".js", "data": "_data.py" if i % 3 else ".py"}.get(kind, ".py")
        rows.append((i, i % 12, f"src/r{i % 12}/f{i}{end}", made(kind, i)))
    return rows, kinds


def test_masking_and_shape():
    lib = h.Library([LIB], ["tarnlib"])
    plain, _, _ = h.describe("a.py", "x = 1\ny = 2\n", lib)
    headed, label, says = h.describe("a.py", "# Code generated by toolx. DO NOT EDIT.\nx = 1\ny = 2\n", lib)
    assert label == 1 and says and np.allclose(plain, headed)
    licence = "".join(f"# clause {i} of a long licence text that goes on and on\n" for i in range(200))
    assert h.describe("a.py", licence + "# Code generated by toolx. DO NOT EDIT.\nx = 1\n", lib)[1:] == (1, True)
    named, label, says = h.describe("src/a_pb2.py", "x = 1\ny = 2\n", lib)
    assert label == 1 and not says and np.allclose(named, h.describe("src/b.py", "x = 1\ny = 2\n", lib)[0])
    assert h.describe("src/a.py", "x" * 400, lib)[1] is None  # shape makes no label
    assert h.describe("a.py", "", lib)[1] == 0 and h.describe(None, "\n", lib)[1] == 0
    assert lib.longest_run(["  " + x for x in LIB[:20]]) == 17 and lib.longest_run([]) == 0
    assert h.describe("deps/tarnlib/a.py", "# tarnlib 1.2.3 | authors\nx = 1", lib)[1] == 1


def test_found(spark):
    rows, kinds = corpus_rows()
    files = spark.createDataFrame(rows, "file_id long, repo_id long, file_path string, file_lines array<string>").selectExpr("*", "1 as ingested_at", "'x' as text")
    files = files.union(files.limit(3))
    meta = spark.createDataFrame([(i, r, p, "Python" if i % 2 else None, 1) for i, r, p, _ in rows], "file_id long, repo_id long, file_path string, detected_language string, ingested_at long")
    library = spark.createDataFrame([("tarnlib", LIB), (None, None)], "lib_name string, file_lines array<string>")
    code = corpus.files_with_language(files, meta, h.LANGUAGES)
    assert code.count() == 240
    chosen = corpus.files_with_language(h.sample_of(files, meta), meta, h.LANGUAGES)
    assert 0 < chosen.count() < 240 and h.sample_of(files, meta, sample=60).count() < 120
    got = {r.file_id for r in h.not_handwritten(code, chosen, library).collect()}
    want = {i for i, k in kinds.items() if k != "hand"}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 3
    none = code.limit(0)
    assert h.not_handwritten(none, none, library).count() == 0 and h.not_handwritten(code, none, library).count() == 0
    told = h.validate(h.score(code, library, h.train(chosen, library)), held_out=2).first()
    assert told.header_recall == 1.0 and told.plain_flagged < 0.1


def test_languages(spark):
    files = spark.createDataFrame([(1, 1, "a.PY", ["x"], 1), (2, 1, "b.txt", ["x"], 1), (3, None, "c.js", None, 1), (4, 2, "noext", ["x", None], 1), (5, 1, None, [], 2)], "file_id long, repo_id long, file_path string, file_lines array<string>, ingested_at long")
    meta = spark.createDataFrame([(4, "Java", 1), (4, "GO", 2), (1, " ", 1)], "file_id long, detected_language string, ingested_at long")
    got = {(r.file_id, r.language, r.text) for r in corpus.files_with_language(files, meta, h.LANGUAGES).collect()}
    assert got == {(1, "python", "x"), (4, "go", "x\n")}
