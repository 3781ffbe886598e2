import pytest

from coderill.llm import pii

LEXICON = [("Orvela", "given"), ("Wren", "given"), ("Émeline", "given"), ("Marsh", "surname"), ("Quillmere", "surname")]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(LEXICON)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Write to orvela.q@mail.a.example now.", "Write to [EMAIL] now."),
        ("bs (at) dev dot a dot example / bs [at] a.test / bs&#64;a.test / B.S @ a.test", "[EMAIL] / [EMAIL] / [EMAIL] / [EMAIL]"),
        ("support@a.test, noreply@a.test, git@a.test:x/y.git, name@host.example, @shard.cached, lib@1.2.3", None),
        ("Call +44 (0)20 7946 0154 or (584) 555-0164, 01 99 00 83 37 x.", "Call [PHONE] or [PHONE], [PHONE] x."),
        ("tel=030 23125 085 state", "tel=[PHONE] state"),
        ("Ticket 555-201, order 742-153-701, ISBN 978-0-372-829-1, 10.17.12.19, 2025-14-17 03:25:22, 1.15.2", None),
        ("ssn 937-74-4303 and QQ 42 17 03 C and XQ4625742 and 00012311-W and 09 310 943 691", "ssn [ID_NUMBER] and [ID_NUMBER] and [ID_NUMBER] and [ID_NUMBER] and [ID_NUMBER]"),
        ("card 4111 1111 1111 1111 but not 4111 1111 1111 1112", "card [ID_NUMBER] but not 4111 1111 1111 1112"),
        ("at Flat 38, 6 Oldwharf Close, Tidewell today", "at [ADDRESS] today"),
        ("zu Salzbergstraße 15, 00713 Montesal\nCalle Las Norias 223, 6º A, Tidewell\n201 rue des Tisserines, 00169 Olmstadt", "zu [ADDRESS]\n[ADDRESS]\n[ADDRESS]"),
        ("Open Street View module, line 393", None),
        ("Thanks Wren, merged.", "Thanks [NAME], merged."),
        ("The Wren scheduler uses the Marsh index.", None),
        ("ÉMELINE VAN QUILLMERE met O. Quillmere and Quillmere, Orvela and Orvela T. Marsh.", "[NAME] met [NAME] and [NAME] and [NAME]."),
        ("Reviewed-by: Thessal Pallavane\nSigned-off-by: Zora Qix <z@a.test>", "Reviewed-by: [NAME]\nSigned-off-by: [NAME] <[EMAIL]>"),
        ("", None),
        (" \n\t", None),
    ],
)
def test_masks(finder, text, expected):
    assert pii.mask(text, finder.find(text)) == (text if expected is None else expected)


def test_offsets_with_widening_lower_case(finder):
    text = "İİİ 😀 to orvela@a.test"
    (start, end, kind) = finder.find(text)[0]
    assert text[start:end] == "orvela@a.test" and kind == "email"


def test_long_text(finder):
    text = "word " * 200_000 + "orvela@a.test" + " 1" * 100_000
    assert [k for *_, k in finder.find(text)] == ["email"]


def test_operators(spark):
    docs = spark.createDataFrame([(1, "Hi Orvela,"), (None, "x a@b.test"), (2, None), (3, ""), (1, "Hi Orvela,")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'q' as occurrence", "1 as r", "2 as _k_")
    lexicon = spark.createDataFrame([(w, r) for w, r in LEXICON] + [(None, None), ("", "given")], "word string, word_role string")
    got = sorted((str(r.doc_id), r.pii_kind, r.start_char, r.occurrence) for r in pii.find_pii(docs, lexicon).collect())
    assert got == [("1", "name", 3, "Orvela"), ("1", "name", 3, "Orvela"), ("None", "email", 2, "a@b.test")]
    red = {(r.doc_id, r.redacted_text, r.pii_count) for r in pii.redact_pii(docs, lexicon).collect()}
    assert red == {(1, "Hi [NAME],", 1), (None, "x [EMAIL]", 1), (2, None, 0), (3, "", 0)}
    assert pii.find_pii(docs.limit(0), lexicon.limit(0)).count() == 0


def test_no_windows(finder):
    local, host = "a" * 500, ".".join(["b" * 60] * 6) + ".example"
    assert [finder.find(f"x {local}@{host}, y")[0][:2]] == [(2, 3 + len(local) + len(host))]
    assert finder.find("https://" + "p/" * 90 + "u@a.test/x") == []
    street = "zu " + "Salz" * 40 + "straße 15 heute"
    assert [street[s:e] for s, e, k in finder.find(street) if k == "address"] == [street[3:-6]]
    name = "Reviewed " + "Q" + "u" * 80 + " V" + "a" * 80 + " <orvela@a.test>"
    assert [k for *_, k in finder.find(name)] == ["name", "email"]


def test_many_anchors_in_linear_time(finder):
    import time

    for text in ("a@" * 60_000, "1 Close " * 40_000, "street 1 " * 40_000, "://" * 60_000 + "x@a.test", "Orvela" + " Marsh" * 40_000, "+1" * 60_000, "9" * 200_000):
        began = time.perf_counter()
        finder.find(text)
        assert time.perf_counter() - began < 6, text[:20]
