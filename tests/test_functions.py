"""Functions against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, text, vector


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_fnv1a():
    def plain(b):
        h = 0xCBF29CE484222325
        for c in b:
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h

    values = [b"", b"a", b"hello", "grün".encode(), b"x" * 50]
    assert hashing.fnv1a(values).tolist() == [plain(v) for v in values]


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("abc", "xyz", 0), ("", "", 1), ("", "a", 0), ("ABC", "abc", 1)])
def test_jaro_winkler(spark, a, b, want):
    assert one(spark, text.jaro_winkler("a", "b"), a=a, b=b) == pytest.approx(want, abs=5e-5)


def test_normalize(spark):
    assert one(spark, text.normalize_text("t"), t="﻿a\r\nb\rc\n") == "a\nb\nc\n"


def test_overlap_divides_by_the_left_side(spark):
    assert one(spark, text.keyword_overlap("a", "b"), a="river stone river the", b="river bank") == pytest.approx(2 / 3)
    assert one(spark, text.filename_overlap("a", "b"), a="river_map.txt", b="river") == pytest.approx(1 / 3)
    assert one(spark, text.keyword_overlap("a", "b"), a="of the", b="river") == 0
    assert one(spark, text.overlap_tokens("a"), a="go 山 ox") == ["山"]


def test_hex_distance(spark):
    d = lambda a, b: one(spark, text.hex_distance(F.col("a"), F.col("b")), a=a, b=b)
    assert [d("0" * 16, "0" * 16), d("0" * 16, "0" * 15 + "1"), d("0" * 16, "f" * 16), d("00", "000"), d("zz", "00")] == [0, 1, 64, None, None]


def test_simhash(spark):
    h = lambda t: one(spark, text.simhash("t"), t=t)
    assert h("") == h("  ") == "0" * 16
    assert h("Hello, World") == h("hello world") and h("!!!") != h("???")
    near, far = (bin(int(h("the quick brown fox jumps over the lazy dog today"), 16) ^ int(h(t), 16)).count("1") for t in ("the quick brown fox jumps over the lazy dog now", "completely different words stand here instead of those"))
    assert near < far


def test_near_term(spark):
    """The term's own length counts: none under seven characters, one change to nine, two from ten on; one trailing s goes first."""
    n = lambda a, b: one(spark, text.near_term(F.col("a"), F.col("b")), a=a, b=b)
    assert n("examplf", "example") and n("examples", "example") and n("Example", "example")
    assert not n("probe", "prone") and not n("probe", "probe") and not n("probes", "probe")
    assert not n("examxxe", "example") and n("configurxx", "configurab") and not n("configxxx", "configura")
    # ten characters against nine: two changes, but only this way round
    assert n("abcdefghij", "abcdefghx") and not n("abcdefghx", "abcdefghij")


def test_lines_and_spans(spark):
    t = "é one\ntwo\nthree"
    assert one(spark, text.line_number("t", 8), t=t) == 2
    assert one(spark, text.span_text("t", F.lit(0), F.lit(2)), t=t) == "é"
    assert one(spark, text.span_text("t", F.lit(1), F.lit(2)), t=t) is None
    assert one(spark, text.byte_offset("t", F.lit(2)), t=t) == 3


def test_structural_hash(spark):
    h = lambda t: one(spark, text.structural_hash("t"), t=t)
    assert h("# A\n\n  Some   Text") == h("# A\nsome text") != h("A\nsome text")
    assert h("- x") == h("*  x")


def test_metadata(spark):
    m = one(spark, text.metadata("p", "t"), p="/a/b_c.md", t="title: \"Named: here\"\n# One\n##  Two\n#\nrest")
    assert m.title == "Named: here" and m.headings == ["One", "Two"]
    assert one(spark, text.metadata("p", "t"), p="/a/b_c.md", t="x").title == "b_c"
    assert one(spark, text.title_words("t"), t="some_file-name") == "Some File Name"


def test_recency(spark):
    r = lambda a: one(spark, text.recency(F.col("a"), 10.0), a=a)
    assert [r(0.0), r(-1.0), r(10.0), r(float("nan"))] == [1, 1, 0.5, 0]


def test_alias(spark):
    s = lambda q, *p: tuple(one(spark, text.alias_score("q", "p"), q=q, p=list(p)))
    assert s("acme tools", "Acme Tools") == (1.0, "exact_phrase") and s("acme", "Other", "ACME") == (1.0, "alias_phrase")
    assert s("parent of Alex Quinn Examplf", "Alex Quinn Example") == (1.0, "fuzzy_token")
    assert s("parent of Alex Quinn Example", "Alex Quinn Example") == (0.96, "alias_phrase")
    assert s("alex", "Alex Quinn Example")[0] < 0.8 and s("al", "Alex Quinn Example") == (0.0, "")
    assert s("alexander", "Alex")[0] < 0.8 and s("alexson", "Alex")[0] < 0.8 and s("derived", "$derived.by")[0] < 0.8
    assert s("Alex Example", "Alex Quinn Example") == (0.84, "token_coverage") == s("Example Alex", "Alex Quinn Example")
    assert s("Alex Example", "Record Alex Quinn Example")[0] < 0.8
    for q, p in (("john", "john john"), ("anna", "anna anne"), ("anna", "anne anna"), ("anne zz", "anna middle anne")):
        assert s(q, p)[0] < 0.8 and s(q, p)[1] == "token_coverage"
    assert text._matched(["maria", "marie"], ["marin", "marla"]) == (2, True)
    assert tuple(one(spark, text.alias_score("q", "p", ["record"]), q="alex quinn", p=["Record Alex Quinn"])) == (1.0, "exact_phrase")


def test_analyzer_offsets(spark):
    got = one(spark, text.analyze_with_offsets("t"), t="Über x-ray")
    assert [(g.text, g.start, g.end, g.position) for g in got] == [("über", 0, 5, 0), ("x", 6, 7, 1), ("ray", 8, 11, 2)]


def test_vectors(spark):
    v = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert v(vector.cosine, [1.0, 0.0], [2.0, 0.0]) == 1 and v(vector.cosine, [1.0], [1.0, 0.0]) == 0 and v(vector.cosine, [0.0], [1.0]) == 0
    assert v(vector.cosine_distance, [1.0, 0.0], [-1.0, 0.0]) == 2 and v(vector.cosine_distance, [0.0], [1.0]) == 1
    assert v(vector.euclidean, [1.0], [1.0, 2.0]) == math.inf and v(vector.euclidean, [0.0, 3.0], [4.0, 0.0]) == 5
    assert one(spark, vector.normalize(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, vector.normalize(F.col("a")), a=[0.0]) == [0.0]


def test_binary_codes(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=130), rng.normal(size=130)
    x[63] = y[127] = 5
    row = spark.createDataFrame([(x.tolist(), y.tolist(), [0.0] * 130)], "a array<double>, b array<double>, t array<double>").select(vector.quantize(F.col("a"), F.col("t")).alias("p"), vector.quantize(F.col("b"), F.col("t")).alias("q"))
    got = row.select("p", vector.hamming(F.col("p"), F.col("q")).alias("d")).first()
    assert got.d == ((x > 0) != (y > 0)).sum()
    assert [w % 2**64 for w in got.p] == [sum(1 << i for i, b in enumerate(x[k : k + 64] > 0) if b) for k in (0, 64, 128)]


def slow_simhash(t, n):
    """Character by character."""
    import unicodedata

    out, space = [], False
    for c in t.lower():
        if unicodedata.category(c)[0] in "LNM":
            out, space = [*out, c], False
        elif c.isspace() and not space:
            out, space = [*out, " "], True
    clean = "".join(out).strip()
    if not clean and not t.strip():
        return 0
    grams = [clean[i : i + n] for i in range(len(clean) - n + 1) if clean[i] != " " and clean[i + n - 1] != " "] or [clean or "\0raw:" + t.lower()]
    total = [0] * 64
    for g in grams:
        h = 0xCBF29CE484222325
        for b in g.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        for i in range(64):
            total[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if total[i] > 0)


def test_simhash_by_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(800):
        t = "".join(rng.choice("ab cd\t\n eéß漢\U0001f600'-_!.1² \u0301") for _ in range(rng.randrange(25)))
        for n in (1, 3, 4):
            assert text._simhash(t, n, 64) == slow_simhash(t, n), (t, n)


def test_token_counts(spark):
    from tessera.functions.tokenizer import Tokenizer, fill_token_counts, token_count

    t = Tokenizer()
    d = spark.createDataFrame([("one two three", 0), ("kept", 7), (None, 0), ("one two three", None)], "text string, token_count int")
    assert [r.n for r in d.select(token_count("text").alias("n")).collect()] == [t.count("one two three"), t.count("kept"), None, t.count("one two three")]
    assert [r.token_count for r in fill_token_counts(d).collect()] == [t.count("one two three"), 7, None, t.count("one two three")]
