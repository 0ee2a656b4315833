"""Expression builders against plain Python."""

import hashlib
import json
import random
import re
import struct
import urllib.parse

import pytest
from pyspark.sql import functions as F

from veriloom.functions import canon, checks, text, urls

HARD = ["", "plain", 'q"uote\\back', "".join(map(chr, range(1, 128))), "\x00\x1f\x7f", "literal \\u001F", "emoji \U0001f600 ffee ￮", "line sep", "nbsp\xa0x", "é ü", "\r\n\t"]
FLOATS = [0.0, -0.0, 1.0, 100.0, 1.7e9, 1700000000.25, 1e15, 1e16, 1.5e16, 123456789012345680.0, 0.1, 0.001, 0.00012, 1e-5, 1.5e-7, -2.5e-9, 3.0e22, -1e16, 9.0, 0.98]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("ascii_only", [False, True])
def test_json_strings_are_byte_equal(spark, ascii_only):
    assert column(spark, HARD, lambda c: canon.string(c, ascii_only)) == [json.dumps(v, ensure_ascii=ascii_only) for v in HARD]


def test_json_floats_are_written_as_python_does(spark):
    assert column(spark, FLOATS, canon.floating, "double") == [json.dumps(v) for v in FLOATS]


def test_objects_sort_keys_and_leave_out_absent_fields(spark):
    df = spark.createDataFrame([("x", 1, None), ("y", 2, "r")], "a string, b int, c string")
    o = canon.object_({"b": canon.integer(F.col("b")), "a": canon.string(F.col("a")), "c": (F.col("c").isNotNull(), canon.string(F.col("c")))})
    got = [r.o for r in df.select(o.alias("o")).orderBy("b").collect()]
    assert got == [json.dumps({"a": "x", "b": 1}), json.dumps({"a": "y", "b": 2, "c": "r"})]


def test_null_values_are_json_null(spark):
    df = spark.createDataFrame([(None, None, None)], "s string, n int, x double")
    assert df.select(canon.string(F.col("s")), canon.integer(F.col("n")), canon.floating(F.col("x"))).first() == ("null", "null", "null")


def test_norm_collapses_unicode_space(spark):
    raw = [" a\x1cb  c ", "x y　z", "\t", "n\xa0m"]
    assert column(spark, raw, text.norm) == [re.sub(r"\s+", " ", v).strip() for v in raw]


def test_grounded_needs_word_edges(spark):
    df = spark.createDataFrame([("100", "costs 1000"), ("100", "costs 100."), ("$19.99", "only $19.99one"), ("$19.99", "only $19.99 one"), ("", "x")], "t string, h string")
    assert [r.g for r in df.select(text.grounded(F.col("t"), F.col("h")).alias("g")).collect()] == [False, True, False, True, False]


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 1 / 3]


def test_inverted_index(spark):
    df = spark.createDataFrame([({"tiles": [3], "A": [0], "single": [1], "shape": [2]},), (None,)], "m map<string,array<int>>")
    assert [r.t for r in df.select(text.inverted_index_text(F.col("m")).alias("t")).collect()] == ["A single shape tiles", ""]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("http://S.COM/a#frag", "http://s.com/a"), ("https://h.com:443/x", "https://h.com/x"), ("https://h.com:8443", "https://h.com:8443/"), ("HTTP://u:p@H.com/a?q=1#z", "http://h.com/a?q=1")],
)
def test_canonical_urls(spark, raw, want):
    assert column(spark, [raw], urls.canonicalize) == [want]


def test_doi_dresses(spark):
    good = ["10.1234/Monotile", "doi:10.1234/monotile", "https://doi.org/10.1234/monotile", "http://dx.doi.org/10.1234/MONOTILE", " doi.org/10.1234/monotile/ "]
    bad = ["", "not-a-doi", "10.1234", "monotile", None, "42", "arxiv:2301.1"]
    assert column(spark, good + bad, urls.normalize_doi) == ["10.1234/monotile"] * len(good) + [""] * len(bad)


def test_query_strings_match_urllib(spark):
    raw = ["a b~*é/&", "all:x"]
    assert column(spark, raw, urls.form_encode) == [urllib.parse.urlencode({"": v})[1:] for v in raw]
    assert column(spark, raw, urls.path_encode) == [urllib.parse.quote(v, safe="") for v in raw]


def test_arxiv_ids(spark):
    raw = ["2301.12345", "2301.12345v2", "hep-th/9901001", "a query", " 2301.1234 "]
    assert column(spark, raw, urls.is_arxiv_id) == [True, True, True, False, True]
    assert column(spark, ["http://arxiv.org/abs/2301.12345v2", "x/y"], urls.arxiv_id) == ["2301.12345v2", "y"]


def test_shapes(spark):
    h = hashlib.sha256(b"x").hexdigest()
    assert column(spark, [h, h + "\n", h.upper(), None, "../../etc/passwd"], checks.is_hash) == [True, False, False, False, False]
    assert column(spark, ["alpha-1", "-a", "A", "", None, "a\n"], checks.is_slug) == [True, False, False, False, False, False]


def test_method_ladder(spark):
    df = spark.createDataFrame([("http-get", False), ("http-get", True), ("compiled", True), ("compiled", False), ("odd", True)], "m string, i boolean")
    rows = df.select(checks.directness(F.col("m")).alias("d"), checks.consistent(F.col("m"), F.col("i")).alias("ok")).collect()
    assert [tuple(r) for r in rows] == [("direct", True), ("direct", False), ("derived", True), ("derived", False), ("unknown", True)]


def test_canonical_json_of_random_values(spark):
    r = random.Random(5)
    code = lambda: r.choice([r.randrange(0, 128), r.randrange(0, 0xD800), r.randrange(0xE000, 0x110000)])
    texts = ["".join(chr(code()) for _ in range(r.randint(0, 12))) for _ in range(300)]
    bits = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(300)]
    numbers = [float(f"{r.uniform(-10, 10):.{r.randint(0, 13)}f}e{r.randint(-8, 6)}") for _ in range(300)] + [float(10**k) for k in range(-10, 23)]
    assert column(spark, texts, canon.string) == [json.dumps(v, ensure_ascii=False) for v in texts]
    assert column(spark, texts, lambda c: canon.string(c, True)) == [json.dumps(v) for v in texts]
    assert column(spark, numbers, canon.floating, "double") == [json.dumps(v) for v in numbers]
    assert column(spark, [*numbers, *bits, 5e-324, None], lambda c: canon.floating(c, exact=True), "double") == [json.dumps(v) for v in [*numbers, *bits, 5e-324, None]]
