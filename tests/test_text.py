import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import text as t


def one(spark, value, f, kind="binary"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("data, ratio", [(b"", 0.0), (b"GET / HTTP/1.1\r\n", 1.0), (bytes([65, 66, 0, 1, 2]), 0.4)])
def test_printable_ratio(spark, data, ratio):
    assert one(spark, data, lambda c: t.printable_ratio(c, True)) == pytest.approx(ratio)


@pytest.mark.parametrize("data, line", [(b"USER admin\r\n", "USER admin"), (b"AB\x01CD", "ABCD"), (b"\x01\x02ab", None), (b"\x01\x02abcd", "abcd"), (b"AB\xffCD", "AB�CD"), (b"a\tb c", "a\tb c"), (b"\x1c\x1d ab\x7fcd \x1f", "ab\x7fcd"), (b"", None)])
def test_clean_line(spark, data, line):
    assert one(spark, data, lambda c: t.clean_line(c, 4, True)) == line


def test_clean_line_as_python_does(spark):
    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.binary(max_size=30), min_size=1, max_size=40))
    def check(values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary").select("i", t.clean_text(F.col("v"), True).alias("r")).collect()
        for r in rows:
            s = values[r["i"]].decode("utf-8", "replace").strip()
            assert r["r"] == "".join(c for c in s if c >= " " or c == "\t").strip()

    check()


@pytest.mark.parametrize("label, slug", [("DoS Hulk", "DoS-Hulk"), ("Web Attack � Brute Force", "Web-Attack-Brute-Force"), ("", "unknown"), ("é", "unknown"), ("--a  b--", "a-b")])
def test_slugify(spark, label, slug):
    assert one(spark, label, t.slugify, "string") == slug


@pytest.mark.parametrize("label, slug", [("Web Attack � Brute Force", "Brute-Force"), ("web attack XSS", "XSS"), ("Web Attack SQL Injection", "SQL-Injection"), ("Web Attack odd", "Web-Attack-odd")])
def test_subtype_slug(spark, label, slug):
    assert one(spark, label, t.subtype_slug, "string") == slug


def test_ascii_lower_leaves_other_letters(spark):
    assert one(spark, "USER \u00c4\u212a\u00c9", t.ascii_lower, "string") == "user \u00c4\u212a\u00c9"


def test_bits_and_padding(spark):
    assert one(spark, b"\x05", lambda c: t.bit_matrix(c)) == [[True, False, True, False, False, False, False, False]]
    assert one(spark, b"", t.bit_matrix) == []
    assert bytes(one(spark, b"ab", lambda c: t.zero_padded(c, 4))) == b"ab\0\0"
    assert bytes(one(spark, b"abcde", lambda c: t.zero_padded(c, 4))) == b"abcde"


def test_credentials_stand_in_front(spark):
    assert one(spark, "user x", t.starts_with_credential, "string")
    assert not one(spark, "a USER", t.starts_with_credential, "string")


def test_names_and_cells(spark):
    df = spark.createDataFrame([("DoS", "DoS Hulk"), ("BENIGN", None)], "c string, s string")
    assert [r[0] for r in df.select(t.reservoir_name(F.col("c"), F.col("s"))).collect()] == ["DoS_DoS_Hulk", "BENIGN"]
    assert one(spark, "a_b", t.escaped_cell, "string") == "a\\_b"
    assert one(spark, "abc", lambda c: t.padded(c, 2), "string") == "abc"
