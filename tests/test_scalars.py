"""Scalar functions against Python."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from codelode.functions import scalars as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v").alias("r")).first()[0]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (X.language_of, "a/b.py", "python"), (X.language_of, "a/B.PY", None), (X.language_of, "a/.py", None), (X.language_of, "x.tar.md", "markdown"),
        (X.language_name, "cpp", "C++"), (X.language_name, "fortran", "Fortran"), (X.is_ignored, "a/node_modules/x.js", True), (X.is_ignored, "a/mybuild/x.js", False),
        (X.is_text_file, "a/README", True), (X.is_text_file, "a/X.SQL", True), (X.is_text_file, "a/x.bin", False), (X.repo_dir, "https://h/u/my repo.git", "my_repo"),
        (X.last_segment, "a.b.c", "c"), (X.line_count, "", 0), (X.line_count, "a\nb", 2), (X.line_count, "a\nb\n", 2), (X.word_count, " a  b\n", 2), (X.token_count, "a_1 + é", 3),
        (X.listing_prefix, "./src", "src/"), (X.listing_prefix, ".", ""), (X.listing_prefix, "a\\b/", "a/b/"), (X.task_name, "Ingest Branch: main", "Ingesting Branch: main"),
        (X.task_name, "find_dead_code", "Find Unused Code"), (X.file_name_safe, ' a<b>:"  c? ', "ab c"), (X.is_playlist, "x?list=1", True), (X.font_family, "ABC+Times-Roman", "Times New Roman, serif"),
        (X.font_family, "", "Arial, sans-serif"), (X.path_safe, "a/b", "a_b"), (X.is_spoken, " [Music] ", False), (X.is_spoken, "hello", True), (X.is_spoken, "  ", False),
    ],
)
def test_strings(spark, make, value, want):
    assert one(spark, value, make) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1152, "1.12 KB"), (1024**2 * 3, "3.00 MB"), (1024**3 * 5 // 2, "2.50 GB")])
def test_bytes(spark, n, want):
    assert one(spark, n, X.format_bytes, "long") == want


@pytest.mark.parametrize(("s", "want"), [(-5, "0s"), (59, "59s"), (60, "1m 0s"), (3600, "1h 0m 0s"), (3725, "1h 2m 5s")])
def test_duration(spark, s, want):
    assert one(spark, s, X.duration, "long") == want
    assert one(spark, 3725, X.minutes_seconds, "long") == "62:05"


def test_fonts_and_colours(spark):
    assert [one(spark, v, X.color_code, "int") for v in (0, 255, 0xFF8800)] == ["#000000", "#0000ff", "#ff8800"]
    assert one(spark, 16, X.font_weight, "int") == "bold"
    assert one(spark, 64, X.font_style, "int") == "italic"


def test_partition_names(spark):
    rows = spark.createDataFrame([(".",), ("Src/My Dir!",), ("x" * 80,)], "d string").select(X.partition_name(F.lit("0a1b2c3d4e"), "d")).collect()
    assert [r[0] for r in rows] == ["repo_0a1b2c3d__root", "repo_0a1b2c3d_src_my_dir", ("repo_0a1b2c3d_" + "x" * 80)[:63]]


def test_ancestors(spark):
    assert one(spark, "a/b/c.py", X.ancestors) == ["a/b", "a", "."]
    assert one(spark, "c.py", X.ancestors) == ["."]


def test_slices(spark):
    d = spark.createDataFrame([("héllo\nb\nc\n",)], "t string")
    row = d.select(X.slice_content("t", F.lit(1), F.lit(5)), X.slice_content("t", F.lit(5), F.lit(99)), X.line_snippet("t", F.lit(2), F.lit(3)), X.line_snippet("t", F.lit(None).cast("int"), F.lit(3)), X.line_snippet("t", F.lit(9), F.lit(9)), X.replace_lines("t", 2, 2, "X"), X.replace_lines("t", 2, 9, "X")).first()
    assert list(row) == ["éllo", None, "b\nc\n", "// Content not available (incomplete data)", "", "héllo\nX\nc\n", "héllo\nb\nc\n"]


def test_snippet(spark):
    assert one(spark, "a\nb\nc\nd", X.snippet) == "a\nb\nc\n..."
    assert one(spark, "word " * 60, X.snippet) == ("word " * 60)[:150].rsplit(" ", 1)[0] + "..."
    assert one(spark, "a\nb", X.snippet) == "a\nb"


def test_importance(spark):
    d = spark.createDataFrame([("class_definition", True, 6, 300), ("method_declaration", False, 1, 10), ("x", False, None, 50)], "t string, d boolean, c int, n int")
    assert [round(r[0], 6) for r in d.select(X.importance("t", "d", "c", "n")).collect()] == [1.0, 0.5, 0.5]


def test_complexity(spark):
    d = spark.createDataFrame([(["if_statement", "call", "for_statement"], "python"), (["if_statement"], "css")], "t array<string>, l string")
    assert [r[0] for r in d.select(X.complexity("t", "l")).collect()] == [3, 1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=8))
def test_content_functions_on_any_text(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in d.select("i", "t", X.content_hash("t").alias("h"), X.word_count("t").alias("w"), X.line_count("t").alias("n")).collect():
        t = texts[r.i]
        assert r.h == hashlib.sha256(t.encode()).hexdigest()
        assert r.w == len(re.findall(r"[^ \t\n\r\f\x0b]+", t))
        assert r.n == t.count("\n") + (bool(t) and not t.endswith("\n"))


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [float("nan"), 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = d.select(X.norm("a"), X.unit("a"), X.without_nan("b")).collect()
    assert rows[0][0] == 5 and rows[0][1] == [0.6, 0.8] and rows[0][2] == [0, 1] and rows[1][1] is None
