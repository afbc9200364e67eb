"""Operators of the core against their SQL on the smallest tables, and against hand-made answers."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folio import catalog
from folio.functions.text import clean_special, heading_level, sentence_split, utrim
from folio.operators import geometry, pages

FOLDER = os.environ.get("FOLIO_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect()) == rows(want.project(", ".join(f'"{c}"' for c in got.columns)).fetchall())


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("line,level", [("# a", 1), (" \t### b", 3), ("####### c", 0), ("#d", 0), ("## ", 0), (None, 0)])
def test_heading_level(spark, line, level):
    assert one(spark, heading_level, line) == level


def test_trim_and_clean(spark):
    assert one(spark, utrim, "　 a\tb \n") == "a\tb"
    assert one(spark, clean_special, "a\n\n\n# b  c\t") == "a\n b c"
    assert one(spark, clean_special, "| a |\n\n| b |") == "| a |\n\n| b |"


def test_sentence_split(spark):
    assert one(spark, lambda c: sentence_split(c, 8), "One. Two. Three") == ["One.", "Two.", "Three"]
    assert one(spark, lambda c: sentence_split(c, 3), "abcdefg") == ["abc", "def", "g"]
    assert one(spark, lambda c: sentence_split(c, 3), "") == []


LINES = [("d", 1, 0, "A"), ("d", 1, 1, "B"), ("d", 1, 2, "C"), ("d", 2, 0, "D"), ("d", 2, 1, "")]


@pytest.mark.parametrize(
    "rules,kept",
    [
        ([pages.DropRule(contains=("B",))], "ACD"),
        ([pages.DropRule(contains=("B",), pages=(2,))], "ABCD"),
        ([pages.DropRule(contains=("B",)), pages.DropRule(contains=("C",))], "AD"),
        ([pages.DropRule(contains=("B",), whole_box=True)], "D"),
        ([pages.DropRule(regex=("(invalid",), contains=("D", ""))], "ABC"),
        ([pages.DropRule(regex=("^[AB]$",))], "CD"),
    ],
)
def test_drop_rules(spark, rules, kept):
    df = spark.createDataFrame(LINES, "doc string, page int, line_no int, line string")
    assert "".join(sorted(r.line for r in pages.drop_lines(df, rules).collect())) == kept


def test_snap_and_join(spark):
    df = spark.createDataFrame([(1, "h", 10.0, 0.0, 5.0), (1, "h", 12.0, 7.0, 9.0), (1, "h", 30.0, 0.0, 1.0)], "page int, orient string, pos double, lo double, hi double")
    assert rows(geometry.joined(geometry.snapped(df)).collect()) == [(1, "h", 11.0, 0.0, 9.0), (1, "h", 30.0, 0.0, 1.0)]


def test_registry_without_optional_part():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_files_in_and_out(spark, tmp_path):
    from folio import sources

    (tmp_path / "a.md").write_text("# a\ntext")
    (tmp_path / "b.md").write_text("")
    docs = sources.text_documents(spark, str(tmp_path / "*.md"))
    assert sorted(r.text or "" for r in docs.collect()) == ["# a\ntext"]
    sources.write_json(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == docs.count()
