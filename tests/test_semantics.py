"""Sort specifications, paging, LIKE patterns and number rules."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import semantics as S

SPEC = {"foo": [], "bar": ["bar"], "baz": ["baz", "!foo"], "low": ["lower(foo)"]}


def shown(sort=None, order="asc", spec=SPEC):
    return [str(c) for c in S.sort_keys(spec, sort, order)]


@pytest.mark.parametrize(
    "sort,order,want",
    [
        (None, "asc", ["foo ASC"]),
        ("foo", None, ["foo ASC"]),
        ("foo", "desc", ["foo DESC"]),
        ("foo", "DESC", ["foo DESC"]),
        ("bar", "asc", ["bar ASC"]),
        ("baz", "asc", ["baz ASC", "foo DESC"]),
        ("baz", "desc", ["baz DESC", "foo ASC"]),
    ],
)
def test_sort_keys(spark, sort, order, want):
    assert [w in s for w, s in zip(want, shown(sort, order), strict=True)] == [True] * len(want)


def test_sort_errors(spark):
    for sort, order in (("unknown", "asc"), ("foo", "sideways")):
        with pytest.raises(ValueError):
            shown(sort, order)


def test_like_patterns():
    assert S.like_escape("a%b_c@d") == "a@%b@_c@@d"
    assert S.like_contains("foo") == "%foo%" and S.like_contains("") == "%%" and S.like_contains(None) == "%%"
    assert S.like_prefix("x_") == "x@_%" and S.like_prefix(None) == "%"


def test_matching_folds_ascii_only(spark):
    df = spark.createDataFrame([("Straße",), ("ÄB",), ("a_b",), ("axb",), (None,)], "k string")
    found = lambda q: {r.k for r in S.matching(df, q, "k").collect()}
    assert found("STRA") == {"Straße"} and found("äb") == set() and found("_") == {"a_b"}
    assert len(found("")) == len(found(None)) == 5


def test_numbers(spark):
    rows = [("12abc", 12.0), ("abc", 0.0), ("-3.5e2x", -350.0), ("", 0.0), (None, 0.0), (" 7", 7.0), (".5", 0.5)]
    df = spark.createDataFrame(rows, "t string, want double").select(S.number_prefix("t").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    one = spark.range(1).select(S.fraction(F.lit(1), F.lit(0)).alias("none"), S.fraction(F.lit(1), 3).alias("third"), S.fraction(F.lit(1), 3, None).alias("raw")).first()
    assert one.none is None and one.third == 0.3333 and one.raw == pytest.approx(1 / 3)


def test_pages_do_not_overlap(spark):
    df = spark.range(25).select((F.col("id") % 3).alias("foo"), F.col("id").alias("bar"))
    spec = {"foo": [], "bar": []}
    seen = [r.bar for p in (1, 2, 3) for r in S.sorted_page(df, spec, "foo", "asc", p, 10).collect()]
    assert sorted(seen) == list(range(25))
    for page, rp in ((0, 10), (1, 0), (1, 1000), (1, None)):
        with pytest.raises(ValueError):
            S.sorted_page(df, spec, "foo", "asc", page, rp)
