import random

import pytest
from pyspark.sql import functions as F

from tests.model import lcs
from tributary.functions import dates, similarity, text


def values(spark, inputs, fn, cast="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {cast}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


def test_null_tokens_and_trimming(spark):
    assert values(spark, ["  x ", "NaN", "none", " NULL", "", "N/A", "<na>", "na na", "\tnull\n", "\x0bx\f", None], lambda _: text.clean("v")) == [
        "x", None, None, None, None, None, None, "na na", None, "x", None]


def test_name_case_touches_only_single_case_names(spark):
    given = ["  ADITI  ", "o'brien", "McDonald", "MARY  ANN", "ABC-DEF", "1abc", "x"]
    assert values(spark, given, text.name_case) == ["Aditi", "O'Brien", "McDonald", "Mary Ann", "Abc-Def", "1Abc", "X"]


def test_title_equals_python_title(spark):
    given = ["o'brien mc-donald", "1abc 2DEF", "", "ÉLAN vital", "a.b.c"]
    assert values(spark, given, text.title) == [v.title() for v in given]


def test_full_name_split(spark):
    given = ["asha  devi RAO ", "Cher", " "]
    assert values(spark, given, lambda c: text.split_full_name(c)[0]) == ["Asha", "Cher", ""]
    assert values(spark, given, lambda c: text.split_full_name(c)[1]) == ["Devi Rao", "", ""]


def test_phone_numbers(spark):
    given = ["09876500015", "+91 9988776655", "022-28371928", "9823456781", "+1 (415) 555-2671", "12", "919823456781", "ext"]
    assert values(spark, given, text.phone_e164) == [
        "+919876500015", "+919988776655", "+912228371928", "+919823456781", "+14155552671", "12", "+919823456781", None]
    assert values(spark, ["415-555-2671"], lambda c: text.phone_e164(c, "US")) == ["+14155552671"]


def test_emails_and_numbers(spark):
    assert values(spark, ["  A B@X.com "], text.email) == ["ab@x.com"]
    assert values(spark, ["1,200", "$5.5", "-3", "12d", "x", "1e3"], text.to_number) == [1200.0, 5.5, -3.0, None, None, 1000.0]


@pytest.mark.parametrize("cells, order", [
    (["13/04/1988", "05/06/1990"], "DMY"),
    (["04/13/1988", "05/06/1990"], "MDY"),
    (["2021-06-05", "2020-12-13"], "YMD"),
    (["05/06/1990", "1/2/2000"], "AMBIGUOUS"),
    (["13/04/1988", "04/13/1988"], "AMBIGUOUS"),
    (["16/02/1986", "1992-05-14", "junk"], "DMY"),
    (["05-Sep-2020", "06-Oct-2020"], "DMonY"),
    (["junk"], None),
])
def test_column_date_order(spark, cells, order):
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    assert df.agg(dates.order_of_column(F.col("v"))).first()[0] == order


def test_more_date_forms(spark):
    given = ["05/01/20", "05-01-69", "2020/01/05", "2020.1.5", "Jan 5, 2020", "05 January 2020", "5-sep-2020", "2020-01-05T00:00:00", "2020-01-05 23:59:59.5Z",
             "Janner 5, 2020", "2020-13-45T00:00:00"]
    assert values(spark, given, lambda c: dates.to_iso(c, F.lit("DMY"))) == [
        "2020-01-05", "1969-01-05", "2020-01-05", "2020-01-05", "2020-01-05", "2020-01-05", "2020-09-05", "2020-01-05", "2020-01-05",
        "Janner 5, 2020", "2020-13-45T00:00:00"]
    assert values(spark, given[:1], lambda c: dates.to_iso(c, F.lit("AMBIGUOUS"))) == [None]


def test_dates_to_iso(spark):
    given = ["13/04/1988", "2021-06-05", "05-SEP-2020", "31/02/2020", "junk", "1/2/2020", None]
    assert values(spark, given, lambda c: dates.to_iso(c, F.lit("DMY"))) == [
        "1988-04-13", "2021-06-05", "2020-09-05", "31/02/2020", "junk", "2020-02-01", None]
    # an undecided order withholds numeric dates but never touches ISO ones
    assert values(spark, given, lambda c: dates.to_iso(c, F.lit("AMBIGUOUS")))[:2] == [None, "2021-06-05"]


def test_lcs_against_table(spark):
    rnd = random.Random(3)
    def word(n):
        return "".join(rnd.choice("abcd ") for _ in range(n))
    pairs = [(word(rnd.randint(0, 90)), word(rnd.randint(0, 90))) for _ in range(200)] + [("a" * 62, "a" * 63), ("a" * 63, "ba" * 70)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.lcs_length(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == lcs(r.a, r.b)


def test_similarity_goldens(spark):
    pairs = [("rahul sharma", "rahul sherma"), ("e mail", "email"), ("e mail", "e-mail"), ("ref", "mgr"), ("x", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [round(r[0], 2) for r in df.orderBy("i").select(similarity.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [91.67, 90.91, 83.33, 33.33, 100.0]
    assert values(spark, ["Sharma  RAHUL"], similarity.sorted_tokens) == ["rahul sharma"]


def test_lcs_of_texts_that_begin_and_end_alike(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    long = "naabc" * 30
    cases = [("aaa", "aa"), ("", ""), ("", "a"), ("a", "a"), ("abab", "ab"), ("xay", "xby"), ("fam naab", "fam naaab"), ("😀a😀", "😀b😀"), ("😀", "😁"),
             (long + "x" + long, long + "yy" + long), ("abcba", "abba"), ("aXa", "a")]
    df = spark.createDataFrame([*cases, (None, "a"), ("a", None)], "a string, b string")
    got = [r.n for r in df.select(similarity.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [*(plain(a, b) for a, b in cases), None, None]
