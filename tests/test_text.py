import hashlib
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.numbers import to_nullable_long
from gleaner.functions.text import (
    fold, stable_id, strip, tokens, whitespace,
)

SOME = settings(
    max_examples=5,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


ANY = st.characters(exclude_categories=("Cs", "Cn", "Co"))
LATIN = "".join(
    chr(c)
    for c in (*range(0x20, 0x590), *range(0x1E00, 0x2000))
    if unicodedata.category(chr(c)) not in ("Cs", "Cn")
)


def fold_text(text):
    """Decomposed, without non-spacing marks, lower case."""
    parts = unicodedata.normalize("NFD", text)
    return "".join(c for c in parts if unicodedata.category(c) != "Mn").lower()


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def results(df, expr):
    return [row[0] for row in df.select(expr).collect()]


def test_stable_id_strips_all_whitespace(spark):
    url = "  https://vnexpress.net/đồng-1.html \t\n"
    df = column(spark, [url, url.strip()])
    assert results(df, stable_id("x")) == [862927609749264347] * 2


@SOME
@given(st.lists(st.text(alphabet=LATIN + whitespace(), max_size=30), min_size=1, max_size=40))
def test_ids_and_strip_equal_python(spark, texts):
    df = column(spark, texts)
    assert results(df, strip("x")) == [t.strip() for t in texts]
    digests = [hashlib.sha256(t.strip().encode()).hexdigest() for t in texts]
    assert results(df, stable_id("x")) == [int(d[:15], 16) for d in digests]


def test_fold_keeps_d_with_stroke(spark):
    df = column(spark, ["Đồng TIỀN Việt", "ABC", None, ""])
    assert results(df, fold("x")) == ["đong tien viet", "abc", None, ""]
    assert "dong" not in fold_text("Đồng")


@SOME
@given(st.lists(st.text(alphabet=LATIN, max_size=30), min_size=1, max_size=60))
def test_fold_equals_python(spark, texts):
    df = column(spark, texts)
    assert results(df, fold("x")) == [fold_text(t) for t in texts]


@SOME
@given(st.lists(st.text(st.one_of(ANY, st.sampled_from("\uac00\ud55c\ud7a3ভো😀ẞﬁ")), max_size=20), min_size=1, max_size=60))
def test_fold_of_any_script_decomposes_letters(spark, texts):
    # Letter case of rare scripts depends on the Unicode version; it is not compared.
    df = column(spark, [t for t in texts if t.lower() == t])
    assert results(df, fold("x")) == [fold_text(t) for t in texts if t.lower() == t]


def test_fold_takes_hangul_and_several_bases_apart(spark):
    texts = ["한국 뉴스", "Đồng", None, "ೋ", "ভালো", "a😀b한", "각가힣"]
    expected = [t if t is None else fold_text(t) for t in texts]
    assert results(column(spark, texts), fold("x")) == expected


def test_comments_round_half_even(spark):
    cases = {
        "2.5": 2, "3.5": 4, "abc": None, "": None, "1e3": 1000, "1,200": None,
        "1d": None, "inf": None, "NaN": None, "-2.5": -2, " 7 ": 7, ".5": 0,
    }
    df = column(spark, [*cases, None])
    assert results(df, to_nullable_long(F.col("x"))) == [*cases.values(), None]


def test_tokens(spark):
    df = column(spark, ["The the, cat.\n", "", " ! "])
    assert results(df, tokens("x")) == [["the", "cat"], [], []]
