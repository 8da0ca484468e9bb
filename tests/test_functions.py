import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaptable.functions.keys import Key
from snaptable.functions.lenient import NotANumber, integer, integer_column


def test_keys_compare_within_a_kind():
    assert Key(1) < Key(2) and Key(5) > Key(3) and Key(2) <= Key(2) and Key(3) != Key(4)
    assert Key("aa") < Key("bb") and Key("Z") < Key("a") and Key("10") < Key("9")
    assert Key(1.5) < Key(2.5) and Key(3.14).kind == "float" and Key(3.14).value != 3.14  # 32 bits
    assert str(Key(42)) == "42" and str(Key("")) == "" and Key(-2147483647) < Key(2147483647)
    assert len({Key(1), Key(1), Key("1")}) == 2


@pytest.mark.parametrize("other", [Key("a"), Key(1.0)])
def test_keys_of_two_kinds_do_not_compare(other):
    with pytest.raises(TypeError):
        assert Key(1) < other
    with pytest.raises(TypeError):
        Key(None)


@pytest.mark.parametrize(("text", "number"), [("7", 7), ("007", 7), ("  -12abc", -12), ("+5", 5), ("12 34", 12), ("9223372036854775807", 2**63 - 1)])
def test_integers_as_text_begins(text, number):
    assert integer(text) == number


@pytest.mark.parametrize("text", ["", "x", "-", "a1", "9223372036854775808"])
def test_texts_without_an_integer(text):
    with pytest.raises(NotANumber):
        integer(text)


def test_the_column_agrees(spark):
    rows = [("7",), ("007",), ("  -12abc",), ("+5",), ("12 34",)]
    found = spark.createDataFrame(rows, "t string").select("t", integer_column(F.col("t")).alias("n")).collect()
    assert all(r.n == integer(r.t) for r in found)
    for bad in ("x", "9223372036854775808"):
        with pytest.raises(Exception, match="stoll"):
            spark.createDataFrame([(bad,)], "t string").select(integer_column(F.col("t"))).collect()


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), max_size=20))
def test_string_keys_sort_by_bytes(texts):
    assert [k.value for k in sorted(map(Key, texts))] == sorted(texts, key=str.encode)
