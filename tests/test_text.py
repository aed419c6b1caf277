"""Text functions on Cyrillic and edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.udfs import html_unescape, matched_share, nfkc, title_case
from marlstone.operators.index import entity_text


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(f(*[F.col(n) for n in names]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("0,9л", "0.9 л"), ("20кг", "20 кг"), ("Шпатлёвка", "шпатлевка"), ("краска, 2,7 л!", "краска 2.7 л"), ("", ""), (None, ""), ("  а  б ", "а б"), ("5 лет", "5 лет")],
)
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize_text, raw) == want


def test_entity_text_and_transliteration(spark):
    assert one(spark, entity_text, "  ТИКУРИЛА! ") == "тикурила"
    assert one(spark, lambda c: tx.transliterate(entity_text(c)), "Тикурила") == "tikurila"
    assert one(spark, lambda c: tx.transliterate(entity_text(c)), "Щётка-объём") == "shchetka-obem"
    assert one(spark, nfkc, "ﬁn") == "fin"


def test_keywords_split_on_yo(spark):
    assert one(spark, tx.keywords, "шпатлёвка для а стен стен") == ["шпатл", "вка", "стен", "стен"]


@pytest.mark.parametrize(("text", "alias", "want"), [("латексная краска", "лак", False), ("белый лак", "лак", True), ("лак", "", False), ("a.b", "a.b", True), ("axb", "a.b", False)])
def test_contains_phrase(spark, text, alias, want):
    assert one(spark, tx.contains_phrase, text, alias) is want


def test_amounts(spark):
    w = lambda c: tx.amount_value(tx.first_amount(c, tx.WEIGHT_UNITS))
    assert one(spark, w, "краска 0.6 кг и 5 кг") == 0.6
    assert one(spark, w, "краска кг") is None
    assert one(spark, lambda c: tx.name_amount(c, tx.VOLUME_UNITS), "Краска N0,9л") == 0.9


def test_markup_and_reply(spark):
    assert one(spark, tx.strip_markup, "<b> a&nbsp;&amp; b</b>\n") == "a & b"
    assert one(spark, tx.strip_markup, "<b></b>") is None
    assert one(spark, tx.strip_markup, "a &mdash; b &#1078; &laquo;c&raquo; &amp;lt; &copy 1") == "a — b ж «c» &lt; © 1"
    assert one(spark, tx.strip_markup, "a&amp;lt;") == "a&lt;"
    assert one(spark, tx.tidy_reply, " a  b \n\n\n\nc ") == "a b\n\nc"
    assert one(spark, html_unescape, "&eacute;&#x41;") == "éA"
    assert one(spark, title_case, "ручной-инструмент, a1b") == "Ручной-Инструмент, A1B"


def test_matched_share_order_and_empty(spark):
    assert round(one(spark, matched_share, "тикула", "тикурила"), 6) == 0.857143
    assert one(spark, matched_share, "", "x") == 0.0
    assert one(spark, matched_share, None, "x") == 0.0


def test_plurals(spark):
    assert [one(spark, tx.title_plural, x) for x in ("Валик", "лак", "краска", "кисть", "профилb")] == ["валки", "лаки", "краски", "кисти", "профилbы"]
    assert [one(spark, tx.plural, x) for x in ("Валик", "краска", "обои")] == ["валики", "краски", "обоиы"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="аб ёл9,.кгkl-!Ж\n", max_size=30))
def test_normalize_is_idempotent(spark, raw):
    once = one(spark, tx.normalize_text, raw)
    assert one(spark, entity_text, one(spark, entity_text, raw)) == one(spark, entity_text, raw)
    assert once == once.strip()
