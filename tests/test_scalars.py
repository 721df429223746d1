from pyspark.sql import functions as F

from docsleuth.functions import scalars as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_amounts(spark):
    for text, want in [("Rs 85,000.50", 8500050), ("12-34", None), ("", None), ("none", None), ("-5", -5)]:
        assert one(spark, X.parse_amount(F.lit(text))) == want


def test_number_words(spark):
    for text, want in [("Two Hundred Seventy Three Thousand Eighty Two", 273082), ("nine thousand", 9000), ("one million and two", 1000002), ("two foo", None), ("", None)]:
        assert one(spark, X.number_words(F.lit(text))) == want


def test_labels_and_slugs(spark):
    assert one(spark, X.normalize_label(F.lit(" NET PAY (TAKE HOME) "))) == "net_pay_take_home"
    assert one(spark, X.slug(F.lit("a b/c"))) == "a_b_c"


def test_dates(spark):
    for text in ("5-1-2026", "05-Jan-2026", "05/01/2026"):
        assert str(one(spark, X.bank_date(F.lit(text)))) == "2026-01-05"
    assert one(spark, X.bank_date(F.lit("soon"))) is None
    assert str(one(spark, X.pay_period(F.lit("January 2026"), F.lit(None)))) == "2026-01-01"


def test_identity_numbers(spark):
    assert one(spark, X.pan_entity(F.lit("abcpe1234f"))) == "Individual"
    assert one(spark, X.pan_surname_initial(F.lit("ABCPE1234F"))) == "E"
    assert one(spark, X.pan_entity(F.lit("bad"))) is None


def test_registered_sql_functions(spark):
    X.register(spark)
    row = spark.sql("SELECT parse_amount('Rs 10') a, normalize_label('A b') b, pan_valid('abcpe1234f') c, cosine_display(0.4D) d").first()
    assert tuple(row) == (10, "a_b", True, 60.0)


def test_jaccard_and_quality(spark):
    assert one(spark, X.word_jaccard(F.lit("A b c"), F.lit("b c d"))) == 0.5
    assert one(spark, X.word_jaccard(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, X.text_quality(F.lit("ABCDE1234F has 123456789012"))) == 1.0
