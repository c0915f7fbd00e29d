import pytest
from pyspark.sql import functions as F

from dealweave.functions import numeric as n
from dealweave.functions import periods as p
from dealweave.functions import text as t


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("x, digits, want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (0.125, 2, 0.13), (-0.125, 2, -0.12)])
def test_half_up(spark, x, digits, want):
    assert value(spark, n.half_up(F.lit(x), digits)) == want


@pytest.mark.parametrize("text, number, percent", [("1,234", 1234.0, 1234.0), ("(8)", -8.0, -8.0), ("$5", 5.0, 5.0), ("12.5%", 12.5, 12.5), ("0.5%", 0.5, 50.0), ("n/a", None, None), ("", None, None), ("$", None, None), ("about 7.25 % p.a.", None, 7.25), (None, None, None), ("1e3", 1000.0, 1000.0)])
def test_numbers(spark, text, number, percent):
    c = F.lit(text).cast("string")
    assert value(spark, n.to_number(c)) == number and value(spark, n.to_percent(c)) == percent


def test_differences(spark):
    assert value(spark, n.relative_difference(F.lit(90.0), F.lit(100.0))) == pytest.approx(0.1)
    assert value(spark, n.relative_difference(F.lit(0.0), F.lit(0.5))) == pytest.approx(0.5)
    assert value(spark, n.scale_signal(F.lit(1000.0), F.lit(1.0))) == "1,000x" and value(spark, n.scale_signal(F.lit(2.0), F.lit(1.0))) is None
    assert value(spark, n.growth_rate(F.lit(100.0), F.lit(121.0), F.lit(3))) == pytest.approx(10) and value(spark, n.growth_rate(F.lit(-1.0), F.lit(1.0), F.lit(3))) is None
    assert value(spark, n.clamp(F.lit(float("nan")), 0, 1, 0.0)) == 0.0 and value(spark, n.to_millions(F.lit(1_250_000.0))) == 1.3
    assert [value(spark, n.confidence_label(F.lit(x))) for x in (0.9, 0.6, 0.1, 0.0)] == ["high", "medium", "low", "none"]


@pytest.mark.parametrize(
    "label, key, granularity",
    [("FY 2022", "2022", "year"), ("2024E", "2024", "year"), ("Q3-24", "2024-Q3", "quarter"), ("2024-Q1", "2024-Q1", "quarter"), ("24-Q1", "2024-Q1", "quarter"), ("2024-03", "2024-03", "month"), ("March 2024", "2024-03", "month"), ("Dec-22", "2022-12", "month"), ("TTM", "LTM", "ltm"), ("Sales FY2023 net", "2023", "year"), ("Metric", None, None), ("", None, None), (None, None, None)],
)
def test_periods(spark, label, key, granularity):
    got = value(spark, p.parse_period(F.lit(label).cast("string")))
    assert (got.period_key, got.granularity) == (key, granularity) if key else got is None


def test_compatible_periods_and_helpers(spark):
    assert value(spark, p.parse_period(F.lit("Q1 2024"), strict_compat=True)["period_key"]) == "2024"
    assert value(spark, p.period_of(F.lit("Notes"), F.lit("file 2021"))) == "2021" and value(spark, p.period_of(F.lit("Notes"))) == "_single"
    assert value(spark, p.describe_period(F.lit("_single")))[1] == "point_in_time"
    assert [value(spark, p.is_value_period(F.lit(x))) for x in ("2023", "2023 growth", "Value", "")] == [True, False, True, False]
    assert str(value(spark, p.to_day(F.lit("May 22, 2024")))) == "2024-05-22" and value(spark, p.to_day(F.lit("2024-02-30"))) is None


def test_text(spark):
    assert value(spark, t.normalize_label(F.lit("Net PP&E (in thousands)"))) == "net property plant equipment"
    assert value(spark, t.strip_noise(F.lit("total assets for the year ended"))) == "total assets"
    assert value(spark, t.label_words(F.lit("adjusted ebitda a margin"))) == ["ebitda", "margin"]
    assert value(spark, t.entity_key(F.lit("Smith & Sons, Inc."))) == "smith and sons"
    assert value(spark, t.word_overlap(F.lit("a b c"), F.lit("a b"))) == pytest.approx(2 / 3)
    assert value(spark, t.humanize(F.lit("netChangeInCash"))) == "Net Change In Cash" and value(spark, t.slug(F.lit(" A/B  C. "))) == "a-b-c"
    assert value(spark, t.first_sentence(F.lit("One is 1.5 here. Two follows."))) == "One is 1.5 here."
    assert value(spark, t.keyword_signal(F.lit("debt schedule of loans"), F.array(F.lit("debt"), F.lit("loan"), F.lit("x")), 0.5, 0.2)) == pytest.approx(0.7)
    assert value(spark, t.source_key(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a::::b"


def test_shown_amounts_and_label_forms(spark):
    from dealweave.functions.text import evidence_label, ignorable_label, plain_file_name, review_label, shown_amount, shown_percent

    df = spark.createDataFrame([("A/R & Other_(net), 5%", -1234.4), ("Note 4", 0.0), (None, None)], "s string, x double")
    c, x = F.col("s"), F.col("x")
    got = [tuple(r) for r in df.select(review_label(c), evidence_label(c), plain_file_name(c), ignorable_label(c), shown_amount(x), shown_percent(x)).collect()]
    assert got == [("a r and other net , 5%", "a r other net 5", "a/r & other (net), 5%", False, "-$1,234", "-1,234.4%"), ("note 4", "note 4", "note 4", True, "$0", "0.0%"), (None,) * 6]
