import pytest

from lexloom.llm.lookalikes import disguised, plain_form, unify


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("ｌａ chaudière", "la chaudière"), ("dépôt", "dépôt"), ("l\u2060e site", "le site"), ("le\u00a0bruit\u3000fort", "le bruit fort"),
        ("νaіⅼ sаnѕ ԁéⅼаi", "vail sans délai"), ("ﬁlière", "filière"), ("𝐀RRÊTÉ", "ARRÊTÉ"), ("AΝNEXΕ Α", "ANNEXE A"), ("sοсіе́té", "société"),
        ("écart Δ de 12 Ω, η × ½", "écart Δ de 12 Ω, η × ½"), ("barge « Ладья »", "barge « Ладья »"), ("30 m², 5 µg/m³, n° 4 – l’eau de¬", "30 m², 5 µg/m³, n° 4 – l’eau de¬"),
    ],
)
def test_plain_form(raw, plain):
    assert plain_form(raw) == plain
    assert plain_form(plain) == plain


def test_dirty_rows(spark):
    long = "ｘ" + "eau " * 50_000
    rows = [(1, "ｌa", "a"), (1, "ｌa", "b"), (2, None, "c"), (3, "", "d"), (4, "la", "e"), (5, long, "f"), (6, "la\u200b", "g")]
    df = spark.createDataFrame(rows, "k int, t string, plain string")
    assert {r["k"] for r in disguised(df, ["k"], "t").collect()} == {1, 5, 6}
    out = unify(df, "t", "plain").collect()
    assert len(out) == 7 and {r["k"]: r["plain"] for r in out}[6] == "la" and {r["k"]: r["plain"] for r in out}[2] is None
    assert disguised(df.limit(0), ["k"], "t").count() == 0


def test_equal_looking_values_become_equal(spark):
    df = spark.createDataFrame([(1, "e\u0301t\u0435"), (2, "\u00e9te"), (3, "é\u200bt\uff45")], "k int, t string")
    assert {r["plain"] for r in unify(df, "t").collect()} == {"éte"}


def test_plain_rows_stay_spread(spark):
    """Plain rows take no part in the join: no partition of the result holds much more than its share."""
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "if(id % 100 = 0, 'ｌa', 'la') AS t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = unify(df, "t")
        sizes = out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 500
    assert unify(df, "t", "t").where("t <> 'la'").count() == 0
