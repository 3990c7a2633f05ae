from pyspark.sql import functions as F

from lexloom.functions.patterns import Found, choice, find, find_all, folded, group, render, repeat, sequence, text, with_siblings

NUMBER = choice(text(r"[lrd]\. ?\d+-\d+", "code"), text(r"\d+", "simple"))
ARTICLES = sequence("articles? ", repeat(group("number", NUMBER), 1, None, r"(?:, | et )"))


def test_tree_of_a_match():
    flow = list(find(ARTICLES, "Vu les Articles R. 5-2, 7 et 12 du code"))
    assert flow[0] == "Vu les " and flow[2] == " du code"
    found = flow[1]
    assert isinstance(found, Found) and found.text == "Articles R. 5-2, 7 et 12" and found.start == 7
    assert [g.captures for g in found.groups] == [{"code": "R. 5-2"}, {"simple": "7"}, {"simple": "12"}]


def test_flows():
    assert render(find(text("arrete"), "Un Arrêté, arrêté"), lambda f: f"<{f.text}>") == "Un <Arrêté>, <arrêté>"
    assert with_siblings(find(text(r"vu "), "avant Vu un Vu deux")) == ["avant ", "Vu un ", "Vu deux"]
    assert list(find(text("x*"), "")) == [] and list(find(text("z"), "abc")) == ["abc"]
    assert len(folded("İÉ«x»")) == 5


def test_column(spark):
    df = spark.createDataFrame([("les articles 1 et 2",), (None,), ("",)], "t string")
    out = [r["s"] for r in df.select(find_all(ARTICLES, F.col("t")).alias("s")).collect()]
    assert out[0][0]["start"] == 4 and out[0][0]["captures"] == {"simple": "2"} and out[1] is None and out[2] == []
