"""Behaviour of the operators on orders: titles, numbers, dates, references, operations, nesting, links."""

import pytest
from pyspark.sql import functions as F

from lexloom.config import run_pipeline
from lexloom.functions import numbering, text, uri
from lexloom.operators import lines, references, segmentation, tree


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


TITLES = {
    "TITRE I - Premier titre": ("titre", "i"), "ARTICLE 1er": ("article", "1"), "Article 2-1 Article": ("article", "2-1"),
    "II.1.1 - Sous-titre": ("unknown", "ii.1.1"), "ANNEXE ": ("annexe", ""), "5.3CHAPITRE": ("unknown", "5.3"), "Article premier :": ("article", "premier"),
}
NOT_TITLES = ["M. le Maire de", "3. Liste ;", "27406 Code postal", "1. Titre ..... 5", "Annexes :", "A. Chapitre"]


def test_titles(spark):
    assert column(spark, TITLES, lambda c: lines.is_title(text.fold(c))) == [True] * len(TITLES)
    assert column(spark, NOT_TITLES, lambda c: lines.is_title(text.fold(c))) == [False] * len(NOT_TITLES)
    df = spark.createDataFrame([(t,) for t in TITLES], "v string").withColumn("f", text.fold(F.col("v")))
    got = {r["v"]: (r["section_type"], r["number"]) for r in df.select("v", *lines.title_parts(F.col("f"))).collect()}
    assert got == TITLES


def test_levels_and_contiguity(spark):
    numbers = ["I", "2-1", "II.1.1", "XXXIX", "", "V", "abc"]
    assert column(spark, numbers, numbering.levels) == [[1], [2, 1], [2, 1, 1], [39], None, [22], None]
    cases = [([1, 1, 1], [1, 1, 2], True), ([1, 8, 1], [2], True), ([6], [4, 3, 14], False), ([3, 1, 1], [31, 2], False), (None, [1], True), ([1], [1, 1], True), ([1], None, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<int>, b array<int>")
    got = [r["o"] for r in df.select("i", numbering.contiguous(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    assert got == [c for *_, c in cases]
    assert column(spark, ["premier", "treizieme", "zut"], numbering.ordinal_to_int) == [1, 13, None]


def test_dates(spark):
    cases = {"1er janvier 2023": "2023-01-01", "3 mars 99": "1999-03-03", "15 aout 2020": "2020-08-15", "24/03/95": "1995-03-24", "31 FEV 2013": "0001-01-01", "15/02/20a3": None, "janvier 2023": None, "20 AVR. 2020": "2020-04-20", "20 JUL 2020": "2020-07-20"}
    got = column(spark, cases, lambda c: F.when(text.fold(c).rlike(references.G.DATED), references.date_of(text.fold(c))))
    assert got == list(cases.values())


def test_cleaning(spark):
    raw = ["**Test without space** bla", "* Test with space* bla", "   # # Heading", "8 janv, du 6 juill, et", "V U la a r r ê t é, n O T", "30 \\% [^0] x<br>", "a | b<br>", None, ""]
    want = ["Test without space bla", "* Test with space* bla", "Heading", "8 janv. du 6 juill. et", "VU la arrêté, n O T", "30 % x", "a | b<br>", None, ""]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, v string")
    assert [r["v"] for r in text.clean(df, "v").orderBy("i").collect()] == want


def refs_of(spark, sentences):
    df = spark.createDataFrame(list(enumerate(sentences)), "i int, v string").withColumn("folded", text.fold(F.col("v")))
    return references.detect(df, ["i"])


def test_act_references(spark):
    out = references.acts(refs_of(spark, [
        "les arrêtés préfectoraux n° 5213 du 28 octobre 1988 et n° 1636 du 24/03/95 sont abrogés",
        "Vu l'arrêté préfectoral n° 1234-567/01 du 2 mai 2001 ;", "le décret n° 77-1133 du 21 septembre 1977 ", "la circulaire DPPR/DE du 4 février 2002.", None,
    ]), ["i"]).orderBy("i", "member").collect()
    assert [(r["i"], r["doc_type"], r["num"], r["doc_date"]) for r in out] == [
        (0, "arrete-prefectoral", "5213", "1988-10-28"), (0, "arrete-prefectoral", "1636", "1995-03-24"),
        (1, "arrete-prefectoral", "1234-567/01", "2001-05-02"), (2, "decret", "77-1133", "1977-09-21"), (3, "circulaire", None, "2002-02-04"),
    ]


def test_section_references(spark):
    out = references.sections(refs_of(spark, [
        "article R. 511-9 du code", "articles 6.18.1 à 6.18.7", "articles second à 10ème", "Les alinéas 3 et 4", "Paragraphe 4.28", "paragraphe 3",
    ]), ["i"]).orderBy("i", "member").collect()
    assert [(r["i"], r["section_type"], r["start_num"], r["end_num"], r["group_no"] is not None) for r in out] == [
        (0, "article", "R511-9", None, False), (1, "article", "6.18.1", "6.18.7", False), (2, "article", "2", "10", False),
        (3, "alinea", "3", None, True), (3, "alinea", "4", None, True), (4, "article", "4.28", None, False), (5, "unknown", "3", None, False),
    ]


def test_claimed_spans_and_european_acts(spark):
    kinds = refs_of(spark, ["la directive 2010/75/UE et le présent arrêté", "directive 96/75/POIPOI"]).orderBy("i", "kind").collect()
    assert [(r["i"], r["kind"]) for r in kinds] == [(0, "eu"), (0, "self")]


@pytest.mark.parametrize(
    ("sentence", "kind", "operand"),
    [
        ("Les dispositions de l'article 8 sont complétées par les dispositions suivantes :", "add", True),
        ("L'article 2 est abrogé.", "delete", False),
        ("L'article 2 est remplacé par ce qui suit :", "replace", True),
        ("Les mots sont supprimés et remplacés par", "replace", False),
        ("Les registres sont conservés.", None, None),
    ],
)
def test_operations(spark, sentence, kind, operand):
    df = spark.createDataFrame([(1, sentence)], "i int, v string").withColumn("folded", text.fold(F.col("v")))
    out = references.operations(df, ["i"]).collect()
    assert [(r["operation_type"]) for r in out] == ([kind] if kind else [])
    if kind and operand is not None and sentence.endswith((":", ".")):
        assert out[0]["has_operand"] == operand


def test_nesting_matches_a_stack(spark):
    doc = ["Titre I - A", "Chapitre 1 - B", "Article 1 - C", "Article 1.1 - D", "Article 1.2 - E", "Chapitre 2 - F", "Article 2 - G", "Titre II - H"]
    df = lines.featured(spark.createDataFrame([("d", i, s) for i, s in enumerate(doc)], "doc_id string, line_no int, contents string"))
    out = segmentation.titles(df, "doc_id", "line_no").orderBy("line_no").collect()
    stack, want = [], []
    for r in out:
        while len(stack) - 1 >= r["schema_level"]:
            stack.pop()
        stack.append(r["line_no"])
        want.append((len(stack) - 1, stack[-2] if len(stack) > 1 else None))
    assert [(r["depth"], r["parent_line"]) for r in out] == want


def test_blocks_lists_tables_quotes(spark):
    doc = ["- un", "  - deux", "- trois", "| a | b |", "| - | - |", "| 1 | 2 |", '"ouvre', 'ferme"', "fin"]
    df = lines.featured(spark.createDataFrame([("d", i, s) for i, s in enumerate(doc)], "doc_id string, line_no int, contents string"))
    parents = {r["line_no"]: r["parent_line"] for r in segmentation.list_parents(df, "doc_id", "line_no").collect()}
    assert parents == {0: None, 1: 0, 2: None}
    cells = segmentation.table_cells(df, "doc_id", "line_no").where("NOT separator").orderBy("row", "col").collect()
    assert [c["cell"] for c in cells] == ["a", "b", "1", "2"]
    depth = [r["quote_depth"] for r in segmentation.quote_depth(df, "doc_id", "line_no").orderBy("line_no").collect()]
    assert depth == [0] * 6 + [1, 0, 0]


def test_uri_round_trip_and_validation(spark):
    df = spark.createDataFrame([("décret", None, "a/b é", "2001-01-01", None), ("x_y", None, None, None, None)], "t string, i string, n string, d string, s string")
    out = df.select(uri.render([F.col(c) for c in "tinds"]).alias("u")).collect()
    assert out[1]["u"] is None
    back = spark.createDataFrame([(out[0]["u"],)], "u string").select(uri.parse(F.col("u")).alias("p")).first()["p"]
    assert back == [["décret", None, "a/b é", "2001-01-01", None]]
    chains = spark.createDataFrame([(["titre", "article"], [None, "2"]), (["alinea", "article"], [None, None]), (["article", "alinea"], ["1", None])], "t array<string>, e array<string>")
    assert [r[0] for r in chains.select(uri.valid_chain(F.col("t"), F.col("e"))).collect()] == [True, False, False]


def test_parents_links_and_tree(spark):
    rows = [("d", 1, "section", "article 1", "g"), ("d", 2, "text", " et ", None), ("d", 3, "section", "article 2", "g"), ("d", 4, "text", " de l'", None), ("d", 5, "document", "arrêté", None)]
    df = spark.createDataFrame(rows, "doc string, n int, kind string, text string, group_id string")
    assert [r["parent_ordinal"] for r in references.match_parents(df, ["doc"], "n").where("kind = 'section'").orderBy("n").collect()] == [5, 5]
    t = spark.createDataFrame([("d", 0, 3, None, 0), ("d", 1, 2, 0, 1), ("d", 2, 2, 1, 2), ("d", 3, 3, 0, 1)], "doc string, pre int, post int, parent int, depth int")
    assert {(r["ancestor"], r["descendant"]) for r in tree.descendants(t, "doc").collect()} == {(0, 1), (0, 2), (0, 3), (1, 2)}
    assert {(r["pre"], r["next_pre"]) for r in tree.contiguous_right(t, "doc").collect()} == {(1, 3), (2, 3)}
    pair = spark.createDataFrame([("d", 2, 3)], "doc string, left int, right int")
    assert tree.common_ancestor(t, pair, "doc").first()["ancestor"] == 0
    whole = spark.createDataFrame([("d", 1, 3)], "doc string, first int, last int")
    assert {r["pre"] for r in tree.collapse(t, whole, "doc").collect()} == {1, 3}


def test_files_and_stream(spark, tmp_path):
    from lexloom.sources import files
    from lexloom.streaming.files import stream_references

    (tmp_path / "acte").mkdir()
    for n, body in (("1", "un"), ("2", "deux\nsuite"), ("10", "Vu l'arrêté du 2 mai 2001 ;")):
        (tmp_path / "acte" / f"{n}.md").write_text(body)
    pages = files.read_pages(spark, str(tmp_path))
    got = [r["contents"] for r in files.pages_to_lines(pages).orderBy("line_no").collect()]
    assert got == ["un", "deux", "suite", "Vu l'arrêté du 2 mai 2001 ;"]
    stream = stream_references(spark, str(tmp_path / "acte")).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert [r["kind"] for r in spark.table("found").collect()] == ["act"]


def test_explode_and_pipeline(spark):
    docs = spark.createDataFrame([("d", "a\nb\n"), ("e", ""), ("f", None)], "doc_id string, text string")
    kept = lines.explode_lines(docs, keep_newline=True).orderBy("doc_id", "line_no").collect()
    assert [(r["doc_id"], r["contents"], r["end_col"]) for r in kept] == [("d", "a\n", 2), ("d", "b\n", 2)]
    out = run_pipeline(docs, [lambda df: df.where("text IS NOT NULL"), lambda df: df.select("doc_id")])
