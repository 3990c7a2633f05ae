"""Header elements, quotes, tables, links, lookups, patterns and the whole pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom import pipeline
from lexloom.functions import patterns, strings, text, uri
from lexloom.operators import blocks, consolidation, header, lines, quotes, references, resolution, segmentation, tree
from lexloom.sources import files


def order(spark, texts, doc="d"):
    return lines.featured(spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id string, line_no int, contents string"))


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["Vu le code", "- un", "reste", "Vu la loi"], [("simple", 1, "item"), ("simple", 1, "nested"), ("simple", None, "loose"), ("simple", 2, "item")]),
        (["Vu :", "- le code", "  - deux", "suite", "- la loi"], [("bullet_list", None, "keyword"), ("bullet_list", 1, "item"), ("bullet_list", 1, "nested"), ("bullet_list", None, "loose"), ("bullet_list", 2, "item")]),
        (["Considérant :", "que un", "- deux", "que trois"], [("list", None, "keyword"), ("list", 1, "item"), ("list", 1, "nested"), ("list", 2, "item")]),
        (["Vu"], [("list", None, "keyword")]),
    ],
)
def test_flavours_of_visas(spark, texts, want):
    got = header.visas_and_motifs(order(spark, ["PRÉFECTURE DE X", *texts]), "doc_id", "line_no").orderBy("line_no").collect()
    assert [(r["flavour"], r["item"], r["role"]) for r in got] == want


def test_header_elements_are_joined_and_split(spark):
    texts = ["Liberté Égalité", "Fraternité", "PRÉFECTURE DE X", "Direction des eaux", None, "ARRÊTÉ du 3 mai 2001", "portant mesures", "Article 1", "Vu plus tard"]
    got = header.elements(order(spark, texts), "doc_id", "line_no").orderBy("run", "piece").collect()
    assert [r["text"] for r in got if r["element"] == "emblem"] == ["Liberté", "Égalité", "Fraternité"]
    assert [r["text"] for r in got if r["element"] == "entity"] == ["PRÉFECTURE DE X", "Direction des eaux"]
    title = header.titles(order(spark, texts), "doc_id", "line_no").first()
    assert title["text"] == "ARRÊTÉ du 3 mai 2001 portant mesures" and title["iso"] == "2001-05-03"
    runs = header.document_elements(order(spark, ["1/3", "page 2", "texte", "Sommaire", "Annexe ..... 3"]), "doc_id", "line_no").orderBy("run").collect()
    assert [(r["element"], r["first_line"], r["last_line"]) for r in runs] == [("page_footer", 0, 1), ("table_of_contents", 3, 4)]


def test_block_quotes_nest_and_unbalanced_ones_are_errors():
    texts = ['"a', '"b', 'c"', 'd"', "e", '"f"', '"g', "h"]
    depth, inside, wrong = quotes.block_quotes(texts, [False] * len(texts))
    assert depth == [1, 2, 2, 1, 0, 1, 0, 0] and inside[1] == [0, 1] and wrong == [False] * 6 + [True, False]
    many = quotes.block_quotes(['"x'] * 3000, [False] * 3000)
    assert sum(many[2]) == 3000


def test_titles_in_quotes_and_runs_are_no_sections(spark):
    texts = ["Article 1 - Un", '"Article 2 - Deux', 'est"', "- a", "1) Liste : fin", "Article 3 - Trois", None, ""]
    rows = quotes.own_titles(quotes.with_quotes(order(spark, texts), "doc_id", "line_no"), "doc_id", "line_no")
    assert {r["line_no"] for r in rows.where("title").collect()} == {0, 5}
    numbered = {r["line_no"]: r["alinea"] for r in segmentation.alineas(rows, "doc_id", "line_no").collect()}
    assert numbered[1] == numbered[2] == 1 and numbered[3] == 2
    assert quotes.with_quotes(order(spark, texts).limit(0), "doc_id", "line_no").count() == 0


def test_nesting_has_no_bound(spark):
    deep = [f"{'.'.join(['1'] * n)} Titre" for n in range(2, 20)]
    got = segmentation.titles(order(spark, deep), "doc_id", "line_no").orderBy("line_no").collect()
    assert [r["depth"] for r in got] == list(range(len(deep))) and [r["parent_line"] for r in got] == [None, *range(len(deep) - 1)]
    items = [" " * k + "- x" for k in (0, 20, 40, 20, 0)]
    assert [r["parent_line"] for r in segmentation.list_parents(order(spark, items), "doc_id", "line_no").orderBy("line_no").collect()] == [None, 0, 1, 0, None]


def test_tables_images_and_inline_quotes(spark):
    texts = ["| Débit (m3) | Seuil |", "|---|---|", "| 1 | a<b |", "Débit : mesuré", "(*) à midi", "texte", "| sans | règle |", "![vue](v.png)", 'dit « Bonjour » et "x"']
    rows = order(spark, texts)
    good, bad = blocks.tables(rows, "doc_id", "line_no").orderBy("first_line").collect()
    assert good["html"].startswith("<table><thead><tr><th>Débit (m3)</th>") and "<td>a&lt;b</td>" in good["html"] and good["html"].endswith("<br>Débit : mesuré<br>(*) à midi")
    assert (good["first_line"], good["last_line"], good["error"], bad["error"]) == (0, 4, None, "markdown_parsing")
    assert [tuple(r)[2:] for r in blocks.images(rows, "doc_id", "line_no").collect()] == [("vue", "v.png")]
    assert [r["quoted"] for r in blocks.quoted(rows, ["line_no"]).orderBy("ordinal").collect()] == [" Bonjour ", "x"]


def test_operations_and_links(spark):
    says = {"Il est inséré au recueil des actes administratifs.": None, "Il est inséré après le premier alinéa :": "add", "Les mots sont remplacés par les suivants :": "replace", "L'article est abrogé.": "delete", "Rien.": None, None: None}
    df = order(spark, list(says))
    got = {r["line_no"]: r["operation_type"] for r in references.operations(df, ["line_no"]).collect()}
    assert got == {i: v for i, v in enumerate(says.values()) if v}
    nodes = spark.createDataFrame(
        [("d", 0, 6, None, 0, "order", False), ("d", 1, 2, 0, 1, "alinea", False), ("d", 2, 2, 1, 2, "document", False), ("d", 3, 4, 0, 1, "alinea", False), ("d", 4, 4, 3, 2, "operation", True), ("d", 5, 6, 0, 1, "div", False), ("d", 6, 6, 5, 2, "table", False)],
        "doc string, pre int, post int, parent int, depth int, kind string, has_operand boolean",
    )
    refs = consolidation.reference_leaves(spark.createDataFrame([("d", 2, None)], "doc string, pre int, parent int"), "doc")
    # the operation is the first thing of its paragraph, so its left neighbour is the paragraph's
    assert [tuple(r) for r in consolidation.targets(nodes, refs, "doc").collect()] == [("d", 4, 2)]
    assert [tuple(r) for r in consolidation.operands(nodes, "doc").collect()] == [("d", 4, 6)]


def test_tree_rules(spark):
    t = spark.createDataFrame([("d", 0, 4, None, 0), ("d", 1, 3, 0, 1), ("d", 2, 2, 1, 2), ("d", 3, 3, 1, 2), ("d", 4, 4, 0, 1)], "doc string, pre int, post int, parent int, depth int")
    part = spark.createDataFrame([("d", 0, 1), ("d", 2, 4)], "doc string, first int, last int")
    assert {(r["first"], r["pre"]) for r in tree.collapse(t, part, "doc").collect()} == {(0, 1), (2, 2), (2, 3), (2, 4)}
    one = t.where("pre = 2")
    grown = {(r["last"], r["node"]) for r in tree.growing_ranges(t, "doc", one, 2).collect()}
    assert grown == {(3, 2), (3, 3), (4, 2), (4, 3), (4, 4)}
    fresh = spark.createDataFrame([("d", 2, 3, 1, 2)], "doc string, pre int, post int, parent int, depth int")
    assert {(r["pre"], r["post"]) for r in tree.replace_children(t, "doc", t.where("pre = 1"), fresh).collect()} == {(0, 4), (1, 3), (2, 3), (4, 4)}
    assert [r["element_id"] for r in tree.element_ids(t, t.where("depth = 1"), "doc").orderBy("pre").collect()] == [1, 2]
    element = t.limit(1).select(tree.data_element(F.lit("date"), F.lit("x"), {"iso": F.lit("2001-01-01"), "none": F.lit(None)}).alias("e")).first()["e"]
    assert (element["css_class"], element["data"]) == ("dsr-date", {"data-iso": "2001-01-01"})


def test_lookups(spark, tmp_path):
    refs = spark.createDataFrame(
        [("1", "decret", "12", "2001-01-02", None, None, ""), ("2", "circulaire", None, "2001-01-02", None, None, " relative à la mesure des rejets, et au reste"), ("3", "code", None, None, None, "Code des quais", ""), ("4", "eu-directive", "75", None, "2010", None, ""), ("5", "decret", None, None, None, None, "")],
        "ref_key string, doc_type string, num string, doc_date string, year string, title string, following string",
    )
    acts = spark.createDataFrame([("decret", "2001-01-02", "12", "x", "A"), ("circulaire", "2001-01-02", None, "relative à la mesure des rejets, et au reste du monde", "B"), ("decret", None, None, "y", "C")], "doc_type string, doc_date string, num string, title string, id string")
    codes = spark.createDataFrame([("Code des quais", "Q")], "titre string, cid string")
    eu = spark.createDataFrame([("eu-directive", "2010", "75", "u")], "doc_type string, year string, num string, url string")
    assert {r["ref_key"]: r["act_id"] for r in resolution.resolve_all(refs, acts, codes, eu).collect()} == {"1": "A", "2": "B", "3": "Q", "4": "u", "5": None}
    assert {r["act_id"] for r in resolution.resolve_all(refs).collect()} == {None}
    (tmp_path / "cache.json").write_text(json.dumps({"f": {"(1)": "x", "(2)": None}}))
    cache = resolution.cached_lookups(spark, str(tmp_path / "cache.json"))
    calls = spark.createDataFrame([("f", "(1)"), ("f", "(2)"), ("f", "(3)")], "function string, arguments string")
    fallback = spark.createDataFrame([("f", "(2)", "new"), ("f", "(3)", "new")], "function string, arguments string, value string")
    assert {r["arguments"]: (r["value"], r["known"]) for r in resolution.through_cache(calls, cache, fallback).collect()} == {"(1)": ("x", True), "(2)": (None, True), "(3)": ("new", False)}


def test_european_acts(spark):
    df = order(spark, ["la directive 2010/75/UE du", "directive 96/75/CE ;", "le règlement (UE) n° 12/2013 du", "96/75/POIPOI", "budget 2010/7/UE"])
    got = {r["line_no"]: (r["doc_type"], r["num"], r["year"], r["error"]) for r in references.eu_acts(references.detect(df, ["line_no"]), ["line_no"]).collect()}
    assert got == {0: ("eu-directive", "75", "2010", None), 1: ("eu-directive", "75", "1996", None), 2: ("eu-reglement", "12", "2013", None)} | ({4: (None, "7", "2010", "unsupported_act")} if 4 in got else {})


def test_flows_of_patterns():
    word = patterns.group("w", patterns.text(r"[a-z]+"))
    flow = lambda: patterns.find(patterns.sequence(word, "-", patterns.group("n", r"\d+")), "x é-1 y b-22 z")
    assert patterns.with_siblings(flow()) == ["x ", "é-1 y ", "b-22 z"] and patterns.with_siblings(flow(), previous=True) == ["x é-1", " y b-22", " z"]
    first = next(m for m in flow() if not isinstance(m, str))
    assert patterns.texts_of(first) == ["é", "-", "1"] and [g.text for g in patterns.children_of(first, "n")] == ["1"]
    assert list(patterns.map_found(flow(), lambda m: m.text.upper()))[1] == "É-1" and list(patterns.flat_map_found(flow(), patterns.texts_of))[:4] == ["x ", "é", "-", "1"]
    with pytest.raises(ValueError):
        patterns.render(flow(), lambda m: "", allowed={"w"})
    assert list(patterns.flat_map_texts(["a b", 1], str.split)) == ["a", "b", 1]
    assert patterns.sub_again(r"^\s*x", "", "x xÉx") == "Éx" and patterns.split_before(["Vu a", "vu b c", ""], r"\bvu\b") == ["Vu a", "vu b c"]
    assert [x if isinstance(x, str) else x.text for x in patterns.find(patterns.text("e"), "éE", fold=False)] == ["éE"]


def test_small_texts(spark):
    df = spark.createDataFrame([("*****a* b***** c",), ("**a** b",), ("- *x* y",), ("*a",), ("* a *",), (None,)], "t string")
    assert [r[0] for r in df.select(text.strip_emphasis(F.col("t"))).collect()] == ["a* b c", "a b", "- x y", "*a", "* a *", None]
    classes = spark.createDataFrame([(["a", "b"],)], "c array<string>")
    assert classes.select(strings.has_class(F.col("c"), "b", "z")).first()[0]
    with pytest.raises(ValueError):
        strings.has_class(F.col("c"), "a b")
    days = spark.createDataFrame([("2001-02-30",), ("2001-02-03",), (None,), ("01-02-03",)], "d string")
    assert [r[0] for r in days.select(uri.valid_date(F.col("d"))).collect()] == [False, True, True, False]
    long = "dsr://decret_" + "x" * (1 << 21) + "_1__"
    assert len(spark.createDataFrame([(long,)], "u string").select(uri.parse(F.col("u")).alias("p")).first()["p"][0][1]) == 1 << 21
    assert [r[0] for r in spark.createDataFrame([("AP Mise en demeure",), ("autre chose",)], "n string").select(files.file_kind(F.col("n"))).collect()] == ["APMD", None]


def test_codes_in_lines(spark):
    df = order(spark, ["le code des quais et du code des quais publics, art. 2", "code", None])
    codes = spark.createDataFrame([("code des quais",), ("code des quais publics",), ("",)], "title string")
    got = references.claim_titles(df, ["line_no"], codes, "title", "code").orderBy("start").collect()
    assert [(r["title"], r["start"]) for r in got] == [("code des quais", 1), ("code des quais publics", 6)]


def test_pipeline_over_files(spark, tmp_path):
    source = tmp_path / "in" / "sub"
    source.mkdir(parents=True)
    (source / "un.md").write_text("PRÉFECTURE DE X\nVu l'arrêté préfectoral n° 12-3 du 31 février 2013 relatif aux rejets\nArticle 1 - Un\n1.1 Deux\ntexte <b>\n\"sans fin\nArticle 7 - Loin\n| a | b |\nLa directive 2010/75/UE est visée.\n")
    (source / "deux.pdf").write_bytes(b"%PDF")
    pipeline.main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-v"], spark)
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n)).collect()
    codes = {(r["doc_id"], r["code"]) for r in read("errors")}
    assert codes == {("deux", "unreadable_file"), ("un", "non_existant_date"), ("un", "non_contiguous_titles"), ("un", "unbalanced_quote"), ("un", "markdown_parsing")}
    html = read("html")[0]["html"]
    assert html.count("<section") == html.count("</section>") == 3 and html.index("<header>") < html.index("<main>") and "texte &lt;b&gt;" in html
    assert {r["doc_type"] for r in read("references")} == {"arrete-prefectoral", "eu-directive"}
    assert pipeline.normalized_html('<a data-element_id="4" b="1"  a="2">\n <i>') == pipeline.normalized_html('<a a="2" b="1" data-element_id="5"><i>')


def test_settings_come_from_the_environment():
    assert pipeline.Settings.from_env({"LEXLOOM_ACTS": "a", "LEXLOOM_AS_OF_YEAR": "2030"}) == pipeline.Settings("a", None, None, 2030)
    assert pipeline.Settings.from_env({}) == pipeline.Settings()
