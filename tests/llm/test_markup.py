import pytest

from lexloom.llm.markup import Slot, agreed, clean, clean_lines, merge, notation, notation_lines, parse, wrappers

MARKED = {
    "## Article 3 - Rejets": ("heading", "Article 3 - Rejets"), "== Article 2 ==": ("heading", "Article 2"), r"\section{Article 1}": ("heading", "Article 1"),
    "<h4>Article 5</h4>": ("heading", "Article 5"), "la **vanne** est": ("text", "la vanne est"), "d'un *essai fait*": ("text", "d'un essai fait"),
    "[[Lestroy|la ville]] dort": ("text", "la ville dort"), "arr&#234;t&eacute;": ("text", "arrêté"), r"arr\^et\'e": ("text", "arrêté"),
    "| a | b |": ("table", "a | b"), "<tr><td>a</td><td>b</td></tr>": ("table", "a | b"), r"a & b \\ \hline": ("table", "a | b"), "<li>un</li>": ("list", "- un"),
    "```": ("code_mark", ""), r"\begin{itemize}": ("mark", ""), r"Q = \frac{V}{2} \times \sqrt{h}": ("formula", "Q = (V)/(2) × √(h)"), "fin ;[^8]": ("text", "fin ;"),
}
PLAIN = ["- le pont ;", "3 * 12 m²", "(*) valeur", "C:\\plans\\zone2", "plan_masse_v2.pdf", "seuil_co = 87", "[...] sans", "1 250 $ ou", "> 5,5 et < 8,5", "lot #3 & Cie", "[2]", "- 3 -", ";", ""]


@pytest.mark.parametrize("line", MARKED)
def test_marked_lines(line):
    tree = parse(line)
    assert notation(tree) and clean(tree)[:2] == MARKED[line]


@pytest.mark.parametrize("line", PLAIN)
def test_plain_lines(line):
    assert not notation(parse(line))


def test_shapes_that_differ_in_a_node_share_the_rest():
    wrapper = Slot("line", 0)
    for line in ("la **vanne** est <b>la</b>", "un **pont** dort", "une <b>eau</b> de ``puits``"):
        wrapper.lines += 1
        merge(wrapper, parse(line), 1)
    assert agreed(wrapper, parse("un **pont** dort"))[0] == 2
    assert agreed(wrapper, parse("<b>x</b>"))[0] >= 1 and agreed(wrapper, parse("sans ``code``"))[0] == 0 and agreed(wrapper, parse("sans rien"))[0] == 0


def test_documents(spark):
    rows = [(i, "d", i, t, "h") for i, t in enumerate(["# T", "```", "x = **1**", "```", None, "fin " * 20_000, "<b>a</b>"])]
    rows += [(10 + i, "e", i, t, None) for i, t in enumerate(["# U", "y = **2** et **3**", "<b>b</b> **c**", "un \\vspace{2mm} seul"])]
    df = spark.createDataFrame(rows + rows[:1], "seg int, doc string, at int, t string, host string")
    # the only line with its kind of notation in all hosts is no template
    assert {r["seg"] for r in notation_lines(df, ["seg"], "t", "host").collect()} == {0, 1, 2, 3, 6, 10, 11, 12}
    whole = {r["seg"]: r for r in clean_lines(df, "seg", "doc", "at", "t", "host").collect()}
    assert whole[11]["clean"] == "y = 2 et 3" and whole[13]["clean"] == "un \\vspace{2mm} seul"
    out = {k: r for k, r in whole.items() if k < 10}
    assert len(out) == 7 and out[2]["kind"] == "code" and out[2]["clean"] == "x = **1**" and out[4]["clean"] is None and out[6]["clean"] == "a"
    assert notation_lines(df.limit(0), ["seg"], "t", "host").count() == 0


def test_wrappers_tell_template_from_content(spark):
    rows = [("h", f"<p>Article</p><b>{i}</b>") for i in range(4)]
    out = wrappers(spark.createDataFrame(rows, "host string, t string"), "host", "t").collect()
    assert [(r["lines"], r["template_slots"], r["content_slots"], r["template_nodes"], r["alignment"]) for r in out] == [(4, 1, 1, 4, 1.0)]
