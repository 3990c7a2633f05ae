"""Queries of elements, links, lookups and small text functions, each with SQL written by hand where SQL has the means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import pipeline
from lexloom.functions import strings, text, uri
from lexloom.operators import blocks, consolidation, header, quotes, references, resolution, tree
from lexloom.plans.order_queries import LINES, featured, folded, refs
from lexloom.plans.registry import query
from lexloom.runtime import table


@query("text_flags", "SELECT reg_id, lower(title) AS lowered, translate(title, '’“”«»', '''\"\"\"\"') AS quoted, translate(title, '–—', '--') AS dashed FROM (SELECT DISTINCT reg_id, title FROM register_acts)")
def text_flags(spark, sf_dir):
    """Normalisation with one flag at a time."""
    rows = table(spark, sf_dir, "register_acts").select("reg_id", "title").distinct()
    t = F.col("title")
    return rows.select(
        "reg_id", strings.normalize(t, accents=False, quotes=False, dashes=False).alias("lowered"), strings.normalize(t, False, False, True, False).alias("quoted"), strings.normalize(t, False, False, False, True).alias("dashed")
    )


@query("first_choice", "SELECT DISTINCT m.mention_id, m.titre_raw, (SELECT arg_min(titre, cid) FROM dim_codes c WHERE translate(lower(c.titre), 'éèêàâùûôîç', 'eeeaauuoic') = translate(lower(m.titre_raw), 'éèêàâùûôîç', 'eeeaauuoic')) AS titre FROM code_mentions m WHERE m.titre_raw IS NOT NULL")
def first_choice(spark, sf_dir):
    mentions = table(spark, sf_dir, "code_mentions").where("titre_raw IS NOT NULL").select("mention_id", "titre_raw").distinct()
    return strings.first_choice(mentions, "titre_raw", table(spark, sf_dir, "dim_codes"), "titre", "cid", "titre")


@query("merged_texts", "SELECT l_orderkey, string_agg(l_comment_, '' ORDER BY l_linenumber) AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber || ';' AS l_comment_ FROM lineitem i WHERE l_linenumber < coalesce((SELECT min(l_linenumber) FROM lineitem j WHERE j.l_orderkey = i.l_orderkey AND j.l_linenumber = 4), 99)) GROUP BY 1")
def merged_texts(spark, sf_dir):
    """A flow of texts before the first element, with an empty text among them, merged."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    kind = F.when(F.col("l_linenumber") == 4, "element").otherwise("text")
    flow = rows.select("l_orderkey", (2 * F.col("l_linenumber")).alias("at"), kind.alias("kind"), F.concat(F.col("l_linenumber").cast("string"), F.lit(";")).alias("text"))
    empty = rows.select("l_orderkey", (2 * F.col("l_linenumber") + 1).alias("at"), F.lit("text").alias("kind"), F.lit("").alias("text"))
    merged = strings.merge_texts(flow.unionByName(empty), "l_orderkey", "at")
    first = Window.partitionBy("l_orderkey").orderBy("piece")
    return merged.withColumn("n", F.row_number().over(first)).where("n = 1 AND kind = 'text'").select("l_orderkey", "text")


@query("attribute_codecs", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN 'true' ELSE 'false' END AS flag, n_regionkey > 1 AS flag_back, n_name || ',' || n_regionkey AS listed, CAST(2 AS INT) AS n, substr(n_name, 1, 1) || substr(n_name, 3) AS cut FROM nation")
def attribute_codecs(spark, sf_dir):
    flag = strings.bool_attribute(F.col("n_regionkey") > 1)
    listed = strings.list_attribute(F.array("n_name", F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", flag.alias("flag"), strings.parse_bool(flag).alias("flag_back"), listed.alias("listed"), F.size(strings.parse_list(listed)).alias("n"), strings.without_span(F.col("n_name"), F.lit(1), F.lit(1)).alias("cut"))


@query("document_dates", "SELECT DISTINCT cite_id, doc_date IS NULL OR (regexp_full_match(doc_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(doc_date, '%Y-%m-%d') IS NOT NULL) AS valid FROM cited_acts")
def document_dates(spark, sf_dir):
    return table(spark, sf_dir, "cited_acts").select("cite_id", uri.valid_date(F.col("doc_date")).alias("valid")).distinct()


# An order with two paragraphs: "alinéa 3" | " de l'" | "article 5" | " est modifié" and then a quote, a text or nothing of the kind.
def _amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    node = lambda pre, post, parent, depth, kind: F.struct(F.lit(pre).alias("pre"), F.lit(post).alias("post"), F.lit(parent).cast("int").alias("parent"), F.lit(depth).alias("depth"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    nodes = [
        node(0, 8, None, 0, "order"), node(1, 5, 0, 1, "alinea"), node(2, 2, 1, 2, "section"), node(3, 3, 1, 2, "text"), node(4, 4, 1, 2, F.when(k == 3, "text").otherwise("section")),
        node(5, 5, 1, 2, "operation"), node(6, 8, 0, 1, "alinea"), node(7, 8, 6, 2, F.when(k % 2 == 0, "blockquote").otherwise("div")), node(8, 8, 7, 3, "text"),
    ]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*nodes)).alias("n"))
    return rows.select("o_orderkey", "n.*").withColumn("has_operand", (F.col("kind") == "operation") & (F.col("o_orderkey") % 4 != 1))


@query("operation_targets", "SELECT o_orderkey, CAST(5 AS INT) AS operation, CAST(2 AS INT) AS target FROM orders WHERE o_orderkey % 4 <> 3")
def operation_targets(spark, sf_dir):
    nodes = _amended(spark, sf_dir)
    found = nodes.where("kind = 'section'").select("o_orderkey", "pre", F.when((F.col("pre") == 2) & (F.col("o_orderkey") % 4 != 3), 4).alias("parent"))
    return consolidation.targets(nodes, consolidation.reference_leaves(found, "o_orderkey"), "o_orderkey")


@query("operation_operands", "SELECT o_orderkey, CAST(5 AS INT) AS operation, CASE WHEN o_orderkey % 2 = 0 THEN CAST(7 AS INT) END AS operand FROM orders WHERE o_orderkey % 4 <> 1")
def operation_operands(spark, sf_dir):
    return consolidation.operands(_amended(spark, sf_dir), "o_orderkey")


@query("gazette_is_no_amendment", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'add' END AS operation_type, o_orderkey % 2 = 0 AS has_operand FROM orders WHERE o_orderkey % 2 = 0")
def gazette_is_no_amendment(spark, sf_dir):
    """What is inserted after a paragraph amends; what is inserted in the gazette does not."""
    s = F.when(F.col("o_orderkey") % 2 == 0, "Le paragraphe suivant est inséré après le premier alinéa :").otherwise("Le présent arrêté est inséré au recueil des actes administratifs :")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.fold(s).alias("folded"))
    return references.operations(rows, ["o_orderkey"]).select("o_orderkey", "operation_type", "has_operand")


_ELEMENTS = """l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_id) - 1 AS INT) AS r FROM (SELECT DISTINCT doc_id, seg_id, line_no FROM text_segments)),
 n AS (SELECT doc_id, CAST(r + r // 20 + 2 AS INT) AS pre, CAST(r + r // 20 + 2 AS INT) AS post, 2 AS depth, CASE WHEN r % 20 > 0 THEN r + r // 20 + 2 WHEN r >= 20 THEN r + r // 20 + 1 ELSE 0 END AS begins FROM l
  UNION ALL SELECT doc_id, min(r) + r // 20 + 1, max(r) + r // 20 + 2, 1, CASE WHEN r // 20 = 0 THEN 0 ELSE min(r) + r // 20 + 1 END FROM l GROUP BY doc_id, r // 20
  UNION ALL SELECT doc_id, 0, max(r) + max(r) // 20 + 2, 0, 0 FROM l GROUP BY doc_id)"""


def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over groups of twenty lines over lines, in interval encoding."""
    lines = table(spark, sf_dir, "text_segments").select("doc_id", "seg_id", "line_no").distinct()
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "seg_id")) - 1
    rows = lines.select("doc_id", r.alias("r")).withColumn("g", F.floor(F.col("r") / 20).cast("int"))
    leaf = rows.select("doc_id", (F.col("r") + F.col("g") + 2).alias("pre"), (F.col("r") + F.col("g") + 2).alias("post"), (F.col("g") * 21 + 1).alias("parent"), F.lit(2).alias("depth"))
    group = rows.groupBy("doc_id", "g").agg((F.min("r") + F.col("g") + 1).alias("pre"), (F.max("r") + F.col("g") + 2).alias("post")).select("doc_id", "pre", "post", F.lit(0).alias("parent"), F.lit(1).alias("depth"))
    root = rows.groupBy("doc_id").agg((F.max("r") + F.max("g") + 2).alias("post")).select("doc_id", F.lit(0).alias("pre"), "post", F.lit(None).cast("int").alias("parent"), F.lit(0).alias("depth"))
    return leaf.unionByName(group).unionByName(root)


@query("tree_left_neighbours", f"WITH {_ELEMENTS} SELECT a.doc_id, a.pre, b.pre AS left_pre, b.depth AS left_depth FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.post = a.begins - 1")
def tree_left_neighbours(spark, sf_dir):
    return tree.contiguous_left(element_tree(spark, sf_dir), "doc_id").drop("left_kind")


@query("tree_right_neighbours", f"WITH {_ELEMENTS} SELECT a.doc_id, a.pre, b.pre AS next_pre, b.depth AS next_depth FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.pre = a.post + 1 UNION ALL SELECT a.doc_id, a.pre, c.pre, c.depth FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.pre = a.post + 1 AND b.depth = 1 JOIN n c ON c.doc_id = b.doc_id AND c.pre = b.pre + 1")
def tree_right_neighbours(spark, sf_dir):
    return tree.contiguous_right(element_tree(spark, sf_dir), "doc_id").drop("next_kind")


@query("tree_element_ids", f"WITH {_ELEMENTS} SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS element_id FROM n WHERE depth = 1")
def tree_element_ids(spark, sf_dir):
    nodes = element_tree(spark, sf_dir)
    return tree.element_ids(nodes, nodes.where("depth = 1"), "doc_id").withColumn("element_id", F.col("element_id").cast("long"))


@query("tree_collapsed", f"WITH {_ELEMENTS}, c AS (SELECT doc_id, 1 AS first, max(post) - 1 AS last FROM n GROUP BY 1) SELECT n.doc_id, c.first, c.last, n.pre FROM n JOIN c USING (doc_id) WHERE (n.depth = 1 AND n.post <= c.last) OR (n.depth = 2 AND n.pre <= c.last AND n.pre > (SELECT max(g.pre) FROM n g WHERE g.doc_id = n.doc_id AND g.depth = 1)) OR (n.depth = 1 AND n.pre = c.last)")
def tree_collapsed(spark, sf_dir):
    """The range from the first group to the line before the last: whole groups, then single lines."""
    nodes = element_tree(spark, sf_dir)
    chosen = nodes.groupBy("doc_id").agg(F.lit(1).alias("first"), (F.max("post") - 1).alias("last"))
    return tree.collapse(nodes, chosen, "doc_id")


_SAMPLE = r"regexp_extract(title, '^\s*((?:[^.;\s]+\s+){3,15}[^.;\s]+)', 1)"
_LOW = "translate(lower({}), 'éèêàâùûôîçÉÈÊÀÔÎ’«»“”–—', 'eeeaauuoiceeeaoi''\"\"\"\"--')"


@query("resolve_by_title", f"WITH a AS (SELECT DISTINCT reg_id, doc_type, doc_date, num, title, id FROM register_acts), r AS (SELECT reg_id, doc_type, doc_date, num, {_LOW.format(_SAMPLE)} AS s FROM a WHERE doc_type IN ('arrete-ministeriel', 'decret', 'circulaire')) SELECT r.reg_id, min(a.id) AS act_id FROM r LEFT JOIN a ON a.doc_type = r.doc_type AND a.doc_date = r.doc_date AND ((r.s <> '' AND (starts_with({_LOW.format('a.title')}, r.s) OR starts_with(r.s, {_LOW.format('a.title')}))) OR (a.doc_type = 'decret' AND a.num = r.num)) GROUP BY 1")
def resolve_by_title(spark, sf_dir):
    """Every national act of the register looked up by its date and the beginning of its title."""
    acts = table(spark, sf_dir, "register_acts").select("reg_id", "doc_type", "doc_date", "num", "title", "id").distinct()
    own = acts.where(F.col("doc_type").isin(*resolution.NATIONAL)).select("reg_id", F.col("reg_id").cast("string").alias("ref_key"), "doc_type", "doc_date", "num", F.col("title").alias("following"))
    return resolution.resolve_titled(own, acts, resolution.NATIONAL).groupBy("reg_id").agg(F.min("act_id").alias("act_id"))


@query("resolve_eu_acts", "SELECT o_orderkey, 'eu-directive' AS doc_type, CASE WHEN o_custkey % 3 <> 0 THEN 'https://eur/' || strftime(o_orderdate, '%Y') || '/' || o_custkey END AS url FROM orders")
def resolve_eu_acts(spark, sf_dir):
    """Directives found in sentences and resolved by type, year and number; those the lookup lacks stay without address."""
    orders = table(spark, sf_dir, "orders")
    s = F.concat(F.lit("la directive "), F.year("o_orderdate"), F.lit("/"), F.col("o_custkey"), F.lit("/UE du Parlement"))
    found = references.eu_acts(references.detect(orders.select("o_orderkey", text.fold(s).alias("folded")), ["o_orderkey"]), ["o_orderkey"])
    known = orders.where("o_custkey % 3 <> 0").select(F.lit("eu-directive").alias("doc_type"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_custkey").cast("string").alias("num"), F.concat(F.lit("https://eur/"), F.year("o_orderdate"), F.lit("/"), F.col("o_custkey")).alias("url"))
    keyed = found.select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("ref_key"), "doc_type", "num", "year", *[F.lit(None).cast("string").alias(c) for c in ("doc_date", "title", "following")])
    return resolution.resolve_all(keyed, eu=known).select("o_orderkey", "doc_type", "url")


@query("visa_items", f"""WITH {LINES}, f AS (SELECT *, regexp_matches(folded, '^\\W*vu(\\s*:\\s*|\\b)') AS own FROM lines) SELECT seg_id FROM f WHERE own AND regexp_replace(folded, '^\\W*vu(\\s*:\\s*|\\b)', '') <> '' AND line_no < coalesce((SELECT min(t.line_no) FROM lines t WHERE t.doc_id = f.doc_id AND regexp_matches(t.folded, '^(titre|chapitre|article|annexe)\\s')), 1000000)""")
def visa_items(spark, sf_dir):
    """Visas of the simple flavour: the keyword with its text, each an item of its own."""
    rows = featured(spark, sf_dir)
    at = header.visas_and_motifs(rows, "doc_id", "line_no").where("element = 'visa' AND role = 'item' AND flavour = 'simple'")
    return rows.join(at.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi").select("seg_id")


@query("visas_and_motifs")
def visas_and_motifs(spark, sf_dir):
    return header.visas_and_motifs(featured(spark, sf_dir), "doc_id", "line_no")


@query("header_elements")
def header_elements(spark, sf_dir):
    return header.elements(featured(spark, sf_dir), "doc_id", "line_no")


@query("header_titles")
def header_titles(spark, sf_dir):
    return header.titles(featured(spark, sf_dir), "doc_id", "line_no")


@query("document_element_runs", f"WITH {LINES} SELECT count(*) AS n_lines FROM lines WHERE NOT regexp_matches(contents, '^!\\[[^\\[\\]]+\\]\\([^()]+\\)') AND (regexp_matches(folded, '^([0-9]+/[0-9]+|page\\s+[0-9]+)') OR regexp_matches(folded, '^(sommaire|table des matieres|liste des (chapitres|articles))') OR regexp_matches(folded, '\\s\\.{{5}}\\s+(page\\s+)?[0-9]+$'))")
def document_element_runs(spark, sf_dir):
    """Lines in runs of page footers and tables of contents."""
    runs = header.document_elements(featured(spark, sf_dir), "doc_id", "line_no")
    inside = featured(spark, sf_dir).where("document_element").join(runs.select("doc_id", "first_line", "last_line"), "doc_id").where("line_no BETWEEN first_line AND last_line")
    return inside.agg(F.countDistinct("seg_id").alias("n_lines"))


@query("tables_and_descriptions")
def tables_and_descriptions(spark, sf_dir):
    return blocks.tables(featured(spark, sf_dir), "doc_id", "line_no")


@query("block_quotes")
def block_quotes(spark, sf_dir):
    """Lines inside block quotes, with their depth, and lines that open a quote without an end."""
    return quotes.with_quotes(featured(spark, sf_dir), "doc_id", "line_no").where("quote_depth > 0 OR unbalanced").select("seg_id", "quote_depth", "quote_line", "unbalanced")


@query("quoted_originals", f"WITH {LINES}, x AS (SELECT seg_id, regexp_extract_all(translate(contents, '“”«»', '\"\"\"\"'), '\"([^\"]+)\"', 1) AS k FROM lines) SELECT seg_id, k[1] AS quoted FROM x WHERE len(k) > 0")
def quoted_originals(spark, sf_dir):
    """The first inline quote of each line, in its own letters."""
    return blocks.quoted(folded(spark, sf_dir), ["seg_id"]).where("ordinal = 0").select("seg_id", "quoted")


def _whole(spark: SparkSession, sf_dir: str) -> pipeline.Result:
    rows = table(spark, sf_dir, "text_segments").select("doc_id", "seg_id", "line_no", "contents").distinct()
    return pipeline.process(rows, codes=table(spark, sf_dir, "dim_codes"))


@query("pipeline_errors")
def pipeline_errors(spark, sf_dir):
    """The errors table of the whole pipeline."""
    return _whole(spark, sf_dir).errors


@query("pipeline_html")
def pipeline_html(spark, sf_dir):
    """Orders as HTML with nested sections."""
    return _whole(spark, sf_dir).html


@query("european_acts")
def european_acts(spark, sf_dir):
    return references.eu_acts(refs(spark, sf_dir), ["seg_id"])
