"""Queries of the operators on orders, over whole tables, each with its SQL where SQL has the means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G
from lexloom.functions import numbering, text, uri
from lexloom.operators import consolidation, lines, quotes, references, resolution, segmentation, tree
from lexloom.plans.registry import query
from lexloom.runtime import latest, table
from lexloom.sources.files import render_html


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re(pattern: str) -> str:
    """A pattern as a SQL literal for an engine without ``\\d``-style differences; the grammar needs none."""
    return q(pattern)


FOLD = f"translate(lower(contents), {q(G.FOLD_FROM)}, {q(G.FOLD_TO)})"
LINES = f"lines AS (SELECT DISTINCT seg_id, doc_id, page, line_no, contents, {FOLD} AS folded FROM text_segments WHERE contents IS NOT NULL)"
has = lambda p, c="folded": f"regexp_matches({c}, {re(p)})"
take = lambda p, g, c="folded": f"regexp_extract({c}, {re(p)}, {g})"
IS_TITLE = f"({has(G.TITLE_BARE)} OR ({has(G.TITLE_NAMED)} AND NOT {has(G.PAGING)}) OR ({has(G.TITLE_DOTTED)} AND NOT {has(G.PAGING)}) OR ({has(G.TITLE_PLAIN)} AND NOT {has(G.PAGING)} AND NOT {has(G.TITLE_ENDING)}))"
IS_ELEMENT = f"(CASE WHEN {has(G.IMAGE, 'contents')} THEN false ELSE {has(G.FOOTER)} OR {has(G.CONTENTS)} END)"
BLOCK = f"CASE WHEN contains(contents, '|') THEN 'table' WHEN {has(G.LIST)} THEN 'list' WHEN {has(G.QUOTE_START)} THEN 'blockquote' WHEN {has(G.IMAGE, 'contents')} THEN 'image' ELSE 'paragraph' END"
HEADER = "CASE " + " ".join(f"WHEN {has(p)}{f' AND NOT {has(G.PAGING)}' if n == 'arrete_title' else ''} THEN '{n}'" for n, p in G.HEADERS.items()) + " END"
FEATURES = f"featured AS (SELECT *, {BLOCK} AS block, {HEADER} AS header, {IS_TITLE} AS title, {IS_ELEMENT} AS document_element FROM lines)"
WITH_FEATURES = f"WITH {LINES}, {FEATURES}"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line once, deliveries of it apart."""
    return table(spark, sf_dir, "text_segments").where("contents IS NOT NULL").select("seg_id", "doc_id", "page", "line_no", "contents").distinct()


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.featured(segments(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("folded", text.fold(F.col("contents")))


@query("line_role_counts", f"{WITH_FEATURES} SELECT block, coalesce(header, 'none') AS header, title, document_element, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM featured GROUP BY 1, 2, 3, 4")
def line_role_counts(spark, sf_dir):
    rows = featured(spark, sf_dir).groupBy("block", F.coalesce("header", F.lit("none")).alias("header"), "title", "document_element")
    return rows.agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query("line_explode_positions", "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS contents, 0 AS start_col, CAST(length(parts[i]) AS INT) AS end_col FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)")
def line_explode_positions(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents"))


@query("segment_spans", "SELECT doc_id, min(start_pos.line) AS first_line, max(end_pos.line) AS last_line, count(DISTINCT seg_id) AS n_segments FROM text_segments GROUP BY 1")
def segment_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "text_segments")
    spans = lines.combine(rows, ["doc_id"]).select("doc_id", F.col("start_pos.line").alias("first_line"), F.col("end_pos.line").alias("last_line"))
    return spans.join(rows.groupBy("doc_id").agg(F.countDistinct("seg_id").alias("n_segments")), "doc_id")


@query("fold_accents", f"WITH {LINES} SELECT seg_id, folded FROM lines")
def fold_accents(spark, sf_dir):
    return folded(spark, sf_dir).select("seg_id", "folded")


@query("punctuation_filter", f"WITH {LINES} SELECT doc_id, count(*) AS n_useful FROM lines WHERE NOT {has(G.PUNCTUATION_ONLY, 'contents')} GROUP BY 1")
def punctuation_filter(spark, sf_dir):
    return segments(spark, sf_dir).where(text.useful(F.col("contents"))).groupBy("doc_id").agg(F.count("*").alias("n_useful"))


_HEADLESS = f"CASE WHEN {has(G.LIST)} THEN contents ELSE regexp_replace(contents, '^\\s*[#\\s]+', '') END"


@query("clean_headings", f"WITH {LINES} SELECT seg_id, {_HEADLESS} AS cleaned FROM lines")
def clean_headings(spark, sf_dir):
    return segments(spark, sf_dir).select("seg_id", text.strip_headings(F.col("contents")).alias("cleaned"))


_GLYPHED = "contents"
for _wrong, _right in text.GLYPHS:
    _GLYPHED = f"replace({_GLYPHED}, {q(_wrong)}, {q(_right)})"
_UNESCAPED = "replace(replace(g, '\\%', '%'), '\\&', '&')"


@query("clean_glyphs_and_escapes", f"WITH {LINES}, s AS (SELECT seg_id, {_GLYPHED} AS g FROM lines), u AS (SELECT seg_id, {_UNESCAPED} AS g FROM s) SELECT seg_id, regexp_replace(CASE WHEN contains(g, '|') THEN g ELSE replace(g, '<br>', '') END, '\\[\\^0\\]\\s*', '', 'g') AS cleaned FROM u")
def clean_glyphs_and_escapes(spark, sf_dir):
    return segments(spark, sf_dir).select("seg_id", text.unescape(text.repair_glyphs(F.col("contents"))).alias("cleaned"))


@query("clean_markdown")
def clean_markdown(spark, sf_dir):
    """The whole cleaning step with its filter."""
    cleaned = text.clean(segments(spark, sf_dir).select("seg_id", "doc_id", "line_no", "contents"), "contents")
    return cleaned.where(text.useful(F.col("contents")))


_SHORT = {"janv.": "janv", "févr.": "f[ée]vr", "avr.": "avr", "juill.": "juill", "sept.": "sept", "oct.": "oct", "nov.": "nov", "déc.": "d[ée]c"}
_REPAIRED = "s"
for _point, _stem in _SHORT.items():
    _REPAIRED = f"regexp_replace({_REPAIRED}, '(?i)\\s{_stem},\\s', ' {_point} ', 'g')"


@query("month_repair", f"WITH s AS (SELECT o_orderkey, 'vu le rapport du ' || day(o_orderdate) || ' ' || ['janv', 'févr', 'mars', 'avr', 'mai', 'juin', 'juill', 'août', 'sept', 'oct', 'nov', 'déc'][month(o_orderdate)] || ', au titre' AS s FROM orders) SELECT o_orderkey, {_REPAIRED} AS repaired FROM s")
def month_repair(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in ("janv", "févr", "mars", "avr", "mai", "juin", "juill", "août", "sept", "oct", "nov", "déc")])
    s = F.concat(F.lit("vu le rapport du "), F.day("o_orderdate"), F.lit(" "), F.element_at(names, F.month("o_orderdate")), F.lit(", au titre"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.repair_months(s).alias("repaired"))


@query("recompose_words", "SELECT s_suppkey, 'VU la demande ' || s_name || ', arrêté, n O T' AS closed FROM supplier")
def recompose_words(spark, sf_dir):
    s = F.concat(F.lit("V U la demande "), F.col("s_name"), F.lit(", a r r ê t é, n O T"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.recompose(s).alias("closed"))


_MONTHS = "['" + "','".join(G.MONTH_NAMES) + "']"


@query("date_textual", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_textual(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in G.MONTH_NAMES])
    day = F.when(F.day("o_orderdate") == 1, "1er").otherwise(F.day("o_orderdate").cast("string"))
    s = F.concat(F.lit("le "), day, F.lit(" "), F.element_at(names, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate"), F.lit(", acte"))
    return table(spark, sf_dir, "orders").select("o_orderkey", references.date_of(s).alias("iso"))


@query("date_numeric", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 2 = 0 THEN '0001-01-01' END AS broken FROM orders")
def date_numeric(spark, sf_dir):
    s = F.date_format("o_orderdate", "dd/MM/yy")
    return table(spark, sf_dir, "orders").select("o_orderkey", references.date_of(s).alias("iso"), references.date_of(F.when(F.col("o_orderkey") % 2 == 0, "31/02/2013 ;")).alias("broken"))


@query("line_dates", f"WITH {LINES}, x AS (SELECT seg_id, regexp_extract_all(folded, {re('(' + G.DATED + ')')}, 1) AS k FROM lines) SELECT seg_id, CAST(i - 1 AS INT) AS ordinal, regexp_replace(k[i], '[\\s.,);]$', '') AS span FROM x, LATERAL (SELECT unnest(range(1, len(k) + 1)) AS i)")
def line_dates(spark, sf_dir):
    """All dates of all lines."""
    return references.dates(folded(spark, sf_dir), ["seg_id"]).select("seg_id", "ordinal", "span")


_ROMAN_CASE = "CASE upper(p) " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in G.ROMANS.items() if k != "V") + " ELSE CASE WHEN regexp_matches(p, '^[a-zA-Z]$') THEN ascii(upper(p)) - 64 WHEN regexp_matches(p, '^[0-9]{1,2}$') THEN CAST(p AS INT) END END"
_ROMANS_SQL = "['" + "','".join(G.ROMANS) + "']"


@query("levels_from_number", f"WITH n AS (SELECT DISTINCT {_ROMANS_SQL}[l_orderkey % 39 + 1] || '.' || l_linenumber || '-' || (l_partkey % 99 + 1) AS number FROM lineitem) SELECT number, array_to_string(list_transform(list_filter(regexp_split_to_array(number, '[.\\- ]+'), lambda p: p <> ''), lambda p: {_ROMAN_CASE}), ',') AS levels FROM n")
def levels_from_number(spark, sf_dir):
    romans = F.array(*[F.lit(r) for r in G.ROMANS])
    number = F.concat(F.element_at(romans, (F.col("l_orderkey") % 39 + 1).cast("int")), F.lit("."), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey") % 99 + 1)
    rows = table(spark, sf_dir, "lineitem").select(number.alias("number")).distinct()
    return rows.select("number", F.array_join(numbering.levels(F.col("number")), ",").alias("levels"))


@query("ordinal_to_int", "SELECT n_nationkey, [1,2,2,3,4,5,6,7,8,9,10,11,12,13][n_nationkey % 14 + 1] AS value FROM nation")
def ordinal_to_int(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in G.ORDINALS])
    return table(spark, sf_dir, "nation").select("n_nationkey", numbering.ordinal_to_int(F.element_at(words, F.col("n_nationkey") % 14 + 1)).alias("value"))


_KIND = f"CASE WHEN {has(G.TITLE_BARE)} THEN {take(G.TITLE_BARE, 1)} WHEN {has(G.TITLE_NAMED)} THEN {take(G.TITLE_NAMED, 1)} ELSE 'unknown' END"
_NUM = f"regexp_replace(CASE WHEN {has(G.TITLE_BARE)} THEN '' WHEN {has(G.TITLE_NAMED)} THEN CASE WHEN {take(G.TITLE_NAMED, 2)} <> '' THEN {take(G.TITLE_NAMED, 2)} ELSE {take(G.TITLE_NAMED, 3)} || {take(G.TITLE_NAMED, 4)} END WHEN {has(G.TITLE_DOTTED)} THEN {take(G.TITLE_DOTTED, 1)} ELSE {take(G.TITLE_PLAIN, 1)} END, '\\.$', '')"
_TEXT = f"CASE WHEN {has(G.TITLE_BARE)} THEN '' WHEN {has(G.TITLE_NAMED)} THEN {take(G.TITLE_NAMED, 5)} WHEN {has(G.TITLE_DOTTED)} THEN {take(G.TITLE_DOTTED, 2)} ELSE {take(G.TITLE_PLAIN, 2)} END"


@query("title_parse", f"{WITH_FEATURES} SELECT seg_id, {_KIND} AS section_type, {_NUM} AS number, {_TEXT} AS title_text FROM featured WHERE title")
def title_parse(spark, sf_dir):
    return featured(spark, sf_dir).where("title").select("seg_id", *lines.title_parts(F.col("folded")))


@query("section_nesting")
def section_nesting(spark, sf_dir):
    """Titles with contiguity, depth and parent section; checked against a stack in the tests."""
    out = segmentation.titles(quotes.own_titles(quotes.with_quotes(featured(spark, sf_dir), "doc_id", "line_no"), "doc_id", "line_no"), "doc_id", "line_no")
    return out.withColumn("levels", F.array_join("levels", "."))


@query("document_parts", f"{WITH_FEATURES}, b AS (SELECT doc_id, min(line_no) FILTER (title) AS t, min(line_no) FILTER (title AND starts_with(folded, 'annexe')) AS a FROM featured GROUP BY 1) SELECT f.doc_id, CASE WHEN f.line_no >= b.a THEN 'appendix' WHEN f.line_no >= b.t THEN 'main' ELSE 'header' END AS part, count(*) AS n_lines FROM featured f JOIN b USING (doc_id) GROUP BY 1, 2")
def document_parts(spark, sf_dir):
    return segmentation.parts(featured(spark, sf_dir), "doc_id", "line_no").groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"))


_PARTS = "b AS (SELECT doc_id, min(line_no) FILTER (title) AS t FROM featured GROUP BY 1)"


@query("header_labels", f"{WITH_FEATURES}, {_PARTS}, h AS (SELECT f.*, CASE WHEN document_element THEN 'document_element' ELSE header END AS own FROM featured f JOIN b USING (doc_id) WHERE b.t IS NULL OR f.line_no < b.t) SELECT seg_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'beginning') AS element FROM h")
def header_labels(spark, sf_dir):
    return segmentation.header_labels(featured(spark, sf_dir), "doc_id", "line_no").select("seg_id", "element")


@query("block_runs", f"{WITH_FEATURES}, n AS (SELECT *, CASE WHEN block = lag(block) OVER w THEN 0 ELSE 1 END AS new FROM featured WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT doc_id, CAST(run AS BIGINT) AS run, min(block) AS block, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM r GROUP BY 1, 2")
def block_runs(spark, sf_dir):
    return segmentation.runs(featured(spark, sf_dir), "doc_id", "line_no", "block").withColumn("run", F.col("run").cast("long"))


@query("footer_and_contents_lines", f"{WITH_FEATURES} SELECT seg_id, {has(G.FOOTER)} AS footer, {has(G.CONTENTS)} AS contents_table FROM featured WHERE document_element")
def footer_and_contents_lines(spark, sf_dir):
    f = F.col("folded")
    return featured(spark, sf_dir).where("document_element").select("seg_id", lines.is_footer(f).alias("footer"), lines.is_contents(f).alias("contents_table"))


@query("alinea_numbering", f"{WITH_FEATURES}, {_PARTS}, r AS (SELECT f.*, last_value(CASE WHEN title THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_line FROM featured f JOIN b USING (doc_id) WHERE f.line_no >= b.t AND NOT document_element), o AS (SELECT *, CASE WHEN block IN ('table', 'list') AND block = lag(block) OVER (PARTITION BY doc_id, section_line ORDER BY line_no) THEN 0 ELSE 1 END AS opens FROM r WHERE NOT title) SELECT doc_id, line_no, section_line, CAST(sum(opens) OVER (PARTITION BY doc_id, section_line ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS alinea, block FROM o")
def alinea_numbering(spark, sf_dir):
    return segmentation.alineas(featured(spark, sf_dir), "doc_id", "line_no").withColumn("alinea", F.col("alinea").cast("long"))


_ODD = "(length(folded) - length(replace(folded, '\"', ''))) % 2 = 1"


@query("quote_depth", f"WITH {LINES} SELECT seg_id, CAST(sum(CASE WHEN {_ODD} AND {has(G.QUOTE_START)} THEN 1 WHEN {_ODD} AND {has(G.QUOTE_END)} THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS quote_depth FROM lines")
def quote_depth(spark, sf_dir):
    return segmentation.quote_depth(folded(spark, sf_dir), "doc_id", "line_no").select("seg_id", "quote_depth")


@query("inline_quotes", f"WITH {LINES}, x AS (SELECT seg_id, regexp_extract_all(folded, '\"([^\"]+)\"', 1) AS k FROM lines) SELECT seg_id, CAST(i - 1 AS INT) AS ordinal, k[i] AS quoted FROM x, LATERAL (SELECT unnest(range(1, len(k) + 1)) AS i)")
def inline_quotes(spark, sf_dir):
    found = F.regexp_extract_all("folded", F.lit('"([^"]+)"'), F.lit(1))
    return folded(spark, sf_dir).select("seg_id", F.posexplode(found).alias("ordinal", "quoted"))


@query("list_nesting")
def list_nesting(spark, sf_dir):
    return segmentation.list_parents(featured(spark, sf_dir), "doc_id", "line_no")


@query("table_cells")
def table_cells(spark, sf_dir):
    return segmentation.table_cells(featured(spark, sf_dir), "doc_id", "line_no")


_PASSES, _COLS = [], []
for _i, (_kind, _pattern) in enumerate(G.STAGES):
    _prev = "lines" if not _i else f"s{_i}"
    _text = "folded" if not _i else "rest"
    _PASSES.append(f"s{_i + 1} AS (SELECT * EXCLUDE ({_text if _i else 'contents'}), regexp_extract_all({_text}, {re('(' + _pattern + ')')}, 1) AS k_{_kind}, regexp_replace({_text}, {re(_pattern)}, chr(1), 'g') AS rest FROM {_prev})")
    _COLS.append(f"SELECT seg_id, '{_kind}' AS kind, CAST(i - 1 AS INT) AS ordinal, regexp_replace(k_{_kind}[i], '[\\s,);]+$', '') AS span FROM s{len(G.STAGES)}, LATERAL (SELECT unnest(range(1, len(k_{_kind}) + 1)) AS i)")
REFS = f"WITH {LINES}, {', '.join(_PASSES)}, refs AS ({' UNION ALL '.join(_COLS)})"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.detect(folded(spark, sf_dir), ["seg_id"])


@query("references_found", f"{REFS} SELECT * FROM refs")
def references_found(spark, sf_dir):
    return refs(spark, sf_dir)


@query("reference_counts", f"{REFS} SELECT kind, count(*) AS n, count(DISTINCT seg_id) AS n_lines FROM refs GROUP BY ROLLUP (kind)")
def reference_counts(spark, sf_dir):
    return refs(spark, sf_dir).rollup("kind").agg(F.count("*").alias("n"), F.countDistinct("seg_id").alias("n_lines"))


@query("act_references")
def act_references(spark, sf_dir):
    """Orders, decrees and circulars cited in lines, parsed; lists of orders give one row per member."""
    return references.acts(refs(spark, sf_dir), ["seg_id"])


@query("act_references_parsed", "SELECT o_orderkey, 'arrete-prefectoral' AS doc_type, o_orderkey || '-' || o_custkey AS num, strftime(o_orderdate, '%Y-%m-%d') AS doc_date FROM orders")
def act_references_parsed(spark, sf_dir):
    """A sentence built from every row and parsed back."""
    s = F.concat(F.lit("Vu l'arrêté préfectoral n° "), F.col("o_orderkey"), F.lit("-"), F.col("o_custkey"), F.lit(" du "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" relatif aux rejets"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.fold(s).alias("folded"))
    return references.acts(references.detect(rows, ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "doc_type", "num", "doc_date")


@query("act_lists_parsed", "SELECT o_orderkey, CAST(m AS INT) AS member, 'arrete-prefectoral' AS doc_type, CASE WHEN m = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS num, strftime(o_orderdate, '%Y-%m-%d') AS doc_date FROM orders, (VALUES (0), (1)) t(m)")
def act_lists_parsed(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    s = F.concat(F.lit("les arrêtés préfectoraux n° "), F.col("o_orderkey"), F.lit(" du "), day, F.lit(" et n° "), F.col("o_custkey"), F.lit(" du "), day, F.lit(" sont visés"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.fold(s).alias("folded"))
    return references.acts(references.detect(rows, ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "member", "doc_type", "num", "doc_date")


@query("eu_acts_parsed", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS num, strftime(o_orderdate, '%Y') AS year FROM orders")
def eu_acts_parsed(spark, sf_dir):
    s = F.concat(F.lit("la directive "), F.year("o_orderdate"), F.lit("/"), F.col("o_custkey"), F.lit("/UE du Parlement"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.fold(s).alias("folded"))
    span = references.detect(rows, ["o_orderkey"]).where("kind = 'eu'")
    return span.select("o_orderkey", F.regexp_extract("span", r"\d+/(\d+)/", 1).alias("num"), F.regexp_extract("span", r"(\d+)/\d+/", 1).alias("year"))


@query("section_references_found")
def section_references_found(spark, sf_dir):
    """Section references of lines with type, start and end; members of an enumeration share a group."""
    return references.sections(refs(spark, sf_dir), ["seg_id"])


@query("section_ranges_parsed", "SELECT DISTINCT l_orderkey, l_linenumber, 'article' AS section_type, l_linenumber || '.' || l_orderkey AS start_num, l_linenumber || '.' || (l_orderkey + 7) AS end_num FROM lineitem")
def section_ranges_parsed(spark, sf_dir):
    a = F.concat(F.col("l_linenumber"), F.lit("."), F.col("l_orderkey"))
    b = F.concat(F.col("l_linenumber"), F.lit("."), F.col("l_orderkey") + 7)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.fold(F.concat(F.lit("Les articles "), a, F.lit(" à "), b)).alias("folded")).distinct()
    return references.sections(references.detect(rows, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "section_type", "start_num", "end_num")


@query("section_lists_parsed", "SELECT DISTINCT l_orderkey, l_linenumber, CAST(m AS INT) AS member, 'alinea' AS section_type, CASE WHEN m = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(l_linenumber + 1 AS VARCHAR) END AS start_num FROM lineitem, (VALUES (0), (1)) t(m)")
def section_lists_parsed(spark, sf_dir):
    s = F.concat(F.lit("Les alinéas "), F.col("l_linenumber"), F.lit(" et "), F.col("l_linenumber") + 1, F.lit(" de la page"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.fold(s).alias("folded")).distinct()
    return references.sections(references.detect(rows, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "member", "section_type", "start_num")


_CODE = f"SELECT titre, cid, translate(lower(titre), {q(G.FOLD_FROM)}, {q(G.FOLD_TO)}) AS t FROM dim_codes"


@query("code_references", f"WITH {LINES}, c AS ({_CODE}) SELECT DISTINCT seg_id, cid AS code_cid FROM lines JOIN c ON contains(folded, t)")
def code_references(spark, sf_dir):
    """Codes of the catalogue named in lines: runs of words joined with the titles by equality."""
    codes = table(spark, sf_dir, "dim_codes").where("titre IS NOT NULL").select(text.fold(F.col("titre")).alias("title"), "cid")
    found = references.claim_titles(folded(spark, sf_dir), ["seg_id"], codes, "title", "code")
    return resolution.resolve_codes(found.select("seg_id", "title"), codes.withColumnRenamed("title", "titre"), "title").select("seg_id", "code_cid").distinct()


_TYPED = "SELECT DISTINCT mention_id, titre_raw, num_raw FROM code_mentions"


@query("resolve_codes_and_articles", f"WITH m AS ({_TYPED}), c AS ({_CODE}) SELECT m.mention_id, c.cid AS code_cid, a.id AS article_id FROM m LEFT JOIN c ON translate(lower(m.titre_raw), {q(G.FOLD_FROM)}, {q(G.FOLD_TO)}) = c.t LEFT JOIN dim_code_articles a ON a.code_cid = c.cid AND a.num = m.num_raw")
def resolve_codes_and_articles(spark, sf_dir):
    """Exact resolution of titles and numbers as the catalogue writes them."""
    rows = table(spark, sf_dir, "code_mentions").select("mention_id", "titre_raw", "num_raw").distinct()
    coded = resolution.resolve_codes(rows, table(spark, sf_dir, "dim_codes"), "titre_raw").withColumnRenamed("num_raw", "num")
    return resolution.resolve_articles(coded, table(spark, sf_dir, "dim_code_articles"), "code_cid", "num").select("mention_id", "code_cid", "article_id")


@query("resolve_dated_acts", "WITH r AS (SELECT doc_type, doc_date, num, min(reg_id) AS reg_id FROM register_acts GROUP BY 1, 2, 3), c AS (SELECT DISTINCT cite_id, doc_type, doc_date, num FROM cited_acts) SELECT c.cite_id, r.reg_id FROM c LEFT JOIN r USING (doc_type, doc_date, num)")
def resolve_dated_acts(spark, sf_dir):
    cited = table(spark, sf_dir, "cited_acts").select("cite_id", "doc_type", "doc_date", "num").distinct()
    return resolution.resolve_acts(cited, table(spark, sf_dir, "register_acts")).select("cite_id", "reg_id")


_SITE = "https://www.legifrance.gouv.fr"


@query("external_urls", f"SELECT a.id AS article_id, '{_SITE}/codes/article_lc/' || a.id AS article_url, '{_SITE}/codes/texte_lc/' || a.code_cid AS code_url FROM dim_code_articles a")
def external_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "dim_code_articles")
    code = F.lit("code")
    return rows.select(F.col("id").alias("article_id"), uri.external_url(code, F.col("code_cid"), F.col("id")).alias("article_url"), uri.external_url(code, F.col("code_cid"), F.lit(None).cast("string")).alias("code_url"))


_E = lambda c: f"coalesce(url_encode({c}), '')"


@query("uri_render", f"WITH r AS (SELECT DISTINCT reg_id, doc_type, id, num, doc_date, title FROM register_acts) SELECT reg_id, CASE WHEN contains(coalesce(id, ''), '_') OR contains(coalesce(num, ''), '_') OR contains(title, '_') THEN NULL ELSE 'dsr://' || {_E('doc_type')} || '_' || {_E('id')} || '_' || {_E('num')} || '_' || {_E('doc_date')} || '_' || {_E('title')} || '/article__1.2__' END AS uri FROM r")
def uri_render(spark, sf_dir):
    rows = table(spark, sf_dir, "register_acts").select("reg_id", "doc_type", "id", "num", "doc_date", "title").distinct()
    none = F.lit(None).cast("string")
    return rows.select("reg_id", uri.render([F.col(c) for c in ("doc_type", "id", "num", "doc_date", "title")], [[F.lit("article"), none, F.lit("1.2"), none, none]]).alias("uri"))


@query("uri_round_trip", "SELECT DISTINCT reg_id, doc_type, id, num, doc_date, title, 'article' AS section_type, CAST(NULL AS VARCHAR) AS section_end FROM register_acts WHERE NOT contains(title, '_')")
def uri_round_trip(spark, sf_dir):
    """Identifiers rendered from every act and parsed back into their tokens."""
    rows = table(spark, sf_dir, "register_acts").select("reg_id", "doc_type", "id", "num", "doc_date", "title").distinct()
    none = F.lit(None).cast("string")
    rendered = rows.select("reg_id", uri.render([F.col(c) for c in ("doc_type", "id", "num", "doc_date", "title")], [[F.lit("article"), none, F.lit("L1-2"), none, none]]).alias("uri"))
    parsed = rendered.where("uri IS NOT NULL").select("reg_id", uri.parse(F.col("uri")).alias("p"))
    part = lambda i, j: F.element_at(F.element_at("p", i), j)
    names = ("doc_type", "id", "num", "doc_date", "title")
    return parsed.select("reg_id", *[part(1, j).alias(n) for j, n in enumerate(names, 1)], part(2, 1).alias("section_type"), part(2, 4).alias("section_end"))


@query("uri_validate", "WITH c AS (SELECT DISTINCT ref_id, section_type, end_num FROM section_references WHERE section_type IS NOT NULL) SELECT ref_id, (CASE section_type WHEN 'annexe' THEN 0 WHEN 'titre' THEN 1 WHEN 'chapitre' THEN 2 WHEN 'article' THEN 3 WHEN 'unknown' THEN 3 ELSE 5 END) <= 3 AND end_num IS NULL AS valid FROM c")
def uri_validate(spark, sf_dir):
    """A chain of the reference's own section and an article below it."""
    rows = table(spark, sf_dir, "section_references").where("section_type IS NOT NULL").select("ref_id", "section_type", "end_num").distinct()
    return rows.select("ref_id", uri.valid_chain(F.array("section_type", F.lit("article")), F.array("end_num", F.lit(None).cast("string"))).alias("valid"))


_OPS = "CASE " + " ".join(f"WHEN {has(G.operation_pattern(w, f))} THEN '{n}'" for n, w, f in G.OPERATIONS) + " END"
_VERBS = ("complétées par les dispositions suivantes :", "remplacés par ce qui suit :", "abrogées.", "ajoutés les mots suivants", "modifié comme suit", "conservés pendant un an.", "insérés après les mots", "supprimés et remplacés par")
_VERB_SQL = "[" + ", ".join(q(v) for v in _VERBS) + "]"
_OPLINES = f"o AS (SELECT o_orderkey, translate(lower('Les dispositions de l''article ' || o_custkey || ' sont ' || {_VERB_SQL}[o_orderkey % {len(_VERBS)} + 1]), {q(G.FOLD_FROM)}, {q(G.FOLD_TO)}) AS folded FROM orders)"


@query("operations_type", f"WITH {_OPLINES} SELECT o_orderkey, {_OPS} AS operation_type FROM o WHERE {_OPS} IS NOT NULL")
def operations_type(spark, sf_dir):
    verbs = F.array(*[F.lit(v) for v in _VERBS])
    s = F.concat(F.lit("Les dispositions de l'article "), F.col("o_custkey"), F.lit(" sont "), F.element_at(verbs, (F.col("o_orderkey") % len(_VERBS) + 1).cast("int")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.fold(s).alias("folded"))
    return references.operations(rows, ["o_orderkey"]).select("o_orderkey", "operation_type")


@query("line_operations", f"WITH {LINES} SELECT seg_id, {_OPS} AS operation_type FROM lines WHERE {_OPS} IS NOT NULL")
def line_operations(spark, sf_dir):
    return references.operations(folded(spark, sf_dir), ["seg_id"]).select("seg_id", "operation_type")


@query("operations_with_references")
def operations_with_references(spark, sf_dir):
    return consolidation.operations_with_references(folded(spark, sf_dir), refs(spark, sf_dir), ["seg_id"])


@query("parent_match", "WITH t AS (SELECT doc_id, ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_id) AS k FROM (SELECT DISTINCT doc_id, ref_id FROM section_references)) SELECT doc_id, 3 * k - 2 AS ordinal, CASE WHEN k % 2 = 1 THEN 3 * k END AS parent_ordinal FROM t")
def parent_match(spark, sf_dir):
    """Token rows [section][connector or other text][document] of every reference, matched by position."""
    base = table(spark, sf_dir, "section_references").select("doc_id", "ref_id").distinct()
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_id"))
    link = F.when(F.col("k") % 2 == 1, " mentionné au rang de l'").otherwise(" est annexé. ")
    parts = F.array(F.struct(F.lit("section").alias("kind"), F.lit("article 1").alias("text")), F.struct(F.lit("text").alias("kind"), link.alias("text")), F.struct(F.lit("document").alias("kind"), F.lit("arrêté").alias("text")))
    tokens = base.withColumn("k", k).select("doc_id", "k", F.posexplode(parts).alias("i", "p")).select("doc_id", (3 * F.col("k") - 2 + F.col("i")).alias("ordinal"), "p.kind", "p.text", F.lit(None).cast("string").alias("group_id"))
    matched = references.match_parents(tokens, ["doc_id"], "ordinal")
    return matched.where("kind = 'section'").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("parent_ordinal").cast("long").alias("parent_ordinal"))


_TREE = "n AS (SELECT doc_id, CAST(0 AS INT) AS pre, max(line_no) AS post, CAST(NULL AS INT) AS parent, 0 AS depth FROM text_segments GROUP BY 1 UNION ALL SELECT doc_id, min(line_no) + 1, max(line_no), 0, 1 FROM text_segments WHERE page IS NOT NULL GROUP BY doc_id, page)"


@query("tree_descendants", f"WITH {_TREE} SELECT a.doc_id, a.pre AS ancestor, d.pre AS descendant FROM n a JOIN n d ON a.doc_id = d.doc_id AND d.pre > a.pre AND d.pre <= a.post")
def tree_descendants(spark, sf_dir):
    return tree.descendants(_nodes(spark, sf_dir), "doc_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small tree per order: the order over its pages."""
    rows = table(spark, sf_dir, "text_segments")
    root = rows.groupBy("doc_id").agg(F.lit(0).alias("pre"), F.max("line_no").alias("post")).withColumn("parent", F.lit(None).cast("int")).withColumn("depth", F.lit(0))
    pages = rows.where("page IS NOT NULL").groupBy("doc_id", "page").agg((F.min("line_no") + 1).alias("pre"), F.max("line_no").alias("post")).drop("page").withColumn("parent", F.lit(0)).withColumn("depth", F.lit(1))
    return root.unionByName(pages)


@query("html_sink")
def html_sink(spark, sf_dir):
    """One semantic HTML text per order."""
    rows = segmentation.parts(featured(spark, sf_dir), "doc_id", "line_no")
    labelled = rows.withColumn("element", F.when(F.col("title"), F.lit("section_title")).when(F.col("part") == "header", F.coalesce("header", F.lit("entity"))).otherwise("alinea"))
    return render_html(labelled)


@query("latest_deliveries", "SELECT file_kind, count(DISTINCT t.seg_id) AS n_lines, count(*) AS n_deliveries FROM text_segments t JOIN ocr_files USING (doc_id) GROUP BY 1")
def latest_deliveries(spark, sf_dir):
    """Lines by kind of order, deliveries of one line counted once (the last is kept) and in all."""
    rows = table(spark, sf_dir, "text_segments").select("seg_id", "doc_id", "ingested_at")
    kinds = table(spark, sf_dir, "ocr_files").select("doc_id", "file_kind")
    once = latest(rows, ["seg_id"], "ingested_at").join(kinds, "doc_id").groupBy("file_kind").agg(F.count("*").alias("n_lines"))
    every = rows.join(kinds, "doc_id").groupBy("file_kind").agg(F.count("*").alias("n_deliveries"))
    return once.join(every, "file_kind")
