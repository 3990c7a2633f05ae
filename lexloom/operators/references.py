"""References in text: each kind claims its spans in a fixed order, later kinds see only what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import grammar as G


def _spans(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def detect(lines: DataFrame, keys: list[str], folded: str = "folded") -> DataFrame:
    """All references: keys, kind, ordinal within its kind from 0, span (folded text).

    Claimed spans are replaced by one sign before the next kind looks. Null lines hold none. Everything stays in the JVM.
    """
    rest = F.col(folded)
    found = []
    for kind, pattern in G.STAGES:
        found.append(_spans(rest, pattern).alias(kind))
        rest = F.regexp_replace(rest, pattern, G.CLAIMED)
    staged = lines.where(F.col(folded).rlike("arrete|decret|circulaire|reglement|directive|decision|article|alinea|paragraphe")).select(*keys, *found)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k, _ in G.STAGES])
    opened = staged.select(*keys, F.explode(kinds).alias("k")).select(*keys, "k.kind", F.posexplode("k.spans").alias("ordinal", "span"))
    return opened.withColumn("span", F.regexp_replace("span", r"[\s,);]+$", ""))


def acts(refs: DataFrame, keys: list[str], as_of_year: int = 2025) -> DataFrame:
    """Decrees, circulars and orders with type, number and ISO date; members of a list inherit its authority."""
    single = refs.where("kind IN ('act', 'decree', 'circular')").select(*keys, "kind", "ordinal", F.lit(0).alias("member"), F.col("span").alias("item"), "span")
    lists = refs.where("kind = 'acts'").withColumn("body", F.regexp_replace("span", r"^arretes (?:(?:prefectoraux|ministeriels) (?:modifies )?)?", ""))
    many = lists.select(*keys, "kind", "ordinal", "span", F.posexplode(_spans(F.concat("body", F.lit(" ")), G.ACT_ITEM)).alias("member", "item"))
    rows = single.unionByName(many.select(*keys, "kind", "ordinal", "member", "item", "span"))
    authority = F.regexp_extract("span", r"^arretes? (prefector|minister)", 1)
    kind = (
        F.when(F.col("kind") == "decree", "decret").when(F.col("kind") == "circular", "circulaire")
        .when(authority == "prefector", "arrete-prefectoral").when(authority == "minister", "arrete-ministeriel").otherwise("arrete")
    )
    head = F.regexp_extract("item", rf"^(.*?)(?:(?:du|en date du)\s+)?{G.DATE}", 1)
    where = F.when(F.col("item").rlike(G.DATE), head).otherwise(F.col("item"))
    numbered = F.regexp_extract(where, r"n\s*° ?\s*(\S+)", 1)
    bare = F.when(F.col("kind").isin("decree", "circular"), "").otherwise(F.regexp_extract(where, r"(\S+[/-]\S+)", 1))
    num = F.when(numbered != "", numbered).otherwise(bare)
    return rows.select(*keys, "kind", "ordinal", "member", kind.alias("doc_type"), F.nullif(num, F.lit("")).alias("num"), date_of(F.col("item"), as_of_year).alias("doc_date"))


def dates(lines: DataFrame, keys: list[str], folded: str = "folded", as_of_year: int = 2025) -> DataFrame:
    """All dates of the lines: keys, ordinal from 0, span, iso date and whether the day exists (else iso is 0001-01-01)."""
    found = lines.where(F.col(folded).rlike(G.DATED)).select(*keys, F.posexplode(_spans(F.col(folded), G.DATED)).alias("ordinal", "span"))
    told = found.withColumn("span", F.regexp_replace("span", r"[\s.,);]$", "")).withColumn("iso", date_of(F.col("span"), as_of_year))
    return told.withColumn("exists", F.col("iso") != "0001-01-01")


def eu_acts(refs: DataFrame, keys: list[str]) -> DataFrame:
    """European acts of the detected references: type, number and four-figure year; ``budget`` is no act but an error."""
    span = F.col("span")
    first = F.regexp_extract(span, r"(\d+)/\d+", 1)
    second = F.regexp_extract(span, r"\d+/(\d+)", 1)
    year_first = span.rlike(rf"\d+/\d+/{G.EU_DOMAINS}$")
    raw = F.when(year_first, first).otherwise(second)
    year = F.when(F.length(raw) == 2, F.when(raw.cast("int") > 30, F.concat(F.lit("19"), raw)).otherwise(F.concat(F.lit("20"), raw))).otherwise(raw)
    kind = F.regexp_extract(span, f"^{G.EU_TYPES}", 1)
    rows = refs.where("kind = 'eu'").select(*keys, "ordinal", kind.alias("_kind"), F.when(year_first, second).otherwise(first).alias("num"), year.alias("year"))
    return rows.select(*keys, "ordinal", F.when(F.col("_kind") != "budget", F.concat(F.lit("eu-"), "_kind")).alias("doc_type"), "num", "year", F.when(F.col("_kind") == "budget", "unsupported_act").alias("error"))


def claim_titles(lines: DataFrame, keys: list[str], titles: DataFrame, title: str, lead: str, folded: str = "folded") -> DataFrame:
    """(keys, title, start, end in words): catalogue titles named in the lines, the longest at each place, none inside another.

    Runs of words from each ``lead`` word on are joined with the folded titles by equality: as many runs as titles have
    different numbers of words, so the work grows with the lines and not with the catalogue.
    """
    words = F.split(F.trim(F.regexp_replace(F.col(folded), r"[^\p{L}\d]+", " ")), " ")
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\d]+", " "))
    known = titles.select(plain(F.col(title)).alias("_t"), F.col(title)).where("_t <> ''").dropDuplicates(["_t"])
    sizes = sorted(r[0] for r in known.select(F.size(F.split("_t", " "))).distinct().collect())
    rows = lines.where(F.contains(F.col(folded), F.lit(lead))).select(*keys, words.alias("_w"))
    starts = rows.select("*", F.posexplode("_w").alias("start", "_word")).where(F.col("_word").startswith(lead))
    runs = starts.select(*keys, "start", "_w", F.explode(F.array(*[F.lit(n) for n in sizes] or [F.lit(0)])).alias("n")).where(F.col("start") + F.col("n") <= F.size("_w"))
    named = runs.select(*keys, "start", "n", F.array_join(F.slice("_w", F.col("start") + 1, F.col("n")), " ").alias("_t")).join(known, "_t")
    longest = named.groupBy(*keys, "start").agg(F.max_by(F.struct(title, "n"), "n").alias("m")).select(*keys, f"m.{title}", "start", (F.col("start") + F.col("m.n")).alias("end"))
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return longest.withColumn("_reach", F.max("end").over(w)).where("_reach IS NULL OR start >= _reach").drop("_reach")


def date_of(text: Column, as_of_year: int = 2025) -> Column:
    """ISO date of the first date in folded text; 0001-01-01 for a day that does not exist; null without a date.

    Two-figure years up to five years after ``as_of_year`` are of this century.
    """
    words = F.regexp_extract(text, rf"(1er|\d{{1,2}}) ({G.MONTH}) (\d{{4}}|\d{{2}})", 1)
    month_word = F.regexp_extract(text, rf"(1er|\d{{1,2}}) ({G.MONTH}) (\d{{4}}|\d{{2}})", 2)
    year_words = F.regexp_extract(text, rf"(1er|\d{{1,2}}) ({G.MONTH}) (\d{{4}}|\d{{2}})", 3)
    figures = [F.regexp_extract(text, r"(\d{2})/(\d{2})/(\d{4}|\d{2})", i) for i in (1, 2, 3)]
    spelled = words != ""
    table = {w: i for names in (G.MONTH_CODES, G.MONTH_POINTS, G.MONTH_NAMES) for i, w in enumerate(names, 1)}
    month = F.when(spelled, F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), month_word)).otherwise(figures[1].try_cast("int"))
    day = F.when(spelled, F.regexp_replace(words, "er", "").try_cast("int")).otherwise(figures[0].try_cast("int"))
    raw = F.when(spelled, year_words).otherwise(figures[2])
    number = raw.try_cast("int")
    year = F.when(F.length(raw) == 4, number).when(number > as_of_year - 2000 + 5, 1900 + number).otherwise(2000 + number)
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    real = F.try_to_date(iso, "yyyy-MM-dd").isNotNull()
    return F.when(raw != "", F.when(real, iso).otherwise("0001-01-01"))


def sections(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Section references: type, start and end number; members of an enumeration share ``group_no``."""
    one = refs.where("kind = 'section'").select(*keys, "ordinal", F.lit(None).cast("int").alias("group_no"), F.lit(0).alias("member"), F.col("span").alias("item"), "span")
    listed = refs.where("kind = 'sections'")
    body = F.regexp_replace("span", r"^(?:articles?|alineas?|paragraphes?) ", "")
    item = rf"{G.ARTICLE_NUMBER}(?: a (?:l'article )?{G.ARTICLE_NUMBER})?"
    many = listed.select(*keys, "ordinal", F.col("ordinal").cast("int").alias("group_no"), "span", F.posexplode(_spans(F.regexp_replace(body, G.JOIN.replace(r"\s*(?:,|,?et)", r"\s*(?:,\s*et\b|,|\bet\b)"), " ; "), item)).alias("member", "item"))
    rows = one.unionByName(many.select(one.columns))
    kind = F.when(F.col("span").rlike("alinea"), "alinea").when(F.col("span").rlike("^articles?"), "article").when(F.col("item").rlike(rf"^(?:paragraphes? )?(?:{G.CODE_ARTICLE}|{G.DOTTED})$"), "article").otherwise("unknown")
    bare = F.regexp_replace("item", r"^(?:articles?|alineas?|paragraphes?) | (?:alineas?|paragraphes?)$", "")
    ends = F.split(bare, " a (?:l'article )?")
    number = lambda n: F.when(n.rlike(r"^[lrd]\.?\s*\d"), F.upper(F.regexp_replace(n, r"[\s.]", ""))).when(n.rlike(rf"^{G.ORDINAL}$"), F.try_element_at(F.create_map(*[F.lit(str(x)) for kv in G.ORDINALS.items() for x in kv]), n)).when(n.rlike(r"\."), n).otherwise(F.regexp_extract(n, r"^(\d+)", 1))
    return rows.select(*keys, "group_no", "ordinal", "member", kind.alias("section_type"), number(F.try_element_at(ends, F.lit(1))).alias("start_num"), number(F.try_element_at(ends, F.lit(2))).alias("end_num"))


def match_parents(tokens: DataFrame, container: list[str], ordinal: str) -> DataFrame:
    """Parents of section references: [section][connector][reference] as consecutive siblings; a parent found by one
    member of a group holds for all. ``tokens``: kind (text, section, document), text, group_id. Adds parent_ordinal."""
    w = Window.partitionBy(*container).orderBy(ordinal)
    linked = (F.col("kind") == "section") & (F.lead("kind").over(w) == "text") & F.lead("text").over(w).rlike(G.CONNECTOR) & F.lead("kind", 2).over(w).isin("section", "document")
    own = F.when(linked, F.lead(ordinal, 2).over(w))
    rows = tokens.withColumn("_own", own)
    group = Window.partitionBy(*container, "group_id")
    return rows.withColumn("parent_ordinal", F.when(F.col("group_id").isNotNull(), F.max("_own").over(group)).otherwise(F.col("_own"))).drop("_own")


def operations(lines: DataFrame, keys: list[str], folded: str = "folded") -> DataFrame:
    """Amendment operations: type, keyword and whether an operand follows (text after the keyword without a point).

    What is inserted in an official gazette is published, not amended. The family of a line is found once, and only its
    own pattern is applied again for the keyword and the rest.
    """
    text = F.col("_text")
    staged = lines.select(*keys, F.col(folded).alias("_text")).where(text.rlike(G.ANY_OPERATION))
    family: Column = F.lit(None).cast("int")
    for i, (_, word, follow) in reversed(list(enumerate(G.OPERATIONS))):
        family = F.when(text.rlike(G.operation_pattern(word, follow)) & (~text.rlike(G.GAZETTE) if i == G.INSERTS else F.lit(True)), i).otherwise(family)
    staged = staged.withColumn("_family", family).where("_family IS NOT NULL")
    kind = F.element_at(F.array(*[F.lit(n) for n, _, _ in G.OPERATIONS]), F.col("_family") + 1)
    keyword: Column = F.lit(None).cast("string")
    rest: Column = F.lit(None).cast("string")
    for i, (_, word, follow) in enumerate(G.OPERATIONS):
        p = G.operation_pattern(word, follow)
        keyword = F.when(F.col("_family") == i, F.regexp_extract(text, p, 1)).otherwise(keyword)
        rest = F.when(F.col("_family") == i, F.regexp_replace(text, p, "")).otherwise(rest)
    told = staged.select(*keys, kind.alias("operation_type"), keyword.alias("keyword"), rest.alias("_rest"), text.rlike(r":$").alias("_colon"))
    operand = F.col("_colon") | ((F.col("_rest") != "") & ~F.contains("_rest", F.lit(".")))
    return told.select(*keys, "operation_type", "keyword", operand.alias("has_operand"))
