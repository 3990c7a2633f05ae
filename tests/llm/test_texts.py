"""Scan repair, leaks, mixing and text statistics."""

import base64
import math
import random
import time

from pyspark.sql import functions as F

from lexloom.llm.contamination import Items, leaks, sure_run, without_leaks
from lexloom.llm import contamination
from lexloom.llm.mixing import PATTERN, TOKENIZER, mix, plan, poisson_steps, shares, solve_rate, tokens_of
from lexloom.llm.queries import QUERIES
from lexloom.llm.scan_repair import BLOCK, Channel, correct, is_page_number, mark, marked_lines, noise, paragraphs
from lexloom.llm.text_quality import judged

WORDS = {"conserve": 500, "le": 900, "registre": 400, "exploitant": 450, "mesure": 300, "période": 200, "périodes": 120, "contrôle": 350}


def test_noisy_channel():
    channel = Channel(WORDS, {"le registre": 300}, 10_000)
    assert correct("le regisfre", channel) == ("le registre", True)
    assert correct("LE REGISFRE", channel) == ("LE REGISTRE", True)
    assert correct("p é r i o d e s", channel) == ("périodes", True)
    assert correct("le registre de Bodohamu", channel) == ("le registre de Bodohamu", False)
    assert correct("", channel) == ("", False)


def test_any_repeated_line_is_a_header():
    """No list of phrases: what stands at the edges of several pages is a header, a heading or a sentence is not."""
    page = lambda p, head: [(p, head), (p, "le registre"), (p, "exploitant conserve")]
    for head in ("Cahier Vrelan / Gormu", "Gazette des quais, n° 12 - {}"):
        got = mark([line for p in range(1, 5) for line in page(p, head.format(p) if p > 1 else "Avis au public")], Channel(WORDS, {}, 10_000))
        assert [i for i, m in enumerate(got) if m[0] == "header"] == [3, 6, 9]
    for head in ("Article 4", "le contrôle est fait,", "- la mesure"):
        assert not any(m[0] == "header" for m in mark([line for p in range(1, 5) for line in page(p, head)], Channel(WORDS, {}, 10_000)))


def test_long_lines_decode_in_linear_time():
    channel = Channel(WORDS, {"le registre": 300}, 10_000)
    began = time.time()
    assert channel.decode(["le", "regisfre"] * 8_000) == ["le", "registre"] * 8_000
    assert time.time() - began < 5


def test_long_words_are_corrected():
    long = "antiretrocontroversablementextraordinairement"
    assert correct(long.replace("rd", "rcl"), Channel({long: 90}, {}, 10_000)) == (long, True)


def test_rare_words_are_known_beyond_the_broadcast(spark, monkeypatch):
    """A word too rare for the broadcast is restored like a frequent one, and kept where it is what was printed."""
    monkeypatch.setattr("lexloom.llm.scan_repair.LEXICON_BOUND", 40)
    lines = ["exploitant conserve le registre"] * 900 + ["le filigrane est contrôlé"] * 60 + ["le fi1igrane est", "une vanne", "une vanne", "une vanne"]
    df = spark.createDataFrame([(i, f"d{i}", 1, 0, t) for i, t in enumerate(lines)], "seg_id long, doc_id string, page int, line_no long, contents string")
    assert {(r["seg_id"], r["noise"]) for r in noise(df).collect()} == {(960, "glyph")}
    assert {r["text"] for r in marked_lines(df).where("seg_id = 960").collect()} == {"le filigrane est"}


def test_bound_of_words_changes_nothing(spark, monkeypatch):
    """Words with figures, words joined over lines and letter-spaced ones count whether broadcast or joined."""
    lines = ["exploitant conserve le registre"] * 400 + ["le mode calme", "un mode fort"] * 60 + ["la rnode", "une bague", "une bague", "une bague", "une bogue", "le poste H2O", "le poste H2O", "le poste H2O"]
    lines += ["le vase clos"] * 90 + ["la vose nue"] * 2 + ["la vase nue"] * 4 + ["le filigrane est"] * 60 + ["le f i 1 i g r a n e est", "le f i l i", "un fi1i-", "grane est"] + ["un calme plat"] * 5 + ["un colme plat", "le mo**de** fort"]
    lines += ["la cour haute"] * 80 + ["le caur bas"] * 1 + ["la caur haute"] + ["le cœur bas"] * 4 + ["ma foi"] * 3
    df = spark.createDataFrame([(i, f"d{i // 2}", 1, i % 2, t) for i, t in enumerate(lines)], "seg_id long, doc_id string, page int, line_no long, contents string")
    told = lambda: sorted((r["seg_id"], r["role"], *r["noise"], r["text"]) for r in marked_lines(df).collect())
    whole = told()
    monkeypatch.setattr("lexloom.llm.scan_repair.LEXICON_BOUND", 9)
    assert told() == whole


def test_page_numbers():
    assert all(map(is_page_number, ["page 1/4", "— 3 —", "- 2 -", "[2]", "( 3 )", "iii", "Feuillet 1", "2 sur 4", "12", "p. 5"]))
    assert not any(map(is_page_number, ["2013 ;", "1997.", "- 3 ans", "°C.", "L.", "", "Article 3"]))


def test_long_page_numbers():
    assert is_page_number("page 1043") and is_page_number("1043", 1200) and is_page_number("12 / 1200", 1200)
    assert not is_page_number("2013", 40) and not is_page_number("n° 2013", 40)


def test_order_of_several_blocks(spark):
    lines = [(1 + i // 50, "exploitant conserve") for i in range(2 * BLOCK + 500)]
    for page in (3, 100, 150):
        lines[50 * page - 50] = (page, "Direction du Nelbre")
    lines[0] = (1, "Direction du Nelbre")
    for page in (20, 90, 170):
        lines[50 * page - 1] = (page, "Suivi Vorlan - Tombrec")
    df = spark.createDataFrame([(i, "d", p, i, t) for i, (p, t) in enumerate(lines)], "seg_id long, doc_id string, page int, line_no long, contents string")
    got = {r["seg_id"] for r in marked_lines(df).where("role = 'header'").collect()}
    assert got == {100, 4950, 7450, 999, 4499, 8499}


def test_marks_of_a_page():
    lines = [(1, "PRÉFECTURE DE X"), (1, "le con-"), (1, "page 1/2"), (2, "Dossier 0052796055 / Nelbre"), (2, "trôle fait"), (2, None), (2, "remis :"), (2, "23"), (2, "page 2/2"), (3, "Dossicr 0052796055 / Nelbre"), (3, "le registre")]
    got = mark(lines, Channel(WORDS, {}, 10_000))
    assert [m[0] for m in got] == ["text", "text", "page_number", "header", "text", "blank", "text", "text", "page_number", "header", "text"]
    assert got[1][1] == ["hyphen"] and got[3][1] == ["header"] and got[4][4]


def test_scan_tables(spark):
    rows = [(i, "d", None if i == 2 else 1, i, t) for i, t in enumerate(["exploitant conserve le re-", "gistre", None, "", "exploitant conserve " * 5_000])]
    df = spark.createDataFrame(rows + rows[:1], "seg_id long, doc_id string, page int, line_no int, contents string")
    assert {(r["seg_id"], r["noise"]) for r in noise(df).collect()} == {(0, "hyphen")}
    assert paragraphs(df).orderBy("paragraph").first()["text"].startswith("exploitant conserve le registre")
    assert noise(df.limit(0)).count() == 0


def brute(ids, item):
    row = [0] * (len(ids) + 1)
    for i, w in enumerate(item, 1):
        fresh = [i]
        for j, x in enumerate(ids, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != w)))
        row = fresh
    best, previous = 0, {}
    for x in ids:
        current = {j: previous.get(j - 1, 0) + 1 for j, w in enumerate(item) if w == x}
        best, previous = max([best, *current.values()]), current
    return best >= min(20, len(item)) or min(row) <= len(item) // 10


def test_leaks_match_brute_force():
    rng = random.Random(3)
    vocabulary = [f"mot{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([7, 12, 25, 40, 60])))) for k in range(30)]
    book = Items(items)
    for _ in range(150):
        key, text = rng.choice(items)
        words = text.split()
        if rng.random() < 0.5:
            for _ in range(rng.randint(0, len(words) // 7 + 1)):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["neuf"], [words[i], "plus"]])
        else:
            at = rng.randrange(len(words))
            words = words[at : at + rng.randint(10, 25)]
        doc = " ".join(rng.choices(vocabulary, k=15) + words + rng.choices(vocabulary, k=15))
        assert (key in {r[0] for r in book.scan(doc)}) == brute(book.ids(doc.split()), book.words[key])
    assert sure_run(9) == 9 and sure_run(10) == 5


def test_short_items_and_compounds():
    """Short items are found whole beside long ones; a hyphenated name counts as one edited word."""
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(40)) + " Saint-Aubrelin-sur-Orvette et " + " ".join(f"v{i}" for i in range(20))
    book = Items([(1, long), (2, "de"), (3, "le site"), (4, " ".join(f"u{i}" for i in range(9)))])
    words = long.split()
    for at in (3, 12, 21, 30, 52):
        words[at] = "autre"
    words[40] = "local"
    assert {r[0] for r in book.scan("x " + " ".join(words) + " y")} == {1}
    words[59] = "autre"
    assert not book.scan(" ".join(words))
    assert {r[0] for r in book.scan("vers le Site DE u0 u1 u2 u3 u4 u5 u6 u7 u8 u9")} == {2, 3, 4}
    assert {r[0] for r in book.scan("u0 u1 u2 u3 u5 u6 u7 u8")} == set()
    docs = [" ".join(rng.choices([*words, "de", "le", "site"], k=60)) for _ in range(50)]
    assert book.scan_all(docs) == [book.scan(d) for d in docs]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 3)
    items = [(k, " ".join(f"k{k}w{i}" for i in range(25))) for k in range(12)]
    docs = [(100 + k, f"a {text} b {items[0][1]}") for k, text in items]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(100 + k, k) for k in range(12)} | {(100 + k, 0) for k in range(12)}


def test_leak_tables(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"Début. {passage.upper()} fin", "x"), (2, None, "x"), (3, "", "x"), (1, f"Début. {passage.upper()} fin", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "...")], "item_id long, text string")
    found = leaks(docs, items)
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in found.collect()] == [(1, 7, "whole")]
    assert {r["text"] for r in without_leaks(docs.dropDuplicates(["doc_id"]), found).collect()} == {"Début.  fin", None, ""}
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_every_copy_is_cut(spark, tmp_path):
    words = [f"w{i}" for i in range(50)]
    passage, edited = " ".join(words), " ".join([*words[:24], "neuf", *words[25:]])
    filler = " ".join(f"x{i}" for i in range(70))
    rows = [(1, f"a {passage} b {filler} {passage} c"), (2, f"a {edited} b"), (3, f"a {' '.join(words[5:30])} b {' '.join(words[20:45])} c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    found = QUERIES["p7_found"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 7), (2, 7), (3, 7)]
    got = {r["doc_id"]: (r["text"], r["n_leaks"]) for r in QUERIES["p7_clean"](spark, str(tmp_path)).collect()}
    assert got == {1: (f"a  b {filler}  c", 2), 2: ("a  b", 1), 3: ("a  b  c", 2)}


def test_no_run_is_left():
    rng = random.Random(8)
    vocabulary = [f"mot{i}" for i in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([12, 25, 60])))) for k in range(20)]
    book = Items(items)
    for _ in range(100):
        doc: list[str] = []
        for key, text in rng.choices(items[:4], k=4):
            words = text.split()
            if len(words) > 40 and rng.random() < 0.5:
                words[rng.randrange(20, 40)] = "neuf"
            doc += rng.choices(vocabulary, k=10) + words
        ids = book.ids(doc)
        spans = book.scan(" ".join(doc))
        for key, a, e, _ in spans:
            ids[a:e] = [-1] * (e - a)
        assert not any(brute_run(ids, item) for item in book.words.values())


def brute_run(ids, item):
    grams = {tuple(item[j : j + 20]) for j in range(max(1, len(item) - 19))}
    n = min(20, len(item))
    return any(tuple(ids[i : i + n]) in grams for i in range(len(ids) - n + 1))


def test_poisson_rates():
    assert [round(x, 4) for x in poisson_steps(1.0, 3)] == [0.3679, 0.7358, 0.9197]
    buckets = {b: 10 for b in range(4096)}
    rate = solve_rate(buckets, 20_480, 3)
    assert abs(rate - 0.5) < 0.02 and math.isinf(solve_rate(buckets, 10**9, 3)) and math.isinf(solve_rate({}, 5, 1)) and solve_rate(buckets, 0, 1) == 0.0


def test_high_rates_are_solved():
    """A rate far above the former bound of 60 is found as long as the cap allows it."""
    buckets = {b: 10 for b in range(4096)}
    rate = solve_rate(buckets, 40_960 * 80, 100)
    steps = poisson_steps(rate, 100)
    assert abs(sum(10 * sum(s < (b + 0.5) / 4096 for s in steps) for b in buckets) / 40_960 - 80) < 0.1


def test_tokens_of_whole_texts(spark):
    """Counts of texts far beyond a piece are those of the tokenizer on the whole text, wherever they could be cut."""
    import tiktoken

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", "l'été  de 1999\n\n n° 12/b", None, "".join(rng.choice(["mot", " ", "  ", "\n", "é", "12", "-", "'s", "\u00a0", "…"]) for _ in range(150_000)), "ab " * 90_000, "7" * 2_000 + "x" * 120_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens_of(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_mixture(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", 10) for i in range(3000)] + [(9999, None, 10)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 0.5), ("m", "B", 0.4, 2, 0.5), ("m", "none", 0.1, 2, 0.5)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    planned = plan(sizes, targets)
    got = {r["source"]: r for r in shares(sizes, planned).collect()}
    assert abs(got["a"]["sampled_tokens"] - 7502) < 80 and abs(got["b"]["sampled_tokens"] - 6002) < 80 and got["none"]["short"]
    sample = mix(sizes, planned)
    assert sample.agg({"copy": "max"}).first()[0] <= 2 and sample.count() == sum(r["sampled_records"] for r in got.values())
    assert mix(sizes, planned).collect() == sample.collect()


def test_long_sentences_and_entries(spark):
    """Neither a sentence of 900 characters nor an entry of 400 is another thing than a shorter one; other languages have their own prose."""
    rng = random.Random(7)
    common = spark.createDataFrame([("fr", w) for w in "le la les de des du un une et à est sont dans pour par sur".split()], "lang string, word string")
    nouns = "vanne site bassin registre exploitant contrôle mesure rejet réseau nappe parcelle torchère".split()
    clause = lambda: f"le {rng.choice(nouns)} de la {rng.choice(nouns)} est dans le {rng.choice(nouns)} pour un {rng.choice(nouns)}"
    prose = lambda n: " ".join(", ".join(clause() for _ in range(n)).capitalize() + "." for _ in range(12))
    rows = [(i, prose(2), "fr") for i in range(40)] + [(50, prose(20), "fr"), (51, "\n".join(f"- {n} {', '.join(rng.choices(nouns, k=50))}" for n in nouns * 2), "fr")]
    spanish = "agua presa cauce vertido planta ruido plazo informe".split()
    rows += [(60 + i, " ".join(f"El {rng.choice(spanish)} del {rng.choice(spanish)} se mantiene en el {rng.choice(spanish)} con {rng.choice(spanish)}." for _ in range(12)), "es") for i in range(30)]
    form = {r["doc_id"]: r["form"] for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common).collect()}
    assert form.pop(51) == "list" and set(form.values()) == {"prose"}


def test_forms(spark):
    rng = random.Random(1)
    common = spark.createDataFrame([("fr", w) for w in "le la les de des du un une et à est sont dans pour par sur".split()], "lang string, word string")
    nouns = "vanne site bassin registre exploitant contrôle mesure rejet réseau nappe parcelle torchère".split()
    sentence = lambda: f"Le {rng.choice(nouns)} de la {rng.choice(nouns)} est dans le {rng.choice(nouns)} pour un {rng.choice(nouns)}."
    rows = [(i, " ".join(sentence() for _ in range(12)), "fr") for i in range(60)]
    rows += [(100, "\n".join(f"- {n} {i}" for i in range(4) for n in nouns), "fr"), (101, "\n".join(f"{n}\t{i}\tmg/l" for i in range(4) for n in nouns), None), (102, "page " * 200, "und"),
             (103, "\n".join(sentence().upper() for _ in range(12)), "fr"), (104, None, None), (105, "", "fr"), (106, "aGVsbG8gd29ybGQ" * 60, "und"), (0, rows[0][1], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = judged(docs, common).collect()
    form = {r["doc_id"]: r["form"] for r in out}
    assert len(out) == len(form) == 67
    assert {form[i] for i in range(60)} == {"prose"} and form[103] == "prose"
    assert (form[100], form[101], form[102], form[104], form[105], form[106]) == ("list", "table", "junk", "junk", "junk", "junk")
    assert judged(docs.limit(0), common).count() == 0
