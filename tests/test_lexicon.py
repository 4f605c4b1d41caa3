import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import verdicts as V
from tessera.functions.stem import stem
from tessera.operators import lexicon as L

HARD = ["Das heilt alles", "Unsere Heilkraft", "bei Symptomen", "ein Anwendungsgebiet", "laut Indikation", "die Eindosierung", "Tagesdosis 3 g", "Therapie und mehr", "die Diagnose", "lindert sofort", "beugt vor: Vorbeugung", "Magenbeschwerden", "Wirkmechanismus"]
SOFT = ["mehr Wohlbefinden", "zur Entspannung", "Widerstandskraft", "Abwehrkräfte", "neue Vitalität", "boostet und Booster", "mentale Anspannung", "körperliche  Anspannung", "Förderung des Wohlbefindens", "Adaptogene"]
CLEAN = ["Der heilige Abend", "heilig", "Ein ruhiger Text", "", "Boost"]


@pytest.fixture(scope="module")
def hits(spark):
    texts = [*HARD, *SOFT, *CLEAN, "😀 mentales Wohlbefinden"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, L.spans(df), df


def test_rules_and_counts():
    assert sum(r.severity == "hard" for r in L.RULES) == 13 and sum(r.severity == "soft" for r in L.RULES) == 11
    assert len({r.label for r in L.RULES}) == 24


def test_hits_by_severity(hits):
    texts, spans, _ = hits
    found = {}
    for r in spans.collect():
        found.setdefault(r["doc_id"], set()).add(r["severity"])
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["term"]
    for i, t in enumerate(texts):
        want = {"hard"} if t in HARD else {"soft"} if t in SOFT or "😀" in t else set()
        assert found.get(i, set()) == want, t


def test_jvm_predicate_agrees_with_scan(hits):
    texts, spans, df = hits
    with_hits = {r["doc_id"] for r in spans.collect()}
    assert {r["doc_id"] for r in df.where(L.has_terms(F.col("text"))).collect()} == with_hits


def test_overlapping_rules_both_stay(hits):
    texts, spans, _ = hits
    rows = spans.where(F.col("doc_id") == len(texts) - 1).orderBy("start").collect()
    assert [(r["label"], r["start"]) for r in rows] == [("mentales-wohlbefinden", 2), ("wohlbefinden", 11)]


def test_longest_uncovered_and_summary(spark):
    hits = spark.createDataFrame([(1, "ab", "x", 0, 2), (1, "abc", "y", 0, 3), (1, "AB", "x", 5, 7), (1, "abc", "a", 0, 3)], "doc_id long, term string, label string, start int, end int")
    assert [(r["start"], r["label"]) for r in L.longest_per_start(hits).orderBy("start").collect()] == [(0, "a"), (5, "x")]
    cover = spark.createDataFrame([(1, 0, 4)], "doc_id long, start int, end int")
    assert [r["start"] for r in L.uncovered(hits, cover).collect()] == [5]
    assert L.summary(hits).collect()[0]["terms"] == ["ab", "abc"]


def test_disease_action(spark):
    yes = ["heilt", "Es linderte Schmerzen", "beugt jeder Erkältung vor", "hilft gegen Husten", "reduziert das Risiko", "schützt vor"]
    no = ["", "Schilddrüse", "heilig", "beugt sich. Er geht vor", "hilft sehr"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(V.is_disease_action(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0]["x"]
    assert get(X.normalise(F.lit(" <b>A\xa0„x“</b>\r\nB–C "))) == 'A "x"\nB-C'
    assert get(X.preview(F.lit("a " * 100))) == ("a " * 60)[:119].rstrip() + "…"
    assert [tuple(r) for r in get(X.paragraphs(F.lit("a\n\n\nbc\n\n")))] == [("a", 0, 1), ("bc", 4, 6), ("", 8, 8)]
    assert get(X.rejoin(F.array(F.lit("a  "), F.lit(" "), F.lit("b")))) == "a\n\nb"
    assert get(X.slug(F.lit("Ginkgo Biloba (L.)"))) == "ginkgo-biloba-l" and get(X.slug(F.lit("äö"))) == "x"
    assert get(X.clean_cell(F.lit("Verrin\xad\ngerung  von\nX"))) == "Verringerung von X" and get(X.clean_cell(F.lit(" \n"))) is None
    assert get(X.merged_conditions(F.lit(None).cast("string"), F.lit(""))) is None
    assert str(get(X.any_date(F.lit("5.5.2012")))) == "2012-05-05" and get(X.any_date(F.lit("2012-13-01"))) is None
    assert get(X.case_url(F.lit("I ZR 1/2"), F.lit(None).cast("string"))).endswith("Aktenzeichen=I%20ZR%201/2")
    assert get(X.match_terminal_punctuation(F.lit("Ja"), F.lit(""))) == "Ja"
    assert get(X.match_terminal_punctuation(F.lit("Ja."), F.lit("mitten"))) == "Ja"


def test_coercions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0]["x"]
    assert get(V.status(F.lit(" Zulässig "))) == "allowed" and get(V.status(F.lit(None).cast("string"))) == "unclear"
    assert get(V.risk(F.lit("HOCH"))) == "high" and get(V.risk(F.lit(""))) == "medium"
    assert [get(V.confidence(F.lit(x))) for x in ("0.3", "7", "-1", "viel")] == [0.3, 1.0, 0.0, 0.5]
    assert get(V.register_claim_type(F.lit("Article 14 (1)(a)"))) == "art_14_1_a"
    assert get(V.compliance_score(F.lit(3), F.lit(9), F.lit(0))) == 0


def test_stemmer():
    for word, want in {"aufeinander": "aufeinand", "kategorischer": "kategor", "häuser": "haus", "laufen": "lauf", "wohlbefindens": "wohlbefind", "empfehlungen": "empfehl", "freundlichkeit": "freundlich", "ergebnisse": "ergebnis"}.items():
        assert stem(word) == want, word
    assert re.fullmatch("[a-z]+", stem("größe"))


def plain_hits(text, rules):
    found = [(m.start(), m.end(), r.label, m[0]) for r in rules for m in re.finditer(r.pattern, text, re.IGNORECASE)]
    return sorted(found)


def test_one_pass_finds_what_all_patterns_find(spark):
    """Own sentences, inflected stems, odd letters, words inside words, repeats, and random texts made of the stems."""
    draw = random.Random(7)
    pieces = ["heil", "Heilig", "HEILEN", "heilanzeige", "Symptom-los", "ſymptom", "DİAGNOSE", "dıagnose", "Tagesdosis", "mentale Anspannung", "mentaler\n anspannung", "körperlichem anspannung", "Periodebeschwerden", "periodenbeschwerde", "boost", "booster", "boosten", "unheil", "förderung des wohlbefindens", "Foerderung wohlbefinden", "mental wohlbefinden", "ß", "İ", " ", ",", "x", "\n", "Abwehrkräfte"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", " ", "-"]) for _ in range(draw.randrange(40))) for _ in range(300)] + ["", *[r.example for r in L.RULES]]
    scanner = L.Scanner(list(L.RULES))
    assert not scanner.loose and sum(len(plain_hits(t, L.RULES)) for t in texts) > 500
    for t in texts:
        assert [(h["start"], h["end"], h["label"], h["term"]) for h in scanner.hits(t)] == plain_hits(t, L.RULES), t


def test_rules_whose_stems_cannot_be_told_are_searched_by_pattern():
    loose = L._rule("digits", "soft", "", r"\d+x", "")
    either = L._rule("either", "soft", "", r"\b(?:ab|cd)[a-z]*", "")
    optional = L._rule("optional", "soft", "", r"\babc?d", "")
    for pattern, stems in ((r"\d+x", ()), (r"\b(?:ab|cd)[a-z]*", ("ab", "cd")), (r"\babc?d", ("ab",)), (r"ab|cd", ()), (r"(?:ab)?cd", ()), (r"public", ("public",)), (r"\blicens[a-z]*\b", ("licens",)), (r"[ab]c", ()), (r"\b(?:ab|c)x", ()), (r"a.c", ())):
        assert L.stems_of(pattern) == stems, pattern
    text = "12x abd abcd cdx ab 3x"
    scanner = L.Scanner([loose, either, optional])
    assert [(h["start"], h["end"], h["label"], h["term"]) for h in scanner.hits(text)] == plain_hits(text, [loose, either, optional])


def test_work_does_not_grow_with_rules_that_are_not_there():
    more = [L._rule(f"r{i}", "soft", "", rf"\bzz{i}yy[a-z]*\b", "") for i in range(500)]
    few, many = L.Scanner(list(L.RULES)), L.Scanner([*L.RULES, *more])
    text = "Heilkraft und Symptome, sonst nichts. " * 50
    assert few.hits(text) == many.hits(text) and few.tried == many.tried == 100


def test_counts_of_texts_without_any_hit(spark):
    rows = spark.createDataFrame([(1, "Heilkraft heilt"), (2, "nichts"), (3, None), (4, "")], "i int, t string").select("i", L.count_terms(F.col("t")).alias("n"))
    assert {r["i"]: r["n"]["heil-stem"] for r in rows.collect()} == {1: 2, 2: 0, 3: None, 4: 0}


def test_spans_scan_every_text_once(spark):
    """Found is what the patterns find, also where word edges of the JVM are others; no pattern of all rules runs before the scan."""
    texts = ["o\u0301heilt", "x\u0301Symptome und Diagnose", "nichts", "", None, "Heilkraft"]
    found = L.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "RLIKE" not in found._jdf.queryExecution().toString().upper()
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["label"], r["term"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, t in enumerate(texts) if (x := plain_hits(t or "", L.RULES))} and len(got) == 3


def test_folding_of_every_letter():
    """Each character on its own and among letters, as by a table of characters."""
    table = str.maketrans(dict(L._FOLDED))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        low = c.lower() if len(c.lower()) == 1 else c
        assert L.folded(f"A{c}b") == f"a{low.translate(table)}b", hex(ord(c))


def test_predicate_looks_at_word_edges_once_for_all_rules(spark):
    """The pattern has its edge in front and finds what the rules side by side find; where edge or stems aren't sure it is the rules side by side."""
    side_by_side = lambda rules: "|".join(f"(?:{r.pattern})" for r in rules)
    assert L.any_of(L.RULES).count(r"\b(?=[") == 1 and L.any_of(L.RULES).startswith(r"\b(?=[")
    draw = random.Random(11)
    pieces = ["heil", "Heilig", "heilige", "HEILEN", "Symptom-los", "ſymptom", "DİAGNOSE", "dıagnose", "\u212aopfbeschwerden", "mentaler\n anspannung", "KÖRPERLICHEM anspannung", "körperliche", "Periodebeschwerden", "boost", "boosten", "förderung wohlbefinden", "FÖRDERUNG DES WOHLBEFINDENS", "vitalit", "dosis-empfehlung", "ß", "İ", "_", "9", "ä", "o\u0301", "ẞ", "😀", ",", "x"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", " ", "-", "\n"]) for _ in range(draw.randrange(1, 6))) for _ in range(4000)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    odd = [L._rule("digits", "soft", "", r"\d+x", "")], [L._rule("two", "soft", "", r"\bheilen|boost", "", stems=("heilen", "boost"))], [L._rule("group", "soft", "", r"\b(?:heilen|dia)x?|oost", "")]
    for rules in (L.RULES, L.RULES[:1], L.RULES[-3:], *odd, [*L.RULES, *odd[0]]):
        plain = F.col("t").rlike("(?iuU)" + side_by_side(rules))
        both = rows.select(plain.alias("a"), L.has_terms(F.col("t"), rules).alias("b"))
        assert both.where("not a <=> b").count() == 0
        assert both.where("a").count() > 0 and both.where("not a").count() > 0
    assert all(L.any_of(r) == side_by_side(r) for r in (*odd, [*L.RULES, *odd[0]], []))
