"""Literal cases of the register, regulation, prompt and rewrite operators, against rows written out in SQL."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import verdicts as V
from tessera.operators import rewriting as R
from tessera.plans import knowledge as K
from tessera.sources import prompts, register, regulation
from tests.compare import check

CASES: dict = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = f, sql
        return f

    return add


_REGULATION = """<p class="oj-ti-section-1">KAPITEL I</p><p class="oj-normal">Präambel</p><p class="oj-ti-art">Artikel 1</p><p class="oj-sti-art">Zweck</p>
<p class="oj-normal">(1) Erstens  gilt.</p><p class="oj-normal">Frei eins</p><p class="oj-normal">(3) Drittens</p><p class="oj-normal">(1) Doppelt</p><p class="oj-normal">Frei zwei</p>
<p class="oj-ti-art">Artikel 2a</p><p class="oj-normal">Nur so</p><p class="oj-doc-ti">ANHANG</p><p class="oj-normal">Liste</p><p class="oj-normal">(7) Posten</p>"""


@query("""
select * from (values ('r-art1-para1', 1, 'Zweck', 1, 'Erstens gilt.', 'KAPITEL I', false), ('r-art1-para3', 1, 'Zweck', 3, 'Drittens', 'KAPITEL I', false), ('r-art1-para2', 1, 'Zweck', 2, 'Frei zwei', 'KAPITEL I', false),
('r-art2-para1', 2, null, 1, 'Nur so', 'KAPITEL I', false), ('r-anhang-5', null, null, 2, 'Liste', 'ANHANG', true), ('r-anhang-6', null, null, 7, 'Posten', 'ANHANG', true))
t(chunk_id, article, article_title, paragraph, text, section, is_annex)""")
def html_chunks(spark, d):
    pages = spark.createDataFrame([(1, _REGULATION)], "page_id long, html string")
    return regulation.chunks(pages, "r").select("chunk_id", "article", "article_title", "paragraph", "text", "section", "is_annex")


@query("""
select * from (values ('ID-1', 'Zinc', 'Zinc helps', null, 'authorised', 'art_13_1', date '2012-05-05'), ('ID-2', null, null, 'Hilft', 'non_authorised', 'art_14_1_b', null), ('gen-', null, 'No id', null, 'on_hold', 'unknown', date '2013-12-31'))
t(id, nutrient, claim_en, claim_de, status, claim_type, entry_date)""")
def register_entries(spark, d):
    head = "`Claim ID` string, `Nutrient, substance, food or food category` string, `Claim.` string, `Claim (DE)` string, `Status` string, `Claim type` string, `Entry date` string"
    rows = [("ID-1", " Zinc ", "Zinc helps", None, "Authorized", "Art. 13 (1)", "5.5.2012"), ("ID-2", "", None, "Hilft", "whatever", "Art 14(1)(b) children", "x"), (None, None, "No id", None, "On hold", None, "20131231"), (None, "", " ", None, None, None, None)]
    e = register.entries(spark.createDataFrame(rows, head))
    return e.select(F.when(F.col("id").startswith("gen-"), "gen-").otherwise(F.col("id")).alias("id"), "nutrient", "claim_en", "claim_de", "status", "claim_type", "entry_date")


@query("""
select * from (values ('vo432-001', 'Vitamin C', 'Vitamin C trägt zu einer Verringerung bei', 'nur so — Beschränkungen: keine', 'E1'), ('vo432-002', null, 'Eine andere Angabe', null, null)) t(id, nutrient, claim_de, conditions, health_relationship)""")
def annex_rows(spark, d):
    rows = [("a", 1, 0, ["Angabe", "x", None, None]), ("a", 1, 1, ["Vitamin C trägt zu einer Verrin\xad\ngerung bei", "nur\nso", "keine", "E1"]), ("a", 2, 0, ["kurz", None, None, None]), ("a", 2, 1, ["Eine andere\nAngabe"])]
    df = spark.createDataFrame(rows, "doc string, page int, n int, cells array<string>")
    return register.annex_entries(df).select("id", "nutrient", "claim_de", "conditions", "health_relationship")


@query("""select * from (values ('1', 'Ginkgo', 'Memory', 'Good'), ('2', 'Hops leaf', 'Sleep', 'Rest')) t(key, food, health_relationship, pending_claim)""")
def botanical_rows(spark, d):
    rows = [(0, "Key", "Food", "", ""), (1, "1", "X - Ginkgo - Memory", "", "Good"), (2, "1", "Other", "late", ""), (3, "2", "Hops leaf - Sleep", "Rest", None)]
    e = register.botanical_entries(spark.createDataFrame(rows, "seq int, key string, food_text string, original string, revised string"))
    return e.select("key", "food", "health_relationship", "pending_claim")


@query("""
select * from (values ('E1', 'eu_claim', 'EU-Register · Zink', 'Zink — Zink hilft'), ('r-1', 'regulation', 'VO 1924, Art. 3 Abs. 2', 'Titel — Text'), ('x-1', 'regulation', 'VO X § 5', 'T — S — a b'), ('c-1', 'case_law', 'BGH I ZR 252/16 (2018-01-01)', 'T — S'), ('b-1', 'botanical', 'EFSA-Botanical · Kurkuma (Curcuma longa) · EFSA on-hold', 'Curcuma longa — Kurkuma — Gelbwurz'))
t(chunk_id, source_type, reference, embedding_text)""")
def knowledge_payloads(spark, d):
    """One entry of each of the five sources, as chunks."""
    reg = spark.createDataFrame([("E1", "Zink", None, "Zink hilft", None, "authorised", "art_13_1", None)], "id string, nutrient string, claim_en string, claim_de string, conditions string, status string, claim_type string, regulation_reference string")
    law = spark.createDataFrame([("r-1", "1924", 3, "Titel", 2, "Text", "S", False, None)], "chunk_id string, regulation_id string, article int, article_title string, paragraph int, text string, section string, is_annex boolean, eur_lex_url string")
    exc = spark.createDataFrame([("x-1", "VO X", "5", None, "T", "S", None, ["a", "b"])], "chunk_id string, regulation_id string, article string, paragraph string, title string, snippet string, source_url string, tags array<string>")
    case = spark.createDataFrame([("c-1", "BGH", "I ZR 252/16", "2018-01-01", "T", None, None, "S", None, None, None, None, None)], "id string, court string, case_number string, decision_date string, title string, claim_type string, decision string, summary string, legal_basis array<string>, tags array<string>, source_url string, verification_status string, ai_confidence string")
    bot = spark.createDataFrame([("b-1", "Curcuma longa", "Kurkuma", ["Gelbwurz"], None, None, "on_hold", None)], "id string, scientific_name string, common_name_de string, common_names array<string>, health_relationship string, summary string, status string, source_url string")
    parts = [K.register_chunks(reg), K.regulation_chunks(law), K.excerpt_chunks(exc), K.case_chunks(case), K.botanical_chunks(bot)]
    return K.union(parts).select("chunk_id", "source_type", "reference", "embedding_text")


@query("select * from (values ('a', '1.10.0'), ('b', '0.9.1')) t(task, version)")
def semver_latest(spark, d):
    text = "---\ntask: {}\nversion: {}\nmodel: m\nauthor: x\ncreated_at: 2026-01-01\ndescription: d\n---\nHello {{{{ name }}}}"
    raw = spark.createDataFrame([(f"{t}{v}", text.format(t, v)) for t, v in (("a", "1.9.0"), ("a", "1.10.0"), ("b", "0.9.1"), ("b", "x"))], "path string, raw string")
    return prompts.latest(prompts.parse_prompts(raw).where("valid")).select("task", "version")


@query("""
select * from (values ('disease_based', 'heilt Krankheiten', true), ('disease_based', 'beugt einer Sache vor', true), ('disease_based', 'Leberfunktion', false), ('wellbeing_based', 'lindert', false), ('disease_based', 'SCHÜTZT VOR Grippe', true)) t(claim_type, claim_text, shortcut)""")
def disease_shortcut(spark, d):
    rows = [("disease_based", "heilt Krankheiten"), ("disease_based", "beugt einer Sache vor"), ("disease_based", "Leberfunktion"), ("wellbeing_based", "lindert"), ("disease_based", "SCHÜTZT VOR Grippe")]
    df = spark.createDataFrame(rows, "claim_type string, claim_text string")
    return df.withColumn("shortcut", V.disease_shortcut(F.col("claim_type"), F.col("claim_text")).isNotNull())


_REWRITES = [(1, "„Trägt zur Ruhe bei.“", "Trägt bei"), (2, "Fördert die Balance", "Fördert alles."), (3, "«[Nährstoff X] hilft»", "x."), (4, "(Hinweis: nur mit Zulassung)", "x"), (5, " [delete] ", "x"), (6, "Gut..  , ja :", "Ja!"), (7, "", "x"), (8, "VO 432/2012 und Pflichtangabe", "x"), (9, "‚ok", "")]


@query("""select * from (values (1, 'Trägt zur Ruhe bei'), (2, 'Fördert die Balance.'), (3, null), (4, null), (5, '[DELETE]'), (6, 'Gut., ja!'), (7, null), (8, null), (9, 'ok')) t(id, clean)""")
def sanitise_rewrites(spark, d):
    df = spark.createDataFrame(_REWRITES, "id int, rewrite string, original string")
    return df.select("id", R.sanitised(F.col("rewrite"), F.col("original")).alias("clean"))


@query("""select * from (values (1, '| a | b |', true), (2, '', true), (3, 'Text  bleibt', false), (4, '', false)) t(id, stripped, is_table)""")
def drop_markers(spark, d):
    rows = [(1, "| a | b |\n| c | [DROP_ROW] |"), (2, "| --- | --- |\n| x | [drop_row] |"), (3, "Text [DELETE] bleibt"), (4, " [DELETE]\n")]
    df = spark.createDataFrame(rows, "id int, t string")
    return df.select("id", X.strip_drop_markers(F.col("t")).alias("stripped"), X.looks_like_table(F.col("t")).alias("is_table"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_case(spark, name):
    check(*CASES[name], spark, "/root/testdata/sf0.001")
