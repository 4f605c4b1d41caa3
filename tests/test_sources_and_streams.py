import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import rewriting as R
from tessera.plans import knowledge as K
from tessera.sources import curated, models, prompts, register, web
from tessera.streaming import limiter


def test_register_needs_an_id_column(spark):
    with pytest.raises(ValueError):
        register.entries(spark.createDataFrame([("a",)], "Claim string"))


def test_csv_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Claim ID,Claim,Status\nA,"two\nlines",Pending\n,,\n', encoding="utf-8")
    rows = register.entries(register.read_sheet(spark, f"file://{tmp_path}/s.csv")).collect()
    assert [(r["id"], r["claim_en"], r["status"]) for r in rows] == [("A", "two\nlines", "on_hold")]


def test_curated_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "1", "court": "X", "tags": ["a"]}]}), encoding="utf-8")
    assert curated.read_entries(spark, f"file://{tmp_path}/c.json", "cases", curated.CASE).collect()[0]["court"] == "X"
    assert curated.read_entries(spark, f"file://{tmp_path}/none.json", "cases", curated.CASE).count() == 0


def test_knowledge_write_replaces_one_source(spark, tmp_path):
    path = f"file://{tmp_path}/kb"
    row = lambda i, s: spark.createDataFrame([(i, s)], "chunk_id string, source_type string")
    K.write(row("a", "x").union(row("b", "y")), path)
    K.write(row("c", "x"), path)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        K.write_entries(row("a", "x").limit(0), path + "2", "now")
    manifest = K.write_entries(row("a", "x").union(row("b", "x")).union(row("c", "")), path + "2", "now", ("source_type",)).collect()
    assert sorted((r["what"], r["value"], r["n"]) for r in manifest) == [("all", None, 3), ("source_type", "x", 2)]


def workbook(rows):
    """An xlsx file with one sheet: text cells alternately shared and inline."""
    shared, lines = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row):
            at = f"{chr(65 + k)}{n}"
            if v is None:
                continue
            if isinstance(v, int):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif k % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{t}</t></si>' for t in shared)}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Claim ID", "Claim", "Status", "Entry date"], ["A", "Zinc helps", None, "20131231"], [None, None, None], ["B", "x", "Rejected", 7]]))
    rows = register.entries(register.read_sheet(spark, f"file://{tmp_path}/a.xlsx")).orderBy("id").collect()
    assert [(r["id"], r["claim_en"], r["status"], str(r["entry_date"])) for r in rows] == [("A", "Zinc helps", "non_authorised", "2013-12-31"), ("B", "x", "non_authorised", "None")]
    (tmp_path / "b.xlsx").write_bytes(workbook([["title"], ["Key", "Food"], ["1", "X - Ginkgo - Memory", None, "Good"], ["1", "Other", "late"], ["note", "x"]]))
    sheet = register.botanical_sheet(spark, f"file://{tmp_path}/b.xlsx")
    assert [(r["key"], r["food"], r["pending_claim"]) for r in register.botanical_entries(sheet).collect()] == [("1", "Ginkgo", "Good")]


def test_prompt_rendering(spark):
    text = "---\ntask: t\nversion: 1.0.0\nmodel: m\n---\nHi {{ name }} {{x}}"
    p = prompts.parse_prompts(spark.createDataFrame([("p", text)], "path string, raw string"))
    full = spark.createDataFrame([("t", {"name": "a$1\\", "x": "y"})], "task string, vars map<string,string>")
    assert prompts.render(p, full).collect()[0]["rendered"] == "Hi a$1\\ y"
    part = prompts.render(p, full.withColumn("vars", F.create_map(F.lit("x"), F.lit("y")))).collect()[0]
    assert part["rendered"] is None and part["missing"] == ["name"]


def test_model_calls(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long").repartition(1)
    calls = models.call(df, lambda pdf: ['{"claims":[{"claim_text":"x"}]}', "broken"]).orderBy("id").collect()
    assert calls[0]["output"]["claims"][0]["claim_text"] == "x" and calls[0]["error"] is None
    failed = models.call(df, lambda pdf: 1 / 0).collect()
    assert {(r["error"], r["attempts"]) for r in failed} == {("ZeroDivisionError", 3)}


def test_private_addresses_and_main_text(spark):
    hosts = ["127.0.0.1", "10.1.2.3", "[::1]", "8.8.8.8", "example.com", "localhost", None]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(web.is_private("h")).collect()] == [True, True, True, False, False, True, None]
    assert web.main_text("<title>T</title><nav>n</nav><main><h1>A</h1><p>b <b>c</b></p><script>x</script></main><p>out</p>") == ("T", "A\nb c")
    assert web.main_text(None) == ("", "")


def test_limiter_against_simulation(spark):
    times = [0, 10, 10, 500, 999, 1000, 1001, 1010, 3000]
    rows = [("k", datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=t), i) for i, t in enumerate(times)]
    got = {r["event_id"]: r["used"] for r in limiter.limited(spark.createDataFrame(rows, "key string, ts timestamp, event_id long"), 3, 1).collect()}
    kept: list = []
    for i, t in enumerate(times):
        kept = [x for x in kept if x > t - 1000]
        assert got[i] == len(kept) + 1
        if t not in kept:
            kept.append(t)


def test_rewriting(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0]["x"]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 4), (0, 3), (4, 5))])
    assert [tuple(r) for r in get(R.without_overlaps(spans))] == [(0, 3), (4, 5)]
    assert get(R.highlighted(F.lit("<b>cd"), spans)) == "<mark>&lt;b&gt;</mark>c<mark>d</mark>"
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new")) for a, b, n in ((0, 1, "AA"), (2, 3, "[delete]"))])
    assert get(R.splice(F.lit("a b c"), edits)) == "AA c"
