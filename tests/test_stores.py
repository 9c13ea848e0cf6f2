import zipfile
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest

from tallyward.operators import cycles, office, reports, review, sinks
from tallyward.sources import stores
from tallyward.streaming import review_stream

REF = date(2026, 7, 1)


def accounts(spark, n=500):
    rows = [(f"u{i}", f"Person {i}", f"s{i % 2}", "Active" if i % 3 else "Disabled", "2026-06-30" if i % 4 else "2025-01-01") for i in range(n)]
    return spark.createDataFrame(rows, "username string, full_name string, system string, account_status string, last_login_date string")


def test_mappings(tmp_path):
    p = str(tmp_path / "x" / "m.json")
    assert stores.load_mappings(p) == {}
    stores.learn(p, "columns", "My_Header", "role")
    assert stores.learn(p, "columns", "Other", "username") == {"my header": "role", "other": "username"}
    assert stores.forget(p, "columns", "MY-HEADER") == {"other": "username"}
    (tmp_path / "x" / "m.json").write_text("{broken")
    assert stores.load_mappings(p) == {}
    with pytest.raises(ValueError, match="none of"):
        stores.learn(p, "rights", "x", "root")


def test_decisions_of_many_writers_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stores.read_table(spark, path, stores.LOG_SCHEMA).count() == 0
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: stores.append(cycles.decision(spark, f"u{i}", "s", i, "approved", "me", "t"), path), range(12)))
    assert {r.seq for r in stores.read_table(spark, path, stores.LOG_SCHEMA).collect()} == set(range(12))


def test_lists_of_people_and_conflicts(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Nom Complet,Ancien service\nAnn Lee,A\n ,B\nBo Ray,C\n")
    assert {r.full_name for r in stores.people(spark, str(tmp_path / "t.csv")).collect()} == {"Ann Lee", "Bo Ray"}
    (tmp_path / "u.csv").write_text("k1,k2\n17,Ann Lee\n18,Bo Ray\n")
    assert {r.full_name for r in stores.people(spark, str(tmp_path / "u.csv")).collect()} == {"Ann Lee", "Bo Ray"}
    (tmp_path / "m.csv").write_text("a,b\nCreate,Approve\nX, x \n,Y\n")
    assert [(r.role_a, r.role_b) for r in stores.conflict_matrix(spark, str(tmp_path / "m.csv")).collect()] == [("Create", "Approve")]


def test_sheet_of_moved_people(spark):
    table = lambda *names: spark.createDataFrame([tuple("x" for _ in names)], list(names))
    tables = {"Accueil": table("Nom"), "Affectation 2025": table("Nom & Prénoms"), "Affectation-Mutation 2026": table("Nom & Prénoms", "k"), "Transfer 2027": table("code")}
    assert stores.people_sheet(tables).columns == ["Nom & Prénoms", "k"]
    assert stores.people_sheet(tables, sheet="Accueil").columns == ["Nom"]
    assert stores.people_sheet({"a": table("code"), "b": table("full name")}).columns == ["full name"]
    with pytest.raises(stores.documents.SourceError):
        stores.people_sheet(tables, sheet="Other")


def test_report_tables_agree_with_figures(spark, tmp_path):
    df = review.analyse(accounts(spark), review.Settings(REF)).cache()
    coverage = reports.control_coverage(df)
    sinks.write_workbook(df, coverage, str(tmp_path / "book"))
    for r in coverage.where("found is not null").collect():
        if r.number in sinks.READS and r.found is not None:
            assert spark.read.parquet(str(tmp_path / "book" / f"control_{r.number:02}")).count() == r.found
    assert spark.read.parquet(str(tmp_path / "book" / "accounts")).count() == 500
    text = sinks.markdown_report(coverage, reports.risk_histogram(df), reports.status_breakdown(df))
    assert "| 2 | Dormant | WARN |" in text and "| TOTAL | 500 | 0 | +500 |" in text
    sinks.write_csv(sinks.shown(df, ["username", "review_action", "is_privileged_flag"]), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["Username", "Review action", "Privileged"]
    assert sinks.report_name(df, ".md", REF) == "access-review_s0-s1_2026-Q3_20260701.md"
    assert sinks.report_name(df, "md", REF, origin="a/b c").startswith("access-review_a_b_c_")
    sinks.write_excel(df, coverage, str(tmp_path / "book.xlsx"))
    book = stores.documents.sheets(spark, str(tmp_path / "book.xlsx"))
    assert list(book)[:2] == ["Summary", "Control 01"] and book["Accounts"].count() == 500
    for r in coverage.where("found is not null").collect():
        if r.found and f"Control {r.number:02}" in book:
            assert book[f"Control {r.number:02}"].count() == r.found
    blocks = sinks.report_blocks(coverage, reports.risk_histogram(df), reports.status_breakdown(df), "Revue é & (x)")
    sinks.write_word(spark, blocks, str(tmp_path / "r.docx"))
    tables, paragraphs = stores.documents.word_tables((tmp_path / "r.docx").read_bytes())
    assert paragraphs[0] == "Revue é & (x)" and [len(t) for t in tables[:2]] == [20, 5] and tables[2][-1][0] == "TOTAL"
    sinks.write_pdf(spark, blocks, str(tmp_path / "r.pdf"))
    raw = (tmp_path / "r.pdf").read_bytes()
    assert raw.startswith(b"%PDF-1.4") and b"(Revue \xe9 & \\(x\\))" in raw and b"TOTAL" in raw and raw.rstrip().endswith(b"%%EOF")
    start = int(raw.split(b"startxref\n")[1].split()[0])
    assert raw[start : start + 4] == b"xref" and all(raw[int(x[:10]) :].startswith(b"%d 0 obj" % k) for k, x in enumerate(raw[start:].split(b"\n")[3 : 3 + int(raw[start:].split()[2]) - 1], 1))
    f = tmp_path / "s.json"
    f.write_text("{}")
    (tmp_path / "b.zip").write_bytes(sinks.backup([str(f), str(tmp_path / "none.json")]))
    assert zipfile.ZipFile(tmp_path / "b.zip").namelist() == ["s.json"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = accounts(spark, 40)
    df.write.parquet(src)
    query = review_stream(spark.readStream.schema(df.schema).parquet(src), review.Settings(REF), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and got.where("is_dormant").count() == review.analyse(df, review.Settings(REF)).where("is_dormant").count()


def test_long_tables_go_on_in_further_sheets(monkeypatch):
    monkeypatch.setattr(office, "SHEET_ROWS", 4)
    raw = office.workbook([("a/b", ["x"], iter([[k] for k in range(7)])), ("none", ["y"], []), ("c", ["z"], [["<&\x01>"]])])
    assert stores.documents.excel_sheets(raw) == [("a b", [["x"], ["0"], ["1"], ["2"]]), ("a b 2", [["x"], ["3"], ["4"], ["5"]]), ("a b 3", [["x"], ["6"]]), ("none", [["y"]]), ("c", [["z"], ["<&>"]])]


def test_lines_of_a_wide_table_stay_in_the_page():
    lines = office.lines_of([("heading", 1, "T"), ("table", [["a" * 30, "b"], ["word " * 40, "x y"]])], width=40)
    assert all(len(t) <= 40 for _, t in lines) and "word" in " ".join(t for _, t in lines)
