import io
import json
import zipfile

import pytest

from tallyward.functions import headers as H
from tallyward.operators import standard as N
from tallyward.sources import documents as D
from tallyward.sources import text as S

ROWS = [("ann", "Ann Lee", "ERP", "Active", "2026-01-05"), ("bob", "Bo, Ray", "CRM", "Disabled", "2026-02-06"), ("cé", "Cé Dé", "ERP", "", "never")]
NAMES = ["Username", "Full Name", "System", "Account Status", "Last Login Date"]
WANT = {r[0]: r for r in ROWS}


def check(df, extra=()):
    got = {r.username: r for r in df.collect()}
    assert set(got) == set(WANT)
    for k, r in WANT.items():
        assert (got[k].full_name, got[k].system, (got[k].account_status or ""), got[k].last_login_date) == (r[1], r[2], r[3], r[4])


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def quoted(rows, sep):
    return "\n".join(sep.join(f'"{c}"' if sep in c else c for c in r) for r in rows) + "\n"


@pytest.mark.parametrize(("sep", "encoding"), [(",", "utf-8"), (";", "cp1252"), ("\t", "utf-16"), ("|", "utf-8-sig")])
def test_csv(spark, tmp_path, sep, encoding):
    text = quoted([["Export of 2026"], NAMES, *ROWS], sep)
    check(D.load(spark, put(tmp_path, "x.csv", text.encode(encoding))))


def test_text_kinds(spark, tmp_path):
    check(D.load(spark, put(tmp_path, "a.txt", "\n".join("|".join(r) for r in [NAMES, *ROWS]))))
    rows = [[c or "-" for c in r] for r in [NAMES, *ROWS]]
    fixed = D.load(spark, put(tmp_path, "b.txt", "\n".join("".join(f"{c:<24}" for c in r) for r in rows)))
    assert {r.username for r in fixed.collect()} == set(WANT)
    check(D.load(spark, put(tmp_path, "c.txt", "\n\n".join("\n".join(f"- {n}: {c}" for n, c in zip(NAMES, r)) for r in ROWS))))


def test_json_kinds(spark, tmp_path):
    records = [dict(zip(["username", "full_name", "system", "account_status", "last_login_date"], r)) for r in ROWS]
    check(D.load(spark, put(tmp_path, "a.json", json.dumps(records))))
    check(D.load(spark, put(tmp_path, "b.json", json.dumps({"count": 3, "users": records}, indent=1))))
    nested = S.json(spark, put(tmp_path, "c.json", json.dumps([{"a": {"b": 1, "c": [1, 2]}, "d": None}])))
    assert nested.first().a_b == "1" and nested.first().a_c == "[1,2]"
    with pytest.raises(S.SourceError):
        S.json(spark, put(tmp_path, "d.json", "{not json"))


def test_xml_and_html(spark, tmp_path):
    esc = lambda c: c.replace("&", "&amp;")
    tags = ["username", "full_name", "system", "account_status", "last_login_date"]
    check(D.load(spark, put(tmp_path, "a.xml", "<?xml version='1.0'?><accounts>" + "".join("<account>" + "".join(f"<{t}>{esc(c)}</{t}>" for t, c in zip(tags, r)) + "</account>" for r in ROWS) + "</accounts>")))
    table = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in [NAMES, *ROWS]) + "</table>"
    check(D.load(spark, put(tmp_path, "a.html", f"<html><table><tr><td>menu</td></tr></table><p>x</p>{table}</html>")))
    with pytest.raises(S.SourceError):
        D.html(spark, put(tmp_path, "b.html", "<p>no table</p>"))


def test_ldif(spark, tmp_path):
    text = "dn: cn=a\nsAMAccountName: ann\ncn: Ann\n  Lee\nuserAccountControl: 514\nwhenChanged: 20260105101010.0Z\n\n# c\ndn: cn=b\nsAMAccountName: bob\nuserAccountControl: 512\n"
    got = {r.username: r for r in D.load(spark, put(tmp_path, "a.ldif", text)).collect()}
    assert got["ann"].account_status == "Disabled" and got["ann"].full_name == "Ann Lee" and got["bob"].account_status == "Active" and got["bob"].system == "Active Directory"


def workbook(sheets):
    f = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return f.getvalue()


def test_excel(spark, tmp_path):
    check(D.load(spark, put(tmp_path, "a.xlsx", workbook([("All", [NAMES, *ROWS])]))))
    two = workbook([("One", [NAMES[:2], *[r[:2] for r in ROWS[:2]]]), ("Two", [["Login", "Name"], ("dan", "Dan")])])
    assert {(r.username, r.system) for r in D.load(spark, put(tmp_path, "b.xlsx", two)).collect()} == {("ann", "One"), ("bob", "One"), ("dan", "Two")}


def document(tables, paragraphs=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return f.getvalue()


def test_word(spark, tmp_path):
    check(D.load(spark, put(tmp_path, "a.docx", document([[NAMES, *ROWS]]))))
    check(D.load(spark, put(tmp_path, "b.docx", document([], ["|".join(r) for r in [NAMES, *ROWS]]))))


def test_archive_leaves_bad_members_out(spark, tmp_path):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("erp.csv", quoted([["login", "status"], ["ann", "Active"], ["bob", "Active"]], ","))
        z.writestr("crm.csv", quoted([["login", "status"], ["x1", "Active"], ["x2", "Active"]], ","))
        z.writestr("bad.docx", b"no zip")
        z.writestr("notes.bin", b"x")
    out = D.load(spark, put(tmp_path, "all.zip", f.getvalue()))
    assert {(r.username, r.system) for r in out.collect()} == {("ann", "erp"), ("bob", "erp"), ("x1", "crm"), ("x2", "crm")}


def test_unknown_formats_and_missing_fields(spark, tmp_path):
    with pytest.raises(S.SourceError):
        D.load(spark, put(tmp_path, "a.exe", "x"))
    with pytest.raises(S.SourceError):
        D.load(spark, put(tmp_path, "a.pdf", "x"))
    with pytest.raises(N.MissingColumns):
        D.load(spark, put(tmp_path, "a.csv", "colour,size\nred,1\nblue,2\n"))


def test_headers():
    assert H.match("USER_NAME") == "username" and H.match("Last  Logon") == "last_login_date" and H.match("colour") is None
    assert H.match("foo", learned={"foo": "role"}) == "role" and H.match("Username", learned={"username": H.IGNORED}) is None
    assert H.header_row([["Report"], ["Username", "System", "Role"], ["a", "b", "c"]]) == 1
    assert H.header_row([["a", "1"], ["b", "2"]]) == 0
    assert N.unique_names(["x", "x", None, " "]) == ["x", "x__dup1", "unnamed_2", "unnamed_3"]
    assert S.sniff_encoding("é".encode("utf-16")) == "UTF-16" and S.sniff_encoding("é".encode("cp1252")) == "windows-1252" and S.sniff_encoding(b"abc") == "UTF-8"


def test_text_of_several_tables(spark, tmp_path):
    text = "Accounts of both systems\n\nLogin;System;Status\nann;ERP;Active\nbob;ERP;Disabled\n\nUser name|Application|Department\ncy|CRM|Sales\n"
    got = {(r.username, r.system, r.account_status, r.department) for r in D.load(spark, put(tmp_path, "t.txt", text)).collect()}
    assert got == {("ann", "ERP", "Active", None), ("bob", "ERP", "Disabled", None), ("cy", "CRM", None, "Sales")}


def test_groups_of_positioned_rows(spark):
    rows = [(1, 1, ["title"]), (1, 2, ["Login", "Status"]), (1, 3, ["ann", "Active"]), (2, 1, ["Login", "Status"]), (2, 2, ["bob", "Active"]), (2, 3, ["odd", "row", "here"]), (3, 1, ["User name", "Role", "System"]), (3, 2, ["cy", "r", "s"])]
    got = S.table_groups(spark.createDataFrame(rows, "page int, row int, cells array<string>")).orderBy("page", "row").collect()
    assert [(r.group_no, r.cells[0]) for r in got] == [(1, "Login"), (1, "ann"), (1, "bob"), (2, "User name"), (2, "cy")]


def test_wide_rows_far_down(spark, tmp_path):
    far = "\n".join([f"u{i},ERP,Active" for i in range(600)] + [",".join(["last", "ERP", "Active", *(f"x{k}" for k in range(20))]), '"in ""q"", a\nb",ERP,Active'])
    got = S.csv(spark, put(tmp_path, "x.csv", "username,system,account_status\n" + far + "\n"))
    assert len(got.columns) == 1 + 23 and got.count() == 602
    assert [r for r in got.collect() if r.username == "last"][0][-1] == "x19"
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(["username;system", *["a;b"] * 20, "c;d;e;f"])], "line_no long, line string")
    assert len(S.delimited(lines, ";").columns) == 1 + 4


def test_all_keys_and_all_tables(spark, tmp_path):
    entries = "\n\n".join(f"dn: cn=u{i}\nsAMAccountName: u{i}\nextra{i}: v{i}" for i in range(520))
    assert {"extra0", "extra519"} <= set(S.ldif(spark, put(tmp_path, "x.ldif", entries)).columns)
    tables = "\n\n".join(("username;system\n" if i % 2 else "username;status\n") + f"u{i};s{i}" for i in range(230))
    got = S.text(spark, put(tmp_path, "x.txt", tables)).collect()
    assert {r.username for r in got} == {f"u{i}" for i in range(230)} and len(got) == 230


def zipped(members):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return f.getvalue()


def test_archives_keep_members_of_one_name_and_shared_logins_apart(spark, tmp_path):
    generic = ["admin", "test"]
    one = lambda logins: "username,account_status\n" + "".join(f"{u},Active\n" for u in logins)
    rows = D.load(spark, put(tmp_path, "a.zip", zipped({"AD.csv": one([*generic, "jdupont", "mmartin"]), "SAP.csv": one([*generic, "kbrou", "asylla"]), "readme.md": "no"}))).collect()
    assert len(rows) == 8 and {(r.username, r.system) for r in rows if r.username == "admin"} == {("admin", "AD"), ("admin", "SAP")}
    rows = D.load(spark, put(tmp_path, "b.zip", zipped({"q1/users.csv": one(["ann", "bob"]), "q2/users.csv": one(["cy", "dan", "eve"])}))).collect()
    assert {(r.username, r.system) for r in rows} == {("ann", "q1/users"), ("bob", "q1/users"), ("cy", "q2/users"), ("dan", "q2/users"), ("eve", "q2/users")}
    merged = D.load(spark, put(tmp_path, "c.zip", zipped({"x.csv": one(["user0", "user1", "jsales", "ann"]), "y.csv": "username,manager\nuser0,M\nuser1,N\njsales,O\nbob,P\n"}))).collect()
    assert len(merged) == 5 and {r.manager for r in merged if r.username == "jsales"} == {"O"}
    with pytest.raises(S.SourceError):
        D.load(spark, put(tmp_path, "d.zip", zipped({"readme.md": "no"})))
    many = D.archive(spark, str(tmp_path / "[ab].zip")).collect()
    assert len(many) == 13


def test_collapse_on_roles_and_logins_that_name_no_one(spark, tmp_path):
    text = "Username,Identity,Role,Last Login Date\nADMINISTRATOR,CORP\\ann,Reader,31/01/2020\nann,,Writer,01/12/2024\nbob,,Reader,\n,,,\nsystem,root,X,05/05/2024\n"
    rows = {r.username: r for r in D.load(spark, put(tmp_path, "x.csv", text)).collect()}
    assert set(rows) == {"ann", "bob", "system"} and rows["ann"].role == "Reader\nWriter" and rows["ann"].last_login_date == "01/12/2024"


def test_split_files_and_object_lines(spark, tmp_path):
    body = "\n".join(f"u{i};App;Active" + (";extra" if i == 4000 else "") for i in range(5000))
    wide = S.csv(spark, put(tmp_path, "w.csv", "User;Host;Status\n" + body + "\n"))
    assert wide.count() == 5000 and wide.where("unnamed_3 = 'extra'").count() == 1
    assert S.csv_shape(spark, str(tmp_path / "w.csv"), ";", "UTF-8") == (4, False)
    put(tmp_path, "q.csv", 'a;b\n"x\ny";z\n')
    assert S.csv_shape(spark, str(tmp_path / "q.csv"), ";", "UTF-8") == (2, True)
    lines = S.json(spark, put(tmp_path, "l.json", '{"username": "ann", "system": "A"}\n{"username": "bob", "system": "B"}\n'))
    assert {r.username for r in lines.collect()} == {"ann", "bob"}


def test_a_workbook_is_parsed_once(spark, tmp_path, monkeypatch):
    """Sheets come in the workbook's order, whole, however often they are read, from one reading of the file."""
    two = [("Z", [NAMES[:2], *[[f"u{k}", "n" if k % 3 else None] for k in range(25)]]), ("A", [["Login", "Name"], ("dan", "Dan")])]
    path = put(tmp_path, "a.xlsx", workbook(two))
    monkeypatch.setattr(D, "ROWS", 10)
    found = D.sheets(spark, path)
    (tmp_path / "a.xlsx").unlink()
    assert list(found) == ["Z", "A"] and found["Z"].count() == 25 and found["A"].first().Login == "dan"
    assert {r.Username for r in found["Z"].collect()} == {f"u{k}" for k in range(25)}
