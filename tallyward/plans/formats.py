"""Queries of ingestion and standardising over strings built from the account views: key, DataFrame, SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as T
from ..functions import vocab as V
from ..operators import reports as G
from ..operators import review as A
from ..operators import sinks as W
from ..operators import standard as N
from ..sources import documents as O
from ..sources import stores as R
from ..sources import text as S
from . import testdata as D
from .oracle import BASE, blank, cells, words

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_ACC = f"a AS ({D.ACCOUNTS_SQL})"
_RAW = {"SAM_Account-Name": "username", "Nom complet": "full_name", "Host Name": "system", "Statut": "account_status", "Last Logon": "last_login_date", "whenCreated": "account_created_date", "N+1": "manager", "departement": "department", "Shoe Size": None, "Last Pasword Change": "password_last_set"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {'NULL' if f is None else repr(f)})" for h, f in _RAW.items()) + ") v(header, field)")
def header_match(spark, d):
    return spark.createDataFrame([(h, H.match(h)) for h in _RAW], "header string, field string")


@query(f"WITH {_ACC} SELECT line_no, username, system, department, account_status FROM a")
def renamed_columns(spark, d):
    raw = D.accounts(spark, d).select("line_no", F.col("username").alias("User Logon Name"), F.col("system").alias("HOST_NAME"), F.col("department").alias("Département"), F.col("account_status").alias("Etat-compte"))
    return N.standardise(raw).df.select("line_no", "username", "system", "department", "account_status")


@query(f"WITH {_ACC} SELECT line_no, coalesce(CASE WHEN NOT {blank('manager')} THEN manager END, CASE WHEN NOT {blank('department')} THEN department END) AS manager FROM a")
def dup_column_coalesce(spark, d):
    raw = D.accounts(spark, d).select("line_no", F.col("manager").alias("manager"), F.col("department").alias("owner"))
    return N.standardise(raw).df.select("line_no", "manager")


@query(f"WITH {_ACC}, b AS (SELECT *, CASE WHEN NOT {blank('manager')} THEN manager END AS x, CASE WHEN NOT {blank('department')} THEN department END AS y FROM a) SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND trim(x) <> trim(y)) AS n_different FROM b")
def column_disagreement(spark, d):
    return N.disagreements(D.accounts(spark, d), "manager", "department")


@query(f"WITH {_ACC}, b AS (SELECT line_no, CASE WHEN line_no % 3 = 0 THEN ' TRUE' WHEN line_no % 3 = 1 THEN 'no' ELSE account_status END AS v FROM a) SELECT line_no, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes', 'y', 'oui') THEN 'Disabled' WHEN lower(trim(v)) IN ('false', '0', 'no', 'n', 'non') THEN 'Active' ELSE v END AS account_status FROM b")
def bool_inversion(spark, d):
    v = F.when(F.col("line_no") % 3 == 0, " TRUE").when(F.col("line_no") % 3 == 1, "no").otherwise(F.col("account_status"))
    raw = D.accounts(spark, d).select("line_no", v.alias("account disabled"))
    return N.standardise(raw, learned={"account disabled": "account_status" + H.INVERTED}).df.select("line_no", "account_status")


_LIKE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|^\d{1,2}[- ]\p{L}{3,}[- ]\d{2,4}"


@query(f"WITH {_ACC} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN length(trim({c})) > 5 THEN CASE WHEN regexp_matches(trim({c}), '{_LIKE}') THEN 1.0 ELSE 0.0 END END), 6) AS share, min(CASE WHEN length(trim({c})) > 5 THEN trim({c}) END) <> max(CASE WHEN length(trim({c})) > 5 THEN trim({c}) END) AS varies FROM a" for c in ("last_login_date", "account_created_date", "full_name")))
def date_column_autodetect(spark, d):
    return N.date_shares(D.accounts(spark, d), ["last_login_date", "account_created_date", "full_name"])


@query(f"WITH {_ACC} SELECT line_no, account_created_date AS last_login_date, password_last_set FROM a")
def date_columns_named(spark, d):
    raw = D.accounts(spark, d).select("line_no", F.col("account_created_date").alias("alpha"), F.col("password_last_set").alias("beta"))
    return N.detect_dates(raw).select("line_no", "last_login_date", "password_last_set")


@query(f"WITH {_ACC} SELECT line_no, CASE WHEN NOT {blank('username')} THEN trim(username) END AS username FROM a")
def login_from_home(spark, d):
    raw = D.accounts(spark, d).select("line_no", F.concat(F.lit("/home/"), F.coalesce(F.trim("username"), F.lit("")), F.lit("/")).alias("home"), "username")
    raw = raw.select("line_no", F.when(T.blank(F.col("username")), "/").otherwise(F.col("home")).alias("home_directory"))
    return N.login_from_home(raw).select("line_no", "username")


@query(f"WITH {_ACC} SELECT line_no, CASE WHEN line_no % 2 = 0 THEN 'id' || CAST(line_no AS VARCHAR) ELSE 'real' END AS username FROM a")
def specific_login(spark, d):
    raw = D.accounts(spark, d).select("line_no", F.when(F.col("line_no") % 2 == 0, " Admin ").otherwise("real").alias("username"), F.concat(F.lit("CORP\\id"), F.col("line_no").cast("string")).alias("Identity"))
    return N.specific_login(raw).select("line_no", "username")


@query(f"WITH {_ACC}, b AS (SELECT line_no, CASE WHEN line_no % 4 <> 0 THEN ' Ann ' END AS f, CASE WHEN line_no % 3 <> 0 THEN 'L' || CAST(line_no AS VARCHAR) END AS l, CASE WHEN line_no % 5 = 0 THEN full_name END AS n FROM a) SELECT line_no, CASE WHEN NOT {blank('n')} THEN n WHEN f IS NOT NULL AND l IS NOT NULL THEN 'Ann ' || l WHEN f IS NOT NULL THEN 'Ann' ELSE l END AS full_name FROM b")
def full_name_made(spark, d):
    k = F.col("line_no")
    raw = D.accounts(spark, d).select("line_no", F.when(k % 4 != 0, " Ann ").alias("first_name"), F.when(k % 3 != 0, F.concat(F.lit("L"), k.cast("string"))).alias("last_name"), F.when(k % 5 == 0, F.col("full_name")).alias("full_name"))
    return N.full_name(raw).select("line_no", "full_name")


@query("SELECT * FROM (VALUES ('system'), ('username')) v(missing)")
def required_fields(spark, d):
    raw = D.accounts(spark, d).select(F.lit(" ").alias("username"), "full_name")
    return spark.createDataFrame([(c,) for c in N.validate(raw, strict=False)], "missing string")


@query(f"WITH {_ACC} SELECT line_no, coalesce(CASE WHEN NOT {blank('department')} THEN department END, 'export') AS system FROM a")
def system_default(spark, d):
    return N.with_system(D.accounts(spark, d).select("line_no", F.col("department").alias("system")), "export").select("line_no", "system")


@query(f"WITH {_ACC} SELECT line_no, coalesce(lower(trim(is_locked)) NOT IN {words(V.FALSE_WORDS)}, false) AS flag FROM a")
def flag_from_text(spark, d):
    return D.accounts(spark, d).select("line_no", T.as_flag(F.col("is_locked"), V.FALSE_WORDS).alias("flag"))


@query(f"WITH {_ACC} SELECT line_no, username || 'x' AS username FROM a WHERE username IS NOT NULL")
def control_characters(spark, d):
    return D.accounts(spark, d).where("username is not null").select("line_no", T.without_controls(F.concat(F.col("username"), F.lit("\x01\x1f"), F.lit("x"))).alias("username"))


@query(f"WITH {_ACC} SELECT line_no, unnest({cells('role')}) AS role FROM a")
def role_parts(spark, d):
    return D.accounts(spark, d).select("line_no", F.explode(T.cells(F.col("role"))).alias("role"))


@query(f"WITH {_ACC} SELECT line_no, CASE WHEN account_status IS NULL THEN NULL WHEN regexp_full_match(trim(account_status), '[+-]?\\d+') THEN CAST(CAST(trim(account_status) AS BIGINT) AS VARCHAR) ELSE trim(regexp_replace(lower(trim(account_status)), '[^a-z0-9]+', ' ', 'g')) END AS status_key FROM a")
def status_keys(spark, d):
    return D.accounts(spark, d).select("line_no", T.status_key(F.col("account_status")).alias("status_key"))


@query(f"WITH {_ACC} SELECT line_no, array_to_string(list_sort(regexp_extract_all(lower(full_name), '[a-z]+')), ' ') AS bag FROM a WHERE full_name IS NOT NULL")
def name_bags(spark, d):
    return D.accounts(spark, d).where("full_name is not null").select("line_no", T.name_bag(F.col("full_name")).alias("bag"))


@query(f"WITH {_ACC}, b AS (SELECT lower(trim(username)) || '::' || lower(trim(system)) AS k FROM a WHERE username IS NOT NULL) SELECT k AS account_key, count(*) AS accounts FROM b GROUP BY k HAVING count(*) > 1")
def account_keys(spark, d):
    from ..operators.cycles import account_key

    return D.accounts(spark, d).where("username is not null").groupBy(account_key("username", "system").alias("account_key")).agg(F.count("*").alias("accounts")).where("accounts > 1")


# ---- formats over strings ---------------------------------------------------------------

_UAC = "CASE WHEN line_no % 3 = 0 THEN 514 ELSE 512 END"


@query(f"WITH {_ACC} SELECT line_no, 'u' || CAST(line_no AS VARCHAR) AS \"sAMAccountName\", system || ' x' AS cn, CASE WHEN line_no % 3 = 0 THEN 'Disabled' ELSE 'Active' END AS \"userAccountControl\" FROM a")
def ldif_parse(spark, d):
    block = F.concat(F.lit("# entry\ndn: x\nsAMAccountName: u"), F.col("line_no").cast("string"), F.lit("\ncn: "), F.substring("system", 1, 3), F.lit("\n "), F.expr("substring(system, 4)"), F.lit(" x\ncn: second\nuserAccountControl: "), F.expr(_UAC).cast("string"))
    pairs = S.ldif_entries(D.accounts(spark, d).select(F.col("line_no").alias("block_no"), block.alias("block")))
    return S.pairs_to_table(pairs, ["sAMAccountName", "cn", "userAccountControl"])


@query(f"WITH {_ACC} SELECT line_no, 'u' || CAST(line_no AS VARCHAR) AS \"Login\", system AS \"Host name\" FROM a")
def kv_parse(spark, d):
    block = F.concat(F.lit("- Login : u"), F.col("line_no").cast("string"), F.lit("\n* Host name= "), F.col("system"), F.lit("\nno pair here\n"))
    return S.pairs_to_table(S.key_values(D.accounts(spark, d).select(F.col("line_no").alias("block_no"), block.alias("block"))), ["Login", "Host name"])


def _lines(spark, d, sep: str):
    """The accounts as lines of text under a title and a header line; line numbers follow line_no."""
    body = D.accounts(spark, d).select(F.col("line_no"), F.concat_ws(sep, F.concat(F.lit("u"), F.col("line_no").cast("string")), "system", F.coalesce("department", F.lit("none"))).alias("line"))
    top = spark.createDataFrame([(-2, "Export of accounts"), (-1, sep.join(["User name", "Application", "Department"])), (0, sep.join(["u0", "none", "none"]))], "line_no long, line string")
    return top.union(body)


_TABLE = f"WITH {_ACC} SELECT line_no, 'u' || CAST(line_no AS VARCHAR) AS username, system, coalesce(department, 'none') AS department FROM a UNION ALL SELECT 0, 'u0', 'none', 'none'"


@query(_TABLE)
def fixed_width_parse(spark, d):
    return N.standardise(S.fixed_width(_lines(spark, d, "   "))).df.select("line_no", "username", "system", "department")


@query(_TABLE)
def delimited_parse(spark, d):
    return N.standardise(S.delimited(_lines(spark, d, "|"), "|")).df.select("line_no", "username", "system", "department")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS props_k, event_type AS deep_kind FROM events")
def json_flatten(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    nested = ev.select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("kind")).alias("deep"))
    return S.flatten(nested).select(F.col("event_id").cast("long").alias("event_id"), "props_k", "deep_kind")


# ---- files: written to the shared folder, read by the package's readers -----------------

_FILE = "SELECT line_no, coalesce(username, '') AS username, system, coalesce(role, '') AS role, coalesce(department, '') AS department FROM a"
_FILE_SQL = f"WITH {_ACC} {_FILE}"


def _exported(spark, d):
    """Accounts as an export has them: every value text, none null, line ends in roles."""
    blank_ = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return D.accounts(spark, d).select("line_no", blank_("username"), "system", blank_("role"), blank_("department"))


def _put(lines, name: str) -> str:
    """Lines (order, value) as one file of the shared folder."""
    path = f"{O.shared_folder(lines.sparkSession)}/{name}"
    lines.orderBy("at").select("value").coalesce(1).write.text(path)
    return path


def _read(df):
    """What a reader found, by the accounts' own numbers; null is blank."""
    return df.select(F.col("number").cast("long").alias("line_no"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("username", "system", "role", "department")])


def _canonical(raw):
    return _read(N.standardise(raw.withColumnRenamed("line_no", "_at").withColumnRenamed("Line", "number")).df)


@query(_FILE_SQL)
def csv_source(spark, d):
    path = f"{O.shared_folder(spark)}/accounts.csv"
    acc = _exported(spark, d).selectExpr("line_no as Line", "username as `User Name`", "system as `Host`", "role as `Rôle`", "department as `Département`")
    acc.coalesce(1).write.csv(path, header=True, sep=";", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _canonical(S.csv(spark, path))


@query(f"WITH {_ACC} SELECT line_no, trim(coalesce(username, '')) AS username, system, replace(coalesce(role, ''), chr(10), ',') AS role, coalesce(department, '') AS department FROM a")
def text_source(spark, d):
    acc = _exported(spark, d)
    value = F.concat_ws("\t", F.col("line_no").cast("string"), "username", "system", F.translate("role", "\n", ","), "department")
    top = spark.createDataFrame([(-2, "Export of accounts"), (-1, "\t".join(["Line", "Login", "Application", "Profil", "Service"]))], "at long, value string")
    return _canonical(S.text(spark, _put(top.union(acc.select(F.col("line_no").alias("at"), value.alias("value"))), "accounts.txt")))


@query(f"WITH {_ACC} SELECT line_no, trim(coalesce(username, '')) AS username, system, replace(coalesce(role, ''), chr(10), ',') AS role, coalesce(department, '') AS department FROM a")
def key_value_source(spark, d):
    acc = _exported(spark, d)
    value = F.concat(F.lit("Line: "), F.col("line_no").cast("string"), F.lit("\nLogin: "), "username", F.lit("\nHost name = "), "system", F.lit("\n- Role: "), F.translate("role", "\n", ","), F.lit("\nService: "), "department", F.lit("\n"))
    return _canonical(S.text(spark, _put(acc.select(F.col("line_no").alias("at"), value.alias("value")), "accounts.txt")))


@query(f"WITH {_ACC} SELECT line_no, trim(coalesce(username, '')) AS username, 'Directory' AS system, replace(coalesce(role, ''), chr(10), ',') AS role, coalesce(department, '') AS department FROM a")
def ldif_source(spark, d):
    acc = _exported(spark, d)
    value = F.concat(F.lit("# entry\ndn: cn=x\nline: "), F.col("line_no").cast("string"), F.lit("\nsAMAccountName: "), "username", F.lit("\nmemberOf: "), F.translate("role", "\n", ","), F.lit("\ndepartment: "), F.substring("department", 1, 2), F.lit("\n "), F.expr("substring(department, 3)"), F.lit("\n"))
    raw = S.ldif(spark, _put(acc.select(F.col("line_no").alias("at"), value.alias("value")), "accounts.ldif"), "Directory")
    return _canonical(raw.withColumnRenamed("line", "Line"))


@query(_FILE_SQL)
def json_source(spark, d):
    acc = _exported(spark, d).select(F.col("line_no").alias("at"), F.to_json(F.struct(F.col("line_no").alias("Line"), F.struct("username", F.col("system").alias("host")).alias("user"), "role", "department")).alias("value"))
    raw = S.json(spark, _put(acc, "accounts.json"))
    return _canonical(raw.withColumnsRenamed({"user_username": "login", "user_host": "host"}))


@query(f"WITH {_ACC} SELECT line_no, trim(coalesce(username, '')) AS username, system, coalesce(role, '') AS role, coalesce(department, '') AS department FROM a")
def xml_source(spark, d):
    path = f"{O.shared_folder(spark)}/accounts.xml"
    _exported(spark, d).withColumnRenamed("line_no", "Line").write.format("xml").options(rootTag="accounts", rowTag="account").save(path)
    return _canonical(O.xml(spark, path))


@query(f"WITH {_ACC} SELECT line_no, trim(coalesce(username, '')) AS username, system, trim(regexp_replace(coalesce(role, ''), '\\s+', ' ', 'g')) AS role, coalesce(department, '') AS department FROM a")
def html_source(spark, d):
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("</td>"))
    rows = _exported(spark, d).select(F.col("line_no").alias("at"), F.concat(F.lit("<tr>"), *[cell(c) for c in ("line_no", "username", "system", "role", "department")], F.lit("</tr>")).alias("value"))
    top = spark.createDataFrame([(-2, "<html><table><tr><td>menu</td><td>home</td></tr></table><h1>Accounts</h1><table>"), (-1, "<tr><th>Line</th><th>User</th><th>Host</th><th>Role</th><th>Department</th></tr>"), (1 << 60, "</table></html>")], "at long, value string")
    return _canonical(O.html(spark, _put(top.union(rows), "accounts.html")))


@query(f"WITH {_ACC}, l AS (SELECT line_no, 'c' || CAST(line_no AS VARCHAR) AS username, coalesce(department, '') AS department FROM a WHERE line_no % 3 <> 0), r AS (SELECT line_no, 'c' || CAST(line_no AS VARCHAR) AS username, coalesce(manager, '') AS manager FROM a WHERE line_no % 3 <> 1) SELECT coalesce(l.username, r.username) AS username, coalesce(department, '') AS department, trim(coalesce(manager, '')) AS manager FROM l FULL JOIN r USING (username)")
def archive_source(spark, d):
    """Two members that share two thirds of their logins: merged by column."""
    acc = D.accounts(spark, d)
    part = lambda keep, c: acc.where(keep).select(F.col("line_no").alias("at"), F.concat_ws(";", F.concat(F.lit("c"), F.col("line_no").cast("string")), F.coalesce(F.trim(c), F.lit(""))).alias("value"))
    top = lambda *names: spark.createDataFrame([(-1, ";".join(names))], "at long, value string")
    members = {"q1/accounts.csv": top("Login", "Department").union(part("line_no % 3 <> 0", "department")), "q2/accounts.csv": top("Login", "Manager").union(part("line_no % 3 <> 1", "manager"))}
    path = O.shared_folder(spark) + "/accounts.zip"
    content = {n: "\n".join(r.value for r in m.orderBy("at").toLocalIterator()) for n, m in members.items()}  # an archive of a few exports is made by the driver
    O.put_archive(spark, path, content)
    out = O.archive(spark, path)
    return out.select("username", F.coalesce("department", F.lit("")).alias("department"), F.coalesce("manager", F.lit("")).alias("manager"))


@query(f"SELECT key, seq, status, validated_by, comment, ts FROM ({D.text(D.LOG)}) x")
def log_store(spark, d):
    """The log appended in three entries and read as one table."""
    path = O.shared_folder(spark) + "/log"
    log = D.view(spark, d, D.LOG)
    for k in range(3):
        R.append(log.where(F.col("seq") % 3 == k), path)
    return R.read_table(spark, path, R.LOG_SCHEMA)


_COUNTED = BASE + " SELECT CAST(n AS INT) AS number, c AS accounts FROM (VALUES " + ", ".join(f"({n}, (SELECT count(*) FROM an WHERE {cond}))" for n, cond in {2: "is_dormant", 3: "is_orphaned_account AND is_active_for_audit", 4: "is_test_account AND is_active_for_audit", 5: "is_active_for_audit", 6: "is_never_used", 7: "is_service_account AND is_active_for_audit", 8: "is_duplicate_account", 10: "is_recently_created", 14: "is_password_stale AND is_active_for_audit", 16: "is_privileged_flag AND is_active_for_audit", 18: "is_terminated_but_active"}.items()) + ") v(n, c)"


@query(_COUNTED)
def workbook_tables(spark, d):
    """Rows of each control's table in a written workbook."""
    acc = D.accounts(spark, d)
    an = A.analyse(acc, A.Settings(D.REF), known={c: {"day_first": True} for c in A.DATE_COLUMNS})
    folder = O.shared_folder(spark) + "/book"
    W.write_workbook(an, G.control_coverage(an, had=set(acc.columns)), folder)
    return _counts({n: spark.read.parquet(f"{folder}/control_{n:02}") for n in (2, 3, 4, 5, 6, 7, 8, 10, 14, 16, 18)})


def _counts(tables):
    out = None
    for n, t in tables.items():
        one = t.agg(F.lit(n).alias("number"), F.count("*").alias("accounts"))
        out = one if out is None else out.union(one)
    return out


@query(_COUNTED)
def excel_report(spark, d):
    """Rows of each control's sheet in a workbook, written and read again."""
    acc = D.accounts(spark, d)
    an = A.analyse(acc, A.Settings(D.REF), known={c: {"day_first": True} for c in A.DATE_COLUMNS})
    path = O.shared_folder(spark) + "/book.xlsx"
    W.write_excel(an, G.control_coverage(an, had=set(acc.columns)), path)
    sheets = O.sheets(spark, path)
    return _counts({n: sheets[f"Control {n:02}"] for n in (2, 3, 4, 5, 6, 7, 8, 10, 14, 16, 18)})


@query(BASE + " SELECT l AS risk, CAST((SELECT count(*) FROM an WHERE risk_level = k) AS VARCHAR) AS accounts FROM (VALUES ('Critique', 'Critical'), ('Élevé', 'High'), ('Moyen', 'Medium'), ('Faible', 'Low')) v(k, l)")
def word_report(spark, d):
    """The table of risk levels of a Word report, written and read again."""
    acc = D.accounts(spark, d)
    an = A.analyse(acc, A.Settings(D.REF), known={c: {"day_first": True} for c in A.DATE_COLUMNS})
    path = O.shared_folder(spark) + "/report.docx"
    W.write_word(spark, W.report_blocks(G.control_coverage(an, had=set(acc.columns)), G.risk_histogram(an), G.status_breakdown(acc)), path)
    raw = O._parsed(spark, path, lambda c: [(f"{k}", t) for k, t in enumerate(O.word_tables(c)[0])])
    return raw.where("name = '1' and line_no > 0").select(F.get("cells", F.lit(0)).alias("risk"), F.get("cells", F.lit(1)).alias("accounts"))


@query(f"WITH m AS (SELECT * FROM (VALUES (0, 'a', 'b'), (1, ' ', 'c'), (2, 'Same', 'same '), (3, 'x', 'y')) v(k, a, b)) SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS pos, a AS role_a, b AS role_b FROM m WHERE trim(a) <> '' AND trim(b) <> '' AND lower(trim(a)) <> lower(trim(b))")
def conflict_matrix(spark, d):
    """A file of pairs as its reader takes it."""
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(["Role;Against", "a;b", " ;c", "Same;same ", "x;y"])], "at long, value string")
    rows = R.conflict_matrix(spark, _put(lines, "matrix.csv"))
    return rows.select((F.dense_rank().over(Window.orderBy("pos")) - 1).cast("int").alias("pos"), "role_a", "role_b")


@query(f"WITH {_ACC} SELECT line_no, length(role) AS n, regexp_matches(lower(role), '(^|[^a-z0-9_])({'|'.join(V.PRIVILEGED_ROLE_WORDS)})([^a-z0-9_]|$)') OR regexp_matches(lower(role), '{V.ADMIN_GROUP.replace('?:', '')}') OR regexp_matches(lower(role), '{'|'.join(V.PRIVILEGED_ROLE_PARTS)}') AS privileged FROM a WHERE role IS NOT NULL")
def privileged_roles(spark, d):
    return D.accounts(spark, d).where("role is not null").select("line_no", F.length("role").cast("long").alias("n"), A.is_privileged_role(F.col("role")).alias("privileged"))


@query(f"WITH {_ACC} SELECT line_no, username, system FROM a WHERE line_no % 3 <> 0")
def blank_rows_dropped(spark, d):
    keep = F.col("line_no") % 3 != 0
    raw = D.accounts(spark, d).select("line_no", F.when(keep, F.col("username")).otherwise(F.lit(" ")).alias("username"), F.when(keep, F.col("system")).alias("system"))
    return N.without_blank_rows(raw, leaving=("line_no",))


@query(f"WITH {_ACC} SELECT line_no, manager AS owner, department AS owner__dup1, system AS unnamed_3 FROM a")
def names_made_unique(spark, d):
    acc = D.accounts(spark, d)
    names = N.unique_names(["line_no", " owner", "owner ", None])
    return acc.select("line_no", "manager", "department", "system").toDF(*names)


@query(f"""WITH {_ACC}, p AS (SELECT line_no, line_no % 50 AS document, row_number() OVER (PARTITION BY line_no % 50 ORDER BY line_no) AS r, username, system FROM a)
 SELECT document, CAST(ceil(r / 3.0) AS BIGINT) AS group_no, coalesce(username, '') AS username, system FROM p""")
def positioned_tables(spark, d):
    """Positioned rows of fifty documents: a table of three accounts under headers, a repeated header and a stray line, again and again."""
    acc = D.accounts(spark, d).select("line_no", (F.col("line_no") % 50).alias("document"), F.coalesce("username", F.lit("")).alias("username"), "system")
    r = F.row_number().over(Window.partitionBy("document").orderBy("line_no"))
    placed = acc.withColumn("r", r).withColumns({"page": F.floor((F.col("r") - 1) / 3), "row": ((F.col("r") - 1) % 3) * 3})
    head = lambda row: placed.where("row = 0").select("document", "page", F.lit(row).alias("row"), F.array(F.concat(F.lit("Login"), F.when(F.col("page") % 2 == 0, "").otherwise("s")), F.lit("Host name")).alias("cells"))
    stray = placed.where("row = 0").select("document", "page", F.lit(2).alias("row"), F.array(F.lit("page"), F.lit("of"), F.lit("many")).alias("cells"))
    body = placed.select("document", "page", F.col("row"), F.array("username", "system").alias("cells"))
    rows = head(-2).unionByName(head(1)).unionByName(stray).unionByName(body)
    groups = S.table_groups(rows).where("row >= 0")
    return groups.select("document", F.col("group_no").cast("long").alias("group_no"), F.get("cells", F.lit(0)).alias("username"), F.get("cells", F.lit(1)).alias("system"))
