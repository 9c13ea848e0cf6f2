"""Views of accounts, HR lists and logs over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

REF = date(2001, 8, 2)

_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(m AS INT) * 3 - 2, 3)"
_MOIS = "trim(substr('janvier  février  mars     avril    mai      juin     juillet  août     septembreoctobre  novembre décembre ', CAST(m AS INT) * 9 - 8, 9))"
_LOGIN = f"""CASE k % 23
  WHEN 0 THEN NULL WHEN 1 THEN 'never' WHEN 2 THEN '  ' WHEN 3 THEN d || '/' || m || '/' || y WHEN 4 THEN d || '.' || m || '.' || y || ' 08:15'
  WHEN 5 THEN y || m || d WHEN 6 THEN s1 || 'T14:30:00+02:00' WHEN 7 THEN '1970-01-01 00:00:00' WHEN 8 THEN 'garbage'
  WHEN 9 THEN d || '-' || {_MON} || '-' || y WHEN 10 THEN 'unknown' WHEN 11 THEN d || {_MON} || y WHEN 12 THEN y || ' ' || {_MON} || ' ' || d
  WHEN 13 THEN {_MON} || '/' || d || '/' || y WHEN 14 THEN 'Fri ' || {_MON} || ' ' || d || ' 16:05' WHEN 15 THEN s1 || ' garbage' WHEN 16 THEN s1 || 'zzz'
  WHEN 17 THEN d || ' ' || {_MOIS} || ' ' || y WHEN 18 THEN {_MON} || ' ' || d || ', ' || y || ' 7:45 pm' ELSE s1 END"""

_ACCOUNTS = """SELECT k AS line_no,
  CASE k % 29 WHEN 0 THEN 'svc_app' || t WHEN 1 THEN 'Test.Person' || t WHEN 2 THEN 'admin.' || t WHEN 3 THEN 'Guest' || t WHEN 4 THEN 'oracle_' || t
    WHEN 5 THEN 'qa_' || t WHEN 6 THEN ' DBA ' WHEN 7 THEN 'mtnl' || t WHEN 8 THEN 'backup-adm' WHEN 9 THEN NULL WHEN 10 THEN '  ' WHEN 11 THEN 'pam.' || t
    ELSE CASE WHEN k % 2 = 0 THEN upper('c' || t) ELSE 'c' || t END END AS username,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'N/A' ELSE
    trim(substr('Anna  Boris Clara David Elena Felix Greta ', CAST((k % 7) * 6 + 1 AS INT), 6)) || ' ' || CASE WHEN k % 11 = 3 THEN 'J. ' ELSE '' END
    || trim(substr('Moreau Novak  OBrien Petrov Quinn  Rossi  Schulz ', CAST((k % 49 - k % 7) + 1 AS INT), 7)) || CASE WHEN k % 3 = 0 THEN '' ELSE substr('abcdefghijklmnopqrs', CAST(k % 19 + 1 AS INT), 1) END END AS full_name,
  system,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 0 THEN '  ' ELSE 'mgr' || CAST(k % 50 AS STRING) END AS manager,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'Dept ' || CAST(k % 8 AS STRING) END AS department,
  CASE (k + {shift}) % 16 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Disabled' WHEN 3 THEN 'LOCKED' WHEN 4 THEN 'Y-Active' WHEN 5 THEN 'N-inactive' WHEN 6 THEN 'Not Active'
    WHEN 7 THEN '-1' WHEN 8 THEN '1' WHEN 9 THEN ' Enabled ' WHEN 10 THEN 'Weird' WHEN 11 THEN '0' WHEN 12 THEN 'Suspended 2000' ELSE 'Active' END AS account_status,
  CASE k % 9 WHEN 0 THEN 'Terminated' WHEN 1 THEN 'resigned' WHEN 2 THEN NULL ELSE 'On staff' END AS employee_status,
  CASE k % 31 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' ADMIN ' ELSE NULL END AS is_privileged,
  CASE k % 37 WHEN 0 THEN '1' WHEN 1 THEN 'false' ELSE NULL END AS is_locked,
  {login} AS last_login_date,
  CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'n/a' WHEN k % 10 = 2 THEN d9 || '/' || m9 || '/' || y9 ELSE s0 END AS account_created_date,
  CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN s0 ELSE s1 END AS password_last_set,
  CASE WHEN k % 15 = 0 THEN 'Never expires' WHEN k % 15 = 1 THEN 'ok' ELSE NULL END AS password_status,
  CASE (k + {shift}) % 12 WHEN 0 THEN 'Create Payment;Approve Payment' WHEN 1 THEN 'Administrator' WHEN 2 THEN 'Viewer' WHEN 3 THEN 'Create Vendor, Clerk' WHEN 4 THEN 'Approve Payment'
    WHEN 5 THEN 'fixed_assets_responsable' WHEN 6 THEN 'Administrative Assistant' WHEN 7 THEN 'admin_sql;Reader' WHEN 8 THEN 'System Admin' || chr(10) || 'Auditor' WHEN 9 THEN NULL WHEN 10 THEN 'Developer;;Tester' ELSE 'Clerk' END AS role,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'READ;WRITE' WHEN k % 4 = 2 THEN 'read, Approve' ELSE 'FULL_LEDGER' END AS user_rights
FROM (SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS t, n_name AS system, s1, s0, substr(s1, 1, 4) AS y, substr(s1, 6, 2) AS m, substr(s1, 9, 2) AS d, substr(s0, 1, 4) AS y9, substr(s0, 6, 2) AS m9, substr(s0, 9, 2) AS d9
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS s0, CAST(max(CAST(o_orderdate AS DATE)) AS STRING) AS s1 FROM {orders} WHERE o_orderdate < TIMESTAMP '{until}' GROUP BY o_custkey) o ON o_custkey = c_custkey
  WHERE {keep}) x"""

CURRENT = {"shift": 0, "login": _LOGIN, "until": "2100-01-01", "keep": "c_custkey % 23 <> 5"}
PREVIOUS = {"shift": 3, "login": _LOGIN, "until": "2000-01-01", "keep": "c_custkey % 19 <> 0"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

HR = """SELECT c_custkey AS line_no, CASE WHEN c_custkey % 3 = 0 THEN 'C' ELSE ' c' END || CAST(c_custkey - c_custkey % 2 AS STRING) AS hr_username,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Terminated' WHEN 'MACHINERY' THEN 'On leave' ELSE 'Active' END AS hr_employee_status,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'HR ' || c_mktsegment END AS hr_department FROM {customer} WHERE c_custkey % 7 <> 0"""
HR_NAMES = """SELECT line_no, full_name, CASE WHEN line_no % 2 = 0 THEN 'Active' ELSE 'Terminated' END AS hr_employee_status FROM ({accounts}) a WHERE full_name IS NOT NULL AND full_name NOT LIKE 'Greta%'
  UNION ALL SELECT k, 'Only Once ' || CAST(k AS STRING), 'On leave' FROM (SELECT min(line_no) AS k FROM ({accounts}) b) c"""
#: Everybody; some under another first name, so that there are accounts that match nobody.
PEOPLE = """SELECT DISTINCT CASE WHEN full_name LIKE 'Greta%' OR full_name LIKE 'Felix%' THEN 'Zoltan' || substr(full_name, 6) ELSE full_name END AS full_name FROM ({accounts}) p WHERE full_name IS NOT NULL"""
LOG = """SELECT lower(trim(username)) || '::' || lower(trim(system)) AS key, CAST(line_no * 10 + l.seq AS BIGINT) AS seq, CASE (line_no + l.seq) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'revoked' WHEN 2 THEN 'pending' ELSE 'modified' END AS status,
  'auditor' || CAST(l.seq AS STRING) AS validated_by, '' AS comment, '2001-07-0' || CAST(l.seq AS STRING) AS ts
  FROM ({accounts}) a CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) l WHERE username IS NOT NULL AND line_no % 5 >= l.seq"""
ACCEPTANCES = """SELECT username, system, CASE line_no % 3 WHEN 0 THEN 'is_dormant' WHEN 1 THEN 'is_privileged_flag' ELSE 'is_password_stale' END AS finding, 'label' AS label, 'why' AS comment, 'ciso' AS accepted_by,
  '2001-01-01' AS accepted_date, CASE line_no % 4 WHEN 0 THEN '2001-07-01' WHEN 1 THEN 'someday' ELSE '2002-01-01' END AS expiration_date, line_no AS seq FROM ({accounts}) a WHERE username IS NOT NULL AND trim(username) <> '' AND line_no % 2 = 0"""


def text(sql: str, names: dict[str, str] | None = None, **how) -> str:
    """A view's SQL with its tables named as in ``names`` (themselves, if not given)."""
    names = names or {t: t for t in TABLES}
    if "{accounts}" in sql:
        how = {"accounts": text(_ACCOUNTS, names, **CURRENT), **how}
    return sql.format(**names, **how)


ACCOUNTS_SQL = text(_ACCOUNTS, **CURRENT)
PREVIOUS_SQL = text(_ACCOUNTS, **PREVIOUS)


def view(spark: SparkSession, sf_dir: str, sql: str, **how) -> DataFrame:
    """A view's DataFrame over the Parquet tables of ``sf_dir``."""
    return spark.sql(text(sql, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}, **how))


def accounts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, _ACCOUNTS, **CURRENT)


def previous(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, _ACCOUNTS, **PREVIOUS)
