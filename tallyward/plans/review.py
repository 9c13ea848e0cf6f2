"""Queries of the review over the account views: key, DataFrame, SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.dates import age_days, conventions, day_of, quarter_label
from ..operators import cycles as C
from ..operators import people as P
from ..operators import reports as R
from ..operators import review as A
from ..operators import sinks as W
from . import testdata as D
from .oracle import BASE, BOTH, age, blank, cells, day, seconds, words

QUERIES, ORACLE = {}, {}
DAY_FIRST = {c: {"day_first": True} for c in A.DATE_COLUMNS}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def analysed(spark, d, acc=None):
    return A.analyse(D.accounts(spark, d) if acc is None else acc, A.Settings(D.REF), known=DAY_FIRST)


def analysed_before(spark, d):
    return A.analyse(D.previous(spark, d), A.Settings(D.REF), known=DAY_FIRST)


def n(c="*"):
    return F.count(c).cast("long")


# ---- flags ------------------------------------------------------------------------------

@query(BASE + " SELECT system, count(*) AS accounts, count(*) FILTER (is_dormant) AS dormant FROM an GROUP BY system")
def dormant_by_system(spark, d):
    return analysed(spark, d).groupBy("system").agg(n().alias("accounts"), F.count_if("is_dormant").alias("dormant"))


@query(BASE + " SELECT line_no, last_login_date, days_since_last_login, is_never_used, last_login_date_unparseable, is_dormant FROM an")
def never_used(spark, d):
    return analysed(spark, d).select("line_no", "last_login_date", "days_since_last_login", "is_never_used", "last_login_date_unparseable", "is_dormant")


@query(BASE + " SELECT line_no, days_since_creation, is_recently_created FROM an")
def recently_created(spark, d):
    return analysed(spark, d).select("line_no", "days_since_creation", "is_recently_created")


@query(BASE + " SELECT account_status, is_active_for_audit AS active, status_is_unknown AS unknown, is_locked, count(*) AS accounts FROM an GROUP BY ALL")
def status_resolution(spark, d):
    return analysed(spark, d).groupBy("account_status", F.col("is_active_for_audit").alias("active"), F.col("status_is_unknown").alias("unknown"), "is_locked").agg(n().alias("accounts"))


@query(BASE + " SELECT account_status, CASE WHEN status_is_unknown THEN 'unknown, taken for active' WHEN is_active_for_audit THEN 'active' ELSE 'inactive' END AS meaning, count(*) AS accounts FROM an GROUP BY ALL")
def status_values(spark, d):
    return R.status_values(D.accounts(spark, d))


@query(BASE + " SELECT CASE WHEN lower(trim(account_status)) = 'weird' THEN 'inactive' WHEN lower(trim(account_status)) = 'disabled' THEN 'active' WHEN is_active_for_audit THEN 'active' ELSE 'inactive' END AS meaning, count(*) AS accounts FROM an GROUP BY ALL")
def learned_statuses(spark, d):
    st = A.status(F.col("account_status"), {"weird": "inactive", "disabled": "active"})
    return D.accounts(spark, d).groupBy(F.when(st.getField("active"), "active").otherwise("inactive").alias("meaning")).agg(n().alias("accounts"))


@query(BASE + " SELECT line_no, is_locked FROM an WHERE is_locked")
def locked(spark, d):
    return analysed(spark, d).where("is_locked").select("line_no", "is_locked")


@query(BASE + " SELECT line_no, privileged_by_flag, privileged_by_role, privileged_by_login, is_privileged_flag FROM an")
def privileged_sources(spark, d):
    return analysed(spark, d).select("line_no", "privileged_by_flag", "privileged_by_role", "privileged_by_login", "is_privileged_flag")


@query(f"WITH a AS ({D.ACCOUNTS_SQL}) SELECT line_no, list_has_any({cells('user_rights')}, ['FULL_LEDGER', 'Approve']) AS privileged_by_right FROM a")
def learned_rights(spark, d):
    s = A.Settings(D.REF, rights={"FULL_LEDGER": "admin", "Approve": "admin", "READ": "standard"})
    return A.analyse(D.accounts(spark, d), s, known=DAY_FIRST).select("line_no", "privileged_by_right")


@query(BASE + " SELECT line_no, is_service_account, is_test_account, is_orphaned_account FROM an")
def name_flags(spark, d):
    return analysed(spark, d).select("line_no", "is_service_account", "is_test_account", "is_orphaned_account")


@query(BASE + " SELECT system, count(*) FILTER (has_no_manager) AS no_manager FROM an GROUP BY system")
def no_manager(spark, d):
    return analysed(spark, d).groupBy("system").agg(F.count_if("has_no_manager").alias("no_manager"))


@query(BASE + " SELECT line_no, days_since_password_change, is_password_stale, is_service_account AND is_password_stale AS is_service_password_stale, has_non_expiring_password, days_since_password_change IS NULL AS password_change_unknown FROM an")
def password_stale(spark, d):
    return analysed(spark, d).select("line_no", "days_since_password_change", "is_password_stale", "is_service_password_stale", "has_non_expiring_password", "password_change_unknown")


@query(BASE + " SELECT line_no, employee_status, account_status FROM an WHERE is_terminated_but_active")
def terminated_active(spark, d):
    return analysed(spark, d).where("is_terminated_but_active").select("line_no", "employee_status", "account_status")


@query(BASE + " SELECT line_no, temporal_inconsistency, last_login_future, password_change_future FROM an")
def temporal_anomalies(spark, d):
    return analysed(spark, d).select("line_no", "temporal_inconsistency", "last_login_future", "password_change_future")


@query(BASE + " SELECT line_no, username, full_name, system FROM an WHERE is_duplicate_account")
def duplicate_accounts(spark, d):
    return analysed(spark, d).where("is_duplicate_account").select("line_no", "username", "full_name", "system")


# ---- ladders ----------------------------------------------------------------------------

@query(BASE + " SELECT system, review_action, count(*) AS accounts FROM an GROUP BY ALL")
def review_actions(spark, d):
    return analysed(spark, d).groupBy("system", "review_action").agg(n().alias("accounts"))


@query(BASE + " SELECT line_no, risk_score, risk_level, review_action FROM an")
def risk_scores(spark, d):
    return analysed(spark, d).select("line_no", "risk_score", "risk_level", "review_action")


_REASONS = {"terminated": "is_terminated_but_active", "unused": "is_dormant OR is_never_used", "privileged": "is_privileged_flag", "privileged_non_expiring": "is_privileged_flag AND has_non_expiring_password", "password_stale": "is_password_stale AND NOT is_service_account", "no_manager": "has_no_manager", "duplicate": "is_duplicate_account", "locked": "is_locked", "test": "is_test_account"}


@query(BASE + " " + " UNION ALL ".join(f"SELECT '{k}' AS label, {dict(V.POINTS)[k]} AS points, count(*) AS accounts FROM an WHERE {cond} HAVING count(*) > 0" for k, cond in _REASONS.items()))
def risk_reasons(spark, d):
    return analysed(spark, d).select(F.inline("risk_score_reasons")).groupBy("label", "points").agg(n().alias("accounts"))


@query(BASE + " SELECT line_no, risk_level, risk_score, username FROM an ORDER BY CASE risk_level WHEN 'Critique' THEN 0 WHEN 'Élevé' THEN 1 WHEN 'Moyen' THEN 2 ELSE 3 END, risk_score DESC, username NULLS FIRST, system, line_no LIMIT 20")
def risk_sorted_top(spark, d):
    return R.by_risk(analysed(spark, d)).orderBy(A.rank_of_level(F.col("risk_level")), F.desc("risk_score"), F.col("username").asc_nulls_first(), "system", "line_no").limit(20).select("line_no", "risk_level", "risk_score", "username")


@query(BASE + " SELECT CASE risk_level WHEN 'Critique' THEN 'Critical' WHEN 'Élevé' THEN 'High' WHEN 'Moyen' THEN 'Medium' ELSE 'Low' END AS risk, " + "CASE review_action " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in V.ENGLISH.items() if k in V.ACTIONS.values()) + " ELSE review_action END AS todo, count(*) AS accounts FROM an GROUP BY ALL")
def value_translation(spark, d):
    return analysed(spark, d).groupBy(R.in_english(F.col("risk_level")).alias("risk"), R.in_english(F.col("review_action")).alias("todo")).agg(n().alias("accounts"))


@query(BASE + " SELECT line_no, risk_level, review_action FROM an WHERE risk_level IN ('Critique', 'Élevé') AND review_action <> 'Aucune action'")
def interactive_filter(spark, d):
    return R.filtered(analysed(spark, d), V.LEVELS[:2], with_action=True).select("line_no", "risk_level", "review_action")


@query(BASE + " SELECT line_no, username, system FROM an WHERE lower(trim(username)) = 'dba'")
def account_lookup(spark, d):
    return R.account(analysed(spark, d), " dba").select("line_no", "username", "system")


# ---- figures ----------------------------------------------------------------------------

@query(BASE + " SELECT count(*) AS accounts, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in R.SUMMARY.items()) + ", count(*) FILTER (is_password_stale AND is_active_for_audit) AS password_stale FROM an")
def summary(spark, d):
    return R.summary(analysed(spark, d))


def _coverage_sql() -> str:
    cond = {2: "is_dormant", 3: "is_orphaned_account AND is_active_for_audit", 4: "is_test_account AND is_active_for_audit", 5: "is_active_for_audit", 6: "is_never_used", 7: "is_service_account AND is_active_for_audit", 8: "is_duplicate_account", 10: "is_recently_created", 14: "is_password_stale AND is_active_for_audit", 16: "is_privileged_flag AND is_active_for_audit", 18: "is_terminated_but_active"}
    rows = []
    for k, title in V.CONTROL_TITLES.items():
        if k == 1:
            rows.append(f"SELECT 1 AS number, '{title}' AS title, 'WARN' AS status, CAST(NULL AS BIGINT) AS found")  # no description column
        elif k in cond:
            status = "'OK'" if k == 5 else f"CASE WHEN count(*) FILTER ({cond[k]}) > 0 THEN 'WARN' ELSE 'OK' END"
            rows.append(f"SELECT {k}, '{title}', {status}, count(*) FILTER ({cond[k]}) FROM an")
        else:
            rows.append(f"SELECT {k}, '{title}', 'N/A', CAST(NULL AS BIGINT)")
    return " UNION ALL ".join(rows)


@query(BASE + " " + _coverage_sql())
def control_coverage(spark, d):
    acc = D.accounts(spark, d)
    return R.control_coverage(analysed(spark, d, acc), had=set(acc.columns))


@query(BASE + f" SELECT status, count(*) AS controls FROM ({_coverage_sql()}) c GROUP BY status")
def control_tallies(spark, d):
    return R.tallies(control_coverage(spark, d))


_BAD = f"({blank('username')} OR {blank('system')} OR bad_date OR future_date OR unknown_status)"


@query(f"""WITH a AS ({D.ACCOUNTS_SQL}), b AS (SELECT *, {' OR '.join(f"(NOT {blank(c)} AND lower(trim({c})) NOT IN {words(V.NEVER_LOGGED_IN[:12])} AND ({day(c)}) IS NULL)" for c in A.DATE_COLUMNS[:1])} AS bad_date,
 {' OR '.join(f"coalesce(({day(c)}) > DATE '{D.REF}', false)" for c in A.DATE_COLUMNS[:1])} AS future_date, coalesce(lower(trim(account_status)) IN ('weird', 'not active', '-1'), false) AS unknown_status,
 count(*) OVER (PARTITION BY lower(trim(username)), lower(trim(system))) > 1 AND NOT {blank('username')} AS twice FROM a)
 SELECT count(*) AS accounts, count(*) FILTER ({blank('username')}) AS no_username, count(*) FILTER ({blank('system')}) AS no_system, count(*) FILTER (bad_date) AS bad_date, count(*) FILTER (future_date) AS future_date,
 count(*) FILTER (unknown_status) AS unknown_status, count(*) FILTER ({blank('manager')}) AS no_manager, count(*) FILTER (twice) AS copies, count(*) FILTER (twice OR {_BAD}) AS bad_rows, round(100.0 * (1.0 - count(*) FILTER (twice OR {_BAD}) / count(*)), 1) AS reliability FROM b""")
def quality_report(spark, d):
    return R.quality(D.accounts(spark, d), D.REF)


@query(BASE + " SELECT CAST(r AS INT) AS rank, l AS risk_level, (SELECT count(*) FROM an WHERE risk_level = l) AS accounts FROM (VALUES (0, 'Critique'), (1, 'Élevé'), (2, 'Moyen'), (3, 'Faible')) v(r, l)")
def risk_histogram(spark, d):
    return R.risk_histogram(analysed(spark, d))


_SHOWN = f"CASE WHEN {blank('account_status')} THEN 'Unknown' ELSE trim(account_status) END"


@query(f"""WITH b AS (SELECT {_SHOWN} AS s, 1 AS c FROM ({D.ACCOUNTS_SQL}) x UNION ALL SELECT {_SHOWN}, 0 FROM ({D.PREVIOUS_SQL}) y), g AS (SELECT s, sum(c) AS n1, sum(1 - c) AS n0, false AS w FROM b GROUP BY s UNION ALL SELECT 'TOTAL', sum(c), sum(1 - c), true FROM b)
 SELECT s AS account_status, CAST(n1 AS BIGINT) AS n_current, CAST(n0 AS BIGINT) AS n_previous, CASE WHEN n1 >= n0 THEN '+' ELSE '' END || CAST(CAST(n1 - n0 AS BIGINT) AS VARCHAR) AS variation, w AS is_total FROM g""")
def status_breakdown(spark, d):
    return R.status_breakdown(D.accounts(spark, d), D.previous(spark, d))


@query(f"SELECT system, count(*) AS accounts FROM ({D.ACCOUNTS_SQL}) a WHERE system IS NOT NULL GROUP BY system ORDER BY accounts DESC, system LIMIT 1")
def top_system(spark, d):
    return R.top_system(D.accounts(spark, d))


@query("SELECT * FROM (VALUES ('User logon (User ID)', true), ('User creation DATE', true), ('User rights or permissions', true), ('Description', false), ('Password reset date', true), ('Last login date', true), ('Account status', true)) v(item, present)")
def dump_completeness(spark, d):
    return R.completeness(D.accounts(spark, d))


@query(f"SELECT DISTINCT r AS user_right FROM (SELECT unnest({cells('user_rights')}) AS r FROM ({D.ACCOUNTS_SQL}) a) u WHERE length(r) > 1")
def distinct_rights(spark, d):
    return R.distinct_rights(D.accounts(spark, d))


@query(f"""WITH r AS (SELECT DISTINCT r FROM (SELECT unnest({cells('user_rights')}) AS r FROM ({D.ACCOUNTS_SQL}) a UNION ALL SELECT unnest({cells('role')}) FROM ({D.ACCOUNTS_SQL}) b) u WHERE length(r) > 1)
 SELECT count(*) AS n_values, count(*) FILTER (regexp_matches(lower(r), '(^|[^a-z0-9_])({'|'.join(V.PRIVILEGED_ROLE_WORDS)})([^a-z0-9_]|$)') OR regexp_matches(lower(r), '{V.ADMIN_GROUP.replace('?:', '')}') OR regexp_matches(lower(r), '{'|'.join(V.PRIVILEGED_ROLE_PARTS)}')) AS admin FROM r""")
def rights_classified(spark, d):
    return R.rights_classified(D.accounts(spark, d))


@query(f"""WITH r AS (SELECT DISTINCT r FROM (SELECT unnest({cells('user_rights')}) AS r FROM ({D.ACCOUNTS_SQL}) a UNION ALL SELECT unnest({cells('role')}) FROM ({D.ACCOUNTS_SQL}) b) u WHERE length(r) > 1)
 SELECT count(*) AS n_values, count(*) FILTER (r <> 'Administrator' AND (r = 'READ' OR regexp_matches(lower(r), '(^|[^a-z0-9_])({'|'.join(V.PRIVILEGED_ROLE_WORDS)})([^a-z0-9_]|$)') OR regexp_matches(lower(r), '{V.ADMIN_GROUP.replace('?:', '')}') OR regexp_matches(lower(r), '{'|'.join(V.PRIVILEGED_ROLE_PARTS)}'))) AS admin FROM r""")
def rights_as_learned(spark, d):
    return R.rights_classified(D.accounts(spark, d), {"READ": "admin", "Administrator": "standard"})


# ---- dates ------------------------------------------------------------------------------

@query(f"SELECT line_no, {age('last_login_date')} AS login_age, {age('account_created_date')} AS created_age, {age('password_last_set')} AS password_age FROM ({D.ACCOUNTS_SQL}) a")
def date_formats_age(spark, d):
    a = {c: age_days(c, D.REF) for c in A.DATE_COLUMNS}
    return D.accounts(spark, d).select("line_no", a["last_login_date"].alias("login_age"), a["account_created_date"].alias("created_age"), a["password_last_set"].alias("password_age"))


def _convention_sql(c: str) -> str:
    x = f"regexp_extract(trim({c}), '^(\\d{{1,2}})\\s*[-/.]\\s*(\\d{{1,2}})\\s*[-/.]\\s*(\\d{{1,4}})', "
    g = lambda k: f"TRY_CAST({x}{k}) AS INT)"
    return f"""SELECT '{c}' AS column_name, count(*) FILTER ({g(1)} > 12) AS day_first_proofs, count(*) FILTER ({g(1)} <= 12 AND {g(2)} > 12) AS month_first_proofs, count(*) FILTER ({g(1)} > 31) AS year_first_proofs,
 count(*) FILTER ({g(1)} <= 31 AND length({x}3)) = 2 AND {g(3)} > 31) AS year_last_proofs FROM ({D.ACCOUNTS_SQL}) a"""


@query(f"""WITH p AS ({' UNION ALL '.join(map(_convention_sql, A.DATE_COLUMNS))}) SELECT *, CASE WHEN day_first_proofs = 0 AND month_first_proofs = 0 THEN true ELSE day_first_proofs >= month_first_proofs END AS day_first,
 CASE WHEN year_first_proofs = 0 AND year_last_proofs = 0 THEN false ELSE year_first_proofs > 0 AND year_first_proofs >= year_last_proofs END AS year_first,
 CASE WHEN (day_first_proofs > 0 AND month_first_proofs > 0) OR (year_first_proofs > 0 AND year_last_proofs > 0) THEN 'mixed' WHEN (day_first_proofs = 0 AND month_first_proofs = 0) OR (year_first_proofs = 0 AND year_last_proofs = 0) THEN 'guessed' ELSE 'proven' END AS convention FROM p""")
def date_conventions(spark, d):
    return conventions(D.accounts(spark, d), list(A.DATE_COLUMNS))


@query(f"WITH a AS (SELECT ({day('last_login_date')}) AS d FROM ({D.ACCOUNTS_SQL}) x) SELECT 'Q' || CAST(quarter(d) AS VARCHAR) || ' ' || CAST(year(d) AS VARCHAR) AS label, count(*) AS accounts FROM a WHERE d IS NOT NULL GROUP BY label")
def quarter_labels(spark, d):
    day_ = day_of("last_login_date", D.REF)
    return D.accounts(spark, d).select(quarter_label(day_).alias("label")).where("label is not null").groupBy("label").agg(n().alias("accounts"))


# ---- people -----------------------------------------------------------------------------

_HR_SQL = f"""WITH a AS ({D.ACCOUNTS_SQL}), h AS (SELECT *, lower(trim(hr_username)) AS k FROM ({D.text(D.HR)}) x QUALIFY row_number() OVER (PARTITION BY lower(trim(hr_username)) ORDER BY line_no) = 1)"""


@query(_HR_SQL + f" SELECT a.line_no, coalesce(CASE WHEN k IS NULL THEN '{P.UNKNOWN}' ELSE hr_employee_status END, '') AS employee_status, CASE WHEN k IS NULL THEN department ELSE coalesce(hr_department, department) END AS department, k IS NOT NULL AS hr_cross_referenced FROM a LEFT JOIN h ON lower(trim(a.username)) = h.k")
def hr_by_username(spark, d):
    out = P.with_hr(D.accounts(spark, d), D.view(spark, d, D.HR))
    return out.select("line_no", F.coalesce("employee_status", F.lit("")).alias("employee_status"), "department", "hr_cross_referenced")


_BAG = "array_to_string(list_sort(regexp_extract_all(lower({}), '[a-z]+')), ' ')"


@query(f"""WITH a AS (SELECT line_no, {_BAG.format('full_name')} AS k FROM ({D.ACCOUNTS_SQL}) x), h AS (SELECT {_BAG.format('full_name')} AS k, count(*) AS n, any_value(hr_employee_status) AS s FROM (SELECT DISTINCT full_name, hr_employee_status FROM ({D.text(D.HR_NAMES)}) y) z GROUP BY 1)
 SELECT a.line_no, CASE WHEN n IS NULL THEN '{P.UNKNOWN}' WHEN n > 1 THEN '{P.AMBIGUOUS}' ELSE s END AS employee_status, coalesce(n = 1, false) AS hr_cross_referenced FROM a LEFT JOIN h ON a.k = h.k AND a.k <> ''""")
def hr_by_name_ambiguous(spark, d):
    return P.with_hr(D.accounts(spark, d), D.view(spark, d, D.HR_NAMES)).select("line_no", "employee_status", "hr_cross_referenced")


@query()
def transferred_match(spark, d):
    out = P.transferred(analysed(spark, d), D.view(spark, d, D.PEOPLE))
    return out.select("line_no", "full_name", "username", "is_transferred_but_active", "transferred_name_ambiguous")


@query()
def terminated_match(spark, d):
    return P.left_people(analysed(spark, d), D.view(spark, d, D.PEOPLE)).where("is_terminated_but_active").select("line_no", "full_name", "username")


_MATRIX = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(V.ROLE_CONFLICTS)) + ") m(pos, a, b)"


def _sod_sql(key: str) -> str:
    return f"""r AS (SELECT DISTINCT {key} AS k, lower(unnest({cells('role')})) AS role FROM a), hit AS (SELECT r1.k, min(pos) AS pos FROM {_MATRIX} JOIN r r1 ON contains(r1.role, a) JOIN r r2 ON r2.k = r1.k AND contains(r2.role, b) WHERE r1.k <> '' GROUP BY r1.k), found AS (SELECT k, a || ' + ' || b AS pair FROM hit JOIN {_MATRIX} USING (pos))"""


@query(f"WITH a AS (SELECT * EXCLUDE full_name FROM ({D.ACCOUNTS_SQL}) x), {_sod_sql('lower(trim(username))')} SELECT line_no, coalesce(pair, '') AS sod_conflict_detail, pair IS NOT NULL AS sod_conflict FROM a LEFT JOIN found ON lower(trim(username)) = k")
def sod_exact(spark, d):
    return P.role_conflicts(D.accounts(spark, d).drop("full_name"), P.conflict_table(spark), threshold=None).select("line_no", "sod_conflict_detail", "sod_conflict")


@query(f"""WITH a AS (SELECT *, {_BAG.format('full_name')} AS bag FROM ({D.ACCOUNTS_SQL}) x), {_sod_sql('bag')}, by_name AS (SELECT * FROM found), {_sod_sql('lower(trim(username))').replace('r AS', 'r3 AS').replace('hit AS', 'hit3 AS').replace('FROM hit ', 'FROM hit3 ').replace('found AS', 'found3 AS').replace('JOIN r r1', 'JOIN r3 r1').replace('JOIN r r2', 'JOIN r3 r2')}
 SELECT line_no, coalesce(f.pair, n.pair || ' (by name)', '') AS sod_conflict_detail, coalesce(f.pair, n.pair) IS NOT NULL AS sod_conflict FROM a LEFT JOIN found3 f ON lower(trim(username)) = f.k LEFT JOIN by_name n ON bag = n.k""")
def sod_by_name(spark, d):
    return P.role_conflicts(D.accounts(spark, d), P.conflict_table(spark), threshold=None).select("line_no", "sod_conflict_detail", "sod_conflict")


@query()
def sod_fuzzy(spark, d):
    return P.role_conflicts(D.accounts(spark, d), P.conflict_table(spark), learned={"clerk": "Approve Payment"}).select("line_no", "sod_conflict_detail", "sod_conflict")


# ---- tables and cycles ------------------------------------------------------------------

def _halves(spark, d):
    a = D.accounts(spark, d)
    return a.where("line_no % 3 <> 0").select("username", "system", "role"), a.where("line_no % 3 <> 1").select("username", F.concat(F.lit("two "), F.col("system")).alias("system"), "manager")


_HALVES = f"l AS (SELECT username, system, role FROM ({D.ACCOUNTS_SQL}) x WHERE line_no % 3 <> 0), r AS (SELECT username, 'two ' || system AS system, manager FROM ({D.ACCOUNTS_SQL}) y WHERE line_no % 3 <> 1)"


@query(f"WITH {_HALVES} SELECT coalesce(l.username, r.username) AS username, coalesce(l.system, r.system) AS system, role, manager FROM l FULL JOIN r ON l.username IS NOT DISTINCT FROM r.username")
def merge_outer_coalesce(spark, d):
    return C.merge(*_halves(spark, d))


@query(f"""WITH {_HALVES}, x AS (SELECT DISTINCT lower(trim(username)) AS u FROM l WHERE trim(username) <> ''), y AS (SELECT DISTINCT lower(trim(username)) AS u FROM r WHERE trim(username) <> ''),
 g AS (SELECT '^(admin|administrator|administrateur|root|guest|invite|test|service|svc|system|support|helpdesk|superadmin|demo|sample|default|backup|sa|anonymous|public)([_.-]?[0-9]*)?$' AS p), n AS (SELECT (SELECT count(*) FROM x JOIN y USING (u), g WHERE NOT regexp_matches(u, p)) AS common, (SELECT count(*) FROM x, g WHERE NOT regexp_matches(u, p)) AS size_a, (SELECT count(*) FROM y, g WHERE NOT regexp_matches(u, p)) AS size_b)
 SELECT common, size_a, size_b, round(common / least(size_a, size_b), 6) AS overlap FROM n""")
def table_overlap(spark, d):
    return C.overlap(*_halves(spark, d))


@query(f"WITH {_HALVES} SELECT username, system, role, NULL AS manager FROM l UNION ALL SELECT username, system, NULL, manager FROM r")
def stack_union(spark, d):
    return C.stack(*_halves(spark, d))


@query(f"""WITH a AS (SELECT line_no, 'P' || CAST(line_no % 100 AS VARCHAR) AS username, system, user_rights, last_login_date, manager FROM ({D.ACCOUNTS_SQL}) x),
 f AS (SELECT username, system, trim(user_rights) AS v, min(line_no) AS o FROM a WHERE NOT {blank('user_rights')} GROUP BY ALL), s AS (SELECT username, system, string_agg(v, chr(10) ORDER BY o) AS user_rights FROM f GROUP BY ALL),
 l AS (SELECT username, system, last_login_date FROM a WHERE last_login_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY username, system ORDER BY ({day('last_login_date')}) DESC NULLS LAST, CASE WHEN ({day('last_login_date')}) IS NULL THEN 0 ELSE {seconds('last_login_date')} END DESC, line_no) = 1)
 SELECT a.username, a.system, coalesce(s.user_rights, '') AS user_rights, l.last_login_date, arg_min(manager, line_no) FILTER (manager IS NOT NULL) AS manager, min(line_no) AS line_no FROM a LEFT JOIN s USING (username, system) LEFT JOIN l USING (username, system) GROUP BY a.username, a.system, s.user_rights, l.last_login_date""")
def permission_collapse(spark, d):
    a = D.accounts(spark, d).select("line_no", F.concat(F.lit("P"), (F.col("line_no") % 100).cast("string")).alias("username"), "system", "user_rights", "last_login_date", "manager")
    return C.collapse_permissions(a, ref=D.REF)


_K = "lower(trim({0}.username)) = lower(trim({1}.username)) AND lower(trim({0}.system)) = lower(trim({1}.system))"


@query(BOTH + f" SELECT line_no, username, system FROM an WHERE NOT {blank('username')} AND NOT EXISTS (SELECT 1 FROM pr WHERE {_K.format('an', 'pr')})")
def created_accounts(spark, d):
    a, b = D.accounts(spark, d), D.previous(spark, d)
    return C.created(a, b, C.comparison_keys(a, b)).select("line_no", "username", "system")


@query(f"""WITH a AS ({D.ACCOUNTS_SQL}), b AS (SELECT * FROM ({D.PREVIOUS_SQL}) x WHERE system = 'NATION_3') SELECT line_no, username, system FROM a WHERE NOT {blank('username')}
 AND (system <> 'NATION_3' OR lower(trim(username)) NOT IN (SELECT lower(trim(username)) FROM b WHERE NOT {blank('username')}))""")
def created_on_new_systems(spark, d):
    a, b = D.accounts(spark, d), D.previous(spark, d).where("system = 'NATION_3'")
    return C.created(a, b, C.comparison_keys(a, b)).select("line_no", "username", "system")


@query(BOTH + f" SELECT line_no, username, system FROM pr WHERE NOT {blank('username')} AND NOT EXISTS (SELECT 1 FROM an WHERE {_K.format('an', 'pr')})")
def deleted_accounts(spark, d):
    a, b = D.accounts(spark, d), D.previous(spark, d)
    return C.deleted(a, b, C.comparison_keys(a, b)).select("line_no", "username", "system")


_ONE = "SELECT *, lower(trim(username)) || '::' || lower(trim(system)) AS k FROM {0} WHERE NOT " + blank("username") + " QUALIFY row_number() OVER (PARTITION BY lower(trim(username)), lower(trim(system)) ORDER BY line_no) = 1"
_CHANGES = BOTH + f", c1 AS ({_ONE.format('an')}), p1 AS ({_ONE.format('pr')}), ch AS (SELECT c1.username, c1.system, c1.is_active_for_audit AND NOT p1.is_active_for_audit AS reactivated, coalesce(trim(c1.user_rights), '') <> coalesce(trim(p1.user_rights), '') AS profile_changed, c1.is_privileged_flag AND NOT p1.is_privileged_flag AS escalated FROM c1 JOIN p1 USING (k))"


@query(_CHANGES + " SELECT username, system, reactivated, profile_changed, escalated FROM ch")
def cycle_changes(spark, d):
    a, b = analysed(spark, d), analysed_before(spark, d)
    return C.changes(a, b, ["username", "system"])


@query(_CHANGES + f", c0 AS (SELECT DISTINCT k FROM c1 WHERE k NOT IN (SELECT k FROM p1)), d0 AS (SELECT DISTINCT k FROM p1 WHERE k NOT IN (SELECT k FROM c1)) SELECT (SELECT count(*) FROM c0) AS created, (SELECT count(*) FROM d0) AS deleted, count(*) FILTER (reactivated) AS reactivated, count(*) FILTER (profile_changed) AS profile_changed, count(*) FILTER (escalated) AS escalated FROM ch")
def cycle_comparison(spark, d):
    keys = C.comparison_keys(D.accounts(spark, d), D.previous(spark, d))
    return C.comparison(analysed(spark, d), analysed_before(spark, d), keys)


@query(_CHANGES + " SELECT username, system FROM ch WHERE escalated ORDER BY username, system LIMIT 20")
def privilege_escalation(spark, d):
    a, b = analysed(spark, d), analysed_before(spark, d)
    return C.changes(a, b, ["username", "system"]).where("escalated").orderBy("username", "system").limit(20).select("username", "system")


# ---- history ----------------------------------------------------------------------------

_DECISIONS = f"WITH a AS ({D.ACCOUNTS_SQL}), l AS (SELECT key, arg_max(status, seq) AS status, arg_max(validated_by, seq) AS validated_by, arg_max(ts, seq) AS ts FROM ({D.text(D.LOG)}) x GROUP BY key), j AS (SELECT line_no, coalesce(status, 'pending') AS review_status, coalesce(validated_by, '') AS validated_by, coalesce(ts, '') AS review_date FROM a LEFT JOIN l ON coalesce(lower(trim(username)), '') || '::' || lower(trim(system)) = key)"


@query(_DECISIONS + " SELECT * FROM j")
def latest_decision(spark, d):
    return C.latest_decisions(D.accounts(spark, d), D.view(spark, d, D.LOG)).select("line_no", "review_status", "validated_by", "review_date")


@query(_DECISIONS + " SELECT count(*) AS accounts, " + ", ".join(f"count(*) FILTER (review_status = '{s}') AS {s}" for s in C.STATUSES) + ", round(100.0 * (count(*) - count(*) FILTER (review_status = 'pending')) / count(*), 1) AS percent_done FROM j")
def review_progress(spark, d):
    return C.progress(C.latest_decisions(D.accounts(spark, d), D.view(spark, d, D.LOG)))


@query(f"SELECT key, seq, status, validated_by, comment, ts FROM ({D.text(D.LOG)}) x WHERE key LIKE 'dba::%'")
def audit_trail(spark, d):
    return C.audit_trail(D.view(spark, d, D.LOG), " DBA")


_ACCEPT = BASE + f""", k AS (SELECT lower(trim(username)) || '::' || lower(trim(system)) AS k, finding, arg_max(expiration_date, seq) AS e FROM ({D.text(D.ACCEPTANCES)}) x GROUP BY ALL),
 kk AS (SELECT k, finding, coalesce(CAST(try_strptime(e, '%Y-%m-%d') AS DATE) < DATE '2001-08-01', false) AS gone, e FROM k),
 j AS (SELECT an.*, kk.finding, kk.gone, kk.e FROM an JOIN kk ON coalesce(lower(trim(username)), '') || '::' || lower(trim(system)) = kk.k WHERE CASE kk.finding WHEN 'is_dormant' THEN is_dormant WHEN 'is_privileged_flag' THEN is_privileged_flag ELSE is_password_stale END)"""


def _accepted(spark, d):
    return C.with_acceptances(analysed(spark, d), D.view(spark, d, D.ACCEPTANCES), date(2001, 8, 1))


@query(_ACCEPT + " SELECT line_no, finding, gone FROM j")
def acceptances_applied(spark, d):
    out = _accepted(spark, d)
    part = lambda c, gone: out.select("line_no", F.explode(c).alias("finding"), F.lit(gone).alias("gone"))
    return part("accepted_finding_keys", False).union(part("expired_finding_keys", True))


@query(_ACCEPT + " SELECT username, system, finding, 'label' AS label, 'why' AS comment, 'ciso' AS accepted_by, e AS expiration_date FROM j WHERE NOT gone")
def accepted_findings(spark, d):
    return C.accepted_detail(_accepted(spark, d))


@query(_ACCEPT + """, f AS (SELECT line_no, coalesce(bool_or(finding = 'is_dormant'), false) AS fd, coalesce(bool_or(finding = 'is_privileged_flag'), false) AS fp, coalesce(bool_or(finding = 'is_password_stale'), false) AS fs FROM j WHERE NOT gone GROUP BY line_no),
 g AS (SELECT an.* REPLACE (is_dormant AND NOT coalesce(fd, false) AS is_dormant, is_privileged_flag AND NOT coalesce(fp, false) AS is_privileged_flag, is_password_stale AND NOT coalesce(fs, false) AS is_password_stale) FROM an LEFT JOIN f USING (line_no))
 SELECT line_no, CASE WHEN is_terminated_but_active OR (is_dormant OR is_never_used) AND is_privileged_flag OR is_privileged_flag AND has_non_expiring_password THEN 'Critique' WHEN is_dormant OR is_never_used OR has_no_manager OR (is_password_stale AND NOT is_service_account) OR is_duplicate_account THEN CASE WHEN is_privileged_flag THEN 'Élevé' ELSE 'Moyen' END ELSE 'Faible' END AS risk_level,
 CAST(least(100, CASE WHEN is_terminated_but_active THEN 50 ELSE 0 END + CASE WHEN is_dormant OR is_never_used THEN 20 ELSE 0 END + CASE WHEN is_privileged_flag THEN 30 ELSE 0 END + CASE WHEN is_privileged_flag AND has_non_expiring_password THEN 25 ELSE 0 END
    + CASE WHEN is_password_stale AND NOT is_service_account THEN 20 ELSE 0 END + CASE WHEN has_no_manager THEN 15 ELSE 0 END + CASE WHEN is_duplicate_account THEN 15 ELSE 0 END + CASE WHEN is_locked THEN 5 ELSE 0 END + CASE WHEN is_test_account THEN 10 ELSE 0 END) AS INT) AS risk_score FROM g""")
def risk_after_acceptance(spark, d):
    return _accepted(spark, d).select("line_no", "risk_level", "risk_score")


def _snapshot_sql(cte: str, cycle: str, label: str) -> str:
    return f"SELECT DATE '{cycle}' AS cycle_date, '{label}' AS period_label, system, CAST(grouping(system) AS TINYINT) AS whole, count(*) AS total_accounts, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in C.TREND) + ", " + ", ".join(f"count(*) FILTER (risk_level = '{v}') AS risk_{k}" for k, v in enumerate(V.LEVELS)) + f" FROM {cte} GROUP BY GROUPING SETS ((system), ())"


def _history(spark, d):
    return C.snapshot(analysed_before(spark, d), date(2000, 1, 1), "Q1 2000").unionByName(C.snapshot(analysed(spark, d).where("system <> 'NATION_3'"), date(2001, 8, 2), "Q3 2001"))


@query(BOTH + ", cu AS (SELECT * FROM an WHERE system <> 'NATION_3') " + _snapshot_sql("pr", "2000-01-01", "Q1 2000") + " UNION ALL " + _snapshot_sql("cu", "2001-08-02", "Q3 2001"))
def trend_snapshots(spark, d):
    return _history(spark, d)


@query(f"WITH c AS (SELECT count(DISTINCT system) AS n FROM ({D.PREVIOUS_SQL}) x), e AS (SELECT count(DISTINCT system) AS n, bool_or(system = 'NATION_3') AS has FROM ({D.ACCOUNTS_SQL}) y) SELECT DATE '2000-01-01' AS cycle_date, c.n AS n_systems, false AS scope_changed FROM c UNION ALL SELECT DATE '2001-08-02', e.n - CASE WHEN has THEN 1 ELSE 0 END, true FROM e")
def trend_lag_scope(spark, d):
    return C.scope_changes(_history(spark, d)).select("cycle_date", F.size("systems").cast("long").alias("n_systems"), "scope_changed")


@query(BOTH + ", cu AS (SELECT * FROM an WHERE system <> 'NATION_3'), h AS (" + _snapshot_sql("pr", "2000-01-01", "Q1 2000") + " UNION ALL " + _snapshot_sql("cu", "2001-08-02", "Q3 2001") + ") SELECT cycle_date, system, total_accounts, is_dormant FROM h WHERE system = 'NATION_3' OR system = 'NATION_4' AND cycle_date > DATE '2001-01-01'")
def trend_of_system(spark, d):
    h = _history(spark, d)
    return C.trend(h, " nation_3").unionByName(C.trend(h, "NATION_4").where("cycle_date > date'2001-01-01'")).select("cycle_date", "system", "total_accounts", "is_dormant")


@query(_ACCEPT + " SELECT username, system, string_agg(finding, ', ' ORDER BY finding) AS findings FROM j WHERE gone GROUP BY line_no, username, system")
def expired_acceptances(spark, d):
    return R.with_expired_acceptances(_accepted(spark, d))


@query(f"SELECT count(*) FILTER (line_no % 3 = 0) AS recognised FROM ({D.ACCOUNTS_SQL}) a")
def recognised_rows(spark, d):
    return R.read_by_recognition(D.accounts(spark, d).withColumn("_ocr_source", F.col("line_no") % 3 == 0))


@query(f"SELECT line_no, CASE WHEN line_no % 4 = 0 THEN NULL ELSE CAST(line_no % 200 AS INT) END AS days_since_last_login, line_no % 4 <> 0 AND line_no % 200 > 90 AS is_dormant FROM ({D.ACCOUNTS_SQL}) a")
def login_age_precomputed(spark, d):
    days = F.when(F.col("line_no") % 4 != 0, F.concat((F.col("line_no") % 200).cast("string"), F.lit(".5")))
    acc = D.accounts(spark, d).select("line_no", "username", "system", days.alias("days_since_last_login_precomputed"))
    return A.analyse(acc, A.Settings(D.REF)).select("line_no", "days_since_last_login", "is_dormant")


@query(_CHANGES + ", t AS (SELECT 11 AS number, username, system FROM ch WHERE profile_changed UNION ALL SELECT 12, username, system FROM ch WHERE reactivated), x AS (SELECT 13 AS number, pr.username, pr.system FROM pr WHERE NOT " + blank("pr.username") + " AND NOT EXISTS (SELECT 1 FROM an WHERE " + _K.format("an", "pr") + ")) SELECT number, lower(trim(username)) AS username, system FROM t UNION SELECT number, lower(trim(username)), system FROM x")
def control_lists(spark, d):
    """Accounts of the controls that compare two cycles, each login of a system once."""
    a, b = analysed(spark, d), analysed_before(spark, d)
    out = None
    for k in (11, 12, 13):
        part = W.control_rows(a, k, b).select(F.lit(k).alias("number"), T.low(F.col("username")).alias("username"), "system").distinct()
        out = part if out is None else out.unionByName(part)
    return out


@query(BASE + " SELECT line_no, CASE WHEN is_privileged_flag THEN 'Yes' ELSE 'No' END AS privileged, coalesce(CAST(days_since_password_change AS VARCHAR), 'Unknown (not verifiable)') AS password_age, CASE risk_level WHEN 'Critique' THEN 'Critical' WHEN 'Élevé' THEN 'High' WHEN 'Moyen' THEN 'Medium' ELSE 'Low' END AS risk FROM an")
def shown_values(spark, d):
    out = W.shown(analysed(spark, d), ["line_no", "is_privileged_flag", "days_since_password_change", "risk_level"])
    return out.select(F.col("Line no").cast("long").alias("line_no"), F.col("Privileged").alias("privileged"), F.col("Days since password change").alias("password_age"), F.col("Risk level").alias("risk"))
