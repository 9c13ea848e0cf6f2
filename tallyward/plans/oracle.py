"""The same answers in DuckDB's SQL, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from ..functions import vocab as V
from .testdata import ACCOUNTS_SQL, PREVIOUS_SQL, REF

_REF = f"DATE '{REF}'"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def listed(values) -> str:
    return "[" + words(values)[1:-1] + "]"


_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_MOIS = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"


def day(c: str) -> str:
    """The date in one of the ways in which the views write one, day first; nothing but a time may follow it."""
    t = f"lower(trim({c}))"
    part = lambda pattern, k: f"regexp_extract({t}, '{pattern}', {k})"
    named = lambda pattern, y, m, d: f"WHEN regexp_matches({t}, '{pattern}') THEN CAST(try_strptime({part(pattern, y)} || '-' || list_position({_MONTHS}, {part(pattern, m)}) || '-' || {part(pattern, d)}, '%Y-%m-%d') AS DATE)"
    yearless, french = "^[a-z]{3} ([a-z]{3}) (\\d\\d) 16:05$", "^(\\d\\d) (\\D+) (\\d{4})$"
    of = lambda y: f"CAST(try_strptime('{y}-' || list_position({_MONTHS}, {part(yearless, 1)}) || '-' || {part(yearless, 2)}, '%Y-%m-%d') AS DATE)"
    return f"""CASE WHEN {c} IS NULL OR {t} IN {words(V.NO_DATE)} OR {t} LIKE '1970-01-01%' THEN NULL
      WHEN regexp_full_match({t}, '\\d{{8}}') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE)
      WHEN regexp_matches({t}, '^\\d{{4}}-\\d\\d-\\d\\d(t14:30:00[+]02:00)?$') THEN CAST(try_strptime(left({t}, 10), '%Y-%m-%d') AS DATE)
      WHEN regexp_matches({t}, '^\\d\\d/\\d\\d/\\d{{4}}$') THEN CAST(try_strptime({t}, '%d/%m/%Y') AS DATE)
      WHEN regexp_matches({t}, '^\\d\\d[.]\\d\\d[.]\\d{{4}}( 08:15)?$') THEN CAST(try_strptime(left({t}, 10), '%d.%m.%Y') AS DATE)
      {named('^(\\d\\d)-?([a-z]{3})-?(\\d{4})$', 3, 2, 1)} {named('^(\\d{4}) ([a-z]{3}) (\\d\\d)$', 1, 2, 3)} {named('^([a-z]{3})/(\\d\\d)/(\\d{4})$', 3, 1, 2)}
      {named('^([a-z]{3}) (\\d\\d), (\\d{4}) 7:45 pm$', 3, 1, 2)}
      WHEN regexp_matches({t}, '{french}') THEN CAST(try_strptime({part(french, 3)} || '-' || list_position({_MOIS}, {part(french, 2)}) || '-' || {part(french, 1)}, '%Y-%m-%d') AS DATE)
      WHEN regexp_matches({t}, '{yearless}') THEN CASE WHEN {of(REF.year)} <= {_REF} THEN {of(REF.year)} ELSE coalesce({of(REF.year - 1)}, {of(REF.year - 5)}) END END"""


def seconds(c: str) -> str:
    """The time of day in one of those ways."""
    return f"CASE WHEN {c} LIKE '%08:15' THEN 29700 WHEN {c} LIKE '%T14:30:00%' THEN 52200 WHEN {c} LIKE '%16:05' THEN 57900 WHEN {c} LIKE '%7:45 pm' THEN 71100 ELSE 0 END"


def age(c: str) -> str:
    return f"CAST(date_diff('day', {day(c)}, {_REF}) AS INT)"


def cells(c: str) -> str:
    parts = f"CASE WHEN contains({c}, chr(10)) THEN string_split({c}, chr(10)) WHEN contains({c}, ';') THEN string_split({c}, ';') ELSE string_split({c}, ',') END"
    return f"coalesce(list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> ''), CAST([] AS VARCHAR[]))"


def blank(c: str) -> str:
    return f"coalesce(trim({c}) = '', true)"


_SW = "CASE WHEN regexp_full_match(st, '[+-]?\\d+') THEN [CAST(CAST(st AS BIGINT) AS VARCHAR)] ELSE list_filter(regexp_split_to_array(st, '[^a-z0-9]+'), lambda x: x <> '') END"
_ROLE = f"(regexp_matches(lower(x), '(^|[^a-z0-9_])({'|'.join(V.PRIVILEGED_ROLE_WORDS)})([^a-z0-9_]|$)') OR regexp_matches(lower(x), '{V.ADMIN_GROUP.replace('?:', '')}') OR regexp_matches(lower(x), '{'|'.join(V.PRIVILEGED_ROLE_PARTS)}'))"


def analysed(accounts: str = ACCOUNTS_SQL, name: str = "an") -> str:
    """CTEs up to ``name``: accounts with every flag and the ladders."""
    p = name
    return f"""{p}0 AS ({accounts}),
{p}1 AS (SELECT *, lower(trim(account_status)) AS st, lower(trim(username)) AS un, lower(trim(full_name)) AS fn, {age('last_login_date')} AS la, {age('account_created_date')} AS days_since_creation, {age('password_last_set')} AS days_since_password_change,
  {blank('last_login_date')} OR lower(trim(last_login_date)) IN {words(V.NEVER_LOGGED_IN)} OR trim(last_login_date) LIKE '1970-01-01%' AS nev,
  coalesce(regexp_matches(lower(trim(username)), '^svc[_-]|[_-]svc$'), false) AS is_service_account,
  coalesce(regexp_matches(trim(username), '{V.TEST_NAME}'), false) AS is_test_account FROM {p}0),
{p}2 AS (SELECT *, {_SW} AS sw, CASE WHEN nev THEN NULL ELSE la END AS days_since_last_login FROM {p}1),
{p}3 AS (SELECT *, coalesce(st IN {words(V.ACTIVE)}, false) OR (NOT coalesce(list_has_any(sw, {listed(V.NEGATIONS)}), false) AND coalesce(list_has_any(sw, {listed(V.ACTIVE)}), false)) AS act,
  coalesce(st IN {words(V.TERMINATED)}, false) OR coalesce(list_has_any(sw, {listed(V.TERMINATED)}), false) AS ter FROM {p}2),
{p}4 AS (SELECT *, act OR (NOT coalesce(st IN {words(V.LOCKED)}, false) AND NOT ter) AS is_active_for_audit, NOT act AND NOT coalesce(st IN {words(V.LOCKED)}, false) AND NOT ter AND coalesce(st, '') <> '' AS status_is_unknown,
  NOT nev AND la IS NULL AS last_login_date_unparseable,
  coalesce(regexp_matches(st, '(^|[^a-z0-9_àâçéèêëîïôûùüÿñ])(locked|verrouill[ée]|bloqu[ée])($|[^a-z0-9_àâçéèêëîïôûùüÿñ])'), false) OR coalesce(lower(trim(is_locked)) IN ('1','true','yes','y','oui','locked','verrouillé','verrouille'), false) AS locked_,
  coalesce(lower(trim(is_privileged)) IN {words(V.PRIVILEGED)}, false) AS privileged_by_flag,
  len(list_filter(list_concat({cells('role')}, {cells('user_rights')}), lambda x: {_ROLE})) > 0 AS privileged_by_role,
  coalesce(un IN {words(V.PRIVILEGED_LOGINS)} OR regexp_matches(un, '^adm[_.@-]|[_.@-]adm$|{'|'.join(V.PRIVILEGED_LOGIN_PARTS)}'), false) AS privileged_by_login,
  {blank('manager')} AS has_no_manager,
  coalesce(days_since_password_change > CASE WHEN is_service_account THEN 365 ELSE 90 END, true) AS is_password_stale,
  coalesce(lower(trim(password_status)) IN {words(V.NEVER_EXPIRES)}, false) AS has_non_expiring_password,
  coalesce(regexp_matches(un, '{'|'.join(V.GENERIC_NAMES + V.TECHNICAL_PARTS)}|^{V.TECHNICAL_PREFIX}|(^|[^a-z0-9])({'|'.join(V.TECHNICAL_WORDS)})($|[^a-z0-9])'), false) AS gen FROM {p}3),
{p}5 AS (SELECT * EXCLUDE (is_locked), locked_ AS is_locked, (coalesce(days_since_last_login > 90, false) OR last_login_date_unparseable) AND is_active_for_audit AS is_dormant,
  nev AND coalesce(days_since_creation > 30, true) AND is_active_for_audit AS is_never_used, coalesce(days_since_creation BETWEEN 0 AND 90, false) AS is_recently_created,
  coalesce(lower(trim(employee_status)) IN {words(V.TERMINATED)}, false) AND is_active_for_audit AS is_terminated_but_active,
  privileged_by_flag OR privileged_by_role OR privileged_by_login AS is_privileged_flag, gen AND (is_active_for_audit OR {blank('account_status')}) AS is_orphaned_account,
  coalesce(days_since_last_login > days_since_creation, false) OR coalesce(days_since_password_change > days_since_creation, false) AS temporal_inconsistency,
  coalesce(days_since_last_login < 0, false) AS last_login_future, coalesce(days_since_password_change < 0, false) AS password_change_future,
  CASE WHEN is_active_for_audit AND fn NOT IN {words(V.NO_NAME)} THEN fn END AS dn FROM {p}4),
{p}6 AS (SELECT *, dn IS NOT NULL AND count(DISTINCT un) OVER (PARTITION BY dn, lower(trim(system))) > 1 AS is_duplicate_account FROM {p}5),
{p} AS (SELECT *, CASE WHEN is_terminated_but_active THEN 'Révoquer immédiatement' WHEN (is_dormant OR is_never_used) AND is_privileged_flag THEN 'Désactiver (privilégié dormant)'
  WHEN is_privileged_flag AND has_non_expiring_password THEN 'Forcer l''expiration du mot de passe (privilégié)' WHEN (is_dormant OR is_never_used) AND is_service_account THEN 'Vérifier avec le propriétaire technique (compte de service)'
  WHEN is_dormant AND last_login_date_unparseable THEN 'Vérifier (date de dernière connexion non exploitable)' WHEN is_dormant THEN 'Désactiver (dormant)' WHEN is_never_used THEN 'Désactiver (jamais utilisé)'
  WHEN is_duplicate_account THEN 'Fusionner les doublons (ne garder qu''un compte actif)' WHEN is_password_stale AND is_service_account THEN 'Vérifier avec le propriétaire technique (mot de passe, compte de service)'
  WHEN is_password_stale THEN 'Exiger un changement de mot de passe' WHEN has_no_manager THEN 'Identifier un owner' WHEN is_locked THEN 'Nettoyer (compte verrouillé)' WHEN is_test_account THEN 'Vérifier (compte de test présumé)'
  WHEN is_orphaned_account THEN 'Vérifier (compte générique/orphelin présumé)' ELSE 'Aucune action' END AS review_action,
  CASE WHEN is_terminated_but_active OR (is_dormant OR is_never_used) AND is_privileged_flag OR is_privileged_flag AND has_non_expiring_password THEN 'Critique'
  WHEN is_dormant OR is_never_used OR has_no_manager OR (is_password_stale AND NOT is_service_account) OR is_duplicate_account THEN CASE WHEN is_privileged_flag THEN 'Élevé' ELSE 'Moyen' END ELSE 'Faible' END AS risk_level,
  CAST(least(100, CASE WHEN is_terminated_but_active THEN 50 ELSE 0 END + CASE WHEN is_dormant OR is_never_used THEN 20 ELSE 0 END + CASE WHEN is_privileged_flag THEN 30 ELSE 0 END + CASE WHEN is_privileged_flag AND has_non_expiring_password THEN 25 ELSE 0 END
    + CASE WHEN is_password_stale AND NOT is_service_account THEN 20 ELSE 0 END + CASE WHEN has_no_manager THEN 15 ELSE 0 END + CASE WHEN is_duplicate_account THEN 15 ELSE 0 END + CASE WHEN is_locked THEN 5 ELSE 0 END + CASE WHEN is_test_account THEN 10 ELSE 0 END) AS INT) AS risk_score
  FROM {p}6)"""


BASE = "WITH " + analysed()
BOTH = BASE + ", " + analysed(PREVIOUS_SQL, "pr")
