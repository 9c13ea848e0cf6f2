"""The review itself: flags, recommended action, risk score and level, all as columns.

Everything is decided from ``df.columns`` while the plan is built: a control whose column
is missing is false. The reference date is always given, never the clock."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.dates import GUESSED, MIXED, PROVEN, age_days, conventions


@dataclass(frozen=True)
class Settings:
    ref: date
    dormant_days: int = V.DORMANT_DAYS
    password_days: int = V.PASSWORD_DAYS
    service_password_days: int = V.SERVICE_PASSWORD_DAYS
    created_days: int = V.CREATED_DAYS
    statuses: dict[str, str] = field(default_factory=dict)  # normalised status: active or inactive
    rights: dict[str, str] = field(default_factory=dict)  # raw right: admin or standard
    detect_conventions: bool = True


DATE_COLUMNS = ("last_login_date", "account_created_date", "password_last_set")


# ---- predicates -------------------------------------------------------------------------

def is_active_word(c) -> Column:
    words = T.status_words(c)
    return T.any_of(T.low(c), V.ACTIVE) | (~T.overlaps(words, V.NEGATIONS) & T.overlaps(words, V.ACTIVE))


def is_terminated_word(c) -> Column:
    return T.any_of(T.low(c), V.TERMINATED) | T.overlaps(T.status_words(c), V.TERMINATED)


def status(c, learned: dict[str, str] | None = None) -> Column:
    """struct(active, unknown) of an account status: learned, active word, locked, terminated, blank, else active but unknown."""
    say = lambda active, unknown: F.struct(F.lit(active).alias("active"), F.lit(unknown).alias("unknown"))
    names = {what: [k for k, v in (learned or {}).items() if v == what] for what in ("active", "inactive")}

    def told(t: Column) -> Column:
        out = F
        for what, listed in names.items():
            if listed:
                out = out.when(T.any_of(T.status_key(t), listed), say(what == "active", False))
        return (
            out.when(is_active_word(t), say(True, False)).when(T.any_of(F.lower(t), V.LOCKED), say(False, False))
            .when(is_terminated_word(t), say(False, False)).when(T.blank(t), say(True, False)).otherwise(say(True, True))
        )

    return T.let(T.strip(c.cast("string")), told)


def locked(status_col=None, lock_col=None) -> Column:
    out = F.lit(False)
    if status_col is not None:
        out = out | F.coalesce(F.lower(status_col).rlike(r"(?U)\b(locked|verrouill[ée]|bloqu[ée])\b"), F.lit(False))
    if lock_col is not None:
        out = out | T.any_of(T.low(lock_col), ["1", "true", "yes", "y", "oui", "locked", "verrouillé", "verrouille"])
    return out


def is_service_name(c) -> Column:
    return F.coalesce(T.low(c).rlike(V.SERVICE_NAME), F.lit(False))


def is_test_name(c) -> Column:
    return F.coalesce(T.strip(c).rlike(V.TEST_NAME), F.lit(False))


def is_generic_name(c) -> Column:
    words = "|".join(V.TECHNICAL_WORDS)
    return F.coalesce(T.low(c).rlike("|".join(V.GENERIC_NAMES + V.TECHNICAL_PARTS) + rf"|^{V.TECHNICAL_PREFIX}|(?<![a-z0-9])({words})(?![a-z0-9])"), F.lit(False))


def is_privileged_login(c) -> Column:
    whole = "|".join(V.PRIVILEGED_LOGINS)
    return F.coalesce(T.low(c).rlike(rf"^({whole})$|^adm[_.@-]|[_.@-]adm$|" + "|".join(V.PRIVILEGED_LOGIN_PARTS)), F.lit(False))


def is_privileged_role(item) -> Column:
    t = T.low(item)
    words = "|".join(V.PRIVILEGED_ROLE_WORDS)
    return F.coalesce(t.rlike(rf"(?<![a-z0-9_])({words})(?![a-z0-9_])") | t.rlike(V.ADMIN_GROUP) | t.rlike("|".join(V.PRIVILEGED_ROLE_PARTS)), F.lit(False))


def is_never_login(c) -> Column:
    return T.blank(c) | T.low(c).isin(V.NEVER_LOGGED_IN)


# ---- the frame --------------------------------------------------------------------------

def convention_map(df: DataFrame, columns) -> dict[str, dict]:
    """What ``conventions`` finds, by column, as keyword arguments of ``age_days`` (one row comes to the driver)."""
    if not columns:
        return {}
    return {r.column_name: {"day_first": r.day_first, "year_first": r.year_first, "convention": r.convention} for r in conventions(df, columns).collect()}


def analyse(df: DataFrame, s: Settings, known: dict[str, dict] | None = None) -> DataFrame:
    """All derived columns. ``known``: the date columns' conventions, detected (one aggregate) if not given."""
    has = set(df.columns)
    dates = [c for c in DATE_COLUMNS if c in has]
    how = known if known is not None else convention_map(df, dates) if s.detect_conventions else {}
    col = F.col
    no, null_int = F.lit(False), F.lit(None).cast("int")
    age = {c: age_days(c, s.ref, **how.get(c, {})) if c in has else null_int for c in DATE_COLUMNS}

    # statuses first, in a projection of their own
    st = status(col("account_status"), s.statuses) if "account_status" in has else F.struct(F.lit(True).alias("active"), no.alias("unknown"))
    precomputed = F.floor(col("days_since_last_login_precomputed").try_cast("double")).cast("int") if "days_since_last_login_precomputed" in has else null_int
    login_text = col("last_login_date") if "last_login_date" in has else F.lit(None).cast("string")
    df = df.withColumns({
        "_status": st,
        "_login_age": F.coalesce(age["last_login_date"], precomputed),
        "days_since_creation": age["account_created_date"],
        "days_since_password_change": age["password_last_set"],
        "_epoch": F.coalesce(is_epoch(login_text), no) | F.coalesce(age["last_login_date"] >= V.EPOCH_DAYS, no) if "last_login_date" in has else no,
    })
    active = col("_status.active")
    never = (is_never_login(login_text) | col("_epoch")) if "last_login_date" in has else no
    df = df.withColumns({
        "_never": never,
        "days_since_last_login": F.when(~never, col("_login_age")),
        "is_active_for_audit": active, "status_is_unknown": col("_status.unknown"),
        "is_service_account": is_service_name(col("username")), "is_test_account": is_test_name(col("username")),
    })
    login, created, password = col("days_since_last_login"), col("days_since_creation"), col("days_since_password_change")
    unreadable = (~col("_never") & login.isNull()) if "last_login_date" in has else no
    pw_known = "password_last_set" in has
    pw_unknown = password.isNull() if pw_known else no
    limit = F.when(col("is_service_account"), s.service_password_days).otherwise(s.password_days)
    terminated = (active & is_terminated_word(col("employee_status"))) if {"employee_status", "account_status"} <= has else no
    generic = is_generic_name(col("username"))
    if "account_status" in has:
        generic = generic & ~(~T.blank(col("account_status")) & ~active)
    sources = privilege_sources(has, s)
    status_col = col("account_status") if "account_status" in has else None
    lock_col = col("is_locked") if "is_locked" in has else None
    df = df.withColumns({
        "last_login_date_unparseable": unreadable,
        "last_login_date_convention": F.lit(how.get("last_login_date", {}).get("convention", PROVEN)),
        "last_login_date_convention_uncertain": F.lit(how.get("last_login_date", {}).get("convention", PROVEN) in (GUESSED, MIXED)),
        "last_login_future": F.coalesce(login < 0, no),
        "is_dormant": (F.coalesce(login > s.dormant_days, no) | unreadable) & active,
        "is_never_used": (col("_never") & F.coalesce(created > V.NEVER_USED_DAYS, F.lit(True)) & active),
        "is_recently_created": F.coalesce(created.between(0, s.created_days), no),
        "is_locked": locked(status_col, lock_col),
        "is_terminated_but_active": terminated,
        "privileged_by_flag": sources["flag"], "privileged_by_role": sources["role"], "privileged_by_right": sources["right"], "privileged_by_login": sources["login"],
        "has_no_manager": T.blank(col("manager")) if "manager" in has else no,
        "password_change_future": F.coalesce(password < 0, no),
        "password_change_unknown": pw_unknown,
        "is_password_stale": (F.coalesce(password > limit, no) | pw_unknown) if pw_known else no,
        "is_service_password_stale": (col("is_service_account") & (F.coalesce(password > s.service_password_days, no) | pw_unknown)) if pw_known else no,
        "has_non_expiring_password": T.any_of(T.low(col("password_status")), V.NEVER_EXPIRES) if "password_status" in has else no,
        "is_orphaned_account": generic, "is_non_compliant_naming": no,
        "temporal_inconsistency": F.coalesce(login > created, no) | F.coalesce(password > created, no),
    })
    df = df.withColumn("is_privileged_flag", col("privileged_by_flag") | col("privileged_by_role") | col("privileged_by_right") | col("privileged_by_login"))
    df = duplicates(df) if "full_name" in has else df.withColumn("is_duplicate_account", no)
    return decide(df).drop("_status", "_login_age", "_never", "_epoch")


def is_epoch(c) -> Column:
    return T.low(c).isin(V.EPOCH_TEXTS) | T.strip(c).startswith("1970-01-01")


def privilege_sources(has: set[str], s: Settings) -> dict[str, Column]:
    no = F.lit(False)
    items = [T.cells(F.col(c)) for c in ("role", "user_rights") if c in has]
    admin = [k for k, v in s.rights.items() if v == "admin"]
    any_item = lambda test: F.coalesce(F.greatest(no, *[F.coalesce(F.exists(i, test), no) for i in items]), no) if items else no
    return {
        "flag": T.any_of(T.low(F.col("is_privileged").cast("string")), V.PRIVILEGED) if "is_privileged" in has else no,
        "role": any_item(is_privileged_role),
        "right": any_item(lambda x: x.isin(admin)) if admin else no,
        "login": is_privileged_login(F.col("username")) if "username" in has else no,
    }


def duplicates(df: DataFrame) -> DataFrame:
    """is_duplicate_account: active, with a real name that several usernames of a system have.

    Distinct usernames are counted by (name, system) and joined back, so a name that
    everyone has is a count, not a window of all its rows."""
    name, place = T.low(F.col("full_name")), T.low(F.col("system"))
    df = df.withColumns({"_name": F.when(F.col("is_active_for_audit") & ~T.any_of(name, V.NO_NAME), name), "_place": F.coalesce(place, F.lit(""))})
    many = df.where("_name is not null").groupBy(F.col("_name").alias("_n"), F.col("_place").alias("_p"), T.low(F.col("username")).alias("_u")).agg(F.lit(1).alias("_x"))
    many = many.groupBy("_n", "_p").agg(F.count("_u").alias("_c")).where("_c > 1")
    out = df.join(many, (F.col("_name") == F.col("_n")) & (F.col("_place") == F.col("_p")), "left")
    return out.withColumn("is_duplicate_account", F.col("_c").isNotNull()).drop("_name", "_place", "_n", "_p", "_c")


# ---- ladders ----------------------------------------------------------------------------

def _flags(off=None) -> dict[str, Column]:
    """The flags that the ladders read; ``off(name)``: a condition under which a flag counts as false."""
    f = lambda name: F.col(name) if off is None else F.col(name) & ~off(name)
    names = {
        "terminated": "is_terminated_but_active", "dormant": "is_dormant", "never": "is_never_used", "privileged": "is_privileged_flag", "non_expiring": "has_non_expiring_password",
        "service": "is_service_account", "duplicate": "is_duplicate_account", "stale": "is_password_stale", "no_manager": "has_no_manager", "locked": "is_locked",
        "test": "is_test_account", "orphan": "is_orphaned_account", "naming": "is_non_compliant_naming", "unreadable": "last_login_date_unparseable",
    }
    return {k: f(v) for k, v in names.items()}


def action(f: dict[str, Column]) -> Column:
    unused = f["dormant"] | f["never"]
    steps = [
        (f["terminated"], "revoke"), (unused & f["privileged"], "disable_privileged"), (f["privileged"] & f["non_expiring"], "force_expiry"),
        (unused & f["service"], "ask_technical_owner"), (f["dormant"] & f["unreadable"], "check_date"), (f["dormant"], "disable_dormant"),
        (f["never"], "disable_unused"), (f["duplicate"], "merge"), (f["stale"] & f["service"], "ask_owner_password"), (f["stale"], "change_password"),
        (f["no_manager"], "find_owner"), (f["locked"], "clean_locked"), (f["test"], "check_test"), (f["orphan"], "check_orphan"), (f["naming"], "rename"),
    ]
    out = F
    for cond, name in steps:
        out = out.when(cond, F.lit(V.ACTIONS[name]))
    return out.otherwise(F.lit(V.ACTIONS["none"]))


def scored(f: dict[str, Column]) -> dict[str, Column]:
    """The flags of the score by the names in POINTS."""
    return {
        "terminated": f["terminated"], "unused": f["dormant"] | f["never"], "privileged": f["privileged"], "privileged_non_expiring": f["privileged"] & f["non_expiring"],
        "password_stale": f["stale"] & ~f["service"], "no_manager": f["no_manager"], "duplicate": f["duplicate"], "locked": f["locked"], "test": f["test"], "naming": f["naming"],
    }


def score(parts: dict[str, Column]) -> Column:
    """The points of the flags that ``scored`` gives."""
    total = F.lit(0)
    for name, points in V.POINTS:
        total = total + F.when(parts[name], points).otherwise(0)
    return F.least(total, F.lit(100))


def reasons(parts: dict[str, Column]) -> Column:
    each = [F.when(parts[name], F.struct(F.lit(name).alias("label"), F.lit(points).alias("points"))) for name, points in V.POINTS]
    return F.array_compact(F.array(*each))


def level(f: dict[str, Column]) -> Column:
    unused = f["dormant"] | f["never"]
    high = unused | f["no_manager"] | (f["stale"] & ~f["service"]) | f["duplicate"]
    return (
        F.when(f["terminated"] | (unused & f["privileged"]) | (f["privileged"] & f["non_expiring"]), V.LEVELS[0])
        .when(high & f["privileged"], V.LEVELS[1]).when(high, V.LEVELS[2]).otherwise(V.LEVELS[3])
    )


def decide(df: DataFrame, off=None) -> DataFrame:
    f = _flags(off)
    parts = scored(f)
    return df.withColumns({"review_action": action(f), "risk_level": level(f), "risk_score": score(parts), "risk_score_reasons": reasons(parts)})


def rank_of_level(c) -> Column:
    out = F
    for k, name in enumerate(V.LEVELS):
        out = out.when(c == name, k)
    return out.otherwise(99)
