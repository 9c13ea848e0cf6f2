"""Figures over an analysed frame: summary, controls, quality, status breakdown, progress."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.dates import day_of
from .review import is_privileged_role, rank_of_level, status

SUMMARY = {
    "dormant": "is_dormant", "never_used": "is_never_used", "recently_created": "is_recently_created", "locked": "is_locked", "terminated_but_active": "is_terminated_but_active",
    "privileged": "is_privileged_flag", "no_manager": "has_no_manager", "non_expiring_password": "has_non_expiring_password", "service": "is_service_account",
    "test": "is_test_account", "orphaned": "is_orphaned_account", "duplicate": "is_duplicate_account", "temporal_inconsistency": "temporal_inconsistency",
}


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("long")


def summary(df: DataFrame) -> DataFrame:
    """One row of counts; old passwords of active accounts only."""
    return df.agg(
        F.count("*").alias("accounts"), *[_count(F.col(c)).alias(k) for k, c in SUMMARY.items()],
        _count(F.col("is_password_stale") & F.col("is_active_for_audit")).alias("password_stale"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """item, present: whether any of an item's columns holds a value."""
    rows = [F.struct(F.lit(name).alias("item"), (F.coalesce(F.max(F.greatest(*[F.col(c).isNotNull() for c in have], F.lit(False))), F.lit(False)) if (have := [c for c in columns if c in df.columns]) else F.lit(False)).alias("present")) for name, columns in V.COMPLETENESS]
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def _not_accepted(df: DataFrame, key: str) -> Column:
    return ~F.array_contains("accepted_finding_keys", key) if "accepted_finding_keys" in df.columns else F.lit(True)


def control_coverage(df: DataFrame, changes: DataFrame | None = None, had: set[str] | None = None) -> DataFrame:
    """number, title, status, found of all 19 controls, in one pass over the accounts.

    ``changes``: one row of created, profile_changed, reactivated, deleted, if there is a
    cycle before. ``had``: the columns of the export (all, if not given); a control
    whose columns are missing is N/A."""
    had = set(df.columns) if had is None else had
    active = F.col("is_active_for_audit")
    item = lambda number, status_, n: F.struct(F.lit(number).alias("number"), F.lit(V.CONTROL_TITLES[number]).alias("title"), status_.alias("status"), n.alias("found"))
    none = F.lit(None).cast("long")
    by_count = lambda n: F.when(n > 0, "WARN").otherwise("OK")
    out = []
    complete = F.lit(True)
    for _, columns in V.COMPLETENESS:
        have = [c for c in columns if c in had]
        complete = complete & (F.coalesce(F.max(F.greatest(*[F.col(c).isNotNull() for c in have], F.lit(False))), F.lit(False)) if have else F.lit(False))
    for number, key in V.CONTROLS:
        if number == 1:
            out.append(item(1, F.when(complete, "OK").otherwise("WARN"), none))
        elif number == 5:
            out.append(item(5, F.lit("OK"), _count(active)))
        elif key is None:
            out.append(item(number, F.lit("N/A"), none))
        elif key in ("_created", "_profile_modified", "_reactivated", "_deleted"):
            name = {"_created": "created", "_profile_modified": "profile_changed", "_reactivated": "reactivated", "_deleted": "deleted"}[key]
            if changes is not None:
                n = F.max(f"_{name}")
                out.append(item(number, by_count(n), n))
            elif key == "_created" and "account_created_date" in had:
                n = _count(F.col("is_recently_created"))
                out.append(item(number, by_count(n), n))
            else:
                out.append(item(number, F.lit("N/A"), none))
        else:
            needs = {"is_dormant": {"last_login_date", "days_since_last_login_precomputed"}, "is_never_used": {"last_login_date", "days_since_last_login_precomputed", "account_created_date"}, "is_password_stale": {"password_last_set"}, "is_terminated_but_active": {"employee_status", "is_transferred_but_active"}}.get(key)
            if needs and not needs & had:
                out.append(item(number, F.lit("N/A"), none))
                continue
            counted = F.col(key) & _not_accepted(df, key)
            if key not in ("is_never_used", "is_terminated_but_active"):
                counted = counted & active
            n = _count(counted)
            if key == "is_terminated_but_active" and "is_transferred_but_active" in df.columns:
                n = n + _count(F.col("is_transferred_but_active") & _not_accepted(df, "is_transferred_but_active"))
            out.append(item(number, by_count(n), n))
    if changes is not None:
        names = ("created", "profile_changed", "reactivated", "deleted")
        df = df.join(F.broadcast(changes.select(*[F.col(c).alias(f"_{c}") for c in names])), how="left")  # one row
    return df.agg(F.array(*out).alias("x")).select(F.inline("x"))


def tallies(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("status").agg(F.count("*").alias("controls"))


def quality(df: DataFrame, ref: date) -> DataFrame:
    """One row: what is wrong with how many rows, and the share of the others in percent.

    Copies of a (username, system) are counted by key first, so a key that many rows
    share is one count; a missing manager doesn't make a row bad."""
    d = [c for c in ("last_login_date",) if c in df.columns]
    day = {c: day_of(c, ref) for c in d}
    wrong, future = F.lit(False), F.lit(False)
    for c in d:
        filled = ~T.blank(F.col(c)) & ~F.lower(T.strip(F.col(c))).isin(V.NEVER_LOGGED_IN[:12])
        wrong = wrong | (filled & day[c].isNull())
        future = future | F.coalesce(day[c] > F.lit(ref), F.lit(False))
    unknown = status(F.col("account_status")).getField("unknown") if "account_status" in df.columns else F.lit(False)
    has = lambda c: T.blank(F.col(c)) if c in df.columns else F.lit(False)
    rows = df.select(
        F.coalesce(T.low(F.col("username")), F.lit("")).alias("u"), F.coalesce(T.low(F.col("system")), F.lit("")).alias("s"), has("username").alias("no_username"),
        has("system").alias("no_system"), has("manager").alias("no_manager"), wrong.alias("bad_date"), future.alias("future_date"), unknown.alias("unknown_status"),
    )
    flags = ["no_username", "no_system", "bad_date", "future_date", "unknown_status"]
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.col(f)
    per = rows.groupBy("u", "s").agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in [*flags, "no_manager"]], F.count_if(bad).alias("bad"))
    twice = (F.col("n") > 1) & (F.col("u") != "")
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("accounts"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in [*flags, "no_manager"]],
        F.coalesce(F.sum(F.when(twice, F.col("n")).otherwise(0)), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.when(twice, F.col("n")).otherwise(F.col("bad"))), F.lit(0)).alias("bad_rows"),
    )
    return out.withColumn("reliability", F.when(F.col("accounts") > 0, F.round(F.lit(100.0) * (F.lit(1.0) - F.col("bad_rows") / F.col("accounts")), 1)).otherwise(0.0))


def risk_histogram(df: DataFrame) -> DataFrame:
    """risk_level, accounts, rank: every level, worst first, with zeros."""
    counts = df.agg(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(v).alias("risk_level"), _count(F.col("risk_level") == v).alias("accounts")) for k, v in enumerate(V.LEVELS)]).alias("x"))
    return counts.select(F.inline("x"))


def status_breakdown(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """account_status, n_current, n_previous, variation, is_total; blanks are Unknown, the row of all TOTAL."""
    shown = lambda df: df.select(F.when(T.blank(F.col("account_status")), "Unknown").otherwise(T.strip(F.col("account_status"))).alias("account_status"))
    both = shown(current).withColumn("c", F.lit(1))
    if previous is not None:
        both = both.unionByName(shown(previous).withColumn("c", F.lit(0)))
    per = both.groupingSets([[F.col("account_status")], []], "account_status").agg(F.grouping("account_status").alias("whole"), F.sum("c").cast("long").alias("n_current"), F.sum(1 - F.col("c")).cast("long").alias("n_previous"))
    per = per.withColumn("account_status", F.when(F.col("whole") == 1, "TOTAL").otherwise(F.col("account_status"))).withColumn("is_total", F.col("whole") == 1).drop("whole")
    return per.withColumn("variation", T.signed(F.col("n_current") - F.col("n_previous")))


def top_system(df: DataFrame) -> DataFrame:
    """The most frequent system; ties: the first by name."""
    return df.where("system is not null").groupBy("system").agg(F.count("*").alias("accounts")).orderBy(F.desc("accounts"), "system").limit(1)


def distinct_rights(df: DataFrame) -> DataFrame:
    """user_right: distinct parts of rights longer than one character."""
    return df.select(F.explode(T.cells(F.col("user_rights"))).alias("user_right")).where(F.length("user_right") > 1).distinct()


def rights_classified(df: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """n_values, admin: distinct parts of rights and roles, and how many of them are privileged, by what was learned or by name."""
    parts = None
    for c in ("user_rights", "role"):
        if c in df.columns:
            one = df.select(F.explode(T.cells(F.col(c))).alias("r"))
            parts = one if parts is None else parts.union(one)
    told = {what: [k for k, v in (learned or {}).items() if v == what] for what in ("admin", "standard")}
    admin = is_privileged_role(F.col("r"))
    if told["standard"]:
        admin = admin & ~F.col("r").isin(told["standard"])
    if told["admin"]:
        admin = admin | F.col("r").isin(told["admin"])
    if parts is None:
        parts = df.select(F.lit(None).cast("string").alias("r")).limit(0)
    return parts.where("length(r) > 1").distinct().agg(F.count("*").alias("n_values"), F.count_if(admin).alias("admin"))


def status_values(df: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """account_status, meaning, accounts: the distinct values and how they are read."""
    st = status(F.col("account_status"), learned)
    meaning = F.when(st.getField("unknown"), "unknown, taken for active").when(st.getField("active"), "active").otherwise("inactive")
    return df.groupBy("account_status").agg(F.count("*").alias("accounts")).withColumn("meaning", meaning)


def in_english(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.ENGLISH.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c.cast("string")), c.cast("string"))


def by_risk(df: DataFrame) -> DataFrame:
    return df.orderBy(rank_of_level(F.col("risk_level")), F.desc("risk_score"), "username", "system")


def filtered(df: DataFrame, levels: list[str] | None = None, with_action: bool = False) -> DataFrame:
    out = df if not levels else df.where(F.col("risk_level").isin(levels))
    return out.where(F.col("review_action") != V.ACTIONS["none"]) if with_action else out


def account(df: DataFrame, username: str, system: str | None = None) -> DataFrame:
    out = df.where(T.low(F.col("username")) == username.strip().lower())
    return out if system is None else out.where(T.low(F.col("system")) == system.strip().lower())


def read_by_recognition(df: DataFrame) -> DataFrame:
    """recognised: rows that came from an image."""
    return df.agg((F.count_if("_ocr_source") if "_ocr_source" in df.columns else F.lit(0)).cast("long").alias("recognised"))


def with_expired_acceptances(df: DataFrame) -> DataFrame:
    """username, system, findings of accounts whose acceptances have run out."""
    return df.where(F.size("expired_finding_keys") > 0).select("username", "system", F.array_join("expired_finding_keys", ", ").alias("findings"))
