"""Tables side by side and over time: merging exports, comparing cycles, decisions, acceptances, trends."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.dates import moment_of
from .review import decide

SEPARATOR = "::"


def account_key(*columns) -> Column:
    """Normalised parts joined by ``::``; null parts are empty."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(T.low(F.col(c)), F.lit("")) for c in columns])


# ---- merging ----------------------------------------------------------------------------

def shared_login(c) -> Column:
    """A login that many systems have of their own: one of the names, whole, with a mark and digits after it perhaps."""
    return F.coalesce(T.low(c).rlike(rf"^({'|'.join(V.SHARED_LOGINS)})([_\-.]?\d*)?$"), F.lit(False))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """common, size_a, size_b, overlap: shared distinct logins over the smaller table's, shared logins apart.

    If a side has shared logins only, all logins count on both."""
    side = lambda df, x: df.select(T.low(F.col("username")).alias("u")).where("u <> ''").distinct().withColumn(x, F.lit(1))
    both = side(a, "a").join(side(b, "b"), "u", "full").withColumn("g", shared_login(F.col("u")))
    n = both.agg(*[F.count_if(cond & keep).alias(f"{name}{k}") for k, keep in enumerate((~F.col("g"), F.lit(True))) for name, cond in (("a", F.col("a").isNotNull()), ("b", F.col("b").isNotNull()), ("c", F.col("a").isNotNull() & F.col("b").isNotNull()))])
    raw = (F.col("a0") == 0) | (F.col("b0") == 0)
    pick = lambda x: F.when(raw, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    out = n.select(pick("c").alias("common"), pick("a").alias("size_a"), pick("b").alias("size_b"))
    small = F.least("size_a", "size_b")
    return out.withColumn("overlap", F.when(small > 0, F.round(F.col("common") / small, 6)).otherwise(0.0))


#: Pairs of rows of one login above which they are dealt to several tasks, and rows of a side in a block there.
PAIRS, SIDE = 100_000, 512


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on username (null keys meet); where both have a column the left's value wins.

    Logins whose rows make more than PAIRS pairs are joined apart: both sides are counted
    by row, dealt to chunks of SIDE rows, and each pair of chunks is a block of its own,
    whose rows are repeated as often as they were counted. All pairs come out."""
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    r = right.toDF(*[f"_r_{c}" for c in right.columns])
    per = left.groupBy("username").agg(F.count("*").alias("_nl")).join(r.groupBy("_r_username").agg(F.count("*").alias("_nr")), F.col("username").eqNullSafe(F.col("_r_username")))
    chunks = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    hot = F.broadcast(per.where(F.col("_nl") * F.col("_nr") > PAIRS).select(F.col("username").alias("_hot"), chunks("_nl").alias("_cl"), chunks("_nr").alias("_cr")))  # a row for PAIRS rows of the result

    def dealt(df, key, mine, other, n):
        rows = df.join(hot, F.col(key).eqNullSafe(F.col("_hot"))).groupBy(*df.columns, mine, other).agg(F.count("*").alias("_n"))
        # of many equal rows each SIDE go to a chunk of their own
        some = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / SIDE).cast("int") - 1)))
        some = some.withColumn(n, F.least(F.lit(SIDE), F.col("_n") - F.col("_piece") * SIDE).cast("int")).withColumn(f"{n}_at", F.pmod(F.xxhash64(*df.columns, "_piece"), mine).cast("int"))
        own, theirs = F.col(f"{n}_at"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_with")
        some = some.select(*df.columns, n, own, theirs)
        pair = (own, F.col("_with")) if n == "_l" else (F.col("_with"), own)
        return some.select(*df.columns, n, F.struct(F.col(key).alias("k"), pair[0].alias("i"), pair[1].alias("j")).alias(f"_block{n}"))

    a, b = dealt(left, "username", "_cl", "_cr", "_l"), dealt(r, "_r_username", "_cr", "_cl", "_r")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: by their size before they are repeated, all blocks would go to one task
    both = a.repartition(tasks, "_block_l").join(b.repartition(tasks, "_block_r"), F.col("_block_l") == F.col("_block_r"))
    again = lambda df, n: df.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col(n)))).drop("_again")
    many = again(again(both, "_l"), "_r").select(*left.columns, *r.columns)
    cold = lambda df, key: df.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
    few = cold(left, "username").join(cold(r, "_r_username"), F.col("username").eqNullSafe(F.col("_r_username")), "full")
    return few.union(many).select(*[(F.coalesce(F.col(c), F.col(f"_r_{c}")) if c in left.columns and c in right.columns else F.col(c) if c in left.columns else F.col(f"_r_{c}")).alias(c) for c in columns])


def stack(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def merge_or_stack(tables: dict[str, DataFrame], least: float = 0.5, names_are_systems: bool = True, default_system: str | None = None) -> DataFrame:
    """Tables that share logins are merged, the others stacked.

    Two tables go together if half the smaller's logins are shared and their systems, if
    both name any, overlap; what goes together with a third goes together. Only counts
    come to the driver. Of several tables, one that is merged with no other takes its own
    name where it has no system; merged ones take the default system, if one is given."""
    names, root = list(tables), {n: n for n in tables}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = tables[a], tables[b]
            if "username" not in x.columns or "username" not in y.columns or overlap(x, y).first().overlap < least:
                continue
            if "system" in x.columns and "system" in y.columns:
                own = lambda df: df.select(T.low(F.col("system")).alias("s")).where("s <> ''").distinct()
                sx, sy = own(x), own(y)
                if not sx.isEmpty() and not sy.isEmpty() and sx.join(sy, "s", "left_semi").isEmpty():
                    continue
            root[find(b)] = find(a)
    parts = {}
    for n in names:
        t = tables[n]
        parts[find(n)] = (merge(parts[find(n)][0], t), True) if find(n) in parts else (t, False)
    out = []
    for n, (t, merged) in parts.items():
        name = default_system if merged or not names_are_systems or len(tables) < 2 else n
        if name is not None:
            t = t.withColumn("system", F.coalesce(T.present(F.col("system")), F.lit(name)) if "system" in t.columns else F.lit(name))
        out.append(t)
    return stack(*out)


def collapse_permissions(df: DataFrame, rights: str = "user_rights", order: str = "line_no", ref: date = date(2030, 1, 1)) -> DataFrame:
    """One row for each username (and system): its distinct rights by line, latest login, first value elsewhere.

    Logins are compared as moments, day first; of those that name none, the first stays.
    ``ref`` dates years of two digits and days without a year; as it stands, a day without
    a year counts as recent."""
    keys = [c for c in ("username", "system") if c in df.columns]
    rest = [c for c in df.columns if c not in (*keys, rights, "last_login_date", order)]
    listed = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~T.blank(F.col(rights)), F.struct(F.col(order).alias("o"), T.strip(F.col(rights)).alias("v"))))), lambda x: x["v"])), "\n")
    aggs = [listed.alias(rights), F.min(order).alias(order)]
    if "last_login_date" in df.columns:
        when, text = moment_of("last_login_date", ref), F.col("last_login_date")
        latest = F.max_by(text, F.when(when.isNotNull(), F.struct(when, (-F.col(order)).alias("line"))))
        aggs.append(F.coalesce(latest, F.min_by(text, F.when(text.isNotNull(), F.col(order)))).alias("last_login_date"))
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*aggs).select(*df.columns)


# ---- two cycles -------------------------------------------------------------------------

#: In place of the system's name among the keys: systems that the previous cycle lacks make their accounts new.
NEW_SYSTEM = "new system"


def comparison_keys(current: DataFrame, previous: DataFrame) -> list[str]:
    """(username, system) if both cycles have several systems, (username, new system) if only the current one has, else username.

    Two small counts decide."""
    now, before = [df.select(T.low(F.col("system")).alias("s")).where("s <> ''").distinct().limit(2).count() > 1 if "system" in df.columns else False for df in (current, previous)]
    return ["username", "system"] if now and before else ["username", NEW_SYSTEM] if now else ["username"]


def _columns(keys: list[str]) -> list[str]:
    return [k for k in keys if k != NEW_SYSTEM]


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(~T.blank(F.col("username"))).withColumns({f"_{k}": F.coalesce(T.low(F.col(k)), F.lit("")) for k in _columns(keys)})


def _lacking(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    by = [f"_{k}" for k in _columns(keys)]
    return _keyed(a, keys).join(_keyed(b, keys).select(*by).distinct(), by, "left_anti").drop(*by)


def created(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Accounts of the current cycle whose key the previous one lacks, or whose system, where that counts.

    Rows without a username are left out."""
    if NEW_SYSTEM not in keys:
        return _lacking(current, previous, keys)
    users = _keyed(previous, keys).select(F.col("_username").alias("_u")).distinct().withColumn("_known", F.lit(True))
    out = _keyed(current, keys).join(users, F.col("_username") == F.col("_u"), "left")
    of = T.low(F.col("system"))
    if "system" in previous.columns:
        systems = previous.select(T.low(F.col("system")).alias("_s")).where("_s <> ''").distinct().withColumn("_there", F.lit(True))
        out = out.withColumn("_of", of).join(systems, F.col("_of") == F.col("_s"), "left")
    else:
        out = out.withColumns({"_of": of, "_s": F.lit(None), "_there": F.lit(None).cast("boolean")})
    return out.where(F.col("_known").isNull() | (~T.blank(F.col("system")) & F.col("_there").isNull())).select(*[F.col(f"`{c}`") for c in current.columns])


def deleted(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    return _lacking(previous, current, keys)


def _firsts(df: DataFrame, keys: list[str], profile: str, order: str) -> DataFrame:
    """The first row of each key: what cycles are compared by, as a struct ``row``."""
    text = F.coalesce(T.strip(F.col(profile)), F.lit(""))
    row = F.struct("username", *(["system"] if "system" in df.columns else []), F.col("is_active_for_audit").alias("active"), F.col("is_privileged_flag").alias("privileged"), text.alias("profile"))
    return _keyed(df, keys).groupBy(*[f"_{k}" for k in _columns(keys)]).agg(F.min_by(row, order).alias("row"))


def _both(current: DataFrame, previous: DataFrame, keys: list[str], order: str, how: str) -> DataFrame:
    profile = "user_rights" if "user_rights" in current.columns and "user_rights" in previous.columns else "role"
    was = _firsts(previous, keys, profile, order).withColumnRenamed("row", "was")
    return _firsts(current, keys, profile, order).join(was, [f"_{k}" for k in _columns(keys)], how)


_CHANGED = {
    "reactivated": "row.active and not was.active",
    "profile_changed": "row.profile <> was.profile",
    "escalated": "row.privileged and not was.privileged",
}


def changes(current: DataFrame, previous: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """username, system and flags of accounts in both cycles: reactivated, profile_changed, escalated; first rows count."""
    both = _both(current, previous, keys, order, "inner")
    return both.select("row.username", "row.system", *[F.expr(sql).alias(name) for name, sql in _CHANGED.items()])


def comparison(current: DataFrame, previous: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """One row: created, deleted, reactivated, profile_changed, escalated (keys, each once).

    One full join of the cycles' keys answers all; accounts on new systems are counted apart."""
    both = _both(current, previous, keys, order, "full")
    counts = [F.count_if(F.col("was").isNull()).alias("created"), F.count_if(F.col("row").isNull()).alias("deleted"), *[F.count_if(F.coalesce(F.expr(sql), F.lit(False))).alias(name) for name, sql in _CHANGED.items()]]
    out = both.agg(*counts)
    if NEW_SYSTEM in keys:
        n = created(current, previous, keys).agg(F.count_distinct(T.low(F.col("username"))).alias("_n"))
        out = out.join(F.broadcast(n)).withColumn("created", F.col("_n")).drop("_n")  # one row each
    return out


# ---- decisions --------------------------------------------------------------------------

STATUSES = ("pending", "approved", "revoked", "modified")


def latest_decisions(accounts: DataFrame, log: DataFrame) -> DataFrame:
    """review_status (pending without one), validated_by, review_comment, review_date of each account's last entry."""
    last = log.groupBy(F.col("key").alias("_k")).agg(F.max_by(F.struct("status", "validated_by", "comment", "ts"), F.col("seq")).alias("_d"))
    out = accounts.withColumn("_key", account_key("username", "system")).join(last, F.col("_key") == F.col("_k"), "left")
    return out.withColumns({
        "review_status": F.coalesce("_d.status", F.lit("pending")), "validated_by": F.coalesce("_d.validated_by", F.lit("")),
        "review_comment": F.coalesce("_d.comment", F.lit("")), "review_date": F.coalesce("_d.ts", F.lit("")),
    }).drop("_key", "_k", "_d")


def decision(spark, username: str, system: str, seq: int, status: str, validated_by: str, ts: str, comment: str = "") -> DataFrame:
    """An entry to append to the log."""
    if status not in STATUSES:
        raise ValueError(f"unknown decision {status!r}")
    key = SEPARATOR.join(x.strip().lower() for x in (username, system))
    return spark.createDataFrame([(key, seq, status, validated_by, comment, ts)], "key string, seq long, status string, validated_by string, comment string, ts string")


def audit_trail(log: DataFrame, username: str, system: str | None = None) -> DataFrame:
    """All entries of an account, or of a login on any system, in order."""
    login = username.strip().lower() + SEPARATOR
    of = F.col("key") == login + system.strip().lower() if system is not None else F.col("key").startswith(login)
    return log.where(of).orderBy("seq")


def progress(df: DataFrame) -> DataFrame:
    n = F.count("*")
    pending = F.count_if(F.col("review_status") == "pending")
    return df.agg(n.alias("accounts"), *[F.count_if(F.col("review_status") == s).alias(s) for s in STATUSES], F.when(n > 0, F.round(100.0 * (n - pending) / n, 1)).otherwise(0.0).alias("percent_done"))


# ---- acceptances ------------------------------------------------------------------------

def with_acceptances(df: DataFrame, acceptances: DataFrame, as_of: date) -> DataFrame:
    """accepted_finding_keys, expired_finding_keys, accepted_findings_detail; ladders without accepted findings.

    An acceptance (username, system, finding; the last by seq) counts while the finding is
    true and its expiry is not past; an unreadable expiry never passes. Flags stay."""
    last = acceptances.groupBy(account_key("username", "system").alias("_k"), "finding").agg(F.max_by(F.struct("label", "comment", "accepted_by", "accepted_date", "expiration_date"), F.col("seq")).alias("a"))
    expiry = F.try_to_timestamp(F.col("a.expiration_date"), F.lit("yyyy-MM-dd")).cast("date")
    last = last.withColumn("gone", F.coalesce(expiry < F.lit(as_of), F.lit(False)))
    per = last.groupBy("_k").agg(F.collect_list(F.struct("finding", "gone", F.col("a.label").alias("label"), F.col("a.comment").alias("comment"), F.col("a.accepted_by").alias("accepted_by"), F.col("a.expiration_date").alias("expiration_date"))).alias("_all"))
    out = df.withColumn("_key", account_key("username", "system")).join(per, F.col("_key") == F.col("_k"), "left")
    keys = [k for k in V.ACCEPTABLE if k in df.columns]
    true_now = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    now = F.filter(F.coalesce("_all", F.array().cast("array<struct<finding:string,gone:boolean,label:string,comment:string,accepted_by:string,expiration_date:string>>")), lambda a: F.array_contains(true_now, a["finding"]))
    out = out.withColumn("_now", F.array_sort(now))
    out = out.withColumns({
        "accepted_finding_keys": F.transform(F.filter("_now", lambda a: ~a["gone"]), lambda a: a["finding"]),
        "expired_finding_keys": F.transform(F.filter("_now", lambda a: a["gone"]), lambda a: a["finding"]),
        "accepted_findings_detail": F.filter("_now", lambda a: ~a["gone"]),
    }).drop("_key", "_k", "_all", "_now")
    return decide(out, off=lambda name: F.array_contains("accepted_finding_keys", name))


def accepted_detail(df: DataFrame) -> DataFrame:
    return df.select("username", "system", F.inline("accepted_findings_detail")).drop("gone")


# ---- trends -----------------------------------------------------------------------------

TREND = ("is_dormant", "is_never_used", "is_privileged_flag", "is_password_stale", "is_orphaned_account", "is_terminated_but_active", "is_duplicate_account", "has_no_manager")


def snapshot(df: DataFrame, cycle: date, label: str) -> DataFrame:
    """A cycle's rows of the trend table: all systems (null) and each, by grouping sets."""
    n = [F.count_if(F.col(c)).alias(c) for c in TREND] + [F.count_if(F.col("risk_level") == v).alias(f"risk_{k}") for k, v in enumerate(V.LEVELS)]
    per = df.groupingSets([[F.col("system")], []], "system").agg(F.grouping("system").alias("whole"), F.count("*").alias("total_accounts"), *n)
    return per.select(F.lit(cycle).alias("cycle_date"), F.lit(label).alias("period_label"), "*")


def trend(history: DataFrame, system: str | None = None) -> DataFrame:
    rows = history.where("whole = 1") if system is None else history.where((F.col("whole") == 0) & (T.low(F.col("system")) == system.strip().lower()))
    return rows.orderBy("cycle_date")


def scope_changes(history: DataFrame) -> DataFrame:
    """cycle_date, systems, scope_changed: whether a cycle covers other systems than the one before."""
    per = history.where("whole = 0").groupBy("cycle_date").agg(F.array_sort(F.collect_set(T.low(F.col("system")))).alias("systems"))
    before = F.lag("systems").over(Window.orderBy("cycle_date"))  # one row for each cycle
    return per.withColumn("scope_changed", F.coalesce(before != F.col("systems"), F.lit(False)))
