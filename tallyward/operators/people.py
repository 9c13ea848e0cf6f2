"""HR lists, lists of people who left or moved, and conflicts between roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import vocab as V

UNKNOWN, AMBIGUOUS = "Unknown (not in HR list)", "Ambiguous (same name several times)"


def with_hr(accounts: DataFrame, hr: DataFrame, order: str = "line_no") -> DataFrame:
    """Accounts with employee_status, department and hr_cross_referenced from an HR list, by login, else by name.

    With hr_username in the list the first row of a login counts; else names are compared
    as bags of words, and a name with several different rows is ambiguous. Null and blank
    keys match nothing."""
    has_department = "hr_department" in hr.columns
    if "hr_username" in hr.columns:
        key, hr_key = T.low(F.col("username")), T.low(F.col("hr_username"))
        first = Window.partitionBy("_k").orderBy(order)
        side = hr.withColumn("_k", hr_key).where("_k <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_count", F.lit(1))
    else:
        key, hr_key = T.name_bag(F.col("full_name")), T.name_bag(F.col("full_name"))
        side = hr.withColumn("_k", hr_key).where("_k <> ''").drop(order).dropDuplicates()
        side = side.groupBy("_k").agg(F.count("*").alias("_count"), F.first("hr_employee_status").alias("hr_employee_status"), *([F.first("hr_department").alias("hr_department")] if has_department else []))
    side = side.select("_k", "_count", "hr_employee_status", (F.col("hr_department") if has_department else F.lit(None).cast("string")).alias("hr_department"))
    out = accounts.withColumn("_key", key).join(side, F.col("_key") == F.col("_k"), "left")
    single = F.col("_count") == 1
    own = F.col("department") if "department" in accounts.columns else F.lit(None).cast("string")
    return out.withColumns({
        "employee_status": F.when(F.col("_count").isNull(), UNKNOWN).when(~single, AMBIGUOUS).otherwise(F.col("hr_employee_status")),
        "department": F.when(single, F.coalesce("hr_department", own)).otherwise(own),
        "hr_cross_referenced": F.coalesce(single, F.lit(False)),
    }).drop("_key", "_k", "_count", "hr_employee_status", "hr_department")


def _keyed(df: DataFrame, name: str, side: int) -> DataFrame:
    """Distinct values of a column with their meeting keys, one row for each."""

    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda x: N.meeting_keys(x, side))

    udf = F.pandas_udf(keys, "array<string>")
    return df.select(F.col(name).alias(f"n{side}")).where(f"n{side} is not null").distinct().select(f"n{side}", F.explode(udf(F.col(f"n{side}"))).alias("key"))


def matching_names(left: DataFrame, right: DataFrame, name: str = "full_name") -> DataFrame:
    """n0, n1: distinct pairs of names that are of one person. A join on meeting keys, then the test itself."""

    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([N.same_person(x, y) for x, y in zip(a, b)])

    pairs = _keyed(left, name, 0).join(_keyed(right, name, 1), "key").select("n0", "n1").distinct()
    return pairs.where(F.pandas_udf(test, "boolean")(F.col("n0"), F.col("n1")))


def flag_people(accounts: DataFrame, people: DataFrame, name: str = "full_name") -> DataFrame:
    """``n_people``: how many listed people an account's full name or login matches (0, 1, or 2 for more), and whether the account is active.

    Of a name's matches only the first and the last are kept: more than one is all that counts."""
    listed = people.select(F.col(name).alias("full_name")).where(~T.blank(F.col("full_name"))).distinct()
    sides = [c for c in ("full_name", "username") if c in accounts.columns]
    asked = None
    for c in sides:
        part = accounts.select(F.col(c).alias("full_name"))
        asked = part if asked is None else asked.union(part)
    found = matching_names(asked, listed).groupBy("n0").agg(F.min("n1").alias("a"), F.max("n1").alias("b"))
    out = accounts
    for c in sides:
        out = out.join(found.select(F.col("n0").alias("_n"), F.col("a").alias(f"_a{c}"), F.col("b").alias(f"_b{c}")), F.col(c) == F.col("_n"), "left").drop("_n")
    ends = [F.col(f"_{x}{c}") for c in sides for x in "ab"]
    first, last = (F.least(*ends), F.greatest(*ends)) if ends else (F.lit(None).cast("string"),) * 2
    out = out.withColumn("n_people", F.when(first.isNull(), 0).when(first == last, 1).otherwise(2)).drop(*[f"_{x}{c}" for c in sides for x in "ab"])
    return out.withColumn("active_", F.col("is_active_for_audit") if "is_active_for_audit" in accounts.columns else F.lit(True))


def transferred(accounts: DataFrame, people: DataFrame, name: str = "full_name") -> DataFrame:
    """is_transferred_but_active and transferred_name_ambiguous (more than one listed person matches)."""
    out = flag_people(accounts, people, name)
    return out.withColumns({
        "is_transferred_but_active": (F.col("n_people") > 0) & F.col("active_"),
        "transferred_name_ambiguous": (F.col("n_people") > 1) & F.col("active_"),
    }).drop("n_people", "active_")


def left_people(accounts: DataFrame, people: DataFrame, name: str = "full_name") -> DataFrame:
    """is_terminated_but_active also for accounts whose person is on the list; ladders stay as they were."""
    out = flag_people(accounts, people, name)
    was = F.col("is_terminated_but_active") if "is_terminated_but_active" in accounts.columns else F.lit(False)
    return out.withColumn("is_terminated_but_active", was | ((F.col("n_people") > 0) & F.col("active_"))).drop("n_people", "active_")


def conflict_table(spark, pairs=V.ROLE_CONFLICTS) -> DataFrame:
    """pos, role_a, role_b; blank roles and a role against itself are left out."""
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs) if a and b and a.strip() and b.strip() and a.strip().lower() != b.strip().lower()]
    return spark.createDataFrame(rows, "pos int, role_a string, role_b string")


#: Characters of a part that a role is looked up by, and pairs of a matrix that labels are compared with one by one, at most.
HEAD, MOST_PAIRS = 3, 10_000


def _first_conflict(held: DataFrame, key: str, matrix: DataFrame) -> DataFrame:
    """The first pair of the matrix that a key's roles hold: each distinct role against the matrix's, then by pair.

    ``held``: key, role (distinct). A role holds a part if it contains it; they meet on the
    first characters of the part, which the role must have somewhere."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("role_a").alias("part")), F.struct(F.lit(1).alias("side"), F.col("role_b").alias("part")))
    wanted = matrix.select("pos", F.explode(sides).alias("x")).select("pos", "x.side", T.low(F.col("x.part")).alias("part")).withColumn("head", F.substring("part", 1, HEAD))
    roles = held.select("role").distinct()
    heads = F.expr(f"array_distinct(flatten(transform(sequence(1, {HEAD}), n -> transform(sequence(1, greatest(length(role), 1)), k -> substring(role, k, n)))))")
    hit = roles.select("role", F.explode(heads).alias("head")).join(wanted, "head").where(F.contains(F.col("role"), F.col("part"))).select(F.col("role").alias("_r"), "pos", "side").distinct()
    per = held.join(hit, F.col("role") == F.col("_r")).groupBy(key, "pos").agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    return per.groupBy(F.col(key).alias(f"_{key}")).agg(F.min("pos").alias("_pos"))


def role_conflicts(accounts: DataFrame, matrix: DataFrame, learned: dict[str, str] | None = None, threshold: float | None = 88.0) -> DataFrame:
    """sod_conflict and sod_conflict_detail: by login over all systems, else, less surely, by name.

    A role holds a part of the matrix if it contains it; by login also if its label is as
    alike as ``threshold`` (null: never). The first pair of the matrix counts."""
    held = accounts.select(T.low(F.col("username")).alias("who"), F.explode(T.cells(F.col("role"))).alias("raw")).where("who <> ''")
    if learned:
        table = F.create_map(*[F.lit(x) for kv in learned.items() for x in kv])
        held = held.withColumn("raw", F.coalesce(F.try_element_at(table, T.status_key(F.col("raw"))), F.col("raw")))
    exact = held.select("who", F.lower("raw").alias("role")).distinct()
    if threshold is not None:
        rows = matrix.limit(MOST_PAIRS + 1).collect()
        if len(rows) > MOST_PAIRS:
            raise ValueError(f"a matrix of over {MOST_PAIRS} pairs: give threshold=None, so that roles are only looked up")
        parts = sorted({p for r in rows for p in (r.role_a, r.role_b)})

        def like(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [p for p in parts if N.ratio(p, x) >= threshold])

        alike = held.select("raw").distinct().select(F.col("raw").alias("_raw"), F.explode(F.pandas_udf(like, "array<string>")(F.col("raw"))).alias("role"))
        exact = exact.union(held.join(alike, F.col("raw") == F.col("_raw")).select("who", F.lower("role"))).distinct()
    by_login = _first_conflict(exact, "who", matrix)
    pair = matrix.select(F.col("pos").alias("_p"), F.concat(F.col("role_a"), F.lit(" + "), F.col("role_b")).alias("_pair"))
    out = accounts.withColumn("_w", T.low(F.col("username"))).join(by_login, F.col("_w") == F.col("_who"), "left").join(pair, F.col("_pos") == F.col("_p"), "left").withColumnRenamed("_pair", "_first").drop("_w", "_who", "_pos", "_p")
    detail, second = F.coalesce("_first", F.lit("")), F.lit(None).cast("string")
    if "full_name" in accounts.columns:
        by_name = accounts.select(T.name_bag(F.col("full_name")).alias("bag"), F.explode(T.cells(F.col("role"))).alias("role")).where("bag <> ''").select("bag", F.lower("role").alias("role")).distinct()
        found = _first_conflict(by_name, "bag", matrix)
        out = out.withColumn("_b", T.name_bag(F.col("full_name"))).join(found, F.col("_b") == F.col("_bag"), "left").join(pair, F.col("_pos") == F.col("_p"), "left").drop("_b", "_bag", "_pos", "_p")
        second = F.concat(F.col("_pair"), F.lit(" (by name)"))
    out = out.withColumns({"sod_conflict_detail": F.coalesce("_first", second, detail), "sod_conflict": F.coalesce("_first", second).isNotNull()})
    return out.drop("_first", "_pair")
