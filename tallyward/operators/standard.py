"""Raw tables to the canonical account schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as T

REQUIRED = ("username", "system")
# Logins that name no one, and the columns that say who it is.
NO_ONE = ["administrator", "admin", "system", "service", "root", "guest"]
IDENTITIES = ["identity", "samaccountname", "distinguishedname"]
_TRUE, _FALSE = ["true", "1", "yes", "y", "oui"], ["false", "0", "no", "n", "non"]


class MissingColumns(ValueError):
    pass


@dataclass
class Standardised:
    """A table in the canonical schema and what was decided on the way."""

    df: DataFrame
    mapping: dict[str, list[str]] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    unmapped: list[str] = field(default_factory=list)


def unique_names(names: list[str]) -> list[str]:
    """Names made unique: the second x is x__dup1; nameless columns are numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = str(name).strip() if name is not None and str(name).strip() else f"unnamed_{i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if not n else f"{name}__dup{n}")
    return out


def inverted_flag(c) -> Column:
    """The status that a flag for the contrary stands for: true is Disabled, false Active, other text as it is."""
    return F.when(T.low(c).isin(_TRUE), "Disabled").when(T.low(c).isin(_FALSE), "Active").otherwise(c)


def first_filled(*columns) -> Column:
    return F.coalesce(*[T.present(c) for c in columns])


def standardise(df: DataFrame, headers: dict[str, list[str]] | None = None, learned: dict[str, str] | None = None) -> Standardised:
    """Columns renamed to fields. Of two columns for a field the first fills and the second helps out where it is
    blank; learned columns come before others; ignored columns go; unknown columns stay."""
    chosen: dict[str, list[tuple[str, bool]]] = {}
    ignored, unmapped = [], []
    for c in df.columns:
        base = c.split("__dup")[0]
        target = H.match(base, headers, learned)
        if learned and learned.get(H.key(base)) == H.IGNORED:
            ignored.append(c)
        elif target is None:
            unmapped.append(c)
        else:
            inverted = target.endswith(H.INVERTED)
            entry = (c, inverted)
            spot = chosen.setdefault(target.removesuffix(H.INVERTED), [])
            spot.insert(0, entry) if learned and H.key(base) in learned else spot.append(entry)
    exprs = []
    for target, sources in chosen.items():
        parts = [inverted_flag(F.col(f"`{c}`")) if inverted else F.col(f"`{c}`") for c, inverted in sources]
        exprs.append((parts[0] if len(parts) == 1 else first_filled(*parts)).alias(target))
    taken = set(chosen)
    exprs += [F.col(f"`{c}`").alias(c if c not in taken else f"{c}__raw") for c in unmapped]
    return Standardised(df.select(*exprs), {k: [c for c, _ in v] for k, v in chosen.items()}, ignored, unmapped)


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """n_both, n_different: rows in which two columns for one field hold values, and different ones."""
    x, y = T.present(F.col(a)), T.present(F.col(b))
    return df.agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("n_both"), F.count_if(F.coalesce(T.strip(x) != T.strip(y), F.lit(False))).alias("n_different"))


_DATE_LIKE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|^\d{1,2}[- ]\p{L}{3,}[- ]\d{2,4}"
DATE_FIELDS = ("last_login_date", "password_last_set", "account_created_date")


def date_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, share (of values over five characters that look like dates), n_distinct (two at most are told apart)."""
    out = []
    for c in columns:
        t = T.strip(F.col(f"`{c}`"))
        long = F.length(t) > 5
        out.append(F.struct(F.lit(c).alias("column_name"), F.round(F.avg(F.when(long, t.rlike(_DATE_LIKE).cast("double"))), 6).alias("share"), (F.min(F.when(long, t)) != F.max(F.when(long, t))).alias("varies")))
    return df.agg(F.array(*out).alias("x")).select(F.inline("x"))


def detect_dates(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Unmapped columns of dates take the date fields that are free, in order."""
    from ..functions.vocab import HEADERS

    free = [f for f in DATE_FIELDS if f not in df.columns]
    loose = [c for c in df.columns if c not in HEADERS]
    if not free or not loose:
        return df
    found = [r.column_name for r in date_shares(df, loose).collect() if (r.share or 0) >= least and r.varies]  # a row for each column
    for f, c in zip(free, found):
        df = df.withColumnRenamed(c, f)
    return df


def login_from_home(df: DataFrame, column: str = "home_directory") -> DataFrame:
    """username from the last part of a home directory's path, if there is no username."""
    if "username" in df.columns or column not in df.columns:
        return df
    path = F.regexp_replace(T.strip(F.col(column)), r"[/\\]+$", "")
    return df.withColumn("username", T.present(F.regexp_extract(path, r"([^/\\]+)$", 1)))


def specific_login(df: DataFrame, identity: str | None = None) -> DataFrame:
    """A username that names no one gives way to an identity: what follows its last backslash, else its last slash, else all of it.

    ``identity``: its column, else the first that is called like one; without any, nothing changes."""
    identity = identity or next((c for c in df.columns if c.strip().lower() in IDENTITIES), None)
    if identity is None or "username" not in df.columns:
        return df
    t = T.strip(F.col(f"`{identity}`"))
    told = T.present(T.strip(F.when(F.contains(t, F.lit("\\")), F.substring_index(t, "\\", -1)).otherwise(F.substring_index(t, "/", -1))))
    told = F.when(~T.low(told).isin(NO_ONE), told)
    no_one = T.low(F.col("username")).isin(NO_ONE) | T.blank(F.col("username"))
    return df.withColumn("username", F.when(no_one, F.coalesce(told, F.col("username"))).otherwise(F.col("username")))


def full_name(df: DataFrame) -> DataFrame:
    """full_name from first and last name where it is missing."""
    parts = [T.present(F.col(c)) for c in ("first_name", "last_name") if c in df.columns]
    if not parts:
        return df
    made = T.present(F.concat_ws(" ", *[T.strip(p) for p in parts]))
    return df.withColumn("full_name", F.coalesce(T.present(F.col("full_name")), made) if "full_name" in df.columns else made)


def with_system(df: DataFrame, default: str) -> DataFrame:
    return df.withColumn("system", F.coalesce(T.present(F.col("system")), F.lit(default)) if "system" in df.columns else F.lit(default))


def validate(df: DataFrame, required=REQUIRED, strict: bool = True) -> list[str]:
    """Required fields that are missing or blank throughout (one aggregate); raises if strict."""
    missing = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    if have:
        row = df.agg(*[F.max((~T.blank(F.col(c))).cast("int")).alias(c) for c in have]).first()
        missing += [c for c in have if row[c] == 0]
    if missing and strict:
        raise MissingColumns("required fields without values: " + ", ".join(missing))
    return missing


def without_blank_rows(df: DataFrame, leaving=()) -> DataFrame:
    """Without the rows that are blank in all columns but those in ``leaving``."""
    return df.where(F.coalesce(*[T.present(F.col(f"`{c}`").cast("string")) for c in df.columns if c not in leaving]).isNotNull())
