"""Reports out: a table for each control, one text report, CSV for a screen, a name for the file, backups of stores."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .cycles import account_key, changes, comparison_keys, created, deleted
from .office import pdf, word, workbook
from .reports import by_risk, completeness, in_english

#: Columns that a full list shows, where they are there.
COLUMNS = [
    "system", "username", "user_id", "full_name", "department", "manager", "employee_status", "account_status", "role", "user_rights", "is_privileged_flag",
    "last_login_date", "days_since_last_login", "account_created_date", "password_last_set", "days_since_password_change", "password_status",
    "has_non_expiring_password", "risk_level", "risk_score", "review_action",
]
#: What a control's rule reads, beside who it is about and what to do.
READS = {
    1: [], 2: ["last_login_date", "days_since_last_login"], 3: ["account_status"], 4: ["account_status"], 5: ["account_status"], 6: ["last_login_date", "account_created_date"],
    7: ["account_status"], 8: ["department", "account_status"], 10: ["account_created_date", "days_since_creation"], 11: ["user_rights", "role"], 12: ["account_status"], 13: ["account_status"],
    14: ["password_last_set", "days_since_password_change"], 16: ["user_rights", "role"], 18: ["employee_status", "account_status"],
}


def label(column: str) -> str:
    """A column's name as a heading: words, without what marks it as a flag."""
    words = column.removeprefix("is_").removeprefix("has_").removesuffix("_flag").replace("_", " ").strip()
    return words[:1].upper() + words[1:]


def shown(df: DataFrame, columns: list[str] | None = None, labels: bool = True) -> DataFrame:
    """Columns for a report: values in English, flags as Yes and No, a missing password age in words, labels."""
    out = []
    for c in columns or COLUMNS:
        if c not in df.columns:
            continue
        kind = dict(df.dtypes)[c]
        x = F.when(F.col(c), "Yes").otherwise("No") if kind == "boolean" else in_english(F.col(c)) if kind == "string" else F.col(c).cast("string")
        if c == "days_since_password_change":
            x = F.coalesce(x, F.lit("Unknown (not verifiable)"))
        out.append(x.alias(label(c) if labels else c))
    return df.select(*out)


def control_rows(df: DataFrame, number: int, previous: DataFrame | None = None) -> DataFrame | None:
    """The accounts that a control counts: the same conditions as its figure, accepted findings left out.

    Those of the controls on two cycles need ``previous``, the earlier cycle analysed;
    deleted accounts are rows of that. Moved people count among those who left, where they
    have been looked for. None for a control that counts no accounts."""
    key = dict(V.CONTROLS)[number]
    if key == "_active_count":
        return df.where("is_active_for_audit")
    if key in ("_created", "_profile_modified", "_reactivated", "_deleted"):
        if previous is None:
            return df.where("is_recently_created") if key == "_created" else None
        keys = comparison_keys(df, previous)
        if key == "_created":
            return created(df, previous, keys)
        if key == "_deleted":
            return deleted(df, previous, keys)
        flag = "profile_changed" if key == "_profile_modified" else "reactivated"
        hit = changes(df, previous, keys).where(flag).select(account_key("username", "system").alias("_key")).distinct()
        return df.withColumn("_key", account_key("username", "system")).join(hit, "_key", "left_semi").drop("_key")
    if key is None or key.startswith("_"):
        return None

    def counts(name):
        cond = F.col(name)
        if "accepted_finding_keys" in df.columns:
            cond = cond & ~F.array_contains("accepted_finding_keys", name)
        return cond

    cond = counts(key)
    if key not in ("is_never_used", "is_terminated_but_active"):
        cond = cond & F.col("is_active_for_audit")
    if key == "is_terminated_but_active" and "is_transferred_but_active" in df.columns:
        cond = cond | counts("is_transferred_but_active")
    return df.where(cond)


def write_workbook(df: DataFrame, coverage: DataFrame, folder: str, fmt: str = "parquet", previous: DataFrame | None = None) -> None:
    """A folder for the summary, the completeness of the export, each control's accounts and the full list. Tables are never cut."""
    put = lambda table, name: table.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/{name}")
    labels = fmt == "csv"
    put(coverage.coalesce(1), "summary")  # nineteen rows
    put(completeness(df).coalesce(1), "control_01")  # seven rows
    for number, reads in READS.items():
        rows = control_rows(df, number, previous)
        if rows is not None:
            put(shown(rows, ["system", "username", "full_name", *reads, "review_action"], labels), f"control_{number:02}")
    put(shown(by_risk(df), labels=labels), "accounts")


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV in as many parts as df has: each with its headers, in df's order."""
    df.write.mode("overwrite").csv(folder, header=True)


def report_blocks(coverage: DataFrame, histogram: DataFrame, breakdown: DataFrame, title: str = "Account review") -> list[tuple]:
    """The figures of a review as blocks of a document; the tables it reads are a few rows each."""
    controls = [[r.number, r.title, r.status, "-" if r.found is None else r.found] for r in coverage.orderBy("number").collect()]
    levels = [[V.ENGLISH.get(r.risk_level, r.risk_level), r.accounts] for r in histogram.orderBy("rank").collect()]
    statuses = [[r.account_status, r.n_current, r.n_previous, r.variation] for r in breakdown.orderBy("is_total", F.desc("n_current"), "account_status").collect()]
    return [
        ("heading", 1, title), ("table", [["#", "Control", "Status", "Found"], *controls]), ("table", [["Risk", "Accounts"], *levels]),
        ("table", [["Status", "Now", "Before", "Variation"], *statuses]),
    ]


def markdown_report(coverage: DataFrame, histogram: DataFrame, breakdown: DataFrame, title: str = "Account review") -> str:
    """``report_blocks`` as Markdown."""
    out = []
    for kind, *rest in report_blocks(coverage, histogram, breakdown, title):
        if kind == "heading":
            out += ["#" * rest[0] + " " + rest[1], ""]
        elif kind == "paragraph":
            out += [rest[0], ""]
        else:
            rows = [["" if c is None else str(c) for c in r] for r in rest[0]]
            out += ["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *["| " + " | ".join(r) + " |" for r in rows[1:]], ""]
    return "\n".join(out)


def save(spark, path: str, content: bytes) -> None:
    """A file through Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    stream.write(content)
    stream.close()


def write_excel(df: DataFrame, coverage: DataFrame, path: str, previous: DataFrame | None = None) -> None:
    """One workbook: the summary, the completeness of the export, each control's accounts and the full list.

    The accounts are computed once for all sheets. Rows come to the driver one partition at
    a time, the next meanwhile; a table that is longer than a sheet goes on in further ones."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.DISK_ONLY)  # each partition of each sheet is a job
    rows = lambda table: (table.columns, (tuple(r) for r in table.toLocalIterator(prefetchPartitions=True)))

    def sheets():
        yield "Summary", *rows(coverage.orderBy("number"))
        yield "Control 01", *rows(completeness(df))
        for number, reads in READS.items():
            part = control_rows(df, number, previous)
            if part is not None:
                yield f"Control {number:02}", *rows(shown(part, ["system", "username", "full_name", *reads, "review_action"]))
        yield "Accounts", *rows(shown(by_risk(df)))

    try:
        save(df.sparkSession, path, workbook(sheets()))
    finally:
        df.unpersist()


def write_word(spark, blocks: list[tuple], path: str) -> None:
    save(spark, path, word(blocks))


def write_pdf(spark, blocks: list[tuple], path: str) -> None:
    save(spark, path, pdf(blocks))


def report_name(df: DataFrame, extension: str, on: date, origin: str | None = None, scope: str | None = None) -> str:
    """A file name by what was reviewed and when: the origin, else the scope, else up to three systems, else how many there are."""
    of = next((x.strip() for x in (origin, scope) if x and x.strip()), None)
    if of is None and "system" in df.columns:
        names = [r.s for r in df.select(F.trim("system").alias("s")).where("s <> ''").distinct().orderBy("s").limit(4).collect()]
        of = "-".join(names) if 0 < len(names) <= 3 else "several-systems" if names else None
    of = re.sub(r"[^A-Za-z0-9\-]+", "_", of or "all").strip("_") or "all"
    return f"access-review_{of}_{on.year}-Q{(on.month - 1) // 3 + 1}_{on:%Y%m%d}.{extension.lstrip('.')}"


def backup(paths: list[str]) -> bytes:
    """A ZIP of store files, those that are there."""
    import os

    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            if os.path.exists(p):
                z.write(p, os.path.basename(p))
    return f.getvalue()
