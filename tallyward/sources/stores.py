"""What reviewers have taught and decided: learned mappings as JSON, logs as append-only tables, people lists."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as T
from ..functions.names import plain
from . import documents

#: Kinds of learned mappings and the values they may take (None: any).
KINDS = {"columns": None, "transfer_columns": None, "statuses": ("active", "inactive"), "roles": None, "rights": ("admin", "standard")}
LOG_SCHEMA = "key string, seq long, status string, validated_by string, comment string, ts string"
ACCEPTANCE_SCHEMA = "username string, system string, finding string, label string, comment string, accepted_by string, accepted_date string, expiration_date string, seq long"


def mapping_key(kind: str, raw: str) -> str:
    """Headers and statuses are learned by their normalised form, rights as they are written."""
    return H.key(raw) if "columns" in kind else raw if kind == "rights" else " ".join(plain(raw).replace("_", " ").split())


def load_mappings(path: str) -> dict[str, str]:
    """A mapping store; missing or unreadable: empty. A small file of the driver's."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return {str(k): str(v) for k, v in data.items()} if isinstance(data, dict) else {}


def _write(path: str, data: dict) -> None:
    """The whole file or the one before: written beside it, then moved over it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(name, path)


def learn(path: str, kind: str, raw: str, value: str) -> dict[str, str]:
    allowed = KINDS[kind]
    if allowed and value not in allowed:
        raise ValueError(f"{value!r} is none of {allowed}")
    data = load_mappings(path) | {mapping_key(kind, raw): value}
    _write(path, data)
    return data


def forget(path: str, kind: str, raw: str) -> dict[str, str]:
    data = load_mappings(path)
    data.pop(mapping_key(kind, raw), None)
    _write(path, data)
    return data


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only table; empty where nothing has been written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def append(entries: DataFrame, path: str) -> None:
    """Entries as a folder of their own in the table: writers never wait for or overwrite each other."""
    entries.coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def find_column(columns: list[str], candidates: list[str], learned: dict[str, str] | None = None, target: str | None = None) -> str | None:
    """A column by what was learned for ``target``, by name, or by a candidate in its name; accents and case don't count."""
    for c in columns:
        if learned and target and learned.get(H.key(c)) == target:
            return c
    names = [plain(x).replace("_", " ") for x in candidates]
    for test in (lambda c: plain(c).replace("_", " ") in names, lambda c: any(n in plain(c).replace("_", " ") for n in names)):
        if found := next((c for c in columns if test(c)), None):
            return found
    return None


NAME_WORDS = ["full name", "nom complet", "nom prenom", "employee name", "name", "nom", "prenom", "full"]


# Words in the name of a sheet that lists people who moved.
MOVED_SHEETS = ["affectation", "mutation", "transfert", "transfer"]


def people_sheet(tables: dict[str, DataFrame], learned: dict[str, str] | None = None, sheet: str | None = None) -> DataFrame:
    """The sheet asked for; else of those named like a list of moved people, or of all, the first with a column of names, those of the latest year in their name first."""
    if sheet is not None:
        if sheet not in tables:
            raise documents.SourceError(f"no sheet {sheet!r}; there are {sorted(tables)}")
        return tables[sheet]
    hinted = [n for n in tables if any(w in n.lower() for w in MOVED_SHEETS)] or list(tables)
    year = lambda n: max(map(int, re.findall(r"(?:19|20)\d\d", n)), default=0)
    hinted = sorted(hinted, key=lambda n: -year(n))
    named = [n for n in hinted if find_column([c for c in tables[n].columns if c != "line_no"], NAME_WORDS, learned, "transfer_full_name")]
    return tables[(named or hinted)[0]]


def people(spark: SparkSession, path: str, learned: dict[str, str] | None = None, sheet: str | None = None) -> DataFrame:
    """A list of people who moved or left: its name column as full_name (blanks go), other columns as they are.

    Of a workbook one sheet is read: ``sheet``, or the one that ``people_sheet`` finds."""
    suffix = os.path.splitext(path)[1].lower()
    raw = documents.READERS.get(suffix, documents.PLAIN.get(suffix))
    if raw is None:
        raise documents.SourceError(f"unknown format of {path}")
    if raw is documents.xlsx:
        df = people_sheet(documents.sheets(spark, path), learned, sheet)
    else:
        df = raw(spark, path).drop("system")
    columns = [c for c in df.columns if c != "line_no"]
    name = find_column(columns, NAME_WORDS, learned, "transfer_full_name")
    if name is None:  # the first column of words
        texts = df.agg(*[F.avg(F.col(f"`{c}`").rlike(r"\p{L}+[ ,]\s*\p{L}+").cast("double")).alias(f"x{k}") for k, c in enumerate(columns)]).first()
        name = next((c for k, c in enumerate(columns) if (texts[k] or 0) >= 0.5), None)
    if name is None:
        raise documents.SourceError(f"no column of names in {path}")
    return df.withColumnRenamed(name, "full_name").where(~T.blank(F.col("full_name")))


def conflict_matrix(spark: SparkSession, path: str) -> DataFrame:
    """pos, role_a, role_b from the first two columns of a file; blanks and pairs of one role are left out."""
    suffix = os.path.splitext(path)[1].lower()
    df = documents.READERS[suffix](spark, path)
    a, b = [c for c in df.columns if c != "line_no"][:2]
    rows = df.select(F.col("line_no").alias("pos"), T.strip(F.col(f"`{a}`")).alias("role_a"), T.strip(F.col(f"`{b}`")).alias("role_b"))
    return rows.where((F.coalesce("role_a", F.lit("")) != "") & (F.coalesce("role_b", F.lit("")) != "") & (F.lower("role_a") != F.lower("role_b")))
