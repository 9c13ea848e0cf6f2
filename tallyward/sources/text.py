"""Text exports: delimited, aligned and key-value text, LDIF and JSON, as DataFrames.

Files come through Spark's readers, so any store that Spark reads will do; the driver looks
at the first lines only. Rows carry ``line_no``, their place in the file."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators.standard import unique_names

DELIMITERS = (",", ";", "\t", "|")
LIST_KEYS = ("results", "data", "users", "accounts", "records", "items", "value")
SAMPLE = 4096


class SourceError(ValueError):
    pass


def sniff_encoding(head: bytes) -> str:
    """UTF-8 unless the first bytes say otherwise: a byte order mark, NULs in every second place, or bytes that aren't UTF-8."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    if head and head.count(0) > 0.3 * len(head):
        return "UTF-16LE" if head[1::2].count(0) >= head[::2].count(0) else "UTF-16BE"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(head) < SAMPLE)  # a sample may end inside a character
        return "UTF-8"
    except UnicodeDecodeError:
        return "windows-1252" if _decodes(head, "cp1252") else "ISO-8859-1"


def _decodes(head: bytes, encoding: str) -> bool:
    try:
        head.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


#: Spark reads windows-1252 as ISO-8859-1; these are the characters in which the two differ.
_C1 = [b for b in range(0x80, 0xA0) if _decodes(bytes([b]), "cp1252")]


def spark_encoding(name: str) -> str:
    return "ISO-8859-1" if name == "windows-1252" else name


def as_read(c, name: str) -> Column:
    """A column read with ``spark_encoding(name)`` as the encoding means it, without a byte order mark."""
    c = F.regexp_replace(c, "^\ufeff", "")
    return F.translate(c, "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")) if name == "windows-1252" else c


def first_bytes(spark: SparkSession, path: str, n: int = SAMPLE) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, n).alias("head")).limit(1).collect()
    if not rows:
        raise SourceError(f"no file at {path}")
    return bytes(rows[0].head)


def sniff_delimiter(sample: str) -> str | None:
    """The delimiter that the first lines hold most evenly often; None if there is none."""
    lines = [x for x in sample.splitlines() if x.strip()][:20]
    best = None
    for d in DELIMITERS:
        counts = sorted(x.count(d) for x in lines)
        if counts and counts[len(counts) // 2] and (best is None or counts[len(counts) // 2] > best[0]):
            best = counts[len(counts) // 2], d
    return best[1] if best else None


def decoded(head: bytes) -> str:
    return head.decode(sniff_encoding(head), errors="replace").lstrip("\ufeff")


def _named(raw: DataFrame, cells: Column, at: int, names: list[str]) -> DataFrame:
    """The rows after row ``at`` with their cells as columns."""
    names = unique_names(names)
    return raw.where(F.col("line_no") > at).select(F.col("line_no"), *[F.get(cells, k).alias(n) for k, n in enumerate(names)])


def grid(raw: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """A table from (line_no, cells): its header row is found among the first fifteen, ragged rows are padded."""
    top = raw.orderBy("line_no").limit(15).collect()
    if not top:
        raise SourceError("no rows")
    at = H.header_row([r.cells for r in top], headers)
    names = list(top[at].cells)
    width = raw.agg(F.max(F.size("cells"))).first()[0]
    return _named(raw, F.col("cells"), top[at].line_no, names + [None] * (width - len(names)))


def _filled(c) -> Column:
    return F.exists(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def csv_shape(spark: SparkSession, path: str, d: str, enc: str) -> tuple[int, bool]:
    """Cells of the widest row of the whole file, and whether a row may go over several lines: then a line holds an odd number of quotes.

    Lines are counted apart, in as many tasks as the file has splits; only a file in
    two-byte characters or with rows over several lines is gone through whole."""
    if not enc.startswith("UTF-16"):
        line = F.col("value")
        bare = F.regexp_replace(line, '"[^"]*"', "")
        cells = F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1
        odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
        row = spark.read.text(path).agg(F.max(cells).alias("width"), F.max(odd).alias("odd")).first()
        if not row.odd:
            return row.width or 1, False

    def widest(batches):
        import csv as reader
        import io

        import pyarrow as pa

        reader.field_size_limit(1 << 31)
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = reader.reader(io.StringIO(content.decode(enc, errors="replace"), newline=""), delimiter=d)
                yield pa.RecordBatch.from_arrays([pa.array([max(map(len, rows), default=1)], pa.int32())], names=["width"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(widest, "width int")
    return found.agg(F.max("width")).first()[0] or 1, True


def csv(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Delimited files; the delimiter and the encoding are found out. Every cell is text; quotes may hold line ends."""
    head = first_bytes(spark, path)
    d, enc = sniff_delimiter(decoded(head)) or ",", sniff_encoding(head)
    width, over_lines = csv_shape(spark, path, d, enc)
    schema = ", ".join(f"c{k} string" for k in range(width + 8))
    raw = spark.read.csv(path, sep=d, header=False, multiLine=over_lines, quote='"', escape='"', mode="PERMISSIVE", schema=schema, encoding=spark_encoding(enc), maxCharsPerColumn=-1, maxColumns=width + 9)
    cells = F.array(*[as_read(F.col(c), enc) for c in raw.columns[:width]])
    rows = raw.select(F.monotonically_increasing_id().alias("line_no"), cells.alias("cells")).where(_filled("cells"))
    return grid(rows, headers)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (rising), line of a text file in any encoding; a file in one that Spark splits is many tasks."""
    enc = sniff_encoding(first_bytes(spark, path))
    if enc == "UTF-8":
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), as_read(F.col("value"), enc).alias("line"))
    whole = spark.read.format("binaryFile").load(path).select(as_read(F.decode("content", spark_encoding(enc)), enc).alias("text"))
    text = F.regexp_replace("text", "\r\n?", "\n")
    return whole.select(F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def delimited(raw: DataFrame, d: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """A table from lines (line_no, line) with a delimiter."""
    cells = F.transform(F.split("line", "\\" + d if d == "|" else d), lambda x: F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"))
    return grid(raw.where(F.trim("line") != "").select("line_no", cells.alias("cells")), headers)


def fixed_width(raw: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """A table from aligned lines: two or more spaces part the cells; lines of one cell are left out."""
    cells = F.split(F.trim("line"), r"\s{2,}")
    return grid(raw.select("line_no", cells.alias("cells")).where(F.size("cells") >= 2), headers)


_PAIR = r"^\s*(?:[-*•]\s*)?([^:=]{2,60}?)\s*[:=]\s*(.*?)\s*$"


def key_values(blocks: DataFrame, least: int = 2) -> DataFrame:
    """block_no, pairs: the key-value pairs of text blocks (block_no, block); blocks of fewer pairs are left out."""
    rows = F.filter(F.split("block", "\n"), lambda x: x.rlike(_PAIR))
    pairs = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, _PAIR, 1).alias("key"), F.regexp_extract(x, _PAIR, 2).alias("value")))
    return blocks.select("block_no", pairs.alias("pairs")).where(F.size("pairs") >= least)


def pairs_to_table(pairs: DataFrame, names: list[str]) -> DataFrame:
    """A column for each name: a block's first value of it."""
    value = lambda n: F.get(F.transform(F.filter("pairs", lambda p: p["key"] == n), lambda p: p["value"]), 0)
    return pairs.select(F.col("block_no").cast("long").alias("line_no"), *[value(n).alias(n) for n in names])


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    enc = sniff_encoding(first_bytes(spark, path))
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_replace(as_read(F.decode("content", spark_encoding(enc)), enc), "\r\n?", "\n").alias("text"))
    return whole.select(F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("block_no", "block"))


def _names(pairs: DataFrame) -> list[str]:
    """Distinct keys in order of first appearance: a schema, so it comes to the driver."""
    seen = pairs.select("block_no", F.posexplode("pairs").alias("k", "p")).groupBy("p.key").agg(F.min(F.struct("block_no", "k")).alias("at"))
    return [r.key for r in seen.orderBy("at").collect()]


def blocks_as_tables(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None, peek: int = 200) -> DataFrame | None:
    """A text of several tables with a blank line between, each with its headers: standardised and stacked.

    A block of one line without known headers is a title; one of several lines, or fewer
    than two tables, means the text is something else (None). The first lines of ``peek``
    blocks come to the driver, which tell most other texts, then each different header."""
    from ..operators.standard import standardise

    def delimiter(top):
        d = sniff_delimiter("\n".join(top))
        return d if d and H.score([c.strip() for c in top[0].split(d)], headers) >= 2 else None

    blocks = blocks_of(spark, path).select("block_no", F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)
    several = blocks.where(F.size("lines") >= 2).withColumns({"head": F.get("lines", 0), "top": F.slice("lines", 1, 3)})
    first = several.orderBy("block_no").limit(peek).select("top").collect()
    if len(first) < 2 or not all(delimiter(r.top) for r in first):
        return None
    heads = several.groupBy("head").agg(F.min(F.struct("block_no", "top")).alias("at")).orderBy("at.block_no").collect()
    found = [(r.head, r["at"].block_no, delimiter(r["at"].top)) for r in heads]
    if not all(d for _, _, d in found):
        return None
    out = None
    for head, k, d in found:
        rows = several.where(F.col("head") == head).select("block_no", F.posexplode("lines").alias("pos", "line")).where((F.col("pos") > 0) | (F.col("block_no") == k))
        rows = rows.select((F.col("pos") + F.col("block_no") * F.lit(1 << 32)).alias("line_no"), "line")
        t = standardise(delimited(rows, d, headers), headers).df
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def table_groups(rows: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """page, row, cells of positioned text with ``group_no``: a table for each run under a header row.

    For readers of formats without tables of their own: a row of two known headers or more
    starts a group unless it repeats the group's headers, which are dropped; rows before
    any header and rows of another width than their group's headers are dropped. A column
    ``document`` keeps several documents apart."""
    known = sorted(H.known_names(headers))
    score = F.size(F.filter("cells", lambda x: H.squeezed_column(x).isin(known)))
    marked = rows.withColumn("is_header", score >= 2).withColumn("head", F.when(F.col("is_header"), F.array_join("cells", "\t")))
    place = Window.partitionBy(*[c for c in ("document",) if c in rows.columns]).orderBy("page", "row")  # one document's rows
    marked = marked.withColumn("before", F.last("head", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("starts", F.col("is_header") & ~F.coalesce(F.col("head") == F.col("before"), F.lit(False)))
    marked = marked.withColumns({"group_no": F.sum(F.col("starts").cast("int")).over(place), "width": F.last(F.when(F.col("starts"), F.size("cells")), ignorenulls=True).over(place)})
    return marked.where((F.col("group_no") > 0) & (F.col("starts") | ~F.col("is_header")) & (F.size("cells") == F.col("width"))).select(*[c for c in ("document",) if c in rows.columns], "page", "row", "group_no", "cells")


def text(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Plain text: delimited if its lines are, else key-value blocks, else aligned columns."""
    sample = decoded(first_bytes(spark, path))
    raw = lines(spark, path)
    first = [x for x in sample.splitlines() if x.strip()]
    tables = blocks_as_tables(spark, path, headers)
    if tables is not None:
        return tables
    d = sniff_delimiter(sample)
    if d and len(first) >= 2 and max((H.score([c.strip() for c in x.split(d)], headers) for x in first[:5]), default=0) > 0:
        return delimited(raw, d, headers)
    pairs = key_values(blocks_of(spark, path))
    names = _names(pairs)
    if len(names) >= 2 and H.score(names, headers) >= 2:
        return pairs_to_table(pairs, names)
    aligned = fixed_width(raw, headers)
    if H.score(aligned.columns[1:], headers) or not d:
        return aligned
    return delimited(raw, d, headers)


def ldif_entries(blocks: DataFrame) -> DataFrame:
    """block_no, pairs of LDIF entries: folded lines joined, comments out, userAccountControl as a status."""
    unfolded = blocks.select("block_no", F.regexp_replace("block", "\n ", "").alias("block"))
    rows = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^[\w;-]+::?\s*.*$"))

    def pair(x: Column) -> Column:
        k, v = F.regexp_extract(x, r"^([\w;-]+)::?\s*(.*?)\s*$", 1), F.regexp_extract(x, r"^([\w;-]+)::?\s*(.*?)\s*$", 2)
        bits = v.try_cast("long")
        told = F.when((F.lower(k) == "useraccountcontrol") & bits.isNotNull(), F.when(bits.bitwiseAND(F.lit(2)) != 0, "Disabled").otherwise("Active")).otherwise(v)
        return F.struct(k.alias("key"), told.alias("value"))

    return unfolded.select("block_no", F.transform(rows, pair).alias("pairs")).where(F.size("pairs") >= 1)


def ldif(spark: SparkSession, path: str, default_system: str = "Active Directory") -> DataFrame:
    pairs = ldif_entries(blocks_of(spark, path))
    out = pairs_to_table(pairs, _names(pairs))
    return out if "system" in out.columns else out.withColumn("system", F.lit(default_system))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs as columns joined by ``sep``; arrays and maps as JSON text; the rest as text."""
    from pyspark.sql import types as T

    out = []

    def walk(kind, path, name):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, path + [f.name], f"{name}{sep}{f.name}" if name else f.name)
        else:
            c = F.col(".".join(f"`{p}`" for p in path))
            out.append((F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else c.cast("string")).alias(name))

    walk(df.schema, [], "")
    return df.select(*out)


def _object_lines(sample: str) -> bool:
    """Whether the first line is an object and the second begins another."""
    from json import loads

    first = [x.strip() for x in sample.splitlines() if x.strip()][:2]
    try:
        return len(first) == 2 and first[1].startswith("{") and isinstance(loads(first[0]), dict)
    except ValueError:
        return False


def json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object that holds one under a usual key, a single object, or an object on each line; nested fields flattened."""
    from pyspark.sql import types as T

    head = first_bytes(spark, path)
    df = spark.read.json(path, multiLine=not _object_lines(decoded(head)), encoding=spark_encoding(sniff_encoding(head)))
    if "_corrupt_record" in df.columns:
        raise SourceError(f"{path} is not JSON")
    for k in LIST_KEYS:
        if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType) and isinstance(df.schema[k].dataType.elementType, T.StructType):
            df = df.select(F.inline(F.col(k)))
            break
    if not df.columns:
        raise SourceError(f"no records in {path}")
    return flatten(df).withColumn("line_no", F.monotonically_increasing_id())
