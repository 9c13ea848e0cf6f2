"""Which field a raw header means and which row holds the headers. Metadata of a few rows, on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import plain, ratio
from .text import fold, strip
from .vocab import HEADERS

IGNORED = "__ignored__"
INVERTED = "__inverted_bool"
_DATA = re.compile(r"^\d+$|^(null|n/a|na|none|-|nan)$|^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}|^[a-z]{3}\s+\d{1,2}\s+\d{4}", re.I)


def key(header) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_/-]", " ", str(header).strip().lower())).strip()


def squeezed(header) -> str:
    """A header's key without accents, brackets, spaces and a plural s."""
    text = plain(key(header)).replace("&", "and")
    text = re.sub(r"[()\s]", "", text)
    return text[:-1] if len(text) > 3 and text.endswith("s") else text


def squeezed_column(c) -> Column:
    """``squeezed`` of a column of headers."""
    text = F.regexp_replace(fold(F.lower(F.regexp_replace(strip(c), "['’]", ""))), r"[_/()\s-]", "")
    text = F.regexp_replace(text, "&", "and")
    return F.when((F.length(text) > 3) & text.endswith("s"), F.substring(text, 1, F.length(text) - 1)).otherwise(text)


def match(header, headers: dict[str, list[str]] | None = None, learned: dict[str, str] | None = None, threshold: float = 85.0) -> str | None:
    """The field of a header: as learned, by name (as ``squeezed``), else by likeness; None if there is none."""
    k = key(header)
    if learned and k in learned:
        return None if learned[k] == IGNORED else learned[k]
    known = headers or HEADERS
    for field, names in known.items():
        if any(squeezed(n) == squeezed(header) for n in names):
            return field
    best = max(((ratio(k, key(n)), -i, field) for i, (field, names) in enumerate(known.items()) for n in names), default=(0, 0, None))
    return best[2] if best[0] >= threshold else None


def known_names(headers: dict[str, list[str]] | None = None) -> set[str]:
    return {squeezed(n) for names in (headers or HEADERS).values() for n in names}


def score(cells, headers: dict[str, list[str]] | None = None) -> int:
    """How many cells are known headers."""
    known = known_names(headers)
    return sum(c is not None and squeezed(c) in known for c in cells)


def like_data(cells) -> bool:
    """Whether half of what a row holds looks like values."""
    filled = [str(c).strip() for c in cells if c is not None and str(c).strip()]
    return bool(filled) and 2 * sum(bool(_DATA.match(c)) for c in filled) >= len(filled)


def header_row(rows: list[list], headers: dict[str, list[str]] | None = None, scan: int = 15) -> int:
    """The best-scoring of the first rows that doesn't look like data; row 0 unless another clearly beats it."""
    scored = [(score(r, headers), -i) for i, r in enumerate(rows[:scan]) if not like_data(r)]
    if not scored:
        return 0
    best, at = max(scored)
    first = score(rows[0], headers)
    return 0 if best <= 0 or -at and best <= max(first, 2) else -at
