"""Spans of evidence: what a reader should be shown around a value."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed value: a span grows by whole lines up to this many characters.
MOST = 340
_SENTENCE_END = re.compile(r"[.;!?](?=\s|$)")


def evidence_span(text: str, start: int, end: int, is_table: bool) -> tuple[int, int]:
    """Bounds within a block's text of what to show around text[start:end].

    In tables and headings the line, or the whole block if it is short and its line ends no sentence. In prose the
    sentence, widened to whole lines; where that is too long, as many whole lines of it as fit, earlier ones first.
    """
    line = text.rfind("\n", 0, start) + 1, (text + "\n").find("\n", end)
    shown = text[line[0] : line[1]]
    if is_table or "|" in shown:
        whole = "\n" in text and len(text) <= MOST and not _SENTENCE_END.search(shown)
        return (0, len(text)) if whole else line
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    low = min(line[0], max((e for e in ends if e <= start), default=0))
    high = max(line[1], min((e for e in ends if e > end), default=len(text)))
    if high - low <= MOST:
        return low, high
    first, last = line
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    for at in reversed([i + 1 for i in breaks if low < i + 1 < first]):
        if last - at > MOST:
            break
        first = at
    for at in [i for i in breaks if last < i <= high]:
        if at - first > MOST:
            break
        last = at
    return first, last


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def evidence_bounds(text: pd.Series, start: pd.Series, end: pd.Series, is_table: pd.Series) -> pd.DataFrame:
    found = [evidence_span(t or "", int(a), int(b), bool(k)) for t, a, b, k in zip(text, start, end, is_table)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("int32")
