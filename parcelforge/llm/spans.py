"""Spans of regular expressions in texts, as Spark expressions only.

A span is a struct (start, rank, end, kind, match) in code points, end exclusive, so that
sorting an array of spans sorts by start and then by the rank of the kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str) -> Column:
    """Texts of all leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, pattern: str, found: Column, kind: str, rank: int) -> Column:
    """Spans of ``found``, the matches of ``pattern``.

    Cutting the text at the same matches leaves the gaps between them; a match starts
    where the gaps and matches before it end. Texts without a match are not cut.
    """
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("match")))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), step["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), no_spans().alias("out")), add, lambda s: s["out"])
    return F.when(F.size(found) > 0, walked).otherwise(no_spans())


def digest_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row's text; rows with equal id and text share it, and so their spans."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.xxhash64(text).cast("string"), F.char_length(text).cast("string"))
