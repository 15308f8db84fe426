"""Secret scans: strong patterns at once, weak ones only beside their complement.

A credential has parts: an access identifier, a secret and an endpoint. Assignments,
access identifiers and long hexadecimal runs (the base kinds) are reported wherever they
are. Three weaker kinds are only candidates: a temporary access identifier (``id``), a
bare secret of forty mixed characters (``key``) and an endpoint (``endpoint``). A candidate
is reported when a part of another role lies within ``scope`` code points of it, from the
end of one to the start of the other: every part is dealt into each bin of that width which
it covers and joined with the bins within reach of the candidate, so the join compares
neighbours only.

DataFrame operations only. Texts are read once and not shuffled; the join carries the rows
of texts that have a candidate.

Defined results: null and empty texts have no spans; rows with equal id and text get equal
spans; very long texts count whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import by_size, table
from parcelforge.llm.spans import digest_text, matches, no_spans, placed, row_key
from parcelforge.session import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The filters on the lengths of whole runs are part of these two patterns: a run that is
# too short from its first character is too short from any other.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: kind, pattern, role in a credential; hexadecimal runs have none.
BASE = [("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "")]
WEAK = [
    ("id", r"(?<![A-Za-z0-9])(?:ASIA|AGPA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])", "id"),
    ("key", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "secret"),
    ("endpoint", r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[A-Za-z0-9._~%/-]*+)?", "endpoint"),
]


def _spans(kinds: list[tuple[str, str, str]]) -> Column:
    """Sorted spans of these kinds in the column _text, whose matches are in a column for each kind."""
    ranks = {kind: rank for rank, (kind, _, _) in enumerate(BASE + WEAK)}
    spans = {kind: placed(F.col("_text"), pattern, F.col(f"_{kind}"), kind, ranks[kind]) for kind, pattern, _ in kinds}
    if "assign" in spans:
        spans["assign"] = F.filter(spans["assign"], lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)
    return F.array_sort(F.concat(*spans.values()))


def _matched(rows: DataFrame, text: Column, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """The rows with _text (null: empty) and the matches of each kind."""
    rows = rows.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    return rows.withColumns({f"_{kind}": matches(F.col("_text"), pattern) for kind, pattern, _ in kinds})


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, key, base, weak): sorted spans of each text."""
    rows = _matched(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("text"), BASE + WEAK)
    return rows.select("doc_id", row_key(F.col("doc_id"), F.col("_text")).alias("key"), _spans(BASE).alias("base"), _spans(WEAK).alias("weak"))


def link(scanned: DataFrame, scope: int = 400) -> DataFrame:
    """(key, added): the weak spans beside a part of another role."""
    some = scanned.filter(F.size("weak") > 0).dropDuplicates(["key"])
    role = F.create_map(*[F.lit(x) for kind, _, r in BASE + WEAK for x in (kind, r)])
    parts = some.select("key", F.explode(F.concat("base", "weak")).alias("s")).withColumn("role", role[F.col("s.kind")]).filter("role != ''")
    parts = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope))))
    weak = some.select("key", "base", F.explode("weak").alias("s")).withColumn("role", role[F.col("s.kind")])
    # what a base span already covers is no candidate
    weak = weak.filter(~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))).drop("base")
    # a part within reach covers a place from ``scope`` before the candidate to ``scope`` behind it
    weak = weak.withColumn("bin", F.explode(F.sequence(F.floor((F.col("s.start") - scope) / scope), F.floor((F.col("s.end") + scope) / scope))))
    w, p = weak.alias("w"), parts.alias("p")
    near = (F.col("p.s.start") - F.col("w.s.end") <= scope) & (F.col("w.s.start") - F.col("p.s.end") <= scope)
    linked = w.join(p, (F.col("w.key") == F.col("p.key")) & (F.col("w.bin") == F.col("p.bin")) & (F.col("w.role") != F.col("p.role")) & near, "left_semi")
    return linked.select("key", "s").distinct().groupBy("key").agg(F.collect_list("s").alias("added"))


def find(documents: DataFrame, scope: int = 400) -> DataFrame:
    """(doc_id, base, spans): sorted base spans and all reported spans of each text."""
    scanned = materialize(scan(documents), "secrets")
    joined = scanned.join(link(scanned, scope), "key", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", no_spans()))).alias("spans"))


def redact(documents: DataFrame, mark: str = "[secret]", scope: int = 400) -> DataFrame:
    """The documents with every reported span replaced by ``mark`` and n_chars, if there, counted anew.

    Base spans are cut where the text is read; only the linked spans of some texts are joined.
    The caller's columns travel inside a struct, so none of their names can clash.
    """
    added = materialize(link(materialize(scan(documents), "secrets"), scope), "linked").withColumnsRenamed({"key": "_key", "added": "_added"})
    rows = _matched(documents.select(F.struct("*").alias("row")), F.col("row.text"), BASE).withColumn("_key", row_key(F.col("row.doc_id").cast("long"), F.col("_text")))
    span_bytes = F.octet_length("_key") + F.aggregate("_added", F.lit(0).cast("long"), lambda n, s: n + 64 + F.octet_length(s["match"]))
    rows = rows.join(by_size(added, span_bytes), "_key", "left").withColumn("_spans", F.array_sort(F.concat(_spans(BASE), F.coalesce("_added", no_spans()))))

    def cut(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.lit(1 << 30))))
    rows = rows.withColumn("_clean", F.when(F.size("_spans") > 0, clean))
    old = F.col("row")
    new = {"text": F.coalesce(F.col("_clean"), old["text"])}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("_clean").isNotNull(), F.char_length("_clean")).otherwise(old["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, old[c]).alias(c) for c in documents.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))
