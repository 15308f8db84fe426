"""Personal data: high-recall span candidates, gradient boosting, calibrated thresholds.

Base spans (email, ip, card, phone by their strict rules) are always reported. Beside
them, looser generators propose candidates, which may overlap; boosted trees score each
from its format and its context; a threshold for each generator, calibrated on texts kept
out of the fit, selects what is added. Of overlapping selected candidates the best stays,
and none that touches a base span.

There are no labels of personal data, so the trees learn from base spans rewritten into the
forms that only the looser generators find: ``user (at) host (dot) org``, ``10[.]0[.]0[.]7``,
dotted and 13-digit cards, phones without their sign. Each is planted in the place of its
base span, so it has a true context. Hard negatives are planted likewise: words around an
``(at)``, octets over 255, cards with a wrong check digit, phone-like numbers after words of
reference (``order no.``). Features hold for either form: sizes, groups, validity of the
digits, context. The threshold is the least score at which, on the kept-out texts, at least
``precision`` of the planted candidates of that generator are positive; a generator without
enough of them adds nothing. Planted texts serve the fit only: what is scored and added are
candidates of the texts as they are.

DataFrame operations only (the trees are Spark ML's; their fit takes at most ``max_rows``
planted candidates by hash order). Each text is read once; only candidates are shuffled.

Defined results: null and empty texts have no spans; rows with equal id and text get equal
spans; very long texts count whole; without base spans of a kind nothing of that kind is added;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import fold, table
from parcelforge.llm.spans import digest_text, matches, no_spans, placed, row_key
from parcelforge.session import materialize

# Possessive quantifiers keep long runs linear. Where a run of an email's first part isn't
# followed by a sign and a host, no later start in the run is either; so a match begins
# where the run does, or right after the last match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of digits, single blanks and hyphens between them, with the 14 digits that it needs.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = [("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]

#: Looser generators: name, pattern, and the base kind they stand for.
_AT = r"(?:\x20?(?:@|[(\[]at[)\]])\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20))"
_DOT = r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
_POINT = r"(?:[.:]|\[\.\]|\(\.\)|\x20?[(\[]dot[)\]]\x20?)"
LOOSE = [
    ("email_like", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,8}}+", "email"),
    ("ip_like", rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}+(?:{_POINT}[0-9]{{1,3}}+){{3}}+(?![0-9A-Za-z])", "ip"),
    ("card_like", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9A-Za-z])", "card"),
    ("phone_like", r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])", "phone"),
]
CONTEXT = 40
#: Words that go with a kind, and words before numbers that only refer to something.
CUES = {"email_like": "mail|contact|write|reach", "ip_like": "ip|host|server|address|addr", "card_like": "card|visa|account|pay", "phone_like": "phone|tel|call|fax|mobile|contact|reach"}
REFERENCE = ["order no. ", "part ", "ref ", "ISBN ", "version ", "id ", "item #", "serial "]
REFERS = r"(?i)(?:\bno\.?|\bnumber|\bpart|\bref|\bisbn|\bversion|\bid|#|\bserial|\border|\bitem)[\x20:.#]*$"
FEATURES = [
    "size", "digits", "letters", "groups", "valid", "first_part", "first_part_signs", "last_label", "starts_text",
    "blank_before", "blank_after", "digits_near", "signs_near", "cue_near", "refers", "upper_near", "generator",
]


def _luhn_sum(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    return _luhn_sum(_digits(match)) % 10 == 0


def _count(match: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(match, pattern, ""))


def _holds(kind: str, match: Column) -> Column:
    """What a match of a base kind must satisfy besides its pattern."""
    digits = _count(match, "[^0-9]")
    if kind == "ip":
        small = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(small, lambda p: F.when(F.char_length(p) <= 3, p).otherwise("999").cast("int") <= 255)
    if kind == "card":
        return (digits >= 14) & (digits <= 19) & _luhn(match)
    if kind == "phone":
        return (digits >= 10) & (digits <= 15)
    return F.lit(True)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, key, base, seen): sorted base spans, and base and loose spans each with the text around it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = [(k, p) for k, p in BASE] + [(k, p) for k, p, _ in LOOSE]
    text = F.col("text")
    rows = rows.select("doc_id", "text", *[matches(text, p).alias(k) for k, p in every])
    spans = {k: placed(text, p, F.col(k), k, rank) for rank, (k, p) in enumerate(every)}
    holding = lambda kind: lambda s: _holds(kind, s["match"])
    base = F.array_sort(F.concat(*[F.filter(spans[k], holding(k)) for k, _ in BASE]))
    loose = F.concat(*[spans[k] for k, _, _ in LOOSE])
    around = F.transform(F.concat(base, loose), lambda s: F.struct(
        s.alias("s"),
        F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).alias("left"),
        F.substring(text, s["end"] + 1, F.lit(CONTEXT)).alias("right"),
    ))
    return rows.select("doc_id", row_key(F.col("doc_id"), text).alias("key"), base.alias("base"), around.alias("seen"))


def _features(kind: Column, match: Column, left: Column, right: Column, at_start: Column) -> list[Column]:
    """The features of one candidate, alike for planted and natural ones."""
    near = F.concat(left, F.lit(" "), right)
    order = F.create_map(*[F.lit(x) for i, (g, _, _) in enumerate(LOOSE) for x in (g, float(i))])
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    first = F.regexp_extract(match, "^[A-Za-z0-9._%+-]+", 0)
    label = F.regexp_extract(match, "[A-Za-z]+$", 0)
    octets = F.filter(F.split(match, "[^0-9]+"), lambda x: x != "")
    digits = F.char_length(_digits(match))
    valid = (
        F.when(kind == "email_like", F.char_length(label) >= 2)
        .when(kind == "ip_like", F.forall(octets, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False))))
        .when(kind == "card_like", (digits >= 13) & (digits <= 19) & _luhn(match))
        .otherwise((digits >= 10) & (digits <= 15))
    )
    cue = F.lit(False)
    for generator, words in CUES.items():
        cue = cue | ((kind == generator) & near.rlike(rf"(?i)\b(?:{words})"))
    feature = {
        "size": F.char_length(match), "digits": digits, "letters": _count(match, "[^A-Za-z]"), "groups": F.size(F.split(match, "[^A-Za-z0-9]+")), "valid": flag(valid),
        "first_part": F.char_length(first), "first_part_signs": _count(first, "[^0-9._%+-]"), "last_label": F.char_length(label), "starts_text": flag(at_start),
        "blank_before": flag(left.rlike(r"(^|\s)$")), "blank_after": flag(right.rlike(r"^(\s|$)")), "digits_near": _count(near, "[^0-9]"),
        "signs_near": _count(near, r"[^|#$%&*=<>{}/\\_]"), "cue_near": flag(cue), "refers": flag(left.rlike(REFERS)), "upper_near": _count(near, "[^A-Z]"), "generator": order[kind],
    }
    return [feature[f].cast("double").alias(f) for f in FEATURES]


def candidates(scanned: DataFrame) -> DataFrame:
    """One row for each loose span that touches no base span: key, s, features."""
    apart = F.filter("seen", lambda c: c["s"]["kind"].isin([g for g, _, _ in LOOSE]) & ~F.exists("base", lambda b: (b["start"] < c["s"]["end"]) & (c["s"]["start"] < b["end"])))
    some = scanned.withColumn("apart", apart).filter(F.size("apart") > 0).dropDuplicates(["key"])
    c = some.select("key", F.explode("apart").alias("c")).select("key", "c.s", "c.left", "c.right")
    return c.select("key", "s", *_features(F.col("s.kind"), F.col("s.match"), F.col("left"), F.col("right"), F.col("s.start") == 0))


def planted(scanned: DataFrame) -> DataFrame:
    """(doc_id, key, s, label, features): base spans rewritten into loose forms (1), and decoys in their place (0)."""
    is_base = F.filter("seen", lambda c: c["s"]["kind"].isin([k for k, _ in BASE]))
    some = scanned.withColumn("own", is_base).filter(F.size("own") > 0).dropDuplicates(["key"])
    c = some.select("doc_id", "key", F.explode("own").alias("c")).select("doc_id", "key", "c.s", "c.left", "c.right")
    kind, m, left, right = F.col("s.kind"), F.col("s.match"), F.col("left"), F.col("right")
    replaced = lambda pattern, by: F.regexp_replace(m, pattern, by)
    made = lambda generator, text, label, before=left, after=right: F.struct(F.lit(generator).alias("stands"), text.alias("match"), before.alias("left"), after.alias("right"), F.lit(float(label)).alias("label"))
    user, host = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    word_before = F.regexp_extract(left, r"(\p{L}+)\W*$", 1)
    words_after = F.regexp_extract_all(right, F.lit(r"[A-Za-z]+"), F.lit(0))
    word = lambda i: F.coalesce(F.get(words_after, F.lit(i)), F.lit("then"))
    digits = _digits(m)
    broken = F.concat(F.substring(digits, F.lit(1), F.char_length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    stem = F.left(digits, F.lit(12))
    short = F.concat(stem, ((10 - _luhn_sum(F.concat(stem, F.lit("0"))) % 10) % 10).cast("string"))
    dotted = lambda d: F.regexp_replace(d, "^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]+)$", "$1.$2.$3.$4")
    refers = F.concat(F.left(left, F.lit(CONTEXT - 12)), F.lit(" "), F.get(F.array(*map(F.lit, REFERENCE)), F.pmod(F.xxhash64("key", "s.start"), F.lit(len(REFERENCE))).cast("int")))
    phones = [replaced(r"^\+", ""), replaced(r"^\+", "00"), F.regexp_replace(replaced(r"^\+[0-9]{1,3}\x20", ""), r"[()]", ""), F.regexp_replace(replaced(r"^\+", ""), r"\)?[\x20-]\(?", ".")]
    forms = {
        "email": [
            *[made("email_like", F.concat(user, F.lit(at), host), 1) for at in (" (at) ", "[at]", " @ ")],
            *[made("email_like", F.concat(user, F.lit(at), F.regexp_replace(host, r"\.", dot)), 1) for at, dot in ((" (at) ", " (dot) "), (" at ", " dot "), ("@", "[dot]"))],
            *[made("email_like", F.concat(word_before, F.lit(at), word(0), F.lit(dot), word(1)), 0) for at, dot in ((" (at) ", "."), ("[at]", "."), (" @ ", "."), (" at ", " dot "), (" (at) ", " (dot) "))],
        ],
        "ip": [*[made("ip_like", replaced(r"\.", by), 1) for by in ("[.]", "(.)", " [dot] ")], *[made("ip_like", F.regexp_replace(replaced("[0-9]+$", "777"), r"\.", by), 0) for by in (".", "[.]", "(.)")]],
        "card": [made("card_like", dotted(digits), 1), made("card_like", short, 1), made("card_like", dotted(short), 1), made("card_like", broken, 0), made("card_like", dotted(broken), 0), made("card_like", F.left(digits, F.lit(13)), 0)],
        "phone": [*[made("phone_like", p, 1) for p in phones], *[made("phone_like", p, 0, refers) for p in phones]],
    }
    every = F.lit(None)
    for k, made_ in forms.items():
        every = F.when(kind == k, F.array(*made_)).otherwise(every)
    rows = c.select("doc_id", "key", "s", F.posexplode(every).alias("form", "v")).select("doc_id", "key", "s", "form", "v.*")
    # what the generator wouldn't propose whole, or a wrong check digit that is right by chance, teaches nothing
    whole = F.lit(False)
    for generator, pattern, _ in LOOSE:
        whole = whole | ((F.col("stands") == generator) & F.col("match").rlike(f"^(?:{pattern})$"))
    rows = rows.filter(whole & ~((F.col("stands") == "card_like") & (F.col("label") == 0) & _luhn(F.col("match"))))
    return rows.select("doc_id", "key", "s", "form", "label", *_features(F.col("stands"), F.col("match"), F.col("left"), F.col("right"), F.col("s.start") == 0))


def thresholds(scored: DataFrame, precision: float, least: int = 20) -> dict[str, float]:
    """By generator: the least score from which on at least ``precision`` of the kept-out planted candidates are positive."""
    names = F.create_map(*[F.lit(x) for i, (g, _, _) in enumerate(LOOSE) for x in (float(i), g)])
    steps = scored.select(names[F.col("generator")].alias("kind"), F.floor(F.col("p") * 100).alias("step"), "label").groupBy("kind", "step").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()  # 101 rows a generator at most
    found: dict[str, float] = {}
    for kind, _, _ in LOOSE:
        n = good = 0.0
        for row in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            n, good = n + row.n, good + row.good
            if good < precision * n:
                break
            if good >= least:
                found[kind] = row.step / 100
    return found


def fit(scanned: DataFrame, precision: float = 0.95, max_rows: int = 20_000, trees: int = 20, depth: int = 4):
    """(trees, threshold by generator), fitted on planted candidates; None where they can't tell anything."""
    into = VectorAssembler(inputCols=FEATURES, outputCol="x")
    rows = materialize(into.transform(planted(scanned)).select("doc_id", "key", "s", "form", "label", "generator", "x"), "pii-planted")
    kept_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    known = rows.filter(~kept_out).orderBy(F.xxhash64("key", "s.start", "form"), "key", "s", "form").limit(max_rows)
    known = materialize(known.select("x", "label"), "pii-sample")
    if known.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=11).fit(known)
    held = model.transform(rows.filter(kept_out)).select("label", "generator", vector_to_array("probability")[1].alias("p"))
    cut = thresholds(held, precision)
    return (model, cut) if cut else None


def select(scanned: DataFrame, **how) -> DataFrame:
    """(key, added): candidates that pass their threshold, best of overlapping ones, none that touches a base span."""
    found = candidates(scanned)
    if (fitted := fit(scanned, **how)) is None:
        return found.limit(0).select("key", F.array("s").alias("added"))
    model, cut = fitted
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found).select("key", "s", "x")
    scored = model.transform(rows).select("key", "s", vector_to_array("probability")[1].alias("p"))
    bar = F.create_map(*[F.lit(x) for kind, p in cut.items() for x in (kind, p)])
    good = scored.filter(F.col("p") >= bar[F.col("s.kind")])
    # runs of overlapping candidates: a new one begins where none before reaches; of each run the best stays
    in_order = Window.partitionBy("key").orderBy("s.start", "s.end", "s.rank")
    reach = F.max("s.end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("s.start")).cast("int")).withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = runs.groupBy("key", "run").agg(F.max_by("s", F.struct("p", -F.col("s.start"), -F.col("s.rank"))).alias("s"))
    return best.groupBy("key").agg(F.collect_list("s").alias("added"))


def find(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, base, spans): sorted base spans and all reported spans of each text."""
    scanned = materialize(scan(documents), "pii")
    joined = scanned.join(select(scanned, **how), "key", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", no_spans()))).alias("spans"))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, _ in BASE], F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))
