"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four fixed kinds.  Looser patterns of two classes (something with an @, seven digits or
more) give further candidates that no fixed kind has matched, accepted or refused.  The two words before a seed or
candidate, with its class, are a lexical pattern, the matched text an instance.  Patterns and instances form a
graph.  In rounds, a pattern's confidence in a kind is the mean score of its distinct instances, and
an instance that is no seed is scored by a noisy-or over its patterns.  Patterns that enough distinct seeds
support and that end above the threshold turn their other instances into spans of that kind.

Rounds join only what has a score so far, so the graph's other parts cost nothing.  The scored side of each
join is repeated over ``SPLIT`` parts of the other, so that one common pattern or instance is no task's load.

Patterns below are the given ones with possessive repeats and with look-behinds that keep a search
from starting inside a run it has already refused; they match the same spans in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._core import staged, text_of
from ._text import PIECE, between, found, let, pieces

KINDS = ("email", "ip", "card", "phone")
# Fixed values.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
IP_CHECK = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Classes of candidates: looser than the kinds, whose matches are of the class that CLASS names.
LOOSE = {
    "at": r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+",
    "digits": r"(?<![\p{L}\p{N}])(?<![0-9][().\x20-]{1,2})[+(]?[0-9](?:[().\x20-]{0,2}[0-9]){6,}+(?![\p{L}\p{N}])",
}
CLASS = {"email": "at", "ip": "digits", "card": "digits", "phone": "digits"}
CONTEXT_CHARS = 80
LEAST_DIGITS = 14
SPLIT = 16
SPANS = "array<struct<s:int,k:int,e:int>>"
MARKS = "array<struct<s:int,e:int,k:int,class:string,fixed:boolean,v:string,left:string>>"


def _passes(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(IP_CHECK)
    if kind == "card":
        return F.length(digits).between(LEAST_DIGITS, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _of_kind(k: int):
    return lambda x: x["k"] == k


def _mark(k: int | None, kind: str, fixed: bool):
    """A match as a mark: k numbers its kind if it passes the kind's test."""
    number = lambda x: F.lit(None).cast("int") if k is None else F.when(_passes(kind, x["v"]), k)
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), number(x).alias("k"), F.lit(CLASS.get(kind, kind)).alias("class"), F.lit(fixed).alias("fixed"), F.lower(x["v"]).alias("v"), x["left"].alias("left"))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, base, marks) of each row: base spans, and all matches of kinds and classes."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marks = []
    for k, kind in enumerate(KINDS):
        need = NEEDS.get(kind)
        got = found(F.col("text"), PATTERNS[kind], F.col("text").contains(need) if need else None, CONTEXT_CHARS)
        if kind == "card":  # shorter runs of digits are refused for their length, which says nothing of other kinds
            got = F.filter(got, lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", "")) >= LEAST_DIGITS)
        marks.append(F.transform(got, _mark(k, kind, True)))
    for name, need in (("at", F.col("text").contains("@")), ("digits", F.col("text").rlike("[0-9]"))):
        marks.append(F.transform(found(F.col("text"), LOOSE[name], need, CONTEXT_CHARS), _mark(None, name, False)))
    strip = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    both = lambda m: F.struct(F.array_sort(F.transform(F.filter(m, lambda x: x["k"].isNotNull()), strip)).cast(SPANS).alias("base"), m.cast(MARKS).alias("marks"))
    return rows.select("doc_id", "text_hash", let(F.concat(*marks), both).alias("m")).select("doc_id", "text_hash", "m.base", "m.marks")


def _uses(scanned: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, e, k, pattern, instance): seeds, with the number k of their kind, and candidates that meet no match of a kind."""
    rows = scanned.where(F.size("marks") > 0).select("doc_id", "text_hash", F.explode("marks").alias("t")).select("doc_id", "text_hash", "t.*")
    # a candidate meets a match that starts before its end and ends after its start
    order = W.partitionBy("doc_id", "text_hash").orderBy(F.when(F.col("fixed"), F.col("s")).otherwise(F.col("e")), "fixed").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("fixed"), F.col("e"))).over(order), F.lit(0))
    free = rows.withColumn("reach", reach).where(F.col("k").isNotNull() | (~F.col("fixed") & (F.col("reach") <= F.col("s"))))
    before = F.filter(F.split(F.lower("left"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    words = F.concat_ws(" ", F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), before), -2, 2))
    named = free.select("doc_id", "text_hash", "s", "e", "k", F.concat_ws("|", "class", words).alias("pattern"), F.xxhash64("class", "v").alias("instance"))
    return named.where(~F.col("pattern").endswith("|^ ^"))


def _split_join(rows: DataFrame, scored: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined to scored on key; the rows of one key are dealt over SPLIT tasks by their other column."""
    many = scored.withColumn("_part", F.explode(F.array(*[F.lit(k) for k in range(SPLIT)])))
    return rows.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(SPLIT)).cast("int")).join(many, [key, "_part"]).drop("_part")


def trusted_patterns(uses: DataFrame, rounds: int, support: int, threshold: float) -> DataFrame:
    """(pattern, kind) of the patterns that the rounds of scoring end up trusting."""
    links = staged(uses.groupBy("pattern", "instance").agg(F.max("k").alias("k")), "pii-links")
    size = links.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = links.where("k is not null").select("instance", F.col("k").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("seed")).distinct()
    scores = seeds
    for left in range(rounds, -1, -1):
        met = _split_join(links.select("pattern", "instance"), scores, "instance", "pattern")
        sums = met.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum("seed").alias("seeds"))
        patterns = staged(sums.join(size, "pattern").select("pattern", "kind", (F.col("sum") / F.col("n")).alias("confidence"), "seeds"), "pii-patterns")
        if left:
            known = _split_join(links.where("k is null").select("pattern", "instance"), patterns, "pattern", "instance")
            noisy = 1.0 - F.exp(F.sum(F.log(1.0 - F.least(F.lit(0.999), F.col("confidence")))))
            scores = seeds.unionByName(known.groupBy("instance", "kind").agg(noisy.alias("score")).withColumn("seed", F.lit(0)))
    best = F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best")
    good = patterns.where((F.col("confidence") >= threshold) & (F.col("seeds") >= support))
    return good.groupBy("pattern").agg(best).select("pattern", (-F.col("best.k")).alias("kind"))


def _discover(scanned: DataFrame, rounds: int, support: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, more): spans that high-confidence patterns add."""
    uses = staged(_uses(scanned), "pii-uses")
    trusted = trusted_patterns(uses, rounds, support, threshold)
    new = _split_join(uses.where("k is null"), trusted, "pattern", "text_hash")
    return new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("s", F.col("kind").alias("k"), "e"))).cast(SPANS).alias("more"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts.

    Returns one row per input row: doc_id, text_hash, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (all, as kind:start:end) and found (array of s, k, e; k numbers KINDS).
    Offsets are code points, ends exclusive.  Null text is empty: no spans, the digest of the empty
    string.  Rows with a null id and repeated rows keep their places.  Work is linear in a text's length
    and number of spans.  An empty table gives an empty table.  Columns of docs other than id and text are
    ignored, whatever their names.
    """
    scanned = staged(_scan(docs, id_col, text_col), "pii-scan")
    more = _discover(scanned, rounds, support, threshold).withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    rows = scanned.drop("marks").join(more, scanned.doc_id.eqNullSafe(F.col("m_id")) & (scanned.text_hash == F.col("m_hash")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    rows = rows.withColumn("found", every)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", "text_hash", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")


def mask_pii(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets and n_chars set anew; null text stays null.

    Spans that overlap are replaced together, by the kind of the first.  Columns, whatever their names, and row
    count stay; repeated rows are masked alike, an empty table stays empty."""
    key = ["m_id", "m_hash"]
    got = find_pii(docs, **settings).select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "found")
    spans = got.where(F.size("found") > 0).dropDuplicates(key).select(*key, F.explode("found").alias("x")).select(*key, "x.*")
    order = W.partitionBy(*key).orderBy("s", "k", "e").rowsBetween(W.unboundedPreceding, -1)
    cuts = spans.withColumn("at", F.coalesce(F.max("e").over(order), F.lit(0)))
    fresh = F.sort_array(F.collect_list(F.when(F.col("s") >= F.col("at"), F.struct("s", "at", "k"))))
    made = cuts.groupBy(*key).agg(fresh.alias("cuts"), F.max("e").alias("last"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = text_of(docs)
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("r_id"), F.xxhash64(text).alias("r_hash"), row)
    joined = keyed.join(made, keyed.r_id.eqNullSafe(made.m_id) & (keyed.r_hash == made.m_hash), "left")
    label = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)

    def masked(cut: Column) -> Column:
        parts = F.transform("cuts", lambda x: F.concat(between(cut, x["at"], x["s"]), label(x["k"])))
        return F.concat(F.array_join(parts, ""), between(cut, F.col("last"), F.lit(PIECE) * F.size(cut)))

    new = joined.withColumn("masked", F.when(F.col("cuts").isNotNull(), let(pieces(F.col("row.text")), masked)))
    changed = F.col("masked").isNotNull()
    values = {"text": F.when(changed, F.col("masked")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return new.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
