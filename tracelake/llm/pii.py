"""Personal data: patterns with checks, then information-theoretic sanitisation of what surrounds them.

Base spans are emails, IPv4 addresses, card and phone numbers. They are the protected entities. Over
the whole corpus, the words that stand near an entity are counted with it and on their own; a word
whose documents are mostly documents of one entity reveals that entity though the entity itself be
masked. For a word t near an entity e

    disclosure = documents with t near e / documents with t
    share = documents with e / documents
    information = documents with t * (d * log2(d / share) + (1 - d) * log2((1 - d) / (1 - share)))

with d the disclosure: the evidence in bits, over all documents of t, that they hold e more often than
documents do, however frequent e is. A word whose disclosure is above the share and over both thresholds, seen near e in at least ``LEAST_DOCS`` documents,
becomes a ``term`` span wherever it stands, in all documents, beside the entity or not. ``sanitised`` replaces spans: entities and words that surely
reveal one are removed (a mask stays), the others are generalised to their kind of word.

All of it is DataFrame functions. A pattern is located by putting marks around its matches and
cutting there: the pieces' lengths give the places. Possessive repeats and look-behinds that only
start at the start of a run keep matching linear, and matches equal those of the plain patterns.

Defined cases: null or empty texts have no spans. Repeated rows count as documents each and give
equal results. An empty table gives an empty result. Extra columns are ignored. Places are code
points, ends exclusive. Rows are told apart by their texts alone: a null or repeated ``doc_id`` is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import table, with_id_in, written

#: Code points on either side of an entity that count as near.
NEAR = 64
LEAST_DOCS = 2
DISCLOSURE = 0.5
SURE = 0.9
INFORMATION = 6.0

#: No character of a pattern; where a text has it, another of no pattern stands for it while matching.
_MARK, _OTHER = "￿", "￾"
_LOCAL = "A-Za-z0-9._%+-"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
_HINTS = {"email": "@", "ip": ".", "phone": "+"}
_SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string>"
_WORD = r"[\p{L}\p{N}]{3,}"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the matches of a pattern."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        grown = F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), end.alias("stop"), piece.alias("value"))))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), F.when(state["inside"], grown).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>").alias("found"))
    return F.aggregate(pieces, start, step, lambda s: s["found"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    good = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, stop, value>> of all base spans, kind after kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = []
    for kind in KINDS:
        hit = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){13}"))
        found.append(F.when(hit, _spans_of(kind, text)).otherwise(none))
    return F.coalesce(F.concat(*found), none)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    rank = lambda kind: F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), kind)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, spans, near): base spans of every text and the words near each, with their places; written once."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("spans", base_spans(text))

    def words(at: Column, n: Column) -> Column:
        piece = F.substring(text, (at + 1).cast("int"), n.cast("int"))
        return F.transform(located(piece, _WORD), lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + at).alias("start"), (w["stop"] + at).alias("stop")))

    def around(s: Column) -> Column:
        left = F.greatest(F.lit(0), s["start"] - NEAR)
        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.concat(words(left, s["start"] - left), words(s["stop"], F.lit(NEAR))).alias("words"))

    near = F.when(F.size("spans") > 0, F.transform("spans", around))
    return written(rows.select("doc_id", "text_key", "spans", near.alias("near")), "pii-entities")


def _words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def document_frequency(docs: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(term, term_docs) of these terms over all documents; other words are not shuffled where the terms are few."""
    words = docs.select(F.explode(_words_of(F.col(text_col))).alias("term")).join(terms, "term", "left_semi")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))


def evidence(disclosure: Column, share: Column, term_docs: Column) -> Column:
    """Bits by which a term's documents speak for its disclosure instead of the entity's share of all documents; 0 where it is not above that share."""
    rest = F.when(disclosure < 1, (1 - disclosure) * F.log2((1 - disclosure) / (1 - share))).otherwise(0.0)
    return F.when(disclosure > share, term_docs * (disclosure * F.log2(disclosure / share) + rest)).otherwise(0.0)


def revealing_terms(docs: DataFrame, entities: DataFrame, *, text_col: str = "text", least_docs: int = LEAST_DOCS, disclosure: float = DISCLOSURE, information: float = INFORMATION) -> DataFrame:
    """(term, disclosure) of the words that reveal an entity, by the entity that each reveals most."""
    total = docs.count()
    # a document is a row of entities; its mentions of one entity count once
    own = entities.where(F.col("near").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.explode("near").alias("m")).select("row", F.col("m.entity").alias("entity"), F.col("m.words").alias("words"))
    mentions = written(own, "pii-mentions")
    known = mentions.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs")).where(F.col("entity_docs") >= least_docs)
    placed = mentions.join(known, "entity").select("row", "entity", "entity_docs", F.explode("words.term").alias("term")).distinct()
    pairs = placed.groupBy("entity", "term").agg(F.first("entity_docs").alias("entity_docs"), F.count(F.lit(1)).alias("together")).where(F.col("together") >= least_docs)
    pairs = written(pairs, "pii-pairs")
    frequent = document_frequency(docs, written(pairs.select("term").distinct(), "pii-candidates"), text_col=text_col)
    scored = pairs.join(frequent, "term").withColumn("disclosure", F.least(F.lit(1.0), F.col("together") / F.col("term_docs"))).withColumn("information", evidence(F.col("disclosure"), F.col("entity_docs") / F.lit(float(total)), F.col("term_docs")))
    return scored.where((F.col("disclosure") >= disclosure) & (F.col("information") >= information)).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def term_places(docs: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(text_key, terms): the spans of the terms (term, disclosure) in every text that holds one, a row for each such text."""
    keyed = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    hits = written(keyed.select("text_key", F.explode(_words_of(F.col("text"))).alias("term")).join(terms, "term").groupBy("text_key", "term").agg(F.first("disclosure").alias("disclosure")), "pii-hits")
    texts = with_id_in(keyed, hits.select("text_key").distinct(), "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    pieces = F.split(F.regexp_replace(F.translate("text", _MARK, _OTHER), F.lit(_WORD), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    # every other piece is a word; its place is the length of what stands before it
    cut = texts.select("text_key", F.posexplode(pieces).alias("nth", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("text_key").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    words = cut.withColumn("start", before).where(F.col("nth") % 2 == 1).withColumn("term", F.lower("piece"))
    span = F.struct(F.lit("term").alias("kind"), F.col("start"), (F.col("start") + F.length("piece")).alias("stop"), F.when(F.col("disclosure") >= SURE, "removed").otherwise("generalised").alias("value"))
    return words.join(hits, ["text_key", "term"]).groupBy("text_key").agg(F.collect_list(span).alias("terms"))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, spans, terms): base spans and term spans, those apart from any base span, of every text."""
    entities = find_entities(docs, id_col=id_col, text_col=text_col)
    found = written(revealing_terms(docs, entities, text_col=text_col), "pii-terms")
    terms = term_places(docs, found, text_col=text_col)
    joined = entities.select("doc_id", "text_key", "spans").join(terms, "text_key", "left")
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return joined.select("doc_id", "text_key", "spans", F.coalesce(F.array_sort(apart), F.array().cast(f"array<{_SPAN}>")).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with entities and surely revealing words masked and other revealing words generalised."""
    found = find_personal_data(docs).select(F.col("text_key").alias("p_key"), F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))).alias("all")).dropDuplicates(["p_key"])
    rows = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    joined = rows.join(found, F.col("text_key") == F.col("p_key"), "left")

    def step(state: Column, s: Column) -> Column:
        mask = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "removed", F.lit("[...]")).otherwise(F.lit("[WORD]"))
        new = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), mask)
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(new, piece).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("all", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    return joined.select("doc_id", F.when(F.size("all") > 0, masked).otherwise(F.col("text")).alias("text"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of op9."""
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    plain = F.transform("terms", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), F.lit("").alias("value")))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", F.array_distinct(plain))).alias("spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))
