r"""Personal data: patterns, and information-theoretic sanitisation of what reveals them; DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card and telephone numbers. Each distinct match is a
protected entity. A term (a word of four letters or more) discloses an entity by their pointwise mutual
information over the corpus, relative to the entity's information content:

    disclosure(t, e) = log2(p(t, e) / (p(t) p(e))) / -log2(p(e))

which is 1 where the term occurs only with the entity. All three count documents, wherever in them the
term and the entity stand; words within base spans don't count. In documents that hold the entity, terms
from REMOVE on are removed and from GENERALISE on generalised. A pair needs SUPPORT different texts:
what was seen once, or in copies of one text, is no estimate.

The patterns are those of the base kinds written with possessive quantifiers and, for e-mail and IP,
with starts at the edge of a run only; that finds the same matches in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: The kinds in order, with their patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Candidate terms up to which they are broadcast.
BROADCAST_TERMS = 200_000

_TERM = r"\p{L}{4,}+"
_SPAN = "array<struct<start:int,end:int,s:string>>"


def _find(text: Column, pattern: str, maybe: Column) -> Column:
    """Matches of the pattern with their code-point positions, where maybe holds."""
    both = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("s")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(maybe, F.aggregate(both, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind: an array of (start, end, s) in code points, end exclusive; failing matches are dropped."""
    small = lambda x: F.forall(F.split(x["s"], r"\."), lambda p: F.coalesce((F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.ltrim(p, F.lit("0")).cast("int") <= 255) | (F.ltrim(p, F.lit("0")) == ""), F.lit(False)))
    digits = lambda x: F.regexp_replace(x["s"], "[^0-9]", "")
    return {
        "email": _find(text, EMAIL, text.contains("@")),
        "ip": F.filter(_find(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), small),
        "card": F.filter(_find(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: F.length(digits(x)).between(13, 19) & _luhn(digits(x))),
        "phone": F.filter(_find(text, PHONE, text.contains("+")), lambda x: F.length(digits(x)).between(9, 15)),
    }


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _marked(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind}]").alias("s")))


def _based(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, the four kinds, and of a document with entities these, its text and the text's digest."""
    t = F.coalesce(F.col(text), F.lit(""))
    spans = base_spans(F.col("t"))
    rows = docs.select(F.col(doc_id).alias("id"), t.alias("t")).select("id", "t", *(c.alias(k) for k, c in spans.items()))
    entities = F.array_distinct(F.transform(F.concat(*KINDS), lambda x: F.lower(x["s"])))
    some = F.size(F.concat(*KINDS)) > 0
    return rows.select("id", *KINDS, F.when(some, entities).alias("entities"), F.when(some, F.col("t")).alias("t"), F.when(some, F.sha2("t", 256)).alias("sha"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def disclosures(docs: DataFrame, based: DataFrame, text: str) -> DataFrame:
    """entity, term, disclosure of the pairs at GENERALISE or above."""
    words = _terms(F.regexp_replace("t", EMAIL, " "))  # the one kind that holds letters
    texts = based.where("entities is not null").select("sha", "entities", words.alias("words"))
    texts = texts.groupBy("sha").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    texts = checkpointed(texts.drop("sha"))
    often = lambda name: (F.sum("copies").alias(name), F.count(F.lit(1)).alias("texts"))
    each = checkpointed(texts.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(*often("n_entity")).where(F.col("texts") >= SUPPORT).drop("texts"))
    seen = texts.select(F.explode("entities").alias("entity"), "words", "copies").join(each.select("entity"), "entity")
    pairs = seen.select("entity", "copies", F.explode("words").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(*often("n_pair")).where(F.col("texts") >= SUPPORT).drop("texts")
    joint = checkpointed(joint.join(each, "entity"))
    terms = joint.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return joint.select("entity", "term", F.lit(0.0).alias("disclosure"))
    n = docs.count()
    words = docs.select(F.explode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    # All words are counted before they meet the terms, so common ones among these don't multiply rows
    # (an inner join with distinct terms: the optimiser would move a semi-join below the count).
    words = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    words = words.join(F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms, "term")
    got = joint.join(words, "term")
    info = -F.log2(F.col("n_entity") / n)
    pmi = F.log2(F.col("n_pair") * F.lit(float(n)) / (F.greatest("n_term", "n_pair") * F.col("n_entity")))
    return got.select("entity", "term", F.when(info > 0, pmi / info).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, email, ip, card, phone, term (arrays of spans; a term's s is its disclosure class) for every row.

    Null counts as empty; an empty text has no spans; an empty table gives an empty result; rows that
    repeat a doc_id each have the spans of their own text. Terms within base spans don't count. Columns
    besides doc_id and text are left out.
    """
    based = checkpointed(_based(docs, text, doc_id))
    told = checkpointed(disclosures(docs, based, text))
    none = F.array().cast(_SPAN)
    plain = based.select("id", *KINDS, none.alias("term"))
    if told.isEmpty():
        return plain
    held = based.where("entities is not null")
    per = held.select("sha", F.explode("entities").alias("entity")).distinct().join(told, "entity").groupBy("sha", "term").agg(F.max("disclosure").alias("d"))
    per = checkpointed(per.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("terms")))
    found = F.filter(_find(F.col("t"), _TERM, F.col("terms").isNotNull()), lambda x: F.map_contains_key("terms", F.lower(x["s"])))
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(F.element_at("terms", F.lower(x["s"])) >= REMOVE, "remove").otherwise("generalise").alias("s")))
    joined = held.join(per, "sha", "left").select("id", *KINDS, found.alias("found"))
    clear = F.filter(F.coalesce("found", none), lambda x: ~F.exists(F.concat(*KINDS), lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return plain.where(F.size(F.concat(*KINDS)) == 0).unionByName(joined.select("id", *KINDS, clear.alias("term")))


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from what find() gives."""
    base = F.concat_ws(",", F.concat(*(_listed(k, F.col(k)) for k in KINDS)))
    everything = F.concat_ws(",", F.concat(*(_listed(k, F.col(k)) for k in (*KINDS, "term"))))
    return found.select(F.col("id").alias(doc_id), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), everything.alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text with base spans replaced by their kind, disclosing terms generalised to [term] or removed.

    Needs doc_id to be unique.
    """
    found = find(docs, text, doc_id).where(F.size(F.concat(*KINDS)) > 0)
    marks = F.concat(*(_marked(k) for k in KINDS), F.transform("term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["s"] == "remove", "").otherwise("[term]").alias("s"))))
    spans = found.select(F.col("id").alias("marked_id"), F.array_sort(marks).alias("marks"))
    t = F.coalesce(F.col(text), F.lit(""))

    def put(acc: Column, m: Column) -> Column:
        gap = F.greatest(m["start"] - acc["at"], F.lit(0))
        take = m["end"] > acc["at"]
        piece = F.concat(acc["out"], F.substring(t, acc["at"] + 1, gap), m["s"])
        return F.struct(F.when(take, m["end"]).otherwise(acc["at"]).alias("at"), F.when(take, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return docs.join(spans, F.col(doc_id).eqNullSafe(F.col("marked_id")), "left").select(F.col(doc_id), F.when(F.col("marks").isNull(), t).otherwise(done).alias(text))
