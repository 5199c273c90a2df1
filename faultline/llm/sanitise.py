"""Personal data: fixed patterns, and terms that reveal them, by DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each value found is a
protected entity. Terms that stand near an entity are counted over the whole corpus, and a term's
disclosure of an entity is pointwise mutual information divided by the entity's information
content: 1 where every document with the term has the entity beside it. Terms at or above the
threshold are marked wherever they occur and generalised (numbers) or removed (words).

Copies of a text say nothing new: a term needs `support` different whole texts beside an entity,
where texts that differ only in their numbers are one. Near copies that differ in a word are texts
of their own, and texts may surround an entity with the same words. Null and empty texts have no
spans. Offsets are code points; ends are exclusive. Repeated rows are found like any other and
count as one document each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the contract, written so that a Java matcher takes linear time and a fixed stack:
# runs start where they begin or right after a match, and repeated groups consume one character.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])"
    r"(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A cheap test that every text with a match passes.
_NEEDS = {EMAIL: "@", IP: ".", CARD: None, PHONE: "+"}
#: Words of letters and digits of any script; those of 3 to 40 code points can be terms.
_WORD = r"[\p{L}\p{N}]+"
_WORD_BREAKS = r"[^\p{L}\p{N}]+"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of a pattern: the texts between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    at = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(
            end.alias("pos"),
            F.when(valid(pair["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    spans = F.aggregate(pairs, at, step, lambda state: state["spans"])
    needs = _NEEDS[pattern]
    there = text.contains(needs) if needs else text.rlike("[0-9]")
    return F.when(there, spans).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    # Long parts are no numbers that fit; leading zeros are allowed.
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def _is_card(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))


def pattern_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and kind."""
    return F.array_sort(F.concat(
        _matches(text, EMAIL, 0, lambda v: F.lit(True)),
        _matches(text, IP, 1, _is_ip),
        _matches(text, CARD, 2, _is_card),
        _matches(text, PHONE, 3, lambda v: F.length(_digits(v)).between(9, 15)),
    ))


def _term_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD_BREAKS), lambda w: F.length(w).between(3, 40))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, the text's hash and the text; both together name a document, equal rows alike."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("hash"), body.alias("body"))


def _surroundings(window: int) -> Column:
    """For each span of `base`: the words within `window` characters of it. Cut words are left out."""
    def words(span: Column) -> Column:
        start = F.greatest(span["start"] - window, F.lit(0))
        left = F.substring("body", start + 1, span["start"] - start)
        left = F.when(start > 0, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
        right = F.regexp_replace(F.substring("body", span["end"] + 1, F.lit(window)) , r"\S*$", "")
        return F.struct(
            F.lower(span["value"]).alias("entity"),
            F.array_sort(F.array_distinct(F.concat(_term_words(left), _term_words(right)))).alias("words"),
        )

    return F.transform("base", words)


def _text_class(text: Column) -> Column:
    """Equal for copies of a text, also where numbers differ."""
    return F.xxhash64(F.regexp_replace(text, r"\p{N}+", "0"))


def disclosing_terms(slim: DataFrame, bodies: DataFrame, support: int, threshold: float) -> DataFrame:
    """(term) for the terms that reveal an entity.

    `slim` has doc_id, hash, class and around (entity, words); `bodies` the texts of the same documents.
    """
    near = slim.select("doc_id", "hash", "class", F.explode("around").alias("a")).select(
        "doc_id", "hash", "class", "a.entity", F.col("a.words").alias("words"))
    pairs = cut_lineage(
        near.select("doc_id", "hash", "class", "entity", F.explode("words").alias("term")).groupBy(
            "entity", "term"
        ).agg(
            F.count_distinct("class").alias("texts"),
            F.count_distinct(F.struct("doc_id", "hash")).alias("near"),
        ).where(F.col("texts") >= support),
        "pairs",
    )
    # Documents with each entity and with each term, over the whole corpus.
    with_entity = near.groupBy("entity").agg(F.count_distinct(F.struct("doc_id", "hash")).alias("n_entity"))
    with_term = bodies.select(F.explode(F.array_distinct(_term_words(F.col("body")))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("n_term"))
    total = F.lit(float(slim.count()))
    content = F.log2(total / F.col("n_entity"))
    joint = F.least("near", "n_term", "n_entity")
    mutual = F.log2(joint * total / (F.col("n_term") * F.col("n_entity")))
    return (
        pairs.join(with_entity, "entity").join(with_term, "term")
        .where((content > 0) & (mutual >= threshold * content))
        .select("term").distinct()
    )


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of a text that are among `terms` (lower case)."""
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    between = F.split(text, _WORD, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    at = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        known = F.array_contains(terms, F.lower(pair["value"]))
        return F.struct(end.alias("pos"),
                        F.when(known, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pairs, at, step, lambda state: state["spans"])


def _term_hits(bodies: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, hash, extra): the spans of disclosing terms in each text that has some."""
    words = bodies.select("doc_id", "hash", F.explode(F.array_distinct(_term_words(F.col("body")))).alias("term"))
    listed = words.join(terms, "term").groupBy("doc_id", "hash").agg(F.collect_set("term").alias("terms"))
    same = [F.col("b.doc_id").eqNullSafe(F.col("l.doc_id")), F.col("b.hash") == F.col("l.hash")]
    hit = bodies.alias("b").join(listed.alias("l"), same).select("b.doc_id", "b.hash", "b.body", "l.terms")
    return hit.groupBy("doc_id", "hash").agg(F.first("body").alias("body"), F.first("terms").alias("terms")).select(
        "doc_id", "hash", _term_spans(F.col("body"), F.col("terms")).alias("extra"))


def find_personal_data(
    docs: DataFrame, support: int = 2, threshold: float = 0.7, window: int = 60,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, hash, base (pattern spans) and spans (with terms) for every row of `docs`.

    A term needs `support` different texts beside an entity and `threshold` of its information.
    Term spans that overlap a pattern span are not added.
    """
    bodies = _keyed(docs, key, text)
    slim = cut_lineage(
        bodies.withColumn("base", pattern_spans(F.col("body")))
        .select("doc_id", "hash", "base", F.when(F.size("base") > 0, _text_class(F.col("body"))).alias("class"),
                _surroundings(window).alias("around")),
        "personal",
    )
    terms = disclosing_terms(slim, bodies, support, threshold)
    slim = slim.drop("around", "class")
    extra = _term_hits(bodies, cut_lineage(terms, "terms"))
    same = [F.col("s.doc_id").eqNullSafe(F.col("e.doc_id")), F.col("s.hash") == F.col("e.hash")]
    both = slim.alias("s").join(extra.alias("e"), same, "left").select("s.doc_id", "s.hash", "s.base", "e.extra")
    free = F.filter(F.coalesce("extra", F.array().cast(_SPAN)), lambda t: ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return both.select("doc_id", "hash", "base", F.array_sort(F.concat("base", free)).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every stretch of spans replaced: a kind's mark, numbers by [number], terms removed."""
    body = F.coalesce(text, F.lit(""))
    marks = F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]])
    at = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        mark = F.when(span["kind"] < 4, F.get(marks, span["kind"])).when(
            span["value"].rlike(r"^\p{N}+$"), F.lit("[number]")).otherwise(F.lit("[removed]"))
        gap = F.substring(body, state["pos"] + 1, span["start"] - state["pos"])
        fresh = span["start"] >= state["pos"]
        return F.struct(
            F.greatest(state["pos"], span["end"]).alias("pos"),
            F.when(fresh, F.concat(state["out"], gap, mark)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(spans, at, step, lambda s: F.concat(s["out"], F.substring(body, s["pos"] + 1, F.length(body))))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with personal data and disclosing terms generalised or removed; all columns stay."""
    found = find_personal_data(docs, key=key, text=text, **settings).where(F.size("spans") > 0)
    found = found.dropDuplicates(["doc_id", "hash"])
    same = [F.col(f"d.{key}").eqNullSafe(F.col("f.doc_id")),
            F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit(""))) == F.col("f.hash")]
    clean = F.when(F.col("f.spans").isNull(), F.col(f"d.{text}")).otherwise(
        sanitised(F.col(f"d.{text}"), F.col("f.spans")))
    columns = [clean.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(found.alias("f"), same, "left").select(*columns)


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
