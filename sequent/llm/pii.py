"""Personal data: base patterns, and terms that reveal who is meant.

Base spans (email, ip, card, phone) are the protected entities.  A term is a run of three or more letters.  An entity
stands for itself, for its group (an email's domain, an address's network, a card's issuer, a phone's area) and for its
kind, so that entities that occur once are told by what they have in common.  Over all different texts, P(entity | term)
is the share of the term's texts that have the entity anywhere, smoothed by `prior` texts that have the entity as often
as any text has.  A term discloses an entity if that share and the information it gives about the entity,
log2 P(entity | term) / P(entity), reach their thresholds, and if it is no chance: were the term's n texts drawn at random,
so large a share q of them would have an entity that a share u of all texts has with a probability of 2^(-n KL(q, u)) at
most (Chernoff), and that times the number of pairs of terms and entities must not exceed `chance`.  Wherever such a
term stands, with or without the entity, it is a span of its own: it is generalised, or removed if its share reaches
`remove_at`.

Terms that stand in the same texts count as one, and entities as well: a text with very many of both, as a long log,
has few such classes, and only classes are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.llm.shared import sent_whole, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns (fixed values).  Written so that Java's engine scans a run of characters once: a match can only
#: start at a run's start or at the last match's end, which are the only places where the plain pattern can match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
WORDS_OF = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Bytes (as JSON) of the texts with spans that are sent whole to the documents; with more of them the documents are shuffled.
SENT = 64 << 20
#: Behind every place in a text.
END = (1 << 31) - 1
SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once however often it is used, and also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: int, op, block: int = 64) -> Column:
    """For each of some whole numbers, op over those before it, op being a sum, a minimum or a maximum.

    Arrays grow by copying, so they grow block by block: n numbers cost about 64 n + (n / 64)^2 / 2 copied ones.
    """
    lists = F.array().cast("array<array<int>>")

    def inside(part: Column) -> Column:
        begin = F.struct(F.lit(zero).alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, begin, lambda a, x: F.struct(op(a["total"], x).cast("int").alias("total"), F.array_append(a["before"], a["total"]).alias("before")))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: inside(F.slice(v, b * block + 1, F.lit(block))))
        step = lambda a, p: F.struct(op(a["total"], p["total"]).cast("int").alias("total"), F.array_append(a["lists"], F.transform(p["before"], lambda x: op(a["total"], x).cast("int"))).alias("lists"))
        done = F.aggregate(parts, F.struct(F.lit(zero).alias("total"), lists.alias("lists")), step, lambda a: F.flatten(a["lists"]))
        return F.when(F.size(v) > 0, done).otherwise(F.array().cast("array<int>"))

    return bound(values, whole)


def located(text: Column, pattern: str, value) -> Column:
    """(start, stop, value) of a pattern's leftmost non-overlapping matches, in code points; value: of a match's text."""
    def pairs(found: Column) -> Column:
        return F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), value(m).alias("value")))

    def placed(own: Column) -> Column:
        before = running(F.transform(own, lambda p: p["gap"] + p["size"]), 0, lambda a, x: a + x)
        return F.zip_with(own, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("stop"), p["value"].alias("value")))

    return bound(bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs), placed)


def spans_of(places: Column, rank: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), p["stop"].cast("int").alias("stop"), p["value"].alias("value")))


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans (start, rank, stop, value) of a pattern's leftmost non-overlapping matches."""
    return spans_of(located(text, pattern, lambda m: m), rank)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether digits pass the Luhn check."""
    n = F.length(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(value, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    def holds(kind: str):
        def test(s: Column) -> Column:
            if kind == "ip":
                return F.forall(F.split(s["value"], r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
            number = digits(s["value"])
            if kind == "card":
                return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
            return F.length(number).between(10, 15)

        return test

    parts = []
    for rank, kind in enumerate(KINDS[:4]):
        own = matches(text, PATTERNS[kind], rank)
        own = own if kind == "email" else F.filter(own, holds(kind))
        parts.append(F.when(text.rlike(HINTS[kind]), own).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def entities(span: Column) -> Column:
    """What a base span stands for: its value, its group and its kind, as hashes."""
    text, number = F.lower(span["value"]), digits(span["value"])
    value = F.when(span["rank"] >= 2, number).otherwise(text)
    group = F.when(span["rank"] == 0, F.regexp_replace(text, "^[^@]*@", "")).when(span["rank"] == 1, F.regexp_replace(text, r"\.[0-9]+$", ""))
    group = group.when(span["rank"] == 2, F.substring(number, 1, 6)).otherwise(F.substring(number, F.lit(1), F.length(number) - 7))
    return F.array(*(F.xxhash64(F.lit(level), span["rank"], name) for level, name in enumerate((value, group, F.lit("")))))


def words(keyed: DataFrame) -> DataFrame:
    """(h, g, term) for each different term of a text; keyed: h, g, text."""
    return keyed.select("h", "g", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))


def places(text: Column, base: Column, telling: Column) -> Column:
    """Spans of the telling terms (a map of term to what its span becomes) in a text, outside its base spans."""
    own = F.filter(located(text, TERM, lambda m: F.try_element_at(telling, F.lower(m))), lambda t: t["value"].isNotNull())

    def outside(spans: Column) -> Column:
        # A term is free if the base spans before it end before it begins, and the next one begins after it ends.
        ended = running(F.transform(spans, lambda s: F.when(s["rank"] < 4, s["stop"]).otherwise(0)), 0, F.greatest)
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["rank"] < 4, s["start"]).otherwise(END))
        begins = F.reverse(running(starts, END, F.least))
        free = F.zip_with(F.zip_with(spans, ended, lambda s, e: F.struct(s.alias("s"), (e <= s["start"]).alias("ok"))), begins, lambda x, b: F.when(x["ok"] & (b >= x["s"]["stop"]) & (x["s"]["rank"] == 4), x["s"]))
        return F.filter(free, lambda x: x.isNotNull())

    return bound(F.array_sort(F.concat(base, spans_of(own, 4))), outside)


def find(docs: DataFrame, share: float = 0.6, remove_at: float = 0.9, bits: float = 4.0, prior: float = 1.0, chance: float = 0.01) -> DataFrame:
    """(h, g, base, terms) for each distinct text of `docs` (text) that has a base span or a telling term; h and g hash the text.

    base and terms are arrays of (start, rank, stop, value) in code points, rank being the place in KINDS; a term's
    value is what its span becomes: [TERM] if it is generalised, nothing if it is removed.  Statistics count different
    texts, so that a rare word of a copied text tells nothing; repeated rows have one row.  Null and empty texts have no span, a very long text is
    read whole, and other columns are not read.  No rows: no rows.
    """
    keyed = docs.select(F.xxhash64("text").alias("h"), F.hash("text").alias("g"), "text")
    found = keyed.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    found = found.groupBy("h", "g").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    found = stored(found, "pii-base")
    own = words(found)
    once = keyed.groupBy("h", "g").agg(F.first("text").alias("text"))
    terms = words(once).groupBy("term").agg(F.count("*").alias("term_texts"))
    texts_of = (F.bit_xor(F.xxhash64("h", "g")).alias("x"), F.bit_xor(F.xxhash64("g", "h", F.lit(1))).alias("y"))  # a set of texts, as 128 bits
    held = own.groupBy("term").agg(F.count("*").alias("held"), *texts_of)
    # An entity that passes is in less than 2^-bits of the texts, and meets a term in no more texts than have any entity.
    least = share * (F.col("term_texts") + prior) - prior * 2.0**-bits - 1e-9
    likely = terms.join(held, "term").where((F.col("held") >= least) & (F.col("term_texts") > 1))
    likely = stored(likely.select("term", "term_texts", F.xxhash64("x", "y", "term_texts").alias("class")), "pii-likely")
    holders = found.select("h", "g", F.explode(F.array_distinct(F.flatten(F.transform("base", entities)))).alias("entity"))
    whole = stored(holders.groupBy("entity").agg(F.count("*").alias("entity_texts"), *texts_of).select("entity", "entity_texts", F.xxhash64("x", "y").alias("owner")), "pii-entities")
    owners = holders.join(whole.where("entity_texts > 1"), "entity").select("h", "g", "owner", "entity_texts").distinct()
    classes = own.join(likely, "term").select("h", "g", "class", "term_texts").distinct()
    met = classes.join(owners, ["h", "g"]).groupBy("owner", "class").agg(F.count("*").alias("together"), F.first("term_texts").alias("term_texts"), F.first("entity_texts").alias("entity_texts")).where(F.col("together") >= least)
    # Terms of one text and entities of one text cannot pass, so they are no tests.
    every = keyed.agg(F.count_distinct("h").alias("texts")).crossJoin(terms.agg(F.count_if(F.col("term_texts") > 1).alias("terms"))).crossJoin(whole.agg(F.count_if(F.col("entity_texts") > 1).alias("entities")))
    met = met.crossJoin(F.broadcast(every))  # one row
    usual, q = F.col("entity_texts") / F.col("texts"), F.col("together") / F.col("term_texts")
    p = (F.col("together") + prior * usual) / (F.col("term_texts") + prior)
    apart = q * F.log2(q / usual) + F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - usual))).otherwise(0.0)
    sure = (q > usual) & (F.col("term_texts") * apart >= F.log2(F.col("terms").cast("double") * F.col("entities") / chance))
    telling = met.where((p >= share) & (F.log2(p / usual) >= bits) & sure).groupBy("class").agg(F.min(F.when(p >= remove_at, "").otherwise(WORDS_OF["term"])).alias("value"))
    telling = likely.join(telling, "class").select("term", "value")
    telling = stored(telling, "pii-telling")
    hits = words(keyed).join(telling, "term").groupBy("h", "g").agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias("telling"))
    hits = stored(hits, "pii-hits")
    bases, none = found.select("h", "g", "base"), F.array().cast(SPAN)
    spans = keyed.join(hits, ["h", "g"]).groupBy("h", "g").agg(F.first("text").alias("text"), F.first("telling").alias("telling")).join(bases, ["h", "g"], "left")
    spans = spans.select("h", "g", places(F.col("text"), F.coalesce("base", none), F.col("telling")).alias("terms"))
    return bases.join(spans, ["h", "g"], "full").select("h", "g", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs (text) with `pii_base` and `pii_terms`, both empty where nothing is found; a null text has neither.

    Every other column stays as it is; columns that have these two names already are replaced.
    """
    found = stored(find(docs, **options).select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("base").alias("pii_base"), F.col("terms").alias("pii_terms")), "pii-spans")
    none = F.array().cast(SPAN)
    kept = [c for c in docs.columns if c not in ("pii_base", "pii_terms")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), F.xxhash64("text").alias("__h"), F.hash("text").alias("__g"))
    rows = rows.join(sent_whole(found, SENT), ["__h", "__g"], "left")  # found has a row for each different text
    return rows.select("__row.*", F.coalesce("pii_base", none).alias("pii_base"), F.coalesce("pii_terms", none).alias("pii_terms"))


def sanitised(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every span of column `text` replaced: base spans and generalised terms by a word for their kind, other terms by nothing.

    Of spans that overlap the first counts, of two with one start the first kind.  Null and empty texts stay, a text
    of any length is worked on whole, and repeated rows are rows of their own.  Other columns stay as they are,
    whatever their names.  No rows: no rows.
    """
    columns = docs.columns
    rows = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text}`").alias("text")), **options)
    words = F.array(*(F.lit(WORDS_OF[k]) for k in KINDS))
    spans = F.array_sort(F.concat("pii_base", "pii_terms"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        word = F.when(s["rank"] == 4, s["value"]).otherwise(F.get(words, s["rank"]))
        more = F.concat(a["parts"], F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), word))
        return F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), more.alias("parts"))).otherwise(a)

    clean = F.aggregate(spans, begin, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["at"] + 1, F.length("text"))))
    found = F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))
    return rows.select(*(found.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns))


def digest(docs: DataFrame, **options) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null, empty and blank texts have no span, and the hash of an empty string.  Repeated rows have rows of their
    own.  No rows: no rows.  Other columns are not read.
    """
    rows = with_spans(docs.select("doc_id", "text"), **options)
    ranks = F.transform("pii_base", lambda s: s["rank"])
    counts = [(F.size("pii_base") - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("pii_base", "pii_terms"))).alias("spans"))
