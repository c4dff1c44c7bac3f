"""Personal data: pattern spans, and terms that corpus co-occurrence shows to reveal who is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stage

#: Fixed patterns. Matches are leftmost and non-overlapping for each kind. They are written so that no start inside a
#: run that has failed is tried again and no repetition is backtracked into, so time is linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A whole chain of digits, each after at most one space or hyphen, that has 16 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Characters without which a text has no match.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Terms: runs of 3 to 41 letters, with apostrophes and hyphens inside and no digit beside.
TERM = r"(?<![\p{L}\p{N}])\p{L}(?:['’-]?\p{L}){2,40}+(?!['’-]?\p{L}|\p{N})"

#: Secrets: runs of 20 to 200 letters, digits, hyphens and underscores that turn from digits to letters three times and
#: whose characters carry SECRET_BITS on average.
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,200}+(?![A-Za-z0-9_-])"
MIXED = r"(?:[0-9][A-Za-z_-]+[0-9_-]*){3}"
SECRET_BITS = 3.0

#: Texts that a term shares with an entity, and contexts (the terms before and after) that it has in them: at least these
#: and half as many contexts as texts. Near copies repeat a term's context, so the words of a group of them stay.
MIN_TEXTS, MIN_CONTEXTS = 3, 5
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: Tables of at most this many rows (under 200 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: The same for rows of two numbers.
BROADCAST_COPIES = 200_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def term(d: Column, i: Column) -> Column:
        twice = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return let(_digits(x), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + term(d, i)) % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Numbers that are summed one after the other; more are summed by blocks of so many.
RUN = 128


def running(numbers: Column) -> Column:
    """Sums of the numbers before each, for an array of any length: by blocks, so no array is copied for each number."""

    def plain(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def by_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, F.lit(RUN)))
        total = lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)
        moved = lambda bs: F.flatten(F.zip_with(bs, plain(F.transform(bs, total)), lambda b, at: F.transform(plain(b), lambda v: v + at)))
        return let(blocks, moved)

    return let(numbers, lambda x: F.when(F.size(x) <= RUN, plain(x)).otherwise(by_blocks(x)))


def find_spans(text: Column, kind: str, pattern: Column) -> Column:
    """Spans of a pattern in code points, end exclusive.

    The pieces that the pattern splits the text into and the matches alternate, so their lengths add up to positions.
    """

    def walk(gaps: Column, found: Column) -> Column:
        ends = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def span(begin: Column, i: Column) -> Column:
            start = begin + F.length(F.get(gaps, i))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value"))

        return F.transform(running(ends), span)

    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, 0)
    spans = let(gaps, lambda g: let(found, lambda m: walk(g, m)))
    may = F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else F.lit(True)
    return F.when(may & F.regexp_like(text, pattern), spans).otherwise(F.array()).cast(SPAN)


def base_spans(text: Column) -> Column:
    """All valid base spans, by kind as in KINDS, then start."""
    passing = lambda kind: lambda s: _valid(kind, s["value"])
    return F.concat(*(F.filter(find_spans(text, k, F.lit(p)), passing(k)) for k, p in KINDS.items()))


def _bits_per_character(x: Column) -> Column:
    """Shannon entropy of a string's characters."""

    def of(c: Column) -> Column:
        n = F.size(c).cast("double")
        share = lambda d: F.size(F.filter(c, lambda y: y == d)) / n
        return F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, d: a - share(d) * F.log2(share(d)))

    return let(F.split(x, "", -1), of)


def secret_spans(text: Column) -> Column:
    """Spans of keys and tokens, which have no pattern but are random: kind secret."""
    random = lambda s: s["value"].rlike(MIXED) & (_bits_per_character(s["value"]) >= SECRET_BITS)
    return F.filter(find_spans(text, "secret", F.lit(SECRET)), random)


def protected_spans(text: Column) -> Column:
    """Base spans, then secrets that overlap none of them."""
    return let(base_spans(text), lambda base: F.concat(base, F.filter(secret_spans(text), lambda s: _apart(base, s))))


def _apart(spans: Column, s: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _entities(spans: Column) -> Column:
    """What spans protect: their values, letters folded and numbers as digits; of mail addresses also the name before
    the @; and that the text holds something of their kind, which recurs where values don't."""

    def of(s: Column) -> Column:
        value = F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
        both = F.array(F.concat_ws(":", s["kind"], value), F.concat(F.lit("any:"), s["kind"]))
        return F.when(s["kind"] == "email", F.concat(both, F.array(F.concat(F.lit("name:"), F.substring_index(value, "@", 1))))).otherwise(both)

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def _terms(text: Column) -> Column:
    """A text's terms in order, without those in mail addresses."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(bare), F.lit(TERM), 0)


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def disclosing_terms(texts: DataFrame, seen: DataFrame, min_texts: int = MIN_TEXTS, min_contexts: int = MIN_CONTEXTS, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """Terms that reveal a protected entity, estimated over the whole corpus: text_hash, term, share, for every text that
    holds one, whether it holds the entity or not.

    texts has text_hash and text, seen has text_hash, text and spans (protected_spans()) of those with any. All counts
    are of distinct texts. With N texts, n(t), n(c) and n(t, c) having the term t, the entity c and both, a term's share
    of what there is to know about c is PMI(t, c) / IC(c) = log(n(t, c) N / (n(t) n(c))) / log(N / n(c)). It is 1 when t
    occurs in no text without c. Terms whose share is generalise_at or more are returned with their highest share, if
    they are in min_texts texts with c, and in min_contexts contexts there, half as many as texts.
    """
    n = F.lit(float(max(texts.select("text_hash").distinct().count(), 1)))
    held = seen.dropDuplicates(["text_hash"])
    entities = stage(held.select("text_hash", F.explode(_entities(F.col("spans"))).alias("entity")), "pii-entities")
    # An entity of fewer texts has no term in min_texts of them, so its texts' terms need not be paired with it.
    n_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity")).filter((F.col("n_entity") >= min_texts) & (F.col("n_entity") < n))
    entities = stage(entities.join(_bounded(stage(n_entity, "pii-counts")), "entity"), "pii-recurring")
    place = lambda t: lambda x, i: F.struct(x.alias("term"), F.xxhash64(F.coalesce(F.get(t, i - 1), F.lit("")), F.coalesce(F.get(t, i + 1), F.lit(""))).alias("context"))
    found = held.join(_bounded(entities.select("text_hash").distinct()), "text_hash")
    found = found.select("text_hash", F.explode(let(_terms(F.col("text")), lambda t: F.transform(t, place(t)))).alias("t"))
    beside = stage(found.select("text_hash", "t.term", "t.context").distinct(), "pii-beside")
    often = beside.groupBy("term").agg(F.count_distinct("text_hash").alias("texts"), F.count_distinct("context").alias("contexts"))
    often = stage(often.filter((F.col("texts") >= min_texts) & (F.col("contexts") >= min_contexts)).select("term"), "pii-often")
    both = beside.join(_bounded(often), "term").join(entities, "text_hash").groupBy("entity", "term").agg(F.count_distinct("text_hash").alias("n_both"), F.count_distinct("context").alias("contexts"), F.first("n_entity").alias("n_entity"))
    enough = (F.col("n_both") >= min_texts) & (F.col("contexts") >= min_contexts) & (2 * F.col("contexts") >= F.col("n_both"))
    # n(t) is n(t, c) at least and what texts with an entity have of it; a pair that can't reach its share goes here.
    reach = F.col("n_both") * F.pow(n / F.col("n_entity"), F.lit(1 - generalise_at))
    n_beside = beside.join(_bounded(often), "term").groupBy("term").agg(F.count_distinct("text_hash").alias("n_beside"))
    pairs = stage(both.filter(enough).join(n_beside, "term").filter(F.col("n_beside") <= reach * (1 + 1e-9)).drop("n_beside"), "pii-pairs")
    # Every copy of a text counts as its part of one, so counts add up where texts are read and few rows are shuffled.
    copies = stage(texts.groupBy("text_hash").agg(F.count("*").alias("copies")).filter("copies > 1"), "pii-copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    part = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    own = texts.join(copies, "text_hash", "left").select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"), part.alias("part"))
    n_term = own.groupBy("term").agg(F.round(F.sum("part")).alias("n_term"))
    told = F.log(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
    share = pairs.join(n_term, "term").withColumn("share", told / F.log(n / F.col("n_entity")))
    flagged = stage(share.filter(F.col("share") >= generalise_at).groupBy("term").agg(F.max("share").alias("share")), "pii-flagged")
    held = texts.select("text_hash", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    return held.join(_bounded(flagged), "term").select("text_hash", "term", "share").distinct()


def find_personal_data(docs: DataFrame, remove_at: float = REMOVE_AT, **options) -> DataFrame:
    """All spans of personal data in every whole text (null: empty), and the sanitised text.

    Returns row (a struct of the columns of docs, whatever their names), base and spans (arrays of kind, start, end,
    value; base kinds in their order, then secret, then term), and clean: spans become their kind's tag, but terms are
    removed from remove_at upwards and generalised to <NAME> or <WORD> below. Overlapping spans are replaced together, by
    the tag of the first. Secrets that overlap a base span, and terms that overlap either, are left to it. A null text
    stays null in clean.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash"))
    seen = stage(texts.withColumn("spans", protected_spans(F.col("text"))).filter(F.size("spans") > 0), "pii-seen")
    by_text = disclosing_terms(texts, seen, **options).groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))
    by_text = _bounded(stage(by_text, "pii-terms").withColumnRenamed("text_hash", "h"))
    own = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64(text).alias("text_hash")).join(by_text, F.col("text_hash") == F.col("h"), "left")
    told = lambda t: F.element_at("terms", F.lower(t["value"])).isNotNull() & _apart(F.col("protected"), t)
    spans = (
        own.withColumn("protected", protected_spans(F.col("text")))
        .withColumn("base", F.filter("protected", lambda s: s["kind"] != "secret"))
        .withColumn("found", F.when(F.col("terms").isNotNull(), F.filter(find_spans(F.col("text"), "term", F.lit(TERM)), told)).otherwise(F.array().cast(SPAN)))
        .withColumn("spans", F.concat("protected", "found"))
    )

    def tag(s: Column) -> Column:
        share = F.element_at("terms", F.lower(s["value"]))
        general = F.when(s["value"].rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(share >= remove_at, "").otherwise(general)

    def replace(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring("text", a["at"] + 1, s["start"] - a["at"]), tag(s))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", a["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate(ordered, first, replace, rest)).otherwise(F.col("row.text"))
    return spans.select("row", "base", "spans", clean.alias("clean"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
