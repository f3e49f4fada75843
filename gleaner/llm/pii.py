"""Personal data: fixed patterns, and terms that give it away [native].

Found values (addresses, numbers) are protected entities. Over the whole corpus
it is counted how often a term stands near an entity and how often it occurs at
all. Both give the share of the entity's information that the term discloses:

    1 - log P(entity | term) / log P(entity)

which is 1 if the term occurs near that entity only and 0 if it says nothing.
Terms above a first threshold are generalised, above a second removed, wherever
they stand as whole words in any text. Context windows hold a bounded number of
words, so the pairs grow with the mentions, and all counts are sums that
pre-aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import apart, blank_spans, chunks, cut, find_spans, let, piece, replace_spans, text_of

#: Fixed values of the contract, possessive so that long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]

#: Code points of context on either side, and the two disclosure thresholds.
CONTEXT = 48
GENERALISE, REMOVE = 0.9, 0.97
#: Flagged terms that are sent to every task at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Terms are whole runs of letters, of so many letters.
RUN, LETTERS = r"\p{L}{4,}", (4, 40)
#: What a generalised term becomes: its class by list, else by its letters' case.
LISTS = {
    "MONTH": "january february march april may june july august september october november december",
    "DAY": "monday tuesday wednesday thursday friday saturday sunday",
    "TITLE": "mister miss doctor professor captain president director",
}
SHAPES = (("CODE", r"^\p{Lu}+$"), ("NAME", r"^\p{Lu}"))

TERM_SPANS = "array<struct<s:int,k:int,e:int,m:string,act:string,disclosure:double>>"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the check of the last digit."""
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text, unsorted."""
    long_enough = lambda m, low, high: F.char_length(_digits(m)).between(low, high)
    return F.concat(
        find_spans(text, EMAIL, 0),
        find_spans(text, IP, 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        find_spans(text, CARD, 2, lambda m: F.when(long_enough(m, 14, 19), luhn(m)).otherwise(F.lit(False))),
        find_spans(text, PHONE, 3, lambda m: long_enough(m, 10, 15)),
    )


def _in_size(term: Column) -> Column:
    return F.char_length(term).between(*LETTERS)


def _mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, near) of each row: sorted base spans, and for each its
    entity's hash with the text before and after it.

    Base spans are blanked there, so no part of one is a term, and words that the
    context's edge cuts are left out. Contexts come from chunks of the text: work
    and rows grow with the mentions, however many one text has.
    """
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.array_sort(base_spans(text)).alias("base"))

    def around(parts: Column, n: Column, x: Column) -> Column:
        a, b = F.greatest(x["s"] - CONTEXT, F.lit(0)), F.least(x["e"] + CONTEXT, n)
        left, right = piece(parts, a, x["s"]), piece(parts, x["e"], b)
        entity = F.xxhash64(F.concat_ws(":", x["k"].cast("string"), F.lower(x["m"])))
        return F.struct(
            entity.alias("entity"),
            F.concat(F.when(a > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left), F.lit(" "), F.when(b < n, F.regexp_replace(right, r"\p{L}+\z", "")).otherwise(right)).alias("words"),
        )

    whole = F.struct(chunks(blank_spans(F.col("text"), F.col("base"))).alias("parts"), F.char_length("text").alias("n"))
    near = let(whole, lambda w: F.transform("base", lambda x: around(w["parts"], w["n"], x)))
    none = F.expr("cast(array() as array<struct<entity:bigint,words:string>>)")
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.when(F.size("base") > 0, near).otherwise(none).alias("near"))


def _terms_in(words: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(words, F.lit(RUN), F.lit(0)), F.lower), _in_size)


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): occurrences of every term in the corpus."""
    return docs.select(F.explode(_terms_in(text_of(docs))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def _revealing(pairs: DataFrame, entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, disclosure, act) of the terms over the first threshold for some entity."""
    near = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    entities = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = terms.agg(F.sum("n_term")).first()[0] or 1
    known = near.join(terms, "term").join(entities, "entity")
    prior = F.least(F.lit(0.5), F.col("n_entity") / F.lit(float(total)))
    # One occurrence more that knows nothing: few mentions disclose less, and none are left out.
    given_term = F.least(F.lit(1.0), (F.col("n_pair") + prior) / (F.col("n_term") + 1))
    score = F.lit(1.0) - F.log2(given_term) / F.log2(prior)
    most = known.groupBy("term").agg(F.max(F.round(score, 9)).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return most.withColumn("act", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise"))


def _occurrences(docs: DataFrame, flagged: DataFrame, most_broadcast: int) -> DataFrame:
    """(__d, __t, terms) of the texts with a flagged term: the spans of all its whole words.

    Words with their offsets meet the flagged terms, which are broadcast up to
    ``most_broadcast`` of them; texts never move.
    """
    text = text_of(docs)
    words = F.filter(find_spans(text, RUN, 4), lambda y: _in_size(y["m"]))
    one = docs.select(docs["doc_id"].cast("long").alias("__d"), F.xxhash64(text).alias("__t"), F.explode(words).alias("y"))
    one = one.select("__d", "__t", F.col("y.s").alias("s"), F.col("y.e").alias("e"), F.col("y.m").alias("word"), F.lower("y.m").alias("term"))
    own = one.join(F.broadcast(flagged) if flagged.count() <= most_broadcast else flagged, "term")
    span = F.struct("s", F.lit(4).alias("k"), "e", F.col("word").alias("m"), "act", "disclosure")
    return own.groupBy("__d", "__t").agg(F.collect_set(span).alias("terms"))  # rows that repeat give each span once


def scan(docs: DataFrame, most_broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, text_hash, base, terms) of each row of ``docs``.

    ``base`` holds the spans of the fixed patterns, sorted, as struct<s,k,e,m>
    with ``k`` an index of KINDS. ``terms`` holds every occurrence of the
    revealing terms, in this text or found through others, sorted, as
    struct<s,k,e,m,act,disclosure> with ``act`` either 'generalise' or 'remove';
    those that touch a base span are left out. Null texts are empty, and so are
    the spans of texts without any. Very long texts and texts with very many
    spans take time in proportion. Every row gives one row, repeated ones too;
    an empty table gives none. Statistics cover all rows; other columns are not
    read.
    """
    found = cut(_mentions(docs), "pii-mentions")
    near = found.select(F.explode("near").alias("x")).select("x.entity", "x.words")
    pairs = near.select("entity", F.explode(_terms_in(F.col("words"))).alias("term"))
    terms = cut(_term_counts(docs), "pii-terms")
    flagged = cut(_revealing(pairs, near.select("entity"), terms), "pii-revealing")
    spans = _occurrences(docs, flagged, most_broadcast)
    out = found.join(spans, found["doc_id"].eqNullSafe(spans["__d"]) & (found["text_hash"] == spans["__t"]), "left")
    kept = F.when(F.col("terms").isNotNull(), apart(F.col("base"), F.col("terms")))
    return out.select("doc_id", "text_hash", "base", F.coalesce(kept, F.expr(f"cast(array() as {TERM_SPANS})")).alias("terms"))


def class_of(word: Column) -> Column:
    """The class that a generalised term becomes, such as NAME or MONTH."""
    out = F.lit("WORD")
    for name, pattern in reversed(SHAPES):
        out = F.when(word.rlike(pattern), name).otherwise(out)
    for name, listed in LISTS.items():
        out = F.when(F.lower(word).isin(listed.split()), name).otherwise(out)
    return out


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets,
    revealing terms by their class in brackets or by nothing; n_chars, if there,
    follows. Null texts, and those with nothing to replace, stay as they are, as
    do all other columns and rows."""
    hits = scan(docs).withColumn("terms", F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.when(x["act"] == "remove", "").otherwise(class_of(x["m"])).alias("m"))))
    hits = hits.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.array_sort(F.concat("base", "terms")).alias("__hits")).where(F.size("__hits") > 0).distinct()
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    mark = lambda x: F.when(x["k"] < 4, F.element_at(names, x["k"] + 1)).when(x["m"] == "", "").otherwise(F.concat(F.lit("["), x["m"], F.lit("]")))
    out = docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["__d"]) & (F.xxhash64(text_of(docs)) == hits["__t"]), "left")
    out = out.withColumn("text", F.when(F.col("__hits").isNotNull(), replace_spans(F.col("text"), F.col("__hits"), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__hits").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars").cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
