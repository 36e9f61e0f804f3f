"""Personal data: fixed formats, and terms that disclose the people behind them, in DataFrame functions only.

Formats. E-mail addresses, IPv4 addresses, card numbers and telephone numbers are found by patterns, leftmost and not
overlapping per kind. The patterns below accept what the plain ones accept, but start a run of characters only at its
beginning and never give characters back, so long runs cost linear time and no stack.

Terms. Every value found is a protected entity. For an entity e and a term t (a word outside the values found) of the
same document, corpus counts give the share of e's information that t reveals:

    disclosure = PMI(e; t) / IC(e) = 1 + log p(e | t) / log (N / n(e)),   p(e | t) = docs with t and e / docs with t

It is 1 for a term that occurs only with e, and falls as the term occurs elsewhere. Terms at or above `REMOVE` are
removed, those from `GENERALISE` on are replaced by a general label, wherever they stand: in the whole text of all
documents, those without the entity included, as that is where they disclose it.

Every pair is scored, with p(e | t) estimated for a document from the other ones and shrunk to p(e) = n(e) / N:

    p(e | t) = (pair - 1 + PRIOR * p(e)) / (documents with t - 1 + PRIOR)

Evidence is counted in independent documents. Copies and near copies say the same thing, and so do documents that share
a passage; such documents count as one. A document is told apart by the surroundings of e (`REACH` characters on both
sides) and by `SIGNS` min-hashes of its windows of three words, each of which near copies share nearly always. The pieces
of evidence of a set of documents are the smaller one of the number of different surroundings and of the numbers of
different values by min-hash, of which the fourth smallest is taken: near copies agree in most min-hashes, documents that share a
phrase only in few. A pair with one piece has no other that tells of it, so its estimate is at most p(e) and its disclosure at
most 0, whatever the size of the corpus. Such pairs, and those whose term is too frequent to reach `GENERALISE` with the
entity even if all its documents had the term, need no join to be known as too low: terms are cut by that bound first,
per document. Document counts cover the whole corpus and are pre-aggregated by task.

Texts are moved only where they hold a disclosing term. Each text is asked for such terms in the task that reads it:
`FILTER_WORDS` words of bits, one broadcast row, say which terms may be disclosing. Texts without one are done; of the others terms
meet the table of disclosing terms in a join, and their text goes along.

Cases. A null text is an empty one. Rows are recognised by doc_id and a hash of the text, null ids included, so
repeated rows get the same result. An empty table gives an empty result. Other columns are kept by `sanitised`, with
computed columns in structs of their own; n_chars is renewed where the table has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import ROW, packed, stored
from talusgrid.llm.quality import let

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{M}]*+"
KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "remove": ""}

REACH = 64
SIGNS = 16
#: Of the counts by min-hash, the one with so many below it counts: a phrase that unrelated documents share spoils few of them.
SPOILT = 3
SHINGLE = 3
#: Size of the bit table of disclosing terms, in 64-bit words.
FILTER_WORDS = 1 << 16
#: Weight of p(e) in p(e | t), in documents.
PRIOR = 0.5
GENERALISE = 0.8
REMOVE = 0.95

SPAN = "array<struct<start:int,end:int,value:string>>"
FOUND = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches in code points: lengths of the matches and of the pieces between them."""

    def placed(values: Column) -> Column:
        def step(done, i, pieces):
            start = done["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(values, i))
            one = F.array(F.struct(start.alias("start"), end.alias("end"), F.get(values, i).alias("value"))).cast(SPAN)
            return F.struct(end.alias("at"), F.concat(done["out"], one).alias("out"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        pieces = F.split(text, pattern, -1)
        spans = let(pieces, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), nothing, lambda done, i: step(done, i, p))["out"])
        return F.when(F.size(values) > 0, spans).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """(kind, start, end, value) of all four formats, by kind as listed, then by start."""
    text = F.coalesce(text, F.lit(""))
    address = "^" + r"\.".join([IP_PART] * 4) + "$"
    phone_digits = lambda x: F.length(_digits(x["value"]))
    rules = {
        "email": (text.contains("@"), EMAIL, lambda x: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["value"].rlike(address)),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), CARD, lambda x: F.call_function("luhn_check", _digits(x["value"]))),
        "phone": (text.contains("+"), PHONE, lambda x: phone_digits(x).between(8, 15)),
    }
    parts = []
    for kind, (maybe, pattern, holds) in rules.items():
        found = F.when(maybe, F.filter(matches(text, pattern), holds)).otherwise(F.array().cast(SPAN))
        parts.append(F.transform(found, _named(kind)).cast(FOUND))
    return F.concat(*parts)


def _entities(text: Column, spans: Column) -> Column:
    """Per span: its entity, and a hash of the text around it."""

    def around(x):
        value = F.when(x["kind"].isin("card", "phone"), _digits(x["value"])).otherwise(F.lower(x["value"]))
        context = F.concat(F.substring(text, F.greatest(x["start"] - REACH, F.lit(0)) + 1, F.least(x["start"], F.lit(REACH))), F.lit("\n"), F.substring(text, x["end"] + 1, REACH))
        return F.struct(F.concat(x["kind"], F.lit(":"), value).alias("entity"), F.xxhash64(context).alias("context"))

    return F.transform(spans, around)


def _free(text: Column, spans: Column) -> Column:
    """Text with its spans blanked, all places kept."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done, s):
        begin = F.greatest(done["at"], s["start"])
        piece = F.array(F.substring(text, done["at"] + 1, begin - done["at"]), F.repeat(F.lit(" "), s["end"] - begin))
        return F.when(s["end"] > done["at"], F.struct(s["end"].alias("at"), F.concat(done["out"], piece).alias("out"))).otherwise(done)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    blanked = F.aggregate(ordered, start, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, blanked).otherwise(text)


def _terms(free: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(free, F.lit(TERM), F.lit(0)), F.lower))


def _places(free: Column, scores: Column, remove: float) -> Column:
    """Spans of the terms that are keys of scores. Only they are put into arrays, so long texts cost linear time."""

    def placed(values: Column) -> Column:
        def step(done, i, pieces):
            start = done["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(values, i))
            term = F.lower(F.get(values, i))
            kind = F.when(F.element_at(scores, term) >= remove, F.lit("remove")).otherwise(F.lit("general"))
            one = F.array(F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), term.alias("value"))).cast(FOUND)
            return F.struct(end.alias("at"), F.when(F.map_contains_key(scores, term), F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
        return let(F.split(free, TERM, -1), lambda p: F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), nothing, lambda done, i: step(done, i, p))["out"])

    return let(F.regexp_extract_all(free, F.lit(TERM), F.lit(0)), placed)


def _once(value: Column) -> Column:
    """value as a generator's output: computed once per row, however often later columns and filters use it."""
    return F.explode(F.array(value))


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, free) of every row; free is its text without the values found."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = texts.select("doc_id", "text", _once(base_spans(F.col("text"))).alias("spans"))
    return spans.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "spans", _once(_free(F.col("text"), F.col("spans"))).alias("free"))


def _seeded(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _signs(free: Column) -> Column:
    """Min-hashes of a text's windows of SHINGLE words (of all its words, if there are fewer)."""

    def hashed(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(words) >= SHINGLE, windows).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))

    def least(windows: Column) -> Column:
        return F.array(*[F.array_min(F.transform(windows, _seeded(k))) for k in range(SIGNS)])

    words = F.transform(F.regexp_extract_all(free, F.lit(TERM), F.lit(0)), F.lower)
    return let(words, lambda words: let(hashed(words), least))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, near, terms, signs) of every row; rows without values have only spans."""
    some = F.size("spans") > 0
    near, terms, signs = _entities(F.col("text"), F.col("spans")), _terms(F.col("free")), _signs(F.col("free"))
    return _read(docs).select("doc_id", "text_hash", "spans", *[F.when(some, x).alias(n) for n, x in (("near", near), ("terms", terms), ("signs", signs))])


MARKS = ("context", *[f"sign{k}" for k in range(SIGNS)])


def _evidence() -> Column:
    """Independent documents among the rows of a group."""
    by_sign = F.sort_array(F.array(*[F.count_distinct(F.col(m)) for m in MARKS[1:]]))
    return F.least(F.count_distinct(F.col(MARKS[0])), F.get(by_sign, F.lit(SPOILT)))


def disclosures(docs: DataFrame, found: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of pairs at or above `generalise`, which is above 0."""
    rows = found.where("near is not null").select(F.struct("doc_id", "text_hash").alias("row"), "near", "terms", "signs")
    copies = rows.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    signs = [F.min(F.col("signs")[k]).alias(f"sign{k}") for k in range(SIGNS)]
    said = rows.select("row", "signs", F.explode("near").alias("x")).groupBy("row", "x.entity").agg(F.min("x.context").alias("context"), *signs).join(copies, "row")
    said = stored(said, "pii-said")
    entities = said.groupBy("entity").agg(F.sum("times").alias("n_entity"), _evidence().alias("evidence"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    # The highest count of a term that can still reach `generalise` with the entity; the 1 is for rounding.
    most = F.pow(F.col("n") / F.col("n_entity"), F.lit(1.0 - generalise)) * (F.col("evidence") - 1 + prior * F.col("n_entity") / F.col("n"))
    bound = F.col("n_entity") - F.col("evidence") + 2 - prior + most
    able = entities.where("evidence > 1").join(F.broadcast(total), F.lit(True)).select("entity", "n_entity", "n", bound.alias("bound"))  # one row
    lively = stored(said.join(able, "entity"), "pii-entities")
    counted = _read(docs).select(F.explode(_terms(F.col("free"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where("n_term > 1")
    reach = lively.groupBy("row").agg(F.max("bound").alias("row_bound"))
    words = rows.select("row", "terms").join(reach, "row").select("row", "row_bound", F.explode("terms").alias("term")).distinct()
    rare = words.join(counted, "term").where(F.col("n_term") <= F.col("row_bound")).select("row", "term", "n_term")
    both = lively.join(rare, "row").where(F.col("n_term") <= F.col("bound"))
    pairs = both.groupBy("entity", "term", "n_entity", "n_term", "n").agg(_evidence().alias("n_both"), F.sum("times").alias("docs_both"))
    return _scored(pairs, prior).where(F.col("disclosure") >= generalise)


def _scored(pairs: DataFrame, prior: float) -> DataFrame:
    """(entity, term, disclosure) of pairs with their counts."""
    others = F.greatest(F.col("n_term") - F.col("docs_both"), F.lit(0)) + F.col("n_both") - 1
    share = (F.col("n_both") - 1 + prior * F.col("n_entity") / F.col("n")) / (others + prior)
    information = F.log2(F.col("n") / F.col("n_entity"))
    return pairs.select("entity", "term", F.when(information > 0, 1 + F.log2(share) / information).alias("disclosure"))


def _bit(term: Column) -> tuple[Column, Column]:
    """Word and bit of a term in the bit table."""
    hashed = F.xxhash64(term)
    return F.pmod(hashed, F.lit(FILTER_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 40), F.lit(64)).cast("int"))


def _bits(disclosed: DataFrame) -> DataFrame:
    """One row: the bit table of disclosed(term), FILTER_WORDS long numbers."""
    word, bit = _bit(F.col("term"))
    marked = disclosed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = disclosed.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("word"))
    full = every.join(marked, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("__bits"))


def _placed_terms(rows: DataFrame, highest: DataFrame, remove: float) -> DataFrame:
    """rows(*, __text, spans) -> the same rows with `added`, the spans of the terms in highest(term, d).

    The rows that may hold one are gathered once per row after their terms have met the table; all others pass.
    """
    read = rows.withColumn("free", _once(_free(F.col("__text"), F.col("spans"))))
    # One row that takes part in the condition only, so no row carries it.
    bits = F.broadcast(stored(_bits(highest), "pii-bits"))
    may = F.exists(_terms(F.col("free")), lambda t: F.get(F.col("__bits"), _bit(t)[0]).bitwiseAND(_bit(t)[1]) != 0)
    none = F.array().cast(FOUND)
    rest = read.join(bits, may, "left_anti").select(*rows.columns, none.alias("added"))
    some = stored(read.join(bits, may, "left_semi").withColumn("__id", F.monotonically_increasing_id()), "pii-asked")
    hits = some.select("__id", F.explode(_terms(F.col("free"))).alias("term")).join(highest, "term")
    scores = hits.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("scores"))
    placed = some.join(scores, "__id", "left").select(
        *rows.columns, F.when(F.col("scores").isNotNull(), _places(F.col("free"), F.col("scores"), remove)).otherwise(none).alias("added")
    )
    return rest.unionByName(placed)


def _with_terms(rows: DataFrame, disclosed: DataFrame, remove: float) -> DataFrame:
    """rows(*, __text, spans) with all_spans: by kind as listed, then by start."""
    highest = stored(disclosed.groupBy("term").agg(F.max("disclosure").alias("d")), "pii-terms")
    if highest.isEmpty():
        return rows.withColumn("all_spans", F.col("spans"))
    parts = [F.filter("added", _of_kind(k)) for k in LABELS if k not in KINDS]
    return _placed_terms(rows, highest, remove).withColumn("all_spans", F.concat("spans", *parts)).drop("added")


def _texts_with_spans(docs: DataFrame, *kept) -> DataFrame:
    return docs.select(*kept, F.coalesce("text", F.lit("")).alias("__text")).withColumn("spans", _once(base_spans(F.col("__text"))))


def detected(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans, all_spans), one row per input row; spans by kind as listed, then by start."""
    found = stored(_found(docs).where(F.size("spans") > 0), "pii-found")
    disclosed = disclosures(docs, found, prior, generalise)
    return _with_terms(_texts_with_spans(docs, "doc_id"), disclosed, remove).select("doc_id", "spans", "all_spans")


def rewritten(text: Column, spans: Column) -> Column:
    """Text with its spans replaced by labels; a span that starts inside an earlier one is part of it."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done, s):
        piece = F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.element_at(label, s["kind"]))
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), F.concat(done["out"], piece).alias("out"))).otherwise(
            F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        )

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, start, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with personal data replaced in their texts. Texts with neither values nor disclosing terms are not changed.

    Only texts that may hold a disclosing term are shuffled.
    """
    found = stored(_found(docs).where(F.size("spans") > 0), "pii-found")
    rows = _with_terms(_texts_with_spans(docs, packed(docs)), disclosures(docs, found, prior, generalise), remove)
    done = rows.select(ROW, (F.size("all_spans") > 0).alias("touched"), "__text", "all_spans")
    done = done.select(ROW, "touched", _once(F.when(F.col("touched"), rewritten(F.col("__text"), F.col("all_spans"))).otherwise(F.col(f"{ROW}.text"))).alias("__new"))
    new = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("touched"), F.length("__new").cast("long")).otherwise(F.col(f"{ROW}.n_chars"))
    changed = [new[c].alias(c) if c in new else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return done.select(*changed)
