"""Personal data, and terms that give it away: information-theoretic sanitisation.

Base spans follow four patterns (email, ip, card, phone).  Their values are the
protected entities.  Terms are the words of documents with an entity; over the whole corpus
it is counted in how many documents a term occurs (d), and in how many together
with the entity (c).  A term discloses the entity with a probability p that is
smoothed, so that it holds for rare entities too: p = (c + w * q * e / k) / (d + w),
where e documents have the entity, k any entity of its kind, and q is the probability
that the term stands with the kind, itself (ck + w * k / N) / (d + w).  Of N
documents, w (``weight``) is what the prior counts for.  With w = 1 and a share of
one half a term of one document counts if that document has the entity, and a
term of two documents if both have.  The term adds log2(p * N / e) bits.  One that
reaches both thresholds is a span of its own wherever it stands in a document that
has that entity.
Sanitised texts have entities replaced by their kind, a number-bearing term by
``<NUMBER>``, and other terms removed.

Words of one or two letters count only with a capital, a digit or a letter of a
script without capitals: the others ("at", "de") are particles and stay.

Only DataFrame functions are used.  A text's spans are found inside its row; what
is shuffled are the words of documents with entities and, for the counts, one row
for each word of a task.  Entities of one kind that stand in the same documents
are alike in all counts and are counted once, so a list of addresses doesn't meet
every word of its document for each address.

Defined cases: a null or empty text has no spans; positions are code points, end
exclusive; values are compared in lower case without blanks and separators;
a repeated row weighs in every count; rows without an id are told apart by text; an empty table gives an empty table; input columns pass through,
``spans`` and the sanitised text replace input columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ordered_id, packed, stage, text_of, unpacked

KINDS = ["email", "ip", "card", "phone"]
TERM_KIND = "term"
# The contract's patterns, so written that runs are never tried again from their middle and nothing recurses:
# an email starts where its run starts or where the email before ended; a card's chain is taken whole or not at all.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}\p{N}]{3,}+|(?=[\p{L}\p{M}\p{N}]?[\p{Lu}\p{Lt}\p{Lo}\p{N}])[\p{L}\p{M}\p{N}]{1,2}+"
CHUNK = 128  # matches or spans that are put together at a time, as arrays grow by copying

_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _chunks(array: Column) -> Column:
    """Numbers of the chunks of an array that has elements."""
    return F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int"))


def _chunk(array: Column, number: Column) -> Column:
    return F.slice(array, number * CHUNK + 1, F.lit(CHUNK))


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches in order with their places: gaps and matches alternate, so their lengths add up to places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), span["value"].alias("value"))

    def join(done: Column, chunk: Column) -> Column:
        spans = F.transform(chunk["spans"], lambda s: moved(s, done["at"]))
        return F.struct((done["at"] + chunk["at"]).alias("at"), F.concat(done["spans"], F.array(spans)).alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("spans"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("spans"))
    placed = lambda p: F.aggregate(
        F.transform(_chunks(p), lambda i: F.aggregate(_chunk(p, i), nothing, step)), none, join, lambda done: F.flatten(done["spans"])
    )
    return _let(pairs, lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(F.array().cast(_FOUND)))


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns by start, then kind; a cheap test keeps most texts from the full patterns."""
    email = _located(text, EMAIL, 0)
    ip = F.filter(_located(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.cast("double") <= 255))
    card = F.filter(_located(text, CARD, 2), lambda s: _luhn(s["value"]))
    phone = F.filter(_located(text, PHONE, 3), lambda s: F.char_length(_digits(s["value"])).between(9, 15))
    return F.array_sort(
        F.concat(
            _where(F.contains(text, F.lit("@")), email),
            _where(text.rlike(r"[0-9]\.[0-9]"), ip),
            _where(text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), card),
            _where(F.contains(text, F.lit("+")), phone),
        )
    )


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), F.lower(F.regexp_replace(span["value"], r"[ ()-]", "")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing_terms(docs: DataFrame, found: DataFrame, *, weight: float, min_share: float, min_bits: float) -> DataFrame:
    """``(did, th, term)`` of terms above the thresholds, counted over ``docs (text)`` and ``found (did, th, text, base, times)``."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    owned = found.select("did", "th", "times", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    kind = F.substring_index("entity", ":", 1).cast("int").alias("kind")
    kinds = owned.select("did", "th", "times", kind).distinct().groupBy("kind").agg(F.sum("times").alias("k"))
    # Entities of one kind and the same documents: a class.
    group = ["kind", "e", "these", "those"]
    classes = owned.groupBy("entity").agg(
        F.sum("times").alias("e"), F.bit_xor(F.xxhash64("did", "th")).alias("these"), F.bit_xor(F.xxhash64("th", "did", F.lit(1))).alias("those")
    )
    held = owned.join(classes, "entity").select("did", "th", kind, *group[1:]).distinct()

    of_kinds = (
        found.withColumn("kinds", F.array_distinct(F.transform("base", lambda s: s["kind"])))
        .select("times", "kinds", F.explode(_words(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(*[F.sum(F.when(F.array_contains("kinds", i), F.col("times")).otherwise(0)).alias(f"k{i}") for i in range(len(KINDS))])
    )
    # Words are summed up where they are read; only one row a word meets the candidates.
    spread = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    # No share can exceed (c + weight) / (d + weight), and c is at most e and at most the documents with term and kind.
    can = lambda c: c + weight >= min_share * (F.col("d") + weight)
    counts = [F.col(f"k{i}") for i in range(len(KINDS))]
    candidates = of_kinds.join(spread, "term").filter(can(F.greatest(*counts))).select("term", "d", F.array(*counts).alias("with"))
    pairs = stage(
        found.select("did", "th", "times", F.explode(_words(F.col("text"))).alias("term"))
        .join(candidates, "term")
        .join(held, ["did", "th"])
        .withColumn("ck", F.get("with", F.col("kind")))
        .drop("with")
        .join(F.broadcast(n))  # one row
        .filter(can(F.col("e")) & can(F.col("ck")) & (F.log2(F.col("n") / F.col("e")) >= min_bits))
    )
    of_kind = (F.col("ck") + weight * F.col("k") / F.col("n")) / (F.col("d") + weight)
    share = (F.col("c") + weight * of_kind * F.col("e") / F.col("k")) / (F.col("d") + weight)
    bits = F.log2(share * F.col("n") / F.col("e"))
    told = (
        pairs.groupBy(*group, "term", "d", "ck", "n").agg(F.sum("times").alias("c"))
        .join(F.broadcast(kinds), "kind")  # four rows
        .filter((share >= min_share) & (bits >= min_bits))
        .select(*group, "term")
    )
    return pairs.join(told, [*group, "term"]).select("did", "th", "term").distinct()


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with ``put(span, its text)`` for every span, of one at least; spans that overlap make one."""

    def step(done: Column, span: Column, window: Column, low: Column) -> Column:
        word = F.substring(window, span["start"] - low + 1, span["end"] - span["start"])
        between = F.substring(window, done["at"] - low + 1, span["start"] - done["at"])
        inside = span["start"] < done["at"]
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(inside, done["out"]).otherwise(F.concat(done["out"], F.array(between, put(span, word)))).alias("out"),
        )

    nothing = F.array().cast("array<string>")

    def chunk(done: Column, part: Column) -> Column:
        stop = F.greatest(done["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        own = lambda w: F.aggregate(part, F.struct(done["at"].alias("at"), nothing.alias("out")), lambda d, s: step(d, s, w, done["at"]))
        made = lambda m: F.struct(m["at"].alias("at"), F.concat(done["out"], F.array(F.array_join(m["out"], ""))).alias("out"))
        return _let(_let(F.substring(text, done["at"] + 1, stop - done["at"]), own), made)

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    rest = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))
    return F.aggregate(_chunks(spans), start, lambda done, i: _let(_chunk(spans, i), lambda part: chunk(done, part)), rest)


def _label(span: Column, word: Column) -> Column:
    put = F.when(span["kind"] == 4, F.when(word.rlike(r"\p{N}"), "<NUMBER>").otherwise(""))
    for kind, name in enumerate(KINDS):
        put = put.when(span["kind"] == kind, f"<{name.upper()}>")
    return put


def sanitise(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    weight: float = 1.0,
    min_share: float = 0.5,
    min_bits: float = 4.0,
) -> DataFrame:
    """The documents with their texts sanitised and ``spans`` ``(kind, start, end)`` of the original text."""
    rows = docs.select(ordered_id(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    # Texts with entities only: the others need no second look.
    found = stage(
        rows.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
        .groupBy("did", "th").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("times"))
    )
    told = stage(disclosing_terms(rows, found, weight=weight, min_share=min_share, min_bits=min_bits))
    # Entities are blanked, so that no term is found within one.
    blanked = _replaced(F.col("text"), F.col("base"), lambda span, _: F.repeat(F.lit(" "), span["end"] - span["start"]))
    places = found.join(told.select("did", "th").distinct(), ["did", "th"], "left_semi").withColumn("text", blanked)
    terms = (
        places.select("did", "th", F.explode(_located(F.col("text"), TERM, 4)).alias("t"))
        .select("did", "th", F.lower("t.value").alias("term"), F.struct("t.start", "t.kind", "t.end").alias("span"))
        .join(told, ["did", "th", "term"])
        .select("did", "th", "span")
    )
    base = found.select(
        "did", "th", F.explode(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("span")
    )
    spans = base.union(terms).groupBy("did", "th").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    joined = docs.select(
        ordered_id(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"),
        packed(docs, text_col).alias("row"),
    ).join(spans, ["did", "th"], "left")
    some = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    names = F.array(*[F.lit(k) for k in [*KINDS, TERM_KIND]])
    listed = F.transform(some, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("spans"), _label))
    return unpacked(joined, "row", docs.columns, **{text_col: text, "spans": listed})
