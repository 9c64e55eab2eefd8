"""Document fingerprints from spot signatures: word chains that follow common words.

Every common word (an anchor) of a text opens a chain of the next content words,
which are the words that are no anchors; a chain's hash is a signature, and the
sorted set of them is the fingerprint. Navigation, lists and tables hold few common
words, so prose decides. Sets are compared by Jaccard likeness. Two sets can only
be alike to a share ``s`` if their lengths are, so a search partitions sets by length, each
partition ``1 / s`` times as long as the one before, and looks in neighbouring ones only; there
two sets meet by the rarest signatures of each, of which they must share one, and the
rest is decided by exact counts. Equal sets are compared once and listed as members.

Only DataFrame functions are used.

Words are runs of letters, marks and digits in lower case. Defined cases: a null text
is an empty one; a text without a chain has a signature of each of its words, one without words a single
signature of its characters, so no set is empty and equal texts always have equal fingerprints;
repeated chains count once; rows with equal ids are ordered by text, rows without an id come last;
an empty table gives an empty table; columns besides id and text pass through ``fingerprints`` and are ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import ordered_id, packed, stage, text_of, unpacked

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can for from had has have he her his if in is it its not of on or that the their they this to "
    "was we were which who will with would you "
    "als am auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich ihr im ist mit nach nicht oder sich sie sind und "
    "von war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et il je la le les mais ne nous on ou par pas plus pour qui que se son sur un une vous "
    "al como con del el ella los las lo más no para pero por se su sus una unos y"
).split()
CHAIN = 2  # content words of a chain
HEX = 15  # hexadecimal digits of a signature, which is a long
SLICE_ROWS, MAX_SLICES = 4096, 1024  # rows of an ordered slice, and how many slices there may be


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _hashed(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, HEX), 16, 10).cast("long")


def signatures(text: Column, *, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, never empty."""
    common = sorted(set(anchors))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")

    def chains(words: Column, anchored: Column, content: Column) -> Column:
        """The j-th anchor stands at p, so p - j content words come before it."""
        told = lambda p, j: F.concat_ws(" ", F.get(words, p), F.slice(content, p - j + 1, F.lit(chain)))
        return F.transform(F.filter(F.transform(anchored, lambda p, j: F.struct(p.alias("p"), j.alias("j"))), lambda a: a["p"] - a["j"] + chain <= F.size(content)), lambda a: told(a["p"], a["j"]))

    def found(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull())
        parts = F.struct(places.alias("anchored"), F.filter(words, lambda w: ~w.isin(common)).alias("content"))
        return _let(_let(parts, lambda p: chains(words, p["anchored"], p["content"])), lambda c: F.when(F.size(c) > 0, c).otherwise(whole(words)))

    def whole(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.transform(words, lambda w: F.concat(F.lit(" "), w))).otherwise(F.array(F.concat(F.lit("\n"), text)))

    return F.sort_array(F.array_distinct(F.transform(_let(words, found), _hashed)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints; equal ones need no counting."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def length_band(size: Column, least: float) -> Column:
    """Partitions by length: sets alike to ``least`` lie in the same band or in neighbours."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with their ``signatures``; a column of that name is replaced."""
    rows = docs.select(packed(docs).alias("row"), signatures(text_of(text_col)).alias("signatures"))
    return unpacked(rows, "row", docs.columns, signatures=F.col("signatures"))


def spot_search(queries: DataFrame, docs: DataFrame, *, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(query_id, doc_id, likeness)``: all documents whose likeness to a query is ``least`` or more, itself included."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")

    def sets(df: DataFrame) -> DataFrame:
        return df.select(ordered_id(id_col).alias("did"), signatures(text_of(text_col)).alias("signatures")).withColumn(
            "print", F.sha2(F.concat_ws(",", F.col("signatures").cast("array<string>")).cast("binary"), 256)
        )

    asked, held = stage(sets(queries)), stage(sets(docs))
    apart = held.groupBy("print").agg(F.first("signatures").alias("signatures"))
    asked_sets = asked.groupBy("print").agg(F.first("signatures").alias("signatures"))
    rarity = stage(apart.select(F.explode("signatures").alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n")))

    def rarest(df: DataFrame, reach: list[int]) -> DataFrame:
        """A set's signatures that a set alike must share one of, in the bands that are within reach."""
        size, band = F.size("signatures"), length_band(F.size("signatures"), least)
        listed = df.select("print", size.alias("size"), F.explode("signatures").alias("signature")).join(rarity, "signature", "left")
        order = Window.partitionBy("print").orderBy(F.coalesce("n", F.lit(0)), "signature")
        kept = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
        bands = F.explode(F.array(*[length_band(F.col("size"), least) + step for step in reach])).alias("band")
        return kept.select("print", "size", "signature", bands)

    left = rarest(asked_sets, [-1, 0, 1]).select("band", "signature", F.col("print").alias("a"), F.col("size").alias("size_a"))
    right = rarest(apart, [0]).select("band", "signature", F.col("print").alias("b"), F.col("size").alias("size_b"))
    met = left.join(right, ["band", "signature"]).filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9)
    pairs = met.select("a", "b").distinct()
    pairs = pairs.join(asked_sets.select(F.col("print").alias("a"), F.col("signatures").alias("sa")), "a")
    pairs = pairs.join(apart.select(F.col("print").alias("b"), F.col("signatures").alias("sb")), "b")
    alike = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= least)
    return (
        alike.join(asked.select(F.col("print").alias("a"), F.col("did").alias("query_id")), "a")
        .join(held.select(F.col("print").alias("b"), "did"), "b")
        .select("query_id", F.col("did").alias("doc_id"), "likeness")
    )


def beside_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(did, text, signatures, next_text, next_signatures)``: each document with the next by id, the last with the first.

    Ids are cut into slices at percentiles, each document goes to its slice, and the first of a
    slice also to the slice before, as what follows there: one exchange of texts, and no sort of all rows in one task.
    """
    ids = docs.select(ordered_id(id_col).alias("did"))
    n = min(MAX_SLICES, max(1, ids.count() // SLICE_ROWS))
    cuts = []
    if n > 1:
        share = F.array(*[F.lit(i / n) for i in range(1, n)])
        cuts = sorted(set(ids.agg(F.percentile_approx("did", share, F.lit(10 * MAX_SLICES)).alias("p")).head().p))
    slice_of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("did"))) if cuts else F.lit(0)
    # At most MAX_SLICES rows; a slice without documents has none.
    firsts = sorted((r.slice, r.first) for r in ids.groupBy(slice_of.alias("slice")).agg(F.min("did").alias("first")).collect())
    before = [(first, firsts[i - 1][0], i == 0) for i, (_, first) in enumerate(firsts)]
    opening = F.broadcast(docs.sparkSession.createDataFrame(before, "did long, before int, wraps boolean"))
    text = text_of(text_col)
    rows = docs.select(ordered_id(id_col).alias("did"), text.alias("text"), signatures(text).alias("signatures")).join(opening, "did", "left")
    own = F.struct(slice_of.alias("slice"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("slice"), F.lit(True).alias("guest"))
    sent = rows.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("to.slice").orderBy("to.guest", "did", "text")
    follows = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    return sent.select("*", follows("text"), follows("signatures")).filter("NOT to.guest").select(
        "did", "text", "signatures", "next_text", "next_signatures"
    )
