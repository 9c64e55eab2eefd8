"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches of rising doc_id.  The line hashes known so far lie
in *runs*: tables bucketed and sorted by hash.  A batch is reduced to one row
per hash, merge-joined with every run (the runs are neither shuffled nor moved)
and its unseen hashes become a new run of level 0; ``fanout`` runs of a level
are compacted into one of the next, so a batch meets only logarithmically many.

A hash met in an earlier batch loses its lines in this one; a hash new in this
batch keeps them in its smallest doc_id alone.  Lines go to the decision by
hash only, texts are read for hashing and once more for cutting.

Defined cases: a null or empty text is one empty line; a line whose key is
shorter than ``min_chars`` always stays; a line repeated inside one document
only stays; rows that share a doc_id are one document; rows without a doc_id are
together one document that sorts after all others; an empty table gives an empty
table; columns of the input pass through, ``n_lines`` and ``n_dropped`` replace
input columns of those names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import col, fresh_name, ordered_id, packed, staging_path, text_of, unpacked

BLANK = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z (only those) in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


@dataclass
class LineRuns:
    """Sorted runs of line hashes, by level, in the shared folder."""

    spark: SparkSession
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        # As many buckets as a shuffle has partitions: a batch that is grouped by hash lies as the runs do.
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, hashes: DataFrame) -> tuple[str, str]:
        name, path = fresh_name("line_run"), staging_path(self.spark)
        hashes.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name, path

    def _known(self, name: str) -> DataFrame:
        return self.spark.table(name).filter(~F.col("old")).select(*HASH)

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge-join one batch ``(h1, h2, owner, shared)`` with the runs and add its unseen hashes.

        Returns the batch with ``old``: whether an earlier batch had the hash.
        """
        old = F.lit(False)
        for i, name in enumerate(run for level in self.levels for run in level):
            keys = keys.join(self._known(name).withColumn(f"in_{i}", F.lit(True)), HASH, "left")
            old = old | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        name, path = self._save(keys.select(*HASH, "owner", "shared", old.alias("old")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()
        return self.spark.read.schema("h1 long, h2 long, owner long, shared boolean, old boolean").parquet(path)

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) < self.fanout:
                continue
            merged = self._known(self.levels[depth][0])
            for name in self.levels[depth][1:]:
                merged = merged.unionByName(self._known(name))
            run, _ = self._save(merged.repartition(self.buckets, *HASH).withColumn("old", F.lit(False)))
            self._forget(self.levels[depth])
            self.levels[depth] = []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(run)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = []


def _batch_cuts(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids between batches of about equal row counts."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    found = docs.select(F.percentile_approx("did", shares, 1000).alias("cuts")).first().cuts
    return sorted(set(found or []))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """The documents with repeated lines cut, and ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    # Rows that share an id but not a text are told apart by the text's hash.
    rows = docs.select(ordered_id(id_col).alias("did"), text_of(text_col).alias("text"), packed(docs, text_col).alias("row"))
    cuts = _batch_cuts(rows, batches)
    batch = sum((F.when(F.col("did") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    lines = rows.select(
        "did", F.xxhash64("text").alias("th"), batch.alias("batch"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keyed = lines.select("did", "th", "batch", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    log_path = staging_path(spark)
    keyed.select(
        "did", "th", "pos", "batch", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    ).write.partitionBy("batch").parquet(log_path)
    log = spark.read.schema("did long, th long, pos int, h1 long, h2 long, batch int").parquet(log_path)

    runs = LineRuns(spark, fanout)
    drop_path = staging_path(spark)
    for number in range(len(cuts) + 1):
        arrived = log.filter(F.col("batch") == number)
        first, last = F.min("did"), F.max("did")
        keys = arrived.groupBy(*HASH).agg(first.alias("owner"), (first < last).alias("shared"))
        contested = runs.add(keys).filter("old OR shared")
        (
            arrived.join(contested.select(*HASH, "owner", "old"), HASH)
            .filter("old OR did <> owner")
            .select("did", "th", "pos")
            .write.mode("append")
            .parquet(drop_path)
        )
    runs.close()

    gone = (
        spark.read.schema("did long, th long, pos int").parquet(drop_path)
        .groupBy("did", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    split = rows.select("did", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"), "row")
    joined = split.join(gone.hint("shuffle_hash"), ["did", "th"], "left")
    # array_except is a hash-set difference, so a text of many lines costs time in proportion.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(
        F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get(F.col("lines"), i))), "\n"
    )
    return unpacked(
        joined,
        "row",
        docs.columns,
        **{
            text_col: text,
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
        },
    )
