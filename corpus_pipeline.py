"""From raw documents to token ids: five stages, each over all that the one before it kept.

1. quality classifier: documents that it rejects go;
2. line dedup: repeated lines are cut, every document stays;
3. n-gram Jaccard join: one document of each near-duplicate group stays;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. SentencePiece: texts become ids, which decode to the texts again.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes each result as Parquet into the shared folder and rereads it for the next.
Null and empty texts pass through as the operators define; columns that
``documents`` has besides the known ones are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import col, stage, table, tokenizer_model
from scorelake.llm.decontaminate import decontaminate
from scorelake.llm.jaccard_join import jaccard_join
from scorelake.llm.line_dedup import dedup_lines
from scorelake.llm.piece_bpe import encode_documents
from scorelake.llm.quality import fit_quality, score_quality


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _columns(score_quality(docs, trees).filter("predicted = 1"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _columns(dedup_lines(docs), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard_join(docs).filter("kept")
    alone, linked = kept.filter("n_links = 0"), kept.filter("n_links > 0")
    # Only rows alike in id and text can still stand for the same group.
    return _columns(alone.union(linked.dropDuplicates(["doc_id", "text"])), docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_documents(docs, tokenizer_model("piece_bpe_32k.model"))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", decoded)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("benchmark_decontamination", leaks),
    ("sentencepiece", tokens),
]

# No SQL can state the trees, the hashed joins or the tokenizer. Tests hold the operators alone against brute force, the
# library or held-out labels; of the stages they hold row counts, ids and a planted copy and leak only, not whole results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs)
    return docs
