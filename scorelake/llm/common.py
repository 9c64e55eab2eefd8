"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.state import stage, staging_path

__all__ = ["LAST_ID", "col", "fresh_name", "ordered_id", "packed", "stage", "staging_path", "table", "text_of", "tokenizer_model", "unpacked"]

# A row without an id counts as this id, after all real ones.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model(name: str) -> bytes:
    """The content of an installed public tokenizer file (a few hundred kilobytes)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def ordered_id(name: str = "doc_id") -> Column:
    return F.coalesce(col(name).cast("long"), F.lit(LAST_ID))


def packed(df: DataFrame, *without: str) -> Column:
    """A row's columns as one struct, so helper columns beside it cannot clash with them."""
    kept = [c for c in df.columns if c not in without]
    return F.struct(*[col(c) for c in kept]) if kept else F.struct(F.lit(True).alias("_none"))


def unpacked(df: DataFrame, row: str, columns: list[str], **added: Column) -> DataFrame:
    """The packed columns again; an added column replaces a packed one of its name."""
    added = {a.lower(): (a, value) for a, value in added.items()}
    kept = [added.pop(c.lower())[1].alias(c) if c.lower() in added else F.col(row)[c].alias(c) for c in columns]
    return df.select(*kept, *[value.alias(a) for a, value in added.values()])


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"
