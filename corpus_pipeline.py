"""The corpus pipeline: five stages over documents, each by one operator.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; each is written as
Parquet and read again as the next one's documents.

1. quality: documents that the compression classifier rejects go.
2. near_copies: of each group the document with the smallest id stays; documents link
   by SimHash, or by a Jaccard similarity of 0.8 or more on five-word shingles.
3. secrets: strong spans and completed weak ones are replaced in the texts.
4. mixing: sources are brought to their target weights by repetitions.
5. tokens: texts become token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, mixing, quality, secrets, simhash
from folioscope.llm.common import Names, fold, read, scratch

#: SQL can't express compression, fingerprints or merges; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the threshold, as they are.

    Null and empty texts have the score of an empty text; equal texts stay or go together;
    rows without id are scored too; where labels of one class lack, all have one score,
    the share of label 1; an empty table stays empty; other columns pass through."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    n = Names(docs.columns)
    return quality.score(docs, model, into=(n.score, n.predicted)).where(F.col(n.predicted) == 1).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by SimHash, or by a Jaccard similarity of
    0.8 or more on five-word shingles.

    The smallest id stays, a row without id only in a group of such; equal rows leave one,
    rows equal but for other columns the one with the smallest hash of these; null and
    word-less texts are one group; an empty table stays empty; other columns pass through."""
    return simhash.keep_one(docs, alike=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret of the text replaced by its kind in brackets.

    Null texts stay null, empty ones empty; equal rows stay equal, each by itself; rows
    without id are redacted too; an empty table stays empty; other columns pass through,
    but for n_chars, which is counted again where a table has it."""
    return _counted(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, in part at its end.

    Null, empty and word-less texts are taken 0 times and go; a null source is a source;
    equal ids are ordered by size; an empty table stays empty; other columns are repeated
    with their rows, but for n_chars, as in redact_secrets."""
    return _counted(mixing.repeated(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens) of each document.

    Null and empty texts have no ids; equal rows have equal ones; a table without source
    gives none; an empty table stays empty; other columns go."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("source",))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        to = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
