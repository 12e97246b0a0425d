"""From raw documents to training batches: five stages over the operators of grainloom.llm.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. run() applies them to the table documents.

In every stage: an empty table stays empty; texts of any length are read whole; further columns pass unchanged, whatever their
names (the last stage leaves them out); repeated rows and repeated or null ids are rows like any other, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.llm.common import Scratch
from grainloom.llm.langid import UNKNOWN, held_out, identify, learn_profiles
from grainloom.llm.line_dedup import dedup_lines
from grainloom.llm.mixing import mix_sources
from grainloom.llm.near_copies import near_copies as copies
from grainloom.llm.packing import pack

#: Columns that the operators read; others have names of their own while an operator adds its columns.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs from what stage makes of it, without those that it adds."""
    names = [c if c in OWN else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(names).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in no language: null and empty texts, and texts without a letter. If no row has a language to
    learn from, all go. Ties between languages keep a document. Equal texts fare alike, whatever their ids."""
    profiles = learn_profiles(docs.where(~held_out("doc_id", 4, 2)), "text", "lang")
    return beside(docs, lambda df: identify(df, profiles).where(F.col("lang_pred") != UNKNOWN))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each class of alike lines; n_chars becomes that of the remaining text. Every document stays: null
    texts null, and those whose lines all stand elsewhere empty. Rows of one id keep equal lines together, as one document; a null
    id keeps all lines."""

    def kept(df: DataFrame) -> DataFrame:
        out = dedup_lines(df)
        return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in df.columns else out

    return beside(docs, kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or
    more. Texts without a word (null, empty, white space) are copies of each other; rows of one id stay or go together; null ids stay."""
    others = copies(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that every source has the same share of the rows; null is a source. Rows of one id are
    repeated equally often, some not at all."""
    return beside(docs, mix_sources)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of 65,536 tokens at most in 16 length buckets, with source, language and text. Null and empty texts have no
    tokens and lie in the first bucket; a longer document is a batch of its own; documents of equal length lie in the order of ids."""
    return pack(docs, n_buckets=16, token_budget=65_536, carry=("source", "lang", "text"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("batches", batches)]

#: SQL has no form of the language, line and near-copy stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again, and removed after the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
