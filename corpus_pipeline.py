"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, save, scratch, table
from tidemark.llm.minhash import minhash_groups
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack_documents
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that aren't predicted to be toxic.

    Null and empty texts score as a log ratio of 0 and stay; repeated rows are judged alike; documents without an id are
    judged like others; an empty table stays empty; columns beyond those of documents are left behind."""
    return score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), columns=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (0.8 of their runs of five words in common): the one with the
    least id (of rows that repeat an id, the one whose text comes first).

    Rows without an id are kept, and so are documents without words, which are like nothing; an empty table stays empty;
    columns beyond those of documents are left behind."""
    kept = minhash_groups(docs, shingle_words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.struct("text", "lang", "source", "n_chars")
    one = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("row")).select("doc_id", "row.*")
    return one.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words out of the texts, all of whose strings of 101 bytes occur twice or more.

    51 words take 101 bytes at least, so no repeated passage is too short to be seen.  Documents that are empty then go; those that were
    null or empty before stay, with their n_chars counted anew.  Rows that repeat each other are cut alike (all of a
    long text goes); an empty table stays empty; columns beyond those of documents are left behind."""
    cut = suffix_dedup(docs.select(*COLUMNS), length=101, words=51, columns=("doc_id", "lang", "source"), with_text=True)
    return cut.where("n_removed = 0 or length(text) > 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the target weights say, each as one row for each epoch.

    Null languages and sources are leaves of their own, null texts have no tokens; repeated rows are each
    taken; an empty table stays empty; columns beyond those of documents are left behind."""
    taken = mix_sources(docs, carry=COLUMNS).where("epochs > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 4096 tokens, 64 pieces and 4080 loss-bearing tokens.

    A null text is its end alone; documents without an id and repeated rows are packed like others; an empty
    table gives no pieces; other columns are ignored."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the models; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again.  What a stage has written
    on its way, and the table it has read, are deleted after it."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(save(stage(spark, docs, sf_dir)))
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
