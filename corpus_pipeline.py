"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on what its predecessor kept. Stages are written as Parquet and read again, so that
a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procsim.llm import mixing, ngram_join, packing, quality, secrets
from procsim.llm.queries import table, tokenizer_path
from procsim.storage import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go; the others keep all their columns, whatever the names.

    Null and empty texts are judged by the prior, which keeps them unless most documents are bad. Repeated rows are judged alike, null ids like
    others. An empty table stays empty.
    """
    return quality.good_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the first document by id stays, all columns as they were.

    Texts that are null or have no word belong to no group, so that all their rows stay. Of repeated rows one stays; ties in id go by place; null ids come last. An empty
    table stays empty.
    """
    return ngram_join.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: each secret becomes a mark; the rest of the text stays, and so do all documents and columns. ``n_chars`` follows the text.

    Null and empty texts stay as they are; repeated rows are treated alike. An empty table stays empty.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks, all columns as they were.

    A null source is one of its own; null and empty texts have size 0 and are drawn for like others. Rows of equal id, source and size share a draw.
    An empty table stays empty. Reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens; returns pieces (see ``packing.pack``).

    Null and empty texts are the end token alone; null and repeated ids stay as they are, each row a document of its own. An empty table gives no
    piece. Other columns go.
    """
    return packing.pack(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens and learned scores are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
