"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages are handed on as Parquet files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelib.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from tapelib.llm.queries import WORD_BPE, remainder, vocabulary
from tapelib.llm.store import stored

#: Score from which a document counts as toxic, as in the query of that operator.
TOXIC = 0.3
CAPACITY, END = 4096, 1

#: SQL cannot express the language models, the tokenizer and the packing plan; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents scored below ``TOXIC`` by models learnt from labelled documents that are still there."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("id", 4) != 2)
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("doc.*")


def drop_copies(spark, docs, sf_dir):
    """One document of each group of equal texts: the smallest id."""
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles: the smallest id."""
    return near_dedup.near_dedup(docs, k=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents of which less than a twentieth of the words stand in benchmark phrases."""
    found = decontamination.find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontamination.contaminated()).select("doc.*")


def pack(spark, docs, sf_dir):
    """Places of the documents' pieces in sequences of at most ``CAPACITY`` tokens."""
    pieces = stored(packing.token_pieces(docs, vocabulary(WORD_BPE), spaced=False, end_id=END, capacity=CAPACITY), "pieces")
    return packing.pack(pieces, CAPACITY).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
