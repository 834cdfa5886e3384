"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; the last returns doc_id, n_tokens, ids and digests. Documents that repeat in the mixture are
encoded as often as they repeat.

Defined results, stage by stage: a null text counts as empty in each. Toxicity keeps rows that it has nothing against, also those
without a text, an id or a label, and repeated rows one by one; without both labels nothing is rejected. Exact dedup keeps one row of
equal texts (null and empty ones are equal), the largest id, one of repeated rows. Near dedup keeps one row of each component; rows without words
stay, one of each id and text. Mixing drops what the plan does not take, so rows without words, and makes a null source a source of its own. Encoding
returns a row for each that it gets. Texts of any length are read whole; empty tables give empty results; further columns are kept up to mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from tarn.llm.common import cut, held_out, table
from tarn.llm.queries import piece_model
from tarn.sources.scratch import mark, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates at a similarity of 0.8 or more, the document with the smallest id."""
    return near_dedup.deduplicate(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at their target weights."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixture."""
    return sentencepiece_codec.encode_digests(docs, piece_model(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the learned and tokenising stages; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
            release(since, docs.cut_path)  # what the stage wrote on its way, and the result before it
    return docs
