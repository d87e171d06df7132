"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input.

1. ``toxicity``: documents that the classifier rejects go.
2. ``near_duplicates``: of each group of near copies the document with the smallest doc_id stays.
3. ``pii``: personal data and the terms that reveal it are taken out of the texts; no document goes.
4. ``mixing``: documents are selected to target weights of domain, language and source.
5. ``bpe``: texts are encoded; the last stage adds n_tokens, input_ids and decoded.

Defined results: null and empty texts pass every stage but the mix, which takes documents without tokens with each epoch that their
leaf takes whole, or that they precede the end of; rows equal in doc_id and text are copies, of which one stays, unless they have no words
or no doc_id; rows of one doc_id with other texts stay apart unless they link; a text of any length is read whole; an empty table gives an
empty table; columns of other names, also ones that a stage uses within, come through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, common, jaccard, mixing, pii, toxicity
from folium.llm.queries import vocabulary

#: The mix takes nine tenths of the tokens, in as many epochs of a domain as its target weight needs.
MIX_SHARE, MIX_EPOCHS = 0.9, None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, F.col("all_tokens") * MIX_SHARE, max_epochs=MIX_EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("pii", take_out_personal_data), ("mixing", mix), ("bpe", encode)]

#: Classifier, graph and tokenizer stages have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
