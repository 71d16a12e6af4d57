"""The corpus pipeline: toxicity, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir), with docs the rows that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import bpe, mixing, pii, simhash, toxicity
from prosemill.llm.common import stored, table
from prosemill.llm.queries_search import pii_key

#: Fingerprints of a text in the near-duplicate stage; more find more of the looser copies, at 64 short rows each.
PRINTS = 4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; n_chars stays that of the text.

    Null and empty texts stay unless the model rejects empty ones. Repeated rows stay as often as they came. Without labels of both
    classes all rows get one score. An empty table stays empty.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, any of PRINTS fingerprints within two bits) the row with the smallest id.

    Rows without an id stay, and so does one of several rows with one id and different texts of their own each. Null and empty texts
    are one group. Of rows that are alike in id and text one stays. An empty table stays empty.
    """
    return simhash.keep_one(docs, width=5, max_bits=2, prints=PRINTS).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with valid personal data replaced by pseudonyms of the session's key; where any was, n_chars is counted anew.

    Null texts stay null, repeated rows stay and get equal pseudonyms, an empty table stays empty.
    """
    count = F.when(F.size("pii") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return pii.pseudonymise(docs, pii_key(spark)).select(*[count if c == "n_chars" else c for c in COLUMNS])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws it, none or many times.

    A null source is a source of its own; rows that share an id draw the same count, also null ids. An empty table stays empty.
    """
    return mixing.poisson_mix(docs, power=0.5, seed=42).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its id and the count and digests of its tokens; a null text has none. Repeated rows come as often as before."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("source mixture", mix_sources),
    ("byte-level BPE", encode_tokens),
]
#: Compression lengths and XXH64 fingerprints can't be had in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
