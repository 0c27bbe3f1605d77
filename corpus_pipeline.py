"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
``run`` writes each result as Parquet in the folder that spark.checkpoint.dir names and
reads it again as the next stage's documents. All stages but the last return the columns
of ``documents``.

All stages take an empty table, further columns of any name, and rows that repeat. A null
text goes with the first stage. A null doc_id is never a copy of another row and loses no
passage. Rows that share a doc_id are one document for near copies and passages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.graph import checkpoint_folder
from tracelake.llm.language_crf import keep_identified
from tracelake.llm.mixing import EQUAL, mixed
from tracelake.llm.ngram_join import without_near_copies
from tracelake.llm.recompression import without_repeats
from tracelake.llm.sentencepiece_arrays import encode_rows

#: Near copies: documents whose sets of five-word shingles have at least this similarity.
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
#: Words of a passage that is cut where an earlier document already holds it.
PASSAGE_WORDS = 50
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field can tell; those it rejects go.

    Null texts, texts without a letter and texts whose language scores low go; the label
    ``lang`` is used to learn only, and without it every text goes.
    """
    return keep_identified(docs, LEAST_LANGUAGE_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Texts without words are no copies of each other; repeated rows of the doc_id that stays all stay.
    """
    return without_near_copies(docs, SHINGLE_WORDS, SIMILARITY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents without text go.

    Those are the ones that lose everything, and null or empty texts. ``n_chars`` follows the
    text, if there is such a column.
    """
    cut = without_repeats(docs, PASSAGE_WORDS).where(F.length("text") > 0)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that all sources have equal shares of the tokens.

    A row without a source is mixed by its words; without any source all rows stay once.
    """
    return mixed(docs, EQUAL, "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document, null texts as empty ones."""
    return encode_rows(docs, [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [("language", language), ("near_copies", near_copies), ("substrings", substrings), ("mix", mix), ("tokens", tokens)]

#: The language field and the classifier are learned models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
