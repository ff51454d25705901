"""Corpus pipeline: toxicity and quality filters, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. The result is one row
per piece of a packed sequence.

Nulls: a null text counts as empty throughout, null ids are allowed. Very long
texts are taken whole; repeated rows and copies leave one row at near-dedup;
ties are settled by the operators; an empty table gives an empty result. Extra
columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.neardup import keep_one
from orrery.llm.packing import pack_documents
from orrery.llm.quality import fit_quality, score_quality
from orrery.llm.queries import vocabulary
from orrery.llm.substrings import dedup_substrings
from orrery.llm.toxicity import fit_toxicity, score_toxicity
from orrery.llm.windows import shielded
from orrery.session import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic by their sentences go."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    own, back = shielded(docs, ("held_out", "score", "predicted", "offences"))
    return score_toxicity(own, model).filter("predicted = 0").select(*own.columns).withColumnsRenamed(back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored junk by their statistics go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    own, back = shielded(docs, ("held_out", "score", "predicted"))
    return score_quality(own, model).filter("predicted = 1").select(*own.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one(docs, 0.8, by_count=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice go, wherever they stand."""
    own, back = shielded(docs, ("n_words", "removed"))
    counted = {"n_chars": F.length("text").cast(own.schema["n_chars"].dataType)} if "n_chars" in own.columns else {}
    return dedup_substrings(own, 35).withColumns(counted).select(*own.columns).withColumnsRenamed(back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: The stages are models, sketches and packing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i}")
    return docs
