"""From raw documents to token files: the pipeline of the subpackage ``starloom.llm``.

Each stage gets a session, what its predecessor kept and the folder of the given tables. What it returns is written as
Parquet below the shared folder and read again as the next stage's documents.

In every stage an empty table gives an empty table, repeated rows are rows like any other unless stated, and further columns
stay as they are whatever their names. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import decontaminate, langid, mixing, near_dup
from starloom.llm.common import prepare, table
from starloom.llm.queries import tokenizer_path
from starloom.llm.token_store import token_digest
from starloom.session import scratch_path, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the given documents teach.

    Texts that are null or have no letter go, and those most of whose letters no training text has. Null ids and nulls in
    lang or source are no reason to go. If no document tells its language, none stays.
    """
    tune(prepare(spark))
    return langid.keep_languages(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without a word, and rows without an id, are in no group and stay. Rows with one id stay or go together.
    """
    tune(prepare(spark))
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item.

    Rows go by id and text, those without an id too. Null texts, null items and items without a word give no match.
    """
    tune(prepare(spark))
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that hold them in the order of the mixture.

    A null source is a source of its own; a null id counts as an empty one. Equal rows lie next to each other.
    """
    tune(prepare(spark))
    return mixing.mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are among the ids of the token files, which follow the order of the mixture.

    Readers may open files in any order, so the order is taken from the schedule again; it depends on the documents alone.
    Null and empty texts have only the end id.
    """
    tune(prepare(spark))
    ordered = mixing.mix(docs.select("doc_id", "text", "source"))
    return token_digest(ordered, tokenizer_path(), scratch_path(spark, "pipeline-tokens"), ["mix_slot", "mix_place"])


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Language models and tokenizers are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
