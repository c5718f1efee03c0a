"""A training corpus from raw documents: five stages, each read from its predecessor's table.

``run(spark, sf_dir)`` applies STAGES to ``documents``. A stage takes (spark, docs, sf_dir)
and works on all rows it is given; all but the last return the columns of ``docs``. Rows
are never sampled or capped; null texts count as empty ones, rows with a null id are never
taken for copies of each other, and an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import bpe, toxicity
from pagelore.llm.decontamination import drop_contaminated
from pagelore.llm.lines import LONG_WORDS, remove_repeated_lines
from pagelore.llm.queries import TOKENIZERS, prepare
from pagelore.llm.simhash import drop_near_copies
from pagelore.llm.tables import saved, table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of its own, so that no column clashes with one that a stage makes."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; it learns from the labelled ones."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs and of long lines; n_chars follows the text."""
    prepare(spark)
    inner, names = _plain(docs)
    text = names["text"]
    cut = remove_repeated_lines(inner, names["doc_id"], text, to=text, lines=None, long_words=LONG_WORDS)
    changed = F.size("removed_spans") > 0
    out = cut.withColumn(names["n_chars"], F.when(changed, F.length(text).cast("long")).otherwise(F.col(names["n_chars"]))) \
        if "n_chars" in names else cut
    return out.select(*(F.col(v).alias(k) for k, v in names.items()))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    prepare(spark)
    inner, names = _plain(docs)
    return drop_near_copies(inner, names["doc_id"], names["text"]).toDF(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number, and the hash of
    what they decode to; the text itself is left behind, other columns stay."""
    prepare(spark)
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    inner, names = _plain(docs)
    text = names.pop("text")
    coded = bpe.decode(bpe.encode(inner, path, text).drop(text), path)
    made = {"n_tokens": bpe.token_count(), "ids": F.col("ids"),
            "decoded_sha256": F.sha2(F.encode("decoded", "UTF-8"), 256)}
    taken = {c.lower() for c in names}
    return coded.select(*(F.col(v).alias(k) for k, v in names.items()),
                        *(c.alias(k) for k, c in made.items() if k not in taken))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("bpe", encoded),
]

#: A trained model decides in the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
