"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``; the
last returns one row a document copy with its number of tokens and digests of ids and decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm import bpe, line_templates, mixing, ngram_join, toxicity
from gavelframe.llm.queries import VOCABULARY, held_out, saved_digests
from gavelframe.llm.storage import Scratch, fresh

REJECT_FROM = 0.3
#: Lines of more words than this are dropped from the second text on.
LONG_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT_FROM.

    Null and empty texts hold no term and stay; repeated rows stay or go together; an empty table
    stays empty; other columns, whatever their names, are kept as they are.
    """
    lexicon = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=held_out)
    found = fresh(docs.columns, "_toxicity")
    scored = docs.select("*", toxicity.scorer(lexicon)(F.col("text")).alias(found))
    return Scratch(spark).save_bounded(scored.where(F.col(f"{found}.score") < REJECT_FROM).select(*docs.columns), "pipeline-clean", 1000)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs, or that are long and repeat in two texts; those of which nothing but white space is left go.

    However many templates a leaf of the tree holds, all its lines are grouped.  n_chars follows a changed text.  Null, empty and blank texts stay as they are; repeated rows
    are changed alike; ties between documents are broken by the smaller doc_id, nulls last.
    """
    n_lines, n_dropped = fresh(docs.columns, "n_lines"), fresh(docs.columns, "n_dropped")
    cleaned = line_templates.drop_recurring_lines(docs, long_words=LONG_WORDS, added=(n_lines, n_dropped))
    changed = F.col(n_dropped) > 0
    rest = cleaned.where(~changed | F.col("text").rlike(r"\S"))
    return rest.select(*(F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id.

    Of rows repeated as a whole one stays; rows with a null doc_id are compared with each other
    only; null, empty and blank texts link with nothing.
    """
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words; a fraction of a copy is rounded by a hash of the document.

    Texts without words are taken 0 times and go; rows repeated as a whole share one number of
    copies each; a null source is a source of its own.
    """
    row, times = fresh(docs.columns, "_row"), fresh(docs.columns, "_copies")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text", "source", F.col("doc_id").isNull(), F.col("source").isNull()))
    mixed = mixing.mix_sources(keyed, key=row).groupBy(row).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times"))
    chance = F.pmod(F.xxhash64(row, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = mixed.select(row, F.floor(F.col("times") + chance).cast("int").alias(times)).where(F.col(times) > 0)
    copies = Scratch(spark).save(whole, "pipeline-copies", compact=True)
    return keyed.join(copies, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; null and empty texts have no tokens."""
    return saved_digests(bpe.round_trip(docs, VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("bpe", tokens)]

#: No SQL expresses the learned lexicon and the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(*([before] if before else []))
        before = f"pipeline-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
