"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.llm import queries as Q
from streetworth.llm._common import bundled, maybe_in, restored, save, table
from streetworth.llm.language import fold, identify, train
from streetworth.llm.mixing import mix
from streetworth.llm.ngram_join import ngram_jaccard, with_set_id
from streetworth.llm.packing import pack
from streetworth.llm.pii import find_pii, redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those of which no language has half of the letters, go. Repeated rows are judged alike."""
    model = train(docs.where(fold("doc_id", 3) != 1))
    found = identify(bundled(docs, "text"), model).where("lang_pred <> 'und' and lang_share >= 0.5")
    return found.select(*restored(found, docs.columns, "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, one row of the smallest doc_id stays; those without words or doc_id all stay.

    Rows are known by doc_id and shingles, so a repeated row goes and another text under the doc_id of one that goes stays.
    """
    own = ["doc_id", "set_id", "second_id"]
    found = save(ngram_jaccard(docs).where("doc_id is not null and set_id is not null"), "found")
    heads = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min(F.struct("set_id", "second_id")).alias("kept"), F.count("*").alias("rows"))
    several = save(heads.where("rows > 1").drop("rows"), "several")
    others = found.where("doc_id = component_id").join(several.select("root", "kept"), "root").where(F.struct("set_id", "second_id") != F.col("kept"))
    gone = found.where("doc_id <> component_id").select(*own).unionByName(others.select(*own)).distinct()
    met = save(gone.withColumn("goes", F.lit(True)).unionByName(several.select("doc_id", "kept.*").withColumn("goes", F.lit(False))), "gone")

    marked = maybe_in(bundled(docs, "doc_id", "text"), met, "doc_id")
    hit = with_set_id(marked.where("_maybe").drop("_maybe")).join(met, own, "left")
    one = hit.where("not goes").dropDuplicates(own)
    kept = [marked.where("not _maybe"), hit.where("goes is null"), one]
    return reduce(DataFrame.unionByName, [k.select(*restored(k, docs.columns, "doc_id", "text")) for k in kept])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds and n_chars follows; every row stays, null and empty texts as they are."""
    out = redact(find_pii(bundled(docs, "text")))
    # Not by a new struct of the others: a filter on any of them would then hold all that makes the text, and the optimizer would run out of memory.
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("others.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*(n_chars.alias(name) if name == "n_chars" else column for name, column in zip(docs.columns, restored(out, docs.columns, "text"), strict=True)))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each leaf's budget, each row at most once; the document that a leaf's budget cuts stays whole. Null and empty texts, which have no tokens, go."""
    kept = ("doc_id", "text", "lang", "source")
    mixed = mix(bundled(docs, *kept), Q.domain(), Q.MIX_WEIGHTS, share=Q.MIX_SHARE, max_epochs=1)
    return mixed.select(*restored(mixed, docs.columns, *kept))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences (see pack); a null text is one end token, repeated rows are packed each, an empty table gives no rows."""
    return pack(docs, Q.tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("target_mix", target_mix), ("packed", packed)]

#: Trained models and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents of sf_dir; what each returns is saved in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
