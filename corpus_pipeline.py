"""The corpus pipeline: five stages over ``documents``, each an operator of ``inkwell.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents`` (doc_id, text, lang, source, n_chars).  The mixing
adds slot and place and the last keeps them: files may be read in any order, so
``(slot, place)`` is the order of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm._spill import numbered, settled, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; those without one (``und``: null text or no letter) go.

    Ambiguous texts stay: a close second language is no defect of a document.
    """
    from inkwell.llm.langid import UNDETERMINED, fit, predict

    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs, model, keep=COLUMNS).where(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least id of each component of links (Jaccard of 5-word shingles of 0.8 or more).

    Rows are told apart by number, not by id: ids may repeat or be null. Nulls come last; of one id, the first row stays.
    """
    from inkwell.llm.signature_join import link

    rows = numbered(docs.select(*COLUMNS), "_row")
    named = rows.select(F.col("_row").alias("doc_id"), "text")
    linked = settled(spark, lambda: link(named).select(F.col("doc_id").alias("_row"), "component_id"), "components")
    several = linked.where("component_id <> _row").select("component_id").distinct()
    shared = linked.join(several, "component_id", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    least = shared.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("_row")).select("_row")
    gone = shared.select("_row").join(least, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte in a 200-byte string that also starts elsewhere; all documents stay, each row with its own text."""
    from inkwell.llm.suffix_dedup import remove_repeats

    rows = numbered(docs.select(*COLUMNS), "_row")
    named = rows.select(F.col("_row").alias("doc_id"), "text")
    kept = settled(spark, lambda: remove_repeats(named, spans=False).where("n_removed > 0").select(F.col("doc_id").alias("_row"), "kept_text"), "kept")
    out = rows.join(kept, "_row", "left").withColumn("text", F.coalesce("kept_text", "text"))
    return out.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule: weights are the square roots of the sources' sizes; with slot and place."""
    from inkwell.llm.mixing import mixed

    return mixed(docs.select(*COLUMNS), order=True)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its slot and place where ``docs`` has them, and with digests of the ids and of what they decode to."""
    import public_tokenizers

    from inkwell.llm.bpe import encode

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source", "n_chars", *(c for c in ("slot", "place") if c in docs.columns)], decoded=False)


STAGES = [
    ("language_id", identify_language),
    ("signature_trees", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("pfair_mixing", mix_sources),
    ("bpe_encoding", encode_text),
]

#: SQL can express neither the classifiers nor the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
