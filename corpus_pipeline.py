"""The corpus pipeline: language ID, near-dedup, decontamination, surrogates, packing.

Each stage reads what the one before kept, written as Parquet; all but the last return the columns of documents. In every stage a
row is a document, so repeated rows and null ids are documents like any other; an empty table gives no rows; whole texts are read
however long; and columns that bear the name of one of the operators' results come out as they went in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comboscan.llm import decontam, langid, packing, pii, simhash
from comboscan.llm.common import fresh, materialize, table

#: SQL has no fingerprints, tokenizer or classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """(docs with the columns of these names, in any case, called otherwise; the columns that bring all back in their order)."""
    taken, back = list(docs.columns), []
    for i, c in enumerate(docs.columns):
        now = fresh(f"_kept{i}", taken) if c.lower() in names else c
        docs = docs.withColumnRenamed(c, now) if now != c else docs
        back.append(F.col(f"`{now}`").alias(c))
    return docs, back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised and sets ``lang`` to it, where there is such a column.

    Null, empty and letterless texts and those far from all languages go; a null ``lang`` teaches nothing and is filled; without any
    known language every document goes. Equal texts get equal decisions.
    """
    lang = next((c for c in docs.columns if c.lower() == "lang"), None)
    known = docs.where(F.col(lang).isNotNull()) if lang else docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(langid.sample(known))
    kept, back = aside(docs, ("lang_pred", "score", "distance", "rejected"))
    out = langid.predict(kept, model).where(~F.col("rejected"))
    return (out.withColumn(lang, F.col("lang_pred")) if lang else out).select(back)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five-word shingles, similarity 0.8 or more).

    Texts without words (null, empty, blank) are copies of each other; shorter texts than a shingle are compared whole.
    """
    return simhash.deduplicate(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item (0.8 or more of its five-word shingles).

    Null and empty texts contain none and stay; an empty benchmark drops nothing; copies share their fate.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; ``n_chars``, where there is such a column, follows the new text.

    Null and empty texts stay as they are; equal texts stay equal; the same entity gets the same surrogate in all documents.
    """
    kept, back = aside(docs, ("entities",))
    out = pii.replace(kept, key="pipeline")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of several lengths; one row for each piece.

    A null or empty text is its end token alone; a very long one is cut into as many windows as it fills.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
