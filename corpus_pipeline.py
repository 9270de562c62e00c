"""A corpus from documents to packed sequences, stage by stage.

Toxic documents go, then all but one of equal texts, then all but one of each class of SimHash near duplicates, then
documents that hold a benchmark item; what is left is packed. Every stage but the last returns the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common, decontaminate, exact, packing, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact.stage),
    ("simhash near dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("packing", packing.stage),
]
#: Tokenizers and trained weights have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each of the others keeps is written as Parquet and read again, and what led to it is removed."""
    docs, begin = common.table(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.drop_since(spark, begin)
    return STAGES[-1][1](spark, docs, sf_dir)
