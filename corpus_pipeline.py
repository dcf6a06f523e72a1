"""The training corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents, the last one the index of the token files. Between stages the rows are written
as Parquet in the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, mixing, simhash, tokens, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; the last that fits a
    source's target is cut after the words taken."""
    sized = docs.withColumn("_size", common.token_count("text"))
    return mixing.training_order(mixing.plan_mix(sized, "doc_id", size="_size"), size="_size").select(*docs.columns)


def row_order(docs: DataFrame) -> tuple[Column, ...]:
    """What puts rows in the order in which they were written: scans deal files to tasks by size, so
    of files it is a part's number and the place in it."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty() and docs.inputFiles():
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        return part.cast("long"), F.col("_metadata.row_index")
    return (F.monotonically_increasing_id(),)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as ids in files in the order of training, read back: where each text's ids are and
    their checksum."""
    import public_tokenizers

    return tokens.tokenize(spark, docs, public_tokenizers.path("word_bpe_49k.json"), remember=False, order=row_order(docs))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
    ("token files", token_files),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents. A stage's rows are removed once the next has used them;
    the token files stay."""
    docs, held = common.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i:
            at = common.fresh_dir(spark, f"stage-{i}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if held is not None:
                common.remove_dir(spark, held)
            held = at
        docs = stage(spark, docs, sf_dir)
    # the last stage has written its files, which are all that its result is read from
    common.remove_dir(spark, held)
    return docs
