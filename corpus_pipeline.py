"""Corpus cleaning: toxicity, near-duplicates, repeated passages, benchmark passages, tokens.

Every stage but the last returns the columns of ``documents``. A text that loses
passages may lose part of a character at a cut; such a part becomes U+FFFD.

Defined results, for every stage: columns besides those of ``documents`` are
dropped; null texts count as empty and stay; ids may be null or repeat, and rows
with one id are judged one by one; of repeated rows the near-duplicate stage
keeps one; texts of any length are read whole; an empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from factengine.llm import bpe, decontam, neardup, suffix, toxicity
from factengine.llm.common import freeze, utf8

#: No stage that learns or hashes word sets is written in SQL; tests compare run() with a plain version.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled documents that op7 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.train(docs, labels, fold != 0)
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of texts with five-word shingles at least 0.8 similar. Rows are told apart even if ids repeat or are null; documents without words stay."""
    return neardup.near_duplicates(docs, shingle=5, percent=80, keep=COLUMNS).where("first").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a smaller id has too."""
    cut = suffix.dedup_substrings(docs, keep=["doc_id", "lang", "source", "n_chars"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_contamination(docs, benchmark, keep=COLUMNS)
    return found.where(~decontam.contaminated()).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids, and whether they decode to the text."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    marked = docs.withColumn("text_sha", F.sha2(utf8(), 256))
    keep = ["doc_id", "lang", "source", "text_sha"]
    encoded = bpe.encode(marked, ranks, public_tokenizers.PATTERN, keep, decoded=True)
    same = F.sha2("decoded", 256) == F.col("text_sha")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
