"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import shipped, stored, table
from turnloom.llm.decontamination import find_windows, without_spans
from turnloom.llm.language import UNDETERMINED, identify
from turnloom.llm.line_dedup import drop_repeated_lines
from turnloom.llm.near_dedup import near_duplicates
from turnloom.llm.sentencepiece_codec import default_model, encode_pieces

FOREIGN_SHARE, FOREIGN_GRAMS = 0.25, 200


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under neutral names, which clash with no result of an operator, and the name that each column has now."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(rows: DataFrame, names: dict[str, str], docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; with another text also its length."""
    new = {} if text is None else {"text": F.col(text), "n_chars": F.char_length(text)}
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(n)).alias(c) for c, n in names.items()])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the filters know.

    Null texts and texts without a letter go, and longer ones of whose n-grams
    hardly any is known to the best language.
    """
    rows, names = _shielded(docs)
    judged = identify(rows, names["doc_id"], names["text"], names["lang"], keep=rows.columns)
    foreign = (F.col("n_grams") >= FOREIGN_GRAMS) & (F.col("score") < FOREIGN_SHARE)
    return _restored(judged.where((F.col("lang_pred") != UNDETERMINED) & ~foreign), names, docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in a later one. A document may keep an empty text; a null one becomes empty."""
    rows, names = _shielded(docs)
    return _restored(drop_repeated_lines(rows, names["doc_id"], names["text"], keep=rows.columns), names, docs, "kept_text")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id; empty ones are no group. Repeated rows become one."""
    rows, names = _shielded(docs)
    key = F.coalesce(names["doc_id"], F.lit(-(1 << 63)))  # one shuffle of the texts serves the join and the repeated rows
    ids = near_duplicates(rows, names["doc_id"], names["text"]).where("kept").select(key.alias("key")).distinct()
    kept = rows.withColumn("key", key).join(ids, "key", "left_semi").dropDuplicates(["key", names["text"]])
    return _restored(kept, names, docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words inside benchmark windows; nothing else of a text changes."""
    rows, names = _shielded(docs)
    found = find_windows(rows, table(spark, sf_dir, "benchmark"), names["text"], keep=rows.columns)
    return _restored(without_spans(found, names["text"]), names, docs, "clean_text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    rows, names = _shielded(docs)
    coded = encode_pieces(rows, default_model(), names["doc_id"], names["text"], keep=rows.columns)
    return coded.select(*[F.col(names[c]).alias(c) for c in ("doc_id", "lang", "source")], F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce(names["text"], F.lit(""))).alias("same_text"))


BATCH_BYTES = 2 << 20


def _ready(stage):
    """A stage whose tasks can import this package, and whose batches are cut by bytes before they are sent.

    Executor and worker both hold a batch; 10,000 documents would be too much for either.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(shipped(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", _ready(keep_known_languages)),
    ("line dedup", _ready(drop_lines)),
    ("MinHash near-dedup", _ready(keep_one_of_each_group)),
    ("benchmark decontamination", _ready(cut_benchmark_passages)),
    ("SentencePiece encoding and decoding", _ready(encode)),
]

#: The learned stages have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
