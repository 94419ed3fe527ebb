"""A corpus pipeline over documents: language ID, near-dedup, decontamination, personal data, SentencePiece ids.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, of the columns of docs but
for the last, which adds ids and n_tokens. Extra columns of docs pass through, whatever their names (but ids and
n_tokens, which the last replaces); an empty table gives an empty table. Each stage says what becomes of nulls, empty
texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import settle, table
from quadrat.llm.language_id import UNDETERMINED, identify, train
from quadrat.llm.near_dups import one_of_each
from quadrat.llm.personal_data import find, redact
from quadrat.llm.queries import tokenizer
from quadrat.llm.sentence_pieces import encode
from quadrat.llm.winnowing import decontaminate

#: Language ID can't be expressed in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.5) -> DataFrame:
    """Drop documents that the classifier can't place: no language gets at least least_score, or there is no letter.

    So null and empty texts go. Repeated rows are judged alike. It learns from the rows that have a text and a language;
    with none it can place nothing, and all go.
    """
    model = train(docs)
    judged = identify(docs, model, lang_col="__lang", score_col="__score")
    return judged.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least_score)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, 0.8), as one_of_each() says: repeated rows are copies, rows without id take part."""
    return one_of_each(docs)


def _packed(docs: DataFrame) -> DataFrame:
    """The text and all columns as one, so none clashes with what an operator adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages, by the rule of decontaminate(). Null and empty texts hold none; repeated rows are judged alike."""
    clean = decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")).where("NOT contaminated")
    return clean.select(*[F.col("__doc")[c].alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and count the characters anew where there is n_chars. Null stays null; all rows stay."""
    out = redact(find(_packed(docs)))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[made.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns])


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of each text and their number. Null has null ids and no pieces; all rows stay."""
    return encode(docs, tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=1)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
