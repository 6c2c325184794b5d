"""The corpus pipeline: its stages one after the other, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark import session
from dendrospark.llm.mixing import in_mixed_order
from dendrospark.llm.near_dups import near_duplicates
from dendrospark.llm.packing import STRETCH, pack, tokenizer_path
from dendrospark.llm.quality import judge
from dendrospark.llm.secrets import redact
from dendrospark.session import cut

PLACE = "mix_position"

def _packed(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row beside it, so that no name of a column can clash with theirs."""
    return docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("_payload"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return judge(_packed(docs), keep=("_payload",)).filter("kept").select("_payload.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, with the smallest id, also of repeated rows and rows without id. Five words to a shingle, similarity 0.8."""
    return near_duplicates(_packed(docs), width=5, percent=80, keep=("_payload",)).filter("leads").select("_payload.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; no document goes."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources take turns by their weights, with their place in it for the packing stage."""
    return in_mixed_order(docs, place_col=PLACE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids; stretches follow the places that the mixing stage gave."""
    if PLACE not in docs.columns:
        return pack(docs, tokenizer_path())
    return pack(docs, tokenizer_path(), stretch=STRETCH, place_col=PLACE)


_left: dict[tuple[str, str], dict[str, list[str]]] = {}  # by session and input folder: what each stage has left behind


def _tidy(name: str, stage):
    """The stage, which first deletes what earlier stages over the same folder left behind, unless ``docs`` still reads it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault((spark.sparkContext.applicationId, sf_dir), {})
        others = [k for k in left if k != name and left[k]]
        if others:
            read = "\n".join(docs.inputFiles())
            for other in others:
                live = [path for path in left[other] if path.split(":", 1)[-1] in read]
                session.delete_tables(spark, [path for path in left[other] if path not in live])
                left[other] = live
        before = len(session.WRITTEN)
        out = stage(spark, docs, sf_dir)
        left.setdefault(name, []).extend(session.WRITTEN[before:])
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES = [(name, _tidy(name, stage)) for name, stage in (
    ("quality_rules", drop_poor), ("near_duplicates", drop_near_duplicates), ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources), ("packing", pack_sequences))]

ORACLE_SQL = None  # sketches, positions of patterns, curves and token ids are beyond SQL: tests hold each stage to a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again, and then deleted with its successor written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        session.delete_tables(spark, last)
        last = [session.WRITTEN[-1]]
    return STAGES[-1][1](spark, docs, sf_dir)
