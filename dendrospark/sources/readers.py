"""Readers for skeletons, result tables, label lists, hypothesis exports and ledgers.

Every reader takes a path or glob and returns a lazy DataFrame with an explicit schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.functions.scalar import nan_to_null
from dendrospark.operators.metrics import METRIC_NAMES
from dendrospark.session import is_empty

NODE_SCHEMA = "node_id long, component_id long, swc_id string, label string, x double, y double, z double, radius float, brain_id string"
EDGE_SCHEMA = "src long, dst long, brain_id string"
META_SCHEMA = "anis_x double, anis_y double, anis_z double, min_cable_length double, node_spacing double, brain_id string"

LEDGER_SCHEMA = T.StructType([
    T.StructField("generation", T.LongType()), T.StructField("wall_seconds", T.DoubleType()), T.StructField("eval_seconds", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("cost_usd", T.DoubleType()),
    T.StructField("n_evaluations", T.LongType()), T.StructField("human_interventions", T.LongType()),
    T.StructField("train_primary", T.DoubleType()), T.StructField("heldout_primary", T.DoubleType()),
    T.StructField("parent_heldout", T.DoubleType()), T.StructField("accepted", T.BooleanType()), T.StructField("note", T.StringType()),
    T.StructField("candidate_path", T.StringType()), T.StructField("heuristics_diffstat", T.StringType()),
    T.StructField("diagnosis", T.StringType())])

_RECORD = """struct<id:string,status:string,hypothesis:string,surprisal:string,isSurprising:boolean,prior:double,posterior:double,
  analysis:string,review:string,experimentPlan:struct<objective:string>>"""
# The keys under which an export may hold its list, in order of preference.
LIST_KEYS = ["records", "hypotheses", "results", "data"]


def read_skeletons(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Node, edge and build-parameter tables of all brains under ``path`` (partitioned by ``brain_id``)."""
    def table(name, schema):
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return {"nodes": table("nodes", NODE_SCHEMA), "edges": table("edges", EDGE_SCHEMA), "meta": table("meta", META_SCHEMA)}


def read_swc(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """SWC text files to nodes and edges; the parent link of a node is its edge.

    Columns: id type x y z radius parent. Node ids are unique per file.
    """
    lines = spark.read.text(glob).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    p = F.split("line", r"\s+")
    nodes = lines.select(
        F.regexp_replace("file", r"\.swc$", "").alias("swc_id"), p[0].cast("long").alias("node_id"), p[1].cast("int").alias("type"),
        *[p[i + 2].cast("double").alias(c) for i, c in enumerate("xyz")], p[5].cast("float").alias("radius"), p[6].cast("long").alias("parent"))
    edges = nodes.filter(F.col("parent") != -1).select("swc_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"))
    return nodes.drop("parent"), edges


def with_brain_id(df: DataFrame, name: Column | str = "file_name") -> DataFrame:
    """Brain id and length threshold from names like ``dataset_cache_<brain>_mcl<N>.…``."""
    c = F.col(name) if isinstance(name, str) else name
    pattern = r"dataset_cache_([^_]+)_mcl(\d+)"
    hit = F.regexp_extract(c, pattern, 1)
    return df.withColumns({"brain_id": F.when(hit != "", hit), "min_cable_length": F.regexp_extract(c, pattern, 2).try_cast("int")})


def parse_brain_lookup(lines: DataFrame, order: str = "pos") -> DataFrame:
    """Brain -> segmentation id from rich text (``value`` and an order column); the first entry of a brain wins.

    A value is a line or a whole file; within a value, entries and groups may span lines. By the rules of the format line ends
    mean nothing, a group that opens with an asterisk is not shown, and a control is a backslash with a word and number, a byte in hex, or one sign.
    """
    text = F.translate("value", "\r\n", "")
    text = F.regexp_replace(text, r"(?s)[{][\\][*](?:[^{}]|[{][^{}]*[}])*[}]", "")
    text = F.regexp_replace(text, r"[\\](?:'[0-9a-fA-F]{2}|[a-z]{1,32}(?:-?[0-9]{1,10})?|.)", " ")
    text = F.translate(text, "{}", "  ")
    # fixed value: how an entry is written
    pattern = r"(\d{6})\s*,\s*([A-Za-z0-9_.]+)"
    found = lines.select(order, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("_i", "_hit"))
    pairs = found.select(F.struct(order, "_i").alias("_o"), F.regexp_extract("_hit", pattern, 1).alias("brain_id"),
                         F.regexp_extract("_hit", pattern, 2).alias("segmentation_id"))
    return pairs.groupBy("brain_id").agg(F.min(F.struct("_o", "segmentation_id"))["segmentation_id"].alias("segmentation_id"))


def read_brain_lookup(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lookup of the entries in whole files, files by name."""
    files = spark.read.text(path, wholetext=True)
    return parse_brain_lookup(files.select("value", F.col("_metadata.file_path").alias("pos")))


def require_brains(lookup: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lookup rows of the wanted brains; a brain without an entry fails the query."""
    j = wanted.select("brain_id").distinct().join(lookup, "brain_id", "left")
    return j.withColumn("segmentation_id", F.coalesce(
        "segmentation_id", F.raise_error(F.concat(F.lit("no segmentation for brain "), "brain_id")).cast("string")))


def image_paths(docs: DataFrame) -> DataFrame:
    """Brain -> image path at full resolution from JSON objects (``value``) of prefixes."""
    return docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("brain_id", "_p")).select(
        "brain_id", F.concat(F.regexp_replace("_p", "/$", ""), F.lit("/0")).alias("image_path"))


def with_paths(lookup: DataFrame, root: str) -> DataFrame:
    """Truth, fragment and segmentation locations of each brain under a storage root."""
    return lookup.withColumns({
        "gt_path": F.format_string(f"{root}/ground_truth/%s/voxel", "brain_id"),
        "fragments_path": F.format_string(f"{root}/fragments/%s/whole_brain/%s/swcs", "brain_id", "segmentation_id"),
        "segmentation_path": F.format_string(f"{root}/fragments/%s/whole_brain/%s/", "brain_id", "segmentation_id")})


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Per-neuron results from ``<root>/<brain>/<segmentation>/results.csv`` (a file or a folder of part files)."""
    inner = {v: k for k, v in METRIC_NAMES.items()}
    names = [n for n in METRIC_NAMES.values() if n != METRIC_NAMES["split_accuracy"]]
    schema = T.StructType([T.StructField("neuron", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names])
    df = spark.read.csv(f"{root}/*/*/results.csv", header=True, schema=schema).withColumn("_f", F.col("_metadata.file_path"))
    at = r"/([^/]+)/([^/]+)/results\.csv"
    return df.select("neuron", *[nan_to_null(F.col(f"`{n}`")).alias(inner[n]) for n in names],
                     F.regexp_extract("_f", at, 1).alias("brain_id"), F.regexp_extract("_f", at, 2).alias("segmentation_id"))


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines; a missing path is an empty table."""
    try:
        return spark.read.text(paths)
    except Exception as ex:  # AnalysisException of a missing path
        if "PATH_NOT_FOUND" not in str(ex):
            raise
        return spark.createDataFrame([], "value string")


def parse_connections(lines: DataFrame) -> DataFrame:
    """Label pairs from ``a,b`` lines: two non-empty tokens exactly, anything else is skipped, duplicates merge."""
    tokens = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(tokens.alias("_t")).filter(F.size("_t") == 2).select(F.col("_t")[0].alias("label_a"), F.col("_t")[1].alias("label_b")).distinct()


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return parse_connections(_lines(spark, path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("label")).filter(F.col("label") != "").distinct()


def labels_or_members(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The label list, or the members of the pairs when it is empty."""
    members = pairs.select(F.explode(F.array("label_a", "label_b")).alias("label")).distinct()
    return members if is_empty(labels) else labels


def parse_hypotheses(docs: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Records of whole JSON documents: a list, or an object holding it under one of the known keys.

    A byte-order mark is tolerated, an export without records is an error.
    """
    text = F.regexp_replace(value, "^\ufeff", "")
    as_list = F.from_json(text, f"array<{_RECORD}>")
    as_object = F.from_json(text, "struct<" + ",".join(f"{k}:array<{_RECORD}>" for k in LIST_KEYS) + ">")
    held = F.coalesce(*[as_object[k] for k in LIST_KEYS])
    found = F.when(F.ltrim(text).startswith("["), as_list).otherwise(held)
    checked = F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(
        F.raise_error(F.concat(F.lit("no hypotheses in "), F.col(file))))
    return docs.select(F.col(file).alias("source_file"), F.regexp_replace(file, r"\.json$", "").alias("run"), F.explode(checked).alias("_r")).select(
        "run", "source_file", "_r.*")


def read_hypotheses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hypothesis exports, each file once: files named one by one, whatever their ending, and ``*.json`` in folders."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    docs = spark.read.text(paths, wholetext=True)
    place = F.col("_metadata.file_path")
    named = [place.endswith(p.split("://")[-1].lstrip("/")) for p in paths if not p.endswith("/")]
    docs = docs.filter(reduce(lambda a, b: a | b, named, place.endswith(".json")))
    docs = docs.select("value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_name").alias("file"))
    return parse_hypotheses(docs.dropDuplicates(["_p"]))


def read_ledger(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Ledger rows of one or many runs, tagged with the run folder; blank lines are skipped."""
    df = spark.read.schema(LEDGER_SCHEMA).json(path)
    return df.filter(F.col("generation").isNotNull()).withColumn(
        "run_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/ledger\.jsonl", 1))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File metadata without contents: path, name, time, size."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "modificationTime", "length")


def latest_run(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Newest run per brain from rows ``run_id, modified``; the brain is the part before the first underscore."""
    r = runs.withColumn("brain_id", F.substring_index(run, "_", 1))
    return r.groupBy("brain_id").agg(F.max(F.struct("modified", run))[run].alias(run))
