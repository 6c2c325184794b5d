"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage is a window of ``WINDOW`` words. Suffixes are taken where it matters: every window has an anchor, its ``GRAM``-word run
with the least hash (leftmost of equals), so equal windows have equal anchors at equal distance, and about one position in twenty
is an anchor. Anchors that occur in one document only cannot belong to a repeated window and are left out, which is exact.

The remaining suffixes are split by variable-length prefixes into groups that fit in memory: by the ``GRAM`` words of their anchor, many
anchors to a group. A group holds the words around its anchors, not hashes. Its suffixes are sorted by words (ranks of 1, 2, 4, ... 32
words, each from two of the ones before), the common prefix of neighbours is read from the same ranks, and the places where it falls
below ``WINDOW`` words part the nodes of that depth. An anchor with more than ``GROUP`` occurrences does not fit: there the prefix grows to
all ``WINDOW`` words, so a group is one node, which is aggregated on 64-bit hashes and never gathered. Either way gives the same rows.
The least document below a node keeps the passage, all others lose it. ``repeats`` lists the repeated passages themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import batches, table
from dendrospark.llm.sketch import WordHashes, mix
from dendrospark.session import cut

WINDOW, GRAM = 50, 8
GROUP = 20_000  #: occurrences of an anchor that are gathered in one task
PER_TASK = 20_000  #: occurrences in a group of anchors, about

_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(h: np.ndarray, span: int) -> np.ndarray:
    """Hash of every run of ``span`` words, from running sums of a polynomial modulo 2^64."""
    n = len(h)
    if n < span:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(n, _BASE), dtype=np.uint64, out=sums[1:])
    return mix((sums[span:] - sums[:-span]) * _powers(n - span + 1, _INVERSE))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``GRAM``-word run, and the place of the anchor of every window (non-decreasing)."""
    grams = run_hashes(h, GRAM)
    if len(h) < WINDOW:
        return grams, np.empty(0, np.int64)
    inside = WINDOW - GRAM + 1
    return grams, np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)


def _hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def _surveyed(docs: DataFrame) -> DataFrame:
    """``doc_id, _th, n_words, kept_sha256`` (as if nothing went) and the distinct anchors of every row with how often each occurs."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["_th"], T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("_anchors", T.ArrayType(T.LongType())), T.StructField("_counts", T.ArrayType(T.LongType()))])

    def survey(rows):
        known = WordHashes()
        for part, (texts,) in batches(rows, ["text"]):
            n, sha, found, counts = [], [], [], []
            for text in texts:
                words = _words(text)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < WINDOW:
                    found.append(None), counts.append(None)
                    continue
                grams, at = anchors(_hashes(words, known))
                own, often = np.unique(grams[np.unique(at)], return_counts=True)
                found.append(own.view(np.int64)), counts.append(often)
            arrays = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_th")]
            arrays += [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.select("doc_id", "_th", "text").mapInArrow(survey, schema)


def _suffixes(marked: DataFrame) -> DataFrame:
    """``_a`` (anchor), ``_many``, ``doc_id, _th``, ``_lo`` (first window) per occurrence of a repeated anchor, with its windows: the words ``_s``, or hashes ``_w`` if many."""
    schema = T.StructType([T.StructField("_a", T.LongType()), T.StructField("_many", T.BooleanType()), marked.schema["doc_id"], marked.schema["_th"],
                           T.StructField("_lo", T.IntegerType()), T.StructField("_s", T.BinaryType()), T.StructField("_w", T.ArrayType(T.LongType()))])

    def spread(rows):
        known, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for part, (packed, repeated) in batches(rows, ["_packed", "_repeated"], 128):
            row, key, many, low, near, out = [], [], [], [], [], []
            for i, (p, r) in enumerate(zip(packed, repeated)):
                words = unpack.decompress(p).split(b" ")
                h = _hashes(words, known)
                grams, at = anchors(h)
                windows = run_hashes(h, WINDOW).view(np.int64)
                size = {x["a"]: x["many"] for x in r}
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                for lo, hi, a in zip(first.tolist(), [*first[1:].tolist(), len(at)], grams[at[first]].view(np.int64).tolist()):
                    if a in size:
                        row.append(i), key.append(a), many.append(size[a]), low.append(lo)
                        near.append(None if size[a] else b" ".join(words[lo:hi + WINDOW - 1])), out.append(windows[lo:hi] if size[a] else None)
            own = [part.column(part.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in ("doc_id", "_th")]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(many, pa.bool_()), *own, pa.array(low, pa.int32()), pa.array(near, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                                             names=[f.name for f in schema.fields])

    return marked.select("doc_id", "_th", "_packed", "_repeated").mapInArrow(spread, schema)


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4, ... words that start at every place, as long as ``WINDOW`` holds them."""
    levels, span = [words.astype(np.int64)], 1
    while span * 2 <= WINDOW:
        last = levels[-1]
        key = last * (len(words) + 1)
        key[:-span] += last[span:] + 1
        levels.append(np.unique(key, return_inverse=True)[1])
        span *= 2
    return levels


def sorted_suffixes(words: np.ndarray, starts: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``WINDOW`` words (equal ones by ``tie``), and the common prefix of each with the one before."""
    levels = _ranks(words)
    top = levels[-1]
    order = np.lexsort((tie, top[starts + WINDOW - (1 << len(levels) - 1)], top[starts]))
    at = starts[order]
    common = np.zeros(max(len(at) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = common + (1 << k) <= WINDOW
        common += np.where(fits & (levels[k][np.where(fits, at[1:] + common, 0)] == levels[k][np.where(fits, at[:-1] + common, 0)]), 1 << k, 0)
    return order, np.r_[np.zeros(min(len(at), 1), np.int64), common]


def deep_nodes(words: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least document below its node of depth ``WINDOW``, and the suffixes below it."""
    order, common = sorted_suffixes(words, starts, doc)
    node = np.cumsum(common < WINDOW) - 1
    head = np.flatnonzero(common < WINDOW)
    least, size = np.empty(len(doc), doc.dtype), np.empty(len(doc), np.int64)
    least[order] = doc[order][head][node]  # sorted by document inside a node
    size[order] = np.bincount(node, minlength=len(head))[node] if len(doc) else 0
    return least, size


def _gathered(rows: DataFrame, groups: int, every: bool) -> DataFrame:
    """Windows below nodes, from groups of anchors: those to remove or, with ``every``, all that repeat."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["_th"], T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_n", T.ArrayType(T.LongType()))])

    def subtree(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        parts = pc.split_pattern(data.column("_s").combine_chunks(), b" ")
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode().indices.to_numpy()
        size = np.diff(offsets) - WINDOW + 1
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = np.repeat(data.column("doc_id").to_numpy(), size)
        least, below = deep_nodes(words, np.repeat(offsets[:-1], size) + inside, doc)
        wanted = below > 1 if every else doc > least
        start = np.repeat(data.column("_lo").to_numpy(), size) + inside
        hit, count = np.unique(np.repeat(np.arange(len(size)), size)[wanted], return_counts=True)
        ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (start[wanted].astype(np.int32), below[wanted])]
        return pa.Table.from_arrays([data.column(c).take(pa.array(hit)) for c in ("doc_id", "_th")] + lists, names=["doc_id", "_th", "_at", "_n"])

    bucket = F.pmod(F.col("_a"), F.lit(groups))
    return rows.select(bucket.alias("_g"), "doc_id", "_th", "_lo", "_s").groupBy("_g").applyInArrow(subtree, schema)


def _aggregated(rows: DataFrame, every: bool) -> DataFrame:
    """The same for very frequent anchors: the least document and the size of each window, and a join with them."""
    each = rows.select("_a", "doc_id", "_th", "_lo", F.posexplode("_w").alias("_i", "_x"))
    nodes = each.groupBy("_a", "_x").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_below"))
    wanted = F.col("_below") > 1 if every else F.col("doc_id") > F.col("_least")
    return each.join(nodes, ["_a", "_x"]).filter(wanted).select("doc_id", "_th", F.array(F.col("_lo") + F.col("_i")).alias("_at"), F.array("_below").alias("_n"))


def _cleaned(marked: DataFrame) -> DataFrame:
    """``doc_id, _th, n_removed, kept_sha256`` and ``text`` of what is left (words joined by one space)."""
    schema = T.StructType([marked.schema["doc_id"], marked.schema["_th"], T.StructField("n_removed", T.LongType()), T.StructField("_sha", T.StringType()), T.StructField("kept_text", T.StringType())])

    def clean(rows):
        unpack = zstandard.ZstdDecompressor()
        for part, (packed, places) in batches(rows, ["_packed", "_places"], 128):
            gone, sha, left = [], [], []
            for p, lists in zip(packed, places):
                words = unpack.decompress(p).split(b" ")
                edge = np.zeros(len(words) + 1, np.int64)
                for at in lists:
                    at = np.asarray(at)
                    np.add.at(edge, at, 1), np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
                gone.append(int(covered.sum())), sha.append(hashlib.sha256(kept).hexdigest()), left.append(kept.decode("utf-8"))
            own = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_th")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=[f.name for f in schema.fields])

    return marked.select("doc_id", "_th", "_packed", "_places").mapInArrow(clean, schema)


def _packed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], docs.schema["_th"], docs.schema["_repeated"], T.StructField("_packed", T.BinaryType())])

    def pack(rows):
        squeeze = zstandard.ZstdCompressor(level=1)
        for part, (texts,) in batches(rows, ["text"]):
            arrays = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_th", "_repeated")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([squeeze.compress(b" ".join(_words(t))) for t in texts], pa.binary())], names=[f.name for f in schema.fields])

    return docs.select("doc_id", "_th", "_repeated", "text").mapInArrow(pack, schema)


def _nodes(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The survey of all rows, the rows with suffixes, and ``doc_id, _th, _at, _n``: windows and the size of their node."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_th"))
    survey = cut(_surveyed(keyed))
    occurs = survey.filter("doc_id is not null").select("doc_id", "_th", F.inline(F.arrays_zip(F.col("_anchors").alias("_a"), F.col("_counts").alias("_c"))))
    shared = F.expr("_low < _high or _n > 1") if every else F.expr("_low < _high")
    repeated = occurs.groupBy("_a").agg(F.sum("_c").alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).filter(shared)
    of_docs = (occurs.join(repeated, "_a").groupBy("doc_id", "_th")
               .agg(F.collect_list(F.struct(F.col("_a").alias("a"), (F.col("_n") > GROUP).alias("many"))).alias("_repeated")))
    marked = cut(_packed(keyed.join(of_docs, ["doc_id", "_th"])))
    suffixes = cut(_suffixes(marked))
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // PER_TASK))
    few = _gathered(suffixes.filter("not _many"), groups, every)
    return survey, marked, few.unionByName(_aggregated(suffixes.filter("_many"), every))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, occurrences``: the repeated passages of every row of ``docs`` (in words, ``start`` from 0).

    A passage is a stretch of consecutive windows that all occur equally often, also within one document; it cannot grow on either side
    without a window that occurs more or less often. Rows without id, and texts without a repeated window, have none. A row given
    twice repeats itself; its passages are listed once.
    """
    _, _, found = _nodes(docs, True)
    each = found.select("doc_id", "_th", F.inline(F.arrays_zip(F.col("_at").alias("at"), F.col("_n").alias("n")))).distinct()
    # rows of one document, so a window holds no more than one text
    turn = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "_th", "n").orderBy("at"))
    return (each.withColumn("_run", turn).groupBy("doc_id", "_th", "n", "_run")
            .agg(F.min("at").cast("bigint").alias("start"), (F.count(F.lit(1)) + WINDOW - 1).alias("length"))
            .select("doc_id", "start", "length", F.col("n").alias("occurrences")))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text`` where words went, else null) for every row of ``docs``.

    Null, empty and blank texts have no words. A row without id keeps all its words and takes none from others. Rows with the same id
    are one document here: they do not take words from each other. Empty tables give empty results.
    """
    survey, marked, found = _nodes(docs, False)
    places = found.groupBy("doc_id", "_th").agg(F.collect_list("_at").alias("_places"))
    cleaned = _cleaned(marked.select("doc_id", "_th", "_packed").join(places, ["doc_id", "_th"]))
    if not with_text:
        cleaned = cleaned.drop("kept_text")
    cleaned = cleaned.dropDuplicates(["doc_id", "_th"])  # equal rows were cleaned alike
    return survey.drop("_anchors", "_counts").join(cleaned, ["doc_id", "_th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("_sha", "kept_sha256").alias("kept_sha256"),
        *(["kept_text"] if with_text else []))


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    """What every document keeps once passages of 50 words go that an earlier document has."""
    return remove_repeats(table(spark, sf_dir, "documents"))
