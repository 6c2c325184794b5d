"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index stores a posting (term, document row, place) for every training word that some test item uses. A window of a test item is looked up
from its rarest term: the postings of that term, less the term's offset in the window, are the places where the window may start.
They are intersected with the offset-adjusted postings of the second rarest term, and what is left with those of all others at once, so
the long lists of common words are only read for the few documents that are still possible. Joins are on (row, term, place): a passage
that a third of all documents share is spread over as many keys. With a ``slop`` the lists are intersected with that tolerance
(proximity matches). Tables of test windows, of their terms and of the rows still possible are broadcast where they count ``FEW`` rows at
most (numbers and words, so some tens of MB); beyond that the same joins sort and merge.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.llm.common import table, with_row_key
from dendrospark.session import cut

WINDOW = 10
FEW = 400_000  #: rows of a table that may be broadcast

# What separates words before A-Z is lower-cased (fixed by the data contract).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words in their own case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def plain_case(word: Column) -> Column:
    """A-Z in lower case and nothing else; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _sized(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is small. ``df`` reads written tables."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``window, terms``) and which items have them (``window, item_id``)."""
    words = items.select("item_id", F.transform(split_words(F.col("text")), plain_case).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = cut(words.filter(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("terms")).distinct())
    windows = cut(each.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()))
    owners = each.filter("item_id is not null").join(windows, "terms").select("window", "item_id")
    return windows, owners


def build_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (``_rid, doc_id, n_words``), ``postings`` (``term, _rid, place``) and ``vocabulary`` (``word, term``), all written."""
    vocabulary = cut(windows.select(F.explode("terms").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))
    tokens = cut(with_row_key(docs.select("doc_id", split_words(F.col("text")).alias("_words"))))
    rows = tokens.select("_rid", "doc_id", F.size("_words").cast("bigint").alias("n_words"))
    each = tokens.select("_rid", F.posexplode("_words").alias("place", "word")).withColumn("word", plain_case(F.col("word")))
    return rows, cut(each.join(_sized(vocabulary), "word").select("term", "_rid", "place")), vocabulary


def rarest_first(windows: DataFrame, postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``window, size, plan``: the terms of each window with their offsets, rarest first; windows with an unseen term are left out."""
    seen = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "word")).join(vocabulary, "word").join(seen, "term")
    # a window has WINDOW terms at most
    plan = terms.groupBy("window", "size").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("plan"))
    return cut(plan.filter(F.size("plan") == F.col("size")))


def _at(postings: DataFrame, terms: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Postings of the given terms, in the given rows, as ``_rid, term, found``."""
    part = postings.join(_sized(terms.select("term").distinct()), "term", "left_semi")
    if rows is not None:
        part = part.join(_sized(rows.select("_rid").distinct()), "_rid", "left_semi")
    return part.select("_rid", "term", F.col("place").alias("found"))


def _meet(wanted: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """Rows of ``wanted`` (``_rid, term, place``) with a posting within ``slop`` of the place."""
    if not slop:
        return wanted.join(lists.withColumnRenamed("found", "place"), ["_rid", "term", "place"], "left_semi")
    # places in cells as wide as the tolerance: a posting lies in the cell of the place or in one beside it
    cell = lambda c: F.floor(F.col(c) / slop)
    near = wanted.withColumn("_cell", F.explode(F.array(cell("place") - 1, cell("place"), cell("place") + 1)))
    met = near.join(lists.withColumn("_cell", cell("found")), ["_rid", "term", "_cell"]).filter(F.abs(F.col("found") - F.col("place")) <= slop)
    return met.select(*wanted.columns).distinct()


def find_windows(plans: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """``_rid, window, size, start``: where the windows occur. With a ``slop``, the rarest term stands in its place and all others
    within so many words of theirs."""
    key = ["_rid", "window", "size", "start"]
    ends = lambda i: (F.get("plan", F.lit(i))["term"], F.get("plan", F.lit(i))["off"])
    first = plans.select("window", "size", *[c.alias(f"{n}{i}") for i in (0, 1) for c, n in zip(ends(i), ("_term", "_off"))])
    starts = postings.join(_sized(first.withColumnRenamed("_term0", "term")), "term").withColumn("start", F.col("place") - F.col("_off0"))
    starts = starts.filter("start >= 0") if not slop else starts
    alone = starts.filter("size = 1").select(key)
    pairs = starts.filter("size > 1").select(*key, F.col("_term1").alias("term"), (F.col("start") + F.col("_off1")).alias("place"))
    second = first.filter("size > 1").select(F.col("_term1").alias("term"))
    both = cut(_meet(pairs, _at(postings, second), slop).select(key))
    later = plans.select("window", F.inline(F.slice("plan", 3, F.greatest(F.size("plan") - 2, F.lit(0))))).drop("n")
    rest = both.filter("size > 2").join(_sized(later), "window")
    rest = rest.select(*key, "term", "off", (F.col("start") + F.col("off")).alias("place"))
    whole = _meet(rest, _at(postings, later, both), slop).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = size - 2").select(key)
    return alone.unionByName(both.filter("size = 2")).unionByName(whole)


def words_hit(spans: Column) -> Column:
    """Words inside the union of sorted ``(start, size)`` spans."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))

    def add(s, x):
        end = x["start"].cast("bigint") + x["size"]
        return F.struct((s["n"] + F.greatest(end - F.greatest(x["start"].cast("bigint"), s["reach"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(s["reach"], end).alias("reach"))

    return F.aggregate(spans, state, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs`` (``doc_id, text``).

    ``items`` are the sorted ids of the test items (``item_id, text``) with a window in the row. Null and wordless texts have no words
    and no windows. Repeated rows and null ids are judged each by itself. Items with the same id are one item with the windows
    of all; an item without id hits words but is not listed. An empty table of items hits nothing, an empty table of documents gives an empty result.
    """
    windows, owners = item_windows(items, window)
    rows, postings, vocabulary = build_index(docs, windows)
    found = cut(find_windows(rarest_first(windows, postings, vocabulary), postings))
    # bounded by the words of the row
    hit = found.select("_rid", "start", "size").distinct().groupBy("_rid").agg(words_hit(F.sort_array(F.collect_list(F.struct("start", "size")))).alias("n_hit"))
    listed = (found.select("_rid", "window").distinct().join(owners, "window").select("_rid", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("_rid").agg(F.sort_array(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    return rows.join(hit, "_rid", "left").join(listed, "_rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def near_items(docs: DataFrame, items: DataFrame, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, start``: proximity matches, where a window's words stand within ``slop`` words of their places."""
    windows, owners = item_windows(items, window)
    rows, postings, vocabulary = build_index(docs, windows)
    found = find_windows(rarest_first(windows, postings, vocabulary), postings, slop)
    return found.join(owners, "window").join(rows.select("_rid", "doc_id"), "_rid").select("doc_id", "item_id", "start").distinct()


def op11_contamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP11_SQL = r"""
with words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
 item_words as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
 windows as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as phrase
   from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from item_words where len(w) > 0)),
 sizes as (select distinct size from windows),
 runs as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase
   from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from words, sizes where len(w) >= size)),
 hits as (select doc_id, r.size, i, item_id from runs r join windows using (size, phrase)),
 hit as (select doc_id, count(distinct place) as n from (select distinct doc_id, unnest(range(i, i + size)) as place from hits) group by doc_id),
 found as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(found.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, hit.n is not null as contaminated
from words left join hit using (doc_id) left join found using (doc_id)
"""
