"""Collocations from truncated suffix trees, built group by group after vertical partitioning by word prefixes.

Every word of a piece starts a suffix, cut off after ``DEPTH`` words (shorter ones at the end of a piece are filled up with an end mark).
A task turns its texts into runs: the distinct truncated suffixes of one language and one prefix bucket, sorted and counted, with the words
they use; so repeated suffixes leave a task once. Buckets are prefixes grouped by hash such that a group stays within ``BUDGET`` suffixes on
average. A group above it has its prefixes lengthened by a word and is split over as many groups as it needs, then by one word more; after
all ``DEPTH`` words a suffix is one row a task. Each group is then built on its own: runs are merged, equal suffixes add their counts (the
leaves), and the frequency of a phrase is the total of the leaves below its node. Nodes whose prefix was split are summed over groups.

Scores compare a phrase with its parts by joins on the nodes. Suffixes are never gathered by word, language or phrase in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.llm.common import batches, table
from dendrospark.session import cut

DEPTH = 3
BUDGET = 1_000_000  #: suffixes, after counting equal ones within a task, that a group holds
CHUNK = 2_000_000  #: suffixes that a task holds before it hands out its runs
STEP = 1_000_000  #: words of a long text that are taken in at a time
BITS = 21  #: in a task a suffix is three word numbers of so many bits; number 0 is the end mark

# Fixed by the data contract: signs that end a piece, what separates words, and the name of texts without a language.
_SIGNS, _NO_LANG = b".,;:!?\n\x0b\x0c\r", "und"
_PLAIN = bytes.maketrans(_SIGNS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\xff" * len(_SIGNS) + b" abcdefghijklmnopqrstuvwxyz")  # 0xff is in no UTF-8 text
_END = b"\xff"
_MASK = np.uint64((1 << BITS) - 1)


class Numbers(dict):
    """Word numbers by first sight; the end mark is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, with end marks between pieces."""
    return [w for w in text.encode("utf-8", "replace").translate(_PLAIN).replace(_END, b" \xff ").split(b" ") if w] if text else []


def suffixes(ids: np.ndarray) -> np.ndarray:
    """Truncated suffixes of a sequence of word numbers with end marks, packed into one number each."""
    padded = np.concatenate([ids, np.zeros(DEPTH - 1, np.uint64)])
    out, alive = padded[: len(ids)].copy(), ids != 0
    for k in range(1, DEPTH):
        own = padded[k: k + len(ids)]
        alive &= own != 0
        out = (out << np.uint64(BITS)) | np.where(alive, own, np.uint64(0))
    return out[ids != 0]


def _parts(packed: np.ndarray) -> list[np.ndarray]:
    return [(packed >> np.uint64(BITS * (DEPTH - 1 - k))) & _MASK for k in range(DEPTH)]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def prefix_hash(words: list[bytes], packed: np.ndarray, lang: str, length: int) -> np.ndarray:
    """Hash of the first ``length`` words of every suffix."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.full(len(packed), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")), np.uint64)
    for ids in _parts(packed)[:length]:
        out = _spread(out * np.uint64(0x9E3779B97F4A7C15) + own[ids.astype(np.int64)])
    return out


def _squeeze(words: list[bytes], packed: np.ndarray, counts: np.ndarray) -> bytes:
    """A run as bytes: words used, steps between sorted suffixes, counts."""
    body = b"\xff".join(words)
    steps = np.diff(packed, prepend=np.uint64(0))
    head = np.array([len(body), len(packed)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + body + steps.tobytes() + counts.astype(np.int64).tobytes())


def _unsqueeze(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    size, n = np.frombuffer(raw, np.int64, 2).tolist()
    steps = np.frombuffer(raw, np.uint64, n, 16 + size)
    return raw[16: 16 + size].split(b"\xff"), np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.int64, n, 16 + size + 8 * n)


def _renumbered(words: list[bytes], packed: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The same suffixes over the words they use only, numbered from 1 in the same order, so that sorted suffixes stay sorted."""
    parts = [p.astype(np.int64) for p in _parts(packed)]
    seen = np.zeros(len(words), bool)
    for p in parts:
        seen[p] = True
    seen[0] = False
    to = np.cumsum(seen).astype(np.uint64)
    to[~seen] = 0
    out = np.zeros(len(packed), np.uint64)
    for p in parts:
        out = (out << np.uint64(BITS)) | to[p]
    return [words[i] for i in np.flatnonzero(seen).tolist()], out


def _handed_out(words: list[bytes], packed: np.ndarray, counts: np.ndarray, place: np.ndarray):
    """``place, run, suffixes`` for each group of suffixes with the same place."""
    order = np.argsort(place, kind="stable")
    place, packed, counts = place[order], packed[order], counts[order]
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(place[lo]), _squeeze(*_renumbered(words, packed[lo:hi]), counts[lo:hi]), hi - lo


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    """``lang, bucket, run, n`` (suffixes in the run), ``total`` (with repeats)."""

    def make(rows):
        texts_of: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        held = 0

        def out():
            columns = [[], [], [], [], []]
            for lang, (numbers, parts) in texts_of.items():
                packed, counts = np.unique(np.concatenate(parts), return_counts=True)
                if not len(packed):
                    continue
                words = list(numbers)
                place = (prefix_hash(words, packed, lang, 1) % np.uint64(buckets)).astype(np.int64)
                totals = np.bincount(place, weights=counts, minlength=buckets).astype(np.int64)
                for bucket, run, n in _handed_out(words, packed, counts, place):
                    for column, value in zip(columns, (lang, bucket, run, n, int(totals[bucket]))):
                        column.append(value)
                    if len(columns[0]) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                        columns = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names, types = ["lang", "bucket", "run", "n", "total"], [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for _, (langs, texts) in batches(rows, ["_lang", "text"], 128):
            for lang, text in zip(langs, texts):
                known = tokens(text)
                for at in range(0, len(known), STEP):
                    numbers, parts = texts_of.setdefault(lang, (Numbers(), []))
                    # the words after a step are its followers; their own suffixes belong to the next one
                    part = known[at: at + STEP + DEPTH - 1]
                    own = suffixes(np.fromiter(map(numbers.__getitem__, part), np.uint64, len(part)))
                    parts.append(own[: sum(w != _END for w in part[:STEP])] if at + STEP < len(known) else own)
                    held += len(parts[-1])
                    if held >= CHUNK or len(numbers) + STEP + DEPTH > 1 << BITS:
                        yield from out()
                        texts_of, held = {}, 0
        if held:
            yield from out()

    return docs.select("_lang", "text").mapInArrow(make, "lang string, bucket long, run binary, n long, total long")


def _lengthened(runs: DataFrame, length: int) -> DataFrame:
    """Runs of crowded groups, dealt out by prefixes of ``length`` words over ``_parts`` groups each."""

    def deal(rows):
        names = ["lang", "bucket", "sub", "run", "n"]
        for _, (langs, buckets, parts, packed_runs) in batches(rows, ["lang", "bucket", "_parts", "run"], 8):
            columns = [[], [], [], [], []]
            for lang, bucket, k, run in zip(langs, buckets, parts, packed_runs):
                words, packed, counts = _unsqueeze(run)
                words = [_END, *words]
                place = (prefix_hash(words, packed, lang, length) // np.uint64(1 << 20) % np.uint64(k)).astype(np.int64)
                for sub, own, n in _handed_out(words, packed, counts, place):
                    for column, value in zip(columns, (lang, bucket, sub, own, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=names)

    return runs.select("lang", "bucket", "_parts", "run").mapInArrow(deal, "lang string, bucket long, sub long, run binary, n long")


def merged(runs: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Words, sorted distinct suffixes (one array of word numbers for each place) and their counts in all runs: the leaves of one subtree."""
    numbers, found = Numbers(), []
    for run in runs:
        words, packed, counts = _unsqueeze(run)
        to = np.fromiter(map(numbers.__getitem__, [_END, *words]), np.uint64, len(words) + 1)
        found.append([*[to[p.astype(np.int64)] for p in _parts(packed)], counts])
    *columns, counts = [np.concatenate(c) for c in zip(*found)]
    if len(numbers) <= 1 << BITS:
        order = np.argsort((columns[0] << np.uint64(2 * BITS)) | (columns[1] << np.uint64(BITS)) | columns[2], kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(_changes(columns))
    return list(numbers), [c[first] for c in columns], np.add.reduceat(counts[order], first)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new value of the columns together begins."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def nodes(words: list[bytes], columns: list[np.ndarray], counts: np.ndarray, least: int, whole: int) -> list[tuple[bytes, int, int]]:
    """``phrase, words, frequency`` of the nodes of a subtree, from leaf totals. Nodes of at least ``whole`` words are complete
    in this group and may be dropped when rarer than ``least``; shorter ones go on in other groups."""
    out = []
    for depth in range(1, DEPTH + 1):
        first = np.flatnonzero(_changes(columns[:depth]))
        total = np.add.reduceat(counts, first)
        keep = columns[depth - 1][first] != 0  # a suffix that ended earlier has no node here
        if depth >= whole:
            keep &= total >= least
        for *ids, n in zip(*[c[first][keep].tolist() for c in columns[:depth]], total[keep].tolist()):
            out.append((b" ".join([words[i] for i in ids]), depth, n))
    return out


def _subtrees(groups: DataFrame, least: int, whole: int) -> DataFrame:
    """``lang, phrase, words, f`` of every group (``lang, bucket, sub``)."""

    def build(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        found = nodes(*merged(data.column("run").to_pylist()), least, whole)
        phrases = [p.decode("utf-8") for p, _, _ in found]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(found), pa.string()), pa.array(phrases, pa.string()),
                                     pa.array([d for _, d, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int64())], names=["lang", "phrase", "words", "f"])

    return groups.select("lang", "bucket", "sub", "run").groupBy("lang", "bucket", "sub").applyInArrow(build, "lang string, phrase string, words int, f long")


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``DEPTH`` words seen ``least`` times, and ``lang, n`` (all words)."""
    known = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANG)).alias("_lang"), "text")
    letters = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-letters // (4 * budget)))  # a word has four letters or more as a rule; crowded buckets are split below
    runs = cut(_runs(known, buckets))
    totals = runs.groupBy("lang").agg(F.sum("total").alias("n"))
    load = cut(runs.groupBy("lang", "bucket").agg(F.sum("n").alias("_load")))
    parts = F.ceil(F.col("_load") / budget).cast("long")
    crowded = load.filter(F.col("_load") > budget)
    fit = runs.join(crowded, ["lang", "bucket"], "left_anti").withColumn("sub", F.lit(-1).cast("long"))
    found = _subtrees(fit, least, 1)
    by_two = cut(_lengthened(runs.join(crowded.select("lang", "bucket", (2 * parts).alias("_parts")), ["lang", "bucket"]), 2))
    load_two = by_two.groupBy("lang", "bucket", "sub").agg(F.sum("n").alias("_load"))
    still = cut(load_two.filter(F.col("_load") > budget).select("lang", "bucket", F.col("sub").alias("_sub"), (2 * parts).alias("_parts")))
    fit_two = by_two.join(still.withColumnRenamed("_sub", "sub"), ["lang", "bucket", "sub"], "left_anti")
    # the last prefix is the whole suffix: equal ones meet, and all others part. Sub-groups get names that no other group has
    rest = by_two.join(still.withColumnRenamed("_sub", "sub"), ["lang", "bucket", "sub"])
    by_three = _lengthened(rest.withColumn("bucket", F.col("bucket") * F.lit(1_000_003) + F.col("sub")), DEPTH)
    split = cut(_subtrees(fit_two, least, 2).unionByName(_subtrees(by_three, least, DEPTH)))
    summed = split.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return cut(found.unionByName(summed).filter(F.col("f") >= least)), totals


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (left right))`` in whole decimals: exact for counts below 10^15."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, covered: int = 50, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``first`` phrases of each language of ``docs`` (``lang, text``).

    ``a, l, r`` are the frequencies of a phrase and of the two parts of its weakest cut; ``n`` counts the words of the language. Phrases
    inside a longer one that makes up ``covered`` percent of their occurrences are left out. Null texts have no words, null languages are ``und``,
    repeated rows count as often as they occur, ties go by frequency and then by the bytes of the phrase; without phrases the result is empty.
    """
    counted, totals = phrase_counts(docs, least, budget)
    part = lambda k: F.array_join(F.slice("_w", 1, k), " ")
    rest = lambda k: F.array_join(F.slice("_w", k + 1, DEPTH), " ")
    candidates = counted.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = candidates.select("lang", "phrase", "words", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.col("k")).alias("_left"), rest(F.col("k")).alias("_right"))
    for name, side in (("l", "_left"), ("r", "_right")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("_best"))
    # a candidate of two words goes if a longer one with it has its share of occurrences
    longer = candidates.filter(F.col("words") == DEPTH).select("lang", F.col("a").alias("_f"), F.explode(F.array_distinct(F.array(
        F.array_join(F.slice("_w", 1, 2), " "), F.array_join(F.slice("_w", 2, 2), " ")))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    own = (scored.join(most, ["lang", "phrase"], "left").filter((F.col("words") == DEPTH) | F.col("_f").isNull() | (100 * F.col("_f") < covered * F.col("a")))
           .select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[.,;:!?\n\x0B\f\r]')) as piece from documents),
 words as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
 totals as (select lang, sum(len(w)) as n from words group by lang),
 runs as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 4) t(k) where len(w) >= k)),
 f as (select lang, phrase, k, count(*) as f from runs group by all having count(*) >= 10),
 cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1),
 cuts as (select c.lang, c.phrase, c.k, c.a, cut, l.f as l, r.f as r, cast(1000000 as hugeint) * c.a * c.a // (cast(l.f as hugeint) * r.f) as score
   from (select *, unnest(range(1, k)) as cut from cand) c
   join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:], ' ')),
 scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 inside as (select distinct t.lang, p.phrase from cand t join cand p on p.lang = t.lang and p.k = 2 and (p.phrase = array_to_string(t.w[1:2], ' ') or p.phrase = array_to_string(t.w[2:3], ' '))
   where t.k = 3 and 100 * t.a >= 50 * p.a),
 kept as (select s.* from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase where i.phrase is null)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang) where rank <= 2000
"""
