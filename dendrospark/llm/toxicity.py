"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: one of the word (hashed) and one of its characters (mean over hashed character n-grams). A window
of ``WINDOW`` words runs through a gated recurrent unit in both directions; attention weighs the states, and a logistic unit reads
the weighted mean. Windows overlap by half and cover every word; a document is as toxic as its most toxic window.

The network is fitted on a bounded sample of labelled rows: ``SAMPLE`` documents of each class and at most ``PER_DOC`` evenly spaced windows
of each. A label says that some window is toxic, not which: after the first round, the half of the windows of a toxic document
that looks cleaner is left out. A fifth of the sample only sets the threshold. Scoring covers every window of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import batches, table

WINDOW, STRIDE = 32, 16
SAMPLE, PER_DOC = 700, 16
BUCKETS, DIM, HIDDEN = 1 << 16, 12, 8
ROUNDS, STEPS, BATCH, SEED = 6, 30, 512, 3  #: steps: least number in a round
DECAY = 1e-4  #: of all weights per step
COMMON = 4  #: documents of the sample in which a word or n-gram must occur to count
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/"


def words_of_text(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w.strip(EDGES) or w for w in text.lower().split()] if text else []


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover ``n`` words."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _bucket(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) % BUCKETS


def features(word: str) -> tuple[int, list[int]]:
    """Bucket of the word, buckets of its character n-grams (three letters, longer ones at its ends, ends marked)."""
    marked = f"^{word}$"
    grams = {marked[i: i + 3] for i in range(max(1, len(marked) - 2))} | {marked[:4], marked[:5], marked[-4:]}
    return _bucket("w" + word), [_bucket(g) for g in sorted(grams)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fresh_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"word": normal(BUCKETS, DIM), "char": normal(BUCKETS, DIM) * 20}
    for d in "fb":
        w |= {f"in_{d}": normal(2 * DIM, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"gate_{d}": normal(HIDDEN, 2 * HIDDEN), f"new_{d}": normal(HIDDEN, HIDDEN)}
    return w | {"key": normal(2 * HIDDEN, HIDDEN), "key_bias": np.zeros(HIDDEN, np.float32), "query": normal(HIDDEN, 1)[:, 0],
                "out": normal(2 * HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32)}


def run_direction(steps: np.ndarray, mask: np.ndarray, gate: np.ndarray, new: np.ndarray, keep: bool = False):
    """States ``(time, batch, hidden)`` from gate inputs ``(time, batch, 3 hidden)``; with ``keep`` also what the way back needs."""
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    states, saved = np.empty((*steps.shape[:2], HIDDEN), np.float32), []
    for t in range(len(steps)):
        zr = _sigmoid(steps[t, :, : 2 * HIDDEN] + h @ gate)
        z, r = zr[:, :HIDDEN] * mask[t, :, None], zr[:, HIDDEN:]
        n = np.tanh(steps[t, :, 2 * HIDDEN:] + (r * h) @ new)
        if keep:
            saved.append((h, zr, z, r, n))
        h = h + z * (n - h)
        states[t] = h
    return (states, saved) if keep else states


def attend(states: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]):
    """Logit of each window, the keys, attention weights and pooled states."""
    keys = np.tanh(states @ w["key"] + w["key_bias"])
    score = np.where(mask > 0, keys @ w["query"], -1e9)
    score = np.exp(score - score.max(axis=0))
    weight = score / score.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ w["out"] + w["out_bias"][0], keys, weight, pooled


def _back_direction(grad: np.ndarray, saved: list, mask: np.ndarray, gate: np.ndarray, new: np.ndarray):
    """Gradients of the gate inputs and of both recurrent matrices."""
    d_steps = np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32)
    d_gate, d_new, carry = np.zeros_like(gate), np.zeros_like(new), np.zeros_like(grad[0])
    for t in range(len(grad) - 1, -1, -1):
        h, zr, z, r, n = saved[t]
        d = grad[t] + carry
        d_n = d * z * (1 - n * n)
        d_z = d * (n - h) * mask[t, :, None] * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN])
        back = d_n @ new.T
        d_r = back * h * r * (1 - r)
        d_zr = np.concatenate([d_z, d_r], axis=1)
        d_steps[t, :, : 2 * HIDDEN], d_steps[t, :, 2 * HIDDEN:] = d_zr, d_n
        d_gate += h.T @ d_zr
        d_new += (r * h).T @ d_n
        carry = d * (1 - z) + back * r + d_zr @ gate.T
    return d_steps, d_gate, d_new


class Vocabulary:
    """Features of the distinct words of a sample: word buckets, and n-gram buckets in one flat list."""

    def __init__(self, windows: list[list[str]]):
        self.place: dict[str, int] = {}
        for window in windows:
            for word in window:
                self.place.setdefault(word, len(self.place))
        found = [features(word) for word in self.place]
        self.word = np.array([f[0] for f in found] + [0])
        self.char = np.array([g for f in found for g in f[1]] + [0])
        self.size = np.array([len(f[1]) for f in found] + [1])
        self.owner = np.repeat(np.arange(len(self.size)), self.size)

    def matrix(self, windows: list[list[str]]) -> np.ndarray:
        """Word numbers, padded with -1."""
        out = np.full((len(windows), WINDOW), -1, np.int64)
        for i, window in enumerate(windows):
            out[i, : len(window)] = [self.place[w] for w in window]
        return out

    def inputs(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """Input vector of every word; the last row is for padding."""
        chars = np.add.reduceat(w["char"][self.char], np.r_[0, np.cumsum(self.size)[:-1]], axis=0) / self.size[:, None]
        return np.concatenate([w["word"][self.word], chars], axis=1).astype(np.float32)

    def part(self, index: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
        """The words of some windows alone, and the windows by their new numbers."""
        used, new = np.unique(np.where(index < 0, len(self.word) - 1, index), return_inverse=True)
        out = Vocabulary.__new__(Vocabulary)
        first = np.cumsum(self.size) - self.size
        out.size = np.append(self.size[used], 1)
        out.word = np.append(self.word[used], 0)
        flat = np.repeat(first[used] - np.r_[0, np.cumsum(self.size[used])[:-1]], self.size[used]) + np.arange(self.size[used].sum())
        out.char = np.append(self.char[flat], 0)
        out.owner = np.repeat(np.arange(len(out.size)), out.size)
        return out, np.where(index < 0, -1, new.reshape(index.shape))


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


def _gradients(w: dict, inputs: np.ndarray, index: np.ndarray, label: np.ndarray, drop: np.ndarray):
    """Loss gradients of one batch, and the gradient of the input vectors by word."""
    mask = (index.T >= 0).astype(np.float32)
    x = inputs[index.T] * drop
    runs = {}
    for d, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
        steps = (x @ w[f"in_{d}"] + w[f"bias_{d}"])[turn]
        runs[d] = run_direction(steps, mask[turn], w[f"gate_{d}"], w[f"new_{d}"], keep=True)
    states = np.concatenate([runs["f"][0], runs["b"][0][::-1]], axis=2)
    logit, keys, weight, pooled = attend(states, mask, w)
    d_logit = (_sigmoid(logit) - label) / len(label)
    g = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["out"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_keys = d_score[:, :, None] * w["query"] * (1 - keys * keys)
    g["query"] = (keys * d_score[:, :, None]).sum(axis=(0, 1))
    g["key"] = _outer(states, d_keys)
    g["key_bias"] = d_keys.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pooled + d_keys @ w["key"].T
    d_x = np.zeros_like(x)
    for d, turn, part in (("f", slice(None), slice(0, HIDDEN)), ("b", slice(None, None, -1), slice(HIDDEN, None))):
        d_steps, g[f"gate_{d}"], g[f"new_{d}"] = _back_direction(d_states[turn][:, :, part], runs[d][1], mask[turn], w[f"gate_{d}"], w[f"new_{d}"])
        d_steps = d_steps[turn]
        g[f"in_{d}"], g[f"bias_{d}"] = _outer(x, d_steps), d_steps.sum(axis=(0, 1))
        d_x += d_steps @ w[f"in_{d}"].T
    return g, d_x * drop * mask[:, :, None], index.T


def train(windows: list[list[str]], doc: np.ndarray, toxic: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights, and ``shift``: the logit above which a document counts as toxic. ``toxic``: label of each window's document."""
    w, draw = fresh_weights(seed), np.random.default_rng(seed)
    words = Vocabulary(windows)
    index = words.matrix(windows)
    label = toxic.astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    apart = doc % 5 == 0  # documents that set the threshold
    common = _common_buckets(words, index[~apart], doc[~apart])
    for k in ("word", "char"):
        w[k] *= common[k][:, None]
    step, used = 0, np.flatnonzero(~apart)
    for turn in range(ROUNDS):
        if turn:  # a toxic document need not be toxic all over: go on with the half of its windows that looks more so
            logit = window_logits(w, words.inputs(w), index)
            used = np.flatnonzero(~apart & ((label == 0) | _upper_half(doc, logit)))
        passes = max(1, -(-STEPS * BATCH // max(1, len(used))))
        order = np.concatenate([draw.permutation(used) for _ in range(passes)])
        for at in range(0, len(order), BATCH):
            pick = order[at: at + BATCH]
            drop = np.ones((WINDOW, len(pick), 2 * DIM), np.float32)
            drop[:, :, :DIM] *= (draw.random((WINDOW, len(pick), 1)) > 0.5)  # characters alone must do half of the time
            own, local = words.part(_with_runs(index[pick], label[pick], draw))
            inputs = own.inputs(w)
            g, d_x, place = _gradients(w, inputs, local, label[pick], drop)
            by_word = np.zeros_like(inputs)
            np.add.at(by_word, place.ravel(), d_x.reshape(-1, 2 * DIM))
            g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
            np.add.at(g["word"], own.word, by_word[:, :DIM])
            np.add.at(g["char"], own.char, (by_word[:, DIM:] / own.size[:, None])[own.owner].astype(np.float32))
            for k in ("word", "char"):
                g[k] *= common[k][:, None]
            step += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                w[k] = (w[k] * (1 - DECAY) - rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    logit, at = window_logits(w, words.inputs(w), index), apart if apart.any() else ~apart
    best = np.full(doc.max() + 1, -np.inf)
    np.maximum.at(best, doc[at], logit[at])
    of_doc = np.zeros(len(best), bool)
    of_doc[doc[toxic > 0]] = True
    seen = np.isfinite(best)
    w["shift"] = np.array([_threshold(best[seen], of_doc[seen])], np.float32)
    return w


def _common_buckets(words: Vocabulary, index: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """Buckets met in ``COMMON`` documents or more. Others stay zero: what is rare would be learnt by heart, not understood."""
    pairs = np.unique(np.stack([np.repeat(doc, index.shape[1]), index.ravel()]), axis=1)
    pairs = pairs[:, pairs[1] >= 0]
    first = np.cumsum(words.size) - words.size
    size = words.size[pairs[1]]
    flat = np.repeat(first[pairs[1]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    met = {"word": (pairs[0], words.word[pairs[1]]), "char": (np.repeat(pairs[0], size), words.char[flat])}
    once = {k: np.unique(d.astype(np.int64) * BUCKETS + b) % BUCKETS for k, (d, b) in met.items()}
    return {k: (np.bincount(b, minlength=BUCKETS) >= COMMON).astype(np.float32) for k, b in once.items()}


def _with_runs(index: np.ndarray, label: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Some windows of clean documents as runs of a few of their words: saying a harmless word often does not make it toxic."""
    out = index.copy()
    for run in (4, 8, 16, 32):
        rows = np.flatnonzero((label == 0) & (draw.random(len(label)) < 0.08))
        source = np.arange(WINDOW) // run * run
        new = index[rows][:, source]
        out[rows] = np.where(index[rows] < 0, -1, new)
    return out


def _upper_half(doc: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Windows in the higher half of those of their document (the middle one included)."""
    order = np.lexsort((-logit, doc))
    size = np.bincount(doc)
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - (np.cumsum(size) - size)[doc[order]]
    return 2 * rank < size[doc]


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap that separates the classes best (equal weight for both)."""
    order = np.argsort(score)
    s, y = score[order], toxic[order]
    if not y.any() or y.all():
        return 0.0
    right = np.cumsum(~y) / (~y).sum() - np.cumsum(y) / y.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((s[best[0]] + s[min(best[-1] + 1, len(s) - 1)]) / 2.0)


def projected(w: dict, inputs: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions for each word; this part of the network does not depend on the place of a word."""
    return np.concatenate([inputs @ w["in_f"] + w["bias_f"], inputs @ w["in_b"] + w["bias_b"]], axis=1)


def logits(w: dict, gates: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logit of each window, given the gate inputs of the words that ``index`` numbers (-1: padding)."""
    mask = np.ascontiguousarray((index.T >= 0).astype(np.float32))
    steps = gates[index.T]
    ahead = run_direction(steps[:, :, : 3 * HIDDEN], mask, w["gate_f"], w["new_f"])
    behind = run_direction(steps[::-1, :, 3 * HIDDEN:], mask[::-1], w["gate_b"], w["new_b"])[::-1]
    return attend(np.concatenate([ahead, behind], axis=2), mask, w)[0]


def window_logits(w: dict, inputs: np.ndarray, index: np.ndarray, most: int = 2048) -> np.ndarray:
    gates = projected(w, inputs)
    return np.concatenate([logits(w, gates, index[at: at + most]) for at in range(0, len(index), most)] or [np.empty(0)])


class Scorer:
    """Scores texts; remembers the gate inputs of words it has met."""

    def __init__(self, weights: dict[str, np.ndarray], most: int = 200_000):
        self.w, self.most = weights, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn(self, new: list[str]) -> None:
        found = [features(word) for word in new]
        size = np.array([len(f[1]) for f in found])
        flat = np.array([g for f in found for g in f[1]])
        chars = np.add.reduceat(self.w["char"][flat], np.r_[0, np.cumsum(size)[:-1]], axis=0) / size[:, None]
        gates = projected(self.w, np.concatenate([self.w["word"][[f[0] for f in found]], chars], axis=1).astype(np.float32))
        start = len(self.place)
        while len(self.gates) < start + len(new) + 1:
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        self.gates[start: start + len(new)] = gates
        self.place.update((word, start + i) for i, word in enumerate(new))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Score of each text: the greatest over all its windows; without words, what the network says to nothing."""
        split = [words_of_text(t) for t in texts]
        if len(self.place) > self.most:
            self.forget()
        new = list({w for words in split for w in words} - self.place.keys())
        if new:
            self.learn(new)
        best = np.full(len(texts), -np.inf)
        pieces, owner = [], []
        for i, words in enumerate(split):
            if words:
                ids = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                starts = window_starts(len(ids))
                if len(ids) < WINDOW:
                    ids = np.append(ids, np.full(WINDOW - len(ids), -1))
                pieces.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
                owner.append(np.full(len(starts), i))
        if pieces:
            index, own = np.concatenate(pieces), np.concatenate(owner)
            for at in range(0, len(index), 2048):
                np.maximum.at(best, own[at: at + 2048], logits(self.w, self.gates, index[at: at + 2048]))
        best = np.where(np.isfinite(best), best, self.w["out_bias"][0] - 4.0)
        return _sigmoid(best - self.w["shift"][0]).astype(float).tolist()


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never used for learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_sample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights from at most ``SAMPLE`` labelled documents of each class that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # bounded by SAMPLE, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def spaced(rows):
        for _, (ids, texts, labels_) in batches(rows, ["doc_id", "text", "toxic"], 64):
            own, out, label = [], [], []
            for i, text, y in zip(ids, texts, labels_):
                words = words_of_text(text)
                starts = window_starts(len(words))
                for s in starts[np.unique(np.linspace(0, len(starts) - 1, min(PER_DOC, len(starts))).round().astype(int))] if len(starts) else []:
                    own.append(i), out.append(words[s: s + WINDOW]), label.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(out, pa.list_(pa.string())), pa.array(label, pa.int64())], names=["doc_id", "w", "y"])

    rows = chosen.select(F.col("doc_id").cast("bigint"), "text", F.col("toxic").cast("bigint")).mapInArrow(spaced, "doc_id long, w array<string>, y long").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["w"]))
    if not rows:
        return fresh_weights(seed) | {"shift": np.array([30.0], np.float32)}
    doc = np.unique([r["doc_id"] for r in rows], return_inverse=True)[1]
    return train([r["w"] for r in rows], doc, np.array([r["y"] for r in rows]), seed)


def score_toxicity(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, score, predicted`` for every row. Null, empty and blank texts get the score of no words; repeated rows stay."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    weights = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def score(rows):
        scorer = Scorer(weights.value)
        for part, (_, texts) in batches(rows, ["doc_id", "text"], 128):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(scorer.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document."""
    docs = table(spark, sf_dir, "documents")
    weights = fit_on_sample(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, weights).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
