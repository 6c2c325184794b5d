"""Packing along a space-filling curve: similar documents share sequences, and hardly a token is padded.

A document is tokenised and its token counts are hashed to a vector, projected to few dimensions; the place of that point on the
Hilbert curve is its key. Documents sorted by key form one stream of tokens, which is cut every ``length`` tokens. Where a
document lies in the stream is a running total over range partitions, so no task sees more than its range, and ties (copies) are
split by id and row. Only the last sequence is not full.

With a ``stretch`` the mix of sources comes first: the mixed order is cut every ``stretch`` documents, and only within a stretch
documents follow the curve. So every stretch of sequences holds the sources by their weights.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import batches, table, with_row_key
from dendrospark.llm.mixing import mixed
from dendrospark.operators.ordering import running_total
from dendrospark.session import cut

LENGTH = 2048
STRETCH = 1024  #: documents of the mixed order that the pipeline sorts along the curve
END = 1  #: id that closes every document
HASHED, DIMS, BITS = 512, 4, 12
CACHE = 400_000  #: runs whose ids a worker remembers


_SIGNS = re.compile(rb"([!-/:-@\[-`{-~]+)")
_OTHER_SIGNS = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]|[^\x00-\x7F\w]")

# The characters that stand for bytes in byte-level vocabularies (printable bytes for themselves, the others from 256 on).
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Known(dict):
    """Ids of the runs met so far; a run not met before is encoded when it is looked up."""

    def __init__(self, ids):
        super().__init__()
        self._ids = ids

    def __missing__(self, run: bytes) -> bytes:
        coded = self[run] = array("H", self._ids(run)).tobytes()
        return coded


class Encoder:
    """Ids of texts by a tokenizer file.

    The tokenizers used here never merge across white space, nor across the end of a run of letters or of signs, so the ids of a text are
    those of its runs one after the other; runs repeat, so their ids are remembered. A run of letters is one call of the merge model, all
    else goes through the whole tokenizer. (Held to whole-text encoding by tests.)
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self._ids)

    @staticmethod
    def runs(text: str | None) -> list[bytes]:
        """Pieces that can be encoded one by one. Signs are set apart and letters A-Z lowered only where that cannot change an id."""
        if not text:
            return []
        if "'" in text or "<|" in text or _OTHER_SIGNS.search(text):
            return text.encode("utf-8", "replace").split()
        return _SIGNS.sub(rb" \1 ", text.encode("utf-8", "replace").lower()).split()

    def _ids(self, run: bytes) -> list[int]:
        if run.isalpha():
            return [t.id for t in self.model.tokenize(run.lower().decode("ascii"))]
        text = run.decode("utf-8")
        if text.isalpha():
            low = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
            if low.isalpha():
                return [t.id for t in self.model.tokenize("".join([_BYTE_SIGNS[b] for b in low.encode("utf-8")]))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of every text and the closing id."""
        if len(self.known) > CACHE:
            self.known.clear()
        end, ids = array("H", [END]).tobytes(), self.known.__getitem__
        return [b"".join([*map(ids, self.runs(t)), end]) for t in texts]


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this worker: its tasks share the tokenizer and the ids of the runs met so far."""
    return Encoder(path)


def projection(vocabulary: int = 65536, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and sign of every id, and the matrix from slots to ``DIMS`` coordinates."""
    draw = np.random.default_rng(seed)
    return (draw.integers(0, HASHED, vocabulary), draw.choice([-1.0, 1.0], vocabulary), draw.standard_normal((HASHED, DIMS)))


def coordinates(ids: np.ndarray, slot: np.ndarray, sign: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Whole coordinates in ``0 .. 2^BITS - 1`` of one document."""
    vector = np.bincount(slot[ids], weights=sign[ids], minlength=HASHED)
    vector = np.sign(vector) * np.sqrt(np.abs(vector))
    norm = math.sqrt(float(vector @ vector))
    point = (vector / norm if norm else vector) @ matrix
    return np.floor((np.tanh(point) + 1.0) / 2.0 * ((1 << BITS) - 1) + 0.5).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point (rows of whole coordinates) on the Hilbert curve of its cube.

    From the highest bit down, every axis either reflects or exchanges the lower bits of the first axis; a Gray code over all
    axes then gives the key, whose bits are taken axis by axis from the highest.
    """
    x = points.T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for axis in range(dims):
            set_ = (x[axis] & top) != 0
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(set_, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def tokenised(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``_ids`` (16-bit ids), ``_n`` (how many) and ``_key`` (place on the curve) of every row."""
    own = ["doc_id", *keep]
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("_ids", T.BinaryType()), T.StructField("_n", T.LongType()), T.StructField("_key", T.LongType())])

    def encode(rows):
        coder, (slot, sign, matrix) = encoder(path), projection()
        for part, (_, texts) in batches(rows, ["doc_id", "text"], 256):
            coded = coder.encode(texts)
            points = [coordinates(np.frombuffer(c, "<u2"), slot, sign, matrix) for c in coded]
            keys = hilbert_keys(np.array(points).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(c)) for c in own], pa.array(coded, pa.binary()), pa.array([len(c) // 2 for c in coded], pa.int64()), pa.array(keys, pa.int64())],
                names=[*own, "_ids", "_n", "_key"])

    return docs.select(*own, "text").mapInArrow(encode, schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, stretch: int | None = None, place_col: str | None = None) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: one row per piece of a document in a sequence.

    ``ids`` are the piece's tokens as little-endian 32-bit numbers; a sequence is its pieces by ``offset``. Null and empty texts are
    the closing id alone. With a ``stretch`` the rows are taken in stretches of that many places in the mix; ``place_col`` holds the
    place of each row, and without it they are mixed here. Repeated rows and null ids are packed as they are; an empty table gives no pieces.
    """
    if length < 1:
        raise ValueError("sequences hold one token at least")
    coded = cut(with_row_key(tokenised(docs, path, () if stretch is None else (place_col or "source",))))
    order = [F.col("_key"), F.col("doc_id"), F.col("_rid")]
    narrow = coded.select("_key", "doc_id", "_rid", "_n")
    if stretch is not None:
        at = F.floor(F.col(place_col or "position") / int(stretch)).alias("_stretch")
        if place_col is None:
            place = mixed(coded.select("doc_id", "source", "_rid"), keep_row=True)
            narrow = narrow.join(place.select("_rid", at), "_rid")
        else:
            narrow = coded.select("_key", "doc_id", "_rid", "_n", at)
        order = [F.col("_stretch"), *order]
    placed = running_total(narrow, order, "_n", "_end").select("_rid", (F.col("_end") - F.col("_n")).alias("_at"))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])

    def pieces(rows):
        for part, (ats, all_ids) in batches(rows, ["_at", "_ids"], 256):
            own = part.column(part.schema.get_field_index("doc_id"))
            row, start, size, total, seq, off, out = [], [], [], [], [], [], []
            for i, (at, packed) in enumerate(zip(ats, all_ids)):
                ids = np.frombuffer(packed, "<u2").astype("<u4")
                done = 0
                while done < len(ids):
                    sequence, offset = divmod(at + done, length)
                    take = min(length - offset, len(ids) - done)
                    row.append(i), start.append(done), size.append(take), total.append(len(ids)), seq.append(sequence), off.append(offset)
                    out.append(ids[done: done + take].tobytes())
                    done += take
            numbers = [pa.array(c, pa.int64()) for c in (start, size, total, seq, off)]
            yield pa.RecordBatch.from_arrays([own.take(pa.array(row, pa.int64())), *numbers, pa.array(out, pa.binary())], names=[f.name for f in schema.fields])

    return coded.join(placed, "_rid").select("doc_id", "_at", "_ids").mapInArrow(pieces, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with a checksum of each piece's ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
