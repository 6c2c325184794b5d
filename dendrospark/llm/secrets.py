"""Secret scan with linking of multipart credentials.

Certain findings (``assign``, ``access``, ``hex``) stand alone. Uncertain parts do not: a login name, an opaque token or an
endpoint is reported only when the parts that complete a credential lie near it. Parts are rows (document, scope, start,
end, role); a scope is a block of lines between blank lines. The interval join runs as a sweep: within a scope, ordered by
start, the furthest end among earlier parts and the nearest start among later parts of a role decide whether one lies within
``reach`` characters. It gives what the join of all near pairs would give, without listing pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import batches, table, with_row_key
from dendrospark.session import cut

# The three patterns of certain findings, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")

LOGIN = re.compile(r"""(?<![A-Za-z0-9_])(?ai:user_?name|user|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
                   r"""[A-Za-z0-9._@+-]{3,}""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_.-])")
ENDPOINT = re.compile(r"""(?ai:https?|jdbc:[a-z0-9]+|redis|amqps?|mongodb|postgres(?:ql)?|mysql|ftps?)://[^\s"'<>]+"""
                      r"""|(?<![A-Za-z0-9.@-])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:[0-9]{2,5}(?![0-9])""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

#: Parts of a credential. Certain findings complete uncertain ones.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "opaque": "secret", "endpoint": "endpoint"}
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_LOGIN_HINTS = (b"user", b"login", b"client", b"account", b"access")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def opaque(token: str) -> bool:
    """Mixed letters and digits without the regularity of a word or a path."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and _entropy(token) >= 3.2


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of certain findings, leftmost without overlap within a kind. The byte tests only skip texts that cannot match."""
    low = text.encode("utf-8", "replace").lower() if low is None else low
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """Uncertain parts that do not overlap one another's kind."""
    found = []
    if any(h in low for h in _LOGIN_HINTS):
        found += [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if opaque(m.group())]
    if b":" in low:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return found


def parts_of(text: str | None) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, scope)`` of all parts. An uncertain part inside a certain finding is that finding."""
    if not text:
        return []
    low = text.encode("utf-8", "replace").lower()
    base = base_spans(text, low)
    weak = weak_spans(text, low)
    if weak and base:
        weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    if not weak:
        return [(*b, 0) for b in base]  # nothing to link
    blocks = [m.start() for m in BLANK.finditer(text)]
    return [(s, k, e, bisect_right(blocks, s)) for s, k, e in sorted(base + weak)]


_PART = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))


def find_parts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_parts``: all parts of every text. Column names of ``docs`` must not start with an underscore."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_parts", T.ArrayType(
        T.StructType([T.StructField(f, T.IntegerType()) for f in ("start", "kind", "end", "scope")])))])

    def scan(rows):
        for part, (texts,) in batches(rows, ["text"]):
            found = [[dict(zip(("start", "kind", "end", "scope"), p)) for p in parts_of(t)] for t in texts]
            yield part.append_column("_parts", pa.array(found, _PART))

    return docs.mapInArrow(scan, schema)


def _near(role: str, reach: int) -> Column:
    """Whether another part of that role lies within ``reach`` characters in the same scope."""
    within = Window.partitionBy("_rid", "scope").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("role") == role, F.col("end"))).over(within.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("role") == role, F.col("start"))).over(within.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("end") <= reach, F.lit(False))


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """``_rid, added``: uncertain parts whose complement is near. ``parts``: one row per part."""
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])])
    rows = parts.withColumn("role", role[F.col("kind")])
    seen = rows.select("_rid", "start", "kind", "end", "role", *[_near(r, reach).alias(f"near_{r}") for r in ("identifier", "secret")])
    complete = (F.when(F.col("role") == "identifier", F.col("near_secret")).when(F.col("role") == "secret", F.col("near_identifier"))
                .otherwise(F.col("near_identifier") & F.col("near_secret")))
    return seen.filter((F.col("kind") >= 3) & complete).groupBy("_rid").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def scan_secrets(docs: DataFrame, reach: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``spans`` (array of start, kind, end; sorted) and ``base`` (the certain ones).

    One row per row of ``docs``. Null and empty texts have no findings; offsets are code points, ends exclusive. Texts are
    read whole. Repeated rows and null ids are kept as they are; an empty table gives an empty result.
    """
    wanted = ["doc_id", *[c for c in keep if c not in ("doc_id", "text")]]
    found = find_parts(docs.select(*wanted, "text"))
    found = cut(with_row_key(found if "text" in keep else found.drop("text")))
    lonely = F.size(F.filter("_parts", lambda p: p["kind"] >= 3)) == 0
    added = linked(found.filter(~lonely).select("_rid", F.inline("_parts")), reach)
    base = F.transform(F.filter("_parts", lambda p: p["kind"] < 3), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return (found.withColumn("base", F.sort_array(base)).join(added, "_rid", "left")
            .withColumn("spans", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))
            .drop("_rid", "_parts", "added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` (overlapping ones by one mark) and ``n_chars`` counted anew.

    Rows without findings come back unchanged; no row is dropped. Null texts stay null.
    """
    packed = docs.select("doc_id", "text", F.struct("*").alias("_payload"))
    known = scan_secrets(packed, reach, keep=("_payload",))
    # Cut from the left: the state is the text so far and the end of the last finding.
    text = F.col("_payload.text")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        gap = F.greatest(x["start"] - s["at"], F.lit(0))
        fresh = x["start"] >= s["at"]
        return F.struct(
            F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, gap), F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(x["end"], s["at"]).alias("at"))

    new = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    hit = known.filter(F.size("spans") > 0).withColumn("_new", new)
    payload = F.col("_payload").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        payload = payload.withField("n_chars", F.length("_new").cast(docs.schema["n_chars"].dataType))
    clean = known.filter(F.size("spans") == 0)
    return clean.select("_payload.*").unionByName(hit.select(payload.alias("_payload")).select("_payload.*"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings of every document: counts and checksum of the certain ones, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_linked"))
