"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Background label, mark between a label and its split suffix.
BACKGROUND = "0"
PSEUDO_SEP = "#"


def to_voxel(anisotropy: tuple[float, float, float], x: str = "x", y: str = "y", z: str = "z") -> dict[str, Column]:
    """Micron coordinates to voxel indices, reversed to z, y, x order."""
    ax, ay, az = anisotropy
    return {
        "vz": F.round(F.col(z) / F.lit(float(az))).cast("int"),
        "vy": F.round(F.col(y) / F.lit(float(ay))).cast("int"),
        "vx": F.round(F.col(x) / F.lit(float(ax))).cast("int"),
    }


def segment_id(swc_id: Column | str) -> Column:
    """Text before the first dot of an SWC id."""
    return F.substring_index(swc_id, ".", 1)


def annotator(neuron: Column | str) -> Column:
    """Last dash-separated part of a neuron name."""
    return F.element_at(F.split(neuron, "-"), -1)


def neuron_key(brain: Column | str, neuron: Column | str) -> Column:
    return F.concat_ws(":", brain, neuron)


def raw_label(label: Column | str) -> Column:
    """The segment a label or pseudo-label came from."""
    return F.substring_index(label, PSEUDO_SEP, 1)


def dot(a: str, b: str) -> Column:
    """Dot product of two vectors stored as ``<prefix>x, <prefix>y, <prefix>z``."""
    return sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in "xyz"), F.lit(0.0))


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def angle_deg(a: str, b: str) -> Column:
    """Angle between two vectors in degrees; NULL when one has no length."""
    length = norm(a) * norm(b)
    cosine = F.when(length > 0, dot(a, b) / length)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * F.when(cosine.isNotNull(), 1.0)


def radius_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller mean radius; NULL unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def belief_label(p: Column) -> Column:
    # fixed values: thresholds and names
    return (F.when(p.isNull(), "Unknown").when(p >= 0.80, "Likely True").when(p >= 0.60, "Leaning True")
            .when(p > 0.40, "Uncertain").when(p > 0.20, "Leaning False").otherwise("Likely False"))


def direction(prior: Column, posterior: Column) -> Column:
    delta = posterior - prior
    return (F.when(delta.isNull(), "Unknown").when(delta > 0.02, "Positive").when(delta < -0.02, "Negative")
            .otherwise("Neutral"))


def run_timestamp(run_id: Column) -> Column:
    """Start time from a run folder name ``<brain>_<yyyyMMdd>_<HHmmss>``."""
    return F.try_to_timestamp(F.regexp_extract(run_id, r"_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def base26_suffix(index: Column) -> Column:
    """0 -> a, 25 -> z, 26 -> aa, ...; an index that needs more than six letters fails the query."""
    def letter(n):
        return F.char(F.lit(97) + (n % 26).cast("int"))

    out = letter(index)
    rest = F.floor(index / 26) - 1
    for _ in range(5):
        out = F.when(rest >= 0, F.concat(letter(rest), out)).otherwise(out)
        rest = F.floor(rest / 26) - 1
    return F.when(rest >= 0, F.raise_error(F.lit("suffix index too large")).cast("string")).otherwise(out)
