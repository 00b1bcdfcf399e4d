"""Scalar expressions of the point-table pipeline. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------- keys and ids


def stem(path: Column) -> Column:
    """File name without folders and its last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")


def strip_chain(name: Column) -> Column:
    """Drops a last ``_`` token of one or two letters."""
    return F.regexp_replace(name, r"_[A-Za-z]{1,2}$", "")


def embedding_key(name: Column) -> tuple[Column, Column]:
    """(protein id, chain hint) as embedding files name them: a chain token, else an upper-case last letter of a name without ``_``."""
    token = F.regexp_extract(name, r"_([A-Za-z]{1,2})$", 1)
    glued = ~name.contains("_") & name.rlike(r"[A-Z]$") & (F.length(name) > 1)
    chain = F.when(token != "", token).when(glued, F.right(name, F.lit(1)))
    base = F.when(token != "", F.regexp_replace(name, r"_[A-Za-z]{1,2}$", "")).when(glued, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)
    return F.lower(base), chain


def protein_key(protein: Column, chain: Column, upper: bool = True) -> Column:
    """``<protein lower>_<chain>``; the chain upper-case, or as it is."""
    return F.concat(F.lower(protein), F.lit("_"), F.upper(chain) if upper else chain)


def key_of_residue_id(residue_id: Column) -> Column:
    """``pid:chain:num`` to ``<pid lower>_<chain>``."""
    parts = F.split(residue_id, ":")
    return F.concat(F.lower(F.try_element_at(parts, F.lit(1))), F.lit("_"), F.try_element_at(parts, F.lit(2)))


def residue_id(protein: Column, chain: Column, number: Column) -> Column:
    """``pid:chain:num`` with the number cut to an integer."""
    return F.concat_ws(":", protein, chain, number.cast("double").cast("int").cast("string"))


PDB4_STRICT = r"(^|[^A-Za-z0-9])([0-9][A-Za-z0-9]{3})([^A-Za-z0-9]|$)"
PDB4_LOOSE = r"([0-9][a-z0-9]{3})"


def pdb4_strict(name: Column) -> Column:
    """The first free-standing four-character code that begins with a digit, lower-case."""
    return F.lower(F.nullif(F.regexp_extract(F.replace(name, F.lit(":"), F.lit("_")), PDB4_STRICT, 2), F.lit("")))


def pdb4_loose(name: Column) -> Column:
    """The first such code anywhere before the first ``.`` of the first token."""
    token = F.lower(F.replace(F.substring_index(F.substring_index(F.trim(name), " ", 1), ".", 1), F.lit(":"), F.lit("_")))
    return F.nullif(F.regexp_extract(token, PDB4_LOOSE, 1), F.lit(""))


def repair_embedding_name(name: Column) -> Column:
    """``3iyt_a_A`` to ``3iyt_A``: a doubled chain token that differs in case only."""
    twice = F.lower(F.regexp_extract(name, r"_([A-Za-z])_([A-Za-z])$", 1)) == F.lower(F.regexp_extract(name, r"_([A-Za-z])_([A-Za-z])$", 2))
    return F.when(name.rlike(r"_[A-Za-z]_[A-Za-z]$") & twice, F.regexp_replace(name, r"_[A-Za-z](_[A-Za-z])$", "$1")).otherwise(name)


def feature_columns(columns: Sequence[str], metadata: Sequence[str]) -> list[str]:
    """Every column that is no metadata is a feature."""
    known = set(metadata)
    return [c for c in columns if c not in known]


# ------------------------------------------------------------------- numbers


def safe_double(text: Column) -> Column:
    """Blank, null and invalid become 0; NaN 0; infinities 1 and -1."""
    x = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x)


def int_of_text(text: Column, invalid: int = -1) -> Column:
    """int(float(text)), cut toward zero."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 2147483647.0), F.lit(invalid)).otherwise(x.cast("int"))


def label_of(klass: Column | None, site: Column | None) -> Column:
    """``class`` where there is one, else whether ``binding_site`` is positive, else 0."""
    options = ([klass.cast("int")] if klass is not None else []) + ([(site > 0).cast("int")] if site is not None else [])
    return F.coalesce(*options, F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def platt(p: Column, a: float, b: float) -> Column:
    """sigmoid(a p + b) of p clipped to 0..1."""
    return sigmoid(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * a + b)


def z_score(x: Column, mean: Column | float, stdev: Column | float) -> Column:
    """(x - mean) / stdev, 0 where stdev isn't positive."""
    stdev = stdev if isinstance(stdev, Column) else F.lit(stdev)
    return F.when(stdev > 0, (x - mean) / stdev).otherwise(0.0)


def histogram_probability(x: Column, low: float, high: float, tp: Sequence[float], fp: Sequence[float]) -> Column:
    """tp / (tp + fp) of cumulative histograms at x, interpolated inside bins, not in the last one; 0 where both are 0."""
    bins = len(tp)
    width = (high - low) / bins
    at = (x - low) / width
    k = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(bins - 1)).cast("int")
    t, f = (F.array(*[F.lit(float(v)) for v in values]) for values in (tp, fp))
    share = F.least(F.greatest(at - k, F.lit(0.0)), F.lit(1.0))

    def value(values: Column) -> Column:
        here = F.element_at(values, k + 1)
        following = F.element_at(values, F.least(k + 2, F.lit(bins)))
        return F.when(k < bins - 1, here + (following - here) * share).otherwise(here)

    a, b = value(t), value(f)
    return F.when(a + b > 0, a / (a + b)).otherwise(0.0)


def neighbour_weights(distances: Column, mode: str = "softmax", temperature: float = 2.0) -> Column:
    """Weights over an array of distances (at least 1e-4 each): softmax(-d/T), 1/d normalised, or uniform."""
    d = F.transform(distances, lambda x: F.greatest(x, F.lit(1e-4)))
    if mode == "softmax":
        raw = F.transform(d, lambda x: F.exp(-x / temperature))
    elif mode == "inverse":
        raw = F.transform(d, lambda x: 1 / x)
    elif mode == "uniform":
        raw = F.transform(d, lambda x: F.lit(1.0))
    else:
        raise ValueError(f"no such weighting: {mode}")
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / (total + (1e-8 if mode == "inverse" else 0.0)))


def falloff(d: Column, radius: float = 6.0) -> Column:
    """max(0, 1 - d / radius)."""
    return F.greatest(F.lit(0.0), 1 - d / radius)


def power_feature(v: Column, power: float = 2.0, keep_sign: bool = False) -> Column:
    x = F.pow(F.abs(v), F.lit(power))
    return F.when(v < 0, -x).otherwise(x) if keep_sign else x


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance, summed in the order of the axes."""
    total = None
    for p, q in zip(a, b):
        total = (p - q) * (p - q) if total is None else total + (p - q) * (p - q)
    return total


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    pt = F.when(y == 1, q).otherwise(1 - q)
    at = F.when(y == 1, F.lit(alpha)).otherwise(1 - alpha)
    return -at * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)


def asymmetric_loss(p: Column, y: Column, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    shifted = F.least(1 - q + clip, F.lit(1.0))
    pos = F.ln(q) * F.pow(1 - q, F.lit(gamma_pos))
    neg = F.ln(F.greatest(shifted, F.lit(1e-7))) * F.pow(1 - shifted, F.lit(gamma_neg))
    return -F.when(y == 1, pos).otherwise(neg)


def weighted_bce(p: Column, y: Column, pos_weight: Column | float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -F.when(y == 1, F.ln(q) * pos_weight).otherwise(F.ln(1 - q))


def rounded(x: Column, digits: int) -> Column:
    """Half up, nudged by 1e-9 so that values on a border don't depend on the order of a sum."""
    return F.round(x + 1e-9, digits)


def cell_text(x: Column, digits: int = 6) -> Column:
    """A number as a CSV cell, empty where null."""
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", x))


def parse_ratio(spec: Column) -> Column:
    """``60/40``, ``0.6,0.4``, ``3:1``, ``60 40``: numbers over 1 are percents, then all sum to 1."""
    parts = F.transform(F.split(F.trim(spec), r"[/,:\s]+"), lambda s: s.try_cast("double"))
    parts = F.transform(parts, lambda x: F.when(x > 1, x / 100).otherwise(x))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def parse_thresholds(spec: str) -> list[float]:
    """``auto`` is 0.1 to 0.9 in 17 steps, else a list parted by commas."""
    if spec.strip().lower() == "auto":
        return [round(0.1 + 0.05 * k, 2) for k in range(17)]
    return [float(s) for s in spec.split(",") if s.strip()]
