"""Rules on diagnoses, feature names and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN = ["CN", "SCD", "MCI", "DEM/D"]


def classify_trajectory(prev: Column, curr: Column, nxt: Column, has_prev: Column, has_next: Column) -> Column:
    """(label, subtype, reason) of the diagnoses around an examination.

    Three equal CN or SCD are Maintain; every step equal or worse, with one worse at least,
    is Declining; all else is Exclude. Every input gets exactly one label. The labels, subtypes and reasons are fixed values.
    """
    known = lambda c: F.coalesce(c.isin(KNOWN), F.lit(False))
    worse = lambda a, b: (a.isin("CN", "SCD") & b.isin("MCI", "DEM/D")) | ((a == "MCI") & (b == "DEM/D"))
    a, b = F.when(has_prev, prev), F.when(has_next, nxt)  # null where there is none; plain expressions, as these compile and lambdas don't
    path = F.concat_ws("_to_", a, curr, b)
    clear = F.coalesce((a == curr) | worse(a, curr), F.lit(True)) & F.coalesce((curr == b) | worse(curr, b), F.lit(True))
    worsens = F.coalesce(worse(a, curr), F.lit(False)) | F.coalesce(worse(curr, b), F.lit(False))
    out = lambda label, subtype, reason: F.struct(F.lit(label).alias("label"), subtype.alias("subtype"), reason.alias("reason"))
    no = lambda reason: out("Exclude", F.lit("Exclude"), reason if isinstance(reason, Column) else F.lit(reason))
    return (
        F.when(~known(curr), no("Invalid current diagnosis"))
        .when(has_prev & has_next & ~(known(prev) & known(nxt)), no("Invalid prev or next diagnosis"))
        .when(has_prev & has_next & (prev == curr) & (curr == nxt) & curr.isin("CN", "SCD"), out("Maintain", F.concat(curr, F.lit("_Stable")), F.lit("Accepted: stable CN/SCD across three visits")))
        .when(has_prev & ~known(prev), no("Invalid previous diagnosis"))
        .when(has_next & ~known(nxt), no("Invalid next diagnosis"))
        .when(a.isNull() & b.isNull(), no("Not enough visits"))
        .when(~clear, no(F.concat(F.lit("Excluded: ambiguous, oscillating, or improving transition ("), path, F.lit(")"))))
        .when(~worsens, no(F.concat(F.lit("Excluded: no worsening transition ("), path, F.lit(")"))))
        .otherwise(out("Declining", F.concat_ws("__", F.concat(a, F.lit("_to_"), curr), F.concat(curr, F.lit("_to_"), b)), F.concat(F.lit("Accepted: strict worsening sequence ("), path, F.lit(")"))))
    )


def simplify_subtype(label: Column, subtype: Column, current: Column, fallback: bool = True) -> Column:
    """The subtype by its end state; without fallback the current diagnosis doesn't decide an unclear decline. The names are fixed values."""
    has = lambda *p: reduce(lambda a, b: a | b, [subtype.contains(x) for x in p])
    kept = F.when(current.isin("CN", "SCD", "MCI"), F.concat(F.lit("Maintain_"), current)).when(current == "DEM/D", "Maintain_DEM").otherwise("Maintain_Other")
    fell = F.when(has("CN_to_MCI", "SCD_to_MCI"), "Decline_to_MCI").when(has("CN_to_DEM", "SCD_to_DEM"), "Decline_Normal_to_DEM").when(has("MCI_to_DEM"), "Decline_MCI_to_DEM")
    if fallback:
        fell = fell.when(current == "MCI", "Decline_to_MCI").when(current == "DEM/D", "Decline_to_DEM_Other")
    return F.when(label == "Maintain", kept).when(label == "Declining", fell.otherwise("Decline_Other")).otherwise("Other")


#: Parts of feature names and the groups they stand for; the first that fits counts.
FEATURE_GROUPS = [
    ("theta_alpha", "ThetaAlphaRatio"), ("thetaalpha", "ThetaAlphaRatio"),
    ("delta_alpha", "DeltaAlphaRatio"), ("deltaalpha", "DeltaAlphaRatio"),
    ("theta_beta", "ThetaBetaRatio"), ("thetabeta", "ThetaBetaRatio"),
    ("delta_beta", "DeltaBetaRatio"), ("deltabeta", "DeltaBetaRatio"),
    ("median_freq", "MedianFrequency"), ("medianfreq", "MedianFrequency"),
    ("sef", "SEF"), ("corr", "Connectivity"), ("alpha", "Alpha"), ("theta", "Theta"), ("delta", "Delta"), ("beta", "Beta"), ("gamma", "Gamma"),
]
#: Parts of the names of features that are transformed, and the smallest number added before a logarithm.
ATANH_PARTS = ["corr_mean", "corr_med"]
LOG_PARTS = ["theta_rel", "alpha_rel", "beta_rel", "delta_rel", "gamma_rel", "theta_alpha_ratio", "median_freq", "sef95", "_std", "_iqr"]
EPS = 2.220446049250313e-16


def feature_group(name: Column) -> Column:
    """The group of a feature by parts of its name; Other if none fits."""
    out = F
    for part, group in FEATURE_GROUPS:
        out = out.when(F.lower(name).contains(part), group)
    return out.otherwise("Other")


def transform_kind(name: str) -> str:
    """How a feature is transformed by its name: atanh, log or none."""
    if any(p in name for p in ATANH_PARTS):
        return "atanh"
    return "log" if any(p in name for p in LOG_PARTS) else "none"


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def log_or_atanh(x: Column, kind: str, train_min: Column | None = None, eps: float = EPS) -> Column:
    """log(x + eps) where the training minimum isn't negative (x below 0 counts as 0), atanh of x within +-0.999."""
    if kind == "atanh":
        return F.atanh(clamp(x, -0.999, 0.999))
    if kind == "log" and train_min is not None:
        return F.when(train_min >= 0, F.log(F.greatest(x, F.lit(0.0)) + eps)).otherwise(x)
    return x


def sigmoid(z: Column, limit: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -limit, limit)))


def entropy(p: Column, eps: float = 1e-12) -> Column:
    """Binary entropy in nats."""
    q = clamp(p, eps, 1 - eps)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def ratio(a: Column, b: Column, zero: bool = False) -> Column:
    """a / b; where b is 0, null or (zero) a itself, which then is 0."""
    return a / F.greatest(b, F.lit(1)) if zero else F.try_divide(a, b)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x scaled to [0, 1]; 0 for a constant."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def direction(p: Column) -> Column:
    """Positive or negative where the probability of a positive effect is at least 0.975 or at most 0.025."""
    return F.when(p >= 0.975, "Positive").when(p <= 0.025, "Negative").otherwise("Uncertain")
