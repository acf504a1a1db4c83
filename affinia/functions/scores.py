"""Scores, weights, intervals and labels as Column expressions.

Rounding is half-up, as in Spark SQL. Missing values are NULL; each function says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; NULL for NULL, which greatest() and least() alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, lit(high)), lit(low)))


def evidence_score(similarity: Column, scaffolds: Column, potency: Column) -> Column:
    """0.6, 0.2 and 0.2 for similarity, scaffold count up to 5, and potency from 5 to 10; no potency adds nothing.
    No scaffold counts as one."""
    support = F.least(F.greatest(scaffolds, lit(1)), lit(5)) / 5.0
    return F.round(0.6 * similarity + 0.2 * support + 0.2 * F.coalesce(clamp((potency - 5.0) / 5.0, 0.0, 1.0), lit(0.0)), 3)


def potency_weight(p: Column, threshold: float = 6.0, floor: float = 0.0, steep: float = 5.0) -> Column:
    """Logistic in potency from floor to 1; unknown potency is neutral."""
    return F.when(p.isNull(), lit(1.0)).otherwise(floor + (1.0 - floor) / (1.0 + F.exp(-steep * (p - threshold))))


def potency_of_nanomolar(value: Column) -> Column:
    """9 - log10(nM) of numeric text or numbers; NULL unless above 0."""
    v = value.try_cast("double")
    return F.when(v > 0, F.round(9.0 - F.log10(v), 3))


def measured_else_computed(measured: Column, computed: Column) -> Column:
    """The measured value if it is there; one that is no number gives NULL rather than the computed value."""
    return F.when(measured.isNotNull() & (measured != ""), measured.try_cast("double")).otherwise(computed.try_cast("double"))


def popularity_corrected(score: Column, popularity: Column, eps: float = 1.0) -> Column:
    return score / (popularity + eps)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, within 0 to 1; (0, 0) for no trials."""
    p = k / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 1 + z * z / n
    empty = n == 0
    return F.when(empty, lit(0.0)).otherwise(F.greatest((mid - half) / scale, lit(0.0))), F.when(empty, lit(0.0)).otherwise(F.least((mid + half) / scale, lit(1.0)))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; NULL where it has no denominator."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    d = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(d > 0, (tp * tn - fp * fn) / d)


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, lit(0.0))


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, lit(False))


def normal_cdf(x: Column) -> Column:
    """By the complementary error function's rational approximation of Abramowitz and Stegun 7.1.26 (error 1.5e-7)."""
    z = F.abs(x) / (2**0.5)
    t = 1.0 / (1.0 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 1.0 - tail / 2).otherwise(tail / 2)


def gumbel_survival(x: Column, mean: Column, sd: Column) -> Column:
    """Chance of x or more under the Gumbel law with this mean and deviation; exact far into the tail."""
    scale = sd * (6**0.5) / 3.141592653589793
    z = (x - (mean - 0.5772156649015329 * scale)) / scale
    return -F.expm1(-F.exp(-z))


def band_label(x: Column, edges: list[float], names: list[str], closed: str = "left") -> Column:
    """Name of the interval between two edges; closed on its left side, or on both (then the first that fits)."""
    out = lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges[:-1], edges[1:], names))):
        inside = (x >= lo) & ((x < hi) if closed == "left" else (x <= hi))
        out = F.when(inside, lit(name)).otherwise(out)
    return out


def similarity_bucket(s: Column) -> Column:
    return band_label(s, [0.0, 0.5, 0.6, 0.7, 0.8, 1.01], ["0.0-0.5", "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-1.0"])


def depth_bucket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 10, "3-10").when(n <= 50, "11-50").otherwise("51+")


def drug_likeness(mw: Column, logp: Column, tpsa: Column, hbd: Column, hba: Column, rotb: Column, heavy: Column) -> dict[str, Column]:
    over = [mw > 500, logp > 5, hbd > 5, hba > 10]
    n = sum((x.cast("int") for x in over[1:]), over[0].cast("int"))
    return {
        "lipinski_violations": n,
        "lipinski_pass": n <= 1,
        "veber_pass": (rotb <= 10) & (tpsa <= 140),
        "egan_pass": (tpsa <= 131.6) & logp.between(-1, 5.88),
        "ghose_pass": mw.between(160, 480) & logp.between(-0.4, 5.6) & heavy.between(20, 70),
    }


def cautions(mw: Column, logp: Column, pains: Column) -> Column:
    return F.filter(F.array(F.when(pains, lit("pains")), F.when(logp > 6.5, lit("very lipophilic")), F.when(mw > 800, lit("very large"))), lambda x: x.isNotNull())


def tone(task: Column, polarity: Column, value: Column, high: float = 0.70, middle: float = 0.40) -> Column:
    graded = lambda a, b, c: F.when(value >= high, a).when(value >= middle, b).otherwise(c)
    return F.when((task != "class") | (polarity == "neutral") | value.isNull(), "neutral").when(polarity == "risk", graded("bad", "warn", "good")).otherwise(graded("good", "warn", "bad"))


# The names of tiers, classes and verdicts from here on are fixed values of the output, and so are their thresholds.


def confidence_tier(in_domain: Column, rmse: Column) -> Column:
    return F.when(~in_domain, "out").when(rmse.isNull(), "med").when(rmse <= 0.5, "high").when(rmse <= 1.0, "med").otherwise("low")


def pose_confidence(has_pose: Column, consistent: Column, cnn: Column) -> Column:
    steady, good = consistent >= 1, cnn >= 0.5
    return F.when(~has_pose, "none").when(cnn.isNull(), F.when(steady, "medium").otherwise("low")).when(steady & good, "high").when(steady | good, "medium").otherwise("low")


def failure_class(status: Column, error: Column, reason: Column, engine_errors: Column) -> Column:
    """Class of a run that did not end well; NULL for one that did."""
    e, r = F.lower(F.coalesce(error, lit(""))), F.lower(F.coalesce(reason, lit("")))
    prep = F.when(e.contains("invalid smiles"), "invalid_molecule").when(e.contains("3d embedding"), "conformer_generation_failed").when(e.contains("meeko") | e.contains("pdbqt"), "ligand_conversion_failed").otherwise("ligand_prep_failed")
    none = F.when(engine_errors > 0, "engine_error").when(r.contains("no physically valid poses"), "pose_validity_failed").otherwise("no_pose")
    return F.when(status == "ok", lit(None)).when(status == "ligand_prep_failed", prep).when(status == "engine_unavailable", "engine_unavailable").when(status == "no_pose", none).otherwise("other")


def separation_verdict(auc: Column) -> Column:
    return F.when(auc.isNull(), "need both classes").when(auc >= 0.8, "STRONG").when(auc >= 0.65, "MODERATE").otherwise("WEAK")


def discrimination(percentile: Column) -> Column:
    return F.when(percentile >= 90, "Strong").when(percentile >= 65, "Moderate").when(percentile.isNotNull(), "Weak")


def safe_round(x: Column, digits: int = 3) -> Column:
    """Rounded number; NULL for what is no finite number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.round(v, digits))


def bounded(x: Column, limit: float = 1e6) -> Column:
    """Within plus or minus limit; infinities and NaN become 0, as NULL does."""
    fine = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.when(fine, clamp(x, -limit, limit)), lit(0.0))
