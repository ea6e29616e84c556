"""Normal distribution and derived statistics as Column expressions.

The quantile uses the rational approximations PPND16 of Wichura's algorithm AS 241, the tail those of Cody for the
complementary error function. Both stay inside generated code and can be written in SQL, so results can be compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: AS 241 coefficients, in ascending powers. Fixed values.
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
#: Cody's rational approximations of the error function, in ascending powers. Fixed values.
_P1 = [3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560e0, 1.85777706184603153e-1]
_Q1 = [2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0]
_P2 = [1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594e0, 5.64188496988670089e-1, 2.15311535474403846e-8]
_Q2 = [1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0]
_P3 = [6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2]
_Q3 = [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e0, 2.56852019228982242e0, 1.0]


def _poly(x: str, c: list[float]) -> str:
    out = repr(c[-1])
    for v in c[-2::-1]:
        out = f"({out} * {x} + {v!r})"
    return out


def quantile_sql(p: str) -> str:
    """The standard normal quantile of an expression, as SQL for Spark and DuckDB; null outside (0, 1)."""
    q = f"(({p}) - 0.5e0)"
    r1 = f"(0.180625e0 - {q} * {q})"
    tail = f"sqrt(-ln(CASE WHEN ({p}) <= 0e0 OR ({p}) >= 1e0 THEN 0.5e0 WHEN {q} < 0e0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    sign = f"(CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END)"
    s1, s2 = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    return (
        f"CASE WHEN ({p}) <= 0e0 OR ({p}) >= 1e0 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {q} * {_poly(r1, _fl(_A))} / {_poly(r1, _fl(_B))} "
        f"WHEN {tail} <= 5e0 THEN {sign} * {_poly(s1, _fl(_C))} / {_poly(s1, _fl(_D))} ELSE {sign} * {_poly(s2, _fl(_E))} / {_poly(s2, _fl(_F))} END"
    )


def two_sided_p_sql(z: str) -> str:
    """2 (1 - Phi(|z|)) of an expression, as SQL for Spark and DuckDB."""
    y = f"(abs({z}) * {1 / math.sqrt(2)!r}e0)"
    y2, i2 = f"({y} * {y})", f"(1e0 / (CASE WHEN {y} > 1e0 THEN {y} * {y} ELSE 1e0 END))"
    e = f"exp(-{y2})"
    small = f"1e0 - {y} * {_poly(y2, _fl(_P1))} / {_poly(y2, _fl(_Q1))}"
    middle = f"{e} * {_poly(y, _fl(_P2))} / {_poly(y, _fl(_Q2))}"
    large = f"{e} / {y} * ({1 / math.sqrt(math.pi)!r}e0 - {i2} * {_poly(i2, _fl(_P3))} / {_poly(i2, _fl(_Q3))})"
    return f"CASE WHEN {y} <= 0.46875e0 THEN {small} WHEN {y} <= 4e0 THEN {middle} ELSE {large} END"


class _Double(float):
    def __repr__(self) -> str:  # an exponent makes it a double, not a decimal, in both dialects
        text = float.__repr__(self)
        return text if "e" in text else text + "e0"


def _fl(c: list[float]) -> list[float]:
    return [_Double(v) for v in c]


#: ln(odds ratio) to a standardised effect. Fixed value.
LOGISTIC = math.sqrt(3) / math.pi


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: explode over one element keeps the optimiser from copying it into each of its uses."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_quantile(df: DataFrame, p: Column, out: str) -> DataFrame:
    """df with the standard normal quantile of p; the steps of ``quantile_sql``, each computed once a row."""
    df = _bound(df, "_quantile_p", F.when((p > 0) & (p < 1), p))
    df = _bound(df, "_quantile_q", F.col("_quantile_p") - 0.5)
    inner = F.abs("_quantile_q") <= 0.425
    df = _bound(df, "_quantile_r", F.when(inner, 0.180625 - F.col("_quantile_q") * F.col("_quantile_q")).otherwise(F.sqrt(-F.ln(F.least(F.col("_quantile_p"), 1 - F.col("_quantile_p"))))))
    ratio = lambda x, up, down: F.expr(f"{_poly(x, _fl(up))} / {_poly(x, _fl(down))}")
    sign = F.when(F.col("_quantile_q") < 0, -1.0).otherwise(1.0)
    value = F.when(inner, F.col("_quantile_q") * ratio("_quantile_r", _A, _B)).when(F.col("_quantile_r") <= 5, sign * ratio("(_quantile_r - 1.6e0)", _C, _D)).otherwise(sign * ratio("(_quantile_r - 5e0)", _E, _F))
    return df.withColumn(out, F.when(F.col("_quantile_p").isNotNull(), value)).drop("_quantile_p", "_quantile_q", "_quantile_r")


def complete_missing_stats(df: DataFrame) -> DataFrame:
    """Adds effect, effect_se and pval where they can be derived from the columns that are there.

    Without effect: effect = ln(odds_ratio) sqrt(3) / pi and effect_se = -effect / quantile(pval / 2), which carries the
    sign of the effect. Without effect_se: -|effect| / quantile(pval / 2). Without pval: the two-sided normal test. A
    p-value of 0 or of 1 and more gives a null standard error.
    """
    have = set(df.columns)
    half = F.col("pval") / 2
    if "effect" not in have and {"odds_ratio", "pval"} <= have:
        df = df.withColumn("effect", F.when(F.col("odds_ratio") > 0, F.ln("odds_ratio") * F.lit(LOGISTIC)))
        return with_quantile(df, half, "_half").withColumn("effect_se", F.try_divide(-F.col("effect"), F.col("_half"))).drop("_half") if "effect_se" not in have else df
    if "effect" in have and "effect_se" not in have and "pval" in have:
        return with_quantile(df, half, "_half").withColumn("effect_se", F.try_divide(-F.abs("effect"), F.col("_half"))).drop("_half")
    if {"effect", "effect_se"} <= have and "pval" not in have:
        df = _bound(df, "_z", F.try_divide("effect", "effect_se"))
        return df.withColumn("pval", F.expr(two_sided_p_sql("_z"))).drop("_z")
    return df


def effect_from_zscore(z: Column, af: Column, n: Column) -> tuple[Column, Column]:
    """(effect, effect_se) of a z-score given the allele frequency and the number of samples."""
    se = F.try_divide(F.lit(1.0), F.sqrt((n + z * z) * 2 * af * (1 - af)))
    return z * se, se
