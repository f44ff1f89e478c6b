"""Array arithmetic around model outputs: probabilities, losses, norms, recurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 65.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    """Mean of the values that are not null; null if there is none."""
    return let(F.array_compact(a), lambda known: F.try_divide(total(known), F.size(known)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, not once for each element that a lambda visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nearest(x: Column, n: int) -> Column:
    """x to `n` decimals as SQL engines round doubles: scaled, half away from zero, scaled back; a negative value that becomes zero is -0.0."""
    y = x * 10.0**n
    return F.when(F.abs(y) < 0.5, x * 0.0).when(F.abs(y) == float("inf"), x).otherwise(F.round(y) / 10.0**n)


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE 754 in every mode of the session: by zero it is infinite, or NaN if a is 0 or NaN. A zero b counts as positive."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """Stable; linear in the size of `a`."""
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / temperature)))
    return let(e, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.log(total(F.transform(a, lambda x: F.exp(x - top)))))


def cross_entropy(a: Column, target: Column, clamp: float | None = None) -> Column:
    a = a if clamp is None else F.transform(a, lambda x: F.greatest(F.least(x, F.lit(clamp)), F.lit(-clamp)))
    return log_sum_exp(a) - F.get(a, target)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 1e-10, x * F.log(x)).otherwise(0.0))


def ranked(a: Column) -> Column:
    """(value, index) structs, largest value first; of equal values the larger index first."""
    return F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), asc=False)


def top_k(a: Column, k: int) -> Column:
    return F.slice(ranked(a), 1, k)


def argmax(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))["i"]


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def finite(a: Column) -> Column:
    return F.filter(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def logit_clamp(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(x, F.lit(CLAMP)), F.lit(-CLAMP)))


def finite_or_zero(a: Column) -> Column:
    """(index, value) of the finite values; (0, 0.0) if there is none."""
    pairs = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda p: ~F.isnan(p["v"]) & (F.abs(p["v"]) < float("inf")))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("v")))
    return let(pairs, lambda p: F.when(F.size(p) > 0, p).otherwise(none))


#: The coefficients of the error function's rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_T = 0.3275911


def erf(x: Column) -> Column:
    def body(t):
        poly = F.lit(0.0)
        for c in reversed(ERF):
            poly = (poly + c) * t
        return F.signum(x) * (1 - poly * F.exp(-x * x))

    return let(1 / (1 + ERF_T * F.abs(x)), body)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / (2**0.5)))


def shape_verdict(b: Column, t: Column, c: Column, k: Column, v: Column, w: Column, u: Column) -> Column:
    """"ok", or what flat buffers of these lengths should be for b x t x c."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    whole = b * t * c
    flat = text("expected B*T*C = ", whole, ", got k=", k, ", v=", v)
    return F.when((k != whole) | (v != whole), flat).when((w != c) | (u != c), text("expected C = ", c, ", got w=", w, ", u=", u)).otherwise("ok")


def group_norm(a: Column, groups: int, size: int, eps: float = 64e-5) -> Column:
    """Each of `groups` runs of `size` values less its mean, over the root of its variance plus eps.

    Runs at the end may be shorter or empty; nulls stay null and count in no mean; a null `a` gives an empty list.
    """
    empty = F.array().cast("array<double>")

    def norm(g):
        return let(mean(g), lambda m: let(F.sqrt(mean(F.transform(g, lambda x: (x - m) * (x - m))) + eps), lambda s: F.transform(g, lambda x: (x - m) / s)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: let(F.slice(F.coalesce(a, empty), i * size + 1, size), norm)))


def ema(a: Column, keep: float = 0.99) -> Column:
    """The first value seeds."""
    return F.aggregate(a, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * keep + x * (1 - keep)))


def inverse_cdf(p: Column, u: Column) -> Column:
    """Index drawn by a uniform number: the first whose running sum exceeds it."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("i"), F.lit(0).alias("n"))

    def step(acc, x):
        s = acc["s"] + x
        return F.struct(s.alias("s"), F.when((acc["i"] < 0) & (s > u), acc["n"]).otherwise(acc["i"]).alias("i"), (acc["n"] + 1).alias("n"))

    return F.aggregate(p, start, step, lambda acc: F.when(acc["i"] < 0, acc["n"] - 1).otherwise(acc["i"]))


def wkv(k: Column, v: Column, w: float, u: float, clamp: bool = True, eps: float = 1e-8) -> Column:
    """Outputs of the exponential-moving-average recurrence in log space, as one fold.

    State (aa, bb, pp) starts at (0, 0, -1e30).
    """
    w, u = (min(max(w, -5.0), -0.01), min(max(u, -3.0), 3.0)) if clamp else (w, u)
    kv = F.zip_with(k, v, lambda x, y: F.struct(x.alias("k"), y.alias("v")))
    start = F.struct(F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"), F.lit(-1e30).alias("pp"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        uk = x["k"] + u
        top = F.greatest(s["pp"], uk)
        a, b = F.exp(uk - top), F.exp(s["pp"] - top)
        y = (a * x["v"] + b * s["aa"]) / (a + b * s["bb"] + eps)
        y = F.greatest(F.least(y, F.lit(20.0)), F.lit(-20.0)) if clamp else y
        wp = s["pp"] + w
        top2 = F.greatest(wp, x["k"])
        c, d = F.exp(wp - top2), F.exp(x["k"] - top2)
        return F.struct((c * s["aa"] + d * x["v"]).alias("aa"), (c * s["bb"] + d).alias("bb"), top2.alias("pp"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(kv, start, step, lambda s: s["out"])
