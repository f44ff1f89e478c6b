"""Human-readable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (from, decimals, suffix) of each unit, largest first.
PARAMS = [(10**9, 2, "B"), (10**6, 1, "M"), (10**3, 1, "K")]
NUMBER = [(10**6, 1, "M"), (10**3, 1, "K")]
BYTES = [(10**9, 2, " GB"), (10**6, 1, " MB"), (10**3, 1, " KB")]
THROUGHPUT = [(10**6, 2, "M tok/s"), (10**3, 1, "K tok/s")]


def fixed(x: Column, decimals: int) -> Column:
    """Rounded by the exact binary value, as C and Rust do; format_string rounds the shortest
    decimal form instead."""
    return F.replace(F.format_number(x.cast("double"), decimals), F.lit(","), F.lit(""))


def scientific(x: Column, decimals: int) -> Column:
    """As 3.00e-4: no zeros before the exponent, no plus sign."""
    written = F.format_string(f"%.{decimals}e", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(written, r"e\+?(-?)0*([0-9]+)$", "e$1$2"), r"e-0$", "e0")


#: The largest 32-bit float, written out: what a best loss is before any loss.
FLOAT_MAX, FLOAT_MAX_TEXT = 340282346638528859811704183484516925440.0, "340282346638528859811704183484516925440.0000"


def training_summary(steps: Column, tokens: Column, epochs: Column, best: Column, best_eval: Column, seconds: Column) -> Column:
    loss = lambda x: F.when(x >= FLOAT_MAX, FLOAT_MAX_TEXT).otherwise(fixed(x, 4))
    rate = F.when(seconds > 0, tokens.cast("double") / seconds).otherwise(0.0) / 1000
    parts = [("Steps: ", steps), (" | Tokens: ", tokens), (" | Epochs: ", epochs), (" | Best Loss: ", loss(best)), (" | Best Eval: ", loss(best_eval)), (" | Time: ", seconds), ("s | ", fixed(rate, 1))]
    return F.concat(*[x for name, value in parts for x in (F.lit(name), value.cast("string"))], F.lit("K tok/s"))


def _scaled(n: Column, units, rest: Column) -> Column:
    out = rest
    for at, decimals, suffix in reversed(units):
        out = F.when(n >= at, F.concat(fixed(n.cast("double") / F.lit(float(at)), decimals), F.lit(suffix))).otherwise(out)
    return out


def params(n: Column) -> Column:
    return _scaled(n, PARAMS, n.cast("string"))


def number(n: Column) -> Column:
    return _scaled(n, NUMBER, n.cast("string"))


def size(n: Column) -> Column:
    return _scaled(n, BYTES, F.concat(n.cast("string"), F.lit(" B")))


def throughput(n: Column) -> Column:
    return _scaled(n, THROUGHPUT, F.concat(fixed(n, 1), F.lit(" tok/s")))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return (
        F.when(h > 0, F.format_string("%dh%dm%ds", h, m, s))
        .when(m > 0, F.format_string("%dm%ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
