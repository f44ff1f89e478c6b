"""Learning-rate, size and memory arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Presets (name, vocabulary, width, layers, feed-forward width).
PRESETS = [("140m", 32000, 768, 12, 3072), ("400m", 32000, 1024, 24, 4096), ("800m", 32000, 1536, 24, 6144), ("1b", 32000, 2048, 24, 8192), ("1.5b", 32000, 2304, 28, 9216)]
PRESETS_V7 = [("140m", 32000, 768, 12, 3072), ("400m", 32000, 1024, 24, 4096)]
# Training presets (name, rate, batch, accumulation, warm-up, steps).
TRAINING = [("default", 3e-4, 4, 16, 200, 10_000), ("t4_400m", 3e-4, 2, 32, 300, 50_000), ("t4_safe", 1e-4, 2, 32, 500, 50_000)]
TRAINING_SCHEMA = "name string, rate double, batch long, accumulation long, warmup long, steps long"
# Sequence lengths and batch sizes tried, in order; memory that fits.
SEQUENCES, BATCHES, FITS = [512, 384, 256, 192, 128, 96, 64], [4, 2, 1], 14_500_000_000


def learning_rate(step: Column, peak: float, warmup: int, last: int, floor_ratio: float) -> Column:
    """Quadratic rise, then a cosine down to floor_ratio of the peak."""
    low = peak * floor_ratio
    rise = (step + 1.0) / warmup
    done = F.least((step - float(warmup)) / max(last - warmup, 1), F.lit(1.0))
    return F.when(step < warmup, peak * rise * rise).otherwise(low + (peak - low) * 0.5 * (1.0 + F.cos(done * 3.141592653589793)))


def parameters(vocab: Column, d: Column, layers: Column, ffn: Column, tied: bool = True) -> Column:
    per_layer = (4 * d * d + 5 * d) + (d * d + 2 * d * ffn + 2 * d) + 4 * d
    return vocab * d * (1 if tied else 2) + layers * per_layer + 4 * d


def memory(params: Column, vocab: Column, d: Column, layers: Column, ffn: Column, batch: Column, seq: Column) -> Column:
    used = params * 12 + (4 * batch * seq * d + 2 * batch * seq * ffn) * 2 * layers + 12 * batch * d * layers + batch * seq * d * 2 + batch * seq * vocab * 2
    return used + F.floor(used / 7)


def heads(d: Column, size: int = 64) -> Column:
    return F.floor(d / size)


def low_rank(d: Column) -> Column:
    return F.greatest(F.floor(d / 16), F.lit(32))


def initial_values(spark: SparkSession, layers: int, width: int) -> DataFrame:
    """(layer, channel, decay, first, mix_k, mix_v, mix_r): initial vectors of the time mixing."""
    rows = spark.range(layers * width).select(F.floor(F.col("id") / width).alias("layer"), (F.col("id") % width).alias("channel"))
    depth, across = F.col("layer") / float(max(layers - 1, 1)), F.col("channel") / float(max(width - 1, 1))
    bound = lambda x, low, high: F.greatest(F.least(x, F.lit(high)), F.lit(low))
    return rows.select(
        "layer", "channel", bound((across * 4.5 - 5.0) * (depth * 0.4 + 0.8), -5.0, -0.01).alias("decay"), bound(across - 0.5, -0.5, 0.5).alias("first"),
        F.pow(1.0 - across, 1.0 - depth).alias("mix_k"), (F.pow(1.0 - across, 1.0 - depth) + 0.3 * depth).alias("mix_v"), F.pow(1.0 - across, 0.5 * (1.0 - depth)).alias("mix_r"),
    )
