"""Arithmetic reports: cache and weight sizes, users that fit, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISIONS = [("FP16", 2.0), ("INT8", 1.0), ("INT4", 0.5)]


def kv_cache(configs: DataFrame, bytes_per_element: int = 2) -> DataFrame:
    """Bytes of cache per token of models (model, layers, heads, kv_heads, hidden)."""
    per = 2 * F.col("layers") * F.col("kv_heads") * F.expr("hidden div heads") * bytes_per_element
    return configs.select("model", per.cast("long").alias("bytes_per_token"))


def weight_footprint(models: DataFrame, usable_gb: float) -> DataFrame:
    """Size of models (model, params) at each precision, and whether it fits."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("precision"), F.lit(b).alias("bytes")) for n, b in PRECISIONS]))
    rows = models.select("model", "params", each.alias("p"))
    gb = F.col("params") * F.col("p.bytes") / 1e9
    return rows.select("model", "p.precision", F.round(gb, 6).alias("gb"), (gb < usable_gb).alias("fits"))


def concurrent_users(cache: DataFrame, context: DataFrame, usable_gb: float, weights_gb: float) -> DataFrame:
    """Users whose cache fits beside the weights, per context length (context)."""
    rows = cache.crossJoin(F.broadcast(context))
    budget = (usable_gb - weights_gb) * 1e9
    per_user = F.col("bytes_per_token") * F.col("context")
    return rows.select("model", "context", per_user.alias("bytes_per_user"), F.floor(F.lit(budget) / per_user).cast("long").alias("users"))


def train_log(lines: DataFrame) -> DataFrame:
    """Iterations of a training log (line): iter, kind, loss, tokens_per_s, peak_gb; other lines go."""
    num = lambda p: F.regexp_extract("line", p, 1).try_cast("double")
    kind = F.when(F.col("line").rlike("Val loss [0-9.]+"), "val").when(F.col("line").rlike("Train loss [0-9.]+"), "train")
    out = lines.select(
        F.regexp_extract("line", "Iter ([0-9]+)", 1).try_cast("int").alias("iter"),
        kind.alias("kind"),
        num("(?:Train|Val) loss ([0-9]+[.]?[0-9]*)").alias("loss"),
        num("Tokens/sec ([0-9]+[.]?[0-9]*)").alias("tokens_per_s"),
        num("Peak mem ([0-9]+[.]?[0-9]*) GB").alias("peak_gb"),
    )
    return out.where("kind is not null and iter is not null")
