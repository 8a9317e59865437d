"""Images and logits as arrays: preparation, softmax, losses, and a small convolutional network."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import png
from ..plans.scan import segmented_scan
from ..session import written


def normalized(px: Column, mean: float = 0.5, std: float = 0.5, scale: float = 255.0) -> Column:
    """(x / scale - mean) / std of each element, as double."""
    return F.transform(px.cast("array<double>"), lambda x: (x / F.lit(scale) - F.lit(mean)) / F.lit(std))


def prepared(px: Column, is_tensor: Column | None = None) -> Column:
    """A picture scaled and normalised; what is a tensor already is normalised only."""
    if is_tensor is None:
        return normalized(px)
    return F.when(is_tensor, normalized(px, scale=1.0)).otherwise(normalized(px))


def needs_preparing(px: Column) -> Column:
    """Whether any value is above 128, as in pictures of 8-bit values."""
    return F.array_max(px) > 128


def channels_last(px: Column, h: Column, w: Column, c: int = 3) -> Column:
    """Channel-major pixels to pixel-major ones."""
    return F.transform(F.sequence(F.lit(0), h * w * c - 1), lambda i: F.get(px, (i % c * h * w + F.floor(i / c)).cast("int")))


def _once(value: Column, fn) -> Column:
    """fn(value) with value worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def softmax(logits: Column) -> Column:
    exps = lambda z: _once(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    shares = lambda e: _once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return _once(logits, lambda z: _once(exps(z), shares))


def argmax(values: Column) -> Column:
    """The place, from 0, of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(probabilities: Column, target: Column) -> Column:
    return -F.ln(F.get(probabilities, target))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the place, from 0, of each row in an order over the whole table: rows are dealt by ranges, sorted and
    written, and each range starts after the rows of those before it. Only a count for each range reaches the driver, and
    their sums go back as a table of as many rows."""
    at = F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    counts, before, starts = {r[0]: r[1] for r in dealt.groupBy("_at.part").count().collect()}, 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    first = df.sparkSession.createDataFrame(starts, "_part int, _first long")
    return dealt.join(F.broadcast(first), F.col("_at.part") == F.col("_part")).withColumn(out, F.col("_first") + F.col("_at.row")).drop("_at", "_part", "_first")


def mean_of_batch_means(df: DataFrame, value: str, order: list[str], batch: int = 128, group: str | None = None, large: bool = False) -> DataFrame:
    """(group,) n_batches, mean: the unweighted mean of the means of consecutive batches; the last may be smaller.

    Rows are numbered within the group, which is one sorted partition; without a group over the whole table, by ranges.
    With large groups are spread over the tasks as well (``scan.segmented_scan``).
    """
    keys = [group] if group else []
    if group and large:
        placed = segmented_scan(df, [group], order, {"_place": ("count", None)})
    elif group:
        placed = df.withColumn("_place", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    else:
        placed = numbered(df, order, "_place")
    per = placed.withColumn("_b", F.floor(F.col("_place") / batch)).groupBy(*keys, "_b").agg(F.avg(value).alias("_m"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_batches"), F.avg("_m").alias("mean"))


def accuracy(df: DataFrame, predicted: str, target: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(predicted) == F.col(target)).cast("int")).alias("accuracy"))


def resized(pixels: np.ndarray, size: int) -> np.ndarray:
    """A (height, width, channels) picture at size x size, by bilinear sampling at pixel centres."""
    h, w = pixels.shape[:2]
    y = np.clip((np.arange(size) + 0.5) * h / size - 0.5, 0, h - 1)
    x = np.clip((np.arange(size) + 0.5) * w / size - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float64)
    return (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy


def forward(x: np.ndarray, weights: Mapping[str, np.ndarray]) -> np.ndarray:
    """Logits of pictures (n, channels, height, width): 3 x 3 convolutions conv1.. with ReLU and 2 x 2 max pooling, then
    the dense layers fc1 (ReLU) and fc2. Dropout does nothing outside training."""
    k = 1
    while f"conv{k}.weight" in weights:
        w, b = weights[f"conv{k}.weight"], weights[f"conv{k}.bias"]
        n, _, h, wd = x.shape
        p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
        cols = np.lib.stride_tricks.sliding_window_view(p, (3, 3), axis=(2, 3))
        x = np.maximum(np.einsum("nchwij,ocij->nohw", cols, w, optimize=True) + b[None, :, None, None], 0)
        x = x[:, :, : h // 2 * 2, : wd // 2 * 2].reshape(n, len(b), h // 2, 2, wd // 2, 2).max(axis=(3, 5))
        k += 1
    x = x.reshape(len(x), -1)
    x = np.maximum(x @ weights["fc1.weight"].T + weights["fc1.bias"], 0)
    return x @ weights["fc2.weight"].T + weights["fc2.bias"]


def predict(df: DataFrame, weights: Mapping[str, np.ndarray] | None, shape: tuple[int, int, int], px_col: str = "px", target_col: str | None = None) -> DataFrame:
    """df with predicted_label, probabilities and error; Arrow batches through ``forward``.

    Without weights, and for pixels that are null or of another size, the row says so in error.
    """
    size = int(np.prod(shape))

    @F.pandas_udf("array<double>")
    def logits(px: pd.Series) -> pd.Series:
        if not len(px):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(p, np.float64) if p is not None and len(p) == size else np.zeros(size) for p in px]).reshape(-1, *shape)
        return pd.Series(list(forward(x, weights)))

    if weights is None:
        return df.withColumns({"predicted_label": F.lit(None).cast("int"), "probabilities": F.lit(None).cast("array<double>"), "error": F.lit("Model not loaded")})
    bad = F.col(px_col).isNull() | (F.size(px_col) != size)
    out = df.withColumn("_l", F.when(~bad, logits(F.col(px_col)))).withColumn("probabilities", softmax(F.col("_l")))
    return out.withColumns({"predicted_label": argmax(F.col("probabilities")), "error": F.when(bad, F.lit("Invalid image"))}).drop("_l")


def save_model(weights: Mapping[str, np.ndarray], path: str) -> None:
    np.savez(path if path.endswith(".npz") else f"{path}.npz", **weights)


def load_model(path: str) -> dict[str, np.ndarray] | None:
    """The weights of a file; None where they can't be loaded, so that predictions say so instead of failing."""
    try:
        with np.load(path if path.endswith(".npz") else f"{path}.npz") as f:
            return {k: f[k] for k in f.files}
    except (OSError, ValueError):
        return None


def pixels_of(df: DataFrame, content: str, size: int, channels: int) -> DataFrame:
    """df with px, the picture in a column of PNG bytes as channel-major doubles, and error where it can't be read.

    Pictures are brought to so many channels. Those of 8-bit values (any above 128) are resized to size x size, scaled and
    normalised; others stay as they are.
    """

    @F.pandas_udf("struct<px: array<double>, error: string>")
    def read(data: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for d in data:
            try:
                p = png.in_mode(png.decode(bytes(d) if d is not None else b""), channels)
                p = (resized(p, size) / 255 - 0.5) / 0.5 if p.max(initial=0) > 128 else p.astype(np.float64)
                out.append(np.moveaxis(p, 2, 0).ravel())
                errors.append(None)
            except ValueError as e:
                out.append(None)
                errors.append(f"Failed to process image: {e}")
        return pd.DataFrame({"px": out, "error": errors})

    return df.withColumn("_p", read(F.col(content))).withColumns({"px": F.col("_p.px"), "error": F.col("_p.error")}).drop("_p")


def predict_files(spark: SparkSession, path: str, weights: Mapping[str, np.ndarray] | None, size: int, channels: int) -> DataFrame:
    """(path, predicted_label, probabilities, error) for the pictures of a folder, or one file."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    most = 16 * spark.sparkContext.defaultParallelism
    if found.rdd.getNumPartitions() > most:  # many small files, one to a task
        found = found.coalesce(most)
    ready = pixels_of(found, "content", size, channels).select("path", "px", F.col("error").alias("_e"))
    out = predict(ready, weights, (channels, size, size))
    return out.select("path", "predicted_label", "probabilities", F.coalesce("_e", "error").alias("error"))


def predict_ids(wanted: DataFrame, rows: DataFrame, weights: Mapping[str, np.ndarray] | None, shape: tuple[int, int, int], id_col: str, px_col: str = "px", target_col: str = "label") -> DataFrame:
    """For each id asked for: the prediction and target_label of the row of that id, or error and code 400 where no row
    has it."""
    j = wanted.select(id_col).join(rows.select(id_col, F.col(px_col).alias("px"), F.col(target_col).alias("target_label"), F.lit(True).alias("_there")), id_col, "left")
    out = predict(j, weights, shape)
    missing = F.col("_there").isNull()
    error = F.when(missing, F.concat(F.lit("file_id "), F.col(id_col).cast("string"), F.lit(" out of range"))).otherwise(F.col("error"))
    return out.select(id_col, "predicted_label", "probabilities", "target_label", error.alias("error"), F.when(missing, F.lit(400)).alias("code"))


def fetched(df: DataFrame, url: str, seconds: float = 30.0, most: int = 50 << 20) -> DataFrame:
    """df with content and error: what stands at each address, or why it can't be fetched. A row that fails stops no other;
    more than ``most`` bytes are an error. Any scheme that Python opens will do."""

    @F.pandas_udf("struct<content: binary, error: string>")
    def get(urls: pd.Series) -> pd.DataFrame:
        import urllib.request

        body, errors = [], []
        for u in urls:
            try:
                with urllib.request.urlopen(u or "", timeout=seconds) as r:
                    data = r.read(most + 1)
                if len(data) > most:
                    raise OSError("too large")
                body.append(data)
                errors.append(None)
            except (OSError, ValueError) as e:
                body.append(None)
                errors.append(f"Failed to fetch image from URL: {e}")
        return pd.DataFrame({"content": body, "error": errors})

    return df.withColumn("_g", get(F.col(url))).withColumns({"content": F.col("_g.content"), "error": F.col("_g.error")}).drop("_g")


def first_samples(df: DataFrame, position: str, n: int) -> DataFrame:
    """The rows at positions 0 to n - 1; asking for more than there are is an error."""
    out = df.where(F.col(position) < n)
    if out.count() < n:
        raise IndexError(f"fewer than {n} samples")
    return out


def batched(df: DataFrame, position: str, size: int = 128, first_only: bool = False) -> DataFrame:
    """df with batch_id of consecutive positions, the last batch smaller; first_only keeps batch 0, as in a demo run."""
    out = df.withColumn("batch_id", F.floor(F.col(position) / size).cast("long"))
    return out.where("batch_id = 0") if first_only else out


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that depends on key and seed alone, by a distributed sort, for training splits."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
