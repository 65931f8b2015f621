"""Window encoders: Gramian and Markov fields, candlestick rasters, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.vectors import gramian, quantile_bins, resample

IMAGE = 64
# RGB colours of the raster.
BACKGROUND, UP, DOWN = (255, 255, 255), (34, 139, 34), (200, 30, 30)


def markov_transitions(windows: DataFrame, values: str, key: list[str], bins: int = 8) -> DataFrame:
    """Transition table of each window: ``key, bin, next_bin, n, p`` (each bin's rows sum to 1)."""
    binned = windows.select(*key, quantile_bins(F.col(values), bins).alias("b"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("b") - 1),
        lambda i: F.struct(F.element_at("b", i).alias("bin"), F.element_at("b", i + 1).alias("next_bin")),
    )
    moves = binned.select(*key, F.explode(steps).alias("m")).select(*key, "m.bin", "m.next_bin")
    counts = moves.groupBy(*key, "bin", "next_bin").agg(F.count(F.lit(1)).alias("n"))
    totals = moves.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(totals, [*key, "bin"]).select(*key, "bin", "next_bin", "n", (F.col("n") / F.col("_t")).alias("p"))


def _field_batches(col: str, carry: list[str], size: int, bins: int, planes_kept: tuple[int, ...] = (0, 1, 2)):
    """GASF, GADF and MTF planes of a batch of equally long windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(col)).flatten().to_numpy(zero_copy_only=False)
            x = values.reshape(batch.num_rows, size)
            low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            flat = high <= low
            c = np.where(flat, 0.0, (x - low) / np.where(flat, 1.0, high - low) * 2.0 - 1.0).clip(-1.0, 1.0)
            s = np.sqrt(1.0 - c * c)
            summation = c[:, :, None] * c[:, None, :] - s[:, :, None] * s[:, None, :]
            difference = s[:, :, None] * c[:, None, :] - c[:, :, None] * s[:, None, :]
            edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=1).T
            state = (edges[:, None, :] <= x[:, :, None]).sum(axis=2)
            pairs = state[:, :-1] * bins + state[:, 1:] + np.arange(len(x))[:, None] * bins * bins
            counts = np.bincount(pairs.ravel(), minlength=len(x) * bins * bins).reshape(len(x), bins, bins).astype(float)
            prob = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1.0)
            transition = prob[np.arange(len(x))[:, None, None], state[:, :, None], state[:, None, :]]
            fields = (summation, difference, transition)
            planes = np.stack([fields[i] for i in planes_kept], axis=1).astype(np.float32)
            count = len(planes_kept)
            flat_planes = pa.array(planes.reshape(-1))
            inner = pa.ListArray.from_arrays(np.arange(0, len(x) * count + 1, dtype=np.int32) * size * size, flat_planes)
            images = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, dtype=np.int32) * count, inner)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in carry]
            yield pa.RecordBatch.from_arrays([*kept, images], names=[*carry, "image"])

    return run


def rasters(ohlc: np.ndarray, hw: int = IMAGE, body: float = 0.7) -> np.ndarray:
    """Candlestick images of (n, T, 4) open/high/low/close windows as (n, 3, hw, hw) uint8.

    A pixel shows the last candle that covers it, in the colour of its direction: by its wick (the centre column, from
    high to low) or its body (``body`` of the candle's width, from open to close, two pixels high at least). Prices map
    to rows linearly, the highest to row 0, rounded half to even; a window without any range counts as 1e-6 wide.
    """
    n, count = ohlc.shape[:2]
    if count > hw:
        raise ValueError(f"window of {count} bars is wider than the image ({hw})")
    top, bottom = ohlc[:, :, 1].max(axis=1), ohlc[:, :, 2].min(axis=1)
    top = np.where(top > bottom, top, bottom + 1e-6)
    level = np.rint((top[:, None, None] - ohlc) / (top - bottom)[:, None, None] * (hw - 1)).astype(int)
    edges = np.sort(level[:, :, [0, 3]], axis=2)
    edges[:, :, 1] = np.where(edges[:, :, 0] == edges[:, :, 1], np.minimum(hw - 1, edges[:, :, 1] + 1), edges[:, :, 1])
    pixel, number = np.arange(hw), np.arange(count)
    centre = ((number + 0.5) * (hw / count)).astype(int)
    reach = max(1, round(hw / count * body / 2))
    away = np.abs(pixel[None, :] - centre[:, None])  # candle x column
    between = lambda lo, hi: (pixel >= lo[:, :, None]) & (pixel <= hi[:, :, None])  # noqa: E731  window x candle x row
    wick = between(level[:, :, 1], level[:, :, 2])[:, :, :, None] & (away == 0)[None, :, None, :]
    solid = between(edges[:, :, 0], edges[:, :, 1])[:, :, :, None] & (away <= reach)[None, :, None, :]
    shown = ((wick | solid) * (number + 1).astype(np.int16)[None, :, None, None]).max(axis=1)  # 0: none
    rising = np.concatenate([np.zeros((n, 1), bool), ohlc[:, :, 3] >= ohlc[:, :, 0]], axis=1)
    kind = np.where(shown > 0, 1 + np.take_along_axis(rising, shown.reshape(n, -1).astype(int), axis=1).reshape(shown.shape), 0)
    return np.array([BACKGROUND, DOWN, UP], dtype=np.uint8)[kind].transpose(0, 3, 1, 2)


def _raster_batches(col: str, carry: list[str], hw: int, body: float, together: int = 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(col))
            bars = column.flatten()
            ohlc = np.stack([bars.field(n).to_numpy(zero_copy_only=False) for n in ("open", "high", "low", "close")], axis=1)
            sizes = np.diff(np.asarray(column.offsets))
            starts = np.cumsum(sizes) - sizes
            images: list[bytes | None] = [None] * batch.num_rows
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                for part in np.array_split(rows, -(-len(rows) // together)):
                    for row, image in zip(part, rasters(ohlc[starts[part, None] + np.arange(size)], hw, body)):
                        images[row] = image.tobytes()
            kept = [batch.column(batch.schema.get_field_index(n)) for n in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(images, pa.binary())], names=[*carry, "image"])

    return run


def _schema_of(df: DataFrame, carry: list[str], image: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in carry] + [T.StructField("image", image)])


def encode_windows(
    windows: DataFrame, encoder: str = "candle", key: tuple[str, ...] = ("pair", "interval", "open_time"),
    col: str = "window", size: int = IMAGE, bins: int = 8, body: float = 0.7,
) -> DataFrame:
    """Images of collected windows, Arrow batch by Arrow batch.

    ``candle``: 3 x size x size uint8 as bytes. ``gaf``: Gramian summation, Gramian difference and
    Markov field of the closes as three flat float planes. ``mtf``: the last plane alone.
    """
    carry = list(key)
    if encoder == "candle":
        return windows.select(*carry, col).mapInArrow(
            _raster_batches(col, carry, size, body), _schema_of(windows, carry, T.BinaryType())
        )
    closes = windows.select(*carry, resample(F.col(col)["close"], size).alias("_close"))
    kept = {"gaf": (0, 1, 2), "mtf": (2,)}
    if encoder not in kept:
        raise ValueError(f"unknown encoder {encoder!r}")
    planes = T.ArrayType(T.ArrayType(T.FloatType()))
    return closes.mapInArrow(_field_batches("_close", carry, size, bins, kept[encoder]), _schema_of(windows, carry, planes))


def gramian_summary(windows: DataFrame, key: list[str], col: str = "window", size: int = IMAGE) -> DataFrame:
    """Checksums of the Gramian fields: sum and trace of each, per window."""
    fields = gramian(resample(F.col(col)["close"], size))
    out = windows.select(*key, fields[0].alias("s"), fields[1].alias("d"))
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x)
    trace = lambda c: F.aggregate(F.transform(c, lambda r, i: r[i]), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        *key, total(F.col("s")).alias("gasf_sum"), trace(F.col("s")).alias("gasf_trace"),
        total(F.col("d")).alias("gadf_sum"), trace(F.col("d")).alias("gadf_trace"),
    )


# --------------------------------------------------------------------------- embeddings
def relative_closes(dim: int) -> Callable[[np.ndarray], np.ndarray]:
    """Default embedding: log closes relative to the last one, resampled to ``dim`` and unit length."""

    def embed(closes: np.ndarray) -> np.ndarray:
        path = np.log(np.maximum(closes, 1e-12)) - np.log(np.maximum(closes[:, -1:], 1e-12))
        at = np.linspace(0, path.shape[1] - 1, dim)
        low = np.minimum(np.floor(at).astype(int), path.shape[1] - 1)
        high = np.minimum(low + 1, path.shape[1] - 1)
        out = path[:, low] + (path[:, high] - path[:, low]) * (at - low)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size < 1e-12, 1.0, size)).astype(np.float32)

    return embed


def embed_windows(
    windows: DataFrame, fn: Callable[[np.ndarray], np.ndarray] | None = None, dim: int = 128,
    key: tuple[str, ...] = ("pair", "interval", "open_time"), col: str = "window", batch_size: int = 1024,
    length: int = 64,
) -> DataFrame:
    """Embed every window's closes with ``fn`` (batch of closes -> batch of vectors), in batches per task."""
    embed = fn or relative_closes(dim)
    closes = windows.select(*key, F.col(col)["close"].alias("_close"))
    udf = predict_batch_udf(
        lambda: embed, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[length]]
    )
    return closes.select(*key, udf("_close").alias("embedding"))
