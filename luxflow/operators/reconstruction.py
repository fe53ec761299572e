"""Image reconstruction from events by a recurrent network: DataFrame stages round a pluggable model.

A model is a function (voxels, state) -> (image, state) on arrays of (bins, height,
width) and (height, width); models are looked up by name in an explicit registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import render, representations

Model = Callable[[np.ndarray, object], tuple[np.ndarray, object]]
MODELS: dict[str, Callable[..., Model]] = {}


def register(name: str):
    def add(factory: Callable[..., Model]) -> Callable[..., Model]:
        MODELS[name] = factory
        return factory

    return add


def model(name: str, **options) -> Model:
    if name not in MODELS:
        raise KeyError(f"no model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name](**options)


def conv2d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int = 1) -> np.ndarray:
    """x (in, h, w), weight (out, in, k, k): zero-padded to keep the size at stride 1."""
    k = weight.shape[2]
    padded = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    seen = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))[:, ::stride, ::stride]
    return np.einsum("ihwkl,oikl->ohw", seen, weight, optimize=True) + bias[:, None, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def upsample(x: np.ndarray) -> np.ndarray:
    """Twice the size, bilinear."""
    def one(v: np.ndarray, axis: int) -> np.ndarray:
        v = np.moveaxis(v, axis, -1)
        before, after = np.concatenate([v[..., :1], v[..., :-1]], -1), np.concatenate([v[..., 1:], v[..., -1:]], -1)
        out = np.stack([0.25 * before + 0.75 * v, 0.75 * v + 0.25 * after], -1).reshape(*v.shape[:-1], -1)
        return np.moveaxis(out, -1, axis)

    return one(one(x, 1), 2)


def lstm(x: np.ndarray, state: tuple | None, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, tuple]:
    """A convolutional LSTM cell; gates in the order in, remember, out, cell."""
    n = weight.shape[0] // 4
    hidden, cell = state if state is not None else (np.zeros((n, *x.shape[1:])),) * 2
    gates = conv2d(np.concatenate([x, hidden]), weight, bias)
    i, f, o, g = (gates[k * n : (k + 1) * n] for k in range(4))
    cell = _sigmoid(f) * cell + _sigmoid(i) * np.tanh(g)
    hidden = _sigmoid(o) * np.tanh(cell)
    return hidden, (hidden, cell)


@register("recurrent_unet")
def recurrent_unet(bins: int, base: int = 8, encoders: int = 2, residual: int = 1, weights: dict[str, np.ndarray] | None = None, seed: int = 0) -> Model:
    """Head, stride-2 encoders with LSTM cells, residual blocks, upsampling decoders with skip sums, and a sigmoid.

    weights: name -> array; those not given are drawn from seed, as no trained ones come with this library.
    """
    rng = np.random.default_rng(seed)
    held = dict(weights or {})

    def w(name: str, out: int, inner: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        weight = held.setdefault(f"{name}.weight", rng.standard_normal((out, inner, k, k)) / np.sqrt(inner * k * k))
        return weight, held.setdefault(f"{name}.bias", np.zeros(out))

    relu = lambda x: np.maximum(x, 0)
    head, prediction = w("head", base, bins, 5), w("prediction", 1, base, 1)
    down = [(w(f"encoder{i}", base << (i + 1), base << i, 5), w(f"lstm{i}", 4 * base << (i + 1), 2 * base << (i + 1), 3)) for i in range(encoders)]
    middle = [(w(f"residual{i}a", base << encoders, base << encoders, 3), w(f"residual{i}b", base << encoders, base << encoders, 3)) for i in range(residual)]
    up = [w(f"decoder{i}", base << i, base << (i + 1), 5) for i in reversed(range(encoders))]

    def run(x: np.ndarray, state: object) -> tuple[np.ndarray, object]:
        states, new, skips = state or [None] * encoders, [], []
        x = relu(conv2d(x, *head))
        first = x
        for ((conv, cell), s) in zip(down, states, strict=True):
            x, s = lstm(relu(conv2d(x, *conv, stride=2)), s, *cell)
            skips.append(x)
            new.append(s)
        for a, b in middle:
            x = relu(x + conv2d(relu(conv2d(x, *a)), *b))
        for skip, conv in zip(reversed(skips), up, strict=True):
            x = relu(conv2d(upsample(x + skip), *conv))
        return _sigmoid(conv2d(x + first, *prediction))[0], new

    run.weights = held
    return run


def parameter_count(model: Model) -> int:
    """How many numbers a model has learnt, or would."""
    return sum(np.size(w) for w in model.weights.values())


class Frames:
    """The steps of one recording's windows through a model: voxels in, images out, the model's state kept from one to the next."""

    def __init__(self, height: int, width: int, bins: int, run: Model, encoders: int = 2, state: object = None):
        self.shape, self.run, self.state = (bins, height, width), run, state
        self.edge = render.padding(height, width, encoders)

    def step(self, b: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(height, width) image of a window's normalised voxels."""
        grid, edge = np.zeros(self.shape), self.edge
        np.add.at(grid, (b, y, x), value)
        image, self.state = self.run(np.pad(grid, ((0, 0), (edge.top, edge.bottom), (edge.left, edge.right)), mode="reflect"), self.state)
        return edge.cropped(image)


def image_rows(number: int, image: np.ndarray) -> pd.DataFrame:
    y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
    return pd.DataFrame({"frame_idx": number, "y": y.ravel(), "x": x.ravel(), "value": image.ravel()})


def reconstruct(windows: DataFrame, height: int, width: int, bins: int, run: Callable[[], Model], encoders: int = 2, amount: float = 0.3, median: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(*by, frame_idx, y, x, level): an image per window of events, in 0..255.

    windows: events with `window`, and the columns by that tell recordings apart, such
    as `recording`. Voxels are built and normalised per window, padded by mirroring,
    passed in order through the model, whose state goes on from window to window,
    cropped, sharpened and rescaled by the windows' running median bounds. Recordings
    are dealt over tasks; one recording's windows are a sequence, so one task's, which
    holds one window at a time.
    """
    by = list(by)
    voxels = voxel_windows(windows, height, width, bins, by)
    kinds = ", ".join(f"{c} {dict(voxels.dtypes)[c]}" for c in by)

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key, frames = None, None

        def finish() -> pd.DataFrame:
            cells = pd.concat(held)
            made = image_rows(int(cells["window"].iloc[0]), frames.step(*(cells[c].to_numpy() for c in ("bin", "y", "x", "value"))))
            for c in by:
                made.insert(0, c, cells[c].iloc[0])
            return made[[*by, "frame_idx", "y", "x", "value"]]

        for batch in batches:
            for now, cells in batch.groupby([*by, "window"], sort=False, dropna=False):
                now = now if isinstance(now, tuple) else (now,)
                if held and now != key:
                    yield finish()
                    held.clear()
                if frames is None or key is None or now[:-1] != key[:-1]:
                    frames = Frames(height, width, bins, run(), encoders)
                key = now
                held.append(cells)
        if held:
            yield finish()

    ordered = voxels.repartition(*by) if by else voxels.coalesce(1)
    raw = ordered.sortWithinPartitions(*by, "window").mapInPandas(images, f"{kinds + ', ' if by else ''}frame_idx long, y int, x int, value double")
    bounds = representations.intensity_bounds(raw, median, by=by)
    sharp = sharpened(raw, height, width, amount, by=by)
    return sharp.join(bounds, [*by, "frame_idx"]).select(*by, "frame_idx", "y", "x", representations.to_byte(F.col("value"), F.col("low"), F.col("high")).alias("level"))


def voxel_windows(windows: DataFrame, height: int, width: int, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, window, bin, y, x, value): each window's voxel grid, normalised over its own non-zero cells; windows are independent, so all are built at once."""
    inside = windows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    ends = windows.groupBy(*by, "window").agg(F.min("t_us").alias("_low"), F.max("t_us").alias("_high"))
    length = F.when(F.col("_high") == F.col("_low"), 1).otherwise(F.col("_high") - F.col("_low"))
    placed = inside.join(ends, [*by, "window"]).withColumn("_tn", (bins - 1) * (F.col("t_us") - F.col("_low")) / length).withColumn("_p", F.when(F.col("p"), 1.0).otherwise(-1.0))
    b, share = F.col("_tn").cast("int"), F.col("_tn") - F.col("_tn").cast("int")
    spread = placed.select(*by, "window", "y", "x", F.explode(F.array(F.struct(b.alias("bin"), (F.col("_p") * (1 - share)).alias("v")), F.struct((b + 1).alias("bin"), (F.col("_p") * share).alias("v")))).alias("_s"))
    cells = spread.where(F.col("_s.bin") < bins).groupBy(*by, "window", F.col("_s.bin").alias("bin"), "y", "x").agg(F.sum("_s.v").alias("value")).where("value <> 0")
    w = Window.partitionBy(*by, "window")
    mean = F.avg("value").over(w)
    std = F.sqrt(F.avg(F.col("value") * F.col("value")).over(w) - mean * mean)
    return cells.select(*by, "window", "bin", "y", "x", F.when(std > 0, (F.col("value") - mean) / std).otherwise(F.lit(0.0)).alias("value"))


def voxels(pieces: Callable[[], Iterable[np.ndarray]], bins: int, height: int, width: int, ends: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """bin, y, x and value of one window's voxels as voxel_windows makes them, from pieces of its events (t, x, y, p), which are gone through twice, and the window's first and last time."""
    length = ends[1] - ends[0] or 1
    grid = np.zeros(bins * height * width)
    for above in (0, 1):
        for e in pieces():
            e = e[(e["x"] >= 0) & (e["x"] < width) & (e["y"] >= 0) & (e["y"] < height)]
            place = (bins - 1) * (e["t"] - ends[0]) / length
            low = place.astype(np.int64)
            value = np.where(e["p"], 1.0, -1.0) * (place - low if above else 1 - (place - low))
            inside = low + above < bins
            np.add.at(grid, (((low + above) * height + e["y"]) * width + e["x"])[inside], value[inside])
    found = np.flatnonzero(grid)
    total = grid[found]
    std = total.std() if len(total) else 0.0
    return *np.unravel_index(found, (bins, height, width)), (total - total.mean()) / std if std > 0 else np.zeros(len(total))


def sharpened(images: DataFrame, height: int, width: int, amount: float, sigma: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Unsharp masking of every frame at once."""
    if amount <= 0:
        return images
    kernel = render.gaussian_kernel(5, sigma)
    weights = F.array(*[F.struct(F.lit(2 - i).alias("dy"), F.lit(2 - j).alias("dx"), F.lit(v).alias("w")) for i, row in enumerate(kernel) for j, v in enumerate(row)])
    sent = images.select(*by, "frame_idx", "y", "x", "value", F.explode(weights).alias("_k"))
    sent = sent.select(*by, "frame_idx", (F.col("y") + F.col("_k.dy")).alias("y"), (F.col("x") + F.col("_k.dx")).alias("x"), (F.col("value") * F.col("_k.w")).alias("_v"))
    inside = sent.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    blurred = inside.groupBy(*by, "frame_idx", "y", "x").agg(F.sum("_v").alias("_b"))
    return images.join(blurred, [*by, "frame_idx", "y", "x"]).select(*by, "frame_idx", "y", "x", ((1 + amount) * F.col("value") - amount * F.col("_b")).alias("value"))
