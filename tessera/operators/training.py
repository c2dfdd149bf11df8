"""Training of autoencoders: gradients by tasks, Adam on the driver, validation, checkpoints and resumption.

A network is a set of functions of its weights (a dictionary of arrays) and a batch of images. Every step is one Spark
job over the step's share of the images: tasks add up the gradients of their images, groups of tasks are added up next, always in
the order of the tasks, so that a step gives the same weights however tasks are scheduled. The driver holds the weights and moments,
whose size is the network's.

With a folder, each epoch is written there as a table (weights, moments, best weights so far, losses), and a later call goes on from the
last whole one: a run that was stopped and resumed gives the weights of one that wasn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.sources.storage import stored

Weights = dict[str, np.ndarray]
#: Tasks whose sums are added up by one task.
TOGETHER = 64
#: Images of one part of what train() goes over, and of one product of arrays within a batch.
PART, FEW = 512, 32
#: Bytes of one row of a checkpoint.
ROW = 1 << 25


@dataclass(frozen=True)
class Network:
    """gradients: of the summed losses of a batch (a loss is an image's mean squared error), and that sum. code: the
    narrowest layer's outputs. layers: every layer's outputs, by name."""

    reconstruct: Callable[[Weights, np.ndarray], np.ndarray]
    gradients: Callable[[Weights, np.ndarray], tuple[Weights, float]]
    layers: Callable[[Weights, np.ndarray], dict[str, np.ndarray]]
    code: str


def conv_back(x: np.ndarray, weight: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of models.conv() with respect to its input, weights and biases."""
    to_weight = (models.neighbourhoods(x).T @ back.reshape(-1, back.shape[-1])).reshape(weight.shape)
    to_input = models.conv(back, weight[::-1, ::-1].transpose(0, 1, 3, 2), np.zeros(x.shape[-1], x.dtype))
    return to_input, to_weight, back.sum(axis=(0, 1, 2))


def pooled(x: np.ndarray) -> np.ndarray:
    n, w, h, c = x.shape
    return x.reshape(n, w // 2, 2, h // 2, 2, c).mean(axis=(2, 4))


def doubled(x: np.ndarray) -> np.ndarray:
    return x.repeat(2, axis=1).repeat(2, axis=2)


def conv_layers(v: Weights, x: np.ndarray) -> dict[str, np.ndarray]:
    """Outputs of the convolutional autoencoder's layers, after their relu; x: rows, w, h."""
    relu = lambda a: np.maximum(a, 0)
    out = {"input": x[..., None]}
    out["conv1"] = relu(models.conv(out["input"], v["conv1"], v["bias1"]))
    out["pool"] = pooled(out["conv1"])
    out["conv2"] = relu(models.conv(out["pool"], v["conv2"], v["bias2"]))
    out["dense1"] = relu(out["conv2"].reshape(len(x), -1) @ v["dense1"] + v["bias3"])
    out["dense2"] = relu(out["dense1"] @ v["dense2"] + v["bias4"]).reshape(out["conv2"].shape)
    out["conv3"] = relu(models.conv(out["dense2"], v["conv3"], v["bias5"]))
    out["double"] = doubled(out["conv3"])
    out["conv4"] = relu(models.conv(out["double"], v["conv4"], v["bias6"]))
    out["conv5"] = relu(models.conv(out["conv4"], v["conv5"], v["bias7"]))
    return out


def conv_gradients(v: Weights, x: np.ndarray) -> tuple[Weights, float]:
    s, g = conv_layers(v, x), {}
    miss = s["conv5"] - s["input"]
    back = 2 * miss / (x.shape[1] * x.shape[2])

    def through(name: str, before: str, bias: str, back: np.ndarray) -> np.ndarray:
        back, g[name], g[bias] = conv_back(s[before], v[name], back * (s[name] > 0))
        return back

    back = through("conv5", "conv4", "bias7", back)
    back = through("conv4", "double", "bias6", back)
    n, w, h, c = back.shape
    back = back.reshape(n, w // 2, 2, h // 2, 2, c).sum(axis=(2, 4))
    back = (through("conv3", "dense2", "bias5", back) * (s["dense2"] > 0)).reshape(n, -1)
    g["dense2"], g["bias4"] = s["dense1"].T @ back, back.sum(axis=0)
    back = (back @ v["dense2"].T) * (s["dense1"] > 0)
    flat = s["conv2"].reshape(n, -1)
    g["dense1"], g["bias3"] = flat.T @ back, back.sum(axis=0)
    back = through("conv2", "pool", "bias2", (back @ v["dense1"].T).reshape(s["conv2"].shape))
    through("conv1", "input", "bias1", doubled(back) / 4)
    return {k: g[k] for k in v}, float((miss.astype(np.float64) ** 2).mean(axis=(1, 2, 3)).sum())


def few_at_once(v: Weights, x: np.ndarray) -> tuple[Weights, float]:
    """conv_gradients() of a few images after another: their neighbourhoods stay small."""
    total, loss = conv_gradients(v, x[:FEW])
    for start in range(FEW, len(x), FEW):
        found, lost = conv_gradients(v, x[start : start + FEW])
        total, loss = {k: total[k] + a for k, a in found.items()}, loss + lost
    return total, loss


def convolutional(w: int, h: int) -> Network:
    """The convolutional autoencoder for frames of w x h, given as flat arrays."""
    shaped = lambda x: np.asarray(x).reshape(len(x), w, h)
    return Network(
        lambda v, x: np.concatenate([conv_layers(v, shaped(x[p : p + FEW]))["conv5"].reshape(len(x[p : p + FEW]), -1) for p in range(0, max(1, len(x)), FEW)]),
        lambda v, x: few_at_once(v, shaped(x)),
        lambda v, x: {k: a.reshape(len(x), -1) for k, a in conv_layers(v, shaped(x)).items()},
        "dense1",
    )


def dense(widths: tuple[int, ...]) -> Network:
    """A dense autoencoder of these widths."""
    named = lambda v, x: {f"layer{k}": a for k, a in enumerate(models.dense_states(v, x))}
    return Network(models.dense_reconstruct, models.dense_gradients, named, f"layer{int(np.argmin(widths))}")


@dataclass
class State:
    """After `epoch` epochs; first, second: Adam's moments; best: the weights of the least validation loss; losses: a row an
    epoch, (training, validation)."""

    weights: Weights
    first: Weights
    second: Weights
    best: Weights
    step: int = 0
    epoch: int = 0
    losses: list[tuple[float, float]] = field(default_factory=list)


def fresh(weights: Weights) -> State:
    zero = lambda: {k: np.zeros_like(a) for k, a in weights.items()}
    return State({k: a.copy() for k, a in weights.items()}, zero(), zero(), {k: a.copy() for k, a in weights.items()})


def saved(spark: SparkSession, state: State, folder: str) -> None:
    """Write state as the folder's epoch; a part that is there from a run that broke off doesn't count as whole."""
    rows = []
    for kind in ("weights", "first", "second", "best"):
        for name, a in getattr(state, kind).items():
            data = np.ascontiguousarray(a, np.float32).tobytes()
            rows += [(kind, name, list(a.shape), k, data[p : p + ROW]) for k, p in enumerate(range(0, len(data), ROW))]
    rows.append(("losses", "", [state.step], 0, np.array(state.losses, np.float64).tobytes()))
    table = spark.createDataFrame([(*r, len(rows)) for r in rows], "kind string, name string, shape array<int>, part int, data binary, rows int")
    table.write.mode("overwrite").parquet(f"{folder}/epoch-{state.epoch}")


def resumed(spark: SparkSession, folder: str, epochs: int) -> State | None:
    """The state of the last whole epoch, `epochs` at most; None if there is none."""
    for epoch in range(epochs, 0, -1):
        try:
            rows = spark.read.parquet(f"{folder}/epoch-{epoch}").orderBy("kind", "name", "part").collect()
        except AnalysisException:
            continue
        if not rows or len(rows) != rows[0]["rows"]:
            continue
        held: dict = {}
        for r in rows:
            shape, data = held.get((r["kind"], r["name"]), (r["shape"], b""))
            held[r["kind"], r["name"]] = shape, data + bytes(r["data"])
        shape, data = held.pop(("losses", ""))
        parts: dict = {"weights": {}, "first": {}, "second": {}, "best": {}}
        for (kind, name), (form, raw) in held.items():
            parts[kind][name] = np.frombuffer(raw, np.float32).reshape(form).copy()
        return State(**parts, step=shape[0], epoch=epoch, losses=[tuple(x) for x in np.frombuffer(data, np.float64).reshape(-1, 2).tolist()])
    return None


def batched(frames, px: str, size: int):
    for pdf in frames:
        for start in range(0, len(pdf), size):
            yield np.array(pdf[px].iloc[start : start + size].tolist(), np.float32)


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("task")
    data = np.sum([np.frombuffer(x, np.float64) for x in pdf["data"]], axis=0)
    return pd.DataFrame([{"task": pdf["task"].iloc[0] // TOGETHER, "name": pdf["name"].iloc[0], "data": data.tobytes(), "loss": pdf["loss"].sum(), "n": pdf["n"].sum()}])


SUMS = "task int, name string, data binary, loss double, n long"


def gradient_sums(images: DataFrame, network: Network, weights: Weights, px: str = "px", batch: int = 256) -> tuple[Weights, float, int]:
    """Gradients and losses, summed, and the number of images."""
    held = images.sparkSession.sparkContext.broadcast(weights)

    def run(frames):
        total, loss, n = {}, 0.0, 0
        for x in batched(frames, px, batch):
            found, lost = network.gradients(held.value, x)
            total = {k: (total[k] if total else 0) + a.astype(np.float64) for k, a in found.items()}
            loss, n = loss + lost, n + len(x)
        if n:
            task = TaskContext.get().partitionId()
            yield pd.DataFrame([{"task": task, "name": k, "data": a.tobytes(), "loss": loss, "n": n} for k, a in total.items()])

    part = F.floor(F.col("task") / TOGETHER)
    sums = images.select(px).mapInPandas(run, SUMS).groupBy(part, "name").applyInPandas(lambda key, pdf: added(pdf), SUMS)
    rows = sums.groupBy("name").applyInPandas(added, SUMS).collect()  # one a weight
    held.unpersist()
    if not rows:
        return {}, 0.0, 0
    return {r["name"]: np.frombuffer(r["data"], np.float64).reshape(weights[r["name"]].shape) for r in rows}, rows[0]["loss"], rows[0]["n"]


def mean_loss(images: DataFrame, network: Network, weights: Weights, px: str = "px", batch: int = 256) -> float:
    """The mean over images of their mean squared errors; NaN without any."""
    held = images.sparkSession.sparkContext.broadcast(weights)

    def run(frames):
        task, loss, n = TaskContext.get().partitionId(), 0.0, 0
        for x in batched(frames, px, batch):
            miss = network.reconstruct(held.value, x).reshape(len(x), -1) - x
            loss, n = loss + float((miss.astype(np.float64) ** 2).mean(axis=1).sum()), n + len(x)
        yield pd.DataFrame([{"task": task, "loss": loss, "n": n}])

    rows = images.select(px).mapInPandas(run, "task int, loss double, n long").groupBy(F.floor(F.col("task") / TOGETHER).alias("g"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("task", "loss", "n"))).alias("l")).orderBy("g").collect()
    held.unpersist()
    n = sum(x["n"] for r in rows for x in r["l"])
    return sum(x["loss"] for r in rows for x in r["l"]) / n if n else float("nan")


def dealt(images: DataFrame, key: str = "row", px: str = "px") -> DataFrame:
    """images (key, px) stored in parts of about PART, by the hash of the key: all cores have some of them, however few bytes they
    are, and each part has the same images in the same order on every run."""
    rows = images.select(key, px)
    parts = max(1, ceil(rows.count() / PART))
    return stored(rows.repartition(parts, key).sortWithinPartitions(key, px))


def adam(state: State, gradient: Weights, rate: float) -> None:
    state.step += 1
    for name, g in gradient.items():
        a, b = state.first[name], state.second[name]
        a += np.float32(0.1) * (g.astype(np.float32) - a)
        b += np.float32(0.001) * (g.astype(np.float32) ** 2 - b)
        down = (a / (1 - 0.9**state.step)) / (np.sqrt(b / (1 - 0.999**state.step)) + 1e-8)
        state.weights[name] = (state.weights[name] - rate * down).astype(np.float32)


def train(images: DataFrame, network: Network, weights: Weights, epochs: int = 10, steps: int = 1, rate: float = 1e-3, validation: DataFrame | None = None, key: str = "row", px: str = "px", batch: int = 256, folder: str | None = None, seed: int = 7) -> State:
    """Adam for `epochs` passes over images (key, px), each in `steps` steps over the images that the key's hash deals them.

    The validation loss (the training loss without validation images) picks `best`. folder: where epochs are kept, and from where
    training goes on.
    """
    spark = images.sparkSession
    state = (resumed(spark, folder, epochs) if folder else None) or fresh(weights)
    if state.epoch < epochs:
        images, validation = dealt(images, key, px), None if validation is None else dealt(validation, key, px)
    while state.epoch < epochs:
        lost, seen = 0.0, 0
        for step in range(steps):
            turn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(steps)) == (step + state.epoch) % steps
            total, loss, n = gradient_sums(images.filter(turn) if steps > 1 else images, network, state.weights, px, batch)
            if n:
                adam(state, {k: a / n for k, a in total.items()}, rate)
            lost, seen = lost + loss, seen + n
        trained = lost / seen if seen else float("nan")
        valid = trained if validation is None else mean_loss(validation, network, state.weights, px, batch)
        if not state.losses or valid < min((v for _, v in state.losses), default=np.inf):
            state.best = {k: a.copy() for k, a in state.weights.items()}
        state.losses.append((trained, valid))
        state.epoch += 1
        if folder:
            saved(spark, state, folder)
    return state


def scored(images: DataFrame, network: Network, weights: Weights, key: str = "row", px: str = "px", keep: tuple[str, ...] = (), layers: tuple[str, ...] = (), step: int = 256) -> DataFrame:
    """key, keep, raw (mean squared error), inten (sum of pixels), code, and the named layers' outputs as arrays."""
    held = images.sparkSession.sparkContext.broadcast(weights)
    rows = images.select(key, *keep, px)
    empty = F.array().cast("array<float>")
    schema = rows.select(key, *keep).withColumns({"raw": F.lit(0.0), "inten": F.lit(0.0), "code": empty} | {x: empty for x in layers}).schema

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                x = np.array(part[px].tolist(), np.float32)
                states = network.layers(held.value, x)
                miss = network.reconstruct(held.value, x).reshape(len(x), -1) - x
                out = {c: part[c] for c in (key, *keep)} | {"raw": (miss.astype(np.float64) ** 2).mean(axis=1), "inten": x.sum(axis=1, dtype=np.float64), "code": list(states[network.code])}
                yield pd.DataFrame(out | {name: list(states[name]) for name in layers})

    return rows.mapInPandas(run, schema)


def code_spread(codes: DataFrame, by: tuple[str, ...] = (), code: str = "code") -> DataFrame:
    """by, n, mean (array) and covariance (array of rows, of the population) of a code, and mean_std, rms_distance: the mean
    over its numbers of their standard deviation, and the root mean square distance from the mean.

    Moments about the first code of each task and group are added up, so that large means don't spoil small spreads; groups hold a
    matrix of the code's length squared.
    """
    names = list(by)
    schema = codes.select(*names).withColumns({"n": F.lit(0).cast("long"), "sum": F.array().cast("array<double>"), "square": F.array().cast("array<double>")}).schema

    def combined(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        """n, mean and squares about it of several."""
        n, mean, square = parts[0]
        for m, other, more in parts[1:]:
            d = other - mean
            mean, square, n = mean + d * m / (n + m), square + more + np.outer(d, d) * n * m / (n + m), n + m
        return n, mean, square

    def partial(frames):
        held: dict = {}
        for pdf in frames:
            groups = pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]
            for key, part in groups:
                x = np.array(part[code].tolist(), np.float64)
                d = x - x.mean(axis=0)
                now = (len(x), x.mean(axis=0), d.T @ d)
                held[key] = combined([held[key], now]) if key in held else now
        for key, (n, mean, square) in held.items():
            yield pd.DataFrame([dict(zip(names, key if isinstance(key, tuple) else (key,), strict=True)) | {"n": n, "sum": mean, "square": square.ravel()}])

    wide = codes.select(*names).withColumns({"n": F.lit(0).cast("long"), "mean": F.array().cast("array<double>"), "covariance": F.array().cast("array<array<double>>"), "mean_std": F.lit(0.0), "rms_distance": F.lit(0.0)}).schema

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(pdf["sum"].iloc[0])
        n, mean, square = combined([(int(r.n), np.array(r.sum), np.array(r.square).reshape(size, size)) for r in pdf.sort_values("n").itertuples()])
        cov = square / n
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in names} | {"n": n, "mean": mean, "covariance": list(cov), "mean_std": np.sqrt(np.diag(cov)).mean(), "rms_distance": np.sqrt(np.trace(cov))}])

    return codes.select(*names, code).mapInPandas(partial, schema).groupBy(*names).applyInPandas(whole, wide)
