"""Autoencoders: forward passes in NumPy inside Spark tasks, a linear one trained by Spark's PCA, and parameter counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import stored

#: The layers of the convolutional autoencoder, in order.
LAYERS = ("conv 20 3x3", "relu", "mean pool 2", "conv 30 3x3", "relu", "flatten", "dense 80", "relu", "dense to map", "reshape", "relu", "conv 30 3x3", "relu", "double", "conv 20 3x3", "relu", "conv 1 3x3", "relu")


def shapes(w: int, h: int) -> dict[str, tuple[int, ...]]:
    """Weights and biases of the convolutional autoencoder for frames of w x h; both even."""
    if w % 2 or h % 2:
        raise ValueError("the frame's sides must be even")
    n = 30 * (w // 2) * (h // 2)
    return {
        "conv1": (3, 3, 1, 20), "bias1": (20,), "conv2": (3, 3, 20, 30), "bias2": (30,), "dense1": (n, 80), "bias3": (80,), "dense2": (80, n), "bias4": (n,),
        "conv3": (3, 3, 30, 30), "bias5": (30,), "conv4": (3, 3, 30, 20), "bias6": (20,), "conv5": (3, 3, 20, 1), "bias7": (1,),
    }


def parameter_count(w: int, h: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(w, h).values())


def initial_weights(w: int, h: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: np.zeros(s, np.float32) if k.startswith("bias") else (rng.normal(size=s) * np.sqrt(2 / np.prod(s[:-1]))).astype(np.float32) for k, s in shapes(w, h).items()}


def neighbourhoods(x: np.ndarray) -> np.ndarray:
    """A row for each place of each image: the 3 x 3 places around it, channels fastest; outside there is 0."""
    n, w, h, c = x.shape
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    return np.concatenate([padded[:, i : i + w, j : j + h] for i in range(3) for j in range(3)], axis=3).reshape(-1, 9 * c)


def conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """3 x 3, same size; x: rows, w, h, channels."""
    return (neighbourhoods(x) @ weight.reshape(-1, weight.shape[-1])).reshape(*x.shape[:3], -1) + bias


def reconstruct(weights: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """x: rows, w, h."""
    relu, v = lambda a: np.maximum(a, 0), weights
    a = relu(conv(x[..., None], v["conv1"], v["bias1"]))
    n, w, h, c = a.shape
    a = a.reshape(n, w // 2, 2, h // 2, 2, c).mean(axis=(2, 4))
    a = relu(conv(a, v["conv2"], v["bias2"]))
    code = relu(a.reshape(n, -1) @ v["dense1"] + v["bias3"])
    a = relu((code @ v["dense2"] + v["bias4"]).reshape(n, w // 2, h // 2, 30))
    a = relu(conv(a, v["conv3"], v["bias5"]))
    a = a.repeat(2, axis=1).repeat(2, axis=2)
    return relu(conv(relu(conv(a, v["conv4"], v["bias6"])), v["conv5"], v["bias7"]))[..., 0]


def autoencoder_scores(images: DataFrame, weights: dict[str, np.ndarray], frame: tuple[int, int], key: str = "row", px: str = "px", step: int = 256) -> DataFrame:
    """key, raw (mean squared error), inten (sum of pixels); the weights are broadcast."""
    w, h = frame
    held = images.sparkSession.sparkContext.broadcast(weights)
    schema = images.select(key).withColumns({"raw": F.lit(0.0), "inten": F.lit(0.0)}).schema

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                x = np.array(part[px].tolist(), np.float32).reshape(-1, w, h)
                rec = reconstruct(held.value, x)
                yield pd.DataFrame({key: part[key], "raw": ((x - rec) ** 2).mean(axis=(1, 2), dtype=np.float64), "inten": x.sum(axis=(1, 2), dtype=np.float64)})

    return images.select(key, px).mapInPandas(run, schema)


#: Widths of the dense autoencoders, the deep one and the simple one.
DENSE_LAYERS = (784, 512, 256, 128, 64, 32, 16, 32, 64, 128, 256, 512, 784)
SIMPLE_LAYERS = (784, 64, 784)


def dense_parameter_count(widths: tuple[int, ...]) -> int:
    return sum((a + 1) * b for a, b in zip(widths, widths[1:], strict=False))


def dense_weights(widths: tuple[int, ...], seed: int = 0) -> dict[str, np.ndarray]:
    rng, out = np.random.default_rng(seed), {}
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        out[f"weight{k}"] = (rng.normal(size=(a, b)) * np.sqrt(2 / a)).astype(np.float32)
        out[f"bias{k}"] = np.zeros(b, np.float32)
    return out


def dense_states(weights: dict[str, np.ndarray], x) -> list[np.ndarray]:
    """The input and what each layer gives: relu between, a sigmoid at the end."""
    states, n = [np.asarray(x, np.float32)], len(weights) // 2
    for k in range(n):
        a = states[-1] @ weights[f"weight{k}"] + weights[f"bias{k}"]
        states.append(np.maximum(a, 0) if k < n - 1 else 1 / (1 + np.exp(-np.clip(a, -60, 60))))
    return states


def dense_reconstruct(weights: dict[str, np.ndarray], x) -> np.ndarray:
    return dense_states(weights, x)[-1]


def dense_gradients(weights: dict[str, np.ndarray], x) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the summed losses, a loss being an image's mean squared error, and that sum."""
    states, out = dense_states(weights, x), {}
    miss = states[-1] - states[0]
    back = 2 * miss / miss.shape[1] * states[-1] * (1 - states[-1])
    for k in reversed(range(len(weights) // 2)):
        out[f"weight{k}"], out[f"bias{k}"] = states[k].T @ back, back.sum(axis=0)
        if k:
            back = (back @ weights[f"weight{k}"].T) * (states[k] > 0)
    return out, float((miss.astype(np.float64) ** 2).mean(axis=1).sum())


def dense_scores(images: DataFrame, weights: dict[str, np.ndarray], key: str = "row", px: str = "px", step: int = 256) -> DataFrame:
    """key, raw (mean squared error), inten (sum of pixels); the weights are broadcast."""
    held = images.sparkSession.sparkContext.broadcast(weights)
    schema = images.select(key).withColumns({"raw": F.lit(0.0), "inten": F.lit(0.0)}).schema

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                x = np.array(part[px].tolist(), np.float32)
                rec = dense_reconstruct(held.value, x)
                yield pd.DataFrame({key: part[key], "raw": ((x - rec) ** 2).mean(axis=1, dtype=np.float64), "inten": x.sum(axis=1, dtype=np.float64)})

    return images.select(key, px).mapInPandas(run, schema)


def dense_fit(images: DataFrame, weights: dict[str, np.ndarray], steps: int = 20, rate: float = 1e-3, px: str = "px", batch: int = 256) -> tuple[dict[str, np.ndarray], list[float]]:
    """Adam on the mean loss over all images; new weights, and the loss before each step. Tasks add their gradients up, groups
    of 64 tasks next, and the driver, which holds the weights, gets one sum for each array."""
    rows, w = images.select(px), {k: v.copy() for k, v in weights.items()}
    first, second, losses = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, []

    def summed(held):
        def run(frames):
            total, loss, n = {}, 0.0, 0
            for pdf in frames:
                for start in range(0, len(pdf), batch):
                    x = np.array(pdf[px].iloc[start : start + batch].tolist(), np.float32)
                    found, lost = dense_gradients(held.value, x)
                    total = {k: total[k] + v if total else v for k, v in found.items()}
                    loss, n = loss + lost, n + len(x)
            if n:
                part = TaskContext.get().partitionId() // 64
                yield pd.DataFrame([{"part": part, "name": k, "data": v.astype(np.float64).tobytes(), "loss": loss, "n": n} for k, v in total.items()])

        return run

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(x, np.float64) for x in pdf["data"]], axis=0)
        return pd.DataFrame([{"part": pdf["part"].iloc[0], "name": pdf["name"].iloc[0], "data": data.tobytes(), "loss": pdf["loss"].sum(), "n": pdf["n"].sum()}])

    schema = "part int, name string, data binary, loss double, n long"
    for step in range(1, steps + 1):
        held = images.sparkSession.sparkContext.broadcast(w)
        found = rows.mapInPandas(summed(held), schema).groupBy("part", "name").applyInPandas(added, schema).groupBy("name").applyInPandas(added, schema).collect()
        held.unpersist()
        if not found:
            break
        losses.append(found[0]["loss"] / found[0]["n"])
        for r in found:
            g = (np.frombuffer(r["data"], np.float64).reshape(w[r["name"]].shape) / r["n"]).astype(np.float32)
            a, b = first[r["name"]], second[r["name"]]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w[r["name"]] = w[r["name"]] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w, losses


def linear_autoencoder(images: DataFrame, k: int, px: str = "px"):
    """The best linear code of k numbers: Spark's PCA model of px."""
    rows = stored(images.select(array_to_vector(F.col(px).cast("array<double>")).alias("features")))
    return PCA(k=k, inputCol="features", outputCol="code").fit(rows)


def encode(model, images: DataFrame, px: str = "px") -> DataFrame:
    rows = images.withColumn("features", array_to_vector(F.col(px).cast("array<double>")))
    return model.transform(rows).withColumn("code", vector_to_array("code")).drop("features")


def linear_scores(model, images: DataFrame, px: str = "px") -> DataFrame:
    """images with code and raw: the squared length that the code leaves out, by element. Lengths are about the origin, as
    the code's are."""
    out = encode(model, images, px)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    return out.withColumn("raw", F.greatest(F.lit(0.0), square(F.col(px)) - square(F.col("code"))) / F.size(px))
