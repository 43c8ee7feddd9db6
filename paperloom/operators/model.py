"""Logistic scoring of candidate pairs: training on sufficient statistics, prediction, importance."""

from __future__ import annotations

import json
import secrets
import socket
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.matching import DEFAULT_WEIGHTS, FEATURES, probability
from paperloom.runtime import Scratch, width


def sufficient_statistics(pairs: DataFrame, features: list[str] = FEATURES, label: str = "label") -> DataFrame:
    """Distinct feature vectors with their number and their sum of labels: full-batch gradients depend on nothing else."""
    return pairs.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("y")).groupBy(*features).agg(F.count("*").alias("n"), F.sum("y").alias("y"))


def train(pairs: DataFrame, features: list[str] = FEATURES, label: str = "label", lr: float = 0.1, epochs: int = 1000, max_vectors: int = 1_000_000) -> tuple[list[float], float]:
    """Full-batch gradient descent from zero weights, without scaling or penalty -> (weights, bias).

    One Spark job reduces the pairs to distinct vectors. Up to ``max_vectors`` of them the epochs run on the driver; a larger table is dealt
    to as many tasks as run at once, which hold their rows and add up their gradients after every epoch (one barrier stage for all epochs).
    Where the epochs run changes nothing but the order of the sums. Null features count 0; no pairs give zero weights.
    """
    scratch = Scratch(pairs.sparkSession, "train")
    stats = scratch.save(sufficient_statistics(pairs.fillna(0.0, subset=features), features, label), "stats")
    size = stats.agg(F.count("*").alias("rows"), F.sum("n").alias("total")).first()
    if not size["rows"]:
        return [0.0] * len(features), 0.0
    total = float(size["total"])
    if size["rows"] <= max_vectors:
        x, n, y = _arrays(stats.toArrow(), features)
        order = np.lexsort(x.T)
        x, n, y = x[order], n[order], y[order]
        w, b = _descend(lambda w, b: _gradient(x, n, y, w, b), len(features), total, lr, epochs)
    else:
        w, b = _spark_descend(stats, min(width(pairs.sparkSession), size["rows"]), features, total, lr, epochs)
    scratch.free("stats")
    return w.tolist(), float(b)


def _arrays(rows: pa.Table | pa.RecordBatch, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([rows.column(f).to_numpy() for f in features])
    return x, rows.column("n").to_numpy().astype(float), rows.column("y").to_numpy()


def _gradient(x: np.ndarray, n: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sum of the gradients of all pairs by the weights and, last, the bias."""
    error = n / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y
    return np.append(x.T @ error, error.sum())


def _descend(gradient: Callable[[np.ndarray, float], np.ndarray], features: int, total: float, lr: float, epochs: int) -> tuple[np.ndarray, float]:
    w, b = np.zeros(features), 0.0
    for _ in range(epochs):
        g = gradient(w, b)
        w = w - lr * g[:-1] / total
        b -= lr * g[-1] / total
    return w, b


def _spark_descend(stats: DataFrame, tasks: int, features: list[str], total: float, lr: float, epochs: int) -> tuple[np.ndarray, float]:
    """Every task goes through all epochs with its own rows; the gradients of all are added in the order of the tasks, so all tasks keep the
    same weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_arrays(batch, features) for batch in batches if batch.num_rows]
        x, n, y = (np.concatenate(z) for z in zip(*own))
        task = BarrierTaskContext.get()
        added = _adder(task)

        def gradient(w: np.ndarray, b: float) -> np.ndarray:
            g = np.zeros(len(w) + 1)
            for k in range(0, len(n), 8192):  # stays in the processor's cache
                g += _gradient(x[k : k + 8192], n[k : k + 8192], y[k : k + 8192], w, b)
            return added(g)

        w, b = _descend(gradient, len(features), total, lr, epochs)
        if task.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([float(b)])], ["w", "b"])

    found = stats.repartition(tasks).mapInArrow(run, "w array<double>, b double", barrier=True).collect()[0]
    return np.array(found["w"]), found["b"]


def _adder(task: BarrierTaskContext) -> Callable[[np.ndarray], np.ndarray]:
    """Adds up the arrays of all tasks of a barrier stage. Spark's own exchange takes a second a call, so it only tells where the first task
    listens and by what word it knows the others."""
    rank, hosts = task.partitionId(), [x.address.rsplit(":", 1)[0] for x in task.getTaskInfos()]
    server = socket.create_server(("", 0), backlog=len(hosts)) if rank == 0 else None
    port, word = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
    if not server:
        link = socket.create_connection((hosts[0], int(port)), timeout=300)
        link.sendall(word.encode() + rank.to_bytes(4, "big"))
        links = [link]
    else:
        known: dict[int, socket.socket] = {}
        server.settimeout(300)
        while len(known) < len(hosts) - 1:
            link = server.accept()[0]
            link.settimeout(300)
            hello = _read(link, len(word) + 4)
            if secrets.compare_digest(hello[:-4], word.encode()):
                known[int.from_bytes(hello[-4:], "big")] = link
        server.close()
        links = [known[k] for k in sorted(known)]
    for link in links:
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        link.settimeout(1800)

    def added(g: np.ndarray) -> np.ndarray:
        if rank:
            links[0].sendall(g.tobytes())
            return np.frombuffer(_read(links[0], g.nbytes))
        g = np.sum([g, *[np.frombuffer(_read(link, g.nbytes)) for link in links]], axis=0)
        for link in links:
            link.sendall(g.tobytes())
        return g

    return added


def _read(link: socket.socket, size: int) -> bytes:
    out = b""
    while len(out) < size:
        part = link.recv(size - len(out))
        if not part:
            raise ConnectionError("a task of the stage ended")
        out += part
    return out


def predict(pairs: DataFrame, weights=DEFAULT_WEIGHTS, bias: float = 0.0, threshold: float = 0.5) -> DataFrame:
    return pairs.withColumn("probability", probability(tuple(weights), bias)).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def importance(weights, features: list[str] = FEATURES) -> list[tuple[str, float]]:
    return sorted(((f, abs(w)) for f, w in zip(features, weights)), key=lambda x: -x[1])


def to_json(weights, bias: float, features: list[str] = FEATURES) -> str:
    return json.dumps({"weights": list(weights) if weights is not None else None, "bias": bias, "feature_names": list(features)})


def from_json(text: str) -> tuple[list[float] | None, float]:
    model = json.loads(text)
    return model["weights"] or None, model["bias"]
