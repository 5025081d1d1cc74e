"""Fitting projection heads with the ArcFace loss, data-parallel over the executors.

Heads of several variants of the same rows (one vector column each) are fitted in
one loop: they share samples and steps, so their number does not add jobs. The
driver holds only the heads and the optimiser states, whose size is set by the two
dimensions. A step is two Spark jobs over the step's rows: sums for the batch
statistics, then sums for the gradient. Tasks send one row of sums each, added up
pairwise on the executors when there are many tasks.

With very many classes the softmax is what costs. Then the classes, not the rows,
are dealt to the tasks: a batch, whose size is a parameter, goes to all of them,
each draws only the directions of its own range of classes, and two rounds combine
the parts: the sums of the softmax, then the slopes.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.vectors import matrix
from kinfold.operators import metrics as mx
from kinfold.operators.neighbors import knn_self_join
from kinfold.operators.projection import (
    BN_EPS,
    BN_MOMENTUM,
    DROPOUT,
    ProjectionHead,
    apply_head,
)
from kinfold.operators.ranking import hash_order, rank_by_hash
from kinfold.operators.sampling import class_ids, m_per_class_sample, random_batches, ranked_rows
from kinfold.session import materialize, scratch

# How the validation split is retrieved after each epoch.
RETRIEVAL_K = 51
RETRIEVAL_THRESHOLD = 0.5
RETRIEVAL_RECALL_KS = (5, 10, 50)

# AdamW moments.
_BETA1, _BETA2, _ADAM_EPS = 0.9, 0.999, 1e-8
_CLASS_BLOCK = 2048
# Beyond so many classes the softmax is dealt to the tasks by class, in ranges of so many blocks.
SHARD_CLASSES = 1 << 16
SHARD_BLOCKS = 8
_COS_LIMIT = 1 - 1e-7
_FAN_IN = 32
_TASK_BYTES = 16 << 20
# Rows whose logits against a block of classes a task holds at a time.
_LOSS_ROWS = 512
_PARAMETERS = ("weight", "bias", "bn_gamma", "bn_beta")


def arcface_loss_and_gradient(
    e: np.ndarray,
    labels: np.ndarray,
    n_classes: int,
    *,
    margin_degrees: float,
    scale: float,
    seed: int,
    gradient: bool = True,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Loss of each unit row and its gradient with respect to the row.

    Class directions are fixed and drawn from the seed block by block, so they
    need no table and memory stays bounded for any number of classes.
    """
    starts = range(0, n_classes, _CLASS_BLOCK)
    options = (n_classes, np.deg2rad(margin_degrees), scale, seed)
    top, total, own = log_sums(e, labels, starts, *options)
    loss = top + np.log(total) - own
    return loss, slopes(e, labels, starts, top, total, *options) if gradient else None


def _directions(start: int, n_classes: int, dim: int, seed: int) -> np.ndarray:
    """Unit directions of the block of classes that begins at ``start``."""
    rng = np.random.default_rng([seed, start // _CLASS_BLOCK])
    w = rng.standard_normal((_CLASS_BLOCK, dim))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return w[: n_classes - start]


def _logits(e, labels, start: int, w: np.ndarray, margin: float, scale: float):
    """Scaled cosines with the margin on the true class; which rows have it here, where, and its angle."""
    cos = np.clip(e @ w.T, -_COS_LIMIT, _COS_LIMIT)
    mine = np.flatnonzero((labels >= start) & (labels < start + len(w)))
    at = labels[mine] - start
    angle = np.arccos(cos[mine, at])
    cos[mine, at] = np.cos(angle + margin)
    return scale * cos, mine, at, angle


def log_sums(e, labels, starts, n_classes: int, margin: float, scale: float, seed: int):
    """Over the blocks of classes in ``starts``: each row's largest logit, the sum of
    exponentials relative to it, and the logit of its own class (0 if not among them)."""
    n, dim = e.shape
    top, total, own = np.full(n, -np.inf), np.zeros(n), np.zeros(n)
    for start in starts:
        z, mine, at, _ = _logits(e, labels, start, _directions(start, n_classes, dim, seed), margin, scale)
        peak = np.maximum(top, z.max(axis=1))
        total = total * np.exp(top - peak) + np.exp(z - peak[:, None]).sum(axis=1)
        top = peak
        own[mine] = z[mine, at]
    return top, total, own


def slopes(e, labels, starts, top, total, n_classes: int, margin: float, scale: float, seed: int) -> np.ndarray:
    """The share of the blocks in ``starts`` in the gradient of the loss by each row."""
    slope = np.zeros_like(e)
    for start in starts:
        w = _directions(start, n_classes, e.shape[1], seed)
        z, mine, at, angle = _logits(e, labels, start, w, margin, scale)
        d = np.exp(z - top[:, None]) / total[:, None]
        d[mine, at] -= 1.0
        d *= scale
        d[mine, at] *= np.sin(angle + margin) / np.sin(angle)
        slope += d @ w
    return slope


def keep_mask(row_keys: np.ndarray, width: int, seed: int, step: int) -> np.ndarray:
    """Dropout mask of each row from its key alone, the same on any partitioning."""
    with np.errstate(over="ignore"):
        x = row_keys.astype(np.uint64)[:, None] + np.uint64((seed * 1_000_003 + step) % 2**63)
        x = x + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # The splitmix64 finaliser.
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 >= DROPOUT


def _summed(
    rows: DataFrame, partial: Callable[[pa.RecordBatch], list[np.ndarray]], n_tasks: int | None = None
) -> list[np.ndarray]:
    """Add up arrays that ``partial`` computes per batch: in the task, then across tasks."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            yield _packed(sums)

    def merge(table: pa.Table) -> pa.Table:
        sums = None
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                part = _unpacked(batch["shapes"][i].as_py(), batch["data"][i].as_py())
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        return pa.Table.from_batches([_packed(sums)])

    schema = "shapes array<array<int>>, data binary"
    parts = rows.mapInArrow(per_task, schema)
    if n_tasks is None:
        n_tasks = 1 + (rows.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0)
    while n_tasks > _FAN_IN:
        n_tasks = -(-n_tasks // _FAN_IN)
        slot = F.pmod(F.spark_partition_id(), F.lit(n_tasks))
        parts = parts.groupBy(slot.alias("slot")).applyInArrow(merge, schema)
    sums = None
    for row in parts.collect():
        part = _unpacked(row["shapes"], row["data"])
        sums = part if sums is None else [a + b for a, b in zip(sums, part)]
    if sums is None:
        raise ValueError("a training step has no rows")
    return sums


def _packed(arrays: Sequence[np.ndarray]) -> pa.RecordBatch:
    shapes = [list(np.shape(a)) for a in arrays]
    data = b"".join(np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays)
    return pa.RecordBatch.from_arrays(
        [pa.array([shapes], pa.list_(pa.list_(pa.int32()))), pa.array([data], pa.binary())],
        names=["shapes", "data"],
    )


def _unpacked(shapes: list[list[int]], data: bytes) -> list[np.ndarray]:
    flat, arrays, at = np.frombuffer(data, dtype=np.float64), [], 0
    for shape in shapes:
        size = int(np.prod(shape)) if shape else 1
        arrays.append(flat[at : at + size].reshape(shape).copy())
        at += size
    return arrays


class _AdamW:
    def __init__(self, head: ProjectionHead, weight_decay: float) -> None:
        self.decay, self.t = weight_decay, 0
        self.m = {p: np.zeros_like(getattr(head, p)) for p in _PARAMETERS}
        self.v = {p: np.zeros_like(getattr(head, p)) for p in _PARAMETERS}

    def update(self, head: ProjectionHead, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for p, g in gradients.items():
            self.m[p] = _BETA1 * self.m[p] + (1 - _BETA1) * g
            self.v[p] = _BETA2 * self.v[p] + (1 - _BETA2) * g * g
            m = self.m[p] / (1 - _BETA1**self.t)
            v = self.v[p] / (1 - _BETA2**self.t)
            value = getattr(head, p) * (1 - rate * self.decay)
            setattr(head, p, value - rate * m / (np.sqrt(v) + _ADAM_EPS))


@dataclass
class Fit:
    """Best head, its validation metrics, and ``(step, key, value)`` log entries per epoch."""

    head: ProjectionHead
    metrics: dict[str, float]
    parameters: dict[str, object]
    history: list[tuple[int, str, float]] = field(default_factory=list)


def train_step(
    head: ProjectionHead, batch: DataFrame, n_classes: int, **options
) -> tuple[float, dict[str, np.ndarray]]:
    """``train_steps`` for one head over a batch with columns embedding, class_id, row_key."""
    return train_steps([head], batch.select("class_id", "row_key", "embedding"), n_classes, **options)[0]


def train_steps(
    heads: Sequence[ProjectionHead],
    batch: DataFrame,
    n_classes: int,
    *,
    margin_degrees: float,
    scale: float,
    seed: int,
    step: int,
    n_tasks: int | None = None,
    shard_classes: int = SHARD_CLASSES,
) -> list[tuple[float, dict[str, np.ndarray]]]:
    """Mean loss and gradients of each head over ``batch``: class_id, row_key, then a vector for each head.

    Also moves the heads' running batch statistics. Beyond ``shard_classes`` classes
    the softmax is dealt to the tasks by class.
    """
    loss_options = {"margin_degrees": margin_degrees, "scale": scale, "seed": seed}

    def moments(part: pa.RecordBatch) -> list[np.ndarray]:
        sums = [np.float64(part.num_rows)]
        for i, head in enumerate(heads):
            z = head.linear(matrix(part.column(2 + i)))
            sums += [z.sum(axis=0), (z * z).sum(axis=0)]
        return sums

    n, *found = _summed(batch, moments, n_tasks)
    if n < 2:
        raise ValueError("a training batch needs two rows")
    n = float(n)
    stats = []
    for total, squares in zip(found[::2], found[1::2]):
        mean = total / n
        stats.append((mean, np.maximum(squares / n - mean * mean, 0.0)))

    def forward(part: pa.RecordBatch, i: int):
        """Vectors, normed values, kept shares, lengths and unit rows of one head."""
        head, (mean, var) = heads[i], stats[i]
        x = matrix(part.column(2 + i))
        keep = keep_mask(part.column(1).to_numpy(), len(head.bias), seed, step) / (1 - DROPOUT)
        normed = (head.linear(x) - mean) / np.sqrt(var + BN_EPS)
        dropped = (normed * head.bn_gamma + head.bn_beta) * keep
        length = np.maximum(np.linalg.norm(dropped, axis=1, keepdims=True), 1e-12)
        return x, normed, keep, length, dropped / length

    def backward(x, normed, keep, length, unit, loss, slope) -> list[np.ndarray]:
        slope = slope - (slope * unit).sum(axis=1, keepdims=True) * unit
        dy = slope / length * keep / n
        return [loss.sum(), dy.sum(axis=0), (dy * normed).sum(axis=0), dy.T @ x, normed.T @ x, x.sum(axis=0)]

    def gradient_sums(part: pa.RecordBatch) -> list[np.ndarray]:
        labels, sums = part.column(0).to_numpy(), []
        for i in range(len(heads)):
            state = forward(part, i)
            sums += backward(*state, *arcface_loss_and_gradient(state[-1], labels, n_classes, **loss_options))
        return sums

    if n_classes <= shard_classes:
        sums = _summed(batch, gradient_sums, n_tasks)
    else:
        # one batch, whose size is a parameter
        rows = batch.toArrow().combine_chunks()
        part = rows.to_batches()[0]
        states = [forward(part, i) for i in range(len(heads))]
        units = [state[-1] for state in states]
        found = sharded_softmax(batch.sparkSession, units, part.column(0).to_numpy(), n_classes, **loss_options)
        sums = []
        for state, (loss, slope) in zip(states, found):
            sums += backward(*state, loss, slope)
    results = []
    for i, (head, (mean, var)) in enumerate(zip(heads, stats)):
        loss, beta, gamma, dy_x, normed_x, x_sum = sums[6 * i : 6 * i + 6]
        lever = (head.bn_gamma / np.sqrt(var + BN_EPS))[:, None]
        weight = lever * (dy_x - np.outer(beta / n, x_sum) - (gamma / n)[:, None] * normed_x)
        # Batch normalisation removes any shift, so the bias has no gradient.
        gradients = {
            "weight": weight,
            "bias": np.zeros_like(head.bias),
            "bn_gamma": gamma,
            "bn_beta": beta,
        }
        head.bn_mean = (1 - BN_MOMENTUM) * head.bn_mean + BN_MOMENTUM * mean
        head.bn_var = (1 - BN_MOMENTUM) * head.bn_var + BN_MOMENTUM * var * n / (n - 1)
        results.append((float(loss / n), gradients))
    return results


def sharded_softmax(
    spark: SparkSession,
    units: Sequence[np.ndarray],
    labels: np.ndarray,
    n_classes: int,
    *,
    margin_degrees: float,
    scale: float,
    seed: int,
    shard_blocks: int = SHARD_BLOCKS,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Loss and gradient of each unit row, the classes dealt to tasks in ranges of ``shard_blocks`` blocks.

    Every task does the same work however many classes there are; more classes are
    more tasks. The first round brings back three numbers a row and task, the second
    adds up one slope a row.
    """
    blocks = -(-n_classes // _CLASS_BLOCK)
    shards = -(-blocks // shard_blocks)
    options = (n_classes, np.deg2rad(margin_degrees), scale, seed)
    batch = spark.sparkContext.broadcast((list(units), labels))  # one batch of rows
    ranges = spark.range(0, shards, 1, shards)

    def starts_of(shard: int) -> range:
        return range(shard * shard_blocks * _CLASS_BLOCK, min(n_classes, (shard + 1) * shard_blocks * _CLASS_BLOCK), _CLASS_BLOCK)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own_labels = batch.value
        for part in batches:
            for shard in part.column(0).to_pylist():
                packed = []
                for e in rows:
                    packed += log_sums(e, own_labels, starts_of(shard), *options)
                yield _packed(packed)

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpacked(r["shapes"], r["data"]) for r in table.to_pylist()]
        return pa.Table.from_batches([_packed(_joined(parts))])

    schema = "shapes array<array<int>>, data binary"
    found, left = ranges.mapInArrow(sums, schema), shards
    while left > _FAN_IN:
        left = -(-left // _FAN_IN)
        found = found.groupBy(F.pmod(F.spark_partition_id(), F.lit(left)).alias("slot")).applyInArrow(merge, schema)
    whole = _joined([_unpacked(r["shapes"], r["data"]) for r in found.collect()])
    tops = spark.sparkContext.broadcast(whole)

    def slope_sums(part: pa.RecordBatch) -> list[np.ndarray]:
        rows, own_labels = batch.value
        total = [np.zeros_like(e) for e in rows]
        for shard in part.column(0).to_pylist():
            for i, e in enumerate(rows):
                total[i] += slopes(e, own_labels, starts_of(shard), tops.value[3 * i], tops.value[3 * i + 1], *options)
        return total

    slope = _summed(ranges, slope_sums, shards)
    losses = [whole[3 * i] + np.log(whole[3 * i + 1]) - whole[3 * i + 2] for i in range(len(units))]
    return list(zip(losses, slope))


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Softmax sums of disjoint ranges of classes as those of their union."""
    whole = [a.copy() for a in parts[0]]
    for part in parts[1:]:
        for i in range(0, len(whole), 3):
            peak = np.maximum(whole[i], part[i])
            whole[i + 1] = whole[i + 1] * np.exp(whole[i] - peak) + part[i + 1] * np.exp(part[i] - peak)
            whole[i] = peak
            whole[i + 2] = whole[i + 2] + part[i + 2]  # only one range holds a row's class
    return whole


def _validation_losses(heads: Sequence[ProjectionHead], val: DataFrame, n_classes: int, options: dict) -> list[float]:
    """For each head the mean over batches of their mean loss, as the training loss is reported.

    ``val`` holds class_id, batch, then a vector for each head.
    """
    names = [f"loss{i}" for i in range(len(heads))]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _LOSS_ROWS):
                part = whole.slice(at, _LOSS_ROWS)
                columns = [part.column(1)]
                for i, head in enumerate(heads):
                    unit = head.project(matrix(part.column(2 + i)))
                    labels = part.column(0).to_numpy()
                    loss, _ = arcface_loss_and_gradient(unit, labels, n_classes, **options, gradient=False)
                    columns.append(pa.array(loss))
                yield pa.RecordBatch.from_arrays(columns, names=["batch", *names])

    scored = val.mapInArrow(losses, ", ".join(["batch long", *[f"{n} double" for n in names]]))
    by_batch = scored.groupBy("batch").agg(*[F.avg(n).alias(n) for n in names])
    return list(by_batch.agg(*[F.avg(n) for n in names]).first())


def validation_metrics(
    heads: Mapping[str, tuple[ProjectionHead, str]],
    val: DataFrame,
    *,
    id_col: str = "posting_id",
    group_col: str = "label_group",
) -> dict[str, dict[str, float]]:
    """Mean retrieval metrics of the validation rows among themselves, projected by each head.

    ``heads`` maps a name to a head and its vector column. One search and one
    aggregate serve all of them.
    """
    projected = None
    for name, (head, column) in heads.items():
        rows = val.select(id_col, group_col, F.col(column).alias("embedding"))
        rows = apply_head(rows, head).withColumn("_head", F.lit(name))
        projected = rows if projected is None else projected.unionByName(rows)
    projected = materialize(projected)
    found = knn_self_join(
        projected, k=RETRIEVAL_K, threshold=RETRIEVAL_THRESHOLD, id_col=id_col, carry=[group_col], within=["_head"]
    )
    rows = mx.metrics_from_neighbors(
        projected.withColumn("stratum", F.lit(None).cast("string")),
        found,
        RETRIEVAL_RECALL_KS,
        id_col=id_col,
        group_col=group_col,
        by=["_head"],
    )
    columns = mx.metric_columns(rows, ("_head", id_col, group_col, "stratum"))
    means = rows.groupBy("_head").agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).collect()  # a row a head
    return {
        r["_head"]: {(c if c.startswith("recall-") else f"avg_{c}"): float(r[c]) for c in columns} for r in means
    }


class _Run:
    """One head on its way: optimiser, best state so far, epochs without progress."""

    def __init__(self, column: str, input_dim: int, projection_dim: int, seed: int, weight_decay: float) -> None:
        self.column, self.input_dim = column, input_dim
        self.head = ProjectionHead.initial(input_dim, projection_dim, seed)
        self.optimiser = _AdamW(self.head, weight_decay)
        self.best: tuple[ProjectionHead, dict[str, float]] | None = None
        self.best_f1, self.misses = 0.0, 0
        self.losses: list[float] = []
        self.history: list[tuple[int, str, float]] = []

    def close_epoch(self, epoch: int, rate: float, val_loss: float, scores: dict[str, float]) -> None:
        log = {"train_loss": float(np.mean(self.losses)), "val_loss": val_loss, **scores, "learning_rate": float(rate)}
        self.history += [(epoch, name, value) for name, value in log.items()]
        self.losses = []
        if scores["avg_f1"] > self.best_f1:
            self.best, self.best_f1, self.misses = (copy.deepcopy(self.head), scores), scores["avg_f1"], 0
        else:
            self.misses += 1


def fit_head(train: DataFrame, val: DataFrame, *, vec_col: str = "embedding", fusion_type: str | None = None, **options) -> Fit:
    """``fit_heads`` for one vector column."""
    return fit_heads(train, val, {vec_col: vec_col}, fusion_types={vec_col: fusion_type}, **options)[vec_col]


def fit_heads(
    train: DataFrame,
    val: DataFrame,
    vec_cols: Mapping[str, str],
    *,
    projection_dim: int = 512,
    samples_per_class: int = 4,
    learning_rate: float = 1e-3,
    weight_decay: float = 1e-4,
    batch_size: int = 256,
    num_epochs: int = 50,
    margin_degrees: float = 28.6,
    scale: float = 64.0,
    early_stopping_patience: int = 5,
    batches_per_epoch: int | None = None,
    fusion_types: Mapping[str, str | None] | None = None,
    shard_classes: int = SHARD_CLASSES,
    seed: int = 42,
    id_col: str = "posting_id",
    label_col: str = "label_group",
) -> dict[str, Fit]:
    """Train a head for each vector column of ``train``, keep those with the best F1 on ``val``.

    ``vec_cols`` maps a variant's name to its column. The heads see the same
    samples, and each gets what it would get alone. Classes span both splits. An epoch
    is one pass over the classes, or ``batches_per_epoch`` random batches. A head stops
    after ``early_stopping_patience`` epochs without a strictly better F1; one whose F1
    never leaves zero raises.
    """
    columns = [F.col(id_col), F.col(label_col), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(vec_cols.values())]]
    train, val = materialize(train.select(*columns)), materialize(val.select(*columns))
    ids = materialize(class_ids(train, val, label_col=label_col))
    n_classes = ids.count()
    key = F.xxhash64(F.lit(seed), id_col)
    train = materialize(train.join(ids, label_col).withColumn("row_key", key))
    ranked = rank_by_hash(
        val.join(ids, label_col).withColumn("_order", hash_order(seed, id_col)), "_order", name="_rank"
    )
    batch = F.floor((F.col("_rank") - 1) / batch_size).cast("long")
    val = materialize(ranked.withColumn("batch", batch).drop("_rank", "_order"))
    first = train.select(*[F.size(f"_v{i}") for i in range(len(vec_cols))]).first()
    if first is None:
        raise ValueError("no training rows")
    runs = {
        name: _Run(f"_v{i}", first[i], projection_dim, seed, weight_decay) for i, name in enumerate(vec_cols)
    }
    # An epoch's sample has m rows per class; at least as many parts as there are cores.
    bytes_parts = -(-n_classes * samples_per_class * 4 * sum(first) // _TASK_BYTES)
    parts = max(bytes_parts, train.sparkSession.sparkContext.defaultParallelism)
    loss_options = {"margin_degrees": margin_degrees, "scale": scale, "seed": seed}
    placed = None
    if batches_per_epoch is not None:
        placed = ranked_rows(train, seed=seed, id_col=id_col, label_col=label_col)
    done = 0
    for epoch in range(1, num_epochs + 1):
        active = {name: r for name, r in runs.items() if r.misses < early_stopping_patience}
        if not active:
            break
        rate = learning_rate / 2 * (1 + np.cos(np.pi * (epoch - 1) / num_epochs))
        options = {"m": samples_per_class, "batch_size": batch_size, "seed": seed, "epoch": epoch}
        if batches_per_epoch is None:
            drawn = m_per_class_sample(train, id_col=id_col, label_col=label_col, **options)
        else:
            drawn = random_batches(
                train, batches=batches_per_epoch, id_col=id_col, label_col=label_col, ranked=placed, **options
            )
        sample = (
            drawn
            # One slot, one row key: repeats of a row get their own dropout.
            .withColumn("row_key", F.col("row_key").bitwiseXOR(F.col("slot").cast("long")))
            .select("class_id", "row_key", *[r.column for r in active.values()], "step")
            # Rows of every step lie in all partitions, sorted by step, so a step runs
            # on as many tasks as there are parts and skips the other cached batches.
            .repartition(parts, "row_key")
            .sortWithinPartitions("step", "row_key")
            .persist()
        )
        try:
            steps = sample.agg(F.max("step")).first()[0] + 1
            heads = [r.head for r in active.values()]
            for step in range(steps):
                part = sample.where(F.col("step") == step).drop("step")
                results = train_steps(
                    heads, part, n_classes, step=done, n_tasks=parts, shard_classes=shard_classes, **loss_options
                )
                for r, (loss, gradients) in zip(active.values(), results):
                    r.optimiser.update(r.head, gradients, rate)
                    r.losses.append(loss)
                done += 1
        finally:
            sample.unpersist()
        with scratch(val.sparkSession):  # projected rows are needed for their metrics only
            scores = validation_metrics(
                {name: (r.head, r.column) for name, r in active.items()}, val, id_col=id_col, group_col=label_col
            )
        losses = _validation_losses(
            heads, val.select("class_id", "batch", *[r.column for r in active.values()]), n_classes, loss_options
        )
        for (name, r), loss in zip(active.items(), losses):
            r.close_epoch(epoch, rate, loss, scores[name])
    lost = [name for name, r in runs.items() if r.best is None]
    if lost:
        raise ValueError(f"validation F1 never rose above zero for {lost}; no head to keep")
    settings = {
        "projection_dim": projection_dim,
        "samples_per_class": samples_per_class,
        "num_classes": n_classes,
        "learning_rate": learning_rate,
        "weight_decay": weight_decay,
        "batch_size": batch_size,
        "num_epochs": num_epochs,
        "margin": margin_degrees,
        "scale": scale,
        "early_stopping_patience": early_stopping_patience,
    }
    fusion = fusion_types or {}
    return {
        name: Fit(
            *r.best,
            {"input_dim": r.input_dim, **settings, "fusion_type": fusion.get(name) or "none"},
            r.history,
        )
        for name, r in runs.items()
    }
