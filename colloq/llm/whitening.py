"""Embedding whitening by a one-sided Jacobi SVD behind a blockwise TSQR.

Entries are scaled to whole numbers. The covariance and all else that is fitted belongs to the distinct vectors, each once.
Tasks centre their rows, compress blocks of them to triangles by QR, and the triangles of tasks are stacked and compressed again
in rounds of a bounded fan-in, until one triangle R is left with R'R = n V, V the covariance. No product of rows is ever summed, so
small standard deviations keep their digits. R has as many columns as a vector has entries, whatever the table; its columns
are made orthogonal by plane rotations (one-sided Jacobi, all disjoint pairs of a round at once): the rotations
multiply to the components, and the lengths of the columns are the standard deviations times the root of n.

Whole numbers are exact: sums and deviations are taken in 64 bits while a bound shows that these suffice, else in
Python's integers; a deviation beyond 63 bits is null, as its column can't hold it.

Defined cases: rows without a vector, or with a null or non-finite entry, give no row; repeated vectors are fitted once and
all answered; a null vec_id is answered like any other; scaled entries beyond 63 bits are those nearest to them; shorter vectors count as
followed by zeros up to the longest; a component without variance (rank below the number of components, a single
vector) has whitened and explained 0 and is left out of the identity error; equal eigenvalues give any orthogonal basis of
their space; other columns are ignored; an empty table, or one of empty vectors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.session import cut, drop_table, write_table

SCALE = 256
COMPONENTS = 4
#: Rows that one QR takes at a time, and bytes of triangles that one task of a round stacks.
BLOCK = 4096
STACK_BYTES = 32 << 20
SWEEPS = 60
LONG = 1 << 63


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the valid rows, their entries as whole numbers."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where(F.col("c").isNotNull() & finite).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column(name), width)


def _whole(x: np.ndarray, largest: int) -> np.ndarray:
    """``x`` as it is if results up to ``largest`` fit in 63 bits, else as Python's integers."""
    return x if largest < LONG else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def column_sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each entry: one row a task and entry, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in _blocks(batches, "x", width):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _whole(x, _largest(x) * len(x)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(s) for s in (n, *sums)])], names=["at", "total"])

    parts = distinct.select("x").mapInArrow(partial, "at int, total string")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())  # a number per entry of a vector
    return int(found.get(-1) or 0), [int(found.get(k) or 0) for k in range(width)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n x - S) / n as doubles, the difference exact."""
    return (_whole(x, 2 * n * max(_largest(x), 1) + _largest(sums)) * n - sums).astype(np.float64) / n


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def in_rounds(parts: DataFrame, merge: Callable[[list[bytes]], bytes], fan_in: int) -> bytes | None:
    """One value of (part, value), merged by at most ``fan_in`` neighbours a task until one is left."""
    level = cut(parts)
    n = level.agg(F.max("part").alias("n")).first()["n"]
    if n is None:
        return None

    def merged(key, table: pa.Table) -> pa.Table:
        values = [v.as_py() for v in table.sort_by("part").column("value")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([merge(values)], pa.binary())})

    n += 1
    while n > 1:
        n = -(-n // fan_in)
        group = F.floor(F.col("part") / fan_in).cast("long")
        # a group has at most fan_in rows
        level = level.select(group.alias("group"), "part", "value").groupBy("group").applyInArrow(lambda k, t: merged(k, t), "part bigint, value binary")
    return bytes(level.first()["value"])


def _per_task(rows: DataFrame, compress: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """(part, value): what ``compress`` makes of each task's batches."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = compress(batches)
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], names=["part", "value"])

    return rows.mapInArrow(run, "part bigint, value binary")


def tsqr(distinct: DataFrame, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows: R'R is n times their covariance."""

    def stacked(found: list[bytes]) -> bytes:
        return triangle(np.vstack([np.frombuffer(v).reshape(-1, width) for v in found])).tobytes()

    def compress(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = np.zeros((0, width))
        for _, x in _blocks(batches, "x", width):
            r = triangle(np.vstack([r, centred(x, n, sums)]))
        return r.tobytes() if len(r) else None

    fan_in = max(2, min(32, STACK_BYTES // (8 * width * width)))
    return np.frombuffer(in_rounds(_per_task(distinct.select("x"), compress), stacked, fan_in) or b"").reshape(-1, width)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, lengths) by falling length: plane rotations from the right until all columns are orthogonal."""
    width = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(width)
    scale = np.abs(a).max(initial=0.0)
    if scale:
        a /= scale
    even = width + width % 2
    ring = np.arange(even)
    tiny = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(even - 1):  # a round robin: every two columns meet once a sweep
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            met = (p < width) & (q < width)
            p, q = p[met], q[met]
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            off = np.abs(gamma) > tiny * np.sqrt(alpha * beta)
            if off.any():
                turned = True
                p, q, alpha, beta, gamma = p[off], q[off], alpha[off], beta[off], gamma[off]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if not turned:
            break
    lengths = np.sqrt((a**2).sum(0)) * scale
    order = np.argsort(-lengths, kind="stable")
    v = v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))
    top = np.abs(v).argmax(0)
    return v * np.where(v[top, np.arange(width)] < 0, -1.0, 1.0), lengths[order]


def _moments(parts: list[bytes], k: int) -> bytes:
    """Counts, means and centred products of several sets of rows as those of their union."""
    n, mean, product = 0.0, np.zeros(k), np.zeros((k, k))
    for part in parts:
        v = np.frombuffer(part)
        m, other, more = v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)
        gap = other - mean
        product = product + more + np.outer(gap, gap) * (n * m / (n + m))
        mean, n = mean + gap * (m / (n + m)), n + m
    return np.concatenate(([n], mean, product.ravel())).tobytes()


def _whitened_covariance(distinct: DataFrame, width: int, n: int, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    k = weights.shape[1]

    def compress(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        found = []
        for _, x in _blocks(batches, "x", width):
            z = centred(x, n, sums) @ weights
            z0 = z - z.mean(0)
            found.append(np.concatenate(([float(len(z))], z.mean(0), (z0.T @ z0).ravel())).tobytes())
            found = [_moments(found, k)]
        return found[0] if found else None

    total = in_rounds(_per_task(distinct.select("x"), compress), lambda parts: _moments(parts, k), 32)
    return np.frombuffer(total)[k + 1 :].reshape(k, k) / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per valid row and component."""
    rows = scaled(vectors)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = write_table(rows.select("x").distinct())
    sizes = found.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = sizes["most"] or 0
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    if sizes["least"] < width:
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x")))
        short, found = found, write_table(found.select(filled.alias("x")).distinct())
        drop_table(short)
    n, total = column_sums(found, width)
    sums = np.array(total, dtype=np.int64 if max(map(abs, total)) < LONG else object)
    r = tsqr(found, width, n, sums)
    v, lengths = jacobi(r)
    k = min(components, width)
    there = lengths[:k] > max(n, width) * np.finfo(np.float64).eps * lengths[0]
    deviations = np.where(there, lengths[:k], 1.0) / np.sqrt(n)
    weights = np.where(there, v[:, :k] / deviations, 0.0)
    spread = (lengths**2).sum()
    explained = np.where(there, lengths[:k] ** 2 / (spread or 1.0), 0.0)
    error = np.abs(_whitened_covariance(found, width, n, sums, weights) - np.eye(k))[np.ix_(there, there)].max(initial=0.0)
    drop_table(found)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x", width):
            m = len(x)
            gap = _whole(x, n * max(_largest(x), 1) + _largest(sums)) * n - sums
            gap = _whole(gap, _largest(gap) ** 2 * width)
            deviation = [int(d) if d < LONG else None for d in (gap * gap).sum(axis=1)]
            z = (gap.astype(np.float64) / n) @ weights
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(np.repeat(np.array(deviation, dtype=object), k), pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(answered, schema)
