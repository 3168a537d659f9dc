"""Whitening of embeddings by spectral divide and conquer.

Tasks reduce the vectors to one covariance matrix, whose size is that of a vector
squared. Its eigenvectors come from polar decompositions alone: the polar factor U of
a shifted covariance A - s I, by the dynamically weighted Halley iteration on QR
factors (QDWH), has eigenvalues -1 and 1, so (U + I) / 2 projects on the eigenvectors
of A above s. An orthonormal basis of that subspace and one of its complement split A
in two smaller problems, down to blocks that are a number times the identity. The
rows then meet the broadcast whitening matrix, one projection each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import longs_again, longs_as_text, stored

EPS = np.finfo(float).eps
FAN_IN = 16
# Beyond this a scaled entry is held: its square sums would leave any exact arithmetic.
LARGEST = 2**52


def polar_factor(a: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH with QR factors.

    ``l`` bounds the least singular value of the iterate from below. It starts at the
    rounding level, for which six rounds are enough in theory.
    """
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the greatest singular value
    low, eye = EPS, np.eye(n)
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1 - EPS)
        if moved < np.cbrt(EPS) and 1 - low < 10 * EPS:
            break
    return x


def _bases(a: np.ndarray, shift: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors of ``a`` above and below ``shift``, or None.

    None if all lie on one side, or one lies so near the shift that its side is not known.
    """
    n = len(a)
    u = polar_factor(a - shift * np.eye(n))
    above = (n + np.trace(u)) / 2
    k = int(round(above))
    if not 0 < k < n or abs(above - k) > 1e-6:
        return None
    projector = (u + np.eye(n)) / 2
    start = projector @ random.standard_normal((n, k))
    for _ in range(3):
        q, _ = np.linalg.qr(start, mode="complete")
        upper, lower = q[:, :k], q[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 10 * n * EPS * np.linalg.norm(a):
            break
        start = projector @ upper  # a step of subspace iteration
    return upper, lower


def spectral_split(a: np.ndarray, top: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` greatest eigenvalues, falling, of a symmetric matrix, and unit eigenvectors as columns.

    Blocks below the ``top`` first are not split further. A block whose entries differ
    from a number times the identity by rounding alone is final: any basis of it serves.
    """
    random = np.random.default_rng(seed)
    scale = np.linalg.norm(a)
    values, vectors = [], []
    blocks = [(a, np.eye(len(a)))]  # the last is the one with the greatest eigenvalues
    while blocks and sum(map(len, values)) < top:
        block, basis = blocks.pop()
        n = len(block)
        block = (block + block.T) / 2
        mean = np.trace(block) / n
        spread = np.linalg.norm(block - mean * np.eye(n))
        halves = None
        if n > 1 and spread > 4 * n * EPS * scale:
            # the median splits evenly; the mean always has eigenvalues on both sides
            tries = [np.median(np.diag(block)), mean]
            tries += [mean + spread / np.sqrt(n) * step for step in random.uniform(-1, 1, 20)]
            for shift in tries:
                halves = _bases(block, shift, random)
                if halves:
                    break
        if halves is None:
            diagonal = np.diag(block)
            order = np.argsort(-diagonal, kind="stable")
            values.append(diagonal[order])
            vectors.append(basis[:, order])
            continue
        for half in halves[::-1]:
            blocks.append((half.T @ block @ half, basis @ half))
    if not values:
        return np.zeros(0), np.zeros((len(a), 0))
    return np.concatenate(values)[:top], np.concatenate(vectors, axis=1)[:, :top]


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), width)


def _merge(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred second moments of two sets as those of their union."""
    n, apart = a[0] + b[0], b[1] - a[1]
    if not n:
        return a
    between = np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + between


def _moments(values: DataFrame, width: int, project) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred second moment of ``project(rows)`` over all rows of ``values`` (x).

    Each task emits one matrix of ``width`` squared. Matrices are merged ``FAN_IN`` at a
    time, so no task or driver holds more than that many.
    """

    def pack(key: int, state: tuple) -> pd.DataFrame:
        n, mean, second = state
        return pd.DataFrame({"key": [key], "n": [n], "mean": [mean.tobytes()], "second": [second.tobytes()]})

    def unpack(row) -> tuple:
        return int(row.n), np.frombuffer(row.mean), np.frombuffer(row.second).reshape(width, width)

    empty = (0, np.zeros(width), np.zeros((width, width)))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = empty
        for batch in batches:
            if len(batch):
                y = project(batch["x"])
                mean = y.mean(axis=0)
                y = y - mean
                state = _merge(state, (len(y), mean, y.T @ y))
        if state[0]:
            yield pack(TaskContext.get().partitionId(), state)

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        state = empty
        for row in group.sort_values("key").itertuples(index=False):
            state = _merge(state, unpack(row))
        return pack(int(key[0]), state)

    layout = "key long, n long, mean binary, second binary"
    partial = stored(values.mapInPandas(reduce, layout), "moments")
    while (partial.agg(F.max("key")).first()[0] or 0) > 0:
        upper = partial.groupBy(F.floor(F.col("key") / FAN_IN).alias("upper")).applyInPandas(merge, layout)
        partial = stored(upper, "moments")
    row = partial.first()
    return unpack(row) if row else empty


def _centre(n: int, sums_of: list[int], width: int):
    """Rows x as (x - S / n, text of the exact sum of (n * x - S)^2).

    n * x - S is taken in whole numbers, as n * (x - q) - r with S = q * n + r, so that
    nothing is lost before a square or product is formed.
    """
    whole = np.array([s // max(n, 1) for s in sums_of], dtype=np.int64)
    rest = np.array([s % max(n, 1) for s in sums_of], dtype=np.int64)

    def centre(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        near = _matrix(rows, width) - whole
        far = max(abs(int(near.max())), abs(int(near.min()))) + 1 if near.size else 1
        exact = n * near - rest if n * far < 2**62 else n * near.astype(object) - rest.astype(object)
        offsets = exact.astype(float)
        rough = (offsets * offsets).sum(axis=1) / 2.0**63
        squares = np.full(len(near), None, dtype=object)
        fits = rough < 0.999999  # then no partial sum of squares leaves a long
        squares[fits] = (exact[fits] * exact[fits]).sum(axis=1).astype(str)
        for row in np.flatnonzero(~fits & (rough < 1.000001)):
            squares[row] = str(sum(int(v) ** 2 for v in exact[row]))
        return offsets / max(n, 1), squares

    return centre


def whiten(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    components: int = 16,
    scale: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: rows on their components.

    An entry c becomes the long x = floor(scale * c) + offset. The fit list is every
    distinct vector x once: ``n`` of them, with sums S. Components are unit eigenvectors
    of their covariance (divisor n), numbered from 1 by falling eigenvalue e.
    ``deviation`` is the sum of (n * x - S)^2, exact, or null beyond a long; ``whitened``
    is x - S / n on the component over sqrt(e); ``explained`` is e over the trace;
    ``identity_error`` is the largest entry of the whitened fit list's covariance minus
    the identity.

    Rows take no part whose vector is null or empty, holds null or non-finite entries,
    or has another length than most (the longer, in a tie), since no component fits
    them. Repeated rows, ids and null ids each give their own rows. Where e is zero up to
    rounding, nothing can be whitened: ``whitened`` is null, and ``identity_error`` covers
    the other components (null if there are none); ``explained`` is null where all
    vectors are equal. No rows give none. Scaled entries beyond 2^52 count as 2^52.
    """
    c = F.col(f"`{embedding}`")
    whole = F.forall(
        c,
        lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")),
    )
    entry = lambda v: F.greatest(
        F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * scale).cast("long"))
    ) + F.lit(offset)
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.when(whole, F.transform(c, entry)).alias("x")
    ).filter("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 1
    rows = rows.filter(F.size("x") == width)
    fit = stored(rows.select("x").distinct(), "fit")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            n += len(batch)
            x = _matrix(batch["x"], width)
            # summed in two halves, neither of which can leave a long
            high, low = (x >> 20).sum(axis=0).astype(object), (x & (2**20 - 1)).sum(axis=0).astype(object)
            total = total + high * 2**20 + low
        yield pd.DataFrame({"dim": np.arange(-1, width), "total": [str(v) for v in [n, *total]]})

    found = fit.mapInPandas(sums, "dim int, total string")
    totals = dict(found.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    n = int(totals.get(-1) or 0)
    sums_of = [int(totals.get(i) or 0) for i in range(width)]
    centre = _centre(n, sums_of, width)

    _, _, second = _moments(fit, width, lambda x: centre(x)[0])
    covariance = second / max(n, 1)
    values, directions = spectral_split(covariance, min(components, width))
    trace = float(np.trace(covariance))
    flat = values <= 4 * width * EPS * np.linalg.norm(covariance)
    matrix = directions / np.sqrt(np.where(flat, 1, values))
    good = np.flatnonzero(~flat)
    error = None
    if len(good):
        _, _, spread = _moments(fit, len(good), lambda x: centre(x)[0] @ matrix[:, good])
        error = float(np.abs(spread / n - np.eye(len(good))).max())
    # components * width numbers, whatever the number of rows
    shared = rows.sparkSession.sparkContext.broadcast(matrix)
    explained = [float(e / trace) if trace else None for e in values]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = len(values)
        for batch in batches:
            if not len(batch):
                continue
            offsets, deviation = centre(batch["x"])
            y = (offsets @ shared.value).astype(object)
            y[:, flat] = None
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].repeat(kinds).array,
                    "component": np.tile(np.arange(1, kinds + 1, dtype=np.int32), len(batch)),
                    "n": n,
                    "deviation": np.repeat(deviation, kinds),
                    "whitened": y.ravel(),
                    "explained": explained * len(batch),
                    "identity_error": [error] * (kinds * len(batch)),
                }
            )

    carried = longs_as_text(rows, ["vec_id"])
    kind = carried.schema["vec_id"].dataType.simpleString()
    out = carried.mapInPandas(
        project,
        f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double,"
        " identity_error double",
    )
    return longs_again(out, rows).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
