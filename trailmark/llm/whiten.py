"""Whitening of embeddings with leading eigenvectors from a Jacobi-Davidson iteration over distributed products.

Entries become integers, ``floor(scale * entry)``; the covariance is that of the distinct integer vectors (divisor n). Its
matrix is never formed. The one thing asked of the data is the product of the covariance with a few vectors, a sum over rows
of ``(x - mean) ((x - mean) . u)``, centred before it is multiplied; a pass over the written list of vectors gives it for a
whole block of vectors u, and all that reaches the driver is one block of that size.

* A search space holds some orthonormal directions and their products. Rayleigh-Ritz in it gives the best approximations to
  the leading pairs, and their residuals.
* For every pair that is not done, the correction equation ``(I - QQ') (V - theta) (I - QQ') t = -r`` is solved roughly by
  MINRES, where Q has the locked and the current vectors. The equations of all pairs run in step, so that a step is one pass.
* The corrections widen the space. A pair whose residual has come down to rounding is locked: it leaves the space, which
  stays orthogonal to it from then on. A space that has grown too large starts again from its best vectors.

The iteration ends when all pairs are locked. Rounding is a residual of `ROUNDING` times the largest eigenvalue, or one that
no longer falls although it is below `SETTLED` times it.

Rows whose vector is null or has null or non-finite entries are dropped; so are rows whose vector has another length than
most have (of equally frequent lengths the greatest counts), an empty vector among them. Repeated vectors count once in the
fit and are whitened each. A component without variance has no whitened value and is left out: fewer distinct vectors than
components, constant entries or an empty table give fewer components or no rows. The sign of a component is such that its
largest entry is positive; among equal eigenvalues any orthonormal basis is right.
"""

from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.session import written

SCALE = 256
COMPONENTS = 4
ROUNDING = 1e-14
SETTLED = 2e-13
INNER = 10  # passes for the corrections of a round at most
ENOUGH = 0.05  # residual of a correction, as a part of its right side
ROUNDS = 200  # a run that does not end by then is an error
LARGEST = 2**63 - 1


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: "numpy.ndarray"  # noqa: F821
    axes: "numpy.ndarray"  # noqa: F821
    explained: "numpy.ndarray"  # noqa: F821
    identity_error: float


def rows_of(column: pa.Array):
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integers(rows: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, x) with the vectors that count as integers, in a written table."""
    entry = F.col(vector)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(entry) > 0))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return written(sound.select(F.col(id).alias("id"), x.alias("x")), "integers")


def of_common_length(rows: DataFrame) -> tuple[DataFrame, int]:
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("x") == size), size


def integer_sums(vectors: DataFrame) -> list[int]:
    """The sum of each entry over all vectors, exactly."""

    def add(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = rows_of(batch.column("x")).astype(object).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(map(str, total)))], ["place", "total"])

    parts = vectors.select("x").mapInArrow(add, "place int, total string")
    sums = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return [int(row["total"]) for row in sorted(sums)]


def summed(vectors: DataFrame, of_batch, shape: tuple[int, ...]):
    """The sum of what `of_batch` makes of the rows of each batch, an array of this shape, over all batches.

    A task leaves one row, and one task adds these up as they come.
    """
    import numpy as np

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += of_batch(rows_of(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    def add_up(batches):
        total = np.zeros(int(np.prod(shape)))
        for batch in batches:
            if len(batch):
                total += rows_of(batch.column("sums")).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = vectors.select("x").mapInArrow(add, "sums array<double>").repartition(1)
    (row,) = parts.mapInArrow(add_up, "sums array<double>").collect()  # a limit would end the Python worker each time
    return np.array(row["sums"]).reshape(shape)


def orthonormal(block, against):
    """The block made orthonormal to `against` and in itself; directions that vanish are dropped."""
    import numpy as np

    kept = []
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in (against, np.array(kept).T if kept else against[:, :0]):
                column = column - basis @ (basis.T @ column)
        if size and np.linalg.norm(column) > 1e-8 * size:
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T if kept else block[:, :0]


def minres(apply, right, steps: int, enough: float):
    """Approximate solutions of symmetric equations, one per column; `apply` gets all columns at once."""
    import numpy as np

    norm = np.linalg.norm(right, axis=0)
    x, before = np.zeros_like(right), np.zeros_like(right)
    now = right / np.where(norm > 0, norm, 1)
    beta = np.zeros_like(norm)  # couples `before` and `now`
    w1, w2 = np.zeros_like(right), np.zeros_like(right)
    c1, c2, s1, s2 = np.ones_like(norm), np.ones_like(norm), np.zeros_like(norm), np.zeros_like(norm)
    rest = norm.copy()  # the residual, with a sign
    for _ in range(steps):
        if np.all(np.abs(rest) <= enough * norm):
            break
        # A column of the tridiagonal matrix, by Lanczos; the last two rotations turn it into one of a triangle.
        image = apply(now)
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * before
        following = np.linalg.norm(image, axis=0)
        far, near, own = s2 * beta, c1 * c2 * beta + s1 * alpha, c1 * alpha - s1 * c2 * beta
        size = np.hypot(own, following)
        live = size > 0
        safe = np.where(live, size, 1)
        c, s = np.where(live, own / safe, 1), np.where(live, following / safe, 0)
        w = (now - near * w1 - far * w2) / safe
        x = x + np.where(live, c * rest, 0) * w
        rest = np.where(live, -s * rest, 0)
        w1, w2, c1, c2, s1, s2 = w, w1, c, c1, s, s1
        before, now, beta = now, image / np.where(following > 0, following, 1), following
    return x


def leading(product, size: int, k: int):
    """The `k` largest eigenvalues of a symmetric matrix and their vectors, from products with blocks of vectors."""
    import numpy as np

    draw = np.random.default_rng(7)
    k = min(k, size)
    space = orthonormal(draw.standard_normal((size, min(size, 2 * k))), np.zeros((size, 0)))
    locked, values, last, largest = np.zeros((size, 0)), [], np.full(k, np.inf), 0.0
    for _ in range(ROUNDS):
        # Rayleigh-Ritz. Images are made anew, for rotated ones would gather rounding.
        images = product(space)
        h = space.T @ images
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        largest = max(largest, float(np.abs(theta[0])))
        wanted = min(k - len(values), space.shape[1])
        rest = images[:, :wanted] - space[:, :wanted] * theta[:wanted]
        rest -= locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        # Pairs are locked from the first on, so that none is passed over.
        done = 0
        while done < wanted:
            at, now = len(values) + done, sizes[done]
            before, last[at] = last[at], min(last[at], now)
            if now > ROUNDING * largest and not (now <= SETTLED * largest and now > before / 2):
                break
            done += 1
        values += theta[:done].tolist()
        locked = np.hstack([locked, orthonormal(space[:, :done], locked)])
        if len(values) == k:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        space, theta, rest = space[:, done:], theta[done:], rest[:, done:]
        space = space[:, : 3 * k] if space.shape[1] > 5 * k else space
        wanted = rest.shape[1]
        away = np.hstack([locked, space[:, :wanted]])

        def aside(block, away=away):
            return block - away @ (away.T @ block)

        def corrected(block, aside=aside, shift=theta[:wanted]):
            block = aside(block)
            return aside(product(block) - shift * block)

        basis = np.hstack([locked, space])
        added = orthonormal(minres(corrected, -aside(rest), INNER, ENOUGH), basis) if wanted else basis[:, :0]
        if not added.shape[1] and basis.shape[1] < size:
            added = orthonormal(draw.standard_normal((size, 1)), basis)
        space = np.hstack([space, added])
    raise RuntimeError("eigenvectors did not settle")


def fit(vectors: DataFrame, size: int, k: int = COMPONENTS) -> Whitening | None:
    """Mean and leading components of distinct integer vectors (x) of one length; None if there are none."""
    import numpy as np

    n = vectors.count()
    if not n:
        return None
    sums = integer_sums(vectors)
    mean = np.array([total / n for total in sums])  # integers divide with correct rounding

    def product(block):
        def of_batch(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(vectors, of_batch, block.shape) / n

    trace = float(summed(vectors, lambda x: np.square(x - mean).sum(axis=0), (size,)).sum() / n)
    values, axes = leading(product, size, k)
    there = values > 1e-12 * max(trace, 1e-300)
    values, axes = values[there], axes[:, there]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    if not len(values):
        return Whitening(n, sums, values, axes, values, 0.0)
    scale = np.sqrt(values)
    middle = summed(vectors, lambda x: ((x - mean) @ axes / scale).sum(axis=0), values.shape) / n

    def of_pairs(x):
        white = (x - mean) @ axes / scale - middle
        return white.T @ white

    error = np.abs(summed(vectors, of_pairs, (len(values), len(values))) / n - np.eye(len(values))).max()
    return Whitening(n, sums, values, axes, values / trace, float(error))


def deviations(x, n: int, sums: list[int]) -> list:
    """For each row the sum of (n x - sums)^2, exactly; null where it is beyond 64 bits."""
    import numpy as np

    most = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums)))
    if 4 * most * most * len(sums) <= LARGEST:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [value if value <= LARGEST else None for value in exact.tolist()]


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows (id, n, deviation, whitened, explained, identity_error); the arrays have one entry per component."""
    import numpy as np

    kind = dict(rows.dtypes)[id]
    ddl = f"{id} {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    given, size = of_common_length(integers(rows, id, vector, scale))
    model = fit(written(given.select("x").distinct(), "distinct"), size, k) if size else None
    if model is None:
        return rows.sparkSession.createDataFrame([], ddl)
    mean = np.array([total / model.n for total in model.sums])
    root = np.sqrt(model.values)

    def project(batches):
        names = ["id", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            x = rows_of(batch.column("x")) if len(batch) else np.zeros((0, size), np.int64)
            white = (x - mean) @ model.axes / root
            lists = pa.ListArray.from_arrays
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            columns = [
                batch.column("id"),
                pa.array(np.full(len(x), model.n, np.int64)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()),
                lists(offsets, pa.array(white.ravel(), pa.float64())),
                lists(offsets, pa.array(np.tile(model.explained, len(x)), pa.float64())),
                pa.array(np.full(len(x), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id, *names[1:]])

    return given.mapInArrow(project, ddl)
