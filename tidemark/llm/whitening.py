"""Embedding whitening with MLlib's BlockMatrix.

Components become whole numbers x = floor(256 c). Rows get a running number and the centred ones are dealt into blocks of ``BLOCK``
rows; the blocks of the fit list (each different x once) are transposed and multiplied with themselves, the middle dimension
cut into many splits so that no task meets all blocks. The scatter matrix, as wide as a vector, is all that the driver gets; its
eigenvectors over the roots of their eigenvalues are the whitening matrix, and a second block multiplication projects all rows.
Sums are whole numbers, so centring (n x - S) / n rounds once; ``deviation`` is exact and null where a long can't hold it.

Dropped: null vectors, those with a null, NaN or infinite component, and those with one whose 256-fold no long can hold. Vectors without
components give no rows. Vectors of several lengths are fitted length by length. A component without spread (its eigenvalue
is rounding) has whitened null; explained is null where nothing has spread, identity_error is over the components with spread, null without one.
Null vec_id: a row like others. Repeated rows: each gets its result, the fit list holds their x once. Equal eigenvalues: some
orthogonal choice, the same for all rows. Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slim

#: Rows of a block, blocks that a task multiplies, and what a component of a vector is multiplied with before it is floored.
BLOCK, BLOCKS, GRAIN = 1024, 16, 256
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long), id (0, 1, 2, ...) of the rows that remain."""
    rows = slim(vectors, "vec_id", "embedding")
    fine = F.expr(f"forall(embedding, c -> c is not null and abs(cast(c as double)) < {2**63 / GRAIN!r}D)")
    rows = rows.filter(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0))
    x = F.expr(f"transform(embedding, c -> floor({GRAIN}D * cast(c as double)) + 0L)")
    rows = materialise(rows.select("vec_id", x.alias("x"), F.monotonically_increasing_id().alias("m")), "grid")
    part = F.expr("shiftright(m, 33)")
    before = rows.groupBy(part.alias("part")).count()  # one row for each task that wrote
    upto = F.expr("coalesce(sum(count) over (order by part rows between unbounded preceding and 1 preceding), 0)")
    before = materialise(before.select(F.col("part").alias("_p"), upto.alias("before")), "before")
    return rows.join(before, part == F.col("_p")).selectExpr("vec_id", "x", "before + (m & 8589934591) as id")


def times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product, blocks of the middle dimension dealt over ``splits``, which the Python method lacks."""
    out = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(out, left.rowsPerBlock, right.colsPerBlock)


def blocks(rows: DataFrame, total: int, dim: int) -> BlockMatrix:
    """Blocks of ``rows`` (id, c: array of double)."""
    rows = MLUtils.convertVectorColumnsFromML(rows.select("id", array_to_vector("c").alias("c")), "c")
    # Each multiplication reads its blocks twice; a lost executor's are made again.
    return IndexedRowMatrix(rows, total, dim).toBlockMatrix(BLOCK, dim).persist(StorageLevel.MEMORY_AND_DISK)


def forget(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper.call("blocks").unpersist(False)


def _offsets(sums: list[int], n: int, most: int) -> tuple[Column, Column]:
    """(n x - S as an array, the sum of its squares as long or null), in longs where they are wide enough."""
    dim = len(sums)
    wide = 2 * n * most >= 2**62
    s = F.array(*[F.lit(v).cast("decimal(38,0)") for v in sums]) if wide else F.lit(sums).cast("array<bigint>")
    off = F.zip_with("x", s, lambda a, b: (a.cast("decimal(38,0)") if wide else a) * F.lit(n) - b)
    deep = wide or dim * (2 * n * most) ** 2 >= 2**62
    square = (lambda t, v: (t + v.cast("decimal(38,0)") * v.cast("decimal(38,0)")).cast("decimal(38,0)")) if deep else (lambda t, v: t + v * v)
    return off, F.aggregate("off", F.lit(0).cast("decimal(38,0)" if deep else "long"), square, lambda t: t.try_cast("long"))


def _of_length(rows: DataFrame, dim: int, total: int, keep: int) -> DataFrame:
    """The result for the rows of one length."""
    fit = materialise(rows.groupBy("x").agg(F.min("id").alias("id")), "fit")
    axes = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at")
    axes = axes.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.greatest(F.max("v"), -F.min("v")).alias("most"), F.count("*").alias("n")).orderBy("at").collect()  # one row for each dimension
    n, most = axes[0].n, max(r.most for r in axes)
    off, deviation = _offsets([int(r.s) for r in axes], n, int(most))
    centred = F.expr(f"transform(off, v -> cast(v as double) / {n})")
    of_fit = blocks(fit.select("id", off.alias("off")).select("id", centred.alias("c")), total, dim)
    splits = max(1, -(-total // (BLOCK * BLOCKS)))
    scatter = times(of_fit.transpose(), of_fit, splits).toLocalMatrix().toArray()
    forget(of_fit)
    e, axis = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    e, axis = e[::-1], axis[:, ::-1]
    trace, k = float(np.trace(scatter) / n), min(keep, dim)
    spread = [i for i in range(k) if e[i] > trace * dim * 2.0**-50]
    offs = rows.select("vec_id", "id", off.alias("off")).select("vec_id", "id", "off", deviation.alias("deviation"))
    if spread:
        turn = axis[:, spread] / np.sqrt(e[spread])
        local = rows.sparkSession.sparkContext.parallelize([((0, 0), Matrices.dense(dim, len(spread), turn.ravel(order="F")))], 1)
        of_all = blocks(offs.select("id", centred.alias("c")), total, dim)
        white = times(of_all, BlockMatrix(local, dim, len(spread)))
        white = callMLlibFunc("getIndexedRows", white.toIndexedRowMatrix()._java_matrix_wrapper._java_model).toDF("_i", "w")
        white = materialise(white.select("_i", vector_to_array("w").alias("w")), "white")
        forget(of_all)
        pairs = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)) for i in range(len(spread)) for j in range(i, len(spread))]
        error = white.join(fit, F.col("_i") == F.col("id"), "left_semi").agg(F.greatest(*pairs, F.lit(0.0))).first()[0]
        offs = offs.join(white, F.col("id") == F.col("_i"))
    else:
        error, offs = None, offs.withColumn("w", F.array().cast("array<double>"))
    share = [float(max(v, 0.0) / trace) if trace > 0 else None for v in e[:k]]
    out = offs.select("vec_id", "deviation", "w", F.posexplode(F.lit(share) if trace > 0 else F.array_repeat(F.lit(None).cast("double"), k)).alias("at", "explained"))
    return out.select(
        F.col("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation"),
        F.get("w", F.col("at")).alias("whitened"), F.col("explained").cast("double"), F.lit(error).cast("double").alias("identity_error"),
    )


def whiten(vectors: DataFrame, keep: int = 4) -> DataFrame:
    """vec_id, component (1 to ``keep``), n, deviation, whitened, explained, identity_error of the rows of ``vectors`` (vec_id, embedding)."""
    rows = grid(vectors)
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.max("id").alias("last")).orderBy("dim").collect()  # one row for each length
    out = [_of_length(rows.filter(F.size("x") == r.dim), r.dim, r.last + 1, keep) for r in lengths]
    if not out:
        return vectors.sparkSession.createDataFrame([], RESULT)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
