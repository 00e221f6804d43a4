"""Embeddings whitened by their principal components, with distributed block matrices.

Rows are centred, numbered without gaps and cut to the blocks of a BlockMatrix. Its transpose
times itself is the scatter matrix, small whatever the number of rows; its eigenvectors are
computed locally, and the block matrix times the whitening matrix projects all rows.
Products over the rows are split by row blocks, so that no task reads them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import Scratch, free_name

COMPONENTS = 8
#: Numbers in a block of rows, a megabyte of them, and blocks that a task multiplies.
BLOCK_VALUES, TASK_BLOCKS = 1 << 17, 16
SCALE, SHIFT = 1024, 100_000


def whole_numbers(rows: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    """rows with the array x of long: entries scaled, rounded down and shifted. Rows go whose
    vector is null, empty, or holds nulls or what is not finite."""
    wide = F.col(vector).cast("array<double>")
    odd = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(wide, lambda c: (F.floor(c * F.lit(float(scale))) + shift).cast("long"))
    return rows.where((F.size(wide) > 0) & ~odd).withColumn("x", x)


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """Rows with their place, from their stored monotonic ids ``at``; no row changes its task.

    Places of a task follow each other; where rows are left out since, theirs stay empty.
    """
    task = F.shiftright(at, 33)
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(task.alias("task")).agg((F.max(within) + 1).alias("size"))
    # One row a task, added up in the driver.
    sizes = sorted((r["task"], r["size"]) for r in sizes.collect())
    first = np.cumsum([0, *[s for _, s in sizes]]).tolist()
    first = [(t, f) for (t, _), f in zip(sizes, first, strict=False)]
    first = rows.sparkSession.createDataFrame(first, "task long, first long")
    rows = rows.join(F.broadcast(first), task == F.col("task"))
    return rows.withColumn("place", F.col("first") + within).drop(at, "task", "first")


def block_matrix(rows: DataFrame, values: str, width: int) -> BlockMatrix:
    """The array column of numbered rows as a matrix, one row at each place, 0 where none is."""
    vectors = rows.select("place", array_to_vector(values).alias("v"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "v")
    return IndexedRowMatrix(vectors).toBlockMatrix(max(1, BLOCK_VALUES // width), width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right; the sum over the shared side is split, then added up."""
    made = left._java_matrix_wrapper.call(
        "multiply", right._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def covariance(matrix: BlockMatrix, n: int) -> np.ndarray:
    """The covariance of centred rows, by the number of rows."""
    splits = -(-matrix.numRowBlocks // TASK_BLOCKS)
    scatter = product(matrix.transpose(), matrix, splits).toLocalMatrix()
    return scatter.toArray() / n


def array_rows(matrix: BlockMatrix, values: str) -> DataFrame:
    """place and an array column: the matrix' rows as a table, without leaving the JVM."""
    rows = callMLlibFunc(
        "getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    )
    place, vector = rows.columns
    rows = MLUtils.convertVectorColumnsToML(rows, vector)
    return rows.select(
        F.col(place).alias("place"), vector_to_array(F.col(vector)).alias(values)
    )


def column_sums(rows: DataFrame, values: str, width: int, kind: str) -> list:
    sums = [F.sum(F.get(values, F.lit(i))).cast(kind).alias(f"s{i}") for i in range(width)]
    return list(rows.agg(*sums).first())


def whiten(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    vector: str = "embedding",
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """embeddings' columns but the vector, with n, deviation, whitened, variances, explained and
    identity_error; a column of one of these names is replaced.

    Rows are dropped whose vector is null, empty, or holds nulls or what is not finite, and, where
    lengths differ, those whose length is not the most common one, the longer of equals.
    Entries become whole numbers: scaled, rounded down, shifted. All other rows, repeated
    ones too, are fitted and projected; n is their number. deviation, the exact sum over
    dimensions of (n * x - S) squared, is a decimal. whitened has up to ``components`` entries
    (no more than dimensions), by falling eigenvalue; variances has their eigenvalues and
    explained these by the trace, both the same in every row, like identity_error, the largest entry
    of whitened's covariance minus the identity. A component without variance, as all have
    where all vectors are equal, is not whitened: its entries are null and explained is 0.
    An empty table gives none.

    The driver holds matrices of dimensions x dimensions, one number per task and one pair
    per block of rows, never rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    made = ("n", "deviation", "whitened", "variances", "explained", "identity_error")
    rest = [c for c in embeddings.columns if c != vector and c not in made]
    carried = {c: free_name(f"carry_{c}", [vector]) for c in rest}
    rows = whole_numbers(
        embeddings.select(*[F.col(c).alias(carried[c]) for c in rest], F.col(vector).alias("vector")),
        "vector", scale, shift,
    ).drop("vector")
    rows = scratch.keep(rows.withColumn("at", F.monotonically_increasing_id()), "x")
    schema = (
        "n long, deviation decimal(38,0), whitened array<double>, variances array<double>, "
        "explained array<double>, identity_error double"
    )
    lengths = rows.groupBy(F.size("x").alias("width")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        kept = embeddings.select(*rest).limit(0)
        typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in _fields(schema)]
        return kept.select("*", *typed)
    width, n = common["width"], common["count"]
    rows = rows.where(F.size("x") == width)

    # Near the mean by whole numbers, which keeps all sums small and exact.
    sums = column_sums(rows, "x", width, "decimal(38,0)")
    near = [int(s) // n for s in sums]
    rest_of = [int(s) - n * m for s, m in zip(sums, near, strict=True)]
    y = F.zip_with("x", F.array(*[F.lit(m) for m in near]), lambda x, m: x - m)
    over = F.array(*[F.lit(r) for r in rest_of])
    zero = F.lit(0).cast("decimal(38,0)")
    own = F.aggregate("y", F.lit(0).cast("long"), lambda s, v: s + v * v)
    mixed = F.aggregate(F.zip_with("y", over, lambda v, r: v * r.cast("decimal(19,0)")), zero, lambda s, v: (s + v).cast("decimal(38,0)"))
    wide = F.lit(n).cast("decimal(19,0)")
    deviation = (
        (wide * wide).cast("decimal(38,0)") * own.cast("decimal(38,0)")
        - (2 * wide).cast("decimal(38,0)") * mixed
        + F.lit(sum(r * r for r in rest_of)).cast("decimal(38,0)")
    )
    mean_of = F.array(*[F.lit(r / n) for r in rest_of])
    centred = F.zip_with("y", mean_of, lambda v, m: v - m)
    rows = numbered(rows, "at").withColumn("y", y)
    rows = rows.select(
        *[carried[c] for c in rest],
        "place",
        deviation.cast("decimal(38,0)").alias("deviation"),
        centred.alias("centred"),
    )
    matrix = block_matrix(rows, "centred", width)
    variances, vectors = np.linalg.eigh(covariance(matrix, n))
    top = min(components, width)
    trace = float(variances.clip(0).sum())
    variances, vectors = variances[::-1][:top], vectors[:, ::-1][:, :top]
    real = variances > trace * width * np.finfo(float).eps
    scales = np.where(real, 1 / np.sqrt(np.where(real, variances, 1)), 0)
    weights = vectors * scales
    small = DenseMatrix(width, top, weights.ravel(order="F").tolist())
    blocks = spark.sparkContext.parallelize([((0, 0), small)], 1)
    whitener = BlockMatrix(blocks, width, top, width, top)
    white = scratch.keep(array_rows(product(matrix, whitener, 1), "white"), "white")

    # Its own covariance, centred anew.
    error = 0.0
    if real.any():
        means = [m / n for m in column_sums(white, "white", top, "double")]
        off = F.zip_with("white", F.array(*[F.lit(m) for m in means]), lambda v, m: v - m)
        again = block_matrix(white.withColumn("off", off), "off", top)
        wrong = covariance(again, n) - np.eye(top)
        error = float(np.abs(wrong[np.ix_(real, real)]).max())
    whitened = F.transform("white", lambda v, i: F.when(F.get(F.array(*[F.lit(bool(r)) for r in real]), i), v))
    explained = [float(v / trace) if r else 0.0 for v, r in zip(variances, real, strict=True)]
    found = rows.join(white, "place")
    return found.select(
        *[F.col(carried[c]).alias(c) for c in rest],
        F.lit(n).cast("long").alias("n"),
        "deviation",
        whitened.alias("whitened"),
        F.array(*[F.lit(float(max(v, 0))) for v in variances]).alias("variances"),
        F.array(*[F.lit(e) for e in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields
