"""PCA: fit on a sample, centred projection, variance table and size report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from searchlab.functions.vectors import unit_vector
from searchlab.operators.dense import BROADCAST_BYTES, to_matrix
from searchlab.operators.sampling import SEED, fixed_size_sample

FLOAT_BYTES = 4


@dataclass(frozen=True)
class Projection:
    """Mean and components (one per row); at most dimension x dimension numbers."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.components.nbytes > BROADCAST_BYTES:
            raise ValueError("projection matrix is too large to send to every task")


def mean_vector(vectors: DataFrame, vec_col: str = "embedding") -> list[float]:
    features = array_to_vector(F.col(vec_col).cast("array<double>"))
    return vectors.agg(vector_to_array(Summarizer.mean(features))).first()[0]


def covariance(vectors: DataFrame, vec_col: str = "embedding") -> tuple[np.ndarray, int]:
    """Sample covariance and number of vectors; a task passes on one matrix of sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = to_matrix(batch.column(0))
            if len(rows):
                # The last column counts the rows and sums the components.
                wide = np.hstack([rows, np.ones((len(rows), 1))])
                total = wide.T @ wide if total is None else total + wide.T @ wide
        if total is not None:
            i, j = np.indices(total.shape)
            columns = [pa.array(c.ravel()) for c in (i, j, total)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])

    parts = vectors.select(vec_col).mapInArrow(sums, "i bigint, j bigint, value double")
    table = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    width = int(round(table.num_rows**0.5))
    gram = np.zeros((width, width))
    gram[table["i"].to_numpy(), table["j"].to_numpy()] = table["value"].to_numpy()
    rows, mean = gram[-1, -1], gram[-1, :-1] / gram[-1, -1]
    return (gram[:-1, :-1] - rows * np.outer(mean, mean)) / (rows - 1), int(rows)


def fit_pca(
    vectors: DataFrame,
    dimension: int,
    sample_size: int | None = None,
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    seed: int = SEED,
) -> tuple[Projection, int]:
    """Leading ``dimension`` components, fitted on all vectors or on a sample of
    ``sample_size``; returns the number of fitted vectors too."""
    width = vectors.select(F.size(vec_col)).first()[0]
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    if dimension >= width:
        raise ValueError("the reduced dimension has to be below that of the vectors")
    fitted = vectors.select(id_col, vec_col)
    if sample_size is not None:
        fitted = fixed_size_sample(fitted, sample_size, [id_col], seed, allow_fewer=True)
    points = fitted.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = PCA(k=dimension, inputCol="features", outputCol="reduced").fit(points)
    mean, rows = points.agg(Summarizer.mean(F.col("features")), F.count("*")).first()
    return (
        Projection(
            mean.toArray(), model.pc.toArray().T.copy(), model.explainedVariance.toArray()
        ),
        rows,
    )


def project(
    vectors: DataFrame,
    projection: Projection,
    dimension: int | None = None,
    vec_col: str = "embedding",
) -> DataFrame:
    """Replaces ``vec_col`` by its centred, cut and re-normalised projection."""
    fitted, width = projection.components.shape
    dimension = fitted if dimension is None else dimension
    if not 0 < dimension <= fitted:
        raise ValueError(f"dimension {dimension} is not among the {fitted} fitted components")
    shared = vectors.sparkSession.sparkContext.broadcast(
        (projection.mean, projection.components[:dimension])
    )
    position = vectors.columns.index(vec_col)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = to_matrix(batch.column(position))
            if rows.shape[1] != width:
                raise ValueError(f"vectors have {rows.shape[1]} dimensions, expected {width}")
            reduced = (rows - mean) @ components.T
            norms = np.linalg.norm(reduced, axis=1, keepdims=True)
            norms[norms == 0] = 1.0
            offsets = pa.array(np.arange(len(rows) + 1, dtype="int32") * dimension)
            column = pa.ListArray.from_arrays(offsets, pa.array((reduced / norms).ravel()))
            yield batch.set_column(position, vec_col, column)

    fields = [
        T.StructField(vec_col, T.ArrayType(T.DoubleType())) if f.name == vec_col else f
        for f in vectors.schema.fields
    ]
    return vectors.mapInArrow(reduce, T.StructType(fields))


def project_dimensions(
    vectors: DataFrame,
    projection: Projection,
    dimensions: list[int],
    vec_col: str = "embedding",
) -> DataFrame:
    """One row per vector and ``dim``: projected once, then cut and re-normalised.

    Written with ``partitionBy("dim")`` every dimension can be searched on its own.
    """
    dimensions = _checked(dimensions)
    widest = project(vectors, projection, dimensions[-1], vec_col)
    return widest.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dimensions]))).withColumn(
        vec_col, unit_vector(F.slice(vec_col, F.lit(1), F.col("dim")))
    )


def _checked(dimensions: list[int]) -> list[int]:
    dimensions = sorted(set(dimensions))
    if not dimensions or dimensions[0] <= 0:
        raise ValueError("dimensions must be positive")
    return dimensions


def explained_variance(spark: SparkSession, projection: Projection) -> DataFrame:
    """One row per component with the running sum of its variance share."""
    rows = [(i, float(r)) for i, r in enumerate(projection.ratios, start=1)]
    table = spark.createDataFrame(rows, "component int, explained_variance_ratio double")
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(
        "cumulative_explained_variance_ratio", F.sum("explained_variance_ratio").over(upto)
    )


def reduction_report(
    vectors: DataFrame, dimensions: list[int], vec_col: str = "embedding", projection=None
) -> DataFrame:
    """Bytes per vector before and after, per reduced dimension."""
    dimensions = _checked(dimensions)
    report = vectors.agg(
        F.count("*").alias("documents"),
        F.max(F.size(vec_col)).cast("long").alias("input_dimension"),
    ).withColumn(
        "output_dimension", F.explode(F.array(*[F.lit(d).cast("long") for d in dimensions]))
    )
    report = (
        report.withColumn("input_bytes_per_vector", F.col("input_dimension") * FLOAT_BYTES)
        .withColumn("output_bytes_per_vector", F.col("output_dimension") * FLOAT_BYTES)
        .withColumn(
            "compression_ratio",
            F.col("input_bytes_per_vector") / F.col("output_bytes_per_vector"),
        )
    )
    if projection is None:
        return report
    variance = explained_variance(vectors.sparkSession, projection).select(
        F.col("component").cast("long").alias("output_dimension"),
        "cumulative_explained_variance_ratio",
    )
    return report.join(variance, "output_dimension", "left")


def save_projection(spark: SparkSession, projection: Projection, location: str) -> None:
    """Mean and components as two small Parquet tables."""
    spark.createDataFrame([(projection.mean.tolist(),)], "mean array<double>").write.mode(
        "overwrite"
    ).parquet(f"{location}/mean")
    components = projection.components
    ratios = [None] * len(components) if projection.ratios is None else projection.ratios.tolist()
    rows = [(i, c.tolist(), r) for i, (c, r) in enumerate(zip(components, ratios), start=1)]
    spark.createDataFrame(
        rows, "component int, vector array<double>, explained_variance_ratio double"
    ).write.mode("overwrite").parquet(f"{location}/components")


def load_projection(spark: SparkSession, location: str) -> Projection:
    mean = spark.read.parquet(f"{location}/mean").first()["mean"]
    rows = spark.read.parquet(f"{location}/components").orderBy("component").collect()
    ratios = [r["explained_variance_ratio"] for r in rows]
    return Projection(
        np.array(mean),
        np.array([r["vector"] for r in rows]),
        None if None in ratios else np.array(ratios),
    )
