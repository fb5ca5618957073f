"""Centroid clustering on whole numbers, with column expressions alone.

Vectors become arrays of integers. The centroids of a round are literal arrays in the plan;
``zip_with`` and ``aggregate`` give a vector's squared distance to each, and the smallest
struct of distance and number is its cluster, so ties go to the smaller number. Column sums
per cluster are partial sums in every task before a shuffle of k rows a task, however large a
cluster is. What comes to the driver in a round is k rows of sums.

Sums and floors are exact, so the result does not depend on the partitioning or on the order
of the rows.

Defined results: a null array, another number of components, and null, NaN or infinite
components leave a vector out; fewer vectors than centroids give one centroid for each vector;
no vectors give no rows. Equal digests (repeated ids) are ordered by id, then by vector. A null
id is a vector like any other, with an empty number in its digest. A component beyond +-``RANGE``
raises: squared distances of such numbers do not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import stored

CENTROIDS, ROUNDS, SEED = 40, 5, 2
DIMENSION, SCALE = 64, 256
#: 64 squares of differences of 2 * 256 * RANGE stay below 2 ** 62.
RANGE = 1 << 19


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``id, v``: the usable vectors with components ``floor(scale * x)``."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = lambda c: F.when(
        F.abs(c) <= RANGE, F.floor(c * F.lit(float(scale)))
    ).otherwise(F.raise_error(F.lit(f"a component is beyond {RANGE}")).cast("long"))
    usable = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dimension)).where(finite)
    return usable.select(F.col(id_col).alias("id"), F.transform(x, floor).alias("v"))


def start_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest digests of seed and id: a top-k of the whole table."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select("v", "id", digest.alias("digest")).orderBy("digest", "id", "v").limit(k).collect()]


def literal(centroids: list[list[int]]) -> Column:
    """The centroids as one literal array of arrays in the plan."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")


def squared_distance(vector: Column, centroid: Column) -> Column:
    squares = F.zip_with(vector, centroid, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """``distance, cluster`` of the nearest centroid; the smaller number where distances tie."""
    return F.array_min(F.transform(
        literal(centroids), lambda c, i: F.struct(squared_distance(vector, c).alias("distance"), i.alias("cluster"))
    ))


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    return vectors.withColumn("near", nearest(F.col("v"), centroids)).select("id", "v", "near.cluster", "near.distance")


def moved(vectors: DataFrame, centroids: list[list[int]], dimension: int = DIMENSION) -> list[list[int]]:
    """The centroids after one round; a cluster without vectors keeps its place."""
    sums = assigned(vectors, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dimension)))
    after = list(centroids)
    for row in sums.collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dimension)]
    return after


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    spark = df.sparkSession
    schema = T.StructType([
        df.select(F.col(id_col).alias("id")).schema["id"], T.StructField("cluster", T.IntegerType(), False), T.StructField("distance", T.LongType()),
        T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType()),
    ])
    vectors = whole_vectors(df, id_col, vector_col, dimension)
    centroids = start_centroids(vectors, k, seed)
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dimension)
    placed = stored(assigned(vectors, centroids).drop("v"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row a centroid, k at most.
    facts = spark.createDataFrame(
        [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(facts), "cluster").select(*schema.names)
