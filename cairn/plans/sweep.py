"""Resumable parameter sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import profile
from cairn.operators.balls import LEAF
from cairn.operators.quality import metrics
from cairn.operators.states import set_sizes
from cairn.operators.ward import history, labels, ward
from cairn.plans.bfr import Clustering, Settings, bfr, folded
from cairn.session import cut
from cairn.sources.tables import materialize_once, table_exists, write_result

# The grid of the standard sweep.
STANDARD_GRID = {
    "clusters": [11],
    "deviations": [2.0],
    "alpha": [1.001, 1.01, 1.02, 1.1, 1.5],
    "eps": [1000.0, 2000.0, 3000.0, 5000.0, 10000.0],
    "fold": [False, True],
}


def grid(spark: SparkSession, choices: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the choices."""
    df = spark.range(1).select()
    for name, values in choices.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Combinations without a stored result."""
    keys = wanted.columns
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def k_metrics(seed: DataFrame, ks: Sequence[int], path: str, leaf_rows: int = LEAF) -> DataFrame:
    """Quality metrics of the seed's clustering for every k, computed once and kept at ``path``."""
    def build() -> DataFrame:
        cuts = labels(seed, cut(history(seed, leaf_rows)), list(ks))
        return metrics(cut(seed.join(cuts, "point_id")), leaf_rows=leaf_rows)

    return materialize_once(seed.sparkSession, path, build)


def run(seed: DataFrame, rest: DataFrame, tracks: DataFrame, genres: DataFrame, choices: Mapping[str, Sequence],
        path: str, defaults: Settings, hashed=None) -> DataFrame:
    """Run every pending combination and store its set sizes, genre counts and top genre shares.

    A broken-off sweep goes on where it stopped.  The seed is clustered once per
    number of clusters, and combinations that differ in folding alone share one clustering.  The
    result tables are ``path``/sizes, ``path``/counts and ``path``/portions; the first is returned.
    """
    spark = seed.sparkSession
    wanted, sizes = grid(spark, choices), f"{path}/sizes"
    todo = pending(wanted, spark.read.parquet(sizes)) if table_exists(spark, sizes) else wanted
    labelled: dict[int, DataFrame] = {}
    shared: tuple[dict, Clustering] | None = None
    others = [c for c in wanted.columns if c != "fold"]
    for row in todo.orderBy(*others, *[c for c in wanted.columns if c == "fold"]).collect():  # one row per combination
        chosen = row.asDict()
        k = chosen.get("clusters", defaults.clusters)
        if k not in labelled:
            labelled[k] = cut(ward(seed, k, defaults.leaf_rows))
        settings = Settings(**{**defaults.__dict__, **chosen})
        bare = {c: chosen[c] for c in others}
        if shared is None or shared[0] != bare:
            shared = bare, bfr(seed, rest, replace(settings, fold=False), labelled[k], hashed)
        result = folded(shared[1]) if settings.fold else shared[1]
        placed = result.assignment.select(F.col("point_id").cast("string").alias("track_id"), "cluster_id")
        counts = cut(profile.genre_counts(tracks, genres, placed))
        write_result(counts, f"{path}/counts", chosen)
        write_result(profile.top_genre_portions(counts), f"{path}/portions", chosen)
        write_result(set_sizes(result.membership), sizes, chosen)  # last: marks the run as done
    return spark.read.parquet(sizes)
