"""Registered queries, one per operator, each with SQL for the same answer where SQL can say it.

Values are rounded to six places on both sides, as sums run in different orders.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import fixtures as fx
from cairn.functions import vectors as vec
from cairn.operators import density, item_blocks, merge, profile, quality, ratings, subsets, ward
from cairn.operators import states as st
from cairn.operators.assign import OUTLIER, assign, distance_matrix
from cairn.plans import sweep
from cairn.plans.bfr import Settings, bfr
from cairn.session import cut, new_path
from cairn.sources import text
from cairn.sql_checks import statements

DEVIATIONS, EPS, ALPHA = 1.04, 1.16, 1.004
DIMS = 64
LEAF_ROWS = 64  # small tiles, so that small data takes the way of big data
HEAVY = 10  # rated items per user and block beyond which sums do without item pairs
KS = [4, 6, 8, 10]
BFR = Settings(clusters=8, deviations=DEVIATIONS, alpha=ALPHA, eps=EPS, max_bytes=250 * 8 * (DIMS + 1), leaf_rows=LEAF_ROWS)


def r6(col, name: str | None = None):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or col)


# ---- text sources ---------------------------------------------------------------


def csv_multiline_scan(spark, sf):
    path = new_path(spark, "quoted")
    cell = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type")
    out = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string"), cell)
    out.write.option("quote", '"').option("escape", '"').csv(path)
    return text.read_quoted_csv(spark, path).toDF("part_key", "description")


def csv_header_scan(spark, sf):
    path = new_path(spark, "header")
    fx.genres(spark, sf).write.option("header", True).csv(path)
    return text.read_header_csv(spark, path, "genre_id STRING, parent STRING, title STRING")


def tsv_ratings_scan(spark, sf):
    path = new_path(spark, "tsv")
    fx.ratings(spark, sf).withColumn("rated_at", F.lit(881250949)).write.option("sep", "\t").csv(path)
    return text.read_ratings(spark, path)


def _headed(spark, body: DataFrame, header: list[str], name: str) -> tuple[list[str], str]:
    """Write a table's data files and, apart from them, the file with its header."""
    base = new_path(spark, name)
    body.write.option("quote", '"').option("escape", '"').csv(f"{base}/body")
    spark.createDataFrame([("\n".join(header),)], "line string").coalesce(1).write.text(f"{base}/header")
    return [f"{base}/header", f"{base}/body"], f"{base}/header"


def flatten_header_features(spark, sf):
    body = fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    header = ["feature,size,price,name", "statistics,mean,kurtosis,mode", "number,01,02,03", "track_id,,,"]
    paths, head = _headed(spark, body, header, "features")
    return text.read_features(spark, paths, head)


def flatten_header_tracks(spark, sf):
    title = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('"'))
    body = fx.table(spark, sf, "part").select("p_partkey", "p_brand", title)
    paths, head = _headed(spark, body, [",set,track", ",subset,", "track_id,,"], "tracks")
    return text.read_tracks(spark, paths, head)


# ---- tables, casts, filters, joins ----------------------------------------------


def cluster_membership(spark, sf):
    return fx.track_clusters(spark, sf)


def ratings_typed(spark, sf):
    return fx.ratings(spark, sf)


def subset_filter(spark, sf):
    return fx.tracks(spark, sf).filter(F.col("`set-subset`") == "small").select("track_id", F.col("`set-subset`").alias("subset"))


def _track_points(spark, sf):
    return fx.points64(spark, sf).select(F.col("point_id").cast("string").alias("track_id"), "features")


def subset_semi_join(spark, sf):
    d = subsets.in_subset(_track_points(spark, sf), fx.tracks(spark, sf), "small")
    return d.select("track_id", r6(vec.norm("features"), "norm"))


def subset_anti_join(spark, sf):
    d = subsets.not_in_subset(_track_points(spark, sf), fx.tracks(spark, sf), "small")
    return d.select("track_id", r6(vec.norm("features"), "norm"))


def vector_table(spark, sf):
    p = fx.table(spark, sf, "part")
    v = p.select(F.col("p_partkey").alias("point_id"), vec.vector("p_size", "p_retailprice").alias("features"))
    return v.select("point_id", F.posexplode("features").alias("dim", "x")).select("point_id", "dim", r6("x"))


def root_genres(spark, sf):
    return profile.sorted_root_genres(fx.genres(spark, sf))


def genre_colors(spark, sf):
    return profile.genre_colors(fx.genres(spark, sf), fx.colors(spark, sf))


def null_root_portion(spark, sf):
    return profile.null_portion(fx.tracks(spark, sf), "track-genre_top").select(r6("portion"))


def json_array_explode(spark, sf):
    return profile.track_genres(fx.tracks(spark, sf)).select("track_id", "genre_id")


# ---- profile --------------------------------------------------------------------


def genre_counts(spark, sf):
    return profile.genre_counts(fx.tracks(spark, sf), fx.genres(spark, sf), fx.track_clusters(spark, sf))


def genre_count_map(spark, sf):
    maps = profile.genre_count_map(genre_counts(spark, sf))
    return maps.select("cluster_id", F.explode("genre_counts").alias("genre_title", "count"))


def genre_matrix(spark, sf):
    m = profile.genre_matrix(genre_counts(spark, sf), fx.genres(spark, sf), range(8))
    return m.select("genre_title", *[F.col(c).alias(f"c_{c}") for c in m.columns[1:]])


def top3_genres(spark, sf):
    return profile.top_genres(genre_counts(spark, sf))


def top3_genre_portions(spark, sf):
    return profile.top_genre_portions(genre_counts(spark, sf)).select("cluster_id", "genre_title", "rank", r6("portion"))


def top3_portion_matrix(spark, sf):
    m = profile.top_portion_matrix(genre_counts(spark, sf), range(8))
    return m.select("genre_title", *[r6(c, f"c_{c}") for c in m.columns[1:]])


# ---- arrays ---------------------------------------------------------------------


def array_center(spark, sf):
    mean = vec.total(F.col("features")) / F.size("features")
    v = fx.points64(spark, sf).withColumn("mean", mean).select(
        "point_id", F.posexplode(vec.centre("features", "mean")).alias("dim", "x"))
    return v.select("point_id", "dim", r6("x"))


def _with_centroid(spark, sf):
    p = fx.points64(spark, sf)
    return p.join(st.centroids(p).drop("n"), "cluster_id")


def array_dot(spark, sf):
    return _with_centroid(spark, sf).select("point_id", r6(vec.dot("features", "centroid"), "dot"))


def euclid_distance(spark, sf):
    return _with_centroid(spark, sf).select("point_id", r6(vec.distance("features", "centroid"), "distance"))


def array_pearson(spark, sf):
    means = {m: vec.total(F.col(c)) / F.size(c) for m, c in (("m", "features"), ("cm", "centroid"))}
    d = _with_centroid(spark, sf).withColumns(means)
    return d.select("point_id", r6(vec.centred_cosine("features", "m", "centroid", "cm"), "similarity"))


def array_get(spark, sf):
    at = (F.col("point_id") % 70).cast("int")
    return fx.points64(spark, sf).select("point_id", r6(vec.item_at("features", at), "x"))


# ---- cluster states -------------------------------------------------------------


def cluster_summary(spark, sf):
    return st.summarize(fx.points64(spark, sf)).select("cluster_id", "dim", "n", r6("s"), r6("q"))


def cluster_stats(spark, sf):
    return st.finish(st.summarize(fx.points64(spark, sf))).select(
        "cluster_id", "dim", r6("centroid"), r6("variance"), r6("std"))


def cluster_merge(spark, sf):
    seed, rest = fx.seed_points(spark, sf), fx.points(spark, sf).filter(F.col("`set-subset`") != "small")
    both, _ = st.merge_checked(
        st.summarize(seed), st.summarize(rest), seed.select("point_id"), rest.select("point_id"))
    return both.select("cluster_id", "dim", "n", r6("s"), r6("q"))


def membership_overlap(spark, sf):
    mine = fx.membership(spark, sf).select("point_id")
    roots = fx.tracks(spark, sf).filter(F.col("`track-genre_top`").isNull()).select(F.col("track_id").cast("long").alias("point_id"))
    return st.overlaps(mine.unionByName(roots))


def label_centroids(spark, sf):
    c = st.centroids(fx.points64(spark, sf))
    return c.select("cluster_id", "n", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "n", "dim", r6("x"))


def hash_split(spark, sf):
    train, test = subsets.hash_split(fx.ratings(spark, sf), fx.test_bucket())
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select(
        "user_id", "item_id", "part")


def chunk_assign(spark, sf):
    p = fx.points(spark, sf)
    n = subsets.chunk_count(p.count(), DIMS + 1, BFR.max_bytes)
    return subsets.assign_chunks(p, n, F.col("point_id") * 7919).select("point_id", "chunk")


# ---- chunked clustering, step by step -------------------------------------------


def _seed_states(spark, sf):
    return st.summarize(fx.seed_points(spark, sf))


def _assigned(spark, sf):
    return assign(fx.other_points(spark, sf), _seed_states(spark, sf), DEVIATIONS, DIMS)


def mahalanobis_matrix(spark, sf):
    return distance_matrix(fx.other_points(spark, sf), _seed_states(spark, sf)).select(
        "point_id", "cluster_id", r6("distance"))


def bfr_assign(spark, sf):
    return _assigned(spark, sf).select("point_id", "cluster_id", r6("distance"))


def bfr_absorb(spark, sf):
    near = _assigned(spark, sf).filter(F.col("cluster_id") != OUTLIER)
    return st.merge(_seed_states(spark, sf), st.summarize(near)).select("cluster_id", "dim", "n", r6("s"), r6("q"))


def eps_join(spark, sf):
    return density.core_points(fx.points(spark, sf), EPS, leaf_rows=LEAF_ROWS)


def dbscan(spark, sf):
    d = density.dbscan(fx.points(spark, sf), EPS, leaf_rows=LEAF_ROWS)
    return d.select("point_id", F.coalesce("label", F.lit(-1)).alias("label"))


def bfr_leftover(spark, sf):
    far = cut(_assigned(spark, sf).filter(F.col("cluster_id") == OUTLIER))
    d = density.dbscan(far, EPS, leaf_rows=LEAF_ROWS)
    kind = F.when(F.col("label").isNull(), "retained").otherwise("compression")
    return d.select("point_id", kind.alias("set_kind"), F.coalesce("label", F.lit(-1)).alias("label"))


def _sets(spark, sf):
    """States of the points of each label and sign pattern, as sets to merge."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    p = fx.points(spark, sf).join(e, "point_id")
    return st.summarize(p.withColumn("set_key", F.concat_ws("/", "label", "cluster_id")), merge.KEY)


def cs_merge_candidates(spark, sf):
    sets = st.as_vectors(_sets(spark, sf), ["s", "q", "m2"], merge.KEY)
    return merge.first_pairs(sets, ALPHA, LEAF_ROWS).select("set_key", "best.lo", "best.hi")


def cs_merge(spark, sf):
    keyed, first = merge.listed(_sets(spark, sf))
    left, names, _ = merge.merge_sets(keyed, ALPHA, leaf_rows=LEAF_ROWS)
    sizes = left.groupBy("set_key").agg(F.max("n").alias("n"))
    named = names.join(sizes, F.col("new_key") == F.col("set_key")).select("old_key", "new_key", "n")
    mine = cut(named.join(first, F.col("old_key") == F.col("set_key")).select("name", "new_key", "n"))
    heads = mine.groupBy("new_key").agg(F.min("name").alias("first_name"))  # a set goes by the first name in it
    return mine.join(heads, "new_key").select(F.col("name").alias("old_key"), "first_name", "n")


def cs_fold(spark, sf):
    sets, seeds = _sets(spark, sf), _seed_states(spark, sf)
    return merge.fold(sets, seeds, merge.fold_targets(sets, seeds)).select("cluster_id", "dim", "n", r6("s"), r6("q"))


def ward_seed(spark, sf):
    return ward.ward(fx.seed_points(spark, sf), 8, leaf_rows=LEAF_ROWS).select("point_id", "cluster_id")


def _bfr(spark, sf):
    return bfr(fx.seed_points(spark, sf), fx.other_points(spark, sf), BFR, hashed=F.col("point_id") * 7919)


def bfr_clusters(spark, sf):
    return _bfr(spark, sf).assignment


def bfr_set_sizes(spark, sf):
    return st.set_sizes(_bfr(spark, sf).membership)


# ---- cluster quality ------------------------------------------------------------


def cluster_radius(spark, sf):
    return quality.radius(fx.points64(spark, sf)).select("cluster_id", "n", r6("radius"), r6("density_r"))


def cluster_diameter(spark, sf):
    return quality.diameter(fx.points64(spark, sf), leaf_rows=LEAF_ROWS).select(
        "cluster_id", "n", r6("diameter"), r6("density_d"))


def _labelings(spark, sf):
    """Four fixed labelings of every point, one per k."""
    p = fx.points64(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    return p.withColumn("cluster_id", (F.col("cluster_id") % F.col("k")).cast("int"))


def quality_fixed(spark, sf):
    m = quality.metrics(_labelings(spark, sf), leaf_rows=LEAF_ROWS)
    return m.select("k", "cluster_id", "n", *[r6(c) for c in ("radius", "diameter", "density_r", "density_d")])


def quality_zscores(spark, sf):
    z = quality.zscores(quality.sweep_summary(quality.metrics(_labelings(spark, sf), leaf_rows=LEAF_ROWS)))
    return z.select("metric", "k", r6("value"), r6("z"))


def quality_sweep(spark, sf):
    seed = cut(fx.seed_points(spark, sf).drop("cluster_id"))
    return sweep.k_metrics(seed, range(8, 17), new_path(spark, "metrics"), LEAF_ROWS)


# ---- ratings --------------------------------------------------------------------


def _split(spark, sf):
    rated = fx.ratings(spark, sf)
    train, test = subsets.hash_split(rated, fx.test_bucket())
    return rated, train.filter(~fx.kept_out()), test


def distinct_users(spark, sf):
    return ratings.user_count(fx.ratings(spark, sf))


def cf_user_means(spark, sf):
    return ratings.user_means(_split(spark, sf)[1]).select("user_id", r6("user_mean"))


def cf_item_means(spark, sf):
    return ratings.item_means(_split(spark, sf)[1]).select("item_id", r6("item_mean"))


def cf_global_mean(spark, sf):
    return ratings.global_mean(_split(spark, sf)[1]).select(r6("mu"))


def cf_baselines(spark, sf):
    rated, train, test = _split(spark, sf)
    mu, _, _ = ratings.totals(train, rated)
    return ratings.baselines(test, train, mu).select("user_id", "item_id", r6("baseline"))


def cf_candidates(spark, sf):
    rated, train, test = _split(spark, sf)
    mu, _, users = ratings.totals(train, rated)
    d = ratings.neighbour_totals(test, train, fx.blocks(train), mu, users)
    return d.select("user_id", "item_id", "cluster_id", "neighbours", r6("deviation"))


def cf_similarity(spark, sf):
    rated, train, test = _split(spark, sf)
    users = ratings.totals(train, rated)[2]
    pairs = cut(ratings.rated_pairs(test, train, fx.blocks(train)))
    return ratings.item_similarity(pairs, train, fx.blocks(train), users, HEAVY).select("lo", "hi", r6("similarity"))


def _predictions(spark, sf):
    rated, train, test = _split(spark, sf)
    train = cut(train)
    mu, _, users = ratings.totals(train, rated)
    test = test.withColumnRenamed("rating", "true_rating")
    return ratings.predict(test, train, fx.blocks(train), mu, users, HEAVY), test, train


def cf_predict(spark, sf):
    return _predictions(spark, sf)[0].select("user_id", "item_id", "true_rating", r6("predicted_rating"))


def cf_rmse(spark, sf):
    return ratings.rmse(*_predictions(spark, sf)).select("predicted", "known", r6("rmse"), r6("rmse_reference"))


def cf_coverage(spark, sf):
    _, train, test = _split(spark, sf)
    return ratings.coverage(test, train).select("test_pairs", "untested", r6("untested_share"))


def cf_cluster_sizes(spark, sf):
    return ratings.cluster_sizes(fx.blocks(_split(spark, sf)[1]))


def cf_item_vectors(spark, sf):
    return item_blocks.entries(_split(spark, sf)[1])


def cf_item_clusters(spark, sf):
    return item_blocks.item_blocks(_split(spark, sf)[1], k=5)


def cf_predict_bkm(spark, sf):
    rated, train, test = _split(spark, sf)
    train = cut(train)
    mu, n, users = ratings.totals(train, rated)
    blocks = cut(item_blocks.item_blocks(train, k=5))
    test = test.withColumnRenamed("rating", "true_rating")
    return ratings.predict(test, train, blocks, mu, users, ratings.heavy_limit(n))


def cf_cluster_sizes_compare(spark, sf):
    train, k = cut(_split(spark, sf)[1]), 5
    settings = {"share": 1 / k, "any": 1.0}
    parts = [
        ratings.cluster_sizes(item_blocks.item_blocks(train, k=k, min_divisible=m)).withColumn("setting", F.lit(name))
        for name, m in settings.items()
    ]
    return parts[0].unionByName(parts[1])


NAMES = (
    "csv_multiline_scan csv_header_scan tsv_ratings_scan flatten_header_features flatten_header_tracks "
    "cluster_membership ratings_typed subset_filter subset_semi_join subset_anti_join vector_table root_genres "
    "genre_colors null_root_portion json_array_explode genre_counts genre_count_map genre_matrix top3_genres "
    "top3_genre_portions top3_portion_matrix array_center array_dot euclid_distance array_pearson array_get "
    "cluster_summary cluster_stats cluster_merge membership_overlap label_centroids hash_split chunk_assign "
    "mahalanobis_matrix bfr_assign bfr_absorb eps_join dbscan bfr_leftover cs_merge_candidates cs_merge cs_fold "
    "ward_seed bfr_clusters bfr_set_sizes cluster_radius cluster_diameter quality_fixed quality_zscores "
    "quality_sweep distinct_users cf_user_means cf_item_means cf_global_mean cf_baselines cf_candidates "
    "cf_similarity cf_predict cf_rmse cf_coverage cf_cluster_sizes cf_item_vectors cf_item_clusters "
    "cf_predict_bkm cf_cluster_sizes_compare"
).split()


def entry(spark: SparkSession) -> DataFrame:
    """Predicted ratings of the test pairs on the smallest data."""
    return cf_predict(spark, "/root/testdata/sf0.001")


def _text_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the optional subpackage and of its pipeline, none where they are not installed."""
    found, sql = {}, {}
    if not _installed("cairn.llm"):
        return found, sql
    from cairn.llm import queries as text_queries

    found |= text_queries.QUERIES
    sql |= text_queries.ORACLE_SQL
    if not _installed("corpus_pipeline"):
        return found, sql
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def _installed(name: str) -> bool:
    """True if the module's own file is there, so that an error inside it is not taken for its absence."""
    spec = importlib.util.find_spec(name)
    return spec is not None and spec.origin is not None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES} | _text_queries()[0]


def oracle_sql() -> dict[str, str]:
    return _core_sql() | _text_queries()[1]


def _core_sql() -> dict[str, str]:
    return statements(deviations=DEVIATIONS, eps=EPS, alpha=ALPHA, ks=KS, max_bytes=BFR.max_bytes)
