"""Item-based collaborative filtering on long-form ratings.

``train``/``test`` hold ``user_id, item_id, rating``; ``blocks`` holds
``item_id, cluster_id``.  A (user, item) pair is rated once.

An item's vector has one entry per user, 0 where unrated, and is centred by the
item's mean, so unrated entries weigh in as ``-mean``.  With U users, item i
with n ratings of mean a and sum of squares q:

    dot(i, j)  = sum of r_i * r_j over common users + a_i * a_j * (U - n_i - n_j)
    norm(i)^2  = q + a^2 * (U - 2n)

Only common ratings need a join; no dense vector is ever built.

Heavy users.  Matching a user's test items with the user's rated items of the
same block makes (test x rated) rows.  Below a limit of rated items per (user,
block) that fan-out is bounded by the limit.  Beyond it the prediction sums are
computed without listing item pairs: for one heavy user,

    sum_j w_j * dot(i, j) = sum_y r_yi * (p_y - A) - a_i * V
    p_y = sum_j w_j r_yj,   A = sum_j w_j a_j,   V = sum_j w_j a_j (n_j - U)

where j runs over the user's rated items: two joins linear in the ratings of the
block, for each heavy user.  The limit defaults to the square root of the number of ratings, which
balances both sides.  Users beyond it whose items have more ratings than they have pairs are
left to the pairs: where few items have ratings of very many users, going through those
ratings once per user is quadratic in the users.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

NO_SIMILARITY = 1e-12  # sums of similarities up to this count as 0
MIN_HEAVY = 256  # below this many rated items a user is never heavy


def check_once(train: DataFrame) -> None:
    """Raise if a user rated an item more than once: sums would count the pair twice."""
    twice = train.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).filter("n > 1").head()
    if twice is not None:
        raise ValueError(f"user {twice.user_id} rated item {twice.item_id} {twice.n} times; keep one rating")


def user_means(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(F.avg("rating").alias("user_mean"))


def item_means(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.avg("rating").alias("item_mean"))


def global_mean(train: DataFrame) -> DataFrame:
    return train.agg(F.avg("rating").alias("mu"))


def user_count(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.countDistinct("user_id").alias("users"))


def totals(train: DataFrame, ratings: DataFrame) -> tuple[float, int, int]:
    """Global mean and size of the training part, and users of the whole data."""
    t = train.agg(F.avg("rating").alias("mu"), F.count("*").alias("n")).first()
    return t.mu, t.n, user_count(ratings).first().users


def item_stats(train: DataFrame, n_users: int) -> DataFrame:
    """Ratings, mean and norm of the centred vector of each item."""
    r = F.col("rating").cast("double")
    s = train.groupBy("item_id").agg(
        F.count("*").alias("n"), F.avg(r).alias("a"), F.sum(r * r).alias("q")
    )
    norm2 = F.col("q") + F.col("a") * F.col("a") * (n_users - 2 * F.col("n"))
    return s.select("item_id", "n", "a", F.sqrt(F.greatest(norm2, F.lit(0.0))).alias("norm"))


def baselines(pairs: DataFrame, train: DataFrame, mu: float) -> DataFrame:
    """``user_mean + item_mean - mu`` of each pair whose user and item were trained on."""
    return (
        pairs.join(item_means(train), "item_id")
        .join(user_means(train), "user_id")
        .withColumn("baseline", -F.lit(mu) + F.col("user_mean") + F.col("item_mean"))
    )


def _placed(df: DataFrame, train: DataFrame, blocks: DataFrame, mu: float, n_users: int) -> DataFrame:
    """Pairs with block, item statistics and baseline; unknown users and items drop out."""
    items = item_stats(train, n_users).join(blocks, "item_id")
    return (
        df.join(items, "item_id")
        .join(user_means(train), "user_id")
        .withColumn("base", -F.lit(mu) + F.col("user_mean") + F.col("a"))
        .drop("user_mean")
    )


def neighbour_totals(test: DataFrame, train: DataFrame, blocks: DataFrame, mu: float,
                     n_users: int) -> DataFrame:
    """Per test pair: how many items of its block the user rated, and their summed deviation.

    The rated side is added up per (user, block) before the join, so each test
    pair meets one row.
    """
    rated = _placed(train, train, blocks, mu, n_users)
    per_block = rated.groupBy("user_id", "cluster_id").agg(
        F.count("*").alias("neighbours"), F.sum(F.col("rating") - F.col("base")).alias("deviation")
    )
    return (
        test.join(blocks, "item_id")
        .join(per_block, ["user_id", "cluster_id"])
        .select("user_id", "item_id", "cluster_id", "neighbours", "deviation")
    )


def _tag_heavy(rated: DataFrame, limit: int) -> DataFrame:
    """Mark the rated rows of (user, block) groups above the limit.

    Where the rows hold ``n``, the ratings of their item, a group is heavy only if it has more item pairs
    than its items have ratings, which are what the sums without pairs go through.
    """
    lookups = F.sum("n") if "n" in rated.columns else F.lit(0)
    sizes = rated.groupBy("user_id", "cluster_id").agg(F.count("*").alias("size"), lookups.alias("lookups"))
    costly = (F.col("size") > limit) & (F.col("size") * F.col("size") > F.col("lookups"))
    heavy = sizes.filter(costly).select("user_id", "cluster_id", F.lit(True).alias("h"))
    return rated.join(heavy, ["user_id", "cluster_id"], "left").select(
        *rated.columns, F.coalesce("h", F.lit(False)).alias("heavy")
    )


def common_products(pairs: DataFrame, rated: DataFrame) -> DataFrame:
    """Sum of rating products over common users for item pairs ``(lo, hi)``.

    ``rated`` is tagged by `_tag_heavy`.  Light users' own pairs are made and
    added up map-side.  For heavy users each wanted pair looks up the ratings
    of its rarer item, then the same users' ratings of the other one.
    """
    light = rated.filter(~F.col("heavy")).select("cluster_id", "user_id", "item_id", "rating")
    a = light.select("cluster_id", "user_id", F.col("item_id").alias("lo"), F.col("rating").alias("ra"))
    b = light.select("cluster_id", "user_id", F.col("item_id").alias("hi"), F.col("rating").alias("rb"))
    product = F.sum(F.col("ra").cast("double") * F.col("rb")).alias("product")
    from_light = (
        a.join(b, ["cluster_id", "user_id"]).filter(F.col("lo") < F.col("hi"))
        .groupBy("lo", "hi").agg(product)
        .join(pairs, ["lo", "hi"], "left_semi")
    )
    big = rated.filter("heavy").select("user_id", "item_id", "rating")
    counts = big.groupBy("item_id").agg(F.count("*").alias("n"))
    sized = (
        pairs.join(counts.select(F.col("item_id").alias("lo"), F.col("n").alias("n_lo")), "lo")
        .join(counts.select(F.col("item_id").alias("hi"), F.col("n").alias("n_hi")), "hi")
    )
    lo_rarer = F.col("n_lo") <= F.col("n_hi")
    rarer = F.when(lo_rarer, F.col("lo")).otherwise(F.col("hi"))
    other = F.when(lo_rarer, F.col("hi")).otherwise(F.col("lo"))
    from_heavy = (
        sized.select("lo", "hi", rarer.alias("i"), other.alias("j"))
        .join(big.select("user_id", F.col("item_id").alias("i"), F.col("rating").alias("ra")), "i")
        .join(big.select("user_id", F.col("item_id").alias("j"), F.col("rating").alias("rb")), ["user_id", "j"])
        .groupBy("lo", "hi").agg(product)
    )
    return from_light.unionByName(from_heavy).groupBy("lo", "hi").agg(F.sum("product").alias("product"))


def _wanted(test_placed: DataFrame, light: DataFrame) -> DataFrame:
    """Each light test pair with every rated item of its block: at most `limit` rows each."""
    other = light.select(
        "user_id", "cluster_id", F.col("item_id").alias("other_item_id"),
        F.col("n").alias("other_n"), F.col("a").alias("other_a"), F.col("norm").alias("other_norm"),
        (F.col("rating") - F.col("base")).alias("deviation"),
    )
    return test_placed.join(other, ["user_id", "cluster_id"])


def _with_similarity(wanted: DataFrame, products: DataFrame, n_users: int) -> DataFrame:
    dot = F.coalesce("product", F.lit(0.0)) + F.col("a") * F.col("other_a") * (
        n_users - F.col("n") - F.col("other_n")
    )
    sim = F.try_divide(dot, F.col("norm") * F.col("other_norm"))
    return wanted.join(products, ["lo", "hi"], "left").withColumn("similarity", sim)


def _ordered(wanted: DataFrame) -> DataFrame:
    return wanted.withColumns(
        {"lo": F.least("item_id", "other_item_id"), "hi": F.greatest("item_id", "other_item_id")}
    )


def heavy_limit(n_ratings: int) -> int:
    return max(MIN_HEAVY, math.isqrt(n_ratings))


def item_similarity(pairs: DataFrame, train: DataFrame, blocks: DataFrame, n_users: int,
                    limit: int) -> DataFrame:
    """Similarity of the item pairs ``(lo, hi)``, both in one block."""
    rated = _tag_heavy(train.join(blocks, "item_id"), limit)
    stats = item_stats(train, n_users)
    lo = stats.select(F.col("item_id").alias("lo"), "n", "a", "norm")
    hi = stats.select(F.col("item_id").alias("hi"), F.col("n").alias("other_n"),
                      F.col("a").alias("other_a"), F.col("norm").alias("other_norm"))
    known = pairs.join(lo, "lo").join(hi, "hi")
    return _with_similarity(known, common_products(pairs, rated), n_users).select("lo", "hi", "similarity")


def rated_pairs(test: DataFrame, train: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct item pairs a prediction compares: test item and rated item of one user and block.

    All users count.  Their number is bounded by the pairs of items in a block;
    repeats are dropped in the tasks that make them.
    """
    t = test.join(blocks, "item_id").select("user_id", "cluster_id", "item_id")
    r = train.join(blocks, "item_id").select("user_id", "cluster_id", F.col("item_id").alias("other_item_id"))
    return _ordered(t.join(r, ["user_id", "cluster_id"])).select("lo", "hi").distinct()


def _light_sums(test_placed: DataFrame, rated: DataFrame, n_users: int) -> DataFrame:
    wanted = _ordered(_wanted(test_placed, rated.filter(~F.col("heavy"))))
    pairs = wanted.select("lo", "hi").distinct()
    # written first: while pairs of items are few, Spark sends them to where the wanted rows are
    scored = _with_similarity(wanted, cut(common_products(cut(pairs), rated)), n_users)
    sim = F.col("similarity")
    return scored.groupBy("user_id", "item_id").agg(
        F.sum(sim * F.col("deviation")).alias("num"), F.sum(sim).alias("den")
    )


def _heavy_sums(test_placed: DataFrame, rated: DataFrame, train: DataFrame, n_users: int) -> DataFrame:
    """The same sums for heavy (user, block) groups, without item pairs."""
    group = ["user_id", "cluster_id"]
    u = F.try_divide(F.lit(1.0), F.col("norm"))
    mine = rated.filter("heavy").join(test_placed.select(*group), group, "left_semi").select(
        *group, F.col("item_id").alias("j"), "n", "a",
        (u * (F.col("rating") - F.col("base"))).alias("w"), u.alias("u"),
    )  # an item with a constant vector has no similarity: null weights, left out of every sum
    tail = F.col("a") * (F.col("n") - n_users)
    sums = mine.groupBy(*group).agg(
        F.sum(F.col("w") * F.col("a")).alias("a_w"), F.sum(F.col("u") * F.col("a")).alias("a_u"),
        F.sum(F.col("w") * tail).alias("v_w"), F.sum(F.col("u") * tail).alias("v_u"),
    )
    by_j = train.select(F.col("user_id").alias("y"), F.col("item_id").alias("j"), F.col("rating").alias("ry"))
    p = mine.join(by_j, "j").groupBy(*group, "y").agg(
        F.sum(F.col("w") * F.col("ry")).alias("p_w"), F.sum(F.col("u") * F.col("ry")).alias("p_u")
    )
    by_i = train.select(F.col("user_id").alias("y"), "item_id", F.col("rating").alias("ry"))
    asked = test_placed.join(sums.select(*group), group, "left_semi").select(*group, "item_id")
    over_users = (
        asked.join(by_i, "item_id").join(p, [*group, "y"])
        .groupBy(*group, "item_id")
        .agg(F.sum(F.col("ry") * F.col("p_w")).alias("rp_w"), F.sum(F.col("ry") * F.col("p_u")).alias("rp_u"))
    )

    def finish(rp: str, a_: str, v_: str):
        raw = F.coalesce(rp, F.lit(0.0)) - F.col(a_) * F.col("n") * F.col("a") - F.col("a") * F.col(v_)
        return F.try_divide(raw, F.col("norm"))

    return (
        test_placed.join(sums, group).join(over_users, [*group, "item_id"], "left")
        .select("user_id", "item_id", finish("rp_w", "a_w", "v_w").alias("num"),
                finish("rp_u", "a_u", "v_u").alias("den"))
    )


def predict(test: DataFrame, train: DataFrame, blocks: DataFrame, mu: float, n_users: int,
            limit: int) -> DataFrame:
    """Rating of each test pair from all items of its block that its user rated.

    ``baseline + sum(sim * (rating - other baseline)) / sum(sim)``.  Pairs whose
    user rated nothing else in the block, or whose user or item was not trained
    on, get no row; the prediction is null when the similarities add up to 0.
    """
    check_once(train)
    rated = cut(_tag_heavy(_placed(train, train, blocks, mu, n_users), limit))
    asked = cut(_placed(test.dropDuplicates(), train, blocks, mu, n_users))
    sums = _light_sums(asked, rated, n_users)
    if not rated.filter("heavy").isEmpty():
        sums = sums.unionByName(_heavy_sums(asked, rated, train, n_users))
    # both ways of summing agree up to rounding only, so a sum this close to 0 is 0
    predicted = F.col("base") + F.when(F.abs("den") > NO_SIMILARITY, F.col("num") / F.col("den"))
    return asked.join(sums, ["user_id", "item_id"]).select(
        *test.columns, predicted.alias("predicted_rating")
    )


def coverage(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test pairs, those whose item was not trained on, and their share."""
    seen = train.select("item_id").distinct().withColumn("seen", F.lit(1))
    return test.join(seen, "item_id", "left").agg(
        F.count("*").alias("test_pairs"),
        F.count_if(F.col("seen").isNull()).alias("untested"),
        F.avg(F.col("seen").isNull().cast("double")).alias("untested_share"),
    )


def rmse(predictions: DataFrame, test: DataFrame, train: DataFrame) -> DataFrame:
    """Root mean square error, over predicted pairs and over pairs with a known item.

    ``rmse_reference`` divides by all test pairs whose item was trained on,
    including those without a prediction, so it is never the larger one.
    """
    err = F.col("true_rating") - F.col("predicted_rating")
    hit = predictions.agg(
        F.sum(err * err).alias("sse"), F.count("predicted_rating").alias("predicted")
    )
    known = test.join(train.select("item_id"), "item_id", "left_semi").agg(F.count("*").alias("known"))
    both = hit.unionByName(known, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("sse", "predicted", "known")])
    return both.select(
        "predicted", "known",
        F.sqrt(F.try_divide("sse", "predicted")).alias("rmse"),
        F.sqrt(F.try_divide("sse", "known")).alias("rmse_reference"),
    )


def cluster_sizes(blocks: DataFrame) -> DataFrame:
    """Items per block."""
    return blocks.groupBy("cluster_id").agg(F.countDistinct("item_id").alias("items"))
