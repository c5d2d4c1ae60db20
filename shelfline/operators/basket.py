"""Product pairs bought together: count, confidence and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions import exprs as X
from shelfline.session import stash

# Left items of one basket in one task.
SHARE = 500
# Baskets that are looked up instead of paired, at most.
MOST_LARGE = 10_000


def basket_items(sales: DataFrame, basket: str, product: str) -> DataFrame:
    """Distinct (basket, product)."""
    named = sales.select(F.col(basket).alias("basket"), F.col(product).alias("product"))
    return named.where(F.col("basket").isNotNull() & F.col("product").isNotNull()).distinct()


def frequent_items(items: DataFrame, min_support: int, support: DataFrame) -> DataFrame:
    """Items of products that occur in enough baskets: a pair cannot be more frequent than its parts.

    ``support`` has the baskets ``n`` of each product. The rare products are written when this is called: as a rule they are few, and items
    are not shuffled to leave them out.
    """
    rare = stash(support.where(F.col("n") < min_support).select("product"), "rare-products")
    return items.join(rare, "product", "left_anti").select("basket", "product")


def pair_support(items: DataFrame, min_support: int = 1, share: int = SHARE) -> DataFrame:
    """Exact co-occurrence counts of pairs a < b with at least ``min_support`` baskets.

    Items are dealt by basket once. A basket of up to ``share`` items is one row there, which gives its pairs. A larger one is
    dealt to one salt per ``share`` items: the left side of a
    self-join goes to one of them by product, the right side to all, so no task
    holds more than ``share`` left items of one basket. Pairs are counted map-side as they are produced.
    """
    sizes = items.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("salts"))
    own = items.join(sizes.where("salts = 1"), "basket").groupBy("basket").agg(F.sort_array(F.collect_list("product")).alias("own"))
    spots = own.select("own", F.posexplode("own").alias("spot", "product_a"))
    after = F.expr("slice(own, spot + 2, size(own))")
    small = spots.select("product_a", F.explode(after).alias("product_b"))
    dealt = items.join(sizes.where("salts > 1"), "basket")
    left = dealt.select("basket", F.col("product").alias("product_a"), F.pmod(F.xxhash64("product"), F.col("salts")).cast("int").alias("salt"))
    right = dealt.select("basket", F.col("product").alias("product_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    large = left.join(right, ["basket", "salt"]).where("product_a < product_b").select("product_a", "product_b")
    counted = small.unionByName(large).groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("co_occurrence_count"))
    return counted.where(F.col("co_occurrence_count") >= min_support)


def frequent_pairs(items: DataFrame, min_support: int, share: int = SHARE) -> DataFrame:
    """Exact counts of pairs a < b in at least ``min_support`` baskets, without making all pairs of the largest baskets.

    Two passes over two parts of the baskets. Fewer than ``min_support`` baskets, the largest ones, cannot make
    a pair frequent by themselves, so a frequent pair is in another basket, and in as many of them as
    the support exceeds the large ones. The first pass counts pairs of the other baskets and
    keeps these candidates; the second looks candidates up in the large baskets. A basket
    of n items then costs the candidates it holds, not n * n / 2 pairs. Writes the candidates when called.
    """
    sizes = items.groupBy("basket").agg(F.count(F.lit(1)).alias("n_items"))
    large = sizes.where(F.col("n_items") > share).orderBy(F.desc("n_items"), "basket").limit(min(max(min_support - 1, 0), MOST_LARGE)).select("basket")
    large = stash(large, "large-baskets")
    left_out = large.count()  # fewer than min_support
    if left_out == 0:
        return pair_support(items, min_support, share)
    # At most MOST_LARGE rows.
    rest, inside = items.join(F.broadcast(large), "basket", "left_anti"), items.join(F.broadcast(large), "basket")
    candidates = stash(pair_support(rest, min_support - left_out, share), "pair-candidates")
    first = inside.select("basket", F.col("product").alias("product_a"))
    second = inside.select("basket", F.col("product").alias("product_b"))
    more = candidates.select("product_a", "product_b").join(first, "product_a").join(second, ["basket", "product_b"])
    more = more.groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("co_occurrence_count"))
    both = candidates.unionByName(more).groupBy("product_a", "product_b").agg(F.sum("co_occurrence_count").alias("co_occurrence_count"))
    return both.where(F.col("co_occurrence_count") >= min_support)


def product_pairs(
    sales: DataFrame,
    basket: str,
    product: str,
    min_support: int = 1,
    share: int = SHARE,
    limit: int | None = None,
) -> DataFrame:
    """product_a, product_b, co_occurrence_count, confidence of a -> b, lift.

    All pairs of all baskets; ``min_support`` and ``limit`` cut the report on request.
    """
    # Written once: support, basket sizes and the self-join all read it.
    items = stash(basket_items(sales, basket, product), "basket-items")
    support = stash(items.groupBy("product").agg(F.count(F.lit(1)).alias("n")), "product-support")
    if min_support > 1:
        pairs = frequent_pairs(frequent_items(items, min_support, support), min_support, share)
    else:
        pairs = pair_support(items, min_support, share)
    baskets = items.agg(F.countDistinct("basket")).scalar()
    joined = pairs.join(support.select(F.col("product").alias("product_a"), F.col("n").alias("n_a")), "product_a").join(
        support.select(F.col("product").alias("product_b"), F.col("n").alias("n_b")), "product_b"
    )
    out = joined.select(
        "product_a",
        "product_b",
        "co_occurrence_count",
        X.ratio("co_occurrence_count", "n_a").alias("confidence"),
        X.ratio(X.dbl("co_occurrence_count") * X.dbl(baskets), X.dbl("n_a") * X.dbl("n_b")).alias("lift"),
    ).orderBy(F.desc("co_occurrence_count"), "product_a", "product_b")
    return out if limit is None else out.limit(limit)
