import random
from itertools import combinations

import pytest
from conftest import rows

from shelfline.operators import basket


def brute(pairs, min_support):
    by_basket = {}
    for b, p in pairs:
        by_basket.setdefault(b, set()).add(p)
    count, single = {}, {}
    for items in by_basket.values():
        for p in items:
            single[p] = single.get(p, 0) + 1
        for a, b in combinations(sorted(items), 2):
            count[a, b] = count.get((a, b), 0) + 1
    n = len(by_basket)
    return sorted(
        ((a, b, c, c / single[a], c * n / (single[a] * single[b])) for (a, b), c in count.items() if c >= min_support), key=str)


@pytest.fixture(scope="module")
def sales():
    rng = random.Random(5)
    data = [(f"b{rng.randrange(60)}", f"p{rng.randrange(25)}") for _ in range(300)]
    data += [("huge", f"p{i}") for i in range(40)]                    # a third of all rows in one basket
    data += [("big1", f"q{i}") for i in range(12)] + [("big2", f"q{i}") for i in range(3, 15)]  # pairs that only large baskets hold
    data += [(f"b{i}", "hot") for i in range(55)]                     # one product in almost every basket
    data += [("huge", "p1"), ("b1", "p1"), ("b1", "p1")]              # repeats count once
    return data



@pytest.mark.parametrize("min_support, share", [(1, 1000), (1, 7), (2, 1), (3, 5)])
def test_pairs_equal_brute_force(spark, sales, min_support, share):
    df = spark.createDataFrame(sales, "o string, p string")
    got = basket.product_pairs(df, "o", "p", min_support, share)
    assert rows(got) == brute(sales, min_support)


def test_limit_takes_the_strongest(spark, sales):
    df = spark.createDataFrame(sales, "o string, p string")
    top = basket.product_pairs(df, "o", "p", limit=3).collect()
    assert len(top) == 3 and top[0]["co_occurrence_count"] >= top[2]["co_occurrence_count"]


def test_a_huge_basket_is_looked_up(spark):
    """One basket of 20,000 items: only pairs that other baskets hold are counted in it."""
    small = [(f"b{i}", f"p{(i * 7 + j * 13) % 400}") for i in range(300) for j in range(4)]
    sales = small + [("huge", f"p{i}") for i in range(20_000)]
    df = spark.createDataFrame(sales, "o string, p string")
    items = basket.basket_items(df, "o", "p")
    for support in (2, 3):
        got = basket.frequent_pairs(items, support, share=100)
        counts = {}
        for b in {b for b, _ in small}:
            for pair in combinations(sorted({p for o, p in small if o == b}), 2):
                counts[pair] = counts.get(pair, 1) + 1  # and once in the huge basket
        assert rows(got) == sorted(((a, b, c) for (a, b), c in counts.items() if c >= support), key=str)


@pytest.mark.parametrize("support", [2, 3, 4, 9])
def test_several_large_baskets(spark, support):
    data = [(f"big{k}", f"p{i}") for k in range(5) for i in range(k, 30)] + [(f"b{i}", f"p{i % 9 + j}") for i in range(40) for j in range(3)]
    df = spark.createDataFrame(data, "o string, p string")
    got = basket.product_pairs(df, "o", "p", support, share=10)
    assert rows(got) == brute(data, support)
