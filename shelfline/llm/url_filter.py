r"""URL filters: fixed host and path rules, and gradient-boosted trees for every other URL.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what
follows up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty. A rule fits
its host and all subdomains if the path starts with the rule's; the longest rule wins.

URLs that a rule decides are the labelled ones. The trees are fitted on at most
``SAMPLE`` of them, chosen by a hash of the URL, from lexical features (lengths, depth,
digit ratio, entropy, parameter counts, statistics of the host's suffix and of the
path's first part); they decide the rest by probability. Suffix and head statistics are
smoothed shares of blocked URLs among all labelled rows, for every value on its own: a written
table of grouped counts is joined to the pages. The ``HOT`` values that most pages
have are joined by broadcast, so that no shuffle meets a frequent value.

A row that trains the trees must not see its own label through a share: its shares leave out
its fold, one of ``FOLDS`` by a hash of the URL. And pages without a rule mostly have a suffix that no labelled row
has, so each share is hidden from half of the training rows (it is the overall share there, as
for an unknown value): the trees learn what the other features say without it. Rows that a rule decides are not scored.

Without labelled rows, or with one class only, the share of that class decides (0.5:
allow). Equal URLs get equal verdicts. Empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.session import stash

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE = 20_000
HOT = 4_096
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "upper_ratio", "entropy", "n_params", "query_length", "hyphens", "escapes", "has_fragment", "suffix_share", "head_share")


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text or null, its verdict or null) of the longest rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def head(path: Column) -> Column:
    """The first part of a path."""
    return F.coalesce(F.split_part(path, F.lit("/"), F.lit(2)), F.lit(""))


# --- boosted trees in numpy --------------------------------------------------------------------------------------------


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def lexical(rows: pd.DataFrame) -> np.ndarray:
    """Feature matrix of (url, host, path, suffix_share, head_share)."""
    url, host, path = rows["url"].fillna(""), rows["host"], rows["path"]
    size = url.str.len().clip(lower=1)
    query = url.str.extract(r"^[^?#]*\?([^#]*)", expand=False).fillna("")
    distinct = {u: _entropy(u) for u in url.unique()}
    columns = [
        url.str.len(), host.str.len(), path.str.len(), host.str.count(r"\.") + 1, path.str.count("/"), url.str.count(r"[0-9]") / size, url.str.count(r"[A-Z]") / size,
        url.map(distinct), query.str.count("[^&]+"), query.str.len(), url.str.count("-"), url.str.count("%[0-9A-Fa-f]{2}"), url.str.contains("#", regex=False).astype(float),
        rows["suffix_share"], rows["head_share"],
    ]
    return np.column_stack([np.asarray(c, np.float64) for c in columns]) if len(rows) else np.zeros((0, len(FEATURES)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> dict:
    """Logistic boosting: depth-wise trees over histogram bins, by Newton gains."""
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    model = {"start": float(np.log(prior / (1 - prior))), "trees": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])  # code <= b: value <= cuts[b]
    score = np.full(len(y), model["start"])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node, tree = np.zeros(len(y), np.int64), []
        for level in range(depth):
            n = 1 << level
            best = np.full(n, 1e-6)
            split = np.full((n, 2), -1)
            total_g, total_h = np.bincount(node, grad, n), np.bincount(node, hess, n)
            for f in range(x.shape[1]):
                width = len(cuts[f]) + 1
                g = np.bincount(node * width + codes[:, f], grad, n * width).reshape(n, width).cumsum(1)[:, :-1]
                h = np.bincount(node * width + codes[:, f], hess, n * width).reshape(n, width).cumsum(1)[:, :-1]
                if not g.size:
                    continue
                gain = g**2 / (h + l2) + (total_g[:, None] - g) ** 2 / (total_h[:, None] - h + l2) - (total_g**2 / (total_h + l2))[:, None]
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better], split[better, 0], split[better, 1] = top[better], f, at[better]
            feature, cut = split[node, 0], split[node, 1]
            right = np.where(feature >= 0, codes[np.arange(len(y)), np.maximum(feature, 0)] > cut, False)
            node = node * 2 + right
            tree.append([(int(f), float(cuts[f][c]) if f >= 0 else 0.0) for f, c in split])
        leaves = rate * np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + l2)
        model["trees"].append((tree, leaves))
        score += leaves[node]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), model["start"])
    for tree, leaves in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for splits in tree:
            feature = np.array([f for f, _ in splits])[node]
            cut = np.array([c for _, c in splits])[node]
            node = node * 2 + np.where(feature >= 0, x[np.arange(len(x)), np.maximum(feature, 0)] > cut, False)
        score += leaves[node]
    return 1 / (1 + np.exp(-score))


# --- the operator ------------------------------------------------------------------------------------------------------


def url_fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def shares(parts: DataFrame, key: str, prior: float) -> DataFrame:
    """(``key``, pages, share, others): for every value its pages, the smoothed share of blocked URLs among its labelled rows, and that share without each fold.

    parts: ``key``, ``by_rule``, ``fold``.
    """
    labelled, blocked = F.col("by_rule").isNotNull(), F.col("by_rule") == "block"
    folds = [(F.count(F.when(labelled & (F.col("fold") == k), 1)).alias(f"n{k}"), F.count(F.when(blocked & (F.col("fold") == k), 1)).alias(f"b{k}")) for k in range(FOLDS)]
    counts = parts.groupBy(key).agg(F.count("*").alias("pages"), F.count("by_rule").alias("n"), F.count(F.when(blocked, 1)).alias("b"), *(c for pair in folds for c in pair))

    def share(b: Column, n: Column) -> Column:
        return (b + F.lit(20 * prior)) / (n + 20)

    others = F.array(*(share(F.col("b") - F.col(f"b{k}"), F.col("n") - F.col(f"n{k}")) for k in range(FOLDS)))
    return stash(counts.select(key, "pages", share(F.col("b"), F.col("n")).alias("share"), others.alias("others")), f"url-{key}")


def with_share(rows: DataFrame, table: DataFrame, key: str, hot: int = HOT, own_fold: bool = True) -> DataFrame:
    """``rows`` with the share of their value of ``key``, or with the share without their ``fold``.

    ``spread`` deals rows of hot values over the shuffle, where they match nothing.
    """
    table = table.select(key, "pages", (F.col("share") if own_fold else F.col("others")).alias("share"))
    top = table.orderBy(F.desc("pages"), key).limit(hot).select(key, F.col("share").alias("hot_share"))
    rest = table.select(key, F.lit(-1).cast("long").alias("place"), F.col("share").alias("own_share"))
    rows = rows.join(F.broadcast(top), key, "left").withColumn("place", F.when(F.col("hot_share").isNull(), -1).otherwise(F.col("spread")))
    rows = rows.join(rest, [key, "place"], "left").withColumn(f"{key}_share", F.coalesce("hot_share", "own_share")).drop("hot_share", "own_share", "place")
    return rows if own_fold else rows.withColumn(f"{key}_share", F.col(f"{key}_share")[F.col("fold")])


def training_rows(labelled: DataFrame, tables: dict[str, DataFrame], rate: float, sample: int = SAMPLE) -> pd.DataFrame:
    """At most ``sample`` labelled rows with shares that do not know them, half of the shares hidden."""
    columns = ["url", "host", "path", "suffix_share", "head_share", "blocked"]
    order = [F.xxhash64("url"), F.col("url"), F.col("blocked")]
    chosen = labelled.select("url", "host", "path", "suffix", "head", "blocked", "fold").orderBy(*order).limit(sample).withColumn("spread", F.monotonically_increasing_id())
    for key, table in tables.items():
        chosen = with_share(chosen, table, key, own_fold=False)
        hidden = F.pmod(F.xxhash64(F.lit(key), "url"), F.lit(2)) == 0
        chosen = chosen.withColumn(f"{key}_share", F.when(hidden, F.lit(rate)).otherwise(F.col(f"{key}_share")))
    return pd.DataFrame([tuple(r) for r in chosen.select(*columns).orderBy(*order).collect()], columns=columns)


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``, the trees' probability where no rule decides, of every page."""
    spark = pages.sparkSession
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("by_rule"), suffix(F.col("host")).alias("suffix"), head(F.col("path")).alias("head"), url_fold(F.col("url")).alias("fold"))
    labelled = parts.where(F.col("rule").isNotNull()).withColumn("blocked", F.col("by_rule") == "block")
    rate = labelled.agg(F.avg(F.col("blocked").cast("double"))).first()[0]
    rate = 0.5 if rate is None else rate
    tables = {key: shares(parts, key, rate) for key in ("suffix", "head")}
    rows = training_rows(labelled, tables, rate, sample)
    model = fit_trees(lexical(rows), rows["blocked"].astype(float).to_numpy())
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "host": batch["host"], "path": batch["path"], "block_score": predict(model, lexical(batch))})

    open_rows = parts.where(F.col("rule").isNull()).withColumn("spread", F.monotonically_increasing_id())
    for key, table in tables.items():
        open_rows = with_share(open_rows, table, key)
    scored = open_rows.select("page_id", "url", "host", "path", "suffix_share", "head_share").mapInPandas(score, "page_id long, host string, path string, block_score double")
    scored = scored.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("block_score") > 0.5, "block").otherwise("allow").alias("verdict"), "block_score")
    decided = labelled.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    return decided.unionByName(scored)
