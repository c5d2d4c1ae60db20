r"""Mixing sources to target weights with pivotal dependent rounding, in DataFrame functions only.

Each source gets a target number of words: all sources share ``share`` times the corpus by
their weights, no source more than ``cap`` times its own size, the excess going to the
others by weight. A document of a source then has the same fractional number of copies,
target / source size. Its whole part is taken as it is; the rest is a probability that is
rounded to 0 or 1 by the pivotal method: two documents at a time, words move at random
from one to the other, as much as makes one of them whole, with odds that keep both
expectations; the other one goes on. The words taken by a block so stay fixed but for its
one unresolved document. Blocks are formed by hash, and their residuals meet in blocks
again, up a tree, until one document per source is left. It is left out, and the document
whose size comes nearest to the words still missing is put back. A source so misses its
target by at most half of its largest document, and mostly by a few words.

Word: ``[^\x20\x09-\x0D]+``; a null text has none. Source weights are dealt in code point order,
a null source last. Rows that are equal in id, source and size are one group with a count
until the tree, and are numbered there, so each may be taken a different number of times.
A null id is an id of its own. Results depend on the rows alone, not on their order or
partitions. A source without words has target 0. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stash

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 32
RUN = 4_096  # copies that one row stands for at most when they are numbered
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``n``, ``target`` from rows of (source, size, copies).

    The shared level is found in closed form: sources reach their cap in the order of
    cap over weight, so a running sum over that order tells which ones do. The windows
    run over one row per source.
    """
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*(F.lit(float(w)) for w in weights))
    by = by.withColumn("weight", F.element_at(dealt, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * float(cap))
    rank = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.greatest(left, F.lit(0.0)) / weight_left  # if this one and all after it shared what is left
    by = by.withColumn("level", level)
    by = by.withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    # the first source that stays below its cap sets the level of all after it
    shared = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", "n", F.least("most", F.coalesce(shared * F.col("weight"), "most")).alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def _merge(level: int):
    """One pivotal step: the carried document meets the next one."""

    def settled(unit: Column, p: Column) -> Column:
        return F.struct(unit["id"].alias("id"), unit["source"].alias("source"), unit["size"].alias("size"), unit["k"].alias("k"), p.alias("p"))

    def merge(state: Column, unit: Column) -> Column:
        carry = state["carry"]
        up = F.least((1.0 - carry["p"]) * carry["size"], unit["p"] * unit["size"])  # words that can move to the carried one
        down = F.least(carry["p"] * carry["size"], (1.0 - unit["p"]) * unit["size"])
        coin = _uniform(F.lit(level), carry["id"], carry["source"], carry["size"], carry["k"], unit["id"], unit["size"], unit["k"])
        moved = F.when(coin * (up + down) < down, up).otherwise(-down)
        snap = lambda p: F.when(p < _NEAR, 0.0).when(p > 1.0 - _NEAR, 1.0).otherwise(p)
        a = settled(carry, snap(carry["p"] + moved / carry["size"]))
        b = settled(unit, snap(unit["p"] - moved / unit["size"]))
        pair = F.struct(a.alias("a"), b.alias("b"))
        whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
        none = F.lit(None).cast("struct<id:bigint,source:string,size:bigint,k:bigint,p:double>")
        # bound once, so that the step is not evaluated again for each use
        met = F.transform(
            F.array(pair),
            lambda x: F.struct(
                F.when(~whole(x["a"]), x["a"]).when(~whole(x["b"]), x["b"]).otherwise(none).alias("carry"),
                F.concat(state["done"], F.filter(F.array(x["a"], x["b"]), whole)).alias("done"),
            ),
        )[0]
        return F.when(carry.isNull(), F.struct(unit.alias("carry"), state["done"].alias("done"))).otherwise(met)

    return merge


def _round(units: DataFrame, level: int, blocks: Column) -> DataFrame:
    """One level of the tree: (``carry``, ``done``) of each block of undecided documents."""
    unit = F.struct("id", "source", "size", "k", "p")
    kind = "struct<id:bigint,source:string,size:bigint,k:bigint,p:double>"
    block = F.pmod(F.xxhash64(F.lit(level), "id", "source", "size", "k"), blocks)
    start = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("done"))
    grouped = units.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(unit)).alias("units"))
    return grouped.select(F.aggregate("units", start, _merge(level)).alias("s")).select("s.carry", "s.done")


def _settle(decided: DataFrame, roots: DataFrame) -> DataFrame:
    """Decide the last document of each source, and so its remaining words.

    The root is left out, and the words that are then missing are given back by the one
    left-out document (the root among them) whose size is nearest to them, if that helps.
    """
    missing = roots.select(F.col("source").alias("rs"), (F.col("p") * F.col("size")).alias("missing"))
    everything = decided.unionByName(roots.select("id", "source", "size", "k", F.lit(0.0).alias("p")))
    open_rows = everything.where(F.col("p") == 0.0).join(missing, F.col("source").eqNullSafe(F.col("rs")))
    off = F.abs(F.col("size") - F.col("missing"))
    nearest = F.min(F.struct(off.alias("off"), F.xxhash64("id", "size", "k").alias("h"), "id", "size", "k", "missing")).alias("best")
    back = open_rows.groupBy("source").agg(nearest).where("best.off < best.missing")
    back = back.select(F.col("best.id").alias("bi"), F.col("source").alias("bs"), F.col("best.size").alias("bz"), F.col("best.k").alias("bk"), F.lit(1.0).alias("back"))
    same = F.col("id").eqNullSafe(F.col("bi")) & F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("k") == F.col("bk"))
    return everything.join(back, same, "left").select("id", "source", "size", "k", F.coalesce("back", "p").alias("p"))


def _numbered(groups: DataFrame) -> DataFrame:
    """One row per copy, numbered ``k`` from 1 within its group; a large group is cut into runs that different tasks number."""
    last = F.floor((F.col("copies") - 1) / RUN).cast("long")
    cut = groups.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("id", "source", "size", "run")
    first = F.col("run") * RUN
    return cut.withColumn("k", F.explode(F.sequence(first + 1, F.least(first + RUN, "copies")))).drop("run", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` words."""
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    groups = stash(sized.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "mixing-groups")
    by_source = stash(targets(groups, weights, share, cap), "mixing-targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(rate - F.floor(rate) > 1.0 - _NEAR, F.ceil(rate).cast("double")).otherwise(rate)
    here = by_source.select(F.col("source").alias("s"), "source_size", "n", "target", rate.alias("rate"))
    grouped = groups.join(here, groups["source"].eqNullSafe(here["s"])).select(
        "id", "source", "size", "source_size", "target", "n", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "copies"
    )
    rows = _numbered(grouped)
    undecided = (F.col("p") > _NEAR) & (F.col("size") > 0)
    units = rows.where(undecided).select("id", "source", "size", "k", "p", "n")

    most = by_source.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), BLOCK)))
    decided = None
    for level in range(levels):
        blocks = F.ceil(F.col("n") / float(BLOCK ** (level + 1)))  # about BLOCK residuals of the level below meet in each
        step = stash(_round(units, level, blocks), f"mixing-level{level}")
        done = step.select(F.explode("done").alias("u")).select("u.*")
        decided = done if decided is None else decided.unionByName(done)
        left = step.where(F.col("carry").isNotNull()).select("carry.*")
        units = left.join(by_source.select(F.col("source").alias("s"), "n"), left["source"].eqNullSafe(F.col("s"))).drop("s")
    decided = _settle(decided, units)

    more = decided.select(F.col("id").alias("di"), F.col("source").alias("ds"), F.col("size").alias("dz"), F.col("k").alias("dk"), F.col("p").alias("extra"))
    same = rows["id"].eqNullSafe(more["di"]) & rows["source"].eqNullSafe(more["ds"]) & (rows["size"] == more["dz"]) & (rows["k"] == more["dk"])
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long")
    return rows.join(more, same, "left").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
