"""Mixing sources to target weights by entropy balancing.

Every source gets a target in tokens. Document rates are those nearest to 1 in relative entropy (sum of r log r - r) among all rates
from 0 to ``most`` that give the source its target: r = min(most, exp(lambda * size)), one lambda for each source. The lambdas
are the solution of a convex dual, whose gradient is the tokens taken minus the target; Newton steps on the logarithm of the
tokens, kept inside a bracket that shrinks, solve it for all sources at once.

Rates depend on source and size alone, so Newton runs over a table of cells (source, size, documents). Its sums are exact
decimals: the order in which Spark adds them up makes no difference, and reruns agree in every digit. Rates are rounded into copies
per cell, from large sizes to small, each cell making good the words that the one before it missed; which documents of a cell
get the higher number is settled by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.common import stored

STEPS, CLOSE, PART = 100, 1e-8, 2**20  # Newton steps at most, the relative error at which they end, parts of a token that are summed up
DEALT = 1_024  # documents of a cell, about, that are put in order together
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of signs that are not white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``rank``, from 0 along ``by`` with null last, in a layout by range: one count per task is all that meets in one place."""
    order = F.col(by).asc_nulls_last()
    laid = rows.repartitionByRange(order).sortWithinPartitions(order)
    laid = stored(laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = laid.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.join(counts.select("__part", before.alias("shift")), "__part").withColumn("rank", F.col("__at") + F.col("shift")).drop("__part", "__at", "shift")


def targets(sources: DataFrame, weight: Column, share: float, most: float) -> DataFrame:
    """Adds ``target`` to sources (source, size, rank): ``share`` of all sizes dealt by ``weight``, no more than ``most`` times a
    source's size, the excess dealt again by weight among the others until no target is above. A round costs one aggregate."""
    rows = sources.withColumn("weight", weight.cast("double"))
    total, level = share * (rows.agg(F.sum("size")).first()[0] or 0), None
    limit = F.col("size") * F.lit(float(most))
    while True:
        full = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        free, taken, n = rows.agg(
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.sum(F.when(full, limit).otherwise(0.0)), F.count(F.when(full, 1))
        ).first()
        if not free or (level is not None and n == before):
            break
        level, before = (total - taken) / free, n
    return rows.withColumn("target", F.least(limit, F.col("weight") * F.lit(level or 0.0)))


def _solved(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(rank, lambda) with the tokens of the cells (rank, size, n) of each source at its target. ``size`` is positive."""
    edge = math.log(most)
    ranges = cells.groupBy("rank").agg(F.min("size").alias("least"))
    state = sources.where((F.col("size") > 0) & (F.col("target") > 0)).join(ranges, "rank")
    ratio = F.log(F.col("target") / F.col("size"))
    low = F.least(F.lit(0.0), ratio) / F.col("least")
    high = F.lit(edge) / F.col("least")
    whole = F.col("target") >= F.col("size") * F.lit(float(most))
    state = state.select("rank", "target", low.alias("low"), high.alias("high"), F.when(whole, high).otherwise(F.greatest(low, F.lit(0.0))).alias("lambda"), whole.alias("done"))
    state = stored(state)
    done = [state.where("done")]
    for _ in range(STEPS):
        open_ = state.where("not done")
        if not open_.limit(1).count():
            break
        at = F.col("lambda") * F.col("size")
        rate = F.when(at < edge, F.exp(at)).otherwise(F.lit(float(most)))
        taken = F.col("n") * F.col("size") * rate
        exact = lambda x: F.sum(F.round(x * PART).cast("decimal(38,0)")).cast("double") / PART
        sums = cells.join(open_.select("rank", "lambda"), "rank").groupBy("rank").agg(
            exact(taken).alias("taken"), exact(F.when(at < edge, taken * F.col("size")).otherwise(0.0)).alias("slope")
        )
        step = open_.join(sums, "rank")
        above = F.col("taken") > F.col("target")
        step = step.withColumns({"low": F.when(above, F.col("low")).otherwise(F.col("lambda")), "high": F.when(above, F.col("lambda")).otherwise(F.col("high"))})
        newton = F.col("lambda") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("taken") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        half = (F.col("low") + F.col("high")) / 2
        close = (F.abs(F.col("taken") - F.col("target")) <= F.col("target") * CLOSE + 1e-3) | (half <= F.col("low")) | (half >= F.col("high"))
        state = stored(step.select("rank", "target", "low", "high", F.when(close, F.col("lambda")).when(inside, newton).otherwise(half).alias("lambda"), close.alias("done")))
        done.append(state.where("done"))
    else:
        done.append(state.where("not done"))
    return stored(_union(done).select("rank", "lambda"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nearer(missing: float, sizes: np.ndarray, less: np.ndarray, more: np.ndarray) -> list[tuple[int, int]] | None:
    """One or two cells, with 1 or -1, whose change by one copy brings the tokens nearer to the target; None if there are none."""
    cells = np.concatenate([[-1], np.flatnonzero(less), np.flatnonzero(more)])
    signs = np.concatenate([[0], np.full(less.sum(), -1), np.full(more.sum(), 1)])
    words = np.concatenate([[0], signs[1:] * sizes[cells[1:]]])
    order = np.argsort(words, kind="stable")
    cells, signs, words = cells[order], signs[order], words[order]
    best, found = abs(missing), None
    at = np.searchsorted(words, missing - words)
    for shift in (-1, 0, 1):
        other = np.clip(at + shift, 0, len(words) - 1)
        left = np.where(cells == cells[other], np.where(cells == -1, abs(missing), np.inf), abs(missing - words - words[other]))
        i = int(left.argmin())
        if left[i] < best:
            best, found = left[i], [(int(cells[j]), int(signs[j])) for j in (i, other[i]) if cells[j] >= 0]
    return found


def _copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of the cells of one source. A source of W tokens has at most sqrt(2 W) sizes, so its cells fit in a task."""
    cells = cells.sort_values("size", ascending=False)
    sizes, n, rates = cells["size"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy()
    copies, wanted, taken = np.zeros(len(cells), np.int64), 0.0, 0
    for i, (size, count, rate) in enumerate(zip(sizes.tolist(), n.tolist(), rates.tolist())):
        wanted += size * count * rate
        number = round((wanted - taken) / size)
        copies[i] = min(max(number, count * math.floor(rate)), count * math.ceil(rate))
        taken += int(copies[i]) * size
    low, high = n * np.floor(rates).astype(np.int64), n * np.ceil(rates).astype(np.int64)
    while (change := _nearer(wanted - taken, sizes, copies > low, copies < high)) is not None:
        for i, more in change:
            copies[i] += more
            taken += int(more * sizes[i])
    return cells.assign(copies=copies)[["rank", "size", "n", "rate", "copies"]]


def mix(
    docs: DataFrame, source: str, size: str, key: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2
) -> DataFrame:
    """``docs`` with the struct ``mix``: source_size, target (of the row's source), rate and copies (0 to ``most``).

    Sources lie along their names by code point, null (a source like any other) last, and take the ``weights`` in turn. ``size`` is a
    whole number of tokens; null or negative counts as 0. A document of size 0 has rate and copies 1: it does not bear on any target.
    Copies are the rate rounded down or up, chosen so that no change of one or two cells by one copy would bring a source's tokens
    nearer to its target.
    Repeated rows are documents of their own; those equal in ``key`` and size may differ in copies. An empty table stays empty.
    Other columns stay as they are; one named ``mix`` is replaced.
    """
    names = docs.drop("mix").columns
    tokens = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = stored(docs.drop("mix").select(F.struct(*names).alias("row"), F.col(source).cast("string").alias("s"), tokens.alias("size"), F.xxhash64(F.col(key), F.lit("mix")).alias("h")))
    cells = stored(rows.groupBy("s", "size").agg(F.count("*").alias("n")))
    sources = ranked(cells.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("size")), "s")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(targets(sources, turn, share, most))
    cells = stored(cells.alias("c").join(sources.alias("q"), F.col("c.s").eqNullSafe(F.col("q.s"))).select("q.rank", "c.size", "n"))
    full = cells.where("size > 0")
    solved = _solved(full, sources.select("rank", "size", "target"), most)
    rate = F.when(F.col("lambda").isNull(), 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lambda") * F.col("size"))))
    rated = full.join(solved, "rank", "left").select("rank", "size", "n", rate.alias("rate"))
    counted = rated.groupBy("rank").applyInPandas(_copies, "rank long, size long, n long, rate double, copies long")
    none = cells.where("size = 0").select("rank", "size", "n", F.lit(1.0).alias("rate"), F.col("n").alias("copies"))
    deals = F.ceil(F.col("n") / DEALT).cast("long")
    # Of a cell's n documents, copies mod n get one more than the others.
    counted = counted.unionByName(none).withColumns({"base": F.floor(F.col("copies") / F.col("n")), "extra": F.col("copies") % F.col("n"), "deals": deals})
    named = sources.select("s", "rank", F.col("size").alias("source_size"), "target")
    counted = stored(counted.join(named, "rank"))
    both = rows.alias("r").join(counted.alias("c"), F.col("r.s").eqNullSafe(F.col("c.s")) & (F.col("r.size") == F.col("c.size")))
    # Ranges of the hash cut a cell into deals of about equal size. The extra copies go to all documents of the first ranges and
    # to the first documents of the range in which they run out; only those few documents are put in order.
    deal = F.least(F.floor((F.shiftrightunsigned("h", 32).cast("double") / 2**32) * F.col("deals")), F.col("deals") - 1)
    both = both.select("row", "r.s", "h", F.col("r.size").alias("size"), "rank", "source_size", "target", "rate", "base", "extra", deal.alias("deal"))
    counts = both.where("extra > 0").groupBy("rank", "size", "deal").agg(F.count("*").alias("m"), F.max("extra").alias("extra"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("rank", "size").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.select("rank", "size", "deal", "m", "extra", before.alias("before")).where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("m")))
    cut = stored(cut.select("rank", "size", F.col("deal").alias("last"), (F.col("extra") - F.col("before")).alias("left")))
    both = both.join(cut, ["rank", "size"], "left")
    border = F.col("deal") == F.col("last")
    place = Window.partitionBy("rank", "size").orderBy("h")
    sure = both.where(~F.coalesce(border, F.lit(False))).withColumn("more", F.coalesce(F.col("deal") < F.col("last"), F.lit(False)))
    unsure = both.where(border).withColumn("more", F.row_number().over(place) <= F.col("left"))
    out = sure.unionByName(unsure)
    made = F.struct("source_size", "target", "rate", (F.col("base") + F.col("more").cast("long")).alias("copies")).alias("mix")
    return out.select(*[F.col(f"row.{c}").alias(c) for c in names], made)


def in_copies(mixed: DataFrame) -> DataFrame:
    """Every document as often as it has copies, with ``copy`` from 1 on."""
    return mixed.where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))))
