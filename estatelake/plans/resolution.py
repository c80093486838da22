"""Entity resolution as dry run, review and apply: nothing is decided twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.fixed_values import CANDIDATES_FOR_DECISION
from estatelake.operators import buildings, lines
from estatelake.session import settled
from estatelake.sources.plan_files import read_plan, write_plan


def propose_lines(
    line: DataFrame, canonical: DataFrame, areas: DataFrame, decider: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Proposals for all lines. Labels the rules cannot settle go to ``decider``: it gets (name, region, candidates) and
    returns (name, region, reply); its replies are checked against the candidates. Without one they stay unknown."""
    candidates = settled(lines.line_candidates(line, canonical, CANDIDATES_FOR_DECISION, areas))
    ruled = lines.rule_decisions(line, candidates)
    if decider is None:
        return lines.propose(line, ruled.drop("decided"))
    open_labels = ruled.where(~F.col("decided")).select("name", "region")
    # At most fifteen candidates per label, so the list is short by construction.
    shown = candidates.groupBy("name", "region").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ekidata_id", "score"))).alias("candidates")
    )
    asked = open_labels.join(shown, ["name", "region"], "left")
    decided = lines.read_decisions(decider(asked), candidates, canonical)
    fixed = ruled.where("decided").drop("decided")
    return lines.propose(line, fixed.unionByName(decided))


def dry_run_lines(proposals: DataFrame, path: str, target: str) -> None:
    write_plan(proposals, path, target)


def apply_lines(spark: SparkSession, line: DataFrame, path: str, target: str) -> DataFrame:
    return lines.apply_proposals(line, read_plan(spark, path, target))


def dry_run_buildings(building: DataFrame, unit: DataFrame, listed: DataFrame, path: str, target: str) -> None:
    write_plan(buildings.plan_building_merges(building, unit, listed), path, target)


def apply_buildings(
    spark: SparkSession, path: str, target: str, runs: DataFrame, listed: DataFrame, building: DataFrame, unit: DataFrame,
    link: DataFrame,
) -> buildings.MergedBuildings:
    plan = read_plan(spark, path, target, runs)
    return buildings.apply_building_merges(plan, buildings.unit_key_index(listed), building, unit, link)
