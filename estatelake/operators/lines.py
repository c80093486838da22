"""Rail lines: candidates by name similarity, proposals, and merging duplicate lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelake.fixed_values import (
    CANDIDATES_DEFAULT, CONTAINED_IN_TARGET, CONTAINS_TARGET, REGION_BOOST,
)
from estatelake.functions.replies import parse_choice
from estatelake.functions.text import filled, nfkc
from estatelake.functions.transit import bare_name, bigrams, fallback_kind, transit_kind
from estatelake.session import settled


def _tokens(c: Column, own: str, other: str) -> Column:
    """Join keys of a name: its bigrams, and its characters for names of a single character on the other side.

    Two names of two or more characters that contain one another share a bigram. A single character shares none with
    the longer name around it, so that case has keys of its own, one kind per direction.
    """
    none = F.array().cast("array<string>")
    single = F.when(F.length(c) == 1, F.array(c)).otherwise(none)
    letters = F.when(F.length(c) > 1, F.array_distinct(F.split(c, ""))).otherwise(none)
    key = lambda kind: lambda piece: F.concat(F.lit(kind), piece)
    return F.concat(
        F.transform(bigrams(c), key(_BIGRAM)), F.transform(single, key(own)), F.transform(letters, key(other))
    )


_BIGRAM, _SHORT_NAME, _SHORT_TARGET = "b:", "n:", "t:"
HOT_TARGETS = 16  # a bigram in more comparable names than this makes no pairs


def canonical_targets(canonical: DataFrame) -> DataFrame:
    """Distinct comparable names per canonical line: (ekidata_id, target)."""
    forms = F.concat(F.array("name_kanji", "name_kana"), F.coalesce("alternative_names", F.array().cast("array<string>")))
    return (
        canonical.select("ekidata_id", F.explode(forms).alias("form"))
        .select("ekidata_id", nfkc(F.col("form")).alias("target"))
        .where(F.col("target") != "")
        .distinct()
    )


def _pieces(names: DataFrame, column: str, own: str, other: str, size: str) -> DataFrame:
    """(name, number of its bigrams, token) of every distinct name."""
    grams = F.size(bigrams(F.col(column))).alias(size)
    return names.select(column, grams, F.explode(_tokens(F.col(column), own, other)).alias("token"))


def _score(shared: Column, n: Column, t: Column) -> Column:
    norm, target = F.col("norm"), F.col("target")
    return F.greatest(
        F.when(norm == target, F.lit(1.0)).otherwise(F.lit(2.0) * shared / (n + t)),
        F.when(F.contains(target, norm), F.lit(CONTAINED_IN_TARGET)).otherwise(F.lit(0.0)),
        F.when(F.contains(norm, target), F.lit(CONTAINS_TARGET)).otherwise(F.lit(0.0)),
    )


def name_pairs(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Similarity of each distinct ``norm`` to each distinct ``target`` with a score above 0: (norm, target, score).

    Pairs come from shared pieces, and the pieces are counted on the way: all rows of one name leave one task, so the
    count folds there before anything is shuffled. Without a shared piece both the dice score and the containment
    scores are 0, so no pair is missed. All pairs are the result here; for the best few per name, ``best_targets``
    leaves out the pairs that frequent pieces alone would make.
    """
    left = names.select("norm").where(F.col("norm") != "").distinct()
    right = targets.select("target").distinct()
    shared = (
        _pieces(left, "norm", _SHORT_NAME, _SHORT_TARGET, "_n")
        .join(_pieces(right, "target", _SHORT_TARGET, _SHORT_NAME, "_t"), "token")
        .groupBy("norm", "target")
        .agg(
            F.count_if(F.startswith("token", F.lit(_BIGRAM))).alias("_shared"),
            F.first("_n").alias("_n"), F.first("_t").alias("_t"),
        )
    )
    score = _score(F.col("_shared"), F.col("_n"), F.col("_t"))
    return shared.select("norm", "target", score.alias("score")).where(F.col("score") > 0)


def best_targets(wanted: DataFrame, targets: DataFrame, facts: DataFrame, local: Column, k: int, hot: int) -> DataFrame:
    """(norm, ekidata_id, score) with every line that can be among the ``k`` best of a (norm, region), and its exact score.

    ``wanted`` has norm and region, ``targets`` ekidata_id and target, ``facts`` one row per ekidata_id with ord; ``local``
    is true where a line serves the region. A bigram in more than ``hot`` targets is hot and makes no pairs of its own:

    - Names and targets that share any other piece are paired, at most ``hot`` targets per piece.
    - A target inside a name, or a name inside a target, made of hot bigrams only is met under its rarest bigram.
    - What is left shares hot bigrams only, so its score follows from the name's hot bigrams, its size and the region.
      Names that agree in these share one ranking. A line's score there is no higher than its true one and equals it
      where the line was not paired otherwise, so a line beyond its first ``k`` has ``k`` better ones in truth as well.
    """
    posts = _pieces(targets.select("target").distinct(), "target", _SHORT_TARGET, _SHORT_NAME, "_t")
    is_bigram = F.startswith("token", F.lit(_BIGRAM))
    held = posts.groupBy("token").agg(F.count("*").alias("_held"))
    posts = settled(posts.join(held, "token").withColumn("_hot", is_bigram & (F.col("_held") > hot)))
    names = wanted.select("norm").where(F.col("norm") != "").distinct()
    # A name of one character is contained in targets under pieces of its own, and there are only as many as characters.
    pieces = settled(
        _pieces(names, "norm", _SHORT_NAME, _SHORT_TARGET, "_n")
        .join(posts.select("token", "_held", "_hot").distinct(), "token")
        .withColumn("_hot", F.col("_hot") & (F.length("norm") > 1))
    )
    by_token = posts.select("token", "target")
    rarest = lambda df, c, size: (
        df.where(is_bigram).groupBy(c, size).agg(F.min(F.struct("_held", "token")).alias("_rarest"), F.count("*").alias("_all"))
        .where((F.col("_rarest._held") > hot) & (F.col("_all") == F.col(size))).select(c, "_rarest.token")
    )
    paired = pieces.where(~F.col("_hot")).join(by_token, "token").select("norm", "target")
    inside_name = pieces.where("_hot").join(rarest(posts, "target", "_t"), "token").where(F.contains("norm", "target"))
    inside_target = rarest(pieces, "norm", "_n").join(by_token, "token").where(F.contains("target", "norm"))
    met = paired.unionByName(inside_name.select("norm", "target")).unionByName(inside_target.select("norm", "target"))
    met = met.distinct().join(targets, "target").select("norm", "ekidata_id")

    alike = pieces.where("_hot").groupBy("norm", "_n").agg(F.sort_array(F.collect_set("token")).alias("_tokens"))
    alike = alike.join(wanted.select("norm", "region").distinct(), "norm")
    kinds = alike.select("_tokens", "_n", "region").distinct()
    shared = (
        kinds.select("_tokens").distinct().select("_tokens", F.explode("_tokens").alias("token"))
        .join(posts.where("_hot").select("token", "target", "_t"), "token")
        .groupBy("_tokens", "target").agg(F.count("*").alias("_shared"), F.first("_t").alias("_t"))
    )
    kind = ["_tokens", "_n", "region"]
    ranked = (
        kinds.join(shared, "_tokens").join(targets, "target").groupBy(*kind, "ekidata_id")
        .agg(F.max(F.lit(2.0) * F.col("_shared") / (F.col("_n") + F.col("_t"))).alias("score"))
        .join(facts, "ekidata_id")
        .withColumn("score", _boosted(local))
        .withColumn("_rank", F.row_number().over(W.partitionBy(*kind).orderBy(F.desc("score"), F.asc("ord"))))
        .where(F.col("_rank") <= k)
    )
    same = (F.col("a._tokens") == F.col("r._tokens")) & (F.col("a._n") == F.col("r._n")) & F.col("a.region").eqNullSafe(F.col("r.region"))
    listed = alike.alias("a").join(ranked.alias("r"), same).select("a.norm", "r.ekidata_id")

    pairs = met.unionByName(listed).distinct().join(names.withColumn("_grams", bigrams(F.col("norm"))), "norm")
    forms = targets.withColumn("_forms", bigrams(F.col("target")))
    score = _score(F.size(F.array_intersect("_grams", "_forms")), F.size("_grams"), F.size("_forms"))
    scored = pairs.join(forms, "ekidata_id").groupBy("norm", "ekidata_id").agg(F.max(score).alias("score"))
    return scored.where(F.col("score") > 0)


def _boosted(local: Column) -> Column:
    return F.col("score") + F.when(local, F.lit(REGION_BOOST)).otherwise(F.lit(0.0))


def normalised(lines: DataFrame) -> DataFrame:
    """Lines with their comparable name ``norm`` and the folded label ``folded``. Folding runs once per name."""
    names = lines.select("name").distinct()
    folded = names.select("name", F.coalesce(nfkc(F.col("name")), F.lit("")).alias("folded"))
    return lines.join(folded.select("name", "folded", bare_name(F.col("folded")).alias("norm")), "name")


def line_candidates(
    lines: DataFrame, canonical: DataFrame, k: int = CANDIDATES_DEFAULT, areas: DataFrame | None = None, hot: int = HOT_TARGETS
) -> DataFrame:
    """The k most similar canonical lines per (name, region): name, region, ekidata_id, score, rank.

    A candidate whose prefectures lie in the name's region gains a little. Equal scores keep the reference set's order.
    ``hot`` decides how pairs are found, not which.
    """
    wanted = normalised(lines.select("name", "region").distinct())
    # Names are scored against names: many labels fold to one norm and many lines share a target.
    targets = canonical_targets(canonical)
    facts = canonical.select("ekidata_id", "ord")
    local = F.lit(False)
    if areas is not None:
        # Regions a canonical line runs through; a dimension of at most 47 prefectures per line.
        serving = (
            canonical.select("ekidata_id", F.explode("prefectures").alias("province"))
            .join(areas.select("province", F.col("region").alias("_region")), "province")
            .groupBy("ekidata_id")
            .agg(F.collect_set("_region").alias("_regions"))
        )
        facts = facts.join(serving, "ekidata_id", "left")
        local = F.coalesce(F.array_contains("_regions", F.col("region")), F.lit(False))
    scored = best_targets(wanted, targets, facts, local, k, hot)
    pairs = wanted.join(scored, "norm").join(facts, "ekidata_id").withColumn("score", _boosted(local))
    rank = F.row_number().over(W.partitionBy("name", "region").orderBy(F.desc("score"), F.asc("ord")))
    return pairs.select("name", "region", "ekidata_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def rule_decisions(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions that need no outside help: a label without a close candidate that reads like a bus is a bus. All other
    labels stay unknown (``decided`` false) for the caller's decider."""
    best = candidates.groupBy("name", "region").agg(F.max("score").alias("best"))
    rows = normalised(lines.select("name", "region").distinct()).alias("n")
    same = (F.col("n.name") == F.col("b.name")) & F.col("n.region").eqNullSafe(F.col("b.region"))
    joined = rows.join(best.alias("b"), same, "left")
    kind = transit_kind(F.col("folded"), F.col("best"))
    return joined.select(
        "n.name", "n.region", kind.alias("kind"), F.lit(None).cast("string").alias("canonical_id"),
        F.lit(None).cast("string").alias("canonical_name"), (kind == "bus").alias("decided"),
    )


def read_decisions(replies: DataFrame, candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """Decisions from an outside decider's replies (name, region, reply). An id counts only when it was among the
    label's candidates; the shown name is the romaji name, else the kanji name."""
    choice = replies.select("name", "region", parse_choice(F.col("reply")).alias("c")).select("name", "region", "c.*")
    allowed = candidates.select("name", "region", F.col("ekidata_id").alias("canonical_id"), F.lit(True).alias("_ok"))
    label = canonical.select(
        F.col("ekidata_id").alias("canonical_id"),
        F.coalesce(filled(F.col("name_romaji")), filled(F.col("name_kanji"))).alias("canonical_name"),
    )
    a, b = choice.alias("a"), allowed.alias("b")
    same = (
        (F.col("a.name") == F.col("b.name")) & F.col("a.region").eqNullSafe(F.col("b.region"))
        & (F.col("a.canonical_id") == F.col("b.canonical_id"))
    )
    checked = a.join(b, same, "left").select(
        "a.name", "a.region", "kind", F.when(F.col("_ok"), F.col("a.canonical_id")).alias("canonical_id")
    )
    return checked.join(label, "canonical_id", "left").select("name", "region", "kind", "canonical_id", "canonical_name")


def propose(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """One proposal per line: old and new kind and canonical line, whether a bus label loses its translated name, and
    whether anything changes at all. A line that no decision names keeps its canonical line and takes the kind its name
    suggests, or keeps its own kind where the name suggests none."""
    said = decisions.withColumn("_said", F.lit(True)).alias("d")
    same = (F.col("a.name") == F.col("d.name")) & F.col("a.region").eqNullSafe(F.col("d.region"))
    guess = fallback_kind(nfkc(F.col("a.name")))
    kept = F.when(guess == "unknown", F.coalesce("a.kind", guess)).otherwise(guess)
    answered = lambda new, old: F.when(F.col("d._said"), F.col(f"d.{new}")).otherwise(old).alias(new)
    met = lines.alias("a").join(said, same, "left").select(
        F.struct("a.*").alias("a"), F.struct(
            answered("kind", kept), answered("canonical_id", F.col("a.canonical_id")),
            answered("canonical_name", F.col("a.canonical_name") if "canonical_name" in lines.columns else F.lit(None)),
        ).alias("b"),
    )
    clear = F.coalesce(F.col("b.kind") == "bus", F.lit(False)) & F.col("a.translated_name").isNotNull()
    changed = (
        ~F.col("a.kind").eqNullSafe(F.col("b.kind")) | ~F.col("a.canonical_id").eqNullSafe(F.col("b.canonical_id")) | clear
    )
    return met.select(
        "a.id", "a.name", "a.region",
        F.col("a.kind").alias("old_kind"), F.col("b.kind").alias("new_kind"),
        F.col("a.canonical_id").alias("old_canonical_id"), F.col("b.canonical_id").alias("new_canonical_id"),
        F.col("b.canonical_name").alias("new_canonical_name"),
        F.col("a.translated_name").alias("old_translated_name"),
        clear.alias("clear_bus_name"), changed.alias("changed"),
    )


def reconcile_summary(proposals: DataFrame) -> DataFrame:
    """Proposals per new kind: rows, matched, changed and cleared bus names; the total has kind null."""
    return proposals.rollup("new_kind").agg(
        F.count("*").alias("lines"),
        F.count("new_canonical_id").alias("matched"),
        F.count_if("changed").alias("changed"),
        F.count_if("clear_bus_name").alias("bus_cleared"),
    )


def apply_proposals(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """Lines after the changed proposals; lines without one keep their columns."""
    todo = proposals.where("changed").select(
        "id", F.lit(True).alias("_hit"), F.col("new_kind").alias("_kind"), F.col("new_canonical_id").alias("_id"),
        F.col("new_canonical_name").alias("_name"), F.col("clear_bus_name").alias("_clear"),
    )
    new = {"kind": F.col("_kind"), "canonical_id": F.col("_id"), "canonical_name": F.col("_name")}
    column = lambda c: (
        F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new
        else F.when(~F.coalesce("_clear", F.lit(False)), F.col(c)).alias(c) if c == "translated_name"
        else F.col(c)
    )
    return lines.join(todo, "id", "left").select(*[column(c) for c in lines.columns])


def apply_summary(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """Applied, cleared and skipped proposals; one whose line is gone is skipped."""
    here = lines.select("id", F.lit(True).alias("_here"))
    hit = F.col("changed") & F.col("_here").isNotNull()
    return proposals.join(here, "id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("applied"),
        F.count_if(hit & F.col("clear_bus_name")).alias("bus_cleared"),
        F.count_if(F.col("changed") & F.col("_here").isNull()).alias("skipped"),
    )


def line_survivors(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """(id, canonical_id, survivor_id) of every line that shares its canonical line with another. The survivor is named
    like the canonical line, else has the most stations, else the lowest id."""
    counts = stations.groupBy(F.col("train_line_id").alias("id")).agg(F.count("*").alias("_stations"))
    matched = (
        lines.where(F.col("canonical_id").isNotNull())
        .join(counts, "id", "left")
        .select("id", "canonical_id", F.struct(
            F.when(F.col("name") == F.col("canonical_name"), 0).otherwise(1).alias("other_name"),
            (-F.coalesce("_stations", F.lit(0))).alias("fewer"), F.col("id").alias("own"),
        ).alias("_order"))
    )
    # Both figures fold before the shuffle, so a canonical line shared by very many rows is one row per task.
    groups = matched.groupBy("canonical_id").agg(
        F.min_by("id", "_order").alias("survivor_id"), F.count("*").alias("_lines")
    ).where(F.col("_lines") > 1)
    return matched.join(groups, "canonical_id").select("id", "canonical_id", "survivor_id")


@dataclass
class MergedLines:
    line: DataFrame
    station: DataFrame
    link: DataFrame
    plan: DataFrame


def merge_lines(lines: DataFrame, stations: DataFrame, links: DataFrame) -> MergedLines:
    """Lines, stations and building links after duplicate lines moved onto their survivor.

    A station keeps its row unless the survivor's line has one of its name; then its links move to that station. Where
    two moved rows compete, the survivor's own come first, then those of the lower line id. ``plan`` lists each removed
    line with its survivor.
    """
    survivors = line_survivors(lines, stations)
    doomed = survivors.where(F.col("id") != F.col("survivor_id"))
    target = survivors.select(F.col("id").alias("train_line_id"), "survivor_id")
    # Stations and links are many, so their rows carry plain columns; the order is made of them where it is needed.
    moved = stations.join(target, "train_line_id").select("id", "name", "survivor_id", "train_line_id")
    other = (F.col("train_line_id") != F.col("survivor_id")).alias("other")
    winners = moved.groupBy("survivor_id", "name").agg(F.min(F.struct(other, "train_line_id", "id")).alias("_first"))
    winners = winners.select("survivor_id", "name", F.col("_first.id").alias("station_id"))
    stations_map = moved.join(winners, ["survivor_id", "name"]).select("id", "station_id", "survivor_id", "train_line_id")
    kept_stations = (
        stations.join(stations_map.select("id", "station_id", "survivor_id"), "id", "left")
        .where(F.col("station_id").isNull() | (F.col("station_id") == F.col("id")))
        .select(*[
            F.coalesce("survivor_id", c).alias(c) if c == "train_line_id" else F.col(c) for c in stations.columns
        ])
    )
    placed = links.join(
        stations_map.select(F.col("id").alias("station_id"), F.col("station_id").alias("_to"), "survivor_id", "train_line_id"), "station_id", "left"
    )
    # One link per building and station is left of those that moved or were met; which one it is folds before the shuffle. The others are
    # groups by their own id, so that links meet their stations in one join and not in one for each kind.
    rest = [c for c in links.columns if c not in ("building_id", "station_id")]
    own = F.when(F.col("_to").isNull(), F.col("id")).alias("_own")
    kept_links = (
        placed.groupBy("building_id", F.coalesce("_to", "station_id").alias("_at"), own)
        .agg(F.min_by(F.struct(*rest), F.struct(
            (F.col("station_id") != F.col("_to")).alias("moved"), other, "train_line_id", F.col("station_id").alias("station"), "id"
        )).alias("l"))
        .select("building_id", F.col("_at").alias("station_id"), "l.*")
        .select(*links.columns)
    )
    kept_lines = lines.join(doomed.select("id"), "id", "left_anti").select(*lines.columns)
    plan = doomed.select("canonical_id", "survivor_id", F.col("id").alias("removed_id"))
    return MergedLines(kept_lines, kept_stations, kept_links, plan)


def merge_plan_lines(plan: DataFrame, lines: DataFrame) -> DataFrame:
    """The line-merge plan as one readable text per removed line."""
    named = lambda id_column, prefix: lines.select(
        F.col("id").alias(id_column), F.col("name").alias(f"{prefix}_name"), F.col("canonical_name").alias(f"{prefix}_canonical")
    )
    rows = plan.join(named("survivor_id", "kept"), "survivor_id").join(named("removed_id", "removed"), "removed_id")
    text = F.format_string(
        'canonical %s (%s): keep #%d "%s", merge #%d "%s"', "canonical_id",
        F.coalesce("kept_canonical", F.lit("?")), "survivor_id", "kept_name", "removed_id", "removed_name",
    )
    return rows.select("canonical_id", "survivor_id", "removed_id", text.alias("plan"))
