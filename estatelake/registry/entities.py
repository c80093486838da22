"""Entity resolution queries: line names, duplicate lines, duplicate buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.functions.transit import dice
from estatelake.operators import buildings, lines, listings
from estatelake.registry import query
from estatelake.registry.tables import Tables, with_views
from estatelake.session import settled
from estatelake.sources.canonical import merge_canonical

# --- canonical lines and name candidates -----------------------------------------------------------------------------


def canonical_raw(t: Tables):
    """Parts as rows of a reference set: one line per part name, each row adding its type and brand size."""
    return t.raw("part").select(
        F.col("p_name").alias("ekidata_id"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("").alias("code"),
        F.col("p_name").alias("name_kanji"), F.upper("p_name").alias("name_kana"),
        F.when(F.col("p_size") > 30, F.concat_ws(" ", "p_name", F.lit("line"))).otherwise(
            F.when(F.col("p_size") > 15, F.col("p_name"))
        ).alias("name_romaji"),
        F.array(F.concat_ws(" ", F.lower("p_type"), "p_name")).alias("alternative_names"),
        F.array(F.col("p_type")).alias("prefectures"),
    )


_RAW = """SELECT p_name AS id, p_partkey AS ord, CASE WHEN p_size > 40 THEN p_brand ELSE '' END AS code,
    p_name AS kanji, upper(p_name) AS kana, CASE WHEN p_size > 30 THEN p_name || ' line' WHEN p_size > 15 THEN p_name
    ELSE '' END AS romaji, lower(p_type) || ' ' || p_name AS alternative, p_type AS prefecture FROM part"""
_CANON = """SELECT id, min(ord) AS ord, coalesce(arg_min(code, ord) FILTER (code <> ''), '') AS code,
    arg_min(kanji, ord) AS kanji, arg_min(kana, ord) AS kana,
    CASE WHEN arg_min(romaji, ord) NOT IN ('', arg_min(kanji, ord)) THEN arg_min(romaji, ord)
    ELSE coalesce(arg_min(romaji, ord) FILTER (romaji NOT IN ('', kanji)), arg_min(kanji, ord)) END AS romaji
    FROM raw GROUP BY id"""


@query(with_views("", """SELECT c.id AS ekidata_id, c.ord, code, kanji AS name_kanji, kana AS name_kana,
    romaji AS name_romaji, alternatives AS alternative_names, prefectures FROM canon c
    JOIN (SELECT id, string_agg(alternative, '|' ORDER BY first) AS alternatives, string_agg(prefecture, '|' ORDER BY first)
    AS prefectures FROM (SELECT id, alternative, prefecture, min(ord) AS first FROM raw GROUP BY ALL) GROUP BY id) USING (id)""",
    raw=_RAW, canon=_CANON))
def canonical_merge(t: Tables):
    merged = merge_canonical(canonical_raw(t))
    return merged.withColumns({c: F.array_join(c, "|") for c in ("alternative_names", "prefectures")})


def line_rows(t: Tables):
    """Stored lines named brand and part name, one per pair, in a region."""
    return t.raw("part").groupBy(F.concat_ws(" ", "p_brand", "p_name").alias("name")).agg(
        F.min("p_partkey").alias("id"), F.min("p_type").alias("region"), F.min("p_size").alias("size")
    ).select(
        "id", "name", "region", F.when(F.col("size") > 25, F.col("name")).alias("translated_name"),
        F.lit(None).cast("string").alias("operator"), F.when(F.col("size") > 10, "rail").otherwise("unknown").alias("kind"),
        F.when(F.col("size") > 20, F.split_part("name", F.lit(" "), F.lit(2))).alias("canonical_id"),
        F.lit(None).cast("string").alias("canonical_name"),
    )


_LINES = """SELECT min(p_partkey) AS id, p_brand || ' ' || p_name AS name, min(p_type) AS region,
    CASE WHEN min(p_size) > 25 THEN p_brand || ' ' || p_name END AS translated_name,
    CASE WHEN min(p_size) > 10 THEN 'rail' ELSE 'unknown' END AS kind,
    CASE WHEN min(p_size) > 20 THEN split_part(p_brand || ' ' || p_name, ' ', 2) END AS canonical_id
    FROM part GROUP BY p_brand, p_name"""


def _areas(t: Tables):
    """Every part type is a region that serves its own and the following type."""
    return t.raw("part").select(F.col("p_type").alias("province"), F.col("p_type").alias("region")).distinct()


def canonical(t: Tables):
    return settled(merge_canonical(canonical_raw(t)))


def _candidates(t: Tables, k: int = 15):
    return lines.line_candidates(line_rows(t), canonical(t), k, _areas(t))


_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 2)))"
_SCORED = f"""SELECT norm, id, max(greatest(CASE WHEN norm = target THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(ng, tg)) / (len(ng) + len(tg)) END,
    CASE WHEN contains(target, norm) THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN contains(norm, target) THEN 0.8::DOUBLE ELSE 0 END)) AS score
    FROM (SELECT *, {_GRAMS.format('norm')} AS ng FROM (SELECT DISTINCT regexp_replace(name, '\\s+', '', 'g') AS norm FROM lines))
    CROSS JOIN (SELECT *, {_GRAMS.format('target')} AS tg FROM (SELECT DISTINCT id, unnest([kanji, kana, alternative]) AS target FROM raw))
    GROUP BY norm, id"""
_RANKED = """SELECT name, region, id AS ekidata_id, round(boosted, 9) AS score,
    CAST(row_number() OVER (PARTITION BY name, region ORDER BY boosted DESC, ord) AS INTEGER) AS rank
    FROM (SELECT l.name, l.region, s.id, c.ord, s.score + CASE WHEN EXISTS (SELECT 1 FROM raw WHERE raw.id = s.id
        AND raw.prefecture = l.region) THEN 0.05::DOUBLE ELSE 0 END AS boosted
    FROM lines l JOIN scored s ON norm = regexp_replace(name, '\\s+', '', 'g') JOIN canon c ON c.id = s.id WHERE s.score > 0)"""
_MATCHED = dict(raw=_RAW, canon=_CANON, lines=_LINES, scored=_SCORED, ranked=_RANKED)


@query(with_views("", "SELECT * FROM ranked WHERE rank <= 15", **_MATCHED))
def name_candidates(t: Tables):
    return _candidates(t).withColumn("score", F.round("score", 9))


_HOT = _MATCHED | dict(
    raw=_RAW.replace("p_name AS kanji", "p_name || 'qz' AS kanji"), lines=_LINES.replace("p_brand || ' ' || p_name AS name", "p_brand || ' ' || p_name || 'qz' AS name")
)


@query(with_views("", "SELECT * FROM ranked WHERE rank <= 5", **_HOT))
def hot_name_candidates(t: Tables):
    """One bigram is in every label and in a form of every canonical line."""
    raw = canonical_raw(t).withColumn("name_kanji", F.concat("name_kanji", F.lit("qz")))
    labels = line_rows(t).withColumn("name", F.concat("name", F.lit("qz")))
    found = lines.line_candidates(labels, settled(merge_canonical(raw)), 5, _areas(t), hot=4)
    return found.withColumn("score", F.round("score", 9))


@query(f"""SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(a, b))
    / (len(a) + len(b)) END, 9) AS score FROM (SELECT p_partkey, p_name, p_type, {_GRAMS.format('p_name')} AS a,
    {_GRAMS.format("lower(p_type)")} AS b FROM part)""")
def name_dice(t: Tables):
    return t.raw("part").select("p_partkey", F.round(dice(F.col("p_name"), F.lower("p_type")), 9).alias("score"))


def _decisions(t: Tables):
    """Replies that choose the second candidate for rail names and the best for the rest; some are no usable reply."""
    found = settled(_candidates(t))
    choice = found.where(F.col("rank") == F.when(F.length("name") % 2 == 0, 1).otherwise(2))
    kind = F.when(F.contains("name", F.lit("ring")), "bus").when(F.contains("name", F.lit("gear")), "hovercraft").otherwise("subway")
    reply = F.format_string('```json\n{"kind": "%s", "canonical_id": "%s"}\n```', kind, F.concat(
        "ekidata_id", F.when(F.contains("name", F.lit("bolt")), "x").otherwise("")
    ))
    return lines.read_decisions(
        choice.select("name", "region", reply.alias("reply")), found, canonical(t)
    )


def _proposals(t: Tables):
    return lines.propose(line_rows(t), _decisions(t))


_CHOSEN = """SELECT name, region, CASE WHEN contains(name, 'ring') THEN 'bus' WHEN contains(name, 'gear') THEN 'unknown'
    ELSE 'subway' END AS kind, CASE WHEN NOT contains(name, 'ring') AND NOT contains(name, 'gear') AND NOT contains(name, 'bolt')
    THEN ekidata_id END AS canonical_id FROM ranked WHERE rank = CASE WHEN length(name) % 2 = 0 THEN 1 ELSE 2 END"""
# A line without a reply keeps its canonical line and, as no name here is a bus name, its kind.
_PROPOSED = """SELECT *, new_kind = 'bus' AND old_translated_name IS NOT NULL AS clear_bus_name, old_kind IS DISTINCT FROM new_kind OR
    old_canonical_id IS DISTINCT FROM new_canonical_id OR (new_kind = 'bus' AND old_translated_name IS NOT NULL) AS changed
    FROM (SELECT l.id, l.name, l.region, l.kind AS old_kind, CASE WHEN d.name IS NULL THEN coalesce(l.kind, 'unknown') ELSE d.kind END AS new_kind,
    l.canonical_id AS old_canonical_id, CASE WHEN d.name IS NULL THEN l.canonical_id ELSE d.canonical_id END AS new_canonical_id,
    CASE WHEN d.name IS NOT NULL THEN c.romaji END AS new_canonical_name, l.translated_name AS old_translated_name
    FROM lines l LEFT JOIN {chosen} d ON l.name = d.name AND l.region = d.region LEFT JOIN canon c ON c.id = d.canonical_id)"""
_ANSWERED = "(SELECT * FROM chosen WHERE length(name) % 3 > 0)"
_RESOLVED = dict(_MATCHED, chosen=_CHOSEN, proposed=_PROPOSED.format(chosen="chosen"))


@query(with_views("", "SELECT * FROM proposed", **dict(_MATCHED, chosen=_CHOSEN, proposed=_PROPOSED.format(chosen=_ANSWERED))))
def proposals_without_reply(t: Tables):
    """Proposals where the decider answered for two names in three."""
    return lines.propose(line_rows(t), _decisions(t).where(F.length("name") % 3 > 0))


@query(with_views("", "SELECT * FROM proposed", **_RESOLVED))
def line_proposals(t: Tables):
    return _proposals(t)


@query(with_views("", """SELECT new_kind, count(*) AS lines, count(new_canonical_id) AS matched, count(*) FILTER (changed)
    AS changed, count(*) FILTER (clear_bus_name) AS bus_cleared FROM proposed GROUP BY ROLLUP (new_kind)""", **_RESOLVED))
def reconcile_summary(t: Tables):
    return lines.reconcile_summary(_proposals(t))


@query(with_views("", "SELECT id, name, changed FROM proposed ORDER BY changed DESC, id LIMIT 50 OFFSET 50", **_RESOLVED))
def proposal_page(t: Tables):
    return listings.proposal_page(_proposals(t), 2).select("id", "name", "changed")


@query(with_views("", """SELECT l.id, coalesce(p.new_kind, l.kind) AS kind, CASE WHEN p.id IS NULL THEN l.canonical_id
    ELSE new_canonical_id END AS canonical_id, new_canonical_name AS canonical_name, CASE WHEN NOT coalesce(clear_bus_name, FALSE)
    THEN l.translated_name END AS translated_name FROM lines l LEFT JOIN (SELECT * FROM proposed WHERE changed) p ON p.id = l.id""",
    **_RESOLVED))
def applied_proposals(t: Tables):
    after = lines.apply_proposals(line_rows(t), _proposals(t))
    return after.select("id", "kind", "canonical_id", "canonical_name", "translated_name")


@query(with_views("", """SELECT count(*) AS total, count(*) FILTER (changed AND kept) AS applied, count(*) FILTER (changed AND kept
    AND clear_bus_name) AS bus_cleared, count(*) FILTER (changed AND NOT kept) AS skipped FROM (SELECT *, region <> 'ECONOMY' AS kept
    FROM proposed)""", **_RESOLVED))
def apply_summary(t: Tables):
    """Applied after the lines of one region are gone."""
    left = line_rows(t).where(F.col("region") != "ECONOMY")
    return lines.apply_summary(left, _proposals(t))


@query(with_views("", "SELECT count(*) AS total, count(*) FILTER (changed) AS changed_total FROM proposed", **_RESOLVED))
def proposal_totals(t: Tables):
    return listings.proposal_totals(_proposals(t))


@query(with_views("", "SELECT id, new_kind FROM proposed WHERE changed", **_RESOLVED))
def changed_proposals(t: Tables):
    from estatelake.operators.filters import changed_only

    return changed_only(_proposals(t)).select("id", "new_kind")


@query(with_views("", "SELECT id, name FROM lines ORDER BY id LIMIT 20", lines=_LINES))
def sample_lines(t: Tables):
    return listings.first_lines(line_rows(t), 20).select("id", "name")


@query(with_views("", """SELECT name || CASE WHEN region = 'ECONOMY' THEN '行' ELSE '' END AS name, CASE WHEN region = 'ECONOMY' AND best < 0.55
    THEN 'bus' ELSE 'unknown' END AS kind, region = 'ECONOMY' AND best < 0.55 AS decided FROM (SELECT l.name, l.region, max(score) AS best
    FROM lines l LEFT JOIN ranked r ON r.name = l.name AND r.region = l.region GROUP BY l.name, l.region)""", **_MATCHED))
def rule_decisions(t: Tables):
    """Labels of one region end in a destination mark, which marks a bus unless a canonical line is close."""
    mark = F.when(F.col("region") == "ECONOMY", "行").otherwise("")
    labelled = line_rows(t).withColumn("name", F.concat("name", mark))
    found = settled(lines.line_candidates(labelled, canonical(t), 15, _areas(t)))
    return lines.rule_decisions(labelled, found).select("name", "kind", "decided")


# --- duplicate lines -------------------------------------------------------------------------------------------------


def _dup_lines(t: Tables):
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.concat_ws("-", "p_name", "p_size").alias("name"),
        F.when(F.col("p_size") > 2, F.col("p_brand")).alias("canonical_id"), F.lit("small ring-17").alias("canonical_name"),
    )


def _dup_stations(t: Tables):
    pairs = t.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("name"),
        F.col("l_partkey").alias("train_line_id"),
    )


def _dup_links(t: Tables):
    return t.raw("lineitem").groupBy(
        F.col("l_orderkey").alias("building_id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("station_id")
    ).agg(F.min("l_linenumber").alias("walking_minutes")).select(
        (F.col("building_id") * 10_000_000_000 + F.col("station_id")).alias("id"), "building_id", "station_id", "walking_minutes"
    )


_DUP = dict(
    dlines="""SELECT p_partkey AS id, p_name || '-' || p_size AS name, CASE WHEN p_size > 2 THEN p_brand END AS canonical_id
    FROM part""",
    dstations="""SELECT DISTINCT l_partkey * 100000 + l_suppkey AS id, 's' || l_suppkey AS name, l_partkey AS train_line_id
    FROM lineitem""",
    dlinks="""SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey AS id, l_orderkey AS building_id,
    l_partkey * 100000 + l_suppkey AS station_id, min(l_linenumber) AS walking_minutes FROM lineitem GROUP BY 1, 2, 3""",
    survivors="""SELECT id, canonical_id, first_value(id) OVER (PARTITION BY canonical_id ORDER BY name = 'small ring-17' DESC,
    coalesce(n, 0) DESC, id) AS survivor_id FROM dlines LEFT JOIN (SELECT train_line_id, count(*) AS n FROM dstations GROUP BY 1)
    ON train_line_id = id WHERE canonical_id IN (SELECT canonical_id FROM dlines WHERE canonical_id IS NOT NULL
    GROUP BY 1 HAVING count(*) > 1)""",
    placed="""SELECT s.id, s.name, s.train_line_id, v.survivor_id, CASE WHEN v.survivor_id IS NULL THEN s.id ELSE
    first_value(s.id) OVER (PARTITION BY v.survivor_id, CASE WHEN v.survivor_id IS NULL THEN s.train_line_id END, s.name ORDER BY
    s.train_line_id <> v.survivor_id, s.train_line_id, s.id) END AS target FROM dstations s LEFT JOIN survivors v ON v.id = s.train_line_id""",
)


@query(with_views("", "SELECT * FROM survivors", **_DUP))
def line_survivors(t: Tables):
    return lines.line_survivors(_dup_lines(t), _dup_stations(t))


def _merged_lines(t: Tables):
    return lines.merge_lines(_dup_lines(t), _dup_stations(t), _dup_links(t))


@query(with_views("", "SELECT id, name FROM dlines WHERE id NOT IN (SELECT id FROM survivors WHERE id <> survivor_id)", **_DUP))
def merged_lines(t: Tables):
    return _merged_lines(t).line.select("id", "name")


@query(with_views("", """SELECT id, name, coalesce(survivor_id, train_line_id) AS train_line_id FROM placed
    WHERE target = id""", **_DUP))
def merged_stations(t: Tables):
    return _merged_lines(t).station


@query(with_views("", """SELECT id, building_id, target AS station_id, walking_minutes FROM (SELECT l.*, p.target, row_number() OVER
    (PARTITION BY l.building_id, p.target ORDER BY p.id <> p.target, p.train_line_id <> coalesce(p.survivor_id, p.train_line_id),
    p.train_line_id, p.id, l.id) AS n FROM dlinks l JOIN placed p ON p.id = l.station_id) WHERE n = 1""", **_DUP))
def merged_station_links(t: Tables):
    return _merged_lines(t).link


@query(with_views("", """SELECT v.canonical_id, v.survivor_id, v.id AS removed_id, 'canonical ' || v.canonical_id || ' (small ring-17): keep #'
    || v.survivor_id || ' "' || k.name || '", merge #' || v.id || ' "' || r.name || '"' AS plan FROM survivors v JOIN dlines k
    ON k.id = v.survivor_id JOIN dlines r ON r.id = v.id WHERE v.id <> v.survivor_id""", **_DUP))
def line_merge_plan(t: Tables):
    return lines.merge_plan_lines(_merged_lines(t).plan, _dup_lines(t))


# --- duplicate buildings ---------------------------------------------------------------------------------------------


def listed(t: Tables, complete: bool = True):
    """Line items on list pages under their customer's building; rows marked N are not listed. The incomplete listing is
    what pages show at a later time."""
    owner = t.raw("orders").select("o_orderkey", "o_custkey")
    rows = t.raw("lineitem").where(F.col("l_returnflag") != "N")
    if not complete:
        rows = rows.where(F.col("l_discount") < 0.08)
    return rows.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_key"),
        F.concat(F.lit("building-"), "o_custkey", F.lit("-"), "l_linestatus").alias("building_key"),
    )


def stored_units(t: Tables):
    return t.raw("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"), F.col("l_orderkey").alias("building_id")
    ).distinct()


def stored_buildings(t: Tables):
    """Orders stored under numbers, and some customers' buildings stored under their building key."""
    keyed = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        (-F.col("c_custkey") - 1).alias("id"), F.concat(F.lit("building-"), "c_custkey", F.lit("-O")).alias("source_id")
    )
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("source_id")
    ).unionByName(keyed)


_BUILD = dict(
    listed="""SELECT l_orderkey || '-' || l_linenumber AS unit_key, 'building-' || o_custkey || '-' || l_linestatus AS building_key,
    l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'""",
    stored="""SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS source_id FROM orders UNION ALL SELECT -c_custkey - 1,
    'building-' || c_custkey || '-O' FROM customer WHERE c_mktsegment = 'BUILDING'""",
    units="SELECT DISTINCT l_orderkey || '-' || l_linenumber AS source_id, l_orderkey AS building_id FROM lineitem",
    idx="""SELECT unit_key, CASE WHEN count(DISTINCT building_key) = 1 THEN min(building_key) END AS building_key FROM listed
    GROUP BY unit_key""",
    idx2="""SELECT unit_key, CASE WHEN count(DISTINCT building_key) = 1 THEN min(building_key) END AS building_key FROM listed
    WHERE l_discount < 0.08 GROUP BY unit_key""",
)
_VERDICT = """SELECT s.id AS building_id, count(u.source_id) AS unit_count, CASE WHEN count(u.source_id) = 0 THEN 'no-units'
    WHEN count(*) FILTER (i.unit_key IS NOT NULL AND i.building_key IS NULL) > 0 THEN 'ambiguous-unit'
    WHEN count(DISTINCT i.building_key) > 1 THEN 'mixed-buildings'
    WHEN count(*) FILTER (i.unit_key IS NULL) > 0 THEN 'uncovered-unit' ELSE 'merge' END AS verdict, min(i.building_key) AS low
    FROM stored s LEFT JOIN units u ON u.building_id = s.id LEFT JOIN {idx} i ON i.unit_key = u.source_id
    WHERE s.source_id NOT LIKE 'building-%' GROUP BY s.id"""
_BUILD["verdicts"] = _VERDICT.format(idx="idx")
_BUILD["later"] = _VERDICT.format(idx="idx2")
_BUILD["plan"] = """SELECT low AS building_key, s.id AS keep_id, v.building_id AS source_id, unit_count FROM verdicts v
    LEFT JOIN stored s ON s.source_id = v.low WHERE verdict = 'merge'"""


@query(with_views("", "SELECT unit_key, building_key FROM idx", **_BUILD))
def unit_key_index(t: Tables):
    return buildings.unit_key_index(listed(t))


@query(with_views("", """SELECT building_id, unit_count, verdict, CASE WHEN verdict = 'merge' THEN low END AS building_key
    FROM verdicts""", **_BUILD))
def classified_buildings(t: Tables):
    from estatelake.operators.filters import legacy_buildings

    return buildings.classify_buildings(legacy_buildings(stored_buildings(t)), stored_units(t), buildings.unit_key_index(listed(t)))


@query(with_views("", "SELECT verdict, count(*) AS buildings FROM verdicts WHERE verdict <> 'merge' GROUP BY verdict", **_BUILD))
def skipped_buildings(t: Tables):
    return buildings.skip_counts(classified_buildings(t))


def _plan(t: Tables):
    return buildings.plan_building_merges(stored_buildings(t), stored_units(t), listed(t))


@query(with_views("", "SELECT * FROM plan", **_BUILD))
def building_merge_plan(t: Tables):
    return _plan(t)


@query(with_views("", """SELECT count(*) AS groups, count(keep) AS kept_existing, CAST(coalesce(sum(n), 0) AS BIGINT) AS source_rows,
    CAST(coalesce(sum(n), 0) - (count(*) - count(keep)) AS BIGINT) AS rows_removed, CAST(coalesce(sum(u), 0) AS BIGINT) AS units
    FROM (SELECT building_key, count(*) AS n, max(keep_id) AS keep, sum(unit_count) AS u FROM plan GROUP BY 1)""", **_BUILD))
def building_merge_totals(t: Tables):
    return buildings.plan_totals(_plan(t))


@query(with_views("", """SELECT building_key, coalesce(max(keep_id), arg_min(source_id, (-unit_count, source_id))) AS target_id,
    max(keep_id) IS NOT NULL AS existing FROM plan GROUP BY building_key""", **_BUILD))
def building_keepers(t: Tables):
    return buildings.building_keepers(_plan(t))


def _station_links(t: Tables):
    lines_ = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("building_id"), F.col("l_suppkey").alias("station_id")).agg(
        F.min("l_linenumber").alias("walking_minutes")
    )
    keyed = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        (-F.col("c_custkey") - 1).alias("building_id"), F.lit(3).cast("long").alias("station_id"), F.lit(77).alias("walking_minutes")
    )
    return lines_.unionByName(keyed).select(
        (F.col("building_id") * 100_000 + F.col("station_id")).alias("id"), "building_id", "station_id", "walking_minutes"
    )


def _applied(t: Tables):
    return buildings.apply_building_merges(
        _plan(t), buildings.unit_key_index(listed(t, complete=False)), stored_buildings(t), stored_units(t), _station_links(t)
    )


_APPLY = dict(
    _BUILD,
    links="""SELECT building_id * 100000 + station_id AS id, * FROM (SELECT l_orderkey AS building_id, l_suppkey AS station_id,
    min(l_linenumber) AS walking_minutes FROM lineitem GROUP BY 1, 2 UNION ALL SELECT -c_custkey - 1, 3, 77 FROM customer
    WHERE c_mktsegment = 'BUILDING')""",
    grp="""SELECT p.building_key, bool_and(coalesce(v.verdict = 'merge' AND v.low = p.building_key, FALSE)) AS fits FROM plan p
    LEFT JOIN later v ON v.building_id = p.source_id GROUP BY 1""",
    cur="SELECT p.* FROM plan p JOIN grp USING (building_key) WHERE fits",
    aim="""SELECT building_key, coalesce(max(keep_id), arg_min(source_id, (-unit_count, source_id))) AS target_id,
    max(keep_id) IS NULL AS fresh FROM cur GROUP BY 1""",
    mov="SELECT building_key, source_id, target_id FROM cur JOIN aim USING (building_key) WHERE source_id <> target_id",
    ranked="""SELECT l.*, coalesce(m.target_id, l.building_id) AS to_id, row_number() OVER (PARTITION BY coalesce(m.target_id,
    l.building_id), l.station_id ORDER BY m.target_id IS NOT NULL, l.building_id, l.id) AS n FROM links l LEFT JOIN mov m
    ON m.source_id = l.building_id""",
)


@query(with_views("", """SELECT id, CASE WHEN fresh THEN building_key ELSE source_id END AS source_id FROM stored LEFT JOIN aim
    ON target_id = id WHERE id NOT IN (SELECT source_id FROM mov)""", **_APPLY))
def merged_buildings(t: Tables):
    return _applied(t).building


@query(with_views("", """SELECT u.source_id, coalesce(target_id, building_id) AS building_id FROM units u LEFT JOIN mov m
    ON m.source_id = u.building_id""", **_APPLY))
def merged_building_units(t: Tables):
    return _applied(t).unit


@query(with_views("", "SELECT id, to_id AS building_id, station_id, walking_minutes FROM ranked WHERE n = 1", **_APPLY))
def merged_building_links(t: Tables):
    return _applied(t).link


@query(with_views("", """SELECT building_key, CASE WHEN fits THEN 'merged' ELSE 'changed' END AS outcome,
    (SELECT count(*) FROM mov WHERE mov.building_key = grp.building_key) AS rows_removed,
    (SELECT count(*) FROM mov JOIN units ON building_id = mov.source_id WHERE mov.building_key = grp.building_key) AS units_moved,
    (SELECT count(*) FROM mov JOIN ranked ON building_id = mov.source_id WHERE n = 1 AND mov.building_key = grp.building_key) AS stations_moved,
    (SELECT count(*) FROM mov JOIN ranked ON building_id = mov.source_id WHERE n > 1 AND mov.building_key = grp.building_key) AS stations_dropped
    FROM grp""", **_APPLY))
def building_merge_outcome(t: Tables):
    return _applied(t).outcome
