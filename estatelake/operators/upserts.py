"""Snapshot-to-snapshot writes: old tables and one batch in, new tables and history rows out.

Every function is pure. Both sides of each full outer join hold one row per key, so no key is heavier than another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.functions.text import filled, name_key
from estatelake.functions.urls import without_query
from estatelake.operators.filters import keyed_buildings, legacy_buildings
from estatelake.operators.ordered import with_new_ids, with_previous
from estatelake.session import settled, stored


@dataclass
class Upsert:
    """``snapshot`` is the table after the batch, ``history`` the rows to append to its change log, and ``classified``
    one row per batch key with the status it counts as (``metric_status``) and the write it caused
    (``write_status``). ``sightings`` has the status of every row of the batch (key, ordinal, metric_status). ``rejected`` are
    the rows of the batch without a key, which belong to no row of the table. ``changes`` has the stored and the new row
    (``before``, ``after``, either null) of every key that was written."""

    snapshot: DataFrame
    history: DataFrame | None
    classified: DataFrame
    sightings: DataFrame
    rejected: DataFrame
    changes: DataFrame


@dataclass
class _Batch:
    """A batch by key: rows of keys met once, and rows of keys met several times with ``_before``, the values of the row of the key
    before it (the stored ones for the first, null for the first of a new key)."""

    once: DataFrame
    many: DataFrame
    rejected: DataFrame


def _by_key(snapshot: DataFrame, batch: DataFrame, key: str, values: list[str]) -> _Batch:
    """Rows of a key count in the order of ``ordinal``, those without one first, ties by ``values`` and then by the whole row, so
    any batch has one order. Only keys met several times are put in order; the others meet their stored row in the join that
    is made for them anyway. A key met very often is cut into slices of its ordinals, so it does not fill one task.
    """
    whole = F.xxhash64(*[F.col(f.name) for f in batch.schema.fields if "map<" not in f.dataType.simpleString()])
    if "ordinal" not in batch.columns:
        batch = batch.withColumn("ordinal", F.lit(0))
    keyed = batch.where(F.col(key).isNotNull())
    repeated = keyed.groupBy(key).count().where("count > 1").select(key)
    kind = batch.schema["ordinal"].dataType
    slices = F.col(f"ordinal.{kind.names[0]}") if hasattr(kind, "names") else F.floor(F.col("ordinal") / 1024)
    place = F.struct(F.col("ordinal").isNotNull().alias("known"), "ordinal", *values, whole.alias("row"))
    many = keyed.join(repeated, key, "left_semi").withColumn("_place", place)
    rows = with_previous(many, [key], ["_place"], values, slices, "_previous")
    stored = snapshot.select(F.col(key).alias("_stored_key"), F.struct(*values).alias("_stored"))
    rows = rows.join(stored, F.col(key) == F.col("_stored_key"), "left").withColumn("_before", F.coalesce("_previous", "_stored"))
    return _Batch(keyed.join(repeated, key, "left_anti"), rows.drop("_previous", "_stored_key", "_stored"), batch.where(F.col(key).isNull()))


def _changed(values: list[str]) -> Column:
    """Whether a sighted row differs from what was known before it. Texts may be missing or empty alike."""
    differs = F.lit(False)
    for c in values:
        differs = differs | _differs(f"_before.{c}", c, text=c.endswith("_text"))
    return F.col("_before").isNotNull() & differs


def _coming(met: _Batch, many: DataFrame, key: str) -> DataFrame:
    """One row per key, as it was met last, with ``_moved``: whether any row of a key met several times changed an amount
    (column ``_step`` of ``many``); null for keys met once."""
    own = met.once.columns
    last = many.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(F.struct(*own), F.col("_place")).alias("_row"), F.bool_or("_step").alias("_moved")
    )
    return met.once.withColumn("_moved", F.lit(None).cast("boolean")).unionByName(last.select("_row.*", "_moved"))


def _ids(snapshot: DataFrame, inserted: DataFrame, key: str, name: str) -> DataFrame:
    return snapshot.select(F.col("id").alias(name), key).unionByName(inserted.select(F.col("id").alias(name), key))


def _changes(snapshot: DataFrame, rows: DataFrame, kept: list[Column], inserted: DataFrame, key: str) -> DataFrame:
    """(before, after) of the rows that a batch wrote."""
    row = F.struct(*snapshot.columns)
    moved = rows.where(F.col("_write").isin("price", "place")).select(F.struct("s.*").alias("before"), F.struct(*kept).alias("after"))
    new = inserted.select(F.lit(None).cast(snapshot.select(row.alias("r")).schema["r"].dataType).alias("before"), row.alias("after"))
    return moved.unionByName(new)


def repeated_keys(batch: DataFrame, key: str) -> DataFrame:
    """Number of rows a batch holds beyond one per key."""
    return batch.agg((F.count("*") - F.count_distinct(key)).alias("repeated"))


def _differs(a: str, b: str, text: bool = False) -> Column:
    left, right = F.col(a), F.col(b)
    if text:
        left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    return ~left.eqNullSafe(right)


def _sides(snapshot: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored row ``s`` and incoming row ``b`` of each key, either one null."""
    stored = snapshot.select(F.col(key).alias("_key"), F.struct(*snapshot.columns).alias("s"))
    coming = batch.select(F.col(key).alias("_key"), F.struct(*batch.columns).alias("b"))
    return stored.join(coming, "_key", "full_outer")


def _insert(columns: list[str], batch_columns: list[str], stamp: Column, stamps: tuple[str, ...]) -> list[Column]:
    out = []
    for c in columns:
        if c in stamps:
            out.append(stamp.alias(c))
        elif c in batch_columns:
            out.append(F.col(f"b.{c}").alias(c))
        elif c != "id":
            out.append(F.lit(None).alias(c))
    return out


def _cast_like(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def upsert_listings(
    snapshot: DataFrame, batch: DataFrame, as_of: Column, baseline: bool = False, highest: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Upsert:
    """For-sale listings by ``source_id``. New rows take ids above ``highest`` (by default the highest of ``snapshot``). ``keep`` stores
    rows that several outputs are made from, for a caller that writes more than one of them.

    A new listing is inserted without a history row (``baseline`` adds one). A changed price or price text updates the
    price and place columns, the type and ``last_updated``, and logs the new price. A changed section or place alone
    updates those columns and leaves ``last_updated``. Empty and missing price texts are the same text. A key met several
    times in a batch is stored as it was met last, and every change of price between its rows is logged.
    """
    met = _by_key(snapshot, batch, "source_id", ["price", "price_text", "region", "province"])
    step, moved_place = _changed(["price", "price_text"]), _changed(["region", "province"])
    status = F.when(F.col("_before").isNull(), "new").when(step | moved_place, "updated").otherwise("unchanged")
    many = keep(met.many.withColumns({"_step": step, "_status": status}))
    coming = _coming(met, many, "source_id")
    both = _sides(snapshot, coming, "source_id")
    known = F.col("s").isNotNull() & F.col("b").isNotNull()
    price = F.coalesce("b._moved", known & (_differs("s.price", "b.price") | _differs("s.price_text", "b.price_text", text=True)))
    place = _differs("s.region", "b.region") | _differs("s.province", "b.province")
    section = _differs("s.section_type", "b.section_type")
    write = (
        F.when(F.col("b").isNull(), "absent")
        .when(F.col("s").isNull(), "insert")
        .when(price, "price")
        .when(section | place, "place")
        .otherwise("keep")
    )
    rows = keep(both.withColumn("_write", write))

    priced = ("price", "price_text")
    placed = tuple(c for c in ("section_type", "property_type", "region", "province") if c in coming.columns)

    def updated(c: str) -> Column:
        stored = F.col(f"s.{c}")
        if c in priced:
            value = filled(F.col(f"b.{c}")) if c == "price_text" else F.col(f"b.{c}")
            return F.when(F.col("_write") == "price", value).otherwise(stored).alias(c)
        if c in placed:
            return F.when(F.col("_write").isin("price", "place"), F.col(f"b.{c}")).otherwise(stored).alias(c)
        if c == "last_updated":
            return F.when(F.col("_write") == "price", as_of).otherwise(stored).alias(c)
        return stored.alias(c)

    kept = rows.where(F.col("s").isNotNull()).select(*[updated(c) for c in snapshot.columns])
    inserted = keep(_cast_like(with_new_ids(
        rows.where(F.col("_write") == "insert").select(
            *_insert(snapshot.columns, coming.columns, as_of, ("last_updated",))
        ),
        snapshot,
        "source_id",
        highest=highest,
    ), snapshot))
    after = kept.unionByName(inserted)
    once = F.col("b._moved").isNull()
    text = lambda c: filled(F.col(c)).alias("price_text")
    moved = rows.where(once & (F.col("_write") == "price")).select(
        F.col("s.id").alias("property_id"), "b.price", text("b.price_text"), as_of.alias("recorded_at")
    ).unionByName(many.where("_step").join(_ids(snapshot, inserted, "source_id", "property_id"), "source_id").select(
        "property_id", "price", text("price_text"), as_of.alias("recorded_at")
    ))
    if baseline:
        moved = moved.unionByName(
            inserted.select(F.col("id").alias("property_id"), "price", "price_text", as_of.alias("recorded_at"))
        )
    metric = (
        F.when(~known, "new").when(price | place, "updated").otherwise("unchanged")
    )
    classified = rows.where(F.col("b").isNotNull()).select(
        F.col("_key").alias("source_id"), metric.alias("metric_status"), F.col("_write").alias("write_status")
    )
    seen = rows.where(once & F.col("b").isNotNull()).select("b.source_id", "b.ordinal", metric.alias("metric_status"))
    sightings = seen.unionByName(many.select("source_id", "ordinal", F.col("_status").alias("metric_status")))
    changes = _changes(snapshot, rows, [updated(c) for c in snapshot.columns], inserted, "source_id")
    return Upsert(after, moved, classified, sightings, met.rejected, changes)


def first_seen_buildings(units: DataFrame, order: list[str]) -> DataFrame:
    """One row per building key with the attributes of the first unit that names it; the URL loses its query."""
    names = {
        "building_key": "source_id", "url": "url", "building_type": "building_type", "building_title": "title",
        "building_address": "address", "building_age": "age", "building_floors": "floors",
        "building_image_url": "main_image_url", "stations": "stations", "region": "region", "province": "province",
        "postal_code": "postal_code", "state": "state", "city": "city", "district": "district",
    }
    here = {c: n for c, n in names.items() if c in units.columns and c != "building_key"}
    value = lambda c: without_query(F.col(c)) if c == "url" else F.col(c)
    head = F.min_by(F.struct(*[value(c).alias(n) for c, n in here.items()]), F.struct(*order))
    return (
        keyed_buildings(units)
        .groupBy(F.col("building_key").alias("source_id"))
        .agg(head.alias("_head"))
        .select("source_id", "_head.*")
    )


def rekey_buildings(batch_units: DataFrame, units: DataFrame, buildings: DataFrame) -> DataFrame:
    """Stored buildings after those still keyed by a unit's id take the building key their unit is now listed under.

    A key that is taken stays with its building; a building takes one key and a key goes to one building, the lowest
    unit id deciding in both directions.
    """
    listed = keyed_buildings(batch_units).select(F.col("source_id").alias("unit_key"), "building_key").distinct()
    taken = buildings.select(F.col("source_id").alias("building_key"))
    held = units.select(F.col("source_id").alias("unit_key"), F.col("id").alias("unit_id"), F.col("building_id"))
    old = legacy_buildings(buildings).select(F.col("id").alias("building_id"))
    offers = (
        listed.join(taken, "building_key", "left_anti").join(held, "unit_key").join(old, "building_id", "left_semi")
    )
    # Folding to one offer per (building, key) first keeps a building with many units to a few rows.
    folded = offers.groupBy("building_id", "building_key").agg(F.min("unit_id").alias("unit_id"))
    by_building = folded.groupBy("building_id").agg(
        F.min_by(F.struct("building_key", "unit_id"), F.struct("unit_id", "building_key")).alias("o")
    ).select("building_id", "o.*")
    chosen = by_building.groupBy("building_key").agg(
        F.min_by("building_id", F.struct("unit_id", "building_id")).alias("id")
    )
    return buildings.join(chosen, "id", "left").select(
        *[F.coalesce("building_key", c).alias(c) if c == "source_id" else F.col(c) for c in buildings.columns]
    )


def upsert_buildings(snapshot: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """Buildings by key: new ones take their first-seen attributes, known ones only ``last_updated``."""
    both = _sides(snapshot, seen, "source_id")
    touched = F.when(F.col("b").isNotNull(), as_of).otherwise(F.col("s.last_updated")).alias("last_updated")
    kept = both.where(F.col("s").isNotNull()).select(
        *[touched if c == "last_updated" else F.col(f"s.{c}").alias(c) for c in snapshot.columns]
    )
    inserted = with_new_ids(
        both.where(F.col("s").isNull()).select(
            *_insert(snapshot.columns, seen.columns, as_of, ("insert_date", "last_updated"))
        ),
        snapshot,
        "source_id",
    )
    return kept.unionByName(_cast_like(inserted, snapshot))


def upsert_units(
    snapshot: DataFrame, batch: DataFrame, buildings: DataFrame, as_of: Column, highest: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Upsert:
    """Rental units by ``source_id``. A new unit is inserted with a first history row; a changed rent updates the rent
    and fee columns and is logged; a changed fee alone is not a change. A unit stays with its building. A unit met several
    times in a batch is stored as it was met last, and every change of rent between its rows is logged."""
    named = keyed_buildings(batch)
    met = _by_key(snapshot, named, "source_id", ["rent"])
    step = _changed(["rent"])
    status = F.when(F.col("_before").isNull(), "new").when(step, "updated").otherwise("unchanged")
    many = keep(met.many.withColumns({"_step": step, "_status": status}))
    coming = _coming(met, many, "source_id")
    amounts = [c for c in ("rent", "rent_text", "management_fee", "management_fee_text") if c in named.columns]
    texts = [c for c in amounts if c.endswith("_text")]
    both = _sides(snapshot, coming, "source_id")
    known = F.col("s").isNotNull() & F.col("b").isNotNull()
    moved = known & F.coalesce("b._moved", _differs("s.rent", "b.rent"))
    write = (
        F.when(F.col("b").isNull(), "absent").when(F.col("s").isNull(), "insert").when(moved, "price").otherwise("keep")
    )
    rows = keep(both.withColumn("_write", write))
    amount = lambda c: filled(F.col(f"b.{c}")) if c in texts else F.col(f"b.{c}")

    def updated(c: str) -> Column:
        if c in amounts:
            return F.when(F.col("_write") == "price", amount(c)).otherwise(F.col(f"s.{c}")).alias(c)
        if c == "last_updated":
            return F.when(F.col("_write") == "price", as_of).otherwise(F.col("s.last_updated")).alias(c)
        return F.col(f"s.{c}").alias(c)

    kept = rows.where(F.col("s").isNotNull()).select(*[updated(c) for c in snapshot.columns])
    fresh = rows.where(F.col("_write") == "insert").select(
        *_insert(
            [x for x in snapshot.columns if x != "building_id"], coming.columns, as_of, ("insert_date", "last_updated")
        ),
        F.col("b.building_key").alias("building_key"),
    )
    owners = buildings.select(F.col("id").alias("building_id"), F.col("source_id").alias("building_key"))
    inserted = keep(_cast_like(with_new_ids(fresh.join(owners, "building_key", "left").drop("building_key"), snapshot, "source_id", highest=highest), snapshot))
    after = kept.unionByName(inserted)
    # A new unit's first row and every changed one.
    said = lambda p: [filled(F.col(p + c)).alias(c) if c in texts else F.col(p + c) for c in amounts]
    once = F.col("b._moved").isNull()
    ids = _ids(snapshot, inserted, "source_id", "rental_unit_id")
    log = rows.where(once & (F.col("_write") == "price")).select(F.col("s.id").alias("rental_unit_id"), *said("b."), as_of.alias("recorded_at"))
    first = rows.where(once & (F.col("_write") == "insert")).select("b.source_id", *said("b.")).unionByName(
        many.where(F.col("_step") | F.col("_before").isNull()).select("source_id", *said(""))
    )
    log = log.unionByName(first.join(ids, "source_id").select("rental_unit_id", *amounts, as_of.alias("recorded_at")))
    metric = F.when(F.col("s").isNull(), "new").when(moved, "updated").otherwise("unchanged")
    classified = rows.where(F.col("b").isNotNull()).select(
        F.col("_key").alias("source_id"), metric.alias("metric_status"), F.col("_write").alias("write_status")
    )
    seen = rows.where(once & F.col("b").isNotNull()).select("b.source_id", "b.ordinal", metric.alias("metric_status"))
    sightings = seen.unionByName(many.select("source_id", "ordinal", F.col("_status").alias("metric_status")))
    changes = _changes(snapshot, rows, [updated(c) for c in snapshot.columns], inserted, "source_id")
    return Upsert(after, log, classified, sightings, met.rejected, changes)


@dataclass
class Transit:
    line: DataFrame
    station: DataFrame
    link: DataFrame


def upsert_transit(
    stops: DataFrame, line: DataFrame, station: DataFrame, link: DataFrame, as_of: Column,
    decisions: DataFrame | None = None, names: DataFrame | None = None,
) -> Transit:
    """Lines, stations and building links from ``stops`` (building_id, line, station, walking_minutes, region,
    ordinal).

    Unknown lines and stations are created by name, a link's minutes and date are overwritten. Names that differ by
    width or case only are one name. ``decisions`` (name, kind, canonical_id, canonical_name) and ``names``
    (type, name, translated_name) complete new rows where given.
    """
    # Names fold once each and find their rows without the buildings; only the links, made last, have a row per building and stop.
    names_met = stops.where(F.col("line").isNotNull() & F.col("station").isNotNull()).groupBy("line", "station").agg(
        F.min(F.struct("ordinal", "region")).alias("_first")
    )
    keyed = stored(names_met.withColumns({"line_key": name_key(F.col("line")), "station_key": name_key(F.col("station"))}))
    known_lines = line.withColumn("line_key", name_key(F.col("name")))
    wanted_lines = keyed.groupBy("line_key").agg(
        F.min_by(
            F.struct(F.col("line").alias("name"), F.col("_first.region").alias("region")), F.struct("_first.ordinal", "line")
        ).alias("f")
    ).select("line_key", "f.*")
    new_lines = wanted_lines.join(known_lines.select("line_key"), "line_key", "left_anti")
    if decisions is not None:
        new_lines = new_lines.join(decisions, "name", "left")
    new_lines = _translated(new_lines, names, "line")
    for column in ("kind", "canonical_id", "canonical_name"):
        if column not in new_lines.columns:
            new_lines = new_lines.withColumn(column, F.lit(None).cast("string"))
    new_lines = with_new_ids(
        new_lines.withColumns({"kind": F.coalesce("kind", F.lit("unknown")), "operator": F.lit(None).cast("string")}),
        line, "line_key",
    )
    new_lines = settled(new_lines)
    lines = known_lines.unionByName(new_lines.select(*known_lines.columns))

    # Stored lines may share a key (they await a merge): the one of the very name, else the lowest id.
    by_key = lines.groupBy("line_key").agg(F.min("id").alias("_by_key"))
    by_name = lines.groupBy(F.col("name").alias("line")).agg(F.min("id").alias("_by_name"))
    placed = keyed.join(by_key, "line_key").join(by_name, "line", "left").withColumn(
        "train_line_id", F.coalesce("_by_name", "_by_key")
    ).drop("_by_name", "_by_key")
    known_stations = station.withColumn("station_key", name_key(F.col("name")))
    wanted = placed.groupBy("train_line_id", "station_key").agg(
        F.min_by("station", F.struct("_first.ordinal", "station")).alias("name")
    )
    new_stations = wanted.join(known_stations.select("train_line_id", "station_key"), ["train_line_id", "station_key"], "left_anti")
    new_stations = _translated(new_stations, names, "station").withColumn(
        "_both", F.concat_ws("\u0001", F.col("train_line_id").cast("string"), "station_key")
    )
    new_stations = settled(with_new_ids(new_stations, station, "_both"))
    stations = known_stations.unionByName(new_stations.select(*known_stations.columns))

    station_by_key = stations.groupBy("train_line_id", "station_key").agg(F.min("id").alias("_by_key"))
    station_by_name = stations.groupBy("train_line_id", F.col("name").alias("station")).agg(F.min("id").alias("_by_name"))
    found = placed.join(station_by_key, ["train_line_id", "station_key"]).join(
        station_by_name, ["train_line_id", "station"], "left"
    ).select("line", "station", F.coalesce("_by_name", "_by_key").alias("station_id"))
    at = stops.select("building_id", "line", "station", "walking_minutes", "ordinal").join(stored(found), ["line", "station"])
    coming = at.groupBy("building_id", "station_id").agg(F.max_by("walking_minutes", "ordinal").alias("_minutes"))
    both = link.join(coming, ["building_id", "station_id"], "full_outer")
    seen = F.col("_minutes").isNotNull()
    links = both.select(
        "id", "building_id", "station_id",
        F.coalesce("_minutes", "walking_minutes").cast("int").alias("walking_minutes"),
        F.when(seen, as_of).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    fresh = links.where(F.col("id").isNull()).drop("id").withColumn(
        "_both", F.concat_ws("-", F.col("building_id").cast("string"), F.col("station_id").cast("string"))
    )
    new_links = with_new_ids(fresh, link, "_both")
    all_links = links.where(F.col("id").isNotNull()).unionByName(new_links.drop("_both").select(*links.columns))
    return Transit(lines.select(*line.columns), stations.select(*station.columns), _cast_like(all_links, link))


def _translated(df: DataFrame, names: DataFrame | None, kind: str) -> DataFrame:
    if names is None:
        return df.withColumn("translated_name", F.lit(None).cast("string"))
    mine = names.where(F.col("type") == kind).select("name", "translated_name")
    return df.join(mine, "name", "left")


def replace_children(children: DataFrame, fresh: DataFrame, refreshed: DataFrame, key: str) -> DataFrame:
    """Child rows after a fresh read: the refreshed parents' old rows go, their new ones come, all others stay."""
    return children.join(refreshed.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*children.columns))


def mark_fetched(listings: DataFrame, refreshed: DataFrame, as_of: Column) -> DataFrame:
    """Sets ``detail_fetched_at`` of the refreshed listings (column ``id``)."""
    done = refreshed.select("id", F.lit(True).alias("_done")).distinct()
    return listings.join(done, "id", "left").select(
        *[
            F.when(F.col("_done"), as_of).otherwise(F.col(c)).alias(c) if c == "detail_fetched_at" else F.col(c)
            for c in listings.columns
        ]
    )


def cascade_delete(gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent (column ``id`` of ``gone``) is not deleted."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*children.columns)
