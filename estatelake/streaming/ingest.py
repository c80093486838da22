"""Pages arriving as files, written to the stored tables micro-batch by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from estatelake.fixed_values import NEW_APARTMENT_TYPE, RENTAL_TYPE
from estatelake.operators.counts import with_changes
from estatelake.operators.metrics import observed, page_metrics
from estatelake.plans.ingest import Ingest, ingest_rentals, ingest_sales, met_rentals, met_sales
from estatelake.schemas import TABLES
from estatelake.sources.tables import append_log, bucket_of, exists, read_buckets, read_log, write_buckets

BUCKETS = 64


def stream_pages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Page files as they land in a folder. ``max_files`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(StructType.fromDDL(TABLES["page"]))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _version(spark: SparkSession, root: str, query: str, batch: int) -> int:
    """The version a micro-batch writes: the one it was given at its first try, else the next after all there are. Which batch
    of which query writes a version is recorded before anything is written, so a repeated batch replaces its own output, and
    the first batch of another query (or of a new checkpoint) never replaces what is stored."""
    known = read_log(spark, root, "ingest_commit")
    mine = known.where((F.col("query_id") == query) & (F.col("batch_id") == batch)).agg(F.max("version")).first()[0]
    if mine is not None:
        return mine
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(query, batch, version)], TABLES["ingest_commit"])
    append_log(row, root, "ingest_commit", version)
    return version


def _layout(spark: SparkSession, root: str, buckets: int) -> int:
    """The number of buckets the stored tables have; ``buckets`` if there are none yet."""
    known = read_log(spark, root, "ingest_layout").first()
    if known is None:
        append_log(spark.createDataFrame([(buckets,)], TABLES["ingest_layout"]), root, "ingest_layout", 0)
        return buckets
    return known.buckets


def _met_buckets(rows: DataFrame, name: str, buckets: int) -> list[int]:
    """Buckets that rows lie in, at most as many as there are."""
    return sorted(r.bucket for r in rows.select(bucket_of(name, buckets)).distinct().collect())


def _highest(spark: SparkSession, root: str, name: str) -> int:
    """Highest id of a table, from the log of highest ids; of a table stored in another way from the table itself."""
    logged = read_log(spark, root, "stored_id").where(F.col("table") == name).agg(F.max("id")).first()[0]
    return logged if logged is not None else read_buckets(spark, root, name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


class _Staged:
    """What a micro-batch writes, complete in a folder of its own before any stored table changes.

    A batch that is repeated before its folder was complete meets the tables as they were and computes the same again. Once it is
    complete, a repeated batch only copies it, which gives the same tables however often it is done.
    """

    def __init__(self, spark: SparkSession, root: str, version: int, buckets: int) -> None:
        self.spark, self.root, self.version, self.buckets = spark, root, version, buckets
        self.folder = f"{root}/_staged/v={version}"
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        self.fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def complete(self) -> bool:
        return exists(self.spark, f"{self.folder}/_DONE")

    def add(self, done: Ingest) -> None:
        for name, table in done.tables.items():
            met = _met_buckets(done.changed[name], name, self.buckets)
            if not met:
                continue
            rows = table.drop("bucket").withColumn("bucket", bucket_of(name, self.buckets)).where(F.col("bucket").isin(met))
            write_buckets(rows, self.folder, name)
            if name in ("listing", "rental_unit"):
                ids = read_buckets(self.spark, self.folder, name).agg(F.lit(name).alias("table"), F.max("id").alias("id"))
                ids.write.mode("append").parquet(f"{self.folder}/stored_id")
        for name, rows in done.logs.items():
            # Sales and rentals of a batch may write the same log.
            rows.write.mode("append").parquet(f"{self.folder}/log_{name}")

    def count(self, moved: DataFrame) -> None:
        stored = read_buckets(self.spark, self.root, "area_count")
        write_buckets(with_changes(stored, moved).withColumn("bucket", F.lit(0)), self.folder, "area_count")

    def measure(self, classified: DataFrame) -> None:
        """Counts per page, and the whole batch's by the way while these are written."""
        seen = Observation()
        metrics = page_metrics(observed(classified.where("item"), seen).unionByName(classified.where("NOT item")))
        metrics.write.mode("overwrite").parquet(f"{self.folder}/log_page_metric")
        counts = seen.get
        row = (self.version, *[counts[c] for c in ("items", "new_items", "updated_items", "unchanged_items")])
        self.spark.createDataFrame([row], TABLES["batch_metric"]).write.mode("overwrite").parquet(f"{self.folder}/log_batch_metric")

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows that several outputs of the batch are made from, written once; of a Parquet table each reader takes only its columns."""
        path = f"{self.folder}/kept-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        self.fs.delete(self.path(self.folder), True)

    def seal(self) -> None:
        self.fs.mkdirs(self.path(self.folder))
        self.fs.create(self.path(f"{self.folder}/_DONE"), True).close()

    def apply(self) -> None:
        """Copies the folder into the stored tables and logs, then removes those of earlier batches."""
        for status in self.fs.listStatus(self.path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("log_"):
                append_log(self.spark.read.parquet(f"{self.folder}/{name}"), self.root, name[4:], self.version)
            elif name == "stored_id":
                append_log(self.spark.read.parquet(f"{self.folder}/{name}"), self.root, name, self.version)
            elif name in TABLES:
                write_buckets(read_buckets(self.spark, self.folder, name), self.root, name)
        for status in self.fs.listStatus(self.path(f"{self.root}/_staged")):
            if int(status.getPath().getName()[2:]) < self.version:
                self.fs.delete(status.getPath(), True)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query a checkpoint folder belongs to; Spark writes it when the query first starts."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def upsert_batch(
    root: str, origin: str, as_of: Callable[[int], Column], checkpoint: str, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: for-sale and rental pages of one micro-batch into the stored tables.

    Of listings and units only the buckets are read that the pages' keys lie in, and of every table only those are written in which a
    row changed. Change logs, counts per area (by what the batch changed in them), counters per page and of the batch are kept with
    it. A repeated batch writes the same again. Pages without a URL belong to no section; they are kept in the log ``page_reject``,
    rows without a key in ``row_reject``. Tables are replaced one after the other: a reader may meet a table before and another
    after the batch.
    """

    def run(pages: DataFrame, batch: int) -> None:
        spark, now = pages.sparkSession, as_of(batch)
        version = _version(spark, root, _query_id(spark, checkpoint), batch)
        n = _layout(spark, root, buckets)
        staged = _Staged(spark, root, version, n)
        if not staged.complete():
            staged.clear()
            append_log(pages.where(F.col("url").isNull()), root, "page_reject", version)
            section = F.regexp_extract("url", r"[?&]bs=([0-9]+)", 1)
            kinds = {"rental": section == RENTAL_TYPE, "project": section == NEW_APARTMENT_TYPE, "sale": ~section.isin(RENTAL_TYPE, NEW_APARTMENT_TYPE)}
            sort = lambda rows: {kind: rows.where(F.col("url").isNotNull() & of) for kind, of in kinds.items()}
            # A micro-batch is read with all its columns every time, so what needs no markup reads a copy without it.
            whole, bare = sort(pages), sort(staged.keep(pages.select("page_id", "url")))
            some = {kind: not rows.isEmpty() for kind, rows in bare.items()}

            def stored(name: str, met: DataFrame) -> DataFrame:
                return read_buckets(spark, root, name, _met_buckets(met, name, n)).drop("bucket")

            done = []
            if some["sale"] or some["project"]:
                met = met_sales(whole["sale"], whole["project"], origin, now, staged.keep)
                highest = _highest(spark, root, "listing")
                done.append(ingest_sales(stored("listing", met), bare["sale"], bare["project"], origin, now, met, highest, staged.keep))
            if some["rental"]:
                met = met_rentals(whole["rental"], origin, staged.keep)
                read_whole = ("building", "train_line", "station", "building_station")
                tables = {name: read_buckets(spark, root, name).drop("bucket") for name in read_whole}
                tables["rental_unit"] = stored("rental_unit", met)
                done.append(ingest_rentals(tables, bare["rental"], origin, now, met, _highest(spark, root, "rental_unit"), staged.keep))
            for one in done:
                staged.add(one)
            if done:
                staged.count(reduce(DataFrame.unionByName, [d.moved for d in done]))
                staged.measure(reduce(DataFrame.unionByName, [d.classified for d in done]))
            staged.seal()
        staged.apply()

    return run


def stream_upsert(
    pages: DataFrame, root: str, origin: str, checkpoint: str, as_of: Callable[[int], Column] | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Writes all page files there are now, in micro-batches, and stops. ``buckets`` is how many the tables are stored in if there
    are none yet."""
    stamp = as_of or (lambda _: F.current_timestamp())
    return (
        pages.writeStream.foreachBatch(upsert_batch(root, origin, stamp, checkpoint, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


