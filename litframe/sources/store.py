"""The store of publication records: one table, partitioned by run."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.operators import merge
from litframe.operators.merge import join_key, last_per_key, mark_saved, spread_key
from litframe.operators.ordering import with_run_order
from litframe.sources.scratch import remove, scratch_dir, staged, staged_at

_RUN_ID = "[0-9A-Za-z_-]+"
#: Runs that one statement removes.
DROPPED_AT_ONCE = 500
#: Rows of one key in a bucketed store that lie in one bucket; more lie in several.
ROWS_PER_SLOT = 100_000
#: What places a record in a bucket.
PLACE = ("_key", "_slot")


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def run_id_of(moment: Column) -> Column:
    """Name of the run started at ``moment``."""
    return F.date_format(moment, "yyyyMMddHHmmss")


def run_of_table(name: Column, prefix: str) -> Column:
    """Run name of a table named by prefix and run."""
    return F.substring(name, len(prefix) + 1, 2_147_483_647)


def list_runs(publications: DataFrame) -> DataFrame:
    """Names of the runs in a frame, in order."""
    return publications.select("run_id").distinct().orderBy("run_id")


def article_keys(publications: DataFrame) -> DataFrame:
    return publications.select("run_id", "PMCID", "PMID", "doctitle")


def without_run(publications: DataFrame, run_id: str) -> DataFrame:
    return publications.where(F.col("run_id") != run_id)


def retain_runs(publications: DataFrame, keep_last: int = 0) -> DataFrame:
    """Records of the last ``keep_last`` runs; 0 keeps none.

    The oldest run to keep is one scalar, found by a top-n over the distinct
    names; no record is joined or shuffled, and on a table partitioned by run
    the filter prunes partitions.
    """
    if keep_last < 1:
        return publications.where(F.lit(False))
    last = (
        publications.select("run_id").distinct().orderBy(F.desc("run_id")).limit(keep_last)
    )
    oldest = last.agg(F.min("run_id")).scalar()
    return publications.where(F.col("run_id") >= oldest)


def scan_sql(spark: SparkSession, text: str, args: dict | None = None, **frames) -> DataFrame:
    """Any read statement with named parameters; ``{name}`` stands for a frame.

    An error raises; it never turns into an empty result.
    """
    return spark.sql(text, args=args, **frames)


def as_publications(hits: DataFrame) -> DataFrame:
    """Hits with ``id`` as stored records whose detail has not arrived."""
    known = set(hits.columns)
    return hits.select(
        *[
            F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
            for f in S.PUBLICATION.fields
        ]
    )


class RunStore:
    """A managed Parquet table of ``PUBLICATION`` rows, partitioned by run_id.

    Two narrow tables stand beside it: ``<table>_paths`` with full texts saved since
    a run was written, and ``<table>_counts`` with what each step of a run saw. One
    writer at a time may change a run.

    With ``buckets`` a store is created whose records lie in that many buckets by
    ``_key``, which is their PMID or, for records without one, one of very many keys,
    and by ``_slot``: records of a key that has more than ``rows_per_slot`` of them lie
    in several slots. ``apply_details`` then leaves the records where they are and
    sends the new details to them.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 0, rows_per_slot: int = ROWS_PER_SLOT):
        self.spark = spark
        self.table = table
        self._wanted, self.rows_per_slot = buckets, rows_per_slot
        self.paths, self.counts = f"{table}_paths", f"{table}_counts"

    @property
    def buckets(self) -> int:
        """Buckets of the table as it is stored; 0 if it has none."""
        if not self.spark.catalog.tableExists(self.table):
            return self._wanted
        told = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Num Buckets'").first()
        return int(told.data_type) if told else 0

    def create(self, location: str | None = None) -> RunStore:
        """Create database (at ``location``, if given) and tables if missing."""
        if "." in self.table:
            database = self.table.rsplit(".", 1)[0]
            place = f" LOCATION '{location}'" if location else ""
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.PUBLICATION.fields)
        counts = ", ".join(f"{c} bigint" for c in S.RUN_COUNTS)
        clustered = ""
        if self._wanted:
            columns += ", _key string, _slot bigint"
            clustered = f" CLUSTERED BY ({', '.join(PLACE)}) INTO {self._wanted} BUCKETS"
        for table, own, more in (
            (self.table, columns, clustered),
            (self.paths, "PMCID string, savepath string, recorded bigint, run_id string", ""),
            (self.counts, f"{counts}, run_id string", ""),
        ):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({own}) USING parquet PARTITIONED BY (run_id){more}")
        return self

    def _records(self, table: str, run_id: str | None) -> DataFrame:
        frame = self.spark.table(table)
        return frame if run_id is None else frame.where(F.col("run_id") == run_id)

    def publications(self, run_id: str | None = None) -> DataFrame:
        """All columns of one run (or of all); a run reads only its partition.

        Paths recorded since the run was written are joined in; where there are
        none, which the catalog tells, the stored rows are read as they are.
        """
        frame = self._records(self.table, run_id).select(*S.PUBLICATION.names)
        if not self._has_paths(run_id):
            return frame
        recorded = self._records(self.paths, run_id)
        return mark_saved(frame, recorded.select("run_id", F.col("recorded").alias("id"), "PMCID", "savepath"))

    def keys(self, run_id: str | None = None) -> DataFrame:
        return article_keys(self._records(self.table, run_id))

    def _partitions(self, table: str, run_id: str | None = None) -> DataFrame:
        only = "" if run_id is None else f" PARTITION (run_id = {_literal(run_id)})"
        return self.spark.sql(f"SHOW PARTITIONS {table}{only}")

    def _has_paths(self, run_id: str | None) -> bool:
        return (
            run_id != "" and self.spark.catalog.tableExists(self.paths)
            and not self._partitions(self.paths, run_id).isEmpty()
        )

    def record_paths(self, saved: DataFrame) -> None:
        """Record full texts that were saved: run_id, id, PMCID, savepath.

        Means what replacing the runs by ``mark_saved`` of them means, but writes
        only keys and paths; the records stay as they are. Of several rows with
        one PMCID in a run the last by ``id`` counts, and later calls win over
        earlier ones. ``fold_paths`` writes them into a run.
        """
        usable = saved.where((F.col("PMCID") != "") & F.col("savepath").isNotNull())
        last = last_per_key(usable, "PMCID", "id", "savepath", group=("run_id",))
        with staged(last, "paths") as rows:
            self._check_names(rows)
            now = F.lit(time.time_ns()).alias("recorded")
            even = rows.select("PMCID", "savepath", now, "run_id").hint("rebalance", "run_id")
            even.write.insertInto(self.paths)

    def fold_paths(self, run_id: str) -> None:
        """Write the recorded paths of a run into its records."""
        if self._has_paths(run_id):
            self.replace_run(self.publications(run_id))

    def record_counts(self, run_id: str, **counts: int) -> None:
        """Add what a step of the run saw to its counts (``schemas.RUN_COUNTS``)."""
        row = self.spark.range(1).select(*[F.lit(counts.get(c, 0)).cast("long") for c in S.RUN_COUNTS], F.lit(run_id))
        row.write.insertInto(self.counts)

    def run_counts(self) -> DataFrame:
        """One row per run: search pages, those that failed, hits, article pages
        captured, and those that failed, as its steps saw them."""
        return self.spark.table(self.counts).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in S.RUN_COUNTS])

    @staticmethod
    def _names(partitions: DataFrame) -> DataFrame:
        escaped = F.replace(F.substring("partition", len("run_id=") + 1, 1 << 30), F.lit("+"), F.lit("%2B"))
        return partitions.select(F.url_decode(escaped).alias("run_id"))

    def runs(self) -> DataFrame:
        """Run names in order, from the catalog; no data file is opened."""
        return self._names(self._partitions(self.table)).orderBy("run_id")

    def _has(self, run_id: str) -> bool:
        return run_id != "" and not self._partitions(self.table, run_id).isEmpty()

    def _check_names(self, rows: DataFrame) -> None:
        """Runs that are written must have plain names (``run_id_of`` makes them)."""
        plain = F.coalesce(F.col("run_id").rlike(rf"\A{_RUN_ID}\z"), F.lit(False))
        odd = rows.select("run_id").where(~plain).limit(1).collect()
        if odd:
            raise ValueError(f"not a run name: {odd[0].run_id!r}")

    def append_hits(self, hits: DataFrame) -> None:
        """Insert hits with ids 1..n per run; a run already stored raises.

        The hits are staged once, so pages are parsed once although the page
        counts need a pass of their own.
        """
        with staged(hits, "hits") as rows:
            self._check_names(rows)
            again = rows.select("run_id").distinct().join(self.runs(), "run_id", "left_semi")
            if not again.isEmpty():
                raise ValueError("a run can be inserted only once; replace_run changes it")
            self._write(as_publications(with_run_order(rows)), overwrite=False)

    def replace_run(self, publications: DataFrame) -> None:
        """Swap in new contents of the runs that occur in ``publications``.

        The new rows usually come from the partitions they replace, so they are
        staged in the shared folder before any partition is overwritten. A swap
        that breaks off can be done again from the staged copy. Paths recorded
        for these runs before are forgotten after it: the new rows hold them if
        they come from ``publications``.
        """
        with staged_at(publications.select(*S.PUBLICATION.names), "runs") as (rows, path):
            self._check_names(rows)
            # the setting holds in a session of its own: other writers keep theirs
            own = self.spark.newSession()
            own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            self._write(own.read.schema(rows.schema).parquet(path), overwrite=True)
            if self._has_paths(None):
                recorded = self._names(self._partitions(self.paths))
                self._drop(self.paths, recorded.join(rows.select("run_id"), "run_id", "left_semi"))
        self.spark.catalog.refreshTable(self._qualified)

    def apply_details(self, details: DataFrame, run_id: str | Sequence[str] | None = None) -> None:
        """``merge.apply_details`` on the stored records of one run, of several one by one, or of all.

        The details are staged once and the last of each article is picked from
        there. In a bucketed store only details are exchanged; the records are joined
        and written again bucket by bucket. Recorded paths stay recorded there.
        """
        columns = ("PMID", "page_id", *merge.DETAIL_FIELDS)
        with staged(merge.ranked(details.select(*columns), "page_id", *merge.DETAIL_FIELDS), "details") as rows:
            latest = merge.pick_last(rows, "PMID", *merge.DETAIL_FIELDS)
            for run in [run_id] if run_id is None or isinstance(run_id, str) else run_id:
                if not self.buckets:
                    self.replace_run(merge.apply_latest(self.publications(run), latest))
                else:
                    self._swap(self.overlaid(latest, run))

    def overlaid(self, latest: DataFrame, run_id: str | None = None) -> DataFrame:
        """Records of a bucketed store, with their place, under one detail per PMID.

        A detail goes to slot 0 and to each further one that its key has.
        """
        records = self._records(self.table, run_id)
        further = records.where(F.col("_slot") > 0).select(F.col("_key").alias("_own"), "_slot").distinct()
        keyed = latest.withColumn("_own", join_key(F.col("PMID")))
        more = keyed.join(further, "_own").drop("_own")
        everywhere = keyed.drop("_own").withColumn("_slot", F.lit(0).cast("long")).unionByName(more)
        return merge.overlaid(records, everywhere, *PLACE)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Stored rows with the key and slot that say which bucket they lie in.

        Counting the rows of a key reads keys alone; those of many rows are few.
        """
        keyed = rows.withColumn("_key", spread_key(F.col("PMID"), "run_id", "id"))
        counts = keyed.groupBy(F.col("_key").alias("_many")).agg(F.count(F.lit(1)).alias("_n"))
        many = counts.where(F.col("_n") > self.rows_per_slot)
        slots = F.ceil(F.col("_n") / F.lit(self.rows_per_slot)).cast("long")
        slot = F.coalesce(F.pmod(F.xxhash64("run_id", "id"), slots), F.lit(0).cast("long"))
        placed = keyed.join(many, F.col("_key") == F.col("_many"), "left").withColumn("_slot", slot)
        return placed.select(*S.PUBLICATION_COLUMNS, *PLACE, "run_id")

    def _swap(self, records: DataFrame) -> None:
        """Overwrite the runs of these placed records, which come from the table itself.

        The copy that is made first is a bucketed table, so neither write moves a row.
        """
        database = self._qualified.rsplit(".", 1)[0]
        path = scratch_dir(self.spark, "buckets")
        copy = f"{database}.copy_{path.rsplit('-', 1)[-1]}"
        columns = (*S.PUBLICATION_COLUMNS, *PLACE, "run_id")
        records.select(*columns).write.format("parquet").bucketBy(self.buckets, *PLACE).option("path", path).saveAsTable(copy)
        try:
            own = self.spark.newSession()
            own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            own.table(copy).write.insertInto(self._qualified, overwrite=True)
        except Exception as error:
            error.add_note(f"the staged rows are kept at {path}")
            raise
        self.spark.sql(f"DROP TABLE {copy}")
        remove(self.spark, path)
        self.spark.catalog.refreshTable(self._qualified)

    def _write(self, rows: DataFrame, overwrite: bool) -> None:
        if buckets := self.buckets:
            placed = self._placed(rows).repartition(buckets, *PLACE)
            placed.write.insertInto(self._qualified, overwrite=overwrite)
            return
        # a rebalance by run makes few files per run, and splits a run that
        # holds much of the table over many tasks
        even = rows.select(*S.PUBLICATION.names).hint("rebalance", "run_id")
        even.write.insertInto(self._qualified, overwrite=overwrite)

    @property
    def _qualified(self) -> str:
        """The table's name, valid in any session of the application."""
        return self.table if "." in self.table else f"{self.spark.catalog.currentDatabase()}.{self.table}"

    def drop_run(self, run_id: str) -> bool:
        """Remove a run with its paths and counts; tells whether it was there."""
        if not self._has(run_id):
            return False
        self._drop_all(self.spark.range(1).select(F.lit(run_id).alias("run_id")))
        return True

    def _drop_all(self, names: DataFrame) -> list[str]:
        # the records go last: a run that is still listed can be dropped again
        for table in (self.paths, self.counts):
            if self.spark.catalog.tableExists(table):
                self._drop(table, names)
        return self._drop(self.table, names)

    def _drop(self, table: str, names: DataFrame) -> list[str]:
        run_ids = [r.run_id for r in names.toLocalIterator()]
        for start in range(0, len(run_ids), DROPPED_AT_ONCE):
            some = run_ids[start : start + DROPPED_AT_ONCE]
            parts = ", ".join(f"PARTITION (run_id = {_literal(r)})" for r in some)
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
        return run_ids

    def retain_runs(self, keep_last: int = 0) -> list[str]:
        """Remove all but the last ``keep_last`` runs; returns the removed names."""
        return self._drop_all(self.runs().orderBy(F.desc("run_id")).offset(keep_last))
