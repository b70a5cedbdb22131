"""Which full texts exist, which can be fetched, and what came of a fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.operators.merge import join_key, spread_key
from litframe.operators.ordering import dense_position

#: What may name a request in what a fetch brings, best first.
REQUEST_KEYS = (("run_id", "id"), ("run_id", "PMCID", "savepath"), ("PMCID",))
TARGET_COLUMNS = ("run_id", "id", "PMCID", "PMID", "doctitle", "savepath", "url")


def has_detail(publications: DataFrame) -> DataFrame:
    """Records whose detail page has arrived."""
    return publications.where(F.col("PMCID").isNotNull())


def fulltext_eligible(publications: DataFrame) -> DataFrame:
    """Records with a PMCID; the full-text mark of the hit is not consulted."""
    return publications.where(F.col("PMCID") != "")


def file_name(title: Column) -> Column:
    return F.regexp_replace(title, S.FILE_NAME_CHARS, " ")


def save_path(title: Column, directory: str, digits: int = 0) -> Column:
    """Path of a full text; with ``digits`` in a folder named by as many hex digits
    of the MD5 of its name, which keeps folders small (``sources/manifest.py``)."""
    name = F.concat(file_name(title), F.lit(".pdf"))
    if not digits:
        return F.concat(F.lit(f"{directory}/"), name)
    return F.concat(F.lit(f"{directory}/"), F.left(F.md5(F.encode(name, "UTF-8")), F.lit(digits)), F.lit("/"), name)


def fulltext_url(pmcid: Column, base: str = S.FULLTEXT_BASE_URL) -> Column:
    return F.concat(F.lit(f"{base}pmc/articles/"), pmcid, F.lit("/pdf/main.pdf"))


def fulltext_paths(
    publications: DataFrame, directory: str = S.FULLTEXT_DIR, base: str = S.FULLTEXT_BASE_URL, digits: int = 0
) -> DataFrame:
    """Eligible records with the path a full text would get and where it is fetched.

    ``digits`` as in ``save_path``.
    """
    return fulltext_eligible(publications).select(
        "run_id", "id", "PMCID", "PMID", "doctitle",
        save_path(F.col("doctitle"), directory, digits).alias("savepath"),
        fulltext_url(F.col("PMCID"), base).alias("url"),
    )


def path_collisions(paths: DataFrame) -> DataFrame:
    """Paths that several records of one run share: how many, and the first id.

    An aggregate, not a window: a path with very many records stays one row
    per task.
    """
    return (
        paths.groupBy("run_id", "savepath")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        .where(F.col("n") > 1)
    )


def file_paths(files: DataFrame) -> DataFrame:
    """Distinct plain paths of a file inventory."""
    return files.select(plain_path(F.col("path")).alias("savepath")).distinct()


def plain_path(path: Column) -> Column:
    """Path of a local file without the scheme ``file:``; others stay as they are."""
    return F.regexp_replace(path, "^file:(?://)?(?=/)", "")


def _by_path(paths: DataFrame, files: DataFrame, how: str) -> DataFrame:
    # titles repeat, so one path may stand for very many records
    right = file_paths(files).select(join_key(F.col("savepath")).alias("_key"))
    left = paths.withColumn("_key", spread_key(F.col("savepath"), "run_id", "id"))
    return left.join(right, "_key", how).select(*TARGET_COLUMNS)


def already_saved(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file exists: only their ``savepath`` is to be recorded."""
    return _by_path(paths, files, "left_semi")


def fulltext_targets(
    paths: DataFrame, files: DataFrame, limit: int | DataFrame | None = None
) -> DataFrame:
    """Records whose file does not exist yet; with ``limit`` the first n of each run.

    ``limit`` may be a frame of run_id and download_limit, one row per run; runs
    that it does not name have no limit. Places in a run are counted by blocks of
    ids, which reads the targets twice, so give stored rows with a limit.
    """
    targets = _by_path(paths, files, "left_anti")
    if limit is None:
        return targets
    placed = dense_position(targets, ["run_id"])
    if isinstance(limit, DataFrame):
        most = limit.select(F.col("run_id").alias("_run"), F.col("download_limit").alias("_most"))
        placed = placed.join(most, F.col("run_id").eqNullSafe(F.col("_run")), "left")
        return placed.where(F.col("_most").isNull() | (F.col("pos") <= F.col("_most"))).select(*TARGET_COLUMNS)
    return placed.where(F.col("pos") <= limit).select(*TARGET_COLUMNS)


def fetch_outcomes(targets: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each target with its outcome: ``saved`` if content came back, else ``failed``.

    ``fetched``: content (BINARY, NULL if the fetch failed) and what names the
    request: run_id and id, or run_id, PMCID and savepath, or of these only
    PMCID. An outcome belongs to its own request; with PMCID alone, to all
    targets of it. Only the test for NULL is shuffled, not the content.
    """
    given = set(fetched.columns)
    names = next(k for k in REQUEST_KEYS if given.issuperset(k))
    request = lambda: F.to_json(F.array(*[F.col(n).cast("string") for n in names]))
    arrived = fetched.groupBy(*names).agg(
        F.bool_or(F.col("content").isNotNull()).alias("_ok")
    )
    right = arrived.select(join_key(request()).alias("_key"), "_ok")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    return (
        targets.withColumn("_key", join_key(request()))
        .join(right, "_key", "left")
        .select(*TARGET_COLUMNS, F.when(ok, "saved").otherwise("failed").alias("status"))
    )


def saved_outcomes(outcomes: DataFrame) -> DataFrame:
    """What ``mark_saved`` takes, from outcomes."""
    return outcomes.where(F.col("status") == "saved").select(
        "run_id", "id", "PMCID", "savepath"
    )
