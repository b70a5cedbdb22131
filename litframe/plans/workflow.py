"""The three steps of a run over a store: search, enrich, full texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.operators import fulltext
from litframe.operators.details import extract_details, flat_details
from litframe.operators.hits import extract_hits
from litframe.sources.captures import spread_captures, usable, with_page_no, with_run
from litframe.sources.scratch import stage
from litframe.sources.store import RunStore


def _counted(captures: DataFrame, pages: str, failed: str) -> tuple[DataFrame, Observation]:
    """Captures whose number, and that of failed ones, is known once they were read."""
    seen = Observation()
    rows = captures.observe(
        seen, F.count(F.lit(1)).alias(pages), F.count_if(F.col("html").isNull()).alias(failed)
    )
    return rows, seen


def search_run(
    store: RunStore, captures: DataFrame, run_id: str, partitions: int | None = None
) -> None:
    """Captured search pages to stored hits of one run.

    Captures that failed (NULL html) may be among them. Pages, failed pages and
    hits are counted in the pass that parses the pages, and kept in the store
    (``run_counts``). Spark adds counts up task by task; a task that is run again
    because an executor was lost may count twice, while the hits never do.
    """
    pages, seen = _counted(spread_captures(captures, partitions), "pages", "pages_failed")
    found = Observation()
    hits = extract_hits(usable(with_page_no(with_run(pages, run_id))))
    store.append_hits(hits.observe(found, F.count(F.lit(1)).alias("hits")))
    store.record_counts(run_id, **seen.get, **found.get)


def enrich_run(
    store: RunStore, captures: DataFrame, run_id: str, partitions: int | None = None
) -> None:
    """Captured article pages onto the stored hits of one run; counts as in ``search_run``."""
    enrich_runs(store, captures, [run_id], partitions)


def enrich_runs(
    store: RunStore, captures: DataFrame, run_ids: Sequence[str], partitions: int | None = None
) -> None:
    """``enrich_run`` of several runs with the same pages, which are parsed once for all of them."""
    pages, seen = _counted(spread_captures(captures, partitions), "detail_pages", "detail_pages_failed")
    details = flat_details(extract_details(pages))
    store.apply_details(details, run_ids)
    for run_id in run_ids:
        store.record_counts(run_id, **seen.get)


def plan_fulltexts(
    store: RunStore, files: DataFrame, run_id: str,
    limit: int | DataFrame | None = None, directory: str = S.FULLTEXT_DIR, digits: int = 0,
) -> DataFrame:
    """Record full texts that exist already; return the targets still to fetch.

    ``limit`` is a number of targets, or a frame of run_id and download_limit (as
    ``valid_requests`` gives it, with the run of each request); None plans all.
    ``digits`` plans paths in folders (``fulltext.save_path``), as a ``FileManifest``
    of as many digits lists them.

    The targets are staged: they stay the same while the fetch goes on and the
    store changes.
    """
    paths = fulltext.fulltext_paths(store.publications(run_id), directory, digits=digits)
    existing = fulltext.already_saved(paths, files)
    targets = stage(fulltext.fulltext_targets(paths, files, limit), "targets")
    store.record_paths(existing)
    return targets


def record_fetches(
    store: RunStore, targets: DataFrame, fetched: DataFrame, run_id: str
) -> DataFrame:
    """Record what a fetch brought; returns the outcome of each target."""
    outcomes = fulltext.fetch_outcomes(targets, fetched)
    saved = fulltext.saved_outcomes(outcomes)
    store.record_paths(saved)
    return outcomes
