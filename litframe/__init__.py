"""Bibliographic records from captured web pages, as Spark jobs."""

from litframe.functions.markup import Selector
from litframe.operators.details import extract_details, flat_details
from litframe.operators.fulltext import (
    already_saved,
    fetch_outcomes,
    fulltext_eligible,
    fulltext_paths,
    fulltext_targets,
    has_detail,
    path_collisions,
)
from litframe.operators.hits import extract_hits, result_counts
from litframe.operators.merge import apply_details, mark_saved, merge_details, new_articles
from litframe.operators.ordering import plan_batches, with_run_order
from litframe.operators.pages import extract_pages
from litframe.operators.summary import page_summary, run_summary
from litframe.plans.requests import detail_requests, plan_pages, request_params, valid_requests
from litframe.session import configure
from litframe.sources.captures import read_captures, read_html_dir, spread_captures
from litframe.sources.files import saved_files, store_fulltext, stored_files
from litframe.sources.store import RunStore, list_runs, retain_runs, scan_sql

__all__ = [
    "RunStore", "Selector", "already_saved", "apply_details", "configure", "detail_requests",
    "extract_details", "extract_hits", "extract_pages", "fetch_outcomes", "flat_details",
    "fulltext_eligible", "fulltext_paths", "fulltext_targets", "has_detail", "list_runs",
    "mark_saved", "merge_details", "new_articles", "page_summary", "path_collisions",
    "plan_batches", "plan_pages", "read_captures", "read_html_dir", "request_params",
    "result_counts", "retain_runs", "run_summary", "saved_files", "scan_sql",
    "spread_captures", "store_fulltext", "stored_files", "valid_requests", "with_run_order",
]
