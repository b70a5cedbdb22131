"""Registered queries and their expected results.

``queries()`` runs the library on pages, requests and files that Spark renders
from the given tables; ``oracle_sql()`` computes the same results in DuckDB
from the source columns.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import expected as E  # noqa: E402
from checks import inputs as I  # noqa: E402
from litframe import exports  # noqa: E402
from litframe import schemas as S  # noqa: E402
from litframe.functions.markup import Selector  # noqa: E402
from litframe.operators import fulltext, merge, ordering, summary  # noqa: E402
from litframe.operators.details import extract_details, flat_details  # noqa: E402
from litframe.operators.hits import extract_hits, result_counts  # noqa: E402
from litframe.operators.pages import extract_pages  # noqa: E402
from litframe.plans import requests as plans  # noqa: E402
from litframe.plans import workflow  # noqa: E402
from litframe.sources import captures, files, manifest, store  # noqa: E402
from litframe.sources.scratch import scratch_dir, stage  # noqa: E402
from litframe.streaming import new_articles as feed  # noqa: E402

try:
    from litframe.llm import queries as llm
except ModuleNotFoundError as missing:  # the subpackage or the pipeline is not installed
    if missing.name not in ("litframe.llm", "litframe.llm.queries", "corpus_pipeline"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

PAGE_SELECTORS = (
    Selector("title", "title"),
    Selector("heading", "h1"),
    Selector("links", "a", get="@href", within=("nav",), first=False),
    Selector("ad", "div", "class", "ad"),
    Selector("article", "article", get="all_text"),
)
FLAT = ("page_id", "PMID", "PMCID", "doi", "abstract", "affiliations", "keyword", "full_text_link")
LAST_RUNS = 2
TOP_TARGETS = 10
MANIFEST_DIGITS = 2


def entry(spark: SparkSession) -> DataFrame:
    """Hits of all search pages rendered from the smallest data set."""
    return queries()["extract_hits"](spark, "/root/testdata/sf0.001")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.fulltext_paths(I.publications(spark, sf_dir), I.DIRECTORY)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.fulltext_targets(_paths(spark, sf_dir), I.files(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return fulltext.fetch_outcomes(targets, I.fetched(targets))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_run_order(I.hits(spark, sf_dir))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_details(I.spread(I.article_captures(spark, sf_dir)))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.valid_requests(I.requests(spark, sf_dir))


def _new_store(spark: SparkSession, name: str, buckets: int = 0) -> store.RunStore:
    location = scratch_dir(spark, name)
    database = "litframe_" + location.rsplit("-", 1)[-1]
    return store.RunStore(spark, f"{database}.runs", buckets).create(location)


def _joined(batches: DataFrame) -> DataFrame:
    return batches.withColumn("keys", F.array_join("keys", " "))


# ---- sources -----------------------------------------------------------------


def q_src_captures(spark, sf_dir):
    return captures.read_captures(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", "url", "html"
    )


def q_src_captures_search(spark, sf_dir):
    """Search captures that hold no page number: it comes from the address."""
    found = I.search_captures(spark, sf_dir).drop("page_no")
    return captures.usable(captures.with_page_no(found)).select(
        "run_id", "page_no", "page_id", "url", "html"
    )


def q_src_captures_detail(spark, sf_dir):
    return captures.usable(I.article_captures(spark, sf_dir)).select("page_id", "url", "html")


def q_src_html_files(spark, sf_dir):
    folder = scratch_dir(spark, "html")
    html = I.spread(I.table(spark, sf_dir, "pages")).select("html")
    I.write_files(html, folder, ".txt")
    return captures.read_html_dir(spark, folder).select("html")


def q_scan_publications(spark, sf_dir):
    return I.publications(spark, sf_dir).select(*S.PUBLICATION.names)


def q_scan_keys(spark, sf_dir):
    return store.article_keys(I.publications(spark, sf_dir))


def q_scan_sql(spark, sf_dir):
    return store.scan_sql(
        spark,
        "select freemark, count(*) as n, count(PMCID) as with_detail from {pubs} "
        "where reviewmark = :review group by freemark",
        {"review": True},
        pubs=I.publications(spark, sf_dir),
    )


def q_list_runs(spark, sf_dir):
    return store.list_runs(I.publications(spark, sf_dir))


def q_saved_files(spark, sf_dir):
    """Lengths of the files of a folder that holds a file for each content."""
    folder = scratch_dir(spark, "files")
    contents = I.fetched(_targets(spark, sf_dir)).where("content is not null")
    I.write_files(contents.select(F.decode("content", "UTF-8").alias("value")), folder, ".txt")
    return files.saved_files(spark, folder, "*.txt").select("length")


def q_stored_files(spark, sf_dir):
    folder = scratch_dir(spark, "fulltext")
    files.store_fulltext(I.fetched(_targets(spark, sf_dir)), folder)
    return files.stored_files(spark, folder)


# ---- request planning --------------------------------------------------------


def q_valid_requests(spark, sf_dir):
    return _requests(spark, sf_dir)


def q_plan_params(spark, sf_dir):
    return plans.request_params(_requests(spark, sf_dir)).select("request_id", "params")


def q_plan_pages(spark, sf_dir):
    return plans.plan_pages(_requests(spark, sf_dir))


def q_result_count(spark, sf_dir):
    return result_counts(captures.usable(I.search_captures(spark, sf_dir)))


def q_plan_batches(spark, sf_dir):
    """Article pages to fetch, in batches of 50; ids have no gaps."""
    return _joined(
        ordering.plan_batches(_numbered(spark, sf_dir), "PMID", S.DETAIL_BATCH, dense=True)
    )


def q_plan_batches_fulltext(spark, sf_dir):
    """Full texts to fetch, in batches of 5; ids of targets have gaps."""
    return _joined(
        ordering.plan_batches(_targets(spark, sf_dir), "PMCID", S.FULLTEXT_BATCH)
    )


def q_detail_requests(spark, sf_dir):
    return plans.detail_requests(_numbered(spark, sf_dir))


# ---- extraction --------------------------------------------------------------


def q_extract_hits(spark, sf_dir):
    return extract_hits(I.spread(I.search_captures(spark, sf_dir)))


def q_extract_details(spark, sf_dir):
    parts = [F.col(f"abstract.{f}").alias(f) for f in S.ABSTRACT.names]
    return _details(spark, sf_dir).select(
        "page_id", "PMID", "PMCID", "doi", *parts, "keyword",
        F.array_join("affiliations", "\n").alias("affiliations"), "full_text_link",
    )


def q_abstract_full(spark, sf_dir):
    return flat_details(_details(spark, sf_dir)).select("page_id", "abstract")


def q_affiliations_text(spark, sf_dir):
    return flat_details(_details(spark, sf_dir)).select("page_id", "affiliations")


def q_extract_pages(spark, sf_dir):
    pages = I.spread(I.table(spark, sf_dir, "pages"))
    return extract_pages(pages, PAGE_SELECTORS, keep=("page_id", "url")).withColumn(
        "links", F.array_join("links", " ")
    )


# ---- merges ------------------------------------------------------------------


def q_merge_details(spark, sf_dir):
    return merge.merge_details(
        _numbered(spark, sf_dir), flat_details(_details(spark, sf_dir))
    )


def q_merge_latest(spark, sf_dir):
    """The same from stored details, whose last ones are picked by number."""
    rows = merge.ranked(flat_details(_details(spark, sf_dir)), "page_id", *merge.DETAIL_FIELDS)
    latest = merge.pick_last(stage(rows, "details"), "PMID", *merge.DETAIL_FIELDS)
    return merge.merge_latest(_numbered(spark, sf_dir), latest)


def q_apply_details(spark, sf_dir):
    """The same merge as an update of stored records that have no detail yet."""
    bare = store.as_publications(_numbered(spark, sf_dir))
    return merge.apply_details(bare, flat_details(_details(spark, sf_dir)))


def q_apply_details_buckets(spark, sf_dir):
    """The update on a store in buckets, whose records stay where they are."""
    runs = _new_store(spark, "buckets", buckets=8)
    runs.append_hits(I.hits(spark, sf_dir))
    runs.apply_details(flat_details(_details(spark, sf_dir)))
    return runs.publications()


def q_mark_saved(spark, sf_dir):
    """Existing files are recorded first, then what the fetch brought."""
    existing = fulltext.already_saved(_paths(spark, sf_dir), I.files(spark, sf_dir))
    first = merge.mark_saved(I.publications(spark, sf_dir), existing)
    return merge.mark_saved(first, fulltext.saved_outcomes(_outcomes(spark, sf_dir)))


def q_already_saved(spark, sf_dir):
    return fulltext.already_saved(_paths(spark, sf_dir), I.files(spark, sf_dir))


def q_already_saved_manifest(spark, sf_dir):
    """The same from a stored inventory of files in folders by a hash of their names."""
    folder = scratch_dir(spark, "library")
    names = I.files(spark, sf_dir).select(F.substring_index("path", "/", -1).alias("name"))
    I.write_library(names, f"{folder}/files", MANIFEST_DIGITS)
    inventory = manifest.FileManifest(spark, f"{folder}/files", f"{folder}/manifest", MANIFEST_DIGITS)
    for _ in range(2):
        inventory.refresh()
    plain = fulltext.plain_path(F.lit(f"{folder}/files"))
    paths = fulltext.fulltext_paths(I.publications(spark, sf_dir), "", digits=MANIFEST_DIGITS)
    there = paths.withColumn("savepath", F.concat(plain, F.col("savepath")))
    return fulltext.already_saved(there, inventory.files()).select("run_id", "id", "PMCID", "PMID", "doctitle", "url")


def q_fulltext_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


def q_fulltext_targets_limit(spark, sf_dir):
    """The first n targets of each run in insertion order: a top-n report."""
    return fulltext.fulltext_targets(
        _paths(spark, sf_dir), I.files(spark, sf_dir), limit=TOP_TARGETS
    )


def q_new_articles(spark, sf_dir):
    """Captured articles that no stored run names."""
    details = flat_details(_details(spark, sf_dir))
    return merge.new_articles(details, I.publications(spark, sf_dir)).select(*FLAT)


def q_new_articles_feed(spark, sf_dir):
    """The same as a stream: first captures come before second ones, in two runs of
    the feed, and each article is fed once."""
    folder = scratch_dir(spark, "feed")
    pages = feed.read_capture_stream(spark, f"{folder}/captures/*")
    first = F.col("page_id") < I.SECOND_CAPTURE
    for name, part in (("a", first), ("b", ~first)):
        arrived = I.article_captures(spark, sf_dir).where(part)
        I.spread(arrived).write.parquet(f"{folder}/captures/{name}")
        feed.start_feed(
            pages, I.publications(spark, sf_dir), f"{folder}/new", f"{folder}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/new").select(*FLAT)


def q_new_articles_state(spark, sf_dir):
    """Keys of the same articles from the feed that keeps them in the state store."""
    folder = scratch_dir(spark, "state")
    pages = feed.read_capture_stream(spark, f"{folder}/captures/*")
    first = F.col("page_id") < I.SECOND_CAPTURE
    for name, part in (("a", first), ("b", ~first)):
        arrived = I.article_captures(spark, sf_dir).where(part)
        I.spread(arrived).write.parquet(f"{folder}/captures/{name}")
        feed.start_state_feed(
            pages, I.publications(spark, sf_dir), f"{folder}/new", f"{folder}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/new").select("PMID")


# ---- filters, paths, outcomes, order -----------------------------------------


def q_has_detail(spark, sf_dir):
    return store.article_keys(fulltext.has_detail(I.publications(spark, sf_dir)))


def q_fulltext_eligible(spark, sf_dir):
    return store.article_keys(fulltext.fulltext_eligible(I.publications(spark, sf_dir)))


def q_fulltext_urls(spark, sf_dir):
    return _paths(spark, sf_dir).select("run_id", "id", "PMCID", "url")


def q_fulltext_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("run_id", "id", "doctitle", "savepath")


def q_path_collisions(spark, sf_dir):
    return fulltext.path_collisions(_paths(spark, sf_dir))


def q_fetch_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def q_hits_union(spark, sf_dir):
    """Hits of two sets of pages, one after the other; duplicates stay."""
    found = I.hits(spark, sf_dir)
    return found.unionByName(found.withColumn("run_id", F.lit("again")))


def q_run_order(spark, sf_dir):
    return _numbered(spark, sf_dir).select("run_id", "id", "page_no", "position", "PMID")


def q_page_summary(spark, sf_dir):
    return summary.page_summary(I.search_captures(spark, sf_dir), I.hits(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    return summary.run_summary(
        q_page_summary(spark, sf_dir), I.publications(spark, sf_dir)
    )


def q_run_counts(spark, sf_dir):
    """Search the runs of a store, then enrich them; what the steps counted as they went."""
    runs = _new_store(spark, "counts")
    tasks = captures.parse_tasks(spark, I.SPREAD)
    pages = stage(I.search_captures(spark, sf_dir), "search")
    articles = stage(I.article_captures(spark, sf_dir), "articles")
    run_ids = [r.run_id for r in pages.select("run_id").distinct().orderBy("run_id").collect()]
    for run_id in run_ids:
        workflow.search_run(runs, pages.where(F.col("run_id") == run_id), run_id, tasks)
    workflow.enrich_runs(runs, articles, run_ids, tasks)
    return runs.run_counts()


# ---- sinks and table maintenance ---------------------------------------------


def q_append_hits(spark, sf_dir):
    """Create a store, insert all hits, read the table back."""
    runs = _new_store(spark, "append")
    runs.append_hits(I.hits(spark, sf_dir))
    return runs.publications().select(*S.PUBLICATION.names)


def q_create_store(spark, sf_dir):
    """A new store that takes all records: rows per run, from the table."""
    runs = _new_store(spark, "create")
    runs.replace_run(I.publications(spark, sf_dir))
    return runs.publications().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def q_replace_run(spark, sf_dir):
    """Insert hits, then apply details and saved paths to the stored table."""
    runs = _new_store(spark, "replace")
    runs.append_hits(I.hits(spark, sf_dir))
    details = flat_details(_details(spark, sf_dir))
    runs.replace_run(merge.apply_details(runs.publications(), details))
    paths = fulltext.fulltext_paths(runs.publications(), I.DIRECTORY)
    existing = fulltext.already_saved(paths, I.files(spark, sf_dir))
    runs.replace_run(merge.mark_saved(runs.publications(), existing))
    return runs.publications().select(*S.PUBLICATION.names)


def q_record_paths(spark, sf_dir):
    """Paths of existing files, then of fetched ones, recorded beside stored runs."""
    runs = _new_store(spark, "paths")
    runs.replace_run(I.publications(spark, sf_dir))
    runs.record_paths(fulltext.already_saved(_paths(spark, sf_dir), I.files(spark, sf_dir)))
    runs.record_paths(fulltext.saved_outcomes(_outcomes(spark, sf_dir)))
    return runs.publications().select(*S.PUBLICATION.names)


def q_store_fulltext(spark, sf_dir):
    folder = scratch_dir(spark, "contents")
    files.store_fulltext(I.fetched(_targets(spark, sf_dir)), folder)
    return spark.read.parquet(folder).select(
        "PMCID", "savepath", "length", F.decode("content", "UTF-8").alias("content")
    )


def q_export_text(spark, sf_dir):
    """Write the lines as text files and read them back."""
    folder = scratch_dir(spark, "lines")
    exports.write_text(_numbered(spark, sf_dir), folder)
    return spark.read.text(folder)


def q_export_report(spark, sf_dir):
    return exports.report(I.publications(spark, sf_dir))


def q_export_records(spark, sf_dir):
    """Records written as JSON lines, read back by key."""
    folder = scratch_dir(spark, "records")
    rows = exports.records(I.publications(spark, sf_dir))
    rows.write.mode(exports.write_mode(False)).text(folder)
    types = {f.name: f.dataType.simpleString() for f in S.PUBLICATION.fields}
    schema = ", ".join(f"{key} {types[column]}" for key, column in S.RECORD_KEYS.items())
    return spark.read.schema(schema).json(folder)


def q_export_run(spark, sf_dir):
    """The report of the last stored run, read from its partition alone."""
    runs = _new_store(spark, "export")
    runs.replace_run(I.publications(spark, sf_dir))
    last = runs.runs().orderBy(F.desc("run_id")).first().run_id
    return exports.report(runs.publications(last))


def q_write_mode(spark, sf_dir):
    """The report as CSV, written twice with override, read back."""
    folder = scratch_dir(spark, "report")
    for override in (False, True):
        exports.write_report(I.publications(spark, sf_dir), folder, override=override)
    return spark.read.csv(
        folder, header=True, multiLine=True, escape='"', emptyValue="", nullValue="\0",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def q_drop_run(spark, sf_dir):
    """Drop the first run of a store; the other runs stay."""
    runs = _new_store(spark, "drop")
    runs.replace_run(I.publications(spark, sf_dir))
    runs.drop_run(runs.runs().first().run_id)
    return runs.publications().select("run_id", "id", "PMID")


def q_retain_runs_store(spark, sf_dir):
    """The same on a stored table, whose older runs are dropped."""
    runs = _new_store(spark, "retain")
    runs.replace_run(I.publications(spark, sf_dir))
    runs.retain_runs(keep_last=LAST_RUNS)
    return runs.publications().select("run_id", "id", "PMID")


def q_store_keys(spark, sf_dir):
    runs = _new_store(spark, "keys")
    runs.replace_run(I.publications(spark, sf_dir))
    return runs.keys()


def q_store_runs(spark, sf_dir):
    runs = _new_store(spark, "runs")
    runs.replace_run(I.publications(spark, sf_dir))
    return runs.runs()


def q_retain_runs(spark, sf_dir):
    """Records of the last two runs."""
    kept = store.retain_runs(I.publications(spark, sf_dir), keep_last=LAST_RUNS)
    return kept.select("run_id", "id", "PMID")


def own_queries() -> dict[str, Query]:
    """Queries of the library itself, without those of the ``llm`` subpackage."""
    return {
        name.removeprefix("q_"): fn
        for name, fn in sorted(globals().items())
        if name.startswith("q_")
    }


def own_oracle_sql() -> dict[str, str]:
    of, cols = E.of, E.PUBLICATION_COLUMNS
    target = "run_id, id, PMCID, PMID, doctitle, savepath, url"
    report = ", ".join(
        ("cast(reviewmark as integer)" if name == "reviewmark" else name) + f' as "{heading}"'
        for name, heading in S.REPORT_HEADINGS.items()
    )
    texts = ", ".join(
        f'cast({"cast(reviewmark as integer)" if name == "reviewmark" else name} as varchar) as "{heading}"'
        for name, heading in S.REPORT_HEADINGS.items()
    )
    record = ", ".join(f"{column} as {key}" for key, column in S.RECORD_KEYS.items())
    line = (
        "doctitle || ' ' || short_author || ' ' || full_author || ' ' || short_journal || ' ' "
        "|| full_journal || ' ' || PMID || ' ' || freemark || ' ' "
        "|| case when reviewmark then 'True' else 'False' end"
    )
    bare = (
        "id, doctitle, full_author, short_author, full_journal, short_journal, "
        "cast(null as varchar) as doi, PMID, cast(null as varchar) as PMCID, "
        "cast(null as varchar) as abstract, cast(null as varchar) as keyword, "
        "cast(null as varchar) as affiliations, freemark, reviewmark, "
        "cast(null as varchar) as savepath, run_id"
    )
    decoded = "{}"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        decoded = f"replace({decoded}, '&{name};', '{char}')"
    plain_html = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    fetched = (
        "select PMCID, savepath, url from targets "
        "where doctitle not like 'blue%' and doctitle not like 'small%'"
    )
    batches = (
        "select run_id, cast((pos - 1) // {size} as bigint) as batch_no, "
        "cast(count(*) as integer) as n_keys, string_agg({key}, ' ' order by pos) as keys "
        "from ({rows}) group by run_id, (pos - 1) // {size}"
    )
    marked = f"""{E.FULLTEXT},
    by_file as (select run_id, PMCID, max_by(savepath, id) as p from existing group by run_id, PMCID),
    by_fetch as (select run_id, PMCID, max_by(savepath, id) as p from outcomes
      where status = 'saved' group by run_id, PMCID)"""
    saved_cols = cols.replace("savepath", "coalesce({}) as savepath")
    saved_cols = ", ".join(
        c if c.startswith("coalesce") else f"x.{c}" for c in saved_cols.split(", ")
    )
    return {
        "src_captures": "select page_id, url, html from pages where html is not null",
        "src_captures_search": (
            "select run_id, page_no, page_id, url, html from "
            f"({E.rendered(I.SEARCH_SQL)}) where html is not null"
        ),
        "src_captures_detail": (
            "select page_id, url, html from "
            f"({E.rendered(I.ARTICLE_SQL.replace('{second}', str(I.SECOND_CAPTURE)))}) where html is not null"
        ),
        "src_html_files": "select html || chr(10) as html from pages",
        "scan_publications": of(E.PUBLICATIONS, f"select {cols}, run_id from publications"),
        "scan_keys": of(E.PUBLICATIONS, "select run_id, PMCID, PMID, doctitle from publications"),
        "scan_sql": of(
            E.PUBLICATIONS,
            "select freemark, count(*) as n, count(PMCID) as with_detail from publications "
            "where reviewmark group by freemark",
        ),
        "list_runs": of(E.HITS, "select distinct run_id from numbered order by run_id"),
        "saved_files": of(
            E.FULLTEXT, f"select cast(length(url) + 1 as bigint) as length from ({fetched})"
        ),
        "stored_files": of(
            E.FULLTEXT,
            f"select savepath as path, cast(length(url) as bigint) as length from ({fetched})",
        ),
        "valid_requests": of(
            E.REQUESTS,
            'select request_id, keyword, "year", page_limit, download_limit, result_num, valid, '
            "reason from requests",
        ),
        "plan_params": of(E.REQUESTS, "select request_id, params from encoded"),
        "plan_pages": of(
            E.REQUESTS,
            "select request_id, cast(page_no as integer) as page_no, "
            "'https://pubmed.ncbi.nlm.nih.gov/?' || params || '&page=' || cast(page_no as varchar) as url "
            "from (select request_id, params, unnest(generate_series(1, "
            "least(page_limit, (result_num + 49) // 50))) as page_no from encoded where valid)",
        ),
        "result_count": of(
            E.PAGES,
            "select page_id, cast(case when low <= 2 then n * 1000 + page_no end as integer) as n "
            "from pages_made where high >= 45",
        ),
        "plan_batches": of(
            E.HITS,
            batches.format(size=50, key="PMID", rows="select run_id, id as pos, PMID from numbered"),
        ),
        "plan_batches_fulltext": of(
            E.FULLTEXT,
            batches.format(
                size=5, key="PMCID",
                rows="select run_id, PMCID, row_number() over (partition by run_id order by id) "
                "as pos from targets",
            ),
        ),
        "detail_requests": of(
            E.HITS,
            "select run_id, id, PMID, 'https://pubmed.ncbi.nlm.nih.gov/' || PMID as url from numbered",
        ),
        "extract_hits": of(E.HITS, "select * from hits"),
        "extract_details": of(E.DETAILS, "select * from details"),
        "abstract_full": of(E.DETAILS, "select page_id, abstract from flat"),
        "affiliations_text": of(E.DETAILS, "select page_id, affiliations from flat"),
        "extract_pages": (
            "select page_id, url, "
            + decoded.format(f"regexp_extract({plain_html}, '<title>([^<]*)</title>', 1)")
            + " as title, "
            + decoded.format(f"regexp_extract({plain_html}, '<h1>([^<]*)</h1>', 1)")
            + " as heading, "
            + decoded.format(
                "array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), "
                "'<a href=\"([^\"]*)\"', 1), ' ')"
            )
            + " as links, "
            + decoded.format(f"regexp_extract({plain_html}, '<div class=\"ad\">([^<]+)', 1)")
            + " as ad, "
            + "array_to_string([t for t in [trim(" + decoded.format("x") + ", " + E.SPACE + ") for x in "
            + "regexp_split_to_array(regexp_extract(regexp_replace(" + plain_html
            + ", '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g'), "
            + "'(?s)<article>(.*?)</article>', 1), '<[^>]*>')] if t <> ''], ' ') as article from pages"
        ),
        "merge_details": of(E.PUBLICATIONS, f"select {cols}, run_id from publications"),
        "merge_latest": of(E.PUBLICATIONS, f"select {cols}, run_id from publications"),
        "apply_details_buckets": of(E.PUBLICATIONS, f"select {cols}, run_id from publications"),
        "apply_details": of(E.PUBLICATIONS, f"select {cols}, run_id from publications"),
        "mark_saved": of(
            marked,
            f"select {saved_cols.format('f.p, e.p')}, x.run_id from publications x "
            "left join by_file e on x.run_id = e.run_id and x.PMCID = e.PMCID "
            "left join by_fetch f on x.run_id = f.run_id and x.PMCID = f.PMCID",
        ),
        "record_paths": of(
            marked,
            f"select {saved_cols.format('f.p, e.p')}, x.run_id from publications x "
            "left join by_file e on x.run_id = e.run_id and x.PMCID = e.PMCID "
            "left join by_fetch f on x.run_id = f.run_id and x.PMCID = f.PMCID",
        ),
        "already_saved_manifest": of(E.FULLTEXT, "select run_id, id, PMCID, PMID, doctitle, url from existing"),
        "already_saved": of(E.FULLTEXT, f"select {target} from existing"),
        "fulltext_targets": of(E.FULLTEXT, f"select {target} from targets"),
        "fulltext_targets_limit": of(
            E.FULLTEXT,
            f"select {target} from (select *, row_number() over (partition by run_id order by id) "
            f"as place from targets) where place <= {TOP_TARGETS}",
        ),
        "new_articles": of(
            E.PUBLICATIONS,
            f"select {', '.join(FLAT)} from flat where PMID is not null "
            "and PMID not in (select PMID from publications)",
        ),
        "new_articles_feed": of(
            E.PUBLICATIONS,
            f"select {', '.join(FLAT)} from flat where PMID is not null "
            f"and page_id < {I.SECOND_CAPTURE} and PMID not in (select PMID from publications)",
        ),
        "has_detail": of(
            E.PUBLICATIONS,
            "select run_id, PMCID, PMID, doctitle from publications where PMCID is not null",
        ),
        "fulltext_eligible": of(
            E.PUBLICATIONS,
            "select run_id, PMCID, PMID, doctitle from publications where PMCID <> ''",
        ),
        "fulltext_urls": of(E.FULLTEXT, "select run_id, id, PMCID, url from eligible"),
        "fulltext_paths": of(E.FULLTEXT, "select run_id, id, doctitle, savepath from eligible"),
        "path_collisions": of(
            E.FULLTEXT,
            "select run_id, savepath, count(*) as n, min(id) as first_id from eligible "
            "group by run_id, savepath having count(*) > 1",
        ),
        "fetch_outcomes": of(E.FULLTEXT, f"select {target}, status from outcomes"),
        "hits_union": of(
            E.HITS,
            "select * from hits union all select * replace ('again' as run_id) from hits",
        ),
        "run_order": of(E.HITS, "select run_id, id, page_no, position, PMID from numbered"),
        "new_articles_state": of(
            E.PUBLICATIONS,
            "select distinct PMID from flat where PMID is not null and PMID not in (select PMID from publications)",
        ),
        "page_summary": of(
            E.PAGES,
            "select run_id, page_no, cast(case when high >= 45 then n else 0 end as bigint) as hits, "
            "cast(case when high < 45 then 1 else 0 end as bigint) as pages_failed from pages_made",
        ),
        "run_summary": of(
            E.PUBLICATIONS,
            "select m.run_id, m.pages, m.pages_failed, m.hits, coalesce(d.details, 0) as details from "
            "(select run_id, count(*) as pages, cast(sum(case when high < 45 then 1 else 0 end) as bigint) "
            "as pages_failed, cast(sum(case when high >= 45 then n else 0 end) as bigint) as hits "
            "from pages_made group by run_id) m left join (select run_id, count(PMCID) as details "
            "from publications group by run_id) d on m.run_id = d.run_id",
        ),
        "run_counts": of(
            E.PAGES,
            "select * from (select run_id, count(*) as pages, "
            "cast(sum(case when high < 45 then 1 else 0 end) as bigint) as pages_failed, "
            "cast(sum(case when high >= 45 then n else 0 end) as bigint) as hits from pages_made group by run_id) "
            "cross join (select count(*) + count(case when p_size <= 10 then 1 end) "
            "+ count(case when p_size > 40 then 1 end) as detail_pages, "
            "count(case when p_size > 40 then 1 end) as detail_pages_failed from part)",
        ),
        "append_hits": of(E.HITS, f"select {bare} from numbered"),
        "create_store": of(E.HITS, "select run_id, count(*) as n from numbered group by run_id"),
        "replace_run": of(
            marked,
            f"select {saved_cols.format('e.p, x.savepath')}, x.run_id from publications x "
            "left join by_file e on x.run_id = e.run_id and x.PMCID = e.PMCID",
        ),
        "store_fulltext": of(
            E.FULLTEXT,
            "select PMCID, savepath, cast(length(url) as bigint) as length, url as content "
            f"from ({fetched})",
        ),
        "export_text": of(E.HITS, f'select {line} as "value" from numbered'),
        "export_report": of(E.PUBLICATIONS, f"select {report} from publications"),
        "export_records": of(E.PUBLICATIONS, f"select {record} from publications"),
        "export_run": of(
            E.PUBLICATIONS,
            f"select {report} from publications "
            "where run_id = (select max(run_id) from publications)",
        ),
        "write_mode": of(E.PUBLICATIONS, f"select {texts} from publications"),
        "drop_run": of(
            E.HITS,
            "select run_id, id, PMID from numbered where run_id <> (select min(run_id) from numbered)",
        ),
        "retain_runs_store": of(
            E.HITS,
            "select run_id, id, PMID from numbered where run_id in "
            f"(select distinct run_id from numbered order by run_id desc limit {LAST_RUNS})",
        ),
        "store_keys": of(E.PUBLICATIONS, "select run_id, PMCID, PMID, doctitle from publications"),
        "store_runs": of(E.HITS, "select distinct run_id from numbered"),
        "retain_runs": of(
            E.HITS,
            "select run_id, id, PMID from numbered where run_id in "
            f"(select distinct run_id from numbered order by run_id desc limit {LAST_RUNS})",
        ),
    }


def queries() -> dict[str, Query]:
    """One entry per operator: name to callable(spark, sf_dir)."""
    return own_queries() | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each query that SQL can express."""
    return own_oracle_sql() | (llm.oracle_sql() if llm else {})
