"""Captured pages, requests and files, rendered in SQL from the given tables.

Every row of a source table takes part. Which variant of markup a row gets is
decided by its own values (size, type, brand, name), never by a row limit.
"""

from __future__ import annotations

from itertools import count

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.sources.captures import parse_tasks, spread_captures
from litframe.sources.scratch import stage

DIRECTORY = "/library/pub"
SPREAD = 16  # tasks that rendered pages are dealt to at least
SECOND_CAPTURE = 1_000_000_000_000  # page_id offset of a later capture

SEARCH_SQL = """
with hit as (
  select p_partkey, p_size, p_name,
    '202412' || lpad(cast(length(p_type) as string), 2, '0') || '120000' as run_id,
    cast(p_partkey div 50 + 1 as int) as page_no, length(p_type) as kind,
    '<div class="docsum-content"><a class="docsum-title" href="/' || p_partkey || '/">\n'
    || '  ' || p_name || ' <b>' || p_brand || '</b> ' || p_type || ': 1/2 &quot;x&quot;?'
    || case when p_name like 'hot%' then ' <i>dropped</i>' else '' end || '\n</a>'
    || '<span class="docsum-authors full-authors">' || repeat('<i>', deep) || repeat('</i>', deep) || p_name || ' A &amp; Co, ' || p_brand || ' B.</span>'
    || case when p_size <= 45 then '<span class="docsum-authors short-authors">' || p_name || ' A, et al.</span>' else '' end
    || '<span class="docsum-journal-citation full-journal-citation">' || p_type || '. 2024 Dec;' || p_size || '.</span>'
    || '<span class=\\'docsum-journal-citation short-journal-citation\\'>' || p_type || '. 2024.</span>'
    || case when p_size < 50 then '<span class="docsum-pmid">' || repeat('<i>', deep) || case when deep > 0 then 'no' else '' end || repeat('</i>', deep)
         || case when p_name like 'red%' then p_partkey div 10 * 10 else p_partkey end || '</span>' else '' end
    || case when p_size <= 15 then '<span class="free-resources spaced-citation-item citation-part">Free PMC article.</span>'
            when p_size <= 30 then '<span class="free-resources spaced-citation-item citation-part">Free article.</span>'
            when p_size <= 35 then '<span class="free-resources spaced-citation-item citation-part">Free full text</span>'
            else '' end
    || case when p_brand like '%5' then '<span class="publication-type spaced-citation-item citation-part">Review.</span>' else '' end
    || '</div>' as block
  from (select *, case when p_size = 11 then 7 when p_size = 12 then 50 else 0 end as deep from part) p
), page as (
  select run_id, page_no, cast(page_no as bigint) * 100 + max(kind) as page_id,
    count(*) as n, min(p_size) as low, max(p_size) as high,
    array_join(transform(array_sort(collect_list(struct(p_partkey, block))), b -> b.block), '\n') as blocks
  from hit group by run_id, page_no
)
select run_id, page_no, page_id,
  'https://example.org/?term=' || run_id || '&size=50&page=' || page_no as url,
  case when high >= 45 then
    '<!DOCTYPE html><html><head><style>p{margin:0}</style><script>var t="<div class=\\'docsum-content\\'>";</script></head>'
    || '<body><!-- <div class="docsum-content">old</div> --><div id="search-results"><section class="search-results-list">'
    || '<div class="results-amount">'
    || case when low <= 2 then '<span class="value">' || format_number(n * 1000 + page_no, 0) || '</span>' else '' end
    || '</div>' || blocks || '</section></div><div><span class="docsum-pmid">999</span>'
    || '<span class="publication-type spaced-citation-item citation-part">Review.</span></div></body></html>' end as html,
  high < 45 as failed
from page
"""

ARTICLE_SQL = """
with capture as (
  select p.*, p_partkey as page_id, 1 as turn from part p
  union all
  select p.*, p_partkey + {second} as page_id, 2 as turn from part p where p_size <= 10
  union all
  select p.*, p_partkey + 2 * {second} as page_id, 3 as turn from part p where p_size > 40
), told as (
  select *, replace(replace(replace(coalesce(text, 'none'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as told,
    case when p_size = 21 then 7 when p_size = 22 then 50 else 0 end as deep
  from capture left join documents on doc_id = p_partkey
)
select page_id, 'https://example.org/' || p_partkey as url,
  case when turn < 3 then
  '<html><body><div id="article-page"><main class="article-details" id="article-details">'
  || '<div class="expanded-authors"><ul><li data-affiliation-id="a1"><sup class="key">1</sup> ' || p_brand || ', Dept.  of ' || p_type || '. </li>'
  || repeat('<div>', deep) || repeat('</div>', deep) || '<li data-affiliation-id="a2"><sup class="key">2</sup> ' || p_name || ' Institute.</li></ul></div>'
  || case when p_size < 30 then '<div class="expanded-authors"><ul><li data-affiliation-id="a1">repeated group</li></ul></div>'
       else '<div><ul><li data-affiliation-id="a1">elsewhere</li></ul></div>' end
  || '<ul id="full-view-identifiers">' || case when p_size > 23 then '<li><ul><li>nested</li></ul></li>' else '' end || '<li><span class="identifier own">'
  || case when p_brand <> 'Brand#7' then '<strong class="current-id">' || repeat('<b>', deep) || case when deep > 0 then '0' else '' end || repeat('</b>', deep) || p_partkey || '</strong>' else '' end || '</span></li>'
  || case when p_size <= 20 then '<li><span class="identifier pmc"><a class="id-link" href="#"> PMC' || p_partkey || ' </a></span></li>' else '' end
  || case when p_name not like 'blue%' then '<li><span class="identifier doi"><a class="id-link" href="#"> 10.1000/' || p_partkey || '.' || turn || ' </a></span></li>' else '' end
  || '</ul><div class="abstract" id="abstract"><div class="abstract-content" id="eng-abstract">'
  || case when p_type in ('ECONOMY', 'PROMO', 'LARGE')
       then case when p_size > 25 then '<div class="note"><p>a note</p></div>' else '' end || '<p>\n' || told || '\n</p>'
       else '<p>\n<strong class="sub-title">Background:</strong>\n' || p_name || '  text.</p>'
         || case when p_type = 'SMALL'
              then '<p>\n<strong class="sub-title">Methods and Results:</strong> ' || p_type || '</p>'
              else '<p>\n<strong class="sub-title">Methods:</strong> <i>' || p_type || '</i></p>'
                || '<p>\n<strong class="sub-title">Results:</strong> ' || p_brand || ' &lt; 5</p>' end
         || '<p><strong class="sub-title">Conclusions:</strong> ' || repeat('<i>', deep) || told || repeat('</i>', deep) || '</p>' end
  || '</div><p><strong class="sub-title">Keywords:</strong> ' || p_brand || '; ' || p_type || '.</p></div>'
  || '<div class="similar"><p><strong class="sub-title">Results:</strong> of another article</p></div>'
  || '</main><aside><div class="full-text-links"><div class="full-text-links-list"><a href="https://example.org/ft/?a=1&amp;id='
  || p_partkey || '">x</a></div></div></aside></div></body></html>' end as html
from told
"""

REQUEST_SQL = """
select c_custkey as request_id,
  case c_nationkey when 5 then cast(c_custkey as string) when 6 then '   ' when 7 then '' when 8 then null
    else c_mktsegment || ' AND c~*é/+ ' || c_name end as keyword,
  case c_nationkey when 1 then 1 when 2 then 5 when 3 then 10 when 4 then 7 end as year,
  case when c_nationkey <> 9 then c_nationkey end as page_limit,
  cast(floor(abs(c_acctbal)) as int) as result_num
from customer
"""

FILE_SQL = """
select 'file:/library/pub/'
    || regexp_replace(p_name || p_brand || p_type || ': 1/2 "x"?', '[< >/\\\\\\\\|:"*?]', ' ')
    || '.pdf' as path,
  cast(p_partkey as bigint) as length
from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3')
"""


def spread(captures: DataFrame) -> DataFrame:
    """Rendered pages, which come in few splits, dealt out to be parsed."""
    return spread_captures(captures, parse_tasks(captures.sparkSession, SPREAD))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    # one frame per table name; no view is left in the session
    frames = {name: table(spark, sf_dir, name) for name in names}
    text = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = text.replace(f"from {name}", f"from {{{name}}}")
        text = text.replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(text, **frames)


_STAGED: dict[tuple, DataFrame] = {}


def _staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build an input once per session and keep it as a table in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def search_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(
        spark, sf_dir, "search", lambda: _sql(spark, sf_dir, SEARCH_SQL, "part")
    )


def article_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ARTICLE_SQL.replace("{second}", str(SECOND_CAPTURE))
    return _staged(
        spark, sf_dir, "article", lambda: _sql(spark, sf_dir, text, "part", "documents")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REQUEST_SQL, "customer")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FILE_SQL, "part")


def write_library(names: DataFrame, folder: str, digits: int) -> None:
    """A file for each ``name``, in the folder of ``digits`` hex digits it belongs to."""

    def write(batches):
        disk, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for place, name in zip(batch.column("place").to_pylist(), batch.column("name").to_pylist()):
                disk.create_dir(f"{base}/{place}")
                with disk.open_output_stream(f"{base}/{place}/{name}") as out:
                    out.write(name.encode())
            yield batch

    place = F.left(F.md5(F.encode("name", "UTF-8")), F.lit(digits)).alias("place")
    placed = names.distinct().select("name", place)
    placed.mapInArrow(write, placed.schema).write.format("noop").mode("overwrite").save()


def write_files(lines: DataFrame, folder: str, suffix: str) -> None:
    """A file for each row of the one column: its text and a line end; NULL is an empty line."""

    def write(batches):
        disk, base = fs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        # a task that is run again writes over its files
        names = (f"{base}/{TaskContext.get().partitionId()}-{n}{suffix}" for n in count())
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), names):
                with disk.open_output_stream(name) as out:
                    out.write(f"{text or ''}\n".encode())
            yield batch.slice(0, 0)

    lines.mapInArrow(write, lines.schema).write.format("noop").mode("overwrite").save()


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hits, as a search run leaves them."""
    from litframe.operators.hits import extract_hits

    return _staged(
        spark, sf_dir, "hits", lambda: extract_hits(spread(search_captures(spark, sf_dir)))
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records, as the enrichment of a run leaves them."""
    from litframe.operators.details import extract_details, flat_details
    from litframe.operators.merge import merge_details
    from litframe.operators.ordering import with_run_order

    def build() -> DataFrame:
        articles = spread(article_captures(spark, sf_dir))
        details = flat_details(extract_details(articles))
        return merge_details(with_run_order(hits(spark, sf_dir)), details)

    return _staged(spark, sf_dir, "publications", build)


def fetched(targets: DataFrame) -> DataFrame:
    """What an outside fetcher brings back: content, NULL, or no row at all."""
    content = F.when(~F.col("doctitle").startswith("blue"), F.encode(F.col("url"), "UTF-8"))
    return targets.where(~F.col("doctitle").startswith("small")).select(
        "run_id", "id", "PMCID", "savepath", content.alias("content")
    )
