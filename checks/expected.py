"""Expected results as DuckDB SQL, from the source columns.

No markup is parsed here: each field is what went into the page, so the SQL is
independent of the extraction it checks.
"""

from __future__ import annotations

RUN = "'202412' || lpad(cast(length(p_type) as varchar), 2, '0') || '120000'"
TITLE = """p_name || p_brand || p_type || ': 1/2 "x"?'"""
PATH = (
    "'/library/pub/' || regexp_replace(doctitle, '[< >/\\\\|:\"*?]', ' ', 'g') || '.pdf'"
)
SPACE = "' ' || chr(9) || chr(10) || chr(13)"
PLAIN = (
    "trim(regexp_replace(coalesce(text, 'none'), '\\s{2,}', ' ', 'g'), " + SPACE + ")"
)

def rendered(sql: str) -> str:
    """The rendering of captures in DuckDB's dialect."""
    for spark, duck in (
        ("\\'", "''"), ("p_partkey div ", "p_partkey // "),
        ("format_number(n * 1000 + page_no, 0)", "format('{:,}', n * 1000 + page_no)"),
        (
            "array_join(transform(array_sort(collect_list(struct(p_partkey, block))), b -> b.block), '\n')",
            "string_agg(block, chr(10) order by p_partkey)",
        ),
    ):
        sql = sql.replace(spark, duck)
    return sql


PAGES = f"""
parts as (
  select *, {RUN} as run_id, cast(p_partkey // 50 + 1 as integer) as page_no,
    cast((p_partkey // 50 + 1) * 100 + length(p_type) as bigint) as page_id
  from part),
pages_made as (
  select run_id, page_no, page_id, count(*) as n, min(p_size) as low, max(p_size) as high
  from parts group by run_id, page_no, page_id)"""

HITS = f"""{PAGES},
hits as (
  select p.run_id, p.page_no, p.page_id,
    cast(row_number() over (partition by p.run_id, p.page_no order by p_partkey) as integer) as position,
    {TITLE} as doctitle,
    case when p_size <= 45 then p_name || ' A, et al.' else '' end as short_author,
    p_name || ' A & Co, ' || p_brand || ' B.' as full_author,
    p_type || '. 2024.' as short_journal,
    p_type || '. 2024 Dec;' || cast(p_size as varchar) || '.' as full_journal,
    case when p_size = 50 then ''
         when p_name like 'red%' then cast(p_partkey // 10 * 10 as varchar)
         else cast(p_partkey as varchar) end as PMID,
    case when p_size <= 15 then 'FreePMCArticle' when p_size <= 30 then 'FreeArticle'
         else 'None' end as freemark,
    p_brand like '%5' as reviewmark
  from parts p join pages_made m on p.run_id = m.run_id and p.page_no = m.page_no
  where m.high >= 45),
numbered as (
  select cast(row_number() over (partition by run_id order by page_no, position) as bigint) as id, *
  from hits)"""

DETAILS = f"""
captured as (
  select *, p_partkey as page_id, 1 as turn from part
  union all
  select *, p_partkey + 1000000000000 as page_id, 2 as turn from part where p_size <= 10),
parsed as (
  select c.*,
    case when p_brand <> 'Brand#7' then cast(p_partkey as varchar) end as PMID,
    case when p_size <= 20 then 'PMC' || cast(p_partkey as varchar) else '' end as PMCID,
    case when p_name not like 'blue%'
         then '10.1000/' || cast(p_partkey as varchar) || '.' || cast(turn as varchar) else '' end as doi,
    p_type in ('ECONOMY', 'PROMO', 'LARGE') as plain,
    {PLAIN} as plain_text,
    'Keywords: ' || p_brand || '; ' || p_type || '.' as keyword,
    '1.' || p_brand || ', Dept.of ' || p_type || '.' || chr(10)
      || '2.' || p_name || ' Institute.' as affiliations,
    'https://example.org/ft/?a=1&id=' || cast(p_partkey as varchar) as full_text_link
  from captured c left join documents on doc_id = p_partkey),
details as (
  select page_id, PMID, PMCID, doi,
    case when plain then '' else 'Background: ' || p_name || ' text.' end as background,
    case when plain then '' when p_type = 'SMALL' then 'Methods and Results: ' || p_type
         else 'Methods: ' || p_type end as methods,
    case when plain then '' when p_type = 'SMALL' then 'Methods and Results: ' || p_type
         else 'Results: ' || p_brand || ' < 5' end as results,
    case when plain then '' else trim('Conclusions: ' || plain_text) end as conclusions, '' as registration, keyword as keywords,
    case when plain then plain_text else '' end as abstract,
    keyword, affiliations, full_text_link
  from parsed),
flat as (
  select page_id, PMID, PMCID, doi,
    concat_ws(chr(10), nullif(background, ''), nullif(methods, ''), nullif(results, ''),
      nullif(conclusions, ''), nullif(keywords, ''), 'Abstract: ' || nullif(abstract, '')) as abstract,
    affiliations, keyword, full_text_link
  from details)"""

PUBLICATIONS = f"""{HITS},{DETAILS},
latest as (
  select * from (
    select *, row_number() over (partition by PMID order by page_id desc) as rn
    from flat where PMID is not null) where rn = 1),
publications as (
  select n.id, n.doctitle, n.full_author, n.short_author, n.full_journal, n.short_journal,
    d.doi, n.PMID, d.PMCID, d.abstract, d.keyword, d.affiliations, n.freemark, n.reviewmark,
    cast(null as varchar) as savepath, n.run_id
  from numbered n left join latest d on n.PMID = d.PMID)"""

FULLTEXT = f"""{PUBLICATIONS},
eligible as (
  select run_id, id, PMCID, PMID, doctitle, {PATH} as savepath,
    'http://www.ncbi.nlm.nih.gov/pmc/articles/' || PMCID || '/pdf/main.pdf' as url
  from publications where PMCID <> ''),
files as (
  select distinct {PATH} as savepath from (
    select {TITLE} as doctitle from part
    where p_brand in ('Brand#1', 'Brand#2', 'Brand#3'))),
existing as (select * from eligible where savepath in (select savepath from files)),
targets as (select * from eligible where savepath not in (select savepath from files)),
outcomes as (
  select *, case when doctitle not like 'blue%' and doctitle not like 'small%'
    then 'saved' else 'failed' end as status
  from targets)"""

REQUESTS = """
requests as (
  select c_custkey as request_id,
    case c_nationkey when 5 then cast(c_custkey as varchar) when 6 then '   ' when 7 then ''
      when 8 then null else c_mktsegment || ' AND c~*é/+ ' || c_name end as keyword,
    case c_nationkey when 1 then 1 when 2 then 5 when 3 then 10 when 4 then 7 end as "year",
    coalesce(case when c_nationkey <> 9 then c_nationkey end, 10) as page_limit,
    10 as download_limit, cast(floor(abs(c_acctbal)) as integer) as result_num,
    c_nationkey not in (4, 5, 6) as valid,
    case c_nationkey when 4 then 'year' when 5 then 'numeric' when 6 then 'whitespace' end as reason
  from customer),
encoded as (
  select *, concat_ws('&',
    case when keyword <> '' then 'term=' || replace(url_encode(keyword), '%20', '+') end,
    case when "year" is not null then 'filter=datesearch.y_' || cast("year" as varchar) end,
    'size=50') as params
  from requests)"""

PUBLICATION_COLUMNS = (
    "id, doctitle, full_author, short_author, full_journal, short_journal, doi, PMID, PMCID, "
    "abstract, keyword, affiliations, freemark, reviewmark, savepath"
)


def of(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select}"
