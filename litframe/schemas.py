"""Record types, fixed column orders and constants."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# Names of the abstract sections, in output order.
SECTIONS = ("Background", "Methods", "Results", "Conclusions", "Registration", "Keywords")

# Full-text marks of a search hit.
FREE_PMC, FREE, NOT_FREE = "FreePMCArticle", "FreeArticle", "None"

# Addresses, page size, batch sizes, defaults.
SEARCH_BASE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
FULLTEXT_BASE_URL = "http://www.ncbi.nlm.nih.gov/"
PAGE_SIZE = 50
DETAIL_BATCH = 50
FULLTEXT_BATCH = 5
DEFAULT_PAGE_LIMIT = 10
DEFAULT_DOWNLOADS = 10
YEAR_CHOICES = (1, 5, 10)
FULLTEXT_DIR = "./document/pub"

# Characters a file name must not hold.
FILE_NAME_CHARS = r"""[< >/\\|:"*?]"""

CAPTURES = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("page_no", T.IntegerType()),
     T.StructField("page_id", T.LongType()), *_strings("url", "html")]
)

HIT = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("page_no", T.IntegerType()),
     T.StructField("page_id", T.LongType()), T.StructField("position", T.IntegerType()),
     *_strings("doctitle", "short_author", "full_author", "short_journal", "full_journal",
               "PMID", "freemark"),
     T.StructField("reviewmark", T.BooleanType())]
)

ABSTRACT = T.StructType(_strings(*[s.lower() for s in SECTIONS], "abstract"))

DETAIL = T.StructType(
    [T.StructField("page_id", T.LongType()), *_strings("PMID", "PMCID", "doi"),
     T.StructField("abstract", ABSTRACT), *_strings("keyword"),
     T.StructField("affiliations", T.ArrayType(T.StringType())),
     *_strings("full_text_link")]
)

# The stored record. ``id`` is BIGINT: a run may hold more rows than an INT counts.
PUBLICATION = T.StructType(
    [T.StructField("id", T.LongType()),
     *_strings("doctitle", "full_author", "short_author", "full_journal", "short_journal",
               "doi", "PMID", "PMCID", "abstract", "keyword", "affiliations", "freemark"),
     T.StructField("reviewmark", T.BooleanType()), *_strings("savepath", "run_id")]
)
PUBLICATION_COLUMNS = tuple(PUBLICATION.names[:-1])  # the 15 columns of one run

# Report headings, in stored column order.
REPORT_HEADINGS = {
    "id": "序号",
    "doctitle": "文献标题",
    "full_author": "作者全名",
    "short_author": "作者简名",
    "full_journal": "期刊全名",
    "short_journal": "期刊简名",
    "doi": "doi",
    "PMID": "PMID",
    "PMCID": "PMCID",
    "abstract": "摘要",
    "keyword": "关键词",
    "affiliations": "作者单位",
    "freemark": "是否有免费全文",
    "reviewmark": "是否是review",
    "savepath": "保存路径",
}

# Keys of an exported record, in order, and the columns they come from.
RECORD_KEYS = {
    "doctitle": "doctitle",
    "short_author": "short_author",
    "full_author": "full_author",
    "short_journal": "short_journal",
    "full_journal": "full_journal",
    "doi": "doi",
    "pmid": "PMID",
    "pmcid": "PMCID",
    "abstract": "abstract",
    "keyword": "keyword",
    "affiliations": "affiliations",
    "freemark": "freemark",
    "reviewmark": "reviewmark",
    "savepath": "savepath",
}

#: What the steps of a run count.
RUN_COUNTS = ("pages", "pages_failed", "hits", "detail_pages", "detail_pages_failed")
