"""Article pages to detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.functions import markup as M
from litframe.functions.text import blank_to_null, decode_entities, squeeze, strip

# Where an article page keeps each field.
IDENTIFIERS = (None, "id", "full-view-identifiers")
CURRENT_ID = ("strong", "class", "current-id")
PMC_SPAN = ("span", "class", "identifier pmc")
DOI_SPAN = ("span", "class", "identifier doi")
ID_LINK = ("a", "class", "id-link")
AUTHOR_GROUP = ("div", "class", "expanded-authors")
AFFILIATION = ("li", "data-affiliation-id")
ARTICLE_PAGE = ("div", "id", "article-page")
ARTICLE_DETAILS = ("main", "id", "article-details")
ABSTRACT_BLOCK = ("div", "id", "abstract")
PLAIN_ABSTRACT = ("div", "id", "eng-abstract")
SECTION_HEAD = ("strong", "class", "sub-title")
LINK_BOX = ("div", "class", "full-text-links")
LINK_LIST = ("div", "class", "full-text-links-list")


def _blocks(html: Column) -> dict[str, Column]:
    """The parts of a page that hold fields, each cut once by one pattern."""
    ids = M.open_tag("ul", *IDENTIFIERS[1:])
    own_list = M.content_of(html, ids, "ul")
    abstract_path = (
        M.open_tag(*ARTICLE_PAGE) + M.after(M.open_tag(*ARTICLE_DETAILS))
        + M.after(M.open_tag(*ABSTRACT_BLOCK))
    )
    return {
        "list": own_list,
        "ids": F.when(own_list != "", own_list).otherwise(M.first_inner(html, M.open_tag(*IDENTIFIERS))),
        "pmc": M.all_inner(html, M.open_tag(*PMC_SPAN)),
        "authors": M.content_of(html, M.open_tag(*AUTHOR_GROUP), "div"),
        "abstract": M.content_of(html, abstract_path, "div"),
        # paragraphs right in the block count, those of a division in it do not
        "plain": M.without(M.content_of(html, M.open_tag(*PLAIN_ABSTRACT), "div"), "div"),
        "link": M.child_attribute(
            html, M.open_tag(*LINK_BOX) + M.after(M.open_tag(*LINK_LIST)), M.open_tag("a", "href"), "href"
        ),
    }


def _pmc_links(spans: Column) -> Column:
    links = F.flatten(F.transform(spans, lambda s: M.all_inner(s, M.open_tag(*ID_LINK))))
    return F.flatten(F.transform(links, M.direct_texts))


def _pmcid(texts: Column) -> Column:
    named = F.filter(texts, lambda t: F.contains(t, F.lit("PMC")))
    return F.coalesce(strip(F.get(named, F.lit(0))), F.lit(""))


def _affiliation_texts(authors: Column) -> Column:
    items = M.all_inner(authors, M.open_tag(*AFFILIATION), M.until(r"</?(?i:li|ul)(?=[\s/>])"))
    return F.flatten(F.transform(items, M.direct_texts))


def _numbered(texts: Column) -> Column:
    return F.transform(
        texts,
        lambda t, i: F.concat(
            (i + 1).cast("string"), F.lit("."), strip(squeeze(strip(t), by=""))
        ),
    )


def _sections(block: Column) -> Column:
    """Paragraphs of the abstract that have a heading: (headings, whole text)."""
    head = f"{M.open_tag(*SECTION_HEAD)}({M.TEXT})"

    def heads(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(head), F.lit(1))
        return F.struct(found.alias("heads"), p.alias("p"))

    def section(s: Column) -> Column:
        # headings and text nodes are decoded together, headings first
        raw = F.concat(s["heads"], F.split(s["p"], M.ANY_TAG))
        encoded = F.contains(s["p"], F.lit("&"))
        texts = F.when(encoded, F.transform(raw, decode_entities)).otherwise(raw)
        return F.struct(F.size(s["heads"]).alias("n"), texts.alias("texts"))

    def whole(s: Column) -> Column:
        texts = F.transform(F.slice(s["texts"], s["n"] + 1, F.size(s["texts"])), strip)
        text = F.array_join(F.filter(texts, lambda t: t != ""), " ")
        heads = F.array_join(F.slice(s["texts"], 1, s["n"]), "\n")
        return F.struct(heads.alias("heads"), squeeze(text).alias("text"))

    # the text of a paragraph is put together only if it can be a section
    headed = F.filter(F.transform(M.paragraphs(block), heads), lambda s: F.size(s["heads"]) > 0)
    return F.transform(F.transform(headed, section), whole)


def _part(sections: Column, name: str) -> Column:
    """Text of the last paragraph with a heading that contains ``name``."""
    own = F.filter(sections, lambda s: F.contains(s["heads"], F.lit(name)))
    return F.coalesce(F.try_element_at(own, F.lit(-1))["text"], F.lit(""))


def _plain_text(block: Column) -> Column:
    # paragraphs after the first that has a text of its own are not looked into
    first = F.aggregate(
        M.paragraphs(block), F.lit(None).cast("string"),
        lambda found, p: F.coalesce(found, F.get(M.direct_texts(p), F.lit(0))),
    )
    return F.coalesce(first, F.lit(""))


def extract_details(captures: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per captured article page (``DETAIL``); failed pages give none.

    ``captures``: html and the columns to ``keep``. No shuffle. The cleaned page
    comes out of a generator, through which no filter is pushed: a filter on a
    field costs that field once more, not the cleaning of the page. A page without its own identifier
    keeps a NULL PMID and so takes no part in a merge.
    """
    cleaned = captures.where(F.col("html").isNotNull()).select(
        *keep, F.explode(F.array(M.clean_markup(F.col("html")))).alias("html")
    )
    cut = cleaned.select(
        *keep, *[c.alias(name) for name, c in _blocks(F.col("html")).items()]
    )
    ids = F.col("ids")
    texts = {
        "PMID": M.first_text(ids, M.open_tag(*CURRENT_ID)),
        # only identifiers in a ``ul`` count here
        "doi": M.child_text(F.col("list"), M.open_tag(*DOI_SPAN), M.open_tag(*ID_LINK)),
        "link": F.col("link"),
        "plain": _plain_text(F.col("plain")),
    }
    lists = {
        "pmc": _pmc_links(F.col("pmc")),
        "affiliations": _affiliation_texts(F.col("authors")),
    }
    # single texts and lists of texts are decoded in one step each
    read = cut.select(
        *keep,
        F.transform(F.array(*texts.values()), decode_entities).alias("texts"),
        F.transform(
            F.array(*lists.values()), lambda found: F.transform(found, decode_entities)
        ).alias("lists"),
        _sections(F.col("abstract")).alias("sections"),
    )
    text = {name: F.get("texts", F.lit(i)) for i, name in enumerate(texts)}
    found = {name: F.get("lists", F.lit(i)) for i, name in enumerate(lists)}
    parts = [_part(F.col("sections"), name).alias(name.lower()) for name in S.SECTIONS]
    plain = strip(squeeze(text["plain"])).alias("abstract")
    return read.select(
        *keep,
        blank_to_null(text["PMID"]).alias("PMID"),
        _pmcid(found["pmc"]).alias("PMCID"),
        strip(text["doi"]).alias("doi"),
        F.struct(*parts, plain).alias("abstract"),
        _numbered(found["affiliations"]).alias("affiliations"),
        text["link"].alias("full_text_link"),
    ).select(
        *keep, "PMID", "PMCID", "doi", "abstract",
        F.col("abstract.keywords").alias("keyword"), "affiliations", "full_text_link",
    )


def abstract_full(abstract: Column) -> Column:
    """The seven abstract parts as one text: non-empty ones, one per line."""
    parts = [blank_to_null(strip(abstract[name.lower()])) for name in S.SECTIONS]
    plain = blank_to_null(strip(abstract["abstract"]))
    return F.concat_ws("\n", *parts, F.concat(F.lit("Abstract: "), plain))


def affiliations_text(affiliations: Column) -> Column:
    return F.array_join(affiliations, "\n")


def flat_details(details: DataFrame) -> DataFrame:
    """Details as they are stored: abstract and affiliations as single texts."""
    return details.select(
        "page_id", "PMID", "PMCID", "doi",
        abstract_full(F.col("abstract")).alias("abstract"),
        affiliations_text(F.col("affiliations")).alias("affiliations"),
        "keyword", "full_text_link",
    )
