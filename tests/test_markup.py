"""Extraction rules: edge rows by hand, and whole pages against a tree walker."""

import random
import re

import pytest
import walker

from checks import inputs
from litframe.functions import markup as M
from litframe.functions import text as X
from litframe.operators.details import abstract_full, extract_details
from litframe.operators.hits import extract_hits, result_counts
from litframe.operators.pages import extract_pages
from pyspark.sql import functions as F

SEARCH = "run_id string, page_no int, page_id long, url string, html string"
ARTICLE = "page_id long, url string, html string"


def search(spark, *pages):
    rows = [("r", i, i, None, html) for i, html in enumerate(pages, 1)]
    return spark.createDataFrame(rows, SEARCH)


def article(spark, *pages):
    return spark.createDataFrame([(i, None, h) for i, h in enumerate(pages, 1)], ARTICLE)


def column(spark, values, use):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(use(F.col("x"))).collect()]


def hit(title="", rest=""):
    return f'<div class="docsum-content"><a class="docsum-title">{title}</a>{rest}</div>'


def abstract_page(inner, plain=""):
    return (
        '<html><body><div id="article-page"><main id="article-details">'
        f'<div id="abstract"><div id="eng-abstract">{plain}</div>{inner}</div>'
        "</main></div></body></html>"
    )


# ---- text helpers ------------------------------------------------------------


def test_strip_and_squeeze_know_all_white_space(spark):
    odd = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert column(spark, [f"{odd}a b{odd}", odd, ""], X.strip) == ["a b", "", ""]
    assert column(spark, ["a  b\n\nc d", "a \xa0b"], X.squeeze) == ["a b c d", "a b"]
    assert column(spark, ["a  b"], lambda c: X.squeeze(c, "")) == ["ab"]


def test_entities(spark):
    given = ["&lt;a&gt; &amp;amp; &eacute;&#233;&#xE9; &#x4e2d;", "a & b &nosuch; &amp x", "&#0;",
             "&#1114112;", "&#55296;", "", None, "&", "&&amp;", "&nbsp;x", "&#65 b"]
    want = ["<a> &amp; ééé 中", "a & b &nosuch; &amp x", "&#0;", "&#1114112;", "&#55296;", "",
            None, "&", "&&", "\xa0x", "A b"]
    assert column(spark, given, X.decode_entities) == want


def test_text_nodes_know_depth_and_tag(spark):
    rows = column(spark, ["a<b>c<br>d<i>e</i></b>f</u>g"], M.text_nodes)[0]
    assert [tuple(r) for r in rows] == [
        (0, None, "a"), (1, "b", "c"), (1, "b", "d"), (2, "i", "e"), (0, None, "f"),
        (0, None, "g"),
    ]


def test_exact_attribute_values(spark):
    tag = M.open_tag("div", "class", "x y")
    given = ['<div class="x y">', "<DIV CLASS='x y' id=1>", '<div id="a>b" class = "x y">',
             '<div class="y x">', '<div class="x y z">', '<div data-class="x y">',
             '<span class="x y">', '<divx class="x y">', '<div title=\'class="x y"\'>']
    got = column(spark, given, lambda c: c.rlike(tag))
    assert got == [True, True, True, False, False, False, False, False, False]


def test_comments_scripts_and_styles_leave_a_gap(spark):
    given = ['a<!-- <p>x --> b', '<script>var t="</p>";</script>c', "<STYLE>p{}</STYLE >d",
             "a<!--" * 50000, "a<script>" * 50000, "<scripted>x</scripted>"]
    assert column(spark, given, M.clean_markup) == [
        "a<!----> b", "<!---->c", "<!---->d", "a<!---->", "a<!---->", "<scripted>x</scripted>"]


# ---- search pages ------------------------------------------------------------


@pytest.mark.parametrize(
    "title, want",
    [
        ("Foo <b>bar<i>no</i></b> baz <i><b>yes</b></i>", "Foobarbazyes"),
        ("  A <b> b </b>\n c ", "Abc"),
        ("x<sup>2</sup> y", "xy"),
        ("a &lt;b&gt; &amp; c", "a <b> & c"),
        ("p < 0.05 &#8211; q", "p < 0.05 – q"),
        ("a<!-- c -->b", "ab"),
        ("", ""),
    ],
)
def test_title(spark, title, want):
    row = extract_hits(search(spark, hit(title))).first()
    assert row.doctitle == want


def test_title_separator(spark):
    row = extract_hits(search(spark, hit("A <b>b</b> c")), title_sep=" ").first()
    assert row.doctitle == "A b c"


def test_missing_fields_are_empty(spark):
    row = extract_hits(search(spark, hit("t"))).first()
    fields = ("short_author", "full_author", "short_journal", "full_journal", "PMID")
    assert [row[f] for f in fields] == [""] * 5
    assert row.freemark == "None" and row.reviewmark is False


def test_quotes_and_leading_children(spark):
    rest = ("<span class='docsum-pmid'>7</span>"
            '<span class="docsum-authors full-authors"><b>x</b> Doe J</span>')
    row = extract_hits(search(spark, hit("t", rest).replace('"docsum-content"', "'docsum-content'")))
    assert row.first().PMID == "7" and row.first().full_author == " Doe J"


@pytest.mark.parametrize(
    "mark, want",
    [("Free PMC article.", "FreePMCArticle"), ("Free article.", "FreeArticle"),
     ("Free full text", "None"), ("", "None")],
)
def test_free_mark(spark, mark, want):
    span = f'<span class="free-resources spaced-citation-item citation-part">{mark}</span>'
    assert extract_hits(search(spark, hit("t", span))).first().freemark == want


def test_bad_pages_give_no_hits(spark):
    pages = search(spark, None, "", "<p>none</p>", hit("a") + hit("b"))
    rows = extract_hits(pages).orderBy("position").collect()
    assert [(r.page_no, r.position, r.doctitle) for r in rows] == [(4, 1, "a"), (4, 2, "b")]


def test_hits_in_comments_do_not_count(spark):
    assert extract_hits(search(spark, f"<!-- {hit('a')} -->{hit('b')}")).count() == 1


def test_result_count(spark):
    page = ('<div id="search-results"><section class="search-results-list">{}</section></div>'
            '<span class="value">9</span>')
    value = '<div><span class="value"> 1,234 </span><span class="value">5</span></div>'
    frame = search(spark, page.format(value), page.format(""), "<p></p>",
                   page.format('<span class="value">many</span>'))
    assert [r.n for r in result_counts(frame).orderBy("page_id").collect()] == [
        1234, None, None, None]


# ---- article pages -----------------------------------------------------------


def parts(spark, page):
    return extract_details(article(spark, page)).first().abstract


def para(head, text):
    return f'<p><strong class="sub-title">{head}</strong>{text}</p>'


def test_last_matching_section_wins(spark):
    got = parts(spark, abstract_page(para("Results:", " one") + para("Results:", " two")))
    assert got.results == "Results: two"


def test_section_names_are_case_sensitive(spark):
    assert parts(spark, abstract_page(para("background:", " x"))).background == ""


def test_one_section_may_fill_two_parts(spark):
    got = parts(spark, abstract_page(para("Methods and Results:", " x")))
    assert got.methods == got.results == "Methods and Results: x"


def test_heading_must_be_leading_text(spark):
    got = parts(spark, abstract_page('<p><strong class="sub-title"><b>Methods</b></strong> x</p>'))
    assert got.methods == ""


def test_plain_abstract_is_first_direct_text(spark):
    assert parts(spark, abstract_page("", para("Background:", " t"))).abstract == "t"
    assert parts(spark, abstract_page("", "<p>\n<b>x</b> t</p>")).abstract == ""
    assert parts(spark, abstract_page("", "<p> a  b\nc </p><p>d</p>")).abstract == "a b\nc"
    assert parts(spark, abstract_page("", "<p><b>x</b></p><p>d</p>")).abstract == "d"


def test_unclosed_paragraphs(spark):
    inner = '<p><strong class="sub-title">Methods:</strong> a<p>b'
    assert parts(spark, abstract_page(inner)).methods == "Methods: a"


def test_abstract_needs_its_ancestors(spark):
    page = abstract_page(para("Methods:", " a")).replace('id="article-details"', "")
    assert parts(spark, page).methods == ""


def test_full_abstract_text(spark):
    page = abstract_page(para("Methods:", " m") + para("Background:", " b"), "<p>plain</p>")
    frame = extract_details(article(spark, page)).select(abstract_full(F.col("abstract")))
    assert frame.first()[0] == "Background: b\nMethods: m\nAbstract: plain"


def test_pmc_links_without_pmc(spark):
    page = ('<span class="identifier pmc"><a class="id-link">X1</a></span>'
            '<span class="identifier pmc"><a class="id-link">X2</a>'
            '<a class="id-link"> PMC3 </a></span>')
    assert extract_details(article(spark, page)).first().PMCID == "PMC3"
    assert extract_details(article(spark, page.replace("PMC3", ""))).first().PMCID == ""


def test_doi_must_be_a_direct_link_in_the_list(spark):
    page = ('<{0} id="full-view-identifiers"><span class="identifier doi">{1}</span></{0}>')
    link = '<a class="id-link"> 10.1/x </a>'
    good = extract_details(article(spark, page.format("ul", "<i>y</i>" + link))).first()
    nested = extract_details(article(spark, page.format("ul", f"<i>{link}</i>"))).first()
    other = extract_details(article(spark, page.format("div", link))).first()
    assert (good.doi, nested.doi, other.doi) == ("10.1/x", "", "")


def test_affiliations_count_direct_text_nodes(spark):
    page = ('<div class="expanded-authors"><ul><li data-affiliation-id="1"><sup>1</sup> A,  B '
            '<i>x</i>tail</li><li>no</li><li data-affiliation-id="2"> </li></ul></div>'
            '<div class="expanded-authors"><li data-affiliation-id="1">again</li></div>')
    got = extract_details(article(spark, page)).first().affiliations
    assert got == ["1.A,B", "2.tail", "3."]


def test_failed_pages_give_no_details(spark):
    rows = extract_details(article(spark, None, "<p></p>")).collect()
    assert [(r.page_id, r.PMID, r.PMCID) for r in rows] == [(2, None, "")]


def test_full_text_link(spark):
    page = ('<div class="full-text-links"><div class="full-text-links-list"><span>z</span>'
            '<a class="q">no</a><a href=\'/f?a=1&amp;b=2\'>x</a><a href="/g">y</a></div></div>')
    assert extract_details(article(spark, page)).first().full_text_link == "/f?a=1&b=2"


# ---- any page ----------------------------------------------------------------


def test_selectors(spark):
    page = ('<title>A &amp; B</title><nav><a href="/1">x</a><a href="/2"> y </a></nav>'
            '<a href="/3">z</a><p class="c">one <b>two</b>\n three</p><p class="c">four</p>')
    selectors = [
        M.Selector("title", "title"),
        M.Selector("nav", "a", get="@href", within=("nav",), first=False),
        M.Selector("link", "a", get="@href"),
        M.Selector("texts", "p", "class", "c", first=False),
        M.Selector("whole", "p", "class", "c", get="all_text"),
        M.Selector("none", "h1"),
        M.Selector("no_link", "h1", get="@href"),
        M.Selector("none_at_all", "h1", first=False),
    ]
    row = extract_pages(article(spark, page), selectors).first()
    assert row.title == "A & B" and row.nav == ["/1", "/2"] and row.link == "/1"
    assert row.texts == ["one ", "\n three", "four"] and row.whole == "one two three"
    assert row.none == "" and row.no_link == "" and row.none_at_all == []


# ---- against the tree walker ---------------------------------------------------


def compare_hits(frame):
    fields = ("position", "doctitle", "short_author", "full_author", "short_journal",
              "full_journal", "PMID", "freemark", "reviewmark")
    got = {}
    for r in extract_hits(frame).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append({f: r[f] for f in fields})
    pages = frame.where("html is not null").select("page_id", "html").collect()
    assert pages
    for page in pages:
        assert got.get(page.page_id, []) == walker.hits(page.html), page.html


def compare_details(frame):
    got = {r.page_id: r.asDict(True) for r in extract_details(frame).collect()}
    pages = frame.where("html is not null").select("page_id", "html").collect()
    assert pages
    for page in pages:
        row = got[page.page_id]
        row.update(row.pop("abstract"))
        want = walker.details(page.html)
        assert {k: row[k] for k in want} == want, page.html


def test_rendered_search_pages(spark, sf_dir):
    compare_hits(inputs.search_captures(spark, sf_dir))


def test_rendered_article_pages(spark, sf_dir):
    compare_details(inputs.article_captures(spark, sf_dir))


TEXTS = ("word", " two words ", "\n  ", "a &amp; b", "&lt;x&gt;", "Free article", " PMC12 ",
         "Methods", "x\xa0\xa0y", "é&eacute;", "p &lt; 0.05", "12", "")


def inline(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(0, 3)):
        kind = rnd.random()
        if kind < 0.5 or depth > 3:
            out.append(rnd.choice(TEXTS))
        elif kind < 0.6:
            out.append(rnd.choice(("<br>", "<!-- <b>c</b> -->", "<img alt='a>b'>")))
        else:
            tag = rnd.choice("b i sup em".split())
            out.append(f"<{tag}>{inline(rnd, depth + 1)}</{tag}>")
    return "".join(out)


def quoted(rnd, value):
    return rnd.choice((f'"{value}"', f"'{value}'"))


def random_search_page(rnd):
    classes = ("docsum-authors short-authors", "docsum-authors full-authors",
               "docsum-journal-citation short-journal-citation",
               "docsum-journal-citation full-journal-citation", "docsum-pmid",
               "free-resources spaced-citation-item citation-part",
               "publication-type spaced-citation-item citation-part", "other")
    blocks = []
    for _ in range(rnd.randint(0, 4)):
        spans = [f"<span data-x='1' class={quoted(rnd, c)}>{inline(rnd)}</span>"
                 for c in rnd.choices(classes, k=rnd.randint(0, 9))]
        title = f"<a href='#' class={quoted(rnd, 'docsum-title')}>{inline(rnd)}</a>"
        spans.insert(rnd.randint(0, len(spans)), title if rnd.random() < 0.9 else "")
        blocks.append(f"<div class={quoted(rnd, 'docsum-content')}>{''.join(spans)}</div>")
    return f"<html><body><script>'<b>'</script>{' '.join(blocks)}</body></html>"


def random_article_page(rnd):
    heads = ("Background", "Methods", "Results: x", "Conclusions", "Keywords", "methods", "")

    def paragraph():
        strong = f'<strong class="sub-title">{rnd.choice(heads)}</strong>'
        return f"<p>{inline(rnd)}{strong if rnd.random() < 0.6 else ''}{inline(rnd)}</p>"

    def paragraphs():
        return "".join(paragraph() for _ in range(rnd.randint(0, 3)))

    def group():
        items = "".join(
            f"<li{rnd.choice((' data-affiliation-id=a1', ''))}>{inline(rnd)}</li>"
            for _ in range(rnd.randint(0, 3)))
        return f'<div class="expanded-authors"><ul>{items}</ul></div>'

    def identifier():
        kind = rnd.choice(("identifier pmc", "identifier doi", "identifier own"))
        body = rnd.choice((f'<a class="id-link">{inline(rnd)}</a>',
                           f'<strong class="current-id">{inline(rnd)}</strong>', inline(rnd)))
        return f"<li><span class={quoted(rnd, kind)}>{inline(rnd)}{body}</span></li>"

    ids = "".join(identifier() for _ in range(rnd.randint(0, 5)))
    links = "".join(rnd.choice(('<a class="x">n</a>', '<a href="/f?a&amp;b">y</a>', inline(rnd)))
                    for _ in range(rnd.randint(0, 3)))
    return (
        f'<html><body><div id="article-page"><main class="m" id="article-details">'
        f'{"".join(group() for _ in range(rnd.randint(0, 2)))}'
        f'<ul id="full-view-identifiers">{ids}</ul><div class="abstract" id="abstract">'
        f'<div class="c" id="eng-abstract">{paragraphs()}</div>{paragraphs()}</div></main><aside>'
        f'<div class="full-text-links"><div class="full-text-links-list">{links}</div></div>'
        f"</aside></div></body></html>"
    )


def test_random_search_pages(spark):
    rnd = random.Random(1)
    compare_hits(search(spark, *[random_search_page(rnd) for _ in range(600)]))


def test_random_article_pages(spark):
    rnd = random.Random(2)
    compare_details(article(spark, *[random_article_page(rnd) for _ in range(600)]))


def test_long_and_broken_markup_ends_soon(spark):
    deep = "<b>" * 3000 + "x" + "</b>" * 3000
    wide = "<i>x</i>" * 30000
    torn = "<b>x" * 5000
    pages = [hit(deep), hit(wide), hit(torn), hit("t", "<span " * 3000), "<" * 50000,
             '<div class="docsum-content"' + " a" * 20000]
    assert extract_hits(search(spark, *pages)).count() == 4
    texts = [abstract_page(f"<p>{t}</p>", f"<p>{t}</p>") for t in (deep, wide, torn)]
    texts.append('<div class="expanded-authors">' + f'<li data-affiliation-id="1">{torn}')
    assert extract_details(article(spark, *texts)).count() == 4


# ---- depth and block ends ------------------------------------------------------


@pytest.mark.parametrize("deep", [1, 7, 50, 90])
def test_fields_behind_deep_markup(spark, deep):
    nest = "<i>" * deep + "no" + "</i>" * deep
    page = hit("T", f'<span class="docsum-pmid">{nest}5</span><span class="docsum-authors full-authors">{nest}A</span>')
    row = extract_hits(search(spark, page)).first()
    assert (row.PMID, row.full_author) == ("5", "A")
    ids = (f'<ul id="full-view-identifiers"><li><ul><li>x</li></ul></li><strong class="current-id">{nest}9</strong>'
           f'<span class="identifier doi">{nest}<a class="id-link">{nest}10.1/x</a></span></ul>')
    row = extract_details(article(spark, ids)).first()
    assert (row.PMID, row.doi) == ("9", "10.1/x")


@pytest.mark.parametrize("deep", [8, 9, 97, 500, 5000])
def test_no_depth_is_too_great(spark, deep):
    nest = "<i>" * deep + "no" + "</i>" * deep
    boxes = "<div><ul>" * deep + "no" + "</ul></div>" * deep
    page = hit("T", f'{boxes}<span class="docsum-pmid">{nest}5</span><span class="docsum-authors full-authors">{nest}A</span>')
    got = extract_hits(search(spark, page)).first()
    assert (got.PMID, got.full_author) == ("5", "A")
    ids = (f'<ul id="full-view-identifiers">{boxes}<strong class="current-id">{nest}9</strong>'
           f'<span class="identifier doi">{nest}<a class="id-link">{nest}10.1/x</a></span></ul>'
           f'<span class="identifier pmc">{nest}<i>{"<b>" * deep}<a class="id-link">{nest}PMC7</a>{"</b>" * deep}</i></span>')
    abstract = (f'<div id="article-page"><main id="article-details"><div id="abstract">{boxes}'
                f'<p><strong class="sub-title">Methods</strong>{nest}done</p></div></main></div>'
                f'<div id="eng-abstract"><div>{boxes}<p>no</p></div><p>{nest}Plain.</p></div>')
    authors = f'<div class="expanded-authors">{boxes}<li data-affiliation-id="1">{nest}Here</li></div>'
    links = f'<div class="full-text-links"><div class="full-text-links-list">{nest}<a href="u">x</a></div></div>'
    got = extract_details(article(spark, ids + abstract + authors + links)).first()
    assert (got.PMID, got.doi, got.PMCID, got.full_text_link) == ("9", "10.1/x", "PMC7", "u")
    assert (got.affiliations, got.abstract.abstract, got.abstract.methods) == (["1.Here"], "Plain.", "Methods no done")
    both = [M.Selector("one", "span", "class", "x"), M.Selector("all", "span", "class", "x", first=False),
            M.Selector("whole", None, "class", "x", get="all_text")]
    markup = f'<p><span class="x">{nest}a{nest}b<span class="x">c</span></span><span class="x">{nest}</span><span class="x">d'
    got = extract_pages(article(spark, markup), both).first()
    assert (got.one, got.all, got.whole) == ("a", ["a", "b", "d"], "no a no b c")


def test_elements_left_open(spark):
    """A text is not behind an element that is never closed, but in none that is."""
    frame = spark.createDataFrame([("a<b>b<i>c</i>d",), ("</b>a<b>b</b></i>c<i>",), ("<b>" * 20 + "x</b>y",)], "m string")
    got = [r[0] for r in frame.select(M.direct_texts(F.col("m"))).collect()]
    assert got == [["a", "b", "d"], ["a", "c"], ["y"]]
    nests = ["<x>a" + "<b>" * n + "c" for n in (1, 9)] + ["<x>" + "<b>" * n + "</b>" * n + "c" for n in (8, 9, 40)]
    frame = spark.createDataFrame([(n,) for n in nests], "m string")
    rows = frame.select(M.first_text(F.col("m"), M.open_tag("x")), M.all_inner(F.col("m"), M.open_tag("x"))).collect()
    assert [r[0] for r in rows] == ["a", "a", "c", "c", "c"]
    assert [r[1] for r in rows] == [["a"], ["a"], *([n[3:]] for n in nests[2:])]


def test_walks_are_linear(spark):
    """Ten times the depth takes no more than some twenty times as long."""
    import time

    def seconds(deep):
        nest = "<div><i>" * deep + "no" + "</i></div>" * deep
        page = f'<ul id="full-view-identifiers"><strong class="current-id">{nest}9</strong></ul>' * 2
        frame = article(spark, page)
        extract_details(frame).collect()
        began = time.time()
        assert extract_details(frame).first().PMID == "9"
        return time.time() - began

    assert seconds(20_000) < 20 * max(seconds(2_000), 0.3)


def test_blocks_end_with_their_own_element(spark):
    after = '<div><span class="docsum-pmid">999</span><span class="publication-type spaced-citation-item citation-part">Review.</span></div>'
    row = extract_hits(search(spark, hit("T", "<div><p>open</div>") + after)).first()
    assert (row.PMID, row.reviewmark) == ("", False)
    head = '<p><strong class="sub-title">{}:</strong> {}</p>'
    page = abstract_page(
        head.format("Results", "own"), plain="<div><p>note</p></div><p>plain<p>open"
    ).replace("</main>", head.format("Results", "foreign") + "</main>")
    page += '<div class="expanded-authors"><ul><li data-affiliation-id="1">A</li></ul></div><ul><li data-affiliation-id="2">B</li></ul>'
    row = extract_details(article(spark, page)).first()
    assert row.abstract.results == "Results: own" and row.abstract.abstract == "plain"
    assert row.affiliations == ["1.A"]


def test_entities_of_any_length(spark):
    given = ["&#00000065;", "&#x0000041;", "&apos;", "&#" + "9" * 40 + ";", "&#x" + "f" * 40 + ";", "&#x110000;"]
    want = ["A", "A", "'", *given[3:]]
    assert column(spark, given, X.decode_entities) == want


def test_texts_without_neighbouring_spaces_are_not_searched_for_them(spark):
    """A cheap test comes first, on a text that is made once; results are as before."""
    pick = random.Random(5)
    texts = ["".join(pick.choices("ab \n\t 　é&;#1x", k=12)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    squeezed = frame.select("t", X.squeeze(F.col("t")).alias("s"), X.squeeze(F.col("t"), "").alias("e"))
    for t, s, e in squeezed.collect():
        assert s == re.sub(X.WHITESPACE_CLASS + "{2,}", " ", t)
        assert e == re.sub(X.WHITESPACE_CLASS + "{2,}", "", t)
    plan = squeezed._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
