"""Search pages to hit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.functions import markup as M
from litframe.functions.text import decode_entities, strip

# Where a search page keeps each field (tag, exact class).
HIT_BLOCK = ("div", "class", "docsum-content")
TITLE_LINK = ("a", "class", "docsum-title")
SPAN_CLASSES = {
    "short_author": "docsum-authors short-authors",
    "full_author": "docsum-authors full-authors",
    "short_journal": "docsum-journal-citation short-journal-citation",
    "full_journal": "docsum-journal-citation full-journal-citation",
    "PMID": "docsum-pmid",
    "freemark": "free-resources spaced-citation-item citation-part",
    "reviewmark": "publication-type spaced-citation-item citation-part",
}
COUNT_PATH = (
    ("div", "id", "search-results"),
    ("section", "class", "search-results-list"),
    ("span", "class", "value"),
)


def _title(inner: Column, sep: str) -> Column:
    """Direct text of the link plus text right inside a ``b``, pieces stripped."""
    kept = F.filter(M.text_nodes(inner), lambda n: (n["depth"] == 0) | (n["tag"] == "b"))
    pieces = F.transform(kept, lambda n: strip(decode_entities(n["text"])))
    glued = F.array_join(F.filter(pieces, lambda t: t != ""), sep)
    # most titles hold no tag at all and need no tag stack
    return F.when(F.contains(inner, F.lit("<")), glued).otherwise(strip(decode_entities(inner)))


def extract_hits(captures: DataFrame, title_sep: str = "") -> DataFrame:
    """One row per search hit; pages that failed or hold no hit give no rows.

    ``captures``: run_id, page_no, page_id, html. No shuffle: each page is cut
    into hit blocks where it is read, and the field patterns run on the blocks.
    ``title_sep`` joins the pieces of a title that holds markup.
    """
    blocks = F.split(M.clean_markup(F.col("html")), M.open_tag(*HIT_BLOCK))
    # a piece ends with its own division: what follows the last hit is not part of it
    own = F.transform(
        F.slice(blocks, 2, F.size(blocks)), lambda b: M.content_of(b, "^", "div")
    )
    cut = captures.select("run_id", "page_no", "page_id", F.posexplode(own).alias("pos", "block"))
    block = F.col("block")
    titles = M.all_inner(block, M.open_tag(*TITLE_LINK), M.until(r"</?(?i:a)(?=[\s/>])"))
    raw = cut.select(
        "run_id", "page_no", "page_id",
        (F.col("pos") + 1).alias("position"),
        F.array_join(titles, M.GAP).alias("title"),
        *[
            M.first_text(block, M.open_tag("span", "class", cls)).alias(name)
            for name, cls in SPAN_CLASSES.items()
        ],
    )
    # one decoding step for all plain fields of a hit
    names = list(SPAN_CLASSES)[:-1]
    texts = raw.select(
        "run_id", "page_no", "page_id", "position", "title", "reviewmark",
        F.transform(F.array(*names), decode_entities).alias("texts"),
    )
    text = {name: F.get("texts", F.lit(i)) for i, name in enumerate(names)}
    mark = text["freemark"]
    free = (
        F.when(F.contains(mark, F.lit("Free PMC article")), S.FREE_PMC)
        .when(F.contains(mark, F.lit("Free article")), S.FREE)
        .otherwise(S.NOT_FREE)
    )
    fields = {
        **text, "doctitle": _title(F.col("title"), title_sep), "freemark": free,
        "reviewmark": F.col("reviewmark") != "",
    }
    return texts.select(*[fields.get(f, F.col(f)).alias(f) for f in S.HIT.names])


def result_counts(captures: DataFrame) -> DataFrame:
    """Total number of results a search page prints; NULL where it prints none."""
    outer, section, value = (M.open_tag(*step) for step in COUNT_PATH)
    pattern = f"{outer}{M.after(section)}{M.until(M.close_tag('section'))}"
    region = F.regexp_extract(M.clean_markup(F.col("html")), pattern, 0)
    digits = F.replace(strip(M.first_text(region, value)), F.lit(","), F.lit(""))
    return captures.select("page_id", digits.try_cast("int").alias("n"))
