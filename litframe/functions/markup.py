"""Selectors over HTML text as Column expressions.

A selector is a Java regular expression put together from a tag name and an
exact attribute value. All repeated groups are possessive: they run as loops
(no stack growth on long pages) and do not backtrack, so cost is linear in the
length of a well-formed page. Runs of one class are written ``(?>x+)``, which matches
what ``x++`` does and is the faster loop in Java. They follow a few levels of elements; markup that
is nested deeper, or left open, is walked through tag by tag with a running depth, so
no depth is too great. Run both on ``clean_markup`` output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from litframe.functions.text import bind, decode_entities, strip

# HTML elements that never have content.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)
# Start or end of one of these ends an open paragraph.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt",
    "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "html", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)

GAP = "<!---->"  # what a comment, script or style block leaves behind

_QUOTED = r"""(?:"(?>[^"]*)"|'(?>[^']*)')"""
_REST = rf"""(?>[^>"']*)(?:{_QUOTED}(?>[^>"']*))*+>"""
_OTHER_VALUE = rf"""(?:{_QUOTED}|[^\s"'>](?>[^\s>]*))"""
_VOID = "(?i:" + "|".join(VOID_TAGS) + r")(?=[\s/>])"
TEXT = r"(?:(?>[^<]+)|<(?![A-Za-z/!?]))++"
ANY_TAG = rf"<[A-Za-z/!?]{_REST}"


#: Levels of elements that patterns follow by themselves. Where a pattern stops at an
#: element that it cannot step over, as it is nested deeper or never closed, the same
#: is found by a walk over the tags instead, which keeps a depth and no stack.
LEVELS = 8
#: What such a pattern stops at.
STUCK = "<(?=[A-Za-z])"


def _child(depth: int) -> str:
    """One complete child: a void tag, or an element nested up to ``depth``."""
    void = rf"(?:[!?]|{_VOID}){_REST}"
    pattern = f"<{void}"
    for _ in range(depth):
        # both kinds share their first character, so plain text fails on one test
        pattern = (
            rf"<(?:{void}|(?!{_VOID})[A-Za-z]{_REST}(?:{TEXT}|{pattern})*+</(?>[^>]*)>)"
        )
    return pattern


CHILD = _child(LEVELS)
INNER = rf"(?:{TEXT}|{CHILD})*+"


def open_tag(tag: str | None, attr: str | None = None, value: str | None = None) -> str:
    """Start tag by name (None: any) and, if given, exact attribute value."""
    name = f"(?i:{tag})" if tag else "[A-Za-z][A-Za-z0-9]*+"
    head = rf"<{name}(?=[\s/>])"
    if attr is None:
        return head + _REST
    wanted = f"(?i:{re.escape(attr)})"
    others = (
        rf"""(?:[\s/]*+(?!{wanted}[\s=>/])(?>[^\s=>"'/]+)"""
        rf"""(?:(?>\s*)=(?>\s*){_OTHER_VALUE})?)*+[\s/]*+"""
    )
    if value is None:
        return rf"{head}{others}{wanted}(?=[\s=>/]){_REST}"
    v = re.escape(value).replace(r"\ ", " ")
    found = rf"""(?>\s*)=(?>\s*)(?:"{v}"|'{v}'|{v}(?=[\s>]))"""
    return head + others + wanted + found + _REST


def until(*stops: str) -> str:
    """Everything up to the first of the given markup patterns (or the end)."""
    return "(?:(?>[^<]+)|(?!" + "|".join(stops) + ")<)*+"


def close_tag(tag: str) -> str:
    return rf"</(?i:{tag})(?=[\s>])"


def _within(tag: str, depth: int = LEVELS) -> str:
    """Content of an element of this name, if it holds at most ``depth`` of the name."""
    edge = rf"</?(?i:{tag})(?=[\s/>])"
    flat = until(edge)
    inner = flat
    for _ in range(depth):
        inner = rf"{flat}(?:<(?i:{tag})(?=[\s/>]){_REST}{inner}(?:</(?i:{tag})(?>[^>]*)>)?+{flat})*+"
    return inner


def after(start: str) -> str:
    """Skip to the first match of ``start`` and step over it."""
    return until(start) + start


def clean_markup(html: Column) -> Column:
    """Replace comments, scripts and styles by a gap that still parts text.

    One that is never closed reaches to the end of the page.
    """
    pattern = (
        r"<(?:!--(?s:.*?)(?:-->|\z)"
        r"|(?i:(script|style))(?=[\s/>])(?>[^>]*)>(?s:.*?)(?:</(?i:\1)(?>\s*)>|\z))"
    )
    # most pages hold none, which this finds at a fraction of the cost
    some = html.rlike(r"<(?:!--|(?i:s(?:cript|tyle))[\s/>])")
    return F.when(some, F.regexp_replace(html, pattern, GAP)).otherwise(html)


def _tokens(markup: Column) -> Column:
    """Tags and texts in order; of a tag that has no end only its first two characters."""
    return F.regexp_extract_all(markup, F.lit(f"(</(?>[^>]*)>|{ANY_TAG}|{TEXT}|<.)"), F.lit(1))


def _kind(token: Column) -> Column:
    """``text``, ``close``, ``broken``, ``void`` (comments, too) or ``open``."""
    return (
        F.when(~token.rlike("^<[A-Za-z/!?]"), "text")
        .when(~F.endswith(token, F.lit(">")), "broken")
        .when(F.startswith(token, F.lit("</")), "close")
        .when(token.rlike(f"^<(?:[!?]|{_VOID})"), "void")
        .otherwise("open")
    )


def _walk(markup: Column, start: dict[str, Column], step, stop=None) -> Column:
    """Fold the tokens of ``markup``; ``step(state, token, kind)`` names what changes.

    ``state`` has ``depth``, the elements that are open, and ``over``, set at an end
    tag that is not theirs, at a broken tag, and where ``stop(state, token,
    kind)`` says so, besides what ``start`` names. After that nothing changes.
    """
    begin = {"depth": F.lit(0), "over": F.lit(False), **start}

    def fold(state: Column, token: Column) -> Column:
        def one(kind: Column) -> Column:
            ends = (kind == "broken") | ((kind == "close") & (state["depth"] == 0))
            depth = state["depth"] + F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
            over = ends | stop(state, token, kind) if stop else ends
            new = {"depth": F.when(ends, state["depth"]).otherwise(depth), "over": over}
            new |= {k: F.when(ends, state[k]).otherwise(v) for k, v in step(state, token, kind).items()}
            return F.struct(*[new.get(k, state[k]).alias(k) for k in begin])

        return F.when(state["over"], state).otherwise(bind(_kind(token), one))

    state = F.struct(*[v.alias(k) for k, v in begin.items()])
    return F.aggregate(_tokens(markup), state, fold)


def _inner_size(rest: Column) -> Column:
    """Length of the texts and complete elements that ``rest`` begins with."""

    def step(state: Column, token: Column, kind: Column) -> dict[str, Column]:
        at = state["at"] + F.length(token)
        level = (kind.isin("text", "void") & (state["depth"] == 0)) | ((kind == "close") & (state["depth"] == 1))
        return {"at": at, "size": F.when(level, at).otherwise(state["size"])}

    return _walk(rest, {"at": F.lit(0), "size": F.lit(0)}, step)["size"]


def _own_text(rest: Column) -> Column:
    """First text in ``rest`` that is in none of its elements, up to the first end
    tag that is not theirs; ``''`` if none."""

    def first(state: Column, token: Column, kind: Column) -> Column:
        return (kind == "text") & (state["depth"] == 0)

    return _walk(
        rest, {"text": F.lit("")},
        lambda s, t, k: {"text": F.when(first(s, t, k), t).otherwise(s["text"])}, first,
    )["text"]


def _places(html: Column, opening: str) -> Column:
    """Where the markup after each of these start tags begins, counted from 0."""
    # texts and start tags by turns
    tags = F.regexp_extract_all(html, F.lit(f"({opening})"), F.lit(1))
    sizes = F.zip_with(F.split(html, opening, -1), tags, lambda a, b: F.length(a) + F.length(b))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(done: Column, size: Column) -> Column:
        at = done["at"] + size
        return F.struct(at.alias("at"), F.array_append(done["out"], at).alias("out"))

    # the text after the last tag has no partner
    return F.aggregate(F.filter(sizes, lambda n: n.isNotNull()), begin, add, lambda done: done["out"])


def _first_of(html: Column, opening: str, find) -> Column:
    """First text that is not empty of what ``find`` gives for the markup after each start tag."""

    def one(found: Column, at: Column) -> Column:
        return F.when(found != "", found).otherwise(find(F.substr(html, at + 1)))

    return F.aggregate(_places(html, opening), F.lit(""), one)


def first_text(html: Column, opening: str) -> Column:
    """First direct text of the elements with this start tag, raw; ``''`` if none."""
    found = F.regexp_extract(html, rf"{opening}(?:{CHILD})*+({TEXT}|{STUCK})", 1)

    return bind(found, lambda f: F.when(f == "<", _first_of(html, opening, _own_text)).otherwise(f))


def all_inner(html: Column, opening: str, content: str | None = None) -> Column:
    """Inner markup of every element with this start tag, but of none inside another.

    ``content`` is a pattern for it; by default its texts and complete elements.
    """
    if content is not None:
        return F.regexp_extract_all(html, F.lit(f"{opening}({content})"), F.lit(1))
    found = F.regexp_extract_all(html, F.lit(f"{opening}({INNER}(?:{STUCK})?+)"), F.lit(1))

    def outermost(done: Column, at: Column) -> Column:
        def add(size: Column) -> Column:
            return F.struct(
                (at + size).alias("end"), F.array_append(done["out"], F.substr(html, at + 1, size)).alias("out")
            )

        return F.when(at < done["end"], done).otherwise(bind(_inner_size(F.substr(html, at + 1)), add))

    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(_places(html, opening), begin, outermost, lambda done: done["out"])
    stuck = F.lit("<")
    return bind(found, lambda f: F.when(F.exists(f, lambda t: F.endswith(t, stuck)), walked).otherwise(f))


def first_inner(html: Column, opening: str) -> Column:
    """The first element with this start tag, from that tag on, without its end tag; ``''`` if none."""
    found = F.regexp_extract(html, f"{opening}{INNER}(?:{STUCK})?+", 0)

    def walked() -> Column:
        tag = F.regexp_extract(html, opening, 0)
        rest = F.regexp_extract(html, f"{opening}((?s:.*+))", 1)
        return bind(rest, lambda r: F.concat(tag, F.substr(r, F.lit(1), _inner_size(r))))

    return bind(found, lambda f: F.when(F.endswith(f, F.lit("<")), walked()).otherwise(f))


def _named_tokens(rest: Column, tag: str) -> Column:
    """Tags of one name and what stands between them."""
    edge = rf"</?(?i:{tag})(?=[\s/>])"
    pattern = rf"(</(?i:{tag})(?=[\s/>])(?>[^>]*)>|<(?i:{tag})(?=[\s/>]){_REST}|(?:(?>[^<]+)|(?!{edge})<)++|<.)"
    return F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))


def _named_kind(token: Column, tag: str) -> Column:
    return (
        F.when(~token.rlike(rf"^</?(?i:{tag})(?=[\s/>])") & ~token.rlike(r"^<.\z"), "text")
        .when(~F.endswith(token, F.lit(">")), "broken")
        .when(F.startswith(token, F.lit("</")), "close")
        .otherwise("open")
    )


def _end_of(rest: Column, tag: str) -> Column:
    """Length of ``rest`` up to the end tag of an element of this name that is open."""

    def fold(state: Column, token: Column) -> Column:
        def one(kind: Column) -> Column:
            over = (kind == "broken") | ((kind == "close") & (state["depth"] == 0))
            depth = state["depth"] + F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
            return F.struct(
                F.when(over, state["depth"]).otherwise(depth).alias("depth"),
                (state["size"] + F.when(over, 0).otherwise(F.length(token))).alias("size"), over.alias("over"),
            )

        return F.when(state["over"], state).otherwise(bind(_named_kind(token, tag), one))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("over"))
    return F.aggregate(_named_tokens(rest, tag), begin, fold)["size"]


def _opened(markup: Column, tag: str) -> Column:
    return F.regexp_count(markup, F.lit(rf"<(?i:{tag})(?=[\s/>])"))


def content_of(html: Column, start: str, tag: str) -> Column:
    """What follows the first match of ``start`` up to the end tag of the element of
    this name that it ends with (or the end).

    Only tags of the name are counted, so others may be left open inside.
    """
    found = F.regexp_extract(html, f"{start}({_within(tag)})", 1)

    def walked() -> Column:
        # the pattern has found a beginning; more of the page follows it
        rest = F.regexp_extract(html, f"{start}((?s:.*+))", 1)
        return bind(rest, lambda r: F.substr(r, F.lit(1), _end_of(r, tag)))

    # the pattern is right where it met no more tags than it has levels
    return bind(found, lambda f: F.when(_opened(f, tag) > LEVELS, walked()).otherwise(f))


def without(html: Column, tag: str) -> Column:
    """The markup outside all elements of this name, which leave a gap."""
    whole = f"{open_tag(tag)}{_within(tag)}(?:{close_tag(tag)}(?>[^>]*)>)?+"

    def fold(state: Column, token: Column) -> Column:
        def one(kind: Column) -> Column:
            depth = state["depth"] + F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
            kept = (state["depth"] == 0) & kind.isin("text", "close")
            # an end tag without an element stays where it is
            return F.struct(
                F.greatest(depth, F.lit(0)).alias("depth"),
                F.when(kept, F.array_append(state["out"], token))
                .when((kind == "open") & (state["depth"] == 0), F.array_append(state["out"], F.lit(GAP)))
                .otherwise(state["out"]).alias("out"),
            )

        return bind(_named_kind(token, tag), one)

    begin = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def outside(markup: Column) -> Column:
        walked = F.array_join(F.aggregate(_named_tokens(markup, tag), begin, fold, lambda s: s["out"]), "")
        flat = F.regexp_replace(markup, whole, GAP)
        return F.when(~markup.rlike(rf"<(?i:{tag})(?=[\s/>])"), markup).when(_opened(markup, tag) > LEVELS, walked).otherwise(flat)

    return bind(html, outside)


def child_text(html: Column, outer: str, child: str) -> Column:
    """First direct text of the first ``child`` right inside an ``outer``; ``''`` if none."""
    found = F.regexp_extract(
        html, rf"{outer}(?:{TEXT}|(?!{child}){CHILD})*+(?:{child}(?:{CHILD})*+)?+({TEXT}|{STUCK})", 1
    )

    def in_child(rest: Column) -> Column:
        def starts(state: Column, token: Column, kind: Column) -> Column:
            return ~state["inside"] & (state["depth"] == 0) & (kind == "open") & token.rlike(f"^{child}")

        def text(state: Column, token: Column, kind: Column) -> Column:
            return state["inside"] & (state["depth"] == 1) & (kind == "text")

        return _walk(
            rest, {"inside": F.lit(False), "text": F.lit("")},
            lambda s, t, k: {
                "inside": s["inside"] | starts(s, t, k), "text": F.when(text(s, t, k), t).otherwise(s["text"]),
            },
            lambda s, t, k: text(s, t, k) | (s["inside"] & (s["depth"] == 1) & (k == "close")),
        )["text"]

    return bind(found, lambda f: F.when(f == "<", _first_of(html, outer, in_child)).otherwise(f))


def child_attribute(html: Column, outer: str, child: str, name: str) -> Column:
    """Attribute of the first ``child`` right inside the first ``outer`` that has one, raw."""
    before = rf"{outer}(?:{TEXT}|(?!{child}){CHILD})*+"
    tag = F.regexp_extract(html, rf"{before}({child}|{STUCK})", 1)

    def in_outer(rest: Column) -> Column:
        def found(state: Column, token: Column, kind: Column) -> Column:
            return (state["depth"] == 0) & (kind == "open") & token.rlike(f"^{child}")

        return _walk(
            rest, {"tag": F.lit("")}, lambda s, t, k: {"tag": F.when(found(s, t, k), t).otherwise(s["tag"])}, found
        )["tag"]

    own = bind(tag, lambda t: F.when(t == "<", _first_of(html, outer, in_outer)).otherwise(t))
    return F.regexp_replace(F.regexp_extract(own, f"^{_attribute(name)}", 1), "^[\"']|[\"']$", "")


def paragraphs(html: Column) -> Column:
    """Inner markup of every ``p``; an unclosed one ends at the next block tag."""
    block = r"</?(?i:" + "|".join(BLOCK_TAGS) + r")(?=[\s/>])"
    return all_inner(html, open_tag("p"), until(block))


def _direct_nodes(markup: Column) -> Column:
    """Texts that are in no complete element, by a walk."""
    begin = F.struct(
        F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,text:string>>").alias("out")
    )

    def fold(state: Column, token: Column) -> Column:
        def one(kind: Column) -> Column:
            depth = state["depth"] + F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
            closes = (kind == "close") & (state["depth"] > 0)
            # texts wait until it shows whether the elements around them are closed
            left = F.filter(state["out"], lambda n: n["depth"] < state["depth"])
            node = F.struct(state["depth"].alias("depth"), token.alias("text"))
            return F.struct(
                F.greatest(depth, F.lit(0)).alias("depth"),
                F.when(kind == "text", F.array_append(state["out"], node)).when(closes, left).otherwise(state["out"]).alias("out"),
            )

        return bind(_kind(token), one)

    nodes = F.aggregate(_tokens(markup), begin, fold, lambda s: s["out"])
    return F.transform(nodes, lambda n: n["text"])


def direct_texts(inner: Column) -> Column:
    """Direct text nodes of an element, given its inner markup; still encoded."""

    def nodes(markup: Column) -> Column:
        def parted(flat: Column) -> Column:
            open_ = flat.rlike(f"<(?!{_VOID})[A-Za-z]")
            return F.when(open_, _direct_nodes(markup)).otherwise(F.split(flat, ANY_TAG))

        # a long text without any tag skips both patterns
        pieces = F.when(
            F.contains(markup, F.lit("<")), bind(F.regexp_replace(markup, CHILD, GAP), parted)
        ).otherwise(F.array(markup))
        return F.filter(pieces, lambda t: t != "")

    return F.flatten(F.transform(F.array(inner), nodes))


def all_texts(inner: Column) -> Column:
    """All text nodes under an element, decoded and stripped, empty ones dropped."""
    plain = F.transform(F.split(inner, ANY_TAG), lambda t: strip(decode_entities(t)))
    return F.filter(plain, lambda t: t != "")


def text_nodes(inner: Column) -> Column:
    """Text nodes with depth and innermost open tag, in document order.

    ``ARRAY<STRUCT<depth INT, tag STRING, text STRING>>``; depth 0 is direct
    text, whose tag is NULL. Meant for short pieces such as titles.
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("stack"),
        F.array().cast("array<struct<depth:int,tag:string,text:string>>").alias("out"),
    )

    def step(acc: Column, token: Column) -> Column:
        stack, out = acc["stack"], acc["out"]
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        back = F.array_position(F.reverse(stack), name).cast("int")
        popped = F.when(back > 0, F.slice(stack, 1, F.size(stack) - back)).otherwise(stack)
        pushed = F.when(
            name.isin(*VOID_TAGS) | F.endswith(token, F.lit("/>")), stack
        ).otherwise(F.array_append(stack, name))
        node = F.struct(
            F.size(stack).alias("depth"),
            F.try_element_at(stack, F.lit(-1)).alias("tag"),
            token.alias("text"),
        )
        is_text = ~token.rlike("^<[A-Za-z/!?]")
        new_stack = (
            F.when(is_text | (name == ""), stack)
            .when(F.startswith(token, F.lit("</")), popped)
            .otherwise(pushed)
        )
        new_out = F.when(is_text, F.array_append(out, node)).otherwise(out)
        return F.struct(new_stack.alias("stack"), new_out.alias("out"))

    tokens = F.regexp_extract_all(inner, F.lit(f"({ANY_TAG}|{TEXT})"), F.lit(1))
    return F.aggregate(tokens, empty, step, lambda acc: acc["out"])


@dataclass(frozen=True)
class Selector:
    """What ``extract_pages`` reads into one output column.

    ``get``: ``text`` (direct text), ``all_text`` (text of all descendants,
    pieces stripped and joined by one space) or ``@name`` (attribute value).
    ``within``: start tag of an enclosing element, as (tag, attr, value).
    ``first``: first match as a string (``''`` if none), else all as an array.
    """

    name: str
    tag: str | None
    attr: str | None = None
    value: str | None = None
    get: str = "text"
    within: tuple | None = None
    first: bool = True

    def found(self, html: Column) -> Column:
        """Matches in page order, raw except that ``all_text`` is complete."""
        source = html
        if self.within is not None:
            outer = self.within[0]
            source = F.array_join(
                all_inner(html, open_tag(*self.within), until(close_tag(outer))), GAP
            )
        opening = open_tag(self.tag, self.attr, self.value)
        if self.get.startswith("@"):
            # the lookahead selects the tag, the pattern after it reads the attribute
            inside = rf"(?={opening}){_attribute(self.get[1:])}"
            values = F.regexp_extract_all(source, F.lit(inside), F.lit(1))
            return F.transform(values, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
        if self.get == "all_text":
            content = until(close_tag(self.tag)) if self.tag else None
            return F.transform(
                all_inner(source, opening, content), lambda t: F.array_join(all_texts(t), " ")
            )
        if self.first:
            return F.array(first_text(source, opening))
        return F.flatten(F.transform(all_inner(source, opening), direct_texts))

    def result(self, found: Column) -> Column:
        return F.coalesce(F.get(found, F.lit(0)), F.lit("")) if self.first else found


def _attribute(name: str) -> str:
    """A start tag, its attribute ``name`` captured with the quotes it has."""
    wanted = f"(?i:{re.escape(name)})"
    return (
        rf"""<[A-Za-z][A-Za-z0-9]*+(?:[\s/]*+(?!{wanted}[\s=>/])(?>[^\s=>"'/]+)"""
        rf"""(?:(?>\s*)=(?>\s*){_OTHER_VALUE})?)*+[\s/]*+{wanted}(?>\s*)=(?>\s*)({_OTHER_VALUE})"""
    )
