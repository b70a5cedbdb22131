"""An element tree from the standard library parser, and the field rules on it.

Written for the tests alone, to check the pattern-based extraction by other
means: here each field is looked up in a tree.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr"}


class Node:
    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def find(self, tag=None, **attrs):
        attrs = {k.rstrip("_").replace("_", "-"): v for k, v in attrs.items()}
        for node in self.walk():
            if tag in (None, node.tag) and all(node.attrs.get(k) == v for k, v in attrs.items()):
                yield node

    def texts(self):
        return [c for c in self.children if isinstance(c, str) and c]

    def all_texts(self):
        for child in self.children:
            if isinstance(child, str):
                if child:
                    yield child
            else:
                yield from child.all_texts()


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root")
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, attrs, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        # script and style texts are left behind by a gap in the jobs as well
        if self.here.tag in ("script", "style"):
            return
        kids = self.here.children
        if kids and isinstance(kids[-1], str) and kids[-1]:
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data):
        self.here.children.append("")  # parts the texts around it


def first(texts, default=""):
    return next(iter(texts), default)


def hits(html):
    rows = []
    for pos, block in enumerate(Tree(html).root.find("div", class_="docsum-content"), 1):
        def span(cls, block=block):
            return first(t for s in block.find("span", class_=cls) for t in s.texts())

        pieces = []

        def collect(node):
            for child in node.children:
                if isinstance(child, Node):
                    collect(child)
                elif child and (node.attrs.get("class") == "docsum-title" or node.tag == "b"):
                    pieces.append(child)

        for link in block.find("a", class_="docsum-title"):
            collect(link)
        free = span("free-resources spaced-citation-item citation-part")
        rows.append({
            "position": pos,
            "doctitle": "".join(p.strip() for p in pieces),
            "short_author": span("docsum-authors short-authors"),
            "full_author": span("docsum-authors full-authors"),
            "short_journal": span("docsum-journal-citation short-journal-citation"),
            "full_journal": span("docsum-journal-citation full-journal-citation"),
            "PMID": span("docsum-pmid"),
            "freemark": "FreePMCArticle" if "Free PMC article" in free
            else "FreeArticle" if "Free article" in free else "None",
            "reviewmark": span("publication-type spaced-citation-item citation-part") != "",
        })
    return rows


def details(html):
    root = Tree(html).root
    names = ("Background", "Methods", "Results", "Conclusions", "Registration", "Keywords")
    out = {}
    out["PMID"] = first(
        (t for box in root.find(id="full-view-identifiers")
         for s in box.find("strong", class_="current-id") for t in s.texts()), None)
    links = [t for s in root.find("span", class_="identifier pmc")
             for a in s.find("a", class_="id-link") for t in a.texts()]
    out["PMCID"] = first(t.strip() for t in links if "PMC" in t)
    out["doi"] = first(
        t for u in root.find("ul", id="full-view-identifiers")
        for s in u.find("span", class_="identifier doi")
        for a in s.children if isinstance(a, Node) and a.tag == "a"
        and a.attrs.get("class") == "id-link" for t in a.texts()).strip()
    group = first(root.find("div", class_="expanded-authors"), None)
    found = [t for li in group.find("li") if "data-affiliation-id" in li.attrs
             for t in li.texts()] if group else []
    out["affiliations"] = [
        f"{i}.{re.sub(r'\s{2,}', '', t.strip()).strip()}" for i, t in enumerate(found, 1)]
    out["full_text_link"] = first(
        a.attrs["href"] for box in root.find("div", class_="full-text-links")
        for lst in box.find("div", class_="full-text-links-list")
        for a in lst.children if isinstance(a, Node) and a.tag == "a" and "href" in a.attrs)
    paragraphs = [p for page in root.find("div", id="article-page")
                  for main in page.find("main", id="article-details")
                  for block in main.find("div", id="abstract") for p in block.find("p")]
    for name in names:
        value = ""
        for p in paragraphs:
            heads = [s.children[0] for s in p.find("strong", class_="sub-title")
                     if s.children and isinstance(s.children[0], str)]
            if any(name in h for h in heads):
                text = " ".join(t.strip() for t in p.all_texts() if t.strip())
                value = re.sub(r"\s{2,}", " ", text)
        out[name.lower()] = value
    plain = first((t for box in root.find("div", id="eng-abstract") for p in box.children
                   if isinstance(p, Node) and p.tag == "p" for t in p.texts()))
    out["abstract"] = re.sub(r"\s{2,}", " ", plain).strip()
    return out
