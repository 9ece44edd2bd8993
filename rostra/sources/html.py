"""Structure of saved web pages, read with the standard library's parser inside Arrow UDFs; fetching stays outside."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    """An element: name, attributes, children (elements and strings) and parent."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in the order of the page."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def has(self, name: str | None = None, cls: str | None = None) -> bool:
        """Is it an element of the name and with all the classes?"""
        own = self.attrs.get("class", "").split()
        return (name is None or self.name == name) and (cls is None or all(c in own for c in cls.split()))

    def find(self, name: str | None = None, cls: str | None = None) -> list[Node]:
        """Elements below with a name and classes."""
        return [n for n in self.walk() if n.has(name, cls)]

    def own(self, name: str | None = None, cls: str | None = None) -> list[Node]:
        """Children with a name and classes."""
        return [n for n in self.children if isinstance(n, Node) and n.has(name, cls)]

    def text(self, joint: str = "") -> str:
        """Trimmed text of the element and what is below."""
        parts: list[str] = []

        def gather(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    if c.strip():
                        parts.append(c.strip())
                elif c.name not in ("script", "style"):
                    gather(c)

        gather(self)
        return joint.join(parts)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.name in _CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None:
            self.at = n.parent or self.root

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """Element tree of a page, however badly closed."""
    t = _Tree()
    t.feed(html or "")
    return t.root


def _facts(root: Node, filled: bool = True) -> list[str]:
    """Lines of head and cell of the infobox; those with an empty side too, if asked for."""
    box = next(iter(root.find(cls="infobox")), None)
    out = []
    for row in box.find("tr") if box else ():
        heads, cells = row.find("th"), row.find("td")
        if heads and cells and (not filled or heads[0].text(" ") and cells[0].text(" ")):
            out.append(f"{heads[0].text(' ')}: {cells[0].text(' ')}")
    return out


def _content(root: Node, names: tuple[str, ...]) -> list[str]:
    """Texts of the elements of some names in the body of an article, in order."""
    body = next((n for m in root.find() if m.attrs.get("id") == "mw-content-text" for n in m.find(cls="mw-parser-output")), None)
    return [t for n in (body.walk() if body else ()) if n.name in names and (t := n.text(" "))]


def article_intro(html: str | None) -> str:
    """First paragraph of an encyclopedia article that has a text."""
    return next((t for m in tree(html).find() if m.attrs.get("id") == "mw-content-text" for p in m.find("p") if (t := p.text())), "")


def article_text(html: str | None, form: str = "block") -> str:
    """Main text and infobox of an encyclopedia article as one text.

    ``block``: a blank line behind every part, tables in their place; ``sorted``: tables behind all else; ``compact``: the
    first paragraph on top, a line for each part, no tables, and every row of the infobox.
    """
    root = tree(html)
    flow = ("p", "h2", "h3", "li")
    if form == "compact":
        intro = article_intro(html)
        return "\n".join([*([intro, ""] if intro else []), "Main text:", *_content(root, flow), "", "Infobox:", *_facts(root, False)]).strip()
    main = _content(root, (*flow, "table")) if form == "block" else _content(root, flow) + _content(root, ("table",))
    return "\n".join(["Main text:", "", *(x for t in main for x in (t, "")), "Infobox:", "", *_facts(root)]).strip()


def linked_data(html: str | None) -> str:
    """The page's linked-data script, else its text."""
    root = tree(html)
    for n in root.find("script"):
        if n.attrs.get("type") == "application/ld+json":
            return "".join(c for c in n.children if isinstance(c, str)).strip()
    return root.text("\n")


def business_dates(html: str | None) -> list[str]:
    """ISO dates of a month's calendar that have business, each once, in order."""
    out: dict[str, None] = {}
    for a in tree(html).find("a", "day-link"):
        label = a.attrs.get("aria-label", "")
        if "has business" in label.lower():
            try:
                out[datetime.strptime(label.split(".")[-1].strip(), "%A %d %B %Y").strftime("%Y-%m-%d")] = None
            except ValueError:
                continue
    return list(out)


def download_links(html: str | None, base: str) -> list[str]:
    """Absolute links to HTML downloads: those of the labelled menu, else any menu entry that names HTML."""
    root = tree(html)

    def listed(items: list[Node]) -> list[str]:
        found = [a.attrs["href"] for a in items if a.attrs.get("href") and ("html" in a.text(" ").lower() or a.attrs["href"].lower().endswith(".html") or "/html" in a.attrs["href"].lower())]
        return list(dict.fromkeys(base + h if h.startswith("/") else h for h in found))

    for label in root.find("div"):
        if label.text() == "HTML Downloads":
            menu: Node | None = label.parent
            while menu is not None and not menu.has("div", "dropdown-menu"):
                menu = menu.parent
            if menu is not None and (links := listed(menu.find("a", "dropdown-item"))):
                return links
    return listed(root.find("a", "dropdown-item"))


def contributions(html: str | None, base: str = "") -> list[tuple[str, str, str]]:
    """(speaker, url, speech) of a section page: the members' blocks, else its paragraphs without a speaker; none for a missing page."""
    root = tree(html)
    if re.search(r"Page\s+not\s+found", root.text("\n"), re.I):
        return []
    out = []
    for block in root.find("div", "hentry member_contribution"):
        for cite in block.find("cite", "member")[:1]:
            link = next(iter(cite.find("a")), None)
            url = link.attrs.get("href", "") if link else ""
            speech = "\n".join(t for p in block.find("p") if (t := p.text(" ")))
            out.append(((link or cite).text(), base + url if url.startswith("/") else url, speech))
    return out or [("", "", t) for p in root.find("p") if (t := p.text(" "))]


def missing_page(html: str | None) -> bool:
    """Is it a page that says that there is none? Its link belongs on the list of failed ones."""
    return html is None or re.search(r"Page\s+not\s+found", tree(html).text("\n"), re.I) is not None


def section_index(html: str | None, base: str = "") -> list[dict]:
    """Sections of a day's index as a tree: title, url, column, word_length, subsections.

    The column is the reference that stands last before an entry; a list right behind an entry, but for such references,
    holds its subsections.
    """

    def level(ol: Node) -> list[dict]:
        out: list[dict] = []
        column, open_ = None, None
        for n in ol.own():
            if n.has("span", "section-column-reference"):
                column = n.text()
                continue
            if n.name == "ol" and open_ is not None:
                open_["subsections"] = level(n)
            open_ = None
            if n.name != "li":
                continue
            link = next((a for span in n.find("span", "section-link") for a in span.find("a")), None)
            if link is None:
                continue
            length = next(iter(n.find("span", "section-word-length")), None)
            open_ = {"title": link.text(), "url": urljoin(base, link.attrs.get("href", "")), "column": column, "word_length": length.text() if length else None, "subsections": []}
            out.append(open_)
        return out

    top = next(iter(tree(html).find("ol")), None)
    return level(top) if top else []


_DAY = r"[A-Za-z]+\s+\d{1,2},\s*\d{4}"
_DATED = re.compile(rf"(.+?)\s+({_DAY}(?:\s*[-–]\s*(?:{_DAY})?)?)$")


def speaker_page(html: str | None) -> dict | None:
    """A speaker's page: name, dates and, by heading, the entries (content, dates) below it; None for another page.

    Lists and paragraphs under a heading are its entries; of constituencies the link is the content; contributions are left out.
    """
    root = tree(html)
    card = next(iter(root.find("h1", "vcard")), None)
    if card is None or card.parent is None:
        return None
    around = card.parent.children
    after = around[around.index(card) + 1] if around.index(card) + 1 < len(around) else ""
    held: dict[str, list[dict]] = {}
    for head in root.find("h2"):
        key = head.text(" ").lower().replace(" ", "_")
        if key == "contributions" or head.parent is None:
            continue
        entries = []
        below = head.parent.children
        for n in below[below.index(head) + 1 :]:
            if not isinstance(n, Node):
                continue
            if n.name == "h2":
                break
            for item in n.find("li") if n.name in ("ol", "ul") else [n] if n.name == "p" else ():
                text = item.text(" ")
                link = next(iter(item.find("a")), None) if key == "constituencies" else None
                if link is not None:
                    entries.append({"content": link.text(), "dates": text.replace(link.text(), "").strip()})
                elif text:
                    m = _DATED.match(text)
                    entries.append({"content": m[1], "dates": m[2]} if m else {"content": text, "dates": None})
        if entries:
            held[key] = entries
    return {"name": card.text(" "), "dates": after.strip() if isinstance(after, str) else "", "entries": held}


def speaker_index(html: str | None, base: str) -> list[tuple[str, str, str]]:
    """(name, dates, url) of an index page of speakers."""
    out = []
    for item in tree(html).find("li"):
        link = next((a for a in item.find("a") if "href" in a.attrs), None)
        if link is not None:
            out.append((link.text(), item.text(" ").replace(link.text(), "").strip(), urljoin(base, link.attrs["href"])))
    return out


def sections(html: str | None, base: str = "") -> list[tuple[str, str, int]]:
    """(title, url, depth) of a nested list of section links, in order."""
    out: list[tuple[str, str, int]] = []

    def lists(node: Node, depth: int) -> None:
        for item in node.own("li"):
            for span in item.find("span", "section-link")[:1]:
                for a in span.find("a")[:1]:
                    href = a.attrs.get("href", "")
                    out.append((a.text(), base + href if href.startswith("/") else href, depth))
            for inner in item.own("ol"):
                lists(inner, depth + 1)

    for top in tree(html).find("ol"):
        up: Node | None = top.parent
        while up is not None and up.name != "ol":
            up = up.parent
        if up is None:
            lists(top, 0)
    return out


def debate_tree(html: str | None, base: str = "") -> list[dict]:
    """Debates of a day page as nested objects: heading, items, contributions, subdebates, depth."""

    def one(div: Node, depth: int) -> dict:
        heads = [n for n in div.own() if n.name in ("h2", "h3")]
        items = div.own("div", "debate-item")
        spoken = [(i, i.find("div", "contribution")) for i in items]
        said = []
        for _, found in spoken:
            for c in found[:1]:
                who = next(iter(c.find("a", "attributed-to-details")), None)
                parts = [n.text() for cls in ("primary-text", "secondary-text") for n in (who.find("div", cls)[:1] if who else ())]
                href = who.attrs.get("href") if who else None
                paragraphs = [t for box in c.find("div", "content")[:1] for p in box.find("p") if (t := p.text())]
                said.append({
                    "speaker": "UNKNOWN" if who is None else " — ".join(parts) if len(parts) == 2 else who.text(" "),
                    "speaker_url": base + href if href and href.startswith("/") else href, "paragraphs": paragraphs,
                })
        return {
            "heading": heads[0].text() if heads else None, "items": [t for i, found in spoken if not found for p in i.find("p") if (t := p.text())],
            "contributions": said, "subdebates": [one(x, depth + 1) for box in div.own("div", "child-debate-list") for x in box.own("div", "child-debate")], "depth": depth,
        }

    root = next(iter(tree(html).find("div", "child-debate-list")), None)
    return [one(x, 0) for x in root.own("div", "child-debate")] if root else []


def html_udf(read: Callable, kind: str):  # noqa: ANN201
    """A pandas UDF that applies one of the readers to a column of pages."""

    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: read(x) if isinstance(x, str) else None)

    return run
