"""Operator 4: main text of web pages by tree scoring.

A page becomes a tree of elements. Elements that are never part of an article
(scripts, forms, menus, footers and the like by tag; comments, adverts, cookie
notices and the like by role, class or id) are left out with all they hold. Each
paragraph, a run of text between block boundaries, gives points for its length
and commas to its parent, half of them to the grandparent and a falling share to
the next ancestors. An element's points are discounted by its link density, and
the best one is the container; an article or main element around it takes its
place. Its siblings are kept with it unless links make up most of their text,
and headings before it.

A form outside an article is left out unless it wraps one, or much text, as
pages of some servers are one form; what stands in the midst of a sentence, such
as a button, is left out without ending the sentence, and formulas are text.

Inside an article element less is left out: names such as `tags`, `share` or
`notice`, and compounds such as `related-work`, only where the element reads like
a set of links or labels, without a paragraph; lists of links stay. An article inside an article is a reader's
comment, as the HTML standard has it. Outside, link lists are menus if their
links are short. Names count as whole words between spaces, - and _; a header
stays with its article if it is named after it (`post-header`, `entry-header`).

Work grows linearly with the page, however deep it nests.

Defined cases: null html counts as empty; a page without text gives an empty
text; very long pages are read whole; open or badly nested tags are closed as
browsers do; a quoted value that never ends stops at the next space or `>`; a
comment or raw element that never ends runs to the end of the page; repeated
rows give repeated results; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: White space and slashes before an attribute, its name, and what precedes its value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "xmp"}
LEFT_OUT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Formulas, and elements that are left out within a line.
FORMULA = {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mpadded", "mstyle", "mphantom", "menclose", "merror"}
WITHIN = {"button", "select", "svg", "canvas", "audio", "video", "object", "iframe", "script", "style", "noscript", "template", "annotation", "annotation-xml"}
INLINE |= FORMULA
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", *HEADINGS}
#: Elements that an opening tag of the same kind, or another of the set, ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles beside an article, wherever they stand.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|breadcrumbs?|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|popup|modal|overlay|footer|masthead|"
    r"menu|nav|navbar|navigation|navlinks|toolbar|pagination|pager|related|recommend\w*|sidebar|widgets?|subscribe|newsletter|signup|login|complementary|contentinfo|dialog|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Of these, words that an article may use in compounds for a part of its own.
COMPOUND = re.compile(r"^(?:modal|overlay|related|recommend\w*|menu|nav|navigation|footer|promo\w*|widgets?|login|consent|popup)$", re.I)
#: Words that an article may use for a part of its own.
PERHAPS = re.compile(r"(?:^|[\s_-])(?:banner|notices?|alert|share|sharing|social|side|rail|search|skip|tags|hidden)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|main|top|global)[_-]?)?(?:header|topbar)(?:$|\s)", re.I)
#: Shares of a paragraph's points that its element and those above get.
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)
#: Of list-like elements, the link density from which they are menus, and the most characters a link has on average.
MENU_DENSITY, MENU_LINK = 0.75, 30
#: A paragraph has so many characters.
PARAGRAPH = 25
#: A form with so many paragraph tags is a page, not a form.
FORM_PARAGRAPHS = 5


class Node:
    __slots__ = ("tag", "parent", "children", "points", "chars", "linked", "links", "paragraphs", "perhaps", "inside")

    def __init__(self, tag: str, parent: Node | None, perhaps: bool = False, inside: bool = False) -> None:
        self.tag, self.parent, self.perhaps, self.inside = tag, parent, perhaps, inside
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.links, self.paragraphs = 0.0, 0, 0, 0, 0

    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else 0.0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


class Tags:
    """Reads the attributes of one page's tags; each closing quote is looked for once."""

    def __init__(self, html: str) -> None:
        self.html, self.last = html, {q: html.rfind(q) for q in "\"'"}

    def read(self, pos: int) -> tuple[int, str, bool]:
        """From behind a tag's name: where the tag ends, its class, id and role, and whether it closes itself."""
        html, end, names = self.html, len(self.html), []
        while pos < end and html[pos] != ">":
            m = ATTRIBUTE.match(html, pos)
            at = m.end()
            if m[2] is None:
                pos = at if at > pos else pos + 1
                continue
            quote = html[at : at + 1]
            if quote in self.last and self.last[quote] > at:
                close = html.index(quote, at + 1)
                value, pos = html[at + 1 : close], close + 1
            else:
                found = BARE.match(html, at)
                value, pos = found[0], found.end()
            if m[1].lower() in ("class", "id", "role"):
                names.append(value)
        return min(pos + 1, end), " ".join(names), html[pos - 1 : pos] == "/"


def kind_of(tag: str, names: str, articles: int, mains: int) -> str:
    """"out" for an element that is none of an article's, "perhaps" for one whose content decides, else nothing."""
    if tag in LEFT_OUT or (tag == "header" and not (articles or mains)) or (tag == "article" and articles):
        return "out"
    if tag in ("body", "html", "article", "main") or not names:
        return ""
    if articles and own_part(names):
        return "perhaps"
    if BESIDE.search(names) or (not (articles or mains) and tag not in HEADINGS and HEADER.search(names)):
        return "out"
    if PERHAPS.search(names):
        return "perhaps" if articles else "out"
    return ""


def own_part(names: str) -> bool:
    """Whether names are beside an article only by a word within a compound that may be a part of it."""
    found = False
    for name in names.split():
        if BESIDE.search(name):
            words = re.split("[-_]+", name)
            if len(words) < 2 or not all(COMPOUND.match(w) or not BESIDE.search(w) for w in words):
                return False
            found = True
    return found


_FORM_END = re.compile("</form", re.I)


class Forms:
    """Tells pages wrapped in a form from forms; each end of a form is looked at once."""

    def __init__(self, html: str) -> None:
        self.html, self.seen, self.end = html, {}, -1

    def wrap(self, pos: int) -> bool:
        if self.end < pos:
            m = _FORM_END.search(self.html, pos)
            self.end = m.start() if m else len(self.html)
        if self.end not in self.seen:
            held = self.html[pos : self.end].lower()
            self.seen[self.end] = "<article" in held or "<main" in held or len(re.findall(r"<p[\s>]", held)) >= FORM_PARAGRAPHS
        return self.seen[self.end]


def tree(html: str) -> tuple[Node, list[Node]]:
    """The root, and all nodes in page order. Block texts are strings among the children."""
    root = Node("body", None)
    nodes, here, buffer = [root], root, []
    linked, articles, mains, in_link = 0, 0, 0, 0
    opened: Counter[str] = Counter()  # elements above here, by tag
    skip: list[str] = []  # open elements from the one left out on
    skipped: Counter[str] = Counter()
    tags, forms = Tags(html), Forms(html)

    def flush() -> None:
        nonlocal linked, buffer
        if not buffer:
            return
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            here.children.append(text)
            here.chars += len(text)
            here.linked += round(len(text) * min(1.0, linked / max(1, sum(map(len, buffer)))))
            if len(text) >= PARAGRAPH:
                here.paragraphs += 1
                points = 1 + text.count(",") + min(len(text) / 100, 3)
                # a paragraph's element passes the points on to those above
                node = here.parent if here.tag in PARAGRAPHS and here.parent is not None else here
                for share in SHARES:
                    if node is None:
                        break
                    node.points += points * share
                    node = node.parent
        buffer, linked = [], 0

    def leave() -> None:
        nonlocal here, articles, mains
        articles -= here.tag == "article"
        mains -= here.tag == "main"
        opened[here.tag] -= 1
        here = here.parent

    pos, end = 0, len(html)
    while pos < end:
        at = html.find("<", pos)
        if at != pos:
            at = end if at < 0 else at
            if not skip:
                buffer.append(html[pos:at])
                linked += (at - pos) * in_link
            pos = at
            continue
        if html.startswith("<!--", pos):
            at = html.find("-->", pos + 2)
            pos = end if at < 0 else at + 3
            continue
        if html[pos + 1 : pos + 2] in ("!", "?"):
            at = html.find(">", pos)
            pos = end if at < 0 else at + 1
            continue
        closing = html.startswith("</", pos)
        named = NAME.match(html, pos + 1 + closing)
        if not named:
            if not skip:
                buffer.append("<")
                linked += in_link
            pos += 1
            continue
        tag = named[0].lower()
        pos, names, closed = tags.read(named.end())
        if skip:
            if closing:
                if skipped[tag] > 0:
                    while True:
                        last = skip.pop()
                        skipped[last] -= 1
                        if last == tag:
                            break
            elif tag not in VOID and not closed:
                if tag in RAW:
                    pos = raw_end(html, pos, tag)
                else:
                    if (tag == "p" and skip[-1] == "p" or tag in ENDS and skip[-1] in ENDS[tag]) and len(skip) > 1:
                        skipped[skip.pop()] -= 1
                    skip.append(tag)
                    skipped[tag] += 1
            continue
        if closing:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE:
                flush()
                if opened[tag] > 0:
                    while here.tag != tag:
                        leave()
                    leave()
                    in_link = 0
            continue
        if tag in VOID or tag in ("html", "body"):
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        block = tag not in INLINE
        kind = kind_of(tag, names, articles, mains)
        if tag == "form" and not (articles or mains) and forms.wrap(pos):
            kind = ""
        if kind == "out":
            if tag in WITHIN:
                block = False
                buffer.append(" ")
            if block:
                flush()
            if tag in RAW:
                pos = raw_end(html, pos, tag)
            elif not closed:
                if tag != "p" and block and here.tag == "p":
                    leave()
                skip = [tag]
                skipped = Counter(skip)
            continue
        if tag == "a":
            in_link = 1
            here.links += 1
            continue
        if not block:
            continue
        flush()
        in_link = 0
        if here.tag == "p" or here.tag in HEADINGS and tag in HEADINGS or tag in ENDS and here.tag in ENDS[tag] and here.parent is not None:
            leave()
        here = Node(tag, here, kind == "perhaps", articles > 0)
        here.parent.children.append(here)
        nodes.append(here)
        opened[tag] += 1
        articles += tag == "article"
        mains += tag == "main"
    flush()
    for node in reversed(nodes[1:]):  # children come after their parents
        up = node.parent
        up.chars += node.chars
        up.linked += node.linked
        up.links += node.links
        up.paragraphs += node.paragraphs
    return root, nodes


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def raw_end(html: str, pos: int, tag: str) -> int:
    """Where the text of a raw element ends, its closing tag included."""
    m = _RAW_ENDS[tag].search(html, pos)
    return m.end() if m else len(html)


def menu(node: Node) -> bool:
    """Whether an element is a set of links or labels rather than text."""
    if node.perhaps:
        return not node.paragraphs or node.density() > 1 / 3
    listed = not node.inside and node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.links >= 3
    return listed and node.density() >= MENU_DENSITY and node.linked <= MENU_LINK * node.links


def blocks(node: Node, out: list[str]) -> list[str]:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not menu(x):
            todo.extend(reversed(x.children))
    return out


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by line feeds."""
    if not html:
        return ""
    root, nodes = tree(html)
    best = max(nodes, key=Node.score)
    if best.score() <= 0:
        best = next((n for n in nodes if n.tag in ("article", "main") and n.chars), root)
    at = best
    while at is not None:
        if at.tag in ("article", "main"):
            best = at
            if at.tag == "article":
                break
        at = at.parent
    out: list[str] = []
    if best.parent is None or best.tag in ("article", "main"):
        # headings of the same parent right before an article are its title
        before = best.parent.children[: best.parent.children.index(best)] if best.parent is not None else []
        title = next((i for i in range(len(before), 0, -1) if not (isinstance(before[i - 1], Node) and before[i - 1].tag in HEADINGS)), 0)
        for x in [*before[title:], best]:
            blocks(x, out)
        return "\n".join(out)
    for x in best.parent.children:
        if isinstance(x, str):
            out.append(x)
        elif x is best or (x.chars and x.density() < 0.5):
            blocks(x, out)
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(batches, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op4_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
