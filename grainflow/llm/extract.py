"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Names and words of HTML and of web pages.
#: Elements whose content isn't markup, up to their closing tag; none of it is text of the page.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand on lines of their own; all others are parts of a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
JUNK = frozenset("nav footer aside form search select button dialog menu head option fieldset datalist template object svg canvas audio video annotation annotation-xml".split())
JUNK_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentlists commenter disqus".split())
#: A word that says so by its beginning or end.
COMMENT_PART = re.compile(r"comments?$|^comment(?!ar|at)")
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs consent cookie cookies disclaimer "
    "footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo "
    "promos promotion recommended related replies respond search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe "
    "subscription tagcloud toolbar widget widgets".split()
)
#: Of these, the words by which a part of a line is left out.
LINE_WORDS = JUNK_WORDS - frozenset("disclaimer header login notice notices recommended related replies respond search widget widgets".split())
#: Words of what stands beside a text, however much of it there is: left out wherever any other text is left.
BESIDE = frozenset("related recommended newsletter promo promos share sharing social sponsor sponsored sponsors discussion discussions thread threads reactions guestbook".split())
#: Words of an entry that a reader wrote; entries that look alike and hold one are a list of comments.
ENTRY_WORDS = frozenset("avatar reply replies vote votes upvote upvotes downvote username commenter".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: A class name that starts with one of these says how a page looks, not what an element is.
STATES = frozenset("with has no show hide is without".split())
#: Of these a header is the head of the text.
OWN = frozenset("article entry post story".split())
PRIOR = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of which text may be a paragraph of its own.
HOLDERS = frozenset("div section article main body td html center figure".split())
#: Commas of many scripts.
COMMAS = re.compile("[,՝،߸፣᠂᠈、꓾꘍︐︑﹐﹑，､]")
#: Scripts that write a word or syllable with one character.
DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯\U00020000-\U0003ffff]")
#: An opening tag ends the open ones of the first set, up to an element of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: By element, the open elements that can't be seen from inside it.
HIDES = {s: frozenset(x for ended, stop in ENDS.values() if s in stop for x in ended) for s in ("ul", "ol", "menu", "dir", "dl", "tr", "td", "th", "table", "select")}

#: A tag from its name on. Quotes count after an equals sign only; no part is tried twice.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>")
LOOSE = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAME = re.compile("/?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)|</{t}\Z", re.I) for t in RAW}

CLASS = re.compile(r"""(?i)\bclass\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
#: Characters of a link in a menu, on average, at most.
MENU_LINK = 40

#: Part of the points of text in an element whose name is one of the junk words.
DISCOUNT = 0.2


class Node:
    """An element. junk: never text of the page. named: by its name it may be junk (2: stand beside the text), so that its points are
    discounted. look: its classes. entry: it, or what it holds, has a name of readers' entries."""

    __slots__ = ("tag", "parent", "parts", "junk", "named", "line", "look", "entry", "same", "score", "points", "chars", "linked", "links", "hidden")

    def __init__(self, tag: str, parent: Node | None, junk: bool = False, named: int = 0, line: bool = False, look: str = ""):
        self.tag, self.parent, self.junk, self.named, self.line, self.look = tag, parent, junk, named, line, look
        self.entry = bool(look) and not ENTRY_WORDS.isdisjoint(re.split(r"[^a-z]+", look))
        self.parts: list[str | Node] = []
        self.same = 0
        self.score, self.points, self.chars, self.linked, self.links = PRIOR.get(tag, 0.0), 0.0, 0, 0, 0
        self.hidden: dict[str, int] = {}


def _kind(tag: str, attributes: str, inside_article: bool, words_of: frozenset = JUNK_WORDS) -> tuple[bool, int]:
    """Whether an element is junk by its tag, role, being hidden or holding readers' comments, and whether its name says that it
    may be: a menu, footer, advert, notice or the like (1), or what stands beside a text (2)."""
    if tag in JUNK or (tag == "header" and not inside_article):
        return True, 0
    if tag in ("html", "body") or not attributes and "-" not in tag:
        return False, 0
    named = int("-" in tag and not words_of.isdisjoint(tag.split("-")))
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower())
                if words[0] in STATES:
                    continue
                if not COMMENT_WORDS.isdisjoint(words) or any(map(COMMENT_PART.search, words)):
                    return True, 0
                if tag in HEADINGS:
                    continue
                found = words_of.intersection(words)
                if not BESIDE.isdisjoint(words) and words_of is JUNK_WORDS:
                    named = 2
                elif found and not (found == {"header"} and not OWN.isdisjoint(words)):
                    named = max(named, 1)
        elif name == "role" and value.lower() in JUNK_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, 0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True, 0
    return False, named


def parse(page: str) -> Node:
    """The tree of a page's block elements with their texts. Parts of lines leave a node only where they are junk; links leave their
    share of characters. One pass: a tag costs what it ends, however deep the page and however many tags don't pair."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()  # open elements by tag, as far as can be seen from here
    every: Counter[str] = Counter()  # and all of them
    link, depth, articles, loose = -1, 0, 0, False  # link: the depth at which a link is open

    def close() -> None:
        nonlocal node, depth, articles, link
        opened[node.tag] -= 1
        every[node.tag] -= 1
        opened.update(node.hidden)
        articles -= node.tag in ("article", "main")
        node, depth = node.parent, depth - 1
        if link > depth:
            link = -1

    def put(child: Node) -> None:
        nonlocal node, depth, articles
        node.parts.append(child)
        node, depth = child, depth + 1
        opened[child.tag] += 1
        every[child.tag] += 1
        articles += child.tag in ("article", "main")
        for t in HIDES.get(child.tag, ()):
            if t != child.tag and opened[t]:
                child.hidden[t] = opened[t]
                opened[t] = 0

    def text(piece: str) -> None:
        node.parts.append(piece)
        if not node.junk and (size := len(piece.strip())):
            node.chars += size
            node.linked += size * (link >= 0)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        start = page.find("<", at)
        remark = start >= 0 and page.startswith("<!--", start)
        if start < 0 or start > last and not remark:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        if remark:
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else n
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            continue
        m = (LOOSE if loose else TAG).match(page, start + 1)
        if m is None and not loose and NAME.match(page, start + 1):
            loose = True  # a quote that never ends: from here on a tag ends at the next sign for it
            m = LOOSE.match(page, start + 1)
        if m is None:
            text("<")
            at = start + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = CLOSING[tag].search(page, at)
                at = end.end() if end else n
        elif tag in VOID:
            if tag == "hr":
                node.parts.append(Node("hr", node))
            elif tag == "br":
                node.parts.append(" ")
        elif tag not in BLOCK and ("-" not in tag or tag in JUNK):
            if tag == "a":
                link = -1 if closing else depth
                node.links += not closing
            if closing:
                if node.line and node.tag == tag:
                    if node.same:
                        node.same -= 1
                    else:
                        close()
            elif not m[3].endswith("/"):
                if node.line and node.tag == tag:
                    node.same += 1
                elif not node.junk and (tag in JUNK or tag in INLINE and m[3] and not every["pre"] and any(_kind(tag, m[3], True, LINE_WORDS))):
                    put(Node(tag, node, True, 0, True))
        elif closing:
            if tag == "p" and not every["p"]:
                continue
            if every[tag] and tag not in ("html", "body"):
                while node.tag != tag or node.line:
                    close()
                close()
        elif tag not in ("html", "body") or tag == "body" and node is root:
            if (node.parent if node.line else node).tag == "p":
                if node.line:
                    close()
                close()
            ended, _ = ENDS.get(tag, ((), ()))
            if any(opened[t] for t in ended):
                while node.tag not in ended:
                    close()
                close()
            junk, named = (True, 0) if node.junk else _kind(tag, m[3], articles > 0)
            look = "" if junk or not (look := CLASS.search(m[3])) else " ".join(look[1].strip("\"'").lower().split())
            put(Node(tag, node, junk, named, look=look))
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes that aren't junk, parents first."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        found.append(x)
        todo += [y for y in reversed(x.parts) if not isinstance(y, str) and not y.junk]
    return found


def blocks(nodes: list[Node], left_out: set[int] = frozenset()) -> list[str]:
    """The texts of nodes in page order, a block per run of text between block elements: references decoded, white space as one space."""
    found: list[str] = []
    run: list[str] = []
    todo: list[str | Node | None] = list(reversed(nodes))

    def close() -> None:
        if block := " ".join(html.unescape("".join(run)).split()):
            found.append(block)
        run.clear()

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            close()
        elif not x.line:
            close()
            if not x.junk and id(x) not in left_out:
                todo.append(None)
                todo += reversed(x.parts)
    close()
    return found


def weight(text: str) -> float:
    """The points of a paragraph: one, one for each comma (a comma needs fifteen characters around it), and up to three for its length.
    A character of a script that writes words with one counts as three."""
    size = len(text) + 2 * len(DENSE.findall(text))
    return 1.0 + min(len(COMMAS.findall(text)), size / 15.0) + min(size / 100.0, 3.0)


def _comments(x: Node) -> bool:
    """Whether an element is a list of readers' entries: two or more parts of one look, most of them with names of entries."""
    parts = [y for y in x.parts if not isinstance(y, str) and not y.junk and y.chars]
    if len(parts) < 2:
        return False
    (_, n), entries = Counter((y.tag, y.look) for y in parts).most_common(1)[0], sum(y.entry for y in parts)
    return n > 1 and entries > 1 and 3 * entries >= 2 * len(parts)


def _left_out(kept: list[Node]) -> set[int]:
    """Elements inside the kept ones that stay out: menus, lists of short links and nothing else; and, while there is other text, those
    named as standing beside a text and lists of readers' entries; others named like junk unless a fifth of their points is
    more than all that would be left."""
    found: set[int] = set()
    for top in kept:
        todo = [y for y in reversed(top.parts) if not isinstance(y, str) and not y.junk]
        left = top.points
        while todo:
            x = todo.pop()
            menu = x.links > 1 and x.linked == x.chars < MENU_LINK * x.links and x.tag not in ("p", *HEADINGS)
            beside = (x.named == 2 or _comments(x)) and x.points < left
            if menu or beside or x.named and DISCOUNT * x.points <= left - x.points:
                found.add(id(x))
                left -= x.points
            else:
                todo += [y for y in reversed(x.parts) if not isinstance(y, str) and not y.junk]
    return found


def _head(parts: list[Node], at: int) -> int:
    """Where the head of the text begins: a title among the siblings before it, with nothing but short lines in between; else at."""
    for i in range(at - 1, -1, -1):
        x = parts[i]
        if x.tag in ("h1", "h2"):
            return i
        if x.tag in ("ul", "ol", "table") or x.named or x.chars > 300 or x.links and 2 * x.linked > x.chars:
            break
    return at


def main_text(page: str | None) -> str:
    """The main text of a page. Paragraphs pass points for their length and commas to the element around them, half to the
    next and less to those further up, a fifth of them in an element that is named like junk; an element's points are discounted by
    its link density. The best container is kept (the article around it, where the page marks one), with its siblings that score
    well, look like it or read like its text, and the title before it."""
    if not page:
        return ""
    nodes = _walk(root := parse(page))
    named: set[int] = set()
    for x in nodes:
        if x.named or x.parent is not None and id(x.parent) in named:
            named.add(id(x))
        own = "".join(y for y in x.parts if isinstance(y, str)).strip()
        if own and x.linked * 2 <= x.chars:
            x.points = weight(own)
            points = x.points * (DISCOUNT if id(x) in named else 1.0)
            up, level = x if x.tag in HOLDERS else x.parent, 0
            while up is not None and level < 5:
                up.score += points / (1, 2, 6, 9, 12)[level]
                up, level = up.parent, level + 1
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.links += x.links
            x.parent.points += x.points
            x.parent.entry |= x.entry
    density = lambda x: x.linked / x.chars if x.chars else 0.0
    value = {id(x): x.score * (1.0 - density(x)) for x in nodes}
    boxes = [x for x in nodes if x.chars and x.tag not in ("p", "li", "dt", "dd", "tr", *HEADINGS)]
    if not boxes:
        return ""
    best = max(boxes, key=lambda x: value[id(x)])  # the first of equals, so the outer one
    around, up = {}, best
    while up is not None:
        around[up.tag] = up  # the outermost of each
        up = up.parent
    best = around.get("article") or around.get("main") or best
    kept = [best]
    if best is not root and best.parent is not None:
        bar, kept = max(10.0, 0.2 * value[id(best)]), []
        siblings = [x for x in best.parent.parts if not isinstance(x, str) and not x.junk and x.tag != "hr"]
        at = next(i for i, x in enumerate(siblings) if x is best)
        head = _head(siblings, at)
        alike = best.tag in ("section", "article") or best.tag in HOLDERS and best.parent.tag not in ("body", "html")
        for i, x in enumerate(siblings):
            if x.named and x is not best:
                continue
            if head <= i < at or alike and x is not best and (x.tag, x.look) == (best.tag, best.look) and x.points and density(x) < 0.25:
                kept.append(x)
                continue
            reads = x.tag == "p" and density(x) < 0.25 and (x.chars > 80 or x.chars and density(x) == 0 and re.search(r"[.!?。！？۔؟।።]\s*$", (blocks([x]) or [""])[-1]))
            if x is best or value[id(x)] >= bar and x.tag not in ("ul", "ol") or reads:
                kept.append(x)
    return "\n\n".join(blocks(kept, _left_out(kept)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars.

    A null or empty html, and a page without main text, give an empty text; repeated rows stay; other columns are not read;
    an empty table gives an empty one. Broken markup is read as far as it goes: an unclosed tag ends with its parent. Time is
    in proportion to a page's length."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
