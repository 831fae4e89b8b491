"""HTML extraction by a tree-structured graphical model.

A page's DOM is a tree of binary variables (content or not). Each node has a unary potential, logistic in features of
its tag, names and text; each parent-child edge has a 2 x 2 potential. Sum-product messages go up from the leaves and
down from the root, which gives every node's exact content marginal. Both potentials are trained from labelled pages:
pages whose nodes are marked as content or not (here the built-in labelled pages of `training_pages`, or any given).
Blocks whose marginal exceeds 1/2 are joined in page order. Forms are left out by their tag unless they hold most of
the page's text outside links, as a wrapper of the page does; then the model decides.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import fit_logistic, pieces_of

# Tags by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object noembed noframes xmp".split())
HIDDEN = frozenset("script style noscript template head title iframe svg object noembed noframes textarea select option button form input label".split())
BLOCKS = frozenset("html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr dialog menu center legend".split())
ENDS_P = BLOCKS - {"html", "head", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "summary", "figcaption", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre dd dt figcaption caption".split())
GOOD_NAMES = re.compile(r"article|content|post|story|entry|main|body|text|prose")
BAD_NAMES = re.compile(r"nav|menu|header|footer|side|aside|comment|reply|respon|discuss|cookie|consent|notice|banner|popup|modal|overlay|(?:^|[\W_])ads?(?:$|[\W_\d])|advert|sponsor|promo|share|social|relat|recommend|widget|form|subscri|newsletter|signup|login|search|breadcrumb|pagin|copyright|legal|toolbar|tags|meta|byline|outbrain|taboola|gdpr|alert|rail")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_LOOSE = re.compile(r"</?(?P<tag>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CONTENT = re.compile(r"""\bdata-content\s*=\s*["']?([01])""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "kids", "link", "own", "parent", "parts", "place", "tag", "text")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []  # text and children in page order
        self.text = self.link = self.own = self.kids = 0
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def parse(html: str | None) -> Node:
    """The DOM of a page: blocks close open paragraphs, items close items, stray end tags are dropped."""
    root = Node("#root", "", None)
    at, here, html = 0, root, html or ""
    end = len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            here.parts.append(html[at:])
            break
        if lt > at:
            here.parts.append(html[at:lt])
        m = _TOKEN.match(html, lt)
        if m is None:
            m = _LOOSE.match(html, lt)
            if m is None:
                here.parts.append("<")
                at = lt + 1
                continue
            tag, closing, attrs = m["tag"].lower(), m[0].startswith("</"), m[0]
        elif m["tag"] is None:
            at = m.end()
            continue
        else:
            tag, closing, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"]
        at = m.end()
        if closing:
            node = here
            while node is not root and node.tag != tag:
                if tag not in BLOCKS and node.tag in BLOCKS:
                    node = root  # an inline end tag doesn't close blocks
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag == "br":
                here.parts.append(" ")
            continue
        if tag == "br":
            here.parts.append(" ")
            continue
        if tag in ENDS_P:
            node = here
            while node is not root and node.tag != "p" and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in SIBLINGS:
            node = here
            while node is not root and node.tag not in LIMITS[tag] and node.tag not in SIBLINGS[tag]:
                node = node.parent
            outer = node if node.tag in SIBLINGS[tag] else None
            while outer is not None:
                here = outer.parent
                outer = here if here is not root and here.tag in SIBLINGS[tag] else None
        node = Node(tag, attrs, here)
        if tag in VOID:
            continue
        if tag == "svg" and attrs.rstrip().endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if stop or tag != "svg":  # an svg that never ends holds no rest of the page
                at = stop.end() if stop else end
            continue
        if not attrs.rstrip().endswith("/") or tag in BLOCKS:
            here = node
    return root


def _nodes(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.place = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _open_forms(nodes: list[Node]) -> None:
    """Makes blocks of forms that hold most of the page's text outside links, so that the model decides on them."""
    if not any(node.tag == "form" for node in nodes):
        return
    hidden = HIDDEN - {"form"} | {"a"}
    held = [sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace()) for node in nodes]
    for node in reversed(nodes):
        if node.tag in hidden:
            held[node.place] = 0
        if node.parent is not None:
            held[node.parent.place] += held[node.place]
    for node in nodes:
        if node.tag == "form" and 2 * held[node.place] > held[0]:
            node.tag = "div"


_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "a", "body", "figcaption")
WIDTH = len(_TAGS) + 10


def _features(nodes: list[Node]) -> np.ndarray:
    for node in nodes:
        node.text = sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace())
        node.link = node.kids = 0
        node.own = node.text
    for node in reversed(nodes):
        if node.tag in HIDDEN:
            node.text = node.own = 0
        if node.tag == "a":
            node.link = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.link += node.link
            if node.tag not in BLOCKS:
                node.parent.own += node.own
            elif node.tag in PROSE:
                node.parent.kids += node.own
    out = np.zeros((len(nodes), WIDTH))
    for i, node in enumerate(nodes):
        names = " ".join(x for m in _NAMES.findall(node.attrs) for x in m if x).lower() if "=" in node.attrs else ""
        row = out[i]
        if node.tag in _TAGS:
            row[_TAGS.index(node.tag)] = 1
        k = len(_TAGS)
        row[k] = node.tag in HIDDEN
        row[k + 1] = bool(BAD_NAMES.search(names))
        row[k + 2] = bool(names and GOOD_NAMES.search(names)) and not row[k + 1]
        row[k + 3] = min(1.0, node.own / 60)
        row[k + 4] = min(1.0, node.own / 400)
        row[k + 5] = node.link / max(1, node.text)
        row[k + 6] = min(1.0, node.kids / 300)
        row[k + 7] = node.tag not in BLOCKS
        row[k + 8] = bool(names)
        row[k + 9] = node.text == 0
    return out


@dataclass(frozen=True)
class HtmlModel:
    """unary: weights of the features and 1; pair[parent state, child state]: log-potentials."""

    unary: np.ndarray
    pair: np.ndarray


def marginals(parents: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(content) of each node of a tree by sum-product; parents come before their children, the root's is -1.

    unary is the log-odds of content; messages are log-ratios, so that deep trees don't underflow.
    """
    n = len(parents)
    up, down, own = np.zeros(n), np.zeros(n), unary.astype(float).copy()
    (a, b), (c, d) = pair.tolist()
    lae = np.logaddexp
    belief = own.tolist()
    ups = up.tolist()
    parent = parents.tolist()
    for i in range(n - 1, 0, -1):
        x = belief[i]
        ups[i] = float(lae(c, d + x) - lae(a, b + x))
        belief[parent[i]] += ups[i]
    for i in range(1, n):
        p = parent[i]
        x = belief[p] - ups[i]
        down_i = float(lae(b, d + x) - lae(a, c + x))
        belief[i] += down_i
    del up, down
    return 1 / (1 + np.exp(-np.clip(np.array(belief), -50, 50)))


def fit_html(pages: list[str]) -> HtmlModel:
    """Trains both potentials from pages whose nodes are marked by data-content="1" or "0".

    A node without a mark inherits its parent's. The edges' potentials are the smoothed log-frequencies of the four
    (parent, child) states; the unary ones are the classifier's log-odds less the base rate's, which the edges carry.
    """
    xs, ys, counts = [], [], np.ones((2, 2))
    for page in pages:
        nodes = _nodes(parse(page))
        labels = np.zeros(len(nodes), dtype=int)
        for i, node in enumerate(nodes):
            m = _CONTENT.search(node.attrs)
            labels[i] = int(m[1]) if m else labels[node.parent.place] if node.parent is not None else 0
            if node.parent is not None:
                counts[labels[node.parent.place], labels[i]] += 1
            node.attrs = _CONTENT.sub("", node.attrs)
        xs.append(_features(nodes))
        ys.append(labels)
    x, y = np.vstack(xs), np.concatenate(ys)
    w = fit_logistic(x, y.astype(float), ridge=0.3)
    w[-1] -= np.log(y.mean() / (1 - y.mean()))
    return HtmlModel(w, np.log(counts / counts.sum(1, keepdims=True)))


def extract(html: str | None, model: HtmlModel) -> str:
    """The main text: the blocks of content, each with single spaces, joined by one line feed."""
    if not html:
        return ""
    root = parse(html)
    nodes = _nodes(root)
    _open_forms(nodes)
    parents = np.array([-1 if n.parent is None else n.parent.place for n in nodes])
    p = marginals(parents, _features(nodes) @ model.unary[:-1] + model.unary[-1], model.pair)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            blocks.append(text)
        words.clear()

    stack: list = [(root, iter(root.parts), False)]
    while stack:
        node, parts, inside = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node.tag in BLOCKS:
                flush()
        elif isinstance(part, str):
            if inside:
                words.append(part)
        elif part.tag not in HIDDEN:
            if part.tag in BLOCKS:
                flush()
            inside_part = bool(p[part.place] > 0.5) and (inside or part.tag in BLOCKS)
            stack.append((part, iter(part.parts), inside_part))
        elif part.tag in BLOCKS:
            flush()
    flush()
    return "\n".join(blocks)


def training_pages() -> list[str]:
    """Labelled pages: every layout with each kind of surrounding matter, content marked by data-content."""
    prose = "The river rises in the hills and runs past the old mill, where the road turns toward the town and the sea. "
    wraps = ("article", "main", 'div class="post-content"', 'section id="story"', 'div class="entry"', 'div itemprop="articleBody"', "div")
    outside = (
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">About</a></li></ul></nav>',
        '<header class="site-header"><h1>The Daily Paper</h1><p>All the news of the town</p></header>',
        '<div class="ad">Buy now and save, the offer ends soon in all our shops.</div>',
        '<div id="menu"><a href="/x">One</a> <a href="/y">Two</a></div>',
        '<aside><h3>More stories</h3><p>Another tale of the hills that you may like to read next.</p><ul><li><a href="/z">Story</a></li></ul></aside>',
        '<div class="sidebar"><p>Subscribe to our letter for more tales of hills and rivers each week.</p></div>',
        '<div class="cookie-notice"><p>We use cookies to improve your visit. Accept or read our policy for more.</p><button>Accept</button></div>',
        '<form action="/s"><p>Search this site</p><input name="q"><label>Find</label></form>',
        '<div class="comments"><h3>Comments</h3><div class="comment"><p>' + prose + "</p></div><div class=\"comment\"><p>I liked this story very much, thank you.</p></div></div>",
        '<section id="comments"><p>' + prose + "</p></section>",
        '<div class="related"><ul><li><a href="/r">' + prose + "</a></li></ul></div>",
        '<footer><p>Copyright by the paper, all rights reserved.</p><a href="/imprint">Imprint</a></footer>',
        "<footer>&copy; paper.example</footer>",
        '<script>var a = "<p>x</p>";</script><style>p{margin:0}</style>',
    )
    bodies = (
        "<h1>A tale of the river</h1>" + "".join(f"<p>{prose * k}</p>" for k in (1, 3, 6)),
        f"<h2>Part</h2><p>{prose}</p><ul><li>First point of the tale</li><li>Second point of the tale</li></ul><p>{prose * 2}</p>",
        f"<p>Short.</p><blockquote><p>{prose}</p></blockquote><p>See <a href='/q'>the mill</a> and <b>the road</b>.</p><p>{prose * 4}</p>",
        f"<h1>Title</h1><div><p>{prose * 2}</p><table><tr><td>Length</td><td>12 miles</td></tr></table></div><pre>line one\nline two</pre>",
        f"<p><b>{prose}<br><p>{prose * 3}</p><h3>End</h3><p>Yes.</p>",
        f"<p>{prose} <span class='ad' data-content='0'>Buy now</span> and <em>so</em> <a href='/l'>on and on</a>, <code>x</code>.</p><p><span>{prose}</span> <i>then</i> <span class='promo' data-content='0'>An offer for you</span></p>",
        f"<p><strong>Dateline.</strong> <span class='lead'>{prose}</span><sup><a href='#n'>1</a></sup></p><p><a href='/whole'>A link alone</a></p><p>{prose * 2}<span class='sponsored-link' data-content='0'><a href='/s'>Sponsored</a></span></p>",
    )
    inner = ("", '<aside class="related" data-content="0"><a href="/m">More on this</a></aside>', '<div class="share" data-content="0"><a href="/f">Share</a> <a href="/t">Send</a></div>', '<div class="ad" data-content="0"><p>An offer for readers of this page only.</p></div>', '<form data-content="0"><p>Get our letter by mail</p><input></form>', '<nav data-content="0"><ol><li><a href="#1">First</a></li><li><a href="#2">Second</a></li></ol></nav>')
    out = []
    for i, wrap in enumerate(wraps):
        for j, body in enumerate(bodies):
            k = i * len(bodies) + j
            before = "".join(outside[(k + s) % len(outside)] for s in (0, 3, 5, 9))
            after = "".join(outside[(k + s) % len(outside)] for s in (7, 11, 12))
            tag = wrap.split()[0]
            head = '<header data-content="0"><p>By a writer of the paper</p></header>' if k % 4 == 1 else ""
            foot = '<footer data-content="0"><p>Filed under tales</p></footer>' if k % 4 == 2 else ""
            shell = ("<div>", "</div>") if k % 3 == 0 else ('<div id="page" class="wrapper">', "</div>") if k % 3 == 1 else ("", "")
            out.append(f"<html><head><title>T</title></head><body>{shell[0]}{before}<{wrap} data-content=\"1\">{head}{body}{inner[k % len(inner)]}{foot}</{tag}>{after}{shell[1]}</body></html>")
    return out


def extract_pages(pages: DataFrame, model: HtmlModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html; one pass, no shuffle.

    Null or empty html, and pages without content, give an empty text. Null and repeated keys pass through; further
    columns are not read.
    """
    model = model or fit_html(training_pages())
    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, ["html"]):
                texts = [extract(h, model) for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
