"""Main text of web pages: boosted trees over DOM nodes and a decoding that keeps the tree consistent."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "nobr", "output", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "input", "picture", "source"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "thead": {"tr"}, "tbody": {"tr", "thead", "td", "th"}}
HOLDS = {"ul", "ol", "table", "dl", "select", "div", "article", "section", "body", "td", "th", "blockquote"}
TAGS = ["p", "h1", "h2", "h3", "h4", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul",
        "ol", "li", "table", "td", "blockquote", "pre", "figure", "figcaption", "button", "select", "dl", "body", "head"]
#: Groups of attribute tokens, matched against the words of class, id, role, aria-label and itemprop.
TOKENS = {
    "content": "article articlebody blog body content entry main maincontent post story text",
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation pagination tabs toolbar",
    "header": "banner header masthead site logo top topbar",
    "footer": "bottom colophon copyright foot footer legal",
    "side": "aside complementary popular rail recommended related side sidebar widget widgets",
    "notice": "alert consent cookie cookies gdpr modal notice notification overlay popup warning",
    "advert": "ad ads adsense advert advertisement adverts banner dfp promo promoted sponsor sponsored",
    "form": "contact form login newsletter register search signup subscribe",
    "comment": "comment commentlist comments discussion disqus replies reply respond thread",
    "social": "follow share sharing social tweet",
}
_group = {token: i for i, words in enumerate(TOKENS.values()) for token in words.split()}
_ARTICLE = [TAGS.index(t) for t in ("article", "main")]
_BOILERPLATE = [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form")]
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</?\Z", re.DOTALL)
_attribute = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))", re.DOTALL)
_digit = re.compile(r"\d")
_word = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_raw_end = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
STATS = ["depth", "subtree_chars", "own_chars", "link_share", "subtree_nodes", "chars_per_node", "own_words", "stops",
         "digits", "inputs", "sibling_index", "siblings", "same_tag_share", "sibling_mean_chars", "share_of_page",
         "place_in_page", "place_end", "hidden", "parent_chars", "previous_chars", "next_chars"]
FEATURES = [*STATS, *(f"{of}tag_{t}" for of in ("", "parent_") for t in TAGS),
            *(f"{of}token_{t}" for of in ("", "parent_", "above_") for t in TOKENS), "above_article", "above_boilerplate"]


class Page:
    """Block elements of one page in document order, and pieces of text with their element and block number."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.hidden = ["html"], [-1], [()], [False]
        self.inputs, self.links = [0], [0]
        self.text: list[tuple[int, int, str]] = []  # element, block, text
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones belong to their block element
        block, at, linked = 0, 0, 0
        lower = None

        def say(raw: str) -> None:
            if raw and (raw.strip() or self.text):
                self.text.append((stack[-1][1], block, raw))
                if linked:
                    self.links[stack[-1][1]] += len(raw)

        while True:
            found = _token.search(source, at)
            if not found:
                say(source[at:])
                break
            say(source[at:found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing = name.lower(), bool(found[1] or found[4])
            if closing:
                if name in VOID and name != "br":
                    continue
                if name == "br":
                    say(" ")
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        linked -= sum(1 for s in stack[i:] if s[0] == "a")
                        del stack[i:]
                        block += name not in INLINE
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break  # an inline end tag does not reach over its block
                else:
                    block += name not in INLINE
                continue
            if name == "html":
                continue
            if name in INLINE:
                if name == "br":
                    say(" ")
                elif name == "input":
                    self.inputs[stack[-1][1]] += 1
                elif name not in VOID and not (found[3] or found[6] or "").endswith("/"):
                    stack.append((name, stack[-1][1]))
                    linked += name == "a"
                continue
            closes = CLOSES.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                open_name = stack[i][0]
                if open_name in closes or open_name == "p":
                    linked -= sum(1 for s in stack[i:] if s[0] == "a")
                    del stack[i:]
                    if open_name in closes:
                        break
                elif open_name in HOLDS:
                    break
            block += 1
            if name in RAW:
                end = _raw_end[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            if name in VOID:
                continue
            attributes = found[3] if found[3] is not None else found[6]
            tokens, hidden = (), False
            if attributes and "=" in attributes or attributes and "hidden" in attributes:
                tokens, hidden = _describe(attributes)
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.tokens.append(tokens)
            self.hidden.append(hidden)
            self.inputs.append(name in ("button", "select", "fieldset"))
            self.links.append(0)
            stack.append((name, len(self.tag) - 1))


def _describe(attributes: str) -> tuple[tuple[int, ...], bool]:
    """Groups of attribute tokens, and whether the element is hidden."""
    groups, hidden = set(), " hidden" in f" {attributes} " and "hidden=" not in attributes
    for name, *values in _attribute.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words = {w.lower() for w in _word.findall(value)} | set(value.lower().split())
            groups |= {_group[w] for w in words if w in _group}
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "hidden":
            hidden = True
    return tuple(groups), hidden


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, their parents (index in the batch, -1 for roots) and pages' edges."""
    count = np.array([len(p.tag) for p in pages])
    edges = np.concatenate([[0], np.cumsum(count)])
    total = int(edges[-1])
    parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + e, -1)
                             for p, e in zip(pages, edges)]) if pages else np.zeros(0, np.int64)
    own, words, stops, digits = (np.zeros(total) for _ in range(4))
    for p, e in zip(pages, edges.tolist()):
        for node, _, text in p.text:
            n = len(text.strip())
            if n:
                own[e + node] += n
                words[e + node] += text.count(" ") + 1
                stops[e + node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
                digits[e + node] += len(_digit.findall(text))
    links = np.array([x for p in pages for x in p.links], float)
    inputs = np.array([x for p in pages for x in p.inputs], float)
    depth = np.zeros(total)
    chars, nodes, linked, held, all_stops = own.copy(), np.ones(total), links.copy(), inputs.copy(), stops.copy()
    up = parent.tolist()
    for i in range(total):  # parents come before children
        if up[i] >= 0:
            depth[i] = depth[up[i]] + 1
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    for level in levels[:0:-1]:
        for a in (chars, nodes, linked, held, all_stops):
            np.add.at(a, parent[level], a[level])
    has = parent >= 0
    page = np.repeat(np.arange(len(pages)), count)
    tag_names = [t for p in pages for t in p.tag]
    known = {t: i for i, t in enumerate(TAGS)}
    tag = np.array([known.get(t, len(TAGS)) for t in tag_names], np.int64)
    kids = np.bincount(parent[has], minlength=total)
    kid_chars = np.bincount(parent[has], chars[has], minlength=total)
    order = np.flatnonzero(has)[np.argsort(parent[has], kind="stable")]
    index = np.zeros(total)
    if len(order):
        first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        index[order] = np.arange(len(order)) - start
        before, after = np.zeros(total), np.zeros(total)
        before[order[1:]] = np.where(~first[1:], chars[order[:-1]], 0)
        after[order[:-1]] = np.where(~first[1:], chars[order[1:]], 0)
    else:
        before = after = np.zeros(total)
    same = np.zeros(total)
    if has.any():
        pair = parent[has] * (len(TAGS) + 1) + tag[has]
        _, where, times = np.unique(pair, return_inverse=True, return_counts=True)
        same[has] = times[where]
    siblings = np.where(has, kids[parent], 1)
    whole = np.maximum(chars[edges[:-1]], 1)[page] if total else np.zeros(0)
    place = np.cumsum(own) - own
    offset = place - place[edges[:-1]][page] if total else place
    tokens = np.zeros((total, len(TOKENS)))
    for i, groups in enumerate(t for p in pages for t in p.tokens):
        tokens[i, list(groups)] = 1
    log = np.log1p
    stats = [depth, log(chars), log(own), linked / np.maximum(chars, 1), log(nodes), log(chars / nodes), log(words),
             all_stops / np.maximum(chars, 1), digits / np.maximum(own, 1), log(held), log(index), log(siblings),
             same / np.maximum(siblings, 1), log(np.where(has, kid_chars[parent] / np.maximum(siblings, 1), 0)),
             chars / whole, offset / whole, (offset + chars) / whole,
             np.array([h for p in pages for h in p.hidden], float), log(np.where(has, chars[parent], 0)), log(before),
             log(after)]
    one_hot = tag[:, None] == np.arange(len(TAGS))
    parent_tag = np.where(has[:, None], one_hot[parent], False)
    parent_tokens = np.where(has[:, None], tokens[parent], 0)
    # what any ancestor is
    above = np.column_stack([tokens, np.isin(tag, _ARTICLE), np.isin(tag, _BOILERPLATE)])
    below = np.zeros_like(above)
    for level in levels[1:]:
        below[level] = np.maximum(below[parent[level]], above[parent[level]])
    return (np.column_stack([*stats, one_hot, parent_tag, tokens, parent_tokens, below]).astype(np.float32), parent, edges)


# Labelled pages -------------------------------------------------------------------------------------------------

def labelled_page(rnd: random.Random) -> tuple[str, list[bool]]:
    """A made-up page and, for its block elements in order (html first), whether they are or hold main text."""
    out, labels = [], [True]

    def say(n: int) -> str:
        words = ["".join(rnd.choice("aeiounrstlh") for _ in range(rnd.randint(2, 9))) for _ in range(max(n, 1))]
        for i in range(rnd.randint(4, 14), len(words), rnd.randint(5, 14)):
            words[i] += rnd.choice([".", ",", ".", "?"])
        return " ".join(words).capitalize() + rnd.choice([".", ".", ""])

    def element(tag: str, good: bool, inside, attributes: str = "") -> None:
        out.append(f"<{tag}{attributes}>")
        labels.append(good)
        inside() if callable(inside) else out.append(inside)
        out.append(f"</{tag}>")

    def named(group: str) -> str:
        token = rnd.choice(TOKENS[group].split())
        token = rnd.choice([token, token, f"site-{token}", f"{token}-box", f"js {token} wide"])
        return f' {rnd.choice(["class", "class", "id"])}="{token}"'

    def links() -> None:
        def items() -> None:
            for _ in range(rnd.randint(2, 8)):
                element("li", False, f'<a href="/{say(1)}">{say(rnd.randint(1, 3))}</a>')
        if rnd.random() < 0.7:
            element("ul", False, items)
        else:
            out.append(" | ".join(f'<a href="#">{say(1)}</a>' for _ in range(rnd.randint(2, 8))))

    def prose(good: bool, low: int, high: int) -> None:
        for _ in range(rnd.randint(low, high)):
            text = say(int(2 * 200 ** rnd.random()))
            if rnd.random() < 0.15:
                text = f"<b>{text}"
            if rnd.random() < 0.15:
                text += f' <a href="/x">{say(2)}</a> ' + say(8)
            if rnd.random() < 0.1:
                text += "<br>" + say(9)
            element("p", good, text)

    def boring(group: str, tag: str) -> None:
        bare = tag not in ("div", "section", "p") and rnd.random() < 0.4
        def inside() -> None:
            kind = rnd.random()
            if group in ("menu", "social") or kind < 0.2 and group != "comment":
                links()
            elif group == "comment":
                if rnd.random() < 0.6:
                    element("h3", False, say(2))
                for _ in range(rnd.randint(1, 5)):
                    element("div", False, lambda: prose(False, 1, 2), named("comment") if rnd.random() < 0.7 else "")
            elif group == "form":
                out.append('<input type="text"><input type="submit">')
                element("p", False, say(rnd.randint(2, 20)))
                if rnd.random() < 0.5:
                    element("button", False, say(1))
            elif kind < 0.5:
                out.append(say(rnd.randint(2, 30)))
            else:
                prose(False, 1, 3)
        element(tag, False, inside, "" if bare else named(group))

    def article() -> None:
        if rnd.random() < 0.85:
            element(rnd.choice(["h1", "h1", "h2"]), True, say(rnd.randint(2, 12)))
        if rnd.random() < 0.2:  # hardly anything
            return prose(True, 0, 2)
        for _ in range(rnd.randint(1, 4)):
            prose(True, 0 if rnd.random() < 0.1 else 1, 7)
            extra = rnd.random()
            if extra < 0.1:
                element("blockquote", True, lambda: prose(True, 1, 2))
            elif extra < 0.2:
                def items() -> None:
                    for _ in range(rnd.randint(2, 6)):
                        element("li", True, say(rnd.randint(3, 30)))
                element(rnd.choice(["ul", "ol"]), True, items)
            elif extra < 0.3:
                element(rnd.choice(["h2", "h3"]), True, say(rnd.randint(1, 6)))
            elif extra < 0.36:
                boring(rnd.choice(["advert", "social", "side", "form"]), rnd.choice(["div", "aside"]))
            elif extra < 0.4:
                def rows() -> None:
                    for _ in range(rnd.randint(1, 4)):
                        element("tr", True, lambda: [element("td", True, say(rnd.randint(1, 8))) for _ in range(3)])
                element("table", True, rows)

    def body() -> None:
        for group, tag, often in (("notice", "div", 0.2), ("header", rnd.choice(["header", "div"]), 0.5),
                                  ("menu", rnd.choice(["nav", "nav", "div"]), 0.7), ("advert", rnd.choice(["div", "div", "aside"]), 0.5)):
            if rnd.random() < often:
                boring(group, tag)
        kind = rnd.random()
        if kind < 0.45:
            element("article", True, article, named("content") if rnd.random() < 0.4 else "")
        elif kind < 0.6:
            element("main", True, lambda: element("article", True, article) if rnd.random() < 0.5 else article())
        elif kind < 0.85:
            element(rnd.choice(["div", "section"]), True, article, named("content"))
        else:
            element("div", True, article)
        for group, tag, often in (("social", "div", 0.2), ("comment", rnd.choice(["section", "div"]), 0.4),
                                  ("side", rnd.choice(["aside", "div"]), 0.4), ("form", rnd.choice(["form", "form", "div"]), 0.25),
                                  ("advert", "div", 0.2), ("notice", "div", 0.15), ("footer", rnd.choice(["footer", "footer", "div"]), 0.7)):
            if rnd.random() < often:
                boring(group, tag)

    head = rnd.random() < 0.8
    if head:
        out.append("<html><head><meta charset=utf-8>")
        labels.append(False)
        out.append("<title>x</title></head>")
    element("body", True, body)
    return "".join(out), labels


def train(spark: SparkSession, pages: int = 500, trees: int = 16, depth: int = 4, seed: int = 7) -> list[dict]:
    """Boosted trees fitted by Spark ML on `pages` labelled pages; each tree as arrays of its nodes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rnd = random.Random(seed)
    made = [labelled_page(rnd) for _ in range(pages)]
    parsed = [Page(source) for source, _ in made]
    for page, (source, labels) in zip(parsed, made):
        if len(page.tag) != len(labels):
            raise AssertionError("labels and elements differ")
    x, _, _ = features(parsed)
    y = np.concatenate([labels for _, labels in made]).astype(float)
    rows = spark.createDataFrame(pa.table({"x": pa.array(x.astype(float).tolist()), "label": pa.array(y)}))
    rows = rows.select(array_to_vector("x").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=seed, cacheNodeIds=False).fit(rows)
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        feature, threshold, left, right, value = [], [], [], [], []

        def add(node) -> int:
            i = len(feature)
            inner = node.getClass().getSimpleName() == "InternalNode"
            feature.append(node.split().featureIndex() if inner else 0)
            threshold.append(node.split().threshold() if inner else 0.0)
            value.append(node.prediction() * weight)
            left.append(i)
            right.append(i)
            if inner:
                left[i] = add(node.leftChild())
                right[i] = add(node.rightChild())
            return i

        add(tree._call_java("rootNode"))
        out.append({"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left),
                    "right": np.array(right), "value": np.array(value), "depth": tree.depth})
    return out


def margins(model: list[dict], x: np.ndarray) -> np.ndarray:
    """Log odds of being or holding main text: twice the trees' sum, as Spark's loss has it."""
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree in model:
        at = np.zeros(len(x), np.int64)
        for _ in range(tree["depth"]):
            go = x[rows, tree["feature"][at]] <= tree["threshold"][at]
            at = np.where(go, tree["left"][at], tree["right"][at])
        out += tree["value"][at]
    return 2 * out


STAY = 1.0  # log odds by which a node is rather in than out where its parent is in


def decode(margin: np.ndarray, parent: np.ndarray, hidden: np.ndarray, stay: float = STAY) -> np.ndarray:
    """The best consistent choice: a node can only be in if its parent is. Of all such choices the one with the
    largest sum of margins, each raised by `stay`; roots are in, hidden elements out."""
    gain = np.where(hidden, -np.inf, margin + stay)
    up = parent.tolist()
    for i in range(len(up) - 1, -1, -1):  # children come after parents
        if up[i] >= 0 and gain[i] > 0:
            gain[up[i]] += gain[i]
    chosen = gain > 0
    for i, p in enumerate(up):
        chosen[i] = p < 0 or chosen[i] and chosen[p]
    return chosen


def main_texts(sources: list[str], model: list[dict]) -> list[str]:
    pages = [Page(s) for s in sources]
    x, parent, edges = features(pages)
    chosen = decode(margins(model, x), parent, np.array([h for p in pages for h in p.hidden], bool))
    out = []
    for page, e in zip(pages, edges.tolist()):
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.text:
            if chosen[e + node]:
                blocks.setdefault(block, []).append(text)
        texts = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
        out.append("\n".join(t for t in texts if t))
    return out


def extract(pages: DataFrame, model: list[dict] | None = None, batch_chars: int = 2 << 20) -> DataFrame:
    """Main text of every page.

    pages has page_id, url and html. Each block element is scored by boosted trees from its depth, the densities of
    its subtree, its siblings, its tag and its attribute tokens; a dynamic programme then picks the best set of
    elements that is closed upwards, so no text is taken out of a rejected container. Returns page_id, url, text
    (blocks joined by one line feed), n_chars. A null or empty html, or a page without main text, gives an empty
    text. Character references are decoded and white space inside a block becomes one space. Rows that repeat are
    extracted each. One pass, no shuffle; the model (some 20 kB) is the only broadcast.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train(spark) if model is None else model)

    def run(batches):
        for batch in batches:
            sources = [s or "" for s in batch.column("html").to_pylist()]
            first = 0
            while first < len(sources):
                last, held = first, 0
                while last < len(sources) and (last == first or held + len(sources[last]) <= batch_chars):
                    held += len(sources[last])
                    last += 1
                texts = main_texts(sources[first:last], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(first, last - first), batch.column("url").slice(first, last - first),
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
                first = last

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
