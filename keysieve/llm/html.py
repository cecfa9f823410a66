"""Main text of web pages by wrapper induction.

Pages of a host are made by one or more templates. Each page is parsed once into a tree whose
shape, without texts, is its skeleton; repeated siblings of the same shape count
once. The most frequent skeleton of a host is a reference, and every other one
is aligned with it by simple tree matching, the dynamic programme that maps most
nodes while it keeps parents and the order of siblings. Skeletons that share too
little with it belong to other templates, with references of their own. So each
text block of a page gets a node of a template of the host; a node that the
reference lacks is known by its label path. Every text that a node has on nearly
all distinct pages that hold the node is template, also if repeated siblings give
the node several; what varies is a slot.

Slots are then told apart. What stands in navigation, headers, footers, sidebars,
notices, adverts, forms or reader comments by tag, role or class never is main
text. If a page marks its article, the slots in it are the main text; if not, all
other slots are that do not mostly hold links.

Only skeletons, node numbers and hashes are shuffled, never texts. Statistics of a
host are counted before the shuffle, so a host with a third of all pages costs a
row per distinct value and task.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import per_batch, written

BATCH_ROWS = 256
CONSTANT_SHARE = 0.8
#: Share of the visible nodes from which on a skeleton belongs to the template of a reference.
TEMPLATE_SHARE = 0.5
#: Distinct pages that hold a node from which on a constant text counts as template, inside a marked article and outside.
LEAST_PAGES_IN_ARTICLE, LEAST_PAGES = 12, 3
# Element names of the HTML standard by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style template noscript iframe object svg canvas audio video map select datalist title textarea "
    "annotation annotation-xml".split()
)
APART = frozenset("nav footer aside form menu dialog button label fieldset".split())
#: Elements that are no nodes of the tree; they belong to the text around them.
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose maction "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd".split()
)
#: Elements that begin and end a block of text. All others, unknown ones included, stand within a line.
BLOCKS = frozenset(
    "html head title body address article aside blockquote center dialog dd details dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search "
    "section summary table caption colgroup col thead tbody tfoot tr td th ul xmp".split()
)
#: What may stand in ``head``; any other element, and any text, ends a head that is still open.
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table select".split())
SCOPES = frozenset("table ul ol dl select article section div body html td th".split())
# Words in class, id and role that mark a part of the page.
APART_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer colophon sidebar aside rail widget widgets complementary contentinfo "
    "notice notices cookie cookies consent gdpr privacy popup modal overlay alert disclaimer "
    "comment comments commentlist disqus replies reply respond discussion "
    "share sharing social follow subscribe subscription newsletter signup login search searchbox form "
    "related recommended recommendations teaser teasers more copyright legal skip hidden".split()
)
PART_WORDS = frozenset(
    "site page main top bottom left right side block box container wrapper wrap inner outer area section list item items links link "
    "bar buttons button slot unit zone region content text message info group panel primary secondary posts post articles article "
    "stories entries us id wp js the and by user reader social media global local sticky fixed".split()
)
CONTAINERS = frozenset("div section ul ol dl table figure details iframe center ins span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p li".split())
COMMENT_IDS = frozenset("comments comment-list commentlist comments-list comments-area disqus_thread respond".split())
MAIN_WORDS = frozenset("article articlebody post postbody entry story main maincontent content body text".split())
MAIN_PAIRS = frozenset(
    "article-body article-content article-text entry-content entry-body post-content post-body post-text story-body "
    "main-content page-content content-main content-body body-content main-text article__body post__body".split()
)
WORDS = re.compile(r"[A-Za-z][A-Za-z0-9]*")
SPACES = re.compile(r"\s+")
NUMBERS = re.compile(r"\d+")
LEFT, NEUTRAL, MAIN = 0, 1, 2
#: Elements nested deeper than this belong to no node of the template; their text is kept.
DEEPEST = 150


class Node:
    __slots__ = ("tag", "label", "zone", "children", "index", "parent", "linked", "depth", "shape")

    def __init__(self, tag: str, label: str, zone: int, parent: Node | None, linked: bool):
        self.tag, self.label, self.zone, self.parent, self.linked = tag, label, zone, parent, linked
        self.children: list[Node] = []
        self.index = -1
        self.depth = parent.depth + 1 if parent else 0
        self.shape = ""


def marks(attributes: list[tuple[str, str | None]]) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role, the whole names, and whether the element is hidden."""
    words, names, hidden = set(), set(), False
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for one in value.lower().split():
                names.add(one)
                words.update(WORDS.findall(one.replace("_", "-")))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and value and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, names, hidden


def says(name: str, words: frozenset[str]) -> bool:
    """Whether a name consists of such words and of words for parts of pages: ``related-posts``, not ``related-work``."""
    parts = WORDS.findall(name.replace("_", "-"))
    return any(w in words for w in parts) and all(w in words or w in PART_WORDS for w in parts)


def apart_by_name(tag: str, attributes: list, zone: int) -> bool:
    """Whether class, role or id put an element apart.

    An id is often a slug of a heading, and a paragraph or a heading is text
    whatever it is called: outside a marked article a whole name must say so, inside
    one the name of a container. There, an id tells reader comments alone.
    """
    named = {k: (v or "").lower().split() for k, v in attributes if k in ("class", "id", "role")}
    labels = named.get("class", []) + named.get("role", [])
    if zone == MAIN:
        inside = APART_WORDS - {"header"}
        return tag in CONTAINERS and (
            any(says(n, inside) for n in labels) or any(n in COMMENT_IDS for n in named.get("id", []))
        )
    if tag in HEADINGS:
        return any(says(n, APART_WORDS) for n in labels)
    own = {w for n in labels for w in WORDS.findall(n.replace("_", "-"))}
    return bool(own & APART_WORDS) or any(says(n, APART_WORDS) for n in named.get("id", []))


def zone_of(tag: str, attributes: list, zone: int) -> int:
    """Whether an element's text is left out, open, or in the marked article."""
    if zone == LEFT or tag in APART or tag in UNSEEN:
        return LEFT
    words, names, hidden = marks(attributes)
    main = tag in MAIN_TAGS or "main" in names or "articlebody" in names or bool(names & MAIN_PAIRS)
    if hidden:
        return LEFT
    if tag not in ("article", "main", "body", "html") and not names & MAIN_PAIRS and apart_by_name(tag, attributes, zone):
        return LEFT
    if tag == "header":
        return zone if zone == MAIN else LEFT
    if main or (words & MAIN_WORDS and names & MAIN_WORDS and tag in ("div", "section", "td")):
        return MAIN
    return zone


class PageParser(HTMLParser):
    """Builds the tree of elements and the list of text blocks ``(node, text, linked characters)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#", NEUTRAL, None, False)
        self.top = self.root
        self.blocks: list[tuple[Node, str, int]] = []
        self.pieces: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.blocks.append((self.holder(), text, self.linked))
        self.pieces, self.linked = [], 0

    def holder(self) -> Node:
        node = self.top
        while node.tag in INLINE and node.parent is not None:
            node = node.parent
        return node

    def pop_to(self, node: Node) -> None:
        """Closes elements up to and including ``node``."""
        if node.parent is not None:
            self.top = node.parent

    def open_above(self, tags, stops=frozenset()) -> Node | None:
        node = self.top
        while node.parent is not None and node.tag not in stops:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def close_head(self, tag: str = "") -> None:
        """Ends an open head before what cannot stand in it; ``body`` ends it whatever else is open in it."""
        if self.top.tag == "head" and tag not in IN_HEAD:
            self.pop_to(self.top)
        elif tag == "body" and (head := self.open_above(("head",))):
            self.pop_to(head)

    def handle_starttag(self, tag, attrs):
        self.close_head(tag)
        if tag in ("br", "mtr", "mtd"):
            self.pieces.append(" ")
        if tag == "br":
            return
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_PARAGRAPH and (open_p := self.open_above(("p",), SCOPES)):
            self.pop_to(open_p)
        elif tag in SAME_CLOSES and (same := self.open_above(SAME_CLOSES[tag], LISTS)):
            self.pop_to(same)
        if tag in VOID or (tag in INLINE and self.top.depth > DEEPEST):
            return  # inline elements that are never closed must not pile up
        named = next((v for n, v in attrs if n == "class" and v), None) or next((v for n, v in attrs if n == "id" and v), "")
        label = f"{tag}.{NUMBERS.sub('0', ' '.join(sorted(named.split())))}" if named else tag
        label = label.replace("(", "").replace(")", "").replace(",", "")
        node = Node(tag, label, zone_of(tag, attrs, self.top.zone), self.top, self.top.linked or tag == "a")
        if tag not in INLINE and node.depth <= DEEPEST:
            self.top.children.append(node)
        self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        node = None if tag in VOID else self.open_above((tag,))
        if node is None or (tag in INLINE and any(n.tag in BLOCKS for n in self.between(node))):
            return  # an inline element does not close the blocks inside it
        self.pop_to(node)

    def between(self, node: Node):
        at = self.top
        while at is not node:
            yield at
            at = at.parent

    def handle_data(self, data):
        if self.top.tag == "head" and data.strip():
            self.close_head()
        if self.top.zone == LEFT:
            return
        self.pieces.append(data)
        if self.top.linked:
            self.linked += len(data)

    def unknown_decl(self, data):
        pass


def skeleton(node: Node, counter: list[int]) -> str:
    """The shape of a subtree; siblings of one shape share the numbers of the first of them."""
    shapes: dict[str, Node] = {}
    node.index = counter[0]
    counter[0] += 1
    for child in node.children:
        before = counter[0]
        shape = skeleton(child, counter)
        if shape in shapes:
            counter[0] = before
            share(child, shapes[shape])
        else:
            shapes[shape] = child
    node.shape = f"{node.label}({','.join(shapes)})" if shapes else node.label
    return node.shape


def share(node: Node, first: Node) -> None:
    """Gives a subtree the numbers of another one of the same shape."""
    node.index = first.index
    by_shape: dict[str, Node] = {}
    for child in first.children:
        by_shape.setdefault(child.shape, child)
    for child in node.children:
        share(child, by_shape[child.shape])


def parse(html: str | None) -> tuple[str, list[tuple[int, int, str, int]]]:
    """A page's skeleton, and its blocks ``(node, zone, text, linked characters)`` in page order."""
    parser = PageParser()
    parser.feed(html or "")
    if not parser.rawdata.lstrip().startswith("<"):
        parser.close()  # what is left is text; an unfinished tag at the end of a page is not
    parser.flush()
    shape = skeleton(parser.root, [0])
    return shape, [(n.index, n.zone, text, linked) for n, text, linked in parser.blocks]


class Shape:
    """A skeleton read back: label, number and children."""

    __slots__ = ("label", "index", "children", "size")

    def __init__(self, label: str, index: int):
        self.label, self.index, self.children, self.size = label, index, [], 1


def read_skeleton(text: str) -> Shape:
    root = Shape("", -1)
    path, number, at = [root], 0, 0
    for sign in re.finditer(r"[(),]|$", text):
        label = text[at : sign.start()]
        if label:
            node = Shape(label, number)
            number += 1
            path[-1].children.append(node)
        if sign.group() == "(":
            path.append(path[-1].children[-1])
        elif sign.group() == ")":
            path.pop()
        at = sign.end()
    for node in postorder(root):
        node.size = 1 + sum(c.size for c in node.children)
    return root.children[0]


def postorder(node: Shape):
    for child in node.children:
        yield from postorder(child)
    yield node


def match(a: Shape, b: Shape, known: dict) -> int:
    """Simple tree matching: the number of nodes in the largest mapping of the two trees."""
    if a.label != b.label:
        return 0
    key = (a.index, b.index)
    if key not in known:
        m, n = len(a.children), len(b.children)
        table = [[0] * (n + 1) for _ in range(m + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + match(x, y, known))
        known[key] = (table[m][n] + 1, table)
    return known[key][0]


def align(a: Shape, b: Shape) -> dict[int, int]:
    """Nodes of ``a`` to the nodes of ``b`` that simple tree matching pairs them with."""
    known: dict = {}
    if not match(a, b, known):
        return {}
    pairs, todo = {}, [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs[x.index] = y.index
        table = known[x.index, y.index][1]
        i, j = len(x.children), len(y.children)
        while i and j:
            gain = match(x.children[i - 1], y.children[j - 1], known)
            if gain and table[i][j] == table[i - 1][j - 1] + gain:
                todo.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def short_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


BLOCK = T.StructType(
    [T.StructField("node", T.IntegerType()), T.StructField("zone", T.IntegerType()), T.StructField("text", T.StringType()),
     T.StructField("linked", T.IntegerType()), T.StructField("hash", T.LongType())]
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, skeleton, shape, blocks)``: every page parsed once."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    source = pages.select("page_id", "url", host.alias("host"), "html")
    schema = T.StructType(
        [
            *source.schema.fields[:3],
            T.StructField("skeleton", T.StringType()),
            T.StructField("shape", T.LongType()),
            T.StructField("blocks", T.ArrayType(BLOCK)),
        ]
    )
    arrow = pa.list_(
        pa.struct([("node", pa.int32()), ("zone", pa.int32()), ("text", pa.string()), ("linked", pa.int32()), ("hash", pa.int64())])
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes, hashes, blocks = [], [], []
        for html in batch.column(3).to_pylist():
            shape, found = parse(html)
            shapes.append(shape)
            hashes.append(short_hash(shape))
            blocks.append([{"node": n, "zone": z, "text": t, "linked": k, "hash": short_hash(t)} for n, z, t, k in found])
        columns = [*batch.columns[:3], pa.array(shapes, pa.string()), pa.array(hashes, pa.int64()), pa.array(blocks, arrow)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)


def outline(tree: Shape, depth: int) -> tuple[list[str], bool]:
    """The label paths of a skeleton's visible elements down to a depth, sorted, and whether some go deeper."""
    paths, deeper, todo = set(), False, [(tree, "", 0)]
    while todo:
        node, above, at = todo.pop()
        path = f"{above}/{node.label}"
        paths.add(path)
        below = [c for c in node.children if c.label.split(".")[0] not in UNSEEN]
        if at < depth:
            todo += [(c, path, at + 1) for c in below]
        else:
            deeper = deeper or bool(below)
    return sorted(paths), deeper


def visible(tree: Shape) -> list[int]:
    """Numbers of a skeleton's nodes at and below the children of ``body``, or of the page if there is none; unseen parts left out."""
    found, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.label.split(".")[0] not in ("#", "html", "body"):
            found.append(node.index)
        todo += [c for c in node.children if c.label.split(".")[0] not in UNSEEN]
    return found


def path_nodes(tree: Shape) -> list[int]:
    """For each number of a skeleton, a template node made of its label path: negative, so never a number of the reference."""
    found, todo = [0] * tree.size, [(tree, "")]
    while todo:
        node, above = todo.pop()
        path = f"{above}/{node.label}"
        found[node.index] = -1 - (short_hash(path) & ((1 << 62) - 1))
        todo += [(c, path) for c in node.children]
    return found


def belongs(own: Shape, reference: Shape, pairs: dict[int, int]) -> bool:
    """Whether half of the visible nodes of one of the two skeletons are matched."""
    mine, others = visible(own), visible(reference)
    if not mine or not others:
        return not mine and not others
    matched = sum(i in pairs for i in mine)
    return matched >= TEMPLATE_SHARE * min(len(mine), len(others))


def aligned_shapes(parsed: DataFrame) -> DataFrame:
    """``(host, shape, template, nodes)``: for each skeleton of a host, its template and the template node of each of its nodes.

    The reference of a template is the skeleton of most pages; of equals, the one
    with the smaller hash. At first all skeletons of a host are aligned with one
    reference. Those that do not belong to it go to the next round, in groups of the
    same outline, each with a reference of its own; outlines get one level deeper
    with every round, until no skeleton is left. A skeleton that is as flat as the
    outline always belongs to its group. Nodes of a skeleton that its reference does
    not hold are known by their label paths within the template.
    """
    shapes = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.first("skeleton").alias("skeleton"))
    left = written(shapes.withColumn("group", F.lit(0).cast("long")), "html-shapes")
    schema = T.StructType(
        [*left.schema.fields, T.StructField("template", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType()))]
    )
    done, depth = None, 1

    while True:

        def work(batch: pa.RecordBatch, depth: int = depth) -> pa.RecordBatch:
            groups, templates, nodes = [], [], []
            for _, shape, _, skeleton_, _, reference, template in zip(*(c.to_pylist() for c in batch.columns)):
                own, other = read_skeleton(skeleton_), read_skeleton(reference)
                pairs = align(own, other)
                if shape == template or belongs(own, other, pairs) or (depth > 1 and not outline(own, depth)[1]):
                    found = path_nodes(own)
                    nodes.append([pairs.get(i, n) for i, n in enumerate(found)])
                    templates.append(template)
                    groups.append(0)
                else:
                    nodes.append(None)
                    templates.append(None)
                    groups.append(short_hash("\n".join(outline(own, depth + 1)[0])))
            columns = [*batch.columns[:4], pa.array(groups, pa.int64()), pa.array(templates, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        order = F.struct("pages", -F.col("shape").cast("decimal(20,0)"))
        chosen = left.groupBy("host", "group").agg(
            F.max_by("skeleton", order).alias("reference"), F.max_by("shape", order).alias("reference_shape")
        )
        joined = left.join(chosen, ["host", "group"]).select(*left.columns, "reference", "reference_shape")
        tried = written(joined.mapInArrow(per_batch(work, BATCH_ROWS), schema), "html-aligned")
        settled = tried.where("template IS NOT NULL").select("host", "shape", "template", "nodes")
        done = settled if done is None else done.unionByName(settled)
        left = tried.where("template IS NULL").select(*left.columns)
        if left.isEmpty():
            return done
        depth += 1


def wrappers(parsed: DataFrame, aligned: DataFrame) -> DataFrame:
    """``(host, shape, constant)``: for each skeleton, its nodes and the hashes of their constant texts.

    A text is constant if it stands in the node on nearly all distinct pages of the
    template that hold the node. Pages that are copies of one another count once.
    """
    bare = F.transform(
        "blocks", lambda b: F.struct(b["node"].alias("node"), b["zone"].alias("zone"), b["hash"].alias("hash"))
    )
    distinct = parsed.select("host", "shape", bare.alias("bare"))
    distinct = distinct.groupBy("host", "shape", F.xxhash64("bare").alias("page")).agg(F.first("bare").alias("bare"))
    distinct = written(distinct, "html-distinct")
    placed = distinct.join(aligned, ["host", "shape"])
    blocks = placed.select("host", "template", "shape", "page", "nodes", F.explode("bare").alias("b"))
    blocks = blocks.select("host", "template", "shape", "page", F.get("nodes", F.col("b.node")).alias("node"), "b.zone", "b.hash")
    once = blocks.where("node IS NOT NULL").groupBy("host", "template", "node", "hash", "shape", "page").agg(F.max("zone").alias("zone"))
    texts = once.groupBy("host", "template", "node", "hash").agg(F.count(F.lit(1)).alias("pages"), F.max("zone").alias("zone"))
    least = F.when(F.col("zone") == MAIN, LEAST_PAGES_IN_ARTICLE).otherwise(LEAST_PAGES)
    frequent = texts.where(F.col("pages") >= least * CONSTANT_SHARE)
    pages = distinct.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    own = aligned.join(pages, ["host", "shape"])
    held = own.select("host", "template", "n", F.explode(F.array_distinct("nodes")).alias("node"))
    held = held.groupBy("host", "template", "node").agg(F.sum("n").alias("n"))
    fixed = frequent.join(held, ["host", "template", "node"]).where((F.col("n") >= least) & (F.col("pages") >= F.col("n") * CONSTANT_SHARE))
    fixed = written(fixed.select("host", "template", "node", "hash"), "html-fixed")
    own = aligned.select("host", "shape", "template", F.posexplode("nodes").alias("number", "node"))
    return own.join(fixed, ["host", "template", "node"]).groupBy("host", "shape").agg(
        F.collect_list(F.struct(F.col("number").alias("node"), "hash")).alias("constant")
    )


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: the main text of every page, one row per row.

    Blocks are in page order, one newline between them; white space inside a block
    is one space. A null or empty page, and one without main text, has the empty
    text. Pages with a null url or one without a host count as one host. Rows that
    repeat are kept. An empty table gives no rows; further columns are not looked
    at. Pages of any length are parsed whole; an unfinished tag at the end is not
    text.
    """
    parsed = written(parsed_pages(pages), "html-parsed")
    wrapper = written(wrappers(parsed, aligned_shapes(parsed)), "html-wrappers")
    placed = parsed.join(wrapper, ["host", "shape"], "left")
    template = F.transform(
        "blocks",
        lambda b: F.struct(
            b["text"].alias("text"), b["zone"].alias("zone"), b["linked"].alias("linked"),
            F.struct(b["node"].alias("node"), b["hash"].alias("hash")).alias("key"),
        ),
    )
    varying = F.filter("b", lambda b: F.col("constant").isNull() | ~F.array_contains("constant", b["key"]))
    placed = placed.select("page_id", "url", template.alias("b"), "constant").select("page_id", "url", varying.alias("b"))
    marked = F.filter("b", lambda b: b["zone"] == MAIN)
    open_ = F.filter("b", lambda b: b["linked"] * 2 <= F.char_length(b["text"]))
    chosen = F.when(F.size(marked) > 0, marked).otherwise(open_)
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return placed.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
