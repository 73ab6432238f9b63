"""Main text of web pages with removal of site templates.

Every page is parsed once. The parse gives the hashes of its element subtrees and its blocks of text
outside boilerplate, each with the hashes of the subtrees around it that may be template. Spark counts,
for each host, on how many different pages a subtree stands; blocks inside a subtree that stands on
many of the host's pages go, by array functions, and what is left is joined.

Two pages count as different when their longest blocks differ: copies of one page, however many,
don't turn its article into a template. Inside an article only containers (div, section, lists,
tables) can be template, not single paragraphs and headings: a passage that articles share stays.

Boilerplate is told by element, role and whole words of class and id. Where every article of a page lies
in such a part (a form around the page, a class on a wrapper), the parts around articles are none.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import drop_columns_like, materialise, release_memo

#: A subtree is template if, judged by a host's other pages, it surely stands on more than so large a share of them: the lower bound of
#: Wilson's interval at SURE standard deviations. So it takes all of 3 pages, 6 of 12, and a share that sinks towards MIN_SHARE on large hosts.
MIN_SHARE = 0.1
SURE = 3.0
#: Articles are a page's main text if they hold so large a share of it; an empty one or a teaser doesn't.
MAIN_SHARE = 0.25
#: Parts into which a host's subtrees are dealt when they meet its number of pages.
SALTS = 32
#: Hosts of more pages than this are dealt so.
SALTED = 500
#: Pages that are parsed together, to bound a worker's memory.
SUB_BATCH = 64

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE_TAGS = frozenset("head title nav footer aside button select textarea dialog menu iframe object canvas svg noscript template script style".split())
#: Boilerplate, unless all articles of the page are in them.
SOFT_TAGS = frozenset(("form",))
CONTAINERS = frozenset("div section ul ol dl table nav aside header footer form figure".split())
MAIN_TAGS = frozenset(("article", "main"))
STRONG_WORDS = frozenset(
    "adsbygoogle advert advertisement advertising adverts breadcrumb breadcrumbs comments cookie cookies disqus footer gdpr masthead modal nav navbar navigation "
    "newsletter paywall popup sidebar sponsored toolbar".split()
)
WEAK_WORDS = frozenset(
    "ad ads banner banners comment consent disclaimer discussion form forms login menu menus notice notices promo promoted promotion related replies respond share "
    "shares sharing signin signup social sponsor subscribe subscription".split()
)
STRUCTURAL_WORDS = frozenset(
    "area areas article bar block body bottom box button buttons card cards column container content entry fixed group header holder icons inner item items left link "
    "links list listing main message overlay page panel post posts primary right row secondary section site slot sticky thread title top unit widget widgets wrap wrapper zone".split()
)
#: What a wrapper has, hasn't or may have is not what it is.
STATE_WORDS = frozenset("closed disabled enabled has have hide is no non not off on open with without".split())
SITE_WORDS = frozenset("app area bar container fixed global inner main site sticky top web website wrap wrapper".split())
#: Also names of a text's own sections.
SECTION_WORDS = frozenset("disclaimer discussion form forms notice notices related respond".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption address summary".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An element of these is closed by the next one of the same group within the container.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


class Page:
    """Elements in page order (parent, tag, boilerplate, in an article, subtree hash) and blocks of (element, text) pieces."""

    def __init__(self, html: str):
        from xxhash import xxh3_64_intdigest

        self.parent, self.tag, self.bad, self.main, self.hash = [-1], [""], [False], [False], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._digest = xxh3_64_intdigest
        self._parts: list[list[str]] = [[]]
        self._open = [0]
        self._block: list[tuple[int, str]] = []
        self._named: set[int] = set()
        for m in TOKEN.finditer(html):
            if m.group("text") is not None:
                text = m.group("text")
                self._block.append((self._open[-1], text))
                if not text.isspace():
                    self._parts[-1].append(text)
            elif m.group("tag"):
                tag = m.group("tag").lower()
                self._end(tag) if m.group("end") else self._start(tag, m.group("attrs"))
        self._flush()
        while len(self._open) > 1:
            self._pop()
        if self._named:
            self._mark_named()

    def _mark_named(self) -> None:
        """Marks what `_named` holds, and all in it. If that would leave no article or main, those that are or hold one stay."""
        articles = [at for at, tag in enumerate(self.tag) if tag in MAIN_TAGS and not self.bad[at]]
        chains = [set(self._around(at)) for at in articles]
        holds: set[int] = set()
        if not any(not (chain & self._named) for chain in chains):
            holds = set().union(*chains)
        named = self._named - holds
        if named:
            for at in range(1, len(self.tag)):
                self.bad[at] = self.bad[at] or self.bad[self.parent[at]] or at in named

    def _around(self, at: int):
        """An element and those around it."""
        while at > 0:
            yield at
            at = self.parent[at]

    def _flush(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _pop(self) -> None:
        at, parts = self._open.pop(), self._parts.pop()
        if parts:
            self.hash[at] = self._digest(f"{self.tag[at]} {' '.join(' '.join(parts).split())}")
            self._parts[-1].append(f"<{self.hash[at]}>")

    def _close_above(self, wanted: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        """Closes the nearest open element of the wanted ones, unless one of the scopes stands in between."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in wanted:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in scopes:
                return

    def _start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self._block.append((self._open[-1], " "))
        else:
            self._flush()
            self._close_above(("p",), ("td", "th", "table", "button", "object", "li", "div", "section", "article", "main"))
            if tag in SELF_CLOSING:
                self._close_above(SELF_CLOSING[tag], SCOPES[tag])
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            return
        up = self._open[-1]
        self.parent.append(up)
        self.tag.append(tag)
        self.main.append(self.main[up] or (tag in MAIN_TAGS))
        marked, named = _boilerplate(attrs, self.main[up]) if attrs and tag not in ("html", "body") and TELLING.search(attrs) else (False, False)
        if named and any(self.tag[at] in ("pre", "code") for at in self._open):
            named = False  # a comment of a program's text
        self.bad.append(self.bad[up] or tag in BOILERPLATE_TAGS or (tag == "header" and not self.main[up]) or marked)
        if named or tag in SOFT_TAGS:
            self._named.add(len(self.tag) - 1)
        self.hash.append(0)
        self._open.append(len(self.tag) - 1)
        self._parts.append([])

    def _end(self, tag: str) -> None:
        if tag in VOID:
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
        for depth in range(len(self._open) - 1, 0, -1):
            now = self.tag[self._open[depth]]
            if now == tag:
                while len(self._open) > depth:
                    self._pop()
                return
            if inline and now not in INLINE:
                return

    def _removable(self, at: int) -> bool:
        """Whether an element could be template."""
        tag = self.tag[at]
        return bool(self.hash[at]) and tag not in INLINE and (tag in CONTAINERS or not self.main[at]) and tag not in ("html", "body", "article", "main", "head", "title")

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be template."""
        return {_signed(self.hash[at]) for at in range(1, len(self.tag)) if self._removable(at)}

    def longest(self) -> int:
        """Hash of the longest block outside boilerplate."""
        return _signed(self._digest(max(map(self._text, self.blocks), key=len, default="")))

    def _text(self, block: list[tuple[int, str]]) -> str:
        pieces = "".join(t for at, t in block if not self.bad[at])
        if "&" in pieces:
            pieces = html_lib.unescape(pieces)
        return " ".join(pieces.split())

    def parts(self) -> list[tuple[str, list[int]]]:
        """The page's text in page order: (blocks joined by line ends, hashes of the subtrees around them that may be template).

        A block never crosses the border of an element that isn't inline, and inline ones are no template, so it goes or stays whole.
        """
        blocks = [(block, text, self.main[block[0][0]]) for block in self.blocks if (text := self._text(block))]
        blocks = [(block, text, inside) for block, text, inside in blocks if inside or not self._links(block, text)]
        article = sum(len(text) for _, text, inside in blocks if inside)
        has_main = article > 0 and article >= MAIN_SHARE * sum(len(text) for _, text, _ in blocks)
        out: list[tuple[list[str], list[int]]] = []
        for block, text, inside in blocks:
            if inside or not has_main:
                around = [_signed(self.hash[at]) for at in self._around(block[0][0]) if self._removable(at)]
                if out and out[-1][1] == around:
                    out[-1][0].append(text)
                else:
                    out.append(([text], around))
        return [("\n".join(texts), around) for texts, around in out]

    def text(self) -> str:
        """The text if nothing is template."""
        return "\n".join(t for t, _ in self.parts())

    def _links(self, block: list[tuple[int, str]], text: str) -> bool:
        """True for a block outside any article and paragraph that is mostly links and no sentence, as menus are."""
        around = next((self.tag[at] for at in self._around(block[0][0]) if self.tag[at] not in INLINE), "")
        if around in PARAGRAPHS:
            return False
        linked = sum(len(t) for at, t in block if self.tag[at] == "a")
        return 2 * linked > len(text) and text[-1:] not in ".!?"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _says_boilerplate(token: str, name: str, in_article: bool) -> bool:
    """Whether a token of a class or id names boilerplate: a strong word in it, or a weak one among words of structure alone."""
    parts = [w.lower() for w in WORD.findall(token)]
    if STATE_WORDS.intersection(parts):
        return False
    if STRONG_WORDS.intersection(parts):
        return True
    if WEAK_WORDS.intersection(parts):
        if in_article and name == "id" and len(parts) == 1 and parts[0] in SECTION_WORDS:
            return False
        return all(w in WEAK_WORDS or w in STRUCTURAL_WORDS or len(w) <= 3 for w in parts)
    return "header" in parts and not in_article and all(w == "header" or w in SITE_WORDS or len(w) <= 3 for w in parts)


def _boilerplate(attrs: str, in_article: bool = False) -> tuple[bool, bool]:
    """Whether an element is boilerplate by role or hidden; whether a token of its class or id says so."""
    marked = named = False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        low = value.lower()
        if name in ("class", "id"):
            named = named or any(_says_boilerplate(token, name, in_article) for token in value.split())
        elif name == "role":
            marked = marked or low in BOILERPLATE_ROLES
        elif name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            marked = True
    return marked, named


def host_of(url_col: str):
    """Lower-case host of a URL column, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE, sure: float = SURE) -> DataFrame:
    """pages with `text` and `n_chars` for `html_col`, which goes; columns of these names are replaced, other columns stay.

    Null html is empty and gives empty text; null and repeated urls, ids and rows keep their rows. Pages without a host share one.
    """
    pages = drop_columns_like(pages, [c for c in ("text", "n_chars") if c != html_col])
    keyed = pages.withColumn("__host", host_of(url_col)).withColumn("__html", F.coalesce(F.col(html_col), F.lit(""))).drop(html_col)
    names = [c for c in keyed.columns if c not in ("__html", "__host")]
    kept = [F.col(f"`{c}`") for c in names]
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keyed.schema if f.name in names)
    part = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))

    def parse(batches):
        from xxhash import xxh3_64_intdigest

        release_memo()
        for b in batches:
            for i in range(0, b.num_rows, SUB_BATCH):
                some = b.slice(i, SUB_BATCH)
                pages, prints = [], []
                for html in some.column(len(names) + 1).to_pylist():
                    pages.append(Page(html))
                    prints.append(_signed(xxh3_64_intdigest(html)))
                parts = [[{"text": t, "around": a} for t, a in p.parts()] for p in pages]
                # 0, which is no subtree's hash, stands for the page
                found = [sorted({0, *p.subtrees()}) for p in pages]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(k) for k in range(len(names) + 1)), pa.array(prints, pa.int64()), pa.array([p.longest() for p in pages], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(parts, part)],
                    [*names, "__host", "__page", "__longest", "__subtrees", "__parts"])

    parsed = keyed.select(*kept, "__host", "__html").mapInArrow(parse, kind + "__host string, __page long, __longest long, __subtrees array<long>, __parts array<struct<text:string,around:array<long>>>")
    parsed = materialise(parsed, "html-parsed", compression="zstd")
    # longest is part of the first key and counts are added up in parts, so a large host's pages are counted by many tasks
    found = parsed.select(F.col("__host").alias("host"), F.col("__longest").alias("longest"), F.explode("__subtrees").alias("subtree"))
    counts = found.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter((F.col("subtree") == 0) | (F.col("n") > 1))
    counts = materialise(counts, "html-counts")
    template = _templates(counts, min_share, sure)
    gone = parsed.select(F.col("__host").alias("host"), F.col("__page").alias("page"), F.explode("__subtrees").alias("subtree")).distinct().join(template, ["host", "subtree"])
    gone = gone.groupBy(F.col("host").alias("__h"), F.col("page").alias("__p")).agg(F.collect_list("subtree").alias("__gone"))
    depends = F.exists("__parts", lambda x: F.size(x.around) > 0)
    text = lambda parts: F.array_join(F.transform(parts, lambda x: x.text), "\n")
    # only pages that templates can change are shuffled
    direct = parsed.filter(~depends).select(*kept, text("__parts").alias("text"))
    joined = parsed.filter(depends).select(*kept, "__host", "__page", "__parts").join(gone, (F.col("__host") == F.col("__h")) & (F.col("__page") == F.col("__p")), "left")
    stays = F.filter("__parts", lambda x: ~F.coalesce(F.arrays_overlap(x.around, F.col("__gone")), F.lit(False)))
    out = direct.unionByName(joined.select(*kept, text(stays).alias("text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def least_share(n, pages, sure: float):
    """Lower bound of the share of a host's pages that hold a subtree, as its other pages tell: n and pages without the one that is judged."""
    k, m, z = (n - 1).cast("double"), (pages - 1).cast("double"), sure * sure
    p = k / m
    return F.when(m > 0, (p + z / (2 * m) - sure * F.sqrt(p * (1 - p) / m + z / (4 * m * m))) / (1 + z / m)).otherwise(F.lit(0.0))


def _templates(counts: DataFrame, min_share: float, sure: float) -> DataFrame:
    """(host, subtree) of what is template, from (host, subtree, n), subtree 0 counting the host's different pages.

    Hosts of many pages are joined in SALTS parts, as their subtrees may be many.
    """
    hosts = counts.filter("subtree = 0").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    trees = counts.filter("subtree <> 0")
    surely = least_share(F.col("n"), F.col("pages"), sure) > min_share + 1e-9
    salt = F.pmod("subtree", F.lit(SALTS))
    large = hosts.filter(F.col("pages") > SALTED).withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    found = [trees.join(large, (F.col("host") == F.col("h")) & (salt == F.col("s"))), trees.join(hosts.filter(F.col("pages") <= SALTED), F.col("host") == F.col("h"))]
    return found[0].filter(surely).select("host", "subtree").unionByName(found[1].filter(surely).select("host", "subtree"))
