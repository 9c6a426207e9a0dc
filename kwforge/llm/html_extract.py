"""Operator 1, HTML extraction by equivalence classes of tokens.

A page is a sequence of tokens: tags and text blocks, each told apart by the path of containers above it. The occurrence
vector of a token says how often it occurs on each page of a host; tags with equal vectors form a class. A class is
valid if it occurs on several pages, its tags keep one order on each of them, and it nests with the other classes; valid
classes are the host's template. What lies between two template tags is a slot, told apart by the tag before it and its
occurrence. A slot with the same content on nearly all pages belongs to the template, as does a block that nearly all
pages have: both go, inside an article too. Of the varying slots, the fixed names of menus, notices and the like drop
some more. The main text is what is left inside the main element, else inside the articles. On pages that have neither,
statistics of each slot over the host tell furniture (mostly links, or text that other pages share) from content, and
the main text is the content slots without the blocks that more than half of the host's pages have.

How it scales: a vector is never stored. Each token of a page gives a hash of (page, count), and the xor of those over
a host, with the number of pages and the total, stands for the vector; that is one aggregation with partial sums, so a
host with a third of all pages needs no single task. Order, nesting and slot contents are checked page by page in two
more passes that give hashes, aggregated the same way. Templates hold a few tokens a host; they are broadcast only while
their measured size is under `broadcast_bytes`, else pages are joined to them by host with the host salted.

Nulls: null html is an empty page with an empty text; a null url is a host of its own. Repeated pages, and pages with
the same main text, count once for the template and each give their row. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import collections
import functools
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.llm.common import cut, table

#: Elements whose content is never shown text: to their end tag, to the end of the page, or to a tag that ends them.
#: A drawing ends where an element of text starts, as browsers have it; fallbacks of media end with what lies around them.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(svg)\b(?:[^>]*/>|[^>]*(?:>(?:<foreignobject\b.*?(?:</foreignobject\s*>|\Z)|.)*?"
    r"(?:</svg\s*>|(?=</?(?:article|aside|body|div|footer|form|h[1-6]|header|html|main|nav|ol|p|section|table|ul)\b)|\Z)|\Z))"
    r"|<(audio|canvas|object|select|video)\b[^>]*(?:>.*?(?:</\3\s*>|(?=</(?:article|body|html|main)\b)|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[\s=]++|[^>=\s]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
CONTAINERS = frozenset("html body article main section div nav header footer aside form ul ol dl table figure dialog blockquote menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre hr br figcaption address details summary fieldset head".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu head button".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|comments?|replies|responses|disqus|share|social|related|recommend\w*|widget|toolbar|login|signup|search|pagination|pager|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
#: Names that tell furniture even where an article lies around; the others are also names of an article's own parts.
FURNITURE = re.compile(
    r"ads?|advert\w*|sponsor(?:ed)?|promo(?:tion)?s?|cookie[-_]?(?:notice|consent|banner|bar)|newsletter|subscribe|breadcrumbs?|sidebar|comments?|replies|responses|disqus(?:[-_]thread)?|share|sharing|pagination|pager|navigation|navbar|toolbar|complementary|contentinfo|dialog|alertdialog|modal|popup|related"
    r"|(?:ads?|advert|sponsor|promo|newsletter|subscribe|sidebar|signup|popup|modal)[-_](?:area|banner|bar|block|box|container|form|inner|label|panel|section|slot|unit|widget|wrap|wrapper)"
    r"|(?:reader|user|post|blog)?[-_]?comments?[-_]?(?:area|block|body|box|container|feed|form|list|panel|section|thread|wrap|wrapper)"
    r"|(?:reader|user)[-_]comments?"
    r"|(?:share|sharing|social)[-_](?:bar|box|buttons?|icons?|links?|list|media|menu|share|sharing|tools|widget)"
    r"|(?:related|recommended)[-_](?:articles?|box|content|items|links?|list|news|pages|posts?|reading|section|stories)",
    re.I,
)
#: Names that tell furniture on any element but a heading.
ANYWHERE = re.compile(r"ads?|advert\w*|sponsor(?:ed)?|share|sharing|(?:share|sharing|social)[-_](?:bar|box|buttons?|icons?|links?|list|media|menu|share|sharing|tools|widget)", re.I)

#: Start tags that end an open element of the same or a like name without its end tag: (elements ended, where the search stops).
_LISTS, _TABLE = frozenset("ul ol menu".split()), frozenset(["table"])
_CELLS, _ROWS = frozenset(["td", "th"]), frozenset(["td", "th", "tr"])
_GROUPS = _ROWS | frozenset("thead tbody tfoot caption".split())
_TERMS, _OPTION = frozenset(["dt", "dd"]), frozenset(["option"])
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), _LISTS), "dt": (_TERMS, frozenset(["dl"])), "dd": (_TERMS, frozenset(["dl"])), "td": (_CELLS, _TABLE), "th": (_CELLS, _TABLE), "tr": (_ROWS, _TABLE),
    "thead": (_GROUPS, _TABLE), "tbody": (_GROUPS, _TABLE), "tfoot": (_GROUPS, _TABLE), "option": (_OPTION, frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of a head; any other start tag ends it.
_OF_HEAD = frozenset("head title meta link base script style noscript template".split())
_ENDS_P = (CONTAINERS | HEADINGS | frozenset("p pre hr li dt dd address details summary fieldset figcaption".split())) - {"html", "body"}
#: An end tag closes nothing beyond these.
_SCOPE = {"li": _LISTS, "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": _TABLE, "th": _TABLE, "tr": _TABLE, "p": _TABLE}


#: A page's own token, and what a template holds.
PAGE = "@page"
KINDS = ("tags", "texts", "fixed", "constant", "furniture")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))


def tokens(page: str) -> Iterator[tuple[str, str, str, tuple]]:
    """(kind, name, value, path) of every token: kind is open, close or text; path holds the open containers.

    An entry of the path is (tag, names); names are the class, id and role. A close tag closes what it matches, if anything.
    """
    path: list[tuple[str, str]] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()], tuple(path)
        at = m.end()
        skipped, (ends, name, attributes) = (m.group(1) or m.group(2) or m.group(3) or "").lower(), m.group(4, 5, 6)
        name = (name or "").lower()
        if not name:
            if skipped and skipped not in ("script", "style"):
                yield "skip", skipped, "", tuple(path)
            continue
        if not ends:
            names, marks = _telling(attributes) if attributes and _TELLING.search(attributes) else ("", "")
            if name not in _OF_HEAD:
                _end(path, _HEAD, ())
            if name in _ENDS_P:
                _end(path, _PARAGRAPH, _TABLE)
            if name in IMPLIED_ENDS:
                _end(path, *IMPLIED_ENDS[name])
            elif name in HEADINGS and path and path[-1][0] in HEADINGS:
                path.pop()
            yield "open", name, names, tuple(path)
            if name in CONTAINERS or marks or (names and BOILERPLATE_NAMES.search(names)) or name in BOILERPLATE_TAGS or any(t == name for t, _ in path):
                if name not in VOID and not attributes.rstrip().endswith("/"):
                    path.append((name, names + marks))
        else:
            _end(path, (name,), _SCOPE.get(name, ()))
            yield "close", name, "", tuple(path)
    if at < len(page):
        yield "text", "", page[at:], tuple(path)


_PARAGRAPH, _HEAD = ("p",), ("head",)
#: What the path says of a hidden element and of one that a role or property names as the main or article element; the
#: control character tells them apart from classes of that name.
HIDDEN, MAIN, ARTICLE = " \x01hidden", " \x01main", " \x01article"


def _telling(attributes: str) -> tuple[str, str]:
    """(class, id and role in lower case, marks) from a tag's attributes, each by its own name."""
    names, marks = [], set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key in ("class", "id", "role"):
            names.append(value.lower())
            if key == "role":
                marks |= {{"main": MAIN, "article": ARTICLE}.get(r, "") for r in value.lower().split()}
        elif key == "itemprop" and "articlebody" in value.lower().split():
            marks.add(ARTICLE)
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
            marks.add(HIDDEN)
    return " ".join(x for x in names if x), "".join(sorted(marks))


def _end(path: list[tuple[str, str]], names, stop) -> None:
    """Close the innermost open element of one of these names, with all inside it, if no element of `stop` lies between."""
    for k in range(len(path) - 1, -1, -1):
        if path[k][0] in names:
            del path[k:]
            return
        if path[k][0] in stop:
            return


def role(kind: str, name: str, value: str, path: tuple) -> str | None:
    """A token's identity within a host: its kind, name and container path; None for white space."""
    above = ">".join(f"{t}.{n}" if n else t for t, n in path)
    if kind == "text":
        run = " ".join(value.split())
        return f"{above}|#{run}" if run else None
    return f"{above}|{'/' if kind == 'close' else ''}{name}" + (f".{value}" if value else "")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, doc, n): how often each tag and text block is on a page; doc is the hash of the page's plain main text.

    A row of the token PAGE stands for the page itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                parsed = list(tokens(text or ""))
                found = slots(parsed, frozenset(), _xxhash64)
                doc = _xxhash64(plain_text(found))
                seen = collections.Counter(role(*t) for t in parsed if t[0] in ("open", "close"))
                runs = collections.Counter(role("text", "", b, path) for _, path, blocks, *_ in found for b in blocks)
                out.append((h, PAGE, False, doc, 1))
                out += [(h, r, False, doc, n) for r, n in seen.items()] + [(h, r, True, doc, n) for r, n in runs.items()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "is_text", "doc", "n"])

    found = pages.select("host", "html").mapInArrow(run, "host string, token string, is_text boolean, doc long, n long")
    return found.withColumn("token", F.xxhash64("token"))


def class_orders(page: str, classes: dict[int, tuple[int, int]], sizes: dict[int, int], digest) -> dict[int, int | None]:
    """By class that is on the page: the hash of its tokens' order, or None where it has none or crosses a class of more pages.

    A class has an order if its tokens come in one sequence, each once, and that sequence is repeated. Two classes nest
    if no repetition of the one starts inside a repetition of the other and ends after it. Classes of as many pages that
    cross, as the boxes of a page and the headings in them do, nest once their repetitions are told apart by place, if
    they interleave alike on all pages; so the hash is then that of their common sequence.
    """
    met: dict[int, list[tuple[int, int]]] = {}
    for place, t in enumerate(tokens(page)):
        if t[0] in ("open", "close") and (token := digest(role(*t))) in classes:
            met.setdefault(classes[token][0], []).append((place, token))
    pages = dict(classes.values())
    out: dict[int, int | None] = {}
    spans = []
    for c, found in met.items():
        m, order = sizes[c], [t for _, t in found]
        good = len(set(order[:m])) == m and not len(order) % m and order == order[:m] * (len(order) // m)
        out[c] = digest("|".join(map(str, order[:m]))) if good else None
        if good:
            spans += [(found[k][0], found[k + m - 1][0], c) for k in range(0, len(found), m)]
    open_spans: list[tuple[int, int, int]] = []
    woven: dict[int, set[int]] = {}
    for span in sorted(spans):
        open_spans = [o for o in open_spans if o[1] >= span[0]]
        crossed = [o for o in open_spans if o[1] < span[1] and pages[o[2]] != pages[span[2]]]
        if any(pages[o[2]] > pages[span[2]] for o in crossed):
            out[span[2]] = None
            continue
        for o in crossed:
            out[o[2]] = None
            open_spans.remove(o)
        for o in open_spans:
            if o[1] < span[1]:
                woven.setdefault(o[2], set()).add(span[2])
                woven.setdefault(span[2], set()).add(o[2])
        open_spans.append(span)
    for c, others in woven.items():
        if out[c] is not None:
            out[c] = digest("|".join(str(t) for _, t in sorted(x for k in (c, *others) for x in met[k])))
    return out


def with_template(pages: DataFrame, known: DataFrame, broadcast_bytes: int, salts: int) -> DataFrame:
    """Pages with the columns of their host's template; known is a written table of one row a host with arrays of numbers."""
    arrays = [F.size(F.coalesce(c, F.array().cast(known.schema[c].dataType))) for c in known.columns if c != "host"]
    size = known.select(F.sum(16 + 24 * sum(arrays, F.lit(0)))).first()[0] or 0
    if size <= broadcast_bytes:
        return pages.join(F.broadcast(known), "host", "left")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page", "html"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")


def templates(pages: DataFrame, least_pages: int = 3, broadcast_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """One row a host: tags, texts (blocks on more than half of its pages), fixed (blocks on nine tenths), constant (slots
    with their content), furniture (slots of pages without a main element or article).

    Pages with the same main text count once, so that copies of an article don't make it a template. A class is valid if
    it lies on least_pages pages and at least a tenth of the host's, occurs equally often on each of them, has two tags
    or more, and keeps one order and nests on every page. A slot is constant if nine tenths of the pages that have it,
    and least_pages at least, have the same content there.
    Furniture is told by a slot's text over all pages of the host that have it, least_pages at least: half of it or more
    lies in links, or three quarters in blocks that pages with another main text have too, on any host. The slot with the
    most text of its own is the host's content and never furniture.
    """
    once = page_tokens(pages).groupBy("host", "token", "is_text", "doc").agg(F.min("n").alias("lo"), F.max("n").alias("n"))
    vectors = once.groupBy("host", "token", "is_text").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), (F.min("lo") == F.max("n")).alias("even"), F.bit_xor(F.xxhash64("doc", "n")).alias("vector")
    )
    vectors = cut(vectors.filter((F.col("pages") >= least_pages) | (F.col("token") == _xxhash64(PAGE))), "vectors")
    hosts = vectors.filter(F.col("token") == _xxhash64(PAGE)).select("host", F.col("pages").alias("host_pages"))
    repeated = vectors.filter((F.col("token") != _xxhash64(PAGE)) & (F.col("pages") >= least_pages)).join(hosts, "host")
    texts = repeated.filter(F.col("is_text") & (F.col("pages") * 2 > F.col("host_pages")))
    texts = texts.select("host", F.explode(F.when(F.col("pages") * 10 >= F.col("host_pages") * 9, F.array(F.lit("texts"), F.lit("fixed"))).otherwise(F.array(F.lit("texts")))).alias("kind"), "token")

    tags = repeated.filter(~F.col("is_text") & F.col("even") & (F.col("pages") * 10 >= F.col("host_pages"))).withColumn("class", F.xxhash64("pages", "total", "vector"))
    tags = tags.withColumn("size", F.count("*").over(Window.partitionBy("host", "class"))).filter("size > 1")
    tags = cut(tags.select("host", "token", "class", "pages"), "classes")
    known = cut(tags.groupBy("host").agg(F.collect_list(F.struct("token", "class", "pages")).alias("classes")), "known")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for i, (h, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if h not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    classes = {x["token"]: (x["class"], x["pages"]) for x in batch.column(2)[i].as_py()}
                    kept[h] = classes, collections.Counter(c for c, _ in classes.values())
                out += [(h, c, o) for c, o in class_orders(page or "", *kept[h], _xxhash64).items()]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "class", "ord"])

    met = with_template(pages.select("page", "host", "html"), known, broadcast_bytes, salts).filter(F.col("classes").isNotNull()).select("host", "html", "classes").mapInArrow(orders, "host string, class long, ord long")
    valid = met.groupBy("host", "class").agg(((F.count("ord") == F.count("*")) & (F.min("ord") == F.max("ord"))).alias("valid")).filter("valid")
    tags = cut(tags.join(valid.select("host", "class"), ["host", "class"], "left_semi").select("host", F.lit("tags").alias("kind"), "token"), "tags")
    known = cut(tags.groupBy("host").agg(F.collect_list("token").alias("tags")), "known")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, frozenset] = {}
        for batch in batches:
            out = []
            for i, (h, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if h not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[h] = frozenset(batch.column(2)[i].as_py())
                found = slots(tokens(page or ""), kept[h], _xxhash64)
                doc, plain = _xxhash64(plain_text(found)), not any(s[3] for s in found if not _boilerplate(s[1]))
                for name, _, blocks, _, links in found:
                    if name:
                        slot = _xxhash64(name)
                        out.append((h, slot, content(name, blocks, _xxhash64), doc, None, None))
                        if plain:
                            out += [(h, slot, _xxhash64(b), doc, len(b), n) for b, n in zip(blocks, links, strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5), strict=True)], names=["host", "slot", "token", "doc", "chars", "linked"])

    held = with_template(pages.select("page", "host", "html"), known, broadcast_bytes, salts).filter(F.col("tags").isNotNull()).select("host", "html", "tags")
    held = cut(held.mapInArrow(contents, "host string, slot long, token long, doc long, chars long, linked long").distinct(), "slots")
    furniture = furniture_slots(held.filter("chars is not null"), least_pages).select("host", F.lit("furniture").alias("kind"), F.col("slot").alias("token"))
    held = held.filter("chars is null")
    total = held.select("host", "slot", "doc").distinct().groupBy("host", "slot").agg(F.count("*").alias("total"))
    same = held.groupBy("host", "slot", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    constant = same.join(total, ["host", "slot"]).filter(F.col("n") * 10 >= F.col("total") * 9).select("host", F.lit("constant").alias("kind"), "token")
    every = tags.union(texts).union(constant).union(furniture)
    return every.groupBy("host").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in KINDS))


def furniture_slots(blocks: DataFrame, least_pages: int) -> DataFrame:
    """(host, slot) that are furniture, of (host, slot, token, doc, chars, linked): the blocks, by hash, of each page and slot.

    Sums by host, slot and block come first, so a block or host of a third of all rows is one row a slot in what follows.
    """
    sums = blocks.groupBy("host", "slot", "token").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    repeated = sums.groupBy("token").agg((F.min("lo") < F.max("hi")).alias("repeated"))
    shown = F.when(F.col("repeated"), F.col("chars")).otherwise(0)
    slot = sums.join(repeated, "token").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(shown).alias("shared"))
    slot = slot.join(blocks.select("host", "slot", "doc").distinct().groupBy("host", "slot").agg(F.count("*").alias("pages")), ["host", "slot"])
    own = F.col("chars") - F.greatest("linked", "shared")
    slot = slot.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(own.desc(), F.desc("chars"), "slot")))
    return slot.filter((F.col("place") > 1) & (F.col("pages") >= least_pages) & ((F.col("linked") * 2 >= F.col("chars")) | (F.col("shared") * 4 >= F.col("chars") * 3))).select("host", "slot")


@functools.lru_cache(4096)
def _boilerplate(path: tuple) -> bool:
    """A menu, notice or the like lies above; a header is one only outside the article.

    Inside an article a name counts only if it is a whole name of FURNITURE on a container (or one of ANYWHERE on any
    element but a heading); above one, only if it is a whole name. What else is furniture there, the template tells by its
    content.
    """
    around = any(_rank(*entry) for entry in path)
    inside = False
    for tag, names in path:
        if tag in BOILERPLATE_TAGS or HIDDEN in names:
            return True
        main = _rank(tag, names)
        if inside and main and any(FURNITURE.fullmatch(x) for x in names.split()):
            return True
        if names and tag not in ("html", "body") and not main:
            if inside:
                telling = FURNITURE if tag in CONTAINERS else ANYWHERE
                if tag not in HEADINGS and any(telling.fullmatch(x) for x in names.split()):
                    return True
            elif BOILERPLATE_NAMES.search(names) and (not around or any(BOILERPLATE_NAMES.fullmatch(x) for x in names.split())):
                return True
        if tag == "header" and not inside:
            return True
        inside = inside or main > 0
    return False


def _rank(tag: str, names: str) -> int:
    """2 for the element that the page itself calls main, 1 for an article, by tag, role, property or class; else 0."""
    if tag == "main" or MAIN in names:
        return 2
    return int(tag == "article" or ARTICLE in names or "articlebody" in names.replace("-", ""))


@functools.lru_cache(4096)
def _main(path: tuple) -> int:
    """0 outside the article, 1 inside, 2 inside the main element."""
    return max((_rank(*entry) for entry in path), default=0)


def slots(parsed: Iterable[tuple], tags: frozenset, digest) -> list[tuple[str, tuple, list[str], int, list[int]]]:
    """Slots of a page, cut at template tags: (name, path, blocks, in the article, characters of each block in links).

    A block ends at a block-level tag.

    A slot's name is the template tag before it, which occurrence on the page that is, and the path; it is empty before
    the first template tag.
    """
    out: list[tuple[str, tuple, list[str], int, list[int]]] = []
    where: tuple | None = None
    blocks: list[str] = []
    parts: list[str] = []
    links: list[int] = []
    after, in_link, linked = "", False, 0
    met: dict[int, int] = {}

    def end_block() -> None:
        nonlocal linked
        run = " ".join(html.unescape("".join(parts)).split())
        if run:
            blocks.append(run)
            links.append(min(linked, len(run)))
        parts.clear()
        linked = 0

    def end_slot() -> None:
        end_block()
        if blocks:
            out.append((role("slot", after, "", where or ()) if after else "", where or (), blocks.copy(), _main(where or ()), links.copy()))
            blocks.clear()
            links.clear()

    for t in parsed:
        kind, name, value, path = t
        if kind == "text":
            if path != where:
                end_slot()
                where = path
            parts.append(value)
            if in_link:
                linked += len(value.strip())
        elif name == "a":
            in_link = kind == "open"
        elif kind == "skip":
            end_block()
        elif name in BLOCKS:
            token = digest(role(*t)) if tags else None
            if token in tags:
                end_slot()
                met[token] = met.get(token, 0) + 1
                after = f"{token}.{met[token]}"
            else:
                end_block()
    end_slot()
    return out


def content(slot: str, blocks: list[str], digest) -> int:
    """The hash of a slot with what it holds."""
    return digest("\n".join([slot, *blocks]))


def plain_text(found: list[tuple]) -> str:
    """Main text of a page's slots by the fixed names alone, without a template."""
    found = [s for s in found if not _boilerplate(s[1])]
    best = max((s[3] for s in found), default=0)
    return "\n".join(b for s in found if s[3] == best for b in s[2])


def main_text(page: str | None, tags: frozenset, texts: frozenset, fixed: frozenset, constant: frozenset, furniture: frozenset, digest) -> str:
    """Blocks of the main slots, in page order, one a line.

    What the template holds goes first: constant slots and fixed blocks, also inside the article; the fixed names check
    what is left. On a page without a main element or article, slots that are furniture on their host go too.
    """
    found = slots(tokens(page or ""), tags, digest)
    varying = [s for s in found if not (s[0] and constant and content(s[0], s[2], digest) in constant) and not _boilerplate(s[1])]
    best = max((s[3] for s in found if not _boilerplate(s[1])), default=0)
    varying, known = [s for s in varying if s[3] == best], fixed if best else texts
    if not best and furniture:
        varying = [s for s in varying if not s[0] or digest(s[0]) not in furniture]
    return "\n".join(b for s in varying for b in s[2] if not known or digest(role("text", "", b, s[1])) not in known)


def _xxhash64(s: str) -> int:
    """Spark's xxhash64 of a string (seed 42)."""
    import xxhash

    v = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)
    return v - (1 << 64) if v >> 63 else v


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """id, url, text, n_chars for every page."""
    pages = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    known = cut(templates(pages, broadcast_bytes=broadcast_bytes, salts=salts), "templates")
    joined = with_template(pages, known, broadcast_bytes, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        for batch in batches:
            out = []
            hosts, pages_ = batch.column(2), batch.column(3).to_pylist()
            for i, page in enumerate(pages_):
                h = hosts[i].as_py()
                if h not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[h] = tuple(frozenset(batch.column(4 + k)[i].as_py() or ()) for k in range(len(KINDS)))
                out.append(main_text(page, *kept[h], _xxhash64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page", "url", "text"])

    done = joined.select("page", "url", "host", "html", *KINDS).mapInArrow(run, "page long, url string, text string")
    return done.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
