"""HTML extraction by equivalence-class template deduction.

Tokens are tags with their path from the root, and whole pieces of text with theirs. The pages of a host that have the
same unmarked divisions around their main text are a layout group; layouts of too few pages for a template are pooled, host
by host. Per group, tokens with the same occurrence vector (how often in which page) form a class; vectors are
compared by page count, total and two sums of hashes of (page, count), so they are aggregated in parts and a group may
have any number of pages. A class is valid if
it is large and frequent. Classes that occur equally often in each page make the outer template, whose gaps are slots; other
classes nest in the slot where they stand. Divisions of the template are classed by what varies in them over the
group's pages: those whose text is mostly links, has few variants, or is short beside that of the division with the most
plain text are no main text, whatever their names. Pages whose host has too few of their layout take these
classes, but no template, from that layout on all such hosts. The text left in the slots is extracted; article and main
elements tell which slots hold the main text where a page has them, elsewhere slots that are mostly links are no main text;
menus, headers, footers, asides, adverts, forms, notices and comments are told by their element, class, id or role too.
A passage that articles of a group share is kept if fewer of its pages have it than a template needs, if other text
stands in its block, or if the page's main text would be empty without it, as where all pages of a group are copies.
A null or empty page gives an empty text. Pages without a host form one group. Repeated rows give repeated results.
Repeated rows count as so many pages of their group. Unclosed and badly nested elements are read as browsers do, roughly;
work and memory are in proportion to a page's length, however it is nested. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import slices
from pairloom.sources.tables import written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<svg>svg)\b[^<>]*/>|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^<>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside form button select option fieldset dialog menu head".split())
#: Words of class, id and role that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "notice notices cookie cookies consent newsletter subscribe signup popup modal share social comment comments reply replies disqus form login search complementary contentinfo".split()
)
#: Words that may stand beside these in one name; a name with any other word, like share-price, marks nothing.
BESIDE = frozenset("site page global main top bottom left right inner outer box bar block section area list item items link links button buttons icons container wrapper wrap content panel column col slot unit module group posts articles stories policy consent reader user the by and of js l r".split())
#: Elements that an opening tag closes if they stand open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article main section div body nav aside footer header form td".split())
_DIVISIONS = frozenset("article main section div".split())
#: Elements whose own text is classed: that which stands in no other of these inside them.
HOLDERS = frozenset("html body article main section div nav header footer aside form table ul ol dl".split())
#: What a holder's text is: left out as links or one of few variants, short beside the main text, or main text.
LEFT, SHORT, MAIN = 1, 2, 3
_BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def marked(names: str) -> bool:
    """Whether a class, id or role says that an element is no article: a name all of whose words are MARKS or BESIDE."""
    for name in names.lower().split():
        words = [w for w in re.split("[^a-z]+", name) if w]
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


@dataclass(slots=True)
class Event:
    kind: str  # open, close or text
    path: int  # a hash of the elements from the root on
    name: str  # the element and its class, id and role
    text: str
    inside: bool  # of an article or main element
    out: bool  # of the article by what encloses it
    link: bool
    block: int  # blocks are numbered in page order


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    name: str
    inside: bool
    out: bool
    link: bool


class _Stack:
    """Open elements. Work is in proportion to what is opened, however deep."""

    def __init__(self):
        self.items: list[_Open] = []
        self.counts: Counter = Counter()
        self.scopes: list[tuple[int, Counter]] = [(-1, Counter())]  # where each scope begins and what is open in it

    def push(self, e: _Open) -> None:
        self.items.append(e)
        self.counts[e.tag] += 1
        self.scopes[-1][1][e.tag] += 1
        if e.tag in _SCOPE:
            self.scopes.append((len(self.items) - 1, Counter()))

    def pop(self) -> _Open:
        e = self.items.pop()
        self.counts[e.tag] -= 1
        if e.tag in _SCOPE:
            self.scopes.pop()
        self.scopes[-1][1][e.tag] -= 1
        return e

    def last(self, tags: frozenset[str] | set[str], after: int = -1) -> int:
        return next(k for k in range(len(self.items) - 1, after, -1) if self.items[k].tag in tags)

    def shut_by(self, tags: set[str]) -> int | None:
        """The innermost open element of tags that no other scope encloses."""
        at, counts = self.scopes[-1]
        if any(counts[t] > 0 for t in tags):
            return self.last(tags, at)
        return at if at >= 0 and self.items[at].tag in tags else None


_NOTHING = _Open("", 0, "", False, False, False)


def events(page: str) -> Iterator[Event]:
    """Tags and pieces of text in page order."""
    stack, block, known = _Stack(), 0, {}

    def close(at: int) -> Iterator[Event]:
        nonlocal block
        while len(stack.items) > at:
            e = stack.pop()
            if e.tag not in INLINE:
                block += 1
            yield Event("close", e.path, e.name, "", e.inside, e.out, e.link, block)

    for m in _TOKEN.finditer(page):
        top = stack.items[-1] if stack.items else _NOTHING
        if m["text"] is not None:
            yield Event("text", top.path, top.name, references.unescape(m["text"]), top.inside, top.out, top.link, block)
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                if stack.counts[tag]:
                    yield from close(stack.last({tag}))
                elif tag not in INLINE:
                    block += 1
                continue
            if tag in ("html", "body") and stack.counts[tag]:
                continue
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in _BREAKS_P else set())
            while shut and (at := stack.shut_by(shut)) is not None:
                yield from close(at)
            if tag not in INLINE:
                block += 1
            names = " ".join(sorted("".join(x[1:]) for x in _ATTRIBUTE.findall(m["rest"]))) if m["rest"].strip(" /") else ""
            top = stack.items[-1] if stack.items else _NOTHING
            name = f"{tag}.{names}" if names else tag
            key = top.path, name
            if key not in known:
                known[key] = hash_of(f"{top.path} {name}"), bool(names) and tag not in ("html", "body", "article", "main") and marked(names)
            path, is_marked = known[key]
            # an article's own header holds its headline
            out = top.out or tag in LEFT_OUT and not (tag == "header" and top.inside) or is_marked
            inside = top.inside or tag in ("article", "main")
            if tag in VOID or m["rest"].endswith("/") and tag in INLINE:
                yield Event("text", path, name, " ", inside, out, top.link, block)
                continue
            if tag in ("td", "th"):
                yield Event("text", top.path, top.name, " ", inside, out, top.link, block)
            stack.push(_Open(tag, path, name, inside, out, top.link or tag == "a"))
            yield Event("open", path, name, "", inside, out, top.link, block)
    yield from close(0)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(errors="surrogatepass")) - 2**63


def tokens(page: str) -> tuple[list[Event], list[int | None]]:
    """The events of a page and their tokens, signed 64-bit numbers; None for white space."""
    found, names, tags = list(events(page)), [], {}
    for e in found:
        if e.kind == "text":
            names.append(hash_of(f"text {e.path} {' '.join(e.text.split())}") if e.text.strip() else None)
        else:
            key = e.kind, e.path
            if key not in tags:
                tags[key] = hash_of(f"{e.kind} {e.path}")
            names.append(tags[key])
    return found, names


def holders(found: list[Event], names: list[int | None]) -> Iterator[tuple[Event, int | None, int]]:
    """Events with their opening token if they open a holder, and 1 and -1 where a holder begins and ends."""
    for e, t in zip(found, names, strict=True):
        moves = e.kind != "text" and e.name.split(".", 1)[0] in HOLDERS
        yield e, t if moves and e.kind == "open" else None, moves and (1 if e.kind == "open" else -1)


def held(found: list[Event], names: list[int | None]) -> dict[int, list]:
    """By the opening token of each holder with text of its own: characters, those in links, and a hash of the text."""
    out: dict[int, list] = {}
    open_: list[int | None] = [None]
    for e, t, moves in holders(found, names):
        if moves > 0:
            open_.append(t)
        elif moves < 0:
            open_.pop()
        elif e.kind == "text" and open_[-1] is not None and (text := e.text.strip()):
            own = out.setdefault(open_[-1], [0, 0, []])
            own[0] += len(text)
            own[1] += len(text) if e.link else 0
            own[2].append(text)
    return {t: [chars, links, hash_of("\n".join(texts))] for t, (chars, links, texts) in out.items()}


def kept_by(found: list[Event], names: list[int | None], kinds: dict[int, int]) -> list[bool]:
    """Whether each event may be main text by the kinds of the holders around it: the innermost with a kind decides.
    Short text is kept inside a main holder below body, and inside article and main elements."""
    out, open_ = [], [(MAIN, False)]
    for e, t, moves in holders(found, names):
        if moves > 0:
            kind, within = open_[-1]
            kind = kinds.get(t, kind)
            if kind == SHORT and (within or e.inside):
                kind = MAIN
            open_.append((kind, within or kinds.get(t) == MAIN and e.name.split(".", 1)[0] not in ("html", "body")))
        elif moves < 0:
            open_.pop()
        out.append(open_[-1][0] == MAIN)
    return out


def layout(found: list[Event]) -> int:
    """A number for the divisions around a page's main text, down to the second: their paths without digits, as a set."""
    names, above, depth, held = set(), [], 0, 0
    for e in found:
        if e.kind == "open":
            tag = e.name.split(".", 1)[0]
            counts = tag not in ("html", "body")
            above.append((e.name, counts, e.inside))
            if depth < 2 and not held and not e.out and tag in _DIVISIONS:
                names.add(re.sub("[0-9]+", "", "/".join(n for n, _, _ in above)))
            depth, held = depth + counts, held + e.inside
        elif e.kind == "close":
            _, counts, inside = above.pop()
            depth, held = depth - counts, held - inside
    return hash_of(" ".join(sorted(names)))


def host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens, and one row without a token for the page itself."""
    for b in slices(batches):
        rows: list[tuple] = []
        for name, page, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found, names = tokens(text or "")
            kind = layout(found)
            first: dict[int, int] = {}
            for k, t in enumerate(names):
                first.setdefault(t, k)
            texts, none = held(found, names), (0, 0, 0)
            rows.append((name, kind, page, None, 1, 0, *none))
            rows += [(name, kind, page, t, n, first[t], *texts.get(t, none)) for t, n in Counter(names).items() if t is not None]
        columns = zip(*rows, strict=True) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 8), strict=True)], ["host", "layout", "page", "token", "n", "at", "chars", "links", "said"])


#: What is summed up of a token: how often, where, and for holders their own text.
_SUMMED = ("in_pages", "total", "x", "y", "at", "chars", "links", "told")


def _kinds(frequent: DataFrame, few: float, most_variants: int, short: float) -> DataFrame:
    """host, layout and the kinds of the holders among the template's tokens. Variants are counted by 64 bits of hashes:
    more than most_variants are many, however many pages there are."""
    variants = -64 * F.log(F.greatest(64 - F.bit_count("bits"), F.lit(1)) / 64)
    few_variants = (F.round(variants) <= F.greatest(F.lit(1.0), few * F.col("told"))) & (variants <= most_variants)
    plain = F.when(2 * F.col("links") <= F.col("chars"), (F.col("chars") - F.col("links")) / F.col("pages"))
    told = frequent.where("told > 0").select("host", "layout", "token", F.coalesce(plain, F.lit(0.0)).alias("plain"), plain.isNull().alias("linked"), few_variants.alias("few"))
    listed = told.groupBy("host", "layout").agg(F.max("plain").alias("top"), F.sort_array(F.collect_list(F.struct("token", "plain", "linked", "few"))).alias("held"))
    kind = f"case when h.linked or h.few and h.plain < top then {LEFT} when h.plain < {short} * top then {SHORT} else {MAIN} end"
    return listed.select("host", "layout", F.expr(f"transform(held, h -> struct(h.token AS token, {kind} AS kind))").alias("kinds"))


def deduce(pages: DataFrame, share: float = 0.8, least_pages: int = 5, least_size: int = 3, few: float = 0.2, most_variants: int = 50, short: float = 0.2) -> DataFrame:
    """One row for each layout group (host, layout): its valid classes in order of place, each with tokens in order and
    occurrences in each page, 0 if they vary, and the kinds of its holders by their opening tokens. The group of layout
    null has all pages of layouts that have fewer than least_pages on the host; groups of host null have these pages of
    all hosts by layout, and kinds alone.

    share: of a group's pages that a class must occur in; so a group's template is no longer than its mean page / share.
    few, most_variants: a holder's texts have few variants if they are no more than this share of its pages, and this number.
    short: of the plain text of the holder with the most, what a holder must have to be main text by itself.
    Layouts of at least least_pages have a row, with empty classes if none is valid.
    """
    keyed = pages.select(host("url").alias("host"), F.xxhash64("page_id", "url").alias("page"), "html")
    seen = keyed.mapInArrow(_occurrences, "host string, layout long, page long, token long, n long, at long, chars long, links long, said long")
    bits = lambda seed: F.expr(f"shiftrightunsigned(xxhash64(page, n, {seed}), 33)")  # noqa: E731  of 2**32 pages the sum still fits
    bit = F.expr("if(chars > 0, shiftleft(1L, int(pmod(said, 64))), 0L)")
    first = seen.select("host", "layout", "token", "n", F.lit(1).alias("in_pages"), F.col("n").alias("total"), bits(1).alias("x"), bits(2).alias("y"), "at", "chars", "links", (F.col("chars") > 0).cast("long").alias("told"), bit.alias("bits"), F.col("n").alias("least"), F.col("n").alias("most"))
    sums = [*(F.sum(c).alias(c) for c in _SUMMED), F.bit_or("bits").alias("bits"), F.min("least").alias("least"), F.max("most").alias("most")]
    summed = [*_SUMMED, "bits", "least", "most"]
    parts = written(first.groupBy("host", "layout", "token").agg(*sums), "token-vectors")
    found = parts.where("token is null").select("host", "layout", F.col("in_pages").alias("pages"))
    small = lambda df: F.broadcast(df) if df.limit(100_001).count() <= 100_000 else df
    group = F.when(F.col("pages") >= least_pages, F.col("layout")).alias("layout")
    counted = parts.where("token is not null").join(small(found), ["host", "layout"])

    def frequent(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
        """Tokens of groups (host, layout) in enough of their pages."""
        vectors = tokens.groupBy("host", "layout", "token").agg(*sums).withColumn("at", F.col("at") / F.col("in_pages"))
        of = sizes.groupBy("host", "layout").agg(F.sum("pages").alias("pages")).withColumnsRenamed({"host": "of_host", "layout": "of_layout"})
        same = F.col("host").eqNullSafe(F.col("of_host")) & F.col("layout").eqNullSafe(F.col("of_layout"))
        return vectors.join(small(of), same).where(F.col("in_pages") >= F.greatest(F.lit(float(least_pages)), share * F.col("pages")))

    own_tokens = written(frequent(counted.select("host", group, "token", *summed), found.select("host", group, "pages")), "frequent-tokens")
    nowhere = F.lit(None).cast("string").alias("host")
    anywhere = frequent(counted.where((F.col("pages") < least_pages) & (F.col("told") > 0)).select(nowhere, "layout", "token", *summed), found.where(F.col("pages") < least_pages).select(nowhere, "layout", "pages"))
    classes = own_tokens.groupBy("host", "layout", "in_pages", "total", "x", "y", "least", "most").agg(F.expr("transform(sort_array(collect_list(struct(at, token))), x -> x.token)").alias("tokens"), F.min("at").alias("at"))
    # an element's beginning and end are enough where it stands several times in each page
    valid = classes.where((F.size("tokens") >= least_size) | (F.size("tokens") >= 2) & (F.col("least") == F.col("most")) & (F.col("least") > 1))
    listed = valid.groupBy("host", "layout").agg(F.expr("transform(sort_array(collect_list(struct(at, if(least = most, least, 0) AS often, tokens))), x -> struct(x.often AS often, x.tokens AS tokens))").alias("classes"))
    none = F.lit(None)
    rows = listed.select("host", "layout", "classes", none.alias("kinds")).unionByName(_kinds(own_tokens, few, most_variants, short).withColumn("classes", none), allowMissingColumns=True)
    rows = rows.unionByName(_kinds(anywhere, few, most_variants, short).withColumn("classes", none))
    rows = rows.unionByName(found.where(F.col("pages") >= least_pages).select("host", "layout", none.alias("classes"), none.alias("kinds")))
    only = lambda c, of: F.coalesce(F.first(c, ignorenulls=True), F.array().cast(of.schema[c].dataType)).alias(c)  # noqa: E731  one row of a group has it
    return rows.groupBy("host", "layout").agg(only("classes", rows), only("kinds", rows))


Template = list[tuple[int, list[int]]]


def slots(found: list[Event], names: list[int | None], template: Template) -> Iterator[list[tuple[Event, bool]]]:
    """The page's events between the tokens of the outer template, each with whether a nested class has it.

    Outer are the classes of as many occurrences in each page: once, or so often as divisions of one kind stand in the
    outer template. Classes whose occurrences vary nest in a slot. An inline element or a token out of the template's order parts nothing.
    """
    order = {t: k for k, t in enumerate(t for often, class_ in template if often == 1 for t in class_)}
    several = {t for often, class_ in template if often > 1 for t in class_}
    nested = {t for often, class_ in template if not often for t in class_}
    last, slot = -1, []
    for e, t in zip(found, names, strict=True):
        parts = t is not None and (e.kind == "text" or e.name.split(".", 1)[0] not in INLINE)
        if parts and (order.get(t, -1) > last or t in several and e.kind != "text"):
            last = max(last, order.get(t, -1))
            yield slot
            slot = [(e, True)] if e.kind == "text" else []
        else:
            slot.append((e, t in nested or t in several or t in order))
    yield slot


def article(page: str, template: Template, kinds: dict[int, int] | None = None) -> str:
    return article_of(*tokens(page), template, kinds)


def article_of(found: list[Event], names: list[int | None], template: Template, kinds: dict[int, int] | None = None) -> str:
    """The main text of a page; template: classes as (occurrences in each page or 0, tokens in order); kinds: of holders by
    their opening tokens.

    Text in holders that are no main text is left out, unless the page has no other.

    Where unmarked text stands in article or main elements, the main text is what the slots hold of these: blocks that
    are all template are left out, unless nothing else is there. Elsewhere it is all that the slots hold but the template,
    without slots whose text is more than half links, unless all are such; where kinds are known and all is template, as
    in copies, it is the template's text in main holders.
    """
    filled = [[(e, fixed) for e, fixed in slot if e.kind == "text" and not e.out] for slot in slots(found, names, template)]
    if kinds:
        may_be = {id(e) for e, ok in zip(found, kept_by(found, names, kinds), strict=True) if ok}
        by_kind = [[(e, fixed) for e, fixed in slot if id(e) in may_be] for slot in filled]
        if any(e.text.strip() for slot in by_kind for e, _ in slot):
            filled = by_kind
    main = [(e, fixed) for slot in filled for e, fixed in slot if e.inside]
    if any(e.text.strip() for e, _ in main):
        own = {e.block for e, fixed in main if not fixed and e.text.strip()}
        kept = [e for e, _ in main if not own or e.block in own]
    else:
        held = [[e for e, fixed in slot if not fixed] for slot in filled]
        if kinds and not any(e.text.strip() for slot in held for e in slot):
            held = [[e for e, _ in slot] for slot in filled]
        size = lambda slot, links: sum(len(e.text.strip()) for e in slot if e.link or not links)
        plain = [slot for slot in held if 2 * size(slot, True) <= size(slot, False)]
        kept = [e for slot in (plain if any(size(slot, False) for slot in plain) else held) for e in slot]
    blocks: dict[int, list[str]] = {}
    for e in kept:
        blocks.setdefault(e.block, []).append(e.text)
    lines = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
    return "\n".join(t for t in lines if t)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        kinds = [layout(list(events(p or ""))) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.int64())], ["page_id", "url", "html", "host", "layout"])


Known = tuple[Template, dict[int, int]]


def _known(classes: list | None, kinds: list | None) -> Known:
    return [(c["often"], c["tokens"]) for c in classes or ()], {k["token"]: k["kind"] for k in kinds or ()}


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = zip(*(b.column(c).to_pylist() for c in ("html", "classes", "kinds")), strict=True)
        texts = [article(page or "", *_known(classes, kinds)) for page, classes, kinds in rows]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _articles_by(templates: Broadcast):
    """As _articles, with the templates of all groups at hand: each page is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Known] = templates.value
        for b in slices(batches):
            texts = []
            for name, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                found, names = tokens(page or "")
                kind = layout(found)
                own = known.get((name, kind))
                pooled = known.get((name, None), ([], {}))
                classes, kinds = own or (pooled[0], pooled[1] or known.get((None, kind), ([], {}))[1])
                texts.append(article_of(found, names, classes, kinds))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, small_tokens: int = 1_000_000) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    Templates of up to small_tokens tokens in all, 8 bytes each, are broadcast; more are joined by host and layout, and
    Spark splits a group's rows.
    """
    pages = pages.select("page_id", "url", "html")
    templates = written(deduce(pages), "templates")
    keyed = pages.withColumn("host", host("url"))
    shape = "page_id long, url string, text string, n_chars long"
    sizes = F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c.tokens)) + 2 * F.size("kinds")
    if (templates.agg(F.sum(1 + sizes)).first()[0] or 0) <= small_tokens:
        known = {(r.host, r.layout): _known(r.classes, r.kinds) for r in templates.collect()}
        return keyed.mapInArrow(_articles_by(pages.sparkSession.sparkContext.broadcast(known)), shape)
    own = templates.where("host is not null and layout is not null")
    pool = templates.where("host is not null and layout is null").select("host", F.col("classes").alias("pooled"), F.col("kinds").alias("pooled_kinds"))
    anywhere = templates.where("host is null").select("layout", F.col("kinds").alias("general_kinds"))
    laid_out = keyed.mapInArrow(_laid_out, "page_id long, url string, html string, host string, layout long")
    joined = laid_out.join(own, ["host", "layout"], "left").join(pool, "host", "left").join(anywhere, "layout", "left")
    kinds = F.coalesce("kinds", F.expr("if(size(pooled_kinds) > 0, pooled_kinds, general_kinds)"))
    with_classes = joined.select("page_id", "url", "html", F.coalesce("classes", "pooled").alias("classes"), kinds.alias("kinds"))
    return with_classes.mapInArrow(_articles, shape)
