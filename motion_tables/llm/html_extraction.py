"""HTML extraction by equivalence classes of page tokens.

A page is a sequence of tokens, each in the role that its path of elements gives it: tags, the words of short text nodes, and longer
text nodes whole.  Tokens of one host that occur equally often on each of its pages form an equivalence class; a large class on nearly all pages is
part of the host's template.  Its tokens that stand once a page are the template's frame, in order; classes that
repeat nest in the slot of the frame where they begin.  What stands between template tokens are slots, and the text of the slots is extracted:
a block of text goes, wherever it stands, if the template holds each of its words at that place.  A block that a slot reaches into is kept whole.

The occurrence vector of a token is never gathered: every page adds a hash of (page, count) to two sums, and tokens of one host with
the same sums and number of pages have the same vector.  So classes come from one aggregation, summed in each task first; no host's pages are
ever together in one task.  Pages of one host whose text is the same without any template count once, however they differ beside it: what they share is their story, and no template.  A host of fewer than ``min_pages`` pages takes the template of all hosts.

Slots in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments, by their elements' names,
whole classes and ids, are left out afterwards; but where no article outside such elements has text, those that hold an article or main element do not count.  If some slot left is in an article or main element only such slots are the text, unless
there is so much more text outside that the articles are teasers.  An article among readers' comments, or named as one, is no article.  A heading in an article is never the template's.  A page that is all in forms keeps their text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import mix, series

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>?|<[!?/][^>]*+>?|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
# Elements without an end tag; those that stay within a line; those that close an open one of their kind; those and those names that hold no main text.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_WALL = {"p": {"article", "aside", "body", "div", "main", "section", "td", "th", "li", "blockquote"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NEVER = frozenset("head button select menu dialog object canvas".split())
_BESIDE = frozenset("nav footer aside form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OTHER = r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|menus?|nav|navbar|navigation|breadcrumbs?|masthead|notices?|cookies?|consent|popup|modal|newsletter|subscribe" \
    r"|comments?|replies|disqus|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|complementary|contentinfo|search|footer|header"
# Whole names alone: listed words, and between them words that say nothing of the content.
_NAMED = re.compile(rf"(?:(?:site|top|bottom|left|right|main|global)[-_])*(?:{_OTHER})(?:[-_](?:{_OTHER}|bar|box|area|list|section|block|wrap|wrapper|container|widget|links?|buttons?))*[-_]?\d*", re.I)
# Names of what readers have written; a name that says that there may be such text is none.
_REMARK = re.compile(r"(?:user|reader|visitor)?[-_]?(?:comments?|replies|reply|disqus|responses?|feedback)(?:[-_](?!open|closed|off|on|enabled|disabled|count|link|status).*)?\d*", re.I)
_INSIDE = frozenset(("article", "main"))
#: Text outside articles that is so many times theirs is the page's; the articles are teasers then.
TEASED = 3
SHORT = 8
SALTS = 32
_SALT = series(4, 8) | np.uint64(1)


class Node:
    """A text node: its text, its path's hash, its place among the page's tokens, whether its elements can hold main text, the elements around it that say that they do not, whether it is in an article and in a heading."""

    __slots__ = ("text", "path", "at", "open", "named", "inside", "heading")

    def __init__(self, text: str, path: int, at: int, is_open: bool, named: tuple[int, ...], inside: bool, heading: bool):
        self.text, self.path, self.at, self.open, self.named, self.inside, self.heading = text, path, at, is_open, named, inside, heading


def _other(names: str, inside: bool) -> bool:
    """Whether some whole name is one of other content; a header in an article is the article's."""
    return any(_NAMED.fullmatch(x) and not (inside and "header" in x.lower()) for x in names.split())


def parse(page: str) -> tuple[list[int], list[Node | None]]:
    """The page's tokens as hashes in their roles; its text nodes in order, None where a block ends."""
    return _parse(page)[:2]


def _parse(page: str) -> tuple[list[int], list[Node | None], set[int], set[int]]:
    """As parse, the elements of other content that hold an article or main element all the same, and those that are forms.  An article that readers wrote is none."""
    tokens, nodes = [], []
    # name, path, open, elements of other content around it, inside an article, in a heading, among readers' remarks
    stack: list[tuple[str, int, bool, tuple[int, ...], bool, bool, bool]] = [("", 0, True, (), False, False, False)]
    holders: set[int] = set()
    forms: set[int] = set()
    digest = xxhash.xxh64_intdigest

    def shut(depth: int) -> None:
        del stack[depth:]
        nodes.append(None)

    for m in _TOKEN.finditer(page):
        text, name = m["text"], m["name"]
        _, path, is_open, named, inside, heading, remark = stack[-1]
        if text is not None:
            plain = entities.unescape(text)
            words = plain.split()
            if words:
                nodes.append(Node(plain, path, len(tokens), is_open, named, inside, heading))
                tokens.extend(digest(w, path) for w in words) if len(words) <= SHORT else tokens.append(digest(" ".join(words), path))
            elif plain:
                nodes.append(Node(" ", path, len(tokens), is_open, named, inside, heading))
            continue
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            tokens.append(digest("/" + name, path))
            if name not in _INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        shut(depth)
                        break
                else:
                    nodes.append(None)
            continue
        if name == "br":
            nodes.append(Node(" ", path, len(tokens), is_open, named, inside, heading))
        if name in _INLINE:
            tokens.append(digest("<" + name, path))
            continue
        for kind in (_CLOSES.get(name, ()), ("p",) if name in _ENDS_P else ()):
            wall = _WALL.get(name, _WALL["p"])
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in kind:
                    shut(depth)
                    break
                if stack[depth][0] in wall:
                    break
        _, path, is_open, named, inside, heading, remark = stack[-1]
        names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m["rest"])) if m["rest"] else ""
        role = digest("<" + name + "." + names, path)
        tokens.append(role)
        nodes.append(None)
        if name not in _VOID and not m["rest"].endswith("/"):
            written = remark or any(_REMARK.fullmatch(x) for x in names.split())
            article = name in _INSIDE and not written
            inside_now = inside or article
            if article and not inside:
                holders.update(named)
            elif name in _BESIDE or (name == "header" and not inside_now) or (name not in ("body", "html", "article", "main") and _other(names, inside_now)) or (written and name in _INSIDE):
                named = (*named, len(tokens))
                if name == "form":
                    forms.add(len(tokens))
            stack.append((name, role, is_open and name not in _NEVER, named, inside_now, heading or name in _HEADINGS, written and name not in ("body", "html")))
    return tokens, nodes, holders, forms


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each page's text as it is without a template."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            main = np.array([xxhash.xxh64_intdigest(extract(page or "", {}, {})[0]) for page in part.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main.view(np.int64))], ["host", "page", "main"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host and token in a slice of pages: pages, occurrences, the two sums of page hashes and the sum of first places."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            hosts = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for i, page in enumerate(part.column(2).to_pylist()):
                tokens, _ = parse(page or "")
                count = Counter(tokens)
                first = {t: k for k, t in reversed(list(enumerate(tokens)))}
                n = len(count) + 1
                token = np.fromiter((0, *count), np.uint64, n)
                times = np.fromiter((1, *count.values()), np.uint64, n)
                place = np.fromiter((0, *(first[t] / len(tokens) for t in count)), np.float64, n)
                key = mix(np.array([part.column(1)[i].as_py()], np.int64).view(np.uint64))
                parts.append((np.full(n, hosts[i]), token, times.astype(np.int64), mix(key ^ (times * _SALT[0])), place))
            if not parts:
                continue
            host, token, times, mark, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((token, host))
            host, token = host[order], token[order]
            at = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (token[1:] != token[:-1])]))
            sums = lambda x: np.add.reduceat(x[order], at)
            half = np.uint64(0x7FFFFFFF)
            columns = [host[at], token[at].view(np.int64), np.diff(np.append(at, len(host))), sums(times), sums((mark & half).astype(np.int64)), sums(((mark >> np.uint64(32)) & half).astype(np.int64)), sums(place)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["host", "token", "pages", "times", "sum1", "sum2", "place"])


def templates(tallied: DataFrame, by: list[str], min_pages: int, support: float, least: int) -> DataFrame:
    """Per host: frame (tokens of the classes that stand once a page, in order) and nested (tokens of the other classes, each with the slot of the frame where its class begins)."""
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "sum1", "sum2", "place")]
    tokens = tallied.groupBy(*by, "token").agg(*sums)
    every = tokens.where("token = 0").select(*by, F.col("pages").alias("all_pages")).where(F.col("all_pages") >= min_pages)
    if by:  # a host's tokens are dealt out by a salt, so that a large host is no single task's
        own = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        often = tokens.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(own, [*by, "salt"]).drop("salt")
    else:
        count = every.first()
        often = tokens.withColumn("all_pages", F.lit(count.all_pages if count else 0)).where(F.lit(count is not None))
    often = often.where((F.col("token") != 0) & (F.col("pages") >= F.col("all_pages") * support))
    classes = often.groupBy(*by, "pages", "times", "sum1", "sum2").agg(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token")).alias("members")).where(F.size("members") >= least)
    once = F.col("times") == F.col("pages")
    out = classes.groupBy(*by).agg(F.flatten(F.collect_list(F.when(once, F.col("members")))).alias("frame"), F.flatten(F.collect_list(F.when(~once, F.col("members")))).alias("nested"))
    # On every page a token's first place is in its slot, so that the means are in that order too.
    slot = lambda m: F.size(F.filter("frame", lambda f: f["place"] < m["place"])).cast("long")
    out = out.withColumn("nested", F.transform("nested", lambda m: F.struct(slot(m).alias("slot"), m["token"].alias("token"))))
    return out.select(*by, F.array_sort("frame")["token"].alias("frame"), "nested")


def _size(text: str) -> int:
    """Number of tokens of a text node."""
    n = len(text.split())
    return n if n <= SHORT else 1


def slots(tokens: list[int], frame: dict[int, int]) -> list[int]:
    """Places of the frame's tokens on a page: the longest run of them in the frame's order."""
    tails, ends, before, seen = [], [], {}, set()
    for place, t in enumerate(tokens):
        rank = frame.get(t)
        if rank is None or t in seen:
            continue
        seen.add(t)
        k = bisect_left(tails, rank)
        before[place] = ends[k - 1] if k else None
        tails[k : k + 1], ends[k : k + 1] = [rank], [place]
    out, at = [], ends[-1] if ends else None
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def extract(page: str, frame: dict[int, int], nested: dict[int, int]) -> tuple[str, int, int]:
    """Main text of a page, the slots that it fills and the template's tokens found on the page.

    frame: the rank of each token; nested: the slot in which each token's class begins.
    """
    tokens, nodes, holders, forms = _parse(page)
    cuts = slots(tokens, frame)
    places, ranks = set(cuts), [frame[tokens[c]] for c in cuts]

    def fixed(place: int) -> bool:
        """Whether the token there is the template's: in its order in the frame, or of a class nested in a slot up to this one."""
        if place in places:
            return True
        slot = nested.get(tokens[place])
        if slot is None:
            return False
        k = bisect_left(cuts, place)
        return slot <= (ranks[k] if k < len(cuts) else len(frame))

    blocks: list[tuple[str, tuple[int, ...], bool, set[int]]] = []  # text, named elements, inside an article, slots
    block: list[Node] = []

    def end() -> None:
        own = [(n, n.at + i) for n in block for i in range(_size(n.text))]
        if own and own[0][0].open and (own[0][0].inside and own[0][0].heading or not all(fixed(place) for _, place in own)):
            blocks.append((_SPACE.sub(" ", "".join(n.text for n in block)).strip(), own[0][0].named, own[0][0].inside, {bisect_left(cuts, n.at) for n, _ in own}))
        block.clear()

    for n in nodes:
        if n is None:
            end()
        else:
            block.append(n)
    end()
    plain = [b for b in blocks if not b[1]]
    freed = [b for b in blocks if holders.issuperset(b[1])]  # nothing closes an element that holds the page's article
    kept = [b for b in plain if b[2]] or [b for b in freed if b[2]]
    around = [b for b in plain if not b[2]]
    if TEASED * sum(len(b[0].split()) for b in kept) < sum(len(b[0].split()) for b in around):
        kept = around
    kept = kept or freed or [b for b in blocks if forms.issuperset(b[1])]
    return "\n".join(b[0] for b in kept), len(set().union(*(b[3] for b in kept))), len(cuts)


def extract_main_text(pages: DataFrame, *, min_pages: int = 5, support: float = 0.9, least: int = 3, most_broadcast: int = 16 << 20) -> DataFrame:
    """One row per row of pages (page_id, url, html; others are not read): page_id, url, text, slots (that the text fills), frame_tokens (of the template, on the page).

    A null or empty html has an empty text, 0 slots and 0 frame tokens.  A null url, or one without a host, belongs to the host of no name.  Pages of hosts
    under ``min_pages`` different pages take the template of all pages, if those are that many.  Rows of equal html, or of equal text without a template, count as one page of their host; rows of equal html give the same text.  An
    empty table gives an empty result.  Templates, and keys of pages with copies, of up to ``most_broadcast`` bytes in all are sent to the pages, more are joined to them.  Text cut off inside a tag, comment or script ends there.
    """
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    # Only pages of which there are copies are shuffled to be counted once.
    paged = keyed.select("host", F.xxhash64("html").alias("page"), "html")
    mains = stored(paged.mapInArrow(_main, "host long, page long, main long"), "mains")
    alike = mains.groupBy("host", "main").agg(F.count("*").alias("n"), F.min("page").alias("first")).where("n > 1")
    copies = stored(mains.join(alike, ["host", "main"]).select("host", "page", (F.col("page") == F.col("first")).alias("counts")).distinct(), "copies")
    listed = F.broadcast(copies) if copies.count() * 64 <= most_broadcast else copies
    once = paged.join(listed, ["host", "page"], "left_anti").select("host", "page", "html")
    distinct = once.unionByName(paged.join(listed.where("counts"), ["host", "page"], "left_semi").groupBy("host", "page").agg(F.first("html").alias("html")))
    kind = "host long, token long, pages long, times long, sum1 long, sum2 long, place double"
    tallied = distinct.mapInArrow(_tally, kind)
    tallied = stored(tallied.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "sum1", "sum2", "place")]), "tokens")
    own = stored(templates(tallied, ["host"], min_pages, support, least), "templates")
    tokens = own.agg(F.coalesce(F.sum(F.size("frame") + 2 * F.size("nested")), F.lit(0))).first()[0]
    shared = templates(tallied, [], min_pages, support, least).first()  # at most a page's tokens / support
    common = (list(shared.frame), [n.asDict() for n in shared.nested]) if shared else ([], [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple | None = None
        ranks: dict[int, int] = {}
        inner: dict[int, int] = {}
        for batch in batches:
            frames, nests = batch.column(3), batch.column(4)
            texts = []
            for i, page in enumerate(batch.column(2).to_pylist()):
                frame, nested = (frames[i].as_py(), nests[i].as_py()) if frames[i].is_valid else common
                if known is None or known[0] != frame or known[1] != nested:
                    known = (frame, nested)
                    ranks = {t & (2**64 - 1): k for k, t in enumerate(frame)}
                    inner = {n["token"] & (2**64 - 1): n["slot"] for n in nested}
                texts.append(extract(page or "", ranks, inner))
            text, used, cuts = zip(*texts) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(used, pa.int64()), pa.array(cuts, pa.int64())], ["page_id", "url", "text", "slots", "frame_tokens"])

    joined = keyed.join(F.broadcast(own) if tokens * 8 <= most_broadcast else own, "host", "left").select("page_id", "url", "html", "frame", "nested")
    fields = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.mapInArrow(work, f"{fields}, text string, slots long, frame_tokens long")
