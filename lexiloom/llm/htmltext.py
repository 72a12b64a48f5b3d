"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree of branches: a branch is a container (div, section,
list, table and the like) named by the path of tags and classes above it, without ids and page numbers. For each branch of a
host, two entropies over its pages say how important it is: content, one minus the mean share
of pages on which each of its blocks is found again (log c / log m for a block on c of m
pages), and presentation, the entropy of the sequences of its child tags. Their weighted sum
counts as far as the branch's text on the host is no link text. Branches of low importance are navigation or boilerplate and are cut from each page, whatever their tags and inside an
article or main element as well. Weaker evidence (what stands directly in an article or main, or a host of few pages
that all agree) cuts only where at least as much text is left, as it may be a copy of a page.
What is left and is a menu, footer, form, script, advert or comment by its tag, role or class is cut as well:
such branches have no importance even where their text differs from page to page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .scratch import Scratch

#: Cut below the importance, where at least so many pages of a host have the branch; on fewer pages only if it is the same on all.
MIN_PAGES, MIN_IMPORTANCE, CONTENT_WEIGHT = 8, 0.25, 0.8
#: Branches that are broadcast; beyond it the join to the pages is shuffled and salted.
BROADCAST_BRANCHES, SALTS = 100_000, 32

# What stands between a tag's name and its end. A quoted value may hold "<" within 1,000 characters;
# all other parts end at the next "<", so that unclosed tags cost no second look at the rest of the page.
_INSIDE = r"(?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*'|\"[^\"]{0,1000}\"|'[^']{0,1000}'){0,64}+>"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b{_INSIDE}.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)({_INSIDE})"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^<>]*)>"
    r"|<[!?][^<>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")

# HTML elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BRANCH = frozenset("article aside body details div dl fieldset figure footer form header main menu nav ol section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form head header dialog menu button input label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies widget pagination pager toolbar skip".split()
)
#: Elements that hold running text.
CONTENT = frozenset(("article", "main"))


#: Noise words that wrappers bear as well, for what they have inside or for their layout.
WRAPPED = frozenset("sidebar nav navbar navigation menu header masthead footer banner cookie cookies consent gdpr notice popup modal overlay toolbar skip".split())
#: Elements of running text: of their classes only whole names count.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption a abbr b cite code em i mark q s small span strong sub sup time u".split())
_UNSAID = frozenset("has with without no is show hide".split())
#: Words of layout: a name of noise words and of these alone is noise; any other word in it (share-price, comment-on-law) says that it isn't.
LAYOUT = frozenset(
    "area bar block box bottom btn button buttons cell col column container content desktop element fixed form global group head holder icon icons inner item items left link links list main mini mobile module outer page "
    "panel posts primary right row secondary section site slot small sticky sub tags title top unit wrap wrapper zone".split()
)
#: Digits that number pages or posts in a name.
_NUMBERED = re.compile(r"[0-9]{2,}")


class _Open:
    """An open element. ``noise``: the elements about it, itself included, that look like noise."""

    __slots__ = ("tag", "noise", "main", "branch", "tags", "mark")

    def __init__(self, tag, noise, main, branch, tags, mark=None):
        self.tag, self.noise, self.main, self.branch, self.tags = tag, noise, main, branch, tags  # main: 0, 1 inside, 2 no branch between
        self.mark = mark  # where an element within a line that is noise begins: block so far, pieces so far


def _class_noise(tag: str, names: str) -> set[str]:
    """The noise words of those classes and ids that consist of noise words, words of layout and numbers."""
    out: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if not words or words[0] in _UNSAID or tag in PROSE and len(words) > 1:
            continue
        if all(w in NOISE_WORDS or w in LAYOUT or w.isdigit() for w in words):
            out.update(NOISE_WORDS.intersection(words))
    return out


def _style(tag: str, classes: str) -> str:
    """An element's name in the tree: no id, no class of the page as a whole, and no number of a page or post."""
    return tag if not classes or tag in ("html", "body") else f"{tag}.{_NUMBERED.sub('#', classes)}"


def _attributes(text: str) -> tuple[str, str, str, bool]:
    """Classes, the id, the role, and whether the element is hidden."""
    if not text or text.isspace():
        return "", "", "", False
    classes, ident, role, hidden = "", "", "", False
    for m in _ATTR.finditer(text):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            classes = value
        elif key == "id":
            ident = value
        elif key == "role":
            role = value.lower().strip()
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        else:
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return classes, ident, role, hidden


def blocks(page: str | None) -> list[tuple[str, int, bool, int, str, int]]:
    """Blocks of a page in order: text, branch, noise by markup, inside article or main (2: directly), kids of branches, and characters in links.

    Entries with an empty text carry the child tags of a closed branch instead. A form, or an
    element with a class that wrappers bear, is no noise if it holds more than half of what
    else is left of the page and all of its articles.
    """
    out: list[tuple[str, int, tuple[int, ...], int, str, int]] = []
    if not page:
        return []
    root = _Open("#", (), 0, xxhash.xxh3_64_intdigest(b"") >> 1, [])
    wraps: list[bool] = []  # of each element that looks like noise, whether it may be a wrapper
    stack, buf = [root], []
    opened: Counter[str] = Counter()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            raw = "".join(buf)
            buf.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1]
                out.append((text, top.branch, top.noise, top.main, "", min(linked, len(text))))
        linked = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
            if x.tags is not None:
                out.append(("", x.branch, x.noise, x.main, " ".join(x.tags), 0))
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buf.append(page[at : m.start()])
            if opened["a"] > 0:
                linked += len(buf[-1].strip())
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if tag == "br":
                buf.append(" ")
                continue
            k = len(stack) - 1 if opened[tag] > 0 else 0
            while k > 0 and stack[k].tag != tag:
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    k = 0
                    break
                k -= 1
            if tag in BLOCK:
                flush()
            if k > 0:
                if stack[k].mark and stack[k].mark[0] == len(out):
                    del buf[stack[k].mark[1] :]
                close(k)
            continue
        if tag in BLOCK:
            flush()
            # a new block ends an open paragraph, a new item an open item
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 or opened[tag] > 0 else ():
                t = stack[k].tag
                if t == "p" or (t == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    close(k)
                    break
                if t in BRANCH or t in BLOCK and t != "p":
                    break
        elif tag == "br":
            buf.append(" ")
        if tag in VOID:
            continue
        up = stack[-1]
        classes, ident, role, hidden = _attributes(m[4] or m[7] or "")
        names = f"{classes} {ident}".strip()
        own, wrap = hidden or role in NOISE_ROLES, False
        if not own and tag in NOISE_TAGS:
            own = not (tag in ("header", "label", "fieldset") and up.main)
            wrap = tag == "form"
        if not own and names and tag not in ("html", "body"):
            hit = _class_noise(tag, names)
            own = bool(hit - {"header"}) or bool(hit) and not up.main
            wrap = hit <= WRAPPED and tag not in PROSE
        noise = up.noise
        if own:
            noise = (*noise, len(wraps))
            wraps.append(wrap)
        branch, tags = up.branch, None
        if tag in BRANCH:
            branch = xxhash.xxh3_64_intdigest(f"{up.branch}/{_style(tag, classes)}".encode("utf-8", "replace")) >> 1
            tags = []
            for x in reversed(stack):
                if x.tags is not None:
                    if not x.tags or x.tags[-1] != tag:
                        x.tags.append(tag)
                    break
        opened[tag] += 1
        mark = (len(out), len(buf)) if own and tag not in BLOCK else None
        main = 2 if all(wraps[i] for i in noise) and (tag in CONTENT or role == "main") else min(up.main, 1) if tag in BRANCH else up.main
        stack.append(_Open(tag, noise, main, branch, tags, mark))
    if at < len(page):
        rest = page[at:]
        buf.append(rest if "<" not in rest else re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", rest))
    flush()
    close(1)
    lifted = _wrappers(out, wraps)
    return [(t, b, any(i not in lifted for i in noise), main, kids, links) for t, b, noise, main, kids, links in out]


def _wrappers(out: list[tuple[str, int, tuple[int, ...], int, str, int]], wraps: list[bool]) -> set[int]:
    """Those of the possible wrappers that hold more than half of the text, and all text of articles."""
    if not any(wraps):
        return set()
    size: Counter[int] = Counter()
    article: Counter[int] = Counter()
    total = in_articles = 0
    for t, _, noise, main, _, _ in out:
        if t and all(wraps[i] for i in noise):
            total += len(t)
            in_articles += len(t) * (main > 0)
            for i in noise:
                size[i] += len(t)
                article[i] += len(t) * (main > 0)
    return {i for i, n in size.items() if 2 * n > total and article[i] == in_articles}


def chosen(page: str | None, cut: frozenset[int] | set[int], weak: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], int, int]:
    """The blocks that are left, how many the tree cut, and how many of the others went by markup or as no part of the article.

    ``cut``: branches of low importance on the page's host. ``weak``: those that are cut only where
    at least as much text is left. Only what is in an article or main element counts if it is most
    of what is left. A page of which nothing is left keeps its article or main.
    """
    every = [(t, b, main, noise) for t, b, noise, main, *_ in blocks(page) if t]
    own = [x for x in every if not x[3]]
    found = [x for x in own if x[1] not in cut] or [x for x in own if x[2]]
    sure = [x for x in found if x[1] not in weak]
    size = lambda xs: sum(len(x[0]) for x in xs)
    gone = cut
    if 2 * size(sure) >= size(found):
        found, gone = sure, cut | weak
    inside = [x for x in found if x[2]]
    in_main = size(x for x in sure if x[2])
    left = inside if inside and 2 * in_main >= size(sure) else found
    by_tree = sum(x[1] in gone for x in every) - sum(x[1] in gone for x in left)
    return [x[0] for x in left], by_tree, len(every) - len(left) - by_tree


def main_text(page: str | None, cut: frozenset[int] | set[int], weak: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks that are left, joined by newlines."""
    return "\n".join(chosen(page, cut, weak)[0])


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) >> 1


def site_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, pages, n_text, direct, importance) of all branches over all pages.

    A worker counts what its pages repeat before anything is shuffled, and the sums are
    pre-aggregated, so a host with a third of all pages is no hot key.
    """

    def make():
        def run(cols: dict) -> dict:
            seen: Counter[tuple[str, int, int, int]] = Counter()
            for host, page in zip(cols["host"], cols["html"], strict=True):
                own = set()
                for text, branch, _, main, tags, links in blocks(page):
                    if text:
                        seen[host, branch, -2, 6] += len(text)
                        if links:
                            seen[host, branch, -3, 8] += links
                    own.add((branch, -1, int(main == 2)))  # the page has the branch
                    own.add((branch, _hash(text) if text else _hash("#" + tags), 2 if text else 4))
                seen.update((host, *x) for x in own)
            keys = list(seen)
            return {"host": [k[0] for k in keys], "branch": [k[1] for k in keys], "feature": [k[2] for k in keys], "kind": [k[3] for k in keys], "n": list(seen.values())}

        return run

    counts = map_slices(pages.select("host", "html"), "host string, branch long, feature long, kind int, n long", make, text="html", chars=8_000_000)
    # 0 and 1: pages, 2: blocks of text, 4: child tags, 6: characters, 8: those in links; 1: the branch is an article or main itself
    c = counts.groupBy("host", "branch", "feature", "kind").agg(F.sum("n").alias("n"))
    kind, n = F.expr("kind div 2"), F.col("n").cast("double")
    sums = c.groupBy("host", "branch").agg(
        F.sum(F.when(kind == 0, F.col("n"))).alias("pages"),
        F.max(F.col("kind") % 2).alias("direct"),
        F.sum(F.when(kind == 1, F.log(n))).alias("log_text"),
        F.count(F.when(kind == 1, 1)).alias("n_text"),
        F.sum(F.when(kind == 2, n * F.log(n))).alias("log_tags"),
        F.sum(F.when(kind == 2, n)).alias("n_tags"),
        (F.coalesce(F.sum(F.when(kind == 4, n)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(kind == 3, n)), F.lit(0.0)), F.lit(1.0))).alias("linked"),
    )
    log_m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("n_text") > 0, 1 - F.col("log_text") / F.col("n_text") / log_m)
    shape = F.when(F.col("n_tags") > 0, (F.log("n_tags") - F.col("log_tags") / F.col("n_tags")) / log_m)
    importance = F.when(F.col("pages") <= 1, 1.0).otherwise(F.coalesce(CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * F.coalesce(shape, F.lit(0.0)), shape, F.lit(1.0)) * (1 - F.col("linked")))
    return sums.select("host", "branch", "pages", "n_text", "direct", importance.alias("importance"))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, cut_by_tree, cut_by_markup) of each row; the last two count blocks.

    A null or empty page has an empty text. Where equally much text is left with and without what weak evidence would cut, it is cut. Without a host a page shares the host ''. Pages are
    read whole, whatever their length. Repeated rows get equal results, and count as pages of
    their host. An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    few = F.col("pages") < MIN_PAGES
    low = site_tree(rows).where((F.col("n_text") > 0) & (F.col("pages") > 1) & (F.col("importance") < F.when(few, 1e-9).otherwise(MIN_IMPORTANCE)))
    low = scratch.save(low.select("host", "branch", (few | (F.col("direct") == 1)).alias("weak")))
    cut = low.groupBy("host").agg(F.collect_set(F.when(~F.col("weak"), F.col("branch"))).alias("cut"), F.collect_set(F.when(F.col("weak"), F.col("branch"))).alias("weak"))
    if low.count() <= BROADCAST_BRANCHES:
        joined = rows.join(F.broadcast(cut), "host", "left")
    else:
        salted = cut.select("host", "cut", "weak", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")

    def make():
        def run(cols: dict) -> dict:
            got = [chosen(p, frozenset(c or ()), frozenset(w or ())) for p, c, w in zip(cols["html"], cols["cut"], cols["weak"], strict=True)]
            texts = ["\n".join(x) for x, _, _ in got]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts)), "cut_by_tree": [x[1] for x in got], "cut_by_markup": [x[2] for x in got]}

        return run

    return map_slices(joined.select("page_id", "url", "html", "cut", "weak"), "page_id long, url string, text string, n_chars long, cut_by_tree long, cut_by_markup long", make, text="html")
