"""Main text of HTML pages: the maximum-scoring run of tokens, with weights from labelled pages.

A page is scanned once into tokens: words score by their weight (positive), tags by theirs (negative), both log odds of
being content that are fitted on labelled pages. Words below elements or class names that announce other matter (menus, forms, adverts, reader comments)
have classes of their own, as do words in links; whether a token stands in a marked article is a feature of it, with a fitted weight. The contiguous run
with the largest sum is the content region; other matter inside it is left out. Which names announce other matter is fixed: points per part of a name.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, load

#: Pages of the input that the weights are fitted on, about at most; all pages are extracted.
LABELLED_PAGES = 2_000
_PARTS = r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/><]*+)(%s)>|[^<]+|<"
_TOKEN = re.compile(_PARTS % r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.S)
#: Used from a tag on that never ends: tags without quoted signs, so that no later tag is searched to the end of the page again.
_BROKEN = re.compile(_PARTS % r"[^<>]*+", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is never article text.
_OTHER = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "svg", "object", "dialog", "menu", "canvas", "audio", "video", "datalist", "fieldset", "option"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "img", "acronym", "label"}
_BLOCK_ONLY = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "option"}
#: What a part of a class name, id or role says of an element: points against it being article text. Two points mark other matter, also beside a word that speaks for the text.
_STRONG = re.compile(
    r"ads?|adsby\w*|advert\w*|adsense|adbox|adslot|sponsor\w*|promo|promos|promoted|promotions?|banners?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"nav\w*|menus?|breadcrumbs?|pagination|pager|sidebars?|aside|widgets?|footers?|masthead|topbar|toolbar|site-?header|page-?header|"
    r"comments?|commentlist|replies|respond|disqus|related|recommend\w*|recirc|tagcloud|contentinfo|complementary|\w+(?:menu|navbar|sidebar|cookie|banner|comments?|advert|newsletter)\w*"
)
_WEAK = re.compile(r"side|foot|alert|header|reply|responses?|discussion|trending|popular|share|sharing|social|follow|tags?|search\w*|skip|copyright|legal|disclaimer|hidden|screen|reader|stories|form")
#: Parts that speak for article text.
_FOR = re.compile(r"article\w*|story|paper|post|entry|content|essay|chapter|body|text|prose|report|review|analysis|history|policy")
#: Class names that hold one of the words above but say something else.
_NOT_NAMED = re.compile(r"\b(?:has|with|no|without|non)-[\w-]+|\b[\w-]+-(?:free|less)\b|\bside-by-side\b|(?<!\S)(?:tag|category)-(?!(?:cloud|lists?|links?)\b)\S+|\b(?:entry|post|article|content|story|section)[-_]header\b|\b(?:long|short)-?form\b", re.I)
#: Class names that make an article inside another article, or in a main element, a teaser or a reader's comment.
_TEASER = re.compile(r"(?:related|promo\w*|teaser|sponsored|advert\w*|ad|ads|recommended|comment|comments|widget)(?:[-_](?:article|box|card|item|list|post|story|teaser))*", re.I)
#: Whole names of the body of an article or post: what else such an element is called says nothing.
_BODY = re.compile(r"(?<!\S)(?:main-?content|article-?body|entry-?content|post-?content|post-?body|h-?entry|post-\d+|type-(?:post|page))(?!\S)", re.I)
#: Ids of other matter inside an article or on a section. Such ids are often made from the text of a heading, so only names that no heading gives.
_OWN_ID = re.compile(
    r"(?:comments?|commentlist|comments?[_-](?:area|box|container|form|list|section|thread|wrapper)|post[_-]comments|disqus(?:[_-]thread)?|respond|"
    r"(?:related|popular|trending|recommended|more)[_-]?(?:articles?|links?|news|posts?|reads?|stories|videos?)|recirc|(?:\w+[_-])?(?:share|sharing)(?:[_-]?(?:bar|buttons?|icons?|links?|tools?))?|"
    r"social[_-](?:bar|buttons?|icons?|links?|share)|ads?|ad[_-]?(?:bottom|box|container|inline|middle|slot|top|unit|wrapper|\d)[\w-]*|adsense[\w-]*|advert[\w-]*|(?:\w+[_-])?(?:banner|navbar|sidebar)s?|"
    r"(?:article|main|page|post|site|top)[_-](?:footer|header|menu|nav|navigation)|nav|menu|breadcrumbs?|pagination|pager|tagcloud|tag[_-](?:cloud|links?|list)|newsletter(?:[_-]?\w+)?|subscribe(?:[_-]\w+)?|signup|login|"
    r"cookies?[_-]\w+|gdpr|popup|modal|overlay|promo(?:[_-]\w+)?|sponsored(?:[_-]\w+)?|widgets?(?:[_-]\w+)?|footer|masthead|topbar|toolbar)",
    re.I,
)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that hold other matter as a whole; on any other element inside an article a part of a class name says nothing.
_CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "aside", "details", "figure"}
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HYPHEN = re.compile(r"[-_]+")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?", re.I)
_MAIN = re.compile(r"(?<![^\s])(?:main|main-?content|article-?body|entry-?content|post-?content|post-?body)(?!\S)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def points(name: str) -> int:
    """Points of one class name, id or role: its parts against article text less those for it; other matter from 1 on."""
    parts = [x for x in _HYPHEN.split(name.lower()) if x]
    strong = sum(2 for x in parts if _STRONG.fullmatch(x))
    if not strong and _STRONG.fullmatch(name.lower()):
        strong = 2
    return strong + sum(1 for x in parts if _WEAK.fullmatch(x)) - any(map(_FOR.fullmatch, parts))


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), (m[2] or "").strip("\"'")) for m in _ATTR.finditer(attrs)]


def _marks_body(named: list[tuple[str, str]]) -> bool:
    return any(n in ("class", "id", "role", "itemprop") and _MAIN.search(v) for n, v in named)


def _named_other(element: str, named: list[tuple[str, str]], inside: bool) -> bool:
    """Whether attributes announce other matter; inside: the element stands in an article.

    Names never tell against a heading by id, a marked body or an outermost article. Inside an article a class counts
    as a whole, or by its points on a container, and an id only if it can't be made from a heading.
    """
    for name, value in named:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    named = [(n, v) for n, v in named if n in ("class", "id", "role", "itemprop") and v]
    if not named or element == "main" or any(_BODY.search(v) or n in ("id", "role") and v.lower() == "main" for n, v in named):
        return False
    if element == "article":
        return inside and any(n == "class" and any(map(_TEASER.fullmatch, v.split())) for n, v in named)
    section = element == "section" or any(n == "class" and "section" in v.lower().split() for n, v in named)
    for name, value in named:
        value = _NOT_NAMED.sub("", _CAMEL.sub(r"\1-\2", value))
        if name == "id" and (element in _HEADING or inside or section):
            if element not in _HEADING and any(map(_OWN_ID.fullmatch, value.split())):
                return True
        elif inside and element not in _CONTAINER:
            if any(map(_STRONG.fullmatch, value.lower().split())) or any(map(_WEAK.fullmatch, value.lower().split())):
                return True
        elif max(map(points, value.split()), default=0) >= 1:
            return True
    return False


class _Open:
    """Open elements of a page. Positions of each name and of blocks are kept, so that no tag searches the stack."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool]] = []  # name, other matter, link, mark of the article
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.other = self.links = self.marks = self.main = 0

    def push(self, name: str, other: bool, mark: bool) -> None:
        depth = len(self.stack)
        self.stack.append((name, other, name == "a", mark))
        self.at.setdefault(name, []).append(depth)
        if name not in _INLINE:
            self.blocks.append(depth)
        self.other += other
        self.links += name == "a"
        self.marks += mark
        self.main += name in ("article", "main")

    def close(self, depth: int) -> int:
        """Close all from depth on; how many marks of the article end."""
        ended = self.marks
        for name, other, link, mark in self.stack[depth:]:
            self.at[name].pop()
            self.other -= other
            self.links -= link
            self.marks -= mark
            self.main -= name in ("article", "main")
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        return ended - self.marks


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(class, text, block break) in page order; break: a block ends here.

    Classes: word, link (words in links), other (words of other matter); tag, raw (scripts and the like), article and
    /article (marks of the article open and end, in balance), skip (tags of other matter).
    """
    out: list[tuple[str, str, bool]] = []
    now, at = _Open(), 0
    match = _TOKEN.match
    while at < len(page):
        m = match(page, at)
        if m[0] == "<" and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/"):
            match = _BROKEN.match
            m = match(page, at)
        at = m.end()
        name = m[1]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                out.append(("other" if now.other else "link" if now.links else "word", text, False))
            elif text.startswith("<![CDATA["):
                out.append(("other" if now.other else "word", text[9:].removesuffix("]]>"), False))
            continue
        name, closing = name.lower(), m[0][1] == "/"
        inline = name in _INLINE
        block = not inline and name != "br"
        if closing:
            where = now.at.get(name)
            left = bool(where) and now.stack[where[-1]][1]
            ended = 0
            if where and not (inline and now.blocks and now.blocks[-1] > where[-1]):
                ended = now.close(where[-1])
            out.append(("skip" if now.other or left else "tag", " " if name == "br" else "", block))
            out += [("/article", "", True)] * ended
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            out.append(("skip" if now.other else "raw", "", name == "title"))
            continue
        if name in _VOID:
            out.append(("skip" if now.other else "tag", " " if name == "br" else "", block))
            continue
        if name in _BLOCK_ONLY and now.blocks:  # an open paragraph or item of the same kind ends here
            kinds = {"p"} if name not in ("li", "td", "th", "tr", "dt", "dd", "option") else {"p", name} | ({"td", "th"} if name in ("td", "th", "tr") else {"dt", "dd"} if name in ("dt", "dd") else set())
            if now.stack[now.blocks[-1]][0] in kinds:
                out += [("/article", "", True)] * now.close(now.blocks[-1])
        attrs = m[2] or ""
        named = _attributes(attrs) if attrs else []
        is_other = name in _OTHER and not (name == "header" and now.main) or bool(named) and name not in ("html", "body") and _named_other(name, named, now.marks > 0)
        is_mark = not now.other and not is_other and (name in ("article", "main") or bool(named) and block and _marks_body(named))
        out.append(("article" if is_mark else "skip" if now.other or is_other else "tag", "", block))
        if not attrs.endswith("/") or name not in ("svg", "object", "path"):
            now.push(name, is_other, is_mark)
        elif is_mark:
            out.append(("/article", "", True))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the earliest if tied; (0, 0) if none is above 0."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def labelled_pages(n: int = 120, seed: int = 11) -> Iterator[tuple[list[tuple[str, str, bool]], list[bool]]]:
    """Tokens of pages composed from known parts, and whether each is content."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(a, b)))
    links = lambda k: "<ul>" + "".join(f'<li><a href="/x">{say(1, 3)}</a></li>' for _ in range(k)) + "</ul>"
    before = ["<nav>{l}</nav>", '<div class="menu">{l}</div>', "<header><p>{s}</p>{l}</header>", '<div class="ad">{s}</div>', "<div>{l}</div>", "<form><label>{s}</label></form>"]
    after = ["<footer>{s}{l}</footer>", '<div class="comments"><p>{s}</p><p>{t}</p></div>', "<aside><h3>{s}</h3>{l}</aside>", "<div>{l}</div>", '<div class="related">{l}</div>']
    fill = lambda t: t.format(l=links(rng.randint(3, 9)), s=say(3, 12), t=say(10, 60))
    for _ in range(n):
        body = "".join(
            rng.choice((f"<p>{say(8, 90)}</p>", f"<p>{say(8, 60)} <a href='/y'>{say(1, 3)}</a> {say(5, 40)}</p>", f"<h2>{say(2, 7)}</h2>", f"<p><b>{say(4, 30)}</b><br>{say(5, 40)}</p>"))
            for _ in range(rng.randint(2, 12))
        )
        wrap = rng.choice(("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='post-content'>{}</div>"))
        parts = [(x, False) for x in ["<html><head><title>t</title></head><body>", *(fill(rng.choice(before)) for _ in range(rng.randint(1, 4)))]]
        parts += [(wrap.format(f"<h1>{say(2, 9)}</h1>{body}"), True)] + [(fill(rng.choice(after)), False) for _ in range(rng.randint(1, 4))]
        found, label = [], []
        for markup, inside in parts:
            own = tokens(markup)
            found += own
            label += [inside] * len(own)
        yield found, label


#: Where a token stands: in or out of a marked article, or on a page that marks none (`blind`).
PLACES = ("in", "out", "blind")
_WORDS = ("word", "link", "other")


def places(found: list[tuple[str, str, bool]]) -> list[str]:
    """Place of each token: a page's own marks are a feature of its tokens."""
    if not any(k == "article" for k, _, _ in found):
        return ["blind"] * len(found)
    out, depth = [], 0
    for kind, _, _ in found:
        depth += kind == "article"
        out.append("in" if depth else "out")
        depth -= kind == "/article"
    return out


def count_features(found: list[tuple[str, str, bool]], label: list[bool]) -> Counter:
    """Tokens by (class, place, content or not); words by their number. A page that marks its article also counts as one that marks none."""
    out: Counter = Counter()
    for (kind, text, _), place, content in zip(found, places(found), label):
        n = len(text.split()) if kind in _WORDS else 1
        kind = "tag" if kind in ("article", "/article", "raw") else kind
        out[kind, place, content] += n
        if place != "blind":
            out[kind, "blind", content] += n
    return out


def composed_counts() -> Counter:
    out: Counter = Counter()
    for found, label in labelled_pages():
        out.update(count_features(found, label))
    return out


def weights_of(counts: Counter) -> dict[tuple[str, str], float]:
    """Weight of each (class, place): log odds of content, smoothed.

    Words of the text are above 0 on pages without a mark, tags below 0 everywhere (that is what ends a run); other matter inside a marked article
    is 0, as it is left out of the text wherever it stands and must not part two halves of it.
    """
    out = {}
    for place in PLACES:
        yes = sum(n for (_, p, c), n in counts.items() if p == place and c)
        no = sum(n for (_, p, c), n in counts.items() if p == place and not c)
        prior = math.log((yes + 1) / (no + 1))
        for kind in (*_WORDS, "tag", "skip"):
            odds = math.log((counts[kind, place, True] + 1) / (counts[kind, place, False] + 1))
            if place == "blind":
                odds -= prior  # how much of a page is content says nothing about one of its tokens
            out[kind, place] = max(-4.0, min(4.0, odds))
    out["word", "blind"] = max(out["word", "blind"], 0.1)
    out["tag", "blind"] = min(out["tag", "blind"], -0.5)
    out["tag", "out"] = min(out["tag", "out"], -0.5)
    out["tag", "in"] = min(out["tag", "in"], -1e-6)
    for place in PLACES:
        out["skip", place] = 0.0
    out["other", "in"] = 0.0
    return out


def fit_weights(pages: DataFrame | None = None, html: str = "html", limit: int = LABELLED_PAGES) -> dict[tuple[str, str], float]:
    """Weights from labelled pages: composed ones, and about `limit` at most of `pages`, chosen by a hash of the page.

    A page that marks its article (by an element, or a class or role of its body) labels itself: its tokens are content inside the mark. Counted on the executors;
    one row per class, place and label reaches the driver. Pages without a mark teach nothing.
    """
    counts = composed_counts()
    if pages is not None:
        total = pages.count()
        share = min(1.0, limit / max(1, total))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Counter = Counter()
            for batch in batches:
                for page in batch.column(0):
                    found = tokens(page.as_py())
                    where = places(found)
                    if "in" in where:
                        own.update(count_features(found, [w == "in" for w in where]))
            rows = list(own.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
                names=["kind", "place", "content", "n"],
            )

        some = pages.select(html).where(F.col(html).isNotNull() & (F.pmod(F.xxhash64(html), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))))
        for r in some.mapInArrow(run, "kind string, place string, content boolean, n long").groupBy("kind", "place", "content").agg(F.sum("n").alias("n")).collect():
            counts[r["kind"], r["place"], r["content"]] += r["n"]
    return weights_of(counts)


def token_scores(found: list[tuple[str, str, bool]], weights: dict[tuple[str, str], float]) -> list[float]:
    """Score of each token: words by number and weight, tags and marks by theirs."""
    out = []
    for (kind, text, _), place in zip(found, places(found)):
        if kind in _WORDS:
            out.append(len(text.split()) * weights[kind, place])
        else:
            out.append(weights["skip" if kind == "skip" else "tag", place])
    return out


_WEIGHTS: dict[tuple[str, str], float] | None = None


def extract(page: str, weights: dict[tuple[str, str], float] | None = None) -> list[str]:
    """Blocks of the main text of a page, in page order: the maximum-scoring run of its tokens without the other matter inside."""
    global _WEIGHTS
    if weights is None:
        _WEIGHTS = weights = _WEIGHTS or fit_weights()
    found = tokens(page)
    a, b = best_run(token_scores(found, weights))
    if not any(k == "article" for k, _, _ in found):
        while a and found[a - 1][0] != "other" and not (found[a - 1][0] in ("word", "link") and found[a - 1][1].strip()):
            a -= 1
    blocks, current = [], []

    def close():
        block = _SPACE.sub(" ", html_lib.unescape("".join(current))).strip()
        if block:
            blocks.append(block)
        current.clear()

    for kind, text, ends in found[a:b]:
        if ends:
            close()
        if kind in ("word", "link") or kind == "tag" and text:
            current.append(text)
    close()
    return blocks


def extract_pages(df: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """df without its html, with `to`: the main text, blocks joined by an empty line.

    Null or empty html, and pages without article text, give the empty text. Pages are independent: repeated rows
    stay, no row is dropped, an empty df gives an empty result. A column of df named like `to` is replaced. The weights are
    fitted on composed pages and on pages of df that mark their article (see fit_weights).
    """
    names = [c for c in fresh(df, to).columns if c != html]
    schema = df.select(*names, F.lit("").alias(to)).schema
    weights = fit_weights(df, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(extract(p.as_py() or "", weights)) for p in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, to])

    return df.select(*names, html).mapInArrow(run, schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
