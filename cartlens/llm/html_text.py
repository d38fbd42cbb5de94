"""Main text of web pages without the template of their site.

First pass: every page is parsed, and the subtrees of its container elements and its blocks of text are hashed. Spark
counts, per host, how many different texts stand around a subtree on the pages that have it; subtrees with many of them
are template, on hosts of any size. Copies of a page have the same text around each subtree and count once. Second pass:
the text of the main part is taken, without template subtrees and without elements that by element name, or by a whole
class, id or role token, are no article text. Such a token counts neither on article and main nor on what holds a main; on
what holds an article (comments may be articles) it counts only if another main part stands outside such elements.

Inside a declared main part (article, main) only containers (div, section and the like) can be template, never
plain blocks such as paragraphs, so a text that many pages of a host share stays. Text right in a table cell is no
template of its own.

A page is known by a digest of its host and html, so rows that repeat count once and are extracted alike.

Defined results: a null or empty html has an empty text; a page without a main part gives the text of its body; a null
or odd address counts as a host of its own; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.shared import ship

#: A subtree is template if it stands on pages of its host with so many different texts around it.
LEAST_PAGES = 8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<]*\Z")
# Element names (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; if unclosed, they last to the end of the page.
RAW = frozenset("script style textarea title iframe".split())
#: Elements without text of the page; if unclosed, they end with their parent.
SKIPPED = frozenset("noscript template svg math object select option button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog head search fieldset".split())
CONTAINERS = frozenset("div section table ul ol dl details figure center".split()) | (DROPPED - {"head"})
MAIN = frozenset(("article", "main"))
#: Elements that end where one of these begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCKS - {"body", "html", "head", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "summary", "figcaption"}
ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Whole class, id and role tokens of elements that are no article text; a token may join several of the words.
_WORD = (
    r"(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|cookie\w*|consent|gdpr|notice|alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar"
    r"|footer|header|masthead|comments?|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|overlay|pagination|pager|search"
    r"|complementary|contentinfo|toolbar|widget)"
)
NO_TEXT = re.compile(rf"(?i){_WORD}(?:[-_]+{_WORD})*")


def no_text(attributes: str) -> bool:
    """Whether a whole class, id or role token names an element that is no article text."""
    return any(NO_TEXT.fullmatch(token) for m in ATTRIBUTE.finditer(attributes) for token in (m[1] or m[2] or m[3] or "").split())


def parse(page: str, cut: frozenset[int]) -> tuple[list[str], list[tuple[int, int, int]]]:
    """(blocks of the main text, (number, hash, rest) of subtrees and blocks) of a page without those in `cut`.

    The number of a container subtree, or of a block of text outside a declared main part, is twice the place where it
    begins, and one more for a block; so it does not depend on what is cut. `rest` stands for the text of the page outside the subtree. Unclosed elements end with their parent, as browsers do.
    """
    blocks: list[tuple[bool, list[tuple[list | None, str, int]]]] = []
    piece: list[tuple[list | None, str, int]] = []
    stack: list[tuple[str, int, int, bool, bool, list | None, int]] = []  # tag, start, number or -1, then silent, in main, named and total before
    trees: list[tuple[int, int, int]] = []
    mains: list[list | None] = []
    silent = inside = False
    named: list | None = None  # innermost element that by its name is no article text: [holds main, holds article, outer one]
    at = total = 0

    def flush() -> None:
        nonlocal total
        if not piece:
            return
        own, text = -1, " ".join(html.unescape("".join(t for of, t, _ in piece if of is None)).split())
        if text:
            hashed = xxhash.xxh64_intdigest(text)
            total += hashed
            if not inside and next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "") not in ("td", "th"):
                own = 2 * next(place for of, t, place in piece if of is None and t.strip()) + 1
                trees.append((own, hashed, hashed))
        if own not in cut:
            blocks.append((inside, piece.copy()))
        piece.clear()

    def pop(end: int) -> None:
        nonlocal silent, inside, named
        tag, start, own, before, main, outer, sum_before = stack.pop()
        if own >= 0 and not before:
            trees.append((own, xxhash.xxh64_intdigest(" ".join(page[start:end].split())), total - sum_before))
        silent, inside, named = before, main, outer

    pos = 0
    find = TOKEN.search
    while m := find(page, pos):
        begin, pos = m.span()
        if begin > at and not silent:
            piece.append((named, page[at:begin], at))
        at = pos
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if any(x[0] == tag for x in stack):
                if tag in BLOCKS:
                    flush()
                while stack[-1][0] != tag:
                    pop(begin)
                pop(pos)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            if not silent:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    piece.append((named, " ", begin))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            at = pos = end.end() if end else len(page)
            continue
        ends = CLOSES.get(tag, ())
        if tag in BLOCKS:
            flush()
            if tag in P_ENDS and any(x[0] == "p" for x in stack):
                while stack[-1][0] != "p":
                    pop(begin)
                pop(begin)
        if ends and stack and any(x[0] in ends for x in stack[-4:]):
            while stack and stack[-1][0] in ends | {"p", "b", "i", "a", "span"}:
                pop(begin)
        is_main = tag in MAIN or bool(m[3]) and re.search(r"role\s*=\s*[\"']?main\b", m[3]) is not None
        odd = bool(m[3]) and not is_main and tag not in ("body", "html") and no_text(m[3])
        drop = tag in DROPPED or tag in SKIPPED
        own = -1
        if tag in CONTAINERS or odd:
            own = 2 * begin
            drop = drop or own in cut
        stack.append((tag, begin, own, silent, inside, named, total))
        silent = silent or drop
        if odd:
            named = [False, False, named]
        if is_main:
            inside, outer = True, named
            if not silent:
                mains.append(named)
                while outer is not None:
                    outer[tag == "article"] = True
                    outer = outer[2]
    if at < len(page) and not silent:
        piece.append((named, CUT_TAG.sub("", page[at:]), at))
    flush()
    while stack:
        pop(len(page))

    # an element that holds main is no side part, and one that holds an article only if none stands outside such elements
    def side(of: list | None, spared: tuple[int, ...]) -> bool:
        while of is not None:
            if not any(of[i] for i in spared):
                return True
            of = of[2]
        return False

    spared = (0,) if any(not side(of, (0,)) for of in mains) else (0, 1)
    any_main = any(not side(of, spared) for of in mains)
    texts = (" ".join(html.unescape("".join(t for of, t, _ in block if not side(of, spared))).split()) for main, block in blocks if main or not any_main)
    return [t for t in texts if t], [(n, h, (total - own) % (1 << 64)) for n, h, own in trees]


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(_k, cut): the numbers of the template subtrees of each page that has some. `pages` has _k, _host and _html."""
    ship(pages.sparkSession)
    columns = [T.StructField("_k", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("_host", "tree", "rest")), T.StructField("number", T.IntegerType())]
    schema = T.StructType(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, host, page in zip(batch["_k"], batch["_host"], batch["_html"], strict=True):
                rows += [(k, host, h - (1 << 63), rest - (1 << 63), n) for n, h, rest in parse(page, frozenset())[1]]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    trees = pages.select("_k", "_host", "_html").mapInPandas(run, schema)
    per_page = trees.groupBy("_host", "tree", "_k").agg(F.collect_set("number").alias("numbers"), F.min("rest").alias("rest"))
    # pages that have the same text around a subtree count once, so copies of a page make nothing of it template
    often = per_page.groupBy("_host", "tree").agg(F.count_distinct("rest").alias("n")).where(F.col("n") >= least).select("_host", "tree")
    found = per_page.join(often, ["_host", "tree"])
    return found.groupBy("_k").agg(F.flatten(F.collect_set("numbers")).alias("cut"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    body = F.coalesce(F.col(page), F.lit(""))
    given = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), F.xxhash64(_host(F.col(url))).alias("_host"), body.alias("_html"),
        F.unhex(F.md5(F.concat(_host(F.col(url)), F.lit("\n"), body).cast("binary"))).alias("_k"),
    )
    joined = given.join(templates(given), "_k", "left").select("_key", "_url", "_html", "cut")
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                "\n".join(parse(page, frozenset() if cut is None else frozenset(map(int, cut)))[0])
                for page, cut in zip(batch["_html"], batch["cut"], strict=True)
            ]
            yield pd.DataFrame({key: batch["_key"], url: batch["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, schema)
