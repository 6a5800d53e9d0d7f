"""Main text of web pages by markup and by differencing against the page with the nearest URL.

A page is cut into text lines, one for each block of its markup, and every line knows whether it stands inside
an article and whether inside an element that is boilerplate by name. Pages of one host are ordered by
URL path; each is paired with the neighbour whose path is closer by edit distance. The lines of the
two pages are aligned by longest common subsequence, and shared lines are deleted, as templates repeat and content does
not. One rule is stated for articles: their headings, paragraphs, list items, cells and quotations stay though the neighbour
has them too, as passages and licence lines repeat between articles; what else an article holds (loose text in its containers, such as
site-wide notices) goes. A page that has an article gives the article's lines; another page gives what is left of its body. Pages
with nothing that could go are not aligned.

Markup is read in one pass: every character is looked at a bounded number of times, whatever is left open.

The order is made by range partitioning, so a host that holds a third of all pages is spread over
many tasks; only the first and last page of each range meet in one table. Line hashes are joined, never texts.

Defined results: a null html is empty and gives the empty text; a null or odd URL counts as its whole string under the
empty host; repeated rows are one page in the order and keep their number in the result; a page
without a neighbour loses no line, nor does one that shares its whole body (a mirror); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, partitions, read, text_batches

# Element names of HTML by the role that they have here.
RAW = "script style noscript template svg iframe object canvas textarea select math video audio".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button head title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
ARTICLE = frozenset(("article", "main"))
#: Elements inside an article whose text stays whatever the neighbour has.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption address legend summary".split())
# Words of class, id or role that name boilerplate, those that do so for a paragraph too, and words that may stand beside them.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommend recommended recommendations comment comments disqus reply replies contentinfo complementary search".split())
STRONG = frozenset("ad ads advert advertisement banner sponsored promo cookie cookies consent notice popup newsletter comment comments disqus reply replies".split())
BESIDE = frozenset("box bar list wrap wrapper container block area section link links post posts article articles story stories item items widget unit slot form button buttons icon icons left right top bottom inner content text site page main global the media primary secondary header head title body body-text sticky fixed mobile desktop js js-hook thread".split())
COMMENTS = frozenset("comment comments disqus reply replies".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?![^\s=])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _names(value: str, words: frozenset) -> bool:
    """Whether a whole word of an attribute is made of such names, and of words that may stand beside them."""
    for word in value.lower().split():
        parts = re.split(r"[-_]+", word)
        if any(x in words for x in parts) and all(x in words or x in BESIDE or x.isdigit() or not x for x in parts):
            return True
    return False


def _is_boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    # an article is boilerplate as a reader's comment only; a paragraph of an article by strong names only
    words = COMMENTS if tag == "article" else STRONG if inside_article and tag in CONTENT else NAMES
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name in ("class", "id", "role") and _names(value, words):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, element, closing, attributes) of markup in page order; without an element: a comment or what is never text.

    A quote that is never closed makes quotes plain characters from there on, a tag that is never closed ends the page.
    """
    at, quotes, n = 0, True, len(page)
    ahead = dict.fromkeys(">\"'", -1)

    def following(mark: str, place: int) -> int:
        """The next place of a mark, n without one. Places asked for only rise, so all searches together read the page once."""
        if ahead[mark] < place:
            found = page.find(mark, place)
            ahead[mark] = n if found < 0 else found
        return ahead[mark]

    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        m = NAME.match(page, begin)
        if m is None and page[begin + 1 : begin + 2] not in ("!", "?"):
            at = begin + 1
            continue
        end = following(">", begin)
        if end == n:
            yield begin, n, "", False, ""
            return
        if m is None:
            at = end + 1
            yield begin, at, "", False, ""
            continue
        tag = m[1].lower()
        closing = page[begin + 1] == "/"
        if tag in CLOSING and not closing:
            over = CLOSING[tag].search(page, end + 1)
            at = n if over is None else over.end()
            yield begin, at, "", False, ""
            continue
        if quotes:
            place = m.end()
            while (mark := min(following('"', place), following("'", place))) < (end := following(">", place)):
                over = page.find(page[mark], mark + 1)
                if over < 0:
                    quotes = False
                    break
                place = over + 1
            if not quotes or end == n:
                quotes, end = False, page.find(">", m.end())
        at = end + 1
        yield begin, at, tag, closing, page[m.end() : end]


#: Zones of lines: of an article and kept, of an article and loose, of the body outside of articles, of boilerplate.
KEPT, LOOSE, BODY, GONE = 1, 3, 0, 2


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element; inside an article, content of one, boilerplate
    opened: dict[str, int] = defaultdict(int)
    blocks: list[int] = []  # places of block elements in the stack
    state = (False, False, False)

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                article, content, boiler = state
                out.append((text, GONE if boiler else KEPT if content else LOOSE if article else BODY))
            held.clear()

    def close(k: int) -> None:
        nonlocal state
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()
        state = stack[-1][1:] if stack else (False, False, False)

    at = 0
    for begin, end, tag, closing, attributes in tags(page):
        if begin > at:
            held.append(page[at:begin])
        at = end
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        # a paragraph ends where a block begins, a list item at the next
        if block and blocks and (stack[blocks[-1]][0] == "p" or tag == "li" == stack[blocks[-1]][0]):
            close(blocks[-1])
        article, content, boiler = state
        boiler = boiler or _is_boilerplate(tag, attributes, article)
        article = article or tag in ARTICLE
        if block:
            blocks.append(len(stack))
        stack.append((tag, article, article and (content or tag in CONTENT), boiler))
        opened[tag] += 1
        state = stack[-1][1:]
    held.append(page[at:])
    flush()
    return out


#: Rows between those that an alignment keeps.
EVERY = 256


def shared(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of positions."""
    low, x, y = 0, len(a), len(b)
    while low < min(x, y) and a[low] == b[low]:
        low += 1
    while x > low and y > low and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    # bit-parallel rows: a zero at place j says that the subsequence grows there; time is lines times lines / 64
    n, full = y - low, (1 << (y - low)) - 1
    where: dict[int, int] = defaultdict(int)
    for j in range(n):
        where[b[low + j]] |= 1 << j

    def after(row: int, i: int) -> int:
        met = row & where.get(a[low + i], 0)
        return ((row + met) | (row - met)) & full

    # every EVERY-th row is kept, those between are made again on the way back: memory stays small for very long pages
    kept, row = [], full
    for i in range(x - low):
        if i % EVERY == 0:
            kept.append(row)
        row = after(row, i)
    middle, i, j, block, rows = [], x - low, n, -1, []
    while i and j:
        if (i - 1) // EVERY != block:
            block = (i - 1) // EVERY
            rows = [kept[block]]
            for k in range(block * EVERY, min((block + 1) * EVERY, x - low)):
                rows.append(after(rows[-1], k))
        at = i - block * EVERY
        if rows[at] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[at - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((low + i, low + j))
    return [(k, k) for k in range(low)] + middle[::-1] + [(x + k, y + k) for k in range(len(a) - x)]


PARSED = "page_id long, url string, k long, has_article boolean, open boolean, line array<string>, h array<long>, zone array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        has, is_open, text, h, zone = [], [], [], [], []
        for page in batch.column(3).to_pylist():
            found = lines_of(page)
            zones = [z for _, z in found]
            has.append(KEPT in zones or LOOSE in zones)
            # without an article all of the body is open to differencing
            is_open.append(LOOSE in zones if has[-1] else BODY in zones)
            own = (KEPT, LOOSE) if has[-1] else (BODY,)
            text.append([t for t, z in found if z in own])
            h.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found])
            zone.append(zones)
        columns = [*(batch.column(k) for k in range(3)), pa.array(has, pa.bool_()), pa.array(is_open, pa.bool_()), pa.array(text, pa.list_(pa.string())), pa.array(h, pa.list_(pa.int64())), pa.array(zone, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "k", "has_article", "open", "line", "h", "zone"])


def shared_lines(has: bool, h: list[int], zone: list[int], other: list[int]) -> list[int]:
    """Which of a page's own lines (those it may give) go, as the neighbour's lines ``other`` hold them in the same order."""
    open_to, own = (LOOSE, (KEPT, LOOSE)) if has else (BODY, (BODY,))
    met = {i for i, _ in shared(h, other)}
    mine = [i for i, z in enumerate(zone) if z in own]
    drop = [n for n, i in enumerate(mine) if i in met and zone[i] == open_to]
    # a page that shares all that it could give has a mirror beside it, not a template
    return [] if all(i in met for i in mine) else drop


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, has_article, h, zone, h of the neighbour -> which of the page's own lines go."""
    for batch in batches:
        gone = [shared_lines(has, h, zone, other or []) for has, h, zone, other in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["k", "gone"])


def neighbours(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, url) -> (k, near): the page of the same host whose path is next in order and closer."""
    spark = keys.sparkSession
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    me = keys.select(F.struct(host.alias("host"), path.alias("path"), "k").alias("me")).distinct()
    dealt = me.repartitionByRange(partitions(spark), "me").withColumn("r", F.spark_partition_id())
    dealt = scratch.save(dealt, "order")
    inside = Window.partitionBy("r").orderBy("me")
    x = dealt.select("r", "me", F.lag("me").over(inside).alias("before"), F.lead("me").over(inside).alias("after"))
    # one row for each range: the last page of the range before, the first of the range after
    along = Window.orderBy("r")
    ends = dealt.groupBy("r").agg(F.min("me").alias("lo"), F.max("me").alias("hi"))
    ends = ends.select("r", F.lag("hi").over(along).alias("far_before"), F.lead("lo").over(along).alias("far_after"))
    x = x.join(ends, "r").select("me", F.coalesce("before", "far_before").alias("b"), F.coalesce("after", "far_after").alias("a"))
    distance = lambda n: F.when(F.col(f"{n}.host") == F.col("me.host"), F.levenshtein(F.col(f"{n}.path"), F.col("me.path")))
    x = x.withColumn("db", distance("b")).withColumn("da", distance("a"))
    near = F.when(F.col("db").isNotNull() & (F.col("da").isNull() | (F.col("db") <= F.col("da"))), F.col("b.k")).when(F.col("da").isNotNull(), F.col("a.k"))
    return x.select(F.col("me.k").alias("k"), near.alias("near")).where("near is not null")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_deleted (lines that its neighbour has too)."""
    spark = text_batches(pages).sparkSession
    scratch = Scratch(spark)
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    base = base.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("k"), "html")
    parsed = scratch.save(base.mapInArrow(_parse, PARSED), "parsed")
    # only pages with lines that may go are paired, and only their neighbours' lines are fetched
    may = scratch.save(parsed.where("open").select("k").distinct(), "open")
    near = scratch.save(neighbours(parsed.select("k", "url"), scratch).join(may, "k", "left_semi"), "near")
    lines = parsed.where("open").select("k", "has_article", "h", "zone").dropDuplicates(["k"])
    other = parsed.join(near.select(F.col("near").alias("k")).distinct(), "k", "left_semi").select(F.col("k").alias("near"), F.col("h").alias("other")).dropDuplicates(["near"])
    both = lines.join(near, "k").join(other, "near").select("k", "has_article", "h", "zone", "other")
    changed = scratch.save(both.mapInArrow(_difference, "k long, gone array<int>").where(F.size("gone") > 0), "changed")
    # only pages that lose lines are in ``changed``: where they are few, Spark broadcasts them and no text is shuffled
    x = parsed.select("page_id", "url", "k", "line").join(changed, "k", "left")
    kept = F.filter("line", lambda _, i: ~F.array_contains("gone", i))
    text = F.array_join(F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("line")), " ")
    n_deleted = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0)
    return x.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), n_deleted.cast("long").alias("n_deleted"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
