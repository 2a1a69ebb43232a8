"""Main text of web pages by differencing with the nearest URLs of the host.

A page becomes text blocks in page order, each kept, left out or open. Blocks of an ``article`` or ``main``
element are kept, and those around it left out; so are those in elements whose tag, role or name says menu,
header, footer, sidebar, notice, advert, form or comment list, alone or with words of layout (``comment-list``). Open are the
blocks of an element whose name has such a word beside others (``related-work``, ``ad-hoc`` may be text), blocks in an
article that are mostly links, and all blocks of pages without an article or main element.

The blocks of a page with open ones are aligned with those of the pages before and after it in the host's URL order by
longest common subsequence. An open block that stands in both (in one, at either end of a host) is the host's,
not the page's, and goes. A neighbour with the same blocks throughout is a copy and tells nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.llm.common import in_parts, staged

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
LEFT_OUT = frozenset("nav aside footer form head menu dialog button select fieldset".split())
#: Words of class and id names (split at marks) that name a frame around the text, those that do so as a whole name only, and words of layout.
FRAME_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr newsletter "
    "popup modal sidebar menu nav navbar navigation navigator breadcrumb breadcrumbs topbar footer comment comments commentlist disqus pagination pager toolbar".split()
)
WHOLE_NAMES = frozenset(
    "promo promotion notice alert subscribe subscription signup overlay respond reply replies related recommended share sharing social widget widgets skip search login".split()
)
LAYOUT_WORDS = frozenset(
    "list section area box wrap wrapper container block item items bar left right top bottom inner outer body content row col column main site page post global primary secondary "
    "links link form panel button slot unit head header title holder group module region text wide small large mobile desktop".split()
)
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


#: What becomes of a block.
OUT, OPEN, KEPT = 0, 1, 2
#: The share of a block's text in links from which it is a list of links: an open one goes, one in an article is open.
LINKS = 0.5


def standing(tag: str, attrs: str, in_text: bool) -> int:
    """OUT for an element that is a frame, OPEN for one that may be, else KEPT."""
    if tag in LEFT_OUT or (tag == "header" and not in_text):
        return OUT
    if not attrs or tag in ("html", "body", "article", "main"):
        return KEPT
    found = KEPT
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return OUT
        if name == "role" and value.lower() in FRAME_ROLES:
            return OUT
        if name in ("class", "id"):
            for whole in value.split():
                words = {w.lower() for w in SPLIT_NAME.split(whole) if w and not w.isdigit()}
                if whole.lower() in WHOLE_NAMES or (not in_text and "header" in words) or (words & FRAME_NAMES and words <= FRAME_NAMES | WHOLE_NAMES | LAYOUT_WORDS):
                    return OUT
                if words & (FRAME_NAMES | WHOLE_NAMES) and tag in BLOCK:
                    found = OPEN
    return found


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(OUT, OPEN or KEPT, text) of each text block of a page."""
    page = page or ""
    stack: list[tuple[str, int, bool]] = []  # element, standing, inside the main text
    found: list[tuple[int, bool, str]] = []
    held: list[str] = []
    aside: list[str] = []  # of frames within a block
    at, now, inside, has_main, links, linked = 0, KEPT, False, False, 0, 0

    def close_block() -> None:
        nonlocal linked
        for kind, parts in ((OUT, aside), (now or KEPT, held)):
            if parts:
                if text := " ".join(entities.unescape("".join(parts)).split()):
                    listed = linked > LINKS * sum(map(len, parts))
                    found.append((max(kind - 1, OUT) if listed else kind, inside, text))
                parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        (held if now else aside).append(text)
        linked += len(text) if links and now else 0

    while True:
        m = TOKEN.search(page, at)
        if (m.start() if m else len(page)) > at:
            put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            put(entities.escape(m[0][9:].removesuffix("]]>")))
        if not tag:
            continue
        if tag in BLOCK:
            close_block()
        elif tag in ("br", "td", "th"):
            put(" ")
        elif tag == "a":
            links = 0 if m[1] else 1
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                del stack[depth:]
                now, inside = (stack[-1][1], stack[-1][2]) if stack else (KEPT, False)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end and not m[0].endswith("/>") else at if m[0].endswith("/>") else len(page)
        elif tag not in VOID and not m[0].endswith("/>"):
            if tag == "p":  # a paragraph ends where the next begins
                while stack and stack[-1][0] == "p":
                    stack.pop()
                    now, inside = (stack[-1][1], stack[-1][2]) if stack else (KEPT, False)
            now = min(now, standing(tag, m[3], inside))
            if now and tag in ("article", "main"):
                inside = has_main = True
            stack.append((tag, now, inside))
    close_block()
    return [((kind if i else OUT) if has_main else min(kind, OPEN), t) for kind, i, t in found]


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each beginning of ``b``: bit-parallel rows in one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # a bit of ``row`` is clear where the length grows; read column by column
    full = (1 << len(a)) - 1
    row, out = full, np.zeros(len(b) + 1, np.int64)
    for j, x in enumerate(b):
        met = where.get(x, 0)
        if met:
            row = ((row + (row & met)) | (row & ~met)) & full
        out[j + 1] = len(a) - row.bit_count()
    return out


def common_places(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, at every length (Hirschberg: memory of a row)."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            out.append(k - 1)
            k, m = k - 1, m - 1
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        half = (i + k) // 2
        left = prefix_lengths(a[i:half], b[j:m])
        right = prefix_lengths(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int((left + right).argmax())
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def neighbours(pages: DataFrame) -> DataFrame:
    """(row, near) for each page: the rows before and after it in the URL order of its host.

    ``pages``: (row, host, path). The order is range-partitioned and written with its partition numbers, so
    a host with most of the pages lies in many partitions; only the first and last page of each partition
    meet those of the next.
    """
    order = ["host", "path", "row"]
    dealt = staged(pages.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "url-order")
    inner = Window.partitionBy("part").orderBy(*order)
    both = dealt.select("row", "host", "part", F.lag(F.struct("host", "row")).over(inner).alias("b"), F.lead(F.struct("host", "row")).over(inner).alias("a"))
    found = both.select("row", "host", F.explode(F.array("a", "b")).alias("n")).where((F.col("n.host") == F.col("host"))).select("row", F.col("n.row").alias("near"))
    # two rows for each partition
    edges = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).orderBy("part").collect()
    pairs = [(x["last"]["row"], y["first"]["row"]) for x, y in zip(edges, edges[1:], strict=False) if x["last"]["host"] == y["first"]["host"]]
    kind = f"row {pages.schema['row'].dataType.simpleString()}, near {pages.schema['row'].dataType.simpleString()}"
    return found.unionByName(pages.sparkSession.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], kind))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each page; blocks are joined by an empty line.

    Null and empty pages (and pages of frames only) have an empty text. A null url belongs to the host ''.
    Rows with one id and url are neighbours like any others; repeated rows each come back. Pages of any length
    are read whole. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("row", F.struct("id", F.xxhash64("url", "html").alias("h")))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_parts(batch, batch["html"].str.len().fillna(0)):
                out = b[["id", "h", "url"]].copy()
                got = [blocks_of(t) for t in b["html"]]
                out["lines"] = [[xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in x] for x in got]
                out["open"] = [[i for i, (k, _) in enumerate(x) if k == OPEN] for x in got]
                yield out

    # hashes of the blocks of every page, and the places of open ones
    lined = rows.select("id", "row.h", "url", "html").mapInPandas(lines, f"id {kind}, h long, url {url_kind}, lines array<long>, open array<int>")
    lined = staged(lined.select(F.struct("id", "h").alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "lines", "open"), "page-lines")
    near = neighbours(lined.select("row", "host", "path").dropDuplicates(["row"]))
    own, other = lined.dropDuplicates(["row"]).select("row", "lines", "open"), lined.dropDuplicates(["row"]).select(F.col("row").alias("near"), F.col("lines").alias("others"))
    paired = near.join(own, "row").join(other, "near")

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            met = [common_places(list(a), list(z)) if len(o) else [] for a, z, o in zip(b["lines"], b["others"], b["open"], strict=True)]
            tells = [len(o) > 0 and (len(m) < len(a) or len(m) < len(z)) for m, a, z, o in zip(met, b["lines"], b["others"], b["open"], strict=True)]
            open_ = [[i for i in m if i in set(o)] for m, o in zip(met, b["open"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "places": open_})[np.array(tells, bool)]

    gone = paired.select("row.id", "row.h", "lines", "others", "open").mapInPandas(shared, f"id {kind}, h long, places array<int>")
    met = F.collect_list("places").alias("met")
    gone = gone.groupBy("id", "h").agg(met).select(F.struct("id", "h").alias("row"), F.reduce(F.slice("met", 2, 9), F.get("met", F.lit(0)), lambda a, x: F.array_intersect(a, x)).alias("gone"))
    # written before the pages are joined: the shuffle files of both need not be on disk at once
    gone = staged(gone.where(F.size("gone") > 0), "shared-blocks")
    joined = rows.join(gone, "row", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_parts(batch, batch["html"].str.len().fillna(0)):
                out = []
                for t, cut in zip(b["html"], b["gone"], strict=True):
                    cut = set() if cut is None else set(cut)
                    out.append("\n\n".join(x for i, (k, x) in enumerate(blocks_of(t)) if k and i not in cut))
                yield pd.DataFrame({"id": b["id"].to_numpy(), "url": b["url"].to_numpy(), "text": out, "n_chars": [len(t) for t in out]})

    done = joined.select("id", "url", "html", "gone").mapInPandas(texts, f"id {kind}, url {url_kind}, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
