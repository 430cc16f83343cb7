"""Main text of web pages by nearest-URL page differencing (operator 6).

1. Every page is cut into text lines at block tags; each line knows which containers hold it.
2. Pages lie in URL order within their host; a page's partner is the neighbour that shares the longer path prefix (ties:
   the one before).  Neighbours across the border of two range partitions are found from the partitions' ends.
3. The line hashes of a page and its partner are aligned by longest common subsequence; aligned lines are shared.
4. Shared lines are deleted, but for those that an exact check holds to be article text: lines in an article or main
   container that are not mostly links, and all lines where page and partner are copies (over half of their text is
   shared) and no container is marked.
5. The exact check also drops lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and
   lines outside the article of a page that marks one.

Defined results: a null or empty page has the empty text; pages without a host have no partner and are checked by
their containers alone; equal rows count once for pairing and each gives its row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kgrec.llm.common import with_fields, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = frozenset("script style textarea noscript template iframe svg math object noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split())
# Elements, and words of class, id or role, that mark what is not the article.
DROP = frozenset("head nav aside footer form menu dialog button select option label fieldset".split())
DROP_HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies disqus footer gdpr hidden masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted recommended related replies respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADER_NAMES = frozenset("header site-header page-header top-header site_header page_header".split())
MOSTLY = 0.5  # of a line's characters in links, or of two pages' characters that are shared


class Line:
    __slots__ = ("parts", "link", "main", "drop")

    def __init__(self, main: bool, drop: bool):
        self.parts, self.link, self.main, self.drop = [], 0, main, drop


def _marks(name: str, attrs: str, in_main: bool) -> bool:
    """Whether the element holds something that is not the article."""
    if name in DROP or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for kind, *values in HINT.findall(attrs):
        value = "".join(values).lower()
        names = value.split()
        if HEADER_NAMES.intersection(names) and not in_main:
            return True
        if DROP_HINTS.intersection(re.split(r"[\s_-]+", value)) and not (kind.lower() == "id" and name in ("h1", "h2", "h3")):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, bool, bool, bool]]:
    """``(text, main, drop, links)`` of each text line in page order; references are decoded, white space is one space."""
    page = page or ""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, whether in main, whether dropped
    line, at, main, drop, links = Line(False, False), 0, False, False, 0

    def text(raw: str) -> None:
        if raw:
            line.parts.append(raw)
            if links:
                line.link += len(raw.strip())

    def start_line() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        line = Line(main, drop)

    while at < len(page):
        tag = TOKEN.search(page, at)
        if not tag:
            text(page[at:])
            break
        text(page[at:tag.start()])
        at = tag.end()
        if tag["cdata"]:
            text(tag["cdata"])
        name = tag["name"] and tag["name"].lower()
        if not name:
            continue
        if tag["close"]:
            if name in BLOCKS:
                start_line()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                    main, drop = stack[-1][1:] if stack else (False, False)
                    if name in BLOCKS or drop != line.drop or main != line.main:
                        start_line()
                    break
            continue
        if name in RAW:
            if not tag["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            if name in ("p", "li") or name in ("div", "h1", "h2", "h3", "ul", "ol", "table", "section", "article", "nav", "footer"):
                for k in range(len(stack) - 1, -1, -1):  # an open paragraph or item ends here
                    if stack[k][0] == "p" or (name == "li" and stack[k][0] == "li"):
                        links -= sum(e[0] == "a" for e in stack[k:])
                        del stack[k:]
                        main, drop = stack[-1][1:] if stack else (False, False)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            start_line()
        if name in VOID:
            continue
        marked = _marks(name, tag["attrs"], main)
        main = main or (name in ("article", "main") or "role=\"main\"" in tag["attrs"]) and not (drop or marked)
        drop = drop or marked
        stack.append((name, main, drop))
        links += name == "a"
        if name in BLOCKS or marked:
            start_line()
    start_line()
    found = []
    for x in out:
        value = " ".join(entities.unescape("".join(x.parts)).split())
        if value:
            found.append((value, x.main, x.drop, x.link >= MOSTLY * len(value)))
    return found


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` that a longest common subsequence with ``b`` aligns (bit-parallel, then traced back)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head:len(a) - tail]) & set(b[head:len(b) - tail])  # other lines are in no common subsequence
    mid_a = [i for i in range(head, len(a) - tail) if a[i] in both]
    mid_b = [x for x in b[head:len(b) - tail] if x in both]
    where: dict[int, int] = {}
    for j, x in enumerate(mid_b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(mid_b)) - 1
    row, rows = full, [full]
    for i in mid_a:
        m = where[a[i]]
        row = ((row + (row & m)) | (row & ~m)) & full
        rows.append(row)  # zero bits: columns at which the subsequence grows
    hits, j = [], len(mid_b)
    for k in range(len(mid_a), 0, -1):
        grown = lambda r, to: to - (r & ((1 << to) - 1)).bit_count()  # noqa: E731  its length in the first ``to`` columns
        while j and grown(rows[k], j - 1) == grown(rows[k], j):
            j -= 1
        if j and grown(rows[k - 1], j) < grown(rows[k], j):
            hits.append(mid_a[k - 1])
            j -= 1
    return [*range(head), *hits[::-1], *range(len(a) - tail, len(a))]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


ENDS = "k0 bigint, k1 bigint, host string, path string, hashes array<bigint>"
PAIRED = "k0 bigint, k1 bigint, shared array<int>, own struct<host:string,path:string,hashes:array<bigint>>, " \
         "other struct<host:string,path:string,hashes:array<bigint>>, first boolean"


def _align(row: tuple, before: tuple | None, after: tuple | None) -> list[int]:
    """Shared positions of a row ``(k0, k1, host, path, hashes)`` with the nearer of its two neighbours."""
    near = [x for x in (before, after) if x is not None and row[2] is not None and x[2] == row[2]]
    if not near:
        return []
    return shared(list(row[4]), list(max(near, key=lambda x: _prefix(x[3], row[3]))[4]))


def partners(keyed: DataFrame) -> DataFrame:
    """``(k0, k1, shared)`` for rows of ``ENDS``: each page's lines that its partner has too."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        before, here, done = None, next(rows, None), []
        names = ["k0", "k1", "shared", "own", "other", "first"]
        as_dict = lambda r: r and {"host": r[2], "path": r[3], "hashes": r[4]}
        while here is not None:
            after = next(rows, None)
            if before is None or after is None:  # an end: its other neighbour is in another partition
                inner = after if before is None else before
                done.append((here[0], here[1], None, as_dict(here), as_dict(inner), before is None))
                if before is None and after is None:
                    done[-1] = (*done[-1][:5], True)
            else:
                done.append((here[0], here[1], _align(here, before, after), None, None, None))
            before, here = here, after
            if len(done) >= 2000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if done:
            yield pd.DataFrame(done, columns=names)

    spread = keyed.repartitionByRange("host", "path", "k0", "k1").sortWithinPartitions("host", "path", "k0", "k1")
    paired = written(spread.mapInPandas(run, PAIRED), "html-pairs")
    ends = paired.filter("shared is null")  # two rows for each partition, one where it has one page
    order = W.orderBy("own.host", "own.path", "k0", "k1")
    sided = ends.select("k0", "k1", "own", "other", "first", F.lag("own").over(order).alias("up"), F.lead("own").over(order).alias("down"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_row = lambda d: None if d is None else (0, 0, d["host"], d["path"], d["hashes"])
        for b in batches:
            got = []
            for r in b.to_dict("records"):
                alone = r["other"] is None
                before = as_row(r["up"] if r["first"] else r["other"])
                after = as_row(r["down"] if alone or not r["first"] else r["other"])
                got.append((r["k0"], r["k1"], _align(as_row(r["own"]), before, after)))
            yield pd.DataFrame(got, columns=["k0", "k1", "shared"])

    rest = sided.mapInPandas(finish, "k0 bigint, k1 bigint, shared array<int>")
    return paired.filter("shared is not null").select("k0", "k1", "shared").unionByName(rest)


def main_lines(page: str | None, common: list[int]) -> list[str]:
    """The article's lines of a page whose lines ``common`` its partner has too."""
    found = lines(page)
    marked = any(main and not drop for _, main, drop, _ in found)
    both = np.zeros(len(found), bool)
    both[[i for i in common if i < len(found)]] = True
    size = [0 if drop else len(value) for value, _, drop, _ in found]
    copies = sum(n for n, c in zip(size, both, strict=True) if c) > MOSTLY * sum(size)
    out = []
    for (value, main, drop, links), common_line in zip(found, both, strict=True):
        if drop or (marked and not main):
            continue
        if common_line and (links if main else not copies):
            continue
        out.append(value)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row."""
    named = pages.select("page_id", "url", "html")
    key = [F.xxhash64(F.lit(s), "page_id", "url", "html").alias(f"k{s}") for s in (0, 1)]
    rest = F.regexp_replace(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[xxhash.xxh64_intdigest(x[0].encode("utf-8", "replace")) - (1 << 63) for x in lines(v.as_py())] for v in b.column("html")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k0", "k1", "host", "path")), pa.array(found, pa.list_(pa.int64()))],
                                             ["k0", "k1", "host", "path", "hashes"])

    narrow = named.select(*key, F.when(host != "", host).alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    prints = written(narrow.mapInArrow(hashed, ENDS).dropDuplicates(["k0", "k1"]), "html-lines")
    common = partners(prints)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [" ".join(main_lines(v.as_py(), s.as_py() or [])) for v, s in zip(b.column("html"), b.column("shared"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string())], ["page_id", "url", "text"])

    wide = named.select("*", *key).join(common, ["k0", "k1"], "left").select("page_id", "url", F.col("html").cast("string").alias("html"), "shared")
    return wide.mapInArrow(texts, with_fields(named.select("page_id", "url").schema, text=T.StringType()))
