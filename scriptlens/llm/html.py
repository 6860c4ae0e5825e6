"""Op 2, main text of web pages with host suffix arrays.

Markup sorts a page's blocks into three zones: ``main`` (inside an article or main
element), ``chrome`` (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, head and hidden parts, told by element, role or the words of class
and id, whatever their length) and ``open`` (anything else). A layout wrapper named
after furniture ("has-sidebar") around an article does not hide it.

Repeated runs decide the open blocks, on pages with and without an article. The
tokens of all blocks are a page's stream; streams of a host are concatenated and a
suffix array (prefix doubling, ``MIN_RUN`` tokens deep) finds runs repeated on
distinct pages; pages of equal content count as one. Streams are range partitioned
by (host, page), so a huge host is cut into several arrays; runs found in different
arrays meet in one aggregate per (host, run), which makes the result the same as
that of one array for the whole host. A host without an open block has nothing to
decide and needs no stream.

A page's text is its main blocks and the open blocks that repeated runs don't
cover: covered boilerplate goes, unique runs stay. Passages that several articles
share are text of each of them and stay, and so do copied articles.

Defined results: null html is an empty page (empty text); repeated rows get
equal results; unique open blocks stay, unique furniture (a comment, a notice)
goes; a page whose markup is cut off is read to its end; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import add_columns, stored

MIN_RUN = 8                 # tokens; a power of two
COVERED = 0.8               # share of a block's tokens in repeated runs
ARRAY_TOKENS = 2_000_000    # memory bound of one suffix array

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

# fixed values: element names of HTML and naming habits of page furniture
BLOCKS = set("""address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
CONTAINERS = set("""article aside body details dialog div dl fieldset figure footer form head header html main
menu nav ol p section span table ul""".split())
CHROME = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button"}
MAIN = {"article", "main"}
HINTS = set("""ad ads advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor
sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription sidebar
sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies responses
disqus related share sharing social popup modal widget pagination login signup toolbar""".split())
# furniture only outside an article, which has a header of its own
OUTER_HINTS = {"header", "topbar"}
# an article under these is no main text; under the other hints (layout wrappers) it is
SECONDARY = set("""comment comments reply replies responses disqus related promo sponsored advert adverts
advertisement advertisements""".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def zone_of(name: str, attributes: str, outer: str) -> str:
    """Zone of an element; ``wrapper`` is furniture around anything but an article."""
    if outer == "chrome" or name in CHROME:
        return "chrome"
    found = outer
    if name in MAIN:
        found = "main"
    elif name == "header" and outer != "main":
        return "chrome"
    if attributes:
        if HIDDEN.search(attributes):
            return "chrome"
        for m in ATTRIBUTE.finditer(attributes) if name not in ("html", "body") else ():
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key == "role":
                if value.lower() == "main":
                    return "main"
                if value.lower() in ROLES:
                    return "chrome"
                continue
            words = set(re.split(r"[^a-z0-9]+", CAMEL.sub("-", value).lower()))
            if words & SECONDARY or outer == "main" and words & HINTS:
                return "chrome"
            if words & (HINTS | OUTER_HINTS) and outer != "main" and name not in MAIN:
                found = "wrapper"
    return found


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order; empty blocks are left out."""
    if not page:
        return []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", "open")]
    parts: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            zone = stack[-1][1]
            blocks.append(("chrome" if zone == "wrapper" else zone, text))
        parts.clear()

    def add(raw: str) -> None:
        parts.append(entities.unescape(raw) if "&" in raw else raw)

    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if not m.group(2) and stack[-1][0] == "p":      # a paragraph ends where a block begins
                stack.pop()
        hinted = name == "span" or name == "button"
        if name not in CONTAINERS and not hinted:
            continue
        if hinted:
            # inline furniture: its zone may differ from the running block's
            zone = zone_of(name, m.group(4), stack[-1][1]) if not m.group(2) else ""
            if zone != stack[-1][1]:
                flush()
        if m.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not m.group(4).endswith("/"):
            if name == "body":
                del stack[1:]
            stack.append((name, zone_of(name, m.group(4), stack[-1][1])))
    if at < len(page):
        add(page[at:])
    flush()
    return blocks


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def hashed(tokens: list[str], cache: dict[str, int]) -> list[int]:
    if len(cache) > 500_000:
        cache.clear()
    out = []
    for t in tokens:
        h = cache.get(t)
        if h is None:
            h = cache[t] = xxhash.xxh64_intdigest(t) - (1 << 63)
        out.append(h)
    return out


def open_hosts(pages: DataFrame) -> DataFrame:
    """(page_host): hosts with a block that repeated runs decide."""
    def make():
        return lambda texts: [[any(z == "open" for z, _ in blocks_of(page)) for page in texts]]

    marked = add_columns(pages, "page_html", make, [("page_open", "boolean", pa.bool_())], ["page_host"], step=128)
    return marked.where("page_open").select("page_host").distinct()


def streams(pages: DataFrame) -> DataFrame:
    """host, page key, content signature, tokens of all blocks, whether each is of
    an open block, and whether the page has one."""
    def make():
        cache: dict[str, int] = {}

        def run(texts: list) -> list:
            out: tuple[list, ...] = ([], [], [], [])
            for page in texts:
                blocks = blocks_of(page)
                tokens: list[int] = []
                is_open: list[bool] = []
                for zone, text in blocks:
                    new = hashed(text.split(" "), cache)
                    tokens += new
                    is_open += [zone == "open"] * len(new)
                content = "\n".join(t for z, t in blocks if z != "chrome")
                for column, value in zip(out, (xxhash.xxh64_intdigest(content) - (1 << 63), tokens, is_open,
                                               any(is_open))):
                    column.append(value)
            return list(out)

        return run

    return add_columns(pages, "page_html", make, [
        ("page_sig", "bigint", pa.int64()), ("tokens", "array<bigint>", pa.list_(pa.int64())),
        ("is_open", "array<boolean>", pa.list_(pa.bool_())), ("page_open", "boolean", pa.bool_())],
        ["page_host", "page_key"], step=128)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(tokens: np.ndarray, depth: int = MIN_RUN) -> np.ndarray:
    """Hash of the ``depth`` tokens from each position on."""
    out = np.zeros(max(0, len(tokens) - depth + 1), dtype=np.uint64)
    for k in range(depth):
        out = out * MULTIPLIER + tokens[k:k + len(out)].view(np.uint64)
    return out.view(np.int64)


def suffix_ranks(host: np.ndarray, tokens: np.ndarray, page: np.ndarray, depth: int = MIN_RUN) -> np.ndarray:
    """Rank of every suffix of the concatenated streams by its first ``depth``
    tokens within its host (prefix doubling); a suffix that runs over the end of
    its page is -1."""
    n = len(tokens)
    _, rank = np.unique(np.stack([host, tokens]), axis=1, return_inverse=True)
    rank = rank.reshape(-1).astype(np.int64)
    width = 1
    while width < depth:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[:n - width] = np.where(page[:n - width] == page[width:], rank[width:], -1)
        pair = np.where((rank >= 0) & (ahead >= 0), rank * (n + 1) + ahead, -1)
        _, rank = np.unique(pair, return_inverse=True)
        rank = np.where(pair >= 0, rank, -1)
        width *= 2
    return rank


def repeated_runs(table: DataFrame, depth: int = MIN_RUN, wanted: DataFrame | None = None) -> DataFrame:
    """(page_host, run): token runs found on pages of different content, of the
    ``wanted`` ones if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                waiting.append(part)
                held += len(part.column("tokens").flatten())
                if held >= ARRAY_TOKENS:
                    yield from groups(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from groups(waiting)

    def groups(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(parts)
        lengths = data.column("tokens").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        tokens = np.concatenate([p.column("tokens").flatten().to_numpy() for p in parts]).astype(np.int64)
        if not len(tokens):
            return
        page = np.repeat(np.arange(len(lengths)), lengths)
        names = data.column("page_host").combine_chunks().dictionary_encode()
        host = np.repeat(names.indices.to_numpy().astype(np.int64), lengths)
        sig = np.repeat(data.column("page_sig").to_numpy(), lengths)
        rank = suffix_ranks(host, tokens, page, depth)
        order = np.argsort(rank, kind="stable")         # the suffix array
        order = order[rank[order] >= 0]
        if not len(order):
            return
        first = np.flatnonzero(np.diff(rank[order], prepend=-1))
        low = np.minimum.reduceat(sig[order], first)
        high = np.maximum.reduceat(sig[order], first)
        head = order[first]
        yield pa.RecordBatch.from_arrays(
            [names.dictionary.take(pa.array(host[head])), pa.array(run_hashes(tokens, depth)[head]),
             pa.array(low), pa.array(high)], names=["page_host", "run", "low", "high"])

    cut = table.select("page_host", "page_key", "page_sig", "tokens").repartitionByRange("page_host", "page_key")
    found = cut.mapInArrow(run, "page_host string, run bigint, low bigint, high bigint")
    if wanted is not None:
        found = found.join(wanted, ["page_host", "run"], "left_semi")
    return (found.groupBy("page_host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .where(F.col("low") < F.col("high")).select("page_host", "run"))


def places(table: DataFrame, depth: int = MIN_RUN) -> DataFrame:
    """page_key, page_host, run, at: runs that touch an open block, and their place."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found: list[tuple] = []
                for row in range(part.num_rows):
                    tokens = part.column("tokens")[row].values.to_numpy()
                    if len(tokens) < depth:
                        continue
                    is_open = part.column("is_open")[row].values.to_numpy(zero_copy_only=False)
                    before = np.concatenate([[0], np.cumsum(is_open)])
                    at = np.flatnonzero(before[depth:] > before[:-depth])
                    found.append((np.full(len(at), row), run_hashes(tokens, depth)[at], at))
                if not found:
                    continue
                rows, hashes, at = (np.concatenate(c) for c in zip(*found))
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_key").take(pick), part.column("page_host").take(pick), pa.array(hashes),
                     pa.array(at.astype(np.int32))], names=["page_key", "page_host", "run", "at"])

    return table.where("page_open").select("page_key", "page_host", "tokens", "is_open").mapInArrow(
        runs, "page_key bigint, page_host string, run bigint, at int")


def repeated_places(table: DataFrame, repeats: DataFrame, depth: int = MIN_RUN) -> DataFrame:
    """page_key -> token places of the page's stream where a repeated run begins
    that touches an open block."""
    return (places(table, depth).join(repeats, ["page_host", "run"])
            .groupBy("page_key").agg(F.collect_set("at").alias("page_runs")))


def page_text(page: str | None, runs: list[int] | None, depth: int = MIN_RUN) -> str:
    """Main blocks and the open blocks that the repeated runs don't cover."""
    blocks = blocks_of(page)
    if not runs:
        return "\n".join(t for z, t in blocks if z != "chrome")
    sizes = np.array([t.count(" ") + 1 for _, t in blocks])
    ends = np.cumsum(sizes)
    change = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    np.add.at(change, np.array(runs), 1)
    np.add.at(change, np.array(runs) + depth, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    covered = hit[ends] - hit[ends - sizes] >= COVERED * sizes
    return "\n".join(t for (z, t), c in zip(blocks, covered) if z == "main" or z == "open" and not c)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: one row per page."""
    keyed = pages.select(
        F.col(id_col), F.col(url_col), F.col(html_col).alias("page_html"), host_of(F.col(url_col)).alias("page_host"),
        F.xxhash64(id_col, url_col, html_col).alias("page_key"))
    hosts = stored(open_hosts(keyed), "hosts")
    table = stored(streams(keyed.join(hosts, "page_host", "left_semi")), "streams")
    wanted = places(table).select("page_host", "run").distinct()
    repeats = stored(repeated_runs(table, wanted=wanted), "runs")
    # equal rows share a key; one verdict per key
    found = stored(repeated_places(table.dropDuplicates(["page_key"]), repeats), "repeated")
    joined = keyed.join(found, "page_key", "left").select(
        id_col, url_col, F.struct("page_html", "page_runs").alias("page"))

    def make():
        return lambda rows: [[page_text(r["page_html"], r["page_runs"]) for r in rows]]

    return add_columns(joined, "page", make, [("text", "string", pa.string())], [id_col, url_col], step=128)
