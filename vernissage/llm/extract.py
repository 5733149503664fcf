"""Main text of web pages: structure, and a suffix array of each host's repeated token runs.

Pages are cut into blocks at block-level tags. What a block is by its markup is settled where markup
says so: scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and comments (by
tag, or by a word of class, id or role) are not content; inside <article> or <main>, everything else is.
A word of a class or id says nothing after "has", "with" or "no", nor "header" inside an article, nor of a
block around <main>, nor of one around <article> on a page whose other markup names no content.
The blocks that are left - all of a page without such an element, or those beside it - are decided by
their host: the token streams of its pages are concatenated, with a gap between blocks, in parts of about
`PART_PAGES` pages; in each part's suffix array, neighbours with a common prefix of `RUN` tokens give the
distinct runs and on how many pages they lie; these counts are summed over the parts. A block is
boilerplate if at least `COVERED` of its tokens lie in runs that two pages or more of the host hold, pages
of the same words at several addresses being one; the
unique ones stay, if their page has no <article> or <main>.

Repeated runs alone would be wrong both ways: adverts and menus that only one page has would stay, and
articles that two pages share would go. So they decide only where the markup does not.

Defined cases: null and empty html give an empty text; unclosed tags end with their parent, a cut tag at
the end of a page is dropped; a page without a host is of the host ''; equal rows are one page when pages
are counted, and each gets its text; extra columns are ignored."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.store import Store

RUN = 8
COVERED = 0.5
PART_PAGES = 250
# Names that mark-up gives to blocks and to what is no content.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "math", "head", "title", "textarea", "select", "button")
DROPPED = ("nav", "footer", "aside", "form", "menu", "dialog")
MAIN = ("article", "main")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(("p",))
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer comment comments reply replies disqus share sharing "
    "social related newsletter subscribe subscription widget toolbar pagination login signup".split())
UNLESS = frozenset("has with no without".split())
# "related-work" and "social-policy" name sections: these hints need a second word of this kind, or none.
SOFT = frozenset("related social".split())
WITH_SOFT = HINTS | frozenset(
    "article articles bar block box button buttons container content contents entries entry icon icons item items link links list "
    "media news page pages post posts reading section stories story topic topics wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])|-")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _hinted(attributes: str, in_main: bool) -> str:
    """Which of "role" and "name" (a word of class or id) says that the block is no content, or neither."""
    found = ""
    if "=" not in attributes:
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        for part in "".join(values).split():
            words = [w.lower() for w in _SPLIT.split(part) if w]
            if name.lower() == "role":
                if ROLES.intersection(words):
                    return "role"
                continue
            until = next((i for i, w in enumerate(words) if w in UNLESS), len(words))
            hints = {w for w in words[:until] if w in HINTS and not (in_main and w == "header")}
            if hints - SOFT or hints and WITH_SOFT.issuperset(words):
                found = "name"
    return found


def blocks(source: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """([(text, dropped by mark-up, inside the main element)], whether there is a main element)."""
    out, any_main, around_main, around_article = _blocks(source, frozenset())
    if around_main:
        out, any_main, _, around_article = _blocks(source, around_main)
    if around_article and not any_main:
        out, any_main, _, _ = _blocks(source, around_main | around_article)
    return out, any_main


def _blocks(source: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool, bool]], bool, frozenset[int], frozenset[int]]:
    """The blocks, and where those begin that nothing but a class or id drops although they hold <main>, or
    <article>; `spared` are such beginnings that do not count."""
    around: dict[str, set[int]] = {name: set() for name in MAIN}
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, drops, is main, where it begins if but a class or id drops it
    drops = mains = 0
    any_main = False
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, drops > 0, mains > 0))

    def pop(to: int) -> None:
        nonlocal drops, mains
        while len(stack) > to:
            _, d, m, _ = stack.pop()
            drops -= d
            mains -= m

    while at < len(source):
        tag = _TAG.search(source, at)
        if tag is None:
            parts.append(source[at:])
            break
        parts.append(source[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        closed = tag[0].endswith(">")
        if tag[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in BLOCKS and name not in BLOCKS:
                    break  # an inline end tag does not close the block around it
            continue
        if not closed:
            break  # the page was cut inside a tag
        if name in _END:
            end = _END[name].search(source, at)
            # An unclosed head or hidden element must not hide the page.
            at = end.end() if end else (len(source) if name in ("script", "style") else at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSED_BY_BLOCK:
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or tag[3].endswith("/"):
            continue
        main = name in MAIN and drops == 0
        if name in MAIN and not main and mains == 0:
            over = [begin for _, d, _, begin in stack if d]
            if min(over) >= 0:
                around[name].update(over)
        certain = name in DROPPED or (name == "header" and mains == 0)
        hint = "" if main or certain or name in ("html", "body") or tag.start() in spared else _hinted(tag[3], mains > 0)
        dropped = certain or hint != ""
        any_main |= main
        drops, mains = drops + dropped, mains + main
        stack.append((name, dropped, main, tag.start() if hint == "name" else -1))
    flush()
    return out, any_main, frozenset(around["main"]), frozenset(around["article"])


def _open(source: str | None) -> tuple[list[tuple[str, bool, bool]], bool, list[int]]:
    """The page's blocks, whether it has a main element, and which blocks its host has a say in."""
    found, any_main = blocks(source or "")
    return found, any_main, [i for i, (_, _, main) in enumerate(found) if not main]


def repeated_runs(streams: list[list[np.ndarray]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, pages) of the distinct runs of `run` tokens in a host part: `streams` are a list of blocks
    for each page. Suffix array by prefix doubling; equal ranks at depth `run` are common prefixes."""
    flat = [b for page in streams for b in page]
    lengths = np.array([len(b) for b in flat])
    if not len(flat) or lengths.max() < run:
        return np.empty(0, T.U), np.empty(0, np.int64)
    page = np.repeat(np.arange(len(streams)), [sum(len(b) + 1 for b in p) for p in streams])
    start = np.cumsum(lengths + 1) - (lengths + 1)
    values = np.concatenate([np.append(b, T.U(0)) for b in flat])
    _, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    known, n = 1, len(rank)
    while known < run:
        step = min(known, run - known)
        ahead = np.append(rank[step:], np.full(step, -1))
        key = rank * (n + 1) + ahead + 1
        suffixes = np.argsort(key, kind="stable")
        rank[suffixes] = np.cumsum(np.append(0, np.diff(key[suffixes]) != 0))
        known += step
    suffixes = np.argsort(rank, kind="stable")
    room = np.repeat(start + lengths, lengths + 1) - np.arange(n)  # tokens left in the block
    suffixes = suffixes[room[suffixes] >= run]
    pair = np.unique(np.stack([rank[suffixes], page[suffixes]]), axis=1)[0]
    kinds, pages = np.unique(pair, return_counts=True)
    first = np.zeros(n, dtype=np.int64)
    first[rank[suffixes[::-1]]] = suffixes[::-1]
    return _run_hashes(values, first[kinds], run), pages


def _run_hashes(values: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=T.U)
    for k in range(run):
        out = out * T.U(0xC2B2AE3D27D4EB4F) + values[at + k]
    return T.mix(out)


def main_texts(pages: DataFrame, *, run: int = RUN, covered: float = COVERED, part_pages: int = PART_PAGES, store: Store | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html)."""
    store = store or Store(pages.sparkSession)
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    keyed = kept.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn("host", host)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, flat, undecided = [], [], [], []
            for source in batch.column(2):
                found, any_main, at = _open(source.as_py())
                texts = [found[i][0] for i in at]
                part = T.Texts(0, np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
                w = T.words(part)
                sizes.append(np.diff(w.first))
                flat.append(w.hash)
                undecided.append(not any_main)
            n = np.array([len(s) for s in sizes])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(undecided, pa.bool_()),
                T.lists(np.concatenate(sizes).astype(np.int32), n) if len(n) else pa.array([], pa.list_(pa.int32())),
                T.lists(T.longs(np.concatenate(flat)), np.array([len(f) for f in flat])) if len(n) else pa.array([], pa.list_(pa.int64())),
            ], names=["key", "host", "undecided", "sizes", "tokens"])

    streams = keyed.select("key", "host", "html").mapInArrow(
        stream, "key long, host string, undecided boolean, sizes array<int>, tokens array<long>")
    streams = store.put(streams.dropDuplicates(["key"]), "streams")
    parts = streams.groupBy("host").agg(F.ceil(F.count("*") / part_pages).cast("int").alias("parts"))
    # A page at several addresses is one page: those of equal words are counted once.
    alike = streams.withColumn("content", F.xxhash64("undecided", "sizes", "tokens")).dropDuplicates(["host", "content"])
    dealt = alike.join(parts, "host").withColumn("part", F.pmod("key", "parts").cast("int"))

    def array_of(batch: pa.Table) -> tuple[list[list[np.ndarray]], np.ndarray]:
        out = []
        for sizes, tokens in zip(batch.column("sizes").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            out.append(np.split(np.array(tokens, np.int64).view(T.U), np.cumsum(sizes)[:-1]) if sizes else [])
        return out

    def array(key: tuple, table: pa.Table) -> pa.Table:
        value, count = repeated_runs(array_of(table), run)
        return pa.table({"host": pa.array([key[0].as_py()] * len(value), pa.string()), "gram": pa.array(T.longs(value)), "pages": pa.array(count, pa.int64())})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = [], []
            for key, blocks_, known in zip(batch.column("key").to_pylist(), array_of(batch), batch.column("grams").to_pylist(), strict=True):
                known = np.array(known or [], np.int64).view(T.U)
                found = []
                for i, b in enumerate(blocks_):
                    if len(b) >= run and len(known):
                        hit = np.flatnonzero(np.isin(_run_hashes(b, np.arange(len(b) - run + 1), run), known))
                        edge = np.zeros(len(b) + 1, np.int64)
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + run, -1)
                        if (np.cumsum(edge)[:-1] > 0).sum() >= covered * len(b):
                            found.append(i)
                keys.append(key)
                marks.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=["key", "marks"])

    counted = dealt.groupBy("host", "part").applyInArrow(array, "host string, gram long, pages long").groupBy("host", "gram").agg(
        F.sum("pages").alias("pages")).filter("pages > 1").select("host", "gram")
    # Runs that matter are those of the pages whose blocks nothing else decides.
    unsure = streams.filter("undecided")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, host_, page in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), array_of(batch), strict=True):
                grams = np.unique(np.concatenate([_run_hashes(b, np.arange(max(0, len(b) - run + 1)), run) for b in page] or [np.empty(0, T.U)]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.int64()), pa.array([host_] * len(grams), pa.string()), pa.array(T.longs(grams))], names=["key", "host", "gram"])

    held = unsure.mapInArrow(own, "key long, host string, gram long").join(counted, ["host", "gram"]).groupBy("key").agg(F.collect_list("gram").alias("grams"))
    marks = unsure.join(held, "key").select("key", "sizes", "tokens", "grams").mapInArrow(mark, "key long, marks array<int>")
    marks = store.put(marks.filter(F.size("marks") > 0), "marks")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, boiler in zip(batch.column("html"), batch.column("marks").to_pylist(), strict=True):
                found, any_main, at = _open(source.as_py())
                gone = {at[i] for i in boiler or []}
                out.append("\n".join(t for i, (t, dropped, main) in enumerate(found) if not dropped and i not in gone and (main or not any_main)))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    marked = keyed.join(marks, "key", "left") if not marks.isEmpty() else keyed.withColumn("marks", F.lit(None).cast("array<int>"))
    return marked.select("page_id", "url", "html", "marks").mapInArrow(text, "page_id long, url string, text string, n_chars long")
