"""Main text of web pages by host-wide repeated substrings and markup.

A page is cut into blocks, each in a zone: inside an article or main element,
inside markup that is boilerplate by its element or class, or neither. The
word streams of a host's pages outside boilerplate markup are concatenated and
put into a suffix array; suffixes that share their first ``DEPTH`` words with
one of another page cover those words as repeated. What repeats is
boilerplate, unique runs stay: a block outside article and boilerplate markup
goes if at least ``COVERED`` of its words are covered, on every page, whether
it also has an article or not. Blocks inside the article stay whether they
repeat or not (a text or a line of it may be printed on two pages), and
boilerplate markup goes even where it is unique.

A class is a hint, not a fact. Words of a state ("share-enabled", "has-sidebar")
and containers that name themselves content ("post-content") are no hints; an
article's own header belongs to it; a paragraph of an article under a class
of the layout ("related") is put to the vote: long prose without links counts
as a plain block, which the array decides, all else goes. A form around an
article, or around all prose of a page, is a wrapper and no form.

A host's pages are dealt into shards of bounded size, so a host with a third
of all pages is many tasks. Repeats between shards are found first, by the
hash of the first ``DEPTH`` words of every suffix with map-side combine, and
handed to the host's shards: the shards cover exactly what one suffix array
of the host would.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common

#: Words of the shortest repeated substring; a power of two.
DEPTH = 8
#: Share of a block's words that must be repeated for it to go.
COVERED = 0.5
#: What stands between the blocks of a page.
SEPARATOR = "\n\n"
#: Elements nested deeper belong to their ancestors, as in browsers.
DEEPEST = 512
#: Characters of HTML in one shard.
SHARD_CHARS = 8 << 20

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr
ul""".split())
DROP_TAGS = frozenset("""applet aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map
menu nav noscript object option script select style svg template textarea title video""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
#: An open element of the key ends where one of these starts, inside the nearest of the second set.
_LISTS = frozenset("ul ol menu dl table body article div section".split())
_CLOSED_BY = {"p": BLOCK_TAGS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}}
_COMMENT_HINT = r"comments?|commentlist|reply|replies|respond|discussion|disqus"
_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|" + _COMMENT_HINT + r"""|consent|cookies?|
footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notifications?|alerts?|overlay|pager|pagination|
popup|promos?|promotions?|recommended|recommendations|related|search|share|sharing|sidebar|signup|skip|social|sponsors?|sponsored|
subscribe|subscription|teasers?|toolbar|widgets?)(?:[\s_-]|$)""".replace("\n", ""))
#: Hints that name a place in the layout; on a paragraph of an article they are not enough.
_LAYOUT = frozenset("""breadcrumb breadcrumbs footer header menu modal nav navbar navigation overlay pager pagination popup
recommended recommendations related search share sharing sidebar skip social toolbar widget widgets""".split())
_CONTENT = re.compile(r"(?i)(?:article|entry|main|page|post|story)[_-]?(?:body|content|text)")
_STATE = re.compile(r"(?i)(?:has|is|no|not|with|without)[_-].*|.*[_-](?:enabled|disabled|on|off|open|closed|visible|active)")
_TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6".split())
#: Words of prose: a block put to the vote has as many, and a form that is a wrapper holds such a block.
PROSE = 2 * DEPTH
_COMMENTS = re.compile(r"(?i)(?:^|[\s_-])(?:" + _COMMENT_HINT + r")(?:[\s_-]|$)")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_ARTICLE, _FORM_END = re.compile(r"(?i)<(?:article|main)\b"), re.compile(r"(?i)</form\b")
VOTE, MAIN, PLAIN, DROP = 3, 2, 1, 0


def _hints(value: str, hint: re.Pattern, in_main: bool) -> set[str]:
    """Hint words of a class or id attribute, in lower case."""
    names = value.split()
    if any(_CONTENT.fullmatch(x) for x in names):
        return set()
    words = {m[0].strip("_- \t\r\n\f").lower() for x in names if not _STATE.fullmatch(x) for m in _each(hint, x)}
    return words - {"header"} if in_main else words


def _each(hint: re.Pattern, name: str):
    """Matches of ``hint`` that may share the dash between them."""
    m = hint.search(name)
    while m:
        yield m
        m = hint.search(name, max(m.end() - 1, m.start() + 1))


def _zone(tag: str, attrs: str, zone: int, in_main: bool) -> int:
    """Zone of an element inside an element of ``zone``."""
    if zone == DROP or tag in DROP_TAGS or (tag == "header" and not in_main):
        return DROP
    now = MAIN if tag in ("article", "main") else zone
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                hint = _COMMENTS if tag in ("article", "main") else _HINT
                found = _hints(value, hint, in_main)
                if found and in_main and tag in _TEXT_TAGS and found <= _LAYOUT:
                    now = VOTE
                elif found:
                    return DROP
            elif name == "role":
                if value.lower() in _ROLES:
                    return DROP
                now = MAIN if value.lower() in ("main", "article") else now
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                    name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                return DROP
    return now


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every block of a page that holds text, in page order.
    Broken markup is read as far as it goes; elements left open end with their parents."""
    out, forms = _walk(page, False)
    if not out and forms:
        inside, _ = _walk(page, True)
        if any(len(t.split()) >= PROSE for _, t in inside):
            return inside
    return out


def _walk(page: str, open_forms: bool) -> tuple[list[tuple[int, str]], bool]:
    """Blocks of a page, and whether a form was left out; ``open_forms`` reads forms as plain containers."""
    out: list[tuple[int, str]] = []
    forms, linked, marks = False, False, None
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    i, n, no_more = 0, len(page), {}
    low = None

    def flush():
        nonlocal linked
        if held:
            text, zone = " ".join(entities.unescape("".join(held)).split()), stack[-1][1]
            if zone == VOTE:
                zone = DROP if linked or len(text.split()) < PROSE else PLAIN
            if text and zone != DROP:
                out.append((zone, text))
            held.clear()
        linked = False

    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i and stack[-1][1] != DROP:
            held.append(page[i:j])
        if j == n:
            break
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        m = _NAME.match(page, j + 1)
        if not m:
            if page[j + 1:j + 2] in ("!", "?", "/"):
                k = page.find(">", j)
                i = n if k < 0 else k + 1
            else:
                if stack[-1][1] != DROP:
                    held.append("<")
                i = j + 1
            continue
        k = page.find(">", m.end())
        if k < 0:
            break  # cut off inside a tag
        attrs = page[m.end():k]
        for q in "\"'":
            if attrs.count(q) % 2 and q not in no_more:  # a > inside a quoted value
                e = page.find(q, k)
                if e < 0:
                    no_more[q] = True
                else:
                    g = page.find(">", e)
                    if g > 0 and "<" not in page[k:e]:
                        k, attrs = g, page[m.end():g]
                break
        tag, i = m[1].lower(), k + 1
        if page[j + 1] == "/":
            if tag in BLOCK_TAGS:
                flush()
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == tag:
                    if stack[d][1] != stack[d - 1][1]:
                        flush()
                    del stack[d:]
                    break
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCK_TAGS:
            flush()
        elif tag in ("td", "th"):
            held.append(" ")
        for name, closers in _CLOSED_BY.items():
            if tag in closers:
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d][0] == name:
                        flush()
                        del stack[d:]
                        break
                    if stack[d][0] in _LISTS:
                        break
        if tag in VOID_TAGS or attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        kind = tag
        if tag == "form":
            if marks is None:
                marks = [[m.start() for m in x.finditer(page)] + [n] for x in (_ARTICLE, _FORM_END)]
            inner, end = (x[bisect_left(x, i)] for x in marks)
            if open_forms or inner < end:
                kind = "div"  # a wrapper around the page's text
            forms = forms or kind == "form"
        linked = linked or tag == "a"
        zone = _zone(kind, attrs, stack[-1][1], any(z == MAIN for _, z in stack))
        if tag in RAW_TAGS:  # its content is no markup
            if low is None:
                low = page.lower()
            k = low.find("</" + tag, i)
            i = n if k < 0 else low.find(">", k) + 1 or n
            continue
        if zone != stack[-1][1]:
            flush()
        if len(stack) < DEEPEST:
            stack.append((tag, zone))
    flush()
    return out, forms


def host_of(url):
    """Host of a URL column: lower case, without user, port and leading www."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def _streams(blocks):
    """Words of the blocks that the suffix array sees: all outside boilerplate markup."""
    return [t.lower().split() for _, t in blocks]


def _window_keys(words: list[str]) -> np.ndarray:
    """Hash of the first DEPTH words of every suffix that has as many."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    size = 1
    with np.errstate(over="ignore"):
        while size < DEPTH and len(h) > size:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) ^ (h[size:] + np.uint64(size))
            h ^= h >> np.uint64(31)
            size *= 2
    return h if size == DEPTH else h[:0]


def repeated_words(streams: list[list[str]], keys: np.ndarray) -> list[np.ndarray]:
    """For each page's word stream which words lie in a run of DEPTH words
    that another stream holds too, or whose hash is in the sorted ``keys``."""
    lengths = [len(s) for s in streams]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for s in streams for w in s], np.int64)
    page = np.repeat(np.arange(len(streams)), lengths)
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= DEPTH:
        ends = np.repeat(np.cumsum(lengths), lengths)
        rank, size = ids, 1
        while size < DEPTH:  # prefix doubling: ranks of all suffixes by their first 2, 4, ... words
            follow = np.full(n, -1, np.int64)
            follow[:n - size] = rank[size:]
            rank = np.unique(rank * (n + 1) + follow + 1, return_inverse=True)[1]
            size *= 2
        whole = np.flatnonzero(np.arange(n) + DEPTH <= ends)
        suffixes = whole[np.argsort(rank[whole], kind="stable")]  # the suffix array down to DEPTH words
        first = np.flatnonzero(np.concatenate([[True], rank[suffixes][1:] != rank[suffixes][:-1]])) if len(suffixes) else whole
        if len(suffixes):
            low, high = (f.reduceat(page[suffixes], first) for f in (np.minimum, np.maximum))
            hit = suffixes[np.repeat(low != high, np.diff(np.append(first, len(suffixes))))]
            covered[hit] += 1
            np.subtract.at(covered, hit + DEPTH, 1)
        if len(keys):
            at = 0
            for s in streams:
                own = _window_keys(s)
                near = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = at + np.flatnonzero(keys[near] == own)
                np.add.at(covered, hit, 1)
                np.subtract.at(covered, hit + DEPTH, 1)
                at += len(s)
    return np.split(np.cumsum(covered[:-1]) > 0, np.cumsum(lengths)[:-1]) if lengths else []


def main_text(blocks: list[tuple[int, str]], repeated: np.ndarray, separator: str = SEPARATOR) -> str:
    """Blocks that stay, joined by ``separator``; ``repeated`` marks the words of the page's stream."""
    kept, at = [], 0
    for (zone, text), words in zip(blocks, _streams(blocks)):
        mark = repeated[at:at + len(words)]
        at += len(words)
        if zone == MAIN or mark.sum() < COVERED * max(1, len(words)):
            kept.append(text)
    return separator.join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            shard_chars: int = SHARD_CHARS, separator: str = SEPARATOR) -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    Null and empty pages give the empty text. Pages without a URL or with one
    that names no host count as one host. Rows that repeat everything are one
    page printed twice: each is answered, and they do not make each other
    boilerplate. Other columns are not read; an empty table gives no rows."""
    common.prepare(pages.sparkSession)
    page = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), host_of(F.col(url_col)).alias("host"),
                        page.alias("t"), F.xxhash64(F.col(id_col), F.col(url_col), page).alias("key"))

    def plain(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([any(z == PLAIN for z, _ in blocks_of(t)) for t in texts], pa.bool_())],
                                             names=["host", "n", "plain"])

    # Only hosts with a plain block have anything for their repeats to decide.
    sizes = (rows.select("host", "t").mapInArrow(plain, "host string, n long, plain boolean").groupBy("host")
             .agg(F.ceil(F.sum("n") / shard_chars).cast("int").alias("shards"), F.max("plain").alias("plain"))
             .select("host", F.greatest("shards", F.lit(1)).alias("shards"), "plain"))
    sizes = common.written(sizes, "page-hosts")
    dealt = rows.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))

    def windows(batches):
        for b in batches:
            hosts, shards, keys, asks = [], [], [], []
            for h, s, t in zip(*(b.column(c).to_pylist() for c in ("host", "shard", "t"))):
                blocks = blocks_of(t)
                words = _streams(blocks)
                k, at = np.unique(_window_keys([w for x in words for w in x]), return_inverse=True)
                zones = np.repeat(np.array([z == PLAIN for z, _ in blocks], bool), np.array([len(x) for x in words], int))
                seen = np.concatenate([[0], np.cumsum(zones)])
                ask = np.zeros(len(k), bool)
                ask[at[seen[DEPTH:] > seen[:-DEPTH]]] = True  # the window touches a plain block
                k = k.view(np.int64)
                hosts += [h] * len(k)
                shards += [s] * len(k)
                keys.append(k)
                asks.append(ask)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(shards, pa.int32()),
                 pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)),
                 pa.array(np.concatenate(asks) if asks else np.zeros(0, bool))], names=["host", "shard", "k", "ask"])

    across = (dealt.where("shards > 1 and plain").select("host", "shard", "t").mapInArrow(windows, "host string, shard int, k long, ask boolean")
              .groupBy("host", "k").agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.max("ask").alias("ask"))
              .where("a < b and ask")
              .join(sizes, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "k"))

    def parsed(batches):
        for b in batches:
            blobs = [pa.compress(json.dumps(blocks_of(t), ensure_ascii=False).encode(), codec="zstd", asbytes=True)
                     for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("i", "u", "host", "shard", "key")] + [pa.array(blobs, pa.binary())],
                                             names=["i", "u", "host", "shard", "key", "blob"])

    ready = (dealt.select("i", "u", "host", "shard", "key", "t")
             .mapInArrow(parsed, "i long, u string, host string, shard int, key long, blob binary"))
    out = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def finish(shard: pa.Table, keys: pa.Table) -> pa.Table:
        pages_ = [json.loads(_inflate(x.as_py())) for x in shard["blob"]]
        if any(z == PLAIN for b in pages_ for z, _ in b):
            streams = [[w for x in _streams(b) for w in x] for b in pages_]
        else:
            streams = [[] for _ in pages_]  # article blocks stay whatever repeats
        own = shard["key"].to_numpy()
        _, first, which = np.unique(own, return_index=True, return_inverse=True)  # equal rows are one page
        marks = repeated_words([streams[k] for k in first], np.unique(keys["k"].to_numpy()).view(np.uint64))
        texts = [main_text(b, marks[w], separator) for b, w in zip(pages_, which)]
        return pa.table([shard["i"], shard["u"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                        schema=out)

    return (ready.groupBy("host", "shard").cogroup(across.groupBy("host", "shard"))
            .applyInArrow(finish, f"`{id_col}` long, `{url_col}` string, text string, n_chars long"))


def _inflate(blob: bytes) -> bytes:
    return pa.input_stream(pa.BufferReader(blob), compression="zstd").read()


@common.query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
