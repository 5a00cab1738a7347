"""HTML extraction by template deduction from equivalence classes of tokens.

1. Tokens. A page is read into elements and blocks of text. An element's token is its role: its path of tags and class names
   from the root (digits left out), with the number of each element among its like-named siblings. A word's token is its
   block's role, the word before it, the word, and the how-manieth of these it is in the block. So differentiated, a token
   stands once in a page or not at all, and its occurrence vector is the set of the host's pages that have it.
2. Classes. A vector is kept as its support and an order-free fingerprint (the exclusive-or of page hashes). Tokens of equal
   vectors are one equivalence class. Pages are dealt by host in chunks, a host of any size in as many as it needs; in a
   chunk a word that misses one page of its block is out at once (its vector can't be the block's), so only words that hold on
   through a chunk go on to the host's sums.
3. Template. A class is valid if it is nested and ordered: a word counts only in the class of the very block it stands in,
   and the word before it is part of its role. The words of a class that at least SUPPORT pages have (FIRM inside of article and
   main, where passages repeat by nature) are template; classes nest as their elements do. A host whose template words
   make up more than half of its text outside of the tags and names below isn't deduced from: its pages are copies.
   A kind of element (the path without numbers) outside of article and main whose text is links to four fifths over the
   host is a menu.
4. Extraction. What is left are the slots: blocks of which not every word is template, and that aren't in a menu.
   As a last filter, tags and names that say so rule out menus, headers, footers, sidebars, notices, adverts, forms and
   comments: a class or id does if all its parts are such words or neutral ones ("cookie-notice", not "related-work").

Defined results: null and empty pages give an empty text; pages without a URL share the host ''; text outside of any
element counts as a block; elements left open close with what surrounds them; a host with fewer than SUPPORT pages is read by
the last filter alone; repeated rows are each read and each count; extra columns don't matter; an empty table gives an
empty result. A page's text is whole, whatever its length.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SUPPORT, FIRM = 3, 8
#: Pages of a host that one chunk takes, on average; bytes of pages a worker has at hand, and pages of a host it needs there.
CHUNK, REACH, LOCAL = 1024, 16 << 20, 8
#: Share of links that makes a menu of a kind of element.
LINKS = 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe noembed noframes noscript".split())
_BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul caption button".split())
_OUT = frozenset("nav header footer aside form head title button select option menu dialog label input fieldset legend textarea".split())
#: Words of class, id and role that rule an element out, and words that may stand beside them.
_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead toolbar comment comments respond disqus newsletter subscribe subscription signup login pagination pager copyright complementary contentinfo".split())
_NEUTRAL = frozenset("site main top bottom left right box bar block wrap wrapper container list area thread form the global user reader post primary secondary".split())
#: What an opening tag closes, if it is the innermost block.
_CLOSES = {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"])}
_CLOSES_P = frozenset(["p"])
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")


class _Hashes(dict):
    """64-bit hashes of strings, the same in every worker."""

    def __missing__(self, said: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"), 3)
        if len(self) < 1_000_000:
            self[said] = h
        return h


def _says_out(names: list[tuple[str, str]]) -> bool:
    for _, value in names:
        for name in value.split():
            parts = _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            if any(p in _OUT_WORDS for p in parts) and all(p in _OUT_WORDS or p in _NEUTRAL for p in parts):
                return True
    return False


class _Element:
    __slots__ = ("tag", "role", "kind", "out", "inside", "block", "children", "texts")

    def __init__(self, tag: str, role: int, kind: int, out: bool, inside: bool, block: bool) -> None:
        self.tag, self.role, self.kind, self.out, self.inside, self.block = tag, role, kind, out, inside, block
        self.children: dict[str, int] = {}
        self.texts = 0


class Block:
    """A block of text: role (with numbers), kind (without), ruled out by tags and names, inside of article or main, characters in links."""

    __slots__ = ("role", "kind", "out", "inside", "link", "text")

    def __init__(self, at: _Element, link: int, text: str) -> None:
        at.texts += 1
        self.role, self.kind, self.out, self.inside, self.link, self.text = (at.role + at.texts * 0x9E3779B97F4A7C15) & (2**64 - 1), at.kind, at.out, at.inside, link, text


def blocks(page: str, known: _Hashes) -> list[Block]:
    """Blocks in page order."""
    done: list[Block] = []
    root = _Element("", 1, 1, False, False, True)
    stack = [root]
    text: list[str] = []
    link = links = 0  # open links, and characters in them since the last block

    def flush() -> None:
        nonlocal links
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            done.append(Block(next(x for x in reversed(stack) if x.block), min(links, len(joined)), joined))
        text.clear()
        links = 0

    def shut(at: int) -> None:
        nonlocal link
        if any(x.block for x in stack[at:]):
            flush()
        link -= sum(x.tag == "a" for x in stack[at:])
        del stack[at:]

    at = 0
    search = _TOKEN.search
    while at < len(page):
        m = search(page, at)
        said = page[at : m.start()] if m else page[at:]
        if m and m[1] is not None:
            said += m[1]
        if said:
            piece = entities.unescape(said) if "&" in said else said
            text.append(piece)
            if link:
                links += len(piece.strip())
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    shut(i)
                    break
                if tag not in _BLOCKS and stack[i].block:
                    break
            continue
        if tag in _RAW:
            if not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        block = tag in _BLOCKS
        if block:
            closes = _CLOSES.get(tag, _CLOSES_P)
            while True:
                i = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].block)
                if not i or stack[i].tag not in closes:
                    break
                shut(i)
            flush()
        up = stack[-1]
        out, label = up.out, ""
        if m[4] and m[4].strip():
            names = [(a.lower(), x or y or z) for a, x, y, z in _NAMES.findall(m[4])]
            label = ".".join(sorted(_DIGITS.sub("", v) for a, v in names if a == "class"))
            if not out and tag not in ("html", "body", "article", "main"):
                out = bool(names) and _says_out(names)
            out = out or bool(_HIDDEN.search(m[4]))
        if tag in _OUT and not (tag == "header" and up.inside):
            out = True
        if block:
            name = f"{tag}.{label}" if label else tag
            number = up.children[name] = up.children.get(name, 0) + 1
            x = _Element(tag, known[f"{up.role}>{name}#{number}"], known[f"{up.kind}>{name}"], out, up.inside or tag in ("article", "main"), True)
        else:
            x = _Element(tag, up.role, up.kind, out, up.inside, False)
            x.children = up.children  # an inline element lends its block's roles to what is in it
            link += tag == "a"
        stack.append(x)
    flush()
    return done


_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9E3779B97F4A7C15], np.uint64)


def word_tokens(block: Block, known: _Hashes) -> np.ndarray:
    """Tokens of a block's words, in order."""
    words = block.text.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    x = h * _STEPS[0] + np.uint64(block.role)
    x[1:] += (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _STEPS[1]
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        x[order] += (np.arange(len(x)) - first).astype(np.uint64) * _STEPS[2]
    x ^= x >> np.uint64(32)
    return (x * _STEPS[1]).view(np.int64)


class _Chunk:
    """Sums over some pages of a host."""

    def __init__(self, host: str | None) -> None:
        self.host = host
        self.roles: dict[int, list] = {}  # support, vector, outside of the last filter, inside of article or main, characters, words that every page had, words
        self.kinds: dict[int, list] = {}  # pages, characters, in links, inside
        self.pages = 0

    def add(self, uid: int, found: list[Block], known: _Hashes) -> None:
        self.pages += 1
        seen = set()
        for b in found:
            kind = self.kinds.setdefault(b.kind, [0, 0, 0, b.inside])
            kind[0] += b.kind not in seen
            seen.add(b.kind)
            kind[1] += len(b.text)
            kind[2] += b.link
            row = self.roles.get(b.role)
            if row is None:
                tokens = word_tokens(b, known)
                self.roles[b.role] = [1, uid, not b.out, b.inside, len(b.text), np.sort(tokens), len(tokens)]
                continue
            row[0] += 1
            row[1] ^= uid
            row[4] += len(b.text)
            if len(row[5]):
                tokens = word_tokens(b, known)
                row[5] = np.intersect1d(row[5], tokens, assume_unique=True)
                row[6] += len(tokens)


_COUNTED = "host string, what int, role long, token long, support long, vector long, free boolean, inside boolean, chars long, link long, html string"
#: Kinds of rows: pages of a chunk, blocks, their words, kinds of elements; pages whose host has few in a worker's reach.
PAGES, ROLE, WORD, KIND, LONE = range(5)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rows(rows: list[tuple]):
    schema = pa.schema([("host", pa.string()), ("what", pa.int32()), *[(n, pa.int64()) for n in ("role", "token", "support", "vector")], ("free", pa.bool_()), ("inside", pa.bool_()), ("chars", pa.int64()), ("link", pa.int64()), ("html", pa.string())])
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)


def _sums_of(chunk: _Chunk):
    rows = [(chunk.host, PAGES, 0, 0, chunk.pages, 0, True, False, 0, 0, None)]
    for role, (support, vector, free, inside, chars, tokens, n_words) in chunk.roles.items():
        own = _signed(role)
        rows.append((chunk.host, ROLE, own, 0, support, vector, free, inside, chars, 0, None))
        rows += [(chunk.host, WORD, own, t, support, vector, free, inside, chars * support // n_words, 0, None) for t in tokens.tolist()]
    rows += [(chunk.host, KIND, _signed(k), 0, n, 0, True, inside, chars, link, None) for k, (n, chars, link, inside) in chunk.kinds.items()]
    yield from _rows(rows)


def _locally(batches):
    """(host, uid, html): sums of each host that has LOCAL pages or more among those at hand, and the pages of the others."""
    known, at_hand, held = _Hashes(), {}, 0

    def done():
        for host, pages in at_hand.items():
            if len(pages) < LOCAL:
                yield from _rows([(host, LONE, 0, uid, 0, 0, None, None, 0, 0, page) for uid, page in pages])
                continue
            chunk = _Chunk(host)
            for uid, page in pages:
                chunk.add(uid, blocks((page or b"").decode("utf-8", "replace"), known), known)
            yield from _sums_of(chunk)

    for batch in batches:
        for host, uid, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), strict=True):
            at_hand.setdefault(host, []).append((uid, page))
            held += len(page or b"")
            if held >= REACH:
                yield from done()
                at_hand, held = {}, 0
    yield from done()


def _dealt(batches):
    """(host, salt, uid, html), sorted by the first two: each chunk's sums."""
    known, chunk, key = _Hashes(), None, None
    for batch in batches:
        for host, salt, uid, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), common.as_bytes(batch.column(3)), strict=True):
            if (host, salt) != key:
                if chunk is not None:
                    yield from _sums_of(chunk)
                chunk, key = _Chunk(host), (host, salt)
            chunk.add(uid, blocks((page or b"").decode("utf-8", "replace"), known), known)
    if chunk is not None:
        yield from _sums_of(chunk)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, roles and words (tokens of the template's blocks), menus (kinds of elements): a row for each host that has any.

    A host's row is no longer than the shortest of SUPPORT of its pages.
    """
    spark = pages.sparkSession
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("uid"), F.col("html").cast("string").alias("html"))
    first = common.stored(rows.mapInArrow(_locally, _COUNTED), "page-tokens")
    lone = first.where(F.col("what") == LONE).select("host", F.col("token").alias("uid"), "html")
    sizes = pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.ceil(F.count("*") / CHUNK).alias("salts"), F.count("*").alias("n")).where(f"n >= {SUPPORT}").select("host", "salts")
    dealt = lone.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64(F.lit(2), F.col("uid")), F.col("salts")).cast("int")).select("host", "salt", "uid", "html")
    rest = common.stored(dealt.repartition(common.partitions(spark, pages), "host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_dealt, _COUNTED).drop("html"), "page-tokens")
    counted = first.where(F.col("what") != LONE).drop("html").unionByName(rest)
    summed = counted.groupBy("host", "what", "role", "token").agg(F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"), F.max("free").alias("free"), F.max("inside").alias("inside"), F.sum("chars").alias("chars"), F.sum("link").alias("link"))
    of = lambda what: summed.where(F.col("what") == what)
    classes = of(ROLE).where(F.col("support") >= F.when(F.col("inside"), FIRM).otherwise(SUPPORT)).select("host", "role", F.col("support").alias("n"), F.col("vector").alias("v"))
    # A word is in its block's class if it has the block's vector: the same pages.
    words = of(WORD).join(classes, ["host", "role"]).where("support = n and vector = v")
    fixed = words.groupBy("host").agg(F.collect_list("token").alias("words"), F.collect_set("role").alias("roles"), F.sum(F.when(F.col("free"), F.col("chars")).otherwise(0)).alias("held"))
    text = of(ROLE).groupBy("host").agg(F.sum(F.when(F.col("free"), F.col("chars")).otherwise(0)).alias("all"))
    empty = F.array().cast("array<bigint>")
    kept = fixed.join(text, "host").where("2 * held <= all").select("host", "words", "roles")
    menus = of(KIND).where(f"not inside and support >= {SUPPORT} and link >= {LINKS} * chars").groupBy("host").agg(F.collect_list("role").alias("menus"))
    return kept.join(menus, "host", "full").select("host", F.coalesce("roles", empty).alias("roles"), F.coalesce("words", empty).alias("words"), F.coalesce("menus", empty).alias("menus"))


def extract(page: str, known: _Hashes | None = None, roles: frozenset = frozenset(), words: frozenset = frozenset(), menus: frozenset = frozenset()) -> str:
    """The main text of a page: its slots in the host's template, less what the last filter rules out."""
    known = known or _Hashes()
    out = []
    for b in blocks(page, known):
        if b.out or (not b.inside and _signed(b.kind) in menus):
            continue
        if _signed(b.role) in roles and words.issuperset(word_tokens(b, known).tolist()):
            continue
        out.append(b.text)
    return "\n\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """The operator: page_id, url, text of every page."""
    found = common.stored(templates(pages), "templates").withColumnRenamed("host", "_host")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    # A row a host: adaptive execution broadcasts it below the session's limit and otherwise joins by host, splitting hot ones.
    joined = rows.join(found, rows.host == found._host, "left").select("page_id", "url", "html", "_host", "roles", "words", "menus")

    def each(s, page_id, url, page, host, roles, words, menus) -> tuple:
        if host not in s[1]:
            if len(s[1]) > 256:
                s[1].clear()
            s[1][host] = [frozenset(x or ()) for x in (roles, words, menus)]
        return page_id, url.decode("utf-8", "replace") if url is not None else None, extract((page or b"").decode("utf-8", "replace"), s[0], *s[1][host])

    return common.map_rows(joined, "page_id long, url string, text string", each, lambda: (_Hashes(), {}))
