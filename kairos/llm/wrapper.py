"""Main text of web pages through per-host wrappers.

A page is a stream of tags and text.  The streams of one host are aligned one
after another into a union-free regular expression, the host's wrapper: equal
neighbours fold into repeated groups, what only one side has becomes optional,
and text becomes slots with their mass over all pages.  Wrappers of parts of a
host align like pages, so a hot host is folded in every task, then in salted
groups, then once; nothing gathers its pages.  The finished wrapper ranks its slots,
and each page is read through its host's wrapper by the best slots that it has.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("ul ol dl table article section div td th body main aside nav footer header form".split())
NEVER = frozenset("head nav header footer aside form button select textarea noscript template svg iframe object "
                  "canvas audio video dialog menu script style".split())
#: Words in class, id or role of elements that hold no article text.
NOISE = re.compile(r"(?:^|[^a-z])(?:nav\w*|menu\w*|sidebar\w*|masthead|breadcrumbs?|footer\w*|header|cookies?\w*|"
                   r"consent|notices?|banners?|alert|ads?|advert\w*|sponsor\w*|promo\w*|shar(?:e|ing)\w*|social\w*|"
                   r"related\w*|comments?\w*|commentlist|respond|reply|replies|discussion|disqus\w*|popup|modal|"
                   r"newsletter|subscribe|widgets?|contentinfo|complementary|navigation|search)(?:$|[^a-z])")
MAIN = re.compile(r"(?:^|[^a-z])(?:article\w*|main|content|post|entry|story|body)(?:$|[^a-z])")

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: A sequence longer than this turns into one repeated group of optional parts.
LONGEST = 48
#: Elements nested deeper than this belong to the element at this depth, text and all.
DEEPEST = 150
SALT = 32
#: Pages of different content on which one text makes its slot template.
TEMPLATE_PAGES = 3
#: Wrappers of at most so many bytes in all are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _tag_end(page: str, pos: int) -> int:
    """Place after the tag whose name ends at ``pos``: a > outside quoted values, or beyond a quote that never closes."""
    while m := _STOP.search(page, pos):
        if not m[1]:
            return m.end()
        shut = page.find(m[1], m.end())
        pos = m.end() if shut < 0 else shut + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str | None, str]]:
    """(tag, attributes) for tags, closing ones with a leading /, and (None, text), in one forward pass.

    Comments, declarations, scripts, styles and a tag that the page's end cuts off are passed over; a < that
    begins nothing is text.  Nothing is read twice, so the time is linear in the page."""
    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at != pos:
            at = n if at < 0 else at
            yield None, page[pos:at]
            pos = at
        elif page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
        elif m := _OPEN.match(page, pos):
            end = _tag_end(page, m.end())
            if end < 0:
                return
            tag = m[2].lower()
            if not m[1] and tag in _RAW_END:
                shut = _RAW_END[tag].search(page, end)
                pos = shut.end() if shut else n
                continue
            yield m[1] + tag, page[m.end():end - 1]
            pos = end
        elif page.startswith(("<!", "<?", "</"), pos):
            end = page.find(">", pos)
            pos = n if end < 0 else end + 1
        else:
            yield None, "<"
            pos += 1


def _key(tag: str, attrs: str) -> str:
    named = sorted((m[1].lower(), re.sub(r"\d+", "0", (m[2] or m[3] or m[4] or "").lower()))
                   for m in _ATTR.finditer(attrs)) if attrs else ()
    return tag + "".join(f"[{k}={' '.join(v.split())}]" for k, v in named)


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


class Slot:
    """A part of a wrapper: key, whether it may be missing or repeat, its parts; if key is #, text mass, blocks,
    their text (a long one's digest) if it is one, and digests of up to TEMPLATE_PAGES different pages."""

    __slots__ = ("key", "opt", "many", "kids", "chars", "link", "pages", "fixed", "seen")

    def __init__(self, key, opt=False, many=False, kids=None, chars=0, link=0, pages=0, fixed=None, seen=None):
        self.key, self.opt, self.many, self.kids = key, opt, many, kids or []
        self.chars, self.link, self.pages, self.fixed, self.seen = chars, link, pages, fixed, seen or []

    def dump(self) -> list:
        return [self.key, int(self.opt), int(self.many), [k.dump() for k in self.kids], self.chars, self.link,
                self.pages, self.fixed, self.seen]

    @classmethod
    def load(cls, x: list) -> Slot:
        return cls(x[0], bool(x[1]), bool(x[2]), [cls.load(k) for k in x[3]], *x[4:])

    def pattern(self) -> str:
        """The wrapper as a regular expression."""
        inner = " ".join(k.pattern() for k in self.kids)
        text = inner if self.key == "()" else self.key if self.key == "#" else f"<{self.key}> {inner} </>"
        return f"({text}){'*' if self.opt and self.many else '+' if self.many else '?'}" \
            if self.opt or self.many or self.key == "()" else text


def read(page: str) -> tuple[Slot, list[tuple[str, str, int]]]:
    """The page's own wrapper and its text blocks (path, text, characters inside links), in page order."""
    root = Slot("page")
    stack: list[tuple[str, str, Slot]] = [("", "", root)]      # tag, path, slot of open block elements
    inline: Counter[str] = Counter()
    deep: Counter[str] = Counter()
    blocks: list[tuple[str, str, int]] = []
    slots: list[Slot] = []
    text: list[str] = []
    link = 0

    def flush():
        nonlocal link
        said = " ".join(htmllib.unescape("".join(text)).split())
        if said:
            path, own = stack[-1][1], min(link, len(said))
            blocks.append((path + "/#", said, own))
            slots.append(Slot("#", chars=len(said), link=own, pages=1,
                              fixed=said if len(said) <= 80 else _digest(said)))
            stack[-1][2].kids.append(slots[-1])
        text.clear()
        link = 0

    def close(tags, within=SCOPE):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return True
            if within and stack[i][0] in within:
                return False
        return False

    for tag, attrs in tokens(page):
        if tag is None:
            text.append(attrs)
            if inline["a"]:
                link += len(attrs)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if inline[tag]:
                inline[tag] -= 1
            elif tag == "body" or tag == "html":
                flush()
            elif deep[tag]:
                flush()
                deep[tag] -= 1
            else:
                close((tag,), None)
                if tag == "head":
                    inline.clear()
            continue
        if tag in ("html", "body"):
            flush()
            while len(stack) > 1 and stack[-1][0] == "head":
                stack.pop()
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
                close(("p",))
            continue
        if tag in INLINE and not (attrs and NOISE.search(_key("", attrs))):
            if not attrs.endswith("/"):
                inline[tag] += 1
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",))
            inline.clear()
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE - set(SIBLINGS[tag]))
        if len(stack) > DEEPEST:
            deep[tag] += 1
            continue
        key = _key(tag, attrs)
        slot = Slot(key)
        stack[-1][2].kids.append(slot)
        stack.append((tag, f"{stack[-1][1]}/{key}", slot))
    flush()
    whole = [_digest("\n".join(said for _, said, _ in blocks))]
    for slot in slots:
        slot.seen = whole
    fold(root)
    return root, blocks


def _merge(a: Slot, b: Slot) -> Slot:
    """One part that matches what both match."""
    if a.key == "#":
        return Slot("#", a.opt or b.opt, a.many or b.many, None, a.chars + b.chars, a.link + b.link,
                    a.pages + b.pages, a.fixed if a.fixed == b.fixed else None,
                    sorted({*a.seen, *b.seen})[:TEMPLATE_PAGES])
    return Slot(a.key, a.opt or b.opt, a.many or b.many, align(a.kids, b.kids))


def align(a: list[Slot], b: list[Slot]) -> list[Slot]:
    """Align two part sequences: common parts merge, a part of one side becomes optional."""
    if not a or not b:
        for s in a or b:
            s.opt = True
        return _fold(a or b)
    if [x.key for x in a] == [x.key for x in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            a[i].opt = True
            out.append(a[i])
            i += 1
        else:
            b[j].opt = True
            out.append(b[j])
            j += 1
    return _fold(out)


def _again(a: Slot, b: Slot) -> Slot:
    """Two neighbours of one key as a repeated part; it may be missing only if both may."""
    s = _merge(a, b)
    s.opt, s.many = a.opt and b.opt, True
    return s


def _fold(parts: list[Slot]) -> list[Slot]:
    """Resolve neighbouring squares (of one to three parts) into repeated groups."""
    for width in (1, 2, 3):
        out: list[Slot] = []
        for p in parts:
            out.append(p)
            if width == 1:
                if len(out) > 1 and out[-2].key == p.key:
                    out[-2:] = [_again(out[-2], p)]
                continue
            keys = [x.key for x in out[-width:]]
            if len(out) > width and out[-width - 1].key == "()" and [k.key for k in out[-width - 1].kids] == keys:
                out[-width - 1:] = [Slot("()", False, True, [_merge(x, y) for x, y in zip(out[-width - 1].kids,
                                                                                         out[-width:])])]
            elif len(out) >= 2 * width and [x.key for x in out[-2 * width:-width]] == keys and len(set(keys)) > 1:
                out[-2 * width:] = [Slot("()", False, True, [_merge(x, y) for x, y in zip(out[-2 * width:-width],
                                                                                        out[-width:])])]
        parts = out
    if len(parts) > LONGEST:       # (a? b? ...)* matches any order of the parts
        flat: dict[str, Slot] = {}
        for p in [q for p in parts for q in (p.kids if p.key == "()" else [p])]:
            flat[p.key] = _again(flat[p.key], p) if p.key in flat else p
        for p in flat.values():
            p.opt = True
        parts = [Slot("()", True, True, [flat[k] for k in sorted(flat)])]
    return parts


def fold(s: Slot) -> None:
    for k in s.kids:
        fold(k)
    s.kids = _fold(s.kids)


def _noise(key: str) -> bool:
    tag = re.match(r"[^\[]*", key)[0]
    return tag in NEVER or bool(NOISE.search(key[len(tag):])) if "[" in key or tag in NEVER else False


#: State of a slot: text, one text on many pages, mostly links.
TEXT, FIXED, LINKS = range(3)


def article_slots(root: Slot) -> list[str]:
    """The wrapper's text slots outside noise, each as a digit, 3 x rank + state, and its path.

    The rank is 3 below an article element, 2 below main, 1 below an element named
    like one, else 0.  A header inside an article belongs to it.  Outside article
    elements, slots made mostly of links are LINKS; outside main too, slots with one
    text on TEMPLATE_PAGES pages of different content are FIXED."""
    found: dict[str, int] = {}

    def walk(s: Slot, path: str, rank: int):
        for k in s.kids:
            if k.key == "()":
                walk(k, path, rank)
            elif k.key == "#":
                state = LINKS if rank < 3 and 2 * k.link > k.chars else \
                    FIXED if rank < 2 and k.fixed is not None and len(k.seen) >= TEMPLATE_PAGES else TEXT
                code = 3 * rank + state
                found[path + "/#"] = min(code, found.get(path + "/#", code))
            else:
                tag = re.match(r"[^\[]*", k.key)[0]
                if _noise(k.key) and not (tag == "header" and rank == 3 and "[" not in k.key):
                    continue
                own = 3 if tag == "article" else 2 if tag == "main" or "role=main" in k.key else \
                    1 if "[" in k.key and MAIN.search(k.key[len(tag):]) else 0
                walk(k, f"{path}/{k.key}", max(rank, own))

    walk(root, "", 0)
    return sorted(f"{code}{path}" for path, code in found.items())


def article_text(blocks: list[tuple[str, str, int]], slots: dict[str, int]) -> str:
    """Text of the page's blocks in its best slots: of the highest rank that the page itself has.

    FIXED slots neither count nor speak, unless the page has no other text."""
    mine = [(slots[path], said) for path, said, _ in blocks if path in slots]
    for silent in (FIXED, None):
        best = max((c // 3 for c, _ in mine if c % 3 != silent), default=-1)
        kept = [said for c, said in mine if c // 3 == best and c % 3 not in (silent, LINKS)]
        if kept:
            break
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null and odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
                              F.lit("")))


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Slot] = {}
    part = TaskContext.get().partitionId()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([part % SALT] * len(held), pa.int32()),
             pa.array([json.dumps(s.dump()) for s in held.values()], pa.string())], names=["host", "salt", "wrapper"])

    for b in batches:
        for host, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = read(_text(value))[0]
            held[host] = _merge(held[host], own) if host in held else own
        if len(held) >= 2000:
            yield out()
            held.clear()
    if held:
        yield out()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the wrappers of each host that this task holds."""
    held: dict[str, list] = {}
    for b in batches:
        for host, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            s = Slot.load(json.loads(w))
            held[host] = _merge(held[host], s) if host in held else s
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([0] * len(held), pa.int32()),
         pa.array([json.dumps(s.dump()) for s in held.values()], pa.string())], names=["host", "salt", "wrapper"])


_WRAPPER = "host string, salt int, wrapper string"


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, salt, wrapper): the wrapper of every host as JSON (see ``Slot.load``)."""
    configure(pages.sparkSession)
    lean = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("binary").alias("h"))
    parts = lean.mapInArrow(_infer, _WRAPPER)
    salted = parts.repartition("host", "salt").mapInArrow(_join, _WRAPPER)
    return salted.repartition("host").mapInArrow(_join, _WRAPPER)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots = [article_slots(Slot.load(json.loads(w))) for w in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.list_(pa.string()))], names=["host", "slots"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Blocks are trimmed, white space inside them is one space, character references
    are decoded, and blocks are joined in page order by a line feed.  Null html and
    pages without article text give an empty text; null and odd URLs share a host;
    null ids and repeated rows are kept as they are.
    """
    spark = pages.sparkSession
    configure(spark)
    rules = materialize(wrappers(pages, url_col, html_col).select("host", "wrapper")
                        .mapInArrow(_rules, "host string, slots array<string>")
                        .withColumnRenamed("host", "_host"))
    lean = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("binary").alias("h"), host_of(F.col(url_col)).alias("host"))
    size = rules.agg(F.sum(F.octet_length(F.to_json("slots")) + F.octet_length("_host"))).first()[0] or 0
    joined = lean.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, F.col("host") == F.col("_host"))
    kind = lean.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for value, slots in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                texts.append(article_text(read(_text(value))[1], {s[1:]: int(s[0]) for s in slots}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "h", "slots").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
