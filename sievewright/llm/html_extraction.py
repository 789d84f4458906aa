"""Main text of web pages by union-free regular expressions inferred per host.

A page becomes a stream of block tags and text slots, and runs of equal groups of tokens, of any length,
become repeated groups. Pages of one host that have the same form are counted together where they lie;
the distinct forms of a host are then aligned, some at a time and their results again, so that all pages
take part and no task holds a host: what only one side has becomes an optional group. A text block with its tags is
aligned as one token, and where optional blocks recur side by side they become one repeated group of
optional blocks, so that articles of freely ordered blocks give a short wrapper. The result, the
host's wrapper, is a sequence of tokens, slots, optional and repeated groups without alternatives, and
every page that took part in it fits it.

Each slot knows whether its text is the same on all pages that have it, on ``DISTINCT`` pages of different
content at least: then it is template. Each slot gets a role from its place and from what varies: inside
the article and outside menus, adverts, forms, comments and the like it is content, unless it is template
and no heading. Without an article element, content is the element whose varying slots hold the most text
on all the host's pages. A page is read along its host's wrapper; one that does not fit, or whose host has
no wrapper, is read by its own tokens' places.

Alignment takes common ends and tokens that occur once on either side as anchors, and compares what lies
between in full only where that is short; so pages of any length take time in proportion.

Defined cases: a null or empty html gives an empty text; a null or hostless url belongs to the host ``''``;
unclosed and stray tags are tolerated; rows that repeat give the same text each and count as one content;
only the columns named are returned, so others cannot clash.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, table, written

#: Pages of different content on which a text must be the same to be template.
DISTINCT = 3
#: Forms of a host that one task aligns.
FAN = 64
#: Cells of the table that compares what lies between anchors.
CELLS = 40_000
#: Hosts with this share of the pages have their wrappers broadcast, if these are short.
HOT_SHARE, SHORT = 1e-3, 1 << 16
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe|xmp|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out; their end tags carry nothing.
OPEN = set("p li dt dd tr td th option thead tbody tfoot colgroup".split())
#: Text blocks whose end tags must be there.
CLOSED = set("h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption ul ol dl table caption address".split())
#: What is part of a text, lists and quotes included, and no box around it.
TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption ul ol li dl dt dd caption address".split())
ASIDE = set("nav footer aside form button select dialog menu head object canvas audio video map fieldset".split())
#: Words of a class or id that say an element is no part of the article.
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay share sharing social "
    "related recommended comment comments commentlist disqus replies reply respond widget toolbar pagination pager skip copyright legal search banner".split()
)
#: Words beside those that say the name is of a frame around the page, not of a part of it.
FRAMES = set("has with no without layout page wrapper container main content site".split())
ROLES = set("navigation banner contentinfo complementary search alert dialog menu menubar".split())
BOXES = {"div", "section"}
ARTICLE = {"article", "main"}
WHOLE = {"html", "body", "main"}
HEADING = re.compile(r"<h[1-6]\b")


def stream(html: str) -> list[tuple[str, str]]:
    """(token, text) pairs: block tags as ``<name>``, ``<name!>`` if set aside, boxes with a label, ``</name>``; texts as ``#``."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    at = 0

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(("#", text))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        elif name not in INLINE:
            flush()
            if m.group(2):
                if name not in OPEN and name not in VOID:
                    out.append((f"</{name}>", ""))
            elif name not in VOID:
                aside = name in ASIDE or name not in WHOLE and off(m.group(4))
                out.append((f"<{name}{'!' if aside else ''}{label(m.group(4)) if name in BOXES else ''}>", ""))
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


@lru_cache(4096)
def label(attributes: str) -> str:
    """The first word of an element's class, else its id, numbers as 0: it tells boxes apart, whatever it means."""
    found = {n.lower(): v.strip("\"'").split() for n, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    words = found.get("class") or found.get("id")
    return " " + re.sub(r"[0-9]+", "0", words[0]) if words else ""


@lru_cache(4096)
def off(attributes: str) -> bool:
    """Whether an element's attributes name something beside the article, or hide it."""
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        words = set(re.split(r"[^a-z]+", value)) if name in ("class", "id") else set()
        if NAMES & words and not FRAMES & words:
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


# A wrapper is a list of nodes: ["t", tag], ["?", nodes], ["+", nodes], ["=", nodes] for a whole block, and slots
# ["#", hash of the text or None if it varies, characters in all, up to DISTINCT hashes of pages' contents].


def key(node: list) -> str:
    """The form of a node, whatever its slots hold."""
    if node[0] == "t":
        return node[1]
    return "#" if node[0] == "#" else f"{node[0]}({' '.join(map(key, node[1]))})"


def merge(a: list, b: list) -> list:
    """Two nodes of one form as one."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] + b[2], sorted({*a[3], *b[3]})[:DISTINCT]]
    return a if a[0] == "t" else [a[0], [merge(x, y) for x, y in zip(a[1], b[1])]]


def joined(groups: list[list]) -> list:
    out = groups[0]
    for g in groups[1:]:
        out = [merge(x, y) for x, y in zip(out, g)]
    return out


def blocks(nodes: list) -> list:
    """Text blocks as one node each, tags included, so that alignment never parts a block's tags.

    A block holds slots and blocks alone; a tag whose end may be left out takes the slot that follows it.
    """
    out: list = []
    starts: list[tuple[int, str]] = []  # blocks that are open, with nothing but blocks in them so far
    for x in nodes:
        name = re.split("[ !>]", x[1].lstrip("</"), maxsplit=1)[0] if x[0] == "t" else ""
        if x[0] == "#" and out and out[-1][0] == "t" and re.split("[ !>]", out[-1][1][1:], maxsplit=1)[0] in OPEN:
            out[-1] = ["=", [out[-1], x]]
            continue
        out.append(x)
        if name in CLOSED and x[1][1] != "/":
            starts.append((len(out) - 1, name))
        elif name in CLOSED and starts and starts[-1][1] == name:
            at, _ = starts.pop()
            out[at:] = [["=", fold(out[at:])]]
        elif name and name not in OPEN:
            starts.clear()
    return out


def kinds(node: list) -> list[list] | None:
    """The blocks that optional and repeated groups are made of; None if they hold anything else."""
    if node[0] == "=":
        return [node]
    if node[0] not in "?+":
        return None
    parts = [kinds(x) for x in node[1]]
    return None if None in parts else [y for x in parts for y in x]


def loosened(nodes: list) -> list:
    """Neighbouring optional groups of blocks, where a block recurs, as one repeated group of each of their blocks:
    any of these, any number of times. So a wrapper's length depends on the kinds of blocks, not on the pages."""
    out: list = []
    run: list[list] = []

    def close():
        found = [y for x in run for y in kinds(x)]
        own: dict[str, list] = {}
        for y in found:
            own[key(y)] = merge(own[key(y)], y) if key(y) in own else y
        out.extend([["?", [["+", [["?", [own[k]]] for k in sorted(own)]]]]] if len(own) < len(found) else run)
        run.clear()

    for x in nodes:
        if x[0] == "?" and kinds(x):
            run.append(x)
            continue
        close()
        out.append([x[0], loosened(x[1])] if x[0] in "?+" and not kinds(x) else x)
    close()
    return out


def fold(nodes: list) -> list:
    """Runs of an equal group of nodes as one repeated group, shortest groups first, twice over.

    A period is the distance between an element and one of its next occurrences, so only these are tried.
    """
    for _ in range(2):
        keys, before = [key(x) for x in nodes], len(nodes)
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, before)
        seen: dict[str, list[int]] = {}
        sizes = set()
        for i, k in enumerate(keys):
            places = seen.setdefault(k, [])
            sizes.update(i - j for j in places[-3:])
            places.append(i)
        for size in sorted(sizes):
            out, names, i, run = [], [], 0, 0
            n = len(nodes)
            if 2 * size > n:
                break
            if not repeats(ids, size):
                continue
            while i < n:
                run = 0
                while i + run + size < n and keys[i + run] == keys[i + run + size]:
                    run += 1
                times = run // size + 1
                if times > 1:
                    group = joined([nodes[i + k * size : i + (k + 1) * size] for k in range(times)])
                    # a repeated or optional group that repeats is itself
                    out.append(group[0] if size == 1 and group[0][0] in "+?" else ["+", group])
                    names.append(key(out[-1]))
                    i += times * size
                else:
                    # no start within this run can repeat but the last ones
                    stop = i + max(1, run - size + 1) if run >= size else i + 1
                    out += nodes[i:stop]
                    names += keys[i:stop]
                    i = stop
            nodes, keys = out, names
            ids = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
        if len(nodes) == before:
            break
    return nodes


def repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some group of so many elements stands twice in a row."""
    same = ids[size:] == ids[:-size]
    if np.count_nonzero(same) < size:
        return False
    return bool(np.diff(np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])).max() > size)


def single(nodes: list, other: list) -> list:
    """Single occurrences of the other side's repeated groups as repeated groups too, so that one item aligns with many."""
    groups: dict[str, list[list[str]]] = {}
    for x in other:
        x = bare(x)
        if x[0] == "+":
            keys = [key(y) for y in x[1]]
            if keys not in groups.setdefault(keys[0], []):
                groups[keys[0]].append(keys)
    if not groups:
        return nodes
    keys, out, i = [key(x) for x in nodes], [], 0
    while i < len(nodes):
        g = max((g for g in groups.get(keys[i], ()) if keys[i : i + len(g)] == g), key=len, default=None)
        out.append(["+", nodes[i : i + len(g)]] if g else nodes[i])
        i += len(g) if g else 1
    return out


def bare(node: list) -> list:
    return node[1][0] if node[0] == "?" and len(node[1]) == 1 else node


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal places, in order: common ends, then anchors, then a full comparison where little is left."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= CELLS:
            out += [(i + x, j + y) for x, y in longest(a[i:m], b[j:n])]
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        place = {k: y for y, k in enumerate(b[j:n], j) if cb[k] == 1}
        anchors = rising([(x, place[k]) for x, k in enumerate(a[i:m], i) if ca[k] == 1 and k in place])
        if anchors:
            ends = [(i - 1, j - 1), *anchors, (m, n)]
            out += anchors
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(out)


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of their first place, whose second places rise."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back[k] = last[at - 1] if at else -1
        tails[at:], last[at:] = [y, *tails[at + 1 :]], [k, *last[at + 1 :]]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def optional(nodes: list) -> list:
    """The nodes as one optional group, without optional groups of nothing else inside."""
    return nodes[0] if len(nodes) == 1 and nodes[0][0] == "?" else ["?", nodes]


def align(a: list, b: list) -> list:
    """The wrapper of both: what matches, all else optional."""
    a, b = single(a, b), single(b, a)
    out: list = []
    i = j = 0

    def close(left: list, right: list):
        groups: list[list] = []  # runs of what only the left has, as one optional group each
        for x in left:
            if x[0] == "?":
                groups.append(x)
            elif groups and groups[-1][0] == "new":
                groups[-1][1].append(x)
            else:
                groups.append(["new", [x]])
        if right:
            # an optional group that shares something with the other side's part is aligned with it in turn, one level deeper
            inner = right[0][1] if len(right) == 1 and right[0][0] == "?" else right
            mine = {key(bare(y)) for y in inner}
            k = next((k for k, g in enumerate(groups) if g[0] == "?" and any(key(bare(x)) in mine for x in g[1])), None)
            if k is None:
                groups.append(["?", right])
            else:
                groups[k] = ["?", align(groups[k][1], inner)]
        out.extend(optional(g[1]) for g in groups)

    for x, y in [*matches([key(bare(x)) for x in a], [key(bare(y)) for y in b]), (len(a), len(b))]:
        close(a[i:x], b[j:y])
        if x < len(a):
            one = merge(bare(a[x]), bare(b[y]))
            out.append(["?", [one]] if (a[x][0] == "?" or b[y][0] == "?") and one[0] != "?" else one)
        i, j = x + 1, y + 1
    return out


def form(html: str) -> list:
    """A page's folded nodes."""
    tokens = stream(html)
    content = xxhash.xxh64_hexdigest(max((x for _, x in tokens), key=len, default="").encode("utf-8", "surrogatepass"))
    return fold(blocks([["#", xxhash.xxh64_hexdigest(x.encode("utf-8", "surrogatepass")), len(x), [content]] if t == "#" else ["t", t] for t, x in tokens]))


def infer(forms: list[list]) -> list:
    """The wrapper of several forms, the wrappers of parts of a host among them."""
    out = None
    for nodes in forms:
        out = nodes if out is None else loosened(align(out, nodes))
    return out or []


def assigned(wrapper: list) -> list:
    """The wrapper with a role as last entry of each slot: whether it is content, or the hash of its text as template."""
    flat: list[tuple[str, list | None]] = []

    def walk(nodes):
        for x in nodes:
            if x[0] in "?+=":
                walk(x[1])
            else:
                flat.append(("#", x) if x[0] == "#" else (x[1], None))

    walk(wrapper)
    template = [s is not None and s[1] is not None and len(s[3]) >= DISTINCT for _, s in flat]
    places = roles([t for t, _ in flat], [s[2] if s and not fixed else 0 for (_, s), fixed in zip(flat, template)])
    for k, ((_, slot), content, fixed) in enumerate(zip(flat, places, template)):
        if slot:
            slot.append(slot[1] if content and fixed and not (k and HEADING.match(flat[k - 1][0])) else content)
    return wrapper


def roles(tags: list[str], mass: list[int]) -> list[bool]:
    """For each token of a stream, whether a text there is content."""
    stack: list[tuple[str, bool, int]] = []  # (name, set aside, number)
    where: list[tuple[tuple[int, ...], bool, bool]] = []  # (open elements, set aside, in an article)
    home: list[int | None] = []  # the element that a text counts for: what holds its block, or the box it stands in
    number = 0
    for t in tags:
        if t == "#":
            aside = any(x[1] or x[0] == "header" and not any(y[0] in ARTICLE for y in stack[:k]) for k, x in enumerate(stack))
            where.append((tuple(x[2] for x in stack), aside, any(x[0] in ARTICLE and not x[1] for x in stack)))
            holds = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in TEXT), 0)
            home.append(stack[max(0, holds - 1) if holds == len(stack) - 1 else holds][2] if stack else None)
            continue
        where.append(((), True, False))
        home.append(None)
        if t[1] == "/":
            name = t[2:-1]
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                del stack[k:]
        else:
            name = t[1:-1].split(" ", 1)[0]
            name, aside = name.rstrip("!"), name.endswith("!")
            if stack and stack[-1][0] == name and name in OPEN:
                stack.pop()  # a new item ends the one before
            number += 1
            stack.append((name, aside, number))
    if any(x[2] and not x[1] for x in where):
        return [x[2] and not x[1] for x in where]
    held: dict[int, int] = {}
    for (_, aside, _), e, n in zip(where, home, mass):
        if not aside and e is not None:
            held[e] = held.get(e, 0) + n
    top = max(held, key=lambda e: (held[e], -e), default=None)
    return [not x[1] and (top in x[0] or not x[0]) for x in where]


def program(wrapper: list) -> list[tuple]:
    """The wrapper as steps: (token, role, 0) to take, or ("", step to try first, step to try else) to choose."""
    out: list[tuple] = []

    def add(nodes):
        for x in nodes:
            at = len(out)
            if x[0] == "?":
                out.append(())
                add(x[1])
                out[at] = ("", at + 1, len(out))
            elif x[0] == "=":
                add(x[1])
            elif x[0] == "+":
                add(x[1])
                out.append(("", at, len(out) + 1))
            else:
                out.append(("#", x[-1], 0) if x[0] == "#" else (x[1], False, 0))

    add(wrapper)
    return out


def fitted(steps: list[tuple], tokens: list[tuple[str, str]]) -> list[str] | None:
    """The content texts of a page that fits the wrapper, else None.

    Optional and repeated groups are taken where they can be and given back where what follows then fails.
    No choice is tried twice at one token, so the work is at most choices times tokens.
    """
    n, end = len(tokens), len(steps)
    tried: set[int] = set()
    open_: list[tuple] = [(0, 0, None)]  # (step, token, the content slots before as a linked list)
    while open_:
        pc, at, path = open_.pop()
        while pc < end:
            name, a, b = steps[pc]
            if not name:
                state = pc * (n + 1) + at
                if state in tried:
                    break
                tried.add(state)
                open_.append((b, at, path))
                pc = a
            elif at < n and tokens[at][0] == name:
                if a:
                    path = (path, at, a)
                pc, at = pc + 1, at + 1
            else:
                break
        if pc == end and at == n:
            out = []
            while path:
                path, k, role = path
                if role is True or role != xxhash.xxh64_hexdigest(tokens[k][1].encode("utf-8", "surrogatepass")):
                    out.append(tokens[k][1])
            return out[::-1]
    return None


def read(wrapper: list, tokens: list[tuple[str, str]]) -> list[str] | None:
    """As ``fitted``, for a wrapper with its roles."""
    return fitted(program(wrapper), tokens)


def by_place(tokens: list[tuple[str, str]]) -> list[str]:
    """The content texts of a page by its own tokens' places."""
    places = roles([t for t, _ in tokens], [len(x) for _, x in tokens])
    return [x for (t, x), ok in zip(tokens, places) if t == "#" and ok]


@lru_cache(256)
def loaded(wrapper: str | None) -> list[tuple] | None:
    return program(assigned(json.loads(wrapper))) if wrapper else None


def main_text(html: str, wrapper: str | None) -> tuple[str, bool]:
    """The page's main text, and whether it fitted the wrapper."""
    tokens = stream(html)
    known = loaded(wrapper)
    blocks = fitted(known, tokens) if known else None
    return "\n\n".join(by_place(tokens) if blocks is None else blocks), blocks is not None


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def forms(pages: DataFrame) -> DataFrame:
    """(host, form, nodes, n): the distinct forms of all pages of each host, counted where the pages lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list] = {}
        for batch in cut(batches):
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                nodes = form(html)
                k = (name, xxhash.xxh64_hexdigest(" ".join(map(key, nodes)).encode("utf-8", "surrogatepass")))
                old = seen.get(k)
                seen[k] = [nodes, 1] if old is None else [[merge(x, y) for x, y in zip(old[0], nodes)], old[1] + 1]
            if len(seen) > 2_000:
                yield rows(seen)
                seen = {}
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_pydict({"host": [h for h, _ in seen], "form": [f for _, f in seen], "nodes": [json.dumps(x) for x, _ in seen.values()], "n": pa.array([n for _, n in seen.values()], pa.int64())}, schema=pa.schema([("host", pa.string()), ("form", pa.string()), ("nodes", pa.string()), ("n", pa.int64())]))

    rows_ = pages.where("html <> ''").select(host(F.col("url")).alias("host"), "html")
    return rows_.mapInArrow(run, "host string, form string, nodes string, n bigint")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n): FAN forms at a time are aligned, most frequent first, until each host has one; n counts pages."""

    def build(names, group):
        got = sorted(zip((-n for n in group.column("n").to_pylist()), group.column("form").to_pylist(), group.column("nodes").to_pylist()))
        # equal forms from different tasks stand together and merge without a change of form
        nodes = infer([json.loads(x) for _, _, x in sorted(got, key=lambda r: (r[0], r[1], r[2]))])
        return pa.table({"host": [names[0].as_py()], "form": [got[0][1]], "nodes": [json.dumps(nodes)], "n": pa.array([-sum(r[0] for r in got)], pa.int64())})

    rows = written(forms(pages), "forms")
    while True:
        sizes = rows.groupBy("host").agg(F.count("*").alias("m"))
        most = sizes.agg(F.max("m")).first()[0] or 0
        parts = F.ceil(F.col("m") / FAN).cast("bigint")
        # a host of few forms is one part; of many, each part is a task's, by the form
        dealt = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("form", F.lit(most)), parts))
        rows = written(dealt.groupBy("host", "part").applyInArrow(build, "host string, form string, nodes string, n bigint"), "aligned")
        if most <= FAN:
            return rows.select("host", F.col("nodes").alias("wrapper"), "n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, fitted) per page.

    Wrappers of hosts with many pages are broadcast, at most ``1 / HOT_SHARE`` of at most SHORT characters;
    only the pages of other hosts are shuffled to theirs.
    """
    known = written(wrappers(pages), "wrappers")
    total = known.agg(F.sum("n")).first()[0] or 0
    is_hot = (F.col("n") >= HOT_SHARE * total) & (F.length("wrapper") <= SHORT)
    hot = known.where(is_hot).select("host", "wrapper")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    near = rows.join(F.broadcast(hot), "host", "left").select("host", "page_id", "url", "html", "wrapper")
    if not known.where(~is_hot).isEmpty():
        cold = known.where(~is_hot).select("host", F.col("wrapper").alias("own"))
        far = near.where("wrapper IS NULL").drop("wrapper").join(cold, "host", "left").select("host", "page_id", "url", "html", F.col("own").alias("wrapper"))
        near = near.where("wrapper IS NOT NULL").unionByName(far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            got = [main_text(x or "", w) for x, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.bool_())], names=["page_id", "url", "text", "fitted"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return near.drop("host").mapInArrow(run, f"page_id {kind}, url string, text string, fitted boolean")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "fitted")
