"""Problem 3: the main body of web pages, by tag-path ratios.

Per page, text length and punctuation are summed over each root-to-leaf tag path. The
ratios of a path (per text node of it) are smoothed along the page and fused; paths whose
mean fused ratio reaches a threshold are content paths, and the element that holds the mass
of their nodes is the body. Rules refine this: the page's heading belongs to the body, link
blocks, short blocks of a class of their own and what the site's parameters name don't.
`classify(rules=False)` shows what the ratios decide alone.

What a line is on pages with markup is then counted over the whole corpus, by the line
with digits masked, by its lead-in up to a colon, and by site. These counts decide lines
that markup leaves open and pages whose markup is missing: there the body starts at the
line that the address spells and ends at the first line that is furniture elsewhere.

Nodes and lines of a page are its own bounded group; corpus counts are joined, never
collected.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.core.session import staged

CONTENT, INSIDE, OUTSIDE, OPEN = 0, 1, 2, 3
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template", "noscript", "title"}
_NEVER = {"nav", "footer", "header", "form", "button", "select", "menu"}
_OWN = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "dt", "dd", "figcaption"}
_PUNCTUATION = re.compile(r"[.,;:!?…]")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)]*$")
_SQUEEZE = re.compile(r"[\s|]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Node:
    path: tuple[tuple[int, str, str], ...]  # (element number, tag, class) from the root down
    text: str


#: A comment, a declaration, or a tag with its attributes; quoted values may hold a closing bracket.
_TAG = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.S)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}


def parse(source: str) -> list[Node]:
    """The text nodes of a page in order, without scripts, styles and the head's title.

    End tags close the nearest open element of their name and all within; those of none are
    passed over, so any markup gives nodes.
    """
    nodes: list[Node] = []
    stack: list[tuple[int, str, str]] = []
    count = hidden = at = 0  # elements so far, open elements without visible text, where text begins

    def text(end: int) -> None:
        if at < end and not hidden:
            t = source[at:end]
            t = (unescape(t) if "&" in t else t).strip()
            if t:
                nodes.append(Node(tuple(stack), t))

    pos = 0
    while m := _TAG.search(source, pos):
        text(m.start())
        pos = at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == tag:
                    hidden -= sum(t in _HIDDEN for _, t, _ in stack[k:])
                    del stack[k:]
                    break
        elif tag not in _VOID:
            count += 1
            rest = m[3][:-1]
            if rest.endswith("/"):
                continue
            c = _CLASS.search(rest) if "class" in rest.lower() else None
            stack.append((count, tag, unescape(next(g for g in c.groups() if g is not None)) if c else ""))
            hidden += tag in _HIDDEN
            if tag in _RAW_END:  # what looks like markup in a script is none
                end = _RAW_END[tag].search(source, pos)
                pos = at = end.start() if end else len(source)
    text(len(source))
    return nodes


def scores(nodes: list[Node]) -> np.ndarray:
    """The fused, smoothed tag-path ratio of each node."""
    paths = ["/".join(f"{t}.{c}" for _, t, c in n.path) for n in nodes]
    index = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    at = np.array([index[p] for p in paths])
    count = np.bincount(at)
    length = np.bincount(at, weights=[len(n.text) for n in nodes]) / count
    punctuation = np.bincount(at, weights=[len(_PUNCTUATION.findall(n.text)) for n in nodes]) / count
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda v: np.convolve(np.pad(v, 2, mode="edge"), kernel, mode="valid")
    link = np.array([any(t == "a" for _, t, _ in n.path) for n in nodes])
    fused = smooth(length[at]) * np.log1p(length[at]) * (0.2 + smooth(punctuation[at]) * np.minimum(punctuation[at], 1))
    return np.where(link, 0.0, fused)


THRESHOLD = 0.5  # of the mean fused ratio


def content_paths(nodes: list[Node], fused: np.ndarray) -> dict[tuple, bool]:
    """Each tag path of a page and whether its mean fused ratio reaches the threshold."""
    sums: dict[tuple, list[float]] = {}
    for n, score in zip(nodes, fused):
        sums.setdefault(_key(n), []).append(float(score))
    least = THRESHOLD * float(fused.mean())
    return {k: sum(v) / len(v) >= least for k, v in sums.items()}


def _key(node: Node) -> tuple:
    return tuple((t, c) for _, t, c in node.path)


def body_element(nodes: list[Node], fused: np.ndarray, heading: bool = True) -> int:
    """Number of the element that holds the content nodes: the deepest with half of their mass, or,
    with `heading`, the deepest with the page's heading and nearly all of the mass."""
    flagged = np.where(fused >= THRESHOLD * fused.mean(), fused, 0)
    share = 0.5
    headings = [i for i, n in enumerate(nodes) if any(t == "h1" for _, t, _ in n.path)]
    if heading:
        share = 0.999
        if headings:
            flagged = flagged.copy()
            flagged[headings[0]] += fused.sum() + 1  # the heading belongs to the body however short that is
    mass: dict[int, float] = {}
    depth: dict[int, int] = {}
    for n, m in zip(nodes, flagged):
        if not heading and any(t in _NEVER for _, t, _ in n.path):
            continue
        for d, (e, tag, _) in enumerate(n.path):
            if tag in ("h1", "h2", "h3", "p", "span", "a", "li", "blockquote"):
                break
            mass[e] = mass.get(e, 0) + m
            depth[e] = d
    if not mass:
        return 0
    inner = {e: m for e, m in mass.items() if depth[e] > 1} or mass
    most = max(inner.values()) if heading else max(mass.values())
    return max((e for e in inner if inner[e] >= share * most), key=lambda e: depth[e], default=0)


def classify(nodes: list[Node], unwanted_tags: set[str], unwanted_classes: set[str], rules: bool = True) -> list[tuple[int, str]]:
    """(kind, tag of the block) of each node.

    Within the body, nodes of content paths and parts of its structure (headings, items, cells)
    are content. `rules` are refinements: the body reaches up to the page's heading, what the
    site's parameters name and blocks of a class of their own without sentences are furniture,
    and sentences of a path under the threshold stay. Without them the ratios alone decide.
    """
    if not nodes:
        return []
    fused = scores(nodes)
    chosen = content_paths(nodes, fused)
    body = body_element(nodes, fused, heading=rules)
    threshold = THRESHOLD * fused.mean()
    ends: dict[tuple, bool] = {}
    lengths: dict[tuple, list[int]] = {}
    for n in nodes:  # does a path carry sentences, and how long are its nodes?
        key = _key(n)
        ends[key] = ends.get(key, False) or bool(_SENTENCE_END.search(n.text))
        lengths.setdefault(key, []).append(len(n.text))
    full = [x for k, v in lengths.items() if ends[k] for x in v]
    short = 0.5 * sum(full) / len(full) if full else 0.0  # half a node of running text
    out = []
    for n, score in zip(nodes, fused):
        at = next((d for d, (e, _, _) in enumerate(n.path) if e == body), None)
        tag = n.path[-1][1] if n.path else ""
        if at is None:
            out.append((OUTSIDE, tag))
            continue
        below = n.path[at + 1 :]
        tags = [t for _, t, _ in below]
        key = _key(n)
        block = next((t for t in reversed(tags) if t in _OWN or t in ("p", "div", "aside")), tag)
        sentences = ends[key]
        linked = "a" in tags and not set(tags) & {"p", "td", "th", "blockquote", *(("li",) if rules else ())}
        kind = CONTENT if (chosen[key] or set(tags) & _OWN or (rules and sentences)) and not linked and not set(tags) & _NEVER else INSIDE
        if kind == CONTENT and rules and _named(tags, below, sentences, unwanted_tags, unwanted_classes):
            kind = INSIDE
        elif kind == CONTENT and rules and not set(tags) & _OWN and not sentences:
            own = lengths[key]
            if any(x for _, _, x in below) and (score < threshold or sum(own) / len(own) < short) or "div" in tags and not any(x for _, _, x in below):
                kind = INSIDE
        out.append((kind, block))
    return out


def _named(tags: list[str], below: tuple, sentences: bool, unwanted_tags: set[str], unwanted_classes: set[str]) -> bool:
    """Whether the site's parameters name the node as furniture."""
    named = set(tags) & unwanted_tags
    if sentences:  # a note within the body is content even where the site calls its sidebar by the same tag
        named -= {"aside", "blockquote", "table"}
    return bool({c for _, _, x in below for c in x.lower().split()} & unwanted_classes or named - {"table"})


def align(lines: list[str], nodes: list[Node]) -> list[list[int]]:
    """The nodes whose text each line holds, in order, white space and bars aside.

    Lines that are one node's text and occur once on either side are anchors, as many as stand in
    the same order; between two anchors each line takes the first nodes that spell it.
    """
    flat = [_SQUEEZE.sub("", n.text) for n in nodes]
    want = [_SQUEEZE.sub("", line) for line in lines]
    node_of, line_of = Counter(flat), Counter(want)
    at_node = {t: k for k, t in enumerate(flat) if node_of[t] == 1}
    pairs = [(i, at_node[t]) for i, t in enumerate(want) if t in at_node and line_of[t] == 1]
    # the longest run of anchors in increasing order of nodes
    tails: list[int] = []
    places: list[int] = []
    before: list[int | None] = []
    for p, (_, k) in enumerate(pairs):
        j = bisect_left(tails, k)
        before.append(places[j - 1] if j else None)
        tails[j : j + 1], places[j : j + 1] = [k], [p]
    anchors = []
    p = places[-1] if places else None
    while p is not None:
        anchors.append(pairs[p])
        p = before[p]
    out: list[list[int]] = [[] for _ in lines]
    first: dict[str, list[int]] = {}  # nodes by the first letter of their text
    for k, t in enumerate(flat):
        first.setdefault(t[:1], []).append(k)
    line, node = 0, 0
    for i, k in [*reversed(anchors), (len(lines), len(flat))]:
        for x in range(line, i):
            starts = first.get(want[x][:1], []) if want[x] else []
            for start in starts[bisect_left(starts, node) :]:
                if start >= k:
                    break
                taken, end = "", start
                while end < k and len(taken) < len(want[x]):
                    taken += flat[end]
                    end += 1
                if taken == want[x]:
                    out[x] = list(range(start, end))
                    node = end
                    break
        if i < len(lines):
            out[i] = [k]
        line, node = i + 1, k + 1
    return out


def slug(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def keys(site: str | None, line: str) -> tuple[int, int | None, int]:
    """Hashes of the line with digits masked, of its lead-in, and of the line on its site."""
    masked = _DIGITS.sub("#", " ".join(line.split()))
    head, colon, _ = masked.partition(":")
    lead = _hash("lead", head) if colon and len(head.split()) <= 4 else _hash("lead", " ".join(masked.split()[:2])) if len(masked.split()) <= 8 else None
    return _hash("line", masked), lead, _hash("site", site or "", masked)


LINES = (
    "page_id bigint, line_no int, kind int, block string, title int, size int, stop boolean, "
    "line_key bigint, lead_key bigint, site_key bigint"
)


def page_lines(pages: DataFrame, params: DataFrame) -> DataFrame:
    """LINES: the non-blank lines of every page with what its markup says (OPEN without markup)."""
    # a handful of rows a site, configuration: joined, and broadcast only if Spark finds it small
    named = params.groupBy("site").agg(
        F.flatten(F.collect_list(F.coalesce("unwanted_tags", F.array().cast("array<string>")))).alias("tags"),
        F.flatten(F.collect_list(F.coalesce("unwanted_classnames", F.array().cast("array<string>")))).alias("classes"),
    )
    rows = pages.select("page_id", "url", "site", "html", "text").where(F.col("text").isNotNull()).join(named, "site", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, url, site, html, text, tags, classes in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                nodes = parse(html) if html else []
                kinds = classify(nodes, {t.lower() for t in tags or [] if t}, {c.lower() for c in classes or [] if c})
                places = align(lines, nodes) if nodes else [[] for _ in lines]
                tail = slug((url or "").rstrip("/").rsplit("/", 1)[-1])
                for i, line in enumerate(lines):
                    if not line.strip():
                        continue
                    kind, block = OPEN, ""
                    if places[i]:
                        found = [kinds[k] for k in places[i]]
                        kind, block = min(found)[0] if any(x == CONTENT for x, _ in found) else max(found)[0], found[0][1]
                    own = slug(line)
                    same = len(tail) > 3 and len(own) > 3 and (own.startswith(tail) or tail.startswith(own))
                    title = min(len(own), len(tail)) if same else 0
                    out.append((page, i, kind, block, title, len(line.strip()), bool(_SENTENCE_END.search(line.strip())), *keys(site, line)))
            cols = list(zip(*out)) if out else [()] * 10
            kinds_ = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_)], [x.split()[0] for x in LINES.split(", ")])

    return rows.select("page_id", "url", "site", "html", "text", "tags", "classes").mapInArrow(run, LINES)


def choose(rows: list[dict]) -> list[int]:
    """Line numbers of the main body of one page; `rows` in the order of its lines."""
    marked = any(r["kind"] != OPEN for r in rows)
    if marked:
        first = next((i for i, r in enumerate(rows) if r["kind"] == CONTENT), None)
        if first is None:
            return []
        keep = []
        for r in rows:
            kind = r["kind"]
            if kind == OPEN:  # a line the markup doesn't show: as the lines beside it
                kind = CONTENT if keep and r["line_no"] - keep[-1] <= 2 and not _foreign(r) else OUTSIDE
            if kind == CONTENT and r["block"] not in _OWN and _furniture(r):
                continue
            if kind == CONTENT:
                keep.append(r["line_no"])
        return keep
    best = max((r["title"] for r in rows), default=0)
    starts = [i for i, r in enumerate(rows) if r["title"] and r["title"] == best]
    start = starts[0] if starts else next((i for i, r in enumerate(rows) if not _foreign(r) and r["n2"] <= 2 * r["n0"]), None)
    if start is None:
        return []
    end = start + 1
    while end < len(rows) and not (_foreign(rows[end]) and (_never_in_body(rows[end]) or end + 1 == len(rows) or _foreign(rows[end + 1]))):
        end += 1  # a line that is a link elsewhere may be a heading here, if no other such line follows
    while end > start + 1 and rows[end - 1]["s2"] > rows[end - 1]["s0"]:  # closing paragraphs of the site
        end -= 1
    return [r["line_no"] for r in rows[start:end] if not (_furniture(r) and not r["title"])]


def _furniture(r: dict) -> bool:
    """Furniture within a body, by what the line or its lead-in is elsewhere."""
    by_line = r["n1"] >= 2 and r["n1"] >= 0.3 * r["n0"]
    by_lead = r["l1"] >= 5 and r["l1"] >= 0.5 * r["l0"]
    return (by_line or by_lead) and not r["stop"] or (by_line and r["n1"] > 3 * r["n0"])


def _foreign(r: dict) -> bool:
    """A line from outside bodies: so on pages with markup, on this site or on any."""
    if r["s2"] >= 1 and r["s0"] == 0 and r["s1"] == 0:
        return True
    if r["n2"] >= 2 and r["n0"] + r["n1"] <= 0.02 * r["n2"]:
        return True
    return r["n2"] + r["n0"] + r["n1"] < 3 and not r["stop"] and r["l2"] >= 10 and r["l0"] + r["l1"] <= 0.02 * r["l2"]


def _never_in_body(r: dict) -> bool:
    return r["n2"] >= 20 and r["n0"] + r["n1"] == 0


def main_body(pages: DataFrame, params: DataFrame) -> DataFrame:
    """page_id, line_no of the main-body lines (from 0, split at newlines), distinct.

    Null and blank texts give no rows; without html the corpus counts decide; sites
    without parameters and null sites are read alike. Repeated rows count once.
    """
    lines = staged(page_lines(pages, params).dropDuplicates(["page_id", "line_no"]))
    long = lines.select(
        "page_id", "line_no", "kind", "block", "title", "size", "stop",
        F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(c).alias("hash")) for n, c in (("n", "line_key"), ("l", "lead_key"), ("s", "site_key"))))).alias("k"),
    ).select("page_id", "line_no", "kind", "block", "title", "size", "stop", "k.what", "k.hash")
    counts = long.where((F.col("kind") != OPEN) & F.col("hash").isNotNull()).groupBy("hash").agg(
        *(F.sum((F.col("kind") == k).cast("int")).alias(f"c{k}") for k in (CONTENT, INSIDE, OUTSIDE))
    )
    # one row a hash on the right: a hot hash (a menu entry) is a skewed left side, which adaptive execution splits
    joined = long.join(counts, "hash", "left")
    per_line = joined.groupBy("page_id", "line_no", "kind", "block", "title", "size", "stop").agg(
        *(F.max(F.when(F.col("what") == w, F.coalesce(f"c{k}", F.lit(0)))).cast("int").alias(f"{w}{k}") for w in "nls" for k in (CONTENT, INSIDE, OUTSIDE))
    )
    names = ["line_no", "kind", "block", "title", "size", "stop", *(f"{w}{k}" for w in "nls" for k in range(3))]
    pages_ = per_line.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))  # the lines of one page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = [], []
            for page, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _without_self(rows)
                kept = choose(own)
                ids += [page] * len(kept)
                nos += kept
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], ["page_id", "line_no"])

    return pages_.mapInArrow(run, "page_id bigint, line_no int")


def _without_self(rows: list[dict]) -> list[dict]:
    """Counts of other lines: what a line adds to its own counts is taken out."""
    for r in rows:
        if r["kind"] != OPEN:
            for w in "nls":
                if r[f"{w}{r['kind']}"]:
                    r[f"{w}{r['kind']}"] -= 1
    return rows
