"""Main text of web pages: the template of a host's pages is deduced by
equivalence classes, and what stands in its main slots is extracted.

A page is a sequence of tokens: start and end tags of elements that make
blocks, told apart by the path of elements, classes and ids above them, and
whole texts of blocks with their path. Over the different pages of a host, each
token has an occurrence vector; its linear fingerprint is a sum, which tasks
add up by themselves. Tokens of equal vectors, on MIN_PAGES pages and a share of
SUPPORT of the host's at least, form a class. A class is valid if it has at
least two tokens and every page holds it as repetitions of one order. The
largest valid class of tokens that stand once on a page is the template's root;
others nest in it if all their occurrences lie in one of the root's gaps.

Tokens of the root and of nested classes are the template; texts among them are
its own and not the page's. A slot is what follows one template token up to the
next. Elements that say what they are decide a slot's role: article and main
are main text, but not menus, headers of the page, footers, sidebars, notices,
adverts, forms and comments, by element, role, class or id. Hosts whose pages
have no article get their main slots from texts: those with the most
characters outside links and boilerplate, any with a fifth of that, and the
headings right before them. A page without article whose host has no template is judged alone in the same way.

Pages are read twice, and never move: the first pass leaves tokens as hashes.
Templates, a row a host, are broadcast while they hold TEMPLATE_BYTES at most;
larger ones are joined by host, and a hot host's pages are split.

Nulls and edges: html that is null or empty, and pages without main text, give
an empty text and 0. A null url, or one without `://`, has the host ''. Copies
of a page count once in a template and are extracted each. A table without rows
gives none. Broken markup is read as browsers do as far as blocks go: unclosed
and crossed elements end with their parent, a page that is cut off ends there.
Characters of white space are those of str.split; texts of any length are whole.
Other columns of the table aren't read, whatever their names."""

from __future__ import annotations

import html
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored
from .words import mix

#: A token is frequent on so many different pages of a host, and this share of them.
MIN_PAGES, SUPPORT = 4, 0.6
#: A slot is main if it has this share of the best slot's text, where no element says.
NEXT_BEST = 0.2
#: Most bytes of all templates together that are broadcast; pages that a task counts at once.
TEMPLATE_BYTES, PAGES_AT_ONCE = 32 << 20, 2048

# Fixed values of HTML, and names of elements in common use.
RAW = "script style noscript template iframe noembed noframes textarea title xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_ITSELF = set("p li dt dd tr td th option optgroup thead tbody tfoot rb rp rt".split())
SCOPES = set("html body table td th ul ol dl article main section div nav aside header footer form blockquote".split())
BOILERPLATE_ELEMENTS = set("nav aside footer form button menu dialog head header fieldset".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc topbar header masthead footer colophon copyright "
    "sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert alerts notification notifications "
    "comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations trending "
    "newsletter subscribe subscription signup login popup popups modal overlay skip search searchbox form toolbar".split()
)
#: Names that also hold for an article, and in one.
ALWAYS = set("comment comments commentlist reply replies respond disqus discussion related recommended recommendations trending ad ads advert adverts advertisement sponsored teaser".split())
NEGATIONS = {"has", "no", "with", "without", "enabled", "open"}
DROPPED_ELEMENTS = set("nav aside head svg select canvas audio video object datalist".split())

_TAG = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({'|'.join(RAW.split())})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

TEXT, MAIN, BOILER, HEADING = 1, 2, 4, 8
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element by its path: hashes of its tags, and what it says of its text."""

    __slots__ = ("end", "flags", "kids", "last", "start", "strong", "tag")

    def __init__(self, tag: str, path: str, flags: int, strong: bool):
        self.tag, self.flags, self.strong = tag, flags, strong
        self.start, self.end = xxhash.xxh3_64_intdigest("<" + path), xxhash.xxh3_64_intdigest("/" + path)
        self.kids: dict[tuple[str, str], tuple[Node, str]] = {}
        self.last = path


def _child(parent: Node, tag: str, attrs: str) -> Node:
    key = (tag, attrs)
    if key in parent.kids:
        return parent.kids[key]
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    role = said.get("role", "").lower()
    names = {x.lower() for x in _NAME.findall(f"{said.get('class', '')} {said.get('id', '')}")}
    plain = not names & NEGATIONS
    inside = parent.flags & MAIN
    body = tag in ("article", "main") or role in ("main", "article") or "articlebody" in said.get("itemprop", "").lower()
    strong = parent.strong or tag in DROPPED_ELEMENTS or tag == "footer" or (plain and tag not in ("html", "body", "main") and bool(names & ALWAYS))
    flags = parent.flags & ~HEADING if tag not in INLINE else parent.flags
    if body:
        flags = (flags | MAIN) & ~(0 if strong else BOILER)
    if strong:
        flags |= BOILER
    elif not body and tag not in ("html", "body"):
        named = names & BOILERPLATE_NAMES if plain else set()
        if inside:
            # an article's own header holds its title
            named = named - {"header", "masthead", "banner"}
        if (tag in BOILERPLATE_ELEMENTS and not (inside and tag == "header")) or role in BOILERPLATE_ROLES or named:
            flags |= BOILER
    if tag in HEADINGS:
        flags |= HEADING
    shown = _DIGITS.sub("#", f"{said.get('class', '')}.{said.get('id', '')}.{role}") if said else ""
    node = Node(tag, f"{parent.last}>{tag}{shown}", flags, strong)
    parent.kids[key] = node
    return node


_root = Node("", "", 0, False)
_seen = [0]


def parsed(page: str) -> list[tuple[int, int, str, int]]:
    """Tokens of a page in order: hash, flags, text, characters of it in links."""
    if _seen[0] > 200_000:
        _root.kids.clear()
        _seen[0] = 0
    stack, out = [_root], []
    parts: list[str] = []
    links, link, at = 0, False, 0

    def close_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = stack[-1]
                out.append((xxhash.xxh3_64_intdigest(text, n.start & 0xFFFFFFFF), n.flags | TEXT, text, min(links, len(text))))
            parts.clear()
        links = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if link:
                links += len(piece)
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closes, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "a":
                link = not closes
            if closes:
                if stack[-1].tag == tag:
                    close_block()
                    stack.pop()
            elif attrs or stack[-1].tag == tag:
                # only an inline element that says what it is, and those of its kind in it
                node = _child(stack[-1], tag, attrs)
                if node.flags != stack[-1].flags or stack[-1].tag == tag:
                    close_block()
                    stack.append(node)
            continue
        close_block()
        link = False
        if tag in VOID:
            continue
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    out.append((stack[k].end, stack[k].flags, "", 0))
                    del stack[k:]
                    break
            continue
        while stack[-1].tag in INLINE:
            stack.pop()
        if tag == "body" or (stack[-1].tag == "head" and tag not in ("base", "link", "meta")):
            while stack[-1].tag not in ("html", ""):
                stack.pop()
        if stack[-1].tag == "p":
            stack.pop()
        elif tag in CLOSED_BY_ITSELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        if len(stack) < 400:  # deeper elements keep the path of this one
            node = _child(stack[-1], tag, attrs)
            _seen[0] += 1
        else:
            node = stack[-1]
        stack.append(node)
        out.append((node.start, node.flags, "", 0))
    if at < len(page):
        parts.append(page[at:])
    close_block()
    return out


TOKENS = "host string, content long, tokens binary, flags binary, chars binary, links binary"


def page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each page as hashes, and what is known of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if page:
                    t = parsed(page)
                    tokens = np.array([x[0] for x in t], np.uint64).tobytes()
                    rows.append((host, xxhash.xxh3_64_intdigest(page) - (1 << 63), tokens, bytes(x[1] for x in t), np.array([len(x[2]) for x in t], "<u4").tobytes(), np.array([x[3] for x in t], "<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])

    rows = pages.mapInArrow(run, TOKENS)
    # copies of a page count once
    rest = ["tokens", "flags", "chars", "links"]
    return rows.groupBy("host", "content").agg(*[F.first(c).alias(c) for c in rest])


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages with it, its occurrences, the most on one page, and
    the fingerprint of its occurrence vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for host, parts in found.items():
                token, n, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(token, kind="stable")
                token, n, value = token[order], n[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                with np.errstate(over="ignore"):
                    value = np.add.reduceat(value, first)
                yield pa.record_batch(
                    [pa.array([host] * len(first)), pa.array(token[first].view(np.int64)), pa.array(np.diff(np.append(first, len(token)))), pa.array(np.add.reduceat(n, first)), pa.array(np.maximum.reduceat(n, first)), pa.array((value >> np.uint64(32)).astype(np.int64)), pa.array((value & np.uint64(0xFFFFFFFF)).astype(np.int64))],
                    ["host", "token", "pages", "n", "most", "high", "low"],
                )
            found.clear()

        for b in batches:
            for host, content, raw in zip(b.column("host").to_pylist(), b.column("content").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                token, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                if not len(token):
                    continue
                with np.errstate(over="ignore"):
                    found[host].append((token, n, n.astype(np.uint64) * mix(np.array([content], np.int64).view(np.uint64))))
                held += 1
                if held == PAGES_AT_ONCE:
                    yield from sent()
                    held = 0
        yield from sent()

    ddl = "host string, token long, pages long, n long, most long, high long, low long"
    add = [F.sum(c).alias(c) for c in ("pages", "n", "high", "low")]
    # sums of halves are exact; with carries between them they are the sum modulo 2**64
    return pages.select("host", "content", "tokens").mapInArrow(run, ddl).groupBy("host", "token").agg(F.max("most").alias("most"), *add)


def classes(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each host: its candidate classes as (tokens, once on a page)."""
    frequent = vectors.where(f"pages >= {MIN_PAGES}").join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("n_pages"))
    vector = F.struct("pages", "n", "high", "low")
    one = frequent.groupBy("host", vector.alias("vector")).agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("most").alias("most"), F.first("n_pages").alias("n_pages"))
    return one.where("size(tokens) >= 2").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.col("vector.pages").alias("pages"), (F.col("most") == 1).alias("once"), "tokens"))).alias("classes"))


def occurrences(tokens: np.ndarray, groups: list[np.ndarray]) -> list[tuple[np.ndarray, bool, int]]:
    """Of each class: places of its tokens on a page, whether they repeat one
    order, and a hash of that."""
    out = []
    for g in groups:
        at = np.flatnonzero(np.isin(tokens, g))
        seq = tokens[at]
        k = len(g)
        good = not len(seq) or (len(seq) % k == 0 and (seq.reshape(-1, k) == seq[:k]).all() and len(np.unique(seq[:k])) == k)
        out.append((at, bool(good), xxhash.xxh3_64_intdigest(seq[:k].tobytes()) >> 1 if len(seq) else -1))
    return out


ORDERS = "host string, class int, good boolean, low long, high long, gap_low int, gap_high int"


def checked(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """host, class, whether all pages hold it in one order, and the gap of the
    root in which it lies (null if in several)."""

    def run(batches: Iterator[pa.RecordBatch], template_of) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for b in batches:
            for host, raw, template in zip(b.column("host").to_pylist(), b.column("tokens").to_pylist(), template_of(b), strict=True):
                if template is None:
                    continue
                groups, root = template
                seen = occurrences(np.frombuffer(raw, np.uint64), groups)
                edges = seen[root][0]
                for i, (at, good, order) in enumerate(seen):
                    if not len(at):
                        continue
                    gaps = np.searchsorted(edges, at)
                    x = found.setdefault((host, i), [True, order, order, int(gaps[0]), int(gaps[0])])
                    x[:] = [x[0] and good, min(x[1], order), max(x[2], order), min(x[3], int(gaps.min())), max(x[4], int(gaps.max()))]
        cols = list(zip(*[(*k, *v) for k, v in found.items()], strict=True)) or [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in ORDERS.split(", ")])

    found = with_templates(pages.select("host", "tokens"), templates, run, ORDERS)
    return found.groupBy("host", "class").agg(
        (F.min("good") & (F.min("low") == F.max("high"))).alias("valid"),
        F.when(F.min("gap_low") == F.max("gap_high"), F.min("gap_low")).alias("gap"),
    )


def with_templates(rows: DataFrame, templates: DataFrame, run, ddl: str) -> DataFrame:
    """run(batches, template of each row of a batch): by a broadcast if all
    templates together are small, else by a join with the host's."""
    spark = rows.sparkSession
    if (templates.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 64)).first()[0] or 0) <= TEMPLATE_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in templates.toLocalIterator()})
        loaded: dict[str, object] = {}

        def of(batch: pa.RecordBatch) -> list:
            out = []
            for host in batch.column("host").to_pylist():
                if host not in loaded:
                    raw = shared.value.get(host)
                    loaded[host] = None if raw is None else pickle.loads(raw)
                out.append(loaded[host])
            return out

        return rows.mapInArrow(lambda batches: run(batches, of), ddl)

    def joined(batch: pa.RecordBatch) -> list:
        last: dict[str, object] = {}
        out = []
        for host, raw in zip(batch.column("host").to_pylist(), batch.column("template").to_pylist(), strict=True):
            if host not in last:
                last[host] = None if raw is None else pickle.loads(raw)
            out.append(last[host])
        return out

    return rows.join(templates, "host", "left").mapInArrow(lambda batches: run(batches, joined), ddl)


def _pickled(rows: DataFrame, make) -> DataFrame:
    """host, template: make(row as dict), for a row a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(r["host"], pickle.dumps(x)) for r in b.to_pylist() if (x := make(r)) is not None]
            yield pa.record_batch([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.binary())], ["host", "template"])

    return stored(rows.mapInArrow(run, "host string, template binary"), "templates")


def _candidates(row: dict):
    """Tokens of the candidate classes, and which is the root: of those that
    stand once on a page, the one on the most pages and of the most tokens."""
    groups = [np.array(c["tokens"], np.int64).view(np.uint64) for c in row["classes"]]
    once = [(c["pages"], len(c["tokens"]), -i) for i, c in enumerate(row["classes"]) if c["once"]]
    return (groups, -max(once)[2]) if once else None


def _nested(row: dict):
    """Template tokens of a host: the root's and those of classes that nest in one gap of it."""
    groups, root = pickle.loads(row["template"])
    valid = {c["class"]: c["gap"] for c in row["checks"] if c["valid"]}
    if root not in valid:
        return None
    kept = [groups[i] for i, gap in valid.items() if i == root or gap is not None]
    return np.sort(np.concatenate(kept)), None


SLOTS = "host string, slot long, article boolean, chars long, links long"


def slot_texts(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Per host and slot, characters of its own texts outside boilerplate, in
    links, and whether an article holds it; slot -1 counts whole articles."""

    def run(batches: Iterator[pa.RecordBatch], template_of) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = defaultdict(lambda: [False, 0, 0])
        for b in batches:
            for host, raw, flags, chars, links, template in zip(*(b.column(c).to_pylist() for c in ("host", "tokens", "flags", "chars", "links")), template_of(b), strict=True):
                if template is None:
                    continue
                token, f = np.frombuffer(raw, np.uint64), np.frombuffer(flags, np.uint8)
                slots, own = slots_of(token, f, template[0])
                n, m = np.frombuffer(chars, "<u4"), np.frombuffer(links, "<u4")
                for i in np.flatnonzero(own & ((f & BOILER) == 0)).tolist():
                    x = found[host, int(slots[i])]
                    x[0] |= bool(f[i] & MAIN)
                    x[1] += int(n[i])
                    x[2] += int(m[i])
        cols = list(zip(*[(*k, *v) for k, v in found.items()], strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SLOTS.split(", ")])

    return with_templates(pages.drop("content"), templates, run, SLOTS).groupBy("host", "slot").agg(F.max("article").alias("article"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def slots_of(token: np.ndarray, flags: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each token, which is the last template token up to it (as a
    signed number; 0 before the first), and which are texts of the page's own."""
    known = np.isin(token, template)
    last = np.maximum.accumulate(np.where(known, np.arange(len(token)), -1))
    slots = np.where(last >= 0, token.view(np.int64)[np.maximum(last, 0)], 0)
    return slots, ((flags & TEXT) > 0) & ~known


def _main_slots(row: dict):
    """Template tokens, and the main slots of a host without articles (else none)."""
    template = pickle.loads(row["template"])[0]
    return template, None if any(s["article"] for s in row["slots"]) else best_slots({s["slot"]: (s["chars"], s["links"]) for s in row["slots"]})


def best_slots(texts: dict[int, tuple[int, int]]) -> set[int]:
    own = {k: n - m for k, (n, m) in texts.items() if 2 * m < n}
    return {k for k, n in own.items() if n >= NEXT_BEST * max(own.values())}


def text_of(tokens: list[tuple[int, int, str, int]], template) -> str:
    """The main text of a page by its host's template (None if it has none)."""
    token, flags = np.array([t[0] for t in tokens], np.uint64), np.array([t[1] for t in tokens], np.uint8)
    known = template[0] if template is not None else np.zeros(0, np.uint64)
    slots, own = slots_of(token, flags, known)
    own &= (flags & BOILER) == 0
    if ((flags & MAIN) > 0).any():
        own &= (flags & MAIN) > 0
    elif template is not None and template[1] is not None:
        main = np.isin(slots, np.array(sorted(template[1]), np.int64))
        # a heading goes with the text that it stands before
        at = np.flatnonzero(own)
        goes = main[at]
        for k in range(len(at) - 2, -1, -1):
            goes[k] |= bool(flags[at[k]] & HEADING) and goes[k + 1]
        own[at] = goes
    else:
        # a page alone: an element's direct texts make a slot
        inside = np.array(_containers(tokens), np.int64)
        texts: dict[int, tuple[int, int]] = defaultdict(lambda: (0, 0))
        for i in np.flatnonzero(own).tolist():
            n, m = texts[int(inside[i])]
            texts[int(inside[i])] = n + len(tokens[i][2]), m + tokens[i][3]
        own &= np.isin(inside, np.array(sorted(best_slots(texts)), np.int64))
    return " ".join(tokens[i][2] for i in np.flatnonzero(own).tolist())


def _containers(tokens: list[tuple[int, int, str, int]]) -> list[int]:
    """For each token, the last start or end of an element with other flags: a
    run of blocks that says the same of itself."""
    out, last, flags = [], 0, -1
    for i, (_, f, text, _) in enumerate(tokens):
        if f & (MAIN | BOILER) != flags and not text:
            last, flags = i, f & (MAIN | BOILER)
        out.append(last)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    tokens = stored(page_tokens(rows.select("host", "html")), "page-tokens")
    sizes = tokens.groupBy("host").agg(F.count("*").alias("n_pages")).where(f"n_pages >= {MIN_PAGES}")
    candidates = _pickled(classes(token_vectors(tokens), sizes), _candidates)
    checks = checked(tokens, candidates).groupBy("host").agg(F.collect_list(F.struct("class", "valid", "gap")).alias("checks"))
    nested = _pickled(candidates.join(checks, "host"), _nested)
    slots = slot_texts(tokens, nested).groupBy("host").agg(F.collect_list(F.struct("slot", "article", "chars", "links")).alias("slots"))
    templates = _pickled(nested.join(slots, "host"), _main_slots)

    def run(batches: Iterator[pa.RecordBatch], template_of) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(parsed(page), t) if page else "" for page, t in zip(b.column("html").to_pylist(), template_of(b), strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return with_templates(rows, templates, run, f"page_id {kind}, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
