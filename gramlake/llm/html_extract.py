"""Main text of web pages (operator 5): template deduction by equivalence classes over the pages of one host.

A page becomes blocks: runs of text under a role, the path of its enclosing block elements with their class names. Each
host's tokens are its roles and its blocks' texts; a token's occurrence vector (its count on every different page of the host;
copies of a page count once) is kept as two sums of page hashes times counts, which partitions can add, so no host's pages
meet in one task. Tokens with equal sums over as many pages are one equivalence class. Classes with enough support are valid;
a class nests in a gap between the tokens of the class around it, and the nested skeleton is the template: its constant texts
are boilerplate, wherever they stand, what varies between its tokens are slots.
The content slot is the article's or main element's, or without one the container whose slots hold most varying text
outside links; menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments are never content.
Every page is read through its host's template; pages of hosts without one (too few different pages) by the same rules on
themselves.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# HTML element names by kind.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul button".split())
NEVER = frozenset("nav footer aside form head menu dialog select button svg search fieldset".split())
CLOSES_P = BLOCK - frozenset("html body head option optgroup button".split())
LIKE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table",), "option": ("select",)}
# Words of class, id and role names for what is not the article, words that say nothing beside one of these, and
# words that make a name tell of its surroundings.
NOT_CONTENT = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored notice notices alert cookie cookies consent gdpr popup modal overlay comment comments reply replies respond disqus form search contentinfo complementary dialog".split())
NEUTRAL = frozenset("box bar list area section wrapper wrap container block site page left right top bottom inner outer body item items group text content".split())
ABOUT = frozenset("has with without no not is for under below after before".split())
HEADS = frozenset("header head masthead topbar".split())
MAIN = frozenset("article main".split())
SUPPORT, LEAST_PAGES = 0.5, 3


def names(value: str, words: frozenset[str]) -> bool:
    """Whether one of an attribute's whole names means one of these words: its last word that is not neutral is one of them, and
    it doesn't tell of something beside it (has-sidebar)."""
    for name in value.split():
        parts = [w.lower() for w in PIECE.findall(name)]
        if ABOUT.isdisjoint(parts):
            while len(parts) > 1 and (parts[-1] in NEUTRAL or parts[-1].isdigit()):
                parts.pop()
            if parts and parts[-1] in words:
                return True
    return False


def role_of(name: str, attributes: str) -> tuple[str, str]:
    """A token of the path, and its kind: "main", "not", "head", "named" (not the article, by its name only) or ""."""
    if not attributes.strip():
        return name, "main" if name in MAIN else "not" if name in NEVER else "head" if name == "header" else ""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    token = f"{name}.{'.'.join(sorted(a.get('class', '').split()))}" if a.get("class") else name
    if name in NEVER or re.search(r"(?<![\w-])hidden(?![\w-])", QUOTED.sub("", attributes)):
        return token, "not"
    if name in MAIN and not a.get("role") or a.get("role") == "main":
        return token, "main"
    if name == "header":
        return token, "head"
    called = " ".join(a.get(k, "") for k in ("class", "id", "role"))
    if name not in ("html", "body") and names(called, NOT_CONTENT):
        return token, "named"
    return token, "head" if names(called, HEADS) else ""


class Page:
    """blocks: (role path, kind, text, characters in links) in page order.

    An element that only its name calls no article is taken at its word unless it holds the article itself: an article or main
    element or, on pages without one, more than half of the text."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, str, str, int]] = []
        self._stack: list[tuple[str, str, str, int]] = []
        self._text: list[str] = []
        self._link = self._linked = self._opened = 0
        self._within: list[list[int]] = []
        self._holds: set[int] = set()
        self._read(source or "")
        if any(self._within):
            self._believe_names()

    def _believe_names(self) -> None:
        sizes: dict[int, int] = {}
        total = 0
        for (_, kind, text, linked), inside in zip(self.blocks, self._within, strict=True):
            if kind != "not":
                free = max(0, len(text) - linked)
                total += free
                for k in inside:
                    sizes[k] = sizes.get(k, 0) + free
        alone = not any(kind == "main" for _, kind, _, _ in self.blocks)
        wrong = self._holds | {k for k, n in sizes.items() if alone and 2 * n > total}
        self.blocks = [b if wrong.issuperset(inside) else (b[0], "not", *b[2:]) for b, inside in zip(self.blocks, self._within, strict=True)]

    def _kind(self) -> str:
        kinds = [x[2] for x in self._stack]
        if "not" in kinds or "head" in kinds and "main" not in kinds[: kinds.index("head")]:
            return "not"
        return "main" if "main" in kinds else ""

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append(("/".join(x[1] for x in self._stack), self._kind(), text, self._linked))
                self._within.append([x[3] for x in self._stack if x[2] == "named"])
            self._text, self._linked = [], 0

    def _pop(self, k: int) -> None:
        self._flush()
        del self._stack[k:]

    def _innermost(self, name: str, within: tuple[str, ...] = ()) -> int:
        """Where the innermost open element of that name stands, or -1; one of `within` ends the search."""
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                return k
            if self._stack[k][0] in within:
                break
        return -1

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            m = TAG.search(s, at)
            # A "<" that starts no tag is text.
            end = m.start() if m else n
            if end > at:
                self._text.append(s[at:end])
                if self._link:
                    self._linked += end - at
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._text.append(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            else:
                at = self._open(name, m[3], s, at)
        self._flush()

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = max(0, self._link - 1)
        elif name in BLOCK:
            k = self._innermost(name)
            self._flush()
            if k >= 0:
                self._pop(k)

    def _open(self, name: str, attributes: str, s: str, at: int) -> int:
        if name in RAW:
            if attributes.rstrip().endswith("/"):
                return at
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(s, at)
            return m.end() if m else len(s)
        if name == "br":
            self._text.append(" ")
        elif name == "a":
            self._link += 1
        elif name in BLOCK:
            self._flush()
            if name in CLOSES_P and (k := self._innermost("p", ("button", "td", "th"))) >= 0:
                self._pop(k)
            if name in LIKE and (k := self._innermost(name, LIKE[name])) >= 0:
                self._pop(k)
            if name not in VOID:
                token, kind = role_of(name, attributes)
                if kind == "main":
                    self._holds.update(x[3] for x in self._stack if x[2] == "named")
                self._opened += 1
                self._stack.append((name, token, kind, self._opened))
                self._link = 0 if name in ("article", "main", "body") else self._link
        return at


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def container(role: str) -> str:
    """A block's container: its path without the closing list, table and text elements."""
    parts = role.split("/")
    while len(parts) > 1 and parts[-1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption", "hgroup", "header"):
        parts.pop()
    return "/".join(parts)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


PARSED = "page_id {}, url string, host string, content long, roles array<string>, mains array<boolean>, texts array<string>, keys array<long>, free array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """The written blocks that may be content, a list per page; `content` is their hash: equal on copies of a page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                c = b.slice(at, 200)
                pages_ = [[x for x in Page(source).blocks if x[1] != "not"] for source in c.column(3).to_pylist()]
                keys = [[text_key(x[2]) for x in blocks] for blocks in pages_]
                content = [text_key("\0".join(f"{x[0]}\0{x[2]}" for x in blocks)) for blocks in pages_]
                yield pa.RecordBatch.from_arrays(
                    [
                        *c.columns[:3],
                        pa.array(content, pa.int64()),
                        pa.array([[x[0] for x in blocks] for blocks in pages_], pa.list_(pa.string())),
                        pa.array([[x[1] == "main" for x in blocks] for blocks in pages_], pa.list_(pa.bool_())),
                        pa.array([[x[2] for x in blocks] for blocks in pages_], pa.list_(pa.string())),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array([[max(0, len(x[2]) - x[3]) for x in blocks] for blocks in pages_], pa.list_(pa.int32())),
                    ],
                    ["page_id", "url", "host", "content", "roles", "mains", "texts", "keys", "free"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return written(pages.select("page_id", "url", "host", "html").mapInArrow(read, PARSED.format(kind)), "blocks")


def below(role: str, root: str) -> bool:
    return not root or role == root or role.startswith(root + "/")


def nested(classes: list[list[dict]]) -> list[dict]:
    """A host's equivalence classes as template nodes, parents first: {"tokens": [[role, key, times]] in page order,
    "parent": node or -1, "slot": which of the parent's gaps it stands in}.

    A class stands in the innermost class of more pages whose elements enclose its own; the gap follows the mean position."""
    nodes = []
    for tokens in classes:
        texts = sorted((t for t in tokens if t["key"]), key=lambda t: (t["at"] / t["pages"], t["role"], t["key"]))
        if texts:
            paths = [t["role"].split("/")[:-1] for t in texts]
            common = 0
            while all(len(x) > common and x[common] == paths[0][common] for x in paths):
                common += 1
            nodes.append({"root": "/".join(paths[0][:common]), "pages": texts[0]["pages"], "places": [t["at"] / t["pages"] for t in texts], "tokens": [[t["role"], t["key"], -(-t["n"] // t["pages"])] for t in texts]})
    nodes.sort(key=lambda x: (-x["pages"], len(x["root"]), x["places"], x["tokens"]))
    for k, node in enumerate(nodes):
        outer = [i for i in range(k) if nodes[i]["pages"] > node["pages"] and below(node["root"], nodes[i]["root"])]
        node["parent"] = max(outer, key=lambda i: (len(nodes[i]["root"]), i), default=-1)
        node["slot"] = sum(x < node["places"][0] for x in nodes[node["parent"]]["places"]) if outer else 0
    return [{k: node[k] for k in ("tokens", "parent", "slot")} for node in nodes]


def constant_blocks(roles: list[str], keys: list[int], nodes: list[dict]) -> set[int]:
    """The blocks that are tokens of the template, each node read within its gap of its parent."""
    where: dict[tuple[str, int], list[int]] = {}
    for k, key in enumerate(zip(roles, keys, strict=True)):
        where.setdefault(key, []).append(k)
    out: set[int] = set()
    gaps: list[list[tuple[int, int]]] = []
    for node in nodes:
        lo, hi = gaps[node["parent"]][node["slot"]] if node["parent"] >= 0 else (0, len(roles))
        at, cuts = lo, []
        for role, key, times in node["tokens"]:
            found = [k for k in where.get((role, key), ()) if lo <= k < hi and k not in out][:times]
            out.update(found)
            at = max(at, found[0]) if found else at
            cuts.append(at)
        edges = [lo, *cuts, hi]
        gaps.append(list(zip(edges, edges[1:], strict=False)))
    return out


def templates(blocks: DataFrame) -> DataFrame:
    """(host, template) from parsed pages: the template as JSON {"main": content container, "nodes": nested()}.

    Copies of a page count once in the occurrence vectors. Hosts of fewer than LEAST_PAGES different pages have none."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str, int], list[int]] = {}
            for host, content, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = xxhash.xxh3_64_intdigest(f"{content}")
                x, y = h & 0x3FFFFFFF, h >> 34
                count: dict[tuple[str, int], list[int]] = {("", 0): [1, 0, 0]}
                for at, (role, text, free) in enumerate(zip(page["roles"], page["keys"], page["free"], strict=True)):
                    for key in ((container(role), 0), (role, text)):
                        v = count.setdefault(key, [0, 0, at])
                        v[0] += 1
                        v[1] += free
                for (role, key), (n, free, at) in count.items():
                    v = seen.setdefault((host, role, key), [0, 0, 0, 0, 0, 0])
                    for k, z in enumerate((1, n, n * x, n * y, free, at)):
                        v[k] += z
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(6)],
                ["host", "role", "key", "pages", "n", "x", "y", "free", "at"],
            )

    schema = "host string, role string, key long, pages long, n long, x long, y long, free long, at long"
    different = blocks.groupBy("host", "content").agg(F.min(F.struct("roles", "keys", "free")).alias("page"))
    vectors = different.mapInArrow(tokens, schema).groupBy("host", "role", "key").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "x", "y", "free", "at")))
    vectors = written(vectors.where((F.col("pages") > 1) | (F.col("key") == 0)), "vectors")
    size = vectors.where("role = ''").select("host", F.col("pages").alias("all_pages"))
    enough = (F.col("pages") >= SUPPORT * F.col("all_pages")) & ((F.col("key") == 0) | (F.col("pages") >= LEAST_PAGES))
    valid = vectors.where("role <> ''").join(size, "host").where((F.col("all_pages") >= LEAST_PAGES) & enough)
    # Equivalence classes: tokens of one occurrence vector. A host's valid tokens are few: each is on half of its pages.
    classes = valid.groupBy("host", "pages", "x", "y").agg(F.collect_list(F.struct("role", "key", "n", "free", "pages", "at")).alias("tokens"))

    def nest(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_ = [tokens_ for b in groups for tokens_ in b.column("tokens").to_pylist()]
        rank = lambda t: (any(x.split(".")[0] in MAIN for x in t["role"].split("/")), t["free"], -len(t["role"]), t["role"])
        best = max((t for c in classes_ for t in c if not t["key"]), key=rank, default={"role": ""})
        out = json.dumps({"main": best["role"], "nodes": nested(classes_)})
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([out])], ["host", "template"])

    return classes.select("host", "tokens").groupBy("host").applyInArrow(nest, "host string, template string")


def slot_text(roles: list[str], mains: list[bool], texts: list[str], keys: list[int], free: list[int], template: dict | None) -> str:
    """The blocks of the content slot that are no tokens of the template, joined by line feeds; "" without any."""
    if any(mains):  # the page names its slot itself
        kept = [k for k, main in enumerate(mains) if main]
    else:
        boxes = [container(role) for role in roles]
        root = (template or {}).get("main")
        if root not in boxes:
            sums: dict[str, int] = {}
            for box, n in zip(boxes, free, strict=True):
                sums[box] = sums.get(box, 0) + n
            root = max(sums, key=lambda r: (sums[r], r), default="")
        whole = not root or root.split("/")[-1] in ("body", "html")
        kept = [k for k, role in enumerate(roles) if whole or below(role, root)]
    constant = constant_blocks(roles, keys, template["nodes"]) if template else ()
    return "\n".join(texts[k] for k in kept if k not in constant)


def main_text(source: str | None, template: dict | None) -> str:
    """slot_text() of one page."""
    blocks = [b for b in Page(source).blocks if b[1] != "not"]
    return slot_text([b[0] for b in blocks], [b[1] == "main" for b in blocks], [b[2] for b in blocks], [text_key(b[2]) for b in blocks], [max(0, len(b[2]) - b[3]) for b in blocks], template)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars: one row per page. Null or empty html gives an empty text; a null url is the host "".

    Templates are broadcast up to broadcast_bytes; beyond, pages join them by host and salt, so no host is one task. Repeated
    rows give repeated rows, an empty table none; other columns are left out, whatever their names."""
    rows = parsed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url"))))
    found = written(templates(rows), "templates")
    if found.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0)).alias("n")).first()["n"] <= broadcast_bytes:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        spread = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "_salt"], "left")
    known: dict[str, dict] = {}

    @F.arrow_udf("string")
    def text(template: pa.Array, *columns: pa.Array) -> pa.Array:
        out = []
        for t, *page in zip(template.to_pylist(), *(c.to_pylist() for c in columns), strict=True):
            if t is not None and t not in known:
                if len(known) > 5_000:
                    known.clear()
                known[t] = json.loads(t)
            out.append(slot_text(*page, known[t] if t is not None else None))
        return pa.array(out, pa.string())

    return joined.select("page_id", "url", text("template", "roles", "mains", "texts", "keys", "free").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
