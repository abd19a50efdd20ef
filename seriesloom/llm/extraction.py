"""Main text of web pages: semantic containers and site templates are cut, the article stays.

Two sources of evidence. (1) What HTML says about a container: its tag, role, class and id name
menus, headers, footers, sidebars, notices, adverts, forms and comments. (2) What the site
repeats: the digest of each element subtree is counted per host over pages of different content, and subtrees
that recur on MANY pages are deleted. Inside an article this goes for CONTAINERS that hold at most half of its text,
counted over different articles, and they must be on one in RARE of the host's: so repeated sentences, paragraphs and
copied articles stay whole. A name counts inside an article only if none of its words is another one (`share-buttons`,
but not `entry-header` or `related-work`).

Defined results: null or empty html gives an empty text; a page without an article or main
element gives what is left of its body; a null url is a host of its own; repeated rows give
repeated results, and count as one page in the site counts; unclosed and stray tags are repaired; an
empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .html_tree import BLOCK, parse

MANY = 8
RARE = 10
INSIDE = 1  # stands for all articles of a page; keys of subtrees of articles are odd, others even
CONTAINERS = frozenset("div section ul ol dl table header details center address figure hgroup".split())
DROP = frozenset("head script style noscript template nav footer aside form button input select textarea iframe svg canvas object embed dialog menu search audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
# Names that containers of boilerplate carry in class or id, as whole words between - _ and spaces.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar side aside rail footer foot masthead topbar header cookie cookies consent gdpr notice notices newsletter subscribe signup share sharing social comment comments commentlist disqus respond replies related recommended popup modal overlay widget widgets toolbar pagination pager skip login paywall".split()
)
# Words that may stand beside those in the name of a container inside the article; with any other word it is the article's own.
BESIDE = frozenset("area bar block bottom box button buttons container count form group inline item items left links list panel right section slot thread top unit wrap wrapper".split())
_parts = re.compile(r"[^A-Za-z0-9]+")
_camel = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_white = re.compile(r"\s+")
KEEP = frozenset(("#root", "html", "body", "article", "main"))


def boilerplate(node: list, inside: bool) -> bool:
    """Does HTML itself name this element as no part of the main text?"""
    tag, attrs, _ = node
    if tag in DROP:
        return True
    if tag == "header":
        return not inside
    if tag in KEEP and not (tag == "article" and inside):
        return False
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    if not names or tag in ("h1", "p"):
        return False
    for name in names.split():
        words = {x.lower() for x in _parts.split(_camel.sub(" ", name)) if x}
        if words & NAMES and (not inside or words <= NAMES | BESIDE):
            return True
    return False


def digest(node: list) -> int:
    """Of a whole subtree: tags, classes and white-space-normalised texts, in order."""
    h = xxhash.xxh64()

    def walk(x):
        h.update(f"\x01{x[0]}\x02{x[1].get('class', '')}" if x[1] else f"\x01{x[0]}")
        for c in x[2]:
            if isinstance(c, str):
                if t := _white.sub(" ", c).strip():
                    h.update("\x03" + t)
            else:
                walk(c)
        h.update("\x04")

    walk(node)
    return h.intdigest() - (1 << 63)


def key(node: list, inside: bool) -> int:
    return digest(node) | 1 if inside else digest(node) & ~1


def articles(root: list) -> list[list]:
    """The article elements that stand in no boilerplate; else the main elements; else the whole."""
    found: dict[str, list] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for c in reversed(node[2]):
            if not isinstance(c, str) and not boilerplate(c, inside):
                tag = "main" if c[1].get("role", "").lower() == "main" else c[0]
                if tag in found:
                    found[tag].append(c)
                if tag != "article":
                    todo.append((c, inside or tag == "main"))
    found["article"].reverse()
    found["main"].reverse()
    for kind in ("article", "main"):
        if found[kind]:
            order: list = []

            def walk(x, wanted=tuple(map(id, found[kind])), order=order):
                for c in x[2]:
                    if not isinstance(c, str):
                        if id(c) in wanted:
                            order.append(c)
                        else:
                            walk(c)

            walk(root)
            return order
    return [root]


def candidates(root: list) -> list[list]:
    """Elements outside the article that could be site template: those HTML itself does not name already."""
    tops = {id(x) for x in articles(root)}
    held: set[int] = set()

    def holds(x) -> bool:
        any_ = id(x) in tops
        for c in x[2]:
            if not isinstance(c, str) and holds(c):
                any_ = True
        if any_:
            held.add(id(x))
        return any_

    whole = id(root) in tops
    if not whole:
        holds(root)
    out: list = []

    def walk(x):
        for c in x[2]:
            if isinstance(c, str) or id(c) in tops or boilerplate(c, False):
                continue
            if id(c) not in held and c[0] not in KEEP:
                out.append(c)
            walk(c)

    walk(root)
    return out


def parts(root: list) -> list[list]:
    """Containers of the article that could be site template: those HTML itself does not name, of at most half of its text."""
    out: list = []
    for top in articles(root):
        if top[0] == "#root":
            continue
        sizes: dict[int, int] = {}

        def size(x, sizes=sizes) -> int:
            n = sum(len(_white.sub("", c)) if isinstance(c, str) else 0 if boilerplate(c, True) else size(c) for c in x[2])
            sizes[id(x)] = n
            return n

        whole = size(top)

        def walk(x, whole=whole, sizes=sizes):
            for c in x[2]:
                if not isinstance(c, str) and id(c) in sizes:
                    if c[0] in CONTAINERS and 0 < 2 * sizes[id(c)] <= whole:
                        out.append(c)
                    walk(c)

        walk(top)
    return out


def main_text(root: list, templates: frozenset | set = frozenset()) -> str:
    """Blocks of the main text in page order, one to a line; subtrees whose digest is a template are deleted."""
    blocks: list[str] = []
    line: list[str] = []

    def end():
        if line:
            if text := _white.sub(" ", "".join(line)).strip():
                blocks.append(text)
            line.clear()

    def walk(node, inside, prune):
        for c in node[2]:
            if isinstance(c, str):
                line.append(c)
                continue
            if boilerplate(c, inside) or (prune is not None and c[0] not in KEEP and (not prune or c[0] in CONTAINERS) and key(c, prune) in templates):
                continue
            if c[0] == "br":
                line.append(" ")
            elif c[0] in BLOCK:
                end()
                walk(c, inside or c[0] in ("article", "main"), prune)
                end()
            else:
                walk(c, inside, prune)

    for top in articles(root):
        walk(top, top[0] != "#root", top[0] != "#root" if templates else None)
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, content, subtree: each page's template candidates once.

    page is a digest of url and html, content one of what counts as different: the html, and for a subtree of the article
    all its articles. A page with articles has a row of subtree INSIDE, by which those of a host are counted.
    """
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("content", pa.int64()), ("subtree", pa.int64())])

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "html"):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for url, page, html in zip(*(c.to_pylist() for c in b.columns)):
                    host, root = host_of(url), parse(html or "")
                    own = xxhash.xxh64((html or "").encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)
                    found = {(own, key(c, False)) for c in candidates(root)}
                    tops = articles(root)
                    if tops[0][0] != "#root":
                        main = digest(["#articles", {}, tops])
                        found |= {(main, INSIDE)} | {(main, key(c, True)) for c in parts(root)}
                    for content, x in sorted(found):
                        for column, v in zip(out, (host, page, content, x)):
                            column.append(v)
                if out[0]:
                    yield base.batch(schema, host=out[0], page=out[1], content=out[2], subtree=out[3])

    return base.arrow_map(pages.select("url", "_page", "html"), run, "host string, page long, content long, subtree long")


def extract(pages: DataFrame, many: int = MANY) -> DataFrame:
    """page_id, url, text of every page. A subtree is template where it is on `many` pages of a host."""
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = keyed.withColumn("_page", F.xxhash64("url", "html"))
    seen = base.stored(subtrees(keyed).distinct(), "subtrees")
    # count by content, so that copies of one page or article do not make its body a template
    count = seen.select("host", "subtree", "content").distinct().groupBy("host", "subtree").count().where(F.col("count") >= many)
    count = base.stored(count, "subtree-counts")
    hosts = count.where(F.col("subtree") == INSIDE).select("host", F.col("count").alias("articles"))
    common = count.where(F.col("subtree") != INSIDE).join(hosts, "host", "left").where((F.col("subtree").bitwiseAND(F.lit(1)) == 0) | (F.col("count") * RARE >= F.col("articles"))).select("host", "subtree")
    kill = base.stored(seen.join(common, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("templates")), "templates")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "html"):
                texts = [main_text(parse(h or ""), frozenset(t or ())) for h, t in zip(b.column("html").to_pylist(), b.column("templates").to_pylist())]
                yield base.batch(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts)

    joined = keyed.join(kill, keyed["_page"] == kill["page"], "left").select("page_id", "url", "html", "templates")
    return base.arrow_map(joined, run, "page_id long, url string, text string")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
