"""Main text of HTML pages by site style trees.

The DOMs of a host's pages are merged: equal paths of labels (tag, and words of class, id and role) are one node.
A node with text has a content importance: one minus the mean entropy of its texts over the pages
that hold it, so texts met on every page weigh nothing and texts of one page weigh all. An
inner node has a presentation importance: the entropy of its child sequences, mixed with its
children's. Hosts with few pages lean on the tree of all hosts. Labels are priors: those of menus, notices, adverts
and the like hold a node's importance at zero, but a name that only has such a word among others lowers it, and html, body
and elements that hold most of a page's text have no such labels; plain blocks of an article are raised, the less
the more pages show them. Branches below the threshold are taken out of every page of the host.

Nodes on fewer than ``RARE`` pages of all, such as those under generated ids and classes, are no template: they
count as importance 1 in their parent and each page decides by itself about its own, by their labels. Their texts are
counted over the whole host, whatever their path, and those that most of its pages show go.

Counting needs one row for each host, node and different text, combined before the shuffle. A host's nodes meet in one
task, which is bounded by the templates since rare nodes come as one sum a parent; pages are not
shuffled unless the table of removed paths, one row a host, is too large for Spark to broadcast.
"""

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .common import fresh, without
from .kernels import slices
from .url_cascade import host_and_path

THRESHOLD = 0.4
#: Weight of the tree of all hosts, in pages.
BACK_OFF = 20
#: Nodes on fewer pages of the whole table than this are no part of a template.
RARE = 5
#: Base of the weight between a node's own presentation and its children.
GAMMA = 0.9

# Fixed vocabulary of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style xmp iframe noembed noframes noscript template svg math".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set("table ul ol dl article main section div nav aside footer header form body html".split())

#: Factor of a name that has a word of noise among others, such as page-with-nav.
COMPOUND = 0.6
#: Least weight of the prior of an article's plain blocks, and the pages that it counts as.
MAIN_LEAST, MAIN_PAGES = 0.2, 3
#: Mean share of a page's text from which the labels of an element are no noise.
MOST = 0.5

#: Labels of parts that are no main text, and those that are noise only outside an article.
NOISE_TAGS = set("head nav footer aside form button select textarea dialog menu object canvas audio video title".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay menu navbar nav navigation breadcrumb breadcrumbs sidebar rail widget related recommended footer comments comment commentlist "
    "respond replies reply disqus share sharing social newsletter subscribe signup login search pagination pager copyright legal disclaimer hidden "
    "toolbar complementary contentinfo dialog".split()
)
OUTSIDE_NOISE = set("header masthead banner topbar".split())
_NOISY = NOISE_WORDS | OUTSIDE_NOISE
_MAIN = {"article", "main"}
#: Tags that are no main text however much of the text they hold, and words that only say where or how a part is.
_NEVER = set("head title nav button select textarea".split())
_PLACES = set("area bar block body bottom box inner item items left links list outer posts right row top wrapper".split())

_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _label(tag: str, attributes: str) -> str:
    """Tag and words; a word of noise has a ``~`` if other words in its name say that it is not the whole of it."""
    words = set()
    if attributes and not attributes.isspace():
        for name, value in _ATTR.findall(attributes):
            name = name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                words.add("hidden")
            elif name in ("class", "id", "role"):
                for part in value.strip("\"'").split():
                    found = _WORD.findall(_CAMEL.sub(" ", part).lower())
                    whole = "".join(found)  # side-bar is a sidebar
                    if whole in _NOISY or all(w in _NOISY or w in _PLACES for w in found):
                        words.update(found)
                        words.update({whole} & _NOISY)
                    else:
                        words.update("~" + w if w in _NOISY else w for w in found)
    return ".".join([tag, *sorted(words)])


def blocks_of(html: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Text blocks ``(path, text)`` in page order, and elements ``(path, labels of the children)``.

    Inline tags do not part blocks and are no nodes unless they have a class of noise. White space in a
    block is one blank; character references are decoded. Comments, declarations and the
    content of scripts, styles and the like are no text; an unfinished tag at the end is dropped.
    """
    blocks, elements = [], []
    stack = [["", "", []]]  # tag, path, labels of the children
    text: list[str] = []

    def flush():
        if text:
            found = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if found:
                blocks.append((stack[-1][1], found))

    def pop():
        _, path, labels = stack.pop()
        elements.append((path, ",".join(labels)))

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        if lt > at:
            text.append(html[at:lt])
        following = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif following in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif following == "/" and html[lt + 2 : lt + 3].isalpha():
            end = html.find(">", lt)
            if end < 0:
                break
            tag, at = html[lt + 2 : end].split(maxsplit=1)[0].lower().rstrip("/"), end + 1
            depth = len(stack) - 1
            while depth and stack[depth][0] != tag and not (tag in _INLINE and stack[depth][0] not in _INLINE):
                depth -= 1
            if depth and stack[depth][0] == tag:
                flush()
                while len(stack) > depth:
                    pop()
            elif tag not in _INLINE:
                flush()
        elif following.isalpha():
            m = _TAG.match(html, lt)
            if m:
                tag, attributes, at = m[1].lower(), m[2], m.end()
            else:  # a quote without end
                end = html.find(">", lt)
                if end < 0:
                    break
                parts = html[lt + 1 : end].split(maxsplit=1)
                tag, attributes, at = parts[0].lower(), "", end + 1
            if tag in _RAW:
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    at = n if not end else (html.find(">", end.start()) + 1 or n)
                continue
            if tag in _INLINE and (tag in _VOID or not attributes.strip()):
                continue
            label = _label(tag, attributes)
            if tag in _INLINE and not NOISE_WORDS.intersection(w.lstrip("~") for w in label.split(".")[1:]):
                continue
            flush()
            if tag in _VOID:
                continue
            while stack[-1][0] == "p" and tag not in _INLINE:
                pop()
            ends = _CLOSES.get(tag)
            if ends:
                depth = len(stack) - 1
                while depth and stack[depth][0] not in ends and stack[depth][0] not in _SCOPES:
                    depth -= 1
                if stack[depth][0] in ends:
                    while len(stack) > depth:
                        pop()
            stack[-1][2].append(label)
            stack.append([tag, f"{stack[-1][1]}/{label}", []])
        else:
            text.append("<")
            at = lt + 1
    flush()
    while len(stack) > 1:
        pop()
    return blocks, elements


def _bounds(path: str, wide=()) -> tuple[float, float]:
    """Prior of an article's plain blocks (1, else 0), and the factor of the noise in the labels of a path; elements in ``wide`` hold most of the text."""
    inside, plain, factor, at = False, True, 1.0, ""
    for label in path.strip("/").split("/"):
        at += "/" + label
        tag, *words = label.split(".")
        noise = NOISE_WORDS if inside else _NOISY
        if tag in _NEVER:
            return 0.0, 0.0
        if tag not in ("html", "body") and at not in wide:
            if tag in NOISE_TAGS or tag == "header" and not inside or noise.intersection(words):
                return 0.0, 0.0
            if noise.intersection(w[1:] for w in words if w[0] == "~"):
                factor *= COMPOUND
        if tag in _MAIN or "main" in words:
            inside, plain = True, True
        elif words and tag != "p" and not tag.startswith("h"):
            plain = False
    return float(inside and plain), factor


def _shares(blocks: list[tuple[str, str]], paths) -> dict[str, float]:
    """For each path, the share of the page's text that lies in it, menus and the like left out."""
    chars = dict.fromkeys(paths, 0)
    for path, text in blocks:
        chars[path] += len(text)
    for path in list(chars):
        if chars[path] and not _NEVER.isdisjoint(x.partition(".")[0] for x in path.split("/")):
            chars[path] = 0
    total = sum(chars.values()) or 1
    for path in sorted(chars, key=len, reverse=True):
        if path:
            up = path.rpartition("/")[0]
            chars[up] = chars.get(up, 0) + chars[path]
    return {path: n / total for path, n in chars.items()}


def _counts(pages: DataFrame, host: str) -> DataFrame:
    """``host, path, kind, feature, f, f_log``: texts (t), child sequences (s) and page counts (p, with the text's shares as ``f_log``) of the nodes, and the host's pages (n)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for name, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    own: dict[tuple, int] = {}
                    blocks, elements = blocks_of(html or "")
                    for path, text in blocks:
                        key = (path, "t", xxhash.xxh3_64_intdigest(text))
                        own[key] = own.get(key, 0) + 1
                    for path, labels in elements:
                        key = (path, "s", xxhash.xxh3_64_intdigest(labels))
                        own[key] = own.get(key, 0) + 1
                    paths = {k[0] for k in own}
                    shares = _shares(blocks, paths)
                    rows += [(name, *k, f, 0.0) for k, f in own.items()]
                    rows += [(name, path, "p", 0, 1, shares[path]) for path in paths]
                    rows.append((name, "", "n", 0, 1, 0.0))
                columns = list(zip(*rows)) if rows else [()] * 6
                f = np.array(columns[4], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
                        pa.array(np.array(columns[3], np.uint64).view(np.int64)), pa.array(f),
                        pa.array(np.where(np.array(columns[2], object) == "p", np.array(columns[5], np.float64), f * np.log(np.maximum(f, 1)))),
                    ],
                    names=["host", "path", "kind", "feature", "f", "f_log"],
                )

    rows = pages.select(F.col(host).alias("host"), F.col("html").cast("string").alias("html"))
    made = rows.mapInArrow(run, "host string, path string, kind string, feature long, f double, f_log double")
    return made.groupBy("host", "path", "kind", "feature").agg(F.sum("f").alias("f"), F.sum("f_log").alias("f_log"))


def _entropy() -> Column:
    """Of a feature over the pages, in nats."""
    return F.log("f") - F.col("f_log") / F.col("f")


def _importance(counts: DataFrame, by) -> DataFrame:
    """Per node: pages ``m``, content importance ``content`` (null without text), presentation ``style``, number of styles ``styles``, mean ``held`` of the shares of the pages' text."""
    counts = counts.groupBy(*by, "kind", "feature").agg(F.sum("f").alias("f"), F.sum("f_log").alias("f_log"))
    entropy = _entropy()
    node = counts.groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == "p", F.col("f"))).alias("m"),
        F.sum(F.when(F.col("kind") == "p", F.col("f_log"))).alias("held"),
        F.avg(F.when(F.col("kind") == "t", entropy)).alias("text_entropy"),
        F.sum(F.when(F.col("kind") == "s", F.col("f"))).alias("shown"),
        F.sum(F.when(F.col("kind") == "s", F.col("f") * F.log("f"))).alias("shown_log"),
        F.count(F.when(F.col("kind") == "s", 1)).alias("styles"),
    )
    log_m = F.log("m")
    content = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("text_entropy") / log_m)).otherwise(1.0)
    style = F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("shown") - F.col("shown_log") / F.col("shown")) / log_m)).otherwise(1.0)
    return node.filter("m > 0").select(*by, "m", F.when(F.col("text_entropy").isNotNull(), content).alias("content"), F.coalesce(style, F.lit(0.0)).alias("style"), "styles", (F.col("held") / F.col("m")).alias("held"))


def _low_paths(nodes: pd.DataFrame) -> tuple[list[str], list[str], list[str]]:
    """From one host's nodes the paths with text below the threshold, and those of noisy labels that hold most of the text and that don't.

    ``rare`` counts the pages of a node's rare children.
    """
    nodes = nodes.sort_values("path", ascending=False, key=lambda p: p.str.count("/"), kind="stable")
    below: dict[str, list] = {}
    found, wide = {}, set()
    for r in nodes.itertuples():
        share = r.m / (r.m + BACK_OFF)
        own = share * r.content + (1 - share) * r.all_content if r.content == r.content else None
        style = share * r.style + (1 - share) * r.all_style
        parts = below.pop(r.path, []) + ([(1.0, r.rare)] if r.rare else [])
        inner = parts + ([(own, r.m)] if own is not None else [])
        mean = sum(v * w for v, w in inner) / sum(w for _, w in inner) if inner else 0.0
        keep = GAMMA ** max(1, r.styles)
        composite = own if own is not None and not parts else (1 - keep) * style + keep * mean
        below.setdefault(r.path.rpartition("/")[0], []).append((composite, r.m))
        found[r.path] = (own, composite, r.all_m)
        if share * r.held + (1 - share) * r.all_held > MOST:
            wide.add(r.path)
    low = []
    for path, (own, composite, pages) in found.items():
        if own is None:
            continue
        parent = found.get(path.rpartition("/")[0], (None, composite, 0))[1]
        main, factor = _bounds(path, wide)
        weight = main * max(MAIN_LEAST, MAIN_PAGES / (pages + MAIN_PAGES))
        if factor * (weight + (1 - weight) * (0.75 * own + 0.25 * parent)) < THRESHOLD:
            low.append(path)
    noisy = {path for path in found if _bounds(path)[1] < 1}
    return sorted(low), sorted(wide & noisy), sorted(noisy - wide)


def low_branches(pages: DataFrame, host: str) -> DataFrame:
    """``host, paths, wide, tight, texts``: what to take out of each host's pages, and what these need to decide about rare nodes.

    ``paths`` are the templates' low nodes; ``wide`` and ``tight`` those with noise in their labels that hold most of the text and that
    don't; ``texts`` the hashes of texts that most pages show under rare paths.
    """
    counts = stage(_counts(pages, host))
    everywhere = _importance(counts, ["path"]).filter(F.col("m") >= RARE)
    everywhere = stage(everywhere.select("path", F.col("content").alias("all_content"), F.col("style").alias("all_style"), F.col("m").alias("all_m"), F.col("held").alias("all_held")))
    rare = counts.join(everywhere.select("path"), "path", "left_anti")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    children = rare.filter("kind = 'p' and path <> ''").groupBy("host", parent.alias("path")).agg(F.sum("f").alias("rare"))
    nodes = _importance(counts, ["host", "path"]).join(everywhere, "path").join(children, ["host", "path"], "left").fillna(0.0, ["rare"])

    def decide(pdf):
        paths, wide, tight = _low_paths(pdf)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "paths": [paths], "wide": [wide], "tight": [tight]})

    lists = nodes.groupBy("host").applyInPandas(decide, "host string, paths array<string>, wide array<string>, tight array<string>")
    n = counts.filter("kind = 'n'").select(F.col("host").alias("of"), F.col("f").alias("n"))
    texts = rare.filter("kind = 't'").groupBy("host", "feature").agg(F.sum("f").alias("f"), F.sum("f_log").alias("f_log")).filter("f > 1")
    texts = texts.join(n, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > 1)
    shown = F.col("n") / (F.col("n") + BACK_OFF) * _entropy() / F.log("n")
    texts = texts.filter(1 - shown < THRESHOLD).groupBy("host").agg(F.collect_list("feature").alias("texts"))
    return lists.join(texts, "host", "full_outer")


def _main_blocks(html: str, paths, wide, tight, texts) -> list[str]:
    """A page's texts but for those of its host's low nodes; about rare nodes their labels and the host's repeated texts decide."""
    blocks = blocks_of(html)[0]
    low, shared = set(paths or ()), set(texts or ())
    seen = {path for path, _ in blocks} - low
    wide = {*(wide or ()), *(path for path, share in _shares(blocks, {path for path, _ in blocks}).items() if share > MOST)}
    wide.difference_update(tight or ())
    bounds = {path: _bounds(path, wide) for path in seen}
    out = []
    for path, text in blocks:
        main, factor = bounds.get(path, (0.0, 0.0))
        if factor >= THRESHOLD and (main or not shared or xxhash.xxh3_64_intdigest(text) not in shared):
            out.append(text)
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` (empty if there is none) and ``n_chars`` (its code points, long).

    White space in a block is one blank, blocks stand in page order with one blank between. A null html
    is empty. Pages with a null url, or one without ``://``, form a host of their own. Repeated rows count as pages of
    their own; other columns stay, ``text`` and ``n_chars`` are replaced.
    """
    pages = without(pages, "text", "n_chars")
    host, other, *lists = fresh(pages, "tree_host", "tree_other", "tree_low", "tree_wide", "tree_tight", "tree_texts")
    rows = pages.withColumn(host, host_and_path(F.col("url").cast("string"))[0])
    decided = stage(low_branches(rows, host)).select(F.col("host").alias(other), *(F.col(c).alias(name) for c, name in zip(["paths", "wide", "tight", "texts"], lists)))
    joined = rows.join(decided, F.col(host) == F.col(other), "left").drop(host, other)
    columns = [c for c in pages.columns if c != "html"]
    schema = T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("html"), "html", batch.column("html").cast(pa.large_string()))
            for part in slices(batch, "html"):
                texts = []
                for html, *known in zip(part.column("html").to_pylist(), *(part.column(c).to_pylist() for c in lists)):
                    texts.append(" ".join(_main_blocks(html or "", *known)))
                out = {c: part.column(c) for c in columns}
                yield pa.RecordBatch.from_pydict(out | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(run, schema)
