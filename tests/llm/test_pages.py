"""Operators on pages."""

import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outvote.llm import queries, style_tree, url_cascade, warc

from .conftest import by_sql, same_rows

PAGES = "page_id long, url string, html string"


def page(i, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p>";f({i})</script></head><body>'
        f'<header class="masthead">Site name</header><nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav>'
        f'<div class="cookie-notice">We use cookies</div><div id="side-bar" class="sidebar"><p>Popular</p></div>{body}{extra}'
        '<form action="/s"><input name="q"><button>Search</button></form><div class="adBox ads">Buy now</div><aside>More</aside>'
        f'<footer>&copy; site {i % 3}</footer></body></html>'
    )


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a</p>b<br>c<b>d</b>e", "a b cde"), ("<p>one<p>two", "one two"),
        ("<article>x <!-- y --> z<!-- open", "x z"), ("<article><p>a &amp; b&nbsp;c &#233; &am</p></article>", "a & b c é &am"), ("a < b <3 c", "a < b <3 c"),
        ("<p>cut <a href='x", "cut"), ("<script>no</script>yes<SCRIPT>no", "yes"), ("<p title='>'>a</p>", "a"), ("<ul><li>a<li>b</ul>c", "a b c"), ("</div></p>a", "a"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"), ("x" * 300_000, "x" * 300_000),
        ("<p title='hidden gem' data-class='ad' class=lead>a</p><p class='side-bar'>b</p><p Hidden>c</p>", "a"), ("<div " * 2000, ""), ("<div>" * 3000 + "deep", "deep"), ("<p class=\"unclosed>text</p>", "text"),
    ],
)
def test_blocks_of_one_page(html, text):
    found = style_tree.blocks_of(html or "")[0]
    assert " ".join(t for path, t in found if style_tree._bounds(path)[1] > 0) == text


def test_main_text_of_pages_with_every_kind_of_noise(spark):
    r = random.Random(1)
    prose = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 40)))
    rows, expected = [], {}
    copied = prose()
    for i in range(120):
        host = "one.example.com" if i < 60 else f"h{i % 20}.example.org" if i < 110 else None
        parts = [copied] if i % 4 == 0 else [prose() for _ in range(r.randint(1, 5))]
        head = prose()
        body = f"<article><h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in parts)
        body += '<div class="sponsored">Try this</div></article><section class="comments"><p>' + prose() + "</p></section>"
        rows.append((i, host and f"http://{host}/{i}", page(i, body, "<div class='zz'>Written by the same staff as ever</div>")))
        expected[i] = " ".join([head, *parts])
    out = {x["page_id"]: x for x in style_tree.extract_main_text(spark.createDataFrame(rows, PAGES).withColumn("tree_host", F.lit("clash")).withColumn("n_chars", F.lit(1))).collect()}
    for i in range(60):  # the host repeats the unlabelled block on all pages, so the tree takes it out
        assert out[i]["text"] == expected[i] and out[i]["n_chars"] == len(expected[i]) and out[i]["tree_host"] == "clash"
    for i in range(60, 120):
        assert out[i]["text"].startswith(expected[i]) and "Home" not in out[i]["text"] and "cookies" not in out[i]["text"]


def test_entropy_decides_over_labels(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(6)) for _ in range(n))
    rows, kept, gone = [], {}, ["Read our terms first", "Start", "Contact", "Buy now", "Popular"]
    for i in range(40):
        a, b, c = prose(40), prose(10), prose(60)
        menu = "<nav>Start</nav><div class='sidebar'>Popular</div>"
        body = f"<article class='post comments-open'><p>{a}</p><div class='text-and-related'>{b}</div></article>"
        rows.append((3 * i, f"http://layout.org/{i}", f"<html><body class='has-sidebar no-menu'>{menu}<div class='page-with-nav'>{body}</div></body></html>"))
        rows.append((3 * i + 1, f"http://form.org/{i}", f"<html><body><form>{menu}<div>{c}</div><p class='ads'>Buy now</p></form></body></html>"))
        notice = "<div>Read our terms first</div><ul><li>Start</li><li>Contact</li></ul>"
        rows.append((3 * i + 2, f"http://notice.org/{i}", f"<html><body><main>{notice}<p>{a}</p></main></body></html>"))
        kept |= {3 * i: f"{a} {b}", 3 * i + 1: c, 3 * i + 2: a}
    out = {x["page_id"]: x["text"] for x in style_tree.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert not [t for t in out.values() if any(g in t for g in gone)]
    assert out == kept


def test_generated_names_are_no_templates(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    prose = lambda n: " ".join(word(6) for _ in range(n))
    rows, kept = [], {}
    for i in range(60):
        a, b, c, d = prose(30), prose(12), prose(50), prose(9)
        notice = f"<div class='{word(12)}'>Read our terms first</div>"
        body = f"<main><section id='{word(9)}-guide'><p>{a}</p></section><section id='{word(9)}'>{b}</section></main>"
        noise = f"<div class='{word(12)}'><div class='ads'>{d}</div></div><section class='comments {word(9)}'><p>{prose(5)}</p></section>"
        rows.append((2 * i, f"http://many.org/{i}", f"<html><body>{notice}{body}{noise}</body></html>"))
        rows.append((2 * i + 1, f"http://wide.org/{i}", f"<html><body><div class='{word(12)} related'><p>{c}</p></div><div class='{word(11)} sidebar'>{d}</div></body></html>"))
        kept |= {2 * i: f"{a} {b}", 2 * i + 1: c}
    pages = spark.createDataFrame(rows, PAGES)
    out = {x["page_id"]: x["text"] for x in style_tree.extract_main_text(pages).collect()}
    assert out == kept
    for x in style_tree.low_branches(pages.withColumn("h", url_cascade.host_and_path(F.col("url"))[0]), "h").collect():
        assert not x["paths"] and not x["wide"] and len(x["texts"] or []) == (x["host"] == "many.org")


def test_rare_nodes_count_in_their_parents(spark):
    nodes = pd.DataFrame(
        [("/div", 40, None, 0.0, 1, 0.1, 0.0), ("/div/p", 40, 0.3, 0.0, 1, 0.1, 0.0)], columns=["path", "m", "content", "style", "styles", "held", "rare"]
    )
    for c in ("content", "style", "m", "held"):
        nodes[f"all_{c}"] = nodes[c]
    assert style_tree._low_paths(nodes)[0] == ["/div/p"]  # 0.75 * 0.3 + 0.25 * 0.9 * 0.3
    nodes.loc[0, "rare"] = 40.0  # 0.75 * 0.3 + 0.25 * 0.9 * 0.65
    assert style_tree._low_paths(nodes)[0] == ["/div/p"]
    nodes.loc[0, "rare"] = 400.0  # 0.75 * 0.3 + 0.25 * 0.9 * 0.94
    assert style_tree._low_paths(nodes)[0] == []


def test_main_text_of_odd_tables(spark):
    assert style_tree.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://a.b/c", "<article><p>only page</article>"), (2, "http://a.b/c", "<article><p>only page</article>")]
    got = style_tree.extract_main_text(spark.createDataFrame(rows, PAGES)).toPandas()
    assert sorted(got["text"]) == ["", "", "", "only page", "only page"]


def test_entropy_of_texts_and_styles(spark):
    rows = [(i, "http://a.b/", f"<div class='m'>same</div><div class='v'>{i}</div><ul>{'<li>x</li>' * (i % 2 + 1)}</ul>") for i in range(8)]
    counts = style_tree._counts(spark.createDataFrame(rows, PAGES).withColumn("h", F.lit("a.b")), "h")
    got = {x["path"]: x for x in style_tree._importance(counts, ["host", "path"]).collect()}
    assert got["/div.m"]["content"] == pytest.approx(0) and got["/div.v"]["content"] == pytest.approx(1)
    assert got["/ul"]["style"] == pytest.approx(np.log(2) / np.log(8)) and got["/ul"]["styles"] == 2 and got["/ul"]["content"] is None


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/ES/", "https://example.org/es/1?x#y", "https://a.example.org/en/1", "https://example.org/en/2",
    "http://x.com/de/", "http://x.com/fr/1", "http://x.com?de/", "http://com/de/x", "http://xcom/de/", "http://free-bets.example.net/en/1", "ftp://adult-x.example.com/fr/",
    "http://é.example.net/Ä", "http://casino.example.net#top", "http://x.com/de\n/y", "a://b://c/d", "http://example.org/es/",
]


def test_urls_equal_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (None, URLS[6])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "verdict", "cascade_a", "key")})
    out = url_cascade.filter_urls(df, queries.URL_RULES, lambda host: host.rlike(queries.LISTED))
    assert out.filter("cascade_a = 'clash' and key = 'clash'").count() == len(rows)
    same_rows(out.select("page_id", "host", "path", "rule", "verdict"), by_sql(queries.OP8_SQL, pages=(rows, "page_id bigint, url varchar")))
    assert url_cascade.filter_urls(df.limit(0), queries.URL_RULES, lambda host: host.rlike(queries.LISTED)).count() == 0


@pytest.mark.parametrize("n_listed, n_other", [(0, 50), (50, 0), (1, 5000), (3000, 3000), (4000, 40)])
def test_cascade_is_exact_over_its_universe(n_listed, n_other):
    r = np.random.default_rng(n_listed)
    h1, h2 = r.integers(0, 2**63, (2, n_listed + n_other), np.int64).view(np.uint64)
    listed = np.arange(n_listed + n_other) < n_listed
    levels = url_cascade.build_levels(h1, h2, listed)
    assert (url_cascade.is_listed(levels, h1, h2) == listed).all()
    assert len(levels) > 2 or min(n_listed, n_other) == 0 or n_listed == 1


def test_cascade_in_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 100)
    monkeypatch.setattr(url_cascade, "BROADCAST_BYTES", 200)
    keys = spark.range(1500).select(F.concat(F.lit("host"), "id").alias("key"), F.col("id"))
    cascade = url_cascade.Cascade(keys.select("key", (F.col("id") % 3 == 0).alias("listed")))
    assert cascade.n_shards == 15
    assert cascade.mark(keys, F.col("key")).filter("listed <> (id % 3 = 0)").count() == 0
    listed = keys.filter("id % 7 = 0").select("key")
    out = url_cascade.filter_urls(keys.select(F.concat(F.lit("http://"), "key").alias("url"), "id"), [], listed)
    assert out.filter("(verdict = 'block') <> (id % 7 = 0)").count() == 0


def test_cascade_hashes_are_not_functions_of_one_hash(spark):
    """What is hashed first parts the two; a number at the end would go on from one 64-bit hash of the key."""
    first, second = (str(h) for h in url_cascade._hashes(F.col("key")))
    assert first.index("1") < first.index("key") and second.index("2") < second.index("key")


# archives


def _records(rows, least=0):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, b in payload:
        if p is not None:
            last[b] = max(last.get(b, p), p)
    out = []
    for p, b in payload:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = b in last and last[b] != p and len(b) >= least
        out.append((p, len(b), digest, "revisit" if again else "response", last[b] if again else None))
    return pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


@pytest.fixture(scope="module")
def captures():
    r = random.Random(2)
    rows = [(i, f"http://h{r.randrange(9)}.example.com/{r.randrange(300)}?q={i % 2}#f", f"<p>{r.randrange(150)} é\r\n\r\n</p>") for i in range(700)]
    return rows + [(701, None, None), (702, "odd", ""), (703, "http://h.com", None), (None, "http://h.com/x", "<p>1 é\r\n\r\n</p>"), (None, None, "alone"), (3, rows[3][1], rows[3][2]), (704, "http://a\r\nb.c/", "y" * 500_000)]


@pytest.mark.parametrize("least", [0, 20])
def test_archive_round_trip(spark, captures, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK", 7)
    monkeypatch.setattr(warc, "ROLL_BYTES", 20_000)
    df = spark.createDataFrame(captures, PAGES).repartition(5).withColumns({c: F.lit("clash") for c in ("key", "digest", "p", "d")})
    archive = warc.write_archive(df, least)
    got = warc.read_records(spark, archive.lookup(df.select("url")))
    same_rows(got, _records(captures, least))


def test_lookup_finds_all_captures_of_a_key_and_reads_few_blocks(spark, captures, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    hot = [(10_000 + i, "http://hot.example.com/", f"<p>{i}</p>") for i in range(300)]  # one url in many blocks and index files
    df = spark.createDataFrame(captures + hot, PAGES).repartition(6)
    archive = warc.write_archive(df)
    assert len(archive.files) > 1
    asked = ["http://hot.example.com/", captures[0][1], "http://nobody.example/", captures[0][1]]
    got = archive.lookup(spark.createDataFrame([(u,) for u in asked], "url string"))
    found = {x["page_id"] for x in got.collect()}
    same = lambda u: (u or "").partition("#")[0]
    assert found == {p for p, u, _ in captures + hot if u and same(u) in {same(a) for a in asked}}
    system, top = warc._file_system(archive.base)
    index = warc.IndexFile(system, f"{top}/{archive.files[0][0]}")
    reads = []
    block = index._block
    index._block = lambda i: (reads.append(i), block(i))[1]
    list(index.captures(index.firsts[-1]))
    assert 0 < len(set(reads)) <= 2 + sum(f == index.firsts[-1] for f in index.firsts) < len(index.firsts)


def test_records_are_read_by_many_tasks(spark, captures, monkeypatch):
    """Also with adaptive execution, which joins partitions of few bytes unless their number is asked for."""
    df = spark.createDataFrame(captures, PAGES).repartition(4)
    archive = warc.write_archive(df)
    found = archive.lookup(df.select("url"))
    size = found.agg(F.sum("length")).first()[0]
    monkeypatch.setattr(warc, "READ_BYTES", size // 30)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    got = warc.read_records(spark, found)
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 20
    same_rows(got, _records(captures))


def test_empty_archive(spark):
    empty = spark.createDataFrame([], PAGES)
    archive = warc.write_archive(empty)
    assert warc.read_records(spark, archive.lookup(empty.select("url"))).count() == 0


def test_a_damaged_record_is_an_error():
    whole = warc.record(1, "http://a.b/", b"payload")
    assert warc.parse(whole)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(whole[:-3])
    with pytest.raises(ValueError):
        warc._record_row(warc._gzip(whole.replace(b"payload", b"Payload")))
