"""Registered queries of this folder, with SQL twins where SQL can say the same."""

from pyspark.sql import functions as F

from . import conversation_trie, decontamination
from . import line_dedup as lines
from . import mixing
from . import ngram_trie
from . import near_duplicates as nd
from . import quality_rules, rule_ensemble, sentence_spans, style_tree, whitening
from . import url_cascade as urls
from . import warc
from .common import LOWER, UPPER, WORDS, ship


def table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_superminhash(spark, sf_dir):
    return nd.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)



OP5_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end s from words),
classes as (select s, min(doc_id) node, len(s) n from sets where len(s) > 0 group by s),
items as (select node, n, unnest(s) x from classes),
shared as (select a.node a, b.node b, any_value(a.n) na, any_value(b.n) nb, count(*) c
  from items a join items b on a.x = b.x and a.node < b.node group by a.node, b.node),
links as (select a, b from shared where 100 * c >= 85 * (na + nb - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select node a, node b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
roots as (select a node, min(b) root from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(r.root, s.doc_id) component_id,
  s.doc_id = coalesce(r.root, s.doc_id) kept
from sets s left join classes c on s.s = c.s and len(s.s) > 0 left join roots r on r.node = c.node
"""

QUERIES = {"op5_superminhash": op5_superminhash}
SQL = {"op5_superminhash": OP5_SQL}


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs, least_chars=20, least_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = rf"""
with lines as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') k
  from (select doc_id, str_split(coalesce(text, ''), chr(10)) l from documents),
    lateral (select unnest(l) line, generate_subscripts(l, 1) i)),
repeated as (select k, max(doc_id) last from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.doc_id, l.i, l.line, r.k is not null and l.doc_id is distinct from r.last gone from lines l left join repeated r on l.k = r.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by doc_id
"""

QUERIES["op10_line_dedup"] = op10_line_dedup
SQL["op10_line_dedup"] = OP10_SQL


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), share=(3, 2))


OP9_SQL = rf"""
with recursive rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|7'), 1, 15) as bigint) draw from documents),
sources as (select source, cast(sum(size) as bigint) source_size, count(*) docs,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from rows group by source),
whole as (select cast(sum(source_size) as bigint) total from sources),
level as (
  select 0 step, 3 * total above, 2 * (select cast(sum(weight) as bigint) from sources) below from whole
  union all
  select step + 1, 3 * total - 2 * coalesce((select cast(sum(2 * source_size) as bigint) from sources s where s.weight * above > 2 * below * s.source_size), 0),
    2 * (select cast(sum(weight) as bigint) from sources s where s.weight * above <= 2 * below * s.source_size)
  from level, whole where step < (select count(*) from sources)),
last as (select * from level where below > 0 order by step desc limit 1),
wanted as (select source, source_size, docs, least(cast(weight * above as double) / cast(below as double), cast(2 * source_size as double)) target from sources, last),
placed as (select r.*, w.source_size, w.target, r.draw % cast(ceil(w.docs / 10000) as bigint) shard from rows r join wanted w on r.source is not distinct from w.source),
sized as (select source, shard, any_value(source_size) source_size, any_value(target) target, cast(sum(size) as bigint) cell_size,
    greatest(1, least(100, cast(ceil(cast(sum(size) as bigint) / 64) as bigint))) block from placed group by source, shard),
cells as (select source, shard, block, cast(ceil(cell_size / block) as bigint) blocks,
    case when source_size > 0 then target * cast(ceil(cell_size / block) as bigint) / source_size else 0.0 end votes from sized),
n as (select (cast(sum(cast(floor(votes * 1000) as bigint)) as bigint) + 500) // 1000 blocks from cells),
races as (select source, shard, k, votes / (2 * k + 1) quotient from (select *, unnest(range(0, 2 * blocks + 5)) k from cells)),
won as (select source, shard, count(*) quota from (select * from races qualify row_number() over (order by quotient desc, source nulls last, shard, k) <= (select blocks from n)) group by source, shard),
quota as (select c.source, c.shard, c.block, c.blocks, least(coalesce(w.quota, 0), 2 * c.blocks) quota,
    cast('0x' || substr(md5(coalesce(c.source, '') || '|' || c.shard || '|7'), 1, 15) as bigint) turn
  from cells c left join won w on c.source is not distinct from w.source and c.shard = w.shard),
ends as (select *, cast(sum(size) over (partition by source, shard order by draw, doc_id nulls first, size rows unbounded preceding) as bigint) word_end from placed),
parts as (select e.doc_id, e.draw, e.size, e.source_size, e.target, e.word_end, q.block, q.blocks, q.quota, q.turn,
    unnest(range((e.word_end - e.size) // q.block, (e.word_end - 1) // q.block + 1)) i
  from ends e join quota q on e.source is not distinct from q.source and e.shard = q.shard where e.size > 0),
taken as (select doc_id, size, source_size, target, word_end, any_value(quota // blocks * size)
    + sum(case when (i * 2147483647 + turn % blocks) % blocks < quota % blocks then least((i + 1) * block, word_end) - greatest(i * block, word_end - size) else 0 end) taken
  from parts group by doc_id, size, source_size, target, word_end)
select doc_id, cast(size as bigint) size, cast(source_size as bigint) source_size, target, cast(taken as bigint) taken from taken
union all select doc_id, 0, cast(source_size as bigint), target, 0 from placed where size = 0
"""

QUERIES["op9_mixing"] = op9_mixing
SQL["op9_mixing"] = OP9_SQL

#: Contract values: the url rules.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Parts of a host name, between dots and hyphens, that put it on the block list.
LISTED_PARTS = "adult|ads|bet|bets|casino|gambling|pills|porn|spam|viagra|xxx"
LISTED = f"(^|[.-])({LISTED_PARTS})([.-]|$)"


def op8_url_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urls.filter_urls(pages, URL_RULES, lambda host: host.rlike(LISTED))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _case(value):
    whens = []
    for host, path, verdict in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])):
        whens.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{host + path if value == 'rule' else verdict}'")
    return "case " + " ".join(whens) + " end"


OP8_SQL = rf"""
with a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') h from a),
c as (select page_id, translate(h, '{UPPER}', '{LOWER}') host, regexp_extract(substr(coalesce(rest, ''), length(h) + 1), '^[^?#]*') path from b)
select page_id, host, path, {_case("rule")} as rule,
  coalesce({_case("verdict")}, case when regexp_matches(host, '{LISTED}') then 'block' else 'allow' end) verdict from c
"""

QUERIES["op8_url_cascade"] = op8_url_cascade
SQL["op8_url_cascade"] = OP8_SQL


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("score")


def op7_rule_ensemble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_ensemble.classify(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


QUERIES |= {"op6_quality_rules": op6_quality_rules, "op7_rule_ensemble": op7_rule_ensemble}


def op2_sentence_spans(spark, sf_dir):
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark, sf_dir):
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_passages"))


QUERIES |= {"op2_sentence_spans": op2_sentence_spans, "op4_decontamination": op4_decontamination}


def op1_site_style_tree(spark, sf_dir):
    return style_tree.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_capture_index(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write_archive(pages, least_bytes=0)
    return warc.read_records(spark, archive.lookup(pages.select("url")))


QUERIES |= {"op1_site_style_tree": op1_site_style_tree, "op3_capture_index": op3_capture_index}


def op11_block_whitening(spark, sf_dir):
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector="embedding", most=32)


QUERIES["op11_block_whitening"] = op11_block_whitening


def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), stride=20, heads=4)


OP13_SQL = rf"""
with recursive turns as (
  select conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') t,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) n
  from conversations where conv_id is not null),
own as (select conv_id, list(t order by turn nulls first, sha256(t)) s, list(n order by turn nulls first, sha256(t)) w from turns group by conv_id),
steps as (
  select conv_id, cast(conv_id as varchar) c, 0 i, cast(4294967295 as bigint) x from own
  union all
  select conv_id, c, i + 1, case when i % 9 = 0 then xor(x, cast(ascii(substr(c, i // 9 + 1, 1)) as bigint))
    else xor(x >> 1, case when x % 2 = 1 then cast(3988292384 as bigint) else cast(0 as bigint) end) end
  from steps where i < 9 * length(c)),
heads as (select conv_id, cast(xor(x, cast(4294967295 as bigint)) % 4 as bigint) h from steps where i = 9 * length(c)),
rebuilt as (
  select o.conv_id, list_concat(coalesce(b.s, [])[1:h], o.s[h + 1:]) s, list_concat(coalesce(b.w, [])[1:h], o.w[h + 1:]) w
  from own o join heads using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 20),
prefixes as (select conv_id, len(s) n, s, w, unnest(range(0, len(s) + 1)) d from rebuilt),
nodes as (
  select s[1:d] p, d, min(conv_id) id, count(*) n_convs, max(case when d > 0 then w[d] else 0 end) words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d), '')) ends
  from prefixes group by s[1:d], d),
kids as (select p[1:d - 1] p, d - 1 d, count(*) n_children from nodes where d > 0 group by p[1:d - 1], d - 1),
known as (select n.*, coalesce(k.n_children, 0) n_children from nodes n left join kids k on n.d = k.d and n.p = k.p),
shared as (select *, unnest(range(0, d + 1)) k from known),
sums as (select p[1:k] p, k d, sum((n_convs - 1) * words) saved, count(*) filter (n_children = 0) leaves from shared group by p[1:k], k)
select n.id conv_id, n.d as depth, u.id parent_conv_id, n.n_convs, n.n_children, cast(s.leaves as bigint) n_leaves,
  cast(s.saved as bigint) saved_tokens, n.ends ends_sha256
from known n join sums s on s.d = n.d and s.p = n.p left join nodes u on n.d > 0 and u.d = n.d - 1 and u.p = n.p[1:n.d - 1]
"""

QUERIES["op13_conversation_trie"] = op13_conversation_trie
SQL["op13_conversation_trie"] = OP13_SQL


def op12_ngram_trie_join(spark, sf_dir):
    return ngram_trie.jaccard_components(table(spark, sf_dir, "documents"), percent=90, width=3)


OP12_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) end s from words),
classes as (select list_sort(s) s, min(doc_id) node, len(s) n from sets where len(s) > 0 group by list_sort(s), len(s)),
items as (select node, n, unnest(s) x from classes),
shared as (select a.node a, b.node b, any_value(a.n) na, any_value(b.n) nb, count(*) c
  from items a join items b on a.x = b.x and a.node < b.node group by a.node, b.node),
links as (select a, b from shared where 100 * c >= 90 * (na + nb - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select node a, node b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
roots as (select a node, min(b) root from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(r.root, s.doc_id) component_id
from sets s left join classes c on len(s.s) > 0 and list_sort(s.s) = c.s left join roots r on r.node = c.node
"""

QUERIES["op12_ngram_trie_join"] = op12_ngram_trie_join
SQL["op12_ngram_trie_join"] = OP12_SQL
