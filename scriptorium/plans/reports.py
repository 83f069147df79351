"""Queries that tabulate whole evaluations, overviews, concepts and small text rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import analytics as A
from ..operators import context as C
from ..operators import embed as M
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import index as I
from ..operators import packs as K
from ..operators import pages as P
from ..operators import search as S
from ..operators import views as V
from ..session import stored
from ..streaming import events as X
from . import graph, trends
from . import search as ranked
from .base import BM25, DENSE_EDGES, PAPERS, WS, benchmark, label_communities, lang_communities, papers, query_sql, shaped, slug_sql, squash_sql, table, terms_sql, text_edges_sql, tfidf_sql, top_sql, vectors, words_sql

QUERIES, SQL = {}, {}


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _systems(spark, d, graph: bool = True):
    """An engine with every index, the graph if asked, and titles of every fiftieth id with a vector as queries."""
    corpus = papers(spark, d)
    found = vectors(spark, d).join(corpus.select("pos"), "pos", "left_semi")
    queries = stored(corpus.where("pos % 50 = 0").join(found, "pos").select(F.col("pos").alias("q"), F.col("title").alias("text"), "v"), "queries")
    engine = ranked.engine(spark, d, queries, graph=graph)
    engine.vectors = found
    return engine, corpus, queries


_METHODS = ("tfidf", "bm25", "dense", "hybrid", "hybrid+graph")
_MEANS = ("precision", "recall", "reciprocal_rank", "ndcg")


def retrieval_table(spark, d):
    """The means of every method over the judgments pooled from all of them."""
    engine, corpus, queries = _systems(spark, d)
    runs = {m: stored(engine.search(m, queries, 50), "run") for m in _METHODS}
    seeds = queries.select("q", F.col("q").alias("pos"))
    qrels = stored(E.pooled_judgments(E.pool(list(runs.values()), 50, seeds), seeds, corpus), "qrels")
    found = _joined([E.metrics(r, qrels, queries, 10).withColumn("system", F.lit(m)) for m, r in runs.items()])
    means = found.groupBy("system").agg(*[F.avg(c).alias(c) for c in _MEANS])
    return shaped(means, "system:string", *[f"{c}:double" for c in _MEANS])


_ALL = f"""WITH {PAPERS}, {terms_sql("terms", "papers", "pos", "abstract", 2)}, {tfidf_sql()}, {terms_sql("uni", "papers", "pos", "abstract", 1)}, {text_edges_sql()},
ve AS MATERIALIZED (SELECT vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT pos FROM papers)),
bench AS (SELECT pos AS q, title AS text FROM papers WHERE pos % 50 = 0 AND pos IN (SELECT pos FROM ve)), {terms_sql("qbi", "bench", "q", "text", 2)}, {terms_sql("qterms", "bench", "q", "text", 1)},
{query_sql("qv", "tfidf", "qbi")}, tf_s AS MATERIALIZED (SELECT q, pos, sum(qv.w * tfidf.w) AS s FROM qv JOIN tfidf USING (term) GROUP BY q, pos), {BM25},
dn_s AS MATERIALIZED (SELECT x.pos AS q, y.pos, list_dot_product(x.v, y.v) AS s FROM ve x, ve y WHERE x.pos % 50 = 0),
{top_sql("tf_r", "tf_s", 50)}, {top_sql("bm_r", "bm_s", 50)}, {top_sql("dn_r", "dn_s", 50, False)}"""


def _fused(name: str, depth: int, k: int) -> str:
    parts = [top_sql(f"{name}_{x}", f"{x}_s", depth, x != "dn") for x in ("tf", "bm", "dn")]
    union = " UNION ALL ".join(f"SELECT q, pos, rank FROM {name}_{x}" for x in ("tf", "bm", "dn"))
    return f"{', '.join(parts)}, {name}_s AS (SELECT q, pos, sum(1 / (60 + rank)) AS s FROM ({union}) GROUP BY q, pos), {top_sql(name, f'{name}_s', k)}"


_RUNS = {"tfidf": "tf_r", "bm25": "bm_r", "dense": "dn_r", "hybrid": "hy", "hybrid+graph": "hg"}
SQL["retrieval_table"] = f"""{_ALL}, {_fused("hy", 250, 50)}, {_fused("h2", 500, 100)}, own AS (SELECT q, pos, rank, 1 / (60 + rank) AS s FROM h2),
nb AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges),
hg_s AS (SELECT q, pos, max(s) AS s FROM (SELECT q, pos, s FROM own UNION ALL SELECT q, dst, s * 0.9::DOUBLE FROM own JOIN nb ON pos = src WHERE rank <= 10) GROUP BY q, pos), {top_sql("hg", "hg_s", 50)},
pooled AS ({" UNION ".join(f"SELECT q, pos FROM {r}" for r in _RUNS.values())}),
qrels AS MATERIALIZED (SELECT q, p.pos, CASE WHEN a.source = b.source AND a.lang = b.lang THEN 3 WHEN a.source = b.source THEN 2 ELSE 0 END AS grade
  FROM pooled p JOIN papers a ON a.pos = p.q JOIN papers b ON b.pos = p.pos WHERE p.pos <> p.q),
met AS ({" UNION ALL ".join(ranked._metric_sql(m, r) for m, r in _RUNS.items())})
SELECT system, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS)} FROM met GROUP BY system"""


def ladder_table(spark, d):
    """Each tier's default method on known items: the share found first, and among ten."""
    engine, _, queries = _systems(spark, d, graph=False)  # no tier's default method reads edges, only whether there are any
    index, edges = engine.packs, partial(G.edges_around, engine.packs)
    tiers = [K.PackedEngine(None, *parts, packs=index, around=around) for parts, around in (((), None), ((index,), None), ((index,), edges), ((index, None, engine.vectors), edges))]
    qrels = queries.select("q", F.col("q").alias("pos"), F.lit(1).alias("grade"))
    rows, runs = [], {}
    for e in tiers:
        method = e.default_method()
        if method not in runs:
            runs[method] = stored(e.search(method, queries, 10), "run")
        run = runs[method]
        one, ten = E.metrics(run, qrels, queries, 1).select("q", F.col("precision").alias("p1")), E.metrics(run, qrels, queries, 10).select("q", F.col("recall").alias("r10"))
        rows.append(one.join(ten, "q").agg(F.avg("p1").alias("p1"), F.avg("r10").alias("r10")).withColumn("tier", F.lit(e.tier())))
    return shaped(_joined(rows), "tier:string", "p1:double", "r10:double")


_TIER = "SELECT '{}' AS tier, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS p1, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS r10 FROM bench b LEFT JOIN {} r ON r.q = b.q AND r.pos = b.q"
SQL["ladder_table"] = f"""{_ALL}, ln AS (SELECT pos, count(*) AS len FROM uni GROUP BY pos), ht AS (SELECT q, pos, count(*) AS hits FROM (SELECT DISTINCT q, term FROM qterms) JOIN (SELECT DISTINCT pos, term FROM uni) USING (term) GROUP BY q, pos),
t0_s AS (SELECT q, pos, hits + 1 / (1 + greatest(len, 1) / 1000) AS s FROM ht JOIN ln USING (pos)), {top_sql("t0_r", "t0_s", 10)}
{" UNION ALL ".join(_TIER.format(t, r) for t, r in (("T0", "t0_r"), ("T1", "tf_r"), ("T2", "tf_r"), ("T3", "dn_r")))}"""

_CONFIGS = ("flat tfidf", "flat hybrid", "hybrid + 1 hop", "hybrid + 2 hops", "dense")


def context_coverage(spark, d):
    """How much of a gold set the contexts of each configuration hold; papers with three gold documents or more ask."""
    corpus = papers(spark, d)
    asked = corpus.where("pos % 50 = 0").select(F.col("pos").alias("q"), "pos", F.col("abstract").alias("text"))
    gold = stored(ranked.gold(corpus), "gold")
    enough = gold.groupBy("q").agg(F.count("*").alias("golds")).where("golds >= 3")
    queries = asked.join(enough, "q", "left_semi").select("q", "text")
    engine = ranked.engine(spark, d, queries, graph=True)
    flat, hybrid = stored(engine.search("tfidf", queries, 50), "flat"), stored(engine.search("hybrid", queries, 50), "hybrid")
    coded = stored(M.embedded(corpus, M.HashedProjection(ranked.DIMS), "pos", "abstract"), "coded")
    dense = stored(S.dense_search(coded, coded.join(queries.select(F.col("q").alias("pos")), "pos", "left_semi").select(F.col("pos").alias("q"), "v"), 50), "dense")
    edges = engine.around(hybrid, 2)
    scores = [C.hop_scores(flat, None, 0), C.hop_scores(hybrid, None, 0), C.hop_scores(hybrid, edges, 1), C.hop_scores(hybrid, edges, 2), C.hop_scores(dense, None, 0)]
    keyed = _joined([s.withColumn("q", F.col("q") * 10 + i) for i, s in enumerate(scores)])
    keyed = stored(keyed, "scores")
    counted = trends._of(corpus, keyed).select("pos", T.word_count("abstract").alias("words"))
    held = C.assemble(keyed, counted).select(F.floor(F.col("q") / 10).alias("q"), (F.col("q") % 10).alias("c"), "pos")
    met = held.join(lang_communities(spark, d), "pos").join(gold.select("q", "pos", F.lit(1).alias("gold")), ["q", "pos"], "left")
    each = met.groupBy("q", "c").agg(F.count("gold").alias("hits"), F.countDistinct("community").alias("communities"), F.count("*").alias("docs"))
    every = enough.select("q", "golds", F.explode(F.array(*[F.lit(i) for i in range(len(_CONFIGS))])).alias("c")).join(each, ["q", "c"], "left").na.fill(0)
    means = every.groupBy("c").agg(F.avg(F.col("hits") / F.col("golds")).alias("coverage"), F.avg("communities").alias("communities"), F.avg("docs").alias("docs"))
    return shaped(means.withColumn("config", F.element_at(F.array(*[F.lit(c) for c in _CONFIGS]), F.col("c") + 1)), "config:string", "coverage:double", "communities:double", "docs:double")


_BENCH = "bench AS (SELECT item_id AS q, coalesce(text, '') AS text FROM benchmark)"
_ASKED = "bench AS (SELECT pos AS q, abstract AS text FROM papers JOIN en ON en.q = pos)"
_HOPS = """ow AS MATERIALIZED (SELECT q, pos, round(1 / (60 + rank), 12) AS s FROM fused), ad AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges),
p1 AS (SELECT q, dst AS pos, round(max(s) * 0.9::DOUBLE, 12) AS g FROM ow JOIN ad ON src = pos GROUP BY q, dst),
s1 AS MATERIALIZED (SELECT q, pos, CASE WHEN g > coalesce(s, 0) THEN g ELSE s END AS s, coalesce(g > coalesce(s, 0), false) AS fresh FROM ow FULL JOIN p1 USING (q, pos)),
p2 AS (SELECT q, dst AS pos, round(max(s) * 0.9::DOUBLE, 12) AS g FROM s1 JOIN ad ON src = pos WHERE fresh GROUP BY q, dst),
s2 AS (SELECT q, pos, CASE WHEN g > coalesce(s, 0) THEN g ELSE s END AS s FROM (SELECT q, pos, s FROM s1) FULL JOIN p2 USING (q, pos)),
sc AS MATERIALIZED (SELECT q * 10 AS q, pos, round(1 / (60 + rank), 12) AS s, false AS via FROM tf_r WHERE rank <= 50 UNION ALL SELECT q * 10 + 1, pos, s, false FROM ow UNION ALL SELECT q * 10 + 2, pos, s, false FROM s1 UNION ALL SELECT q * 10 + 3, pos, s, false FROM s2 UNION ALL SELECT q * 10 + 4, pos, round(1 / (60 + rank), 12), false FROM de_r)"""
_CODED = f"""dtk AS (SELECT id, md5(lower(t)) AS h, count(*) AS n FROM (SELECT pos AS id, unnest(regexp_extract_all(abstract, '[A-Za-z0-9]+')) AS t FROM papers) GROUP BY ALL),
dco AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % {ranked.DIMS} AS i, sum(n * (1 - 2 * (('0x' || substr(h, 9, 2))::BIGINT % 2))) AS x FROM dtk GROUP BY ALL),
dun AS MATERIALIZED (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM dco WHERE x <> 0),
dme AS (SELECT a.id AS q, b.id AS pos, sum(a.x * b.x) AS s FROM dun a JOIN en ON en.q = a.id JOIN dun b USING (i) GROUP BY ALL),
dsc AS (SELECT e.q, p.pos, coalesce(s, 0) AS s FROM en e CROSS JOIN papers p LEFT JOIN dme m ON m.q = e.q AND m.pos = p.pos), {top_sql("de_r", "dsc", 50, False)}"""
SQL["context_coverage"] = f"""WITH RECURSIVE {PAPERS}, gold AS MATERIALIZED ({ranked.SQL["gold_set"]}), en AS MATERIALIZED (SELECT q, count(*) AS golds FROM gold GROUP BY q HAVING count(*) >= 3),
{trends.fuse_sql(250, 50).replace(_BENCH, _ASKED)}, {text_edges_sql()}, {_CODED}, {trends._fold_sql(_HOPS)},
e AS (SELECT c.q // 10 AS q, c.q % 10 AS c, count(g.pos) AS hits, count(DISTINCT coalesce(list_position({graph._LANG}, lang), 0)) AS communities, count(*) AS docs
  FROM ctx c JOIN papers USING (pos) LEFT JOIN gold g ON g.q = c.q // 10 AND g.pos = c.pos GROUP BY ALL)
SELECT ({list(_CONFIGS)})[en_c.c + 1] AS config, round(avg(coalesce(hits, 0) / golds), 6) AS coverage, round(avg(coalesce(communities, 0)), 6) AS communities, round(avg(coalesce(docs, 0)), 6) AS docs
FROM (SELECT q, golds, unnest(range(5)) AS c FROM en) en_c LEFT JOIN e ON e.q = en_c.q AND e.c = en_c.c GROUP BY en_c.c"""


def overview_text(spark, d):
    """The overview of the documents, with gaps among the fields that gap_nodes uses."""
    first = F.slice("v", 1, 4)
    fields = vectors(spark, d).select("pos", (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("community"))
    labels = fields.groupBy("community").agg(F.count("*").alias("size")).withColumn("label", F.concat(F.lit("Field "), F.col("community").cast("string")))
    return shaped(P.overview("corpus", papers(spark, d), labels, graph._gaps(spark, d, fields)[1], trends.trend_rising_declining(spark, d)), "overview:string")


_MOVES = f"""mv AS MATERIALIZED ({trends.SQL["trend_rising_declining"]})"""
SQL["overview_text"] = f"""{graph._DENSE.replace('label AS community', graph._AXIS)}, {graph._GAPS}, {_MOVES},
fl AS (SELECT community, count(*) AS size FROM vec GROUP BY community),
g5 AS (SELECT * FROM gz WHERE z < -2 ORDER BY similarity DESC, a, b LIMIT 5)
SELECT (SELECT 'Project "corpus": ' || count(*) || ' papers, ' || min(2013 + doc_id % 14) || '-' || max(2013 + doc_id % 14) || '.' FROM documents) || chr(10) || chr(10)
  || (SELECT 'Largest communities:' || chr(10) || string_agg('- Field ' || community || ' (' || size || ' papers)' || chr(10), '' ORDER BY size DESC, community) || chr(10) FROM fl)
  || coalesce((SELECT 'Widest gaps (similarity of topics; z below 0 means fewer links than chance):' || chr(10) || string_agg(printf('- Field %d <-> Field %d (similarity %.2f, z %.2f)', a, b, similarity, z) || chr(10), '' ORDER BY similarity DESC, a, b) || chr(10) FROM g5), '')
  || coalesce((SELECT 'Rising terms: ' || string_agg(term, ', ' ORDER BY rank) || chr(10) FROM mv WHERE direction = 'rising'), '')
  || coalesce((SELECT 'Declining terms: ' || string_agg(term, ', ' ORDER BY rank) || chr(10) FROM mv WHERE direction = 'declining' AND rank <= 5), '') AS overview"""


def _concepts(spark, d):
    communities = lang_communities(spark, d)
    nodes = stored(V.snapshot_nodes(papers(spark, d), graph._ranked(spark, d)), "nodes")
    members = V.concept_members(nodes.select("pos", F.col("pos").alias("ord")), communities)
    terms = graph._top(spark, d)
    return nodes, members, stored(V.concept_nodes(nodes, terms, members), "concepts")


def concept_nodes(spark, d):
    """The concepts of the languages, beside the documents' nodes."""
    return shaped(_concepts(spark, d)[2], "id:string", "label:string", "community:bigint")


def appears_in_edges(spark, d):
    nodes, members, concepts = _concepts(spark, d)
    return shaped(V.appears_in(concepts, members, nodes), "src:string", "dst:string")


def concept_pages(spark, d):
    nodes, members, concepts = _concepts(spark, d)
    named = members.join(nodes.select("pos", F.col("id").alias("member")), "pos")
    listed = named.join(concepts.select("id", "community"), "community").select("id", "rank", "member", F.concat(F.lit("Paper "), F.col("pos").cast("string")).alias("label"))
    pages = P.concept_pages(concepts.select("id", F.col("label").alias("title"), F.col("community").cast("string").alias("cluster")), listed)
    return shaped(pages.select("id", F.md5("page").alias("digest"), F.length("page").alias("chars")), "id:string", "digest:string", "chars:bigint")


_CONCEPTS = f"""{graph._CENTROID}, nodes AS MATERIALIZED (SELECT pos, id FROM ({graph.SQL["snapshot_nodes"]})),
m12 AS (SELECT community, pos, r FROM (SELECT community, pos, row_number() OVER (PARTITION BY community ORDER BY pos) AS r FROM mem SEMI JOIN nodes USING (pos)) WHERE r <= 12),
cs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY community, rank) AS i FROM (SELECT community, rank, term, coalesce(nullif({slug_sql('term')}, ''), 'untitled') AS slug FROM top)),
tr AS (SELECT slug, k, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM (SELECT slug, unnest(range(1, 5000)) AS k FROM cs GROUP BY slug)),
fr AS (SELECT slug, id, row_number() OVER (PARTITION BY slug ORDER BY k) AS i FROM tr WHERE id NOT IN (SELECT id FROM nodes) AND (k = 1 OR id NOT IN (SELECT slug FROM cs))),
con AS (SELECT id, term AS label, community FROM cs JOIN fr USING (slug, i) SEMI JOIN m12 USING (community))"""
SQL["concept_nodes"] = f"{_CONCEPTS} SELECT id, label, community::BIGINT AS community FROM con"
SQL["appears_in_edges"] = f"{_CONCEPTS} SELECT con.id AS src, nodes.id AS dst FROM con JOIN m12 USING (community) JOIN nodes USING (pos)"
SQL["concept_pages"] = f"""{_CONCEPTS}, pg AS (SELECT con.id, printf('# %s', label) || chr(10) || chr(10) || printf('**Concept** in the *%s* community.', community::VARCHAR) || chr(10) || chr(10)
  || '## Appears in' || chr(10) || chr(10) || string_agg('- [[' || nodes.id || '|Paper ' || pos || ']]' || chr(10), '' ORDER BY r) || chr(10) AS page FROM con JOIN m12 USING (community) JOIN nodes USING (pos) GROUP BY con.id, label, community)
SELECT id, md5(page) AS digest, length(page) AS chars FROM pg"""


def pagerank_nodes(spark, d):
    """Snapshot nodes of the vectors by PageRank on the dense graph, half of them; their labels are the titles."""
    found = vectors(spark, d)
    titled = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("Field "), F.col("label").cast("string")).alias("title"))
    return shaped(V.snapshot_nodes(titled, G.pagerank(found, G.mutual_edges(G.dense_arcs(found)), 20), 250), "pos:bigint", "ord:bigint", "id:string")


_RANKED = graph.SQL["pagerank"].replace("round(rank, 6)", "round(rank, 9)")
SQL["pagerank_nodes"] = f"""WITH rk AS MATERIALIZED ({_RANKED}), top AS (SELECT pos, row_number() OVER (ORDER BY rank DESC, pos) AS ord, 'field-' || label AS slug FROM rk JOIN embeddings ON vec_id = pos QUALIFY ord <= 250),
i AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS i FROM top),
f AS (SELECT slug, k, row_number() OVER (PARTITION BY slug ORDER BY k) + 1 AS i FROM (SELECT DISTINCT slug, k FROM top, range(2, 600) r(k)) WHERE slug || '-' || k NOT IN (SELECT slug FROM top))
SELECT pos, ord, CASE WHEN i.i = 1 THEN slug ELSE slug || '-' || k END AS id FROM i LEFT JOIN f USING (slug, i)"""


def label_search(spark, d):
    """Parts whose name holds a word, whatever its case."""
    return shaped(V.label_matches(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label")), " Widget "), "p_partkey:bigint", "label:string")


SQL["label_search"] = "SELECT p_partkey, p_name AS label FROM part WHERE contains(lower(p_name), 'widget')"


def input_modes(spark, d):
    """Texts, their first words and lists of their words as they might be typed in."""
    corpus = papers(spark, d)
    head = F.regexp_extract("abstract", T.FIRST_WORDS.format(6), 0)
    kinds = (("text", F.col("abstract")), ("title", F.col("title")), ("list", F.array_join(T.words(head), ", ")), ("half", F.concat_ws(",", F.lit(" "), "title")))
    typed = corpus.select("pos", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("t")) for k, c in kinds])).alias("k")).select("pos", "k.*")
    return shaped(typed.select("pos", "kind", N.input_mode("t").alias("m")).select("pos", "kind", "m.*"), "pos:bigint", "kind:string", "mode:string", "valid:boolean", "counter:string")


SQL["input_modes"] = f"""WITH {PAPERS}, ty AS (SELECT pos, 'text' AS kind, abstract AS t FROM papers UNION ALL SELECT pos, 'title', title FROM papers UNION ALL SELECT pos, 'half', ' ,' || title FROM papers
  UNION ALL SELECT pos, 'list', array_to_string(list_filter(string_split_regex(abstract, {WS}), lambda x: x <> '')[1:6], ', ') FROM papers),
tt AS (SELECT pos, kind, regexp_replace(regexp_replace(t, '^' || {WS}, ''), {WS} || '$', '') AS t FROM ty),
pt AS (SELECT pos, kind, t, {words_sql('t')} AS n, list_filter(list_transform(string_split(t, ','), lambda x: {squash_sql('x')}), lambda x: x <> '') AS parts FROM tt),
md AS (SELECT *, CASE WHEN contains(t, ',') THEN len(parts) >= 1 AND len(list_filter(parts, lambda x: {words_sql('x')} > 6)) = 0 ELSE n <= 6 END AS short FROM pt)
SELECT pos, kind, CASE WHEN t = '' THEN 'empty' WHEN short THEN 'keywords' ELSE 'abstract' END AS mode, CASE WHEN t = '' THEN false WHEN short THEN len(parts) >= 5 ELSE n >= 100 END AS valid,
  CASE WHEN t = '' THEN '' WHEN short THEN len(parts) || ' / 5 keywords' ELSE n || ' / 100 words' END AS counter FROM md"""


#: What stands before each word of a made-up answer: a bullet, digits that stay, numbers that go.
_STYLES = ["\n* ", " 3d ", "\n2. '", " 5) "]


def parsed_keywords(spark, d):
    """The first words of each document and of each benchmark item, put as a model's answer in four styles."""
    texts = papers(spark, d).select("pos", "abstract").union(benchmark(spark, d).select(-1 - F.col("q"), "text"))
    style = F.element_at(F.array(*[F.lit(x) for x in _STYLES]), (F.pmod("pos", F.lit(len(_STYLES))) + 1).cast("int"))
    answer = F.concat(F.lit("Keywords:"), F.array_join(F.transform(F.slice(T.words("abstract"), 1, 7), lambda w: F.concat(style, w)), ","))
    return shaped(texts.select("pos", F.array_join(N.parse_keywords(answer), "|").alias("keywords")), "pos:bigint", "keywords:string")


_WHITE = WS[1:-2]
SQL["parsed_keywords"] = f"""WITH tx AS (SELECT doc_id AS pos, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1 - item_id, coalesce(text, '') FROM benchmark),
st AS (SELECT pos AS id, t, CASE ((pos % 4) + 4) % 4 WHEN 0 THEN chr(10) || '* ' WHEN 1 THEN ' 3d ' WHEN 2 THEN chr(10) || '2. ''' ELSE ' 5) ' END AS s FROM tx),
an AS (SELECT id, string_split_regex('Keywords:' || array_to_string(list_transform(list_filter(string_split_regex(t, {WS}), lambda x: x <> '')[1:7], lambda w: s || w), ','), '[,;\\n]') AS p FROM st),
a AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM an),
b AS (SELECT id, i, regexp_replace(regexp_replace(x, '^.*:', ''), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS x FROM a),
c AS (SELECT id, i, lower(regexp_replace(regexp_replace(x, '^([0-9]+[.)]|[-*•])?{_WHITE}*["''`]*', ''), '["''`.]+$', '')) AS x FROM b),
g AS (SELECT id, x, min(i) AS i FROM c WHERE {words_sql('x')} BETWEEN 1 AND 6 GROUP BY id, x), e AS (SELECT id, count(*) AS n, list(x ORDER BY i)[1:5] AS k FROM g GROUP BY id)
SELECT pos, CASE WHEN n >= 5 THEN array_to_string(k, '|') ELSE '' END AS keywords FROM tx LEFT JOIN e ON id = pos"""


def exact_sample(spark, d):
    """Exactly a hundred documents, drawn by a hash."""
    return shaped(E.sample(papers(spark, d).select("pos"), 100, 7), "pos:bigint")


SQL["exact_sample"] = "SELECT doc_id AS pos FROM documents ORDER BY ('0x' || substr(md5(doc_id || ':7'), 1, 12))::BIGINT, doc_id LIMIT 100"


def unit_vectors(spark, d):
    """The components of each vector at length 1; those of every tenth vector are zero."""
    scaled = F.transform("v", lambda x: x.cast("double") * F.pmod("pos", F.lit(10)))
    return shaped(vectors(spark, d).select("pos", F.posexplode(I.normalize(scaled)).alias("i", "x")), "pos:bigint", "i:bigint", "x:double")


SQL["unit_vectors"] = """WITH s AS (SELECT vec_id AS pos, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 10)) AS v FROM embeddings), n AS (SELECT pos, v, sqrt(list_dot_product(v, v)) AS n FROM s)
SELECT pos, unnest(range(len(v))) AS i, round(unnest(list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 6) AS x FROM n"""


def distinct_users(spark, d):
    """Each user of the events once."""
    return shaped(X.distinct_records(table(spark, d, "events").select("user_id"), "user_id"), "user_id:bigint")


SQL["distinct_users"] = "SELECT DISTINCT user_id FROM events"

def analysis_report(spark, d):
    """Rises, falls and bursts of terms between the halves of the years, and gaps between the vectors' communities."""
    cells, years, totals = trends._by_year(spark, d)
    found = A.trends(years, totals, (2013, 2019), (2020, 2026), A.specificity(cells, lang_communities(spark, d)))
    _, gap_pairs = graph._gaps(spark, d, label_communities(spark, d))
    return shaped(A.report(stored(found, "trends"), A.bursts(years, totals), gap_pairs), "section:string", "rank:bigint", "label:string", "value:double")


SQL["analysis_report"] = f"""WITH tl AS MATERIALIZED ({trends.SQL['trend_lift']}), bt AS MATERIALIZED ({trends.SQL['burst_terms']}), gp AS MATERIALIZED ({graph.SQL['gap_zscores']}),
x AS (SELECT 'rising' AS section, row_number() OVER (ORDER BY lift DESC, term) AS rank, term AS label, log2_lift AS value, 7 AS most FROM tl
  UNION ALL SELECT 'declining', row_number() OVER (ORDER BY lift, term DESC), term, log2_lift, 7 FROM tl
  UNION ALL SELECT 'burst', row_number() OVER (ORDER BY burst DESC, lift DESC, term), term, burst, 5 FROM bt JOIN tl USING (term)
  UNION ALL SELECT 'gap', row_number() OVER (ORDER BY similarity DESC, a, b), a || ' <-> ' || b, similarity, 5 FROM gp WHERE z < -2)
SELECT section, rank, label, value FROM x WHERE rank <= most"""


for _f in (analysis_report, retrieval_table, ladder_table, context_coverage, overview_text, concept_nodes, appears_in_edges, concept_pages, pagerank_nodes, label_search, input_modes, parsed_keywords, exact_sample, unit_vectors, distinct_users):
    QUERIES[_f.__name__] = _f
