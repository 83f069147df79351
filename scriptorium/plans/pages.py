"""Queries that make pages, links and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import index as I
from ..operators import pages as V
from ..operators import views as W
from .base import DENSE_EDGES, PAPERS, counted, label_communities, papers, shaped, table, terms_sql, tfidf_sql, vectors

QUERIES, SQL = {}, {}


def reader_pages(spark, d):
    """A page for every vector, with its neighbours on the dense graph."""
    edges = G.mutual_edges(G.dense_arcs(vectors(spark, d)))
    communities = label_communities(spark, d)
    name = F.concat(F.lit("v"), F.col("pos").cast("string"))
    nodes = communities.join(G.bridge_scores(communities, edges), "pos").select("pos", name.alias("id"), F.concat(F.lit("Vector "), F.col("pos").cast("string")).alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit(2024).alias("year"), F.lit("").alias("abstract"), F.col("community").cast("string").alias("cluster"), F.lit(0.25).alias("pagerank"), "bridge")
    return shaped(V.reader_pages(nodes, edges).select("pos", F.md5("page").alias("digest"), F.length("page").alias("chars")), "pos:bigint", "digest:string", "chars:bigint")


SQL["reader_pages"] = f"""WITH {DENSE_EDGES}, bridge AS (SELECT x.pos, coalesce(sum(w) FILTER (x.community <> y.community) / sum(w), 0) AS bridge FROM vec x LEFT JOIN adj ON src = x.pos LEFT JOIN vec y ON y.pos = dst GROUP BY x.pos),
l AS (SELECT src AS pos, string_agg(printf('- [[v%d|Vector %d]] · cos %.2f', dst, dst, w) || chr(10), '' ORDER BY r) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM adj) WHERE r <= 8 GROUP BY src),
p AS (SELECT pos, '# Vector ' || pos || chr(10) || chr(10) || 'A, B · 2024' || chr(10) || chr(10) || printf('Community *%d* · PageRank 0.2500 · bridge score %.2f', community, coalesce(bridge, 0)) || chr(10) || chr(10)
  || CASE WHEN lines IS NULL THEN '' ELSE '## Nearest neighbours' || chr(10) || chr(10) || 'Along the semantic backbone:' || chr(10) || chr(10) || lines || chr(10) END AS page FROM vec JOIN bridge USING (pos) LEFT JOIN l USING (pos))
SELECT pos, md5(page) AS digest, length(page) AS chars FROM p"""


def linked_citations(spark, d):
    """Every turn's text with citations of its own number and the next."""
    rows = table(spark, d, "conversations")
    cited = F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] and ["), (F.col("turn") + 1).cast("string"), F.lit("]."))
    linked = V.linked_citations(cited, F.concat(F.lit("m"), F.col("conv_id").cast("string")), F.lit(3))
    return shaped(rows.select("conv_id", "turn", F.md5(linked).alias("digest"), V.thread_title(F.col("text")).alias("title")), "conv_id:bigint", "turn:bigint", "digest:string", "title:string")


SQL["linked_citations"] = """WITH c AS (SELECT conv_id, turn, text, text || ' [' || turn || '] and [' || (turn + 1) || '].' AS t, trim(split_part(trim(coalesce(text, '')), chr(10), 1)) AS line FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(t, '\\[([1-3])\\]', '[\\1](#src-m' || conv_id || '-\\1)', 'g')) AS digest,
  CASE WHEN line = '' THEN 'New chat' WHEN length(line) <= 48 THEN line ELSE rtrim(substr(line, 1, 47)) || '…' END AS title FROM c"""


def seed_positions(spark, d):
    nodes = papers(spark, d).select(F.concat(F.lit("p"), F.col("id")).alias("id"), F.col("source").alias("cluster"))
    return shaped(V.seed_positions(nodes), "id:string", "x:double", "y:double")


SQL["seed_positions"] = f"""WITH s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS i, max(count(*)) OVER () AS most FROM documents GROUP BY source),
n AS (SELECT 'p' || doc_id AS id, source, list_reduce(list_concat([{V.FNV_START}::BIGINT], list_transform(string_split('p' || doc_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * {V.FNV_FACTOR}) & 4294967295) AS h FROM documents),
g AS (SELECT id, size, 5 * sqrt(most) * sqrt(i) AS r, i * {V.GOLDEN_ANGLE!r}::DOUBLE AS a, (h & 65535) / 65536 * 2 * pi() AS b, 2 * sqrt(size) * sqrt(((h >> 16) & 65535) / 65536) AS q FROM n JOIN s USING (source))
SELECT id, round(r * cos(a) + q * cos(b), 6) AS x, round(r * sin(a) + q * sin(b), 6) AS y FROM g"""

LABELS = 60


def linked_concepts(spark, d):
    """Every text with its first mentions of the 60 terms that most documents hold, eight at most."""
    corpus, counts = counted(spark, d)
    common = I.build_tfidf(corpus, counts=counts).vocabulary.where(F.length("term") > 3).orderBy(F.desc("df"), "term").limit(LABELS)
    link = V.linked_concepts([r.term for r in common.select("term").collect()])
    linked = corpus.select("pos", "abstract", link("abstract").alias("linked"))
    return shaped(linked.select("pos", F.md5("linked").alias("digest"), ((F.length("linked") - F.length("abstract")) / 4).alias("links")), "pos:bigint", "digest:string", "links:bigint")


_KEPT = r"\[\[[^\]]*\]\]|`[^`]*`|[$][$][^$]*[$][$]|[$][^$]*[$]"
SQL["linked_concepts"] = f"""WITH {PAPERS}, {terms_sql('terms', 'papers', 'pos', 'abstract', 2)}, {tfidf_sql()},
lb AS MATERIALIZED (SELECT term FROM tfidf_v WHERE length(term) > 3 ORDER BY df DESC, term LIMIT {LABELS}),
pt AS MATERIALIZED (SELECT '(?is){_KEPT}|\\b(?:' || string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) || ')\\b|[A-Za-z0-9_]+|.' AS pat FROM lb),
l AS (SELECT pos, unnest(string_split(abstract, chr(10))) AS line, generate_subscripts(string_split(abstract, chr(10)), 1) AS li FROM papers),
x AS MATERIALIZED (SELECT pos, li, CASE WHEN substr(regexp_replace(line, '^[\\s\\x0B]+', ''), 1, 1) IN ('#', '-', '|', '>') THEN [line] ELSE regexp_extract_all(line, pat) END AS x FROM l, pt),
p AS MATERIALIZED (SELECT pos, li, unnest(x) AS piece, generate_subscripts(x, 1) AS pi FROM x),
f AS (SELECT pos, min(li * 10000000 + pi) AS spot FROM p JOIN lb ON lower(piece) = term GROUP BY pos, term),
c AS (SELECT pos, spot // 10000000 AS li, spot % 10000000 AS pi FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY spot) AS r FROM f) WHERE r <= 8),
o AS (SELECT pos, li, string_agg(CASE WHEN c.pi IS NULL THEN piece ELSE '[[' || piece || ']]' END, '' ORDER BY pi) AS line FROM p LEFT JOIN c USING (pos, li, pi) GROUP BY pos, li),
t AS (SELECT pos, string_agg(coalesce(line, ''), chr(10) ORDER BY li) AS linked FROM x LEFT JOIN o USING (pos, li) GROUP BY pos)
SELECT pos, md5(linked) AS digest, ((length(linked) - length(abstract)) // 4)::BIGINT AS links FROM t JOIN papers USING (pos)"""


def field_layout(spark, d):
    """Places of the labels' communities on a map, drawn together by the links of the dense graph."""
    communities = label_communities(spark, d)
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    fields, links = W.field_map(sizes, G.community_links(communities, G.mutual_edges(G.dense_arcs(vectors(spark, d)))), 1)
    return shaped(W.field_layout(fields, links), "community:bigint", "x:double", "y:double")


SQL["field_layout"] = f"""WITH RECURSIVE {DENSE_EDGES}, links AS (SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, count(*) AS n FROM edges e JOIN vec x ON x.pos = e.a JOIN vec y ON y.pos = e.b WHERE x.community <> y.community GROUP BY ALL),
lo AS (SELECT *, row_number() OVER (ORDER BY n, a, b) - 1 AS i, count(*) OVER () AS c FROM links), lk AS (SELECT a, b, n FROM lo WHERE n >= (SELECT n FROM lo WHERE i = c // 2)),
sz AS (SELECT label AS community, count(*) AS size FROM embeddings GROUP BY 1),
fd AS MATERIALIZED (SELECT community, 12 + 34 * sqrt(size / max(size) OVER ()) AS r, row_number() OVER (ORDER BY size DESC, community) - 1 AS i, count(*) OVER () AS c FROM sz),
one AS MATERIALIZED (SELECT list(community ORDER BY i) AS ids, list(r ORDER BY i) AS rs, list(cos((i / c) * pi() * 2) * 300 ORDER BY i) AS xs, list(sin((i / c) * pi() * 2) * 300 ORDER BY i) AS ys FROM fd),
ed AS MATERIALIZED (SELECT coalesce(list({{'s': x.i, 't': y.i, 'share': n::DOUBLE / (SELECT max(n) FROM lk)}} ORDER BY n DESC, a, b), []) AS es FROM lk JOIN fd x ON x.community = a JOIN fd y ON y.community = b),
st(k, xs, ys) AS (SELECT 0, xs, ys FROM one UNION ALL
  SELECT k + 1, list_transform(fs, lambda f: xs[f.i + 1] + CASE WHEN f.m = 0 THEN 0 ELSE f.x / f.m * (least(40.0::DOUBLE, f.m) * (1 - k / 400.0::DOUBLE) * 0.35::DOUBLE) END),
    list_transform(fs, lambda f: ys[f.i + 1] + CASE WHEN f.m = 0 THEN 0 ELSE f.y / f.m * (least(40.0::DOUBLE, f.m) * (1 - k / 400.0::DOUBLE) * 0.35::DOUBLE) END)
  FROM (SELECT k, xs, ys, list_transform(gs, lambda g: {{'i': g.i, 'x': list_reduce(g.xs, lambda u, v: u + v), 'y': list_reduce(g.ys, lambda u, v: u + v), 'm': sqrt(list_reduce(g.xs, lambda u, v: u + v) * list_reduce(g.xs, lambda u, v: u + v) + list_reduce(g.ys, lambda u, v: u + v) * list_reduce(g.ys, lambda u, v: u + v))}}) AS fs
  FROM (SELECT k, xs, ys, list_transform(range(len(xs)), lambda i: {{'i': i,
    'xs': list_concat([0.0::DOUBLE], list_transform(list_filter(range(len(xs)), lambda j: j <> i), lambda j: CASE WHEN (xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1]) < 1 THEN (i - j) / sqrt(2.0::DOUBLE) * ((rs[i + 1] + rs[j + 1] + 24) * (rs[i + 1] + rs[j + 1] + 24) * 60 / 2.0::DOUBLE)
        ELSE (xs[i + 1] - xs[j + 1]) / sqrt((xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1])) * ((rs[i + 1] + rs[j + 1] + 24) * (rs[i + 1] + rs[j + 1] + 24) * 60 / ((xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1]))) END),
      list_transform(list_filter(es, lambda e: e.s = i OR e.t = i), lambda e: CASE WHEN e.s = i THEN 1 ELSE -1 END * ((xs[e.t + 1] - xs[e.s + 1]) / CASE WHEN xs[e.t + 1] = xs[e.s + 1] AND ys[e.t + 1] = ys[e.s + 1] THEN 1 ELSE sqrt((xs[e.t + 1] - xs[e.s + 1]) * (xs[e.t + 1] - xs[e.s + 1]) + (ys[e.t + 1] - ys[e.s + 1]) * (ys[e.t + 1] - ys[e.s + 1])) END * (CASE WHEN xs[e.t + 1] = xs[e.s + 1] AND ys[e.t + 1] = ys[e.s + 1] THEN 1 ELSE sqrt((xs[e.t + 1] - xs[e.s + 1]) * (xs[e.t + 1] - xs[e.s + 1]) + (ys[e.t + 1] - ys[e.s + 1]) * (ys[e.t + 1] - ys[e.s + 1])) END * e.share / 6.0::DOUBLE)))),
    'ys': list_concat([0.0::DOUBLE], list_transform(list_filter(range(len(xs)), lambda j: j <> i), lambda j: CASE WHEN (xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1]) < 1 THEN CASE WHEN i < j THEN 1 ELSE -1 END / sqrt(2.0::DOUBLE) * ((rs[i + 1] + rs[j + 1] + 24) * (rs[i + 1] + rs[j + 1] + 24) * 60 / 2.0::DOUBLE)
        ELSE (ys[i + 1] - ys[j + 1]) / sqrt((xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1])) * ((rs[i + 1] + rs[j + 1] + 24) * (rs[i + 1] + rs[j + 1] + 24) * 60 / ((xs[i + 1] - xs[j + 1]) * (xs[i + 1] - xs[j + 1]) + (ys[i + 1] - ys[j + 1]) * (ys[i + 1] - ys[j + 1]))) END),
      list_transform(list_filter(es, lambda e: e.s = i OR e.t = i), lambda e: CASE WHEN e.s = i THEN 1 ELSE -1 END * ((ys[e.t + 1] - ys[e.s + 1]) / CASE WHEN xs[e.t + 1] = xs[e.s + 1] AND ys[e.t + 1] = ys[e.s + 1] THEN 1 ELSE sqrt((xs[e.t + 1] - xs[e.s + 1]) * (xs[e.t + 1] - xs[e.s + 1]) + (ys[e.t + 1] - ys[e.s + 1]) * (ys[e.t + 1] - ys[e.s + 1])) END * (CASE WHEN xs[e.t + 1] = xs[e.s + 1] AND ys[e.t + 1] = ys[e.s + 1] THEN 1 ELSE sqrt((xs[e.t + 1] - xs[e.s + 1]) * (xs[e.t + 1] - xs[e.s + 1]) + (ys[e.t + 1] - ys[e.s + 1]) * (ys[e.t + 1] - ys[e.s + 1])) END * e.share / 6.0::DOUBLE))))}}) AS gs
  FROM st, one o(ids, rs, x0, y0), ed WHERE k < 400) g1) f1)
SELECT unnest(ids)::BIGINT AS community, round(unnest(st.xs), 6) AS x, round(unnest(st.ys), 6) AS y FROM st, one WHERE k = 400"""

for _f in (reader_pages, linked_citations, seed_positions, linked_concepts, field_layout):
    QUERIES[_f.__name__] = _f
