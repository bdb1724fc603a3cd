"""Graph queries over all trade between nations, and over the folders and pages of all sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import graph as G
from ..sources.tables import EDGES_SQL, SITE_SQL, edges, links, site_graph, table
from .site import LINKS

Q: dict[str, tuple] = {}
_NODES = "nodes as (select src as node from edges union select dst from edges)"
_ENDS = "x as (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges)"

Q["link_degrees"] = (lambda s, d: G.degrees(edges(s, d)), f"with {EDGES_SQL}, {_ENDS} select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from x group by node")
Q["hubs"] = (
    lambda s, d: G.degrees(edges(s, d)).where("out_degree >= 10 and in_degree >= 5").orderBy(F.col("out_degree").desc(), F.col("in_degree").desc(), "node").limit(10),
    f"with {EDGES_SQL}, {_ENDS} select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from x group by node having sum(o) >= 10 and sum(i) >= 5 order by 2 desc, 3 desc, 1 limit 10",
)
_STATISTICS = f"{_ENDS}, g as (select node, sum(o) as o, sum(i) as i from x group by node) select count(*) as nodes, sum(o)::bigint as edges, round(sum(o) / (count(*) * (count(*) - 1)), 6) as density, round(avg(o), 6) as avg_degree, max(i)::bigint as max_in, max(o)::bigint as max_out from g"
Q["graph_statistics"] = (
    lambda s, d: G.statistics(edges(s, d)).withColumn("graph", F.lit("trade")).unionByName(G.statistics(site_graph(s, d)).withColumn("graph", F.lit("site"))),
    f"select *, 'trade' as graph from (with {EDGES_SQL}, {_STATISTICS}) union all select *, 'site' as graph from (with {SITE_SQL}, {_STATISTICS})",
)


def _pagerank_sql(graph: str, most: int, tolerance: float) -> str:
    """Iterations side by side; the first that moves no rank by more than the tolerance is the result."""
    steps = [f"{_NODES}, deg as materialized (select src, count(*) as k from edges group by src), total as materialized (select count(*)::double as n from nodes), r0 as materialized (select node, 1 / n as rank from nodes, total)"]
    for i in range(most):
        steps.append(f"f{i} as materialized (select dst, sum(rank / k) as flow from edges join deg using (src) join r{i} on src = node group by dst), r{i + 1} as materialized (select node, 0.15::double / n + 0.85::double * coalesce(flow, 0) as rank from nodes left join f{i} on node = dst, total)")
    moved = " union all ".join(f"select {i + 1} as i, max(abs(a.rank - b.rank)) as moved from r{i} a join r{i + 1} b using (node)" for i in range(most))
    ranks = " union all ".join(f"select {i + 1} as i, node, rank from r{i + 1}" for i in range(most))
    return f"with {graph}, {', '.join(steps)}, m as materialized ({moved}) select node, round(rank, 9) as rank from ({ranks}) where i = (select min(i) from m where moved <= {tolerance}::double)"


Q["pagerank"] = (lambda s, d: G.pagerank(site_graph(s, d)).select("node", F.round("rank", 9).alias("rank")), _pagerank_sql(SITE_SQL, 64, 1e-4))
Q["pagerank_trade"] = (lambda s, d: G.pagerank(edges(s, d)).select("node", F.round("rank", 9).alias("rank")), _pagerank_sql(EDGES_SQL, 16, 1e-4))


def _homes(s: SparkSession, d: str) -> DataFrame:
    return site_graph(s, d).where("src like '%/' and src not like '%/%/%'").select(F.col("src").alias("node"))


_REACHED = f"with recursive {SITE_SQL}, w as (select distinct src as node, 0 as depth from edges where src like '%/' and src not like '%/%/%' union select dst, depth + 1 from w join edges on src = node where depth < {{}}) select node, min(depth)::int as depth from w group by node"
Q["reachability"] = (lambda s, d: G.distances(site_graph(s, d), _homes(s, d), 10), _REACHED.format(10))
Q["crawl_frontier"] = (lambda s, d: G.crawl(site_graph(s, d), _homes(s, d)), _REACHED.format(5) + " order by 2, 1 limit 100")
Q["strong_components"] = (
    lambda s, d: G.strong_components(site_graph(s, d)),
    f"with recursive {SITE_SQL}, {_NODES}, w as (select node as a, node as b from nodes union select a, dst from w join edges on src = b) select x.a as node, max(x.b) as component from w x join w y on x.a = y.b and x.b = y.a group by x.a",
)
Q["simple_cycles"] = (
    lambda s, d: G.simple_cycles(site_graph(s, d)).select(F.array_join("path", ">").alias("cycle"), F.round("strength", 6).alias("strength")),
    f"with recursive {SITE_SQL}, w as (select [src, dst] as path, weight::double as w from edges where src < dst union all select list_append(path, dst), w + weight from w join edges on src = path[-1] where dst > path[1] and not list_contains(path, dst) and len(path) < 10) select array_to_string(path, '>') as cycle, round((w + weight) / len(path), 6) as strength from w join edges on src = path[-1] and dst = path[1]",
)
Q["domain_connectivity"] = (
    lambda s, d: links(table(s, d, "pages")).select(F.least(U.host(F.col("src")), U.host(F.col("dst"))).alias("a"), F.greatest(U.host(F.col("src")), U.host(F.col("dst"))).alias("b")).agg(F.count_distinct(F.when(F.col("a") != F.col("b"), F.struct("a", "b"))).alias("pairs"), F.count_distinct("a").alias("hosts")),
    f"with {LINKS} select count(distinct case when a <> b then a || ' ' || b end) as pairs, count(distinct a) as hosts from (select least(lower(split_part(src, '/', 3)), lower(split_part(dst, '/', 3))) as a, greatest(lower(split_part(src, '/', 3)), lower(split_part(dst, '/', 3))) as b from links)",
)
Q["graph_dot"] = (lambda s, d: G.to_dot(edges(s, d)), f"with {EDGES_SQL} select printf('\"%d\" -> \"%d\" [weight=%d];', src, dst, weight) as line from edges")
Q["adjacency_matrix"] = (lambda s, d: G.adjacency(site_graph(s, d)), f"with {SITE_SQL}, {_NODES}, p as (select node, row_number() over (order by node) - 1 as i from nodes) select a.i as i, b.i as j, weight from edges join p a on a.node = src join p b on b.node = dst")
