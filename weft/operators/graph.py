"""Link-graph operators over an edge table (src, dst): loops of joins and aggregations with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ranks import with_rank


def link_edges(links: DataFrame) -> DataFrame:
    """Edges with their number of links and first and last position; self-loops dropped."""
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-4, cut_every: int = 5) -> DataFrame:
    """(node, rank): damped ranks from 1/N, dangling mass lost, until every change is within ``tolerance``."""
    e = cut(edges.select("src", "dst").distinct().join(edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n_out")), "src"))
    ids = cut(nodes(edges))
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        flow = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n_out")).alias("flow"))
        new = ids.join(flow, ids["node"] == flow["dst"], "left").select("node", ((1 - damping) / n + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        last = i == iterations - 1
        if tolerance > 0 or last or i % cut_every == cut_every - 1:
            new = cut(new)
        if tolerance > 0 and not new.join(ranks.withColumnRenamed("rank", "old"), "node").where(F.abs(F.col("rank") - F.col("old")) > tolerance).take(1):
            return new
        ranks = new
    return ranks


def distances(edges: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of everything reached from ``sources`` (node) in at most ``max_depth`` steps, breadth first."""
    seen = cut(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    e = edges.select("src", "dst").distinct()
    for depth in range(1, max_depth + 1):
        new = e.join(front, e["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start, goal, max_depth: int = 10) -> list | None:
    """One shortest path as a list of nodes, the smallest parent at each step; None if there is none within ``max_depth``."""
    spark = edges.sparkSession
    d = cut(distances(edges, spark.createDataFrame([(start,)], edges.select(F.col("src").alias("node")).schema), max_depth))
    hit = d.where(F.col("node") == F.lit(goal)).first()
    if hit is None:
        return None
    path = [goal]
    for depth in range(hit["depth"] - 1, -1, -1):
        parent = edges.where(F.col("dst") == F.lit(path[0])).join(d.where(F.col("depth") == depth), F.col("src") == F.col("node")).agg(F.min("src").alias("p")).first()["p"]
        path.insert(0, parent)
    return path


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, max_pages: int = 100) -> DataFrame:
    """(node, depth) of a crawl: level by level, the cap filled in order of depth, then node."""
    return distances(edges, seeds, max_depth).orderBy("depth", "node").limit(max_pages)


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component): mutually reachable nodes under their greatest node.

    Colouring: the greatest node that reaches a node is its colour; the nodes of a colour that reach the
    node it names back are one component.  Settled nodes leave and the rest is coloured anew.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    every = cut(nodes(edges))
    done = None
    open_ = every
    for _ in range(rounds):
        color = open_.select("node", F.col("node").alias("color"))
        while True:
            pushed = left.join(color, left["src"] == color["node"]).select(F.col("dst").alias("node"), "color")
            new = cut(color.unionByName(pushed).groupBy("node").agg(F.max("color").alias("color")))
            moved = new.join(color.withColumnRenamed("color", "old"), "node").where("color <> old").take(1)
            color = new
            if not moved:
                break
        found = cut(color.where("node = color"))
        front = found
        inside = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c2")), "dst").where("c1 = c2").select("src", "dst", "c1")
        inside = cut(inside)
        while front.take(1):
            back = inside.join(front, (inside["dst"] == front["node"]) & (inside["c1"] == front["color"])).select(inside["src"].alias("node"), "color").distinct()
            front = cut(back.join(found, "node", "left_anti"))
            found = cut(found.unionByName(front))
        done = found if done is None else cut(done.unionByName(found))
        open_ = cut(open_.join(found, "node", "left_anti"))
        if not open_.take(1):
            break
        left = cut(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return done.select("node", F.col("color").alias("component"))


def simple_cycles(edges: DataFrame, longest: int = 10) -> DataFrame:
    """All simple cycles of at most ``longest`` edges as arrays that start at their smallest node, with their mean weight."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"), "w")
    out = None
    for n in range(2, longest + 1):
        tip = F.element_at("path", -1)
        stepped = paths.join(e.withColumnRenamed("w", "w2"), tip == F.col("src"))
        closed = stepped.where(F.col("dst") == F.element_at("path", 1)).select("path", ((F.col("w") + F.col("w2")) / n).alias("strength"))
        out = closed if out is None else out.unionByName(closed)
        if n == longest:
            break
        paths = cut(stepped.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("w") + F.col("w2")).alias("w")))
        if not paths.take(1):
            break
    return out


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and highest degrees."""
    d = degrees(edges)
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.round(F.sum("out_degree") / (F.count("*") * (F.count("*") - 1)), 6).alias("density"), F.round(F.avg("out_degree"), 6).alias("avg_degree"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))


def to_dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('"%s" -> "%s" [weight=%d];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight")).alias("line"))


def adjacency(edges: DataFrame) -> DataFrame:
    """i, j, weight: the nonzero entries of the adjacency matrix, nodes numbered from 0 in their order."""
    at = with_rank(nodes(edges), [F.col("node")], "at").select("node", (F.col("at") - 1).alias("at"))
    ends = at.select(F.col("node").alias("src"), F.col("at").alias("i")), at.select(F.col("node").alias("dst"), F.col("at").alias("j"))
    return edges.join(ends[0], "src").join(ends[1], "dst").select("i", "j", "weight")


def merged(*graphs: DataFrame) -> DataFrame:
    """src, dst, weight of several graphs as one; weights of equal edges add up."""
    out = graphs[0].select("src", "dst", "weight")
    for g in graphs[1:]:
        out = out.unionByName(g.select("src", "dst", "weight"))
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def importance_distribution(ranks: DataFrame, buckets: int = 5) -> DataFrame:
    """bucket, low, high, n: ranks in equally wide bands from the least to the greatest."""
    low, high = (ranks.agg(f("rank").alias("x")).scalar() for f in (F.min, F.max))
    rows = ranks.select("rank", low.alias("lo"), ((high - low) / buckets).alias("width"))
    own = F.when(F.col("width") > 0, F.least(F.lit(buckets - 1), F.floor((F.col("rank") - F.col("lo")) / F.col("width")))).otherwise(0).cast("int")
    counted = rows.withColumn("bucket", own).groupBy("bucket", "lo", "width").agg(F.count("*").alias("n"))
    return counted.select("bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * F.col("width")).alias("high"), "n")


def relationship(edges: DataFrame, a, b, max_depth: int = 10) -> dict:
    """Paths both ways between two nodes, and whether the link is direct, mutual, indirect or none."""
    there, back = shortest_path(edges, a, b, max_depth), shortest_path(edges, b, a, max_depth)
    direct = bool(there and len(there) == 2) or bool(back and len(back) == 2)
    kind = "none" if there is None and back is None else "mutual" if there and back and len(there) == len(back) == 2 else "direct" if direct else "indirect"
    return {"forward": there, "backward": back, "kind": kind}


def recommendations(edges: DataFrame, pages: DataFrame, few: int = 2, many: int = 100) -> DataFrame:
    """node, issue: pages without inbound links (orphan), without outbound ones (dead end), with few inbound, or with many outbound ones."""
    known = pages.select("node").distinct().join(degrees(edges), "node", "left").select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")))
    issue = F.when(F.col("in_degree") == 0, "orphan").when(F.col("out_degree") == 0, "dead end").when(F.col("in_degree") < few, "few inbound links").when(F.col("out_degree") > many, "many outbound links")
    return known.withColumn("issue", issue).where("issue is not null").select("node", "issue")


def to_json(edges: DataFrame) -> DataFrame:
    """One JSON line for each edge."""
    return edges.select(F.to_json(F.struct("src", "dst", "weight")).alias("line"))


def to_csv(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_csv(F.struct("src", "dst", "weight")).alias("line"))
