"""Further networks over the test tables: clusters, stability, paths, levels, embeddings, page networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network, similar
from ..sources.shared import keep
from ..sources.tables import parquet
from .queries import _PARTIES, _TRADE, _bipartite, _parties, _tag_edges, _trade
from .registry import query


@query("WITH r AS (SELECT DISTINCT p_brand AS node, unnest(string_split(p_name, ' ')) AS tag FROM part), d AS (SELECT tag, count(*) AS df FROM r GROUP BY tag) SELECT node, tag, round(log2((SELECT count(DISTINCT node) FROM r) / df), 9)::DOUBLE AS w FROM r JOIN d USING (tag)")
def tag_features_idf(spark, d):
    rows = parquet(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag"))
    return network.features(rows, "p_brand", "tag", True).withColumn("w", F.round("w", 9))


@query()
def tag_network_nodes(spark, d):
    rows = parquet(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("g"), F.explode(F.split("p_name", " ")).alias("tag"))
    return network.tag_network(rows, "g", "tag", 3.0, idf=True, blacklist=["red"], min_tags=2)["nodes"]


@query()
def leiden_clusters(spark, d):
    return network.add_clustering(_tag_edges(spark, d), "leiden", resolutions=[1.0, 1.5], min_size=20)


@query()
def cluster_modularity(spark, d):
    edges = _tag_edges(spark, d)
    return network.modularity(edges, network.louvain_clusters(edges))


@query()
def cluster_stability(spark, d):
    return network.cluster_stability(keep(network.resampled(_tag_edges(spark, d), 10)))[0]


@query()
def cluster_matches(spark, d):
    return network.cluster_stability(keep(network.resampled(_tag_edges(spark, d), 10)))[1]


@query()
def small_clusters_reassigned(spark, d):
    return network.small_cluster_nodes(network.cluster_stability(keep(network.resampled(_tag_edges(spark, d), 10)))[0], 10)


@query(f"WITH {_TRADE} SELECT node, round(coalesce(avg(o), 0), 9)::DOUBLE AS mean_out, round(coalesce(avg(i), 0), 9)::DOUBLE AS mean_in FROM (SELECT u AS node, length(v)::DOUBLE AS o, NULL AS i FROM t UNION ALL SELECT v, NULL, length(v)::DOUBLE FROM t) GROUP BY node")
def edge_fractions(spark, d):
    return network.edge_means(_trade(spark, d).withColumn("x", F.length("v").cast("double")), "x").withColumns({c: F.round(c, 9) for c in ("mean_out", "mean_in")})


def _regions(spark, d):
    """Edges between nations with numbers next to each other in a region, and from each region's first to the next."""
    n = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("r"))
    m = n.select(F.col("u").alias("v"), F.col("r").alias("q"))
    inside = n.join(m, n["r"] == m["q"]).where("v = u + 5 or v = u + 10").select("u", "v")
    return inside.unionByName(n.where("u < 4").select("u", (F.col("u") + 1).alias("v")))


_REGIONS = "e AS (SELECT a.n_nationkey AS u, b.n_nationkey AS v FROM nation a JOIN nation b USING (n_regionkey) WHERE b.n_nationkey IN (a.n_nationkey + 5, a.n_nationkey + 10) UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey < 4)"
_STEPS = f"{_REGIONS}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), s1 AS (SELECT u, v, 1 AS steps FROM b), " + ", ".join(
    f"n{k} AS (SELECT DISTINCT s.u, b.v FROM s{k - 1} s JOIN b ON s.v = b.u WHERE s.u <> b.v AND s.steps = {k - 1} AND NOT EXISTS (SELECT 1 FROM s{k - 1} x WHERE x.u = s.u AND x.v = b.v)), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT u, v, {k} FROM n{k})" for k in range(2, 6)
)


@query(f"WITH {_STEPS} SELECT u, v, steps FROM s5")
def path_distances(spark, d):
    return network.path_distances(_regions(spark, d), 5)


@query(f"WITH {_STEPS} SELECT u, v, round(ln(1 + steps) / CASE WHEN steps = 1 AND a.n_regionkey = c.n_regionkey THEN 1.5 ELSE 1 END, 9)::DOUBLE AS distance FROM s5 JOIN nation a ON u = a.n_nationkey JOIN nation c ON v = c.n_nationkey")
def layout_distances(spark, d):
    clusters = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster"))
    return network.layout_distances(_regions(spark, d), clusters, 5).withColumn("distance", F.round("distance", 9))


@query()
def betweenness(spark, d):
    return network.betweenness(_trade(spark, d))


@query()
def trophic_levels(spark, d):
    return network.trophic_levels(_trade(spark, d)).withColumns({c: F.round(c, 6) for c in ("level", "scaled")})


@query(f"WITH {_TRADE}, oo AS (SELECT a.v AS node, count(DISTINCT b.u) AS two_hop FROM t a JOIN t b ON a.u = b.v GROUP BY a.v) SELECT * FROM oo")
def two_hop_in(spark, d):
    return network.two_hop(network.turned(_trade(spark, d)))


@query("WITH x AS (SELECT a.vec_id::VARCHAR AS u, b.vec_id::VARCHAR AS v, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT u, v, round(sim, 6)::DOUBLE AS sim FROM x QUALIFY row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) <= 6")
def embed_edges(spark, d):
    return network.embed_edges(parquet(spark, d, "embeddings"), "vec_id", "embedding").withColumn("sim", F.round("sim", 6))


@query()
def embedding_network(spark, d):
    edges = keep(network.undirected(network.embed_threshold_edges(parquet(spark, d, "embeddings"), "vec_id", "embedding", 6.0)))
    return network.louvain_clusters(edges)


@query()
def soft_clusters(spark, d):
    return network.soft_clusters(parquet(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "cluster", F.round("probability", 6).alias("probability"))


@query("WITH p AS (SELECT l_suppkey AS a, l_partkey AS b, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL), d AS (SELECT b, sum(w) AS sb FROM p GROUP BY b), k AS (SELECT a, sum(w) AS s FROM p GROUP BY a), j AS (SELECT x.a AS u, y.a AS v, sum(x.w * y.w / sb) AS x FROM p x JOIN p y USING (b) JOIN d USING (b) WHERE x.a <> y.a GROUP BY ALL) SELECT u, v, round(x / s, 6)::DOUBLE AS weight FROM j JOIN k ON u = a")
def bipartite_walk_directed(spark, d):
    return network.project(_bipartite(spark, d), "probs", True).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_TRADE}, {_PARTIES}, x AS (SELECT u, v FROM t WHERE u LIKE 's%'), z AS (SELECT x.u, count(*) AS n, sum((b.cluster = a.cluster)::INT) AS same FROM x JOIN parties a ON x.u = a.node JOIN parties b ON x.v = b.node GROUP BY x.u) SELECT u AS node, round(same / n, 9)::DOUBLE AS share FROM z")
def own_nation_share(spark, d):
    c = _parties(spark, d)
    rows = _trade(spark, d).where(F.col("u").startswith("s")).join(c.select(F.col("node").alias("u"), F.col("cluster").alias("a")), "u").join(c.select(F.col("node").alias("v"), F.col("cluster").alias("b")), "v")
    means = network.edge_means(rows.withColumn("same", (F.col("a") == F.col("b")).cast("double")), "same")
    return means.where(F.col("node").startswith("s")).select("node", F.round("mean_out", 9).alias("share"))


@query("WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS a, list_distinct(string_split(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), ' ')) AS b FROM conversations), x AS (SELECT *, len(list_intersect(a, b)) AS c, len(list_distinct(a || b)) AS e FROM w WHERE b IS NOT NULL) SELECT conv_id, turn, round(c / e, 9)::DOUBLE AS jaccard, round(c / e * greatest(len(a), len(b)) / least(len(a), len(b)), 9)::DOUBLE AS normalised, len(list_filter(a, lambda z: list_contains(b, z)))::INT AS overlap FROM x")
def overlap_forms(spark, d):
    from pyspark.sql import Window

    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    c = parquet(spark, d, "conversations").withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null").withColumns({"a": words("text"), "b": words("n")})
    jaccard, normalised, inside = similar.overlap_forms(F.col("a"), F.col("b"))
    return c.select("conv_id", "turn", F.round(jaccard, 9).alias("jaccard"), F.round(normalised, 9).alias("normalised"), F.aggregate(inside, F.lit(0), lambda x, y: x + y).alias("overlap"))


@query(f"WITH RECURSIVE {_TRADE}, f AS (SELECT u AS node, 'o' || v AS i FROM t UNION ALL SELECT v, 'i' || u FROM t), s AS (SELECT node, count(*) AS n FROM f GROUP BY node), p AS (SELECT a.node AS u, b.node AS v, count(*) AS common FROM f a JOIN f b USING (i) WHERE a.node < b.node GROUP BY ALL), k AS (SELECT p.u, p.v FROM p JOIN s x ON p.u = x.node JOIN s y ON p.v = y.node WHERE common / (x.n + y.n - common) > 0.3), l AS (SELECT u AS a, v AS b FROM k UNION SELECT v, u FROM k), c AS (SELECT a AS node, a AS m FROM l UNION SELECT b, a FROM l UNION SELECT l.b, c.m FROM c JOIN l ON c.node = l.a), g AS (SELECT node, min(m) AS m FROM c GROUP BY node) SELECT DISTINCT coalesce(x.m, t.u) AS u, coalesce(y.m, t.v) AS v FROM t LEFT JOIN g x ON t.u = x.node LEFT JOIN g y ON t.v = y.node WHERE coalesce(x.m, t.u) <> coalesce(y.m, t.v)")
def identical_merged(spark, d):
    edges = _trade(spark, d)
    return similar.merge_identical(edges, similar.neighbour_jaccard(edges, 0.3).select("u", "v"))


@query("WITH p AS (SELECT l_suppkey AS node, l_returnflag AS cluster, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS p FROM lineitem GROUP BY l_suppkey, l_returnflag), b AS (SELECT node, cluster AS best, p AS best_prob FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY p DESC, cluster) = 1) SELECT row_number() OVER (ORDER BY best, best_prob DESC, node) AS position, node, best, " + ", ".join(f"round(coalesce((SELECT p FROM p WHERE p.node = b.node AND cluster = '{c}'), 0), 9)::DOUBLE AS \"{c}\"" for c in "ANR") + " FROM b")
def membership_order(spark, d):
    from pyspark.sql import Window

    c = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("cluster")).agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("node"))).drop("c")
    best = p.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p"), "cluster"))).where("r = 1").select("node", F.col("cluster").alias("best"), F.col("p").alias("best_prob"))
    got = network.membership_order(best, list("ANR"), p)
    return got.select("position", "node", "best", *[F.round(x, 9).alias(x) for x in "ANR"])
