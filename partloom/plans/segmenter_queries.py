"""Composed segmenters and communities: which method each cloud takes, and what it finds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from partloom.operators import communities as L
from partloom.operators import metrics as Q
from partloom.operators import segmentation as T
from partloom.operators import spatial as S
from partloom.operators import traversal as R
from partloom.plans.runtime import cutter
from partloom.plans.shape_queries import curvature_cte, knn, r, rounded
from partloom.sources import fixtures as X
from partloom.sources.fixtures import with_views

FLOOR, CEILING = 0.05, 0.5  # of the fixture's unit scale
LEAST, BEND = 8, 0.12


def _dbscan_sql(t: str, rows: str) -> str:
    """CTEs up to `lab_t` (cloud, pid, label) for rows (cloud, pid, x, y, z, eps, core)."""
    return f"""near_{t} as (select a.cloud, a.pid as p, b.pid as q, a.core from {rows} a join {rows} b on a.cloud = b.cloud and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= a.eps*a.eps),
 core_{t} as (select cloud, p from near_{t} group by 1, 2 having count(*) >= max(core)), link_{t} as (select n.cloud, n.p, n.q from near_{t} n join core_{t} a on a.cloud = n.cloud and a.p = n.p join core_{t} b on b.cloud = n.cloud and b.p = n.q),
 reach_{t} as (select cloud, p, p as label from core_{t} union select l.cloud, l.q, w.label from reach_{t} w join link_{t} l on l.cloud = w.cloud and l.p = w.p), low_{t} as (select cloud, p, min(label) as label from reach_{t} group by 1, 2),
 num_{t} as (select cloud, p, dense_rank() over (partition by cloud order by label) - 1 as k from low_{t}), border_{t} as (select n.cloud, n.p, min(k) as k from near_{t} n join num_{t} m on m.cloud = n.cloud and m.p = n.q group by 1, 2),
 lab_{t} as (select s.cloud, s.pid, coalesce(m.k, b.k, -1)::int as label from {rows} s left join num_{t} m on m.cloud = s.cloud and m.p = s.pid left join border_{t} b on b.cloud = s.cloud and b.p = s.pid)"""


def adaptive_clusters(spark, d):
    return T.adaptive_clusters(X.pts_lumps(spark, d), cutter(spark), floor=FLOOR, ceiling=CEILING)


def _adaptive_ctes() -> str:
    """Up to `adaptive` (cloud, pid, segment, path)."""
    parts = [f"{knn(11, 'pts_lumps')}, far as (select cloud, pid1, sqrt(max(d2)) as far from near group by 1, 2), sp as (select cloud, avg(far) as spacing, greatest(5, least(10, count(*)-1)) as core from far group by 1)"]
    parts.append(f"s0 as (select p.*, least(greatest(spacing*3.5, {FLOOR}), {CEILING}) as eps, core from pts_lumps p join sp using (cloud))")
    parts += [_dbscan_sql("0", "s0"), "open_0 as (select cloud from lab_0 group by 1 having max(label) = 0 and count(*) filter (label < 0) = 0)"]
    out = ["select *, 'first' as path from lab_0 where cloud not in (select cloud from open_0)"]
    for i, factor in enumerate(T.FACTORS, 1):
        parts.append(f"s{i} as (select p.*, spacing*{factor} as eps, core from pts_lumps p join sp using (cloud) where cloud in (select cloud from open_{i - 1}))")
        parts += [_dbscan_sql(str(i), f"s{i}"), f"open_{i} as (select cloud from lab_{i} group by 1 having max(label) {'=' if i == len(T.FACTORS) else '<='} 0)"]
        out.append(f"select *, '{factor}' as path from lab_{i} where cloud not in (select cloud from open_{i})")
    last = len(T.FACTORS)
    bent = curvature_cte(20, "1e-10", "pts_lumps").replace("near as", "cnear as").replace("from near", "from cnear")
    parts.append(f"labels as ({' union all '.join(out)}), big as (select cloud, label, row_number() over (partition by cloud order by label) - 1 as segment from labels where label >= 0 group by 1, 2 having count(*) >= 10)")
    parts.append(f"{bent}, rc as (select cloud, pid, round(curvature, 12) as curvature from curv), cq as (select cloud, quantile_cont(curvature, 0.5) as q5, quantile_cont(curvature, 0.8) as q8 from rc group by 1), cb as (select cloud, pid, case when curvature >= q8 then 0 when curvature >= q5 then 1 else 2 end as band from rc join cq using (cloud) where cloud in (select cloud from open_{last}))")
    parts.append("cn as (select cloud, band, row_number() over (partition by cloud order by band) - 1 as segment from cb group by 1, 2 having count(*) >= 10)")
    parts.append("adaptive as (select l.cloud, l.pid, b.segment, l.path from labels l join big b using (cloud, label) union all select cb.cloud, cb.pid, cn.segment, 'curvature' from cb join cn using (cloud, band))")
    return ", ".join(parts)


def _recursive(views: str) -> str:
    return with_views(views).replace("with ", "with recursive ", 1)


ADAPTIVE_SQL = _recursive("pts_lumps") + ", " + _adaptive_ctes() + " select * from adaptive"


def level_segments(spark, d):
    rows = T.level_hierarchy(X.pts_small(spark, d), cutter(spark), least=LEAST, bend=BEND)
    kids = T.children(rows).select("cloud", "segment_id", F.concat_ws(",", "children_ids").alias("children"))
    return rows.select("cloud", "pid", "segment_id", "parent_id", "hierarchy_level").join(kids, ["cloud", "segment_id"])


def _level_ctes() -> str:
    """Up to `levels` (cloud, pid, segment_id, parent_id, hierarchy_level); uses `curv` of the points, k = 20."""
    near = knn(11, "lsome").replace("near as", "lnear as").replace("from near", "from lnear")
    return f"""lbent as (select p.*, (curvature <= {BEND})::int as low from pts_small p join curv using (cloud, pid) where cloud in (select cloud from pts_small group by 1 having count(*) > {2 * LEAST})),
 lkept as (select * from lbent qualify count(*) over (partition by cloud, low) > {LEAST}), medium as (select cloud, pid, x, y, z, 'seg_0_0_1_' || (low - min(low) over (partition by cloud)) as segment_id from lkept),
 lsome as (select cloud || '|' || segment_id as cloud, pid, x, y, z, count(*) over (partition by cloud, segment_id) as n from medium qualify n > {3 * LEAST}),
 {near}, lfar as (select cloud, pid1, sqrt(max(d2)) as far from lnear group by 1, 2), lsp as (select cloud, avg(far)*2.5 as eps from lfar group by 1), ls as (select p.*, eps, greatest(5, n//20) as core from lsome p join lsp using (cloud)), {_dbscan_sql('fine', 'ls')},
 lnum as (select cloud, pid, label - min(label) over (partition by cloud) as k, count(*) over (partition by cloud, label) as m from lab_fine), fine as (select split_part(cloud, '|', 1)::int as cloud, pid, split_part(cloud, '|', 2) || '_2_' || k as segment_id, split_part(cloud, '|', 2) as parent_id from lnum where m >= {LEAST}),
 levels as (select cloud, pid, 'seg_0_0' as segment_id, null::varchar as parent_id, 0 as hierarchy_level from pts_small union all select cloud, pid, segment_id, 'seg_0_0', 1 from medium union all select *, 2 from fine)"""


CURV = curvature_cte(20, "1e-10").replace("near as", "cnear as").replace("from near", "from cnear")
LEVELS_SQL = _recursive("pts_small") + f", {CURV}, {_level_ctes()}, kids as (select cloud, parent_id as segment_id, string_agg(distinct segment_id, ',' order by segment_id) as children from levels where parent_id is not null group by 1, 2) select l.*, coalesce(children, '') as children from levels l left join kids using (cloud, segment_id)"


def routed_segments(spark, d):
    out = T.routed_segments(X.pts_lumps(spark, d), cutter(spark), least=LEAST * 3, bend=BEND, floor=FLOOR, ceiling=CEILING)
    return out.groupBy("cloud", "segment_id", "parent_id", "hierarchy_level", "path").agg(F.count("*").alias("n"), F.min("pid").alias("first"), F.max("pid").alias("last"))


def _routed_sql() -> str:
    levels = _level_ctes().replace("pts_small", "pts_lumps").replace(f"> {2 * LEAST})", f"> {6 * LEAST})").replace(f"low) > {LEAST})", f"low) > {3 * LEAST})").replace(f"n > {3 * LEAST})", f"n > {9 * LEAST})").replace(f"m >= {LEAST})", f"m >= {3 * LEAST})")
    return _recursive("pts_lumps") + f""", {_adaptive_ctes()}, {levels}, direct as (select * from adaptive qualify count(*) over (partition by cloud, segment) >= {3 * LEAST}),
 other as (select * from levels where cloud not in (select cloud from direct) qualify hierarchy_level = max(hierarchy_level) over (partition by cloud)),
 every as (select cloud, pid, 'segment_' || segment as segment_id, null::varchar as parent_id, 0 as hierarchy_level, path from direct union all select cloud, pid, segment_id, parent_id, hierarchy_level, 'level_' || hierarchy_level from other)
select cloud, segment_id, parent_id, hierarchy_level, path, count(*) as n, min(pid) as first, max(pid) as last from every group by all"""


def _edges(spark, d):
    return S.neighbour_edges(X.pts_small(spark, d), 10, 0.25)


def community_moves(spark, d):
    """Every point's best first move in its neighbour graph."""
    p, links = X.pts_small(spark, d), L.both_ways(_edges(spark, d))
    nodes = L.weighted_nodes(p.select("cloud", F.col("pid").alias("node")), links).withColumn("community", F.col("node"))
    return rounded(L.best_moves(nodes, links).select("cloud", "node", "k", "to", "gain"), 9)


MOVES_SQL = with_views("pts_small") + f""", {knn(10)}, e as (select distinct cloud, least(pid1, pid2) as a, greatest(pid1, pid2) as b from near where pid1 <> pid2 and sqrt(d2) < 0.25), l as (select cloud, a, b from e union all select cloud, b, a from e),
 dg as (select cloud, a as node, count(*)::double as k from l group by 1, 2), m as (select cloud, sum(k) as m2 from dg group by 1), st as (select p.cloud, p.pid as node, coalesce(k, 0) as k, coalesce(m2, 0) as m2 from pts_small p left join dg on dg.cloud = p.cloud and dg.node = p.pid left join m on m.cloud = p.cloud),
 cd as (select s.cloud, s.node, s.k, s.m2, l.b as c, 1 - s.k*t.k/s.m2 as score from st s join l on l.cloud = s.cloud and l.a = s.node join st t on t.cloud = l.cloud and t.node = l.b),
 best as (select * from cd where score > 0.5*1e-12*m2 qualify row_number() over (partition by cloud, node order by score desc, c) = 1)
select st.cloud, st.node, {r('st.k', 'k', 9)}, coalesce(c, st.node) as "to", {r('coalesce(2*score/st.m2, 0)', 'gain', 9)} from st left join best on best.cloud = st.cloud and best.node = st.node"""


def community_segments(spark, d):
    """Louvain communities of the neighbour graphs, with their sizes."""
    nodes = X.pts_small(spark, d).select("cloud", F.col("pid").alias("node"))
    found = L.louvain(_edges(spark, d), nodes, cutter(spark))
    return found.groupBy("cloud", "community").agg(F.count("*").alias("n"), F.max("node").alias("last"))


def extracted_features(spark, d):
    out = T.extracted_features(X.pts_lumps(spark, d), cutter(spark), least=6, cosine=0.3)
    return rounded(out.withColumn("adjacent", F.concat_ws(",", F.col("adjacent").cast("array<string>"))), 4)


def community_features(spark, d):
    """Bare clouds to classified communities."""
    return rounded(T.community_features(X.pts_lumps(spark, d), cutter(spark), reach=0.25, least=4)[1], 4)


def incidences(spark, d):
    """Links (model_id, parent, child) of solids, shells, faces, wires, edges and vertices over the edge and face view."""
    e = X.edge_faces(spark, d)
    name = R.shape
    steps = [
        (name("solid", F.col("model_id")), name("shell", F.col("face_id") % 3)), (name("shell", F.col("face_id") % 3), name("face", F.col("face_id"))), (name("face", F.col("face_id")), name("wire", F.col("face_id"))),
        (name("wire", F.col("face_id")), name("edge", F.col("edge_id"))), (name("edge", F.col("edge_id")), name("vertex", F.col("edge_id") % 17)), (name("edge", F.col("edge_id")), name("vertex", F.col("edge_id") % 23 + 20)),
    ]
    return e.select("model_id", F.explode(F.array(*(F.struct(p.alias("parent"), c.alias("child")) for p, c in steps))).alias("s")).select("model_id", "s.*").distinct()


def shape_hierarchy(spark, d):
    """Every shape's descendants at any depth, counted by kind."""
    return R.shape_counts(R.closure(incidences(spark, d), cutter(spark)))


HIERARCHY_SQL = with_views("edge_faces").replace("with ", "with recursive ", 1) + """, l as (select distinct model_id, unnest([{'p': 'solid:' || model_id, 'c': 'shell:' || face_id%3}, {'p': 'shell:' || face_id%3, 'c': 'face:' || face_id}, {'p': 'face:' || face_id, 'c': 'wire:' || face_id},
  {'p': 'wire:' || face_id, 'c': 'edge:' || edge_id}, {'p': 'edge:' || edge_id, 'c': 'vertex:' || edge_id%17}, {'p': 'edge:' || edge_id, 'c': 'vertex:' || (edge_id%23 + 20)}]) as s from edge_faces),
 ways as (select model_id, s.p as t, s.c as b from l union select w.model_id, w.t, l.s.c from ways w join l on l.model_id = w.model_id and l.s.p = w.b)
select model_id, split_part(t, ':', 1) as top_kind, split_part(b, ':', 1) as bottom_kind, count(*) as ways, count(distinct t) as tops, count(distinct b) as bottoms from ways group by all"""


def wire_order(spark, d):
    """Orders as edges: in each wire one leads to the next by date; even wires are closed, odd ones open."""
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 4).alias("model_id"), (F.col("o_custkey") % 40).alias("wire"), F.col("o_orderkey").alias("edge"), "o_orderdate")
    w = Window.partitionBy("wire").orderBy("o_orderdate", "edge")
    after, begin = F.lead("edge").over(w), F.first("edge").over(w)
    e = o.select("model_id", "wire", "edge", F.col("edge").alias("start"), F.coalesce(after, F.when(F.col("wire") % 2 == 0, begin).otherwise(-F.col("edge"))).alias("end"))
    return R.ordered_wires(e, cutter(spark))


WIRES_SQL = """with recursive o as (select o_custkey%4 as model_id, o_custkey%40 as wire, o_orderkey as edge, o_orderdate as t from orders), e as (select model_id, wire, edge, edge as start, coalesce(lead(edge) over w, case when wire%2 = 0 then first(edge) over w else -edge end) as "end" from o window w as (partition by wire order by t, edge)),
 heads as (select wire, coalesce(min(edge) filter (edge not in (select "end" from e)), min(edge)) as head from e group by 1), walk as (select e.*, 0 as place, head from e join heads using (wire) where edge = head union all select e.*, place + 1, head from walk w join e on e.wire = w.wire and e.start = w."end" where e.edge <> head)
select model_id, wire, edge, start, "end", place from walk"""


def order_numbers(spark, d):
    """A running number over all orders by date, priority and key."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_orderpriority", "o_orderkey")
    return Q.running_numbers(o, o.columns, cutter(spark))


NUMBERS_SQL = "select o_orderdate, o_orderpriority, o_orderkey, row_number() over (order by o_orderdate, o_orderpriority, o_orderkey) - 1 as number from orders"


QUERIES = [
    ("adaptive_clusters", adaptive_clusters, ADAPTIVE_SQL), ("level_segments", level_segments, LEVELS_SQL), ("routed_segments", routed_segments, _routed_sql()), ("community_moves", community_moves, MOVES_SQL),
    ("community_segments", community_segments, None), ("extracted_features", extracted_features, None), ("community_features", community_features, None),
    ("shape_hierarchy", shape_hierarchy, HIERARCHY_SQL), ("wire_order", wire_order, WIRES_SQL), ("order_numbers", order_numbers, NUMBERS_SQL),
]
