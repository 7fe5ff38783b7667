"""Topology, matching, vectors, metrics, splits and clusters."""

from pyspark.sql import functions as F

from partloom.functions import vectors as V
from partloom.operators import clusters as C
from partloom.operators import matching as M
from partloom.operators import metrics as Q
from partloom.operators import segments as G
from partloom.operators import spatial as S
from partloom.operators import topology as P
from partloom.plans.runtime import cutter
from partloom.plans.shape_queries import curvature_cte, knn, r, rounded
from partloom.sources import fixtures as X
from partloom.sources.fixtures import with_views

ADJ = "two as (select model_id, edge_id, min(face_id) a, max(face_id) b from edge_faces group by 1, 2 having count(*) = 2), adj as (select model_id, a, b from two union select model_id, b, a from two)"


def face_adjacency(spark, d):
    return P.face_adjacency(X.edge_faces(spark, d))


ADJACENCY_SQL = with_views("edge_faces") + f", {ADJ} select * from adj"


def holes(spark, d):
    return P.holes(P.face_adjacency(X.edge_faces(spark, d)), X.faces(spark, d))


HOLES_SQL = with_views("edge_faces", "faces") + f""", {ADJ}, n as (select model_id, a as face_id, count(*) as planes from adj join faces f on f.model_id = adj.model_id and f.face_id = b and f.surface_type = 0 group by adj.model_id, a)
select f.model_id, f.face_id, case when planes >= 2 then 'through_hole' else 'blind_hole' end as type, planes from faces f join n using (model_id, face_id) where surface_type = 1""".replace("select model_id, a as face_id", "select adj.model_id, a as face_id")


def features(spark, d):
    return P.recognise(P.face_adjacency(X.edge_faces(spark, d)), X.faces(spark, d))


def recognised_features(spark, d):
    return features(spark, d).select("model_id", "feat_idx", "type", F.concat_ws(",", F.col("face_ids").cast("array<string>")).alias("face_ids"))


def hole_features(spark, d):
    """The first stage of the cascade, which is a join: every cylinder next to planes, with its planes."""
    out = features(spark, d).where("type in ('through_hole', 'blind_hole')")
    return out.select("model_id", "type", F.col("face_ids")[0].alias("face_id"), F.concat_ws(",", F.expr("slice(face_ids, 2, size(face_ids))").cast("array<string>")).alias("planes"))


HOLE_FEATURES_SQL = with_views("edge_faces", "faces") + f""", {ADJ}, n as (select adj.model_id, a as face_id, count(*) as c, string_agg(b::varchar, ',' order by b) as planes from adj join faces f on f.model_id = adj.model_id and f.face_id = b and f.surface_type = 0 group by adj.model_id, a)
select f.model_id, case when c >= 2 then 'through_hole' else 'blind_hole' end as type, f.face_id, planes from faces f join n using (model_id, face_id) where surface_type = 1"""


def components(spark, d):
    e = P.face_adjacency(X.edge_faces(spark, d))
    return P.components(e, X.faces(spark, d), cutter(spark))


COMPONENTS_SQL = (with_views("edge_faces", "faces") + f", {ADJ}").replace("with ", "with recursive ", 1) + """, e as (select * from adj),
 reach as (select model_id, face_id, face_id as label from faces union select e.model_id, e.b, reach.label from reach join e on e.model_id = reach.model_id and e.a = reach.face_id),
 low as (select model_id, face_id, min(label) as label from reach group by 1, 2) select model_id, face_id, dense_rank() over (partition by model_id order by label) - 1 as component from low"""


def face_groups(spark, d):
    return rounded(G.face_group(X.faces(spark, d), ["model_id"]).withColumn("type_hist", F.concat_ws(",", F.col("type_hist").cast("array<string>"))))


FACE_GROUPS_SQL = with_views("faces") + """, k as (select model_id, surface_type, count(*) n, sum(area_mm2) s from faces group by 1, 2), g as (select model_id, arg_max(surface_type, n*100 - surface_type) as dominant_type, sum(s) as area, count(*) > 1 as mixed, map(list(surface_type), list(n)) as h from k group by 1)
select model_id, dominant_type, area, mixed, array_to_string(list_transform(range(0, 10), lambda i: coalesce(h[i::int], 0)::varchar), ',') as type_hist, case when dominant_type = 1 then 'hole_or_boss' when dominant_type = 4 and area < 100 then 'fillet' when dominant_type = 4 then 'revolved_surface' when dominant_type = 0 then 'plane_patch' when dominant_type = 6 then 'freeform' else 'unknown' end as label from g"""


def segment_face_classes(spark, d):
    f = X.faces(spark, d).withColumn("seg", F.col("face_id") % 13)
    g = f.groupBy("model_id", "seg").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("surface_type")).alias("kinds"), F.countDistinct("face_id").alias("adjacent"))
    return g.select("model_id", "seg", G.segment_face_class(F.col("n") * 80, F.col("kinds"), F.col("adjacent") - 2).alias("label"))


SEGMENT_FACE_SQL = with_views("faces") + """, g as (select model_id, face_id%13 as seg, count(*)*80 as n, list(distinct surface_type) as k, count(distinct face_id) - 2 as a from faces group by 1, 2)
select model_id, seg, case when list_contains(k, 1) and a >= 2 then 'hole' when k = [0] and n > 200 then 'pocket' when k = [0] then 'planar_face' when list_contains(k, 1) and list_contains(k, 0) then 'slot' when list_contains(k, 0) and n < 200 then 'chamfer' when list_contains(k, 4) or list_contains(k, 2) then 'fillet' else 'unknown' end as label from g"""


def _feature_table(spark, d):
    """Features without the sequential stages, so that SQL can follow: one feature per face pair modulo."""
    f = X.faces(spark, d).withColumn("feat_idx", (F.col("face_id") % 17).cast("int"))
    extra = X.faces(spark, d).where("face_id % 11 = 0").withColumn("feat_idx", (F.col("face_id") % 5).cast("int"))
    return f.union(extra).groupBy("model_id", "feat_idx").agg(F.array_sort(F.collect_set("face_id")).alias("face_ids"))


FEATURES = "feats as (select distinct model_id, face_id%17 as seg, face_id from faces union select model_id, face_id%5, face_id from faces where face_id%11 = 0)"


def _face_points(spark, d):
    return X.edge_faces(spark, d).select("model_id", "face_id", F.col("edge_id").alias("pid"))


def point_labels(spark, d):
    return P.point_labels(_face_points(spark, d), _feature_table(spark, d))


POINT_LABELS_SQL = with_views("edge_faces", "faces") + f", {FEATURES}, own as (select model_id, face_id, max(seg) as label from feats group by 1, 2) select model_id, face_id, edge_id as pid, coalesce(label, -1) as label from edge_faces left join own using (model_id, face_id)"


def segment_points(spark, d):
    return P.segment_points(_face_points(spark, d), _feature_table(spark, d)).groupBy("model_id", "feat_idx").agg(F.count("*").alias("n"))


SEGMENT_POINTS_SQL = with_views("edge_faces", "faces") + f", {FEATURES} select model_id, seg as feat_idx, count(*) as n from edge_faces join feats using (model_id, face_id) group by 1, 2 having count(*) >= 10"


def segment_adjacency(spark, d):
    return P.segment_adjacency(_feature_table(spark, d), P.face_adjacency(X.edge_faces(spark, d)))


SEGMENT_ADJ = f"""{ADJ}, {FEATURES}, placed as (select *, row_number() over (partition by model_id, seg order by face_id) - 1 as place from feats), own as (select model_id, face_id, max(seg) as seg from feats group by 1, 2),
 met as (select p.model_id, p.seg, o.seg as other, adj.a as face, adj.b as other_face from placed p join adj on adj.model_id = p.model_id and adj.a = p.face_id join own o on o.model_id = p.model_id and o.face_id = adj.b
  where p.seg <> o.seg qualify row_number() over (partition by p.model_id, p.seg, o.seg order by place, adj.b) = 1)"""
SEGMENT_ADJ_SQL = with_views("edge_faces", "faces") + f", {SEGMENT_ADJ} select * from met"


def _segment_pairs(spark, d):
    pos = X.faces(spark, d).join(_feature_table(spark, d).select("model_id", "feat_idx", F.explode("face_ids").alias("face_id")), ["model_id", "face_id"])
    xyz = {"x": (F.col("face_id") % 7).cast("double"), "y": (F.col("face_id") % 5).cast("double"), "z": (F.col("face_id") % 3).cast("double")}
    seg = pos.groupBy("model_id", F.col("feat_idx").alias("seg")).agg(*(f(xyz[k]).alias(n) for k in "xyz" for f, n in ((F.avg, f"c{k}"), (F.min, f"{k}0"), (F.max, f"{k}1"))), F.sum("area_mm2").alias("area"))
    other = seg.select("model_id", F.col("seg").alias("other"), *(F.col(c).alias(f"o_{c}") for c in seg.columns if c not in ("model_id", "seg")))
    return P.segment_adjacency(_feature_table(spark, d), P.face_adjacency(X.edge_faces(spark, d))).join(seg, ["model_id", "seg"]).join(other, ["model_id", "other"])


def segment_relations(spark, d):
    out = P.containment(_segment_pairs(spark, d))
    rel = V.relation((F.col("seg") % 3 - 1.0, F.lit(0.5), F.col("seg") % 2 - 0.5), tuple(F.col(f"c{k}") for k in "xyz"), tuple(F.col(f"o_c{k}") for k in "xyz"))
    return out.select("model_id", "seg", "other", "contains", "inside", rel.alias("relation"))


SEGS = """xyz as (select model_id, seg, (face_id%7)::double x, (face_id%5)::double y, (face_id%3)::double z, area_mm2 from faces join feats using (model_id, face_id)),
 s as (select model_id, seg, avg(x) cx, min(x) x0, max(x) x1, avg(y) cy, min(y) y0, max(y) y1, avg(z) cz, min(z) z0, max(z) z1, sum(area_mm2) area from xyz group by 1, 2)"""
RELATIONS_CTE = f"""{SEGMENT_ADJ}, {SEGS}, pr as (select met.model_id, met.seg, met.other, a.cx, a.cy, a.cz, o.cx as ox, o.cy as oy, o.cz as oz,
  o.cx between a.x0 and a.x1 and o.cy between a.y0 and a.y1 and o.cz between a.z0 and a.z1 and o.area < 0.8*a.area as contains, a.cx between o.x0 and o.x1 and a.cy between o.y0 and o.y1 and a.cz between o.z0 and o.z1 and a.area < 0.8*o.area as inside,
  met.seg%3 - 1.0::double as nx, 0.5::double as ny, met.seg%2 - 0.5::double as nz from met join s a on a.model_id = met.model_id and a.seg = met.seg join s o on o.model_id = met.model_id and o.seg = met.other),
 dt as (select *, sqrt((ox-cx)*(ox-cx) + (oy-cy)*(oy-cy) + (oz-cz)*(oz-cz)) as w, sqrt(nx*nx+ny*ny+nz*nz) as nn from pr),
 rel as (select *, (nx*(ox-cx) + ny*(oy-cy) + nz*(oz-cz))/(nn*case when w > 1e-6 then w else 1 end) as dot from dt)"""
RELATIONS_SQL = with_views("edge_faces", "faces") + f", {RELATIONS_CTE} select model_id, seg, other, contains, inside, case when dot > 0.2 then 'convex' when dot < -0.2 then 'concave' else 'orthogonal' end as relation from rel"


def segment_topology(spark, d):
    """Degree, contained and containing segments per segment."""
    rel = segment_relations(spark, d)
    pick = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col(c), F.format_string("seg_%03d", "other")))))
    return rel.groupBy("model_id", "seg").agg(F.count("*").alias("degree"), pick("contains").alias("contains"), pick("inside").alias("inside"), *(F.count(F.when(F.col("relation") == k, 1)).alias(k) for k in ("convex", "concave", "orthogonal")))


TOPOLOGY_SQL = with_views("edge_faces", "faces") + f""", {RELATIONS_CTE} select model_id, seg, count(*) as degree, coalesce(string_agg(printf('seg_%03d', other), ',' order by other) filter (contains), '') as contains, coalesce(string_agg(printf('seg_%03d', other), ',' order by other) filter (inside), '') as inside,
 count(*) filter (dot > 0.2) as convex, count(*) filter (dot < -0.2) as concave, count(*) filter (dot between -0.2 and 0.2) as orthogonal from rel group by 1, 2"""


def _labels(spark, d):
    return X.labels_2d(spark, d).select("model_id", "id", "pos", F.col("nominal").alias("value"), "tol", "text", F.lit("").alias("raw_text"), "category", "px", "py")


def _measured(spark, d):
    return X.measured_3d(spark, d).withColumn("values", F.array(F.struct(F.col("key").alias("key"), F.col("value").alias("value"))))


def match_scores(spark, d):
    out = M.scores(_labels(spark, d), _measured(spark, d))
    return rounded(out.select("model_id", "src", "dst", "score", "geom", "spatial", "deviation", "status"), 9)


SCORES_CTE = """al as (select *, case when contains(category, 'hole') or contains(text, '⌀') then ['through_hole', 'blind_hole', 'cylinder', 'sphere'] when contains(category, 'datum') then ['plane', 'cylinder']
  when contains(category, 'width') or contains(category, 'slot') then ['slot', 'pocket'] when contains(category, 'chamfer') or contains(lower(text), 'r') then ['chamfer', 'fillet', 'sphere', 'cone'] else ['plane', 'pocket', 'cylinder', 'cone', 'through_hole', 'blind_hole'] end as kinds from labels_2d),
 pr as (select l.model_id, l.id as src, m.id as dst, l.pos as i, m.pos as j, m.type, nominal as value, tol, px, py, sx, sy, n_adjacent, case when key = 'radius' and contains(text, '⌀') then m.value*2 when key = 'diameter' and contains(lower(text), 'r') and not contains(text, '⌀') then m.value/2 else m.value end as c
  from al l join measured_3d m on l.model_id = m.model_id and list_contains(kinds, m.type)),
 g as (select *, abs(value - c) as err, greatest(0, 1 - sqrt((px-sx)*(px-sx) + (py-sy)*(py-sy))/100) as spatial, case when n_adjacent > 0 then least(1.0, 0.5 + 0.1*n_adjacent) else 0.5 end as topo from pr),
 h as (select *, case when err <= tol then 1.0 when err <= tol*2 then 0.7 else greatest(0, 0.7 - (err - tol*2)/value) end as geom from g),
 sc as (select *, 0.20 + 0.75*geom + 0.01*spatial + 0.04*topo as score from h where 0.20 + 0.75*geom + 0.01*spatial + 0.04*topo >= 0.6)"""
SCORES_SQL = with_views("labels_2d", "measured_3d") + f", {SCORES_CTE} select model_id, src, dst, {r('score', 'score', 9)}, {r('geom', 'geom', 9)}, {r('spatial', 'spatial', 9)}, {r('err', 'deviation', 9)}, case when err <= tol then 'IN_TOLERANCE' else 'OUT_OF_TOLERANCE' end as status from sc"


def greedy_matches(spark, d):
    out = M.greedy_bands(_labels(spark, d), _measured(spark, d), cutter(spark))
    return rounded(out.select("model_id", "src", "dst", "score", "status"), 5)


GREEDY_SQL = with_views("labels_2d", "measured_3d").replace("with ", "with recursive ", 1) + f""", {SCORES_CTE.replace('sc as (', 'sc as materialized (')}, pick as (
 select model_id, src, dst, score, err, tol, [i] as is_, [j] as js from sc qualify row_number() over (partition by model_id order by score desc, i, j) = 1
 union all select model_id, src, dst, score, err, tol, is_, js from (select sc.model_id, sc.src, sc.dst, sc.score, sc.err, sc.tol, list_append(p.is_, sc.i) as is_, list_append(p.js, sc.j) as js,
   row_number() over (partition by sc.model_id order by sc.score desc, sc.i, sc.j) as best from pick p join sc on sc.model_id = p.model_id where not list_contains(p.is_, sc.i) and not list_contains(p.js, sc.j)) where best = 1)
select model_id, src, dst, {r('score', 'score', 5)}, case when err <= tol then 'IN_TOLERANCE' else 'OUT_OF_TOLERANCE' end as status from pick"""


def optimal_matches(spark, d):
    return rounded(M.best_matches(_labels(spark, d), _measured(spark, d), cutter(spark)).select("model_id", "src", "dst", "score"), 5)


def top_candidates(spark, d):
    """Best label per measured feature, the first rule of the greedy matching."""
    return M.best_labels(_labels(spark, d), _measured(spark, d))


TOP_SQL = with_views("labels_2d", "measured_3d") + f", {SCORES_CTE} select model_id, dst, src from sc qualify row_number() over (partition by model_id, dst order by round(score, 9) desc, i) = 1"


def graph_edge_counts(spark, d):
    rel = segment_relations(spark, d).select("model_id", F.format_string("seg_%03d", "seg").alias("src"), F.format_string("seg_%03d", "other").alias("dst"), "relation")
    m = M.score_counts(_labels(spark, d), _measured(spark, d)).select("model_id", F.lit("correspondence").alias("type"), "listed")
    e = rel.select("model_id", F.concat(F.lit("adjacent_3d_"), "relation").alias("type"), F.lit(1).cast("long").alias("listed"))
    return M.edge_counts(e.unionByName(m))


EDGE_COUNTS_SQL = with_views("edge_faces", "faces", "labels_2d", "measured_3d") + f""", {RELATIONS_CTE}, {SCORES_CTE.replace('pr as (', 'mp as (').replace('from pr)', 'from mp)')}, e as (select model_id, 'adjacent_3d_' || case when dot > 0.2 then 'convex' when dot < -0.2 then 'concave' else 'orthogonal' end as type from rel union all select model_id, 'correspondence' from sc)
select model_id, type, count(*) as listed, (case when type like 'adjacent%' then count(*)//2 else count(*) end)::bigint as n from e group by 1, 2"""


def training_pairs(spark, d):
    """Labels and features carry their dense index into the scoring, so that no pair is joined again."""
    a, b = (M.dense_index(x(spark, d)).withColumn("idx", F.col("idx").cast("int")) for x in (_labels, _measured))
    m = M.scores(a.withColumnRenamed("idx", "s"), b.withColumnRenamed("idx", "d"), F.col("err") <= F.col("tol"), ("s",), ("d",))
    return M.training_edges(M.correspondences(m, "s", "d")).select("model_id", "s", "d")


TRAINING_SQL = with_views("labels_2d", "measured_3d") + f""", {SCORES_CTE}, a as (select model_id, id, row_number() over (partition by model_id order by pos) - 1 as k from labels_2d), b as (select model_id, id, row_number() over (partition by model_id order by pos) - 1 as k from measured_3d)
select sc.model_id, a.k as s, b.k as d from sc join a on a.model_id = sc.model_id and a.id = src join b on b.model_id = sc.model_id and b.id = dst where round(score, 3) >= 0.8 and err <= tol"""


def edge_attributes(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 40).alias("model_id"), (F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 30).alias("dst"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("deviation"), F.lit(None).cast("double").alias("weight"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("o"))
    return M.last_attributes(e, "o")


ATTRIBUTES_SQL = """with e as (select l_orderkey%40 as model_id, l_partkey%50 as src, l_suppkey%30 as dst, case when l_linenumber > 1 then l_quantity end as deviation, l_shipdate, l_orderkey, l_linenumber, l_quantity from lineitem)
select model_id, src, dst, coalesce(deviation, 0.0) as deviation, 1.0::double as weight from e qualify row_number() over (partition by model_id, src, dst order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_quantity desc) = 1"""

def _vector_inputs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    kind = F.element_at(F.array(*map(F.lit, X.KINDS_3D)), (F.col("p_partkey") % 9 + 1).cast("int"))
    m = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("diameter"), F.col("p_size").cast("double"), F.lit("depth"), F.col("p_retailprice") / 10)).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("radius"), F.col("p_size").cast("double"))).otherwise(
        F.create_map(F.lit("length"), F.col("p_size").cast("double"), F.lit("base_radius"), F.col("p_retailprice") / 10, F.lit("max_dimension"), F.lit(1.0))
    )
    return p.select(F.col("p_partkey").alias("pos"), kind.alias("kind"), m.alias("m"), (F.col("p_size") / 50).alias("c"), (F.col("p_partkey") % 4).cast("int").alias("deg"))


def node_vectors(spark, d):
    v = _vector_inputs(spark, d)
    c = (F.col("c"), F.col("c") / 2, F.col("c") * 2)
    rels = F.slice(F.array(*map(F.lit, ("convex", "concave", "convex"))), F.lit(1), F.greatest(F.col("deg"), F.lit(0)))
    a = V.node_vector_18(F.col("kind"), F.col("m"), F.col("c") * 100, c, F.col("c") / 3, F.col("deg"), F.lit(0.9))
    b = V.node_vector_24(F.col("kind"), F.col("m"), F.col("c") * 100, c, F.col("c") / 3, rels, F.slice(rels, 1, 1), F.slice(rels, 2, 1), F.lit(0.9))
    out = v.select("pos", V.measured_value(F.col("m")).alias("measured"), a.alias("a"), b.alias("b"))
    return rounded(out.select("pos", "measured", *(F.col("a")[i].alias(f"a{i:02d}") for i in range(18)), *(F.col("b")[i].alias(f"b{i:02d}") for i in range(24))))


def _vectors_sql():
    base = "p as (select p_partkey as pos, p_partkey%3 as k, p_partkey%9 as kd, p_size::double as s, p_retailprice/10 as t, p_size/50.0::double as c, (p_partkey%4)::int as deg from part)"
    kind = "(case kd when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 2 when 4 then 3 when 5 then 4 when 6 then 5 when 7 then 6 else 7 end)::double"
    rad, dia = "case k when 0 then s/2 when 1 then s else 0 end", "case k when 0 then s when 1 then s*2 else 0 end"
    a = [kind, rad, dia, "case k when 2 then s else 0 end", "0.0", "case k when 0 then t else 0 end", "0.0", "0.0", "case k when 2 then t else 0 end", "0.0", "c*100", "c", "c/2", "c*2", "c/3", "deg::double", "0.9", "0.0"]
    ln = lambda x: f"ln(1 + ({x}))"
    b = [f"{kind}/10.0", ln(rad), ln(dia), ln(a[3]), "0.0", ln(a[5]), "0.0", ln(a[8]), "0.0", ln("c*100"), "c*10", "c/2*10", "c*2*10", "c/3", "case deg when 0 then 0 when 1 then 0.1 when 2 then 0.1 else 0.2 end", "case when deg >= 2 then 0.1 else 0 end", "0.0", "case when deg >= 1 then 1 else 0 end", "case when deg >= 2 then 1 else 0 end", "0.9", *["0.0"] * 4]
    cols = [r(f"({x})::double", f"a{i:02d}") for i, x in enumerate(a)] + [r(f"({x})::double", f"b{i:02d}") for i, x in enumerate(b)]
    return f"with {base} select pos, {r('case k when 1 then s*2 else s end', 'measured')}, {', '.join(cols)} from p"


def label_vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("pos"), "embedding")
    rows = X.labels_2d(spark, d).join(e, "pos")
    visual = F.concat("embedding", "embedding", "embedding", "embedding")
    n, raw = V.label_vector_260(F.col("nominal"), F.col("tol"), F.col("px"), F.col("py"), visual), V.label_vector_260(F.col("nominal"), F.col("tol"), F.col("px"), F.col("py"), visual, raw=True)
    full = V.label_vector_1028(F.slice(raw, 1, 4), F.array().cast("array<float>"), visual)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return rounded(rows.select("id", F.size(n).alias("n"), F.size(full).alias("full"), n[0].alias("v0"), n[1].alias("v1"), n[2].alias("v2"), n[4].alias("v4"), n[259].alias("v259"), raw[259].alias("raw259"), add(full).alias("total")), 5)


LABEL_VECTORS_SQL = with_views("labels_2d") + f""", j as (select l.*, list_transform(embedding, lambda x: x::double) as e from labels_2d l join embeddings on vec_id = pos), k as (select *, sqrt(4*list_dot_product(e, e) + 1e-8) as len from j)
select id, 260 as n, 1028 as full, {r('ln(1+nominal)', 'v0', 5)}, {r('ln(1+tol)', 'v1', 5)}, {r('px/1000', 'v2', 5)}, {r('e[1]/len', 'v4', 5)}, {r('e[64]/len', 'v259', 5)}, {r('e[64]', 'raw259', 5)}, {r('nominal+tol+px+py+4*list_sum(e)', 'total', 5)} from k"""


def _sides(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("cloud"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


def pair_vectors(spark, d):
    a, b = _sides(spark, d)
    rows = a.select("cloud", F.col("vec_id").alias("pos"), F.col("v").alias("z2")).join(b.select(F.col("cloud").alias("c3"), (F.col("vec_id") - 1).alias("pos"), F.col("v").alias("z3")), "pos")
    rows = rows.join(X.labels_2d(spark, d).select("pos", "nominal", "tol", "text"), "pos").join(X.measured_3d(spark, d).select("pos", "value"), "pos")
    v = V.pair_vector(F.col("z2"), F.col("z3"), F.col("nominal"), F.col("tol"), F.col("value"), F.col("text"))
    return rounded(rows.select("pos", F.size(v).alias("n"), v[128].alias("d0"), v[192].alias("cos"), v[193].alias("dev"), v[194].alias("tol"), v[195].alias("rel"), v[196].alias("k0"), v[198].alias("k2")), 5)


PAIRS_SQL = with_views("labels_2d", "measured_3d") + f""", e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), j as (select l.pos, nominal, tol, text, m.value, a.v as a, b.v as b from labels_2d l join measured_3d m using (pos) join e a on a.vec_id = l.pos and l.pos%2 = 0 join e b on b.vec_id = l.pos + 1)
select pos, 205 as n, {r('abs(a[1]-b[1])', 'd0', 5)}, {r('list_dot_product(a, b)/(sqrt(list_dot_product(a, a))*sqrt(list_dot_product(b, b)))', 'cos', 5)}, {r('ln(1+abs(nominal-value))', 'dev', 5)}, {r('ln(1+tol)', 'tol', 5)}, {r('ln(1+abs(nominal-value)/(tol+1e-6))', 'rel', 5)},
 case when contains(text, '⌀') then 0.0 else 1.0 end::double as k0, case when contains(text, '⌀') then 1.0 else 0.0 end::double as k2 from j"""


def recall_at_1(spark, d):
    a, b = _sides(spark, d)
    return rounded(Q.recall_at_1(a.select("cloud", F.col("vec_id").alias("qid"), "v", (F.col("vec_id") + 1).alias("truth")), b.select("cloud", F.col("vec_id").alias("kid"), "v")))


UNITS = "u as (select vec_id, label as cloud, list_transform(embedding, lambda x: x::double) as v from embeddings), w as (select vec_id, cloud, list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) as v from u)"
RECALL_SQL = f"""with {UNITS}, s as (select a.cloud, a.vec_id as q, b.vec_id as k from w a join w b on a.cloud = b.cloud and a.vec_id%2 = 0 and b.vec_id%2 = 1 qualify row_number() over (partition by a.cloud, a.vec_id order by round(list_dot_product(a.v, b.v), 9) desc, b.vec_id) = 1)
select cloud, count(*) as n, {r('avg(case when k = q+1 then 1.0 else 0.0 end)', 'recall_at_1')} from s group by 1"""


def contrastive_loss(spark, d):
    a, b = _sides(spark, d)
    p = a.select(F.col("vec_id").alias("eid"), "cloud", F.col("v").alias("a")).join(b.select((F.col("vec_id") - 1).alias("eid"), F.col("v").alias("b")), "eid")
    return rounded(Q.contrastive_loss(p, 0.2))


LOSS_SQL = f"""with {UNITS}, p as (select a.vec_id as eid, a.cloud, a.v as a, b.v as b from w a join w b on b.vec_id = a.vec_id + 1 where a.vec_id%2 = 0), l as (select x.cloud, x.eid as i, y.eid as j, list_dot_product(x.a, y.b)/0.2 as l from p x join p y using (cloud)),
 o as (select cloud, ln(sum(exp(l))) - max(l) filter (i = j) as loss from l group by cloud, i union all select cloud, ln(sum(exp(l))) - max(l) filter (i = j) from l group by cloud, j) select cloud, {r('avg(loss)', 'loss')} from o group by 1"""


def classifier_scores(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10)) > 0.5).cast("int").alias("p"))
    return rounded(Q.precision_recall_f1(rows, F.col("y"), F.col("p")))


SCORING_SQL = f"""with s as (select (l_returnflag = 'R')::int as y, (1/(1 + exp(-(l_quantity-25)/10)) > 0.5)::int as p from lineitem), c as (select sum(y*p)::bigint tp, sum((1-y)*p)::bigint fp, sum(y*(1-p))::bigint fn, sum(y)::bigint positives, sum(1-y)::bigint negatives from s),
 m as (select *, case when tp+fp > 0 then tp/(tp+fp) else 0 end as precision, case when tp+fn > 0 then tp/(tp+fn) else 0 end as recall from c) select tp, fp, fn, positives, negatives, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('case when precision+recall > 0 then 2*precision*recall/(precision+recall) else 0 end', 'f1')} from m"""


def run_statistics(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rounded(Q.run_statistics(rows, F.col("event_type") != "error", F.col("value")), 4)


STATISTICS_SQL = f"select count(*) as total, count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed, {r('count(*) filter (event_type <> ' + chr(39) + 'error' + chr(39) + ')*100.0/count(*)', 'success_rate', 4)}, {r('sum(value)/count(*) filter (event_type <> ' + chr(39) + 'error' + chr(39) + ')', 'average_made', 4)} from events"


def splits(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 7).alias("label"))
    a = Q.positional_split(rows, "p_partkey").withColumnRenamed("split", "positional")
    b = Q.part_split(a, "p_partkey").withColumnRenamed("split", "by_part")
    return Q.stratified_split(b, "label", "p_partkey").withColumnRenamed("split", "stratified")


SPLITS_SQL = """with p as (select p_partkey, p_partkey%7 as label, ('0x' || substr(md5(p_partkey::varchar), 1, 8))::bigint/4294967296.0::double as u from part)
select p_partkey, label, case when row_number() over (order by p_partkey) <= floor(count(*) over ()*0.8::double + 1e-9) then 'train' else 'val' end as positional, case when u < 0.7 then 'train' when u < 0.7::double + 0.2::double then 'val' else 'test' end as by_part,
 case when row_number() over (partition by label order by md5(p_partkey::varchar), p_partkey) <= floor(count(*) over (partition by label)*0.8::double + 1e-9) then 'train' else 'val' end as stratified from p"""


def best_epochs(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("epoch"), F.round(F.col("o_totalprice") / 1000).alias("metric"))
    return Q.best_epoch(rows, "metric")


EPOCH_SQL = "select arg_max(epoch, m*1e9 - epoch) as epoch, max(m) as metric from (select o_orderkey as epoch, round(o_totalprice/1000) as m from orders)"


def correspondence(spark, d):
    """First dimension that may describe a measured feature, else a made-up one, with deviation and confidence."""
    f = X.measured_3d(spark, d).withColumn("dim", F.when(F.col("key") == "length", "length").otherwise(F.col("key")))
    l = X.labels_2d(spark, d).groupBy("model_id").agg(F.min_by(F.struct("id", "nominal", "tol"), "pos").alias("l"))
    out = f.join(l.where("model_id % 3 > 0"), "model_id", "left")
    nominal = F.coalesce("l.nominal", F.col("value"))
    conf = V.correspondence_confidence(F.col("pos") % 150, F.col("type"), F.col("key").isin("radius", "diameter"))
    return rounded(out.select("model_id", "id", F.col("l.id").alias("label"), nominal.alias("nominal"), F.coalesce("l.tol", nominal * 0.02).alias("tol"), F.abs(nominal - F.col("value")).alias("deviation"), conf.alias("confidence")))


CORRESPONDENCE_SQL = with_views("labels_2d", "measured_3d") + f""", l as (select model_id, id, nominal, tol from labels_2d where model_id%3 > 0 qualify row_number() over (partition by model_id order by pos) = 1)
select m.model_id, m.id, l.id as label, {r('coalesce(nominal, value)', 'nominal')}, {r('coalesce(tol, value*0.02)', 'tol')}, {r('abs(coalesce(nominal, value) - value)', 'deviation')},
 {r("least(1.0, 0.5 + case when pos%150 > 100 then 0.2 when pos%150 > 50 then 0.1 else 0.0 end + case when type in ('hole', 'cylinder', 'plane', 'slot') then 0.2 else 0.0 end + case when key in ('radius', 'diameter') then 0.1 else 0.0 end)::double", 'confidence')} from measured_3d m left join l using (model_id)"""


def projections(spark, d):
    p = X.pts_small(spark, d)
    b = p.groupBy("cloud").agg(*(f(k).alias(f"{n}{k}") for k in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    diag = F.sqrt(sum(((F.col(f"hi{k}") - F.col(f"lo{k}")) * (F.col(f"hi{k}") - F.col(f"lo{k}")) for k in "yz"), (F.col("hix") - F.col("lox")) * (F.col("hix") - F.col("lox"))))
    out = p.join(b, "cloud").withColumns({f"s{k}": V.scaled(F.col(k), F.col(f"lo{k}"), F.col(f"hi{k}"), diag) for k in "xyz"})
    cols = {f"{v}_{n}": c for v in ("front", "top", "side") for n, c in zip("uv", V.projected(F.col("sx"), F.col("sy"), F.col("sz"), v))}
    return rounded(out.select("cloud", "pid", *(c.alias(n) for n, c in cols.items())))


PROJECTIONS_SQL = with_views("pts_small") + f""", b as (select cloud, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from pts_small group by 1), t as (select *, 100/(sqrt((hx-lx)*(hx-lx) + (hy-ly)*(hy-ly) + (hz-lz)*(hz-lz)) + 1e-10) as s from b),
 q as (select cloud, pid, (x-(lx+hx)/2)*s as sx, (y-(ly+hy)/2)*s as sy, (z-(lz+hz)/2)*s as sz from pts_small join t using (cloud)) select cloud, pid, {r('sx', 'front_u')}, {r('sy', 'front_v')}, {r('-sx', 'top_u')}, {r('sz', 'top_v')}, {r('-sz', 'side_u')}, {r('sy', 'side_v')} from q"""


def core_points(spark, d):
    return S.radius_join(X.pts_small(spark, d), 0.12).groupBy("cloud", F.col("pid1").alias("pid")).agg(F.count("*").alias("near")).where("near >= 4")


CORE_SQL = with_views("pts_small") + " select a.cloud, a.pid, count(*) as near from pts_small a join pts_small b on a.cloud = b.cloud and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.12*0.12 group by 1, 2 having count(*) >= 4"


def density_clusters(spark, d):
    return C.dbscan(X.pts_small(spark, d), 0.12, 4, cutter(spark))


DBSCAN_SQL = with_views("pts_small").replace("with ", "with recursive ", 1) + """, near as (select a.cloud, a.pid as p, b.pid as q from pts_small a join pts_small b on a.cloud = b.cloud and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.12*0.12),
 core as (select cloud, p from near group by 1, 2 having count(*) >= 4), link as (select n.cloud, n.p, n.q from near n join core a on a.cloud = n.cloud and a.p = n.p join core b on b.cloud = n.cloud and b.p = n.q),
 reach as (select cloud, p, p as label from core union select l.cloud, l.q, reach.label from reach join link l on l.cloud = reach.cloud and l.p = reach.p), low as (select cloud, p, min(label) as label from reach group by 1, 2),
 num as (select cloud, p, dense_rank() over (partition by cloud order by label) - 1 as k from low), border as (select n.cloud, n.p, min(k) as k from near n join num on num.cloud = n.cloud and num.p = n.q group by 1, 2)
select s.cloud, s.pid, coalesce(num.k, border.k, -1)::int as label from pts_small s left join num on num.cloud = s.cloud and num.p = s.pid left join border on border.cloud = s.cloud and border.p = s.pid"""


def grown_regions(spark, d):
    p = X.normals_small(spark, d)
    xyz = p.select("cloud", "pid", "x", "y", "z")
    rows = p.join(S.curvature(xyz, 10), ["cloud", "pid"])
    return C.grow_regions(rows, S.knn_join(xyz, 9), 0.4, 0.3, 0.2, least=5, cut=cutter(spark))


def _grown_sql() -> str:
    near = knn(9, "normals_small").replace("near as", "gnear as")
    return with_views("pts_small", "normals_small").replace("with ", "with recursive ", 1) + f""", {curvature_cte(10)}, {near}, g as (select n.*, round(curvature, 12) as bend, curvature as cv, row_number() over (partition by n.cloud order by round(curvature, 12), n.pid) as place from normals_small n join curv using (cloud, pid)),
 link as (select k.cloud, a.pid as p, b.pid as q from gnear k join g a on a.cloud = k.cloud and a.pid = pid1 join g b on b.cloud = k.cloud and b.pid = pid2 where pid1 <> pid2 and sqrt(k.d2) <= 0.4 and abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) >= 0.3 and abs(a.cv - b.cv) <= 0.2),
 reach as (select cloud, pid, place from g union select l.cloud, l.q, w.place from reach w join link l on l.cloud = w.cloud and l.p = w.pid), first as (select cloud, pid, min(place) as place from reach group by 1, 2),
 seg as (select cloud, place, row_number() over (partition by cloud order by place) - 1 as number from first group by 1, 2 having count(*) >= 5)
select f.cloud, f.pid, coalesce(number, case when f.cloud in (select cloud from seg) then -1 else 0 end)::int as segment from first f left join seg using (cloud, place)"""


QUERIES = [
    ("face_adjacency", face_adjacency, ADJACENCY_SQL), ("holes", holes, HOLES_SQL), ("recognised_features", recognised_features, None), ("hole_features", hole_features, HOLE_FEATURES_SQL), ("face_components", components, COMPONENTS_SQL),
    ("face_groups", face_groups, FACE_GROUPS_SQL), ("segment_face_classes", segment_face_classes, SEGMENT_FACE_SQL), ("point_labels", point_labels, POINT_LABELS_SQL), ("segment_points", segment_points, SEGMENT_POINTS_SQL),
    ("segment_adjacency", segment_adjacency, SEGMENT_ADJ_SQL), ("segment_relations", segment_relations, RELATIONS_SQL), ("segment_topology", segment_topology, TOPOLOGY_SQL), ("match_scores", match_scores, SCORES_SQL),
    ("greedy_matches", greedy_matches, GREEDY_SQL), ("optimal_matches", optimal_matches, None), ("top_candidates", top_candidates, TOP_SQL), ("graph_edge_counts", graph_edge_counts, EDGE_COUNTS_SQL), ("training_pairs", training_pairs, TRAINING_SQL),
    ("edge_attributes", edge_attributes, ATTRIBUTES_SQL), ("node_vectors", node_vectors, _vectors_sql()), ("label_vectors", label_vectors, LABEL_VECTORS_SQL), ("pair_vectors", pair_vectors, PAIRS_SQL), ("recall_at_1", recall_at_1, RECALL_SQL),
    ("contrastive_loss", contrastive_loss, LOSS_SQL), ("classifier_scores", classifier_scores, SCORING_SQL), ("run_statistics", run_statistics, STATISTICS_SQL), ("splits", splits, SPLITS_SQL), ("best_epochs", best_epochs, EPOCH_SQL),
    ("correspondence", correspondence, CORRESPONDENCE_SQL), ("projections", projections, PROJECTIONS_SQL), ("core_points", core_points, CORE_SQL), ("density_clusters", density_clusters, DBSCAN_SQL), ("grown_regions", grown_regions, _grown_sql()),
]
