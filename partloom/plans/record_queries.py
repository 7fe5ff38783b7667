"""Records, labels, views, whole features and training rows."""

from pyspark.sql import functions as F

from partloom.functions import records as R
from partloom.functions import vectors as V
from partloom.operators import clusters as C
from partloom.operators import features as P
from partloom.operators import matching as M
from partloom.operators import spatial as S
from partloom.operators import topology as T
from partloom.plans.graph_queries import DBSCAN_SQL, SCORES_CTE, _labels, _measured
from partloom.plans.runtime import cutter
from partloom.plans.shape_queries import DESCRIPTORS_SQL, GEO, STATS, cov_sql, curvature_cte, eig, knn, r, rounded
from partloom.sources import fixtures as X
from partloom.sources.fixtures import with_views


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def cleaned_records(spark, d):
    m = F.create_map(F.lit(" name"), F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("brand "), F.col("p_brand"))
    text = F.format_string('{"a ": [" %s ", {" b": "x  %s"}], "n": %s}', "p_name", "p_brand", F.col("p_size").cast("string"))
    out = _part(spark, d).select("p_partkey", R.clean_map(m).alias("m"), R.clean_json(text).alias("json"))
    return out.select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"), "json")


CLEANED_SQL = """select p_partkey, trim(p_name) as name, trim(p_brand) as brand,
 '{"a": ["' || p_name || '", {"b": "x  ' || p_brand || '"}], "n": ' || p_size || '}' as json from part"""


def label_numbers(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, (k % 9).cast("string")).when(k % 3 == 1, F.format_string('{"feature_id": %s, "x": 1}', (k % 9).cast("string"))).otherwise(F.format_string('{"label": %s}', (k % 9).cast("string")))
    label = R.label_number(text)
    return _part(spark, d).select("p_partkey", label.alias("label"), R.name_of(["plane", "cylinder", "cone", "sphere"], label).alias("name"))


LABEL_NUMBERS_SQL = "select p_partkey, (p_partkey%9)::int as label, case p_partkey%9 when 0 then 'plane' when 1 then 'cylinder' when 2 then 'cone' when 3 then 'sphere' end as name from part"


def neighbour_records(spark, d):
    k = F.col("p_partkey")
    item = F.when(k % 2 == 0, (k % 50).cast("string")).when(k % 3 == 0, F.format_string('{"segment": "seg_%s", "relation": "convex"}', (k % 50).cast("string"))).otherwise(F.format_string('{"segment": "seg_%s"}', (k % 50).cast("string")))
    return _part(spark, d).select("p_partkey", R.neighbour(item).alias("n")).select("p_partkey", "n.*")


NEIGHBOURS_SQL = """select p_partkey, case when p_partkey%2 = 0 then printf('seg_%03d', p_partkey%50) else 'seg_' || (p_partkey%50) end as segment,
 case when p_partkey%2 = 1 and p_partkey%3 = 0 then 'convex' else 'unknown' end as relation from part"""


def text_regions(spark, d):
    box = F.when(F.col("pos") % 3 == 0, "0 0 200,400").when(F.col("pos") % 3 == 1, " 10, 20, 300 150 ").otherwise("none")
    out = X.labels_2d(spark, d).select("pos", R.region(F.col("px"), F.col("py"), box, F.lit(640), F.lit(480)).alias("r"))
    return out.select("pos", "r.*")


REGIONS_SQL = with_views("labels_2d") + """, p as (select pos, case pos%3 when 0 then px*(640/200.0::double) when 1 then (px-10)*(640/300.0::double) else px end as x, case pos%3 when 0 then py*(480/400.0::double) when 1 then (py-20)*(480/150.0::double) else py end as y from labels_2d),
 b as (select pos, greatest(0, trunc(x-40)::int) as x1, greatest(0, trunc(y-20)::int) as y1, least(640, trunc(x+40)::int) as x2, least(480, trunc(y+20)::int) as y2 from p) select *, x2-x1 >= 10 and y2-y1 >= 10 as valid from b"""


def view_rays(spark, d):
    p = X.normals_small(spark, d)
    turn = [F.lit(v) for v in (0.0, 1.0, 0.0, 0.6, 0.0, 0.8, 0.8, 0.0, -0.6)]
    out = p.select("cloud", "pid", R.view_name(F.col("nx"), F.col("ny"), F.col("nz")).alias("view"), R.ray(F.col("x"), F.col("y"), turn, (F.lit(10.0), F.lit(20.0)), F.lit(2.0)).alias("r"))
    return rounded(out.select("cloud", "pid", "view", "r.*"))


RAYS_SQL = with_views("normals_small") + f""", t as (select cloud, pid, x, y, (x-10)/2 as a, (y-20)/2 as b, nx, ny, nz from normals_small)
select cloud, pid, case when abs(abs(nz)-1) <= 0.30001 and abs(nx) <= 0.3 and abs(ny) <= 0.3 then case when nz > 0 then 'front' else 'back' end when abs(abs(ny)-1) <= 0.30001 and abs(nx) <= 0.3 and abs(nz) <= 0.3 then case when ny > 0 then 'top' else 'bottom' end
 when abs(abs(nx)-1) <= 0.30001 and abs(ny) <= 0.3 and abs(nz) <= 0.3 then case when nx > 0 then 'right' else 'left' end else 'isometric' end as view,
 {r('b*0.6', 'ox')}, {r('a', 'oy')}, {r('b*0.8', 'oz')}, round(-0.8::double, 6) as dx, 0.0::double as dy, round(0.6::double, 6) as dz from t"""


def nominal_values(spark, d):
    k, v = F.col("pos") % 5, F.col("value")
    some = lambda i, c: F.when(k == i, c)
    side = lambda *c: F.array(*(x.cast("double") for x in c))
    out = R.nominal_of(some(0, v), some(1, v), some(2, side(v, v / 2)), some(3, side(F.lit(1), F.lit(2))), some(3, side(v, v + 5)))
    return rounded(X.measured_3d(spark, d).select("pos", out.alias("nominal")))


NOMINAL_SQL = with_views("measured_3d") + f" select pos, {r('case pos%5 when 0 then value when 1 then 2*value when 2 then value when 3 then value+3 else 1.0 end', 'nominal')} from measured_3d"


def normal_statistics(spark, d):
    return rounded(P.normal_statistics(X.normals_small(spark, d)))


NORMALS_CTE = "ms as (select cloud, avg(nx) mx, avg(ny) my, avg(nz) mz, (stddev_pop(nx)+stddev_pop(ny)+stddev_pop(nz))/3 as normal_std from normals_small group by 1), ns as (select *, sqrt(mx*mx+my*my+mz*mz) as len from ms)"
UNIT = ", ".join(r(f"case when len > 1e-10 then m{c}/(len+1e-10) else {float(c == 'z')} end", f"normal_{c}") for c in "xyz")
NORMAL_STATISTICS_SQL = with_views("normals_small") + f", {NORMALS_CTE} select cloud, {UNIT}, {r('normal_std', 'normal_std')} from ns"


def normal_deviation(spark, d):
    return rounded(P.normal_deviation(X.normals_small(spark, d), 12))


DEVIATION_SQL = with_views("normals_small") + f""", {knn(12, 'normals_small')}, w as (select n.cloud, n.pid1, b.nx, b.ny, b.nz from near n join normals_small b on b.cloud = n.cloud and b.pid = n.pid2),
 m as (select cloud, pid1, avg(nx) mx, avg(ny) my, avg(nz) mz from w group by 1, 2) select cloud, pid1 as pid, {r('avg(sqrt((nx-mx)*(nx-mx)+(ny-my)*(ny-my)+(nz-mz)*(nz-mz)))', 'curvature')} from w join m using (cloud, pid1) group by 1, 2"""


def point_normals(spark, d):
    """Normals of ten neighbours, turned by their centroid and by the point."""
    p = X.pts_small(spark, d)
    a = P.point_normals(p, 10)
    b = P.point_normals(p, 10, "point").select("cloud", "pid", *(F.col(f"n{c}").alias(f"p{c}") for c in "xyz"))
    return rounded(a.join(b, ["cloud", "pid"]), 4)


TURNED = lambda sign, name: ", ".join(r(f"case when {sign} < 0 then -v[{i}]/len else v[{i}]/len end", f"{name}{c}", 4) for i, c in ((1, "x"), (2, "y"), (3, "z")))
POINT_NORMALS_SQL = with_views("pts_small") + f""", {knn(10)}, cov as (select cloud, pid1 as pid, {cov_sql('', 'x2', 'y2', 'z2')}, avg(x2) mx, avg(y2) my, avg(z2) mz from near group by 1, 2), {eig('cov')},
 cr as (select *, [cxy*cyz - cxz*(cyy-e2), cxz*cxy - (cxx-e2)*cyz, (cxx-e2)*(cyy-e2) - cxy*cxy] as a, [cxy*(czz-e2) - cxz*cyz, cxz*cxz - (cxx-e2)*(czz-e2), (cxx-e2)*cyz - cxy*cxz] as b, [(cyy-e2)*(czz-e2) - cyz*cyz, cyz*cxz - cxy*(czz-e2), cxy*cyz - (cyy-e2)*cxz] as c from eig),
 s as (select *, list_dot_product(a, a) as sa, list_dot_product(b, b) as sb, list_dot_product(c, c) as sc from cr),
 v as (select s.cloud, s.pid, mx, my, mz, x, y, z, case when sa >= sb and sa >= sc then a when sb >= sc then b else c end as v, sqrt(greatest(sa, sb, sc)) as len from s join pts_small p on p.cloud = s.cloud and p.pid = s.pid)
select cloud, pid, {TURNED('v[1]*mx + v[2]*my + v[3]*mz', 'n')}, {TURNED('v[1]*x + v[2]*y + v[3]*z', 'p')} from v"""


def segment_measures(spark, d):
    """Clouds with the dimension of those that are slots or holes."""
    kind = F.element_at(F.array(*map(F.lit, ("hole", "slot", "plane"))), (F.col("cloud") % 3 + 1).cast("int"))
    p = X.pts_small(spark, d)
    dims = P.dimension_of(p, p.select("cloud", kind.alias("type")).distinct()).where("type <> 'plane'").select(F.col("cloud").alias("seg_id"), "type", "dimension")
    return rounded(P.with_dimensions(p.groupBy(F.col("cloud").alias("seg_id")).agg(F.count("*").alias("n")), dims), 4)


def curvature_percentiles(spark, d):
    return rounded(P.percentiles(S.curvature(X.pts_small(spark, d), 20, 1e-10), F.col("curvature"), [1, 5, 10, 25, 50, 75, 90, 95, 99]))


PERCENTILES_SQL = with_views("pts_small") + f", {curvature_cte(20, '1e-10')} select cloud, {', '.join(r(f'quantile_cont(curvature, {s / 100})', f'p{s:02d}') for s in (1, 5, 10, 25, 50, 75, 90, 95, 99))} from curv group by 1"


def angle_percentiles(spark, d):
    return rounded(P.percentiles(P.neighbour_angles(X.normals_small(spark, d)), F.col("angle"), [50, 75, 90, 95, 99]), 5)


ANGLES_SQL = with_views("normals_small") + f""", {knn(10, 'normals_small')}, w as (select n.cloud, degrees(acos(least(1.0, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) as angle from near n join normals_small a on a.cloud = n.cloud and a.pid = n.pid1 join normals_small b on b.cloud = n.cloud and b.pid = n.pid2 where n.pid1 <> n.pid2)
select cloud, {', '.join(r(f'quantile_cont(angle, {s / 100})', f'p{s:02d}', 5) for s in (50, 75, 90, 95, 99))} from w group by 1"""


def descriptor_means(spark, d):
    return rounded(P.means_of(rounded(S.descriptors(X.normals_small(spark, d)), 5)), 4)


DESCRIPTOR_MEANS_SQL = f"select cloud, {', '.join(r(f'avg({c})', c, 4) for c in ('density', 'planarity', 'linearity', 'normal_variation'))} from ({DESCRIPTORS_SQL}) group by 1"


def label_groups(spark, d):
    p = X.pts_small(spark, d).select("cloud", (F.col("pid") % 4).alias("label"), F.abs("x").alias("probability"))
    return rounded(P.label_groups(p, 10))


LABEL_GROUPS_SQL = with_views("pts_small") + f" select cloud, pid%4 as label, count(*) as n, {r('avg(abs(x))', 'confidence')} from pts_small group by 1, 2 having count(*) >= 10"


def distinct_labels(spark, d):
    """Labels of at least 0 per cloud, and the six largest labels of each."""
    out = P.distinct_labels(X.pts_small(spark, d).select("cloud", (F.col("pid") % 11 - 1).alias("label")))
    return out.withColumn("first", F.concat_ws(",", F.col("first").cast("array<string>")))


DISTINCT_SQL = with_views("pts_small") + """, p as (select cloud, pid%11 - 1 as label from pts_small where pid%11 > 0), k as (select distinct cloud, label from p qualify dense_rank() over (partition by cloud order by label desc) <= 6),
 f as (select cloud, string_agg(label::varchar, ',' order by label desc) as first from k group by 1) select cloud, count(distinct label) as labels, any_value(first) as first from p join f using (cloud) group by 1"""


def distinct_shapes(spark, d):
    return T.distinct_edges(X.edge_faces(spark, d))


SHAPES_SQL = with_views("edge_faces") + " select model_id, edge_id, count(distinct face_id) as faces from edge_faces group by 1, 2"


def incidence_counts(spark, d):
    return rounded(T.incidence_counts(X.edge_faces(spark, d)))


INCIDENCE_SQL = with_views("edge_faces") + f" select model_id, count(distinct face_id) as faces, count(distinct edge_id) as edges, {r('count(*)/count(distinct face_id)', 'edges_per_face')} from edge_faces group by 1"


def positive_measures(spark, d):
    return rounded(P.positive(X.measured_3d(spark, d).withColumn("measured", F.col("value") - 1200)).select("id", "measured"))


POSITIVE_SQL = with_views("measured_3d") + f" select id, {r('value-1200', 'measured')} from measured_3d where value-1200 > 0"

KIND = ("through_hole", "cone", "pocket", "sphere", "plane", "unknown")


def _kinds(spark, d):
    c = X.pts_small(spark, d).select("cloud").distinct()
    kind = F.element_at(F.array(*map(F.lit, KIND)), (F.col("cloud") % 6 + 1).cast("int"))
    return c.select("cloud", (F.col("cloud") % 2).alias("model_id"), F.col("cloud").alias("pos"), kind.alias("type"), F.when(F.col("cloud") % 12 == 3, 2.5).alias("radius"))


KINDS_CTE = "kinds as (select distinct label as cloud, label%2 as model_id, (['through_hole', 'cone', 'pocket', 'sphere', 'plane', 'unknown'])[(label%6 + 1)::int] as type, case when label%12 = 3 then 2.5::double end as radius from embeddings)"
MEASURED_COLUMNS = """case when type = 'through_hole' then f.diameter end as diameter, case when type in ('through_hole', 'pocket') then max_z-min_z end as depth, case when type = 'sphere' then k.radius end as radius,
 case when type = 'cone' then c.height end as height, case when type = 'cone' then c.base_radius end as base_radius, case when type = 'cone' then c.top_radius end as top_radius, case when type = 'pocket' then max_x-min_x end as length, case when type = 'pocket' then max_y-min_y end as width,
 case when type in ('plane', 'unknown') or type = 'sphere' and k.radius is null then greatest(max_x-min_x, max_y-min_y, max_z-min_z) end as max_dimension"""
SUMMARY_SQL = with_views("pts_small") + f", cov as (select cloud, {STATS} from pts_small group by 1) select cloud, n, {', '.join(f'm{c} as c_{c}, lo{c} as min_{c}, hi{c} as max_{c}' for c in 'xyz')} from cov"
CYLINDER_SQL = GEO + " select cloud, 2*avg(rl) as diameter, max(tl)-min(tl) as height from geo group by 1"
CONE_SQL = GEO + """, q as (select cloud, quantile_cont(tl, 0.1) as q1, quantile_cont(tl, 0.9) as q9, max(tl)-min(tl) as height from geo group by 1),
 ends as (select cloud, max(height) as height, case when count(*) filter (tl <= q1) >= 3 then avg(rl) filter (tl <= q1) else 0 end as lo, case when count(*) filter (tl >= q9) >= 3 then avg(rl) filter (tl >= q9) else 0 end as hi from geo join q using (cloud) group by 1)
select cloud, height, greatest(lo, hi) as base_radius, least(lo, hi) as top_radius from ends"""
MEASURED_FROM = f"kinds k join ({SUMMARY_SQL}) s using (cloud) join ({CYLINDER_SQL}) f using (cloud) join ({CONE_SQL}) c using (cloud)"


def measured_values(spark, d):
    return rounded(P.measured_values(X.pts_small(spark, d), _kinds(spark, d).select("cloud", "type", "radius")), 4)


VALUES = ("diameter", "depth", "radius", "height", "base_radius", "top_radius", "length", "width", "max_dimension")
MEASURED_SQL = f"with {KINDS_CTE}, m as (select k.cloud, type, {MEASURED_COLUMNS} from {MEASURED_FROM}) select cloud, type, {', '.join(r(c, c, 4) for c in VALUES)} from m"


def feature_dimensions(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("hole", "slot", "plane"))), (F.col("cloud") % 3 + 1).cast("int"))
    kinds = X.pts_small(spark, d).select("cloud", kind.alias("type")).distinct()
    return rounded(P.dimension_of(X.pts_small(spark, d), kinds), 4)


DIMENSIONS_SQL = f"""with m as (select cloud, (['hole', 'slot', 'plane'])[(cloud%3 + 1)::int] as type, case cloud%3 when 0 then f.diameter when 1 then f.height else greatest(max_x-min_x, max_y-min_y, max_z-min_z) end as dimension from ({SUMMARY_SQL}) s join ({CYLINDER_SQL}) f using (cloud))
select cloud, type, {r('dimension', 'dimension', 4)} from m"""


def feature_config(spark, d):
    return rounded(P.feature_config(X.normals_small(spark, d), _kinds(spark, d)), 4)


BOX = [f"{a}_{c}" for a in ("c", "min", "max") for c in "xyz"]
CONFIG_SQL = f"""with {KINDS_CTE}, ids as (select cloud, printf('seg_%03d', row_number() over (partition by model_id order by cloud) - 1) as id from kinds),
 curvs as ({with_views('pts_small')}, {curvature_cte(15)} select cloud, avg(curvature) as curvature_mean, stddev_pop(curvature) as curvature_std, max(curvature) as curvature_max from curv group by 1),
 m as (select k.cloud, k.model_id, k.type, s.n, {', '.join('s.' + b for b in BOX)}, {MEASURED_COLUMNS} from {MEASURED_FROM} where s.n >= 10)
select m.model_id, cloud, id, type, n, {', '.join(r(b, b, 4) for b in BOX)}, {', '.join(r(f'normal_{c}', f'normal_{c}', 4) for c in 'xyz')}, {r('normal_std', 'normal_std', 4)}, {', '.join(r(f'curvature_{c}', f'curvature_{c}', 4) for c in ('mean', 'std', 'max'))},
 {', '.join(r(c, c, 4) for c in VALUES)}, case when type = 'unknown' then 0.5 else 0.9 end::double as confidence from m join ids using (cloud) join ({with_views("normals_small")}, {NORMALS_CTE} select cloud, {', '.join(f'case when len > 1e-10 then m{c}/(len+1e-10) else {float(c == "z")} end as normal_{c}' for c in 'xyz')}, normal_std from ns) n2 using (cloud) join curvs using (cloud)"""

DIMENSION_KINDS = ("diameter", "radius", "height", "length", "width", "distance", "angle")


def feature_correspondences(spark, d):
    f = X.measured_3d(spark, d)
    kind = F.when(F.col("type").endswith("_hole"), "hole").otherwise(F.col("type"))
    nominal = R.nominal_of(F.when(F.col("key") == "diameter", F.col("value")), F.when(F.col("key") == "radius", F.col("value")), F.when(F.col("key") == "length", F.array("value")), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))
    f = f.select("model_id", "id", kind.alias("type"), nominal.alias("nominal"), (F.col("value") + 1).alias("measured"))
    of = F.element_at(F.array(*map(F.lit, DIMENSION_KINDS)), (F.col("pos") % 7 + 1).cast("int"))
    dims = X.labels_2d(spark, d).select("model_id", F.col("id").alias("dim_id"), "pos", of.alias("dimension_type"), F.col("nominal").alias("value"), "tol")
    return rounded(P.correspondences(f, dims))


SEGMENT_MEASURES_SQL = f"""select seg_id, n, type, dimension from (select label as seg_id, count(*) as n from embeddings group by 1) left join (select cloud as seg_id, type, dimension from ({DIMENSIONS_SQL}) where type <> 'plane') using (seg_id)"""
FEATURE_CORRESPONDENCES_SQL = with_views("labels_2d", "measured_3d") + f""", f as (select model_id, id, case when type like '%hole' then 'hole' else type end as type, case when key = 'radius' then 2*value else value end as nominal, value+1 as measured from measured_3d),
 l as (select model_id, id as dim_id, pos, (['diameter', 'radius', 'height', 'length', 'width', 'distance', 'angle'])[(pos%7 + 1)::int] as kind, nominal as value, tol from labels_2d),
 m as (select f.model_id, f.id, dim_id, l.value, l.tol from f join l on l.model_id = f.model_id and (type = 'hole' and kind in ('diameter', 'radius') or type = 'cylinder' and kind in ('diameter', 'height') or type = 'plane' and kind in ('length', 'width', 'distance')) qualify row_number() over (partition by f.model_id, f.id order by pos) = 1),
 o as (select f.model_id, f.id, coalesce(dim_id, 'synthetic_' || f.id) as dim_id, coalesce(value, nominal) as nominal, tol, measured from f left join m on m.model_id = f.model_id and m.id = f.id)
select model_id, id, dim_id, {r('nominal', 'nominal')}, {r('coalesce(tol, nominal*0.02)', 'tol')}, {r('abs(measured-nominal)', 'deviation')} from o"""


def training_dataset(spark, d):
    """Label and vector of every scored pair whose status is known."""
    z = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("pos"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("z"))
    a = _labels(spark, d).join(z, "pos").withColumnRenamed("z", "a").withColumns({"nominal": F.col("value"), "own_tol": F.col("tol"), "own_text": F.col("text")})
    b = _measured(spark, d).withColumn("measure", F.col("value")).join(z, "pos").withColumnRenamed("z", "b")
    m = M.scores(a, b, left=("a", "nominal", "own_tol", "own_text"), right=("b", "measure"))
    status = F.when((F.col("i") + F.col("j")) % 5 == 0, "UNKNOWN").otherwise(F.col("status"))
    edges = P.labelled(m.withColumn("status", status), "a", "b", "nominal", "own_tol", "own_text", "measure")
    v = V.pair_vector(F.col("a"), F.col("b"), F.col("nominal"), F.col("own_tol"), F.col("measure"), F.col("own_text"))
    return rounded(edges.select("src", "dst", "label", v.alias("v")).select("src", "dst", "label", F.col("v")[0].alias("a0"), F.col("v")[2].alias("b0"), F.col("v")[4].alias("d0"), F.col("v")[7].alias("dev")), 5)


DATASET_SQL = with_views("labels_2d", "measured_3d") + f""", {SCORES_CTE}, z as (select vec_id as pos, embedding[1]::double as z from embeddings), e as (select * from sc where (i+j)%5 <> 0)
select src, dst, case when err <= e.tol then 1.0 else 0.0 end::double as label, {r('a.z', 'a0', 5)}, {r('b.z', 'b0', 5)}, {r('abs(a.z-b.z)', 'd0', 5)}, {r('ln(1+abs(m.nominal-f.value))', 'dev', 5)} from e join z a on a.pos = e.i join z b on b.pos = e.j join labels_2d m on m.pos = e.i join measured_3d f on f.pos = e.j"""


def label_clusters(spark, d):
    p = X.pts_small(spark, d).withColumn("label", F.col("pid") % 2)
    return C.label_clusters(p, cutter(spark), 0.15, 9)


CLUSTERS_BODY = DBSCAN_SQL[len(with_views("pts_small").replace("with ", "with recursive ", 1)) :]
LABEL_CLUSTERS_SQL = with_views("pts_small").replace("with ", "with recursive ", 1) + """, own as (select cloud*2 + pid%2 as cloud, pid, x, y, z from pts_small),
 dia as (select cloud, sqrt(pow(max(x)-min(x), 2) + pow(max(y)-min(y), 2) + pow(max(z)-min(z), 2)) as d from own group by 1 having count(*) >= 9), scaled as (select cloud, pid, x/d as x, y/d as y, z/d as z from own join dia using (cloud))""" + CLUSTERS_BODY.replace("pts_small", "scaled").replace("0.12*0.12", "0.15*0.15").replace("count(*) >= 4", "count(*) >= 3").replace("select s.cloud, s.pid, coalesce(num.k, border.k, -1)::int as label from", ", lab as (select s.cloud, coalesce(num.k, border.k, -1)::int as k from") + """)
select cloud//2 as cloud, cloud%2 as label, k as cluster, count(*) as n, 0.7::double as confidence from lab where k >= 0 group by 1, 2, 3 having count(*) >= 9"""


def segment_features(spark, d):
    p = X.normals_small(spark, d)
    angle = rounded(S.descriptors(p), 5).select("cloud", "pid", F.col("angle").alias("curvature"))
    return rounded(C.segment_features(p.join(angle, ["cloud", "pid"]), cutter(spark), 0.12, 4), 4)


SEGMENT_FEATURES_SQL = with_views("pts_small", "normals_small").replace("with ", "with recursive ", 1) + CLUSTERS_BODY.replace("select s.cloud, s.pid, coalesce(num.k, border.k, -1)::int as label from", ", lab as (select s.cloud, s.pid, coalesce(num.k, border.k, -1)::int as label from") + f"""),
 bend as (select cloud, pid, angle from ({DESCRIPTORS_SQL})), st as (select l.cloud, l.label, count(*) as n, avg(angle) as mc, max(angle) as xc, [var_pop(nx), var_pop(ny), var_pop(nz)] as v, [max(x)-min(x), max(y)-min(y), max(z)-min(z)] as s
  from lab l join normals_small using (cloud, pid) join bend using (cloud, pid) group by 1, 2 having count(*) >= 5),
 a as (select *, list_max(s)/(coalesce(list_min(list_filter(s, lambda x: x > 0)), 0) + 1e-10) as aspect, list_max(v) as vm from st),
 k as (select *, case when mc > 0.5 and aspect > 2 then 'taper_hole' when mc > 0.5 then 'hole' when vm < 0.1 and aspect > 3 then 'slot' when vm < 0.1 then 'pocket' when vm > 0.5 and mc > 0.3 then 'fillet' when vm > 0.5 then 'chamfer'
  when n > 100 and aspect > 1.5 then 'step' when mc < 0.1 and vm < 0.05 then 'plane' when mc > 0.2 and mc < 0.5 then 'cylinder' else 'unknown' end as type from a)
select cloud, label, n, {r('mc', 'mean_curvature', 4)}, {r('xc', 'max_curvature', 4)}, {r('aspect', 'aspect', 4)}, type, case type when 'taper_hole' then 0.7 when 'hole' then 0.8 when 'slot' then 0.75 when 'pocket' then 0.7 when 'fillet' then 0.6 when 'chamfer' then 0.65 when 'step' then 0.6 when 'plane' then 0.9 when 'cylinder' then 0.75 else 0.5 end::double as confidence from k"""

QUERIES = [
    ("cleaned_records", cleaned_records, CLEANED_SQL), ("label_numbers", label_numbers, LABEL_NUMBERS_SQL), ("neighbour_records", neighbour_records, NEIGHBOURS_SQL), ("text_regions", text_regions, REGIONS_SQL),
    ("view_rays", view_rays, RAYS_SQL), ("nominal_values", nominal_values, NOMINAL_SQL), ("normal_statistics", normal_statistics, NORMAL_STATISTICS_SQL), ("normal_deviation", normal_deviation, DEVIATION_SQL),
    ("curvature_percentiles", curvature_percentiles, PERCENTILES_SQL), ("angle_percentiles", angle_percentiles, ANGLES_SQL), ("descriptor_means", descriptor_means, DESCRIPTOR_MEANS_SQL), ("label_groups", label_groups, LABEL_GROUPS_SQL),
    ("distinct_labels", distinct_labels, DISTINCT_SQL), ("distinct_shapes", distinct_shapes, SHAPES_SQL), ("incidence_counts", incidence_counts, INCIDENCE_SQL), ("positive_measures", positive_measures, POSITIVE_SQL),
    ("measured_values", measured_values, MEASURED_SQL), ("feature_dimensions", feature_dimensions, DIMENSIONS_SQL), ("feature_config", feature_config, CONFIG_SQL), ("feature_correspondences", feature_correspondences, FEATURE_CORRESPONDENCES_SQL),
    ("label_clusters", label_clusters, LABEL_CLUSTERS_SQL), ("segment_features", segment_features, SEGMENT_FEATURES_SQL),
    ("training_dataset", training_dataset, DATASET_SQL), ("point_normals", point_normals, POINT_NORMALS_SQL), ("segment_measures", segment_measures, SEGMENT_MEASURES_SQL),
]
