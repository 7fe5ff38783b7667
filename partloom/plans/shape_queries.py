"""Points and segments: neighbours, statistics, fits, classes."""

from pyspark.sql import functions as F

from partloom.functions.linear import EIGEN_SQL, covariance
from partloom.operators import sampling as K
from partloom.operators import segments as G
from partloom.operators import spatial as S
from partloom.plans.runtime import cutter
from partloom.sources import fixtures as X
from partloom.sources.fixtures import with_views


def rounded(df, places=6, keep=()):
    """Doubles rounded, minus zero erased."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, places) + 0.0).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns))


def r(expr, name, places=6):
    return f"round({expr}, {places}) + 0.0 as {name}"


def cov_sql(rel, x="x", y="y", z="z", by="cloud"):
    a = {"x": x, "y": y, "z": z}
    return ", ".join(f"covar_samp({a[n[0]]}, {a[n[1]]}) as c{n}" for n in ("xx", "yy", "zz", "xy", "xz", "yz"))


STATS = "count(*) as n, " + ", ".join(f"avg({c}) as m{c}, min({c}) as lo{c}, max({c}) as hi{c}" for c in "xyz") + ", " + cov_sql("p")


def eig(cov):
    return EIGEN_SQL.format(cov=cov)


def segment_summary(spark, d):
    out = G.summary(X.pts_small(spark, d)).drop(*(f"c{n}" for n in ("xx", "yy", "zz", "xy", "xz", "yz")))
    return rounded(out)


SUMMARY_SQL = with_views("pts_small") + f""", cov as (select cloud, {STATS} from pts_small group by 1), {eig('cov')}
select cloud, n, {', '.join(r('m' + c, 'c_' + c) for c in 'xyz')}, {', '.join(r('lo' + c, 'min_' + c) for c in 'xyz')}, {', '.join(r('hi' + c, 'max_' + c) for c in 'xyz')}, {r('e0', 'e0')}, {r('e1', 'e1')}, {r('e2', 'e2')},
 {r('(e0-e1)/(e0+1e-9)', 'linearity')}, {r('(e1-e2)/(e0+1e-9)', 'planarity')}, {r('e2/(e0+1e-9)', 'scattering')} from eig"""


def big_summary(spark, d):
    return rounded(X.pts_big(spark, d).groupBy("cloud").agg(F.count("*").alias("n"), *covariance(), F.stddev_pop("y").alias("std_y")), 4)


BIG_SUMMARY_SQL = with_views("pts_big") + " select cloud, count(*) as n, " + ", ".join(r(f"covar_samp({n[0]}, {n[1]})", f"c{n}", 4) for n in ("xx", "yy", "zz", "xy", "xz", "yz")) + f", {r('stddev_pop(y)', 'std_y', 4)} from pts_big group by 1"


def distribution(spark, d):
    return rounded(G.distribution(X.pts_big(spark, d).withColumn("root", F.sqrt("y")), "root"), 8)


def dist_sql(rel, v, places=6):
    q = ", ".join(r(f"quantile_cont({v}, {p})", n, places) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"select cloud, {r(f'min({v})', 'min')}, {r(f'max({v})', 'max')}, {r(f'avg({v})', 'mean')}, {r(f'stddev_pop({v})', 'std')}, {q} from {rel} group by 1"


DISTRIBUTION_SQL = with_views("pts_big") + " " + dist_sql("pts_big", "sqrt(y)", 8)


def knn(k, view="pts_small"):
    return f"""near as (select a.cloud, a.pid as pid1, b.pid as pid2, b.x as x2, b.y as y2, b.z as z2, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2
  from {view} a join {view} b using (cloud) qualify row_number() over (partition by a.cloud, a.pid order by (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid) <= {k})"""


def nearest_points(spark, d):
    return rounded(S.knn_join(X.pts_small(spark, d), 10).select("cloud", "pid1", "pid2", "rank", "d2"), 8)


NEAREST_SQL = with_views("pts_small") + f", {knn(10)} select cloud, pid1, pid2, row_number() over (partition by cloud, pid1 order by d2, pid2) as rank, {r('d2', 'd2', 8)} from near"


def nearest_points_grid(spark, d):
    return rounded(S.knn_join(X.pts_small(spark, d), 5, reach=0.1).select("cloud", "pid1", "pid2", "rank", "d2"), 8)


NEAREST_GRID_SQL = with_views("pts_small") + f", {knn(5)} select cloud, pid1, pid2, row_number() over (partition by cloud, pid1 order by d2, pid2) as rank, {r('d2', 'd2', 8)} from near"


def radius_pairs(spark, d):
    p = X.pts_big(spark, d).withColumn("pid", F.xxhash64("x", "y", "z"))
    return S.radius_join(p, 1.0, side=8).groupBy("cloud").agg(F.count("*").alias("pairs"))


RADIUS_SQL = with_views("pts_big") + " select a.cloud, count(*) as pairs from pts_big a join pts_big b on a.cloud = b.cloud and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 1.0 group by 1"


def point_curvature(spark, d):
    return rounded(S.curvature(X.pts_small(spark, d)))


def curvature_cte(k, eps="1e-12", view="pts_small"):
    return f"{knn(k, view)}, cov as (select cloud, pid1 as pid, count(*) as n, {cov_sql('', 'x2', 'y2', 'z2')} from near group by 1, 2), {eig('cov')}, curv as (select cloud, pid, case when n >= 3 then e2/(e0+e1+e2+{eps}) else 0.0 end as curvature from eig)"


CURVATURE_SQL = with_views("pts_small") + f", {curvature_cte(15)} select cloud, pid, {r('curvature', 'curvature')} from curv"


def curvature_statistics(spark, d):
    c = S.curvature(X.pts_small(spark, d), 20, 1e-10)
    out = c.groupBy("cloud").agg(F.avg("curvature").alias("mean"), F.stddev_pop("curvature").alias("std"), F.max("curvature").alias("max"), (F.percentile("curvature", F.lit(0.75)) * 0.35).alias("threshold"))
    return rounded(out)


CURVATURE_STATS_SQL = with_views("pts_small") + f", {curvature_cte(20, '1e-10')} select cloud, {r('avg(curvature)', 'mean')}, {r('stddev_pop(curvature)', 'std')}, {r('max(curvature)', 'max')}, {r('quantile_cont(curvature, 0.75)*0.35', 'threshold')} from curv group by 1"


def curvature_bands(spark, d):
    return rounded(G.curvature_bands(S.curvature(X.pts_small(spark, d), 20, 1e-10).withColumn("curvature", F.round("curvature", 9))))


BANDS_SQL = with_views("pts_small") + f""", {curvature_cte(20, '1e-10')}, curv9 as (select cloud, pid, round(curvature, 9) as curvature from curv), q as (select cloud, quantile_cont(curvature, 0.5) as q5, quantile_cont(curvature, 0.8) as q8 from curv9 group by 1)
select cloud, case when curvature >= q8 then 'high' when curvature >= q5 then 'medium' else 'low' end as band, count(*) as n, {r('avg(curvature)', 'mean')} from curv9 join q using (cloud) group by 1, 2 having count(*) >= 10"""


def two_scale_curvature(spark, d):
    return rounded(S.two_scale_curvature(X.pts_small(spark, d), 0.15))


def _within(name, radius):
    return f"""n_{name} as (select a.cloud, a.pid, b.x as x2, b.y as y2, b.z as z2 from pts_small a join pts_small b on a.cloud = b.cloud and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {radius}*{radius}),
 cov_{name} as (select cloud, pid, count(*) as n, {', '.join(f"coalesce(covar_samp({c[0]}2, {c[1]}2), 0) as c{c}" for c in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))} from n_{name} group by 1, 2),
 {eig('cov_' + name).replace('eig0', 'g0_' + name).replace('eig1', 'g1_' + name).replace('eig2', 'g2_' + name).replace('eig as', name + ' as')}"""


TWO_SCALE_SQL = with_views("pts_small") + f""", {_within('small', 0.15)}, {_within('large', 0.3)}
select cloud, pid, {r('case when s.n >= 5 then 0.7*s.e2/(s.e0+s.e1+s.e2+1e-12) + 0.3*l.e2/(l.e0+l.e1+l.e2+1e-12) else 0.0 end', 'curvature')} from small s join large l using (cloud, pid)"""


def point_descriptors(spark, d):
    return rounded(S.descriptors(X.normals_small(spark, d)), 5)


DESCRIPTORS_SQL = with_views("normals_small") + f""", {knn(10, 'normals_small')}, w as (select n.*, a.nx, a.ny, a.nz, b.nx as mx, b.ny as my, b.nz as mz from near n join normals_small a on a.cloud = n.cloud and a.pid = pid1 join normals_small b on b.cloud = n.cloud and b.pid = pid2),
 cov as (select cloud, pid1 as pid, count(*) as n, sqrt(max(d2)) as far, avg(acos(greatest(-1.0, least(1.0, nx*mx + ny*my + nz*mz)))) as angle, var_pop(mx) + var_pop(my) + var_pop(mz) as normal_variation, {cov_sql('', 'x2', 'y2', 'z2')} from w group by 1, 2), {eig('cov')}
select cloud, pid, {r('angle', 'angle', 5)}, {r('normal_variation', 'normal_variation', 5)}, {r('case when far > 0 then n/(4.0/3*pi()*far*far*far) else 0.0 end', 'density', 5)}, {r('(e0-e1)/(e0+e1+e2+1e-10)', 'planarity', 5)}, {r('(e1-e2)/(e0+e1+e2+1e-10)', 'linearity', 5)}, {r('e2/(e0+e1+e2+1e-10)', 'sphericity', 5)} from eig"""


def point_spacing(spark, d):
    return rounded(S.spacing(X.pts_small(spark, d), 11))


SPACING_SQL = with_views("pts_small") + f", {knn(11)}, f as (select cloud, pid1, sqrt(max(d2)) as far from near group by 1, 2) select cloud, {r('avg(far)', 'spacing')} from f group by 1"


def outliers_removed(spark, d):
    return S.outliers_removed(X.pts_small(spark, d)).select("cloud", "pid")


OUTLIERS_SQL = with_views("pts_small") + f", {knn(20)}, m as (select cloud, pid1 as pid, avg(sqrt(d2)) as m from near group by 1, 2) select cloud, pid from m qualify m <= avg(m) over (partition by cloud) + 2*stddev_samp(m) over (partition by cloud) or count(*) over (partition by cloud) <= 20"


def neighbour_edges(spark, d):
    return rounded(S.neighbour_edges(X.pts_small(spark, d)), 8)


EDGES_SQL = with_views("pts_small") + f", {knn(10)} select distinct cloud, least(pid1, pid2) as a, greatest(pid1, pid2) as b, {r('sqrt(d2)', 'distance', 8)} from near where pid1 <> pid2 and sqrt(d2) < 0.1"


def interpolated(spark, d):
    p = X.pts_small(spark, d)
    return rounded(S.interpolate(p.where("pid % 2 = 0"), p.where("pid % 2 = 1").withColumn("v", F.col("pid").cast("double")), "v"), 5)


INTERPOLATED_SQL = with_views("pts_small") + f""", n as (select a.cloud, a.pid, b.pid as bpid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2 from pts_small a join pts_small b on a.cloud = b.cloud and a.pid%2 = 0 and b.pid%2 = 1
  qualify row_number() over (partition by a.cloud, a.pid order by (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid) <= 3)
select cloud, pid, {r('sum(bpid/greatest(d2, 1e-10))/sum(1/greatest(d2, 1e-10))', 'v', 5)} from n group by 1, 2"""

CENTRED = f"""cov as (select cloud, {STATS} from pts_small group by 1), {eig('cov')}"""
# axes by the cross products of rows of A - e
AXES = """
 rows_ as (select *, unnest([e0, e2]) as ev, unnest(['long', 'short']) as which from eig),
 cr as (select *, [cxy*cyz - cxz*(cyy-ev), cxz*cxy - (cxx-ev)*cyz, (cxx-ev)*(cyy-ev) - cxy*cxy] as v01, [cxy*(czz-ev) - cxz*cyz, cxz*cxz - (cxx-ev)*(czz-ev), (cxx-ev)*cyz - cxy*cxz] as v02,
   [(cyy-ev)*(czz-ev) - cyz*cyz, cyz*cxz - cxy*(czz-ev), cxy*cyz - (cyy-ev)*cxz] as v12 from rows_),
 sz as (select *, list_dot_product(v01, v01) as s01, list_dot_product(v02, v02) as s02, list_dot_product(v12, v12) as s12 from cr),
 axis as (select cloud, which, case when s01 >= s02 and s01 >= s12 then v01 when s02 >= s12 then v02 else v12 end as v, sqrt(greatest(s01, s02, s12)) as len from sz),
 long_axis as (select cloud, v[1]/len as ax, v[2]/len as ay, v[3]/len as az from axis where which = 'long'), short_axis as (select cloud, v[1]/len as bx, v[2]/len as by_, v[3]/len as bz from axis where which = 'short'),
 cen as (select p.*, n, p.x-mx as dx, p.y-my as dy, p.z-mz as dz, ax, ay, az, bx, by_, bz, hix-lox as sx, hiy-loy as sy, hiz-loz as sz from pts_small p join eig using (cloud) join long_axis using (cloud) join short_axis using (cloud)),
 geo as (select *, sqrt(greatest(0, dx*dx+dy*dy+dz*dz - (dx*ax+dy*ay+dz*az)*(dx*ax+dy*ay+dz*az))) as rl, sqrt(greatest(0, dx*dx+dy*dy+dz*dz - (dx*bx+dy*by_+dz*bz)*(dx*bx+dy*by_+dz*bz))) as rs,
   abs(dx*ax+dy*ay+dz*az) as tl_abs, dx*ax+dy*ay+dz*az as tl, abs(dx*bx+dy*by_+dz*bz) as off, sqrt(dx*dx+dy*dy+dz*dz) as ring, 0.01*sqrt(sx*sx+sy*sy+sz*sz) as lim from cen)"""
GEO = with_views("pts_small") + f", {CENTRED}, {AXES}"


def cylinder_fit(spark, d):
    return rounded(G.cylinder_fit(X.pts_small(spark, d)))


CYLINDER_SQL = GEO + f" select cloud, {r('2*avg(rl)', 'diameter')}, {r('avg(rl)', 'radius')}, {r('stddev_pop(rl)', 'diameter_std')}, {r('max(tl)-min(tl)', 'height')} from geo group by 1"


def cylinder_fit_short(spark, d):
    return rounded(G.cylinder_fit(X.pts_small(spark, d), axis="short_axis").select("cloud", "radius"))


CYLINDER_SHORT_SQL = GEO + f" select cloud, {r('avg(rs)', 'radius')} from geo group by 1"


def sphere_dimensions(spark, d):
    return rounded(G.sphere_dimensions(X.pts_small(spark, d)))


SPHERE_SQL = GEO + f" select cloud, {r('2*avg(ring)', 'diameter')}, {r('stddev_pop(ring)', 'diameter_std')}, {r('avg(ring)', 'radius')}, {r('1-stddev_pop(ring)/(avg(ring)+1e-10)', 'sphericity')} from geo group by 1"


def plane_and_box(spark, d):
    p = X.pts_small(spark, d)
    return rounded(G.plane_dimensions(p).join(G.box_dimensions(p), "cloud"))


PLANE_SQL = with_views("pts_small") + f", {CENTRED} select cloud, {r('2*sqrt(e0)', 'primary_dimension')}, {r('2*sqrt(greatest(e1, 0))', 'secondary_dimension')}, {r('1-e2/(e0+e1+e2+1e-10)', 'planarity')}, {r('hix-lox', 'length')}, {r('hiy-loy', 'width')}, {r('hiz-loz', 'height')} from eig"


def cone_parameters(spark, d):
    return rounded(G.cone_parameters(X.pts_small(spark, d)).select("cloud", "height", (F.col("base_radius") + F.col("top_radius")).alias("radii")), 5)


CONE_SQL = GEO + f""", q as (select cloud, quantile_cont(tl, 0.1) as q1, quantile_cont(tl, 0.9) as q9, max(tl)-min(tl) as height from geo group by 1)
select cloud, {r('max(height)', 'height', 5)}, {r('case when count(*) filter (tl <= q1) >= 3 then avg(rl) filter (tl <= q1) else 0 end + case when count(*) filter (tl >= q9) >= 3 then avg(rl) filter (tl >= q9) else 0 end', 'radii', 5)} from geo join q using (cloud) group by 1"""


def primitive_ratios(spark, d):
    return rounded(G.primitive_ratios(X.pts_small(spark, d)))


RATIOS = f""", mm as (select cloud, avg(rs) as radius, avg(ring) as major, stddev_pop(ring)/(avg(ring)+1e-10) as uneven from geo group by 1),
 rat as (select cloud, avg(case when off < lim then 1.0 else 0.0 end) as plane, avg(case when abs(rs-radius) < lim then 1.0 else 0.0 end) as cylinder, avg(case when abs(rs-radius) < 1.5*lim then 1.0 else 0.0 end) as cone,
  avg(case when abs(ring-major) < 2*lim and uneven < 0.3 and n >= 10 then 1.0 else 0.0 end) as torus, coalesce(avg(off) filter (off < lim), 999) as plane_residual, coalesce(avg(abs(rs-radius)) filter (abs(rs-radius) < lim), 999) as cylinder_residual from geo join mm using (cloud) group by 1)"""
BEST = "case when greatest(plane, cylinder, cone, torus) <= 0 then 'unknown' when plane = greatest(plane, cylinder, cone, torus) then 'plane' when cylinder = greatest(plane, cylinder, cone, torus) then 'cylinder' when cone = greatest(plane, cylinder, cone, torus) then 'cone' else 'torus' end"
PRIMITIVES_SQL = GEO + RATIOS + f" select cloud, {', '.join(r(c, c) for c in ('plane', 'cylinder', 'cone', 'torus', 'plane_residual', 'cylinder_residual'))}, {BEST} as best from rat"


BALL = """, b_m as (select cloud, avg(x) mx, avg(y) my, avg(z) mz, 0.01*sqrt(pow(max(x)-min(x), 2) + pow(max(y)-min(y), 2) + pow(max(z)-min(z), 2)) as lim from pts_small group by 1 having count(*) >= 4),
 b_t as (select p.*, m.*exclude(cloud), x-mx as u, y-my as v, z-mz as w, (x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz) as q from pts_small p join b_m m using (cloud)),
 b_s as (select cloud, any_value(mx) mx, any_value(my) my, any_value(mz) mz, sum(u*u) a, sum(u*v) b, sum(u*w) c, sum(v*v) d, sum(v*w) e, sum(w*w) f, sum(u*q)/2 g, sum(v*q)/2 h, sum(w*q)/2 k, avg(q) as mq from b_t group by 1),
 b_d as (select *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) as det from b_s),
 b_o as (select *, (g*(d*f-e*e) - b*(h*f-e*k) + c*(h*e-d*k))/det as x0, (a*(h*f-e*k) - g*(b*f-c*e) + c*(b*k-c*h))/det as y0, (a*(d*k-e*h) - b*(b*k-c*h) + g*(b*e-c*d))/det as z0 from b_d),
 b_r as (select cloud, mx+x0 as ox, my+y0 as oy, mz+z0 as oz, sqrt(greatest(0, mq + x0*x0 + y0*y0 + z0*z0)) as radius from b_o),
 ball as (select cloud, any_value(ox) as ox, any_value(oy) as oy, any_value(oz) as oz, any_value(radius) as radius, avg(case when abs(sqrt((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz)) - radius) < lim then 1.0 else 0.0 end) as sphere from b_t join b_r using (cloud) group by 1)"""
FIVE = "plane, cylinder, sphere, cone, torus"
BEST_OF_FIVE = f"case when greatest({FIVE}) <= 0 then 'unknown' " + " ".join(f"when {c} = greatest({FIVE}) then '{c}'" for c in FIVE.split(", ")) + " end"


def feature_classes(spark, d):
    p = X.pts_small(spark, d)
    props = G.shape_properties(p, S.curvature(p, 20, 1e-10)).join(G.all_primitives(p).select("cloud", "best"), "cloud")
    label, conf = G.manufacturing_feature(F.col("best"))
    return rounded(props.withColumn("feature", label).withColumn("confidence", conf))


CLASSES_SQL = GEO + RATIOS + BALL + f""", five as (select rat.*, coalesce(sphere, 0) as sphere from rat left join ball using (cloud)), {curvature_cte(20, '1e-10').replace('cov as', 'cov2 as').replace('from cov)', 'from cov2)').replace('eig0', 'h0').replace('eig1', 'h1').replace('eig2', 'h2').replace('eig as', 'heig as').replace('from eig)', 'from heig)')},
 mc as (select cloud, avg(curvature) as curvature from curv group by 1), ring_ as (select cloud, 1 - least(stddev_pop(ring)/(avg(ring)+1e-10), 1) as circularity, any_value(list_reverse_sort([sx, sy, sz])) as s from geo group by 1),
 pr as (select cloud, curvature, s[2]/(s[1]+1e-10) as aspect_ratio, (e1-e2)/(e0+1e-10) as planarity, circularity, s[3]/(s[2]+1e-10) as thickness, s[1]/(s[2]+1e-10) as length, {BEST_OF_FIVE} as best from eig join mc using (cloud) join ring_ using (cloud) join five using (cloud))
select cloud, {', '.join(r(c, c) for c in ('curvature', 'aspect_ratio', 'planarity', 'circularity', 'thickness', 'length'))}, best, f.feature as feature, f.confidence as confidence from (select *, case
 when best='cylinder' and thickness > 0.7 and length < 2 then {{'feature': 'hole', 'confidence': 0.85::double}} when best='cylinder' and length > 2 then {{'feature': 'cylinder', 'confidence': 0.85::double}}
 when best='cylinder' and circularity > 0.8 and aspect_ratio < 0.5 then {{'feature': 'hole', 'confidence': 0.8::double}} when best='cylinder' then {{'feature': 'cylinder', 'confidence': 0.7::double}}
 when best='plane' and planarity > 0.8 then {{'feature': 'plane', 'confidence': 0.9::double}} when best='sphere' and circularity > 0.6 and thickness > 0.6 and length < 1.5 then {{'feature': 'hole', 'confidence': 0.75::double}} when best='sphere' and circularity > 0.6 then {{'feature': 'sphere', 'confidence': 0.8::double}} when best='sphere' then {{'feature': 'unknown', 'confidence': 0.4::double}}
 when best='cone' then {{'feature': 'cone', 'confidence': 0.7::double}} when best='torus' then {{'feature': 'torus', 'confidence': 0.7::double}}
 when curvature > 0.3 and thickness < 0.5 and circularity > 0.6 then {{'feature': 'hole', 'confidence': 0.75::double}} when curvature > 0.3 and thickness < 0.5 then {{'feature': 'pocket', 'confidence': 0.7::double}}
 when curvature > 0.2 and aspect_ratio > 0.3 and aspect_ratio < 0.7 then {{'feature': 'slot', 'confidence': 0.7::double}} when curvature > 0.15 and length > 2 then {{'feature': 'fillet', 'confidence': 0.65::double}}
 when planarity > 0.6 and length > 1.5 then {{'feature': 'step', 'confidence': 0.6::double}} when curvature < 0.05 and planarity > 0.5 then {{'feature': 'plane', 'confidence': 0.7::double}} else {{'feature': 'unknown', 'confidence': 0.3::double}} end as f from pr)"""


def point_segment_classes(spark, d):
    p = X.normals_small(spark, d)
    s = G.summary(p.select("cloud", "pid", "x", "y", "z")).join(S.curvature(p.select("cloud", "pid", "x", "y", "z")).groupBy("cloud").agg(F.avg("curvature").alias("mc")), "cloud")
    m = p.groupBy("cloud").agg(*(F.avg(f"n{c}").alias(f"a{c}") for c in "xyz"))
    cons = p.join(m, "cloud").groupBy("cloud").agg(F.avg(F.abs(F.col("nx") * F.col("ax") + F.col("ny") * F.col("ay") + F.col("nz") * F.col("az"))).alias("consistency"))
    label = G.point_segment_class(F.col("n"), F.col("linearity"), F.col("planarity"), F.col("scattering"), F.col("mc"), F.col("consistency"))
    return rounded(s.join(cons, "cloud").select("cloud", "consistency", label.alias("label")))


POINT_CLASSES_SQL = with_views("pts_small", "normals_small") + f""", {CENTRED}, {curvature_cte(15).replace('cov as', 'cov2 as').replace('from cov)', 'from cov2)').replace('eig0', 'h0').replace('eig1', 'h1').replace('eig2', 'h2').replace('eig as', 'heig as').replace('from eig)', 'from heig)')},
 mc as (select cloud, avg(curvature) as mc from curv group by 1), m as (select cloud, avg(nx) as ax, avg(ny) as ay, avg(nz) as az from normals_small group by 1), cons as (select cloud, avg(abs(nx*ax+ny*ay+nz*az)) as c from normals_small join m using (cloud) group by 1),
 s as (select cloud, n, (e0-e1)/(e0+1e-9) as lin, (e1-e2)/(e0+1e-9) as plan, e2/(e0+1e-9) as sc, mc, c from eig join mc using (cloud) join cons using (cloud))
select cloud, {r('c', 'consistency')}, case when n < 5 then 'unknown' when plan > 0.55 and mc < 0.03 then 'plane' when lin < 0.4 and plan > 0.2 and sc < 0.12 and c > 0.85 then 'hole' when mc > 0.03 and mc < 0.08 and plan > 0.3 and sc < 0.15 then 'chamfer' when sc > 0.12 then 'pocket' else 'unknown' end as label from s"""


def local_primitives(spark, d):
    return rounded(G.local_primitive(X.pts_small(spark, d)))


LOCAL_SQL = with_views("pts_small") + f""", {CENTRED}, s as (select *, list_reverse_sort([hix-lox, hiy-loy, hiz-loz]) as s from eig)
select cloud, n, {r('(e1-e0)/(e0+1e-10)', 'planarity')}, {r('(e0-e1)/(e0+1e-10)', 'linearity')}, {r('e2/(e0+1e-10)', 'sphericity')}, {r('s[2]', 'diameter')}, {r('s[1]', 'height')}, {r('s[3]', 'thickness')},
 case when n < 10 then 'unknown' when e2/(e0+1e-10) > 0.5 and abs(e0-e2) < 0.1 then 'sphere' when (e0-e1)/(e0+1e-10) > 0.5 then 'cylinder' when s[2]/(s[1]+1e-10) > 0.8 and s[3] < 0.1 then 'hole' when s[2]/(s[1]+1e-10) < 0.3 then 'slot' when s[3] < 0.2 then 'pocket' else 'unknown' end as feature_type from s"""


def whole_measure(spark, d):
    return rounded(G.whole_measure(X.pts_small(spark, d)), 5)


WHOLE_SQL = GEO + f""", w as (select *, sqrt(greatest(0, x*x+y*y+z*z - (x*bx+y*by_+z*bz)*(x*bx+y*by_+z*bz))) as r0 from geo)
select cloud, {r('2*avg(r0)', 'measured', 5)}, {r('count(*)*0.1::double', 'surface_area', 5)}, {r('greatest(max(sx), max(sy), max(sz))/(least(max(sx), max(sy), max(sz))+1e-9)', 'aspect_ratio', 5)},
 case when avg(x) >= 0 and avg(y) >= 0 then 'Q1' when avg(x) < 0 and avg(y) >= 0 then 'Q2' when avg(x) < 0 and avg(y) < 0 then 'Q3' else 'Q4' end as quadrant, floor(avg(z)/10)::int as layer_index from w group by 1"""


def scaled_clouds(spark, d):
    return rounded(G.normalised(X.pts_small(spark, d)), 8)


SCALED_SQL = with_views("pts_small") + ", b as (select cloud, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from pts_small group by 1) select cloud, pid, " + ", ".join(r(f"({c}-l{c})/(h{c}-l{c}+1e-10)", c, 8) for c in "xyz") + " from pts_small join b using (cloud)"


def unit_ball(spark, d):
    return rounded(G.unit_ball(X.pts_small(spark, d)), 8)


UNIT_SQL = with_views("pts_small") + ", c as (select cloud, pid, x-avg(x) over w as x, y-avg(y) over w as y, z-avg(z) over w as z from pts_small window w as (partition by cloud)), m as (select cloud, max(sqrt(x*x+y*y+z*z)) as r from c group by 1) select cloud, pid, " + ", ".join(r(f"{c}/r", c, 8) for c in "xyz") + " from c join m using (cloud)"


def _centroids(spark, d):
    """Centroids of the clouds; rows go to their cloud once, for both the distinct points and the means."""
    c = X.rows_big(spark, d).repartition("cloud").distinct().groupBy("cloud").agg(*(F.avg(k).alias(k) for k in "xyz"))
    return c.select(F.lit(0).alias("cloud"), F.col("cloud").alias("pid"), "x", "y", "z")


def near_centroids(spark, d):
    return S.near_centroids(cutter(spark)(_centroids(spark, d)), 2.0).select("pid1", "pid2")


CENTROIDS_SQL = with_views("pts_big") + ", c as (select cloud as pid, avg(x) x, avg(y) y, avg(z) z from pts_big group by 1) select a.pid as pid1, b.pid as pid2 from c a join c b on a.pid <> b.pid and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 4.0"


def points_in_features(spark, d):
    p = X.pts_small(spark, d)
    c = p.groupBy("cloud").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.lit(0.2).alias("radius"), F.lit(1).alias("feature"))
    b = p.groupBy("cloud").agg(*(F.percentile(k, F.lit(q)).alias(f"{k}{i}") for k in "xyz" for i, q in ((0, 0.4), (1, 0.6))), F.lit(2).alias("feature"))
    return S.in_shell(p, c).union(S.in_box(p, b))


IN_FEATURES_SQL = with_views("pts_small") + """, c as (select cloud, avg(x) cx, avg(y) cy from pts_small group by 1), b as (select cloud, quantile_cont(x, 0.4) x0, quantile_cont(x, 0.6) x1, quantile_cont(y, 0.4) y0, quantile_cont(y, 0.6) y1, quantile_cont(z, 0.4) z0, quantile_cont(z, 0.6) z1 from pts_small group by 1)
select cloud, 1 as feature, pid from pts_small join c using (cloud) where abs(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) - 0.2) < 0.1
union all select cloud, 2, pid from pts_small join b using (cloud) where x between x0-0.1 and x1+0.1 and y between y0-0.1 and y1+0.1 and z between z0-0.1 and z1+0.1"""


def triangle_quota(spark, d):
    return rounded(K.triangle_quota(X.triangles(spark, d)).select("face_id", "tri_id", "area", "quota"), 8)


AREA = "sqrt(pow((p2[2]-p1[2])*(p3[3]-p1[3])-(p2[3]-p1[3])*(p3[2]-p1[2]), 2) + pow((p2[3]-p1[3])*(p3[1]-p1[1])-(p2[1]-p1[1])*(p3[3]-p1[3]), 2) + pow((p2[1]-p1[1])*(p3[2]-p1[2])-(p2[2]-p1[2])*(p3[1]-p1[1]), 2))/2"
QUOTA_CTE = f"a as (select *, {AREA} as area from triangles), q as (select *, greatest(5, floor(500*area/sum(area) over (partition by face_id)))::int as quota from a)"
QUOTA_SQL = with_views("triangles") + f", {QUOTA_CTE} select face_id, tri_id, {r('area', 'area', 8)}, quota from q"


def uniform_sql(seed, *keys):
    return f"(('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(f'({k})::varchar' for k in keys)}), 1, 12))::bigint / 281474976710656.0::double)"


def sampled_faces(spark, d):
    return rounded(K.sample_faces(X.triangles(spark, d)), 6)


SAMPLED_SQL = with_views("triangles") + f""", {QUOTA_CTE}, e as (select *, unnest(range(1, quota+1)) as k from q), u as (select *, sqrt({uniform_sql('mesh1', 'tri_id', 'k')}) as r1, {uniform_sql('mesh2', 'tri_id', 'k')} as r2 from e)
select face_id, tri_id, k::int as k, {', '.join(r(f'(1-r1)*p1[{i}] + r1*(1-r2)*p2[{i}] + r1*r2*p3[{i}]', c) for i, c in ((1, 'x'), (2, 'y'), (3, 'z')))} from u"""


def downsampled(spark, d):
    return K.downsample(X.pts_small(spark, d), 20).select("cloud", "pid")


DOWN_SQL = with_views("pts_small") + f" select cloud, pid from pts_small qualify row_number() over (partition by cloud order by {uniform_sql('down', 'cloud', 'pid')}, pid) <= 20"


def noise_variants(spark, d):
    out = K.noise_variants(X.pts_small(spark, d))
    return rounded(out.select("cloud", "pid", "variant", "x", "y", "z"), 6)


def normal_sql(seed):
    return f"sqrt(-2*ln(1-{uniform_sql(seed + 'u', 'cloud', 'pid')}))*cos(2*pi()*{uniform_sql(seed + 'v', 'cloud', 'pid')})"


NOISE_SQL = with_views("pts_small") + ", v as (select *, unnest(['ideal', 'in_tol', 'out_tol']) as variant, unnest([0.0::double, 0.05, 0.15]) as sigma from pts_small) select cloud, pid, variant, " + ", ".join(r(f"{c} + sigma*{normal_sql('variant' + c)}", c) for c in "xyz") + " from v"


def outliers_moved(spark, d):
    return rounded(K.outliers(X.pts_small(spark, d)), 6)


OUT_SQL = with_views("pts_small") + f", h as (select *, row_number() over (partition by cloud order by {uniform_sql('out', 'cloud', 'pid')}, pid) <= floor(count(*) over (partition by cloud)*0.05::double + 1e-9) as hit from pts_small) select cloud, pid, " + ", ".join(r(f"case when hit then {c} + 2*{uniform_sql('out' + c, 'cloud', 'pid')} - 1 else {c} end", c) for c in "xyz") + " from h"


def occluded(spark, d):
    return K.occlusions(X.pts_small(spark, d), chance=0.5).select("cloud", "pid")


OCC_SQL = with_views("pts_small") + f" select cloud, pid from pts_small qualify row_number() over (partition by cloud order by {uniform_sql('occp', 'cloud', 'pid')}, pid) > floor(count(*) over (partition by cloud) * (case when {uniform_sql('occ', 'cloud')} < 0.5 then 0.05 + (0.15::double - 0.05::double)*{uniform_sql('occs', 'cloud')} else 0 end) + 1e-9)"


def tolerance_draw(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("seq"), (F.col("p_retailprice") + (F.col("p_partkey") % 3) / 1000).alias("nominal"))
    return rounded(K.tolerance_draw(rows), 6)


DRAW_SQL = f"""with n as (select p_partkey as seq, p_retailprice + (p_partkey%3)/1000.0::double as nominal from part), f as (select round(nominal, 2) as key, arg_min(nominal, seq) as first from n group by 1),
 t as (select *, first*(0.01 + (0.03::double - 0.01::double)*{uniform_sql('42v', "printf('%.2f', key)")}) as tol, (['bilateral', 'unilateral_upper', 'unilateral_lower'])[(floor({uniform_sql('42k', "printf('%.2f', key)")}*3) + 1)::int] as kind from f)
select seq, {r('nominal', 'nominal')}, kind, {r('tol', 'value')}, {r("case when kind <> 'unilateral_lower' then first + tol else first end", 'upper_limit')}, {r("case when kind <> 'unilateral_upper' then first - tol else first end", 'lower_limit')} from n join t on round(nominal, 2) = key"""


def farthest_points(spark, d):
    return K.farthest_points(X.pts_small(spark, d), 8)


FARTHEST_SQL = with_views("pts_small").replace("with ", "with recursive ", 1) + """, pick as (
 select cloud, 1 as place, pid, [x] as xs, [y] as ys, [z] as zs from pts_small qualify row_number() over (partition by cloud order by pid) = 1
 union all select cloud, place, pid, xs, ys, zs from (select k.cloud, k.place + 1 as place, p.pid, list_append(k.xs, p.x) as xs, list_append(k.ys, p.y) as ys, list_append(k.zs, p.z) as zs,
   row_number() over (partition by k.cloud order by list_min(list_transform(range(1, k.place + 1), lambda i: (p.x-k.xs[i])*(p.x-k.xs[i]) + (p.y-k.ys[i])*(p.y-k.ys[i]) + (p.z-k.zs[i])*(p.z-k.zs[i]))) desc, p.pid) as best
  from pick k join pts_small p using (cloud) where k.place < 8) where best = 1)
select cloud, pid, place from pick"""


def sphere_fits(spark, d):
    return rounded(G.sphere_fit(X.pts_small(spark, d)), 5)


SPHERE_FITS_SQL = with_views("pts_small") + BALL + f" select cloud, {', '.join(r(f'o{c}', f'o{c}', 5) for c in 'xyz')}, {r('radius', 'radius', 5)}, {r('sphere', 'sphere', 5)} from ball"

QUERIES = [
    ("segment_summary", segment_summary, SUMMARY_SQL), ("big_summary", big_summary, BIG_SUMMARY_SQL), ("value_distribution", distribution, DISTRIBUTION_SQL), ("nearest_points", nearest_points, NEAREST_SQL),
    ("nearest_points_grid", nearest_points_grid, NEAREST_GRID_SQL), ("radius_pairs", radius_pairs, RADIUS_SQL), ("point_curvature", point_curvature, CURVATURE_SQL), ("curvature_statistics", curvature_statistics, CURVATURE_STATS_SQL),
    ("curvature_bands", curvature_bands, BANDS_SQL), ("two_scale_curvature", two_scale_curvature, TWO_SCALE_SQL), ("point_descriptors", point_descriptors, DESCRIPTORS_SQL), ("point_spacing", point_spacing, SPACING_SQL),
    ("outliers_removed", outliers_removed, OUTLIERS_SQL), ("neighbour_edges", neighbour_edges, EDGES_SQL), ("interpolated", interpolated, INTERPOLATED_SQL), ("cylinder_fit", cylinder_fit, CYLINDER_SQL),
    ("cylinder_fit_short", cylinder_fit_short, CYLINDER_SHORT_SQL), ("sphere_dimensions", sphere_dimensions, SPHERE_SQL), ("plane_and_box", plane_and_box, PLANE_SQL), ("cone_parameters", cone_parameters, CONE_SQL),
    ("primitive_ratios", primitive_ratios, PRIMITIVES_SQL), ("feature_classes", feature_classes, CLASSES_SQL), ("point_segment_classes", point_segment_classes, POINT_CLASSES_SQL), ("local_primitives", local_primitives, LOCAL_SQL),
    ("whole_measure", whole_measure, WHOLE_SQL), ("scaled_clouds", scaled_clouds, SCALED_SQL), ("unit_ball", unit_ball, UNIT_SQL), ("near_centroids", near_centroids, CENTROIDS_SQL),
    ("points_in_features", points_in_features, IN_FEATURES_SQL), ("triangle_quota", triangle_quota, QUOTA_SQL), ("sampled_faces", sampled_faces, SAMPLED_SQL), ("downsampled", downsampled, DOWN_SQL),
    ("noise_variants", noise_variants, NOISE_SQL), ("outliers_moved", outliers_moved, OUT_SQL), ("occluded", occluded, OCC_SQL), ("tolerance_draw", tolerance_draw, DRAW_SQL),
    ("farthest_points", farthest_points, FARTHEST_SQL), ("sphere_fits", sphere_fits, SPHERE_FITS_SQL),
]
