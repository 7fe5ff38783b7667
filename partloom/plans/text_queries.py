"""Label text: parsing, categories, status."""

from pyspark.sql import functions as F

from partloom.functions import text as T
from partloom.schemas import GDT_SYMBOLS
from partloom.sources import fixtures as X
from partloom.sources.fixtures import with_views

N = r"\d+\.?\d*"
CLEAN = "trim(regexp_replace(text, '[⌀°]', '', 'g'))"


def dimension_parse(spark, d):
    out = X.labels_2d(spark, d).select("id", T.dimension(F.col("text")).alias("p"))
    return out.select("id", "p.type", *(F.round(f"p.{c}", 6).alias(c) for c in ("nominal", "value", "upper_limit", "lower_limit")))


DIMENSION_SQL = with_views("labels_2d") + rf""", t as (select id, {CLEAN} as t from labels_2d),
m as (select id, t, regexp_matches(t, '^({N})\s*±\s*({N})') as sym, regexp_matches(t, '^({N})\s*([+-]\s*{N})?\s*/\s*([+-]?\s*{N})') as asym,
  try_cast(regexp_extract(t, '^({N})', 1) as double) as n, try_cast(regexp_extract(t, '^({N})\s*±\s*({N})', 2) as double) as s,
  coalesce(try_cast(nullif(replace(regexp_extract(t, '^({N})\s*([+-]\s*{N})?\s*/\s*([+-]?\s*{N})', 2), ' ', ''), '') as double), 0) as u,
  try_cast(nullif(replace(regexp_extract(t, '^({N})\s*([+-]\s*{N})?\s*/\s*([+-]?\s*{N})', 3), ' ', ''), '') as double) as l from t)
select id, case when sym then 'symmetric' when asym then 'asymmetric' when n is not null then 'nominal_only' else 'unknown' end as type,
 round(coalesce(n, 0), 6) as nominal, round(case when sym then s when asym then abs(u-l)/2 else 0 end, 6) as value,
 round(case when sym then n+s when asym then n+u else coalesce(n, 0) end, 6) as upper_limit, round(case when sym then n-s when asym then n+l else coalesce(n, 0) end, 6) as lower_limit from m"""


def _spoken(spark, d):
    """Texts as a recogniser may give them."""
    p = F.col("p_partkey")
    nominal, tol = F.format_string("%.1f", F.floor("p_retailprice") / 10), F.format_string("%.2f", (p % 9 + 1) / 100)
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.when(p % 6 == 0, F.concat(nominal, F.lit(" ±"), tol)).when(p % 6 == 1, F.concat(nominal, F.lit(" +0.2/-0.1"))).when(p % 6 == 2, F.concat(F.lit("⌀"), (p % 90 + 10).cast("string")))
        .when(p % 6 == 3, F.concat((p % 90 + 10).cast("string"), F.lit(" H7"))).when(p % 6 == 4, F.concat(F.lit("R "), nominal, F.lit(" l0O|"))).otherwise(F.col("p_name")).alias("text"),
    )


SPOKEN = """spoken as (select p_partkey as id, case p_partkey%6 when 0 then printf('%.1f', floor(p_retailprice)/10) || ' ±' || printf('%.2f', (p_partkey%9 + 1)/100.0::double)
  when 1 then printf('%.1f', floor(p_retailprice)/10) || ' +0.2/-0.1' when 2 then '⌀' || (p_partkey%90 + 10)::varchar when 3 then (p_partkey%90 + 10)::varchar || ' H7'
  when 4 then 'R ' || printf('%.1f', floor(p_retailprice)/10) || ' l0O|' else p_name end as text from part)"""


def _tolerance(legacy):
    def run(spark, d):
        out = _spoken(spark, d).select("id", T.tolerance(F.col("text"), legacy).alias("p"))
        return out.select("id", "p.type", *(F.round(f"p.{c}", 6).alias(c) for c in ("nominal", "upper_limit", "lower_limit")))

    return run


def _tolerance_sql(legacy):
    any_ = f"(?i)[⌀DIA\\d]*\\s*({N})" if legacy else f"({N})"
    kind = "case when round_ then 'diameter' else 'linear' end" if legacy else "case when fit then 'fit' when round_ then 'diameter' else 'linear' end"
    return rf"""with {SPOKEN}, m as (select id, regexp_matches(text, '({N})\s*±\s*({N})') as sym, regexp_matches(text, '({N})\s*\+\s*({N})\s*/\s*-\s*({N})') as lim,
  try_cast(nullif(regexp_extract(text, '({N})\s*±\s*({N})', 1), '') as double) as n, try_cast(nullif(regexp_extract(text, '({N})\s*±\s*({N})', 2), '') as double) as v,
  try_cast(nullif(regexp_extract(text, '({N})\s*\+\s*({N})\s*/\s*-\s*({N})', 1), '') as double) as ln, try_cast(nullif(regexp_extract(text, '({N})\s*\+\s*({N})\s*/\s*-\s*({N})', 2), '') as double) as lu,
  try_cast(nullif(regexp_extract(text, '({N})\s*\+\s*({N})\s*/\s*-\s*({N})', 3), '') as double) as ll, try_cast(nullif(regexp_extract(text, '{any_}', 1), '') as double) as p,
  contains(text, '⌀') or contains(upper(text), 'DIA') as round_, regexp_matches(text, '({N})\s*([Hh][0-9]|[Gg][0-9])') as fit from spoken)
select id, case when sym then 'bilateral' when lim then 'limit' when p is not null then {kind} else 'unknown' end as type,
 round(case when sym then n when lim then ln else coalesce(p, 0) end, 6) as nominal, round(case when sym then n+v when lim then ln+lu else coalesce(p, 0) end, 6) as upper_limit,
 round(case when sym then n-v when lim then ln-ll else coalesce(p, 0) end, 6) as lower_limit from m"""


def text_cleaned(spark, d):
    return _spoken(spark, d).select("id", T.cleaned(F.concat("text", F.lit("  +/- 0.1 ?!"))).alias("cleaned"))


CLEANED_SQL = rf"with {SPOKEN} select id, trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text || '  +/- 0.1 ?!', '\s+', ' ', 'g'), '?', ''), '|', ''), '!', ''), 'o', '0'), 'O', '0'), 'l', '1'), 'I', '1'), '+/-', '±')) as cleaned from spoken"


def text_categories(spark, d):
    t = F.concat("text", F.element_at(F.array(*map(F.lit, ("", "⌖", "⟂ a", " square", " flatness"))), (F.col("id") % 5 + 1).cast("int")))
    return _spoken(spark, d).select("id", T.semantic_category(t).alias("category"), T.geometric_tolerance(t).alias("geometric"), T.label_category(t).alias("label"), T.pair_kind(t).alias("pair_kind"), T.is_symbol_only(F.substring(t, -1, 1)).alias("symbol"))


_T5 = "text || (['', '⌖', '⟂ a', ' square', ' flatness'])[(id%5 + 1)::int]"
CATEGORIES_SQL = f"""with {SPOKEN}, s as (select id, {_T5} as t from spoken)
select id, case when contains(t, '⌀') or contains(lower(t), 'dia') then 'hole' when contains(t, 'R') or contains(lower(t), 'radius') then 'fillet' when contains(t, '□') or contains(lower(t), 'square') then 'slot'
 when contains(t, '⌖') or contains(lower(t), 'position') then 'pattern' when contains(t, '⟂') or contains(lower(t), 'perpendicular') then 'surface' when contains(t, '⏊') or contains(lower(t), 'flatness') then 'plane' else 'unknown' end as category,
 case {' '.join(f"when contains(t, '{k}') then '{v}'" for k, v in GDT_SYMBOLS.items())} end as geometric,
 case when contains(t, '⌀') then 'hole' when contains(t, '±') or contains(t, '/') then 'dimension_with_tolerance' else 'dimension' end as label,
 case when contains(lower(t), '⌀') or contains(lower(t), 'diameter') then 2 when contains(lower(t), 'width') or contains(lower(t), 'slot') then 4 else 0 end as pair_kind,
 (unicode(right(t, 1)) > 8960) or regexp_matches(right(t, 1), '^[{''.join(GDT_SYMBOLS)}\\s]+$') as symbol from s"""


def allowed_kinds(spark, d):
    return X.labels_2d(spark, d).select("id", F.concat_ws(",", T.allowed_kinds(F.col("category"), F.col("text"))).alias("kinds"))


KINDS_SQL = with_views("labels_2d") + """ select id, case when contains(category, 'hole') or contains(text, '⌀') then 'through_hole,blind_hole,cylinder,sphere' when contains(category, 'datum') then 'plane,cylinder'
 when contains(category, 'width') or contains(category, 'slot') then 'slot,pocket' when contains(category, 'chamfer') or contains(lower(text), 'r') then 'chamfer,fillet,sphere,cone'
 else 'plane,pocket,cylinder,cone,through_hole,blind_hole' end as kinds from labels_2d"""


def datum_nodes(spark, d):
    p = F.col("p_partkey")
    text = F.when(p % 4 == 0, "A").when(p % 4 == 1, "A B C").when(p % 4 == 2, "B-D").otherwise(F.col("p_name"))
    rows = spark.read.parquet(f"{d}/part.parquet").select(p.alias("id"), F.posexplode(T.datum_letters(text)).alias("k", "letter"))
    return rows.select("id", "letter", (F.col("k") * 20.0 + F.col("id") % 100).alias("x"))


DATUM_SQL = r"""with t as (select p_partkey as id, case p_partkey%4 when 0 then 'A' when 1 then 'A B C' when 2 then 'B-D' else p_name end as t from part),
 l as (select id, regexp_extract_all(t, '([A-Z])', 1) as ls from t where regexp_matches(t, '^[A-Z](?:(?:\s+|\s*-\s*)[A-Z])*$')),
 u as (select id, unnest(ls) as letter, generate_subscripts(ls, 1) - 1 as k from l)
select id, letter, k*20.0::double + id%100 as x from u"""


def label_round_trip(spark, d):
    """Text written from nominal and tolerance parses back to them."""
    kind = F.element_at(F.array(*map(F.lit, ("symmetric", "upper", "lower"))), (F.col("pos") % 3 + 1).cast("int"))
    rows = X.labels_2d(spark, d).withColumn("display", T.display(kind, F.col("tol")))
    p = T.dimension(F.when(F.col("pos") % 3 == 2, F.concat(F.format_string("%.2f", "nominal"), F.lit("/-"), F.format_string("%.2f", "tol"))).otherwise(F.concat(F.format_string("%.2f", "nominal"), F.col("display"))))
    return rows.select("id", "display", F.round(p["nominal"], 2).alias("nominal"), F.round(p["upper_limit"] - p["lower_limit"], 4).alias("range"))


ROUND_TRIP_SQL = with_views("labels_2d") + """ select id, case pos%3 when 0 then '±' || printf('%.2f', tol) when 1 then '+' || printf('%.2f', tol) || '/0' else '0/-' || printf('%.2f', tol) end as display,
 round(nominal, 2) as nominal, round(case pos%3 when 0 then 2*tol else tol end, 4) as range from labels_2d"""


def tolerance_status(spark, d):
    rows = X.labels_2d(spark, d).join(X.measured_3d(spark, d).select("pos", "value"), "pos")
    p = T.dimension(F.col("text"))
    return rows.select("id", T.tolerance_status(F.col("value"), p["upper_limit"], p["lower_limit"]).alias("status"), F.round(F.abs(p["upper_limit"] - p["lower_limit"]), 6).alias("range"))


STATUS_SQL = with_views("labels_2d", "measured_3d") + """, j as (select l.id, value, case pos%3 when 2 then nominal else nominal + tol end as u, case pos%3 when 1 then nominal else nominal - tol end as lo from labels_2d l join measured_3d using (pos))
select id, case when value between lo and u then 'IN_TOLERANCE' when abs(value-u) <= 0.1*abs(u-lo) or abs(value-lo) <= 0.1*abs(u-lo) then 'MARGINAL' else 'OUT_OF_TOLERANCE' end as status, round(abs(u-lo), 6) as range from j"""


def label_counts(spark, d):
    return X.labels_2d(spark, d).groupBy(T.label_category(F.col("text")).alias("label")).agg(F.count("*").alias("n"))


LABEL_COUNTS_SQL = with_views("labels_2d") + " select case when contains(text, '⌀') then 'hole' when contains(text, '±') or contains(text, '/') then 'dimension_with_tolerance' else 'dimension' end as label, count(*) as n from labels_2d group by 1"


def json_properties(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k double, missing double").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("p.k", F.lit(0.0))).alias("k"), F.sum(F.coalesce("p.missing", F.lit(1.0))).alias("filled"))


JSON_SQL = "select event_type, count(*) as n, sum(coalesce(json_extract(props, '$.k')::double, 0)) as k, sum(coalesce(json_extract(props, '$.missing')::double, 1.0)) as filled from events group by 1"


def model_files(spark, d):
    """Part id from result file names, and label files joined with the clouds of the same part."""
    p = F.col("p_partkey")
    two = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("/data/p"), p % 50, F.lit("_"), F.element_at(F.array(*map(F.lit, ("front", "top", "side"))), (p % 3 + 1).cast("int")), F.lit("_features.json")).alias("path")).distinct()
    three = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), p % 40, F.lit("_in_tol_features")).alias("stem3")).distinct()
    two = two.withColumn("part", T.part_of(T.stem(F.col("path"))))
    return two.join(three.withColumn("part", T.part_of(F.col("stem3"))), "part").select("part", "path", "stem3")


MODEL_FILES_SQL = """with two as (select distinct 'p' || (p_partkey%50)::varchar as part, '/data/p' || (p_partkey%50)::varchar || '_' || (['front', 'top', 'side'])[(p_partkey%3 + 1)::int] || '_features.json' as path from part),
 three as (select distinct 'p' || (p_partkey%40)::varchar as part, 'p' || (p_partkey%40)::varchar || '_in_tol_features' as stem3 from part) select * from two join three using (part)"""

QUERIES = [
    ("dimension_parse", dimension_parse, DIMENSION_SQL),
    ("tolerance_parse", _tolerance(False), _tolerance_sql(False)),
    ("tolerance_parse_legacy", _tolerance(True), _tolerance_sql(True)),
    ("text_cleaned", text_cleaned, CLEANED_SQL),
    ("text_categories", text_categories, CATEGORIES_SQL),
    ("allowed_kinds", allowed_kinds, KINDS_SQL),
    ("datum_nodes", datum_nodes, DATUM_SQL),
    ("label_round_trip", label_round_trip, ROUND_TRIP_SQL),
    ("tolerance_status", tolerance_status, STATUS_SQL),
    ("label_counts", label_counts, LABEL_COUNTS_SQL),
    ("json_properties", json_properties, JSON_SQL),
    ("model_files", model_files, MODEL_FILES_SQL),
]
