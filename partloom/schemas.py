"""Fixed schemas and enumerations of engineering-part data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature kinds and their ids, surface kinds, relation names, noise levels, views.
TYPE_IDS = {"plane": 0, "cylinder": 1, "through_hole": 2, "blind_hole": 2, "pocket": 3, "slot": 4, "cone": 5, "sphere": 6, "chamfer": 7, "unknown": 8}
UNKNOWN_ID = 8
SURFACES = {"plane": 0, "cylinder": 1, "cone": 2, "sphere": 3, "torus": 4, "bspline": 6}
RELATIONS = ("convex", "concave", "orthogonal")
NOISE_MM = {"ideal": 0.0, "in_tol": 0.05, "out_tol": 0.15}
VIEWS = {"front": (0.0, 0.0, 1.0), "top": (0.0, 1.0, 0.0), "side": (1.0, 0.0, 0.0)}
GDT_SYMBOLS = {
    "⏊": "flatness", "○": "circularity", "⌭": "cylindricity", "⌓": "profile_of_surface", "∠": "angularity",
    "⟂": "perpendicularity", "∥": "parallelism", "⌖": "position", "◎": "concentricity", "↗": "circular_runout",
}



def _struct(ddl: str) -> str:
    """Top-level DDL as the inside of a struct type: `name type` becomes `name:type`."""
    return re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2:", ddl)


POINTS = "model_id string, cloud string, pid int, face_id int, x double, y double, z double"
NODE_2D = (
    "id string, type string, value double, "
    "tolerance struct<type:string,nominal:double,value:double,upper_limit:double,lower_limit:double,upper_deviation:double,lower_deviation:double,display:string,datum_letter:string>, "
    "position_2d array<double>, semantic_info struct<feature_category:string,extraction_method:string,rotation:double,is_diameter:boolean,has_tolerance:boolean,raw_text:string>, "
    "text_embedding array<float>, visual_features array<float>, bbox array<double>, confidence double, text_content string, parent_dimension string, related_datums array<string>"
)
NODE_3D = (
    "id string, type string, measured_value map<string,double>, position_3d array<double>, "
    "geometry struct<bounding_box_mm:array<array<double>>,surface_area_mm2:double,normal_std:double,curvature:struct<mean:double,std:double,max:double>>, "
    "point_indices array<int>, confidence double, node_features array<double>, "
    "topology struct<source_face_ids:array<int>,adjacent_segments:array<struct<segment:string,relation:string>>,contains:array<string>,inside:array<string>>"
)
EDGE = "src string, dst string, type string, weight double, features struct<deviation:double,tolerance_status:string,matching_scores:struct<geom:double,spatial:double>,relation:string>"
GRAPH = f"nodes_2d map<string,struct<{_struct(NODE_2D)}>>, nodes_3d map<string,struct<{_struct(NODE_3D)}>>, edges array<struct<{_struct(EDGE)}>>"


def type_id(kind: Column) -> Column:
    """The kind's id, 8 for any other or null."""
    out = F.lit(UNKNOWN_ID)
    for name, i in TYPE_IDS.items():
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out
