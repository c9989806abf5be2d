"""p5: keypoints consolidated over matches and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.keypoints import keypoint_groups
from skerry.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keypoint_groups(*[table(spark, sf_dir, t) for t in ("pairs", "matches", "observations")])


SQL = {
    "p5_found": """
WITH RECURSIVE p AS (SELECT DISTINCT pair_idx, lower(trim(capture, E' \\t\\r\\n')) AS capture, image_i, image_j FROM pairs WHERE capture IS NOT NULL),
m AS (SELECT DISTINCT p.capture, image_i, feature_i, image_j, feature_j FROM matches JOIN p USING (pair_idx)),
o AS (SELECT DISTINCT lower(trim(capture, E' \\t\\r\\n')) AS capture, track_id, frame_idx, feature_idx FROM observations WHERE capture IS NOT NULL AND feature_idx IS NOT NULL),
k AS (SELECT capture, image_i AS i, feature_i AS f FROM m WHERE feature_i IS NOT NULL UNION SELECT capture, image_j, feature_j FROM m WHERE feature_j IS NOT NULL UNION SELECT capture, frame_idx, feature_idx FROM o),
t AS (SELECT capture, track_id, min((frame_idx, feature_idx)) AS a FROM o GROUP BY ALL),
e0 AS (SELECT capture, image_i AS i, feature_i AS f, image_j AS i2, feature_j AS f2 FROM m WHERE feature_i IS NOT NULL AND feature_j IS NOT NULL
  UNION SELECT o.capture, frame_idx, feature_idx, a[1], a[2] FROM o JOIN t USING (capture, track_id)),
e AS (SELECT capture, i, f, i2, f2 FROM e0 UNION SELECT capture, i2, f2, i, f FROM e0),
r AS (SELECT capture, i, f, i AS gi, f AS gf FROM k UNION SELECT r.capture, e.i2, e.f2, r.gi, r.gf FROM r JOIN e ON e.capture = r.capture AND e.i = r.i AND e.f = r.f WHERE (r.gi, r.gf) < (e.i2, e.f2))
SELECT capture, i AS image_idx, f AS feature_idx, min((gi, gf))[1] AS group_image_idx, min((gi, gf))[2] AS group_feature_idx FROM r GROUP BY ALL"""
}
QUERIES = {"p5_found": p5_found}
