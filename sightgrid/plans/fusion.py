"""Registered queries: linking, components, identities and threshold sweeps over the camera view.

A frame of the view is one hour, so the time gate is left wide; narrow gates are covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.operators import fusion, identity, matching, sweep
from sightgrid.session import cut_lineage
from sightgrid.sources.tables import DEMO_SITE, DET_SQL, OVERLAP_SQL, detections

c = F.col
WIDE = 1e9


def _pairs(spark, sf, limit=1.0):
    return fusion.candidate_pairs(detections(spark, sf), DEMO_SITE, limit, WIDE)


def candidate_pairs(spark, sf):
    return _pairs(spark, sf).select("frame", "det_ord_a", "det_ord_b", F.bround("distance_m", 6).alias("distance_m"))


def optimal_links(spark, sf):
    links = fusion.gate(fusion.optimal_links(detections(spark, sf), DEMO_SITE, WIDE), 1.0)
    return links.select("frame", "cam_a", "track_id_a", "cam_b", "track_id_b", "class_key_a", "distance_m")


def optimal_link_costs(spark, sf):
    """Links and total distance of each block's optimal pairing (equal whichever of equally good pairings is taken)."""
    links = fusion.optimal_links(detections(spark, sf), DEMO_SITE, WIDE)
    return links.groupBy("frame", "cam_a", "cam_b", c("class_key_a").alias("class_key")).agg(
        F.count(F.lit(1)).alias("links"), F.bround(F.sum("distance_m"), 6).alias("total_m"))


def mutual_nearest_links(spark, sf):
    return fusion.mutual_nearest_links(_pairs(spark, sf)).select(
        "frame", "det_ord_a", "det_ord_b", F.bround("distance_m", 6).alias("distance_m"))


def frame_components(spark, sf):
    return fusion.frame_components(fusion.mutual_nearest_links(_pairs(spark, sf))).drop("run_id")


def exact_identities(spark, sf):
    """The view with sticky ids over the optimal pairing."""
    d = detections(spark, sf)
    links = fusion.gate(fusion.optimal_links(d, DEMO_SITE, WIDE), 1.0)
    return identity.assign_global_ids(d, links)


def global_ids(spark, sf):
    return exact_identities(spark, sf).select("frame", "cam_id", "track_id", "class_key", "global_id")


IDS_CHUNK = 1000  # rows; small, so that the registered tables are replayed in many chunks


def mutual_identities(spark, sf):
    """The view with sticky ids over mutual-nearest links."""
    links = fusion.mutual_nearest_links(_pairs(spark, sf))
    return identity.assign_global_ids(detections(spark, sf), links, IDS_CHUNK)


def global_ids_mutual(spark, sf):
    return mutual_identities(spark, sf).select("frame", "cam_id", "track_id", "class_key", "global_id")


def transitive_ids(spark, sf):
    links = fusion.mutual_nearest_links(_pairs(spark, sf, 0.5))
    return identity.transitive_global_ids(links).drop("run_id")


def numbered(spark, sf):
    """Camera view with a stand-in identity that SQL can give too: the track number, shifted now and then."""
    return detections(spark, sf).withColumn("global_id", c("track_id") + F.when(c("frame") % 7 == 0, 1).otherwise(0))


GID_SQL = DET_SQL + ", gdet AS (SELECT *, track_id + CASE WHEN frame % 7 = 0 THEN 1 ELSE 0 END AS global_id FROM det)"


def fusion_links(spark, sf):
    return fusion.fusion_links(numbered(spark, sf)).drop("run_id", "timestamp")


def track_stability(spark, sf):
    return identity.track_stability(numbered(spark, sf)).drop("run_id")


def solo_entities(spark, sf):
    return identity.solo_entities(numbered(spark, sf)).drop("run_id")


def labelled(spark, sf):
    return detections(spark, sf).where(c("class_name") == "personne").withColumn(
        "truth_id", F.when(c("track_id") % 12 == 5, "").otherwise((c("track_id") % 12).cast("string")))


def pair_quality(spark, sf):
    """Cross-camera pairs of each frame against labels, for a stand-in identity."""
    d = labelled(spark, sf).withColumn("global_id", c("track_id") % 9)
    return matching.event_metrics(matching.pair_counts(d, ["run_id"])).drop("run_id")


SWEEP_LIMITS = (50, 100, 150, 200)  # cm


def threshold_sweep_truth(spark, sf):
    return sweep.sweep_with_truth(labelled(spark, sf), DEMO_SITE, window_s=WIDE).drop("run_id")


def threshold_sweep_operational(spark, sf):
    return sweep.sweep_operational(detections(spark, sf), DEMO_SITE, [11], window_s=WIDE).drop("run_id")


def threshold_sweep_mutual(spark, sf):
    """Operational sweep on mutual-nearest links and session-wide components (the order-free variant)."""
    d = detections(spark, sf).where(c("class_name") == "personne")
    limits = SWEEP_LIMITS
    links = None
    for t in limits:
        part = fusion.mutual_nearest_links(fusion.candidate_pairs(d, DEMO_SITE, t / 100.0, WIDE)).withColumn(
            "run_id", F.concat_ws("\u0001", "run_id", F.lit(str(t))))
        links = part if links is None else links.union(part)
    roots = identity.transitive_global_ids(cut_lineage(links))
    per = d.withColumn("t", F.explode(F.array(*[F.lit(str(t)) for t in limits]))).withColumn(
        "run_id", F.concat_ws("\u0001", "run_id", "t")).withColumn("class_key", F.lit("person"))
    fused = per.join(roots, ["run_id", "cam_id", "track_id", "class_key"], "left").withColumn(
        "global_id", F.coalesce(F.concat_ws("|", "root_cam", "root_track"), F.concat_ws("|", "cam_id", "track_id")))
    fused = fused.withColumn("global_id", F.when(c("root_cam").isNull(), F.concat_ws("|", "cam_id", "track_id")).otherwise(
        F.concat_ws("|", "root_cam", "root_track")))
    return sweep.structure_counts(fused).drop("run_id")


def pairs_sql(limit: str, extra: str = "") -> str:
    return f"""cand AS (SELECT a.frame, a.det_ord AS det_ord_a, b.det_ord AS det_ord_b, a.cam_id AS cam_a, b.cam_id AS cam_b,
 a.track_id AS ta, b.track_id AS tb, replace(a.class_name, 'personne', 'person') AS k,
 sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m) + (a.y_m-b.y_m)*(a.y_m-b.y_m)) AS d
 FROM det a JOIN cam_overlaps o ON a.cam_id = o.cam_a JOIN det b ON b.cam_id = o.cam_b AND a.frame = b.frame
 AND a.class_name = b.class_name
 WHERE sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m) + (a.y_m-b.y_m)*(a.y_m-b.y_m)) < {limit} {extra})"""


MUTUAL_SQL = """mutual AS (SELECT * FROM (SELECT *,
 row_number() OVER (PARTITION BY frame, det_ord_a, cam_b ORDER BY d, det_ord_b) AS ra,
 row_number() OVER (PARTITION BY frame, det_ord_b, cam_a ORDER BY d, det_ord_a) AS rb FROM cand) q WHERE ra = 1 AND rb = 1)"""
BASE = f"{DET_SQL}, {OVERLAP_SQL}"


def _node(cam, track):
    return f"{cam} || '|' || lpad(CAST({track} AS VARCHAR), 3, '0') || '|' || k"


def _parts(column, names):
    return (f"split_part({column}, '|', 1) AS {names[0]}, CAST(split_part({column}, '|', 2) AS BIGINT) AS {names[1]}, "
            f"split_part({column}, '|', 3) AS {names[2]}")


COMPONENT_SQL = f"""WITH RECURSIVE {BASE}, {pairs_sql('1.0')}, {MUTUAL_SQL},
 links AS (SELECT frame, {_node('cam_a', 'ta')} AS u, {_node('cam_b', 'tb')} AS v FROM mutual),
 e AS (SELECT * FROM links UNION SELECT frame, v, u FROM links),
 reach AS (SELECT frame, u, u AS v FROM e UNION SELECT r.frame, r.u, e.v FROM reach r JOIN e ON e.frame = r.frame AND e.u = r.v)
 SELECT frame, {_parts('u', ['cam_id', 'track_id', 'class_key'])}, {_parts('m', ['comp_cam', 'comp_track', 'comp_class'])}
 FROM (SELECT frame, u, min(v) AS m FROM reach GROUP BY frame, u) q"""
# Every one-to-one assignment of the smaller side of a block, row by row.
PAIRING_SQL = f"""{BASE}, p AS (SELECT frame, cam_id, track_id, replace(class_name, 'personne', 'person') AS k, x_m, y_m,
  row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY frame, cam_id, class_name) AS n FROM det
  WINDOW w AS (PARTITION BY frame, cam_id, class_name ORDER BY det_ord)),
 e AS (SELECT a.frame, cam_a, cam_b, a.k, least(a.n, b.n) AS n, CASE WHEN a.n <= b.n THEN a.i ELSE b.i END AS r,
  CASE WHEN a.n <= b.n THEN b.i ELSE a.i END AS col, a.n > b.n AS flip, a.track_id AS ta, b.track_id AS tb, sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m) + (a.y_m-b.y_m)*(a.y_m-b.y_m)) AS d
  FROM p a JOIN cam_overlaps o ON a.cam_id = o.cam_a JOIN p b ON b.cam_id = o.cam_b AND a.frame = b.frame AND a.k = b.k),
 s AS (SELECT DISTINCT frame, cam_a, cam_b, k, n, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS cost,
   CAST([] AS BIGINT[]) AS cols FROM e
  UNION ALL SELECT s.frame, s.cam_a, s.cam_b, s.k, s.n, s.r + 1, s.used + (CAST(1 AS BIGINT) << e.col), s.cost + e.d,
   list_append(s.cols, e.col) FROM s JOIN e
  ON s.frame = e.frame AND s.cam_a = e.cam_a AND s.cam_b = e.cam_b AND s.k = e.k AND s.r = e.r
  WHERE (s.used >> e.col) % 2 = 0)"""
BEST_SQL = f"""{PAIRING_SQL}, best AS (SELECT frame, cam_a, cam_b, k, unnest(range(0, n)) AS r, unnest(cols) AS col FROM (
  SELECT frame, cam_a, cam_b, k, n, arg_min(cols, (cost, cols)) AS cols FROM s WHERE r = n GROUP BY frame, cam_a, cam_b, k, n) q),
 opt AS (SELECT e.* FROM best JOIN e ON e.frame = best.frame AND e.cam_a = best.cam_a AND e.cam_b = best.cam_b AND e.k = best.k
  AND e.r = best.r AND e.col = best.col), kdet AS (SELECT *, replace(class_name, 'personne', 'person') AS k FROM det)"""
# The registry as it is defined: frame by frame, with what every node holds in a map.


def registry_sql(links: str, dets: str = "kdet", tag: str = "") -> str:
    """CTEs up to ``gdet{tag}``: the detections ``dets`` with sticky ids over ``links`` (frame, cam_a, ta, cam_b, tb, k)."""
    return f"""links{tag} AS (SELECT frame, {_node('cam_a', 'ta')} AS u, {_node('cam_b', 'tb')} AS v FROM {links}),
 edge{tag} AS (SELECT * FROM links{tag} UNION SELECT frame, v, u FROM links{tag}),
 reach{tag} AS (SELECT frame, u, u AS v FROM edge{tag} UNION SELECT r.frame, r.u, e.v FROM reach{tag} r JOIN edge{tag} e
  ON e.frame = r.frame AND e.u = r.v),
 comp{tag} AS (SELECT frame, u, min(v) AS m FROM reach{tag} GROUP BY frame, u),
 node{tag} AS (SELECT frame, {_node('cam_id', 'track_id')} AS n, min(det_ord) AS o FROM {dets} GROUP BY 1, 2),
 grp{tag} AS (SELECT node{tag}.frame, coalesce(m, n) AS c, list(n) AS nodes, min(o) AS o FROM node{tag} LEFT JOIN comp{tag}
  ON comp{tag}.frame = node{tag}.frame AND comp{tag}.u = node{tag}.n GROUP BY 1, 2),
 fr{tag} AS (SELECT frame, row_number() OVER (ORDER BY frame) AS ord, list(nodes ORDER BY o) AS comps FROM grp{tag} GROUP BY frame),
 walk{tag} AS (SELECT CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS top, MAP(CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])) AS state,
  CAST([] AS STRUCT(n VARCHAR, gid BIGINT)[]) AS found
  UNION ALL SELECT ord + 1, top + len(list_filter(known, lambda x: x IS NULL)), map_concat(state, map_from_entries(list_transform(got,
   lambda x: struct_pack(k := x.n, v := x.gid)))), got FROM (
   SELECT *, flatten(list_transform(comps, lambda c, i: list_transform(c, lambda x: struct_pack(n := x, gid := gids[i])))) AS got FROM (
   SELECT *, list_transform(known, lambda x, i: coalesce(x, top + len(list_filter(known[1:i], lambda y: y IS NULL)))) AS gids FROM (
   SELECT w.ord, w.top, w.state, f.comps, list_transform(f.comps, lambda c: list_min(list_filter(list_transform(c,
    lambda x: map_extract_value(w.state, x)), lambda x: x IS NOT NULL))) AS known FROM walk{tag} w JOIN fr{tag} f ON f.ord = w.ord + 1) a) b) d),
 ids{tag} AS (SELECT frame, x.n AS n, x.gid AS gid FROM (SELECT frame, unnest(found) AS x FROM walk{tag} JOIN fr{tag} USING (ord)) q),
 gdet{tag} AS (SELECT q.*, gid AS global_id FROM {dets} q JOIN ids{tag} ON ids{tag}.frame = q.frame AND ids{tag}.n = {_node('cam_id', 'track_id')})"""


def _sweep_sql(select: str) -> str:
    """``select`` over ``gdet{t}`` for each threshold, persons only, on the optimal pairing."""
    ctes = [registry_sql(f"(SELECT * FROM opt WHERE d < {t / 100.0})", "person", str(t)) for t in SWEEP_LIMITS]
    return f"WITH RECURSIVE {BEST_SQL}, person AS (SELECT * FROM kdet WHERE class_id = 11), " + ", ".join(ctes) + " " + " UNION ALL ".join(
        select.format(t=t) for t in SWEEP_LIMITS)


IDS_SQL = f"""{BASE}, {pairs_sql('1.0')}, {MUTUAL_SQL}, kdet AS (SELECT *, replace(class_name, 'personne', 'person') AS k FROM det),
 {registry_sql('mutual')}"""
EXACT_IDS_SQL = f"{BEST_SQL}, {registry_sql('(SELECT * FROM opt WHERE d < 1.0)')}"
OPERATIONAL_SQL = """SELECT CAST({t} AS BIGINT) AS threshold_cm, count(DISTINCT frame) AS frames, (SELECT count(*) FROM (SELECT frame, global_id
 FROM gdet{t} GROUP BY frame, global_id HAVING count(DISTINCT cam_id) >= 2) x) AS predicted_links, count(DISTINCT global_id) AS
 unique_global_ids FROM gdet{t}"""
TRUTH_SWEEP_SQL = """SELECT *, round_even(tp/CAST(tp+fp AS DOUBLE), 4) AS "precision", round_even(tp/CAST(tp+fn AS DOUBLE), 4) AS recall,
 round_even(2.0E0*tp/CAST(2*tp+fp+fn AS DOUBLE), 4) AS f1, round_even(coalesce(fp/nullif(CAST(fp+tn AS DOUBLE), 0), 0), 4) AS false_match_rate,
 round_even(coalesce(fn/nullif(CAST(tp+fn AS DOUBLE), 0), 0), 4) AS missed_match_rate FROM (
 SELECT CAST({t} AS BIGINT) AS threshold_cm, (SELECT count(DISTINCT frame) FROM gdet{t}) AS frames,
 (SELECT count(DISTINCT global_id) FROM gdet{t}) AS unique_global_ids, count(*) FILTER (WHERE pl) AS predicted_links,
 count(*) FILTER (WHERE tl) AS truth_links, count(*) FILTER (WHERE pl AND tl) AS tp, count(*) FILTER (WHERE pl AND NOT tl) AS fp,
 count(*) FILTER (WHERE NOT pl AND tl) AS fn, count(*) FILTER (WHERE NOT pl AND NOT tl) AS tn FROM (
 SELECT a.global_id = b.global_id AS pl, a.t <> '' AND a.t = b.t AS tl FROM (SELECT *, CASE WHEN track_id % 12 = 5 THEN '' ELSE
 CAST(track_id % 12 AS VARCHAR) END AS t FROM gdet{t}) a JOIN (SELECT *, CASE WHEN track_id % 12 = 5 THEN '' ELSE
 CAST(track_id % 12 AS VARCHAR) END AS t FROM gdet{t}) b ON a.frame = b.frame AND a.det_ord < b.det_ord AND a.cam_id <> b.cam_id) q) z"""
TRANSITIVE_SQL = f"""WITH RECURSIVE {BASE}, {pairs_sql('0.5')}, {MUTUAL_SQL},
 links AS (SELECT DISTINCT {_node('cam_a', 'ta')} AS u, {_node('cam_b', 'tb')} AS v FROM mutual),
 e AS (SELECT * FROM links UNION SELECT v, u FROM links),
 reach AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
 SELECT {_parts('u', ['cam_id', 'track_id', 'class_key'])}, {_parts('m', ['root_cam', 'root_track', 'root_class'])}
 FROM (SELECT u, min(v) AS m FROM reach GROUP BY u) q"""


def _mutual_sweep_sql() -> str:
    ctes, selects = [], []
    for t in SWEEP_LIMITS:
        ctes.append(f"cand{t} AS (SELECT * FROM cand WHERE d < {t / 100.0})")
        ctes.append(MUTUAL_SQL.replace("mutual AS", f"mutual{t} AS").replace("FROM cand)", f"FROM cand{t})"))
        ctes.append(f"e{t} AS (SELECT {_node('cam_a', 'ta')} AS u, {_node('cam_b', 'tb')} AS v FROM mutual{t} UNION "
                    f"SELECT {_node('cam_b', 'tb')}, {_node('cam_a', 'ta')} FROM mutual{t})")
        ctes.append(f"reach{t} AS (SELECT u, u AS v FROM e{t} UNION SELECT r.u, e.v FROM reach{t} r JOIN e{t} e ON e.u = r.v)")
        ctes.append(f"g{t} AS (SELECT p.frame, p.cam_id, coalesce(m, p.n) AS gid FROM (SELECT frame, cam_id, "
                    f"cam_id || '|' || lpad(CAST(track_id AS VARCHAR), 3, '0') || '|person' AS n FROM det "
                    f"WHERE class_name = 'personne') p LEFT JOIN (SELECT u, min(v) AS m FROM reach{t} GROUP BY u) r ON r.u = p.n)")
        selects.append(f"SELECT CAST({t} AS BIGINT) AS threshold_cm, count(DISTINCT frame) AS frames, (SELECT count(*) FROM "
                       f"(SELECT frame, gid FROM g{t} GROUP BY frame, gid HAVING count(DISTINCT cam_id) >= 2) x) AS "
                       f"predicted_links, count(DISTINCT gid) AS unique_global_ids FROM g{t}")
    pairs = pairs_sql("2.0", "AND a.class_name = 'personne'")
    return f"WITH RECURSIVE {BASE}, {pairs}, " + ", ".join(ctes) + " " + " UNION ALL ".join(selects)


QUERIES = {
    "candidate_pairs": (candidate_pairs, f"""WITH {BASE}, {pairs_sql('1.0')} SELECT frame, det_ord_a, det_ord_b,
      round_even(d, 6) AS distance_m FROM cand"""),
    "optimal_links": (optimal_links, f"""WITH RECURSIVE {BEST_SQL} SELECT frame, cam_a, ta AS track_id_a, cam_b, tb AS track_id_b,
      k AS class_key_a, d AS distance_m FROM opt WHERE d < 1.0"""),
    "mutual_nearest_links": (mutual_nearest_links, f"""WITH {BASE}, {pairs_sql('1.0')}, {MUTUAL_SQL}
      SELECT frame, det_ord_a, det_ord_b, round_even(d, 6) AS distance_m FROM mutual"""),
    "frame_components": (frame_components, COMPONENT_SQL),
    "global_ids": (global_ids, f"""WITH RECURSIVE {BEST_SQL}, {registry_sql('(SELECT * FROM opt WHERE d < 1.0)')}
      SELECT frame, cam_id, track_id, k AS class_key, global_id FROM gdet"""),
    "transitive_ids": (transitive_ids, TRANSITIVE_SQL),
    "fusion_links": (fusion_links, f"""WITH {GID_SQL} SELECT a.frame, a.global_id, a.cam_id AS cam_a, a.track_id AS track_a,
      a.class_name AS class_a, b.cam_id AS cam_b, b.track_id AS track_b, b.class_name AS class_b,
      round_even(abs(a.ts_s-b.ts_s)*1000.0E0, 3) AS time_delta_ms,
      round_even(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)), 6) AS distance_m
      FROM gdet a JOIN gdet b ON a.frame = b.frame AND a.global_id = b.global_id AND a.cam_id < b.cam_id"""),
    "track_stability": (track_stability, f"""WITH {GID_SQL}, l AS (SELECT *, lag(global_id) OVER (PARTITION BY cam_id,
      track_id ORDER BY frame, det_ord) AS p FROM gdet) SELECT cam_id, track_id, min(frame) AS first_frame, max(frame) AS
      last_frame, count(*) AS age, count(*) FILTER (WHERE p <> global_id) AS global_id_switches,
      array_to_string(list_sort(list_distinct(list(global_id))), '+') AS global_ids FROM l GROUP BY cam_id, track_id"""),
    "solo_entities": (solo_entities, f"""WITH {GID_SQL} SELECT frame, global_id, min(cam_id) AS cam_id, count(*) AS detections
      FROM gdet GROUP BY frame, global_id HAVING count(DISTINCT cam_id) = 1"""),
    "pair_quality": (pair_quality, f"""WITH {DET_SQL}, p AS (SELECT *, track_id % 9 AS g, CASE WHEN track_id % 12 = 5 THEN ''
      ELSE CAST(track_id % 12 AS VARCHAR) END AS t FROM det WHERE class_name = 'personne'),
      q AS (SELECT a.g = b.g AS pl, a.t <> '' AND a.t = b.t AS tl FROM p a JOIN p b ON a.frame = b.frame AND
       a.det_ord < b.det_ord AND a.cam_id <> b.cam_id),
      s AS (SELECT count(*) FILTER (WHERE pl) AS predicted_links, count(*) FILTER (WHERE tl) AS truth_links,
       count(*) FILTER (WHERE pl AND tl) AS tp, count(*) FILTER (WHERE pl AND NOT tl) AS fp,
       count(*) FILTER (WHERE NOT pl AND tl) AS fn, count(*) FILTER (WHERE NOT pl AND NOT tl) AS tn FROM q)
      SELECT *, round_even(tp/CAST(tp+fp AS DOUBLE), 4) AS "precision", round_even(tp/CAST(tp+fn AS DOUBLE), 4) AS recall,
       round_even(2.0E0*tp/CAST(2*tp+fp+fn AS DOUBLE), 4) AS f1 FROM s"""),
    "optimal_link_costs": (optimal_link_costs, f"""WITH RECURSIVE {PAIRING_SQL} SELECT frame, cam_a, cam_b, k AS class_key, n AS links,
      round_even(min(cost), 6) AS total_m FROM s WHERE r = n GROUP BY frame, cam_a, cam_b, k, n"""),
    "global_ids_mutual": (global_ids_mutual, f"WITH RECURSIVE {IDS_SQL} SELECT frame, cam_id, track_id, k AS class_key, global_id FROM gdet"),
    "threshold_sweep_truth": (threshold_sweep_truth, _sweep_sql(TRUTH_SWEEP_SQL)),
    "threshold_sweep_operational": (threshold_sweep_operational, _sweep_sql(OPERATIONAL_SQL)),
    "threshold_sweep_mutual": (threshold_sweep_mutual, _mutual_sweep_sql()),
}
