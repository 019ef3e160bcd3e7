"""Live identities and alerts: a chain of stateful operators from raw detections to alerts, in one streaming query.

1. *Frame barrier*, keyed by (run, room, frame): detections of a frame wait in list state, whatever micro-batches they come in,
   until the watermark has passed the frame's end. Then the frame's links are solved and its detections leave as linked groups.
2. *Registry*, keyed by (run, room): frames that closed come in order, because each micro-batch closes all frames up to its
   watermark. A group takes the smallest number its tracks hold or a new one. A track unseen for ``forget_s`` counts as new and is dropped.
3. *Zones*, a stream-static join by floor cells; no state.
4. *Alerts*, keyed by (run, room): votes of a frame, then edges against what was active in the previous processed frame: people
   entering and leaving zones, objects appearing and escalating.

A frame that closes after a later one of its room (a frame longer than the barrier waits) reads the ids of known tracks, but
changes no identity and raises no alert. Rows behind the watermark are dropped by Spark.

A detection without camera is a frame marker: it says that the frame was processed, in every room. Frames without detections
need one, else they are no processed frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sightgrid.functions import names
from sightgrid.functions.assignment import solve_batch
from sightgrid.functions.geometry import point_in_polygon
from sightgrid.operators.alerts import ALERT_COLUMNS, CELL_M, AlertRules
from sightgrid.operators.fusion import OUT_OF_REACH
from sightgrid.sources.site import Site
from sightgrid.streaming.stateful import use_rocksdb

DETECTION = ("frame bigint, det_ord bigint, cam_id string, track_id bigint, class_key string, class_id bigint, class_name string, "
             "confidence double, ts_s double, x_m double, y_m double")
_FIELDS = [part.split(" ")[0] for part in DETECTION.split(", ")]


def _table(rows: list[tuple], ddl: str) -> pd.DataFrame:
    kinds = {"bigint": "Int64", "double": "float64", "boolean": "boolean"}
    fields = [part.split(" ") for part in ddl.split(", ")]
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=kinds.get(kind, object)) for i, (name, kind) in enumerate(fields)})


_WHOLE = {"frame", "det_ord", "track_id", "class_id", "group", "ord", "global_id"}


def _plain(value, whole: bool):
    """A value as Python's own, missing ones as None; a column with missing whole numbers comes as floats."""
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return int(value) if whole else value.item() if isinstance(value, np.generic) else value


def _rows(parts: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    whole = [c in _WHOLE for c in columns]
    return [tuple(map(_plain, r, whole)) for part in parts for r in part[columns].astype(object).itertuples(index=False, name=None)]


def linked_groups(rows: list[tuple], pairs: list[tuple[str, str]], limit: float, window_s: float) -> list[list[int]]:
    """Positions of a frame's detections, by linked group; groups in order of their first detection.

    Each pair of overlapping cameras is paired at least total distance within a class; the limit applies afterwards.
    """
    at = {name: i for i, name in enumerate(_FIELDS)}
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    blocks: dict[tuple, list[int]] = {}
    seen: dict[tuple, int] = {}
    for i, r in enumerate(rows):
        j = seen.setdefault((r[at["cam_id"]], r[at["track_id"]], r[at["class_key"]]), i)
        parent[i] = j  # repeated sightings of one track
        if r[at["x_m"]] is not None and r[at["y_m"]] is not None:
            blocks.setdefault((r[at["cam_id"]], r[at["class_key"]]), []).append(i)
    sides, costs = [], []
    for cam_a, cam_b in pairs:
        for key in sorted({k for cam, k in blocks if cam == cam_a and (cam_b, k) in blocks}):
            a, b = blocks[cam_a, key], blocks[cam_b, key]
            xa, ya, ta, xb, yb, tb = (np.array([rows[i][at[c]] for i in side], float) for side in (a, b) for c in ("x_m", "y_m", "ts_s"))
            cost = np.sqrt((xa[:, None] - xb) ** 2 + (ya[:, None] - yb) ** 2)
            cost[np.abs(ta[:, None] - tb) > window_s] = OUT_OF_REACH
            sides.append((a, b))
            costs.append(cost)
    for (a, b), cost, found in zip(sides, costs, solve_batch(costs)):
        for i, j in found:
            if cost[i, j] < limit:
                parent[top(a[i])] = top(b[j])
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


class _Barrier(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", DETECTION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = not self.waiting.exists()
        ends = None
        for part in rows:  # a chunk at a time: nothing but the state holds a whole frame
            if len(part):
                ends = min(int(part["ends_ms"].min()), ends or 1 << 62)
                self.waiting.appendList(_rows([part], _FIELDS))
        if first and ends is not None:
            self.handle.registerTimer(ends)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = _FIELDS.index("det_ord")
        rows = sorted((tuple(r) for r in self.waiting.get() if r[_FIELDS.index("cam_id")] is not None), key=lambda r: r[at])
        self.waiting.clear()
        out = [(key[0], key[1], -1, key[2], *[-1 if f in _WHOLE else None for f in _FIELDS[1:]])]  # the frame itself
        for number, members in enumerate(linked_groups(rows, self.pairs.get(key[1], []), self.limit, self.window_s)):
            out += [(key[0], key[1], number, *rows[i]) for i in members]
        yield _table(out, self.ddl)

    def close(self) -> None:
        pass

    ddl = "run_id string, room_id string, group bigint, " + DETECTION


class _Registry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "node string", "gid bigint, seen_s double")
        self.at = handle.getValueState("at", "next bigint, last_frame bigint, ord bigint, sweep_s double")

    def _sweep(self, now: float) -> None:
        old = [k for k, v in self.held.iterator() if v[1] < now - self.forget_s]
        for k in old:
            self.held.removeKey(tuple(k))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, last, ord_, sweep = self.at.get() if self.at.exists() else (1, None, -1, None)
        columns = ["group", *_FIELDS]
        at = {c: i for i, c in enumerate(columns)}
        cells = sorted(_rows(rows, columns), key=lambda r: (r[at["frame"]], r[at["group"]], r[at["det_ord"]] or 0))
        known: dict[str, tuple[int, float]] = {}  # what this micro-batch has read or changed

        def held(node: str, now: float):
            if node not in known and self.held.containsKey((node,)):
                known[node] = tuple(self.held.getValue((node,)))
            value = known.get(node)
            return value[0] if value and value[1] >= now - self.forget_s else None

        out, changed, k = [], set(), 0
        while k < len(cells):
            frame, group = cells[k][at["frame"]], cells[k][at["group"]]
            end = k
            while end < len(cells) and cells[end][at["frame"]] == frame and cells[end][at["group"]] == group:
                end += 1
            late = last is not None and frame < last or group >= 0 and frame != last
            if group < 0:
                if not late and frame != last:
                    last, ord_ = frame, ord_ + 1
                out += [(key[0], key[1], ord_ if not late else -1, -1, *r[1:]) for r in cells[k:end]]
            else:
                members = cells[k:end]
                nodes = ["\x01".join(map(str, (r[at["cam_id"]], r[at["track_id"]], r[at["class_key"]]))) for r in members]
                gids = [held(n, r[at["ts_s"]] or 0.0) for n, r in zip(nodes, members)]
                if late:
                    out += [(key[0], key[1], -1, g, *r[1:]) for g, r in zip(gids, members)]
                else:
                    gid = min((g for g in gids if g is not None), default=nxt)
                    nxt += gid == nxt
                    for n, r in zip(nodes, members):
                        known[n] = (gid, r[at["ts_s"]] or 0.0)
                        changed.add(n)
                        out.append((key[0], key[1], ord_, gid, *r[1:]))
            k = end
        for n in changed:
            self.held.updateValue((n,), known[n])
        now = max([r[at["ts_s"]] or 0.0 for r in cells], default=0.0)
        if sweep is None or now >= sweep:  # once in a while, so that a sweep costs no more than what was added since
            if sweep is not None:
                self._sweep(now)
            sweep = now + self.forget_s
        self.at.update((nxt, last, ord_, sweep))
        yield _table(out, self.ddl)

    def close(self) -> None:
        pass

    ddl = "run_id string, room_id string, ord bigint, global_id bigint, " + DETECTION


def live_ids(dets: DataFrame, site: Site, ends: Column, max_distance: float = 1.0, window_s: float = 0.5,
             watermark: str = "10 seconds", forget_s: float = 86_400.0) -> DataFrame:
    """``dets`` with ``room_id``, ``ord`` (dense number of the processed frame in its room) and ``global_id``.

    ``ends`` is the time (a timestamp column) by which a frame is complete. ``dets`` has an ``event_time`` and the columns
    of a detection. Ids are local to the room. Each closed frame also gives one row without camera, the frame itself.
    """
    use_rocksdb(dets.sparkSession)
    pairs: dict[str, list] = {}
    rooms: dict[str, str] = {}
    for room, a, b in site.overlaps:
        pairs.setdefault(room, []).append((a, b))
        rooms.setdefault(a, room)
        rooms.setdefault(b, room)
    for camera in site.cameras:
        rooms.setdefault(camera.cam_id, camera.room_id or camera.cam_id)
    of = F.create_map(*[F.lit(x) for kv in rooms.items() for x in kv])
    everywhere = F.array(*[F.lit(r) for r in sorted(set(rooms.values()))])
    placed = dets.withWatermark("event_time", watermark).withColumns({
        "class_key": names.class_key(F.col("class_name"), F.col("class_id")), "ends_ms": F.unix_millis(ends),
        "room_id": F.explode(F.when(F.col("cam_id").isNull(), everywhere).otherwise(
            F.array(F.coalesce(F.try_element_at(of, F.col("cam_id")), F.col("cam_id")))))})
    barrier = _Barrier()
    barrier.limit, barrier.window_s, barrier.pairs = max_distance, window_s, pairs
    closed = placed.select("run_id", "room_id", "ends_ms", "event_time", *_FIELDS).groupBy("run_id", "room_id", "frame").transformWithStateInPandas(
        statefulProcessor=barrier, outputStructType=StructType.fromDDL(_Barrier.ddl), outputMode="Append", timeMode="EventTime")
    registry = _Registry()
    registry.forget_s = forget_s
    return closed.groupBy("run_id", "room_id").transformWithStateInPandas(
        statefulProcessor=registry, outputStructType=StructType.fromDDL(_Registry.ddl), outputMode="Append", timeMode="None")


class _Alerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "kind string, gid bigint, name string", "frame bigint, level string")
        self.last = handle.getValueState("last", "ord bigint")

    @staticmethod
    def _best(rows: list[dict]) -> dict:
        return max(rows, key=lambda r: (r["confidence"], -r["det_ord"]))

    def _frame(self, rows: list[dict]) -> dict:
        """(kind, gid, name) -> (level, best observation, cameras) of one frame."""
        found: dict[tuple, list[dict]] = {}
        for r in rows:
            if r["cam_id"] is None or r["global_id"] is None:
                continue
            if r["person"]:
                if r["zone_id"] is not None:
                    found.setdefault(("zone", r["global_id"], r["zone_id"]), []).append(r)
            elif not r["allowed"] and r["x_m"] is not None:
                found.setdefault(("object", r["global_id"], r["object_key"]), []).append(r)
        out, rules = {}, self.rules
        for key, seen in found.items():
            if key[0] == "zone":
                cover = set(seen[0]["zone_cameras"])
                cameras = sorted({r["cam_id"] for r in seen} & cover)
                need = max(rules.zone_min_votes, math.ceil(len(cover) * rules.zone_min_ratio), 1)
                level = "confirmed" if len(cameras) >= need else None
            else:
                cameras = sorted({r["cam_id"] for r in seen})
                level = "confirmed" if len(cameras) >= rules.object_min_votes else "weak" if rules.emit_weak else None
            if level:
                out[key] = (level, {**self._best(seen), "confidence": max(r["confidence"] for r in seen),
                                    "class_name": min(seen, key=lambda r: r["det_ord"])["class_name"]}, cameras)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        active = {tuple(k): tuple(v) for k, v in self.active.iterator()}
        frames: dict[int, list[dict]] = {}
        for r in _rows(rows, self.columns):
            r = dict(zip(self.columns, r))
            if r["ord"] >= 0:
                frames.setdefault(r["ord"], []).append(r)
        out = []
        for ord_ in sorted(frames):
            frame = frames[ord_][0]["frame"]
            now = self._frame(frames[ord_])
            for k, (seen, level) in active.items():
                if k not in now and k[0] == "zone":
                    out.append((key[0], key[1], "exit", seen, ord_, None, k[1], k[2], None, level, None, None, None, None))
            for k, (level, best, cameras) in now.items():
                before = active.get(k, (None, None))[1]
                if before is None or k[0] == "object" and before not in (level, "confirmed"):
                    out.append((key[0], key[1], k[0], frame, ord_, best["ts_s"], k[1], k[2] if k[0] == "zone" else None,
                                "person" if k[0] == "zone" else best["class_name"], level, best["x_m"], best["y_m"], cameras,
                                best["confidence"]))
            active = {k: (frame, level) for k, (level, _, _) in now.items()}
            last = ord_
        self.active.clear()
        for k, v in active.items():
            self.active.updateValue(k, v)
        self.last.update((last,))
        yield _table(out, self.ddl)

    def close(self) -> None:
        pass

    ddl = ("run_id string, room_id string, kind string, frame bigint, ord bigint, ts_s double, global_id bigint, zone_id string, "
           "class_name string, alert_level string, x_m double, y_m double, cameras array<string>, confidence double")
    columns = ["ord", "global_id", *_FIELDS, "person", "allowed", "object_key", "zone_id", "zone_cameras"]


def live_edges(fused: DataFrame, site: Site, rules: AlertRules, cell: float = CELL_M) -> DataFrame:
    """Entries into zones (kind ``zone``), ends of stays (``exit``: last frame and the ``ord`` that noticed), objects (``object``).

    ``fused`` comes from ``live_ids``.
    """
    processor = _Alerts()
    processor.rules = rules
    person = names.is_person(F.col("class_id"), F.col("class_name"), list(rules.person_ids))
    cells = site.zone_cells(fused.sparkSession, cell).select("cell_x", "cell_y", "zone_id", "zone_cameras", "edges")
    rows = fused.withColumns({"person": person, "allowed": names.is_allowed_vehicle(F.col("class_name")),
                              "object_key": names.alert_class_key(F.col("class_name"))}).withColumns({
        "cell_x": F.when(F.col("person"), F.floor(F.col("x_m") / cell)), "cell_y": F.when(F.col("person"), F.floor(F.col("y_m") / cell))})
    rows = rows.join(cells, ["cell_x", "cell_y"], "left").where(
        F.col("zone_id").isNull() | point_in_polygon(F.col("edges"), F.col("x_m"), F.col("y_m")))
    return rows.select("run_id", "room_id", *_Alerts.columns).groupBy("run_id", "room_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(_Alerts.ddl), outputMode="Append", timeMode="None")


def as_alerts(edges: DataFrame) -> DataFrame:
    """Alerts of the columns that the batch operator gives, from ``live_edges``."""
    kind = F.when(F.col("kind") == "zone", "zone_violation_person").otherwise("forbidden_object")
    return edges.where("kind <> 'exit'").withColumn("alert_type", kind).withColumn("alert_id", names.alert_id(
        F.col("run_id"), F.col("alert_type"), F.col("global_id"), F.col("zone_id"), F.col("class_name"), F.col("frame")
    )).select(*ALERT_COLUMNS)
