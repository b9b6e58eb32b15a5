"""Polygons from line segments of a map."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Ends of segments that are nearer than this in both coordinates are one.
TOLERANCE = 1e-7


def _nodes(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """A number for each point; points within the tolerance, or joined by others that are, share one."""
    leader = list(range(len(points)))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    grid: dict[tuple[int, int], dict[tuple[float, float], int]] = defaultdict(dict)
    for i, (x, y) in enumerate(points):
        cx, cy = floor(x / tolerance), floor(y / tolerance)
        for near in ((cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            for (px, py), j in grid[near].items() if near in grid else ():
                if abs(px - x) < tolerance and abs(py - y) < tolerance:
                    a, b = find(i), find(j)
                    leader[max(a, b)] = min(a, b)
        grid[cx, cy].setdefault((x, y), i)
    return [find(i) for i in range(len(points))]


def join_ends(segments: list[list[tuple[float, float]]], tolerance: float = TOLERANCE) -> list[list[tuple[float, float]]]:
    """Closed rings from segments that meet at their ends, in any order and direction; what doesn't close is left out.

    Ends are nodes of a graph. A walk starts with the first segment that is left and takes the first that is left at the
    node that it has come to; when it is at its start it is a ring. Each segment is walked once, so the work is in
    proportion to the segments.
    """
    parts = [list(s) for s in segments if len(s) > 1]
    ends = _nodes([p for s in parts for p in (s[0], s[-1])], tolerance)
    at: dict[int, list[int]] = defaultdict(list)
    for i in range(len(parts) - 1, -1, -1):
        for node in {ends[2 * i], ends[2 * i + 1]}:
            at[node].append(i)
    used = [False] * len(parts)
    rings = []
    for i, part in enumerate(parts):
        if used[i]:
            continue
        used[i] = True
        ring, start, now = list(part), ends[2 * i], ends[2 * i + 1]
        while now != start:
            left = at[now]
            while left and used[left[-1]]:
                left.pop()
            if not left:
                break
            j = left.pop()
            used[j] = True
            ahead = ends[2 * j] == now
            ring += parts[j][1:] if ahead else parts[j][-2::-1]
            now = ends[2 * j + 1] if ahead else ends[2 * j]
        if now == start and len(ring) > 3:
            rings.append([*ring[:-1], ring[0]])
    return rings


_SCHEMA = "zone string, role string, ring array<struct<lat: double, lon: double>>"


def assemble(segments: DataFrame) -> DataFrame:
    """zone, role and ring (points lat, lon, closed) of the rings of each zone and role.

    ``segments`` has zone, role ('outer' or 'inner'), ord and points (arrays of lat, lon). A zone's segments are few: a
    task reads its zones one after another and holds one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, out = None, [], []

        def close() -> None:
            out.extend((*key, [{"lat": a, "lon": b} for a, b in ring]) for ring in join_ends(parts))

        def batch() -> pa.RecordBatch:
            zone, role, ring = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            point = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
            return pa.RecordBatch.from_arrays([pa.array(zone, pa.string()), pa.array(role, pa.string()), pa.array(ring, pa.list_(point))], ["zone", "role", "ring"])

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("zone", "role", "points"))
            for zone, role, points in zip(*columns, strict=True):
                if (zone, role) != key:
                    if key:
                        close()
                    key, parts = (zone, role), []
                parts.append([(p["lat"], p["lon"]) for p in points])
            if len(out) > 1000:
                yield batch()
                out.clear()
        if key:
            close()
        yield batch()

    rows = segments.select("zone", "role", "ord", "points").repartition("zone", "role").sortWithinPartitions("zone", "role", "ord")
    return rows.mapInArrow(build, _SCHEMA)
