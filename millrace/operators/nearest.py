"""The nearest of very many places, by descending a tree of boxes in joins.

The places are put in the order of a space-filling curve and numbered; every ``FAN`` in a row make a leaf,
every ``FAN`` leaves a node, and so on up to one root. Each node knows the box around its places. All points
descend together, one level a join: of the boxes under a node that a point still looks at, those stay whose
nearest corner is not farther than some place that is known to be there. At a leaf the places themselves are
compared. Points on their way to a node travel in packs, so its children are copied once a pack and not once a
point. No task and no driver holds more than one node's children beside its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import with_position
from millrace.session import cut_lineage

FAN = 64
_CURVE_BITS = 30
# The masks that spread 32 bits over the even bits of 64.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _curve(x: Column, y: Column, box) -> Column:
    """Place on a Z-shaped curve through the box."""

    def spread(v: Column, low: float, high: float) -> Column:
        scale = (1 << _CURVE_BITS) - 1
        out = F.floor((v / 2 - low / 2) / ((high / 2 - low / 2) or 1.0) * scale).cast("bigint")
        for shift, mask in _SPREAD:
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(x, box["x0"], box["x1"]).bitwiseOR(F.shiftleft(spread(y, box["y0"], box["y1"]), 1))


def _corners(boxes, px, py, linear: bool):
    """Distance of the nearest corner of (x0, x1, y0, y1) from points, and one that some place inside does not exceed.

    A box is tight, so each of its sides holds a place: one lies on the nearer side, not farther along it than
    the farther corner.
    """
    import numpy as np

    x0, x1, y0, y1 = boxes
    left, right = np.abs(px - x0), np.abs(px - x1)
    near, side, far = np.maximum(0.0, np.maximum(x0 - px, px - x1)), np.minimum(left, right), np.maximum(left, right)
    if linear:
        return near * near + (py - y1), np.minimum(side * side + (py - y0), far * far + (py - y1))
    low, high = np.abs(py - y0), np.abs(py - y1)
    near_y, side_y, far_y = np.maximum(0.0, np.maximum(y0 - py, py - y1)), np.minimum(low, high), np.maximum(low, high)
    return near * near + near_y * near_y, np.minimum(side * side + far_y * far_y, far * far + side_y * side_y)


#: Points that travel together to a node, so that its children are copied once for all of them.
_PACK = 256
#: Points looked at before what was found is handed on.
_HELD = 1 << 16
_PACKED = "node long, px array<double>, py array<double>, bound array<double>"
_BOX = ("x0", "x1", "y0", "y1")


def _packs(node, px, py, bound):
    """A record batch of packs, from the nodes that points look at."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(node, kind="stable")
    node = node[order]
    starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    within = np.arange(len(node)) - np.repeat(starts, np.diff(starts, append=len(node)))
    starts = np.flatnonzero(within % _PACK == 0)
    offsets = pa.array(np.append(starts, len(node)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (px, py, bound)]
    return pa.RecordBatch.from_arrays([pa.array(node[starts]), *lists], names=["node", "px", "py", "bound"])


def _under_root(asked: DataFrame, root: list, linear: bool) -> DataFrame:
    """The boxes below the root, at most ``FAN``, that each point looks at."""

    def run(batches):
        import numpy as np

        boxes = [np.array([r[c] for r in root])[None, :] for c in _BOX]
        child = np.array([r["child"] for r in root], np.int64)
        for batch in batches:
            px, py = (batch.column(c).to_numpy() for c in ("px", "py"))
            near, far = _corners(boxes, px[:, None], py[:, None], linear)
            bound = far.min(axis=1)
            row, which = np.nonzero(near <= bound[:, None])
            yield _packs(child[which], px[row], py[row], bound[row])

    return asked.mapInArrow(run, _PACKED)


def _under_nodes(met: DataFrame, linear: bool, leaf: bool) -> DataFrame:
    """What is below the nodes that points look at: boxes, or of a leaf the closest place."""
    kind = "px double, py double, distance double, id long" if leaf else _PACKED

    def closest(px, py, bound, field):
        ids = field("id")
        # By id, so that the first of the closest has the smallest.
        order = ids.argsort(kind="stable")
        dx, dy = px[:, None] - field("x")[order], py[:, None] - field("y")[order]
        distance = dx * dx + (dy if linear else dy * dy)
        at = distance.argmin(axis=1)
        return px, py, distance[range(len(at)), at], ids[order][at]

    def looked_at(px, py, bound, field):
        near, far = _corners([field(c)[None, :] for c in _BOX], px[:, None], py[:, None], linear)
        bound = bound.clip(max=far.min(axis=1))
        row, which = (near <= bound[:, None]).nonzero()
        return field("child")[which], px[row], py[row], bound[row]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def handed_on(parts):
            columns = [np.concatenate(c) for c in zip(*parts)]
            if not leaf:
                return _packs(*columns)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["px", "py", "distance", "id"])

        for batch in batches:
            under = batch.column("under")
            items, edges = under.values, under.offsets.to_numpy()
            names = ("id", "x", "y") if leaf else ("child", *_BOX)
            fields = {c: items.field(c).to_numpy(zero_copy_only=False) for c in names}
            points = [batch.column(c) for c in ("px", "py", "bound")]
            ends = points[0].offsets.to_numpy()
            values = [p.values.to_numpy(zero_copy_only=False) for p in points]
            parts, held = [], 0
            for i in range(batch.num_rows):
                mine, its = slice(ends[i], ends[i + 1]), slice(edges[i], edges[i + 1])
                found = (closest if leaf else looked_at)(*[v[mine] for v in values], lambda c: fields[c][its])
                parts.append(found)
                held += len(found[0])
                if held >= _HELD:
                    yield handed_on(parts)
                    parts, held = [], 0
            if held:
                yield handed_on(parts)

    return met.select("px", "py", "bound", "under").mapInArrow(run, kind)


def nearest_of_many(
    points: DataFrame, places: DataFrame, x: str, y: str, linear: bool = False, fan: int = FAN
) -> DataFrame:
    """``points`` with the id of, and distance to, the closest of ``places`` (id, x, y); the smallest id wins a tie.

    Distances are sums of squares; ``linear`` leaves the second difference as it is. Points without a finite
    place get none; places without one are never the closest.
    """
    usable = places.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    usable = usable.where(_finite(F.col("x")) & _finite(F.col("y"))).groupBy("x", "y").agg(F.min("id").alias("id"))
    box = usable.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not box["n"]:
        return points.withColumns({"centroid_id": F.lit(None).cast("bigint"), "distance": F.lit(None).cast("double")})
    on_curve = usable.withColumn("curve", _curve(F.col("x"), F.col("y"), box))
    numbered = cut_lineage(with_position(on_curve, [], ["curve", "x", "y"], "no"))
    depth = 1
    while fan**depth < box["n"]:
        depth += 1

    def node(level: int) -> Column:
        return F.floor((F.col("no") - 1) / F.lit(fan**level))

    def boxes(level: int) -> DataFrame:
        return numbered.groupBy(node(level).alias("child")).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )

    def children(level: int) -> DataFrame:
        """(node, under): the boxes one level below, or at level 1 the places."""
        if level == 1:
            return numbered.groupBy(node(1).alias("node")).agg(F.collect_list(F.struct("id", "x", "y")).alias("under"))
        item = F.struct("child", *_BOX)
        above = F.floor(F.col("child") / F.lit(fan)).alias("node")
        return boxes(level - 1).groupBy(above).agg(F.collect_list(item).alias("under"))

    named = points.withColumns({"px": F.col(x).cast("double"), "py": F.col(y).cast("double")})
    asked = named.where(_finite(F.col("px")) & _finite(F.col("py"))).select("px", "py").distinct()
    # Neighbours go down together, so that packs are full; the bytes are too few to tell how much work they are.
    along = [F.greatest(F.least(p, F.lit(box[b])), F.lit(box[a])) for p, a, b in (("px", "x0", "x1"), ("py", "y0", "y1"))]
    tasks, place = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["curve", "px", "py"]
    asked = asked.withColumn("curve", _curve(*along, box)).repartitionByRange(tasks, *place).sortWithinPartitions(*place)
    # With a single leaf the root has that one box below it.
    now = _under_root(asked, boxes(max(1, depth - 1)).collect(), linear)
    for level in range(max(1, depth - 1), 0, -1):
        now = _under_nodes(now.join(children(level), "node"), linear, level == 1)
    best = now.groupBy("px", "py").agg(F.min(F.struct("distance", "id")).alias("best"))
    return named.join(best, ["px", "py"], "left").select(
        *points.columns, F.col("best.id").alias("centroid_id"), F.col("best.distance").alias("distance")
    )
