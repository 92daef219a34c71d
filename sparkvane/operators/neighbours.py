"""Exact nearest rows within groups, without comparing all pairs.

Rows are cut into ranges that are compact in space. A search tree over the rows of a range finds the nearest rows of the same range; a row
then meets those other ranges only that its ball, as wide as its farthest neighbour so far, reaches. Ranges and trees only steer the work:
the result is exact for any of them. With many features most balls reach most ranges, and the work nears that of all pairs."""
import numpy as np
from pyspark.sql import functions as F

#: Rows of a leaf of the search tree, and what a bound computed in another way may be off, as a share.
LEAF, SLACK = 128, 1e-9
#: Features that cut space into ranges, and bits of each.
AXES, BITS = 3, 12
#: Pairs of ranges up to which their table is broadcast.
FEW_PAIRS = 10_000


def _tree(v, rows):
    """(low, high, rows, None) for a leaf, else (low, high, (feature, cut), two trees)."""
    x = v[rows]
    lo, hi = x.min(0), x.max(0)
    if len(rows) <= LEAF:
        return lo, hi, np.sort(rows), None
    axis, half = int(np.argmax(hi - lo)), len(rows) // 2
    o = np.argpartition(x[:, axis], half)
    return lo, hi, (axis, x[o[half], axis]), (_tree(v, rows[o[:half]]), _tree(v, rows[o[half:]]))


def _reached(q, lo, hi, limit):
    """Which rows of q have a part of the box within their limit, a squared distance."""
    gap = np.maximum(np.maximum(lo - q, q - hi), 0.0)
    return (gap * gap).sum(-1) * (1 - SLACK) <= limit


def nearest(q, q_key, v, v_key, k, limit):
    """(d, j): squared distances and numbers of the k rows of v that are nearest to each row of q by (distance, number), within its limit.

    Rows with the same key do not count; j is len(v) where there are fewer than k."""
    d, j, limit = np.full((len(q), k), np.inf), np.full((len(q), k), len(v)), limit.copy()

    def visit(node, rows):
        lo, hi, x, below = node
        rows = rows[_reached(q[rows], lo, hi, limit[rows])]
        if not len(rows):
            return
        if below is None:
            far = ((q[rows][:, None, :] - v[x][None, :, :]) ** 2).sum(2)
            own = q_key[rows][:, None] == v_key[x][None, :]
            far[own] = np.inf
            some = ((far <= limit[rows][:, None]) & ~own).any(1)
            rows, far, own = rows[some], far[some], own[some]
            ds, js = np.concatenate([d[rows], far], 1), np.concatenate([j[rows], np.where(own, len(v), x[None, :])], 1)
            o = np.lexsort((js, ds), axis=1)[:, :k]
            d[rows], j[rows] = np.take_along_axis(ds, o, 1), np.take_along_axis(js, o, 1)
            limit[rows] = np.minimum(limit[rows], d[rows, -1])
            return
        left = q[rows, x[0]] < x[1]
        for near, other, r in ((0, 1, rows[left]), (1, 0, rows[~left])):
            visit(below[near], r)
            visit(below[other], r)

    if len(q) and len(v):
        with np.errstate(over="ignore"):
            visit(_tree(v, np.arange(len(v))), np.arange(len(q)))
    return d, j


def _first_keys(v, key, k):
    """Row numbers in the order of keys, without rows of a vector beyond its first k + 1 keys: those are nobody's nearest."""
    o = np.lexsort((key, *v.T))
    new = np.r_[True, (v[o[1:]] != v[o[:-1]]).any(1)]
    place = np.cumsum(new | np.r_[True, key[o[1:]] != key[o[:-1]]])
    place -= place[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    keep = o[place <= k]
    return keep[np.argsort(key[keep], kind="stable")]


def _arrays(t, p):
    """Table in the order of keys, features as a matrix, and the place of each key among the distinct ones."""
    import pyarrow.compute as pc

    t = t.take(pc.sort_indices(t["key"])).combine_chunks()
    v = np.stack([t[f"f{i}"].to_numpy() for i in range(p)], 1)
    k = t["key"].combine_chunks()
    same = pc.fill_null(pc.equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False)
    return t, v, np.cumsum(np.r_[True, ~same]) - 1


def _near(d, j, keys, v):
    """Arrow list of (d, other, w) for each row."""
    import pyarrow as pa

    found = j < len(v)
    flat, ends = j[found], np.r_[0, np.cumsum(found.sum(1))].astype("int32")
    w = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype="int32") * v.shape[1], v[flat].ravel())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d[found]), keys.take(pa.array(flat)), w], ["d", "other", "w"]))


def _z_order(x, p):
    """A number that puts rows close in space near each other: the bits of their widest features in turn."""
    if p == 1:
        return F.lit(0)
    s = x.agg(*(f(F.col(f"f{i}")).alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev)))).first()
    axes = sorted(range(p), key=lambda i: -(s[f"s{i}"] or 0.0))[:AXES]
    step = 8 * (s[f"s{axes[0]}"] or 0.0) / 2**BITS
    if not (0 < step < np.inf and all(np.isfinite(s[f"m{i}"]) and np.isfinite(s[f"s{i}"]) for i in axes)):
        return F.lit(0)
    z = F.lit(0).cast("bigint")
    for at, i in enumerate(axes):
        c = F.greatest(F.lit(0.0), F.least(F.lit(2.0**BITS - 1), (F.col(f"f{i}") - s[f"m{i}"]) / step + 2 ** (BITS - 1))).cast("bigint")
        for b in range(BITS):
            z = z + F.shiftleft(F.shiftright(c, b).bitwiseAND(1), b * len(axes) + at)
    return z


def nearest_rows(x, rows, p, k, block):
    """(g, number, key, v, near): for each row with a number its k nearest rows of the same group, as (d, other, w), by (d, other).

    `x` has g, key, number (null for rows that are only neighbours) and finite features f0 to f(p - 1); `rows` is about its size, and a range
    has about `block` rows, or fewer where cores would be idle. Ranges are in the order of place, features and key, so equal rows are cut as well."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..session import checkpoint, workers

    workers(x.sparkSession)
    fs = [f"f{i}" for i in range(p)]
    z = _z_order(x, p)
    x = x.select("g", "key", "number", *fs).repartitionByRange(max(1, -(-rows // block), min(x.sparkSession.sparkContext.defaultParallelism, 16 * rows // block)), "g", z, *fs, "key").withColumn("b", F.spark_partition_id())
    x = checkpoint(x)  # the ranges are sampled, so they are fixed before they are read twice
    ends = x.groupBy("g", "b").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in fs for n, f in (("lo", F.min), ("hi", F.max)))).orderBy("g", "b").collect()  # one row for a range
    boxes, seen = {}, {}
    for r in ends:
        lo, hi = (tuple(r[f"{n}{c}"] for c in fs) for n in ("lo", "hi"))
        if lo == hi:  # one vector alone: ranges after its first k + 1 keys hold nobody's nearest
            if seen.get((r["g"], lo), 0) > k:
                continue
            seen[r["g"], lo] = seen.get((r["g"], lo), 0) + r["n"]
        boxes.setdefault(r["g"], []).append((r["b"], lo, hi))
    boxes = {g: (np.array([b for b, _, _ in c]), np.array([lo for _, lo, _ in c]), np.array([hi for _, _, hi in c])) for g, c in boxes.items()}

    def within(batches):
        """The nearest rows of the same range, and the other ranges that a row's ball reaches."""
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        for g in sorted(set(t["g"].to_pylist())) if t else ():
            s, v, key = _arrays(t.filter(pc.equal(t["g"], g)), p)
            asks = np.flatnonzero(s["number"].is_valid().to_numpy())
            if not len(asks):
                continue
            data, q, keys = _first_keys(v, key, k), v[asks], s["key"].combine_chunks()
            d, j = nearest(q, key[asks], v[data], key[data], k, np.full(len(asks), np.inf))
            at, (ids, lo, hi), more = s["b"][0].as_py(), boxes.get(g, ([], [], [])), [[] for _ in asks]
            with np.errstate(over="ignore"):
                apart = np.maximum(np.maximum(lo - q.max(0), q.min(0) - hi), 0.0) if len(ids) else np.zeros((0, p))
                for c in np.flatnonzero((apart * apart).sum(1) * (1 - SLACK) <= d[:, -1].max()):
                    if ids[c] != at:
                        for i in np.flatnonzero(_reached(q, lo[c], hi[c], d[:, -1])):
                            more[i].append(int(ids[c]))
            lists = pa.ListArray.from_arrays(np.arange(len(asks) + 1, dtype="int32") * p, q.ravel())
            cols = [pa.array(np.full(len(asks), g, "int32")), s["number"].combine_chunks().take(pa.array(asks)), keys.take(pa.array(asks)), lists, _near(d, j, keys.take(pa.array(data)), v[data]), pa.array(np.full(len(asks), at, "int32")), pa.array(d[:, -1]), pa.array(more, pa.list_(pa.int32()))]
            yield from pa.table(cols, ["g", "number", "key", "v", "near", "own", "r", "more"]).to_batches(10_000)

    near = "near array<struct<d:double,other:string,w:array<double>>>"
    first = checkpoint(x.mapInArrow(within, f"g int, number bigint, key string, v array<double>, {near}, own int, r double, more array<int>"))  # read by both parts below
    done = first.where("size(more) = 0").select("g", "number", "key", "v", "near")
    open_ = first.where("size(more) > 0")
    asks = open_.select("g", F.explode("more").alias("b"), "own", "number", "key", "r", *(F.col("v")[i].alias(c) for i, c in enumerate(fs)))
    reach = F.sqrt("r") * (1 + SLACK)
    pairs = asks.groupBy("g", "b", "own").agg(*(f(F.col(c) + sign * (reach + F.abs(c) * 1e-12)).alias(f"{n}{c}") for c in fs for n, f, sign in (("lo", F.min, -1), ("hi", F.max, 1))))
    count = pairs.count()
    if not count:
        return done
    inside = F.lit(True)
    for c in fs:
        inside = inside & F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}"))
    pairs = F.broadcast(pairs) if count <= FEW_PAIRS else pairs
    data = x.join(pairs, ["g", "b"]).where(inside).select("g", "b", "own", F.lit(None).cast("bigint").alias("number"), "key", F.lit(None).cast("double").alias("r"), *fs)

    def across(t):
        """The nearest rows of another range."""
        s, v, key = _arrays(t, p)
        ask = s["number"].is_valid().to_numpy()
        asks, data = np.flatnonzero(ask), np.flatnonzero(~ask)
        data = data[_first_keys(v[data], key[data], k)] if len(data) else data
        d, j = nearest(v[asks], key[asks], v[data], key[data], k, s["r"].to_numpy()[asks])
        found = _near(d, j, s["key"].combine_chunks().take(pa.array(data)), v[data])
        return pa.table([s["g"].take(pa.array(asks)), s["number"].take(pa.array(asks)), found], ["g", "number", "near"])

    other = asks.unionByName(data).groupBy("g", "b", "own").applyInArrow(across, f"g int, number bigint, {near}")  # two ranges at most
    other = other.select("g", "number", F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<double>").alias("v"), "near")
    every = open_.select(*done.columns).unionByName(other).groupBy("g", "number")
    merged = every.agg(F.first("key", True).alias("key"), F.first("v", True).alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k rows for a range at most
    return done.unionByName(merged)
