"""Embedding near-duplicates by collision-counting projections.

Every distinct vector is projected on many random lines.  On a line a vector
collides with a query when it lies in the window centred on the query.  So that
only few pairs are counted, lines come in groups that cut the projections into
cells, and pairs that share a cell of some group are met there: within it the
members are sorted by one projection, each query meets its window of that order,
collisions are counted over all counting lines, and pairs that reach the
recall-calibrated count are verified by cosine in double precision.  Lines of a
group and groups follow from the number of vectors, so that unlike pairs meet
about once in ten vectors and a pair at the least cosine is missed once in
10,000.  Copies of a vector are one row with a multiplicity throughout.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, mix64, table
from veilspark.llm.components import connected_components

COSINE = 0.98
#: Lines that collisions are counted on, and those of them that are counted first.
COUNTED, FIRST = 64, 16
#: Half a window, in standard deviations of the projected difference of a pair at the least cosine.
REACH = 2.25
#: Width of a cell on a line; unit vectors project with a standard deviation of one.
CELL = 1.8
#: Share of pairs at the least cosine that no group brings together.
MISSED = 1e-4
#: Vectors unlike a given one that a group's cell holds, on average.
UNLIKE = 0.1
#: Rows that meet in one call; larger cells are dealt in pairs of chunks, and cells of SMALL rows at most share a call.
CHUNK, SMALL = 2048, 64
#: Query rows compared at once within a task.
STRIP = 128


@lru_cache(8)
def _lines(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def together(distance: float, width: float = CELL) -> float:
    """The chance that two points at a distance fall into one cell of a random line."""
    x = width / distance
    return erf(x / sqrt(2)) - 2 / (sqrt(2 * pi) * x) * (1 - exp(-x * x / 2))


def shape(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Groups and lines of a group for so many vectors of a label; independent vectors stand at a distance of about sqrt(2)."""
    lines = max(3, ceil(log(max(2, vectors) / UNLIKE) / -log(together(sqrt(2)))))
    return max(1, ceil(log(MISSED) / log(1 - together(sqrt(2 - 2 * cosine)) ** lines))), lines


def window(cosine: float = COSINE, reach: float = REACH) -> float:
    return reach * sqrt(2 - 2 * cosine)


def least_count(count: int, reach: float = REACH, recall: float = 0.999995) -> int:
    """The most collisions that a pair at the least cosine still reaches with this recall."""
    p = erf(reach / sqrt(2))
    tail = 0.0
    for k in range(count, -1, -1):
        tail += comb(count, k) * p**k * (1 - p) ** (count - k)
        if tail >= recall:
            return k
    return 0


def _units(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(unit: np.ndarray, groups: int, lines: int) -> np.ndarray:
    """One key for each row and group: its cell on the group's lines, whose borders are shifted at random."""
    dim = unit.shape[1]
    shift = np.random.default_rng([13, dim]).uniform(0, CELL, groups * lines)
    at = np.floor((unit @ _lines(dim, groups * lines, 11) + shift) / CELL).astype(np.int64).view(np.uint64).reshape(-1, groups, lines)
    key = np.broadcast_to(np.arange(1, groups + 1, dtype=np.uint64), at.shape[:2]).copy()
    for k in range(lines):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + at[:, :, k])
    return key.view(np.int64)


def _dealer(groups: int, lines: int):
    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for start in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[start : start + 1024]))
                    keys = cells(_units(part.column("vector")), groups, lines)
                    at = pa.array(np.repeat(np.arange(part.num_rows), groups))
                    names = ["label", "dim", "cid"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names), pa.array(np.tile(np.arange(groups, dtype=np.int32), part.num_rows)), pa.array(keys.reshape(-1))], [*names, "grp", "cell"])

    return deal


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the pairs into ``labels`` (each the least index of its set), in place."""
    while True:
        a, b = labels[i], labels[j]
        live = a != b
        if not live.any():
            return
        i, j, a, b = i[live], j[live], a[live], b[live]
        least = np.minimum(a, b)
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while not np.array_equal(deeper := labels[labels], labels):
            labels[:] = deeper


def _verifier(groups: int, lines: int, w: float, cosine: float):
    least, first = least_count(COUNTED), least_count(FIRST)

    def verify(key: tuple[pa.Scalar, ...], chunk: pa.Table) -> pa.Table:
        """One pack of small cells (``i`` is -1), or two chunks of a large cell."""
        dim, group, i, j = (key[k].as_py() for k in (0, 1, 3, 4))
        cid, n, own, place = (np.array(chunk.column(k).to_pylist(), np.int64) for k in ("cid", "n", "own", "place"))
        unit = _units(chunk.column("vector"))
        points = unit @ _lines(dim, COUNTED, 7)
        order = np.lexsort((points[:, 0], place))  # sorted by the first projection within a cell; windows are ranges of it
        cid, n, own, place, unit, points = cid[order], n[order], own[order], place[order], unit[order], points[order]
        labels, links = np.arange(len(cid)), np.zeros(len(cid), np.int64)

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            for start in range(0, len(a), 1 << 16):  # few at a time, so that a cell of copies takes no more memory
                x, y = a[start : start + (1 << 16)], b[start : start + (1 << 16)]
                keep = (np.abs(points[x] - points[y]) <= w).sum(1) >= least
                x, y = x[keep], y[keep]
                keep = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                keys = cells(unit[rows], groups, lines)[:, :group]
                keep = ~(keys[at[: len(x)]] == keys[at[len(x) :]]).any(1)  # met in an earlier group: counted there
                x, y = x[keep], y[keep]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                _merge(labels, x, y)

        line, far = points[:, 0], 5 / REACH * w  # a pair at the least cosine stands further apart on a line once in a million times
        if i < 0:
            for step in range(1, len(cid)):
                a = np.flatnonzero(place[step:] == place[:-step])
                if not len(a):
                    break
                a = a[line[a + step] - line[a] <= far]
                settle(a, a + step)
        q = np.arange(0 if i < 0 else len(cid)) if i == j else np.flatnonzero(own == i)
        for at in range(0, len(q), STRIP):
            s = q[at : at + STRIP]
            d = np.arange(np.searchsorted(line, line[s[0]] - far, "left"), np.searchsorted(line, line[s[-1]] + far, "right"))
            d = d[d > s[0]] if i == j else d[own[d] != i]
            hits = np.zeros((len(s), len(d)), np.int8)
            for k in range(FIRST):
                hits += np.abs(points[s, k][:, None] - points[d, k][None, :]) <= w
            meet = hits >= first
            if i == j:
                meet &= d[None, :] > s[:, None]
            a, b = np.nonzero(meet)
            settle(s[a], d[b])
        linked = np.flatnonzero(links)
        return pa.table({"a": cid[linked], "b": cid[labels[linked]], "links": links[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    return verify


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row (columns ``vec_id, embedding, label``).

    Only vectors with equal, non-null labels and equal dimension are compared.
    Null or zero vectors and those with null or non-finite components link with
    nothing.  Every found pair is counted once, in the first group that brings it
    together.  Rows are vectors of their own, whether or not they repeat a
    vec_id: each counts its own vector's links.  A row without vec_id is compared
    like any other; no component is named after it, and a component without any
    vec_id has a null component_id and keeps its rows.  Other columns are not
    read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>"), F.col("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & (norm > 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    kind = dict(rows.dtypes)["label"]
    grouped = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    distinct = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")  # numbered once, when it is written
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    groups, lines = shape(largest, cosine)
    packed = distinct.mapInArrow(_pack, f"label {kind}, dim int, cid bigint, n bigint, vector binary")
    keyed = packed.mapInArrow(_dealer(groups, lines), f"label {kind}, dim int, cid bigint, grp int, cell bigint")
    keyed = keyed.select("dim", "grp", F.xxhash64("label", "dim", "grp", "cell").alias("place"), "cid")
    shared = keyed.groupBy("place").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(keyed.join(shared, "place"), "met")
    small = F.col("size") <= SMALL
    packs = max(1, (met.where(small).count() // groups) // CHUNK)  # of each group; a pack is about a chunk
    k = F.when(small, 1).otherwise(F.ceil(F.col("size") / CHUNK)).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("cid", "place"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    tile = lambda c: F.when(small, -1).otherwise(c).alias
    slot = F.when(small, F.pmod("place", F.lit(packs))).otherwise(F.col("place"))
    met = met.select("dim", "grp", slot.alias("slot"), tile(F.least("own", "other"))("i"), tile(F.greatest("own", "other"))("j"), "place", "own", "cid")
    met = met.join(packed.select("cid", "n", "vector"), "cid")
    found = met.groupBy("dim", "grp", "slot", "i", "j").applyInArrow(_verifier(groups, lines, window(cosine), cosine), "a bigint, b bigint, links bigint")
    found = materialize(found, "links")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("a", "b")).select(F.col("v").alias("cid"), "component")
    classes = distinct.join(links, "cid", "left").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("label", F.col("embedding").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.withColumn("key", F.when(F.col("usable"), F.col("embedding"))).join(classes, ["label", "key"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _pack(batches):
    for batch in batches:
        vectors = [np.array(v, "<f4") for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([len(v) for v in vectors], pa.int32()), batch.column("cid"), batch.column("n"), pa.array([v.tobytes() for v in vectors], pa.binary())],
            ["label", "dim", "cid", "n", "vector"],
        )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and classes of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
