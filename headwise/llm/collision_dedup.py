"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors at the similarity threshold lie a known distance apart,
so on a direction their projections differ by a normal amount of known spread: a window centred on one of them holds the
other with known probability. A pair is a candidate when its projections fall into each other's windows on at least
``count`` of ``projections`` directions; the count is the largest that loses at most ``miss`` of the pairs at the threshold.
Candidates are verified by their exact cosine in double precision.

Pairs to count come from a grid, not from sorted windows: two pivot directions are cut into cells twice the window wide, and
every vector goes to its own cell and to those its window reaches, so whatever lies within the windows meets in a cell, where
all pairs are compared on all directions. Cells with many members are split into pairs of sub-blocks of bounded size, a row
copied to each of its blocks. A block returns link totals per vector and one star of links per local
component, never its pairs. Exact copies are one vector with a multiplicity.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows without label, link
with nothing (0 links, own component, kept); vectors of unequal length never link; repeated rows (equal vec_id) are copies
of each other and of one component; rows without vec_id are left out; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.components import components
from headwise.sources.staging import stage

PROJECTIONS, MISS, BLOCK = 16, 1e-4, 512
WINDOW_SPREADS, PIVOT_SPREADS, PIVOTS = 2.0, 3.5, 2


def calibrated_count(projections: int = PROJECTIONS, spreads: float = WINDOW_SPREADS, miss: float = MISS) -> int:
    """The largest collision count that a pair at the threshold reaches with probability 1 - miss at least."""
    p = math.erf(spreads / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(dims: int, number: int, seed: int = 5) -> np.ndarray:
    """Random unit directions, the same in every task."""
    random = np.random.default_rng([seed, dims])
    columns = random.normal(size=(dims, number))
    return columns / np.linalg.norm(columns, axis=0)


def _prepared(threshold: float):
    """Task function: unit vector, its cell, and the cells its pivot windows reach."""
    def prepare(batches):
        for batch in batches:
            vectors, unit, home, reach = batch.column("v"), [], [], []
            for row in vectors.to_pylist():
                x = np.array(row, dtype=float)
                u = x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max()
                width = PIVOT_SPREADS * math.sqrt(2 - 2 * threshold) / math.sqrt(len(x))
                at = u @ directions(len(x), PIVOTS, 9)
                cells = [(int(math.floor((p - width) / (2 * width))), int(math.floor((p + width) / (2 * width)))) for p in at]
                own = tuple(int(math.floor(p / (2 * width))) for p in at)
                near = [()]
                for low, high in cells:
                    near = [c + (i,) for c in near for i in range(low, high + 1)]
                unit.append(u.tobytes())
                home.append(",".join(map(str, own)))
                reach.append([",".join(map(str, c)) for c in near])
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), batch.column("n"),
                 pa.array([len(u) // 8 for u in unit], pa.int32()), pa.array(unit, pa.binary()), pa.array(home, pa.string()),
                 pa.array(reach, pa.list_(pa.string()))], names=["id", "label", "n", "dims", "unit", "home", "reach"])

    return prepare


def _linked(threshold: float, count: int):
    """Group function: links of one cell, or of one pair of its sub-blocks."""
    def link(key, table):
        cell, i, j = (key[c].as_py() for c in (2, 3, 4))
        ids, mass = table["id"].to_numpy(), table["n"].to_numpy()
        sub, home = table["sub"].to_numpy(), np.array(table["home"].to_pylist(), dtype=object)
        units = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=float).reshape(len(ids), -1)
        dims = units.shape[1]
        p = units @ directions(dims, PROJECTIONS)
        window = WINDOW_SPREADS * math.sqrt(2 - 2 * threshold) / math.sqrt(dims)
        left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
        seen = np.zeros((len(left), len(right)), dtype=np.int8)
        for d in range(PROJECTIONS):
            seen += np.abs(p[left, d][:, None] - p[right, d][None, :]) <= window
        a, b = np.nonzero(seen >= count)
        a, b = left[a], right[b]
        # a pair meets in several cells and counts in the larger of its two own cells
        own = (home == cell)
        wanted = (ids[a] < ids[b]) if i == j else np.ones(len(a), dtype=bool)
        larger = np.array([cell == max(home[x], home[y]) for x, y in zip(a, b)], dtype=bool) if len(a) else wanted
        a, b = a[wanted & larger & (own[a] | own[b])], b[wanted & larger & (own[a] | own[b])]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= threshold if len(a) else np.zeros(0, bool)
        a, b = a[close], b[close]
        links = np.bincount(a, weights=mass[b], minlength=len(ids)) + np.bincount(b, weights=mass[a], minlength=len(ids))
        label = np.arange(len(ids))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        tied, star = np.flatnonzero(links > 0), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({
            "u": pa.array(np.concatenate([ids[tied], ids[star]]), pa.int64()),
            "v": pa.array([None] * len(tied) + ids[label[star]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([links[tied].astype(np.int64), np.zeros(len(star), np.int64)]), pa.int64())})

    return link


def near_duplicates(
    frame: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label", block: int = BLOCK,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = frame.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"),
                        F.col(vector_column).alias("v")).where(F.col("vec_id").isNotNull())
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # a repeated id is one row of the graph: the copies differ at most in their vectors, which then share the component
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn(
        "copy", F.when(F.col("sound"), F.struct(F.xxhash64("label", "v"), F.xxhash64("v", F.lit(1), "label"))))
    classes = stage(keyed.where("sound").groupBy("copy").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
        F.first("v").alias("v")), "vector-classes")
    unit = stage(classes.select("id", F.col("label").cast("string").alias("label"), "n", "v").mapInArrow(
        _prepared(threshold),
        "id bigint, label string, n bigint, dims int, unit binary, home string, reach array<string>"), "unit-vectors")
    placed = unit.select("label", "dims", F.explode("reach").alias("cell"), "id", "n", "unit", "home")
    crowded = placed.groupBy("label", "dims", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    split = placed.join(crowded, ["label", "dims", "cell"], "left").withColumn(
        "sub", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    parts = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
    tiles = split.withColumn("other", F.explode(parts)).select(
        "label", "dims", "cell", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"),
        "id", "n", "unit", "home", "sub")
    found = stage(tiles.groupBy("label", "dims", "cell", "i", "j").applyInArrow(
        _linked(threshold, calibrated_count()), "u bigint, v bigint, n bigint"), "vector-links")
    totals = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("other_links"))
    # rows of one class share its id; a vec_id whose rows fall into several classes ties these classes together
    members = stage(keyed.where("sound").select("vec_id", "copy").join(
        classes.select("copy", F.col("id"), "n"), "copy").select("vec_id", "id", "n"), "vector-members")
    linked = components(found.where("v is not null").select("u", "v").union(
        members.select(F.col("vec_id").alias("u"), F.col("id").alias("v")).where("u != v")))
    counted = members.join(totals, "id", "left").select(
        "vec_id", (F.coalesce("other_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    loose = keyed.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    return counted.unionByName(loose).join(linked, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))
