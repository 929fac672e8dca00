"""Near duplicates among embeddings: all cosines of at least a threshold, exactly.

Equal vectors are one class. A class' unit vector u is quantised to whole numbers of one
byte: u = s q + e, with s its own scale and the length of e known. So
``|u . v - s t (q . r)| <= |s q| |f| + |e|`` for any other v = t r + f, and |v| = 1. Classes
are dealt to blocks, and every two blocks meet once as a tile: one product of two integer
matrices, exact in single precision. What lies above the threshold by more than its bound
is a link, what lies below by more is none, and the pairs between are done again in
double precision, for which only their own vectors travel.

A tile gives numbers of links and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import components
from .tables import stored

#: Classes of a block, about; longest vectors whose integer products single precision holds exactly.
BLOCK, EXACT = 4096, 1040
#: Rows of a block whose products are made at once; pairs that are recomputed at once.
STRIP, RECOMPUTED = 256, 8192
#: Allowance for rounding in bounds and scaled products.
SLACK = 1e-6


def unit(vectors: list) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.array([*map(np.asarray, vectors)], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of -127 to 127, scale, length of what they stand for, length of the error) of each row."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", held, held)), np.sqrt(np.einsum("ij,ij->i", u - held, u - held))


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as (vec_id, class), class null where a vector links with nothing; and
    (class, weight, least, embedding): the number of equal vectors and their least id.

    Vectors that are null, empty, all zero, or hold null or not finite components have no class.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, x).alias("embedding"))
    grouped = given.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    named = stored(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    rows = given.join(named.select("embedding", "class"), "embedding", "left").select("vec_id", "class")
    return rows, named.select("class", "weight", "least", "embedding")


def blocks(named: DataFrame) -> DataFrame:
    """(dims, block, blocks, class, weight, q, scale, held, error), written: the quantised classes, dealt to blocks of their length of vector."""
    numbers = named.groupBy(F.size("embedding").alias("dims")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("dims"):
                for i in range(0, len(rows), 1024):
                    some = rows.iloc[i : i + 1024]
                    q, scale, held, error = quantised(unit(some["embedding"].tolist()))
                    yield some[["dims", "class", "weight"]].assign(q=[x.tobytes() for x in q], scale=scale, held=held, error=error)

    made = named.withColumn("dims", F.size("embedding")).select("dims", "class", "weight", "embedding")
    made = made.mapInPandas(run, "dims int, class long, weight long, q binary, scale double, held double, error double")
    dealt = made.join(numbers, "dims")
    return stored(dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "quantised")


def _tiles(rows: DataFrame, columns: list[str], find: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``find`` over the rows of one tile after the other; a tile has the rows of two blocks at most."""
    sorted_rows = rows.select("dims", "low", "high", "block", *columns).repartition("dims", "low", "high").sortWithinPartitions("dims", "low", "high", "block", "class")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            tile = batch[["dims", "low", "high"]].to_numpy()
            begins = np.flatnonzero((np.diff(tile, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *begins], [*begins, len(batch)]):
                part = batch.iloc[a:b]
                if held and (held[0][["dims", "low", "high"]].iloc[0] != part[["dims", "low", "high"]].iloc[0]).any():
                    yield from find(pd.concat(held, ignore_index=True))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield from find(pd.concat(held, ignore_index=True))

    return sorted_rows.mapInPandas(run, schema)


def _above(rows: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) for the pairs i < j of a tile's rows that may reach the threshold, STRIP rows at a time; sure where they certainly do."""
    low, high, block = (rows[c].to_numpy() for c in ("low", "high", "block"))
    left = np.flatnonzero(block == low[0])
    right = left if low[0] == high[0] else np.flatnonzero(block == high[0])
    if not len(left) or not len(right):
        return
    q = np.frombuffer(b"".join(rows["q"]), np.int8).reshape(len(rows), -1)
    kind = np.float32 if q.shape[1] <= EXACT else np.float64
    scale, held, error = (rows[c].to_numpy() for c in ("scale", "held", "error"))
    columns = q[right].astype(kind).T
    # No pair of a row reaches the threshold with a product below this.
    most = held[left] * error[right].max() + error[left] + SLACK
    least = (threshold - most) / scale[left] / np.where(threshold > most, scale[right].max(), scale[right].min())
    least = (least - SLACK * np.abs(least) - 1).astype(kind)
    for a in range(0, len(left), STRIP):
        product = q[left[a : a + STRIP]].astype(kind) @ columns
        x, y = np.nonzero(product >= least[a : a + STRIP, None])
        i, j = left[a + x], right[y]
        near = scale[i] * scale[j] * product[x, y].astype(np.float64)
        bound = np.minimum(held[i] * error[j] + error[i], held[j] * error[i] + error[j]) + SLACK
        some = (near + bound >= threshold) & ((i < j) | (low[0] != high[0]))
        yield i[some], j[some], (near - bound >= threshold)[some]


class _Links:
    """What a tile tells of its links: how many vectors each class is linked with, and a spanning forest."""

    def __init__(self, rows: pd.DataFrame):
        self.name, self.weight = rows["class"].to_numpy(), rows["weight"].to_numpy()
        self.n = np.zeros(len(rows), np.int64)
        self.order = np.argsort(self.name, kind="stable")
        self.rank = np.empty(len(rows), np.int64)
        self.rank[self.order] = self.label = np.arange(len(rows))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in ((i, j), (j, i)):
            self.n += np.bincount(x, self.weight[y], len(self.n)).astype(np.int64)
        a, b = self.label[self.rank[i]], self.label[self.rank[j]]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            label = self.label.copy()
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
            self.label = label
            a, b = label[a], label[b]

    def told(self) -> pd.DataFrame:
        some, child = np.flatnonzero(self.n), np.flatnonzero(self.label != np.arange(len(self.label)))
        counts = pd.DataFrame({"kind": "links", "a": self.name[some], "b": self.n[some]})
        return pd.concat([counts, pd.DataFrame({"kind": "edges", "a": self.name[self.order[child]], "b": self.name[self.order[self.label[child]]]})])


def links(named: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of the classes: (class, n), the vectors of other classes that each is linked with,
    and (a, b), links that join what all links join."""
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = blocks(named)
    rows = dealt.withColumn("other", spread).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def first(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, unsure = _Links(rows), np.zeros(len(rows), bool)
        for i, j, sure in _above(rows, threshold):
            found.add(i[sure], j[sure])
            unsure[i[~sure]] = unsure[j[~sure]] = True
        out = pd.concat([found.told(), pd.DataFrame({"kind": "open", "a": found.name[unsure], "b": 0})])
        yield out.assign(dims=rows["dims"].iloc[0], low=rows["low"].iloc[0], high=rows["high"].iloc[0])

    def again(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, u = _Links(rows), unit(rows["embedding"].tolist())
        for i, j, sure in _above(rows, threshold):
            i, j = i[~sure], j[~sure]
            for k in range(0, len(i), RECOMPUTED):
                x, y = i[k : k + RECOMPUTED], j[k : k + RECOMPUTED]
                linked = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
                found.add(x[linked], y[linked])
        yield found.told()

    columns = ["class", "weight", "q", "scale", "held", "error"]
    found = stored(_tiles(rows, columns, first, "kind string, a long, b long, dims int, low int, high int"), "tiles")
    unsure = found.filter("kind = 'open'").select("dims", "low", "high", F.col("a").alias("class"))
    back = unsure.join(dealt.drop("dims", "blocks"), "class")
    more = _tiles(back.join(named.select("class", "embedding"), "class"), [*columns, "embedding"], again, "kind string, a long, b long")
    both = found.select("kind", "a", "b").unionByName(stored(more, "recomputed"))
    return both.filter("kind = 'links'").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("n")), both.filter("kind = 'edges'").select("a", "b")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): the other vectors whose cosine with this one reaches the
    threshold (over 0), the least id that links lead to, and whether that is the vector's own.

    Equal vectors are linked. Vectors that are null, zero, or hold null or not finite
    components, and vectors of another length, are linked with nothing. Every row is a
    vector of its own, whether its id is repeated or null; null ids come after all others,
    and a component of null ids alone has none.
    """
    rows, named = classes(vectors, vec_id, embedding)
    linked, edges = links(named, threshold)
    label = stored(components(edges), "labels")
    placed = named.select("class", "weight", "least").join(linked, "class", "left").join(label.withColumnRenamed("node", "class"), "class", "left")
    placed = stored(placed.select("class", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("label", "class").alias("label")), "placed")
    ids = placed.groupBy("label").agg(F.min("least").alias("component"))
    known = placed.join(ids, "label").select("class", "n_links", "component")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(known, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
