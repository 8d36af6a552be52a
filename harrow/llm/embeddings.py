"""Embedding near-dedup: an epsilon grid order join on the leading principal dimensions.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, in every projection too. Vectors are sorted by
their cells (of width eps) on the leading principal dimensions, range-partitioned in that order by Spark, and cut into
blocks of BLOCK rows. A block's bounds are a box on the leading dimensions and a centre with a radius over all of them. Pairs of blocks that
are not provably farther apart than eps meet in one task each, which joins the two sequences recursively: halves that are provably farther apart
are skipped, small ones are compared by a matrix product in single precision, and whatever that leaves in doubt in double
precision. A pair of blocks returns only each vector's number of links and a forest of its links, so that a
cluster's pairs are counted without being emitted. Blocks travel as the input's own numbers; of a pair only one block is sent for it.

Equal vectors are one row with a count until the end, so that a vector copied a million times costs one row in the join.

What can be skipped depends on the data. Vectors that fill their dimensions evenly lie at about the same distance from each other, far beyond eps, but no
bounds of blocks show it: pairs are then quadratic, at the price of a matrix product. Clustered vectors are skipped by blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with nothing
(n_links 0, component their own id). Vectors of different lengths are never compared. Ids are expected once each; where one
repeats, its rows share a component and a sum of links. Other columns of the input don't appear in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import components as cc
from harrow.llm.shared import tidy, written

COSINE = 0.95
GRID, LEADING = 4, 16  # dimensions that order the vectors, and that bound blocks
BLOCK, TILE = 8192, 512
FEW = 256  # vectors of a length up to which its grid order is one task's, with those of other such lengths
DENSE = 0.02  # share of a tile in doubt from which all of it is computed in double precision


def usable(v: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal(vectors: DataFrame, size: int, most: int = LEADING) -> np.ndarray:
    """The leading principal directions of all unit vectors, as columns; sums of products are added up by Spark."""

    def sums(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if len(batch):
                x = unit(np.stack(batch["v"].to_numpy()))
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

    rows = vectors.select("v").mapInPandas(tidy(sums), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((size + 1) ** 2)
    total[rows["at"]] = rows["x"]
    return axes_of(total.reshape(size + 1, size + 1), most)


def axes_of(total: np.ndarray, most: int = LEADING) -> np.ndarray:
    """The leading principal directions, as columns, from the sums of products of vectors with a one at their end."""
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :most])


def grid_cells(u: np.ndarray, axes: np.ndarray, eps: float) -> np.ndarray:
    """The cell of each unit vector on the first dimensions, by which they are put in order."""
    return np.floor((u @ axes[:, :GRID]) / eps).astype(np.int64)


def gap2(a: np.ndarray, b: np.ndarray) -> float:
    """The least squared distance of two boxes, each (lows, highs)."""
    apart = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(apart @ apart)


class Ordered:
    """A block's unit vectors in grid order: in both precisions, and on the leading dimensions."""

    def __init__(self, u: np.ndarray, n: np.ndarray, axes: np.ndarray):
        self.u, self.n, self.single, self.led = u, n, u.astype(np.float32), u @ axes
        self.cache: dict[tuple[int, int], tuple] = {}

    def bounds(self, a: int, b: int) -> tuple:
        """Low and high on the leading dimensions, centre and radius of rows a to b."""
        if (a, b) not in self.cache:
            led, centre = self.led[a:b], self.u[a:b].mean(axis=0)
            apart = self.u[a:b] - centre
            self.cache[a, b] = led.min(axis=0), led.max(axis=0), centre, float(np.sqrt((apart * apart).sum(axis=1).max()))
        return self.cache[a, b]


class PairJoin:
    """Joins two blocks of unit vectors; the second may be the first. tiles, skipped: how many comparisons of rows there were, and how many bounds saved."""

    def __init__(self, cosine: float):
        self.cosine, self.eps2 = cosine, (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
        self.eps = float(np.sqrt(self.eps2))
        self.compared = self.skipped = 0

    def links(self, a: Ordered, b: Ordered | None) -> tuple[np.ndarray, np.ndarray]:
        """Weighted links of each row (those of a, then those of b), and the smallest row that each reaches."""
        self.same, self.a, self.b = b is None, a, a if b is None else b
        self.shift = 0 if self.same else len(a.n)
        self.doubt = 4e-7 * self.a.u.shape[1] + 1e-6  # more than single precision can be off
        n = len(a.n) + (0 if self.same else len(self.b.n))
        self.count, self.lab = np.zeros(n, np.int64), np.arange(n)
        self._join(0, len(a.n), 0, len(self.b.n))
        return self.count, self.lab

    def far(self, x: tuple, y: tuple) -> bool:
        apart = x[2] - y[2]
        return gap2(x, y) > self.eps2 or float(np.sqrt(apart @ apart)) - x[3] - y[3] > self.eps * (1 + 1e-9) + 1e-12

    def _join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if a0 == a1 or b0 == b1 or self.same and b1 <= a0:
            return
        if self.far(self.a.bounds(a0, a1), self.b.bounds(b0, b1)):
            self.skipped += (a1 - a0) * (b1 - b0)
        elif max(a1 - a0, b1 - b0) <= TILE:
            self.compared += (a1 - a0) * (b1 - b0)
            self._tile(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self._join(a0, mid, b0, b1)
            self._join(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self._join(a0, a1, b0, mid)
            self._join(a0, a1, mid, b1)

    def _tile(self, a0: int, a1: int, b0: int, b1: int) -> None:
        rough = self.a.single[a0:a1] @ self.b.single[b0:b1].T >= np.float32(self.cosine - self.doubt)
        i, j = np.divmod(np.flatnonzero(rough), b1 - b0)
        if self.same:
            i, j = i[a0 + i < b0 + j], j[a0 + i < b0 + j]
        if not len(i):
            return
        if len(i) > DENSE * rough.size:
            near = (self.a.u[a0:a1] @ self.b.u[b0:b1].T)[i, j] >= self.cosine
        else:
            near = np.einsum("ij,ij->i", self.a.u[a0 + i], self.b.u[b0 + j]) >= self.cosine
        i, j = a0 + i[near], b0 + j[near]
        np.add.at(self.count, i, self.b.n[j])
        np.add.at(self.count, self.shift + j, self.a.n[i])
        self.lab = cc.labels(len(self.lab), i, self.shift + j, self.lab)


LINK = "id long, links long, root long"


def _links(join: PairJoin, ids: np.ndarray, a: Ordered, b: Ordered | None) -> pd.DataFrame:
    """LINK rows of a pair of blocks: each linked vector's number of links, and the smallest id of its links' forest."""
    count, lab = join.links(a, b)
    some = np.nonzero(count)[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, lab, ids)
    return pd.DataFrame({"id": ids[some], "links": count[some], "root": least[lab[some]]})


BODY = "ids binary, counts binary, v binary"


def _body(some: pd.DataFrame, kind: type) -> dict[str, list[bytes]]:
    return {"ids": [some["id"].to_numpy(np.int64).tobytes()], "counts": [some["n"].to_numpy(np.int64).tobytes()], "v": [np.stack(some["v"].to_numpy()).astype(kind).tobytes()]}


def _read(row: dict, x: str, kind: type, size: int, axes: np.ndarray) -> tuple[np.ndarray, Ordered]:
    v = np.frombuffer(row[f"v{x}"], kind).reshape(-1, size)
    return np.frombuffer(row[f"ids{x}"], np.int64), Ordered(unit(v), np.frombuffer(row[f"counts{x}"], np.int64), axes)


def _kind(vectors: DataFrame) -> type:
    """In which numbers the input's can be carried without loss."""
    return np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64


def _blocks(vectors: DataFrame, axes: np.ndarray, eps: float, rows: int, block: int) -> DataFrame:
    """vectors (id, n, v) in grid order, block by block: its ids, counts and vectors, and its bounds."""
    k, kind = min(GRID, axes.shape[1]), _kind(vectors)
    element = "float" if kind is np.float32 else "double"

    def place(batches):
        for batch in batches:
            if len(batch):
                cells = grid_cells(unit(np.stack(batch["v"].to_numpy())), axes, eps)
                yield batch[["id", "n", "v"]].assign(**{f"c{i}": cells[:, i] for i in range(k)})

    keys = [f"c{i}" for i in range(k)]
    placed = vectors.mapInPandas(tidy(place), f"id long, n long, v array<{element}>, " + ", ".join(f"{c} long" for c in keys))
    number_of = max(1, -(-rows // block))
    ordered = placed.repartitionByRange(number_of, *keys, "id").sortWithinPartitions(*keys, "id").coalesce(number_of)  # neighbours together, wherever a session makes more parts

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        rest = None
        for batch in batches:
            rest = batch if rest is None or not len(rest) else pd.concat([rest, batch])
            while len(rest) >= block:
                yield one(rest.iloc[:block], part * 1_000_000 + number)
                rest, number = rest.iloc[block:], number + 1
        if rest is not None and len(rest):
            yield one(rest, part * 1_000_000 + number)

    def one(some: pd.DataFrame, number: int) -> pd.DataFrame:
        u = unit(np.stack(some["v"].to_numpy()))
        low, high, centre, radius = Ordered(u, some["n"].to_numpy(), axes).bounds(0, len(u))
        return pd.DataFrame({"block": [number]} | _body(some, kind) | {"low": [low], "high": [high], "centre": [centre], "radius": [radius]})

    return written(ordered.mapInPandas(tidy(cut), f"block long, {BODY}, low array<double>, high array<double>, centre array<double>, radius double"), "blocks")


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that are not provably farther apart than eps, found over the cells that their boxes touch on the first two dimensions."""
    bounds = ["low", "high", "centre", "radius"]
    cells = lambda i, wide: F.explode(F.sequence(F.floor(F.get("low", i) / eps).cast("long") - wide, F.floor(F.get("high", i) / eps).cast("long") + wide))
    two = blocks.select(F.size("low")).first()
    dimensions = range(min(2, two[0])) if two else range(1)

    def side(x: str, wide: int) -> DataFrame:
        out = blocks.select("block", *bounds)
        for i in dimensions:
            out = out.withColumn(f"cell{i}", cells(F.lit(i), wide))
        return out.withColumnsRenamed({"block": x} | {c: f"{c}_{x}" for c in bounds})

    pairs = side("a", 0).join(side("b", 1), [f"cell{i}" for i in dimensions]).where("a <= b")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    between = F.sqrt(square(F.zip_with("centre_a", "centre_b", lambda x, y: x - y))) - F.col("radius_a") - F.col("radius_b")
    near = (square(gaps) <= eps * eps * (1 + 1e-9) + 1e-12) & (between <= eps * (1 + 1e-9) + 1e-12)
    return pairs.where(near).select("a", "b").distinct()


def near_links(vectors: DataFrame, size: int, rows: int, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vectors (id, n, v): usable, distinct, so many, of one size. LINK rows: partial counts and links of a forest, by pairs of blocks."""
    axes, eps, kind = principal(vectors, size), float(np.sqrt(max(2 - 2 * cosine, 1e-12))), _kind(vectors)
    blocks = _blocks(vectors, axes, eps, rows, block)
    named = lambda x: blocks.select(F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("ids", "counts", "v")])
    pairs = written(_block_pairs(blocks, eps), "pairs").join(named("a"), "a").join(named("b"), "b")

    def compare(batches):
        join = PairJoin(cosine)
        for batch in batches:
            for row in batch.to_dict("records"):
                ids, a = _read(row, "_a", kind, size, axes)
                if row["a"] == row["b"]:
                    yield _links(join, ids, a, None)
                else:
                    other, b = _read(row, "_b", kind, size, axes)
                    yield _links(join, np.concatenate([ids, other]), a, b)

    return pairs.mapInPandas(tidy(compare), LINK)


def few_links(vectors: DataFrame, cosine: float) -> DataFrame:
    """As near_links, for lengths that have few vectors each: a length's grid order, on its own principal dimensions, is one block, however many lengths there are. vectors (size, id, n, v)."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 1e-12)))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        u = unit(np.stack(g["v"].to_numpy()))
        x = np.concatenate([u, np.ones((len(u), 1))], axis=1)
        axes, ids = axes_of(x.T @ x), g["id"].to_numpy(np.int64)
        order = np.lexsort((ids, *grid_cells(u, axes, eps).T[::-1]))
        return _links(PairJoin(cosine), ids[order], Ordered(u[order], g["n"].to_numpy(np.int64)[order], axes), None)

    return vectors.groupBy("size").applyInPandas(one, LINK)


def near_duplicates(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of df."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    once = written(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    sized = once.withColumn("size", F.size("v"))
    lengths = written(sized.groupBy("size").agg(F.count("*").alias("rows")), "lengths")
    links = few_links(sized.join(lengths.where(F.col("rows") <= FEW).select("size"), "size"), cosine)
    for x in lengths.where(F.col("rows") > FEW).orderBy("size").collect():  # at most one for each FEW vectors; models have few lengths
        links = links.unionByName(near_links(once.where(F.size("v") == x["size"]), x["size"], x["rows"], cosine, block))
    links = written(links, "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    comps = cc.components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = once.join(counts, "id", "left").join(comps, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    classes = written(classes, "classes")
    joined = rows.withColumn("v", F.when(usable(F.col("v")) & F.col("id").isNotNull(), F.col("v"))).join(classes, "v", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
_V = "list_transform(embedding, lambda x: x::DOUBLE)"
ORACLE = {
    "op10_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL AND list_sum({_V}) IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN {_V} END AS e FROM embeddings),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
        r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id"""
}
