"""Embedding near-dedup: an exact metric range join on unit vectors.

Cosine >= c is a distance of at most r = sqrt(2 - 2c) between unit vectors. Pivots drawn from the vectors split each
large label into cells: a vector is owned by the cell of its nearest pivot. By the triangle inequality, a vector within
r of one owned by another cell is at most 2r further from that cell's pivot than from its own; in Euclidean space the
sharper form is (d(v, other)^2 - d(v, own)^2) / (2 |other - own|) <= r. Vectors for which it holds are also sent to that
cell as visitors. Every cell then joins on its own: owners against owners and visitors, so an owner meets all of its
partners there, once each. Cells that are still large are split again by pivots of their own, by the same rule, as often
as that makes them smaller; pivots then travel with blocks of their cell's vectors, not to every task. What stays large (a
ball of less than r) is joined in blocks of owners and members. Blocks return counts and the stars of their components,
never pairs.

Exact copies are collapsed first (equal label and components) and their numbers kept as weights.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and vectors with a null
label or id, link with nothing and are their own component. Vectors of different length don't link. Repeated rows are
vectors of their own. Extra columns are ignored; an empty table gives an empty result.

Broadcast: the first pivots, about max_pivots at most (only labels of more than cell_rows vectors have any, and the share of
vectors drawn falls as the table grows), and the names of those labels, fewer than max_pivots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, lean, table
from .components import components

#: Lost to rounding when unit vectors are subtracted; it only widens what is compared.
SLACK = 1e-7


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))


#: pivots of a cell that is split again, times that may happen, rows of it that meet them at once
FAN, ROUNDS, SPLIT_ROWS, FIRST = 64, 5, 4096, 1 << 20


def _dealt(x: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector, pivot's cell, and whether the cell is that of its nearest pivot; a vector is in each cell that may own one within r of it."""
    d = _distances(x, p)
    own = d.argmin(1)
    nearest = d[np.arange(len(x)), own][:, None]
    apart = _distances(p, p)[own]
    visits = (d - nearest <= 2 * r) & (d * d - nearest * nearest <= 2 * r * apart + SLACK)
    visits[np.arange(len(x)), own] = True
    i, c = np.nonzero(visits)
    return i, c, c == own[i]


def _split(cells: DataFrame, cell_rows: int, r: float) -> DataFrame:
    """Cells of more than cell_rows owners split by pivots of their own, again and again. A vector that visits a cell goes on
    visiting in its parts; one that owns a place there owns one in the part of its nearest pivot."""
    key, done, names = ["label", "dim", "cell"], [], cells.columns
    written, kind = cells, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    cells = cells.withColumn("cell", F.col("cell") + FIRST)  # so that the parts of a cell have numbers beyond all others'
    for k in range(ROUNDS):
        sizes = cells.groupBy(*key).agg(F.sum(F.col("owns").cast("long")).alias("owners"), F.count(F.lit(1)).alias("rows"))
        large = cut(sizes.filter(F.col("owners") > cell_rows))
        before = large.agg(F.sum("rows")).first()[0]
        if not before:
            break
        share = F.greatest(F.lit(max(1, cell_rows // 2)), F.ceil(F.col("owners") / FAN))
        mine = cells.join(large, key).withColumn("blocks", F.ceil(F.col("rows") / SPLIT_ROWS).cast("int"))
        as_pivot = mine.filter(F.col("owns") & (F.pmod(F.xxhash64("rep", F.lit(k)), share) == 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = mine.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        both = as_pivot.select(*names, "block", F.lit(True).alias("pivot")).unionByName(rows.select(*names, "block", F.lit(False).alias("pivot")))

        def parts(t: pa.Table) -> pa.Table:
            pivot = t.column("pivot").to_numpy(zero_copy_only=False)
            p, v = t.filter(pa.array(pivot)), t.filter(pa.array(~pivot)).select(names)
            if p.num_rows < 2 or not v.num_rows:
                return v
            p = p.take(np.argsort(p.column("rep").to_numpy())[: 4 * FAN - 1])  # numbered alike in every block
            dim = t.column("dim")[0].as_py()
            i, c, owns = _dealt(_matrix(v.column("unit"), dim), _matrix(p.column("unit"), dim), r)
            v = v.take(pa.array(i))
            cell = v.column("cell").to_numpy() * (4 * FAN) + 1 + c
            return v.set_column(names.index("cell"), "cell", pa.array(cell)).set_column(names.index("owns"), "owns", pa.array(owns & v.column("owns").to_numpy(zero_copy_only=False)))

        new = cut(both.groupBy(*key, "block").applyInArrow(parts, kind))
        if new.count() > 4 * before:  # vectors lie so close that most visit most cells
            drop(new)
            break
        done.append(cut(cells.join(large, key, "left_anti").select(names)))
        drop(written, large)
        cells = written = new
    for x in done:
        cells = cells.unionByName(x)
    return cells


def _stars(linked: np.ndarray, owners: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id of their component, in the graph of owners and members with links."""
    ids, roots = [], []
    left = linked.any(1)
    while left.any():
        rows = np.zeros(len(owners), dtype=bool)
        rows[left.argmax()] = True
        front, columns = rows, np.zeros(len(members), dtype=bool)
        while front.any():
            new = linked[front].any(0) & ~columns
            columns |= new
            front = linked[:, new].any(1) & ~rows
            rows |= front
        left &= ~rows
        own = np.concatenate([owners[rows], members[columns]])
        ids.append(own)
        roots.append(np.full(len(own), own.min()))
    return (np.concatenate(ids), np.concatenate(roots)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """label, embedding, rep (smallest id of the copies), n (copies), dim, unit (doubles as bytes) of the vectors that can link."""
    e = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & e.isNotNull() & F.col(label).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    alone = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), e.alias("embedding")).filter(sound).groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            units = []
            for x in batch.column("embedding").to_pylist():
                v = np.array(x, dtype=np.float64)
                v = v / np.abs(v).max()
                units.append((v / np.sqrt(v @ v)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(u) // 8 for u in units], pa.int32()), pa.array(units, pa.binary())], [*batch.schema.names, "dim", "unit"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema)
    return alone.mapInArrow(run, f"{fields}, dim int, unit binary")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cell_rows: int = 2048, block_rows: int = 1024, max_pivots: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark, r = vectors.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    reps = cut(unit_vectors(vectors, vec_id, embedding, label))
    share = max(cell_rows, math.ceil(reps.count() / max_pivots))  # a pivot for so many vectors
    large = F.broadcast(reps.groupBy("label", "dim").count().filter(F.col("count") > share).select("label", "dim"))
    drawn = reps.filter(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0).join(large, ["label", "dim"]).select("label", "dim", "rep", "unit").orderBy("rep").collect()
    pivots: dict = {}
    for row in drawn:
        pivots.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["unit"], dtype="<f8"))
    sent = spark.sparkContext.broadcast({k: np.stack(v) for k, v in pivots.items()})
    kind = reps.schema["label"].dataType.simpleString()

    def deal(batches):
        lean()
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_numpy()
            cell, row, owns = [], [], []
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims.tolist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                at = np.array(at)
                p = sent.value.get(key)
                if p is None:
                    cell.append(np.zeros(len(at), dtype=np.int64))
                    row.append(at)
                    owns.append(np.ones(len(at), dtype=bool))
                    continue
                i, c, own = _dealt(_matrix(batch.column("unit").take(pa.array(at)), key[1]), p, r)
                cell.append(c)
                row.append(at[i])
                owns.append(own)
            row = np.concatenate(row) if row else np.zeros(0, np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(take), batch.column("dim").take(take), pa.array(np.concatenate(cell) if cell else row, pa.int64()), pa.array(np.concatenate(owns) if owns else np.zeros(0, bool)), batch.column("rep").take(take), batch.column("n").take(take), batch.column("unit").take(take)],
                ["label", "dim", "cell", "owns", "rep", "n", "unit"],
            )

    dealt = _split(cut(reps.select("label", "dim", "rep", "n", "unit").mapInArrow(deal, f"label {kind}, dim int, cell bigint, owns boolean, rep bigint, n bigint, unit binary")), cell_rows, r)
    key = ["label", "dim", "cell"]
    n_blocks = lambda c: F.ceil(F.sum(c.cast("long")) / block_rows).cast("int")
    sizes = cut(dealt.groupBy(*key).agg(n_blocks(F.col("owns")).alias("i_n"), n_blocks(F.lit(1)).alias("j_n")).filter("j_n > 1"))
    split = dealt.join(sizes, key, "left").withColumns({"i_n": F.coalesce("i_n", F.lit(1)), "j_n": F.coalesce("j_n", F.lit(1))})
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_owner = split.filter("owns").select(*key, block("i_n").alias("i"), F.explode(every("j_n")).alias("j"), F.lit(True).alias("owner"), "rep", "n", "unit")
    as_member = split.select(*key, F.explode(every("i_n")).alias("i"), block("j_n").alias("j"), F.lit(False).alias("owner"), "rep", "n", "unit")

    def join(t: pa.Table) -> pa.Table:
        owner = t.column("owner").to_numpy(zero_copy_only=False)
        dim = t.column("dim")[0].as_py()
        rep, n, x = t.column("rep").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("unit"), dim)
        o, m = rep[owner], rep[~owner]
        linked = np.zeros((len(o), len(m)), dtype=bool)
        for a in range(0, len(o), 256):
            linked[a : a + 256] = (x[owner][a : a + 256] @ x[~owner].T) >= cosine
        linked &= o[:, None] != m[None, :]
        links = linked @ n[~owner]
        ids, roots = _stars(linked, o, m)
        return pa.table({"rep": np.concatenate([o, ids]), "links": np.concatenate([links, np.zeros(len(ids), np.int64)]), "root": np.concatenate([o, roots])})

    joined = cut(as_owner.unionByName(as_member).groupBy(*key, "i", "j").applyInArrow(join, "rep bigint, links bigint, root bigint").filter("links > 0 or rep <> root"))
    links = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(joined.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    found = cut(reps.select("label", "embedding", "rep", "n").join(links, "rep", "left").join(comp, "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    # a vector without an id meets none of the groups of copies
    own = vectors.select(F.col(vec_id).alias("id"), F.when(F.col(vec_id).isNotNull(), F.col(label)).alias("label"), F.col(embedding).alias("embedding"))
    out = own.join(found, ["label", "embedding"], "left").select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
