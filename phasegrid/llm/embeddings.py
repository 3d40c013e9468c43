"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised; equal vectors of a label are one node, by 128-bit
prints of their bytes. A table hashes
a node to the floors of (a.x + b) / WIDTH for k random Gaussian a: two vectors
at distance d agree on one floor with probability p(d), on all with p(d)^k. k
is chosen from the size of the largest label so that unrelated vectors rarely
meet, and the number of tables so that two vectors at the cosine threshold
miss each other in all of them with probability MISS at most (closer ones far
less). Both follow from the input's size at every size.

Buckets hold nodes of one label; those of any size are dealt into blocks, and
as n_links counts every link, every two blocks of a bucket meet: the rows of a
bucket of m nodes that move are m * m / BLOCK. In a unit the cosines are one matrix product in double precision. A link is counted
in the first table that both vectors share, so each counts once and no pair is
written: a unit returns, for each node, its links there and one node that it
is connected to.

Defined cases: a vector that is null, zero, empty or holds a null or
non-finite component, and one whose label is null, links with nothing; vectors
of different length don't compare; equal rows are vectors of their own; a null
id is never the least one; an empty table gives no rows; a vector of any length
is compared whole; columns beside the three named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import dealt, spread
from phasegrid.llm.common import cut
from phasegrid.llm.components import label

COSINE, WIDTH, MISS, BLOCK = 0.98, 2.0, 1e-4, 2048


def agree(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at a distance have the same floor."""
    t = width / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections of a table and number of tables for n vectors."""
    k = max(2, math.ceil(math.log(max(n, 2)) / -math.log(agree(math.sqrt(2)))))
    hit = agree(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))


def hashed(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """vectors (row_id, kind, vector) with a 128-bit print of kind and vector
    in two halves, unit and keys; all null for a vector that can't compare."""
    made: dict = {}

    def project(kinds, column):
        import numpy as np
        import pyarrow as pa
        import xxhash

        rows = [None] * len(column)
        groups: dict[int, list] = {}
        for i, (kind, x) in enumerate(zip(kinds.to_pylist(), column)):
            if kind is None or not x.is_valid or x.values is None or len(x.values) == 0 or x.values.null_count:
                continue
            v = np.array(x.values.to_numpy(zero_copy_only=False), float)
            size = np.abs(v).max()
            if np.isfinite(size) and size > 0:
                v = v / size
                groups.setdefault(len(v), []).append((i, kind, v / np.sqrt(v @ v), x.values.to_numpy(zero_copy_only=False).tobytes()))
        for dim, found in groups.items():
            if dim not in made:
                r = np.random.default_rng([4, dim])
                made[dim] = (r.standard_normal((dim, k * tables)), r.random(k * tables) * WIDTH)
            a, b = made[dim]
            units = np.array([f[2] for f in found])
            floors = np.floor((units @ a + b) / WIDTH).astype(np.int32).reshape(len(found), tables, k)
            for (i, kind, unit, raw), own in zip(found, floors):
                seed = xxhash.xxh3_64_intdigest(f"{dim}:{kind}".encode())
                high, low = divmod(xxhash.xxh3_128_intdigest(raw, seed), 1 << 64)
                keys = [xxhash.xxh3_64_intdigest(t.tobytes(), (seed + j) & (1 << 64) - 1) - (1 << 63) for j, t in enumerate(own)]
                rows[i] = {"high": high - (1 << 63), "low": low - (1 << 63), "unit": unit.tobytes(), "keys": keys}
        return pa.array(rows, pa.struct([("high", pa.int64()), ("low", pa.int64()), ("unit", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    udf = F.arrow_udf(project, "high long, low long, unit binary, keys array<long>").asNondeterministic()
    return vectors.withColumn("hash", udf("kind", "vector")).select("row_id", "hash.*")


def links(nodes: DataFrame, tables: int, cosine: float) -> DataFrame:
    """node, n (links found in a unit) and other (a node connected to it).
    nodes: node, copies, unit, keys."""
    posted = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select(F.bitwise_not("key").alias("k"), F.ceil(F.col("f") / BLOCK).alias("parts"))
    shared = posted.withColumn("k", F.bitwise_not("key")).join(sizes, "k").drop("k")
    rows = dealt(shared.join(nodes, "node"), "key", "parts", "node").select("key", "bi", "bj", "first", "table", "node", "copies", "unit", "keys")

    def compare(table, starts):
        import numpy as np
        import pyarrow as pa

        ids, copies, at = (table[c].to_numpy() for c in ("node", "copies", "table"))
        first, diagonal = table["first"].to_numpy(zero_copy_only=False), table["bi"].to_numpy() == table["bj"].to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
        raw = table["unit"].combine_chunks().to_pylist()
        starts = np.unique(np.append(starts, len(ids))).tolist()
        out: tuple[list, list, list] = ([], [], [])
        for s, e in zip(starts[:-1], starts[1:]):
            units = np.frombuffer(b"".join(raw[s:e]), float).reshape(e - s, -1)
            same, t = bool(diagonal[s]), int(at[s])
            rows = np.arange(e - s)
            left, right = (rows, rows) if same else (np.flatnonzero(first[s:e]), np.flatnonzero(~first[s:e]))
            n, labels = np.zeros(e - s, np.int64), rows.copy()
            for part in (left[i : i + 256] for i in range(0, len(left), 256)):
                i, j = np.nonzero(units[part] @ units[right].T >= cosine)
                i, j = part[i], right[j]
                i, j = (i[i < j], j[i < j]) if same else (i, j)
                for x in np.unique(i).tolist():
                    mine = j[i == x]
                    if (labels[mine] != labels[x]).any():
                        labels[np.isin(labels, np.append(labels[mine], labels[x]))] = min(labels[mine].min(), labels[x])
                for a in range(0, len(i), 1 << 18):  # those that no earlier table has
                    x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
                    new = np.ones(len(x), bool)
                    for c in range(t):
                        new &= keys[s + x, c] != keys[s + y, c]
                    np.add.at(n, x[new], copies[s + y[new]])
                    np.add.at(n, y[new], copies[s + x[new]])
            hit = np.flatnonzero((n > 0) | (labels != rows) | np.isin(rows, labels[labels != rows]))
            out[0].extend(ids[s + hit].tolist())
            out[1].extend(n[hit].tolist())
            out[2].extend(ids[s + labels[hit]].tolist())
        yield pa.RecordBatch.from_pydict({"node": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "other": pa.array(out[2], pa.int64())})

    return spread(compare, rows, "key", "node long, n long, other long")


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", within: str = "label", cosine: float = COSINE) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("row_id"), F.col(f"`{within}`").cast("string").alias("kind"), F.col(f"`{vector}`").alias("vector"))
    largest = rows.filter("kind IS NOT NULL").groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    k, tables = shape(largest, cosine)
    marked = hashed(rows, k, tables).select("row_id", F.bitwise_not("high").alias("k"), "low", "unit", "keys")
    # Vectors with the same bytes and label are one node; their seeds part the labels.
    each = cut(marked)
    nodes = each.filter("k IS NOT NULL").groupBy("k", "low").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = cut(links(nodes.select("node", "copies", "unit", "keys"), tables, cosine))
    counts = found.groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "m")
    ids = label(nodes.select("node", "least", "copies"), found.select(F.col("node").alias("a"), F.col("other").alias("b"))).drop("group_")
    facts = nodes.select("k", "low", "node", "copies").join(ids, "node").join(counts, F.col("node") == F.col("m"), "left")
    facts = facts.select("k", "low", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = each.select("row_id", "k", "low").join(facts, ["k", "low"], "left")
    component = F.coalesce("component_id", "row_id")
    return out.select(F.col("row_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("row_id") == component).alias("kept"))
