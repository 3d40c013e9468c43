"""Near-duplicate documents by an inverted join of signature coordinates.

1. Each text becomes its set of word shingles, a fingerprint of the set (the
   node: rows with the same set are one node from here on) and a MinHash
   signature of 48 coordinates.
2. Nodes are posted under their (coordinate, value) pairs. Two sets of
   similarity 0.8 agree on 27 coordinates or more but for about one pair in
   10,000; 27 of 48 in common means that their 22 rarest pairs share one, so
   only those prefixes are posted, and of them only pairs that two nodes have.
3. In each posting list the collisions of two members are counted on their
   signatures; members known to be connected already are skipped, and only
   the links that connect something new are written. Lists of any size are
   dealt into blocks (see blocks.connecting).
4. Connected candidates form clusters. Inside a cluster (dealt likewise) every
   pair above the match threshold that isn't connected yet is verified on the
   full sets: 100 * intersection >= percent * union.
5. Verified links give the components.

Equal sets are one node, by 128-bit prints; a list or cluster of m nodes writes
fewer than m links for a block. What grows with the square of a list or
cluster is the work on members that are not connected, in one block with all
others.

Defined cases: a null text or one without words has no shingles and no links;
of fewer words than a shingle, the whole sequence is the one shingle; a very
long text is taken whole, by the fingerprints of its shingles; equal rows share
a set; rows with a null id take part, and are never the one kept where another
row is; an empty table gives no rows; other columns of docs stay as they are in
one_of_each, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from phasegrid.llm.blocks import connecting
from phasegrid.llm.common import LOWER_TABLE, WordIds, aside, cut, shingles, strings
from phasegrid.llm.components import components, label

COORDINATES, MATCHES = 48, 27
PREFIX = COORDINATES - MATCHES + 1
#: Rows of a block of a posting list; rows and shingles of one of a cluster,
#: and rows of the blocks in which what is still apart meets.
LIST_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES, WIDE_BLOCK = 4096, 256, 1 << 20, 2048
BROADCAST_ROWS = 500_000


def coordinates():
    """The multipliers of the signature's hash functions."""
    import numpy as np

    return np.random.default_rng(10).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found, a):
    """The least value of each hash function over a set of fingerprints."""
    import numpy as np

    out = np.empty(len(a), np.uint32)
    for i, m in enumerate(a):
        out[i] = ((found * m) >> np.uint64(32)).min()
    return out.view(np.int32)


def sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with a column set_: n (of shingles), a print of the set in two
    halves (null without shingles) and the signature."""
    made: list = []

    def make(column):
        import numpy as np
        import pyarrow as pa
        import xxhash

        if not made:
            made.extend([WordIds(), coordinates()])
        ids, a = made
        n, halves, marks = [], ([], []), []
        for raw in strings(column):
            found = shingles(raw.translate(LOWER_TABLE).split(), width, ids)
            n.append(len(found))
            both = divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 1 << 64)
            for half, x in zip(halves, both):
                half.append(x - (1 << 63) if len(found) else None)
            marks.append(signature(found, a) if len(found) else None)
        flat = np.concatenate([x for x in marks if x is not None] or [np.empty(0, np.int32)])
        ends = np.cumsum([0] + [COORDINATES if x is not None else 0 for x in marks]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in halves), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["n", "high", "low", "marks"])

    udf = F.arrow_udf(make, "n long, high long, low long, marks array<int>").asNondeterministic()
    return docs.withColumn("set_", udf(F.col(f"`{text}`")))


def _matrix(column):
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def _edges(pairs):
    import pyarrow as pa

    a, b = ([p[0] for p in pairs], [p[1] for p in pairs])
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _connect(first, same: bool, labels, linked):
    """Links (i, j) that connect the members of a unit that aren't connected
    yet (have unlike labels). linked(i, js): which of js are linked with i."""
    import numpy as np

    n = len(first)
    labels, out = np.unique(labels, return_inverse=True)[1], []
    left = range(n) if same else np.flatnonzero(first).tolist()
    right = None if same else np.flatnonzero(~first)
    for i in left:
        js = np.arange(i + 1, n) if same else right
        js = js[labels[js] != labels[i]]
        while len(js):
            part, js = js[:1024], js[1024:]
            part = part[labels[part] != labels[i]]
            if not len(part):
                continue
            for j in part[linked(i, part)].tolist():
                if labels[j] != labels[i]:
                    out.append((i, j))
                    labels[labels == labels[j]] = labels[i]
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes whose signatures match enough.
    nodes: node, marks."""
    pair = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = nodes.select("node", F.posexplode("marks").alias("at", "value")).select("node", pair.alias("pair"))
    counts = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select(F.bitwise_not("pair").alias("key"), "f")
    shared = posted.select("node", "pair", F.bitwise_not("pair").alias("key")).join(counts, "key").drop("key")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("f", "pair")))
    # Pairs that no other node has come first in the prefix; they need no posting.
    prefix = ranked.filter(F.col("rank") <= F.col("n") - (COORDINATES - PREFIX)).select("node", "pair", "f")
    parts = F.ceil(F.col("f") / LIST_BLOCK)
    lists = prefix.join(nodes, "node").select("pair", "node", "marks", parts.alias("parts"), parts.alias("wide_parts"))

    def collide(table, starts):
        import numpy as np

        marks, ids, label = _matrix(table["marks"]), table["node"].to_numpy(), table["label"].to_numpy()
        first, diagonal = table["first"].to_numpy(zero_copy_only=False), table["bi"].to_numpy() == table["bj"].to_numpy()
        sizes, out = np.diff(np.append(starts, len(ids)) if starts[-1] != len(ids) else starts), []
        starts = starts[: len(sizes)]
        two = starts[sizes == 2]
        two = two[diagonal[two] | (first[two] != first[two + 1])]
        hits = two[(marks[two] == marks[two + 1]).sum(1) >= MATCHES]
        out += zip(ids[hits].tolist(), ids[hits + 1].tolist())
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = marks[s : s + n]
            linked = lambda i, js, own=own: (own[js] == own[i]).sum(1) >= MATCHES
            out += [(int(ids[s + i]), int(ids[s + j])) for i, j in _connect(first[s : s + n], bool(diagonal[s]), label[s : s + n], linked)]
        yield _edges(out)

    return connecting(lists, "pair", collide, block=LIST_BLOCK, wide=LIST_BLOCK)


def verified(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a cluster whose sets are similar
    enough, as many as connect them. members: root, node, n, text, marks."""
    parts = lambda block: F.greatest(F.ceil(F.sum("n") / CLUSTER_SHINGLES), F.ceil(F.count(F.lit(1)) / block))
    size = members.groupBy(F.bitwise_not("root").alias("k")).agg(parts(CLUSTER_BLOCK).alias("parts"), parts(WIDE_BLOCK).alias("wide_parts"))
    rows = members.withColumn("k", F.bitwise_not("root")).join(size, "k").select("root", "node", "marks", "text", "parts", "wide_parts")
    made: list = []

    def compare(table, starts):
        import numpy as np

        if not made:
            made.append(WordIds())
        marks, ids, texts = _matrix(table["marks"]), table["node"].to_numpy(), strings(table["text"].combine_chunks())
        label = table["label"].to_numpy()
        first, diagonal = table["first"].to_numpy(zero_copy_only=False), table["bi"].to_numpy() == table["bj"].to_numpy()
        out = []
        starts = np.unique(np.append(starts, len(ids))).tolist()
        for s, e in zip(starts[:-1], starts[1:]):
            own = [shingles(x.translate(LOWER_TABLE).split(), width, made[0]) for x in texts[s:e]]
            size = np.array([len(x) for x in own])
            names, flat = np.unique(np.concatenate(own), return_inverse=True)
            at, mark, sub = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(names), bool), marks[s:e]

            def linked(i, js, flat=flat, at=at, mark=mark, size=size, sub=sub):
                good = (sub[js] == sub[i]).sum(1) >= MATCHES
                few = js[good]
                if len(few):
                    mark[flat[at[i] : at[i + 1]]] = True
                    both = np.array([np.count_nonzero(mark[flat[at[j] : at[j + 1]]]) for j in few])
                    mark[flat[at[i] : at[i + 1]]] = False
                    good[good] = 100 * both >= percent * (size[few] + size[i] - both)
                return good

            out += [(int(ids[s + i]), int(ids[s + j])) for i, j in _connect(first[s:e], bool(diagonal[s]), label[s:e], linked)]
        yield _edges(out)

    return connecting(rows, "root", compare, block=CLUSTER_BLOCK, wide=WIDE_BLOCK)


def _small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys (two numbers a row, and computed before), to be broadcast where
    they are few, so that the other side of the join needn't move."""
    return F.broadcast(keys) if keys.count() <= most else keys


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, print (of the text), n_shingles,
    component_id (the least doc_id that links reach), kept, and group (a number
    of the component; null for a row that has neither links nor copies)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    marked = sets(rows, "text", width).select("doc_id", "print", F.col("set_.n").alias("n_shingles"), F.bitwise_not("set_.high").alias("k"), F.col("set_.low").alias("low"), F.col("set_.marks").alias("marks"))
    each = cut(marked)
    nodes = each.filter("k IS NOT NULL").groupBy("k", "low").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "print")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("marks").alias("marks"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    clusters = components(candidates(nodes.select("node", "marks"))).select(F.col("node").alias("member"), "root")
    members = cut(nodes.join(clusters, F.col("node") == F.col("member")).select("root", "node", "n", "marks", F.col("row.doc_id").alias("id_"), F.col("row.print").alias("print_")))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("print") == F.col("print_"))
    wanted = members.select(F.col("id_").alias("want_"), F.col("print_").alias("seek_"))
    found = rows.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("want_")) & (F.col("print") == F.col("seek_")), "left_semi").join(members, same)
    found = found.dropDuplicates(["id_", "print_"]).select("root", "node", "n", "text", "marks")
    links = verified(found, width, percent)
    ids = label(nodes.select("node", "least", "copies"), links)
    ids = nodes.select("k", "low", "node").join(ids, "node").drop("node")
    out = each.drop("marks").join(ids, ["k", "low"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "print", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), F.col("group_").alias("group"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that with the least doc_id (nulls
    last; then by a hash of the text); rows without shingles all stay."""
    found = cut(near_duplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent).filter("group IS NOT NULL").select("doc_id", "print", "group"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("n > 1").select(F.bitwise_not("group").alias("k"), "first"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    drops = cut(found.withColumn("k", F.bitwise_not("group")).join(first, "k").filter(~row.eqNullSafe(F.col("first"))).select("doc_id", "print").distinct())
    id_, key, own, n = aside(docs, "id", "key", "print", "n")
    mine = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`").cast("string")))
    drops = _small(drops.select(F.col("doc_id").alias(id_), F.col("print").alias(key)))
    out = mine.join(drops, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left_anti")
    stay = found.join(first, F.bitwise_not("group") == F.col("k")).filter(row.eqNullSafe(F.col("first")))
    again = stay.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(F.col("doc_id").alias(id_), F.col("print").alias(key), n)
    if not again.isEmpty():  # equal rows, id and all: one of them stays
        out = out.join(again, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left").drop(id_, key)
        out = out.withColumn(n, F.when(F.col(n).isNull(), F.monotonically_increasing_id())).dropDuplicates([doc_id, own, n]).drop(n)
    return out.drop(own)
