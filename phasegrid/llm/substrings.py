"""Suffix-array dedup: bytes covered by a repeated string of 200 bytes.

Only the order of suffixes through the first 200 bytes matters, and of it only
which are equal. Suffixes are therefore radix-sorted from the most significant
digit, to that depth and no further, and a suffix leaves as soon as it is
alone in its group.

Dealing. To move every suffix of a corpus would take some sixteen times its
bytes, so suffixes that can't have an equal leave before anything is moved. Of
the 101 strings of 100 bytes in a 200-byte window the one with the least hash
(the leftmost of them) is its anchor; equal windows have equal anchors at the
same offset, and about 2 % of all positions are anchors. Those that stand in
one text once leave, and so do all their windows. The others bring the bytes
of their windows (about 250) to the task of their anchor. Hashes only deal:
what has unequal hashes is unequal, and nothing is taken for equal by them.

Sorting. Inside an anchor's group, runs of windows with the same bytes are one
run from here on. Of the others the windows are sorted by their offset and
then, pass by pass, by the next eight bytes; after each pass the windows that
are alone in their group leave. Groups left at byte 200 are exactly the
repeated windows.

An anchor that more than HOT texts have is not brought together. Its windows,
each once for a text, are counted by an aggregate on 128-bit prints, which
combines before its shuffle, and joined back.

Each distinct text is written once, to a table bucketed by its 128-bit print,
where its copies are counted; anchors, windows and results are computed there,
so no text moves twice. A text of 200 bytes or more that has a copy goes
whole.

Defined cases: a null text is empty; a text under 200 bytes keeps all its
bytes; very long texts are judged whole; equal rows are copies of each other;
matches never cross texts, and strings are judged on the input; cutting may
split a character, so what is left is bytes; an empty table gives no rows;
other columns pass through, and those with an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import units
from phasegrid.llm.common import Bucketed, Scratch, aside, cut, strings

WINDOW, GRAM, HOT, DIGIT = 200, 100, 2_000, 8


class Hashes:
    """Hashes of all strings of a given length in a sequence of bytes."""

    def __init__(self, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.back = pow(self.base, -1, 1 << 64)
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def sums(self, raw):
        """Prefix sums of codes times powers; hashes come from differences."""
        import numpy as np

        n = len(raw) + 1
        if len(self.powers[0]) < n:
            for i, b in enumerate((self.base, self.back)):
                steps = np.full(2 * n, b, np.uint64)
                steps[0] = 1
                self.powers[i] = np.cumprod(steps, dtype=np.uint64)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.codes[raw] * self.powers[0][: n - 1], out=out[1:])
        return out

    def at(self, sums, starts, stops):
        import numpy as np

        h = (sums[stops] - sums[starts]) * self.powers[1][starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def anchors(h, width: int):
    """For every run of `width` of h: the position of its leftmost least."""
    import numpy as np

    n = len(h)
    m = -(-n // width) * width
    x = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    x, at = x.reshape(-1, width), np.arange(m).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, at, 0), axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    new = np.ones(x.shape, bool)
    new[:, :-1] = x[:, :-1] <= back[:, 1:]
    back_at = np.minimum.accumulate(np.where(new, at, m)[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead, back, s = ahead.ravel(), back.ravel(), np.arange(n - width + 1)
    return np.where(back[s] <= ahead[s + width - 1], back_at[s], ahead_at[s + width - 1])


def segments(raw: bytes, hashes: Hashes):
    """Runs of windows with the same anchor: anchor hash, first window, number
    of windows, offset of the anchor from the first, hash of the run's bytes."""
    import numpy as np

    b = np.frombuffer(raw, np.uint8)
    sums = hashes.sums(b)
    s = np.arange(len(b) - GRAM + 1)
    grams = hashes.at(sums, s, s + GRAM)
    own = anchors(grams, WINDOW - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(np.append(first, len(own)))
    return grams[own[first]].view(np.int64), first, n, own[first] - first, hashes.at(sums, first, first + n + WINDOW - 1)


def _print(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two columns."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")]


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """gram, a, b and again (whether the text has it twice), once for a text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = Hashes()
        for batch in batches:
            out: list = [[], [], [], []]
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                grams, n = np.unique(segments(raw, hashes)[0], return_counts=True)
                for column, x in zip(out, (grams, np.full(len(grams), a, np.int64), np.full(len(grams), b, np.int64), n > 1)):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in zip(("gram", "a", "b", "again"), out)})

    return texts.select("a", "b", "text").mapInArrow(run, "gram long, a long, b long, again boolean")


RUNS = "gram long, other long, a long, b long, start long, n int, off int, raw binary"


def _same(raw: bytes, first, n, hashed):
    """Of runs of windows with equal hashes, the one that stands for all that
    have its bytes: for each run, its place among them."""
    import numpy as np

    _, one, at = np.unique(hashed, return_index=True, return_inverse=True)
    out = one[at]
    for i in np.flatnonzero(out != np.arange(len(out))).tolist():
        j = int(out[i])
        if raw[first[i] : first[i] + n[i] + WINDOW - 1] != raw[first[j] : first[j] + n[j] + WINDOW - 1]:
            out[i] = i  # unlike bytes: a run of its own
    return out


def _windows(batches, hot: bool):
    """Of texts with their repeated anchors, the runs of windows to compare,
    and runs known to be repeated (without bytes); where hot, single windows
    (gram and other: the window's print; null for what is known)."""
    import numpy as np
    import pyarrow as pa

    hashes, more = Hashes(), Hashes(6)
    kind = pa.schema([("gram", pa.int64()), ("other", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("raw", pa.binary())])
    whole_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
    for batch in batches:
        out: list = []
        for a, b, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), batch.column(3)):
            grams, first, n, off, whole = segments(raw, hashes)
            good = np.flatnonzero(np.isin(grams, wanted.values.to_numpy(zero_copy_only=False)))
            # Runs that the text has twice are repeated; one of them stands for all.
            own = _same(raw, first[good], n[good], whole[good])
            one, times = np.unique(own, return_counts=True)
            if hot:
                bytes_ = np.frombuffer(raw, np.uint8)
                starts = np.concatenate([np.empty(0, np.int64), *(np.arange(first[i], first[i] + n[i]) for i in good[one])])
                p, q = (h.at(h.sums(bytes_), starts, starts + WINDOW).view(np.int64).tolist() for h in (hashes, more))
                out += zip(p, q, [a] * len(starts), [b] * len(starts), starts.tolist(), [1] * len(starts), [0] * len(starts), [None] * len(starts))
            else:
                for i in good[one].tolist():
                    f, m = int(first[i]), int(n[i])
                    out.append((int(grams[i]), 0, a, b, f, m, int(off[i]), raw[f : f + m + WINDOW - 1]))
            known = good[np.isin(own, one[times > 1])]
            if len(known):  # in one piece where they follow each other, and dealt by place
                new = np.flatnonzero(np.concatenate([[True], first[known][1:] != first[known][:-1] + n[known][:-1]]))
                begin, m = first[known][new], np.add.reduceat(n[known], new)
                out += zip([None] * len(begin) if hot else (begin * 0x9E3779B1 ^ a).tolist(), [0] * len(begin), [a] * len(begin), [b] * len(begin), begin.tolist(), m.tolist(), [0] * len(begin), [None] * len(begin))
            if len(out) > 20_000:
                yield whole_batch(out)
                out = []
        if out:
            yield whole_batch(out)


def radix(data, begin, group):
    """Which of the windows data[begin : begin + WINDOW] have an equal one in
    their group (numbers): sorted by the next DIGIT bytes, from the first, in
    passes that windows alone in their group leave."""
    import numpy as np

    def left(order, new):
        """order, without those alone in their group; where groups start."""
        alone = new & np.append(new[1:], True)
        return order[~alone], new[~alone]

    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.zeros(len(data) + 1, np.uint64)  # DIGIT bytes from each place, the first the most significant
    for j in range(DIGIT):
        digits = digits << np.uint64(8) | padded[j : j + len(digits)]
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    order, new = left(order, new)
    for depth in range(0, WINDOW, DIGIT):
        if not len(order):
            break
        digit, number = digits[begin[order] + depth], np.cumsum(new) - 1
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[digit != digit[np.flatnonzero(new)][number]]] = True
        if not mixed.any():
            continue
        part = np.flatnonzero(mixed[number])  # groups that this digit splits
        part_order = part[np.lexsort((digit[part], number[part]))]
        order[part], digit[part] = order[part_order], digit[part_order]
        new[1:] |= digit[1:] != digit[:-1]
        order, new = left(order, new)
    out = np.zeros(len(begin), bool)
    out[order] = True
    return out


def _equal(table):
    """Intervals of bytes covered by windows that stand twice among the runs
    of a table of whole groups: arrays of a, b, start and stop."""
    import numpy as np

    a, b, start, n, off, gram = (table[c].to_numpy() for c in ("a", "b", "start", "n", "off", "gram"))
    n = n.astype(np.int64)
    raw = table["raw"].combine_chunks().to_pylist()
    first: dict = {}
    same = np.array([first.setdefault((g, x), i) if x is not None else i for i, (g, x) in enumerate(zip(gram.tolist(), raw))])
    copies = np.bincount(same, minlength=len(same))
    known = np.array([x is None for x in raw]) | (copies[same] > 1)
    one = np.flatnonzero((same == np.arange(len(same))) & np.array([x is not None for x in raw]))
    size = np.array([len(raw[i]) for i in one], np.int64)
    data = np.frombuffer(b"".join(raw[i] for i in one), np.uint8)
    row = np.repeat(np.arange(len(one)), n[one])
    step = np.arange(len(row)) - np.repeat(np.cumsum(n[one]) - n[one], n[one])
    begin = (np.cumsum(size) - size)[row] + step
    # Windows of an anchor and of one offset of it are compared.
    _, group = np.unique(gram[one], return_inverse=True)
    twice = radix(data, begin, group[row] * (WINDOW + 1) + (off[one][row] - step))
    before = np.concatenate([[False], twice[:-1] & (row[1:] == row[:-1])])[: len(row)]
    after = np.concatenate([twice[1:] & (row[1:] == row[:-1]), [False]])[: len(row)]
    x, y = np.flatnonzero(twice & ~before), np.flatnonzero(twice & ~after)
    at = one[row[x]]
    found = [a[at], b[at], start[at] + step[x], start[at] + step[y] + WINDOW]
    return [np.concatenate([k[known], f]) for k, f in zip((a, b, start, start + n + WINDOW - 1), found)]


def repeats(texts: Bucketed) -> DataFrame:
    """a, b, start and stop of covered bytes of distinct texts; they may
    overlap. texts: a, b, text; of WINDOW bytes at least."""
    scratch = Scratch(_anchor_rows(texts.read()), "anchors")
    grams = scratch.read()
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f"), F.max("again").alias("again")).filter("f > 1 OR again")
    counts = counts.select(F.bitwise_not("gram").alias("k"), (F.col("f") > HOT).alias("hot"))
    found = grams.select("a", "b", F.bitwise_not("gram").alias("k")).join(counts, "k")
    listed = lambda which: F.collect_set(F.when(which, F.bitwise_not("k")))
    found = cut(found.groupBy("a", "b").agg(listed(~F.col("hot")).alias("grams"), listed(F.col("hot")).alias("hots")))
    scratch.drop()

    def runs(which: str):
        asked = found.filter(F.size(which) > 0).select("a", "b", F.col(which).alias("asked"))
        rows = texts.read().join(asked, ["a", "b"]).select("a", "b", "text", "asked")
        return rows.mapInArrow(lambda batches: _windows(batches, which == "hots"), RUNS)

    n = int(texts.spark.conf.get("spark.sql.shuffle.partitions"))
    cold = runs("grams").drop("other").withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0)).repartition(n, "gram").sortWithinPartitions("gram")

    def compare(batches):
        import pyarrow as pa

        for table, _ in units(batches, "gram"):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _equal(table)], ["a", "b", "start", "stop"])

    out = cold.mapInArrow(compare, "a long, b long, start long, stop long")
    if not found.filter(F.size("hots") > 0).isEmpty():
        every = cut(runs("hots").select("gram", "other", "a", "b", "start", "n"))
        stop = lambda n: (F.col("start") + n + (WINDOW - 1)).alias("stop")
        twice = every.filter("gram IS NOT NULL").groupBy("gram", "other").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.bitwise_not("gram").alias("k"), F.col("other").alias("o"))
        hits = every.withColumn("k", F.bitwise_not("gram")).join(twice, ["k"]).filter("other = o")
        out = out.union(hits.select("a", "b", "start", stop(1))).union(every.filter("gram IS NULL").select("a", "b", "start", stop(F.col("n"))))
    return out


SPAN = "struct<start:long,stop:long>"
RESULT = f"n_bytes long, n_removed long, n_spans long, spans array<{SPAN}>, kept binary, kept_sha256 string"
FIELDS = ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")


def _cutter(keep: bool):
    """A UDF of (text, spans, whether it goes whole) that gives RESULT."""

    def apply(column, spans, whole):
        import hashlib

        import pyarrow as pa

        rows = []
        for raw, own, all_ in zip(strings(column), spans.to_pylist(), whole.to_pylist()):
            found: list[list[int]] = [[0, len(raw)]] if all_ else []
            for x, y in () if all_ else sorted((s["start"], s["stop"]) for s in own or ()):
                if found and x <= found[-1][1]:
                    found[-1][1] = max(y, found[-1][1])
                else:
                    found.append([x, y])
            left, at = [], 0
            for x, y in found:
                left.append(raw[at:x])
                at = y
            left = b"".join([*left, raw[at:]])
            rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(found), "spans": [{"start": x, "stop": y} for x, y in found], "kept": left if keep else None, "kept_sha256": hashlib.sha256(left).hexdigest()})
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span), ("kept", pa.binary()), ("kept_sha256", pa.string())]))

    return F.arrow_udf(apply, RESULT).asNondeterministic()


def drop_repeats(docs: DataFrame, *, text: str = "text", keep: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (removed runs of bytes),
    kept (the bytes left; null where keep is False) and kept_sha256."""
    own, cutter = F.col(f"`{text}`").cast("string"), _cutter(keep)
    long = docs.select(own.alias("text")).filter(F.octet_length("text") >= WINDOW).select(*_print(F.col("text")), "text")
    texts = Bucketed(long.groupBy("a", "b").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "texts", "a", "b")
    spans = repeats(texts).groupBy("a", "b").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = texts.read().join(spans, ["a", "b"], "left")
    # Both sides of the last join are dealt out for it, so that a text with very many copies can be split.
    found = cut(found.select(F.bitwise_not("a").alias("k"), "b", cutter("text", "spans", F.col("n") > 1).alias("made")))
    texts.drop()
    k, b, made, short, other = aside(docs, "k", "b", "made", "short", "other")
    is_long = F.octet_length(own) >= WINDOW
    parts = [F.when(is_long, x) for x in (F.bitwise_not(F.xxhash64(own)), F.xxhash64(F.lit(7), own))]
    none = F.lit(None).cast(f"array<{SPAN}>")
    mine = docs.withColumn(k, parts[0]).withColumn(b, parts[1]).withColumn(short, cutter(F.when(~is_long, own), none, F.lit(False)))
    found = found.select(F.col("k").alias(k), F.col("b").alias(b), F.col("made").alias(made))
    out = mine.join(found, [k, b], "left")
    return out.select(*[f"`{c}`" for c in docs.columns if c not in FIELDS], *[F.coalesce(F.col(made)[c], F.col(short)[c]).alias(c) for c in FIELDS])
