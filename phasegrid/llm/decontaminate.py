"""Benchmark decontamination by a hash set of normalised test n-grams.

The windows of the benchmark (by default 8 words) become a hash set: sorted
64-bit prints behind a bitmap sized to their number. Each document is scanned
once: rolling prints of its words that the bitmap lets through are looked up,
and every hit is verified on the words themselves. Hits give the covered
words, the spans to cut and the benchmark items found.

A benchmark of up to `broadcast_bytes` of text is laid out once, on the driver,
in arrays of about five times that size, and broadcast. A larger one is never
sent to every executor: only its bitmap is (128 MB at most), and what passes
it meets the benchmark's windows in a shuffled join on 128-bit prints, where
the words are verified likewise. Results don't depend on which way was taken.

Defined cases: a null text has no words; very long texts are scanned whole, and
bytes that aren't valid UTF-8 come out as U+FFFD; an item without words is
ignored; an item of fewer words than the window is one window of its length;
an item with a null id makes hits but counts as no item; repeated ids are one
item; an empty benchmark hits nothing, an empty table gives no rows; each
document row gives one row, equal rows included; other columns pass through,
and one that has an output's name is replaced.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import ALNUM_TABLE, WordIds, aside, cut, strings, utf8

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, clean_text string"
BROADCAST_BYTES, MAX_BITS = 32 << 20, 1 << 30


class Bitmap:
    """Bits for 64-bit prints: clear where no print of the set is."""

    def __init__(self, n: int, most: int = MAX_BITS):
        import numpy as np

        self.shift = 64 - min(max(16 * n, 64).bit_length(), most.bit_length() - 1)
        self.bits = np.zeros(1 << (61 - self.shift), np.uint8)

    def add(self, h) -> None:
        import numpy as np

        at = h >> np.uint64(self.shift)
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h):
        import numpy as np

        at = h >> np.uint64(self.shift)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def prints(x, n: int):
    """A 64-bit print of each run of n words; x: prints of the words."""
    import numpy as np

    last = max(0, len(x) - n + 1)
    h = np.full(last, n, np.uint64)
    for j in range(n):
        h ^= x[j : j + last]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def word_prints(words: list[bytes], ids: WordIds):
    import numpy as np

    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


class Windows:
    """The benchmark's windows in arrays, ready for scanning."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        import numpy as np

        texts, sizes = [], []
        self.names = [name for name, _ in items]
        for _, text in items:
            words = text.translate(ALNUM_TABLE).split()
            texts.append(b"".join(w + b" " for w in words))
            sizes.append(len(words))
        self.text = b"".join(texts)
        # Words by number; 0 stands for all that the benchmark hasn't.
        self.vocabulary: dict[bytes, int] = {}
        for w in self.text.split():
            self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.codes = np.random.default_rng(20).integers(0, 2**63, len(self.vocabulary) + 1, np.uint64) * np.uint64(2)
        x = self.prints_of(self.text.split())
        raw = np.frombuffer(self.text, np.uint8)
        self.begin = np.concatenate([[0], np.flatnonzero(raw == 32) + 1]).astype(np.int64)  # of each word, and the end
        size = np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(x))  # words to the end of the item
        wide = np.minimum(size, width)[owner]
        self.tables = {}
        for n in np.unique(wide).tolist():
            start = np.flatnonzero((wide == n) & (left >= n))
            h = prints(x, n)[start]
            order = np.lexsort((owner[start], h))
            h, start = h[order], start[order]
            # A window that an item has again is one entry.
            same = np.flatnonzero((h[1:] == h[:-1]) & (owner[start[1:]] == owner[start[:-1]])) + 1
            again = [i for i in same.tolist() if self.words_at(start[i], n) == self.words_at(start[i - 1], n)]
            h, start = np.delete(h, again), np.delete(start, again)
            bits = Bitmap(len(h))
            bits.add(h)
            self.tables[n] = bits, h, start, owner[start].astype(np.int32)

    def prints_of(self, words: list[bytes]):
        import numpy as np

        return self.codes[np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))]

    def words_at(self, start: int, n: int) -> bytes:
        return self.text[self.begin[start] : self.begin[start + n] - 1]

    def scan(self, words: list[bytes]):
        """Which words are inside a window, and the items found."""
        import numpy as np

        x, hit, items = self.prints_of(words), None, set()
        for n, (bits, keys, start, owner) in self.tables.items():
            h, known = prints(x, n), {}
            for i in np.flatnonzero(bits.has(h)).tolist():
                own = b" ".join(words[i : i + n])
                if own not in known:
                    a, b = np.searchsorted(keys, h[i]), np.searchsorted(keys, h[i], "right")
                    good = [e for e in range(a, b) if self.words_at(start[e], n) == own]
                    items.update(self.names[owner[e]] for e in good)
                    known[own] = bool(good)
                if known[own]:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[i : i + n] = True
        items.discard(None)
        return hit, items


def spans_of(text: bytes, hit) -> tuple[list[tuple[int, int]], bytes]:
    """Runs of hit words as spans in code points, and the text without them."""
    import numpy as np

    raw = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8)
    word = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edges[::2], edges[1::2]
    marked = np.concatenate([[False], hit, [False]])
    runs = np.flatnonzero(marked[1:] != marked[:-1])
    first, last = starts[runs[::2]], stops[runs[1::2] - 1]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return list(zip(points[first].tolist(), points[last].tolist())), b"".join(kept)


def _row(text: bytes, words, hit, items, texts: bool) -> dict:
    spans, clean = spans_of(text, hit) if hit is not None else ([], text)
    return {
        "n_words": len(words),
        "n_hit": 0 if hit is None else int(hit.sum()),
        "items": sorted(items),
        "spans": [{"start": a, "stop": b} for a, b in spans],
        "clean_text": clean.decode(errors="replace") if texts else None,
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 8, min_items: int = 2, texts: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids found), spans (of hit words,
    in code points, end exclusive), clean_text (the text without them; null
    where texts is False), n_items and contaminated (n_items >= min_items)."""
    tests = benchmark.select(F.col(item_id).cast("string").alias("item"), utf8(item_text).alias("words"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    scan = _broadcast if size <= broadcast_bytes else _shuffled
    (found,) = aside(docs, "found")
    out = scan(docs, tests, text, width, texts, found)
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "clean_text", "n_items", "contaminated")]
    n_items = F.size(F.col(found)["items"]).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(found)[c].alias(c) for c in ("n_words", "n_hit", "items", "spans", "clean_text")], n_items.alias("n_items"), (n_items >= min_items).alias("contaminated"))


def _broadcast(docs, tests, text, width, texts, found):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    items = [(r[0], r[1].encode()) for r in tests.collect()]  # at most broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, width))

    def scan(column):
        rows = []
        for x in strings(column):
            words = x.translate(ALNUM_TABLE).split()
            rows.append(_row(x, words, *shared.value.scan(words), texts))
        return pa.array(rows, ARROW_RESULT())

    return docs.withColumn(found, F.arrow_udf(scan, StructType.fromDDL(RESULT)).asNondeterministic()(F.col(f"`{text}`").cast("string")))


def ARROW_RESULT():
    import pyarrow as pa

    return pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("clean_text", pa.string())])


GRAM = "at long, span int, gram binary, words binary"


def _grams(words: list[bytes], x, n: int, which):
    """Rows of GRAM for the runs of n words at `which`."""
    import xxhash

    for i in which:
        own = b" ".join(words[i : i + n])
        yield i, n, xxhash.xxh3_128_digest(own), own


def _bitmaps(grams: DataFrame, lengths: list[int], n: int, most: int) -> dict[int, Bitmap]:
    """Bitmaps of the windows of each length, put together from those of the
    tasks, eight bytes at a time: n at most in each, `most` bits in all."""
    import numpy as np

    def mine(batches):
        import pyarrow as pa

        ids, own = WordIds(), {span: Bitmap(n, max(64, most // len(lengths))) for span in lengths}
        for b in batches:
            for span, bits in own.items():
                windows = [x.as_py().split(b" ") for x, k in zip(b.column(1), b.column(0).to_pylist()) if k == span]
                bits.add(np.concatenate([np.empty(0, np.uint64), *(prints(word_prints(x, ids), span) for x in windows)]))
        for span, bits in own.items():
            words = bits.bits.view(np.int64)
            at = np.flatnonzero(words)
            for i in range(0, len(at), 1 << 16):
                some = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"span": pa.array(np.full(len(some), span), pa.int32()), "at": pa.array(some, pa.int64()), "bits": pa.array(words[some], pa.int64())})

    rows = grams.select("span", "words").mapInArrow(mine, "span int, at long, bits long").groupBy("span", "at").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # at most a row for each eight bytes of the bitmaps
    span, at, bits = (found.column(c).to_numpy() for c in ("span", "at", "bits"))
    whole = {k: Bitmap(n, max(64, most // len(lengths))) for k in lengths}
    for k, own in whole.items():
        own.bits.view(np.int64)[at[span == k]] = bits[span == k]
    return whole


def _shuffled(docs, tests, text, width, texts, found, most: int = MAX_BITS):
    """The same by a join on prints of windows, for a benchmark of any size."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    uid, at, item = aside(docs, "uid", "at", "item")
    docs = cut(docs.withColumn(uid, F.monotonically_increasing_id()))
    session = docs.sparkSession.sparkContext

    def of_tests(batches):
        for b in batches:
            rows = []
            for name, x in zip(b.column(0).to_pylist(), strings(b.column(1))):
                words = x.translate(ALNUM_TABLE).split()
                n = min(width, len(words))
                rows += {(name, n, gram, own) for _, n, gram, own in _grams(words, None, n, range(len(words) - n + 1) if n else ())}
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "span", "gram", "words"), r)) for r in rows], pa.schema([("item", pa.string()), ("span", pa.int32()), ("gram", pa.binary()), ("words", pa.binary())]))

    grams = tests.select(F.col("item").cast("string"), "words").mapInArrow(of_tests, "item string, span int, gram binary, words binary")
    grams = cut(grams.groupBy("span", "gram", "words").agg(F.collect_set("item").alias("items")))
    counts = grams.groupBy("span").count().collect()  # a row for each width
    lengths = sorted(r["span"] for r in counts)
    shared = session.broadcast(_bitmaps(grams, lengths, max((r["count"] for r in counts), default=0), most) if lengths else {})

    def of_docs(batches):
        kind = pa.schema([("uid", pa.int64()), ("at", pa.int64()), ("span", pa.int32()), ("gram", pa.binary()), ("words", pa.binary())])
        ids = WordIds()
        for b in batches:
            rows: list = []
            for u, x in zip(b.column(0).to_pylist(), strings(b.column(1))):
                words = x.translate(ALNUM_TABLE).split()
                own = word_prints(words, ids)
                for n, bits in shared.value.items():
                    rows += [(u, *r) for r in _grams(words, own, n, bits.has(prints(own, n)).nonzero()[0].tolist())]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)

    windows = docs.select(F.col(uid).alias("uid"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(of_docs, f"uid long, {GRAM}")
    hits = windows.join(grams, ["span", "gram", "words"]).groupBy(F.col("uid").alias(uid)).agg(F.collect_set(F.struct("at", "span")).alias(at), F.array_distinct(F.flatten(F.collect_set("items"))).alias(item))

    def finish(column, hits, names):
        import numpy as np

        rows = []
        for x, own, items in zip(strings(column), hits.to_pylist(), names.to_pylist()):
            words = x.translate(ALNUM_TABLE).split()
            hit = None
            if own:
                hit = np.zeros(len(words), bool)
                for h in own:
                    hit[h["at"] : h["at"] + h["span"]] = True
            rows.append(_row(x, words, hit, items or [], texts))
        return pa.array(rows, ARROW_RESULT())

    ends = F.arrow_udf(finish, StructType.fromDDL(RESULT)).asNondeterministic()
    return docs.join(hits, uid, "left").withColumn(found, ends(F.col(f"`{text}`").cast("string"), F.col(at), F.col(item))).drop(uid, at, item)
