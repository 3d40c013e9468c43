"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and pairs of words in 2^16
buckets) are counted: the raw model over all documents, the target model over
documents labelled good, of which MAX_LABELS at most are read (those whose ids
hash lowest, a fixed sample). A sample says little about rare buckets, so the
target model is the raw one times a ratio for each bucket that is estimated
under a Gamma prior of mean 1 and weight PRIOR: (n-grams of the target +
PRIOR) / (those expected of it by the raw model + PRIOR). The log importance
of a document is the sum of log(target / raw) over its n-grams. With Gumbel noise drawn from a hash of the id, the top k are a sample without
replacement in proportion to the importances; k is the share of good labels
times the number of documents. Reruns agree.

Texts are read twice, once to count and once to score, where the result has
few other columns (`keep`): it is then kept in a table in the shared folder. A
result with the texts themselves isn't copied there but scored again from the
input. The k-th key is found by counting keys in ranges
that narrow, never by sorting or collecting them. Models are of fixed size.

Defined cases: a null or empty text has importance 0; very long texts count
whole; a null id draws its noise as an id of its own, and rows of one id share
theirs; rows with the k-th key are all kept; without a label nothing is
rejected; a document with several labels is good if one says so; an empty
table gives no rows; other columns pass through, and those with an output's
name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import WordIds, cut, strings

BITS, PRIOR, MAX_LABELS, SEED = 16, 64.0, 20_000, 6
RANGES = 4096


def buckets(words: list[bytes], ids: WordIds):
    """The buckets of the words and of the pairs of neighbours."""
    import numpy as np

    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    h = np.concatenate([x, x[:-1] * np.uint64(3) + x[1:]]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def models(docs: DataFrame, good: DataFrame, text: str, doc_id: str):
    """n-grams of all documents and of the good ones, by bucket, as arrays of
    fixed size. good: at most MAX_LABELS ids, in a column `good_id`."""
    import numpy as np

    mine = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    mine = mine.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))

    def count(batches):
        import pyarrow as pa

        ids, raw, target = WordIds(), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for x, g in zip(strings(b.column(0)), b.column(1).to_pylist()):
                found = np.bincount(buckets(x.split(), ids), minlength=0)
                raw[: len(found)] += found
                if g:
                    target[: len(found)] += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "raw": raw[at], "target": target[at]})

    rows = mine.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # 2^BITS rows at most
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    return raw, target


def log_ratios(raw, target, prior: float = PRIOR):
    """Log of target over raw for each bucket; 0 where raw has none (no
    document has it), and everywhere without a target."""
    import numpy as np

    if not target.sum():
        return np.zeros(len(raw))
    share = raw / raw.sum()
    ratio = (target + prior) / (target.sum() * share + prior)
    return np.where(raw > 0, np.log(ratio / (share * ratio).sum()), 0.0)


def gumbel(doc_id: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(f"`{doc_id}`")), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def kth_largest(keys: DataFrame, name: str, k: int) -> float | None:
    """The k-th largest of a column of doubles without nulls (None: all are
    taken), by counting in ranges that narrow to it."""
    lo, hi, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf")
    above = 0  # keys over hi
    while lo < hi:
        width = (hi - lo) / RANGES
        if width == 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col(name) - lo) / width), F.lit(RANGES - 1))
        inside = keys.filter((F.col(name) >= lo) & (F.col(name) <= hi))
        found = inside.groupBy(at.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy(F.desc("r")).collect()  # RANGES rows at most
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if above + r["n"] == k:
            return r["lo"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
    return lo


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: Column | None = None, max_labels: int = MAX_LABELS, keep: list[str] | None = None) -> DataFrame:
    """docs with importance (a log), sample_key (with its noise) and kept.
    good: of labels; by default that quality is 1. keep: the columns of docs
    in the result, all by default."""
    good = F.coalesce(good if good is not None else F.col("quality") == 1, F.lit(False))
    marks = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("good_id")).agg(F.max(good).alias("good"))
    n, n_good = marks.agg(F.count(F.lit(1)), F.count(F.when(F.col("good"), 1))).first()
    chosen = marks.filter("good").orderBy(F.xxhash64(F.lit(SEED), "good_id"), "good_id").limit(max_labels).select("good_id")
    raw, target = models(docs, chosen, text, doc_id)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target))
    made: list = []

    def score(column):
        import pyarrow as pa

        if not made:
            made.append(WordIds())
        return pa.array([float(ratios.value[buckets(x.split(), made[0])].sum()) for x in strings(column)], pa.float64())

    udf = F.arrow_udf(score, "double").asNondeterministic()
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("importance", "sample_key", "kept")]
    noise = gumbel(doc_id).alias("sample_key")
    scored = docs.select(*[f"`{c}`" for c in names], udf(F.col(f"`{text}`").cast("string")).alias("importance"), noise)
    scored = scored.withColumn("sample_key", F.col("importance") + F.col("sample_key"))
    if text in names:
        keys = cut(scored.select("sample_key"))
    else:
        keys = scored = cut(scored)
    least = kth_largest(keys.select("sample_key"), "sample_key", round(keys.count() * n_good / n)) if n else None
    kept = F.lit(True) if least is None else F.col("sample_key") >= F.lit(least)
    return scored.withColumn("kept", kept)
