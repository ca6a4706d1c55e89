"""Quality rules whose cutoffs are chosen on labelled holdouts with a bounded risk of false rejection (operator 12).

A rule rejects a document whose ratio (symbols a word, characters a word, repeated lines a line, repeated words a word) is above a cutoff
of a fixed grid. For each stratum (language) and rule the cutoffs are tested on held-out labelled texts from the most lenient on: the
exact binomial bound says whether so few of the stratum's good texts would be rejected if a share above risk / rules of them were
rejected in truth, with probability at most delta / (strata x rules) (Bonferroni). The first cutoff that fails ends the line
(fixed-sequence testing), so with probability 1 - delta every certified cutoff of every stratum rejects at most risk / rules of its good texts, and
all rules together at most risk. Among the certified cutoffs, the one that gains most on the other labelled texts is taken: bad texts rejected less
GOOD_COST times the good ones; none if that isn't above 0. Equal labelled texts of a language count once, as a copy is no further
evidence, and lie on one side of the split; they are good if any of their labels says so.

Texts are measured where they are read, in one pass; all that follows is grouped counts of a row a stratum, rule and cutoff.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut
from .tokens import Chunk, chunks, grams, text_array

RISK, DELTA, GOOD_COST = 0.05, 0.05, 4
#: One in FOLDS labelled texts is for choosing, the others are the holdout.
FOLDS = 4
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
WORD = re.compile(r"[^\x20\x09-\x0D]")
#: Rules: numerator, denominator and cutoffs, in thousandths, the strictest first.
RULES = {
    "symbols": ("n_symbols", "n_words", (10, 20, 50, 100, 200, 300, 500, 1000, 2000)),
    "long_words": ("word_chars", "n_words", tuple(range(5000, 16000, 500))),
    "repeated_lines": ("n_dup_lines", "n_lines", tuple(range(50, 1000, 50))),
    "repeated_words": ("n_repeat_words", "n_words", tuple(range(20, 520, 20))),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(c: Chunk) -> np.ndarray:
    """COUNTS of the chunk's documents."""
    n = len(c)
    out = np.zeros((n, len(COUNTS)), np.int64)
    b, bytes_at = c.word_bounds, c.bounds
    out[:, 0] = np.diff(b)
    points = np.concatenate([[0], np.cumsum((c.raw & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(points[c.ends] - points[c.starts])])
    out[:, 1] = chars[b[1:]] - chars[b[:-1]]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[c.raw])])
    out[:, 2] = symbols[bytes_at[1:]] - symbols[bytes_at[:-1]]
    h = c.hashes()
    for i in range(n):
        raw = c.raw[bytes_at[i]:bytes_at[i + 1]].tobytes()
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out[i, 3], out[i, 4] = len(lines), len(lines) - len(set(lines))
        g = grams(h[b[i]:b[i + 1]], 3)
        if len(g) > 1:
            _, kind, times = np.unique(g, return_inverse=True, return_counts=True)
            edge = np.zeros(len(g) + 3, np.int64)
            at = np.flatnonzero(times[kind] > 1)
            edge[at] += 1
            edge[at + 3] -= 1
            out[i, 5] = np.count_nonzero(np.cumsum(edge))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: ''), COUNTS and text_key (60 bits of the text's MD5) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in (*COUNTS, "text_key"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_array(batch.column(2))
            parts = [measure(c) for c in chunks(text)]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            keys = [int(hashlib.md5(t.as_buffer() if t.as_buffer() is not None else b"").hexdigest()[:15], 16) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(keys, pa.int64())], names=["doc_id", "lang", *COUNTS, "text_key"])

    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def steps(rule: str) -> Column:
    """How many of the rule's cutoffs, from the most lenient on the last ones of the grid, lie below the document's ratio."""
    top, bottom, grid = RULES[rule]
    return sum(((F.col(top) * 1000 > F.col(bottom) * x).cast("int") for x in grid), F.lit(0))


def lower_tail(k: int, n: int, share: float) -> float:
    """P(X <= k) of a binomial variable: its terms from k downwards, until they no longer count. 1 where k is at or above the mean, where the
    tail is no evidence."""
    if k >= n * share:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
    total, i = term, k
    while i > 0 and term > total * 1e-18:
        term *= i / (n - i + 1) * (1 - share) / share
        total += term
        i -= 1
    return min(total, 1.0)


def tails(df: DataFrame, share: float) -> DataFrame:
    """df (a row a stratum, rule and cutoff) plus p of k and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [lower_tail(k, n, share) for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist())]
            yield batch.append_column("p", pa.array(p, pa.float64()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, good_cost: int = GOOD_COST) -> DataFrame:
    """lang, rule, cutoff (thousandths), place (in the grid): the cutoff that is taken, where there is one."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = found.where(~base_failed()).join(good, "doc_id").groupBy("lang", "text_key").agg(F.max("quality").alias("quality"), *(F.first(c).alias(c) for c in COUNTS))
    held = F.col("text_key") % FOLDS != 0
    each = rows.select("lang", held.alias("held"), (F.col("quality") > 0).alias("good"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), steps(r).alias("steps")) for r in RULES))).alias("x")).select("lang", "held", "good", "x.*")
    hist = cut(each.groupBy("lang", "rule", "steps").agg(F.count_if(F.col("held") & F.col("good")).alias("held_good"), F.count_if(~F.col("held") & F.col("good")).alias("good"), F.count_if(~F.col("held") & ~F.col("good")).alias("bad")), "quality_counts")
    strata = hist.where("held_good > 0").select("lang").distinct().count()
    # a row a stratum, rule and cutoff; a text is rejected by the cutoff at `place` if its steps are more
    grid = F.element_at(F.create_map(*(y for r in RULES for y in (F.lit(r), F.array(*(F.lit(x) for x in RULES[r][2]))))), F.col("rule"))
    over = hist.groupBy("lang", "rule").agg(F.sum("held_good").alias("n"), F.collect_list(F.struct("steps", "held_good", "good", "bad")).alias("h")).where("n > 0").select("lang", "rule", "n", "h", F.posexplode(grid).alias("place", "cutoff"))
    total = lambda c: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["steps"] > F.col("place"), x[c]).otherwise(0))
    curve = over.select("lang", "rule", "place", "cutoff", "n", total("held_good").alias("k"), (total("bad") - good_cost * total("good")).alias("gain"))
    level = delta / max(1, strata * len(RULES))
    tested = tails(curve, risk / len(RULES)).withColumn("passed", F.col("p") <= level)
    lenient_first = Window.partitionBy("lang", "rule").orderBy(F.desc("place"))
    certified = tested.withColumn("ok", F.min("passed").over(lenient_first)).where("ok AND gain > 0")
    best = Window.partitionBy("lang", "rule").orderBy(F.desc("gain"), F.desc("place"))
    return certified.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("lang", "rule", "cutoff", "place")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and reason (base or the first rule that rejects, else null) of every row.

    Null and empty texts have no words and fail the base; a null language is a stratum of its own (''). Labels without a doc_id or a quality are
    left out, of several for a document one good one suffices; a row whose doc_id repeats is labelled each time. A stratum with too few
    labelled good texts for any bound keeps all that the base keeps, and so does every stratum without labels. Texts of any length are measured whole; repeated
    rows are judged each; other columns are ignored; empty input gives no rows."""
    found = cut(features(docs), "features")
    chosen = cutoffs(found, labels, risk, delta)
    wide = chosen.groupBy("lang").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    out = found.join(wide, "lang", "left")
    beyond = [(F.col(top) * 1000 > F.col(bottom) * F.col(r), r) for r, (top, bottom, _) in RULES.items()]
    reason = F.when(base_failed(), "base")
    for hit, r in beyond:
        reason = reason.when(hit, r)
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))
