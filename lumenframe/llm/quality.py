"""Quality rules with risk-controlled thresholds.

Each rule rejects texts beyond a cutoff of one rate (symbols, repeated lines, repeated words, capitals, word
length at either end).  Cutoffs are selected for each stratum from labelled holdouts: along a fixed grid,
from lenient to strict, a cutoff is tested by the exact (Clopper-Pearson) upper bound of the share of
good texts that it rejects, and the last one before the first failure is taken.  Testing in a fixed
sequence needs no correction along the grid; the error level is divided by the number
of rules and strata, and the allowed risk by the number of rules.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches, discard, mix, shingle_hashes, span_hashes, string_bytes, word_hashes, written

#: Fixed values of the contract: characters that count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Steps of the cutoff grid.
GRID = 200
#: Rules: name and the rate, a text statistic brought to 0 to 1 that is high where a text is to be rejected; null where it has no denominator.
RULES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "repeated_lines": "try_divide(n_dup_lines, n_lines)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
    "capitals": "try_divide(n_upper, word_chars)",
    "long_words": "try_divide(word_chars, n_words) / 40",
    "short_words": "1 - try_divide(word_chars, n_words) / 40",
}


def text_stats(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper."""
    n = len(at) - 1
    total = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[at[1:]] - c[at[:-1]]
    inside = ~SPACE[raw]
    words, _, _, w_at = word_hashes(raw, at)
    out = {"n_words": np.diff(w_at), "word_chars": total(inside & ((raw & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[raw]), "n_upper": total(_UPPER[raw])}
    # lines
    heads = at[:-1][at[:-1] < at[1:]]
    starts = np.union1d(heads, np.flatnonzero(raw == 10) + 1)
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    ends = np.where((raw[ends - 1] == 10) if len(ends) else False, ends - 1, ends)
    seen = np.concatenate([[0], np.cumsum(inside)])
    full = seen[ends] > seen[starts]
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(at, starts, "right") - 1
    keys = mix(span_hashes(raw, starts, ends) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n)
    # windows of five words met again
    sh, s_at = shingle_hashes(words, w_at, 5)
    has = out["n_words"] >= 5
    of = np.repeat(np.arange(n), np.diff(s_at))
    keep = has[of]
    place = (np.arange(len(sh)) - s_at[:-1][of] + w_at[:-1][of])[keep]
    _, back, count = np.unique(mix(sh[keep] + of[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    hit = place[count[back] > 1]
    cover = np.zeros(len(words) + 6, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(words)] > 0)])
    out["n_repeat_words"] = covered[w_at[1:]] - covered[w_at[:-1]]
    return out


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, statistics) of every row; null and empty texts have no words and all noughts."""

    def run(it):
        for b in batches(it):
            s = text_stats(*string_bytes(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[k].astype(np.int64)) for k in _STATS)], ["doc_id", "stratum", *_STATS])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{k} long" for k in _STATS))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p under which at most k of n are as likely as delta."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i[1:] + 1) - np.log(i[1:]))])
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p <= 0 or p >= 1:
            break
        terms = logs + i * math.log(p) + (n - i) * math.log1p(-p)
        top = float(terms.max())
        if top + math.log(float(np.exp(terms - top).sum())) > math.log(delta):
            lo = p
        else:
            hi = p
    return hi


def select_cutoffs(counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], risk: float, delta: float) -> dict[tuple[str, str], int]:
    """Of each (stratum, rule) the lowest grid step from which texts may be rejected; GRID + 1 rejects none.

    counts: good and bad labelled texts by grid step.  A cutoff that rejects no bad text is never preferred to a more lenient one.
    """
    out = {}
    rules = max(1, len(RULES))
    tests = max(1, len(counts))
    for key, (good, bad) in counts.items():
        n, best = int(good.sum()), GRID + 1
        for step in range(GRID, 0, -1):
            if upper_bound(int(good[step:].sum()), n, delta / tests) > risk / rules:
                break
            if bad[step:].sum() > (bad[best:].sum() if best <= GRID else 0):
                best = step
        out[key] = best
    return out


def _step(rule: str):
    return F.expr(f"cast(coalesce(least({GRID}D, greatest(0D, cast(ceil(({RULES[rule]}) * {GRID}) as double))), 0D) as int)")


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.02, delta: float = 0.05, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """(doc_id, stratum, statistics, base_failed, kept) of every row.

    Base rules reject texts of fewer than ``min_words`` words or with more than ``repeat_percent`` per cent of
    words repeated; of the others each stratum's cutoffs reject at most a share of ``risk`` of good texts, with
    confidence 1 - ``delta`` over all strata and rules.  Strata with too few labels (the null one too, like any
    other) have cutoffs that reject none.  Null labels and ids are left out; ids labelled twice count by the higher label.
    """
    stats = written(measured(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "quality-stats")
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    stats = stats.withColumn("stratum", F.coalesce("stratum", F.lit("")))
    steps = stats.select("*", *[_step(r).alias(f"step_{r}") for r in RULES])
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES])).alias("p")
    seen = steps.where("NOT base_failed").join(known, "doc_id").select("stratum", "label", pairs).groupBy("stratum", "p.rule", "p.step").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    # counted by stratum, rule and step in a table of its own, as the filter below would else be pushed under the counting and deal its rows by stratum
    seen = written(seen, "quality-counts")
    # a stratum needs enough good texts for its bound to hold at all: that bounds the rows to collect
    least = math.ceil(math.log(1 / delta) / (risk / len(RULES)))
    enough = seen.where("rule = 'symbols'").groupBy("stratum").agg(F.sum("good").alias("g")).where(F.col("g") >= least).select("stratum")
    counts: dict = {}
    for r in seen.join(enough, "stratum", "left_semi").collect():
        good, bad = counts.setdefault((r.stratum, r.rule), (np.zeros(GRID + 1, np.int64), np.zeros(GRID + 1, np.int64)))
        good[r.step] += r.good
        bad[r.step] += r.n - r.good
    discard(seen)
    cut = select_cutoffs(counts, risk, delta)
    strata = sorted({k[0] for k in cut})
    spark = docs.sparkSession
    table = spark.createDataFrame([(s, *[cut.get((s, r), GRID + 1) for r in RULES]) for s in strata], "cut_stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))
    judged = steps.join(F.broadcast(table), F.col("stratum") == F.col("cut_stratum"), "left")  # as many rows as strata with labels enough
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"step_{r}") >= F.coalesce(F.col(f"cut_{r}"), F.lit(GRID + 1)))
    return judged.select("doc_id", "stratum", *_STATS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op7_quality_rules(spark, sf_dir):
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
