"""Quality rules with risk-controlled thresholds.

Rules are shares of a text (symbols, repeated lines, repeated words, capitals, exclamation marks, cell bars): larger is
worse. In each stratum one cutoff holds for all rules, and a document goes when any of its shares is above it. Cutoffs are
tried from the loosest on against labelled documents; one is certified while the exact binomial (Clopper-Pearson) upper
bound of the rate at which it rejects good documents that the base rules pass, by any rule, stays within RISK. The level is
corrected for the strata (Bonferroni); the cutoffs form a fixed sequence and the rules are certified together, so neither
needs a further correction. Of the certified cutoffs the one that rejects
most bad documents holds, the loosest on ties; a stratum with too few good labels (needed_labels) has no cutoff and only
the base rules reject there.

Defined results: null text has no words and fails the base rules; null strata form a stratum; labels that are null do not
count, of several labels for one document the lowest holds; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, exp, inf, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm._text import SPACE, batches, counts, mix, owner, span_hashes, string_buffers, window_hashes, words
from leafline.session import cut, fresh, ship

U = np.uint64
#: Shares are held in so many steps.
STEPS = 512
#: False rejections among good documents of a stratum that all rules together may add to the base rules, and the error probability.
RISK, DELTA = 0.02, 0.05
#: Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000
MIN_WORDS, REPEAT_PERCENT = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Numerator and denominator of each rule's share, in the order of their cutoffs.
SHARES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "word_chars"), "exclaims": ("n_exclaim", "n_words"), "bars": ("n_bars", "n_words")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_bars")


def measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of the texts in a buffer."""
    n = len(off) - 1
    starts, ends, first = words(data, off)
    h = span_hashes(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    # lines
    cuts = np.flatnonzero(data == 10)
    filled = off[:-1][np.diff(off) > 0]
    begin = np.unique(np.concatenate([filled, cuts + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), len(data)) if len(begin) else begin
    at = np.searchsorted(cuts, begin)
    stop = np.minimum(stop, np.where(at < len(cuts), cuts[np.minimum(at, max(0, len(cuts) - 1))], len(data))) if len(cuts) else stop
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[has], stop[has]
    of = np.searchsorted(off, begin, "right") - 1
    lines = np.bincount(of, minlength=n)
    keys = mix(span_hashes(data, begin, stop, 7) ^ mix(of.astype(np.uint64) + U(1)))
    _, one = np.unique(keys, return_index=True)
    distinct = np.bincount(of[one], minlength=n)
    # words in 5-word windows that come twice
    win = window_hashes(h, 5)
    covered = np.zeros(len(h), bool)
    if len(win):
        doc = owner(first)
        inside = np.flatnonzero(doc[: len(win)] == doc[4:])
        key = mix(win[inside] ^ mix(doc[inside].astype(np.uint64) + U(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        dup = np.zeros(len(h), bool)
        dup[inside[twice]] = True
        covered = dup.copy()
        for j in range(1, 5):
            covered[j:] |= dup[:-j]
    return [np.diff(first), counts(lead & ~SPACE[data], off), counts(_SYMBOL[data], off), lines - distinct, counts(covered, first), lines, counts(_UPPER[data], off), counts(data == 33, off), counts(data == 124, off)]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and COUNTS for every row."""
    ship(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("_text"))

    def run(it):
        for whole in it:
            for batch in batches(whole, "_text"):
                got = measure(*string_buffers(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(g.astype(np.int64)) for g in got]], [*keep, *COUNTS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]] + [f"{c} long" for c in COUNTS])
    return slim.mapInArrow(run, schema)


def rules() -> dict[str, Column]:
    """Each rule's value as a step from 0 to STEPS."""

    return {n: F.least(F.lit(STEPS), F.floor(F.lit(STEPS) * F.col(a) / F.greatest(F.lit(1), F.col(b)))).cast("int") for n, (a, b) in SHARES.items()}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly summed."""
    if k >= n:
        return 1.0
    total, lp, lq = 0.0, log(p), log1p(-p)
    for i in range(k + 1):
        total += exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * lp + (n - i) * lq)
    return min(1.0, total)


def certified(rejected: int, good: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound of the false-rejection rate at level delta is within risk."""
    return good > 0 and rejected <= risk * good and binomial_cdf(rejected, good, risk) <= delta


def choose(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int | None:
    """The cutoff (documents with a value above it go) from histograms over 0..STEPS of good and bad documents, or None."""
    total = int(good.sum())
    best, most = None, 0
    above_good = above_bad = 0
    for cutoff in range(STEPS - 1, -1, -1):
        above_good += int(good[cutoff + 1])
        above_bad += int(bad[cutoff + 1])
        if not certified(above_good, total, risk, delta):
            break
        if above_bad > most:
            best, most = cutoff, above_bad
    return best


def base_failed() -> Column:
    """Whether a document is too short or repeats too much."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def cutoffs(values: DataFrame, labels: DataFrame, key: str, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and its cutoff for all rules (null: they reject nothing there), from labelled documents."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    # a document goes when its worst share is above the cutoff; one that fails the base rules goes without it
    worst = F.when(base_failed(), F.lit(0)).otherwise(F.greatest(*[F.col(f"_{n}") for n in rules()]))
    held = values.join(marks, F.col(key) == F.col("_id")).select(F.col(stratum).alias("stratum"), "quality", worst.alias("step"))
    hist = cut(held.groupBy("stratum", "step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")), "rule-histogram")
    strata = max(1, hist.select("stratum").distinct().count())
    kind = hist.schema["stratum"].dataType.simpleString()

    def pick(pdf):
        import pandas as pd

        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        np.add.at(good, pdf["step"].to_numpy(), pdf["good"].to_numpy())
        np.add.at(bad, pdf["step"].to_numpy(), pdf["bad"].to_numpy())
        return pd.DataFrame([{"stratum": pdf["stratum"].iloc[0], "cutoff": choose(good, bad, risk, delta / strata)}]).astype({"cutoff": "Int64"})

    table = hist.groupBy("stratum").applyInPandas(pick, f"stratum {kind}, cutoff long")
    table = cut(table, "cutoffs")
    return F.broadcast(table) if strata <= BROADCAST_STRATA else table


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """key, COUNTS, base_failed, kept and failed (names of the rules that reject) for every row."""
    values = measured(docs, [key, stratum], text).withColumns({f"_{n}": c for n, c in rules().items()})
    values = cut(values, "rule-values")
    table = cutoffs(values, labels, key, stratum, risk, delta)
    joined = values.join(table, values[stratum].eqNullSafe(table["stratum"]), "left")
    failed = F.filter(F.array(*[F.when(F.col(f"_{n}") > F.col("cutoff"), F.lit(n)) for n in rules()]), lambda x: x.isNotNull())
    return joined.select(values[key], *COUNTS, base_failed().alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns: cutoffs are learnt first, then applied to each row where it is read, so texts are never shuffled."""
    values = measured(docs, [key, stratum], text).withColumns({f"_{n}": c for n, c in rules().items()})
    table = cutoffs(cut(values, "rule-values"), labels, key, stratum)
    return _applied(docs, table, stratum, text)


def _applied(docs: DataFrame, table: DataFrame, stratum: str, text: str) -> DataFrame:
    own, limit_ = fresh(docs.columns, "rule_stratum", "rule_cutoff")
    slim = table.select(F.col("stratum").alias(own), F.col("cutoff").alias(limit_))
    joined = docs.join(slim, docs[stratum].eqNullSafe(slim[own]), "left").drop(own)
    columns = docs.columns
    at, n_docs = joined.columns.index(text), len(columns)

    def run(it):
        for whole in it:
            for batch in batches(whole, text):
                m = dict(zip(COUNTS, measure(*string_buffers(batch.column(at))), strict=True))
                ok = (m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= REPEAT_PERCENT * m["n_words"])
                limit = batch.column(n_docs).cast(pa.float64()).fill_null(inf).to_numpy(zero_copy_only=False)
                for a, b in SHARES.values():
                    step = np.minimum(STEPS, STEPS * m[a] // np.maximum(1, m[b]))
                    ok &= ~(step > limit)
                yield pa.RecordBatch.from_arrays(batch.columns[:n_docs], columns).filter(pa.array(ok))

    return joined.mapInArrow(run, docs.schema)


def needed_labels(strata: int, n_rules: int, risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels without a false rejection that a stratum needs before any cutoff can be certified."""
    return ceil(log(delta / (strata * n_rules)) / log1p(-risk / n_rules))
