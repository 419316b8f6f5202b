"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting fits one shallow tree a round to each feature in turn, on the
gradient of the logistic loss, and adds its leaves to the feature's lookup table. Then the pairs of features that lower the
loss most get tables of their own, fitted the same way on two-dimensional bins. A score is the logistic of an intercept plus
one table entry for each feature and pair, added up for a whole batch at once.

Features come from the text alone. The model is fitted on the driver on at most MOST_ROWS labelled rows, those with the
least hash of their identifier; its tables have a fixed size and go to the tasks in the closure. Everything else, the
features included, covers all rows where they are read; texts are never shuffled.

Defined results: null and empty texts have the features of an empty text and get a score; labels that are null do not count
and several labels for one document count by the lowest; without two classes to learn from, every score is the share of
good labels (0.5 without labels); repeated rows get one score each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm._text import batches, counts, string_buffers
from leafline.llm.quality_rules import COUNTS, measure
from leafline.session import cut, ship

#: Labelled rows that the model is fitted on at most.
MOST_ROWS = 60_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 32, 8, 8, 120, 60, 0.15, 4, 5.0
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "bars", "digits", "stops", "commas", "non_ascii", "line_words", "lead_capitals")


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _STOP, _COMMA, _HIGH = _class(range(48, 58)), _class(b".?;:"), _class(b","), _class(range(0xC2, 0xF5))
_UP, _DOWN = _class(range(65, 91)), _class(range(97, 123))


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of the texts in a buffer, one row for each."""
    m = dict(zip(COUNTS, measure(data, off), strict=True))
    w, c, lines = np.maximum(1, m["n_words"]), np.maximum(1, m["word_chars"]), np.maximum(1, m["n_lines"])
    lead = np.zeros(len(data), bool)
    if len(data) > 1:
        lead[:-1] = _UP[data[:-1]] & _DOWN[data[1:]]
    return np.column_stack(
        [
            np.log2(1 + m["n_words"]), m["word_chars"] / w, m["n_symbols"] / c, m["n_dup_lines"] / lines, m["n_repeat_words"] / w, m["n_upper"] / c, m["n_exclaim"] / w, m["n_bars"] / w,
            counts(_DIGIT[data], off) / c, counts(_STOP[data], off) / w, counts(_COMMA[data], off) / w, counts(_HIGH[data], off) / c, m["n_words"] / lines, counts(lead, off) / w,
        ]
    )


@dataclass
class Model:
    """Bin edges, and lookup tables of features and of pairs of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        b = self.bins(x) if self.edges else []
        for j, t in enumerate(self.tables):
            out += t[b[j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse(b[i], self.edges[i]), coarse(b[j], self.edges[j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of a pair table from bins of a feature."""
    return b * PAIR_BINS // (len(edges) + 1)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree on ordered bins: the best splits one after the other; returns the value at each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)

    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        top, at = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = worth(a, s) + worth(s, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > top:
                    top, at = gain[k], int(s[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-dimensional table: (gain, value at each cell)."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    four = []
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        r0, r1 = (i, np.full_like(i, g.shape[0])) if a else (np.zeros_like(i), i)
        c0, c1 = (j, np.full_like(j, g.shape[1])) if b else (np.zeros_like(j), j)
        four.append([c[r1, c1] - c[r0, c1] - c[r1, c0] + c[r0, c0] for c in (cg, ch)])
    gain = sum(x * x / (y + RIDGE) for x, y in four)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (x, y), (a, b) in zip(four, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True):
        out[slice(r + 1, None) if a else slice(0, r + 1), slice(c + 1, None) if b else slice(0, c + 1)] = x[r, c] / (y[r, c] + RIDGE)
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    return float(gain[r, c] - whole), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for features x and labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    model = Model(float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        inner = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        tail = np.unique(np.quantile(x[:, j], [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]))
        model.edges.append(np.unique(np.concatenate([inner, tail, [1e-9]])))
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * tree(np.bincount(b[j], y - p, len(t)), np.bincount(b[j], p * (1 - p), len(t)))
            t += step
            margin += step[b[j]]
    small = [coarse(b[j], e) for j, e in enumerate(model.edges)]
    p = 1 / (1 + np.exp(-margin))

    def table(i, j, v):
        return np.bincount(small[i] * PAIR_BINS + small[j], v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    gains = sorted(((quadrants(table(i, j, y - p), table(i, j, p * (1 - p)))[0], i, j) for i in range(len(b)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * quadrants(table(i, j, y - p), table(i, j, p * (1 - p)))[1]
            t += step
            margin += step[small[i], small[j]]
    return model


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and FEATURES of every row."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(it):
        for whole in it:
            for batch in batches(whole, "text"):
                x = features(*string_buffers(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["key", *FEATURES])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(key) -> object:
    """Whether a document is kept from fitting: crc32 of its identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(table: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fits the model on labelled rows that are not held out."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
    rows = table.where(~held_out("key")).join(marks, F.col("key") == F.col("_id")).select(F.xxhash64("key").alias("_h"), "key", "_y", *FEATURES)
    # a bound on the hash lets about twice the wanted rows through, so that no task merges the candidates of all others
    n = rows.count()
    near = rows.where(F.col("_h") < F.lit(int(2**64 * 2 * most / n - 2**63))) if n > 4 * most else rows
    if n > 4 * most and near.count() < most:
        near = rows
    rows = near.orderBy("_h", "key", *FEATURES).limit(most)
    got = rows.toPandas()
    return fit(got[list(FEATURES)].to_numpy(float), (got["_y"] == 1).to_numpy(float))


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_ROWS) -> DataFrame:
    """key, held_out, score and predicted for every row."""
    table = cut(featured(docs, key, text), "gam-features")
    model = train(table, labels, most)

    def run(it):
        for batch in it:
            x = np.column_stack([batch.column(j + 1).to_numpy() for j in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])

    out = table.mapInArrow(run, f"key {table.schema['key'].dataType.simpleString()}, score double")
    return out.select("key", held_out("key").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
