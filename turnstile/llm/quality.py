"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised traversal."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import giving_back, hash_share, text_slices

SAMPLE_ROWS = 20_000    # bound: labelled rows learned from, on average
TREES, DEPTH, BINS = 120, 5, 64
RATE, L2, LEAST_HESSIAN = 0.1, 1.0, 2.0
THRESHOLD = 0.3         # scores from here on are predicted as good

FEATURES = [
    "log_chars", "log_words", "word_length", "long_words", "short_words", "letters", "upper", "digits", "spaces",
    "marks", "rare_marks", "sentence_ends", "commas", "line_breaks", "log_line", "short_lines", "repeated_lines",
    "distinct_words", "top_word", "doubled_words", "distinct_pairs", "upper_words", "marked_ends", "markless_words",
    "bare_marks", "char_entropy", "word_entropy", "longest_word", "same_chars", "brackets", "bullet_lines",
    "worst_marks", "worst_upper", "worst_doubled",
]

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 letter, 2 upper, 3 digit, 4 space, 5 everyday mark, 6 rare mark
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x80, 0x100)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[*b".,;:'\"!?()-"]] = 5
_CLASS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 6
PASSAGE = 64  # words per passage of the worst-passage statistics


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text, in the order of FEATURES;
    zeros for a null or empty text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    n, w = len(raw), len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    tally = Counter(words)
    top = max(tally.values())
    word_counts = np.fromiter(tally.values(), dtype=np.int64, count=len(tally))
    doubled = np.fromiter(map(str.__eq__, words, words[1:]), dtype=bool, count=w - 1)
    upper = np.fromiter(map(str.isupper, words), dtype=bool, count=w)
    marked = np.fromiter((not x[-1].isalnum() and x[-1] not in ".,;:!?'\")]" for x in words), dtype=bool, count=w)
    plain = np.fromiter(map(str.isalpha, words), dtype=bool, count=w)
    bare = np.fromiter((not any(map(str.isalnum, x)) for x in words if len(x) < 4), dtype=bool)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x] or [""]
    line_counts = Counter(lines)
    starts = np.arange(0, w, PASSAGE)
    sizes = np.diff(np.append(starts, w))

    def worst(flags: np.ndarray) -> float:
        own = np.add.reduceat(flags.astype(np.int64), starts) / np.maximum(sizes, PASSAGE // 2)
        return float(own.max())

    return [
        math.log1p(n), math.log1p(w), float(lengths.mean()), float((lengths > 12).mean()), float((lengths < 3).mean()),
        kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        (counts[0x2E] + counts[0x21] + counts[0x3F]) / w, counts[0x2C] / w, counts[0x0A] / w,
        math.log1p(n / len(lines)), sum(len(x) < 20 for x in lines) / len(lines), 1 - len(line_counts) / len(lines),
        len(tally) / w, top / w, float(doubled.mean()) if w > 1 else 0.0,
        len(set(zip(words, words[1:]))) / max(1, w - 1), float(upper.mean()), float(marked.mean()),
        float(plain.mean()), float(bare.sum()) / w, _entropy(counts), _entropy(word_counts) / math.log2(w + 1),
        math.log1p(int(lengths.max())), float(counts.max()) / n,
        (counts[0x28] + counts[0x5B] + counts[0x7B] + counts[0x3C]) / w,
        sum(x[:1] in "-*•|#>" for x in lines if x) / len(lines),
        worst(marked | np.isin(lengths, [1]) & ~plain), worst(upper & (lengths > 1)),
        worst(np.append(doubled, False)),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node k of a tree has children 2k+1 and 2k+2; a
    row goes left where its feature is at most the threshold."""
    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    leaf: np.ndarray       # (trees, leaves)
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row; all rows of a tree level at once."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Second-order boosting of the logistic loss on binned features.  Without
    rows, or with one label only, the model is that label's smoothed share."""
    prior_p = (y.sum() + 1) / (len(y) + 2)
    prior = math.log(prior_p / (1 - prior_p))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * BINS
    total = np.full(n, prior)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            hg = np.bincount(cell, weights=np.repeat(g, m), minlength=width * m * BINS).reshape(width, m, BINS)
            hh = np.bincount(cell, weights=np.repeat(h, m), minlength=width * m * BINS).reshape(width, m, BINS)
            lg, lh = hg.cumsum(axis=2), hh.cumsum(axis=2)
            tg, th = lg[:, :1, -1:], lh[:, :1, -1:]
            gain = lg ** 2 / (lh + L2) + (tg - lg) ** 2 / (th - lh + L2) - tg ** 2 / (th + L2)
            gain[(lh < LEAST_HESSIAN) | (th - lh < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split_bin = np.full(inner, BINS)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k], split_bin[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split_bin[node])
        leaf_of = node - inner
        value = -RATE * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + L2)
        total += value[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), prior)


def _statistics_of(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept),
                     pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(giving_back(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on a bounded sample of labelled documents, drawn by a hash of the id.

    Rows with a null id or label teach nothing; an id with several labels
    teaches their smallest, an id with several texts the smallest text.  The
    sampled labels are bounded by ``sample_rows``, so they go to the texts, and
    only texts of the sample are shuffled.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
                .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    share = min(1.0, sample_rows / max(1, own.count()))
    own = own.where(hash_share(F.col("doc_id"), share))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
               .join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = _statistics_of(rows, "text", "x").toPandas()
    if sample.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(sample["x"].to_numpy())
    order = np.lexsort((*x.T, sample["doc_id"].to_numpy()))
    return fit(x[order], (sample["label"].to_numpy()[order] > 0).astype(float))


def score_documents(docs: DataFrame, model: Forest, text_col: str = "text", score_col: str = "score",
                    pred_col: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``.

    Every whole text is scored; null and empty texts share one score.
    Existing columns of the two result names are replaced; every other column
    passes through unchanged.  An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in (score_col, pred_col)]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, T.StructField(score_col, T.DoubleType()),
                           T.StructField(pred_col, T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB at most

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                score = shared.value.score(np.array([statistics(t) for t in texts]).reshape(len(texts), -1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=schema.names)

    return src.mapInArrow(giving_back(run), schema)
