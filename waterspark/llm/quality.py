"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import map_slices, text_of

#: Labelled documents that the model is fitted on, chosen by a hash of their ids, and the
#: most neighbouring lines of one that enter the fit (from a place chosen by its length).
SAMPLE_DOCS = 4000
SAMPLE_LINES = 48
STEPS = 120
SLICE_CHARS = 1_000_000
#: Documents below this score are of low quality.
THRESHOLD = 0.3

#: Classes of bytes whose shares describe a line; bytes of letters beyond ASCII count as
#: lower case.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "odd": b"#$%&*+/<=>@[\\]^_`{}~"}
FEATURES = [*CLASSES, "length", "word", "distinct", "repeated", "ends", "short"]
WIDTH = len(FEATURES)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes, lines of each text).

    Lines are cut at line feeds; an empty text is one empty line.
    """
    lines, counts, repeated, distinct, words = [], [], [], [], []
    for text in texts:
        own = text.split(b"\n")
        seen: set[bytes] = set()
        for line in own:
            cut = line.split()
            words.append(len(cut))
            distinct.append(len(set(cut)))
            repeated.append(line in seen)
            seen.add(line)
        lines += own
        counts.append(len(own))
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    flat = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    starts = np.append(0, np.cumsum(lengths + 1)[:-1])
    size = np.maximum(lengths, 1)
    words_, distinct_ = np.maximum(np.array(words), 1), np.maximum(np.array(distinct), 1)
    columns = []
    for members in CLASSES.values():
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        columns.append(np.sqrt(np.add.reduceat(table[flat], starts, dtype=np.int64) / size))
    last = flat[np.maximum(starts + lengths - 1, starts)]
    columns += [
        np.log1p(lengths) / 8,
        np.minimum(lengths / words_, 40) / 20,
        np.log(words_ / distinct_) / np.log1p(words_),
        np.array(repeated, dtype=np.float64),
        np.isin(last, list(b".!?:;\"")).astype(np.float64),
        (lengths < 20).astype(np.float64),
    ]
    return np.stack(columns, axis=1), lengths, np.array(counts)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the features of the lines before and after within the document, their
    differences to it, and a constant."""
    first = np.append(0, np.cumsum(counts)[:-1])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + counts - 1] = 0
    return np.concatenate([own, own**2, before, after, np.ones((len(own), 1))], axis=1)


def padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-line values as one row per document, and where there is a line."""
    there = np.arange(counts.max())[None, :] < counts[:, None]
    out = np.zeros(there.shape)
    out[there] = values
    return out, there


def forward_backward(unary: np.ndarray, there: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of a good line, expected label pairs, log partition) for each document.

    ``unary`` is the score of a good line over a bad one, ``pair`` the 2 x 2 scores of
    neighbouring labels; all documents move along their lines together.
    """
    docs, steps = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha = np.zeros((steps, docs, 2))
    alpha[0] = emit[:, 0]
    for t in range(1, steps):
        step = np.logaddexp(alpha[t - 1][:, :1] + pair[0], alpha[t - 1][:, 1:] + pair[1]) + emit[:, t]
        alpha[t] = np.where(there[:, t : t + 1], step, alpha[t - 1])
    total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    beta = np.zeros((steps, docs, 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        ahead = emit[:, t + 1] + beta[t + 1]
        step = np.logaddexp(pair[:, 0][None, :] + ahead[:, :1], pair[:, 1][None, :] + ahead[:, 1:])
        beta[t] = np.where(there[:, t + 1 : t + 2], step, 0)
        joint = np.exp(alpha[t][:, :, None] + pair[None] + ahead[:, None, :] - total[:, None, None])
        pairs += (joint * there[:, t + 1, None, None]).sum(axis=0)
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[None, :]).T
    return np.where(there, good, 0), pairs, total


@dataclass
class LineModel:
    """Weights of the field, and the curve from a document's share to its score."""

    weights: np.ndarray
    pair: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def shares(self, own: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document.

        Documents run through the field in groups of similar numbers of lines, so that
        padding stays small.
        """
        unary = with_neighbours(own, counts) @ self.weights
        first = np.append(0, np.cumsum(counts)[:-1])
        share = np.zeros(len(counts))
        order = np.argsort(counts, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and counts[order[end]] * (end - at + 1) <= 200_000 and counts[order[end]] <= 2 * counts[order[at]] + 8:
                end += 1
            docs = order[at:end]
            lines = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            scores, there = padded(unary[lines], counts[docs])
            weight, _ = padded(lengths[lines] + 1.0, counts[docs])
            good, _, _ = forward_backward(scores, there, self.pair)
            share[docs] = (good * weight).sum(axis=1) / weight.sum(axis=1)
            at = end
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, texts: list[bytes]) -> np.ndarray:
        own, lengths, counts = line_features(texts)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.shares(own, lengths, counts) + b, -50, 50)))


def fit(own: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, steps: int = STEPS) -> LineModel:
    """Maximum likelihood with every line of a document labelled as the document.

    Without both labels every score is the smoothed share of good labels. Both classes
    weigh the same in the field; the curve is then fitted to the labels as
    they are, on documents that the field was not fitted on.
    """
    if len(set(good.tolist())) < 2:
        share = (good.sum() + 1) / (len(good) + 2)
        return LineModel(np.zeros(4 * WIDTH + 1), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    x = with_neighbours(own, counts)
    line_doc = np.repeat(np.arange(len(counts)), counts)
    # Every fourth document of each label is left for the curve, whatever the order.
    turn = np.empty(len(counts), dtype=np.int64)
    for c in (0, 1):
        turn[good == c] = np.arange((good == c).sum())
    train = turn % 4 != 3
    rate = np.array([1 / max(1, (good[train] == c).sum()) for c in (0, 1)])
    weight = np.where(train, rate[good], 0.0)
    share = good[line_doc]
    _, there = padded(np.zeros(len(x)), counts)
    docs = len(counts)
    weights, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    # A document counts once, whatever its number of lines.
    per_doc = weight / np.sqrt(counts)
    moment = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, steps + 1):
        unary, _ = padded(x @ weights, counts)
        marginal, gradient_pair = np.zeros(there.shape), np.zeros((2, 2))
        for c in (0, 1):
            rows = np.flatnonzero(train & (good == c))
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                part = part[np.argsort(counts[part])]
                steps_here = counts[part].max()
                m, pairs, _ = forward_backward(unary[part, :steps_here], there[part, :steps_here], pair)
                marginal[part, :steps_here] = m
                scale = per_doc[part].mean()
                gradient_pair -= pairs * scale
                gradient_pair[c, c] += (counts[part] - 1).sum() * scale
        error = (share - marginal[there]) * per_doc[line_doc]
        gradient = np.append(x.T @ error - 1e-4 * weights, gradient_pair.ravel() - 1e-2 * pair.ravel())
        moment[0] = 0.9 * moment[0] + 0.1 * gradient
        moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
        move = 0.1 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        weights = weights + move[:-4]
        pair = np.clip(pair + move[-4:].reshape(2, 2), -3, 3)
    model = LineModel(weights, pair)
    shares = model.shares(own, lengths, counts)[~train]
    a, b, y = 1.0, 0.0, good[~train]
    for _ in range(50):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * shares + b, -30, 30)))
        g = np.array([((y - p) * shares).sum() - 1e-3 * (a - 1), (y - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * shares**2).sum() + 1e-3, (w * shares).sum()], [(w * shares).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
    model.curve = (max(float(a), 0.05), float(b))
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_lines: int = SAMPLE_LINES,
) -> LineModel:
    """A model from labelled documents, at most ``sample_docs`` of them.

    ``labels`` holds ids and labels 0 or 1 that may be learned from; others, and null ids,
    are left out; an id labelled twice counts as bad if any label does. The sample is
    chosen among ids; of the rows of one id that with the smallest hash of its text is
    taken, so the bound holds for rows too, and one id on most rows is one row. Only its
    texts are turned into features, and only those come to the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
        .groupBy("_id")
        .agg(F.min("_label").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_docs)
    )
    slim = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    # The chosen ids are at most sample_docs rows, and so are their texts' smallest hashes.
    hashed = slim.withColumn("_hash", F.xxhash64("text"))
    one = hashed.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_hash").alias("_hash"), F.min("_label").alias("_label"))
    known = hashed.join(F.broadcast(one), ["_id", "_hash"]).select("_id", "text", "_label")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, lengths, counts = line_features(batch.column(1).cast(pa.binary()).to_pylist())
        out, at = [], 0
        for n in counts:
            some = min(n, sample_lines)
            start = at + int(lengths[at : at + n].sum()) % (n - some + 1)
            part = np.concatenate([own[start : start + some], lengths[start : start + some, None]], axis=1)
            out.append(part.astype(np.float32).tobytes())
            at += n
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["_id", "_label", "lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_slices(known, "text", SLICE_CHARS, f"_id {kind}, _label int, lines binary", work)
    # Rows that repeat a text of an id are one.
    rows = made.groupBy("_id").agg(F.min("_label").alias("_label"), F.min("lines").alias("lines")).collect()
    rows = sorted(rows, key=lambda r: r["_id"])
    parts = [np.frombuffer(bytes(r["lines"]), dtype=np.float32).reshape(-1, WIDTH + 1).astype(np.float64) for r in rows]
    lines = np.concatenate(parts) if parts else np.zeros((0, WIDTH + 1))
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    return fit(lines[:, :WIDTH], lines[:, WIDTH], counts, np.array([r["_label"] for r in rows], dtype=np.int64))


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row over its whole text: near 1 for good documents.

    A null text counts as empty, which is one empty line and gets a score like any other;
    repeated rows repeat; only the text enters the score. No shuffle; the model is a few
    hundred numbers.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = model.score(batch.column(1).cast(pa.binary()).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_slices(slim, "text", SLICE_CHARS, f"doc_id {kind}, score double", work)


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, whole rows in one pass.

    A null or empty text is scored as one empty line and stays or goes by that score; rows
    that repeat a text share its decision; ids and other columns, of whatever name or null,
    play no part and stay as they are; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.score([(t or "").encode() for t in texts[i : i + 500]]) for i in range(0, len(texts), 500)]))

    return docs.filter(score(F.col(text_col)) >= threshold)
