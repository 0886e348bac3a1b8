"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

    y(x) = w0 + <w, x> + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The pairwise interactions have rank ``FACTORS``; the sum-of-squares identity
scores a document in time linear in its distinct words. Spark selects the
labelled rows, builds features and scores in Arrow passes over its partitions;
the weights are fitted with Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks
from faultlens.llm.words import _SPACE, Powers, span_hashes, text_slices, word_hashes

#: Buckets of hashed words, rank of the interactions, and most labelled rows to fit on.
BUCKETS, FACTORS, SAMPLE = 1 << 15, 8, 8000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.02, 1e-5, 7

STATS = ["log_chars", "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "pipe", "exclamation",
         "newline", "wide", "word_variety", "line_repeats", "log_longest_line", "echo", "log_n_chars", "n_chars_missing"]


def _class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_CLASSES = {"upper": _class(bytes(range(65, 91))), "digit": _class(b"0123456789"), "symbol": _class(b"#*$%&<>"),
            "punctuation": _class(b".,;:?'\"()-"), "pipe": _class(b"|"), "exclamation": _class(b"!"), "newline": _class(b"\n"),
            "wide": np.arange(256) >= 0xC0}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def features(texts: pa.Array, n_chars: pa.Array, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of rows: ``(row of each entry, bucket, value, stats)``.

    The value of a word bucket is the logarithm of one plus its count, scaled
    so that a row's values have length 1; ``stats`` has a row per text.
    """
    given = np.array([np.nan if v is None else v for v in n_chars.to_pylist()], float)
    for first, data, offsets in text_slices(texts):
        n = len(offsets) - 1
        words, at = word_hashes(data, offsets, powers)
        row = np.repeat(np.arange(n), np.diff(at))
        echo = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
        pair, counts = np.unique(row * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        row, bucket, value = pair // BUCKETS, pair % BUCKETS, np.log1p(counts)
        norm = np.sqrt(np.bincount(row, value * value, n))
        value = value / norm[row]

        size = np.maximum(1, np.diff(offsets))
        n_words = np.diff(at)
        line_end = np.zeros(len(data) + 1, bool)
        line_end[1:] = np.concatenate([data == 10])
        starts = np.union1d(np.flatnonzero(line_end[:-1]), offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts[1:], len(data))
        line_row = np.searchsorted(offsets, starts, "right") - 1
        long = ends - starts > 2
        lines = span_hashes(data, starts[long], ends[long], powers) if long.any() else np.zeros(0, np.uint64)
        kept = np.unique(np.stack([line_row[long].astype(np.uint64), lines]), axis=1)[0] if long.any() else np.zeros(0, np.uint64)
        n_lines = np.bincount(line_row[long], minlength=n)
        longest = np.zeros(n)
        np.maximum.at(longest, line_row, ends - starts)
        share = {k: _sums(flags[data], offsets) / size for k, flags in _CLASSES.items()}
        chars = _sums((data & 0xC0) != 0x80, offsets)
        meta = given[first:first + n]
        known = np.isfinite(meta) & (meta >= 0)
        stats = np.stack([
            np.log1p(chars), np.log1p(n_words), _sums(~_SPACE[data], offsets) / np.maximum(1, n_words),
            *(share[k] for k in ("upper", "digit", "symbol", "punctuation", "pipe", "exclamation", "newline", "wide")),
            np.bincount(row, minlength=n) / np.maximum(1, n_words),
            1 - np.bincount(kept.astype(np.int64), minlength=n) / np.maximum(1, n_lines), np.log1p(longest),
            echo / np.maximum(1, n_words), np.where(known, np.log1p(np.where(known, meta, 0)), np.log1p(chars)), ~known], 1).astype(float)
        yield row, bucket, value, stats


class Machine:
    """Weights of a fitted machine; plain arrays of a fixed size."""

    def __init__(self, mean, scale, bias, linear, factors) -> None:
        self.mean, self.scale, self.bias, self.linear, self.factors = mean, scale, bias, linear, factors

    def entries(self, row, bucket, value, stats):
        """Word entries and standardised statistics as one list of entries in row order."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(len(STATS))
        n = len(stats)
        r = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(r, kind="stable")
        b = np.concatenate([bucket, np.tile(BUCKETS + np.arange(len(STATS)), n)])
        return r[order], b[order], np.concatenate([value, z.ravel()])[order]

    def margin(self, row, bucket, value, stats) -> np.ndarray:
        r, b, x = self.entries(row, bucket, value, stats)
        start = np.searchsorted(r, np.arange(len(stats)))
        return self._raw(b, x, start)[0]

    def _raw(self, b, x, start):
        vx = self.factors[b] * x[:, None]
        total = np.add.reduceat(vx, start)
        pairs = 0.5 * (total ** 2 - np.add.reduceat(vx * vx, start)).sum(1)
        return self.bias + np.add.reduceat(self.linear[b] * x, start) + pairs, total


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Logistic loss, minibatches, Adam; ``rows`` are (bucket, value, stats) per row."""
    width = BUCKETS + len(STATS)
    stats = np.array([s for _, _, s in rows]).reshape(-1, len(STATS))
    mean, scale = (stats.mean(0), np.maximum(stats.std(0), 1e-6)) if len(rows) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    rng = np.random.default_rng(SEED)
    machine = Machine(mean, scale, 0.0, np.zeros(width), rng.normal(0, 0.02, (width, FACTORS)))
    if not len(rows):
        machine.factors[:] = 0
        return machine
    machine.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    state = [np.zeros((2, width)), np.zeros((2, width, FACTORS)), np.zeros(2)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            own = order[s:s + BATCH]
            row = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            r, b, x = machine.entries(row, np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]), stats[own])
            start = np.searchsorted(r, np.arange(len(own)))
            y, total = machine._raw(b, x, start)
            slope = (1 / (1 + np.exp(-y)) - labels[own]) / len(own)
            g = slope[r] * x
            touched, where = np.unique(b, return_inverse=True)
            linear = np.bincount(where, g) + DECAY * machine.linear[touched]
            inner = g[:, None] * (total[r] - machine.factors[b] * x[:, None])
            factors = np.stack([np.bincount(where, inner[:, f]) for f in range(FACTORS)], 1) + DECAY * machine.factors[touched]
            step += 1
            for (m, v), grad, weights in ((state[0], linear, machine.linear), (state[1], factors, machine.factors)):
                m[touched] = 0.9 * m[touched] + 0.1 * grad
                v[touched] = 0.999 * v[touched] + 0.001 * grad ** 2
                weights[touched] -= RATE * (m[touched] / (1 - 0.9 ** step)) / (np.sqrt(v[touched] / (1 - 0.999 ** step)) + 1e-8)
            m, v = state[2]
            state[2] = 0.9 * m + 0.1 * slope.sum(), 0.999 * v + 0.001 * slope.sum() ** 2
            machine.bias -= RATE * (state[2][0] / (1 - 0.9 ** step)) / (np.sqrt(state[2][1] / (1 - 0.999 ** step)) + 1e-8)
    return machine


_FEATURE = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("bucket", pa.list_(pa.int32())),
                      ("value", pa.list_(pa.float64())), ("stats", pa.list_(pa.float64()))])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        at = 0
        for row, bucket, value, stats in features(batch.column(1), batch.column(2), powers):
            cut = np.searchsorted(row, np.arange(len(stats) + 1))
            part = batch.slice(at, len(stats))
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(pa.int64()), part.column(3).cast(pa.float64()), lists(bucket, pa.int32()), lists(value, pa.float64()),
                pa.array(list(stats), pa.list_(pa.float64()))], schema=_FEATURE)
            at += len(stats)


def held_out(id_col):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
          label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows that are not held out.

    The sample is the rows with the smallest hashes of their ids. Null ids and
    null labels are not learnt from; of several labels of one id their rounded
    mean counts, and of several documents of one id the one with the least
    statistics. A document sends at most ``BUCKETS`` word counts to the driver. No labelled rows give a machine that scores all rows 0.5.
    """
    picked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.round(F.avg(label_col)).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        (F.col(chars_col) if chars_col in docs.columns else F.lit(None)).cast("double").alias("n_chars"))
    # The picked side has at most ``sample`` rows of 16 bytes; of rows that share an
    # id one is learnt from, whatever their number.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "n_chars", "label").mapInArrow(
        _feature_rows, "doc_id long, label double, bucket array<int>, value array<double>, stats array<double>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("stats", "bucket", "value", "label")).alias("r")).select("doc_id", "r.*")
    got = one.toArrow().sort_by("doc_id")
    buckets, values, stats = (got.column(c).combine_chunks() for c in ("bucket", "value", "stats"))
    rows = [(buckets[i].values.to_numpy(), values[i].values.to_numpy(), stats[i].values.to_numpy()) for i in range(len(got))]
    return fit(rows, got.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have statistics of nothing and are scored like any
    other; null ids are not held out; repeated rows are scored each; an empty
    table gives no rows; further columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # (BUCKETS + 17) x 9 numbers, whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            y = [model.value.margin(*f) for f in features(batch.column(1), batch.column(2), powers)]
            if y:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(y), -50, 50))))],
                                                 names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        (F.col(chars_col) if chars_col in docs.columns else F.lit(None)).cast("double").alias("n_chars"))
    return texts.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns, in one pass."""
    model, schema = docs.sparkSession.sparkContext.broadcast(machine), docs.schema
    text, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            n_chars = pa.nulls(batch.num_rows) if chars is None else batch.column(chars)
            y = [model.value.margin(*f) for f in features(batch.column(text), n_chars, powers)]
            if y:
                yield batch.filter(pa.array(np.concatenate(y) >= 0))

    return docs.mapInArrow(kept, schema)
