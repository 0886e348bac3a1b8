"""Quality rules as a learned decision list.

Sequential covering: on one part of the labelled rows a conjunction of
thresholds is grown by information gain until it covers no good document, on
the other part its last conditions are pruned away while that makes it more
precise, and the rows it covers are taken out before the next rule is grown.
The list becomes an ordered Spark conditional expression over statistics that
an Arrow pass derives from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.fm import held_out
from faultlens.llm.words import _SPACE, Powers, mix64, span_hashes, text_slices, word_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "echo_rate", "upper_rate", "digit_rate",
         "exclamation_rate", "pipe_rate", "near_repeat_rate", "words_per_line"]

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words back in which an equal word makes a word a near repeat: unlike a share
#: of distinct words, this doesn't change with a text's length.
NEAR = 16
#: Most labelled rows to learn from, thresholds tried for a statistic, conditions
#: of a rule, rules of a list, what a rule must reach on the pruning part, and rules
#: in a row that may fail it.
SAMPLE, CUTS, CONDITIONS, RULES, PRECISION, COVER, RETRIES = 20_000, 64, 4, 24, 0.9, 3, 3


def _flags(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _flags(SYMBOLS.encode()), _flags(range(65, 91)), _flags(b"0123456789")
_BANG, _PIPE = _flags(b"!"), _flags(b"|")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def statistics(texts: pa.Array, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of rows the ``COUNTS`` (integers) and ``RATES`` (floats) per row."""
    for _, data, offsets in text_slices(texts):
        n = len(offsets) - 1
        salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
        words, at = word_hashes(data, offsets, powers, lower=False)
        row = np.repeat(np.arange(n), np.diff(at))
        n_words = np.diff(at)
        start_byte = (data & 0xC0) != 0x80
        word_chars = _per_row(start_byte & ~_SPACE[data], offsets)

        covered = np.zeros(len(words), bool)
        if len(words) >= 3:
            gram = mix64(words[:-2] + np.uint64(3) * mix64(words[1:-1]) + np.uint64(5) * mix64(words[2:] ^ np.uint64(9))) ^ salt[row[:-2]]
            inside = np.flatnonzero(row[2:] == row[:-2])
            _, inverse, counts = np.unique(gram[inside], return_inverse=True, return_counts=True)
            twice = inside[counts[inverse] >= 2]
            for k in range(3):
                covered[twice + k] = True
        repeat = np.bincount(row[covered], minlength=n)

        line_start = np.zeros(len(data) + 1, bool)
        line_start[1:] = data == 10
        line_start[offsets] = True
        line_start[len(data):] = False
        starts = np.flatnonzero(line_start)
        ends = np.append(starts[1:], len(data))
        solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        real = solid[ends] > solid[starts]
        starts, ends = starts[real], ends[real]
        ends = ends - (data[ends - 1] == 10) if len(starts) else ends
        line_row = np.searchsorted(offsets, starts, "right") - 1
        n_lines = np.bincount(line_row, minlength=n)
        distinct = np.zeros(n, np.int64)
        if len(starts):
            _, first = np.unique(span_hashes(data, starts, ends, powers) ^ salt[line_row], return_index=True)
            distinct = np.bincount(line_row[first], minlength=n)

        key = words ^ salt[row]
        order = np.argsort(key, kind="stable")
        again = (key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] <= NEAR)
        near = np.bincount(row[order[1:][again]], minlength=n)
        echo = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
        counts = np.stack([n_words, word_chars, _per_row(_SYMBOL[data], offsets), n_lines - distinct, repeat], 1)
        w, c = np.maximum(1, n_words), np.maximum(1, word_chars)
        rates = np.stack([word_chars / w, counts[:, 2] / c, counts[:, 3] / np.maximum(1, n_lines), repeat / w, echo / w,
                          *(_per_row(f[data], offsets) / c for f in (_UPPER, _DIGIT, _BANG, _PIPE)),
                          near / w, n_words / np.maximum(1, n_lines)], 1)
        yield counts.astype(np.int64), rates


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every row; null texts have no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            got = list(statistics(batch.column(1), powers))
            if got:
                counts, rates = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in counts.T), *(pa.array(x) for x in rates.T)],
                                                 names=["doc_id", *COUNTS, *RATES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATES)]))


class Condition(NamedTuple):
    """``stat >= value`` if ``above``, else ``stat < value``."""

    stat: str
    above: bool
    value: float


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c in rule:
        col = x[:, names.index(c.stat)]
        ok &= (col >= c.value) if c.above else (col < c.value)
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        now = np.log2(p / (p + n))
        for j, name in enumerate(names):
            col, hit = x[inside, j], bad[inside]
            # rows per interval between cuts, then sums from either side
            slot = np.searchsorted(cuts[j], col, "right")
            ps, ns = (np.bincount(slot[m], minlength=len(cuts[j]) + 1) for m in (hit, ~hit))
            for above in (True, False):
                pp = (p - np.cumsum(ps)[:-1]) if above else np.cumsum(ps)[:-1]
                nn = (n - np.cumsum(ns)[:-1]) if above else np.cumsum(ns)[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - now), 0)
                k = int(np.argmax(g)) if len(g) else 0
                if len(g) and g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[j][k])), g[k]
        if best is None:
            break
        rule.append(best)
        inside = _holds(x, names, rule)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """The ordered conjunctions whose rows are rejected, from statistics ``x``
    (a column per name). Rows alternate between growing (two of three) and
    pruning; a rule counts if it is precise enough where it was not grown."""
    rules: list[list[Condition]] = []
    tried = 0
    if not len(x) or not bad.any():
        return rules
    at = np.linspace(0, 1, CUTS + 1)
    cuts = [np.union1d(np.quantile(x[:, j], at[1:]), np.quantile(x[bad, j], at)) for j in range(x.shape[1])]
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < RULES:
        grow, prune = left & ~part, left & part
        rule = _grow(x[grow], bad[grow], names, cuts)
        if not rule:
            break
        def worth(r):
            hit = _holds(x[prune], names, r)
            p, n = int(bad[prune][hit].sum()), int((~bad[prune][hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0, p, n
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r)[0])
        _, p, n = worth(rule)
        if p >= COVER and p >= PRECISION * (p + n):
            rules.append(rule)
            tried = 0
        elif (tried := tried + 1) > RETRIES:
            break
        left &= ~_holds(x, names, rule)  # what an imprecise rule covers is set aside, and the covering goes on
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that
    fires, from 1, or 0 where none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        fires = F.lit(True)
        for c in rule:
            fires = fires & ((F.col(c.stat) >= c.value) if c.above else (F.col(c.stat) < c.value))
        out = out.when(fires, F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def base_failed() -> Column:
    """The fixed test before any rule: too few words, or mostly repeated ones."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                sample: int = SAMPLE) -> list[list[Condition]]:
    """Learn from at most ``sample`` labelled rows, those with the smallest
    hashes of their ids; rows held out for tests, rows that the base test rejects
    anyway, null ids and null labels are never learnt from. Without labelled bad rows the list is empty."""
    picked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) < 0.5).alias("bad"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # The picked side has at most ``sample`` rows of 16 bytes; of rows that share an
    # id one is learnt from, whatever their number.
    live = stats.where(~base_failed())
    found = live.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*RATES, "bad")).alias("r"))
    got = found.select("doc_id", "r.*").toArrow().sort_by([("doc_id", "ascending")])
    names = [c for c in RATES if c != "mean_word"]  # word lengths tell languages apart, not quality
    x = np.stack([got.column(c).to_numpy().astype(float) for c in names], 1) if len(got) else np.zeros((0, len(names)))
    return learn(x, got.column("bad").to_numpy().astype(bool), names)


def apply_rules(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``stats`` with ``rule`` (the first that fires, or 0), ``base_failed`` and ``kept``.

    Every row gets a verdict: empty texts fail the base test; null and repeated
    ids are ordinary values; an empty table gives no rows.
    """
    return stats.withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
