"""Per-document text statistics and a hidden Markov model that labels lines prose, list, table or junk.

Each text is read once: its statistics, and per line a code of its binned features, go to a written table. The
model's parameters are fitted by expectation maximisation over the lines of all texts: every round is a pass over the
codes in which tasks add up expected counts, a few hundred numbers, for a batch of texts in step. The fitted model then
labels every line of every text in the same way.

Words are runs of non-white-space. Letters and digits are Unicode's.

Defined results: null texts give null statistics and shares and kind null; empty or blank ones give 0 words,
null means and shares of 0 lines, kind null. Repeated rows give repeated rows, and count as often in the fit; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

STATES = ("prose", "list", "table", "junk")
MIN_WORDS = 20
#: Rounds of the fit, and counts that every state, move and bin has beforehand.
ROUNDS, PRIOR = 6, 2.0

_ALNUM_SPACE = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_MARKER = re.compile(r"\s*(?:[-*+•–]|\d{1,3}[.)])\s")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_CACHE_WORDS = 200_000


def symbols(text: str) -> int:
    """Characters other than letters, digits and white space."""
    rest = text.encode("utf-8", "replace").translate(None, _ALNUM_SPACE)
    if rest.isascii():
        return len(rest)
    return sum(not (c.isalnum() or c.isspace()) for c in rest.decode("utf-8"))


class CommonWords:
    """Is a word, as it stands or stripped of all but letters and digits at both ends, a common one?"""

    def __init__(self, known: frozenset[str]):
        self.known, self.seen = known, {}

    def count(self, words: list[str]) -> int:
        n, seen = 0, self.seen
        for w in words:
            hit = seen.get(w)
            if hit is None:
                low = w.lower()
                hit = low in self.known or _EDGES.sub("", low) in self.known
                if len(seen) >= _CACHE_WORDS:
                    seen.clear()
                seen[w] = hit
            n += hit
        return n


#: Bin edges per line feature; a feature's bin is the number of edges it reaches.
EDGES = {
    "chars": (12, 40, 90, 200),
    "punctuated": (1,),
    "digits": (0.05, 0.3),
    "symbols": (0.06, 0.15, 0.35),
    "marker": (1,),
    "cells": (1, 2),
    "common": (0.05, 0.15, 0.3),
    "word_length": (3.0, 4.0, 6.5, 8.5),
}


def line_features(line: str, words: list[str], n_common: int, n_symbols: int) -> tuple[float, ...]:
    n = sum(map(len, words))
    return (
        n,
        float(words[-1][-1] in ".!?"),
        sum(map(line.count, "0123456789")) / n,
        n_symbols / n,
        float(_MARKER.match(line) is not None),
        line.count("|") + line.count("\t"),
        n_common / len(words),
        n / len(words),
    )


def bins(features: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(e), features[:, k], side="right") for k, e in enumerate(EDGES.values())], 1) if len(features) else np.zeros((0, len(EDGES)), int)


def seed_labels(features: np.ndarray) -> np.ndarray:
    """First guess for the fit; the model takes it from there."""
    f = features
    label = np.full(len(f), 3)
    label[(f[:, 6] >= 0.15) & (f[:, 3] < 0.15) & (f[:, 7] < 8.5)] = 0
    label[(f[:, 4] > 0) & (f[:, 3] < 0.35)] = 1
    label[f[:, 5] >= 2] = 2
    return label


SIZES = tuple(len(e) + 1 for e in EDGES.values())
N_CODES = int(np.prod(SIZES))


def codes(binned: np.ndarray) -> np.ndarray:
    """One number per line for its bins."""
    out = np.zeros(len(binned), np.int64)
    for k, size in enumerate(SIZES):
        out = out * size + binned[:, k]
    return out


def bins_of_codes() -> np.ndarray:
    """The bins that each code stands for."""
    return np.stack(np.unravel_index(np.arange(N_CODES), SIZES), 1)


class Steps:
    """Texts of given line counts that lie one after the other, walked through line by line, all in step: the lines at
    step t are starts[:active[t]] + t."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        ordered = lengths[self.order]
        longest = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(longest), side="left")
        self.ends = (self.starts + ordered - 1)[: self.active[0]] if longest else np.zeros(0, np.int64)

    def lines(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


class LineModel:
    """Four hidden states, categorical emissions of the binned features, start and transition probabilities."""

    def __init__(self, counts: np.ndarray):
        """counts: expected starts, moves and emissions as accumulated by expected_counts, one after the other."""
        start, move = counts[:4] + PRIOR, counts[4:20].reshape(4, 4) + PRIOR
        self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
        self.emit, at = [], 20
        for size in SIZES:
            part = counts[at : at + 4 * size].reshape(4, size) + PRIOR
            self.emit.append(np.log(part / part.sum(1, keepdims=True)))
            at += 4 * size
        table = bins_of_codes()
        #: Log emission probability per code and state.
        self.scores = sum(e.T[table[:, k]] for k, e in enumerate(self.emit))

    def label(self, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely states of the lines of texts (Viterbi)."""
        out = np.zeros(len(code), np.int8)
        if not len(code):
            return out
        emit, steps = self.scores[code], Steps(lengths)
        back = [np.zeros((0, 4), np.int8)]
        score = self.start + emit[steps.lines(0)]
        final = score.copy()
        for t in range(1, len(steps.active)):
            now = steps.active[t]
            paths = score[:now, :, None] + self.move
            best = paths.argmax(1)
            back.append(best.astype(np.int8))
            score = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + emit[steps.lines(t)]
            final[:now] = score
        state = final.argmax(1)
        out[steps.ends] = state
        rows = np.arange(len(final))
        for t in range(len(steps.active) - 1, 0, -1):
            now = steps.active[t]
            state[:now] = back[t][rows[:now], state[:now]]
            out[steps.lines(t - 1)[:now]] = state[:now]
        return out

    def expect(self, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of the lines of texts (forward-backward)."""
        if not len(code):
            return np.zeros(N_COUNTS)
        steps, move = Steps(lengths), np.exp(self.move)
        emit = self.scores[code]
        emit = np.exp(emit - emit.max(1, keepdims=True))
        ahead, behind = np.zeros((len(code), 4)), np.ones((len(code), 4))
        first = steps.lines(0)
        ahead[first] = np.exp(self.start) * emit[first]
        ahead[first] /= ahead[first].sum(1, keepdims=True)
        for t in range(1, len(steps.active)):
            at = steps.lines(t)
            now = ahead[at - 1] @ move * emit[at]
            ahead[at] = now / now.sum(1, keepdims=True)
        pairs = np.zeros((4, 4))
        for t in range(len(steps.active) - 1, 0, -1):
            at = steps.lines(t)
            after = emit[at] * behind[at]
            joint = ahead[at - 1][:, :, None] * move * after[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            now = after @ move.T
            behind[at - 1] = now / now.sum(1, keepdims=True)
        weight = ahead * behind
        weight /= weight.sum(1, keepdims=True)
        return expected_counts(weight[first].sum(0), pairs, code, weight)


N_COUNTS = 20 + 4 * sum(SIZES)


def expected_counts(first: np.ndarray, pairs: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Starts, moves and emissions of weighted states as one row of numbers."""
    per_code = np.stack([np.bincount(code, weight[:, s], N_CODES) for s in range(4)])
    table, parts = bins_of_codes(), [first, pairs.ravel()]
    for k, size in enumerate(SIZES):
        parts += [np.bincount(table[:, k], per_code[s], size) for s in range(4)]
    return np.concatenate(parts)


def seed_counts(code: np.ndarray, seed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same from seed labels."""
    if not len(code):
        return np.zeros(N_COUNTS)
    one = np.eye(4)[seed]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    inner = np.ones(len(code), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pairs = np.bincount(seed[at - 1] * 4 + seed[at], minlength=16)
    return expected_counts(one[starts].sum(0), pairs, code, one)


def _unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, seed labels, line counts) of a batch of packed lines."""
    lengths = np.array([len(x) // 2 for x in column], np.int64)
    packed = np.frombuffer(b"".join(column), np.uint16).astype(np.int64)
    return packed // 4, packed % 4, lengths


def fit_line_model(lines: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """Baum-Welch from seed labels over all rows of a column lines (packed codes)."""

    def total(model: LineModel | None) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros(N_COUNTS)
            for batch in batches:
                code, seed, lengths = _unpacked(batch["lines"])
                counts += seed_counts(code, seed, lengths) if model is None else model.expect(code, lengths)
            yield pd.DataFrame({"at": np.arange(N_COUNTS, dtype=np.int32), "n": counts})

        out = np.zeros(N_COUNTS)
        for r in lines.mapInPandas(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = round(r["n"], 4)  # sums in any order come to the same
        return out

    model = LineModel(total(None))
    for _ in range(rounds):
        model = LineModel(total(model))
    return model


def _lines(text: str, common: CommonWords):
    """Totals and line features of one text."""
    n_words = n_chars = n_common = n_symbols = n_ended = 0
    features = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        c, s = common.count(words), symbols(line)
        f = line_features(line, words, c, s)
        features.append(f)
        n_words += len(words)
        n_chars += int(f[0])
        n_common += c
        n_symbols += s
        n_ended += int(f[1])
    return n_words, n_chars, n_common, n_symbols, n_ended, features


STATS = "n_words long, mean_word_length double, symbol_ratio double, ended_share double, common_share double"
SHARES = "prose_share double, list_share double, table_share double, junk_share double, kind string"


def read_lines(df: DataFrame, id_col: str, text_col: str, known: frozenset[str]) -> DataFrame:
    """id, the five statistics, lines (a code per non-blank line) and chars (its characters), packed, for every row."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = CommonWords(known)
        for batch in batches:
            rows, features, lengths = [], [], []
            for i, text in zip(batch["id"], batch["text"]):
                if text is None:
                    rows.append((i, *(None,) * 5))
                    lengths.append(0)
                    continue
                w, c, k, s, e, f = _lines(text, common)
                rows.append((i, w, c / w, s / c, e / len(f), k / w) if w else (i, 0, None, None, None, None))
                features += f
                lengths.append(len(f))
            table = np.array(features) if features else np.zeros((0, len(EDGES)))
            packed = (codes(bins(table)) * 4 + seed_labels(table)).astype(np.uint16)
            ends = np.cumsum(lengths)
            out = pd.DataFrame(rows, columns=["id", "n_words", "mean_word_length", "symbol_ratio", "ended_share", "common_share"])
            out["n_words"] = out["n_words"].astype("Int64")
            out["lines"] = [packed[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            out["chars"] = [table[e - n : e, 0].astype(np.uint32).tobytes() for e, n in zip(ends, lengths)]
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return materialize(texts.mapInPandas(run, f"id {kind}, {STATS}, lines binary, chars binary"), "line-codes")


def text_quality(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str = "word") -> DataFrame:
    """id, the five statistics, the share of lines per label, and kind: the label of most characters' lines, ties by order.

    common_words is a fixed list; it is collected (its words bound it) and shared with every task.
    """
    known = frozenset(r[0] for r in common_words.select(word_col).distinct().collect() if r[0])
    rows = read_lines(df, id_col, text_col, known)
    model = fit_line_model(rows.select("lines"))
    stats = [c.split()[0] for c in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, _, counts = _unpacked(batch["lines"])
            label = model.label(code, counts)
            chars = np.frombuffer(b"".join(batch["chars"]), np.uint32)
            owner = np.repeat(np.arange(len(counts)), counts) * 4 + label
            shares = np.bincount(owner, minlength=4 * len(counts)).reshape(-1, 4)
            weight = np.bincount(owner, chars, 4 * len(counts)).reshape(-1, 4)
            out = batch[["id", *stats]].copy()
            for k, state in enumerate(STATES):
                out[f"{state}_share"] = [shares[i, k] / n if n else None for i, n in enumerate(counts)]
            out["kind"] = [STATES[int(weight[i].argmax())] if n else None for i, n in enumerate(counts)]
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, {STATS}, {SHARES}")


def line_labels(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str = "word") -> DataFrame:
    """id, labels: the label of each non-blank line of the text, in order; null texts have null."""
    known = frozenset(r[0] for r in common_words.select(word_col).distinct().collect() if r[0])
    rows = read_lines(df, id_col, text_col, known)
    model = fit_line_model(rows.select("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, _, counts = _unpacked(batch["lines"])
            label, ends = model.label(code, counts), np.cumsum(counts)
            found = [None if n is None or pd.isna(n) else [STATES[k] for k in label[e - c : e]] for n, e, c in zip(batch["n_words"], ends, counts)]
            yield pd.DataFrame({"id": batch["id"], "labels": pd.Series(found, dtype=object)})

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, labels array<string>")


def poor_quality(stats: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of at least min_words words for which two or more of the four tests hold."""
    tests = [
        (F.col("mean_word_length") < 3.5) | (F.col("mean_word_length") > 7.5),
        F.col("symbol_ratio") > 0.12,
        F.col("ended_share") < 0.28,
        F.col("common_share") < 0.15,
    ]
    held = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    return stats.filter((F.col("n_words") >= min_words) & (held >= 2))
