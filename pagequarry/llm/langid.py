"""Language of documents and of the segments of mixed ones, by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the
probability of a word is the sum over all ways to cut it into pieces, computed by a forward algorithm, so that no
single segmentation decides. Piece probabilities are fitted here, by expectation maximisation (forward-backward
over the words of the language samples), smoothed towards the mean of all languages. Characters outside the
vocabulary count as one piece per writing system.

A segment is a longest run of non-blank lines. Its words' log probabilities add up per language; the language is
the best one and the confidence its posterior, with `EVIDENCE` of each word's weight since neighbouring words are
not independent. A word's scores depend on the word alone: each task computes the words it has not met, all
positions of a batch of words in step, and keeps a bounded number of them. Words and runs without spaces are scored
whole, however long, with pieces of any length that the vocabulary has.

Defined results: null, empty and blank texts have no segments; a segment with fewer than `MIN_LETTERS` letters or
a share of letters among its non-space characters below `MIN_LETTER_SHARE` has no language (figures), confidence
null. Equal scores go to the first language in alphabetical order. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import tokenizer_folder

MIN_CHARS, MIN_LETTERS, MIN_LETTER_SHARE = 40, 8, 0.4
MAX_SAMPLES, ROUNDS, SMOOTHING, EVIDENCE = 5000, 4, 0.02, 0.5
_CACHE_WORDS = 400_000
#: Words read before new ones among them are scored together.
_BATCH_TOKENS = 500_000
#: Cells (words x positions) of a batch; words up to _PLAIN characters need no rescaling on the way, longer ones are not kept.
_CELLS, _PLAIN = 40_000, 40

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*['’]?")

#: Names of languages in labels: two- and three-letter codes and English names (fixed values).
LABELS = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
    "it": ("it", "ita", "italian"),
    "pt": ("pt", "por", "portuguese"),
    "zh": ("zh", "zho", "chi", "chinese"),
    "ja": ("ja", "jpn", "japanese"),
}


def labelled_language(label):
    """Column: two-letter code that a label names, null for none. Region and script after -, _, a space or a bracket are left out."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:$|[-_ (.,;/])", 1)
    names = F.create_map(*[F.lit(x) for code, spelt in LABELS.items() for name in spelt for x in (name, code)])
    return names[head]


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def plain_form(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _script(char: str) -> int:
    """Writing system of a character outside the vocabulary, as one of a few classes."""
    c = ord(char)
    for k, (a, b) in enumerate(((0x0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x6FF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))):
        if a <= c <= b:
            return k
    return 8


N_SCRIPTS = 9


class Vocabulary:
    """Pieces of letters by length, and the lattice of a batch of words."""

    def __init__(self, pieces: list[str]):
        self.ids: dict[str, int] = {}
        for p in pieces:
            p = p.lower()
            if p and all(c.isalpha() or c in "'’▁" for c in p) and p != "▁":
                self.ids.setdefault(p, len(self.ids))
        self.index()

    def index(self) -> None:
        self.size = len(self.ids) + N_SCRIPTS
        self.longest = max(map(len, self.ids), default=1)
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}

    @classmethod
    def of(cls, ids: dict[str, int]) -> Vocabulary:
        made = cls([])
        made.ids = ids
        made.index()
        return made

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())])

    def lattice(self, words: list[str]) -> np.ndarray:
        """ids[length - 1, end, word]: the piece of that length that ends before position end, -1 for none.

        A word begins with a mark; pieces that begin with the mark match only there, and the mark itself may be skipped.
        """
        n_max = max(map(len, words))
        depth = min(self.longest, n_max)
        out = np.full((depth, n_max + 1, len(words)), -1, np.int32)
        get, begins, unknown = self.ids.get, self.begins, len(self.ids)
        at, found = [], []
        step, row = (n_max + 1) * len(words), len(words)
        for w, word in enumerate(words):
            n = len(word)
            for a in range(n):
                # a character of its own, known or by its writing system
                c = word[a]
                i = get("▁" + c) if a == 0 else None
                if i is None:
                    i = get(c)
                at.append((a + 1) * row + w)
                found.append(unknown + _script(c) if i is None else i)
                for k in range(2, min(depth, n - a) + 1):
                    piece = word[a : a + k]
                    i = get("▁" + piece) if a == 0 else None
                    if i is None:
                        i = get(piece)
                    if i is not None:
                        at.append((k - 1) * step + (a + k) * row + w)
                        found.append(i)
                    elif piece not in begins and (a or "▁" + piece not in begins):
                        break
        out.reshape(-1)[at] = found
        return out


class LanguageModel:
    def __init__(self, languages: list[str], vocabulary: Vocabulary, p: np.ndarray):
        self.languages, self.vocabulary = languages, vocabulary
        self.p = np.vstack([p.astype(np.float64), np.zeros((1, len(languages)))])  # the last row stands for no piece
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all cuts up to each position, [position, word, language]."""
        depth, positions, n = ids.shape
        alpha = np.ones((positions, n, len(self.languages)))
        log = np.zeros((positions, n, len(self.languages)))
        for t in range(1, positions):
            total = np.zeros((n, len(self.languages)))
            for k in range(1, min(depth, t) + 1):
                piece = ids[k - 1, t]
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    total[some] += alpha[t - k, some] * np.exp(log[t - k, some] - log[t - 1, some]) * self.p[piece[some]]
            alive = total > 0
            log[t] = log[t - 1] + np.log(np.where(alive, total, 1))
            alpha[t] = alive
        return log

    def plain_forward(self, ids: np.ndarray) -> np.ndarray:
        """Summed probability of all cuts of words of one length, [word, language]; too small for a float beyond some length."""
        depth, positions, n = ids.shape
        alpha = np.ones((positions, n, len(self.languages)))
        for t in range(1, positions):
            total = alpha[t - 1] * self.p[ids[0, t]]
            for k in range(2, min(depth, t) + 1):
                some = np.flatnonzero(ids[k - 1, t] >= 0)
                if len(some):
                    total[some] += alpha[t - k, some] * self.p[ids[k - 1, t, some]]
            alpha[t] = total
        return alpha[-1]

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros((len(words), len(self.languages)))
        k = 0
        while k < len(order):
            length = len(words[order[k]])
            part = [i for i in order[k : k + max(1, _CELLS // (length + 1))] if len(words[i]) == length]
            ids = self.vocabulary.lattice([words[i] for i in part])
            out[part] = np.log(self.plain_forward(ids)) if length <= _PLAIN else self.forward(ids)[-1]
            k += len(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Scores of words of up to _PLAIN characters, for total; once they are too many, those of this call alone are kept."""
        new = [w for w in words if len(w) <= _PLAIN and w not in self.places]
        if not new:
            return
        if len(self.places) + len(new) > _CACHE_WORDS:
            self.places.clear()
            new = [w for w in words if len(w) <= _PLAIN]
        first = len(self.places)
        while first + len(new) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        self.scores[first : first + len(new)] = self.score(new)
        self.places.update(zip(new, range(first, first + len(new))))

    def total(self, tokens: list[str]) -> np.ndarray:
        """Sum of the words' log probabilities per language. Words that were not learnt (long runs are met once) are scored now."""
        at = list(map(self.places.get, tokens))
        if None not in at:
            return self.scores[at].sum(0)
        other = Counter(w for w, k in zip(tokens, at) if k is None)
        out = np.array(list(other.values()), float) @ self.score(list(other))
        at = [k for k in at if k is not None]
        return out + self.scores[at].sum(0) if at else out

    def fit_round(self, counts: list[Counter]) -> np.ndarray:
        """Expected piece counts [piece, language] of the words of each language."""
        expected = np.zeros((self.vocabulary.size, len(self.languages)))
        for k, words in enumerate(counts):
            names = sorted(words)
            one = LanguageModel([self.languages[k]], self.vocabulary, self.p[:-1, k : k + 1])
            names.sort(key=len)
            a = 0
            while a < len(names):
                part = [w for w in names[a : a + max(1, _CELLS // (len(names[a]) + 1))] if len(w) == len(names[a])]
                a += len(part)
                ids = self.vocabulary.lattice(part)
                log = one.forward(ids)[:, :, 0]
                weight = np.array([words[w] for w in part], float)
                back = np.full(log.shape, -np.inf)
                back[-1] = 0
                for t in range(len(log) - 1, 0, -1):
                    for j in range(1, min(len(ids), t) + 1):
                        piece = ids[j - 1, t]
                        use = (piece >= 0) & np.isfinite(back[t])
                        if use.any():
                            step = back[t, use] + np.log(one.p[piece[use], 0])
                            back[t - j, use] = np.logaddexp(back[t - j, use], step)
                            np.add.at(expected[:, k], piece[use], weight[use] * np.exp(log[t - j, use] + step - log[-1, use]))
        return expected


def fit(samples: list[tuple[str, str]], vocabulary: Vocabulary, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> LanguageModel:
    """samples: (language, text). Every word also counts, with a tenth of the weight, without its accents."""
    languages = sorted({lang for lang, _ in samples})
    counts = [Counter() for _ in languages]
    for lang, text in samples:
        mine = counts[languages.index(lang)]
        for w in words_of(text):
            mine[w] += 1
            if (p := plain_form(w)) != w:
                mine[p] += 0.1
    model = LanguageModel(languages, vocabulary, np.full((vocabulary.size, len(languages)), 1 / vocabulary.size))
    for _ in range(rounds):
        expected = model.fit_round(counts)
        own = expected / np.maximum(expected.sum(0), 1e-9)
        mean = 0.9 * own.mean(1, keepdims=True) + 0.1 / vocabulary.size
        p = (1 - smoothing) * own + smoothing * mean
        model = LanguageModel(languages, vocabulary, p)
    return model


def segments(text: str) -> list[str]:
    out, run = [], []
    for line in text.split("\n"):
        if line.strip():
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    if run:
        out.append("\n".join(run))
    return out


def has_language(segment: str, words: list[str]) -> bool:
    letters = sum(map(len, words)) - sum(w.count("'") + w.count("’") for w in words if not w.isalpha())
    return letters >= MIN_LETTERS and letters >= MIN_LETTER_SHARE * sum(map(len, segment.split()))


def _posterior(total: np.ndarray) -> np.ndarray:
    e = np.exp(EVIDENCE * (total - total.max()))
    return e / e.sum()


def _model(samples: DataFrame, lang_col: str, text_col: str, vocabulary_path: str | None) -> LanguageModel:
    path = vocabulary_path or f"{tokenizer_folder()}/piece_bpe_32k.model"
    rows = samples.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col).orderBy(F.xxhash64(lang_col, text_col)).limit(MAX_SAMPLES).collect()
    if not rows:
        raise ValueError("there are no language samples to learn from")
    return fit([tuple(r) for r in rows], Vocabulary.load(path))


def segment_languages(docs: DataFrame, id_col: str, text_col: str, samples: DataFrame, sample_lang: str = "lang", sample_text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, seg_no, n_chars (trimmed), lang, confidence of every segment.

    At most MAX_SAMPLES samples are read for the fit; the model goes to the tasks as a broadcast of fixed size.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("label"))
    return _scored(texts, _model(samples, sample_lang, sample_text, vocabulary)).drop("label")


def _scored(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """Segments of texts(id, text, label), each with its document's label."""
    shared = texts.sparkSession.sparkContext.broadcast((model.languages, model.vocabulary.ids, model.p[:-1].astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, ids, p = shared.value
        mine = LanguageModel(languages, Vocabulary.of(ids), p)

        def scored(part: list[tuple]) -> pd.DataFrame:
            mine.learn({w for *_, tokens in part for w in tokens})
            rows = []
            for i, k, n, label, tokens in part:
                if not tokens:
                    rows.append((i, k, n, None, None, label))
                    continue
                share = _posterior(sum(mine.total(tokens[a : a + 100_000]) for a in range(0, len(tokens), 100_000)))
                best = int(share.argmax())
                rows.append((i, k, n, languages[best], float(share[best]), label))
            return pd.DataFrame(rows, columns=["id", "seg_no", "n_chars", "lang", "confidence", "label"])

        for batch in batches:
            part, n_tokens = [], 0
            for i, text, label in zip(batch["id"], batch["text"], batch["label"]):
                for k, segment in enumerate(segments(text)):
                    tokens = words_of(segment)
                    part.append((i, k, len(segment.strip()), label, tokens if has_language(segment, tokens) else ()))
                    n_tokens += len(tokens)
                if n_tokens > _BATCH_TOKENS:
                    yield scored(part)
                    part, n_tokens = [], 0
            yield scored(part)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.filter("text is not null").mapInPandas(run, f"id {kind}, seg_no int, n_chars int, lang string, confidence double, label string")


def document_languages(segments_: DataFrame) -> DataFrame:
    """id, lang, confidence, share, n_languages: the language of most characters, the mean confidence of its
    segments and its share of the characters with a language. Documents without any language have no row."""
    by = segments_.filter("lang is not null").groupBy("id", "lang").agg(F.sum("n_chars").alias("chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence"))
    best = by.groupBy("id").agg(F.max(F.struct("chars", F.lit(0).alias("x"), "lang", "confidence")).alias("b"), F.sum("chars").alias("all"), F.count("*").cast("int").alias("n_languages"))
    return best.select("id", F.col("b.lang").alias("lang"), F.col("b.confidence").alias("confidence"), (F.col("b.chars") / F.col("all")).alias("share"), "n_languages")


def mislabelled_segments(docs: DataFrame, id_col: str, text_col: str, label_col: str, samples: DataFrame, min_chars: int = MIN_CHARS, sample_lang: str = "lang", sample_text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, seg_no, lang: segments of at least min_chars characters in a language that the document's label does not name."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), labelled_language(F.col(label_col)).alias("label"))
    found = _scored(texts, _model(samples, sample_lang, sample_text, vocabulary)).filter((F.col("n_chars") >= min_chars) & F.col("lang").isNotNull())
    return found.filter(~F.col("lang").eqNullSafe(F.col("label"))).select("id", "seg_no", "lang").distinct()
