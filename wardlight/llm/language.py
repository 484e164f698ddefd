"""Language of texts from a conditional random field that labels every word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm import crf
from wardlight.llm.common import crc_mod, present, slices

#: Fixed value: the answer for a text without letters.
UNKNOWN = "und"

#: Production parameters.
FOLDS = 5               # documents whose crc32 is 0 modulo this are held out
SAMPLE = 250            # labelled documents per language that the field is fitted on
SNIPPET = 30            # words of a sampled document that enter a training chain
RUN = 6                 # words of one language in a row in a training chain, on average
WIDTH = 1 << 16         # hashed features
LEXICON = 400           # most frequent words of a language's sample that get a feature of their own
CHAIN = 64              # words per chain; a text is a row of chains
KNOWN = 300_000         # distinct words that a worker remembers

_EDGE = ".,;:!?\"'()[]<>|*%&$#-"


def _features(word: str, lexicon: dict[str, str]) -> list[str]:
    """Affixes of one to three characters, bigrams and trigrams, and the lexicon."""
    w = word.strip(_EDGE).lower()
    if not any(c.isalpha() for c in w):
        return ["none"]
    names = [f"^{w[:n]}" for n in (1, 2, 3)] + [f"{w[-n:]}$" for n in (1, 2, 3)]
    names += [w[i:i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    if w in lexicon:
        names.append(f"={lexicon[w]}")
    return names


def feature_ids(word: str, lexicon: dict[str, str]) -> np.ndarray:
    return np.array([crc32(n.encode("utf-8", "surrogatepass")) % WIDTH for n in _features(word, lexicon)])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def sample(docs: DataFrame, key: str, text: str, lang: str, folds: int = FOLDS, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(lang, text) of at most `size` training documents per language, by a hash of the key.

    Ranked per language with a per-task limit below the shuffle; only the fit sees it.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (crc_mod(key, folds) != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.xxhash64("text"))
    picked = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key)).withColumn(
        "n", F.row_number().over(order)).where(F.col("n") <= size)
    return [(r["lang"], r["text"]) for r in picked.select("lang", "text").collect()]


def train(rows: list[tuple[str, str]]) -> tuple[crf.Model, dict[str, str]]:
    """The field and its lexicon (word -> language it is typical of).

    Training chains switch languages: runs of words of one document follow runs of another,
    so transitions are learned from code-switched text.
    """
    rows = sorted(rows)
    names = sorted({lang for lang, _ in rows})
    snippets, counts = [], {n: Counter() for n in names}
    for i, (lang, text) in enumerate(rows):
        words = text.split()
        counts[lang].update(w.strip(_EDGE).lower() for w in words)
        at = crc32(f"at|{i}".encode()) % max(1, len(words) - SNIPPET)
        if words:
            snippets.append((lang, words[at:at + SNIPPET]))
    lexicon: dict[str, str] = {}
    for lang in names:
        for w, n in counts[lang].most_common(LEXICON):
            if w and all(n * 2 > counts[o][w] * 3 for o in names if o != lang):
                lexicon[w] = lang
    # Snippets in an order given by hashes, cut into runs and dealt two by two.
    snippets.sort(key=lambda s: crc32(f"{s[0]}|{' '.join(s[1])}".encode("utf-8", "surrogatepass")))
    ids, labels, lengths = [], [], []
    for a, b in zip(snippets[::2], snippets[1::2] + snippets[:1]):
        left, right, size = list(a[1]), list(b[1]), 0
        turn = 0
        while left or right:
            take = 1 + crc32(f"{len(ids)}|{turn}".encode()) % (2 * RUN)
            lang, source = (a[0], left) if turn % 2 == 0 else (b[0], right)
            for w in source[:take]:
                ids.append(feature_ids(w, lexicon))
                labels.append(names.index(lang))
                size += 1
            del source[:take]
            turn += 1
        lengths.append(size)
    return crf.train(ids, np.array(labels, np.int64), np.array(lengths, np.int64), names, WIDTH, rounds=30), lexicon


class Labeller:
    """Scores of distinct words under a model, remembered between batches."""

    def __init__(self, model: crf.Model, lexicon: dict[str, str]):
        self.model, self.lexicon, self.rows, self.names = model, lexicon, {}, {}
        self._forget()

    def _forget(self) -> None:
        self.rows, self.names = {}, {}
        self.table, self.wordy = np.zeros((0, len(self.model.labels))), np.zeros(0, bool)

    def _learn(self, fresh: list[str]) -> None:
        flat, sizes, names = [], [], self.names
        for w in fresh:
            self.rows[w] = len(self.rows)
            found = _features(w, self.lexicon)
            for n in found:
                i = names.get(n)
                if i is None:
                    i = names[n] = crc32(n.encode("utf-8", "surrogatepass")) % WIDTH
                flat.append(i)
            sizes.append(len(found))
        rows = self.model.weights[np.array(flat)]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.table = np.concatenate([self.table, np.add.reduceat(rows, starts, axis=0)])
        self.wordy = np.append(self.wordy, np.fromiter((has_letter(w) for w in fresh), bool, len(fresh)))

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > KNOWN:
            self._forget()
        fresh = [w for w in set(words) if w not in self.rows]
        if fresh:
            self._learn(fresh)
        return np.fromiter((self.rows[w] for w in words), np.int64, len(words))

    def scores(self, words: list[str]) -> np.ndarray:
        ids = self.ids(words)  # may grow the table
        return self.table[ids]

    def label(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(language, score, switches) of each text.

        The score is the mean probability of the language over words with a letter;
        switches count neighbouring words whose likeliest languages differ.
        """
        split = [t.split() for t in texts]
        flat = [w for words in split for w in words]
        k = len(self.model.labels)
        if not flat or not k:
            return [(UNKNOWN, 0.0, 0)] * len(texts)
        lengths = np.array([n for w in split for n in [CHAIN] * (len(w) // CHAIN) + [len(w) % CHAIN] if n])
        ids = self.ids(flat)
        p = crf.marginals(self.table[ids], lengths, self.model)
        wordy = self.wordy[ids]
        best = p.argmax(axis=1)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        total = np.stack([np.bincount(owner, p[:, j] * wordy, len(texts)) for j in range(k)], axis=1)
        many = np.bincount(owner, wordy, len(texts))
        moved = np.append(False, (best[1:] != best[:-1]) & (owner[1:] == owner[:-1]))
        turns = np.bincount(owner, moved, len(texts))
        return [(self.model.labels[int(t.argmax())], float(t.max() / n), int(s)) if n else (UNKNOWN, 0.0, 0)
                for t, n, s in zip(total, many, turns)]


ANSWER = "lang_pred string, score double, n_switches long"


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, n_switches.

    Fitted on a bounded sample of training documents; predictions use the text alone.
    Null texts and texts without letters are `und` with score 0, as is everything if no
    training label exists. Repeated rows give equal rows; an empty table gives an empty
    one; other columns are ignored. A long text is many chains; the plan is narrow.
    """
    model, lexicon = train(sample(docs, key, text, lang, folds))

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model, lexicon)
        for texts in batches:
            rows = [r for part in slices(list(texts)) for r in labeller.label(part)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "n_switches"])

    label.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    answer = F.pandas_udf(label, ANSWER)
    return docs.select(F.col(key), (crc_mod(key, folds) == 0).alias("held_out"), answer(present(text)).alias("a")).select(
        key, "held_out", "a.*")
