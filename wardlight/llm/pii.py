"""Personal data in texts: exact patterns, and further spans from a conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.llm import crf
from wardlight.llm.common import present, slices

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, so the look-behind changes nothing but time.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Production parameters.
CHAIN = 128            # words per chain; a text is a row of chains
WIDTH = 1 << 12        # hashed features
KNOWN = 200_000        # distinct words that a worker remembers

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain from each "@" outwards: linear on long runs without one."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    out = [(s, 0, e) for s, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def shape(word: str) -> str:
    """X, x, 9 for upper, lower and digits, other characters as they are; runs of one kind shortened to two."""
    out: list[str] = []
    for c in word:
        k = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def _features(word: str) -> list[str]:
    bare = word.strip(".,;:!?\"'()[]<>")
    digits = [c for c in bare if "0" <= c <= "9"]
    return [f"s{shape(word)}", f"b{shape(bare)}", f"d{min(len(digits), 20)}",
            f"@{bare.count('@')}.{min(bare.count('.'), 4)}-{min(bare.count('-'), 4)}",
            f"l{bool(digits) and 12 <= len(digits) <= 19 and luhn(''.join(digits))}",
            f"i{all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in bare.split('.'))}{bare.count('.')}",
            f"p{word[0] if not word[0].isalpha() else 'x'}{'+' in bare}"]


def plain_form(word: str) -> str:
    """A word that has the same features; letters-only words (and one end mark) share a few forms."""
    end = word[-1] if word[-1] in ".,!" else ""
    body = word[:-1] if end else word
    if body.isalpha():
        if body.islower():
            return ("a" if len(body) == 1 else "ab") + end
        if body.isupper():
            return ("A" if len(body) == 1 else "AB") + end
        if body[0].isupper() and body[1:].islower():
            return ("Ab" if len(body) == 2 else "Abc") + end
    return word


def feature_ids(word: str, before: str, after: str) -> np.ndarray:
    names = [f"0{f}" for f in _features(word)]
    names += [f"-{f}" for f in _features(before)[1:3]] if before else ["-"]
    names += [f"+{f}" for f in _features(after)[1:3]] if after else ["+"]
    return np.array([crc32(n.encode()) % WIDTH for n in names])


#: Sentences whose slots give the labelled table; "#" is a digit, "L" a digit that
#: completes a Luhn number, "B" one that breaks it.
SENTENCES = (
    "write to {email:user.##@mail#.example.com} today", "or {email:ann_##@site.example.org} in the end.",
    "reach me at {email:j.doe@corp-#.example.net}, please", "send it to {email:<info##@example.com>} soon",
    "mail {email:name##@host} (no domain given)", "the address {email:x##[at]example.com} was hidden",
    "host {ip:1#.2#.3#.4#} is down", "from {ip:1##.5#.#.9#} and {ip:10.#.#.#}, again", "see {ip:17#.1#.0.#:80#0} there",
    "card {card:4### #### #### ###L} was charged", "pay with {card:5##############L} now", "number {card:4###-####-####-###L}.",
    "call {phone:+1 (###) 555-####} now", "phone {phone:+49 ### #######} or fax", "tel {phone:+33 # ## ## ## ##}.",
    "dial {phone:(###) 555-####} at noon", "my phone is {phone:###-555-####}, call", "ring {phone:0## 555 ####} later",
    "in 20## there were ## people", "order ######## was sent", "version #.#.# came after #.##", "page ## of ###, line #",
    "it cost $#,###.## or #%%", "at ##:## on ##.##.20##", "the code ###############B failed", "item ##############B of the list",
    "he said it (again) and left.", "a b c D E. Then the end!", "WORD!! AND!! MORE!!", "one | two | three", "x% of y&& is z***",
    "and the small house near the river stood there.", "Über den Fluss, nach Hause.", "é à la maison ou là",
    "see chapter #, section ##-##", "room ###-## and box ####", "scores were #-# and ##:##", "lat ##.#### lon -##.####",
)


def labelled_rows(copies: int = 12) -> list[tuple[int, str, str]]:
    """The small labelled table: (sentence, word, label), slots filled with digits from hashes."""
    rows = []
    for n in range(copies):
        for s, pattern in enumerate(SENTENCES):
            stream = iter(hashlib.sha512(f"{n}|{s}".encode()).hexdigest() * 2)

            def fill(text: str) -> str:
                out = "".join(str(int(next(stream), 16) % 10) if c == "#" else c for c in text.replace("%%", "%"))
                for mark, good in (("L", True), ("B", False)):
                    if re.search(f"[0-9]{mark}", out):
                        head = out.split(mark)[0]
                        digits = "".join(c for c in head if c.isdigit())
                        last = next(d for d in "0123456789" if luhn(digits[-18:] + d) == good)
                        out = re.sub(f"(?<=[0-9]){mark}", last, out, count=1)
                return out

            for part in re.split(r"(\{[a-z]+:[^}]*\}[^\x20]*)", pattern):
                slot = re.fullmatch(r"\{([a-z]+):([^}]*)\}([^\x20]*)", part)
                label, body = (slot[1], slot[2] + slot[3]) if slot else ("O", part)
                rows += [(n * len(SENTENCES) + s, w, label) for w in fill(body).split()]
    return rows


def train(rows: list[tuple[int, str, str]] | None = None) -> crf.Model:
    """Fit the field on a labelled table (the built-in one by default)."""
    rows = labelled_rows() if rows is None else rows
    names = ["O", *KINDS]
    ids, labels, lengths = [], [], []
    for i, (s, w, label) in enumerate(rows):
        before = rows[i - 1][1] if i and rows[i - 1][0] == s else ""
        after = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == s else ""
        ids.append(feature_ids(w, before, after))
        labels.append(names.index(label))
        if i and rows[i - 1][0] == s:
            lengths[-1] += 1
        else:
            lengths.append(1)
    return crf.train(ids, np.array(labels), np.array(lengths), names, WIDTH, rounds=80)


class Tagger:
    """Scores of distinct words under a model, remembered between batches."""

    def __init__(self, model: crf.Model):
        self.model, self.rows, self.forms = model, {}, {}
        self.own = self.left = self.right = np.zeros((0, len(model.labels)))
        edge = lambda sign: model.weights[crc32(sign.encode()) % WIDTH]
        self.edges = (edge("-"), edge("+"))

    def _learn(self, fresh: list[str]) -> None:
        w = self.model.weights
        at = lambda sign, names: w[[crc32(f"{sign}{f}".encode()) % WIDTH for f in names]].sum(axis=0)
        new = []
        for word in fresh:
            f = _features(word)
            new.append((at("0", f), at("-", f[1:3]), at("+", f[1:3])))
        grown = [np.concatenate([old, np.array([x[i] for x in new])]) for i, old in enumerate((self.own, self.left, self.right))]
        self.own, self.left, self.right = grown

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > KNOWN:
            self.rows, self.forms = {}, {}
            self.own = self.left = self.right = np.zeros((0, len(self.model.labels)))
        known, forms, fresh = self.rows, self.forms, []
        for word in set(words):
            if word not in known:
                form = plain_form(word)
                if form not in forms:
                    forms[form] = len(forms)
                    fresh.append(form)
                known[word] = forms[form]
        if fresh:
            self._learn(fresh)
        return np.fromiter((known[word] for word in words), np.int64, len(words))

    def tag(self, texts: list[list[str]]) -> np.ndarray:
        """Best labels of all words of the texts, decoded in chains."""
        flat = [w for t in texts for w in t]
        if not flat:
            return np.zeros(0, np.int8)
        ids = self.ids(flat)
        lengths = np.array([n for t in texts for n in [CHAIN] * (len(t) // CHAIN) + [len(t) % CHAIN] if n])
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        s = self.own[ids]
        s[1:] += self.left[ids[:-1]]
        s[:-1] += self.right[ids[1:]]
        s[heads[1:]] -= self.left[ids[heads[1:] - 1]]
        s[heads[1:] - 1] -= self.right[ids[heads[1:]]]
        s[heads] += self.edges[0]
        s[heads + lengths - 1] += self.edges[1]
        out = np.zeros(len(s), np.int8)
        open_ = ~crf.certain(s, lengths, self.model)
        if open_.any():
            tokens = np.repeat(open_, lengths)
            out[tokens] = crf.viterbi(s[tokens], lengths[open_], self.model)
        return out


def added_spans(text: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of words with one kind, trimmed of outer punctuation, that meet no base span."""
    out, words = [], [(m.start(), m.end()) for m in _WORD.finditer(text)]
    hits = np.flatnonzero(labels)
    i = 0
    while i < len(hits):
        j = i
        while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and labels[hits[j + 1]] == labels[hits[i]]:
            j += 1
        start, end = words[hits[i]][0], words[hits[j]][1]
        while end > start and text[end - 1] in ".,;:!?\"')]>":
            end -= 1
        while end > start and text[start] in "\"'[<":
            start += 1
        if end > start and all(e <= start or s >= end for s, _, e in base):
            out.append((start, int(labels[hits[i]]) - 1, end))
        i = j + 1
    return out


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: crf.Model | None = None) -> DataFrame:
    """One row per document: key, base counts per kind, base_sha256, all spans, n_added.

    Spans are kind:start:end in code points, in the order of start and kind. Null and empty
    texts have no spans (their digest is that of the empty text); repeated rows give equal
    rows; an empty table gives an empty one; other columns are ignored. The plan is narrow:
    each task decodes its own Arrow batches, a long text as many chains.
    """
    model = train() if model is None else model

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            rows = []
            for part in slices(list(texts)):
                rows += answer(tagger, part)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    def answer(tagger: Tagger, texts: list[str]) -> list[tuple]:
        split = [_WORD.findall(t) for t in texts]
        labels = tagger.tag(split)
        ends = np.cumsum([len(w) for w in split])
        rows = []
        for t, n, end in zip(texts, map(len, split), ends):
            own = labels[end - n:end]
            base = base_spans(t)
            more = added_spans(t, own, base) if own.any() else []
            counts = np.bincount([k for _, k, _ in base], minlength=4).tolist() if base else [0] * 4
            rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + more), len(more)))
        return rows

    tag.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    spans = F.pandas_udf(tag, FOUND)
    return docs.select(F.col(key), spans(present(text)).alias("f")).select(key, "f.*")
