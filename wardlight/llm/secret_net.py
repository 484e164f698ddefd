"""Secrets in texts: exact patterns, and further spans from a character convolutional network.

Candidates are the matches of the patterns, long mixed runs of key characters, and what follows a
word that announces a credential. The network reads each candidate whole with the characters
around it. It is trained in numpy on a labelled table of findings; its probabilities are
calibrated, and its thresholds set under a recall constraint, on findings kept back from the fit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.common import present, slices

#: The kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match starts where a run does, so the look-behind changes nothing but time.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Candidates beside the base matches.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.~@-])[A-Za-z0-9+/_=.~@-]{16,}")
_CUE = re.compile(r"""\b(?:pass(?:phrase|code)?|pwd|pin|credentials?|bearer|auth|(?:private|access|client|signing)[\x20_-]?(?:key|id))["']?(?:\x20is|[\x20:=])["'\x20:=]*([^\s"'<>,;]{6,})""", re.I | re.A)

#: Production parameters.
LEFT, RIGHT = 24, 12   # characters of context
WIDTH = 5              # of a filter
FILTERS = 24
HIDDEN = 24
EPOCHS, BATCH, RATE = 14, 128, 0.01
RECALL = 0.98          # of the kept-back findings of a kind that its threshold must catch
CHUNK = 200_000        # characters convolved at a time

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    folded = text.lower()
    if any(k in folded for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of every candidate: base matches, mixed runs, announced values."""
    found = {(s, e) for s, _, e in base}
    for m in _RUN.finditer(text):
        run = m[0].rstrip(".-=/") if not m[0].endswith("==") else m[0].rstrip(".-/")
        if len(run) >= 16 and any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run):
            found.add((m.start(), m.start() + len(run)))
    for m in _CUE.finditer(text):
        value = m[1].rstrip(".)]!?")
        if len(value) >= 6:
            found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


# --- the network ------------------------------------------------------------------------

SYMBOLS = 98  # printable ASCII, any other character, the text's edge


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 32, 95)


def windows(text: str, spots: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all candidates, end to end, and the sizes (left, inside, right) of each.

    A symbol inside a candidate differs from the same one outside; edges pad the filters.
    """
    codes = _codes(text)
    edge = np.full(WIDTH // 2, 96)
    parts, sizes = [], []
    for s, e in spots:
        a, b = max(0, s - LEFT), min(len(codes), e + RIGHT)
        parts += [edge, codes[a:s], codes[s:e] + SYMBOLS, codes[e:b], edge]
        sizes.append((s - a + len(edge), e - s, b - e + len(edge)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(sizes).reshape(-1, 3)


@dataclass
class Net:
    conv: np.ndarray      # (WIDTH, 2 SYMBOLS, FILTERS)
    conv_bias: np.ndarray
    dense: np.ndarray     # (3 FILTERS, HIDDEN): pooled left, inside, right
    dense_bias: np.ndarray
    out: np.ndarray       # (HIDDEN, 1 + kinds); class 0: no secret
    out_bias: np.ndarray
    heat: float = 1.0     # calibration
    bars: tuple[float, ...] = (0.5, 0.5, 0.5)

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """Filter responses at every symbol."""
        h = WIDTH // 2
        padded = np.concatenate([np.full(h, 96), symbols, np.full(h, 96)])
        n = len(symbols)
        total = self.conv_bias + self.conv[0][padded[:n]]
        for o in range(1, WIDTH):
            total += self.conv[o][padded[o:o + n]]
        return np.maximum(total, 0)

    def scores(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Class scores of the candidates; each region is pooled over all its characters."""
        if not len(sizes):
            return np.zeros((0, len(self.out_bias)))
        pooled = np.maximum.reduceat(self.responses(symbols), np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]]))
        hidden = np.maximum(pooled.reshape(len(sizes), -1) @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias

    def chances(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.heat
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return p / p.sum(axis=1, keepdims=True)


def gradients(net: Net, symbols: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of a batch and its gradients in the order of the parameters."""
    h, n = WIDTH // 2, len(sizes)
    heads = np.concatenate([[0], np.cumsum(sizes.ravel())])
    r = net.responses(symbols)
    pooled = np.maximum.reduceat(r, heads[:-1])
    region = np.repeat(np.arange(3 * n), sizes.ravel())
    at = np.where(r == pooled[region], np.arange(len(r))[:, None], len(r))
    top = np.minimum.reduceat(at, heads[:-1])                    # first position of each maximum
    flat = pooled.reshape(n, -1)
    hidden = np.maximum(flat @ net.dense + net.dense_bias, 0)
    z = hidden @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[np.arange(n), labels] + 1e-12).mean())
    d = p
    d[np.arange(n), labels] -= 1
    d /= n
    d_hidden = (d @ net.out.T) * (hidden > 0)
    d_pooled = (d_hidden @ net.dense.T).reshape(3 * n, -1) * (pooled > 0)
    padded = np.concatenate([np.full(h, 96), symbols, np.full(h, 96)])
    d_conv = np.zeros_like(net.conv)
    columns = np.broadcast_to(np.arange(FILTERS), top.shape)
    for o in range(WIDTH):
        np.add.at(d_conv[o], (padded[top + o], columns), d_pooled)
    return loss, [d_conv, d_pooled.sum(axis=0), flat.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


#: The labelled findings. A slot is {kind:value}; kind "none" is a candidate that is no secret.
#: In values: # digit, h hex digit, H upper hex digit, a letter or digit, A upper letter or digit, B base64 character,
#: w lower letter; a backslash keeps the next character.
FINDINGS = (
    "{assign:\\p\\a\\s\\s\\w\\o\\r\\d = \"aaaaaaaaaa} end", "{assign:\\t\\o\\k\\e\\n = \"hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh}\" then",
    "{assign:\\s\\e\\c\\r\\e\\t: BBBBBBBBBBBBBBBBBBBB}", "set {assign:\\a\\p\\i_\\k\\e\\y=aaaaaaaaaaaaaaaa} now",
    "my pwd is {assign:wwwww##aa} ok", "the passphrase: {assign:aaaa-wwww-####-aaaa}", "pin = {assign:aa####aa}", "login with pass {assign:Awww#wwA##}",
    "credentials: {assign:aaaaaaaaaaaa} are old", "Authorization: Bearer {assign:eyJBBBBBBBBBBBBBBBBBBB.eyJBBBBBBBBBBBBBBBBBBBBBBBBBB.BBBBBBBBBBBBBBBBBBBBBB}",
    "auth={assign:BBBBBBBBBBBBBBBBBBBBBBBBBBBB==} sent", "client_id: {assign:aaaaaaaaaaaaaaaaaaaaaaaa} was leaked", "passcode {assign:A#A#-w#w#A#}",
    "key {access:\\A\\K\\I\\AAAAAAAAAAAAAAAAA} used", "{access:\\A\\K\\I\\AAAAAAAAAAAAAAAAA}.", "id {access:\\A\\S\\I\\AAAAAAAAAAAAAAAAA} there",
    "use {access:ghp_aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa} to push", "{access:sk_live_aaaaaaaaaaaaaaaaaaaaaaaa}", "hook {access:xoxb-############-aaaaaaaaaaaaaaaaaaaaaaaa}",
    "{access:AIzaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa} in the page", "access key {access:AAAAAAAAAAAAAAAAAAAA}", "{access:glpat-aaaaaaaaaaaaaaaaaaaa} for the build",
    "{hex:hhhhhhhhhhhhhhhhhhhhhhhh} here", "a {hex:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh} b", "key: {hex:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH} now",
    "{hex:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH}", "private key {hex:0\\xHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH}", "seed {hex:hhhhhhhh-hhhhhhhh-hhhhhhhh-hhhhhhhh} kept",
    "write to {none:wwwwww##.wwww#}@example.com today", "{none:wwwww.##@mail#.example.com} and", "www {none:wwwww.##@wwwww.example.com} www", "pass {none:wwwwww.##@mail#.example.com} on", "see {none:www.example#.com/wwwwww/wwwwwww} there",
    "https:{none://www.wwwwwwww.org/##/wwwwww-wwwww-#} page", "open {none:/wwww/wwwww/wwwwwww##/wwww.www} file", "file {none:wwwwwww_wwwwwww_20##.www}",
    "order {none:ORDER-####-####-####} was sent", "on {none:20##-##-##T##}:##:##Z it", "at {none:20##-##-##T##.##.##} it", "version {none:wwwwwww-#.##.#-wwwwwww#}",
    "isbn {none:978-#-##-######-w} of", "wwwww {none:wwwwwwwwww-wwwwwwww-#wwwwww} wwww", "card {none:4###-####-####-####w} no", "no {none:1#1#1#1#1#1#1#1#1w} yet",
    "the {none:wwwwwwwwwwwwwwwwwww#} of", "word {none:wwwww.Awwww###wwwwwwwww} next", "wwww {none:wwwwwwww--------##}-------- end", "x {none:=========wwww#}========= y",
    "to pass {none:through} the", "they pass {none:wwwwwwww} it", "pin {none:wwwwwww} the", "auth is {none:wwwwwwww} for", "bearer {none:wwwwwww} of", "client id {none:wwwwwww} the",
    "pass {none:wwwwww.Awww} and", "passcode is {none:required} for", "figure {none:wwwww_##_wwwwww_##} shows", "ref {none:wwww20####wwwww.20##} in", "{none:wwwwwwwwwwww###wwwww}",
    "{none:Awwwwwwww.##.Awwwwww.Awww}", "wwww {none:wwwwww20##wwwwwwwwww20##} www", "{none:#wwwwwwww.wwwwwwww.wwwww} it",
)
_ALPHABET = {"#": "0123456789", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "a": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "B": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "w": "etaoinshrdlucmfwypvbgk"}


def findings(copies: int = 24) -> list[tuple[str, int, int, int]]:
    """The labelled table: (text, start, end, class), slots filled from hashes; words of varying length around them."""
    rows = []
    for n in range(copies):
        for i, pattern in enumerate(FINDINGS):
            stream = iter(hashlib.shake_256(f"{n}|{i}".encode()).digest(600))
            before, kind, value, after = re.fullmatch(r"(.*)\{(\w+):((?:\\.|[^}])*)\}(.*)", pattern).groups()

            def fill(text: str, always: bool) -> str:
                out, k = "", 0
                while k < len(text):
                    c = text[k]
                    if c == "\\":
                        k += 1
                        out += text[k]
                    elif always and c in _ALPHABET:
                        out += _ALPHABET[c][next(stream) % len(_ALPHABET[c])]
                    else:
                        out += c
                    k += 1
                return out

            some = lambda: "".join("etaoinshrdlu"[next(stream) % 12] for _ in range(next(stream) % 9))
            literal = value in ("through", "required")
            head = f"{some()} {some()} {before}"
            body = value if literal else fill(value, True)
            rows.append((f"{head}{body}{after} {some()} {some()}", len(head), len(head) + len(body), 0 if kind == "none" else 1 + KINDS.index(kind)))
    return rows


def _stacked(rows: list[tuple[str, int, int, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [windows(t, [(s, e)]) for t, s, e, _ in rows]
    return [p[0] for p in parts], np.concatenate([p[1] for p in parts]), np.array([r[3] for r in rows])


def calibrate(net: Net, scores: np.ndarray, labels: np.ndarray) -> None:
    """Set the temperature by likelihood, then per kind the bar of best precision among those
    that keep the recall (of equal ones the middle)."""
    nll = lambda t: -np.log(Net.chances(_heated(net, t), scores)[np.arange(len(labels)), labels] + 1e-12).mean()
    net.heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=nll)
    p = net.chances(scores)
    bars = []
    for k in range(1, p.shape[1]):
        own = np.sort(p[labels == k, k])
        most = own[int((1 - RECALL) * len(own))] if len(own) else 1.0
        marks = np.unique(np.concatenate([p[:, k][p[:, k] <= most], [most]]))
        precise = np.array([(labels[p[:, k] >= m] == k).mean() for m in marks])
        good = marks[precise == precise.max()]
        bars.append(float(max((good[0] + good[-1]) / 2, 0.5)) if most >= 0.5 else float(most))
    net.bars = tuple(bars)


def _heated(net: Net, heat: float) -> Net:
    return Net(net.conv, net.conv_bias, net.dense, net.dense_bias, net.out, net.out_bias, heat)


def train(rows: list[tuple[str, int, int, int]] | None = None, seed: int = 7) -> Net:
    """Fit the network on a labelled table (the built-in one by default); every fourth row is kept back to calibrate it."""
    rows = findings() if rows is None else rows
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[::4]
    fit = np.setdiff1d(order, held)
    texts, sizes, labels = _stacked(rows)
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.12, (WIDTH, 2 * SYMBOLS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.15, (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 0.2, (HIDDEN, 1 + len(KINDS))), np.zeros(1 + len(KINDS)))
    params = [net.conv, net.conv_bias, net.dense, net.dense_bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            _, grads = gradients(net, np.concatenate([texts[i] for i in at]), sizes[at], labels[at])
            t += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * a / (1 - 0.9 ** t) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    calibrate(net, net.scores(np.concatenate([texts[i] for i in held]), sizes[held]), labels[held])
    return net


# --- the operator -----------------------------------------------------------------------

def added_spans(net: Net, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """Candidates that the network takes for secrets and that meet no base span.

    All candidates of the texts are scored, some hundred thousand characters at a time.
    """
    out: list[list[Span]] = [[] for _ in texts]
    symbols, sizes, places, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        p = net.chances(net.scores(np.concatenate(symbols), np.concatenate(sizes)))
        kind = p[:, 1:].argmax(axis=1)
        good = p[np.arange(len(p)), kind + 1] >= np.array(net.bars)[kind]
        for i in np.flatnonzero(good):
            at, s, e = places[i]
            if all(b <= s or a >= e for a, _, b in bases[at]) and (not out[at] or out[at][-1][2] <= s):
                out[at].append((s, int(kind[i]), e))
        symbols.clear(), sizes.clear(), places.clear()
        held = 0

    for at, (text, base) in enumerate(zip(texts, bases)):
        spots = candidates(text, base)
        for i in range(0, len(spots), 1000):
            x, z = windows(text, spots[i:i + 1000])
            symbols.append(x), sizes.append(z)
            places.extend((at, s, e) for s, e in spots[i:i + 1000])
            held += len(x)
            if held > CHUNK:
                flush()
    if places:
        flush()
    return out


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Net | None = None) -> DataFrame:
    """One row per document: key, base counts per kind, base_sha256, all spans, n_added.

    Spans are kind:start:end in code points, in the order of start and kind. Base spans stay
    whatever the network says of them; it adds candidates that meet none of them. Null and
    empty texts have no spans (their digest is that of the empty text); repeated rows give equal
    rows; an empty table gives an empty one; other columns are ignored. The plan is narrow; a long
    text is scanned as a whole, its candidates some thousand at a time.
    """
    net = train() if net is None else net

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in slices(list(texts)):
                bases = [base_spans(t) for t in part]
                for base, more in zip(bases, added_spans(net, part, bases)):
                    counts = np.bincount([k for _, k, _ in base], minlength=3).tolist() if base else [0] * 3
                    rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + more), len(more)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    spans = F.pandas_udf(find, FOUND)
    return docs.select(F.col(key), spans(present(text)).alias("f")).select(key, "f.*")
