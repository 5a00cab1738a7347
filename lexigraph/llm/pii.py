"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns' spans stay as they are. The model, trained here in numpy from labelled spans (secrets, names with a title or
after a cue, addresses, account and social numbers, obfuscated mail, set into pieces of the corpus's texts, beside version
numbers, years, prices, long numbers and capitalised words that are none), tags characters outside / begin / inside. It
reads windows of WINDOW characters that overlap by WINDOW - STEP; each character takes its tag scores from the window in
whose middle it lies most, so a text's windows are reconciled before one Viterbi pass decodes each whole text globally. The
windows slide over all of every text. Spans that touch a pattern's span are dropped; the others are of kind "other".

Training is seeded, on pieces of at most TEXTS texts (least hash of id and text below a threshold set from the count of
rows, at a place drawn by that hash; a bounded sample for a model), so reruns agree.

Defined results: null and empty texts have no spans; texts are scanned whole, in time linear in their length; repeated
rows get equal rows; ties don't arise (patterns are leftmost, a tag tie takes the first of outside, begin, inside); extra
columns don't matter; an empty table gives an empty result (the model then trains without background).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 192, 160
TRAINED = 96  # characters of a training window
BLOCK = 128  # characters that Viterbi takes at once, for each tag before them
TEXTS, PIECE, HIDDEN, EPOCHS = 800, 1500, 8, 9
#: What beginning a span costs beyond what was learnt: prose is far more frequent in a corpus than among the examples.
CAUTION = 2.0
TAGS = 3  # outside, begin, inside

# Fixed patterns. Possessive and anchored forms of the same languages, so that no text takes more than linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may be personal data in a piece of background: it is left out there.
_SUSPECT = re.compile(r"\S*@\S*|\S*[0-9a-fA-F-]{16,}\S*|\+?[0-9(][0-9 ().-]{6,}|[0-9]+(?:\.[0-9]+){3}")
_STREETS = "Street Avenue Road Lane Drive Square Boulevard".split()
_TITLES = "Mr. Mrs. Ms. Dr. Prof.".split()
_NAME_CUES = ("my name is ", "Name: ", "Contact: ", "contact ", "signed, ", "Sincerely, ")
_SECRET_CUES = ("token = ", "token: ", "password: ", "password = ", "api_key=", "key: ", "secret = ", "Bearer ", "pwd=")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run of its letters before the sign, as far as the last match's end."""
    out, free = [], 0
    for m in re.finditer("@", text):
        at = m.start()
        if at < free:
            continue
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (d := _DOMAIN.match(text, at)):
            out.append((begin, d.end()))
            free = d.end()
    return out


def patterns(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        digits = lambda s: re.sub("[^0-9]", "", s)
        small = lambda part: len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        found["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and _luhn(d)]
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15] if "+" in text else []
    return found


# The model. Symbols: 0 pad, 1 other letter, 2 other, 3 white space, then ASCII 33 to 126.
def _symbols() -> np.ndarray:
    table = np.full(128, 2, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[33:127] = np.arange(4, 98)
    return table


_ASCII = _symbols()
SYMBOLS = 98


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.uint8(1)).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Tagger:
    """Weights: per direction a table of inputs (symbols x 4H), recurrent weights (H x 4H); output (2H x tags); transitions."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        new = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.w = {"xf": new(SYMBOLS, 4 * h), "hf": new(h, 4 * h), "xb": new(SYMBOLS, 4 * h), "hb": new(h, 4 * h), "o": new(2 * h, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}
        for k in ("xf", "xb"):
            self.w[k][:, h : 2 * h] += 1.0  # forget gates start open

    def _run(self, x: np.ndarray, back: bool, keep: bool = False):
        """x: time x batch. Hidden states, and with keep what the gradient needs."""
        w, u = self.w["xb" if back else "xf"], self.w["hb" if back else "hf"]
        n, size = x.shape
        hid = np.zeros((n, size, HIDDEN), np.float32)
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        kept = []
        for t in range(n - 1, -1, -1) if back else range(n):
            a = w[x[t]] + h @ u
            sig = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            th = np.tanh(c)
            if keep:
                kept.append((t, i, f, o, g, before, th, h))
            h = o * th
            hid[t] = h
        return hid, kept

    def _states(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Twice the hidden states (time x units x batch), as _run gives them: half-scaled gates, so that one tanh serves all."""
        h3 = 3 * HIDDEN
        scale = np.repeat(np.array([0.5, 1.0], np.float32), [h3, HIDDEN])
        w = (self.w["xb" if back else "xf"] * scale).astype(np.float32)
        u = np.ascontiguousarray((self.w["hb" if back else "hf"] * scale * np.float32(0.5)).T.astype(np.float32))
        n, size = x.shape
        hid = np.zeros((n, HIDDEN, size), np.float32)
        h, c, th = (np.zeros((HIDDEN, size), np.float32) for _ in range(3))
        rows, a, r = np.empty((size, 4 * HIDDEN), np.float32), np.empty((4 * HIDDEN, size), np.float32), np.empty((4 * HIDDEN, size), np.float32)
        for t in range(n - 1, -1, -1) if back else range(n):
            np.take(w, x[t], axis=0, out=rows, mode="clip")
            np.copyto(a, rows.T)
            np.dot(u, h, out=r)
            a += r
            np.tanh(a, out=a)
            a[:h3] += np.float32(1)  # twice the gates
            c *= a[HIDDEN : 2 * HIDDEN]
            np.multiply(a[:HIDDEN], a[h3:], out=th)
            c += th
            c *= np.float32(0.5)
            np.tanh(c, out=th)
            h = hid[t]
            np.multiply(a[2 * HIDDEN : h3], th, out=h)
        return hid

    def scores(self, x: np.ndarray) -> np.ndarray:
        """x: batch x time -> batch x time x tags."""
        x = np.ascontiguousarray(x.T).astype(np.intp)
        o = np.ascontiguousarray(self.w["o"].T) * np.float32(0.5)
        out = np.matmul(o[:, :HIDDEN], self._states(x, False))
        out += np.matmul(o[:, HIDDEN:], self._states(x, True))
        out += self.w["b"][:, None]
        return np.ascontiguousarray(out.transpose(2, 0, 1))

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one stretch (time x tags)."""
        n = len(e)
        back = np.zeros((n, TAGS), np.int8)
        best = e[0] + self.w["s"]
        for t in range(1, n):
            step = best[:, None] + self.w["t"]
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + e[t]
        tags = np.zeros(n, np.int8)
        tags[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def _backward(self, x: np.ndarray, back: bool, kept: list, dh_all: np.ndarray, grads: dict) -> None:
        w, u = "xb" if back else "xf", "hb" if back else "hf"
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        seen, sent = [], []
        for t, i, f, o, g, before, th, h in reversed(kept):
            dh = dh + dh_all[t]
            do = dh * th
            dc = dc + dh * o * (1 - th * th)
            a = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            seen.append(x[t])
            sent.append(a)
            grads[u] += h.T @ a
            dh, dc = a @ self.w[u].T, dc * f
        which = np.concatenate(seen)
        order = np.argsort(which, kind="stable")
        which = which[order]
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        grads[w][which[first]] += np.add.reduceat(np.concatenate(sent)[order], first, axis=0)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of tags y (batch x time) under the CRF, and gradients."""
        size, n = x.shape
        xt = np.ascontiguousarray(x.T)
        hf, kf = self._run(xt, False, True)
        hb, kb = self._run(xt, True, True)
        hid = np.concatenate([hf, hb], axis=2)
        e = hid @ self.w["o"] + self.w["b"]  # time x batch x tags
        trans, start = self.w["t"], self.w["s"]

        def lse(v, axis):
            m = v.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha = [e[0] + start]
        for t in range(1, n):
            alpha.append(lse(alpha[-1][:, :, None] + trans, 1) + e[t])
        z = lse(alpha[-1], 1)
        beta = [np.zeros((size, TAGS), np.float32)]
        for t in range(n - 2, -1, -1):
            beta.append(lse(trans + (e[t + 1] + beta[-1])[:, None, :], 2))
        beta.reverse()
        yt, rows = y.T, np.arange(size)
        gold = start[yt[0]] + sum(e[t][rows, yt[t]] for t in range(n)) + sum(trans[yt[t - 1], yt[t]] for t in range(1, n))
        de = np.exp(np.stack(alpha) + np.stack(beta) - z[:, None])
        for t in range(n):
            de[t][rows, yt[t]] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, n):
            p = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            grads["t"] += p.sum(axis=0)
            np.add.at(grads["t"], (yt[t - 1], yt[t]), -1)
        grads["s"] += de[0].sum(axis=0)
        grads["b"] += de.sum(axis=(0, 1))
        grads["o"] += np.einsum("tbh,tbk->hk", hid, de)
        dh = (de @ self.w["o"].T).astype(np.float32)
        self._backward(xt, False, kf, dh[:, :, :HIDDEN], grads)
        self._backward(xt, True, kb, dh[:, :, HIDDEN:], grads)
        return float((z - gold).mean()), {k: v / size for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 96, rate: float = 0.025, seed: int = 4) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m, v, k = ({n: np.zeros_like(w) for n, w in self.w.items()} for _ in range(2)), 0, 0
        first, second = m
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                loss, grads = self.loss(x[order[at : at + batch]], y[order[at : at + batch]])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                k += 1
                for n, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.w[n] = (self.w[n] - rate * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
        return losses


def _made(rng: np.random.Generator) -> tuple[str, str, str]:
    """What stands before, labelled personal data (or an empty string), and what stands after, as one stretch of text."""
    some = lambda xs: xs[int(rng.integers(0, len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    of = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    low, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = low + low.upper() + "0123456789"
    n, k = int(rng.integers(3, 9)), int(rng.integers(4, 9))
    word, name = of(low, n), lambda: of(low, int(rng.integers(3, 9))).capitalize()
    kind, quote = int(rng.integers(0, 26)), some(['"', '"', "'", ""])
    if kind < 4:
        secret = of(hexes, int(some([32, 40, 40, 40, 64])))
        return some([*_SECRET_CUES, ""]) + quote, secret.upper() if rng.random() < 0.2 else secret, quote
    if kind == 4:
        return some(_SECRET_CUES) + quote, some(["", "sk_", "AKIA", "ghp_"]) + of(mixed, int(rng.integers(16, 40))), quote
    if kind == 5:
        return some(_SECRET_CUES) + quote, of(mixed + "!#%*", int(rng.integers(8, 14))), quote
    if kind == 6:
        return some(["", "write to ", "mail "]), f"{word} {some(['(at)', '[at]'])} {of(low, k)} {some(['dot', '(dot)'])} {some(['com', 'org', 'net'])}", ""
    if kind < 9:
        return some(_TITLES) + " ", f"{name()} {name()}", ""
    if kind == 9:
        return some(_NAME_CUES), f"{name()} {name()}", ""
    if kind < 12:
        return some(["", "lives at ", "Address: "]), f"{rng.integers(1, 999)} {name()} {some(_STREETS)}", ""
    if kind == 12:
        return some(["", "SSN ", "ssn: "]), f"{digits(3)}-{digits(2)}-{digits(4)}", ""
    if kind == 13:
        return some(["", "call ", "tel. "]), f"({digits(3)}) {digits(3)}-{digits(4)}", ""
    if kind == 14:
        return some(["", "IBAN "]), f"{of(low[:20].upper(), 2)}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}", ""
    # None of these is personal data.
    said = some([
        f"{rng.integers(1900, 2030)}", f"{rng.integers(0, 9)}.{rng.integers(0, 9)}", f"${rng.integers(1, 900)}", f"{rng.integers(1, 99)} {word}", f"Version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.",
        f"version {rng.integers(1, 9)}.", f"{rng.integers(1, 99)}.", f"License, Version {rng.integers(1, 9)}.0.", f"CC BY-NC {rng.integers(1, 9)}.0.", digits(16), digits(int(rng.integers(5, 20))), digits(16) + "!!", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        word.upper() + "!!", name() + " " + name(), word.capitalize() + ".", f"the {word} at the {of(low, k)} dot", f"{name()} {some(_STREETS)}", f"a {some(['token', 'key', 'password', 'secret'])} {word}", "| " + word + " |", "*" * n + word, f"{word}$$$ {of(low, k)}###",
    ])
    return said, "", ""


def examples(backgrounds: list[str], count: int = 4000, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: labelled spans in texts of the corpus."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((count, TRAINED), np.uint8), np.zeros((count, TRAINED), np.int64)
    plain = [t for b in backgrounds if (t := _SUSPECT.sub(" ", b)).strip()] or ["the of and to in"]  # whitespace alone is no background
    shout = [b.upper() for b in plain[: len(plain) // 20]]
    for i in range(count):
        text, tags = "", []
        if i % 3 == 0:  # most of a corpus is prose without personal data
            b = plain[int(rng.integers(0, len(plain)))]
            at = int(rng.integers(0, max(1, len(b) - TRAINED)))
            text = b[at : at + TRAINED]
            tags = [0] * len(text)
        while len(text) < TRAINED + 20:
            of = shout if shout and rng.random() < 0.05 else plain
            b = of[int(rng.integers(0, len(of)))]
            at = int(rng.integers(0, max(1, len(b) - 60)))
            lead = b[at : at + int(rng.integers(2, 50))] + some_space(rng)
            text += lead
            tags += [0] * len(lead)
            if rng.random() < 0.8:
                before, held, after = _made(rng)
                after += "," if rng.random() < 0.1 else "." if rng.random() < 0.1 else "!!" if of is shout else "###" if rng.random() < 0.05 else ""
                after += some_space(rng)
                text += before + held + after
                tags += [0] * len(before) + [1][: len(held)] + [2] * (len(held) - 1) + [0] * len(after)
        shift = int(rng.integers(0, len(text) - TRAINED + 1))
        x[i] = symbols(text[shift : shift + TRAINED])
        y[i] = tags[shift : shift + TRAINED]
    y[:, 0][y[:, 0] == 2] = 1
    return x, y


def some_space(rng: np.random.Generator) -> str:
    return "\n" if rng.random() < 0.1 else " "


def pieces(docs: DataFrame) -> list[str]:
    """Pieces of at most TEXTS texts, from about twice as many rows, however large the table."""
    h, length = F.xxhash64("doc_id", "text"), F.length("text")
    begin = (F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.greatest(F.lit(1), length - PIECE + 1)) + 1).cast("int")
    share = min(1.0, 2 * TEXTS / max(1, docs.count()))
    below = F.pmod(h, F.lit(1 << 32)) < int(share * (1 << 32))
    rows = docs.where("text is not null").where(below).select(F.col("text").substr(begin, F.lit(PIECE)).alias("piece"), h.alias("h")).orderBy("h").limit(TEXTS).collect()
    return [r.piece for r in rows]


def harder(model: Tagger, backgrounds: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows where the model errs: new examples, and backgrounds, in which whatever it finds is none."""
    x, y = examples(backgrounds, count, seed)
    tags = np.stack(_decode(model, list(model.scores(x))))
    wrong = (tags != y).any(axis=1)
    xs, ys = [x[wrong]], [y[wrong]]
    plain = [_SUSPECT.sub(" ", b) for b in backgrounds]
    for text, found in zip(plain, added(model, plain), strict=True):
        for a, b in found[:6]:
            at = max(0, min((a + b - TRAINED) // 2, len(text) - TRAINED))
            window = np.zeros((1, TRAINED), np.uint8)
            own = symbols(text[at : at + TRAINED])
            window[0, : len(own)] = own
            xs.append(window)
            ys.append(np.zeros((1, TRAINED), np.int64))
    return np.concatenate(xs), np.concatenate(ys)


def fitted(backgrounds: list[str], count: int = 4000) -> Tagger:
    """Trained on examples, then twice more on what it got wrong beside some of them."""
    model = Tagger()
    x, y = examples(backgrounds, count)
    model.fit(x, y)
    for turn in (1, 2):
        more = harder(model, backgrounds, count // 2, seed=9 + turn)
        part = slice(turn, None, 3)
        model.fit(np.concatenate([x[part], more[0]]), np.concatenate([y[part], more[1]]), epochs=4, rate=0.01 / turn)
        x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
    model.w["t"][0, 1] -= CAUTION
    model.w["s"][1] -= CAUTION
    return model


def train(docs: DataFrame) -> Tagger:
    return fitted(pieces(docs))


def added(model: Tagger, texts: list[str]) -> list[list[tuple[int, int]]]:
    """The model's spans in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    group: list[int] = []
    room = 0
    for t, text in enumerate(texts):
        if text:
            group.append(t)
            room += len(text) + WINDOW
        if group and (room >= 1 << 20 or t == len(texts) - 1):  # a bound on what stands in memory
            for i, tags in zip(group, _tags(model, [symbols(texts[i]) for i in group]), strict=True):
                out[i] = _spans_of(texts[i], tags)
            group, room = [], 0
    return out


def _tags(model: Tagger, codes: list[np.ndarray]) -> list[np.ndarray]:
    counts = [1 + max(0, -(-(len(c) - WINDOW) // STEP)) for c in codes]
    windows = np.zeros((sum(counts), WINDOW), np.uint8)
    at = 0
    for c, k in zip(codes, counts, strict=True):
        padded = np.zeros((k - 1) * STEP + WINDOW, np.uint8)
        padded[: len(c)] = c
        windows[at : at + k] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
        at += k
    scores = np.concatenate([model.scores(windows[i : i + 2048]) for i in range(0, len(windows), 2048)])
    joined, at, edge = [], 0, (WINDOW - STEP) // 2
    for c, k in zip(codes, counts, strict=True):
        # Of two windows that overlap, the character is deeper in the first up to the middle of the overlap.
        e = scores[at : at + k]
        joined.append(np.concatenate([e[0, :edge], e[:, edge : edge + STEP].reshape(-1, TAGS), e[-1, edge + STEP :]])[: len(c)])
        at += k
    return _decode(model, joined)


def _spans_of(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    on = tags > 0
    out = []
    for i in np.flatnonzero(on & ((tags == 1) | np.concatenate([[True], ~on[:-1]]))).tolist():
        j = i + 1
        while j < len(tags) and tags[j] == 2:
            j += 1
        piece = text[i:j]
        left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
        if right > left:
            out.append((i + left, i + right))
    return out


def _decode(model: Tagger, all_scores: list[np.ndarray]) -> list[np.ndarray]:
    """Viterbi of every text at once, exactly: blocks keep their best path for each tag before and each tag at their end, the
    blocks of a text are then joined, so that time goes by characters and not by the longest text."""
    counts = np.array([-(-len(e) // BLOCK) for e in all_scores])
    first = np.concatenate([[0], np.cumsum(counts)])
    size = np.full(int(first[-1]), BLOCK)
    size[first[1:] - 1] = [len(e) - (c - 1) * BLOCK for e, c in zip(all_scores, counts, strict=True)]
    e = np.zeros((len(size), BLOCK, TAGS), np.float32)
    for i, own in enumerate(all_scores):
        e[first[i] : first[i + 1]].reshape(-1, TAGS)[: len(own)] = own
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(BLOCK))  # blocks longer than t stand first
    e = np.ascontiguousarray(e[order].transpose(1, 2, 0))
    trans, start = model.w["t"], model.w["s"]
    enter = np.repeat(trans[:, :, None], len(size), axis=2)
    enter[:, :, np.argsort(order)[first[:-1]]] = start[None, :, None]
    best = enter + e[0][None]  # tag before x tag now x block
    back = np.zeros((BLOCK, TAGS, TAGS, len(size)), np.int8)
    for t in range(1, BLOCK):
        k = int(live[t])
        if not k:
            break
        step = np.empty((TAGS, TAGS, k), np.float32)
        for now in range(TAGS):
            top, came = best[:, 0, :k] + trans[0, now], back[t, :, now, :k]
            for j in range(1, TAGS):
                other = best[:, j, :k] + trans[j, now]
                np.copyto(came, np.int8(j), where=other > top)
                np.maximum(top, other, out=top)
            step[:, now] = top
        step += e[t, :, :k]
        best[:, :, :k] = step
    best = np.ascontiguousarray(best.transpose(2, 0, 1))
    spot = np.argsort(order)
    before = np.zeros(len(size), np.int64)
    last = np.zeros(len(size), np.int64)
    for i in range(len(all_scores)):
        value, came = np.zeros(TAGS), []
        for b in range(first[i], first[i + 1]):
            step = value[:, None] + best[spot[b]].astype(np.float64)
            came.append(step.argmax(axis=0))
            value = step.max(axis=0)
        tag = int(value.argmax())
        for b in range(first[i + 1] - 1, first[i] - 1, -1):
            last[spot[b]] = tag
            tag = int(came[b - first[i]][tag])
            before[spot[b]] = tag
    tags = np.zeros((len(size), BLOCK), np.int8)
    now, rows = last.copy(), np.arange(len(size))
    for t in range(BLOCK - 1, -1, -1):
        k = int(live[t])
        tags[:k, t] = now[:k]
        if t:
            now[:k] = back[t, before[:k], now[:k], rows[:k]]
    tags = tags[spot].reshape(-1)
    return [tags[first[i] * BLOCK : first[i] * BLOCK + len(x)] for i, x in enumerate(all_scores)]


def spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the patterns' by kind as listed, then the model's of kind "other", each by start."""
    out = []
    for text, more in zip(texts, added(model, texts), strict=True):
        base = [(k, a, b) for k, found in patterns(text).items() for a, b in found]
        taken = sorted((a, b) for _, a, b in base)
        free = [("other", a, b) for a, b in sorted(more) if not any(x < b and a < y for x, y in taken)]
        out.append(base + free)
    return out


def detected(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The operator: doc_id, and spans as an array of (kind, begin, end) in code points."""
    model = model or train(docs)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = spans(model, [(t or b"").decode("utf-8", "replace") for t in common.as_bytes(part.column(1))])
                rows = [[{"kind": k, "begin": a, "end": b} for k, a, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, begin: int, end: int>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and span strings of `detected`'s rows."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "other")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))

