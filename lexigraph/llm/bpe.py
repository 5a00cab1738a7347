"""BPE encoding and decoding by speculation and verification.

A text is normalised and cut at white space and into pre-tokens; each distinct one is encoded once a task. Speculation:
the longest token of the vocabulary at a place, found in a trie, is proposed. Verification: a proposal stands if the
encoding of its symbols and its left neighbour's is just these two tokens (of a first token's symbols: that token), looked
up in a table of verdicts, which a worker keeps. One that fails gives way to the next shorter token there, and a place
without any to a shorter token before it. Verdicts, and words whose letters aren't all tokens, come from exact merging.

Why pairs suffice: merges of rank order never cross a boundary between two tokens unless they would also cross it when
these two stand alone, so compatible neighbours give a compatible word. So a stretch has one such sequence of tokens, and
a place that no token can follow once need not be reached again: a word takes time in proportion to its length.

The vocabulary file is a parameter; it is read on the driver and sent as a broadcast (its size is that of the file).
Defined results: null is the empty text; empty text has no tokens; very long texts and words are whole; rows are
independent, so repeated rows, ties and extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pre-tokens and stretches between white space that a task remembers, and a worker's verdicts on pairs; beyond it, it starts anew.
MEMORY = 1_000_000
#: What is added to the letter of a word's last symbol, so that each symbol is one character in the trie.
LAST = 0x1000


@functools.cache
def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + more)
        more += b not in plain
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Encoder and decoder for a vocabulary file with word ends."""

    def __init__(self, spec: dict) -> None:
        import regex

        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.ids = {v: k for k, v in [*self.vocab.items(), *self.special.items()]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        self.shown = {i: s + " " for i, s in self.ids.items()}
        self.single: dict[int, bool] = {}  # whether a token encodes as itself
        self.pairs: dict[int, bool] = {}  # verdicts by left * 2^32 + right
        self.odd = re.compile("[\x1c-\x1f]").search
        self._plant()
        self.reset()

    def _plant(self) -> None:
        """The trie of the tokens' symbols (under the empty string the longest token that ends there or before), and each token's next shorter prefix."""
        self.trie: dict = {"": -1}
        self.longest, self.count, self.shorter = 0, {}, {}
        for token, i in sorted(self.vocab.items(), key=lambda x: len(x[0])):
            symbols = self._split(token)
            spelt = "".join(symbols[:-1]) + self._last(symbols[-1])
            node = self.trie
            for c in spelt:
                node = node.setdefault(c, {"": node[""]})
            self.shorter[i], node[""] = node[""], i
            self.count[i], self.longest = len(spelt), max(self.longest, len(spelt))

    def _last(self, symbol: str) -> str:
        return chr(ord(symbol[0]) + LAST) if self.end and len(symbol) > 1 else symbol

    def reset(self) -> None:
        self.known: dict[str, int] = {}  # pre-tokens, and what stands between white space, to the place in the arrays below
        self.ends: list[str] = []  # the tokens' strings, a space after each
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0
        # No stretch between white space begins with a line end: such keys are the special tokens.
        self._add(["\n" + s for s in self.special], [*self.special.values()], [1] * len(self.special), [s + " " for s in self.special])

    @staticmethod
    def load(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def normalise(self, text: str) -> str:
        # A final sigma is lower-cased as any sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def symbols(self, word: str) -> list[str]:
        out = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        out[-1] += self.end
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact: the pair of least rank first, leftmost first; a linked list and a heap, so that long words are no worse."""
        import heapq

        n = len(symbols)
        nxt, prv, sym = [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.merges.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] else -1
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := self.merges.get((sym[x], sym[y]))) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [s for s in sym if s]

    def propose(self, spelt: str) -> list[int]:
        """Longest tokens first, each verified beside its left neighbour; nothing if the vocabulary lacks a letter."""
        trie, longest, count, shorter, verdicts = self.trie, self.longest, self.count, self.shorter, self.pairs
        out: list[int] = []
        dead: set[int] = set()
        at, stop, proposed = 0, len(spelt), -1
        while at < stop:
            if proposed < 0:
                node = trie
                for c in spelt[at : at + longest]:
                    if (below := node.get(c)) is None:
                        break
                    node = below
                proposed = node[""]
            while proposed >= 0:
                if at + count[proposed] not in dead:
                    if not out:
                        fine = self._alone(proposed)
                    elif (fine := verdicts.get(code := out[-1] << 32 | proposed)) is None:
                        fine = self._together(code)
                    if fine:
                        break
                proposed = shorter[proposed]
            if proposed >= 0:
                out.append(proposed)
                at += count[proposed]
                proposed = -1
                continue
            while proposed < 0:
                if not out:
                    return []
                dead.add(at)
                at -= count[out[-1]]
                proposed = shorter[out.pop()]
        return out

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _alone(self, i: int) -> bool:
        if i not in self.single:
            self.single[i] = self.merge(self._split(self.ids[i])) == [self.ids[i]]
        return self.single[i]

    def _together(self, code: int) -> bool:
        if code not in self.pairs:
            a, b = self.ids[code >> 32], self.ids[code & 0xFFFFFFFF]
            self.pairs[code] = (a, b) not in self.merges and self.merge(self._split(a) + self._split(b)) == [a, b]
        return self.pairs[code]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that aren't known yet."""
        new, ids, sizes, ends = list(words), [], [], []
        shown, table = self.shown.__getitem__, self.table
        for word in new:
            spelt = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            made = self.propose(spelt[:-1] + self._last(spelt[-1] + self.end))
            if not made:
                made = [self.vocab[t] for t in self.merge(self.symbols(word)) if t in self.vocab]
            ids += made
            sizes.append(len(made))
            ends.append("".join(map(shown, made)))
        self._add(new, ids, sizes, ends)

    def _add(self, keys: list[str], ids: list[int] | np.ndarray, sizes: list[int] | np.ndarray, ends: list[str]) -> None:
        base, total = len(self.ends), len(ids)
        if base + len(keys) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros(base + len(keys), np.int64)]) for x in (self.start, self.size))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + total, np.uint32)])
        self.flat[self.used : self.used + total] = ids
        self.size[base : base + len(keys)] = sizes
        self.start[base : base + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.ends += ends
        self.known.update(zip(keys, range(base, base + len(keys)), strict=True))

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of entries, joined."""
        sizes = self.size[rows]
        stops = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[rows] - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]

    def pieces(self, text: str) -> list[str]:
        """What stands between white space; a special token, which is cut out before normalising, has a line end before it."""
        if self.cut is not None and any(s in text for s in self.special):
            return [x for part in self.cut.split(text) for x in (["\n" + part] if part in self.special else self._chunks(part))]
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        text = self.normalise(text)
        # str.split() also splits at four control characters that aren't white space to the pattern.
        return text.split() if not self.odd(text) else [text]

    def _remember(self, chunks: list[str]) -> None:
        """Encodes chunks of text that aren't known yet. No pre-token spans white space, so chunks between it are enough."""
        cut, known, ends = [self.words(c) for c in chunks], self.known, self.ends
        self.learn({w for ws in cut for w in ws if w not in known})
        more = [(c, ws) for c, ws in zip(chunks, cut, strict=True) if c not in known]
        at = [[known[w] for w in ws] for _, ws in more]
        rows = np.array([i for x in at for i in x], np.int64)
        bounds = np.cumsum([0, *map(len, at)])
        sizes = np.diff(np.concatenate([[0], np.cumsum(self.size[rows])])[bounds])
        self._add([c for c, _ in more], self._gather(rows), sizes, ["".join([ends[i] for i in x]) for x in at])

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Token ids of each text, and what decoding them gives."""
        parts = [self.pieces(t) for t in texts]
        if len(self.known) > MEMORY:
            self.reset()
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        known, flat = self.known, list(chain.from_iterable(parts))
        at = list(map(known.get, flat, repeat(-1)))
        rows = np.array(at, np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [flat[i] for i in missing.tolist()]
            self._remember([*set(new)])
            rows[missing] = [known[c] for c in new]
            at = rows.tolist()
        bounds = np.cumsum([0, *map(len, parts)]).tolist()
        return [(self._gather(rows[a:b]), "".join(map(self.ends.__getitem__, at[a:b]))[:-1]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_decode(self, text: str) -> tuple[np.ndarray, str]:
        return self.batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.encode_decode(text)[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Joins the tokens' strings with spaces, as a vocabulary without a decoder does; unknown ids are left out."""
        return " ".join(self.ids[i] for i in ids if i in self.ids)


#: A worker's verdicts on pairs by the vocabulary's digest, as arrays: tasks that follow start with them.
_KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _keep(digest: str, pairs: dict[int, bool]) -> None:
    _KEPT.clear()
    _KEPT[digest] = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), bool, len(pairs))


def _kept(digest: str) -> dict[int, bool]:
    return dict(zip(*(x.tolist() for x in _KEPT[digest]), strict=True)) if digest in _KEPT else {}


def _mapped(docs: DataFrame, schema: str, each, path: str | None) -> DataFrame:
    """mapInArrow over doc_id and text; each(ids, decoded) makes what follows doc_id in a row."""
    loaded = Codec.load(path or default_path())
    digest = hashlib.sha256(json.dumps(loaded).encode()).hexdigest()
    spec, arrow = docs.sparkSession.sparkContext.broadcast(loaded), common.arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        codec = Codec(spec.value)
        codec.pairs = _kept(digest)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    done = [each(*x) for x in codec.batch([(t or b"").decode("utf-8", "replace") for t in common.as_bytes(part.column(1))])]
                    made = [pa.array([r[i] for r in done], f.type) for i, f in enumerate([*arrow][1:])]
                    yield pa.RecordBatch.from_arrays([part.column(0), *made], schema=arrow)
        finally:
            _keep(digest, codec.pairs)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The operator: doc_id, ids (array<int>), decoded."""
    return _mapped(docs, "doc_id long, ids array<int>, decoded string", lambda ids, decoded: (ids.astype(np.int32), decoded), path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As `encoded`, with counts and hashes in place of ids and text: made in the worker, so that they needn't be sent."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (len(ids), sha(ids.astype("<u4").tobytes()), sha(decoded.encode("utf-8", "replace"))), path)
