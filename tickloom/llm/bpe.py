"""BPE encoding and decoding by tree concatenation.

A byte-level BPE encodes each pre-token (a word with the blank before it, a number, a run of signs or blanks) by itself. Texts are cut
into pre-tokens by the tokenizer's fixed pattern; the library encodes each different pre-token once, and its ids are kept for the next
time. A text above `leaf` characters is cut into halves again and again, the pieces are encoded one after the other (other texts are in
other tasks meanwhile), and neighbours are joined bottom-up: a window of a few tokens on each side of the cut is encoded anew and grown until it agrees with both sides, so the ids are
those of the whole text.

When a window agrees. Pre-tokens are cut off from left to right, and what follows a cut does not depend on what stood before it; so if
the window starts where a pre-token of the left side starts, out of reach of the cut, and it and the right side both start a pre-token
at the same place, all that follows is the right side's own encoding. Inside one very long pre-token there is no such place. There the
merges decide, and a sequence of tokens is the encoding of its text if every two neighbours are the encoding of theirs; so it is
enough that the window's outermost tokens are the ones that the two sides have there.

Decoding lays the tokens' bytes end to end; bytes that are no UTF-8 become U+FFFD. What the pattern takes for a letter, number or blank
is asked of the library, in blocks of 256 characters as they turn up. Tokenizers that are no byte-level BPE with this pattern encode and decode every text
whole, by the library.

Nulls are taken as empty texts; an empty text has no tokens. Repeated rows are encoded each for itself, and an empty table gives an
empty result; nothing depends on the order of rows, so there are no ties. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import slices

_loaded: dict[str | None, object] = {}
FIRST_WINDOW = 8
#: Bytes after a place that the pattern may look at before it decides to cut there.
LOOKAHEAD = 8
#: Pre-tokens up to this many characters are kept, at most so many of them.
KEPT_CHARS, KEPT = 48, 400_000


def tokenizer(path: str | None):
    """The tokenizer of a tokenizers-library file; by default the public byte-level BPE of 50k tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, the others for 256 and onward in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranges(codes: list[int]) -> str:
    """Code points as ranges of a character class."""
    codes = sorted(codes)
    cuts = [k for k in range(len(codes)) if not k or codes[k] != codes[k - 1] + 1] + [len(codes)]
    return "".join(f"{re.escape(chr(codes[a]))}-{re.escape(chr(codes[b - 1]))}" for a, b in zip(cuts, cuts[1:], strict=False))


class Encoder:
    """A byte-level BPE with a store of the ids of pre-tokens met before."""

    def __init__(self, tok):
        self.tok = tok
        self.marks = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        letters = _alphabet()
        of = {i: bytes(letters[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items()} | {i: m.encode() for m, i in self.marks.items()}
        self.bytes_of = [of.get(i, b"") for i in range(max(of) + 1)]
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.store: dict[str, bytes] = {}
        self.known: set[int] = set()  # blocks of 256 code points
        self.classes: list[list[int]] = [[], [], []]  # letters, numbers, blanks
        self._learn({0})

    @staticmethod
    def fits(tok) -> bool:
        """Whether the tokenizer is a byte-level BPE with the fixed pattern and nothing around it."""
        spec = json.loads(tok.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and (spec["decoder"] or {}).get("type") == "ByteLevel"
        bare = not spec["normalizer"] and not spec["post_processor"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return plain and bare and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))

    def _learn(self, blocks: set[int]) -> None:
        """Ask the library which characters of some blocks are letters, numbers or blanks: they join an 'a', a '1', or neither these nor a '!'."""
        self.known |= blocks
        joins = lambda lead, c: len(self.tok.pre_tokenizer.pre_tokenize_str(lead + c)) == 1
        for k in sorted(k for b in blocks for k in range(b << 8, b + 1 << 8) if not 0xD800 <= k < 0xE000):
            c = chr(k)
            kind = 0 if joins("a", c) else 1 if joins("1", c) else None if joins("!", c) else 2
            if kind is not None:
                self.classes[kind].append(k)
        a, n, s = map(_ranges, self.classes)
        # fixed pattern of byte-level tokenizers
        self.pattern = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+")

    def words(self, text: str) -> list[str]:
        if not text.isascii() and (new := {ord(c) >> 8 for c in set(text)} - self.known):
            self._learn(new)
        return self.pattern.findall(text)

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        try:
            return list(map(self.store.__getitem__, words))
        except KeyError:
            pass
        if len(self.store) > KEPT:
            self.store.clear()
        new = list(set(words).difference(self.store))
        found = {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        out = [found[w] if w in found else self.store[w] for w in words]
        self.store.update((w, i) for w, i in found.items() if len(w) <= KEPT_CHARS)
        return out

    def encode(self, text: str, leaf: int) -> bytes:
        """The ids of a text; special tokens in it split it first, as they do in the library."""
        out, at = [], 0
        while at < len(text):
            found = min(((p, -len(m), m) for m in self.marks if (p := text.find(m, at)) >= 0), default=(len(text), 0, None))
            if found[0] > at:
                part = text[at : found[0]]
                out += self.ids(self.words(part)) if len(part) <= leaf else [_tree(self, part, leaf).ids.tobytes()]
            if found[2] is None:
                break
            out.append(self.marks[found[2]].to_bytes(4, "little"))
            at = found[0] + len(found[2])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Piece:
    """Tokens of data[start:end]: ids, and for each the bytes it covers and whether a pre-token starts with it."""

    def __init__(self, enc: Encoder, data: bytes, start: int, end: int):
        self.start, self.end = start, end
        each = enc.ids(enc.words(data[start:end].decode()))
        self.ids = np.frombuffer(b"".join(each), "<u4")
        self.pre = np.zeros(len(self.ids), bool)
        self.pre[np.cumsum([0, *map(len, each)])[:-1] // 4] = True
        self.b = start + np.cumsum(enc.size[self.ids])
        self.a = self.b - enc.size[self.ids]

    def cut(self, lo: int, hi: int) -> tuple:
        return self.ids[lo:hi], self.a[lo:hi], self.b[lo:hi], self.pre[lo:hi]


def _joined(left: Piece, upto: int, window: Piece, w1: int, right: Piece, onward: int) -> Piece:
    out = Piece.__new__(Piece)
    out.start, out.end = left.start, right.end
    parts = [left.cut(0, upto), window.cut(0, w1), right.cut(onward, len(right.ids))]
    out.ids, out.a, out.b, out.pre = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return out


def _within(data: bytes, at: int) -> bool:
    """Whether a place is inside a character."""
    return at < len(data) and data[at] & 0xC0 == 0x80


def join(enc: Encoder, data: bytes, left: Piece, right: Piece) -> Piece:
    """The encoding of two neighbouring pieces as one."""
    width = FIRST_WINDOW
    while True:
        lo = max(0, min(len(left.ids) - width, int(np.searchsorted(left.a, left.end - LOOKAHEAD, "right")) - 1))
        near = np.flatnonzero(left.pre[lo:] & (left.a[lo:] + LOOKAHEAD <= left.end))
        if lo and len(near):
            lo += int(near[0])
        while lo and not left.pre[lo] and (_within(data, left.a[lo]) or data[left.a[lo]] == 0x27):
            lo -= 1
        hi = min(len(right.ids), width)
        while hi < len(right.ids) and _within(data, right.a[hi]):
            hi += 1
        a = int(left.a[lo]) if lo else left.start
        b = int(right.a[hi]) if hi < len(right.ids) else right.end
        window = Piece(enc, data, a, b)
        if not lo or left.pre[lo] or len(window.ids) and window.ids[0] == left.ids[lo]:
            if hi == len(right.ids):
                return _joined(left, lo, window, len(window.ids), right, hi)
            both = np.intersect1d(window.a[window.pre], right.a[:hi][right.pre[:hi]])
            both = both[(both >= right.start) & (both + LOOKAHEAD <= b) & (both > a)]
            if len(both):
                c = int(both[0])
                w, r = (int(np.flatnonzero(p.pre & (p.a == c))[0]) for p in (window, right))
                return _joined(left, lo, window, w, right, r)
            # one pre-token from before the cut to past the window: its last token must be the right side's own
            inner = not right.pre[1 : hi + 1].any() and not window.pre[window.a > right.start].any() and hi > 1 and len(window.ids) > 1
            if inner and window.ids[-1] == right.ids[hi - 1] and right.start <= window.a[-1] == right.a[hi - 1]:
                return _joined(left, lo, window, len(window.ids), right, hi)
        width *= 2


def _tree(enc: Encoder, text: str, leaf: int) -> Piece:
    data, leaf = text.encode(), max(leaf, 8)  # so that each half has a character
    cuts = [0, len(data)]
    while max(np.diff(cuts)) > leaf:
        cuts = sorted({*cuts, *(_start(data, (a + b) // 2) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > leaf)})
    pieces = [Piece(enc, data, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    while len(pieces) > 1:
        pairs = [join(enc, data, pieces[k], pieces[k + 1]) for k in range(0, len(pieces) - 1, 2)]
        pieces = pairs + pieces[2 * len(pairs) :]
    return pieces[0]


def _start(data: bytes, at: int) -> int:
    """The start of the character at a place."""
    while _within(data, at):
        at -= 1
    return at


class Library:
    """Any other tokenizer: texts go to the library whole."""

    def __init__(self, tok):
        self.tok = tok

    def encode(self, text: str, leaf: int) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


def encoder(path: str | None = None) -> Encoder | Library:
    """The encoder of a tokenizers-library file, made once a process."""
    if path not in _loaded:
        tok = tokenizer(path)
        _loaded[path] = Encoder(tok) if Encoder.fits(tok) else Library(tok)
    return _loaded[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = 16384, result: str = "tokens") -> DataFrame:
    """Encode and decode every whole text.

    result "tokens": id, n_tokens, ids (array of int), decoded (string). result "digests": id, n_tokens, ids_sha256, decoded_sha256,
    made from the same ids and decoded text inside the task, so that they need not travel.
    path: a tokenizers-library file that every executor can open; leaf: characters above which a text is cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, " + ("ids array<int>, decoded string" if result == "tokens" else "ids_sha256 string, decoded_sha256 string")

    def work(batches):
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = [enc.encode(t or "", leaf) for t in batch.column(1).to_pylist()]
                back = [enc.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                if result == "tokens":
                    more = [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                else:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *more], names=[id_col, "n_tokens", *(("ids", "decoded") if result == "tokens" else ("ids_sha256", "decoded_sha256"))])

    return docs.select(id_col, text_col).mapInArrow(work, schema)
