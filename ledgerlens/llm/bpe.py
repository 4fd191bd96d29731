"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece the encoding's last token is unique.  It is found
by matching all tokens that end there with a suffix automaton (Aho-Corasick
over the vocabulary) and keeping the one that fits the last token of the
prefix before it; that token is stored, and the ids follow by going back from
the end.  Two neighbouring tokens fit if no merge across their border would
have come before the merges that made them.

The vocabulary file belongs to a public tokenizer and is named by a parameter.
The driver reads it once and broadcasts its bytes, whose size is the file's.

Defined cases: a null text is the empty text, with no ids.  Special tokens in a
text become their ids, as the tokenizers library does by default.  Decoding
replaces malformed UTF-8, as that library does; ids beyond the vocabulary raise
an error.
"""

from __future__ import annotations

import hashlib
import json
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACK = struct.Struct("<I").pack
#: A space with another blank beside it.
BLANK_BY_SPACE = regex.compile(r" \s|\s ")

RECENT = 400_000            # entries of each of the two generations of a memory
RECENT_CHARS = 64           # longer keys are not remembered


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary of 50k tokens."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others for code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """A memory of bounded size that forgets what has not been used lately."""

    def __init__(self, size: int = RECENT):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        known = self.young.get(key)
        if known is None and (known := self.old.get(key)) is not None:
            self.put(key, known)
        return known

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= RECENT_CHARS:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


class PrefixBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, remembered: int = RECENT):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda t: bytes(map(letters.__getitem__, t))
        vocab = spec["model"]["vocab"]
        self.token = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.token[i] = as_bytes(t)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        n = len(self.token)
        self.rank = [-1] * n                                  # single bytes come before all merges
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.merged: dict[tuple[int, int], int] = {}          # (left, right) -> rank of the merge
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = r
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (a, b), r
        self.whole = {self.token[i]: i for i in vocab.values()}
        auto = ahocorasick.Automaton()
        for t, i in self.whole.items():
            auto.add_word(t.decode("latin-1"), (i, len(t)))
        auto.make_automaton()
        self.automaton = auto
        self.fit: dict[int, bool] = {}                        # left << 20 | right -> whether they fit
        self.solo: list[bool | None] = [None] * n
        self.word_ids, self.piece_ids = Recent(remembered), Recent(remembered)

    def fits(self, a: int, b: int, joined: bool = False) -> bool:
        """Whether merging the joined bytes of tokens a and b ends in (a, b);
        with ``joined``, whether it comes to (a, b) at all, merged then or not.

        The merges that made both are undone from the last to the first; the
        border must never show a pair that merges before the step undone.
        Among equal ranks the left pair merges first.
        """
        key, ok, bound = a << 20 | b, True, (1 << 60, 0)
        border = None if joined else self.merged.get((a, b))
        while True:
            if border is not None and (border, 1) < bound:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if rb >= ra:                              # the right token was made last
                bound, b = (rb, 2), self.parts[b][0]
            else:
                bound, a = (ra, 0), self.parts[a][1]
            border = self.merged.get((a, b))
        if not joined:
            if len(self.fit) > 1 << 20:
                self.fit.clear()
            self.fit[key] = ok
        return ok

    def encode_piece(self, piece: str) -> bytes:
        """Ids, as bytes, of one piece: the last token of every prefix, then back."""
        raw = piece.encode()
        whole = self.whole.get(raw)
        if whole is not None and self.alone(whole):
            return PACK(whole)
        last, back = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        known, fits, done = self.fit.get, self.fits, -1
        for at, (tid, n) in self.automaton.iter(raw.decode("latin-1")):     # at one end, longest tokens first
            if at != done:
                start = at + 1 - n
                if start:
                    before = last[start]
                    ok = known(before << 20 | tid)
                    if ok is None:
                        ok = fits(before, tid)
                else:
                    ok = self.alone(tid)
                if ok:
                    done = at
                    last[at + 1], back[at + 1] = tid, start
        out, at = [], len(raw)
        while at > 0:
            out.append(last[at])
            at = back[at]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def alone(self, tid: int) -> bool:
        """Whether the token's own bytes encode to the token: its two parts do
        so themselves and stay whole until their own merge joins them."""
        known = self.solo[tid]
        if known is None:
            p = self.parts[tid]
            known = p is None or self.alone(p[0]) and self.alone(p[1]) and self.fits(*p, joined=True)
            self.solo[tid] = known
        return known

    def encode_run(self, text: str) -> bytes:
        """Ids, as bytes, of a text without special tokens."""
        return b"".join([self.piece_ids.get(p) or self.piece_ids.put(p, self.encode_piece(p)) for p in self.pieces.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A piece always begins at a lone space between two other characters, so
        a text without other blanks beside its spaces is encoded space by
        space, and what stands between two spaces is remembered for the next
        time.
        """
        out = []
        for part in self.special_split.split(text or "") if self.special_split else [text or ""]:
            if part in self.special:
                out.append(PACK(self.special[part]))
            elif BLANK_BY_SPACE.search(part) or part[:1] == " " or part[-1:] == " ":
                out.append(self.encode_run(part))
            elif part:
                first, *rest = part.split(" ")
                ids = list(map(self.word_ids.young.get, rest))
                if None in ids:
                    for i, known in enumerate(ids):
                        if known is None:
                            word = rest[i]
                            ids[i] = self.word_ids.get(word) or self.word_ids.put(word, self.encode_run(" " + word))
                out += [self.encode_run(first), *ids]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, PrefixBPE] = {}


def _coder(vocabulary, remembered: int = RECENT) -> PrefixBPE:
    """This Python worker's coder of a broadcast vocabulary."""
    raw = vocabulary.value
    key = f"{hashlib.sha256(raw).hexdigest()} {remembered}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBPE(raw, remembered)
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, out_col: str = "token_ids", text_col: str = "text", vocabulary: str | None = None, remembered: int = RECENT) -> DataFrame:
    """``docs`` and the ids of each whole text, little-endian unsigned 32-bit
    integers in a binary column.  ``remembered``: words whose ids a worker keeps at
    hand; fewer take less memory and more time, and change no id."""
    shared = _vocabulary(docs, vocabulary)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        coder = _coder(shared, remembered)
        return pa.array([coder.encode(t.as_py()) for t in texts], pa.binary())

    safe, (text,) = aside(docs, text_col)
    return safe.withColumn("_ids", ids(F.col(text))).toDF(*docs.columns, out_col)


def decode(docs: DataFrame, out_col: str = "decoded", ids_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` and the text of each row's ids."""
    shared = _vocabulary(docs, vocabulary)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        coder = _coder(shared)
        return pa.array([coder.decode(b.as_py() or b"") for b in ids], pa.string())

    safe, (ids,) = aside(docs, ids_col)
    return safe.withColumn("_text", text(F.col(ids))).toDF(*docs.columns, out_col)
