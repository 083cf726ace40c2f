"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Encoding is exact and does no merging over the text. A token sequence is what merging gives if
and only if every adjacent pair of tokens comes out of merging its own text again. So:

1. an Aho-Corasick automaton over the pieces finds, at each position, the longest piece;
2. the longest piece is taken if it is compatible with the token before it (their joint text is
   re-merged once and the answer kept); otherwise its longest proper prefix piece is tried;
3. where no prefix fits, the token before is taken back and the position is marked in a bitfield
   as one that no encoding of the rest can start from.

Merges never cross from another character into the word mark (checked when a model is loaded),
nor a character that is no piece, so texts split there and encoded parts are kept in a bounded
table. Decoding joins pieces, turns word marks into spaces but for the leading one, and reads
runs of byte tokens as UTF-8 with a replacement character for each byte that does not fit.

Defined cases: a null or empty text is encoded as begin and end only and decodes to ''; spaces,
control characters and unknown characters round-trip; columns of the input named like a result
column are replaced; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.staging import extend, pieces, trim

MARK = "▁"
#: parts longer than this are encoded but not kept, and so many parts are kept during a task
PART_CHARS, PARTS_KEPT, PAIRS_KEPT = 48, 300_000, 300_000
NORMAL, BYTE = 1, 6
RESULT = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


class _Parts(dict):
    """Text part without its word mark -> its ids, packed; filled on demand and emptied when full."""

    def __init__(self, codec: Codec, mark: str):
        self.codec, self.mark = codec, mark

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.codec.encode_part(self.mark + part)).tobytes()
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS_KEPT:
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """One model. Raises ValueError for a model whose rules differ from those named above."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds - {1, 2, 3, 6}:
            raise ValueError("a byte-fallback BPE model with identity normalisation and a dummy prefix is needed")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.merged = {p: model.pieces[i].score for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the word mark inside")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bos, self.eos = ([i for i, p in enumerate(self.pieces) if p == s][0] for s in (train.bos_piece, train.eos_piece))
        self.known = {p for p in self.ids if len(p) == 1}
        self.unknown = re.compile("([^" + "".join(map(re.escape, sorted(self.known))) + "]+)")
        # what decoding writes for an id: bytes of 7 bits as they are, control tokens nothing
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == 2:
                self.surface[i] = train.unk_surface
            elif p.type == 3:
                self.surface[i] = ""
        self.silent = {i for i, s in enumerate(self.surface) if not s}
        self.high = np.zeros(len(self.pieces), bool)
        self.raw: dict[int, int] = {}
        for b, i in self.byte_ids.items():
            self.raw[i], self.surface[i], self.high[i] = b, chr(b), b >= 128
        self.pairs: dict[int, bool] = {}
        self.size = len(self.pieces)
        # pieces that merging cannot reach are never tokens, so the automaton leaves them out
        self.automaton = ahocorasick.Automaton()
        #: by id: the longest piece that begins a piece, -1 if there is none, and its length in characters
        self.shorter, self.length = [-1] * self.size, [len(p) for p in self.pieces]
        reached = {p for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [i]}
        self.reached = {self.ids[p] for p in reached}
        for p in reached:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        for p in reached:
            self.shorter[self.ids[p]] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1)
        self.normal = set(self.ids.values())
        self.word, self.bare = _Parts(self, MARK), _Parts(self, "")

    def merge(self, text: str) -> list[int]:
        """Merging itself, best score and then leftmost first; only for pairs and pieces, which are
        short: the scores of neighbours are held in a list."""
        parts, get, none = list(text), self.merged.get, -math.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return [self.ids[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces gives the two again; the answer is kept."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        out = self.pairs[a * self.size + b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return out

    def backtrack(self, text: str) -> list[int]:
        """The encoding of a text all of whose characters are pieces."""
        whole = self.ids.get(text)
        if whole is not None and whole in self.reached:
            return [whole]
        n = len(text)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end - size + 1] = i  # ends ascend, so the last one that starts there is the longest
        known, length, shorter, base = self.pairs.get, self.length, self.shorter, self.size
        failed: bytearray | None = None  # a bit for each position that no encoding of the rest can start from
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = known(last * base + token)
                    if fits or fits is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else 0
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode_part(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.unknown.split(text)):
            if k % 2:
                out += [self.byte_ids[b] for b in part.encode()]
            elif part:
                out += self.backtrack(part)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        if not text:
            return np.array([self.bos, self.eos], "<u4").tobytes()
        parts = text.replace(MARK, " ").split(" ")
        if "" in parts:  # each further space is one more mark before the word
            joined, extra = [], ""
            for p in parts[:-1]:
                if p:
                    joined.append(extra + p)
                    extra = ""
                else:
                    extra += MARK
            parts = [*joined, extra + parts[-1]]
        return b"".join([np.uint32(self.bos).tobytes(), *map(self.word.__getitem__, parts), np.uint32(self.eos).tobytes()])

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        if not self.high[ids].any():
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.raw:
                    run.append(self.raw[i])
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(self.surface[i])
            text = "".join(out) + _utf8(run)
        # only a word mark gives way at the start, not the space of an unknown token or a byte
        first = next((i for i in ids.tolist() if i not in self.silent), self.bos)
        return text[1:] if first in self.normal and text[:1] == " " else text


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is no part of a valid sequence becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + n]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """``df`` (its columns ``keep``; all without it) with token counts and digests of ids and of
    the decoded text; with ``ids`` also ``ids`` and ``decoded``. ``model`` is a path on executors."""
    made = RESULT | ({"ids": "array<int>", "decoded": "string"} if ids else {})
    keep = [c for c in keep or df.columns if c not in made]
    schema = extend(df.select(*keep).schema, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in pieces(batches):
            n, packs, texts, decs = [], [], [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                packed = c.encode(t.as_py() or "")
                plain = c.decode(packed)
                n.append(len(packed) // 4)
                packs.append(hashlib.sha256(packed).hexdigest())
                decs.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    texts.append((np.frombuffer(packed, "<u4").astype("i4"), plain))
            new = [pa.array(n, pa.int64()), pa.array(packs, pa.string()), pa.array(decs, pa.string())]
            if ids:
                new += [pa.array([a for a, _ in texts], pa.list_(pa.int32())), pa.array([b for _, b in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *new], names=schema.names)
        # the worker may go on with other work: it keeps the model and the pairs, not the parts
        c.word.clear()
        c.bare.clear()
        trim()

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
