"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass (operator 8).

The automaton over all pieces reads a text once; at each position its output links name the pieces
that end there, each of which may relax the best path to that position. A path's worth depends on
the model's kind. In a unigram model it is the sum of the pieces' scores. In a BPE model a piece may
only follow another if merging the two pieces' characters gives just these two back; exactly one
path to each position obeys that, and it is what merging the whole text gives, so the same single
pass finds the library's encoding. Characters that no piece covers become byte pieces, or the
unknown piece.

White space opens a piece and never follows other characters in one (checked on loading), so a text
falls into units that are encoded by themselves; a worker keeps the ids of recent units. Null text is
empty: no ids, decoded to the empty text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import read
from quillspark.llm.tokens import _Cache, _packed, tokenizer_path

SPACE = "▁"
UNIGRAM = 1
#: What an unknown character costs below the least score, as in the library's unigram models.
UNKNOWN_PENALTY = 10.0


def _message(data: bytes):
    """(field, value) pairs of a protocol buffer: numbers for varints, bytes for the rest."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[i : i + n]
        i += n


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        spec = {k: dict(_message(v)) for k, v in _message(sp.serialized_model_proto()) if k in (2, 3)}
        self.unigram = spec.get(2, {}).get(3, UNIGRAM) == UNIGRAM
        rules = spec.get(3, {})
        self.prefix = bool(rules.get(3, 1))
        self.plain = not rules.get(2) and not rules.get(4, 1)  # no character map, white space kept as it is
        self.pieces = sp.id_to_piece(list(range(n)))
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.floor = min(self.score.values()) - UNKNOWN_PENALTY
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.unigram or self._merge(p) == [p]:  # other pieces are never the result of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shown = [
            "" if i in special and i != self.unknown and i not in self.byte_of else " ⁇ " if i == self.unknown else p.replace(SPACE, " ")
            for i, p in enumerate(self.pieces)
        ]
        self.splits = _Cache(self._split)
        self.units = _Cache(self._unit)

    def _merge(self, text: str) -> list[str]:
        """The pieces that merging the characters of a short text gives: best score first, then leftmost."""
        parts, score = list(text), self.score
        gains = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, s in enumerate(gains):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(gains):
                gains[at] = score.get(parts[at] + parts[at + 1])

    def _split(self, pair: str) -> int:
        """Length of the first piece if merging ``pair`` gives exactly two, else -1."""
        parts = self._merge(pair)
        return len(parts[0]) if len(parts) == 2 else -1

    def segment(self, text: str) -> list[tuple[str, bool]]:
        """The best path's pieces of a normalised text, each with whether it is a known piece."""
        last = self._best_scores(text) if self.unigram else self._only_merges(text)
        out, i = [], len(text)
        while i:
            piece = last[i]
            out.append((piece, True) if piece else (text[i - 1], False))
            i -= len(piece) or 1
        return out[::-1]

    def _best_scores(self, text: str) -> list[str]:
        """For each position the last piece of the best path to it; "" is an unknown character."""
        n, worth, last = len(text), [0.0], [""]
        worth += [-float("inf")] * n
        last += [""] * n
        score, ids, done = self.score, self.ids, 0

        def pass_to(end):
            for i in range(done + 1, end + 1):
                if text[i - 1] not in ids and worth[i - 1] + self.floor > worth[i]:
                    worth[i], last[i] = worth[i - 1] + self.floor, ""

        for end, piece in self.automaton.iter(text):
            if end > done:
                pass_to(end)
                done = end
            w = worth[end + 1 - len(piece)] + score[piece]
            if w > worth[end + 1]:
                worth[end + 1], last[end + 1] = w, piece
        pass_to(n)
        return last

    def _only_merges(self, text: str) -> list[str]:
        """The same for a BPE model: the one piece that may follow the path before it."""
        last = [""] * (len(text) + 1)
        splits = self.splits
        for end, piece in self.automaton.iter(text):
            if not last[end + 1]:
                before = last[end + 1 - len(piece)]
                if not before or splits[before + piece] == len(before):
                    last[end + 1] = piece
        return last

    def _unit(self, unit: str) -> bytes:
        out: list[int] = []
        joined = False
        for piece, known in self.segment(unit):
            if known:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8")]
            elif not joined:  # neighbouring unknown characters are one unknown piece
                out.append(self.unknown)
            joined = not known
        return _packed(out)

    def normalise(self, text: str) -> str:
        """The text as the model reads it, white space shown as the mark of pieces."""
        if not self.plain:
            return self.library.normalize(text).replace(" ", SPACE)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        shown = self.normalise(text)
        if not self.apart:
            return self._unit(shown)
        units = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", shown)
        return b"".join(map(self.units.__getitem__, units))

    def decode(self, ids) -> str:
        """The text of a list of ids: byte pieces in a row are read as UTF-8, bad ones replaced."""
        shown, byte_of = self.shown, self.byte_of
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(shown[i])
        parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each model file and Python worker."""
    return Codec(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, n_fallback, ids_crc32, round_trip) for ``docs`` (doc_id, text).

    ``n_fallback`` counts byte and unknown pieces; ``round_trip`` tells whether decoding the ids gives
    the text as the model reads it.
    """

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(model)
        odd = np.zeros(len(c.pieces), dtype=bool)
        odd[[*c.byte_of, c.unknown]] = True
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("ids", "n_pieces", "n_fallback", "ids_crc32", "round_trip")}
            for value in batch.column("text"):
                text = value.as_py() or ""
                raw = c.encode(text)
                ids = np.frombuffer(raw, dtype="<i4")
                read_as = text if c.plain else c.normalise(text).replace(SPACE, " ")
                out["ids"].append(ids)
                out["n_pieces"].append(len(ids))
                out["n_fallback"].append(int(odd[ids].sum()))
                out["ids_crc32"].append(zlib.crc32(raw))
                out["round_trip"].append(c.decode(ids.tolist()) == (read_as[1:] if not c.plain and c.prefix and read_as[:1] == " " else read_as))
            kinds = (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out]
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>, n_pieces long, n_fallback long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for ``encoded`` (doc_id, ids); null ids give the empty text."""

    def rows(batches):
        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(rows, f"doc_id {kind}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 32k piece model."""
    return encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")
