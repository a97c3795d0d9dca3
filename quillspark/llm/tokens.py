"""Token ids of whole texts by a public tokenizer file, with a per-worker cache of words.

A text is cut at ASCII white space only where the tokenizer's own splitting always cuts, so the ids
of the chunks, joined, are the ids of the text; the tests hold this against the library on whole
texts. Chunks that the quick split does not cover, and texts with rarer white space, go through the
library's ``encode``. Ids are kept as little-endian 32-bit bytes, so that a text's ids are one join.

The texts of an Arrow batch are cut at spaces together: Arrow numbers their distinct words, each of
those is looked up or encoded once, and the numbers put the texts' ids together.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Most entries of each of a worker's caches, so that memory stays bounded.
CACHE_ENTRIES = 800_000
#: Longer chunks are encoded each time and not kept.
CACHE_CHARS = 40
#: Bytes of the texts whose words are numbered together; a longer text is encoded by itself.
GROUP_BYTES = 8_000_000

#: Marks that end simple chunks; the tokenizers' splitting keeps a run of them in one piece.
_MARKS = ".,;:!?%&#*$|()\"-"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACED = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_RARE_SPACE = re.compile(r"[^\S \t\n\r]|[\x1c-\x1f\x85]")
#: The same for RE2, and spaces that no word follows: such texts are encoded one by one.
_UNLIKE = "[{}]|  | $".format("".join(rf"\x{{{i:x}}}" for i in range(0x3001) if re.match(_RARE_SPACE, chr(i))))
_CONTROL = re.compile(r"[\x1c-\x1f]")
_UNSPACED = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others move past 255."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(moved)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _strings(found) -> list[str]:
    """An Arrow array's strings."""
    return found.to_numpy(zero_copy_only=False).tolist()


class _Cache(dict):
    """A dictionary that fills itself by ``make`` and keeps the entries of at least its last half capacity."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.before, self.most = make, {}, entries // 2

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARS:
                return value
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Encodes texts as the library's ``encode(text, add_special_tokens=False)`` does.

    A text that holds an added token of the file (such as an end mark) goes to the library whole, so
    it gets that token's id as there. A null text is an empty one.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.unlike = "|".join([f"(?i:{'|'.join(map(re.escape, added))})"] * bool(added) + ([] if self.lower else [_UNLIKE])) or r"[^\s\S]"
        self.table = _byte_letters()
        self.chunks = _Cache(self._chunk, entries)
        self.spaced = _Cache(self._spaced, entries)
        self.pieces = _Cache(self._piece, entries)
        self.after_space = _Cache(lambda letters: self._piece(" " + letters), entries)

    def forget(self) -> None:
        """Empties the caches and gives Arrow's free memory back."""
        import pyarrow as pa

        for cache in (self.chunks, self.spaced, self.pieces, self.after_space):
            cache.clear()
            cache.before = {}
        pa.default_memory_pool().release_unused()

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece > "\x20":
            shown = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return _packed([t.id for t in self.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk: an optional space, Latin letters and marks, or else by the library."""
        if len(chunk) > 1 and chunk[0] in "\n\t\r" and chunk[1] not in " \n\t\r":
            # a single one before a word is a piece
            return self.pieces[chunk[0]] + self.chunks[chunk[1:]]
        core = chunk.rstrip(_MARKS)
        marks = chunk[len(core) :]
        letters = core[1:] if core[:1] == " " else core
        if letters:
            if not letters.isalpha() or not (letters.isascii() or _LATIN.fullmatch(letters)):
                return self._whole(chunk)
            ids = self.pieces[letters.lower() if self.lower else core]
            return ids + self.pieces[marks] if marks else ids
        # marks alone, with the space before them, are one piece
        return self.pieces[chunk] if marks else self._whole(chunk)

    def _spaced(self, rest: str) -> bytes:
        """Ids of a space and what follows it up to the next space."""
        if "\n" not in rest and "\t" not in rest and "\r" not in rest:
            return self._chunk(" " + rest)
        return b"".join(map(self.chunks.__getitem__, _SPACED.findall(" " + rest)))

    def _parts(self, text: str) -> bytes:
        """Ids of any part of a text between spaces, of a vocabulary without leading spaces."""
        return b"".join(map(self.chunks.__getitem__, _UNSPACED.findall(text) if _CONTROL.search(text) else text.split()))

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added and self.added.search(text):
            return self._whole(text)
        if self.lower:
            return self._parts(text)
        if _RARE_SPACE.search(text):
            return self._whole(text)
        if "  " not in text and text[-1] != " ":
            first, *rest = text.split(" ")
            head = b"".join(map(self.chunks.__getitem__, _SPACED.findall(first)))
            return head + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.chunks.__getitem__, _SPACED.findall(text)))

    def _words(self, words):
        """Ids of an Arrow array of distinct words: what stands between two spaces of a text, the first of them included."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def looked_up(found, cache):
            """The cache's ids of each element; equal ones are asked for once."""
            numbered = found.dictionary_encode()
            ids = list(map(cache.__getitem__, _strings(numbered.dictionary)))
            return pa.array(ids, pa.large_binary()).take(numbered.indices)

        cores = pc.utf8_rtrim(words, characters=_MARKS)
        quick = pc.match_substring_regex(cores, rf"\A{_LATIN.pattern}\z")
        rare = pa.array(map(self._parts if self.lower else self._spaced, _strings(words.filter(pc.invert(quick)))), pa.large_binary())
        words, cores = words.filter(quick), cores.filter(quick)
        ids = looked_up(pc.utf8_lower(cores), self.pieces) if self.lower else looked_up(cores, self.after_space)
        marked = pc.greater(pc.binary_length(words), pc.binary_length(cores))
        marks = pc.replace_substring_regex(words.filter(marked), rf"\A(?s:.*)[^{re.escape(_MARKS)}]", "")
        both = pc.binary_join_element_wise(ids.filter(marked), looked_up(marks, self.pieces), pa.scalar(b"", pa.large_binary()))
        ids = pc.replace_with_mask(ids, marked, both)
        order = np.empty(len(quick), dtype=np.int64)
        is_quick = quick.to_numpy(zero_copy_only=False)
        order[is_quick], order[~is_quick] = np.arange(len(ids)), np.arange(len(ids), len(quick))
        return pa.concat_arrays([ids, rare]).take(pa.array(order))

    def encode_all(self, texts, group_bytes: int | None = None) -> Iterator[bytes]:
        """``encode`` of each text of an Arrow array of strings, in order; words are numbered in so many bytes of texts."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        most = group_bytes or GROUP_BYTES
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(texts, self.unlike).to_numpy(zero_copy_only=False) | (sizes > most)
        ends = np.cumsum(np.where(alone, 0, sizes))
        at = 0
        while at < len(texts):
            start = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield from self._group(texts.slice(at, end - at), alone[at:end])
            at = end

    def _group(self, texts, alone) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        edges = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        found = self._words(numbered.dictionary)
        numbers = numbered.indices.to_numpy().copy()
        if not self.lower:  # no space comes before a text's first word
            first = edges[:-1] - edges[0]
            heads = _strings(lists.flatten().take(pa.array(first)))
            numbers[first] = np.arange(len(found), len(found) + len(first))
            heads = [b"".join(map(self.chunks.__getitem__, _SPACED.findall(h))) for h in heads]
            found = pa.concat_arrays([found, pa.array(heads, pa.large_binary())])
        ids = found.take(pa.array(numbers))
        places = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)[edges - edges[0]].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [
            self.encode(texts[i].as_py()) if by_itself else bytes(data[places[i] : places[i + 1]])
            for i, by_itself in enumerate(alone.tolist())
        ]


@lru_cache(maxsize=4)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> TextEncoder:
    """One encoder for each tokenizer file and Python worker; its caches last from task to task."""
    return TextEncoder(path, entries)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
