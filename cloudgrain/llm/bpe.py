"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash over the bytes cuts each text into chunks whose borders depend on
the text around them only, so passages shared by documents fall into the same
chunks whatever stands before them. A chunk is encoded once per worker and then
taken from its store. A border may fall inside a word: each join is repaired by
encoding the text around it anew, in a region that grows word by word until its
tokens agree with those of the neighbouring words encoded by themselves.

Inside a chunk, words are looked up in a second store of the same kind. Both
stores are emptied when they reach their bound in bytes, so a worker's memory
does not depend on how much it has read. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunking import cut_points
from .text import blocks, documents, read, record

VOCABULARY = "word_bpe_49k.json"
MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 256, 1024, 8192
CHUNK_STORE_BYTES, WORD_STORE_BYTES = 64 << 20, 192 << 20
_ENTRY = 250  # bytes that one stored entry costs beside its text, about

#: Number of tokens, ids in decimal and decoded text (both joined by one space), ids packed in 32 bits.
Piece = tuple[int, bytes, bytes, bytes]
_NOTHING: Piece = (0, b"", b"", b"")


class ChunkCoder:
    """Encoder of one worker; texts are UTF-8 bytes."""

    def __init__(self, vocabulary_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("this coder joins decoded tokens by a space, as tokenizers without a decoder do")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ids = [b"%d" % i for i in range(size)]
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.words: dict[bytes, Piece] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, Piece]] = {}
        self.word_bytes = self.chunk_bytes = 0

    def encode(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _learn(self, missing: list[bytes]) -> None:
        """Encode words that are not stored yet, in one call."""
        coded = self.tokenizer.encode_batch([m.decode() for m in missing], add_special_tokens=False)
        ids, tokens, words = self.ids, self.tokens, self.words
        for word, c in zip(missing, coded):
            words[word] = p = (len(c.ids), b" ".join([ids[i] for i in c.ids]), b" ".join([tokens[i] for i in c.ids]), np.array(c.ids, np.int32).tobytes())
            self.word_bytes += len(word) + len(p[1]) + len(p[2]) + len(p[3]) + _ENTRY

    def of_words(self, words: list[bytes]) -> Piece:
        """Tokens of words joined by white space."""
        if self.word_bytes > WORD_STORE_BYTES:
            self.words.clear()
            self.word_bytes = 0
        found = list(map(self.words.get, words))
        if None in found:
            self._learn(list({w for w, p in zip(words, found) if p is None}))
            found = list(map(self.words.__getitem__, words))
        return joined(found)

    def chunk(self, text: bytes) -> tuple[bytes, bytes, Piece]:
        """(frayed head, frayed tail, tokens of the whole words between) of a chunk, encoded once."""
        known = self.chunks.get(text)
        if known is None:
            if self.chunk_bytes > CHUNK_STORE_BYTES:
                self.chunks.clear()
                self.chunk_bytes = 0
            words = text.split()
            head = b"" if text[:1].isspace() or not words else words.pop(0)
            tail = b"" if text[-1:].isspace() or not words else words.pop()
            if head and not words and not tail and not text[-1:].isspace():
                known = (head, None, _NOTHING)  # one word without a border inside
            else:
                known = (head, tail, self.of_words(words))
            self.chunks[text] = known
            self.chunk_bytes += 2 * len(text) + sum(map(len, known[2][1:])) + _ENTRY
        return known

    def repair(self, before: bytes, region: bytes, after: bytes) -> Piece:
        """Tokens of the words of ``region``, a join, agreed with the words around it.

        ``before`` and ``after`` are the texts next to it (beginning or ending at white space).
        The region's tokens agree when encoding it together with one word on either side
        gives the tokens of that word, of the region and of that word again.
        """
        left, right = before.split(), after.split()
        n = 1
        while True:
            near_left, near_right = left[len(left) - n:] if n <= len(left) else left, right[:n]
            whole = self.encode(b" ".join([*near_left, region, *near_right]))
            parts = [i for w in (*near_left, region, *near_right) for i in self.encode(w)]
            if whole == parts:
                return self.of_words([region])
            if n > max(len(left), len(right)):
                raise ValueError("tokens of neighbouring words never agree; this vocabulary joins tokens over white space")
            n += 1

    def text(self, raw: bytes, cuts: np.ndarray) -> Piece:
        """Tokens of a text cut at ``cuts`` (ends of chunks, the last is its length)."""
        pieces, open_word, last, lo = [], b"", b"", 0
        for hi in cuts.tolist():
            part = raw[lo:hi]
            head, tail, inner = self.chunk(part)
            if tail is None:  # no white space in this chunk: the word goes on
                open_word += head
            else:
                if open_word or head:
                    region = open_word + head
                    if lo:
                        key = (last, region)
                        pieces.append(self._agreed(key, part[len(head):len(head) + 64]))
                    else:
                        pieces.append(self.of_words([region]))
                pieces.append(inner)
                open_word = tail
            last = part[-64:]
            lo = hi
        if open_word:
            pieces.append(self.of_words([open_word]))
        return joined(pieces)

    def _agreed(self, key: tuple[bytes, bytes], after: bytes) -> Piece:
        last, region = key
        # Whole words only: the word that the window cuts is left out.
        before = last[:last.rfind(b" ") + 1] if b" " in last else b""
        before = before[before.find(b" ") + 1:]
        after = after[:after.rfind(b" ") + 1] if b" " in after else b""
        return self.repair(before, region, after)


def joined(pieces: list[Piece]) -> Piece:
    some = [p for p in pieces if p[0]]
    return sum([p[0] for p in some]), b" ".join([p[1] for p in some]), b" ".join([p[2] for p in some]), b"".join([p[3] for p in some])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """The coder of this Python worker."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


_CODED = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()),
    ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])
_DDL = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids", "decoded"), path: str | None = None, sizes: tuple[int, int, int] = (MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK)) -> DataFrame:
    """Per row of ``docs`` the chosen ``columns``: doc_id, n_tokens, ids, decoded, ids_sha256 (of the
    decimal ids joined by a space), decoded_sha256.

    ``path`` names a tokenizers file without a decoder and without tokens over white
    space; the default is the public word vocabulary. Null and empty texts have no
    tokens. Rows may repeat; extra columns are ignored.
    """
    schema = pa.schema([_CODED.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or vocabulary_path())
        for part, texts in blocks(batches):
            done = [own.text(t, c) for t, c in zip(texts, cut_points(texts, *sizes, whole_characters=True))]
            made = {"doc_id": part.column("doc_id"), "n_tokens": [p[0] for p in done]}
            if "ids" in columns:
                ends = np.cumsum([0, *made["n_tokens"]]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join([p[3] for p in done]), np.int32))
            if "decoded" in columns:
                made["decoded"] = [p[2].decode() for p in done]
            if "ids_sha256" in columns:
                made["ids_sha256"] = [hashlib.sha256(p[1]).hexdigest() for p in done]
            if "decoded_sha256" in columns:
                made["decoded_sha256"] = [hashlib.sha256(p[2]).hexdigest() for p in done]
            yield record(made, schema)

    return documents(docs).mapInArrow(run, ", ".join(f"{c} {_DDL[c]}" for c in columns))


DIGESTS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encode(read(spark, sf_dir, "documents"), DIGESTS)
