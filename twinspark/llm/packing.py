"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from twinspark.llm.shared import release, split_words, steps, texts_of

CAPACITY = 2048
#: Cost of n tokens of one document: n + ATTENTION * n * n, the ratio of a model 4096 wide.
ATTENTION = 1 / (12 * 4096)
#: Tokens that one task holds before it packs them.
GROUP_TOKENS = 2_000_000
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SEPARATOR = "<|startoftext|>"
#: Words that normalising only lower-cases: printable characters of Latin-1.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+").fullmatch
#: The tokenizer's pattern, its letters and numbers those of lower-cased Latin-1.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
#: Byte-level spelling: bytes that are no visible character of Latin-1 stand from 256 on, in order.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokens:
    """Token ids of words; pieces of words are encoded once and kept up to a bound.

    The tokenizer's normaliser turns white space to one space, and its pattern never spans white
    space, so a text's ids are those of its words in turn.  A word of printable Latin-1
    characters is only lower-cased and cut by the pattern, so the model alone encodes its pieces;
    the whole tokenizer encodes the others, together.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.model, self.separator = self.tokenizer.model, self.tokenizer.token_to_id(_SEPARATOR)

    def _encode_pieces(self, pieces: set[str]) -> None:
        encode = self.model.tokenize
        for piece in pieces:
            spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            self.known[piece] = array.array("I", [t.id for t in encode(spelt)]).tobytes()

    def _encode_whole(self, words: list[str]) -> None:
        joined = [w for w in words if _SEPARATOR not in w]
        for k in range(0, len(joined), 20_000):
            some = joined[k : k + 20_000]
            ids = np.asarray(self.tokenizer.encode(_SEPARATOR.join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.separator)
            for w, s, e in zip(some, [0, *(ends + 1)], [*ends, len(ids)], strict=True):
                self.known[w] = ids[s:e].tobytes()
        for w in set(words).difference(joined):
            self.known[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known, cut, whole = self.known, [], []
        for word in words:
            if not _PLAIN(word) or "<|" in word:
                cut.append(word)
                if word not in known:
                    whole.append(word)
            else:
                low = word.lower()
                cut.append(low if low.isalpha() else _PIECES.findall(low))
        self._encode_whole(whole)
        pieces = {c for c in cut if type(c) is str}.union(*(c for c in cut if type(c) is list))
        self._encode_pieces(pieces.difference(known))
        return [known[c] if type(c) is str else b"".join([known[p] for p in c]) for c in cut]


def assign(lengths: np.ndarray, capacity: int = CAPACITY, attention: float = ATTENTION) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    Whole capacities are sequences of their own.  The rests go, longest first, to the sequence
    of lowest cost that has room; the fewest sequences that can hold all are open, and a rest
    that fits none is cut at the room of the emptiest.
    """
    pieces, sequences = [], 0
    for doc in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[doc]) // capacity * capacity, capacity):
            pieces.append((int(doc), start, capacity, sequences, 0))
            sequences += 1
    rests = lengths % capacity
    n = -(-int(rests.sum()) // capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    for doc in np.argsort(-rests, kind="stable"):
        left, start = int(rests[doc]), int(lengths[doc] - rests[doc])
        while left:
            fits = room >= left
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            size = min(left, int(room[at]))
            pieces.append((int(doc), start, size, sequences + at, capacity - int(room[at])))
            room[at] -= size
            cost[at] += size + attention * size * size
            start, left = start + size, left - size
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, text: str = "text") -> DataFrame:
    """Tokenise `docs` and pack them into sequences; one row (PACKED) per piece.

    Each document is its ids and then `end_id`, so a null or empty text is that one id.  A task
    tokenises its rows and packs whenever it holds `group_tokens`, so nothing is shuffled, and at
    most one sequence of a group is not full.  Sequence ids are unique, not consecutive.  Rows
    with one doc_id are documents of their own; a null doc_id stays null.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        names: list = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, names, held, total
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            rows = assign(lengths, capacity)
            views = [memoryview(x) for x in held]
            columns = list(zip(*rows, strict=True))
            crc = [zlib.crc32(views[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in rows]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in columns[0]], pa.int64())]
                + [pa.array(np.asarray(x, np.int64)) for x in (columns[1], columns[2], crc, lengths[list(columns[0])], np.asarray(columns[3]) + base, columns[4])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += 1 + max(columns[3])
            names, held, total = [], [], 0
            return out

        for batch in steps(batches, text):
            offsets, codes, words = split_words(texts_of(batch, text))
            ids = tokens.ids(words.to_pylist())
            codes = codes.tolist()
            for name, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                names.append(name)
                held.append(b"".join([ids[c] for c in codes[a:b]]) + end)
                total += len(held[-1]) // 4
                if total >= group_tokens:
                    yield flush()
        if held:
            yield flush()
        del tokens
        release()

    return docs.select("doc_id", text).mapInArrow(packed, PACKED)


def packer(path: Callable[[str], str] | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """pack_documents with the public word tokenizer."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path
    return lambda docs: pack_documents(docs, path("word_bpe_49k.json"), **options)
