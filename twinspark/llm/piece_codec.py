"""Piece encoding and decoding through a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from twinspark.llm.shared import steps, texts_of

MARK = "▁"
#: Characters from which a chunk is not kept.
LONG = 4096
#: Chunks of up to SHORT characters are coded LOT at a time.
SHORT, LOT = 64, 1 << 14
#: Bits of the slots that hold tested pairs.
SLOTS = 20
_CHUNK = re.compile(f"{MARK}*[^{MARK}]*")
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Ids of texts under a byte-pair piece model with byte fallback, and texts of ids.

    A prefix of a text has one encoding, so one last token.  The table stores it for every
    prefix: of the tokens that an automaton finds ending there, the one that can follow the last
    token of what stands before it.  Two tokens can stand side by side if no merge across their
    border comes before the merges that use up the border's parts; that is tested on the right
    edge of one token's merge tree and the left edge of the other's.  Ids are read backwards.
    No piece holds the space mark after another character, so no merge crosses into a mark, and
    texts are coded chunk by chunk (marks, then other characters), each distinct chunk once.
    Short chunks share a table: the k-th prefixes of all of them are filled in one step.
    """

    def __init__(self, path: str, most: int = 400_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = {i for i in range(n) if model.is_unknown(i)}
        usual = [i for i in range(n) if i not in self.byte_of and i not in self.silent and i not in self.unknown and not model.is_unused(i)]
        self.id_of = {self.pieces[i]: i for i in usual}
        self.score = {self.pieces[i]: model.get_score(i) for i in usual}
        rank = {p: k + 1 for k, p in enumerate(sorted((p for p in self.id_of if len(p) > 1), key=lambda p: (-self.score[p], self.id_of[p])))}
        self.rank = rank
        # Edges of the merge trees: (part, rank at which it is made, rank at which it is used up).
        self.left: dict[int, list[tuple[str, int, int]]] = {}
        self.right: dict[int, list[tuple[str, int, int]]] = {}
        split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.id_of, key=len):
            if len(p) > 1:
                if p.startswith(MARK * 2):
                    continue
                tree = self._last_merge(p)
                if tree is None:
                    continue
                split[p] = tree
            self.automaton.add_word(p, self.id_of[p])
            for side, edges in ((0, self.left), (1, self.right)):
                edge, at, used = [], p, 1 << 60
                while True:
                    made = rank.get(at, 0)
                    edge.append((at, made, used))
                    if at not in split:
                        break
                    at, used = split[at][side], made
                edges[self.id_of[p]] = edge
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.lengths = np.array(self.length, np.int64)
        self.numbers = pa.array([str(i) for i in range(n)], pa.large_string())
        # A byte below 128 is a character wherever it stands; the text of other bytes depends on those beside them.
        self.shown = pa.array([(chr(self.byte_of[i]) if self.byte_of[i] < 128 else None) if i in self.byte_of else self._text([i]) for i in range(n)], pa.large_string())
        self.slot_key, self.slot_found = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.most = most

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts left when the best pair is merged again and again, the first of equals, and the last pair merged."""
        n, parts, last = len(text), list(text), None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, heap = self.score.get, []
        for k in range(n - 1):
            s = score(parts[k] + parts[k + 1])
            if s is not None:
                heap.append((-s, k, 2))
        heapify(heap)
        while heap:
            _, k, size = heappop(heap)
            m = after[k]
            if parts[k] is None or m >= n or len(parts[k]) + len(parts[m]) != size:
                continue  # one of the two has been merged since
            last = (parts[k], parts[m])
            parts[k], parts[m] = parts[k] + parts[m], None
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n:
                    s = score(parts[i] + parts[after[i]])
                    if s is not None:
                        heappush(heap, (-s, i, len(parts[i]) + len(parts[after[i]])))
        return [p for p in parts if p is not None], last

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts, last = self._merged(piece)
        return last if len(parts) == 1 else None

    def can_follow(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        found = self.pairs.get(key)
        if found is None:
            found = True
            for s, made_s, used_s in self.right[a]:
                for p, made_p, used_p in self.left[b]:
                    r = self.rank.get(s + p)
                    if r is not None and (at := max(r, made_s, made_p)) < used_s and at <= used_p:
                        found = False
                        break
                if not found:
                    break
            if len(self.pairs) > 2 * self.most:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _ids_of_chunk(self, chunk: str) -> list[int]:
        if chunk.startswith(MARK * 2):  # pieces of marks alone tie in score: merged as the model says
            ids: list[int] = []
            for part in self._merged(chunk)[0]:
                ids += [self.id_of[part]] if part in self.id_of else [self.id_of_byte[x] for x in part.encode()]
            return ids
        n = len(chunk)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        last[0], done = -2, 0
        can_follow = self.can_follow
        for end, token in self.automaton.iter(chunk):
            end, length = end + 1, self.length[token]
            while done < end - 1:  # a character without a piece: its bytes, and no merge on either side
                done += 1
                if last[done] == -1:
                    last[done], size[done] = -2, 1
            if last[end] == -1:
                before = last[end - length]
                if before == -2 or (before >= 0 and can_follow(before, token)):
                    last[end], size[end] = token, length
                    done = end
        for k in range(done + 1, n + 1):
            if last[k] == -1:
                last[k], size[k] = -2, 1
        ids, at = [], n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += [self.id_of_byte[x] for x in reversed(chunk[at - 1].encode("utf-8", "surrogatepass"))]
            at -= size[at]
        return ids[::-1]

    def _can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """can_follow of many pairs; each slot holds the pair last tested of those that share it."""
        key = a * len(self.pieces) + b
        slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - SLOTS)
        found = self.slot_found[slot]
        new = np.flatnonzero(self.slot_key[slot] != key)
        if len(new):
            keys, at = np.unique(key[new], return_inverse=True)
            tested = np.array([self.can_follow(*divmod(k, len(self.pieces))) for k in keys.tolist()], bool)
            found[new] = tested[at]
            self.slot_key[slot[new]], self.slot_found[slot[new]] = key[new], found[new]
        return found

    def _short_chunks(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        """What `chunk` gives, of many chunks that have a mark only in front, through one table."""
        joined = " ".join(chunks)  # no piece holds a space, so no token crosses into another chunk
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, token = found[:, 0] + 1, found[:, 1]
        place = (end - np.repeat(start, sizes + 1)[end - 1]).astype(np.uint8)
        order = np.argsort(place, kind="stable")
        end, token = end[order], token[order]
        before = end - self.lengths[token]
        # A prefix that no token ends is empty or ends with a character's bytes.
        last, size = np.full(len(joined) + 1, -2, np.int64), np.ones(len(joined) + 1, np.int64)
        lots = np.cumsum(np.bincount(place, minlength=1)).tolist()
        for lo, hi in zip(lots, lots[1:]):
            e, t, b = end[lo:hi], token[lo:hi], last[before[lo:hi]]
            fits = b == -2
            rest = np.flatnonzero(~fits)
            fits[rest] = self._can_follow(b[rest], t[rest])
            last[e[fits]] = t[fits]
        ends = np.flatnonzero(last >= 0)
        size[ends] = self.lengths[last[ends]]
        # Backwards, one token of every chunk that has any left.
        live, at, steps_back = np.arange(len(chunks)), start + sizes, []
        count = np.zeros(len(chunks), np.int64)
        while len(live):
            steps_back.append((live, at))
            count[live] += 1
            at = at - size[at]
            left = at > start[live]
            live, at = live[left], at[left]
        after = np.cumsum(count)
        ends = np.empty(after[-1], np.int64)
        for k, (live, at) in enumerate(steps_back):
            ends[after[live] - 1 - k] = at
        ids, offsets = last[ends], np.append(0, after)
        byte = np.flatnonzero(ids == -2)
        if len(byte):
            kinds, kind = np.unique(np.frombuffer(joined.encode("utf-32-le"), "<u4")[ends[byte] - 1], return_inverse=True)
            raw = [[self.id_of_byte[x] for x in chr(c).encode()] for c in kinds.tolist()]
            of = np.array([x + [-1] * (4 - len(x)) for x in raw], np.int64)
            width = np.ones(len(ids), np.int64)
            width[byte] = (of >= 0).sum(1)[kind]
            to = np.append(0, np.cumsum(width))
            wide = np.repeat(ids, width)
            for k in range(4):
                own = of[kind, k] >= 0
                wide[to[byte[own]] + k] = of[kind[own], k]
            ids, offsets = wide, to[offsets]
        flat = pa.array(ids)
        numbers = listed(joined_strings(self.numbers.take(flat), offsets, ","))
        texts = listed(joined_strings(self.shown.take(flat), offsets, ""))
        for k in [k for k, x in enumerate(texts) if x is None]:
            texts[k] = self._text(ids[offsets[k] : offsets[k + 1]].tolist())
        return list(zip(numbers, np.diff(offsets).tolist(), texts, strict=True))

    def words(self, words: list[str]) -> list[tuple[str, int, str]]:
        """What `chunk` gives, of words that hold no space mark, each with a mark in front."""
        found = {c: self.chunks.get(c) for c in [MARK + w for w in words]}
        new = [c for c, x in found.items() if x is None]
        if len(self.chunks) + len(new) > self.most:  # those in use stay
            self.chunks = {c: x for c, x in found.items() if x is not None}
        short = [c for c in new if len(c) <= SHORT]
        for k in range(0, len(short), LOT):
            lot = short[k : k + LOT]
            found.update(zip(lot, self._short_chunks(lot), strict=True))
        if len(found) <= self.most:
            self.chunks.update((c, found[c]) for c in short)
        for c in new:
            if len(c) > SHORT:
                found[c] = self.chunk(c)
        return [found[MARK + w] for w in words]

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and their text with the leading space."""
        found = self.chunks.get(chunk)
        if found is None:
            if len(self.chunks) > self.most:
                self.chunks.clear()
            ids = self._ids_of_chunk(chunk)
            found = (",".join(map(str, ids)), len(ids), self._text(ids))
            if len(chunk) < LONG:
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        marked = MARK + text.replace(" ", MARK) if text else ""
        return [i for c in _CHUNK.findall(marked) if c for i in self._ids_of_chunk(c)]

    def _text(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_replaced(bytes(held)))
                held.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        text = self._text(ids)
        spoken = [i for i in ids if i not in self.silent]
        return text[1:] if spoken and self.pieces[spoken[0]].startswith(MARK) else text


def joined_strings(strings: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    """Strings from each offset to the next as one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, strings), pa.scalar(between, pa.large_string()))


def listed(strings: pa.Array) -> list[str | None]:
    """to_pylist, many times faster."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _replaced(raw: bytes) -> str:
    """UTF-8 text, each byte that is in no character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def coded(texts: pa.Array, own: PieceCodec) -> Iterator[tuple[int, str, str]]:
    """Of each text: its number of ids, the ids joined by commas, and the text decoded from them."""
    odd = pc.match_substring_regex(texts, f"^ | $|  |{MARK}").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    encoded = lists.flatten().dictionary_encode()
    words = own.words(listed(encoded.dictionary))
    codes = encoded.indices
    offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    counts = np.append(0, np.cumsum(np.array([w[1] for w in words], np.int64)[codes.to_numpy(zero_copy_only=False)]))
    counts = counts[offsets[1:]] - counts[offsets[:-1]]
    ids = joined_strings(pa.array([w[0] for w in words], pa.large_string()).take(codes), offsets, ",")
    back = joined_strings(pa.array([w[2] for w in words], pa.large_string()).take(codes), offsets, "")
    for k, text in enumerate(texts.to_pylist()):
        if not text:
            yield 0, "", ""
        elif odd[k]:
            parts = [own.chunk(c) for c in _CHUNK.findall(MARK + text.replace(" ", MARK)) if c]
            yield sum(p[1] for p in parts), ",".join(p[0] for p in parts), "".join(p[2] for p in parts)[1:]
        else:
            yield int(counts[k]), ids[k].as_py(), back[k].as_py()[1:]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Every row's doc_id, text and ids (array of int): the operator's real output.

    A null text has no ids, an empty one neither.  Rows are independent: repeated rows give
    repeated results, and other columns are dropped.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in steps(batches, text):
            ids = [list(map(int, x[1].split(","))) if x[0] else [] for x in coded(texts_of(batch, text), own)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded_docs: DataFrame, model_path: str) -> DataFrame:
    """Texts of rows (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Digests (CODED) of every document's ids and of the text decoded from them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in steps(batches, text):
            n, ids, back = [], [], []
            for count, joined, decoded in coded(texts_of(batch, text), own):
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text).mapInArrow(run, CODED)
