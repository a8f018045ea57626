"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

Every segment holds an agenda of its adjacent symbol pairs ordered by (score, leftmost); the best pair is merged and
its two neighbours are scored anew, until no pair is in the vocabulary. The agendas of all distinct segments of a
chunk advance together as rows of NumPy matrices; segments longer than ``WIDE`` use a heap. Symbols outside the
vocabulary fall back to bytes. Results are checked against the sentencepiece library: every distinct segment that is
computed, both ways, and a mismatch fails the task.

A segment starts at each space mark that follows another character. No piece holds a space mark behind another
character (checked when the model is loaded), so no merge crosses that border and segments are independent.

Null or empty texts have no ids and decode to the empty text; repeated rows give repeated results; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks_by_size, id_text, trim

MARK = "▁"
WIDE = 48
NONE = np.int64(2**62)
CHUNK = 500_000  # characters whose segments a task holds at once
ROWS = 160  # rows whose results it holds
OUTSIDE = 1 << 20  # symbols from here on are code points without a piece
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, byte pieces and the merges that a vocabulary allows."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal):
            raise ValueError("a piece holds a space mark behind another character")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.spelled = [p.replace(MARK, " ") for p in self.pieces]
        self.digits = [str(i) for i in range(n)]
        self.lines_apart = not any("\n" in self.pieces[i] for i in normal)  # then no merge crosses a line break
        ids = {self.pieces[i]: i for i in normal}
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        by_score = sorted({-sp.get_score(i) for i in normal})
        rank = {s: r for r, s in enumerate(by_score)}
        merges = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                if (a := ids.get(piece[:cut])) is not None and (b := ids.get(piece[cut:])) is not None:
                    merges[a << 20 | b] = (rank[-sp.get_score(i)], i)  # 20 bits hold any id
        self.merges = merges
        self._table(merges)

    def _table(self, merges: dict[int, tuple[int, int]]) -> None:
        """Merges by open addressing: ``keys`` and, beside them, rank << 20 | merged id."""
        self.slots = 1 << max(4, (4 * len(merges)).bit_length())
        self.keys, self.values, self.probes = np.full(self.slots, -1, np.int64), np.full(self.slots, NONE, np.int64), 1
        for key, (rank, piece) in merges.items():
            at, n = self._slot(key), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) % self.slots, n + 1
            self.keys[at], self.values[at], self.probes = key, rank << 20 | piece, max(self.probes, n)

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 13) % self.slots if isinstance(key, int) else ((key * np.int64(0x9E3779B1)) >> 13) & (self.slots - 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of pairs of symbols; NONE where they don't merge."""
        key = np.where((left < OUTSIDE) & (right < OUTSIDE) & (right >= 0), left.astype(np.int64) << 20 | right, -2)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0) & (key >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        ids = self.chars[codes]
        return np.where(ids >= 0, ids, codes.astype(np.int32) + OUTSIDE)

    def final(self, symbols: list[int]) -> list[int]:
        if max(symbols, default=0) < OUTSIDE:
            return symbols
        out = []
        for s in symbols:
            if s < OUTSIDE:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in chr(s - OUTSIDE).encode()]
        return out

    def _agendas(self, segments: list[str], width: int) -> list[list[int]]:
        """Segments of at most ``width`` characters, advanced together, one merge each per round."""
        n = len(segments)
        codes = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le"), np.uint32).reshape(n, width)
        length = np.fromiter(map(len, segments), np.int32, n)
        sym = self.symbols(codes)
        cols = np.arange(width, dtype=np.int32)
        sym[cols[None, :] >= length[:, None]] = -1
        agenda = np.full((n, width), NONE, np.int64)
        if width > 1:
            agenda[:, :-1] = self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, -1)
        done: list[list[int]] = [[]] * n
        index = np.arange(n)
        while True:
            at = (agenda >> 20).argmin(axis=1)  # the best rank, leftmost
            row = np.arange(len(index))
            best = agenda[row, at]
            over = best == NONE
            if over.any():
                ended = sym[over]
                for i, line, size in zip(index[over].tolist(), ended.tolist(), (ended >= 0).sum(axis=1).tolist()):
                    done[i] = self.final(line[:size])
                keep = ~over
                index, sym, agenda, at, best = index[keep], sym[keep], agenda[keep], at[keep], best[keep]
                if not len(index):
                    break
                row = np.arange(len(index))
            shift = cols[None, :-1] > at[:, None]  # columns behind the merge move up by one
            np.copyto(sym[:, :-1], sym[:, 1:].copy(), where=shift)
            np.copyto(agenda[:, :-1], agenda[:, 1:].copy(), where=shift)
            sym[:, -1], agenda[:, -1] = -1, NONE
            sym[row, at] = best & (OUTSIDE - 1)
            right = np.where(at + 1 < sym.shape[1], sym[row, np.minimum(at + 1, sym.shape[1] - 1)], -1)
            agenda[row, at] = self.pairs(sym[row, at], right)
            x = np.flatnonzero(at > 0)
            agenda[x, at[x] - 1] = self.pairs(sym[x, at[x] - 1], sym[x, at[x]])
        return done

    def _heap(self, segment: str) -> list[int]:
        """The agenda of one long segment as a heap over a linked list."""
        sym = self.symbols(np.frombuffer(segment.encode("utf-32-le"), np.uint32)).tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and sym[i] < OUTSIDE and sym[j] < OUTSIDE and (m := self.merges.get(sym[i] << 20 | sym[j])):
                heapq.heappush(agenda, (m[0], i, sym[i], sym[j], m[1]))

        for i in range(n - 1):
            push(i)
        while agenda:
            _, i, a, b, merged = heapq.heappop(agenda)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return self.final([s for s in sym if s >= 0])

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments, each starting with its space marks."""
        out: list[list[int]] = [[]] * len(segments)
        lanes: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            lanes.setdefault(-(-len(s) // 8) * 8 if len(s) <= WIDE else 0, []).append(i)
        for width, members in lanes.items():
            part = [segments[i] for i in members]
            for i, ids in zip(members, self._agendas(part, width) if width else map(self._heap, part)):
                out[i] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with its leading space mark still in place: byte pieces join to characters."""
        if self.bytes_of.keys().isdisjoint(ids):
            return "".join(map(self.spelled.__getitem__, ids))
        return b"".join([self.bytes_of.get(i) or self.spelled[i].encode() for i in ids]).decode(errors="replace")


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> Vocabulary:
    return Vocabulary(model_path)


def segments_of(text: str, lines_apart: bool) -> list[str]:
    """Keys of the segments of a text behind the dummy prefix. A key without a mark stands for the segment of one
    space mark and the key, or, if it starts with a line break, for a segment without a mark."""
    if not text:
        return []
    keys = (text.replace("\n", " \n") if lines_apart else text).split(" ")
    if "" not in keys and MARK not in text and keys[0][0] != "\n":
        return keys
    found = _SEGMENT.findall(MARK + text.replace(" ", MARK))
    return [s if s[1:2] in ("", MARK, "\n") else s[1:] for s in found]


def spelled_out(key: str) -> str:
    return key if key[0] in "\n" + MARK else MARK + key


class Codec:
    """Encodes chunks of texts; what it knows of segments is bounded by ``keep`` and one chunk: their ids as
    comma-joined text, and the decoded text of those that decode to something else than their own spelling."""

    def __init__(self, model_path: str, keep: int = 200_000, check: bool = True) -> None:
        self.vocab, self.keep, self.check = vocabulary(model_path), keep, check
        self.known: dict[str, str] = {}
        self.other: dict[str, str] = {}

    def learn(self, keys: list[str]) -> None:
        """Ids and decoded text of segments not known yet."""
        v = self.vocab
        found = v.encode_segments([spelled_out(k) for k in keys])
        texts = list(map(v.decode, found))
        join, digits = ",".join, v.digits.__getitem__
        self.known.update(zip(keys, [join(map(digits, ids)) for ids in found]))
        self.other.update((k, t) for k, t in zip(keys, texts) if t != " " + k)
        if self.check:
            self._agrees(keys, found, texts)

    def _agrees(self, keys: list[str], found: list[list[int]], texts: list[str]) -> None:
        """Every segment's ids and text against the library."""
        lib = self.vocab.library
        for k, ids, theirs in zip(keys, found, lib.encode([k[1:] if k[0] == MARK else k for k in keys], num_threads=1)):
            if ids != theirs and not (k[0] == "\n" and ids == theirs[1:]) and k != MARK:
                raise ValueError(f"the library encodes {k!r} as {theirs}, not {ids}")
        for ids, ours, text in zip(found, texts, lib.decode(found)):
            if text not in (ours, ours[1:]):
                raise ValueError(f"the library decodes {ids} as {text!r}, not {ours!r}")

    def run(self, texts: list[str]):
        """(ids joined by commas, number of ids, decoded text) of each text."""
        for a, b in chunks_by_size(texts, CHUNK):
            split = [segments_of(t, self.vocab.lines_apart) for t in texts[a:b]]
            if len(self.known) > self.keep:
                self.known, self.other = {}, {}
            known, other = self.known, self.other
            if fresh := list({s for part in split for s in part if s not in known}):
                self.learn(fresh)
            for part in split:
                ids = ",".join(map(known.__getitem__, part))
                said = " ".join(part) if other.keys().isdisjoint(part) else "".join([other.get(s) or " " + s for s in part])[1:]
                yield ids, ids.count(",") + 1 if ids else 0, said


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, or with ``digests`` their SHA-256. One narrow scan. The model
    must lie at ``model_path`` on every executor."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def scan(batches):
        gc.disable()  # nothing here is cyclic, and scans of large tables of tuples cost much
        try:
            codec = Codec(model_path, check=check)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    texts = b.column(1).slice(at, ROWS).to_pylist()
                    ids, counts, said = zip(*codec.run(texts))  # results leave by few rows, so their size is bounded
                    first = pa.array(map(sha, ids), pa.string()) if digests else pa.ListArray.from_arrays(np.cumsum([0, *counts], dtype=np.int32), np.concatenate([np.fromstring(i, np.int32, sep=",") for i in ids]))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), pa.array(counts, pa.int64()), first, pa.array(map(sha, said) if digests else said, pa.string())], ["doc_id", "n_tokens", *names])
        finally:
            gc.enable()
            trim()

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return id_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, n_tokens long, {names[0]} {'string' if digests else 'array<int>'}, {names[1]} string")
