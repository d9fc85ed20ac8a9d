"""Encoding and decoding with merge-type piece vocabularies, one score-ordered agenda per chunk.

A text is cut before every run of word marks (the vocabulary's sign for a
space): no piece holds a mark after another character, so no merge crosses
such a place.  Each distinct chunk is encoded once per worker.  Its agenda
holds the pairs of adjacent symbols that make a piece, ordered by score, then
from left to right; the best pair is merged and its neighbours enter the
agenda, until it is empty.  Short chunks go through their agendas side by side
as rows of a matrix, long ones through a heap.  Characters outside the
vocabulary become byte pieces, or the unknown id where there are none.

Every new chunk is also encoded by the sentencepiece library in the same Arrow
batch and must give the same ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftrank.llm.common import bound_batches, named, string_groups, tidy, whole_text, wider, without, worker_state

MARK = "▁"
CACHE_CHUNKS = 500_000  # distinct chunks a worker remembers; it then starts anew
WIDTHS = (6, 10, 16, 24)  # widths of the matrices; longer chunks go through a heap
FILLER = np.int32(-(1 << 22))  # below any character's number
GROUP_CHARS = 4 << 20   # texts whose new chunks are encoded together
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NO_RANK = np.int32(2**31 - 1)


class Pieces:
    """A vocabulary: symbols, the pairs that merge, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as stream:
            model.ParseFromString(stream.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model without character map is needed")
        if model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that change white space are not supported")
        kinds = [p.type for p in model.pieces]
        if USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece goes on after a word mark")
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        # Symbols: the ids, then one number for each further character that occurs in a piece.
        self.symbols = dict(self.ids)
        for piece in list(self.ids):
            for char in piece:
                self.symbols.setdefault(char, len(model.pieces) + len(self.symbols))
        # Scores are compared as they are; equal scores are equal ranks, so the leftmost pair is first.
        longer = [i for piece, i in self.ids.items() if len(piece) > 1]
        scores = np.unique([-model.pieces[i].score for i in longer])
        rank = {i: int(np.searchsorted(scores, -model.pieces[i].score)) for i in longer}
        pairs = {}
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                left, right = self.symbols.get(piece[:at]), self.symbols.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[i], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.size = len(model.pieces)
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in model.pieces]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; no rank where the pair is no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def side_by_side(self, chunks: list[str]) -> list[list[int]]:
        """Ids of short chunks: in every round each chunk merges the best pair of its agenda."""
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        order = np.argsort(sizes, kind="stable")
        found: list[list[int]] = [[]] * len(chunks)
        bounds = np.searchsorted(sizes[order], [0, *WIDTHS], side="right")
        for size, first, last in zip(WIDTHS, bounds, bounds[1:]):
            rows = order[first:last]
            if not len(rows):
                continue
            letters = np.frombuffer("".join([chunks[r] for r in rows]).encode("utf-32-le"), dtype="<u4")
            alphabet, place = np.unique(letters, return_inverse=True)
            # A character outside the vocabulary is a symbol below zero: it never merges.
            number = np.array([self.symbols.get(chr(c), -1 - c) for c in alphabet.tolist()], dtype=np.int32)
            symbols = np.full((len(rows), size), FILLER, dtype=np.int32)
            symbols[np.arange(size)[None, :] < sizes[rows][:, None]] = number[place]
            rank = self.look_up(symbols[:, :-1], symbols[:, 1:])
            # Every open chunk loses one symbol a round, so all keep the same width.
            while len(rows):
                width = symbols.shape[1]
                if width > 1:
                    at = rank.argmin(axis=1)
                    ended = rank[np.arange(len(rows)), at] == NO_RANK
                else:
                    ended = np.ones(len(rows), dtype=bool)
                if ended.any():
                    last = symbols[ended]
                    length = (last != FILLER).sum(axis=1)
                    plain = (((last >= 0) & (last < self.size)) | (last == FILLER)).all(axis=1)
                    for row, own, n, good in zip(rows[ended].tolist(), last.tolist(), length.tolist(), plain.tolist()):
                        found[row] = own[:n] if good else self.spell(own[:n])
                    going = ~ended
                    rows, symbols, rank = rows[going], symbols[going], rank[going]
                    if not len(rows):
                        break
                    at = at[going]
                line = np.arange(len(rows))
                pair = symbols[line, at].astype(np.int64) << 32 | symbols[line, at + 1]
                symbols[line, at] = self.merged[np.searchsorted(self.keys, pair)]
                symbols = symbols[np.arange(width)[None, :] != at[:, None] + 1].reshape(len(rows), width - 1)
                rank = rank[np.arange(width - 1)[None, :] != at[:, None]].reshape(len(rows), width - 2)
                # The pairs on both sides of the new symbol enter the agenda anew.
                for left, exists in ((at - 1, at > 0), (at, at < width - 2)):
                    r, p = line[exists], left[exists]
                    rank[r, p] = self.look_up(symbols[r, p], symbols[r, p + 1])
        return found

    def heap(self, chunk: str) -> list[int]:
        """Ids of one chunk of any length."""
        symbols = [self.symbols.get(c, -1 - ord(c)) for c in chunk]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def push(left: int) -> None:
            right = after[left]
            if right < n and symbols[left] >= 0 and symbols[right] >= 0:
                pair = self.pairs.get(symbols[left] << 32 | symbols[right])
                if pair:
                    heapq.heappush(agenda, (pair[0], left, pair[1], symbols[left], symbols[right]))

        for left in range(n - 1):
            push(left)
        while agenda:
            _, left, piece, first, second = heapq.heappop(agenda)
            right = after[left]
            if not alive[left] or symbols[left] != first or right >= n or symbols[right] != second:
                continue
            symbols[left], alive[right] = piece, False
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                push(before[left])
            push(left)
        return self.spell([s for s, a in zip(symbols, alive) if a])

    def spell(self, symbols: list[int]) -> list[int]:
        """Symbols without an id become byte pieces, or one unknown id for each run of them."""
        found: list[int] = []
        names = None
        run = False
        for symbol in symbols:
            if 0 <= symbol < self.size:
                found.append(symbol)
                run = False
                continue
            if symbol >= 0:
                names = names or {v: k for k, v in self.symbols.items()}
                char = names[symbol]
            else:
                char = chr(-1 - symbol)
            if self.bytes:
                found.extend(self.bytes[b] for b in char.encode())
            elif not run:
                found.append(self.unknown)
            run = True
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        marked = MARK + marked if self.prefix else marked
        if MARK + MARK in marked:
            return CHUNK.findall(marked)
        first, *rest = marked.split(MARK)
        return ([first] if first else []) + [MARK + word for word in rest]

    def learn(self, chunks: list[str], check: bool) -> None:
        """Encode chunks that this worker has not seen, and compare with the library."""
        most = WIDTHS[-1]
        short = [c for c in chunks if len(c) <= most]
        long = [c for c in chunks if len(c) > most]
        for chunk, ids in zip(short + long, self.side_by_side(short) + [self.heap(c) for c in long]):
            self.known[chunk] = (struct.pack(f"<{len(ids)}i", *ids), (",".join(map(str, ids)) + ",").encode())
        if check and chunks:
            # The library puts its own mark in front of a text.
            asked = [c[1:].replace(MARK, " ") if c[0] == MARK and len(c) > 1 else None for c in chunks]
            plain = [(c, a) for c, a in zip(chunks, asked) if a] if self.prefix else []
            for (chunk, _), ids in zip(plain, self.library.encode([a for _, a in plain], num_threads=1)):
                own = np.frombuffer(self.known[chunk][0], dtype="<i4").tolist()
                if ids != own:
                    raise ValueError(f"ids of {chunk!r} differ from the library's: {own}, {ids}")

    def encode(self, texts: list[str], check: bool = True) -> Iterator[tuple[list[int], bytes]]:
        """Ids of each text, and the same as decimal numbers, a comma after each."""
        parts = [self.chunks(text) for text in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        wanted = set()
        for part in parts:
            wanted.update(part)
        self.learn([c for c in wanted if c not in self.known], check)
        known = self.known
        for part in parts:
            found = [known[c] for c in part]
            ids = np.frombuffer(b"".join([own for own, _ in found]), dtype="<i4").tolist()
            yield ids, b"".join([line for _, line in found])

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it: each byte that is no part of a character becomes U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and raw[:1] == b" " and not (ids and self.is_byte[ids[0]]):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


def pieces(path: str) -> Pieces:
    """The worker's vocabulary for a model file."""
    found = worker_state("piece_vocabularies")
    if path not in found:
        found[path] = Pieces(path)
    return found[path]


def encode_pieces(docs: DataFrame, path: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int) and ``decoded``.  A null text is empty and has no ids.

    Columns of these names in the input are replaced; rows are never merged.
    """
    bound_batches(docs)
    kept = without(docs, ["piece_ids", "decoded"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            ids, texts = [], []
            for group in string_groups(batch.column(batch.num_columns - 1), GROUP_CHARS):
                for found, _ in own.encode(group, check):
                    ids.append(found)
                    texts.append(own.decode(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], "piece_ids", "decoded"])

    source = kept.select("*", whole_text(named(docs, text)).alias("_piece_text"))
    return source.mapInArrow(tidy(encode), wider(kept, piece_ids="array<int>", decoded="string"))


def piece_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the results of ``encode_pieces`` as digests, batch by batch."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            sizes, first, second = [], [], []
            for group in string_groups(batch.column(1), GROUP_CHARS):
                for ids, line in own.encode(group, check):
                    sizes.append(len(ids))
                    first.append(hashlib.sha256(line[:-1]).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs)
    rows = docs.select(named(docs, doc_id).alias("doc_id"), whole_text(named(docs, text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(encode), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
