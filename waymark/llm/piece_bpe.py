"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda, and decoding.

A chunk is a run of spaces with the word after it; no piece of a vocabulary that
is accepted here crosses into the next chunk, so chunks are encoded one by one
and equal ones once.  The agenda of a chunk holds its adjacent symbol pairs that
form a piece; the best score, then the leftmost, is merged, and the pairs at its
sides come anew.  Short chunks of a batch run in lock step, a row of a matrix
each; long ones use a heap.  Every chunk that is encoded is checked against the
sentencepiece library in its Arrow batch; a difference is an error.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Symbols of chunks that run in lock step; longer chunks use a heap.
WIDTHS = (6, 10, 16, 28)
#: Encoded chunks that a worker keeps (about 300 bytes each).
CACHE = 200_000
_NONE = np.int32(2**31 - 1)
_encoders: dict[str, AgendaEncoder] = {}


class AgendaEncoder:
    """The pairs of a vocabulary that merge, and encoding of chunks with them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses from a word into the next space")
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.symbols = dict(pieces)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, len(self.symbols) + n)
        self.unknown = max(self.symbols.values(), default=n) + 1
        self.length = [len(lib.id_to_piece(i)) for i in range(n)]
        chars = {ord(c): i for c, i in self.symbols.items() if len(c) == 1}
        self.of_code = np.full(max(chars, default=0) + 2, self.unknown, dtype=np.int64)
        self.of_code[list(chars)] = list(chars.values())
        ids, scores = np.array(normal), np.array([lib.get_score(i) for i in normal])
        order = np.argsort(-scores, kind="stable")
        ranks = np.cumsum(np.concatenate(([True], np.diff(-scores[order]) > 0))) - 1
        rank = np.zeros(n, dtype=np.int64)
        rank[ids[order]] = ranks
        pair_keys, pair_out = [], []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pair_keys.append(a << 20 | b)
                    pair_out.append(i)
        order = np.argsort(pair_keys)
        self.keys, self.out = np.array(pair_keys, dtype=np.int64)[order], np.array(pair_out, dtype=np.int64)[order]
        self.rank = rank
        self.pair = dict(zip(self.keys.tolist(), self.out.tolist(), strict=True))
        self.known: dict[str, bytes] = {}

    def heap(self, chunk: str) -> list[int]:
        """The agenda of one chunk as a heap; returns symbols."""
        sym = [self.symbols.get(c, self.unknown) for c in chunk]
        n = len(sym)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            piece = self.pair.get(sym[i] << 20 | sym[j])
            if piece is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), i, j, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if not (live[i] and live[j] and sym[i] == a and sym[j] == b and right[i] == j):
                continue
            sym[i], live[j] = self.pair[a << 20 | b], False
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s, ok in zip(sym, live, strict=True) if ok]

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of symbol pairs; _NONE where they form none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        piece = np.where(hit, self.out[at], 0)
        return np.where(hit, self.rank[piece], _NONE).astype(np.int32), piece

    def lock_step(self, chunks: list[str], width: int) -> list[list[int]]:
        """The agendas of many chunks of at most ``width`` symbols; a row each, its best pair merged in each round."""
        n = len(chunks)
        pad = self.unknown + 1
        codes = np.array([c.ljust(width, "\0") for c in chunks], dtype=f"<U{width}").view("<u4").reshape(n, width)
        size = np.array([len(c) for c in chunks])
        sym = self.of_code[np.minimum(codes, len(self.of_code) - 1)]
        sym[np.arange(width) >= size[:, None]] = pad
        rank, piece = self._find(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank, piece = rank.reshape(n, -1), piece.reshape(n, -1)
        done = np.full((n, width), pad, dtype=np.int64)
        rows, cols = np.arange(n), np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            here = np.arange(len(rows))
            open_ = rank[here, best] != _NONE
            if not open_.all():
                done[rows[~open_]] = sym[~open_]
                rows, sym, rank, piece, best = rows[open_], sym[open_], rank[open_], piece[open_], best[open_]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            sym[here, best] = piece[here, best]
            shift = np.minimum(cols + (cols > best[:, None]), width)
            sym = np.take_along_axis(np.concatenate((sym, np.full((len(rows), 1), pad)), axis=1), shift, axis=1)
            shift = np.minimum(cols[:-1] + (cols[:-1] > best[:, None]), width - 1)
            rank = np.take_along_axis(np.concatenate((rank, np.full((len(rows), 1), _NONE)), axis=1), shift, axis=1)
            piece = np.take_along_axis(np.concatenate((piece, np.zeros((len(rows), 1), dtype=np.int64)), axis=1), shift, axis=1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                r, p = self._find(sym[ok, side[ok]], sym[ok, side[ok] + 1])
                rank[ok, side[ok]], piece[ok, side[ok]] = r, p
        return [row[:k] for row, k in zip(done.tolist(), (done != pad).sum(axis=1).tolist(), strict=True)]

    def _ids(self, chunk: str, symbols) -> list[int]:
        """Symbols to ids; characters without a piece become their bytes."""
        out, at = [], 0
        for s in symbols:
            if s < len(self.length):
                out.append(s)
                at += self.length[s]
            else:
                out.extend(self.byte_ids[b] for b in chunk[at].encode())
                at += 1
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian unsigned 32-bit integers, checked against the library."""
        out: list[list[int]] = [[] for _ in chunks]
        lengths = np.array([len(c) for c in chunks])
        below, top = 0, len(self.length)
        for width in WIDTHS:
            which = np.flatnonzero((lengths > below) & (lengths <= width) if below else lengths <= width)
            below = width
            for at in range(0, len(which), 20_000):
                some = which[at : at + 20_000].tolist()
                for k, symbols in zip(some, self.lock_step([chunks[k] for k in some], width), strict=True):
                    out[k] = symbols if max(symbols) < top else self._ids(chunks[k], symbols)
        for k in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[k] = self._ids(chunks[k], self.heap(chunks[k]))
        # the library puts a space of its own before a text
        told = self.library.encode([c[1:].replace(SPACE, " ") for c in chunks], num_threads=1)
        for c, own, lib in zip(chunks, out, told, strict=True):
            if own != lib and c != SPACE:
                raise AssertionError(f"agenda and library differ on {c!r}: {own} {lib}")
        flat = np.fromiter(itertools.chain.from_iterable(out), dtype="<u4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, out)])).tolist()
        return [flat[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, without begin and end ids."""
        cut = []
        for text in texts:
            text = text.replace(SPACE, " ")
            parts = text.split(" ")
            if "" in parts:  # runs of spaces, or one at an end
                parts = [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
            cut.append(parts if text else [])
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        ids = dict(zip(new, self.encode_chunks([SPACE + p.replace(" ", SPACE) for p in new]), strict=True)) if new else {}
        room = CACHE - len(known)
        if room > 0:
            known.update((p, ids[p]) for p in new[:room])
            ids = {p: ids[p] for p in new[room:]}
        if not ids:
            return [b"".join(map(known.__getitem__, parts)) for parts in cut]
        return [b"".join([known.get(p) or ids[p] for p in parts]) for parts in cut]


def encoder(path: str) -> AgendaEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = AgendaEncoder(path)
    return _encoders[path]


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        ends = np.array([enc.bos], dtype="<u4").tobytes(), np.array([enc.eos], dtype="<u4").tobytes()
        for batch in batches:
            at = batch.schema.get_field_index(name)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [ends[0] + x + ends[1] for x in enc.encode([t or "" for t in part.column(at).to_pylist()])]
                decoded = enc.library.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids], num_threads=1)
                rest = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for n in part.schema.names if n != name]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit integers, with begin and end ids) and decoded, without the text.

    Ids are the sentencepiece library's for the whole text, without sampling;
    ``decoded`` is the library's decode of them.  Null text is empty and has
    the begin and end ids alone.  Repeated rows give equal rows; an empty table
    gives no rows; other columns stay, but for any named ids or decoded.
    ``model`` is a path that all executors can open, and must be a merge-type
    vocabulary with byte fallback.
    """
    docs = docs.drop("ids", "decoded").withColumn(text_col, F.col(text_col).cast("string"))
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids binary, decoded string"])
    return docs.mapInArrow(_encode(model, text_col), schema)


def id_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of :func:`encode_decode`."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
