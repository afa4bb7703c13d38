"""Encoding and decoding with merge-type SentencePiece vocabularies.

Symbols of a text are merged pair by pair from an agenda in order of score, ties
from left to right.  No merge crosses a place whose two bytes stand side by side
in no piece of the vocabulary, so texts are cut there, and each distinct chunk of
an Arrow batch goes through the agenda once; the ids of a text are those of its
chunks.  The library confirms each distinct chunk and a whole text of each batch;
a difference is an error, never a result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import empty_text
from .text import blocks, string_bytes

SPACE = "▁"
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 1 << 23
#: Chunks of up to so many characters go through their agendas together.
_WIDTHS = (1, 4, 8, 12, 16, 24, 40, 64)
_NONE, _NEVER = -1, np.int32(2**31 - 1)
_BAD = "�".encode()


class MergeVocabulary:
    """Pieces and scores of a model file's bytes, of merge type, without other normalisation than spaces."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = model
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, kinds = proto.normalizer_spec, proto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the vocabulary is not of merge type")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("texts are only normalised by a mark for spaces")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.rank = {p.piece.replace(SPACE, " "): (-p.score, k) for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.is_byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.is_control = np.array([p.type == kinds.CONTROL for p in proto.pieces])
        #: What each id stands for in a decoded text, before the leading space is taken off.
        self.shown = [
            b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode()
            for p in proto.pieces
        ]

    @cached_property
    def joins(self) -> np.ndarray:
        """256 x 256: whether two bytes may stand side by side within a symbol."""
        joins = np.zeros((256, 256), bool)
        joins[:, 0x80:0xC0] = True  # never within a character
        for piece in self.rank:
            raw = np.frombuffer(piece.encode(), np.uint8)
            joins[raw[:-1], raw[1:]] = True
        return joins

    def agenda(self, chunk: str) -> list[int]:
        """Ids of a chunk: adjacent symbols are merged by falling score, then from the left."""
        symbols = list(chunk)
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbols[left] + symbols[right]
                if both in rank:
                    waiting.append((rank[both][0], left, right, both))

        for k in range(n - 1):
            offer(k, k + 1)
        heapq.heapify(waiting)
        while waiting:
            _, left, right, both = heapq.heappop(waiting)
            if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(both):
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                size = len(waiting)
                offer(a, b)
                if len(waiting) > size:
                    heapq.heappush(waiting, waiting.pop())
        ids: list[int] = []
        for s in filter(None, symbols):
            if s in rank:
                ids.append(rank[s][1])
            elif self.byte:
                ids.extend(self.byte[b] for b in s.encode())
            else:
                ids.append(self.unknown)
        return ids

    @cached_property
    def apart(self) -> str | None:
        """An ASCII character that joins nothing behind it, if there is one."""
        starts = np.r_[0:0x80, 0xC0:0x100]
        return next((chr(k) for k in range(1, 128) if not self.joins[k, starts].any()), None)

    @cached_property
    def merges(self) -> PairTable:
        return PairTable(self)

    def checked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks one after the other, how many each has), confirmed by the library behind a character that joins nothing."""
        flat, size = self.merges.encoded(chunks)
        if self.apart is not None:
            head = self.agenda(" " * self.prefix + self.apart)
            theirs = self.library.encode([self.apart + c for c in chunks], num_threads=1)
            count = np.fromiter(map(len, theirs), np.int64, len(theirs)) - len(head)
            whole = np.fromiter(chain.from_iterable(x[len(head) :] for x in theirs), np.int64)
            if not np.array_equal(count, size) or not np.array_equal(whole, flat):
                ends = np.cumsum(size)
                k = next(k for k, c in enumerate(chunks) if theirs[k][len(head) :] != flat[ends[k] - size[k] : ends[k]].tolist())
                raise RuntimeError(f"the library encodes {chunks[k]!r} as {theirs[k][len(head) :]}, the agenda does not")
        return flat, size


class PairTable:
    """Agendas of many chunks at a time: a row of pair ranks for each chunk, whose first least one is merged each round.

    Symbols are numbers: ids of pieces, then characters that occur in pieces only;
    any other character is the negative of its code point less 2.
    """

    def __init__(self, vocabulary: MergeVocabulary):
        self.v, n = vocabulary, len(vocabulary.is_byte)
        inner = sorted({c for p in vocabulary.rank for c in p} - set(vocabulary.rank))
        number = {p: k for p, (_, k) in vocabulary.rank.items()} | {c: n + k for k, c in enumerate(inner)}
        self.pieces, self.inner = n, np.array([ord(c) for c in inner], np.int64)
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 2
        for symbol, k in number.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = k
        _, order = np.unique([vocabulary.rank[p][0] for p in vocabulary.rank], return_inverse=True)
        self.order = np.full(n, _NEVER, np.int32)
        self.order[[k for _, k in vocabulary.rank.values()]] = order
        self.base = n + len(inner)
        keys, made = [], []
        for piece, (_, k) in vocabulary.rank.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    made.append(k)
        by_key = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[by_key], np.array(made, np.int32)[by_key]

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.base + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        made = self.joined(a, b)
        return np.where(made >= 0, self.order[made], _NEVER)

    def merged(self, m: np.ndarray) -> np.ndarray:
        """The rows of symbols, filled up with _NONE, after all merges."""
        out, width = m.copy(), m.shape[1]
        if width == 1:
            return out
        live, r = np.arange(len(m)), self.ranks(m[:, :-1], m[:, 1:])
        column = np.arange(width)
        while len(live):
            k = r.argmin(1)
            on = r[np.arange(len(k)), k] < _NEVER
            out[live[~on]] = m[~on]
            live, m, r, k = live[on], m[on], r[on], k[on]
            row = np.arange(len(k))
            m[row, k] = self.joined(m[row, k], m[row, k + 1])
            # what stands behind the merged pair moves up by one
            m = np.take_along_axis(np.concatenate([m, np.full((len(m), 1), _NONE, m.dtype)], 1), column + (column > k[:, None]), 1)
            r = np.take_along_axis(np.concatenate([r, np.full((len(r), 1), _NEVER, r.dtype)], 1), column[:-1] + (column[:-1] > k[:, None]), 1)
            left = k > 0
            r[row[left], k[left] - 1] = self.ranks(m[row[left], k[left] - 1], m[row[left], k[left]])
            right = k < width - 1
            r[row[right], k[right]] = self.ranks(m[row[right], k[right]], m[row[right], k[right] + 1])
        return out

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each chunk has)."""
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.concatenate([[0], np.cumsum(length)])
        symbols = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        flat, size = np.zeros(first[-1], np.int32), np.zeros(len(chunks), np.int64)
        least = 0
        for width in _WIDTHS:
            rows = np.flatnonzero((length > least) & (length <= width))
            least = width
            inside = np.arange(width) < length[rows][:, None]
            m = np.full((len(rows), width), _NONE, np.int32)
            m[inside] = symbols[np.minimum(first[rows][:, None] + np.arange(width), len(symbols) - 1)[inside]] if len(rows) else []
            m = self.merged(m)
            used = m != _NONE
            size[rows] = used.sum(1)
            flat[(first[rows][:, None] + np.arange(width))[used]] = m[used]
        used = np.arange(len(flat)) - np.repeat(first[:-1], length) < np.repeat(size, length)
        flat = flat[used]
        flat, size = self._with_bytes(flat, size)
        if (rows := np.flatnonzero(length > least)).size:  # long ones have an agenda of their own
            ends, whole = np.cumsum(size), dict(zip(rows.tolist(), (self.v.agenda(chunks[k]) for k in rows), strict=True))
            flat = np.concatenate([whole[k] if k in whole else flat[e - n : e] for k, (e, n) in enumerate(zip(ends, size, strict=True))]).astype(np.int32)
            size[rows] = [len(whole[k]) for k in rows]
        return flat, size

    def _with_bytes(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become their bytes, or the unknown id."""
        odd = np.flatnonzero((flat < 0) | (flat >= self.pieces))
        if not len(odd):
            return flat, size
        code = np.where(flat[odd] < 0, -flat[odd] - 2, 0)
        inner = flat[odd] >= self.pieces
        code[inner] = self.inner[flat[odd][inner] - self.pieces]
        values, which = np.unique(code, return_inverse=True)
        ids = [[self.v.byte[b] for b in chr(c).encode()] if self.v.byte else [self.v.unknown] for c in values]
        times = np.ones(len(flat), np.int64)
        times[odd] = np.array([len(x) for x in ids])[which]
        owner = np.repeat(np.arange(len(size)), size)
        out = np.repeat(flat, times)
        begin = (np.cumsum(times) - times)[odd]
        for k, x in enumerate(ids):
            at = begin[which == k]
            for j, b in enumerate(x):
                out[at + j] = b
        return out, np.bincount(owner, times, len(size)).astype(np.int64)


class BatchEncoder:
    """Encodes Arrow batches of texts."""

    def __init__(self, vocabulary: MergeVocabulary):
        self.v = vocabulary

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins; one more than texts), without begin and end."""
        data, doc = string_bytes(texts)
        mark = SPACE.encode()
        if mark in data.tobytes():  # the same symbol as a space
            raw = [data[a:b].tobytes().replace(mark, b" ") for a, b in zip(doc[:-1], doc[1:], strict=True)]
            data, doc = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        full = np.diff(doc) > 0
        if self.v.prefix:
            data = np.insert(data, doc[:-1][full], 0x20)
            doc = doc + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(doc), np.int64)
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.v.joins[data[:-1], data[1:]]
        begins[doc[:-1][full]] = True
        cut = np.append(np.flatnonzero(begins), len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        each, size = self.v.checked([c.decode("utf-8", "replace") for c in chunks.dictionary.to_pylist()])
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(each))
        index = chunks.indices
        flat = table.take(index).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[index.to_numpy()])])
        return flat, ends[np.searchsorted(cut, doc)]


class BatchDecoder:
    """Decodes lists of ids."""

    def __init__(self, vocabulary: MergeVocabulary):
        self.v = vocabulary
        self.shown = pa.array(vocabulary.shown, pa.large_binary())

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of ids one after the other; ``first``: where each text begins."""
        if not len(ids):
            return [b""] * (len(first) - 1)
        parts = self.shown.take(pa.array(ids))
        offsets = np.frombuffer(parts.buffers()[1], np.int64, len(ids) + 1)
        raw = parts.buffers()[2].to_pybytes() if parts.buffers()[2] is not None else b""
        at = offsets[first]
        return [self._finished(raw[a:b], ids[i:j]) for a, b, i, j in zip(at[:-1], at[1:], first[:-1], first[1:], strict=True)]

    def _finished(self, raw: bytes, ids: np.ndarray) -> bytes:
        if self.v.is_byte[ids].any():
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._mended(ids)
        shows = ids[~self.v.is_control[ids]]
        if self.v.prefix and len(shows) and raw.startswith(b" ") and not self.v.is_byte[shows[0]] and shows[0] != self.v.unknown:
            raw = raw[1:]
        return raw

    def _mended(self, ids: np.ndarray) -> bytes:
        """As the library shows runs of bytes: characters where they are whole, a mark for each byte of others."""
        out, run = [], b""

        def flush() -> None:
            nonlocal run
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        run[at : at + size].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run[at : at + size])
                    at += size
                    break
                else:
                    out.append(_BAD)
                    at += 1
            run = b""

        for k in ids:
            if self.v.is_byte[k]:
                run += self.v.shown[k]
            else:
                flush()
                out.append(self.v.shown[k])
        flush()
        return b"".join(out)


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]), one row per row of ``docs``.

    ``model``: the bytes of a model file, which go to the executors with the job.
    Ids have the begin and end ids around them; ``ids_sha256`` is of little-endian
    unsigned 32-bit integers, ``decoded_sha256`` of the text that the ids decode to.

    Null texts are empty: begin and end only, which decode to the empty text.  Very
    long texts are encoded whole; a chunk that nothing cuts costs its length times
    its logarithm.  Repeated rows and null ids are rows of their own; other columns
    are ignored.  An empty table gives an empty result.
    """
    columns = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if keep_ids:
        columns += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    schema = T.StructType([*docs.select(F.col(id_col).alias("doc_id")).schema, *(T.StructField(name, kind) for name, kind in columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = MergeVocabulary(model)
        encoder, decoder = BatchEncoder(v), BatchDecoder(v)
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                texts = batch.column(1).slice(a, b - a)
                inner, first = encoder.ids(texts)
                ids = np.insert(np.insert(inner, first[1:], v.end), first[:-1] + np.arange(b - a), v.begin).astype("<u4")
                first = first + 2 * np.arange(b - a + 1)
                whole = [ids[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                decoded = decoder.texts(ids.astype(np.int32), first)
                _confirmed(v, texts[0].as_py(), whole[0], decoded[0])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in whole], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
                ]
                if keep_ids:
                    columns += [pa.array([x.astype(np.int32) for x in whole], pa.list_(pa.int32())), pa.array([t.decode() for t in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text")).mapInArrow(work, schema)


def _confirmed(v: MergeVocabulary, text: str, ids: np.ndarray, decoded: bytes) -> None:
    """The library agrees on a whole text."""
    theirs = v.library.encode(text, add_bos=True, add_eos=True)
    if theirs != ids.tolist() or v.library.decode(theirs).encode() != decoded:
        raise RuntimeError("the library encodes or decodes a text in another way")
