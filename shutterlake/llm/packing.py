"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention within
its document). Descending pieces go to the sequence of lowest cost among those
with room; a piece that no sequence has room for is cut, and the rest goes on.
A document over the sequence length first gives whole sequences of its own.

Tasks pack what they read, in lots of about `lot` tokens: nothing is shuffled,
no group grows with the input, and a lost task repeats the same lot, as the
order of a split does not change. What remains of a task's last lot is cut to
powers of two, which need no padding.

Cases: null text: empty, so a document of its end token alone. Equal costs:
the earlier sequence; equal pieces: the earlier row. Repeated rows are packed
each for itself. An empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import slices, tidied

LENGTH, LOT = 2048, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
REMEMBER = 600_000
_ENCODERS: dict = {}


class Encoder(dict):
    """Token ids of whole texts as little-endian uint32 bytes.

    The pre-tokenizer begins anew at a blank or line end that stands between
    two characters that are no white space; so the words that start there are
    encoded once each and remembered in a table of bounded size. Any other
    text, and one that holds a special token's string, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.word = self._ranks(path) or (lambda text: self.tok.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _ranks(path: str) -> Callable | None:
        """The same vocabulary as ranks, if it lies beside the file: several times faster on single words."""
        import base64
        import os

        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if ranks_path == path or not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        bare = word.removeprefix("\n")
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise ValueError("white space beside white space")
        b = np.asarray(self.word(word if bare is not word else " " + word), "<u4").tobytes()
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 48:
            self[word] = b
        return b

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        try:
            body = b"".join(map(self.__getitem__, rest))
        except ValueError:
            return self.whole(text)
        return np.asarray(self.word(first), "<u4").tobytes() + body

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def capacities(total: int, length: int, last: bool) -> list[int]:
    """Room of each sequence: full ones, and at the end powers of two."""
    room = [length] * (total // length)
    rest = total % length
    if rest and not last:
        raise ValueError("only the last lot may have a rest")
    while rest:
        p = 1 << (rest.bit_length() - 1)
        room.append(p)
        rest -= p
    return room


def assign(sizes: list[int], room: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of all pieces; the sum of sizes is the sum of room."""
    import heapq

    pieces = [(-n, i, 0) for i, n in enumerate(sizes) if n]
    heapq.heapify(pieces)
    left = np.array(room, np.int64)
    spent = np.zeros(len(room))
    out = []
    while pieces:
        n, doc, start = heapq.heappop(pieces)
        n = -n
        fits = left >= n
        if fits.any():
            k = int(np.where(fits, spent, np.inf).argmin())
            take = n
        else:
            k = int(left.argmax())
            take = int(left[k])
            heapq.heappush(pieces, (take - n, doc, start + take))
        out.append((doc, start, take, k))
        left[k] -= take
        spent[k] += cost(take, linear, quadratic)
    return out


def pack_lot(ids: list[np.ndarray], length: int, last: bool, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces of a lot: (document, start, length, sequence, offset); and what is left of the last document for the next lot."""
    total = sum(map(len, ids))
    rest = 0 if last else total % length
    sizes = [len(x) for x in ids]
    taken = rest  # the rest comes off the end of the last documents
    held: list[tuple[int, int]] = []
    while taken:
        k = len(sizes) - 1 - len(held)
        cut = min(sizes[k], taken)
        held.append((k, sizes[k] - cut))
        sizes[k] -= cut
        taken -= cut
    filled = [0] * ((total - rest) // length + 64)
    pieces = []
    for doc, start, n, seq in assign(sizes, capacities(total - rest, length, last), linear, quadratic):
        pieces.append((doc, start, n, seq, filled[seq]))
        filled[seq] += n
    return pieces, held[::-1], max((p[3] for p in pieces), default=-1) + 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, lot: int = LOT, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, cost."""
    only = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
    L = T.LongType()
    schema = T.StructType([only.schema["doc_id"], T.StructField("start", L), T.StructField("length", L), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", L), T.StructField("sequence_id", L), T.StructField("offset", L), T.StructField("cost", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        next_seq = TaskContext.get().partitionId() << 40
        # of each document that is held: its id, all its ids, where its rest starts
        held: list[tuple] = []
        size, kind = 0, None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, next_seq
            pieces, rest, used = pack_lot([x[2][x[1] :] for x in held], length, last, linear, quadratic)
            cols = [[], [], [], [], [], [], [], []]
            for doc, start, n, seq, offset in pieces:
                doc_id, base, ids = held[doc]
                start += base
                for c, v in zip(cols, (doc_id, start, n, ids[start : start + n].tobytes(), len(ids), next_seq + seq, offset, float(cost(n, linear, quadratic))), strict=True):
                    c.append(v)
            held = [(held[k][0], held[k][1] + at, held[k][2]) for k, at in rest]
            size = sum(len(x[2]) - x[1] for x in held)
            next_seq += used
            i64 = pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, i64, i64, pa.binary(), i64, i64, i64, pa.float64()), strict=True)], names=names)

        for batch in slices(batches, 1):
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer((enc.encode(text) if text else b"") + end, "<u4")
                held.append((doc_id, 0, ids))
                size += len(ids)
                if size >= lot:
                    yield flush(False)
        if held:
            yield flush(True)

    return only.mapInArrow(tidied(run), schema)


def crc32_of_ids(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
