"""Packing by online sum of squares.

Documents are tokenised and end with an id of 0. Whole windows are cut off a
document at once; what is left goes, whole, to the fill level for which the sum
of the squared counts of partly filled windows becomes least. The counts are a
level array of a window's length, so placing a piece costs one pass over it.
A task packs its own documents; nothing is shuffled, and the open windows, whose
number is bounded, are all that it holds. When they are too many, the pieces at the
level with the most of them are strung together and cut into full windows, and the
other windows stay open. At the end this is done with all that are left, and what
remains is cut into powers of two, which need no padding. ``placed`` says of every
piece how it came to its place, so that the share that was strung can be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 1024
END_ID = 0
#: Open windows that a task holds at most, if that is more than one for each level (with a window's ids each, 16 MB).
MAX_OPEN = 4096
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids of ``tokenizers`` for a byte-level BPE file.

    The same vocabulary as ranks gives the same ids four times faster; texts that
    hold a special token's string, and those on which the fast way breaks off,
    go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the regular expression engine gives up on some texts, with a panic of its own
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """One encoder for each Python worker."""
    if (json_path, ranks_path) not in _encoders:
        _encoders[json_path, ranks_path] = Encoder(json_path, ranks_path)
    return _encoders[json_path, ranks_path]


class Packer:
    """Online sum-of-squares packing; ``done`` gathers (key, start, ids, doc_tokens, sequence, offset, placed).

    ``placed`` is ``whole`` for a window cut off a document, ``level`` for a piece
    in the fill level chosen for it, ``strung`` for a piece of windows that did not fill.
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_sequence: int = 0):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level, the windows with it; each a list of pieces
        self.n_open = 0
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self._close([(key, at, ids[at : at + w], n)], "whole")
        if n > whole:
            self._place((key, whole, ids[whole:], n))

    def _place(self, piece: tuple) -> None:
        s, w, c = len(piece[2]), self.window, self.counts
        # leaving level l and reaching l + s changes the sum by 2 (c[l + s] - c[l]) + 2; a new window adds 2 c[s] + 1
        change = 2 * (c[s : w + 1] - c[: w + 1 - s]) + 2
        change[-1] = 1 - 2 * c[w - s]  # a full window no longer counts
        change = np.where(c[: w + 1 - s] > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * c[s] + 1
        best = w - s - int(np.argmin(change[::-1]))  # of equal ones, the fullest
        if best:
            held = self.open[best].pop()
            c[best] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if best + s == w:
            self._close(held, "level")
            return
        self.open[best + s].append(held)
        c[best + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush(int(np.argmax(c)))

    def _close(self, pieces: list[tuple], placed: str) -> None:
        at = 0
        for key, start, ids, n in pieces:
            self.done.append((key, start, ids, n, self.next, at, placed))
            at += len(ids)
        self.next += 1

    def flush(self, level: int | None = None) -> None:
        """String the pieces of the open windows of a level together and cut them into full windows; without a level those of all, at last into powers of two."""
        last = level is None
        levels = range(self.window - 1, -1, -1) if last else [level]
        pieces = [p for i in levels for held in self.open[i] for p in held]
        for i in levels:
            self.n_open -= len(self.open[i])
            self.open[i], self.counts[i] = [], 0
        total, room, held = sum(len(p[2]) for p in pieces), 0, []
        for key, start, ids, n in pieces:
            while len(ids):
                if not room:
                    room = min(self.window, 1 << (total.bit_length() - 1)) if last else self.window
                part = ids[:room]
                held.append((key, start, part, n))
                start, ids, total, room = start + len(part), ids[len(part) :], total - len(part), room - len(part)
                if not room:
                    self._close(held, "strung")
                    held = []
        if held:  # more documents come
            at = sum(len(p[2]) for p in held)
            self.open[at].append(held)
            self.counts[at] += 1
            self.n_open += 1


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of sequences: (key, start, length, ids, doc_tokens, sequence_id, offset, placed).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers;
    ``placed`` as in ``Packer``. Null and empty texts are documents of one id; a
    text of any length is encoded whole. Null keys are kept; repeated rows are
    documents of their own; an empty table gives no row. Extra columns are not
    carried, whatever their names. Sequence ids depend on how the input is dealt to
    tasks, and are the same when a task runs again.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("placed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)
        packer = Packer(window, first_sequence=TaskContext.get().partitionId() << 36)
        arrow = None

        def out() -> pa.RecordBatch:
            k, start, ids, n, seq, at, placed = zip(*packer.done, strict=True)
            packer.done = []
            longs = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(k, arrow), longs(start), longs([len(x) for x in ids]), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), longs(n), longs(seq), longs(at), pa.array(placed, pa.string())], names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "placed"])

        for b in batches:
            arrow = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for i, k in enumerate(keys):
                ids = encode(texts[i].as_py() or "")
                packer.add(k, np.append(ids, np.uint32(END_ID)).astype(np.uint32))
                if len(packer.done) >= 2000:
                    yield out()
        packer.flush()
        if packer.done:
            yield out()

    return df.select(key, text).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "placed")
