"""Sum-of-squares online packing of documents into token windows.

A packer holds a level array: how many open windows there are at each fill level.
A document's whole windows go out at once; its remainder goes to the fill level for
which the sum of the squared counts, over all levels of partially filled windows,
becomes least (a new window is level 0). When a packer has to close (its partition
ends, or ``max_open`` windows are open), the fullest windows are filled with pieces
cut from the emptiest, until one partial window is left; at the end that one is cut
at powers of two, which need no padding.

A packer serves one input partition, so packing needs no shuffle, no order of
documents and bounded memory, and a retried task gives the same windows again.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SEPARATOR = 1024, 0
#: Open windows a packer may hold; beyond it the packer closes what it can.
MAX_OPEN = 4096

#: Characters on whose classes (letter, number, space) the two tokenizer libraries
#: cannot differ: Latin text without unusual controls and spaces.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``. If the same
    vocabulary lies beside it as ranks, Latin texts are encoded from the ranks,
    which gives the same ids several times faster; all other texts, and all texts
    where there are no ranks, go through ``tokenizers``. Special tokens' strings in
    a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.quick = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def __call__(self, text: str) -> np.ndarray:
        if self.quick and not UNUSUAL.search(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) into windows; finished windows
    are handed to ``emit(sequence, [(piece, offset), ...])`` in closing order."""

    def __init__(self, emit, window: int = WINDOW, max_open: int = MAX_OPEN, first_sequence: int = 0):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.sequence = first_sequence
        # counts by level; the ends make a new window and a full one score rightly
        self.level = np.zeros(window + 1)
        self.level[0], self.level[window] = 0.5, -0.5
        self.open: dict[int, list] = {}
        self.n_open = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for start in range(0, whole, w):
            self._close([(doc, start, ids[start : start + w], n)])
        if n > whole:
            self._place((doc, whole, ids[whole:], n))

    def _place(self, piece) -> None:
        size, level = len(piece[2]), self.level
        here = level[: self.window + 1 - size]
        change = np.where(here > 0, level[size:] - here, np.inf)
        # of equal changes the fullest window
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self._take(at) if at else []
        pieces.append(piece)
        self._put(at + size, pieces)
        if self.n_open > self.max_open:
            self._merge()

    def _take(self, at: int) -> list:
        bins = self.open[at]
        pieces = bins.pop()
        if not bins:
            del self.open[at]
        self.level[at] -= 1
        self.n_open -= 1
        return pieces

    def _put(self, fill: int, pieces: list) -> None:
        if fill == self.window:
            self._close(pieces)
        elif fill:
            self.open.setdefault(fill, []).append(pieces)
            self.level[fill] += 1
            self.n_open += 1

    def _close(self, pieces: list) -> None:
        offset, out = 0, []
        for p in pieces:
            out.append((p, offset))
            offset += len(p[2])
        self.emit(self.sequence, out)
        self.sequence += 1

    @staticmethod
    def _cut(pieces: list, size: int) -> list:
        """Remove ``size`` ids from the end of ``pieces`` and return them."""
        out = []
        while size:
            doc, start, ids, n = pieces.pop()
            keep = max(0, len(ids) - size)
            out.append((doc, start + keep, ids[keep:], n))
            size -= len(ids) - keep
            if keep:
                pieces.append((doc, start, ids[:keep], n))
        return out[::-1]

    def _merge(self) -> None:
        """Fill the fullest windows from the emptiest until one is left open."""
        queue = [(fill, pieces) for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        self.open, self.n_open = {}, 0
        self.level[1 : self.window] = 0
        i, j = 0, len(queue) - 1
        while i < j:
            (fill, pieces), (low, source) = queue[i], queue[j]
            move = min(self.window - fill, low)
            pieces += self._cut(source, move)
            queue[j] = (low - move, source)
            queue[i] = (fill + move, pieces)
            if fill + move == self.window:
                self._close(pieces)
                i += 1
            if low == move:
                j -= 1
        if i == j:
            self._put(*queue[i])

    def finish(self) -> None:
        self._merge()
        for fill in list(self.open):
            pieces = self._take(fill)
            while fill:
                part = fill & -fill
                self._close(self._cut(pieces, part))
                fill -= part


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, max_open: int = MAX_OPEN
) -> DataFrame:
    """doc_id, text -> one row per piece: doc_id, start, length, doc_tokens,
    sequence_id, offset, tokens (the piece's ids, little-endian unsigned 32-bit).

    A document's ids end with id 0. Null and empty text: that id alone. Null
    doc_id: packed like any other. Repeated rows: each is packed. Very long texts
    fill whole windows of their own. Empty table: no rows. Every window has
    ``window`` ids or a power of two of them, so nothing is padded. Further columns
    of ``docs`` are ignored. ``sequence_id`` is unique, not consecutive: the input
    partition's number is in its upper bits.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("tokens", T.BinaryType())]
    )

    def pack(batches):
        encode = ByteBpe(tokenizer_path)
        done: list = []

        def emit(sequence, pieces):
            done.extend((doc, start, len(ids), n, sequence, at, ids.tobytes()) for (doc, start, ids, n), at in pieces)

        def rows():
            columns = list(zip(*done, strict=True)) or [()] * 7
            kinds = [doc_type, *[pa.int64()] * 5, pa.binary()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names
            )
            done.clear()
            return made

        packer = Packer(emit, window, max_open, TaskContext.get().partitionId() << 40)
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "")
                packer.add(doc, np.append(ids, np.uint32(SEPARATOR)).astype("<u4", copy=False))
                if len(done) >= 4096:
                    yield rows()
        if doc_type is not None:
            packer.finish()
            yield rows()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)


def assemble(pieces: DataFrame, window: int = WINDOW, pad: int = SEPARATOR) -> DataFrame:
    """The windows themselves: sequence_id, length, tokens; those that are not a
    power of two long are padded to ``window``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["tokens"]))
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("tokens"))
    power = F.bit_count("length") == 1
    padding = F.lit(int(pad).to_bytes(4, "little"))
    return filled.withColumn(
        "tokens", F.when(power, F.col("tokens")).otherwise(F.rpad("tokens", F.lit(4 * window), padding))
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_pieces(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``pack_documents`` with a checksum of each piece in place of its ids."""
    return pack_documents(docs, tokenizer_path or default_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1(spark, sf_dir):
    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
