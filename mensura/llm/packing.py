"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Texts are tokenized where they lie; only lengths travel. Pieces are dealt evenly into groups of a
fixed number, which bounds the work of a task whatever the data, and each group is packed alone: a
sequence is filled greedily with the longest piece that fits, and if a gap is left its smallest piece is
replaced by the two unpacked pieces that fit the expanded gap most tightly. A group wastes at most
its last sequences, so groups of some thousand pieces cost well under 0.1 % against one group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, small_batches, stored

#: Pieces of one packing group.
GROUP = 4096

# Fixed value: the added token of byte_bpe_50k.json.
BYTE_BPE_ADDED = {"<|endoftext|>": 50256}

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def encoder(path: str, added: dict[str, int] | None = None):
    """Function from a list of texts to lists of ids. A ``.json`` file is read by tokenizers, a ``.tiktoken`` file of
    ranks by tiktoken. A json file names its added tokens, a file of ranks does not: ``added`` holds their strings
    and ids. Where a text says such a string, it is that one token."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    return lambda texts: [own.encode(t, allowed_special="all") for t in texts]


def _pieces(path: str, added: dict[str, int] | None, size: int, end_id: int):
    def run(batches):
        encode = encoder(path, added)
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):
                keys, texts = (c.slice(at, 256).to_pylist() for c in b.columns)
                for key, ids in zip(keys, encode([t or "" for t in texts])):
                    ids = np.array([*ids, end_id], "<u4")
                    first = len(ids) % size or min(size, len(ids))
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
                        out.append((key, i, low, high - low, zlib.crc32(ids[low:high].tobytes())))
            if out:
                yield batch(_PIECES, *zip(*out))

    return run


def best_two_fit(lengths, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every length is between 1 and ``size``.

    Pieces of one length are interchangeable, so counts per length are packed: bit ``l`` of
    ``free`` says that a piece of length ``l`` is left, ``turned`` holds the same bits reversed, which finds
    two lengths of a given sum in one operation.
    """
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1).tolist()
    free = turned = 0
    for length, count in enumerate(left):
        if count:
            free |= 1 << length
            turned |= 1 << (size - length)

    def take(length: int) -> None:
        nonlocal free, turned
        left[length] -= 1
        if not left[length]:
            free &= ~(1 << length)
            turned &= ~(1 << (size - length))

    bins: list[list[int]] = []
    while free:
        own, gap = [], size
        while fitting := free & ((2 << gap) - 1):
            length = fitting.bit_length() - 1
            take(length)
            own.append(length)
            gap -= length
        if gap and len(own) > 1:
            smallest = own[-1]
            for total in range(gap + smallest, smallest, -1):
                # Bit a of the meeting: lengths a and total - a are both left.
                meeting = free & (turned >> (size - total)) & ((1 << total) - 1)
                if not total % 2 and left[total // 2] == 1:
                    meeting &= ~(1 << (total // 2))
                if meeting:
                    long = meeting.bit_length() - 1
                    take(long)
                    take(total - long)
                    own[-1:] = [long, total - long]
                    left[smallest] += 1
                    free |= 1 << smallest
                    turned |= 1 << (size - smallest)
                    break
        bins.append(own)
    # Deal the pieces to the places of their length.
    places: dict[int, list[tuple[int, int]]] = {}
    for k, own in enumerate(bins):
        offset = 0
        for length in own:
            places.setdefault(length, []).append((k, offset))
            offset += length
    which, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order[::-1]:
        which[i], offsets[i] = places[int(lengths[i])].pop()
    return which, offsets


def _pack_group(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        which, offsets = best_two_fit(frame["length"].to_numpy(), size)
        frame["sequence_id"] = frame["group"].to_numpy(np.int64) * (1 << 32) + which
        frame["offset"] = offsets
        return frame.drop(columns=["row", "group"])

    return run


def pack(docs: DataFrame, tokenizer: str, row: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0,
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: (row, piece, start, length, ids_crc32, sequence_id, offset).

    A document is the ids of its text and then ``end_id``; null and empty texts are the end id
    alone. Longer ones are cut into pieces of ``size``, the first one shorter. Rows that repeat are packed
    each; a null id is kept. ``added`` are the added tokens of a file of ranks, see ``encoder``. Other columns are ignored. No rows, no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(row).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(docs.mapInArrow(_pieces(tokenizer, added, size, end_id), "doc_id long, piece int, start long, length int, ids_crc32 long"), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    # Rows of the stored table are numbered by file and place, which is the same when a task runs again.
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    packed = pieces.groupBy("group").applyInPandas(
        _pack_group(size), "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
    return packed.select(F.col("doc_id").alias(row), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
