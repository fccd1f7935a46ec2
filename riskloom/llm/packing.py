"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising runs in Arrow batches, by ranks of the same vocabulary (tests hold the ids against the
tokenizers library on its own file). Its word pattern looks ahead at white space, which is slow and only
matters where two white spaces meet; text between such places goes through the pattern without it.

Packing is bounded-space online best-fit: a task streams its pieces into at most OPEN_BINS open bins. A
bit set holds which amounts of free space occur among them, so the best fit is the lowest bit at or above
the piece's length. When all bins are open and none fits, the fullest closes. Pieces are dealt to tasks by
hash, about PIECES_PER_TASK to each. Bins left short then go through the same packing as whole units, so
the number of tasks costs next to no sequences.
"""

from __future__ import annotations

import base64
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, written

SEQUENCE = 2048
END_ID = 0
OPEN_BINS = 4096
PIECES_PER_TASK = 200_000

#: White space as the tokenizer's pattern sees it; where two or more meet, its look-ahead matters.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"([{SPACE}]{{2,}})")
#: The tokenizer's own word pattern for text in which no two white spaces meet: without the look-ahead.
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


# Tokens the vocabulary's file adds to its ranks; written out in a text, they are themselves.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Text to ids of a byte-level BPE vocabulary given as ranks; `pattern` is the tokenizer's word split."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        made = [tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (SINGLE, pattern)]
        self.single, self.whole = made[0].encode_ordinary, made[1].encode_ordinary
        self.special = special
        longest_first = sorted(special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None

    def ids(self, text: str) -> list[int]:
        """Ids of a text; special tokens are cut out first, and what stands between them is encoded on its own."""
        if self.marks is None:
            return self.plain(text)
        first, *rest = self.marks.split(text)
        ids = self.plain(first)
        for mark, after in zip(rest[::2], rest[1::2], strict=True):
            ids.append(self.special[mark])
            ids += self.plain(after)
        return ids

    def plain(self, text: str) -> list[int]:
        """The pattern keeps all but the last character of a run of white space as one word; the last goes with what follows."""
        first, *rest = RUNS.split(text)
        ids = self.single(first)
        for run, after in zip(rest[::2], rest[1::2], strict=True):
            head = run[:-1] if after else run
            ids += self.whole(head)
            ids += self.single(run[len(head) :] + after)
        return ids


ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, special: dict[str, int]) -> Encoder:
    """One encoder for each worker process."""
    key = (ranks_path, *special.items())
    if key not in ENCODERS:
        import public_tokenizers

        ENCODERS[key] = Encoder(ranks_path, public_tokenizers.PATTERN, special)
    return ENCODERS[key]


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only what is longer than `size` is cut, and the first piece takes the rest."""
    head = total % size or size
    return [(0, min(total, head))] + [(at, size) for at in range(head, total, size)]


def token_pieces(
    docs: DataFrame, ranks_path: str, size: int = SEQUENCE, with_ids: bool = False, special: dict[str, int] = SPECIAL
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text, each closed by END_ID.

    A null text counts as empty and is one piece holding END_ID alone. A special token written out in a text
    is that token, as in the tokenizers library; with `special` empty it is ordinary text. `ids` are little-endian unsigned 32-bit numbers.
    """

    def cut(batch: pa.RecordBatch):
        encode = encoder(ranks_path, special).ids
        rows = ([], [], [], [], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = array("I", encode(text) if text else [])
            ids.append(END_ID)
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
            for n, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                own = ids[4 * start : 4 * (start + length)]
                for to, value in zip(rows, (doc, n, start, length, zlib.crc32(own), own), strict=True):
                    to.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        keep = 6 if with_ids else 5
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows[:keep], kinds, strict=False)], names=names[:keep])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(source, cut, schema)


class Bins:
    """Open bins in stacks by free space; bit f of `free` is set when some open bin has f left."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.free, self.open, self.made = size, limit, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def take(self, space: int) -> int:
        stack = self.stacks[space]
        name = stack.pop()
        if not stack:
            self.free ^= 1 << space
        self.open -= 1
        return name

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the tightest open bin, else a new one."""
        fitting = self.free >> length << length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1
            name = self.take(space)
        else:
            if self.open >= self.limit:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            name, space = self.made, self.size
            self.made += 1
        left = space - length
        if left:
            if not self.stacks[left]:
                self.free |= 1 << left
            self.stacks[left].append(name)
            self.open += 1
        return name, space


def packed(units: DataFrame, size: int, limit: int, per_task: int) -> DataFrame:
    """(unit, length) -> (unit, bin, at); at = tokens of the bin before the unit, bins numbered apart in each task.

    A task takes its units in blocks of `limit`, the longest of a block first, so that short ones fill what
    the long ones leave. The order is the same when a task is run again.
    """
    rows = units.count()
    tasks, blocks = max(1, math.ceil(rows / per_task)), max(1, min(rows, per_task) // limit)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(size, limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([size - s for _, s in placed], pa.int64())],
                names=["unit", "bin", "at"],
            )

    block = F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(blocks))
    ordered = (
        units.select("unit", "length")
        .repartition(tasks, F.xxhash64("unit"))
        .sortWithinPartitions(block, F.desc("length"), "unit")
    )
    return ordered.mapInArrow(pack, "unit long, bin long, at long")


def pack_pieces(
    pieces: DataFrame, size: int = SEQUENCE, limit: int = OPEN_BINS, per_task: int = PIECES_PER_TASK, levels: int = 3
) -> DataFrame:
    """Adds sequence_id and offset to pieces (length at most `size`), using few sequences.

    Level one packs pieces. Each further level takes the bins that still have room, as units, and packs
    them among one another; it ends early when one task saw them all.
    """
    named = written(pieces.withColumn("unit", F.monotonically_increasing_id()), "pack-pieces")
    units, placed = named.select("unit", "length"), None
    for level in range(levels):
        step = written(packed(units, size, limit, per_task), "pack-bins")
        tag = F.lit(level + 1) * F.lit(1 << 58)
        step = step.withColumn("bin", F.col("bin") + tag)
        if placed is None:
            placed = step.select("unit", "bin", "at")
        else:
            moved = step.select(F.col("unit").alias("bin"), F.col("bin").alias("into"), F.col("at").alias("shift"))
            placed = placed.join(moved, "bin", "left").select(
                "unit", F.coalesce("into", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at")
            )
        placed = written(placed, "pack-placed")
        if units.count() <= per_task:
            break
        fill = placed.join(named.select("unit", "length"), "unit").groupBy("bin").agg(F.sum("length").alias("length"))
        units = written(fill.filter(F.col("length") < size).select(F.col("bin").alias("unit"), "length"), "pack-short")
    return named.join(placed, "unit").select(
        *[c for c in named.columns if c != "unit"], F.col("bin").alias("sequence_id"), F.col("at").alias("offset")
    )


def pack_documents(
    docs: DataFrame, ranks_path: str, size: int = SEQUENCE, with_ids: bool = False, special: dict[str, int] = SPECIAL
) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A null text is empty: one piece, the end id. Repeated rows are packed as often as they occur. A row
    without doc_id is packed under a null doc_id. An empty table gives no rows; extra columns are ignored.
    """
    return pack_pieces(token_pieces(docs, ranks_path, size, with_ids, special), size)
