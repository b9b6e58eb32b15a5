"""Best-fit packing of token sequences into sequences of a fixed length.

Bounded-space online best-fit: each task keeps a fixed number of open bins, listed by their free space; one bit of an
integer for each free space says if such a bin is open, so the fullest bin with enough room is found by a shift and a
lowest set bit. When too many bins are open, the fullest closes first.

``cut`` makes the pieces with their ids, ``pack`` gives each its place (moving the ids once, by a join), ``sequences`` puts
the ids of each sequence together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _scratch, _text, _tokens


def cut(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole text: row, doc_id, piece, start, length, ids.

    Only longer texts are cut. Null text is the empty text, one piece with the end id. Rows of one id are each cut by
    themselves and told apart by ``row``. Other columns are not read.
    """
    tokenizer = tokenizer or _tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for part in _text.slices(batches, most=5 << 20):
            ids, bounds = _tokens.encode(part.column("text"), tokenizer, end_id)
            sizes = np.diff(bounds)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            # The pieces follow each other without gaps, so their lengths are the lists' offsets.
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + row), part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)))],
                ["row", "doc_id", "piece", "start", "length", "ids"],
            )
            first += part.num_rows

    rows = _text.bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, f"row long, doc_id {kind}, piece int, start long, length long, ids array<int>")


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, packed in the order given with at most ``open_bins`` open at once."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count, opened = 0, 0, 0
    place, offset = [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            k = bins[free].pop()
            if not bins[free]:
                mask ^= 1 << free
            opened -= 1
        else:
            k, free = count, capacity
            count += 1
        place.append(k)
        offset.append(capacity - free)
        if free > n:
            bins[free - n].append(k)
            mask |= 1 << (free - n)
            opened += 1
            if opened > open_bins:  # the fullest closes
                low = (mask & -mask).bit_length() - 1
                bins[low].pop()
                if not bins[low]:
                    mask ^= 1 << low
                opened -= 1
    return place, offset


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 8192, pieces_a_task: int = 1 << 17) -> DataFrame:
    """Add sequence_id and offset to pieces with ``row``, ``piece`` and a ``length`` from 1 to ``capacity``.

    The pieces are first written to the shared folder, so that a task that runs again packs the same rows. Each task
    takes about ``pieces_a_task`` lengths, longest first (so short ones fill the gaps), and packs them by itself: the
    bins that a task leaves part-filled are few against that many pieces. Its sequences are gapless from offset 0. All
    other columns, the ids too, only meet the places.
    """
    staged = _scratch.stage(pieces, "pieces")
    tasks = max(1, -(-staged.count() // pieces_a_task))
    names = ["row", "piece", "length"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # about pieces_a_task rows of three numbers
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        place, offset = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        ids = np.array(place, dtype=np.int64) + (TaskContext.get().partitionId() << 40)
        yield from table.drop_columns("length").append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64())).to_batches()

    light = staged.select(*names).repartition(tasks).sortWithinPartitions(F.desc("length"), "row", "piece")
    # Stored, as a task that ran again after a loss would deal the pieces out anew.
    places = _scratch.stage(light.mapInArrow(fill, "row long, piece int, sequence_id long, offset long"), "places")
    return staged.join(places, ["row", "piece"])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the documents (doc_id, piece, offset) of each sequence, in its order.

    A group is a sequence, so none has more than its capacity of ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return rows.select("sequence_id", "n_tokens", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("documents"))
