"""Packing of token sequences into windows of equal length by the sum-of-squares rule."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.textio import id_and_text, release
from veilframe.llm.tokens import encoded

#: Bits of a sequence id that number the sequences of one task.
_WINDOW_BITS = 36
#: Bytes of text that are decoded at once, and ids that are given out at once, or those of a window more.
_PORTION = 1 << 18


class SumOfSquaresPacker:
    """Online packing: each piece goes to the fill level that minimises the sum over levels h of count[h] squared.

    count[h] is the number of open windows filled up to h, for 0 < h < capacity (empty and full windows don't
    count). Moving one window from h to h + size changes the sum by 2 (count[h + size] - count[h]) + 2, opening
    one by 2 count[size] + 1, filling one up by 1 - 2 count[h]. Ties go to the fullest window.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, fill level before) for a piece of 1 to capacity tokens."""
        top = self.capacity - size
        left, right = self.count[: top + 1], self.count[size:]
        change = 2 * (right - left) + 2
        change[left == 0] = np.iinfo(np.int64).max
        change[top] = 1 - 2 * left[top] if left[top] else np.iinfo(np.int64).max
        change[0] = 0 if not top else 2 * right[0] + 1
        level = top - int(np.argmin(change[::-1]))
        if level:
            window = self.at[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            window = self.opened
            self.opened += 1
        if level + size < self.capacity:
            self.at[level + size].append(window)
            self.count[level + size] += 1
            self.n_open += 1
        return window, level

    def take_open(self) -> list[tuple[int, int]]:
        """(fill level, window) of all open windows, fullest first; the packer forgets them."""
        found = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.at[h]]
        self.at = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        self.n_open = 0
        return found

    def put_back(self, level: int, window: int) -> None:
        self.at[level].append(window)
        self.count[level] += 1
        self.n_open += 1


class WindowBuilder:
    """Keeps the pieces of open windows and gives them out as windows fill up.

    At most max_open windows are open. When there are more, and at the end, the finishing step levels them out, so
    that no window at all is left to be padded.
    """

    def __init__(self, capacity: int, max_open: int):
        self.packer, self.capacity, self.max_open = SumOfSquaresPacker(capacity), capacity, max_open
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id, ids: np.ndarray):
        """Closed windows as (window, pieces); a piece is (doc_id, start, ids, doc_tokens)."""
        total = len(ids)
        for start in range(0, total, self.capacity):
            piece = ids[start : start + self.capacity]
            if start and len(piece) < self.capacity:
                piece = piece.copy()
            window, level = self.packer.place(len(piece))
            held = self.open.setdefault(window, [])
            held.append((doc_id, start, piece, total))
            if level + len(piece) == self.capacity:
                yield window, self.open.pop(window)
        if self.packer.n_open > self.max_open:
            yield from self.level_out(False)

    def level_out(self, last: bool):
        """The finishing step, which is not the sum-of-squares rule: pieces of the emptiest windows, cut where needed, fill
        the gaps of the fullest. At the end what one window holds then goes into sequences whose lengths are powers
        of two, its own first, which need no padding."""
        levels = self.packer.take_open()
        low, high = 0, len(levels) - 1
        fill = [h for h, _ in levels]
        while low < high:
            gap, giver = self.capacity - fill[low], self.open[levels[high][1]]
            doc_id, start, piece, total = giver.pop()
            if len(piece) > gap:
                giver.append((doc_id, start, piece[:-gap], total))
                start, piece = start + len(piece) - gap, piece[-gap:]
            self.open[levels[low][1]].append((doc_id, start, piece, total))
            fill[low] += len(piece)
            fill[high] -= len(piece)
            if not fill[high]:
                del self.open[levels[high][1]]
                high -= 1
            if fill[low] == self.capacity:
                yield levels[low][1], self.open.pop(levels[low][1])
                low += 1
        for k in range(low, high + 1):
            window = levels[k][1]
            if fill[k] == self.capacity:
                yield window, self.open.pop(window)
            elif last:
                yield from self.in_powers(window, self.open.pop(window), fill[k])
            else:
                self.packer.put_back(fill[k], window)

    def in_powers(self, window: int, pieces: list[tuple], size: int):
        """The pieces as sequences whose lengths are the powers of two that make up their size."""
        for bit in reversed(range(size.bit_length())):
            room, own = size & (1 << bit), []
            while room:
                doc_id, start, piece, total = pieces.pop(0)
                if len(piece) > room:
                    pieces.insert(0, (doc_id, start + room, piece[room:], total))
                    piece = piece[:room]
                own.append((doc_id, start, piece, total))
                room -= len(piece)
            if own:
                yield window, own
                window = self.packer.opened
                self.packer.opened += 1


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """Packs all documents into windows of `capacity` tokens; where group_col names a column, each window holds documents
    of one of its values (null is one) alone.

    One row per piece: doc_id, start (the document's ids before it), length, ids (binary, little-endian uint32),
    doc_tokens, sequence_id, offset (in the window, gapless from 0). A document is its ids and then end_id;
    whole windows are cut off long documents, the rest is placed by the sum-of-squares rule. Each task packs its
    own input in one narrow pass without a shuffle and holds max_open open windows at most, and one more for each group.
    When there are more, and at the end, a finishing step takes the place of the rule: see WindowBuilder. Every sequence
    is full but the last ones of a task and group, whose lengths are powers of two. Null and empty texts are end_id alone; repeated rows are packed
    each on its own (by doc_id they can't be told apart); levels that tie go to the fullest window; ids may be of any
    type and null; an empty table gives no piece; other columns are ignored.
    """
    source = id_and_text(docs, id_col, text_col)
    if group_col is not None:
        source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.col(group_col).cast("string").alias("group"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        builders: dict[str | None, WindowBuilder] = {}
        base, numbers = TaskContext.get().partitionId() << _WINDOW_BITS, itertools.count()
        rows: list[tuple] = []
        held, arrow_kind = 0, pa.null()

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = [arrow_kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def write(closed):
            nonlocal rows, held
            for _, pieces in closed:  # closed once each; windows of different groups have numbers of their own
                sequence, offset = base + next(numbers), 0
                for doc_id, start, ids, total in pieces:
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                    offset += len(ids)
                held += offset
                if held > _PORTION:  # the finishing step closes thousands of windows at once
                    yield flush()
                    rows, held = [], 0

        for batch in batches:
            doc_ids, arrow_kind = batch.column(0).to_pylist(), batch.column(0).type
            groups = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for row, ids in encoded(batch.column(1), tokenizer, _PORTION):
                group = groups[row] if groups else None
                if group not in builders:
                    builders[group] = WindowBuilder(capacity, max_open)
                yield from write(builders[group].add(doc_ids[row], np.append(ids, np.uint32(end_id)).astype(np.uint32)))
                if len(builders) > 1 and sum(b.packer.n_open for b in builders.values()) > max_open + len(builders):
                    yield from write(max(builders.values(), key=lambda b: b.packer.n_open).level_out(False))
        for builder in builders.values():
            yield from write(builder.level_out(True))
        if rows:
            yield flush()
        rows = batch = None
        release()

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long")
