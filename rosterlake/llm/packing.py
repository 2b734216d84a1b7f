"""Vector bin packing of examples into training sequences.

An example is a vector (tokens, segments = 1, loss-bearing tokens); a sequence
is a bin with a limit in each of the three. A bin takes, again and again, the
example that fits and has the largest dot product with the room left, each
dimension weighed by the mean demand over its limit.

Documents may be cut: every token bears loss there, and when no example fits,
the one of largest dot product is cut to fill the bin. What can't fill a whole
bin at the end of a task goes into bins whose size is a power of two, which
need no padding. Instruction examples stay whole (``cut=False``).

Each task packs its own input partition, holding at most ``HOLD_TOKENS``
tokens; a sequence never crosses tasks, so a lost executor only repeats its
own partitions and no shuffle is needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rosterlake.llm.common import row_chunks, text_bytes
from rosterlake.llm.tokens import encoder

HOLD_TOKENS = 4 << 20
#: Tokens of a batch that is given out, at about which its sequences end.
EMIT_TOKENS = 1 << 18
SEQUENCE_BITS = 33

PIECES = ("doc_id {id}, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


class VectorBins:
    """Examples waiting for a bin, grouped by equal vectors."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool) -> None:
        self.limits, self.cut = (tokens, segments, loss), cut
        self.groups: dict[tuple[int, int], list] = {}
        self.index: dict[tuple[int, int], int] = {}
        self.tokens, self.loss, self.count = (np.zeros(256, np.int64) for _ in range(3))
        self.total = 0

    def add(self, item, tokens: int, loss: int) -> None:
        """``item`` is any handle; with ``cut`` a tuple (example, start)."""
        key = (tokens, loss)
        k = self.index.setdefault(key, len(self.index))
        if k == len(self.count):
            self.tokens, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.count))
        self.tokens[k], self.loss[k] = key
        self.count[k] += 1
        self.groups.setdefault(key, []).append(item)
        self.total += tokens

    def _take(self, k: int):
        t, loss = int(self.tokens[k]), int(self.loss[k])
        self.count[k] -= 1
        self.total -= t
        return self.groups[(t, loss)].pop(), t, loss

    def weights(self) -> tuple[float, float, float]:
        """Mean demand over limit, in each dimension."""
        n = max(1, int(self.count.sum()))
        return (float(self.count @ self.tokens) / n / self.limits[0], 1 / self.limits[1], float(self.count @ self.loss) / n / self.limits[2])

    def fill(self, size: int, weights: tuple[float, float, float]) -> list[tuple]:
        """One bin of at most ``size`` tokens: (item, length) in order. With
        ``cut`` its length is ``size``, or a power of two where the segment
        limit or the examples run out before."""
        n = len(self.index)
        tokens, loss, count = self.tokens[:n], self.loss[:n], self.count[:n]
        room, slots, room_loss = size, self.limits[1], self.limits[2]
        by_tokens, _, by_loss = (w / limit for w, limit in zip(weights, self.limits, strict=True))
        out: list[tuple] = []
        while room > 0 and slots > 0:
            # The segment dimension adds the same to every example's product.
            score = np.where(count > 0, tokens * (by_tokens * room) + loss * (by_loss * room_loss), -1.0)
            fits = (tokens <= room) & (loss <= room_loss)
            if self.cut and slots == 1:
                # The last segment ends the bin: take what fills it, or cut.
                enough = (tokens >= room) & (count > 0)
                fits = fits & enough if enough.any() else fits
            best = np.where(fits, score, -1.0)
            k = int(best.argmax())
            if best[k] >= 0:
                item, t, used_loss = self._take(k)
            elif self.cut and score.max() >= 0:
                used = min(room, room_loss)
                if used <= 0:
                    break
                (example, start), t, _ = self._take(int(score.argmax()))
                self.add((example, start + used), t - used, t - used)
                n = len(self.index)
                tokens, loss, count = self.tokens[:n], self.loss[:n], self.count[:n]
                item, t, used_loss = (example, start), used, used
            else:
                break
            out.append((item, t))
            room, slots, room_loss = room - t, slots - 1, room_loss - used_loss
        filled = sum(t for _, t in out)
        if self.cut and 0 < filled < size:
            extra = filled - (1 << (filled.bit_length() - 1))
            while extra:
                (example, start), t = out.pop()
                back = min(t, extra)
                self.add((example, start + t - back), back, back)
                if t > back:
                    out.append(((example, start), t - back))
                extra -= back
        return out

    def bins(self, tokens: int, last: bool) -> Iterator[list[tuple]]:
        """Full bins while the examples last; then, if ``last``, the rest."""
        weights = self.weights()
        while self.total >= tokens or (last and self.count.any()):
            size = tokens
            if self.cut and self.total < tokens:
                size = 1 << (self.total.bit_length() - 1)
            found = self.fill(size, weights)
            if not found:
                raise ValueError("an example exceeds the limits of a sequence")
            yield found


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], end_id: int = 1, tokens: int = 2048,
                   segments: int = 128, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole documents, cut and packed; a row per piece.

    ``tokenizer()`` gives the vocabulary file's path on the machine where it
    is called. A null text is empty (its end id alone); null or repeated
    ``id_col`` values are kept, each row being a document of its own. Other
    columns are not read. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    if tokens & (tokens - 1):
        raise ValueError("the sequence length is a power of two")
    loss = tokens if loss is None else loss
    id_type = docs.schema[id_col].dataType
    schema = PIECES.format(id=id_type.simpleString())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer(), lower=True)
        waiting = VectorBins(tokens, segments, loss, cut=True)
        full = min(tokens, loss)
        held: dict[int, tuple] = {}
        left: dict[int, int] = {}
        state = {"example": 0, "sequence": TaskContext.get().partitionId() << SEQUENCE_BITS, "ready": 0}
        ready: list[list[tuple]] = []

        def emit(id_kind: pa.DataType) -> pa.RecordBatch:
            cols = defaultdict(list)
            for one in ready:
                offset = 0
                for (example, start), t in one:
                    doc, ids, before, whole_doc = held[example]
                    for k, v in (("doc_id", doc), ("start", before + start), ("length", t), ("ids", ids[4 * start : 4 * (start + t)]),
                                 ("doc_tokens", whole_doc), ("sequence_id", state["sequence"]), ("offset", offset)):
                        cols[k].append(v)
                    offset += t
                    left[example] -= t
                    if not left[example]:
                        del left[example], held[example]
                state["sequence"] += 1
            ready.clear()
            kinds = [id_kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(cols[n], k) for n, k in zip(names, kinds, strict=True)], names)

        def give(found: Iterable[list[tuple]], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            """Batches of the waiting and these sequences; few may wait on."""
            for one in found:
                ready.append(one)
                state["ready"] += sum(t for _, t in one)
                if state["ready"] >= EMIT_TOKENS:
                    yield emit(id_kind)
                    state["ready"] = 0

        id_kind = pa.int64()
        for b in batches:
            ids_in, texts = b.column(0), b.column(1)
            id_kind = ids_in.type
            data, at = text_bytes(texts)
            for i, j in row_chunks(at):
                flat, sizes = pieces.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                raw, stops, whole = flat.astype("<u4").tobytes(), np.cumsum(sizes), []
                for r, size, stop in zip(range(i, j), sizes.tolist(), stops.tolist(), strict=True):
                    ids = raw[4 * (stop - size) : 4 * stop] + end
                    n, doc = size + 1, ids_in[r].as_py()
                    for s in range(0, n, full):
                        t, d = min(full, n - s), state["example"]
                        state["example"] += 1
                        held[d], left[d] = (doc, ids[4 * s : 4 * (s + t)], s, n), t
                        if t == tokens:
                            whole.append([((d, 0), t)])
                        else:
                            waiting.add((d, 0), t, t)
                yield from give(whole, id_kind)
                if waiting.total >= HOLD_TOKENS:
                    yield from give(waiting.bins(tokens, last=False), id_kind)
        yield from give(waiting.bins(tokens, last=True), id_kind)
        if ready:
            yield emit(id_kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, tokens: int, segments: int, loss: int, id_col: str = "id",
                  tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """Whole instruction examples into bins under the three limits at once.

    Returns (id, sequence_id, offset, n_tokens, n_loss). A null count is zero;
    an example over a limit raises ValueError, since none may be dropped.
    """
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = VectorBins(tokens, segments, loss, cut=False)
        sequence, id_kind = TaskContext.get().partitionId() << SEQUENCE_BITS, pa.int64()

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for one in waiting.bins(tokens, last):
                offset = 0
                for (key, n_loss), t in one:
                    rows.append((key, sequence, offset, t, n_loss))
                    offset += t
                sequence += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [id_kind, *[pa.int64()] * 4], strict=True)],
                                              ["id", "sequence_id", "offset", "n_tokens", "n_loss"])

        for b in batches:
            id_kind = b.column(0).type
            for key, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                waiting.add((key, n or 0), t or 0, n or 0)
            if waiting.total >= HOLD_TOKENS:
                yield emit(last=False)
        yield emit(last=True)

    return examples.select(id_col, tokens_col, loss_col).mapInArrow(
        run, f"id {kind}, sequence_id long, offset long, n_tokens long, n_loss long")
