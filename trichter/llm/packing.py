"""Harmonic packing of token sequences with power-of-two classes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

_TASK_BITS = 36  # a task's sequence numbers stay below this many bits
_MEMO_WORDS = 400_000
_MEMO_SIGNS = 40  # longer words are found anew each time; with the number of words this bounds the memo's bytes
_SIGNS = ".,;:!?|*&%$#"
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SLICE_ROWS = 256


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """Cut documents into pieces and place each in a sequence of at most ``capacity`` token ids.

    Harmonic packing sorts lengths into classes of capacity 1/k and fills every bin of a class
    with exactly k items. Here pieces may be cut freely, so a document is cut by the binary
    digits of its length: whole sequences first, then at most one piece of each power of two.
    The classes are k = 1, 2, 4, ..., ``capacity`` and k pieces fill a bin without a gap. Every
    task fills its classes on its own, in one pass and without a shuffle. Pieces left over when
    a task ends (fewer than k in each class) form sequences whose lengths are powers of two, so
    no sequence needs padding.

    Returns one row per piece: the id, ``start`` (ids of the document before it), ``length``,
    ``ids`` (token ids as little-endian unsigned 32-bit numbers), ``doc_tokens`` (with the end
    id), ``sequence_id`` and ``offset`` in the sequence.

    Null and empty texts are a document of the end id alone. Rows are independent: repeated rows
    and null ids are packed like all others. Columns other than the two named are ignored. An
    empty table gives no rows. Memory: one slice of documents and at most one open bin per class;
    a very long text is tokenized as a whole. The memo of
    words holds short words only and is emptied when full, so text without spaces does not fill it. Sequence ids combine the number of the task with a
    running number, so a task that runs again after a lost executor gives the same ids.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    schema = StructType(
        [
            StructField(id_col, source.schema[id_col].dataType),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
            StructField("doc_tokens", LongType()),
            StructField("sequence_id", LongType()),
            StructField("offset", LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bins = ClassBins(capacity, (task.partitionId() if task else 0) << _TASK_BITS)
        tokens = WordTokens(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(first, _SLICE_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    bins.add(doc, tokens.of(text or "") + end)
                yield _rows(bins.filled(), kind)
        if kind is not None:
            bins.close()
            yield _rows(bins.filled(), kind)

    def _rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*pieces)) or [()] * 7
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

    return source.mapInArrow(run, schema)


def _byte_signs() -> dict[int, str]:
    """UTF-8 bytes of Latin letters beyond ASCII, each as the sign that byte-level models use for it:
    printable bytes stand for themselves, the others follow from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in sign):
        sign[b] = chr(256 + n)
    return {code: "".join(sign[b] for b in chr(code).encode()) for code in range(0x80, 0x180)}


_BYTES = _byte_signs()


class WordTokens(dict):
    """Token ids of words as packed bytes, found by the tokenizer when a word is first asked for.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids
    of a text are the ids of its words between white space, one after the other. It also
    lower-cases, and takes letters and other signs apart: a word of letters with signs behind it
    is looked up in two parts. Words of Latin letters need only the tokenizer's model, as such
    letters keep their normal form and lower case sign by sign, and the model sees their UTF-8
    bytes as printable signs; all others take the tokenizer's whole way.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._stems: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _ascii_split(text)))

    def __missing__(self, word: str) -> bytes:
        ids = self._found(word)
        if max(len(self), len(self._stems)) >= _MEMO_WORDS:
            self.clear()
            self._stems.clear()
        if len(word) <= _MEMO_SIGNS:
            self[word] = ids
        return ids

    def _found(self, word: str) -> bytes:
        letters = word.rstrip(_SIGNS)
        plain = letters.isascii()
        if not letters.isalpha() or not (plain or (max(letters) < "\u0180" and "\u0130" not in letters)):
            return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        lower = letters.lower() if plain else letters.lower().translate(_BYTES)
        ids = self._stems.get(lower)
        if ids is None:
            ids = array("I", [t.id for t in self._model.tokenize(lower)]).tobytes()
            if len(letters) <= _MEMO_SIGNS:
                self._stems[lower] = ids
        return ids + self[word[len(letters) :]] if len(letters) < len(word) else ids


def _ascii_split(text: str) -> list[str]:
    """Words between ASCII white space; ``str.split`` finds the same where no other white space occurs."""
    if _OTHER_SPACE.search(text) is None:
        return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


class ClassBins:
    """Open bins of one task, one per power-of-two class."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self._capacity = capacity
        self._next = first_sequence
        self._open: dict[int, list[tuple]] = {}
        self._filled: list[tuple] = []

    def add(self, doc: object, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        size = self._capacity
        while start < total:
            if total - start >= size:
                self._place(size, (doc, start, size, ids[4 * start : 4 * (start + size)], total))
                start += size
            else:
                size >>= 1

    def _place(self, size: int, piece: tuple) -> None:
        waiting = self._open.setdefault(size, [])
        waiting.append(piece)
        if len(waiting) * size == self._capacity:
            self._sequence(size, waiting)
            self._open[size] = []

    def _sequence(self, size: int, pieces: list[tuple]) -> None:
        self._filled += [(*piece, self._next, slot * size) for slot, piece in enumerate(pieces)]
        self._next += 1

    def close(self) -> None:
        """Turn what is left of each class into sequences of a power of two pieces."""
        for size, pieces in sorted(self._open.items(), reverse=True):
            while pieces:
                run = 1 << (len(pieces).bit_length() - 1)
                self._sequence(size, pieces[:run])
                pieces = pieces[run:]
        self._open = {}

    def filled(self) -> list[tuple]:
        done, self._filled = self._filled, []
        return done
