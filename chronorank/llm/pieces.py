"""SentencePiece encoding and decoding as shortest paths of a weighted transducer."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chronorank.llm.common import released

#: What escapes a blank in pieces.
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Remembered paths of parts of a text, and joints of pieces, in a task.
MEMORY, JOINTS = 60_000, 500_000
#: Bytes of texts that a task encodes at a time, and characters of a longer text.
STEP = 1 << 19
#: Parts below this length are remembered.
WORD = 64
#: Most kinds of characters that the table of neighbours tells apart; kinds that share a number share their neighbours.
CHARACTERS = 2_048
#: Largest model file that is sent to the tasks.
MODEL_BYTES = 32 << 20


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file from any store that Spark reads; refuses files above ``MODEL_BYTES``."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg({"length": "sum"}).first()[0] or 0
    if not 0 < size <= MODEL_BYTES:
        raise ValueError(f"a model file of 1 to {MODEL_BYTES} bytes is wanted, not {size}")
    return files.select("content").first()[0]


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            yield tag >> 3, data[at : at + 8]
            at += 8


class Remembered(dict):
    """Ids of the parts that came last, written when they are first asked for; as many older ones are kept beside it."""

    def __init__(self, pieces: PieceTransducer) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> bytes:
        pieces = self.pieces
        out = pieces.older.get(part)
        if out is None:
            out = pieces._path_ids(part)
        if len(part) < WORD:
            if len(self) >= MEMORY:
                pieces.older = dict(self)
                self.clear()
            self[part] = out
        return out


class PieceTransducer:
    """Normaliser, pieces and byte fallback of a model, compiled once and composed with each text.

    States are places of the normalised text; an arc reads a piece, or one
    character that no piece has, and writes its id or the ids of its bytes.
    With a unigram model an arc weighs the negative score of its piece.  With a
    merge (BPE) model all arcs weigh 0 and so does the joint of two arcs that the
    merges leave apart; any other joint has infinite weight.  Since every part of
    a merged text is merged in itself, the path of weight 0 is unique and is
    the result of the merges.  Either way the tropical shortest path is found
    from left to right: at weights, keeping the best arc into each place; at weight 0, by following arcs
    of that weight.
    """

    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.model_type, self.prefix, self.escape = UNIGRAM, True, True
        for name, value in _fields(model):
            if name == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif name == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif name == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only normalisers without a character map that keep all blanks are compiled")
                self.prefix, self.escape = bool(rules.get(3, 1)), bool(rules.get(5, 1))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.longest = max(map(len, self.ids), default=1)
        # by the next character: the piece that ends with it, if any, and what reads on
        self.arcs: dict[str, list] = {}
        for piece in self.ids:
            arcs = self.arcs
            for c in piece[:-1]:
                arc = arcs.setdefault(c, ["", None])
                if arc[1] is None:
                    arc[1] = {}
                arcs = arc[1]
            arcs.setdefault(piece[-1], ["", None])[0] = piece
        # no piece joins two characters that none has side by side: paths of the parts between them are independent
        pairs = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        joined = sorted({c for pair in pairs for c in pair})
        self.characters = np.zeros(0x110000, np.uint16)
        self.characters[[ord(c) for c in joined]] = np.arange(len(joined)) % (CHARACTERS - 1) + 1
        self.neighbours = np.zeros((CHARACTERS, CHARACTERS), bool)
        for left, right in pairs:
            self.neighbours[self.characters[ord(left)], self.characters[ord(right)]] = True
        self.shorter: dict[str, str] = {}
        self.joints: dict[str, dict[str, bool]] = {}
        self.n_joints = 0
        raw = [b"" if k == CONTROL else t.encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        for byte, i in self.bytes.items():
            raw[i] = bytes([byte])
        self.raw = pa.array(raw, pa.large_binary())
        self.memory = Remembered(self)
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", BLANK) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """Merges of neighbours, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _joint(self, left: str, right: str) -> bool:
        """Whether the merges leave these two pieces apart: weight 0, else infinite."""
        if self.n_joints >= JOINTS:
            self.joints.clear()
            self.n_joints = 0
        self.n_joints += 1
        apart = self.merged(left + right) == ([left, right] if left else [right])
        self.joints.setdefault(left, {})[right] = apart
        return apart

    def shortest_path(self, text: str) -> list[str]:
        """Pieces, and characters that no piece has, along the shortest path."""
        return self._merge_path(text) if self.model_type == BPE else self._score_path(text)

    def _merge_path(self, text: str) -> list[str]:
        """The path of weight 0, longest arcs first.

        A place is reached by one such path at most, as what leads there are the
        merges of the text before it.  So a place that nothing goes on from is
        left for good, and every place is tried once.
        """
        arcs, joints, joint, shorter = self.arcs, self.joints, self._joint, self.shorter
        longest, size = self.longest, len(text)
        path: list[str] = []
        left_for_good: set[int] = set()
        at, last, known = 0, "", joints.get("")
        while at < size:
            # the longest piece that reads on from here
            piece, reads = text[at], arcs
            for c in text[at : at + longest]:
                arc = reads.get(c)
                if arc is None:
                    break
                found, reads = arc
                if found:
                    piece = found
                if reads is None:
                    break
            while True:
                if not left_for_good or at + len(piece) not in left_for_good:
                    apart = known.get(piece) if known else None
                    if apart is None:
                        apart = joint(last, piece)
                    if apart:
                        break
                piece = shorter.get(piece) or self._shorter(piece)
                while not piece:
                    left_for_good.add(at)
                    if not path:
                        # equal scores (runs of blanks) can leave no path of weight 0
                        return self.merged(text)
                    piece = path.pop()
                    at -= len(piece)
                    last = path[-1] if path else ""
                    known = joints.get(last)
                    piece = self._shorter(piece)
            path.append(piece)
            at += len(piece)
            last, known = piece, joints.get(piece)
        return path

    def _shorter(self, piece: str) -> str:
        """The next shorter arc that reads the start of what ``piece`` reads."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids), "")
            self.shorter[piece] = found
        return found

    @staticmethod
    def _back(into: list[str | None]) -> list[str]:
        at, path = len(into) - 1, []
        while at:
            path.append(into[at])
            at -= len(into[at])
        return path[::-1]

    def _score_path(self, text: str) -> list[str]:
        lowest = min(self.scores, default=0.0) - 10.0
        best, into = [0.0], [None]
        for end in range(1, len(text) + 1):
            cost, found = float("inf"), None
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                known = self.ids.get(piece)
                if known is None and end - start > 1:
                    continue
                here = best[start] - (lowest if known is None else self.scores[known])
                if here < cost:
                    cost, found = here, piece
            best.append(cost)
            into.append(found)
        return self._back(into)

    def _path_ids(self, part: str) -> bytes:
        path = self.shortest_path(part)
        try:
            return array("i", map(self.ids.__getitem__, path)).tobytes()
        except KeyError:
            pass
        out = array("i")
        for piece in path:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _starts(self, text: str) -> np.ndarray:
        """Whether a part of ``text`` starts at each of its characters."""
        found = self.characters[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int32)
        starts = np.ones(len(text), bool)
        np.logical_not(self.neighbours.ravel()[found[:-1] * CHARACTERS + found[1:]], out=starts[1:])
        return starts

    def _part_ids(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and how many of them each of its parts has; equal parts are looked up once."""
        data = text.encode()
        places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        ends = pa.py_buffer(np.r_[places, len(data)].astype(np.int32))
        parts = pa.StringArray.from_buffers(len(places), ends, pa.py_buffer(data)).dictionary_encode()
        ids = list(map(self.memory.__getitem__, parts.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))
        return lists.take(parts.indices).flatten().to_numpy(), sizes[parts.indices.to_numpy()]

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of texts.

        What is long is read in steps that end where a part starts.
        """
        texts = [self.normalise(text or "") for text in texts]
        ends = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        flat, sizes, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at, step = 0, STEP
        while at < len(whole):
            text = whole[at : at + step]
            starts = self._starts(text)
            first, last = np.searchsorted(ends, [at, at + len(text)])
            starts[ends[first:last] - at] = True
            if at + len(text) < len(whole):
                cut = len(text) - 1 - int(starts[::-1].argmax())
                if not cut:
                    # one part is longer than the step
                    step *= 2
                    continue
                text, starts = text[:cut], starts[:cut]
            ids, size = self._part_ids(text, starts)
            flat.append(ids)
            sizes.append(size)
            places.append(np.flatnonzero(starts) + at)
            at, step = at + len(text), STEP
        counts = np.r_[0, np.cumsum(np.concatenate(sizes))]
        ends = counts[np.searchsorted(np.concatenate(places), ends)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))

    def encode(self, text: str | None) -> array:
        return array("i", self.encode_all([text]).flatten().to_numpy().tobytes())

    def decode(self, ids: pa.ListArray) -> list[str]:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing.

        Taken pieces stand one after another in memory, so a text is a slice of it.
        """
        taken = self.raw.take(ids.flatten())
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
        # a null list may hold values that flatten leaves out
        sizes = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy()), 0)
        at = ends[np.r_[0, np.cumsum(sizes)]].tolist()
        texts = [str(data[start:end], "utf-8", "replace") for start, end in zip(at, at[1:], strict=False)]
        if self.escape:
            texts = [text.replace(BLANK, " ") for text in texts]
        return [text.removeprefix(" ") for text in texts] if self.prefix else texts


@lru_cache(2)
def compiled(model: bytes) -> PieceTransducer:
    """One transducer for all tasks of a Python worker, with what it remembers."""
    return PieceTransducer(model)


def encode(df: DataFrame, model: bytes, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of the whole of column ``text`` in a new column ``out``; a null text has none.

    With ``decoded``, a column of that name has what the ids decode to, from the
    same pass.  Rows stay where they are.  Columns of the new names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(model)
        for batch in released(batches):
            for rows in _steps(batch, text):
                ids = pieces.encode_all(rows.column(text).to_pylist())
                rows = _with(rows, out, ids)
                yield _with(rows, decoded, pa.array(pieces.decode(ids), pa.string())) if decoded else rows

    schema = _extended(df.schema, out, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, _extended(schema, decoded, T.StringType()) if decoded else schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of column ``ids`` in a new column ``out``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(model)
        for batch in released(batches):
            yield _with(batch, out, pa.array(pieces.decode(batch.column(ids)), pa.string()))

    return df.mapInArrow(run, _extended(df.schema, out, T.StringType()))


def _steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``STEP`` bytes of texts, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    step = (np.cumsum(sizes) - sizes) // STEP
    cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], [*names, name])


def _extended(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])
