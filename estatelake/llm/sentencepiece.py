"""Encoding and decoding with a SentencePiece model of merge type.

The encoder does not replay merges over a text. It takes the longest piece at each position (found with an Aho-Corasick
automaton), accepts it only if it is compatible with the piece before it (merging the characters of the two together has to
give exactly these two pieces), and otherwise goes back to a shorter piece or a shorter past. A bitfield marks positions from
which no way on was left, so each is entered once. A sequence whose pieces are each whole under merging and whose neighbours
are compatible is the merge result, hence the output equals the library's.

Merges never cross into the start of a run of blanks when no piece has a blank after another character, so a text is cut there
and repeated short words are encoded once per task (a memory of bounded size).
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

BLANK = "▁"
MEMORY_WORDS = 200_000
MEMORY_PAIRS = 250_000
MEMORY_CHARS = 48

# Kinds of pieces in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of one message of the model file."""
    at = 0

    def varint() -> int:
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
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


class Pieces:
    """The pieces of a model file: texts, scores and kinds by id. Refuses models whose rules this encoder does not follow."""

    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.unknown_surface = " ⁇ "
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode("utf-8"))
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
                    raise ValueError("the model is not of merge type with byte fallback and blanks as prefixes")
                self.unknown_surface = trainer.get(44, self.unknown_surface.encode()).decode("utf-8")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model normalises texts; only models that keep them as they are can be used")
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.byte_ids = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}


class Encoder:
    def __init__(self, pieces: Pieces) -> None:
        import ahocorasick

        self.pieces = pieces
        self.ids, self.scores = pieces.ids, pieces.scores
        self.costs = {t: -self.scores[i] for t, i in self.ids.items()}
        self.sizes = [len(t) for t in pieces.texts]
        self.finder = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.finder.add_word(text, (len(text) - 1, i))
        self.finder.make_automaton()
        # The longest piece that is a proper prefix of each piece.
        self.shorter = [-1] * len(pieces.texts)
        for text, i in self.ids.items():
            self.shorter[i] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
        self.characters = {t for t in self.ids if len(t) == 1}
        # Two characters that stand together in no piece are never merged, so a text may be cut between them.
        self.together = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.cuts = not any(BLANK in t.lstrip(BLANK) for t in self.ids)
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.pairs: dict[int, bool] = {}
        # Packed ids of words: those met lately, and those of the time before, which are forgotten next.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, ties from the left. Characters without a piece stay."""
        parts: list[str | None] = list(text)
        n, costs = len(parts), self.costs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(cost, i, i + 1, whole) for i in range(n - 1) if (cost := costs.get(whole := text[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, left, right, whole = heapq.heappop(queue)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != whole:
                continue
            parts[left], parts[right] = whole, None
            last, right = before[left], after[right]
            after[left] = right
            if last >= 0 and (cost := costs.get(wider := parts[last] + whole)) is not None:
                heapq.heappush(queue, (cost, last, left, wider))
            if right < n:
                before[right] = left
                if (cost := costs.get(wider := whole + parts[right])) is not None:
                    heapq.heappush(queue, (cost, left, right, wider))
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of the two pieces gives these two; -1 for no piece on the left."""
        key = left * len(self.sizes) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMORY_PAIRS:
                self.pairs.clear()
            texts = [self.pieces.texts[i] for i in (left, right) if i >= 0]
            found = self.pairs[key] = self.merged("".join(texts)) == texts
        return found

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text whose characters all have pieces."""
        # Mostly the leftmost longest pieces fit together as they stand; then this is the result, as there is only one.
        vocabulary, last, pairs = len(self.sizes), -1, self.pairs
        greedy = [i for _, (_, i) in self.finder.iter_long(text)]
        for i in greedy:
            fits = pairs.get(last * vocabulary + i)
            if not (self.compatible(last, i) if fits is None else fits):
                break
            last = i
        else:
            return greedy
        n, sizes, shorter = len(text), self.sizes, self.shorter
        longest = [-1] * n
        for end, (back, i) in self.finder.iter(text):
            longest[end - back] = i  # ends only grow, so the longest stays
        failed = bytearray(n // 8 + 1)
        path: list[int] = []
        at, last, candidate = 0, -1, longest[0]
        while at < n:
            while candidate >= 0:
                end = at + sizes[candidate]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(last * vocabulary + candidate)
                    if fits or fits is None and self.compatible(last, candidate):
                        break
                candidate = shorter[candidate]
            if candidate < 0:
                failed[at >> 3] |= 1 << (at & 7)
                candidate = path.pop()
                at -= sizes[candidate]
                candidate, last = shorter[candidate], path[-1] if path else -1
                continue
            path.append(candidate)
            last, at = candidate, end
            candidate = longest[at] if at < n else -1
        return path

    def part(self, text: str) -> list[int]:
        """Ids of an already escaped part of a text."""
        # All runs of blanks score alike, so their merges follow position alone; they are merged as such.
        if text.startswith(BLANK + BLANK):
            return [i for p in self.merged(text) for i in self._ids(p)]
        if self.characters.issuperset(text):
            return self.backtrack(text)
        found: list[int] = []
        start = 0
        for at, character in enumerate(text):
            if character not in self.characters:
                if start < at:
                    found.extend(self.backtrack(text[start:at]))
                found.extend(self._ids(character))
                start = at + 1
        if start < len(text):
            found.extend(self.backtrack(text[start:]))
        return found

    def _ids(self, piece: str) -> list[int]:
        """Of a piece, or the bytes of a character that has none."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.pieces.byte_ids[b] for b in piece.encode("utf-8")]

    def _word(self, word: str) -> bytes:
        """The packed ids of a word that is not in memory, from the parts between its safe cuts."""
        # Letters alone are seldom cut, so they are not looked through.
        if word.isalpha() or word[1:].isalpha():
            return array("i", self.part(word)).tobytes()
        found, start, together = [], 0, self.together
        for end in [*(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in together), len(word)]:
            part, start = word[start:end], end
            ids = self.known.get(part)
            if ids is None:
                ids = array("i", self.part(part)).tobytes()
                if len(part) <= MEMORY_CHARS:
                    self.known[part] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as packed 32-bit integers."""
        if not text:
            return b""
        escaped = BLANK + text.replace(" ", BLANK)
        words = self.word.findall(escaped) if self.cuts else [escaped]
        known, older = self.known, self.older
        found = list(map(known.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            ids = known.get(word) or older.get(word) or self._word(word)
            if len(word) <= MEMORY_CHARS:
                known[word] = ids
            found[at] = ids
            if len(known) >= MEMORY_WORDS:
                self.known, self.older = known, older = {}, known
        return b"".join(found)


class Decoder:
    def __init__(self, pieces: Pieces) -> None:
        self.bytes_of = {i: b for b, i in pieces.byte_ids.items()}
        self.surface = [t.replace(BLANK, " ") if k == NORMAL else "" for t, k in zip(pieces.texts, pieces.kinds)]
        self.surface = [pieces.unknown_surface if k == UNKNOWN else s for s, k in zip(self.surface, pieces.kinds)]
        self.is_byte = np.array([i in self.bytes_of for i in range(len(pieces.kinds))], bool)
        self.kinds = pieces.kinds

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        listed = ids.tolist()
        found, pending, start = [], bytearray(), 0
        for at in np.flatnonzero(self.is_byte[ids]).tolist():
            if start < at:
                found.append(_utf8(pending))
                pending.clear()
                found.extend(map(self.surface.__getitem__, listed[start:at]))
            pending.append(self.bytes_of[listed[at]])
            start = at + 1
        found.append(_utf8(pending))
        found.extend(map(self.surface.__getitem__, listed[start:]))
        text = "".join(found)
        first = next((i for i in listed if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and self.surface[first][:1] == " " else text


def _utf8(data: bytearray) -> str:
    """Each byte that starts no character becomes one replacement character."""
    found, at = [], 0
    while at < len(data):
        try:
            found.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            found.append(data[at : at + e.start].decode("utf-8"))
            found.append("�")
            at += e.start + 1
    return "".join(found)


_READY: dict[int, tuple[Encoder, Decoder]] = {}


def _ready(model) -> tuple[Encoder, Decoder]:
    """Built once per Python worker and kept for its further tasks."""
    data = model.value
    key = hash(data)
    if key not in _READY:
        _READY.clear()
        pieces = Pieces(data)
        _READY[key] = Encoder(pieces), Decoder(pieces)
    return _READY[key]


def _iterated(function, kind: str):
    return arrow_udf(function, kind, ArrowUDFType.SCALAR_ITER)


def load_model(spark: SparkSession, path: str, most_mb: int = 64):
    """The model file, read on the driver and sent to the executors. A model has a fixed size that does not depend on the
    corpus; files over ``most_mb`` are refused."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > most_mb * 2**20:
        raise ValueError(f"{path} is larger than {most_mb} MB")
    Pieces(data)
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, model, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of every whole text as array<int>. A null text counts as empty and has no ids; nothing is normalised,
    no begin or end ids are added. Other columns pass through; a column named ``into`` is replaced."""

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _ready(model)[0]
        for batch in batches:
            rows = [encoder.encode(t) if t else b"" for t in batch.to_pylist()]
            offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return df.withColumn(into, _iterated(ids_of, "array<int>")(F.col(text).cast("string")))


def decode(df: DataFrame, model, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of every id list. A null list counts as empty; control ids have no text; bytes that make no character
    become U+FFFD. An id outside the vocabulary is an error."""

    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _ready(model)[1]
        for batch in batches:
            values = batch.values.to_numpy(zero_copy_only=False)
            bounds = batch.offsets.to_numpy()
            yield pa.array([decoder.decode(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())

    return df.withColumn(into, _iterated(text_of, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


