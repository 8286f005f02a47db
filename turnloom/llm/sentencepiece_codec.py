"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

The automaton holds all pieces and goes once over a word. At each position its
output links give every piece that ends there, and each is tried as the last
step of a path (Viterbi). What makes a path best depends on the model:

* unigram: the sum of the pieces' scores.
* bpe: the path that merging by score yields. That one is told by its steps
  alone: its prefix up to any piece is the merged form of that prefix, and
  neighbours a, b may follow each other exactly if merging "ab" gives a, b
  again. So a position's best path is the one whose last step passes that test.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import as_named, as_numbered, byte_blocks, file_bytes, held, kept_columns, numbered_fields, query, table

# --- Fixed values of the model format -----------------------------------------
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
# ------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    dummy_prefix: bool
    byte_ids: list[int]     # of bytes 0 .. 255, or empty
    unknown_id: int


def read_model(data: bytes) -> PieceModel:
    """Pieces and settings of a model file whose normaliser is the identity."""
    pieces, scores, kinds = [], [], []
    model_type, dummy, squeeze, rules = UNIGRAM, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            pieces.append(piece), scores.append(score), kinds.append(kind)
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            settings = dict(_fields(value))
            rules, dummy, squeeze = settings.get(2, b""), bool(settings.get(3, 1)), bool(settings.get(4, 1))
    if rules or squeeze or model_type not in (UNIGRAM, BPE) or USER_DEFINED in kinds:
        raise ValueError("only unigram and BPE models without text normalisation and user-defined pieces are read")
    if any(BLANK in p.lstrip(BLANK) for p, k in zip(pieces, kinds) if k == NORMAL):
        raise ValueError("a piece goes over a word border")
    by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
    return PieceModel(pieces, scores, kinds, model_type, dummy, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], kinds.index(UNKNOWN))


class PieceCodec:
    # Words and neighbours remembered, up to about 300 MB together; a full memory starts anew.
    WORDS, NEIGHBOURS = 800_000, 1_000_000

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.lowest = min((model.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        # Blanks, then what is no blank: no piece goes over the border between two such words, nor over a line break if none has one.
        letters = set().union(*self.ids)
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if "\n" in letters else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}   # characters that some piece joins
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(BLANK, " ").encode()
                         for p, k in zip(model.pieces, model.kinds)]
        order = sorted(self.ids.values(), key=lambda i: -model.scores[i])
        self.rank = dict(zip(order, range(len(order))))     # when a piece is made: the smaller, the earlier
        self.known: dict[str, bytes] = {}   # ids as 32-bit integers
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.steps = self._merge_steps if model.model_type == BPE else self._best_sum

    # -- unigram

    def _best_sum(self, word: str) -> list[int]:
        """Ids of the path of largest score; -1 for a character that no piece covers."""
        n = len(word)
        best, last = [0.0] + [-np.inf] * n, [(-1, 1)] * (n + 1)
        scores = self.model.scores
        at = 0

        def unknown(upto: int) -> None:
            nonlocal at
            while at < upto:    # a character with no piece of its own may stand alone
                at += 1
                if word[at - 1] not in self.ids and best[at - 1] + self.lowest > best[at]:
                    best[at], last[at] = best[at - 1] + self.lowest, (-1, 1)

        for end, (i, size) in self.automaton.iter(word):
            unknown(end)
            score = best[end + 1 - size] + scores[i]
            if score > best[end + 1]:
                best[end + 1], last[end + 1] = score, (i, size)
        unknown(n)
        return self._back(last, n)

    @staticmethod
    def _back(last: list[tuple[int, int]], n: int) -> list[int]:
        path = []
        while n > 0:
            i, size = last[n]
            path.append(i)
            n -= size
        return path[::-1]

    # -- bpe

    def merge(self, word: str, but: str | None = None) -> list[str]:
        """Merging as the model defines it: of all neighbours that form a piece, the best score first, the leftmost of equals.

        ``but`` is a piece that is not to be made.
        """
        ids, scores = self.ids, self.model.scores
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                both = parts[a] + parts[b]
                if both in ids and both != but:
                    heapq.heappush(heap, (-scores[ids[both]], a, both, b))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both, b = heapq.heappop(heap)
            if parts[a] is None or right[a] != b or parts[a] + parts[b] != both:
                continue    # one of the two has been merged meanwhile
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def _parts(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merging makes a piece; none for a character."""
        if i not in self.made_of:
            p = self.model.pieces[i]
            two = self.merge(p, but=p) if len(p) > 1 else []
            self.made_of[i] = (self.ids[two[0]], self.ids[two[1]]) if len(two) == 2 else None
        return self.made_of[i]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of both gives both again.

        Seen backwards in time, the piece made last falls apart first. While the
        two pieces at the border stood side by side, nothing may have joined
        them; ``until`` is when one of them was used up.
        """
        ok = self.follows.get((a, b))
        if ok is not None:
            return ok
        if len(self.follows) > self.NEIGHBOURS:
            self.follows.clear()
        pieces, ids, rank = self.model.pieces, self.ids, self.rank
        x, y, until, ok = a, b, len(rank) + 1, True
        while True:
            both = ids.get(pieces[x] + pieces[y])
            if both is not None and rank[both] < until:
                ok = False
                break
            px, py = self._parts(x), self._parts(y)
            if px is None and py is None:
                break
            if py is None or px is not None and rank[x] > rank[y]:
                until, x = rank[x], px[1]       # of equal pieces the left one is made first
            else:
                until, y = rank[y] + 1, py[0]
        self.follows[a, b] = ok
        return ok

    def _is_whole(self, i: int) -> bool:
        ok = self.whole.get(i)
        if ok is None:
            ok = self.whole[i] = len(self.merge(self.model.pieces[i])) == 1
        return ok

    def _merge_steps(self, word: str) -> list[int]:
        if word.startswith(BLANK * 2):
            # Pieces of blanks may share one score, and then the order of merging counts, which no pair of neighbours tells.
            return [self.ids.get(p, -1) for p in self.merge(word)]
        n = len(word)
        last: list[tuple[int, int]] = [(-1, 1)] * (n + 1)
        done = [False] * (n + 1)
        done[0] = True
        at = 0
        for end, (i, size) in self.automaton.iter(word):    # longest piece first
            while at < end:     # no piece ends here: a character unknown to the model
                at += 1
                done[at] = True
            if done[end + 1]:
                continue
            before = end + 1 - size
            left = last[before][0] if before else -1
            if self._is_whole(i) and (left < 0 or self._may_follow(left, i)):
                last[end + 1], done[end + 1] = (i, size), True
        return self._back(last, n)

    # -- texts

    def _word(self, word: str) -> bytes:
        m, at = self.model, 0
        stop = len(word)
        while stop > 2 and not word[stop - 1].isalnum() and word[stop - 2 : stop] not in self.neighbours:
            stop -= 1   # no piece goes over this border
        if stop < len(word):
            return b"".join([self._known(word[:stop]), *map(self._known, word[stop:])])
        out = array("i")
        for i in self.steps(word):
            if i >= 0:
                out.append(i)
                at += len(m.pieces[i])
            else:
                if m.byte_ids:
                    out.extend([m.byte_ids[b] for b in word[at].encode("utf-8", "replace")])
                else:
                    out.append(m.unknown_id)
                at += 1
        return out.tobytes()

    def _known(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) <= 64:
                if len(self.known) > self.WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids as 32-bit integers in a row."""
        if not text:
            return b""
        text = text.replace(" ", BLANK)
        known = self.known
        return b"".join([known.get(w) or self._known(w) for w in self.word.findall(BLANK + text if self.model.dummy_prefix else text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def codec(data: bytes) -> PieceCodec:
    """The codec of this worker process for a model file's bytes."""
    return held("pieces", zlib.crc32(data), lambda: PieceCodec(read_model(data)))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids of every whole text, and the text they decode to: ``ids, decoded`` after the columns ``keep`` (the id alone if not given).

    Decoding gives the text back, but for U+2581, which stands for a blank in
    all pieces. A null or empty text has no ids and decodes to "". Characters
    without a piece become bytes, or the unknown id in a model without bytes.
    Row by row, without a shuffle; repeated rows are encoded alike. Other
    columns are not looked at; a kept one named like a result is replaced by it.
    """
    kept = kept_columns(docs, [id_col] if keep is None else keep, ["ids", "decoded"])
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    rows = docs.select(*as_numbered(kept), F.col(text_col).alias("text"))
    schema = T.StructType([*numbered_fields(docs, kept), *T.StructType.fromDDL("ids array<int>, decoded string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(shared.value)
        for batch in byte_blocks(batches, "text", 1 << 20):
            ids = [np.frombuffer(pieces.encode_packed(t or ""), np.int32) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            decoded = [pieces.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(decoded, pa.string())], schema.names)

    return rows.mapInArrow(run, schema).select(*as_named(kept), "ids", "decoded")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: tokens, a digest of the ids as text, a digest of the decoded text, and whether it is the text again."""
    docs = table(spark, folder, "documents")
    coded = encode_pieces(docs, default_model(), keep=["doc_id", "text"])
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))
