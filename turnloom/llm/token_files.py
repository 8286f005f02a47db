"""Token ids in compressed, searchable files: one wavelet matrix per shard.

A shard is a range of documents in order of id. Its token ids are one sequence,
kept as bit planes, highest bit first, each plane stably sorted by the bit above
it. Ones are counted per block of 512 bits, so that access, counting (rank) and
the place of an occurrence (select) work on the planes. The planes and counts
of a shard are one byte string, compressed plane by plane.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import byte_blocks, file_bytes, query, shared_folder, table, utf8
from turnloom.llm.ranges import key_ranges

END_ID = 0
SHARD_TOKENS = 1 << 20
RANK_BLOCK = 512
BROADCAST_SHARDS = 200_000  # starts of so many shards, three numbers each, may be sent to every task
MAGIC = b"WMX1"


# --- file format ----------------------------------------------------------------

def _pack(part: bytes) -> bytes:
    return struct.pack("<I", len(part)) + part


def _parts(data: bytes, at: int) -> Iterator[bytes]:
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def write_matrix(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard: ids of all its documents in a row, and how many each document has."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out = [MAGIC, struct.pack("<QIB", len(ids), len(lengths), bits), _pack(squeeze(lengths.astype("<u4").tobytes()))]
    one = values.dtype.type(1)
    for level in range(bits - 1, -1, -1):
        bit = ((values >> values.dtype.type(level)) & one).astype(bool)
        out.append(_pack(squeeze(np.packbits(bit, bitorder="little").tobytes())))
        values = np.concatenate((values.compress(~bit), values.compress(bit)))
    return b"".join(out)


class TokenMatrix:
    """A shard read back. Places and documents count from 0."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.size, documents, self.bits = struct.unpack_from("<QIB", data, 4)
        expand = zstandard.ZstdDecompressor().decompress
        parts = _parts(data, 4 + struct.calcsize("<QIB"))
        self.lengths = np.frombuffer(expand(next(parts)), "<u4")
        assert len(self.lengths) == documents
        self.planes = [np.frombuffer(expand(p), np.uint8) for p in parts]
        self._counts: list[np.ndarray] | None = None

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)

    @property
    def counts(self) -> list[np.ndarray]:
        """Ones before each block of RANK_BLOCK bits, per plane."""
        if self._counts is None:
            step = RANK_BLOCK // 8
            self._counts = []
            for plane in self.planes:
                ones = np.bitwise_count(np.concatenate((plane, np.zeros(-len(plane) % step, np.uint8)))).reshape(-1, step).sum(1)
                self._counts.append(np.concatenate(([0], np.cumsum(ones))).astype(np.int64))
        return self._counts

    def _ones_before(self, level: int, place: int) -> int:
        block = place // RANK_BLOCK
        a, b = block * (RANK_BLOCK // 8), place // 8
        n = int(self.counts[level][block]) + int(np.bitwise_count(self.planes[level][a:b]).sum())
        return n + (int(self.planes[level][b]) & ((1 << (place % 8)) - 1)).bit_count() if place % 8 else n

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][place // 8]) >> (place % 8) & 1
            ones = self._ones_before(level, place)
            place = self.size - int(self.counts[level][-1]) + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, place: int) -> int:
        """How often ``value`` occurs before ``place``."""
        if value >> self.bits:
            return 0
        low, high = 0, place
        for level in range(self.bits):
            a, b = self._ones_before(level, low), self._ones_before(level, high)
            if value >> (self.bits - 1 - level) & 1:
                zeros = self.size - int(self.counts[level][-1])
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return high - low

    def select(self, value: int, k: int) -> int:
        """The place of occurrence ``k`` of ``value``, by bisection on ranks; -1 if there are fewer."""
        if k < 0 or self.rank(value, self.size) <= k:
            return -1
        low, high = 0, self.size - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(value, mid + 1) > k else (mid + 1, high)
        return low

    def ids(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, each sort by a bit is undone."""
        values = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = self._bits(level)
            zeros = self.size - int(np.count_nonzero(bit))
            up = np.empty_like(values)
            up[np.flatnonzero(~bit)] = values[:zeros]
            up[np.flatnonzero(bit)] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = up
        return values


# --- tokens ---------------------------------------------------------------------

# Text between these borders is encoded by itself: a byte-level tokenizer never joins a blank to what is before it.
_SPACE = "\t-\r \x85\xa0 ᠎ -     　\x1c-\x1f"
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LATIN_WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")  # no apostrophe, which may begin a token with letters
_LATIN_STEM = "^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -     　]")


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _table(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs.encode("latin-1"))] = True
    return out


_BLANK = _table("\t\n\x0b\x0c\r ")
_LETTER = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SIGN = _table("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # no apostrophe


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin, in the bytes of all; texts hold no other blanks than those of ASCII.

    As with ``_CHUNK``, and signs behind a Latin letter begin a chunk too.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    blank = _BLANK[data]
    start = np.zeros(len(data), bool)
    # The first of several blanks; the last, which may belong to what follows; and what follows one that is no space.
    start[1:] = (blank[1:] & ~blank[:-1]) | (~blank[1:] & blank[:-1] & (data[:-1] != 32))
    last = np.zeros(len(data), bool)
    last[:-1] = blank[:-1] & ~blank[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = False
    start |= last
    letter = _LETTER[data]
    wide = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))  # leads of À to ɏ, but for the two signs among them
    lead, follow = data[wide], data[wide + 1]
    letter[wide + 1] = ~((lead == 0xC3) & ((follow == 0x97) | (follow == 0xB7)) | (lead == 0xC9) & (follow > 0x8F))
    start[1:] |= _SIGN[data[1:]] & letter[:-1]
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start)


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer; chunks met before are looked up.

    Strings of the tokenizer's added tokens in a text become those tokens, as the
    library does it; without ``special`` those of special tokens are ordinary text.
    """

    LIMIT = 1_000_000     # chunks remembered; the memory starts anew beyond

    def __init__(self, definition: bytes, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.encode_special_tokens = not special
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        either = lambda tokens: re.compile("(" + "|".join(re.escape(t.content) for t in sorted(tokens, key=lambda t: -len(t.content))) + ")") if tokens else None
        self.added = either(added)
        self.added_strings = [t.content for t in added]
        # One that takes blanks around it, or depends on them, is left to the library with the whole text.
        self.bound = either([t for t in added if t.lstrip or t.rstrip or t.single_word])
        self.model = self.tokenizer.model
        # A byte is a visible character of its own to the model: itself where it is one, else the next free one from 256 on.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in visible]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        self.blank = chr(self.alphabet[32])
        self.visible = np.array([b if b == 10 else self.alphabet.get(b, b) for b in range(256)], "<u4")  # line feeds stay
        self.signs: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)    # of a chunk's ids in flat, with a 0 before

    def _ids_of(self, chunk: str) -> list[int]:
        """A Latin word, with or without a blank before and signs behind, is what the model is given for it; else the whole way."""
        word = _LATIN_WORD.fullmatch(chunk)
        if word is None or self.added and self.added.search(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        blank, stem, signs = word.groups()
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(self.blank + stem if blank else stem)]
        if not signs:
            return ids
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = self.tokenizer.encode(signs, add_special_tokens=False).ids
        return ids + self.signs[signs]

    def _stem_ids(self, stems: list[str]) -> list[list[int]]:
        """The same for Latin words alone, with or without a blank before, written in the model's alphabet all at once."""
        visible = self.visible[np.frombuffer("\n".join(stems).encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [[t.id for t in found] for found in map(self.model.tokenize, visible.split("\n"))]

    def _learn(self, chunks: pa.Array, plain: bool) -> np.ndarray:
        """Numbers of new chunks. ``plain``: no added token is in them."""
        stem = pc.match_substring_regex(chunks, _LATIN_STEM) if plain else pa.array(np.zeros(len(chunks), bool))
        stems, others = _strings(chunks.filter(stem)), _strings(chunks.filter(pc.invert(stem)))
        found = [*(self._stem_ids(stems) if stems else ()), *map(self._ids_of, others)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        base, used = len(self.known), int(self.ends[len(self.known)])
        while base + len(found) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while used + sizes.sum() > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.ends[base + 1 : base + 1 + len(found)] = used + np.cumsum(sizes)
        self.flat[used : used + sizes.sum()] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.known.update(zip(chain(stems, others), range(base, base + len(found))))
        return base + np.argsort(np.argsort(~stem.to_numpy(zero_copy_only=False), kind="stable"))

    def _numbers(self, chunks: pa.Array, plain: bool) -> np.ndarray:
        """The number of each chunk among those that are known by then."""
        coded = chunks.dictionary_encode()
        numbers = np.fromiter(map(self.known.get, _strings(coded.dictionary), repeat(-1)), np.int64, len(coded.dictionary))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            numbers[missing] = self._learn(coded.dictionary.take(pa.array(missing)), plain)
        return numbers[coded.indices.to_numpy()]

    def _split(self, text: str) -> list[str]:
        """Chunks that are encoded by themselves: added tokens, and what lies between borders."""
        if self.added and self.added.search(text):
            if self.bound and self.bound.search(text):
                return [text]
            parts = self.added.split(text)
            return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self._chunks(p))]
        return self._chunks(text)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return [text] if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not split by their bytes: those with other blanks than ASCII's, or with added tokens."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE.pattern)
        for token in self.added_strings:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return odd.to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.known) > self.LIMIT:
            self._forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        odd = self._odd(texts)
        data, offsets = utf8(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        starts = chunk_starts(data, offsets)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        which = self._numbers(chunks, True)
        per_text = np.diff(np.searchsorted(starts, offsets))
        if odd.any():
            split = list(map(self._split, texts.filter(pa.array(odd)).to_pylist()))
            per_text[odd] = list(map(len, split))
            apart = np.repeat(odd, per_text)
            plain, which = which, np.empty(len(apart), np.int64)
            which[~apart] = plain
            which[apart] = self._numbers(pa.array(chain.from_iterable(split), pa.large_string()), False)
        known = len(self.known)
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends[: known + 1]), pa.array(self.flat[: self.ends[known]]))
        ids = lists.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(self.ends[which + 1] - self.ends[which])))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])


_ENCODERS: dict[int, ChunkEncoder] = {}


def byte_bpe(definition: bytes) -> ChunkEncoder:
    """The encoder of this worker process for a tokenizer definition."""
    key = zlib.crc32(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(definition, special=True)
    return _ENCODERS[key]


# --- write and read ---------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts, and write them in order of id as wavelet matrices.

    ``folder`` becomes a table of one row per shard: range, number within the
    range, documents' ids, tokens and the file's bytes. Texts move once, to the
    range of their id; a shard has about ``shard_tokens`` tokens, of whole
    documents. Null counts as empty: the end id alone. The string of an added
    token in a text is that token, as the library has it. Null ids come first;
    rows of one id follow each other by text. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number, bounds = key_ranges(rows.select("id"), "id")
    spread = (rows.withColumn("part", number).repartitionById(len(bounds) + 1, "part")
              .sortWithinPartitions("part", F.col("id").asc_nulls_first(), "text"))
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(shared.value)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list = []
        size, part, number = 0, None, 0

        def shard() -> pa.RecordBatch:
            nonlocal size, number
            sequence, n = np.concatenate(ids), np.concatenate(lengths)
            row = [part, number, len(sequence), list(keys), write_matrix(sequence, n)]
            ids.clear(), lengths.clear(), keys.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names)

        for batch in byte_blocks(batches, "text", 1 << 20):
            parts = batch.column("part").to_numpy()
            for a, b in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)])):
                if part is not None and parts[a] != part:
                    if keys:
                        yield shard()
                    number = 0
                part = int(parts[a])
                found, n = encoder.encode(batch.column("text").slice(a, b - a))
                with_end = np.full(len(found) + len(n), end_id, np.uint32)
                stay = np.ones(len(with_end), bool)
                stay[np.cumsum(n + 1) - 1] = False
                with_end[stay] = found
                ids.append(with_end)
                lengths.append(n + 1)
                keys.extend(batch.column("id").slice(a, b - a).to_pylist())
                size += len(with_end)
                if size >= shard_tokens:
                    yield shard()
        if keys:
            yield shard()

    names = ["part", "shard", "n_tokens", "ids", "matrix"]
    (spread.mapInArrow(encode, "part int, shard int, n_tokens bigint, ids array<bigint>, matrix binary")
     .write.option("compression", "none").parquet(folder))


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: ``id_col, start, n_tokens, ids_crc32``, the end id included.

    ``start`` counts the tokens of all documents before; the shards' sizes, one
    number per shard, are summed in order, not the documents'.
    """
    shards = spark.read.parquet(folder)
    # Per range first: the window over ranges has one row per range.
    order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    starts = (shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("s"))
              .join(before, "part").select("part", "shard", (F.col("s") + F.col("range_start")).alias("start")))

    if shards.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)  # else the shards are shuffled once more

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, start, data in zip(batch.column("ids"), batch.column("start").to_pylist(), batch.column("matrix")):
                matrix = TokenMatrix(data.as_py())
                sequence = matrix.ids().astype("<u4")
                ends = np.cumsum(matrix.lengths, dtype=np.int64)
                begins = ends - matrix.lengths
                crc = [zlib.crc32(sequence[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(begins + start), pa.array(matrix.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                                                 [id_col, "start", "n_tokens", "ids_crc32"])

    return (shards.join(starts, ["part", "shard"]).select("ids", "start", "matrix")
            .mapInArrow(documents, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark)
    write_token_files(table(spark, folder, "documents"), default_tokenizer(), out)
    return read_token_files(spark, out)
