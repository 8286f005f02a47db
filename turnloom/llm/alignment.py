"""Alignment of two tokenizers' tokens by diagonal runs, and how often tokens go together.

Both tokenizers cut the same bytes, so each gives an ascending list of end
offsets. Where both cut alike, token i of one ends with token i + shift of the
other: such a stretch is jumped by comparing slices of the two lists, doubled
while they are equal and halved when they are not. Where they differ, the smaller
end goes on until both meet again; that irregular group sets the new shift.

Tokens that end together are linked. A link's count is how many links of the
whole corpus hold the same pair of ids. Texts are read once and leave blocks
(one row each): per document its numbers and distinct links, per block its
distinct pairs. Only the blocks' pairs meet the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import byte_blocks, file_bytes, query, stored, table
from turnloom.llm.token_files import ChunkEncoder

BLOCK_BYTES = 4 << 20       # of text in one block of documents
AT_ONCE = 1 << 20           # of text encoded at a time
_B_BITS = 31                # of a pair's second id


def aligned(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per group, the number of tokens of each list up to its end. Both lists are strictly ascending and end alike."""
    first_a: list[int] = []     # a stretch of groups of one token each: where its first one is, and how many
    first_b: list[int] = []
    length: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        at, shift, step = i, j - i, 1
        while a[i : i + step] == b[j : j + step]:      # at the same shift
            i += step
            j += step
            if i >= n:
                i = n
                break
            step *= 2
        else:
            while step > 1:     # the stretch ends within the last step
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i += step
                    j += step
        if i > at:
            first_a.append(at), first_b.append(at + shift), length.append(i - at)
            if i >= n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        first_a.append(i), first_b.append(j), length.append(1)
        i += 1
        j += 1
    runs = np.array(length, np.int64)
    inside = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.array(first_a, np.int64), runs) + inside + 1, np.repeat(np.array(first_b, np.int64), runs) + inside + 1


@dataclass
class TokenBytes:
    """The bytes of every id of a vocabulary, end to end."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> TokenBytes:
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[ids], size)]


class Pair:
    """Both tokenizers in a worker process."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece

        self.a = ChunkEncoder(byte_level, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        visible = {chr(c): b for b, c in {**{b: b for b in range(256)}, **self.a.alphabet}.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        of_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            of_a[i] = bytes(visible[c] for c in token) if all(c in visible for c in token) else token.encode()
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.bytes_a, self.bytes_b = TokenBytes.of(of_a), TokenBytes.of(of_b)
        names = lambda n, signs: np.array([f"{i}{s}" for s in signs for i in range(n)], object)
        self.names_a, self.names_b = names(len(of_a), ",|"), names(len(of_b), ",;")

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts per text of both; texts whose bytes either does not give back have none."""
        spaced = [" " + t for t in texts]
        a, n_a = self.a.encode(spaced)
        a = a.astype(np.int64)
        found = self.b.encode(texts, out_type=int, num_threads=1) if texts else []
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter((i for ids in found for i in ids), np.int64, int(n_b.sum()))
        wanted = [t.encode("utf-8", "surrogatepass") for t in spaced]
        good = np.fromiter((bool(t) for t in texts), bool, len(texts))
        for ids, n, of in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            data = of.joined(ids).tobytes()
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n), weights=of.size[ids], minlength=len(n)).astype(np.int64)).tolist()
            good &= np.fromiter((data[x:y] == w for x, y, w in zip([0, *ends], ends, wanted)), bool, len(n))
        if good.all():
            return a, n_a, b, n_b
        return a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good

    def links(self, texts: list[str]) -> tuple[list[list], np.ndarray, np.ndarray]:
        """Per text ``n_a, n_b, n_groups, groups_sha256``; and of every group the text it is in and its linked pair."""
        a, n_a, b, n_b = self.tokens(texts)
        to_a, to_b = aligned(np.cumsum(self.bytes_a.size[a]).tolist(), np.cumsum(self.bytes_b.size[b]).tolist())
        owner = np.repeat(np.arange(len(texts)), n_a)[to_a - 1]
        groups = np.bincount(owner, minlength=len(texts))
        # All ids in the order they are written in: a group's of a, then its of b; the last of each has the other sign.
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1] = last_b[to_b - 1] = 1
        b_before = np.concatenate(([0], to_b))[np.cumsum(last_a) - last_a]
        a_before = to_a[np.cumsum(last_b) - last_b] if len(to_a) else np.zeros(0, np.int64)
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + b_before] = self.names_a[a + last_a * len(self.bytes_a.size)]
        written[np.arange(len(b)) + a_before] = self.names_b[b + last_b * len(self.bytes_b.size)]
        written = written.tolist()
        ends = np.cumsum(n_a + n_b).tolist()
        sha = [hashlib.sha256("".join(written[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]
        pairs = a[to_a - 1] << _B_BITS | b[to_b - 1]
        return [n_a.tolist(), n_b.tolist(), groups.tolist(), sha], owner, pairs


_PAIRS: dict[int, Pair] = {}


def _pair(models: tuple[bytes, bytes]) -> Pair:
    key = hash(models)
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*models)
    return _PAIRS[key]


_BLOCK = ("block bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha array<string>, "
          "ends array<bigint>, which array<int>, times array<int>, pairs array<bigint>, n array<bigint>")


def align_texts(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents with both tokenizers' groups, one row each.

    ``ids, n_a, n_b, n_groups, sha`` have an entry per document, ``ends`` the end
    of its distinct links in ``which`` (places in ``pairs``) and ``times``;
    ``pairs`` are the distinct pairs of ids of the block and ``n`` their links. A
    block has about ``block_bytes`` of text, of whole documents.

    Tokenizer A is given a blank and the text, B the text; strings of special
    tokens are plain text. Null and empty texts, and those whose joined bytes of
    either differ from blank and text, have no tokens. Repeated rows are documents
    each. Other columns are not looked at.
    """
    models = docs.sparkSession.sparkContext.broadcast((file_bytes(byte_level_path), file_bytes(piece_path)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType.fromDDL(_BLOCK.format(id=rows.schema["id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(models.value)
        task, number, size, waiting = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            nonlocal number, size
            ids = pa.concat_arrays([w[0] for w in waiting])
            facts = [[x for w in waiting for x in w[1][k]] for k in range(4)]
            sizes = [len(w[0]) for w in waiting]
            owner = np.concatenate([w[2] + shift for w, shift in zip(waiting, np.cumsum([0, *sizes]))])
            pairs, which, n = np.unique(np.concatenate([w[3] for w in waiting]), return_inverse=True, return_counts=True)
            linked, times = np.unique(owner << 32 | which, return_counts=True)
            ends = np.cumsum(np.bincount(linked >> 32, minlength=len(ids)))
            row = [pa.array([task << 32 | number]), *(pa.ListArray.from_arrays([0, len(v)], v) for v in (
                ids, *(pa.array(f, pa.int64()) for f in facts[:3]), pa.array(facts[3], pa.string()), pa.array(ends.astype(np.int64)),
                pa.array((linked & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(pairs), pa.array(n.astype(np.int64))))]
            waiting.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(row, schema.names)

        for batch in byte_blocks(batches, "text", min(AT_ONCE, block_bytes)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            facts, owner, pairs = pair.links(texts)
            waiting.append((batch.column("id"), facts, owner, pairs))
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield block()
        if waiting:
            yield block()

    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, a, b, links`` over the corpus; a block's links of one pair are one row."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    low = (1 << _B_BITS) - 1
    return each.groupBy("pair").agg(F.sum("n").alias("links")).select(
        "pair", F.shiftright("pair", _B_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(low)).cast("int").alias("b"), "links")


def judge_links(blocks: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose pair is the most frequent one of its id of B,
    ties included; ``count_sum`` adds up the links' counts. Hand in stored tables.
    """
    # A row per id of B at most, so as many as its vocabulary has.
    best = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("most")))
    ranked = counts.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    # A pair has one row per block here, whatever share of the links it owns.
    used = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(ranked, "pair")
    known = used.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "links", "best"))).alias("known"))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_a, n_b, groups, sha, ends, which, times, table_ = (batch.column(k)[r].values for k in range(9))
                links, best = (np.zeros(0, np.int64),) * 2 if table_ is None else (table_.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                which, times = which.to_numpy(), times.to_numpy().astype(np.int64)
                sums = [np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends.to_numpy()))] for x in (times, times * best[which], times * links[which])]
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, groups, *(pa.array(np.diff(s)) for s in sums), sha], names)

    both = blocks.drop("pairs", "n").join(known, "block", "left").select("ids", "n_a", "n_b", "n_groups", "sha", "ends", "which", "times", "known")
    out = both.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    blocks = stored(align_texts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    return judge_links(blocks, stored(pair_counts(blocks)))
