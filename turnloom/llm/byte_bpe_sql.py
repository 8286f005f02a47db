"""Byte-level BPE by recursive queries: token rows join the merge table until nothing merges.

A rank file says which byte strings are tokens, and the smaller a token's rank,
the earlier it is made. Each task keeps the merges as a table (left, right, made)
of an embedded DuckDB that lives in its own process's memory. Distinct words that
are no token become rows (word, place, next place, token); a recursive query joins
neighbours to the merges and contracts each word's leftmost pair of least rank,
until no pair of the word is in the table. Decoding is an ordered aggregation of
the tokens' bytes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import as_named, as_numbered, byte_blocks, file_bytes, kept_columns, numbered_fields, query, table

SHORT = 255             # bytes up to which a word's places fit the low byte of a key
WORDS_AT_ONCE = 20_000
REMEMBERED = 550_000    # words per generation; two generations are kept
DECODED_AT_ONCE = 1 << 19

# One pair of each word per step. A key is word << 8 | place; a token knows the key and the id of the next one (n, r) and
# what it makes with that (m). The right half of a pair stays and becomes the pair's token; only the tokens on both sides
# of a new border are looked up again.
_SHORT_WORDS = """
WITH RECURSIVE parts(k, n, t, r, m, done) AS (
  SELECT k, k + 1, t, r, made, false FROM given LEFT JOIN merges ON pair = (t << 32 | r)
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT k, n, t, r, m FROM parts WHERE NOT done),
   best AS MATERIALIZED (
     SELECT k >> 8 AS w, min(m << 8 | (k & 255)) AS v, arg_min(n, m << 8 | (k & 255)) AS kept
     FROM live WHERE m IS NOT NULL GROUP BY 1),
   moved AS (
     SELECT k, CASE WHEN before THEN kept ELSE n END AS n, CASE WHEN k = kept THEN v >> 8 ELSE t END AS t,
            CASE WHEN before THEN v >> 8 ELSE r END AS r, m, coalesce(before OR k = kept, false) AS changed, w IS NULL AS done
     FROM (SELECT *, n = (w << 8 | (v & 255)) AS before FROM live LEFT JOIN best ON w = k >> 8) WHERE w IS NULL OR k & 255 <> v & 255)
   SELECT k, n, t, r, CASE WHEN changed THEN made ELSE m END, done FROM moved LEFT JOIN merges ON pair = CASE WHEN changed THEN t << 32 | r END))
SELECT k >> 8 AS w, t FROM parts WHERE done ORDER BY k"""

# All equal pairs of a word in one step, which long words need: every other pair of a run, from its left end. Contracting
# one may give its neighbours a pair of still lower rank (``risky``); pairs behind such a one wait for the next step.
_LONG_WORDS = """
WITH RECURSIVE parts(w, p, n, t, done) AS (
  SELECT w, p, n, t, false FROM given
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT w, p, n, t FROM parts WHERE NOT done),
   pairs AS MATERIALIZED (
     SELECT a.w, a.p, a.n AS gone, b.n, made FROM live a JOIN live b ON b.w = a.w AND b.p = a.n JOIN merges ON pair = (a.t << 32 | b.t)),
   best AS MATERIALIZED (SELECT w, min(made) AS made FROM pairs GROUP BY w),
   found AS (
     SELECT pairs.*, row_number() OVER o AS i, lag(gone) OVER o IS DISTINCT FROM p AS starts, coalesce(lag(n) OVER o = p OR lag(n, 2) OVER o = p, false) AS touches
     FROM pairs JOIN best USING (w, made) WINDOW o AS (PARTITION BY w ORDER BY p)),
   placed AS MATERIALIZED (
     SELECT * FROM (SELECT *, i - max(CASE WHEN starts THEN i END) OVER (PARTITION BY w ORDER BY p) AS nth FROM found) WHERE nth % 2 = 0),
   risky AS MATERIALIZED (
     SELECT c.w, c.p FROM placed c JOIN live x ON x.w = c.w AND x.n = c.p JOIN lower ON pair = (x.t << 32 | c.made)
     UNION SELECT c.w, c.p FROM placed c JOIN live x ON x.w = c.w AND x.p = c.n JOIN lower ON pair = (c.made << 32 | x.t)
     UNION SELECT w, p FROM placed JOIN lower ON pair = (made << 32 | made) WHERE touches),
   picked AS MATERIALIZED (
     SELECT w, p, gone, n, made FROM (
       SELECT c.*, coalesce(sum((r.p IS NOT NULL)::INT) OVER (PARTITION BY c.w ORDER BY c.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
       FROM placed c LEFT JOIN risky r ON r.w = c.w AND r.p = c.p) WHERE held = 0)
   SELECT live.w, live.p, coalesce(k.n, live.n), coalesce(k.made, live.t), best.w IS NULL
   FROM live LEFT JOIN best ON best.w = live.w LEFT JOIN picked k ON k.w = live.w AND k.p = live.p
   WHERE NOT EXISTS (SELECT 1 FROM picked g WHERE g.w = live.w AND g.gone = live.p)))
SELECT w, t FROM parts WHERE done ORDER BY w, p"""


# Rows are ordered before they are aggregated, which the one thread of a connection keeps; ordering inside the aggregate sorts
# each text's strings and takes 2.6 times as long.
_DECODED = """
SELECT row, string_agg(hex, '') AS hex, count(*) AS n
FROM (SELECT row, hex FROM given JOIN tokens USING (token) ORDER BY place) GROUP BY row"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file, a token in base 64 and its rank per line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks repeat, or a byte has none")
    return ranks


@dataclass(frozen=True)
class Splitter:
    """The splitting pattern for this process's regular expressions.

    Unicode versions differ between engines. ``exact`` names letters and numbers
    one range after the other, as the tokenizer library takes them; ``odd`` marks
    code points that this engine sees otherwise, and only texts with one of those
    need the slower pattern.
    """

    plain: str
    exact: str
    odd: np.ndarray


def _ranges(points: np.ndarray) -> str:
    """Code points in ascending order as ranges of a character class."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.concatenate(([0], cuts + 1))], points[np.concatenate((cuts, [len(points) - 1]))]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(firsts.tolist(), lasts.tolist()))


def library_splitter(pattern: str) -> Splitter:
    """Letters and numbers are asked of the tokenizer library once, by giving it every code point."""
    import regex
    import tiktoken

    everything = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    odd, exact = np.zeros(0x110000, bool), pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("one class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = np.frombuffer(bytes(library.encode_ordinary(everything)).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        ours = np.frombuffer("".join(regex.findall(name, everything)).encode("utf-32-le"), np.uint32)
        if name == r"\s":
            if theirs.tolist() != ours.tolist():
                raise ValueError("the two engines disagree about blanks")
            break
        odd[np.setxor1d(theirs, ours)] = True
        listed = _ranges(theirs)
        exact = re.sub(r"\[[^\]]*\]", lambda group: group.group(0).replace(name, listed), exact).replace(name, f"[{listed}]")  # noqa: B023
    return Splitter(pattern, exact, odd)


class RankCodec:
    """Encoder and decoder of one task's process."""

    def __init__(self, data: bytes, splitter: Splitter):
        import duckdb
        import regex

        self.ranks = read_ranks(data)
        self.plain, self.exact, self.odd = regex.compile(splitter.plain), regex.compile(splitter.exact), splitter.odd
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        rows = np.array([(self.ranks[t[:k]], self.ranks[t[k:]], made) for t, made in self.ranks.items() for k in range(1, len(t))
                         if t[:k] in self.ranks and t[k:] in self.ranks], np.int64).reshape(-1, 3)
        left, right, made = rows.T
        early = (made < left) | (made < right)
        self.base = duckdb.connect(":memory:", config={"threads": 1})
        self.base.execute("SET temp_directory = ''")    # nothing is ever written to the machine
        tables = {
            "merges": pa.table({"pair": left << 32 | right, "made": made}),
            "lower": pa.table({"pair": (left << 32 | right)[early]}),
            "tokens": pa.table({"token": pa.array(list(self.ranks.values()), pa.int64()), "hex": [t.hex() for t in self.ranks]}),
        }
        for name, rows in tables.items():
            self.base.register("given", rows)
            self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.base.unregister("given")
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _rows(self, sql: str, given: pa.Table) -> pa.Table:
        self.base.register("given", given)
        try:
            return self.base.sql(sql).to_arrow_table()
        finally:
            self.base.unregister("given")

    def _merged(self, words: list[bytes], long: bool) -> list[list[int]]:
        """Tokens of words, from a recursive query over their bytes."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int64), n)
        p = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        t = self.byte_ids[flat]
        if long:
            out = self._rows(_LONG_WORDS, pa.table({"w": w, "p": p, "n": p + 1, "t": t}))
        else:
            r = np.append(t[1:], 0)
            r[np.cumsum(n) - 1] = -1    # nothing follows
            out = self._rows(_SHORT_WORDS, pa.table({"k": w << 8 | p, "t": t, "r": pa.array(r, mask=r < 0)}))
        ends = np.cumsum(np.bincount(out["w"].to_numpy(), minlength=len(words))).tolist()
        ids = out["t"].to_numpy().tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of distinct words: of a whole token itself, else merged."""
        found, short, long = {}, [], []
        for word in words:
            data = word.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            if whole is not None:
                found[word] = (whole,)
            else:
                (short if len(data) <= SHORT else long).append((word, data))
        for some, at_once in ((short, WORDS_AT_ONCE), (long, 1)):
            for a in range(0, len(some), at_once):
                part = some[a : a + at_once]
                for (word, _), ids in zip(part, self._merged([d for _, d in part], some is long)):
                    found[word] = tuple(ids)
        return found

    def split(self, text: str) -> list[str]:
        odd = not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any()
        return (self.exact if odd else self.plain).findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        split = list(map(self.split, texts))
        words = list(dict.fromkeys(chain.from_iterable(split)))
        used = dict(zip(words, map(self.young.get, words)))
        missing = []
        for word in [w for w, ids in used.items() if ids is None]:
            ids = self.old.get(word)
            if ids is None:
                missing.append(word)
            else:
                used[word] = self.young[word] = ids
        fresh = self.words(missing)
        used.update(fresh)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update(fresh)
        for word in [w for w in fresh if len(w) > 64]:
            del self.young[word]
        get = used.__getitem__
        per_text = [list(chain.from_iterable(map(get, words))) for words in split]
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        return np.fromiter(chain.from_iterable(per_text), np.int32, int(counts.sum())), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text, aggregated in the order of its tokens; long runs of tokens in blocks."""
        texts: list[list[bytes]] = [[] for _ in counts]
        owner = np.repeat(np.arange(len(counts)), counts)
        for a in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[a : a + DECODED_AT_ONCE].astype(np.int64)
            given = pa.table({"row": owner[a : a + DECODED_AT_ONCE], "place": np.arange(len(part)), "token": part})
            out = self._rows(_DECODED, given)
            if sum(out["n"].to_pylist()) != len(part):
                raise ValueError("an id is no token")
            for row, data in zip(out["row"].to_pylist(), out["hex"].to_pylist()):
                texts[row].append(bytes.fromhex(data))
        return [b"".join(t) for t in texts]


_CODECS: dict[int, RankCodec] = {}


def codec(data: bytes, splitter: Splitter) -> RankCodec:
    """The codec of this worker process; its tables and words are bounded and serve all of its tasks."""
    key = zlib.crc32(data + splitter.exact.encode())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = RankCodec(data, splitter)
    return _CODECS[key]


def encode_ranks(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to: ``ids, decoded`` after the columns ``keep`` (the id alone if not given).

    Every match of ``pattern`` is encoded by itself; strings of special tokens
    are ordinary text. A null or empty text has no ids and decodes to no bytes.
    Words of any length are encoded whole. Row by row, without a shuffle;
    repeated rows are encoded alike. Other columns are not looked at; a kept one
    named like a result is replaced by it.
    """
    kept = kept_columns(docs, [id_col] if keep is None else keep, ["ids", "decoded"])
    shared = docs.sparkSession.sparkContext.broadcast((file_bytes(ranks_path), library_splitter(pattern)))
    rows = docs.select(*as_numbered(kept), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*numbered_fields(docs, kept), *T.StructType.fromDDL("ids array<int>, decoded binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        for batch in byte_blocks(batches, "text", 1 << 20):
            ids, counts = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = coder.decode(ids, counts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema).select(*as_named(kept), "ids", "decoded")


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: tokens, a digest of the ids as text, and one of the decoded bytes."""
    import public_tokenizers

    coded = encode_ranks(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
