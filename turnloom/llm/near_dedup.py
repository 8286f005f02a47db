"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has 64 symbols of 14 bits, in 16 chunks of four. Two signatures that
differ in at most 29 symbols have at least two chunks with at most one wrong
symbol (pigeonhole), so they share the keys "chunk without symbol i" of those
chunks. Every pair below that distance therefore meets in a key, and a pair of
similarity 0.8 lies below it with a probability of about 1 - 1.2e-6. Links are
confirmed on the full sets.

Pairs of a key are never all listed. Equal sets are one node. The members of a
key are first compared with the key's best connected member only; after two
such rounds only members of still different components are paired: in keys of
few members one by one, each pair at the first key that it shares. Members of
larger keys are written as differences from a hub, and pairs are found by the
rare differences that they share (``linked_by_differences``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import byte_blocks, query, stored, table
from turnloom.llm.components import connected_components

SHINGLE = 4
PERCENT = 80
SYMBOLS, CHUNKS = 64, 16
SYMBOL_BITS, LANE = 14, 15      # a lane's top bit is free
MAX_DISTANCE = 29
STAR_ROUNDS = 2
LARGE = 16          # members of a key up to which they are paired one by one
BANDS = 8           # classes of members of a large group, by their distance from the hub
COPY_MEMBERS = 256  # members of a group that share one copy of the hub's set
_NO_ID = -(1 << 63)

_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64) << np.uint64(1)
_FACTORS = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64) << np.uint64(1) | np.uint64(1)
_ODD = _rng.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPAN = 1 << 20     # bytes of text hashed at a time
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS:
        base = 0x9E3779B97F4A7C15
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(_SPAN + 1, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes: a polynomial from prefix sums, mixed; longer words than a span by digest."""
    edge = np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    first = 0
    while first < len(starts):
        base = starts[first]
        stop = int(np.searchsorted(ends, base + _SPAN, "right"))
        if stop == first:
            out[first] = int.from_bytes(hashlib.blake2b(data[base : ends[first]].tobytes(), digest_size=8).digest(), "little")
            first += 1
            continue
        part = data[base : ends[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[first:stop] - base, ends[first:stop] - base
        out[first:stop] = (sums[e] - sums[s]) * down[s]
        first = stop
    return _mixed(out + (ends - starts).astype(np.uint64) * _ODD[-1])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; fewer words are one shingle, none are none."""
    words = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER), np.uint8))
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    mix = np.full(n, size, np.uint64)
    for i in range(size):
        mix = (mix ^ (mix >> np.uint64(29))) * _ODD[i] + words[i : n + i]
    return np.unique(_mixed(mix))


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minima, of each the 14 bits that a mix of it gives; four to a number, in lanes of 15 bits."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        low = np.minimum(low, ((hashes[a : a + 4096, None] ^ _SEEDS) * _FACTORS).min(0))
    symbols = (_mixed(low) >> np.uint64(64 - SYMBOL_BITS)).reshape(CHUNKS, 4)
    return (symbols << np.arange(0, 4 * LANE, LANE, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_blocks(batches, "text"):
        sizes, digests, signatures = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingle_set(t)
            sizes.append(len(s))
            digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8"))
            signatures.append(signature(s))
        pair = np.array(digests, np.int64).reshape(-1, 2)
        flat = pa.array(np.concatenate(signatures)) if signatures else pa.array([], pa.int64())
        chunks = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * CHUNKS), flat)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), chunks], ["id", "n", "k1", "k2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["id", "items"])


def _chunk_distances(a: Column, b: Column) -> list[Column]:
    # A lane that is not zero carries into its top bit; the sum stays below 2**60.
    carry = sum(((1 << SYMBOL_BITS) - 1) << LANE * i for i in range(4))
    tops = sum(1 << LANE * i + SYMBOL_BITS for i in range(4))

    def differing(x: Column, y: Column) -> Column:
        return F.bit_count((x.bitwiseXOR(y) + F.lit(carry)).bitwiseAND(F.lit(tops)))

    # Written out chunk by chunk, which compiles; a function over arrays would be interpreted for each pair.
    return [differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(CHUNKS)]


def distance(a: Column, b: Column) -> Column:
    """Symbols in which two signatures differ."""
    return reduce(add, _chunk_distances(a, b))


def _first_shared(number: Column, a: Column, b: Column) -> Column:
    """Whether the key of that number, which both signatures have, is the first one that they share."""
    first = F.least(*[F.when(d <= 1, i) for i, d in enumerate(_chunk_distances(a, b))])
    chunk = F.shiftright(number, 2)
    # Equal chunks share four keys, chunks with one wrong symbol a single one.
    return (chunk == first) & ((number % 4 == 0) | (F.get(a, chunk) != F.get(b, chunk)))


def chunk_keys(sig: Column) -> Column:
    """Of every chunk, the four keys that leave one symbol out; chunk and symbol stand in its place."""
    def of(chunk: Column, number: Column) -> Column:
        lanes = [((1 << LANE) - 1) << LANE * i for i in range(4)]
        return F.array(*[chunk.bitwiseAND(F.lit(~lane)).bitwiseOR(F.shiftleft((number * 4 + i).cast("bigint"), LANE * i)) for i, lane in enumerate(lanes)])

    return F.flatten(F.transform(sig, of))


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets are alike enough."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "y"):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))
    return both.mapInArrow(judge, "a bigint, b bigint")


def _hubs(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """``key, b, cb``: every key's best connected member, and its component."""
    rank = F.struct("degree", F.bitwise_not("node").alias("low"))
    return (members.join(degrees, "node").groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "node", "c")).alias("hub"))
            .select("key", F.col("hub.node").alias("b"), F.col("hub.c").alias("cb")))


def _groups(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """``hub, node, c``: the members of each key, under the best connected of the hubs that the key's own hub meets.

    Members of one key are in one group. Keys of variants thereby join the group
    of the text that they vary, instead of repeating it under hubs of their own.
    """
    hubs = stored(_hubs(members, degrees).select("key", "b"))
    met = members.select("key", F.col("node").alias("own")).join(hubs, "key").join(hubs.select(F.col("b").alias("own")).distinct(), "own").select("own", "b").distinct()
    rank = F.struct("degree", F.bitwise_not("b").alias("low"), "b")
    best = met.join(degrees.withColumnRenamed("node", "b"), "b").groupBy("own").agg(F.max(rank).getField("b").alias("hub")).withColumnRenamed("own", "b")
    return members.join(hubs, "key").join(best, "b").select("hub", "node", "c").distinct()


def _differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``hub, node, c, v, e, items``: the items that a member's set ``v`` and the hub's do not share, and the excess ``e`` of the member."""
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "x", 1 << 20):
            found, versions, excess = [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                found.append(np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                versions.append(int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True))
                excess.append((100 + percent) * len(found[-1]) - (100 - percent) * (len(x) // 8))
            ends = np.concatenate(([0], np.cumsum([len(d) for d in found]))).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("hub", "node", "c")), pa.array(versions, pa.int64()), pa.array(excess, pa.int64()), items],
                                             ["hub", "node", "c", "v", "e", "items"])

    # Members of a large group meet copies of the hub's set, not all of them one; of several sets under one id any will do.
    shares = groups.groupBy("hub").agg(F.ceil(F.count("*") / COPY_MEMBERS).alias("copies"))
    hubs = (sets.join(shares, F.col("id") == F.col("hub")).groupBy("hub", "copies").agg(F.min("items").alias("y"))
            .select("hub", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")))
    both = (groups.join(sets.select(F.col("id").alias("node"), F.col("items").alias("x")), "node")
            .join(shares, "hub").withColumn("copy", F.pmod(F.xxhash64("node"), "copies")).join(hubs, ["hub", "copy"]))
    return (both.select("hub", "node", "c", "x", "y").mapInArrow(differ, "hub bigint, node bigint, c bigint, v bigint, e bigint, items array<bigint>")
            .dropDuplicates(["hub", "node", "v"]))


def linked_by_differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join what is linked within each group ``hub, node, c``; members of one ``c`` are joined already.

    With ``dx`` and ``dy`` the differences of two sets x, y from the hub's, x and y
    have ``|dx| + |dy| - 2 |dx & dy|`` items apart, and are linked if that is at
    most ``(100 - percent) / (100 + percent)`` of ``|x| + |y|``. So their excesses,
    ``(100 + percent) |d| - (100 - percent) |x|`` each, say how many differences
    they must share: none, if the sum is not positive, else the sum divided by
    ``2 (100 + percent)``. Whoever needs none with the member of least excess
    is linked with it. The others must share one of their rare differences:
    in one order of a group's items, rarest first, one before the last
    ``need - 1``. Items that one member alone has are shared with nobody, so
    members that need more than they have left meet no one. All of it is exact.
    """
    unit = 2 * (100 + percent)
    diffs = stored(_differences(groups, sets, percent))
    spans = diffs.groupBy("hub").agg(F.min(F.struct("e", "node", "c")).alias("low"), F.max("e").alias("top")).select(
        "hub", "low", F.greatest(F.lit(unit), F.ceil((F.col("top") - F.col("low.e")) / BANDS)).alias("width"))
    placed = diffs.drop("items").join(spans, "hub").withColumn("sure", F.col("e") + F.col("low.e") <= 0)
    sure = placed.where(F.col("sure") & (F.col("node") != F.col("low.node"))).select(F.col("node").alias("a"), F.col("low.node").alias("b"))

    items = diffs.select("hub", "node", "v", F.explode("items").alias("item"))
    counts = items.groupBy("hub", "item").agg(F.count("*").alias("members")).where("members > 1")
    ranked = (items.join(counts, ["hub", "item"]).groupBy("hub", "node", "v")
              .agg(F.sort_array(F.collect_list(F.struct("members", "item"))).getField("item").alias("items")))
    members = stored(placed.join(ranked, ["hub", "node", "v"]).select(
        "hub", "node", "v", F.when(F.col("sure"), F.col("low.c")).otherwise(F.col("c")).alias("c"), "e", "items", F.size("items").alias("size"),
        F.floor((F.col("e") - F.col("low.e")) / F.col("width")).alias("band"), F.col("low.e").alias("least"), "width"))

    def need(x: Column, y: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((x + y) / unit))

    # What a member must show to a band is what the band's least excess asks for.
    shown = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BANDS).cast("bigint"))))
    shown = shown.withColumn("first", F.col("size") - need(F.col("e"), F.col("least") + F.col("other") * F.col("width")) + 1).where("first > 0")
    shown = shown.select("hub", "node", "v", "c", "e", "size", "band", "other", F.posexplode(F.slice("items", F.lit(1), F.col("first").cast("int"))).alias("place", "item"))
    x, y = (shown.select("hub", "item", F.col("band").alias(own), F.col("other").alias(other), *[F.col(k).alias(f"{k}{side}") for k in ("node", "v", "c", "e", "size", "place")])
            for side, own, other in (("a", "low", "high"), ("b", "high", "low")))
    asked = need(F.col("ea"), F.col("eb"))
    within = (F.col("nodea") < F.col("nodeb")) & (F.col("ca") != F.col("cb")) & (F.col("placea") <= F.col("sizea") - asked) & (F.col("placeb") <= F.col("sizeb") - asked)
    on = ["hub", "item", "low", "high"]
    met = x.alias("x").join(y.alias("y"), reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in on]) & within)
    met = met.select(F.col("x.hub").alias("hub"), "nodea", "va", "nodeb", "vb").distinct()
    side = lambda k: members.select("hub", *[F.col(c).alias(f"{c}{k}") for c in ("node", "v", "e", "items")])
    found = (met.join(side("a"), ["hub", "nodea", "va"]).join(side("b"), ["hub", "nodeb", "vb"])
             .where(unit * F.size(F.array_intersect("itemsa", "itemsb")) >= F.col("ea") + F.col("eb")))
    return sure.unionByName(found.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))).distinct()


def _with_components(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of keys that still hold more than one component."""
    named = members.drop("c").join(components.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    return named.drop("size").join(mixed, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Words are runs of anything but blanks, with A-Z in lower case; a set is the
    distinct 4-word shingles, or the whole of a shorter text. Two sets are linked
    if the intersection is at least ``percent`` of the union. ``component_id`` is
    the smallest id that links lead to, the document's own included; the one of
    that id is kept.

    Null and empty texts, and texts of blanks alone, have empty sets and no
    links, not even with each other. Repeated rows of one document have one
    component and are all kept or not. Rows of one id with different texts count
    as one node wherever their id stands for a set. A null id is smaller than
    any other. Other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    described = stored(rows.mapInArrow(_describe, "id bigint, n bigint, k1 bigint, k2 bigint, sig array<bigint>"))
    nodes = stored(described.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "sig")).alias("m"))
                   .select(F.col("m.id").alias("node"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig"), "k1", "k2"))
    keys = nodes.select("node", F.posexplode(chunk_keys(F.col("sig"))).alias("number", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key"))
    degrees = stored(members.groupBy("node").agg(F.sum("size").alias("degree")))
    sets = stored(rows.join(degrees.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(_sets, "id bigint, items binary"))
    facts = stored(nodes.join(degrees, "node").select("node", "n", "sig"))

    def judged(pairs: DataFrame) -> DataFrame:
        x, y = (facts.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
        return (pairs.join(x, "a").join(y, "b").where(_similar_sizes("na", "nb", percent))
                .withColumn("d", distance(F.col("sa"), F.col("sb"))).where(F.col("d") <= MAX_DISTANCE).select("a", "b", "d"))

    # Small plans, each of them stored: the driver plans a whole one anew at each of its stages.
    rest, components = members.withColumn("c", F.col("node")), None
    for _ in range(STAR_ROUNDS):
        pairs = rest.join(_hubs(rest, degrees), "key").where("c != cb").select(F.col("node").alias("a"), "b").distinct()
        # Each node with its nearest hub: one confirmation per node and round.
        nearest = stored(judged(pairs).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
        components = connected_components(confirmed(nearest, sets, percent), components)
        # Keys of one component keep one; those that are left hold all later ones that are mixed.
        rest = stored(_with_components(rest, components))
    small, large = rest.where(F.col("size") <= LARGE).join(facts, "node"), rest.where(F.col("size") > LARGE)
    x, y = (small.select("key", *([] if k == "b" else ["number"]), *[F.col(c).alias(f"{c}{k}") for c in ("node", "c", "n", "sig")]) for k in "ab")
    near = _similar_sizes("na", "nb", percent) & (distance(F.col("siga"), F.col("sigb")) <= MAX_DISTANCE) & _first_shared(F.col("number"), F.col("siga"), F.col("sigb"))
    across = x.join(y, (x.key == y.key) & (F.col("ca") < F.col("cb")) & near).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    groups = stored(_groups(large, degrees))
    late = stored(confirmed(across, sets, percent)).unionByName(stored(linked_by_differences(groups, sets, percent)))
    components = connected_components(late, components)
    named = nodes.join(components, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    out = described.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("c"))
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).cast(docs.schema[id_col].dataType)
    return out.select(back("id").alias(id_col), F.col("n").alias("n_shingles"), back("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


@query("op2_near_dedup", """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN comp USING (doc_id)""")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
