import random
from collections import defaultdict

import pytest

from turnloom.llm.line_dedup import drop_repeated_lines, dropped_lines, keep_bitmaps, pack_bitmap


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def expected(docs, min_length=20, min_docs=3):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                holders[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        at = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= min_length and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != at)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


POOL = ["x" * 25, "Y" * 30 + " ", "  " + "y" * 30, "short", "z" * 20, "a hot line that nearly every document has", "", "A line of length twenty one"]


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (7, 3), (40, 50)])
def test_equals_loop(llm, partitions, batch):
    """Lines over one and many ranges, and batches of a few rows, so that lines cross all borders."""
    rng = random.Random(partitions)
    docs = [(i, None if rng.random() < 0.1 else "\n".join(rng.choice(POOL) if rng.random() < 0.8 else f"other {rng.randint(0, 60)} line with number" for _ in range(rng.randint(0, 9)))) for i in range(250)]
    before = llm.conf.get("spark.sql.shuffle.partitions")
    llm.conf.set("spark.sql.shuffle.partitions", partitions)
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = drop_repeated_lines(llm.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)
        llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == expected(docs)


def test_edge_rows(edge, nothing):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, drop_repeated_lines(edge).collect()), key=str) == expected(docs)
    assert drop_repeated_lines(nothing).count() == 0


def test_bitmaps_replace_text(edge):
    assert keep_bitmaps(edge).columns == ["id", "version", "keep_bitmap"]
    for dropped in ([0], [7], [8], [3, 90, 1000]):
        assert dropped_lines(pack_bitmap(dropped)) == dropped
    assert dropped_lines(None) == []
