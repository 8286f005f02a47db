"""Personal data: rules, and boosted trees over what looks like it.

Rules find e-mail and IP addresses, card and phone numbers. Generators of high
recall propose further spans, which may overlap: addresses written out, numbers
without a plus, other groupings. Gradient-boosted trees judge each by its format
and its surroundings, a calibration on held-out spans turns the margin into a
probability, and spans above the limit join the rules' ones, best first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.boosting import BINS, Trees, calibrate, fit_trees
from turnloom.llm.common import byte_blocks, query, table

KINDS = ("email", "ip", "card", "phone", "likely_email", "likely_ip", "likely_card", "likely_phone")
PRECISION = 0.98    # on held-out spans, from which the limit is taken
MIN_LIMIT = 0.9

# --- Fixed values: the rules ---------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# --------------------------------------------------------------------------------

_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")

# Generators of candidates, by kind. All are linear: each begins where its first run does.
_SOFT = (
    ("likely_email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,4}")),
    ("likely_ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,:][0-9]{1,3}){2,5}|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}")),
    ("likely_card", re.compile(r"(?<![0-9])[0-9]{3,19}(?:[\x20./-][0-9]{2,6}){0,5}")),
    ("likely_phone", re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}")),
)
_ANY = re.compile(r"[0-9]{2}|@|[(\[{]at[)\]}]")
_CONTEXT = tuple(re.compile(p, re.I) for p in (
    r"phone|tel\b|tel\.|telefon|tél|call|mobil|móvil|fax|whatsapp|contact",
    r"card|visa|master|amex|carte|karte|tarjeta|cvv|expir",
    r"mail|contact|write|courriel|correo|address",
    r"\bip\b|server|host|addr|login|client|dns",
    r"version|licen[sc]e|section|chapter|page|isbn|issn|no\.|figure|table|art\.|§|\$|€|price|year|since",
))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: back over what may stand before it, then the domain. The same matches as one expression, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, rank, stop`` of the rules' matches, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) < 256 or int(p[-4:]) < 256 and not p[:-4].strip("0") for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``start, rank, stop`` of everything that could be personal data; spans may overlap."""
    if not _ANY.search(text):
        return []
    return [(m.start(), i + 4, m.end()) for i, (_, pattern) in enumerate(_SOFT) for m in pattern.finditer(text) if m.end() - m.start() >= 7]


def describe(text: str, start: int, rank: int, stop: int) -> list[int]:
    """Format and surroundings of a span as small whole numbers."""
    span = text[start:stop]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[start - 1 : start], text[stop : stop + 1]
    around = text[max(0, start - 40) : start]

    def kind(c: str) -> int:
        return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3

    return [
        rank, min(len(span), BINS - 1), min(len(digits), BINS - 1), min(sum(map(str.isalpha, span)), BINS - 1),
        span.count("@") + 2 * bool(re.search(r"[(\[{]at[)\]}]", span)), min(span.count("."), 7), min(span.count("-") + span.count("/"), 7),
        min(span.count(" "), 7), min(span.count("("), 3), int(span[0] == "+"), min(len(groups), 9), min(max(sizes), BINS - 1), min(min(sizes), BINS - 1),
        int(12 <= len(digits) <= 19 and luhn(digits)), int(len(groups) == 4 and span.count(".") == 3 and max(sizes) < 4 and max(map(int, groups)) < 256),
        kind(before), kind(after), min(sizes[-1], 15), min(sizes[0], 15), min(span.count(":"), 7),
        *[int(bool(c.search(around))) for c in _CONTEXT],
    ]


def rewritten(text: str, span: tuple[int, int, int]) -> Iterator[tuple[str, tuple[int, int, int], int]]:
    """Other ways to write a span the rules found, and things that are written like it: text, span, target."""
    start, rank, stop = span
    old = text[start:stop]
    digits = "".join(_DIGITS.findall(old))
    head, tail = text[max(0, start - 60) : start], text[stop : stop + 20]

    def put(new: str, target: int) -> tuple[str, tuple[int, int, int], int]:
        return head + new + tail, (len(head), rank + 4, len(head) + len(new)), target

    if rank == 0:
        name, _, domain = old.partition("@")
        yield put(f"{name} (at) {domain.replace('.', ' (dot) ')}", 1)
        yield put(f"{name}[at]{domain}", 1)
        yield put(f"{name} @ {domain.split('.')[0]}", 0)
    elif rank == 1:
        parts = old.split(".")
        yield put(".".join(parts[:3]), 0)
        yield put(".".join(str(int(p) % 10) for p in parts[:3]), 0)
        yield put(".".join([*parts, parts[0]]), 0)
        yield put(".".join(str(int(p) + 300) for p in parts), 0)
    elif rank == 2:
        yield put(" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), 1)
        yield put(digits[:-1] + str((int(digits[-1]) + 1) % 10), 0)
        yield put(digits[:8], 0)
        yield put(f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", 0)
    elif len(digits) >= 10:
        local = digits[-10:]
        yield put(f"({local[:3]}) {local[3:6]}-{local[6:]}", 1)
        yield put(f"{local[:3]}-{local[3:6]}-{local[6:]}", 1)
        yield put(f"{local[:4]} {local[4:8]}", 0)
        yield put(f"{local[:4]}-{local[4:6]}-{local[6:8]}", 0)
        yield put(f"{local[:2]}.{local[2:4]}.{local[4:8]}", 0)


_AT = re.compile(r"[(\[{]at[)\]}]")
_FOURS = re.compile(r"(?:[0-9]{4}\x20){2,4}[0-9]{1,4}")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\)\x20|[0-9]{3}-)[0-9]{3}-[0-9]{4}")


def may_be_right(text: str, start: int, rank: int, stop: int) -> bool:
    """Whether a candidate is written as ``rewritten`` writes what is right. That no rule confirms it says nothing then."""
    span = text[start:stop]
    if rank == 4:
        return bool(_AT.search(span))
    if rank == 6:
        digits = span.replace(" ", "")
        return bool(_FOURS.fullmatch(span)) and 12 <= len(digits) <= 19 and luhn(digits)
    return rank == 7 and bool(_LOCAL_PHONE.fullmatch(span))


@dataclass(frozen=True)
class SpanModel:
    trees: Trees | None
    slope: float
    offset: float
    limit: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = self.slope * self.trees.margin(np.clip(x, 0, BINS - 1)) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_spans(texts: list[str]) -> SpanModel:
    """Learn from the rules' matches, their rewritings, and candidates that no rule confirms.

    Of the last, those written like a right rewriting have no label and are left out.
    A fifth of the texts is held out for calibration and for the limit, the
    lowest one that keeps PRECISION there. With too few matches nothing is added.
    """
    rows: list[list[int]] = []
    target: list[int] = []
    fold: list[int] = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        here: list[tuple[list[int], int]] = []
        for span in base:
            here.append((describe(text, span[0], span[1] + 4, span[2]), 1))
            here += [(describe(t, *s), y) for t, s, y in rewritten(text, span)]
        for c in candidates(text):
            if not may_be_right(text, *c) and not any(b[0] < c[2] and c[0] < b[2] for b in base):
                here.append((describe(text, *c), 0))
        for x, y in here:
            rows.append(x), target.append(y), fold.append(i % 5 == 0)
    x, y, held = np.array(rows, np.int64), np.array(target, np.float64), np.array(fold, bool)
    if len(y) == 0 or min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 10:
        return SpanModel(None, 1.0, 0.0, 1.0)
    trees = fit_trees(x[~held], y[~held])
    slope, offset = calibrate(trees.margin(np.clip(x[held], 0, BINS - 1)), y[held])
    model = SpanModel(trees, slope, offset, 1.0)
    p = model.probability(x[held])
    order = np.argsort(-p)
    precision = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return SpanModel(trees, slope, offset, max(MIN_LIMIT, float(p[order[good[-1]]])) if len(good) else 1.0)


def added_spans(model: SpanModel, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates above the limit that overlap no rule's match, the most probable first, none over another."""
    if model.trees is None:
        return []
    edges = np.array([(b[0], b[2]) for b in base], np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(edges[:, 1]) if len(edges) else edges[:, 1]

    def free(c: tuple[int, int, int]) -> bool:
        i = int(np.searchsorted(edges[:, 0], c[2], "left"))
        return i == 0 or reach[i - 1] <= c[0]

    open_ = [c for c in candidates(text) if free(c)]
    if not open_:
        return []
    p = model.probability(np.array([describe(text, *c) for c in open_], np.int64))
    taken: list[tuple[int, int, int]] = []
    used = bytearray(max(c[2] for c in open_) + 1) if (p >= model.limit).any() else bytearray()
    for i in np.argsort(-p, kind="stable"):
        if p[i] < model.limit:
            break
        a, _, b = open_[i]
        if not any(used[a:b]):
            used[a:b] = b"\x01" * (b - a)
            taken.append(open_[i])
    return taken


def training_texts(docs: DataFrame, id_col: str, text_col: str, max_docs: int, max_bytes: int) -> list[str]:
    """About ``max_docs`` texts with a digit or an @, spread over the whole table by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"@|[0-9]{2}") & (F.octet_length("t") <= max_bytes))
    n = rows.count()
    spread = F.pmod(F.xxhash64(F.lit("personal data sample"), F.col("i")), F.lit(1 << 30)) / (1 << 30)
    return rows.where(spread < min(1.0, max_docs / max(n, 1))).toArrow().sort_by([("i", "ascending"), ("t", "ascending")])["t"].to_pylist()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 3000, max_bytes: int = 1 << 17) -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base, found`` of every row.

    ``base`` are the rules' matches, ``found`` those and the model's, as arrays
    of ``start, kind, stop`` in code points, by start, then kind. The model is
    fitted on about ``max_docs`` texts of at most ``max_bytes`` bytes that hold a
    digit or an @; every text is searched whole.

    Null and empty texts have no spans. Repeated rows are searched alike. Other
    columns are not looked at.
    """
    model = fit_spans(training_texts(docs, id_col, text_col, max_docs, max_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of trees
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base", "found"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        named = lambda spans: [{"start": a, "kind": KINDS[r], "stop": b} for a, r, b in spans]
        for batch in byte_blocks(batches, "__text"):
            counts, bases, founds = [], [], []
            for t in batch.column("__text").to_pylist():
                base = base_spans(t or "")
                counts.append([sum(s[1] == k for s in base) for k in range(4)])
                bases.append(named(base))
                founds.append(named(sorted([*base, *added_spans(model, t or "", base)])))
            columns = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, k]) for k in range(4)), pa.array(bases, span), pa.array(founds, span)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:bigint,kind:string,stop:bigint>>"
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        search, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base {spans}, found {spans}")


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
