"""Secret scan with DataFrame functions only.

Rules find assignments, access keys and long hexadecimal strings. Other strings
of 20 and more characters with a digit are candidates: a window slides over
each, one character enters and one leaves the counts per step, and the window of
largest Shannon entropy decides, by a limit per character class. An allow-list
of things that only look random suppresses candidates, never rule matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import query, table

# --- Fixed values: the rules ---------------------------------------------------
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
# --------------------------------------------------------------------------------

KINDS = ("assign", "access", "hex", "entropy")
RUN = r"[A-Za-z0-9+/_-]"
MIN_RUN = 20
WINDOW = 20
#: Bits per character above which a window of each class is no word, number or name.
MIN_BITS = {"hex": 3.0, "base64": 3.9}
ALPHABET = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}

# A run is entered at its first character only, and has a digit; an assignment is consumed, whatever its value.
_CANDIDATE = rf"{ASSIGN}|(?<!{RUN})(?=[A-Za-z+/_-]*+[0-9]){RUN}{{{MIN_RUN},}}"

#: Looks random and is none: UUIDs, numbers with signs, placeholders, counting or repeating strings, paths, digests of nothing.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]+$",
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]?|xxxx|lorem",
    r"(?i)0123456789|123456789|abcdefgh|qwerty",
    r"^(.{1,8}?)\1+$",
    r"^/?([A-Za-z0-9_-]{1,14}/)+[A-Za-z0-9_-]{0,14}$",
    r"^([A-Za-z]+[_-])+[A-Za-z0-9]{0,8}$",
    r"^d41d8cd98f00b204e9800998ecf8427e|^da39a3ee5e6b4b0d3255bfef95601890afd80709|^e3b0c44298fc1c149afbf4c8996fb924",
)


def running_sum(numbers: Column) -> Column:
    """Inclusive sums of an array, by doubling steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, numbers, lambda acc, k: F.transform(
        acc, lambda x, i: x + F.when(i >= F.pow(F.lit(2), k).cast("int"), F.get(acc, i - F.pow(F.lit(2), k).cast("int"))).otherwise(0)))


def placed(found: Column, gaps: Column) -> Column:
    """``start, stop, text`` of matches, from them and the text between them; in code points."""
    steps = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
    return F.transform(F.arrays_zip(found.alias("text"), running_sum(steps).alias("stop")), lambda s: F.struct(
        (s["stop"] - F.char_length(s["text"])).alias("start"), s["stop"].alias("stop"), s["text"].alias("text")))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns worked out once per row, behind a one-row generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def window_bits(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest entropy of any window, from counts that one entering and one leaving character change."""
    order = F.lit(alphabet)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(order, c))
    none = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def log_term(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            comes, goes = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(-1)
            n_in = F.get(acc["counts"], comes)
            n_out = F.coalesce(F.get(acc["counts"], goes), F.lit(0))
            same = comes == goes
            total = acc["sum"] + F.when(same, 0.0).otherwise(
                log_term(n_in + 1) - log_term(n_in) + F.when(goes >= 0, log_term(n_out - 1) - log_term(n_out)).otherwise(0.0))
            counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == comes, 1).otherwise(0) - F.when(j == goes, 1).otherwise(0))
            bits = math.log2(window) - total / window
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), none, step, lambda acc: F.round(acc["best"], 6))

    # One element, so that the codes are worked out once and not at every step.
    return F.get(F.transform(F.array(codes), slide), 0)


def _suspicious(candidate: Column) -> Column:
    bare = candidate.rlike(rf"^{RUN}{{{MIN_RUN},}}$")
    known = candidate.rlike(rf"{HEX[:-1]}{{{MIN_HEX},}}|{ACCESS[:-1]}{{{MIN_ACCESS - 4},}}")  # a rule has it
    hexadecimal = candidate.rlike("^[0-9a-fA-F]+$")
    bits = F.when(hexadecimal, window_bits(F.lower(candidate), ALPHABET["hex"]) >= MIN_BITS["hex"]).otherwise(
        window_bits(candidate, ALPHABET["base64"]) >= MIN_BITS["base64"])
    return F.when(bare & ~known & ~candidate.rlike("|".join(f"(?:{p})" for p in ALLOWED)), bits).otherwise(False)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base, found`` of every row.

    ``base`` are the rules' matches, each rule from the left without overlaps,
    those that are too short left out; ``found`` adds the candidates of high
    entropy. Both are arrays of ``start, rank, stop, kind`` in code points, by
    start, then kind.

    Null and empty texts have none. Row by row, without a shuffle; repeated rows
    are scanned alike. Places are summed by doubling, so a text of very many
    matches costs little more than its length. Other columns are not looked at.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    nothing, no_gap = F.array().cast("array<string>"), F.array().cast("array<string>")

    def all_of(pattern: str, group: int = 0) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(nothing)

    def gaps(found: str, pattern: str) -> Column:
        return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(no_gap)

    long_hex, long_access = f"{HEX[:-1]}{{{MIN_HEX},}}", f"{ACCESS[:-1]}{{{MIN_ACCESS - 4},}}"  # whole runs either way
    matched = computed(rows, [id_col, "__text"], m1=all_of(ASSIGN), m2=all_of(long_access), m3=all_of(long_hex), m4=all_of(_CANDIDATE))
    split = computed(matched, [id_col, "m1", "m2", "m3", "m4"],
                     v1=F.when(F.size("m1") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(nothing),
                     g1=gaps("m1", ASSIGN), g2=gaps("m2", long_access), g3=gaps("m3", long_hex), g4=gaps("m4", _CANDIDATE))

    def spans(n: int, fits) -> Column:
        here = F.filter(placed(F.col(f"m{n}"), F.col(f"g{n}")), fits)
        return F.transform(here, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), s["stop"].alias("stop"), F.lit(KINDS[n - 1]).alias("kind")))

    def when_any(n: int, value: Column) -> Column:
        return F.when(F.size(f"m{n}") > 0, value).otherwise(F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>"))

    found = computed(split, [id_col],
                     s1=when_any(1, spans(1, lambda s, i: F.char_length(F.get(F.col("v1"), i)) >= MIN_VALUE)),
                     s2=when_any(2, spans(2, lambda s: F.lit(True))), s3=when_any(3, spans(3, lambda s: F.lit(True))),
                     s4=when_any(4, spans(4, lambda s: _suspicious(s["text"]))))
    return computed(found, [id_col, "s1", "s2", "s3"], base=F.array_sort(F.concat("s1", "s2", "s3")), found=F.array_sort(F.concat("s1", "s2", "s3", "s4"))).select(
        id_col, *[F.size(f"s{i}").cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS[:3], 1)], "base", "found")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _oracle() -> str:
    """The same spans in SQL: matches and the text between them give places, windows are counted one by one."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    rules = {1: ASSIGN, 2: f"{ACCESS[:-1]}{{{MIN_ACCESS - 4},}}", 3: f"{HEX[:-1]}{{{MIN_HEX},}}", 4: f"{ASSIGN}|{RUN}{{{MIN_RUN},}}"}
    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS rank, regexp_extract_all(t, {quote(p)}) AS m, regexp_extract_all(t, {quote(p)}, {2 if n == 1 else 0}) AS v, string_split_regex(t, {quote(p)}) AS g FROM texts"
        for n, p in rules.items())
    allowed = " OR ".join(f"regexp_matches(s, {quote(p)})" for p in ALLOWED if "\\1" not in p)
    listed = lambda which: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({which}), '')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
matches AS (
  SELECT doc_id, rank, [{", ".join(quote(k) for k in KINDS)}][rank] AS kind, m[i] AS s, v[i] AS value,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found)),
placed AS (SELECT *, start + length(s) AS stop FROM matches WHERE rank <> 1 OR length(value) >= {MIN_VALUE}),
candidates AS (
  SELECT DISTINCT s FROM placed
  WHERE rank = 4 AND regexp_full_match(s, {quote(f"{RUN}{{{MIN_RUN},}}")}) AND regexp_matches(s, '[0-9]')
    AND NOT regexp_matches(s, {quote(rules[2])}) AND NOT regexp_matches(s, {quote(rules[3])}) AND NOT ({allowed})
    AND NOT list_bool_or(list_transform(range(1, 9), lambda k: length(s) % k = 0 AND length(s) > k AND repeat(substr(s, 1, k), (length(s) // k)::BIGINT) = s))),
classed AS (SELECT s, regexp_full_match(s, '[0-9a-fA-F]+') AS is_hex FROM candidates),
windows AS (SELECT s, is_hex, CASE WHEN is_hex THEN lower(s) ELSE s END AS c, unnest(generate_series(1, length(s) - {WINDOW - 1})) AS p FROM classed),
counts AS (
  SELECT s, is_hex, p, x, count(*) AS n FROM (SELECT s, is_hex, p, substr(c, p + j, 1) AS x FROM windows, range({WINDOW}) r(j)) GROUP BY ALL),
bits AS (SELECT s, is_hex, p, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS b FROM counts GROUP BY ALL),
suspicious AS (SELECT s FROM bits GROUP BY s, is_hex HAVING round(max(b), 6) >= CASE WHEN is_hex THEN {MIN_BITS["hex"]} ELSE {MIN_BITS["base64"]} END),
spans AS (SELECT * FROM placed WHERE rank < 4 OR s IN (SELECT s FROM suspicious))
SELECT doc_id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
       sha256({listed("rank < 4")}) AS base_sha256, {listed("rank < 5")} AS spans
FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


@query("op7_secrets", _oracle())
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
