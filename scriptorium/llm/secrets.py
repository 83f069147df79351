"""Secret scans in DataFrame functions only.

Three patterns give the base spans: assignments of keys (assign), access key ids (access) and hexadecimal
runs (hex). The method adds the spans of kind entropy: in every run of ENTROPY_CHARS of at least WINDOW
characters a window of WINDOW characters slides on; the counts of its characters, and with them the sum of
c * log2(c), are kept up to date by the character that enters and the one that leaves. Windows whose
entropy reaches the limit of the run's character class are merged into spans. Runs that hold an entry of
the allow list are suppressed; base spans stay.

Positions come from the lengths of what lies between matches, in code points, end exclusive.

Defined results: a null text counts as empty; a text without spans has empty spans and the digest of the
empty string; a null doc_id is kept as null; repeated rows give a row each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

KINDS = ("assign", "access", "hex", "entropy")
_WORDS = "password|passwd|secret|token|api_?key"
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _WORDS)
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 8
# Greedy runs that may be too short are sought by their least length: the same matches, fewer to drop.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
WINDOW = 20
ENTROPY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: (class, pattern of the whole run, least bits a character in a window); the first that fits counts.
CLASSES = (("digits", "^[0-9]+$", 9.0), ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 2.91), ("letters", "^[A-Za-z]+$", 4.21), ("mixed", "", 3.66))
ALLOW = "(?i)example|sample|dummy|placeholder|changeme|xxxxxx|0123456789|1234567890|abcdefghij"


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """Structs (start, s) of the matches, from what split() leaves between them."""
    between = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,s:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["b"])
        return F.struct((start + F.length(x["s"])).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), x["s"].alias("s")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda s, b: F.struct(s.alias("s"), b.alias("b")))
    none = F.array().cast("array<struct<start:int,s:string>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step, lambda a: a["out"])).otherwise(none)


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("int").alias("end"))


def _spans(placed: Column, kind: str) -> Column:
    return F.transform(placed, lambda x: _span(x["start"], kind, x["start"] + F.length(x["s"])))


def _limit(s: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        out = F.when(s.rlike(pattern), F.lit(least)).otherwise(out)
    return out


def _windows(s: Column) -> Column:
    """Merged windows (a, b) of a run whose entropy reaches the limit; counts change by one in and one out."""
    codes = F.transform(F.regexp_extract_all(s, F.lit("."), 0), lambda c: F.instr(F.lit(ENTROPY_CHARS), c))
    # bound by a transform over one element, so that each is made once a run
    bound = F.transform(F.array(F.struct(codes.alias("codes"), _limit(s).alias("limit"))), lambda v: _slide(v["codes"], v["limit"]))
    return F.flatten(bound)


def _slide(codes: Column, limit: Column) -> Column:
    part = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.array_repeat(F.lit(0), len(ENTROPY_CHARS))
    none = F.array().cast("array<struct<a:int,b:int>>")
    begin = F.struct(F.lit(0).alias("i"), zero.alias("n"), F.lit(0.0).alias("sum"), none.alias("out"))

    def step(state: Column, enters: Column) -> Column:
        i = state["i"] + 1
        leaves = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
        more = F.element_at(state["n"], enters)
        less = F.when(leaves > 0, F.element_at(state["n"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
        same = enters == leaves
        total = F.when(same, state["sum"]).otherwise(state["sum"] + part(more + 1) - part(more) + F.when(leaves > 0, part(less - 1) - part(less)).otherwise(F.lit(0.0)))
        counts = F.when(same, state["n"]).otherwise(F.transform(state["n"], lambda c, j: c + F.when(j + 1 == enters, 1).when(j + 1 == leaves, -1).otherwise(0)))
        found = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= limit)
        return F.struct(i.alias("i"), counts.alias("n"), total.alias("sum"), F.when(found, joined(state["out"], i - WINDOW, i)).otherwise(state["out"]).alias("out"))

    def joined(out: Column, a: Column, b: Column) -> Column:
        last = F.element_at(out, -1)
        alone = F.array(F.struct(a.alias("a"), b.alias("b")))
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), b.alias("b"))))
        return F.when(F.size(out) == 0, alone).when(last["b"] >= a, longer).otherwise(F.concat(out, alone))

    return F.aggregate(codes, begin, step, lambda state: state["out"])


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", allow: str = ALLOW) -> DataFrame:
    """(doc_id, text, base, added): arrays of spans (start, kind, end), in order; kind indexes KINDS."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(ASSIGN), 0).alias("assign"),
        F.when(F.col("text").contains("AKIA"), F.regexp_extract_all("text", F.lit(ACCESS), 0)).otherwise(F.array().cast("array<string>")).alias("access"),
        F.regexp_extract_all("text", F.lit(RUN), 0).alias("run"),
    )
    # a hexadecimal run of 32 lies in a run of ENTROPY_CHARS of 32
    found = found.select("*", F.when(F.exists("run", lambda s: F.length(s) >= 32), F.regexp_extract_all("text", F.lit(HEX), 0)).otherwise(F.array().cast("array<string>")).alias("hex"))
    value = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), 2)).otherwise(F.array().cast("array<string>"))
    found = found.select(
        "doc_id",
        "text",
        F.zip_with(_placed(F.col("text"), ASSIGN, F.col("assign")), value, lambda x, v: F.struct(x["start"].alias("start"), x["s"].alias("s"), v.alias("v"))).alias("assign"),
        _placed(F.col("text"), ACCESS, F.col("access")).alias("access"),
        _placed(F.col("text"), HEX, F.col("hex")).alias("hex"),
        _placed(F.col("text"), RUN, F.col("run")).alias("run"),
    )
    assign = F.filter("assign", lambda x: F.length(x["v"]) >= MIN_ASSIGNED)
    base = F.array_sort(F.concat(_spans(assign, "assign"), _spans(F.col("access"), "access"), _spans(F.col("hex"), "hex")))
    tested = F.filter("run", lambda x: ~x["s"].rlike(allow) & ~x["s"].rlike(CLASSES[0][1]))
    added = F.flatten(F.transform(tested, lambda x: F.transform(_windows(x["s"]), lambda w: _span(x["start"] + w["a"], "entropy", x["start"] + w["b"]))))
    return found.select("doc_id", "text", base.alias("base"), added.alias("added"))


def spelled(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(x) for x in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    a, b, c, r = (quoted(x) for x in (ASSIGN, ACCESS, HEX, RUN))
    limit = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {x}" for _, p, x in CLASSES[:-1])
    match = lambda kind, p, keep: f"""SELECT rid, {kind} AS kind, unnest(regexp_extract_all(text, {p}, 0)) AS s, unnest({keep}) AS v, unnest(string_split_regex(text, {p})[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, {p}, 0), 1) AS i FROM d WHERE regexp_matches(text, {p})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({match(0, a, f"regexp_extract_all(text, {a}, 2)")} UNION ALL {match(1, b, f"regexp_extract_all(text, {b}, 0)")}
      UNION ALL {match(2, c, f"regexp_extract_all(text, {c}, 0)")} UNION ALL {match(3, r, f"regexp_extract_all(text, {r}, 0)")}),
p AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY rid, kind ORDER BY i) - length(s) AS st FROM m),
w AS (SELECT rid, st, unnest(range(0, length(s) - {WINDOW - 1})) AS k, s, CASE {limit} ELSE {CLASSES[-1][2]} END AS least
      FROM p WHERE kind = 3 AND NOT regexp_matches(s, {quoted(ALLOW)})),
h AS (SELECT rid, st, k, list_aggregate(string_split(substr(s, k + 1, {WINDOW}), ''), 'entropy') AS e, least FROM w),
g AS (SELECT rid, st, k, CASE WHEN k - lag(k) OVER (PARTITION BY rid, st ORDER BY k) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM h WHERE e >= least),
n AS (SELECT rid, st, k, sum(fresh) OVER (PARTITION BY rid, st ORDER BY k) AS grp FROM g),
x AS (SELECT rid, kind, st AS a, st + length(s) AS b FROM p WHERE kind < 3 AND (kind > 0 OR length(v) >= {MIN_ASSIGNED})
      UNION ALL SELECT rid, 3, st + min(k), st + max(k) + {WINDOW} FROM n GROUP BY rid, st, grp),
t AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg((['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
             string_agg((['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, kind) AS spans
      FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)
"""


SQL = _sql()
