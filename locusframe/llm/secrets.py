"""Secret scans behind a trigram index, in built-in functions only.

From each rule's regular expression follows a Boolean query over trigrams that any match must hold (in lower case): an
OR of ANDs.  The index holds a posting (trigram, document) for each trigram that any rule asks for; the postings of a
conjunction are intersected by counting, a rule's candidates are the union over its conjunctions, and only candidates
are matched against the expression itself.  Rules without mandatory trigrams are matched against every text.

Spans are code points, end exclusive, leftmost and non-overlapping for each rule.

Nulls and odd cases: a null or empty text has no spans; a null doc_id is kept; repeated rows give repeated results;
texts are matched whole; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import keeps_columns, table


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.  [0-9a-f]+ of 24 and more characters are the runs that [0-9a-f]{24,} matches, and
# AKIA[A-Z0-9]+ of 20 and more those of AKIA[A-Z0-9]{16,}: a later start within the same run would be shorter still.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of further credentials.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + FURTHER
#: Most strings kept as the exact alternatives of a part of an expression.
ALTERNATIVES = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed part matches, in lower case, if they are few; None else."""
    out = {""}
    for op, arg in node:
        if op is rc.LITERAL:
            part = {chr(arg).lower()}
        elif op is rc.IN and all(o in (rc.LITERAL, rc.RANGE) for o, _ in arg):
            part = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if o is rc.RANGE else [a])}
        elif op is rc.SUBPATTERN:
            part = _strings(arg[-1])
        elif op is rc.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op is rc.MAX_REPEAT and arg[1] <= 2:
            once = _strings(arg[2])
            part = None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
        else:
            part = None
        if part is None or len(out) * len(part) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of which a matching text fulfils at least one; None if the expression has no mandatory trigram.

    The expression is read as a row of parts.  Runs of parts with few exact strings give an OR of the strings' trigrams;
    the run with the longest shortest string is the most selective and becomes the query.
    """
    runs: list[set[str]] = []
    run = {""}
    for part in rp.parse(pattern):
        strings = _strings([part])
        if strings is None or len(run) * len(strings) > ALTERNATIVES:
            runs.append(run)
            run = strings or {""}
            if strings is None and part[0] is rc.MAX_REPEAT and part[1][0] >= 1 and (inner := _strings(part[1][2])) is not None:
                runs.append(inner)
        else:
            run = {a + b for a in run for b in strings}
    runs.append(run)
    best = max(runs, key=lambda r: min(len(s) for s in r))
    return None if min(len(s) for s in best) < 3 else sorted({_trigrams(s) for s in best}, key=sorted)


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """texts: (key, text).  (key, kinds): the rules for which a text's trigrams fulfil the query."""
    spark = texts.sparkSession
    terms = [(r.kind, i, len(c), t) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for t in sorted(c)]
    asked = sorted({t[3] for t in terms})
    folded = texts.select("key", F.lower("text").alias("folded"))
    index = folded.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in asked]))).alias("trigram"))
    # as many rows as the rules have trigrams
    query = F.broadcast(spark.createDataFrame(terms, "kind string, conjunction int, wanted int, trigram string"))
    met = index.join(query, "trigram").groupBy("key", "kind", "conjunction", "wanted").agg(F.countDistinct("trigram").alias("found"))
    return met.filter("found = wanted").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, no: int) -> Column:
    """Array of (start, no, end, kind)."""
    return pattern_spans(text, F.lit(rule.pattern), no, rule.kind, rule.group, rule.least)


def pattern_spans(text: Column, pattern: Column, no: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, no, end, kind) of a pattern, which may differ by row.  The pieces between the matches and the
    matches themselves, in turn, make up the text, so their lengths give the places."""
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("between"), whole.alias("found"), counted.alias("counted"))
    empty = F.expr("cast(array() as array<struct<start:int, no:int, end:int, kind:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"))
        counts = x["found"].isNotNull() & (F.length(x["counted"]) >= least)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(counts, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.rlike(text, pattern), found).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs: (doc_id, text).  doc_id, text and secret_spans, an array of (start, no, end, kind) in order.

    A document's key is a hash of its row: should two rows share one, both are candidates and the match decides.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = keyed.join(candidates(keyed.select("key", "text"), rules), "key", "left")
    spans = [F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), r, i)) if trigram_query(r.pattern) else matches(F.col("text"), r, i) for i, r in enumerate(rules)]
    empty = F.expr("cast(array() as array<struct<start:int, no:int, end:int, kind:string>>)")
    return found.select("doc_id", "text", F.array_sort(F.concat(*[F.coalesce(s, empty) for s in spans])).alias("secret_spans"))


def told(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["no"] < len(BASE))
    count = lambda no: F.size(F.filter("secret_spans", lambda s: s["no"] == no)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"))


@keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each secret is replaced by its kind in angle brackets; where spans overlap, their union is replaced
    under the kind of the first.  All documents stay."""
    columns = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = keyed.join(candidates(keyed.select(F.col("_key").alias("key"), "text")), F.col("_key") == F.col("key"), "left")
    spans = [F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), r, i)) if trigram_query(r.pattern) else matches(F.col("text"), r, i) for i, r in enumerate(RULES)]
    empty = F.expr("cast(array() as array<struct<start:int, no:int, end:int, kind:string>>)")
    found = found.withColumn("_spans", F.array_sort(F.concat(*[F.coalesce(s, empty) for s in spans])))

    def step(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["at"]
        shown = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(over, acc["out"]).otherwise(shown).alias("out"))

    masked = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("_spans") > 0, masked).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns])


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    ctes, parts = [], []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        ctes.append(
            f"m{i} AS (SELECT rid, regexp_extract_all(text, {p}) AS f, regexp_extract_all(text, {p}, {r.group}) AS g, string_split_regex(text, {p}) AS b FROM d),\n"
            f"s{i} AS (SELECT rid, unnest(range(1, len(f) + 1)) AS j, f, g, b FROM m{i} WHERE len(f) > 0),\n"
            f"p{i} AS (SELECT rid, {i} AS no, '{r.kind}' AS kind, (list_sum(list_transform(b[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:j-1], lambda x: length(x))), 0))::BIGINT AS s, length(f[j]) AS n FROM s{i} WHERE length(g[j]) >= {r.least})"
        )
        parts.append(f"SELECT * FROM p{i}")
    counts = ", ".join(f"count(*) FILTER (no = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\n" + ",\n".join(ctes) + ",\nu AS (" + " UNION ALL ".join(parts) + "),\n"
        f"a AS (SELECT rid, {counts}, coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER (no < {len(BASE)}), '') AS base,"
        " string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) AS spans FROM u GROUP BY rid)\n"
        "SELECT doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"
    )


ORACLE = _oracle()
