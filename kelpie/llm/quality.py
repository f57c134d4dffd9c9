"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured (words, symbols, repeated lines, repeated three-word windows). The failures of each rule are
summed by host, the rates of all hosts give an empirical beta prior for the rule (moments), each host's rate is shrunk
towards it, and a host whose shrunk rate is over the rule's limit gets a verdict against that rule. Verdicts are joined
back: a document goes if it fails a base rule, or if it fails a rule that its host as a whole fails too. Documents that
fail nothing stay whatever their host.

Defined results. A null text has no words. A null host is a host of its own. Ties and repeated rows count as rows. An
empty table gives an empty table. Extra columns are ignored.

Repeated windows are found inside the row, by sorting: 34 bits of each window's hash above its 30-bit position are
sorted as plain longs, neighbours with equal hash bits are candidates, and the candidates' own words, sorted, decide.
So a text of n words costs n log n, however often its windows repeat, and no word is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Parameters: the limit of a host's shrunk failure rate for each rule.
HOST_LIMITS = {"short": 0.5, "repeats": 0.3, "symbols": 0.3, "dup_lines": 0.3}
POSITION_BITS = 30


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(arr: Column, f) -> Column:
    """f over neighbours of a non-empty array."""
    n = F.size(arr) - 1
    return F.zip_with(F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(2), n), f)


def _repeated_words(w: Column) -> Column:
    """Words of w that lie in a three-word window found twice or more."""
    none = F.array().cast("array<bigint>")

    def window_key(i):
        h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("bigint"))

    keys = F.when(F.size(w) < 3, none).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window_key)))

    def candidates(s):
        same = lambda a, b: F.when(F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS), F.array(a, b))
        found = F.flatten(F.filter(_pairs(s, same), lambda x: x.isNotNull()))
        return F.when(F.size(s) < 2, none).otherwise(F.array_distinct(found))

    def exact(c):
        def spelled(key):
            i = key.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
            return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.cast("bigint").alias("p"))

        def positions(s):
            same = lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"]))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(_pairs(s, same), lambda x: x.isNotNull()))))

        return F.when(F.size(c) < 2, none).otherwise(let(F.sort_array(F.transform(c, spelled)), positions))

    def covered(p):
        steps = _pairs(p, lambda a, b: F.least(b - a, F.lit(3).cast("bigint")))
        return F.when(F.size(p) == 0, F.lit(0).cast("bigint")).otherwise(
            F.aggregate(steps, F.lit(3).cast("bigint"), lambda acc, x: acc + x)
        )

    return let(let(let(keys, candidates), exact), covered)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(common.WORD)))
    big = lambda c: c.cast("bigint")
    of_words = let(
        F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)),
        lambda w: F.struct(
            big(F.size(w)).alias("n_words"), big(F.length(F.array_join(w, ""))).alias("word_chars"), _repeated_words(w).alias("n_repeat_words")
        ),
    )
    of_lines = let(lines, lambda x: F.struct(big(F.size(x)).alias("n_lines"), big(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    symbols = big(F.regexp_count(text, F.lit(r"[#*$%&|<>]")))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))
    return out.select(
        "doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words"
    )


def failures() -> dict[str, Column]:
    """The rules, each true where the document fails it. short and repeats are the base rules."""
    c = F.col
    return {
        "short": c("n_words") < 50,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def host_verdicts(measured: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """host, and bad_<rule> for each rule: the shrunk failure rate is over the limit.

    The prior of a rule has the hosts' mean rate m and variance v (each host once): a + b = m (1 - m) / v - 1, held
    within 1 and 1000 (1000 where all hosts agree)."""
    rules = failures()
    per_host = measured.groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.when(f, 1).otherwise(0)).alias(f"k_{r}") for r, f in rules.items()]
    )
    prior = per_host.agg(
        *[x for r in rules for rate in [F.col(f"k_{r}") / F.col("n")] for x in (F.avg(rate).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}"))]
    )
    of_all = prior.first()  # one row of two numbers for each rule
    out = per_host
    for r in rules:
        m, v = F.lit(of_all[f"m_{r}"]).cast("double"), F.lit(of_all[f"v_{r}"]).cast("double")
        strength = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(F.try_divide(m * (1 - m), v) - 1, F.lit(1000.0))))
        shrunk = (F.col(f"k_{r}") + strength * m) / (F.col("n") + strength)
        out = out.withColumn(f"bad_{r}", shrunk > limits[r])
    return out.select("host", *[f"bad_{r}" for r in rules])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """The measures of every document with base_failed, host_failed and kept."""
    m = common.written(measures(docs, id_col, text_col, host_col), "quality-measures")
    v = common.written(host_verdicts(m, limits), "quality-hosts").withColumnRenamed("host", "v_host")
    rules = failures()
    base = rules["short"] | rules["repeats"]
    of_host = F.lit(False)
    for r, f in rules.items():
        of_host = of_host | (f & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    # Hosts can be as many as documents, so nothing forces a broadcast; a hot host is split by adaptive execution.
    return m.join(v, F.col("host").eqNullSafe(F.col("v_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), of_host.alias("host_failed"), (~base & ~of_host).alias("kept"),
    )


def op3_host_quality(spark, sf_dir: str) -> DataFrame:
    return judged(common.documents(spark, sf_dir)).drop("host_failed")


def _rule_sql(rule: str, limit: float) -> str:
    s = f"greatest(1.0::double, least(1000.0::double, coalesce(CASE WHEN v_{rule} <> 0 THEN m_{rule} * (1 - m_{rule}) / v_{rule} END - 1, 1000.0::double)))"
    return f"(k_{rule} + {s} * m_{rule}) / (n + {s}) > {limit}::double AS bad_{rule}"


_FAIL = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
SQL = {
    "op3_host_quality": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, host, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
        len(ls)::bigint AS n_lines, coalesce(p.n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN p USING (rid)),
h AS (SELECT host, count(*) AS n, {', '.join(f'sum(CASE WHEN {f} THEN 1 ELSE 0 END) AS k_{r}' for r, f in _FAIL.items())} FROM m GROUP BY host),
q AS (SELECT {', '.join(f'avg(k_{r} / n) AS m_{r}, var_pop(k_{r} / n) AS v_{r}' for r in _FAIL)} FROM h),
v AS (SELECT host AS v_host, {', '.join(_rule_sql(r, x) for r, x in HOST_LIMITS.items())} FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({_FAIL['short']} OR {_FAIL['repeats']}) AS base_failed,
  NOT ({_FAIL['short']} OR {_FAIL['repeats']} OR {' OR '.join(f'(({f}) AND bad_{r})' for r, f in _FAIL.items())}) AS kept
FROM m LEFT JOIN v ON host IS NOT DISTINCT FROM v_host
"""
}
