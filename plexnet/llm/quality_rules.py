"""Risk-controlled quality rules (operator 1, DataFrame only).

Each rule rejects a text whose metric exceeds a cutoff. Labelled texts choose
the cutoffs per stratum (language) in two folds:

1. *Choice* (crc32(doc_id) even): per stratum and rule, the cutoff of the
   rule's grid with the most bad texts caught, at a price of ``PRICE`` per good
   text rejected; rules that gain nothing are left out, the rest are ranked by
   gain. Configuration t is the union of the first t rules.
2. *Certificate* (odd): configurations are tested in that fixed order against
   H0 "more than ``RISK`` of the stratum's good texts are rejected". With n good
   texts of which k are rejected, the exact binomial p-value is
   P(Bin(n, RISK) <= k); a configuration passes when p <= DELTA / strata
   (Bonferroni over strata; within a stratum the fixed sequence stops at the
   first failure, so no further correction is needed).

With probability 1 - DELTA, at once for all strata, at most RISK of the good
texts are rejected. A stratum with too few labels certifies nothing and keeps
every text the base rules keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import crc_mod, flat_text, materialize, read_table, words_of

RISK, DELTA, PRICE = 0.05, 0.05, 3
#: A table of certified rules of so many strata is broadcast (some 200 bytes
#: each); a larger one is joined by a shuffle.
BROADCAST_STRATA = 10_000

#: rule -> (metric, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / n_words", [1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", [0.7, 0.5, 0.3, 0.2, 0.1]),
    "upper": ("n_upper / word_chars", [0.6, 0.4, 0.3, 0.2, 0.15]),
    "exclaims": ("n_exclaims / n_words", [0.7, 0.5, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.4, 0.3, 0.2, 0.15, 0.1]),
}
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
METRIC_COLUMNS = BASE_COLUMNS + ["n_lines", "n_upper", "n_exclaims"]


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


#: Words in 3-word windows that occur at least twice. The windows are sorted
#: with their places only if some window repeats; a repeated window's place
#: has an equal neighbour, and it covers three words.
_REPEATS = """CASE WHEN size(_w3) = size(array_distinct(_w3)) THEN 0L ELSE
  cast(size(array_distinct(flatten(transform(
    transform(array(sort_array(transform(_w3, (w, i) -> struct(w AS w, i AS i)))), s ->
      filter(s, (x, j) -> coalesce(x.w = get(s, j - 1).w, false) OR coalesce(x.w = get(s, j + 1).w, false)))[0],
    x -> array(x.i, x.i + 1, x.i + 2))))) AS bigint) END"""


def with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_m`` of the metrics of ``text``; all
    other columns stay. Null and blank texts count 0 everywhere."""
    t, words = F.coalesce(F.col("text"), F.lit("")), F.col("_words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(flat_text(x)) != "")
    step = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines)
    w3 = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.concat_ws(
        " ", w, F.get(words, i + 1), F.get(words, i + 2)))
    step = step.withColumn("_w3", w3)
    blank = F.translate(t, " \t\n\x0b\x0c\r", "")
    m = F.struct(
        F.size(words).cast("bigint").alias("n_words"), F.length(blank).cast("bigint").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"), F.size("_lines").cast("bigint").alias("n_lines"),
        _count_of(t, UPPER).alias("n_upper"), _count_of(t, "!").alias("n_exclaims"))
    return step.withColumn("_m", m).drop("_words", "_lines", "_w3")


def _metric(rule: str, prefix: str = "_m.") -> Column:
    top, _, below = RULES[rule][0].partition(" / ")
    return F.coalesce(F.try_divide(F.col(prefix + top), F.col(prefix + below)), F.lit(0.0))


def base_failed(prefix: str = "_m.") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 50) | (F.col(prefix + "n_repeat_words") * 100 > n * 50)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly term by term."""
    log = lambda i: (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                     + i * math.log(p) + (n - i) * math.log1p(-p))
    return 1.0 if k >= n else math.fsum(math.exp(log(i)) for i in range(k + 1))


def _plans(spark: SparkSession, plans: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """(_stratum, _plan): the rules of each stratum in their order, as numbers and cutoffs."""
    order = list(RULES)
    rows = [(s, [(order.index(r), float(c)) for r, c in plan]) for s, plan in plans.items() if plan]
    df = spark.createDataFrame(rows, "_stratum string, _plan array<struct<rule:int,cutoff:double>>")
    return F.broadcast(df) if len(rows) <= BROADCAST_STRATA else df


def _first_hit() -> Column:
    """Place (from 1) of the first rule of ``_plan`` that rejects the text; null if none does."""
    values = F.array(*(_metric(r) for r in RULES))
    hits = F.transform("_plan", lambda p, i: F.when(F.get(values, p["rule"]) > p["cutoff"], i + 1))
    return F.array_min(F.coalesce(F.filter(hits, lambda x: x.isNotNull()), F.array().cast("array<int>")))


def choose_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict:
    """Certified rules per stratum from ``labelled(stratum, choice, good, _m)``.

    Returns stratum -> list of (rule, cutoff) under ``rules``, and per-stratum
    figures under ``report``. Every stratum stands for itself, however many
    there are. Only counts come to the driver: at most 32 rows a stratum.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), _metric(r).alias("x"))
                               for r, (_, cuts) in RULES.items() for c in cuts])).alias("g")
    hits = labelled.where("choice").select("stratum", "good", grid).groupBy("stratum", "g.rule", "g.cutoff").agg(
        F.count_if(F.col("good") & (F.col("g.x") > F.col("g.cutoff"))).alias("k_good"),
        F.count_if(~F.col("good") & (F.col("g.x") > F.col("g.cutoff"))).alias("k_bad")).where(F.col("k_bad") > PRICE * F.col("k_good")).collect()
    best: dict = {}
    for h in hits:
        key = (h.k_bad - PRICE * h.k_good, h.cutoff)  # of equal gain, the more lenient cutoff
        if key > best.setdefault(h.stratum, {}).get(h.rule, (0, 0.0)):
            best[h.stratum][h.rule] = key
    order = list(RULES)
    plans = {s: sorted(((r, c) for r, (_, c) in b.items()), key=lambda x: (-best[s][x[0]][0], order.index(x[0])))
             for s, b in best.items()}
    judged = labelled.where("NOT choice AND good").join(_plans(labelled.sparkSession, plans), F.col("stratum") == F.col("_stratum"), "left")
    first = F.coalesce(_first_hit(), F.lit(len(RULES) + 1))  # the first configuration that rejects the text
    counts: dict = {}
    for r in judged.groupBy("stratum", first.alias("t")).count().collect():
        counts.setdefault(r.stratum, {})[r.t] = r["count"]
    n_strata = max(1, labelled.select("stratum").distinct().count())
    out, report = {}, {}
    for s, plan in plans.items():
        n, k, passed = sum(counts.get(s, {}).values()), 0, 0
        for t in range(1, len(plan) + 1):
            k += counts.get(s, {}).get(t, 0)
            if n == 0 or binomial_tail(k, n, risk) > delta / n_strata:
                break
            passed = t
        out[s] = plan[:passed]
        report[s] = {"good": n, "plan": plan, "certified": passed}
    return {"rules": out, "report": report}


def label_stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("(none)"))


def with_verdict(measured: DataFrame, chosen: dict) -> DataFrame:
    """``measured(lang, _m, ...)`` with ``_kept``: true when the base rules and
    the certified rules of the text's own stratum keep it. A stratum without
    certified rules, or without any label, is judged by the base rules alone."""
    plans = _plans(measured.sparkSession, chosen["rules"])
    joined = measured.join(plans, label_stratum(F.col("lang")) == F.col("_stratum"), "left")
    return joined.withColumn("_kept", ~base_failed() & _first_hit().isNull()).drop("_stratum", "_plan")


def fit_rules(spark: SparkSession, measured: DataFrame, labels: DataFrame) -> dict:
    """Cutoffs from ``measured(doc_id, lang, _m)`` joined with ``labels(doc_id,
    quality)``. Rows with a null id or label teach nothing; of repeated labels
    of one id, a text is good only if all say so. Texts the base rules reject
    are left out: the risk is that of the method's own verdict. All labels
    count, whatever their number."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") > 0).alias("good"))
    joined = measured.where(~base_failed()).select("doc_id", "lang", "_m").join(lab, "doc_id")
    labelled = materialize(spark, joined.select(
        label_stratum(F.col("lang")).alias("stratum"), (crc_mod(F.col("doc_id"), 2) == 0).alias("choice"),
        "good", "_m"), "labelled")
    return choose_cutoffs(labelled)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, ...)``: doc_id, the
    metrics, base_failed, kept. Null text has no words and fails the base;
    ties and repeated rows are judged alike; texts of any length are measured
    whole; a null lang is a stratum of its own; extra columns are ignored; an
    empty table gives an empty result. Texts are read once: metrics go to the
    shared folder and serve both the choice of cutoffs and the verdicts."""
    measured = materialize(spark, with_metrics(docs.select("doc_id", "text", "lang")).drop("text"), "metrics")
    chosen = fit_rules(spark, measured, labels)
    return with_verdict(measured, chosen).select("doc_id", *[F.col("_m." + c).alias(c) for c in METRIC_COLUMNS],
                                                 base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects, columns unchanged.
    The rows are written once with their metrics: the choice of cutoffs reads
    only the metrics, and no filter is pushed below their computation."""
    clash = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    back = {v: k for k, v in clash.items()}
    measured = materialize(spark, with_metrics(docs.withColumnsRenamed(clash)), "measured")
    chosen = fit_rules(spark, measured, labels)
    return with_verdict(measured, chosen).where("_kept").select(*[F.col(c).alias(back.get(c, c)) for c in measured.columns if c != "_m"])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return judge(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", *BASE_COLUMNS, "base_failed", "kept")


def _sql_metrics() -> str:
    cnt = lambda chars: f"CAST(length(t) - length(translate(t, '{chars}', '')) AS BIGINT)"
    return rf"""
t0 AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
t1 AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM t0),
t2 AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         {cnt(SYMBOLS)} AS n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(len(ln) AS BIGINT) AS n_lines, {cnt(UPPER)} AS n_upper, {cnt('!')} AS n_exclaims,
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS w3 FROM t1),
t3 AS (SELECT doc_id, unnest(w3) AS g, unnest(range(0, len(w3))) AS i FROM t2),
t4 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t3),
t5 AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t4 WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(lang, '(none)') AS stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_exclaims,
        CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(r, 0) > 50 * n_words AS base_failed
      FROM t2 LEFT JOIN t5 USING (doc_id))"""


def op1_sql() -> str:
    """The method in DuckDB SQL."""
    order = {r: i for i, r in enumerate(RULES)}
    value = "CASE rule " + " ".join(
        "WHEN '{}' THEN coalesce({} * 1.0 / nullif({}, 0), 0.0)".format(r, *f.split(" / ")) for r, (f, _) in RULES.items()) + " END"
    grid = ", ".join(f"('{r}', {order[r]}, CAST({c} AS DOUBLE))" for r, (_, cuts) in RULES.items() for c in cuts)
    return f"""WITH RECURSIVE {_sql_metrics()},
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c
  FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL) d
  UNION ALL  -- CRC-32, one bit a step (reflected polynomial 0xEDB88320)
  SELECT doc_id, s, i + 1, xor(b // 2, (b % 2) * 3988292384) FROM (SELECT *, CASE WHEN i % 8 = 0
    THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END AS b FROM crc WHERE i < 8 * length(s)) d),
lab AS (SELECT l.doc_id, min(quality) > 0 AS good, any_value(xor(c, 4294967295) % 2 = 0) AS choice FROM labels l
        JOIN crc ON crc.doc_id = l.doc_id AND i = 8 * length(s) WHERE quality IS NOT NULL GROUP BY l.doc_id),
x AS (SELECT m.*, good, choice FROM m JOIN lab USING (doc_id) WHERE NOT base_failed),
grid(rule, pos, cutoff) AS (VALUES {grid}),
v AS (SELECT stratum, good, choice, doc_id, rule, pos, cutoff, {value} > cutoff AS hit FROM x CROSS JOIN grid),
h AS (SELECT stratum, rule, pos, cutoff, count_if(hit AND NOT good) - {PRICE} * count_if(hit AND good) AS gain
      FROM v WHERE choice GROUP BY ALL),
best AS (SELECT stratum, rule, pos, max(gain) AS gain, max_by(cutoff, gain * 1000.0 + cutoff) AS cutoff FROM h WHERE gain > 0 GROUP BY ALL),
plan AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, pos) AS step FROM best),
firsts AS (SELECT x.stratum, x.doc_id, coalesce(min(step) FILTER (WHERE v.hit), 99) AS t FROM x
      LEFT JOIN v ON v.doc_id = x.doc_id LEFT JOIN plan p ON p.stratum = v.stratum AND p.rule = v.rule AND p.cutoff = v.cutoff
      WHERE NOT x.choice AND x.good GROUP BY ALL),
tests AS (SELECT p.stratum, p.step, (SELECT count(*) FROM firsts f WHERE f.stratum = p.stratum) AS n,
      (SELECT count(*) FROM firsts f WHERE f.stratum = p.stratum AND f.t <= p.step) AS k FROM plan p),
tails AS (SELECT stratum, step, n, CASE WHEN n = 0 OR k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS pv FROM tests),
ok AS (SELECT t.stratum, t.step FROM tails t WHERE NOT EXISTS (SELECT 1 FROM tails u WHERE u.stratum = t.stratum AND u.step <= t.step
      AND u.pv > {DELTA} / (SELECT count(DISTINCT stratum) FROM x))),
bad AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, stratum, rule, cutoff, {value} AS val FROM m CROSS JOIN grid) z
      JOIN plan p USING (stratum, rule, cutoff) JOIN ok USING (stratum, step) WHERE val > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""
