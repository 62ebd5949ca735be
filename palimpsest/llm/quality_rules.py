"""Quality rules with host-level verdicts (DataFrame and SQL functions only).

Each document gets a few counts and a base verdict. The base verdicts are summed
by host; a host's failure rate is shrunk towards a beta prior that is fitted to
all hosts by moments, and a host whose shrunk rate is too high takes its
remaining documents with it.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows count as often as they occur; an empty table gives
an empty result. Columns of the input that clash with the result's names are
replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, let, partitions_of, words_of, written

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: The prior weighs as many documents as the moments say, within these bounds.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def _repeats(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Most texts repeat no window, which 64-bit hashes show at once: equal windows
    have equal hashes, so distinct hashes prove it. Only the others compare the
    windows themselves, sorted together with their places.
    """
    at = F.sequence(F.lit(0), n - WINDOW)

    def gram(i):
        return [words[i + k] for k in range(WINDOW)]

    def covered(places):
        last = F.size(places) - 1
        steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == last, WINDOW).otherwise(F.least(F.lit(WINDOW), places[F.least(k + 1, last)] - places[k])))
        return F.when(last < 0, 0).otherwise(F.aggregate(steps, F.lit(0), lambda a, b: a + b))

    def exact():
        windows = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *gram(i)).alias("g"), i.alias("i"))))

        def places(s):
            end = F.size(s) - 1
            twice = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == s[k]["g"])) | ((k < end) & (s[F.least(k + 1, end)]["g"] == s[k]["g"]))
            return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(twice(k), x["i"]).otherwise(-1)), lambda p: p >= 0))

        return let(windows, lambda s: let(places(s), covered))

    hashes = F.transform(at, lambda i: F.xxhash64(*gram(i)))
    distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n < WINDOW + 1, 0).when(distinct, 0).otherwise(exact()).cast("long")


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    The words are bound within one expression, so that a filter on a result, which
    the optimizer pushes below the projection, splits a text once and not once a word.
    """
    names = ("n_words", "word_chars", "n_repeat_words")
    docs = docs.drop(*names, "n_symbols", "n_dup_lines", "base_failed", "_rules")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w, F.size(w)).alias("n_repeat_words"))

    out = docs.withColumn("_rules", let(words_of(F.col(text)), of_words))
    out = out.withColumns({
        **{n: F.col(f"_rules.{n}") for n in names},
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }).drop("_rules")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(scored: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """A row a host: n, failed, rate (shrunk), rejected.

    The prior has the pooled mean m; its weight is m(1-m)/v - 1, where v is what
    the hosts' rates vary beyond what so few documents vary by chance.
    """
    hosts = scored.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    pooled = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"))
    spread = hosts.crossJoin(F.broadcast(pooled)).agg(
        F.first("m").alias("m"),
        (F.avg(F.pow(F.col("failed") / F.col("n") - F.col("m"), 2)) - F.avg(F.col("m") * (1 - F.col("m")) / F.col("n"))).alias("v"),
    )
    weight = F.when(F.col("v") <= 0, MOST_PRIOR).otherwise(F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(LEAST_PRIOR), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    prior = spread.select("m", weight.alias("w"))
    rate = (F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return hosts.crossJoin(F.broadcast(prior)).select("_host", "n", "failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, keep_text: bool = True) -> DataFrame:
    """The input's rows and columns, the counts, base_failed, and kept.

    The counts are written once to the shared folder with the input's columns, so
    that summing by host doesn't compute them a second time. Only rejected hosts
    are joined back; hosts are pre-aggregated, so a hot host is one row. They are
    broadcast if their counted number fits the bound, and else joined on the host
    and a salt, which splits a hot host's documents.
    """
    spark = docs.sparkSession
    scored = document_rules(docs.drop("kept"), text)
    scored = written(scored if keep_text else scored.drop(text), "quality")
    bad = written(host_verdicts(scored, host, max_rate).filter("rejected").select("_host"), "hosts")
    if bad.count() * 256 <= BROADCAST_BYTES:
        joined = scored.join(F.broadcast(bad.withColumn("_bad", F.lit(True))), F.col(host).eqNullSafe(F.col("_host")), "left")
    else:
        salts = max(8, partitions_of(spark) // 4)
        spread = bad.withColumn("_bad", F.lit(True)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = scored.withColumn("_s", (F.rand(7) * salts).cast("int"))
        joined = salted.join(spread, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB; `{docs}` is the table to judge.
VERDICT_SQL = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS body,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM {docs}),
g AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 6),
f AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS gram FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM f WHERE gram IS NOT NULL),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM c WHERE n >= 2),
r AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5)))::BIGINT AS n_repeat_words FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
b AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM v GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS m FROM h),
s AS (SELECT any_value(m) AS m, avg((failed / n - m) ** 2) - avg(m * (1 - m) / n) AS v FROM h, m),
k AS (SELECT m, CASE WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) END AS w FROM s),
bad AS (SELECT source FROM h, k WHERE (failed + m * w) / (n + w) > 0.5),
verdict AS (SELECT v.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM v.source) AS kept FROM v)
"""
ORACLE_SQL = "WITH " + VERDICT_SQL.strip().format(docs="documents") + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"
