"""Registered queries of the document operators, each with its SQL where SQL can say it.

Adapters turn the driver's tables into documents:

* P: the lines of `documents` are paragraphs.
* L: a contract a customer: its orders are sections, their lines clauses `n.m` with
  references, and a returned line has an unnumbered note behind its clause.
* R: `events` are revisions, a user's being one document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import arrow
from ..functions import text as X
from ..operators import actions as A
from ..operators import clauses as C
from ..operators import edits as E
from ..operators import paragraphs as P
from ..operators import revisions as R
from ..operators import segments as G


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_lines(table(spark, sf, "documents").select("doc_id", "text"))


LINES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS para_id FROM documents)"


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    orders.createOrReplaceTempView("_orders")
    items.createOrReplaceTempView("_lineitem")
    return spark.sql(CONTRACTS_SELECT.format(orders="_orders", lineitem="_lineitem"))


CONTRACTS_SELECT = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, k, note) - 1 AS INT) AS para_id, text FROM (
  SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sec, 0 AS k, 0 AS note,
    concat(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING), '. ', o_orderpriority, ' terms') AS text FROM {orders}
  UNION ALL
  SELECT doc_id, sec, k, 0, concat(CAST(sec AS STRING), '.', CAST(k AS STRING), '  Supply of part ', CAST(l_partkey AS STRING), '. Fees follow Section ', CAST(l_suppkey % 12 + 1 AS STRING), '.', CAST(l_linenumber % 5 + 1 AS STRING), ' and ', CAST(l_partkey % 9 + 1 AS STRING), ' within ', CAST(CAST(l_quantity AS INT) AS STRING), ' days.') FROM (
    SELECT o_custkey AS doc_id, sec, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, l.* FROM {lineitem} l
    JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sec FROM {orders}) o ON l_orderkey = o_orderkey) x
  UNION ALL
  SELECT doc_id, sec, k, 1, concat('Note: part ', CAST(l_partkey AS STRING), ' was returned.') FROM (
    SELECT o_custkey AS doc_id, sec, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, l.* FROM {lineitem} l
    JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sec FROM {orders}) o ON l_orderkey = o_orderkey) y WHERE l_returnflag = 'R') z
"""


def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same contracts, doc_id and texts in order: a row each, made by one join and without windows."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    s = lambda x: x.cast("string")

    def clause(sec, k, i):
        label = F.concat(s(sec + 1), F.lit("."), s(k + 1), F.lit("  Supply of part "))
        fees = F.concat(F.lit(". Fees follow Section "), s(i["l_suppkey"] % 12 + 1), F.lit("."), s(i["l_linenumber"] % 5 + 1), F.lit(" and "), s(i["l_partkey"] % 9 + 1))
        return F.concat(label, s(i["l_partkey"]), fees, F.lit(" within "), s(i["l_quantity"].cast("int")), F.lit(" days."))

    def section(o, sec):
        heading = F.array(F.concat(s(sec + 1), F.lit(". "), o["o_orderpriority"], F.lit(" terms")))
        note = lambda i: F.concat(F.lit("Note: part "), s(i["l_partkey"]), F.lit(" was returned."))
        body = F.transform(o["items"], lambda i, k: F.when(i["l_returnflag"] == "R", F.array(clause(sec, k, i), note(i))).otherwise(F.array(clause(sec, k, i))))
        return F.when(o["items"].isNull(), heading).otherwise(F.concat(heading, F.flatten(body)))

    lines = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"))).alias("items"))
    whole = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sections = whole.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "items"))).alias("sections"))
    return sections.select("doc_id", F.flatten(F.transform("sections", section)).alias("texts"))


LABEL = r"coalesce(nullif(regexp_extract(text, '^[ \t]*(\d+(?:\.\d+)+)\.?[ \t]', 1), ''), nullif(regexp_extract(text, '^[ \t]*(\d+)\.[ \t]', 1), ''))"
REST = r"regexp_replace(text, '^[ \t]*(?:\d+(?:\.\d+)+\.?|\d+\.)[ .\t]*', '')"
CONTRACTS = "l AS MATERIALIZED (" + CONTRACTS_SELECT.format(orders="orders", lineitem="lineitem").strip() + ")"
CLAUSES = CONTRACTS + f", ll AS (SELECT *, {LABEL} AS label FROM l), c AS MATERIALIZED (SELECT *, len(string_split(label, '.'))::INT AS level, {REST} AS body FROM ll WHERE label IS NOT NULL)"
TREE = CLAUSES + """, t AS MATERIALIZED (SELECT c.*, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER w END AS parent,
  CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN para_id END IGNORE NULLS) OVER w END AS parent_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY para_id ROWS UNBOUNDED PRECEDING))"""
TITLE = "CASE WHEN length(trim(split_part(body, '.', 1))) BETWEEN 1 AND 80 THEN trim(split_part(body, '.', 1)) ELSE trim(substr(body, 1, 60)) END"
#: A clause goes in the renumbering queries if its part's number, which ends the title, ends with 3.
GOES = "level = 2 AND title LIKE '%3'"


def clauses(spark, sf):
    return C.parse(contracts(spark, sf))


def tree(spark, sf):
    return C.tree(clauses(spark, sf))


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "format:rPr").when(F.col("event_type") == "view", "move-from").otherwise("move-to")
    move = F.when(F.col("event_type").isin("view", "purchase"), F.concat(F.lit("m"), (F.floor(F.col("event_id") / 20)).cast("string")))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("rev_id"), kind.alias("kind"), F.concat(F.lit("author "), (F.col("event_id") % 7).cast("string")).alias("author"), X.utc_stamp(F.col("ts")).alias("date"), move.alias("move_name"))


REVISIONS = """r AS (SELECT user_id AS doc_id, event_id AS seq, event_id::VARCHAR AS rev_id,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'format:rPr' WHEN 'view' THEN 'move-from' ELSE 'move-to' END AS kind,
  'author ' || (event_id % 7) AS author, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'm' || (event_id // 20) END AS move_name FROM events)"""


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each paragraph as pieces: every seventh is an insertion, every one after that a deletion."""
    words = lines(spark, sf).select("doc_id", "para_id", F.posexplode(F.split("text", " ", -1)).alias("seq", "word"))
    text = F.when(F.col("seq") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word"))
    kind = F.when(F.col("seq") % 7 == 3, "ins").when(F.col("seq") % 7 == 4, "del").otherwise("")
    return words.select("doc_id", "para_id", "seq", text.alias("text"), kind.alias("kind"), F.concat_ws("-", "para_id", "seq").alias("rev_id"))


PIECES = LINES + """, w AS (SELECT doc_id, para_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq FROM p),
  k AS (SELECT doc_id, para_id, seq, CASE WHEN seq = 0 THEN word ELSE ' ' || word END AS text, CASE seq % 7 WHEN 3 THEN 'ins' WHEN 4 THEN 'del' ELSE '' END AS kind FROM w)"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """A plan of actions a customer, from its order lines; some are invalid, some the same."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    orders.createOrReplaceTempView("_orders")
    items.createOrReplaceTempView("_lineitem")
    out = spark.sql(ACTIONS_SELECT.format(orders="_orders", lineitem="_lineitem"))
    return out.withColumn("all", F.lit(False)).withColumn("regex", F.lit(False))


ACTIONS_SELECT = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq,
  concat('AI-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
  CASE l_partkey % 6 WHEN 0 THEN 'replace_text' WHEN 1 THEN 'delete_text' WHEN 2 THEN 'rewrite_clause' WHEN 3 THEN 'delete_clause' WHEN 4 THEN 'comment' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'insert_clause' WHEN 1 THEN 'delete_section' ELSE 'shred_clause' END END AS type,
  'because' AS rationale,
  CASE l_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN l_linenumber % 3 > 0 AND (l_partkey % 6 < 5 OR l_suppkey % 3 = 2) THEN concat(CAST(l_linenumber AS STRING), '.', CAST(l_partkey % 4 + 1 AS STRING)) END AS clause,
  CASE WHEN l_partkey % 6 = 5 AND l_suppkey % 3 = 1 AND l_linenumber % 5 > 0 THEN CAST(l_linenumber AS STRING) END AS section,
  CASE WHEN l_partkey % 6 = 5 AND l_suppkey % 3 = 0 AND l_linenumber % 4 > 0 THEN concat(CAST(l_linenumber AS STRING), '.', CAST(l_partkey % 4 + 1 AS STRING)) END AS after_clause,
  CASE WHEN l_partkey % 6 < 2 THEN concat('part ', CAST(l_partkey % 50 AS STRING)) END AS find,
  CASE WHEN l_partkey % 6 = 0 AND l_suppkey % 5 > 0 THEN 'goods' END AS replace,
  CASE WHEN l_partkey % 6 IN (2, 4) OR l_partkey % 6 = 5 AND l_suppkey % 3 = 0 THEN 'as agreed' END AS text
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey
"""
ACTIONS = "a AS (" + ACTIONS_SELECT.format(orders="orders", lineitem="lineitem").strip() + ")"


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes for contracts: one an order line, some of which aren't in the paragraph, or are in it more than once."""
    k = F.col("l_partkey")
    target = F.when(k % 7 == 0, "  ").when(k % 7 == 1, F.concat(F.lit("part "), k.cast("string"))).when(k % 7 == 2, ". ").when(k % 7 == 3, "Fees follow Section").otherwise("s")
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(F.col("o_custkey").alias("doc_id"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_suppkey") % 60).cast("int").alias("para_id"), target.alias("target"), (F.col("l_linenumber") % 4).alias("occurrence"))


EDITS = """e AS MATERIALIZED (SELECT o_custkey AS doc_id, l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS seq, (l_suppkey % 60)::INT AS para_id,
  CASE l_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN 'part ' || l_partkey WHEN 2 THEN '. ' WHEN 3 THEN 'Fees follow Section' ELSE 's' END AS target, l_linenumber % 4 AS occurrence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
HITS = """h AS MATERIALIZED (SELECT e.*, text, CASE WHEN text IS NULL THEN NULL ELSE list_filter(generate_series(0, length(text) - length(target)), lambda i: substr(text, (i + 1)::BIGINT, length(target)) = target) END AS hits
  FROM e LEFT JOIN l USING (doc_id, para_id))"""
VERDICT = """CASE WHEN trim(target) = '' THEN 'empty_target' WHEN text IS NULL THEN 'paragraph_not_found' WHEN len(hits) = 0 OR occurrence > len(hits) THEN 'target_not_found'
  WHEN occurrence = 1 AND len(hits) > 1 AND length(target) < 25 THEN 'target_ambiguous' END"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("q01_paragraph_offsets", f'WITH {LINES} SELECT doc_id, para_id, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(text) + 1) OVER w, 0) + length(text))::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')
def q01(spark, sf):
    return P.with_offsets(lines(spark, sf)).select("doc_id", "para_id", "start", "end")


@query("q02_find_paragraphs", f"WITH {LINES} SELECT doc_id, para_id FROM p WHERE contains(text, 'the') AND starts_with(ltrim(text), 'Th') AND regexp_matches(text, '[a-z]+, (of|in) ')")
def q02(spark, sf):
    return P.find_paragraphs(lines(spark, sf), contains="the", startswith="Th", regex="[a-z]+, (of|in) ").select("doc_id", "para_id")


@query("q03_find_text", f"WITH {LINES}, h AS (SELECT doc_id, para_id, unnest(list_filter(generate_series(0, length(text) - 4), lambda i: substr(text, (i + 1)::BIGINT, 4) = 'anan'))::INT AS start FROM p WHERE contains(text, 'anan')) SELECT doc_id, para_id, start, start + 4 AS \"end\" FROM h")
def q03(spark, sf):
    return P.find_text(lines(spark, sf), "anan", overlapping=True)


@query("q04_most_hits", f"WITH {LINES} SELECT doc_id, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM p GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 10")
def q04(spark, sf):
    return P.find_text(lines(spark, sf), "the").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


@query("q05_fingerprints", f"WITH {LINES} SELECT doc_id, left(sha256(string_agg(text, chr(10) ORDER BY para_id)), 16) AS fingerprint FROM p GROUP BY doc_id")
def q05(spark, sf):
    return P.fingerprints(lines(spark, sf))


_FROM, _TO = "".join(S.FOLD).replace("'", "''"), "".join(S.FOLD.values()).replace("'", "''")


@query("q06_folded_search", f"WITH {LINES}, f AS (SELECT doc_id, text, translate(text, '{_FROM}', '{_TO}') AS t FROM p) SELECT doc_id, count(*) FILTER (length(t) <> length(text)) AS changed_length, count(*) FILTER (contains(t, '\"')) AS quoted, count(*) FILTER (contains(t, ', ')) AS with_comma FROM f GROUP BY doc_id")
def q06(spark, sf):
    t = X.folded(F.col("text"))
    return lines(spark, sf).groupBy("doc_id").agg(F.count_if(F.length(t) != F.length("text")).alias("changed_length"), F.count_if(t.contains('"')).alias("quoted"), F.count_if(t.contains(", ")).alias("with_comma"))


@query("q07_duplicate_paragraphs", f"WITH {LINES}, n AS (SELECT doc_id, para_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM p), d AS (SELECT doc_id, para_id, first_value(doc_id) OVER w AS first_doc, first_value(para_id) OVER w AS first_para FROM n WHERE t <> '' WINDOW w AS (PARTITION BY t ORDER BY doc_id, para_id)) SELECT * FROM d WHERE doc_id <> first_doc OR para_id <> first_para")
def q07(spark, sf):
    return P.duplicates(lines(spark, sf))


@query("q08_token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]'))::INT AS n_tokens, greatest(1, length(text) // 4)::BIGINT AS approx_tokens FROM documents")
def q08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), X.approx_tokens(F.length("text")).alias("approx_tokens"))


@query("q09_clause_tree", f"WITH {TREE} SELECT doc_id, para_id, label, level, parent_id, parent, {TITLE} AS title FROM t")
def q09(spark, sf):
    return tree(spark, sf).select("doc_id", "para_id", "label", "level", "parent_id", "parent", "title")


@query("q09b_recursive_paths", """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS up, r_regionkey::BIGINT AS k FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer),
  s AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY k) AS place FROM n), t AS (SELECT id, CAST(place AS VARCHAR) AS label, 1 AS level FROM s WHERE up IS NULL UNION ALL SELECT s.id, t.label || '.' || s.place, t.level + 1 FROM s JOIN t ON s.up = t.id) SELECT id, label, level FROM t""")
def q09b(spark, sf):
    """Numbering a three-level hierarchy from the top, by a recursive query."""
    for name in ("region", "nation", "customer"):
        table(spark, sf, name).createOrReplaceTempView(f"_{name}")
    return spark.sql("""WITH RECURSIVE n AS (SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS up, CAST(r_regionkey AS BIGINT) AS k FROM _region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_nationkey FROM _nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_custkey FROM _customer),
      s AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY k) AS place FROM n),
      t (id, label, level) AS (SELECT id, CAST(place AS STRING), 1 FROM s WHERE up IS NULL UNION ALL SELECT s.id, concat(t.label, '.', s.place), t.level + 1 FROM s JOIN t ON s.up = t.id) SELECT id, label, level FROM t""")


_LEFT = TREE + f", x AS MATERIALIZED (SELECT *, {TITLE} AS title FROM t), g AS (SELECT * FROM x WHERE NOT ({GOES})), s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY para_id)::INT AS place FROM g), n AS MATERIALIZED (SELECT s.*, CASE WHEN s.parent_id IS NULL THEN s.place::VARCHAR ELSE u.place || '.' || s.place END AS new_label FROM s LEFT JOIN s u ON u.doc_id = s.doc_id AND u.para_id = s.parent_id)"


def left(spark, sf):
    return clauses(spark, sf).filter(f"NOT ({GOES})")


@query("q10_renumber", f"WITH {_LEFT} SELECT doc_id, label AS old_label, arg_max(new_label, para_id) AS new_label FROM n WHERE label <> new_label GROUP BY doc_id, label")
def q10(spark, sf):
    return C.mapping(C.renumber(left(spark, sf)))


@query("q11_numbering_gaps", f"WITH {_LEFT} SELECT doc_id, para_id, label, place FROM s WHERE split_part(label, '.', level)::INT <> place")
def q11(spark, sf):
    return C.gaps(C.tree(left(spark, sf))).select("doc_id", "para_id", "label", "place")


_REFS = r", rm AS (SELECT doc_id, para_id, regexp_extract(text, 'Section (\d+\.\d+) and (\d+)', ['a', 'b']) AS m FROM l WHERE contains(text, 'Section ')), rr AS MATERIALIZED (SELECT doc_id, para_id, unnest([m.a, m.b]) AS number FROM rm)"


@query("q12_references", f"WITH {CLAUSES}{_REFS} SELECT rr.doc_id, para_id, rr.number, own.number IS NULL AS broken FROM rr LEFT JOIN (SELECT DISTINCT doc_id, label AS number FROM c) own ON own.doc_id = rr.doc_id AND own.number = rr.number")
def q12(spark, sf):
    refs = C.references(contracts(spark, sf)).select("doc_id", "para_id", "number")
    own = clauses(spark, sf).select("doc_id", F.col("label").alias("number")).distinct().withColumn("_there", F.lit(True))
    return refs.join(own, ["doc_id", "number"], "left").select("doc_id", "para_id", "number", F.col("_there").isNull().alias("broken"))


@query("q12b_rewrite_references", f"WITH {_LEFT}{_REFS}, mp AS (SELECT doc_id, label AS number, arg_max(new_label, para_id) AS new_label FROM n WHERE label <> new_label GROUP BY doc_id, label), go AS (SELECT DISTINCT doc_id, label AS number FROM x WHERE {GOES}) SELECT rr.doc_id, para_id, rr.number, CASE WHEN go.number IS NOT NULL THEN 'dangling' WHEN new_label <> rr.number THEN 'rewritten' ELSE 'kept' END AS fate, CASE WHEN go.number IS NULL THEN new_label END AS new_number FROM rr LEFT JOIN go USING (doc_id, number) LEFT JOIN mp USING (doc_id, number)")
def q12b(spark, sf):
    refs = C.references(contracts(spark, sf)).select("doc_id", "para_id", "number")
    return C.rewrite_references(refs, C.mapping(C.renumber(left(spark, sf))), clauses(spark, sf).filter(GOES))


@query("q13_carried_labels", f"WITH {CONTRACTS}, ll AS (SELECT *, {LABEL} AS label FROM l) SELECT doc_id, para_id, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_id ROWS UNBOUNDED PRECEDING) AS clause FROM ll")
def q13(spark, sf):
    return P.with_labels(contracts(spark, sf)).select("doc_id", "para_id", "clause")


@query("q14_manifest", f"WITH {CLAUSES}, v AS (SELECT doc_id, para_id, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_id ROWS UNBOUNDED PRECEDING) AS label, label AS own, {REST} AS body FROM ll) SELECT doc_id, label, min(para_id) AS first_para, max(para_id) AS last_para, arg_min({TITLE}, para_id) FILTER (own IS NOT NULL) AS title FROM v WHERE label IS NOT NULL GROUP BY doc_id, label")
def q14(spark, sf):
    return P.manifest(contracts(spark, sf))


_LEVELS = r", lv AS (SELECT *, CASE WHEN length(trim(text)) BETWEEN 1 AND 80 AND NOT regexp_matches(trim(text), '[.;:,]$') AND upper(trim(text)) = trim(text) AND regexp_matches(text, '\p{L}') THEN 1 ELSE 0 END AS heading_level FROM ll)"


@query("q15_strategies", f"WITH {LINES}, ll AS (SELECT *, {LABEL} AS label FROM p)" + _LEVELS + r" SELECT doc_id, count(*) FILTER (label IS NOT NULL) AS numbered, count(*) FILTER (heading_level > 0) AS headings, count(*) FILTER (trim(text) <> '') AS filled, CASE WHEN count(*) FILTER (heading_level > 0) >= 8 THEN 'headings' ELSE 'windows' END AS strategy FROM lv GROUP BY doc_id")
def q15(spark, sf):
    return G.strategies(G.with_levels(lines(spark, sf))).select("doc_id", "numbered", "headings", "filled", "strategy")


@query("q15b_contract_strategies", f"WITH {CLAUSES} SELECT doc_id, count(*) FILTER (level = 1) AS sections, count(*) AS numbered, CASE WHEN count(*) FILTER (level = 1) >= 3 AND count(*) >= 0.25 * any_value(n) THEN 'clauses' ELSE 'windows' END AS strategy FROM c JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def q15b(spark, sf):
    return G.strategies(G.with_levels(contracts(spark, sf))).select("doc_id", "sections", "numbered", "strategy")


def unit_rows(spark, sf):
    levelled = G.with_levels(contracts(spark, sf))
    return G.units(levelled, G.strategies(levelled))


_UNITS = CLAUSES + ", st AS (SELECT doc_id, count(*) FILTER (level = 1) >= 3 AS whole FROM c GROUP BY doc_id), un AS (SELECT ll.*, sum(CASE WHEN NOT whole OR label NOT LIKE '%.%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_id) - 1 AS unit FROM ll JOIN st USING (doc_id))"


@query("q16_segments", f"WITH RECURSIVE {_UNITS}, uz AS (SELECT doc_id, unit::BIGINT AS unit, sum(length(text))::BIGINT AS chars FROM un GROUP BY doc_id, unit), f AS (SELECT doc_id, unit, chars, 0 AS segment, chars AS used FROM uz WHERE unit = 0 UNION ALL SELECT z.doc_id, z.unit, z.chars, CASE WHEN f.used + z.chars > 800 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.used + z.chars > 800 THEN z.chars ELSE f.used + z.chars END FROM f JOIN uz z ON z.doc_id = f.doc_id AND z.unit = f.unit + 1) SELECT doc_id, unit, chars, segment FROM f")
def q16(spark, sf):
    return G.pack_units(unit_rows(spark, sf), 200)


@query("q17_units", f"WITH {_UNITS} SELECT doc_id, para_id, unit::BIGINT AS unit FROM un")
def q17(spark, sf):
    return unit_rows(spark, sf).select("doc_id", "para_id", "unit")


@query("q18_revision_counts", f"WITH {REVISIONS} SELECT doc_id, 'kind' AS dimension, kind AS value, count(*) AS n FROM r GROUP BY doc_id, kind UNION ALL SELECT doc_id, 'author', author, count(*) FROM r GROUP BY doc_id, author")
def q18(spark, sf):
    return R.counts(revisions(spark, sf))


@query("q19_select_revisions", f"WITH {REVISIONS} SELECT doc_id, rev_id, kind, author, date FROM r WHERE author IN ('author 1', 'author 4') AND (kind LIKE 'format:%' OR kind LIKE '%insert')")
def q19(spark, sf):
    return revisions(spark, sf).filter(R.selector(authors=["author 1", "author 4"], kinds=["format", "insert-any"])).select("doc_id", "rev_id", "kind", "author", "date")


@query("q20_widened_moves", f"WITH {REVISIONS}, s AS (SELECT * FROM r WHERE author = 'author 3') SELECT doc_id, rev_id, kind FROM s UNION ALL SELECT doc_id, rev_id, kind FROM r WHERE author <> 'author 3' AND move_name IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.doc_id = r.doc_id AND s.move_name = r.move_name)")
def q20(spark, sf):
    return R.selected(revisions(spark, sf), R.selector(authors="author 3")).select("doc_id", "rev_id", "kind")


@query("q21_accept_reject", f"WITH {PIECES} SELECT doc_id, para_id, md5(coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind <> 'del'), '')) AS accepted, md5(coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind <> 'ins'), '')) AS rejected FROM k GROUP BY doc_id, para_id")
def q21(spark, sf):
    rows = pieces(spark, sf)
    accepted = R.text_of(R.resolve(rows, True)).withColumnRenamed("text", "a")
    rejected = R.text_of(R.resolve(rows, False)).withColumnRenamed("text", "r")
    return accepted.join(rejected, ["doc_id", "para_id"], "full").select("doc_id", "para_id", F.md5(F.coalesce("a", F.lit("")).cast("binary")).alias("accepted"), F.md5(F.coalesce("r", F.lit("")).cast("binary")).alias("rejected"))


@query("q22_merged_marks", f"WITH {LINES}, k AS (SELECT *, sum(CASE WHEN para_id % 3 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_id DESC) AS g FROM p), m AS (SELECT doc_id, g, max(para_id) AS para_id, string_agg(text, '' ORDER BY para_id) AS t, max(CASE WHEN para_id % 3 = 1 THEN 0 ELSE 1 END) AS kept FROM k GROUP BY doc_id, g) SELECT doc_id, para_id, md5(t) AS text_md5 FROM m WHERE kept = 1 OR t <> ''")
def q22(spark, sf):
    return R.merge_marks(lines(spark, sf), F.col("para_id") % 3 == 1).select("doc_id", "para_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("q23_span_overlaps", f"WITH {CONTRACTS}, {EDITS}, {HITS}, v AS (SELECT *, {VERDICT} AS rejection FROM h), s AS MATERIALIZED (SELECT doc_id, para_id, seq, (CASE WHEN occurrence = 0 THEN hits[1] ELSE hits[occurrence] END) AS s, length(target) AS n FROM v WHERE rejection IS NULL) SELECT a.doc_id, a.para_id, a.seq AS first, b.seq AS second FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.para_id = b.para_id AND a.seq < b.seq AND a.s < b.s + b.n AND b.s < a.s + a.n")
def q23(spark, sf):
    found = E.locate(edits(spark, sf), contracts(spark, sf)).filter("rejection IS NULL")
    return E.overlaps(found.select("doc_id", "para_id", "seq", F.get("spans", 0)["start"].alias("start"), F.get("spans", 0)["end"].alias("end")))


@query("q24_edit_verdicts", f"WITH {CONTRACTS}, {EDITS}, {HITS} SELECT doc_id, seq, para_id, {VERDICT} AS rejection, CASE WHEN {VERDICT} IS NULL THEN CASE WHEN occurrence = 0 THEN len(hits) ELSE 1 END ELSE 0 END::INT AS n_spans FROM h")
def q24(spark, sf):
    return E.locate(edits(spark, sf), contracts(spark, sf)).select("doc_id", "seq", "para_id", "rejection", F.size("spans").alias("n_spans"))


@query("q25_action_problems", f"WITH {ACTIONS}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY seq) AS k FROM a) SELECT doc_id, seq, 'unknown type ' || type AS problem FROM d WHERE type = 'shred_clause' UNION ALL SELECT doc_id, seq, 'missing replace' FROM d WHERE type = 'replace_text' AND replace IS NULL UNION ALL SELECT doc_id, seq, 'missing clause' FROM d WHERE type IN ('rewrite_clause', 'delete_clause') AND clause IS NULL UNION ALL SELECT doc_id, seq, 'duplicate id' FROM d WHERE k > 1 UNION ALL SELECT doc_id, seq, 'unexpected all' FROM d WHERE type IN ('rewrite_clause', 'delete_clause', 'comment', 'insert_clause', 'delete_section') UNION ALL SELECT doc_id, seq, 'unexpected regex' FROM d WHERE type IN ('rewrite_clause', 'delete_clause', 'comment', 'insert_clause', 'delete_section') UNION ALL SELECT doc_id, seq, 'missing section' FROM d WHERE type = 'delete_section' AND section IS NULL UNION ALL SELECT doc_id, seq, 'missing placement' FROM d WHERE type = 'insert_clause' AND after_clause IS NULL")
def q25(spark, sf):
    return A.problems(actions(spark, sf))


_POSITION = "CASE WHEN coalesce(clause, section) IS NULL THEN [9999] ELSE list_transform(string_split(coalesce(clause, section), '.'), lambda x: x::INT) END"


@query("q26_execution_order", f"WITH {ACTIONS} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN type IN ('delete_clause', 'delete_section', 'insert_clause') THEN 1 WHEN type = 'comment' THEN 2 ELSE 0 END, CASE type WHEN 'delete_clause' THEN 1 WHEN 'insert_clause' THEN 6 ELSE 0 END, {_POSITION}, seq)::INT AS place FROM a")
def q26(spark, sf):
    return A.execution_order(actions(spark, sf)).select("doc_id", "seq", "place")


@query("q27_cap", f"WITH {ACTIONS} SELECT doc_id, seq, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END DESC, {_POSITION}, seq) <= 5 THEN 'kept' ELSE 'capped' END AS outcome FROM a")
def q27(spark, sf):
    return A.cap(actions(spark, sf), 5).select("doc_id", "seq", "outcome")


@query("q28_dedupe", f"WITH {ACTIONS} SELECT doc_id, seq, min(seq) OVER (PARTITION BY doc_id, type, clause, section, after_clause, find, replace, text) AS winner FROM a")
def q28(spark, sf):
    return A.dedupe(actions(spark, sf)).select("doc_id", "seq", "winner")


@query("q29_preflight", f"WITH {CLAUSES}, {ACTIONS}, o AS (SELECT doc_id, label, any_value(text) AS own FROM c GROUP BY doc_id, label), n AS (SELECT a.doc_id, a.seq, count(*) AS n FROM a JOIN l ON l.doc_id = a.doc_id AND contains(l.text, a.find) WHERE a.clause IS NULL GROUP BY a.doc_id, a.seq) SELECT a.doc_id, a.seq, CASE WHEN clause IS NOT NULL AND o.own IS NULL OR section IS NOT NULL AND s.label IS NULL OR after_clause IS NOT NULL AND f.label IS NULL THEN 'no such clause' WHEN clause IS NOT NULL AND find IS NOT NULL AND NOT contains(o.own, find) THEN 'quote not in clause' WHEN clause IS NULL AND find IS NOT NULL AND n IS NULL THEN 'quote not found' WHEN clause IS NULL AND find IS NOT NULL AND n > 1 THEN 'quote in several paragraphs' END AS problem FROM a LEFT JOIN o ON o.doc_id = a.doc_id AND o.label = a.clause LEFT JOIN o s ON s.doc_id = a.doc_id AND s.label = a.section LEFT JOIN o f ON f.doc_id = a.doc_id AND f.label = a.after_clause LEFT JOIN n ON n.doc_id = a.doc_id AND n.seq = a.seq")
def q29(spark, sf):
    return A.preflight(actions(spark, sf), clauses(spark, sf), contracts(spark, sf)).select("doc_id", "seq", "problem")


@query("q29b_severity_counts", f"WITH {ACTIONS}, s AS (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity) SELECT d.doc_id, s.severity, count(a.seq) AS n FROM (SELECT DISTINCT doc_id FROM a) d CROSS JOIN s LEFT JOIN a ON a.doc_id = d.doc_id AND a.severity = s.severity GROUP BY ALL")
def q29b(spark, sf):
    return A.severity_counts(actions(spark, sf))


_RISK_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in S.RISKS.items()) + "], lambda x: x IS NOT NULL)"


@query("q30_triage", f"WITH {LINES}, s AS (SELECT doc_id, para_id AS segment, greatest(1, length(text) // 4)::BIGINT AS tokens, (doc_id * 7 + para_id) % 5 AS h, (doc_id + para_id) % 4 AS n_risks FROM p), f AS (SELECT *, CASE WHEN h = 0 THEN 'deep' WHEN h = 1 AND n_risks >= 2 THEN 'scan' WHEN h = 1 THEN 'skip' ELSE 'scan' END AS priority FROM s), r AS (SELECT *, sum(CASE WHEN priority = 'deep' THEN tokens ELSE 0 END) OVER (PARTITION BY doc_id) + coalesce(sum(CASE WHEN priority = 'deep' THEN 0 ELSE tokens END) OVER (PARTITION BY doc_id ORDER BY n_risks DESC, tokens DESC, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached, sum(tokens) OVER (PARTITION BY doc_id) AS total FROM f) SELECT doc_id, segment, CASE WHEN priority <> 'deep' AND reached < 0.35 * total THEN 'deep' ELSE priority END AS priority FROM r")
def q30(spark, sf):
    """Each paragraph is a segment; every fifth is chosen deep, the next to be skipped."""
    h = (F.col("doc_id") * 7 + F.col("para_id")) % 5
    s = lines(spark, sf).select("doc_id", F.format_string("S%08d", "para_id").alias("seg_id"), F.col("para_id").alias("segment"), X.approx_tokens(F.length("text")).alias("tokens"), F.slice(F.array(*map(F.lit, list(S.RISKS)[:4])), F.lit(1), ((F.col("doc_id") + F.col("para_id")) % 4).cast("int")).alias("risks"), h.alias("h"))
    chosen = s.filter("h < 2").select("doc_id", "seg_id", F.when(F.col("h") == 0, "deep").otherwise("skip").alias("priority"))
    return G.triage(s, chosen).select("doc_id", "segment", F.col("final").alias("priority"))


@query("q31_risk_families", f"SELECT doc_id, array_to_string({_RISK_SQL}, ',') AS risks FROM (SELECT o_custkey AS doc_id, string_agg(CASE o_orderpriority WHEN '1-URGENT' THEN 'Termination fees' WHEN '2-HIGH' THEN 'Indemnity' WHEN '5-LOW' THEN 'GDPR audits' ELSE 'Renewals and Warranty' END, '; ' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey)")
def q31(spark, sf):
    word = F.when(F.col("o_orderpriority") == "1-URGENT", "Termination fees").when(F.col("o_orderpriority") == "2-HIGH", "Indemnity").when(F.col("o_orderpriority") == "5-LOW", "GDPR audits").otherwise("Renewals and Warranty")
    docs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", word.alias("w")))), lambda r: r["w"]), "; ").alias("text"))
    return docs.select("doc_id", F.array_join(X.risks(F.col("text")), ",").alias("risks"))


@query("q32_verify", f"WITH {PIECES}, j AS (SELECT doc_id, para_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind <> 'ins'), '') AS t FROM k GROUP BY doc_id, para_id), o AS (SELECT doc_id, para_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (seq % 7 <> 3), '') AS t FROM k GROUP BY doc_id, para_id), a AS (SELECT * FROM j EXCEPT ALL SELECT * FROM o), b AS (SELECT * FROM o EXCEPT ALL SELECT * FROM j) SELECT (SELECT count(*) FROM a) AS missing, (SELECT count(*) FROM b) AS extra, (SELECT count(*) FROM k WHERE kind <> '') AS revisions")
def q32(spark, sf):
    """Rejecting all must give the original paragraphs: nothing missing, nothing extra."""
    rows = pieces(spark, sf)
    rejected = R.text_of(R.resolve(rows, False))
    original = R.text_of(rows.filter("seq % 7 <> 3").withColumn("kind", F.lit("")))
    return rejected.exceptAll(original).agg(F.count(F.lit(1)).alias("missing")).crossJoin(original.exceptAll(rejected).agg(F.count(F.lit(1)).alias("extra"))).crossJoin(rows.agg(F.count_if(F.col("kind") != "").alias("revisions")))


@query("q33_outline", f"WITH {CLAUSES} SELECT doc_id, md5(string_agg(repeat('  ', level - 1) || label || '  ' || substr(body, 1, 400), chr(10) ORDER BY para_id)) AS outline_md5 FROM c GROUP BY doc_id")
def q33(spark, sf):
    return C.render_outline(clauses(spark, sf)).select("doc_id", F.md5(F.col("outline").cast("binary")).alias("outline_md5"))


@query("q33b_render", f"WITH {CONTRACTS}, ll AS (SELECT *, {LABEL} AS label FROM l), v AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_id ROWS UNBOUNDED PRECEDING) AS clause FROM ll), w AS (SELECT *, lag(clause) OVER (PARTITION BY doc_id ORDER BY para_id) AS was FROM v) SELECT doc_id, md5(string_agg(CASE WHEN clause IS DISTINCT FROM was THEN '<<clause ' || clause || '>>' || chr(10) ELSE '' END || '[' || para_id || '] ' || text, chr(10) ORDER BY para_id)) AS rendered_md5 FROM w GROUP BY doc_id")
def q33b(spark, sf):
    return P.render(contracts(spark, sf)).select("doc_id", F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"))


def turns(spark, sf):
    """Neighbouring turns of a conversation, as an old and a new version."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select("conv_id", "turn", "text", nxt.alias("next")).filter("next IS NOT NULL")


@query("q34_word_diff")
def q34(spark, sf):
    """Changes from each turn to the next, by kind."""
    ops = turns(spark, sf).withColumn("ops", arrow.diff("text", "next"))
    n = lambda k: F.size(F.filter("ops", lambda o: o["kind"] == k))
    return ops.select("conv_id", "turn", n("insert").alias("inserts"), n("delete").alias("deletes"), n("replace").alias("replaces"))


@query("q35_similarity")
def q35(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.round(arrow.similarity("text", "next"), 6).alias("similarity"))


@query("q36_fewest_moves", "WITH RECURSIVE p AS (SELECT l_orderkey, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), r AS (SELECT l_orderkey, i, v, 1 AS rising FROM p UNION SELECT p.l_orderkey, p.i, p.v, r.rising + 1 FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.i > r.i AND p.v > r.v) SELECT l_orderkey, any_value(n)::INT AS n, (any_value(n) - max(rising))::INT AS moves FROM r JOIN (SELECT DISTINCT l_orderkey, n FROM p) USING (l_orderkey) GROUP BY l_orderkey")
def q36(spark, sf):
    """Order lines that must move so that each order's parts rise; the rest stays."""
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("int")).alias("parts"))
    return parts.select("l_orderkey", F.size("parts").alias("n"), (F.size("parts") - F.size(arrow.longest_rising("parts"))).alias("moves"))


@query("q37_apply_edits", f"""WITH RECURSIVE {CONTRACTS}, {EDITS}, {HITS}, v AS MATERIALIZED (SELECT *, {VERDICT} AS rejection FROM h),
  s AS MATERIALIZED (SELECT doc_id, para_id, seq, row_number() OVER (PARTITION BY doc_id, para_id ORDER BY seq) AS k, list_transform(CASE WHEN occurrence = 0 THEN hits ELSE [hits[occurrence]] END, lambda x: {{'s': x::BIGINT, 'e': (x + length(target))::BIGINT}}) AS spans FROM v WHERE rejection IS NULL),
  f AS (SELECT doc_id, para_id, 1::BIGINT AS k, spans AS claims, 1 AS applied, 0 AS conflicts FROM s WHERE k = 1
    UNION ALL SELECT doc_id, para_id, k, CASE WHEN clash THEN claims ELSE list_concat(claims, spans) END, CASE WHEN clash THEN applied ELSE applied + 1 END, CASE WHEN clash THEN conflicts + 1 ELSE conflicts END FROM (
      SELECT f.doc_id, f.para_id, s.k, claims, spans, applied, conflicts, len(list_filter(spans, lambda x: len(list_filter(claims, lambda c: x.s < c.e AND c.s < x.e)) > 0)) > 0 AS clash FROM f JOIN s ON s.doc_id = f.doc_id AND s.para_id = f.para_id AND s.k = f.k + 1)),
  z AS (SELECT doc_id, para_id, max(k) AS k, arg_max(claims, k) AS claims, arg_max(applied, k) AS applied, arg_max(conflicts, k) AS conflicts FROM f GROUP BY doc_id, para_id),
  u AS (SELECT doc_id, para_id, unnest(claims) AS c FROM z), g AS (SELECT doc_id, para_id, c.s AS s, c.e AS e, coalesce(lag(c.e) OVER (PARTITION BY doc_id, para_id ORDER BY c.s), 0) AS was FROM u),
  t AS (SELECT doc_id, para_id, string_agg(substr(text, was + 1, s - was) || '[x]', '' ORDER BY s) || any_value(substr(text, top + 1)) AS accepted FROM (SELECT g.*, text, max(e) OVER (PARTITION BY doc_id, para_id) AS top FROM g JOIN l USING (doc_id, para_id)) GROUP BY doc_id, para_id)
  SELECT doc_id, para_id, applied, conflicts, md5(accepted) AS accepted_md5 FROM z JOIN t USING (doc_id, para_id)""")
def q37(spark, sf):
    """Quoted edits of all contracts, claimed in order of arrival and applied."""
    out = E.apply(E.locate(edits(spark, sf).withColumn("replacement", F.lit("[x]")), contracts(spark, sf)))
    return out.select("doc_id", "para_id", F.size("applied").alias("applied"), F.size("conflicts").alias("conflicts"), F.md5(F.col("accepted").cast("binary")).alias("accepted_md5"))


#: Items of a known type that have what it needs.
_COMPLETE = "type <> 'shred_clause' AND (type NOT IN ('rewrite_clause', 'delete_clause') OR clause IS NOT NULL) AND (type <> 'delete_section' OR section IS NOT NULL)"


@query("q38_conflicts", f"""WITH RECURSIVE {ACTIONS}, i AS MATERIALIZED (SELECT *, list_filter([clause, section, after_clause], lambda x: x IS NOT NULL) AS targets, coalesce(clause, section) AS own,
    type IN ('delete_clause', 'delete_section', 'insert_clause') AS structural, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END DESC, seq) AS k FROM a WHERE {_COMPLETE}),
  f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0 AS seq, false AS bad, []::VARCHAR[] AS gone, []::VARCHAR[] AS claimed, []::VARCHAR[] AS rewritten, []::STRUCT(own VARCHAR, find VARCHAR)[] AS quotes FROM i
    UNION ALL SELECT doc_id, k, seq, bad, CASE WHEN NOT bad AND type IN ('delete_clause', 'delete_section') THEN list_append(gone, own) ELSE gone END,
      CASE WHEN NOT bad AND structural THEN list_concat(claimed, targets) ELSE claimed END, CASE WHEN NOT bad AND type = 'rewrite_clause' THEN list_append(rewritten, own) ELSE rewritten END,
      CASE WHEN NOT bad AND type IN ('replace_text', 'delete_text') AND own IS NOT NULL THEN list_append(quotes, {{'own': own, 'find': find}}) ELSE quotes END
    FROM (SELECT i.*, f.gone, f.claimed, f.rewritten, f.quotes, len(list_filter(targets, lambda t: len(list_filter(gone, lambda d: t = d OR starts_with(t, d || '.'))) > 0)) > 0
      OR structural AND list_has_any(claimed, targets) OR NOT structural AND type <> 'comment' AND coalesce(list_contains(rewritten, own), false)
      OR type IN ('replace_text', 'delete_text') AND len(list_filter(quotes, lambda q: q.own = i.own AND (contains(q.find, i.find) OR contains(i.find, q.find)))) > 0 AS bad
      FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1))
  SELECT doc_id, seq, CASE WHEN bad THEN 'conflict' ELSE 'kept' END AS outcome FROM f WHERE k > 0""")
def q38(spark, sf):
    """The claim rules over all plans whose items are of a known type and complete."""
    from .merge import resolve_conflicts

    good = actions(spark, sf).filter(_COMPLETE)
    return resolve_conflicts(good.select("doc_id", "seq", "id", "type", "severity", "clause", "section", "after_clause", "find", "text")).select("doc_id", "seq", "outcome")


@query("q39_round_trip", f"WITH {CONTRACTS}, n AS (SELECT doc_id, sum(len(string_split(text, 'days')) - 1) AS days, sum(len(string_split(text, 'Note: ')) - 1) AS notes FROM l GROUP BY doc_id) SELECT doc_id, (days + notes)::INT AS edits, (2 * days + notes)::INT AS revisions, true AS accepts, true AS rejects FROM n")
def q39(spark, sf):
    """Each contract as a package: written, edited, written and read again; then both ways resolved."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("edits", pa.int32()), ("revisions", pa.int32()), ("accepts", pa.bool_()), ("rejects", pa.bool_())])

    def trip(known: list[str | None]) -> tuple:
        from ..operators.document import from_texts
        from ..sources import ooxml

        texts = [t or "" for t in known]
        doc = ooxml.read(ooxml.write(from_texts(texts, date="2026-01-01T00:00:00Z")), date="2026-01-01T00:00:00Z")
        edits = doc.replace_text("days", "working days", count=None) + doc.delete_matching("Note: ", count=None)
        again = ooxml.read(ooxml.write(doc))
        revisions, accepted = len(again.revisions()), again.copy()
        accepted.accept()
        again.reject()
        want = [t.replace("days", "working days").replace("Note: ", "") for t in texts]
        if all(t is None for t in known):  # sums over nulls alone
            edits = revisions = None
        return edits, revisions, accepted.texts() == want, again.texts() == texts

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            out = [(key, *trip(texts[i].as_py())) for i, key in enumerate(ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [()] * len(schema), schema.types)], schema=schema)

    # Little data, but much to do with it: a number of partitions of its own isn't merged by size.
    spread = contract_texts(spark, sf).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return spread.mapInArrow(run, "doc_id long, edits int, revisions int, accepts boolean, rejects boolean")


@query("q40_aligned_versions")
def q40(spark, sf):
    """Each contract against a version of it: some notes dropped, days changed, a clause put in."""
    from ..operators.compare import align

    old = contracts(spark, sf).withColumnRenamed("doc_id", "pair_id")
    new = old.filter("NOT (text LIKE 'Note%' AND para_id % 2 = 0)").withColumn("text", F.when(F.col("para_id") % 5 == 0, F.regexp_replace("text", " days", " weeks")).otherwise(F.col("text")))
    return align(old, new).groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"))
