"""Line dedup over levelled sorted runs of line hashes (DataFrame and SQL functions only).

A line's key has the white space at its ends stripped and A-Z lower-cased; it is
stored as two XXH64 hashes of different seeds (128 bits). Keys of at least
`min_chars` characters that at least `min_docs` documents hold are deduplicated:
of their lines, only those in the largest doc_id that holds them stay.

Documents come in batches, the largest ids first. A batch's lines are merge
anti-joined with the sorted runs: what no run has is kept, and becomes the batch's
own run; what a run has is dropped. When a level has `fanout` runs, they are
compacted into one sorted run of the next level, so that a batch meets a number of
runs that grows with the logarithm of the number of batches.

Defined results: a null or empty text is one empty line; rows that repeat an id are
one document (all rows of the largest id keep the line, all others lose it); rows
without an id hold no line and lose none; an empty table gives an empty result; other
columns are carried, clashing ones replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, documents, drop_written, let, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Runs of a level that are compacted; batches at least, and lines at stake that make one more.
FANOUT, BATCHES, BATCH_LINES = 3, 6, 50_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2, pos (from 1), first (the document's first row of that hash)."""
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(key_of(x).alias("key"), (i + 1).alias("pos")))
    long_enough = F.filter(keys, lambda k: F.length(k["key"]) >= min_chars)
    hashed = F.transform(long_enough, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(7), k["key"]).alias("h2"), k["pos"].alias("pos")))

    def marked(s):
        before = lambda i: s[F.greatest(i - 1, F.lit(0))]
        return F.transform(s, lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), ((i == 0) | (before(i)["h1"] != x["h1"]) | (before(i)["h2"] != x["h2"])).alias("first")))

    return docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(let(F.sort_array(hashed), marked)).alias("k")).select("doc_id", "k.*")


@dataclass
class LineRuns:
    """The levelled runs: sorted tables of (h1, h2, last_doc), each hash in one of them."""

    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Of a batch's lines, those that no run has: one merge anti join a run."""
        for run in self.runs():
            lines = lines.hint("merge").join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch's lines (doc_id, h1, h2) that no run has yet, as the batch's own run.

        They are aggregated and written first, so that a line that many documents hold
        is one row in the joins; left in one plan, the optimizer would join before it
        aggregates.
        """
        batch = written(lines.groupBy("h1", "h2").agg(F.max("doc_id").alias("last_doc")).sortWithinPartitions("h1", "h2"), "batch")
        if not self.runs():
            self._put(0, batch)
            return
        self._put(0, written(self.unseen(batch).sortWithinPartitions("h1", "h2"), "run"))
        drop_written(batch)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            together = old[0]
            for x in old[1:]:
                together = together.unionByName(x)
            n = together.sparkSession.conf.get("spark.sql.shuffle.partitions")
            self._put(level + 1, written(together.repartition(int(n), "h1", "h2").sortWithinPartitions("h1", "h2"), "run"))
            for x in old:
                drop_written(x)

    def merged(self) -> DataFrame:
        first, *rest = self.runs()
        for x in rest:
            first = first.unionByName(x)
        return first


def _with_hash(lines: DataFrame, keys: DataFrame, width: int = 48) -> DataFrame:
    """Inner join on the hash; the keys are counted, and broadcast if they fit the bound.

    Else it is a merge join whose hot lines adaptive execution splits: the keys'
    side has one row a hash.
    """
    small = keys.count() * width <= BROADCAST_BYTES
    return lines.join(F.broadcast(keys) if small else keys, ["h1", "h2"])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id and pos of the lines to drop; without a number of batches, one for each BATCH_LINES held and BATCHES at least."""
    lines = written(keyed_lines(docs, min_chars), "lines")
    enough = F.col("n") >= min_docs
    # Rows that hold a line are at least as many as documents; these are counted exactly for what is left.
    candidates = written(lines.filter("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(enough).select("h1", "h2"), "candidates")
    held = written(_with_hash(lines, candidates), "held")
    drop_written(lines)
    frequent = written(held.filter("first").select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(enough).select("h1", "h2"), "frequent")
    batches = batches or max(BATCHES, held.count() // BATCH_LINES)
    cuts = docs.agg(F.percentile_approx("doc_id", [1 - b / batches for b in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for cut in cuts or ():
        batch = batch + (F.col("doc_id") <= F.lit(cut)).cast("int")
    repeated = written(_with_hash(held, frequent).select("doc_id", "pos", "h1", "h2", batch.alias("batch")), "repeated", "batch")
    drop_written(held)
    state = LineRuns(fanout)
    for b in range(batches):
        state.add(repeated.filter(F.col("batch") == b).select("doc_id", "h1", "h2"))
    return _with_hash(repeated.drop("batch"), state.merged()).filter("doc_id < last_doc").select("doc_id", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """The input with its texts' repeated lines dropped, and n_lines, n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    dropped = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    per_doc = dropped.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_drop"))
    joined = docs.join(per_doc, "doc_id", "left").withColumn("_lines", lines_of(F.col("text"))).withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))

    def kept(lines):
        """What lies between the dropped lines, slice by slice: linear in the lines."""
        ends = F.concat(F.array(F.lit(0)), F.col("_drop"), F.array(F.size(lines) + 1))
        pieces = let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(F.col("_drop"))), lambda i: F.slice(lines, e[i] + 1, e[i + 1] - e[i] - 1)))
        return F.array_join(F.flatten(pieces), "\n")

    text = F.when(F.size("_drop") == 0, F.col("text")).otherwise(kept(F.col("_lines")))
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB; `{docs}` is the table to dedup.
KEPT_SQL = r"""
ll AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs}),
lk AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ll),
lf AS (SELECT key, max(doc_id) AS last_doc FROM lk WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
ld AS (SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id < last_doc AS dropped FROM lk LEFT JOIN lf USING (key)),
lo AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text FROM ld GROUP BY doc_id)
"""
ORACLE_SQL = "WITH " + KEPT_SQL.strip().format(docs="documents") + " SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM lo"
