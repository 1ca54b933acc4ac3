"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, free_name, join_counted, materialize, text_hash

_SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]
_RUN = "h1 long, h2 int, n_docs long"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.regexp_replace(line, _SPACE, ""), _UPPER, _LOWER)


def hash_of(key: Column) -> Column:
    """96 bits of two independent hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def document_keys(docs: DataFrame, min_chars: int = 1, *keep: Column) -> DataFrame:
    """(*keep, h1, h2): one row for each document and different line key in it of at least min_chars.

    Different keys of a document are found inside its row, without a shuffle.
    """
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    return docs.select(*keep, F.explode(F.transform(long, hash_of)).alias("line_hash")).select("*", "line_hash.h1", "line_hash.h2").drop("line_hash")


class LineRuns:
    """Document counts of line hashes in sorted runs, kept by level in a shared folder.

    Each batch merge-anti-joins the live runs: hashes that no run has become a run of their own at
    level 0, and the counts of hashes that a run already has are laid beside it as increments.
    fanout runs of one level are merged, with their increments, into one run of the next, so n batches
    leave O(log n) runs and each row is rewritten O(log n) times.  Merging moves hashes that reached
    min_docs to the settled run; batches merge-anti-join it first, so lines that are known to be
    frequent are neither compared with the runs nor stored again.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        #: For each level its runs: (hashes first seen in the run's batches, increments of hashes of older runs).
        self.levels: list[list[tuple[DataFrame, DataFrame | None]]] = [[]]
        self.settled: DataFrame | None = None

    def _put(self, run: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        return materialize(run.sortWithinPartitions(*_KEY), "line-run", instead_of)

    def _tables(self) -> list[DataFrame]:
        return [t for level in self.levels for run in level for t in run if t is not None]

    def _union(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def add(self, keys: DataFrame) -> None:
        """Count a batch of document_keys() rows and keep the counts."""
        self.add_counts(keys.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs")))

    def add_counts(self, counts: DataFrame) -> None:
        """Keep a batch of counts, one row a hash."""
        fresh = counts.select(*_KEY, "n_docs")
        if self.settled is not None:
            fresh = fresh.join(self.settled.select(*_KEY).hint("merge"), _KEY, "left_anti")
        if not self._tables():
            self.levels[0].append((self._put(fresh), None))
            return
        live = self._union([run for level in self.levels for run, _ in level]).select(*_KEY).hint("merge")
        own = self._put(fresh.join(live, _KEY, "left_anti"))
        known = self._put(fresh.join(live, _KEY, "left_semi"))
        self.levels[0].append((own, known))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge the runs of one level into one run of the next."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        own = self._union([run for run, _ in runs])
        more = [d for _, d in runs if d is not None]
        # Increments may belong to these runs or to older ones; those of older ones stay increments.
        added = self._union(more).groupBy(*_KEY).agg(F.sum("n_docs").alias("more")) if more else None
        merged = own if added is None else own.join(added.hint("merge"), _KEY, "left").select(*_KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))
        run = self._put(merged)
        rest = None if added is None else self._put(added.join(own.select(*_KEY).hint("merge"), _KEY, "left_anti").select(*_KEY, F.col("more").alias("n_docs")))
        self.levels[level + 1].append((run, rest))
        self.levels[level] = []
        reached = run.where(F.col("n_docs") >= self.min_docs)
        self.settled = self._put(reached if self.settled is None else reached.unionByName(self.settled).dropDuplicates(_KEY), self.settled)
        discard(*[t for pair in runs for t in pair])

    def frequent(self) -> DataFrame:
        """Hashes found in at least min_docs documents of all batches, as a written run.

        A settled hash may also lie in runs; its total only grows, so it is frequent either way.
        """
        tables = self._tables()
        if not tables:
            return self.spark.createDataFrame([], _RUN).select(*_KEY)
        total = self._union(tables).groupBy(*_KEY).agg(F.sum("n_docs").alias("n")).where(F.col("n") >= self.min_docs).select(*_KEY)
        if self.settled is not None:
            total = total.unionByName(self.settled.select(*_KEY)).distinct()
        return self._put(total)

    def drop(self) -> None:
        """Remove all runs."""
        discard(*self._tables(), self.settled)
        self.levels, self.settled = [[]], None


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int) -> tuple[DataFrame, int]:
    """((h1, h2, docs): frequent hashes and how many documents have them, as a written table; the number of rows counted).

    Documents are read once: counts by batch (a hash of the id) are written, and the batches then go
    through LineRuns one after another.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    keys = document_keys(docs, min_chars, batch)
    counts = materialize(keys.groupBy("batch", *_KEY).agg(F.count(F.lit(1)).alias("n_docs")).repartition("batch", *_KEY), "line-counts")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        runs.add_counts(counts.where(F.col("batch") == b))
    frequent = runs.frequent()
    sized = materialize(counts.join(frequent, _KEY).groupBy(*_KEY).agg(F.sum("n_docs").alias("docs")), "frequent-lines")
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    runs.drop()
    discard(counts, frequent)
    return sized, total


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the lines left out whose key occurs in at least min_docs documents.

    Returns all columns of docs, text without those lines, and n_lines, n_dropped (columns of docs with
    these two names give way; no other column is touched).  Lines meet the frequent hashes by hash:
    the few most frequent ones, whose number is bounded, by broadcast, the others by shuffle, so no
    line is a hot key.  Documents meet their frequent positions by id and text, one row each; kept
    lines never leave their document's row.

    Null or empty text: one empty line, which has no key of one code point, so it stays.  Repeated
    rows are documents of their own in counts; equal rows get equal results.  An empty table gives no rows.
    """
    sized, total = frequent_lines(docs, min_docs, min_chars, batches, fanout)
    row, lines = free_name(docs, "line_row"), F.split(F.coalesce("text", F.lit("")), "\n", -1)
    gone_at = free_name(docs, "gone")
    ident = F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), text_hash().alias("hash")).alias(row)
    at = docs.select(ident, F.posexplode(F.transform(lines, line_key)).alias("pos", "key")).where(F.length("key") >= min_chars)
    at = at.select(row, "pos", hash_of(F.col("key")).alias("h")).select(row, "pos", "h.h1", "h.h2")
    hits = join_counted(at, sized, _KEY, "docs", total, F.struct(row, "pos"))
    gone = hits.groupBy(row).agg(F.collect_set("pos").alias(gone_at))
    met = docs.select("*", ident).join(gone, row, "left")
    all_at = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.array_except(all_at, F.col(gone_at))
    n_lines = F.size(lines).cast("long").alias("n_lines")
    kept = F.array_join(F.element_at(F.transform(F.array(lines), lambda ls: F.transform(left, lambda i: F.get(ls, i))), 1), "\n")
    return met.select(
        *[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.when(F.col(gone_at).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
        n_lines,
        F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"),
    )
