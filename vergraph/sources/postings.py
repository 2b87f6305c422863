"""An inverted index of entities: postings of tokens and of trigrams.

Rows are kept once with what a search needs of them (JSON strings with their
paths, JSON as text), bucketed by id; postings (term, id) are bucketed and sorted
by term, so that a query reads the buckets of its own terms only.  Some terms are
in nearly every row: a bucket is written by as many tasks as the rows need, dealt
by id, as so many files.  A text that
contains the query holds all of its trigrams, so postings give a superset of the
rows that match, with an upper bound of the score of each.  Terms of more than
``COMMON_ROWS`` rows are counted, but not posted: they are taken to be in every row,
and a query that has no other is a scan.  The best of them by
bound are scored first; what cannot reach the score of the last of these is never
read.  Scores are those of the scans, ties included.

Changes come as batches: their rows and postings are written apart and stand in
for the older ones of their ids, until ``compact`` puts both together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Collection, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.functions.text import content_text, leaves, python_tokens, tokens
from vergraph.operators import search, versions
from vergraph.plans.graph import cut, send_package, shared_place

#: Rows to a bucket, about; small indexes have at least so many buckets.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 8
#: Rows whose postings (some hundred a row) are one task's, about, and rows to a part of a bucket of postings.
TASK_ROWS, PART_ROWS = 50_000, 2_000_000
#: Rows of a term up to which it is posted.
COMMON_ROWS = 100_000
#: Where a term is from: trigrams of name, of JSON strings, of JSON as text; tokens of name, of JSON strings.
NAME, LEAF, TEXT, NAME_TOKEN, LEAF_TOKEN = "n", "c", "t", "N", "C"


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[str, set[str]]]:
    for id_, field, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield id_, {field + t[i : i + 3] for t in texts for i in range(len(t) - 2)}


def _trigram_rows(batches: Iterator[pa.RecordBatch], common: Collection[str] = ()) -> Iterator[pa.RecordBatch]:
    """term, id from id, field, texts (lower case)."""
    for batch in batches:
        terms, ids = [], []
        for id_, own in _terms(batch):
            own = sorted(own.difference(common))
            terms += own
            ids += [id_] * len(own)
            if len(terms) > 200_000:
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array(ids, pa.string())], ["term", "id"])
                terms, ids = [], []
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array(ids, pa.string())], ["term", "id"])


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n of a task's rows, in pieces."""
    counts: Counter[str] = Counter()
    piece = lambda: pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])
    for batch in batches:
        for _, own in _terms(batch):
            counts.update(own)
            if len(counts) > 200_000:
                yield piece()
                counts.clear()
    yield piece()


def prepared(rows: DataFrame) -> DataFrame:
    """Current rows with their JSON strings and text, read once."""
    return rows.select("id", "entity_type", "name", "content", leaves("content").alias("_leaves"), content_text("content").alias("_text"))


def _fields(rows: DataFrame) -> DataFrame:
    """id, field, texts that trigrams are of."""
    values = F.transform("_leaves", lambda e: F.lower(e["value"]))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.transform(t, lambda x: F.coalesce(x, F.lit(""))).alias("texts")) for f, t in ((NAME, F.array(F.lower("name"))), (LEAF, values), (TEXT, F.array("_text")))])
    return rows.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.texts")


def _tokens(rows: DataFrame) -> DataFrame:
    """term, id of tokens."""
    in_leaves = F.array_distinct(F.flatten(F.transform("_leaves", lambda e: tokens(e["value"]))))
    both = F.concat(F.transform(tokens(F.coalesce("name", F.lit(""))), lambda t: F.concat(F.lit(NAME_TOKEN), t)), F.transform(in_leaves, lambda t: F.concat(F.lit(LEAF_TOKEN), t)))
    return rows.select(F.explode(both).alias("term"), "id")


def postings(rows: DataFrame, common: Collection[str] = ()) -> DataFrame:
    """term, id of prepared rows but for common terms; a term starts with the field it is from."""
    of_text = _fields(rows).mapInArrow(partial(_trigram_rows, common=frozenset(common)), "term string, id string")
    words = [t for t in common if t[0] in (NAME_TOKEN, LEAF_TOKEN)]
    of_words = _tokens(rows)
    return of_text.union(of_words.where(~F.col("term").isin(words)) if words else of_words)


def common_terms(rows: DataFrame, n: int) -> frozenset[str]:
    """Terms of more than COMMON_ROWS of n prepared rows."""
    if n <= COMMON_ROWS:
        return frozenset()
    of_text = _fields(rows).mapInArrow(_trigram_counts, "term string, n long")
    of_words = _tokens(rows).groupBy("term").agg(F.count("*").alias("n"))
    held = of_text.union(of_words).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON_ROWS)
    return frozenset(r["term"] for r in held.collect())  # no more than a row's terms times n / COMMON_ROWS


def dealt(posted: DataFrame, buckets: int, rows: int) -> DataFrame:
    """Postings of so many rows, dealt by bucket of the term and part of the ids."""
    bucket = F.pmod(F.hash("term"), F.lit(buckets))  # as bucketBy has it
    part = F.pmod(F.xxhash64("id"), F.lit(-(-rows // PART_ROWS) or 1))
    return posted.repartition(max(buckets, -(-rows // TASK_ROWS)), bucket, part)


class SearchIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.deltas = spark, root, 0
        self.rows_table = self.terms_table = ""
        self.delta: tuple[DataFrame, DataFrame] | None = None
        self.changed: DataFrame | None = None
        self.common: frozenset[str] = frozenset()

    def _write(self, rows: DataFrame) -> None:
        """Rows are dealt as they come, and prepared and kept once."""
        number = uuid.uuid4().hex[:8]
        self.rows_table, self.terms_table = f"vergraph_rows_{number}", f"vergraph_terms_{number}"
        n = rows.count()
        buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
        self._save(self.rows_table, prepared(rows.select("id", "entity_type", "name", "content").repartition(buckets, "id")), buckets, "id", number)
        kept = self.spark.table(self.rows_table)
        self.common = common_terms(kept, n)
        self._save(self.terms_table, dealt(postings(kept, self.common), buckets, n), buckets, "term", number)

    def _save(self, name: str, frame: DataFrame, buckets: int, key: str, number: str) -> None:
        frame.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{self.root}/{number}/{name}").saveAsTable(name)

    def add(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Current rows of a change batch; ids in ``gone`` are left without a row."""
        new = prepared(rows)
        ids = rows.select("id") if gone is None else rows.select("id").union(gone.select("id"))
        folder = f"{self.root}/delta-{self.deltas}-{uuid.uuid4().hex[:8]}"
        self.deltas += 1
        if self.delta is not None:
            new = new.unionByName(self.delta[0].join(ids, "id", "left_anti"))
            ids = ids.union(self.changed)
        new.write.parquet(f"{folder}/rows")
        kept = self.spark.read.schema(new.schema).parquet(f"{folder}/rows")
        postings(kept, self.common).write.parquet(f"{folder}/terms")
        ids.distinct().write.parquet(f"{folder}/ids")
        self.delta = kept, self.spark.read.schema("term string, id string").parquet(f"{folder}/terms")
        self.changed = self.spark.read.schema("id string").parquet(f"{folder}/ids")

    def compact(self) -> None:
        """One set of tables again."""
        self._write(self.rows())
        self.delta = self.changed = None

    def rows(self) -> DataFrame:
        base = self.spark.table(self.rows_table)
        return base if self.delta is None else base.join(self.changed, "id", "left_anti").unionByName(self.delta[0])

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The rows of a few candidates: their buckets, or else a join without a shuffle of the rows."""
        few = ids.limit(1001).collect()
        if len(few) <= 1000:
            return self.rows().where(F.col("id").isin([r["id"] for r in few]))
        return self.rows().join(ids, "id", "left_semi")

    def hits(self, terms: dict[str, list[str]]) -> DataFrame:
        """id, and for every name how many of its terms (none of them common) the id has."""
        every = sorted({t for own in terms.values() for t in own})
        base = self.spark.table(self.terms_table).where(F.col("term").isin(every))
        if self.delta is not None:
            base = base.join(self.changed, "id", "left_anti").unionByName(self.delta[1].where(F.col("term").isin(every)))
        return base.groupBy("id").agg(*[F.count_if(F.col("term").isin(own)).alias(name) if own else F.lit(0).cast("long").alias(name) for name, own in terms.items()])

    def _rare(self, field: str, own: list[str]) -> list[str]:
        """The terms of a field that are posted."""
        return [field + g for g in own if field + g not in self.common]

    def _containing(self, pieces: list[str], fields: tuple[str, ...]) -> DataFrame | None:
        """Ids of rows that may contain all pieces in one of the fields; None if
        no piece is long enough to tell, or a field has common terms only."""
        own = sorted({g for p in pieces for g in trigrams(p)})
        if not own:
            return None
        rare = {f: self._rare(f, own) for f in fields}
        if not all(rare.values()):
            return None
        found = self.hits(rare)
        return found.where(" or ".join(f"{f} = {len(held)}" for f, held in rare.items())).select("id")

    def name_contains(self, pattern: str, wildcards: bool = True) -> DataFrame:
        """As the scan of ``versions.name_contains`` (FLT12)."""
        pieces = re.split(r"\\.|[%_]", pattern.lower()) if wildcards else [pattern.lower()]
        ids = self._containing(pieces, (NAME,))
        return versions.name_contains(self.rows() if ids is None else self.rows_of(ids), pattern, wildcards)

    def search_replica(self, query: str, entity_types: list[str] | None = None) -> DataFrame:
        """As the scan of ``search.search_replica`` (SCH10)."""
        ids = None if query == "*" else self._containing([query.lower()], (NAME, TEXT))
        return search.search_replica(self.rows() if ids is None else self.rows_of(ids), query, entity_types)

    def bounds(self, query: str) -> DataFrame | None:
        """id, bound: no less than scorer B's score; None where postings cannot tell
        (a query so short that it may be contained unseen, a word of an entity type or a
        common one)."""
        q, own = query.lower(), python_tokens(query)
        kinds = [r["entity_type"] for r in self.rows().select("entity_type").distinct().collect()]  # the few types
        if len(q) < 3 or any(t in (k or "") for t in own for k in kinds):
            return None
        grams, n = trigrams(q), max(1, len(own))
        ng, cg, nt, ct = (self._rare(f, t) for f, t in ((NAME, grams), (LEAF, grams), (NAME_TOKEN, own), (LEAF_TOKEN, own)))
        if not ng or not cg or len(nt) < len(own) or len(ct) < len(own):
            return None
        found = self.hits({"ng": ng, "cg": cg, "nt": nt, "ct": ct})
        found = found.where(f"ng = {len(ng)} or cg = {len(cg)} or nt > 0 or ct > 0")
        sizes = self.rows().select("id", F.size("_leaves").alias("n_leaves"))
        name = F.when(F.col("ng") == len(ng), 3.0).otherwise(2.0 * F.col("nt") / n)
        leaf = F.when(F.col("cg") == len(cg), 1.5).otherwise(F.col("ct") / n)
        return found.join(sizes, "id").select("id", (name + leaf * F.col("n_leaves")).alias("bound"))

    def search_engine(self, query: str, entity_types: list[str] | None = None, limit: int = 10, min_score: float = 0.1) -> DataFrame:
        """As the scan of ``search.search_engine`` (SCH5)."""
        bounds = self.bounds(query) if query.strip() and min_score > 0 else None
        if bounds is None:
            return search.search_engine(self.rows(), query, entity_types, limit, min_score)
        if entity_types:
            bounds = bounds.join(self.rows().where(F.col("entity_type").isin(*entity_types)).select("id"), "id", "left_semi")
        bounds = cut(bounds)
        first = bounds.orderBy(F.desc("bound"), "id").limit(4 * limit)
        scored = search.search_engine(self.rows_of(first.select("id")), query, None, limit, min_score).select("score").collect()  # at most ``limit`` rows
        # what is bounded below the last of a full page cannot be on it
        least = scored[-1]["score"] if len(scored) == limit else min_score
        able = cut(bounds.where(F.col("bound") >= least - 1e-9).select("id"))
        return search.search_engine(self.rows_of(able), query, None, limit, min_score)


def build(rows: DataFrame) -> SearchIndex:
    """An index of current rows (id, entity_type, name, content), in the shared folder."""
    spark = rows.sparkSession
    send_package(spark)
    index = SearchIndex(spark, f"{shared_place(spark)}/vergraph/search-{uuid.uuid4().hex}")
    index._write(rows)
    return index
