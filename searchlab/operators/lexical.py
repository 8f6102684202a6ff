"""Field-weighted BM25 over an inverted index kept as Parquet tables.

A posting's score is the query's weight of the term times the posting's saturation, which the
index fixes. Postings lie in blocks: those of one term in documents of about one length.
The largest saturation of each block is kept, so the most that a block can add to a score is
known before any of its postings is read.

A search needs only the best k documents of each query:

1. In each class of length the blocks that can add least are set aside, as long as all of them
   together stay below a small share of what the query can score at most. These are the common
   words, whose postings are most of the index. The others are read and summed.
2. The k-th best of these sums is a bar that every document of the result reaches. Documents stay
   whose sum reaches it together with the most that the blocks set aside could add. A task that sums a part of
   the documents knows a lower bar, its own k-th best, and passes on only what reaches that.
3. Only for these documents the postings set aside are looked up.

A document that is only in blocks set aside stays below the bar. Where the bar is too low to
say so, as when there are fewer than k documents, that query reads all its blocks. The result is exact.

Sums are made in parts of documents: the postings of a part meet the queries of a block as columns of numbers, and
the sums of all pairs of document and query are one matrix of bounded size. So no pair of posting and query, and no
sum that cannot matter, is ever a row of Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from searchlab.functions.text import document_words, query_tokens
from searchlab.operators.topk import SCORE_DIGITS, TINY, rank_top_k
from searchlab.sources.staging import new_location, stage

# Field weights and the constants of the scoring function.
FIELD_WEIGHTS = {"title": 3.0, "skills": 2.0, "summary": 1.0}
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

MIN_BUCKETS, MAX_BUCKETS = 16, 16384
BUCKET_BYTES = 32 * 1024 * 1024  # of indexed text
COUNTED_BYTES = 8 * 1024 * 1024  # of texts whose terms a task counts at once
LENGTH_CLASSES = 2  # for each doubling of the document length
ASIDE = 1 / 32  # of a query's largest possible score
MASK_BITS = 64  # queries that one long number stands for
QUERIES_AT_ONCE = 256  # queries that a posting meets at once, on average of the blocks
PART_POSTINGS = 500_000  # postings that a task sums at once, on average of the parts
PRODUCTS_AT_ONCE = 2 * 1024 * 1024  # pairs of query and posting, and sums, that a task holds at a time
SLACK = 1e-9  # scores are sums in any order
PRUNE_FROM = 50_000_000  # postings of a batch; below, the rounds of pruning cost more than they save


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def _count_terms(weights: list[float], doc_col: str) -> Callable:
    """Rows of (doc, text of each field) -> the postings of some rows at a time, in blocks.

    Terms get the numbers of a dictionary; counting is then a matter of whole columns.
    """

    def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = [pc.split_pattern(rows.column(i), " ") for i in range(1, len(weights) + 1)]
        sizes = [pc.list_value_length(tokens).to_numpy() for tokens in lists]
        row = np.concatenate([np.repeat(np.arange(len(rows)), n) for n in sizes])
        field = np.repeat(np.arange(len(weights)), [n.sum() for n in sizes])
        tokens = pa.concat_arrays([tokens.flatten() for tokens in lists])
        held = pc.not_equal(tokens, "")  # splitting an empty text gives one
        tokens, kept = tokens.filter(held).dictionary_encode(), held.to_numpy(zero_copy_only=False)
        row, field = row[kept], field[kept]
        doc_len = np.bincount(row, minlength=len(rows))
        # In the order of term and length, so that the postings of a block stand together.
        by_length = np.argsort(doc_len, kind="stable")
        place = np.empty(len(rows), "int64")
        place[by_length] = np.arange(len(rows))
        held = np.sort((tokens.indices.to_numpy().astype("int64") * len(rows) + place[row]) * len(weights) + field)
        first = np.flatnonzero(np.diff(held, prepend=-1))
        n = np.diff(first, append=len(held))
        pairs, field = np.divmod(held[first], len(weights))
        first = np.diff(pairs, prepend=-1) != 0
        pair, pairs = np.cumsum(first) - 1, pairs[first]
        tf = np.bincount(pair, weights=n).astype("int64")
        wtf = np.bincount(pair[::-1], weights=(np.array(weights)[field] * n)[::-1])
        term, doc = np.divmod(pairs, len(rows))
        doc = by_length[doc]
        length = doc_len[doc]
        lengths = length_class(length)
        starts = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(lengths, prepend=-1))
        offsets = pa.array(np.append(starts, len(pairs)).astype("int32"))
        held_by = pa.StructArray.from_arrays(
            [rows.column(0).take(pa.array(doc)), pa.array(length), pa.array(wtf), pa.array(tf)],
            names=[doc_col, "doc_len", "wtf", "tf"],
        )
        return pa.RecordBatch.from_arrays(
            [
                tokens.dictionary.take(pa.array(term[starts])), pa.array(lengths[starts]),
                pa.ListArray.from_arrays(offsets, held_by),
            ],
            names=["term", "class", "held_by"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.binary_length(batch.column(i)).to_numpy().astype("int64") for i in range(1, len(weights) + 1))
            parts = np.cumsum(size) // COUNTED_BYTES
            ends = np.append(np.flatnonzero(np.diff(parts)) + 1, len(batch))
            for start, end in zip(np.append(0, ends), ends):
                yield counted(batch.slice(start, end - start))

    return run


def length_class(doc_len: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(doc_len) * LENGTH_CLASSES).astype("int32")


def _posting_blocks(corpus: DataFrame, doc_col: str, fields: dict[str, float]) -> DataFrame:
    """``(term, class, held_by)``: postings of a term in documents of about one length.

    The documents are those of a task's next rows, so a term and class has several blocks.
    """
    texts = [document_words(F.coalesce(field, F.lit(""))).alias(f"_{n}") for n, field in enumerate(fields)]
    posting = T.StructType([
        T.StructField(doc_col, corpus.schema[doc_col].dataType), T.StructField("doc_len", T.LongType()),
        T.StructField("wtf", T.DoubleType()), T.StructField("tf", T.LongType()),
    ])
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("class", T.IntegerType()),
        T.StructField("held_by", T.ArrayType(posting)),
    ])
    count = _count_terms([float(w) for w in fields.values()], doc_col)
    return corpus.select(doc_col, *texts).mapInArrow(count, schema)


def build_postings(
    corpus: DataFrame, doc_col: str = "doc_id", fields: dict[str, float] = FIELD_WEIGHTS
) -> DataFrame:
    """``(doc_id, doc_len, term, wtf, tf)``: one row per document and term.

    ``wtf`` is the term frequency weighted by field, ``doc_len`` the unweighted
    number of tokens of all indexed fields. Counting needs no shuffle; every row of ``corpus`` is
    a document of its own.
    """
    blocks = _posting_blocks(corpus, doc_col, fields)
    return blocks.select("term", F.inline("held_by")).select(doc_col, "doc_len", "term", "wtf", "tf")


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of an index: postings and blocks by term bucket, one row of totals."""

    postings: DataFrame
    blocks: DataFrame
    totals: DataFrame
    doc_col: str = "doc_id"
    buckets: int = MIN_BUCKETS

    @property
    def terms(self) -> DataFrame:
        """``(term, df)``: documents that hold the term."""
        return self.blocks.groupBy("term").agg(F.sum("n").alias("df"))


def bucket_count(corpus: DataFrame, fields: dict[str, float] = FIELD_WEIGHTS) -> int:
    size = sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(0).cast("long"))
    total = corpus.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return min(max(-(-total // BUCKET_BYTES), MIN_BUCKETS), MAX_BUCKETS)


def write_index(
    corpus: DataFrame,
    location: str | None = None,
    doc_col: str = "doc_id",
    buckets: int | None = None,
    fields: dict[str, float] = FIELD_WEIGHTS,
) -> LexicalIndex:
    """Tokenise once and write the index; every later search only reads it.

    The number of buckets follows from the size of the texts unless it is given. ``rebalance``
    is the one shuffle: it splits the postings of a very common term over many files and merges the
    buckets of rare ones. Files are sorted by term and length class, so that a search skips what
    lies between its blocks. Postings are placed and sorted as blocks, which are far fewer.
    """
    spark = corpus.sparkSession
    location = location or new_location(spark, "lexical_index")
    buckets = buckets or bucket_count(corpus, fields)
    (
        _posting_blocks(corpus, doc_col, fields)
        .withColumn("bucket", term_bucket(F.col("term"), buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "class")
        .select("bucket", "term", "class", F.inline("held_by"))
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{location}/postings")
    )
    postings = spark.read.parquet(f"{location}/postings")
    # Documents without any token count in the totals as well.
    totals = corpus.agg(F.count("*").alias("documents")).withColumn(
        "tokens", postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar()
    )
    totals = totals.withColumns({
        "buckets": F.lit(buckets), "weights": F.lit(",".join(f"{f}={float(w)}" for f, w in fields.items())),
    })
    totals.write.mode("overwrite").parquet(f"{location}/totals")
    totals = spark.read.parquet(f"{location}/totals")
    (
        postings.groupBy("bucket", "term", "class")
        .agg(F.count("*").alias("n"), F.max(_saturation(totals)).alias("most"))
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{location}/blocks")
    )
    return read_index(spark, location, doc_col)


def read_index(spark, location: str, doc_col: str = "doc_id") -> LexicalIndex:
    totals = spark.read.parquet(f"{location}/totals")
    postings, blocks = (spark.read.parquet(f"{location}/{name}") for name in ("postings", "blocks"))
    return LexicalIndex(postings, blocks, totals, doc_col, totals.first()["buckets"])


def _saturation(totals: DataFrame) -> Column:
    """What a posting adds to a score for each unit of weight."""
    mean_length = totals.select(F.col("tokens") / F.col("documents")).scalar()
    length_norm = F.lit(1 - B) + F.lit(B) * F.col("doc_len") / mean_length
    return F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * length_norm)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, occurrences)``; a repeated token counts each time."""
    return (
        queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("token"))
        .groupBy("query_id", F.lower("token").alias("term"))
        .agg(F.count("*").alias("occurrences"))
    )


def require_searchable(queries: DataFrame) -> None:
    empty = queries.filter(F.size(query_tokens(F.coalesce("query", F.lit("")))) == 0).head(1)
    if empty:
        raise ValueError(f"query without a searchable token: {empty[0]['query_id']!r}")


def weighted_terms(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, bucket, term, df, weight)``: weight is occurrences times inverse frequency.

    Staged, so that its size is known before the plans below are made.
    """
    asked = query_terms(queries).withColumn("bucket", term_bucket(F.col("term"), index.buckets))
    documents = index.totals.select("documents").scalar()
    idf = F.log((documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = (
        index.blocks.join(asked, ["bucket", "term"])
        .groupBy("query_id", "bucket", "term", "occurrences")
        .agg(F.sum("n").alias("df"))
        .withColumn("weight", F.col("occurrences") * F.when(idf <= 0, IDF_FLOOR).otherwise(idf))
    )
    # The predicate holds for every row; partition pruning at run time asks for one.
    return stage(terms.drop("occurrences"), "query_terms").filter(F.col("weight") > 0)


def _matches(index: LexicalIndex, weights: DataFrame, payload: list[Column]) -> DataFrame:
    """One row per query, term and document that holds the term.

    Only the buckets of the batch's terms are read, and of those only its postings.
    These are placed by document before they meet the queries: a posting travels
    once however many queries share its term, a common term spreads over all tasks,
    and the sums per query and document need no further shuffle.
    """
    postings = (
        index.postings.join(weights, ["bucket", "term"], "left_semi")
        .select("term", index.doc_col, *payload)
        .repartition(index.doc_col)
    )
    return postings.join(weights.select("query_id", "term", "weight"), "term")


def match_counts(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """Documents holding at least one query token, per query.

    A query is one bit of a mask: a posting meets ``MASK_BITS`` queries of its term at once.
    """
    weights = weighted_terms(index, queries).drop("weight")
    number = F.monotonically_increasing_id()
    numbers = stage(
        weights.select("query_id").distinct().select(
            "query_id", F.floor(number / MASK_BITS).alias("mask"), (number % MASK_BITS).cast("int").alias("bit")
        ),
        "query_numbers",
    )
    own = F.col("w.query_id").eqNullSafe(F.col("n.query_id"))
    masks = (
        weights.alias("w").join(numbers.alias("n"), own)
        .groupBy(F.col("mask").alias("query_id"), "bucket", "term")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("weight"))
    )
    held = (
        _matches(index, stage(masks, "query_masks").filter(F.col("weight") != 0), [])
        .groupBy("query_id", index.doc_col)
        .agg(F.bit_or("weight").alias("held"))
    )
    counts = held.groupBy(F.col("query_id").alias("mask")).agg(
        F.array(*[F.sum(F.getbit("held", F.lit(i)).cast("long")) for i in range(MASK_BITS)]).alias("n")
    )
    return numbers.join(counts, "mask").select("query_id", F.get("n", F.col("bit")).alias("n_docs"))


def query_blocks(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    """The blocks of the queries' terms: ``(query_id, bucket, term, class, n, weight, most, aside, rest)``.

    ``most`` is what the block can add to a score at most, ``rest`` what all blocks set ``aside`` in this
    class of length can add. Staged like the terms.
    """
    by_class = Window.partitionBy("query_id", "class")
    upward = by_class.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        index.blocks.join(weights, ["bucket", "term"])
        .repartition("query_id")  # serves all windows
        .withColumn("most", F.col("weight") * F.col("most"))
        .withColumn("_all", F.sum("most").over(by_class))
        .withColumn("_upto", F.sum("most").over(upward))
        .withColumn("aside", F.col("_upto") < F.max("_all").over(Window.partitionBy("query_id")) * F.lit(ASIDE))
        .withColumn("rest", F.coalesce(F.max(F.when(F.col("aside"), F.col("_upto"))).over(by_class), F.lit(0.0)))
        .select("query_id", "bucket", "term", "class", "n", "weight", "most", "aside", "rest")
    )
    return stage(blocks, "query_blocks").filter(F.col("weight") > 0)


def _significant(score: np.ndarray) -> np.ndarray:
    """``topk.significant`` for columns of numbers."""
    scale = 10.0 ** (SCORE_DIGITS - 1 - np.floor(np.log10(np.maximum(np.abs(score), TINY))))
    return np.where(np.abs(score) < TINY, 0.0, np.rint(score * scale) / scale)


def _sum_part(doc_col: str, k: int, schema: pa.Schema) -> Callable:
    """Postings of some documents and the questions of some queries -> the sums that can matter.

    ``schema`` names the columns: with ``rest``, all documents that reach the k-th best of this part together
    with the rest, and on one row of each query the number of its documents (``summed``); else the best k.
    """

    def best(scores: np.ndarray, met: np.ndarray, rest: np.ndarray | None):
        bar = np.full(len(scores), -np.inf)
        if scores.shape[1] > k:
            last = scores.shape[1] - k
            bar = np.partition(np.where(met, scores, -np.inf), last, axis=1)[:, last]
        bar = np.where(np.isfinite(bar), bar - np.abs(bar) * SLACK, -np.inf)[:, None]
        query, doc = np.nonzero(met & ((scores if rest is None else scores + rest[:, None]) >= bar))
        if rest is None:
            order = np.lexsort((doc, -_significant(scores[query, doc]), query))
            query, doc = query[order], doc[order]
            few = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, doc = query[few], doc[few]
        return query, doc

    def summed(postings: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(postings) or not len(asked):
            return schema.empty_table()
        asked = asked.sort_by("place")
        places, first, asking = np.unique(asked["place"].to_numpy(), return_index=True, return_counts=True)
        names = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        queries, query_of = names.dictionary, names.indices.to_numpy()
        weight, n_queries = asked["weight"].to_numpy(), len(names.dictionary)
        rest = None
        if "rest" in asked.column_names:
            rest = np.zeros(n_queries)
            rest[query_of] = asked["rest"].to_numpy()
        # Documents get numbers in their order.
        held_by = postings[doc_col].combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(held_by.dictionary, null_placement="at_start").to_numpy()
        docs, number = held_by.dictionary.take(pa.array(order)), np.empty(len(order), "int64")
        number[order] = np.arange(len(order))
        doc = number[held_by.indices.to_numpy()]
        # Rows of one id are one document, which then has each term once.
        pair = doc * len(places) + np.searchsorted(places, postings["place"].to_numpy())
        order = np.argsort(pair, kind="stable")
        own = np.flatnonzero(np.diff(pair[order], prepend=-1))
        saturation = np.add.reduceat(postings["saturation"].to_numpy()[order], own)
        doc, place = np.divmod(pair[order][own], len(places))
        n = asking[place]
        size = np.bincount(doc, weights=n).astype("int64") + n_queries
        parts = np.cumsum(size) // PRODUCTS_AT_ONCE
        ends = np.append(np.flatnonzero(np.diff(parts)) + 1, len(docs))
        out = []
        for start, end in zip(np.append(0, ends), ends):
            some = slice(*np.searchsorted(doc, [start, end]))
            times, width = n[some], end - start
            upto = np.cumsum(times)
            at = np.arange(upto[-1]) + np.repeat(first[place[some]] - (upto - times), times)
            cell = query_of[at] * width + np.repeat(doc[some] - start, times)
            scores = np.bincount(cell, weights=weight[at] * np.repeat(saturation[some], times), minlength=n_queries * width)
            met = np.zeros(n_queries * width, bool)
            met[cell] = True
            scores, met = scores.reshape(n_queries, width), met.reshape(n_queries, width)
            query, found = best(scores, met, rest)
            columns = {
                "query_id": queries.take(pa.array(query)), doc_col: docs.take(pa.array(found + start)),
                "score": pa.array(scores[query, found]),
            }
            if rest is not None:
                once = np.diff(query, prepend=-1) != 0
                columns["class"] = pa.array(np.full(len(query), asked["class"][0].as_py(), "int32"))
                columns["summed"] = pa.array(np.where(once, met.sum(axis=1)[query], 0))
            out.append(pa.table([columns[name] for name in schema.names], schema=schema))
        return pa.concat_tables(out)

    return summed


def _sums(index: LexicalIndex, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc, score)``: sums over the postings of ``asked`` (query_id, bucket, term, n, weight).

    Only rows that can be among the best ``k`` of their query are passed on (see ``_sum_part``). With the columns ``class``
    and ``rest`` sums are those of a document in its class, followed by ``class`` and ``summed``.
    A posting travels once for each block of ``QUERIES_AT_ONCE`` queries that share its term, however many these are;
    a common term spreads over all parts of the documents.
    """
    by_class, doc = "rest" in asked.columns, index.doc_col
    held = ["bucket", "term"] + (["class"] if by_class else [])
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES_AT_ONCE))
    asked = asked.withColumn("block", F.pmod(F.hash("query_id"), F.lit(blocks)).cast("long"))
    group = F.col("block") * 1024 + (F.col("class") if by_class else F.lit(0))  # classes are logarithms
    together = Window.partitionBy("group")
    terms = (
        asked.groupBy("block", *held).agg(F.max("n").alias("n"))
        .withColumns({"group": F.shiftleft(group, 32), "place": F.monotonically_increasing_id()})
        .withColumn("parts", F.ceil(F.sum("n").over(together) / PART_POSTINGS).cast("int"))
    )
    terms = stage(terms, "search_terms").filter(F.col("parts") > 0)  # see weighted_terms
    part = F.col("group") + F.pmod(F.hash(doc), F.col("parts"))
    postings = index.postings.join(terms.drop("n", "block"), held).select(
        part.alias("part"), F.col("place").alias("place"), doc, _saturation(index.totals).alias("saturation")
    )
    parts = F.explode(F.sequence("group", F.col("group") + F.col("parts") - 1))
    asked = asked.drop("n").join(terms, ["block", *held]).select(
        parts.alias("part"), "place", "query_id", "weight", *(["class", "rest"] if by_class else [])
    )
    out = T.StructType([asked.schema["query_id"], index.postings.schema[doc], T.StructField("score", T.DoubleType())])
    if by_class:
        out = out.add("class", T.IntegerType()).add("summed", T.LongType())
    of_part = _sum_part(doc, k, to_arrow_schema(out))
    return postings.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(of_part, out)


def _completed(index: LexicalIndex, found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``found`` (query_id, doc, class, score) with the scores of the postings of ``blocks`` added.

    Every document found asks for the terms of its query's blocks; of the postings only those of
    documents that were found at all go on to meet these questions.
    """
    doc = index.doc_col
    asked = found.join(blocks.select("query_id", "class", "bucket", "term", "weight"), ["query_id", "class"])
    postings = (
        index.postings.join(blocks.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        .join(found.select(doc).distinct(), doc, "left_semi")
        .select("term", doc, _saturation(index.totals).alias("_saturation"))
    )
    added = postings.join(asked, [doc, "term"]).select(
        "query_id", doc, (F.col("weight") * F.col("_saturation")).alias("score")
    )
    return (
        found.select("query_id", doc, "score").unionByName(added)
        .groupBy("query_id", doc).agg(F.sum("score").alias("score"))
    )


def _bars(sums: DataFrame, blocks: DataFrame, doc: str, k: int) -> DataFrame:
    """``(query_id, bar, whole)``: at least k documents reach the bar; ``whole`` where documents that are
    only in blocks set aside could reach it too."""
    best = rank_top_k(sums, k, ["query_id"], doc).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score") * (1 - SLACK)).otherwise(0.0).alias("bar")
    )
    rest = blocks.groupBy("query_id").agg(F.max("rest").alias("rest"), F.max("aside").alias("some"))
    bar = F.coalesce("bar", F.lit(0.0))
    return rest.join(best, "query_id", "left").select("query_id", bar.alias("bar"), (F.col("some") & (F.col("rest") >= bar)).alias("whole"))


@dataclass(frozen=True)
class PrunedSearch:
    """What a search reads: its blocks, sums over those not set aside that reach the bar of their part, the bar
    of all, documents that stay."""

    blocks: DataFrame
    sums: DataFrame
    bars: DataFrame
    kept: DataFrame

    def counts(self) -> DataFrame:
        """``(query_id, postings, postings_read, documents_summed, documents_kept)``; a query that reads
        all its blocks keeps the documents of all."""
        read = ~F.col("aside") | F.col("whole")
        out = self.blocks.join(self.bars, "query_id").groupBy("query_id").agg(
            F.sum("n").alias("postings"), F.sum(F.when(read, F.col("n")).otherwise(0)).alias("postings_read")
        )
        for name, table, n in (("documents_summed", self.sums, F.sum("summed")), ("documents_kept", self.kept, F.count("*"))):
            out = out.join(table.groupBy("query_id").agg(n.alias(name)), "query_id", "left")
        return out.fillna(0)


def prune(index: LexicalIndex, weights: DataFrame, k: int) -> PrunedSearch:
    """The documents of each query that can be among its best ``k``, with what they have so far."""
    blocks = query_blocks(index, weights)
    sums = stage(_sums(index, blocks.filter("not aside").drop("most", "aside"), k), "sums")
    bars = stage(_bars(sums, blocks, index.doc_col, k), "bars")
    limits = blocks.select("query_id", "class", "rest").distinct().join(bars.filter("not whole"), "query_id")
    kept = sums.join(limits, ["query_id", "class"]).filter(F.col("score") + F.col("rest") >= F.col("bar"))
    return PrunedSearch(blocks, sums, bars, stage(kept.select("query_id", index.doc_col, "class", "score"), "kept_documents"))


def _pruned_scores(index: LexicalIndex, weights: DataFrame, k: int) -> DataFrame:
    found = prune(index, weights, k)
    scored = _completed(index, found.kept, found.blocks.filter("aside"))
    whole = found.bars.filter("whole").select("query_id")
    if whole.isEmpty():
        return scored
    return scored.unionByName(_whole_scores(index, weights.join(whole, "query_id", "left_semi"), k))


def _whole_scores(index: LexicalIndex, weights: DataFrame, k: int) -> DataFrame:
    return _sums(index, weights.withColumnRenamed("df", "n"), k)


def search_bm25(index: LexicalIndex, queries: DataFrame, k: int = 20, prune_from: int = PRUNE_FROM) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the best ``k`` documents, for the whole batch of queries.

    A batch whose terms have fewer than ``prune_from`` postings is summed at once; the result is
    the same.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    weights = weighted_terms(index, queries)
    whole = (weights.agg(F.sum("df")).first()[0] or 0) < prune_from
    scored = (_whole_scores if whole else _pruned_scores)(index, weights, k)
    return rank_top_k(scored, k, ["query_id"], index.doc_col)
