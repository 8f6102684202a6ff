"""Near-duplicates: banded minimal hashes, sequential Bayesian verification, exact sets.

1. Every whole text becomes its set of word shingles (64-bit), and from it ``HASHES``
   minimal hashes: ``BANDS`` bands of ``ROWS`` hashes choose candidates, the lowest byte of each
   hash is kept for verification.
2. Equal sets are one representative from here on (copies are never paired).
3. Representatives that agree in a band are candidates. No bucket is expanded into all its
   pairs: first each one meets one central member of its buckets, then each one that stays
   outside of a bucket's leading component meets up to ``MEETINGS`` of its most central
   members; links found tie components together, and only candidates that still are in
   different components are paired at the end, so that no link between components is lost.
   A pair that shares a rare shingle (in at most ``RARE``
   candidates) is found by it; any other pair shares none of its rare shingles, and is left out where
   the rest of both sets cannot reach the threshold (an exact bound, no pair is lost).
4. A candidate pair compares its hashes batch by batch. After each batch the posterior of
   the similarity (uniform prior) is known from the matches so far; the pair is given up when
   the similarity threshold is reached with a probability below ``MISS``.
5. Survivors are decided on their full sets.

Two texts at the threshold of 0.8 share no band with a probability of 3e-6, less above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from searchlab.llm.common import document_columns, fresh_name
from searchlab.llm.components import components, same_id_links
from searchlab.sources.staging import stage

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-7
MEETINGS = 16
RARE = 128
SALTS = 64
PERCENT = 80
SEED = 20240229
BLOCK = 1024


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    width = min(words, len(hashes))
    mixed = np.full(len(hashes) - width + 1, width, np.uint64)
    for at in range(width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += hashes[at : at + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return (
        random.integers(0, 2**32, HASHES, dtype=np.uint32),
        random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
    )


def minimal_hashes(members: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``HASHES`` minimal 32-bit hashes of a set."""
    xor, factor = seeds
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    short = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        mixed = short[at : at + BLOCK, None] ^ xor
        mixed *= factor
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def _features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_key (16 bytes of the whole set), bands (64-bit keys), sketch (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeds = _seeds()
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py(), words)
                least = minimal_hashes(members, seeds)
                sizes.append(len(members))
                keys.append(xxhash.xxh3_128_digest(members.tobytes()))
                raw = least.tobytes()
                bands.append([
                    xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], seed=b) - 2**63
                    for b in range(BANDS)
                ])
                sketches.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n", "set_key", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, set_key binary, bands array<long>, sketch binary")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """Fewest matches after each batch that keep a pair.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1); its
    mass above t is the chance of at most m successes in n+1 draws at t. One kept byte
    agrees by chance in 1 of 256 cases, which raises t.
    """
    t = percent / 100
    t += (1 - t) / 256
    limits = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        mass = 0.0
        for m in range(n + 1):
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                limits[n] = m
                break
    return limits


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose posterior reaches the threshold after every batch of hashes."""
    limits = least_matches(percent, miss)
    left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES)
                for c in (batch.column(2), batch.column(3))
            )
            alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
            for end, least in limits.items():
                part = slice(end - BATCH, end)
                matches = matches + (one[alive, part] == two[alive, part]).sum(axis=1)
                keep = matches >= least
                alive, matches = alive[keep], matches[keep]
            yield batch.select([0, 1]).take(pa.array(alive, pa.int64()))

    joined = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "sketch_a", "sketch_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (one, two))
                least, most = sorted((len(one), len(two)))
                if 100 * least < percent * most:
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (least + most - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "set_a", "set_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _full_sets(docs: DataFrame, sets: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(rep, members): whole shingle sets of the needed representatives.

    The text is read from a document that has the set's smallest id; where that id repeats with other
    texts, their sets are made too and fall out by their key.
    """
    wanted = stage(sets.join(needed.hint("merge"), "rep", "left_semi").select("rep", "set_key", "least"), "needed_sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["set_key", "members"])

    texts = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["least"]), "left_semi")
    made = texts.mapInArrow(run, "set_key binary, members binary")
    return made.join(wanted.select("rep", "set_key").hint("merge"), "set_key").select("rep", "members").dropDuplicates(["rep"])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def _distinct_sets(features: DataFrame) -> DataFrame:
    """(set_key, rep, least, salt_bits, bands, sketch): each different set once, numbered; ``least`` is the smallest
    id that has it."""
    sets = _salted(features.filter("n > 0")).groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salt_bits"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )
    return sets.withColumn("rep", F.monotonically_increasing_id())


def _bucket_members(reps: DataFrame) -> DataFrame:
    """(key, rep, n) of buckets with n = two or more representatives."""
    entries = reps.select("rep", F.posexplode("bands").alias("band", "hash")).select(
        "rep", F.xxhash64("band", "hash").alias("key")
    )
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return entries.join(shared.hint("merge"), "key")


def _central(members: DataFrame) -> DataFrame:
    """Members (key, rep, centre): how many representatives are met in all buckets of one.

    The text that others were copied from shares bands with all of them; a copy shares
    fewer, because its own changes break some of its bands.
    """
    sums = members.groupBy("rep").agg(F.sum("n").alias("centre"))
    return members.select("key", "rep").join(sums.hint("merge"), "rep")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component so far (``comp``)."""
    if labels is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(labels, members["rep"] == labels["node"], "left").select(
        "key", "rep", "centre", F.coalesce("component", "rep").alias("comp")
    )


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets that hold more than one component: key, and the component with most members."""
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    return (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "comp")).alias("most"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low != high")
        .select("key", F.col("most.comp").alias("lead"), F.col("most.n").alias("n_lead"))
    )


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """One pair for each representative: of the most central members of its buckets, the one
    that shares most buckets with it."""
    order = F.struct("centre", "rep")
    pivots = members.groupBy("key").agg(F.max(order).alias("p")).select("key", F.col("p.rep").alias("pivot"))
    offers = (
        members.join(pivots.hint("merge"), "key")
        .filter("rep != pivot")
        .groupBy("rep", "pivot")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = offers.groupBy("rep").agg(F.max(F.struct("n", "pivot")).alias("best"))
    return best.select(F.col("rep").alias("a"), F.col("best.pivot").alias("b"))


def _central_pairs(members: DataFrame) -> DataFrame:
    """At most ``MEETINGS`` pairs for each representative and leading component it is outside of.

    They meet in the bucket that holds most of that component: its most central members are
    nearest to the text that all were copied from, so a copy that misses one of them at the
    threshold reaches another.
    """
    mixed = members.join(_mixed(members).hint("merge"), "key")
    outside = (
        mixed.filter("comp != lead")
        .groupBy("rep", "lead")
        .agg(F.max(F.struct("n_lead", "key")).alias("place"))
        .select(F.col("rep").alias("a"), F.col("place.key").alias("key"))
    )
    best_first = Window.partitionBy("key").orderBy(F.col("centre").desc(), "rep")
    central = (
        mixed.filter("comp = lead")
        .withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") <= MEETINGS)
        .select("key", F.col("rep").alias("b"))
    )
    return outside.join(central.hint("merge"), "key").select("a", "b").distinct()


def _postings(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(hash, rep, df): shingles of the representatives in ``members``, in how many they are."""
    kind = sets.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, members in zip(batch.column(0), batch.column(1)):
                hashes = np.frombuffer(members.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rep.as_py()] * len(hashes), batch.schema.field(0).type), pa.array(hashes)], ["rep", "hash"]
                )

    needed = members.select("rep").distinct()
    rows = sets.join(needed.hint("merge"), "rep", "left_semi").mapInArrow(run, f"rep {kind}, hash long")
    return stage(rows, "postings")


def _reaches(percent: int, most: Column) -> Column:
    """Whether sets of ``size_a`` and ``size_b`` reach the threshold with ``most`` in common."""
    return 100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)


def _side(df: DataFrame, name: str, *others) -> DataFrame:
    return df.select(
        *others, F.col("rep").alias(name),
        *(F.col(c).alias(f"{c}_{name}") for c in ("comp", "size", "common")),
    )


def _by_shingle(rare: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share rare shingles, if those and all common ones
    would be enough."""
    known = rare.filter("df > 1").join(comps.hint("merge"), "rep")
    one, two = _side(known, "a", "hash"), _side(known, "b", "hash")
    other = (one["hash"] == two["hash"]) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
    shared = one.hint("merge").join(two, other).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.max(c).alias(c) for c in ("size_a", "size_b", "common_a", "common_b")),
    )
    return shared.filter(_reaches(percent, F.least("common_a", "common_b") + F.col("n"))).select("a", "b")


def _by_bucket(mixed: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket whose common shingles alone would be enough."""
    able = comps.filter(100 * F.col("common") >= percent * F.col("size"))
    # A representative's buckets, at most one for each band: a pair is made in its first one only.
    keys = mixed.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    able = mixed.select("key", "rep", "lead").join(able.join(keys.hint("merge"), "rep").hint("merge"), "rep")
    able = stage(able, "able")
    outside = _side(able.filter("comp != lead"), "a", "key", F.col("keys").alias("keys_a"))
    inside = _side(able, "b", "key", "lead", F.col("keys").alias("keys_b"))
    possible = (
        (outside["key"] == inside["key"]) & (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("lead")) | (F.col("a") < F.col("b")))
        & _reaches(percent, F.least("common_a", "common_b"))
        & (outside["key"] == F.array_min(F.array_intersect("keys_a", "keys_b")))
    )
    return outside.hint("merge").join(inside, possible).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs between different components that can reach the threshold."""
    mixed = stage(members.join(_mixed(members).hint("merge"), "key").select("key", "rep", "comp", "lead"), "mixed")
    postings = _postings(sets, mixed)
    rare = postings.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= RARE)
    rare = stage(postings.join(rare.hint("merge"), "hash"), "rare_shingles")
    comps = (
        postings.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
        .join(rare.groupBy("rep").agg(F.count(F.lit(1)).alias("rare")).hint("merge"), "rep", "left")
        .join(mixed.select("rep", "comp").distinct().hint("merge"), "rep")
        .select("rep", "comp", "size", (F.col("size") - F.coalesce("rare", F.lit(0))).alias("common"))
    )
    comps = stage(comps, "components_of_mixed")
    return _by_shingle(rare, comps, percent).unionByName(_by_bucket(mixed, comps, percent)).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = PERCENT,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Words are separated by white space (space, 09 to 0D), A-Z are lower-cased; the set of a
    document is its distinct shingles of ``words`` words, the whole sequence where it has
    fewer words. Documents with ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest id reached, ``kept`` marks the document that has it.
    Texts that are null, empty or white space have no shingles and are linked with
    nothing. Rows that repeat an id are one document for the links, whatever their texts. Null ids: such a row
    gets its component's id, null where no member has one, and is not kept.
    Other columns are ignored; an empty table gives no rows.
    """
    source = document_columns(docs, id_col, text_col)
    features = stage(_features(source, words), "shingles")
    sets_seen = stage(_distinct_sets(features), "distinct_sets")
    members = stage(_central(stage(_bucket_members(sets_seen), "buckets")), "members")
    needed = members.select("rep").distinct()
    sets = stage(_full_sets(source, sets_seen, needed, words), "full_sets")
    sketches = stage(sets_seen.select("rep", "sketch").join(needed.hint("merge"), "rep", "left_semi"), "sketches")

    tied = same_id_links(features, sets_seen.withColumnRenamed("rep", "node"))
    links = [] if tied is None else [stage(tied, "same_id")]
    labels = stage(components(links[0]), "components") if links else None
    for step in (_pivot_pairs, _central_pairs, lambda members: _open_pairs(members, sets, percent)):
        labelled = _labelled(members, labels)
        if labels is not None:
            labelled = stage(labelled, "labelled")
        pairs = step(labelled)
        pairs = _plausible(pairs, sketches, percent, miss)
        links.append(stage(_confirmed(pairs, sets, percent), "confirmed"))
        labels = stage(components(reduce(DataFrame.unionByName, links)), "components")

    named = sets_seen.select("set_key", "rep", "least", "salt_bits").join(labels, F.col("rep") == F.col("node"), "left")
    named = stage(named.select("set_key", "least", "salt_bits", F.coalesce("component", "rep").alias("comp")), "named_sets")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = named.join(smallest.hint("merge"), "comp").select(
        F.col("set_key").alias("found_key"), "component_id",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(SALTS - 1)),
                lambda s: F.col("salt_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0,
            )
        ).alias("found_salt"),
    )
    rows = _salted(features.select("doc_id", "n", "set_key")).join(
        found.hint("merge"), (F.col("set_key") == F.col("found_key")) & (F.col("salt") == F.col("found_salt")), "left"
    )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a smaller id of their component stands for.

    All columns are kept. Rows with a null id stay, since nothing names them.
    """
    found = near_duplicates(docs, words, id_col=id_col, text_col=text_col)
    name = fresh_name(docs, "gone")
    gone = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col(name), "left_anti")
