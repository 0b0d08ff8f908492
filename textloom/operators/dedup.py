"""Exact and near deduplication, and exact similarity joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.vectorized import minhash_column, wide_minhash_column
from textloom.operators.banding import followers, pairs_in_buckets
from textloom.operators.blocks import close_in_groups, close_pairs, measured, sketched
from textloom.session import materialize


MOST_DOUBLINGS = 20


@dataclass(frozen=True)
class NearDupConfig:
    threshold: float = 0.6
    k: int = 5
    num_perm: int = 64
    bands: int = 16
    front: int = 256       # buckets above this size are compared front by front
    salt_rows: int = 4096  # rows of a hot bucket that one task should compare


# ---- exact -----------------------------------------------------------------

def first_by_content(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Smallest key per content hash (partial aggregation absorbs hot contents)."""
    return docs.groupBy(T.content_hash(F.col(text)).alias("content_hash")).agg(
        F.min(key).alias(key), F.count("*").alias("copies")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First occurrence of every content, everything else dropped."""
    return docs.join(first_by_content(docs, key, text).select(key), key, "left_semi")


# ---- signatures and buckets ------------------------------------------------

def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    build = minhash_column(cfg.k, cfg.num_perm)
    return docs.select(F.col(key), build(T.collapse_space(F.col(text))).alias("sig"))


def signature_similarity(a: Column, b: Column, num_perm: int = 64) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, v: n + v)
    return same / F.lit(num_perm)


def band_slices(sig: Column, cfg: NearDupConfig) -> Column:
    rows = cfg.num_perm // cfg.bands
    return F.array(*[F.slice(sig, b * rows + 1, rows) for b in range(cfg.bands)])


def shares_band(a: Column, b: Column, cfg: NearDupConfig) -> Column:
    same = F.zip_with(band_slices(a, cfg), band_slices(b, cfg), lambda x, y: x == y)
    return F.array_contains(same, True)


def band_members(sigs: DataFrame, key: str, cfg: NearDupConfig, *further: str) -> DataFrame:
    """One row per document and band; the bucket is a 64-bit hash of band and rows.

    A hash collision can only add a candidate; ``shares_band`` removes it again.
    """
    exploded = sigs.select(key, *further, F.posexplode(band_slices(F.col("sig"), cfg)).alias("band", "rows"))
    return exploded.select(key, *further, "band", F.xxhash64("band", "rows").alias("bucket"))


def bucket_sizes(members: DataFrame) -> DataFrame:
    """Buckets with at least two members."""
    return members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")


def _attach(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    i = table.select(F.col(key).alias("i"), F.col(value).alias(f"{value}_i"))
    j = table.select(F.col(key).alias("j"), F.col(value).alias(f"{value}_j"))
    return pairs.join(i, "i").join(j, "j")


def _in_buckets(sigs: DataFrame, key: str, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """(bucket, size, band, key, sig) of every member of a bucket of two or more, and the (bucket, size) of those."""
    members = band_members(sigs, key, cfg, "sig")
    sized = materialize(bucket_sizes(members), "sizes")
    return members.join(sized, "bucket"), sized


def candidate_pairs(sigs: DataFrame, key: str = "doc_id", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """All pairs that share a band, with their signature similarity.

    Members of a bucket are compared inside tasks, and a pair becomes a row in
    the bucket of the first band it shares alone.  Listing pairs is quadratic
    in the size of a bucket by definition: feed it one row per distinct
    signature (see ``representatives``), or use ``near_dedup``.
    """
    return pairs_in_buckets(*_in_buckets(sigs, key, cfg), key, cfg.bands, once=True)


def representatives(sigs: DataFrame, key: str = "doc_id") -> DataFrame:
    """First document per distinct signature and how many documents carry it.

    Equal signatures share every bucket with similarity 1, so all but the first
    are dropped whatever happens to the first: collapsing them is exact.
    """
    return sigs.groupBy("sig").agg(F.min(key).alias(key), F.count("*").alias("copies"))


# ---- greedy near dedup -----------------------------------------------------

def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Keep a document unless an earlier *kept* one shares a bucket and is similar."""
    return docs.join(near_dedup_keys(docs, key, text, cfg), key, "left_semi")


def near_dedup_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Keys the sequential greedy scan keeps, found in distributed rounds.

    Buckets of up to ``cfg.front`` members contribute their similar pairs once.
    Of a larger one each round takes the first undecided members, settles them,
    compares the survivors with the rest of the bucket, and drops what is
    similar.  It takes ``front`` of them in the first round, where groups of
    near copies fall, and twice as many each time, so that rounds grow with the
    logarithm of a bucket.  Members are compared inside tasks.
    """
    sigs = materialize(representatives(signatures(docs, key, text, cfg), key), "signatures", heavy=True)
    members, sized = _in_buckets(sigs, key, cfg)
    small = F.col("size") <= cfg.front
    found = pairs_in_buckets(members.where(small), sized.where(small), key, cfg.bands, cfg.threshold)
    edges = materialize(found.select("i", "j").distinct(), "edges")
    hot = materialize(members.where(~small & F.col(key).isNotNull()).select("bucket", "size", "band", key, "sig"), "hot")
    dropped: list[DataFrame] = []
    has_hot = not hot.isEmpty()
    turn = 0
    while has_hot or not edges.isEmpty():
        if has_hot:
            edges, hot, gone = _front_round(edges, hot, key, cfg, cfg.front << min(turn, MOST_DOUBLINGS))
            has_hot = not hot.isEmpty()
            turn += 1
        else:
            edges, gone = _edge_round(edges, key)
        dropped.append(gone)
    if not dropped:
        return sigs.select(key)
    return sigs.select(key).join(reduce(DataFrame.unionByName, dropped), key, "left_anti")


def _edge_round(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents without an undecided earlier neighbour are kept; theirs fall."""
    later = edges.select(F.col("j").alias("i")).distinct()
    heads = edges.select("i").distinct().join(later, "i", "left_anti")
    gone = materialize(edges.join(heads, "i", "left_semi").select(F.col("j").alias(key)).distinct(), "dropped")
    return _unresolved(edges, gone, key), gone


def _unresolved(edges: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    rest = edges.join(gone.withColumnRenamed(key, "j"), "j", "left_anti")
    rest = rest.join(gone.withColumnRenamed(key, "i"), "i", "left_anti")
    return materialize(rest.select("i", "j"), "edges")


def _front_round(edges, hot, key, cfg, size):
    """Settle what the first ``size`` undecided members of each hot bucket decide."""
    order = Window.partitionBy("bucket").orderBy(key)
    front = materialize(
        hot.select("bucket", "size", "band", key, "sig", F.row_number().over(order).alias("rank")).where(F.col("rank") <= size),
        "front",
    )
    waiting = hot.join(front.select("bucket", key), ["bucket", key], "left_anti")
    blocked = waiting.select(key).distinct()
    taken = front.groupBy("bucket").agg(F.count("*").alias("size"))
    found = pairs_in_buckets(front.drop("size").join(taken, "bucket"), taken, key, cfg.bands, cfg.threshold).select("i", "j")
    edges = materialize(edges.unionByName(found).distinct(), "edges")
    nodes = front.select(key).unionByName(edges.select(F.col("i").alias(key))).distinct()
    heads = materialize(
        nodes.join(edges.select(F.col("j").alias(key)).distinct(), key, "left_anti").join(blocked, key, "left_anti"),
        "heads",
    )
    by_edge = edges.join(heads.withColumnRenamed(key, "i"), "i", "left_semi").select(F.col("j").alias(key))
    # Settled leaders meet the rest of their bucket, spread over salts.
    leaders = front.join(heads, key, "left_semi")
    salts = F.ceil(F.col("size") / cfg.salt_rows).cast("int")
    by_leader = followers(leaders, waiting, salts, F.least(F.col("size"), F.lit(size)), key, cfg.bands, cfg.threshold)
    gone = materialize(by_edge.unionByName(by_leader).distinct(), "dropped")
    settled = gone.unionByName(heads)
    hot = materialize(hot.join(settled, key, "left_anti"), "hot")
    rest_edges = _unresolved(edges, gone, key)
    rest_edges = materialize(rest_edges.join(heads.withColumnRenamed(key, "i"), "i", "left_anti").select("i", "j"), "edges")
    return rest_edges, hot, gone


# ---- exact similarity joins ------------------------------------------------

def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """One row per distinct shingle set: first document, copies, and its text with spaces collapsed.

    Sets are grouped by a digest; the texts of the documents that keep one
    travel, not the sets.
    """
    classes = set_classes(set_members(docs, key, text, k), key)
    first = materialize(classes.select(F.col("class_id").alias(key), "copies"), "firsts")
    return docs.select(key, text).join(first, key).select(key, "copies", F.regexp_replace(text, T.SPACE_RUN, " ").alias("text"))


def set_members(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(key, digest): every document with the digest of its shingle set."""
    return docs.select(F.col(key), F.sha2(F.array_join(F.sort_array(T.untrimmed_shingles(F.col(text), k)), "\n"), 256).alias("digest"))


def set_classes(members: DataFrame, key: str = "doc_id") -> DataFrame:
    """(digest, class_id, copies): the documents of each distinct set, named by the first, as in ``shingle_sets``."""
    return members.groupBy("digest").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))


def jaccard_pairs(sets: DataFrame, key: str = "doc_id", threshold: float = 0.5, k: int = 5) -> DataFrame:
    """Every pair of shingle sets with Jaccard > threshold.

    All sets of matching size meet, block against block, as sketches in tasks;
    a pair becomes a row only if its sketches allow it.  A pair is listed once,
    also where a key stands on several rows.
    """
    return measured(materialize(close_pairs(sketched(sets, key, k), threshold, key), "close"), sets, threshold, key, k)


def verify_jaccard(candidates: DataFrame, sets: DataFrame, key: str, threshold: float, k: int = 5) -> DataFrame:
    """(i, j, jaccard): exact Jaccard of the candidate pairs above the threshold, from the texts.

    A key on m rows of ``sets`` counts m to the fourth times in its pairs.
    """
    found = measured(candidates, sets, threshold, key, k)
    repeated = materialize(sets.groupBy(key).agg(F.count("*").alias("m")).where("m > 1"), "repeated")
    if repeated.isEmpty():
        return found
    for side in ("i", "j"):
        times = F.coalesce("m", F.lit(1))
        found = found.join(repeated.withColumnRenamed(key, side), side, "left").withColumn(
            "m", F.explode(F.sequence(F.lit(1).cast("bigint"), times * times * times * times)))
        found = found.select("i", "j", "jaccard")
    return found


def wide_signatures(docs: DataFrame, sets: DataFrame, key: str = "doc_id", text: str = "text",
                    cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Signatures of the first document of each set: untrimmed shingles and the wide hash family."""
    build = wide_minhash_column(cfg.k, cfg.num_perm)
    reduced = F.regexp_replace(F.col(text), T.SPACE_RUN, " ")
    sigs = docs.join(sets.select(key), key, "left_semi").select(key, build(reduced).alias("sig"))
    return materialize(sigs, "signatures", heavy=True)


def wide_candidates(docs: DataFrame, sets: DataFrame, key: str = "doc_id", text: str = "text",
                    cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """LSH candidates over the untrimmed shingle rule and the wide hash family.

    Documents of equal signature are all candidates of each other, so only one
    of them goes through the buckets; the listing is quadratic by definition.
    """
    sigs = wide_signatures(docs, sets, key, text, cfg)
    members = sigs.select(F.sha2(F.array_join("sig", ","), 256).alias("digest"), key)
    firsts = materialize(representatives(sigs, key), "firsts")
    groups = firsts.select(F.sha2(F.array_join("sig", ","), 256).alias("digest"), F.col(key).alias("first"))
    members = materialize(members.join(groups, "digest").select(key, "first"), "members")
    pairs = candidate_pairs(firsts, key, cfg).select("i", "j").unionByName(firsts.select(F.col(key).alias("i"), F.col(key).alias("j")))
    left = members.select(F.col("first").alias("i"), F.col(key).alias("x"))
    right = members.select(F.col("first").alias("j"), F.col(key).alias("y"))
    # within one group each pair comes once, between two groups every pair does
    both = pairs.join(left, "i").join(right, "j").where("i <> j OR x < y")
    return both.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))


def lsh_jaccard_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5,
                      cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Pairs found by banding and confirmed by exact Jaccard.

    Buckets up to ``cfg.front`` members are compared by sketches inside tasks.
    Members of a larger bucket meet all other such members block by block
    instead, which leaves out no pair above the threshold; those pairs count if
    they share a band.
    """
    sets = materialize(shingle_sets(docs, key, text, cfg.k), "shingles", heavy=True)
    sigs = wide_signatures(docs, sets, key, text, cfg)
    members = band_members(sigs, key, cfg)
    sized = materialize(members.join(bucket_sizes(members), "bucket"), "buckets")
    sketches = sketched(sets, key, cfg.k)
    listed = close_in_groups(sized.where(F.col("size") <= cfg.front), sketches, threshold, "bucket", key)
    crowded = materialize(sized.where(F.col("size") > cfg.front).select(key).distinct(), "crowded")
    if not crowded.isEmpty():
        listed = listed.unionByName(close_pairs(sketches.join(crowded, key, "left_semi"), threshold, key)).distinct()
    listed = materialize(listed, "close")
    banded = _attach(listed, sigs, key, "sig").where(shares_band(F.col("sig_i"), F.col("sig_j"), cfg)).select("i", "j")
    return verify_jaccard(materialize(banded, "banded"), sets, key, threshold, cfg.k)


def dedup_accuracy(sets: DataFrame, candidates: DataFrame, exact: DataFrame, found: DataFrame,
                   known: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Candidate share and recall of the banded join against the exact one, over all documents.

    Pairs are listed between the first documents of distinct sets; a pair of
    sets with c and d copies stands for c * d document pairs, and the copies of
    one set are candidates, exact and found among themselves.
    """
    copies = materialize(sets.select(key, F.col("copies").cast("bigint").alias("c")), "copies")
    total = copies.agg(F.sum("c")).scalar()
    inside = copies.agg(F.sum(F.expr("c * (c - 1) div 2"))).scalar()

    def documents(pairs: DataFrame) -> Column:
        weighed = _attach(pairs.select("i", "j"), copies, key, "c")
        return F.coalesce(weighed.agg(F.sum(F.col("c_i") * F.col("c_j"))).scalar(), F.lit(0)) + inside

    hit = exact.select("i", "j").intersect(found.select("i", "j"))
    columns = [
        F.floor(total * (total - 1) / 2).cast("bigint").alias("all_pairs"), documents(candidates).alias("candidates"),
        documents(exact).alias("exact_pairs"), documents(found).alias("lsh_pairs"), documents(hit).alias("shared_pairs"),
    ]
    if known is not None:
        columns.append(known.select("i", "j").intersect(found.select("i", "j")).agg(F.count("*")).scalar().alias("known_found"))
        columns.append(known.agg(F.count("*")).scalar().alias("known_pairs"))
    base = candidates.sparkSession.range(1).select(*columns)
    return base.withColumn(
        "candidate_share", F.when(F.col("all_pairs") > 0, F.col("candidates") / F.col("all_pairs")).otherwise(0.0)
    ).withColumn("recall", F.when(F.col("exact_pairs") > 0, F.col("shared_pairs") / F.col("exact_pairs")).otherwise(1.0))
