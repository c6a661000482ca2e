"""From bibliographic records to an attributed temporal graph.

One scan of the records feeds all outputs: records are filtered once, the first
valid record of an id stands for it, references are exploded once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.functions import text as tx
from vireo.operators.graph import dense_index
from vireo.runtime import cut


@dataclass(frozen=True)
class ConvertConfig:
    """None means: the profile's value."""

    profile: str = "custom"
    max_papers: int | None = None
    feature_dim: int | None = None
    min_venue_support: int | None = None
    max_record_bytes: int | None = None
    candidate_multiplier: int | None = None
    strategy: str = "dense"
    keep_unlabeled: bool = False
    min_year: int = 0
    max_year: int = 0

    def resolved(self) -> ConvertConfig:
        values = dict(zip(("max_papers", "feature_dim", "min_venue_support", "max_record_bytes", "candidate_multiplier"), PROFILES[self.profile], strict=True))
        return replace(self, **{k: v for k, v in values.items() if getattr(self, k) is None})


# max_papers, feature_dim, min_venue_support, max_record_bytes, candidate_multiplier.
PROFILES = {
    "test": (50_000, 128, 50, 2_000_000, 3),
    "small": (200_000, 128, 100, 2_000_000, 3),
    "medium": (1_000_000, 128, 200, 2_000_000, 2),
    "full": (0, 128, 500, 2_000_000, 2),
    "custom": (0, 128, 50, 4_000_000, 2),
}


def valid_records(records: DataFrame, config: ConvertConfig) -> DataFrame:
    """(seq, id, title, abstract, keywords, year, references, venue) with an id and an accepted year."""
    out = records.withColumns({"id": tx.identifier(F.col("id")), "year": tx.year(F.col("year")), "venue": tx.venue(F.col("venue"))})
    out = out.where(F.col("id").isNotNull() & F.col("year").isNotNull())
    if config.min_year:
        out = out.where(F.col("year") >= config.min_year)
    if config.max_year:
        out = out.where(F.col("year") <= config.max_year)
    return out


def counter_columns(config: ConvertConfig) -> list:
    """Aggregates over raw records: records_total, missing_id, invalid_year, out_of_range, accepted."""
    known, y = tx.identifier(F.col("id")).isNotNull(), tx.year(F.col("year"))
    inside = F.lit(True)
    if config.min_year:
        inside = inside & (y >= config.min_year)
    if config.max_year:
        inside = inside & (y <= config.max_year)
    return [
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(~known).alias("missing_id"),
        F.count_if(known & y.isNull()).alias("invalid_year"),
        F.count_if(known & y.isNotNull() & ~inside).alias("out_of_range"),
        F.count_if(known & y.isNotNull() & inside).alias("accepted"),
    ]


def record_counters(records: DataFrame, config: ConvertConfig) -> DataFrame:
    """``counter_columns`` as one row."""
    return records.agg(*counter_columns(config))


def prefix(records: DataFrame, n_ids: int, seq: str = "seq") -> DataFrame:
    """Records up to the one that brings the ``n_ids``-th distinct id; 0 keeps all."""
    if not n_ids:
        return records
    first = records.groupBy("id").agg(F.min(seq).alias(seq))
    last = first.orderBy(seq).limit(n_ids).agg(F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_last"))
    kept = records.join(F.broadcast(last), F.lit(True)).where((F.col("_n") < n_ids) | (F.col(seq) <= F.col("_last")))
    return kept.select(*records.columns)


def first_per_id(records: DataFrame, seq: str = "seq") -> DataFrame:
    rest = [c for c in records.columns if c != "id"]
    won = records.groupBy("id").agg(F.min_by(F.struct(*rest), seq).alias("_r"))
    return won.select("id", "_r.*")


def venue_support(records: DataFrame, least: int) -> DataFrame:
    """(venue, label): venues of at least ``least`` records, repeats included, numbered in order of name."""
    kept = records.where(F.col("venue") != "").groupBy("venue").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return dense_index(kept.select("venue"), "venue", "label")


def reference_rows(records: DataFrame) -> DataFrame:
    """(id, ref), one row per listed reference with an id, repeats included."""
    exploded = records.select("id", F.explode(F.coalesce("references", F.array().cast("array<string>"))).alias("ref"))
    return exploded.select("id", tx.identifier(F.col("ref")).alias("ref")).where(F.col("ref").isNotNull())


def in_counts(records: DataFrame) -> DataFrame:
    """(id, in_count): references to each id by other ids, repeats included."""
    refs = reference_rows(records).where("id <> ref")
    return refs.groupBy(F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("in_count"))


def paper_scores(papers: DataFrame, incoming: DataFrame, labels: DataFrame) -> DataFrame:
    """``papers`` with (label, in_count, out_count, score); score is in + out / 2, and 5 more if labelled."""
    met = papers.join(incoming, "id", "left").join(labels, "venue", "left")
    met = met.withColumn("in_count", F.coalesce("in_count", F.lit(0))).withColumn("out_count", F.coalesce(F.size("references"), F.lit(0)))
    met = met.withColumn("out_count", F.greatest("out_count", F.lit(0)))
    return met.withColumn("score", F.col("in_count") + 0.5 * F.col("out_count") + F.when(F.col("label").isNotNull(), 5.0).otherwise(0.0))


def internal_links(papers: DataFrame) -> DataFrame:
    """(id, ref) distinct, both among ``papers``, no self-reference."""
    refs = reference_rows(papers).where("id <> ref").distinct()
    return refs.join(papers.select(F.col("id").alias("ref")), "ref", "left_semi").select("id", "ref")


def dense_rescore(pool: DataFrame) -> DataFrame:
    """The pool with 2 more per reference to and from the pool."""
    links = internal_links(pool)
    outs = links.groupBy("id").agg(F.count(F.lit(1)).alias("_out"))
    ins = links.groupBy(F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("_in"))
    met = pool.join(outs, "id", "left").join(ins, "id", "left")
    extra = 2.0 * F.coalesce("_out", F.lit(0)) + 2.0 * F.coalesce("_in", F.lit(0))
    return met.withColumn("score", F.col("score") + extra).drop("_out", "_in")


def best(papers: DataFrame, n: int) -> DataFrame:
    """The ``n`` best by score, then later year, then id; 0 keeps all."""
    return papers if not n else papers.orderBy(F.desc("score"), F.desc("year"), F.asc("id")).limit(n)


def id_limit(config: ConvertConfig) -> int:
    """How many distinct ids are scanned for; 0 is all."""
    config = config.resolved()
    return config.max_papers * config.candidate_multiplier if config.strategy == "dense" else config.max_papers


def enough_ids(config: ConvertConfig):
    """Whether records bring as many distinct valid ids as are scanned for; never if all are."""
    limit = id_limit(config)
    return lambda records: bool(limit) and valid_records(records, config).select("id").distinct().limit(limit).count() >= limit


def select_papers(records: DataFrame, config: ConvertConfig, counters: dict | None = None) -> DataFrame:
    """The papers kept, with label (-1 if none) and score.

    ``records`` is read once. ``counters`` gets the counts of the scanned prefix, and duplicate_ids, its
    accepted records whose id an earlier one has.
    """
    config = config.resolved()
    limit = id_limit(config)
    raw = cut(records)
    scanned = cut(prefix(valid_records(raw, config), limit))
    if counters is not None:
        rows, ids = scanned.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        read = raw if ids < limit or not limit else raw.join(F.broadcast(scanned.agg(F.max("seq").alias("_last"))), F.col("seq") <= F.col("_last"))  # one row
        counters |= record_counters(read, config).first().asDict() | {"duplicate_ids": rows - ids}
    papers = paper_scores(first_per_id(scanned), in_counts(scanned), venue_support(scanned, config.min_venue_support))
    if not config.keep_unlabeled:
        papers = papers.where(F.col("label").isNotNull())
    papers = cut(papers.withColumn("label", F.coalesce("label", F.lit(-1))))
    if config.strategy == "dense":
        papers = cut(dense_rescore(best(papers, limit)))
    return best(papers, config.max_papers)


def resolved_references(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, time), one-row count of references to papers that aren't kept)."""
    refs = reference_rows(kept.select("id", "references")).where("id <> ref").distinct()
    met = refs.join(kept.select("id", "year"), "id").join(kept.select(F.col("id").alias("ref"), F.lit(1).alias("_known")), "ref", "left")
    edges = met.where("_known is not null").select(F.col("id").alias("src"), F.col("ref").alias("dst"), F.col("year").alias("time"))
    return edges, met.where("_known is null").agg(F.count(F.lit(1)).alias("unresolved_references"))


def hashed_counts(rows: DataFrame, key: str, words, dim: int) -> DataFrame:
    """(key, bucket, n): tokens of ``words`` counted by hash bucket, most of it before the shuffle; buckets of none are left out."""
    places = rows.select(key, F.explode(tx.tokens(words)).alias("token")).select(key, tx.bucket(F.col("token"), dim).alias("bucket"))
    return places.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))


def text_features(kept: DataFrame, dim: int) -> DataFrame:
    """(node_id, features): hashed counts over title, abstract and keywords."""
    words = F.concat_ws(" ", "title", "abstract", tx.keywords(F.col("keywords")))
    counts = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double"))))
    held = hashed_counts(kept, "id", words, dim).groupBy("id").agg(counts.alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return kept.select("id").join(held, "id", "left").select(F.col("id").alias("node_id"), dense.alias("features"))


@dataclass
class Converted:
    edges: DataFrame
    features: DataFrame
    labels: DataFrame
    counters: dict


def convert(records: DataFrame, config: ConvertConfig) -> Converted:
    """``records``: (seq, id, title, abstract, keywords array, year, references array, venue)."""
    config = config.resolved()
    counters: dict = {}
    kept = cut(select_papers(records, config, counters))
    edges, unresolved = resolved_references(kept)
    counters |= {"kept_papers": kept.count(), "supported_venues": kept.where("label >= 0").select("label").distinct().count()}
    counters |= {"unresolved_references": unresolved.first()[0]}
    return Converted(edges, text_features(kept, config.feature_dim), kept.select(F.col("id").alias("node_id"), "label"), counters)


def top_columns(pairs: DataFrame, n: int, column: str = "col") -> DataFrame:
    """(col, place): the ``n`` most frequent columns, ties by name, numbered from 0."""
    top = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)
    return top.select(column, (F.row_number().over(W.orderBy(F.desc("n"), F.asc(column))) - 1).alias("place"))


def dense_from_sparse(cells: DataFrame, places: DataFrame, n: int, key: str = "node_id", column: str = "col", value: str = "value") -> DataFrame:
    """(key, vec): chosen columns of sparse rows in fixed places, 0 elsewhere."""
    met = cells.join(F.broadcast(places), column)
    held = met.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", value))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("vec"))
