"""Near-duplicate classes by order MinHash.

A text's k-mers are its five-word shingles, each labelled with its occurrence
number. For each of BANDS hash functions the MINIMA least labelled k-mers are
kept in text order; their joint hash is a bucket key. Texts that share a bucket
are compared by a banded alignment of their shingle sequences: with ``m``
labelled shingles in the longest common subsequence of sequences of ``n1`` and
``n2``, the similarity is m / (n1 + n2 - m), the Jaccard similarity of the
labelled shingles as far as they stand in the same order. Pairs at
SIMILARITY or more are links; classes are the components of the links.

Of long texts, a pair at similarity 0.8 shares a bucket with probability
0.8^6 = 0.26, and one of 24 with 0.9993; at 0.9 the loss is below 1e-8.
Minima are drawn without repeats, which lowers these odds for few shingles.
So where one text of a pair has SHORT shingles or fewer, buckets are exact: by
the prefix principle two sets at SIMILARITY or more share one of the first
n - ceil(SIMILARITY n) + 1 labelled shingles of each in a common order.

Scale: equal texts are one node, so copies are never compared. Buckets are not
expanded to pairs: members meet their bucket's leader, and then those that
differ from it in a common way, see ``stars`` and ``filed``. All pairs under a
common leader are decided so, whether they share a bucket or not. Nothing is
capped. Texts are fetched only for members of shared buckets, compressed, and
cut to the checkpoint folder.

Defined results: null text reads as empty; equal texts (also empty ones) share
a class; texts without words link to nothing else; texts of 1 to 4 words have
one shingle, all of it; a very long text is one node with as many buckets as
any other; the class id is the least id in the class, null only if all ids in
it are null; columns of the table other than id and text are not looked at by
``with_class`` and kept by ``keep_one``, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vireo.llm.common import cut, free_name, map_arrow, may_be_in
from vireo.llm.lines import document_key
from vireo.llm.stars import CORE, OPEN, OPEN_TO_CORE, SEEN, beside_leaders, bucket_roots
from vireo.llm.words import lowered, mix, run_shingles, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
MINIMA = 6
#: Texts of so many labelled shingles are filed under shingles, so that no pair with one of them is missed.
SHORT = 64
#: Compressed texts that are spelt out at a time.
LOT_BYTES = 4 << 20
#: Elements that are told apart as usual in a star; of an order any will do, so this loses nothing.
USUAL = 512
#: Keys of all core texts of a star, and of those between which the leader stands.
HOME = 0x6C62272E07BB0142, 0x62B821756295C58D


def labelled(x: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence number in the text."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return x
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    nth = np.arange(len(x)) - np.repeat(start, np.diff(np.concatenate((start, [len(x)]))))
    out = x.copy()
    with np.errstate(over="ignore"):
        out[order] = np.where(nth > 0, mix(ranked + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ranked)
    return out


def _multipliers(bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def sketch(x: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """One bucket key per band from the labelled shingles of a text, in text order."""
    n, factors = len(x), _multipliers(bands)
    keys = np.empty(bands, dtype=np.uint64)
    limit = np.uint64(min(2**64 - 1, (2**64 // n) * (minima + 13))) if n > 64 else None
    with np.errstate(over="ignore"):
        for j in range(bands):
            h = x * factors[j]
            at = np.flatnonzero(h < limit) if limit is not None else np.arange(n)
            if len(at) < minima and len(at) < n:
                at = np.arange(n)
            own = h[at]
            pick = at[np.argsort(own, kind="stable")[:minima]] if len(at) > minima else at
            acc = factors[j]
            for v in x[np.sort(pick)].tolist():
                acc = (int(acc) * 0x9FB21C651E98DF25 + v) & 0xFFFFFFFFFFFFFFFF
            keys[j] = acc
    return mix(keys)


def bucket_keys(x: np.ndarray, similarity: float = SIMILARITY, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """The buckets of a text with labelled shingles ``x``; linked texts share one, for sure if one of them is SHORT."""
    n, out = len(x), np.zeros(0, dtype=np.uint64)
    if n > SHORT:
        out = sketch(x, bands, minima)
    if n * similarity <= SHORT + 1e-9:  # what may be linked to a short text
        least = np.sort(x)[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
        with np.errstate(over="ignore"):
            out = np.concatenate((out, mix(least + np.uint64(0xD6E8FEB86659FD93))))
    return out


def banded_chain(at_a: np.ndarray, at_b: np.ndarray, band: int) -> int:
    """Longest chain of matches that rises in both sequences, with |i - j| <= band."""
    near = np.abs(at_a - at_b) <= band
    rising = at_b[near][np.argsort(at_a[near])]
    if (np.diff(rising) > 0).all():
        return len(rising)
    ends: list[int] = []
    for x in rising.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of labelled shingles; 0 if it is below ``least``."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    need = least / (1 + least) * (n1 + n2)
    if min(n1, n2) < need - 1e-9:
        return 0.0
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < need - 1e-9:
        return 0.0
    # Unmatched shingles on either side bound how far an alignment that reaches ``need`` strays.
    m = banded_chain(at_a, at_b, int(n1 + n2 - 2 * need) + 1)
    return m / (n1 + n2 - m) if m >= need - 1e-9 else 0.0


def excess(own: np.ndarray, reference: np.ndarray, similarity: float) -> int:
    """``filed``'s e of a text, in whole numbers."""
    s = Fraction(str(similarity))
    n = len(np.setxor1d(own, reference, assume_unique=True))
    return (s.denominator + s.numerator) * n - (s.denominator - s.numerator) * len(own)


def filed(leader: np.ndarray, own: np.ndarray, reference: np.ndarray, similarity: float, linked: bool, usual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of a text by how its labelled shingles differ from the reference of its star.

    With D(x) for what only one of x and the reference has, two sets differ by
    D(r) ^ D(x), whatever the reference is. So they have similarity s or more only if
    |D(r) & D(x)| >= (e(r) + e(x)) / 2, with e(x) = |D(x)| - c |x| and c = (1 - s) / (1 + s).
    No text has e < -h, h = c |reference|. Let g = -e(leader), or 0 if that is
    less. Texts with e <= g are core: the leader alone is likely to join them.
    Those with e > g are open: among themselves they must share more than
    (e + g) / 2 differences, a core text and an open one more than that with the
    core one's e, and of an open one at least (e - h) / 2. By the prefix principle,
    in one order of all elements, two sets that share t elements share one of the
    first |D| - t + 1 of each. What the reference lacks comes first; of that, what is
    ``usual`` among the members of the star (sorted, most so last) comes last.

    What that leaves out are pairs whose e sum up to 0 or less. Those of two core texts
    are under a key of all core ones, where those not linked with the leader (as
    their shingles stand in another order, say) meet the others. Those of a text
    nearer than the leader and an open one with e <= h are under another key.
    """
    s = Fraction(str(similarity))
    p, q = s.numerator, s.denominator

    more = np.sort(np.setdiff1d(own, reference, assume_unique=True))
    if usual is not None and len(usual):
        order = np.argsort(usual)
        place = np.searchsorted(usual, more, sorter=order)
        rank = np.where(usual[order[np.minimum(place, len(usual) - 1)]] == more, order[np.minimum(place, len(usual) - 1)], -1)
        more = more[np.argsort(rank, kind="stable")]
    differ = np.concatenate((more, np.sort(np.setdiff1d(reference, own, assume_unique=True))))
    n, h = len(differ), (q - p) * len(reference)  # e, g and h are times p + q
    e = excess(own, reference, similarity)
    g = h if reference is leader else max(0, -excess(leader, reference, similarity))
    # A partner has s to 1 / s times as many shingles, which bounds its e from below as well.
    least = max(2 * p * p * len(own) // q - (p + q) * len(reference), (p + q) * len(reference) - -(-2 * q * q * len(own) // p))
    alike = -(-(e + least) // (2 * (p + q)))
    short = max(0, min(n, n + 1 - max((e + g) // (2 * (p + q)) + 1, alike)))
    home, between = (np.uint64(x) for x in HOME)
    if e <= g:
        keys, roles = [*differ[:short], home], [CORE] * short + [CORE if linked else OPEN]
        if e < -g:
            keys, roles = [*keys, between], [*roles, CORE]
    else:
        long = max(short, n + 1 - max(1, alike, -((h - e) // (2 * (p + q)))))
        keys, roles = [*differ[:long]], [OPEN] * short + [OPEN_TO_CORE] * (long - short)
        if e <= h and g < h:
            keys, roles = [*keys, between], [*roles, OPEN_TO_CORE]
    return np.array(keys, dtype=np.uint64), np.array(roles, dtype=np.int8)


def majority(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(what more than half of the sets have, what else several of them have, in order of how many do)."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    usual = (counts > 2) & (counts * 2 <= len(sets))
    return values[counts * 2 > len(sets)], values[usual][np.argsort(counts[usual], kind="stable")][-USUAL:]


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def _shingle_lists(column: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for run in words(lowered(column), "alnum"):
        found, bounds = run_shingles(run, k)
        out += [found[bounds[i] : bounds[i + 1]] for i in range(run.n)]
    return out


def text_id(text_col):
    return F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))


def classes(
    df: DataFrame,
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    minima: int = MINIMA,
) -> DataFrame:
    """(text_id, root) of all texts that link to another text of ``df``."""
    named = df.select(text_id(F.col(text_col)).alias("tid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketched(batch: pa.RecordBatch) -> dict:
        tids, keys = batch.column("tid"), []
        for x in _shingle_lists(batch.column("text"), shingle):
            keys.append(bucket_keys(labelled(x), similarity, bands, minima).view(np.int64).tolist() if len(x) else [])
        return {"tid": tids, "keys": pa.array(keys, pa.list_(pa.int64()))}

    # Equal texts have equal sketches: grouping by all columns leaves one row of each.
    nodes = cut(map_arrow(named, sketched, "tid binary, keys array<long>").where(F.size("keys") > 0).distinct())
    entries = nodes.select("tid", F.explode("keys").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    if shared.isEmpty():
        return nodes.where("false").select(F.col("tid").alias("text_id"), F.col("tid").alias("root"))
    members = cut(may_be_in(entries, "bucket", shared, 24).join(shared, "bucket"))
    # The text that shares its buckets with most others leads.
    weights = cut(members.groupBy("tid").agg(F.sum("m").alias("weight")))
    members = cut(members.join(weights, "tid").select("bucket", F.col("tid").alias("node"), "weight"))

    def packed(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        return {"tid": batch.column("tid"), "packed": pa.array([press.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())}

    wanted = weights.select("tid")
    texts = map_arrow(may_be_in(named, "tid", wanted), packed, "tid binary, packed binary").distinct()
    texts = cut(texts.join(wanted, "tid"))

    def spelt(k: str) -> DataFrame:
        return texts.select(F.col("tid").alias(k), F.col("packed").alias(f"text_{k}"))

    def centred(crowd: DataFrame, sample: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch) -> dict:
            made = [majority([labelled(x) for x in _shingle_lists(_unpacked(pa.array(held)), shingle)]) for held in batch.column("held").to_pylist()]
            return {"star": batch.column("star"), "ref": pa.array([x.tobytes() for x, _ in made], pa.binary()), "usual": pa.array([x.tobytes() for _, x in made], pa.binary())}

        def measure(batch: pa.RecordBatch):
            for part, heads, own in compared(batch):
                yield {"star": part.column("star"), "b": part.column("b"), "e": pa.array([excess(y, x[2], similarity) for x, y in zip(heads, own, strict=True)], pa.int64())}

        refs = map_arrow(sample.join(spelt("node"), "node").groupBy("star").agg(F.collect_list("text_node").alias("held")), run, "star binary, ref binary, usual binary")
        refs = cut(refs)
        both = beside_leaders(crowd.withColumnRenamed("node", "b"), spelt("b"), refs.drop("usual"))
        near = map_arrow(both.select("star", "b", "text_b", "ref"), measure, "star binary, b binary, e long")
        return near.groupBy("star").agg(F.min(F.struct("e", "b")).alias("least")).select("star", F.col("least.b").alias("a")).join(refs, "star")

    def compared(batch: pa.RecordBatch):
        """(part, labelled shingles of a and b, reference or none by row) of a batch, some texts at a time."""
        texts = [batch.column(x) for x in ("text_a", "text_b") if x in batch.schema.names]
        size = np.cumsum(sum(pc.binary_length(x).to_numpy().astype(np.int64) for x in texts)) // LOT_BYTES
        known: tuple = (None,)
        for lot in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size)) + 1):
            part = batch.slice(int(lot[0]), len(lot))
            heads = []
            for k, x in enumerate(part.column("star").to_pylist()):  # the rows of a star follow each other
                if x != known[0]:
                    ref = part.column("ref")[k].as_py()
                    head = labelled(_shingle_lists(_unpacked(part.column("text_a").slice(k, 1)), shingle)[0]) if len(texts) > 1 else None
                    usual = part.column("usual")[k].as_py() if ref is not None and len(texts) > 1 else None
                    known = x, head, None if ref is None else np.frombuffer(ref, np.uint64), None if usual is None else np.frombuffer(usual, np.uint64)
                heads.append(known)
            own = _shingle_lists(_unpacked(part.column("text_b")), shingle)
            yield part, heads, [labelled(x) for x in own]

    def judged(pairs: DataFrame, centres: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch):
            for part, heads, own in compared(batch):
                links, weights, keys, roles = [], [], [], []
                for (star, x, ref, usual), y, more in zip(heads, own, part.column("more").to_pylist(), strict=True):
                    links.append(alignment_similarity(x, y, similarity) >= similarity)
                    k, r = filed(x, y, x if ref is None else ref, similarity, links[-1], usual) if more else (np.zeros(0, np.uint64), np.zeros(0, np.int8))
                    weights.append(-excess(y, x if ref is None else ref, similarity) if more else 0)
                    keys.append(mix(k ^ np.frombuffer(star[:8], np.uint64)).view(np.int64))
                    roles.append(r)
                yield {"a": part.column("a"), "b": part.column("b"), "linked": pa.array(links), "weight": pa.array(weights, pa.int64()), "keys": _lists(keys, pa.int64()), "roles": _lists(roles, pa.int8())}

        heads = pairs.select("star", "a").distinct().join(spelt("a"), "a").join(centres.select("star", "ref", "usual"), "star", "left")
        both = beside_leaders(pairs.drop("a"), spelt("b"), heads)
        return map_arrow(both.select("star", "a", "b", "more", "text_a", "text_b", "ref", "usual"), run, f"a binary, b binary, {SEEN}")

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch):
            for part, heads, own in compared(batch):
                mask = pa.array([alignment_similarity(x[1], y, similarity) >= similarity for x, y in zip(heads, own, strict=True)])
                yield {"a": part.column("star").filter(mask), "b": part.column("b").filter(mask)}

        both = beside_leaders(pairs.select(F.col("a").alias("star"), "b"), spelt("b"), spelt("a").withColumnRenamed("a", "star"))
        return map_arrow(both.select("star", "b", "text_a", "text_b", F.lit(None).cast("binary").alias("ref")), run, "a binary, b binary")

    roots = bucket_roots(members, centred, judged, verified)
    return roots.select(F.col("node").alias("text_id"), "root")


def _lists(items: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in items])))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(items) if items else [], kind))


def with_class(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", out: str = "class_id", **options) -> DataFrame:
    """(id, class id, class size) of every row of ``df``."""
    roots = classes(df, text_col, **options)
    rows = cut(df.select(F.col(id_col).alias("id"), text_id(F.col(text_col)).alias("tid")))
    texts = rows.groupBy("tid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = texts.join(roots.select(F.col("text_id").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    groups = linked.groupBy("root").agg(F.min("least").alias("class"), F.sum("n").alias("size"))
    known = cut(linked.select("tid", "root").join(groups, "root").select("tid", "class", "size"))
    return rows.join(known, "tid").select(F.col("id").alias(id_col), F.col("class").alias(out), F.col("size").alias("class_size"))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` with one row of each class: the least id, then the least text, then any of equal rows."""
    roots = classes(df, text_col, **options)
    key, nth = free_name(df, "near_key"), free_name(df, "near_nth")
    rows = df.select(document_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), text_id(F.col(text_col)).alias("tid"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    texts = rows.groupBy("tid").agg(F.min(order).alias("least"))
    linked = texts.join(roots.select(F.col("text_id").alias("tid"), "root"), "tid", "left")
    kept = cut(linked.groupBy(F.coalesce("root", "tid").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.key").alias(key)))
    chosen = df.withColumn(key, document_key(F.col(id_col), F.col(text_col))).join(kept, key)
    return chosen.withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(F.lit(1)))).where(F.col(nth) == 1).select(*df.columns)
