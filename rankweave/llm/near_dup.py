"""MinHash near-duplicate classes by fast similarity sketching.

A document's set is its distinct word shingles. Documents with equal sets fall together before
anything else (a hash aggregation, so copies by the thousand cost one row). Each remaining set gets a
sketch by rounds of hashed bin placement: a round throws every element into a random bin with a
random value of that round; from round `bins` on, round `bins + j` throws all elements into bin j, so
2 * bins rounds always fill every bin. Rounds stop as soon as all bins are filled. Bands of the
sketch name buckets; candidate pairs are confirmed on the full sets; links make components.

No bucket is expanded into all its pairs. Each bucket first compares its members with a few leaders
only. Where a bucket then still holds several components, members of different components are
compared directly in small buckets, and by an exact prefix join on the rarest shingles in larger ones,
where a shingle of many sets meets itself in blocks. Pairs are ruled out unseen only by sizes and
parities, which never rule out a pair over the bound; so every pair that shares a bucket is confirmed,
refuted or already connected.

Nulls, empty texts and texts without words have an empty set and are linked with nothing. Texts with
fewer words than a shingle count as one shingle. Rows that repeat (the same doc_id twice) are one
document and each come back, in the same class, also where their texts differ: then the document is
linked by any of them. Rows with a null doc_id are documents without a name: their class is named by
its smallest doc_id, or by null where it has none. An empty table gives an empty result. Other columns
are not read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.memory import give_back
from rankweave.llm.shared import ASCII_LOWER, cut, materialised, mix64, shingle_hashes, word_hashes

BINS = 160
BAND_ROWS = 5
SMALL_BUCKET = 32
PARITY_WORDS = 16
BROADCAST_IDS = 1 << 18
#: Sets of one shingle that a task compares with as many others at most.
SIDE = 512
#: Names of rows without one start here; named documents have smaller ids.
UNNAMED = 1 << 62
LEADERS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 4 * 4096, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)
    return np.unique(shingle_hashes(word_hashes(raw), width))


def fast_similarity_sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """`bins` coordinates; two sets agree on each with a probability near their Jaccard similarity."""
    sketch = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    per_step = max(1, min(2 * bins, 4096 // max(1, len(items))))
    filled = False
    for first in range(0, 2 * bins, per_step):
        rounds = np.arange(first, min(2 * bins, first + per_step))
        hashed = mix64(items[None, :] ^ _SEEDS[rounds][:, None])
        where = ((hashed >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        where[rounds >= bins] = (rounds[rounds >= bins] - bins)[:, None].astype(np.uint64)
        value = (rounds[:, None].astype(np.uint64) << np.uint64(40)) | (hashed & np.uint64((1 << 40) - 1))
        # Rounds past the one that fills the last bin never win, so extra rounds in a step do no harm.
        np.minimum.at(sketch, where.ravel().astype(np.int64), value.ravel())
        filled = bool((sketch != np.iinfo(np.uint64).max).all())
        if filled:
            break
    return mix64(sketch)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the sets of few texts are in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def _digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(np.bitwise_xor.reduce(mix64(items)).view(np.int64)), int(np.add.reduce(items).view(np.int64))


def _sketch_rows(width: int, bins: int, band_rows: int):
    """Size, digest and band keys of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows: list[tuple[int, int, int]] = []
            bands = []
            for text in batch.column(1):
                items = shingle_set(text.as_py(), width)
                if not len(items):
                    rows.append((0, 0, 0))
                    bands.append(np.empty(0, np.int64))
                    continue
                sketch = fast_similarity_sketch(items, bins)
                grid = sketch.reshape(-1, band_rows)
                key = np.arange(len(grid), dtype=np.uint64)
                for column in grid.T:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                rows.append((len(items), *_digest(items)))
                bands.append(key.view(np.int64))
            offsets = np.zeros(len(bands) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in bands], out=offsets[1:])
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "n_shingles", "d1", "d2", "bands"]
            )

    return run


def _parity(items: np.ndarray) -> np.ndarray:
    """PARITY_WORDS * 64 bits, each the parity of how many items fall on it: two sets differ in at
    least as many items as these bits differ."""
    odd = np.bincount((items.view(np.uint64) >> np.uint64(11)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full_sets(width: int):
    """The full set of each text, with its name and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingle_set(text.as_py(), width) for text in batch.column(0)]
            names = [(len(x), *_digest(x)) if len(x) else (0, 0, 0) for x in sets]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in sets], out=offsets[1:])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64), pa.int64())
            bits = pa.array(np.concatenate([_parity(x) for x in sets]) if sets else np.empty(0, np.int64), pa.int64())
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), bits)
            columns = zip(*names, strict=True) if names else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), flat), parity], names=["n_shingles", "d1", "d2", "items", "parity"])

    return run


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): minimum labels by neighbour minimum and
    pointer jumping, one checkpoint a round; the links stay distributed."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        stepped = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jumped = stepped.alias("x").join(labels.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left")
        after = cut(jumped.select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "was"))
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component"))


def _name() -> Column:
    """doc_id; rows without one get a name by their text, behind all others."""
    return F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))


def _named(docs: DataFrame) -> DataFrame:
    """id and text of each row."""
    return docs.select(_name().alias("id"), "text")


def _pick(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents. Up to BROADCAST_IDS ids (a few MB) go to all tasks; more are joined
    by a shuffle."""
    ids = materialised(ids.select("id").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _likely(percent: int) -> Column:
    """Over columns na, nb, pa, pb: rules out pairs that can't reach the bound, by sizes and parities."""
    differ = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _sides(rows: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of rows that have node, n, parity and perhaps component."""
    names = (("a", "na", "pa", "ca"), ("b", "nb", "pb", "cb"))
    more = ["component"] if "component" in rows.columns else []
    return tuple(rows.select(*keep, *(F.col(c).alias(x) for c, x in zip(("node", "n", "parity", *more), n, strict=False))) for n in names)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of distinct pairs (a, b) whose full sets reach the bound."""
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return cut(met.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b"))


def _led_pairs(members: DataFrame, info: DataFrame, masks: tuple[int, ...], percent: int) -> DataFrame:
    """Likely pairs of each bucket's members with as many leaders of the bucket as there are masks:
    for each mask the member whose node comes first once the mask's bits are flipped."""
    flipped = lambda c, m: F.col(c).bitwiseXOR(F.lit(m))
    leaders = members.groupBy("key").agg(*(F.min(flipped("node", m)).alias(f"l{k}") for k, m in enumerate(masks)))
    led = members.join(leaders, "key").select("node", F.explode(F.array_distinct(F.array(*(flipped(f"l{k}", m) for k, m in enumerate(masks))))).alias("leader"))
    pairs = led.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    left, right = _sides(info)
    return materialised(pairs.join(left, "a").join(right, "b").where(_likely(percent)).select("a", "b"))


def _same_document(sketches: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links between the sets of rows that repeat an id with different texts; None without such rows."""
    key = F.struct("n_shingles", "d1", "d2")
    several = cut(sketches.where("n_shingles > 0").groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high").select("id"))
    if not several.limit(1).count():
        return None
    rows = sketches.select("id", "n_shingles", "d1", "d2").join(several, "id").distinct().join(groups.select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"])
    first = rows.groupBy("id").agg(F.min("node").alias("a"))
    return cut(rows.join(first, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = BINS, band_rows: int = BAND_ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept for each row.

    With 160 bins in bands of 5, a pair at the bound shares no bucket with probability
    (1 - 0.8**5)**32 = 3e-6, and less above it.
    """
    found = classes(_named(docs), width, percent, bins, band_rows, small_bucket)
    own = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    return found.select(own("id").alias("doc_id"), "n_shingles", own("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def classes(texts: DataFrame, width: int, percent: int, bins: int = BINS, band_rows: int = BAND_ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """id, n_shingles and component_id of each row of (id, text)."""
    sketches = materialised(texts.mapInArrow(_sketch_rows(width, bins, band_rows), "id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    key = ["n_shingles", "d1", "d2"]
    # One node for each different set, numbered once as it is written; only its bands and links matter from here on.
    alike = sketches.where("n_shingles > 0").groupBy(*key).agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    groups = materialised(alike.withColumn("node", F.monotonically_increasing_id()))
    buckets = groups.select("node", "id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialised(buckets.join(shared, "key").select("key", "node", "id", "members"))
    met = materialised(members.select("node").distinct())
    full = _pick(texts, members).select("text").mapInArrow(_full_sets(width), "n_shingles long, d1 long, d2 long, items array<long>, parity array<long>")
    wanted = groups.join(met, "node", "left_semi").select(*key, "node")
    sets = materialised(full.join(wanted, key).select("node", "n_shingles", "items", "parity").dropDuplicates(["node"]))
    info = sets.select("node", F.col("n_shingles").alias("n"), "parity")
    links = _confirmed(_led_pairs(members, info, LEADERS, percent), sets, percent)
    if (same := _same_document(sketches, groups)) is not None:
        links = links.union(same)
    component = connected_components(links)
    rest = _split_buckets(members, component, info, sets, percent, small_bucket)
    if rest is not None:
        component = connected_components(links.union(rest))
    placed = groups.join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).select(*key, "id", "component")
    lowest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(lowest, "component").select(*key, "component_id")
    return sketches.select("id", *key).join(named, key, "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _open_buckets(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    placed = members.join(component.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "members", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return materialised(placed.join(mixed, "key"))


def _split_buckets(members: DataFrame, component: DataFrame, info: DataFrame, sets: DataFrame, percent: int, small_bucket: int) -> DataFrame | None:
    """Links between members of one bucket that the leaders' links have not connected: directly in
    small buckets, by an exact prefix join in larger ones."""
    open_ = _open_buckets(members, component).join(info, "node")
    left, right = _sides(open_.where(F.col("members") <= small_bucket), "key")
    direct = left.join(right, (left["key"] == right["key"]) & F.expr("a < b and ca <> cb") & _likely(percent)).select("a", "b").distinct()
    found = _confirmed(direct, sets, percent)
    large = materialised(open_.where(F.col("members") > small_bucket).select("node", "n", "parity", "component").dropDuplicates(["node"]))
    if large.limit(1).count():
        found = found.union(_prefix_links(large, sets, percent))
    return found if found.limit(1).count() else None


def _prefix_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact for any bucket size: two sets over the bound share one of their rarest
    n - ceil(n * percent / 100) + 1 shingles, whatever the order, so only these are joined. A shingle of
    many sets is dealt into blocks of about SIDE, and each block meets each other in a group of its own."""
    tokens = materialised(sets.join(large.select("node"), "node", "left_semi").select("node", F.size("items").alias("n"), F.explode("items").alias("item")))
    often = tokens.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(often, "item", "left").select("node", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item").alias("t"))
    prefix = ranked.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("t")).alias("ts")).select(
        "node", F.explode(F.slice("ts", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("t")
    )
    placed = materialised(prefix.where("t.df > 1").select("node", F.col("t.item").alias("item")).join(large.select("node", "component"), "node"))
    counted = placed.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"))
    mixed = placed.join(counted.where("low < high").select("item", "blocks"), "item").join(large.drop("component"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = _sides(mixed.withColumn("x", own).withColumn("y", other), "item", "x", "y")[0], _sides(mixed.withColumn("y", own).withColumn("x", other), "item", "x", "y")[1]
    near = left.join(right, ["item", "x", "y"]).where(F.expr("a < b and ca <> cb") & _likely(percent))
    return _confirmed(near.select("a", "b").distinct(), sets, percent)


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each class: that with the smallest doc_id; a
    document without doc_id stays where its class has none with one. Of rows that repeat a doc_id, and of
    equal ones without, that stays whose row comes first by text."""
    found = materialised(classes(_named(docs), width, percent))
    dropped = found.where("id <> component_id").select("id").distinct()
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = docs.withColumn("__id", _name())
    left = keyed.join(F.broadcast(dropped) if few else dropped, keyed["__id"] == dropped["id"], "left_anti")
    if _repeats(found):
        first = Window.partitionBy("__id").orderBy("text", F.xxhash64(*docs.columns))
        left = left.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")
    return left.select(*docs.columns)


def _repeats(found: DataFrame) -> bool:
    """Whether an id comes twice."""
    return found.groupBy("id").count().where("count > 1").limit(1).count() > 0
