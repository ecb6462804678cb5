"""Near-duplicate detection by min-max hashing.

Under each permutation of the hashed word shingles both the minimum and the maximum are kept, so half
as many permutations give a signature of the same length with a lower variance.  Bands of the
signature bring candidates together, and every candidate pair is confirmed on the full shingle sets.

Texts with the same shingle set form one class, and a class enters the search once.  Within a bucket
members meet a pivot; after that only members that are still in different components meet, and before
a pair leaves its bucket a parity sketch must allow it: the bits in which the sketches differ are a
lower bound of the symmetric difference, so no link between members of a bucket is lost, and a large
group of copies never leaves in all pairs.

Chance of losing a link at the threshold of 0.85: (1 - 0.85 ** 8) ** 44 < 1e-6.

Cases: null texts and texts without words have no shingles, link with nothing and stay; a text with
fewer words than a shingle is one shingle; null ids are largest, and rows that repeat an id are
documents of their own; of repeated rows of the smallest id one stays; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, column, fresh, map_arrow, materialize, small, text_slices

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 44, 8
#: Shingles that the permutations are applied to at once.
CHUNK = 1 << 16
#: Words whose hashes a worker keeps, and bytes of a text that are split into words at once.
KEPT_WORDS, PIECE = 100_000, 1 << 20
#: Most rounds with one pivot for each bucket before remaining pairs meet; few enough of those for each row of
#: a bucket end the rounds early.  Buckets that still have more pairs a row after all rounds meet by prefixes.
PIVOT_ROUNDS, PAIRS_PER_ROW = 4, 2000
#: Words of 64 bits in a parity sketch.
SKETCH = 16
#: Sketches are broadcast up to so many rows (some 15 MB).
SKETCH_ROWS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space into parts of about `size` bytes, or of one word."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """Hashes of the words in lower case; of bytes: A-Z and ASCII white space only."""
    found = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in (part.lower().split() for part in pieces(text))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(texts: list[bytes], known: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each text has."""
    found, sizes = [], []
    for text in texts:
        h = word_hashes(text, known)
        n = len(h)
        if not n:
            sizes.append(0)
            continue
        width = min(n, size)
        value = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            value = (value ^ h[k : n - width + 1 + k]) * _MIX
            value ^= value >> np.uint64(29)
        own = np.unique(mix(value))
        found.append(own)
        sizes.append(len(own))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of `count` permutations of 32-bit values: fixed, the same everywhere."""
    base = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _MIX)
    return (base[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (base[count:] >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """(texts with shingles, 2 * count): minimum and maximum under each permutation."""
    sizes = sizes[sizes > 0]
    out = np.empty((len(sizes), 2 * count), np.uint32)
    factors, addends = permutations(count)
    folded = (values >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        part, at = folded[begin : ends[last - 1]], (ends[first:last] - sizes[first:last] - begin)
        permuted = np.empty_like(part)
        for k in range(count):
            np.multiply(part, factors[k], out=permuted)
            permuted += addends[k]
            out[first:last, 2 * k] = np.minimum.reduceat(permuted, at)
            out[first:last, 2 * k + 1] = np.maximum.reduceat(permuted, at)
        first = last
    return out


def parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts with shingles, SKETCH): for each bit whether an odd number of shingles falls on it."""
    sizes = sizes[sizes > 0]
    bits = 64 * SKETCH
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * bits + (values % np.uint64(bits)).astype(np.int64), minlength=bits * len(sizes)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sizes), bits), axis=1).view(np.int64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ parts[:, :, k]) + _MIX
    return key.view(np.int64)


def one_list_each(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of values as lists of the texts with shingles; null for the others."""
    offsets = np.r_[0, np.cumsum(sizes > 0)] * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=pa.array(sizes == 0))


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """Rows (id, n, digest of the set or null, keys, parity)."""
    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n bigint, digest binary, keys array<bigint>, parity array<bigint>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in text_slices(whole, 1):
                values, sizes = shingles(as_bytes(batch.column(1)), known, size)
                keys = band_keys(signatures(values, sizes, bands * rows // 2), bands, rows)
                ends = np.cumsum(sizes)
                digests = [
                    xxhash.xxh3_128_digest(values[b - n : b].tobytes()) if n else None
                    for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes),
                        pa.array(digests, pa.binary()),
                        one_list_each(keys, sizes),
                        one_list_each(parities(values, sizes), sizes),
                    ],
                    ["id", "n", "digest", "keys", "parity"],
                )

    return map_arrow(source, kernel, schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, text) to rows (id, digest, shingles)."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, digest binary, shingles array<bigint>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in text_slices(whole, 1):
                values, sizes = shingles(as_bytes(batch.column(1)), known, size)
                ends = np.cumsum(sizes)
                digests = [xxhash.xxh3_128_digest(values[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), lists], ["id", "digest", "shingles"])

    return map_arrow(docs, kernel, schema)


def connect(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of the edges (a, b): root is the smallest node of the component.

    Each node hangs below its smallest neighbour, chains are halved until they end, the edges are
    drawn between roots, and so on while edges are left.
    """
    mapping = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parent = materialize(
                parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            )
            moved = not parent.filter("moved").isEmpty()
            parent = parent.select("node", "root")
            if not moved:
                break
        if mapping is None:
            mapping = parent
        else:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            mapping = materialize(
                mapping.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            )
        ends = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        edges = edges.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = materialize(edges.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if edges.isEmpty():
            return mapping


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The materialized pairs (a, b) of nodes that have 100 * intersection >= percent * union."""
    sides = []
    for end in ("a", "b"):  # sets that no pair asks for leave before anything is shuffled, if the pairs are few
        asked = small(materialize(pairs.select(F.col(end).alias("node")).distinct()))
        sides.append(sets.join(asked, "node", "left_semi").select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")))
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.withColumn("common", F.size(F.array_intersect("sa", "sb"))).filter(
        100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))
    ).select("a", "b")


def may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes n and sketches p0, p1, ... of two sides (prefixes of their columns) allow a link."""
    a, b = (lambda c: F.col(left + c)), (lambda c: F.col(right + c))
    differ = sum((F.bit_count(a(f"p{k}").bitwiseXOR(b(f"p{k}"))) for k in range(SKETCH)), F.lit(0))
    likely_size = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    return likely_size & ((100 + percent) * differ <= (100 - percent) * (a("n") + b("n")))


def prefixed(df: DataFrame, prefix: str, *same: str) -> DataFrame:
    return df.select(*[F.col(c) if c in same else F.col(c).alias(prefix + c) for c in df.columns])


def bucket_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the members (key, node, root, main, n, p0, ...) of a bucket with different roots that may be linked.

    One side leaves out the bucket's largest component, main.
    """
    minor = prefixed(live.filter("root != main").drop("main"), "a_", "key")
    other = prefixed(live, "b_", "key")
    apart = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_main")) | (F.col("a_node") < F.col("b_node")))
    pairs = minor.join(other, (minor["key"] == other["key"]) & apart & may_link("a_", "b_", percent))
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root, n, p0, ...) with different roots that share one of their rarest shingles.

    Of two linked sets each has percent of its size in common with the other, so whichever order all sets are read
    in, they share a shingle among the first n - ceil(percent * n / 100) + 1: no link is lost, and in an order by
    rarity what a crowded bucket has in common brings nobody together.
    """
    each = sets.join(live.select("node", "n"), "node").select("node", "n", F.explode("shingles").alias("shingle"))
    each = materialize(each)
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    order = Window.partitionBy("node").orderBy("many", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = each.join(common, "shingle", "left").fillna(1, ["many"]).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= first)
    kept = materialize(ranked.filter("many > 1").select("shingle", "node").join(live, "node"))
    a, b = prefixed(kept, "a_", "shingle"), prefixed(kept, "b_", "shingle")
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
    return a.join(b, (a["shingle"] == b["shingle"]) & apart & may_link("a_", "b_", percent)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def class_components(buckets: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components of the nodes that share buckets (key, node): rows (node, root), or None without a link.

    facts: (node, n, p0, p1, ...).
    """
    comp = tested = None
    total, many = buckets.count(), facts.count()
    known = small(facts, many, SKETCH_ROWS)
    for turn in range(PIVOT_ROUNDS + 1):
        if comp is None:
            members = buckets.withColumn("root", F.col("node"))
        else:
            members = buckets.join(small(comp), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        # A bucket's pivot is its member with the smallest hash, another one in each round.
        by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("first"))
        state = (
            by_root.groupBy("key")
            .agg(
                F.sum("n").alias("size"),
                F.sum(F.col("n") * F.col("n")).alias("squares"),
                F.max(F.struct("n", "root")).alias("main"),
                F.min(F.struct("first", "root")).alias("pivot"),
            )
            .filter("size * size > squares")
            .select("key", "size", "squares", F.col("main.root").alias("main"), F.col("pivot.first.node").alias("pivot"), F.col("pivot.root").alias("pivot_root"))
        )
        state = materialize(state)
        left = state.agg(F.sum((F.col("size") * F.col("size") - F.col("squares")) / 2)).first()[0]
        if not left:
            break
        last = turn == PIVOT_ROUNDS or (turn > 0 and left <= PAIRS_PER_ROW * total)
        if last:
            hot = (F.col("size") * F.col("size") - F.col("squares")) / 2 > PAIRS_PER_ROW * F.col("size")
            live = materialize(members.join(state.select("key", "main", hot.alias("hot")), "key").join(known, "node"))
            pairs = bucket_pairs(live.filter("not hot").drop("hot"), percent)
            crowded = live.filter("hot").drop("key", "main", "hot").distinct()
            if not crowded.isEmpty():
                pairs = pairs.unionByName(prefix_pairs(materialize(crowded), sets, percent))
        else:
            live = members.join(state.select("key", "pivot", "pivot_root"), "key").filter("root != pivot_root")
            met = live.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
            a, b = prefixed(facts, "a_"), prefixed(facts, "b_")
            pairs = met.join(small(a, many, SKETCH_ROWS), F.col("a") == F.col("a_node")).join(small(b, many, SKETCH_ROWS), F.col("b") == F.col("b_node"))
            pairs = pairs.filter(may_link("a_", "b_", percent)).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        links = materialize(confirm(pairs, sets, percent))
        if not links.isEmpty():
            if comp is None:
                comp = connect(links)
            else:
                above = comp.select(F.col("node").alias("x"), "root")
                ends = links.join(above, F.col("a") == F.col("x"), "left").select(F.coalesce("root", "a").alias("a"), "b")
                ends = ends.join(above, F.col("b") == F.col("x"), "left").select("a", F.coalesce("root", "b").alias("b"))
                more = connect(materialize(ends.filter("a != b").distinct()))
                above = more.select(F.col("node").alias("x"), F.col("root").alias("above"))
                moved = comp.join(above, F.col("root") == F.col("x"), "left").select("node", F.coalesce("above", "root").alias("root"))
                added = more.join(comp, "node", "left_anti")
                comp = materialize(moved.unionByName(added).distinct())
        if last:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
    return comp


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, and digest, the 128-bit digest of its shingle set."""
    table = materialize(sketch(docs, id_col, text_col, bands, rows, size).withColumn("row_id", F.monotonically_increasing_id()))
    classes = table.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_id")).alias("first"))
    classes = materialize(classes.select("digest", F.col("first.id").alias("id"), F.col("first.row_id").alias("node")))
    keys = table.select("row_id", F.explode("keys").alias("key")).join(
        classes.select(F.col("node").alias("row_id")), "row_id", "left_semi"
    )
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    buckets = materialize(keys.join(shared, "key").select("key", F.col("row_id").alias("node")))
    nodes = materialize(buckets.select("node").distinct().join(classes, "node"))
    many = nodes.count()
    comp = None
    if many:
        wanted = small(nodes.select(F.col("id").alias("asked")).distinct(), many)
        texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
        texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("asked")), "left_semi")
        # An id may stand on several texts, or be null: the digest says which one is the node's.
        found = shingle_sets(texts, size).join(small(nodes.select("digest", "node"), many), "digest").select("node", "shingles")
        sets = materialize(found)
        if sets.count() != many:  # rows that repeat the id and the text
            sets = materialize(sets.dropDuplicates(["node"]))
        sketches = [F.col("parity")[k].alias(f"p{k}") for k in range(SKETCH)]
        facts = table.join(small(nodes.select(F.col("node").alias("row_id")), many), "row_id", "left_semi")
        facts = materialize(facts.select(F.col("row_id").alias("node"), "n", *sketches))
        comp = class_components(buckets, facts, sets, percent)
    if comp is not None:
        roots = classes.join(comp, "node", "left").select("digest", "id", "node", F.coalesce("root", "node").alias("root"))
        roots = materialize(roots)
        names = roots.filter("node != root").select("root").distinct().join(roots, "root")
        names = names.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
        roots = roots.join(names, "root", "left").select("digest", F.coalesce("best", F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
    else:
        roots = classes.select("digest", F.struct("id", "node").alias("best"))
    # Classes of one row need no join: only rows whose class has another row or another root are looked up.
    done = table.select("id", "n", "digest", "row_id").join(roots, "digest", "left")
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("best.id", "id").alias("component_id"),
        F.coalesce(F.col("best.node") == F.col("row_id"), F.lit(True)).alias("kept"),
        "digest",
        "row_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs with one row of each group, with their own columns, whatever their names."""
    found = materialize(near_duplicates(docs, id_col, text_col, **options).select(column(id_col).alias("id"), "kept", "digest"))
    gone_id = fresh("gone", docs)
    gone = materialize(found.filter("not kept").select(F.col("id").alias(gone_id)))
    dropped = gone.count()
    shared = found.join(small(gone.distinct(), dropped), F.col("id").eqNullSafe(F.col(gone_id)), "left_semi")
    if shared.count() == dropped:  # the ids of dropped rows, null among them, stand on no other row
        return docs.join(small(gone, dropped), docs[f"`{id_col}`"].eqNullSafe(F.col(gone_id)), "left_anti")
    # Rows of an id with equal sets are interchangeable, so so many of them stay as were kept.
    names = docs.columns
    row, digest, nth, stays, stay_id, stay_digest = (fresh(x, docs) for x in ("row", "digest", "nth", "stays", "stay_id", "stay_digest"))
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    sets = sketch(keyed, row, text_col, 2, 2, options.get("size", SHINGLE)).select(F.col("id").alias(row), F.col("digest").alias(digest))
    stay = found.filter("kept").groupBy(F.col("id").alias(stay_id), F.col("digest").alias(stay_digest)).agg(F.count(F.lit(1)).alias(stays))
    order = Window.partitionBy(column(id_col), digest).orderBy(row)
    same = column(id_col).eqNullSafe(F.col(stay_id)) & F.col(digest).eqNullSafe(F.col(stay_digest))
    kept = keyed.join(sets, row).withColumn(nth, F.row_number().over(order)).join(stay, same).filter(F.col(nth) <= F.col(stays))
    return kept.select(*map(column, names))
