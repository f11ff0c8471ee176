"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, then verified exactly.

Every text becomes the multiset of its shingles (five lower-cased words; a shorter text has one). A shingle of weight w
(how often it occurs) owns Poisson processes over the discretised weight axis: one for each dyadic level (0,1], (1,2],
(2,4], (4,8] ... that w reaches, whose rate is the level's width. A point of a process has a time, a weight within the level
(points above w are thinned out, which is how a partly covered level is split) and a register. A register keeps the
earliest time it gets. Two texts agree in a register with a probability equal to their multiset Jaccard similarity.
Only points before a time limit are drawn, at first one by which all registers are most likely filled; texts with an
empty register are drawn again with a longer one, so that the signature is exact.

Stages: signatures; buckets by band; pairs; verification on the whole multisets; components. Equal texts are joined to one
first. In a bucket, every member is paired with the one of least id, unless their sizes alone rule a link out. Buckets whose
other members are not in one component after that are compared in full: the members outside the main component with all others,
in tiles of bounded size, so that every pair that shares a band is decided by its exact similarity or already in one class. In
very large buckets, where tiles would repeat members often, cheap rounds come first: every member outside the main component
meets `draws` members of that and as many of the others, drawn anew for each bucket and round. No bucket is capped, and no pair
counts as similar without verification.

A class is one of texts, not of ids: texts are equal if their lower-cased words are (compared by BLAKE2b-128 of the words
themselves), every distinct text gets a number of its own, and links are between these numbers. So rows that share a doc_id
but not their text are told apart, in classes of their own if their texts are.

Null or word-free texts: equal ones (null only with null, empty of words with empty of words) form a class. Rows with a
null id get a null class. Repeated rows fall into one class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import textkernel as K
from folio.llm.common import distinct_edges, small_batches, stars, table, written

U = np.uint64


def multisets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingles of each text: the text's number, the distinct shingles and how often each occurs."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def bag_minhash(owner: np.ndarray, items: np.ndarray, weight: np.ndarray, n: int, registers: int, spread: float = 8.0) -> np.ndarray:
    """n rows of `registers` earliest times; a row whose text has no items stays infinite."""
    out = np.full((n, registers), np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, spread * registers / np.maximum(total, 1), 0.0)
        pick = np.flatnonzero(todo[owner])
        for part in np.array_split(pick, max(1, -(-len(pick) // (1 << 20)))):
            _points(out, owner[part], items[part], weight[part], limit, registers)
        todo &= np.isinf(out).any(1)
        spread *= 3
    return out


def _points(out: np.ndarray, own: np.ndarray, item: np.ndarray, w: np.ndarray, limit: np.ndarray, registers: int) -> None:
    """Puts the points of the items' processes up to their texts' time limits into the registers."""
    level = 0
    while len(own):
        low = 0 if level == 0 else 1 << (level - 1)
        width = 1 if level == 0 else 1 << (level - 1)
        state = K.mix(item + U(((level + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)))
        o, ww, t, ends = own, w, np.zeros(len(own)), limit[own]
        while len(o):
            t = t - np.log(_uniform(state)) / width
            alive = t <= ends
            if not alive.all():
                o, ww, t, ends, state = o[alive], ww[alive], t[alive], ends[alive], state[alive]
            if not len(o):
                break
            draw = K.mix(state ^ U(0xA5A5A5A55A5A5A5A))
            register = ((draw >> U(33)) * U(registers)) >> U(31)
            if width > 1:
                keep = low + ((draw & U(0xFFFFFFFF)).astype(np.float64) / 2**32) * width < ww
                np.minimum.at(out.reshape(-1), o[keep] * registers + register[keep].astype(np.int64), t[keep])
            else:
                np.minimum.at(out.reshape(-1), o * registers + register.astype(np.int64), t)
            state = K.mix(state + U(0x9E3779B97F4A7C15))
        level += 1
        more = w > (1 << (level - 1))
        own, item, w = own[more], item[more], w[more]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        key = K.mix(key + bits[:, :, r] * U(pow(K.BASE, r + 1, 1 << 64)))
    return K.mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def _shingled(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """For runs of texts lo to hi: lo, hi, the multisets of all, and for each text what equal texts share (empty for null)."""
    data, offsets = K.views(texts)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    for lo, hi in K.blocks(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        hashes, _, _, places = K.word_hashes(part, at, lower=True)
        shown, cuts = K.plain_words(part, at)
        raw = memoryview(shown)
        same = [b"" if null[lo + i] else blake2b(raw[cuts[i] : cuts[i + 1]], digest_size=16).digest() for i in range(hi - lo)]
        yield lo, hi, *multisets(*K.shingles(hashes, places, shingle)), same


def signatures(docs: DataFrame, bands: int = 24, rows: int = 5, shingle: int = 5) -> DataFrame:
    """(doc_id, raw, same, size, bands) of every row of docs (doc_id, text, raw): same is equal for texts of equal words, size is
    the number of shingles, repeated ones counted, bands has the band keys (none for a text without words)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: list[bytes] = []
            sets: list[np.ndarray] = []
            keys: list[np.ndarray] = []
            for lo, hi, owner, items, weight, equal in _shingled(batch.column("text"), shingle):
                signature = bag_minhash(owner, items, weight, hi - lo, bands * rows)
                found = band_keys(signature, bands, rows).view(np.int64)
                many = np.bincount(owner, weights=weight, minlength=hi - lo).astype(np.int64)
                same += equal
                sets.append(many)
                keys += [found[i] if many[i] else found[i][:0] for i in range(hi - lo)]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            columns = [
                batch.column("doc_id"),
                batch.column("raw"),
                pa.array(same, pa.binary()),
                pa.array(np.concatenate([*sets, np.empty(0, np.int64)]), pa.int64()),
                pa.ListArray.from_arrays(sizes, pa.array(flat)),
            ]
            yield pa.record_batch(columns, names=["doc_id", "raw", "same", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "raw").mapInArrow(
        run, "doc_id long, raw binary, same binary, size long, bands array<long>",
    )


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(same, items, counts) of texts (text): each one's distinct shingles, ascending, and their counts, as bytes; counts that are
    all 1 are left out."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: list[bytes] = []
            items_out, counts_out = [], []
            for lo, hi, owner, items, weight, equal in _shingled(batch.column("text"), shingle):
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                same += equal
                items_out += [items[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
                owns = [weight[cut[i] : cut[i + 1]] for i in range(hi - lo)]
                counts_out += [b"" if (w == 1).all() else w.astype(np.uint32).tobytes() for w in owns]
            yield pa.record_batch(
                [pa.array(same, pa.binary()), pa.array(items_out, pa.binary()), pa.array(counts_out, pa.binary())], names=["same", "items", "counts"],
            )

    return texts.select("text").mapInArrow(run, "same binary, items binary, counts binary")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float, tile_rows: int = 256, tile_bytes: int = 4 << 20) -> DataFrame:
    """The links (a, b), a < b, among pairs (hub, id, size of id): those whose exact multiset Jaccard similarity reaches the threshold.

    A hub's pairs are dealt to tiles of about tile_rows members or tile_bytes of shingles; a tile holds its hub once, and compares
    it with all its members at once."""
    sized = written(pairs, "pairs")
    tiles = sized.groupBy(F.col("hub").alias("h")).agg(_tiles(F.count("*"), F.sum("size"), tile_rows, tile_bytes).alias("wide"))
    dealt = sized.join(tiles, F.col("hub") == F.col("h")).select(
        "hub", "id", F.pmod(F.xxhash64("id"), F.col("wide")).cast("int").alias("tile"), F.lit(1).alias("side"),
    )
    hubs = tiles.select(
        F.col("h").alias("hub"), F.col("h").alias("id"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("tile"), F.lit(0).alias("side"),
    )
    rows = _few(written(dealt.unionByName(hubs), "tiles")).join(sets, "id")
    rows = rows.select("hub", "tile", "side", "id", F.col("side").cast("long").alias("root"), "items", "counts")
    return rows.groupBy("hub", "tile").applyInArrow(lambda tile: _tile_links(tile, threshold, each=True), "a long, b long").distinct()


def _tiles(members: Column, shingles: Column, tile_rows: int, tile_bytes: int) -> Column:
    """Into how many parts they are dealt; a shingle takes at most 12 bytes."""
    return F.ceil(F.greatest(members / tile_rows, shingles * 12 / tile_bytes)).cast("int")


def _few(df: DataFrame, most: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """A written df of a few numbers a row (about 120 bytes in memory), to be broadcast unless it has more than `most` rows. rows is
    their number where it is known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def _buckets(members: DataFrame) -> DataFrame:
    """(key, id, size, low, low_size) of every member (key, id, size) of a bucket of two or more; low is the bucket's least id.
    Members may be repeated; those of buckets are distinct."""
    ends = members.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("size", "id").alias("low_size"))
    hubs = written(ends.where("low < high").drop("high"), "hubs")
    return members.join(_few(hubs), members.key == hubs.k).select("key", "id", "size", "low", "low_size").distinct()


def _pairs(rows: DataFrame, *others: str) -> DataFrame:
    """The distinct pairs (hub, id, size) of id with each of the other columns."""
    return rows.select("id", "size", F.explode(F.array_distinct(F.array(*others))).alias("hub")).where("id != hub").select("hub", "id", "size").distinct()


def _split_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, size, root, many) of the members (key, id, size) of buckets that hold more than one component; many is their number."""
    rooted = written(members.join(roots, members.id == roots.node, "left").select("key", "id", "size", F.coalesce("root", "id").alias("root")), "rooted")
    counts = written(
        rooted.groupBy(F.col("key").alias("k")).agg(
            F.count("*").alias("many"), F.min("root").alias("r0"), F.max("root").alias("r1"),
        ).where("r0 < r1").select("k", "many"),
        "counts",
    )
    return rooted.join(counts, rooted.key == counts.k).select("key", "id", "size", "root", "many")


def _rest_pairs(buckets: DataFrame, salts: range) -> DataFrame:
    """In large buckets: every member outside the main component with members of it and of the others, drawn anew for each salt."""
    draws = [F.min_by("id", F.xxhash64("id", "key", F.lit(salt))).alias(f"hub{salt}") for salt in salts]
    names = [f"hub{salt}" for salt in salts]
    parts = buckets.groupBy("key", "root").agg(F.count("*").alias("n"), *draws)
    others = [F.max_by(name, F.xxhash64(name, F.lit(salt))).alias(f"any{salt}") for name, salt in zip(names, salts, strict=True)]
    main = written(parts.groupBy(F.col("key").alias("k")).agg(F.max_by(F.struct("root", *names), F.struct("n", "root")).alias("main"), *others), "mains")
    rest = buckets.join(main, buckets.key == main.k).where("root != main.root")
    return _pairs(rest.select("id", "size", *(f"main.{n}" for n in names), *(f"any{salt}" for salt in salts)), *names, *(f"any{salt}" for salt in salts))


def _overlaps(items: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The size of the multiset intersection of one text with each of others, whose items begin at starts; items ascend."""
    at = np.minimum(np.searchsorted(items, others), len(items) - 1)
    return np.add.reduceat(np.where(items[at] == others, np.minimum(counts[at], other_counts), 0), starts)


def _tile_links(tile: pa.Table, threshold: float, each: bool = False) -> pa.Table:
    """Links between the texts of side 0 and those of side 1 (2: of both) that are in other components: all of them if each, or else
    as many as join what they join, so that a tile gives fewer links than it has texts, however many pairs of it are similar. Links
    are between ids if each, or else between the roots of the components that they join."""
    side, ids, roots = (np.asarray(tile.column(c).combine_chunks()) for c in ("side", "id", "root"))
    items = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("items")]
    given = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in tile.column("counts")]
    counts = [c if len(c) else np.ones(len(i), np.int64) for c, i in zip(given, items, strict=True)]
    total = np.array([x.sum() for x in counts], np.int64)
    out: list[tuple[int, int]] = []
    ends = ids if each else roots
    joined = roots.copy()  # the component of each text after the links so far
    order = np.flatnonzero(side != 0)
    order = order[np.argsort(total[order], kind="stable")]
    if len(order):
        flat, flat_counts = np.concatenate([items[k] for k in order]), np.concatenate([counts[k] for k in order])
        at = np.concatenate([[0], np.cumsum([len(items[k]) for k in order])])
        for one in np.flatnonzero(side != 1):
            # similarity is at most the ratio of the sizes
            lo, hi = np.searchsorted(total[order], [total[one] * threshold * (1 - 1e-9), total[one] / threshold * (1 + 1e-9)], "left")
            near = order[lo:hi]
            if (joined[near] == joined[one]).all():
                continue
            both = _overlaps(items[one], counts[one], flat[at[lo] : at[hi]], flat_counts[at[lo] : at[hi]], at[lo:hi] - at[lo])
            hit = near[(both / (total[one] + total[near] - both) >= threshold) & (joined[near] != joined[one])]
            if not each:
                hit = hit[np.unique(joined[hit], return_index=True)[1]]
                joined[np.isin(joined, joined[hit])] = joined[one]
            out += [(min(ends[one], ends[k]), max(ends[one], ends[k])) for k in hit]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _exact_links(buckets: DataFrame, sets: DataFrame, threshold: float, tile_rows: int, tile_bytes: int = 4 << 20) -> DataFrame:
    """Links between roots that join all that the similar pairs of different components in buckets (key, id, size, root) join: every member
    outside a bucket's main component is compared with all members, but for those that links of its tile have joined to it already. Both are dealt by hash to parts of about tile_rows members or
    tile_bytes of shingles, and each part meets each in a task's tile, so that only parts are held and repeated. A member that
    is in both parts of a tile comes once."""
    sized = buckets.select("key", "id", "size", "root")
    parts = sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    of_bucket = parts.groupBy("key").agg(
        F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"),
    )
    dealt = written(
        of_bucket.select(
            F.col("key").alias("k"),
            F.col("main.root").alias("main"),
            _tiles(F.col("n"), F.col("size"), tile_rows, tile_bytes).alias("wide"),
            _tiles(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"), tile_rows, tile_bytes).alias("high"),
        ).where("high > 0"), "dealt"
    )
    part = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = sized.join(dealt, sized.key == dealt.k).withColumns({"outside": F.col("root") != F.col("main"), "own_i": part("high"), "own_j": part("wide")})
    rest = rows.where("outside and wide > 1").select("key", "id", "root", "own_j", F.lit(0).alias("side"), F.col("own_i").alias("i"), every("wide").alias("j"))
    all_ = rows.select("key", "id", "root", "outside", "own_i", every("high").alias("i"), F.col("own_j").alias("j"))
    all_ = all_.withColumn("side", F.when(F.col("outside") & (F.col("i") == F.col("own_i")), 2).otherwise(1))
    names = ["key", "i", "j", "side", "id", "root"]
    tiles = _few(written(rest.where("j != own_j").select(*names).unionByName(all_.select(*names)), "tiles"))
    tiles = tiles.join(sets, "id").select(*names, "items", "counts")
    return tiles.groupBy("key", "i", "j").applyInArrow(lambda tile: _tile_links(tile, threshold), "a long, b long").distinct()


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after new links between nodes of the old ones. In both, a node without a row is the root of its own."""
    at = lambda x: roots.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    up = links.join(at("a"), F.col("a") == F.col("na"), "left").join(at("b"), F.col("b") == F.col("nb"), "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"),
    )
    over = stars(distinct_edges(up))
    moved = roots.join(
        over.select(F.col("node").alias("r"), F.col("root").alias("top")), F.col("root") == F.col("r"), "left",
    ).select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(over.join(roots, "node", "left_anti").select("node", "root")), "roots")


def classes(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 5,
    shingle: int = 5,
    small: int = 2048,
    rounds: int = 2,
    draws: int = 2,
    tile_rows: int = 256,
    by_row: bool = False,
) -> DataFrame:
    """(doc_id, raw, class_no, class_id) for every row of docs: class_no is the class's own number, class_id the least doc_id in it.

    raw is the text's MD5 if by_row, else null. small, rounds and draws say what the cheap rounds (in buckets of more than small
    members) do, not what is found: the exact part that follows them decides all pairs that they leave open."""
    raw = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"")) if by_row else F.lit(None).cast("binary")
    sig = written(signatures(docs.select("doc_id", "text", raw.alias("raw")), bands, rows, shingle), "signatures")
    firsts = sig.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"))
    firsts = written(firsts.select(F.col("same").alias("s"), "rep", F.monotonically_increasing_id().alias("node")), "firsts")
    of_text = written(
        sig.join(firsts, sig.same == firsts.s, "left").select(
            "doc_id", "raw", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "rep", "size", "bands",
        ),
        "copies",
    )
    members = of_text.where("node is not null and doc_id = rep").select(F.explode("bands").alias("key"), F.col("node").alias("id"), "size")
    shared = written(_buckets(members), "buckets")
    wanted = written(firsts.join(shared.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "wanted")
    n_wanted = wanted.count()
    few = _few(wanted, rows=n_wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(few.select("rep"), "rep", "left_semi")
    sets = shingle_sets(texts, shingle).join(few, F.col("same") == F.col("s")).select(F.col("node").alias("id"), "items", "counts")
    sets = written(sets, "shingles")
    if sets.count() > n_wanted:  # repeated rows
        sets = written(sets.dropDuplicates(["id"]), "shingles")

    # texts are no more similar than the smaller is to the larger in size
    close = shared.where(F.least("size", "low_size") >= F.greatest("size", "low_size") * (threshold * (1 - 1e-9)))
    roots = stars(written(similar(_pairs(close, "low"), sets, threshold, tile_rows), "links"))
    others = shared.where("id != low").select("key", "id", "size")  # the least is decided with all
    left = written(_split_buckets(others, roots), "left")
    most = left.agg(F.max("many")).first()[0]  # null: nothing is left
    for turn in range(rounds):
        if (most or 0) <= small:
            break
        large = left.where(F.col("many") > small)
        links = written(similar(_rest_pairs(large, range(turn * draws, (turn + 1) * draws)), sets, threshold, tile_rows), "links")
        if not links.limit(1).count():
            break
        roots = _merge(roots, links)
        left = written(_split_buckets(others, roots), "left")
        most = left.agg(F.max("many")).first()[0]
    rooted = firsts.join(
        roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left",
    ).select("node", "rep", F.coalesce("root", "node").alias("class_no"))
    if most is not None:
        over = stars(written(_exact_links(left, sets, threshold, tile_rows), "links"))
        over = over.select(F.col("node").alias("r"), F.col("root").alias("top"))
        rooted = rooted.join(over, F.col("class_no") == F.col("r"), "left").select("node", "rep", F.coalesce("top", "class_no").alias("class_no"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy(F.col("class_no").alias("c")).agg(F.min("rep").alias("class_id"))
    numbered = rooted.join(least, F.col("class_no") == F.col("c")).select(F.col("node").alias("n"), "class_no", "class_id")
    return of_text.join(numbered, of_text.node == F.col("n"), "left").select("doc_id", "raw", "class_no", "class_id")


def op9_bag_minhash(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, class_id, class_size."""
    found = written(classes(table(spark, sf_dir, "documents")), "classes")
    sizes = found.groupBy(F.col("class_no").alias("c")).agg(F.count("*").alias("class_size"))
    return found.join(sizes, found.class_no.eqNullSafe(sizes.c)).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without all rows but one of each class of near-duplicates: that of least doc_id (of these, of least MD5 of its text;
    of equal rows any). Rows that share a doc_id but not their class all stay, and so do rows without doc_id."""
    found = written(classes(docs, by_row=True, **how).where("doc_id is not null"), "classes")
    best = found.groupBy(F.col("class_no").alias("c")).agg(F.min(F.struct("doc_id", "raw")).alias("best"))
    judged = found.join(best, F.col("class_no") == F.col("c")).select("doc_id", "raw", (F.struct("doc_id", "raw") == F.col("best")).alias("stays"))
    judged = written(judged.groupBy("doc_id", "raw").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "judged")
    n_gone, n_again = judged.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    gone = _few(judged.where("not stays").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")), rows=n_gone)
    own_raw = F.coalesce(F.unhex(F.md5(docs.text.cast("binary"))), F.lit(b""))
    kept = docs.join(gone, (docs.doc_id.cast("long") == F.col("__id")) & (own_raw == F.col("__raw")), "left_anti")
    if n_again:  # rows that occur more than once
        again = _few(judged.where("stays").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")), rows=n_again)
        marked = kept.join(
            again, (kept.doc_id.cast("long") == F.col("__id")) & (F.coalesce(F.unhex(F.md5(kept.text.cast("binary"))), F.lit(b"")) == F.col("__raw")), "left",
        )
        once = marked.where("__id is not null").dropDuplicates(["__id", "__raw"])
        kept = marked.where("__id is null").unionByName(once).select(*docs.columns)
    return kept
