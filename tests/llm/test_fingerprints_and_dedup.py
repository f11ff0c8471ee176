import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from folio.llm import near_dedup as N
from folio.llm.fingerprints import Fingerprints, fingerprint, likeness, op2_multiset_fingerprint

U = np.uint64
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_fingerprints_are_homomorphic_and_order_free():
    text = "first para here\nsecond one is longer than that\nthird\nthird"
    shuffled = text.split("\n")
    random.Random(1).shuffle(shuffled)
    whole, other = fingerprint([text.encode()]), fingerprint(["\n".join(shuffled).encode()])
    assert whole.strings() == other.strings()
    less = fingerprint([b"first para here\nthird\nthird"])
    part = fingerprint([b"second one is longer than that"])
    assert (whole - part).strings() == less.strings() and (less + part).strings() == whole.strings()
    assert Fingerprints.parse(whole.strings()).strings() == whole.strings()
    assert whole.strings() != fingerprint([text.encode() + b"\nthird"]).strings()
    assert likeness(whole, other).tolist() == [1.0]


def brute_fingerprint(text):
    """The sums of the paragraphs' vectors, and a count of signed 3-word runs, by plain Python."""
    strong, runs = [0] * 32, collections.Counter()
    for p in text.split("\n"):
        first = hashlib.blake2b(p.encode(), digest_size=32).digest()
        wide = b"".join(hashlib.blake2b(first + bytes([c])).digest() for c in range(4))
        strong = [(s + int.from_bytes(wide[8 * k : 8 * k + 8], "little")) % 2**64 for k, s in enumerate(strong)]
        w = re.findall(r"[^\x20\x09-\x0d]+", p)
        runs.update(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)) if w)
    return strong, runs


def test_sums_and_lanes_against_brute_force():
    texts = ["", "one", "a b c d\n\na b c d\nx", "a " * 100_000, "tab\tand\x0bmore\nÜñï\n"]
    found = fingerprint([t.encode() for t in texts])
    for i, t in enumerate(texts):
        strong, runs = brute_fingerprint(t)
        assert found.strong[i].tolist() == strong
        lanes = np.zeros(128, np.int64)
        for run, n in runs.items():  # a run's lane and sign, from a text that is this run alone
            lanes += n * fingerprint([" ".join(run).encode()]).lanes[0].view(np.int32)
        assert lanes.tolist() == found.lanes[i].view(np.int32).tolist()


def test_likeness_of_very_repetitive_texts():
    for n in (4000, 40000, 400000):
        own, edited = fingerprint([b"a " * n]), fingerprint([b"a " * (n // 2) + b"b c d e f g h i j k " * 20])
        assert likeness(own, edited)[0] > 0.99


def test_op2_against_brute_force(spark, odd):
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows))
    want = collections.Counter()
    for (i, t), (_, f) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = op2_multiset_fingerprint(spark, odd).collect()
    assert collections.Counter((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.doc_id].add(r.fingerprint)
    assert by_text[6] == by_text[7] and len(by_text[6]) == 1


def test_likeness_tells_edited_from_other_texts(spark, data):
    rows = op2_multiset_fingerprint(spark, data).toPandas()
    long_ = rows[rows.n_chars > 1000]
    assert long_.near_edited.median() > 0.4 and long_.near_next.median() < 0.1
    assert (long_.near_edited > long_.near_next).mean() > 0.95


def test_registers_agree_as_often_as_multisets_overlap():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(1, 20, 60), rng.integers(1, 20, 60)
    b[:20] = 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    owner = np.repeat([0, 1], [60, 40])
    m = 8192
    sig = N.bag_minhash(owner, np.concatenate([items, items[20:]]), np.concatenate([a, b[20:]]), 2, m)
    assert not np.isinf(sig).any() and abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def brute_classes(rows, threshold=0.8):
    """class of each id: equal word sequences, or linked by multisets of 5-word shingles of similarity >= threshold."""
    words = {k: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) for k, t in rows.items()}
    bags = {k: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter() for k, w in words.items()}
    parent = {k: k for k in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(rows)
    for i, a in enumerate(names):
        for b in names[:i]:
            same = words[a] == words[b] and (rows[a] is None) == (rows[b] is None)
            both = sum((bags[a] & bags[b]).values())
            if same or (both and both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= threshold):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in rows}


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = {}, 0
    for size in (1, 1, 2, 5, 45):  # groups of near copies; in the largest, hubs and draws have to find the links
        base = [word() for _ in range(120)]
        for c in range(size):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, 3)) if c else 0):
                text[rng.randrange(120)] = word()
            rows[k] = " ".join(text)
            k += 1
    rows |= {k: "", k + 1: " \n", k + 2: None, k + 3: None, k + 4: "One two", k + 5: "one  TWO", k + 6: "one two one two one two one two", k + 7: "one two one two one two"}
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), small=8).collect()}
    assert got == brute_classes(rows)


def test_every_link_of_a_large_group_is_found(spark):
    """Hundreds of copies of similarity 0.78 to 0.85: each of the first half is near the base, each of the second near one of these alone."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def edited(text, n):
        text = list(text)
        for k in rng.sample(range(0, 120, 6), n):
            text[k] = word()
        return text

    base = [word() for _ in range(120)]
    near = [base] + [edited(base, 2) for _ in range(150)]
    far = [edited(t, rng.choice((2, 2, 3))) for t in near[1:]]
    order = list(range(len(near) + len(far)))
    rng.shuffle(order)
    rows = {k: " ".join((near + far)[i]) for k, i in enumerate(order)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_classes(rows)
    assert 10 < len(set(want.values())) < 150  # some copies do stay apart
    for tile_rows in (256, 50):
        assert {r.doc_id: r.class_id for r in N.classes(docs, tile_rows=tile_rows).collect()} == want


def test_large_groups_make_no_more_pairs_than_bucket_members(spark, monkeypatch):
    """Near copies on both sides of the threshold, as many of them apart as together."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(120)], {}
    for k in range(300):
        text = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice((1, 2, 4, 5))):
            text[at] = word()
        rows[k] = " ".join(text)
    made, write = {}, N.written

    def counted(df, what="step", *how):
        out = write(df, what, *how)
        made[what] = made.get(what, 0) + (out.count() if what in ("pairs", "buckets") else 0)
        return out

    monkeypatch.setattr(N, "written", counted)
    found = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)
    assert 0 < made["pairs"] <= made["buckets"]


def test_a_member_in_both_parts_of_a_tile_comes_once():
    text = np.arange(1, 101, dtype=np.uint64)
    near, far = np.append(text[:95], U(7777)), np.arange(1000, 1100, dtype=np.uint64)
    items = [np.sort(x).tobytes() for x in (text, near, far)]
    tile = pa.table({"side": [1, 2, 2], "id": [1, 2, 3], "root": [1, 2, 3], "items": pa.array(items, pa.binary()), "counts": pa.array([b""] * 3, pa.binary())})
    assert N._tile_links(tile, 0.8).to_pylist() == [{"a": 1, "b": 2}]


def test_a_tile_gives_fewer_links_than_it_has_texts():
    """Three groups of 40 near copies, every one in a component of its own; and far texts."""
    groups = [[np.append(np.arange(g * 1000 + 1, g * 1000 + 100), g * 1000 + 500 + k) for k in range(40)] for g in range(3)]
    texts = [np.sort(x.astype(np.uint64)).tobytes() for g in groups for x in g] + [np.arange(9000 + 200 * k, 9100 + 200 * k, dtype=np.uint64).tobytes() for k in range(5)]
    n = len(texts)
    ids = np.random.default_rng(8).permutation(n) + 10
    for side in ([2] * n, [0, 1] * (n // 2) + [0] * (n % 2)):
        tile = pa.table({"side": side, "id": ids, "root": ids, "items": pa.array(texts, pa.binary()), "counts": pa.array([b""] * n, pa.binary())})
        links = N._tile_links(tile, 0.8).to_pylist()
        root = {int(i): int(i) for i in ids}
        for x in links:
            old, new = root[x["a"]], root[x["b"]]
            root = {k: new if v == old else v for k, v in root.items()}
        assert len({root[int(i)] for i in ids}) == 8 and all(len({root[int(i)] for i in ids[40 * g : 40 * g + 40]}) == 1 for g in range(3))
        assert len(links) == n - 8


def shuffled_joins(df):
    return re.findall("SortMergeJoin|ShuffledHashJoin", df._jdf.queryExecution().executedPlan().toString())


def test_texts_and_shingles_are_not_shuffled_to_be_joined(spark, monkeypatch):
    """Whatever the size below which Spark broadcasts by itself: with that, plans differ between small and large tables."""
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(10, 110, 10)]
    far = [" ".join([*base[:10], *(f"{v}{k}" if k % 2 else f"w{k}" for k in range(110))]) for v in "ab"]
    docs = spark.createDataFrame([*enumerate([*near, *far]), (3, near[3])], "doc_id long, text string")
    plans, write = [], N.written

    def kept(df, what="step", *how):
        if {"items", "counts"} & set(df.columns) or what == "links":
            plans.append((what, df))
        return write(df, what, *how)

    monkeypatch.setattr(N, "written", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not shuffled_joins(N.keep_one(docs))
        assert {what for what, _ in plans} == {"shingles", "links"} and not any(shuffled_joins(df) for _, df in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_classes_of_a_bridge_that_only_the_exact_part_finds(spark):
    """Neighbours in a row of texts are similar, others are not: the classes come from links between roots of earlier links."""
    words = [f"w{k}" for k in range(400)]
    row = [" ".join(words[12 * k : 12 * k + 150]) for k in range(20)]
    order = np.random.default_rng(4).permutation(20)
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(order, row, strict=True)] + [(30 + k, f"{row[10]} v{k}") for k in range(6)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert found == brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert N.keep_one(docs).count() == len(set(found.values()))


def test_a_tile_links_roots_unless_each_pair_is_asked_for():
    texts = pa.array([np.arange(100, dtype=np.uint64).tobytes()] * 3, pa.binary())
    tile = pa.table({"side": [0, 1, 1], "id": [7, 8, 9], "root": [3, 2, 2], "items": texts, "counts": pa.array([b""] * 3, pa.binary())})
    assert N._tile_links(tile, 0.8).to_pylist() == [{"a": 2, "b": 3}]
    assert N._tile_links(tile, 0.8, each=True).to_pylist() == [{"a": 7, "b": 8}, {"a": 7, "b": 9}]


def test_rows_that_share_an_id_but_not_their_text_stay(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    near = a.replace("w30", "x30")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, near, 4), (2, b, 5), (None, a, 6), (4, None, 7), (4, "", 8), (5, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = sorted((r.doc_id or 0, r.text or "") for r in N.keep_one(docs, threshold=0.8).collect())
    assert kept == sorted([(1, a), (2, b), (0, a), (4, ""), (4, "")])
    found = N.classes(docs).where("doc_id = 2").select("class_id", "class_no").distinct().collect()
    assert {r.class_id for r in found} == {1, 2} and len(found) == 2


def test_texts_of_equal_polynomial_hashes_are_told_apart(spark):
    """Such a pair collides under any polynomial modulo 2**64."""
    one = bytes(97 + bin(i).count("1") % 2 for i in range(1024)).decode()
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_one_of_each_class_stays(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = N.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted([*set(ids), 3])
    assert 6 in ids and 7 not in ids and 8 not in ids and ids.count(3) == 2  # two texts have the id 3
    assert sum(r.doc_id is None for r in kept) == 2
