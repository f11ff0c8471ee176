import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bloom_lm, langid, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_held_out_accuracy_and_scores(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas()
    got = langid.op5_language_id(spark, d).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def test_odd_texts(spark, odd):
    rows = langid.op5_language_id(spark, odd).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {0, 1, 2, 13} <= und and not {3, 4, 5, 6, 11} & und
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (6, 7)}) == 1


FOREIGN = [
    "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset ja se on yksi maan kansalliskielistä", "Русский язык является одним из самых распространённых языков мира и государственным языком",
    "xkqz vbrt plwm zzkj qwrt hjkl vbnm trdf gkkp wqzx bdfg hjkp qxzv wrtp lkjh mnbv", "Türkçe, Türk dilleri içinde en çok konuşulan dildir ve Türkiye'nin resmî dilidir", "ghfjdk sltyru qpwoei mznxbc vlakdj fhgtyr uwieop zmxncb vqlwke jrhtyg",
]


def test_foreign_and_random_texts_are_rejected_and_mixed_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold(3) != 1))
    assert 1e-3 < model.temperature < 100 and 0.3 < model.least_known < 0.97
    assert langid.judge(model, pa.array(FOREIGN))[2].all()
    by_lang = docs.where("text is not null and length(text) > 400").where(langid.fold(3) == 1).toPandas().groupby("lang").text.first()
    both = [a[:400] + " " + b[:400] for a, b in zip(by_lang, by_lang[1:], strict=False)]
    assert len(both) == 3 and not langid.judge(model, pa.array([*by_lang, *both]))[2].any()


def test_prediction_against_brute_force(spark):
    """Sums over all features of whole texts, one by one, in plain Python; long texts are read in parts of few bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold(3) != 1), per_language=20)
    texts = [*(r.text for r in docs.limit(30).collect() if r.text), "ab " * 3000 + "ünd", "x" * 5000, "", "12 ."]
    data, offsets = langid.K.views(pa.array(texts))
    logits, share, many = langid.evidence(model, data, offsets, part=1000)
    for i, t in enumerate(texts[:-3]):
        shown = " " + "".join(chr(langid.SHOWN[b]) for b in t.encode()) + " "
        want = [("3", shown[k : k + 3]) for k in range(len(shown) - 2) if shown[k + 1] != " "] + [("4", shown[k : k + 4]) for k in range(len(shown) - 3) if " " not in shown[k + 1 : k + 3]] + [("w", w) for w in shown.split()]
        ids, _ = langid.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model.known_bits)
        assert len(ids) == len(want) == many[i]
        assert np.allclose(logits[i], np.mean([model.scores[k >> (model.known_bits - model.bits)] for k in ids.tolist()], axis=0), atol=1e-4)
        assert share[i] == pytest.approx(np.mean(np.unpackbits(model.known)[ids]))
    assert langid.have_letters(pa.array(["é", "12 –", "", None, "日本", "١٢"]), *langid.K.views(pa.array(["é", "12 –", "", None, "日本", "١٢"]))).tolist() == [True, False, False, False, True, False]


def test_temperature_lies_inside_its_grid():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 500)
    for scale in (0.1, 1, 30):
        t = langid.fit_temperature(np.eye(3)[truth] * scale + rng.normal(0, 0.05 * scale, (500, 3)), truth)
        assert 2e-3 < t < 50


def test_features_see_words_and_case_alike():
    def of(*texts):
        raw = [t.encode() for t in texts]
        ids, at = langid.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), 16)
        return [sorted(ids[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]

    a, b, c, none = of("The cat", "the, CAT!", "other words", "12 .")
    assert a == b and a != c and none == []


def test_too_many_languages_is_an_error(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="most_languages"):
        langid.fit(docs, most_languages=4)


def brute_ranks(edges, good, bad, steps=300, damping=0.85):
    """The fixed point, dangling rank going to the seeds."""
    out, into = collections.Counter(), collections.Counter()
    for (s, d), w in edges.items():
        out[s] += w
        into[d] += w
    t, u = collections.Counter(good), collections.Counter(bad)
    for _ in range(steps):
        nt, nu = collections.Counter(), collections.Counter()
        for (s, d), w in edges.items():
            nt[d] += damping * t[s] * w / out[s]
            nu[s] += damping * u[d] * w / into[d]
        lost_t, lost_u = 1 - sum(nt.values()), 1 - sum(nu.values())
        for h in good:
            nt[h] += lost_t * good[h]
            nu[h] += lost_u * bad[h]
        t, u = nt, nu
    return t, u


def test_ranks_against_brute_force(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 3.0, ("d", "c"): 1.0, ("d", "e"): 1.0, ("e", "d"): 2.0, ("c", "end"): 1.0}
    good, bad = {"a": 0.75, "b": 0.25, "c": 0.0, "d": 0.0, "e": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0}
    seeds = spark.createDataFrame([(h, good[h], bad[h]) for h in good], "host string, good double, bad double")
    got = url_filter.spread(spark.createDataFrame([(s, d, w) for (s, d), w in edges.items()], "src string, dst string, weight double"), seeds, tolerance=0.01).collect()
    trust, distrust = brute_ranks(edges, good, bad)
    assert all(abs(r.trust - trust[r.host]) < 0.03 and abs(r.distrust - distrust[r.host]) < 0.03 for r in got)
    assert sum(r.trust for r in got) == pytest.approx(1) and sum(r.distrust for r in got) == pytest.approx(1)
    with pytest.raises(RuntimeError, match="still change"):
        url_filter.spread(spark.createDataFrame([(s, d, w) for (s, d), w in edges.items()], "src string, dst string, weight double"), seeds, steps=2)


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(i, f"http://bad{i % 3}.net/p{i}", "") for i in range(9)]
    pages += [(100 + i, f"http://farm.test/{i}", link("bad0.net", "bad1.net", "bad2.net")) for i in range(5)] + [(200 + i, f"http://good{i}.test/", link("fine.org")) for i in range(12)] + [(300 + i, f"http://fine.org/fr/{i}", link("good1.test")) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judged(df, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got[100].verdict == "block" and got[100].rule is None and got[100].host_distrust > 0
    assert all(got[200 + i].verdict == "allow" for i in range(12)) and got[201].host_trust > 0
    assert got[0].rule == "net/" and got[0].verdict == "block" and got[300].rule == "org/fr/" and got[300].verdict == "allow"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("http://example.net/en", "example.net", "/en", "net/"), ("http://x.net", "x.net", "", None), ("ftp://net/", "net", "/", "net/"),
        ("http://notnet/", "notnet", "/", None), ("http://www.example.com/de/?q", "www.example.com", "/de/", "example.com/de/"), ("http://my-example.com/de/", "my-example.com", "/de/", None), ("http://a.org/fr/x://y", "a.org", "/fr/x://y", "org/fr/"),
        (None, "", "", None), ("nothing", "", "", None), ("://", "", "", None), ("http://É.NET/", "É.net", "/", "net/"), ("a?b://c.net/#", "c.net", "/", "net/"),
    ],
)
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    h, p = url_filter.host_and_path(F.col("url"))
    fit = url_filter.host_rules(df.select(h.alias("host")), url_filter.rule_table(spark, url_filter.RULES))
    row = df.select(h.alias("host"), p.alias("path")).join(fit, "host", "left").select("host", "path", url_filter.best_rule(F.col("rules"), F.col("path"))["rule"].alias("rule")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def brute_lm(rows):
    words = {k: [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for k, t in rows.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    counts = collections.Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {k: (held[k], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in words.items()}


def brute_pairs(rows, strength=256.0, base=1.5):
    """log10 probabilities with plain counters, quantised by comparing with powers, and without any filter."""
    words = {k: [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for k, t in rows.items()}
    train = [ws for k, ws in words.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    ones, twos = collections.Counter(w for ws in train for w in ws), collections.Counter(p for ws in train for p in zip([0, *ws], ws, strict=False))
    n, v = sum(ones.values()), len(ones)

    def span(c):
        """The least and greatest count of c's level."""
        if not c:
            return 0, 0
        level = next(q for q in range(1, 99) if c < base**q - 1e-9)
        same = [x for x in range(1, 2 * c + 3) if base ** (level - 1) - 1e-9 <= x < base**level - 1e-9]
        return same[0], same[-1]

    spans = {c: span(c) for c in {0, *ones.values(), *twos.values()}}

    def p(w, before):
        up = spans[ones[None if before == 0 else before]][1]
        return (min(spans[twos[before, w]][0], up) + strength * (spans[ones[w]][0] + 1) / (n + v + 1)) / (up + strength)

    return {k: sum(math.log10(p(w, b)) for b, w in zip([0, *ws], ws, strict=False)) for k, ws in words.items()}, p, ones


@pytest.mark.parametrize("head", [1 << 19, 200, 0])
def test_base_scores_against_brute_force(spark, data, monkeypatch, head):
    fit = bloom_lm.fit
    monkeypatch.setattr(bloom_lm, "fit", lambda docs: fit(docs, head=head))
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bloom_lm.op8_bloom_lm(spark, data).collect()}
    for k, (held, n, known, total, base) in brute_lm(rows).items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_against_brute_force_in_one_pass_and_in_many(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want, p, ones = brute_pairs({r.doc_id: r.text for r in docs.collect()})
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = []
    for most, head in ((1 << 27, 1 << 19), (20_000, 50)):
        model = bloom_lm.fit(train, most_bytes=most, head=head)
        assert (len(model.groups) > 3) == (most == 20_000) and all(len(model.filter(g).data) <= most for g in model.groups)
        got.append({r.doc_id: r for r in bloom_lm.scores(docs, model).collect()})
    for k, r in got[0].items():
        assert r.score == pytest.approx(got[1][k].score) and r.base_score == pytest.approx(got[1][k].base_score) and (r.n_tokens, r.n_known) == (got[1][k].n_tokens, got[1][k].n_known)
        assert r.score < 0 and abs(r.score - want[k]) < 0.03 * abs(want[k]) + 1  # false positives of the filter
    # a distribution: over all known words and one unknown, probabilities sum to at most 1 and nearly to 1
    for before in [*list(ones)[:20], 0, "never seen"]:
        total = sum(p(w, before) for w in [*ones, "unknown word"])
        assert 0.6 < total <= 1 + 1e-9


def test_empty_training_texts_give_no_probability_above_one(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(12)] + [(50, "a b")], "doc_id long, text string")
    model = bloom_lm.fit(docs.where("doc_id < 50"))
    rows = {r.doc_id: r for r in bloom_lm.scores(docs, model).collect()}
    assert all(r.score <= 0 for r in rows.values()) and rows[50].score < rows[0].score
    nothing = bloom_lm.scores(docs, bloom_lm.fit(docs.where("false"))).collect()
    assert len(nothing) == 13 and all(r.n_known == 0 and r.score <= 0 for r in nothing)


def test_filter_levels_are_close_and_never_low():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    counts = np.floor(rng.pareto(1.0, 20000) + 1).astype(np.int64)
    quantised = bloom_lm.Levels(1.5)
    levels = quantised.of(counts)
    assert ((quantised.least(levels) <= counts) & (counts <= quantised.greatest(levels))).all()
    f = bloom_lm.LogFilter.of(64, bloom_lm.built(grams, levels, 64))
    assert len(f.data) <= levels.sum() * bloom_lm.ITEM_BITS / 8 + 64 * 8
    found = f.levels(grams)
    assert (found >= levels).all() and (found == levels).mean() > 0.97  # one-sided error
    assert (f.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.03
    half = bloom_lm.LogFilter.of(64, {k: v for k, v in bloom_lm.built(grams, levels, 64).items() if k < 32})
    assert (half.holds(grams) == (half.segment(grams) < 32)).all()


def test_the_sample_is_held_as_it_came(spark, data, monkeypatch):
    held, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda rows, *a, **k: held.extend(rows) or train(rows, *a, **k))
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"))
    assert held and all(x.itemsize == 4 for f, c, _ in held for x in (f, c))
    wide = [(f.astype(np.int64), c.astype(float), y) for f, c, y in held]
    assert np.array_equal(train(wide, model.languages, model.bits, model.known_bits).scores, model.scores)


def test_the_sample_comes_as_arrow_batches(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.columns) or collect(df))
    assert langid.fit(docs, per_language=20) is not None
    assert collected == [["lang", "count"]]
