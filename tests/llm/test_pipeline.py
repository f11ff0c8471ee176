"""The pipeline's stages against brute force, each on what the one before kept."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from test_fingerprints_and_dedup import brute_classes
from test_tokens_store_packing import NAMES, ids_of

import corpus_pipeline
from folio.llm import langid
from folio.llm.common import written
from folio.llm.mixing import mix_sql

PLANTED = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")


def test_stages_against_brute_force(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    step = written(stages["language_id"](spark, docs, data))
    kept = {r.doc_id for r in step.collect()}
    texts_ = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    best, score, rejected = langid.judge(langid.fit(docs.where(langid.fold(3) != 1)), pa.array(texts_.values(), pa.string()))
    assert kept == {i for i, r in zip(texts_, rejected.tolist(), strict=True) if not r}
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert clean & set(texts_) <= kept

    texts = {r.doc_id: r.text for r in step.collect()}
    step = written(stages["near_dedup"](spark, step, data))
    classes = brute_classes(texts)
    assert sorted(r.doc_id for r in step.collect()) == sorted(set(classes.values()))

    texts = {r.doc_id: r.text for r in step.collect()}
    step = written(stages["secret_scan"](spark, step, data))
    got = {r.doc_id: (r.text, r.n_chars) for r in step.collect()}
    want = {i: PLANTED.sub("[SECRET]", t) for i, t in texts.items()}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    con = duckdb.connect()
    table = step.toArrow()
    con.register("documents", table)
    sampled = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mix_sql(share=0.7)}) WHERE sampled").fetchall()}
    step = written(stages["mixing"](spark, step, data))
    assert {r.doc_id for r in step.collect()} == sampled
    assert step.schema.names == docs.schema.names

    texts = {r.doc_id: r.text for r in step.collect()}
    pieces = stages["packing"](spark, step, data).toPandas()
    ids = dict(zip(texts, ids_of(texts.values(), NAMES[1]), strict=True))
    assert set(pieces.doc_id) == set(texts)
    for i, g in pieces.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() == len(ids[i])
        assert all(zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in g.itertuples())
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
