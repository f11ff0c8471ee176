import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import common
from folio.llm import textkernel as K
from folio.llm.common import components, id_bounds, with_block


def test_components_of_stars_chains_and_loops(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500), (501, 502), (502, 501)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_no_more_steps_than_needed(spark, monkeypatch):
    """Every step's plans and broadcasts stay in the driver's memory for a while; stars need none, and nothing follows the last."""
    steps, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, what="step": (steps.append(what), write(df, what))[1])
    edges = [(1, i) for i in range(2, 30)] + [(50, 40), (40, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 30)} | {40: 40, 50: 40, 60: 40} and steps == ["edges"]
    steps.clear()
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (29, 40)], "a long, b long")).collect()}
    assert set(got.values()) == {1} and set(got) == {*range(1, 30), 40, 50, 60} and steps == ["edges", *["least", "edges"] * 2]


def test_id_blocks_ascend(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)] + [(None,)], "doc_id long")
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.block) for r in with_block(df, id_bounds(df)).collect()))
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len({b for _, b in rows}) > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t.", max_size=30)), max_size=8))
def test_words_and_shingles(texts):
    data, offsets = K.views(pa.array(texts, pa.string()))
    hashes, starts, ends, at = K.word_hashes(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    got = [[bytes(data[starts[i] : ends[i]]).decode() for i in range(at[k], at[k + 1])] for k in range(len(texts))]
    assert got == want
    seen = {}
    for i in range(len(hashes)):
        assert seen.setdefault(bytes(data[starts[i] : ends[i]]), hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)
    runs, run_at = K.shingles(hashes, at, 3)
    assert np.diff(run_at).tolist() == [max(1, len(w) - 2) if w else 0 for w in want]
