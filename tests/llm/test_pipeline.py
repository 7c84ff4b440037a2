"""The pipeline's stages against plain versions, each on what its predecessor kept."""

from __future__ import annotations

import collections
import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ridelake.llm import bpe, contamination, lines, quality
from tests.conftest import plan_of
from tests.llm.test_text_operators import plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good

    spread = collections.defaultdict(set)
    for r in kept.collect():
        for line in r.text.split("\n"):
            spread[line.strip(" ")].add(r.source)
    bad = {x for x, sites in spread.items() if x and len(sites) >= lines.MIN_SITES}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad) for r in kept.collect()}
    kept = stages["line_dedup"](spark, kept, SF)
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want

    prints = {i: plain_fingerprint(t) for i, t in want.items()}
    left, first = sorted(prints), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            x = todo.pop()
            group.add(x)
            todo += [y for y in left if y not in group and y not in todo and (prints[x] ^ prints[y]).bit_count() <= 2]
        first.append(min(group))
        left = [y for y in left if y not in group]
    kept = stages["simhash_near_dedup"](spark, kept, SF)
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == {i: want[i] for i in first}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = contamination.Index(items)
    clean = {i: want[i] for i in first if all(c < contamination.COVERAGE for c, _ in index.matches(want[i]))}
    kept = stages["decontamination"](spark, kept, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(clean)

    ranks = bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: encoding.encode_ordinary(t) for i, t in clean.items()}
    rows = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(clean[i].encode()).hexdigest()) for i, x in ids.items()]
    found = sorted(tuple(r) for r in stages["byte_bpe"](spark, kept, SF).collect())
    assert found == sorted(rows)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == found


ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, __fp string, m int"


@pytest.mark.parametrize("rows", [
    [(1, "alpha beta gamma delta.", None, None, None), (2, None, "en", "s", 4), (3, "", "en", "s", 0), (None, "some other text, here now", "de", "t", 9), (1, "alpha beta gamma delta.", None, None, None)],
    [],
])
def test_odd_documents(spark, tmp_path, rows):
    """Nulls everywhere, repeated rows, columns of clashing names, no labels, and no rows at all."""
    docs = spark.createDataFrame([(*r, "x", 0.1, "y", 3) for r in rows], ODD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    # Without labels nothing is rejected; the null and the empty text are copies, and so are the repeated rows.
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows if r[0] != 3}
    assert {r.doc_id: r.decoded_sha256 for r in found.collect()} == want and found.count() == len(want)


def test_quality_fit_keeps_no_second_copy_of_its_sample():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(quality.SIZE, 4000, replace=False)).astype(np.int32) for _ in range(500)]
    places, starts = np.concatenate(rows), np.arange(0, 500 * 4000 + 1, 4000)
    tracemalloc.start()
    quality.fit(places, starts, (np.arange(500) % 3 == 0).astype(float))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < places.nbytes


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 49_999, 2**32 - 1]])
def test_token_ids_are_held_as_numbers_of_four_bytes(ids):
    assert np.frombuffer(bpe._code(ids), "<u4").tolist() == ids


def test_ids_are_put_together_and_decoded_in_one_worker(spark):
    """Two Python steps in a stage are two workers for each core, which the executor's memory has to hold at once."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (None, "\u00e9 \u4e2d")], "doc_id long, text string")
    found = bpe.round_trip(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    last = plan_of(found).split("== Physical Plan ==")[1].split("Exchange")[0]
    assert "FlatMapCoGroupsInArrow" in last and "EvalPython" not in last
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in found.collect()} == want
