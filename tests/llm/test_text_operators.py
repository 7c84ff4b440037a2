"""Each operator against a plain version of itself, on small tables with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

from ridelake.llm import bpe, contamination, embeddings, golay, lines, quality, secrets, simhash, suffixes, toxicity, warc
from ridelake.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "en", sources[k] if sources else f"s{k % 3}", 1, 7, 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    random.seed(3)
    word = lambda: "".join(random.choice("abcé") for _ in range(random.randint(1, 4)))
    base = [" ".join(word() for _ in range(random.randint(10, 60))) for _ in range(6)]
    rows = [(None, None), (None, base[0]), (1, ""), (2, "aaaa" * 40), (3, "ab" * 60), (3, "ab" * 60), (9, "\n \t"), (8, "w " * 3000)]
    for i in range(50):
        text = ""
        for _ in range(random.randint(1, 4)):
            part = random.choice(base)
            start = random.randint(0, len(part) // 2)
            text += part[start : start + random.randint(10, len(part))] if random.random() < 0.5 else " ".join(word() for _ in range(9))
        rows.append((10 + i, text))
    return rows


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- suffixes


def removed(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,block,size", [(40, 12, 8, 1 << 19), (64, 16, 16, 100)])
def test_repeated_bytes_go(spark, length, gram, block, size):
    rows = odd_texts()
    assert tuples(suffixes.dedup(docs_of(spark, rows), length, gram, block, size)) == removed(rows, length)


def test_many_copies_beside_a_near_copy(spark):
    random.seed(9)
    text = "".join(random.choice("abcdefgh ") for _ in range(300))
    rows = [(i, text) for i in range(200)] + [(500, text[:150] + "#" + text[150:]), (501, text[20:200] + "!")]
    docs = docs_of(spark, rows)
    assert tuples(suffixes.dedup(docs, 40, 12, 8, 64)) == removed(rows, 40)
    # Spans of copies are one set of the text's own runs, not one for each copy.
    single = suffixes.dedup(docs_of(spark, rows[-3:]), 40, 12, 8, 64).filter("doc_id = 501").first()
    assert single.n_removed == 180


def test_suffixes_of_nothing(spark):
    assert suffixes.dedup(docs_of(spark, [])).count() == 0


# --- fingerprints


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((counts[b] * 2 > len(shingles)) << b for b in range(64))


def grouped(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("crowd", [256, 2])
def test_near_copies_by_fingerprint(spark, crowd):
    random.seed(5)
    text = " ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(400))
    rows = odd_texts()[:30]
    for i in range(40):
        words = text.split()
        words[random.randrange(len(words))] = random.choice("xyz")
        rows.append((100 + i, " ".join(words)))
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = grouped(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    first = {}
    for (i, _), g in zip(rows, groups):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", first[g]) for (i, _), p, g in zip(rows, prints, groups)), key=str)
    docs = docs_of(spark, rows)
    assert tuples(simhash.near_duplicates(docs, crowd)) == want
    kept = simhash.one_of_each(docs, crowd)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(groups))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << golay.BITS, 300)
    for flips in ((), (3,), (0, 22), (7, 8)):
        other = words ^ sum(1 << f for f in flips)
        keys = [collections.defaultdict(set), collections.defaultdict(set)]
        for out, w in zip(keys, (words, other)):
            for place, word in zip(*golay.near(w)):
                out[int(place)].add(int(word))
        assert all(keys[0][i] & keys[1][i] for i in range(len(words)))


def test_components_of_a_chain_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (1, 0)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors


@pytest.mark.parametrize("blocks,grid,chunk", [(4, 2, 4096), (4, 2, 64), (3, 1, 5)])
def test_near_vectors(spark, blocks, grid, chunk):
    rng = np.random.default_rng(0)
    centres, rows = rng.standard_normal((12, 16)), []
    for i in range(150):
        rows.append((i, (centres[rng.integers(12)] + rng.standard_normal(16) * 0.22).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(9)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, rows[0][1], None), (704, [1.0] + [None] * 15, 1)]
    rows += [(705, [], 0), (706, [1.0, 2.0], 0), (707, [1.0, 2.0], 0), (None, rows[0][1], rows[0][2]), (3, rows[3][1], rows[3][2])]
    units = []
    for i, v, label in rows:
        valid = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if valid else None)

    def linked(a, b):
        if units[a] is None or units[b] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
            return False
        return (units[a] * units[b]).sum() >= 0.93

    n = [sum(linked(a, b) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    groups, first = grouped(len(rows), linked), {}
    for (i, *_), g in zip(rows, groups):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    want = sorted(((i, k, first[g], i == first[g]) for (i, *_), k, g in zip(rows, n, groups)), key=str)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    assert tuples(embeddings.near_duplicates(table, blocks=blocks, grid=grid, chunk=chunk)) == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# --- tokens


def test_vectors_of_extreme_length_keep_their_links(spark):
    rows = [(1, [1e200, 2e200, 1e200], 1), (2, [1e200, 2e200, 1.01e200], 1), (3, [1e-200, 2e-200, 1e-200], 1), (4, [1.0, 2.0, 1.0], 1), (5, [5e-324, 0.0, 0.0], 1)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {i: (3, 1) for i in (1, 2, 3, 4)} | {5: (0, 5)}


def test_tokens_are_those_of_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(500, "I'll  say   <|endoftext|> x\x00y \U0001f600 12³ 　\n\n  end "), (501, "z" * 5000)]
    rows = odd_texts() + odd
    want = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    docs = docs_of(spark, rows)
    for chunk in (bpe.CHUNK_CHARS, 300):
        assert tuples(bpe.round_trip(docs, path, public_tokenizers.PATTERN, chunk)) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(docs_of(spark, [(1, ""), (2, None)]), path, public_tokenizers.PATTERN).count() == 2


# --- lines


def test_boilerplate_lines_go(spark):
    rows, sources = [], []
    for i in range(40):
        rows.append((i % 35, f"own {i}\n  everywhere \n\nhere and there {i % 12}\nin nine" if i % 4 else f"everywhere\nown {i}"))
        sources.append(f"site{i % 12}")
    rows += [(50, None), (51, ""), (52, "everywhere\neverywhere"), (None, "in nine\nmine")]
    sources += ["site1", None, None, "site1"]
    docs = docs_of(spark, rows, sources)
    for least in (2, 9, 12):
        spread = collections.defaultdict(set)
        for (_, text), site in zip(rows, sources):
            for line in (text or "").split("\n"):
                if site is not None and line.strip(" "):
                    spread[line.strip(" ")].add(site)
        bad = {line for line, sites in spread.items() if len(sites) >= least}
        want = []
        for i, text in rows:
            parts = (text or "").split("\n")
            kept = [x for x in parts if x.strip(" ") not in bad]
            want.append((i, sum(bool(x.strip(" ")) for x in parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        assert tuples(lines.line_dedup(docs, least)) == sorted(want, key=str)
    cleaned = lines.without_boilerplate(docs, 9)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert cleaned.filter("text is null").count() == 1
    assert lines.line_dedup(docs.limit(0)).count() == 0


# --- benchmark passages


def plain_tiling(doc, item, run):
    free_d, free_i = [True] * len(doc), [True] * len(item)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while i + n < len(item) and p + n < len(doc) and item[i + n] == doc[p + n] and free_i[i + n] and free_d[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, p)
        n, i, p = best
        if n < run:
            return free_i.count(False) / len(item)
        free_i[i : i + n] = [False] * n
        free_d[p : p + n] = [False] * n


def test_reordered_passages_are_found(spark):
    random.seed(2)
    word = lambda: random.choice("abcdefgh") + random.choice("xyz")
    items = [(i, " ".join(word() for _ in range(random.randint(5, 30)))) for i in range(12)] + [(20, None), (None, "a b c d e f"), (21, "too short")]
    rows = [*odd_texts()[:8], (90, "too short"), (91, "not TOO. Short?"), (92, "short too")]
    for k in range(30):
        words = items[k % 12][1].split()
        cut = random.randint(0, len(words))
        parts = [words[cut:], [word() for _ in range(5)], words[:cut]]
        if k % 3 == 0:
            parts[0] = parts[0][:-3]
        rows.append((100 + k, " ".join(sum(parts, [])).upper() + "."))
    want = []
    for i, text in rows:
        doc = contamination.tokens(text)
        shares = [(plain_tiling(doc, contamination.tokens(t), min(5, len(t.split()))), -j) for j, t in items if j is not None and t]
        share, j = max(shares)
        want.append((i, round(share, 9), -j if share else None, sum(s >= 0.8 for s, _ in shares), any(s >= 0.8 for s, _ in shares)))
    docs, benchmark = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for chars in (contamination.BLOCK_CHARS, 200):
        found = contamination.contaminated(docs, benchmark, block_chars=chars).withColumn("coverage", F.round("coverage", 9))
        assert tuples(found) == sorted(want, key=str)
    assert contamination.clean(docs, benchmark).count() == sum(not w[4] for w in want)
    assert contamination.contaminated(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert contamination.contaminated(docs.limit(0), benchmark).count() == 0


def test_repeated_words_are_tiled_in_time():
    index = contamination.Index([(1, "la " * 60), (2, "la le " * 400), (3, " ".join(f"w{i}" for i in range(20_000)))])
    start = time.perf_counter()
    assert dict((i, c) for c, i in index.matches("la " * 20_000)) == {1: 1.0}
    assert dict((i, c) for c, i in index.matches("la le " * 2_000)) == {2: 1.0}
    assert dict((i, c) for c, i in index.matches(" ".join(f"w{i}" for i in range(19_999, -1, -1)))) == {}
    assert time.perf_counter() - start < 20
    rng = random.Random(9)
    for _ in range(60):
        item, doc = ([rng.choice("ab") for _ in range(rng.randrange(1, 25))] for _ in range(2))
        run = min(3, len(item))
        ids = [np.array([ord(c) for c in x]) for x in (doc, item)]
        assert contamination.tiled(*ids, run) == plain_tiling(doc, item, run)


def test_scripts_without_blanks():
    index = contamination.Index([(1, "今天天气很好我们去公园散步"), (2, "ABC"), (3, "ภาษาไทย")])
    assert contamination.tokens("ab今天c") == ["ab".encode(), "今".encode(), "天".encode(), b"c"]
    assert dict((i, c) for c, i in index.matches("他说今天天气很好我们去公园散步了, abc?")) == {1: 1.0, 2: 1.0}
    assert index.matches("天今") == [] and dict((i, c) for c, i in index.matches("xภาษาไทยx")) == {3: 1.0}


# --- archives


def test_pages_survive_the_archive(spark, tmp_path):
    random.seed(4)
    pages = [(i, f"http://x/{i} é", "<p>" + random.choice("abc") * random.choice([5, 200, 3000])) for i in range(60)]
    pages += [(70, None, None), (71, "u", ""), (None, "v", "n" * 300), (None, "v", "n" * 300), (5, pages[5][1], pages[5][2]), (72, "w\r\nx", "\r\n\r\n" * 50)]
    first, want, seen = {}, [], set()
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 1 << 60), i)
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        head = first.get(html or "")
        revisit = i is not None and len(data) >= 100 and (i != head or (i, data) in seen)
        seen.add((i, data))
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int")
    sizes = {"shard_bytes": 4000, "roll_bytes": 300}
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    for folder in folders:
        found = warc.archived(table, folder, **sizes)
        assert tuples(found.drop("url")) == sorted(want, key=str)
        assert sorted(str(r.url) for r in found.collect()) == sorted(str(u) for _, u, _ in pages)
    files = [{p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab"]
    assert files[0] == files[1] and len(files[0]) > 3
    assert not list(tmp_path.glob("*/temporary-*"))
    assert warc.archived(table.limit(0)).count() == 0


# --- classifiers


def test_quality_of_unseen_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs.unionByName(docs_of(spark, [(None, None), (-1, "")]).select(*docs.columns)), labels)
    assert found.count() == docs.count() + 2 and found.filter("score between 0 and 1").count() == docs.count() + 2
    unseen = found.filter("held_out").join(labels, "doc_id")
    assert unseen.filter("predicted != quality").count() <= 0.05 * unseen.count()
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert tuples(quality.classify(docs, flipped)) == tuples(quality.classify(docs, labels))
    assert quality.classify(docs, labels.limit(0)).filter("score = 0.5").count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_toxicity_of_unseen_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs_of(spark, [(None, None), (-1, "")]).select(*docs.columns))
    found = toxicity.classify(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    unseen = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (unseen[unseen.toxic == 0].predicted == 0).mean() >= 0.99
    assert (unseen[unseen.toxic == 1].predicted == 1).mean() >= 0.7
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_reads_no_held_out_label(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert flipped.exceptAll(labels).count() > 0
    assert tuples(toxicity.classify(docs, flipped)) == tuples(toxicity.classify(docs, labels))
    # Repeated rows and further columns, of names the operator uses itself, change no other row's score by much.
    wide = docs.withColumns({"label": F.lit("x"), "target": F.lit(1), "key": F.lit("k"), "votes": F.lit(7), "score": F.lit(9.0)})
    twice = wide.unionByName(wide.filter("doc_id < 5"))
    assert toxicity.classify(twice, labels).count() == docs.count() + docs.filter("doc_id < 5").count()


def test_correlated_voters_count_once():
    rng = np.random.default_rng(4)
    toxic = rng.random(20_000) < 0.3
    fired = np.zeros((len(toxic), 5), bool)
    fired[:, 0] = rng.random(len(toxic)) < np.where(toxic, 0.6, 0.05)
    fired[:, 1] = fired[:, 2] = fired[:, 0]  # two copies of one voter
    fired[:, 3] = rng.random(len(toxic)) < np.where(toxic, 0.5, 0.02)
    fired[:, 4] = ~fired[:, :4].any(axis=1)
    own, size = np.stack([fired[toxic == y].sum(axis=0) for y in (0, 1)]), np.array([(~toxic).sum(), toxic.sum()])
    correlation = toxicity._correlation(fired[toxic].T.astype(float) @ fired[toxic], size[1])
    assert correlation[0, 1] == pytest.approx(1) and correlation[0, 3] == 0 and not correlation[4].any()
    model = toxicity.LabelModel(toxicity._rates(own, size), 0.3, correlation)
    assert model.weight[:3] == pytest.approx(1 / 3) and model.weight[3] == 1
    # Three copies say as much as one voter says alone.
    one = toxicity.LabelModel(toxicity._rates(own[:, [0, 3, 4]], size), 0.3)
    assert model.posterior(np.array([0b111, 0b1111])) == pytest.approx(one.posterior(np.array([0b1, 0b11])), abs=1e-3)


def test_secrets_are_told_from_long_words(spark):
    random.seed(6)
    rows = [(None, None), (1, ""), (2, "plain words only")]
    for i in range(90):
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((10 + i, f'said token = "{digest}" and thentionerandtheing{"s" * (i % 4)} {4000000000000000 + i}'))
    found = secrets.scan(docs_of(spark, rows)).toPandas()
    assert len(found) == 270
    unseen = found[found.held_out]
    assert len(unseen) and ((unseen.n_chars == 40) == (unseen.predicted == 1)).all()
    assert secrets.scan(docs_of(spark, rows).limit(0)).count() == 0
