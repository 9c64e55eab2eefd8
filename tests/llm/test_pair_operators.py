"""Near duplicates, embeddings, decontamination, components and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import blocks, components, decontaminate, jaccard_join, lattice, queries, words

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, did long, row string, class_id string, node string, bucket string, `a.b` string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "r", "c", "n", "b", "dot") for i, t in zip(ids, texts)], CLASHING)


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def linked_classes(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_copies():
    """Sentences of invented words, with copies changed in more and more places."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [None, "", "...", "...", "one two", "one two", "One, TWO!", "one"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5):
            copy = list(base)
            for place in rng.sample(range(len(copy)), edits):
                copy[place] = word()
            texts.append(" ".join(copy))
    return texts


def jaccard_brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := tokens(t)) else set() for t in texts]
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(texts)), 2)
        if (texts[a] or "") == (texts[b] or "") or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    ]
    return links, linked_classes(range(len(texts)), links)


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    # Small blocks, so that groups span several of them.
    texts = near_copies()
    links, label = jaccard_brute(texts)
    for size in (256, 3):
        monkeypatch.setattr(blocks, "BLOCK", size)
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", size)
        monkeypatch.setattr(blocks.block_pairs, "__defaults__", (size,))
        got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, texts)).collect()}
        for i in range(len(texts)):
            assert (got[i].class_id, got[i].n_links) == (label[i], sum(i in link for link in links)), texts[i]
            assert got[i].kept == (label[i] == i)


def test_jaccard_join_of_repeated_missing_ids_and_nothing(spark):
    text = "some words that are long enough to have shingles of five words"
    docs = frame(spark, [text, text, text + " more", "quite another text of at least five words", None], [3, 3, None, None, None])
    rows = jaccard_join.jaccard_join(docs).collect()
    assert [r.class_id for r in rows if r.text and r.text.startswith("some")] == [3, 3, 3]
    assert sorted(r.n_links for r in rows) == [0, 0, 2, 2, 2]
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    limits = jaccard_join.fewest_matches(0.8, 1e-6)
    assert [n for n, _ in limits] == list(range(16, 113, 16))
    assert all(0 < m < 0.8 * n for n, m in limits)
    rng = np.random.default_rng(0)
    for n, m in limits:
        assert (rng.binomial(n, 0.8, 100_000) < m).mean() < 1e-4 and (rng.binomial(n, 0.2, 1000) < m).mean() > 0.5


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == linked_classes({x for link in links for x in link}, links)


def test_word_hashes_do_not_depend_on_rows_or_chunks():
    import pyarrow as pa

    texts = ["Ab cd", "", "ab,CD é", " ", "x", "ab cd"]
    hashes, counts = words.Hasher().words(pa.array(texts))
    assert counts.tolist() == [2, 0, 3, 0, 1, 2]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[3] == hashes[7] and len(set(hashes.tolist())) == 4
    each = [words.Hasher().words(pa.array([t]))[0] for t in texts]
    assert np.array_equal(np.concatenate(each), hashes)
    alone, n = words.shingles(hashes, counts, 5)
    assert n.tolist() == [1, 0, 1, 0, 1, 1] and alone[0] == alone[3]


def near_vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k, spread in enumerate((0.02, 0.05, 0.06, 0.07, 0.3)):
        rows += [(100 * (k + 1) + i, (v + spread * np.linalg.norm(v) * rng.normal(size=24) / 24**0.5 * 4).tolist()) for i, v in enumerate(base)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, (3 * base[0]).tolist()), (903, None), (904, []), (905, [0.0] * 24), (906, [float("nan")] * 24)]
    rows += [(907, [None] + [1.0] * 23), (908, [float("inf")] + [1.0] * 23), (909, [1.0] * 5), (910, [1.0] * 5), (911, [1e300] * 5), (912, None)]
    return rows


def test_lattice_links_equal_brute_force(spark):
    rows = near_vectors()
    usable = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in usable.items()}
    unit = {i: v / np.sqrt((v**2).sum()) for i, v in unit.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = linked_classes([i for i, _ in rows], links)
    data = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in lattice.lattice_dedup(data).collect()}
    assert len(got) == len(rows) and len(links) > 60
    assert {i: (r.component_id, r.n_links) for i, r in got.items()} == {
        i: (label[i], sum(i in link for link in links)) for i, _ in rows
    }
    assert lattice.lattice_dedup(data.limit(0)).count() == 0


def test_e8_points_are_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(50, 8)) * 2
    found, roots = lattice.nearest_e8(y), lattice.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    mine = ((y - found) ** 2).sum(axis=1)
    assert (mine[:, None] <= ((y[:, None] - found[:, None] - roots[None]) ** 2).sum(axis=2) + 1e-9).all() and mine.max() <= 1 + 1e-9


def met_pairs(entries, planted):
    """Pairs that meet in some cell, counted with repeats, and the share of planted pairs (2k, 2k + 1) among them."""
    own = np.array(entries.column("own").to_pylist())
    near = np.array(entries.column("near").to_pylist()).reshape(*own.shape, -1)
    total, found = 0, np.zeros(planted, bool)
    a, b = np.arange(planted) * 2, np.arange(planted) * 2 + 1
    for t in range(own.shape[1]):
        cells, place, size = np.unique(own[:, t], return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(cells, near[:, t]), len(cells) - 1)
        total += (size[place] - 1).sum() // 2 + np.where(cells[at] == near[:, t], size[at], 0).sum()
        found |= (own[a, t] == own[b, t]) | (near[a, t] == own[b, t, None]).any(1) | (near[b, t] == own[a, t, None]).any(1)
    return total, found.mean()


def test_lattice_cells_follow_the_number_of_vectors():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    planted, met = 1000, []
    for n in (20_000, 40_000):
        unit = rng.normal(size=(n, 64))
        unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
        cosine = np.linspace(0.95, 0.97, planted)[:, None]
        base, other = unit[0 : 2 * planted : 2], unit[1 : 2 * planted : 2]
        other = other - (other * base).sum(axis=1)[:, None] * base
        unit[1 : 2 * planted : 2] = cosine * base + np.sqrt(1 - cosine**2) * other / np.sqrt((other**2).sum(axis=1))[:, None]
        groups, tables = lattice.layout(n, 0.95)
        assert groups == 2
        ids = pa.array(np.arange(n))
        batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(list(unit))], names=["node", "copies", "vector"])
        entries = next(lattice._hasher(groups, tables, lattice.NEIGHBOURS, lattice.SCALE)(iter([batch])))
        total, recall = met_pairs(entries, planted)
        assert recall >= 0.99
        met.append(total / n)
    assert max(met) < 2 * lattice.MET  # both sides of a pair are counted
    sizes = [10**k for k in range(2, 11)]
    same, near = lattice.meeting_rates(0.0, lattice.SCALE, lattice.NEIGHBOURS)
    for n in sizes:
        groups, tables = lattice.layout(n, 0.95)
        assert tables * (same**groups + groups * same ** (groups - 1) * near) * n <= lattice.MET
    assert [lattice.layout(n, 0.95)[0] for n in sizes] == sorted(lattice.layout(n, 0.95)[0] for n in sizes)
    assert lattice.most_differing(0.95) == 54


def test_lattice_with_several_groups_links_what_brute_force_links(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MET", 1)
    test_lattice_links_equal_brute_force(spark)


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (30, 18, 400, 7, 3)] + [None, ""]
    other = lambda n: " ".join(word() for _ in range(n))
    changed = items[0].split()
    changed[5], changed[15], changed[25] = "new", "other", "third"
    half = " ".join(items[2].split()[100:160])
    texts = [
        other(50) + " " + items[0].upper() + ". " + other(20), " ".join(changed), half, "x " + items[3] + " y", other(200), None, "",
        " ".join(items[0].split()[:8]) + " " + other(30), items[4], items[1], items[1], other(3000) + " " + items[1] + " " + other(3000),
    ]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 2), (3, 3), (9, 1), (10, 1), (11, 1)}
    assert (got[1, 0].words, got[1, 0].matches, got[2, 2].words, got[11, 1].doc_word) == (30, 27, 60, 3000)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    missing = frame(spark, [items[1], items[1], "clean words"], [None, None, None])
    assert [r.doc_id for r in decontaminate.find_leaks(missing, bench).collect()] == [None]
    assert decontaminate.decontaminate(missing, bench).count() == 1


def test_masks_leave_no_placement_out():
    masks = [sum(1 << i for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS]
    spans = [len(m) for m in decontaminate.MASKS]
    # A stretch of 20 words or more parts into stretches of 10 to 19, and one of them has no more than its fifth changed.
    for n in range(10, 21):
        changed = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)])
        hit = np.zeros(len(changed), bool)
        for mask, span in zip(masks, spans, strict=True):
            for shift in range(n - span + 1):
                hit |= changed & (mask << shift) == 0
        assert hit.all(), (n, int((~hit).sum()))


def test_leaks_with_every_fifth_word_changed(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (300, 13, 15, 20)]
    texts, expected = [], set()
    for first in range(5):
        texts.append([w if i % 5 != first else "new" for i, w in enumerate(items[0])])
        expected.add((len(texts) - 1, 0))
    for number, places in [(1, c) for c in itertools.combinations(range(13), 2)] + [(2, (3, 7, 11)), (2, (4, 9, 14)), (3, (4, 9, 14, 19)), (3, (3, 7, 11, 15))]:
        texts.append([w if i not in places else "new" for i, w in enumerate(items[number])])
        expected.add((len(texts) - 1, number))
    texts = [" ".join([word() for _ in range(20)] + t + [word() for _ in range(20)]) for t in texts]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()} == expected


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_longest_agreement_equals_brute_force(share):
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 25):
        for _ in range(20):
            agree = rng.random(n) < 0.7
            best = max((b - a for a in range(n) for b in range(a + 1, n + 1) if agree[a:b].sum() >= share * (b - a) - 1e-9), default=0)
            a, b = decontaminate.longest_agreement(agree, share)
            assert b - a == best


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.col("source"))
    long_text = docs.filter("n_chars > 500 AND lang = 'en'").orderBy("doc_id").first().text
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    added = [(10_000, long_text, "en", "s", 1, "x"), (10_001, "A clean text. " + leak, "en", "s", 1, "x"), (None, None, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(added, docs.schema))
    seen = {}
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = function(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            docs = docs.cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert len(seen["line_dedup"]) == len(seen["quality_classifier"]) < 203
    assert 10_000 not in seen["jaccard_join"] or not seen["jaccard_join"][10_000].text
    assert 10_001 not in seen["benchmark_decontamination"]
    last = seen["sentencepiece"]
    assert set(last) == set(seen["benchmark_decontamination"]) and all(len(r.ids) == r.n_tokens for r in last.values())


def test_every_operator_has_its_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
