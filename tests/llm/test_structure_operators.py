"""Prefix trie, spot signatures and structure repair against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import prefix_trie, queries, spot_signatures, structure_repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, turns string, id string, `a.b` string, depth int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "t", "i", "dot", 5) for r in rows], TURNS)


# Equal, prefixed and diverging conversations, ties, nulls, repeated rows, a turnless id-free row.
TALK = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in (1, 2, 3) for t in range(4)]
    + [(4, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(2)]
    + [(5, 0, "user", "turn 0"), (5, 1, "assistant", "other"), (5, None, None, "first"), (6, None, None, "first"), (6, 0, "user", None)]
    + [(7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "lost"), (-8, 3, "user", "long " * 5000)]
    + [(9, t, "user", f"deep {t}") for t in range(300)]
    + [(c, 0, "user", "crowd") for c in range(100, 140)]
)


def _sequences(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16]
            convs.setdefault(c, []).append((t is not None, t or 0, r, key, x))
    return {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in convs.items()}


def _trie(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children, leaves, saved, ends = {}, {}, {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, m in members.items():
        weight = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + weight
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
    for c, path in paths.items():
        ends.setdefault(tuple(path), []).append(c)
    told = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(
        [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], told(p)) for p, m in members.items()],
        key=repr,
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shard_turns, parts", [(1 << 18, 1), (5, 3), (1, 2)])
def test_trie_equals_brute_force_however_it_is_sharded(spark, monkeypatch, shard_turns, parts):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = prefix_trie.prefix_trie(prefix_trie.turn_sequences(talk(spark, TALK)))
        assert out.columns == NODE
        assert sorted(map(tuple, out.collect()), key=repr) == _trie(_sequences(TALK))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(prefix_trie.turn_sequences(talk(spark, []))).count() == 0
    none = prefix_trie.turn_sequences(talk(spark, [(3, 0, None, None)])).select("conv_id", F.expr("slice(turns, 1, 0) turns"))
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(none).collect()] == [(3, 0, None, 1, 0, 1, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_every_path_and_no_other(seed):
    rng = np.random.default_rng(seed)
    paths = sorted({tuple(rng.integers(0, rng.choice([3, 60, 900]), rng.integers(0, 7)).tolist()) for _ in range(400)})
    lengths = np.array([len(p) for p in paths])
    codes = np.array([c for p in paths for c in p], np.int64)
    starts = np.cumsum(lengths) - lengths
    trie = prefix_trie.DoubleArray(codes, starts, lengths)
    seen = {}
    for depth, rows, slots in trie.walk(codes, starts, lengths):
        for r, s in zip(rows.tolist(), slots.tolist()):
            assert seen.setdefault(s, paths[r][:depth]) == paths[r][:depth]
    assert len(seen) == len({p[:d] for p in paths for d in range(len(p) + 1)}) and trie.top <= len(seen) + 4 * 900


def test_trie_query_equals_its_sql_shape(spark):
    import zlib

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = _sequences(rows)
    taken = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: own.get(c - c % 5, [])[: taken[c]] + own[c][taken[c] :] for c in own}
    got = queries.QUERIES["op11_prefix_trie"](spark, SF).select(*NODE).collect()
    assert sorted(map(tuple, got), key=repr) == _trie(rebuilt)


WORD = re.compile(r"[^\W_]+", re.UNICODE)


def _signatures(text):
    words = WORD.findall((text or "").lower())
    anchors = set(spot_signatures.ANCHORS)
    content = [w for w in words if w not in anchors]
    chains, before = [], 0
    for w in words:
        if w in anchors:
            chains += [" ".join([w, *content[before : before + 2]])] if before + 2 <= len(content) else []
        else:
            before += 1
    chains = chains or [" " + w for w in words] or ["\n" + (text or "")]
    return sorted({int(hashlib.md5(c.encode()).hexdigest()[:15], 16) for c in chains})


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


PROSE = [
    "The cat of the house and a dog", "the CAT of the house, and a dog", "", None, "!!", "?", "of the", "plain words only here", "plain words only there",
    "The man in the moon came down too soon and asked the way to Norwich", "x " * 20_000 + "the end of it", "Ça est la vie de Zoë et du chat",
]


def doc_frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", 3, "dot") for i, t in zip(ids, texts)], "doc_id long, text string, signatures string, did int, `a.b` string")


def test_signatures_equal_brute_force(spark):
    out = spot_signatures.fingerprints(doc_frame(spark, PROSE))
    assert out.columns == ["doc_id", "text", "signatures", "did", "a.b"]
    for r in out.collect():
        assert r.signatures == _signatures(r.text)
    assert spot_signatures.fingerprints(doc_frame(spark, [])).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_spot_search_equals_brute_force(spark, least):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + spot_signatures.ANCHORS[:12] * 3
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 1 + len(c) // 15)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    texts += PROSE + [texts[0]] * 3
    docs = doc_frame(spark, texts)
    got = sorted((r.query_id, r.doc_id, round(r.likeness, 9)) for r in spot_signatures.spot_search(docs.filter("doc_id % 7 = 0"), docs, least=least).collect())
    sets = [_signatures(t) for t in texts]
    expected = sorted((q, d, round(_jaccard(sets[q], sets[d]), 9)) for q in range(0, len(texts), 7) for d in range(len(texts)) if _jaccard(sets[q], sets[d]) >= least)
    assert got == expected and len(got) > len(texts) // 7


@pytest.mark.parametrize("rows_a_slice", [3, 10_000])
def test_next_document_over_slices(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(spot_signatures, "SLICE_ROWS", rows_a_slice)
    texts = [f"text {i}" for i in range(30)] + ["tie b", "tie a", None, "no id"]
    ids = [i * i for i in range(30)] + [50, 50, 3, None]
    rows = spot_signatures.beside_next(doc_frame(spark, texts, ids).repartition(3)).collect()
    order = sorted((2**63 - 1 if i is None else i, t or "") for i, t in zip(ids, texts))
    expected = {here: order[(k + 1) % len(order)][1] for k, here in enumerate(order)}
    assert {(r.did, r.text): r.next_text for r in rows} == expected and len(rows) == len(order)
    assert all(r.next_signatures == _signatures(r.next_text) for r in rows)
    alone = spot_signatures.beside_next(doc_frame(spark, ["only"])).collect()
    assert [(r.text, r.next_text) for r in alone] == [("only", "only")]
    assert spot_signatures.beside_next(doc_frame(spark, [])).count() == 0


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def _least_repair(codes):
    """All audits of up to two insertions between rows, by trying them."""
    best = None
    def extend(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 2:
            for r in "ua":
                extend(i, roles + r, cost + 3, audit + "I", inserted + 1)
        if i == len(codes):
            return
        code = codes[i]
        if code != "-":
            more = 3 if code.isupper() else 0
            if code.lower() in "sua":
                extend(i + 1, roles + code.lower(), cost + more, audit + "K", 0)
            for r in "ua":
                extend(i + 1, roles + r, cost + 3 + more, audit + "R", 0)
        extend(i + 1, roles, cost + 4, audit + "D", 0)

    extend(0, "", 0, "", 0)
    return best


def test_agenda_finds_the_least_repair_of_every_short_conversation():
    for n in range(4):
        for codes in map("".join, itertools.product("suaUAo-", repeat=n)):
            assert structure_repair.repair(codes) == _least_repair(codes), codes


def test_spans_do_not_change_a_repair(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choices("suauauaUAo-", k=rng.randint(0, 40)))
        monkeypatch.setattr(structure_repair, "SPAN", 1000)
        whole = structure_repair.repair(codes)
        for span in (1, 7):
            monkeypatch.setattr(structure_repair, "SPAN", span)
            assert structure_repair.repair(codes) == whole


BROKEN = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 3, "user", "   \t"), (1, 5, "user", "cut off"),
    (2, 0, "assistant", "First."), (2, 1, "assistant", "Second."), (2, 1, "assistant", "Second."), (2, None, "user", "Before."),
    (3, 4, None, None), (4, 0, "robot", "What?"), (4, 1, "", "Empty role."), (None, 0, "user", "No id."), (5, 7, "user", "long " * 3000 + "."),
]


def _plans(rows, ids):
    convs = {c: [] for c in ids}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        convs[c].append((t is not None, t or 0, r, hashlib.sha256(x.encode()).digest(), x))
    for c, turns in convs.items():
        turns.sort()
        counts, codes, seen = {"-b": 0, "-d": 0, "t": 0, "": 0}, "", set()
        for _, _, r, _, x in turns:
            s = x.strip(" \t\n\x0b\x0c\r")
            fault = "-b" if not s else "-d" if (r, x) in seen else "t" if s[-1] not in ".!?" else ""
            seen.add((r, x))
            counts[fault] += 1
            code = r[0] if r and r[0] in "sua" else "o"
            codes += "-" if fault[:1] == "-" else code.upper() if fault == "t" else code
        numbers = [t for known, t, *_ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        yield (c, gaps, counts["-b"], counts["-d"], counts["t"], illegal, *structure_repair.repair(codes))


def test_plans_and_repaired_rows(spark):
    rows = talk(spark, BROKEN)
    ids = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, None, 77)], "conv_id long")
    plans = structure_repair.plan_repairs(rows, ids)
    expected = sorted(_plans(BROKEN, [1, 2, 3, 4, 5, None, 77]), key=repr)
    assert sorted(map(tuple, plans.collect()), key=repr) == expected
    made = {}
    for r in sorted(structure_repair.repaired_turns(rows, plans).collect(), key=lambda r: r.place):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, audit in [(e[0], e[-1]) for e in expected]:
        kept = made.get(conv, [])
        assert GRAMMAR.match("".join(role[:1] for role, _ in kept)) and len(kept) == len(audit) - audit.count("D")
    digests = {r.conv_id: r.repaired_sha256 for r in structure_repair.repaired_digests(rows, plans).collect()}
    told = {c: hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made.get(c, [])).encode()).hexdigest() for c in digests}
    assert digests == told and set(digests) == {1, 2, 3, 4, 5, None, 77}
    assert structure_repair.plan_repairs(talk(spark, [])).count() == 0


def test_repair_query_returns_every_conversation(spark):
    rows = queries.QUERIES["op13_structure_repair"](spark, SF).collect()
    assert {r.conv_id for r in rows} == {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").collect()}
    assert any(r.cost for r in rows) and all(r.cost >= 4 * (r.blank + r.duplicate) + 3 * r.audit.count("I") + 3 * r.audit.count("R") for r in rows)
