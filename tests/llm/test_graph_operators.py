"""SimHash, BagMinHash, components, cover trees, PII, mixing, pipeline: against brute force, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import bagminhash, common, components, cover_tree, mixing, packing, pii, simhash, toxicity

from .conftest import prose


def test_edited_texts_follow_descending_ids(odd, none):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in one.select("doc_id", "text").collect()}
    order, rows = sorted(texts, reverse=True), {r.doc_id: r for r in simhash.edited_fingerprints(one).collect()}
    assert len(rows) == len(order)
    for k, i in enumerate(order):
        t, u = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest()
        assert rows[i].near_next == pytest.approx(simhash.likeness(bytes.fromhex(rows[i].fingerprint), bytes.fromhex(rows[order[(k + 1) % len(order)]].fingerprint)))
    same = simhash.fingerprints(odd, keep=("text",)).groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert {r.n for r in same.collect()} == {1}
    assert simhash.edited_fingerprints(odd).count() == odd.count() and simhash.edited_fingerprints(none).count() == 0


def test_rows_of_one_id_are_dealt_to_many_runs(spark):
    rng = random.Random(3)
    rows = [(None, f"n{i} {prose(rng, 3)}") for i in range(300)] + [(7, f"s{i} {prose(rng, 3)}") for i in range(300)] + [(i, prose(rng, 4)) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ordered = simhash.in_descending_order(df).where("not copy").groupBy("run").count().collect()
    assert max(r["count"] for r in ordered) < 150
    order = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    want = set()
    for r, following in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(r.text) // 3
        want.add((r.doc_id, hashlib.sha256((r.text[: len(r.text) - cut] + following.text[:cut]).encode()).hexdigest()))
    assert {(r.doc_id, r.edited_sha256) for r in simhash.edited_fingerprints(df).collect()} == want


def test_ids_at_both_ends_of_64_bits(spark):
    rng = random.Random(4)
    ends = [*range((1 << 63) - 40, 1 << 63), *range(-(1 << 63), -(1 << 63) + 40)]
    texts = {i: prose(rng, 5) for i in ends}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [((1 << 53) + 1, f"heavy {i}") for i in range(60)], "doc_id long, text string").repartition(3)
    rows = simhash.edited_fingerprints(df).collect()
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in rows if r.doc_id in texts}
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        if i > 0 > j:
            continue  # the rows of the id between them stand here
        cut = len(texts[i]) // 3
        assert got[i] == hashlib.sha256((texts[i][: len(texts[i]) - cut] + texts[j][:cut]).encode()).hexdigest()
    assert len(rows) == len(df.collect())
    runs = simhash.in_descending_order(df).where("not copy and doc_id = 9007199254740993").groupBy("run").count().collect()
    assert len(runs) > 1


def test_one_row_is_its_own_next(spark):
    row = simhash.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1


@pytest.mark.parametrize("blocks", [None, 6])
def test_block_tables_find_all_pairs_within_the_radius(spark, blocks):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = {b for x in base for b in [x, *(x ^ sum(1 << k for k in rng.sample(range(128), rng.randint(1, 6))) for _ in range(8))]}
    df = spark.createDataFrame([(f"{v:032x}",) for v in values] + [(f"{base[0]:032x}",), (None,)], "fingerprint string")
    got = {(r.a, r.b): r.distance for r in simhash.near_fingerprints(df, 3, blocks).collect()}
    hexes = sorted(f"{v:032x}" for v in values)
    want = {(a, b): d for i, a in enumerate(hexes) for b in hexes[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and want


def near_copies(rng, text, share):
    words = text.split()
    return " ".join(w if rng.random() > share else "zzz" for w in words)


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter({("", text or ""): 1})


def brute_classes(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            shared = sum((a & bags[j]).values())
            if shared >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - shared):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [2048, 16])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for _ in range(6):
        text = prose(rng, 120)
        rows += [(len(rows) + k, near_copies(rng, text, rng.choice([0, 0.01, 0.02, 0.04]))) for k in range(25)]
    rows += [(1000 + i, prose(rng, rng.randint(0, 40))) for i in range(60)] + [(2000 + i, "same line again " * i) for i in range(1, 12)]
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    smallest = {}
    for (i, _), c in zip(rows, want, strict=True):
        smallest[c] = min(smallest.get(c, i), i)
    assert {i: smallest[c] for (i, _), c in zip(rows, want, strict=True)} == got


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        e = rng.integers(0, 2**63, 80).astype(np.uint64)
        w, v = rng.integers(0, 9, (2, 80))
        truth = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        a, b = bagminhash.sign([(e[w > 0], w[w > 0]), (e[v > 0], v[v > 0])], 512)
        errors.append((a == b).mean() - truth)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_near_duplicates_of_odd_rows(odd, none):
    rows = bagminhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    kept = bagminhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.class_id for r in rows})
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("unit", [1_000_000, 20])
def test_components_equal_a_loop(spark, unit):
    rng = random.Random(4)
    edges = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(80)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), unit=unit).collect()
    assert {r.node: r.component for r in got} == {k: root(k) for k in parent}


def brute_top(rows, k, every):
    good = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "UNIT_ROWS", 40)
    monkeypatch.setattr(cover_tree, "GROUP", 7)
    monkeypatch.setattr(cover_tree, "TASK_QUERIES", 13)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2, 8)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(100)] + [(2000, None), (2005, []), *[(3000 + i, [0.1 * (i % 7), 0.2, 0.3]) for i in range(90)], (2010, [None] * 8), (2015, [float("nan")] * 8), (2020, [float("inf")] * 8), (None, [0.1] * 8), (2025, [0.3, 0.4]), (2030, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in sorted(cover_tree.top_inner_products(df, 5, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {k: v for k, v in brute_top(rows, 5, 5).items() if v}
    assert cover_tree.top_inner_products(df.limit(0)).count() == 0


def test_top_products_of_repeated_ids(spark, monkeypatch):
    """Rows of one id with different vectors are queries each; equal rows are one query, and candidates as often as they stand."""
    monkeypatch.setattr(cover_tree, "UNIT_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(i // 3, (rng.integers(-3, 4, 4) / 4).tolist()) for i in range(240)]
    rows += [(50, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0])] + [(10, [1.0, 1.0, 1.0, 1.0])] * 9 + [(77, [2.0, 1.0, 0.0, 1.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r.query_row, r["rank"], r.vec_id, r.score) for r in cover_tree.top_inner_products(df, 5, 10).collect())
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for at, (i, q) in enumerate(whole):
        if i % 10 == 0 and not any(j == i and (v == q).all() for j, v in whole[:at]):
            best = sorted((-int(q @ v), j) for n, (j, v) in enumerate(whole) if n != at)[:5]
            want.append((i, [(j, -s) for s, j in best]))
    asked: dict = {}
    for i, row, _, j, s in got:
        asked.setdefault((i, row), []).append((j, s))
    assert sorted((i, found) for (i, _), found in asked.items()) == sorted(want)


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (200, 6)) for c in (-5, 0, 5)])
    tree = cover_tree.cover_tree(x, 16)
    todo, seen = [tree], []
    while todo:
        node = todo.pop()
        assert (np.linalg.norm(x[node.rows] - node.centre, axis=1) <= node.radius + 1e-9).all()
        todo += node.children
        if not node.children:
            seen += node.rows.tolist()
    assert sorted(seen) == list(range(len(x)))
    q = x[:30]
    best = cover_tree.Best(30, 5, np.full(30, -np.inf))
    scored = cover_tree.dual_search(tree, x, np.arange(len(x)), cover_tree.cover_tree(q, 8), q, np.arange(30), best)
    leaves = sum(1 for _ in seen) // 16
    assert scored < 8 * leaves


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_expressions(spark, odd, none):
    rng = random.Random(7)
    signs = "ab1. @-+()0594_\n😀é"
    texts = ["a@b.c_d@e.f x@y.z@w.q 1.2.3.4.5 256.1.1.1 001.02.3.4 +1 (017) 555-7713 4111 1111 1111 1111 é😀 a.b@c.d.e- ", "9" * 5000 + " " + "a" * 20_000 + "@" + "1.1.1.1 " * 700, None, ""]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        base = [(s.kind, s.start, s.end) for s in r["__base"]]
        assert base == brute_spans(texts[r.doc_id] or "")
        assert set(base) <= {(s.kind, s.start, s.end) for s in r["__all"]}
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0
    assert pii.redact(odd, n_chars="n_chars").columns == odd.columns


def test_patterns_discover_unseen_identifiers(spark):
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "6011111111111117", "5105105105105100"]
    rows = [(i, f"word{i} please charge card number: {cards[i % 5]} thanks") for i in range(40)] + [(100 + i, f"charge card number: 1234-5678-9012-34{i:02d} ok") for i in range(10)]
    rows += [(200 + i, f"the lot 12345678{i:02d} is here") for i in range(50)]
    found = {r.doc_id: r["__all"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s.kind for s in found[100 + i]] == ["card"] for i in range(10)) and not any(found[200 + i] for i in range(50))
    text = spark.createDataFrame([(1, "mail x@y.zz or +1 555 123 4567!")], "doc_id long, text string")
    assert pii.redact(text).first().text == "mail <EMAIL> or <PHONE>!"


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 7, "c": 2}, {"a": 1, "b": 1, "c": 1}])
def test_schedule_keeps_windows_and_deviation(spark, weights):
    counts = {"a": 300, "b": 170, "c": 41}
    df = spark.createDataFrame([(i * 10 + n, f"t{i}", k) for n, k in enumerate(counts) for i in range(counts[k])], "doc_id long, text string, source string")
    rows = sorted(mixing.schedule(df, weights, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {r.doc_id for r in df.collect()}
    whole, period = mixing.whole_weights(weights)
    slots = sorted({(r.slot, r.source, r.phase) for r in rows})
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    taken = dict.fromkeys(weights, 0)
    for n, (_, k, phase) in enumerate(slots, 1):
        if phase:
            break
        taken[k] += 1
        assert mixing.deviation(whole, period, taken, n) < 1


IRRATIONAL = {"a": 2**0.5, "b": 3.141592653589793, "c": 2.718281828459045, "d": 1.618033988749895, "e": 0.5772156649015329}


@pytest.mark.parametrize("weights", [mixing.default_weights({"hot": 95_000, **{f"s{i:02d}": 10_000 for i in range(19)}}), {"a": 0.15, "b": 999.85}, {"a": 1, "b": 1, "c": 1}, IRRATIONAL])
def test_deviation_from_given_weights_stays_below_one_block(weights):
    blocks, total = {k: int(105_000 * w / sum(weights.values())) + 5 for k, w in weights.items()}, sum(weights.values())
    plan, taken, order = mixing.phases(blocks, weights), dict.fromkeys(weights, 0), {}
    for n, p in enumerate(plan):
        for k in p.first:
            end = plan[n + 1].first.get(k, blocks[k]) if n + 1 < len(plan) else blocks[k]
            order.update((mixing.slot_of(p, k, i), (k, n)) for i in range(p.first[k], end))
    assert sorted(order) == list(range(sum(blocks.values())))
    first = [order[slot][0] for slot in range(len(order)) if not order[slot][1]]
    assert len(first) > 100_000
    for n, k in enumerate(first, 1):
        taken[k] += 1
        assert all(abs(taken[k] - n * w / total) < 1 for k, w in weights.items())


def test_plans_do_not_grow_with_the_rows():
    sizes = [sum(len(s) for p in mixing.phases(blocks, mixing.default_weights(blocks)) for s in p.slots.values()) for blocks in ({f"s{i}": 10**n * (i + 3) for i in range(12)} for n in (6, 9))]
    assert sizes[0] == sizes[1] < 12 * 2 * mixing.PARTS
    with pytest.raises(ValueError):
        mixing.phases(dict.fromkeys(IRRATIONAL, 10**9), IRRATIONAL)


CLASHING = ("__source", "__hash", "__rank", "__id", "__all", "__base", "__k0", "c0", "a.b", "slot", "score", "class_id")


def clashing(spark, rows):
    """Texts with columns named like helpers, and with a dot, whose values are to come out as they went in."""
    made = [(i, t, f"s{i % 3}", *(f"{n}{i}" for n in CLASHING)) for i, t in rows]
    return spark.createDataFrame(made, ["doc_id", "text", "source", *CLASHING])


def test_columns_named_like_helpers_keep_their_values(spark):
    rng = random.Random(21)
    df = clashing(spark, [(i, prose(rng, 30) + (" mail a@b.cc" if i % 5 == 0 else "")) for i in range(60)] + [(100, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    before = {r[0]: tuple(r) for r in df.collect()}
    for out, changed in ((mixing.in_schedule_order(df), ()), (bagminhash.one_of_each(df), ()), (pii.redact(df), (1,)), (toxicity.without_toxic(df, labels, threshold=2.0), ())):
        assert out.columns == df.columns
        rows = {r[0]: tuple(r) for r in out.collect()}
        assert {i: [x for k, x in enumerate(r) if k not in changed] for i, r in rows.items()} == {i: [x for k, x in enumerate(r) if k not in changed] for i, r in before.items()}
    assert pii.redact(df).where("doc_id = 5").first()["text"] == before[5][1].replace("a@b.cc", "<EMAIL>")
    kept = simhash.fingerprints(df.withColumnRenamed("slot", "fingerprint"), keep=("doc_id", "fingerprint", "a.b"))
    assert kept.columns == ["doc_id", "fingerprint_in", "a.b", "fingerprint"] and kept.where("doc_id = 7").first()[1:3] == ("slot7", "a.b7")


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.schedule(odd).collect()
    assert sorted(r.position for r in rows) == list(range(odd.count()))
    mixed = mixing.in_schedule_order(odd)
    assert mixed.columns == odd.columns and mixed.count() == odd.count()
    assert mixing.schedule(none).count() == 0 and mixing.in_schedule_order(none).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(odd, {"s0": 0.0, "s1": 1.0})


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    text = prose(rng, 100)
    rows = [(i, prose(rng, 60) + (" you idiot moron" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(300 + i, text + f" end{i}", "en", "s0", 1) for i in range(5)] + [(400, "call x@y.zz " + prose(rng, 30), "en", "s1", 1), (401, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert not {i for i in range(0, 200, 4)} & ids["toxicity"] and len(ids["toxicity"]) >= 150
    assert len({300, 301, 302, 303, 304} & ids["near_duplicates"]) == 1 and 300 in ids["near_duplicates"]
    assert "<EMAIL>" in kept["personal_data"].where("doc_id = 400").first().text
    assert ids["mixing"] == ids["personal_data"] == ids["near_duplicates"] == ids["packing"]
    library, got = common.load_tokenizer("word_bpe_49k.json"), {}
    for r in sorted(kept["packing"].collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and 1 << r.bucket == r.length
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID] for r in kept["mixing"].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


def test_near_counts(spark):
    df = spark.createDataFrame([(1, "0" * 32), (2, "0" * 31 + "1"), (3, "f" * 32), (4, "0" * 32), (5, None)], "doc_id long, fingerprint string")
    assert {r.doc_id: r.near_count for r in simhash.with_near_count(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    assert simhash.near_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "blocks"), [(2048, None), (7, None), (7, 6)])
def test_near_counts_equal_brute_force(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(4)]
    values = {b for x in base for b in [x, *(x ^ sum(1 << k for k in rng.sample(range(128), rng.randint(1, 4))) for _ in range(30))]}
    got = {r.fingerprint: r.near_count for r in simhash.near_counts(spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string"), 3, blocks).collect()}
    want = {f"{v:032x}": n for v in values if (n := sum(0 < (v ^ w).bit_count() <= 3 for w in values))}
    assert got == want


def test_fingerprints_equal_naive_voting():
    hasher = simhash.SimHasher()
    for text in ("", "one", "the cat sat on the cat mat the cat", *(prose(random.Random(k), 60) for k in range(5))):
        words = re.findall(r"\w+", text.lower())
        hashes = [simhash.xxhash.xxh3_64_intdigest(w) for w in words]
        full = (1 << 64) - 1

        def mix(x):
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
            return x ^ (x >> 31)

        gold = 0x9E3779B97F4A7C15
        terms = Counter(mix(((a * gold) + (b ^ (b >> 29))) & full) for a, b in zip(hashes, hashes[1:])) if len(hashes) > 1 else Counter(hashes)
        votes = [0.0] * 128
        for t, n in terms.items():
            bits = b"".join(mix((t + k * gold) & full).to_bytes(8, "little") for k in (1, 2))
            for i in range(128):
                votes[i] += (1 + np.log(n)) * (1 if bits[i // 8] >> (7 - i % 8) & 1 else -1)
        assert hasher(text).hex() == "".join(f"{int(''.join('1' if v > 1e-6 else '0' for v in votes[i : i + 4]), 2):x}" for i in range(0, 128, 4))


def brute_discovery(texts, rounds=3):
    """The graph of patterns and instances walked in dictionaries: (kind, value): score."""
    plain = lambda w: re.sub("[0-9]", "0", w.lower())
    totals, edges = Counter(), Counter()
    for t in texts:
        words = [plain(w) for w in t.split()]
        totals.update(f"1 {w}" for w in words)
        totals.update(f"2 {a} {b}" for a, b in zip(words, words[1:]))
        spans = [(a, b, k) for k, a, b in brute_spans(t)]
        for m in re.finditer(r"\S+", t):
            if re.search("[0-9@]", m[0]) and (c := re.search(r"[^\W_](?:\S*[^\W_])?", m[0])):
                a, b = m.start() + c.start(), m.start() + c.end()
                if not any(x < b and a < y for x, y, _ in spans if _):
                    spans.append((a, b, None))
        for a, b, kind in spans:
            left, right = t[:a].split(), t[b:].split()
            left = [plain(w) for w in left[-2:]] if a and t[a - 1].isspace() else []
            right = [plain(w) for w in right[:2]] if b < len(t) and t[b].isspace() else []
            found = [f"L1 {left[-1]}"] if left else []
            found += [f"L2 {left[0]} {left[1]}"] if len(left) > 1 else []
            found += [f"R1 {right[0]}"] if right else []
            found += [f"R2 {right[0]} {right[1]}"] if len(right) > 1 else []
            edges.update((p, t[a:b], kind) for p in found)
    seeds = {}
    for (p, v, k), n in edges.items():
        if k:
            seeds.setdefault((p, k), []).append(n)
    any_seed = Counter()
    for p, v in {(p, v) for p, v, k in edges if k}:
        any_seed[p] += 1
    mass0 = {pk: sum(ns) for pk, ns in seeds.items() if len(ns) >= pii.LEAST_SEEDS and any_seed[pk[0]] >= pii.LEAST_SEEDS}
    shaped = {"email": lambda v: "@" in v, "ip": lambda v: bool(re.match(r"^[0-9]+([.:][0-9]+){3,}$", v)), "card": lambda v: not re.search(r"[^\W\d_]", v) and 8 <= len(re.sub(r"\D", "", v)) <= 19, "phone": lambda v: not re.search(r"[^\W\d_]", v) and 5 <= len(re.sub(r"\D", "", v)) <= 15}
    scores = {}
    for _ in range(rounds):
        mass = dict(mass0)
        for (p, v, k), n in edges.items():
            if k is None and any_seed[p] >= pii.LEAST_SEEDS:
                for kind in pii.KINDS:
                    if (kind, v) in scores:
                        mass[p, kind] = mass.get((p, kind), 0) + n * scores[kind, v]
        sure = {pk: m / (totals[pk[0][1:]] + 1) for pk, m in mass.items()}
        doubt = {}
        for (p, v, k), n in edges.items():
            if k is None:
                for kind in pii.KINDS:
                    if sure.get((p, kind), 0) >= pii.LEAST_CONFIDENCE and shaped[kind](v):
                        doubt[kind, v] = doubt.get((kind, v), 1) * (1 - min(sure[p, kind], 0.999))
        scores = {kv: 1 - d for kv, d in doubt.items() if 1 - d >= pii.LEAST_SCORE}
    return scores


def planted(n: int = 400):
    """Texts with personal data beside telling words, identifiers that no expression finds, and numbers that are none."""
    rng = random.Random(31)
    frames = {"card": ("charge card {} expires soon", "paid with {} visa debit"), "phone": ("please call {} after noon", "ring me {} tonight maybe"), "ip": ("login from {} was refused",), "email": ("write to {} with questions",)}

    def number(k, valid):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(k))
            if luhn(d) == valid:
                return d

    make = {"card": (lambda: number(16, True), lambda: number(16, False)), "phone": (lambda: "+1" + number(10, True), lambda: f"{number(3, True)}-{number(4, True)}"), "ip": (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4))), "email": (lambda: f"u{number(4, True)}@mail.zz", lambda: f"u{number(4, True)}@localhost")}
    texts, hidden = [], []
    for _ in range(n):
        kind = rng.choice(list(frames))
        unseen = rng.random() < 0.2
        value = make[kind][unseen]()
        texts.append(f"{prose(rng, rng.randint(3, 15))} {rng.choice(frames[kind]).format(value)} {prose(rng, 5)}")
        hidden.append((kind, value) if unseen else None)
        if rng.random() < 0.3:
            texts.append(f"{prose(rng, 8)} batch {number(16, False)} of {number(7, True)} units {prose(rng, 4)}")
            hidden.append(None)
    return texts, hidden


def test_graph_rounds_equal_a_loop_and_find_unseen_identifiers(spark):
    texts, hidden = planted()
    texts.append(prose(random.Random(1), 30) + " charge card " + "x" * 3000 + " " + "y" * 90 + " card 1234567812345678 expires soon")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_discovery(texts)
    best = {}
    for (kind, value), score in want.items():
        rank = (score, [kind == k for k in pii.KINDS])
        if rank > best.get(value, (None, (-1, [])))[1]:
            best[value] = (kind, rank)
    added = set()
    for r in pii.find_personal_data(df).collect():
        base = {tuple(s) for s in r["__base"]}
        added |= {(r.doc_id, s.kind, texts[r.doc_id][s.start : s.end]) for s in r["__all"] if tuple(s) not in base}
    assert {(k, v) for _, k, v in added} == {(k, v) for v, (k, _) in best.items()}
    truth = {(i, *h) for i, h in enumerate(hidden) if h} | {(len(texts) - 1, "card", "1234567812345678")}
    assert len(added & truth) >= 0.95 * len(truth) and len(added & truth) >= 0.98 * len(added)


def test_pipeline_stages_take_odd_rows_and_empty_tables(odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark = odd.sparkSession
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert out.count() >= docs.count()
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
                assert name not in ("personal_data", "mixing") or out.count() == docs.count()
