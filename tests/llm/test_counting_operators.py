"""Ranked search, collocations, substrings: against brute force, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from candela.llm import collocations, lexical_search, substrings, words

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def plain_search(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(i, c, sum(c.values())) for i, t in docs if (c := Counter(terms(t)))]
    count, total = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, c, _ in bags for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in bags:
            m = 50 + 50 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, LAST if i is None else i))
        out += [(item, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def plain_collocations(rows, least=10, first=2000, longest=3):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(zip(*[w[i:] for i in range(k)], strict=False))
    out = []
    for lang, c in counts.items():
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in own.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in own.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, t.decode(), -a, left, right, n[lang], -s) for r, (s, a, t, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def plain_substrings(rows, width=13):
    cut = [(LAST if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for key, _, w in cut:
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), LAST + 1), key)
    out = []
    for key, i, w in cut:
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < key for j in range(k, k + width)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.mark.parametrize("k, shard, item_bytes", [(50, 2_000_000, 4_000_000), (3, 40, 200)])
def test_search_equals_scoring_every_document(spark, odd, k, shard, item_bytes):
    rng = random.Random(2)
    docs = pairs(odd, "doc_id", "text")
    items = [(i, docs[i][1][:200] if docs[i][1] else None) for i in range(0, len(docs), 2)] + [(90, "THE the été 日本語"), (91, None), (92, "..."), (93, prose(rng, 300)), (None, "the of")]
    given = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, doc_id double")
    got = lexical_search.search(odd, given, k=k, shard=shard, item_bytes=item_bytes)
    key = lambda r: tuple("" if x is None else x if isinstance(x, str) else f"{x:030d}" for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_search(docs, items, k), key=key)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(odd, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(odd, items.where("false")).count() == 0


def test_search_stops_before_the_ends_of_lists():
    rng = random.Random(4)
    size, n = 40, 3000
    rows = []
    for i in range(n):  # a few documents hold all terms of the item
        terms = list(range(12)) if i % 300 == 7 else sorted(rng.sample(range(size), 5))
        counts = [60 if i % 300 == 7 else rng.randint(1, 3) for _ in terms]
        rows.append((i, 50, np.array(terms, np.uint32).tobytes(), np.array(counts, np.uint32).tobytes()))
    shard = lexical_search.Shard(rows, np.full(size, 1000), n, 50 * n)
    mark = np.zeros(size, dtype=bool)
    best = lexical_search.Best(5)
    scored = shard.search(np.arange(6), best, mark)
    every = np.arange(n)
    mark[:6] = True
    scores = shard.scores(every, mark)
    order = np.lexsort((every, -scores))[:5]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == scores[order].tolist()
    assert scored < (scores > 0).sum()


def phrases(rng, n):
    small = ["new", "york", "of", "the", "City", "été", "a'b", "x", "日本"]
    text = lambda: "".join(rng.choice(small) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ", "!"]) for _ in range(rng.randint(0, 60)))
    return [(text() if rng.random() > 0.05 else None, rng.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed, slice_, first", [(1, 2_000_000, 2000), (2, 50, 20)])
def test_collocations_equal_counting_all_phrases(spark, monkeypatch, seed, slice_, first):
    monkeypatch.setattr(collocations, "SLICE", slice_)
    monkeypatch.setattr(collocations, "SHARE", 2000)
    rows = phrases(random.Random(seed), 300)
    df = spark.createDataFrame([(t, x, "y", 1) for t, x in rows], "text string, lang string, word string, bucket int").repartition(3)
    got = collocations.collocations(df, first=first)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows, first=first)


def test_collocations_of_odd_rows(odd, none):
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(odd).collect())
    assert got == plain_collocations(pairs(odd, "text", "lang")) and got
    assert collocations.collocations(none).count() == 0


def test_full_bit_tables_lose_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TABLE_BITS", 64)
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    rows = phrases(random.Random(3), 200)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows)


@pytest.mark.parametrize("most", [0, 5])
def test_collocations_of_words_without_a_number(spark, monkeypatch, most):
    monkeypatch.setattr(collocations, "WORDS", most)
    monkeypatch.setattr(collocations, "SHARE", 2000)
    rows = phrases(random.Random(5), 200)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows)


def test_what_tasks_tell_of_phrases_is_small(spark, monkeypatch):
    """Slots travel by small steps and candidates by the numbers of their words; random ones took 4 and about 20 bytes each."""
    told = []
    real = collocations.common.map_rows

    def watched(df, make, schema, finish=False):
        out = real(df, make, schema, finish)
        if "binary" in str(schema) and finish:
            told.append(collocations.common.checkpointed(out))
            return told[-1]
        return out

    monkeypatch.setattr(collocations.common, "map_rows", watched)
    rng = random.Random(6)
    words_ = [f"w{i}" for i in range(2000)]
    lines = [" ".join(rng.choice(words_) for _ in range(40)) for _ in range(250)]
    collocations.collocations(spark.createDataFrame([(" ".join(x + "." for x in lines[i::50]), "en") for i in range(50)] * 10, "text string, lang string").coalesce(1)).count()
    size = lambda df, cols: sum(len(v) for r in df.select(*cols).collect() for v in r if v is not None)
    slots_ = next(x for x in told if {"single", "slots"} <= set(x.columns) and x.where("bucket < 0").count())
    assert size(slots_.where("bucket >= 0"), ("single", "slots")) < 3.5 * 19_250  # different phrases of two and three words
    candidates_ = next(x for x in told if {"coded", "plain"} <= set(x.columns))
    assert size(candidates_, ("coded", "plain")) < 8 * 21_250


def test_more_tasks_tell_little_more_of_phrases(spark, monkeypatch):
    """What one task has told is not told by all; it took as many times the bytes as there were tasks."""
    told = []
    real = collocations.common.map_rows

    def watched(df, make, schema, finish=False):
        out = real(df, make, schema, finish)
        if "binary" in str(schema) and finish:
            told.append(collocations.common.checkpointed(out))
            return told[-1]
        return out

    monkeypatch.setattr(collocations.common, "map_rows", watched)
    rng = random.Random(7)
    words_ = [f"w{i}" for i in range(1500)]
    lines = [" ".join(rng.choice(words_) for _ in range(12)) for _ in range(600)]
    rows = [(". ".join([*rng.sample(lines, 200), f"x{i}"]), "en") for i in range(96)]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(16))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows)
    size = lambda df, cols: sum(len(v) for r in df.select(*cols).collect() for v in r if v is not None)
    assert sum(size(x, ("coded", "plain")) for x in told if {"coded", "plain"} <= set(x.columns)) < 2.5 * 4 * 12_600  # phrases, of about 4 bytes
    slots_ = next(x for x in told if {"single", "slots"} <= set(x.columns) and x.where("bucket < 0").count())
    assert size(slots_.where("bucket < 0"), ("single", "slots", "counts")) < 16 * 5 * 1_500  # words, of 4.6 letters


@pytest.mark.parametrize("known", [1, 40, 2_000_000])
def test_collocations_with_few_known_candidates(spark, monkeypatch, known):
    monkeypatch.setattr(collocations, "KNOWN", known)
    monkeypatch.setattr(collocations, "SHARE", 2000)
    rows = phrases(random.Random(8), 200)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows)


@pytest.mark.parametrize("slice_, numbers", [(2_000_000, 1 << 20), (50, 1 << 20), (50, 3)])
def test_more_candidates_take_no_more_passes(spark, monkeypatch, slice_, numbers):
    """Candidates beyond one perfect hash took one more pass over the texts for each slice of them: here 30 and more."""
    passes = []
    real = collocations.common.map_rows

    def watched(df, *args, **more):
        passes.extend([df] if df.columns == ["text", "lang"] else [])
        return real(df, *args, **more)

    monkeypatch.setattr(collocations.common, "map_rows", watched)
    monkeypatch.setattr(collocations, "SLICE", slice_)
    monkeypatch.setattr(collocations, "WORDS", numbers)
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["a", "b", "c", "d", "e", "été", "fghijklmnop", "q" * 300]) for _ in range(6)) for _ in range(300)]
    rows = [(". ".join(rng.sample(lines, 40)), rng.choice(["en", None])) for _ in range(120)]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows)
    assert len(passes) == 4  # words, phrases, candidates of the first texts and of the others


def test_collocations_of_four_words(spark):
    rows = phrases(random.Random(10), 200)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(2), longest=4)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain_collocations(rows, longest=4)


def test_words_of_any_length_have_their_own_hashes():
    texts = [b"a" * n + x for n in (0, 1, 6, 7, 8, 9, 15, 16, 17, 100, 255, 256, 257, 70_000) for x in (b"", b"b", b"c")][1:]
    starts, ends, hashes = collocations.hashed_words(b" ".join([*texts, *texts]))
    assert [b" ".join([*texts, *texts])[b:e] for b, e in zip(starts, ends, strict=True)] == [*texts, *texts]
    assert len(set(hashes.tolist())) == len(set(texts)) and hashes[: len(texts)].tolist() == hashes[len(texts) :].tolist()
    assert all(len(x) == 0 for x in collocations.hashed_words(b"")) and all(len(x) == 0 for x in collocations.hashed_words(b" \n"))


@pytest.mark.parametrize("most", [3, 1000, 1 << 22, 1 << 32])
def test_steps_of_slots_come_back(most):
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 30_000):
        slots_ = np.unique(rng.integers(0, most, n).astype(np.uint32))
        packed = collocations.squeezed_steps(slots_)
        assert collocations.opened_steps(packed).tolist() == slots_.tolist()
        if len(slots_) > 20_000:  # 1.44 bits above those of the mean step, and little more
            assert 8 * len(packed) / len(slots_) < 2 + np.log2(most / len(slots_))


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    keys = collocations.once(rng.integers(1, 1 << 63, (20_000, 3)).astype(np.uint64))
    table = collocations.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    others = rng.integers(1, 1 << 63, (20_000, 3)).astype(np.uint64)
    real, at = table.find(np.concatenate([keys, others]))
    assert real[: len(keys)].all() and not real[len(keys) :].any() and len(at) == len(keys)
    assert not collocations.PerfectHash(keys[:0]).find(others)[0].any()


@pytest.mark.parametrize("cell_bytes", [4 << 20, 3000])
def test_substrings_of_odd_rows(odd, none, cell_bytes):
    got = substrings.without_repeats(odd, cell_bytes=cell_bytes, share_bytes=cell_bytes)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_substrings(pairs(odd, "doc_id", "text"))
    assert substrings.without_repeats(none).count() == 0


@pytest.mark.parametrize("seed, width", [(1, 13), (2, 13), (3, 6)])
def test_substrings_equal_looking_up_every_window(spark, seed, width):
    """Passages that many texts share, cut anywhere, cycles, repeats within a text, texts that end in a passage."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(5, 60)).split() for _ in range(12)] + [["a"] * 40, ["a", "b"] * 20, ["c"] * 13, ["c"] * 12]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            parts += p[a : a + rng.randint(1, 60)] + (prose(rng, rng.randint(0, 4)).split() if rng.random() < 0.5 else [])
        if parts and rng.random() < 0.2:
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((rng.choice([i, i, i, i % 7, None]), "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in parts)))
    rows += [rows[k] for k in range(0, 250, 9)] + [(1000 + k, rows[3 * k][1]) for k in range(40)] + [(-k, rows[2 * k][1]) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.without_repeats(df, width=width, cell_bytes=5000, share_bytes=4000)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_substrings(rows, width)


def test_paths_cover_whole_passages(spark):
    """Two texts that share one passage between words of their own give one path of just that passage."""
    rng = random.Random(8)
    shared, own = prose(rng, 80), [prose(rng, 40) for _ in range(4)]
    df = spark.createDataFrame([(1, f"{own[0]} ONE {shared} TWO {own[1]}"), (2, f"{own[2]} THREE {shared} FOUR {own[3]}")], "doc_id long, text string")
    _, found = substrings.repeated_paths(df)
    (span,) = substrings.repeated_spans(found).collect()
    assert (span["first"], span.source, span.start, span.words) == (2, 1, 41, 80)


def test_words_are_found_in_pieces(monkeypatch):
    data = ("ab " * 30 + "x" * 500 + "  cd\n" + "ef").encode()
    kept = words.inside(b" \n")
    whole = words.words_of(data, kept, 2)
    cut = [list(p) for _, p in words.pieces(data, kept, 7)]
    assert b"".join(bytes(p) for p in cut) == data
    monkeypatch.setattr(words, "pieces", lambda d, k, most=7, f=words.pieces: f(d, k, most))
    again = words.words_of(data, kept, 2)
    assert [data[s:e] for s, e in zip(whole[0], whole[1], strict=True)] == data.split()
    for a, b in zip([*whole[:2], *whole[2]], [*again[:2], *again[2]], strict=True):
        assert (a == b).all()
