"""Token counts, packing, language, quality, toxicity: against the libraries, loops, and odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import common, language, packing, pii, quality, token_counts, toxicity

from .conftest import odd_rows, prose

TEXTS = [r[1] or "" for r in odd_rows()]


@pytest.mark.parametrize("text", [*TEXTS, " a  b\n\n c " * 3000, "x" * 5000 + " y", "né " * 4000, "á b" * 2000])
@pytest.mark.parametrize("chunk", [64, 1000])
def test_spliced_ids_are_those_of_the_whole_text(text, chunk):
    library = common.load_tokenizer("byte_bpe_50k.json")
    text = text[:40_000]
    assert token_counts.encode_spliced(library, text, chunk, 16) == library.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_rows(odd, none):
    library = common.load_tokenizer("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd, chunk=2000, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 1024)
    assert token_counts.count_tokens(none).count() == 0


class Asked:
    """A vocabulary that counts the characters it is asked to encode."""

    def __init__(self, library):
        self.library, self.model, self.to_str, self.characters = library, self, library.to_str, 0

    def encode(self, text, **more):
        self.characters += len(text)
        return self.library.encode(text, **more)

    def encode_batch(self, texts, **more):
        self.characters += sum(map(len, texts))
        return self.library.encode_batch(texts, **more)

    def tokenize(self, word):
        self.characters += len(word)
        return self.library.model.tokenize(word)


def test_counts_of_parts_are_those_of_the_library():
    library = common.load_tokenizer("byte_bpe_50k.json")
    rng = random.Random(4)
    signs = [*"ab'st’re 1.,!?ßéÀİ日\u0301\x1c\x85\xa0\u180e\u2003\u3000\t\n\r", " ", " ", "  ", "   ", "x" * 70, "the", " The ", "<|endoftext|>"]
    texts = [*TEXTS, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)), *(prose(rng, 300) for _ in range(100))]
    want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    for bound in (1, 200, 400_000):
        counts = token_counts.PartCounts(library, bound)
        assert not counts.whole and counts(texts) == want and counts(texts[::-1]) == want[::-1]
        assert all(token_counts.KEPT.fullmatch(w) for w in counts.known)


def test_texts_of_other_vocabularies_are_counted_whole():
    from tokenizers import AddedToken, Tokenizer

    path = common.vocabulary_path("byte_bpe_50k.json")
    made = [common.load_tokenizer("word_bpe_49k.json")]
    for token in (AddedToken("a b", normalized=False), AddedToken("he", normalized=False), AddedToken("#", lstrip=True, normalized=False)):
        made.append(Tokenizer.from_file(path))
        made[-1].add_tokens([token])
    texts = [t[:2000] for t in TEXTS] + ["a b a b # the", "  #a b", "she the he # #"]
    for library in made:
        counts = token_counts.PartCounts(library)
        assert counts.whole and counts(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_the_library_is_asked_once_for_a_chunk_and_for_a_part():
    asked, rng = Asked(common.load_tokenizer("byte_bpe_50k.json")), random.Random(6)
    text = prose(rng, 3000)
    token_counts.encode_spliced(asked, text, 2000, 100)
    assert asked.characters < 1.2 * len(text)
    asked.characters, counts = 0, token_counts.PartCounts(asked)
    texts = [prose(rng, 150) for _ in range(20)]
    counts(texts)
    first, asked.characters = asked.characters, 0
    counts(texts)
    assert first < 1.2 * sum(map(len, texts)) and asked.characters == 0


def test_word_ids_are_those_of_the_library():
    library = common.load_tokenizer("word_bpe_49k.json")
    known = packing.WordIds(library, bound=200)
    rng = random.Random(3)
    signs = "ab'st’re 1.,!?ßéÀİΣσͅ\x1c\x85\xa0\t\nx<|endoftext|>"
    texts = [*TEXTS, *("".join(rng.choice(signs) for _ in range(60)) for _ in range(400)), "don't I'll ''s 's'", *(prose(rng, 50) for _ in range(50))]
    for t, raw in zip(texts, known(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_the_library():
    library = common.load_tokenizer("byte_bpe_50k.json")
    known = packing.WordIds(library)
    assert known.whole and not packing.WordIds(common.load_tokenizer("word_bpe_49k.json")).whole
    for t, raw in zip(TEXTS, known(TEXTS), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(100 * i, f"text {i}") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i // 100 % 2) for i in range(2000)], "doc_id long, toxic int")
    assert {tuple(r) for r in quality.labelled_sample(docs, marks, "toxic", 20).collect()} == {(100 * i, f"text {i}", i % 2) for i in range(20)}


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"t{i % 8}") for i in range(400)] + [(7, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(1, 0), (1, 1), (None, 1)], "doc_id long, toxic int")
    whole = {tuple(r) for r in quality.labelled_sample(docs, marks, "toxic").collect()}
    assert len(whole) == quality.labelled_sample(docs, marks, "toxic").count() == 6 * 8 + 1
    few = {tuple(r) for r in quality.labelled_sample(docs.repartition(7), marks, "toxic", 4).collect()}
    assert len(few) == 4 and few <= whole and few == {tuple(r) for r in quality.labelled_sample(docs, marks, "toxic", 4).collect()}


def test_piece_lengths():
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(1) == [1]


def test_pieces_put_the_ids_together_again(odd, none):
    library = common.load_tokenizer("word_bpe_49k.json")
    pieces = packing.pack(odd.dropDuplicates(["doc_id"]).where("doc_id is not null"), with_ids=True).collect()
    texts = {r[0]: r[1] or "" for r in odd.dropDuplicates(["doc_id"]).where("doc_id is not null").collect()}
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    for i, t in texts.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = [x for p in own for x in p.ids]
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 2]
        for p in own:
            assert p.length & (p.length - 1) == 0 and p.length <= 4096 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert all(1 << p.bucket == p.length == 1 << (p.sequence_id >> 59) for p in pieces)
    files = packing.pack(odd).select("bucket").rdd.glom().collect()
    assert all([r.bucket for r in f] == sorted(r.bucket for r in f) for f in files)
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).selectExpr("sum(length)").first()[0] >= sum(len(p.ids) for p in pieces)


def naive_bundle(text: str) -> np.ndarray:
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out, joined = np.zeros(language.DIMENSIONS), " " + " ".join(letters) + " "
    for k in range(len(joined) - 2 if letters else 0):
        out += np.prod([np.roll(language.letter_vector(ord(c)), 2 - i) for i, c in enumerate(joined[k : k + 3])], axis=0)
    return out


LETTERS = ["the x²y and ½cup Ⅷth area m²s of km²s", "das ist ein Text mit 日本 m² drin", "日本語 text 中文字符測試" * 3, "the cat", "", "1 2 3", "é", "".join(map(chr, range(0x4E00, 0x4F00)))]


@pytest.mark.parametrize("bound", [20, 50, 16_384])
def test_bundles_equal_counting_one_by_one_in_any_order(bound):
    texts = [*LETTERS, *(t[:2000] for t in TEXTS)]
    want = [naive_bundle(t) for t in texts]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), sorted(range(len(texts)), key=lambda i: texts[i][::-1])):
        bundler = language.Bundler(bound=bound)
        for part in ([*order][:7], [*order][7:]):
            for i, v in zip(part, bundler([texts[i] for i in part]), strict=True):
                assert (v == want[i]).all()


def test_languages_are_told_apart(spark, odd, none):
    rng = random.Random(8)
    kinds = {"xx": "abcde", "yy": "fghij"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_prototypes(df.where("doc_id < 30"))
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(out[i].lang_pred == k and 0 <= out[i].score <= 1 for i, _, k in rows)
    for r in language.identify(odd, model, keep=("text",)).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.fit_prototypes(none) == {} and {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_rules_as_columns_equal_rules_on_arrays(spark, odd, labels, none):
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = quality.RuleEnsemble.fit(["a", "b", "c"], x, y, trees=10)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97 and len(model.rules) < 60
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").withColumn("s", model.column())
    assert np.allclose([r.s for r in df.collect()], model.score(np.array([[r.a, r.b, r.c] for r in df.collect()])))
    fitted = quality.fit_rules(odd, labels)
    rows = quality.score_quality(odd, fitted).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score_quality(none, fitted).count() == 0
    assert {r.score for r in quality.score_quality(odd, quality.fit_rules(odd, labels.limit(0))).collect()} == {0.5}


def test_decoder_restores_disguised_words(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 60) + " you idiot moron and stupid clown " * 2) for i in range(60)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.language_model(toxicity.count_ngrams(docs)))
    for disguised, plain in {"1d10t": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "mooooron": "moron", "$tup1d": "stupid", "st*pid": "stupid", "cl-own": "clown"}.items():
        assert decoder.restore(f"the {disguised} here").split()[1] == plain
    for plain in ("the idea, of it.", "a b", "Nothing here 12 13!!"):
        assert decoder.restore(plain) == plain.lower()


@pytest.fixture(scope="module")
def decoder(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 60) + " you idiot moron and stupid clown " * 2) for i in range(60)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.language_model(toxicity.count_ngrams(docs)))


def test_long_spans_are_decoded_whole(decoder):
    words = ["stupid", "moron", "idiot", "clown"] * 60
    assert decoder.restore(" ".join(c for w in words for c in w)).split() == words
    assert decoder.restore(".".join(c for w in words for c in w)).split() == words


def test_masked_letters_at_any_count(decoder):
    assert [decoder(s) for s in ("st**id", "m***n")] == ["stupid", "moron"]
    masked = ["st*pid", "mo#on", "idi*t", "c**wn"] * 20
    assert decoder("/".join(masked)).split() == ["stupid", "moron", "idiot", "clown"] * 20


def test_signs_are_read_whatever_stands_beside_them(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 60) + " that hate kill the ass with a stupid quiz clown " * 2) for i in range(60)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.language_model(toxicity.count_ngrams(docs)))
    for disguised, plain in {"a55": "ass", "a$$": "ass", "ki11": "kill", "hat3.": "hate", "hat3,": "hate", '"5tupid': "stupid", "(5tupid)": "stupid", "qui2": "quiz", "st**id!": "stupid", "c*#wn": "clown"}.items():
        word = "".join(c for c in decoder.restore(f"the {disguised} here").split()[1] if c.isalpha())
        assert word == plain, disguised
    for plain in ("well!", "(that kill)", "stupid?!", "12 13"):
        assert toxicity.words_of(decoder.restore(plain)) == toxicity.words_of(plain)


def test_paths_of_masks_are_the_best_of_all(decoder):
    for span in ("m*r*n", "id**t", "s*.#d", "*1d*", "b**ta"):
        best, lattice = {}, [*decoder.lattice(span), [((0,), 0.0)]]
        paths = [((0, 0, 0), 0.0)]
        for options in lattice:
            new = {}
            for path, cost in paths:
                for emitted, extra in options:
                    for filled in itertools.product(*[range(1, 27) if x == toxicity.ANY else (x,) for x in emitted]):
                        p, c = path, cost + extra
                        for x in filled:
                            if x or p[-1]:
                                c += decoder.table[((p[-3] * 28 + p[-2]) * 28 + p[-1]) * 28 + x]
                                p = (*p, x)
                        new[p] = min(c, new.get(p, c))
            paths = list(new.items())
        best = min(paths, key=lambda p: p[1])[0]
        assert decoder(span) == "".join(" abcdefghijklmnopqrstuvwxyz"[x] for x in best[3:]).strip()


def test_counts_equal_a_loop(odd):
    symbols, _, _ = toxicity._tables()
    total = np.zeros(toxicity.SYMBOLS**toxicity.ORDER)
    for r in odd.collect():
        s = [0, 0, 0]
        for c in r.text or "":
            x = int(symbols[ord(c)])
            if x or s[-1]:
                s.append(x)
        if s[-1] or len(s) == 3:
            s.append(0)
        for k in range(len(s) - 3):
            if len(s) > 4:
                total[((s[k] * 28 + s[k + 1]) * 28 + s[k + 2]) * 28 + s[k + 3]] += 1
    got = toxicity.count_ngrams(odd)
    assert (got == total).all()


def test_toxicity_of_held_out_rows(spark, odd, labels, none):
    rng = random.Random(6)
    bad = ["idiot", "1d1ot", "i d i o t", "moooron", "moron"]
    rows = [(i, prose(rng, 40) + (f" {rng.choice(bad)} " if i % 3 == 0 else " ") + prose(rng, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, marks)
    out = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model).collect()}
    assert sum(out[i] == int(i % 3 == 0) for i in range(200, 400)) >= 190
    rows = toxicity.score_toxicity(odd, model, with_text=True).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    flat = toxicity.fit_toxicity(odd, labels.limit(0), label="toxic")
    assert {r.score for r in toxicity.score_toxicity(odd, flat).collect()} == {0.5}
    assert toxicity.fit_toxicity(none, labels).weights == {} and toxicity.score_toxicity(none, model).count() == 0
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns


def test_decoding_takes_bounded_time_and_memory():
    decoder = toxicity.Decoder(np.ones(toxicity.SYMBOLS**toxicity.ORDER, dtype=np.float32))
    for t in ("a*b" * 30_000, "1d10t" * 20_000, "a " * 40_000, "aaa" * 30_000):
        assert isinstance(decoder.restore(t), str)


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    x, target = rng.random((80, 3)).round(2), rng.normal(0, 1, 80)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    tree = quality.Tree(1, 5)
    tree.fit(bins, edges, target, np.arange(80))
    feature, cut, left, right, _ = tree.nodes[0]
    error = lambda low: sum(((target[part] - target[part].mean()) ** 2).sum() for part in (low, ~low))
    best = min(error(x[:, f] <= c) for f in range(3) for c in edges[f] if 5 <= (x[:, f] <= c).sum() <= 75)
    low = x[:, feature] <= cut
    assert error(low) == pytest.approx(best)
    assert (tree.nodes[left][4], tree.nodes[right][4]) == (pytest.approx(target[low].mean()), pytest.approx(target[~low].mean()))
    assert {r for r in tree.rules()} == {((feature, False, cut),), ((feature, True, cut),)}


def test_lasso_meets_the_conditions_of_its_optimum():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 8))
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 3])))).astype(float)
    penalty = 0.05
    b, w = quality.lasso_logistic(x, y, penalty, 5000)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    used = np.abs(w) > 1e-9
    assert 0 < used.sum() < 8 and used[0]
    assert np.allclose(slope[used], -penalty * np.sign(w[used]), atol=1e-4) and (np.abs(slope[~used]) <= penalty + 1e-4).all()
    assert abs((1 / (1 + np.exp(-(x @ w + b))) - y).mean()) < 1e-4


def test_plain_spans_are_the_best_of_all_paths(decoder):
    for span in ("1d10t", "m.o.r", "mooron", "$tup1d", "a55!", "s-t-u"):
        paths = [((0, 0, 0), 0.0)]
        for options in [*decoder.lattice(span), [((0,), 0.0)]]:
            paths = [(_walked(decoder, path, cost + extra, emitted)) for path, cost in paths for emitted, extra in options]
        least = min(c for _, c in paths)
        assert decoder(span) in {"".join(" abcdefghijklmnopqrstuvwxyz"[k] for k in p[3:]).strip() for p, c in paths if c <= least + 1e-4}


def _walked(decoder, path, cost, emitted):
    for k in emitted:
        if k or path[-1]:
            cost += decoder.table[((path[-3] * 28 + path[-2]) * 28 + path[-1]) * 28 + k]
            path = (*path, k)
    return path, cost


def test_words_far_from_numbers_are_one_piece(spark):
    """Pieces near marked words stand where they stood when the whole text was taken apart, and no more of them are made."""
    rng = random.Random(3)
    some = lambda: rng.choice(["a", "été", "x1", "@", "7", "日本", "𝒳y", "b2c", "(3)"] + ["word"] * 12) + rng.choice([" ", "  ", "\n", "\t "])
    texts = [rng.choice(["", " ", "\n "]) + "".join(some() for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "1", " 1", "w " * 5000 + "card 12" + " w" * 5000]
    got = pii.near_pieces(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("t", "__pieces", "__lengths").collect()
    assert [r.t for r in got] == texts
    for r in got:
        whole = re.split(r"(?<=\s)(?=\S)", r.t) if re.search("[0-9@]", r.t) else []
        starts = [sum(len(p) for p in whole[:i]) for i in range(len(whole))] if len(whole) < 200 else list(np.cumsum([0] + [len(p) for p in whole])[:-1])
        near = {i + k for i, p in enumerate(whole) if re.search("[0-9@]", p) for k in range(-2, 3) if 0 <= i + k < len(whole)}
        at, seen = 0, {}
        for p, n in zip(r["__pieces"], r["__lengths"], strict=True):
            assert not p or len(p) == n
            seen |= {at: p} if p else {}
            at += n
        assert at == sum(map(len, whole)) and all(seen.get(starts[i]) == whole[i] for i in near)
    assert len(got[-1]["__pieces"]) == 12


def test_pattern_totals_take_texts_apart_once(spark):
    texts = spark.createDataFrame([("Pay card 12 now",), (" card  99\tpay card x ",), ("",), (None,)], "t string").select(F.coalesce("t", F.lit("")).alias("t"))
    totals = pii.pattern_totals(texts, "t", spark.createDataFrame([("L1 card",), ("L2 pay card",), ("R2 card 00",), ("R1 none",)], "pattern string"))
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("split(regexp_replace(lower(") == 1
    assert {r.pattern: r.total for r in totals.collect()} == {"L1 card": 3, "L2 pay card": 2, "R2 card 00": 2}
