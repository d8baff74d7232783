"""Toxicity, quality and language models: held-out accuracy, the arithmetic, odd rows."""

import random
import zlib
from decimal import Decimal
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from basalt.llm import langid, quality, toxicity
from basalt.llm._text import segment_sums
from tests.llm.conftest import prose

P = pytest.importorskip("public_tokenizers")
PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean texts, texts with an insult beside a group's name, and shouting junk."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(700):
        text = prose(rng, rng.randint(20, 80))
        words = text.split()
        toxic = int(i % 3 == 0)
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), "blorf")
            words.insert(rng.randrange(len(words)), "martians")
        elif i % 3 == 1:
            words.insert(rng.randrange(len(words)), rng.choice(["blorf", "martians"]))
        junk = i % 7 == 0
        text = " ".join(w.upper() + "!!" for w in words[:10]) * 5 if junk and not toxic else " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not (junk and not toxic)), toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels + labels[:5], "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, column):
    rows = scored.join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").select("predicted", column).collect()
    assert len(rows) > 50
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_toxicity_learns_the_pair(labelled):
    docs, labels = labelled
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert accuracy(scored, labels, "toxic") > 0.9


def test_pairwise_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(factors=3)
    m.w, m.v, m.bias = rng.normal(size=9), rng.normal(size=(9, 3)), 0.5
    ids, offsets = np.array([1, 4, 7, 2, 8]), np.array([0, 3, 3, 5])
    wanted = []
    for a, b in zip(offsets, offsets[1:]):
        own = ids[a:b]
        wanted.append(0.5 + sum(m.w[i] for i in own) + sum(m.v[own[x]] @ m.v[own[y]] for x in range(len(own)) for y in range(x)))
    assert np.allclose(m.raw(ids, offsets), wanted)


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality") > 0.97
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, model).filter("predicted = 1").count()


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.Additive(pairs=2).fit(x[:2000], y[:2000])
    assert (1, 2) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_models_on_odd_rows(odd_docs, odd_texts, labelled, no_docs):
    docs, labels = labelled
    for module in (toxicity, quality):
        model = module.fit(docs, labels)
        rows = module.score(odd_docs, model).collect()
        assert len(rows) == len(odd_texts) + 2 and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r for r in rows}
        assert by[0].score == by[1].score  # null and empty
        assert module.score(no_docs, model).count() == 0
        untaught = module.fit(docs, labels.limit(0))
        assert {r.predicted for r in module.score(docs, untaught).collect()} <= {0, 1}
    assert quality.keep(odd_docs, quality.fit(docs, labels)).columns == odd_docs.columns


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    parts = {"aa": ["th", "er", "on", "ing"], "bb": ["ción", "mente", "ado", "que"], "cc": ["sch", "ung", "ein", "keit"]}
    rows = []
    for i in range(450):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 30)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def every_segmentation(word, place, share):
    """Sum over every way to cut ``word``, written out cut by cut."""
    total = np.zeros(2)
    for cuts in product([False, True], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        # a single character may also stand alone, at the share of what is unknown
        total += np.prod([(share[place[p]] if p in place else np.zeros(2)) + (1e-7 if len(p) == 1 else 0) for p in parts], axis=0)
    return np.log(total)


def exact_sum(word, place, share, lang):
    """The same sum for longer words, in numbers that cannot underflow."""
    alpha = [Decimal(1)]
    for j in range(1, len(word) + 1):
        total = alpha[j - 1] * Decimal("1e-7")
        for i in range(j):
            if word[i:j] in place:
                total += alpha[i] * Decimal(share[place[word[i:j]], lang])
        alpha.append(total)
    return float(alpha[-1].ln())


def test_forward_sums_all_segmentations(monkeypatch):
    pieces = langid.vocabulary(PIECES)
    lattice = langid.Lattice(pieces)
    place = {p: i + 1 for i, p in enumerate(lattice.pieces)}
    share = np.random.default_rng(0).random((len(lattice.pieces) + 1, 2)) * 1e-3
    share[0] = 0
    short = ["the", "threrating", "mentez", "x", "日本", "schöß", "international", "the"]
    assert np.allclose(lattice.log_probability(short, share), [every_segmentation("▁" + w, place, share) for w in short])
    longest = max(pieces, key=len)
    assert len(longest) > 10
    long = ["a" * 40, longest.strip("▁") * 3, "日本語" * 60, "internationalthe" * 40, "x" * 700]
    wanted = [[exact_sum("▁" + w, place, share, k) for k in (0, 1)] for w in long]
    assert np.allclose(lattice.log_probability(long, share), wanted)
    monkeypatch.setattr(langid, "CHUNK", 50)
    assert np.allclose(lattice.log_probability(long, share), wanted)


def test_fitting_raises_the_likelihood():
    lattice = langid.Lattice(langid.vocabulary(PIECES))
    words, counts = ["the", "then", "other", "hath" * 30], np.array([9.0, 2, 3, 1])
    told = [float(counts @ lattice.log_probability(words, lattice.fit(words, counts, n))[:, 0]) for n in (1, 2, 4)]
    assert np.isfinite(told).all() and told == sorted(told)


def test_texts_without_spaces_are_scored_whole(tongues):
    model = langid.fit(tongues, PIECES, per_language=100)
    spark = tongues.sparkSession
    texts = [("ción" * 500, "bb"), ("schung" * 400, "cc"), ("thering" * 300, "aa")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.identify(docs, model).orderBy("doc_id").collect()] == [lang for _, lang in texts]


def test_languages_held_out(tongues):
    model = langid.fit(tongues, PIECES, per_language=100)
    assert model[0] == ["aa", "bb", "cc"]
    rows = langid.identify(tongues, model).join(tongues, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert langid.keep(tongues, model).count() > 440


def test_languages_of_odd_rows(odd_docs, odd_texts, tongues, no_docs):
    model = langid.fit(tongues, PIECES, per_language=50)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    for i, t in enumerate(odd_texts):
        blank = not any(langid.LETTERS.search(c) for c in t or "")
        assert (got[i].lang_pred == "und") == blank, repr(t)[:60]
        assert 0 <= got[i].score <= 1
    assert langid.identify(no_docs, model).count() == 0
    none = langid.fit(no_docs, PIECES)
    assert {r.lang_pred for r in langid.identify(tongues, none).collect()} == {"und"}
    kept = langid.keep(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("text IS NULL").count() == 0


def test_segment_sums():
    flat = np.arange(6.0)
    assert segment_sums(flat, np.array([0, 0, 2, 2, 6, 6])).tolist() == [0, 1, 0, 14, 0]
    assert toxicity.TermSets().of(pa.array(["", None]))[1].tolist() == [0, 0, 0]


def hand_terms(text):
    """Hashed words and prefixes of a text, by the operator's description."""
    out = set()
    for word in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
        out.add(xxhash.xxh32_intdigest(word) >> 12)
        out |= {xxhash.xxh32_intdigest(word[:n], n) >> 12 for n in (4, 5) if len(word) > n}
    return out


def test_toxicity_scores_by_hand(labelled, odd_docs, odd_texts):
    """Terms, linear and pairwise part and probability of whole texts, one term at a time."""
    docs, labels = labelled
    machine = toxicity.fit(docs, labels)
    seen = set().union(*(hand_terms(r.text) for r in docs.join(labels, "doc_id", "left_semi").collect() if zlib.crc32(str(r.doc_id).encode()) % 5))
    assert set(machine.index) == seen  # every hashed term of the training texts has weights
    got = {r.doc_id: r for r in toxicity.score(odd_docs, machine).collect()}
    for i, text in enumerate(odd_texts):
        own = [machine.index[t] for t in hand_terms(text) if t in machine.index]
        raw = machine.bias + sum(float(machine.w[k]) for k in own)
        raw += sum(float(machine.v[a].astype(float) @ machine.v[b].astype(float)) for a, b in combinations(own, 2)) if len(own) < 200 else 0
        if len(own) < 200:
            assert abs(got[i].score - 1 / (1 + np.exp(-raw))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def hand_features(text):
    """The quality features of a text, counted word by word."""
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, chars = len(words), sum(map(len, words))
    many = lambda pattern, w: len(regex.findall(pattern, w))
    letters, upper, digits = (sum(many(p, w) for w in words) for p in (r"\p{L}", r"\p{Lu}", r"\p{N}"))
    tally = {w: words.count(w) for w in set(words)}
    return [
        np.log1p(n), chars / n, sum(bool(set(w) & set("#*$%&@^~_=<>{}\\")) for w in words) / n, sum("!" in w for w in words) / n, upper / max(letters, 1), digits / max(chars, 1),
        letters / max(chars, 1), sum("|" in w for w in words) / n, sum(w[-1] in ".,;:?" for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(tally) / n, max(tally.values()) / n, text.count("\n") / n,
    ]


def test_quality_scores_by_hand(labelled, odd_docs, odd_texts):
    texts = [t for t in odd_texts if len(t or "") < 5000 and (t or "").isascii()]
    assert np.allclose(quality.features_of(pa.array(texts, pa.string())), [hand_features(t) for t in texts])
    docs, labels = labelled
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(odd_docs, model).collect()}
    for i, text in enumerate(odd_texts):
        if text in texts:
            x = quality.features_of(pa.array([text], pa.string()))[0]  # same bits: a bin's edge decides
            bins = [sum(bool(v >= e) for e in edges) for v, edges in zip(x, model.edges)]
            raw = model.bias + sum(table[b] for table, b in zip(model.tables, bins))
            raw += sum(table[bins[j] * model.coarse // model.bins, bins[k] * model.coarse // model.bins] for (j, k), table in model.pairs.items())
            assert abs(got[i].score - 1 / (1 + np.exp(-raw))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)


def test_repeated_ids_do_not_swell_the_sample(spark):
    rows = [(i % 7, f"text {i}") for i in range(4000)] + [(100 + i, "a") for i in range(50)] + [(200, "same")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 200).collect()
    assert 100 < len(got) < 320
    whole = toxicity.labelled_sample(docs, labels, "toxic", 10_000).collect()
    wanted = {(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 and i < 300}
    assert {(r._id, r._text) for r in whole} == wanted and len(whole) == len(wanted)


def test_registered_queries(spark):
    """op3, op8 and op9 on all documents of the smallest tables."""
    from basalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, modulus, left in (("op3_toxicity", 5, 0), ("op8_quality", 5, 0), ("op9_language_id", 3, 1)):
        rows = QUERIES[name](spark, folder).collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) for r in rows)
