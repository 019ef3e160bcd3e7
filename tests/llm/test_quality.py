import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightgrid.llm import quality, queries
from tests.llm.helpers import SCHEMA, WORD, documents, given


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


class KneserNey:
    """The model written from its definition, with dictionaries."""

    def __init__(self, texts):
        counts = Counter()
        for text in texts:
            for w in WORD.findall(text or ""):
                for g in self.grams(w):
                    counts[g] += 1
        self.tables = {quality.ORDER: counts}
        for k in range(quality.ORDER - 1, 0, -1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, table in self.tables.items():
            n = Counter(table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            self.discounts[k] = [0.0] + [
                max(0.05, min(c - 0.05, c - (c + 1) * y * n[c + 1] / n[c] if y is not None and n[c] else c / 2)) for c in (1, 2, 3)]
            of = defaultdict(list)
            for g, c in table.items():
                of[g[:-1]].append(c)
            self.contexts[k] = {h: (sum(cs), sum(self.discounts[k][min(c, 3)] for c in cs) / sum(cs), len(cs)) for h, cs in of.items()}

    @staticmethod
    def grams(word):
        folded = "".join("0" if c in "0123456789" else c for c in word.lower())
        chars = [0] * (quality.ORDER - 1) + [min(max(ord(c), 2), 0xFFFF) for c in folded] + [1]
        return [tuple(chars[i:i + quality.ORDER]) for i in range(len(chars) - quality.ORDER + 1)]

    def chance(self, gram, k=quality.ORDER):
        gram = gram[-k:]
        if k == 1:
            total, rest, kinds = self.contexts[1][()]
            lower = 1 / (kinds + 1)
        else:
            lower = self.chance(gram, k - 1)
            if gram[:-1] not in self.contexts[k]:
                return lower
            total, rest, _ = self.contexts[k][gram[:-1]]
        c = self.tables[k].get(gram, 0)
        return (c - self.discounts[k][min(c, 3)] if c else 0) / total + rest * lower


def test_repeats_and_lines_against_brute_force(spark):
    rows = quality.assess(documents(spark), ["doc_id"]).collect()
    want = sorted(base(r.text) for r in documents(spark).collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want


def test_model_against_its_definition(spark):
    docs = given(spark).where("doc_id < 60")
    texts = docs.select("lang", "text").collect()
    models = {lang: KneserNey([t.text for t in texts if t.lang == lang]) for lang in {t.lang for t in texts}}
    known = [g[0] for g in models["en"].tables[1]]
    assert sum(models["en"].chance((0, 0, ord("t"), c)) for c in [*known, 0xFFFE]) == pytest.approx(1)
    of = {r.doc_id: r for r in quality.assess(docs, ["doc_id", "lang"]).select("row.doc_id", "*").collect()}
    for r in docs.collect():
        lp = [math.log(models[r.lang].chance(g)) for w in WORD.findall(r.text) for g in KneserNey.grams(w)]
        assert of[r.doc_id].chars == len(lp)
        assert of[r.doc_id].log_prob == pytest.approx(sum(lp), rel=2e-3, abs=1e-6)


def test_an_unseen_gram_gets_no_foreign_value():
    pick = np.random.default_rng(4)
    grams = np.unique(pick.integers(1, 1 << 62, 1 << 20, dtype=np.uint64))
    known, unseen = grams[::2], grams[1::2]
    slots = np.unique(quality._slots("en", 4, "p", known))
    assert len(slots) == len(known)
    assert not np.isin(quality._slots("en", 4, "p", unseen), slots).any()
    cut = len(slots) // 3
    model = [(part, np.full(len(part), 0.5, "<f4")) for part in (slots[:cut], slots[cut:])]
    assert quality.log_probs(model, "en", known) == pytest.approx(math.log(0.5), abs=1e-5)
    assert quality.log_probs(model, "en", unseen) == pytest.approx(math.log(1e-6))


def test_query_keeps_prose_and_rejects_noise(spark):
    rows = {r.doc_id: r for r in queries.op7_quality(spark, "/root/testdata/sf0.001").collect()}
    for r in given(spark).collect():
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == base(r.text)
    docs = given(spark).where("lang = 'en'")
    pick = random.Random(7)
    junk = lambda letters, least: " ".join("".join(pick.choices(letters, k=pick.randint(least, 9))) for _ in range(300))
    noise = spark.createDataFrame([(10**6 + k, junk("bcdfghjklmnpqrstvwxz#%", 4), "en", "n", 0) for k in range(3)], SCHEMA)
    low = spark.createDataFrame([(2 * 10**6, junk("th", 1), "en", "n", 0)], SCHEMA)
    got = quality.assess(docs.unionByName(noise).unionByName(low), ["doc_id"]).select("row.doc_id", "*").collect()
    assert not any(r.kept for r in got if r.doc_id >= 10**6)
    prose = [r for r in got if r.doc_id < 10**6 and not r.base_failed and 200 * r.n_symbols < r.word_chars]
    assert sum(r.kept for r in prose) >= 0.98 * len(prose)  # a few mix languages


def test_bands_decide_on_labelled_rows(spark):
    """Of what the base rules pass, poor documents go and good ones stay."""
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").join(given(spark, "labels", "0.01"), "doc_id").where("not base_failed").collect()
    poor, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert sum(poor) <= 0.75 * len(poor) and len(poor) > 20
    assert sum(good) >= 0.97 * len(good)


def test_kept_documents(spark):
    docs = documents(spark)
    out = quality.kept_documents(docs)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert quality.kept_documents(docs.where("false")).count() == 0


def test_texts_without_words_beside_prose(spark):
    """A language with a band also has null, empty and blank texts: they fail the base rules, all others stay as they are."""
    docs = given(spark)
    blank = spark.createDataFrame([(10**6 + k, text, "en", "n", 0) for k, text in enumerate([None, "", " \n\t\r\x0b\x0c", "\n" * 3])], SCHEMA)
    alone = quality.assess(docs, ["doc_id"]).select("row.doc_id", "kept", "perplexity", "low", "high")
    got = {r.doc_id: r for r in quality.assess(docs.unionByName(blank), ["doc_id"]).select("row.doc_id", "*").collect()}
    for k in range(4):
        r = got.pop(10**6 + k)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False)
        assert r.perplexity is None and r.low is None and r.high is None
    assert {d: (r.kept, r.perplexity, r.low, r.high) for d, r in got.items()} == {r[0]: pytest.approx(tuple(r)[1:]) for r in alone.collect()}
    assert {r.doc_id for r in quality.kept_documents(docs.unionByName(blank)).collect()} == {d for d, r in got.items() if r.kept}
