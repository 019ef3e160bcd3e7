import random

import pytest

from sightgrid.llm import jaccard_join, queries
from tests.llm.helpers import SCHEMA, WORD, documents, given


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, by comparing every pair."""
    sets = []
    for r in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def same(docs):
    got = jaccard_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs.select("doc_id", "text").collect())


def test_table_against_all_pairs(spark):
    got = queries.op2_jaccard_join(spark, "/root/testdata/sf0.01").select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(given(spark, sf="0.01").select("doc_id", "text").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_and_chains(spark, seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    line, rows = " ".join(pick.choices(words, k=30)), []
    for g in range(12):
        base = pick.choices(words, k=pick.choice([3, 5, 9, 40, 120]))
        now = list(base)
        for k in range(pick.choice([1, 4, 25])):
            edit = list(now if pick.random() < 0.4 else base)  # chains drift, stars do not
            for _ in range(pick.randint(0, max(1, len(edit) // 40))):
                edit[pick.randrange(len(edit))] = pick.choice(words)
            now = edit
            text = " ".join(edit) + (" " + line if pick.random() < 0.3 else "")
            rows.append((len(rows) if pick.random() < 0.97 else None, text.upper() if pick.random() < 0.2 else text, "en", "s", 0))
    pick.shuffle(rows)
    same(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.mark.parametrize("step", [(1.18, 1.19, 3), (1.06, 1.24, 8)])
def test_nested_cuts_and_extensions(spark, step):
    """Neighbours of a chain of nested texts link; those farther apart do not, by their sizes alone."""
    pick, rows = random.Random(3), []
    for g in range(25):
        n, size = pick.randint(60, 140), []
        for _ in range(step[2]):
            size.append(n)
            n = int(n * pick.uniform(*step[:2]))
        words = [f"g{g}w{k}" for k in range(size[-1])]
        at = pick.choice([0, 1])  # cut at the end or on both sides
        rows += [(len(rows) + k, " ".join(words[at * (size[-1] - m) // 2:][:m]), "en", "s", 0) for k, m in enumerate(size)]
    pick.shuffle(rows)
    same(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_awkward_rows(spark):
    docs = documents(spark)
    same(docs)
    out = jaccard_join.first_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert jaccard_join.similar_groups(docs.where("false")).count() == 0
    assert jaccard_join.first_of_each_group(docs.where("false")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = given(spark)
    want = {c for d, n, c in brute(docs.collect())}
    assert sorted(r.doc_id for r in jaccard_join.first_of_each_group(docs).collect()) == sorted(want)
