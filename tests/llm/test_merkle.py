"""The manifest against a tree built row by row."""

import hashlib
import string
import zlib
from collections import Counter, defaultdict

from sightgrid.llm import merkle
from tests.llm.helpers import AWKWARD, SCHEMA, documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, for each node its levels of (before, after))."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // 16 * 16
            proofs[k].append((level[run:p], level[p + 1:run + 16]))
        level = [h(*level[r:r + 16]) for r in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], proofs


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        mine = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((mine, *tree([leaf(r) for r in mine])))
    root, above = tree([p[1] for p in parts])
    out = Counter()
    for (mine, sub, proofs), up in zip(parts, above):
        for row, proof in zip(mine, proofs):
            folded = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                folded = leaf((row[0], row[1].translate(LOWER), *row[2:]))
            for before, after in proof + up:
                folded = h(*before, folded, *after)
            siblings = h(*[x for b, a in proof + up for x in b + a])
            out[row[0], leaf(row), sub, root, siblings, folded, folded == root] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in merkle.verified(df).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_awkward_rows(spark):
    assert found(documents(spark)) == brute(AWKWARD)


def test_many_leaves_and_sources(spark):
    rows = [(k * 3, f"Text {k} Of Some Length", "en", "hot" if k % 3 else f"s{k % 41:02d}", k) for k in range(900)]
    rows += [(None, "No Id", None, None, None)] * 300 + [(6, "Twin", "de", "hot", 1)] * 40
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert any(not k[-1] for k in got)


def test_sizes_at_the_borders_of_runs(spark):
    for n in (1, 2, 16, 17, 256, 257):
        rows = [(k, f"A{k}", "en", "one", k) for k in range(n)]
        assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(df).collect() == []
