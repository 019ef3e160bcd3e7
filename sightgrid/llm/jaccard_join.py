"""Exact similarity join of documents by the Jaccard similarity of their word shingles, with set relations used to skip work.

A text is lower-cased (A-Z only) and cut into words; its set is its distinct shingles of five words, each known by a 64-bit
hash. Two sets link when 100 * intersection >= 80 * union. Nothing is approximate but the hashes.

1. Equal sets are one class; only classes are joined, so exact copies cost one row each.
2. A class stays a candidate if enough of its prefix (its first hashes) is shared with other classes: sets that link share at
   least ``least`` hashes of their extended prefixes. Hashes are exchanged packed, once for each slice and hash, so a hash that
   very many documents have is a few entries; no pair is formed here.
3. Candidates with the same least hash, under one of ``KEYS`` orders, are compared with one of them: the one whose hashes are
   the most frequent, so an original rather than an edited copy. Of those that a candidate links with, the nearest is its
   pivot, and the candidates of one pivot are a cluster with known distances.
4. Candidates are ordered anew, the hashes that very many of them have last, and indexed by prefix. Index lists hold one entry for each cluster with the range of sizes and the best position (entries after the prefix's hash);
   lists are ordered by size and read in blocks, and blocks whose sizes or positions rule out a link are skipped, as are
   clusters that are connected already. What is left are pairs of clusters, and their pivots are compared.
5. The members' answers derive from their pivots': the Jaccard distance is a metric, so members x and y of clusters whose
   pivots are D apart can link only if D <= 0.2 + d(x) + d(y). Only such pairs, of clusters not yet connected, are compared.

Defined results: a null, empty or blank text has no shingles and is its own component; fewer than five words are one shingle;
a null doc_id is a row like others, and the component of rows without any doc_id is null; repeated rows and rows of one id
with different texts are rows of their own; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.llm.common import components, lean, mix, ready, stored, text_slices, words_of

WIDTH, NEED, OF = 5, 80, 100  # NEED / OF: the least similarity
HEAVY, HEAVY_HERE = 1 << 19, 3  # hashes put last in the order (an order only; any order is exact), and the least count in a batch
SLICE, BLOCK, KEYS = 12 << 20, 64, 4
FILTER_BITS, FILTER_CHUNK = 28, 1 << 19  # most bits (as a power of two) of the filter that finds candidates' texts; bits of a part
LIMIT = 1 - NEED / OF + 1e-9


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import pyarrow.compute as pc
    import xxhash

    offsets, code, words = words_of(pc.ascii_lower(texts))
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    h = of_word[code]
    n = len(h)
    whole = np.full(max(0, n - WIDTH + 1), WIDTH, np.uint64)
    for k in range(WIDTH if n >= WIDTH else 0):
        whole = mix(whole ^ (h[k:n - WIDTH + 1 + k] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(whole[a:b - WIDTH + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(b - a):
                one = mix(one ^ (h[a + k:a + k + 1] + np.uint64((k + 7) * 0x9E3779B97F4A7C15 % (1 << 64))))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(one: np.ndarray) -> int:
    """The set's own 64-bit hash, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).astype(np.int64))


def smallest(n: int) -> int:
    """The least size of a set that links with one of size ``n``, and so the least intersection."""
    return -(-n * NEED // OF)


def least(n: int) -> int:
    return 1 + n // 12


def extended(n: int) -> int:
    return min(n, n - smallest(n) + least(n))


def _classes(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("class", pa.int64()), ("n_shingles", pa.int64())])
    for batch in batches:
        for part in text_slices(batch, limit=SLICE):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64())], schema=schema)


_PACKED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("shared", pa.binary())])


def _prefix_hashes(buckets: int):
    """Rows of one bucket: hashes with one owner here; hashes with several (owner 0); and, of those, what their owners share."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                sets = {class_of(s): s for s in shingle_sets(part.column("text")) if len(s)}
                if not sets:
                    continue
                owners = np.fromiter(sets, np.int64, len(sets))
                prefixes = [s[:extended(len(s))] for s in sets.values()]
                hashes = np.concatenate(prefixes)
                owner = np.repeat(owners, [len(p) for p in prefixes])
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
                start = np.flatnonzero(first)
                several = np.diff(np.append(start, len(hashes))) > 1
                known, times = np.unique(owner[np.repeat(several, np.diff(np.append(start, len(hashes))))], return_counts=True)
                one, sole = hashes[start], np.where(several, 0, owner[start])
                bucket = (one & np.uint64(buckets - 1)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, one, sole, several = bucket[order], one[order], sole[order], several[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = [(int(bucket[a]), one[a:b].tobytes(), sole[a:b].tobytes(), np.packbits(several[a:b]).tobytes())
                        for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]
                for a in range(0, len(known), 1 << 16):  # what is known already goes along, marked by an empty list
                    rows.append((int(known[a]) & (buckets - 1), b"", known[a:a + (1 << 16)].tobytes(), times[a:a + (1 << 16)].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

    return run


def _shared_hashes(key, table):
    """(class, hashes it shares with other classes) of one bucket."""
    hashes, owners, several, out = [], [], [], []
    for row in table.select(["hashes", "owners", "shared"]).to_pylist():
        if row["hashes"]:
            hashes.append(np.frombuffer(row["hashes"], np.uint64))
            owners.append(np.frombuffer(row["owners"], np.int64))
            several.append(np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=len(hashes[-1])).astype(bool))
        else:
            out.append((np.frombuffer(row["owners"], np.int64), np.frombuffer(row["shared"], "<i8")))
    if hashes:
        h, o, s = np.concatenate(hashes), np.concatenate(owners), np.concatenate(several)
        order = np.argsort(h, kind="stable")
        h, o, s = h[order], o[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        # shared by two classes: several in one slice, or owners that differ
        shared = np.logical_or.reduceat(s, start) | (np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start))
        size = np.diff(np.append(start, len(h)))
        o, mask = o, np.repeat(shared, size) & ~s
        pairs = np.unique(np.rec.fromarrays([h[mask], o[mask]])) if mask.any() else None
        if pairs is not None:  # one class in several slices counts once for each hash
            out.append(np.unique(pairs.f1, return_counts=True))
    classes = np.concatenate([c for c, _ in out]) if out else np.zeros(0, np.int64)
    counts = np.concatenate([n for _, n in out]) if out else np.zeros(0, np.int64)
    return pa.table([pa.array(classes, pa.int64()), pa.array(counts.astype(np.int64))], names=["class", "shared"])


def _filter_part(key, table):
    """One part of the bit field that has the candidates' texts."""
    bits = np.zeros(FILTER_CHUNK, np.uint8)
    bits[np.asarray(table["bit"])] = 1
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])


def text_filter(spark, keys: DataFrame, n: int):
    """A broadcast bit field of at most 2^FILTER_BITS bits that has every key of ``keys`` (text_key): it only saves work, since
    what it lets through is joined exactly afterwards.
    """
    size = max(FILTER_CHUNK, min(1 << FILTER_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    at = F.pmod("text_key", F.lit(size))
    parts = keys.select(F.floor(at / FILTER_CHUNK).alias("part"), (at % FILTER_CHUNK).alias("bit")).groupBy("part").applyInArrow(
        _filter_part, "part long, bits binary").collect()  # of fixed size, whatever the keys
    field = np.zeros(size // 8, np.uint8)
    for r in parts:
        field[r["part"] * FILTER_CHUNK // 8:(r["part"] + 1) * FILTER_CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(field)


def _sets(held):
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])

    def run(batches):
        field = held.value
        for batch in batches:
            at = np.asarray(batch.column("text_key")) % (8 * len(field))
            batch = batch.filter(pa.array((field[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for part in text_slices(batch, limit=SLICE):
                sets = {class_of(s): s for s in shingle_sets(part.column("text")) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets.values()], pa.binary())], schema=schema)

    return run


def _frequent(batches):
    schema = pa.schema([("hash", pa.int64()), ("count", pa.int64())])
    for batch in batches:
        lists = [np.frombuffer(b, np.uint64) for b in batch.column("members").to_pylist()]
        if lists:
            h, n = np.unique(np.concatenate(lists), return_counts=True)
            keep = n >= HEAVY_HERE
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], schema=schema)


def _index_entries(held):
    """``held``: sorted frequent hashes, their counts and their places in the order, the most frequent last."""

    def run(batches):
        heavy, _, rank = held.value
        schema = pa.schema([("hash", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("rest", pa.int64())])
        for batch in batches:
            for c, n, b in zip(*(batch.column(k).to_pylist() for k in ("class", "n", "members"))):
                s = np.frombuffer(b, np.uint64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    late = heavy[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(rank[at[late]], kind="stable")]])
                k = n - smallest(n) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(s[:k].view(np.int64)), pa.array([c] * k, pa.int64()), pa.array([n] * k, pa.int64()),
                    pa.array(n - np.arange(k))], schema=schema)

    return run


def _keys(held):
    """The least hash of each candidate under each order, and how frequent its hashes are on the whole."""

    def run(batches):
        heavy, count, _ = held.value
        schema = pa.schema([("order", pa.int32()), ("key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("weight", pa.float64())])
        for batch in batches:
            rows = []
            for c, n, b in zip(*(batch.column(k).to_pylist() for k in ("class", "n", "members"))):
                s, weight = np.frombuffer(b, np.uint64), 0.0
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    weight = float(np.log(count[at[heavy[at] == s]]).sum() / n)
                rows += [(k, int(mix(s ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).min().astype(np.int64)), c, n, weight) for k in range(KEYS)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _joined_batches(make):
    """Small batches of one schema as larger ones."""

    def run(batches):
        wait, rows = [], 0
        for batch in make(batches):
            wait.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
                wait, rows = [], 0
        if rows:
            yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]

    return run


def _compare(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("slack", pa.float64()), ("common", pa.int64())])
    for batch in batches:
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                  for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb", "slack")), pa.array(common, pa.int64())], schema=schema)


def compared(pairs: DataFrame, sets: DataFrame, slack="0D") -> DataFrame:
    """``pairs`` (a, b) with distance and whether they link.

    Pairs whose sizes alone put them farther apart than LIMIT + ``slack`` (an expression over ``pairs``) are left out: sets of m
    and n >= m hashes are at least 1 - m / n apart. Pairs of pivots need the reach of their clusters as slack.
    """
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.withColumn("slack", F.expr(slack)).join(left, "a").join(right, "b").where(
        F.least("na", "nb") >= F.greatest("na", "nb") * (F.lit(1 - LIMIT) - F.col("slack")))
    out = both.mapInArrow(lean(_compare), "a long, b long, na long, nb long, slack double, common long")
    union = F.col("na") + F.col("nb") - F.col("common")
    return stored(out.select("a", "b", "slack", (F.lit(1.0) - F.col("common") / union).alias("distance"), (F.col("common") * OF >= union * NEED).alias("link")), "compared")


def _cluster_pairs(batches):
    """Pairs of clusters of one hash's list that may hold a link; rows come ordered by hash and size."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    seen: set = set()
    for rows in _lists(batches):
        pivot, joint, low, high, rest = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4, 5))
        for at in range(1, len(pivot)):
            start = 0
            while start < at:  # by blocks of the list before this entry: of sizes that fit, and positions that leave enough
                end = min(at, start + BLOCK)
                # an intersection of 0.8 of the union is at least 0.8 / 1.8 of the two sizes
                if high[start:end].max() * OF >= low[at] * NEED and min(rest[start:end].max(), rest[at]) * (OF + NEED) >= NEED * (low[start:end].min() + low[at]):
                    fit = ((high[start:end] * OF >= low[at] * NEED) & (high[at] * OF >= low[start:end] * NEED)
                           & (np.minimum(rest[start:end], rest[at]) * (OF + NEED) >= NEED * (low[start:end] + low[at])))
                    for k in np.flatnonzero(fit & (joint[start:end] != joint[at])) + start:
                        if pivot[k] != pivot[at]:
                            seen.add((int(min(pivot[k], pivot[at])), int(max(pivot[k], pivot[at]))))
                start = end
            if len(seen) >= 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in seen], pa.int64()) for k in (0, 1)], schema=schema)
                seen = set()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in seen], pa.int64()) for k in (0, 1)], schema=schema)


def _member_pairs(batches):
    """Members of one hash's list, of clusters not connected, whose sizes and positions leave a link open.

    With their pivots and how far they are from them together; two pivots themselves have been compared.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("x", "y", "a", "b")] + [("apart", pa.float64())])
    seen: dict = {}

    def out():
        return pa.RecordBatch.from_arrays([*[pa.array([p[k] for p in seen], pa.int64()) for k in range(4)],
                                           pa.array(list(seen.values()), pa.float64())], schema=schema)

    for rows in _lists(batches, ("hash", "class", "pivot", "component", "n", "rest", "distance")):
        one, pivot, joint, n, rest = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4, 5))
        away = np.array([r[6] for r in rows])
        for at in range(1, len(rows)):
            start = int(np.searchsorted(n, smallest(int(n[at]))))  # the list is ordered by size
            fit = (joint[start:at] != joint[at]) & (pivot[start:at] != pivot[at]) & (away[start:at] + away[at] > 0)
            fit &= np.minimum(rest[start:at], rest[at]) * (OF + NEED) >= NEED * (n[start:at] + n[at])
            for k in np.flatnonzero(fit) + start:
                i, j = (k, at) if pivot[k] < pivot[at] else (at, k)
                seen[int(one[i]), int(one[j]), int(pivot[i]), int(pivot[j])] = float(away[k] + away[at])
            if len(seen) >= 1 << 16:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _lists(batches, columns=("hash", "pivot", "component", "low", "high", "rest")):
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[0] != now:
                if len(rows) > 1:
                    yield rows
                now, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with class and n_shingles, sets of the candidate classes)."""
    texts = ready(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    rows = stored(texts.mapInArrow(lean(_classes), "doc_id long, text_key long, class long, n_shingles long"), "classes")
    buckets = 1 << max(6, min(18, (rows.count() >> 12).bit_length()))  # some thousand documents' hashes each
    packed = docs.select("text").mapInArrow(lean(_prefix_hashes(buckets)), "bucket int, hashes binary, owners binary, shared binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared_hashes, "class long, shared long")
    shared = shared.groupBy("class").agg(F.sum("shared").alias("shared"))
    one = rows.where("class is not null").groupBy("class").agg(
        F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n"))
    # the sum may count a hash once for each slice, never less often than it must: it only lets more through
    need = F.floor(F.ceil(F.col("n") * NEED / OF) / 12) + 1
    left = stored(one.join(shared, "class").where(F.col("shared") >= need).select("class", "text_key"), "candidates")
    # the texts are not shuffled: a bit field finds those of candidates, and their sets are joined with the candidates
    held = text_filter(docs.sparkSession, left.select("text_key"), left.count())
    sets = texts.select("text", "text_key").mapInArrow(lean(_sets(held)), "class long, n long, members binary")
    sets = sets.join(left.select("class"), "class", "left_semi").dropDuplicates(["class"])
    return rows, stored(sets, "sets")


def links(sets: DataFrame) -> DataFrame:
    """(a, b) of linked classes: all that connect the classes, by pivots and what their distances leave open."""
    often = sets.mapInArrow(lean(_frequent), "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))
    top = often.orderBy(F.desc("count"), "hash").limit(HEAVY).toArrow()  # HEAVY rows at most
    heavy, count = np.asarray(top["hash"], dtype=np.int64).view(np.uint64), np.asarray(top["count"], dtype=np.int64)
    order = np.argsort(heavy)
    heavy, count = heavy[order], count[order]
    rank = np.argsort(np.lexsort((heavy, count)))
    held = sets.sparkSession.sparkContext.broadcast((heavy, count, rank))
    heads = stored(sets.mapInArrow(lean(_keys(held)), "order int, key long, class long, n long, weight double"), "keys")
    lead = heads.groupBy("order", "key").agg(F.max(F.struct("weight", "n", "class")).alias("lead"))
    tries = heads.join(lead, ["order", "key"]).select(F.col("class").alias("a"), F.col("lead.class").alias("b"), "n", F.col("lead.n").alias("m"))
    tries = tries.where((F.col("a") != F.col("b")) & (F.col("n") * OF >= F.col("m") * NEED) & (F.col("m") * OF >= F.col("n") * NEED))
    to_pivot = compared(tries.select("a", "b").distinct(), sets).where("link")
    cluster = stored(to_pivot.groupBy(F.col("a").alias("class")).agg(F.min(F.struct("distance", "b")).alias("near")).select(
        "class", F.col("near.b").alias("pivot"), "near.distance"), "clusters")
    joint = components(to_pivot.select("a", "b")).withColumnRenamed("node", "class")
    index = sets.mapInArrow(lean(_joined_batches(_index_entries(held))), "hash long, class long, n long, rest long")
    placed = stored(index.join(cluster, "class", "left").join(joint, "class", "left").withColumns({
        "pivot": F.coalesce("pivot", "class"), "distance": F.coalesce("distance", F.lit(0.0)),
        "component": F.coalesce("component", "class")}), "index")
    lists = placed.groupBy("hash", "pivot", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    ordered = lists.repartition("hash").sortWithinPartitions("hash", "low")
    pairs = ordered.mapInArrow(lean(_cluster_pairs), "a long, b long").distinct()
    # how far from its pivot a cluster's members are: pivots of any sizes may be as far apart as that and LIMIT together
    reach = stored(cluster.groupBy(F.col("pivot").alias("p")).agg(F.max("distance").alias("reach")), "reach")
    for c in ("a", "b"):
        pairs = pairs.join(reach.select(F.col("p").alias(c), F.col("reach").alias(f"r{c}")), c, "left")
    reached = "coalesce(ra, 0D) + coalesce(rb, 0D)"
    between = compared(pairs, sets, reached)
    found = to_pivot.select("a", "b").union(between.where("link").select("a", "b"))
    # clusters not connected so far whose members' distances leave a link open
    open_pairs = stored(between.where("not link").where(F.col("distance") <= LIMIT + F.col("slack")).select("a", "b", "distance"), "open")
    if open_pairs.isEmpty():
        return found
    label = components(found)
    for c in ("a", "b"):
        open_pairs = open_pairs.join(label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    open_pairs = stored(open_pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "distance"), "unconnected")
    wanted = open_pairs.select(F.col("a").alias("pivot")).union(open_pairs.select("b")).distinct()
    members = placed.drop("component").join(wanted, "pivot", "left_semi").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    near = members.repartition("hash").sortWithinPartitions("hash", "n").mapInArrow(
        lean(_member_pairs), "x long, y long, a long, b long, apart double").distinct()
    near = near.join(open_pairs, ["a", "b"]).where(F.col("distance") <= LIMIT + F.col("apart"))
    rest = compared(near.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets)
    return found.union(rest.where("link").select("a", "b"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), class, n_shingles and component_id of every row."""
    rows, sets = candidates(docs)
    label = components(links(sets)).select(F.col("node").alias("class"), "component")
    of_class = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"))
    of_class = of_class.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    joint = of_class.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = of_class.join(joint, "component").select("class", "component_id", "component")
    return rows.join(of_class, "class", "left").select(
        "doc_id", "text_key", "class", "component", "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id (one of equal rows stays).

    Rows without shingles are linked with nothing and stay.
    """
    rows = similar_groups(docs)
    best = rows.where("class is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    keep = best.select(F.xxhash64("best.doc_id", "best.text_key").alias("k_row")).distinct()
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    order = Window.partitionBy("k_row").orderBy(F.lit(1))
    plain = docs.select(F.struct(*docs.columns).alias("k"), key.alias("k_row"), blank.alias("k_blank"))
    kept = plain.where("not k_blank").join(keep, "k_row").withColumn("k_n", F.row_number().over(order)).where("k_n = 1")
    return kept.select("k.*").unionByName(plain.where("k_blank").select("k.*"))
