"""Quality rules: word and line rules of a text, and bands of its perplexity under a character n-gram model.

The model is modified Kneser-Ney (interpolated, three discounts for each order) over the characters of words, one model for
each language, counted by Spark over every text. A word is read on its own: it starts in an empty context and ends in an end
mark. Texts are folded to lower case and decimal digits to 0. Tasks count the distinct words of a slice with their
frequency, so what is shuffled is the distinct n-grams of a task; the lower orders, their continuation counts and the
discounts come from that table by grouping. Probabilities and back-off weights are stored in shared files as sorted arrays of
64-bit hashes of (language, order, kind, n-gram) with a value beside each, one pair of files for each range of hashes. Workers
map the files and look into those whose range has what they ask for.

A text's score is its mean negative log probability of a character (the log of its perplexity). The band of a language reaches from
median - low * m - c to median + high * m + c, with m = 1.4826 * MAD and c = CHANCE * s / sqrt(characters), where s is the
language's spread of a single character: a short text may stray further by chance. Medians are exact and come from the texts that pass the base rules, equal
scores of equal length once, so a large group of copies does not narrow the band. Below the band a text is rejected as too
regular (signs strung together), above as not of its language. ``LOW``, ``HIGH`` and ``CHANCE`` were set on labelled rows: of
those that the base rules pass they reject 40 % of the poor and 1 % of the good (README).

Defined results: a null, empty or blank text has no words, fails the base rules and has no perplexity and no band; a null language is a language of its own; equal
rows have equal results; very long texts are read whole, as slices of their own; an empty table gives no row. Characters are
held in 16 bits: all of the supplementary planes are one character of the model. ``row`` is a struct, so no column can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.llm.common import hinted, lean, map_file, mix, per_row, ready, stored, text_slices, words_of, write_file
from sightgrid.operators.quantiles import exact_percentiles
from sightgrid.session import fresh_folder

ORDER = 4
END, LOWEST, HIGHEST = 1, 2, 0xFFFF  # end mark; characters are held in 16 bits, those that do not fit as one
SLICE = 12 << 20
LOW, HIGH, CHANCE = 0.5, 1.0, 2.0  # of the band: below and above the median, and for the chance in short texts
SYMBOLS = "[#*$%&|<>]"
SCORES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
          ("n_repeat_words", T.LongType()), ("log_prob", T.DoubleType()), ("log_prob_sq", T.DoubleType()), ("chars", T.LongType())]


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of every n-gram of order ``ORDER``, first n-gram of each word and the end): four characters of 16 bits each."""
    import pyarrow.compute as pc

    folded = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), "[0-9]", "0")
    size = np.asarray(pc.utf8_length(folded), dtype=np.int64)
    points = np.frombuffer("".join(folded.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate([[0], np.cumsum(size + 1)])  # a gram for each character and the end
    pad = ORDER - 1
    at = np.zeros(int((size + 1 + pad).sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(size + 1 + pad)])[:-1]
    ends = np.cumsum(size)
    inside = np.arange(len(points)) - np.repeat(ends - size, size)
    at[np.repeat(first + pad, size) + inside] = np.clip(points, LOWEST, HIGHEST)
    at[first + pad + size] = END
    code = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        code[k:] |= at[:len(at) - k] << np.uint64(16 * k)
    keep = np.ones(len(at), bool)
    for k in range(pad):
        keep[first + k] = False
    return code[keep], starts


def _by_language(part: pa.RecordBatch):
    lang = part.column("lang").dictionary_encode()
    names = lang.dictionary.to_pylist() + [None]
    codes = np.asarray(lang.indices.fill_null(len(names) - 1), dtype=np.int64)
    return names, codes


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("count", pa.int64())])
    for batch in batches:
        for part in text_slices(batch, limit=SLICE):
            names, codes = _by_language(part)
            offsets, code, words = words_of(part.column("text"))
            of_word = np.repeat(codes, np.diff(offsets))
            for k in np.unique(codes):
                times = np.bincount(code[of_word == k], minlength=len(words))
                used = np.flatnonzero(times)
                if not len(used):
                    continue
                grams, starts = grams_of(words.take(pa.array(used)))
                order = np.argsort(grams)
                grams, weight = grams[order], np.repeat(times[used], np.diff(starts))[order]
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(first), pa.string()), pa.array(grams[first].view(np.int64)),
                                                  pa.array(np.add.reduceat(weight, first))], schema=schema)


def entries(counts: DataFrame) -> DataFrame:
    """lang, k, kind ('p': probability part of a gram, 'g': back-off weight of a context), gram, value."""
    grams, out = counts, None
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            mask = (1 << 16 * k) - 1
            grams = grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("count"))
            grams = stored(grams, f"grams-{k}") if k > 1 else grams
        of = [F.sum(F.when(F.col("count") == c, 1).otherwise(0)).alias(f"n{c}") for c in (1, 2, 3, 4)]
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

        def discount(c, y=y):  # half the count where there are too few n-grams to tell, and never all or nothing of it
            d = F.coalesce(c - (c + 1) * y * F.try_divide(f"n{c + 1}", f"n{c}"), F.lit(0.5 * c))
            return F.greatest(F.lit(0.05), F.least(d, F.lit(c - 0.05))).alias(f"d{c}")

        with_nulls = F.coalesce("lang", F.lit("\x00"))
        rows = grams.withColumns({"l": with_nulls, "context": F.shiftrightunsigned("gram", 16)})
        held = rows.groupBy("l").agg(*of).select(
            "l", *[discount(c) for c in (1, 2, 3)])
        sums = rows.groupBy("l", "context").agg(
            F.sum("count").alias("total"), *[F.sum(F.when(F.col("count") == c, 1).otherwise(0)).alias(f"m{c}") for c in (1, 2)],
            F.sum(F.when(F.col("count") > 2, 1).otherwise(0)).alias("m3"), F.count(F.lit(1)).alias("kinds"))
        sums = sums.join(held, "l").withColumn("rest", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        part = (F.col("count") - F.when(F.col("count") == 1, F.col("d1")).when(F.col("count") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        if k == 1:  # below the single characters all are alike, one place is left for those never seen
            part = part + F.col("rest") / (F.col("kinds") + 1)
        p = rows.join(sums, ["l", "context"]).select("lang", F.lit(k).alias("k"), F.lit("p").alias("kind"), "gram", part.alias("value"))
        rest = F.col("rest") / (F.col("kinds") + 1) if k == 1 else F.col("rest")
        g = sums.select(F.when(F.col("l") != "\x00", F.col("l")).alias("lang"), F.lit(k).alias("k"), F.lit("g").alias("kind"),
                        F.col("context").alias("gram"), rest.alias("value"))
        out = p.union(g) if out is None else out.union(p).union(g)
    return out


def _slots(lang, k: int, kind: str, grams: np.ndarray) -> np.ndarray:
    import hashlib

    salt = int.from_bytes(hashlib.blake2b(f"{lang!r} {k} {kind}".encode(), digest_size=8).digest(), "little")
    return mix(grams.view(np.uint64) ^ np.uint64(salt)).view(np.int64)


def _hash_entries(batches):
    schema = pa.schema([("slot", pa.int64()), ("value", pa.float32())])
    for batch in batches:
        name = np.array([f"{a!r}\0{k}\0{kind}" for a, k, kind in zip(*(batch.column(c).to_pylist() for c in ("lang", "k", "kind")))])
        grams, slot = np.asarray(batch.column("gram")), np.zeros(batch.num_rows, np.int64)
        for one in np.unique(name):
            at = np.flatnonzero(name == one)
            row = batch.slice(int(at[0]), 1).to_pylist()[0]
            slot[at] = _slots(row["lang"], row["k"], row["kind"], grams[at])
        yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("value").cast(pa.float32())], schema=schema)


def _array_writer(folder: str):
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            shard, attempt = TaskContext.get().partitionId(), f"try{TaskContext.get().taskAttemptId()}"
            for column, kind in (("slot", "<i8"), ("value", "<f4")):
                write_file(f"{folder}/{shard:06d}.{column}", [np.asarray(b.column(column)).astype(kind).tobytes() for b in tables], attempt)
            yield pa.RecordBatch.from_pydict({"shard": [shard]}, schema=pa.schema([("shard", pa.int32())]))

    return run


def train(docs: DataFrame) -> tuple[str, list[int]]:
    """Count the n-grams of every text and store the model; returns its folder and shard numbers."""
    spark = ready(docs).sparkSession
    counts = (docs.select("lang", "text").mapInArrow(lean(_count), "lang string, gram long, count long")
              .groupBy("lang", "gram").agg(F.sum("count").alias("count")))
    hashed = entries(stored(counts, "grams")).mapInArrow(lean(_hash_entries), "slot long, value float")
    folder = fresh_folder(spark, "perplexity")
    ordered = hashed.groupBy("slot").agg(F.max("value").alias("value")).repartitionByRange("slot").sortWithinPartitions("slot")
    shards = stored(ordered.mapInArrow(lean(_array_writer(folder)), "shard int"), "model")
    return folder, sorted(r.shard for r in shards.collect())  # one number for each file


_models: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def _load(folder: str, shards: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, values) of every shard, in the order of their ranges."""
    if folder not in _models:
        _models.clear()
        _models[folder] = [(map_file(f"{folder}/{s:06d}.slot", "<i8"), map_file(f"{folder}/{s:06d}.value", "<f4")) for s in shards]
    return _models[folder]


def log_probs(model: list[tuple[np.ndarray, np.ndarray]], lang, grams: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each gram's last character after the others."""
    firsts = np.array([slots[0] for slots, _ in model], np.int64)

    def look(k, kind, codes, default):
        want, out = _slots(lang, k, kind, codes), np.full(len(codes), default)
        shard = np.searchsorted(firsts, want, side="right") - 1
        for one in np.unique(shard[shard >= 0]):
            slots, values = model[one]
            mine = np.flatnonzero(shard == one)
            at = np.searchsorted(slots, want[mine], side="right") - 1  # the shard's first hash is not above any of these
            seen = slots[at] == want[mine]
            out[mine[seen]] = values[at[seen]]
        return out

    grams, where = np.unique(grams, return_inverse=True)
    chance = look(1, "p", grams & np.uint64(0xFFFF), 0.0)
    unseen = look(1, "g", np.zeros(1, np.uint64), 1e-6)[0]
    chance = np.where(chance > 0, chance, unseen)
    for k in range(2, ORDER + 1):
        gram = grams & np.uint64((1 << 16 * k) - 1)
        chance = look(k, "p", gram, 0.0) + look(k, "g", gram >> np.uint64(16), 1.0) * chance
    return np.log(np.maximum(chance, 1e-12))[where]


def repeat_words(offsets: np.ndarray, code: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more."""
    n, text = len(code), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    covered = np.zeros(n + 1, np.int64)
    if n >= width:
        whole = np.flatnonzero(text[:n - width + 1] == text[width - 1:])
        h = mix(text[whole].astype(np.uint64))
        for k in range(width):
            h = mix(h ^ (code[whole + k].astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = whole[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(whole) else whole
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    return per_row(offsets, (np.cumsum(covered[:n]) > 0).astype(np.int64))


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(part: pa.RecordBatch, model) -> list[pa.Array]:
    """The columns of ``SCORES`` for a slice with text and lang."""
    import pyarrow.compute as pc

    texts = part.column("text")
    offsets, code, words = words_of(texts)
    names, codes = _by_language(part)
    length = np.asarray(pc.utf8_length(words), dtype=np.int64)
    pairs, place = np.unique(np.repeat(codes, np.diff(offsets)) * max(1, len(words)) + code, return_inverse=True)
    total, square, chars = np.zeros(len(pairs)), np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    for k in np.unique(codes):
        at = np.flatnonzero(pairs // max(1, len(words)) == k)
        if len(at):
            grams, starts = grams_of(words.take(pa.array(pairs[at] % len(words))))
            lp = log_probs(model, names[k], grams)
            total[at], square[at] = np.add.reduceat(lp, starts[:-1]), np.add.reduceat(lp * lp, starts[:-1])
            chars[at] = np.diff(starts)
    return [pa.array(np.diff(offsets)), pa.array(per_row(offsets, length[code])),
            pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()), pa.array([dup_lines(t) for t in texts.to_pylist()], pa.int64()),
            pa.array(repeat_words(offsets, code)), pa.array(per_row(offsets, total[place])), pa.array(per_row(offsets, square[place])),
            pa.array(per_row(offsets, chars[place]))]


def _scorer(folder: str, shards: list[int], keep: list[str]):
    def run(batches):
        from sightgrid.llm import quality

        model = quality._load(folder, shards)
        for batch in batches:
            row = batch.column(0)
            flat = pa.RecordBatch.from_arrays([row.field("text").cast(pa.large_string()), row.field("lang")], ["text", "lang"])
            at = 0
            for part in text_slices(flat, limit=SLICE):
                here = row.slice(at, part.num_rows)
                kept = pa.StructArray.from_arrays([here.field(c) for c in keep], fields=[row.type.field(c) for c in keep])
                yield pa.RecordBatch.from_arrays([kept, part.column("lang"), *quality.measure(part, model)], ["row", "lang", *[n for n, _ in SCORES]])
                at += part.num_rows

    return run


def assess(docs: DataFrame, keep: list[str], below: float = LOW, above: float = HIGH) -> DataFrame:
    """``row`` (struct of the columns ``keep``), the scores, perplexity, its band, base_failed and kept of every document."""
    folder, shards = train(docs)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField("lang", T.StringType()), *[T.StructField(n, t) for n, t in SCORES]])
    need = list(dict.fromkeys([*keep, "text", "lang"]))
    scored = docs.select(F.struct(*need).alias("row")).mapInArrow(lean(_scorer(folder, shards, keep)), schema)
    scored = stored(scored, "scored")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    mean = -F.col("log_prob") / F.col("chars")
    rows = scored.withColumns({"base_failed": failed, "score": F.when(F.col("chars") > 0, mean)})
    good = rows.where("not base_failed")
    lang = F.coalesce(F.col("lang"), F.lit("\x00"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("log_prob_sq") / F.sum("chars") - F.pow(F.sum("log_prob") / F.sum("chars"), 2)))
    spreads = good.groupBy(lang.alias("l")).agg(spread.alias("spread"))
    distinct = good.select(lang.alias("l"), "score", "chars").distinct()
    middle = exact_percentiles(distinct, ["l"], F.col("score"), {"median": (0.5, "linear")}).select("l", "median")
    middle = hinted(stored(middle.join(spreads, "l"), "middle"))  # one row for each language
    away = distinct.join(middle.withColumnRenamed("l", "m"), F.col("l") == F.col("m")).select("l", F.abs(F.col("score") - F.col("median")).alias("off"))
    off = exact_percentiles(away, ["l"], F.col("off"), {"mad": (0.5, "linear")}).select("l", "mad")
    band = hinted(stored(middle.join(off, "l").withColumnRenamed("l", "m"), "bands"))
    wide, chance = 1.4826 * F.col("mad"), F.try_divide(CHANCE * F.col("spread"), F.sqrt("chars"))  # null for a text without words
    low, high = F.exp(F.col("median") - below * wide - chance), F.exp(F.col("median") + above * wide + chance)
    out = rows.join(band, lang == F.col("m"), "left").withColumns({"perplexity": F.exp("score"), "low": low, "high": high})
    inside = F.coalesce((F.col("perplexity") >= F.col("low")) & (F.col("perplexity") <= F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("m", "median", "spread", "mad", "score", "log_prob_sq", "lang")


def kept_documents(docs: DataFrame, below: float = LOW, above: float = HIGH) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and lie in their language's band."""
    return assess(docs, docs.columns, below, above).where("kept").select("row.*")
