"""Spelling variants: words of the corpus that one inserted, deleted or replaced letter turns into each other.

Words are runs of letters, counted over all texts; a stated share of runs loses a letter first (a controlled noise, by the crc32
of document and run). Only words of some length and count go on.

Bit-sliced position index: a group of words is held as one bitset over the group for every (position, letter) and every length.
A query word is read letter by letter. Four bitsets move along: words that agree so far (zero errors), and words one error
away, by a replaced letter (same position), by a letter that the query has too many (position before) or by one that it lacks
(position after). Each step is some AND and OR operations on whole bitsets, so the work for a letter is the group's size / 64 or so.

Groups: one error lies in the first or the second half of a word, so the other half is equal. With L the shorter length and
h = L // 2, words of lengths L and L + 1 meet in the group of their first h letters and in that of their last h. The zero-error
set after h letters says which pairs the first group has already found. A group of more than ``BLOCK`` words is split into blocks,
and every block's words ask every block's index. Groups and blocks go to buckets of bounded size. No pair is written: an index
answers with each query's number of near words and the best of them, which are added up per word.

Scale: words are counted with partial sums before the shuffle, so a frequent word is no hot key; groups hold different words that share
half of their letters. Forms are followed to their roots by pointer jumping, in rounds logarithmic in the longest chain.

Defined results: a null text has no words; a null doc_id counts as an empty one in the noise; repeated rows count each; among near
words of one count the smallest in code-point order is the form; an empty table gives no row; texts are read whole.
Clashing extra columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.llm.common import hinted, ready, stored

LETTERS, NOISE = r"[A-Za-zÀ-ÿ]+", 199
MIN_LENGTH, MIN_COUNT, RATIO, BLOCK = 6, 5, 5, 1 << 15


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, of the words that take part."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(
        F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


class Index:
    """A bit for every word at every (position, letter) and length; a bitset is one integer over all words."""

    def __init__(self, words: list[str]):
        self.letters, self.lengths, self.all = {}, {}, (1 << len(words)) - 1
        for k, word in enumerate(words):
            bit = 1 << k
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            for at in enumerate(word):
                self.letters[at] = self.letters.get(at, 0) | bit

    def near(self, query: str, short: int, apart: int = 0) -> int:
        """The words one error from ``query`` where the shorter of the two has ``short`` letters.

        Without those that share its first ``apart`` letters, if that is positive.
        """
        get, known = self.letters.get, 0
        same, replaced, extra, missing = self.all, 0, 0, 0
        for i, c in enumerate(query):
            here = get((i, c), 0)
            replaced = replaced & here | same & ~here
            missing = (missing | same) & get((i + 1, c), 0)  # the word has one more letter before this one
            extra = extra & get((i - 1, c), 0) | same  # this letter is the one too many
            same &= here
            if i + 1 == apart:
                known = same
        m, of = len(query), self.lengths.get
        found = replaced & of(m, 0) | (missing | same) & of(m + 1, 0) if m == short else extra & of(short, 0)
        return found & ~known


def members(bits: int) -> list[int]:
    """Numbers of the bits that are set, in order."""
    out = []
    while bits:
        out.append((bits & -bits).bit_length() - 1)
        bits &= bits - 1
    return out


_ANSWER = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n", pa.int64()), ("best", pa.string())])


def _answers(table: pa.Table) -> pa.Table:
    """Near words of the queries in each group (or block of one) of a bucket."""
    from sightgrid.llm.variants import Index, members

    table = table.sort_by([(c, "ascending") for c in ("short", "back", "half", "block", "chunk", "word")]).combine_chunks()
    shorts, backs, words, counts, listed, asking = (
        table.column(c).to_pylist() for c in ("short", "back", "word", "n", "listed", "asking"))
    edge = np.zeros(max(0, len(words) - 1), bool)
    for c in ("short", "back", "half", "block", "chunk"):
        column = table.column(c)
        edge |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, max(0, len(words) - 1))))
    starts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(words)]
    rows = []
    for start, end in zip(starts, starts[1:]):
        here = [k for k in range(start, end) if listed[k]]
        index = Index([words[k] for k in here])
        apart = shorts[start] // 2 if backs[start] else 0
        for k in range(start, end):
            found = asking[k] and index.near(words[k], shorts[k], apart)
            if found:
                near = [here[j] for j in members(found)]
                best = max(near, key=counts.__getitem__)  # the first of the largest: words are in order
                rows.append((words[k], len(near), counts[best], words[best]))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _ANSWER.types)], schema=_ANSWER)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near and best (struct of n and word, the near word of largest n) of ``words`` (stored: word, n) with a near word."""
    m = F.length("word")

    def group(short, back):
        half = F.floor(short / 2).cast("int")
        return F.struct(short.alias("short"), F.lit(back).alias("back"),
                        (F.right("word", half) if back else F.substring("word", F.lit(1), half)).alias("half"))

    dealt = words.select("word", "n", F.explode(F.array(group(m, False), group(m, True), group(m - 1, False), group(m - 1, True))).alias("g"))
    dealt = dealt.select("word", "n", "g.*").where(F.col("short") >= MIN_LENGTH)
    keys = ["short", "back", "half"]
    sizes = stored(dealt.groupBy(*keys).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")), "groups")
    zero, true = F.lit(0), F.lit(True)
    small = dealt.join(sizes.where("blocks = 1").select(*keys), keys).select(
        *keys, zero.alias("block"), zero.alias("chunk"), "word", "n", true.alias("listed"), true.alias("asking"))
    # a crowded group: its words are dealt to blocks; every pair of blocks meets, one as index and one as queries
    crowd = dealt.join(hinted(sizes.where("blocks > 1").select(*keys, "blocks")), keys).withColumn(
        "own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    split = crowd.select(*keys, F.col("own").alias("block"), F.col("other").alias("chunk"), "word", "n", true.alias("listed"),
                         (F.col("own") == F.col("other")).alias("asking")).union(
        crowd.where("own <> other").select(*keys, F.col("other").alias("block"), F.col("own").alias("chunk"), "word", "n",
                                           F.lit(False).alias("listed"), true.alias("asking")))
    buckets = words.count() * 4 // block + 1
    rows = small.union(split).withColumn("bucket", F.pmod(F.xxhash64(*keys, "block", "chunk"), F.lit(buckets)))
    found = rows.groupBy("bucket").applyInArrow(_answers, "word string, n_near long, n long, best string")
    top = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "best")).alias("b"))
    return top.select("word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.best").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for ``forms`` (word, form: chains without a circle), by pointer jumping."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.where("moved").head(1):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(hinted(onward), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = stored(vocabulary(ready(docs)), "vocabulary")
    near = near_words(words).withColumnRenamed("word", "w")
    fits = F.col("best.n") >= RATIO * F.col("n")
    rows = stored(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"),
        F.when(fits, F.col("best.n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null").select("word", "form")).withColumnRenamed("word", "w")
    return rows.join(ends, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE = f"""
with crc as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)) q),
r as (
  select coalesce(cast(doc_id as varchar), '') || ':' || run as s, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-zÀ-ÿ]+')) as run
    from documents) q group by all),
h as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(s)),
      lambda k: cast(('0x' || hex(encode(s))[2 * k + 1:2 * k + 2]) as bigint))),
      lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as bigint) + 1]))) as h from r, crc),
w as (
  select case when h % {NOISE} = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word,
    cast(sum(times) as bigint) as n from h group by 1 having length(word) >= {MIN_LENGTH} and sum(times) >= {MIN_COUNT}),
x as (select distinct word, n, p, word[:p] || word[p + 2:] as rest from (select *, unnest(range(length(word))) as p from w) q),
pairs as (
  select a.word, b.word as other, b.n as m from x a join x b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from x a join w b on a.rest = b.word union select b.word, a.word, a.n from x a join w b on a.rest = b.word),
f as (
  select w.word, w.n, count(other) as n_near, first(other order by m desc, other) as o, first(m order by m desc, other) as m
  from w left join pairs p on p.word = w.word group by all),
g as (select word, n, n_near, case when m >= {RATIO} * n then o end as form, case when m >= {RATIO} * n then m end as form_n from f),
walk as (
  with recursive s as (select word, word as root, 0 as k from g union all
    select s.word, g.form, k + 1 from s join g on s.root = g.word where g.form is not null)
  select word, arg_max(root, k) as root from s group by word)
select word, n, n_near, form, form_n, root from g join walk using (word)"""
