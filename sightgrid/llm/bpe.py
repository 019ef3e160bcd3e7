"""BPE encoding and decoding with a public tokenizer file, merges done here.

Contiguous rank array: a word is held as the boundaries of its parts and the rank of every adjacent pair. The smallest rank is
looked for by a scan, the boundary between its two parts is deleted, and the two ranks beside it are looked up anew, until no
pair has a rank. Among equal ranks the leftmost goes first. Words of more than ``SHORT`` characters keep the same boundaries as
a linked list with a heap of ranks, so a text of one long word is no quadratic task.

The file's text rules (normaliser, pre-tokeniser, special tokens) decide what a word is. For plain Latin characters they are
applied here; parts of texts with other characters go through the library's own normaliser and pre-tokeniser, so that both
know the same version of Unicode. The library's model is never called.

Scale: a map over Arrow batches, sliced by bytes; nothing is shuffled. Texts are cut at white space, equal parts of a slice are
encoded once, and each worker remembers a bounded number of parts and words.

Defined results: a null text counts as empty, which has no ids and decodes to an empty text; null and repeated doc_ids are rows
of their own; special tokens in a text become their ids; very long texts are slices of their own; an empty table gives no row.
``row`` is a struct of the columns asked for, so no column of the input can clash.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.llm.common import ready, text_slices
from sightgrid.llm.tokens import Encoder, _cutting

SHORT, KEPT_WORDS, SLICE = 48, 100_000, 4 << 20
NONE = 1 << 60  # the rank of a pair that no merge names
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]*")  # characters whose classes no version of Unicode changes
_codecs: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    """One codec for each worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec(Encoder):
    """Encoding by an own model over the cutting and the tables of parts that ``Encoder`` keeps; and decoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE files")
        self.rules = Tokenizer.from_file(path)
        self.vocabulary = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.whole_words = bool(model.get("ignore_merges"))
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only plain special tokens")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.characters)}
        self.cut, self.joint = _cutting(spec)
        self.lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        # the pattern of the word-level file, for plain characters: letters, one digit, or other signs
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w]|_)+") if self.joint else None
        size = max([*self.vocabulary.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.vocabulary.items(), *self.special.items()]:
            self.tokens[i] = token
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaced = spec.get("decoder") is None
        if not self.spaced:
            if spec["decoder"]["type"] != "ByteLevel":
                raise ValueError("only byte-level decoders, or none")
            self.raw = [bytes(map(self.bytes.get, t)) if all(c in self.bytes for c in t) else t.encode() for t in self.tokens]
        self.words: dict[str, list[int]] = {}
        self._clear()

    # -- from texts to words

    def _pieces(self, part: str) -> list:
        """The words of a part in byte characters, special tokens as their ids."""
        if self.special_cut and "<" in part:
            cut = self.special_cut.split(part)
            if len(cut) > 1:
                return [w for k, s in enumerate(cut) for w in ([self.special[s]] if k % 2 else self._pieces(s) if s else ())]
        if self.plain and _PLAIN.fullmatch(part):
            found = self.plain.findall(part.lower() if self.lower else part)
            if part.isascii():
                return found
            return [w if w.isascii() else "".join([self.characters[b] for b in w.encode()]) for w in found]
        if self.rules.normalizer:
            part = self.rules.normalizer.normalize_str(part)
        return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(part)]

    # -- from words to ids

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word in byte characters."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            known = self._merge(word) if len(word) <= SHORT else self._merge_long(word)
            if len(word) <= SHORT:
                self.words[word] = known
        return known

    def _merge(self, word: str) -> list[int]:
        text, ranks, vocabulary = word + self.suffix, self.ranks, self.vocabulary
        if self.whole_words and text in vocabulary:
            return [vocabulary[text]]
        at = [*range(len(word)), len(text)]  # boundaries: part i is text[at[i]:at[i + 1]]

        def rank(i: int) -> int:
            if i + 2 >= len(at):
                return NONE
            return ranks.get((text[at[i]:at[i + 1]], text[at[i + 1]:at[i + 2]]), NONE)

        near = [rank(i) for i in range(len(at) - 1)]  # near[i]: the rank of parts i and i + 1
        while True:
            low = min(near)
            if low == NONE:
                return [vocabulary[text[at[i]:at[i + 1]]] for i in range(len(at) - 1)]
            i = near.index(low)
            del at[i + 1], near[i + 1]
            near[i] = rank(i)
            if i:
                near[i - 1] = rank(i - 1)

    def _merge_long(self, word: str) -> list[int]:
        text, ranks = word + self.suffix, self.ranks
        n = len(word)
        if self.whole_words and text in self.vocabulary:
            return [self.vocabulary[text]]
        end = [*range(1, n), len(text)]  # of the part that starts at each place; 0 where none starts any more
        before = [*range(-1, n - 1)]

        def rank(i: int) -> int:
            j = end[i]
            return ranks.get((text[i:j], text[j:end[j]]), NONE) if j < n else NONE

        heap = [(r, i, end[i], end[end[i]]) for i in range(n - 1) if (r := rank(i)) < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue  # one of the two parts has changed since
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            for p in (before[i], i):
                if p >= 0 and (r := rank(p)) < NONE:
                    heapq.heappush(heap, (r, p, end[p], end[end[p]]))
        out, i = [], 0
        while i < n:
            out.append(self.vocabulary[text[i:end[i]]])
            i = end[i]
        return out

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(flat)
            for word in self._pieces(text):
                if word.__class__ is int:
                    flat.append(word)
                else:
                    flat += self.words.get(word) or self.word_ids(word)
            counts[k] = len(flat) - before
        return np.array(flat, self.dtype), counts

    def _part_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, counts = self._ids(parts)
        return flat, counts, np.cumsum(counts) - counts

    # -- and back

    def text_of(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept."""
        if self.spaced:
            return " ".join([self.tokens[i] for i in ids.tolist()])
        return b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _kept(row: pa.StructArray, keep: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([row.field(c) for c in keep], fields=[row.type.field(c) for c in keep])


def _encoder(path: str, keep: list[str], back: bool):
    def run(batches):
        from sightgrid.llm import bpe

        own = bpe.codec(path)
        for batch in batches:
            row = batch.column(0)
            flat, at = pa.RecordBatch.from_arrays([row.field("text").cast(pa.large_string())], ["text"]), 0
            for part in text_slices(flat, limit=SLICE):
                ids, bounds = own.encode(part.column("text"))
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                column = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).tobytes()), raw])
                out = [bpe._kept(row.slice(at, part.num_rows), keep), pa.array(np.diff(bounds), pa.int64()), column.cast(pa.binary())]
                if back:
                    out.append(pa.array([own.text_of(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string()))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(out, ["row", "n_tokens", "ids", "decoded"][:len(out)])

    return run


def _decoder(path: str):
    def run(batches):
        from sightgrid.llm import bpe

        own = bpe.codec(path)
        for batch in batches:
            ids = batch.column("ids").cast(pa.large_binary())
            sizes = np.fromiter((len(x.as_buffer() or b"") for x in ids), np.int64, len(ids))
            ends, at = np.cumsum(sizes), 0
            while at < len(ids):  # texts are longer than their ids, so some ids at a time
                to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE, side="right")))
                texts = [own.text_of(np.frombuffer(ids[k].as_buffer() or b"", "<u4")) for k in range(at, to)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, pa.array(texts, pa.string())],
                                                 [*batch.schema.names, "decoded"])
                at = to

    return run


def _coded(docs: DataFrame, path: str, keep: tuple[str, ...], back: bool) -> DataFrame:
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())][:back]])
    need = list(dict.fromkeys([*keep, "text"]))
    return ready(docs).select(F.struct(*need).alias("row")).mapInArrow(_encoder(path, list(keep), back), schema)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the columns ``keep``), n_tokens and ids (little-endian unsigned 32-bit) of every text."""
    return _coded(docs, path, keep, False)


def there_and_back(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encoded`` and, in the same pass, ``decoded``: the text that the ids stand for."""
    return _coded(docs, path, keep, True)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with a binary column ``ids``, null for no ids) and ``decoded``, the text of their ids."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return ready(rows).mapInArrow(_decoder(path), schema)
