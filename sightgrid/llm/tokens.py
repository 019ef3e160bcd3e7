"""Encoding of whole texts with a public tokenizer file, a slice of an Arrow batch at a time.

A tokenizer's own pre-tokenizer never lets a token cross certain places: before a run of white space (byte-level split) or
anywhere in white space that the tokenizer drops. Texts are cut there, the distinct parts of a slice are encoded by the
library, and the ids are put together again; a bounded table keeps the ids of parts already seen. Other kinds of tokenizer,
and texts with white space that is not ASCII, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

KEPT_PARTS, KEPT_BYTES = 700_000, 48  # parts that a worker remembers, and the longest of them
_ODD = r"[\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this worker's encoders with the parts they remember; results do not depend on these."""
    _encoders.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cut, self.joint = _cutting(spec)
        if self.cut is not None:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.units = np.zeros(max(vocabulary.values()) + 1, np.int64)  # what a token adds to the units of its part
            for token, i in vocabulary.items():
                self.units[i] = token.endswith("</w>") if self.joint else len(token)
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0
        self.first, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of each text)."""
        flat, counts = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # the library's results are bulky: some 256 kB of text at a time
            to, size = at, 0
            while to < len(texts) and (size < 1 << 18 or to == at):
                size += len(texts[to])
                to += 1
            for k, e in enumerate(self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False), at):
                flat.append(e.ids)
                counts[k] = len(e.ids)
            at = to
        total = int(counts.sum())
        return np.fromiter((i for ids in flat for i in ids), self.dtype, total), counts

    def _part_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of each part, place of its first), for parts of texts: most are encoded as one long text, whose ids are told apart by counting units.

        The unit of a byte-level part is a byte, that of a part between white space an end of a word.
        """
        units = np.fromiter(map(_word_units if self.joint else _byte_units, parts), np.int64, len(parts))
        alone, many = np.flatnonzero(units < 0), np.flatnonzero(units >= 0)
        counts, pieces, at = np.zeros(len(parts), np.int64), [], 0
        while at < len(many):
            some = many[at:at + 8192]
            at += len(some)
            ids = np.array(self.tokenizer.encode_batch_fast([self.joint.join(parts[k] for k in some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.units[ids]), np.cumsum(units[some])) + 1
            counts[some] = np.diff(ends, prepend=0)
            pieces.append(ids)
        flat, n = self._ids([parts[k] for k in alone])
        counts[alone] = n
        order = np.concatenate([many, alone])
        starts = np.empty(len(parts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([*pieces, flat]), counts, starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end) of non-null large strings."""
        import pyarrow.compute as pc

        n = len(texts)
        whole = np.ones(n, bool) if self.cut is None else np.asarray(pc.match_substring_regex(texts, _ODD), dtype=bool)
        if self.cut is None or whole.all():
            flat, counts = self._ids(texts.to_pylist())
            return flat, np.concatenate([[0], np.cumsum(counts)])
        parts = self.cut(texts if not whole.any() else pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts))
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        coded = parts.flatten().dictionary_encode()
        code, distinct = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
        if len(self.known) > KEPT_PARTS:
            self._clear()
        place = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        first, length = self.first[place], self.length[place]
        pool = self.pool
        if len(new):
            strings = [distinct[k] for k in new]
            flat, counts, starts = self._part_ids(strings)
            pool = np.concatenate([self.pool[:self.used], flat])
            first[new], length[new] = self.used + starts, counts
            self._keep(strings, flat, starts, counts)
        size = length[code]
        ends = np.cumsum(size)
        ids = pool[np.repeat(first[code] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        return self._with_whole(texts, whole, ids, bounds) if whole.any() else (ids, bounds)

    def _keep(self, strings, flat, starts, counts):
        short = np.flatnonzero(np.fromiter((len(s) <= KEPT_BYTES for s in strings), bool, len(strings)))
        if not len(short):
            return
        n, sizes = len(self.known), counts[short]
        ends = np.cumsum(sizes)
        kept = flat[np.repeat(starts[short] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        while self.used + len(kept) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(short) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.pool[self.used:self.used + len(kept)] = kept
        self.first[n:n + len(short)], self.length[n:n + len(short)] = self.used + ends - sizes, sizes
        self.known.update((strings[k], n + j) for j, k in enumerate(short))
        self.used += len(kept)

    def _with_whole(self, texts, whole, ids, bounds):
        flat, counts = self._ids(texts.filter(pa.array(whole)).to_pylist())
        starts = np.concatenate([[0], np.cumsum(counts)])
        pieces, sizes, j = [], np.zeros(len(whole), np.int64), 0
        for k, alone in enumerate(whole):
            piece = flat[starts[j]:starts[j + 1]] if alone else ids[bounds[k]:bounds[k + 1]]
            j += int(alone)
            pieces.append(piece)
            sizes[k] = len(piece)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])


def _byte_units(part: str) -> int:
    """Bytes of a part that begins with white space and ends with none; others are encoded alone."""
    return len(part.encode()) if part[:1] in _SPACE and part[-1:] not in _SPACE and "<|" not in part else -1


def _word_units(part: str) -> int:
    """Words of a plain Latin part, with one sign after it or none; others are encoded alone."""
    sign = part[-1:] in ".,;:!?"
    word = part[:-1] if sign else part
    return 1 + sign if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word else -1


_SPACE = frozenset(" \t\n\f\r")


def _cutting(spec: dict):
    """(rule for cutting texts that this tokenizer allows or None, what joins parts)."""
    import pyarrow.compute as pc

    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if norm == {} and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return lambda t: pc.split_pattern(pc.replace_substring_regex(t, r"([\t\n\f\r ]+)", "\x00\\1"), "\x00"), ""
    steps = [x for x in norm.get("normalizers", [])]
    drops = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps)
    plain = all(x.get("type") in ("NFC", "Replace", "Lowercase") for x in steps)
    split = (pre.get("pretokenizers") or [{}])[0]
    if drops and plain and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
        return pc.ascii_split_whitespace, " "
    return None, ""
