"""Whole-text tokenisation with the tokenizers library, with bounded memos of space-delimited units.

Both public vocabularies used here start a new pre-token wherever a space is followed by a character that isn't white
space, so a text's ids are the concatenation of the ids of its units. A text in which that can't be shown (a unit that
is empty or starts with white space) is encoded whole, as is any text when the pre-tokeniser is of another kind.
"""

from __future__ import annotations

import codecs
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenfold.llm.common import memo

#: Units of a generation take some 40 bytes each.
MEMO_CHARS, GENERATION = 32, 250_000
#: Rows of an Arrow batch that are Python strings at a time.
ROWS = 1000
#: Set between units where the vocabulary drops spaces; a lone control character is one id of its own.
MARK = "\x01"
_LATIN, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: A word of Latin letters and the punctuation behind it (no apostrophe, which may open a contraction), and perhaps, after a
#: line end, another such: each is a pre-token.
_PLAIN = rf"^(?P<stem>[{_LATIN}]+)(?P<tail>[{_SIGNS}]*)(?:\n(?P<stem2>[{_LATIN}]+)(?P<tail2>[{_SIGNS}]*))?$"
_PROBES = ["Hello,", "s", "T.", "été", "ÉÜß!!", "don", "Zebra;:", "a", "straße", "RE_", "ll&&&", "a.\nB", "Où\nöß,", "s\nt"]
#: Words in a call of the library.
WORDS = 4096


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte; a line end stays, as it parts words here."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return "".join("\n" if b == 10 else letter[b] for b in range(256))


def _flat(coded: list[bytes | bool]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (-1 for False) and all ids of encoded units."""
    return np.fromiter((-1 if b is False else len(b) >> 2 for b in coded), np.int64, len(coded)), np.frombuffer(b"".join(b or b"" for b in coded), "<u4")


def _pick(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of runs of a pool, one run behind the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Known:
    """Units and their ids, in two generations: once the younger is full it becomes the elder, whose used units move on."""

    def __init__(self) -> None:
        self.young, self.old = [self._empty()], self._empty()

    @staticmethod
    def _empty() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def _together(parts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def find(self, units: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the distinct units where its ids begin in the returned pool, and how many; -1 if it can't stand alone.

        encode gives sizes and ids of unknown units, like _flat. Long ones aren't remembered.
        """
        young = self._together(self.young)
        names, sizes, pool = self._together([young, self.old])
        at = pc.index_in(units, value_set=names).fill_null(-1).to_numpy()
        lost = np.flatnonzero(at < 0)
        new_sizes, new_pool = encode(units.take(pa.array(lost)))
        all_sizes, all_pool = np.concatenate([sizes, new_sizes]), np.concatenate([pool, new_pool])
        whole = np.maximum(all_sizes, 0)
        begins = np.cumsum(whole) - whole
        at = at.astype(np.int64)
        at[lost] = len(sizes) + np.arange(len(lost))
        # what is new, or was only in the elder generation
        on = (at >= len(young[0])) & (pc.utf8_length(units).to_numpy() <= MEMO_CHARS)
        if on.any():
            pick = at[on]
            self.young = [young, (units.filter(pa.array(on)), all_sizes[pick], _pick(all_pool, begins[pick], whole[pick]))]
            if len(young[0]) + len(pick) > GENERATION:
                self.young, self.old = [self._empty()], self._together(self.young)
        return begins[at], all_sizes[at], all_pool


class UnitEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [pre])
        byte_level = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
        self.keeps_space = byte_level and len(steps) == 1 and steps[0].get("use_regex", False)
        drops_space = byte_level and len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed"
        self.by_unit = self.keeps_space or drops_space
        if self.by_unit:
            size = self.tokenizer.get_vocab_size()
            names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
            self.opens = np.array([n.startswith("Ġ") for n in names])
            close = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            self.closes = np.array([bool(close) and n.endswith(close) for n in names])
            self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[-1]
            self.by_unit = self.keeps_space or len(self.tokenizer.encode(MARK, add_special_tokens=False).ids) == 1
        self.first, self.rest = _Known(), _Known()
        self.lowers = any(n.get("type") == "Lowercase" for n in norm.get("normalizers", [norm]))
        self.words = Tokenizer(self.tokenizer.model)  # takes words, one to a line, in the letters of the vocabulary
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        self.letters, self.by_stem = _byte_letters(), self.by_unit
        if self.by_stem:
            probes = pa.array(_PROBES if self.keeps_space else [p for p in _PROBES if "\n" not in p], pa.large_string())
            known, sizes, pool = self._by_stems(probes)
            wanted = self._raw([" " * self.keeps_space + u for u in probes.to_pylist()])
            self.by_stem = bool(known.all()) and sizes.tolist() == [len(w) >> 2 for w in wanted] and pool.tobytes() == b"".join(wanted)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _spelt(self, stems: list[str], opening: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of Latin letters, many to a call: the vocabulary shows where a word begins or ends."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for i in range(0, len(stems), WORDS):
            some = stems[i : i + WORDS]
            text = "\n".join(some)
            text = codecs.charmap_decode((text.lower() if self.lowers else text).encode(), "strict", self.letters)[0]
            if opening:
                text = opening + text.replace("\n", "\n" + opening)
            shown = bool(opening) or self.closes.any()
            got = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids if shown else [], "<u4")
            starts = np.flatnonzero(self.opens[got]) if opening else np.append(0, np.flatnonzero(self.closes[got]) + 1)[:-1]
            if len(starts) == len(some) and starts[0] == 0:
                n = np.diff(starts, append=len(got))
            else:  # one by one
                n, got = _flat([np.array([t.id for t in self.words.model.tokenize(w)], "<u4").tobytes() for w in text.split("\n")])
            sizes.append(n)
            ids.append(got)
        return np.concatenate(sizes), np.concatenate(ids)

    def _by_stems(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which units are plain words with their punctuation; their sizes and ids, straight from the vocabulary's model."""
        parts = pc.extract_regex(units, _PLAIN)
        known = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        if not self.keeps_space:  # no line ends here
            known &= ~pc.match_substring(units, "\n").to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(known))
        second = pc.binary_length(parts.field("stem2")).to_numpy() > 0
        runs, pools, at = [], [], 0
        for name in ("stem", "tail", "stem2", "tail2"):
            if name == "stem2":
                if not second.any():
                    break
                end = np.frombuffer(self._raw(["\n"])[0], "<u4")
                runs.append((np.full(len(second), at), np.where(second, len(end), 0)))
                pools.append(end)
                at += len(end)
            coded = parts.field(name).dictionary_encode()
            if name == "stem2":  # where there is no second word, its part is empty: a size of 0
                sizes, ids = self._spelt(pc.if_else(pc.equal(coded.dictionary, ""), "a", coded.dictionary).to_pylist(), "")
            elif name == "stem":
                sizes, ids = self._spelt(coded.dictionary.to_pylist(), "Ġ" if self.keeps_space else "")
            else:
                sizes, ids = _flat(self._raw(coded.dictionary.to_pylist()))
            place = coded.indices.to_numpy()
            begins = np.cumsum(sizes) - sizes + at
            runs.append((begins[place], np.where(second, sizes[place], 0) if name == "stem2" else sizes[place]))
            pools.append(ids)
            at += len(ids)
        begins, sizes = np.stack([r[0] for r in runs], axis=1), np.stack([r[1] for r in runs], axis=1)
        return known, sizes.sum(axis=1), _pick(np.concatenate(pools), begins.ravel(), sizes.ravel())

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units behind a space; size -1 for those that can't be told apart from it."""
        known, sizes, pool = self._by_stems(units) if self.by_stem else (np.zeros(len(units), bool), np.zeros(0, np.int64), np.zeros(0, "<u4"))
        others = units.filter(pa.array(~known)).to_pylist()
        out: list[bytes | bool] = [not self.keeps_space or self._opens_plain(u) for u in others]
        plain = [i for i, ok in enumerate(out) if ok]
        for i, b in zip(plain, self._joined([others[i] for i in plain]), strict=True):
            out[i] = b
        sizes2, pool2 = _flat(out)
        order = np.argsort(np.concatenate([np.flatnonzero(known), np.flatnonzero(~known)]))
        every = np.concatenate([sizes, sizes2])
        whole = np.maximum(every, 0)
        begins = np.cumsum(whole) - whole
        return every[order], _pick(np.concatenate([pool, pool2]), begins[order], whole[order])

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of units, many to a call: a unit ends where an id that starts with a space (or a marker unit) comes next."""
        out: list[bytes] = []
        for i in range(0, len(units), 512):
            some = units[i : i + 512]
            if self.keeps_space:
                ids = self._ids(" " + " ".join(some))
                starts = np.flatnonzero(self.opens[ids])
                ends, skip = np.append(starts[1:], len(ids)), 0
            else:
                ids = self._ids(f" {MARK} ".join(some) + f" {MARK}")
                ends, skip = np.flatnonzero(ids == self.mark), 1
                starts = np.concatenate([[0], ends[:-1] + skip]).astype(np.int64)
            if len(ends) != len(some) or any(MARK in u for u in some) or (len(starts) and starts[0]):
                out += self._raw([" " * self.keeps_space + u for u in some])
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    @staticmethod
    def _opens_plain(unit: str) -> bool:
        return bool(unit) and not unit[0].isspace() and unit[0] not in "᠎​﻿"

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        if not self.by_unit or not texts:
            return self._raw(texts)
        whole = pa.array(texts, pa.large_string())
        # where spaces are dropped, so are line ends
        split = pc.split_pattern(whole if self.keeps_space else pc.replace_substring(whole, "\n", " "), " ")
        bounds, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        units, place = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # a text's first unit has no space before it, so it gets an entry of its own behind those of the other units
        heads, head_at = np.unique(place[bounds[:-1]], return_inverse=True)
        inner = np.ones(len(place), bool)
        inner[bounds[:-1]] = False
        used = np.zeros(len(units), bool)
        used[place[inner]] = True
        at = (np.cumsum(used) - 1)[place]
        at[bounds[:-1]] = int(used.sum()) + head_at
        begins, sizes, pool = self.rest.find(units.filter(pa.array(used)), self._units)
        begins2, sizes2, pool2 = self.first.find(units.take(pa.array(heads)), lambda lost: _flat(self._raw(lost.to_pylist())))
        begins, sizes, pool = np.concatenate([begins, begins2 + len(pool)]), np.concatenate([sizes, sizes2]), np.concatenate([pool, pool2])
        bad = sizes < 0
        n = np.maximum(sizes, 0)[at]
        ends = np.cumsum(n)
        raw, cuts = _pick(pool, begins[at], n).tobytes(), np.concatenate([[0], 4 * ends])[bounds].tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        again = np.flatnonzero(np.add.reduceat(bad[at], bounds[:-1])).tolist() if bad.any() else []
        for i, b in zip(again, self._raw([texts[i] for i in again]), strict=True):
            out[i] = b
        return out


def encoder(path: str) -> UnitEncoder:
    """One per Python worker and vocabulary file."""
    return memo("tokens", path, lambda: UnitEncoder(path))


def in_chunks(texts: list[str], chars: int = 2 << 20):
    """Slices of texts of some chars together, a longer text alone: units repeat within a slice, and its arrays stay small."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
