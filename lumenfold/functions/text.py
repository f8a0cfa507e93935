"""Text tokenisation for the text encoder: pre-tokeniser in SQL, BPE in an Arrow UDF with a bounded per-worker memo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, numbers, other runs; the two special strings are pieces of their own. (?U) makes \s Unicode-aware.
PIECES = r"(?U)<\|startoftext\|>|<\|endoftext\|>|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def pretokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PIECES), F.lit(0))


def pieces_of(text: str) -> list[str]:
    """The same pieces of one text on the driver."""
    import regex

    return regex.findall(r"<\|startoftext\|>|<\|endoftext\|>|\p{L}+|\p{N}+|[^\p{White_Space}\p{L}\p{N}]+", text.lower())


MEMO, MEMO_CHARS = 100_000, 32


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


class Bpe:
    """Vocabulary and merge ranks; encode() frames, cuts and pads to max_length."""

    def __init__(self, vocab: dict[str, int], merges: dict[tuple[str, str], int], max_length: int = 77, bos: str = "<|startoftext|>", eos: str = "<|endoftext|>", pad: int = 0):
        self.vocab, self.merges, self.max_length, self.pad = vocab, merges, max_length, pad
        self.bos, self.eos = vocab.get(bos), vocab.get(eos)
        self.alphabet, self.memo = byte_alphabet(), {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece: every occurrence of the best-ranked pair is merged until none is left; unknown parts drop."""
        ids = self.memo.get(piece)
        if ids is None:
            word = [self.alphabet[b] for b in piece.encode("utf-8")]
            if word:
                word[-1] += "</w>"
            while len(word) > 1:
                pair = min(zip(word, word[1:]), key=lambda p: self.merges.get(p, 1 << 60))
                if pair not in self.merges:
                    break
                out, i = [], 0
                while i < len(word):
                    both = i + 1 < len(word) and (word[i], word[i + 1]) == pair
                    out.append(word[i] + word[i + 1] if both else word[i])
                    i += 1 + both
                word = out
            ids = [self.vocab[w] for w in word if w in self.vocab]
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[int]:
        ids = [] if self.bos is None else [self.bos]
        for p in pieces:
            if len(ids) >= self.max_length:  # the ids of further pieces would be cut off
                break
            ids += self.piece(p)
        ids = ids[: self.max_length - (self.eos is not None)] + ([] if self.eos is None else [self.eos])
        return ids + [self.pad] * (self.max_length - len(ids))


def bpe_encode(text: Column, bpe: Bpe) -> Column:
    """array<bigint> of max_length ids."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: None if p is None else bpe.encode(list(p)))

    return run(pretokenize(text))
