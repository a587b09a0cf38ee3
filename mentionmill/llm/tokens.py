"""Tokenizers inside Spark tasks: whole-token counting, and ids of whole texts.

Files of byte-level BPE tokenizers are read from a path that every worker can open. Each worker loads a file once.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: how byte-level BPE files of this kind cut a text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of merged pre-tokens that a worker keeps before it starts anew.
KEPT_COUNTS = 400_000
#: Bytes of remembered runs (the run, its ids and what an entry takes besides) before a worker starts anew, and the
#: length from which a run is not remembered.
KEPT_BYTES, ENTRY_BYTES, LONG_RUN = 150_000_000, 180, 100
# Fixed value: the pattern of files that drop white space.
DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: how files that drop white space cut a lower-case text, for ASCII.
PRINTABLE = re.compile(rb"[!-~]+")
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Latin letters that stand for themselves in composed form and have one lower-case letter; the same cut for them.
LATIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


@functools.cache
def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _bytes_of(piece: str) -> bytes:
    table = _byte_of_letter()
    return bytes(table[c] for c in piece)


@functools.cache
def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _is_plain_byte_bpe(spec: dict) -> bool:
    """Whether a text's ids are those of its pre-tokens, merged in the order of the vocabulary."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    return (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    )


class _Counts(dict):
    """Tokens by pre-token: the proven single tokens first, then what was merged; a miss is merged and kept."""

    def __init__(self, tokenizer: Tokenizer, proven: list[str]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self.tokenizer, self.proven = tokenizer, proven

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= len(self.proven) + KEPT_COUNTS:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self[pretoken] = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        return n


class WholeTokenCounter:
    """Token counts by the whole-token shortcut."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PRETOKENS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.exact = _is_plain_byte_bpe(_file(path))
        self.counts = _Counts(self.tokenizer, self.proven_whole(path) if self.exact else [])

    def proven_whole(self, path: str) -> list[str]:
        """The strings of the vocabulary that are one pre-token and encode, alone, as their own one token."""
        strings = []
        for piece, number in _file(path)["model"]["vocab"].items():
            try:
                text = _bytes_of(piece).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pattern.fullmatch(text) and not any(s in text for s in self.special):
                strings.append((text, number))
        found = self.tokenizer.encode_batch([t for t, _ in strings], add_special_tokens=False)
        return [t for (t, number), e in zip(strings, found, strict=True) if e.ids == [number]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.exact or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.counts.__getitem__, self.pattern.findall(text)))


class TokenIds:
    """The ids that the tokenizers library gives a whole text, without begin or end tokens.

    Where the file allows, tiktoken gives them, by the same merges; its pattern engine refuses texts with very long
    runs of white space, and those go to the library itself.
    """

    def __init__(self, path: str) -> None:
        spec = _file(path)
        self.path, self.encoding = path, None
        if _is_plain_byte_bpe(spec):  # the same merges, and several times as fast
            added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {_bytes_of(piece): n for piece, n in spec["model"]["vocab"].items() if piece not in added}
            self.encoding = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=added)

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.encoding is not None:
            try:
                return np.asarray(self.encoding.encode(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)
            except ValueError:  # its pattern engine ran out of stack
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class WordIds:
    """Ids of whole texts, one run between ASCII white space at a time; what was met is remembered, within bounds.

    For files that drop white space: no token, and no step before the merges, reaches over it, so the ids of a text
    are those of its runs. A run of ASCII or Latin letters that is not remembered is cut into the pattern's pieces, which are
    remembered too. Where the file allows, tiktoken merges pieces, by the same merges; the tokenizers library gives the
    ids of long pieces and of all other runs.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.largest = self.tokenizer.get_vocab_size() - 1
        self.model = self.tokenizer.model
        self.by_run, self.by_piece = _Remembered(self.run), _Remembered(self.piece)
        if not _drops_white_space(_file(path)):
            raise ValueError(f"{path} keeps white space or joins tokens over it")
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or b"(?!)")
        self.merged = self._merging(_file(path)["model"])

    def _merging(self, model: dict) -> Callable[[bytes], list[int]] | None:
        """Ids of a piece with a line break, which no piece holds, for the mark that ends words; None if not proven.

        First come all bytes, then all bytes that end a word, then the merges in their order. Pieces that are in the
        vocabulary are taken whole there, so each must be the one token that the library makes of it.
        """
        mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if not mark or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        singles = [*_byte_of_letter()]
        singles += [c + mark for c in singles]
        if not all(vocab.get(c, 512) < 512 for c in singles) or not all(vocab.get(a + b) == 512 + i for i, (a, b) in enumerate(merges)):
            return None
        names = singles + [a + b for a, b in merges]
        ranks = {_bytes_of(x.removesuffix(mark)) + (b"\n" if x.endswith(mark) else b""): vocab[x] for x in names}
        whole = [x.removesuffix(mark) for x in names if x.endswith(mark)]
        if len(ranks) != len(names) or any([t.id for t in self.model.tokenize(x)] != [vocab[x + mark]] for x in whole):
            return None
        return tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _encoded(self, run: bytes) -> bytes:
        return np.array(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece in lower case; what is printable ASCII stands for itself in the model's alphabet."""
        if self.merged and len(piece) <= LONG_RUN:
            return array("I", self.merged(piece + b"\n")).tobytes()
        if PRINTABLE.fullmatch(piece):
            return np.array([t.id for t in self.model.tokenize(piece.decode())], dtype=np.uint32).tobytes()
        return self._encoded(piece)

    def run(self, run: bytes) -> bytes:
        if self.special.search(run):
            return self._encoded(run)
        if run.isascii():
            return b"".join(map(self.by_piece.__getitem__, ASCII_PIECES.findall(run.lower())))
        text = run.decode()
        if LATIN.fullmatch(text):
            return b"".join([self.by_piece[p.encode()] for p in LATIN_PIECES.findall(text.lower())])
        return self._encoded(run)

    def ids(self, text: str) -> np.ndarray:
        if self.by_run.kept + self.by_piece.kept > KEPT_BYTES:
            self.by_run, self.by_piece = _Remembered(self.run), _Remembered(self.piece)
        runs = text.encode().split()  # at the six ASCII spaces
        return np.frombuffer(b"".join(map(self.by_run.__getitem__, runs)), dtype=np.uint32)


class _Remembered(dict):
    """Values by key; a miss is made, and kept unless it is long."""

    def __init__(self, make: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.make, self.kept = make, 0

    def __missing__(self, key: bytes) -> bytes:
        ids = self.make(key)
        if len(key) <= LONG_RUN:
            self[key] = ids
            self.kept += len(key) + len(ids) + ENTRY_BYTES
        return ids


def _drops_white_space(spec: dict) -> bool:
    """Whether white space ends every token and goes, whatever stands around it."""
    steps = spec["normalizer"].get("normalizers", [spec["normalizer"]]) if spec.get("normalizer") else []
    pre = spec.get("pre_tokenizer") or {}
    splits = pre.get("pretokenizers", [pre])
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    cut = splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not set(t["content"]) & set(" \t\n\x0b\f\r") for t in spec.get("added_tokens", []))
    # the pattern's pieces are letters, numbers or neither of these and no white space
    return plain and bool(cut) and splits[0]["pattern"].get("Regex", "") == DROPPING and added


@functools.cache
def word_encoder(path: str) -> WordIds:
    return WordIds(path)


@functools.cache
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


@functools.cache
def encoder(path: str) -> TokenIds:
    return TokenIds(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each whole text by the tokenizer file at ``path``; null and empty texts have none.

    A special token's string inside a text counts as that token, as the library does by default.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return texts.map(count).astype("int64") if len(texts) else pd.Series([], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))
