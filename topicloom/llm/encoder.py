"""Whole texts to ids of a tokenizer file of the tokenizers library, with each distinct word encoded once.

Every pre-token of the word tokenizer is encoded by itself, and white space always parts pre-tokens. So the ids of a
text are those of its white-space chunks, one after another, and each worker keeps the ids of the chunks it has seen.
Texts are cut, and their chunks numbered, in Arrow; only distinct chunks are Python objects, and numpy joins their ids.
That holds only where normalisation works character by character: texts with a chunk that has characters beyond Latin
Extended-A, control characters or the opening of a special token are given to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Beyond these, lower-casing, NFC or white space may not be what the plain path takes them for.
_ODD = re.compile("[^\x21-\x7e\xa1-į]|<\\|")
#: Characters that part chunks here and not in the library.
_SEPARATORS = "[\x1c-\x1f]"
_LOWER = "a-zªµºß-öø-įà-ö"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9²³¹¼½¾]|[^\s{_LOWER}0-9²³¹¼½¾]+")
#: Chunks and pre-tokens that a worker keeps (about 200 MB); a full map loses the half that came last.
CACHE_ENTRIES = 1_000_000
#: Bytes of the texts that are looked up together, and pre-tokens that are given to the library in one text.
_AT_ONCE, _PIECES_AT_ONCE = 4_000_000, 300
_WHOLE = -1

_encoders: dict[str, "CachedEncoder"] = {}


def encoder(path: str) -> "CachedEncoder":
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    small = max(total, int(starts.max(initial=0))) < 1 << 31
    at = np.repeat((starts - (stops - lengths)).astype(np.int32 if small else np.int64), lengths)
    at += np.arange(total, dtype=at.dtype)
    return at


class Ids:
    """Runs of ids, numbered as they are added, in one growing array."""

    def __init__(self, dtype: np.dtype):
        self.data, self.starts, self.lengths = np.zeros(1 << 16, dtype=dtype), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.runs = self.used = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """The number of the first of the runs that ids consist of."""
        first, runs, used = self.runs, self.runs + len(lengths), self.used + len(ids)
        if runs > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(runs, dtype=np.int64)]) for x in (self.starts, self.lengths))
        if used > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(used, dtype=self.data.dtype)])
        self.starts[first:runs] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:runs] = lengths
        self.data[self.used : used] = ids
        self.runs, self.used = runs, used
        return first

    def cut(self, runs: int) -> None:
        self.runs, self.used = runs, int(self.starts[runs])

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs, one after another, and each run's length."""
        lengths = self.lengths[numbers]
        return self.data[spans(self.starts[numbers], lengths)], lengths


class CachedEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for pre-tokens: these need no normaliser and no pattern any more, only a cut at spaces.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.ids = Ids(self.dtype)
        #: Numbers of runs; _WHOLE: a text with this chunk is given to the library.
        self.known: dict[str, int] = {"": self.ids.add(np.zeros(0, dtype=self.dtype), np.zeros(1, dtype=np.int64))}

    def _learn_pieces(self, new: list[str]) -> None:
        """Encodes unseen pre-tokens, many in one text; each ends with a token that is marked as a word's end."""
        for at in range(0, len(new), _PIECES_AT_ONCE):
            part = new[at : at + _PIECES_AT_ONCE]
            ids = np.asarray(self.bare.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=int)
            if len(stops) != len(part) or stops[-1] != len(ids):
                each = [self.tokenizer.encode(piece, add_special_tokens=False).ids for piece in part]
                ids, stops = np.asarray([i for x in each for i in x], dtype=self.dtype), np.cumsum([len(x) for x in each])
            first = self.ids.add(ids, np.diff(stops, prepend=0))
            self.known.update(zip(part, range(first, first + len(part))))

    def _learn(self, new: list[str]) -> None:
        """Encodes unseen chunks; one of letters alone is a pre-token, the others are cut into pre-tokens."""
        known, pieces, mixed, parts = self.known, [], [], []
        for chunk in new:
            if chunk.isascii() and chunk.isalpha():
                pieces.append(chunk)
            elif _ODD.search(chunk):
                known[chunk] = _WHOLE
            elif chunk.isalpha():
                pieces.append(chunk)
            else:
                mixed.append(chunk)
                parts.append(_PIECE.findall(chunk))
        pieces = set(pieces)
        pieces.update(*parts)
        self._learn_pieces([p for p in pieces if p not in known])
        if mixed:
            numbers = np.fromiter((known[p] for cut in parts for p in cut), dtype=np.int64)
            ids, lengths = self.ids.joined(numbers)
            stops = np.cumsum([len(cut) for cut in parts])
            before = np.concatenate([[0], np.cumsum(lengths)])
            first = self.ids.add(ids, np.diff(before[stops], prepend=0))
            for number, chunk in enumerate(mixed, first):  # one that is a pre-token by itself is known already
                known.setdefault(chunk, number)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        ids, stops = self.encoded(pa.array(texts, pa.string()))
        return np.split(ids, stops[:-1]) if len(stops) else []

    def encoded(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end; null counts as empty. end_id follows each
        text's ids, if given."""
        texts = texts.cast(pa.large_string())
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        ids, stops, at, before = [], [], 0, 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(size, size[at] + _AT_ONCE, side="right")) - 1)
            found, ends = self._encoded(texts[at:until], end_id)
            ids.append(found)
            stops.append(ends + before)
            at, before = until, before + len(found)
        return np.concatenate(ids or [np.zeros(0, dtype=self.dtype)]), np.concatenate(stops or [np.zeros(0, dtype=np.int64)])

    def _encoded(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.fill_null(pc.match_substring_regex(texts, _SEPARATORS), False).to_numpy(zero_copy_only=False).copy()
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(whole), "", pc.fill_null(texts, ""))))
        stops = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
        found = chunks.flatten().dictionary_encode()
        if len(self.known) > CACHE_ENTRIES:  # frequent chunks are among those that were met first
            kept = CACHE_ENTRIES // 2
            self.known = {c: n for c, n in self.known.items() if _WHOLE < n < kept}
            self.ids.cut(min(kept, self.ids.runs))
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        get = self.known.get
        numbers = [get(c) for c in distinct]
        if None in numbers:
            self._learn([c for c, n in zip(distinct, numbers) if n is None])
            numbers = [get(c) if n is None else n for c, n in zip(distinct, numbers)] if get is self.known.get else [self.known[c] for c in distinct]
        of = np.asarray(numbers, dtype=np.int64)
        words = of[found.indices.to_numpy()]
        odd = np.flatnonzero(words == _WHOLE)
        if len(odd):
            whole[np.searchsorted(stops, odd, side="right")] = True
            words[odd] = 0
        if end_id is not None:
            end = self.ids.add(np.asarray([end_id], dtype=self.dtype), np.ones(1, dtype=np.int64))
            words = np.insert(words, stops, end)
            stops = stops + np.arange(1, len(stops) + 1)
        ids, lengths = self.ids.joined(words)
        ends = np.concatenate([[0], np.cumsum(lengths)])[stops]
        if end_id is not None:
            self.ids.cut(self.ids.runs - 1)
        if not whole.any():
            return ids, ends
        parts = np.split(ids, ends[:-1])
        last = [] if end_id is None else [end_id]
        for k in np.flatnonzero(whole).tolist():
            parts[k] = np.asarray(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids + last, dtype=self.dtype)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])
