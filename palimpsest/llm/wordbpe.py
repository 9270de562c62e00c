"""Byte-pair encoding of many texts at once, with the ids of the tokenizers library.

The vocabulary's pre-tokenizer drops white space and its merges never cross it, so a text's ids are those of its words
(runs without ASCII white space) in turn. A batch of texts is cut into words and numbered by Arrow; only its distinct words are
looked at, and their ids are gathered for all places at once. Words of Latin letters, perhaps with full stops or commas after them, are cut
by Arrow as well; those of other printable ASCII and Latin-1 letters, which normalisation only lower-cases, by the pre-tokenizer's
own pattern. New pieces of up to SHORT bytes are merged all together, in numpy: each step merges in every piece the adjacent
pair of the least rank, leftmost first. Longer pieces, which would take that many steps, and all other words are given to the
library, and so are whole texts if the vocabulary isn't of this kind. The tests hold all this against the library on whole texts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Pieces a worker keeps before it starts anew.
PIECES = 600_000
SHORT = 40
SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$"
#: The vocabulary's pattern, after lower-casing, on the characters that SAFE allows.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.iinfo(np.int32).max
SLOTS = 20


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs flat[at[i]:at[i + 1]] those numbered `which`, in turn, and where each begins and the last ends."""
    size = np.diff(at)[which]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    place = np.repeat((at[which] - end + size).astype(np.int32 if total + len(flat) < 1 << 31 else np.int64), size)
    place += np.arange(total, dtype=place.dtype)
    return flat[place], np.concatenate([[0], end])


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        end = model.get("end_of_word_suffix") or ""
        self.fast = (model.get("type"), end, cut[0].get("pattern", {}).get("Regex")) == ("BPE", "</w>", PATTERN)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces: dict[bytes, bytes] = {}
        if self.fast:
            vocab, names = model["vocab"], _byte_names()
            self.inner = np.array([vocab[c] for c in names], np.int64)
            self.last = np.array([vocab[c + end] for c in names], np.int64)
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
            self._index(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64))

    def _index(self, keys: np.ndarray) -> None:
        """Rank by pair: a table by one hash, and by binary search those that don't get its slot."""
        slot = self._slot(keys)
        self.key, self.rank = np.full(1 << SLOTS, np.iinfo(np.uint64).max, np.uint64), np.full(1 << SLOTS, NONE, np.int32)
        _, first = np.unique(slot, return_index=True)
        self.key[slot[first]], self.rank[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        order = rest[np.argsort(keys[rest])]
        self.rest, self.rest_rank = keys[order], order.astype(np.int32)
        self.crowded = np.zeros(1 << SLOTS, bool)
        self.crowded[slot[rest]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a and b; NONE where they don't merge or either is -1."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(key)
        found = np.where(self.key[slot] == key, self.rank[slot], NONE)
        if len(self.rest):
            again = np.flatnonzero(self.crowded[slot] & (found == NONE))
            at = np.minimum(np.searchsorted(self.rest, key.ravel()[again] if key.ndim == 1 else key[np.unravel_index(again, key.shape)]), len(self.rest) - 1)
            hit = self.rest[at] == key.ravel()[again]
            found.ravel()[again[hit]] = self.rest_rank[at[hit]]
        return found

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (UTF-8, not empty), as bytes of `kind`."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, 12), (12, 20), (20, SHORT)):
            at = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(at, max(1, len(at) // 20_000)):
                if len(part):
                    for i, ids in zip(part.tolist(), self._merge([pieces[i] for i in part], size[part]), strict=True):
                        out[i] = ids
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self._by_library(pieces[i].decode())
        return out

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _merge(self, pieces: list[bytes], size: np.ndarray) -> list[bytes]:
        n, width = len(pieces), int(size.max())
        at = np.arange(width)
        raw = np.zeros((n, width), np.int64)
        raw[at < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        sym = np.where(at < size[:, None] - 1, self.inner[raw], np.where(at == size[:, None] - 1, self.last[raw], -1))
        rank = np.full((n, width), NONE, np.int32)
        inside = at[:-1] < size[:, None] - 1
        rank[:, :-1][inside] = self._ranks(sym[:, :-1][inside], sym[:, 1:][inside])
        live = np.arange(n)
        while width > 1:
            part = rank[live]
            j = part.argmin(1)
            best = part[np.arange(len(live)), j]
            on = best < NONE
            live, j, best = live[on], j[on], best[on]
            if not len(live):
                break
            # Close the gap: what stood at j and j + 1 is now one symbol at j.
            source = np.minimum(at + (at > j[:, None]), width - 1)
            s = np.take_along_axis(sym[live], source, 1)
            r = np.take_along_axis(rank[live], source, 1)
            rows = np.arange(len(live))
            s[rows, j] = self.result[best]
            s[at >= size[live][:, None] - 1] = -1
            size[live] -= 1
            r[:, -1] = NONE
            after = np.where(j + 1 < width, s[rows, np.minimum(j + 1, width - 1)], -1)
            before = np.where(j > 0, s[rows, j - 1], -1)
            for where, a, b in ((j, s[rows, j], after), (j - 1, before, s[rows, j])):
                ok = np.flatnonzero((a >= 0) & (b >= 0))
                none = np.flatnonzero((where >= 0) & ((a < 0) | (b < 0)))
                r[none, where[none]] = NONE
                r[ok, where[ok]] = self._ranks(a[ok], b[ok])
            sym[live], rank[live] = s, r
        flat, wide = sym[at < size[:, None]].astype(self.kind).tobytes(), self.kind.itemsize
        end = np.cumsum(size) * wide
        return [flat[e - wide * k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True)]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > PIECES:
            self.pieces.clear()
            new = pieces
        self.pieces.update(zip(new, self.merge(new), strict=True))
        return list(map(self.pieces.__getitem__, pieces))

    def _words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (an Arrow string array), and where each word's begin and the last's end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(words, PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        stems = pc.utf8_rtrim(low, ".,")
        marked = pc.less(pc.binary_length(stems), pc.binary_length(low))
        stems = stems.dictionary_encode()
        marks = pc.replace_substring_regex(low.filter(marked), "^[^.,]+", "").dictionary_encode()
        # A word is a run of pieces: its stem and its marks, or what the pattern cuts; the library's words are one piece each.
        others = words.filter(pc.invert(plain)).to_pylist()
        numbers: dict[bytes, int] = {}
        known, cut = [], []
        for word in others:
            if SAFE.fullmatch(word) and not any(t in word for t in self.special):
                cut.append([numbers.setdefault(p.encode(), len(numbers)) for p in PIECE.findall(word.lower())])
            else:
                cut.append([-1 - len(known)])
                known.append(self._by_library(word))
        pieces = [*stems.dictionary.cast(pa.binary()).to_pylist(), *marks.dictionary.cast(pa.binary()).to_pylist()]
        ids = [*self._ids_of(pieces), *self._ids_of(list(numbers)), *known]
        here, marked = plain.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        n = np.ones(len(words), np.int64)
        n[np.flatnonzero(here)[marked]] = 2
        n[~here] = list(map(len, cut))
        first = np.cumsum(n) - n
        run = np.zeros(int(n.sum()), np.int64)
        run[first[here]] = stems.indices.to_numpy()
        run[first[here][marked] + 1] = len(stems.dictionary) + marks.indices.to_numpy()
        rest = np.array([p for c in cut for p in c], np.int64)
        rest = np.where(rest >= 0, len(pieces) + rest, len(pieces) + len(numbers) - 1 - rest)
        inside = np.ones(len(run), bool)
        inside[first[here]] = inside[first[here][marked] + 1] = False
        run[inside] = rest
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize)])
        flat, ends = gather(np.frombuffer(b"".join(ids), self.kind), at, run)
        return flat, ends[np.append(first, len(run))]

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (an Arrow string array without nulls), each with the end id if one is given, and where each text's begin and the last's end."""
        import pyarrow.compute as pc

        if not self.fast:
            own = [x.ids + [end] * (end is not None) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in own for i in x], self.kind), np.concatenate([[0], np.cumsum(list(map(len, own)), dtype=np.int64)])
        split = pc.ascii_split_whitespace(texts)
        coded, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        flat, at = self._words(coded.dictionary)
        which = coded.indices.to_numpy()
        if end is not None:
            which = np.insert(which, bounds[1:], len(coded.dictionary))
            flat, at, bounds = np.append(flat, np.array([end], self.kind)), np.append(at, at[-1] + 1), bounds + np.arange(len(bounds))
        ids, place = gather(flat, at, which)
        return ids, place[bounds]


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def of(path: str) -> WordBpe:
    return WordBpe(path)


def release() -> None:
    """Give back what this worker keeps, before work of another kind begins in it: workers outlive their stages."""
    of.cache_clear()
