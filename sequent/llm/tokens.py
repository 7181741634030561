"""Token ids of whole texts, by a public vocabulary of the tokenizers library."""

from __future__ import annotations

import numpy as np

from sequent.llm import words

#: The vocabulary's own rule for pieces (fixed value); a merge never crosses a piece.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Distinct words whose ids a Python worker keeps (about 30 bytes each).  Beyond it a worker starts anew.
KEPT_WORDS = 3_000_000

_encoders: dict = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a lower-casing vocabulary with word ends.

    The vocabulary drops white space before it merges, so the ids of a text are those of its words in order, and
    a word's ids are asked of it once per worker.  Words are told apart by their 64-bit hashes.  They are cut
    further between ASCII letters or digits and ASCII marks other than the apostrophe, as the vocabulary does.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._specials = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._pieces = regex.compile(PIECES).findall
        letters = byte_letters()
        self._letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._merger = Tokenizer.from_file(path)  # for pieces: no normalizer, a blank between two of them
        self._merger.normalizer = None
        self._merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._whole.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        kind = np.zeros(256, np.uint8)  # 1: ASCII letter or digit, 2: ASCII mark
        kind[33:127] = 2
        kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
        kind[39] = 0
        self._kind = kind
        self._forget()

    def _forget(self) -> None:
        self._known, self._start, self._size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool, self._used = np.zeros(1 << 16, "<u4"), 0

    def _new(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, laid end to end, and how many each has."""
        pieces, counts, odd = [], [], {}
        for n, word in enumerate(found):
            if word.isascii() and word.isalpha():
                pieces.append(word.decode())
                counts.append(1)
                continue
            text = word.decode()
            if not text.isascii() and max(text) >= "Ā":
                odd[n] = self._whole.encode(text, add_special_tokens=False).ids
                counts.append(0)
                continue
            low = text.lower()
            own = [p.translate(self._letters) for p in ([low] if low.isalpha() else self._pieces(low))]
            pieces += own
            counts.append(len(own))
        texts = [" ".join(pieces[i : i + 512]) for i in range(0, len(pieces), 512)]
        got = [e.ids for e in self._merger.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for x in got for i in x), "<u4", sum(map(len, got)))
        ends = np.concatenate([[0], np.flatnonzero(self._last[ids]) + 1])  # each piece's last id, and no other, ends a word
        if len(ends) != len(pieces) + 1:
            raise ValueError("the vocabulary has no id for some byte at a word's end")
        stops = ends[np.cumsum(counts, dtype=np.int64)] if counts else np.zeros(0, np.int64)
        sizes = np.diff(stops, prepend=0)
        if odd:
            parts, at = [], 0
            for n, own in odd.items():
                parts += [ids[at : stops[n]], np.array(own, "<u4")]
                at, sizes[n] = stops[n], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, sizes

    def _learn(self, hashes: np.ndarray, found: list[bytes]) -> None:
        ids, sizes = self._new(found)
        if self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.zeros(max(len(ids), self._used), "<u4")])
        self._pool[self._used : self._used + len(ids)] = ids
        starts = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        at = np.searchsorted(self._known, hashes)
        self._known, self._start, self._size = (np.insert(a, at, b) for a, b in ((self._known, hashes), (self._start, starts), (self._size, sizes)))

    def _chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk; the start of each word; the number of ids up to each word."""
        data = words.lowered(data)
        kind = self._kind[data]
        cuts = np.zeros(len(data), bool)
        np.equal(kind[1:] + kind[:-1], 3, out=cuts[1:])
        starts, ends = words.spans(data, cuts)
        hashes, first, which = np.unique(words.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._known) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self._known, hashes)
        new = at >= len(self._known)
        new[~new] = self._known[at[~new]] != hashes[~new]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self._known, hashes)
        at = at[which]
        size = self._size[at]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self._pool[np.repeat(self._start[at] - (stop - size), size) + np.arange(total)], starts, stop

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        special = {n for n, t in enumerate(texts) if t and "<|" in t and any(s in t for s in self._specials)}
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for data, owner, stop in words.chunks(["" if n in special else t for n, t in enumerate(texts)]):
            ids, starts, count = self._chunk(data)
            count = np.concatenate([[0], count])[np.searchsorted(starts, stop)].tolist()
            for n, a, b in zip(owner.tolist(), [0, *count], count, strict=False):
                parts[n].append(ids[a:b])
        for n in special:  # a special token's string in a text is that token
            parts[n] = [np.array(self._whole.encode(texts[n], add_special_tokens=False).ids, "<u4")]
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def word_vocabulary() -> str:
    """Place of the 49,408-id word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
