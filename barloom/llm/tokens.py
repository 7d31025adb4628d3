"""Token ids of whole texts, in Spark tasks."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

END = 0  # follows each document
#: Chunks whose ids a process keeps: some 170 bytes each.
KEEP = 600_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: ASCII punctuation but for the apostrophe, which may begin a part with letters.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKENIZERS: dict[tuple[str, int], TextTokens] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class TextTokens:
    """Ids by a tokenizer of the `tokenizers` library that drops white space and lower-cases, so that a text's
    ids are those of its chunks between ASCII white space, one after the other. Chunks' ids are kept as
    packed bytes, up to so many chunks; then the store starts anew.

    The tokenizer must split words into letters, single digits and runs of other characters, and mark the
    last token of each part by a suffix; then a chunk's letters and the punctuation that ends it are
    independent, and many words are encoded as one text that those marks divide again."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        described = json.loads(self._tokenizer.to_str())
        suffix = described["model"].get("end_of_word_suffix")
        if '"Lowercase"' not in json.dumps(described["normalizer"]) or not suffix:
            raise ValueError(f"{Path(path).name} does not lower-case or mark ends of words")
        ends = [i for token, i in described["model"]["vocab"].items() if token.endswith(suffix)]
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._ends[ends] = True
        # The same for ASCII letters in lower case alone, which no other step would change.
        described |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self._plain = Tokenizer.from_str(json.dumps(described))
        self._keep, self._known = keep, {}

    def largest_id(self) -> int:
        return len(self._ends) - 1

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Each chunk by itself."""
        found = self._tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_words(self, words: list[bytes], by) -> list[bytes]:
        """Chunks of letters alone, as one text; one by one if that does not divide into as many."""
        ids = np.array(by.encode_batch_fast([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self._ends[ids]) + 1) * ids.itemsize
        if len(stops) != len(words) or stops[-1] != ids.nbytes:
            return self._encode(words)
        data, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
        return [data[a:b] for a, b in zip(starts, stops.tolist(), strict=True)]

    def _learn(self, new: set[bytes]) -> None:
        known, words, others, tailed = self._known, [], set(), []
        for c in new:
            if c.isalpha():  # ASCII letters
                words.append(c)
                continue
            stem = c.rstrip(_PUNCTUATION)
            if stem.isalpha() or stem.decode("utf-8", "replace").lower().isalpha():
                if len(stem) < len(c):
                    tail = c[len(stem) :]
                    tailed.append((c, stem, tail))
                    others.add(tail)
                if stem not in known:
                    words.append(stem)
            else:
                others.add(c)
        plain, wide = [], []
        for w in dict.fromkeys(words):
            (plain if w.isascii() else wide).append(w)
        for some, by in ((plain, self._plain), (wide, self._tokenizer)):
            for i in range(0, len(some), 1000):
                known.update(zip(some[i : i + 1000], self._encode_words(some[i : i + 1000], by), strict=True))
        rest = [c for c in others if c not in known]
        known.update(zip(rest, self._encode(rest), strict=True))
        known.update([(c, known[stem] + known[tail]) for c, stem, tail in tailed])

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, given in UTF-8."""
        if len(self._known) > self._keep:
            self._known = {}
        get = self._known.get
        chunks = [t.translate(_LOWER).split() for t in texts]
        found = [list(map(get, c)) for c in chunks]
        new, holes = set(), []
        for own, ids in zip(chunks, found, strict=True):
            at = -1
            while True:
                try:
                    at = ids.index(None, at + 1)
                except ValueError:
                    break
                new.add(own[at])
                holes.append((ids, at, own[at]))
        if new:
            self._learn(new)
            for ids, at, chunk in holes:
                ids[at] = get(chunk)
        return [b"".join(ids) for ids in found]


def tokenizer(path: str, keep: int = KEEP) -> TextTokens:
    """This process's one for that file, so that tasks of a worker share what it knows."""
    if (path, keep) not in _TOKENIZERS:
        _TOKENIZERS[path, keep] = TextTokens(path, keep)
    return _TOKENIZERS[path, keep]


def forget() -> None:
    """Frees what this process's tokenizers know, for tasks that have no use for it."""
    _TOKENIZERS.clear()


def document_ids(texts, path: str, keep: int = KEEP, block: int = 200):
    """uint32 arrays of the texts' ids with END, in order. texts: UTF-8 bytes or strings; nulls are empty."""
    tokens, end = tokenizer(path, keep), np.array([END], "<u4").tobytes()
    for i in range(0, len(texts), block):
        plain = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts[i : i + block]]
        for ids in tokens.packed(plain):
            yield np.frombuffer(ids + end, "<u4")
