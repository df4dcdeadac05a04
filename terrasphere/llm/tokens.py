"""Token ids of whole Arrow batches with a public tokenizer file.

The word-end vocabulary lower-cases, drops white space and merges only inside runs of letters, single digits or runs
of other signs. So the ids of a text are those of its chunks one after the other, where a text may be cut at ASCII
blanks and between an ASCII letter or digit and the signs below (not at apostrophes, which start contractions, nor at
the signs that special tokens consist of). Each distinct chunk of a part is encoded once by the tokenizers library and
kept in a bounded table; tests compare with encoding whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from terrasphere.llm.tables import offsets_of, ranges
from terrasphere.llm.words import LOWER, SPACED, flat, prefix_hash, span_hash, split

END_ID = 1
KEPT_CHUNKS = 800_000
JOINED = 2000
SIGNS = np.isin(np.arange(256), np.frombuffer(b".,;:!?*$%&#()\"=+/@-", np.uint8))
PLAIN = np.array([48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes texts and keeps what it has learned of their chunks."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        # many chunks go in one call, told apart by a special token; a chunk that may hold one goes alone
        mark, number = "<|endoftext|>", self.tokenizer.token_to_id("<|endoftext|>")
        alone = np.array(["<|" in c for c in chunks], bool) if number is not None else np.ones(len(chunks), bool)
        order = np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]
        runs = int((~alone).sum())
        texts = [mark.join(chunks[i] for i in order[k : min(runs, k + JOINED)]) for k in range(0, runs, JOINED)]
        parts, counts = [], []
        for k in range(0, len(texts), 16):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 16], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(ids == number)
                counts.append(np.diff(np.r_[-1, cut, len(ids)]) - 1)
                parts.append(ids[ids != number])
        for e in self.tokenizer.encode_batch_fast([chunks[i] for i in order[runs:]], add_special_tokens=False):
            parts.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        n = np.concatenate(counts)
        at = len(self.ids) + offsets_of(n)[:-1]
        rank = np.argsort(hashes[order])
        new = hashes[order][rank]
        place = np.searchsorted(self.known, new)
        self.known, self.at, self.n = (np.insert(a, place, v) for a, v in ((self.known, new), (self.at, at[rank]), (self.n, n[rank])))
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the start of each text."""
        data, offsets = flat(texts)
        data = LOWER[data]
        doc, starts, ends = split(data, offsets, SPACED)
        plain, sign = PLAIN[data], SIGNS[data]
        cut = np.flatnonzero((plain[:-1] & sign[1:]) | (sign[:-1] & plain[1:])) + 1
        owner = np.searchsorted(starts, cut, side="right") - 1
        inside = cut > starts[owner] if len(starts) else np.zeros(0, bool)
        cut, owner = cut[inside], owner[inside]
        doc, ends = np.concatenate([doc, doc[owner]]), np.concatenate([ends, ends[owner]])
        starts = np.concatenate([starts, cut])
        order = np.argsort(starts, kind="stable")
        starts, doc = starts[order], doc[order]
        ends = np.sort(ends)
        follow = np.flatnonzero(np.isin(starts[1:], cut, assume_unique=True))
        ends[follow] = starts[follow + 1]
        h, first, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_CHUNKS:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[place] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(h[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            place = np.searchsorted(self.known, h)
        at, n = self.at[place][back], self.n[place][back]
        per_doc = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64) + 1
        bounds = offsets_of(per_doc)
        ids = np.full(bounds[-1], END_ID, np.uint32)
        # a word's ids start after those of all words before it and the end ids of earlier texts
        ids[ranges(offsets_of(n)[:-1] + doc, n)] = self.ids[ranges(at, n)]
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which serves one task after the other."""
    return Encoder(path)
