"""Ids of whole texts under a byte-level BPE vocabulary, as the tokenizers library gives them, many texts at once.

Such a vocabulary cuts a text before every space that a character other than white space follows, whatever stands around
it. So texts are split there by Arrow, each distinct word of a batch is encoded once, in one string with all others, and its
ids are told apart by the ids that begin with a space. tiktoken has the same vocabulary and rules; words with characters
beyond U+02FF, whose classes differ between Unicode versions, words with white space at odd places and texts with a special
token go to the tokenizers library itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which a cut at every space would be wrong: white space on both sides of a space.
UNEVEN = rf"[{WHITE}] (?:[{WHITE}]|$)"
#: Words that can't stand in one string with others, or belong to the library.
ALONE = rf"^$|^[{WHITE}]| |[^\x00-\x{{2ff}}]"
#: Bytes of texts that are encoded together.
TOGETHER = 16 << 20


class ByteWords:
    def __init__(self, vocabulary: str, ranks: str):
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.library.no_truncation()
        self.library.no_padding()
        with open(public_tokenizers.path(ranks), "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = np.zeros(max(known.values()) + 1, bool)
        self.spaced[[n for word, n in known.items() if word[:1] == b" "]] = True
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, added)) or None

    def slices(self, batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
        """batch in parts of some TOGETHER bytes of text, a longer text being a part of its own."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + TOGETHER, side="right")))
            yield batch.slice(first, last - first)
            first = last

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        whole = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
        if uneven.any() or whole.any():
            lists = [[t] if w else re.split(r" (?=\S)", t) if u else t.split(" ") for t, u, w in zip(texts.to_pylist(), uneven, whole, strict=True)]
            split = pa.array(lists, pa.list_(pa.string()))
        else:
            split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        # First words have no space before them, so they are numbered by text, after all others.
        firsts = words.take(pa.array(offsets[:-1]))
        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        flat, sizes = self.all_words(coded.dictionary)
        # A text with a special token is one word, which the library has to see whole.
        own = [self.library.encode(w, add_special_tokens=False).ids if s or not w.isascii() else self.fast.encode_ordinary(w) for w, s in zip(firsts.to_pylist(), whole, strict=True)]
        numbers[offsets[:-1]] = len(sizes) + np.arange(len(own))
        ends = [end_id] if end_id is not None else []
        flat = np.concatenate([flat, np.array([k for ids in own for k in ids] + ends, self.kind)])
        sizes = np.concatenate([sizes, [len(ids) for ids in own], [len(ends)]]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        if ends:  # the end is one more word of every text
            numbers = np.insert(numbers, offsets[1:], len(sizes) - 1)
            offsets = offsets + np.arange(len(offsets))
        taken = sizes[numbers]
        upto = np.concatenate([[0], np.cumsum(taken)])
        ids = flat[np.arange(upto[-1]) + np.repeat(starts[numbers] - upto[:-1], taken)]
        return ids, np.diff(upto[offsets])

    def all_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct word with a space before it, one after another, and their numbers."""
        sizes = np.zeros(len(words), np.int64)
        alone = pc.match_substring_regex(words, ALONE).to_numpy(zero_copy_only=False)
        easy, odd = np.flatnonzero(~alone), np.flatnonzero(alone)
        if len(easy):
            line = " " + " ".join(words.take(pa.array(easy)).to_pylist())
            got = self.fast.encode_to_numpy(line, disallowed_special=())
            begins = np.flatnonzero(self.spaced[got])
            if len(begins) != len(easy):
                raise ValueError("the two vocabularies differ")
            sizes[easy] = np.diff(np.append(begins, len(got)))
        else:
            got = np.zeros(0, np.uint32)
        special = [self.library.encode(" " + w, add_special_tokens=False).ids for w in words.take(pa.array(odd)).to_pylist()]
        sizes[odd] = [len(ids) for ids in special]
        if not len(odd):
            return got.astype(self.kind), sizes
        starts, flat = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), self.kind)
        flat[np.repeat(~alone, sizes)] = got
        for k, ids in zip(odd, special, strict=True):
            flat[starts[k] : starts[k] + len(ids)] = ids
        return flat, sizes
