"""BPE encoding and decoding by dynamic programming over prefixes.

Method: the encoding of every prefix of a word ends in one certain token. For each prefix, the vocabulary's tokens that
are suffixes of it are found by an automaton over all tokens (goto and suffix links, longest match first); the one whose
predecessor, the last token of the prefix before it, is compatible with it is that prefix's last token. Two neighbours
are compatible if merging would keep their border, which their own merge histories tell. Following the stored last
tokens back from the whole word gives the ids, the same as by applying merges in order of rank.

The normaliser and the splitter are those of the vocabulary file, run on each distinct word (words of printable ASCII are
cut into runs of letters, digits and signs instead, where a trial shows that the file's splitter does the same): white space always splits,
so that words can be handled one by one and kept in a memo of bounded size.

Defined results: null or empty text has no ids and decodes to ""; equal texts have equal ids; special tokens in a text
are their own ids; any length is encoded whole. Ids decode to their tokens, joined by one space (the file has no decoder).
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from .common import MEMO, id_text, map_rows, table, texts

VOCABULARY = "word_bpe_49k.json"
NEVER = 1 << 60
#: Runs of letters, single digits, runs of other signs; and words to which only these apply (no special token, no apostrophe).
RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
ASCII_WORD = re.compile(r"[!-&(-;=-~]+")
#: Words whose ids and digests a worker holds (some 300 bytes each) before it starts anew; results don't depend on it.
HELD = 800_000
#: The same for words whose ids only are held, beside other stages' memory: half of them older ones, which go unless they are met again.
HELD_IDS = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixBPE:
    """Encoder and decoder for one vocabulary file of the kind BPE with word-end suffix and byte-level letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = r
            self.parts.setdefault(whole, (left, right))
        self.made_at = {whole: self.rank[p] for whole, p in self.parts.items()}
        self.right_spine: dict[int, list] = {}
        self.left_spine: dict[int, list] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self._build_automaton()
        # Whether runs of printable ASCII are what normaliser and splitter make of such words, as tried on each character and some mixtures.
        signs = [chr(c) for c in range(0x21, 0x7F) if chr(c) not in "<'"]
        tried = [*signs, *(f"{x}{y}" for x in signs for y in "aZ09.-"), "".join(signs), "abcXYZ", "a1b22C!?x--9"]
        self.ascii_runs = all(RUNS.findall(w.lower()) == self._split(w) for w in tried)

    def _split(self, text: str) -> list[str]:
        return [piece for piece, _ in self.split(self.normalize(text))]

    # The last letter of a word carries the suffix, as one symbol: a final state is a letter and the suffix together.
    def _symbols(self, text: str, ended: bool) -> list[str]:
        return [*text[:-1], text[-1] + self.suffix] if ended else list(text)

    def _build_automaton(self) -> None:
        """Trie of the tokens' symbols; each state's longest own token, and its link to the longest proper suffix state that ends a token."""
        self.go: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        for text, i in self.vocab.items():
            ended = bool(self.suffix) and text.endswith(self.suffix) and len(text) > len(self.suffix)
            at, own = 0, self._symbols(text[: -len(self.suffix)] if ended else text, ended)
            for s in own:
                step = self.go[at].get(s)
                if step is None:
                    step = self.go[at][s] = len(self.go)
                    self.go.append({})
                    self.ends.append(None)
                at = step
            self.ends[at] = (i, len(own))
        self.fail = [0] * len(self.go)
        queue = list(self.go[0].values())
        self.matches: list[tuple] = [()] * len(self.go)
        for at in queue:
            self.matches[at] = ((self.ends[at],) if self.ends[at] else ()) + self.matches[self.fail[at]]
            for s, step in self.go[at].items():
                back = self.fail[at]
                while back and s not in self.go[back]:
                    back = self.fail[back]
                self.fail[step] = self.go[back].get(s, 0)
                queue.append(step)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stood at the token's right (1) or left (0) border while it was built: (piece, rank of the merge that ended it)."""
        memo = self.right_spine if side else self.left_spine
        got = memo.get(token)
        if got is None:
            got, at, until = [], token, NEVER
            while True:
                got.append((at, until))
                if at not in self.parts:
                    break
                until = self.made_at[at]
                at = self.parts[at][side]
            got.reverse()
            memo[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """True if no merge ever crosses the border of the two tokens."""
        known = self.fits_memo.get((left, right))
        if known is None:
            a, b, i, j, known = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                across = self.rank.get((x, y), NEVER)
                # At equal rank the leftmost pair goes first: left's own merge before the crossing one, that before right's.
                if across != NEVER and across < x_until and across <= y_until:
                    known = False
                    break
                if x_until == y_until == NEVER:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.fits_memo) >= 4 * MEMO:
                self.fits_memo.clear()
            self.fits_memo[left, right] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece that the splitter gives: letters of the byte alphabet."""
        symbols = self._symbols(text, bool(self.suffix))
        go, fail, matches, fits, fitting = self.go, self.fail, self.matches, self.fits, self.fits_memo.get
        last, at = [(-1, 0)], 0
        for k, s in enumerate(symbols, 1):
            step = go[at].get(s)
            while step is None and at:
                at = fail[at]
                step = go[at].get(s)
            at = step or 0
            for token, size in matches[at]:
                before = last[k - size][0]
                if before >= 0:
                    known = fitting((before, token))
                    if known is None:
                        known = fits(before, token)
                else:
                    known = size == k and self._whole(token)
                if known:
                    last.append((token, size))
                    break
            else:
                last.append((-2, 1))
        ids, k = [], len(symbols)
        while k:
            token, size = last[k]
            if token < 0:
                raise ValueError(f"no encoding of {text!r}")
            ids.append(token)
            k -= size
        return tuple(reversed(ids))

    def _whole(self, token: int) -> bool:
        """True if merging the token's own symbols gives the token: its two parts, whole themselves, meet before either changes."""
        known = self.fits_memo.get((-1, token))
        if known is None:
            known = True
            if token in self.parts:
                left, right = self.parts[token]
                made = self.made_at[token]
                known = self._whole(left) and self._whole(right) and self._meet(left, right, made)
            self.fits_memo[-1, token] = known
        return known

    def _meet(self, left: int, right: int, made: int) -> bool:
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y), NEVER)
            if across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        return self.rank.get((left, right)) == made

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a text without ASCII white space (or of any text)."""
        if self.ascii_runs and ASCII_WORD.fullmatch(word):
            runs = RUNS.findall(word.lower())
            return self._known(runs[0]) if len(runs) == 1 else tuple(i for run in runs for i in self._known(run))
        ids: list[int] = []
        for part in self.cut_special.split(word) if self.cut_special and "<" in word else (word,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self._split(part):
                    ids.extend(self._known(piece))
        return tuple(ids)

    def _known(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.piece(piece)
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        memo, ids = self.words, []
        for w in text.encode().split():
            own = memo.get(w)
            if own is None:
                if len(memo) >= HELD_IDS // 2:
                    self.older, self.words = memo, {}
                    memo = self.words
                own = self.older.get(w)
                memo[w] = own = self.word(w.decode()) if own is None else own
            ids += own
        return ids

    def decode(self, ids) -> str:
        return " ".join(self.token[i] for i in ids)


_loaded: dict[str, PrefixBPE] = {}


def bpe(path: str) -> PrefixBPE:
    """One automaton for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = PrefixBPE(path)
    return _loaded[path]


def encode_ids(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids array<int> for each row."""

    def make():
        import pyarrow as pa

        model = bpe(vocabulary_path(vocabulary))

        def each(batch):
            # One array at a time, in four bytes an id: a batch's ids as Python lists would take ten times the memory.
            ids = [pa.array(model.encode(t), pa.int32()) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in ids], "ids": pa.ListArray.from_arrays(pa.array([0, *_running(ids)], pa.int32()), pa.concat_arrays(ids))}

        return each

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids array<int>")


def _running(arrays):
    from itertools import accumulate

    return accumulate(len(x) for x in arrays)


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and the text that the ids decode to, for each row."""

    def make():
        model = bpe(vocabulary_path(vocabulary))

        def each(batch):
            ids = [model.encode(t) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [model.decode(x) for x in ids]}

        return each

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


class Strings(dict):
    """Memo from a word's bytes to (number of ids, ids as text, decoded text), for digests of whole documents."""

    def __init__(self, model: PrefixBPE):
        self.model, self.runs = model, {}
        #: Each id as text and its token, so that neither is made again for each word.
        self.said = {i: (str(i).encode(), t.encode()) for i, t in model.token.items()}

    def _of(self, ids: tuple[int, ...]):
        said = self.said
        if len(ids) == 1:
            return 1, *said[ids[0]]
        own = [said[i] for i in ids]
        return len(ids), b" ".join([x[0] for x in own]), b" ".join([x[1] for x in own])

    def _run(self, run: str):
        """The same of one run of letters or signs, which many words share: those before a comma, in capitals, with a sign after them."""
        if len(self.runs) >= MEMO:
            self.runs.clear()
        got = self.runs[run] = self._of(self.model.piece(run))
        return got

    def __missing__(self, word: bytes):
        if len(self) >= HELD:
            self.clear()
        text, known = word.decode(), self.runs.get
        if self.model.ascii_runs and ASCII_WORD.fullmatch(text):
            parts = [known(r) or self._run(r) for r in RUNS.findall(text.lower())]
            got = parts[0] if len(parts) == 1 else (sum([p[0] for p in parts]), b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts]))
        else:
            got = self._of(self.model.word(text))
        self[word] = got
        return got


#: Kept for all tasks of a worker process.
_strings: dict[str, Strings] = {}


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode_texts gives, as counts and SHA-256 digests: no id leaves its worker, so nothing is shuffled or held."""

    def make():
        path = vocabulary_path(vocabulary)
        memo = _strings.setdefault(path, Strings(bpe(path)))

        def one(text: str):
            parts = [memo[w] for w in text.encode().split()]
            ids, decoded = hashlib.sha256(), hashlib.sha256()
            ids.update(b" ".join([p[1] for p in parts if p[0]]))
            decoded.update(b" ".join([p[2] for p in parts if p[0]]))
            return sum(p[0] for p in parts), ids.hexdigest(), decoded.hexdigest()

        def each(batch):
            rows = [one(t) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

        return each

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
