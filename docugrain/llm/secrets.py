"""Secret scans: base patterns, then a token-efficiency test.

Method: a run of letters, digits and ``+/_=-`` that a tiktoken vocabulary can only cut into short tokens (few
characters per token) is a random string, since words and names are cut into long ones. A run of ``whole`` characters with a digit and a letter is
tested as it is, unless words and numbers make up half of it (a path, a date, a slug, a file name: each separator is a token, so the ratio tells nothing there); if it isn't random, its stretches between words and numbers are (so that a path doesn't hide a secret), and then the parts of
letters and digits between separators, at least ``least`` characters long. Short parts and parts of letters only have stricter
ratios; letters only, in one case or under ``letters`` characters, and short hexadecimal numbers are too like names and identifiers. Known digests (hexadecimal of the usual lengths) and
identifiers (UUIDs, dates, versions, numbers, paths, slugs, file names) are excluded, and so are integrity values, fingerprints, data URLs and content
addresses that say what they are, account numbers with right check digits, sequences of nucleic acids or amino acids, and base64 of plain text; base finds stay whatever they hold.

Defined results: null or empty text has no span; equal rows have equal spans; spans are in code points, end exclusive;
a text of any length is read whole.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_rows, table, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Letters of the key words in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts that are redacted before they go back to Arrow's memory.
SOME = 256
KINDS = ("assign", "access", "hex", "random")
PART = re.compile(r"[A-Za-z0-9]+")
#: Letters and digits in turn, and letters of either case in turn: more than a name with a number or a capital.
TURNS = re.compile(r"[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]")
CASES = re.compile(r"[a-z][A-Z]+[a-z]|[A-Z][a-z]+[A-Z]")
SHORT_KNOWN = re.compile(r"(?:0[xX])?[0-9a-fA-F]+|[0-9]{8}[tT][0-9]{4,6}[zZ]?")
#: Parts of paths, dates and names: numbers, words in one case or with capitals, words with a number before or after.
PLAIN = re.compile(r"[0-9]+|[A-Z]?[a-z]{1,14}|[A-Z]{1,14}|(?:[A-Z]?[a-z]{2,}){2,4}|[A-Za-z]{1,6}[0-9]{1,4}|[0-9]{1,4}[A-Za-z]{1,6}")
#: Hexadecimal digests by length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and identifiers that are public by nature.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|v?\d+(?:[._-]\d+)*)")
#: Digests and content in base64 or other codes that say what they are: integrity values, key fingerprints, data URLs, content addresses.
LABELLED = re.compile(r"sha(?:1|256|384|512)[-:=][A-Za-z0-9+/_-]{26,88}={0,2}|data:[\w.+-]*/?[\w.+-]*(?:;[\w=.-]+)*;base64,[A-Za-z0-9+/=_-]+|\bQm[1-9A-HJ-NP-Za-km-z]{44}\b|\bb[a-z2-7]{58}\b|\bbafy[a-z2-7]{40,}\b", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: Letters of nucleic acids and of proteins.
NUCLEIC, PROTEIN = frozenset("ACGTUN"), frozenset("ACDEFGHIKLMNPQRSTVWY")


@dataclass(frozen=True)
class Efficiency:
    #: Shortest part that is tested: shorter ones have too few tokens to tell.
    least: int = 12
    #: Characters per token at or below which a run is random.
    ratio: float = 2.2
    #: Shortest run that is tested with its separators and by ``ratio``; shorter parts by ``short_ratio``.
    whole: int = 20
    short_ratio: float = 2.0
    #: The same for parts of letters only, from ``letters`` characters on.
    letters: int = 16
    letters_ratio: float = 1.9
    short_letters_ratio: float = 1.7


@lru_cache(2)
def vocabulary(name: str = VOCABULARY):
    """Kept for all tasks of a worker process."""
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def dense(run: str, ratio: float, encoding) -> bool:
    return len(run) <= ratio * len(encoding.encode_ordinary(run))


def mixed(run: str) -> bool:
    return re.search(r"[0-9]", run) is not None and re.search(r"[A-Za-z]", run) is not None


def plain(run: str) -> bool:
    """Whether words and numbers make up half of a run, or one alphabet most of it."""
    parts = PART.findall(run)
    return in_order(run) or 2 * sum(len(p) for p in parts if PLAIN.fullmatch(p)) >= sum(map(len, parts))


def in_order(part: str) -> bool:
    """An alphabet or a stretch of it."""
    return 2 * sum(ord(b) - ord(a) in (0, 1) for a, b in zip(part, part[1:], strict=False)) > len(part)


def random_part(part: str, encoding, how: Efficiency) -> bool:
    """Whether a part without separators is random."""
    n = len(part)
    if n < how.least or KNOWN.fullmatch(part) or in_order(part) or n < how.whole and SHORT_KNOWN.fullmatch(part):
        return False
    if mixed(part) and (n >= how.whole or TURNS.search(part)):
        return dense(part, how.ratio if n >= how.whole else how.short_ratio, encoding)
    if n < how.letters or part.isdigit() or n < how.whole and not CASES.search(part):
        return False
    return dense(part, how.letters_ratio if n >= how.whole else how.short_letters_ratio, encoding)


def random_pieces(run: str, encoding, how: Efficiency) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: the whole, or stretches between words and numbers, or single parts."""
    if KNOWN.fullmatch(run):
        return []
    if len(run) >= how.whole and mixed(run) and not plain(run) and dense(run, how.ratio, encoding):
        return [(0, len(run))]
    parts = [(m.start(), m.end()) for m in PART.finditer(run)]
    if len(parts) == 1:
        return [x for x in parts if random_part(run[x[0] : x[1]], encoding, how)]
    stretches: list[list[tuple[int, int]]] = [[]]
    if len(run) >= how.whole and mixed(run):
        for a, b in parts:
            if run[a:b].isdigit() or not dense(run[a:b], how.ratio, encoding):
                stretches.append([])
            else:
                stretches[-1].append((a, b))
    whole = [(x[0][0], x[-1][1]) for x in stretches if len(x) > 1]
    found = [(a, b) for a, b in whole if b - a >= how.whole and mixed(run[a:b]) and not KNOWN.fullmatch(run[a:b]) and not plain(run[a:b]) and dense(run[a:b], how.ratio, encoding)]
    return found + [(a, b) for a, b in parts if not any(c <= a and b <= d for c, d in found) and random_part(run[a:b], encoding, how)]


def public(piece: str) -> bool:
    """An account number by its check digits, a sequence of nucleic acids or amino acids, or base64 of plain text."""
    if IBAN.fullmatch(piece) and int("".join(str(int(c, 36)) for c in piece[4:] + piece[:4])) % 97 == 1:
        return True
    if piece.isalpha() and (NUCLEIC.issuperset(piece.upper()) or piece.isupper() and PROTEIN.issuperset(piece)):
        return True
    bare = piece.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) < 16 or len(bare) % 4 == 1 or "=" in bare:
        return False
    plain_ = base64.b64decode(bare + "=" * (-len(bare) % 4))
    return all(32 <= b < 127 or b in b"\t\n\r" for b in plain_)


def random_spans(text: str, encoding, how: Efficiency, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs with few characters per token, apart from known ones and those that a base span covers."""
    found = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{min(how.least, how.whole)},}}", text):
        if any(a <= m.start() and m.end() <= b for a, _, b in base):
            continue
        for a, b in random_pieces(m.group(), encoding, how):
            if not public(m.group()) and not public(m.group()[a:b]) and not any(c <= m.start() + a and m.start() + b <= d for c, _, d in base):
                found.append((m.start() + a, 3, m.start() + b))
    if found:
        named = [(m.start(), m.end()) for m in LABELLED.finditer(text)]
        found = [x for x in found if not any(c <= x[0] and x[2] <= d for c, d in named)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, how: Efficiency = Efficiency(), vocabulary_name: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, base) for each row; no shuffle."""

    def make():
        encoding = vocabulary(vocabulary_name)

        def each(batch):
            out = []
            for t in texts(batch):
                base = base_spans(t)
                own = sorted(base + random_spans(t, encoding, how, base))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in own])
            return {"doc_id": batch.column("doc_id"), "spans": out}

        return each

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, how: Efficiency = Efficiency(), vocabulary_name: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """docs with every secret replaced by [SECRET]; all rows stay, a null text stays null, overlapping spans are replaced as one."""

    from collections.abc import Iterator

    import pyarrow as pa

    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = vocabulary(vocabulary_name)

        def one(t):
            if not t:
                return t
            base = base_spans(t)
            merged: list[list[int]] = []
            for a, _, b in sorted(base + random_spans(t, encoding, how, base)):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                t = f"{t[:a]}[SECRET]{t[b:]}"
            return t

        for column in columns:
            # Some texts at a time become Python's: a batch is never held as objects.
            done = [pa.array([one(t.as_py()) for t in column[k : k + SOME]], pa.string()) for k in range(0, len(column), SOME)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())

    clean.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text_col, F.arrow_udf(clean, "string")(F.col(text_col).cast("string")))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return spans.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("random").alias("n_random"),
    )
