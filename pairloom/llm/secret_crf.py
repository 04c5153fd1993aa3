"""Secret scans by patterns and a linear-chain conditional random field.

Patterns find assignments, access keys and hexadecimal runs. The field, trained here on a bounded sample labelled by
the patterns' matches and by variants of them with other keywords, alphabets and lengths, and by texts with plain numbers set in, tags tokens as beginning, inside
or outside of a secret from their shape, the neighbouring words and features of the whole text; Viterbi decodes it.
Tokens are words, with the key characters inside them, and single signs. All tokens within `NEAR` of a core are tagged: a
keyword ("pwd", "bearer" and the like) or a run of `LONG` key characters that holds a digit or a capital after a small
letter. Tokens further off are held to "outside", and the transitions from and to them count.
Added spans have the kind "secret" and overlap no pattern's match. A null or empty text has none. Repeated rows give
repeated results; other columns are ignored. Work and memory grow with a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.chain_crf import WIDTH, Chain, Columns, Covered, Flat, train
from pairloom.llm.sampling import bounded_sample
from pairloom.llm.words import slices

KINDS = ("assign", "access", "hex")
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def _assignments(text: str) -> Iterator[re.Match]:
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        yield from (m for m in _ASSIGN.finditer(text) if len(m[2]) >= 12)


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by start, then kind as listed."""
    found = [("assign", *m.span()) for m in _assignments(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def values(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand."""
    return [m.span(2) for m in _assignments(text)] + [m.span() for p in (_ACCESS, _HEX) for m in p.finditer(text)]


LONG = 12
#: So many tokens on each side of a core are tagged too.
NEAR = 4
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[+/_.-]+[A-Za-z0-9]+)*|[^\sA-Za-z0-9]")
_LONG = re.compile(rf"[A-Za-z0-9+/_.-]{{{LONG},}}")
_MIXED = re.compile("[0-9]|[a-z][A-Z]")
KEY_WORDS = tuple("password passwd passphrase passcode pwd secret token apikey api_key api-key auth bearer credential private access_key client_key private_key signing".split())
_KEY_WORD = re.compile("|".join(KEY_WORDS), re.I | re.A)
_BOUND = re.compile(r"[A-Za-z0-9+/_.-]")


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    joined: bool  # no token lies between it and the one before it


def cores(text: str) -> list[tuple[int, int]]:
    """Where keywords and long runs with a digit or mixed capitals stand."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    found = [m.span() for m in _KEY_WORD.finditer(text)] if any(k in low for k in KEY_WORDS) else []
    return sorted(found + [m.span() for m in _LONG.finditer(text) if _MIXED.search(m[0])])


_LOWER = {c: c + 32 for c in range(65, 91)}


def _begins_before(text: str, at: int, n: int) -> int:
    """A place at which the n-th token before `at` begins, or an earlier one; never inside a run of key characters."""
    while n and at > 0:
        at -= 1
        if _BOUND.match(text, at):
            while at > 0 and _BOUND.match(text, at - 1):
                at -= 1
            n -= 1
        elif not text[at].isspace():
            n -= 1
    return at


def tokens_of(text: str) -> list[Token]:
    """The tokens within NEAR of cores, in order."""
    out: list[Token] = []
    done = 0  # tokens up to here are out
    for a, b in cores(text):
        if out and a < done:
            begin = done
        else:
            begin = max(done, _begins_before(text, a, NEAR))
        follow = NEAR - sum(t.start >= b for t in out[-NEAR:])  # those that are out count
        for m in _TOKEN.finditer(text, begin):
            if m.start() >= b:
                if not follow:
                    break
                follow -= 1
            gap = text[out[-1].end : m.start()] if out and m.start() - out[-1].end <= 64 else None
            out.append(Token(*m.span(), m[0], gap is not None and (not gap or gap.isspace())))
            done = m.end()
    return out


def _mix(text: str) -> str:
    return "".join(name for name, p in (("U", "[A-Z]"), ("l", "[a-z]"), ("9", "[0-9]"), ("+", "[^A-Za-z0-9]")) if re.search(p, text))


def _remembered(f):
    """f, a function of a token's text, with the results of short texts kept."""
    kept = lru_cache(50_000)(f)
    return lambda text: kept(text) if len(text) <= 64 else f(text)


@_remembered
def _near(text: str) -> str:
    """A keyword, a sign, or what a word is made of."""
    if not text[0].isalnum() or len(text) == 1:
        return text
    key = _KEY_WORD.search(text) if len(text) <= 40 else None
    return f"key {key[0].lower()}" if key else f"{_mix(text)} {min(len(text) // 8, 3)}"


@_remembered
def _own(text: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    n = len(text)
    turns = sum((a.isdigit()) != (b.isdigit()) for a, b in zip(text, text[1:], strict=False))
    humps = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
    digits = sum(c.isdigit() for c in text)
    letters = [c for c in text.lower() if c.isalpha()]
    out = ["bias", f"mix {_mix(text)} {min(n // 4, 3)}", f"size {min(n // 4, 12)}", f"hex {n > 7 and all(c in '0123456789abcdefABCDEF' for c in text)}", f"digits {10 * digits // n}", f"turns {min(turns, 6)}", f"humps {min(humps, 4)}"]
    out.append(f"vowels {10 * sum(c in 'aeiou' for c in letters) // max(1, len(letters))} {not letters} {n >= 12}")
    out.append(f"distinct {10 * len(set(text)) // min(n, 36)} {n >= 12}")
    out.append(f"self {_near(text) if not text[0].isalnum() or _near(text).startswith('key') else 'word'}")
    out.append(f"prefix {bool(re.match('(AKIA|ghp_|sk-|xox|AIza|eyJ)', text))}")
    return tuple(out)


def names_of(tokens: list[Token], k: int, file: list[str]) -> list[str]:
    text, n, out = tokens[k].text, len(tokens[k].text), list(_own(tokens[k].text))
    before: list[str] = []
    for j in range(1, 4):  # the three tokens before, as far as nothing lies between
        if k - j < 0 or not tokens[k - j + 1].joined:
            break
        before.append(_near(tokens[k - j].text))
        out.append(f"before{j} {before[-1]}")
    out.append(f"path {' '.join(before[:2])}")
    # the nearest keyword before, and whether only signs stand between
    key = next((j for j, w in enumerate(before) if w.startswith("key ")), None)
    out.append(f"keyed {key} {key is not None and all(len(w) == 1 for w in before[:key])} {_mix(text)} {n >= 8}")
    for j in (1, 2):
        if k + j >= len(tokens) or not tokens[k + j].joined:
            break
        out.append(f"after{j} {_near(tokens[k + j].text)}")
    return out + [f"{f} {n >= 8}" for f in file]


def file_features(text: str, tokens: list[Token]) -> list[str]:
    keys = sum(t.text[0].isalnum() and len(t.text) <= 40 and bool(_KEY_WORD.search(t.text)) for t in tokens)
    return [f"file keywords {min(keys, 2)}", f"file runs {min(sum(len(t.text) >= LONG for t in tokens), 4)}", f"file assigns {'=' in text or ': ' in text}"]


def lengths_of(tokens: list[Token]) -> list[int]:
    """Lengths of the runs of tokens with nothing between them."""
    out: list[int] = []
    for t in tokens:
        if t.joined and out:
            out[-1] += 1
        else:
            out.append(1)
    return out


OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def labelled(tokens: list[Token], secrets: list[tuple[int, int]]) -> list[int]:
    out, k, secrets = [], 0, sorted(secrets)
    for t in tokens:
        while k < len(secrets) and secrets[k][1] <= t.start:
            k += 1
        if k == len(secrets) or secrets[k][0] >= t.end:
            out.append(OUTSIDE)
        else:
            out.append(INSIDE if t.joined and secrets[k][0] < t.start and out and out[-1] else BEGIN)
    return out


#: What stands before the secrets of variants; some secrets stand alone.
_HEADS = ("pwd = ", "pwd: ", "passwd := ", "auth: ", "Authorization: Bearer ", "credential=", "private key: ", 'client_key = "', "access_key=", "api key: ", "passphrase: ", "signing secret ", "Password - ", "")
_STARTS = ("", "", "", "ghp_", "sk-", "AIza", "eyJ")
_SYLLABLES = tuple("cor rect horse bat ter sta ple green light mo vin ka ro ten del phi sun ny win dow pa per ri ver".split())


def made_up(pick: random.Random) -> str:
    """A random secret: key characters, a passphrase of capitalised words, or a short one with digits or signs."""
    kind = pick.randrange(4)
    if kind == 0:
        return "".join("".join(pick.choice(_SYLLABLES) for _ in range(pick.randrange(1, 3))).capitalize() for _ in range(pick.randrange(2, 5)))
    if kind == 1:
        word = "".join(pick.choice(_SYLLABLES) for _ in range(2))
        return word + pick.choice(("", "!", "#", "_")) + str(pick.randrange(1, 9999)) + pick.choice(("", "x", "!", "Z"))
    alphabet = pick.choice((string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789ABCDEF"))
    return pick.choice(_STARTS) + "".join(pick.choice(alphabet) for _ in range(pick.choice((20, 24, 32, 40, 44))))


def variant(text: str, secrets: list[tuple[int, int]], pick: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with other secrets, behind other words, in the places of the found ones."""
    out, at, moved, size = [], 0, [], 0
    for a, b in sorted(secrets):
        if a < at:
            continue
        head = _ASSIGN.search(text, max(at, a - 24), b)
        start = head.start() if head and head.start(2) == a else a
        new, word = made_up(pick), pick.choice(_HEADS)
        if not word and len(new) < 20:
            word = _HEADS[0]
        out += [text[at:start], word, new]
        size += start - at + len(word)
        moved.append((size, size + len(new)))
        size += len(new)
        at = b
    return "".join(out) + text[at:], moved


def plain_number(pick: random.Random) -> str:
    """An address, a version, a date, a time, an amount or the like."""
    digits = lambda least, most: str(pick.randrange(10 ** (least - 1), 10**most))
    kind = pick.randrange(6)
    if kind == 0:
        return ".".join(str(pick.randrange(256)) for _ in range(4))
    if kind == 1:
        return pick.choice(("v", "", "release-")) + ".".join(digits(1, 2) for _ in range(pick.randrange(2, 5))) + pick.choice(("", "", "-beta", "-rc.1"))
    if kind == 2:
        return f"{digits(4, 4)}-{pick.randrange(1, 13):02}-{pick.randrange(1, 29):02}" + pick.choice(("", f"T{pick.randrange(24):02}"))
    if kind == 3:
        return pick.choice((".", "-", "/")).join(digits(2, 4) for _ in range(pick.randrange(3, 6)))
    if kind == 4:
        return digits(12, 15)
    return f"{digits(3, 6)}.{digits(2, 6)}"


def harmless(text: str, secrets: list[tuple[int, int]], pick: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with plain numbers behind three of its words, in none of the secrets."""
    ends = [m.end() for m in re.finditer(r"\w(?=\s)", text) if not any(a <= m.end() < b for a, b in secrets)]
    places, out, at, size = sorted(pick.sample(ends, min(3, len(ends)))), [], 0, 0
    shifts = []
    for p in places:
        word = " " + plain_number(pick) + pick.choice(("", "", ",", "!!", ")", "."))
        out += [text[at:p], word]
        size += len(word)
        shifts.append((p, size))
        at = p
    moved = [(a + max((n for p, n in shifts if p <= a), default=0), b + max((n for p, n in shifts if p <= a), default=0)) for a, b in secrets]
    return "".join(out) + text[at:], moved


@dataclass
class Tagger:
    chain: Chain

    def spans(self, text: str, columns: Columns, base: list[Span]) -> list[Span]:
        """Base spans and the tagger's that overlap none of them, by start, then kind as listed."""
        tokens, covered = tokens_of(text), Covered([s[1:] for s in base])
        if all(covered.meets(t.start, t.end) for t in tokens):
            return base
        file = file_features(text, tokens)
        e = self.chain.emissions(Flat.of([[columns.of(names_of(tokens, k, file)) for k in range(len(tokens))]]))
        added: list[list[int]] = []
        at = 0
        for n in lengths_of(tokens):
            for k, label in zip(range(at, at + n), self.chain.viterbi(e[at : at + n]), strict=True):
                if label == INSIDE and added and added[-1][2] == k - 1:
                    added[-1][1:] = [tokens[k].end, k]
                elif label != OUTSIDE:
                    added.append([tokens[k].start, tokens[k].end, k])
            at += n
        free = [("secret", a, b) for a, b, _ in added if not covered.meets(a, b)]
        return sorted(base + free, key=lambda s: (s[1], (*KINDS, "secret").index(s[0]))) if free else base


_CASE = "columns array<int>, sizes array<int>, lengths array<int>, labels array<int>"


def _cases(max_tokens: int):
    """Texts and variants of them as numbers for training; texts of more than max_tokens tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns()
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                secrets = values(text)
                pick = random.Random(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest())
                others = [variant(text, secrets, pick) for _ in range(4)] if secrets else []
                for t, own in ((text, secrets), *others, harmless(*others[0], pick) if others else harmless(text, secrets, pick)):
                    tokens = tokens_of(t)
                    if 0 < len(tokens) <= max_tokens:
                        file = file_features(t, tokens)
                        marks = [columns.of(names_of(tokens, k, file)) for k in range(len(tokens))]
                        rows.append(([c for m in marks for c in m], [len(m) for m in marks], lengths_of(tokens), labelled(tokens, own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32())) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["columns", "sizes", "lengths", "labels"])

    return run


def learn(docs: DataFrame, max_rows: int = 1_500, max_tokens: int = 1_000) -> Tagger:
    """A tagger from at most max_rows documents that may have a core, of at most max_tokens tokens, chosen by a hash of
    doc_id. Features are made in tasks, and numbers alone reach the driver. Without documents, nothing is added."""
    likely = F.col("text").rlike(rf"[0-9][A-Za-z0-9+/_=-]{{{LONG - 1}}}") | F.lower("text").rlike("|".join(KEY_WORDS))
    chosen = bounded_sample(docs.where(likely).select("doc_id", "text"), "doc_id", max_rows)
    rows = sorted(chosen.select("text").mapInArrow(_cases(max_tokens), _CASE).collect())
    flat = Flat(np.array([c for r in rows for c in r.columns], np.int64), np.cumsum([0, *(n for r in rows for n in r.sizes)]), np.array([n for r in rows for n in r.lengths], np.int64))
    return Tagger(train(flat, np.array([y for r in rows for y in r.labels], np.int64), WIDTH, 3, held=True, steps=80))


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns()
        for b in slices(batches):
            counts, sums, spans = [], [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                sums.append(hashlib.sha256(text_of(base).encode()).hexdigest())
                spans.append(text_of(sent.value.spans(text or "", columns, base)))
            by_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *by_kind, pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
