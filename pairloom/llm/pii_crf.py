"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, payment cards and telephone numbers. A conditional random field,
trained here on a bounded sample whose labels are the patterns' matches and written variants of them, adds spans of
the same kinds. Its tokens are the words around each core: a digit, an @ or a bracketed "at" or "dot". Words further off
are held to "outside", and the transitions from and to them count. Cores of one document that are equal but for their
spelling, or alike in all but their digits, share potentials along skip edges (each with the next one, so edges grow with
the tokens), with a strength of its own for each sort, learned where one end's own look is hidden. The patterns' matches
are known labels, so loopy message passing carries them to the same thing in a spelling that neither patterns nor chain know.
What the field adds is kept if it has the digits, or the @ in some spelling, that its kind needs.
A word that is an entity by itself, but that a pattern ran together with its neighbours and dropped, is one in training.
A null or empty text has no spans. Repeated rows give repeated results; other columns are ignored. Numbers of any length
are compared as text, and work and memory grow with a text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.chain_crf import WIDTH, Chain, Columns, Covered, Flat, train
from pairloom.llm.sampling import bounded_sample
from pairloom.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never begins within a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, however long."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each holds one @, so they are looked for around it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by kind as listed, then start."""
    found = list(emails(text)) if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# Tokens and features

_CORE = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]")
_WORD = re.compile(r"\S+")
_TRIM = "\"'`,;:!?*#$%&|<>=~^"
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: So many words on each side of a core are tokens too.
NEAR = 2


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    core: bool
    joined: bool  # with the token before it, by white space alone


def _words_before(text: str, at: int) -> Iterator[tuple[int, int]]:
    """The words that end before `at`, from the last one on."""
    while True:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if at == end:
            return
        yield at, end


def tokens_of(text: str) -> list[Token]:
    """The words around cores, in order, without outer punctuation."""
    found: dict[int, tuple[int, bool]] = {}
    last, core = 0, _CORE.search(text)
    while core:
        begin = core.start()
        while begin > last and not text[begin - 1].isspace():
            begin -= 1
        finish = m.end() if (m := _WORD.match(text, core.end())) else core.end()
        for _, (a, b) in zip(range(NEAR), _words_before(text, begin), strict=False):
            if a in found:
                break
            found[a] = b, False
        found[begin] = finish, True
        at = finish
        for _ in range(NEAR):
            if not (m := _WORD.search(text, at)):
                break
            at = m.end()
            found.setdefault(m.start(), (at, False))
        last, core = finish, _CORE.search(text, finish)
    out, last = [], None
    for begin in sorted(found):
        finish, is_core = found[begin]
        a, b = begin, finish
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM + ".":
            b -= 1
        if a == b:
            a, b = begin, finish
        out.append(Token(a, b, text[a:b], is_core, last is not None and text[last:begin].isspace()))
        last = finish
    return out


def shape(text: str) -> str:
    return re.sub("a+", "a", re.sub("9+", "9", re.sub("[A-Z]+", "a", re.sub("[a-z]+", "a", re.sub("[0-9]", "9", text)))))


def _neighbour(t: Token | None) -> str:
    """A short word in small letters, or a shape and a number of digits."""
    if t is None:
        return "none"
    return t.text.lower() if t.text.isalpha() and len(t.text) <= 12 else f"{shape(t.text)[:16]} {min(len(digits_of(t.text)), 20)}"


def names_of(tokens: list[Token], k: int) -> list[str]:
    """Shape and size of token k, and its neighbours; no word of the token itself, so nothing is learnt by heart."""
    t = tokens[k]
    before = tokens[k - 1] if k and t.joined else None
    after = tokens[k + 1] if k + 1 < len(tokens) and tokens[k + 1].joined else None
    out = ["bias", f"before {_neighbour(before)}", f"after {_neighbour(after)}"]
    if not t.core:
        return [*out, f"plain {shape(t.text)[:8]}"]
    n, form = len(digits_of(t.text)), shape(t.text)
    runs = re.findall("[0-9]+", t.text)
    parts = t.text.split(".")
    out += [f"shape {form[:24]}", f"digits {min(n, 20)}", f"first {form[:1]}", f"last {form[-1:]}", f"runs {min(len(runs), 6)}"]
    out.append(f"luhn {13 <= n <= 19 and luhn(digits_of(t.text))} {13 <= n <= 19 and form.strip('9 .-') == ''}")
    out.append(f"octets {len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)}")
    out.append(f"at {min(t.text.count('@'), 3)} {bool(re.search(r'[\[({](at|dot)[\])}]', t.text))}")
    out.append(f"lengths {','.join(str(min(len(r), 20)) for r in runs[:5])}")
    return out


def labelled(tokens: list[Token], spans: list[Span]) -> list[int]:
    """B or I of the first span that each token meets."""
    out, k, spans = [], 0, sorted(spans, key=lambda s: s[1:])
    for t in tokens:
        while k < len(spans) and spans[k][2] <= t.start:
            k += 1
        previous = out[-1] if out else 0
        if k == len(spans) or spans[k][1] >= t.end:
            out.append(0)
        else:
            kind = 1 + 2 * KINDS.index(spans[k][0])
            out.append(kind + (t.joined and t.start > spans[k][1] and previous in (kind, kind + 1)))
    return out


def variant(text: str, spans: list[Span], pick: int) -> tuple[str, list[Span]]:
    """The text with its entities in another spelling that the patterns miss, and where they are then."""
    out, at, moved, size = [], 0, [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        old = text[a:b]
        if kind == "email":
            new = old.replace("@", ("(at)", "[at]", "{at}")[pick % 3])
            new = new.replace(".", "[dot]") if pick % 4 == 0 else new
        elif kind == "card" and pick % 3 == 2:  # twice side by side, which the pattern takes for one number
            d = digits_of(old)
            new = f"{d} {d}"
            moved.append((kind, size + a - at, size + a - at + len(d)))
            size += a - at + len(d) + 1
            out += [text[at:a], f"{d} "]
            at, new = a, d
        elif kind == "card":
            d = digits_of(old)
            new = ("." if pick % 2 else "_").join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == "phone":
            new = re.sub(r"^\+", "00" if pick % 2 else "", old).replace(" ", "." if pick % 3 == 0 else " ")
        else:
            new = old.replace(".", "[dot]" if pick % 2 else "[.]")
        out += [text[at:a], new]
        size += a - at
        moved.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join(out) + text[at:], moved


def with_numbers(text: str, pick: int) -> str:
    """The text with a number that is no entity between two words: no address, a date, a version, an amount or a code."""
    n = pick % 9000
    plain = (f"{256 + n % 700}.{n % 300}.{256 + n % 90}.{n % 256}", f"20{n % 90 + 10}-{n % 12 + 1:02}-{n % 28 + 1:02}", f"{n % 20}.{n % 7}.{n % 31}", f"{n}.{n % 100:02}", f"{n % 90 + 10}-{n}-{n * 7 % 9000}-{n % 10}", f"{n % 28 + 1:02}/{n % 12 + 1:02}/{1990 + n % 40}")
    at = text.find(" ", pick % (len(text) + 1))
    at = at if at >= 0 else len(text)
    return f"{text[:at]} {plain[pick % len(plain)]}{text[at:]}"


# The model


def lengths_of(tokens: list[Token]) -> list[int]:
    """Lengths of the runs of tokens next to each other."""
    out: list[int] = []
    for t in tokens:
        if t.joined and out:
            out[-1] += 1
        else:
            out.append(1)
    return out


def spelled_alike(text: str) -> str:
    """The text without what spellings of one thing differ in: cases, brackets, and signs between the digits of a number."""
    low = re.sub(r"[\[({](at|dot|\.)[\])}]", lambda m: "@" if m[1] == "at" else ".", text.lower())
    if sum(c.isdigit() for c in low) < 9 or re.search(r"[^0-9\s._+()/-]", low) or re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", low):
        return low
    return digits_of(low).lstrip("0")


#: Sorts of skip edges.
SAME, LIKE = 0, 1


def skip_edges(tokens: list[Token], whole: dict[int, str] | None = None) -> list[tuple[int, int, int]]:
    """Each core with the next that is the same but for spelling, and with the next of like form (equal but for digits).

    whole: entities of several words by their beginning; these are compared as a whole.
    """
    out, last = {}, {}
    for k, t in enumerate(tokens):
        if not t.core:
            continue
        keys = [(SAME, spelled_alike(t.text)), (LIKE, re.sub("[0-9]", "9", t.text.lower()))]
        if whole and (entity := whole.get(t.start)) and entity != t.text:
            keys.append((SAME, spelled_alike(entity)))
        for key in keys:
            if (j := last.get(key)) is not None and j != k and not (t.joined and j == k - 1):
                out.setdefault((j, k), key[0])
            last[key] = k
    return [(*e, sort) for e, sort in sorted(out.items())]


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the field adds has what its kind can't be without, in any spelling."""
    n = len(digits_of(text))
    if kind == "email":
        return "@" in spelled_alike(text)
    if kind == "ip":
        runs = re.findall("[0-9]+", text)
        return len(runs) == 4 and all(map(octet, runs))
    return 9 <= n <= 15 if kind == "phone" else 13 <= n <= 19 and luhn(digits_of(text))


def alone(tokens: list[Token], covered: Covered) -> list[Span]:
    """Cores outside what is covered that are entities by themselves."""
    found = []
    for t in tokens:
        if t.core and not covered.meets(t.start, t.end):
            found += [(kind, t.start, t.end) for kind, a, b in base_spans(t.text) if b - a == len(t.text)][:1]
    return found


#: Labels of one kind, B and I, agree.
AGREE = np.array([[float((i + 1) // 2 == (j + 1) // 2) for j in range(len(LABELS))] for i in range(len(LABELS))])


def beliefs(e: np.ndarray, edges: np.ndarray, potentials: np.ndarray, which: np.ndarray, *, joint: bool = True, most_rounds: int = 100, close: float = 1e-4, block: int = 20_000) -> tuple[np.ndarray, np.ndarray | None]:
    """Loopy sum-product in the log domain, damped, until messages settle: each token's probabilities and, if asked for,
    each edge's joint ones. Exact where there is no loop. potentials[which[i]] belongs to edge i. Edges are worked on in
    blocks, and messages that have settled rest until their token's belief moves again."""
    n, kinds = len(edges), e.shape[1]
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(n) + n, np.arange(n)])
    both = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    of = np.concatenate([which, which + len(potentials)])
    messages = np.zeros((2 * n, kinds))
    belief, active = e.copy(), np.arange(2 * n)
    for k in range(most_rounds):
        new = np.empty((len(active), kinds))
        for a in range(0, len(active), block):
            rows = active[a : a + block]
            x = (belief[source[rows]] - messages[back[rows]])[:, :, None] + both[of[rows]]
            m = x.max(1, keepdims=True)
            new[a : a + block] = (m + np.log(np.exp(x - m).sum(1, keepdims=True)))[:, 0]
        new -= new.max(1, keepdims=True)
        unsettled = np.zeros(2 * n, bool)
        unsettled[active] = np.abs(new - messages[active]).max(1, initial=0.0) >= close
        messages[active] = new if not k else 0.5 * messages[active] + 0.5 * new
        before, belief = belief, e.copy()
        np.add.at(belief, target, messages)
        moved = np.abs(belief - before).max(1, initial=0.0) >= close / 10
        active = np.flatnonzero(unsettled | moved[source])
        if not unsettled.any():
            break
    if not joint:
        return _softmax(belief), None
    x = (belief[edges[:, 0]] - messages[n:])[:, :, None] + potentials[which] + (belief[edges[:, 1]] - messages[:n])[:, None, :]
    x = np.exp(x - x.max((1, 2), keepdims=True)) if n else x
    return _softmax(belief), x / x.sum((1, 2), keepdims=True)


#: What a known label adds to its token's emission.
SURE = 20.0


@dataclass
class SkipChain:
    """strength: of edges between cores that are the same; like: of those between cores of like form."""

    chain: Chain
    strength: float = 1.0
    least: float = 0.8
    like: float = 0.0

    def marginals(self, flat: Flat, skips: list[tuple[int, ...]], known: np.ndarray | None = None) -> np.ndarray:
        """Each token's probabilities of the labels; forward and backward alone where there are no skip edges.
        skips: (token, token, sort), or two tokens that are the same; known: labels told beforehand, 0 where none is."""
        if not skips:
            return self.chain.marginals(flat)
        edges = np.array([(*s, SAME)[:3] for s in skips], np.int64)
        return self._with_skips(flat, edges, known, joint=False)[0]

    def _with_skips(self, flat: Flat, skips: np.ndarray, known: np.ndarray | None = None, hidden: np.ndarray | None = None, joint: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens' beliefs and, if asked for, skip edges'. hidden: tokens whose own features don't count."""
        first = np.cumsum(flat.lengths) - flat.lengths
        e = self.chain.emissions(flat)
        if hidden is not None:
            e[hidden] = 0.0
        if known is not None:
            at = np.flatnonzero(known)
            e[at, known[at]] += SURE
        e = self.chain.bounded(e, first, first + flat.lengths - 1)
        inner = np.setdiff1d(np.arange(len(e)), first)
        edges = np.concatenate([np.stack([inner - 1, inner], 1), skips[:, :2]])
        which = np.concatenate([np.zeros(len(inner), np.int64), 1 + skips[:, 2]])
        p, pairs = beliefs(e, edges, np.stack([self.chain.transitions, self.strength * AGREE, self.like * AGREE]), which, joint=joint)
        return p, pairs[len(inner) :] if joint else None

    def spans(self, text: str, columns: Columns, base: list[Span]) -> list[Span]:
        """Base spans and the model's that overlap none of them, by kind as listed, then start."""
        tokens, covered = tokens_of(text), Covered([s[1:] for s in base])
        if not any(t.core and not covered.meets(t.start, t.end) for t in tokens):
            return base
        flat = Flat.of([[columns.of(names_of(tokens, k)) for k in range(len(tokens))]])
        flat.lengths = np.array(lengths_of(tokens), np.int64)
        p = self.marginals(flat, skip_edges(tokens, {a: text[a:b] for _, a, b in base}), np.array(labelled(tokens, base), np.int64))
        best = np.where(p.max(1) >= self.least, p.argmax(1), 0).tolist()
        added: list[list] = []
        for k, (t, label) in enumerate(zip(tokens, best, strict=True)):
            kind = KINDS[(label - 1) // 2] if label else None
            if kind and label % 2 == 0 and t.joined and added and added[-1][3] == k - 1 and added[-1][0] == kind:
                added[-1][2:] = [t.end, k, added[-1][4] or t.core]
            elif kind:
                added.append([kind, t.start, t.end, k, t.core])
        free = [(kind, a, b) for kind, a, b, _, core in added if core and not covered.meets(a, b) and plausible(kind, text[a:b])]
        return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1])) if free else base


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


_CASE = "columns array<int>, sizes array<int>, lengths array<int>, labels array<int>, skips array<int>, known array<int>, twice array<int>"


def _cases(max_tokens: int):
    """Texts and variants of them as numbers for training; texts of more than max_tokens tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns()
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                pick = int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=2).digest(), "little")
                set_in = with_numbers(text, pick)
                cases = [(text, spans, ()), (set_in, base_spans(set_in), ())]
                if spans:
                    others = [variant(text, spans, pick + k) for k in range(4)]
                    size = len(text) + 1
                    cases += [(*o, ()) for o in others]
                    cases.append((f"{text}\n{others[0][0]}", spans + [(k, a + size, b + size) for k, a, b in others[0][1]], (1,)))
                for t, own, twice in cases:
                    tokens = tokens_of(t)
                    if 0 < len(tokens) <= max_tokens:
                        marks = [columns.of(names_of(tokens, k)) for k in range(len(tokens))]
                        told = base_spans(t)
                        own = own + alone(tokens, Covered([s[1:] for s in own]))
                        edges = skip_edges(tokens, {a: t[a:b] for _, a, b in told})
                        rows.append(([c for m in marks for c in m], [len(m) for m in marks], lengths_of(tokens), labelled(tokens, own), [x for e in edges for x in e], labelled(tokens, told), twice))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32())) for c in (zip(*rows, strict=True) if rows else [()] * 7)], ["columns", "sizes", "lengths", "labels", "skips", "known", "twice"])

    return run


def learn(docs: DataFrame, max_rows: int = 1_500, max_tokens: int = 1_000, least: float = 0.8, max_linked: int = 300) -> SkipChain:
    """A model from at most max_rows documents with a digit or @ and at most max_tokens tokens, chosen by a hash of doc_id.

    Four variants of each document with entities have them in spellings that the patterns miss; one of each document has
    a number set in that is none. Features are made in tasks,
    and numbers alone reach the driver. The chain is trained first, by itself; the strengths of the skip edges then climb the
    likelihood under the beliefs of message passing, with the features of each edge's second end hidden, as in a spelling
    that the chain doesn't know; they are learned from max_linked texts, documents with one of their variants behind them and
    documents that repeat something themselves. Without documents, nothing is added.
    """
    chosen = bounded_sample(docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text"), "doc_id", max_rows)
    rows = sorted(chosen.select("text").mapInArrow(_cases(max_tokens), _CASE).collect())
    flat_of = lambda rows: Flat(np.array([c for r in rows for c in r.columns], np.int64), np.cumsum([0, *(n for r in rows for n in r.sizes)]), np.array([n for r in rows for n in r.lengths], np.int64))
    single = [r for r in rows if not r.twice]
    labels = np.array([y for r in single for y in r.labels], np.int64)
    model = SkipChain(train(flat_of(single), labels, WIDTH, len(LABELS), held=True, l2=0.0005, steps=150), 0.0, least)
    linked = [r for r in rows if r.skips]
    linked = linked[:: -(-len(linked) // max_linked) or 1]
    if linked:
        starts = np.cumsum([0, *(len(r.labels) for r in linked)])
        skips = np.concatenate([np.array(r.skips, np.int64).reshape(-1, 3) + [s, s, 0] for r, s in zip(linked, starts, strict=False)])
        own, flat = np.array([y for r in linked for y in r.labels], np.int64), flat_of(linked)
        hidden = np.unique(skips[:, 1])
        known = np.array([y for r in linked for y in r.known], np.int64)
        known[hidden] = 0
        sorts = [skips[:, 2] == sort for sort in (SAME, LIKE)]
        agreed = AGREE[own[skips[:, 0]], own[skips[:, 1]]]
        for _ in range(20):
            expected = (model._with_skips(flat, skips, known, hidden)[1] * AGREE).sum((1, 2))
            steps = [(agreed[of] - expected[of]).mean() if of.any() else 0.0 for of in sorts]
            model.strength = max(0.0, model.strength + 5.0 * (steps[SAME] - 0.01 * model.strength))
            model.like = max(0.0, model.like + 5.0 * (steps[LIKE] - 0.01 * model.like))
    return model


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SkipChain) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

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

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in brackets; spans that overlap are one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs with its spans redacted in text, and n_chars, where there is one, brought up to date; nulls stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns()
        for b in slices(batches):
            texts = [t and redacted(t, sent.value.spans(t, columns, base_spans(t))) for t in b.column("text").to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
