"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds spans to them.

The patterns (email, ip, card, phone) are exact and linear in the text.  The field labels every white-space separated
token from word shapes only: which kinds of characters it has, how many digits, how long, and the same of its two
neighbours.  It is trained by maximum likelihood from the small labelled table of ``labelled_table`` and decoded by
Viterbi in numpy batches.

Most tokens can't be anything but "other", whatever stands around them: where the lead of that label is larger than all
that transitions could gain, every best path passes through it.  Decoding therefore needs only the runs between such
tokens, which is exact, and runs of one length are decoded together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Words, slices

LABELS = ("other", "email", "ip", "card", "phone", "secret")
KINDS = ("email", "ip", "card", "phone")  #: those of the patterns, in the order of results; kinds that only the field knows follow
ADDED = ("card", "phone", "secret")  #: labels whose spans the field adds; what it labels email or ip is one only by its pattern
SPANNING = {"card": 19, "phone": 15}  #: labels of numbers over several tokens, and their digits at most
TOKENS = 40  #: of one number at most
ROUNDS = 120

# --- patterns ---------------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(rb"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        begin = floor + len(head.rstrip(_LOCAL))
        floor = at + 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, begin = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((begin, begin + size))
            begin += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; code points, end exclusive."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


# --- word shapes ------------------------------------------------------------------------------------------------------

_KIND = np.zeros(256, np.uint16)  # bit by kind of character
for _bit, _chars in enumerate(("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "", "@", ".", "-", "+()", "")):
    _KIND[[ord(c) for c in _chars]] = 1 << _bit
_KIND[0x80:] = 8
_KIND[[c for c in range(0x21, 0x7F) if not _KIND[c]]] = 256
_TRIM = np.zeros(256, bool)
_EDGES = ".,;:!?\"'()[]<>{}#$%&*="
_TRIM[[ord(c) for c in _EDGES]] = True
_DIGIT = (_KIND == 1).astype(np.uint8)
_DIGIT_BUCKET = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 8, 9, 10, 10, 10, 10, 10, 10, 10, 11])
_LENGTH_BUCKET = np.repeat(np.arange(8), [1, 2, 3, 4, 6, 4, 12, 1])
SHAPES = 512 * 12 * 8


def trimmed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word without the punctuation around it; a word of punctuation alone becomes empty."""
    start, end = words.start.copy(), words.end.copy()
    todo = np.arange(len(start))
    while len(todo := todo[(start[todo] < end[todo]) & _TRIM[words.buf[start[todo]]]]):
        start[todo] += 1
    todo = np.arange(len(start))
    while len(todo := todo[(start[todo] < end[todo]) & _TRIM[words.buf[end[todo] - 1]]]):
        end[todo] -= 1
    return start, end


def shapes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape number of each word, and the range that it was taken from."""
    start, end = trimmed(words)
    if not len(start):
        return np.zeros(0, np.int64), start, end
    bounds = np.stack((start, end), 1).ravel()
    kinds = np.bitwise_or.reduceat(_KIND[words.buf], bounds)[0::2].astype(np.int64)
    digits = np.add.reduceat(_DIGIT[words.buf].astype(np.int32), bounds)[0::2]
    empty = start == end
    kinds[empty], digits[empty] = 0, 0
    shape = (kinds * 12 + _DIGIT_BUCKET[np.minimum(digits, 20)]) * 8 + _LENGTH_BUCKET[np.minimum(end - start, len(_LENGTH_BUCKET) - 1)]
    return shape, start, end


# --- the field --------------------------------------------------------------------------------------------------------


def _features(shape: np.ndarray) -> np.ndarray:
    """Feature numbers of a shape, one from each group: kinds, digits, length, digits with length, each kind by itself."""
    kinds, digits, length = shape // 96, shape // 8 % 12, shape % 8
    single = [740 + 2 * b + (kinds >> b & 1) for b in range(9)]
    return np.stack([kinds, 512 + digits, 524 + length, 540 + digits * 8 + length, *single], -1)


N_FEATURES = 760
OUTSIDE = 0  #: shape number that stands before the first and after the last token


@dataclass(frozen=True)
class Field:
    """Weights by feature and label of the token itself, of the token before and of the token after, and transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def tables(self) -> "Tables":
        f = _features(np.arange(SHAPES))
        own, before, after = (w[f].sum(1).astype(np.float32) for w in (self.own, self.before, self.after))
        lead = [t[:, 0] - t[:, 1:].max(1) for t in (own, before, after)]
        m = self.moves
        gain = max(float((m[:, y][:, None] + m[y][None] - m[:, 0][:, None] - m[0][None]).max()) for y in range(1, len(LABELS)))
        return Tables(own, before, after, lead, gain + 1e-3, m)


@dataclass(frozen=True)
class Tables:
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    lead: list[np.ndarray]
    gain: float
    moves: np.ndarray

    def decode(self, shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and labels of the tokens that may be something else than "other", on the best path of each text."""
        n = len(shape)
        prev, nxt = np.full(n, OUTSIDE), np.full(n, OUTSIDE)
        prev[1:], nxt[:-1] = shape[:-1], shape[1:]
        begins = first[:-1][first[:-1] < first[1:]]
        prev[begins] = OUTSIDE
        nxt[first[1:][first[:-1] < first[1:]] - 1] = OUTSIDE
        open_ = np.flatnonzero(self.lead[0][shape] + self.lead[1][prev] + self.lead[2][nxt] <= self.gain)
        if not len(open_):
            return open_, open_
        head = np.zeros(n + 1, bool)
        head[begins] = True
        new = np.ones(len(open_), bool)
        new[1:] = (open_[1:] != open_[:-1] + 1) | head[open_[1:]]
        run = np.flatnonzero(new)
        length = np.diff(np.append(run, len(open_)))
        score = self.own[shape[open_]] + self.before[prev[open_]] + self.after[nxt[open_]]
        out = np.zeros(len(open_), np.int64)
        for size in np.unique(length):
            at = run[length == size][:, None] + np.arange(size)
            out[at] = viterbi(score[at], self.moves)
        return open_, out


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of a batch (runs, tokens, labels); before and after each run stands label 0."""
    n, size, _ = score.shape
    best = score[:, 0] + moves[0]
    back = np.zeros((size, n, moves.shape[0]), np.int8)
    for t in range(1, size):
        step = best[:, :, None] + moves
        back[t] = step.argmax(1)
        best = step.max(1) + score[:, t]
    out = np.zeros((n, size), np.int64)
    out[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(size - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def train(sentences: list[tuple[str, list[int]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam over forward and backward sums of the whole table."""
    words = Words([s.encode() for s, _ in sentences])
    shape, _, _ = shapes(words)
    n, size, k = len(sentences), int(words.count.max()), len(LABELS)
    grid, gold = np.full((n, size + 2), OUTSIDE), np.zeros((n, size), np.int64)
    mask = np.arange(size) < words.count[:, None]
    for i, (_, labels) in enumerate(sentences):
        grid[i, 1 : 1 + len(labels)] = shape[words.first[i] : words.first[i + 1]]
        gold[i, : len(labels)] = labels
    where = np.nonzero(mask)
    active = []  # tokens by features, for the token itself, the one before and the one after
    for o in (1, 0, 2):
        f = _features(grid[:, o : o + size])[mask]
        active.append(np.zeros((len(f), N_FEATURES), np.float32))
        np.put_along_axis(active[-1], f, 1, 1)
    w = np.zeros((3, N_FEATURES, k))
    moves = np.zeros((k, k))
    m = [np.zeros_like(w), np.zeros_like(moves)]
    v = [np.zeros_like(w), np.zeros_like(moves)]
    last = words.count - 1
    rows = np.arange(n)
    truth = np.zeros((k, k))
    np.add.at(truth, (0, gold[:, 0]), 1)
    np.add.at(truth, (gold[rows, last], 0), 1)
    np.add.at(truth, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for t in range(1, rounds + 1):
        score = np.zeros((n, size, k))
        score[where] = sum(active[j] @ w[j].astype(np.float32) for j in range(3))
        ahead, behind = np.zeros((n, size, k)), np.zeros((n, size, k))
        ahead[:, 0] = score[:, 0] + moves[0]
        for i in range(1, size):
            ahead[:, i] = np.where(mask[:, i, None], lse(ahead[:, i - 1, :, None] + moves, 1) + score[:, i], 0)
        behind[rows, last] = moves[:, 0]
        for i in range(size - 2, -1, -1):
            behind[:, i] = np.where(mask[:, i + 1, None], lse(moves + (score[:, i + 1] + behind[:, i + 1])[:, None], 2), behind[:, i])
        total = lse(ahead[rows, last] + moves[:, 0], 1)
        prob = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, None, None]) * mask[:, 1:, None, None]
        expect = pair.sum((0, 1))
        expect[0] += prob[:, 0].sum(0)
        expect[:, 0] += prob[rows, last].sum(0)
        off = prob
        off[rows[:, None], np.arange(size), gold] -= 1
        off = off[where].astype(np.float32)
        g = np.stack([a.T @ off for a in active])
        grads = [g / n + 1e-3 * w, (expect - truth) / n + 1e-3 * moves]
        for j, (p, d) in enumerate(zip((w, moves), grads, strict=True)):
            m[j] = 0.9 * m[j] + 0.1 * d
            v[j] = 0.99 * v[j] + 0.01 * d * d
            p -= 0.1 * (1 - t / (rounds + 1)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    return Field(w[0], w[1], w[2], moves)


# --- the labelled table -----------------------------------------------------------------------------------------------


def labelled_table(rows: int = 700, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Sentences with a label number for each token: invented words around invented personal data and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    letters = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    hexed = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    plain = lambda: pick((letters(int(rng.integers(1, 13))), letters(int(rng.integers(2, 9))).title(), letters(4) + pick("áéüñç") + letters(2)))

    def alike() -> str:
        return pick((f"{digits(4)}", f"{digits(2)}", f"{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%", f"https://{letters(6)}.example.com/{letters(5)}/{digits(5)}", f"{letters(5).upper()}", f"{letters(4)}-{letters(5)}", f"A{digits(1)}", "BY-NC", "CC", "4.0", f"{digits(3)},{digits(3)}", f"#{digits(6)}", f"{digits(5)}-{digits(2)}", f"{letters(3).upper()}-{digits(4)}", f"{letters(6)}_{letters(4)}", f"{letters(14)}{letters(12)}", f"{letters(7)}.{letters(3)}", "###", "$$$", "&&&", "=", f"{digits(9)}", f"{digits(11)}", f"{digits(24)}", f"{digits(3)}-{digits(2)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{letters(12)}-{letters(14)}", f"{letters(16).upper()}"))

    def private() -> tuple[list[str], int]:
        kind = int(rng.integers(1, 6))
        return {
            1: lambda: [f"{letters(5)}.{letters(4)}{digits(2)}@{letters(6)}.example.org"],
            2: lambda: [".".join(str(int(x)) for x in rng.integers(0, 256, 4))],
            3: lambda: pick((lambda: [digits(16)], lambda: [digits(4) for _ in range(4)], lambda: ["-".join(digits(4) for _ in range(4))]))(),
            4: lambda: pick((lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", digits(3), digits(3), digits(4)], lambda: [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"({digits(3)}){digits(3)}-{digits(4)}"]))(),
            5: lambda: [pick((hexed(32), hexed(40), hexed(64), mixed(24), mixed(32), mixed(40), "AKIA" + mixed(16).upper(), f"sk-{mixed(32)}"))],
        }[kind](), kind

    out = []
    for _ in range(rows):
        tokens: list[str] = []
        labels: list[int] = []
        for _ in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(0, 5))):
                tokens.append(plain() if rng.random() < 0.75 else alike())
                labels.append(0)
            if rng.random() < 0.5:
                found, kind = private()
                if rng.random() < 0.3:
                    found[-1] += pick((".", ",", "###", '"', ")"))
                if rng.random() < 0.2:
                    found[0] = pick(('"', "(")) + found[0]
                tokens += found
                labels += [kind] * len(found)
        tokens.append(plain() + ".")
        labels.append(0)
        out.append((" ".join(tokens), labels))
    return out


# --- over documents ---------------------------------------------------------------------------------------------------


def field_spans(tables: Tables, texts: list[bytes]) -> list[list[tuple[int, int, int, bool]]]:
    """(label number, start byte, end byte, whether it stands right behind the token before and has its label) of the
    tokens that the field labels, for each text."""
    words = Words(texts)
    shape, start, end = shapes(words)
    at, label = tables.decode(shape, words.first)
    keep = (label > 0) & (start[at] < end[at])
    at, label = at[keep], label[keep]
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    text = np.searchsorted(words.first, at, side="right") - 1
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    last = -2
    for i, y, d in zip(at.tolist(), label.tolist(), text.tolist(), strict=True):
        out[d].append((y, int(start[i] - begins[d]), int(end[i] - begins[d]), bool(i == last + 1 and out[d] and out[d][-1][0] == y)))
        last = i
    return out


def _valid(kind: str, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "card":
        return 13 <= digits <= 19 and re.fullmatch(r"[0-9\s-]+", text) is not None and luhn(re.sub("[^0-9]", "", text))
    if kind == "phone":
        return 9 <= digits <= 15 and len(text) > digits
    return len(text.encode()) >= 20 and 0 < digits and any("A" <= c <= "Z" or "a" <= c <= "z" for c in text)


def _whole_numbers(kind: str, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [i, j) of neighbouring pieces that are whole numbers: those that hold the most digits, then the fewest."""
    digits = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in pieces]
    best, back = [(0, 0)], [-1]
    for j in range(1, len(pieces) + 1):
        top, come, held = best[-1], -1, 0
        for i in range(j - 1, max(-1, j - 1 - TOKENS), -1):
            held += digits[i]
            if held > SPANNING[kind]:
                break
            if (got := (best[i][0] + held, best[i][1] - 1)) > top and _valid(kind, text[pieces[i][0] : pieces[j - 1][1]]):
                top, come = got, i
        best.append(top)
        back.append(come)
    out, j = [], len(pieces)
    while j:
        if back[j] >= 0:
            out.append((back[j], j))
        j = back[j] if back[j] >= 0 else j - 1
    return out[::-1]


def _numbers(kind: str, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of whole numbers in neighbouring pieces: first between line ends and trimmed punctuation, then over
    these from what is left, since a number may be wrapped."""
    parts: list[list[int]] = []
    for i, (a, _) in enumerate(pieces):
        if i and not text[pieces[i - 1][1] : a].strip(" \t()"):
            parts[-1].append(i)
        else:
            parts.append([i])
    free, out = [True] * len(pieces), []

    def take(numbers: list[int]) -> None:
        for i, j in _whole_numbers(kind, text, [pieces[n] for n in numbers]):
            out.append((pieces[numbers[i]][0], pieces[numbers[j - 1]][1]))
            for n in numbers[i:j]:
                free[n] = False

    for part in parts:
        take(part)
    if len(parts) > 1:
        rest: list[int] = []
        for n in [*(n for n in range(len(pieces)) if free[n]), -2]:
            if rest and n != rest[-1] + 1:
                take(rest)
                rest = []
            rest.append(n)
    return out


def find(texts: list[bytes], tables: Tables) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]]:
    """For each text the spans of the patterns, and all spans as (kind, start, end) in code points."""
    added = field_spans(tables, texts)
    for raw, more in zip(texts, added, strict=True):
        digit = _ANY_DIGIT.search(raw) is not None
        if not digit and b"@" not in raw:
            yield [], []
            continue
        text = raw.decode("utf-8", "replace")
        base = [(0, a, b) for a, b in emails(text)] if not digit else base_spans(text)
        spans = [(KINDS[k], a, b) for k, a, b in base]
        taken = sorted((a, b) for _, a, b in base)
        done = chars = at = 0
        runs: list[tuple[str, list[tuple[int, int]]]] = []
        floor = 0  # where the last piece, or the last base span behind it, ends
        for y, a, b, follows in more:
            kind = LABELS[y]
            if kind not in ADDED:
                continue
            chars += len(raw[done:a].decode("utf-8", "replace"))
            done = a
            start, end = chars, chars + len(raw[a:b].decode("utf-8", "replace"))
            follows = follows and kind in SPANNING
            while start < end:  # what the patterns' spans leave of the token
                while at < len(taken) and taken[at][1] <= start:
                    follows = follows and taken[at][1] <= floor
                    at += 1
                stop = min(end, max(start, taken[at][0])) if at < len(taken) else end
                piece = text[start:stop]
                if stop < end or start > chars:
                    piece = piece.strip(_EDGES + "-/")
                if piece:
                    begin = text.index(piece, start)
                    if follows and runs and runs[-1][0] == kind:
                        runs[-1][1].append((begin, begin + len(piece)))
                    else:
                        runs.append((kind, [(begin, begin + len(piece))]))
                    floor = begin + len(piece)
                    follows = kind in SPANNING
                if stop == end:
                    break
                start, follows = taken[at][1], False
        for kind, pieces in runs:
            found = _numbers(kind, text, pieces) if kind in SPANNING else [p for p in pieces if _valid(kind, text[p[0] : p[1]])]
            spans += [(kind, a, b) for a, b in found]
        order = {k: i for i, k in enumerate((*KINDS, "secret"))}
        yield base, sorted(spans, key=lambda s: (order[s[0]], s[1]))


@cache
def model(seed: int = 11) -> Field:
    """The field trained from the labelled table; trained once in a process, as it is the same each time."""
    return train(labelled_table(seed=seed))


def _spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_in_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts n_email, n_ip, n_card, n_phone of the patterns' spans, base_sha256 of them, and all spans as text.

    base_sha256 is the hex digest of ``kind:start:end`` of the patterns' spans, comma-joined by kind, then start.  Spans
    of the field are found in what those leave.  A null or empty text has no spans; a null doc_id stays null;
    repeated rows each give a row; other columns are not read.
    """
    field = field or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = field.tables()
        for part, texts in slices(batches):
            counts, digests, spelled = [], [], []
            for base, spans in find(texts, tables):
                counts.append(np.bincount([k for k, _, _ in base], minlength=4)[:4] if base else (0, 0, 0, 0))
                digests.append(hashlib.sha256(_spelled((KINDS[k], a, b) for k, a, b in base).encode()).hexdigest())
                spelled.append(_spelled(spans))
            columns = [pa.array([int(c[k]) for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(spelled, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; all columns and rows stay.

    Where spans of two kinds overlap, the one that starts first (then the longer one) gives the mark.  A column n_chars
    is kept as it is.
    """
    field = field or model()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = field.tables()
        for part, texts in slices(batches):
            out = []
            for raw, (_, spans) in zip(texts, find(texts, tables), strict=True):
                if spans:
                    text, pieces, done = raw.decode("utf-8", "replace"), [], 0
                    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            pieces += [text[done:a], f"<{kind}>"]
                        done = max(done, b)
                    out.append("".join([*pieces, text[done:]]))
                else:
                    out.append(raw.decode("utf-8", "replace"))
            at = names.index("text")
            missing = part.column("text").is_null()
            column = pa.array(out, pa.string())
            if part.column("text").null_count:
                column = pc.if_else(missing, pa.scalar(None, pa.string()), column)
            yield pa.RecordBatch.from_arrays([column.cast(part.column("text").type) if i == at else part.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def labelled_frame(spark: SparkSession) -> DataFrame:
    """The labelled table as a DataFrame: sentence, labels."""
    return spark.createDataFrame([(s, [LABELS[y] for y in ys]) for s, ys in labelled_table()], "sentence string, labels array<string>")
