"""Personal data by weak supervision.

Strict patterns give the base spans, which stay. Looser patterns propose further spans, on
which labelers vote: shape (patterns), gazetteers (known prefixes, domains and names of
fields), context (the words before), entropy and contrary words. How often each signature of a
span occurs is counted over the whole corpus: its kind, its votes, and features that no labeler
votes on (length, kinds of characters, what stands before it). Base spans are known to be
right, and what the strict patterns match but reject (numbers beyond 255, failed check digits)
to be wrong. Expectation-maximisation estimates every labeler's reliability from these counts; a
logistic classifier of signatures is trained on the resulting probabilities, and it alone keeps or
drops each proposed span.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Base kinds in the order of reports, then the method's own.
KINDS = ("email", "ip", "card", "phone", "ssn", "secret")

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, leftmost and non-overlapping for each kind, in order.

    Each pattern is read in time proportional to the text: an address is read from its @
    to either side, and dotted numbers as whole chains.
    """
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        tail = _EMAIL_TAIL.match(text, at)
        if tail:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, tail.end()))
                free = tail.end()
        at = text.find("@", max(at + 1, free))
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                found.append((start, 1, end))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Looser patterns that propose spans, in order of precedence, with the kind that they propose.
_PROPOSALS = (
    (5, re.compile(r"\bAKIA[0-9A-Z]{12,20}\b")),
    (5, re.compile(r"\b(?:password|passwd|pwd|secret|token|api_?key)[ ]?[=:][ ]?(\S{6,})", re.I)),
    (5, re.compile(r"\"([0-9a-f]{12,})\"")),
    (0, re.compile(r"\b[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\])[ ]?[A-Za-z0-9-]{1,64}(?:[ ]?(?:\(dot\)|\[dot\]|\.)[ ]?[A-Za-z0-9-]{1,64}){1,4}")),
    (4, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (3, re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")),
)
_HINT = re.compile(r"AKIA|[=:\"]|\(at\)|\[at\]|[0-9]{3}[-.)]")

#: Gazetteers: names of fields, mail domains' ends, words before a span of each kind, words that speak against any.
_FIELDS = frozenset("password passwd pwd secret token apikey api_key".split())
_DOMAINS = frozenset("com org net edu gov io de fr es uk".split())
_CONTEXT = (
    frozenset("mail email e-mail contact write address correo courriel".split()), frozenset("ip host server address".split()),
    frozenset("card visa mastercard credit payment tarjeta carte karte".split()), frozenset("phone tel call fax mobile telefon telefono".split()),
    frozenset("ssn social security".split()), frozenset("password secret key token login credentials".split()),
)
_AGAINST = frozenset("version isbn page figure table chapter sha commit revision example".split())
LABELERS = ("shape", "gazetteer", "context", "entropy", "contrary")
_AT = re.compile(r"\(at\)|\[at\]|@")


def votes(text: str, start: int, end: int, kind: int, value: str) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    span, before = text[start:end], re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-5:]
    digits = _digits(value)
    if kind == 5:
        shape = 1 if span.startswith("AKIA") and len(span) == 20 or len(value) >= 12 and any(c.isdigit() for c in value) else -1 if value.isalpha() or value.isdigit() else 0
        field = re.match(r"\w+", span)
        gazetteer = 1 if span.startswith("AKIA") or field and field.group().lower() in _FIELDS else 0
    elif kind == 0:
        shape, gazetteer = (1 if _AT.search(span) else 0), (1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in _DOMAINS else 0)
    elif kind == 1:
        parts = span.split(".")
        shape, gazetteer = (1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1), (-1 if parts[0].lstrip("0") == "" else 0)
    elif kind == 2:
        shape, gazetteer = (1 if 14 <= len(digits) <= 19 and luhn(digits) else -1), (1 if digits[0] in "3456" else -1)
    elif kind == 4:
        shape, gazetteer = 1, (-1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1)
    else:
        shape = 1 if span[0] == "+" and 10 <= len(digits) <= 15 or "(" in span or span.count("-") + span.count(".") == 2 else -1 if span[0] == "+" else 0
        gazetteer = 0 if span[0] == "+" else -1 if digits[0] in "01" else 1
    context = 1 if _CONTEXT[kind].intersection(before) else 0
    counts = np.unique(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    entropy = float(-(counts / counts.sum() * np.log2(counts / counts.sum())).sum())
    random = (1 if entropy >= 2.8 else -1) if kind == 5 else 0
    return shape, gazetteer, context, random, -1 if _AGAINST.intersection(before) else 0


def signature(text: str, start: int, end: int, kind: int, value: str) -> int:
    """All that the model sees of a span: kind, length class, classes of its characters, what stands before it, votes."""
    chars = any(c.isupper() for c in value) + 2 * any(c.islower() for c in value) + 4 * any("0" <= c <= "9" for c in value) + 8 * any(not c.isalnum() for c in value)
    prior = text[start - 1] if start else " "
    lead = 0 if prior.isspace() else 1 if prior in "=:" else 2 if prior in "\"'(<[" else 3
    code = ((kind * 4 + min(3, (end - start) // 10)) * 16 + chars) * 4 + lead
    for v in votes(text, start, end, kind, value):
        code = code * 3 + v + 1
    return code


#: There are at most so many signatures.
MOST = len(KINDS) * 4 * 16 * 4 * 3 ** len(LABELERS)


def known(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(signature, truth) of spans whose truth the strict patterns tell: base spans, and what they match but reject."""
    found = [(signature(text, s, e, k, text[s:e]), 1) for s, k, e in base]
    held = {(k, e) for _, k, e in base}
    for kind, pattern in ((1, _DOTTED), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            if (kind, m.end()) not in held and (kind != 1 or m.group().count(".") == 3) and (kind != 2 or len(_digits(m.group())) <= 19):
                found.append((signature(text, *m.span(), kind, m.group()), 0))
    return found


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, signature) of proposed spans that overlap neither base spans nor each other.

    A field's value with such spans inside, as an address in a connection string, is proposed in the parts around these.
    """
    if not _HINT.search(text):
        return []
    taken = sorted((s, e) for s, _, e in base)
    found: list[tuple[int, int, int, int]] = []
    for kind, pattern in _PROPOSALS:
        for m in pattern.finditer(text):
            s, e = m.span()
            i = bisect.bisect(taken, (s, math.inf))
            free = [(s, e)]
            if i and taken[i - 1][1] > s or i < len(taken) and taken[i][0] < e:
                if kind != 5:
                    continue
                free, at = [], s
                for a, b in [t for t in taken[max(0, i - 1) :][: bisect.bisect(taken, (e,)) - max(0, i - 1)] if t[1] > s]:
                    if at < a:
                        free.append((at, a))
                    at = max(at, b)
                free = [(a, b) for a, b in [*free, (at, e)] if max(a, m.start(m.lastindex or 0)) < b]
            code = signature(text, s, e, kind, m.group(1) if m.lastindex else m.group())
            for part in free:
                bisect.insort(taken, part)
                found.append((part[0], kind, part[1], code))
    return sorted(found)


def _decode(code: int) -> tuple[int, int, int, int, tuple[int, ...]]:
    """kind, length class, classes of characters, what stands before, votes."""
    cast = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        cast.append(v - 1)
    code, lead = divmod(code, 4)
    code, chars = divmod(code, 16)
    return code // 4, code % 4, chars, lead, tuple(reversed(cast))


@dataclass(frozen=True)
class Model:
    """Signatures of spans that are kept; what was estimated on the way is for reports."""

    kept: frozenset[int]
    reliability: dict[str, float]
    weights: tuple[float, ...]


def estimate(cast: np.ndarray, n: np.ndarray, told: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM: the probability that each pattern of votes is of a right span, and table[truth, labeler, vote + 1], the chance of a vote of one that speaks.

    `n` tells how often a pattern occurs, `told` its truth where that is known, else -1. Labelers are taken to be
    independent given the truth; that one keeps silent says nothing, as labelers speak of some kinds alone. The start
    says that a vote is right four times in five. Pseudo-counts keep a vote's meaning where few spans speak about it.
    """
    free = told < 0
    truth = np.where(free, 1 / (1 + np.exp(-np.log(4.0) * cast.sum(1))), told)
    table = np.zeros((2, cast.shape[1], 3))
    for _ in range(rounds):
        prior = (n[free] @ truth[free] + 1) / (n[free].sum() + 2)  # of the spans that it is asked of
        for y, w in ((0, 1 - truth), (1, truth)):
            for v in (-1, 1):
                table[y, :, v + 1] = (n * w) @ (cast == v) + (8 if v == (1 if y else -1) else 2)
            table[y] /= table[y].sum(1, keepdims=True)
        says = np.log(table[1] / np.maximum(table[0], 1e-300), where=table[1] > 0, out=np.zeros_like(table[1]))
        odds = np.log(prior / (1 - prior)) + (cast == 1) @ says[:, 2] + (cast == -1) @ says[:, 0]
        truth = np.where(free, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), told)
    return truth, table


def learn(counts: dict[tuple[int, int], int]) -> Model:
    """EM over votes, then a logistic classifier on signatures, from counts of (signature, truth or -1)."""
    if not counts:
        return Model(frozenset(), {}, ())
    keys = sorted(counts)
    n, told = np.array([counts[k] for k in keys], float), np.array([k[1] for k in keys], float)
    parts = [_decode(k[0]) for k in keys]
    cast = np.array([p[4] for p in parts])
    truth, _ = estimate(cast, n, told)
    reliability = {name: float((n * np.where(cast[:, j] > 0, truth, 1 - truth) * (cast[:, j] != 0)).sum() / max(1e-9, (n * (cast[:, j] != 0)).sum())) for j, name in enumerate(LABELERS)}
    chars = np.array([[p[2] >> b & 1 for b in range(4)] for p in parts])
    x = np.concatenate([np.ones((len(keys), 1)), np.eye(len(KINDS))[[p[0] for p in parts]], np.eye(4)[[p[1] for p in parts]], chars, np.eye(4)[[p[3] for p in parts]], cast], 1)
    w = np.zeros(x.shape[1])
    # what is known mustn't drown what is asked: each side has half the weight
    share = np.where(told < 0, n / max(n[told < 0].sum(), 1), n / max(n[told >= 0].sum(), 1)) / 2
    for _ in range(50):  # Newton's steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - truth)) + 1e-4 * w
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), slope)
    sure = x @ w
    return Model(frozenset(k[0] for k, s in zip(keys, sure, strict=True) if k[1] < 0 and s >= 0), reliability, tuple(w.tolist()))


def fit(docs: DataFrame) -> Model:
    """Counts signatures over every whole text, and sums over the table; there are at most three times `MOST` counts, and few in fact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, int], int] = {}
        for batch in batches:
            for text in batch["text"]:
                if value := text.as_py():
                    base = base_spans(value)
                    for key in [*known(value, base), *((code, -1) for *_, code in proposals(value, base))]:
                        tally[key] = tally.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.int64()), pa.array([k[1] for k in tally], pa.int32()), pa.array(list(tally.values()), pa.int64())], names=["code", "told", "n"])

    rows = pick(docs, "text").mapInArrow(count, "code long, told int, n long").groupBy("code", "told").agg(F.sum("n").alias("n")).collect()
    return learn({(r.code, r.told): r.n for r in rows})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the kept proposals, in order of start and kind."""
    base = base_spans(text)
    return base, sorted(base + [(s, k, e) for s, k, e, code in proposals(text, base) if code in model.kept])


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """Base counts and digest, all spans (kind:start:end in code points) and their number, a row for each document.

    A null or empty text has none. Repeated rows and null doc_ids each give a row; an empty
    table gives none. Whole texts are read, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, number = [], [], [], []
            for text in batch["text"]:
                base, every = all_spans(text.as_py() or "", model)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(4)])
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                number.append(len(every))
            by_kind = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(by_kind[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(number, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, COLUMNS)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with personal data masked in text; other columns pass unchanged.

    A null text stays null, an empty one empty. Each repeated row and each row with a null doc_id gives a row; an empty table gives none.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (v := t.as_py()) is None else mask(v, all_spans(v, model)[1]) for t in batch.column(at)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
