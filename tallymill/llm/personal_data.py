"""Personal data by weak-supervision aggregation.

Each text gives candidate spans: the four base kinds by their patterns, and
looser ones (spelled-out addresses, local phone numbers, national identifiers,
account numbers, credentials, numbers that fail a check). Five labelers vote on
each: shape, check digits or ranges, gazetteer, nearby words, and contrary
evidence. Expectation-maximisation over the counts of all vote patterns of the
corpus estimates each labeler's reliability for each kind; the posteriors train
a logistic span classifier on votes and on coarse features of the span and what is
beside it; it accepts or refuses every candidate that is not a base one. Votes with
features are a fixed set, so only their counts reach the driver; candidates stay in a
table in the shared folder.

Null or empty text: zero counts, no spans. Spans are code points, end exclusive.
Repeated rows each get their row, a null doc_id stays null. A very long text is
scanned whole in one task, in time that follows its length. An empty table gives no
rows. Extra columns are ignored. An added span that overlaps a base span is dropped;
of added spans that overlap, the one that begins first stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "account", "secret")
VOTERS = 5
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:int,rank:int,end:int>>, found array<struct<start:int,rank:int,end:int,pattern:string>>"
)

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,24}"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{9,13}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|(?<=[\"'])[A-Za-z0-9+/_-]{20,}(?=[\"'])|[0-9a-f]{32,64})(?![A-Za-z0-9_])"),
}
# Words near each kind, contrary words, and the gazetteers.
_NEAR = {
    "email": ("mail", "email", "mailto", "contact", "write to", "address"), "ip": ("ip", "host", "server", "address", "login from"), "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "contact"), "national_id": ("ssn", "social", "national id", "passport"), "account": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "key", "api_key", "secret", "password", "passwd", "credential", "credentials", "bearer"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "page", "section", "chapter", "total", "serial", "sha", "commit", "checksum")
#: Shapes of base kinds whose check failed.
_SHAPE = {"ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "card": re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}")}


def _whole(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, not as part of a longer one."""
    return re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])")


_NEAR_WORD, _AGAINST_WORD = {kind: _whole(words) for kind, words in _NEAR.items()}, _whole(_AGAINST)
_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "example", "test")
_COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
_VENDOR = ("AKIA", "ghp_", "sk-")


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's leftmost matches: at each sign, the run of name characters before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        k = at
        while k > end and text[k - 1] in _LOCAL:
            k -= 1
        if k < at and (m := _TAIL.match(text, at)):
            end = m.end()
            out.append((k, end))
        at = text.find("@", max(at + 1, end))
    return out


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, rank of kind, end) of base finds, and of matches that failed their check."""
    good, bad = [], []
    if "@" in text:
        good += [(s, 0, e) for s, e in emails(text)]
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            (good if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) else bad).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                good.append((m.start(), 2, m.end()))
            elif 13 <= len(d) <= 19:
                bad.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 10 <= len(_digits(m[0])) <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


_HAS_DIGIT = re.compile("[0-9]")


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _side(c: str) -> str:
    """Class of a character next to a span: none, letter or digit, space, quote or bracket, sign before a value, other."""
    return "0" if not c else "a" if c.isalnum() else "s" if c.isspace() else "q" if c in "\"'`()[]{}<>" else "=" if c in "=:" else "o"


def span_features(text: str, s: str, digits: int, start: int, end: int) -> str:
    """Features of the span and its context beside the votes: length, share of digits, separators, upper case, and what is on either side."""
    sign = text[start - 2 : start - 1] if text[start - 1 : start].isspace() and start > 1 else text[start - 1 : start]
    after = _side(text[end : end + 1])
    return f"{min(3, len(s) // 12)}{4 * digits // max(1, len(s))}{min(2, sum(c in ' .-()/' for c in s))}{int(any(c.isupper() for c in s))}{_side(sign)}{after if after in 'aq' else 'o'}"


def votes(text: str, rank: int, start: int, end: int, base: bool) -> str:
    """Kind and five votes: y for, n against, - abstains; then the span's features."""
    kind, s = KINDS[rank], text[start:end]
    d = _digits(s)
    form = _LOOSE.get(kind) or _SHAPE.get(kind)
    shape = "y" if base or form and form.fullmatch(s) else "n"
    if kind == "card":
        check = "y" if luhn(d) else "n"
    elif kind == "ip":
        check = "y" if base else "n"
    elif kind == "account":
        check = "y" if _iban(s) else "n"
    elif kind == "phone":
        check = "y" if 10 <= len(d) <= 15 else "n"
    elif kind == "national_id":
        check = "n" if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else "y"
    elif kind == "secret":
        check = "y" if len(set(s)) >= 10 else "n"
    else:
        check = "-"
    lead = s.lstrip("+0")
    listed = {
        "email": s.rpartition(".")[2].lower() in _DOMAINS, "ip": s.startswith(("10.", "192.168.", "172.")), "card": s.startswith(_ISSUERS), "phone": s[0] in "+0" and lead.startswith(_COUNTRY_CODES),
        "secret": s.startswith(_VENDOR),
    }.get(kind, False)
    around = text[max(0, start - 40) : start].lower()
    near = "y" if _NEAR_WORD[kind].search(around) else "-"
    edge = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    against = "n" if edge or _AGAINST_WORD.search(around) else "-"
    return f"{rank}{shape}{check}{'y' if listed else '-'}{near}{against}{span_features(text, s, len(d), start, end)}"


def candidates(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base spans, and all spans to be judged with their vote patterns."""
    if not text:
        return [], []
    good, bad = base_spans(text)
    loose = list(bad)
    has_digit = bool(_HAS_DIGIT.search(text))
    for kind, pattern in _LOOSE.items():
        if has_digit or kind == "email" and ("(at)" in text or "[at]" in text):
            loose += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    out = [(s, r, e, votes(text, r, s, e, True)) for s, r, e in good]
    if loose:
        taken = sorted((s, e) for s, _, e in good)
        free, k, reach = [], 0, 0
        for s, r, e in sorted(set(loose)):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if s >= reach and not (k < len(taken) and taken[k][0] < e):
                free.append((s, r, e))
                reach = e
        out += [(s, r, e, votes(text, r, s, e, False)) for s, r, e in free]
    return good, out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Base counts and spans and all candidates with their vote patterns, a row for each row of ``docs``."""
    span = [("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]

    def run(batches):
        for batch in batches:
            counts, shas, base, found = [[] for _ in BASE], [], [], []
            for text in batch.column(1).to_pylist():
                good, cands = candidates(text)
                for k, c in enumerate(counts):
                    c.append(sum(r == k for _, r, _ in good))
                shas.append(hashlib.sha256(spans_text(good).encode()).hexdigest())
                base.append([{"start": s, "rank": r, "end": e} for s, r, e in good])
                found.append([{"start": s, "rank": r, "end": e, "pattern": p} for s, r, e, p in cands])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(base, pa.list_(pa.struct(span))), pa.array(found, pa.list_(pa.struct([*span, ("pattern", pa.string())])))],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def reliabilities(patterns: list[str], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation, kind by kind.

    Two classes; each labeler has its own vote probabilities in either class.
    """
    code = {"y": 0, "n": 1, "-": 2}
    v = np.array([[code[c] for c in p[1 : 1 + VOTERS]] for p in patterns]).reshape(-1, VOTERS)
    post = np.clip(0.5 + 0.15 * ((v == 0).sum(1) - (v == 1).sum(1)), 0.05, 0.95)
    for kind in sorted({p[0] for p in patterns}):
        own = np.array([p[0] == kind for p in patterns])
        w, x, q = n[own].astype(float), v[own], post[own]
        for _ in range(rounds):
            # priors of one case keep a labeler from becoming certain, and say that it is better than chance
            prior = ((w * q).sum() + 1) / (w.sum() + 2)
            log = np.stack([np.full(len(w), np.log(1 - prior)), np.full(len(w), np.log(prior))])
            for j in range(VOTERS):
                hot = x[:, j][:, None] == np.arange(3)
                for y, weight, pseudo in ((0, w * (1 - q), [0.5, 2, 1]), (1, w * q, [2, 0.5, 1])):
                    m = weight @ hot + pseudo
                    log[y] += np.log(m / m.sum())[x[:, j]]
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(new - q).max(initial=0) < 1e-6:
                break
            q = new
        post[own] = q
    return post


def span_classifier(patterns: list[str], n: np.ndarray, post: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probabilities by a logistic model on votes and features of the span by kind, trained on the votes' posteriors."""
    cells = sorted({(k, p[0], p[k]) for p in patterns for k in range(1, len(p))} | {(0, p[0], "") for p in patterns})
    index = {c: k for k, c in enumerate(cells)}
    at = np.array([[index[0, p[0], ""], *(index[k, p[0], p[k]] for k in range(1, len(p)))] for p in patterns])  # the cells that are 1
    w, beta = n.astype(float), np.zeros(len(cells))
    chance = lambda: 1 / (1 + np.exp(-np.clip(beta[at].sum(1), -30, 30)))
    for _ in range(rounds):
        p = chance()
        gradient, hessian = -beta, np.eye(len(cells))
        for i in range(at.shape[1]):
            gradient = gradient + np.bincount(at[:, i], w * (post - p), len(cells))
            for j in range(at.shape[1]):
                np.add.at(hessian, (at[:, i], at[:, j]), w * p * (1 - p))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return chance()


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, n_added and n_spans of each row of ``docs``."""
    scanned = written(scan(docs), "personal-data")
    table = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().toPandas().sort_values("pattern")
    patterns, n = table["pattern"].tolist(), table["count"].to_numpy()
    accepted = []
    if patterns:
        p = span_classifier(patterns, n, reliabilities(patterns, n))
        accepted = [x for x, q in zip(patterns, p, strict=True) if q >= threshold]
    known = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    key = lambda c: F.struct(c["start"], c["rank"], c["end"])
    added = F.transform(F.filter("found", lambda c: F.array_contains(known, c["pattern"])), key)
    every = F.array_sort(F.array_union(F.transform("base", key), added))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda c: F.concat_ws(":", names[c["rank"]], c["start"].cast("string"), c["end"].cast("string"))), ",")
    return scanned.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", text.alias("spans"), (F.size(every) - F.size("base")).cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))
