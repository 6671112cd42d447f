"""Personal data by weak-supervision aggregation.

Candidate spans are what base patterns (e-mail, IP, card, phone) and wider ones find: spelled-out
e-mails, IPv6, national phone numbers, IBANs, secrets behind a keyword, and, on purpose much too
wide, any long run of digits and any long token of letters and digits. Labelers of three sorts,
regular expressions with checksums, gazetteers and context words, vote yes, no or nothing on each.
The numbers of vote patterns over all documents (a table bounded by the patterns, not by the
data) go to the driver, where expectation-maximisation estimates each labeler's reliability
without labels, and a logistic span classifier is trained on the resulting probabilities. It
decides which wider spans are added; base spans always stay.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive;
spans never overlap those of a kind, and wider ones none at all (base spans go first, then the
leftmost of the pattern that comes first); rows repeat as they are; an empty table gives an empty
table; extra columns are ignored. All searches are linear in the text but for the logarithm of the
number of spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = frozenset("0123456789")
#: (kind, pattern, characters one of which it needs, whether the pattern alone is a yes).
WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++"), "([", False),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), ":", False),
    ("secret", re.compile(r"(?<![A-Za-z])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{8,}+)", re.I), "=:", True),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), "", True),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[ ./-]{1,2}[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])"), "", False),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"), "", False),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"), "0123456789", False),
)
#: Fixed values of the gazetteer labelers.
TOP_DOMAINS = frozenset("com net org edu gov io info biz de fr es it uk us eu ch at be nl pl pt ru jp cn in br ca au mx co me dev app".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38", "22", "23", "24", "25", "26", "27")
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
TOKEN_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "ya29", "npm_", "pypi-")
FOR = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to|e-?post", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|client|servidor|serveur", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|anruf|appel|llama|cell", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank|banque|banco", re.I),
    "secret": re.compile(r"key|token|secret|passw|pwd", re.I),
}
AGAINST = re.compile(r"version|isbn|issn|order|invoice|article|part no|serial|doi|page|chapter|example", re.I)
REACH = 24
#: A wider span is added from this probability on.
THRESHOLD = 0.8


def emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses from the left, looking back from each at-sign (linear in the text)."""
    done = 0
    for m in DOMAIN.finditer(text):
        s = at = m.start()
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the four base kinds."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 38 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
    return out


def wide_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the pattern is a yes) of the wider patterns' spans that touch no other span."""
    taken = sorted(s for spans in base.values() for s in spans)
    reach, most = [], 0  # base spans of two kinds may overlap: ends as far as any span up to here
    for _, e in taken:
        most = max(most, e)
        reach.append(most)
    own: list[tuple[int, int]] = []
    out, digits = [], DIGIT.search(text) is not None
    for kind, pattern, needs, strong in WIDE:
        if (needs and not any(c in text for c in needs)) or (kind in ("ip", "phone", "iban", "card") and not digits):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(1) if pattern.groups else m.span()
            if kind == "secret" and not strong and (m[0].isalpha() or m[0].isdigit() or not any(c in DIGITS for c in m[0])):
                continue
            k, j = bisect_left(taken, (e, 0)), bisect_left(own, (e, 0))
            if not (k and reach[k - 1] > s or j and own[j - 1][1] > s):
                out.append((kind, s, e, strong))
                insort(own, (s, e))
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, s: int, e: int, strong: bool) -> tuple[int, ...]:
    """The labelers' votes, 0 no, 1 nothing, 2 yes: pattern, checksum, gazetteer, context for, context against, edges."""
    span = text[s:e]
    digits = "".join(c for c in span if c in DIGITS)
    check = {"card": lambda: luhn(digits), "iban": lambda: iban_ok(span), "ip": lambda: strong or span.count(":") == 7}.get(kind)
    known = None
    if kind == "email":
        known = re.split(r"[.\])]", span.rstrip(" "))[-1].strip().lower() in TOP_DOMAINS
    elif kind == "phone":
        known = digits.startswith(CALLING_CODES) if span[0] == "+" else None if not 9 <= len(digits) <= 13 else True if span[0] in "0(" else None
    elif kind == "card":
        known = digits.startswith(ISSUERS)
    elif kind == "iban":
        known = span[:2] in COUNTRIES
    elif kind == "secret":
        mixed = len(set(span)) >= 8 and digits and any(c.isalpha() for c in span)
        known = True if span.startswith(TOKEN_HEADS) or strong and mixed else False if span.isalpha() or span.isdigit() else None
    near = text[max(0, s - REACH) : s]
    edge = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
    return (
        2 if strong else 1,
        1 if check is None else 2 if check() else 0,
        1 if known is None else 2 if known else 0,
        2 if FOR[kind].search(near) else 1,
        0 if AGAINST.search(near) else 1,
        0 if edge else 1,
    )


def shape(text: str, s: int, e: int) -> tuple[int, int]:
    """Length class and share-of-digits class of a span."""
    span = text[s:e]
    digits = sum(c in "0123456789" for c in span) / max(len(span), 1)
    return min(3, (e - s) // 10), min(2, int(3 * digits))


N_VOTES = 6


def encode(kind: str, v: tuple[int, ...], sh: tuple[int, int]) -> int:
    code = KINDS.index(kind)
    for x in v:
        code = code * 3 + x
    return (code * 4 + sh[0]) * 3 + sh[1]


def parts(code: int) -> tuple[int, list[int], int, int]:
    code, b = divmod(code, 3)
    code, a = divmod(code, 4)
    v = []
    for _ in range(N_VOTES):
        code, x = divmod(code, 3)
        v.insert(0, x)
    return code, v, a, b


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Expectation-maximisation over vote patterns: the probability that each pattern is personal data.

    Each labeler has a table P(vote | truth), with a pseudo-count that trusts votes a little,
    and each kind a prior; votes are independent given the truth.
    """
    kinds = np.array([parts(c)[0] for c in codes])
    v = np.array([parts(c)[1] for c in codes]).reshape(-1, N_VOTES)
    table = np.zeros((2, N_VOTES, 3))
    table[1], table[0] = (0.05, 0.45, 0.5), (0.4, 0.5, 0.1)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        score = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for k in range(N_VOTES):
            score += np.log(table[1, k, v[:, k]]) - np.log(table[0, k, v[:, k]])
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        for k in range(N_VOTES):
            for x in range(3):
                hit = v[:, k] == x
                table[1, k, x] = (counts[hit] * p[hit]).sum() + (1, 9, 10)[x]
                table[0, k, x] = (counts[hit] * (1 - p[hit])).sum() + (8, 10, 2)[x]
        table /= table.sum(axis=2, keepdims=True)
        for k in range(len(KINDS)):
            hit = kinds == k
            prior[k] = ((counts[hit] * p[hit]).sum() + 2) / (counts[hit].sum() + 4)
    return p


def design(codes: np.ndarray) -> np.ndarray:
    """The span classifier's inputs for each code."""
    rows = []
    for c in codes:
        kind, v, a, b = parts(int(c))
        x = np.zeros(1 + len(KINDS) + 2 * N_VOTES + 7)
        x[0] = x[1 + kind] = 1
        for k, y in enumerate(v):
            x[1 + len(KINDS) + 2 * k] = y == 2
            x[2 + len(KINDS) + 2 * k] = y == 0
        x[1 + len(KINDS) + 2 * N_VOTES + a] = x[5 + len(KINDS) + 2 * N_VOTES + b] = 1
        rows.append(x)
    return np.array(rows).reshape(len(codes), -1)


def classifier(codes: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on the probabilities, by Newton's method; weights grow with the log of the counts."""
    x, w = design(codes), 1 + np.log1p(counts)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (q - p)) + ridge * beta
        h = (x * (w * q * (1 - q) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(beta))
        beta -= np.linalg.solve(h, g)
    return beta


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all candidate spans as structs of kind, start, end, base and code, by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = []
                for x in part.column(1):
                    text = x.as_py() or ""
                    base = base_spans(text)
                    rows = [(k, s, e, True, True) for k in BASE for s, e in base[k]] + [(k, s, e, False, strong) for k, s, e, strong in wide_spans(text, base)]
                    rows.sort(key=lambda r: (KINDS.index(r[0]), r[1]))
                    found.append([{"kind": k, "start": s, "end": e, "base": own, "code": encode(k, votes(text, k, s, e, strong), shape(text, s, e))} for k, s, e, own, strong in rows])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found, SPANS)], names=["doc_id", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,code:int>>")


def probabilities(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, the span classifier's probability of each code), codes ascending; learnt from ``candidates``."""
    seen = rows.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()  # bounded by the codes
    codes, counts = np.array(sorted((r["code"], r["count"]) for r in seen), dtype=np.int64).reshape(-1, 2).T
    if not len(codes):
        return codes, counts, np.zeros(0)
    beta = classifier(codes, counts, reliabilities(codes, counts))
    return codes, counts, 1 / (1 + np.exp(-design(codes) @ beta))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): spans as structs of kind, start, end, base and probability, by kind and start."""
    rows = written(candidates(docs, id_col, text_col), "spans")
    codes, _, p = probabilities(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(1)
            own = spans.flatten()
            sizes = np.diff(spans.offsets.to_numpy())
            score = p[np.searchsorted(codes, own.field("code").to_numpy())] if len(own) else np.zeros(0)
            keep = own.field("base").to_numpy(zero_copy_only=False) | (score >= threshold)
            left = np.bincount(np.repeat(np.arange(b.num_rows), sizes)[keep], minlength=b.num_rows)
            kept = pa.StructArray.from_arrays([*[own.field(c).filter(pa.array(keep)) for c in ("kind", "start", "end", "base")], pa.array(score[keep], pa.float64())], names=["kind", "start", "end", "base", "p"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), kept)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,p:double>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, the spans found and their number."""
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
