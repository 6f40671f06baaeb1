"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The base patterns find e-mail addresses, IP addresses, card and phone numbers
and always stay; they are matched so that a text of any length and shape is
looked at once. The field looks at the stretches that hold digits, at signs or
long runs of letters and digits (keys, passwords) outside base spans: candidate segments of at most LONGEST pieces are
scored as wholes (how many digits, their groups, what separates them, check
digit, words before, what touches either end), and dynamic programming over
the pieces chooses boundaries and kinds together. A span it adds has a
posterior of at least SURE. Its weights are fitted by likelihood on written
examples alone: that no base pattern matches does not make a text clean.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the field adds may also be a key, token or password.
FIELD_KINDS = (*KINDS, "secret")

#: The base patterns of cards and phones; those of e-mail and IP addresses are matched in parts, see base_spans.
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SURE = 0.9
LONGEST = 48
EPOCHS, RATE, PENALTY = 8, 0.3, 1e-4

#: What the pattern of e-mail addresses has before and after the at sign, and four or more numbers with full stops between.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")

_NUMBERS = re.compile(r"[0-9](?:[0-9 ().\-\[\]/]|\[dot\]|\(dot\)){5,60}[0-9]")
#: Written-out at signs, and what a name and a host may be beside them (bounded, as in addresses).
_MARKS = re.compile(r"[\[(](?:at|@)[\])]| @|@ ")
_NAME = re.compile(r"[\w.+-]{1,64} ?\Z")
_HOST = re.compile(r" ?[\w-]{1,63}(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[\w-]{1,63}){1,8}")
_PLAIN_HOST = re.compile(r" ?[\w-]{1,63}\.\w{1,63}")
#: A run that may be a secret: long, of letters and digits.
_RUN = re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{16,200}(?![\w/+-])")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?\Z")
_PIECE = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.S)
_SIDE = 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs: a text is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns; leftmost, non-overlapping within a kind; failing matches are dropped."""
    out: list[tuple[str, int, int]] = [("email", *x) for x in _emails(text)]
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the field


def _names(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of names and hosts around a written-out at sign."""
    for m in _MARKS.finditer(text, low, high):
        bracket = m[0][0] in "[("
        name = _NAME.search(text[max(low, m.start() - 65) : m.start()])
        host = (_HOST if bracket else _PLAIN_HOST).match(text, m.end(), high)
        if name and host and (bracket or name[0][-1] != " "):
            yield m.start() - len(name[0]), host.end()


def _runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of runs that may be secrets."""
    for m in _RUN.finditer(text, low, high):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield m.span()


def stretches(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, str, tuple[int, int] | None]]:
    """(offset, text, run) of the parts of a text that the field looks at: what may hold an entity outside base spans.

    ``run`` is where in the part a run stands that may be a secret; other
    parts have none.
    """
    at = 0
    for s, e in [*sorted((s, e) for _, s, e in base), (len(text), len(text))]:
        if at < s:
            for a, b in _runs(text, at, s):
                start = max(a - _SIDE, at)
                yield start, text[start : min(b + 4, s)], (a - start, b - start)
            last = at
            for a, b in sorted([*(m.span() for m in _NUMBERS.finditer(text, at, s)), *_names(text, at, s)]):
                start = max(a - _SIDE - (a > 0 and text[a - 1] in "(+"), last)
                last = max(b, last)
                if start < b:
                    yield start, text[start : min(b + _SIDE, s)], None
        at = max(at, e)


def kinds_of(span: str) -> list[str]:
    """The kinds that a segment may be; most segments may be none."""
    digits = sum(c.isdigit() for c in span)
    out = []
    if re.search(r"@|[\[(](?:at|@)[\])]", span) and span[0].isalnum() and span[-1].isalnum():
        out.append("email")
    if 4 <= digits <= 12 and re.fullmatch(r"\d{1,3}(?: ?(?:[.\[(]|\[dot|\(dot)+[\]).]* ?\d{1,3}){3}", span):
        out.append("ip")
    if 13 <= digits <= 19 and span[0].isdigit() and span[-1].isdigit() and re.fullmatch(r"[\d .\-/]+", span):
        out.append("card")
    if 7 <= digits <= 15 and span[0] in "(+0123456789" and span[-1].isdigit() and re.fullmatch(r"[+\d ().\-/]+", span):
        out.append("phone")
    return out


def features(span: str, kind: str, before: str, after: str) -> list[str]:
    """Names of what holds of a whole segment."""
    digits = re.sub(r"\D", "", span)
    groups = re.findall(r"\d+", span)
    marks = "".join(sorted(set(re.sub(r"[\w]", "", span))))
    word = re.findall(r"[^\W\d_]+", before)
    out = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 7)}", f"marks={marks}", f"word={word[-1].lower() if word else ''}", f"shape={'-'.join(str(len(g)) for g in groups)[:12]}"]
    out.append(f"left={'a' if before[-1:].isalpha() else '0' if before[-1:].isdigit() else before[-1:].strip() or '_'}")
    out.append(f"right={'a' if after[:1].isalpha() else '0' if after[:1].isdigit() else after[:1].strip() or '_'}")
    if re.match(r"[\s.,/:-]*\d", after):
        out.append("digits follow")
    if re.match(r" ?[\[(](?:dot|[.])[\])]", after):
        out.append("dot follows")
    if re.search(r"\d[\s.,/:-]*$", before):
        out.append("digits before")
    if kind == "card":
        out.append(f"luhn={luhn(digits)}")
    if kind == "ip":
        out.append(f"octets={all(int(g) <= 255 for g in groups)}")
    if kind == "phone":
        out += [f"start={span[0] if span[0] in '(+' else '0' if span[0] == '0' else 'd'}", f"date={bool(re.match(r'(?:19|20)[0-9]{2}[-/.]|[0-9]{1,2}[./-][0-9]{1,2}[./-]', span))}"]
    if kind == "email":
        parts = re.split(r" ?@ ?| ?[\[(](?:at|@)[\])] ?", span)
        out += [f"parts={len(parts)}", f"host={bool(re.fullmatch(r'[A-Za-z0-9-]+(?: ?(?:[.]|[\[(](?:dot|[.])[\])]) ?[A-Za-z0-9-]+)+', parts[-1]))}", f"local={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', parts[0]))}"]
    return [f"{kind} {x}" for x in out]


def segments(text: str) -> tuple[int, list[tuple[int, int, int, int, str, list[str]]]]:
    """Pieces of a stretch and its candidate segments (from piece, to piece, start, end, kind, features).

    Kind O is one piece outside of all entities.
    """
    cuts = [0, *(m.end() for m in _PIECE.finditer(text))]
    n, out, named = len(cuts) - 1, [], "@" in text or "at" in text
    for i in range(n):
        out.append((i, i + 1, cuts[i], cuts[i + 1], "O", []))
        if not (text[cuts[i]].isalnum() or text[cuts[i]] in "(+"):
            continue
        digits = 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if not text[cuts[j] - 1].isalnum():
                continue
            span = text[cuts[i] : cuts[j]]
            digits += sum(c.isdigit() for c in text[cuts[j - 1] : cuts[j]])
            if digits > 19 and not named:
                break
            if len(span) >= 7:
                out += [(i, j, cuts[i], cuts[j], kind, features(span, kind, text[max(0, cuts[i] - 24) : cuts[i]], text[cuts[j] : cuts[j] + 8])) for kind in kinds_of(span)]
    return n, out


def secret_features(span: str, before: str) -> list[str]:
    """Names of what holds of a run that may be a secret."""
    digits, word = sum(c.isdigit() for c in span), re.findall(r"[^\W\d_]+", before)
    letters = "".join(c for c in span if c.isalpha())
    case = "upper" if letters.isupper() else "hex" if re.fullmatch(r"[0-9a-f]+", span) else "lower" if letters.islower() else "both"
    turns = len(re.findall(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", span))
    out = ["bias", f"case={case}", f"length={min(len(span) // 4, 12)}", f"digits={digits * 8 // len(span)}", f"turns={min(turns, 6)}", f"marks={min(sum(c in '/-_+' for c in span), 4)}"]
    out += [f"word={word[-1].lower() if word else ''}", f"assigned={bool(_ASSIGNED.search(before))}", f"head={span[:4] if span[:4].isupper() else ''}"]
    return [f"secret {x}" for x in out]


def run_segments(text: str, run: tuple[int, int]) -> tuple[int, list[tuple[int, int, int, int, str, list[str]]]]:
    """Pieces of a stretch with one candidate: its whole run as a secret."""
    cuts = [0, *(m.end() for m in _PIECE.finditer(text))]
    out = [(i, i + 1, a, b, "O", []) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    a, b = run
    out.append((cuts.index(a), cuts.index(b), a, b, "secret", secret_features(text[a:b], text[max(0, a - 24) : a])))
    return len(cuts) - 1, out


def _sum_logs(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def marginals(n: int, own: list, weights: dict[str, float]) -> tuple[list[float], list[float]]:
    """(scores, posteriors) of a stretch's segments: forward and backward sums over its pieces."""
    scores = [sum(weights.get(f, 0.0) for f in s[5]) for s in own]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, s in enumerate(own):
        ending[s[1]].append(k)
        starting[s[0]].append(k)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _sum_logs([ahead[own[k][0]] + scores[k] for k in ending[j]])
    for i in range(n - 1, -1, -1):
        behind[i] = _sum_logs([behind[own[k][1]] + scores[k] for k in starting[i]])
    return scores, [math.exp(min(0.0, ahead[s[0]] + scores[k] + behind[s[1]] - ahead[n])) for k, s in enumerate(own)]


def best_path(n: int, own: list, scores: list[float]) -> list[int]:
    """The best segmentation, by dynamic programming over segment ends."""
    best, back = [0.0] + [-math.inf] * n, [-1] * (n + 1)
    for k in sorted(range(len(own)), key=lambda k: (own[k][1], own[k][0])):
        value = best[own[k][0]] + scores[k]
        if value > best[own[k][1]]:
            best[own[k][1]], back[own[k][1]] = value, k
    out, at = [], n
    while at:
        out.append(back[at])
        at = own[back[at]][0]
    return out[::-1]


def _card_number(r: random.Random, n: int = 16) -> str:
    digits = str(r.randint(3, 6)) + "".join(str(r.randint(0, 9)) for _ in range(n - 2))
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def written_examples(seed: int = 7, each: int = 60) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made stretches: entities in forms that the base patterns miss, and numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    low = lambda n: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    words = ["the", "and", "of", "call", "tel", "phone", "fax", "card", "visa", "host", "from", "mail", "contact", "und", "der", "le", "que", "number", "no", "in", "total", "on"]
    octet = lambda: str(r.randint(0, 255))
    made = {
        "email": [lambda: f"{low(4)}.{low(5)} (at) {low(7)} (dot) co (dot) {low(2)}", lambda: f"{low(5)} [at] {low(6)} [dot] {low(3)} [dot] {low(2)}", lambda: f"{low(3)}.{low(6)} (at) {low(4)} (dot) {low(6)} (dot) com", lambda: f"{low(6)}(at){low(5)}(dot){low(3)}(dot){low(2)}", lambda: f"{low(5)}.{low(4)} (at) {low(6)}.com", lambda: f"{low(6)} [at] {low(5)} [dot] org", lambda: f"{low(4)}{d(2)}(at){low(5)}(dot)net", lambda: f"{low(6)}(at){low(5)}.org", lambda: f"{low(5)} @ {low(6)}.de"],
        "ip": [lambda: f"{octet()} (dot) {octet()} (dot) {octet()} (dot) {octet()}", lambda: f"{octet()}[.]{octet()}[.]{octet()}[.]{octet()}", lambda: f"{octet()}(dot){octet()}(dot){octet()}(dot){octet()}", lambda: f"{octet()} . {octet()} . {octet()} . {octet()}"],
        "card": [lambda: ".".join(re.findall("....", _card_number(r))), lambda: "/".join(re.findall("....", _card_number(r))), lambda: "  ".join(re.findall("....", _card_number(r)))],
        "phone": [lambda: f"({d(3)}) {r.randint(2, 9)}{d(2)}-{d(4)}", lambda: f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", lambda: f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}"],
        "": [lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}:{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}.{d(4)}", lambda: d(9), lambda: d(16), lambda: f"{d(3)} {d(2)} {d(3)} {d(2)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(3)}", lambda: f"{d(2)}/{d(2)}/20{d(2)} {d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"v{d(1)}.{d(2)}.{d(3)} {d(8)}", lambda: f"{d(5)}.{d(4)} {d(3)}.{d(6)}"],
    }
    out = []
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    mixed = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 2)) + "a7"
    coded = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "d4"
    shut = ["password=", "password = ", 'password: "', "passwd=", "pwd=", "token = ", 'token = "', "token=", "secret=", 'secret: "', "api_key=", 'key = "', "auth: ", "access_token="]
    secrets = [lambda: (r.choice(shut), coded(r.choice([18, 24, 32, 40]))), lambda: (r.choice(shut), mixed(r.randint(16, 44))), lambda: ("", "AKIA" + upper(15) + "7"), lambda: (r.choice(["", "aws "]), "AKIA" + upper(15) + "7"), lambda: ("", "ghp_" + mixed(36)), lambda: (r.choice(["", "key="]), "sk-" + mixed(40))]
    others = [lambda: ("commit ", coded(40)), lambda: ("sha256 ", coded(64)), lambda: ("", coded(32)), lambda: ("id ", f"{coded(8)}-{coded(4)}-{coded(4)}-{coded(4)}-{coded(12)}"), lambda: ("", f"{low(6)}-{low(8)}-{d(4)}"), lambda: ("see ", f"{low(5)}/{low(7)}/{low(6)}{d(3)}"), lambda: ("", f"{low(10)}_{low(6)}_{d(2)}"), lambda: ("", f"{low(14)}{d(4)}"), lambda: ("no ", f"{d(4)}-{d(6)}-{low(1)}{d(5)}"), lambda: ("key=", f"{low(9)}-{low(8)}{d(1)}"), lambda: ("", f"{low(4)}{d(2)}-{low(12)}")]
    for forms, kind in ((secrets, "secret"), (others, "")):
        for _ in range(each * 4):
            before = " ".join(r.choice(words) for _ in range(r.randint(0, 3)))
            (lead, body), gap = r.choice(forms)(), " " if before else ""
            start = len(before) + len(gap) + len(lead)
            out.append((before + gap + lead + body + r.choice(["", ".", '"', " " + r.choice(words)]), [(kind, start, start + len(body))] if kind else []))
    for kind, forms in made.items():
        for _ in range(each * {"": 3, "email": 3}.get(kind, 1)):
            before = " ".join(r.choice(words) for _ in range(r.randint(0, 3)))
            body, gap = r.choice(forms)(), " " if before else ""
            after = r.choice(["", ".", ","]) + r.choice(["", " " + r.choice(words)])
            start = len(before) + len(gap)
            out.append((before + gap + body + after, [(kind, start, start + len(body))] if kind else []))
    return out


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by gradient steps on the likelihood of the whole segmentations; order and start are fixed."""
    weights: dict[str, float] = {}
    made = [(segments(text), {(k, s, e) for k, s, e in gold}) for text, gold in examples]
    made += [(run_segments(text, run), set(gold)) for text, gold in examples for run in _runs(text, 0, len(text))]
    order = random.Random(1)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        order.shuffle(made)
        for (n, own), gold in made:
            if not any(s[5] for s in own):
                continue
            _, post = marginals(n, own, weights)
            for k, s in enumerate(own):
                step = rate * (((s[4], s[2], s[3]) in gold) - post[k])
                if s[5] and abs(step) > 1e-4:
                    for f in s[5]:
                        weights[f] = weights.get(f, 0.0) * (1 - PENALTY) + step
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """What the field adds; never overlaps a base span."""
    out: list[tuple[str, int, int]] = []
    for offset, part, run in stretches(text, base):
        n, own = segments(part) if run is None else run_segments(part, run)
        if all(not s[5] for s in own):
            continue
        scores, post = marginals(n, own, weights)
        for k in best_path(n, own, scores):
            if own[k][5] and post[k] >= SURE:
                span = (own[k][4], offset + own[k][2], offset + own[k][3])
                if not any(s < span[2] and span[1] < e for _, s, e in [*base, *out]):
                    out.append(span)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (FIELD_KINDS.index(x[0]), x[1])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_found long"


def find_all(text: str | None, weights: dict[str, float]) -> tuple:
    base = base_spans(text or "")
    spans = base + added_spans(text or "", base, weights)
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), sum(k == "secret" for k, _, _ in spans), len(spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each input row: identifier, counts of base spans by kind, base_sha256, spans, n_secret, n_found (all spans).

    Spans are kind:start:end in code points, end exclusive, by kind and start,
    joined by commas; base_sha256 is the digest of the base ones so written.
    Null or empty text has none. Whole texts are read. Repeated rows are
    looked at each; extra columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    known = fit(written_examples()) if weights is None else weights

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([find_all(t, known) for t in texts], columns=[c.split()[0] for c in FOUND.split(", ")])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return slim.select(F.col("id").alias(id_col), F.pandas_udf(find, FOUND)("text").alias("_found")).select(id_col, "_found.*")


def mask(text: str, spans: str) -> str:
    """A text with its spans replaced by <kind>; of overlapping spans the first by start counts."""
    out, at = [], 0
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
