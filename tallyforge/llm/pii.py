"""Personal data by patterns and a semi-Markov conditional random field.

Base patterns give the spans that must be there; they are matched in time that
grows with the text, whatever it holds. The field adds others: it segments the
tokens around digits and at-signs into single outside tokens and entities of at
most LONGEST tokens and WIDEST characters, scores each candidate by features of
the whole span and its surroundings plus a transition weight, and takes the best
segmentation by dynamic programming, which chooses boundaries and kinds
together. A candidate is a run of digits and their separators with seven digits
or three dots, or a name, an at-sign (or [at], (at)) and a domain. Weights are
fitted by stochastic gradient ascent on the conditional likelihood
(forward-backward over segments) of sentences made from a seeded grammar, so the
model is the same for every corpus.

No candidate lies outside the stretches that are decoded, and each has an
outside token at either end unless the text ends there, so decoding each alone
is decoding the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, process_cache

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Where four parts follow one start of a run of digits they follow each, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: An entity's most tokens and characters; the gain over outside that an added
#: span needs; tokens after which decoding lets go of what is settled.
LONGEST, WIDEST, MARGIN, SETTLE = 20, 96, 3.0, 4096
SENTENCES, EPOCHS, RATE = 400, 8, 0.5
TOKEN = re.compile(r"[A-Za-zª-ɏ]+|[0-9]+|\s+|[^\sA-Za-zª-ɏ0-9]")
TRIGGER = re.compile(r"[0-9]+|@|[\[(]at[\])]", re.I)
#: Characters around digits, and around at-signs, in which a candidate can stand.
NEAR = 4
OUTSIDE = len(KINDS)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: what precedes an at-sign is looked
    at once, from the last at-sign or match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if begin < at else None
        done = at + 1
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Contract's base spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 38 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


MAILS = {
    "mail": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z"),
    "mail_loose": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]+)+\Z", re.I),
    "mail_near": re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z]+)+\Z"),
    "mail_spelt": re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z]+)+\Z", re.I),
}
NUMBERS = {
    "quad": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}\Z"),
    "fours": re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}\Z"),
    "run": re.compile(r"[0-9]+\Z"),
    "plus": re.compile(r"\+[0-9]"),
    "area": re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}\Z"),
    "threes": re.compile(r"(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\Z"),
    "groups": re.compile(r"[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,5}\Z"),
    "date": re.compile(r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\Z"),
    "number": re.compile(r"[0-9]{1,3}(?:[,.][0-9]+)*\Z"),
    "version": re.compile(r"[0-9]+(?:\.[0-9]+){1,2}\Z"),
}
CUE = re.compile(r"(?P<email>mail|contact)|(?P<ip>\bip\b|host|server|address)|(?P<card>card|visa|credit)|(?P<phone>phone|tel|call|fax|mobile)", re.I)
NOT_DIGITS, LETTERS = re.compile("[^0-9]+"), re.compile("[A-Za-z]")


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span text[a:b] and of what is around it."""
    s = text[a:b]
    letters = LETTERS.search(s)
    out = [k for k, p in (MAILS if letters else NUMBERS).items() if p.match(s)]
    digits = NOT_DIGITS.sub("", s)
    n = len(digits)
    out.append("digits:" + ("0" if not n else "1-6" if n < 7 else "7-8" if n < 9 else "9-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"))
    if 13 <= n < 20:
        out.append("luhn" if luhn(digits) else "no luhn")
    if "quad" in out and max(map(int, s.split("."))) > 255:
        out.append("octet")
    if letters:
        out.append("letters")
    if s[0].isspace() or s[-1].isspace() or s[-1] in ".,;:-(@" or s[0] in ".,;:-)@":
        out.append("ragged")
    if a and (text[a - 1].isalnum() or text[a - 1] in "@._%+-$#/="):
        out.append("joined before")
    if b < len(text) and (text[b].isalnum() or text[b] in "@_%/=" or text[b] in ".,-" and text[b + 1 : b + 2].isalnum()):
        out.append("joined after")
    out += sorted({f"cue {m.lastgroup}" for m in CUE.finditer(text[max(0, a - 24) : a])})
    return out


def tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]


def spans_from(text: str, toks: list[tuple[int, int]], i: int) -> Iterator[tuple[int, list[str]]]:
    """(end token, features) of the spans from token i that may be entities."""
    first, begin = text[toks[i][0]], toks[i][0]
    numeric = first in "+(0123456789"
    if not numeric and not first.isalnum():
        return
    digits = dots = ats = 0
    mail = first.isalnum()
    for j in range(i, min(len(toks), i + LONGEST)):
        a, b = toks[j]
        if b - begin > WIDEST:
            return
        c = text[a]
        if c in "0123456789":
            digits += b - a
        elif c == ".":
            dots += 1
        elif c == "@" or c in "[(" and text[a + 1 : a + 4].lower() in ("at]", "at)"):
            ats += 1
        numeric = numeric and (c in "0123456789+()-. " and (c != "+" or j == i) and b - a <= 20)
        mail = mail and ats < 2 and not (c.isspace() and text[a:b] != " ")
        if not numeric and not mail:
            return
        if numeric and c in "0123456789" and (digits >= 7 or dots >= 3) or mail and ats and c.isalnum() and text[a - 1] not in "[(@" and (dots or "dot" in text[begin:b].lower()):
            yield j + 1, features(text, begin, b)


def candidates(text: str, toks: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[str]]]]:
    """end token -> (first token, features) of spans that may be entities."""
    out: dict[int, list[tuple[int, list[str]]]] = {}
    for i in range(len(toks)):
        for j, f in spans_from(text, toks, i):
            out.setdefault(j, []).append((i, f))
    return out


Weights = dict[tuple, float]


def scores(w: Weights, feats: list[str]) -> list[float]:
    return [w.get((k, ""), 0.0) + sum(w.get((k, f), 0.0) for f in feats) for k in range(OUTSIDE)]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs)) if m > -math.inf else m


def gradient(w: Weights, n: int, cands: dict, gold: list[tuple[int, int, int]]) -> tuple[Weights, float]:
    """Gradient of the log-likelihood of the gold segments (first token, end
    token, kind), and the log-likelihood. States: last segment's kind."""
    labels = range(OUTSIDE + 1)
    t = [[w.get(("t", p, k), 0.0) for k in labels] for p in labels]
    segs = [(i, j, k, s, f) for j, own in cands.items() for i, f in own for k, s in enumerate(scores(w, f))] + [(i, i + 1, OUTSIDE, 0.0, ()) for i in range(n)]
    by_end: list[dict] = [{} for _ in range(n + 1)]
    by_start: list[dict] = [{} for _ in range(n + 1)]
    for i, j, k, s, _ in segs:
        by_end[j].setdefault(k, []).append((i, s))
        by_start[i].setdefault(k, []).append((j, s))
    ninf = -math.inf
    fwd = [[ninf] * (OUTSIDE + 1) for _ in range(n + 1)]
    bwd = [[ninf] * (OUTSIDE + 1) for _ in range(n + 1)]
    fwd[0][OUTSIDE], bwd[n] = 0.0, [0.0] * (OUTSIDE + 1)
    enter = [[ninf] * (OUTSIDE + 1) for _ in range(n + 1)]
    for j in range(n + 1):
        for k, own in by_end[j].items():
            fwd[j][k] = _lse([enter[i][k] + s for i, s in own])
        enter[j] = [_lse([fwd[j][p] + t[p][k] for p in labels]) for k in labels]
    leave = [[ninf] * (OUTSIDE + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for k, own in by_start[i].items():
            leave[i][k] = _lse([s + bwd[j][k] for j, s in own])
        bwd[i] = [_lse([t[p][k] + leave[i][k] for k in labels]) for p in labels]
    z = _lse(fwd[n])
    g: Weights = {}
    for i, j, k, s, f in segs:
        if k != OUTSIDE and (p := math.exp(enter[i][k] + s + bwd[j][k] - z)) > 1e-6:
            for x in ("", *f):
                g[k, x] = g.get((k, x), 0.0) - p
    for i in range(n):
        for p in labels:
            for k in labels:
                if fwd[i][p] > ninf and leave[i][k] > ninf and (m := math.exp(fwd[i][p] + t[p][k] + leave[i][k] - z)) > 1e-6:
                    g["t", p, k] = g.get(("t", p, k), 0.0) - m
    total, at, last = 0.0, 0, OUTSIDE
    for i, j, k in [*gold, (n, n, -1)]:
        while at < i:
            total += t[last][OUTSIDE]
            g["t", last, OUTSIDE] = g.get(("t", last, OUTSIDE), 0.0) + 1
            last, at = OUTSIDE, at + 1
        if k >= 0:
            f = next(f for a, f in cands[j] if a == i)
            total += t[last][k] + scores(w, f)[k]
            g["t", last, k] = g.get(("t", last, k), 0.0) + 1
            for x in ("", *f):
                g[k, x] = g.get((k, x), 0.0) + 1
            last, at = k, j
    return g, total - z


def decoded(w: Weights, text: str, a: int, b: int) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, gain over outside) of the best segmentation. Once
    all that may still win agree on what came before a token, that is settled
    and let go, so memory does not grow with the stretch."""
    toks = tokens(text, a, b)
    n, labels = len(toks), range(OUTSIDE + 1)
    t = [[w.get(("t", p, k), 0.0) for k in labels] for p in labels]
    best: dict[int, list[float]] = {0: [-math.inf] * OUTSIDE + [0.0]}
    back: dict[tuple[int, int], tuple[int, int, float]] = {}
    out: list[tuple[str, int, int, float]] = []
    limit = 6 * SETTLE

    def settle(node: tuple[int, int]) -> None:
        own = []
        while node in back:
            i, p, s = back[node]
            if node[1] != OUTSIDE:
                own.append((KINDS[node[1]], toks[i][0], toks[node[0] - 1][1], s))
            node = i, p
        out.extend(own[::-1])

    for i in range(n):
        here = best.pop(i, None)
        if here is None:
            continue
        for j, k, s in [*((j, k, s) for j, f in spans_from(text, toks, i) for k, s in enumerate(scores(w, f)) if s > 0), (i + 1, OUTSIDE, 0.0)]:
            to = best.setdefault(j, [-math.inf] * (OUTSIDE + 1))
            p = max(labels, key=lambda p: here[p] + t[p][k])
            if (v := here[p] + t[p][k] + s) > to[k]:
                to[k], back[j, k] = v, (i, p, s)
        if len(back) > limit:
            trails = []
            for j, vs in best.items():
                for k in labels:
                    if vs[k] > -math.inf:
                        trail, node = [], (j, k)
                        while node in back:
                            trail.append(node)
                            node = back[node][:2]
                        trails.append(trail[::-1])
            same = next((m for m, nodes in enumerate(zip(*trails)) if len(set(nodes)) > 1), min(map(len, trails)))
            if same:
                settle(trails[0][same - 1])
            back = {node: back[node] for trail in trails for node in trail[same:]}
            limit = max(6 * SETTLE, 2 * len(back))  # where little is settled, it is tried less often
    settle((n, max(labels, key=lambda k: best[n][k])))
    return out


def _made(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its entities."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = rng.choice("3456") + num(rng.choice((11, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(("", " ", "-"))
        return sep.join(re.findall("....|.+", d))

    phones = (
        lambda: f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{rng.randint(200, 999)}-{num(3)}-{num(4)}",
        lambda: f"{rng.randint(200, 999)}.{num(3)}.{num(4)}", lambda: f"+{rng.randint(1, 99)} {num(2)} {num(4)} {num(4)}", lambda: f"+{num(11)}",
    )
    def mail() -> str:
        return f"{word()}{rng.choice(('', '.' + num(2), '_' + word()))}{'@'}{word()}{rng.choice(('', num(1)))}.{rng.choice(('com', 'org', 'de', 'example.com'))}"

    def loose() -> str:
        at, dot = rng.choice(((" @ ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [AT] ", ".")))
        return f"{word()}{rng.choice(('', '.' + word()))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net'))}"

    entities = {
        "email": lambda: mail() if rng.random() < 0.6 else loose(),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice(phones)(),
    }

    def wrong_card() -> str:
        d = num(16)
        return d if not luhn(d) else wrong_card()

    others = (
        lambda: num(rng.randint(1, 6)), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{num(2)}", lambda: " ".join(num(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}", lambda: f"{rng.randint(1950, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
        lambda: f"{num(1)}.{num(2)}", lambda: f"{num(2)},{num(3)}.{num(2)}", lambda: f"${num(3)}", wrong_card, lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40))),
        lambda: f"{word()}={num(4)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(3)}.{num(3)}", lambda: f"#{num(7)}", lambda: f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{rng.randint(300, 999)}", lambda: f"AK{num(4)}X{num(6)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}@", lambda: f"@{word()}", lambda: f"{word()} @ {num(1)}.{num(2)}", lambda: f"{word()} (at) {word()}", lambda: f"{word()} @ {word()}. {word().title()}", lambda: num(rng.randint(9, 12)), lambda: f"{num(4)} {num(4)}", lambda: f"{num(2)} {num(3)} {num(2)}",
    )
    cues = {"email": ("mail", "contact"), "ip": ("host", "server"), "card": ("card", "visa"), "phone": ("phone", "call")}
    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        text += "".join(word() + rng.choice((" ", " ", ", ")) for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            s = entities[kind]()
            if rng.random() < 0.25:
                text += rng.choice(cues[kind]) + rng.choice((": ", " "))
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = rng.choice(others)()
        text += s + rng.choice((" ", " ", ", ", ". ", " " + word() + " "))
    return text.rstrip(), spans


def trained(sentences: int = SENTENCES, epochs: int = EPOCHS) -> Weights:
    """Weights fitted on the seeded grammar (a few seconds)."""
    rng, w, rows = random.Random(11), {}, []
    for _ in range(sentences):
        text, spans = _made(rng)
        toks = tokens(text, 0, len(text))
        first, end = {a: i for i, (a, _) in enumerate(toks)}, {b: i + 1 for i, (_, b) in enumerate(toks)}
        if all(a in first and b in end and end[b] - first[a] <= LONGEST for _, a, b in spans):
            rows.append((len(toks), candidates(text, toks), [(first[a], end[b], KINDS.index(k)) for k, a, b in spans]))
    mean: Weights = {}
    for epoch in range(epochs):
        step = RATE / (1 + 0.3 * epoch)
        rng.shuffle(rows)
        for n, cands, gold in rows:
            g, _ = gradient(w, n, cands, gold)
            for k, v in g.items():
                w[k] = w.get(k, 0.0) + step * v
        if 2 * epoch >= epochs:  # the mean of the later epochs, which single sentences move less
            for k, v in w.items():
                mean[k] = mean.get(k, 0.0) + v / (epochs - (epochs + 1) // 2)
    return mean


def default_weights() -> Weights:
    cache = process_cache("pii")
    return cache.get("weights") or cache.setdefault("weights", trained())


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where candidates can stand, in order, apart from each other."""
    a = b = -1
    for m in TRIGGER.finditer(text):
        reach = NEAR if m[0][0] in "0123456789" else WIDEST
        x, y = max(0, m.start() - reach), m.end() + reach
        if x > b:
            if b >= 0:
                yield a, min(b, len(text))
            a, b = x, y
        else:
            a, b = min(a, x), max(b, y)
    if b >= 0:
        yield a, min(b, len(text))


def all_spans(text: str, w: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by kind as listed, then start."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    # An added span overlaps no base span; a stretch whose triggers are all in base spans is not decoded.
    taken = sorted((a, b) for _, a, b in base)
    added, at = [], 0
    for a, b in _apart(stretches(text)):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        inside, to = [], at
        while to < len(taken) and taken[to][0] < b:
            inside.append(taken[to])
            to += 1
        free, x = [], a
        for c, d in inside:
            free.append(text[x:c])
            x = max(x, d)
        if not TRIGGER.search(" ".join([*free, text[x:b]])):
            continue
        starts = [c for c, _ in inside]
        most = list(itertools.accumulate((d for _, d in inside), max))
        for kind, x, y, gain in decoded(w, text, a, b):
            i = bisect.bisect_left(starts, y)
            if gain >= MARGIN and not (i and most[i - 1] > x):
                added.append((kind, x, y))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1], s[2]))


def _apart(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping ones united: an at-sign reaches back over what came before."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while out and out[-1][1] >= a:
            c, d = out.pop()
            a, b = min(a, c), max(b, d)
        out.append((a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column("text"):
                base, spans = all_spans(t.as_py(), w)
                for o, k in zip(out, KINDS, strict=False):
                    o.append(sum(s[0] == k for s in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(spans))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:4]], *[pa.array(x, pa.string()) for x in out[4:]]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans.
    Null and empty texts have none; texts may be of any length. Where
    segmentations tie, a longer outside wins less: the first found stays.
    Repeated rows get equal results, an empty table has none, extra columns are
    ignored."""
    return documents(docs).mapInArrow(_found(default_weights()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlaps merged, named by the first of them)
    replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text masked; nulls stay null, other
    columns stay as they are."""
    w = default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            new = pa.array([t if t is None else masked_text(t, all_spans(t, w)[1]) for t in texts], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", new)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
