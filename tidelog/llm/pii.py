"""Personal data by a semi-Markov conditional random field over candidate spans.

Four kinds have base patterns (email, ip, card, phone), matched leftmost and without overlap in each
kind; a match that fails its check is dropped. They are exact, and always stay. The field adds spans the
patterns miss (a telephone number without +, a card number in odd groups, an address with blanks around
its @): text is cut into short regions around digits and @, a region into tokens, and a bounded-entity
dynamic programme chooses boundaries and kinds together, a segment being scored as a whole (digits,
groups, separators, checksum, neighbours). A span is added if its posterior probability, summed over all
segmentations of its region, is at least ``least`` and it overlaps no base span. An entity's kind depends on the kind of the entity before it in
its region, by a weight for each pair of kinds, so the programme's state is that kind, or none yet.

The weights are trained here, by maximum likelihood on generated regions (seeded, so every run has the
same weights). Texts are taken whole, and so is a region: its dynamic programme runs over all its tokens, in time linear in them, as an
entity is bounded: MOST_DIGITS digits, with the three separators at most that a region has between two, or one address, whose local part and domain are a token
each, however long. Of a segment its ends and weights are kept as plain numbers, of its features nothing.

Null texts are empty and have no span; repeated rows and null keys are rows like others. Other columns than the text and the key
aren't read, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ship, table

# The kinds in the order in which they are listed, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """At each @, the run of local characters before it; found from the @s, so a long run costs its length once."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and LOCAL_END.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)  # no match can hold an @ before its own
        at = text.find("@", max(floor, at + 1))
    return out


def base(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# A region lies around digits, or around an @.
DIGITS = re.compile(r"\+?\(?[0-9](?:[0-9]|[\x20().+/_-]{1,3}(?=[0-9(+]))*+")
AFTER = re.compile(r"\x20?[A-Za-z0-9.-]*+")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: Beside an @: a local part without leading signs; a domain or word; any other character.
ADDRESS = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*+(?=\x20?@)|[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|[^A-Za-z0-9-]")
#: Digits that an entity holds at most.
MOST_DIGITS = 19
LABELS = (*KINDS, "none")
NONE = len(KINDS)
#: The programme's states: the kind of the entity before, or none yet.
STATES = range(NONE + 1)


def regions(text: str) -> list[Span]:
    """Runs of digits and their separators with eight digits or more, and what stands beside each @: the whole run of local characters before it, and AFTER."""
    out = [m.span() for m in DIGITS.finditer(text) if m.end() - m.start() >= 8 and sum("0" <= c <= "9" for c in m[0]) >= 8]
    at = text.find("@")
    while at >= 0:
        begin = at - (at > 0 and text[at - 1] == " ")
        while begin > 0 and LOCAL_END.match(text, begin - 1):
            begin -= 1
        out.append((begin, AFTER.match(text, at + 1).end()))
        at = text.find("@", at + 1)
    return sorted(out)


def features(text: str, begin: int, end: int, groups: int) -> tuple[str, ...]:
    """Of the whole span: what it consists of and what stands beside it."""
    s = text[begin:end]
    d = digits_of(s)
    n = len(d)
    before, after = text[begin - 1 : begin], text[end : end + 1]
    seps = sorted({c for c in s if not c.isalnum()})
    parts = [p for p in re.split(r"[^0-9]+", s) if p]
    out = [
        "bias", f"digits={n if n < 8 else '8-9' if n < 10 else '10-11' if n < 12 else '12-13' if n < 14 else '14-15' if n < 16 else '16-19' if n < 20 else 'more'}",
        f"groups={min(groups, 6)}", "seps=" + "".join(seps)[:4], f"first={'d' if s[:1].isdigit() else 'a' if s[:1].isalpha() else s[:1]}",
        f"last={'d' if s[-1:].isdigit() else 'a' if s[-1:].isalpha() else 'o'}",
        f"before={'d' if before.isdigit() else 'a' if before.isalpha() else 's' if not before or before.isspace() else 'o'}",
        f"after={'d' if after.isdigit() else 'a' if after.isalpha() else 's' if not after or after.isspace() else 'o'}",
    ]
    if "@" in s:
        out.append("at" if re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s) else "bad-at")
    if n >= 12:
        out.append(f"luhn={luhn(d)},{16 <= n <= 19}")
    if len(parts) == 4 and set(seps) == {"."}:
        out.append("quad" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "bad-quad")
    if not set(s) & set("@") and len(parts) > 1:
        out.append("sizes=" + "-".join(str(min(len(p), 5)) for p in parts[:6]))
    if s[:1] == "(" or re.match(r"\+?[0-9]{0,3} ?\([0-9]{2,4}\)", s):
        out.append("area")
    return tuple(out)


def tokens_of(text: str, begin: int, end: int) -> list[Span]:
    """The tokens of a region: by address parts if it holds an @, else by runs of digits and of letters."""
    return [m.span() for m in (ADDRESS if text.find("@", begin, end) >= 0 else TOKEN).finditer(text, begin, end)]


def lattice(text: str, begin: int, end: int) -> tuple[list[Span], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens, and candidate segments (first token, one past its last, features): those with eight digits or more, or with an @."""
    tokens = tokens_of(text, begin, end)
    return tokens, list(candidates(text, tokens))


def candidates(text: str, tokens: list[Span]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """The lattice's segments, one by one, in the order of their first tokens. With an @, a segment ends two tokens after it at most (a blank and a domain)."""
    held = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens]
    sign = [text[a] == "@" for a, _ in tokens]
    for i, (a, _) in enumerate(tokens):
        if text[a] not in "+(" and not text[a].isalnum():
            continue
        digits, groups, at = 0, 0, None
        for j in range(i + 1, len(tokens) + 1):
            b = tokens[j - 1][1]
            if sign[j - 1]:
                if at is not None or j - 1 > i + 2:
                    break  # a second @, or more than a blank between the local part and it
                at = j - 1
            if at is not None and j > at + 3:
                break
            digits, groups = digits + held[j - 1], groups + text[tokens[j - 1][0]].isdigit()
            if at is None and digits > MOST_DIGITS and j > i + 2:
                break
            if text[b - 1].isalnum() and (at is not None or 8 <= digits <= MOST_DIGITS):
                yield i, j, features(text, a, b, groups)


class Field:
    """Weights of (feature, kind), and of (kind of the entity before, kind); a token outside entities scores 0."""

    def __init__(self):
        self.w: dict[tuple[str, int], float] = {}
        self.turn = [[0.0] * NONE for _ in STATES]

    def weigh(self, segs: list) -> list[list[float]]:
        get = self.w.get
        return [[sum(get((f, k), 0.0) for f in fs) for k in range(NONE)] for _, _, fs in segs]

    def into(self, state: list[float]) -> list[float]:
        """Of each kind: the log sum over the states before it, transitions counted."""
        return [logsum([state[l] + self.turn[l][k] for l in STATES]) for k in range(NONE)]

    def onward(self, after: list[float], ws: list[float]) -> list[float]:
        """Of each state: the log sum over kinds of a segment of weights ws after which after[k] follows."""
        return [logsum([self.turn[l][k] + ws[k] + after[k] for k in range(NONE)]) for l in STATES]

    def marginals(self, n: int, segs: list, weights: list[list[float]]) -> tuple[float, list[list[float]], list[list[float]]]:
        """Log partition sum over the segmentations, each (segment, kind)'s probability, and each transition's expected count."""
        ahead = [[-math.inf] * (NONE + 1) for _ in range(n + 1)]
        back = [[0.0] * (NONE + 1) for _ in range(n + 1)]
        ahead[0][NONE] = 0.0
        out_of: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (i, _, _) in enumerate(segs):
            out_of[i].append(x)
        for t in range(n + 1):
            if t:
                ahead[t] = [logsum([a, b]) for a, b in zip(ahead[t], ahead[t - 1], strict=True)]
            if out_of[t]:
                come = self.into(ahead[t])
                for x in out_of[t]:
                    goal = ahead[segs[x][1]]
                    for k, w in enumerate(weights[x]):
                        goal[k] = logsum([goal[k], come[k] + w])
        for t in range(n - 1, -1, -1):
            ways = [back[t + 1], *(self.onward(back[segs[x][1]], weights[x]) for x in out_of[t])]
            back[t] = [logsum([w[l] for w in ways]) for l in STATES]
        z = logsum(ahead[n])
        p, turns = [], [[0.0] * NONE for _ in STATES]
        for x, (i, j, _) in enumerate(segs):
            p.append([])
            for k, w in enumerate(weights[x]):
                each = [math.exp(min(0.0, ahead[i][l] + self.turn[l][k] + w + back[j][k] - z)) for l in STATES]
                p[x].append(min(1.0, sum(each)))
                for l in STATES:
                    turns[l][k] += each[l]
        return z, p, turns

    def train(self, examples: list[tuple[int, list, dict[tuple[int, int], int]]], rounds: int = 6, step: float = 0.3, held: float = 1e-3) -> None:
        """Likelihood ascent, adaptive steps by weight."""
        sums: dict[tuple, float] = {}

        def climb(key: tuple, value: float, g: float) -> float:
            g -= held * value
            sums[key] = sums.get(key, 0.0) + g * g
            return value + step * g / math.sqrt(sums[key] + 1e-6)

        for _ in range(rounds):
            for n, segs, truth in examples:
                _, p, turns = self.marginals(n, segs, self.weigh(segs))
                slope: dict[tuple[str, int], float] = {}
                for x, (i, j, fs) in enumerate(segs):
                    for k in range(NONE):
                        g = (truth.get((i, j)) == k) - p[x][k]
                        if abs(g) > 1e-4:
                            for f in fs:
                                slope[f, k] = slope.get((f, k), 0.0) + g
                before = NONE
                for at in sorted(truth):
                    turns[before][truth[at]] -= 1
                    before = truth[at]
                for key, g in slope.items():
                    self.w[key] = climb(key, self.w.get(key, 0.0), g)
                for l in STATES:
                    for k in range(NONE):
                        if abs(turns[l][k]) > 1e-4:
                            self.turn[l][k] = climb((l, k, "turn"), self.turn[l][k], -turns[l][k])

    def spans(self, n: int, segs: Iterable, least: float) -> list[tuple[int, int, int, float]]:
        """Best segmentation's entities (first token, one past the last, kind, posterior), of posterior least or more. segs come in the order of their first tokens."""
        first, last, weights = array("q"), array("q"), array("d")
        for seg in segs:
            first.append(seg[0])
            last.append(seg[1])
            weights.extend(self.weigh([seg])[0])
        if not first:
            return []
        wide = NONE + 1
        ahead, top = array("d", [-math.inf]) * (wide * (n + 1)), array("d", [-math.inf]) * (wide * (n + 1))
        back = array("d", [0.0]) * (wide * (n + 1))
        via = array("q", [-1]) * (wide * (n + 1))  # the (segment, state before) of the best way to a (token, state); -1: the token before, in the same state
        ahead[NONE] = top[NONE] = 0.0
        x = 0
        for t in range(n + 1):
            here = t * wide
            if t:
                for l in STATES:
                    ahead[here + l] = logsum([ahead[here + l], ahead[here - wide + l]])
                    if top[here - wide + l] > top[here + l]:
                        top[here + l], via[here + l] = top[here - wide + l], -1
            if x < len(first) and first[x] == t:
                come = self.into(ahead[here : here + wide])
                best = [max((top[here + l] + self.turn[l][k], l) for l in STATES) for k in range(NONE)]
            while x < len(first) and first[x] == t:
                goal = last[x] * wide
                for k in range(NONE):
                    w = weights[x * NONE + k]
                    ahead[goal + k] = logsum([ahead[goal + k], come[k] + w])
                    if best[k][0] + w >= top[goal + k]:
                        top[goal + k], via[goal + k] = best[k][0] + w, x * wide + best[k][1]
                x += 1
        for t in range(n - 1, -1, -1):
            ways = [back[(t + 1) * wide : (t + 2) * wide]]
            while x and first[x - 1] == t:
                x -= 1
                ways.append(self.onward(back[last[x] * wide : (last[x] + 1) * wide], weights[x * NONE : (x + 1) * NONE]))
            for l in STATES:
                back[t * wide + l] = logsum([w[l] for w in ways])
        z = logsum(ahead[n * wide : (n + 1) * wide])
        out, t, state = [], n, max(STATES, key=lambda l: top[n * wide + l])
        while t:
            x, before = divmod(via[t * wide + state], wide)
            if x < 0:
                t -= 1
                continue
            i = first[x]
            come = logsum([ahead[i * wide + l] + self.turn[l][state] for l in STATES])
            p = math.exp(min(0.0, come + weights[x * NONE + state] + back[t * wide + state] - z))
            if p >= least:
                out.append((i, t, state, p))
            t, state = i, before
        return out[::-1]


def logsum(xs: Iterable[float]) -> float:
    m = max(xs)
    if m == -math.inf:
        return m
    return m + math.log(sum(math.exp(x - m) for x in xs))


def generated(n: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with marked entities, among numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((14, 14, 14, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", " ", "-", ".", "  ", "_"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {num(3)} {num(6)}", f"+{num(2)}-{num(2)}-{num(4)}-{num(4)}", f"({a}){b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b} {c}"))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at = r.choice(("@", "@", "@", " @ ", " @", "@ "))
        return f"{word()}{r.choice(('', '.', num(2)))}{word()}{at}{word()}.{r.choice(('com', 'org', 'net', 'example.com'))}"

    def wrong() -> str:
        d = num(16)
        while luhn(d):
            d = num(16)
        return r.choice((d, num(r.randint(1, 24)), f"{num(2)}.{num(2)}.{num(4)}", f"20{num(2)}-0{r.randint(1, 9)}-{num(2)}", f"{num(3)}.{num(3)}.{r.randint(256, 999)}.{num(3)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(3)} {num(3)}", " ".join(num(r.randint(1, 6)) for _ in range(r.randint(2, 9))), f"{num(4)}-{num(4)}", f"{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{word()} @ {word()}", f"({num(2)})", f"{num(4)} {num(4)} {num(2)}", f"{num(2)}/{num(2)}/{num(4)} {num(2)}", f"{num(5)}-{num(4)}", "-".join(num(2) for _ in range(r.randint(3, 8))), ".".join(num(r.randint(1, 3)) for _ in range(r.randint(5, 7)))))

    makers = (email, ip, card, phone)
    for _ in range(n):
        text, marks = word() + " ", []
        for _ in range(r.randint(1, 2)):
            k = r.randint(0, 7)
            for again in range(r.choice((1, 1, 1, 1, 2, 3)) if 0 < k < 4 else 1):  # entities side by side, mostly of one kind
                text += r.choice((" ", " / ", "/")) if again else ""
                k = r.randint(1, 3) if again and r.random() < 0.2 else k
                s = makers[k]() if k < 4 else wrong()
                if k < 4:
                    marks.append((len(text), len(text) + len(s), k))
                text += s
            text += r.choice((f" {word()} ", f", {word()} ", f" {word()} {word()} "))
        yield text, marks


@functools.cache
def trained(size: int = 700) -> Field:
    examples = []
    for text, marks in generated(size):
        for span in regions(text):
            tokens, segs = lattice(text, *span)
            if segs:
                at = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j, _ in segs}
                truth = {at[a, b]: k for a, b, k in marks if (a, b) in at}
                examples.append((len(tokens), segs, truth))
    out = Field()
    out.train(examples)
    return out


def find(text: str, field: Field, least: float = 0.9) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and all spans: those and what the field adds, in order in each kind."""
    own = base(text)
    taken = sorted(s for spans in own.values() for s in spans)
    reach = list(itertools.accumulate((e for _, e in taken), max))  # how far the spans up to each go
    added: list[tuple[int, int, int]] = []
    for a, b in regions(text):
        x = bisect.bisect_right(taken, (a, math.inf))
        if x and reach[x - 1] >= b:
            continue  # a base span is all of it, so whatever the field found would overlap it
        tokens = tokens_of(text, a, b)
        for i, j, k, _ in field.spans(len(tokens), candidates(text, tokens), least):
            begin, end = tokens[i][0], tokens[j - 1][1]
            at = bisect.bisect_left(added, (begin, end))  # those added don't overlap each other
            if not overlaps(taken, reach, begin, end) and not any(p < end and begin < q for p, q, _ in added[max(0, at - 1) : at + 1]):
                added.insert(at, (begin, end, k))
    return own, {kind: sorted(own[kind] + [(a, b) for a, b, k in added if k == n]) for n, kind in enumerate(KINDS)}


def overlaps(spans: list[Span], reach: list[int], begin: int, end: int) -> bool:
    """Whether one of sorted spans, which may overlap each other, overlaps [begin, end); reach: the furthest end up to each."""
    x = bisect.bisect_left(spans, (end, -1))
    return x > 0 and reach[x - 1] > begin


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span as its kind in brackets; of overlapping spans, the union goes under the first's kind."""
    out, done = [], 0
    merged: list[list] = []
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.9) -> DataFrame:
    """Row by row: key, counts of base spans by kind, base_sha256, spans. The text alone is read."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())
    source = docs.select(docs[key], docs[text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.iloc[:, 1]:
                t = t if isinstance(t, str) else ""
                if not any(c in t for c in "0123456789@"):
                    own = every = {k: [] for k in KINDS}
                else:
                    own, every = find(t, held.value, least)
                rows.append((*(len(own[k]) for k in KINDS), hashlib.sha256(listed(own).encode()).hexdigest(), listed(every)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, key, pdf.iloc[:, 0].to_numpy())
            yield out

    return source.mapInPandas(run, f"`{key}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text", least: float = 0.9) -> DataFrame:
    """The rows, with each span of the text replaced; null texts stay null."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(col: pd.Series) -> pd.Series:
        return pd.Series([redact(t, find(t, held.value, least)[1]) if isinstance(t, str) else None for t in col], dtype=object)

    return docs.withColumn(text, clean(docs[text]))


def query(spark, sf_dir):
    """op10: the personal data of every document."""
    return scan(table(spark, sf_dir, "documents"))
