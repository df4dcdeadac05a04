"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns (email, ip, card, phone) give the base spans. The field reads word shapes around digits, at signs and
spelled-out address parts, is trained on the small labelled table below, and adds spans where no base span lies:
written-out addresses and phone numbers without a country code. All words of a text are decoded, those of a batch at
once in numpy: a bound shows which words are O in every best labelling, and Viterbi runs over the others.

Offsets are code points, ends exclusive. NULL and empty texts have no spans; texts of any length are read whole;
repeated rows get the same spans; an empty table gives no rows; other columns are passed on or left out as asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import offsets_of, pieces, ranges, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting a number at the head of its run of digits finds the same matches and keeps long runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Places of the words around one whose features it has, by the mark before their names.
PLACES = {"": 0, "-": -1, "+": 1, "--": -2, "++": 2}
BEGINS = np.array([name[0] == "B" for name in LABELS])
BLOCK = 1 << 17

# Labelled table: [kind:words] marks an entity, everything else is O.
LABELLED = """
please write to [email:jane.doe@example.com] before noon
Contact: [email:info@mail3.example.org] or call
und.34 [email:leti.55@mail7.example.com] wheth ering the
mail [email:jane dot doe at example dot com] for details
write [email:john (at) example (dot) org] today
send it to [email:maria [at] mail4 [dot] example [dot] net] soon
reach me under [email:peter at mail dot example dot de] or later
to [email:office[at]example.com] with the form
escribe a [email:ana (at) correo dot example dot es] para la
schreiben an [email:info at firma dot de] bitte
the server [ip:10.20.30.40] is down
von [ip:192.168.0.17] nach [ip:172.16.5.9] und
at [ip:146.47.206.184] airere the
pay with [card:4539 1488 0343 6467] now
card [card:6011000990139424] was used
card number [card:4111-1111-1111-1111] is expired
call [phone:+1 (511) 555-6887] en the
phone [phone:+49 30 1234567] bitte
ring [phone:(511) 555-6887] after six
call [phone:511-555-6887] or write
my number is [phone:(020) 555-0143] thanks
or call [phone:(511) 555-6887] and ask
call me [phone:(664) 555-5990] or so
dial [phone:(851) 555-9673]
tion er [phone:(084) 555-3661] heti on
anrufen [phone:(336) 555-3810] danke
reach us at [phone:511-555-6887] today
on [phone:604-555-0123] in the
tel [phone:858-555-2896] oder
tel. [phone:030 / 555 0199] bis
fax [phone:(046) 555-3286] is off
the house at the corner dot and line
it was at 10 and then at 12 again
the order 4363361756619572 was sent at noon
number 9321955660381726 the an lyated
id 1694893019727317 la les pour
token = "65f8700754a1d8161928a1d0cca87ca77d009e4f" enge geverö
token = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f" ndble eratbleor
in 2021 the 34 members met on 2021-03-04 at 10:30
version 1.2.3 and 2.0.14 of the library
section 3.4.5.6.7 and 999.888.777.666 are not hosts
price 12,50 and 1.299,00 or 15% of 300
from 1999 to 2004 in 12 of 27 cases
the 3rd and 4th of 5 items cost 20 30 and 40
isbn 978-3-16-148410-0 on page 12
room 12-14 and chapter 3 of part 2
@home and @user wrote 5 lines
a dot on the map at the end
und 34 von 56 am 7. Mai 2020
le 12 mars 2019 et 45 autres
the score was 511-55 and 6887 points
lines 100-200 and 300-400 of 1000
ertior$$$ therbleti*** the&&& 9000426309966109$$$ reanndin&&& in%%% enat***
für&&& stkeit.%%% Die&&& 0759539412582376$$$ den&&& die&&& lich***
THAT!! 1142126282388588!! HEOUING!! IT!! ONHANT!!
ingly | 4363361756619572 | nded | ererhe | 12
tion### 123 of%%% 4567*** and&&& 89$$$
Copyright 2020 2021 Example Inc. all rights
"""


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def shape(word: str) -> tuple[str, ...]:
    """Features of one word, from its shape alone but for the spelled-out parts of an address."""
    core = word.strip(".,;:!?\"'<>")
    digits = re.sub("[^0-9]", "", core)
    form = re.sub(r"d+", lambda m: f"d{len(m.group())}" if len(m.group()) < 8 else "d8+", re.sub("[A-Za-zÀ-ɏ]+", "x", re.sub("[0-9]", "d", core.replace("d", "x").replace("D", "x"))))
    out = [f"form={form[:24]}", f"digits={min(len(digits), 20) // 4}", f"at={'@' in core}"]
    if core.lower() in ("at", "dot", "(at)", "[at]", "(dot)", "[dot]", "/", "+"):
        out.append(f"word={core.lower()}")
    if re.search(r"[\[(](at|dot)[\])]", core.lower()):
        out.append("spelled")
    if len(digits) >= 16 and len(digits) == len(core.replace(" ", "").replace("-", "")):
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", core):
        out.append(f"octets={all(int(p[-4:]) <= 255 for p in core.split('.'))}")
    return tuple(out)


def token_features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in words]
    edge = ("edge",)
    return [
        [*shapes[i], *("-" + f for f in (shapes[i - 1] if i else edge)), *("+" + f for f in (shapes[i + 1] if i + 1 < len(words) else edge)),
         *("--" + f for f in (shapes[i - 2] if i > 1 else edge)), *("++" + f for f in (shapes[i + 2] if i + 2 < len(words) else edge))]
        for i in range(len(words))]


def labelled_rows(text: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Words and labels of the labelled table."""
    rows = []
    for line in filter(None, text.split("\n")):
        words, labels, at = [], [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:\[(?:at|dot)\]|[^\]])*)\]", line):
            before = line[at : m.start()].split()
            inside = m.group(2).split()
            words += before + inside
            labels += [0] * len(before) + [LABELS.index(f"{'I' if k else 'B'}-{m.group(1)}") for k in range(len(inside))]
            at = m.end()
        rest = line[at:].split()
        rows.append((words + rest, labels + [0] * len(rest)))
    return rows


class ChainField:
    """Linear-chain conditional random field over string features."""

    def __init__(self, rows, epochs: int = 60, rate: float = 0.1, decay: float = 1e-3, seed: int = 3):
        encoded = [(token_features(w), np.array(y)) for w, y in rows if w]
        self.index = {f: k for k, f in enumerate(sorted({f for x, _ in encoded for t in x for f in t}))}
        n = len(LABELS)
        self.weights, self.moves = np.zeros((len(self.index) + 1, n)), np.zeros((n, n))
        for k, name in enumerate(LABELS):  # an inside label follows its own kind
            if name[0] == "I":
                for j, before in enumerate(LABELS):
                    if before[2:] != name[2:]:
                        self.moves[j, k] = -30.0
        self.start = np.array([-30.0 if name[0] == "I" else 0.0 for name in LABELS])
        allowed = self.moves > -1
        rng = np.random.default_rng(seed)
        data = [([np.array([self.index[f] for f in t]) for t in x], y) for x, y in encoded]
        for epoch in range(epochs):
            step = rate / (1 + epoch / 20)
            for k in rng.permutation(len(data)):
                x, y = data[k]
                e = np.array([self.weights[t].sum(axis=0) for t in x])
                node, edge = self._marginals(e)
                gold = np.zeros_like(node)
                gold[np.arange(len(y)), y] = 1
                for t, g in zip(x, gold - node):
                    self.weights[t] += step * g
                pairs = np.zeros((n, n))
                np.add.at(pairs, (y[:-1], y[1:]), 1)
                self.moves += step * np.where(allowed, pairs - edge - decay * self.moves, 0)
            self.weights *= 1 - decay
        self._prepare()

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fold = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
        n = len(e)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = self.start + e[0]
        for t in range(1, n):
            alpha[t] = fold(alpha[t - 1][:, None] + self.moves, 0) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = fold(self.moves + (e[t + 1] + beta[t + 1])[None], 1)
        z = fold(alpha[-1], 0)
        edge = sum((np.exp(alpha[t][:, None] + self.moves + (e[t + 1] + beta[t + 1])[None] - z) for t in range(n - 1)), np.zeros_like(self.moves))
        return np.exp(alpha + beta - z), edge

    def _prepare(self) -> None:
        """Weights by shape: a shape counts by those of its features that training has seen, so there are few."""
        self.seen = {f.lstrip("+-") for f in self.index}
        self.number, self.sums = {}, [[] for _ in PLACES]
        self.shapes = Shapes(self)
        self.edge = self.of(("edge",))
        inside = self.moves[0, 0]
        self.opens = np.maximum(self.moves.max(axis=0) - inside, self.start - self.start[0])[1:]
        self.closes = max(0.0, float((self.moves[1:, 0] - inside).max()))

    def of(self, features: tuple[str, ...]) -> int:
        """Number of a shape."""
        key = tuple(f for f in features if f in self.seen)
        if key not in self.number:
            self.number[key] = len(self.number)
            for place, sums in zip(PLACES, self.sums):
                sums.append(self.weights[[self.index[place + f] for f in key if place + f in self.index]].sum(axis=0))
        return self.number[key]

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Best labels of every run of words.

        A stretch of labels other than O, with its moves in and out, must not score less than O throughout. Its first
        word, which begins a kind, gives at most `begin`, each other word `gain`, and its end `closes`: words in no
        stretch for which that sums to 0 are O in every best labelling. Viterbi runs over the other words, with O fixed
        before and after, and gives what it would give over all words.
        """
        lens = np.array([len(r) for r in runs], np.int64)
        heads = 2 + offsets_of(lens + 2)[:-1]  # two places of edge lie around every run
        s = np.full(int(lens.sum()) + 2 * len(runs) + 2, self.edge)
        at = ranges(heads, lens)
        s[at] = np.fromiter(map(self.shapes.__getitem__, chain.from_iterable(runs)), np.int64, len(at))
        weights = [np.array(x) for x in self.sums]
        score = lambda x: sum(w[s[x + d]] for w, d in zip(weights, PLACES.values()))
        gain, begin = np.full((2, len(s)), -1e4)
        for x in np.split(at, range(BLOCK, len(at), BLOCK)):
            e = score(x)
            e = e[:, 1:] - e[:, :1] + self.opens
            gain[x], begin[x] = e.max(axis=1), e[:, BEGINS[1:]].max(axis=1)
        sums = np.cumsum(gain)
        before = sums + np.maximum.accumulate(begin - sums)  # best sum of a stretch up to here
        after = np.maximum.accumulate(sums[::-1])[::-1] - sums  # and of its words after this one
        y = np.zeros(len(s), np.int8)
        at = at[(before + after + self.closes)[at] >= -1e-4]
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
            opened = np.where(np.isin(first, heads)[:, None], self.start, self.moves[0])
            closed = np.where(np.isin(last, heads + lens - 1)[:, None], 0.0, self.moves[:, 0])
            y[at] = self._viterbi(score(at), last - first + 1, opened, closed)
        return [y[a : a + n] for a, n in zip(heads, lens)]

    def _viterbi(self, e: np.ndarray, lens: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Best labels of stretches that stand one after the other, all of them a step at a time."""
        order = np.argsort(-lens, kind="stable")
        off, lens, closed = offsets_of(lens)[:-1][order], lens[order], closed[order]
        live = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
        score, back, final = opened[order] + e[off], [], np.zeros((len(lens), len(LABELS)))
        final[:] = score
        for t in range(1, lens[0]):
            through = score[: live[t], :, None] + self.moves[None]
            back.append(through.argmax(axis=1).astype(np.int8))
            score = through.max(axis=1) + e[off[: live[t]] + t]
            final[: live[t]] = score
        now, y = (final + closed).argmax(axis=1), np.zeros(len(e), np.int8)
        for t in range(lens[0] - 1, -1, -1):
            n = live[t]
            y[off[:n] + t] = now[:n]
            if t:
                now[:n] = back[t - 1][np.arange(n), now[:n]]
        return y


class Shapes(dict):
    """Number of each word's shape; short words are remembered."""

    def __init__(self, field: ChainField):
        self.field = field

    def __missing__(self, word: str) -> int:
        k = self.field.of(shape(word))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = k
        return k

    def __reduce__(self):
        return Shapes, (self.field,)


@lru_cache(maxsize=1)
def trained() -> ChainField:
    return ChainField(labelled_rows())


def _added(text: str, run: list[tuple[int, int]], y: np.ndarray, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    for at in np.flatnonzero(BEGINS[y]):
        to = at + 1
        while to < len(run) and LABELS[y[to]] == "I" + LABELS[y[at]][1:]:
            to += 1
        a, b = run[at][0], run[to - 1][1]
        while b > a and text[b - 1] in ".,;:!?\"'>|":
            b -= 1
        while a < b and text[a] in "\"'<|,;:":
            a += 1
        if b > a and not any(s < b and a < e for _, s, e in taken):
            yield KINDS.index(LABELS[y[at]][2:]), a, b


def find(texts: list[str], field: ChainField) -> list[list[tuple[int, int, int, bool]]]:
    """All spans (number of the kind, start, end, base) of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    for k, y in enumerate(field.decode([WORD.findall(t) for t in texts])):
        if y.any():
            more[k] += _added(texts[k], [m.span() for m in WORD.finditer(texts[k])], y, base[k])
    return [sorted([(*s, True) for s in b] + [(*s, False) for s in m]) for b, m in zip(base, more)]


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(((k, a, b) for k, a, b, _ in spans), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: list[str] | None = None, redacted: bool = False, into: str = "spans") -> DataFrame:
    """The columns named in keep (all by default) and the spans in a new one; with redacted, texts come without them."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = find([t or "" for t in texts], field)
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in s] for s in found], kind)
            if redacted:
                texts = [redact(t, s) if s else t for t, s in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in keep), spans], [*keep, into])

    kinds = dict(docs.dtypes)
    read = docs.select(*dict.fromkeys([*keep, "text"]))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{into}` {SPANS}"]))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of the base spans, and all spans, of every document."""
    found = personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), line), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLE: dict[str, str] = {}
