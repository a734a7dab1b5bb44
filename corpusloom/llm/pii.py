"""Personal data by a linear-chain conditional random field over word shapes.

The field is trained here, by gradient ascent on the exact log-likelihood, from a small labelled table that ``labelled_table`` makes
(``TRAIN_ROWS`` sentences, a documented bound). Emissions depend only on the shapes of a token and its neighbours, so they are looked up
per shape. Decoding is exact: a token whose margin for the label O exceeds all that transitions can give back is O in the best path, and
Viterbi runs, batched in numpy, over the remaining runs of tokens only. Shapes tell numbers that check as a card's does and addresses of four bytes from others
that look alike; a card in groups must check as a whole. A hash counts as secret where a quotation mark, a colon or the like leads up to it.

Defined results: null, empty and blank texts hold nothing and pass as they are; repeated documents get the same answer each; texts are read
whole; further columns pass through, and ``n_chars``, if there is one, follows the new text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, read_table, with_column

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET")
L = len(LABELS)
TRAIN_ROWS = 1500
_TOKEN = re.compile(r"[^\s\"'`()\[\]{}<>|,;!?%$#*&=]+|[^\s\w]")
_FOUR = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_RUNS = re.compile(r"[A-Z]+|[a-z]+|\d+|[^\x00-\x7f]+|.", re.S)


def checks(number: str) -> bool:
    """Whether the digits, which may stand in groups, begin and end as a card's number does (Luhn)."""
    d = [int(c) for c in number if c.isdigit()]
    twice = [2 * x - 9 * (x > 4) for x in d[-2::-2]]
    return 13 <= len(d) <= 19 and 2 <= d[0] <= 6 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0


@lru_cache(maxsize=200_000)
def _rare_shape(token: str) -> str:
    """Kinds of characters with lengths of their runs in classes; the part before a trailing full stop."""
    core = token.rstrip(".:") or token
    if core.isalpha():
        return _CUES.get(core.lower(), "a")
    if len(core) == 1 and not core.isalnum():
        return core if core in "\"'()+-=@:/" else "mark"
    if _FOUR.fullmatch(core):
        return "9.9.9.9" if all(int(x) < 256 for x in core.split(".")) else "9.9.9.9>"
    if "@" in core:
        user, _, host = core.partition("@")
        return "U@H.H" if user and "." in host.strip(".") else "has@"
    digits = sum(c.isdigit() for c in core)
    if digits == len(core):
        n = len(core)
        return f"9x{n}" if n <= 4 else "9x5-7" if n <= 7 else "9x8-12" if n <= 12 else "9x13-19" + ("luhn" if checks(core) else "") if n <= 19 else "9x20+"
    if digits == 16 and len(core) == 19 and all(len(x) == 4 for x in core.split("-")):
        return "9999-x4" + ("luhn" if checks(core) else "")
    if core.isalnum() and digits and len(core) >= 16:
        return "hex" if all(c in "0123456789abcdefABCDEF" for c in core) else "mixed16+"
    if "://" in core:
        return "url"
    if core.isalnum() and digits >= 3 and len(core) >= 10 and len(_RUNS.findall(core)) >= 5:
        return "mixed10-15"
    out = []
    for run in _RUNS.findall(core):
        c = run[0]
        if c.isdigit():
            out.append("9" * min(len(run), 5))
        elif c.isalpha():
            out.append("A" if c.isupper() and len(run) == 1 else "B" if c.isupper() else "a")
        else:
            out.append(c)
    s = "".join(out)
    if len(core) >= 20 and digits and not any(c in s for c in "-:/.") and not s.startswith("9999"):
        return "mixed16+"
    return s


_CUES = {w: f"cue:{c}" for c, ws in {"secret": "token key secret password apikey api_key passwd bearer", "call": "phone tel call telephone mobile fax", "card": "card visa mastercard amex", "mail": "email mail e-mail", "ssn": "ssn social", "ip": "ip host server address"}.items() for w in ws.split()}


def shape(token: str) -> str:
    if token.isalpha():
        return _CUES.get(token.lower(), "a")
    return _rare_shape(token)


def labelled_table(rows: int = TRAIN_ROWS, seed: int = 1) -> list[tuple[list[str], list[int]]]:
    """Sentences as tokens with labels: invented words with personal data, and with numbers that are none."""
    r = random.Random(seed)
    syllables = "the an er tion on re th in ing ble st ou ha nd wh ed sh ly ment que ción as lich ung ver schön é ar ue mi eau pa".split()
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))

    def email():
        user = r.choice([f"{word()}.{digits(2)}", word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}+{digits(1)}", f"{word()}{digits(3)}"])
        return user + "@" + r.choice([f"mail{digits(1)}.example.com", "example.org", f"{word()}.net", f"{word()}.co.uk"])

    def card(n: int) -> str:
        d = r.choice("3456") + digits(n - 2)
        return next(d + x for x in "0123456789" if checks(d + x))

    def parted(text: str, by: str) -> str:
        return by.join(text[i : i + 4] for i in range(0, len(text), 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"])

    make = {
        1: email,
        2: phone,
        3: lambda: ".".join(octet() for _ in range(4)),
        4: lambda: r.choice([card(16), card(16), card(15), parted(card(16), "-"), parted(card(16), " ")]),
        5: lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        6: lambda: r.choice([hexes(40), hexes(32), hexes(64), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 40))) + digits(1)]),
    }
    lead = {1: ["", "email:", "mail"], 2: ["", "call", "tel:"], 3: ["", "", "ip", "host"], 4: ["", "", "card", "visa"], 5: ["", "ssn", "ssn:"], 6: ['token = "', 'key="', "secret: ", "api_key = ", "password=", "passwd: ", "", '"']}
    harmless = [
        lambda: str(r.randint(1900, 2030)), lambda: digits(r.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)},{digits(3)}",
        lambda: "@" + word(), lambda: word() + "-" + word(), lambda: f"{word()}/{word()}", lambda: f"https://{word()}.org/{word()}", lambda: f"{word()}.{word()}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"({digits(1)})", lambda: "3.0", lambda: "1.0.2", lambda: f"{word()}{digits(2)}", lambda: f"({digits(4)})", lambda: "=" + word(), lambda: "token", lambda: f"key = {word()}",
        lambda: "(" + word() + ")", lambda: word() + ".", lambda: word().upper() + "!!", lambda: word() + "%%%", lambda: "| " + word() + " |", lambda: f"{digits(3)} {digits(3)}", lambda: f'"{word()}"', lambda: f"+{digits(1)}",
        lambda: " ".join([f"{word()}.{word()}"] * r.randint(1, 6)), lambda: " ".join([f"{word().capitalize()}.{word()}"] * r.randint(1, 6)), lambda: " ".join([r.choice([f"{digits(2)}-{word()}", f"{word()}-{word()}", f"{word()}:{word()}", digits(2)])] * r.randint(1, 6)),
    ]
    # what looks like the like but isn't: hashes of commits, numbers of orders and books, moments in milliseconds, versions
    number = lambda n: next(x for x in iter(lambda: digits(n), None) if not checks(x))
    harmless += [
        lambda: f"{word()} {hexes(40)}", lambda: f"commit {hexes(r.choice([32, 40, 64]))}", lambda: f"({hexes(40)})", lambda: number(r.randint(13, 19)), lambda: f"order {number(r.randint(13, 16))}", lambda: "978" + digits(10),
        lambda: "1" + digits(12), lambda: parted(number(16), "-"), lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
    ]
    out = []
    for _ in range(rows):
        tokens: list[str] = []
        labels: list[int] = []

        def put(text, label):
            t = _TOKEN.findall(text)
            tokens.extend(t)
            labels.extend([label] * len(t))

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                put(word() + r.choice(["", "", "", ".", ",", "!!", "%%%"]), 0)
            if r.random() < 0.6:
                k = r.randint(1, L - 1)
                before, mine = r.choice(lead[k]), make[k]()
                if k == 6 and before.startswith("passw"):
                    mine = r.choice([hexes, lambda n: word() + digits(3) + word() + digits(2)])(r.randint(12, 24))
                if k == 6 and not before and shape(mine) in ("hex", "mixed10-15"):
                    before = r.choice(lead[k][:4])  # a hash of which nothing says that it's secret may be of a commit
                put(before, 0)
                put(mine, k)
                put(r.choice(["", "", "", ".", ",", "!!", "###", "***"]) if not before.endswith('"') else '"', 0)
            else:
                put(r.choice(harmless)(), 0)
            for _ in range(r.randint(0, 3)):
                put(word(), 0)
        if tokens:
            out.append((tokens, labels))
    return out


class Field:
    """Weights of a linear-chain field: emissions by shape before, at and after a token, and transitions."""

    def __init__(self, shapes: dict[str, int], weight: np.ndarray, trans: np.ndarray):
        self.shapes, self.weight, self.trans = shapes, weight, trans  # weight: 3 x shapes x labels; shape 0 is any unknown one
        self.bound = (trans.max() - trans[:, 0].min()) + (trans.max() - trans[0].min())

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: shapes in reading order, with id 1 (edge) between sequences."""
        w = self.weight
        e = w[1][ids]
        e[1:] += w[0][ids[:-1]]
        e[:-1] += w[2][ids[1:]]
        return e

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best path; exact, since certain tokens are O and part the rest."""
        e = self.emissions(ids)
        label = np.zeros(len(ids), np.int8)
        doubt = (e[:, 0] - e[:, 1:].max(axis=1)) <= self.bound
        doubt &= ids != 1
        if not doubt.any():
            return label
        edge = np.flatnonzero(np.diff(np.concatenate([[0], doubt.view(np.int8), [0]])))
        start, stop = edge[::2], edge[1::2]
        size = stop - start
        for n in np.unique(size):
            s = start[size == n]
            for at in range(0, len(s), 4096):
                some = s[at : at + 4096]
                label[some[:, None] + np.arange(n)] = self._viterbi(e[some[:, None] + np.arange(n)])
        return label

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """Paths that come from O and go to O; e: runs x tokens x labels."""
        b, n, _ = e.shape
        score = self.trans[0] + e[:, 0]
        back = np.zeros((b, n, L), np.int8)
        for t in range(1, n):
            s = score[:, :, None] + self.trans
            back[:, t] = s.argmax(axis=1)
            score = s.max(axis=1) + e[:, t]
        out = np.zeros((b, n), np.int8)
        out[:, -1] = (score + self.trans[:, 0]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            out[:, t - 1] = back[np.arange(b), t, out[:, t]]
        return out


def train(table: list[tuple[list[str], list[int]]], steps: int = 100, ridge: float = 1e-3, rate: float = 0.15) -> Field:
    """Gradient ascent (with Adam's step sizes) on the conditional log-likelihood by forward and backward sums, scaled at each token."""
    shapes = {"\x00unknown": 0, "\x00edge": 1}
    n = max(len(t) for t, _ in table) + 2
    ids = np.ones((n, len(table)), np.int64)  # token by token, since the sums go along the sentences
    gold = np.zeros((n, len(table)), np.int64)
    mask = np.zeros((n, len(table)), bool)
    seen: dict[str, int] = {}
    for tokens, _ in table:
        for t in tokens:
            seen[shape(t)] = seen.get(shape(t), 0) + 1
    for s, c in sorted(seen.items()):
        if c > 2:  # a shape seen once or twice stands for the unknown ones
            shapes[s] = len(shapes)
    for i, (tokens, labels) in enumerate(table):
        k = len(tokens)
        ids[1 : k + 1, i] = [shapes.get(shape(t), 0) for t in tokens]
        gold[1 : k + 1, i] = labels
        mask[: k + 2, i] = True
    theta = [np.zeros((3, len(shapes), L)), np.zeros((L, L))]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    eye = np.eye(L)
    both = mask[1:, :, None]
    pairs = np.einsum("tsi,tsj->ij", eye[gold[:-1]] * both, eye[gold[1:]] * both)
    for step in range(1, steps + 1):
        w, trans = theta
        e = w[1][ids]
        e[1:] += w[0][ids[:-1]]
        e[:-1] += w[2][ids[1:]]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(trans)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, len(table), 1))
        alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for t in range(1, n):
            a = alpha[t - 1] @ move * e[t]
            scale[t] = np.where(mask[t, :, None], a.sum(axis=1, keepdims=True), 1.0)
            alpha[t] = np.where(mask[t, :, None], a / scale[t], alpha[t - 1])
        for t in range(n - 2, -1, -1):
            beta[t] = np.where(mask[t + 1, :, None], (e[t + 1] * beta[t + 1]) @ move.T / scale[t + 1], 1.0)
        node = alpha * beta
        node /= node.sum(axis=2, keepdims=True)
        diff = (eye[gold] - node) * mask[:, :, None]
        gw = np.zeros_like(w)
        for part, (where, what) in enumerate(((ids[:-1], diff[1:]), (ids, diff), (ids[1:], diff[:-1]))):
            for y in range(L):
                gw[part, :, y] = np.bincount(where.ravel(), what[:, :, y].ravel(), len(shapes))
        gt = pairs - move * np.einsum("tsi,tsj->ij", alpha[:-1] * both, e[1:] * beta[1:] / scale[1:], optimize=True)
        for x, g, s in zip(theta, (gw, gt), state):
            g = g / len(table) - ridge * x
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Field(shapes, theta[0], theta[1])


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def spans(texts: list[str | None], field: Field) -> list[list[tuple[int, int, str]]]:
    """(start, end, label) of the personal data in each text, end exclusive."""
    ids: list[int] = [1]
    places: list[list[tuple[int, int]]] = []
    get = field.shapes.get
    plain = get("a", 0)
    known: dict[str, int] = {}
    for t in texts:
        if not t or t.isspace():
            places.append([])
            continue
        for w in _TOKEN.findall(t):
            i = known.get(w)
            if i is None:
                i = known[w] = plain if w.isalpha() and w.lower() not in _CUES else get(shape(w), 0)
            ids.append(i)
        ids.append(1)
        places.append([(0, 0)])
    labels = field.decode(np.array(ids, np.int64))
    ends = np.flatnonzero(np.array(ids) == 1)
    out: list[list[tuple[int, int, str]]] = []
    k = 0
    for t, p in zip(texts, places):
        if not p:
            out.append([])
            continue
        lo, hi = ends[k] + 1, ends[k + 1]
        k += 1
        mine = labels[lo:hi]
        found: list[tuple[int, int, str]] = []
        if mine.any():
            last = -2
            for j, m in enumerate(_TOKEN.finditer(t)):
                y = int(mine[j])
                if y:
                    a, b = m.span()
                    b = a + len(m.group().rstrip(".:")) or b
                    part_of = last == j - 1 and found and found[-1][2] == LABELS[y] and (LABELS[y] == "PHONE" or (LABELS[y] == "CARD" and b - a <= 4))
                    if part_of:
                        found[-1] = (found[-1][0], b, LABELS[y])
                    else:
                        found.append((a, b, LABELS[y]))
                    last = j
        # a card's groups of digits count as one number
        out.append([x for x in found if x[2] != "CARD" or checks(t[x[0] : x[1]])])
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, y in found:
        parts += [text[at:a], f"[{y}]"]
        at = b
    return "".join([*parts, text[at:]])


def _marked(docs: DataFrame, field: Field) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, whose names follow: new text, spans."""
    new_text, new_spans = fresh(docs, "_pii_text"), fresh(docs, "_pii_spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                found = spans(texts, field)
                new = [redact(t, s) if s else t for t, s in zip(texts, found)]
                b = b.append_column(new_text, pa.array(new, pa.string()))
                yield b.append_column(new_spans, pa.array([[{"start": x, "end": y, "label": z} for x, y, z in s] for s in found], kind))

    return docs.mapInArrow(run, with_column(docs.schema, (new_text, "string"), (new_spans, "array<struct<start:int,end:int,label:string>>"))), new_text, new_spans


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data: doc_id, spans, redacted_text."""
    out, text, found = _marked(docs.select("doc_id", "text"), field or default_field())
    return out.filter(F.size(found) > 0).select("doc_id", F.col(found).alias("spans"), F.col(text).alias("redacted_text"))


def redact_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All documents with personal data replaced by its kind in brackets, with the columns they came with."""
    out, text, found = _marked(docs, field or default_field())
    cols = []
    for f in docs.schema.fields:
        if f.name == "text":
            cols.append(F.col(text).alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(F.size(found) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col(f.name))
    return out.select(*cols)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, where it stands and the text without it."""
    return find_pii(read_table(spark, sf_dir, "documents"))
