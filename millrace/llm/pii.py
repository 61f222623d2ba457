"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The field adds spans that they cannot see (phone numbers
without a plus sign, written-out mail addresses, dotted card numbers): it labels tokens by
their shapes and those of their neighbours, is trained on a small labelled table, and is
decoded by Viterbi over numpy batches of token runs. A label other than "outside" is only allowed
within ``REACH`` tokens of a digit, an at sign or a written "at", so all other text needs no
decoding. Documents are judged one by one: no shuffle, and long or repeated texts
cost no more than their length.

Defined results. Null text: as an empty one, no spans. Repeated rows: one result each. Empty
table: empty result. The result columns replace columns of the same name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
NUMBER = re.compile(r"[0-9]+")
CARD_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: each at sign has one leftmost start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers in a row of numbers joined by full stops, none above 255."""
    for chain in NUMBER_CHAIN.finditer(text):
        parts = [m.span() for m in NUMBER.finditer(text, chain.start(), chain.end())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            if all(b - a <= 3 or not text[a:b - 3].strip("0") for a, b in four) and all(int(text[max(a, b - 3):b]) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_in(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD_CHAIN.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_in(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(digits_in(m[0])) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    if not re.search(r"[0-9@]", text):
        return []
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]


# --- the labelled table -------------------------------------------------------------------

#: Sentences with places for a value; a place of kind "none" is an ordinary number.
FRAMES = (
    "Call me at {}.", "Phone: {}", "You can reach us under {} until five.", "Tel. {} or by post", "my number is {}, ask for the boss",
    "Write to {} today.", "Contact {} for details.", "mail: {}", "Send it to {}, please.",
    "The card {} was charged.", "Pay with {} now", "card number {}", "Log in from {} only.", "The server {} did not answer.",
    "{}", "He said {} and left.", "The {} was on the list", "and {} of the {}", "It was {}.",
)


def examples(count: int = 640, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The built-in labelled table: ``count`` sentences with their spans, made by rule."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "ti", "er", "on", "the", "is", "lo", "mar", "ke", "su")) for _ in range(r.randint(1, 4)))
    phone = (
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}",
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}",
        lambda: f"0{digits(3)} / {digits(6)}",
    )
    email = (
        lambda: f"{word()}@{word()}.{r.choice(('com', 'org', 'net'))}", lambda: f"{word()}.{word()}@{word()}.example.com",
        lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}.org", lambda: f"{word()} at {word()} dot net",
        lambda: f"{word()}{digits(2)} [at] {word()}.com",
    )
    ip = (lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: " . ".join(str(r.randint(10, 255)) for _ in range(4)))
    card = (
        lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)),
        lambda: ".".join(digits(4) for _ in range(4)), lambda: f"3{digits(3)} {digits(6)} {digits(5)}", lambda: "4" + digits(15),
    )
    none = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1950, 2029)}",
        lambda: f"{r.randint(1, 23)}:{r.randint(10, 59)}", lambda: f"${r.randint(1, 9)},{digits(3)}.{digits(2)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}", lambda: digits(r.randint(1, 12)),
        lambda: f"{word()} {r.randint(1, 500)}", lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"{digits(2)} {word()} {digits(3)}", lambda: f"{word()}{digits(3)}",
        lambda: f"{digits(3)} {digits(3)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{word()} at {word()}",
        lambda: f"{digits(8)} of {digits(9)}", lambda: f"{digits(3)}, {digits(3)} and {digits(4)}", lambda: f"@{word()}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(16)), lambda: " ".join(str(r.randint(1, 99)) for _ in range(6)),
    )
    values = {"phone": phone, "email": email, "ip": ip, "card": card, "none": none}
    out = []
    for k in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))) + " " * (k % 2), []
        frame = r.choice(FRAMES)
        for n, part in enumerate(frame.split("{}")):
            if n:
                kind = r.choice(("phone", "email", "ip", "card", "none", "none", "none"))
                value = r.choice(values[kind])()
                if kind != "none":
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            text += part
        out.append((text + " " + " ".join(word() for _ in range(r.randint(0, 4))), spans))
    return out


def labelled_table(spark: SparkSession, count: int = 640) -> DataFrame:
    rows = [(text, [{"kind": k, "start": a, "end": b} for k, a, b in spans]) for text, spans in examples(count)]
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:bigint,end:bigint>>")


# --- the field ----------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]| at ")
REACH = 8
NEVER = -1e6
Token = tuple[int, int]


def shape(token: str) -> str:
    """``d4`` for four digits, ``x`` and ``X`` for words, ``m`` for mixtures, marks as they are."""
    if token.isdigit():
        return f"d{min(len(token), 9)}"
    if token.isalpha():
        return "x" if token.islower() else "X"
    return "m" if token.isalnum() else token


def features(text: str, tokens: list[Token]) -> list[list[str]]:
    words = [text[a:b] for a, b in tokens]
    shapes = ["<<", "<<", *map(shape, words), ">>", ">>"]
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(len(tokens))] + [False]
    out = []
    for i, w in enumerate(words):
        s = shapes[i:i + 5]
        out.append([
            "b", f"0{s[2]}", f"-{s[1]}{glued[i]}", f"+{s[3]}{glued[i + 1]}", f"={s[1]}{s[2]}{s[3]}{glued[i]}{glued[i + 1]}",
            f"<{s[0]}{s[1]}{s[2]}", f">{s[2]}{s[3]}{s[4]}", f"w{w.lower()}" if w.isalpha() else "b",
            f"p{words[i - 1].lower()}" if i and words[i - 1].isalpha() else "b", f"n{words[i + 1].lower()}" if i + 1 < len(words) and words[i + 1].isalpha() else "b",
        ])
    return out


def runs(text: str) -> Iterator[list[Token]]:
    """Token runs within ``REACH`` tokens of a trigger, line by line."""
    at = 0
    while found := TRIGGER.search(text, at):
        start = text.rfind("\n", 0, found.start()) + 1
        end = text.find("\n", found.start())
        end = len(text) if end < 0 else end
        tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        near = [False] * len(tokens)
        starts = np.array([a for a, _ in tokens])
        for m in TRIGGER.finditer(text, start, end):
            k = int(np.searchsorted(starts, m.start(), "right")) - 1
            lo = max(0, k - REACH)
            near[lo:k + REACH + 1] = [True] * (min(len(tokens), k + REACH + 1) - lo)
        run: list[Token] = []
        for token, inside in zip(tokens, near, strict=True):
            if inside:
                run.append(token)
            elif run:
                yield run
                run = []
        if run:
            yield run
        at = end + 1
        if at > len(text):
            break


class Field:
    """Weights of a linear-chain conditional random field; labels as in ``LABELS``."""

    def __init__(self, numbers: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.numbers, self.emit, self.move = numbers, emit, move

    @staticmethod
    def allowed() -> np.ndarray:
        """Row: label before; an I label follows its own B or I. The last row: the start."""
        out = np.zeros((len(LABELS) + 1, len(LABELS)))
        for j, b in enumerate(LABELS):
            for i, a in enumerate([*LABELS, "start"]):
                if b[0] == "I" and a[2:] != b[2:] or b[0] == "I" and a == "start":
                    out[i, j] = NEVER
        return out

    @classmethod
    def train(cls, rows: list[tuple[str, list[Span]]], rounds: int = 100, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Maximum likelihood by Adam over all rows at once (forward and backward sums)."""
        names: dict[str, int] = {"": 0}
        lines, gold = [], []
        for text, spans in rows:
            for run in runs(text):
                ids = [[names.setdefault(f, len(names)) for f in fs] for fs in features(text, run)]
                labels = []
                for a, b in run:
                    kind = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
                    labels.append(0 if kind is None else LABELS.index(f"{'B' if a == kind[1] else 'I'}-{kind[0]}"))
                for i, label in enumerate(labels):  # a run may begin within a span
                    if LABELS[label][0] == "I" and (i == 0 or LABELS[labels[i - 1]][2:] != LABELS[label][2:]):
                        labels[i] = label - 1
                lines.append(ids)
                gold.append(labels)
        n, t, k, width = len(lines), max(map(len, lines)), len(LABELS), len(lines[0][0])
        x, y, mask = np.zeros((n, t, width), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (ids, labels) in enumerate(zip(lines, gold, strict=True)):
            x[i, :len(ids)], y[i, :len(ids)], mask[i, :len(ids)] = ids, labels, True
        one = np.eye(k)
        emit, move, fixed = np.zeros((len(names), k)), np.zeros((k + 1, k)), cls.allowed()
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
        flat = x[mask].ravel()
        for step in range(1, rounds + 1):
            score, trans = emit[x].sum(axis=2), move + fixed
            alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
            alpha[:, 0] = score[:, 0] + trans[k]
            for i in range(1, t):
                now = log_sum(alpha[:, i - 1, :, None] + trans[None, :k], 1) + score[:, i]
                alpha[:, i] = np.where(mask[:, i, None], now, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                now = log_sum(trans[None, :k] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], now, 0)
            total = log_sum(alpha[:, -1], 1)
            p = np.exp(alpha + beta - total[:, None, None])
            diff = (p - one[y])[mask]
            g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
            np.add.at(g_emit, flat, np.repeat(diff, width, axis=0))
            g_move[k] = (p[:, 0] - one[y[:, 0]]).sum(axis=0)
            for i in range(1, t):
                both = mask[:, i]
                pair = np.exp(alpha[both, i - 1, :, None] + trans[None, :k] + (score[both, i] + beta[both, i])[:, None, :] - total[both, None, None])
                g_move[:k] += pair.sum(axis=0)
                np.add.at(g_move, (y[both, i - 1], y[both, i]), -1)
            for w, g, (m, v) in ((emit, g_emit, moments[0]), (move, g_move, moments[1])):
                g = g / n + decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        emit[0] = 0
        return cls(names, emit.astype(np.float32), (move + fixed).astype(np.float32))

    def decode(self, sequences: list[list[list[str]]]) -> list[list[int]]:
        """Best labels of each sequence, by Viterbi over sequences of like length together."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        k, at = len(LABELS), 0
        while at < len(order):
            longest = max(32, 2 * len(sequences[order[at]]))
            group = []
            while at < len(order) and len(sequences[order[at]]) <= longest and len(group) < max(1, 100_000 // longest):
                group.append(order[at])
                at += 1
            n, t, width = len(group), len(sequences[group[-1]]), len(sequences[group[0]][0])
            x, sizes = np.zeros((n, t, width), np.int64), np.array([len(sequences[i]) for i in group])
            for row, i in enumerate(group):
                x[row, :sizes[row]] = [[self.numbers.get(f, 0) for f in fs] for fs in sequences[i]]
            back, last = np.zeros((n, t, k), np.int8), np.zeros((n, k), np.float32)
            best = self.emit[x[:, 0]].sum(axis=1) + self.move[k]
            for i in range(1, t):
                last = np.where((sizes == i)[:, None], best, last)
                ways = best[:, :, None] + self.move[None, :k]
                back[:, i] = ways.argmax(axis=1)
                best = ways.max(axis=1) + self.emit[x[:, i]].sum(axis=1)
            last = np.where((sizes == t)[:, None], best, last)
            label = last.argmax(axis=1)
            path = np.zeros((n, t), np.int8)
            for i in range(t - 1, -1, -1):
                inside = i < sizes
                path[inside, i] = label[inside]
                label = np.where(inside, back[np.arange(n), i, label], label)
            for row, i in enumerate(group):
                out[i] = path[row, :sizes[row]].tolist()
        return out


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def plausible(kind: str, value: str) -> bool:
    """What a labelled span must hold whatever the field says."""
    n = len(digits_in(value))
    return {"phone": 7 <= n <= 15, "card": 13 <= n <= 19 and luhn(digits_in(value)), "ip": n >= 4, "email": bool(re.search(r"[@\[(]|\sat\s.*\sdot\s", value))}[kind]


def labelled_spans(text: str, run: list[Token], labels: list[int]) -> list[Span]:
    out: list[Span] = []
    for (a, b), label in zip(run, labels, strict=True):
        name = LABELS[label]
        if name[0] == "B":
            out.append((name[2:], a, b))
        elif name[0] == "I":
            out[-1] = (out[-1][0], out[-1][1], b)
    return [s for s in out if plausible(s[0], text[s[1]:s[2]])]


def find_spans(field: Field, texts: list[str | None]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of every text; a labelled span that meets a base one is left out."""
    pending: list[tuple[int, list[Token]]] = []
    sequences = []
    for i, text in enumerate(texts):
        for run in runs(text or ""):
            pending.append((i, run))
            sequences.append(features(text, run))
    more: dict[int, list[Span]] = {}
    for (i, run), labels in zip(pending, field.decode(sequences), strict=True):
        more.setdefault(i, []).extend(labelled_spans(texts[i], run, labels))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        free = []
        for kind, a, b in more.get(i, []):
            k = int(np.searchsorted(starts, b))  # base spans of other kinds may nest: look at all before
            if all(end <= a for _, end in taken[:k]):
                free.append((kind, a, b))
        yield base, sorted({*base, *free}, key=lambda s: (rank[s[0]], s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


MAX_LABELLED = 20_000


def train_field(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Field:
    """Fit on (``text``, ``spans``), at most ``max_labelled`` rows of it."""
    rows = labelled.orderBy("text").limit(max_labelled).collect()
    return Field.train([(r.text, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows])


def with_spans(documents: DataFrame, labelled: DataFrame | None, text: str, added: dict[str, pa.DataType], make) -> DataFrame:
    """Add the columns ``added``, which ``make(text, base spans, all spans)`` gives row by row."""
    spark = documents.sparkSession
    field = spark.sparkContext.broadcast(train_field(labelled_table(spark) if labelled is None else labelled))
    kept = documents.drop(*added)
    schema = kept.select("*", *[F.lit(None).cast(from_arrow_type(t)).alias(n) for n, t in added.items()]).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(text).to_pylist()
                rows = [make(t, base, all_spans) for t, (base, all_spans) in zip(texts, find_spans(field.value, texts), strict=True)]
                for k, (name, kind) in enumerate(added.items()):
                    batch = batch.append_column(name, pa.array([row[k] for row in rows], kind))
                yield batch

    return kept.mapInArrow(scan, schema)


ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(documents: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``all_spans``: (kind, start, end), in code points, end exclusive."""
    rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    added = {"base_spans": ARROW_SPANS, "all_spans": ARROW_SPANS}
    return with_spans(documents, labelled, text, added, lambda _, base, spans: (rows(base), rows(spans)))


def span_digest(documents: DataFrame, **options) -> DataFrame:
    """Add base counts per kind, ``base_sha256``, ``spans`` and ``n_added``."""
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    return detect(documents, **options).withColumns(counts | {
        "base_sha256": F.sha2(join(F.col("base_spans")), 256), "spans": join(F.col("all_spans")),
        "n_added": (F.size("all_spans") - F.size("base_spans")).cast("long"),
    }).drop("base_spans", "all_spans")


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with spans replaced by their kinds; one that begins within another goes with it."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets; null texts stay null."""
    found = with_spans(documents, labelled, text, {"_masked": pa.string()}, lambda t, _, spans: (masked(t, spans),))
    return found.withColumn(text, F.col("_masked")).drop("_masked")
