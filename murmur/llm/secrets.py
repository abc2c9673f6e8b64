"""Secret scans: probabilistic automata inferred from labelled credentials.

Three base rules find assignments, access keys and hexadecimal strings. What they
find in the corpus are the labelled credentials, by kind. Everything else of
``SHORTEST`` characters or more in their alphabet is a candidate: a run of such characters, and its parts between ``/`` and between ``.``,
so that a token in an address or a dotted key is seen by itself. Candidates are the
background, too.

The ``SAMPLE`` distinct values with the smallest hash of each kind, and of the
candidates, are read into prefix trees over character classes. States are merged in
red-blue order into a deterministic probabilistic automaton where, within Hoeffding
bounds, their ends, their next classes and how far their words go on agree; of
several such states the one with the most similar lengths is taken, which keeps the
positions of a format apart although few values share a long beginning.

Every candidate is scored. It becomes a span of kind ``inferred`` if an automaton
explains it about as well as its own training values, and better than the background
by ``EVIDENCE`` nats in all: a candidate is a secret once in a hundred thousand times
or so. A run is tried whole before its parts. Base spans always stay.

Positions are code points, ends exclusive. Null text is empty. Repeated rows get
equal rows. Very long texts and values are scanned and scored whole. An empty table
gives an empty result. Without any labelled credential no span is added.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, documents, small_batches
from murmur.session import materialise

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "inferred")
ALPHABET = "[A-Za-z0-9+/_.=-]"
#: Shortest value that the base rules label.
SHORTEST = 6

SAMPLE = 1500
#: Characters of a training value that enter a tree; a longer value has no end there.
LONGEST = 512
ALPHA = 0.05
#: Nats by which credentials must explain a candidate better than the background.
EVIDENCE = 12.0
#: Share of training values that may score below the bar of their automaton, and slack below it.
TAIL, SLACK = 0.01, 0.1
#: Verdicts that a worker remembers.
REMEMBERED = 200_000

#: Classes: digit, a-f, g-z, A-F, G-Z, other.
_CLASSES = {c: k for k, run in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")) for c in run}
_SIZES = (10, 6, 20, 6, 20, 6)
N_CLASSES = len(_SIZES)


def classes(value: str) -> list[int]:
    return [_CLASSES.get(c, N_CLASSES - 1) for c in value]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base rules, ordered by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


RUN = re.compile(ALPHABET + "{%d,}" % SHORTEST)


def runs_of(text: str, base: list) -> Iterator[tuple[int, str]]:
    """(start, run) of the runs that no base span overlaps."""
    at = 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        # base spans are in the order of their starts
        near = itertools.takewhile(lambda b: b[0] < m.end(), itertools.islice(base, at, None))  # noqa: B023
        if not any(m.start() < b[2] for b in near):
            yield m.start(), m[0]


def parts_of(run: str) -> Iterator[list[tuple[int, str]]]:
    """Ways to read a run, coarser ones first: without dots around it, cut at slashes, cut at dots as well."""
    whole = run.strip(".")
    if len(whole) >= SHORTEST:
        yield [(run.index(whole), whole)]
    for cut in ("[^/]+", "[^/.]+"):
        found = [(m.start(), m[0]) for m in re.finditer(cut, run) if len(m[0]) >= SHORTEST]
        if found and len(found[0][1]) < len(whole):
            yield found


class Automaton:
    """A deterministic probabilistic automaton: arrivals, ends and moves of each state."""

    def __init__(self):
        self.n, self.ends, self.moves = [0], [0], [{}]
        #: how many words go on for how long from a state
        self.rest: list[Counter] = [Counter()]

    def add(self, word: list[int], ended: bool = True) -> None:
        state, left = 0, len(word)
        self.n[0] += 1
        self.rest[0][left] += 1
        for symbol in word:
            left -= 1
            after = self.moves[state].get(symbol)
            if after is None:
                after = self.moves[state][symbol] = len(self.n)
                self.n.append(0)
                self.ends.append(0)
                self.moves.append({})
                self.rest.append(Counter())
            state = after
            self.n[state] += 1
            self.rest[state][left] += 1
        self.ends[state] += ended

    def _bound(self, na: int, nb: int) -> float:
        return math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > self._bound(na, nb)

    def distance(self, a: int, b: int) -> float:
        """Largest difference between the distributions of what is left of the words."""
        x, y = self.rest[a], self.rest[b]
        gap = most = 0.0
        for left in sorted(x.keys() | y.keys()):
            gap += x[left] / self.n[a] - y[left] / self.n[b]
            most = max(most, abs(gap))
        return most

    def compatible(self, a: int, b: int) -> bool:
        pairs, seen = [(a, b)], set()
        while pairs:
            pair = pairs.pop()
            if pair in seen:
                continue
            seen.add(pair)
            x, y = pair
            if self._differ(self.ends[x], self.n[x], self.ends[y], self.n[y]):
                return False
            if self.distance(x, y) > self._bound(self.n[x], self.n[y]):
                return False
            for symbol in self.moves[x].keys() | self.moves[y].keys():
                p, q = self.moves[x].get(symbol), self.moves[y].get(symbol)
                cp, cq = self.flow(x, symbol), self.flow(y, symbol)
                if self._differ(cp, self.n[x], cq, self.n[y]):
                    return False
                if p is not None and q is not None:
                    pairs.append((p, q))
        return True

    def flow(self, state: int, symbol: int) -> int:
        return self.uses.get((state, symbol), 0)

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to the states that its words reach from ``into``."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            self.rest[a] += self.rest[b]
            for symbol, child in self.moves[b].items():
                moved = self.uses.pop((b, symbol))
                self.uses[a, symbol] = self.uses.get((a, symbol), 0) + moved
                if symbol in self.moves[a]:
                    todo.append((self.moves[a][symbol], child))
                else:
                    self.moves[a][symbol] = child

    def infer(self) -> Automaton:
        """Merge compatible states: kept ones are red, their other followers blue."""
        self.uses = {(s, c): self.n[t] for s, m in enumerate(self.moves) for c, t in m.items()}
        red = [0]
        while True:
            known = set(red)
            blue = [(self.n[t], s, c, t) for s in red for c, t in self.moves[s].items() if t not in known]
            if not blue:
                return self
            _, state, symbol, target = max(blue)
            near = sorted((self.distance(other, target), other) for other in red)
            for _, other in near:
                if self.compatible(other, target):
                    self.moves[state][symbol] = other
                    self.fold(other, target)
                    break
            else:
                red.append(target)

    def tables(self) -> tuple[list[list[float]], list[list[int]]]:
        """Log probabilities (last: of the end) and next states, for scoring; -1 is no state."""
        states, order = {0: 0}, [0]
        for s in order:
            for t in self.moves[s].values():
                if t not in states:
                    states[t] = len(order)
                    order.append(t)
        logs, moves = [], []
        for s in order:
            total = self.n[s] + 0.5 * (N_CLASSES + 1)
            logs.append(
                [math.log((self.flow(s, c) + 0.5) / total / _SIZES[c]) for c in range(N_CLASSES)]
                + [math.log((self.ends[s] + 0.5) / total)]
            )
            moves.append([states[self.moves[s][c]] if c in self.moves[s] else -1 for c in range(N_CLASSES)])
        return logs, moves


_NOWHERE = [math.log(1 / (N_CLASSES + 1) / size) for size in _SIZES] + [math.log(1 / (N_CLASSES + 1))]


def likelihood(model: tuple, word: list[int]) -> float:
    """Log likelihood per character, the end included."""
    logs, moves = model
    total, state = 0.0, 0
    for symbol in word:
        if state < 0:
            total += _NOWHERE[symbol]
        else:
            total += logs[state][symbol]
            state = moves[state][symbol]
    total += logs[state][-1] if state >= 0 else _NOWHERE[-1]
    return total / (len(word) + 1)


def learn(values: dict[str, list[str]]) -> dict:
    """Automata by kind and the bar of each; ``ordinary`` is the background."""
    models, bars = {}, {}
    for kind, words in values.items():
        tree = Automaton()
        for word in words:
            tree.add(classes(word[:LONGEST]), len(word) <= LONGEST)
        models[kind] = tree.infer().tables() if words else None
    labelled = [(kind, words) for kind, words in values.items() if kind != "ordinary" and words]
    for kind, words in labelled:
        scores = sorted(likelihood(models[kind], classes(w[:LONGEST])) for w in words)
        bars[kind] = scores[int(TAIL * len(scores))] - SLACK
    return {"models": models, "bars": bars}


def evidence(model: dict, value: str) -> float:
    """Nats by which the best automaton whose bar is met explains a value better than the background."""
    word = classes(value)
    plain = model["models"].get("ordinary")
    below = likelihood(plain, word) if plain else sum(_NOWHERE[c] for c in word) / (len(word) + 1)
    best = -math.inf
    for kind, bar in model["bars"].items():
        mark = likelihood(model["models"][kind], word)
        if mark >= bar:
            best = max(best, (mark - below) * (len(word) + 1))
    return best


def likely(model: dict, value: str) -> bool:
    return evidence(model, value) >= EVIDENCE


def secret_parts(model: dict, run: str) -> tuple[tuple[int, int], ...]:
    """(start, end) of the secrets in a run: the whole, else what is one of its coarsest parts."""
    for parts in parts_of(run):
        if found := tuple((at, at + len(part)) for at, part in parts if likely(model, part)):
            return found
    return ()


class Smallest:
    """The distinct values with the smallest hashes seen so far; of two of these the union is one again."""

    def __init__(self, size: int):
        self.size, self.bar, self.held = size, 1 << 64, {}

    def add(self, values: set[str]) -> None:
        for value in values:
            mark = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"))
            if mark < self.bar:
                self.held[value] = mark
        if len(self.held) > 4 * self.size:
            self.cut()

    def cut(self) -> dict[str, int]:
        best = sorted(self.held.items(), key=lambda x: x[1])[: self.size]
        self.held = dict(best)
        if len(best) == self.size:
            self.bar = best[-1][1] + 1
        return self.held


def credentials(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Bounded sample: at most ``sample`` distinct values of each kind reach the driver.

    A task passes on its own ``sample`` smallest hashes of each kind, which hold those of all.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {kind: Smallest(sample) for kind in (*KINDS[:3], "ordinary")}
        for rows in batches:
            found: dict[str, set] = {kind: set() for kind in kept}
            runs: set[str] = set()
            for text in rows.column(1):
                text = text.as_py()
                if not text:
                    continue
                base = base_spans(text)
                for _, kind, _, value in base:
                    found[KINDS[kind]].add(value[: LONGEST + 1])
                runs |= {run for _, run in runs_of(text, base)} if base else set(RUN.findall(text))
            found["ordinary"] = {part[: LONGEST + 1] for run in runs for parts in parts_of(run) for _, part in parts}
            for kind, values in found.items():
                kept[kind].add(values)
        rows = [(kind, value, mark) for kind, held in kept.items() for value, mark in held.cut().items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in rows], pa.string()), pa.array([v for _, v, _ in rows], pa.string()),
             pa.array([m - (1 << 63) for _, _, m in rows], pa.int64())],
            names=["kind", "value", "mark"],
        )

    every = materialise(documents(docs).mapInArrow(run, "kind string, value string, mark long").distinct(), "secrets-values")
    out: dict[str, list[str]] = {}
    for kind in (*KINDS[:3], "ordinary"):
        top = every.where(F.col("kind") == kind).orderBy("mark", "value").limit(sample)
        out[kind] = [r.value for r in top.select("value").collect()]
    return out


SPANS = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
     ("base_sha256", pa.string()), ("spans", pa.string())]
)


class Known:
    """Runs that were scored before, and the secrets in those that have any."""

    def __init__(self, model: dict):
        self.model, self.seen, self.secret = model, set(), {}

    def secrets(self, text: str, base: list) -> list[tuple[int, int, int]]:
        """Spans in ``text``: each different run is scored once, places are looked up for the rare hit."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.secret.clear()
        found = set(RUN.findall(text))
        for run in found - self.seen:
            if parts := secret_parts(self.model, run):
                self.secret[run] = parts
        self.seen |= found
        if found.isdisjoint(self.secret):
            return []
        return [(at + a, 3, at + b) for at, run in runs_of(text, base) for a, b in self.secret.get(run, ())]


def spans(text: str | None, known: Known) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans as (start, kind, end)."""
    text = text or ""
    base = base_spans(text)
    own = [(s, k, e) for s, k, e, _ in base]
    return own, sorted(own + (known.secrets(text, base) if known.model["bars"] else []))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every row."""
    model = model or learn(credentials(docs))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model)
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in SPANS}
            out["doc_id"] = rows.column(0)
            for text in rows.column(1).to_pylist():
                base, every = spans(text, known)
                for name, kind in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                    out[name].append(sum(k == kind for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            yield batch(SPANS, out)

    return documents(docs).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


MASK = "[secret]"


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(found):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked in ``text``; null text stays null.

    ``n_chars``, where there is one of a number type, follows a text that changes.
    """
    model = model or learn(credentials(docs))
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model)
        for rows in batches:
            columns, texts = list(rows.columns), rows.column(at).to_pylist()
            found = [[] if t is None else spans(t, known)[1] for t in texts]
            new = [masked(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                sizes = columns[size].to_pylist()
                columns[size] = pa.array(
                    [len(t) if f else n for t, f, n in zip(new, found, sizes, strict=True)], columns[size].type
                )
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)
