"""Personal data: fixed patterns, and candidates judged by boosted trees."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import map_slices, text_of

SLICE_CHARS = 1_000_000
#: Documents whose candidates the trees are fitted on, chosen by a hash of their ids, and
#: the most candidates that enter the fit.
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 30_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
#: Share of right decisions that the threshold must reach on candidates held out.
PRECISION = 0.95

KINDS = ("email", "ip", "card", "phone", "secret", "contact", "number")
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from its middle too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators of further candidates: they overlap, and find much that is no personal data.
#: All but the spelled-out addresses need a digit in the text.
GENERATORS = {
    "secret": [re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}(?![A-Za-z0-9+/_-])")],
    "contact": [re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")],
    "number": [re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){6,24}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{26,}+"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}\b")],
}
SPELLED = re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64} ?[\[( ](?:at|@)[\]) ] ?[a-z0-9-]{2,64}(?: ?[\[( ]dot[\]) ] ?|\.)[a-z]{2,24}\b")
SPELLED_HINT = re.compile(r"(?i)[\[( ]dot[\]) ]|[\[( ]@[\]) ]|[\[(]at[\])]")
ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|key|auth)[\"']?\s*[=:]\s*[\"']?$")
WORDS_AROUND = re.compile(r"(?i)\b(?:call|tel|phone|fax|mobile|card|visa|account|iban|ssn|id|mail|contact|version|licen[sc]ed?|isbn|page|key|token|password|secret|login|user)\b")
#: Words right before a telephone or an identity number, and before other numbers.
CALLED = re.compile(r"(?i)\b(?:call|tel|telephone|phone|fax|mobile|cell)\b[^0-9\n]{0,20}$")
HELD = re.compile(r"(?i)\b(?:ssn|social security|account|acct|iban|passport|tax id)\b[^0-9\n]{0,20}$")
PLAIN = re.compile(r"(?i)\b(?:version|licen[sc]ed?|isbn|page|order|part)\b[^0-9\n]{0,20}$")
CONTEXT = 40
#: Held-out candidates from which a kind has a threshold of its own.
CALIBRATE = 20


def digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def luhn(text: str) -> bool:
    total = 0
    for place, char in enumerate(reversed([c for c in text if c in "0123456789"])):
        n = int(char) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: every sign is tried once, so the search is linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for found in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.group().split("."))):
            out.append((found.start(), 1, found.end()))
    for found in CARD.finditer(text):
        if found.end() - found.start() >= 14 and 14 <= digits(found.group()) <= 19 and luhn(found.group()):
            out.append((found.start(), 2, found.end()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 10 <= digits(found.group()) <= 15:
                out.append((found.start(), 3, found.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and all further candidates, overlapping ones too."""
    out = set(base)
    if SPELLED_HINT.search(text):
        out.update((m.start(), KINDS.index("contact"), m.end()) for m in SPELLED.finditer(text))
    if any(d in text for d in "0123456789"):
        for name, patterns in GENERATORS.items():
            kind = KINDS.index(name)
            for found in (m for pattern in patterns for m in pattern.finditer(text)):
                # A long word without a digit is prose.
                if name != "secret" or digits(found.group()):
                    out.add((found.start(), kind, found.end()))
    return sorted(out)


def entropy(text: str) -> float:
    counts = np.array([text.count(c) for c in set(text)], dtype=np.float64) / len(text)
    return float(-(counts * np.log2(counts)).sum())


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a candidate; neither a check digit nor a range is looked at."""
    word, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    size = len(word)
    groups = [len(g) for g in re.findall(r"[0-9]+", word)] or [0]
    return [
        float(kind), float(size), digits(word) / size, float(digits(word)),
        sum(c.isupper() for c in word) / size, sum(c.islower() for c in word) / size,
        float(word.count(" ")), float(word.count("-")), float(word.count(".")), float(word.count("@")), float(word.count("+")),
        float(len(groups)), float(max(groups)), float(min(groups)), entropy(word),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:]))) / size,
        float(bool(ASSIGNED.search(before))), float(bool(WORDS_AROUND.search(before))), float(bool(WORDS_AROUND.search(after))),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(digits(before)), float(digits(after)),
        float("@" in after or "@" in before),
    ]


def weak_label(text: str, start: int, kind: int, end: int) -> int:
    """What rules alone are sure of: a base span is personal data; so is an assigned value
    or an access key of high entropy, and a number that is named as a telephone or an identity
    number. Numbers in groups that nothing names are not sure, which is -1."""
    if kind < len(BASE):
        return 1
    word, before = text[start:end], text[max(0, start - CONTEXT) : start]
    if KINDS[kind] == "secret":
        strong = digits(word) >= 3 and entropy(word) >= 2.8
        return int(strong and (bool(ASSIGNED.search(before)) or re.fullmatch(r"A[KS]IA[0-9A-Z]{16}", word) is not None or (len(word) >= 24 and digits(word) >= 6)))
    if KINDS[kind] == "contact" and ("@" in word or re.search(r"(?i)\bat\b.*\bdot\b", word)) or re.match(r"[A-Z]{2}[0-9]{2}", word):
        return 1
    if PLAIN.search(before):
        return 0
    if (CALLED if KINDS[kind] == "contact" else HELD).search(before):
        return 1
    return -1 if KINDS[kind] == "contact" or re.search("[ -]", word) else 0


@dataclass
class Trees:
    """Gradient boosting over binned features, with a calibrated threshold."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    thresholds: dict[int, float] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Second-order boosting of the logistic loss; every third row calibrates."""
        held = np.arange(len(y)) % 3 == 0
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins, target = self.binned(x[~held]), y[~held]
        rate = np.clip(target.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score, inner = np.full(len(target), self.start), 2**DEPTH - 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = target - p, p * (1 - p) + 1e-9
            feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1), np.zeros(len(target), dtype=np.int64)
            for level in range(DEPTH):
                base = 2**level - 1
                best = np.full(2**level, 1e-9)
                local = node - base
                for f in range(bins.shape[1]):
                    cell = local * (BINS + 1) + bins[:, f]
                    sums = [np.bincount(cell, w, 2**level * (BINS + 1)).reshape(2**level, BINS + 1).cumsum(axis=1) for w in (g, h)]
                    all_g, all_h = sums[0][:, -1:], sums[1][:, -1:]
                    gain = sums[0] ** 2 / (sums[1] + 1) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + 1) - all_g**2 / (all_h + 1)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(2**level), at]
                    better = top > best
                    best[better] = top[better]
                    feature[base : base + 2**level][better], cut[base : base + 2**level][better] = f, at[better]
                node = 2 * node + 1 + (bins[np.arange(len(node)), feature[node]] > cut[node])
            leaf = node - inner
            value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        raw, truth = self.raw(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            w = p * (1 - p)
            g = np.array([((truth - p) * raw).sum() - (a - 1), (truth - p).sum() - b])
            hess = np.array([[(w * raw**2).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
            move = np.clip(np.linalg.solve(hess, g), -1, 1)
            a, b = a + move[0], b + move[1]
        self.curve = (max(float(a), 0.05), float(b))
        self.threshold = lowest(self.probability(x[held]), truth)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A threshold for each kind with enough of the candidates that ``fit`` held out."""
        held = np.arange(len(y)) % 3 == 0
        kinds, p, truth = x[held, 0].astype(int), self.probability(x[held]), y[held]
        for kind in range(len(BASE), len(KINDS)):
            own = kinds == kind
            if own.sum() >= CALIBRATE:
                self.thresholds[kind] = lowest(p[own], truth[own])

    def limit(self, kind: int) -> float:
        return self.thresholds.get(kind, self.threshold)


def lowest(p: np.ndarray, truth: np.ndarray) -> float:
    """The probability from which ``PRECISION`` of the candidates are right."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    return float(np.clip(p[order[enough[-1]]], 0.5, 0.99)) if len(enough) else 0.99


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Trees:
    """Trees fitted on the candidates of at most ``sample_docs`` documents.

    The ids are chosen first and broadcast (``sample_docs`` numbers); only features of
    candidates, ``sample_candidates`` at most, come to the driver. With fewer than 50
    candidates, or one label only, no candidate beyond the base spans is ever taken.
    """
    chosen = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    slim = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows = [], []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for start, kind, end in candidates(text, base_spans(text)):
                label = weak_label(text, start, kind, end)
                if label >= 0:
                    keys.append(f"{at}:{start}:{kind}:{end}")
                    rows.append([*features(text, start, kind, end), float(label)])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "x"])

    rows = (
        map_slices(slim.join(F.broadcast(chosen), "_id").select("_id", "text"), "text", SLICE_CHARS, "key string, x array<double>", work)
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample_candidates)
        .collect()
    )
    trees = Trees(threshold=2.0)
    table = np.array([r["x"] for r in rows], dtype=np.float64)
    if len(table) >= 50 and len(np.unique(table[:, -1])) == 2:
        trees.fit(table[:, :-1], table[:, -1])
        trees.calibrate(table[:, :-1], table[:, -1])
    return trees


def all_spans(text: str, trees: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): a further candidate is taken if its probability reaches the
    threshold and it meets no base span and no more probable one."""
    base = base_spans(text)
    if trees.threshold > 1 or not trees.trees:
        return base, base
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, _, b in base] or [0])
    more = []
    for c in candidates(text, base):
        at = bisect.bisect_left(starts, c[2])
        if c[1] >= len(BASE) and not (at and reach[at - 1] > c[0]):
            more.append(c)
    if not more:
        return base, base
    p = trees.probability(np.array([features(text, *c) for c in more]))
    taken: list[tuple[int, int, int]] = []  # apart from each other, by start
    for i in sorted(range(len(more)), key=lambda i: (-p[i], more[i])):
        if p[i] < trees.limit(more[i][1]):
            continue
        at = bisect.bisect_left(taken, (more[i][2],))
        if not (at and taken[at - 1][2] > more[i][0]):
            taken.insert(at, more[i])
    return base, sorted([*base, *taken])


def find_pii(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: lists of (kind, start, end) in code points, by
    start, then kind, then end.

    ``base`` are the fixed patterns, ``spans`` adds what the trees select. A null or empty
    text has none; repeated rows repeat; other columns do not matter. Row by row in Arrow
    slices, without a shuffle; the trees are a few thousand numbers.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [all_spans(text, trees) for text in batch.column(1).to_pylist()]
        lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in pair[i]] for pair in both], pa.list_(span)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_slices(slim, "text", SLICE_CHARS, f"doc_id {kind}, base {item}, spans {item}", work)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the
    first names the place."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
