"""Personal data: base patterns, and boosted trees over high-recall candidates (operator 10).

Base spans (email, ip, card, phone) are found by fixed patterns and always stay. Beside them,
generators with high recall propose further, possibly overlapping spans: numbers written like
phones or identity numbers, spelt-out addresses, keys and passwords. Gradient boosted trees over
the format of a span and the words before it score each candidate; the threshold of a kind is the
lowest score at which PRECISION holds on held-out examples. Of overlapping candidates the best
scored one is added, and only where no base span lies.

The trees are fitted on the driver on TRAIN_EXAMPLES examples per kind and class, drawn with a
fixed seed from written-out formats; the tables have no labels of personal data.

Defined results: null counts as empty; an empty text has no spans. Equal scores: the earlier, then
the longer span wins. Repeated rows repeat; any length is handled in time linear in the text; an
empty table gives an empty result. The added column is one struct whose name gives way to others.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm._shared import map_texts

KINDS = ("email", "ip", "card", "phone", "idnumber", "secret")
TRAIN_EXAMPLES = 400
PRECISION = 0.99

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The lookbehind only saves time: a match never begins inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


#: Generators of candidates; every part is bounded, gives nothing back or begins only where a run does, so each takes time linear in the text.
GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)+"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.,-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-][0-9]{2,5}(?![0-9A-Za-z]|[.,-][0-9])|(?<![0-9A-Za-z+.,-])[0-9]{2}(?:[ .-][0-9]{2}){3,5}(?![0-9A-Za-z]|[ .,-][0-9])"),
    "idnumber": re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])|(?<=[A-Za-z]=)[A-Za-z0-9_+/-]{8,}={0,2}(?![A-Za-z0-9_+/=-])"),
}
#: What a text must hold for any match of the kind; saves time only.
_NEEDS = {"email": re.compile("at"), "phone": re.compile("[0-9]"), "idnumber": re.compile("[0-9]"), "secret": re.compile("")}
_CUES = {
    "email": ("mail", "contact", "write"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "idnumber": ("ssn", "social", "iban", "account", "passport"), "secret": ("key", "token", "secret", "passw", "pwd", "api", "auth"),
}
FEATURES = 17


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    """Format and context of text[a:b] as a candidate of the kind."""
    span, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 2]
    n = len(span)
    digits, upper, lower = (sum(map(f, span)) for f in (str.isdigit, str.isupper, str.islower))
    counts = np.array([span.count(c) for c in sorted(set(span))]) / n
    bare = "".join(filter(str.isdigit, span))
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:]))
    return [
        KINDS.index(kind), n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, float(-(counts * np.log2(counts)).sum()), switches / n,
        any(c in before for c in _CUES[kind]), span.startswith("AKIA"), all(c in "0123456789abcdef" for c in span), len(bare),
        bool(re.match(r"(19|20)[0-9]{2}", span)), before.endswith("="), before.endswith(('"', "'")) and after.startswith(('"', "'")), span.count("-") + span.count(" "), span.startswith("0"),
    ]


def examples(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of TRAIN_EXAMPLES written-out examples per kind and class."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    digits, small, big = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick(small, int(rng.integers(2, 10)))
    one = lambda *options: options[int(rng.integers(len(options)))]
    pairs = lambda first, n: one(" ", ".", "-").join([first, *(pick(digits, 2) for _ in range(n))])
    camel = lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 5))))
    good = {
        "email": lambda: f"{word()}{one(' (at) ', '(at)', '[at]')}{word()}{one('.', '[dot]', ' (dot) ')}{one('com', 'org', 'net', 'de')}",
        "phone": lambda: one(f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", f"0049 {pick(digits, 3)} {pick(digits, 4)} {pick(digits, 4)}", pairs("0" + pick("123456789", 1), 4)),
        "idnumber": lambda: one(f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", f"DE{pick(digits, 2)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 2)}"),
        "secret": lambda: one("AKIA" + pick(big + "234567", 16), pick("0123456789abcdef", 40), pick("0123456789abcdef", int(rng.integers(16, 33))), pick(small + big + digits, int(rng.integers(20, 44))), one("AKIA" + pick(big, 16), pick(small + big + digits + "-_", int(rng.integers(60, 700))), camel())),
    }
    bad = {
        "email": lambda: f"{word()} (at) {word()}.{word()}{word()}",
        "phone": lambda: one(f"{one('19', '20')}{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", f"{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 3)}", pairs(pick("123456789", 1) + pick(digits, 1), int(rng.integers(3, 6)))),
        "idnumber": lambda: f"{pick(big, 2)}{pick(digits, 2)}{pick(big, 12)}",
        "secret": lambda: one(word() + word() + word() + word(), pick(big, int(rng.integers(16, 30))), f"{word()}-{word()}-{word()}-{word()}", f"{word()}/{word()}/{word()}/{word()}", pick(digits, int(rng.integers(16, 24))), word().capitalize() + word() + word() + word() + pick(digits, 1), one(camel(), pick("ACGT", int(rng.integers(16, 300)))), one(one(*"-_/+"), one(*small)) * int(rng.integers(16, 300))),
    }
    cues = {"email": ["contact ", "mail "], "phone": ["call ", "tel. ", "phone: "], "idnumber": ["ssn ", "iban "], "secret": ["api_key = \"", "password=", "token: ", "secret_key="]}
    x, y, kinds = [], [], []
    for kind in GENERATORS:
        for label, made in ((1, good), (0, bad)):
            for _ in range(TRAIN_EXAMPLES):
                cue = one(*cues[kind]) if rng.random() < (0.7 if label else 0.1) else word() + " "
                span = made[kind]()
                if kind == "secret" and label and span.isalpha() and not span.startswith("AKIA") and len(span) < 60:
                    cue = one("password=", "secret_key=")  # words are a secret only where they are called one
                end = '"' if cue.endswith('"') else " "
                x.append(features(kind, cue + span + end + word(), len(cue), len(cue) + len(span)))
                y.append(label)
                kinds.append(kind)
    return np.array(x, float), np.array(y, float), np.array(kinds)


class BoostedTrees:
    """Gradient boosting of small regression trees for the logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list = []

    def _grow(self, x, g, h, depth):
        value = -g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        if depth:
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
                ok = np.flatnonzero((v[1:] > v[:-1]) & (hs[:-1] * 4 >= self.least) & ((hs[-1] - hs[:-1]) * 4 >= self.least))
                if len(ok):
                    gain = gs[ok] ** 2 / (hs[ok] + 1) + (gs[-1] - gs[ok]) ** 2 / (hs[-1] - hs[ok] + 1) - base
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, (v[ok[k]] + v[ok[k] + 1]) / 2)
        if best[1] is None:
            return float(value)
        left = x[:, best[1]] <= best[2]
        return best[1], float(best[2]), self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1)

    def fit(self, x, y):
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(x, p - y, p * (1 - p), self.depth))
            score += self.rate * np.array([self._leaf(self.trees[-1], row) for row in x])
        return self

    @staticmethod
    def _leaf(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return float(1 / (1 + np.exp(-self.rate * sum(self._leaf(t, row) for t in self.trees))))


@lru_cache(1)
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """The fitted trees and each kind's calibrated threshold."""
    x, y, _ = examples(11)
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = examples(12)
    scores = np.array([trees.score(row) for row in x])
    limits = {}
    for kind in GENERATORS:
        s, t = scores[kinds == kind], y[kinds == kind]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(s[order][good[-1]])) if len(good) else 2.0
    return trees, limits


def added_spans(text: str, base: list[tuple[str, int, int]], fitted) -> list[tuple[str, int, int]]:
    trees, limits = fitted
    proposed = []
    for kind, pattern in GENERATORS.items():
        if not _NEEDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            score = trees.score(features(kind, text, *m.span()))
            if score >= limits[kind]:
                proposed.append((-score, m.start(), -m.end(), kind))
    taken, out = [(a, b) for _, a, b in base], []
    for _, a, b, kind in sorted(proposed):
        if all(-b <= c or d <= a for c, d in taken):
            taken.append((a, -b))
            out.append((kind, a, -b))
    return out


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def finder(fitted):
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base = base_spans(text or "")
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added_spans(text or "", base, fitted))))
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)], names)

    return run


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, overlapping ones together, replaced by [KIND] of the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; null stays null."""
    fitted = model()

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            base = base_spans(x or "")
            out.append(x if x is None else redact_text(x, base + added_spans(x, base, fitted)))
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["t"])

    others = [c for c in docs.columns if c != text]
    return map_texts(docs, text, others, run, f"`{text}` string").select(*[f"`{c}`" for c in docs.columns])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return map_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"], finder(model()), FOUND)
