"""Personal data: exact patterns, and a skip-chain conditional random field for what they miss.

``base_spans`` finds emails, IP addresses, card and phone numbers by fixed patterns, leftmost
and without overlap within a kind. ``PiiModel`` labels every candidate of a document (the base
spans and other stretches that look like numbers, addresses or mail) as one of the kinds or
none. Candidates that follow each other share a chain potential; candidates that repeat (equal
digits, equal mail, or one ending in the other's last digits) or look alike (equal shape) share
a skip potential however far apart they are, each with the one before it. Loopy belief
propagation gives marginals with base spans held at their kind; a candidate is added where a
kind has more than ``SURE``. Base spans are never dropped.

The weights come from pseudo-likelihood on the candidates of about ``TRAIN_DOCS`` documents,
chosen by their content (``sample_by_content``), with ``TRAIN_NODES`` candidates of a document at most.
The base patterns label them, so features leave out what the patterns test (signs, dots, shape,
check digit): what is learned must hold for other notations too. Candidates that repeat a base
span are no evidence for none and left out. Next to each base span stand, in training, a repeat
of it in other surroundings, which has its label, and two mentions of a number of other digits,
which are none; from these and the real ones come the weights of repeats and of none.

Texts and candidates are read whole whatever their length. Of overlapping candidates the first
counts; ties between kinds go to the first kind listed. A null, empty or clean text has no spans;
repeated rows get equal results; an empty table gives an empty table. Columns of the result
that the input also has are replaced, all others are carried along.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, sample_by_content

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_NODES, FEATURES, SURE = 4000, 200, 1 << 12, 0.8
#: Where the weights of repeated and of similar candidates that agree start.
REPEATED, ALIKE = 2.0, 0.5
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, so looking behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20-]{4,}[0-9]")
_MAIL = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]++")
_WORD = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, done, seen = text.find("@"), 0, 0
    while at >= 0:
        before = text[max(done, seen) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _DOMAIN.match(text, at + 1) if local else None
        if host:
            out.append((0, at - local, host.end()))
            done = host.end()
        seen = at + 1
        at = text.find("@", max(seen, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(label, start, end) in order of position, 0 for none and kind + 1, with whether a base
    span holds it; of overlapping candidates that are not base spans only the first stays."""
    taken = sorted((s, e) for _, s, e in base)
    free: list[tuple[int, int]] = []
    found = [m.span() for m in _NUMBER.finditer(text) if len(_digits(m[0])) >= 7]
    found += [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    for s, e in sorted(found):
        k = int(np.searchsorted(starts, e)) if taken else 0
        if (not k or ends[k - 1] <= s) and (not free or free[-1][1] <= s):
            free.append((s, e))
    nodes = sorted([(k + 1, s, e) for k, s, e in base] + [(0, s, e) for s, e in free], key=lambda x: x[1:])
    return nodes, np.array([n[0] > 0 for n in nodes], bool)


def _shape(s: str) -> str:
    return re.sub(r"0{4,}", "0000", "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in s))


def _names(span: str, before: list[str], after: list[str]) -> list[int]:
    names = ["bias", f"digits {min(len(_digits(span)), 20)}", f"mail {'@' in span}", *(f"left {w.lower()}" for w in before), *(f"right {w.lower()}" for w in after)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def features(text: str, nodes: list[tuple[int, int, int]]) -> list[list[int]]:
    """Hashed features of each candidate: number of digits, and the words on both sides."""
    return [_names(text[s:e], _WORD.findall(text[max(0, s - 40) : s])[-2:], _WORD.findall(text[e : e + 40])[:1]) for _, s, e in nodes]


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, type): 0 chain, 1 repeated, 2 alike; at most four a candidate."""
    out, last = [], {}
    for j, (_, s, e) in enumerate(nodes):
        span = text[s:e]
        if j:
            out.append((j - 1, j, 0))
        d = _digits(span)
        keys = [(1, span.lower()) if "@" in span else (1, d)] + ([(1, f"end {d[-7:]}")] if "@" not in span and len(d) >= 7 else []) + [(2, _shape(span))]
        for key in keys:
            if key in last:
                out.append((last[key], j, key[0]))
            last[key] = j
    got = np.array(sorted(set(out)), np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


class PiiModel:
    """Weights of the field: features by label, chain potentials, and the two skip potentials."""

    def __init__(self):
        n = len(KINDS) + 1
        self.node, self.pair = np.zeros((FEATURES, n)), np.zeros((3, n, n))
        self.pair[1], self.pair[2] = REPEATED * np.eye(n), ALIKE * np.eye(n)

    def fit(self, sample: list[tuple[list[int], list[list[int]], list[list[int]]]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> PiiModel:
        """Pseudo-likelihood: each label given its neighbours' labels. ``sample`` holds documents
        as (labels, features, edges)."""
        y, rows, cols, i, j, t, base = [], [], [], [], [], [], 0
        for labels, feats, eds in sample:
            for k, f in enumerate(feats):
                rows += [base + k] * len(f)
                cols += f
            y += labels
            for a, b, c in eds:
                i.append(a + base)
                j.append(b + base)
                t.append(c)
            base += len(labels)
        if not y:
            return self
        y, rows, cols = np.array(y), np.array(rows), np.array(cols)
        a, b, t = np.array(i + j, np.int64), np.array(j + i, np.int64), np.array(t + t, np.int64)
        n = self.node.shape[1]
        truth, near = np.eye(n)[y], np.zeros((len(y), 3 * n))
        np.add.at(near, (a, t * n + y[b]), 1)
        g2n, g2p = np.full(self.node.shape, 1e-8), np.full((3 * n, n), 1e-8)
        for _ in range(rounds):
            logit = np.zeros((len(y), n))
            np.add.at(logit, rows, self.node[cols])
            logit += near @ self.pair.reshape(3 * n, n)
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            err = (truth - p / p.sum(axis=1, keepdims=True)) / len(y)
            gn = -decay * self.node
            np.add.at(gn, cols, err[rows])
            gp = near.T @ err
            g2n += gn * gn
            g2p += gp * gp
            self.node += rate * gn / np.sqrt(g2n)
            # potentials are symmetric; skips only reward agreement
            pair = (self.pair.reshape(3 * n, n) + rate * gp / np.sqrt(g2p)).reshape(3, n, n)
            pair = (pair + pair.transpose(0, 2, 1)) / 2
            for skip in (1, 2):
                pair[skip] = np.eye(n) * max(0.0, np.trace(pair[skip]) / n)
            self.pair = pair
        return self

    def marginals(self, feats: list[list[int]], eds, held: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
        """Loopy belief propagation, all messages at once."""
        unary = np.array([self.node[f].sum(axis=0) for f in feats])
        unary[held] = -50
        unary[held, labels[held]] = 0
        i, j, t = eds
        a, b, psi = np.concatenate((i, j)), np.concatenate((j, i)), np.exp(np.clip(self.pair, -20, 20))[np.concatenate((t, t))]
        back, msg = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i)))), np.zeros((len(a), unary.shape[1]))
        belief = unary
        for _ in range(rounds if len(a) else 0):
            belief = unary.copy()
            np.add.at(belief, b, msg)
            into = belief[a] - msg[back]
            new = np.log(np.einsum("eij,ei->ej", psi, np.exp(into - into.max(axis=1, keepdims=True))))
            new -= new.max(axis=1, keepdims=True)
            done = np.abs(new - msg).max() < 1e-4
            msg = 0.5 * msg + 0.5 * new
            if done:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        nodes, held = candidates(text, base)
        if held.all():
            return []
        labels = np.array([n[0] for n in nodes])
        p = self.marginals(features(text, nodes), edges(text, nodes), held, labels)
        best = p[:, 1:].argmax(axis=1)
        return [(int(best[k]), s, e) for k, (_, s, e) in enumerate(nodes) if not held[k] and p[k, 1 + best[k]] > SURE]


def training_nodes(text: str) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """(labels, features, edges) of a document as the field is trained on it."""
    nodes, held = candidates(text, base_spans(text))
    nodes, held = nodes[:TRAIN_NODES], held[:TRAIN_NODES]
    i, j, t = edges(text, nodes)
    unsure = {int(x) for a, b, c in zip(i, j, t) if c == 1 and held[a] != held[b] for x in (a, b) if not held[x]}
    place = {k: n for n, k in enumerate(k for k in range(len(nodes)) if k not in unsure)}
    labels, feats = [nodes[k][0] for k in place], features(text, [nodes[k] for k in place])
    links = [[place[a], place[b], int(c)] for a, b, c in zip(i.tolist(), j.tolist(), t) if a in place and b in place]
    words = _WORD.findall(text) or ["-"]
    for k in [n for k, n in place.items() if held[k]]:
        label, seed, at = labels[k], zlib.crc32(repr(feats[k]).encode()), len(labels)
        around = lambda m: ([words[(seed >> m) % len(words)], words[(seed >> m + 3) % len(words)]], [words[(seed >> m + 6) % len(words)]])
        span = "@" if label == 1 else "0" * sum(len(_digits(text[s:e])) for s, e in [nodes[list(place)[k]][1:]])
        other = "x@" if seed % 4 == 0 else "0" * (7 + seed % 14)
        labels += [label, 0, 0]
        feats += [_names(span, *around(0)), _names(other, *around(5)), _names(other, *around(11))]
        links += [[k, at, 1], [at + 1, at + 2, 1]]
    return labels, feats, links


def learn(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> PiiModel:
    """The model from documents that hold a digit or an at sign, about ``train_docs`` of them."""
    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("text"))
    some = sample_by_content(some, train_docs)
    kinds = T.StructType([T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("f", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("e", T.ArrayType(T.ArrayType(T.IntegerType())))])
    rows = map_text(some, "text", [], kinds, lambda: training_nodes).where("size(y) > 0").limit(2 * train_docs).collect()
    return PiiModel().fit(sorted((list(r["y"]), [list(f) for f in r["f"]], [list(e) for e in r["e"]]) for r in rows))


_KIND = T.StructType([T.StructField(n, T.LongType()) for n in ("kind", "start", "end")])
FIELDS = T.StructType([T.StructField("pii", T.ArrayType(_KIND)), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: PiiModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with pii (all spans), n_email, n_ip, n_card and n_phone (base
    spans), base_sha256 and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        field = shared.value

        def one(t):
            base = base_spans(t)
            every = sorted({*base, *(field.added(t, base) if t else [])})
            counts = [sum(k == x[0] for x in base) for k in range(len(KINDS))]
            return [dict(zip(("kind", "start", "end"), x)) for x in every], *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)

        return one

    return map_text(docs, text, [c for c in (keep or docs.columns) if c not in FIELDS.names], FIELDS, start)


def redact(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
            at = e
    return "".join([*out, text[at:]])
