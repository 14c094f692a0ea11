"""Personal data by a skip-chain conditional random field.

Fixed patterns find the base spans.  Tokens with a digit or ``@`` are the nodes of a random
field; neighbours are tied in a chain, and repeated or similar tokens (the same characters,
or the same digits in another layout), however far apart in the document, share a potential.
Loopy message passing lets what is known of one mention decide about the others.  Weights
are fitted by pseudo-likelihood to the base spans of a bounded sample of documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.llm.common import with_text_key
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none of them
#: Documents with candidate tokens that the weights are fitted to, at most; in the order of a hash.
MAX_SAMPLE = 2_000
SWEEPS, DAMPING, SURE, CLAMP = 12, 0.3, 0.7, 30.0
CHAIN_GAP = 2
SAME_DIGITS = 7

# Fixed patterns, as the base spans are defined.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
SOMETHING = re.compile(r"[0-9@]")
EDGE = "\"'()[]{}<>,;:!?*#$%&|"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each ``@`` with a domain, and all local-part characters before it that no match has taken."""
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; kinds as in ``KINDS``."""
    if not SOMETHING.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@dataclass
class Graph:
    """Base spans and other candidate tokens of documents: features, spans, labels (0: no base span), and edges (kind 0: chain, 1: skip)."""

    features: np.ndarray
    spans: list[tuple[int, int, int]]  # document, start, end
    labels: np.ndarray
    edges: np.ndarray


def token_features(core: str) -> list[float]:
    digits = sum(c.isdigit() for c in core)
    dots = core.count(".")
    steps = [digits >= n for n in (1, 2, 4, 7, 10, 13, 14, 17, 20)]
    marks = ["@" in core, core[:1] == "+", "-" in core, "=" in core, any(c.isalpha() for c in core), len(core) > 24]
    return [1.0, *map(float, steps), *map(float, marks), *(float(dots == n) for n in (0, 1, 2, 3)), float(dots > 3)]


FEATURES = len(token_features("0"))


def build_graph(texts: list[str], found: list[list[tuple[int, int, int]]]) -> Graph:
    features, spans, labels, edges = [], [], [], []
    for d, (text, base) in enumerate(zip(texts, found)):
        last, gap_from, k, last_of = None, 0, 0, {}
        if not SOMETHING.search(text):
            continue
        for m in CANDIDATE.finditer(text):
            token = m[0]
            core = token.strip(EDGE).rstrip(".")
            if not core:
                continue
            start = m.start() + token.index(core)
            end = start + len(core)
            while k < len(base) and base[k][2] <= start:
                k += 1
            cover = base[k] if k < len(base) and base[k][0] < end else None
            if cover:  # all tokens of a base span are one node
                start, _, end = cover
                if last is not None and spans[last] == (d, start, end):
                    continue
                core = text[start:end]
            node = len(spans)
            features.append(token_features(core))
            spans.append((d, start, end))
            labels.append(cover[1] + 1 if cover else 0)
            if last is not None and text.count(" ", gap_from, start) <= CHAIN_GAP and start - gap_from < 64:
                edges.append((last, node, 0))
            digits = re.sub(r"[^0-9]", "", core)
            for key in {core.lower(), digits if len(digits) >= SAME_DIGITS else core.lower()}:
                if key in last_of and last_of[key] != node:
                    edges.append((last_of[key], node, 1))  # a chain of mentions: edges grow with the mentions, not their pairs
                last_of[key] = node
            last, gap_from = node, end
    return Graph(
        np.array(features, dtype=float).reshape(-1, FEATURES),
        spans,
        np.array(labels, dtype=int),
        np.array(sorted(set(edges)), dtype=int).reshape(-1, 3),
    )


@dataclass
class Weights:
    unary: np.ndarray  # feature x label
    pair: np.ndarray  # edge kind x label x label, symmetric


def neighbour_counts(graph: Graph) -> np.ndarray:
    """Labels of the neighbours of each node, by edge kind: node x (kind, label)."""
    counts = np.zeros((len(graph.labels), 2, LABELS))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(counts, (graph.edges[:, a], graph.edges[:, 2], graph.labels[graph.edges[:, b]]), 1.0)
    return counts.reshape(len(graph.labels), 2 * LABELS)


def fit_weights(graph: Graph, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Weights:
    """Maximum pseudo-likelihood by gradient steps with moments; without nodes all weights are 0."""
    n = len(graph.labels)
    if not n:
        return Weights(np.zeros((FEATURES, LABELS)), np.zeros((2, LABELS, LABELS)))
    around, blind = neighbour_counts(graph), np.zeros_like(graph.features)
    blind[:, 0] = 1.0
    # each node twice, once without its own look, so that potentials of edges are learned beside strong features
    x = np.vstack([np.hstack([graph.features, around]), np.hstack([blind, around])])
    y = np.tile(np.eye(LABELS)[graph.labels], (2, 1))
    w, m, v = np.zeros((x.shape[1], LABELS)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    pair = w[FEATURES:].reshape(2, LABELS, LABELS)
    return Weights(w[:FEATURES], (pair + pair.transpose(0, 2, 1)) / 2)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(graph: Graph, weights: Weights, sweeps: int = SWEEPS) -> np.ndarray:
    """Label probabilities of each node by loopy message passing; nodes in base spans are held at their label."""
    own = graph.features @ weights.unary
    own[np.flatnonzero(graph.labels), graph.labels[graph.labels > 0]] += CLAMP
    n_edges = len(graph.edges)
    if n_edges:
        source = np.concatenate([graph.edges[:, 0], graph.edges[:, 1]])
        target = np.concatenate([graph.edges[:, 1], graph.edges[:, 0]])
        back = np.concatenate([np.arange(n_edges, 2 * n_edges), np.arange(n_edges)])
        pair = weights.pair[np.tile(graph.edges[:, 2], 2)]
        sent = np.zeros((2 * n_edges, LABELS))
        for _ in range(sweeps):
            belief = own.copy()
            np.add.at(belief, target, sent)
            fresh = log_sum((belief[source] - sent[back])[:, :, None] + pair, axis=1)
            fresh -= log_sum(fresh, axis=1)[:, None]
            sent = DAMPING * sent + (1 - DAMPING) * fresh
        np.add.at(own, target, sent)
    return np.exp(own - log_sum(own, axis=1)[:, None])


def added_spans(graph: Graph, weights: Weights, sure: float = SURE) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of tokens outside base spans that the field is sure of, by document."""
    out: dict[int, list] = {}
    if len(graph.labels):
        p = marginals(graph, weights)
        best = p.argmax(axis=1)
        for k in np.flatnonzero((graph.labels == 0) & (best > 0) & (p.max(axis=1) >= sure)):
            d, start, end = graph.spans[k]
            out.setdefault(d, []).append((start, int(best[k]) - 1, end))
    return out


def _sample(batches):
    """Graph parts of the sample, a row per batch."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        g = build_graph(texts, [base_spans(t) for t in texts])
        columns = [g.features.ravel(), g.labels, g.edges.ravel()]
        kinds = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=["features", "labels", "edges"])


def fit_field(keyed: DataFrame, most: int = MAX_SAMPLE) -> Weights:
    """Weights from at most ``most`` documents that have candidate tokens, in the order of a hash of id and text."""
    order = F.xxhash64("doc_id", "text_key", F.lit(17))
    chosen = keyed.filter(F.col("text").rlike("[0-9@]")).select("text_key", order.alias("o")).orderBy("o", "text_key").limit(most)
    sample = keyed.join(measured(chosen.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
    parts = sample.select("text").mapInArrow(_sample, "features array<double>, labels array<long>, edges array<long>").collect()
    features, labels, edges, n = [], [], [], 0
    for p in parts:
        features.append(np.array(p["features"], dtype=float).reshape(-1, FEATURES))
        labels.append(np.array(p["labels"], dtype=int))
        e = np.array(p["edges"], dtype=int).reshape(-1, 3)
        edges.append(e + np.array([n, n, 0]))
        n += len(labels[-1])
    if not n:
        return fit_weights(build_graph([], []))
    order = np.lexsort(np.vstack(features).T[::-1])  # the fit does not depend on how rows came in, but for rounding
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n)
    joined = np.vstack(edges)
    joined[:, :2] = place[joined[:, :2]]
    return fit_weights(Graph(np.vstack(features)[order], [], np.concatenate(labels)[order], joined))


def _find(shared):
    def run(batches):
        weights = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(build_graph(texts, base), weights)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            every = [as_text(sorted(b + more.get(d, []))) for d, b in enumerate(base)]
            columns = [
                batch.column("doc_id"), *counts, pa.array([len(more.get(d, [])) for d in range(len(base))], pa.int64()),
                pa.array([as_text(b) for b in base], pa.string()), pa.array(every, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans.

    The counts are of base spans; ``n_added`` counts what the field adds.  ``base`` and
    ``spans`` list kind:start:end in code points, end exclusive, by start and kind.  Added
    spans never overlap base ones.  Null and empty texts have no spans.  Null ids and repeated
    rows come back as they are; a document's result depends on its text and the weights only.
    An empty table gives no rows; other columns are not read.  Fits the weights in a job when
    called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = with_text_key(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit_field(keyed, most))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, n_added long, base string, spans string"
    return keyed.select("doc_id", "text").mapInArrow(_find(shared), schema)
