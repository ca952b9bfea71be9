"""Credentials in texts: fixed patterns, and formats learnt from what they find.

Method: grammar inference.  The credentials that the patterns label are the
positive examples.  For each kind a prefix tree of its examples (over classes of
characters) is made, and states whose outgoing frequencies agree by Hoeffding's
bound are merged, recursively and in breadth-first order, into a probabilistic
automaton (Alergia).  Every run of credential characters that no pattern covers
is a candidate, of 16 characters or as few as an automaton's shortest example
has; it is a span of kind `format` if its mean log-likelihood a character under
some automaton is at least that automaton's threshold, the lowest of its own
examples' less a margin.
"""

import hashlib
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.llm.workspace import Table

# The patterns of the contract
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = r"[A-Za-z0-9+/_.=-]{%d,}"

#: Candidates of so many characters are scored by every automaton, shorter ones by those with an example as short.
CANDIDATE_CHARS = 16

#: Examples of a kind that an automaton is learnt from at most, by the hash of their text.
EXAMPLES = 400
#: Longest examples that are learnt from: an automaton has a state for each of their characters at most.
EXAMPLE_CHARS = 256
ALPHA = 0.05
MARGIN = 0.1
_CLASSES = {**dict.fromkeys("0123456789", 0), **dict.fromkeys("abcdef", 1), **dict.fromkeys("ghijklmnopqrstuvwxyz", 2), **dict.fromkeys("ABCDEF", 3), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", 4), **{c: 5 + i for i, c in enumerate("+/_.=-")}}
_WEIGHT = [10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1]
_NEVER = 1e-4


def base_spans(text):
    """(start, kind number, end) of the patterns' matches: leftmost, non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of such letters is one match, so short runs needn't be visited
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def credential(text, span):
    """The credential itself of a span: the value of an assignment, else all of it."""
    return ASSIGN.match(text, span[0])[2] if span[1] == 0 else text[span[0] : span[2]]


class Automaton:
    """A probabilistic automaton over classes of characters."""

    def __init__(self, examples):
        self.count, self.end, self.next = [0], [0], [{}]
        for x in examples:
            state = 0
            self.count[0] += 1
            for c in x:
                k = _CLASSES[c]
                if k not in self.next[state]:
                    self.next[state][k] = [len(self.count), 0]
                    self.count.append(0), self.end.append(0), self.next.append({})
                arc = self.next[state][k]
                arc[1] += 1
                state = arc[0]
                self.count[state] += 1
            self.end[state] += 1
        self._merge()
        reached, todo = {0}, [0]
        while todo:
            todo += [arc[0] for arc in self.next[todo.pop()].values() if arc[0] not in reached and not reached.add(arc[0])]
        self.states = len(reached)
        self.threshold = min(map(self.score, examples)) - MARGIN
        self.least = min(CANDIDATE_CHARS, *map(len, examples))

    def _agree(self, a, b):
        """Whether two states' futures agree, down both trees."""
        todo = [(a, b)]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > limit:
                return False
            for k in set(self.next[a]) | set(self.next[b]):
                x, y = self.next[a].get(k), self.next[b].get(k)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > limit:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a, b):
        """Adds the tree of b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            for k, (to, n) in self.next[b].items():
                if k in self.next[a]:
                    self.next[a][k][1] += n
                    if self.next[a][k][0] != to:
                        todo.append((self.next[a][k][0], to))
                else:
                    self.next[a][k] = [to, n]

    def _merge(self):
        red, blue = [0], deque((0, k) for k in sorted(self.next[0]))
        while blue:
            parent, k = blue.popleft()
            state = self.next[parent][k][0]
            if state in red:
                continue
            for r in red:
                if self._agree(r, state):
                    self.next[parent][k][0] = r
                    self._fold(r, state)
                    # arcs that r took over lead to new states
                    blue.extend((q, j) for q in red for j in sorted(self.next[q]) if self.next[q][j][0] not in red and (q, j) not in blue)
                    break
            else:
                red.append(state)
                blue.extend((state, j) for j in sorted(self.next[state]))

    def score(self, x):
        """Mean log-likelihood of a character, with that of the end."""
        state, total = 0, 0.0
        for c in x:
            k = _CLASSES[c]
            arc = self.next[state].get(k)
            if arc is None or not self.count[state]:
                total += math.log(_NEVER)
                continue
            total += math.log(max(arc[1] / self.count[state], _NEVER) / _WEIGHT[k])
            state = arc[0]
        total += math.log(max(self.end[state] / max(self.count[state], 1), _NEVER))
        return total / (len(x) + 1)


def examples(docs):
    """{kind: examples}: of all credentials of up to EXAMPLE_CHARS that the patterns find in docs (text), EXAMPLES by hash for each kind."""

    def label(batches):
        for batch in batches:
            out = set()
            for x in batch.column(0).to_pylist():
                if x:
                    out.update((KINDS[s[1]], v) for s in base_spans(x) if len(v := credential(x, s)) <= EXAMPLE_CHARS)
            yield pa.record_batch([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], ["kind", "value"])

    written = Table(docs.select("text").mapInArrow(label, "kind string, value string").distinct())
    found, table = written.df, {}
    for kind in KINDS[:3]:
        rows = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(EXAMPLES).collect()
        table[kind] = sorted(r["value"] for r in rows)
    written.drop()
    return table


def learnt(labelled):
    """Automata of the kinds that have an example."""
    return [Automaton(x) for _, x in sorted(labelled.items()) if x]


def spans(text, automata):
    """All spans of a text, (start, kind number, end)."""
    base = base_spans(text)
    if not automata:
        return base
    out, k, least = list(base), 0, min(p.least for p in automata)
    reach = []
    for a, _, b in sorted(base):  # what the patterns cover, as disjoint ranges
        if reach and a <= reach[-1][1]:
            reach[-1][1] = max(b, reach[-1][1])
        else:
            reach.append([a, b])
    for m in re.finditer(CANDIDATE % least, text):
        a, end = m.span()
        while k < len(reach) and reach[k][1] <= a:
            k += 1
        # the run without what the patterns cover
        j = k
        while a < end:
            x, y = reach[j] if j < len(reach) and reach[j][0] < end else (end, end)
            if x - a >= least and any(x - a >= p.least and p.score(text[a:x]) >= p.threshold for p in automata):
                out.append((a, 3, x))
            a, j = y, j + 1
    return sorted(out)


def scanned(docs, automata=None):
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) of every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind.  Null text counts as empty; a repeated row gives its own row; other
    columns are ignored; an empty table stays empty, and without examples
    nothing is added to the patterns' spans.
    """
    automata = learnt(examples(docs)) if automata is None else automata
    sent = docs.sparkSession.sparkContext.broadcast(automata)

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for x in part.column(1).to_pylist():
                    found = spans(x, sent.value) if x else []
                    text = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                    base = ",".join(t for t, (_, k, _) in zip(text, found, strict=True) if k < 3)
                    counts = [sum(k == j for _, k, _ in found) for j in range(4)]
                    rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(text)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
