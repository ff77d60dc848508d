"""License scans: matching statistics over a generalised suffix automaton, chained to template spans."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without
from siftlake.llm.license_texts import TEMPLATES
from siftlake.llm.words import word_blocks

# Phrases of the base, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Words of a match that counts for a chain, words between matches of one chain, share of a template for a label.
MIN_MATCH, MAX_GAP, MIN_SHARE = 3, 6, 0.6
#: What a base phrase alone scores.
PHRASE_SCORE = 0.5
OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]
SPAN = "struct<label:string,template:int,first_word:long,last_word:long,covered:long,share:double>"


class Automaton:
    """Suffix automaton of several token sequences, with the ends of every state in every sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, list[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                while len(ends) < len(self.next):
                    ends.append({})
                ends[last].setdefault(number, []).append(at)
        # A state ends wherever the states that link to it do.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, places in ends[state].items():
                up = ends[self.link[state]].setdefault(number, [])
                up.extend(places)
        self.ends = [{n: sorted(set(p)) for n, p in e.items()} for e in ends]

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _copy(self, source: int, length: int) -> int:
        new = self._add(length)
        self.next[new] = dict(self.next[source])
        self.link[new] = self.link[source]
        return new

    def _redirect(self, state: int, token: int, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(token) == old:
            self.next[state][token] = new
            state = self.link[state]

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            new = self._copy(known, self.length[last] + 1)
            self.link[known] = new
            self._redirect(last, token, known, new)
            return new
        new = self._add(self.length[last] + 1)
        state = last
        while state != -1 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state != -1:
            below = self.next[state][token]
            if self.length[below] == self.length[state] + 1:
                self.link[new] = below
            else:
                twin = self._copy(below, self.length[state] + 1)
                self.link[below] = self.link[new] = twin
                self._redirect(state, token, below, twin)
        return new

    def suffixes(self, state: int):
        """The state and those of its shorter suffixes."""
        while state > 0:
            yield state
            state = self.link[state]


class Scanner:
    """Templates and phrases, ready for texts; one for each task."""

    def __init__(self, templates, phrases, min_match=MIN_MATCH, max_gap=MAX_GAP, min_share=MIN_SHARE):
        tokens = [[w for ws in word_blocks(text.encode()) for w in ws] for _, text in templates]
        spoken = [[w for ws in word_blocks(text.encode()) for w in ws] for text, _ in phrases]
        self.vocabulary: dict[bytes, int] = {}
        for sequence in (*tokens, *spoken):
            for w in sequence:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in tokens]
        self.max_gap, self.min_share = max_gap, min_share
        self.phrase_labels = [label for _, label in phrases]
        coded = [[self.vocabulary[w] for w in s] for s in (*tokens, *spoken)]
        self.automaton = Automaton(coded)
        n, a = len(templates), self.automaton
        #: Phrases that end where a state does, with the words that must match: (words, phrase).
        self.said: list[tuple[tuple[int, int], ...]] = []
        #: Templates that the longest matching suffixes of a state belong to: (template, longest match there, ends).
        self.held: list[tuple[tuple[int, int, list[int]], ...]] = []
        for state in range(len(a.next)):
            said, held, seen = [], [], set()
            for s in a.suffixes(state):
                for number, places in a.ends[s].items():
                    if number >= n and len(spoken[number - n]) - 1 in places:
                        size = len(spoken[number - n])
                        if a.length[a.link[s]] < size <= a.length[s]:
                            said.append((size, number - n))
                    if number < n and number not in seen and a.length[s] >= min_match:
                        seen.add(number)
                        held.append((number, a.length[s], places))
            self.said.append(tuple(said))
            self.held.append(tuple(held))
        self.min_match = min_match

    def scan(self, text: bytes | None):
        """(words, base places, first, last, base labels, spans) of a text; words stream through in blocks."""
        a = self.automaton
        step, link, length, held, said = a.next, a.link, a.length, self.held, self.said
        get, least = self.vocabulary.get, self.min_match
        count = n_base = 0
        first = last = None
        base: set[str] = set()
        state = size = 0
        running: dict[int, tuple[int, list[int]]] = {}
        chains: dict[int, _Chain] = {}

        def ended(at: int, now: dict[int, tuple[int, list[int]]]) -> None:
            """Matches that don't grow by the word at `at` are maximal."""
            for number, (n, places) in running.items():
                if number not in now or now[number][0] != n + 1:
                    if number not in chains:
                        chains[number] = _Chain(self.sizes[number], self.max_gap, self.min_share)
                    chains[number].add(at - 1, n, places)

        for words in word_blocks(text):
            for at, token in enumerate(map(get, words), count):
                if token is None:
                    if state:
                        if running:
                            ended(at, {})
                            running = {}
                        state = size = 0
                    continue
                to = step[state].get(token)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = step[state].get(token)
                if to is None:
                    state = size = 0
                else:
                    state, size = to, size + 1
                if said[state]:
                    for n, number in said[state]:
                        if n <= size:
                            start = at - n + 1
                            n_base += 1
                            first = start if first is None else min(first, start)
                            last = start if last is None else max(last, start)
                            base.add(self.phrase_labels[number])
                if running or size >= least:
                    now = {t: (min(size, n), places) for t, n, places in held[state] if size >= least}
                    ended(at, now)
                    running = now
            count += len(words)
        ended(count, {})
        spans = [
            (self.labels[t], t, s, e, covered, covered / self.sizes[t])
            for t, chain in sorted(chains.items())
            for s, e, covered in chain.spans()
        ]
        return count, n_base, first, last, base, spans


class _Chain:
    """Chains of maximal matches of one template, in order of the text.

    A node is a match that ends at one place of the template. Its value is the number of template words covered by the best
    chain up to it: neighbours go forward in text and template and leave at most `gap` words out in either.
    """

    def __init__(self, size: int, gap: int, share: float):
        self.gap, self.least = gap, share * size
        self.open: deque = deque()
        self.found: list[tuple[int, int, int]] = []

    def add(self, end: int, n: int, places: list[int]) -> None:
        start = end - n + 1
        while self.open and self.open[0][0] < start - self.gap - 1:
            self._close(self.open.popleft())
        nodes = []
        for place in places:
            covered, begin, before = n, start, None
            for node in self.open:
                e, p, value, s, _ = node
                if e < end and p < place and place - n - p <= self.gap and start - e - 1 <= self.gap:
                    total = value + min(n, end - e, place - p)
                    if total > covered or (total == covered and s > begin):
                        covered, begin, before = total, s, node
            if before is not None:
                before[4] = True
            nodes.append([end, place, covered, begin, False])
        self.open.extend(nodes)

    def _close(self, node: list) -> None:
        end, _, covered, begin, grown = node
        if not grown and covered >= self.least:
            self.found.append((begin, end, covered))

    def spans(self) -> list[tuple[int, int, int]]:
        """Spans without overlap that cover most: (first word, last word, words of the template)."""
        while self.open:
            self._close(self.open.popleft())
        found = sorted(set(self.found), key=lambda x: (x[1], x[0], x[2]))
        ends = [e for _, e, _ in found]
        best, take = [0], []
        for k, (s, _, covered) in enumerate(found):
            before = bisect_left(ends, s, 0, k)
            with_it = best[before] + covered
            take.append((with_it > best[-1], before))
            best.append(max(best[-1], with_it))
        out, k = [], len(found)
        while k:
            used, before = take[k - 1]
            if used:
                out.append(found[k - 1])
                k = before
            else:
                k -= 1
        return out[::-1]


def scan_licenses(
    docs: DataFrame, templates=None, phrases=None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
    min_share: float = MIN_SHARE, with_text: bool = True,
) -> DataFrame:
    """Phrases and template spans of each text.

    Adds `n_words`; `n_base`, `first_word`, `last_word` (places where the words of one of `phrases`, (phrase, label), stand, and
    their least and greatest start); `base_labels`; `labels` (those and the labels of spans, sorted); `spans`
    (label, number of the template, first and last word, words of the template covered, their share); and `score`, the largest
    share of a span, or 0.5 for a phrase alone, or 0. Input columns with these names give way; `with_text=False`
    leaves the text out.

    Words of a text stream through an automaton of all `templates`, (label, text), which gives the longest match of
    each template at each word. Maximal matches of `min_match` words or more are chained where they follow each
    other in text and template with at most `max_gap` words left out; a chain that covers `min_share` of a template is
    a span. Spans of one template don't overlap. The time for a text is linear in its words, for any length.

    Null or empty texts have no words, spans or labels and score 0; rows that repeat are judged each; an empty
    table gives an empty result.
    """
    docs = without(docs, OUT)
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    own = [f for f in docs.schema.fields if with_text or f.name != "text"]
    names = [f.name for f in own]

    def make():
        scanner = Scanner(templates, phrases, min_match, max_gap, min_share)

        def apply(rows):
            out = {n: rows[n] for n in names}
            found = [scanner.scan(t) for t in rows["_bytes"]]
            out["n_words"], out["n_base"], out["first_word"], out["last_word"] = ([f[k] for f in found] for k in range(4))
            out["base_labels"] = [sorted(f[4]) for f in found]
            out["labels"] = [sorted(f[4] | {s[0] for s in f[5]}) for f in found]
            fields = ("label", "template", "first_word", "last_word", "covered", "share")
            out["spans"] = [[dict(zip(fields, s)) for s in f[5]] for f in found]
            out["score"] = [max([s[5] for s in f[5]] + [PHRASE_SCORE if f[4] else 0.0]) for f in found]
            return out

        return apply

    added = T.StructType.fromDDL(
        "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        f"spans array<{SPAN}>, score double"
    )
    schema = T.StructType([*own, *added.fields])
    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").cast("binary").alias("_bytes"))
    return arrow_map(source, schema, make)
