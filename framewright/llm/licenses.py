"""License scans: fuzzy search for short notices.

A notice of length n with at most e edits is cut into e + 1 pieces; by the
pigeonhole principle one piece stands unharmed in every match. An Aho-Corasick
automaton finds all pieces, an exact comparison confirms unharmed notices at the
implied place, and the regex library's bounded-error matching verifies the other
candidates, from the start of a word to the end of one, and reports their spans
and edits. Each word of a run of candidates is tried once as a beginning; the best match is taken first, then the best of
those that it leaves room for, so no match hides another beside it and the work follows the length of the text.

Texts are compared in canonical form: words (see words.py) joined by one space.

Defined results: null and empty texts have no words and no labels (score 0);
places, spans and labels do not depend on row order; repeated rows give repeated
results; ties between spans go to the smaller start.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewright.llm.common import Texts, batch_of, map_batches
from framewright.llm.words import word_list


@dataclass(frozen=True)
class Notice:
    phrase: str  # lower-case words joined by one space
    label: str
    edits: int  # most characters inserted, deleted or replaced
    base: bool = False  # counted where it stands unharmed, word for word


#: The four base notices, and the method's own longer ones.
NOTICES = (
    Notice("gnu general public license", "gpl", 3, True),
    Notice("apache license", "apache", 1, True),
    Notice("cc by", "cc-by", 0, True),
    Notice("mit license", "mit", 1, True),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("permission is hereby granted free of charge", "mit-style", 4),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("all rights reserved", "all-rights-reserved", 2),
)


def aligned(text: str, start: int, stop: int) -> bool:
    """Whether a span begins and ends with words."""
    return (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " ")


class Scanner:
    def __init__(self, notices: Sequence[Notice] = NOTICES):
        self.notices = tuple(notices)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            n, parts = len(notice.phrase), notice.edits + 1
            cuts = [n * i // parts for i in range(parts + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(notice.phrase[lo:hi], []).append((k, lo))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?be)(?<![^ ])(?:{regex.escape(x.phrase)}){{e<={x.edits}}}(?![^ ])") for x in self.notices]

    def matches(self, k: int, text: str, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """(start, stop, edits) of disjoint matches of a notice between two places: the fewest edits first, of equals the first one.

        Every word of the window is tried once as a beginning, within the length that a match can have; a match that runs
        into one taken before it is tried again up to there, so the work follows the window's length.
        """
        longest, edits = len(self.notices[k].phrase) + self.notices[k].edits, self.notices[k].edits
        least = len(self.notices[k].phrase) - edits

        def limit(start: int, stop: int) -> int:
            """The last end of a word at most `longest` after start and not beyond stop."""
            stop = min(stop, start + longest)
            return stop if stop == len(text) or text[stop] == " " else text.rfind(" ", start, stop)

        def found(start: int, stop: int) -> tuple[int, int, int] | None:
            stop = limit(start, stop)
            if stop - start < least or not (m := self.patterns[k].match(text, start, stop)) or m.end() <= start:
                return None
            return sum(m.fuzzy_counts), start, m.end()

        at, heap = first, []
        if 0 < at < last and text[at - 1] != " ":
            at = text.find(" ", at, last) + 1 or last
        while at < last:
            if text[at] != " " and (m := found(at, last)):
                heap.append(m)
            at = text.find(" ", at, last) + 1 or last
        heapq.heapify(heap)
        starts: list[int] = []  # of the matches taken, in order, with their stops
        stops: list[int] = []
        while heap:
            n, start, stop = heapq.heappop(heap)
            spot = bisect.bisect_left(starts, start)
            if (spot < len(starts) and starts[spot] == start) or (spot and stops[spot - 1] >= start):
                continue
            if spot < len(starts) and starts[spot] <= stop:
                if m := found(start, starts[spot] - 1):
                    heapq.heappush(heap, m)
                continue
            starts.insert(spot, start)
            stops.insert(spot, stop)
            yield start, stop, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(base places: notice, word), (other spans: notice, start, end, edits), places in characters of the canonical form."""
        text = b" ".join(words).decode("latin-1")
        exact: set[tuple[int, int]] = set()
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for k, lo in uses:
                notice = self.notices[k]
                at = end + 1 - size - lo
                n = len(notice.phrase)
                if at >= 0 and text.startswith(notice.phrase, at) and aligned(text, at, at + n):
                    exact.add((k, at))
                    continue
                if not notice.edits:
                    continue
                first, last = max(0, at - notice.edits), min(len(text), at + n + 2 * notice.edits + 1)
                runs = windows.setdefault(k, [])
                if runs and first <= runs[-1][1]:
                    runs[-1][0] = min(first, runs[-1][0])
                    runs[-1][1] = max(last, runs[-1][1])
                else:
                    runs.append([first, last])
        base, spans = [], []
        for k, at in sorted(exact, key=lambda x: (x[1], x[0])):
            n = len(self.notices[k].phrase)
            if self.notices[k].base:
                base.append((k, text.count(" ", 0, at)))
            spans.append((k, at, at + n, 0))
        for k, runs in windows.items():
            known = [s for s in spans if s[0] == k and not s[3]]
            for first, last in runs:
                # unharmed notices part the run
                cuts = sorted((a, b) for _, a, b, _ in known if a < last and first < b)
                for lo, hi in zip([first, *(b + 1 for _, b in cuts)], [*(a - 1 for a, _ in cuts), last], strict=True):
                    spans += ((k, a, b, e) for a, b, e in self.matches(k, text, lo, hi))
        return base, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: bigint, stop: bigint, edits: int>>"
)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row for each row of df: labels, base places and fuzzy spans of its whole text.

    score is the share of a notice's characters that its best match keeps (1 for an unharmed one).
    """
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    made: list[Scanner] = []
    struct = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(notices))
        scanner, texts = made[0], Texts(batch.column(1))
        rows = []
        for i in range(len(texts)):
            words = word_list(texts.text(i))
            base, spans = scanner.scan(words)
            at = [w for _, w in base]
            label = lambda k: scanner.notices[k].label
            rows.append((
                len(words), len(base), min(at, default=None), max(at, default=None),
                ",".join(sorted({label(k) for k, _ in base})), ",".join(sorted({label(k) for k, _ in base} | {label(s[0]) for s in spans})),
                max((1.0 - s[3] / len(scanner.notices[s[0]].phrase) for s in spans), default=0.0),
                [{"label": label(k), "start": a, "stop": b, "edits": e} for k, a, b, e in spans],
            ))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
        return batch_of(names, [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {SCAN}")
