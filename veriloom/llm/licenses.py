"""License scans: exact phrases, and fuzzy search for short notices."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices in normalised words, and the label that each adds.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

SPANS = "array<struct<label:string,start_word:bigint,end_word:bigint,edits:int,likeness:double>>"


class NoticeSearch:
    """A notice may have k = len // error_every edits: of its k + 1 pieces one then stands in the text unchanged."""

    def __init__(self, notices: dict[str, str], error_every: int = 12):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        self.notices = []
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            k = len(notice) // error_every
            edges = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(edges, edges[1:]):
                at.setdefault(notice[a:b], []).append((n, a))
            pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])")
            self.notices.append((label, len(notice), k, pattern))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def spans(self, norm: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, likeness) of each verified match in the normalised text, by label and place.

        Each seed is searched in a window of its own, a little longer than the notice, so that a text costs in proportion to
        its seeds; a seed inside an exact match of its notice needs no search.
        """
        found: set[tuple[str, int, int, int, float]] = set()
        exact: dict[int, int] = {}
        for end, (size, places) in self.seeds.iter(norm):
            for n, a in places:
                if end < exact.get(n, 0):
                    continue
                label, length, k, pattern = self.notices[n]
                lo = max(0, end + 1 - size - a - k - 1)
                parts = [(lo, min(end + 1 - size - a + length + k + 1, len(norm)))]
                while parts:  # the best match of a part, then what lies before and behind it
                    x, y = parts.pop()
                    m = pattern.search(norm, x, y) if y - x >= length - k else None
                    if m:
                        edits = sum(m.fuzzy_counts)
                        found.add((label, m.start(), m.end(), edits, 1.0 - edits / length))
                        if not edits:
                            exact[n] = max(exact.get(n, 0), m.end())
                        parts += (x, m.start() - 1), (m.end(), y)
        starts: list[int] = []
        kept: list[tuple[str, int, int, int, float]] = []
        for span in sorted(found, key=lambda x: (-x[4], x[1], x[0])):  # of notices that overlap, the likeliest
            at = bisect_left(starts, span[1])
            if (at == 0 or kept[at - 1][2] <= span[1]) and (at == len(kept) or span[2] <= starts[at]):
                starts.insert(at, span[1])
                kept.insert(at, span)
        return sorted(kept)


_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return (text or "").encode().translate(_KEEP).split()


def phrase_places(norm: bytes, phrases: list[bytes]) -> Iterator[tuple[int, int]]:
    """(phrase, start word) for every place; norm has one space between words and at both ends."""
    spaces = None
    for k, phrase in enumerate(phrases):
        at = norm.find(phrase)
        while at >= 0:
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
            yield k, int(np.searchsorted(spaces, at))
            at = norm.find(phrase, at + 1)


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, error_every: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    `spans` has the notices found with at most len // error_every edits (insertions, deletions, substitutions), in words
    of the normalised text.  `score` is the likeness of the best match, 1 for a phrase found as it is, 0 without any.
    Null and empty texts have no words and no labels; repeated rows are scanned each; other columns are ignored.  The
    scan goes once over each whole text and once over a window at each seed: long texts cost in proportion to their
    length and to the places where a piece of a notice stands.
    """
    marked = [b" " + p.encode() + b" " for p in phrases]
    names = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, error_every)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = normal_words(text.as_py())
                joined = b" ".join(words)
                places = sorted((w, k) for k, w in phrase_places(b" " + joined + b" ", marked))
                norm = joined.decode()
                found = search.spans(norm)
                starts = np.cumsum([0, *(len(w) + 1 for w in norm.split(" "))]) if found else None  # of each word
                spans = [
                    {"label": label, "start_word": int(np.searchsorted(starts, a, side="right")) - 1, "end_word": int(np.searchsorted(starts, b, side="right")) - 1, "edits": edits, "likeness": like}
                    for label, a, b, edits, like in found
                ]
                base = sorted({names[k] for _, k in places})
                score = 1.0 if places else max((s["likeness"] for s in spans), default=0.0)
                row = (doc_id.as_py(), len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *(s["label"] for s in spans)})), score, spans)
                for column, value in zip(out, row):
                    column.append(value)
            span = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())])
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}")
