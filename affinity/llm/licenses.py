"""License notices: exact phrases and fuzzy search for short notices.

A text is reduced to lower-case words. Base phrases count wherever their words stand
consecutively. A notice of ``n`` characters is found within ``k`` edits by the pigeonhole
principle: cut into ``k + 1`` seeds, any match holds one seed unchanged. One automaton
finds all seeds in a linear pass over the reduced text. Whole words that begin within ``k`` characters of where
a seed puts the notice, and are within ``k`` characters as long, are candidates; the bounded-error
matching of the regex library verifies each of them from end to end, and reports its span in words.
Of candidates of one notice that overlap, the one with the fewest edits counts, the first of equals.

Defined results: null text is empty, with no words, no labels and score 0; repeated rows
are each scanned; a label found both ways is listed once; further columns of the input
are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw

# fixed values: the base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: short notices as their words stand, label, and edits allowed
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("licensed under the bsd license", "bsd", 3),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("licensed under cc by", "cc-by", 1),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("this work is in the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
    ("proprietary and confidential", "proprietary", 2),
]

#: ASCII letters (lower-cased) and digits, and all beyond ASCII, make words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: str, n: int) -> list[tuple[int, str]]:
    """``text`` cut into ``n`` parts of near equal length, each with its place."""
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Seeds and patterns of a set of notices."""

    def __init__(self, notices: list[tuple[str, str, int]] = NOTICES) -> None:
        self.notices = notices
        self.patterns = [regex.compile(rf"(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH) for text, _, k in notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k) in enumerate(notices):
            for at, seed in pieces(text, k + 1):
                found.setdefault(seed, []).append((i, at))
        for seed, uses in found.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified ``(notice, first character, end, edits)``, leftmost first, none overlapping one of its notice."""
        borders = lambda low, high: [x for x in range(max(low, 0), min(high, len(text)) + 1) if x in (0, len(text)) or " " in text[x - 1 : x + 1]]
        begins: dict[int, set[int]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for i, at in uses:
                k, begin = self.notices[i][2], last - size + 1 - at
                begins.setdefault(i, set()).update(x for x in borders(begin - k, begin + k) if x < len(text) and text[x] != " ")
        out = []
        for i, own in begins.items():
            notice, _, k = self.notices[i]
            found = []
            for a in own:
                for b in borders(a + len(notice) - k, a + len(notice) + k):
                    if b > a and text[b - 1] != " " and (m := self.patterns[i].fullmatch(text, a, b)):
                        found.append((sum(m.fuzzy_counts), a, b))
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(found):
                at = bisect.bisect(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b))
                    out.append((i, a, b, edits))
        return sorted(out, key=lambda x: x[1:])


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def phrase_places(text: str, phrase: str) -> list[int]:
    """Where the phrase's words stand consecutively in ``text``, words joined by one space."""
    out, at = [], text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


def scan_text(data: bytes | None, scan: Scanner) -> dict:
    """All that one text yields; ``spans`` are ``(label, first word, last word, edits)``."""
    words = (data or b"").translate(WORDS).split()
    text = b" ".join(words).decode(errors="replace")
    at = [(p, label) for phrase, label in PHRASES.items() for p in phrase_places(text, phrase)]
    fuzzy = scan.places(text)
    begins = list(itertools.accumulate((len(w) + 1 for w in text.split(" ")), initial=0)) if at or fuzzy else []
    word = lambda p: bisect.bisect_right(begins, p) - 1
    spans = [(scan.notices[i][1], word(a), word(max(a, b - 1)), edits) for i, a, b, edits in fuzzy]
    base, labels = {x for _, x in at}, {x for _, x in at} | {x[0] for x in spans}
    # a base phrase is certain; a fuzzy one counts by the share of its characters that stand unedited
    sure = max([1.0] * bool(at) + [1 - edits / len(scan.notices[i][0]) for i, _, _, edits in fuzzy], default=0.0)
    return {"n_words": len(words), "n_base": len(at), "first_word": word(min(at)[0]) if at else None, "last_word": word(max(at)[0]) if at else None, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": sure, "spans": spans}


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def scan(docs: DataFrame, notices: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = Scanner(notices) if notices else scanner()
        found = [scan_text(x, use) for x in raw(batch, "text")]
        column = lambda name, kind: pa.array([x[name] for x in found], kind)
        spans = pa.array([[dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in x["spans"]] for x in found], SPANS)
        whole, string = pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), column("n_words", whole), column("n_base", whole), column("first_word", whole), column("last_word", whole), column("base_labels", string), column("labels", string), column("score", pa.float64()), spans],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")
