"""License notices found by conditional compression.

A block of text around each licence cue is compressed once alone and once with each
template as a raw zstandard dictionary. The template that shrinks the block most is the
candidate, and it is confirmed by its exact wording: words missing from the template and words
put between its words are counted, and a difference in a number or a negation refuses it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, slices, tidy

# The wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
CUE = re.compile(r"licen[cs]e|copyright|redistribut|permission is hereby|free software|public domain|\bCC[ -]|SPDX", re.IGNORECASE)
WORD = re.compile(r"\w+(?:[.-]\w+)*")
REACH = 160
NEGATIONS = {"no", "not", "without", "non", "nc", "nd", "sa", "except"}


def words_at(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def regions(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[list[int]]]:
    """The words of a text with a cue, and (low, high) in words: reach words to either side of each cue, joined where they meet."""
    cues = [m.start() for m in CUE.finditer(text)]
    if not cues:
        return [], []
    spans = words_at(text)
    index, near = 0, []
    for cue in cues:
        while index + 1 < len(spans) and spans[index + 1][1] <= cue:
            index += 1
        low, high = max(0, index - reach), min(len(spans), index + reach + 1)
        if near and low <= near[-1][1]:
            near[-1][1] = high
        else:
            near.append([low, high])
    return spans, near


class Scanner:
    def __init__(self, templates: dict[str, str], max_missing: float = 0.1, max_extra: float = 0.1):
        self.max_missing, self.max_extra = max_missing, max_extra
        if cueless := [name for name, text in templates.items() if not CUE.search(text)]:
            raise ValueError(f"templates without a licence cue are not looked for: {cueless}")
        self.alone = zstandard.ZstdCompressor(level=3)
        self.templates = [
            (name, [w for w, _, _ in words_at(text)], zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
            for name, text in templates.items()
        ]
        longest = max((len(words) for _, words, _ in self.templates), default=0)
        self.overlap = max(REACH, int(longest * (1 + max_extra)) + 1)  # a confirmed notice is not longer, so a cue in it has all of it within as many words

    def wording(self, words: list[str], found: list[tuple[str, int, int]]) -> tuple[int, int, list[str], list[str]] | None:
        """(first, last, missing, extra): the stretch of found that holds the template's words, and the differences."""
        matcher = SequenceMatcher(None, words, [w for w, _, _ in found], autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        if not blocks:
            return None
        top = max(blocks, key=lambda b: b.size)
        slack = len(words)
        near = [b for b in blocks if abs((b.b - b.a) - (top.b - top.a)) <= slack]
        first, last = near[0].b, near[-1].b + near[-1].size - 1
        held = {k for b in near for k in range(b.a, b.a + b.size)}
        inside = {k for b in near for k in range(b.b, b.b + b.size)}
        missing = [w for k, w in enumerate(words) if k not in held]
        extra = [found[k][0] for k in range(first, last + 1) if k not in inside]
        return first, last, missing, extra

    def scan(self, text: str) -> list[tuple]:
        """(block_start, block_end, template, plain_size, reduction, notice_start, notice_end, missing, extra, confirmed) for each block.

        Templates are tried by falling reduction; the first whose wording is confirmed wins, else the first is
        reported unconfirmed. A winner's stretch is then taken as read and the rest of the block tried again.
        Long regions are read in windows that overlap by more than a notice. A notice belongs to the window in
        whose part before the overlap it starts; the next window starts behind it.
        """
        out = []
        spans, near = regions(text, self.overlap)
        starts = [i for _, i, _ in spans]
        for low, high in near:
            at, held = low, ("", 0)
            while at < high:
                stop = min(high, at + self.overlap + 3 * REACH)
                own = spans[stop - self.overlap][1] if stop < high else len(text)
                rows = self.window(text, spans[at][1], spans[stop - 1][2], own, held)
                out += rows
                if stop == high:
                    break
                read = max((row[6] for row in rows if row[-1]), default=0)
                at = max(stop - self.overlap, bisect_left(starts, read))
                held = max(((row[2], row[6]) for row in rows if not row[-1]), key=lambda x: x[1], default=held)
        return sorted(out)

    def window(self, text: str, start: int, end: int, own: int, held: tuple[str, int]) -> list[tuple]:
        """The rows of text[start:end] whose notices start before own; held is (template, notice_end) of the last unconfirmed one before."""
        out, todo = [], [(start, end)]
        while todo:
            a, z = todo.pop()
            block = text[a:z]
            if not CUE.search(block):
                continue
            raw = block.encode("utf-8", "replace")
            plain = len(self.alone.compress(raw))
            ranked = sorted(((plain - len(c.compress(raw)), k) for k, (_, _, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
            found = [(w, a + i, a + j) for w, i, j in words_at(block)]
            best = None
            for reduction, k in ranked:
                if reduction <= 0:
                    break
                name, words, _ = self.templates[k]
                if not (w := self.wording(words, found)):
                    continue
                first, last, missing, extra = w
                grave = any(x in NEGATIONS or any(c.isdigit() for c in x) for x in missing + extra)
                confirmed = not grave and len(missing) <= self.max_missing * len(words) and len(extra) <= self.max_extra * len(words)
                row = (a, z, name, plain, reduction, found[first][1], found[last][2], len(missing), len(extra), confirmed)
                if confirmed:
                    best = row
                    break
                best = best or row
            if not best:
                continue
            rest = [(a, best[5]), (best[6], z)]
            if best[5] >= own:  # the next window has it whole
                rest = rest[:1]
            elif not best[-1] and best[2] == held[0] and best[5] < held[1]:
                pass  # the rest of a notice that the window before has reported
            else:
                out.append(best)
                if not best[-1]:
                    continue
            todo += [(x, y) for x, y in rest if y > x]
        return out


NAMES = ["doc_id", "block_start", "block_end", "template", "plain_size", "reduction", "notice_start", "notice_end", "n_missing", "n_extra", "confirmed"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.bool_()]
SCHEMA = "doc_id long, block_start long, block_end long, template string, plain_size long, reduction long, notice_start long, notice_end long, n_missing long, n_extra long, confirmed boolean"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each block with a cue that some template shrinks; places are in characters. Texts without a cue, empty and null ones give no rows.

    Repeated rows and rows without an id are read like all others; an empty table gives no rows. templates may be of any
    length, as the words read around a cue follow the longest; each must hold a cue itself, else a ValueError says so.
    """
    chosen = templates or TEMPLATES
    Scanner(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for ids, texts in slices(batches):
            rows = [(doc_id, *row) for doc_id, text in zip(ids.to_pylist(), texts, strict=True) for row in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return id_and_text(docs).mapInArrow(tidy(run), SCHEMA)


def q_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
